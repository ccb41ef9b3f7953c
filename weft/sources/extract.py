"""Extractors: one source file to fact rows (kind, start, end, data as JSON).

Parsers that no expression can replace, written as small scanners and run inside ``mapInPandas``. Facts fail closed: a
template with an unbalanced block gives no template facts, only an issue. What cannot be known statically (a dynamic name,
a computed selector) is a fact of its own kind, ``uncertain``, never an error. Offsets are in characters; see
``functions.text.utf16_length`` for UTF-16 units.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from weft.functions.values import GRAPHQL_OWNERS

Fact = tuple[str, int, int, dict]

TAG = re.compile(r"\{%-?\s*(?P<tag>.*?)\s*-?%\}|\{\{-?\s*(?P<out>.*?)\s*-?\}\}", re.S)
#: Blocks whose body is not template text, and blocks that must be closed.
OPAQUE = {"comment", "raw", "schema", "javascript", "stylesheet", "style", "doc", "script"}
BLOCKS = {"if", "unless", "case", "for", "tablerow", "form", "paginate", "capture"}
#: Tag to reference kind.
DEPENDENCY_TAGS = {"render": "snippet", "include": "snippet", "section": "section", "sections": "section-group", "layout": "layout"}
STRING = re.compile(r"\"([^\"]*)\"|'([^']*)'")
PATH = re.compile(r"(?<![\w.\-:])([A-Za-z_][\w-]*\??)((?:\s*\.\s*[\w-]+\??|\[[^\[\]]*\])*)(?!\s*:)")
WORDS = {"and", "or", "contains", "in", "by", "with", "as", "true", "false", "nil", "null", "blank", "empty", "limit", "offset", "reversed", "cols", "if", "else"}


def _reads(text: str, at: int) -> Iterator[Fact]:
    """Variable reads of an expression: root, path, whether it has a computed part."""
    plain = STRING.sub(lambda m: m[0][0] + " " * (len(m[0]) - 2) + m[0][0], text)
    plain = re.sub(r"\|\s*[\w-]+", lambda m: " " * len(m[0]), plain)  # filter names
    for m in PATH.finditer(plain):
        if m[1] in WORDS or text[m.start() - 1 : m.start()] in ("'", '"'):
            continue
        parts, dynamic = [], False
        for p in re.finditer(r"\.\s*([\w-]+\??)|\[([^\[\]]*)\]", text[m.start(2) : m.end(2)]):
            literal = STRING.fullmatch((p[2] or "").strip())
            if p[1]:
                parts.append(p[1])
            elif literal:
                parts.append(literal[1] or literal[2] or "")
            else:
                dynamic = True
                parts.append((p[2] or "").strip())
        yield "template.read", at + m.start(), at + m.end(), {"root": m[1], "path": parts, "dynamic": dynamic}


def template_facts(source: str) -> list[Fact]:
    """References, reads, bindings, conditionals, guards, render arguments, asset and locale names, doc parameters and schema."""
    facts: list[Fact] = []
    stack: list[tuple[str, int, int]] = []
    bindings: list[tuple[str, int, int | None, int]] = []  # name, from, to, depth of the block that ends it
    opaque: tuple[str, int] | None = None
    for m in TAG.finditer(source):
        tag, at = m["tag"], m.start()
        name, _, rest = (tag or "").partition(" ")
        name, rest = name.strip(), rest.strip()
        if opaque:
            if name == "end" + opaque[0]:
                body, start = source[opaque[1] : at], opaque[1]
                if opaque[0] == "schema" and not any(f[0] == "template.schema" for f in facts):
                    facts.append(("template.schema", start, at, {"body": body}))
                if opaque[0] == "doc":
                    for line in re.finditer(r"^\s*@param\s+(?:\{([^}]*)\}\s+)?(\[?)([\w-]+)\]?(?:\s*-\s*(.*))?\s*$", body, re.M):
                        facts.append(("template.param", start + line.start(), start + line.end(), {"type": line[1], "name": line[3], "optional": bool(line[2]), "text": line[4]}))
                if opaque[0] in ("javascript", "stylesheet", "style", "script"):
                    facts.append(("embedded." + opaque[0], start, at, {}))
                opaque = None
            continue
        expression, offset = (m["out"], m.start("out")) if tag is None else (rest, m.start("tag") + (len(tag) - len(rest) if rest else len(tag)))
        if tag is not None and name in OPAQUE:
            opaque = (name, m.end())
            continue
        if tag is not None and name in BLOCKS:
            stack.append((name, at, m.end()))
        elif tag is not None and name.startswith("end"):
            if not stack or stack[-1][0] != name[3:]:
                return [("issue", at, m.end(), {"code": "TEMPLATE_SYNTAX", "message": f"unexpected {name}"})]
            bindings = [(b, s, at if e is None and d == len(stack) else e, d) for b, s, e, d in bindings]
            kind, start, _ = stack.pop()
            if kind in ("if", "unless", "case"):
                facts.append(("template.conditional", start, m.end(), {"name": kind}))
            continue
        if tag is not None and name in DEPENDENCY_TAGS and not re.match(r"[A-Z]\w*\s*(?:\{|$)", rest):
            target = STRING.match(rest)
            static = target[1] or target[2] if target else ("none" if name == "layout" and rest == "none" else None)
            facts.append(("template.reference", at, m.end(), {"kind": DEPENDENCY_TAGS[name], "name": static}))
            if static is None:
                facts.append(("uncertain", at, m.end(), {"code": "DYNAMIC_REFERENCE", "text": rest}))
            for a in re.finditer(r"[,\s]([\w-]+)\s*:", rest):
                facts.append(("template.argument", at, m.end(), {"name": a[1], "target": static}))
            for a in re.finditer(r"\b(?:with|for)\b\s+[^,]*?\bas\s+([\w-]+)", rest):
                facts.append(("template.argument", at, m.end(), {"name": a[1], "target": static}))
        if tag is not None and name in ("component", "import", "props", "blocks") or name == "render" and re.match(r"[A-Z]\w*\s*(?:\{|$)", rest):
            facts.extend(_component(name, rest, at, m.end()))
            continue
        if name in ("assign", "capture", "increment", "decrement") and (b := re.match(r"([\w-]+)", rest)):
            bindings.append((b[1], at, None, 0))
            expression, offset = (rest.partition("=")[2], offset + rest.find("=") + 1) if "=" in rest else ("", offset)
        if name in ("for", "tablerow") and (b := re.match(r"([\w-]+)\s+in\s+", rest)):
            bindings += [(b[1], m.end(), None, len(stack)), (name + "loop", m.end(), None, len(stack))]
            expression, offset = rest[b.end() :], offset + b.end()
        if name in ("if", "unless", "elsif") and re.fullmatch(r"[A-Za-z_][\w-]*", rest):
            facts.append(("template.guard", at, m.end(), {"name": rest}))
        for d in re.finditer(r"([A-Za-z_][\w-]*)\s*\|\s*default\s*:", expression or ""):
            facts.append(("template.guard", at, m.end(), {"name": d[1]}))
        for s in re.finditer(r"(?:\"([^\"]*)\"|'([^']*)')\s*\|\s*(asset_url|asset_img_url|translate|t)\b", expression or ""):
            kind = "template.asset" if s[3].startswith("asset") else "template.locale"
            facts.append((kind, offset + s.start(), offset + s.end(), {"name": s[1] or s[2] or ""}))
        facts.extend(_reads(expression or "", offset))
    if opaque or stack:
        return [("issue", 0, len(source), {"code": "TEMPLATE_SYNTAX", "message": f"unclosed {opaque[0] if opaque else stack[-1][0]}"})]
    scopes = [(b, s, len(source) if e is None else e) for b, s, e, _ in bindings]
    facts += [("template.binding", s, e, {"name": b}) for b, s, e in scopes]
    out = []
    for kind, s, e, data in facts:
        if kind == "template.read":
            data["local"] = any(b == data["root"] and x <= s <= y for b, x, y in scopes)
            path = data["path"]
            if not data["local"] and path and (data["root"] == "settings" or data["root"] in ("section", "block") and path[0] == "settings" and len(path) > 1):
                out.append(("template.setting", s, e, {"object": data["root"] if data["root"] != "settings" else "settings", "name": path[0] if data["root"] == "settings" else path[1]}))
            if path and "metafields" in path[:1]:
                keys = path[1:3]
                out.append(("template.metafield", s, e, {"owner": data["root"], "namespace": keys[0] if keys else None, "key": keys[1] if len(keys) > 1 else None, "dynamic": data["dynamic"] or len(keys) < 2}))
        out.append((kind, s, e, data))
    return out


def _component(name: str, rest: str, start: int, end: int) -> list[Fact]:
    if name == "component":
        return [("component.kind", start, end, {"kind": rest.strip() or None})]
    if name == "import":
        m = re.match(r"(\w+)\s+from\s+(?:\"([^\"]+)\"|'([^']+)')", rest)
        return [("component.import", start, end, {"local": m[1], "specifier": m[2] or m[3]})] if m else [("issue", start, end, {"code": "COMPONENT_IMPORT", "message": rest})]
    if name == "render":
        return [("component.render", start, end, {"local": re.match(r"\w+", rest)[0], "arguments": re.findall(r"[{,]\s*([\w-]+)\s*:", rest)})]
    if name == "blocks":
        return [("component.blocks", start, end, {"names": re.findall(r"\w+", rest)})]
    return [("component.prop", start, end, {"name": n}) for n in re.findall(r"(?:^\{|,)\s*(\w+)\s*:\s*[a-z]+\b", rest)]


def _masked(source: str) -> str:
    blank = lambda m: re.sub(r"[^\n\r]", "\u0000", m[0])
    return TAG.sub(blank, re.sub(r"\{%-?\s*(schema|javascript|stylesheet|style|doc|comment|raw)\b.*?\{%-?\s*end\1\s*-?%\}", blank, source, flags=re.S))


def markup_facts(source: str) -> list[Fact]:
    """Class tokens, ids, data attributes and custom elements of the markup; names that a template computes are uncertain."""
    facts: list[Fact] = []
    for m in re.finditer(r"<([a-zA-Z][\w-]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>", _masked(source)):
        hook = lambda kind, name: ("behavior", m.start(), m.end(), {"subject": kind, "name": name, "role": "emits"})  # noqa: B023, E731
        if "-" in m[1]:
            facts.append(("behavior", m.start(), m.end(), {"subject": "customElement", "name": m[1].lower(), "role": "uses"}))
        for a in re.finditer(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", m[2]):
            value = a[2] or a[3] or a[4] or ""
            if a[1] in ("class", "id"):
                for token in value.split():
                    facts.append(("uncertain", m.start(), m.end(), {"code": "DYNAMIC_" + a[1].upper(), "text": a[1]}) if "\u0000" in token else hook(a[1], token))
            elif a[1].startswith("data-"):
                facts.append(hook("attribute", a[1]))
    return facts


def style_facts(source: str) -> list[Fact]:
    """Selected classes, ids and attributes, defined and read custom properties."""
    text = re.sub(r"/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)
    if text.count("{") != text.count("}"):
        return [("issue", 0, len(source), {"code": "STYLE_SYNTAX", "message": "unbalanced braces"})]
    facts: list[Fact] = []
    add = lambda m, kind, name, role: facts.append(("behavior", m.start(), m.end(), {"subject": kind, "name": name, "role": role}))
    for block in re.finditer(r"([^{};]+)\{", text):
        if block[1].lstrip().startswith("@"):
            continue
        for m in re.finditer(r"\.(-?[_a-zA-Z][\w-]*)|#([_a-zA-Z][\w-]*)|\[([\w-]+)[^\]]*\]", block[1]):
            for kind, name in (("class", m[1]), ("id", m[2]), ("attribute", m[3])):
                if name:
                    add(re.compile(re.escape(m[0])).search(text, block.start()), kind, name, "selects")
    for m in re.finditer(r"(?<![\w-])(--[\w-]+)\s*:", text):
        add(m, "customProperty", m[1], "defines")
    for m in re.finditer(r"var\(\s*(--[\w-]+)", text):
        add(m, "customProperty", m[1], "reads")
    return facts


#: JavaScript call or member, subject, role. Scope: calls with a literal first argument; anything else is uncertain.
_CALLS = (
    (r"(?:querySelector(?:All)?|matches|closest)", "selector", "queries"),
    (r"getElementById", "id", "queries"),
    (r"(?:get|has)Attribute", "attribute", "queries"),
    (r"(?:set|remove|toggle)Attribute", "attribute", "mutates"),
    (r"classList\.(?:add|remove|toggle|replace)", "class", "mutates"),
    (r"classList\.contains", "class", "queries"),
    (r"addEventListener", "customEvent", "listens"),
    (r"customElements\.define", "customElement", "defines"),
    (r"new\s+CustomEvent", "customEvent", "dispatches"),
)


def script_facts(source: str) -> list[Fact]:
    """DOM hooks, events, custom elements, data attributes, module imports and network calls of a script."""
    text = re.sub(r"/\*.*?\*/|(?<![:\\])//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)
    facts: list[Fact] = []
    add = lambda m, kind, name, role: facts.append(("behavior", m.start(), m.end(), {"subject": kind, "name": name, "role": role}))
    for call, subject, role in _CALLS:
        for m in re.finditer(rf"\b{call}\(\s*(?:\"([^\"]*)\"|'([^']*)'|`([^`$]*)`|([^)]))", text):
            value = next((v for v in m.groups()[:3] if v is not None), None)
            if value is None:
                facts.append(("uncertain", m.start(), m.end(), {"code": "DYNAMIC_" + subject.upper(), "text": m[0]}))
            elif subject == "selector":
                for s in re.finditer(r"\.(-?[_a-zA-Z][\w-]*)|#([_a-zA-Z][\w-]*)|\[([\w-]+)[^\]]*\]|(?<![\w.#\[-])([a-z]+-[\w-]+)", value):
                    kind = "class" if s[1] else "id" if s[2] else "attribute" if s[3] else "customElement"
                    add(m, kind, s[1] or s[2] or s[3] or s[4], role)
            elif subject != "attribute" or value.startswith("data-"):
                add(m, subject, value, role)
    for m in re.finditer(r"\.dataset\.([A-Za-z]\w*)", text):
        add(m, "attribute", "data-" + re.sub(r"([A-Z])", lambda c: "-" + c[1].lower(), m[1]), "queries")
    for m in re.finditer(r"^\s*(?:import|export)\b[^'\"\n;]*?\bfrom\s*['\"]([^'\"]+)['\"]|^\s*import\s*['\"]([^'\"]+)['\"]|\bimport\(\s*['\"]([^'\"]+)['\"]\s*\)", text, re.M):
        facts.append(("script.import", m.start(), m.end(), {"specifier": m[1] or m[2] or m[3]}))
    for m in re.finditer(r"\bfetch\(\s*(?:['\"`]([^'\"`$]*)['\"`])?|\.open\(\s*['\"](\w+)['\"]\s*,\s*['\"]([^'\"]*)['\"]|\bsendBeacon\(\s*['\"]([^'\"]*)['\"]", text):
        url = m[1] or m[3] or m[4]
        facts.append(("network", m.start(), m.end(), {"url": url, "graphql": "static" if url and "graphql" in url else "none" if url else "dynamic"}))
    for m in re.finditer(r"(?:['\"`])((?:\s*(?:query|mutation)\b|\s*\{)[^'\"`]*)['\"`]", text):
        for found in graphql_metafields(m[1]):
            facts.append(("template.metafield", m.start(), m.end(), found | {"dynamic": False, "transport": "graphql"}))
    return facts


#: Field names whose selection does not change the owner of a metafield.
TRANSPARENT = {"edges", "node", "nodes"}


def _owner(name: str) -> str:
    return dict(GRAPHQL_OWNERS).get(re.sub("[^a-z]", "", name.lower()), "")


def graphql_metafields(query: str) -> list[dict]:
    """Metafields that a query reads, with the owner of the selection around them, empty where a field has none; fragments are followed once."""
    token = re.compile(r"\.\.\.|[A-Za-z_]\w*|\"(?:[^\"\\]|\\.)*\"|[{}():,!$@\[\]=]|\d+|\S")
    words = token.findall(re.sub(r"#[^\n]*", "", query))
    fragments: dict[str, tuple[str, int]] = {}
    for i, w in enumerate(words[:-3]):
        if w == "fragment" and words[i + 2] == "on":
            fragments[words[i + 1]] = (words[i + 3], words.index("{", i))
    found: list[dict] = []

    def arguments(i: int) -> tuple[dict, int]:
        out, depth, j = {}, 0, i
        while j < len(words):
            depth += (words[j] == "(") - (words[j] == ")")
            if depth == 1 and j + 2 < len(words) and words[j + 1] == ":" and words[j + 2].startswith('"'):
                out[words[j]] = words[j + 2][1:-1]
            j += 1
            if depth == 0:
                break
        return out, j

    def selection(i: int, owner: str, seen: frozenset) -> int:
        """Reads the selection that begins with the brace at i; returns where it ends."""
        i += 1
        while i < len(words) and words[i] != "}":
            if words[i] == "...":
                if i + 2 < len(words) and words[i + 1] == "on":
                    i = selection(words.index("{", i), _owner(words[i + 2]), seen)
                else:
                    name = words[i + 1] if i + 1 < len(words) else ""
                    if name in fragments and name not in seen:
                        selection(fragments[name][1], _owner(fragments[name][0]), seen | {name})
                    i += 2
                continue
            field, i = words[i], i + 1
            if i + 1 < len(words) and words[i] == ":":
                field, i = words[i + 1], i + 2  # an alias
            given: dict = {}
            if i < len(words) and words[i] == "(":
                given, i = arguments(i)
            if field == "metafield" and "namespace" in given and "key" in given:
                found.append({"owner": owner, "namespace": given["namespace"], "key": given["key"]})
            if i < len(words) and words[i] == "{":
                i = selection(i, _owner(field) or (owner if field in TRANSPARENT else ""), seen)
        return i + 1

    i = 0
    while i < len(words):
        if words[i] == "fragment":
            i = _closing(words, words.index("{", i)) if "{" in words[i:] else len(words)
        elif words[i] == "{":
            i = selection(i, "", frozenset())
        else:
            i += 1
    return found


def _closing(words: list[str], i: int) -> int:
    depth = 0
    for j in range(i, len(words)):
        depth += (words[j] == "{") - (words[j] == "}")
        if depth == 0:
            return j + 1
    return len(words)


def locale_keys(value: dict, prefix: str = "") -> list[str]:
    """Dotted paths of all leaves; a list or null is a leaf, an empty object has none."""
    out = []
    for k, v in value.items():
        out += locale_keys(v, f"{prefix}{k}.") if isinstance(v, dict) else [prefix + k]
    return out


def json_facts(path: str, source: str) -> list[Fact]:
    try:
        value = json.loads(source)
    except ValueError as e:
        return [("issue", 0, len(source), {"code": "JSON_PARSE_ERROR", "message": str(e)})]
    facts: list[Fact] = []
    if path.startswith("locales/") and isinstance(value, dict):
        facts += [("declaration.locale", 0, 0, {"name": k}) for k in locale_keys(value)]
    if re.match(r"(?:templates|sections)/", path) and isinstance(value, dict) and isinstance(value.get("sections"), dict):
        for instance, section in value["sections"].items():
            if isinstance(section, dict):
                name = section.get("type") if isinstance(section.get("type"), str) else None
                facts.append(("template.reference", 0, 0, {"kind": "section", "name": name, "site": instance}))
    for i, m in enumerate(re.finditer(r"\b([a-z_]+)\.metafields\.([\w-]+)\.([\w-]+)", source)):
        facts.append(("template.metafield", m.start(), m.end(), {"owner": m[1], "namespace": m[2], "key": m[3], "dynamic": False, "ordinal": i}))
    return facts


def schema_of(body: str) -> tuple[list[dict], list[dict]]:
    """Settings and blocks; both empty without a list of settings."""
    try:
        value = json.loads(body)
    except ValueError:
        return [], []
    if not isinstance(value, dict) or not isinstance(value.get("settings"), list):
        return [], []
    settings = [s for s in value["settings"] if isinstance(s, dict) and isinstance(s.get("id"), str) and isinstance(s.get("type"), str)]
    blocks = [b for b in value.get("blocks", []) if isinstance(b, dict) and isinstance(b.get("type"), str)] if isinstance(value.get("blocks", []), list) else []
    return settings, blocks


def file_facts(path: str, source: str) -> list[Fact]:
    """Exactly one frontend by suffix; anything else is opaque."""
    if path.endswith(".liquid"):
        facts = template_facts(source) + markup_facts(source)
        for kind, start, _, data in list(facts):
            if kind == "template.schema":
                settings, blocks = schema_of(data["body"])
                facts += [("schema.setting", start, start, {"id": s["id"], "type": s["type"]}) for s in settings]
                facts += [("schema.block", start, start, {"type": b["type"]}) for b in blocks]
                facts += [] if settings or blocks or _is_json(data["body"]) else [("issue", start, start, {"code": "SCHEMA_JSON", "message": "schema is not JSON"})]
        return facts
    if path.endswith(".json"):
        return json_facts(path, source)
    if path.endswith(".css"):
        return style_facts(source)
    if re.search(r"\.(?:m?js|ts)$", path):
        return script_facts(source)
    return []


def _is_json(body: str) -> bool:
    try:
        json.loads(body)
    except ValueError:
        return False
    return True
