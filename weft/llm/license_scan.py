"""Licence statements by ordered signature rules, in DataFrame operations only.

A text is reduced to its words, one space between them. A keyword prefilter decides whether any rule can apply at all. Rules
are grouped by their first keyword; a group is looked at where its keyword is among the text's words and its regexes, as one
literal pattern that is compiled once, match somewhere; then each of its rules runs whose keywords are all there. Rules have a priority; a detection is suppressed
where one of the same or a higher priority that comes earlier in order of (start, longest first, priority) contains its
interval. What is left gives the labels.

Defined results: a null text counts as empty; a text without words has n_words 0, no labels and score 0; identifiers may
repeat or be null, every input row gives one row; other columns are ignored. The rule set is a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.license_rules import signatures
from weft.llm.text import LOWER, UPPER, text_or_empty

#: Fixed by the contract: phrase and label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Rule:
    label: str
    regex: str  # over lower-case words with one space between them
    keywords: tuple[str, ...]
    priority: int  # 0 to 3
    weight: float


#: label, keyword, regex of the name. Versions are two words: 2.0 is "2 0".
FAMILIES = (
    ("apache-2.0", "apache", r"apache(?: software)? licen[sc]e(?: v?e?r?s?i?o?n?)? v?2(?: 0)?|apache v?2 0"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[sc]e(?: version)? 1 1"),
    ("apache", "apache", r"apache(?: software)? licen[sc]e"),
    ("mit", "mit", r"mit(?: x11)? licen[sc]e|mit licensed"),
    ("bsd-2-clause", "bsd", r"(?:simplified|2 clause|two clause) bsd|bsd (?:2|two) clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd|bsd (?:3|three) clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd|bsd (?:4|four) clause"),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e"),
    ("gpl-1", "gpl", r"gpl(?: version)? v?1(?: 0)?"),
    ("gpl-2", "gpl", r"gpl(?: version)? v?2(?: 0)?"),
    ("gpl-3", "gpl", r"gpl(?: version)? v?3(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"lgpl(?: version)? v?2(?: 1)?"),
    ("lgpl-3", "lgpl", r"lgpl(?: version)? v?3(?: 0)?"),
    ("agpl-3", "agpl", r"agpl(?: version)? v?3(?: 0)?"),
    ("gpl-2", "general", r"general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version)? v?2(?: 0)?"),
    ("gpl-3", "general", r"general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version)? v?3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e(?: version)?(?: [23](?: [01])?)?"),
    ("lgpl", "library", r"(?:gnu )?library general public licen[sc]e(?: version)?(?: 2(?: 0)?)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e(?: version)?(?: 3(?: 0)?)?"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e(?: version)?(?: 1 [123])?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e(?: version)? 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e(?: version)? v?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e(?: version)? v?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e(?: version)? v?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[sc]e"),
    ("eupl", "european", r"european union public licen[sc]e(?: version)?(?: v?1 [012])?"),
    ("cddl", "cddl", r"cddl(?: version)?(?: 1 [01])?"),
    ("cddl", "distribution", r"common development and distribution licen[sc]e"),
    ("cpl", "common", r"common public licen[sc]e(?: version)?(?: 1 0)?"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("boost", "boost", r"boost software licen[sc]e(?: version)?(?: 1 0)?"),
    ("artistic", "artistic", r"artistic licen[sc]e(?: version)?(?: [12] 0)?"),
    ("unlicense", "unlicense", r"the unlicense|unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("psf", "python", r"python(?: software foundation)? licen[sc]e(?: version)?(?: 2)?"),
    ("php", "php", r"php licen[sc]e(?: version)?(?: 3 01?)?"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("ofl", "sil", r"sil open font licen[sc]e(?: version)?(?: 1 [01])?"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("odbl", "database", r"open (?:data commons open )?database licen[sc]e"),
    ("odc-by", "commons", r"open data commons attribution licen[sc]e"),
    ("pddl", "domain", r"public domain dedication and licen[sc]e"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[sc]e)?"),
    ("sspl", "server", r"server side public licen[sc]e(?: version)?(?: 1)?"),
    ("elastic", "elastic", r"elastic licen[sc]e(?: version)?(?: 2(?: 0)?)?"),
    ("busl", "business", r"business source licen[sc]e(?: version)?(?: 1 1)?"),
    ("community", "agreement", r"community licen[sc]e agreement"),
    ("eula", "agreement", r"end user licen[sc]e agreement"),
)

#: How a licence is stated: regex around the name {n}, priority, weight.
STATEMENTS = (
    (r"spdx licen[sc]e identifier (?:{n})", 3, 1.0),
    (r"(?:licen[sc]ed|released|distributed|available|published|provided|redistributed) (?:only )?(?:under|with|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:gnu )?(?:{n})", 3, 0.95),
    (r"(?:subject to|governed by|covered by|pursuant to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:gnu )?(?:{n})", 2, 0.9),
    (r"(?:{n})", 1, 0.7),
)

#: label, words that must occur, regex, priority, weight. Texts and notices that name no licence.
NOTICES = (
    ("mit", ("hereby", "charge"), r"permission is hereby granted free of charge to any person obtaining a copy", 3, 1.0),
    ("bsd", ("redistribution", "binary"), r"redistribution and use in source and binary forms with or without modification", 3, 1.0),
    ("isc", ("permission", "fee"), r"permission to use copy modify and or distribute this software for any purpose with or without fee", 3, 1.0),
    ("zlib", ("software", "warranty"), r"this software is provided as is without any express or implied warranty", 2, 0.8),
    ("warranty-disclaimer", ("warranty",), r"without warranty of any kind(?: express or implied)?", 0, 0.3),
    ("public-domain", ("domain",), r"(?:in|into|to) the public domain|public domain work|public domain mark", 2, 0.9),
    ("reserved", ("rights",), r"(?:all|some|no) rights reserved", 1, 0.8),
    ("proprietary", ("proprietary",), r"proprietary(?: and confidential)?(?: information| software| licen[sc]e)", 2, 0.8),
    ("confidential", ("confidential",), r"strictly confidential|confidential information", 1, 0.5),
    ("no-redistribution", ("redistribute",), r"(?:do not|may not|must not) (?:copy (?:or )?)?redistribute", 2, 0.8),
    ("no-reproduction", ("reproduced",), r"(?:may not|must not|no part of this \w+ may) be (?:copied (?:or )?)?reproduced", 2, 0.8),
    ("permission-required", ("permission",), r"(?:used|reproduced|reprinted) (?:here )?(?:by|with) (?:the )?(?:kind )?(?:written )?permission(?: of)?", 1, 0.6),
    ("copyright", ("copyright",), r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", 0, 0.4),
    ("copyright", ("copyright",), r"copyright (?:notice|holders?|owners?)", 0, 0.4),
    ("terms-of-use", ("terms",), r"terms (?:of (?:use|service)|and conditions of use)", 0, 0.3),
    ("attribution", ("attribution",), r"with (?:proper |appropriate )?attribution", 0, 0.3),
    ("non-commercial", ("commercial", "non"), r"(?:for )?non commercial (?:use|purposes) only", 1, 0.6),
    ("non-commercial", ("noncommercial",), r"(?:for )?noncommercial (?:use|purposes) only", 1, 0.6),
    ("open-access", ("access",), r"open access article (?:distributed|published) under", 1, 0.6),
)


def signature_rules() -> list[Rule]:
    """The default rules, in order: base phrases, Creative Commons codes, families by statement, GPL forms, notices, signatures of texts."""
    rules = [Rule(label, phrase, tuple(sorted(phrase.split(), key=len, reverse=True)), 1, 0.9) for phrase, label in BASE]
    for code in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"):  # every code with every version, and without
        names = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s(?: works)?", "nc": "non ?commercial"}
        long_name = " ".join(names[x] for x in code.split())
        label = "cc-" + code.replace(" ", "-")
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0", ""):
            tail = f"(?: version)? {version}(?: international| unported| generic)?" if version else ""
            own = label + ("-" + version.replace(" ", ".") if version else "")
            rules.append(Rule(own, rf"(?:creative commons )?cc {code}{tail}", ("cc",), 3 if version else 2, 0.95))
            rules.append(Rule(own, rf"creative commons {long_name}(?: licen[sc]e)?{tail}", ("creative", "commons"), 3 if version else 2, 0.95))
    for label, keyword, name in FAMILIES:
        for around, priority, weight in STATEMENTS:
            rules.append(Rule(label, around.replace("{n}", name), (keyword,) + (("spdx",) if "spdx" in around else ()), priority, weight))
    for label, keyword in (("gpl", "general"), ("lgpl", "lesser"), ("agpl", "affero")):
        name = {"general": "", "lesser": "lesser ", "affero": "affero "}[keyword] + "general public licen[sc]e"
        rules.append(Rule(label, rf"(?:gnu )?{name}", (keyword, "public"), 1, 0.9))
        for n in ("1", "2", "3"):
            for form, tail in (("only", " only"), ("or-later", r"(?: of the licen[sc]e)? or (?:at your option )?any later version"), ("or-later", " or later")):
                rules.append(Rule(f"{label}-{n}-{form}", rf"(?:gnu )?{name}(?: version)? v?{n}(?: [01])?{tail}", (keyword, "public"), 3, 1.0))
    rules += [Rule(label, regex, words, priority, weight) for label, words, regex, priority, weight in NOTICES]
    return rules + [Rule(label, regex, words, priority, weight) for label, words, regex, priority, weight in signatures()]


def _spaces(s: Column) -> Column:
    return F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))


def word_string(text: Column) -> Column:
    """The words of a text, lower-cased, with one space before, between and after them."""
    others = "".join(chr(i) for i in range(128) if not chr(i).isalnum() and chr(i) != " ")
    plain = F.translate(text, UPPER + others, LOWER + " " * len(others))
    return F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), " {2,}", " ")


def _trie(words: list[str]) -> str:
    """An alternation that branches once a letter instead of once a word."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [h + (_trie(rest) if rest != [""] else "") for h, rest in heads.items()]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(sorted(parts, reverse=True)) + ")"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rules_array(rules: list[Rule]) -> str:
    """A constant array: one entry a rule."""
    return "array(" + ", ".join(
        f"named_struct('label', {_quoted(r.label)}, 're', {_quoted(f'(?<= )(?:{r.regex})(?= )')}, 'kw', array({', '.join(map(_quoted, r.keywords))}), 'pri', {r.priority}, 'w', {r.weight}D)"
        for r in rules
    ) + ")"


HIT = "struct<s: bigint, neg: bigint, pri: int, label: string, w: double>"
#: Detections are gathered in blocks of so many: appending to one long array would copy it for every detection.
BLOCK = 512
#: All detections of one rule: start and last word, from the pieces between its matches (the last piece has no match).
_PLACES = f"""
aggregate(zip_with(split(_w, r.re, -1), regexp_extract_all(_w, r.re, 0), (p, m) -> struct(p, m)),
  struct(-1L as at, cast(array() as array<{HIT}>) as hits, cast(array() as array<array<{HIT}>>) as full),
  (a, x) -> if(x.m is null, a, struct(
    a.at + octet_length(x.p) - octet_length(replace(x.p, ' ', '')) + octet_length(x.m) - octet_length(replace(x.m, ' ', '')) as at,
    concat(if(size(a.hits) = {BLOCK}, cast(array() as array<{HIT}>), a.hits), array(struct(
      a.at + octet_length(x.p) - octet_length(replace(x.p, ' ', '')) as s,
      -(a.at + octet_length(x.p) - octet_length(replace(x.p, ' ', '')) + octet_length(x.m) - octet_length(replace(x.m, ' ', ''))) as neg,
      -r.pri as pri, r.label as label, r.w as w))) as hits,
    if(size(a.hits) = {BLOCK}, concat(a.full, array(a.hits)), a.full) as full)),
  a -> concat(flatten(a.full), a.hits))
"""
#: Sweep in order of start, longest first, highest priority first; e0 to e3: the furthest end so far by priority or above.
_SWEEP = """
aggregate({hits},
  struct(-1L as e0, -1L as e1, -1L as e2, -1L as e3, cast(array() as array<string>) as labels, 0.0D as score),
  (a, h) -> if(-h.neg <= case -h.pri when 3 then a.e3 when 2 then a.e2 when 1 then a.e1 else a.e0 end, a, struct(
    greatest(a.e0, -h.neg) as e0,
    if(-h.pri >= 1, greatest(a.e1, -h.neg), a.e1) as e1,
    if(-h.pri >= 2, greatest(a.e2, -h.neg), a.e2) as e2,
    if(-h.pri >= 3, greatest(a.e3, -h.neg), a.e3) as e3,
    array_union(a.labels, array(h.label)) as labels,
    greatest(a.score, h.w) as score)),
  a -> struct(a.labels as labels, a.score as score))
"""


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rules = signature_rules() if rules is None else rules
    # a rule's first keyword is enough for the prefilter: without it the rule cannot apply
    keywords = sorted({k for r in rules for k in r.keywords})
    gate = " (?:" + _trie(sorted({r.keywords[0] for r in rules})) + ") "
    w = docs.select(F.col(id_col), word_string(text_or_empty(text_col)).alias("_w"))
    w = w.withColumn("_n", _spaces(F.col("_w")).cast("long") - 1)
    base = []
    for phrase, label in BASE:
        pieces = F.split("_w", f"(?<= ){phrase}(?= )", -1)
        found = F.struct(
            (F.size(pieces) - 1).cast("long").alias("n"),
            (_spaces(pieces[0]) - 1).cast("long").alias("first"),
            (F.col("_n") - (_spaces(F.element_at(pieces, -1)) - 1) - len(phrase.split())).cast("long").alias("last"),
            F.lit(label).alias("label"),
        )
        base.append(F.when(F.contains("_w", F.lit(f" {phrase} ")), found))
    groups: dict[str, list[Rule]] = {}
    for r in rules:
        groups.setdefault(r.keywords[0], []).append(r)
    # one literal pattern a group; the rules of a group that matches nowhere are never compiled
    chosen = ", ".join(
        f"if(array_contains(k, {_quoted(word)}) and rlike(_w, {_quoted(' (?:' + '|'.join(r.regex for r in own) + ') ')}), {_rules_array(own)}, null)" for word, own in groups.items()
    )
    candidates = f"flatten(filter(array({chosen}), g -> g is not null))"
    hits = f"""array_sort(flatten(transform(
        filter({candidates}, r -> size(array_except(r.kw, k)) = 0 and rlike(_w, r.re)), r -> {_PLACES})))"""
    # k is bound once a row: a column would be evaluated anew for every rule
    known = f"array_intersect(array({', '.join(map(_quoted, keywords))}), split(_w, ' '))"
    found = f"transform(array({known}), k -> {_SWEEP.format(hits=hits)})[0]"
    w = w.withColumn("_some", F.col("_w").rlike(gate))
    some = F.col("_some")
    w = w.withColumn("_base", F.when(some, F.filter(F.array(*base), lambda x: x.isNotNull())))
    w = w.withColumn("_found", F.when(some, F.expr(found)))
    base_labels = F.coalesce(F.transform("_base", lambda x: x["label"]), F.array().cast("array<string>"))
    more = F.coalesce(F.col("_found.labels"), F.array().cast("array<string>"))
    return w.select(
        id_col,
        F.col("_n").alias("n_words"),
        F.coalesce(F.aggregate("_base", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0).cast("long")).alias("n_base"),
        F.array_min(F.transform("_base", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda x: x["last"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, more)), ",").alias("labels"),
        F.greatest(F.coalesce(F.col("_found.score"), F.lit(0.0)), F.when(F.size(base_labels) > 0, F.lit(0.9)).otherwise(0.0)).alias("score"),
    )
