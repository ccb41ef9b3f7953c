"""Path expressions: classification, names, normalisation, globs, imports."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The suffix of component sources, and (role, pattern) in order of precedence; the first that fits wins.
COMPONENT_SUFFIX = ".nz.liquid"
ROLES = (
    ("component", r"\.nz\.liquid$"),
    ("section", r"^sections/[^/]+\.liquid$"),
    ("sectionGroup", r"^sections/[^/]+\.json$"),
    ("snippet", r"^snippets/[^/]+\.liquid$"),
    ("themeBlock", r"^blocks/[^/]+\.liquid$"),
    ("templateJson", r"^templates/.+\.json$"),
    ("templateLiquid", r"^templates/.+\.liquid$"),
    ("layout", r"^layout/[^/]+\.liquid$"),
    ("locale", r"^locales/[^/]+\.json$"),
    ("asset", r"^assets/"),
    ("settingsSchema", r"^config/settings_schema\.json$"),
    ("settingsData", r"^config/settings_data\.json$"),
)
PAGE_ROLES = ("templateJson", "templateLiquid")


def classify(path: Column, rules=ROLES, default: str = "other") -> Column:
    """The first (label, regex) of ``rules`` that the path matches."""
    out = F.lit(default)
    for label, pattern in reversed(rules):
        out = F.when(path.rlike(pattern), label).otherwise(out)
    return out


def file_kind(path: Column) -> Column:
    """The coarser kind: the component suffix is tested last, section groups and settings files are ``other``."""
    order = [r for r in ROLES if r[0] not in ("component", "sectionGroup", "settingsSchema", "settingsData")] + [ROLES[0]]
    return classify(path, order)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory_of(path: Column) -> Column:
    """Everything before the last slash; empty at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def resource_name(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?:\.nz\.liquid|\.liquid|\.json)$", "")


def template_route(path: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(path, "^templates/", ""), r"\.(?:json|liquid)$", "")
    return F.when(name == "index", "/").otherwise(F.concat(F.lit("/"), name))


def is_relative_specifier(specifier: Column) -> Column:
    return specifier.startswith("./") | specifier.startswith("../")


def _fold_segments(path: Column) -> Column:
    """Array of segments after ``.`` and ``..``; null when the path escapes its root."""
    start = F.array().cast("array<string>")

    def step(acc: Column, seg: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        return F.when(acc.isNull(), F.lit(None)).when(seg.isin("", "."), acc).when(seg == "..", up).otherwise(F.concat(acc, F.array(seg)))

    return F.aggregate(F.split(path, "/"), start, step)


def normalize_path(path: Column) -> Column:
    """A relative POSIX path without ``.``, ``..`` and repeated slashes; null if it is empty, absolute or escapes. A trailing slash stays."""
    portable = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = _fold_segments(portable)
    bad = (path == "") | path.contains("\x00") | portable.startswith("/") | portable.rlike("^[a-zA-Z]:/")
    tail = F.when(portable.endswith("/"), "/").otherwise("")
    return F.when(~bad & (F.size(parts) > 0), F.concat(F.array_join(parts, "/"), tail))


def resolve_import(from_file: Column, specifier: Column) -> Column:
    """The path that a relative specifier names, seen from a file; null if it escapes the root."""
    folder = directory_of(from_file)
    joined = F.when(folder == "", specifier).otherwise(F.concat(folder, F.lit("/"), specifier))
    parts = _fold_segments(joined)
    return F.when(F.size(parts) > 0, F.array_join(parts, "/"))


def glob_regex(pattern: str) -> str:
    """The anchored regex of a glob: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a segment."""
    tokens = re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern.replace("\\", "/"))
    meaning = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(meaning.get(t) or re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", t) for t in tokens) + "$"


def glob_match(path: Column, patterns: list[str]) -> Column:
    """Whether any of the globs matches the path."""
    portable = F.replace(path, F.lit("\\"), F.lit("/"))
    found = F.lit(False)
    for p in patterns:
        found = found | portable.rlike(glob_regex(p))
    return found


def is_safe_relative_path(path: Column) -> Column:
    """No empty, ``.`` or ``..`` segment, no backslash, no leading slash."""
    return (path != "") & ~path.contains("\\") & ~path.startswith("/") & F.forall(F.split(path, "/"), lambda s: ~s.isin("", ".", ".."))


def local_module_path(from_path: Column, name: Column) -> Column:
    """The asset that a module specifier names: without query and fragment, absolute ``/assets/`` or relative; null outside ``assets/``."""
    bare = F.regexp_replace(name, "[?#].*$", "")
    found = F.when(bare.startswith("/assets/"), F.substring(bare, 2, 1_000_000)).when(is_relative_specifier(bare), resolve_import(from_path, bare))
    return F.when(found.startswith("assets/"), found)


#: Why a dependency's name is refused, in the order of the tests.
NAME_REASONS = (
    "must be a non-empty trimmed name",
    "must not contain traversal or absolute paths",
    "must not contain path separators",
    "must omit theme file extensions",
)

#: Kind of dependency, folder and extension of its file.
DEPENDENCY_FILES = (("snippet", "snippets/", ".liquid"), ("section", "sections/", ".liquid"), ("section-group", "sections/", ".json"))


def dependency_name_problem(kind: Column, name: Column) -> Column:
    """Why ``name`` cannot name a dependency of ``kind``, null if it can. A layout may be ``none``."""
    untrimmed, outside, separator, extension = NAME_REASONS
    return (
        F.when((kind == "layout") & (name == "none"), F.lit(None).cast("string"))
        .when((name == "") | name.rlike(r"^\s|\s\z"), untrimmed)
        .when(name.startswith("/") | name.contains(".."), outside)
        .when(name.rlike(r"[\\/]"), separator)
        .when(name.rlike(r"(?i)\.(liquid|json)\z"), extension)
    )


def dependency_path(kind: Column, name: Column) -> Column:
    """The file that a dependency names, null for the layout ``none``."""
    file = F.when((kind == "layout") & (name == "none"), F.lit(None).cast("string"))
    for k, folder, extension in DEPENDENCY_FILES:
        file = file.when(kind == k, F.concat(F.lit(folder), name, F.lit(extension)))
    return file.otherwise(F.concat(F.lit("layout/"), name, F.lit(".liquid")))


def is_merchant_data(path: Column) -> Column:
    """Files that the merchant's editor writes: settings data, templates and section groups as JSON."""
    return (path == "config/settings_data.json") | path.rlike(r"^templates/.+\.json\z") | path.rlike(r"^sections/[^/]+\.json\z")


def is_storefront_locale(path: Column) -> Column:
    return path.rlike(r"^locales/[^/]+\.json\z") & ~path.endswith(".schema.json")


def is_merchant_owned(path: Column) -> Column:
    return is_merchant_data(path) | is_storefront_locale(path)
