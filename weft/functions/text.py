"""Scalar text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), r"[-\s]+", "_"))


def humanize(name: Column) -> Column:
    words = F.replace(snake_case(name), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1_000_000))


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-|-$", "")


def story_id(component: Column, story: Column) -> Column:
    return F.concat(slug(component), F.lit("--"), slug(story))


def escape_html(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def unquote(value: Column) -> Column:
    return F.when(value.rlike("(?s)^(?:'.*'|\".*\")$") & (F.length(value) >= 2), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def decode_escapes(value: Column) -> Column:
    return F.regexp_replace(value, r"\\(.)", "$1")


def contains_template(value: Column) -> Column:
    return value.contains("{{") | value.contains("{%") | value.contains("{#")


def static_class_names(value: Column) -> Column:
    """Class tokens that no template expression touches."""
    marked = F.regexp_replace(F.regexp_replace(value, r"(?s)\{\{.*?\}\}", "\u0000"), r"(?s)\{%.*?%\}", "\u0000")
    return F.filter(F.split(marked, r"\s+"), lambda t: (t != "") & ~t.contains("\u0000"))


def dataset_attribute(key: Column) -> Column:
    return F.concat(F.lit("data-"), F.lower(F.regexp_replace(key, "([A-Z])", "-$1")))


def blank_outside(value: Column) -> Column:
    """Blanks of equal length; line ends stay."""
    return F.regexp_replace(value, r"[^\n\r]", " ")


def scoped_class(component: Column, name: Column, binding: Column | None = None) -> Column:
    parts = [F.lit("nz-"), component, F.lit("__")]
    return F.concat(*parts, *([binding, F.lit("__")] if binding is not None else []), name)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over the parts, each preceded by its length, so that no two lists of parts collide."""
    return F.sha2(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def line_column(text: Column, offset: Column) -> tuple[Column, Column]:
    """1-based line and column of a 0-based offset."""
    head = F.substring(text, F.lit(1), offset)
    last = F.length(F.element_at(F.split(head, "\n"), -1))
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1), last + 1


def money(cents: Column, currency: str | None = None) -> Column:
    text = F.concat(F.lit("$"), F.format_string("%.2f", cents / 100))
    return text if currency is None else F.concat(text, F.lit(f" {currency}"))


def utf16_length(text: Column) -> Column:
    """UTF-16 code units: code points beyond the basic plane count twice."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def offset_of(text: Column, line: Column, column: Column) -> Column:
    """0-based offset of a 1-based line and column; null beyond the last line, and the line's end beyond its columns."""
    lines = F.split(text, "\n")
    before = F.aggregate(F.slice(lines, F.lit(1), line - 1), F.lit(0), lambda a, x: a + F.length(x) + 1)
    return F.when((line >= 1) & (line <= F.size(lines)), before + F.least(column - 1, F.length(F.get(lines, line - 1))))


def edited(text: Column, start: Column, end: Column, new: Column) -> Column:
    """The text with its characters from ``start`` to before ``end`` (from 0) replaced by ``new``."""
    return F.concat(F.substring(text, F.lit(1), start), new, F.substring(text, end + 1, F.length(text)))


def moved_range(start: Column, end: Column, edit_start: Column, edit_end: Column, added: Column) -> tuple[Column, Column]:
    """Where a range lies after an edit that put ``added`` characters in place of edit_start to edit_end.

    A range before the edit stays, one after it moves along, one that meets it grows to cover what was put in.
    """
    by = added - (edit_end - edit_start)
    first = F.when(end <= edit_start, start).when(start >= edit_end, start + by).otherwise(F.least(start, edit_start))
    last = F.when(end <= edit_start, end).when(start >= edit_end, end + by).otherwise(F.greatest(edit_start + added, end + by))
    return first, last


def string_literal(value: Column) -> Column:
    """A template expression for any string: the language has no escape, so double quotes are appended one by one."""
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    parts, mark = F.split(value, '"'), F.lit("append: '\"'")
    more = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.when(p == "", F.array(mark)).otherwise(F.array(mark, F.concat(F.lit("append: "), quoted(p)))))
    return F.array_join(F.concat(F.array(quoted(parts[0])), F.flatten(more)), " | ")


def call_argument(name: Column, value: Column, kind: Column) -> Column:
    """``name: value`` of a render call: numbers and booleans as they are, strings quoted, data by its name; null if unset."""
    printed = F.when(kind.isin("number", "boolean"), value).when(kind == "string", F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("\\'")), F.lit("'"))).otherwise(name)
    return F.when(value.isNotNull(), F.concat(name, F.lit(": "), printed))


def render_call(name: Column, arguments: Column, line: int = 72) -> Column:
    """The tag that renders a snippet; ``arguments`` (array) stand on one line if it is no longer than ``line``, else on one each."""
    call = F.concat(F.lit("{% render '"), name, F.lit("'"))
    given = F.filter(arguments, lambda a: a.isNotNull())
    short = F.concat(call, F.lit(", "), F.array_join(given, ", "), F.lit(" %}"))
    long = F.concat(call, F.lit(",\n  "), F.array_join(given, ",\n  "), F.lit("\n%}"))
    return F.when(F.size(given) == 0, F.concat(call, F.lit(" %}"))).when(utf16_length(short) <= line, short).otherwise(long)
