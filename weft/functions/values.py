"""Versions, numeric constraints, literal validators and a flat type lattice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = r"^\d+\.\d+\.\d+$"
COMPONENT_ID = r"^@([a-z0-9][a-z0-9-]*)/([a-z0-9][a-z0-9-]*)$"


def version_key(version: Column, parts: int = 3) -> Column:
    """Integer array that orders versions; missing parts are 0."""
    numbers = F.transform(F.split(version, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.coalesce(F.get(numbers, i), F.lit(0)))


def is_valid_version(version: Column) -> Column:
    return version.rlike(VERSION)


def component_id(value: Column) -> tuple[Column, Column]:
    """Scope and name of ``@scope/name``; empty strings if it is not one."""
    return F.regexp_extract(value, COMPONENT_ID, 1), F.regexp_extract(value, COMPONENT_ID, 2)


def range_violation(value: Column, least: Column | None = None, most: Column | None = None, step: Column | None = None) -> Column:
    """``below``, ``above``, ``step`` or null. A step counts from the minimum, within 1e-9."""
    out = F.lit(None).cast("string")
    if step is not None:
        rest = (value - (F.coalesce(least, F.lit(0.0)) if least is not None else F.lit(0.0))) % step
        out = F.when((F.abs(rest) > 1e-9) & (F.abs(F.abs(rest) - F.abs(step)) > 1e-9), "step").otherwise(out)
    if most is not None:
        out = F.when(value > most, "above").otherwise(out)
    if least is not None:
        out = F.when(value < least, "below").otherwise(out)
    return out


def assignable(source: Column, target: Column) -> Column:
    """Whether a value of the source kind fits the target kind, for flat kinds: equal kinds, unknown on either side, a
    string literal to kinds that validate strings, a number literal to number. Nested types: ``type_expressions.fits``."""
    text = (source == "string-literal") & target.isin("string", "url", "color", "handle")
    return (source == target) | (source == "unknown") | (target == "unknown") | text | ((source == "number-literal") & (target == "number"))


def is_handle(value: Column) -> Column:
    return value.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$")


def is_hex_color(value: Column) -> Column:
    return value.rlike("^#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$")


def is_url(value: Column) -> Column:
    return value.rlike(r"^(?:https?://[^\s/]+\S*|/\S*|#\S*|mailto:\S+|tel:\S+)$")


#: Field or type name of an API in letters only, and the owner of its metafields.
GRAPHQL_OWNERS = (
    ("article", "article"), ("articles", "article"), ("blog", "blog"), ("blogs", "blog"), ("collection", "collection"), ("collections", "collection"),
    ("company", "company"), ("companies", "company"), ("companylocation", "company_location"), ("companylocations", "company_location"),
    ("customer", "customer"), ("customers", "customer"), ("location", "location"), ("locations", "location"), ("market", "market"), ("markets", "market"),
    ("order", "order"), ("orders", "order"), ("page", "page"), ("pages", "page"), ("product", "product"), ("products", "product"),
    ("productvariant", "variant"), ("productvariants", "variant"), ("shop", "shop"), ("variant", "variant"), ("variants", "variant"),
)


def graphql_owner(name: Column) -> Column:
    """Owner type of a field or type name, null if it owns no metafields."""
    letters = F.lower(F.regexp_replace(name, "[^A-Za-z]", ""))
    return F.create_map(*[F.lit(x) for pair in GRAPHQL_OWNERS for x in pair])[letters]


def metafield_identity(value: Column) -> Column:
    """Struct (owner, namespace, key) of ``owner.namespace.key``: exactly three parts, none blank; else null."""
    parts = F.transform(F.split(value, r"\."), lambda p: F.trim(p))
    sound = (F.size(parts) == 3) & F.forall(parts, lambda p: p != "")
    return F.when(sound, F.struct(parts[0].alias("owner"), parts[1].alias("namespace"), parts[2].alias("key")))
