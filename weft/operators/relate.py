"""References, declarations, resolutions, dependency records and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_references(refs: DataFrame, decls: DataFrame, keys: list[str], ref_id: str, target: str, static: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(ref_id, carry, status, n_targets, targets): references matched to declarations by symbol.

    Dynamic references (``static`` false) are not looked up. Without a match a reference is missing, with several it is
    ambiguous and keeps them all. A reference whose key has a null is missing.
    """
    is_static = F.lit(True) if static is None else static
    left = refs.select(ref_id, *carry, *keys, F.coalesce(is_static, F.lit(False)).alias("_static"))
    # declarations of one symbol meet first: a reference row is never multiplied
    symbols = decls.groupBy(*keys).agg(F.array_sort(F.collect_set(target)).alias("targets"))
    found = left.join(symbols, keys, "left")
    targets = F.when(F.col("_static"), F.coalesce("targets", F.array().cast(symbols.schema["targets"].dataType))).otherwise(F.array().cast(symbols.schema["targets"].dataType))
    n = F.size(targets)
    status = F.when(~F.col("_static"), "dynamic").when(n == 0, "missing").when(n == 1, "resolved").otherwise("ambiguous")
    return found.select(ref_id, *carry, status.alias("status"), n.alias("n_targets"), targets.alias("targets"))


def dependency_records(resolutions: DataFrame, ref_id: str, src: str, kind: str) -> DataFrame:
    """(ref_id, src, dst, kind): one record per target of each resolved or ambiguous reference.

    src and kind are carried along with the references: identifiers of references may repeat, so nothing is joined on them.
    """
    return resolutions.select(ref_id, F.col(src).alias("src"), F.explode("targets").alias("dst"), F.col(kind).alias("kind"))


def filtered(df: DataFrame, **equals) -> DataFrame:
    """Rows equal to the given values; a value that is None or empty does not filter."""
    for column, value in equals.items():
        if value is not None and value != "":
            df = df.where(F.col(column) == F.lit(value))
    return df


def evidence_for_owners(evidence: DataFrame, records: DataFrame, owner: str, kind: str | None = None) -> DataFrame:
    """All evidence, of one kind if given, of the owners of the records: not only that of the records themselves."""
    return filtered(evidence, kind=kind).join(records.select(owner).distinct(), owner, "left_semi")


#: Evidence kind, capability, file class.
CAPABILITIES = (
    ("schema", "theme.schema", "configurable"),
    ("metafield-read", "theme.metafields", "data-driven"),
    ("behavior", "browser.behavior", "interactive"),
    ("render-reference", "theme.render", "composed"),
    ("dynamic-reference", "theme.dynamic-render", None),
)


def capability(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, value, _ in CAPABILITIES:
        out = F.when(kind == name, value).otherwise(out)
    return out


def file_classes(owners: DataFrame, evidence: DataFrame, owner: str, classes=None) -> DataFrame:
    """(owner, classes): sorted classes of each owner's evidence kinds; ``static`` without any."""
    table = classes or [(k, c) for k, _, c in CAPABILITIES if c]
    label = F.lit(None).cast("string")
    for kind, name in table:
        label = F.when(F.col("kind") == kind, name).otherwise(label)
    found = evidence.select(owner, label.alias("c")).where("c is not null").groupBy(owner).agg(F.array_sort(F.collect_set("c")).alias("classes"))
    return owners.select(owner).distinct().join(found, owner, "left").select(owner, F.coalesce("classes", F.array(F.lit("static"))).alias("classes"))


def connections(behaviors: DataFrame, key: list[str], owner: str, role: Column) -> DataFrame:
    """(key, producers, consumers): owners on either side of a shared subject, as sorted distinct arrays; subjects need both.

    role: ``producer`` or ``consumer``; the kind of hook does not matter.
    """
    marked = behaviors.select(*key, owner, role.alias("_role")).distinct()
    side = lambda name: F.array_sort(F.collect_set(F.when(F.col("_role") == name, F.col(owner))))
    both = marked.groupBy(*key).agg(side("producer").alias("producers"), side("consumer").alias("consumers"))
    return both.where((F.size("producers") > 0) & (F.size("consumers") > 0))


def flags_after_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``df`` with duplicate: whether an earlier row (by ``order``) has the same key.

    The first of a key comes from a minimum that is combined before the shuffle; no key's rows are gathered.
    """
    first = df.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    joined = df.alias("l").join(first.alias("r"), same)
    return joined.select("l.*", (F.struct(*[F.col(f"l.{o}") for o in order]) != F.col("r._first")).alias("duplicate"))


def unknown_reads(reads: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct reads without a declaration of the same key."""
    return reads.select(*keys).distinct().join(declared.select(*keys), keys, "left_anti")


def merge_records(parts: list[DataFrame], key: str, rank: str, payload: list[str], union: str) -> DataFrame:
    """One row per key: payload of the row with the highest rank (then least payload), and the union of an array column."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    best = F.min(F.struct((-F.col(rank)).alias("_r"), *payload)).alias("_b")
    return rows.groupBy(key).agg(best, F.array_sort(F.array_distinct(F.flatten(F.collect_set(union)))).alias(union)).select(key, *[F.col(f"_b.{p}").alias(p) for p in payload], union)
