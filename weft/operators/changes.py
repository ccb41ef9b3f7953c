"""Change logs and snapshots: folding, differences, moves, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: State of a key so far, next change, state after it. A state of none means that the key cancels out;
#: what is not listed takes the next change as it is.
TRANSITIONS = (("added", "removed", "none"), ("added", "changed", "added"), ("removed", "added", "changed"))


def fold_step(state: Column, change: Column) -> Column:
    out = change
    for have, then, after in TRANSITIONS:
        out = F.when((state == have) & (change == then), after).otherwise(out)
    return out


def expand_moves(changes: DataFrame, key: str, kind: str, source: str, seq: str) -> DataFrame:
    """(key, kind, seq): a move from a to b is a removal of a and an addition of b, at the same place in the log."""
    plain = changes.where(F.col(kind) != "moved").select(key, kind, seq)
    gone = changes.where(F.col(kind) == "moved").select(F.col(source).alias(key), F.lit("removed").alias(kind), seq)
    new = changes.where(F.col(kind) == "moved").select(key, F.lit("added").alias(kind), seq)
    return plain.unionByName(gone).unionByName(new)


def coalesce_changes(changes: DataFrame, key: list[str], kind: str, order: list[str]) -> DataFrame:
    """(key, kind): the one change of each key that its log amounts to, in order; keys that cancel out are absent.

    Runs of the same outcome need no memory of the whole log, but the fold needs the order: a key's changes are gathered
    as (order, kind) pairs only.
    """
    log = F.array_sort(F.collect_list(F.struct(*order, F.col(kind).alias("_kind"))))
    folded = changes.groupBy(*key).agg(log.alias("_log"))
    state = F.aggregate("_log", F.lit("none"), lambda a, x: fold_step(a, x["_kind"]))
    return folded.select(*key, state.alias(kind)).where(F.col(kind) != "none")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change, from_key): added, removed, changed and moved rows between two snapshots.

    A move is a removed and an added key of one content, where the content occurs once among the removed and once among
    the added. content: a fingerprint.
    """
    a = old.select(F.col(key).alias("_ok"), F.col(content).alias("_oc"))
    b = new.select(F.col(key).alias("_nk"), F.col(content).alias("_nc"))
    both = a.join(b, F.col("_ok") == F.col("_nk"), "full_outer")
    changed = both.where("_ok is not null and _nk is not null and _oc <> _nc").select(F.col("_nk").alias(key), F.lit("changed").alias("change"), F.lit(None).cast(old.schema[key].dataType).alias("from_key"))
    removed, added = both.where("_nk is null").select("_ok", "_oc"), both.where("_ok is null").select("_nk", "_nc")
    lone_r = removed.groupBy("_oc").agg(F.count(F.lit(1)).alias("n"), F.min("_ok").alias("_from")).where("n = 1")
    lone_a = added.groupBy("_nc").agg(F.count(F.lit(1)).alias("n"), F.min("_nk").alias("_to")).where("n = 1")
    moved = lone_r.join(lone_a, F.col("_oc") == F.col("_nc")).select("_from", "_to")
    gone = removed.join(moved, F.col("_ok") == F.col("_from"), "left_anti").select(F.col("_ok").alias(key), F.lit("removed").alias("change"), F.lit(None).cast(old.schema[key].dataType).alias("from_key"))
    fresh = added.join(moved, F.col("_nk") == F.col("_to"), "left_anti").select(F.col("_nk").alias(key), F.lit("added").alias("change"), F.lit(None).cast(old.schema[key].dataType).alias("from_key"))
    return changed.unionByName(gone).unionByName(fresh).unionByName(moved.select(F.col("_to").alias(key), F.lit("moved").alias("change"), F.col("_from").alias("from_key")))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: a maximum, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_b"))
    return best.select(*key, *[F.col(f"_b.{c}").alias(c) for c in [*order, *rest]])
