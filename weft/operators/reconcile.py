"""Drift, migrations, three-way merge, output ownership and the component registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.values import version_key
from weft.operators.graph import closure


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(section, kind, id, drift) between two locks (section, kind in setting or block, id, type).

    Sections, settings and blocks that are gone and settings of another type are drift; additions are not. A section that
    is gone stands for all it held.
    """
    gone = old.select("section").distinct().join(new.select("section").distinct(), "section", "left_anti")
    sections = gone.select("section", F.lit("section").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit("SECTION_REMOVED").alias("drift"))
    kept = old.join(gone, "section", "left_anti").alias("o")
    both = kept.join(new.alias("n"), [F.col(f"o.{c}") == F.col(f"n.{c}") for c in ("section", "kind", "id")], "left")
    drift = (
        F.when(F.col("n.id").isNull() & (F.col("o.kind") == "setting"), "SETTING_REMOVED")
        .when(F.col("n.id").isNull(), "BLOCK_REMOVED")
        .when((F.col("o.kind") == "setting") & ~F.col("o.type").eqNullSafe(F.col("n.type")), "SETTING_RETYPED")
    )
    return both.select("o.section", "o.kind", "o.id", drift.alias("drift")).where("drift is not null").unionByName(sections)


def merge3(base: DataFrame, source: DataFrame, merchant: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, conflict): three-way merge of leaves; keys that both sides dropped or that were dropped unedited are absent."""
    b, s, m = (d.select(F.col(key).alias(f"_{n}k"), F.col(value).alias(f"_{n}")) for d, n in ((base, "b"), (source, "s"), (merchant, "m")))
    bs = b.join(s, F.col("_bk") == F.col("_sk"), "full_outer").withColumn("_k", F.coalesce("_bk", "_sk"))
    all3 = bs.join(m, F.col("_k") == F.col("_mk"), "full_outer").withColumn("_key", F.coalesce("_k", "_mk"))
    merged, conflict = merge3_value(F.col("_b"), F.col("_s"), F.col("_m"))
    return all3.select(F.col("_key").alias(key), merged.alias(value), conflict.alias("conflict")).where(F.col(value).isNotNull())


def merge3_value(b: Column, s: Column, m: Column) -> tuple[Column, Column]:
    """Result and conflict flag of one leaf: base, source, merchant; null is absent."""
    value = (
        F.when(b.isNull(), F.coalesce(m, s))
        .when(m.isNull(), s)
        .when(s.isNull() & (m == b), F.lit(None))
        .when(s.isNull(), m)
        .when(m == b, s)
        .otherwise(m)  # source unchanged, both alike, or a conflict that the merchant wins
    )
    conflict = F.coalesce(b.isNotNull() & m.isNotNull() & (m != b) & (s.isNull() | ((s != b) & (s != m))), F.lit(False))
    return value, conflict


def apply_migrations(lock: DataFrame, migrations: list[dict]) -> DataFrame:
    """A lock (section, kind, id, type) after renameSection, renameSetting, removeSetting and renameBlock, in order.

    migrations: a short authored list; each is one projection, so the whole is one pass over the lock.
    """
    for m in migrations:
        here = (F.col("section") == m["section"]) if "section" in m else F.lit(True)
        if m["op"] == "renameSection":
            lock = lock.withColumn("section", F.when(F.col("section") == m["from"], m["to"]).otherwise(F.col("section")))
        elif m["op"] in ("renameSetting", "renameBlock"):
            kind = "setting" if m["op"] == "renameSetting" else "block"
            lock = lock.withColumn("id", F.when(here & (F.col("kind") == kind) & (F.col("id") == m["from"]), m["to"]).otherwise(F.col("id")))
        elif m["op"] == "removeSetting":
            lock = lock.where(~(here & (F.col("kind") == "setting") & (F.col("id") == m["setting"])))
        else:
            raise ValueError(f"unknown migration {m['op']}")
    return lock


def pending(migrations: DataFrame, ledger: DataFrame, key: str = "id") -> DataFrame:
    """Migrations that the ledger does not have."""
    return migrations.join(ledger.select(key), key, "left_anti")


def collisions(writes: DataFrame, path: str, owner: str, content: str) -> DataFrame:
    """(path, owners, contents) of paths that several owners or contents claim."""
    counted = writes.groupBy(path).agg(F.count_distinct(owner).alias("owners"), F.count_distinct(content).alias("contents"))
    return counted.where("owners > 1 or contents > 1")


def output_plan(writes: DataFrame, owned: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, action) of a protected write: writes and owned and existing are (path, hash).

    A file that exists and is not owned is not touched, nor one whose content changed since it was written; what is owned
    and no longer written is deleted.
    """
    w, o, e = (d.select(F.col("path").alias(f"_{n}p"), F.col("hash").alias(f"_{n}h")) for d, n in ((writes, "w"), (owned, "o"), (existing, "e")))
    wo = w.join(o, F.col("_wp") == F.col("_op"), "full_outer").withColumn("_p", F.coalesce("_wp", "_op"))
    all3 = wo.join(e, F.col("_p") == F.col("_ep"), "left")
    wants, has, there = F.col("_wp").isNotNull(), F.col("_op").isNotNull(), F.col("_ep").isNotNull()
    action = (
        F.when(wants & there & ~has & (F.col("_eh") != F.col("_wh")), "conflict:NOT_OWNED")
        .when(wants & there & has & (F.col("_eh") != F.col("_oh")) & (F.col("_eh") != F.col("_wh")), "conflict:OWNED_MODIFIED")
        .when(~wants & there & (F.col("_eh") != F.col("_oh")), "conflict:STALE_MODIFIED")
        .when(~wants & there, "delete")
        .when(~wants, "forget")
        .when(there & (F.col("_eh") == F.col("_wh")), "keep")
        .otherwise("write")
    )
    return all3.select(F.col("_p").alias("path"), action.alias("action"))


def component_diff(previous: DataFrame, following: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, change, local) between two versions of a component and what is on disk; all are (path, hash)."""
    p, n, d = (x.select(F.col("path").alias(f"_{c}p"), F.col("hash").alias(f"_{c}h")) for x, c in ((previous, "p"), (following, "n"), (disk, "d")))
    pn = p.join(n, F.col("_pp") == F.col("_np"), "full_outer").withColumn("_path", F.coalesce("_pp", "_np"))
    rows = pn.join(d, F.col("_path") == F.col("_dp"), "left")
    change = F.when(F.col("_pp").isNull(), "added").when(F.col("_np").isNull(), "removed").when(F.col("_ph") == F.col("_nh"), "unchanged").otherwise("changed")
    local = F.when(F.col("_dp").isNull(), "missing").when(F.col("_dh").eqNullSafe(F.col("_ph")), "clean").when(F.col("_dh").eqNullSafe(F.col("_nh")), "current").otherwise("edited")
    return rows.select(F.col("_path").alias("path"), change.alias("change"), local.alias("local"))


def insert_if_absent(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All of existing, and the rows of new whose key it lacks; of new rows of one key, the least."""
    rest = [c for c in existing.columns if c not in key]
    fresh = new.select(*existing.columns).join(existing.select(*key), key, "left_anti")
    fresh = fresh.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_b")).select(*key, *[F.col(f"_b.{c}").alias(c) for c in rest]) if rest else fresh.distinct()
    return existing.unionByName(fresh.select(*existing.columns))


def latest_version(components: DataFrame, key: str, version: str) -> DataFrame:
    """(key, latest, versions): the highest version by its numbers, and how many there are."""
    best = F.max(F.struct(version_key(F.col(version)).alias("k"), F.col(version).alias("v")))
    return components.groupBy(key).agg(best.alias("_b"), F.count_distinct(version).alias("versions")).select(key, F.col("_b.v").alias("latest"), "versions")


def install_closure(wanted: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(node, depth) of everything that the wanted components need; one entry per component, at its least depth."""
    return closure(dependencies, wanted)
