"""Gates, first rows, contract targets, migration lists, snapshots that replace each other, cycles and invalidation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.values import version_key
from weft.operators import graph


def severity_gate(diagnostics: DataFrame, key: str, severity: str = "severity") -> DataFrame:
    """(key, errors, warnings, can_emit): one error is enough to stop the output of a key."""
    count = lambda s: F.count_if(F.col(severity) == s)
    return diagnostics.groupBy(key).agg(count("error").alias("errors"), count("warning").alias("warnings"), (count("error") == 0).alias("can_emit"))


def first_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, then by the other columns: a minimum that is combined before the shuffle."""
    rest = [c for c in rows.columns if c != key and c not in order]
    first = rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_f"))
    return first.select(key, *[F.col(f"_f.{c}").alias(c) for c in [*order, *rest]])


def contract_targets(sites: DataFrame, targets: DataFrame, contracts: DataFrame) -> DataFrame:
    """(site, target, code) of sites (site, target) whose target is no snippet, or is one without a contract.

    targets: (target, role); contracts: (target). A target that does not exist is a missing reference, not a finding here.
    """
    known = sites.select("site", "target").join(targets.select("target", "role"), "target")
    other = known.where("role <> 'snippet'").select("site", "target", F.lit("TARGET_NOT_SNIPPET").alias("code"))
    bare = known.where("role = 'snippet'").join(contracts.select("target").distinct(), "target", "left_anti")
    return other.unionByName(bare.select("site", "target", F.lit("CONTRACT_UNRESOLVED").alias("code")))


#: Migration and the fields that it needs.
MIGRATION_FIELDS = {"renameSection": ("from", "to"), "renameSetting": ("from", "to"), "removeSetting": ("setting",), "renameBlock": ("from", "to")}


def migration_problems(migrations: DataFrame) -> DataFrame:
    """(id, problem) of a list of migrations (id, op, from, to, setting): a list with any problem is not applied at all."""
    lacks = F.lit(False)
    for op, fields in MIGRATION_FIELDS.items():
        for f in fields:
            lacks = lacks | ((F.col("op") == op) & (F.coalesce(F.col(f), F.lit("")) == ""))
    unknown = F.coalesce(~F.col("op").isin(*MIGRATION_FIELDS), F.lit(True))
    problem = F.when(F.coalesce("id", F.lit("")) == "", "no-id").when(unknown, "unknown-op").when(lacks, "missing-field")
    own = migrations.select("id", problem.alias("problem")).where("problem is not null")
    twice = migrations.where("id is not null and id <> ''").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return own.unionByName(twice.select("id", F.lit("duplicate-id").alias("problem")))


def replace_snapshot(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, step, change): replacing all inputs is first the removal of what is gone, then an update of everything new."""
    gone = old.select(key).distinct().join(new.select(key), key, "left_anti")
    return gone.select(key, F.lit(0).alias("step"), F.lit("remove").alias("change")).unionByName(new.select(key).distinct().select(key, F.lit(1).alias("step"), F.lit("update").alias("change")))


def invalidated(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(node, depth) of computations that depend on changed ones, directly or not; the changed ones are not among them."""
    return graph.impact(edges, changed).where("depth > 0")


def cycle_members(edges: DataFrame) -> DataFrame:
    """(node, cycle) of nodes on a cycle of imports; cycle is its smallest member."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return graph.sccs(nodes, edges).where("cyclic").select("node", F.col("scc").alias("cycle"))


def versions_ascending(components: DataFrame, key: str, version: str) -> DataFrame:
    """(key, versions): all distinct versions of a component, by their numbers."""
    pairs = F.collect_set(F.struct(version_key(F.col(version)).alias("k"), F.col(version).alias("v")))
    return components.groupBy(key).agg(F.transform(F.array_sort(pairs), lambda p: p["v"]).alias("versions"))
