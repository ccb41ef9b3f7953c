"""Operators on small tables with known answers, and streams against batches."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from weft import session
from weft.functions import paths as P
from weft.functions import values as V
from weft.operators import changes, components, graph, intervals, reconcile, relate
from weft.streaming import watch


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def test_paths(spark):
    cases = {"a/./b/../c": "a/c", "a//b": "a/b", "../a": None, "/a": None, "C:/a": None, "": None, ".": None, "a\\b": "a/b", "a/../..": None}
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    assert {r.p: r.q for r in df.select("p", P.normalize_path(F.col("p")).alias("q")).collect()} == cases
    globs = {"a/b/c.js": ("**/*.js", True), "c.js": ("**/*.js", True), "a/c.js": ("*.js", False), "a/bb": ("a/b?", True), "x.y": ("x?y", True), "xzy": ("x.y", False)}
    for path, (pattern, want) in globs.items():
        assert one(spark, p=path).select(P.glob_match(F.col("p"), [pattern])).first()[0] is want
    assert one(spark, f="sections/a.liquid", s="../x/./b.js").select(P.resolve_import(F.col("f"), F.col("s"))).first()[0] == "x/b.js"
    assert one(spark, f="assets/a.js", s="./b.js?v=1#x").select(P.local_module_path(F.col("f"), F.col("s"))).first()[0] == "assets/b.js"


def test_versions_and_ranges(spark):
    df = spark.createDataFrame([("1.9.0",), ("1.10.0",), ("1.2",)], "v string")
    assert [r.v for r in df.orderBy(V.version_key(F.col("v"))).collect()] == ["1.2", "1.9.0", "1.10.0"]
    x = spark.createDataFrame([(v,) for v in (0.0, 5.0, 7.0, 0.3, 200.0)], "v double")
    got = [r[0] for r in x.select(V.range_violation(F.col("v"), F.lit(0.0), F.lit(100.0), F.lit(0.1))).collect()]
    assert got == [None, None, None, None, "above"]


def test_change_folding(spark):
    table = {("added", "removed"): None, ("added", "added"): "added", ("added", "changed"): "added", ("removed", "added"): "changed", ("removed", "removed"): "removed",
             ("removed", "changed"): "changed", ("changed", "removed"): "removed", ("changed", "added"): "added", ("changed", "changed"): "changed"}
    log = [(f"{a}-{b}", k, i) for a, b in table for i, k in enumerate((a, b))]
    got = {r.key: r.kind for r in changes.coalesce_changes(spark.createDataFrame(log, "key string, kind string, seq long"), ["key"], "kind", ["seq"]).collect()}
    assert got == {f"{a}-{b}": v for (a, b), v in table.items() if v}


def test_merge_table(spark):
    cases = [(None, "s", None, "s", False), (None, None, "m", "m", False), (None, "s", "m", "m", False), ("b", "s", None, "s", False), ("b", None, "b", None, False), ("b", None, "m", "m", True),
             ("b", "s", "b", "s", False), ("b", "b", "m", "m", False), ("b", "x", "x", "x", False), ("b", "s", "m", "m", True)]
    df = spark.createDataFrame([c[:3] for c in cases], "b string, s string, m string")
    value, conflict = reconcile.merge3_value(F.col("b"), F.col("s"), F.col("m"))
    assert [(r[0], r[1]) for r in df.select(value, conflict).collect()] == [c[3:] for c in cases]


def test_components_and_sccs(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    arcs = [(rng.randint(0, 12), rng.randint(0, 12)) for _ in range(18)]
    nodes = spark.createDataFrame([(i,) for i in range(13)], "node long")
    reach = {(a, b) for a, b in arcs}
    for k, i, j in itertools.product(range(13), repeat=3):
        if (i, k) in reach and (k, j) in reach:
            reach.add((i, j))
    got = {r.node: (r.scc, r.cyclic) for r in graph.sccs(nodes, spark.createDataFrame(arcs, "src long, dst long")).collect()}
    assert got == {n: (min([n] + [m for m in range(13) if (n, m) in reach and (m, n) in reach]), (n, n) in reach) for n in range(13)}


def test_broken_endpoints_are_dealt_by_rows(spark, monkeypatch):
    """A task gets no more rows than stated, though Spark would make one partition of them; repeated nodes and null ends count as before."""
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    nodes = spark.range(800).select(F.concat(F.lit("n"), F.col("id") % 400).alias("node"))
    edges = spark.range(1200).select(F.concat(F.lit("n"), F.col("id") % 600).alias("src"), F.when(F.col("id") % 2 == 0, "hub").when(F.col("id") > 5, "n1").alias("dst"))
    got = graph.broken_endpoints(nodes, edges).withColumn("part", F.spark_partition_id()).collect()
    want = [(f"n{i % 600}", "hub" if i % 2 == 0 else "n1" if i > 5 else None, "src") for i in range(1200) if i % 600 >= 400]
    want += [(f"n{i % 600}", "hub" if i % 2 == 0 else None, "dst") for i in range(1200) if i % 2 == 0 or i <= 5]
    assert sorted((r.src, r.dst, r.missing) for r in got if r.dst) == sorted(x for x in want if x[1]) and sum(r.dst is None for r in got) == sum(x[1] is None for x in want)
    by_src = [r.part for r in got if r.missing == "src"]
    assert len(set(by_src)) >= 15 and max(map(by_src.count, set(by_src))) <= 100


def test_replay_needs_the_confirming_pass():
    args = (["a", "b"], [("a", "b"), ("b", "a")], {"b": {"settings.color"}})
    assert graph.replay_data_flow(*args, 8, 100)["converged"] and not graph.replay_data_flow(*args, 1, 100)["converged"]
    assert graph.replay_data_flow(*args, 8, 100)["reads"]["a"] == {"settings.color"}


def test_ranges(spark):
    rng = random.Random(2)
    ranges = [(rng.randint(0, 2), s, s + rng.randint(0, 5)) for s in (rng.randint(0, 60) for _ in range(30))]
    points = [(rng.randint(0, 3), rng.randint(0, 70)) for _ in range(80)]
    r, p = spark.createDataFrame(ranges, "k long, s long, e long"), spark.createDataFrame(points, "k long, at long")
    got = sorted((x.k, x.at, x.local) for x in intervals.in_any_range(p, r, ["k"], "at", "s", "e").collect())
    assert got == sorted((k, at, any(k == a and s <= at <= e for a, s, e in ranges)) for k, at in points)
    merged = intervals.merge_ranges(r, ["k"], "s", "e").collect()
    cover = lambda rows: {(k, x) for k, s, e in rows for x in range(s, e + 1)}
    assert cover(ranges) == cover(map(tuple, merged))


def test_plan_and_drift(spark):
    side = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    writes, owned, there = side([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")]), side([("b", "0"), ("c", "3"), ("e", "5"), ("f", "6")]), side([("a", "9"), ("b", "7"), ("c", "3"), ("e", "5"), ("f", "x")])
    got = {r.path: r.action for r in reconcile.output_plan(writes, owned, there).collect()}
    assert got == {"a": "conflict:NOT_OWNED", "b": "conflict:OWNED_MODIFIED", "c": "keep", "d": "write", "e": "delete", "f": "conflict:STALE_MODIFIED"}


def test_duplicate_flags_hold_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, n long")
    assert {(r.n, r.duplicate) for r in relate.flags_after_first(df, ["k"], ["n"]).collect()} == {(1, False), (2, True), (3, False), (4, True)}


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_equals_batch(spark, tmp_path, batches):
    log = [("a", "added", None, "1"), ("b", "added", None, "2"), ("a", "changed", None, "3"), ("c", "moved", "b", None), ("d", "added", None, "4"), ("d", "removed", None, None)]
    rows = [(*r, i) for i, r in enumerate(log)]
    size = -(-len(rows) // batches)
    source = tmp_path / f"in{batches}"
    source.mkdir()
    for i in range(batches):
        spark.createDataFrame(rows[i * size : (i + 1) * size], watch.CHANGE).coalesce(1).write.mode("append").json(f"file://{source}/part{i}")
    store = watch.RevisionStore(spark, f"file://{tmp_path}/store")
    stream = spark.readStream.schema(watch.CHANGE).option("recursiveFileLookup", "true").json(f"file://{source}")
    query = watch.watch(stream, store, f"file://{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, store.current()[1].collect())) == [("a", "3"), ("c", "2")]
    assert not store.commit(1, store.current()[1])  # an obsolete revision
