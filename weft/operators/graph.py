"""Closures, strongly connected components, data flow and integrity checks over edge tables.

Iterative operators write each round to the shared folder; a round joins only the newest rows with the edges, so the work
is proportional to the edges that are followed. They stop at the first round that finds nothing new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import materialize, tasks_for


def closure(edges: DataFrame, seeds: DataFrame, keys: tuple[str, ...] = (), reverse: bool = False, max_rounds: int = 1000) -> DataFrame:
    """(keys, node, depth) of all nodes that ``seeds`` (keys, node) reach over ``edges`` (src, dst); seeds have depth 0.

    With ``reverse`` edges are followed from dst to src: what depends on the seeds. ``keys`` name independent closures.
    """
    start, to = ("dst", "src") if reverse else ("src", "dst")
    steps = edges.select(F.col(start).alias("_from"), F.col(to).alias("node")).where("_from is not null and node is not null")
    own = [*keys, "node"]
    newest = materialize(seeds.select(*own).distinct().withColumn("depth", F.lit(0)), "reached")
    reached = newest
    for depth in range(1, max_rounds + 1):
        found = newest.select(*keys, F.col("node").alias("_from")).join(steps, "_from").select(*own).distinct()
        newest = materialize(found.join(reached, own, "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if newest.isEmpty():
            return reached
        reached = reached.unionByName(newest)
    raise RuntimeError(f"no end after {max_rounds} rounds")


def impact(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(node, depth): everything that depends on the changed nodes, these included."""
    return closure(edges, changed, reverse=True)


def impact_reasons(edges: DataFrame, changed: DataFrame, id_col: str = "id") -> DataFrame:
    """(node, depth, reason): the least id of a dependency record through which a node was reached first; null for seeds."""
    hit = impact(edges, changed)
    back = edges.join(hit.select(F.col("node").alias("dst"), F.col("depth").alias("d")), "dst").select(F.col("src").alias("node"), (F.col("d") + 1).alias("depth"), id_col)
    first = back.groupBy("node", "depth").agg(F.min(id_col).alias("reason"))
    return hit.join(first, ["node", "depth"], "left")


def unused(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that are neither roots nor the target of any edge: one hop, not reachability."""
    return nodes.select("node").join(roots.select("node"), "node", "left_anti").join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def reach_pairs(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(src, dst) of every ordered pair connected by a path of one edge or more, by path doubling. For small components."""
    pairs = materialize(edges.select("src", "dst").distinct(), "paths")
    n = pairs.count()
    for _ in range(max_rounds):
        longer = pairs.select("src", F.col("dst").alias("mid")).join(pairs.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        pairs = materialize(pairs.unionByName(longer).distinct(), "paths")
        if (now := pairs.count()) == n:
            return pairs
        n = now
    raise RuntimeError("paths did not converge")


def trim_acyclic(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """The edges among nodes that have both an incoming and an outgoing edge, repeated until none is left to drop.

    A cycle survives, everything that only leads into or out of cycles goes: what is left is what SCCs need.
    """
    left = materialize(edges.select("src", "dst").distinct(), "edges")
    n = left.count()
    for _ in range(max_rounds):
        inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left = materialize(inner.select("src", "dst"), "edges")
        if (now := left.count()) == n or now == 0:
            return left
        n = now
    return left


def sccs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, scc, size, cyclic): scc is the smallest member; cyclic if it has two members or an edge to itself."""
    pairs = reach_pairs(trim_acyclic(edges))
    mutual = pairs.join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi")
    labelled = mutual.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("scc"))
    out = nodes.select("node").distinct().join(labelled, "node", "left")
    out = out.select("node", F.coalesce("scc", "node").alias("scc"), F.col("scc").isNotNull().alias("on_cycle"))
    sizes = out.groupBy("scc").agg(F.count(F.lit(1)).alias("size"), F.max("on_cycle").alias("cyclic"))
    return out.select("node", "scc").join(sizes, "scc").select("node", "scc", "size", "cyclic")


def scc_identity(components: DataFrame) -> DataFrame:
    """(scc, scc_id): a content hash of the sorted members."""
    return components.groupBy("scc").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("node")), "\n"), 256).alias("scc_id"))


def scc_data_flow(components: DataFrame, reads: DataFrame) -> DataFrame:
    """(node, read): in a cyclic component every member ends with all members' reads, elsewhere a node has its own.

    reads: (node, read). This is the fixed point of passing reads against the edges of a component.
    """
    of = reads.select("node", "read").distinct().join(components, "node")
    cyclic = of.where("cyclic").select("scc", "read").distinct().join(components.where("cyclic").select("scc", "node"), "scc").select("node", "read")
    return of.where(~F.col("cyclic")).select("node", "read").unionByName(cyclic).distinct()


def replay_data_flow(members: list[str], edges: list[tuple[str, str]], reads: dict[str, set[str]], max_iterations: int, max_work: int) -> dict:
    """The sequential run of one component with budgets: iterations and work, which depend on the order of edges, and whether it converged. The pass that finds nothing new counts as an iteration."""
    state = {m: set(reads.get(m, ())) for m in members}
    inner = [(a, b) for a, b in edges if a in state and b in state]
    iterations = work = 0
    while iterations < max_iterations:
        iterations += 1
        grew = False
        for a, b in inner:
            if work >= max_work:
                return {"reads": state, "iterations": iterations, "work": work, "converged": False}
            work += 1
            if not state[b] <= state[a]:
                state[a] |= state[b]
                grew = True
        if not grew:
            return {"reads": state, "iterations": iterations, "work": work, "converged": True}
    return {"reads": state, "iterations": iterations, "work": work, "converged": False}


def broken_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, missing): edges with an end that is no node; one row per missing end.

    A task holds the nodes of its partition, each once, in a hash table; edges pass by it unsorted, so a node that very many
    edges point to takes no memory.
    """
    n = tasks_for(nodes, edges)
    known = nodes.select("node").repartition(n, "node")
    lacks = lambda end: edges.repartition(n, end).join(known.select(F.col("node").alias(end)).hint("shuffle_hash"), end, "left_anti")
    no_src = lacks("src").select("src", "dst", F.lit("src").alias("missing"))
    no_dst = lacks("dst").select("src", "dst", F.lit("dst").alias("missing"))
    return no_src.unionByName(no_dst)


def degrees(nodes: DataFrame, edges: DataFrame, pages: DataFrame) -> DataFrame:
    """(node, dependencies, dependents, usage): used if anything depends on it or it is a page itself."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("dependencies"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("dependents"))
    page = pages.select("node").distinct().withColumn("is_page", F.lit(True))
    both = nodes.select("node").join(out, "node", "left").join(into, "node", "left").join(page, "node", "left")
    dependents = F.coalesce("dependents", F.lit(0).cast("long"))
    usage = F.when((dependents > 0) | F.coalesce("is_page", F.lit(False)), "used").otherwise("unused")
    return both.select("node", F.coalesce("dependencies", F.lit(0).cast("long")).alias("dependencies"), dependents.alias("dependents"), usage.alias("usage"))
