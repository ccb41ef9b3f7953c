"""URL verdicts: fixed host/path rules first, then a path-template tree per host, in DataFrame operations only.

A path's shape is its segments, those that carry digits being one branch. The tree of a host is built from counts of whole
branches, never from rows, level by level down to the last segment: a branch of digits becomes a wildcard, and so does one
that holds less than ``min_share`` of the pages of its parent. Sibling branches whose labelled block rates are alike (a
two-proportion z below ``z``, or no labels at all) are merged into their parent's pool. A shape that is alone in its pool is
finished at once, so there are as many rounds as levels at which branches part, however long a path is.

Labels are the verdicts of the rules. What they say of a shape, on all hosts, is the prior of that shape on every host:
(blocked + strength * share) / (labelled + strength), where share is that of blocked pages among all labelled pages. A
template's purity is (blocked + strength * prior) / (labelled + strength), its prior being the mean over its pages; it is
rejected when its purity reaches ``reject``. So a template generalises from the pages that a rule decides to its siblings,
and to hosts that no rule knows, while a host's own labels outweigh the others'.

Keys that hold over a ten-thousandth of all rows (at most ten thousand keys) are joined by broadcast, the rest by shuffle: no
host or template gathers in a task.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and verdict allow by the method
(no labels); a url with an empty path fits only rules with an empty path; repeated rows give one row each; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.text import LOWER, UPPER
from weft.session import materialize

#: Fixed by the contract: host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: Stands for all segments with digits; no path segment holds a slash.
DIGITS = "/#"
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
#: A key with more than this part of all rows is hot, so there are fewer hot keys than one over it.
HOT_SHARE = 1 / 10_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    known = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(known, PARTS, 1), UPPER, LOWER), F.regexp_extract(known, PARTS, 2)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], share: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key and in ``share`` how many of ``total`` rows have it.

    Rows of hot keys stay where they are: the table's rows for them, at most 1 / HOT_SHARE, are sent out.
    """
    hot, rest = table.where(F.col(share) > total * HOT_SHARE), table.where(F.col(share) <= total * HOT_SHARE)
    fields = [c for c in table.columns if c != share]
    stay = rows.join(F.broadcast(hot.select(*fields)), keys)
    move = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest.select(*fields), keys)
    return stay.unionByName(move)


def shape_of(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.rlike("[0-9]"), DIGITS).otherwise(s))


def template_tree(shapes: DataFrame, min_share: float, z: float) -> DataFrame:
    """``shapes`` (host, segments, n, bad, good and others; one row per host and segments) with template."""
    level, done, k = shapes.withColumn("template", F.lit("")), None, 0
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "good")]
    while True:
        level = level.withColumn("_seg", F.coalesce(F.get("segments", F.lit(k)), F.lit("")))  # "" ends a path
        child = level.groupBy("host", "template", "_seg").agg(*sums, F.count(F.lit(1)).alias("_paths"))
        parent = child.groupBy("host", "template").agg(*[F.sum(c).alias("p_" + c) for c in ("n", "bad", "good")], F.count(F.lit(1)).alias("_children"))
        child, parent = materialize(child, "branches"), materialize(parent, "parents")
        n_child = child.count()
        labelled, p_labelled = F.col("bad") + F.col("good"), F.col("p_bad") + F.col("p_good")
        rate = F.col("p_bad") / F.when(p_labelled > 0, p_labelled)
        # of the branch against the whole of its parent; a pure parent has no variance and all its branches are alike
        spread = F.sqrt(rate * (1 - rate) / F.when(labelled > 0, labelled))
        score = F.abs(F.col("bad") / F.when(labelled > 0, labelled) - rate) / F.when(spread > 0, spread)
        variable = (F.col("_seg") == DIGITS) | (F.col("n") < F.col("p_n") * min_share)
        alike = F.coalesce(score < z, F.lit(True))
        own = F.when(F.col("_seg") == DIGITS, DIGITS).otherwise(F.concat(F.lit("/"), "_seg"))
        name = F.when(F.col("_seg") == "", "").when(variable & alike, "/*").when(alike & (labelled > 0), "/~").otherwise(own)
        named = spread_join(child, parent, ["host", "template"], "_children", n_child)
        names = materialize(named.select("host", "template", "_seg", name.alias("_name"), "_paths"), "names")
        pools = names.groupBy("host", "template", "_name").agg(F.sum("_paths").alias("_lone"), F.count(F.lit(1)).alias("_children"))
        names = spread_join(names, materialize(pools, "pools"), ["host", "template", "_name"], "_children", n_child)
        level = spread_join(level, names, ["host", "template", "_seg"], "_paths", level.count())
        level = level.withColumn("template", F.concat("template", "_name"))
        # alone in its pool, a shape is like its parent in everything that follows
        later = F.when(F.col("bad") + F.col("good") > 0, F.lit("/~"))
        rest = F.transform(F.slice("segments", k + 2, 1 << 30), lambda s: F.when(s == DIGITS, "/*").otherwise(F.coalesce(later, F.concat(F.lit("/"), s))))
        ends = (F.col("_lone") == 1) | (F.size("segments") <= k)
        level = level.withColumn("template", F.when(ends, F.concat("template", F.array_join(rest, ""))).otherwise(F.col("template")))
        level = materialize(level.withColumn("_ends", ends).drop("_seg", "_name", "_lone"), "templates")
        finished = level.where("_ends").drop("_ends")
        done = finished if done is None else done.unionByName(finished)
        level, k = level.where("not _ends").drop("_ends"), k + 1
        if level.isEmpty():
            return done


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, min_share: float = 0.02, z: float = 1.96, strength: float = 4.0, reject: float = 0.8) -> DataFrame:
    """One row per input row: ``id_col``, host, path, rule, verdict, template, purity."""
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_r", rule_for(F.col("host"), F.col("path"), rules)).withColumn("segments", shape_of(F.col("path")))
    bad = F.sum(F.when(F.col("_r.verdict") == "block", 1).otherwise(0))
    good = F.sum(F.when(F.col("_r.verdict") == "allow", 1).otherwise(0))
    shapes = materialize(rows.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), bad.alias("bad"), good.alias("good")), "shapes")

    total = shapes.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("shapes"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    share = (total.bad or 0) / max(1, (total.bad or 0) + (total.good or 0))
    everywhere = shapes.groupBy("segments").agg(F.sum("bad").alias("_bad"), F.sum("good").alias("_good"), F.count(F.lit(1)).alias("_hosts"))
    prior = (F.col("_bad") + strength * share) / (F.col("_bad") + F.col("_good") + strength)
    everywhere = materialize(everywhere.select("segments", "_hosts", prior.alias("prior")), "priors")
    tree = template_tree(spread_join(shapes, everywhere, ["segments"], "_hosts", total.shapes or 0), min_share, z)

    stats = tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), (F.sum(F.col("prior") * F.col("n")) / F.sum("n")).alias("prior"), F.count(F.lit(1)).alias("_shapes"))
    purity = (F.col("bad") + strength * F.col("prior")) / (F.col("bad") + F.col("good") + strength)
    scored = materialize(stats.select("host", "template", "_shapes", F.round(purity, 6).alias("purity")), "purities")
    judged = spread_join(tree.select("host", "segments", "n", "template"), scored, ["host", "template"], "_shapes", total.shapes or 0)
    judged = materialize(judged, "judged")
    found = spread_join(rows, judged, ["host", "segments"], "n", total.n or 0)
    own = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return found.select(id_col, "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), own).alias("verdict"), "template", "purity")
