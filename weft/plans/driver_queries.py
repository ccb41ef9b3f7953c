"""Every operator over the star-schema, event, document and page tables, one query a key; SQL for each is in driver_sql."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import paths as P
from weft.functions import text as X
from weft.functions import type_expressions as E
from weft.functions import values as V
from weft.operators import changes, checks, contracts, graph, intervals, reconcile, relate
from weft.session import table as read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def url_path(c: str = "url") -> Column:
    return F.regexp_extract(c, "^[a-z]+://[^/?#]*/?([^?#]*)", 1)


def node(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


def fk_edges(spark: SparkSession, d: str) -> DataFrame:
    """Foreign keys as dependency edges: what refers depends on what it refers to."""
    n, c, o = read(spark, d, "nation"), read(spark, d, "customer"), read(spark, d, "orders")
    return (
        n.select(node("nation", "n_nationkey").alias("src"), node("region", "n_regionkey").alias("dst"))
        .unionByName(c.select(node("customer", "c_custkey").alias("src"), node("nation", "c_nationkey").alias("dst")))
        .unionByName(o.select(node("order", "o_orderkey").alias("src"), node("customer", "o_custkey").alias("dst")))
    )


def fk_nodes(spark: SparkSession, d: str) -> DataFrame:
    kinds = (("region", "r_regionkey", "region"), ("nation", "n_nationkey", "nation"), ("customer", "c_custkey", "customer"), ("orders", "o_orderkey", "order"))
    out = None
    for name, key, kind in kinds:
        one = read(spark, d, name).select(node(kind, key).alias("node"), F.lit(kind).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out


def theme_path(spark: SparkSession, d: str) -> DataFrame:
    """A path of each shape for every page."""
    k = F.col("page_id") % 10
    name = F.col("page_id").cast("string")
    shapes = ("sections/p{}.liquid", "sections/g{}.json", "snippets/s{}.liquid", "blocks/b{}.liquid", "templates/t{}.json",
              "templates/customers/c{}.liquid", "layout/l{}.liquid", "locales/x{}.json", "assets/a{}.css", "components/c{}.nz.liquid")
    path = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        before, after = shape.split("{}")
        path = F.when(k == i, F.concat(F.lit(before), name, F.lit(after))).otherwise(path)
    return read(spark, d, "pages").select("page_id", path.alias("path"))


# -- scans, predicates, scalar functions --------------------------------------------------------------------------------

@query
def role_classify(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return theme_path(spark, d).select("page_id", "path", P.classify(p).alias("role"), P.file_kind(p).alias("kind"), P.resource_name(p).alias("name"), P.directory_of(p).alias("folder"))


@query
def route_projection(spark: SparkSession, d: str) -> DataFrame:
    t = theme_path(spark, d).where(P.classify(F.col("path")).isin(*P.PAGE_ROLES))
    return t.select("page_id", P.template_route(F.col("path")).alias("route"))


@query
def file_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", X.fingerprint(F.col("lang"), F.col("source"), F.col("text")).alias("fingerprint"))


@query
def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select("page_id", url_path().alias("path"))
    excluded = P.glob_match(F.col("path"), ["en/**", "**/*.html", "de/1??"])
    return p.select("page_id", "path", excluded.alias("excluded"))


@query
def path_normalize(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select("page_id", F.concat(F.lit("a/./b/../"), F.rtrim(url_path(), F.lit("/")), F.lit("//x/../y.css")).alias("raw"))
    return p.select("page_id", P.normalize_path(F.col("raw")).alias("path"), P.resolve_import(F.lit("one/two/f.js"), F.concat(F.lit("../"), F.col("raw"))).alias("imported"))


@query
def snake_slug(spark: SparkSession, d: str) -> DataFrame:
    p, t = F.col("p_name"), F.initcap(F.replace("p_type", F.lit(" "), F.lit("")))
    return read(spark, d, "part").select("p_partkey", X.snake_case(F.col("p_type")).alias("snake"), X.humanize(F.col("p_type")).alias("label"), X.slug(p).alias("slug"),
                                          X.story_id(F.col("p_type"), F.col("p_brand")).alias("story"), X.dataset_attribute(t).alias("attribute"), X.scoped_class(X.slug(p), F.lit("root")).alias("scoped"))


@query
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.sha2(X.escape_html(F.col("html")), 256).alias("escaped"), F.length(X.blank_outside(F.col("html"))).cast("long").alias("n"))


@query
def html_hooks(spark: SparkSession, d: str) -> DataFrame:
    h = read(spark, d, "pages").select("page_id", "html")
    classes = F.flatten(F.transform(F.regexp_extract_all("html", F.lit('class="([^"]*)"'), F.lit(1)), lambda v: X.static_class_names(v)))
    hooks = F.concat(
        F.transform(classes, lambda v: F.struct(F.lit("class").alias("hook"), v.alias("name"))),
        F.transform(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)[ >]"), F.lit(1)), lambda v: F.struct(F.lit("tag").alias("hook"), v.alias("name"))),
        F.transform(F.regexp_extract_all("html", F.lit(' (href|lang|charset)="'), F.lit(1)), lambda v: F.struct(F.lit("attribute").alias("hook"), v.alias("name"))),
    )
    return h.select("page_id", F.explode(hooks).alias("h")).groupBy("page_id", "h.hook", "h.name").agg(F.count(F.lit(1)).alias("n"))


@query
def html_links_resolve(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages")
    refs = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("place", "name"))
    refs = refs.select(F.concat_ws(":", "page_id", "place").alias("ref"), "page_id", "name")
    decls = p.select(F.regexp_extract("html", "<h1>([^ <]*)", 1).alias("name"), F.col("page_id").alias("target"))
    found = relate.resolve_references(refs, decls, ["name"], "ref", "target", F.col("name") != "")
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(long("n_targets")).alias("targets"))


@query
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return e.select("event_id", F.explode("m").alias("key", "value"))


@query
def doc_params(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    name = F.regexp_extract("body", r"^([A-Z][a-z]+) ([a-z]+)", 1)
    return lines.where(name != "").select("doc_id", long("line").alias("line"), name.alias("name"), F.regexp_extract("body", r"^([A-Z][a-z]+) ([a-z]+)", 2).alias("kind"))


@query
def offset_to_linecol(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("doc_id", "text", (F.instr("text", " the ") - 1).alias("pos")).where("pos >= 0")
    line, column = X.line_column(F.col("text"), F.col("pos"))
    return t.select("doc_id", long("pos").alias("pos"), long(line).alias("line"), long(column).alias("col"))


@query
def utf16_lengths(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.lit("\U0001f600")).otherwise(""))
    return read(spark, d, "documents").select("doc_id", long(X.utf16_length(t)).alias("units"), long(F.length(t)).alias("points"), long(F.octet_length(t)).alias("bytes"))


@query
def money_format(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", X.money(F.round(F.col("o_totalprice") * 100).cast("long"), "USD").alias("price"))


@query
def literal_range(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem")
    q = V.range_violation(F.col("l_quantity"), F.lit(5.0), F.lit(45.0), F.lit(5.0))
    s = V.range_violation(F.round(F.col("l_discount") * 100), F.lit(1.0), F.lit(8.0), F.lit(2.0))
    return x.select(F.coalesce(q, F.lit("ok")).alias("quantity"), F.coalesce(s, F.lit("ok")).alias("discount")).groupBy("quantity", "discount").agg(F.count(F.lit(1)).alias("n"))


@query
def assignable(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["string", "string-literal", "url", "color", "number", "number-literal", "money", "boolean", "handle", "nil", "unknown"]
    k = read(spark, d, "region").limit(1).select(F.explode(F.array(*map(F.lit, kinds))).alias("source"))  # a fixed list of kinds
    pairs = k.select("source", F.explode(F.array(*map(F.lit, kinds))).alias("target"))
    return pairs.select("source", "target", V.assignable(F.col("source"), F.col("target")).alias("fits"))


@query
def literal_validators(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    handle, color = X.slug(F.col("p_name")), F.concat(F.lit("#"), F.substring(F.sha2("p_name", 256), F.lit(1), (F.col("p_partkey") % 9).cast("int")))
    return p.select("p_partkey", V.is_handle(handle).alias("handle"), V.is_handle(F.col("p_name")).alias("raw_handle"), V.is_hex_color(color).alias("color"))


# -- references and evidence --------------------------------------------------------------------------------------------

@query
def settings_reads_unknown(spark: SparkSession, d: str) -> DataFrame:
    reads = read(spark, d, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("name"))
    declared = reads.where(F.col("name").isin("signup", "view") | ((F.col("name") == "click") & (F.col("owner") % 2 == 0)))
    return relate.unknown_reads(reads, declared, ["owner", "name"])


def _line_refs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = read(spark, d, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("ref"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("symbol"))
    decls = read(spark, d, "part").where("p_partkey % 7 <> 0").select((F.col("p_partkey") % 1500).alias("symbol"), F.col("p_partkey").alias("target"))
    return refs, decls


@query
def ref_resolution(spark: SparkSession, d: str) -> DataFrame:
    refs, decls = _line_refs(spark, d)
    found = relate.resolve_references(refs, decls, ["symbol"], "ref", "target", F.col("l_linenumber") < 6)
    return found.select("ref", "status", long("n_targets").alias("n_targets"))


@query
def dependency_index(spark: SparkSession, d: str) -> DataFrame:
    refs, decls = _line_refs(spark, d)
    found = relate.resolve_references(refs.withColumn("kind", F.lit("line")), decls, ["symbol"], "ref", "target", carry=("l_orderkey", "kind"))
    return relate.filtered(relate.dependency_records(found, "ref", "l_orderkey", "kind"), dst=10, kind=None)


@query
def behavior_connections(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    role = F.when(F.col("event_type").isin("signup", "purchase"), "producer").otherwise("consumer")
    found = relate.connections(e, ["user_id"], "event_type", role)
    return found.select("user_id", F.array_join("producers", ",").alias("producers"), F.array_join("consumers", ",").alias("consumers"))


@query
def behavior_index(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("kind"))
    records = relate.filtered(e, kind="purchase")
    found = relate.evidence_for_owners(e, records, "user_id")
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("evidence"), F.count_if(F.col("kind") == "purchase").alias("records"))


@query
def metafield_index(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang", "source")
    records = relate.filtered(docs, lang="de", source="")
    evidence = docs.select("doc_id", "source", F.lit("read").alias("kind"))
    return relate.evidence_for_owners(evidence, records, "source", "read").groupBy("source").agg(F.count(F.lit(1)).alias("evidence"))


def _evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    own = F.col("c_custkey").alias("owner")
    kinds = (
        c.select(own, F.lit("role").alias("kind")),
        c.where("c_acctbal < 0").select(own, F.lit("schema").alias("kind")),
        o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("owner"), F.lit("metafield-read").alias("kind")),
        o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("owner"), F.lit("behavior").alias("kind")),
        c.where("c_nationkey % 5 = 0").select(own, F.lit("render-reference").alias("kind")),
    )
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return c.select(own), out


@query
def evidence_union(spark: SparkSession, d: str) -> DataFrame:
    owners, evidence = _evidence(spark, d)
    return relate.file_classes(owners, evidence, "owner").select("owner", F.array_join("classes", ",").alias("classes"))


@query
def evidence_capabilities(spark: SparkSession, d: str) -> DataFrame:
    _, evidence = _evidence(spark, d)
    return evidence.select("kind", F.coalesce(relate.capability(F.col("kind")), F.lit("none")).alias("capability")).groupBy("kind", "capability").agg(F.count(F.lit(1)).alias("n"))


@query
def duplicate_flags(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return relate.flags_after_first(docs, ["h"], ["doc_id"]).select("doc_id", "duplicate")


@query
def ir_merge(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_name", (F.col("p_size") % 4).alias("rank"), "p_brand", F.array("p_type").alias("declarations"))
    even, odd = p.where("rank % 2 = 0"), p.where("rank % 2 = 1")
    merged = relate.merge_records([even, odd], "p_name", "rank", ["p_brand"], "declarations")
    return merged.select("p_name", "p_brand", F.array_join("declarations", "|").alias("declarations"))


# -- graph --------------------------------------------------------------------------------------------------------------

def _region(spark: SparkSession, d: str, key: int) -> DataFrame:
    return read(spark, d, "region").where(F.col("r_regionkey") == key).select(node("region", "r_regionkey").alias("node"))


@query
def impact(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact(fk_edges(spark, d), _region(spark, d, 1)).select("node", long("depth").alias("depth"))


@query
def impact_reasons(spark: SparkSession, d: str) -> DataFrame:
    edges = fk_edges(spark, d).select("src", "dst", F.concat_ws(">", "src", "dst").alias("id"))
    return graph.impact_reasons(edges, _region(spark, d, 2)).select("node", long("depth").alias("depth"), F.coalesce("reason", F.lit("")).alias("reason"))


@query
def affected_pages(spark: SparkSession, d: str) -> DataFrame:
    """Orders, as the pages of this graph, that a change to a region reaches."""
    hit = graph.impact(fk_edges(spark, d), _region(spark, d, 3))
    pages = fk_nodes(spark, d).where("kind = 'order'").select("node")
    return hit.join(pages, "node", "left_semi").select("node")


@query
def unused_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that no edge reaches when only urgent orders refer to customers."""
    nodes, urgent = fk_nodes(spark, d), read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(node("order", "o_orderkey").alias("src"))
    edges = fk_edges(spark, d)
    edges = edges.where("src not like 'order:%'").unionByName(edges.join(urgent, "src", "left_semi"))
    return graph.unused(nodes, edges, nodes.where("kind = 'order'"))


@query
def forward_closure(spark: SparkSession, d: str) -> DataFrame:
    seeds = read(spark, d, "orders").select(node("order", "o_orderkey").alias("node"))
    return graph.closure(fk_edges(spark, d), seeds).select("node", long("depth").alias("depth"))


@query
def render_tree(spark: SparkSession, d: str) -> DataFrame:
    roots = read(spark, d, "nation").where("n_nationkey < 6").select(node("nation", "n_nationkey").alias("root"), node("nation", "n_nationkey").alias("node"))
    tree = graph.closure(fk_edges(spark, d), roots, keys=("root",), reverse=True)
    return tree.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.max(long("depth")).alias("depth"))


def _cycles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All parts: cycles of seven neighbours (shorter at the end of the table is none), and an edge out of every third part."""
    p = read(spark, d, "part").select(long("p_partkey").alias("k"))
    ring = p.select(F.col("k").alias("src"), F.when(F.col("k") % 7 == 6, F.col("k") - 6).otherwise(F.col("k") + 1).alias("dst"))
    return p.select(F.col("k").alias("node")), ring.unionByName(p.where("k % 3 = 0").select(F.col("k").alias("src"), (-F.col("k") - 1).alias("dst")))


@query
def scc(spark: SparkSession, d: str) -> DataFrame:
    return graph.sccs(*_cycles(spark, d))


@query
def scc_dataflow(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _cycles(spark, d)
    reads = read(spark, d, "part").select(long("p_partkey").alias("node"), F.col("p_brand").alias("read"))
    return graph.scc_data_flow(graph.sccs(nodes, edges), reads)


@query
def file_impact(spark: SparkSession, d: str) -> DataFrame:
    nodes = fk_nodes(spark, d)
    return graph.degrees(nodes, fk_edges(spark, d), nodes.where("kind = 'order'"))


@query
def endpoint_integrity(spark: SparkSession, d: str) -> DataFrame:
    nodes = fk_nodes(spark, d).where("not (kind = 'customer' and node like '%7') and not (kind = 'order' and node like '%99')")
    return graph.broken_endpoints(nodes, fk_edges(spark, d))


@query
def summary(spark: SparkSession, d: str) -> DataFrame:
    nodes = fk_nodes(spark, d).agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("kind").alias("kinds"))
    edges = fk_edges(spark, d).agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("dst").alias("targets"))
    return nodes.join(edges)  # one row each


@query
def cardinality_check(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).where("n <> 4")


# -- ranges, logs, streams ----------------------------------------------------------------------------------------------

def _spans(spark: SparkSession, d: str, kind: str, seconds: int) -> DataFrame:
    e = read(spark, d, "events").where(F.col("event_type") == kind)
    return e.select("user_id", "event_id", F.unix_timestamp("ts").alias("start"), (F.unix_timestamp("ts") + seconds).alias("end"), long(F.col("event_id") % 3).alias("depth"))


@query
def local_reads(spark: SparkSession, d: str) -> DataFrame:
    points = read(spark, d, "events").where("event_type = 'click'").select("event_id", "user_id", F.unix_timestamp("ts").alias("at"))
    found = intervals.in_any_range(points, _spans(spark, d, "view", 86_400), ["user_id"], "at", "start", "end")
    return found.select("event_id", "local")


@query
def innermost_scope(spark: SparkSession, d: str) -> DataFrame:
    points = read(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id", F.unix_timestamp("ts").alias("at"))
    scopes = _spans(spark, d, "view", 864_000).withColumnRenamed("event_id", "sid")
    found = intervals.innermost_scope(points, scopes, ["user_id"], "at", "start", "end", "depth", "sid")
    return found.select("event_id", "scope")


@query
def merge_ranges(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge_ranges(_spans(spark, d, "view", 172_800), ["user_id"], "start", "end")


@query
def debounce(spark: SparkSession, d: str) -> DataFrame:
    bursts = intervals.quiet_gaps(read(spark, d, "events"), ["user_id"], "ts", "6 hours")
    return bursts.select("user_id", F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"), "n")


@query
def coalesce_changes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "removed").otherwise("changed")
    log = read(spark, d, "events").select("user_id", kind.alias("kind"), "ts", "event_id")
    return changes.coalesce_changes(log, ["user_id"], "kind", ["ts", "event_id"])


@query
def snapshot_diff_moves(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 3 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    edited = F.when(F.col("doc_id") % 30 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.where("doc_id % 3 <> 1").select("doc_id", F.sha2(edited, 256).alias("h"))
    return changes.snapshot_diff(old, new, "doc_id", "h")


@query
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "event_type")
    return changes.latest(e, ["user_id"], ["us", "event_id"])


# -- reconciliation -----------------------------------------------------------------------------------------------------

def _locks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = read(spark, d, "part")
    kind = F.when(F.col("p_partkey") % 4 == 0, "block").otherwise("setting")
    rows = p.select(F.col("p_brand").alias("section"), kind.alias("kind"), node("id", "p_partkey").alias("id"), F.col("p_type").alias("type"), "p_partkey", "p_size")
    new = rows.where("section <> 'Brand#11' and p_partkey % 9 <> 0").withColumn("type", F.when(F.col("p_size") % 10 == 0, F.lit("other")).otherwise(F.col("type")))
    keep = ["section", "kind", "id", "type"]
    return rows.select(*keep), new.select(*keep)


@query
def schema_drift(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.schema_drift(*_locks(spark, d)).select("section", "kind", F.coalesce("id", F.lit("")).alias("id"), "drift")


@query
def migrations(spark: SparkSession, d: str) -> DataFrame:
    old, _ = _locks(spark, d)
    steps = [
        {"op": "renameSection", "from": "Brand#11", "to": "Brand#11-new"},
        {"op": "removeSetting", "section": "Brand#11-new", "setting": "id:1"},
        {"op": "renameSetting", "section": "Brand#12", "from": "id:2", "to": "id:two"},
        {"op": "renameBlock", "section": "Brand#11-new", "from": "id:4", "to": "id:four"},
    ]
    return reconcile.apply_migrations(old, steps)


@query
def migrations_pending(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(node("m", "p_partkey").alias("id"), "p_partkey")
    return reconcile.pending(p.select("id"), p.where("p_partkey % 3 = 0").select("id"))


@query
def merge3(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("v"))
    k = F.col("o_orderkey")
    base = o.where(k % 5 != 0)
    source = o.where(k % 7 != 0).withColumn("v", F.when(k % 3 == 0, F.lit("source")).otherwise(F.col("v")))
    merchant = o.where(k % 11 != 0).withColumn("v", F.when(k % 4 == 0, F.lit("merchant")).otherwise(F.col("v")))
    return reconcile.merge3(base, source, merchant, "o_orderkey", "v")


def _outputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = read(spark, d, "orders").select(node("out", "o_orderkey").alias("path"), F.col("o_orderkey").alias("k"))
    h = lambda m: F.concat(F.lit("h"), (F.col("k") % m).cast("string")).alias("hash")
    return o.where("k % 5 <> 0").select("path", h(3)), o.where("k % 4 <> 0").select("path", h(2)), o.where("k % 3 <> 0").select("path", h(6))


@query
def ownership_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.output_plan(*_outputs(spark, d))


@query
def component_diff(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.component_diff(*_outputs(spark, d))


@query
def collision_check(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(X.slug(F.col("p_type")).alias("path"), "p_brand", "p_name")
    return reconcile.collisions(p, "path", "p_brand", "p_name")


@query
def semver_latest(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    version = F.concat_ws(".", F.col("p_size"), (F.col("p_partkey") % 13).cast("string"), F.length("p_name").cast("string"))
    return reconcile.latest_version(p.select("p_brand", version.alias("version")), "p_brand", "version")


@query
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    existing = x.where("l_orderkey % 2 = 0")
    new = x.where("l_linenumber <= 2").withColumn("l_partkey", -F.col("l_partkey"))
    return reconcile.insert_if_absent(existing, new, ["l_orderkey", "l_linenumber"])


@query
def install_closure(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(long("p_partkey").alias("k"))
    deps = p.select(F.col("k").alias("src"), F.expr("k div 2").alias("dst")).unionByName(p.select(F.col("k").alias("src"), F.expr("k div 3").alias("dst")))
    return reconcile.install_closure(p.agg(F.max("k").alias("node")), deps).select("node")


@query
def agreement_score(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    declared, inferred = F.col("quality") == 1, F.col("n_chars") >= 500
    cell = lambda a, b: F.count_if((declared == a) & (inferred == b))
    return x.agg(F.count(F.lit(1)).alias("compared"), cell(True, True).alias("both"), cell(True, False).alias("declared_only"), cell(False, True).alias("inferred_only"), cell(False, False).alias("neither"))


@query
def precision_stats(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").groupBy("o_orderpriority")
    at = lambda q: F.round(F.expr(f"percentile(o_totalprice, {q})"), 4)
    return o.agg(at(0.5).alias("median"), at(0.95).alias("p95"), F.round(F.min("o_totalprice"), 4).alias("least"), F.round(F.max("o_totalprice"), 4).alias("most"))


@query
def scale_clone(spark: SparkSession, d: str) -> DataFrame:
    """Every nation, and copies with a suffix: the number of copies is the parameter of the generator."""
    n = read(spark, d, "nation").select("n_name")
    copies = n.select("n_name", F.explode(F.sequence(F.lit(1), F.lit(15))).alias("i")).select(F.concat("n_name", F.lit("-x"), F.col("i").cast("string")).alias("name"))
    return n.select(F.col("n_name").alias("name")).unionByName(copies)


@query
def story_validation(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    props = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"), F.when(F.col("p_partkey") % 5 == 0, "extra").otherwise("type"), F.col("p_type"))
    rows = p.select("p_partkey", F.explode(props).alias("name", "value"))
    controls = spark.createDataFrame([("size", "range", 10.0, 40.0), ("brand", "text", None, None), ("type", "text", None, None)], "name string, control string, least double, most double")
    joined = rows.join(F.broadcast(controls), "name", "left")  # the fixed control table
    violation = V.range_violation(F.col("value").try_cast("double"), F.col("least"), F.col("most"))
    issue = F.when(F.col("control").isNull(), "unknown-prop").when((F.col("control") == "range") & violation.isNotNull(), F.concat(F.lit("range-"), violation))
    return joined.select("p_partkey", "name", issue.alias("issue")).where("issue is not null")


@query
def story_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Props laid over defaults; an explicit null unsets a prop."""
    p = read(spark, d, "part")
    own = F.map_from_arrays(F.array(F.lit("size"), F.lit("brand")), F.array(F.when(F.col("p_size") > 25, F.col("p_size").cast("string")), F.col("p_brand")))
    defaults = F.create_map(F.lit("size"), F.lit("10"), F.lit("tone"), F.lit("plain"))
    kept = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(own, k))
    props = F.map_filter(F.map_concat(kept, own), lambda k, v: v.isNotNull())
    return p.select("p_partkey", F.explode(props).alias("name", "value"))


# -- gates, lists, cycles -----------------------------------------------------------------------------------------------

@query
def severity_gate(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warning").otherwise("info")
    return checks.severity_gate(read(spark, d, "events").select("user_id", severity.alias("severity")), "user_id")


@query
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    return checks.first_per_key(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", ["l_linenumber"])


@query
def contract_targets(spark: SparkSession, d: str) -> DataFrame:
    sites = read(spark, d, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("site"), F.col("l_partkey").alias("target"))
    p = read(spark, d, "part")
    targets = p.select(F.col("p_partkey").alias("target"), F.when(F.col("p_size") < 10, "section").otherwise("snippet").alias("role"))
    return checks.contract_targets(sites, targets, p.where("p_size < 40").select(F.col("p_partkey").alias("target")))


@query
def migration_problems(spark: SparkSession, d: str) -> DataFrame:
    p, k = read(spark, d, "part"), F.col("p_partkey")
    op = F.when(k % 5 == 0, "renameSection").when(k % 5 == 1, "renameSetting").when(k % 5 == 2, "removeSetting").when(k % 5 == 3, "renameBlock").otherwise("move")
    lists = p.select(F.when(k % 11 != 0, F.expr("p_partkey div 2").cast("string")).alias("id"), op.alias("op"), F.when(k % 3 != 0, "a").alias("from"), F.lit("b").alias("to"), F.when(k % 4 != 0, "s").alias("setting"))
    return checks.migration_problems(lists).select(F.coalesce("id", F.lit("")).alias("id"), "problem")


@query
def snapshot_replace(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey")
    return checks.replace_snapshot(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 4 <> 0"), "o_orderkey")


@query
def invalidated(spark: SparkSession, d: str) -> DataFrame:
    return checks.invalidated(fk_edges(spark, d), _region(spark, d, 0)).select("node", long("depth").alias("depth"))


@query
def import_cycles(spark: SparkSession, d: str) -> DataFrame:
    return checks.cycle_members(_cycles(spark, d)[1])


@query
def versions_ascending(spark: SparkSession, d: str) -> DataFrame:
    version = F.concat_ws(".", F.col("p_size"), (F.col("p_partkey") % 13).cast("string"), F.lit("0"))
    found = checks.versions_ascending(read(spark, d, "part").select("p_brand", version.alias("version")), "p_brand", "version")
    return found.select("p_brand", F.array_join("versions", ",").alias("versions"))


@query
def linecol_to_offset(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents")
    return t.select("doc_id", long(X.offset_of(F.col("text"), F.lit(2), F.lit(5))).alias("pos"))


@query
def graphql_owners(spark: SparkSession, d: str) -> DataFrame:
    names = ["companies", "Company-Location", "productVariant", "cart", "orders", "", "shop", "Pages", "checkout"]
    k = read(spark, d, "region").limit(1).select(F.explode(F.array(*map(F.lit, names))).alias("name"))  # a fixed list of names
    return k.select("name", V.graphql_owner(F.col("name")).alias("owner"))


@query
def metafield_identity(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" product . "), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_brand")), F.lit("."), F.col("p_name"), F.when(F.col("p_partkey") % 5 == 0, ".more").otherwise(""))
    return read(spark, d, "part").select("p_partkey", V.metafield_identity(raw).alias("m")).select("p_partkey", "m.owner", "m.namespace", "m.key")


# -- names, edits, calls ------------------------------------------------------------------------------------------------

def _names(spark: SparkSession, d: str) -> tuple[DataFrame, Column, Column]:
    """Every part as a dependency: (rows, kind, name), with names of every fault."""
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    kind = F.when(k % 4 == 0, "snippet").when(k % 4 == 1, "section").when(k % 4 == 2, "section-group").otherwise("layout")
    name = F.when(k % 7 == 0, F.concat(F.lit(" "), n)).when(k % 7 == 1, F.concat(F.lit("../"), n)).when(k % 7 == 2, F.concat(F.lit("a/"), n)).when(k % 7 == 3, F.concat(n, F.lit(".LIQUID"))).when(k % 7 == 4, "none").otherwise(F.concat(F.lit("c-"), n))
    return read(spark, d, "part"), kind, name


@query
def dependency_names(spark: SparkSession, d: str) -> DataFrame:
    rows, kind, name = _names(spark, d)
    problem = P.dependency_name_problem(kind, name)
    return rows.select("p_partkey", problem.alias("problem"), F.when(problem.isNull(), P.dependency_path(kind, name)).alias("file"))


@query
def merchant_paths(spark: SparkSession, d: str) -> DataFrame:
    t = theme_path(spark, d)
    path = F.col("path")
    return t.select("page_id", P.is_merchant_data(path).alias("data"), P.is_storefront_locale(path).alias("locale"), P.is_merchant_owned(path).alias("owned"))


@query
def text_edits(spark: SparkSession, d: str) -> DataFrame:
    """Characters 10 to before 20 of every document replaced; a range of its own moves along."""
    t = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    at = F.col("doc_id") % 40
    start, end = X.moved_range(at, at + 5, F.lit(10), F.lit(20), F.lit(3))
    return t.select("doc_id", F.sha2(X.edited(F.col("text"), F.lit(10), F.lit(20), F.lit("new")), 256).alias("sha"), long(start).alias("start"), long(end).alias("end"))


@query
def template_literals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    value = F.concat(F.when(k % 3 == 0, '"').otherwise(""), F.col("p_brand"), F.when(k % 2 == 0, '""').otherwise(""), F.col("p_type"))
    return read(spark, d, "part").select("p_partkey", X.string_literal(value).alias("literal"))


@query
def render_calls(spark: SparkSession, d: str) -> DataFrame:
    k, lit = F.col("p_partkey"), F.lit
    size = X.call_argument(lit("size"), F.when(k % 5 != 0, F.col("p_size").cast("string")), lit("number"))
    title = X.call_argument(lit("title"), F.when(k % 5 != 0, F.concat(F.col("p_name"), lit("'s"))), lit("string"))
    data = X.call_argument(lit("part"), F.when(k % 2 == 1, lit("{}")), lit("object"))
    return read(spark, d, "part").select("p_partkey", X.render_call(F.col("p_brand"), F.array(size, title, data)).alias("call"))


#: Type expressions that the queries of bindings deal to parts, in turn.
_TYPES = ("string", "number.min(0).max(9)", "boolean.optional()", 'string.enum("a", "b")', "url.or(number)", "money", "array(Product)")


@query
def type_bindings(spark: SparkSession, d: str) -> DataFrame:
    expression = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("p_partkey") % len(_TYPES) + 1).cast("int"))
    rows = read(spark, d, "part").select("p_partkey", expression.alias("expression"))
    found = E.bindings(rows, "expression").select("expression", "binding", "optional", "checked", "control", F.array_join("options", ",").alias("options"))
    return rows.join(found, "expression").drop("expression")


# -- component checks ---------------------------------------------------------------------------------------------------

def _schemas(spark: SparkSession, d: str) -> DataFrame:
    """(path, source) for every part: sound schemas, broken JSON and every fault of shape, by turns."""
    k, quoted = F.col("p_partkey"), lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    setting = F.concat(F.lit('{"type": "range", "min": 1, "max": 9, "id": '), quoted("p_brand"), F.lit("}"))
    block = F.concat(F.lit('{"type": '), F.when(k % 2 == 0, F.lit('"@app"')).otherwise(F.lit('"card"')), F.lit(', "settings": [{"type": "radio", "options": [{"value": "x"}], "id": '), quoted("p_type"), F.lit("}]}"))
    sound = F.concat(F.lit('{"settings": [{"type": "header"}, '), setting, F.lit(', {"type": "checkbox", "id": "on", "label": "On"}], "blocks": ['), block, F.lit("]}"))
    faults = ("{", "[]", '{"settings": 1}', '{"settings": [{}, 2]}', '{"settings": [{"id": 3}]}', '{"blocks": {}}', '{"blocks": [4]}', '{"blocks": [{"type": 5}]}', '{"blocks": [{"settings": 6}]}', '{"blocks": [{}, {"settings": [{"id": null}]}]}')
    source = F.when(k % 21 >= 10, sound).otherwise(F.element_at(F.array(*map(F.lit, faults)), (F.least(k % 21, F.lit(9)) + 1).cast("int")))
    return read(spark, d, "part").select(k.cast("string").alias("path"), source.alias("source"))


@query
def schema_problems(spark: SparkSession, d: str) -> DataFrame:
    return contracts.schema_problems(contracts.parsed_schemas(_schemas(spark, d)))


@query
def schema_setting_reads(spark: SparkSession, d: str) -> DataFrame:
    reads = read(spark, d, "lineitem").join(read(spark, d, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("l_linenumber") % 3 == 0, F.col("p_brand")).when(F.col("l_linenumber") % 3 == 1, F.col("p_type")).otherwise("on")
    reads = reads.select(F.col("l_partkey").cast("string").alias("path"), F.when(F.col("l_linenumber") % 2 == 0, "section").otherwise("block").alias("object"), name.alias("name")).distinct()
    return contracts.unknown_setting_reads(contracts.parsed_schemas(_schemas(spark, d)), reads)


@query
def schema_controls(spark: SparkSession, d: str) -> DataFrame:
    sound = _schemas(spark, d).where("path % 21 >= 10")
    return contracts.schema_controls(sound).select("path", "name", "label", "kind", "least", "most")


@query
def setting_projections(spark: SparkSession, d: str) -> DataFrame:
    props = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_brand").alias("name"), (F.col("p_size") > 10).alias("setting"), F.when(F.col("p_partkey") % 3 != 0, "text").alias("input"))
    return contracts.setting_projections(props)


@query
def slot_placement(spark: SparkSession, d: str) -> DataFrame:
    """Orders as components, their lines as slots and, at odd numbers, as props."""
    kind = F.when(F.col("o_orderkey") % 3 == 0, "section").when(F.col("o_orderkey") % 3 == 1, "block").otherwise("snippet")
    components = read(spark, d, "orders").select(F.col("o_orderkey").alias("path"), kind.alias("kind"))
    x = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("at"), F.col("l_linenumber").cast("string").alias("name"), (F.col("l_quantity") > 25).alias("setting"))
    return contracts.placement(components, x.where("at % 2 = 1").select("path", "name", "setting"), x.select("path", "at"))


@query
def slot_blocks(spark: SparkSession, d: str) -> DataFrame:
    slots = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_partkey").cast("string").alias("name"))
    p = read(spark, d, "part").where("p_size > 5")
    return contracts.slot_problems(slots, p.select(F.col("p_partkey").cast("string").alias("name"), F.when(F.col("p_size") > 25, "block").otherwise("section").alias("kind")))


@query
def hoisting_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as render sites with two unfilled arguments each; the alias is one of three."""
    x = read(spark, d, "lineitem")
    alias = F.element_at(F.array(*map(F.lit, ("itemCard", "item", "item_card"))), (F.col("l_suppkey") % 3 + 1).cast("int"))
    arguments = F.array(F.struct(F.lit("title").alias("argument"), F.lit(0).alias("place")), F.struct(F.lit("size").alias("argument"), F.lit(1).alias("place")))
    rows = x.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("string").alias("site"), F.col("l_linenumber").alias("at"), alias.alias("alias"), F.explode(arguments).alias("a")).select("path", "site", "at", "alias", "a.*")
    own = read(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("path"), F.lit("item_size").alias("id"))
    return contracts.hoisting_conflicts(rows, own)


@query
def setting_headers(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("at"), F.when(F.col("l_quantity") > 25, "bigLot").otherwise("lot").alias("alias"), F.col("l_partkey").cast("string").alias("id"))
    return contracts.with_headers(x)


@query
def resolution_problems(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sites, lines as their targets and as bindings of the order's argument to a part."""
    sites = read(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").cast("string").alias("site"))
    x = read(spark, d, "lineitem")
    targets = x.select(F.col("l_orderkey").cast("string").alias("site"), F.col("l_linenumber").alias("at"), F.col("l_suppkey").alias("symbol"))
    bindings = x.select(F.col("l_orderkey").alias("path"), F.col("l_orderkey").cast("string").alias("site"), (F.col("l_linenumber") % 4).cast("string").alias("argument"), F.col("l_suppkey").alias("component"), F.col("l_partkey").alias("prop"))
    symbols = read(spark, d, "part").select(F.col("p_partkey").alias("symbol"), (F.col("p_partkey") % 10).alias("owner"), (F.col("p_size") > 10).alias("contract"))
    return contracts.resolution_problems(sites, targets, bindings, symbols)


@query
def default_problems(spark: SparkSession, d: str) -> DataFrame:
    values = F.array(*map(F.lit, ('"a"', "1.5", "-2e3", "true", "[]", "{}", "NaN", "")))
    value = F.when(F.col("p_partkey") % 9 < 8, F.element_at(values, (F.least(F.col("p_partkey") % 9, F.lit(7)) + 1).cast("int")))
    props = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_brand").alias("name"), (F.col("p_size") > 10).alias("has_default"), value.alias("value"))
    return contracts.default_problems(props)


@query
def region_references(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    inner = F.when(k % 3 == 0, F.concat(F.lit(" styles.c"), k, F.lit(" "))).when(k % 3 == 1, F.concat(F.lit("styles['card'] | append: props.p"), F.col("p_size"), F.lit(" | append: props.p"), F.col("p_size"))).otherwise("styles.x")
    return contracts.region_references(read(spark, d, "part").select(k.cast("string").alias("path"), (k % 3 != 2).alias("output"), inner.alias("inner")), ["styles"])
