"""Checks of components on small cases: schemas, controls, bindings, edits, calls, slots, defaults."""

import random

import pytest
from pyspark.sql import functions as F

from weft import session
from weft.functions import paths as P
from weft.functions import text as X
from weft.functions import type_expressions as E
from weft.operators import contracts


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("kind,name,problem", [
    ("layout", "none", None), ("snippet", "none", None), ("snippet", "", 0), ("snippet", " a", 0), ("snippet", "a\n", 0), ("snippet", "/a", 1), ("snippet", "a..b", 1),
    ("section", "a/b", 2), ("section", "a\\b", 2), ("section", "a.JSON", 3), ("section", "a.liquid.x", None),
])
def test_dependency_names(spark, kind, name, problem):
    assert value(spark, P.dependency_name_problem(F.lit(kind), F.lit(name))) == (None if problem is None else P.NAME_REASONS[problem])


def test_edits(spark):
    assert value(spark, X.edited(F.lit("abcdef"), F.lit(2), F.lit(4), F.lit("XYZ"))) == "abXYZef"
    assert value(spark, X.edited(F.lit(""), F.lit(0), F.lit(0), F.lit("n"))) == "n"
    for (start, end), want in (((0, 2), (0, 2)), ((4, 6), (5, 7)), ((1, 3), (1, 5)), ((3, 9), (2, 10)), ((2, 4), (2, 5))):
        got = X.moved_range(F.lit(start), F.lit(end), F.lit(2), F.lit(4), F.lit(3))
        assert (value(spark, got[0]), value(spark, got[1])) == want


def test_literals_and_calls(spark):
    assert value(spark, X.string_literal(F.lit('a"b"'))) == "\"a\" | append: '\"' | append: \"b\" | append: '\"'"
    assert value(spark, X.string_literal(F.lit(""))) == '""'
    arguments = [X.call_argument(F.lit("n"), F.lit("1"), F.lit("number")), X.call_argument(F.lit("s"), F.lit("it's"), F.lit("string")), X.call_argument(F.lit("gone"), F.lit(None).cast("string"), F.lit("string"))]
    assert value(spark, X.render_call(F.lit("card"), F.array(*arguments))) == "{% render 'card', n: 1, s: 'it\\'s' %}"
    long = value(spark, X.render_call(F.lit("card"), F.array(F.lit("a: '" + "x" * 60 + "'"), F.lit("b: 1"))))
    assert long == "{% render 'card',\n  a: '" + "x" * 60 + "',\n  b: 1\n%}"


@pytest.mark.parametrize("source,binding,control", [
    ("string", ("string", False, True), {"kind": "text"}),
    ("number.optional()", ("number", True, True), {"kind": "number"}),
    ('string.enum("a", "b").optional()', ("string", True, True), {"kind": "select", "options": ["a", "b"]}),
    ("url.or(color)", ("string", False, True), {"kind": "text"}),
    ("url.or(boolean)", ("string", False, False), {"kind": "text"}),
    ("array(string)", ("string", False, False), {"kind": "text"}),
    ("number.min(1).max(5)", ("number", False, True), {"kind": "number", "range": {"min": 1, "max": 5}}),
])
def test_bindings(source, binding, control):
    kind = E.parse(source)["type"]
    assert E.data_binding(kind) == binding and E.control(kind) == control
    assert E.data_binding(None) == ("string", False, False)


def test_schemas(spark):
    source = '{"settings": [{"id": "a", "type": "radio", "options": [{"value": "x"}, {}, {"value": "y"}]}, {"type": "paragraph", "id": "p"}], "blocks": [{"type": "card", "settings": [{"id": "b"}]}]}'
    schemas = spark.createDataFrame([("s", source), ("bad", "{"), ("nan", '{"settings": NaN}'), ("none", None), ("empty", "{}"), ("deep", "[" * 100_000)], "path string, source string")
    parsed = contracts.parsed_schemas(schemas)
    assert rows(contracts.schema_problems(parsed)) == [("bad", "SCHEMA_INVALID_JSON", "invalid JSON"), ("deep", "SCHEMA_INVALID_JSON", "invalid JSON"), ("nan", "SCHEMA_INVALID_JSON", "invalid JSON")]
    reads = spark.createDataFrame([("s", "section", "a"), ("s", "section", "b"), ("s", "block", "b"), ("s", "block", "c"), ("empty", "block", "x"), ("empty", "section", "x"), ("bad", "section", "x")], "path string, object string, name string")
    assert rows(contracts.unknown_setting_reads(parsed, reads)) == [("empty", "SETTING_READ_UNKNOWN", "x"), ("s", "SETTING_READ_UNKNOWN", "b"), ("s", "SETTING_READ_UNKNOWN", "c")]
    assert rows(contracts.schema_controls(schemas.where("path = 's'"))) == [("s", "a", "a", "select", ["x", "y"], None, None, None)]


def test_hoisting(spark):
    unfilled = spark.createDataFrame([("f", "1", 1, "aCard", "t", 0), ("f", "2", 2, "aCard", "t", 0), ("f", "3", 3, "a_card", "t", 0), ("f", "4", 4, "b", "t", 0), ("f", "4", 4, "b", "t", 0)], "path string, site string, at int, alias string, argument string, place int")
    own = spark.createDataFrame([("f", "b_t")], "path string, id string")
    assert rows(contracts.hoisting_conflicts(unfilled, own)) == [("f", "HOISTED_ALIAS_REUSED", "2"), ("f", "HOISTED_SETTING_COLLISION", "a_card_t"), ("f", "HOISTED_SETTING_COLLISION", "b_t")]
    settings = spark.createDataFrame([("f", 1, "aCard", "x"), ("f", 2, "aCard", "y"), ("f", 3, "b", "z"), ("f", 4, "aCard", "w")], "path string, at int, alias string, id string")
    got = [tuple(r) for r in contracts.with_headers(settings).orderBy("path", "at", "part").select("content").collect()]
    assert got == [("A card",), ("x",), ("y",), ("B",), ("z",), ("A card",), ("w",)]


def test_regions(spark):
    regions = spark.createDataFrame([("a", True, " styles.x "), ("b", True, "styles.x | append: props.y"), ("c", False, 'styles["k-b"] mystyles.z'), ("d", True, 'styles["k"]'), ("e", True, ""), ("f", False, None)], "path string, output boolean, inner string")
    assert rows(contracts.region_references(regions, ["styles"])) == [
        ("a", "style", "styles", "x", "bare-class", 1), ("b", "prop", "props", "y", "identifier", 1), ("b", "style", "styles", "x", "quoted-class", 1),
        ("c", "style", "styles", "k-b", "quoted-class", 1), ("d", "style", "styles", "k", "bare-class", 1),
    ]


def test_defaults_and_slots(spark):
    props = spark.createDataFrame([("f", "a", True, '"x"'), ("f", "b", True, "[]"), ("f", "c", True, None), ("f", "d", False, "1"), ("f", "e", False, None)], "path string, name string, has_default boolean, value string")
    assert [r[2] for r in rows(contracts.default_problems(props))] == ["b", "c", "d"]
    components = spark.createDataFrame([("s", "section"), ("n", "snippet")], "path string, kind string")
    slots = spark.createDataFrame([("s", 5), ("s", 9), ("n", 1)], "path string, at int")
    plain = spark.createDataFrame([("s", "p", False), ("n", "p", False), ("s", "q", True)], "path string, name string, setting boolean")
    assert rows(contracts.placement(components, plain, slots)) == [("n", "SLOT_OUTSIDE_SECTION", "1"), ("s", "PROP_WITHOUT_SETTING", "p"), ("s", "SLOT_REPEATED", "9")]


def test_slots_are_dealt_by_rows(spark, monkeypatch):
    """A task gets about the stated rows, though Spark would make one partition of them; repeats, null names and null kinds count as before."""
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    components = spark.createDataFrame([("b", "block"), ("b", "section"), ("s", "section"), ("k", None), ("k", None), *[(f"n{i}", "section") for i in range(300)]], "name string, kind string")
    slots = spark.range(1200).select(F.concat(F.lit("f"), F.col("id") % 600).alias("path"), F.concat(F.lit("n"), F.col("id") % 600).alias("name"))
    odd = spark.createDataFrame([("f", n) for n in ("b", "s", "s", "k", "gone", None)], "path string, name string")
    got = contracts.slot_problems(slots.unionByName(odd), components).withColumn("part", F.spark_partition_id()).collect()
    known, unknown = "SLOT_NOT_A_BLOCK", "SLOT_BLOCK_UNKNOWN"
    want = [(f"f{i}", known if i < 300 else unknown, f"n{i}") for i in range(600)] + [("f", known, "s"), ("f", unknown, "k"), ("f", unknown, "gone"), ("f", unknown, None)]
    assert sorted(map(repr, ((r.path, r.code, r.name) for r in got))) == sorted(map(repr, want))
    parts = [r.part for r in got]
    assert len(set(parts)) >= 12 and max(map(parts.count, set(parts))) <= 100


def test_hoisting_in_one_pass(spark, monkeypatch):
    """Random sites against the definition, with nulls and repeats; rows are dealt once, by the stated number."""
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    pick = random.Random(4)
    arguments = [(f"f{pick.randrange(40)}" if pick.random() > 0.02 else None, pick.choice(["1", "2", "3", None]), pick.choice([1, 2, 3, None]), pick.choice(["aCard", "a_card", "a", None]), pick.choice(["t", "card_t", "s", None]), pick.choice([0, 1, None])) for _ in range(1500)]
    own_ids = [(f"f{pick.randrange(40)}", pick.choice(["a_t", "a_card_t", None])) for _ in range(30)] + [(None, "a_t")]
    nulls_first = lambda *xs: tuple((x is not None, x if x is not None else 0) for x in xs)
    want = []
    for path in {a[0] for a in arguments} - {None}:
        first, reused, named = {}, set(), {}
        for _, site, at, alias, _, _ in (a for a in arguments if a[0] == path and a[3]):
            first[alias] = min(first.get(alias, (nulls_first(at, site), site)), (nulls_first(at, site), site), key=lambda x: x[0])
        for _, site, at, alias, argument, place in (a for a in arguments if a[0] == path and a[3]):
            if site is None or first[alias][1] is None:
                continue
            if site != first[alias][1]:
                reused.add((site, alias))
            elif argument:
                named.setdefault({"aCard": "a_card"}.get(alias, alias) + "_" + argument, set()).add((nulls_first(at, place, alias)))
        want += [(path, "HOISTED_ALIAS_REUSED", site) for site, _ in reused]
        for name, places in named.items():
            want += [(path, "HOISTED_SETTING_COLLISION", name)] * (len(places) - ((path, name) not in own_ids))
    unfilled = spark.createDataFrame(arguments, "path string, site string, at int, alias string, argument string, place int")
    found = contracts.hoisting_conflicts(unfilled, spark.createDataFrame(own_ids, "path string, id string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == sorted(want, key=repr) and {c for _, c, _ in want} == {"HOISTED_ALIAS_REUSED", "HOISTED_SETTING_COLLISION"}
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "hashpartitioning(path" in plan
