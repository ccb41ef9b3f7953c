"""Type expressions, contracts, hoisting, migrations of documents."""

import json

import pytest

from weft.functions import type_expressions as E
from weft.operators import rules


@pytest.mark.parametrize("source,kind", [
    ("string", {"kind": "string"}),
    ("url.required()", {"kind": "url"}),
    ("array(Product)", {"kind": "array", "element": {"kind": "object", "name": "Product"}}),
    ('url.or(string).optional().setting({ label: "Link" })', {"kind": "union", "members": [{"kind": "url"}, {"kind": "string"}, {"kind": "nil"}]}),
    ('number.min(0).max(100).step(5).unit("px")', {"kind": "number", "constraints": {"min": 0, "max": 100, "step": 5, "unit": "px"}}),
    ('string.enum("a", "b")', {"kind": "union", "members": [{"kind": "string-literal", "value": "a"}, {"kind": "string-literal", "value": "b"}]}),
])
def test_types(source, kind):
    found = E.parse(source)
    assert found["type"] == kind and found["errors"] == [] and found["required"] == ("required" in source)


def test_defaults_and_errors():
    assert E.parse('string.setting({ label: "Text", default: "Free" })') == {"type": {"kind": "string"}, "required": False, "errors": [], "setting": {"label": "Text", "default": "Free"}, "default": "Free"}
    for bad in ("number.min(1).default(0)", "string.min(1)", "string.nope()", "strin", "number.step(0)", "string(", "number.default('x')", "url(1)", ""):
        assert E.parse(bad)["errors"], bad
    assert E.setting_input(E.parse("number.min(0).max(9)")["type"]) == "range" and E.setting_input(E.parse("string.optional()")["type"]) == "text"


def test_assignability():
    s, u, n = {"kind": "string"}, {"kind": "url"}, {"kind": "nil"}
    lit = {"kind": "string-literal", "value": "x"}
    assert E.fits(lit, u) and not E.fits(u, s) and E.fits({"kind": "union", "members": [s, n]}, {"kind": "union", "members": [n, s, u]}) and not E.fits({"kind": "union", "members": [s, n]}, s)
    named, fielded = {"kind": "object", "name": "P"}, {"kind": "object", "fields": {"a": s}}
    assert E.fits(named, named) and not E.fits(named, {"kind": "object", "name": "Q"}) and E.fits(fielded, {"kind": "object"}) and not E.fits({"kind": "object"}, fielded)


def test_contracts(spark):
    text, number = json.dumps({"kind": "string"}), json.dumps({"kind": "number-literal", "value": 1})
    contracts = spark.createDataFrame([("card", "title", text, True, True), ("card", "size", text, False, False)], "component string, name string, type string, required boolean, setting boolean")
    sites = spark.createDataFrame([("a", "card"), ("b", "card")], "path string, component string")
    arguments = spark.createDataFrame([("a", "card", "size", number), ("b", "card", "title", text), ("b", "card", "other", text)], "path string, component string, name string, type string")
    got = {tuple(r) for r in rules.render_contract(sites, arguments, contracts).collect()}
    assert got == {("a", "ARGUMENT_MISSING", "title"), ("b", "ARGUMENT_UNKNOWN", "other"), ("a", "ARGUMENT_MISMATCH", "size")}
    renders = spark.createDataFrame([("a", "card"), ("b", "card"), ("page", "a"), ("a", "page")], "src string, dst string")
    assert {tuple(r) for r in rules.hoisted_settings(renders, contracts, arguments).collect()} == {("a", "card", "title"), ("page", "card", "title")}
    used = spark.createDataFrame([("f", "x"), ("f", "y")], "path string, name string")
    declared = spark.createDataFrame([("f", "y"), ("f", "z"), ("f", "z")], "path string, name string")
    assert {tuple(r) for r in rules.unused_and_unknown(declared, used, "REF").collect()} == {("f", "REF_UNKNOWN", "x"), ("f", "REF_UNUSED", "z")}
    assert [tuple(r) for r in rules.duplicates(declared, "REF").collect()] == [("f", "REF_DUPLICATE", "z")]
    files = spark.createDataFrame([("a",), ("a/b",), ("c/d",)], "path string")
    assert [tuple(r) for r in rules.path_conflicts(files).collect()] == [("a/b", "a")]


def test_documents(spark):
    steps = [{"op": "renameSection", "from": "old", "to": "new"}, {"op": "renameSetting", "section": "new", "from": "a", "to": "b"}, {"op": "renameSetting", "section": None, "from": "g", "to": "h"}, {"op": "renameBlock", "from": "x", "to": "y"}]
    doc = {"current": {"g": 1, "sections": {"s": {"type": "old", "settings": {"a": 1}, "blocks": {"q": {"type": "x"}}}}}}
    files = spark.createDataFrame([("one", json.dumps(doc)), ("two", "{}")], "path string, contents string")
    got = {r.path: (json.loads(r.contents), r.changed) for r in rules.migrate_documents(files, steps).collect()}
    assert got["one"] == ({"current": {"h": 1, "sections": {"s": {"type": "new", "settings": {"b": 1}, "blocks": {"q": {"type": "y"}}}}}}, True) and got["two"] == ({}, False)
    side = lambda d: spark.createDataFrame([("l", json.dumps(d))], "path string, contents string")
    merged = rules.merge_leaf_documents(side({"hello": "x", "gone": "1"}), side({"hello": "source", "dev": "new"}), side({"hello": "merchant", "gone": "1"}))
    assert {(r.key, r.value, r.conflict) for r in merged.collect()} == {("hello", '"merchant"', True), ("dev", '"new"', False)}
