"""The query catalogue on a small bookshop whose references are known."""

import json
import random

import pytest

from weft.plans.theme import Theme

FILES = {
    "assets/shelf.js": 'class Shelf extends HTMLElement {}\ncustomElements.define("book-shelf", Shelf);\ndocument.querySelector("[data-isbn]");\nwindow.addEventListener("shelf:turn", go);\nwindow.dispatchEvent(new CustomEvent("shelf:turn"));\n',
    "assets/print.css": ":root { --ink: black; }\n.spine[data-isbn] { color: var(--ink); }\n",
    "components/stamp.nz.liquid": "{% component snippet %}\n{% props { word: string } %}\n<i>{{ props.word }}</i>",
    "components/cover.nz.liquid": '{% component section %}\n{% import Stamp from "./stamp.nz.liquid" %}\n{% render Stamp { word: "New" } %}',
    "layout/book.liquid": "<html>{% sections 'top' %}{% render 'imprint' %}{{ content_for_layout }}</html>",
    "locales/it.json": '{"shop": {"open": "aperto", "days": [1, 2]}, "none": {}}',
    "sections/top.json": '{"sections": {"one": {"type": "banner"}}}',
    "sections/banner.liquid": "{{ section.settings.motto }}{% schema %}{\"settings\": [{\"id\": \"motto\", \"type\": \"text\"}], \"blocks\": [{\"type\": \"quote\"}]}{% endschema %}",
    "sections/reading.liquid": "{% for volume in collection.volumes %}{% render 'spine', volume: volume %}{% endfor %}{{ section.settings.absent }}",
    "sections/archive.liquid": "{% render which %}{% render 'lost' %}",
    "snippets/imprint.liquid": "<p>Printed by hand</p>",
    "snippets/spine.liquid": "<book-shelf class=\"spine\" data-isbn>{% render 'edition' %}{{ volume.metafields.press.year }}</book-shelf>",
    "snippets/edition.liquid": "{{ volume.edition }}",
    "templates/index.json": '{"sections": {"a": {"type": "reading"}, "b": {"type": "banner"}}}',
    "templates/page.liquid": "{% render 'imprint' %}",
}
TEMPLATES = [p for p in FILES if p.startswith("templates/")]


@pytest.fixture(scope="module")
def theme(spark):
    return Theme(spark.createDataFrame(list(FILES.items()), "path string, contents string").repartition(3))


def names(df, column="node"):
    return {r[0] for r in df.select(column).collect()}


def test_edges_and_statuses(theme):
    edges = {(r.src, r.dst, r.kind) for r in theme.render_edges.collect()}
    assert edges == {
        ("layout/book.liquid", "sections/top.json", "section-group"), ("layout/book.liquid", "snippets/imprint.liquid", "snippet"),
        ("sections/top.json", "sections/banner.liquid", "section"), ("sections/reading.liquid", "snippets/spine.liquid", "snippet"),
        ("snippets/spine.liquid", "snippets/edition.liquid", "snippet"), ("templates/index.json", "sections/reading.liquid", "section"),
        ("templates/index.json", "sections/banner.liquid", "section"), ("templates/page.liquid", "snippets/imprint.liquid", "snippet"),
        ("components/cover.nz.liquid", "components/stamp.nz.liquid", "component-render"),
    }
    assert theme.dependencies.count() == len(edges) + 1  # and the import
    status = {r.status: r["count"] for r in theme.resolutions.groupBy("status").count().collect()}
    assert status == {"resolved": 10, "missing": 1, "dynamic": 1}
    assert {r.cyclic for r in theme.sccs().collect()} == {False} and theme.sccs().count() == len(FILES)


def test_impact_pages_unused(theme):
    inner = "snippets/edition.liquid"
    assert names(theme.impact([inner])) == {inner, "snippets/spine.liquid", "sections/reading.liquid", "templates/index.json"}
    assert names(theme.affected_pages([inner])) == {"templates/index.json"}
    assert names(theme.affected_pages(["snippets/imprint.liquid"])) == {"templates/page.liquid"}
    unused = names(theme.unused_files(["layout/book.liquid", *TEMPLATES]))
    assert unused == {"assets/shelf.js", "assets/print.css", "components/cover.nz.liquid", "locales/it.json", "sections/archive.liquid"}
    assert names(theme.metafield_impact("volume", "press", "year")["pages"]) == {"templates/index.json"}
    report = theme.file_impact("sections/archive.liquid")
    assert report["usage"] == "unused" and report["certainty"] == "partial" and report["issues"] == ["REFERENCE_MISSING"]
    assert theme.render_tree(["templates/index.json"]).count() == 5


def test_records(theme):
    reads = theme.metafield_reads.collect()
    assert [(r.path, r.owner_type, r.namespace, r.key, r.dynamic) for r in reads] == [("snippets/spine.liquid", "volume", "press", "year", False)]
    classes = {r.path: r.classes for r in theme.file_classes().collect()}
    assert classes["snippets/spine.liquid"] == ["composed", "data-driven", "interactive"] and classes["snippets/imprint.liquid"] == ["static"]
    assert classes["sections/banner.liquid"] == ["configurable"]
    links = {(r.subject, r.name): (r.producers, r.consumers) for r in theme.behavior_connections().collect()}
    assert links["customElement", "book-shelf"] == (["assets/shelf.js"], ["snippets/spine.liquid"])
    assert links["attribute", "data-isbn"] == (["snippets/spine.liquid"], ["assets/print.css", "assets/shelf.js"])
    assert links["customEvent", "shelf:turn"] == (["assets/shelf.js"], ["assets/shelf.js"]) and links["customProperty", "--ink"] == (["assets/print.css"], ["assets/print.css"])
    assert {r.name for r in theme.declarations.where("kind = 'localeKey'").collect()} == {"shop.open", "shop.days"}
    assert {(r.path, r.code) for r in theme.issues.collect()} == {("sections/archive.liquid", "REFERENCE_MISSING"), ("sections/reading.liquid", "UNKNOWN_SETTING")}


def test_inspection(theme):
    report = theme.inspection()
    assert report["summary"] == {"unresolvedCount": 2, "brokenMetafieldReadCount": 1, "affectedPageCount": 0}
    assert len(report["nodes"]) == len(FILES) and len(report["edges"]) == 10
    assert theme.summary().first().files == len(FILES)
    with pytest.raises(ValueError):
        theme.behavior_usages("class", "x", "producer", hook="id")


def test_order_does_not_matter(spark, theme):
    rows = list(FILES.items())
    random.Random(1).shuffle(rows)
    assert Theme(spark.createDataFrame(rows, "path string, contents string")).inspection() == theme.inspection()


def test_cycle_data_flow(spark):
    files = {"snippets/a.liquid": "{% render 'b' %}", "snippets/b.liquid": "{% render 'a' %}{{ settings.color }}"}
    t = Theme(spark.createDataFrame(list(files.items()), "path string, contents string"))
    assert {(r.size, r.cyclic) for r in t.sccs().collect()} == {(2, True)}
    assert {(r.node, r.read) for r in t.scc_data_flow().collect()} == {(p, "settings.color") for p in files}


def test_extractors():
    from weft.sources import extract as E

    assert [f[0] for f in E.template_facts("{% if a %}{% render 'x' %}")] == ["issue"]
    reads = [(d["root"], d["path"], d["dynamic"], d["local"]) for k, _, _, d in E.template_facts("{% for p in list %}{{ p.title }}{% endfor %}{{ p['a b'].c[i] }}") if k == "template.read"]
    assert ("p", ["title"], False, True) in reads and ("p", ["a b", "c", "i"], True, False) in reads
    assert [d["name"] for k, _, _, d in E.template_facts("{% layout none %}") if k == "template.reference"] == ["none"]
    assert E.schema_of('{"blocks": [{"type": "x"}]}') == ([], [])
    query = 'query { product(id: 1) { metafield(namespace: "a", key: "b") { value } ...F } } fragment F on Product { m: metafield(namespace: "c", key: "d") { value } ...F }'
    assert [(x["owner"], x["namespace"], x["key"]) for x in E.graphql_metafields(query)] == [("product", "a", "b"), ("product", "c", "d")]
    assert json.loads(json.dumps(E.script_facts("fetch(url); el.dataset.fooBar; import('./x.js')")))


def test_graphql_owners():
    from weft.sources import extract as E

    query = """query { companies(first: 3) { nodes { metafield(namespace: "a", key: "b") { value } } }
      productVariant(id: 1) { metafield(namespace: "c", key: "d") { value } } cart { metafield(namespace: "e", key: "f") { value } } }"""
    assert [(x["owner"], x["key"]) for x in E.graphql_metafields(query)] == [("company", "b"), ("variant", "d"), ("", "f")]


def test_portable_model_and_lock(theme):
    model = theme.portable_model(["templates/index.json"])
    assert {r.route for r in model["routes"].collect()} == {"/", "/page"}
    assert model["components"].count() == 3 + 3 + 2 and model["assets"].count() == 2
    assert {tuple(r) for r in theme.schema_lock().collect()} == {("sections/banner.liquid", "setting", "motto", "text"), ("sections/banner.liquid", "block", "quote", "quote")}
