"""The query catalogue over a source tree: files to facts, facts to references, references to a dependency graph.

Extraction runs once per file in ``mapInPandas`` and is written to the shared folder; everything after it is DataFrame
operations. Role names: a component file has role ``component``; the render and import kinds of components are
``component-render`` and ``component-import``.
"""

from __future__ import annotations

import json
from functools import cached_property

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import paths as P
from weft.operators import graph, relate
from weft.session import materialize
from weft.sources import extract

cloudpickle.register_pickle_by_value(extract)

#: Kinds of reference that are render edges.
RENDER_KINDS = ("snippet", "section", "section-group", "layout", "component-render")
TARGET_ROLE = {"snippet": "snippet", "section": "section", "section-group": "sectionGroup", "layout": "layout"}
PRODUCERS = ("emits", "defines", "dispatches")


def read_files(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """(path, contents) of a source tree, without ignored folders; only theme inputs, assets that are not source are empty."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("full"), F.col("value").alias("contents"))
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace("full", rf"^.*?{base}/", "")
    rows = files.select(path.alias("path"), "contents").where(~F.col("path").rlike(r"(?:^|/)(?:node_modules|\.git|dist)/"))
    source = (P.classify(F.col("path")) != "other") & (P.classify(F.col("path")) != "asset") | F.col("path").rlike(r"\.(?:css|js|ts)$")
    rows = rows.where(source | F.col("path").startswith("assets/")).select("path", F.when(source, F.col("contents")).otherwise("").alias("contents"))
    return rows.where(~P.glob_match(F.col("path"), exclude)) if exclude else rows


class Theme:
    """All queries of one revision of a source tree. files: (path, contents)."""

    def __init__(self, files: DataFrame, metafield_definitions: DataFrame | None = None):
        self.spark = files.sparkSession
        self.files = files.select("path", F.coalesce("contents", F.lit("")).alias("contents"))
        self.definitions = metafield_definitions

    # -- facts ----------------------------------------------------------------------------------------------------------

    @cached_property
    def facts(self) -> DataFrame:
        def run(frames):
            for frame in frames:
                rows = [(p, k, n, s, e, json.dumps(d, sort_keys=True)) for p, c in zip(frame["path"], frame["contents"]) for n, (k, s, e, d) in enumerate(extract.file_facts(p, c))]
                yield pd.DataFrame(rows, columns=["path", "kind", "nth", "start", "end", "data"])

        rows = self.files.mapInPandas(run, "path string, kind string, nth int, start long, end long, data string")
        return materialize(rows, "facts")

    def _of(self, kind: str, *fields: str) -> DataFrame:
        return self.facts.where(F.col("kind") == kind).select("path", "nth", "start", *[F.get_json_object("data", f"$.{f}").alias(f) for f in fields])

    @cached_property
    def roles(self) -> DataFrame:
        return self.files.select("path", P.classify(F.col("path")).alias("role"), P.resource_name(F.col("path")).alias("name"))

    @cached_property
    def references(self) -> DataFrame:
        """(ref, owner, kind, target_role, target_name, target_path, static)."""
        named = self._of("template.reference", "kind", "name")
        role = F.create_map(*[F.lit(x) for pair in TARGET_ROLE.items() for x in pair])
        a = named.select("path", "nth", F.col("kind"), role[F.col("kind")].alias("target_role"), F.col("name").alias("target_name"), F.lit(None).cast("string").alias("target_path"), F.col("name").isNotNull().alias("static"))
        imports = self._of("component.import", "local", "specifier").withColumn("target_path", P.resolve_import(F.col("path"), F.col("specifier")))
        null = F.lit(None).cast("string")
        b = imports.select("path", "nth", F.lit("component-import").alias("kind"), null.alias("target_role"), null.alias("target_name"), "target_path", F.lit(True).alias("static"))
        renders = self._of("component.render", "local").join(imports.select("path", "local", "target_path"), ["path", "local"], "left")
        c = renders.select("path", "nth", F.lit("component-render").alias("kind"), null.alias("target_role"), null.alias("target_name"), "target_path", F.col("target_path").isNotNull().alias("static"))
        modules = self._of("script.import", "specifier").withColumn("target_path", P.local_module_path(F.col("path"), F.col("specifier"))).where("target_path is not null")
        d = modules.select("path", "nth", F.lit("javascript-import").alias("kind"), null.alias("target_role"), null.alias("target_name"), "target_path", F.lit(True).alias("static"))
        return a.unionByName(b).unionByName(c).unionByName(d).select(F.concat_ws("#", "path", "nth").alias("ref"), F.col("path").alias("owner"), "kind", "target_role", "target_name", "target_path", "static")

    @cached_property
    def declarations(self) -> DataFrame:
        """(owner, kind, name): component kinds and locale keys."""
        own = self._of("component.kind", "kind").select(F.col("path").alias("owner"), F.lit("component").alias("what"), F.coalesce("kind", P.resource_name(F.col("path"))).alias("name"))
        keys = self._of("declaration.locale", "name").select(F.col("path").alias("owner"), F.lit("localeKey").alias("what"), "name")
        return own.unionByName(keys).withColumnRenamed("what", "kind")

    @cached_property
    def resolutions(self) -> DataFrame:
        """(ref, owner, kind, status, n_targets, targets)."""
        refs = self.references
        carry = ("owner", "kind")
        symbols = self.roles.select(F.col("role").alias("target_role"), F.col("name").alias("target_name"), "path")
        by_name = relate.resolve_references(refs.where("target_path is null"), symbols, ["target_role", "target_name"], "ref", "path", F.col("static"), carry)
        paths = self.files.select(F.col("path").alias("target_path"), "path")
        by_path = relate.resolve_references(refs.where("target_path is not null"), paths, ["target_path"], "ref", "path", F.col("static"), carry)
        return materialize(by_name.unionByName(by_path), "resolutions")

    @cached_property
    def dependencies(self) -> DataFrame:
        return relate.dependency_records(self.resolutions, "ref", "owner", "kind").withColumnRenamed("ref", "id")

    @cached_property
    def render_edges(self) -> DataFrame:
        return self.dependencies.where(F.col("kind").isin(*RENDER_KINDS))

    @cached_property
    def behaviors(self) -> DataFrame:
        found = self._of("behavior", "subject", "name", "role").select("path", "start", "subject", "name", F.col("role").alias("hook"))
        return found.withColumn("role", F.when(F.col("hook").isin(*PRODUCERS), "producer").otherwise("consumer"))

    @cached_property
    def metafield_reads(self) -> DataFrame:
        found = self._of("template.metafield", "owner", "namespace", "key", "dynamic")
        return found.select("path", "start", F.col("owner").alias("owner_type"), "namespace", "key", (F.col("dynamic") == "true").alias("dynamic"))

    @cached_property
    def evidence(self) -> DataFrame:
        """(path, kind): one row per piece of evidence."""
        one = lambda df, kind: df.select("path", F.lit(kind).alias("kind"))
        refs = self.resolutions.withColumnRenamed("owner", "path")
        parts = [
            one(self.roles, "role"), one(self.facts.where("kind in ('schema.setting', 'schema.block')").select("path").distinct(), "schema"),
            one(self.metafield_reads, "metafield-read"), one(self.behaviors, "behavior"),
            one(refs.where(F.col("kind").isin(*RENDER_KINDS) & (F.col("status") != "dynamic")).select("path"), "render-reference"), one(refs.where("status = 'dynamic'").select("path"), "dynamic-reference"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def uncertainty(self) -> DataFrame:
        return self._of("uncertain", "code", "text").select("path", "code", F.col("text").alias("message"))

    @cached_property
    def issues(self) -> DataFrame:
        """(path, severity, code, message): syntax problems, missing references, unknown settings, unbroken rules left out."""
        syntax = self._of("issue", "code", "message").select("path", F.lit("error").alias("severity"), "code", "message")
        missing = self.resolutions.where("status = 'missing'").select(F.col("owner").alias("path"), F.lit("error").alias("severity"), F.lit("REFERENCE_MISSING").alias("code"), F.col("kind").alias("message"))
        ambiguous = self.resolutions.where("status = 'ambiguous'").select(F.col("owner").alias("path"), F.lit("warning").alias("severity"), F.lit("REFERENCE_AMBIGUOUS").alias("code"), F.col("kind").alias("message"))
        reads = self._of("template.setting", "object", "name").where("object in ('section', 'block')").select("path", "name")
        unknown = relate.unknown_reads(reads, self._of("schema.setting", "id").select("path", F.col("id").alias("name")), ["path", "name"])
        settings = unknown.select("path", F.lit("warning").alias("severity"), F.lit("UNKNOWN_SETTING").alias("code"), F.col("name").alias("message"))
        return syntax.unionByName(missing).unionByName(ambiguous).unionByName(settings)

    # -- queries --------------------------------------------------------------------------------------------------------

    def _edges(self) -> DataFrame:
        return self.dependencies.select("src", "dst", "id")

    def _nodes(self, paths: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(p,) for p in paths], "node string")

    def project_model(self) -> dict[str, DataFrame]:
        return {"declarations": self.declarations, "references": self.resolutions, "classifications": self.file_classes(), "evidence": self.evidence, "uncertainty": self.uncertainty}

    def project_graph(self) -> dict[str, DataFrame]:
        return {"nodes": self.roles, "edges": self.render_edges, "sccs": self.sccs()}

    def sccs(self) -> DataFrame:
        return graph.sccs(self.files.select(F.col("path").alias("node")), self.render_edges)

    def scc_data_flow(self) -> DataFrame:
        reads = self._of("template.setting", "object", "name").select(F.col("path").alias("node"), F.concat_ws(".", "object", "name").alias("read"))
        return graph.scc_data_flow(self.sccs(), reads)

    def dependency_index(self, target: str | None = None) -> DataFrame:
        return relate.filtered(self.dependencies, dst=target)

    def impact(self, changed: list[str]) -> DataFrame:
        return graph.impact_reasons(self._edges(), self._nodes(changed))

    def affected_pages(self, changed: list[str]) -> DataFrame:
        pages = self.roles.where(F.col("role").isin(*P.PAGE_ROLES)).select(F.col("path").alias("node"))
        return graph.impact(self._edges(), self._nodes(changed)).join(pages, "node", "left_semi").select("node")

    def unused_files(self, roots: list[str]) -> DataFrame:
        return graph.unused(self.files.select(F.col("path").alias("node")), self._edges(), self._nodes(roots))

    def render_tree(self, roots: list[str]) -> DataFrame:
        seeds = self.spark.createDataFrame([(p, p) for p in roots], "root string, node string")
        return graph.closure(self.render_edges, seeds, keys=("root",))

    def behavior_index(self, kind: str | None = None) -> dict[str, DataFrame]:
        records = relate.filtered(self.behaviors, subject=kind)
        return {"records": records, "evidence": relate.evidence_for_owners(self.evidence, records, "path", "behavior")}

    def behavior_usages(self, subject: str, name: str, role: str, hook: str | None = None) -> DataFrame:
        if (subject == "domHook") != (hook is not None):
            raise ValueError("a hook kind is given for domHook, and only there")
        return relate.filtered(self.behaviors, subject=hook if subject == "domHook" else subject, name=name, role=role)

    def behavior_connections(self, path: str | None = None) -> DataFrame:
        found = relate.connections(self.behaviors, ["subject", "name"], "path", F.col("role"))
        return found if path is None else found.where(F.array_contains("producers", path) | F.array_contains("consumers", path))

    def metafield_index(self, owner_type: str | None = None, namespace: str | None = None) -> dict[str, DataFrame]:
        records = relate.filtered(self.metafield_reads, owner_type=owner_type, namespace=namespace)
        return {"records": records, "evidence": relate.evidence_for_owners(self.evidence, records, "path", "metafield-read")}

    def metafield_impact(self, owner_type: str, namespace: str, key: str) -> dict[str, DataFrame]:
        sources = relate.filtered(self.metafield_reads, owner_type=owner_type, namespace=namespace, key=key).select(F.col("path").alias("node")).distinct()
        pages = self.roles.where(F.col("role").isin(*P.PAGE_ROLES)).select(F.col("path").alias("node"))
        return {"sources": sources, "pages": graph.impact(self._edges(), sources).join(pages, "node", "left_semi").select("node")}

    def file_classes(self) -> DataFrame:
        return relate.file_classes(self.files, self.evidence, "path")

    def file_impact(self, path: str) -> dict:
        """Report of one file: usage, certainty, dependencies, dependents, pages, issues."""
        here = F.lit(path)
        out = {
            "path": path,
            "dependencies": sorted(r.dst for r in self.dependencies.where(F.col("src") == here).collect()),
            "dependents": sorted(r.src for r in self.dependencies.where(F.col("dst") == here).collect()),
            "affectedPages": sorted(r.node for r in self.affected_pages([path]).collect()),
            "uncertainty": [r.code for r in self.uncertainty.where(F.col("path") == here).collect()],
            "issues": [r.code for r in self.issues.where(F.col("path") == here).collect()],
        }
        return out | {"usage": "used" if out["dependents"] or out["affectedPages"] else "unused", "certainty": "partial" if out["uncertainty"] else "complete"}

    def node(self, path: str) -> DataFrame:
        return self.roles.where(F.col("path") == path)

    def render_occurrences(self, path: str) -> DataFrame:
        return self.render_edges.where(F.col("dst") == path)

    def unresolved(self) -> DataFrame:
        """Static references without a render edge: a resolved import counts too."""
        return self.resolutions.where("status <> 'dynamic'").join(self.render_edges.select(F.col("id").alias("ref")), "ref", "left_anti")

    def broken_metafield_reads(self) -> DataFrame:
        known = self.definitions if self.definitions is not None else self.spark.createDataFrame([], "owner_type string, namespace string, key string")
        return self.metafield_reads.where(~F.col("dynamic")).join(known, ["owner_type", "namespace", "key"], "left_anti")

    def summary(self) -> DataFrame:
        count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        parts = [count(self.files, "files"), count(self.declarations, "declarations"), count(self.references, "references"), count(self.evidence, "evidence"), count(self.uncertainty, "uncertainty")]
        out = parts[0]
        for p in parts[1:]:
            out = out.join(p)  # one row each
        return out

    def inspection(self) -> dict:
        """The stable report: nodes, edges, issues, uncertainty and counts. It is a document for one reader, so it is collected."""
        return {
            "version": 1,
            "nodes": sorted((r.path, r.kind) for r in self.files.select("path", P.file_kind(F.col("path")).alias("kind")).collect()),
            "edges": sorted((r.src, r.dst, r.kind) for r in self.dependencies.collect()),
            "issues": sorted((r.path, r.code) for r in self.issues.collect()),
            "uncertainty": sorted({r.message for r in self.uncertainty.select("message").distinct().collect()}),
            "summary": {"unresolvedCount": self.unresolved().count(), "brokenMetafieldReadCount": self.broken_metafield_reads().count(), "affectedPageCount": 0},
        }

    def portable_model(self, roots: list[str]) -> dict[str, DataFrame]:
        """Components, render trees, routes, contracts, data requirements and assets of an application."""
        roles = self.roles
        return {
            "components": roles.where(F.col("role").isin("section", "snippet", "themeBlock", "component")).select("path", "name", "role"),
            "renderTrees": self.render_tree(roots),
            "routes": roles.where(F.col("role").isin(*P.PAGE_ROLES)).select("path", P.template_route(F.col("path")).alias("route")),
            "contracts": self._of("schema.setting", "id", "type").select("path", "id", "type"),
            "dataRequirements": self.metafield_reads.select("path", "owner_type", "namespace", "key", "dynamic"),
            "assets": roles.where("role = 'asset'").select("path"),
        }

    def schema_lock(self) -> DataFrame:
        """(section, kind, id, type): what merchants' data may refer to; input of schema_drift and apply_migrations."""
        sections = self.roles.where("role = 'section'").select("path")
        settings = self._of("schema.setting", "id", "type").select("path", F.lit("setting").alias("kind"), "id", "type")
        blocks = self._of("schema.block", "type").select("path", F.lit("block").alias("kind"), F.col("type").alias("id"), "type")
        return settings.unionByName(blocks).join(sections, "path", "left_semi").withColumnRenamed("path", "section")

    def to_dot(self) -> str:
        return "digraph theme {\n" + "".join(f'  "{r.src}" -> "{r.dst}" [label="{r.kind}"];\n' for r in self.dependencies.orderBy("src", "dst").collect()) + "}\n"
