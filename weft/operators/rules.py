"""Constraint operators that give diagnostics (path, code, name), as joins over fact tables.

Tables: contracts (component, name, type, required); arguments (path, component, name, type) of render sites, sites
(path, component); declared and used names are (path, name).
"""

from __future__ import annotations

import json
from copy import deepcopy

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.type_expressions import compatible
from weft.operators.reconcile import merge3
from weft.session import materialize


def diagnostic(rows: DataFrame, code: str, name: str = "name") -> DataFrame:
    return rows.select("path", F.lit(code).alias("code"), F.col(name).alias("name"))


def unused_and_unknown(declared: DataFrame, used: DataFrame, what: str, report_unused: bool = True) -> DataFrame:
    """Names used and not declared in a file, and declared and not used: style classes, refs, data bindings, islands, slots, props."""
    unknown = diagnostic(used.select("path", "name").distinct().join(declared, ["path", "name"], "left_anti"), f"{what}_UNKNOWN")
    if not report_unused:
        return unknown
    return unknown.unionByName(diagnostic(declared.select("path", "name").distinct().join(used, ["path", "name"], "left_anti"), f"{what}_UNUSED"))


def duplicates(declared: DataFrame, what: str) -> DataFrame:
    """Names that a file declares more than once."""
    return diagnostic(declared.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{what}_DUPLICATE")


def import_collisions(imports: DataFrame) -> DataFrame:
    """Base names that a file imports from several paths. imports: (path, name, target)."""
    return diagnostic(imports.groupBy("path", "name").agg(F.count_distinct("target").alias("n")).where("n > 1"), "IMPORT_COLLISION")


def render_contract(sites: DataFrame, arguments: DataFrame, contracts: DataFrame) -> DataFrame:
    """Render sites against contracts: required arguments that are missing, arguments that are unknown, types that do not fit."""
    needed = sites.join(contracts.where("required").select("component", "name"), "component")
    missing = diagnostic(needed.join(arguments.select("path", "component", "name"), ["path", "component", "name"], "left_anti"), "ARGUMENT_MISSING")
    known = contracts.select("component").distinct()
    given = arguments.join(known, "component", "left_semi")
    unknown = diagnostic(given.join(contracts.select("component", "name"), ["component", "name"], "left_anti"), "ARGUMENT_UNKNOWN")
    typed = given.select("path", "component", "name", F.col("type").alias("given")).join(contracts.select("component", "name", F.col("type").alias("wanted")), ["component", "name"])
    verdicts = compatible(typed, "given", "wanted")
    return missing.unionByName(unknown).unionByName(diagnostic(typed.join(verdicts, ["given", "wanted"]).where("not fits"), "ARGUMENT_MISMATCH"))


def hoisted_settings(renders: DataFrame, contracts: DataFrame, arguments: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(component, origin, name) of settings that bubble up: what a rendered component needs and no render site fills.

    renders: (src, dst, alias) component to component. A setting rises one level a round until somebody fills it or nobody
    renders the component; on a cycle it stops where it has been.
    """
    filled = arguments.select(F.col("path").alias("src"), F.col("component").alias("dst"), "name")
    level = contracts.where("setting").select(F.col("component").alias("dst"), F.col("component").alias("origin"), "name")
    found = None
    for _ in range(max_rounds):
        up = renders.select("src", "dst").join(level, "dst").join(filled, ["src", "dst", "name"], "left_anti")
        up = up.select(F.col("src").alias("dst"), "origin", "name").distinct()
        up = materialize(up if found is None else up.join(found, ["dst", "origin", "name"], "left_anti"), "hoisted")
        if up.isEmpty():
            break
        found = up if found is None else found.unionByName(up)
        level = up
    empty = level.limit(0) if found is None else found
    return empty.select(F.col("dst").alias("component"), "origin", "name")


def path_conflicts(files: DataFrame) -> DataFrame:
    """(path, parent): a path that another path uses as a folder."""
    parents = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("parent"))
    return parents.where("parent <> path").join(files.select(F.col("path").alias("parent")).distinct(), "parent", "left_semi").select("path", "parent")


def migrate_document(text: str, migrations: list[dict]) -> str:
    """One merchant document after the migrations: current settings, presets and section instances; later steps see earlier ones."""
    root = json.loads(text)
    before = deepcopy(root)
    holders = [root.get("current"), *(root["presets"].values() if isinstance(root.get("presets"), dict) else ()), root]
    for holder in (h for h in holders if isinstance(h, dict)):
        for m in migrations if holder is not root else ():
            if m.get("section", 0) is None and m["op"] == "renameSetting" and m["from"] in holder:
                holder[m["to"]] = holder.pop(m["from"])
            elif m.get("section", 0) is None and m["op"] == "removeSetting":
                holder.pop(m["setting"], None)
        sections = holder.get("sections")
        for instance in (s for s in (sections.values() if isinstance(sections, dict) else ()) if isinstance(s, dict)):
            for m in migrations:
                settings = instance.get("settings")
                if m["op"] == "renameSection" and instance.get("type") == m["from"]:
                    instance["type"] = m["to"]
                elif m["op"] == "renameSetting" and m.get("section") == instance.get("type") and isinstance(settings, dict) and m["from"] in settings:
                    settings[m["to"]] = settings.pop(m["from"])
                elif m["op"] == "removeSetting" and m.get("section") == instance.get("type") and isinstance(settings, dict):
                    settings.pop(m["setting"], None)
                elif m["op"] == "renameBlock" and isinstance(instance.get("blocks"), dict):
                    for block in instance["blocks"].values():
                        if block.get("type") == m["from"]:
                            block["type"] = m["to"]
    return text if root == before else json.dumps(root, ensure_ascii=False)


def migrate_documents(files: DataFrame, migrations: list[dict]) -> DataFrame:
    """(path, contents, changed) of merchant documents (path, contents) after the migrations."""
    def run(frames):
        for f in frames:
            new = [migrate_document(c, migrations) for c in f["contents"]]
            f["changed"] = [a != b for a, b in zip(new, f["contents"])]
            f["contents"] = new
            yield f

    return files.select("path", "contents").mapInPandas(run, "path string, contents string, changed boolean")


def merge_leaf_documents(base: DataFrame, source: DataFrame, merchant: DataFrame) -> DataFrame:
    """Three-way merge of JSON documents (path, contents) by their leaves: (path, key, value, conflict)."""
    def leaves(df: DataFrame) -> DataFrame:
        def walk(value, prefix):
            for k, v in value.items():
                yield from walk(v, f"{prefix}{k}.") if isinstance(v, dict) else [(prefix + k, json.dumps(v, ensure_ascii=False, sort_keys=True))]

        def run(frames):
            for f in frames:
                yield pd.DataFrame([(f"{p}\n{k}", v) for p, c in zip(f["path"], f["contents"]) for k, v in walk(json.loads(c), "")], columns=["leaf", "value"])

        return df.select("path", "contents").mapInPandas(run, "leaf string, value string")

    merged = merge3(leaves(base), leaves(source), leaves(merchant), "leaf", "value")
    return merged.select(F.split("leaf", "\n")[0].alias("path"), F.split("leaf", "\n")[1].alias("key"), "value", "conflict")
