"""Checks of components: authored schemas, slots, hoisted settings, resolved renders, defaults.

Diagnostics are rows (path, code, name). Groups meet as minima and counts, which are combined before the shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as X
from weft.operators.rules import diagnostic
from weft.session import tasks_for

#: Type of a schema setting and the control that edits it; any other type is edited as text.
SETTING_CONTROLS = (
    ("checkbox", "boolean"), ("range", "number"), ("number", "number"), ("color", "color"), ("color_background", "color"), ("url", "url"),
    ("richtext", "richtext"), ("inline_richtext", "richtext"), ("html", "richtext"),
)


def _shape_problem(value) -> str | None:
    """What is wrong with a parsed schema: the first fault in document order."""
    if not isinstance(value, dict):
        return "root must be an object"

    def entries(owner: dict, key: str, at: str, text_field: str):
        """Faults of a list of objects, entry by entry, and the sound entries with their place."""
        if key not in owner:
            return
        if not isinstance(owner[key], list):
            yield f"{at} must be an array", None, None
            return
        for i, entry in enumerate(owner[key]):
            place = f"{at.strip(chr(34))}[{i}]"
            if not isinstance(entry, dict):
                yield f"{place} must be an object", None, None
            elif not isinstance(entry.get(text_field, ""), str):
                yield f"{place}.{text_field} must be a string", None, None
            else:
                yield None, place, entry

    for problem, _, _ in entries(value, "settings", '"settings"', "id"):
        if problem:
            return problem
    for problem, place, block in entries(value, "blocks", '"blocks"', "type"):
        if problem:
            return problem
        for inner, _, _ in entries(block, "settings", f"{place}.settings", "id"):
            if inner:
                return inner
    return None


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def parsed_schemas(schemas: DataFrame) -> DataFrame:
    """(path, problem, section_ids, block_ids, classic) of authored schemas (path, source); a null source is no schema.

    problem is ``invalid JSON`` or the first fault of its shape, else null. classic: every block states its settings here, so
    block_ids is all that a block can read.
    """

    def run(frames):
        for f in frames:
            out = {"path": [], "problem": [], "section_ids": [], "block_ids": [], "classic": []}
            for path, source in zip(f["path"], f["source"]):
                try:
                    value = json.loads(source, parse_constant=_no_constant)
                    problem = _shape_problem(value)
                except (ValueError, RecursionError):
                    value, problem = None, "invalid JSON"
                sound = value if problem is None else {}
                blocks = sound.get("blocks", [])
                ids = lambda owner: [s["id"] for s in owner.get("settings", []) if "id" in s]
                row = (path, problem, ids(sound), [i for b in blocks for i in ids(b)], bool(blocks) and all(b.get("type") not in ("@theme", "@app") for b in blocks))
                for column, x in zip(out.values(), row):
                    column.append(x)
            yield type(f)(out)

    return schemas.select("path", "source").where("source is not null").mapInPandas(run, "path string, problem string, section_ids array<string>, block_ids array<string>, classic boolean")


def schema_problems(parsed: DataFrame) -> DataFrame:
    code = F.when(F.col("problem") == "invalid JSON", "SCHEMA_INVALID_JSON").otherwise("SCHEMA_INVALID_SHAPE")
    return parsed.where("problem is not null").select("path", code.alias("code"), F.col("problem").alias("name"))


def unknown_setting_reads(parsed: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads (path, object, name) of settings that the schema of their file does not declare.

    Block reads are judged only where all blocks are classic; files without a sound schema are not judged.
    """
    sound = parsed.where("problem is null")
    unknown = ((F.col("object") == "section") & ~F.array_contains("section_ids", F.col("name"))) | ((F.col("object") == "block") & F.col("classic") & ~F.array_contains("block_ids", F.col("name")))
    return diagnostic(reads.join(sound, "path").where(unknown), "SETTING_READ_UNKNOWN")


def schema_controls(schemas: DataFrame) -> DataFrame:
    """(path, name, label, kind, options, least, most, step) of the settings of schemas (path, source) that are inputs."""
    shape = "struct<settings: array<struct<type: string, id: string, label: string, min: double, max: double, step: double, options: array<struct<value: string>>>>>"
    rows = schemas.select("path", F.explode(F.from_json("source", shape)["settings"]).alias("s")).select("path", "s.*")
    rows = rows.where("type <> '' and id <> '' and type not in ('header', 'paragraph')")
    options = F.filter(F.transform("options", lambda o: o["value"]), lambda v: v.isNotNull())
    options = F.when(F.size(options) > 0, options)
    kind = F.when(options.isNotNull(), "select")
    for setting, control in SETTING_CONTROLS:
        kind = kind.when(F.col("type") == setting, control)
    bound = lambda c: F.when(F.col("type") == "range", F.col(c))
    return rows.select("path", F.col("id").alias("name"), F.coalesce("label", "id").alias("label"), kind.otherwise("text").alias("kind"), options.alias("options"), bound("min").alias("least"), bound("max").alias("most"), bound("step").alias("step"))


def setting_projections(props: DataFrame) -> DataFrame:
    """Props (path, name, setting, input) that are settings of a type without an editor input."""
    return diagnostic(props.where("setting and input is null"), "SETTING_TYPE_UNSUPPORTED")


def placement(components: DataFrame, props: DataFrame, slots: DataFrame) -> DataFrame:
    """Props without a value source and slots out of place. components (path, kind), props (path, name, setting), slots (path, at).

    A section's or block's prop must be a setting; a slot for blocks stands in a section only, and once.
    """
    plain = props.where("not setting").join(components.where("kind in ('section', 'block')"), "path", "left_semi")
    named = slots.select("path", F.col("at").cast("string").alias("name"), "at")
    outside = named.join(components.where("kind <> 'section'"), "path", "left_semi")
    later = named.join(slots.groupBy("path").agg(F.min("at").alias("first")), "path").where("at > first")
    return diagnostic(plain, "PROP_WITHOUT_SETTING").unionByName(diagnostic(outside, "SLOT_OUTSIDE_SECTION")).unionByName(diagnostic(later, "SLOT_REPEATED"))


def hoisting_conflicts(unfilled: DataFrame, own: DataFrame) -> DataFrame:
    """Settings that cannot be hoisted: unfilled (path, site, at, alias, argument, place) arguments, own (path, id) settings.

    Only the first site of an alias hoists; others are reported once each. Its settings are named after alias and argument; a
    name that the file or an earlier hoisted setting has is reported. Repeated rows count once.

    Rows and own settings are dealt by path once; two ordered passes over a path find the first sites, and then what is
    reported: repeats and what came before are told by the row before.
    """
    rows = unfilled.where("path is not null and alias is not null")
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    both = rows.select("path", "alias", "at", "site", "place", "argument", F.lit(None).cast(own.schema["id"].dataType).alias("_own"), F.lit(True).alias("_row"))
    both = both.unionByName(own.where("path is not null and id is not null").select("path", *map(none, ("alias", "at", "site", "place", "argument")), F.col("id").alias("_own"), F.lit(False).alias("_row")))
    by_site = Window.partitionBy("path", "alias").orderBy("at", "site").rowsBetween(Window.unboundedPreceding, 0)
    first = both.repartition(tasks_for(unfilled, own), "path").withColumn("_site", F.first("site").over(by_site))
    reused = F.col("_row") & (F.col("site") != F.col("_site"))
    named = F.concat(X.snake_case(F.col("alias")), F.lit("_"), F.col("argument"))
    first = first.where("not _row or site <> _site or site = _site").select("path", "alias", "_row", F.coalesce(reused, F.lit(False)).alias("_reused"), "at", "place", F.when(reused, F.col("site")).otherwise(F.coalesce("_own", named)).alias("name"))
    # own settings come first, then named ones by place; of a site that is reused only the alias counts
    place = F.struct("_row", *[F.when(~F.col("_reused"), F.col(c)).alias(c) for c in ("at", "place")], "alias")
    judged = first.where("name is not null").select("path", "name", "_row", "_reused", place.alias("_place"))
    before = F.lag("_place").over(Window.partitionBy("path", "_reused", "name").orderBy("_place"))
    judged = judged.withColumn("_before", before).where(F.col("_row") & ~F.col("_before").eqNullSafe(F.col("_place")) & (F.col("_reused") | F.col("_before").isNotNull()))
    return judged.select("path", F.when(F.col("_reused"), "HOISTED_ALIAS_REUSED").otherwise("HOISTED_SETTING_COLLISION").alias("code"), "name")


def with_headers(settings: DataFrame, header: str = "alias") -> DataFrame:
    """(path, at, part, type, content) of hoisted settings (path, at, alias, id): a header stands where the alias changes.

    Rows of a path in order of ``at`` (then id and alias); part 0 is the header, part 1 the setting itself.
    """
    before = F.lag(header).over(Window.partitionBy("path").orderBy("at", "id", header))
    entry = lambda part, kind, content: F.struct(F.lit(part).alias("part"), F.lit(kind).alias("type"), content.alias("content"))
    own = entry(1, "setting", F.col("id"))
    rows = settings.withColumn("_rows", F.when(before.eqNullSafe(F.col(header)), F.array(own)).otherwise(F.array(entry(0, "header", X.humanize(F.col(header))), own)))
    return rows.select("path", "at", F.explode("_rows").alias("r")).select("path", "at", "r.*")


def resolution_problems(sites: DataFrame, targets: DataFrame, bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Faults of resolved renders, as (path, code, name).

    sites (path, site); targets (site, at, symbol); bindings (path, site, argument, component, prop); symbols (symbol, owner,
    contract): contract says that the symbol is a prop of a compiled contract outside the file. A site has one target, an
    argument one binding, and a binding is to a contract's prop of the site's (first) target.
    """
    counted = targets.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "symbol")).alias("_f"))
    wrong = sites.join(counted, "site", "left").where("coalesce(n, 0) <> 1")
    many = bindings.groupBy("path", "argument").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bound = bindings.join(counted.select("site", F.col("_f.symbol").alias("target")), "site")
    other = bound.where(~F.col("component").eqNullSafe(F.col("target")))
    judged = bound.join(symbols.select(F.col("symbol").alias("prop"), "owner", "contract"), "prop", "left")
    foreign = judged.where(~F.coalesce((F.col("owner") == F.col("component")) & F.col("contract"), F.lit(False)))
    return (
        diagnostic(wrong, "RENDER_TARGET_COUNT", "site")
        .unionByName(diagnostic(many, "ARGUMENT_AMBIGUOUS", "argument"))
        .unionByName(diagnostic(other, "BINDING_TARGET_MISMATCH", "argument"))
        .unionByName(diagnostic(foreign, "BINDING_NOT_CONTRACT_PROP", "argument"))
    )


def default_problems(props: DataFrame) -> DataFrame:
    """Props (path, name, has_default, value) whose default is no string, finite number or boolean, or is there unannounced.

    value is JSON, null if there is none.
    """
    scalar = F.coalesce(F.col("value").rlike(r'(?s)^(?:".*"|true|false|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\z'), F.lit(False))
    return diagnostic(props.where((~F.col("has_default") & F.col("value").isNotNull()) | (F.col("has_default") & ~scalar)), "DEFAULT_INVALID")


def slot_problems(slots: DataFrame, components: DataFrame) -> DataFrame:
    """Blocks that a slot (path, name) allows and that are no component (name, kind), or one of another kind than block.

    Slots are dealt by the name once and pass by a hash table of the components unsorted; only faults are made distinct.
    """
    n = tasks_for(slots, components)
    known = components.select("name", (F.col("kind") == "block").alias("block")).repartition(n, "name").groupBy("name").agg(F.max("block").alias("block"))
    named = slots.select("path", "name").repartition(n, "name").join(known.hint("shuffle_hash"), "name", "left").where("block is null or not block")
    return named.select("path", F.when(F.col("block").isNull(), "SLOT_BLOCK_UNKNOWN").otherwise("SLOT_NOT_A_BLOCK").alias("code"), "name").distinct()


def region_references(regions: DataFrame, bindings: list[str]) -> DataFrame:
    """(path, kind, binding, name, form, n) of what template regions (path, output, inner) refer to, and how often.

    Props as ``props.x``, classes of the imported style ``bindings`` as ``styles.x`` or ``styles["x"]``. An output that is one
    class as a whole prints the bare class; elsewhere it is a quoted one.
    """
    name, bracket = r"([A-Za-z_$][\w$]*)", r"\[\s*[\"']([^\"']+)[\"']\s*\]"
    found = F.transform(F.regexp_extract_all("inner", F.lit(rf"\bprops\.{name}")), lambda x: F.struct(F.lit("prop").alias("kind"), F.lit("props").alias("binding"), x.alias("name"), F.lit("identifier").alias("form")))
    whole = F.lit(False)
    for b in bindings:
        head = r"\b" + "".join(c if c.isalnum() or c == "_" else "\\" + c for c in b)
        alone = F.col("output") & F.trim("inner").rlike(rf"^{head}(?:\.{name}|{bracket})\z")
        for tail in (rf"\.{name}", bracket):
            hits = F.regexp_extract_all("inner", F.lit(head + tail))
            form = F.when(alone, "bare-class").otherwise("quoted-class")
            found = F.concat(found, F.transform(hits, lambda x: F.struct(F.lit("style").alias("kind"), F.lit(b).alias("binding"), x.alias("name"), form.alias("form"))))
        whole = whole | alone
    rows = regions.select("path", F.explode(F.when(whole, F.filter(found, lambda r: r["form"] == "bare-class")).otherwise(found)).alias("r"))
    return rows.select("path", "r.*").groupBy("path", "kind", "binding", "name", "form").agg(F.count(F.lit(1)).alias("n"))
