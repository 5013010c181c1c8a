"""Structured data of pages as Variants: nodes at any depth, typed entities, and whether each holds its type's fields.

A block is parsed once; walking it takes apart only Variants, inside the rows' own tasks, without a shuffle.  A block that is no
JSON gives one row whose types are null.  So does one that repeats a key within an object, or is beyond a Variant's size.
Pages that are null, empty or without blocks give no rows; repeated pages give their rows again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import html as H

#: What a block's tag looks like; how deep entities are looked for.
BLOCK = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
DEPTH = 5
#: Levels taken apart before the rest is written and looked at: what ordinary blocks need.
LEVELS = 8
#: Most fields of all types together that ``entity_status`` takes: they travel as one map.
MAX_FIELDS = 10_000
_KID = "array<struct<path string, depth int, node variant>>"
_TEXTS = "array<string>"


def members(node: Column) -> Column:
    """An object's members by key; null for what is no object."""
    return F.try_variant_get(node, "$", "map<string,variant>")


def items(node: Column) -> Column:
    """A list's items; null for what is no list."""
    return F.try_variant_get(node, "$", "array<variant>")


def is_text(node: Column) -> Column:
    return F.schema_of_variant(node) == "STRING"


def says_nothing(node: Column) -> Column:
    """Absent, null, blank, an empty list or an empty object."""
    json = F.to_json(node)
    return node.isNull() | json.isin("null", "[]", "{}") | json.rlike(r'^"(\s|\\[bfnrt])*"$')


def is_false(node: Column) -> Column:
    """Absent, null, false, zero, an empty text, an empty list or an empty object."""
    json = F.to_json(node)
    return node.isNull() | json.isin("null", "[]", "{}", '""', "false") | json.rlike(r"^-?0(\.0*)?(E.*)?$")


def _either(lists: Column, objects: Column) -> Column:
    return F.coalesce(lists, objects, F.array().cast(_KID))


def _listed(path: Column, depth: Column, found: Column) -> Column:
    at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
    return F.transform(found, lambda x, i: F.struct(at(i).alias("path"), (depth + 1).alias("depth"), x.alias("node")))


def _below(path: Column, depth: Column, node: Column) -> Column:
    """Lists and objects one step below: a list's are a level deeper; an object's too, but for those under ``@graph``.

    Members whose names start with ``@`` hold no entities otherwise.
    """
    named = F.filter(F.map_entries(members(node)), lambda e: (e.key == "@graph") | ~e.key.startswith("@"))
    held = F.transform(named, lambda e: F.struct(F.concat(path, F.lit("."), e.key).alias("path"), (depth + (e.key != "@graph").cast("int")).alias("depth"), e.value.alias("node")))
    return F.filter(_either(_listed(path, depth, items(node)), held), lambda k: k.depth <= DEPTH)


def _graph(path: Column, depth: Column, node: Column) -> Column:
    """The items of a ``@graph`` that is a list; of a block that is a list (named ``$``, not yet a node) its items."""
    top = F.when(path == "$", _listed(path, depth, items(node)))
    return _either(top, _listed(F.concat(path, F.lit(".@graph")), depth, items(F.try_variant_get(node, "$['@graph']", "variant"))))


def _walk(rows: DataFrame, below: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Lists and objects of each row's ``node``, itself included, by ``below`` step after step.

    ``LEVELS`` steps are one pass over the rows.  Its result is written to the checkpoint folder, since it is asked whether
    anything is left; only blocks nested deeper than that go round again.
    """
    inner = F.filter(below(F.col("path"), F.col("depth"), F.col("node")), lambda k: members(k.node).isNotNull() | items(k.node).isNotNull())
    opened = F.transform(inner, lambda k: F.struct(k.path.alias("path"), k.depth.alias("depth"), k.node.alias("node"), F.lit(True).alias("open")))
    own = F.array(F.struct("path", "depth", "node", F.lit(False).alias("open")))
    parts = F.explode(F.when(F.col("open"), F.concat(own, opened)).otherwise(own)).alias("part")
    found = None
    rows = rows.withColumn("open", F.lit(True))
    while True:
        for _ in range(LEVELS):
            rows = rows.select("page_id", "block", parts).select("page_id", "block", "part.*")
        rows = rows.checkpoint()
        closed = rows.filter("NOT open")
        found = closed if found is None else found.unionByName(closed)
        rows = rows.filter("open")
        if rows.isEmpty():
            return found.drop("open")


def blocks(pages: DataFrame, retry: bool = False) -> DataFrame:
    """``page_id, block, path, depth, node``: each block of JSON-LD parsed, null where it is no JSON.

    With ``retry`` a block that is none is read again with its character references resolved.
    """
    raw = F.trim(F.col("raw"), F.lit(" \t\n\r\f\x0b"))
    parsed = F.try_parse_json(raw)
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(BLOCK), F.lit(1))).alias("block", "raw"))
    node = F.coalesce(parsed, F.try_parse_json(H.unescape(raw))) if retry else parsed
    return rows.select("page_id", "block", F.lit("$").alias("path"), F.lit(0).alias("depth"), node.alias("node"))


def nodes(pages: DataFrame) -> DataFrame:
    """``page_id, block, path, node``: the objects of each block, those of its ``@graph`` lists too, at any depth.

    Blocks with character references in them are read as well.  What is no JSON has no nodes.
    """
    found = _walk(blocks(pages, retry=True).filter("node IS NOT NULL"), _graph)
    return found.filter(members(F.col("node")).isNotNull()).select("page_id", "block", "path", "node")


def _question(node: Column) -> Column:
    """What is wrong with an entry of a page of questions; null if nothing is."""
    kind = F.try_variant_get(node, "$['@type']", "variant")
    kinds = F.coalesce(F.transform(F.filter(items(kind), is_text), lambda k: k.cast("string")), F.array(F.when(is_text(kind), kind.cast("string"))))
    part = lambda name: F.try_variant_get(node, f"$.{name}", "variant")
    answer = part("acceptedAnswer")
    return (
        F.when(members(node).isNull(), "no_object")
        .when(~F.coalesce(F.array_contains(kinds, "Question"), F.lit(False)), "no_question")
        .when(is_false(part("name")), "no_name")
        .when(is_false(answer), "no_answer")
        .when(members(answer).isNotNull() & is_false(F.try_variant_get(answer, "$.text", "variant")), "no_answer_text")
    )


def _faq_issues(node: Column) -> Column:
    main = F.try_variant_get(node, "$.mainEntity", "variant")
    entries = F.coalesce(items(main), F.when(members(main).isNotNull(), F.array(main)))
    told = F.transform(entries, lambda q, i: F.concat(F.lit("entry["), i.cast("string"), F.lit("]:"), _question(q)))
    one = lambda text: F.array(F.lit(text))
    return F.when(main.isNull() | (F.size(entries) == 0), one("no_entries")).when(entries.isNull(), one("entries_no_list")).otherwise(F.filter(told, lambda t: t.isNotNull()))


def _crumb_issues(node: Column) -> Column:
    crumbs = F.filter(items(F.try_variant_get(node, "$.itemListElement", "variant")), lambda x: members(x).isNotNull())

    def wrong(crumb: Column, i: Column) -> Column:
        at = F.try_variant_get(crumb, "$.position", "variant")
        text = F.trim(at.cast("string"))
        place = F.when(is_text(at), F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))).otherwise(F.try_variant_get(at, "$", "double").cast("int"))
        return F.when(F.coalesce(place != i + 1, F.lit(True)), F.concat(F.lit("crumb["), i.cast("string"), F.lit("]:position")))

    return F.filter(F.transform(crumbs, wrong), lambda t: t.isNotNull())


def entities(pages: DataFrame) -> DataFrame:
    """``page_id, block, path, depth, type, entity_id, types, fields, issues, node``: objects with an ``@type``, ``DEPTH`` levels deep.

    A list costs a level, ``@graph`` none.  ``types`` are the texts among the types, ``type`` the first of them, else Unknown.
    ``entity_id`` is the ``@id`` as text, null where it says nothing.  ``fields`` are those that say anything.  ``issues`` are
    faults within lists of questions and breadcrumbs, to be counted if that is the type that the entity is judged as.
    """
    parsed = _walk(blocks(pages), _below)
    bad = F.col("node").isNull()
    held = members(F.col("node"))
    rows = parsed.withColumn("held", held).filter(bad | F.map_contains_key("held", "@type"))
    kind = F.try_element_at("held", F.lit("@type"))
    texts = F.coalesce(F.transform(F.filter(items(kind), is_text), lambda k: k.cast("string")), F.when(is_text(kind), F.array(kind.cast("string"))), F.array().cast(_TEXTS))
    name = F.try_element_at("held", F.lit("@id"))
    told = F.map_keys(F.map_filter("held", lambda _, v: ~says_nothing(v)))
    issues = lambda name, found: F.when(F.array_contains("types", name), found)
    rows = rows.withColumn("types", F.when(~bad, texts))
    return rows.select(
        "page_id", "block", "path", "depth", F.when(~bad, F.coalesce(F.try_element_at("types", F.lit(1)), F.lit("Unknown"))).alias("type"),
        F.when(~is_false(name), name.cast("string")).alias("entity_id"), "types", F.when(~bad, F.array_sort(told)).alias("fields"),
        F.struct(issues("FAQPage", _faq_issues(F.col("node"))).alias("FAQPage"), issues("BreadcrumbList", _crumb_issues(F.col("node"))).alias("BreadcrumbList")).alias("issues"), "node",
    )


def entity_status(found: DataFrame, specs: DataFrame) -> DataFrame:
    """``page_id, block, path, depth, type, entity_id, status, missing, wanted, issues``: each entity against its type's fields.

    ``specs``: type, tier, field; ``MAX_FIELDS`` rows at most, more are refused.

    Tiers are required, google_required and recommended.  Of several types the first that has fields counts, else the first.
    Invalid: lacks a required field of either tier (``missing``), or has an issue; incomplete: lacks a recommended one
    (``wanted``); else valid.  Types without fields are no_spec, and have no issues.
    """
    tiers = {t: F.collect_set(F.when(F.col("tier") == t, F.col("field"))) for t in ("required", "google_required", "recommended")}
    if specs.limit(MAX_FIELDS + 1).count() > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} fields of types")
    need = specs.groupBy("type").agg(*[v.alias(k) for k, v in tiers.items()])
    need = need.agg(F.map_from_entries(F.collect_list(F.struct("type", F.struct(*tiers)))).alias("need"))
    # One row beside each entity.
    rows = found.filter("types IS NOT NULL").drop("type").crossJoin(F.broadcast(need))
    known = F.try_element_at(F.filter("types", lambda t: F.map_contains_key(F.col("need"), t)), F.lit(1))
    rows = rows.withColumn("known", known).withColumn("spec", F.try_element_at("need", F.col("known")))
    none = F.array().cast(_TEXTS)
    lack = lambda fields: F.array_sort(F.array_except(F.coalesce(fields, none), F.col("fields")))
    required = F.array_union(F.col("spec.required"), F.col("spec.google_required"))
    issues = F.coalesce(F.when(F.col("known") == "FAQPage", F.col("issues.FAQPage")).when(F.col("known") == "BreadcrumbList", F.col("issues.BreadcrumbList")), none)
    rows = rows.withColumn("missing", lack(required)).withColumn("wanted", lack(F.col("spec.recommended"))).withColumn("issues", issues)
    status = (
        F.when(F.col("spec").isNull(), "no_spec")
        .when((F.size("missing") > 0) | (F.size("issues") > 0), "invalid")
        .when(F.size("wanted") > 0, "incomplete")
        .otherwise("valid")
    )
    kind = F.coalesce("known", F.try_element_at("types", F.lit(1)), F.lit("Unknown"))
    return rows.select("page_id", "block", "path", "depth", kind.alias("type"), "entity_id", status.alias("status"), "missing", "wanted", "issues")
