"""Structured data walked as Variants, against a plain walk of the parsed text and against cases of each fault."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import crawl, structured

SPEC = "type string, tier string, field string"


def block(text):
    return f'<script type="application/ld+json">{text}</script>'


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")


def states(spark, html, *specs):
    rows = structured.entity_status(structured.entities(pages(spark, html)), spark.createDataFrame(list(specs), SPEC))
    return {r.path: (r.type, r.status, r.missing, r.wanted, r.issues) for r in rows.collect()}


def made(rng, depth):
    """A random value: objects with and without types, lists, graphs, texts."""
    roll = rng.random()
    if depth == 0 or roll < 0.2:
        return rng.choice(["x", 1, None, "", True])
    if roll < 0.45:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    keys = rng.sample(["@type", "@graph", "@reverse", "a", "b", "c"], rng.randrange(1, 5))
    return {k: rng.choice(["T", ["T", 1, "U"], [], None]) if k == "@type" else made(rng, depth - 1) for k in keys}


def walked(value, path="$", depth=0):
    if depth > 5:
        return
    if isinstance(value, dict):
        if "@type" in value:
            yield path, depth
        for k, v in value.items():
            if k == "@graph" or not k.startswith("@"):
                yield from walked(v, f"{path}.{k}", depth + (k != "@graph"))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walked(v, f"{path}[{i}]", depth + 1)


def test_walk_against_plain_recursion(spark):
    rng = random.Random(7)
    values = [made(rng, 11) for _ in range(150)]
    values.append(json.loads('{"@graph":' * 30 + '[{"@type":"Z"}]' + "}" * 30))
    rows = structured.entities(pages(spark, *[block(json.dumps(v)) for v in values]))
    got = sorted((r.page_id, r.path, r.depth) for r in rows.collect())
    assert got == sorted((k, *at) for k, v in enumerate(values) for at in walked(v))
    assert len(got) > 200


def test_types_and_ids(spark):
    html = block('[{"@type":"A","@id":"#a"},{"@type":[3,"B","A"],"@id":""},{"@type":[],"@id":0},{"@type":null,"@id":7},{"a":1}]')
    got = {r.path: (r.type, r.types, r.entity_id) for r in structured.entities(pages(spark, html)).collect()}
    assert got == {"$[0]": ("A", ["A"], "#a"), "$[1]": ("B", ["B", "A"], None), "$[2]": ("Unknown", [], None), "$[3]": ("Unknown", [], "7")}
    assert states(spark, html, ("A", "required", "x"))["$[1]"][:3] == ("A", "invalid", ["x"])


@pytest.mark.parametrize(
    ("value", "said"), [('"x"', True), ("0", True), ("false", True), ('[""]', True), ("null", False), ('" \\n"', False), ('""', False), ("[]", False), ("{}", False)]
)
def test_what_counts_as_said(spark, value, said):
    got = states(spark, block(f'{{"@type":"A","f":{value}}}'), ("A", "google_required", "f"))
    assert got["$"][1:3] == (("valid", []) if said else ("invalid", ["f"]))


def test_tiers(spark):
    specs = [("A", "required", "r"), ("A", "google_required", "g"), ("A", "recommended", "w"), ("A", "recommended", "v")]
    html = block('[{"@type":"A"},{"@type":"A","r":1,"g":1},{"@type":"A","r":1,"g":1,"w":1,"v":1},{"@type":"Z"}]')
    got = states(spark, html, *specs)
    assert got["$[0]"][1:4] == ("invalid", ["g", "r"], ["v", "w"])
    assert [got[f"$[{k}]"][1] for k in (1, 2, 3)] == ["incomplete", "valid", "no_spec"]


@pytest.mark.parametrize(
    ("main", "issues"),
    [
        ('{"@type":"Question","name":"q","acceptedAnswer":{"text":"a"}}', []),
        ('[{"@type":["Thing","Question"],"name":"q","acceptedAnswer":"plain"}]', []),
        ("[]", ["no_entries"]),
        ("null", ["entries_no_list"]),
        ('"x"', ["entries_no_list"]),
        ('["x",{"name":"q"},{"@type":"Question"}]', ["entry[0]:no_object", "entry[1]:no_question", "entry[2]:no_name"]),
        ('[{"@type":"Question","name":"q"},{"@type":"Question","name":"q","acceptedAnswer":{"text":""}}]', ["entry[0]:no_answer", "entry[1]:no_answer_text"]),
    ],
)
def test_questions(spark, main, issues):
    got = states(spark, block(f'{{"@type":"FAQPage","mainEntity":{main}}}'), ("FAQPage", "recommended", "name"))
    assert got["$"][1:] == ("invalid" if issues else "incomplete", [], ["name"], issues)


@pytest.mark.parametrize(
    ("items", "wrong"), [('[{"position":1},{"position":"2"},{"position":3.9}]', []), ('[{"position":0},7,{"position":2},{}]', [0, 2]), ('{"position":5}', []), ('[{"position":"1.0"}]', [0])]
)
def test_breadcrumbs(spark, items, wrong):
    got = states(spark, block(f'{{"@type":"BreadcrumbList","itemListElement":{items}}}'), ("BreadcrumbList", "required", "itemListElement"))
    assert got["$"][4] == [f"crumb[{k}]:position" for k in wrong]


def test_nodes_of_graphs_and_escaped_blocks(spark):
    html = block('{&quot;a&quot;:{&quot;b&quot;:1}}') + block("{no") + block('{"@graph":[{"@graph":[{"@type":"X","y":{"@type":"Y"}},3]},[{}]]}') + block('{"@graph":{"z":1}}') + block('[{"q":1},[{"r":1}]]')
    got = {(r.block, r.path) for r in structured.nodes(pages(spark, html)).collect()}
    assert got == {(0, "$"), (2, "$"), (2, "$.@graph[0]"), (2, "$.@graph[0].@graph[0]"), (3, "$"), (4, "$[0]")}


def test_odd_rows(spark):
    html = block("{oops") + '<script type="application/json">{"@type":"A"}</script>' + block(json.dumps({"@type": "A", "t": "x" * 2_000_000}))
    rows = structured.entities(pages(spark, None, "", "<p>", html, html).withColumn("NODE", F.lit(1)).withColumn("block", F.lit(2)))
    got = sorted((r.page_id, r.block, r.path, r.type or "") for r in rows.collect())
    assert got == [(3, 0, "$", ""), (3, 1, "$", "A"), (4, 0, "$", ""), (4, 1, "$", "A")]
    specs = spark.createDataFrame([], SPEC)
    empty = structured.entity_status(structured.entities(pages(spark, html).filter("false")), specs)
    assert empty.count() == 0
    checks = crawl.schema_checks(rows, structured.entity_status(rows, specs)).filter("page_id = 3").first()
    assert (checks.parse, checks.present, checks.no_invalid, checks.ids, checks.known_types) == ("fail", "pass", "pass", "fail", "warn")


def test_specs_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(structured, "MAX_FIELDS", 1)
    with pytest.raises(ValueError, match="fields"):
        structured.entity_status(structured.entities(pages(spark, "")), spark.createDataFrame([("A", "required", "x"), ("A", "required", "y")], SPEC))
