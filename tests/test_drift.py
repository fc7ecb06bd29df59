import json

import numpy as np
import pytest

from quire.operators import drift

BASE = [
    ("s", "page_index", "number", True), ("s", "width", "number", True), ("s", "note", "object", False), ("s", "note.who", "string", False), ("s", "elements", "array", True), ("s", "elements[].text", "string", True), ("s", "elements[].confidence", "number", True),
    ("s", "elements[].box", "array", True), ("s", "elements[].children", "array", False), ("s", "scores", "array", True), ("s", "scores[]", "number", True),
]


def page(**over):
    e = {"text": "Some words of a page.", "confidence": 0.9, "box": [10, 20, 300, 400]}
    p = {"page_index": 3, "width": 1654, "elements": [e, dict(e, children=[dict(e)])], "scores": [0.9, 0.8]}
    p.update(over)
    return p


@pytest.fixture
def run(spark):
    schema = spark.createDataFrame(BASE, "src string, field_path string, json_type string, required boolean")

    def go(rows):
        df = spark.createDataFrame([(i, k, v, "x") for i, (k, v) in enumerate(rows)], "id bigint, key string, doc string, src string")
        return {(r.doc_key, r.field_path, r.change_kind) for r in drift.changes([(df, "key", "doc", "s")], schema).collect()}

    return go


def test_kinds_of_change(run):
    def items(f):
        p = page()
        for e in p["elements"]:
            f(e)
        return p

    def rename(old, new):
        def f(e):
            e[new] = e.pop(old)

        return f

    no_width = page()
    del no_width["width"]
    rows = [("base", page())] * 5 + [
        ("renamed", items(rename("confidence", "score"))), ("renamed_text", items(rename("text", "rec"))), ("removed", no_width), ("added", page(doc_angle=-1.5)), ("retyped", page(width="1654px")),
        ("item", page(scores=["0.9"])), ("nested", items(lambda e: e.update(style={"face": "a"}))), ("decoy", {k: v for k, v in page(angle=-0.7).items() if k != "page_index"}), ("lone", page(elements=[{"text": "a", "confidence": 0.1, "box": [1, 2, 3, 4], "children": {"text": "b", "confidence": 0.3, "box": [1, 2, 3, 4]}}])),
    ]
    got = run([(k, json.dumps(v)) for k, v in rows])
    assert got == {
        ("renamed", "elements[].confidence", "renamed"), ("renamed_text", "elements[].text", "renamed"), ("removed", "width", "removed"), ("added", "doc_angle", "added"), ("retyped", "width", "retyped"), ("item", "scores[]", "retyped"),
        ("nested", "elements[].style", "added"), ("decoy", "page_index", "removed"), ("decoy", "angle", "added"), ("lone", "elements[].children", "retyped"),
    }


def test_edge_rows(run):
    rows = [("a", None), ("a", ""), ("a", "{}"), ("a", "{\"page_index\""), ("a", "[]"), ("a", json.dumps({"res": page()})), (None, json.dumps(page(extra=1))), (None, json.dumps(page(extra=1))), ("nulls", json.dumps(page(width=None, elements=[None])))]
    assert run(rows) == {(None, "extra", "added")}
    assert run([]) == set()


def test_flood_prefers_equal_structure():
    left = {"box": ("a", ()), "layout": ("o", ("boxes:a",))}
    right = {"region": ("a", ()), "found": ("o", ("boxes:a",))}
    score = drift.flood(left, right, {(a, b): 0.2 for a in left for b in right})
    assert score["layout", "found"] > score["layout", "region"] and score["box", "region"] > score["box", "found"]


NESTED = [("s", "first", "object", True), ("s", "first.left", "number", True), ("s", "first.top", "number", True), ("s", "second", "object", True), ("s", "second.name", "number", True), ("s", "second.size", "number", True), ("s", "wide", "number", True), ("s", "high", "number", True)]


def nested_page(a="first", b="second", wide=("wide", 1654), high=("high", 2339)):
    return json.dumps({a: {"left": 5, "top": 7}, b: {"name": 5, "size": 7}, wide[0]: wide[1], high[0]: high[1]})


def changes_of(spark, docs):
    schema = spark.createDataFrame(NESTED, "src string, field_path string, json_type string, required boolean")
    df = spark.createDataFrame(docs, "key string, doc string")
    return {(r.doc_key, r.field_path, r.change_kind, r.found_path) for r in drift.changes([(df, "key", "doc", "s")], schema).collect()}


def test_flooding_decides(spark, monkeypatch):
    """Objects of equal statistics and other names are told apart by what is nested below them, which only flooding sees."""
    docs = [("base", nested_page())] * 5 + [("moved", nested_page("q", "p")), ("range", nested_page(wide=("page_wide", 2339), high=("page_high", 1654)))]
    want = {("moved", "first", "renamed", "q"), ("moved", "second", "renamed", "p"), ("range", "wide", "renamed", "page_wide"), ("range", "high", "renamed", "page_high")}
    assert changes_of(spark, docs) == want
    node = drift.compile_baseline([dict(zip(("src", "field_path", "json_type", "required"), r)) for r in NESTED])["s"]
    keys = {"p": "o", "q": "o", "wide": "n", "high": "n"}
    deep = {"p": ["name:n", "size:n"], "q": ["left:n", "top:n"]}
    stats = {k: np.array([1.0, 0, 0, 0, 0, 1.0, *[0.0] * 14]) for k in keys}
    known = {"first": stats["p"], "second": stats["p"]}
    assert drift.correspond(node, keys, deep, stats, known) == {"first": "q", "second": "p"}
    monkeypatch.setattr(drift, "flood", lambda left, right, start, **_: start)
    assert drift.correspond(node, keys, deep, stats, known) != {"first": "q", "second": "p"}
    monkeypatch.setattr(drift, "flood", lambda *_, **__: {})
    assert drift.correspond(node, keys, deep, stats, known) == {}


def test_lists_are_judged_by_all_items():
    sums = [0.0] * len(drift.STATS)
    drift._stats([None, 1, "a", {"x": 1}], sums)
    assert sums[16:20] == [0.25, 0.25, 0, 0.25]
    found = set()
    drift._deep([{"a": 1}, None, {"b": {"c": "x"}}], found)
    assert found == {"a:n", "b:o", "b.c:s"}


def test_unified_table(spark):
    schema = spark.createDataFrame(BASE, "src string, field_path string, json_type string, required boolean")
    odd = page(width="1654px", note={"who": "x"}, new=1)
    rows = [(1, "k", json.dumps(odd)), (2, "k", "{"), (3, None, None)]
    df = spark.createDataFrame(rows, "id bigint, key string, doc string")
    report = drift.changes([(df, "key", "doc", "s")], schema)
    got = {r.row_id: r for r in drift.unify(df, "id", "key", "doc", "s", report).collect()}
    assert got[1].width == 1654.0 and json.loads(got[1].extra).keys() >= {"new"} and len(got[1].elements) == 3
    assert got[2].width is None and got[3].doc_key is None


def test_unified_table_keeps_every_value(spark):
    base = [
        ("page_cache", "parsing_res_list", "array", True), ("page_cache", "parsing_res_list[].block_label", "string", True), ("page_cache", "parsing_res_list[].block_content", "string", True), ("page_cache", "layout_det_res", "object", True),
        ("page_cache", "layout_det_res.boxes", "array", True), ("page_cache", "layout_det_res.boxes[].score", "number", True), ("page_cache", "overall_ocr_res", "object", True), ("page_cache", "overall_ocr_res.rec_boxes", "array", True), ("page_cache", "overall_ocr_res.rec_scores", "array", True),
        ("page_results", "elements", "array", True), ("page_results", "elements[].text", "string", True), ("page_results", "elements[].order_index", "number", True), ("page_results", "elements[].bbox", "object", True), *[("page_results", f"elements[].bbox.{k}", "number", True) for k in drift.CORNERS],
    ]
    schema = spark.createDataFrame(base, "src string, field_path string, json_type string, required boolean")

    def unified(src, docs):
        df = spark.createDataFrame([(i, k, json.dumps(v)) for i, (k, v) in enumerate(docs)], "id bigint, key string, doc string")
        report = drift.renames_and_changes([(df, "key", "doc", src)], schema)
        return [r for r in drift.unify(df, "id", "key", "doc", src, report).orderBy("row_id").collect()]

    e = {"block_label": "text", "block_content": "a", "is_vertical": True}
    cache = {"parsing_res_list": [dict(e, children=[dict(e, angle=3)]), "stray"], "layout_det_res": {"boxes": [{"score": 0.5, "style": {"a": 1}}], "ms": 7}, "overall_ocr_res": {"rec_boxes": [[1, 2, 3, 4]], "rec_scores": [0.5], "lang": "zh"}}
    r = unified("page_cache", [("k", cache)])[0]
    assert [json.loads(x.extra) for x in r.elements] == [{"is_vertical": True}, {"is_vertical": True, "angle": 3}] and json.loads(r.boxes[0].extra) == {"style": {"a": 1}}
    assert tuple(r.line_boxes[0]) == (1, 2, 3, 4) and json.loads(r.ocr_extra) == {"lang": "zh"} and json.loads(r.layout_extra) == {"ms": 7} and json.loads(r.extra) == {"parsing_res_list[]": [[1, "stray"]]}

    def line(name, corner="x1", order=1):
        return {"elements": [{name: "Some words of a page.", "order_index": order, "bbox": {corner: 10.5, "y1": 20.5, "x2": 300.5, "y2": 400.5}}]}

    docs = [("base", line("text"))] * 4 + [(None, line("rec_text")), (None, line("text_found")), (None, line("text", "x1_left")), (None, line("text", order="first"))]
    got = unified("page_results", docs)
    assert [x.elements[0].content for x in got] == ["Some words of a page."] * 8
    assert [x.elements[0].x1 for x in got] == [10.5] * 8 and [x.elements[0].extra for x in got[:7]] == [None] * 7 and json.loads(got[7].elements[0].extra) == {"order_index": "first"}
