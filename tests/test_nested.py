import json
import random

from quire.operators import nested


def brute(page):
    """Paths by plain recursion."""
    out = []

    def walk(element, path):
        below = element.get("children")
        for i, x in enumerate(below if isinstance(below, list) else [below] if isinstance(below, dict) else []):
            if isinstance(x, dict):
                out.append(f"{path}.{i}")
                walk(x, f"{path}.{i}")

    top = page.get("elements")
    for i, x in enumerate(top if isinstance(top, list) else [top] if isinstance(top, dict) else []):
        if isinstance(x, dict):
            walk(x, str(i))
    return out


def random_element(rng, depth):
    e = {"type": "text", "text": "x"}
    if depth and rng.random() < 0.6:
        e["children"] = rng.choice([[], None, random_element(rng, depth - 1), [random_element(rng, depth - 1) if rng.random() < 0.8 else None for _ in range(rng.randrange(4))]])
    return e


def paths(page, src="page_results"):
    return [n[1] for n in nested.walk(page, src, frozenset({"element"})) if n[3]]


def test_paths_equal_recursion():
    rng = random.Random(1)
    for _ in range(300):
        page = {"elements": [random_element(rng, 4) for _ in range(rng.randrange(4))]}
        assert sorted(paths(page)) == sorted(brute(page))


def test_depth_is_unbounded(spark):
    text = '{"elements": [' + '{"children": [' * 200_000 + "]}" * 200_000 + "]}"
    page = nested.parse(text)
    levels = 0
    while page := (page.get("elements") or page.get("children") or [None])[0]:
        levels += 1
    assert levels == 200_000
    text = '{"elements": [' + '{"children": [' * 6_000 + "]}" * 6_000 + "], \"quad\": " + "[" * 9_000 + "]" * 9_000 + "}"
    df = spark.createDataFrame([(1, text)], "page_id bigint, raw_json string")
    assert nested.nested_elements(df, "page_id", "raw_json", "page_results").count() == 5_999
    page = nested.flatten(df, "page_id", "raw_json", "page_results", ("page",)).first()
    assert page.attributes["quad"] == "[" * 9_000 + "]" * 9_000


def random_json(rng, depth):
    if not depth or rng.random() < 0.3:
        return rng.choice([None, True, False, 0, -3, 2.5, 1e-7, "", "é\\\"\n", "长"])
    if rng.random() < 0.5:
        return [random_json(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abcdé"): random_json(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_deep_reader_and_writer_agree_with_json():
    rng = random.Random(2)
    for _ in range(500):
        v = random_json(rng, 5)
        text = json.dumps(v, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        assert nested.load_deep(text) == v
        assert json.loads(nested.dump(v)) == v
        broken = text[: rng.randrange(len(text))] + rng.choice(["", ",", "}", "]", '"', "x", ":"]) + text[rng.randrange(len(text)) :]
        try:
            want = json.loads(broken)
        except ValueError:
            want = ValueError
        try:
            got = nested.load_deep(broken)
        except ValueError:
            got = ValueError
        assert got == want or got != got, broken


def test_every_value_has_one_place():
    """Page, nodes and attributes hold each value of a page once; parents are found by truncation."""
    page = {"width": 5, "engine": {"name": "n", "more": {"z": 1}}, "elements": [None, "odd", {"type": "t", "bbox": {"x1": 1, "y1": 2, "x2": 3, "y2": 4, "unit": "px"}, "text": {"raw": "r", "lang": "de"}, "style": {"bold": True}, "children": [{"text": "c", "spans": [{"a": 1}, 7, [{"b": 2}]]}]}]}
    rows = [n for n in nested.flatten_page(json.dumps(page), "page_results", frozenset(nested.NODES))]
    known = {(r[0] == "element", r[5], r[1]) for r in rows}
    assert len(known) == len(rows)
    by = {(r[5], r[1]): r for r in rows}
    assert dict(by["$.engine.more", "0.0"][-1]) == {"z": "1"} and dict(by["$.elements[].style", "2.0"][-1]) == {"bold": "true"}
    assert dict(by["$.elements[].bbox", "2.0"][-1])["unit"] == "px" and dict(by["$.elements[].text", "2.0"][-1])["lang"] == "de" and by["$.elements[]", "2"][7] == "r"
    assert dict(by["$.elements[].children[].spans[]", "2.0.0"][-1]) == {"a": "1"} and dict(by["$.elements[].children[].spans[][]", "2.0.2.0"][-1]) == {"b": "2"}
    assert dict(by["$", ""][-1])["elements[]"] == '[[1,"odd"]]' and dict(by["$.elements[].children[]", "2.0"][-1])["spans[]"] == "[[1,7]]"
    assert all(r[2] is None or r[2] == r[1].rpartition(".")[0] for r in rows)


def test_edge_rows(spark):
    docs = [None, "", "{}", "{\"elements\": [", "[1, 2]", "null", json.dumps({"elements": [None, {"children": {"text": "lone"}}, "text"]}), json.dumps({"res": {"elements": [{"children": [None, {"type": "a", "bbox": {"x1": 1, "y1": 2, "x2": 3, "y2": 4}, "confidence": "0.5"}]}]}})]
    rows = [(i, d, "clash") for i, d in enumerate(docs)] + [(7, docs[7], "clash"), (None, docs[6], "clash")]
    df = spark.createDataFrame(rows, "page_id bigint, raw_json string, row_id string")
    found = nested.nested_elements(df, "page_id", "raw_json", "page_results").collect()
    assert sorted((r.row_id if r.row_id is not None else -1, r.elem_path) for r in found) == [(-1, "1.0"), (6, "1.0"), (7, "0.1"), (7, "0.1")]
    nodes = nested.flatten(df, "page_id", "raw_json", "page_results").collect()
    pages = {r.row_id: r.attributes["parsed"] for r in nodes if r.node == "page"}
    assert pages[0] == pages[1] == pages[3] == pages[4] == pages[5] == "false" and pages[2] == pages[6] == "true"
    child = next(r for r in nodes if r.row_id == 7 and r.dewey == "0.1")
    assert (child.parent_dewey, child.level, child.x2, child.score) == ("0", 1, 3.0, 0.5)


def test_parents_exist_and_long_text(spark):
    page = {"parsing_res_list": [{"block_label": "t", "block_content": "长" * 200_000, "children": [{"block_content": ["a", "b"]}]}], "layout_det_res": {"boxes": [{"label": "t", "coordinate": "1,2,3,4", "score": "0.9"}]}, "overall_ocr_res": {"rec_boxes": [[1, 2, 3, 4]], "rec_scores": [0.5, None]}}
    df = spark.createDataFrame([(1, json.dumps(page))], "cache_id bigint, page_json string")
    rows = nested.flatten(df, "cache_id", "page_json", "page_cache").collect()
    kinds = [r.node for r in rows]
    assert kinds.count("element") == 2 and kinds.count("box") == 1 and kinds.count("line") == 2
    labels = {r.dewey for r in rows if r.node == "element"} | {""}
    assert all(r.parent_dewey in labels for r in rows if r.node == "element") and {(r.dewey, r.parent_dewey) for r in rows if r.node == "line"} == {("0.0", "0"), ("0.1", "0")}
    assert next(r for r in rows if r.node == "element" and r.dewey == "0.0").content == "a\nb" and next(r for r in rows if r.node == "box").y2 == 4.0


def test_empty_table(spark):
    df = spark.createDataFrame([], "cache_id bigint, page_json string")
    assert nested.nested_elements(df, "cache_id", "page_json", "page_cache").count() == 0
    assert nested.flatten(df, "cache_id", "page_json", "page_cache").count() == 0
