import json
import random

from pyspark.sql import functions as F

from quire.operators import modules, review, toc
from quire.sources import files, ocr_json


def lines(spark, text):
    return review.lines_of(spark.createDataFrame([(1, text)], "content_id bigint, book_md string"))


def test_issue_families(spark):
    md = "# 一\n\n# 第二章 标题很长\n短句\n——续\n### deep ©\n正文结束。\n短\n短二\n短三\n\n>[low-confidence] 模*糊文字\n后文。"
    df = lines(spark, md)
    assert [(r.id, r.issue) for r in review.title_issues(df).orderBy("line_no").collect()] == [("T-1", "too_short"), ("T-2", "split_title"), ("T-3", "ocr_error")]
    assert [(r.issue, r.line_no) for r in review.chapter_issues(df).orderBy("line_no", "issue").collect()] == [("empty_chapter", 0), ("level_jump", 5)]
    assert [(r.start_line, r.end_line) for r in review.short_line_clusters(df).collect()] == [(7, 9)]
    low = review.low_confidence_issues(df).first()
    assert (low.text, low.max_length, low.max_edits, low.wildcards, low.after) == ("模*糊文字", 6, 2, 1, "后文。")
    assert lines(spark, None).count() == 0 and review.title_issues(lines(spark, "")).count() == 0


def test_corrections(spark):
    rows = [("模*糊", "模模糊", "ok"), ("模*糊", "[UNCLEAR]", "unclear"), ("模*糊", "  ", "empty"), ("ab", "abcdef", "too_long"), ("abc", "abd", "lost_chars"), ("ab*cd", "cabd*", "too_many_edits"), ("aab", "ab*", "lost_chars")]
    df = spark.createDataFrame(rows, "o string, c string, want string")
    for r in df.select("want", review.check_correction(F.col("o"), F.col("c")).alias("got")).collect():
        assert r.got == r.want
    fixes = spark.createDataFrame([(1, 0, "A", 1), (1, 0, "B", 2), (1, 1, None, 1)], "doc bigint, line_no int, new_line string, priority int")
    assert [r.line for r in review.apply_fixes(lines(spark, "a\nb\nc"), fixes).orderBy("line_no").collect()] == ["B", "c"]


def test_json_recovery():
    whole = {"a": [{"b": 1}, {"b": 2, "c": "x]"}], "d": {"e": 3}}
    text = json.dumps(whole)
    assert json.loads(review.lenient_json("```json\n" + text + "\n```")) == whole
    for cut in range(len(text)):
        got = review.lenient_json("Answer: " + text[:cut])
        if got is not None:
            json.loads(got)
    assert json.loads(review.close_json('{"a": [{"b": 1}, {"b": 2')) == {"a": [{"b": 1}]}
    assert review.lenient_json(None) is None and review.lenient_json("no json") is None


def test_images_and_decorations(spark):
    md = "![a](images/x.png)\n\n# T\n![b](images/x.png)\n\ntext\n扫码\n![q](images/q.png)"
    df = lines(spark, md)
    assert sorted(r.refs for r in review.image_refs(df).collect()) == [1, 2, 2]
    assert [r.title for r in review.decorated_titles(df).where("line_no < 5").collect()] == ["T", "T"]
    left = review.remove_images(df, review.image_refs(df).where("refs > 1"))
    assert [r.line for r in left.orderBy("line_no").collect()] == ["# T", "text", "扫码", "![q](images/q.png)"]


def test_modules_round_trip(spark):
    md = "intro\n\n::: {.chapter}\n\n# One {#ch-1}\n\nbody\n\n::: {.dialogue .align-right}\n\n“hi”\n\n:::\n\n![x](pages/p.png)\n\n---\n\n> quote\n\n:::\n"
    got = modules.parse(spark.createDataFrame([(1, md), (2, None), (3, "")], "content_id bigint, book_md string"))
    assert [(r.type, r.layout_classes) for r in got.orderBy("position").collect()] == [("paragraph", []), ("chapter", []), ("paragraph", []), ("dialogue", ["dialogue", "align-right"]), ("cover", []), ("divider", []), ("quote", [])]
    again = modules.serialise(got).first().book_md
    twice = modules.parse(spark.createDataFrame([(1, again)], "content_id bigint, book_md string"))
    assert [(r.type, r.layout_classes) for r in twice.orderBy("position").collect()] == [(r.type, r.layout_classes) for r in got.orderBy("position").collect()]
    toggled = spark.range(1).select(modules.toggle_class(F.array(F.lit("align-left"), F.lit("x")), "align-right"), modules.toggle_class(F.array(F.lit("x")), "x")).first()
    assert toggled == (["x", "align-right"], [])
    assert spark.range(1).select(modules.split_at(F.lit("一二三四。五六"))).first()[0] == ["一二三四。", "五六"]


def test_toc(spark):
    src = spark.createDataFrame([(1, 0, "第一卷南山经／2第二卷西山经／16"), (1, 1, "第十六卷大荒西经第十七卷大荒北经"), (1, 2, "目录"), (1, 3, "CONTENTS")], "doc bigint, line_no int, line string")
    assert [(r.title, r.page) for r in toc.parse_lines(src).orderBy("line_no", "no").collect()] == [("第一卷南山经", "2"), ("第二卷西山经", "16"), ("第十六卷大荒西经", None), ("第十七卷大荒北经", None)]
    entries = spark.createDataFrame([("b", 1, "One Two"), ("b", 2, "OneTwo"), ("b", 3, "Two"), ("b", 4, "Thre@"), ("b", 5, "none"), ("b", 6, None)], "book_id string, pos int, title string")
    anchors = spark.createDataFrame([("b", 1, "One Two", "#1"), ("b", 2, "Three", "#2"), ("x", 1, "none", "#3")], "book_id string, place int, name string, anchor string")
    got = {r.pos: (r.rank, r.anchor) for r in toc.link(entries, anchors).collect()}
    assert got == {1: (1, "#1"), 2: (2, "#1"), 3: (3, "#1"), 4: (4, "#2"), 5: (None, None)}
    assert "- [One Two](#1)" in toc.render(toc.link(entries, anchors)).first().toc_md


def test_layout_json(spark):
    page = {"res": {"width": 100, "height": "x", "parsing_res_list": [None, {"label": "title", "bbox": [0, 0, 10, 10], "content": "A", "block_order": "2"}, {"block_label": "", "block_bbox": [50, 50, 60, 60]}], "layout_det_res": {"boxes": [{"coordinate": [50.4, 50.4, 60.4, 60.4], "score": 0.3}, {"coordinate": [50.2, 50.2, 60.2, 60.2], "score": 0.7}]}, "overall_ocr_res": {"rec_boxes": [[1, 1, 3, 3], [2, 2, 4, 4]], "rec_scores": [0.5, 0.7, 0.9]}}}
    df = spark.createDataFrame([(1, json.dumps(page)), (2, "{"), (3, None), (4, "{}")], "cache_id bigint, page_json string")
    got = ocr_json.layout_elements(df, ("cache_id",)).orderBy("list_pos").collect()
    assert [(r.type, r.text, r.order_index, round(r.confidence, 3)) for r in got] == [("title", "A", 2, 0.6), ("text", "", 2, 0.7)]
    assert got[0].bbox.x2 == 10.0
    line = {"elements": [{"type": "text", "text": "x", "bbox": {"x1": 1, "y1": 2, "x2": 3, "y2": 4}, "confidence": "bad", "order_index": 5}]}
    e = ocr_json.line_elements(spark.createDataFrame([(1, json.dumps(line))], "page_id bigint, raw_json string"), ("page_id",))
    back = ocr_json.line_elements(ocr_json.line_json(e, ("page_id",)), ("page_id",))
    assert e.first().confidence is None and e.collect() == back.collect()


def test_files(spark, tmp_path):
    import io
    import zipfile

    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.pdf").write_bytes(b"1")
    (tmp_path / "in" / "sub" / "b.pdf").write_bytes(b"22")
    assert sorted((r.stem, r.length) for r in files.listing(spark, str(tmp_path / "in")).collect()) == [("a", 1), ("b", 2)]
    assert files.expand({"k": "${A:-x}/${B:-y}", "l": ["${A}"]}, {"A": ""}) == {"k": "/y", "l": ["${A}"]}
    assert files.settings({"merge": False, "odd": 1}).extra == {"odd": 1}
    meta = {"title": "题", "author": "A", "lang": "zh", "rights": None, "date": "2019.6"}
    assert files.read_meta(files.write_meta(meta)) == {k: v for k, v in meta.items() if v} and files.read_meta(None) == {}
    books = spark.createDataFrame([("b", "T", None, None, "# One {#ch-1}\n\ntext & more")], "book_id string, title string, author string, lang string, book_md string")
    z = zipfile.ZipFile(io.BytesIO(files.epubs(books).first().epub))
    assert z.namelist()[0] == "mimetype" and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED and b"text &amp; more" in z.read("text.xhtml")

    class Engine:
        def open(self):
            self.n = 0

        def read(self, image):
            if not image:
                raise ValueError("empty")
            return "{}"

        def close(self):
            pass

    files.register_reader("x", Engine)
    got = {r.path: (r.page_json, r.error) for r in files.recognise(spark.createDataFrame([("p", bytearray(b"1")), ("q", bytearray(b""))], "path string, content binary"), files.reader("x")).collect()}
    assert got == {"p": ("{}", None), "q": (None, "empty")}
    assert random.Random(1).random() != 2


def test_lines_and_pages(spark):
    df = lines(spark, "a\n<!-- page: 3 -->\nb\n\n# T {#ch-1}\n\n![x](images/y.png)\nfirst\nsecond\n# U {#ch-2}")
    assert [r.page_index for r in review.page_of_lines(df).orderBy("line_no").collect()] == [None] + [3] * 9
    assert {r.line_no: r.context for r in review.chapter_contexts(df).collect()} == {4: "first\nsecond", 9: ""}
    assert [(r.place, r.name, r.anchor) for r in toc.chapter_anchors(df).orderBy("place").collect()] == [(4, "T", "#ch-1"), (9, "U", "#ch-2")]


def test_contents_region_is_linked_once(spark):
    md = "front\n# 目录\n第一卷南山经／2第二卷西山经／16\n:::\n::: {.chapter}\n# 第一卷南山经 {#ch-1}\nbody"
    df = lines(spark, md)
    assert [(r.first, r.end) for r in toc.regions(df).collect()] == [(1, 5)]
    once = toc.linkify(df).orderBy("line_no").collect()
    text = "\n".join(r.line for r in once)
    assert text == "front\n# 目录\n\n::: {.toc-list}\n- [第一卷南山经](#ch-1)\n- 第二卷西山经\n:::\n\n:::\n\n::: {.chapter}\n# 第一卷南山经 {#ch-1}\nbody"
    assert "\n".join(r.line for r in toc.linkify(lines(spark, text)).orderBy("line_no").collect()) == text
    assert [r.entry for r in review.toc_sections(lines(spark, "### 目录\n条目……12\n次项/3\n# 章")).orderBy("line_no").collect()] == ["条目", "次项"]


def test_answers_are_merged_and_applied(spark):
    rows = [(1, 0, "title_fixes", '["a"]'), (1, 1, "title_fixes", '["b","c"]'), (1, 0, "metadata", '{"title":"x"}'), (1, 1, "metadata", "{}"), (1, 2, "other", None)]
    got = {r.key: r.value for r in review.merge_corrections(spark.createDataFrame(rows, "doc bigint, batch int, key string, value string")).collect()}
    assert got == {"title_fixes": '["a","b","c"]', "metadata": '{"title":"x"}'}
    books = spark.createDataFrame([("b", "T", "A")], "book_id string, title string, author string")
    fixed = review.metadata_fixes(books, spark.createDataFrame([("b", " N ", " ")], "book_id string, title string, author string")).first()
    assert (fixed.title, fixed.author) == ("N", "A")
    calls = []

    def call(items):
        calls.append(len(items))
        return json.dumps({"n": items}), len(items) <= 2

    assert [x["n"] for x in review.ask([1, 2, 3, 4, 5], call)] == [[1, 2], [3], [4, 5]] and calls == [5, 2, 3, 1, 2]
    marked = spark.createDataFrame([(1, ">[low-confidence] x"), (2, "ok")], "i int, book_md string")
    assert review.wants_second_review(marked, True, False).count() == 1 and review.wants_second_review(marked, True, True).count() == 0


def test_contained_equals_all_pairs(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randrange(1, n)))
    a, b = [(rng.choice("xy"), word(7)) for _ in range(40)], [(rng.choice("xy"), word(14)) for _ in range(60)]
    want = {(k, s, t) for k, s in a for m, t in b if k == m and s in t}
    make = lambda rows: spark.createDataFrame(rows, "key string, text string")
    assert {tuple(r) for r in toc.contained(make(a), make(b)).collect()} == want


def test_mismatches_of_a_long_book_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(review, "ENTRY_BLOCK", 7)
    monkeypatch.setattr(review, "NAME_BLOCK", 5)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh 𠀀") for _ in range(rng.randrange(1, n)))
    entries = [(rng.choice("xyz"), k, word(9)) for k in range(150)] + [("x", 900, "aaaa"), ("x", 901, None), ("y", 902, "")]
    titles = [(rng.choice("xy"), k, word(9)) for k in range(120)] + [("x", 500, "aaaa"), ("x", 501, None)]
    want = set()
    for b, pos, t in entries:
        met = [(-len((set(t) or {""}) & (set(n) or {""})) / max(len(t), len(n), 1), place, n) for c, place, n in titles if c == b and n is not None and t is not None]
        if met and min(met)[0] > -0.5:
            want.add((b, pos, t, min(met)[2], -min(met)[0]))
    got = review.toc_mismatches(spark.createDataFrame(entries, "book_id string, pos int, title string"), spark.createDataFrame(titles, "book_id string, place int, name string"))
    assert want and {tuple(r) for r in got.collect()} == want


def test_ranks_equal_all_pairs(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(rng.randrange(0, n)))
    entries = [(rng.choice("xyz"), k, word(9)) for k in range(120)] + [("x", 900, None), ("x", 901, "qrst1")]
    anchors = [(rng.choice("xy"), k, word(12).strip(), f"#{k}") for k in range(60)] + [("x", 90, "qrst2", "#90"), ("x", 91, "qrst3", "#91")]

    def rank(t, n):
        return 1 if t == n else 2 if t.replace(" ", "") == n.replace(" ", "") else 3 if t in n or n in t else 4 if len(t) >= 4 and t[:4] == n[:4] else None

    want = set()
    for b, pos, t in entries:
        met = [(rank(t, n), place, a) for c, place, n, a in anchors if t and n and c == b and rank(t, n)]
        want |= {(b, pos, t, *((min(met)[0], min(met)[2]) if met else (None, None)))} if t else set()
    linked = toc.link(spark.createDataFrame(entries, "book_id string, pos int, title string"), spark.createDataFrame(anchors, "book_id string, place int, name string, anchor string"))
    assert {r[3] for r in want} == {1, 2, 3, 4, None} and {tuple(r) for r in linked.collect()} == want


def test_groups_of_the_lengths_asked_for(spark):
    row = spark.range(1).select(toc._grams(F.lit("abcab"), F.array(F.lit(2), F.lit(4))), toc._grams(F.lit("ab"), F.array(F.lit(4)))).first()
    assert sorted(row[0]) == ["ab", "abca", "bc", "bcab", "ca"] and row[1] == []


def test_links_do_not_read_the_anchors_again(spark):
    entries = spark.createDataFrame([("b", 1, "One")], "book_id string, pos int, title string")
    anchors = spark.range(3).select(F.lit("b").alias("book_id"), F.col("id").alias("place"), F.concat(F.lit("One "), "id").alias("name"), F.lit("#1").alias("anchor"))
    assert "Range" not in toc.link(entries, anchors)._jdf.queryExecution().optimizedPlan().toString()
