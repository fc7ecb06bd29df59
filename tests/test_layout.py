import random

from pyspark.sql import functions as F

from quire.operators import assemble, classify, flags, outline, store


def pages(spark, n=6, height=2000.0):
    return spark.createDataFrame([(i, "b", i, 1000.0, height) for i in range(n)], "page_id bigint, book_id string, page_index int, width double, height double")


def box(y):
    return (100.0, y, 900.0, y + 40.0)


def test_confidence_tiers(make_elements):
    rows = [dict(text="x", confidence=0.2), dict(text="xy", confidence=0.2), dict(text="", confidence=0.4), dict(text="x", confidence=0.4), dict(text="x", confidence=None), dict(text="", confidence=0.1, type="table"), dict(text=None, confidence=0.1), dict(text="x", confidence=0.9)]
    got = [(r.dropped, r.low_confidence) for r in flags.confidence_tiers(make_elements(rows)).orderBy("elem_id").collect()]
    assert got == [(True, False), (False, True), (True, False), (False, True), (False, False), (False, False), (True, False), (False, False)]


def test_running_heads_join_similar_lines(spark, make_elements):
    rows = [dict(page_index=p, list_pos=0, bbox=box(40.0), text=t) for p, t in enumerate(["The Long Road", "The Long Road", "The Lonq Road", "Other", "Another line", "The Long Road and far more text"])]
    e = flags.with_heights(make_elements(rows), pages(spark))
    got = sorted(r.line for r in flags.running_heads(flags.margin_candidates(e)).collect())
    assert got == ["The Long Road", "The Long Road", "The Lonq Road"]
    assert flags.running_heads(flags.margin_candidates(e.limit(0))).count() == 0


def test_numbers_and_labels(spark, make_elements):
    rows = [dict(bbox=box(1950.0), text=" 12 "), dict(bbox=box(900.0), text="12"), dict(type="footer", text="x"), dict(bbox=None, text="13"), dict(bbox=box(1950.0), text=None)]
    got = [r.dropped for r in flags.remove_furniture(make_elements(rows), pages(spark)).orderBy("elem_id").collect()]
    assert got == [True, False, True, False, False]


def test_levels_fold(spark, make_elements):
    rng = random.Random(3)
    for _ in range(4):
        levels = [rng.randrange(1, 6) for _ in range(12)]
        df = make_elements([dict(type="paragraph_title", text="t", list_pos=i) for i in range(12)]).join(spark.createDataFrame(list(enumerate(levels, 1)), "elem_id bigint, level int"), "elem_id")
        seen, want = set(), []
        for lvl in levels:
            while lvl > 1 and lvl - 1 not in seen:
                lvl -= 1
            seen.add(lvl)
            want.append(lvl)
        assert [r.final_level for r in outline.enforce_order(df).orderBy("elem_id").collect()] == want


def test_title_levels_promote_flat(make_elements):
    flat = make_elements([dict(type="paragraph_title", text="a"), dict(type="paragraph_title", text="b"), dict(text="body")])
    assert [r.level for r in outline.title_levels(flat).orderBy("elem_id").collect()] == [1, 1]
    mixed = make_elements([dict(type="doc_title", text="第一章 起"), dict(type="paragraph_title", text="第2节"), dict(type="paragraph_title", text="1.2.3 deep"), dict(type="paragraph_title", text="plain")])
    assert [r.level for r in outline.title_levels(mixed).orderBy("elem_id").collect()] == [1, 2, 3, 3]


def brute_merge(rows):
    import re

    out, page, weak = [], None, None
    term, line = "。！？；…\"')]!?”’）」』】", re.compile(r"[/／]\s*\d+\s*$")
    starts = re.compile(r"^(?:\s|第[一二三四五六七八九十百千0-9]+[章回节卷篇]|(?i:chapter)\s+[IVXivx0-9]+)")
    last = ""
    for r in rows:
        t = r["text"]
        open_text = out[-1][1] if out else ""
        lines = [x.strip() for x in open_text.strip().split("\n")]
        listed = sum(bool(line.search(x)) for x in lines) >= 2 or bool(line.search(next((x for x in reversed(lines) if x), "")))
        closed = not last.rstrip() or last.rstrip()[-1] in term
        if out and r["page_index"] != page and not weak and not r["low_confidence"] and not closed and t.strip() and not starts.match(t) and not listed:
            a, b = open_text.strip(), t.strip()
            han = lambda c: "一" <= c <= "鿿" or "　" <= c <= "〿" or "＀" <= c <= "￯"
            out[-1][1] = a + b if han(a[-1]) and han(b[0]) else f"{a} {b}"
        else:
            out.append([r["elem_id"], t])
        page, weak, last = r["page_index"], r["low_confidence"], t
    return [tuple(x) for x in out]


def test_merge_equals_sequential(make_elements):
    rng = random.Random(5)
    words = ["开头", "未完", "完。", "alpha", "beta", "第一章 x", " 缩进", "条目/12", "a/1\nb/2", "7", ""]
    for seed in range(6):
        rows = [dict(elem_id=i + 1, page_index=i // rng.choice([1, 1, 2]), list_pos=i, order_index=i, text=rng.choice(words if seed % 2 else words[:6]), low_confidence=rng.random() < 0.1) for i in range(25)]
        rows.sort(key=lambda r: (r["page_index"], r["order_index"], r["list_pos"]))
        got = sorted((r.elem_id, r.text) for r in assemble.merge_paragraphs(make_elements(rows)).collect())
        assert got == sorted(brute_merge(rows))


def test_cataloguing_page(spark, make_elements):
    rows = [dict(page_index=2, text="图书在版编目（CIP）数据"), dict(page_index=3, text="山 海 / 张三 ．石家庄：河北社，2019年6月\nISBN 978-7-5511-4721-7")]
    got = assemble.cataloguing(make_elements(rows)).first()
    assert (got.title, got.author, got.publisher, got.pub_date) == ("山海", "张三", "河北社", "2019.6")
    books = spark.createDataFrame([("b", None, "X", None, None, None, None, None, 3), ("c", " ", None, "P", None, None, "en", 1, None)], "book_id string, title string, author string, publisher string, pub_date string, rights string, lang string, toc_depth int, chapter_level int")
    meta = {r.book_id: r for r in assemble.metadata(books, assemble.cataloguing(make_elements(rows))).collect()}
    assert meta["b"].title == "山海" and meta["b"].chapter_level == 3 and meta["c"].title == "Untitled" and meta["c"].author == "Unknown"


def test_page_types(spark, make_elements):
    rows = [
        dict(page_index=0, type="doc_title", text="山海志"), dict(page_index=1, text="ISBN 1"), dict(page_index=2, type="paragraph_title", text="目录"), *[dict(page_index=2, text=f"第{k}卷………{k}", list_pos=10 + k) for k in (1, 2, 3)],
        dict(page_index=3, type="paragraph_title", text="前言"), dict(page_index=4, type="image", text="", bbox=(0.0, 0.0, 900.0, 1900.0)), dict(page_index=5, text="正文。"),
    ]
    books = spark.createDataFrame([("b", "山海志", "某")], "book_id string, title string, author string")
    got = {r.page_index: r.page_type for r in classify.classify(make_elements(rows), books, pages(spark, 12)).collect()}
    assert got == {0: "cover", 1: "copyright", 2: "toc", 3: "preface", 4: "illustration", 5: "body"}
    s = classify.structure(spark.createDataFrame([("b", p, t) for p, t in got.items()], "book_id string, page_index int, page_type string")).first()
    assert s.found[:2] == ["cover", "copyright"] and "appendix" in s.missing and s.unusual_order


def test_markdown_never_loses_pages(spark, make_elements):
    rows = [dict(page_index=0, text="x"), dict(page_index=1, type="image", text="", image_caption="c"), dict(page_index=2, type="doc_title", text="T"), dict(page_index=2, type="formula", text="a"), dict(page_index=2, text="", type="text"), dict(page_index=2, text="weak", low_confidence=True)]
    types = spark.createDataFrame([("b", 0, "cover"), ("b", 1, "illustration"), ("b", 2, "body"), ("b", 3, "copyright")], "book_id string, page_index int, page_type string")
    e = make_elements(rows)
    blocks = assemble.markdown_blocks(e, types, outline.title_levels(e))
    md = assemble.books_markdown(blocks).first().book_md
    assert md == "![c](images/p1_e1.png)\n\n# T {#ch-1}\n\n$$\na\n$$\n\n>[low-confidence] weak\n\n![](pages/page_0003.png)\n"
    assert assemble.lost_pages(blocks, types).count() == 0


def test_store(spark):
    log = spark.createDataFrame([("h", 0, 200, "c", 1, "2024-01-01", "a"), ("h", 0, 200, "c", 2, "2024-01-02", "b"), ("h", 0, 200, "c", 3, "2024-01-02", "c"), ("h", 1, 200, "c", 4, "2024-01-01", None)], "pdf_hash string, page_index int, dpi int, cfg_hash string, cache_id bigint, created_at string, page_json string")
    new = store.newest(log)
    assert sorted((r.page_index, r.cache_id) for r in new.collect()) == [(0, 3), (1, 4)]
    assert store.upsert(new, log.where("cache_id = 1").select(*new.columns)).where("cache_id = 1").count() == 1
    books = spark.createDataFrame([("b", "h", 3), ("n", None, 3), ("z", "q", 0)], "book_id string, pdf_hash string, total_pages int")
    assert [r.page_index for r in store.pages_to_do(books, log).collect()] == [2]
    assert len(log.select(store.config_key("dpi", "cfg_hash").alias("k")).first().k) == 40
    assert log.limit(0).select(F.count("*")).first()[0] == 0


def test_chain_keeps_every_word(spark, make_elements):
    rows = [dict(page_index=0, text="开头,未完"), dict(page_index=0, type="image", text="图说", list_pos=5), dict(page_index=1, bbox=box(30.0), text="7", list_pos=0), dict(page_index=1, text="接着。", list_pos=1), dict(page_index=1, text="", confidence=0.1, list_pos=2)]
    got = {r.elem_id: r for r in assemble.process(make_elements(rows), pages(spark)).collect()}
    assert len(got) == 5 and got[1].text == "开头，未完接着。" and got[4].dropped and got[3].dropped and got[5].dropped and got[2].image_caption == "图说" and got[2].text == "images/p0_e5.png"
    types = spark.createDataFrame([("b", 1, "cover"), ("b", 3, "cover")], "book_id string, page_index int, page_type string")
    p = pages(spark).withColumn("page_image_path", F.format_string("p%d.png", "page_index"))
    assert assemble.covers(types, p).first().cover_path == "p1.png" and assemble.covers(types.limit(0), p).first().cover_path == "p0.png"


def test_derived_queries_know_short_contents_pages(spark, make_elements, tmp_path):
    from quire.plans import reference

    rows = [dict(page_index=3, text="河上旧事／5"), dict(page_index=3, text="山中岁月／9"), dict(page_index=5, type="paragraph_title", text="河上旧事"), dict(page_index=5, text="正文。"), dict(page_index=9, type="paragraph_title", text="山中岁目"), dict(page_index=9, text="正文。")]
    make_elements(rows).write.parquet(f"{tmp_path}/elements.parquet")
    pages(spark, 12).selectExpr("*", "'p' as page_image_path", "'' as raw_json").write.parquet(f"{tmp_path}/page_results.parquet")
    spark.sql("select 'b' as book_id, '志' as title, '某' as author").write.parquet(f"{tmp_path}/books.parquet")
    q = {n: reference.QUERIES[n](spark, str(tmp_path)).collect() for n in ("page_types", "page_types_by_rule", "page_type_histogram", "book_structure")}
    assert {r.page_index: r.page_type for r in q["page_types"]} == {3: "toc", 5: "body", 9: "body"}
    assert {r.page_type: r.pages for r in q["page_type_histogram"]} == {"toc": 1, "body": 2} and q["book_structure"][0].found == "toc body"
    assert 3 in {r.page_index for r in q["page_types_by_rule"] if r.page_type != "toc"}


def test_processing_stays_a_short_plan(spark, make_elements):
    rows = [dict(page_index=p, list_pos=k, text=t, bbox=box(y)) for p in range(4) for k, (t, y) in enumerate([("The Long Road", 40.0), (f"page {p} goes on", 900.0), (str(p), 1950.0)])]
    out = assemble.process(make_elements(rows), pages(spark))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 8
    assert sorted((r.page_index, r.list_pos, r.text) for r in out.where("not dropped").collect()) == [(0, 1, "page 0 goes on page 1 goes on page 2 goes on page 3 goes on")]
