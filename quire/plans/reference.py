"""Queries of the layout operators, each beside the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import assemble, classify, flags, images, modules, outline, review, store, toc
from quire.runtime import table
from quire.sources import ocr_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _elements(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "elements").dropDuplicates(["elem_id"])


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page_results").drop("raw_json").dropDuplicates(["page_id"])


def _books(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "books").dropDuplicates(["book_id"])


def _texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "book_content").dropDuplicates(["content_id"])


def _lines(s: SparkSession, d: str) -> DataFrame:
    return review.lines_of(_texts(s, d))


# Parts of the SQL. Exact repeats of a row are taken once, as in the queries.
E = "e AS (SELECT * FROM elements QUALIFY row_number() OVER (PARTITION BY elem_id) = 1)"
P = "p AS (SELECT page_id, book_id, page_index, width, height FROM page_results QUALIFY row_number() OVER (PARTITION BY page_id) = 1)"
B = "b AS (SELECT * FROM books QUALIFY row_number() OVER (PARTITION BY book_id) = 1)"
C = "c AS (SELECT * FROM book_content QUALIFY row_number() OVER (PARTITION BY content_id) = 1)"
L = C + r", l0 AS (SELECT content_id AS doc, string_split_regex(book_md, '\r?\n') AS a FROM c WHERE book_md IS NOT NULL), l AS (SELECT doc, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS line_no FROM l0)"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{T.SPACE}]+|[{T.SPACE}]+$', '', 'g')"


LIVE = "NOT coalesce(dropped, false)"
TITLE = "type IN ('doc_title', 'paragraph_title', 'content_title')"
IMAGE = "type IN ('image', 'figure', 'chart')"
CONTENT = "type IN ('text', 'paragraph_title', 'doc_title', 'content_title', 'figure_title')"
H = P + ", h AS (SELECT book_id, page_index, max(height) AS page_height FROM p GROUP BY ALL)"
MARGIN = "CASE WHEN page_height > 0 AND (bbox.y1 + bbox.y2) / 2 / page_height < 0.08 THEN 'top' WHEN page_height > 0 AND (bbox.y1 + bbox.y2) / 2 / page_height > 0.92 THEN 'bottom' END"
FURNITURE = f"(type IN ('header', 'footer', 'header_image', 'footer_image', 'number', 'footnote', 'aside_text') OR (type = 'text' OR {TITLE}) AND coalesce(regexp_matches(text, '^\\s*\\d{{1,4}}\\s*$'), false) AND coalesce({MARGIN}, '') <> '')"


@query(f"""WITH {E}, x AS (SELECT *, length({trim("coalesce(text, '')")}) AS n, {LIVE} AND type IN ('text', 'doc_title', 'paragraph_title', 'content_title') AND confidence IS NOT NULL AS m FROM e)
SELECT elem_id, coalesce(dropped, false) OR m AND (confidence < 0.3 AND n <= 1 OR confidence >= 0.3 AND confidence < 0.5 AND n = 0) AS dropped,
coalesce(low_confidence, false) OR m AND (confidence < 0.3 AND n > 1 OR confidence >= 0.3 AND confidence < 0.5 AND n > 0) AS low_confidence FROM x""")
def confidence_tiers(s, d):
    return flags.confidence_tiers(_elements(s, d)).select("elem_id", "dropped", "low_confidence")


@query(f"WITH {E}, {H} SELECT elem_id, coalesce(dropped, false) OR {FURNITURE} AS dropped FROM e LEFT JOIN h USING (book_id, page_index)")
def furniture(s, d):
    return flags.drop_furniture(flags.with_heights(_elements(s, d), _pages(s, d))).select("elem_id", "dropped")


CAND = f"cand AS (SELECT book_id, page_index, elem_id, {MARGIN} AS margin, {trim('text')} AS line FROM e LEFT JOIN h USING (book_id, page_index) WHERE {LIVE} AND type = 'text')"


@query(f"WITH {E}, {H}, {CAND} SELECT book_id, margin, line, count(DISTINCT page_index) AS pages FROM cand WHERE margin IS NOT NULL AND length(line) BETWEEN 1 AND 60 GROUP BY ALL HAVING count(DISTINCT page_index) >= 3")
def repeated_margin_lines(s, d):
    return flags.repeated_lines(flags.margin_candidates(flags.with_heights(_elements(s, d), _pages(s, d))))


@query()
def running_heads(s, d):
    return flags.running_heads(flags.margin_candidates(flags.drop_furniture(flags.with_heights(_elements(s, d), _pages(s, d))))).select("elem_id", "book_id", "margin", "line")


@query()
def live_elements(s, d):
    return flags.remove_furniture(_elements(s, d), _pages(s, d)).select("elem_id", "dropped")


@query(f"WITH {P}, {B} SELECT page_id, book_id, page_index FROM p JOIN b USING (book_id) WHERE page_index >= 2 AND page_index < total_pages - 1")
def recognised_pages(s, d):
    return flags.page_range(_pages(s, d), _books(s, d), 2, 1).select("page_id", "book_id", "page_index")


_W = lambda words: " + ".join(f"contains(page_text, '{w}')::INT" for w in words)
_ANY = lambda words: "|".join(words)
SHORT = f"(type = 'text' AND length({trim('t')}) <= 20 AND NOT regexp_matches(t, '[。！？；]'))"
FEAT = f"""{E}, {P}, {B}, i AS (SELECT book_id, CASE WHEN title <> 'Untitled' THEN title ELSE '' END AS book_title, author AS book_author FROM b),
x AS (SELECT e.*, coalesce(text, '') AS t, i.book_title, i.book_author FROM e LEFT JOIN i USING (book_id) WHERE {LIVE}),
f0 AS (SELECT book_id, page_index, count_if(type = 'text') AS n_text, count_if({CONTENT}) AS n_content, count_if({TITLE}) AS n_title, count_if({IMAGE}) AS n_image, count_if(type = 'figure_title') AS n_caption,
 sum(CASE WHEN {CONTENT} THEN length(t) ELSE 0 END) AS chars, bool_or(regexp_matches(t, '[。！？；]')) AS has_sentence, bool_or(coalesce(book_title, '') <> '' AND contains(t, coalesce(book_title, '')) AND ({TITLE} OR {SHORT})) AS has_title,
 bool_or({TITLE} AND regexp_matches({trim('t')}, '^(?:{_ANY(classify.PREFACE)})')) AS preface, bool_or({TITLE} AND regexp_matches({trim('t')}, '^(?:{_ANY(classify.APPENDIX)})')) AS appendix,
 sum(CASE WHEN {IMAGE} THEN greatest(0, bbox.x2 - bbox.x1) * greatest(0, bbox.y2 - bbox.y1) ELSE 0 END) AS image_area, max(book_title) AS book_title, max(book_author) AS book_author,
 coalesce(string_agg(CASE WHEN t <> '' THEN t END, chr(10) ORDER BY list_pos, elem_id), '') AS page_text FROM x GROUP BY book_id, page_index),
f AS (SELECT f0.*, total, coalesce(CASE WHEN page_area > 0 THEN image_area / page_area END, 0) AS image_share FROM f0 LEFT JOIN (SELECT book_id, page_index, max(width * height) AS page_area FROM p GROUP BY ALL) USING (book_id, page_index) LEFT JOIN (SELECT book_id, count(DISTINCT page_index) AS total FROM p GROUP BY ALL) USING (book_id))"""
ENTRIES = r"(len(regexp_extract_all(page_text, '(?m)^.+?[…\.·]{3,}[ \t]*\d+[ \t]*$')) + len(regexp_extract_all(page_text, '(?m)^.+?[/／][ \t]*\d+[ \t]*$')))"
NAMED = "(coalesce(book_title, '') <> '' AND contains(page_text, coalesce(book_title, '')) OR coalesce(book_author, '') <> '' AND contains(page_text, coalesce(book_author, '')))"
TYPES = f"""{FEAT}, types AS (SELECT book_id, page_index, CASE WHEN page_index < 5 AND has_title THEN CASE WHEN page_index = 0 THEN 'cover' ELSE 'frontispiece' END
 WHEN page_index >= total - 3 AND {_W(classify.BACK_COVER)} >= 2 THEN 'back_cover' WHEN {_W(classify.COPYRIGHT)} >= 1 THEN 'copyright' WHEN page_index < 5 AND n_text <= 10 AND {_W(classify.PUBLISHING)} >= 2 THEN 'copyright'
 WHEN page_index = 0 AND n_text <= 3 AND n_title = 0 AND n_image > 0 THEN 'cover'
 WHEN page_index BETWEEN 1 AND 2 AND NOT has_sentence AND ({NAMED} AND n_content <= 5 OR n_image > 0 AND n_text <= 5 OR n_image = 0 AND n_text <= 5 AND n_title = 0) THEN 'frontispiece'
 WHEN {_W(classify.TOC_WORDS)} >= 1 AND {ENTRIES} >= 3 OR {ENTRIES} >= 5 THEN 'toc' WHEN preface THEN 'preface' WHEN appendix THEN 'appendix'
 WHEN n_image > 0 AND (n_content = 0 OR image_share > 0.6 AND n_content <= 2) THEN 'illustration' WHEN n_content > 0 AND (n_title > 0 OR chars >= 50 OR has_sentence OR n_caption > 0) THEN 'body' ELSE 'unknown' END AS page_type FROM f)"""


@query(f"WITH {FEAT} SELECT book_id, page_index, n_text, n_content, n_title, n_image, n_caption, chars, has_sentence, has_title, preface, appendix, round(image_share, 6) AS image_share, total FROM f")
def page_features(s, d):
    f = classify.page_features(_elements(s, d), _books(s, d), _pages(s, d))
    return f.select("book_id", "page_index", "n_text", "n_content", "n_title", "n_image", "n_caption", "chars", "has_sentence", "has_title", "preface", "appendix", F.round("image_share", 6).alias("image_share"), "total")


def _types(s, d):
    return classify.classify(_elements(s, d), _books(s, d), _pages(s, d))


@query(f"WITH {TYPES} SELECT * FROM types")
def page_types_by_rule(s, d):
    return classify.classify(_elements(s, d), _books(s, d), _pages(s, d), fuzzy=False)


@query()
def page_types(s, d):
    return _types(s, d)


@query(f"WITH {TYPES} SELECT page_type, count(*) AS pages FROM types GROUP BY ALL")
def page_type_histogram(s, d):
    return _types(s, d).groupBy("page_type").agg(F.count("*").alias("pages"))


_RANK = "CASE page_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(classify.ORDER)) + " END"


@query(f"""WITH {TYPES}, g AS (SELECT book_id, page_type, min(page_index) AS first FROM types WHERE page_type <> 'unknown' GROUP BY ALL), a AS (SELECT book_id, list(page_type ORDER BY first, page_type) AS f, list({_RANK} ORDER BY first, page_type) FILTER ({_RANK} IS NOT NULL) AS r FROM g GROUP BY ALL)
SELECT book_id, array_to_string(f, ' ') AS found, array_to_string(list_filter([{", ".join(f"'{t}'" for t in classify.ORDER)}], lambda x: NOT list_contains(f, x)), ' ') AS missing, coalesce(r, []) <> list_sort(coalesce(r, [])) AS unusual_order FROM a""")
def book_structure(s, d):
    return classify.structure(_types(s, d)).select("book_id", F.concat_ws(" ", "found").alias("found"), F.concat_ws(" ", "missing").alias("missing"), "unusual_order")


HT = "(bbox.y2 - bbox.y1)"
NUMBERED = rf"regexp_extract({trim('text')}, '^(\d+(?:\.\d+)*)[{T.SPACE}]+[^{T.SPACE}]', 1)"
LEVELS = f"""m AS (SELECT book_id, median({HT}) AS med FROM e WHERE {LIVE} AND type = 'text' AND {HT} > 0 GROUP BY ALL),
v0 AS (SELECT e.*, {HT} / CASE WHEN med > 0 THEN med END AS ratio, {NUMBERED} AS num FROM e LEFT JOIN m USING (book_id) WHERE {LIVE} AND {TITLE} AND {trim("coalesce(text, '')")} <> ''),
v1 AS (SELECT *, CASE WHEN regexp_matches({trim('text')}, '^(?i:{T.CHAPTER})') OR regexp_matches({trim('text')}, '^(?i)Chapter\\s+[IVX0-9]+') THEN 1 WHEN regexp_matches({trim('text')}, '^{T.SECTION}') THEN 2 WHEN num <> '' THEN length(num) - length(replace(num, '.', '')) + 1 WHEN ratio >= 2.0 THEN 1 WHEN ratio >= 1.4 THEN 2 ELSE 3 END AS rule_level FROM v0),
v AS (SELECT *, CASE WHEN min(rule_level) OVER (PARTITION BY book_id) = 3 AND max(rule_level) OVER (PARTITION BY book_id) = 3 THEN 1 ELSE rule_level END AS level FROM v1)"""


@query(f"WITH {E}, {LEVELS} SELECT elem_id, book_id, rule_level::INT AS rule_level, level::INT AS level FROM v")
def title_levels(s, d):
    return outline.title_levels(_elements(s, d)).select("elem_id", "book_id", "rule_level", "level")


@query(f"WITH {E}, {LEVELS} SELECT elem_id, book_id, row_number() OVER (PARTITION BY book_id ORDER BY page_index, list_pos, elem_id) AS chapter FROM v WHERE level = 1")
def chapter_numbers(s, d):
    return outline.chapter_numbers(outline.title_levels(_elements(s, d))).select("elem_id", "book_id", F.col("chapter").cast("bigint").alias("chapter"))


@query(f"WITH {E}, {LEVELS}, n AS (SELECT book_id, count_if(level = 1) AS h1, count_if(level = 2) AS h2, count_if(level = 3) AS h3 FROM v GROUP BY ALL) SELECT *, CASE WHEN h3 > 0 THEN 3 WHEN h2 > 0 THEN 2 ELSE 1 END AS toc_depth, CASE WHEN h1 >= 2 THEN 1 WHEN h2 > 0 THEN 2 ELSE 1 END AS chapter_level FROM n")
def level_histogram(s, d):
    return outline.level_histogram(outline.title_levels(_elements(s, d)))


_FRONT = "|".join(outline.FRONT_MATTER)


@query(f"""WITH RECURSIVE {E}, {LEVELS}, tt AS (SELECT book_id, elem_id, level, CASE WHEN regexp_matches(text, '^\\s*(?:{_FRONT})') THEN 2 ELSE 1 END AS low, row_number() OVER (PARTITION BY book_id ORDER BY page_index, list_pos, elem_id) AS rn FROM v),
ff AS (SELECT book_id, elem_id, level, rn, CASE WHEN level <= low THEN level ELSE low END AS final_level, [CASE WHEN level <= low THEN level ELSE low END] AS seen FROM tt WHERE rn = 1
UNION ALL SELECT book_id, elem_id, level, rn, new, list_append(seen, new) FROM (SELECT tt.book_id, tt.elem_id, tt.level, tt.rn, ff.seen, CASE WHEN tt.level <= tt.low THEN tt.level ELSE coalesce(list_max(list_filter(range(tt.low + 1, tt.level + 1), lambda k: list_contains(ff.seen, k - 1))), tt.low) END AS new FROM tt JOIN ff ON tt.book_id = ff.book_id AND tt.rn = ff.rn + 1))
SELECT elem_id, book_id, level::INT AS level, final_level::INT AS final_level FROM ff""")
def ordered_levels(s, d):
    return outline.enforce_order(outline.title_levels(_elements(s, d))).select("elem_id", "book_id", "level", "final_level")


@query(f"WITH {E} SELECT book_id, page_index, md5(string_agg(text, chr(10) ORDER BY list_pos, elem_id)) AS page_md5 FROM e WHERE {LIVE} AND coalesce(text, '') <> '' GROUP BY ALL")
def page_texts(s, d):
    return assemble.page_texts(_elements(s, d)).select("book_id", "page_index", F.md5("page_text").alias("page_md5"))


@query()
def merged_paragraphs(s, d):
    return assemble.merge_paragraphs(flags.confidence_tiers(_elements(s, d)))


@query()
def cataloguing(s, d):
    return assemble.cataloguing(_elements(s, d))


@query(f"""WITH {B} SELECT book_id, coalesce(nullif({trim('title')}, ''), 'Untitled') AS title, coalesce(nullif({trim('author')}, ''), 'Unknown') AS author, nullif({trim('publisher')}, '') AS publisher, nullif({trim('pub_date')}, '') AS pub_date, nullif({trim('rights')}, '') AS rights, coalesce(lang, 'zh-CN') AS lang, coalesce(toc_depth, 2) AS toc_depth, coalesce(chapter_level, 1) AS chapter_level FROM b""")
def file_metadata(s, d):
    return assemble.metadata(_books(s, d), assemble.cataloguing(_elements(s, d)).limit(0))


@query()
def book_metadata(s, d):
    return assemble.metadata(_books(s, d), assemble.cataloguing(_elements(s, d)))


DECO = "page_type IN ('frontispiece', 'copyright', 'illustration', 'back_cover')"
BLOCKS = f"""{TYPES}, {LEVELS.replace("m AS (", "med0 AS (", 1).replace("LEFT JOIN m USING", "LEFT JOIN med0 USING")}, im AS (SELECT book_id, page_index, bool_or({IMAGE}) AS has_image FROM e WHERE {LIVE} GROUP BY ALL),
pk AS (SELECT book_id, page_index FROM types LEFT JOIN im USING (book_id, page_index) WHERE {DECO} AND NOT (page_type = 'illustration' AND coalesce(has_image, false))),
k0 AS (SELECT e.*, coalesce(e.order_index, 0) AS ord, {trim("coalesce(e.text, '')")} AS t, least(coalesce(v.level, 3), 6) AS depth FROM e LEFT JOIN types USING (book_id, page_index) LEFT JOIN (SELECT elem_id, level FROM v) v USING (elem_id) WHERE NOT coalesce(e.dropped, false) AND coalesce(page_type, 'unknown') <> 'cover' AND NOT EXISTS (SELECT 1 FROM pk WHERE pk.book_id = e.book_id AND pk.page_index = e.page_index)),
k AS (SELECT *, sum(CASE WHEN {TITLE} AND depth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY page_index, ord, list_pos, elem_id) AS ch FROM k0 WHERE t <> '' OR {IMAGE}),
blocks AS (SELECT book_id, page_index, elem_id, ord, list_pos, CASE WHEN {TITLE} THEN repeat('#', depth::INT) || ' ' || t || CASE WHEN depth = 1 THEN ' {{#ch-' || ch || '}}' ELSE '' END WHEN {IMAGE} THEN '![' || coalesce(image_caption, '') || '](images/p' || page_index || '_e' || list_pos || '.png)' WHEN type IN ('formula', 'display_formula') THEN '$$' || chr(10) || t || chr(10) || '$$' WHEN coalesce(low_confidence, false) THEN '>[low-confidence] ' || t ELSE t END AS block FROM k
 UNION ALL SELECT book_id, page_index, NULL, 0, 0, '![](pages/page_' || lpad(page_index::VARCHAR, 4, '0') || '.png)' FROM pk)"""


def _blocks(s, d):
    e = _elements(s, d)
    return assemble.markdown_blocks(e, _types(s, d), outline.title_levels(e))


@query(f"WITH {BLOCKS} SELECT book_id, page_index, elem_id, md5(block) AS block_md5 FROM blocks")
def markdown_blocks(s, d):
    return _blocks(s, d).select("book_id", "page_index", "elem_id", F.md5("block").alias("block_md5"))


@query(f"WITH {BLOCKS} SELECT book_id, md5(rtrim(string_agg(block, chr(10) || chr(10) ORDER BY page_index, ord, list_pos, coalesce(elem_id, -1), block), ' ') || chr(10)) AS book_md5 FROM blocks GROUP BY ALL")
def books_markdown(s, d):
    return assemble.books_markdown(_blocks(s, d)).select("book_id", F.md5("book_md").alias("book_md5"))


@query(f"WITH {BLOCKS} SELECT book_id, page_index, page_type FROM types WHERE {DECO} AND NOT EXISTS (SELECT 1 FROM blocks WHERE blocks.book_id = types.book_id AND blocks.page_index = types.page_index)")
def lost_pages(s, d):
    return assemble.lost_pages(_blocks(s, d), _types(s, d))


@query("SELECT pdf_hash, page_index, dpi, cfg_hash, max(cache_id) AS cache_id FROM (SELECT *, rank() OVER (PARTITION BY pdf_hash, page_index, dpi, cfg_hash ORDER BY created_at DESC) AS r FROM page_cache) WHERE r = 1 GROUP BY ALL")
def cache_newest(s, d):
    return store.newest(table(s, d, "page_cache").drop("page_json")).select("pdf_hash", "page_index", "dpi", "cfg_hash", "cache_id")


@query(f"WITH {B} SELECT book_id, pdf_hash, page_index::INT AS page_index FROM (SELECT book_id, pdf_hash, unnest(range(total_pages)) AS page_index FROM b WHERE pdf_hash IS NOT NULL AND total_pages > 0) w WHERE NOT EXISTS (SELECT 1 FROM page_cache c WHERE c.pdf_hash = w.pdf_hash AND c.page_index = w.page_index)")
def pages_to_recognise(s, d):
    return store.pages_to_do(_books(s, d), table(s, d, "page_cache").drop("page_json"))


def _aliased(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(CASE WHEN json_type(x, '$.{n}') IN ('ARRAY', 'OBJECT') THEN json_extract(x, '$.{n}')::VARCHAR ELSE json_extract_string(x, '$.{n}') END, '')" for n in names) + ")"


J = """j AS (SELECT * FROM page_cache WHERE json_valid(page_json) QUALIFY row_number() OVER (PARTITION BY cache_id) = 1), r AS (SELECT cache_id, coalesce(CASE WHEN json_type(page_json, '$.res') = 'OBJECT' THEN json_extract(page_json, '$.res') END, page_json::JSON) AS j FROM j),
i AS (SELECT cache_id, unnest(CASE WHEN json_type(j, '$.parsing_res_list') = 'ARRAY' THEN json_extract(j, '$.parsing_res_list[*]') ELSE [] END) AS x, generate_subscripts(CASE WHEN json_type(j, '$.parsing_res_list') = 'ARRAY' THEN json_extract(j, '$.parsing_res_list[*]') ELSE [] END, 1) - 1 AS list_pos FROM r)"""


def _layout(s, d):
    return ocr_json.layout_elements(table(s, d, "page_cache").dropDuplicates(["cache_id"]), ("cache_id",))


@query(f"""WITH {J} SELECT cache_id, list_pos::INT AS list_pos, coalesce({_aliased("block_label", "label")}, 'text') AS type, length(coalesce({_aliased("block_content", "content")}, '')) AS text_chars, coalesce(TRY_CAST(coalesce(json_extract_string(x, '$.block_order'), json_extract_string(x, '$.order_index')) AS INT), list_pos)::INT AS order_index FROM i WHERE json_type(x) = 'OBJECT'""")
def layout_elements(s, d):
    return _layout(s, d).select("cache_id", "list_pos", "type", F.length("text").alias("text_chars"), "order_index")


BOX = """CASE WHEN json_type(x, '$.block_bbox') = 'ARRAY' AND json_array_length(x, '$.block_bbox') >= 4 THEN json_extract(x, '$.block_bbox') WHEN json_type(x, '$.block_bbox') IS NULL AND json_type(x, '$.bbox') = 'ARRAY' AND json_array_length(x, '$.bbox') >= 4 THEN json_extract(x, '$.bbox') END"""


@query(f"""WITH {J}, k AS (SELECT i.cache_id, list_pos, list_transform(coalesce(TRY_CAST({BOX} AS DOUBLE[]), [0, 0, 0, 0])[1:4], lambda a: trunc(a)) AS q, TRY_CAST(json_extract(r.j, '$.overall_ocr_res.rec_boxes') AS DOUBLE[][]) AS rb, TRY_CAST(json_extract(r.j, '$.overall_ocr_res.rec_scores') AS DOUBLE[]) AS rs,
 TRY_CAST(json_extract(r.j, '$.layout_det_res.boxes[*].coordinate') AS VARCHAR[]) AS lc, json_extract_string(r.j, '$.layout_det_res.boxes[*].score') AS ls, json_extract(r.j, '$.layout_det_res.boxes[*]') AS lb FROM i JOIN r USING (cache_id) WHERE json_type(x) = 'OBJECT'),
n AS (SELECT *, list_filter(range(1, least(len(coalesce(rb, [])), len(coalesce(rs, []))) + 1), lambda z: rs[z] IS NOT NULL AND (trunc(rb[z][1]) + trunc(rb[z][3])) / 2 BETWEEN q[1] AND q[3] AND (trunc(rb[z][2]) + trunc(rb[z][4])) / 2 BETWEEN q[2] AND q[4]) AS hit,
 list_filter(lb, lambda b: json_type(b, '$.coordinate') = 'ARRAY' AND TRY_CAST(json_extract_string(b, '$.score') AS DOUBLE) IS NOT NULL AND (list_transform(TRY_CAST(json_extract(b, '$.coordinate') AS DOUBLE[])[1:4], lambda a: trunc(a)) = q OR list_transform(TRY_CAST(json_extract(b, '$.coordinate') AS DOUBLE[])[1:4], lambda a: round_even(a, 0)) = q)) AS same FROM k)
SELECT cache_id, list_pos::INT AS list_pos, round(coalesce(list_avg(list_transform(hit, lambda z: rs[z])), TRY_CAST(json_extract_string(same[len(same)], '$.score') AS DOUBLE)), 6) AS confidence FROM n""")
def layout_confidence(s, d):
    return _layout(s, d).select("cache_id", "list_pos", F.round("confidence", 6).alias("confidence"))


@query("""WITH j AS (SELECT page_id, coalesce(CASE WHEN json_type(raw_json, '$.res') = 'OBJECT' THEN json_extract(raw_json, '$.res') END, raw_json::JSON) AS j FROM (SELECT * FROM page_results WHERE json_valid(raw_json) QUALIFY row_number() OVER (PARTITION BY page_id) = 1)),
i AS (SELECT page_id, unnest(CASE WHEN json_type(j, '$.elements') = 'ARRAY' THEN json_extract(j, '$.elements[*]') ELSE [] END) AS x, generate_subscripts(CASE WHEN json_type(j, '$.elements') = 'ARRAY' THEN json_extract(j, '$.elements[*]') ELSE [] END, 1) - 1 AS list_pos FROM j)
SELECT page_id, list_pos::INT AS list_pos, coalesce(nullif(json_extract_string(x, '$.type'), ''), 'text') AS type, coalesce(TRY_CAST(json_extract_string(x, '$.order_index') AS INT), list_pos)::INT AS order_index, round(TRY_CAST(json_extract_string(x, '$.confidence') AS DOUBLE), 6) AS confidence FROM i WHERE json_type(x) = 'OBJECT'""")
def line_elements(s, d):
    rows = ocr_json.line_elements(table(s, d, "page_results").where("raw_json is not null").dropDuplicates(["page_id"]), ("page_id",))
    return rows.select("page_id", "list_pos", "type", "order_index", F.round("confidence", 6).alias("confidence"))


@query()
def line_texts(s, d):
    rows = ocr_json.line_elements(table(s, d, "page_results").where("raw_json is not null").dropDuplicates(["page_id"]), ("page_id",))
    return rows.select("page_id", "list_pos", "text", "bbox")


SHORT_LINE = f"(length({trim('line')}) <= 30 AND NOT regexp_matches({trim('line')}, '(?:。|！|？|;|；|\\.)$'))"
BODY = f"({trim('line')} <> '' AND NOT regexp_matches({trim('line')}, '^(?:#|!|:::|\\$\\$|<table|<!--|>\\[low-confidence\\] )'))"
HEAD = r"^(#{1,6})[ \t]+(.+?)(?:[ \t]+\{#(ch-\d+)\})?[ \t]*$"
NEXT = f"{trim('n')}"
ISSUE = rf"""CASE WHEN regexp_matches(title, '[©®™□○◇●〼\*\?]') THEN 'ocr_error' WHEN length({trim('title')}) <= 2 THEN 'too_short'
 WHEN {NEXT} <> '' AND NOT regexp_matches({NEXT}, '^(?:#|:::|!\[)') AND (regexp_matches({NEXT}, '^(?:——|—|--|～)') OR length({NEXT}) <= 30 AND NOT regexp_matches({NEXT}, '(?:。|！|？|;|；|\.)$')) THEN 'split_title' ELSE 'normal' END"""
HEADS = f"hh AS (SELECT doc, line_no, length(regexp_extract(line, '{HEAD}', 1)) AS level, regexp_extract(line, '{HEAD}', 2) AS title, nullif(regexp_extract(line, '{HEAD}', 3), '') AS anchor, coalesce(n, '') AS n FROM (SELECT *, lead(line) OVER (PARTITION BY doc ORDER BY line_no) AS n FROM l) WHERE regexp_matches(line, '{HEAD}'))"
TI = f"ti AS (SELECT doc, 'T-' || row_number() OVER (PARTITION BY doc ORDER BY line_no) AS id, line_no, level, title, anchor, issue FROM (SELECT *, {ISSUE} AS issue FROM hh) WHERE level = 1 OR issue <> 'normal')"
IDENT = "doc, id, line_no::INT AS line_no"


@query(f"WITH {L}, {HEADS}, {TI} SELECT {IDENT}, level::INT AS level, title, anchor, issue FROM ti")
def title_issues(s, d):
    return review.title_issues(_lines(s, d))


LOWS = f"""q AS (SELECT *, starts_with(line, '>[low-confidence] ') AS low, substr(line, {len(review.LOW) + 1}) AS text FROM l), lc AS (SELECT doc, 'LC-' || row_number() OVER (PARTITION BY doc ORDER BY line_no) AS id, line_no, text FROM q WHERE low AND {trim('text')} <> '')"""


@query(f"WITH {L}, {LOWS} SELECT {IDENT}, md5(text) AS text_md5, (length(text) + 1)::INT AS max_length, greatest(2, length(text) // 3)::INT AS max_edits, (length(text) - length(translate(text, '*?□○◇●〼', '')))::INT AS wildcards FROM lc")
def low_confidence_issues(s, d):
    return review.low_confidence_issues(_lines(s, d)).select("doc", "id", "line_no", F.md5("text").alias("text_md5"), "max_length", "max_edits", "wildcards")


CL = f"""sh AS (SELECT *, {BODY} AND {SHORT_LINE} AS short FROM l), rn AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc, short ORDER BY line_no) AS run FROM sh), cl AS (SELECT doc, min(line_no)::INT AS start_line, max(line_no)::INT AS end_line, count(*) AS line_count, arg_min({trim('line')}, line_no) AS sample FROM rn WHERE short GROUP BY doc, run HAVING count(*) >= 3)"""


@query(f"WITH {L}, {CL} SELECT *, 'P-' || row_number() OVER (PARTITION BY doc ORDER BY start_line) AS id FROM cl")
def short_line_clusters(s, d):
    return review.short_line_clusters(_lines(s, d))


CS = f"""bo AS (SELECT *, sum(CASE WHEN {BODY} THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS bodies, length(regexp_extract(line, '^(#{{1,6}})[ \\t]+[^{T.SPACE}]', 1)) AS level FROM l),
hx AS (SELECT *, lead(level) OVER w AS nl, lead(bodies) OVER w AS nb, lead(line_no) OVER w AS nn FROM bo WHERE level > 0 WINDOW w AS (PARTITION BY doc ORDER BY line_no)), ci AS (SELECT doc, 'empty_chapter' AS issue, line_no FROM hx WHERE level = 1 AND nl = 1 AND nb = bodies UNION ALL SELECT doc, 'level_jump', nn FROM hx WHERE level = 1 AND nl >= 3)"""


@query(f"WITH {L}, {CS} SELECT doc, issue, line_no::INT AS line_no, 'CS-' || row_number() OVER (PARTITION BY doc ORDER BY line_no, issue) AS id FROM ci")
def chapter_issues(s, d):
    return review.chapter_issues(_lines(s, d))


IR = r"""ir0 AS (SELECT doc, line_no, regexp_extract(line, '^\s*!\[([^\]]*)\]\((images/[^)]+)\)\s*$', 1) AS alt, regexp_extract(line, '^\s*!\[([^\]]*)\]\((images/[^)]+)\)\s*$', 2) AS path FROM l WHERE regexp_matches(line, '^\s*!\[([^\]]*)\]\((images/[^)]+)\)\s*$')), ir AS (SELECT *, count(*) OVER (PARTITION BY doc, path) AS refs FROM ir0)"""


@query(f"WITH {L}, {IR} SELECT doc, path, line_no::INT AS line_no, alt, refs FROM ir")
def image_refs(s, d):
    return review.image_refs(_lines(s, d))


@query(f"WITH {L}, {IR}, {HEADS} SELECT ir.doc, ir.line_no::INT AS line_no, path, min(hh.line_no)::INT AS title_line, arg_min(title, hh.line_no) AS title FROM ir JOIN hh ON hh.doc = ir.doc AND level = 1 AND hh.line_no BETWEEN ir.line_no - 3 AND ir.line_no + 3 GROUP BY ALL")
def decorated_titles(s, d):
    return review.decorated_titles(_lines(s, d))


@query(f"WITH {L}, {HEADS}, {TI}, {LOWS}, {CL}, {CS} SELECT doc, 'titles' AS kind, count(*) AS n FROM ti GROUP BY doc UNION ALL SELECT doc, 'low_confidence', count(*) FROM lc GROUP BY doc UNION ALL SELECT doc, 'paragraphs', count(*) FROM cl GROUP BY doc UNION ALL SELECT doc, 'chapters', count(*) FROM ci GROUP BY doc")
def issue_totals(s, d):
    lines = _lines(s, d)
    return review.issue_totals(("titles", review.title_issues(lines)), ("low_confidence", review.low_confidence_issues(lines)), ("paragraphs", review.short_line_clusters(lines)), ("chapters", review.chapter_issues(lines)))


@query(f"WITH {L}, {HEADS}, {TI} SELECT doc, 'titles' AS kind, id, (row_number() OVER (PARTITION BY doc ORDER BY line_no) - 1) // 5 AS batch FROM ti")
def title_batches(s, d):
    return review.batches(review.title_issues(_lines(s, d)), "titles")


@query(f"WITH {L}, {LOWS}, o AS (SELECT l.doc, l.line_no, coalesce(lc.text, l.line) AS line FROM l LEFT JOIN lc ON lc.doc = l.doc AND lc.line_no = l.line_no) SELECT doc, md5(string_agg(line, chr(10) ORDER BY line_no)) AS md5 FROM o GROUP BY doc")
def fixes_applied(s, d):
    lines = _lines(s, d)
    fixes = review.low_confidence_issues(lines).select("doc", "line_no", F.col("text").alias("new_line"), F.lit(1).alias("priority"))
    out = review.apply_fixes(lines, fixes)
    return out.groupBy("doc").agg(F.md5(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]))).alias("md5"))


@query(f"WITH {L}, {IR}, g AS (SELECT l.*, EXISTS (SELECT 1 FROM ir WHERE ir.doc = l.doc AND ir.line_no = l.line_no AND refs >= 2) AS gone FROM l), a AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc ORDER BY line_no), false) AS after FROM g) SELECT doc, count(*) AS kept_lines FROM a WHERE NOT gone AND NOT (after AND {trim('line')} = '') GROUP BY doc")
def decorations_removed(s, d):
    lines = _lines(s, d)
    return review.remove_images(lines, review.image_refs(lines).where("refs >= 2")).groupBy("doc").agg(F.count("*").alias("kept_lines"))


@query(f"WITH {L}, n AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{'|'.join(images.KEYWORDS)}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - CASE WHEN regexp_matches(line, '{'|'.join(images.KEYWORDS)}') THEN 1 ELSE 0 END AS near FROM l) SELECT doc, line_no::INT AS line_no FROM n WHERE near > 0 AND regexp_matches(line, '^\\s*!\\[[^\\]]*\\]\\(images/[^)]+\\)\\s*$')")
def functional_images(s, d):
    return images.near_keyword(_lines(s, d))


TE = "t AS (SELECT book_id, pos, title FROM toc_entries WHERE title IS NOT NULL AND title <> '' GROUP BY ALL)"
AN = f"an AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY page_index, list_pos, elem_id) AS place, {trim('text')} AS name, elem_id FROM v)"


def _anchors(s, d):
    titles = outline.title_levels(_elements(s, d))
    from pyspark.sql import Window as W

    return titles.select("book_id", F.row_number().over(W.partitionBy("book_id").orderBy("page_index", "list_pos", "elem_id")).alias("place"), T.trim_all(F.col("text")).alias("name"), F.concat(F.lit("#e"), "elem_id").alias("anchor"))


@query(f"""WITH {E}, {LEVELS}, {AN}, {TE}, m2 AS (SELECT t.*, place, elem_id, CASE WHEN title = name THEN 1 WHEN replace(title, ' ', '') = replace(name, ' ', '') THEN 2 WHEN contains(name, title) OR contains(title, name) THEN 3 WHEN starts_with(name, left(title, 4)) THEN 4 END AS rank FROM t JOIN an USING (book_id)),
z AS (SELECT book_id, pos, title, rank, elem_id FROM m2 WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id, pos, title ORDER BY rank, place) = 1) SELECT t.book_id, t.pos, t.title, z.rank::INT AS rank, '#e' || z.elem_id AS anchor FROM t LEFT JOIN z ON z.book_id = t.book_id AND z.pos = t.pos AND z.title = t.title""")
def toc_links(s, d):
    return toc.link(table(s, d, "toc_entries"), _anchors(s, d)).select("book_id", "pos", "title", "rank", "anchor")


@query(f"""WITH {E}, {LEVELS}, {AN}, {TE}, m2 AS (SELECT t.*, place, name, len(list_intersect(list_distinct(string_split(title, '')), list_distinct(string_split(name, '')))) / greatest(length(title), length(name), 1) AS overlap FROM t JOIN an USING (book_id)), z AS (SELECT * FROM m2 QUALIFY row_number() OVER (PARTITION BY book_id, pos, title ORDER BY overlap DESC, place) = 1) SELECT book_id, pos, title, name AS best_title, round(overlap, 6) AS overlap FROM z WHERE overlap < 0.5""")
def toc_mismatches(s, d):
    entries = table(s, d, "toc_entries").where("title is not null and title <> ''").select("book_id", "pos", "title").distinct()
    return review.toc_mismatches(entries, _anchors(s, d)).withColumn("overlap", F.round("overlap", 6))


@query(f"""WITH {E}, {LEVELS}, {AN}, {TE}, m2 AS (SELECT t.*, place, elem_id, CASE WHEN title = name THEN 1 WHEN replace(title, ' ', '') = replace(name, ' ', '') THEN 2 WHEN contains(name, title) OR contains(title, name) THEN 3 WHEN starts_with(name, left(title, 4)) THEN 4 END AS rank FROM t JOIN an USING (book_id)),
z AS (SELECT book_id, pos, title, elem_id FROM m2 WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id, pos, title ORDER BY rank, place) = 1), y AS (SELECT t.book_id, t.pos, CASE WHEN t.title IN ('山经', '海经') THEN '- **' || t.title || '**' WHEN z.elem_id IS NOT NULL THEN '- [' || t.title || '](#e' || z.elem_id || ')' ELSE '- ' || t.title END AS item FROM t LEFT JOIN z ON z.book_id = t.book_id AND z.pos = t.pos AND z.title = t.title)
SELECT book_id, '::: {{.toc-list}}' || chr(10) || string_agg(item, chr(10) ORDER BY pos, item) || chr(10) || ':::' AS toc_md FROM y GROUP BY book_id""")
def toc_rendered(s, d):
    return toc.render(toc.link(table(s, d, "toc_entries"), _anchors(s, d)))


@query()
def toc_parsed(s, d):
    lines = table(s, d, "toc_entries").dropDuplicates(["entry_id"]).where("title is not null").select(F.col("entry_id").alias("doc"), F.lit(0).alias("line_no"), F.concat_ws("／", "title", "page").alias("line"))
    return toc.parse_lines(lines)


@query(rf"""WITH {E} SELECT elem_id, regexp_matches(text, '[{T.CJK}]') AS cjk, regexp_matches(text, '[{T.HAN}]') AS han, right(regexp_replace(text, '[{T.SPACE}]+$', ''), 1) = '' OR contains('。！？；…"'')]!?”’）」』】', right(regexp_replace(text, '[{T.SPACE}]+$', ''), 1)) AS closed,
len(list_filter(string_split({trim('text')}, chr(10)), lambda x: regexp_matches({trim('x')}, '[/／]\s*\d+\s*$')))::INT AS toc_lines, nullif(length({NUMBERED}) - length(replace({NUMBERED}, '.', '')) + CASE WHEN {NUMBERED} = '' THEN 0 ELSE 1 END, 0)::INT AS depth, length(regexp_replace(text, '[#>*\-\[\]!()' || chr(123) || chr(125) || '=|`~{T.SPACE}]', '', 'g')) AS chars FROM e WHERE text IS NOT NULL""")
def text_predicates(s, d):
    t = F.col("text")
    return _elements(s, d).where("text is not null").select("elem_id", T.has_cjk(t).alias("cjk"), T.has_han(t).alias("han"), T.ends_closed(t).alias("closed"), T.toc_lines(t).alias("toc_lines"), T.numbering_depth(t).cast("int").alias("depth"), T.meaningful_chars(t).alias("chars"))


def _squeezed(x: str) -> str:
    for m in "。！？，；：":
        x = f"regexp_replace({x}, '{m}{{2,}}', '{m}', 'g')"
    return x


@query(f"WITH {E} SELECT elem_id, md5({_squeezed('text')}) AS md5 FROM e WHERE text IS NOT NULL")
def squeezed_marks(s, d):
    return _elements(s, d).where("text is not null").select("elem_id", F.md5(T.squeeze_marks(F.col("text"))).alias("md5"))


@query()
def normal_punctuation(s, d):
    return _elements(s, d).where("text is not null").select("elem_id", T.normalise_punctuation(F.col("text")).alias("text"))


@query(rf"WITH {C} SELECT content_id, md5(regexp_replace(regexp_replace(regexp_replace(book_md, '(?m)^>\[low-confidence\][ \t]*', '', 'g'), '(?m)[ \t]*(?:\[UNCLEAR\]|\[需校对\])[ \t]*$', '', 'g'), '(?m)^<!-- page: \d+ -->[ \t]*\n?', '', 'g')) AS md5 FROM c WHERE book_md IS NOT NULL AND NOT contains(book_md, chr(13))")
def review_marks_stripped(s, d):
    return _texts(s, d).where("book_md is not null and not contains(book_md, char(13))").select("content_id", F.md5(T.strip_review_marks(F.col("book_md"))).alias("md5"))


@query()
def all_review_marks_stripped(s, d):
    """Texts with CRLF too, which the SQL of ``review_marks_stripped`` leaves out."""
    return _texts(s, d).where("book_md is not null").select("content_id", F.md5(T.strip_review_marks(F.col("book_md"))).alias("md5"))


@query()
def editor_modules(s, d):
    return modules.parse(_texts(s, d))


@query()
def module_words(s, d):
    return modules.parse(_texts(s, d)).groupBy("doc").agg(F.sum("word_count").alias("words"), F.count("*").alias("modules"))


@query()
def modules_written(s, d):
    return modules.serialise(modules.parse(_texts(s, d)))


@query(f"WITH {C}, {B} SELECT stem, max(loaded_at) AS newest FROM c WHERE stem IS NOT NULL GROUP BY stem ORDER BY newest DESC, stem LIMIT 5")
def recent_books(s, d):
    """A top-five report."""
    return _texts(s, d).where("stem is not null").groupBy("stem").agg(F.max("loaded_at").alias("newest")).orderBy(F.desc("newest"), "stem").limit(5)


@query(f"WITH {B} SELECT book_id, stem FROM b WHERE contains(lower(stem), 'gazetteer')")
def library_search(s, d):
    return _books(s, d).where(F.contains(F.lower("stem"), F.lit("gazetteer"))).select("book_id", "stem")


@query(f"WITH {C}, {B} SELECT b.book_id, b.stem FROM b WHERE EXISTS (SELECT 1 FROM c WHERE c.stem = b.stem AND c.book_md IS NOT NULL)")
def editable_books(s, d):
    return _books(s, d).join(_texts(s, d).where("book_md is not null").select("stem"), "stem", "left_semi").select("book_id", "stem")


@query(f"WITH {C}, {B} SELECT (SELECT count(*) FROM b) AS books, (SELECT count(*) FROM c WHERE book_md IS NOT NULL) AS texts, (SELECT coalesce(sum(length(book_md)), 0)::BIGINT FROM c) AS chars")
def dashboard(s, d):
    texts = _texts(s, d).agg(F.count("book_md").alias("texts"), F.coalesce(F.sum(F.length("book_md")), F.lit(0)).cast("bigint").alias("chars"), F.lit(1).alias("one"))
    return _books(s, d).agg(F.count("*").alias("books"), F.lit(1).alias("one")).join(texts, "one").select("books", "texts", "chars")


@query()
def recovered_json(s, d):
    cut_off = table(s, d, "page_cache").dropDuplicates(["cache_id"]).where("page_json is not null")
    return cut_off.where(F.expr("try_parse_json(page_json)").isNull()).select("cache_id", F.length(review.recover_json(F.col("page_json"))).alias("recovered_chars"))


@query(f"WITH {L} SELECT doc, line_no::INT AS line_no, last_value(TRY_CAST(nullif(regexp_extract(line, '^<!-- page: (\\d+) -->\\s*$', 1), '') AS INT) IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page_index FROM l")
def page_of_lines(s, d):
    return review.page_of_lines(_lines(s, d)).select("doc", "line_no", "page_index")


CHL = r"regexp_matches(line, '^#{1,3}\s+(.+?)\s*\{#(ch-\d+)\}\s*$')"


@query(f"WITH {L} SELECT doc, line_no::INT AS place, {trim(chr(39).join(['regexp_extract(line, ', '^#{1,3}\\s+(.+?)\\s*\\{#(ch-\\d+)\\}\\s*$', ', 1)']))} AS name, '#' || regexp_extract(line, '^#{{1,3}}\\s+(.+?)\\s*\\{{#(ch-\\d+)\\}}\\s*$', 2) AS anchor FROM l WHERE {CHL}")
def chapter_anchors(s, d):
    return toc.chapter_anchors(_lines(s, d))


@query(f"WITH {L}, {LOWS}, {HEADS}, {TI}, i0 AS (SELECT doc, 'low_confidence' AS kind, (row_number() OVER (PARTITION BY doc ORDER BY line_no) - 1) // 5 AS batch FROM lc UNION ALL SELECT doc, 'titles', (row_number() OVER (PARTITION BY doc ORDER BY line_no) - 1) // 5 FROM ti) SELECT doc, kind, batch, count(*)::INT AS items FROM i0 GROUP BY ALL UNION ALL SELECT DISTINCT doc, 'structure', 0, 0 FROM i0")
def review_batches(s, d):
    lines = _lines(s, d)
    return review.review_batches(review.low_confidence_issues(lines), review.title_issues(lines)).select("doc", "kind", "batch", F.size("ids").alias("items"))


@query(f"WITH {TYPES}, pp AS (SELECT book_id, page_index, max(page_image_path) AS path FROM page_results GROUP BY ALL), w AS (SELECT DISTINCT book_id FROM pp), cv AS (SELECT w.book_id, coalesce((SELECT min(page_index) FROM types WHERE types.book_id = w.book_id AND page_type = 'cover'), 0) AS cover_index FROM w) SELECT cv.book_id, cover_index, pp.path AS cover_path FROM cv LEFT JOIN pp ON pp.book_id = cv.book_id AND pp.page_index = cv.cover_index")
def covers(s, d):
    return assemble.covers(_types(s, d), _pages(s, d))


@query()
def processed_elements(s, d):
    return assemble.process(_elements(s, d), _pages(s, d)).select("elem_id", "text", "dropped", "low_confidence", "image_caption")


@query(f"""WITH {BLOCKS}, kind AS (SELECT elem_id, CASE WHEN {TITLE} THEN 'title' WHEN {IMAGE} THEN 'image' WHEN type = 'table' THEN 'table' WHEN type IN ('formula', 'display_formula') THEN 'formula' ELSE 'text' END AS kind FROM e), w AS (SELECT blocks.*, coalesce(kind, 'page') AS kind FROM blocks LEFT JOIN kind USING (elem_id)),
cc AS (SELECT *, sum(CASE WHEN kind = 'title' AND starts_with(block, '# ') THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY page_index, ord, list_pos, elem_id NULLS FIRST) AS chapter FROM w), g AS (SELECT book_id, chapter, string_agg(CASE WHEN kind = 'text' AND regexp_matches(block, '^["“「]') THEN '::: {{.dialogue}}' || chr(10) || block || chr(10) || ':::' ELSE block END, chr(10) || chr(10) ORDER BY page_index, ord, list_pos, coalesce(elem_id, -1)) AS t FROM cc GROUP BY ALL)
SELECT book_id, chapter::BIGINT AS chapter, md5(CASE WHEN chapter > 0 THEN '::: {{.chapter}}' || chr(10) || t || chr(10) || ':::' ELSE t END) AS content_md5 FROM g""")
def wrapped_chapters(s, d):
    return assemble.wrapped_chapters(_blocks(s, d)).select("book_id", "chapter", F.md5("content").alias("content_md5"))


@query(f"WITH {BLOCKS} SELECT book_id, page_index, elem_id, md5(block) AS block_md5 FROM blocks UNION ALL SELECT DISTINCT book_id, page_index, NULL::BIGINT, md5('<!-- page: ' || page_index || ' -->') FROM blocks WHERE elem_id IS NOT NULL")
def marked_blocks(s, d):
    return assemble.with_page_markers(_blocks(s, d)).select("book_id", "page_index", "elem_id", F.md5("block").alias("block_md5"))


@query()
def chapter_contexts(s, d):
    return review.chapter_contexts(_lines(s, d))


@query()
def toc_sections(s, d):
    return review.toc_sections(_lines(s, d))


@query()
def linked_lines(s, d):
    return toc.linkify(_lines(s, d))


@query()
def flagged_lines(s, d):
    lines = _lines(s, d)
    return review.line_flags(lines, ("title", review.title_issues(lines)), ("low_confidence", review.low_confidence_issues(lines)), ("paragraph", review.short_line_clusters(lines)))


@query()
def review_images(s, d):
    lines = review.page_of_lines(_lines(s, d))
    pages = lines.select("doc", "line_no", "page_index")
    low = review.low_confidence_issues(lines.drop("page_index")).join(pages, ["doc", "line_no"])
    titles = review.title_issues(lines.drop("page_index")).join(pages, ["doc", "line_no"])
    return review.review_images(low, titles, 5)


@query(f"WITH mm AS ({SQL['toc_mismatches']}) SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY pos, title)::INT AS rank, count(*) OVER (PARTITION BY book_id) AS total FROM mm QUALIFY rank <= {review.KEPT}")
def first_mismatches(s, d):
    """A report of the first five of each book."""
    return review.first_mismatches(toc_mismatches(s, d)).withColumn("rank", F.col("rank").cast("int"))


@query(f"WITH {L}, {HEADS}, {TI} SELECT {IDENT}, upper(title) AS new_line FROM ti WHERE issue <> 'normal'")
def corrections_by_issue(s, d):
    """Corrections given by issue id; beside each a second one of an id that no issue has."""
    issues = review.title_issues(_lines(s, d))
    given = issues.where("issue <> 'normal'").select("doc", F.explode(F.array("id", F.concat("id", F.lit("-x")))).alias("id"), F.upper("title").alias("new_line"))
    return review.by_issue(given, issues).withColumn("line_no", F.col("line_no").cast("int"))


@query(f"WITH {B}, {C}, o AS (SELECT t.entry_id, t.title AS x, b.title AS y FROM (SELECT DISTINCT entry_id, book_id, title FROM toc_entries WHERE title IS NOT NULL) t JOIN b USING (book_id) WHERE b.title IS NOT NULL) "
       f"SELECT entry_id, CASE WHEN contains(y, '[UNCLEAR]') THEN 'unclear' WHEN {trim('y')} = '' THEN 'empty' WHEN length(y) > length(x) + 1 THEN 'too_long' WHEN len(list_filter(list_distinct(string_split(x, '')), lambda k: k <> '' AND NOT contains('{T.WILDCARDS}', k) AND NOT regexp_matches(k, '[{T.SPACE}]') "
       "AND length(x) - length(replace(x, k, '')) > length(y) - length(replace(y, k, '')))) > 0 THEN 'lost_chars' WHEN len(list_filter(range(1), lambda k: levenshtein(x, y) > greatest(2, length(x) // 3))) > 0 THEN 'too_many_edits' ELSE 'ok' END AS verdict FROM o")
def corrections_checked(s, d):
    """Each contents title held against its book's title as if that were its correction."""
    titles = table(s, d, "toc_entries").select("entry_id", "book_id", "title").distinct().where("title is not null")
    met = titles.join(_books(s, d).where("title is not null").select("book_id", F.col("title").alias("new")), "book_id")
    return met.select("entry_id", review.check_correction(F.col("title"), F.col("new")).alias("verdict"))


@query(f"WITH {L}, {IR}, k AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{'|'.join(images.KEYWORDS)}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - CASE WHEN regexp_matches(line, '{'|'.join(images.KEYWORDS)}') THEN 1 ELSE 0 END AS near FROM l), "
       f"f AS (SELECT DISTINCT ir.doc, ir.path FROM ir JOIN k ON k.doc = ir.doc AND k.line_no = ir.line_no WHERE near > 0) SELECT DISTINCT ir.doc, ir.path FROM ir WHERE refs >= {images.REPEATS} AND NOT EXISTS (SELECT 1 FROM f WHERE f.doc = ir.doc AND f.path = ir.path)")
def decorative_images(s, d):
    """Repeated images but functional ones. The tables hold no image files, so equal paths stand for equal hashes and there are no bars."""
    lines = _lines(s, d)
    refs = review.image_refs(lines)
    functional = refs.join(images.near_keyword(lines), ["doc", "line_no"], "left_semi")
    return images.decorations(refs.where(F.col("refs") >= images.REPEATS), refs.limit(0), functional)


@query(f"WITH {B}, {C}, n AS (SELECT stem, max(loaded_at) AS t FROM c WHERE stem IS NOT NULL GROUP BY stem) SELECT b.book_id, coalesce(strftime(t, '%Y-%m-%d %H:%M:%S'), '') AS loaded FROM b LEFT JOIN n ON n.stem = b.stem")
def library_times(s, d):
    """Each book with the time of its newest text by stem, or the empty text."""
    newest = _texts(s, d).where("stem is not null").groupBy("stem").agg(F.max("loaded_at").alias("t"))
    return _books(s, d).join(newest, "stem", "left").select("book_id", F.coalesce(F.date_format("t", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("loaded"))


@query(f"WITH {C} SELECT content_id, CASE WHEN length(book_md) < 1024 THEN length(book_md) || ' B' WHEN length(book_md) < 1048576 THEN printf('%.1f KB', length(book_md) / 1024.0) ELSE printf('%.1f MB', length(book_md) / 1048576.0) END AS size FROM c WHERE book_md IS NOT NULL")
def text_sizes(s, d):
    return _texts(s, d).where("book_md is not null").select("content_id", T.human_size(F.length("book_md")).alias("size"))


@query(f"WITH {B} SELECT book_id, CASE WHEN length(pdf_hash) <> length(sha1(stem)) THEN 999 ELSE len(list_filter(range(1, length(pdf_hash) + 1), lambda i: pdf_hash[i] <> sha1(stem)[i])) END::INT AS distance FROM b WHERE pdf_hash IS NOT NULL AND stem IS NOT NULL")
def hash_distances(s, d):
    """How many places of a book's file hash differ from the hash of its stem."""
    return _books(s, d).where("pdf_hash is not null and stem is not null").select("book_id", T.hamming(F.col("pdf_hash"), F.sha1("stem")).cast("int").alias("distance"))


@query("""SELECT cfg_hash, dpi, sha1('{"cfg_hash":"' || cfg_hash || '","dpi":' || dpi || '}') AS key FROM page_cache WHERE cfg_hash IS NOT NULL AND dpi IS NOT NULL GROUP BY ALL""")
def config_keys(s, d):
    return table(s, d, "page_cache").where("cfg_hash is not null and dpi is not null").select("dpi", "cfg_hash").distinct().select("cfg_hash", "dpi", store.config_key("dpi", "cfg_hash").alias("key"))


@query(f"WITH {B} SELECT book_id, 'data:image/jpeg;base64,' || to_base64(encode(title)) AS url FROM b WHERE title IS NOT NULL")
def data_urls(s, d):
    """Data URLs of bytes; the tables hold no image files, so the titles' bytes stand for them."""
    return _books(s, d).where("title is not null").select("book_id", T.data_url(F.encode("title", "UTF-8"), F.lit("p.JPG")).alias("url"))


@query("WITH k AS (SELECT pdf_hash, page_index, dpi, cfg_hash, cache_id, created_at FROM page_cache GROUP BY ALL) SELECT pdf_hash, page_index, dpi, cfg_hash, arg_max(cache_id, (created_at, cache_id)) AS cache_id FROM k GROUP BY ALL")
def cache_upserted(s, d):
    """The log written into an empty store in two steps: each key's first row, then each key's last row in its place."""
    log = table(s, d, "page_cache").select(*store.KEY, "cache_id", "created_at").distinct()
    first = log.groupBy(*store.KEY).agg(F.min_by("cache_id", F.struct("created_at", "cache_id")).alias("cache_id"))
    return store.upsert(first, store.newest(log).select(*store.KEY, "cache_id"))


# SQL that is built on other queries' SQL.
SQL["chapter_contexts"] = rf"""WITH {L}, m AS (SELECT *, regexp_matches(line, '^\s*(?:# |:::)') AS stop FROM l), i AS (SELECT *, sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS island FROM m),
b AS (SELECT doc, island, line_no AS n, {trim('line')} AS t FROM i WHERE {trim('line')} <> '' AND NOT regexp_matches(line, '^\s*!\[') AND NOT stop)
SELECT h.doc, h.line_no::INT AS line_no, left(coalesce(string_agg(t, chr(10) ORDER BY n), ''), 200) AS context FROM i h LEFT JOIN b ON b.doc = h.doc AND b.island = h.island WHERE regexp_matches(h.line, '^# \S') GROUP BY h.doc, h.line_no"""
SQL["flagged_lines"] = f"""WITH {L}, f AS (SELECT doc, line_no, 'title' AS kind FROM ({SQL['title_issues']}) UNION SELECT doc, line_no, 'low_confidence' FROM ({SQL['low_confidence_issues']}) UNION SELECT doc, start_line, 'paragraph' FROM ({SQL['short_line_clusters']})),
g AS (SELECT doc, line_no, list_sort(list(kind)) AS issues FROM f GROUP BY ALL) SELECT l.doc, l.line_no::INT AS line_no, l.line, coalesce(g.issues, []::VARCHAR[]) AS issues FROM l LEFT JOIN g ON g.doc = l.doc AND g.line_no = l.line_no"""
SQL["review_images"] = f"""WITH pg AS ({SQL['page_of_lines']}), x AS (SELECT doc, line_no, 0 AS rank FROM ({SQL['low_confidence_issues']}) UNION ALL SELECT doc, line_no, 1 FROM ({SQL['title_issues']}) WHERE issue <> 'normal'),
y AS (SELECT x.doc, page_index, min((rank, x.line_no)) AS place FROM x JOIN pg ON pg.doc = x.doc AND pg.line_no = x.line_no WHERE page_index IS NOT NULL GROUP BY ALL)
SELECT doc, page_index, row_number() OVER (PARTITION BY doc ORDER BY place, page_index)::INT AS n FROM y QUALIFY n <= 5"""
SQL["toc_sections"] = rf"""WITH {L}, m AS (SELECT *, regexp_matches(line, '^### .*(?:CONTENTS|目录)') AS opens, regexp_matches(line, '^# ') OR starts_with(line, '::: {{.chapter}}') AS closes FROM l),
st AS (SELECT *, last_value(CASE WHEN opens THEN true WHEN closes THEN false END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inside FROM m)
SELECT doc, line_no::INT AS line_no, {trim(r"regexp_replace(line, '(?:[…\.·]{{2,}}|[/／])\s*\d.*$', '')".replace('{{', '{').replace('}}', '}'))} AS entry FROM st WHERE inside AND NOT opens AND {trim('line')} <> '' AND NOT ({" OR ".join(f"starts_with({trim('line')}, '{x}')" for x in review.NON_BODY)})"""

#: Modules: depth of open divs at each line, the line that closes each, and the blocks between marks.
_MD = rf"""{C}, l0 AS (SELECT content_id AS doc, string_split(book_md, chr(10)) AS a FROM c WHERE book_md IS NOT NULL), l AS (SELECT doc, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS line_no FROM l0), m AS (SELECT *, regexp_matches(line, '^:::\s*\{{[^}}]+\}}') AS o, regexp_matches(line, '^:::\s*$') AS c, regexp_matches(line, '^\s*$') AS blank FROM l),
s AS (SELECT *, sum(CASE WHEN o THEN 1 WHEN c THEN -1 ELSE 0 END) OVER w AS run, sum(CASE WHEN o OR c OR blank THEN 1 ELSE 0 END) OVER w AS marks FROM m WINDOW w AS (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT *, run - least(0, min(run) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS depth FROM s),
od AS (SELECT a.doc, a.line_no, a.depth, any_value(list_transform(list_filter(regexp_split_to_array(regexp_extract(a.line, '^:::\s*\{{([^}}]+)\}}', 1), '\s+'), lambda k: starts_with(k, '.')), lambda k: regexp_replace(k, '^[.]+', ''))) AS classes, min(b.line_no) AS closed FROM d a LEFT JOIN d b ON b.doc = a.doc AND b.line_no > a.line_no AND b.depth < a.depth WHERE a.o GROUP BY a.doc, a.line_no, a.depth),
bl AS (SELECT doc, marks, min(line_no) AS n, string_agg(line, chr(10) ORDER BY line_no) AS content, min_by(line, line_no) AS first FROM d WHERE NOT (o OR c OR blank) GROUP BY doc, marks),
cl AS (SELECT bl.doc, bl.n, flatten(list(classes ORDER BY depth)) AS classes FROM bl JOIN od ON od.doc = bl.doc AND od.line_no < bl.n AND (closed IS NULL OR closed > bl.n) WHERE NOT list_contains(classes, 'chapter') GROUP BY bl.doc, bl.n),
h AS (SELECT bl.doc, row_number() OVER (PARTITION BY bl.doc ORDER BY bl.n) - 1 AS position, content, first, coalesce(classes, []::VARCHAR[]) AS layout_classes, regexp_extract(first, '^(#{{1,4}})\s+(.+?)(?:\s*\{{#([^}}]+)\}})?\s*$', 1) AS hash, regexp_extract(first, '^(#{{1,4}})\s+(.+?)(?:\s*\{{#([^}}]+)\}})?\s*$', 2) AS title, nullif(regexp_extract(first, '^(#{{1,4}})\s+(.+?)(?:\s*\{{#([^}}]+)\}})?\s*$', 3), '') AS heading_id,
regexp_extract(first, '^!\[.*?\]\((.+?)\)', 1) AS image FROM bl LEFT JOIN cl ON cl.doc = bl.doc AND cl.n = bl.n),
k AS (SELECT *, CASE WHEN hash <> '' THEN 'chapter' WHEN image <> '' THEN CASE WHEN contains(image, 'pages/') OR starts_with(image, 'pages') THEN 'cover' ELSE 'image' END WHEN regexp_matches(first, '^---+\s*$') THEN 'divider' WHEN starts_with(first, '>') THEN 'quote' WHEN list_contains(layout_classes, 'toc-list') THEN 'toc' WHEN list_contains(layout_classes, 'dialogue') THEN 'dialogue' ELSE 'paragraph' END AS type FROM h),
mods AS (SELECT doc, position::INT AS position, type, content, layout_classes, CASE WHEN type IN ('chapter', 'quote', 'dialogue', 'paragraph') THEN length(regexp_replace(CASE WHEN type = 'chapter' THEN title ELSE content END, '[#>*\-\[\]!()' || chr(123) || chr(125) || '=|`~{T.SPACE}]', '', 'g')) ELSE 0 END::INT AS word_count, nullif(length(hash), 0)::INT AS heading_level, heading_id FROM k)"""
SQL["editor_modules"] = f"WITH {_MD} SELECT * FROM mods"
SQL["module_words"] = f"WITH {_MD} SELECT doc, sum(word_count)::BIGINT AS words, count(*) AS modules FROM mods GROUP BY doc"
SQL["modules_written"] = rf"""WITH {_MD}, q AS (SELECT *, coalesce(heading_level = 1, false) AS h1, list_filter(layout_classes, lambda x, i: x <> 'chapter' AND list_position(layout_classes, x) = i) AS cs FROM mods),
r AS (SELECT *, coalesce(max(h1) OVER (PARTITION BY doc ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS open FROM q),
t AS (SELECT doc, position, h1, CASE WHEN h1 AND open THEN ':::' || chr(10) || chr(10) ELSE '' END || CASE WHEN h1 THEN '::: {{.chapter}}' || chr(10) || chr(10) ELSE '' END || CASE WHEN h1 OR len(cs) = 0 THEN trim(content) ELSE '::: {{' || array_to_string(list_transform(cs, lambda x: '.' || x), ' ') || '}}' || chr(10) || chr(10) || trim(content) || chr(10) || chr(10) || ':::' END || chr(10) || chr(10) AS piece FROM r)
SELECT doc, trim(regexp_replace(regexp_replace(string_agg(piece, '' ORDER BY position) || CASE WHEN max(h1) THEN ':::' ELSE '' END, '\n{{3,}}', chr(10) || chr(10), 'g'), '\s+$', '')) || chr(10) AS book_md FROM t GROUP BY doc"""
