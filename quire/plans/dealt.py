"""Queries of problems 3 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import drift, nested
from quire.runtime import table

SOURCES = (("page_cache", "cache_id", "pdf_hash", "page_json"), ("page_results", "page_id", "book_id", "raw_json"))


def _inputs(spark: SparkSession, d: str) -> tuple[list, DataFrame]:
    return [(table(spark, d, src), key, column, src) for src, _, key, column in SOURCES], table(spark, d, "page_schema")


def _drift(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(*_inputs(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).select("src", "doc_key", "field_path", "change_kind")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d)


def p3_pages(spark: SparkSession, d: str) -> DataFrame:
    report = drift.renames_and_changes(*_inputs(spark, d))
    parts = [drift.unify(table(spark, d, src), row, key, column, src, report) for src, row, key, column in SOURCES]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [nested.nested_elements(table(spark, d, src), row, column, src) for src, row, _, column in SOURCES]
    return parts[0].unionByName(parts[1]).distinct()


def _nodes(spark: SparkSession, d: str, *nodes: str) -> DataFrame:
    parts = [nested.flatten(table(spark, d, src).dropDuplicates([row]), row, column, src, nodes) for src, row, _, column in SOURCES]
    return parts[0].unionByName(parts[1])


def p4_pages(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, "page").select("src", "row_id", nested.attribute("parsed").cast("boolean").alias("parsed"), *[nested.attribute(k).alias(k) for k in ("page_index", "width", "height", "input_path")])


def p4_elements(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, "element").drop("node", "attributes")


def p4_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, "box").select("src", "row_id", "schema_path", "dewey", "parent_dewey", "ordinal", "label", "x1", "y1", "x2", "y2", "score")


def p4_line_scores(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, "line").select("src", "row_id", "dewey", "parent_dewey", "ordinal", "x1", "y1", "x2", "y2", "score")


def p4_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Every further field of every node, whatever its table, with the node's schema path and label."""
    return _nodes(spark, d, *nested.NODES).select("src", "row_id", "node", "schema_path", "dewey", "parent_dewey", F.explode("attributes").alias("name", "value"))


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p3_pages, p4_found, p4_pages, p4_elements, p4_boxes, p4_line_scores, p4_attributes)}

_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN json_extract({0}, '$[*]') WHEN 'OBJECT' THEN [{0}] ELSE [] END"
_J = """j AS (SELECT DISTINCT 'page_cache' AS src, cache_id AS row_id, page_json AS doc FROM page_cache UNION ALL SELECT DISTINCT 'page_results', page_id, raw_json FROM page_results),
v AS (SELECT src, row_id, CASE WHEN json_valid(doc) THEN doc::JSON END AS j FROM j),
r AS (SELECT src, row_id, coalesce(CASE WHEN json_type(j, '$.res') = 'OBJECT' THEN json_extract(j, '$.res') END, j) AS j FROM v)"""


def _any(x: str, names: tuple[str, ...]) -> str:
    """SQL: the first of the fields that is there and not null."""
    return "coalesce(" + ", ".join(f"CASE WHEN json_type({x}, '$.{n}') <> 'NULL' THEN json_extract({x}, '$.{n}') END" for n in names) + ")"


def _sql_text(x: str) -> str:
    return f"""CASE WHEN json_type({x}) = 'VARCHAR' THEN {x}->>'$' WHEN json_type({x}) = 'ARRAY' AND len(list_filter(json_extract({x}, '$[*]'), lambda q: json_type(q) <> 'VARCHAR')) = 0 THEN array_to_string(list_transform(json_extract({x}, '$[*]'), lambda q: q->>'$'), chr(10))
WHEN json_type({x}, '$.raw') = 'VARCHAR' THEN {x}->>'$.raw' ELSE {x}::VARCHAR END"""


def _sql_number(x: str) -> str:
    return f"CASE WHEN json_type({x}) <> 'BOOLEAN' THEN try_cast(trim({x}->>'$') AS DOUBLE) END"


def _sql_box(x: str) -> str:
    items = f"""CASE json_type({x}) WHEN 'VARCHAR' THEN list_transform(string_split({x}->>'$', ','), lambda q: try_cast(trim(q) AS DOUBLE)) WHEN 'ARRAY' THEN list_transform(json_extract({x}, '$[*]'), lambda q: {_sql_number("q")})
WHEN 'OBJECT' THEN [{", ".join(_sql_number(f"json_extract({x}, '$.{k}')") for k in ("x1", "y1", "x2", "y2"))}] END"""
    return f"CASE WHEN len({items}) = 4 AND len(list_filter({items}, lambda q: q IS NULL)) = 0 THEN {items} END"


_CORNERS = ", ".join(f"b[{i}] AS {k}" for i, k in enumerate(("x1", "y1", "x2", "y2"), 1))
_OUTER = "CASE WHEN src = 'page_cache' THEN coalesce(json_extract(j, '$.parsing_res_list'), json_extract(j, '$.blocks')) ELSE coalesce(json_extract(j, '$.elements'), json_extract(j, '$.lines')) END"
SQL: dict[str, str] = {
    "p4_found": f"""WITH RECURSIVE j AS (SELECT 'page_cache' AS src, cache_id AS row_id, page_json::JSON AS j FROM page_cache WHERE json_valid(page_json) UNION ALL SELECT 'page_results', page_id, raw_json::JSON FROM page_results WHERE json_valid(raw_json)),
r AS (SELECT src, row_id, coalesce(CASE WHEN json_type(j, '$.res') = 'OBJECT' THEN json_extract(j, '$.res') END, j) AS j FROM j),
l AS (SELECT src, row_id, CASE WHEN src = 'page_cache' THEN coalesce(json_extract(j, '$.parsing_res_list'), json_extract(j, '$.blocks')) ELSE coalesce(json_extract(j, '$.elements'), json_extract(j, '$.lines')) END AS x FROM r),
t AS (SELECT src, row_id, {_LIST.format("x")} AS items FROM l), e AS (SELECT src, row_id, (i - 1)::VARCHAR AS path, items[i] AS x FROM t, unnest(range(1, len(items) + 1)) u(i) WHERE json_type(items[i]) = 'OBJECT'
UNION ALL SELECT src, row_id, path || '.' || (i - 1), ch[i] FROM (SELECT src, row_id, path, {_LIST.format("json_extract(x, '$.children')")} AS ch FROM e) c, unnest(range(1, len(ch) + 1)) u(i) WHERE json_type(ch[i]) = 'OBJECT')
SELECT DISTINCT src, row_id, path AS elem_path FROM e WHERE contains(path, '.')""",
    "p4_pages": f"""WITH {_J} SELECT src, row_id, coalesce(json_type(j) = 'OBJECT', false) AS parsed, """ + ", ".join(f"CASE WHEN json_type(j, '$.{k}') NOT IN ('OBJECT', 'NULL') THEN j->>'$.{k}' END AS {k}" for k in ("page_index", "width", "height", "input_path")) + " FROM r",
    "p4_elements": f"""WITH RECURSIVE {_J}, t AS (SELECT src, row_id, {_LIST.format("x")} AS items FROM (SELECT src, row_id, {_OUTER} AS x FROM r)),
e AS (SELECT src, row_id, (i - 1)::VARCHAR AS path, 0 AS level, items[i] AS x FROM t, unnest(range(1, len(items) + 1)) u(i) WHERE json_type(items[i]) = 'OBJECT'
UNION ALL SELECT src, row_id, path || '.' || (i - 1), level + 1, ch[i] FROM (SELECT src, row_id, path, level, {_LIST.format("json_extract(x, '$.children')")} AS ch FROM e) c, unnest(range(1, len(ch) + 1)) u(i) WHERE json_type(ch[i]) = 'OBJECT'),
f AS (SELECT src, row_id, path, level, {_any("x", nested.LABELS)} AS l, {_any("x", nested.CONTENTS)} AS c, {_any("x", nested.BOXES)} AS bx, {_any("x", nested.SCORES)} AS sc FROM e),
g AS (SELECT *, {_sql_box("bx")} AS b FROM f)
SELECT src, row_id, path AS dewey, CASE WHEN contains(path, '.') THEN regexp_replace(path, '[.][0-9]+$', '') ELSE '' END AS parent_dewey, level, string_split(path, '.')[-1]::INT AS ordinal,
CASE level WHEN 0 THEN '{nested.OUTER}' ELSE '{nested.INNER}' END AS schema_path, {_sql_text("l")} AS label, {_sql_text("c")} AS content, {_CORNERS}, {_sql_number("sc")} AS score FROM g""",
    "p4_boxes": f"""WITH {_J}, h AS (SELECT src, row_id, k, {_LIST.format("json_extract(j, '$.' || k || '.boxes')")} AS items FROM r, (VALUES ('layout_det_res'), ('layout_detection')) n(k) WHERE src = 'page_cache' AND json_type(j, '$.' || k) = 'OBJECT'),
e AS (SELECT src, row_id, k, i - 1 AS i, items[i] AS x FROM h, unnest(range(1, len(items) + 1)) u(i) WHERE json_type(items[i]) = 'OBJECT'),
f AS (SELECT src, row_id, k, i, {_any("x", nested.LABELS)} AS l, {_any("x", nested.BOXES)} AS bx, {_any("x", nested.SCORES)} AS sc FROM e), g AS (SELECT *, {_sql_box("bx")} AS b FROM f)
SELECT src, row_id, '$.' || k || '.boxes[]' AS schema_path, '0.' || i AS dewey, '0' AS parent_dewey, i AS ordinal, {_sql_text("l")} AS label, {_CORNERS}, {_sql_number("sc")} AS score FROM g""",
    "p4_line_scores": f"""WITH {_J}, o AS (SELECT src, row_id, json_extract(j, '$.overall_ocr_res') AS o FROM r WHERE src = 'page_cache' AND json_type(j, '$.overall_ocr_res') = 'OBJECT'),
h AS (SELECT src, row_id, CASE WHEN json_type(o, '$.rec_boxes') = 'ARRAY' THEN json_extract(o, '$.rec_boxes[*]') ELSE [] END AS boxes, CASE WHEN json_type(o, '$.rec_scores') = 'ARRAY' THEN json_extract(o, '$.rec_scores[*]') WHEN json_type(o, '$.line_scores') = 'ARRAY' THEN json_extract(o, '$.line_scores[*]') ELSE [] END AS scores FROM o),
e AS (SELECT src, row_id, i - 1 AS i, boxes[i] AS bx, scores[i] AS sc FROM h, unnest(range(1, greatest(len(boxes), len(scores)) + 1)) u(i)), g AS (SELECT *, {_sql_box("bx")} AS b FROM e)
SELECT src, row_id, '0.' || i AS dewey, '0' AS parent_dewey, i AS ordinal, {_CORNERS}, {_sql_number("sc")} AS score FROM g""",
}
