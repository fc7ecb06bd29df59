"""Page JSON of OCR engines to element rows, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYOUT = (
    "width string, height string, parsing_res_list array<struct<block_label string, label string, block_bbox string, bbox string, block_content string, content string, block_order string, order_index string>>, "
    "layout_det_res struct<boxes array<struct<coordinate string, score string>>>, overall_ocr_res struct<rec_boxes array<string>, rec_polys array<string>, rec_scores array<string>>"
)
LINES = "width string, height string, elements array<struct<type string, text string, bbox struct<x1 double, y1 double, x2 double, y2 double>, confidence string, order_index string>>"


def payload(json: Column) -> Column:
    """The page object, also from inside the ``res`` wrapper."""
    inner = F.get_json_object(json, "$.res")
    return F.when(F.ltrim(inner).startswith("{"), inner).otherwise(json)


def four_numbers(text: Column) -> Column:
    """An array of four doubles from JSON text, or null."""
    values = F.from_json(text, "array<double>")
    return F.when((F.size(values) >= 4) & F.forall(values, lambda v: v.isNotNull()), F.slice(values, 1, 4))


def box_or_zeros(values: Column) -> Column:
    at = lambda k: F.coalesce(F.try_element_at(values, F.lit(k)), F.lit(0.0))
    return F.struct(at(1).alias("x1"), at(2).alias("y1"), at(3).alias("x2"), at(4).alias("y2"))


def _truncated(values: Column) -> Column:
    return F.transform(values, lambda v: v.cast("bigint"))


def layout_pages(cache: DataFrame, keys: tuple[str, ...], json: str = "page_json") -> DataFrame:
    """Parsed pages: keys, width and height (both or 0), ``page`` with the layout. Unparseable rows are left out."""
    parsed = cache.select(*keys, F.from_json(payload(F.col(json)), LAYOUT).alias("page"), F.get_json_object(F.col(json), "$").isNotNull().alias("valid")).where("valid")
    w, h = F.expr("try_cast(page.width as double)"), F.expr("try_cast(page.height as double)")
    both = w.isNotNull() & h.isNotNull()
    return parsed.select(*keys, F.when(both, w).otherwise(0.0).alias("width"), F.when(both, h).otherwise(0.0).alias("height"), "page")


def line_scores(page: Column) -> Column:
    """Recognised lines as (box, score), zipped to the shorter list; polygons stand in for missing boxes."""
    ocr = page["overall_ocr_res"]
    poly = F.transform(ocr["rec_polys"], lambda p: F.from_json(p, "array<array<double>>"))
    from_poly = F.transform(poly, lambda p: F.array(F.array_min(F.transform(p, lambda q: q[0])), F.array_min(F.transform(p, lambda q: q[1])), F.array_max(F.transform(p, lambda q: q[0])), F.array_max(F.transform(p, lambda q: q[1]))))
    boxes = F.when(F.size(ocr["rec_boxes"]) > 0, F.transform(ocr["rec_boxes"], four_numbers)).otherwise(from_poly)
    zipped = F.transform(F.arrays_zip(boxes.alias("box"), ocr["rec_scores"].alias("score")), lambda z: F.struct(_truncated(z["box"]).alias("box"), z["score"].try_cast("double").alias("score")))
    return F.filter(zipped, lambda z: z["box"].isNotNull() & z["score"].isNotNull())


def detection_scores(page: Column) -> Column:
    """Layout boxes as (box truncated, box rounded half to even, score)."""
    def one(b: Column) -> Column:
        values = four_numbers(b["coordinate"])
        return F.struct(_truncated(values).alias("cut"), F.transform(values, lambda v: F.bround(v).cast("bigint")).alias("near"), b["score"].try_cast("double").alias("score"))

    return F.filter(F.transform(page["layout_det_res"]["boxes"], one), lambda b: b["cut"].isNotNull() & b["score"].isNotNull())


def layout_elements(cache: DataFrame, keys: tuple[str, ...], json: str = "page_json") -> DataFrame:
    """Elements of layout JSON: type, bbox, text, order and confidence, one row for each block.

    Names fall back to their aliases, a bad order to the position, a bad box to
    zeros. Confidence is the mean score of the lines whose centre lies in the
    block, else the score of the last layout box with the same corners, else null.
    """
    pages = layout_pages(cache, keys, json).select(*keys, "width", "height", F.col("page.parsing_res_list").alias("blocks"), line_scores(F.col("page")).alias("lines"), detection_scores(F.col("page")).alias("boxes"))
    rows = pages.select("*", F.posexplode("blocks").alias("list_pos", "b")).where("b is not null")
    filled = lambda *names: F.coalesce(*[F.nullif(F.col(f"b.{n}"), F.lit("")) for n in names])
    values = four_numbers(filled("block_bbox", "bbox"))
    box = _truncated(F.coalesce(values, F.array(*[F.lit(0.0)] * 4)))
    rows = rows.withColumns({"values": values, "cut": box})
    inside = F.filter("lines", lambda z: ((z["box"][0] + z["box"][2]) / 2).between(F.col("cut")[0], F.col("cut")[2]) & ((z["box"][1] + z["box"][3]) / 2).between(F.col("cut")[1], F.col("cut")[3]))
    mean = F.aggregate(inside, F.lit(0.0), lambda a, z: a + z["score"]) / F.nullif(F.size(inside), F.lit(0))
    same = F.filter("boxes", lambda b: (b["cut"] == F.col("cut")) | (b["near"] == F.col("cut")))
    return rows.select(
        *keys, "list_pos", F.coalesce(filled("block_label", "label"), F.lit("text")).alias("type"), box_or_zeros(F.col("values")).alias("bbox"), F.coalesce(filled("block_content", "content"), F.lit("")).alias("text"),
        F.coalesce(F.expr("try_cast(coalesce(b.block_order, b.order_index) as int)"), F.col("list_pos")).alias("order_index"), F.coalesce(mean, F.try_element_at(same, F.lit(-1))["score"]).alias("confidence"),
    )


def line_elements(pages: DataFrame, keys: tuple[str, ...], json: str = "raw_json") -> DataFrame:
    """Elements of text-line JSON; bad scores are null, a bad order is the position."""
    parsed = pages.select(*keys, F.from_json(payload(F.col(json)), LINES).alias("page")).select(*keys, F.posexplode("page.elements").alias("list_pos", "e")).where("e is not null")
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("x1", "y1", "x2", "y2")])
    return parsed.select(*keys, "list_pos", F.coalesce(F.nullif(F.col("e.type"), F.lit("")), F.lit("text")).alias("type"), F.coalesce("e.bbox", zero).alias("bbox"), F.coalesce("e.text", F.lit("")).alias("text"), F.coalesce(F.expr("try_cast(e.order_index as int)"), F.col("list_pos")).alias("order_index"), F.expr("try_cast(e.confidence as double)").alias("confidence"))


def line_json(elements: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The text-line JSON of each page, written from element rows; :func:`line_elements` reads it back."""
    e = F.struct("list_pos", F.struct("type", "text", "bbox", "confidence", "order_index").alias("e"))
    rows = F.transform(F.sort_array(F.collect_list(e)), lambda x: x["e"])
    return elements.groupBy(*keys).agg(F.to_json(F.struct(rows.alias("elements"))).alias("raw_json"))
