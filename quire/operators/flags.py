"""Flags of layout elements: confidence tiers, furniture by label, number or repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import lengths_close, ratcliff, trim_all
from quire.runtime import cut

#: Labels dropped outright, labels that may hold a page number, labels the confidence filter looks at.
FURNITURE = ("header", "footer", "header_image", "footer_image", "number", "footnote", "aside_text")
TITLES = ("doc_title", "paragraph_title", "content_title")
FILTERED = ("text", *TITLES)
#: Margins as shares of the height, longest head, pages it stands on, and the similarity that makes two lines one.
TOP, BOTTOM, HEAD_CHARS, HEAD_PAGES, SIMILAR = 0.08, 0.92, 60, 3, 0.7


def confidence_tiers(elements: DataFrame, noise: float = 0.3, low: float = 0.5, least: float = 0.5, types: tuple[str, ...] = FILTERED) -> DataFrame:
    """``dropped`` and ``low_confidence`` by three tiers of confidence.

    Below ``noise`` a text of at most one character is dropped and a longer one
    marked; below ``low`` (or ``least``, if set and different) an empty text is
    dropped and any other marked. Null confidence, other types and elements
    already dropped stay as they are.
    """
    limit = least if least > 0 and least != low else low
    size = F.length(trim_all(F.coalesce("text", F.lit(""))))
    live = ~F.coalesce("dropped", F.lit(False)) & F.col("type").isin(*types) & F.col("confidence").isNotNull()
    noisy, weak = live & (F.col("confidence") < noise), live & (F.col("confidence") >= noise) & (F.col("confidence") < limit)
    drop, mark = (noisy & (size <= 1)) | (weak & (size == 0)), (noisy & (size > 1)) | (weak & (size > 0))
    flag = lambda c, extra: F.coalesce(F.col(c), F.lit(False)) | F.coalesce(extra, F.lit(False))
    return elements.withColumns({"dropped": flag("dropped", drop), "low_confidence": flag("low_confidence", mark)})


def with_heights(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Elements with their page's height (null where the page is unknown); one row for each element."""
    height = pages.groupBy("book_id", "page_index").agg(F.max("height").alias("page_height"))
    return elements.join(height, ["book_id", "page_index"], "left")


def centre(height: Column | None = None) -> Column:
    """Vertical centre as a share of the page's height; null where there is none."""
    h = F.col("page_height") if height is None else height
    return F.when(h > 0, (F.col("bbox.y1") + F.col("bbox.y2")) / 2 / h)


def margin() -> Column:
    """``top``, ``bottom`` or null."""
    return F.when(centre() < TOP, "top").when(centre() > BOTTOM, "bottom")


def drop_furniture(elements: DataFrame, by_label: bool = True, by_number: bool = True) -> DataFrame:
    """``dropped`` for furniture labels and for bare page numbers in a margin. Needs ``page_height``."""
    gone = F.coalesce("dropped", F.lit(False))
    if by_label:
        gone = gone | F.col("type").isin(*FURNITURE)
    if by_number:
        number = F.col("type").isin("text", *TITLES) & F.coalesce(F.col("text").rlike(r"^\s*\d{1,4}\s*$"), F.lit(False)) & margin().isNotNull()
        gone = gone | F.coalesce(number, F.lit(False))
    return elements.withColumn("dropped", F.coalesce(gone, F.lit(False)))


def margin_candidates(elements: DataFrame) -> DataFrame:
    """Short live texts in a margin: (book_id, page_index, list_pos, margin, line)."""
    line = trim_all(F.col("text"))
    live = ~F.coalesce("dropped", F.lit(False)) & (F.col("type") == "text")
    return elements.where(live).select("book_id", "page_index", "list_pos", "elem_id", margin().alias("margin"), line.alias("line")).where((F.length("line").between(1, HEAD_CHARS)) & F.col("margin").isNotNull())


def repeated_lines(candidates: DataFrame) -> DataFrame:
    """(book_id, margin, line) of lines that stand, as they are, on at least three pages."""
    return candidates.groupBy("book_id", "margin", "line").agg(F.count_distinct("page_index").alias("pages")).where(F.col("pages") >= HEAD_PAGES)


def repeated_anchors(candidates: DataFrame) -> DataFrame:
    """(book_id, margin, anchor) by ordered clustering: a line joins the first anchor it is similar to.

    Equal lines always join the same anchor, so the clustering sees each line
    of a book once, at its first place; pages are counted outside of it.
    """
    first = F.min(F.struct("page_index", "list_pos", "elem_id")).alias("first")
    lines = candidates.groupBy("book_id", "margin", "line").agg(first).select("book_id", "margin", "line", "first.*")

    def cluster(frame):
        import difflib

        import pandas as pd

        frame = frame.sort_values(["page_index", "list_pos", "elem_id"], kind="stable")
        anchors: list[str] = []
        out = []
        for book, side, line in zip(frame["book_id"], frame["margin"], frame["line"]):
            hit = next((a for a in anchors if a == line or (abs(len(a) - len(line)) <= 0.3 * max(len(a), len(line)) and difflib.SequenceMatcher(None, line, a).ratio() >= SIMILAR)), None)
            if hit is None:
                anchors.append(line)
                hit = line
            out.append((book, side, line, hit))
        return pd.DataFrame(out, columns=["book_id", "margin", "line", "anchor"])

    mapped = lines.groupBy("book_id", "margin").applyInPandas(cluster, "book_id string, margin string, line string, anchor string")
    pages = candidates.join(mapped, ["book_id", "margin", "line"]).groupBy("book_id", "margin", "anchor").agg(F.count_distinct("page_index").alias("pages"))
    return pages.where(F.col("pages") >= HEAD_PAGES)


def running_heads(candidates: DataFrame) -> DataFrame:
    """Candidates similar to a repeated anchor of their margin: equal ones by an equi-join, the rest by similarity."""
    anchors = repeated_anchors(candidates).select("book_id", "margin", "anchor")
    equal = candidates.join(anchors.withColumnRenamed("anchor", "line"), ["book_id", "margin", "line"], "left_semi")
    rest = candidates.join(anchors.withColumnRenamed("anchor", "line"), ["book_id", "margin", "line"], "left_anti")
    lines = rest.select("book_id", "margin", "line").distinct()
    near = lines.join(anchors, ["book_id", "margin"]).where(lengths_close(F.col("line"), F.col("anchor")))
    hits = near.where(ratcliff(F.col("line"), F.col("anchor")) >= SIMILAR).select("book_id", "margin", "line").distinct()
    return equal.unionByName(rest.join(hits, ["book_id", "margin", "line"], "left_semi"))


def remove_furniture(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Labels, numbers and running heads in this order; the elements with ``dropped`` set."""
    flagged = drop_furniture(with_heights(elements, pages))
    heads = running_heads(margin_candidates(flagged)).select("elem_id").distinct().withColumn("is_head", F.lit(True))
    return flagged.join(heads, "elem_id", "left").withColumn("dropped", F.col("dropped") | F.coalesce("is_head", F.lit(False))).drop("is_head")


def furniture_ids(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """(elem_id) of the page numbers and running heads that :func:`remove_furniture` drops, written; only texts no longer than a head are looked at."""
    short = elements.where(~F.coalesce("dropped", F.lit(False)) & F.col("type").isin("text", *TITLES) & F.length(trim_all(F.col("text"))).between(1, HEAD_CHARS))
    flagged = cut(drop_furniture(with_heights(short.select("elem_id", "book_id", "page_index", "list_pos", "type", "dropped", "bbox", "text"), pages)))
    heads = running_heads(margin_candidates(flagged)).select("elem_id")
    return cut(flagged.where("dropped").select("elem_id").unionByName(heads).distinct())


def page_range(pages: DataFrame, totals: DataFrame, first: int = 0, last: int = 0) -> DataFrame:
    """Pages that are recognised: without the first and last ones that are only rendered."""
    return pages.join(totals.select("book_id", "total_pages"), "book_id").where((F.col("page_index") >= first) & (F.col("page_index") < F.col("total_pages") - last))
