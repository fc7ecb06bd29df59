"""Page types: one row of features for each page, then one ordered CASE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import ratcliff, trim_all
from quire.operators.flags import TITLES
from quire.operators.outline import live

#: Labels and key words.
IMAGES = ("image", "figure", "chart")
CONTENT = ("text", "paragraph_title", "doc_title", "content_title", "figure_title")
COPYRIGHT = ("图书在版编目", "CIP数据", "ISBN", "版权所有", "出版编目")
PUBLISHING = ("出版社", "印刷", "发行", "版次", "印次", "开本", "字数", "责任编辑", "定价")
BACK_COVER = ("定价", "上架建议", "责任编辑", "美术编辑", "责任校对", "封面设计")
PREFACE = ("前言", "序言", "序", "后记", "跋", "引言")
APPENDIX = ("附录", "索引", "参考文献", "参考书目")
TOC_WORDS = ("目录", "目 录", "CONTENTS", "Contents", "contents")
SENTENCE = "[。！？；]"
DOTS, SLASH = r"(?m)^.+?[…\.·]{3,}\s*\d+\s*$", r"(?m)^.+?[/／]\s*\d+\s*$"
FRONT, BACK, BODY_CHARS, TOC_SHARE, FUZZY = 5, 3, 50, 0.4, 0.6
ORDER = ("cover", "frontispiece", "copyright", "preface", "toc", "body", "appendix", "back_cover")
DECORATIVE = ("cover", "frontispiece", "copyright", "illustration", "back_cover")


def words_present(text: Column, words: tuple[str, ...]) -> Column:
    """How many different key words a text holds."""
    return sum((text.contains(w).cast("int") for w in words[1:]), text.contains(words[0]).cast("int"))


def page_features(elements: DataFrame, books: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each page with a row in ``pages`` or ``elements``; all counts in one aggregation."""
    info = books.groupBy("book_id").agg(F.max("title").alias("t"), F.max("author").alias("book_author"))
    info = info.select("book_id", F.when(F.col("t") != "Untitled", F.col("t")).otherwise("").alias("book_title"), "book_author")
    e = elements.where(live()).join(info, "book_id", "left")
    text = F.coalesce("text", F.lit(""))
    title, kind = F.col("type").isin(*TITLES), F.col("type")
    short = (kind == "text") & (F.length(trim_all(text)) <= 20) & ~text.rlike(SENTENCE)
    area = F.greatest(F.lit(0.0), F.col("bbox.x2") - F.col("bbox.x1")) * F.greatest(F.lit(0.0), F.col("bbox.y2") - F.col("bbox.y1"))
    agg = e.groupBy("book_id", "page_index").agg(
        F.count_if(kind == "text").alias("n_text"), F.count_if(kind.isin(*CONTENT)).alias("n_content"), F.count_if(title).alias("n_title"), F.count_if(kind.isin(*IMAGES)).alias("n_image"), F.count_if(kind == "figure_title").alias("n_caption"),
        F.sum(F.when(kind.isin(*CONTENT), F.length(text)).otherwise(0)).alias("chars"), F.bool_or(F.coalesce(text.rlike(SENTENCE), F.lit(False))).alias("has_sentence"),
        F.bool_or((F.coalesce("book_title", F.lit("")) != "") & text.contains(F.col("book_title")) & (title | short)).alias("has_title"),
        F.bool_or(title & trim_all(text).rlike("^(?:" + "|".join(PREFACE) + ")")).alias("preface"), F.bool_or(title & trim_all(text).rlike("^(?:" + "|".join(APPENDIX) + ")")).alias("appendix"),
        F.sum(F.when(kind.isin(*IMAGES), area).otherwise(0.0)).alias("image_area"), F.max("book_title").alias("book_title"), F.max("book_author").alias("book_author"),
        F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.when(text != "", F.struct("list_pos", "elem_id", text.alias("text"))))), lambda x: x["text"])).alias("page_text"),
    )
    size = pages.groupBy("book_id", "page_index").agg(F.max(F.col("width") * F.col("height")).alias("page_area"))
    total = pages.groupBy("book_id").agg(F.count_distinct("page_index").alias("total"))
    return agg.join(size, ["book_id", "page_index"], "left").join(total, "book_id", "left").withColumn("image_share", F.when(F.col("page_area") > 0, F.col("image_area") / F.col("page_area")).otherwise(0.0))


def contents_entries(page_text: Column) -> Column:
    """Lines with leader dots or a slash before a page number."""
    return F.size(F.regexp_extract_all(page_text, F.lit(DOTS), F.lit(0))) + F.size(F.regexp_extract_all(page_text, F.lit(SLASH), F.lit(0)))


def fuzzy_contents(features: DataFrame, elements: DataFrame) -> DataFrame:
    """(book_id, page_index, toc_share): share of a page's slash entries that name a title of the book.

    Only pages with two entries or more are looked at; containment is tried
    before similarity, which alone runs in Python.
    """
    titles = elements.where(live() & F.col("type").isin(*TITLES)).select("book_id", trim_all(F.col("text")).alias("name")).where(F.length("name") >= 2).distinct()
    lines = features.where(contents_entries(F.col("page_text")) >= 2).select("book_id", "page_index", F.posexplode(F.regexp_extract_all("page_text", F.lit(SLASH), F.lit(0))).alias("no", "line"))
    lines = lines.withColumn("entry", trim_all(F.regexp_replace("line", r"[/／]\s*\d+\s*$", "")))
    met = lines.join(titles, "book_id", "left")
    inside = (F.col("entry") != "") & (F.col("name").contains(F.col("entry")) | F.col("entry").contains(F.col("name")))
    sure = met.groupBy("book_id", "page_index", "no").agg(F.bool_or(F.coalesce(inside, F.lit(False))).alias("hit"))
    open_ = met.join(sure.where(~F.col("hit")), ["book_id", "page_index", "no"], "left_semi").where("name is not null")
    near = open_.where(ratcliff(F.col("entry"), F.col("name")) >= FUZZY).select("book_id", "page_index", "no").distinct().withColumn("near", F.lit(True))
    return sure.join(near, ["book_id", "page_index", "no"], "left").groupBy("book_id", "page_index").agg(F.avg((F.col("hit") | F.coalesce("near", F.lit(False))).cast("double")).alias("toc_share"))


def page_type(fuzzy: bool) -> Column:
    """The first rule that holds, over :func:`page_features` (and ``toc_share`` if ``fuzzy``)."""
    p, text = F.col("page_index"), F.coalesce("page_text", F.lit(""))
    entries = contents_entries(text)
    heading, image = F.col("n_title") > 0, F.col("n_image") > 0
    named = ((F.col("book_title") != "") & text.contains(F.col("book_title"))) | (F.coalesce("book_author", F.lit("")) != "") & text.contains(F.coalesce("book_author", F.lit("")))
    rules = (
        F.when((p < FRONT) & F.col("has_title"), F.when(p == 0, "cover").otherwise("frontispiece"))
        .when((p >= F.col("total") - BACK) & (words_present(text, BACK_COVER) >= 2), "back_cover")
        .when(words_present(text, COPYRIGHT) >= 1, "copyright")
        .when((p < FRONT) & (F.col("n_text") <= 10) & (words_present(text, PUBLISHING) >= 2), "copyright")
        .when((p == 0) & (F.col("n_text") <= 3) & ~heading & image, "cover")
        .when(p.between(1, 2) & ~F.col("has_sentence") & (F.coalesce(named, F.lit(False)) & (F.col("n_content") <= 5) | image & (F.col("n_text") <= 5) | ~image & (F.col("n_text") <= 5) & ~heading), "frontispiece")
        .when((words_present(text, TOC_WORDS) >= 1) & (entries >= 3) | (entries >= 5), "toc")
    )
    if fuzzy:
        rules = rules.when((entries >= 2) & (F.coalesce("toc_share", F.lit(0.0)) >= TOC_SHARE), "toc")
    return (
        rules.when(F.col("preface"), "preface").when(F.col("appendix"), "appendix").when(image & ((F.col("n_content") == 0) | (F.col("image_share") > 0.6) & (F.col("n_content") <= 2)), "illustration")
        .when((F.col("n_content") > 0) & (heading | (F.col("chars") >= BODY_CHARS) | F.col("has_sentence") | (F.col("n_caption") > 0)), "body").otherwise("unknown")
    )


def classify(elements: DataFrame, books: DataFrame, pages: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(book_id, page_index, page_type)."""
    features = page_features(elements, books, pages)
    if fuzzy:
        features = features.join(fuzzy_contents(features, elements), ["book_id", "page_index"], "left")
    return features.select("book_id", "page_index", page_type(fuzzy).alias("page_type"))


def structure(types: DataFrame) -> DataFrame:
    """Per book: types in the order of their first page, expected ones that are missing, and whether the order is unusual."""
    firsts = types.where("page_type <> 'unknown'").groupBy("book_id", "page_type").agg(F.min("page_index").alias("first"), F.count("*").alias("n"))
    books = firsts.groupBy("book_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "page_type"))), lambda x: x["page_type"]).alias("found"))
    expected = F.array(*[F.lit(x) for x in ORDER])
    known = F.filter("found", lambda x: F.array_contains(expected, x))
    ranks = F.transform(known, lambda x: F.array_position(expected, x))
    return books.select("book_id", "found", F.array_except(expected, "found").alias("missing"), (ranks != F.sort_array(ranks)).alias("unusual_order"))
