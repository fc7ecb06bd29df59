"""Heading levels and chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import CHAPTER, CHAPTER_LATIN, SECTION, numbering_depth, trim_all
from quire.operators.flags import TITLES
from quire.operators.ordered import running_sum

#: Text heights, against the median, from which a title is of level 1 or 2; front matter.
H1_RATIO, H2_RATIO, DEFAULT_LEVEL = 2.0, 1.4, 3
FRONT_MATTER = ("前言", "序言", "序$", "后记", "附录", "绪论", "引言", "跋", "结语", "参考文献", "目录", "CONTENTS")


def live() -> Column:
    return ~F.coalesce("dropped", F.lit(False))


def text_height() -> Column:
    return F.col("bbox.y2") - F.col("bbox.y1")


def median_heights(elements: DataFrame) -> DataFrame:
    """(book_id, median_height) of live texts with a height; books without any have no row."""
    return elements.where(live() & (F.col("type") == "text") & (text_height() > 0)).groupBy("book_id").agg(F.median(text_height()).alias("median_height"))


def first_level(title: Column, height: Column, median: Column) -> Column:
    """Level of a title by chapter or section words, numbering, then height against the median."""
    t = trim_all(title)
    ratio = F.when(median > 0, height / median)
    return (
        F.when(t.rlike(f"(?i)^(?:{CHAPTER})") | t.rlike("^" + CHAPTER_LATIN), 1).when(t.rlike("^" + SECTION), 2).when(numbering_depth(t).isNotNull(), numbering_depth(t))
        .when(ratio >= H1_RATIO, 1).when(ratio >= H2_RATIO, 2).otherwise(DEFAULT_LEVEL)
    )


def title_levels(elements: DataFrame) -> DataFrame:
    """Live, non-empty titles with ``level`` by rule and, where all of a book are of level 3, promoted to 1."""
    titles = elements.where(live() & F.col("type").isin(*TITLES) & (trim_all(F.coalesce("text", F.lit(""))) != ""))
    rated = titles.join(median_heights(elements), "book_id", "left").withColumn("rule_level", first_level(F.col("text"), text_height(), F.col("median_height")).cast("int"))
    flat = rated.groupBy("book_id").agg((F.min("rule_level") == 3).alias("lo"), (F.max("rule_level") == 3).alias("hi")).select("book_id", (F.col("lo") & F.col("hi")).alias("flat"))
    return rated.join(flat, "book_id").withColumn("level", F.when(F.col("flat"), 1).otherwise(F.col("rule_level"))).drop("flat")


def enforce_order(levels: DataFrame) -> DataFrame:
    """``final_level``: in reading order, a level stands only if the one above it was met, else it moves up.

    Front matter does not move above level 2. The fold runs over a book's
    titles only, and its state is the set of levels met.
    """
    floor = F.when(F.col("text").rlike("^\\s*(?:" + "|".join(FRONT_MATTER) + ")"), 2).otherwise(1)
    entry = F.struct("page_index", "list_pos", "elem_id", F.col("level").alias("level"), floor.alias("floor"))
    books = levels.groupBy("book_id").agg(F.sort_array(F.collect_list(entry)).alias("titles"))
    start = F.struct(F.array().cast("array<int>").alias("seen"), F.array().cast("array<struct<elem_id:bigint,final_level:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        lvl, low = t["level"], t["floor"]
        above = F.filter(F.sequence(low + 1, F.greatest(lvl, low + 1)), lambda k: (k <= lvl) & F.array_contains(acc["seen"], k - 1))
        new = F.when(lvl <= low, lvl).otherwise(F.coalesce(F.array_max(above), low)).cast("int")
        return F.struct(F.array_distinct(F.concat(acc["seen"], F.array(new))).alias("seen"), F.concat(acc["out"], F.array(F.struct(t["elem_id"].alias("elem_id"), new.alias("final_level")))).alias("out"))

    folded = books.select("book_id", F.explode(F.aggregate("titles", start, step, lambda acc: acc["out"])).alias("x"))
    return levels.join(folded.select("book_id", "x.*").dropDuplicates(["book_id", "elem_id"]), ["book_id", "elem_id"], "left")


def chapter_numbers(levels: DataFrame, level: str = "level") -> DataFrame:
    """``chapter`` of each title of level 1, counted from 1 in reading order."""
    return running_sum(levels.where(F.col(level) == 1), F.lit(1), "chapter")


def level_histogram(levels: DataFrame, level: str = "level") -> DataFrame:
    """Per book: titles of levels 1 to 3, and the depth of contents and splitting they suggest."""
    n = [F.count_if(F.col(level) == k).alias(f"h{k}") for k in (1, 2, 3)]
    counts = levels.groupBy("book_id").agg(*n)
    return counts.withColumn("toc_depth", F.when(F.col("h3") > 0, 3).when(F.col("h2") > 0, 2).otherwise(1)).withColumn("chapter_level", F.when(F.col("h1") >= 2, 1).when(F.col("h2") > 0, 2).otherwise(1))
