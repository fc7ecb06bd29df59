"""Contents entries: parsing, and linking to chapter anchors by ranked strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import is_toc_noise, split_volumes, trim_all
from quire.runtime import cut

#: Labels that are no entries.
CATEGORIES = ("山经", "海经")


def parse_lines(lines: DataFrame) -> DataFrame:
    """(doc, line_no, no, title, page) of contents lines: split at a slash with an optional page number, then at volume titles."""
    t = trim_all(F.col("line"))
    body = lines.where((t != "") & ~t.rlike(r"^#{1,6}\s") & ~is_toc_noise(t))
    pieces = F.regexp_extract_all(F.concat(t, F.lit("\n")), F.lit(r"([^／/\n]*)(?:[／/]\s*(\d+)?|\n)"), F.lit(0))
    rows = body.select("doc", "line_no", F.posexplode(pieces).alias("piece_no", "piece"))
    rows = rows.select("doc", "line_no", "piece_no", trim_all(F.regexp_extract("piece", r"^([^／/\n]*)", 1)).alias("text"), F.nullif(F.regexp_extract("piece", r"[／/]\s*(\d+)", 1), F.lit("")).alias("page"))
    rows = rows.where((F.col("text") != "") & ~is_toc_noise(F.col("text")))
    out = rows.select("doc", "line_no", "piece_no", "page", F.posexplode(split_volumes(F.col("text"))).alias("part_no", "title"))
    return out.where(~is_toc_noise(F.col("title"))).select("doc", "line_no", (F.col("piece_no") * 1000 + F.col("part_no")).alias("no"), "title", "page")


GRAM = 4


def _grams(text, sizes):
    """The different substrings of a text of the lengths in the array ``sizes``."""
    def of(k):
        return F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substr(text, i, k))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(sizes, of)))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(key, a, b): pairs of one key where text ``a`` of ``inner`` stands inside text ``b`` of ``outer``.

    A text meets only the texts that hold its rarest group of characters in the
    key, not all of the key. Groups are made only of the lengths that texts of
    ``inner`` in the key are found by. Both have columns (key, text), without
    empty texts.
    """
    own = inner.select("key", F.col("text").alias("a")).distinct().withColumn("size", F.least(F.length("a"), F.lit(GRAM)))
    sizes = own.groupBy("key").agg(F.collect_set("size").alias("sizes"))
    held = outer.select("key", F.col("text").alias("b")).distinct().join(sizes, "key").select("key", "b", F.explode(_grams(F.col("b"), F.col("sizes"))).alias("gram"))
    counts = held.groupBy("key", "gram").agg(F.count("*").alias("n"))
    parts = own.select("key", "a", F.explode(_grams(F.col("a"), F.array("size"))).alias("gram"))
    rarest = parts.join(counts, ["key", "gram"]).groupBy("key", "a").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return rarest.join(held, ["key", "gram"]).where(F.col("b").contains(F.col("a"))).select("key", "a", "b")


def link(entries: DataFrame, anchors: DataFrame) -> DataFrame:
    """Entries (book_id, pos, title, ...) with the anchor they name, or null.

    Ranks: equal; equal without spaces; one inside the other; same first four
    characters. Within a rank the first anchor by place wins. All ranks are
    equi-joins with one row for each key: containment, by :func:`contained`, is
    looked for only where no name is equal. Titles and names are written first,
    as all ranks read them. ``anchors`` are (book_id, place, name, anchor).
    """
    e = cut(entries.where("title is not null and title <> ''").select("book_id", "pos", "title").distinct())
    first = F.min(F.struct("place", "anchor"))
    a = cut(anchors.where("name <> ''").groupBy("book_id", "name").agg(first.alias("x")).select("book_id", "name", "x.place", "x.anchor"))
    titles, spaceless, head = e.select("book_id", "title").distinct(), lambda c: F.replace(F.col(c), F.lit(" "), F.lit("")), lambda c: F.left(F.col(c), F.lit(4))
    equal = a.select("book_id", F.col("name").alias("title"), F.struct("place", "anchor").alias("m1"))
    loose = a.groupBy("book_id", spaceless("name").alias("k2")).agg(first.alias("m2"))
    alike = a.groupBy("book_id", head("name").alias("k4")).agg(first.alias("m4"))
    met = titles.withColumns({"k2": spaceless("title"), "k4": F.when(F.length("title") >= 4, head("title"))}).join(equal, ["book_id", "title"], "left").join(loose, ["book_id", "k2"], "left").join(alike, ["book_id", "k4"], "left")
    met = cut(met.select("book_id", "title", "m1", "m2", "m4"))
    open_, names = met.where("m1 is null and m2 is null").select(F.col("book_id").alias("key"), F.col("title").alias("text")), a.select(F.col("book_id").alias("key"), F.col("name").alias("text"))
    inside = contained(open_, names).select(F.col("key").alias("book_id"), F.col("a").alias("title"), F.col("b").alias("name")).unionByName(contained(names, open_).select(F.col("key").alias("book_id"), F.col("b").alias("title"), F.col("a").alias("name")))
    part = inside.join(a, ["book_id", "name"]).groupBy("book_id", "title").agg(first.alias("m3"))
    ranks = F.coalesce(*[F.when(F.col(f"m{k}").isNotNull(), F.struct(F.lit(k).alias("rank"), F.col(f"m{k}.anchor").alias("anchor"))) for k in (1, 2, 3, 4)])
    best = met.join(part, ["book_id", "title"], "left").select("book_id", "title", ranks.alias("m"))
    return e.join(best, ["book_id", "title"], "left").select("book_id", "pos", "title", "m.rank", "m.anchor")


def render(linked: DataFrame) -> DataFrame:
    """(book_id, toc_md): entries as a fenced list, linked where an anchor was found."""
    item = F.when(F.col("title").isin(*CATEGORIES), F.concat(F.lit("- **"), "title", F.lit("**"))).when(F.col("anchor").isNotNull(), F.concat(F.lit("- ["), "title", F.lit("]("), "anchor", F.lit(")"))).otherwise(F.concat(F.lit("- "), "title"))
    rows = F.sort_array(F.collect_list(F.struct("pos", item.alias("item"))))
    return linked.groupBy("book_id").agg(F.concat(F.lit("::: {.toc-list}\n"), F.concat_ws("\n", F.transform(rows, lambda x: x["item"])), F.lit("\n:::")).alias("toc_md"))


#: The formats of chapter and contents headings.
CHAPTER_LINE = r"^#{1,3}\s+(.+?)\s*\{#(ch-\d+)\}\s*$"
TOC_HEADING = r"^#{1,6}\s+.*(?:目录|目\s*录|CONTENTS|Contents|contents).*$"


def chapter_anchors(lines: DataFrame) -> DataFrame:
    """(doc, place, name, anchor) of headings of levels 1 to 3 with a chapter anchor."""
    return lines.where(F.col("line").rlike(CHAPTER_LINE)).select("doc", F.col("line_no").alias("place"), trim_all(F.regexp_extract("line", CHAPTER_LINE, 1)).alias("name"), F.concat(F.lit("#"), F.regexp_extract("line", CHAPTER_LINE, 2)).alias("anchor"))


def regions(lines: DataFrame) -> DataFrame:
    """(doc, first, end): from the first contents heading to the first anchored chapter after it; documents without such a region have no row."""
    start = lines.where(F.col("line").rlike(TOC_HEADING)).groupBy("doc").agg(F.min("line_no").alias("first"))
    chapter = lines.where(F.col("line").rlike(CHAPTER_LINE)).select("doc", F.col("line_no").alias("at"))
    return start.join(chapter, "doc").where("at > first").groupBy("doc", "first").agg(F.min("at").alias("end")).join(lines.where(F.col("line").rlike(CHAPTER_LINE)).select("doc", F.col("line_no").alias("first")), ["doc", "first"], "left_anti")


def linkify(lines: DataFrame) -> DataFrame:
    """Lines with the contents region replaced by a linked list; the same lines where there is no region, no anchor, or a list already.

    A heading of level 1 and the div marks of the region stay. Doing it twice changes nothing.
    """
    done = lines.where(F.col("line").contains("::: {.toc-list}")).select("doc").distinct()
    found = regions(lines).join(done, "doc", "left_anti")
    inside = lines.join(found, "doc").where("line_no >= first and line_no < end")
    entries = parse_lines(inside.select("doc", "line_no", "line"))
    keyed = entries.select(F.col("doc").cast("string").alias("book_id"), (F.col("line_no").cast("bigint") * 1_000_000 + F.col("no")).alias("pos"), "title")
    anchors = chapter_anchors(lines).select(F.col("doc").cast("string").alias("book_id"), "place", "name", "anchor")
    lists = render(link(keyed, anchors)).select(F.col("book_id").alias("d"), "toc_md")
    marks = inside.groupBy("doc", "first", "end").agg(
        F.max(F.when(F.col("line_no") == F.col("first"), F.when(F.col("line").rlike(r"^# "), F.rtrim("line")))).alias("heading"),
        F.bool_or(F.col("line").rlike(r"^:::\s*$")).alias("close"), F.bool_or(F.col("line").contains("::: {.chapter}")).alias("open"),
    )
    new = marks.join(lists, marks.doc.cast("string") == F.col("d"))
    text = F.concat_ws("\n\n", "heading", "toc_md", F.when(F.col("close"), ":::"), F.when(F.col("open"), "::: {.chapter}"))
    kept = lines.join(new.select("doc", "first", "end"), "doc", "left").where("first is null or line_no < first or line_no >= end").select("doc", "line_no", "line")
    return kept.unionByName(new.select("doc", F.col("first").cast("int").alias("line_no"), text.alias("line")))
