"""Paragraph merging, Markdown blocks and books, metadata of the copyright page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import CJK, clean_field, ends_closed, last_is_toc_line, plain_date, starts_block, toc_lines, trim_all
from quire.operators.classify import DECORATIVE, IMAGES
from quire.operators.flags import TITLES
from quire.operators.ordered import previous, running_sum
from quire.operators.outline import live
from quire.runtime import cut

#: The cataloguing block's header and main line, and the number of the book.
CIP_HEADER = r"图书在版编目\s*[（(]CIP[)）]\s*数据"
CIP_LINE = r"(.+?)\s*/\s*(.+?)\s*[．.·一。]\s*([^：:]+)\s*[：:]\s*([^，,]+)\s*[，,]\s*(\d{4}[.\-年]\d{1,2}(?:月)?)"
ISBN = r"ISBN\s*[:：]?\s*([\d\-]+)"
FORMULAS = ("formula", "display_formula")
READING = ("page_index", "order_index", "list_pos", "elem_id")


def body_order() -> Column:
    return F.struct("page_index", F.coalesce("order_index", F.lit(0)).alias("order_index"), "list_pos", "elem_id")


def merge_paragraphs(elements: DataFrame) -> DataFrame:
    """Live texts with pieces that run on over a page joined: (book_id, elem_id, pieces, text) of each paragraph's first piece.

    A piece runs on from the one before it in reading order if it stands on
    another page, neither is of low confidence, the first does not end closed
    and the second does not open a block. A run whose accumulated text ends in,
    or holds, contents lines is divided further, in Python, run by run; all
    others are aggregated.
    """
    members = run_members(elements)
    alone = elements.where(_body_text()).join(members.select("elem_id"), "elem_id", "left_anti")
    return alone.select("book_id", "elem_id", F.lit(1).alias("pieces"), "text").unionByName(merged_runs(elements, members))


def _body_text() -> Column:
    return live() & (F.col("type") == "text") & F.col("text").isNotNull()


def run_members(elements: DataFrame) -> DataFrame:
    """(book_id, island, elem_id, toc_like) of the texts in runs of two pieces or more, written.

    Runs are found by the previous piece alone, over rows without their texts,
    which are written first, as ordering reads them several times.
    """
    weak, t = F.coalesce("low_confidence", F.lit(False)).alias("weak"), F.col("text")
    toc_like = t.rlike(r"(?m)[/／]\s*\d+\s*$") | t.rlike(r"^\s*\d+\s*$")
    rows = cut(elements.where(_body_text()).select("book_id", "page_index", F.coalesce("order_index", F.lit(0)).alias("order_index"), "list_pos", "elem_id", weak, ends_closed(t).alias("closed"), starts_block(t).alias("opens"), toc_like.alias("toc_like")))
    rows = previous(rows, ("page_index", "weak", "closed"), "p_", order=READING)
    runs_on = (F.col("p_page_index") != F.col("page_index")) & ~F.col("p_weak") & ~F.col("weak") & ~F.col("p_closed") & ~F.col("opens")
    rows = running_sum(rows.withColumn("head", ~F.coalesce(runs_on, F.lit(False))), F.col("head"), "island", order=READING)
    runs = rows.groupBy("book_id", "island").agg(F.collect_list("elem_id").alias("ids"), F.bool_or("toc_like").alias("toc_like")).where(F.size("ids") > 1)
    return cut(runs.select("book_id", "island", F.explode("ids").alias("elem_id"), "toc_like"))


def merged_runs(elements: DataFrame, members: DataFrame) -> DataFrame:
    """(book_id, elem_id, pieces, text) of the paragraphs that the runs of :func:`run_members` give."""
    texts = elements.where(_body_text()).select("elem_id", "page_index", F.coalesce("order_index", F.lit(0)).alias("order_index"), "list_pos", "text")
    pieces = F.sort_array(F.collect_list(F.struct(*READING, F.col("text").alias("text"))))
    joined = texts.join(members, "elem_id").groupBy("book_id", "island").agg(pieces.alias("p"), F.bool_or("toc_like").alias("toc_like"))
    seam = lambda acc, x: F.when(F.right(acc, F.lit(1)).rlike(f"[{CJK}]") & F.left(trim_all(x["text"]), F.lit(1)).rlike(f"[{CJK}]"), F.concat(acc, trim_all(x["text"]))).otherwise(F.concat_ws(" ", acc, trim_all(x["text"])))
    text = F.aggregate(F.slice("p", 2, F.size("p")), trim_all(F.col("p")[0]["text"]), seam)
    plain = joined.where(~F.col("toc_like")).select("book_id", F.col("p")[0]["elem_id"].alias("elem_id"), F.size("p").alias("pieces"), text.alias("text"))
    listed = joined.where("toc_like").select("book_id", F.transform("p", lambda x: F.struct(x["elem_id"].alias("elem_id"), x["text"].alias("text"))).alias("p"))
    return plain.unionByName(listed.mapInPandas(_divide_runs, "book_id string, elem_id bigint, pieces int, text string"))


def _divide_runs(frames):
    """Runs with contents lines, divided where the text so far ends in one or holds two."""
    import re

    import pandas as pd

    line = re.compile(r"[/／]\s*\d+\s*$")
    cjk = re.compile(r"[一-鿿㐀-䶿\U00020000-\U0002a6df　-〿＀-￯]")
    for frame in frames:
        out: list[list] = []
        for book, run in zip(frame["book_id"], frame["p"]):
            for k, piece in enumerate(run):
                if k:
                    a = out[-1][3].strip()
                    lines = [x.strip() for x in a.split("\n")]
                    if not (sum(bool(line.search(x)) for x in lines) >= 2 or line.search(next((x for x in reversed(lines) if x), ""))):
                        b = piece["text"].strip()
                        out[-1][3] = a + b if a and b and cjk.match(a[-1]) and cjk.match(b[0]) else f"{a} {b}".strip()
                        out[-1][2] += 1
                        continue
                out.append([book, piece["elem_id"], 1, piece["text"]])
        yield pd.DataFrame(out, columns=["book_id", "elem_id", "pieces", "text"])


def markdown_blocks(elements: DataFrame, types: DataFrame, levels: DataFrame) -> DataFrame:
    """One Markdown block for each rendered element or page: (book_id, page_index, order, elem_id, kind, block).

    Covers are left out; decorative pages become one image block, but an
    illustration page with live images follows its elements; empty elements
    give no block. ``levels`` has ``elem_id`` and ``level``.
    """
    e = elements.where(live()).join(types, ["book_id", "page_index"], "left")
    text = trim_all(F.coalesce("text", F.lit("")))
    image = F.col("type").isin(*IMAGES)
    by_element = e.groupBy("book_id", "page_index").agg(F.bool_or(image).alias("has_image"))
    page_kind = types.join(by_element, ["book_id", "page_index"], "left")
    as_image = F.col("page_type").isin(*[t for t in DECORATIVE if t != "cover"]) & ~((F.col("page_type") == "illustration") & F.coalesce("has_image", F.lit(False)))
    images = page_kind.where(as_image).select("book_id", "page_index", F.lit(0).alias("order_index"), F.lit(0).alias("list_pos"), F.lit(None).cast("bigint").alias("elem_id"), F.lit("page").alias("kind"), F.format_string("![](pages/page_%04d.png)", "page_index").alias("block"))
    kept = e.join(page_kind.where(as_image).select("book_id", "page_index"), ["book_id", "page_index"], "left_anti").where(F.coalesce("page_type", F.lit("unknown")) != "cover")
    kept = kept.join(levels.select("elem_id", "level").dropDuplicates(["elem_id"]), "elem_id", "left")
    depth = F.least(F.coalesce("level", F.lit(3)), F.lit(6))
    title = F.col("type").isin(*TITLES)
    kept = kept.withColumn("order_index", F.coalesce("order_index", F.lit(0))).where((text != "") | image)
    kept = running_sum(kept, F.coalesce(title & (depth == 1), F.lit(False)).cast("int"), "chapter_no", order=READING)
    chapter = F.col("chapter_no")
    block = (
        F.when(title, F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), text, F.when(depth == 1, F.concat(F.lit(" {#ch-"), chapter.cast("string"), F.lit("}"))).otherwise("")))
        .when(image, F.concat(F.lit("!["), F.coalesce("image_caption", F.lit("")), F.format_string("](images/p%d_e%d.png)", "page_index", "list_pos")))
        .when(F.col("type").isin(*FORMULAS), F.concat(F.lit("$$\n"), text, F.lit("\n$$"))).when(F.coalesce("low_confidence", F.lit(False)), F.concat(F.lit(">[low-confidence] "), text)).otherwise(text)
    )
    kind = F.when(title, "title").when(image, "image").when(F.col("type") == "table", "table").when(F.col("type").isin(*FORMULAS), "formula").otherwise("text")
    return kept.select("book_id", "page_index", "order_index", "list_pos", "elem_id", kind.alias("kind"), block.alias("block")).unionByName(images)


def books_markdown(blocks: DataFrame) -> DataFrame:
    """(book_id, book_md): each book's blocks joined by blank lines. A book's text must fit one row."""
    rows = F.sort_array(F.collect_list(F.struct("page_index", "order_index", "list_pos", F.coalesce("elem_id", F.lit(-1).cast("bigint")).alias("e"), "block")))
    return blocks.groupBy("book_id").agg(F.concat(F.rtrim(F.concat_ws("\n\n", F.transform(rows, lambda x: x["block"]))), F.lit("\n")).alias("book_md"))


def lost_pages(blocks: DataFrame, types: DataFrame) -> DataFrame:
    """Decorative pages without any block; empty unless a page was lost."""
    wanted = types.where(F.col("page_type").isin(*[t for t in DECORATIVE if t != "cover"]))
    return wanted.join(blocks.select("book_id", "page_index"), ["book_id", "page_index"], "left_anti")


def page_texts(elements: DataFrame) -> DataFrame:
    """(book_id, page_index, page_text) of live, non-empty elements in list order."""
    rows = F.sort_array(F.collect_list(F.struct("list_pos", "elem_id", "text")))
    return elements.where(live() & (F.coalesce("text", F.lit("")) != "")).groupBy("book_id", "page_index").agg(F.concat_ws("\n", F.transform(rows, lambda x: x["text"])).alias("page_text"))


def cataloguing(elements: DataFrame) -> DataFrame:
    """(book_id, title, author, publisher, pub_date, rights) from the first page with a cataloguing block.

    The main line may stand on the next page: the header's page is joined with
    its follower, no other page is moved.
    """
    pages = page_texts(elements)
    headers = pages.where(F.col("page_text").rlike(CIP_HEADER))
    after = pages.select("book_id", (F.col("page_index") - 1).alias("page_index"), F.col("page_text").alias("next_text"))
    both = headers.join(after, ["book_id", "page_index"], "left")
    text = F.when(F.col("page_text").rlike(CIP_LINE), F.col("page_text")).otherwise(F.concat_ws("\n", "page_text", "next_text"))
    hit = both.withColumn("t", text).where(F.col("t").rlike(CIP_LINE))
    part = lambda k: clean_field(F.regexp_extract("t", CIP_LINE, k))
    isbn = F.regexp_extract("t", ISBN, 1)
    rows = hit.select("book_id", "page_index", F.struct(F.coalesce(F.nullif(part(1), F.lit("")), F.lit("Untitled")).alias("title"), F.coalesce(F.nullif(part(2), F.lit("")), F.lit("Unknown")).alias("author"), F.nullif(part(4), F.lit("")).alias("publisher"), plain_date(F.regexp_extract("t", CIP_LINE, 5)).alias("pub_date"), F.when(isbn != "", F.concat(F.lit("ISBN "), isbn)).alias("rights")).alias("m"))
    return rows.groupBy("book_id").agg(F.min_by("m", "page_index").alias("m")).select("book_id", "m.*")


def metadata(books: DataFrame, found: DataFrame) -> DataFrame:
    """Books' metadata, with what the cataloguing block says before what the file says."""
    f = found.select("book_id", *[F.col(c).alias(f"f_{c}") for c in ("title", "author", "publisher", "pub_date", "rights")])
    own = lambda c, default: F.coalesce(F.col(f"f_{c}"), F.nullif(trim_all(F.col(c)), F.lit("")), F.lit(default))
    return books.dropDuplicates(["book_id"]).join(f, "book_id", "left").select("book_id", own("title", "Untitled").alias("title"), own("author", "Unknown").alias("author"), own("publisher", None).alias("publisher"), own("pub_date", None).alias("pub_date"), own("rights", None).alias("rights"), F.coalesce("lang", F.lit("zh-CN")).alias("lang"), F.coalesce("toc_depth", F.lit(2)).alias("toc_depth"), F.coalesce("chapter_level", F.lit(1)).alias("chapter_level"))


__all__ = ["merge_paragraphs", "markdown_blocks", "books_markdown", "lost_pages", "page_texts", "cataloguing", "metadata", "toc_lines", "last_is_toc_line"]


def process(elements: DataFrame, pages: DataFrame, settings=None) -> DataFrame:
    """The post-processing chain in its order: marks, confidence, furniture, merging, captions; each step by its setting.

    Merged pieces are kept with ``dropped`` set; their text stands in the first piece.
    What is furniture and what runs on is found over narrow rows that are
    written, so that no step repeats the ones before it for each of its joins.
    """
    from quire.functions.text import normalise_punctuation
    from quire.operators import flags
    from quire.sources.files import Settings

    s = settings or Settings()
    e = elements
    if s.normalize_punctuation:
        e = e.withColumn("text", F.when(live(), normalise_punctuation(F.col("text"))).otherwise(F.col("text")))
    if s.min_confidence > 0:
        e = flags.confidence_tiers(e, s.noise_confidence, s.low_confidence, s.min_confidence, s.confidence_types)
    if s.remove_headers:
        gone = flags.furniture_ids(e, pages).withColumn("gone", F.lit(True))
        e = e.join(gone, "elem_id", "left").withColumn("dropped", F.coalesce("dropped", F.lit(False)) | F.coalesce(F.col("type").isin(*flags.FURNITURE), F.lit(False)) | F.coalesce("gone", F.lit(False))).drop("gone")
    elif s.remove_numbers:
        e = flags.drop_furniture(flags.with_heights(e, pages), by_label=False).drop("page_height")
    if s.merge:
        members = run_members(e)
        merged = members.select("elem_id", F.lit(True).alias("in_run")).join(merged_runs(e, members).select("elem_id", F.col("text").alias("merged_text")), "elem_id", "left")
        e = e.join(merged, "elem_id", "left")
        e = e.withColumns({"dropped": F.coalesce("dropped", F.lit(False)) | (F.coalesce("in_run", F.lit(False)) & F.col("merged_text").isNull()), "text": F.coalesce("merged_text", "text")}).drop("merged_text", "in_run")
    return captions(e)


def captions(elements: DataFrame) -> DataFrame:
    """Images with a box: their text becomes the caption and the text the path of the cut image."""
    image = live() & F.col("type").isin(*IMAGES) & F.col("bbox").isNotNull() & (F.col("bbox.x2") > F.col("bbox.x1")) & (F.col("bbox.y2") > F.col("bbox.y1"))
    return elements.withColumns({"image_caption": F.when(image, F.nullif(trim_all(F.col("text")), F.lit(""))).otherwise(F.col("image_caption")), "text": F.when(image, F.format_string("images/p%d_e%d.png", "page_index", "list_pos")).otherwise(F.col("text"))})


def covers(types: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, cover_index, cover_path): the first page of type cover, else page 0."""
    t = types.where("page_type = 'cover'").groupBy("book_id").agg(F.min("page_index").alias("c"))
    want = pages.select("book_id").distinct().join(t, "book_id", "left").select("book_id", F.coalesce("c", F.lit(0)).alias("cover_index"))
    paths = pages.groupBy("book_id", F.col("page_index").alias("cover_index")).agg(F.max("page_image_path").alias("cover_path"))
    return want.join(paths, ["book_id", "cover_index"], "left")


def with_page_markers(blocks: DataFrame) -> DataFrame:
    """Blocks with a page comment before the first block of each page that is not an image page."""
    marked = blocks.where("kind <> 'page'").select("book_id", "page_index").distinct()
    rows = marked.select("book_id", "page_index", F.lit(-1 << 30).alias("order_index"), F.lit(-1).alias("list_pos"), F.lit(None).cast("bigint").alias("elem_id"), F.lit("marker").alias("kind"), F.format_string("<!-- page: %d -->", "page_index").alias("block"))
    return blocks.unionByName(rows)


def wrapped_chapters(blocks: DataFrame) -> DataFrame:
    """(book_id, chapter, content): dialogue paragraphs in their div, each chapter's blocks joined in a chapter div; chapter 0 is what precedes the first."""
    dialogue = (F.col("kind") == "text") & F.col("block").rlike('^["“「]')
    body = F.when(dialogue, F.concat(F.lit("::: {.dialogue}\n"), "block", F.lit("\n:::"))).otherwise(F.col("block"))
    numbered = running_sum(blocks, ((F.col("kind") == "title") & F.col("block").startswith("# ")).cast("int"), "chapter", order=READING)
    rows = F.sort_array(F.collect_list(F.struct("page_index", "order_index", "list_pos", F.coalesce("elem_id", F.lit(-1).cast("bigint")).alias("e"), body.alias("body"))))
    text = F.concat_ws("\n\n", F.transform(rows, lambda x: x["body"]))
    return numbered.groupBy("book_id", "chapter").agg(text.alias("t")).select("book_id", "chapter", F.when(F.col("chapter") > 0, F.concat(F.lit("::: {.chapter}\n"), "t", F.lit("\n:::"))).otherwise(F.col("t")).alias("content"))
