"""Mining issues from Markdown lines, batching them, checking and applying corrections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quire.functions.text import GARBLED, LINE_ENDS, WILDCARDS, char_overlap, preserved_counts, trim_all
from quire.runtime import cut

#: Prefixes that are no body text, marks of a continued title, limits.
LOW = ">[low-confidence] "
NON_BODY = ("#", "!", ":::", "$$", "<table", "<!--", LOW)
DASHES = ("——", "—", "--", "～")
SHORT, CLUSTER, CONTEXT, WINDOW, BATCH, LEAST_OVERLAP, KEPT = 30, 3, 3, 3, 5, 0.5, 5
#: Contents entries and titles of a book that meet in one block.
ENTRY_BLOCK, NAME_BLOCK = 1024, 2048


def lines_of(books: DataFrame, key: str = "content_id", text: str = "book_md") -> DataFrame:
    """(doc, line_no, line): lines from 0, split at LF or CRLF. Null texts have no line."""
    return books.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.posexplode(F.split(text, r"\r?\n", -1)).alias("line_no", "line"))


def _order() -> W:
    return W.partitionBy("doc").orderBy("line_no")


def is_body(line: Column) -> Column:
    t = trim_all(line)
    out = t != ""
    for p in NON_BODY:
        out = out & ~t.startswith(p)
    return out


def is_short(line: Column) -> Column:
    t = trim_all(line)
    out = F.length(t) <= SHORT
    for end in LINE_ENDS:
        out = out & ~t.endswith(end)
    return out


def headings(lines: DataFrame) -> DataFrame:
    """Heading lines: level, title without anchor, anchor, and the line after."""
    pattern = r"^(#{1,6})[ \t]+(.+?)(?:[ \t]+\{#(ch-\d+)\})?[ \t]*$"
    with_next = lines.withColumn("next_line", F.lead("line").over(_order()))
    h = with_next.where(F.col("line").rlike(pattern))
    return h.select("doc", "line_no", F.length(F.regexp_extract("line", pattern, 1)).alias("level"), F.regexp_extract("line", pattern, 2).alias("title"), F.nullif(F.regexp_extract("line", pattern, 3), F.lit("")).alias("anchor"), "next_line")


def title_issue(title: Column, next_line: Column) -> Column:
    """``ocr_error``, ``too_short``, ``split_title`` or ``normal``."""
    n = trim_all(F.coalesce(next_line, F.lit("")))
    dash = n.startswith(DASHES[0])
    for d in DASHES[1:]:
        dash = dash | n.startswith(d)
    follows = (n != "") & ~n.startswith("#") & ~n.startswith(":::") & ~n.startswith("![")
    garbled = title.rlike("[" + "".join("\\" + c if c in "*?" else c for c in GARBLED) + "]")
    return F.when(garbled, "ocr_error").when(F.length(trim_all(title)) <= 2, "too_short").when(follows & (dash | is_short(next_line)), "split_title").otherwise("normal")


def title_issues(lines: DataFrame) -> DataFrame:
    """All level-1 headings, and others with an issue; ids T-1, T-2, ... in order."""
    h = headings(lines).withColumn("issue", title_issue(F.col("title"), F.col("next_line")))
    kept = h.where((F.col("level") == 1) | (F.col("issue") != "normal"))
    return kept.withColumn("id", F.concat(F.lit("T-"), F.row_number().over(_order()).cast("string"))).select("doc", "id", "line_no", "level", "title", "anchor", "issue")


def low_confidence_issues(lines: DataFrame) -> DataFrame:
    """Marked lines with their text, constraints and up to three lines of context on each side."""
    marked = F.col("line").startswith(LOW)
    shown = F.when((trim_all(F.col("line")) == "") | marked, F.lit(None)).otherwise(F.col("line"))
    cols = {"text": F.substr(F.col("line"), F.lit(len(LOW) + 1))}
    for name, get in (("before", F.lag), ("after", F.lead)):
        near = [get(shown, k).over(_order()) for k in (1, 2, 3)]
        chain = [near[0], F.when(near[0].isNotNull(), near[1]), F.when(near[0].isNotNull() & near[1].isNotNull(), near[2])]
        cols[name] = F.concat_ws("\n", *(reversed(chain) if name == "before" else chain))
    rows = lines.withColumn("is_low", marked).withColumns(cols).where(F.col("is_low") & (trim_all(F.col("text")) != ""))
    n = F.length("text")
    wild = n - F.length(F.translate("text", WILDCARDS, ""))
    return rows.select("doc", F.concat(F.lit("LC-"), F.row_number().over(_order()).cast("string")).alias("id"), "line_no", "text", "before", "after", (n + 1).alias("max_length"), F.greatest(F.lit(2), F.floor(n / 3).cast("int")).alias("max_edits"), wild.alias("wildcards"))


def short_line_clusters(lines: DataFrame) -> DataFrame:
    """Runs of three or more short, unterminated body lines without a break."""
    part = lines.withColumn("short", is_body(F.col("line")) & is_short(F.col("line")))
    runs = part.withColumn("run", F.col("line_no") - F.row_number().over(W.partitionBy("doc", "short").orderBy("line_no"))).where("short")
    got = runs.groupBy("doc", "run").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count("*").alias("line_count"), F.min_by(trim_all(F.col("line")), "line_no").alias("sample")).where(F.col("line_count") >= CLUSTER)
    return got.withColumn("id", F.concat(F.lit("P-"), F.row_number().over(W.partitionBy("doc").orderBy("start_line")).cast("string"))).drop("run")


def chapter_issues(lines: DataFrame) -> DataFrame:
    """Chapters without body before the next one, and headings that jump from level 1 to 3 or below."""
    counted = lines.withColumn("bodies", F.sum(is_body(F.col("line")).cast("int")).over(_order())).withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,6})[ \t]+\S", 1)))
    h = counted.where("level > 0")
    nxt = lambda c: F.lead(c).over(_order())
    h = h.withColumns({"next_level": nxt("level"), "next_bodies": nxt("bodies"), "next_no": nxt("line_no")})
    empty = h.where((F.col("level") == 1) & (F.col("next_level") == 1) & (F.col("next_bodies") == F.col("bodies"))).select("doc", F.lit("empty_chapter").alias("issue"), "line_no")
    jump = h.where((F.col("level") == 1) & (F.col("next_level") >= 3)).select("doc", F.lit("level_jump").alias("issue"), F.col("next_no").alias("line_no"))
    both = empty.unionByName(jump)
    return both.withColumn("id", F.concat(F.lit("CS-"), F.row_number().over(W.partitionBy("doc").orderBy("line_no", "issue")).cast("string")))


def toc_mismatches(entries: DataFrame, titles: DataFrame) -> DataFrame:
    """Entries whose best title of the same book shares less than half of its characters.

    ``entries`` are (book_id, pos, title), ``titles`` (book_id, place, name).
    The best of several equal ones is the first by place. An entry that is a
    title, and so has a good one, is left out by an equi-join; the others meet
    all titles of their book in blocks, so that a long book is many rows.
    """
    e = cut(entries.where("title is not null").select("book_id", "pos", "title").distinct())
    names = cut(titles.where("name is not null").groupBy("book_id", "name").agg(F.min("place").cast("bigint").alias("place")))
    same = names.where(char_overlap(F.col("name"), F.col("name")) >= LEAST_OVERLAP).select("book_id", F.col("name").alias("title"))
    wanted = _blocks(e.select("book_id", "title").distinct().join(same, ["book_id", "title"], "left_anti"), "title", ENTRY_BLOCK)
    known = _blocks(names, "name", NAME_BLOCK)
    wanted = wanted.groupBy("book_id", "block").agg(F.collect_list("title").alias("titles"))
    wanted = wanted.join(known.select("book_id", "blocks").distinct(), "book_id").select("book_id", "titles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    known = known.groupBy("book_id", "block").agg(F.collect_list(F.struct("name", "place")).alias("n")).select("book_id", "block", F.col("n.name").alias("names"), F.col("n.place").alias("places"))
    met = wanted.join(known, ["book_id", "block"]).select("book_id", "titles", "names", "places").mapInArrow(_best_names, "book_id string, title string, name string, place bigint, overlap double")
    best = met.groupBy("book_id", "title").agg(F.max_by(F.struct("name", "overlap"), F.struct("overlap", -F.col("place"))).alias("b")).where(F.col("b.overlap") < LEAST_OVERLAP)
    return e.join(best, ["book_id", "title"]).select("book_id", "pos", "title", F.col("b.name").alias("best_title"), F.col("b.overlap").alias("overlap"))


def _blocks(rows: DataFrame, text: str, size: int) -> DataFrame:
    """``block`` of about ``size`` rows of a book, and the book's number of ``blocks``."""
    counts = rows.groupBy("book_id").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    return rows.join(counts, "book_id").withColumn("block", F.pmod(F.xxhash64(text), F.col("blocks")).cast("int"))


def _best_names(batches):
    """For each title the name with the highest :func:`char_overlap`, the first by place of several; whole blocks as one product of matrices."""
    import numpy as np
    import pyarrow as pa

    kinds = {"book_id": pa.string(), "title": pa.string(), "name": pa.string(), "place": pa.int64(), "overlap": pa.float64()}
    chars = lambda x: set(x) or {""}

    def held(texts, index):
        out = np.zeros((len(texts), len(index)), dtype="float32")
        for k, t in enumerate(texts):
            out[k, [index[c] for c in chars(t) if c in index]] = 1
        return out

    for batch in batches:
        for book, titles, names, places in zip(*(batch.column(c).to_pylist() for c in ("book_id", "titles", "names", "places"))):
            order = np.argsort(np.array(places), kind="stable")
            index = {c: k for k, c in enumerate(dict.fromkeys(c for t in titles for c in chars(t)))}
            known, sizes = held([names[k] for k in order], index).T, np.array([len(names[k]) for k in order])
            got = []
            for start in range(0, len(titles), 128):
                part = titles[start : start + 128]
                overlap = (held(part, index) @ known).astype("float64") / np.maximum(np.maximum.outer([len(t) for t in part], sizes), 1)
                first = overlap.argmax(axis=1)
                got += [(book, t, names[order[k]], places[order[k]], float(o[k])) for t, k, o in zip(part, first, overlap)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*got), kinds.values())], names=list(kinds))


def image_refs(lines: DataFrame) -> DataFrame:
    """Lines that are an image and nothing else, with how often a document refers to the path."""
    pattern = r"^\s*!\[([^\]]*)\]\((images/[^)]+)\)\s*$"
    refs = lines.where(F.col("line").rlike(pattern)).select("doc", "line_no", F.regexp_extract("line", pattern, 1).alias("alt"), F.regexp_extract("line", pattern, 2).alias("path"))
    counts = refs.groupBy("doc", "path").agg(F.count("*").alias("refs"))
    return refs.join(counts, ["doc", "path"])


def decorated_titles(lines: DataFrame) -> DataFrame:
    """Image lines with a level-1 heading within three lines; the earliest such heading."""
    refs = image_refs(lines)
    near = refs.select("doc", "line_no", "path", F.explode(F.sequence(F.lit(-WINDOW), F.lit(WINDOW))).alias("step")).withColumn("at", F.col("line_no") + F.col("step"))
    h = headings(lines).where("level = 1").select("doc", F.col("line_no").alias("at"), "title")
    met = near.join(h, ["doc", "at"])
    return met.groupBy("doc", "line_no", "path").agg(F.min("at").alias("title_line"), F.min_by("title", "at").alias("title"))


def issue_totals(*families: tuple[str, DataFrame]) -> DataFrame:
    """(doc, kind, n) over families of issues."""
    out = None
    for kind, df in families:
        part = df.groupBy("doc").agg(F.count("*").alias("n")).select("doc", F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def batches(issues: DataFrame, kind: str, size: int = BATCH) -> DataFrame:
    """Issues in batches of ``size`` by line."""
    return issues.select("doc", F.lit(kind).alias("kind"), "id", F.floor((F.row_number().over(_order()) - 1) / size).alias("batch"))


def check_correction(original: Column, corrected: Column) -> Column:
    """``ok`` or the first rule a correction breaks: unclear, empty, too_long, lost_chars, too_many_edits."""
    need, have = preserved_counts(original), preserved_counts(corrected)
    kept = F.forall(F.map_entries(need), lambda e: F.coalesce(F.try_element_at(have, e["key"]), F.lit(0)) >= e["value"])
    n = F.length(original)
    return (
        F.when(corrected.contains("[UNCLEAR]"), "unclear").when(trim_all(corrected) == "", "empty").when(F.length(corrected) > n + 1, "too_long").when(~kept, "lost_chars")
        .when(F.levenshtein(original, corrected) > F.greatest(F.lit(2), F.floor(n / 3).cast("int")), "too_many_edits").otherwise("ok")
    )


def first_mismatches(mismatches: DataFrame, most: int = KEPT) -> DataFrame:
    """The first ``most`` mismatches of each book by place, each with the book's whole number of them."""
    book = W.partitionBy("book_id")
    return mismatches.withColumns({"rank": F.row_number().over(book.orderBy("pos", "title")), "total": F.count("*").over(book)}).where(F.col("rank") <= most)


def by_issue(corrections: DataFrame, issues: DataFrame) -> DataFrame:
    """Corrections (doc, id, new_line) with the line of their issue; those of unknown ids are dropped."""
    return corrections.join(issues.select("doc", "id", "line_no"), ["doc", "id"]).select("doc", "id", "line_no", "new_line")


def apply_fixes(lines: DataFrame, fixes: DataFrame) -> DataFrame:
    """Lines with fixes applied: (doc, line_no, new_line, priority); of several for a line the highest priority, null deletes it."""
    best = fixes.groupBy("doc", "line_no").agg(F.max_by(F.struct("new_line"), F.struct("priority", "new_line")).alias("fix"))
    out = lines.join(best, ["doc", "line_no"], "left")
    return out.where(F.col("fix").isNull() | F.col("fix.new_line").isNotNull()).select("doc", "line_no", F.when(F.col("fix").isNull(), F.col("line")).otherwise(F.col("fix.new_line")).alias("line"))


def remove_images(lines: DataFrame, paths: DataFrame) -> DataFrame:
    """Lines without the images of ``paths`` (doc, path) and without one blank line after each."""
    gone = image_refs(lines).join(paths.select("doc", "path").distinct(), ["doc", "path"], "left_semi").select("doc", "line_no").withColumn("gone", F.lit(True))
    marked = lines.join(gone, ["doc", "line_no"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    after = F.coalesce(F.lag("gone").over(_order()), F.lit(False)) & (trim_all(F.col("line")) == "")
    return marked.withColumn("blank", after).where(~F.col("gone") & ~F.col("blank")).select("doc", "line_no", "line")


def lenient_json(text: str | None) -> str | None:
    """The JSON in an answer: without a fence, the whole, else the first object or array, closed where it was cut off; null if none."""
    import json

    if not text:
        return None
    body = text.strip()
    if body.startswith("```"):
        body = body.split("\n", 1)[-1].rsplit("```", 1)[0]
    try:
        json.loads(body)
        return body
    except ValueError:
        pass
    for opening in "{[":
        at = body.find(opening)
        if at >= 0 and (fixed := close_json(body[at:])) is not None:
            return fixed
    return None


def close_json(text: str) -> str | None:
    """A JSON prefix cut back to its last complete value and closed; null if that gives no JSON."""
    import json

    stack: list[str] = []
    quoted = escaped = False
    safe: tuple[int, str] | None = None
    for i, c in enumerate(text):
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
            continue
        if c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None
            safe = (i + 1, "".join(reversed(stack)))
            if not stack:
                break
    if safe is None:
        return None
    out = text[: safe[0]].rstrip().rstrip(",") + safe[1]
    try:
        json.loads(out)
    except ValueError:
        return None
    return out


def recover_json(column: Column) -> Column:
    """:func:`lenient_json` as a column; valid JSON does not leave the JVM's answer."""
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([lenient_json(t) for t in texts], index=texts.index, dtype=object)

    return pandas_udf(run, StringType())(column)



def page_of_lines(lines: DataFrame) -> DataFrame:
    """``page_index`` of each line: that of the last page comment at or before it, null before the first."""
    marker = F.nullif(F.regexp_extract("line", r"^<!-- page: (\d+) -->\s*$", 1), F.lit("")).cast("int")
    return lines.withColumn("page_index", F.last(marker, ignorenulls=True).over(_order().rowsBetween(W.unboundedPreceding, W.currentRow)))


def chapter_contexts(lines: DataFrame, limit: int = 200) -> DataFrame:
    """(doc, line_no, context) of level-1 headings: the lines after it, without blanks and images, up to ``limit`` characters, the next chapter or div."""
    stops = F.col("line").rlike(r"^\s*(?:# |:::)")
    order = _order()
    marked = lines.withColumn("is_h1", F.col("line").rlike(r"^# \S")).withColumn("island", F.sum(stops.cast("int")).over(order))
    heads = marked.where("is_h1").select("doc", "line_no", "island")
    body = marked.where((trim_all(F.col("line")) != "") & ~F.col("line").rlike(r"^\s*!\[") & ~stops).select("doc", "island", F.col("line_no").alias("n"), trim_all(F.col("line")).alias("t"))
    # lines that begin after the limit was reached add nothing that the cut would keep
    run = W.partitionBy("doc", "island").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    body = body.withColumn("before", F.coalesce(F.sum(F.length("t")).over(run), F.lit(0))).where(F.col("before") < limit)
    rows = F.transform(F.sort_array(F.collect_list(F.struct("n", "t"))), lambda x: x["t"])
    return heads.join(body, ["doc", "island"], "left").groupBy("doc", "line_no").agg(F.left(F.concat_ws("\n", rows), F.lit(limit)).alias("context"))


def toc_sections(lines: DataFrame) -> DataFrame:
    """(doc, line_no, entry) of lines inside a contents section: opened by a level-3 contents heading, closed by a chapter; entries without leaders and page."""
    opens, closes = F.col("line").rlike(r"^### .*(?:CONTENTS|目录)"), F.col("line").rlike(r"^# ") | F.col("line").startswith("::: {.chapter}")
    state = F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(_order().rowsBetween(W.unboundedPreceding, W.currentRow))
    entry = trim_all(F.regexp_replace("line", r"(?:[…\.·]{2,}|[/／])\s*\d.*$", ""))
    return lines.withColumn("inside", F.coalesce(state, F.lit(False))).where(F.col("inside") & ~opens & is_body(F.col("line"))).select("doc", "line_no", entry.alias("entry"))


def line_flags(lines: DataFrame, *families: tuple[str, DataFrame]) -> DataFrame:
    """Lines with the kinds of issue at them as an array."""
    out = None
    for kind, df in families:
        part = df.select("doc", F.col("start_line" if "start_line" in df.columns else "line_no").alias("line_no"), F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    kinds = out.groupBy("doc", "line_no").agg(F.sort_array(F.collect_set("kind")).alias("issues"))
    return lines.join(kinds, ["doc", "line_no"], "left").select("doc", "line_no", "line", F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))


def review_images(low: DataFrame, titles: DataFrame, most: int) -> DataFrame:
    """(doc, page_index): pages to show, those of weak lines first, then those of titles with an issue; each page once, at most ``most`` for a document."""
    both = low.select("doc", "page_index", F.lit(0).alias("rank"), "line_no").unionByName(titles.where("issue <> 'normal'").select("doc", "page_index", F.lit(1).alias("rank"), "line_no"))
    once = both.where("page_index is not null").groupBy("doc", "page_index").agg(F.min(F.struct("rank", "line_no")).alias("at"))
    return once.withColumn("n", F.row_number().over(W.partitionBy("doc").orderBy("at", "page_index"))).where(F.col("n") <= most).select("doc", "page_index", "n")


def review_batches(low: DataFrame, titles: DataFrame, decorations: DataFrame | None = None) -> DataFrame:
    """(doc, kind, batch, ids): weak lines and titles in fives, decorations in one, and one batch of structure for each document with any issue."""
    parts = [batches(low, "low_confidence"), batches(titles, "titles")]
    if decorations is not None:
        parts.append(decorations.select("doc", F.lit("decorations").alias("kind"), "id", F.lit(0).cast("bigint").alias("batch")))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    ids = all_.groupBy("doc", "kind", "batch").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return ids.unionByName(all_.select("doc").distinct().select("doc", F.lit("structure").alias("kind"), F.lit(0).cast("bigint").alias("batch"), F.array().cast("array<string>").alias("ids")))


LISTS = ("low_confidence_fixes", "title_fixes", "paragraph_fixes", "chapter_fixes", "toc_fixes", "decoration_fixes")


def merge_corrections(answers: DataFrame) -> DataFrame:
    """(doc, key, value) from (doc, batch, key, value): lists are joined in order of batch, of other keys the last value that is not empty stays."""
    rows = answers.where("value is not null")
    lists = rows.where(F.col("key").isin(*LISTS))
    joined = lists.groupBy("doc", "key").agg(F.to_json(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("batch", F.from_json("value", "array<string>").alias("v")))), lambda x: F.coalesce(x["v"], F.array().cast("array<string>"))))).alias("value"))
    last = rows.where(~F.col("key").isin(*LISTS) & ~F.col("value").isin("", "{}", "null")).groupBy("doc", "key").agg(F.max_by("value", "batch").alias("value"))
    return joined.unionByName(last)


def metadata_fixes(books: DataFrame, fixes: DataFrame) -> DataFrame:
    """Books with the six metadata fields replaced where a fix is a text that is not blank."""
    names = [c for c in ("title", "author", "lang", "date", "publisher", "rights") if c in books.columns and c in fixes.columns]
    f = fixes.select("book_id", *[F.col(c).alias(f"fix_{c}") for c in names])
    out = books.join(f, "book_id", "left")
    return out.withColumns({c: F.coalesce(F.nullif(trim_all(F.col(f"fix_{c}")), F.lit("")), F.col(c)) for c in names}).drop(*[f"fix_{c}" for c in names])


def ask(items: list, call, depth: int = 3) -> list[dict]:
    """Answers for a list of items: ``call`` gives (text, finished). An answer cut off for length is asked again in halves, ``depth`` times at most; the last is read as far as it goes."""
    import json

    text, finished = call(items)
    if not finished and depth > 0 and len(items) > 1:
        middle = len(items) // 2
        return ask(items[:middle], call, depth - 1) + ask(items[middle:], call, depth - 1)
    fixed = lenient_json(text)
    value = json.loads(fixed) if fixed else None
    return [value] if isinstance(value, dict) else []


def wants_second_review(books: DataFrame, enabled: bool, done: bool, text: str = "book_md") -> DataFrame:
    """Books whose text still has review marks, if a review is enabled and was not run yet."""
    marked = F.col(text).contains(LOW.strip()) | F.col(text).contains("[需校对]") | F.col(text).contains("[UNCLEAR]")
    return books.where(marked) if enabled and not done else books.limit(0)
