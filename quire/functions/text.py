"""Text functions as column expressions; all stay inside the JVM unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Character classes, written so that Java and RE2 read them alike.
SPACE = r"\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CJK = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{3000}-\x{303f}\x{ff00}-\x{ffef}"
HAN = r"\x{4e00}-\x{9fff}"
#: Half-width marks and their full-width forms.
HALF, FULL = ",.!?:;", "，。！？：；"
#: Marks that end a paragraph, closing quotes, wildcards of OCR engines, signs of garbled titles.
TERMINATORS = "。！？；…\"')]!?”’）」』】"
WILDCARDS = "*?□○◇●〼"
GARBLED = "©®™□○◇●〼*?"
LINE_ENDS = ("。", "！", "？", ";", "；", ".")
SENTINEL = chr(0xE000)
CHAPTER = r"第[一二三四五六七八九十百千0-9]+[章回卷篇]"
CHAPTER_WITH_SECTION = r"第[一二三四五六七八九十百千0-9]+[章回节卷篇]"
SECTION = r"第[一二三四五六七八九十百千0-9]+节"
CHAPTER_LATIN = r"(?i)Chapter\s+[IVX0-9]+"


def trim_all(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def rtrim_all(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACE}]+$", "")


def has_cjk(c: Column) -> Column:
    """Any ideograph, CJK mark or full-width form."""
    return c.rlike(f"[{CJK}]")


def has_han(c: Column) -> Column:
    """Any ideograph of the basic block; narrower than :func:`has_cjk`."""
    return c.rlike(f"[{HAN}]")


def full_width_marks(c: Column) -> Column:
    """Half-width marks beside CJK characters made full-width, left to right.

    A full stop needs CJK before it, the others before or after. A converted
    mark is CJK for the next one, hence the run before a mark in the pattern. A
    private-use sign marks what converts before anything is replaced.
    """
    marked = F.regexp_replace(c, f"(?<=[{CJK}][{HALF}]{{0,64}})[{HALF}]|[,!?:;](?=[{CJK}])", SENTINEL + "$0")
    for half, full in zip(HALF, FULL):
        marked = F.replace(marked, F.lit(SENTINEL + half), F.lit(full))
    return marked


def squeeze_marks(c: Column) -> Column:
    """Runs of one CJK mark reduced to one."""
    return F.regexp_replace(c, r"([。！？，；：])\1+", "$1")


def pair_quotes(c: Column) -> Column:
    """ASCII quotes turned into opening and closing ones by turns, for each kind on its own."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("d"), F.lit(False).alias("s"))

    def step(acc: Column, ch: Column) -> Column:
        new = F.when(ch == '"', F.when(acc["d"], "”").otherwise("“")).when(ch == "'", F.when(acc["s"], "’").otherwise("‘")).otherwise(ch)
        return F.struct(F.concat(acc["text"], new).alias("text"), (acc["d"] != (ch == '"')).alias("d"), (acc["s"] != (ch == "'")).alias("s"))

    folded = F.aggregate(F.split(c, ""), start, step, lambda acc: acc["text"])
    return F.when(c.rlike("[\"']"), folded).otherwise(c)


def normalise_punctuation(c: Column) -> Column:
    """Full-width marks, no repeated marks, paired quotes; texts without CJK stay as they are."""
    return F.when(has_cjk(c), pair_quotes(squeeze_marks(full_width_marks(c)))).otherwise(c)


def ends_closed(c: Column) -> Column:
    """Whether a text ends in a terminator or closing quote; the empty text does."""
    last = F.right(rtrim_all(c), F.lit(1))
    return (last == "") | F.lit(TERMINATORS).contains(last)


def starts_block(c: Column) -> Column:
    """Whether a text opens a new block: empty, indented, a chapter line, or a cataloguing line."""
    return (
        (trim_all(c) == "") | c.rlike(f"^[{SPACE}]") | c.rlike("^" + CHAPTER_WITH_SECTION) | c.rlike("^" + CHAPTER_LATIN)
        | c.rlike(r"^图书在版编目\s*[（(]CIP[)）]\s*数据") | c.rlike(r"^.+?[/／].+?[．.·一。].+?[：:].+?[，,]\s*\d{4}")
    )


def join_seam(a: Column, b: Column) -> Column:
    """Two pieces joined: nothing between CJK characters, else one space."""
    x, y = trim_all(a), trim_all(b)
    both = F.right(x, F.lit(1)).rlike(f"[{CJK}]") & F.left(y, F.lit(1)).rlike(f"[{CJK}]")
    return F.when(x == "", y).when(y == "", x).when(both, F.concat(x, y)).otherwise(F.concat_ws(" ", x, y))


def toc_lines(c: Column) -> Column:
    """How many lines end in a slash and a page number."""
    return F.size(F.filter(F.split(trim_all(c), "\n"), lambda x: trim_all(x).rlike(r"[/／]\s*\d+\s*$")))


def last_is_toc_line(c: Column) -> Column:
    """Whether the last line that is not empty ends in a slash and a page number."""
    lines = F.filter(F.transform(F.split(trim_all(c), "\n"), trim_all), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(-1)).rlike(r"[/／]\s*\d+\s*$"), F.lit(False))


def numbering_depth(c: Column) -> Column:
    """Depth of a leading number such as 1.2.3, or null."""
    number = F.regexp_extract(trim_all(c), rf"^(\d+(?:\.\d+)*)[{SPACE}]+[^{SPACE}]", 1)
    return F.when(number != "", F.regexp_count(number, F.lit(r"\.")) + 1)


def clean_field(c: Column) -> Column:
    """Trimmed, and without spaces between ideographs."""
    return F.regexp_replace(trim_all(c), rf"(?<=[{HAN}])[{SPACE}]+(?=[{HAN}])", "")


def plain_date(c: Column) -> Column:
    """2019年6月 and 2019-6 as 2019.6."""
    return F.regexp_replace(F.replace(F.replace(F.replace(trim_all(c), F.lit("年"), F.lit(".")), F.lit("月"), F.lit("")), F.lit("-"), F.lit(".")), r"\.{2,}", ".")


@pandas_udf(DoubleType())
def ratcliff(a, b):
    """Ratcliff-Obershelp similarity of two texts; the order of the arguments matters. The one function here that runs in Python."""
    import difflib

    import pandas as pd

    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def lengths_close(a: Column, b: Column) -> Column:
    """Whether two lengths differ by at most 30 % of the longer; the cheap test before :func:`ratcliff`."""
    return F.abs(F.length(a) - F.length(b)) <= 0.3 * F.greatest(F.length(a), F.length(b))


def char_overlap(a: Column, b: Column) -> Column:
    """Shared different characters over the longer length."""
    shared = F.size(F.array_intersect(F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))))
    return shared / F.greatest(F.length(a), F.length(b), F.lit(1))


def meaningful_chars(c: Column) -> Column:
    """Length without white space and Markdown signs."""
    return F.length(F.regexp_replace(c, rf"[#>*\-\[\]!(){{}}=|`~{SPACE}]", ""))


def strip_review_marks(c: Column) -> Column:
    """Without low-confidence prefixes, trailing review marks and page comments; lines end in LF or CRLF (``$`` stands before either)."""
    c = F.regexp_replace(c, r"(?m)^>\[low-confidence\][ \t]*", "")
    c = F.regexp_replace(c, r"(?m)[ \t]*(?:\[UNCLEAR\]|\[需校对\])[ \t]*$", "")
    return F.regexp_replace(c, r"(?m)^<!-- page: \d+ -->[ \t]*(?:\r?\n)?", "")


def split_volumes(c: Column) -> Column:
    """A title that holds several volume titles, as an array of them; else an array of itself."""
    parts = F.filter(F.transform(F.split(c, r"(?=第[一二三四五六七八九十百零\d]+卷)"), trim_all), lambda x: x != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array(c))


def is_toc_noise(c: Column) -> Column:
    """Whether a fragment of a contents page is no entry."""
    return (
        F.when(F.coalesce(c, F.lit("")) == "", True).when(F.upper(c) == "CONTENTS", True).when(c.isin("目录", "目 录"), True).when(c.rlike(r"^\d+$"), True)
        .when(c.startswith("![") | c.startswith(":::"), True).when(c.rlike(r"[／/]"), False).when((F.length(c) > 30) & ~c.rlike(r"第[一二三四五六七八九十百零\d]+卷"), True).otherwise(False)
    )


def image_class(path: Column) -> Column:
    return F.when(path.contains("pages/") | path.startswith("pages"), "cover").otherwise("image")


def div_classes(line: Column) -> Column:
    """Classes of a fenced div's opening line; null for any other line."""
    inner = F.regexp_extract(line, r"^:::\s*\{([^}]+)\}", 1)
    return F.when(inner != "", F.transform(F.filter(F.split(inner, r"\s+"), lambda x: x.startswith(".")), lambda x: F.regexp_replace(x, r"^\.+", "")))


def preserved_counts(c: Column) -> Column:
    """How often each character occurs that is neither a wildcard nor white space, as a map."""
    chars = F.filter(F.split(c, ""), lambda x: (x != "") & ~F.lit(WILDCARDS).contains(x) & ~x.rlike(f"[{SPACE}]"))
    return F.map_from_entries(F.transform(F.array_distinct(chars), lambda x: F.struct(x.alias("key"), F.size(F.filter(chars, lambda y: y == x)).alias("value"))))


def hamming(a: Column, b: Column) -> Column:
    """Different places of two bit strings; 999 if their lengths differ."""
    return F.when(F.length(a) != F.length(b), 999).otherwise(F.size(F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda p: p["x"] != p["y"])))


def human_size(c: Column) -> Column:
    return F.when(c < 1024, F.format_string("%d B", c.cast("bigint"))).when(c < 1024**2, F.format_string("%.1f KB", c / 1024.0)).otherwise(F.format_string("%.1f MB", c / (1024.0 * 1024.0)))


def data_url(content: Column, path: Column) -> Column:
    """An image's bytes as a data URL; its MIME type by the path's extension, PNG if unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    mime = F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "webp", "image/webp").when(ext == "gif", "image/gif").when(ext == "bmp", "image/bmp").otherwise("image/png")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))
