"""Problem 2: visually identical text with different characters.

Method: each character offers spellings in one or more scripts (Cyrillic ``е``
can be spelt Latin ``e``). A token's resolved script set is the intersection of
its characters' offers. A token whose own scripts disagree is a mixed-script
confusable, one whose every character has an offer in another script a
whole-script confusable; both are respelt in one script of the intersection,
chosen by the text's unambiguous characters, so the choice depends only on
what a reader sees. The remaining forms are then normalised: width of letters
and digits, kinds of space and hyphen, invisible characters, composed accents,
ligatures, radicals and compatibility ideographs.

What a reader can tell apart stays apart: case, accents, raised or circled
digits, punctuation of another width.

Defined results: null stays null, the empty text stays empty, texts of any
length are treated whole, and the function is idempotent.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: For each script, characters and the Latin letters (or, last row, ideographs) they look like.
LOOKALIKES = (
    ("CYRILLIC", "асԁеһіјӏорԛѕѵԝхуАВСЕНІЈКМОРԚЅТԜХУ", "acdehijlopqsvwxyABCEHIJKMOPQSTWXY"),
    ("GREEK", "ονρΑΒΕΖΗΙΚΜΝΟΡΤΥΧϳ", "ovpABEZHIKMNOPTYXj"),
    ("ARMENIAN", "հոօսՕՍ", "hnouOU"),
    ("CHEROKEE", "ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᏔᏃ", "ABCEHJKLMPRSTVWZ"),
    ("KATAKANA", "エカタトニハロ", "工力夕卜二八口"),
)
#: Radicals that Unicode does not decompose, and the ideographs they look like.
RADICALS = dict(zip("⺟⺠⻁⻄⻅⻆⻉⻋⻑⻒⻓⻔⻘⻚⻛⻜⻝⻢⻣⻤⻥⻦⻧⻨⻩⻬⻮⻰⻳", "母民虎西见角贝车長镸长门青页风飞食马骨鬼鱼鸟卤麦黄齐齿龙龟"))
#: Hyphens that look alike, and letters of one script that do.
HYPHENS = "‐‑˗﹣－"
SAME_SCRIPT = {"ɡ": "g", "ı": "i", "ſ": "s"}
#: Invisible characters that are not of category Cf.
INVISIBLE = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10))

#: Texts of these characters alone are already in the consistent form.
PLAIN = re.compile(r"[ -~\n¡-¦¨-¬®-¶»-ÿŒœŸ„“”‘’‹›–—…•·、。〈-】〔-〟！（），：；？～一-鿿]*")
TOKEN = re.compile(r"[^\W\d_][^\W_]*(?:[̀-ͯ]+[^\W_]*)*")


@lru_cache(maxsize=1)
def form_table() -> dict[int, str]:
    """Characters and their consistent form, by rule from the Unicode database."""
    table: dict[int, str] = {}
    for cp in (*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE01F0)):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Zs":
            table[cp] = " "
        elif kind == "Cf" or 0xE0100 <= cp:
            table[cp] = ""
        elif (tag := unicodedata.decomposition(c).partition(" ")[0]).startswith("<"):
            plain = unicodedata.normalize("NFKC", c)
            if tag in ("<wide>", "<narrow>", "<font>") and plain.isalnum():
                table[cp] = plain
            elif tag == "<compat>" and ("LIGATURE" in unicodedata.name(c, "") or 0x2E80 <= cp <= 0x2FDF):
                table[cp] = plain
    table |= {cp: "" for cp in INVISIBLE} | {ord(c): "-" for c in HYPHENS} | {ord(k): v for k, v in (RADICALS | SAME_SCRIPT).items()}
    table[ord("\t")] = " "
    return table


@lru_cache(maxsize=1)
def offers() -> tuple[dict[str, dict[str, str]], frozenset[str]]:
    """Character -> {script: spelling} where there is more than one, and the foreign look-alikes."""
    table: dict[str, dict[str, str]] = {}
    for script, chars, like in LOOKALIKES:
        for c, plain in zip(chars, like):
            own = script_of(plain)
            group = table.setdefault(plain, {own: plain})
            group.setdefault(script, c)
    for plain, group in list(table.items()):
        for spelling in list(group.values()):
            table[spelling] = group
    return table, frozenset(c for row in LOOKALIKES for c in row[1])


@lru_cache(maxsize=65536)
def script_of(c: str) -> str:
    """A character's script, from its Unicode name; empty for marks, digits and signs."""
    if "一" <= c <= "鿿" or "㐀" <= c <= "䶿":
        return "HAN"
    name = unicodedata.name(c, "")
    first = name.split(" ", 1)[0]
    return "HAN" if first == "CJK" else first if unicodedata.category(c)[0] == "L" else ""


@lru_cache(maxsize=1)
def _foreign() -> re.Pattern[str]:
    return re.compile("[" + "".join(sorted(offers()[1])) + "]")


def scripts(token: str) -> set[str] | None:
    """The resolved script set of a token: scripts in which all of it can be spelt; None without letters."""
    table, _ = offers()
    common: set[str] | None = None
    for c in token:
        own = set(table[c]) if c in table else {s} if (s := script_of(c)) else None
        if own is not None:
            common = own if common is None else common & own
    return common


def _respell(text: str) -> str:
    table, foreign = offers()
    weight: dict[str, int] = {}
    for c in text:
        if c not in table and (s := script_of(c)):
            weight[s] = weight.get(s, 0) + 1

    def one(m: re.Match[str]) -> str:
        token = m.group(0)
        if not any(c in foreign for c in token):
            return token
        common = scripts(token)
        if not common:  # letters that no one script spells: each look-alike follows the token's own unambiguous letters
            local: dict[str, int] = {}
            for c in token:
                if c not in table and (s := script_of(c)):
                    local[s] = local.get(s, 0) + 1
            order = sorted(local, key=lambda s: (-local[s], s))
            return "".join(next((table[c][s] for s in order if s in table[c]), c) if c in table else c for c in token)
        best = max(common, key=lambda s: (weight.get(s, 0), s == "LATIN", s == "HAN", s))
        return "".join(table[c][best] if c in table else c for c in token)

    return TOKEN.sub(one, text)


def consistent(text: str | None) -> str | None:
    """The consistent form of a text."""
    if text is None or PLAIN.fullmatch(text):
        return text
    text = text.replace("\r\n", "\n").translate(form_table())
    if _foreign().search(unicodedata.normalize("NFD", text)):
        text = _respell(unicodedata.normalize("NFD", text))
    return unicodedata.normalize("NFC", text)


def changed_only(texts: Iterable[str | None]) -> list[str | None]:
    out: list[str | None] = []
    for t in texts:
        new = consistent(t)
        out.append(None if new is t or new == t else new)
    return out


@pandas_udf(StringType())
def _changed(texts: pd.Series) -> pd.Series:
    return pd.Series(changed_only(texts.tolist()), index=texts.index, dtype=object)


def canonical(column: Column) -> Column:
    """The consistent form as a column. Python returns only texts that change."""
    return F.coalesce(_changed(column), column)


def normalise(df: DataFrame, text_col: str, out_col: str = "consistent_text") -> DataFrame:
    """``df`` with the consistent form and whether it differs; a column named ``out_col`` is replaced."""
    return df.withColumn(out_col, canonical(df[text_col])).withColumn(f"{out_col}_changed", ~F.col(out_col).eqNullSafe(df[text_col]))


def same_looking(titles: DataFrame, elements: DataFrame) -> DataFrame:
    """(entry_id, elem_id): entries and elements of one book that differ as strings and look the same.

    The join key is the book and the whole consistent form. Only texts no
    longer than the longest title are shuffled: longer ones cannot be equal.
    Rows without book or text match nothing; equal rows give one result.
    """
    t = titles.select("entry_id", "book_id", F.col("title").alias("raw_title"), canonical(F.col("title")).alias("form")).where("form is not null and book_id is not null")
    longest = t.agg(F.max(F.length("form")).alias("longest")).first()["longest"] or 0
    e = elements.select(F.col("elem_id"), F.col("book_id").alias("b"), F.col("text").alias("raw_text"), canonical(F.col("text")).alias("f")).where(F.length("f") <= int(longest))
    joined = t.join(e, (t.book_id == e.b) & (t.form == e.f)).where("raw_title <> raw_text")
    return joined.select("entry_id", "elem_id").distinct()
