"""The page cache: the newest row of a key, what is still to do, and configuration keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("pdf_hash", "page_index", "dpi", "cfg_hash")


def newest(log: DataFrame, key: tuple[str, ...] = KEY, time: str = "created_at", tie: str = "cache_id") -> DataFrame:
    """The last written row of each key of an append log.

    ``max_by`` keeps one row for each key on the map side, so a key with many
    rows is reduced before the shuffle.
    """
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("row")).select(*key, "row.*")


def upsert(store: DataFrame, rows: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The store with rows of equal key replaced."""
    return store.join(rows.select(*key).distinct(), list(key), "left_anti").unionByName(rows)


def done_pages(store: DataFrame) -> DataFrame:
    return store.select("pdf_hash", "page_index").distinct()


def pages_to_do(books: DataFrame, store: DataFrame) -> DataFrame:
    """(book_id, pdf_hash, page_index) of pages without a row in the store."""
    b = books.dropDuplicates(["book_id"]).where("pdf_hash is not null and total_pages > 0")
    want = b.select("book_id", "pdf_hash", F.explode(F.sequence(F.lit(0), F.col("total_pages") - 1)).alias("page_index"))
    return want.join(done_pages(store), ["pdf_hash", "page_index"], "left_anti").select("book_id", "pdf_hash", "page_index")


def config_key(*columns: str) -> Column:
    """SHA-1 of the columns as JSON with sorted names."""
    return F.sha1(F.to_json(F.struct(*sorted(columns))))
