"""Order-dependent values over keys of any size.

A window over a whole book would bring the book into one task. Here rows are
ordered inside blocks of pages; only one row for each block is ordered by key,
and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Pages in a block.
BLOCK = 64


def _blocked(df: DataFrame, page: str) -> DataFrame:
    return df.withColumn("_block", F.floor(F.coalesce(page, F.lit(-1)) / BLOCK))


def _back(df: DataFrame, small: DataFrame, key: str) -> DataFrame:
    s = small.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), *[c for c in small.columns if c not in (key, "_block")])
    return df.join(s, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")), "left").drop("_k", "_b")


def running_sum(df: DataFrame, value: Column, out: str, key: str = "book_id", page: str = "page_index", order: tuple[str, ...] = ("page_index", "list_pos", "elem_id")) -> DataFrame:
    """``out``: the sum of ``value`` over the key's rows up to and with each row in order."""
    rows = _blocked(df.withColumn("_v", value.cast("bigint")), page)
    inside = F.sum("_v").over(W.partitionBy(key, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    totals = rows.groupBy(key, "_block").agg(F.sum("_v").alias("_t"))
    above = totals.withColumn("_above", F.sum("_t").over(W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))).select(key, "_block", "_above")
    return _back(rows.withColumn("_in", inside), above, key).withColumn(out, F.col("_in") + F.coalesce("_above", F.lit(0).cast("bigint"))).drop("_v", "_in", "_above", "_block")


def previous(df: DataFrame, columns: tuple[str, ...], prefix: str, key: str = "book_id", page: str = "page_index", order: tuple[str, ...] = ("page_index", "list_pos", "elem_id")) -> DataFrame:
    """``prefix`` + column: the values of the key's row before each row in order, null for the first."""
    rows = _blocked(df, page)
    value = F.struct(*columns)
    before = F.lag(value).over(W.partitionBy(key, "_block").orderBy(*order))
    last = rows.groupBy(key, "_block").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    above = last.withColumn("_above", F.lag("_last").over(W.partitionBy(key).orderBy("_block"))).select(key, "_block", "_above")
    joined = _back(rows.withColumn("_before", before), above, key).withColumn("_p", F.coalesce("_before", "_above"))
    return joined.withColumns({f"{prefix}{c}": F.col(f"_p.{c}") for c in columns}).drop("_before", "_above", "_p", "_block")
