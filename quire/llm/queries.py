"""The pN_ queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import abuse, lookalike, markup, mixing, packing, scans, splitting


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _markup(spark: SparkSession, d: str, text_out: bool) -> DataFrame:
    parts = [markup.clean(_t(spark, d, src), key, "book_md", text_out=text_out).withColumn("src", F.lit(src)) for src, key in (("book_content", "content_id"), ("save_requests", "request_id"))]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _markup(spark, d, False).select("src", "row_id", F.explode("markup").alias("markup")).distinct()


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return _markup(spark, d, True)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking(_t(spark, d, "toc_entries"), _t(spark, d, "elements"))


def p2_elements(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normalise(_t(spark, d, "elements").select("elem_id", "book_id", "text"), "text")


def p2_titles(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normalise(_t(spark, d, "toc_entries").select("entry_id", "book_id", "title"), "title")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(_t(spark, d, "book_content").dropDuplicates(["content_id"]), splitting.limits_of(_t(spark, d, "size_limits")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cut = splitting.pieces(_t(spark, d, "book_content"), splitting.limits_of(_t(spark, d, "size_limits")))
    return cut.where("pieces > 1 and piece = 0").select(F.col("row_id").alias("content_id")).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.Noise(_t(spark, d, "elements"), _t(spark, d, "page_results")).found()


def p6_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.Noise(_t(spark, d, "elements"), _t(spark, d, "page_results")).paragraphs()


def _capacities(spark: SparkSession, d: str) -> list[int]:
    return [r["max_size"] for r in _t(spark, d, "size_limits").where("use_for = 'container'").select("max_size").collect()]


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(packing.place(_t(spark, d, "documents"), _capacities(spark, d)))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.place(_t(spark, d, "documents"), _capacities(spark, d)))


def _listed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sizes of the documents whose source is listed - no other can be selected - and the targets."""
    targets = _t(spark, d, "mix_targets")
    return mixing.sizes(_t(spark, d, "documents").join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")), targets


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(*_listed(spark, d))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_listed(spark, d))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    documents = _t(spark, d, "documents")
    return abuse.score_documents(documents, abuse.trained(abuse.rated_sample(documents, _t(spark, d, "labels"))))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scores(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_elements, p2_titles, p5_found, p5_pieces, p6_found, p6_paragraphs, p7_containers, p7_fill, p8_selection, p8_shares, p9_found, p9_scores, p9_rates)}
SQL: dict[str, str] = {
    "p5_found": "SELECT DISTINCT content_id FROM book_content b JOIN size_limits s ON s.use_for = 'piece' AND s.lang = b.lang WHERE length(book_md) > max_size",
}
