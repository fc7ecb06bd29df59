from pyspark.sql import functions as F
import numpy as np

from quire.operators import images


def test_hash_is_stable_under_scaling():
    rng = np.random.default_rng(1)
    a = np.kron(rng.integers(0, 255, (8, 8)), np.ones((16, 16)))
    b = images.resize(a, 64, 96)
    diff = sum(x != y for x, y in zip(images.phash(a), images.phash(b)))
    other = images.phash(np.kron(rng.integers(0, 255, (8, 8)), np.ones((16, 16))))
    assert len(images.phash(a)) == 64 and diff <= 5 < sum(x != y for x, y in zip(images.phash(a), other))


def test_dct_is_orthonormal():
    m = images.dct_matrix(32)
    assert np.allclose(m @ m.T, np.eye(32))


def test_bars_and_codes():
    assert images.is_separator(np.zeros((5, 200))) and not images.is_separator(np.zeros((20, 200))) and not images.is_separator(np.full((5, 200), 128.0))
    code = np.full((100, 100), 255.0)
    code[:30, :30] = code[:30, 70:] = code[70:, :30] = 0
    code[40:60, 40:80] = 0
    assert images.is_code(code) and not images.is_code(np.full((100, 100), 255.0)) and not images.is_code(np.zeros((10, 10)))


def test_features_of_rows(spark):
    data = bytearray(np.zeros((5, 60, 3), np.uint8).tobytes())
    df = spark.createDataFrame([("p", 5, 60, 3, data), ("p", 5, 60, 3, data)], "origin string, height int, width int, nChannels int, data binary")
    rows = images.features(df).collect()
    assert len(rows) == 1 and rows[0].is_separator
    cut = images.crop(spark.createDataFrame([("p", 5, 60, 3, data, (1.4, 0.0, 11.0, 99.0)), ("q", 5, 60, 3, data, (5.0, 5.0, 5.0, 5.0))], "origin string, height int, width int, nChannels int, data binary, bbox struct<x1:double,y1:double,x2:double,y2:double>")).collect()
    assert [(r.path, r.crop_width, r.crop_height) for r in cut] == [("p", 10, 5)]


def test_repeated_clusters_in_order(spark):
    rows = [("b", 1, "p1", "0" * 64, 1), ("b", 2, "p2", "1" * 3 + "0" * 61, 1), ("b", 3, "p3", "1" * 6 + "0" * 58, 1), ("b", 4, "p4", "1" * 64, 3), ("c", 1, "p1", "0" * 64, 2)]
    df = spark.createDataFrame(rows, "book_id string, first int, path string, phash string, refs bigint")
    assert sorted((r.book_id, r.path) for r in images.repeated(df).collect()) == [("b", "p4")]


def test_decorations_spare_functional_images(spark):
    from quire.operators import images, review

    md = ["![](images/a.png)", "", "x", "![](images/a.png)", "y", "![](images/a.png)", "扫码关注", "![](images/q.png)", "![](images/q.png)", "![](images/q.png)", "", "z", "z", "![](images/bar.png)", "", "end"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(md)], "doc bigint, line_no int, line string")
    refs = review.image_refs(lines)
    functional = refs.join(images.near_keyword(lines), ["doc", "line_no"], "left_semi")
    hashes = refs.groupBy(F.col("doc").cast("string").alias("book_id"), "path").agg(F.min("line_no").alias("first"), F.count("*").alias("refs")).withColumn("phash", F.when(F.col("path").contains("bar"), "1111111111").otherwise(F.concat(F.lit("00000000"), F.when(F.col("path").contains("q"), "11").otherwise("00"))))
    repeated = images.repeated(hashes).select(F.col("book_id").cast("bigint").alias("doc"), "path")
    bars = refs.where("path = 'images/bar.png'")
    got = {r.path for r in images.decorations(repeated, bars, functional).collect()}
    near = {r.path for r in functional.collect()}
    assert near == {"images/a.png", "images/q.png"} and got == {"images/bar.png"}
    assert {r.path for r in images.decorations(repeated, bars, functional.limit(0)).collect()} == {"images/a.png", "images/q.png", "images/bar.png"}
    assert images.decorations(repeated.limit(0), bars.limit(0), functional).count() == 0
    left = review.remove_images(lines, images.decorations(repeated, bars, functional))
    assert left.count() == len(md) - 2


def test_reports_and_ids(spark):
    from quire.operators import review

    m = spark.createDataFrame([("b", i, f"t{i}") for i in range(7)] + [("c", 1, "x")], "book_id string, pos int, title string")
    got = review.first_mismatches(m).collect()
    assert sorted((r.book_id, r.rank, r.total) for r in got) == [("b", k, 7) for k in range(1, 6)] + [("c", 1, 1)]
    issues = spark.createDataFrame([(1, "T-1", 4), (1, "T-2", 9)], "doc bigint, id string, line_no int")
    given = spark.createDataFrame([(1, "T-2", "new"), (1, "T-9", "lost"), (2, "T-1", "lost")], "doc bigint, id string, new_line string")
    assert [tuple(r) for r in review.by_issue(given, issues).collect()] == [(1, "T-2", 9, "new")]
