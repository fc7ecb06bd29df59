"""Image analytics: perceptual hashes, separator bars, code-like images, repeated decorations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes and thresholds of the three tests, and words near functional images.
HASH_INPUT, HASH_SIZE, HASH_DISTANCE, REPEATS = 32, 8, 5, 3
KEYWORDS = ("扫码", "扫描", "二维码", "条形码", "ISBN", "QR", "barcode", "Barcode")
FEATURE_SCHEMA = "path string, width int, height int, phash string, is_separator boolean, is_code boolean"


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """A grey picture from the image source's bytes (blue, green, red order)."""
    a = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(float)
    if channels == 1:
        return a[:, :, 0]
    return np.rint(0.114 * a[:, :, 0] + 0.587 * a[:, :, 1] + 0.299 * a[:, :, 2])


def _weights(size: int, target: int, lobes: int = 3) -> np.ndarray:
    """The matrix of a windowed-sinc resize along one axis."""
    scale = size / target
    reach = max(1.0, scale)
    at = (np.arange(target) + 0.5) * scale
    x = (np.arange(size)[None, :] + 0.5 - at[:, None]) / reach
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(1, keepdims=True)


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    return np.clip(np.rint(_weights(a.shape[0], height) @ a @ _weights(a.shape[1], width).T), 0, 255)


def dct_matrix(n: int) -> np.ndarray:
    """The orthonormal type-II cosine transform."""
    k = np.arange(n)
    m = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def phash(a: np.ndarray) -> str:
    """64 bits: low cosine terms above the median of all but the first."""
    m = dct_matrix(HASH_INPUT)
    low = (m @ resize(a, HASH_INPUT, HASH_INPUT) @ m.T)[:HASH_SIZE, :HASH_SIZE].ravel()
    return "".join("1" if v > np.median(low[1:]) else "0" for v in low)


def is_separator(a: np.ndarray) -> bool:
    """A flat, wide bar of nearly black or white."""
    h, w = a.shape
    return 0 < h < 10 and w >= 50 and w / h >= 5 and float(((a < 30) | (a > 225)).mean()) > 0.95


def is_code(a: np.ndarray) -> bool:
    """Balanced black and white with dark squares in at least two of three corners."""
    h, w = a.shape
    if w < 50 or h < 50 or not 0.30 <= float((resize(a, 100, 100) < 128).mean()) <= 0.70:
        return False
    corners = (a[: max(1, h // 4), : max(1, w // 4)], a[: max(1, h // 4), 3 * w // 4 :], a[3 * h // 4 :, : max(1, w // 4)])
    return sum(float((resize(c, 7, 7) < 128).mean()) > 0.40 for c in corners if c.size) >= 2


def features(images: DataFrame) -> DataFrame:
    """Rows of :data:`FEATURE_SCHEMA` for decoded images; each path once."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            out = []
            for path, h, w, n, data in zip(f["origin"], f["height"], f["width"], f["nChannels"], f["data"]):
                a = grey(data, h, w, n)
                out.append((path, w, h, phash(a), is_separator(a), is_code(a)))
            yield pd.DataFrame(out, columns=["path", "width", "height", "phash", "is_separator", "is_code"])

    return images.select("origin", "height", "width", "nChannels", "data").dropDuplicates(["origin"]).mapInPandas(run, FEATURE_SCHEMA)


def crop(images: DataFrame) -> DataFrame:
    """(path, crop_width, crop_height, data): images cut to their ``bbox``, rounded and clamped; empty cuts are left out."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            out = []
            for path, h, w, n, data, box in zip(f["origin"], f["height"], f["width"], f["nChannels"], f["data"], f["bbox"]):
                x1, y1, x2, y2 = (round(box[k]) for k in ("x1", "y1", "x2", "y2"))
                a = np.frombuffer(data, np.uint8).reshape(h, w, n)[max(0, y1) : min(h, y2), max(0, x1) : min(w, x2)]
                if a.size:
                    out.append((path, a.shape[1], a.shape[0], a.tobytes()))
            yield pd.DataFrame(out, columns=["path", "crop_width", "crop_height", "data"])

    return images.mapInPandas(run, "path string, crop_width int, crop_height int, data binary")


def repeated(hashes: DataFrame, distance: int = HASH_DISTANCE, least: int = REPEATS) -> DataFrame:
    """(book_id, path) of images whose hash cluster is referred to at least ``least`` times.

    ``hashes`` are (book_id, first, path, phash, refs). A hash joins the first
    cluster within ``distance``, in order of first reference; equal hashes are
    merged before, so the ordered pass sees each hash of a book once.
    """
    one = hashes.groupBy("book_id", "phash").agg(F.min("first").alias("first"), F.sum("refs").alias("refs"))

    def cluster(frame):
        import pandas as pd

        frame = frame.sort_values(["first", "phash"], kind="stable")
        heads: list[str] = []
        totals: list[int] = []
        member = []
        for h, refs in zip(frame["phash"], frame["refs"]):
            k = next((i for i, x in enumerate(heads) if len(x) == len(h) and sum(a != b for a, b in zip(x, h)) <= distance), None)
            if k is None:
                heads.append(h)
                totals.append(0)
                k = len(heads) - 1
            totals[k] += refs
            member.append(k)
        keep = [totals[k] >= least for k in member]
        return pd.DataFrame({"book_id": frame["book_id"], "phash": frame["phash"]})[keep]

    found = one.groupBy("book_id").applyInPandas(cluster, "book_id string, phash string")
    return hashes.join(found, ["book_id", "phash"], "left_semi").select("book_id", "path").distinct()


def decorations(repeated_paths: DataFrame, separators: DataFrame, functional: DataFrame) -> DataFrame:
    """(doc, path) of images that only decorate: repeated ones and separator bars, but none that is functional at any place.

    All three are (doc, path); the result goes to ``review.remove_images``.
    """
    return repeated_paths.select("doc", "path").union(separators.select("doc", "path")).distinct().join(functional.select("doc", "path"), ["doc", "path"], "left_anti")


def near_keyword(lines: DataFrame) -> DataFrame:
    """Image lines with a functional word within two lines, the line itself left out: (doc, line_no)."""
    from pyspark.sql import Window as W

    hit = F.col("line").rlike("|".join(KEYWORDS)).cast("int")
    around = F.sum(hit).over(W.partitionBy("doc").orderBy("line_no").rowsBetween(-2, 2)) - hit
    return lines.withColumn("near", around).where(F.col("line").rlike(r"^\s*!\[[^\]]*\]\(images/[^)]+\)\s*$") & (F.col("near") > 0)).select("doc", "line_no")
