"""Problem 8: mixing sources to target weights.

Method: tokens are summed per source (partial sums before the shuffle), a
repetition rate is derived for each source, and each document is emitted
floor(rate) times plus once more with probability rate - floor(rate), decided
by a seeded hash of its id. No row is moved for the selection: the rates are a
literal map with one entry for each row of the target table.

Rates: a source gets share x total / its tokens, at most its ``max_repeats``.
What capped sources cannot give is spread over the others by share, until
nothing is left or all are capped. ``total`` defaults to the tokens of the
listed sources.

Defined results: rows without source, or of a source that is not listed, are
not selected; a listed source without documents is reported with rate 0; null
or empty texts have 0 tokens and are selected at their source's rate; negative
or null shares count as 0; rows with one id share one decision; an empty table
gives an empty selection and shares of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.tokens import FOLDER, VOCABULARY, token_count
from quire.runtime import cut, literal_table

SEED = 20_250_101


def repetition_rates(tokens: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, float]:
    """Rate of each listed source; see the module's text. Works on the target table's rows only."""
    share = {s: max(0.0, w or 0.0) for s, w, _ in targets}
    cap = {s: max(0, m or 0) for s, _, m in targets}
    have = {s: tokens.get(s, 0) for s in share}
    if total is None:
        total = float(sum(have.values()))
    rates = dict.fromkeys(share, 0.0)
    open_ = {s for s in share if have[s] > 0 and share[s] > 0 and cap[s] > 0}
    left = float(total)
    while open_ and left > 0:
        weight = sum(share[s] for s in open_)
        full = [s for s in sorted(open_) if share[s] / weight * left >= cap[s] * have[s]]
        if not full:
            for s in open_:
                rates[s] = share[s] / weight * left / have[s]
            break
        for s in full:
            rates[s] = float(cap[s])
            left -= cap[s] * have[s]
            open_.discard(s)
    return rates


def unit_hash(column: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the id and the seed, alike on every run and executor."""
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 52)) / F.lit(float(1 << 52))


def sizes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens), written once to the checkpoint folder as both passes need it."""
    return cut(documents.select(documents[id_col].alias("doc_id"), documents[source_col].alias("source"), token_count(documents[text_col], folder, vocabulary).alias("tokens")))


def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    return [tuple(r) for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).collect()]


def _rates(sized: DataFrame, rows: list[tuple[str, float, int]], total: float | None) -> tuple[dict[str, int], dict[str, float]]:
    """Tokens of the listed sources (at most as many rows as targets) and their rates."""
    found = sized.where(F.col("source").isin([r[0] for r in rows])).groupBy("source").agg(F.sum("tokens").alias("tokens")).collect() if rows else []
    tokens = {r["source"]: int(r["tokens"] or 0) for r in found}
    return tokens, repetition_rates(tokens, rows, total)


def mix(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, copy): the selected documents, one row for each copy, copies from 1."""
    rows = _targets(targets)
    _, rates = _rates(sized, rows, total)
    pairs = [F.lit(x) for s, r in sorted(rates.items()) if r > 0 for x in (s, r)]
    rate = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
    copies = (F.floor(rate) + (unit_hash(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("int")).cast("int")
    chosen = sized.withColumn("copies", copies).where("copies > 0")
    return chosen.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def shares(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> DataFrame:
    """Target and reached share of each listed source."""
    rows = _targets(targets)
    tokens, rates = _rates(sized, rows, total)
    plan = literal_table(sized.sparkSession, [(s, float(w or 0), int(m or 0), tokens.get(s, 0), float(rates[s])) for s, w, m in rows], "source string, target_share double, max_repeats int, source_tokens bigint, rate double")
    got = mix(sized, targets, total, seed).groupBy("source").agg(F.sum("tokens").alias("selected_tokens"), F.count("*").alias("selected_copies"))
    whole = got.agg(F.sum("selected_tokens").alias("whole"))
    out = plan.join(F.broadcast(got), "source", "left").join(F.broadcast(whole), F.lit(True), "left")  # both have at most as many rows as targets
    zero = F.lit(0).cast("bigint")
    return out.select("source", "target_share", "max_repeats", "source_tokens", "rate", F.coalesce("selected_tokens", zero).alias("selected_tokens"), F.coalesce("selected_copies", zero).alias("selected_copies"), F.coalesce(F.col("selected_tokens") / F.nullif(F.col("whole"), F.lit(0)), F.lit(0.0)).alias("reached_share"))
