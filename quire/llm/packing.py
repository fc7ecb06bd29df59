"""Problem 7: filling fixed-capacity containers with items.

Method: the linear grouping scheme. Documents are spread by a hash of their id
over shards of about ``SHARD`` documents; each shard packs its own:

1. an item larger than the capacity is cut into full containers and a rest;
2. large items are sorted and divided into groups of equal cardinality, each
   length is rounded up to its group's largest;
3. the few sizes are packed by configurations: a linear programme over patterns
   (column generation, priced by a knapsack over the capacity), counts rounded
   down, what is left is packed best-fit decreasing;
4. actual documents take the places of the rounded sizes;
5. small items go best-fit into the space that is left, then into new ones.

A shard wastes at most a few containers, whatever the size of the input, and
holds ids and sizes only, so no task grows with the data.

Defined results: null and empty texts have size 0 and share some container;
rows with one id are one document (its largest size counts); ties are broken
by id; an empty table gives no container; a capacity below 1 is an error.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tokens import FOLDER, VOCABULARY, token_count

#: Documents in a shard, groups of large sizes, and the share of the capacity from which an item is large.
SHARD = 20_000
GROUPS = 24
LARGE = 1 / 8
#: Most tasks that pack, for each core of the cluster.
TASKS = 16

PLACED_SCHEMA = "capacity bigint, container string, doc_id bigint, piece int, start_token bigint, tokens bigint"


def best_pattern(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Unbounded knapsack: the pattern of largest value within the capacity."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, dtype=np.int64)
    useful = [i for i in range(len(lengths)) if values[i] > 1e-12 and 0 < lengths[i] <= capacity]
    for i in useful:
        n, v = int(lengths[i]), values[i]
        # a large item fits at most a few times: as many vectorised passes do
        for _ in range(capacity // n):
            new = best[:-n] + v
            better = new > best[n:] + 1e-12
            if not better.any():
                break
            best[n:][better] = new[better]
            choice[n:][better] = i
    pattern = np.zeros(len(lengths), dtype=np.int64)
    c = capacity
    # follow the choices; positions that inherit a smaller capacity's value have none of their own
    while c > 0:
        if choice[c] < 0:
            break
        pattern[choice[c]] += 1
        c -= int(lengths[choice[c]])
    return pattern, float(pattern @ values)


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 300) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, by column generation; the counts are rounded down."""
    m = len(lengths)
    patterns = [np.where(np.arange(m) == i, capacity // int(lengths[i]), 0) for i in range(m)]
    basis = np.array(patterns, dtype=float).T
    x = counts / np.diag(basis)
    for _ in range(rounds):
        try:
            dual = np.linalg.solve(basis.T, np.ones(m))
        except np.linalg.LinAlgError:
            break
        pattern, value = best_pattern(lengths, dual, capacity)
        if value <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        x = np.maximum(x - ratio[leave] * direction, 0)
        x[leave] = ratio[leave]
        basis[:, leave] = pattern
        patterns[leave] = pattern
    return [(p, int(np.floor(n + 1e-7))) for p, n in zip(patterns, x)]


class Room:
    """Containers by free space, for best fit."""

    def __init__(self) -> None:
        self.free: list[tuple[int, int]] = []

    def add(self, container: int, space: int) -> None:
        insort(self.free, (space, container))

    def take(self, size: int) -> tuple[int, int] | None:
        """The container with the least space that holds the size."""
        i = bisect_left(self.free, (size, -1))
        if i == len(self.free):
            return None
        space, container = self.free.pop(i)
        return container, space


def pack(ids: np.ndarray, sizes: np.ndarray, capacity: int, groups: int = GROUPS, large: float = LARGE) -> list[tuple[int, int, int, int, int]]:
    """Rows (container, id, piece, start, tokens) for one shard."""
    if capacity < 1:
        raise ValueError("a container holds at least one token")
    placed: list[tuple[int, int, int, int, int]] = []
    items: list[tuple[int, int, int, int]] = []  # size, id, piece, start
    n = 0
    for i, size in zip(ids.tolist(), sizes.tolist()):
        piece = start = 0
        if size > capacity:
            while size - start >= capacity:
                placed.append((n, i, piece, start, capacity))
                n, piece, start = n + 1, piece + 1, start + capacity
            if start == size:
                continue
        items.append((size - start, i, piece, start))
    items.sort(key=lambda t: (-t[0], t[1]))
    least = max(1, int(capacity * large))
    many = next((k for k, t in enumerate(items) if t[0] < least), len(items))
    big, small = items[:many], items[many:]
    room, opened = Room(), {}

    def put(container: int, item: tuple[int, int, int, int]) -> None:
        placed.append((container, item[1], item[2], item[3], item[0]))
        opened[container] = opened.get(container, 0) + item[0]

    rest: list[tuple[int, int, int, int]] = []
    if big:
        parts = [p for p in np.array_split(np.arange(len(big)), min(groups, len(big))) if len(p)]
        by_length: dict[int, list] = {}
        for p in parts:  # the rounded length is that of the group's first, its largest
            by_length.setdefault(big[p[0]][0], []).extend(big[k] for k in p)
        lengths = np.array(sorted(by_length, reverse=True))
        queues = [by_length[k][::-1] for k in lengths.tolist()]
        for pattern, times in configurations(lengths, np.array([len(q) for q in queues], dtype=float), capacity):
            for _ in range(times):
                if all(len(q) == 0 for q, k in zip(queues, pattern) if k):
                    break
                for q, k in zip(queues, pattern):
                    for _ in range(min(int(k), len(q))):
                        put(n, q.pop())
                n += 1
        rest = sorted((t for q in queues for t in q), key=lambda t: (-t[0], t[1]))
    for container, used in opened.items():
        room.add(container, capacity - used)
    for item in (*rest, *small):
        found = room.take(item[0])
        container, space = found if found else (n, capacity)
        if not found:
            n += 1
        put(container, item)
        room.add(container, space - item[0])
    return placed


def place(documents: DataFrame, capacities: list[int], id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """Where each document or piece goes: rows of :data:`PLACED_SCHEMA`."""
    count = documents.select(id_col).count()
    shards = max(1, -(-count // shard))
    sized = documents.select(documents[id_col].cast("bigint").alias("doc_id"), token_count(documents[text_col], folder, vocabulary).alias("tokens")).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    rows = sized.select(F.explode(F.array(*[F.lit(int(c)).cast("bigint") for c in sorted(set(capacities))])).alias("capacity"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), "doc_id", "tokens")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        capacity, part = int(key[0]), int(key[1])
        known = frame[frame["doc_id"].notna()]
        placed = pack(known["doc_id"].to_numpy(np.int64), known["tokens"].to_numpy(np.int64), capacity)
        out = pd.DataFrame(placed, columns=["n", "doc_id", "piece", "start_token", "tokens"])
        out["capacity"], out["container"] = capacity, f"{part}-" + out["n"].astype(str)
        return out[["capacity", "container", "doc_id", "piece", "start_token", "tokens"]]

    # The rows are small and the work on them is not: with an explicit number adaptive execution does not put many shards into one task.
    tasks = min(shards * len(set(capacities)), TASKS * documents.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(max(1, tasks), "capacity", "shard").groupBy("capacity", "shard").applyInPandas(run, PLACED_SCHEMA)


def containers(placed: DataFrame) -> DataFrame:
    """One row for each container: its documents, tokens and fill."""
    return placed.groupBy("capacity", "container").agg(
        F.count("*").alias("n_items"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / F.first("capacity")).alias("fill"),
        F.sort_array(F.collect_list(F.struct("doc_id", "piece", "start_token", "tokens"))).alias("items"),
    )


def fill(placed: DataFrame) -> DataFrame:
    """Per capacity: containers used, the fewest that could hold all tokens, and the mean fill."""
    each = placed.groupBy("capacity", "container").agg(F.sum("tokens").alias("tokens"))
    return each.groupBy("capacity").agg(F.count("*").alias("containers"), F.ceil(F.sum("tokens") / F.col("capacity")).alias("least_containers"), (F.sum("tokens") / (F.count("*") * F.col("capacity"))).alias("mean_fill"))
