import random

import numpy as np
import pytest

from quire.llm import mixing, packing, tokens


def whole(placed, ids, sizes, capacity):
    used, parts = {}, {}
    for c, i, piece, start, n in placed:
        used[c] = used.get(c, 0) + n
        parts.setdefault(i, []).append((start, n))
    assert all(v <= capacity for v in used.values())
    for i, s in zip(ids, sizes):
        got = sorted(parts[i])
        assert sum(n for _, n in got) == s
        if s <= capacity:
            assert len(got) == 1
        else:
            assert [a for a, _ in got] == [sum(n for _, n in got[:k]) for k in range(len(got))]
    return len(used)


@pytest.mark.parametrize("seed", range(6))
def test_containers_hold_everything(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    sizes = rng.choice([rng.integers(0, 50, n), rng.integers(300, 1000, n), rng.integers(0, 5000, n), np.full(n, 400)])
    ids = np.arange(n)
    used = whole(packing.pack(ids, sizes, 1000), ids, sizes, 1000)
    least = -(-int(sizes.sum()) // 1000)
    # first-fit decreasing as the yardstick
    room = []
    for s in sorted((int(s) % 1000 if s > 1000 else int(s) for s in sizes), reverse=True):
        k = next((k for k, r in enumerate(room) if r >= s), None)
        if k is None:
            room.append(1000 - s)
        else:
            room[k] -= s
    whole_ffd = len(room) + sum(int(s) // 1000 for s in sizes if s > 1000)
    assert least <= used <= whole_ffd * 1.12 + 2


def test_configurations_meet_the_bound():
    lengths, counts = np.array([60, 50, 40, 30]), np.array([40.0, 30.0, 50.0, 20.0])
    used = packing.configurations(lengths, counts, 100)
    made = sum(p * n for p, n in used)
    assert all((p * lengths).sum() <= 100 for p, _ in used) and (made <= counts + 1e-6).all()
    assert sum(n for _, n in used) <= -(-int((lengths * counts).sum()) // 100) + 4 and (counts - made).sum() <= 10


def test_pattern_is_the_best():
    rng = random.Random(3)
    for _ in range(20):
        lengths = np.array(sorted({rng.randrange(5, 40) for _ in range(5)}, reverse=True))
        values = np.array([rng.random() for _ in lengths])
        best = [0.0] * 61
        for c in range(1, 61):
            best[c] = max([best[c - 1]] + [best[c - n] + v for n, v in zip(lengths, values) if n <= c])
        pattern, value = packing.best_pattern(lengths, values, 60)
        assert (pattern * lengths).sum() <= 60 and abs(value - best[60]) < 1e-9


def test_packing_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 500, "x"), (5, "字" * 300, "x"), (None, "lost", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tokens string")
    placed = packing.place(df, [100, 1000], shard=2)
    got = placed.collect()
    assert {r.doc_id for r in got if r.capacity == 100} == {1, 2, 3, 4, 5}
    for cap in (100, 1000):
        for i, text in ((1, "a b c"), (4, "word " * 500), (5, "字" * 300)):
            assert sum(r.tokens for r in got if r.capacity == cap and r.doc_id == i) == tokens.count(text)
    assert all(r.tokens <= r.capacity and abs(r.fill - r.tokens / r.capacity) < 1e-9 for r in packing.containers(placed).collect())
    assert packing.place(df.limit(0), [100]).count() == 0
    assert packing.fill(placed).count() == 2
    with pytest.raises(ValueError):
        packing.pack(np.array([1]), np.array([1]), 0)


def test_rates():
    targets = [("a", 0.5, 2), ("b", 0.3, 4), ("c", 0.2, 1), ("none", 0.1, 3), ("odd", None, None)]
    have = {"a": 1000, "b": 100, "c": 5000}
    rates = mixing.repetition_rates(have, targets, 2000)
    assert rates["b"] == 4 and rates["none"] == 0 and rates["odd"] == 0 and rates["a"] <= 2 and rates["c"] <= 1
    assert abs(sum(rates[s] * have[s] for s in have) - 2000) < 1e-6
    assert abs(rates["a"] * 1000 / (rates["c"] * 5000) - 0.5 / 0.2) < 1e-9
    assert mixing.repetition_rates({}, targets) == dict.fromkeys([t[0] for t in targets], 0.0)


def test_mix_rows(spark):
    rows = [(i, f"some text {i} " * (i % 7 + 1), "ab"[i % 2], "x") for i in range(400)] + [(1000, None, "a", "x"), (1001, "", None, "x"), (1002, "t", "unlisted", "x"), (0, "some text 0 ", "a", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copy string")
    targets = spark.createDataFrame([("a", 0.7, 3), ("b", 0.3, 2), ("empty", 0.1, 2), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    sized = mixing.sizes(df)
    got = mixing.mix(sized, targets, total=6000).collect()
    again = mixing.mix(sized, targets, total=6000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and {r.source for r in got} == {"a", "b"}
    assert max(r.copy for r in got) <= 3
    share = {r.source: r for r in mixing.shares(sized, targets, total=6000).collect()}
    assert abs(share["a"].reached_share - 0.7) < 0.05 and share["empty"].rate == 0 and abs(sum(r.reached_share for r in share.values()) - 1) < 1e-9
    assert mixing.mix(sized.limit(0), targets).count() == 0 and {r.reached_share for r in mixing.shares(sized.limit(0), targets).collect()} == {0.0}
