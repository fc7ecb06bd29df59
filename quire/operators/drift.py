"""Problem 3: schemas that drift between files.

Method: similarity flooding. For each object shape that misses a required
field, two schema graphs are built - the baseline object and the object found -
with nodes for the object, its fields, their JSON types and the fields nested
below them. Match scores start from names and value statistics and are
propagated along equal edges until they converge. In the found graph each
missing field also has a node for "no counterpart", of its own type and with
nothing below it; a field is renamed to the name whose converged score is
higher than that node's, the pairs of highest score first, each side once.
Correspondences then rename and cast each page into one table (``unify``), and
what does not correspond is reported (``changes``).

Scale: the JSON is parsed where it is read and reduced per batch to object
shapes with summed value statistics; only those shapes are shuffled, so a
document that holds a third of all pages costs no more than any other. The
baseline's value statistics cover all rows; they are at most one row for each
field of the baseline.

Defined results: null, cut-off, non-object and ``{}`` pages show no change;
missing optional fields and null values are none; equal rows count once; a null
document key is reported under null. Extra columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.nested import _text, box_of, items_of, outer_list, parse
from quire.runtime import cut

#: One letter for each JSON type.
CODES = {type(None): "0", bool: "b", int: "n", float: "n", str: "s", list: "a", dict: "o"}
NAMES = {"0": "null", "b": "boolean", "n": "number", "s": "string", "a": "array", "o": "object"}
#: Value statistics, summed over values: how many, then shares and means once divided.
STATS = ("n", "string", "number", "boolean", "array", "object", "log_len", "digits", "ascii", "pathlike", "spaces", "integer", "unit", "log_abs", "negative", "items", "item_number", "item_string", "item_list", "item_object")
#: How much each statistic of a type tells fields apart, by its place in STATS.
WEIGHTS = {"s": {6: 0.15, 7: 1.2, 8: 0.1, 9: 1.5, 10: 0.25}, "n": {11: 1.2, 12: 1.2, 13: 0.35, 14: 1.5}, "b": {}, "a": {15: 0.35, 16: 1.0, 17: 1.0, 18: 1.5, 19: 1.5}, "o": {15: 0.2}}
PLACE = {"s": 1, "n": 2, "b": 3, "a": 4, "o": 5}

CHANGE_SCHEMA = "src string, doc_key string, field_path string, change_kind string, found_path string, pages bigint"


class Node:
    """A field of the baseline."""

    __slots__ = ("path", "code", "required", "fields", "item", "item_code")

    def __init__(self, path: str, code: str = "o", required: bool = False):
        self.path, self.code, self.required = path, code, required
        self.fields: dict[str, Node] = {}
        self.item: Node | None = None
        self.item_code: str | None = None


def compile_baseline(rows: list[dict]) -> dict[str, Node]:
    """A tree for each ``src`` from the rows of page_schema."""
    roots: dict[str, Node] = {}
    codes = {v: k for k, v in NAMES.items()}
    for row in sorted(rows, key=lambda r: r["field_path"].count(".") + r["field_path"].count("[]")):
        node = roots.setdefault(row["src"], Node(""))
        *above, last = row["field_path"].split(".")
        for part in above:
            node = node.fields[part.removesuffix("[]")]
            if part.endswith("[]"):
                node.item = node.item or Node(node.path + "[]")
                node = node.item
        if last.endswith("[]"):
            node.fields[last[:-2]].item_code = codes[row["json_type"]]
        else:
            node.fields[last] = Node(row["field_path"], codes[row["json_type"]], bool(row["required"]))
    for root in roots.values():
        for field in root.fields.values():
            if field.item and "children" in field.item.fields:
                field.item.fields["children"].item = field.item  # nested elements have the outermost list's layout
    return roots


def _stats(v: object, into: list[float]) -> None:
    into[0] += 1
    kind = type(v)
    if kind is str:
        into[1] += 1
        n = len(v)
        into[6] += math.log1p(n)
        if n:
            c = v[0]
            if c.isdigit() or c == "-":
                into[7] += 1
            if v.isascii():
                into[8] += 1
                if "/" in v and " " not in v:
                    into[9] += 1
            if " " in v or "\n" in v:
                into[10] += 1
    elif kind is int or kind is float:
        into[2] += 1
        if v == v and abs(v) != math.inf:
            if v == int(v):
                into[11] += 1
            if 0 <= v <= 1:
                into[12] += 1
            into[13] += math.log1p(abs(v))
            if v < 0:
                into[14] += 1
    elif kind is bool:
        into[3] += 1
    elif kind is list:
        into[4] += 1
        into[15] += math.log1p(len(v))
        for x in v:
            c = CODES.get(type(x), "s")
            if c != "0" and c != "b":
                into["nsao".index(c) + 16] += 1 / len(v)
    elif kind is dict:
        into[5] += 1
        into[15] += math.log1p(len(v))


#: Levels below a field that its graph shows.
NESTING = 2


def _deep(v: object, into: set[str], prefix: str = "", depth: int = NESTING) -> None:
    """The paths below a value with their types, of all items of a list."""
    if isinstance(v, dict):
        for k, x in v.items():
            path = f"{prefix}.{k}" if prefix else k
            into.add(f"{path}:{CODES.get(type(x), 's')}")
            if depth > 1 and isinstance(x, (dict, list)):
                _deep(x, into, path, depth - 1)
    elif isinstance(v, list):
        for x in v:
            if isinstance(x, dict):
                _deep(x, into, prefix, depth)


def _below(node: Node, prefix: str = "", depth: int = NESTING) -> tuple[str, ...]:
    """As :func:`_deep`, of a field of the baseline."""
    out: list[str] = []
    for k, f in (node.item or node).fields.items():
        path = f"{prefix}.{k}" if prefix else k
        out.append(f"{path}:{f.code}")
        if depth > 1:
            out.extend(_below(f, path, depth - 1))
    return tuple(out)


class Shapes:
    """Sums the object shapes of one batch: (doc, baseline path, keys and types) -> pages and value statistics."""

    def __init__(self, root: Node, src: str):
        self.root, self.src = root, src
        self.found: dict[tuple, list] = {}

    def add(self, doc: str | None, page: dict) -> None:
        seen: set[tuple] = set()
        stack = [(self.root, page)]
        while stack:
            node, obj = stack.pop()
            fields = node.fields
            key = tuple([(k, CODES.get(type(v), "s")) for k, v in obj.items()])
            full = (doc, node.path, key)
            entry = self.found.get(full)
            if entry is None:
                entry = self.found[full] = [0, {k: [0.0] * len(STATS) for k, _ in key}, {}, set()]
            if full not in seen:
                seen.add(full)
                entry[0] += 1
            stats = entry[1]
            for k, v in obj.items():
                if v is None:
                    continue
                _stats(v, stats[k])
                child = fields.get(k)
                if child is None:
                    if type(v) is dict or type(v) is list:
                        _deep(v, entry[2].setdefault(k, set()))
                    continue
                if child.code == "o" and type(v) is dict:
                    stack.append((child, v))
                elif child.code == "a":
                    if child.item_code and type(v) is list:
                        for c in set(map(type, v)):
                            if (code := CODES.get(c, "s")) not in ("0", child.item_code):
                                entry[3].add(k)
                    if child.item and (type(v) is list or type(v) is dict):
                        item = child.item
                        stack.extend([(item, x) for x in items_of(v) if type(x) is dict])

    def rows(self) -> list[tuple]:
        return [
            (self.src, doc, path, json.dumps({"keys": list(map(list, key)), "items": sorted(e[3])}, ensure_ascii=False), e[0], [k for k, _ in key], [x for k, _ in key for x in e[1][k]], e[2])
            for (doc, path, key), e in self.found.items()
        ]


_SHAPE_SCHEMA = "src string, doc_key string, obj_path string, shape string, pages bigint, field string, stats array<double>, deep array<string>"


def shapes(df: DataFrame, key_col: str, json_col: str, src: str, baseline: list[dict]) -> DataFrame:
    """Object shapes with value statistics, one row for each (document, object path, shape, field)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = compile_baseline(baseline)[src]
        width = len(STATS)
        total = Shapes(root, src)
        out = pa.schema([("src", pa.string()), ("doc_key", pa.string()), ("obj_path", pa.string()), ("shape", pa.string()), ("pages", pa.int64()), ("field", pa.string()), ("stats", pa.list_(pa.float64())), ("deep", pa.list_(pa.string()))])

        def flush() -> pa.RecordBatch:
            rows = [(s, d, p, sh, n, f, st[i * width : (i + 1) * width], sorted(deep.get(f, ()))) for s, d, p, sh, n, fs, st, deep in total.rows() for i, f in enumerate(fs)]
            total.found.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(list(zip(*rows)) or [()] * 8, out)], schema=out)

        for batch in batches:
            for key, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if page := parse(doc):
                    total.add(key, page)
            if len(total.found) > 20_000:  # memory only: what is flushed early is summed again below
                yield flush()
        yield flush()

    rows = df.select(df[key_col].cast("string").alias("doc_key"), df[json_col].alias("doc")).where(F.col("doc").isNotNull())
    parts = rows.mapInArrow(run, _SHAPE_SCHEMA)
    sums = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(len(STATS))]
    return parts.groupBy("src", "doc_key", "obj_path", "shape", "field").agg(F.sum("pages").alias("pages"), *sums, F.array_distinct(F.flatten(F.collect_set("deep"))).alias("deep"))


def value_similarity(base: np.ndarray, found: np.ndarray, code: str) -> float:
    """1 for equal statistics of the values of one type, towards 0 for different ones; less where the found values are of other types."""
    k = PLACE[code]
    if not base[k] or not found[0]:
        return 0.0
    share = found[k] / found[0]
    if not share:
        return 0.0
    return float(share * math.exp(-sum(w * abs(base[i] / base[k] - found[i] / found[k]) for i, w in WEIGHTS[code].items())))


def name_similarity(a: str, b: str) -> float:
    """Trigram overlap, raised where one name is a part, prefix or word of the other."""
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    grams = [{f"  {x} "[i : i + 3] for i in range(len(x) + 1)} for x in (a, b)]
    score = len(grams[0] & grams[1]) / max(1, len(grams[0] | grams[1]))
    words = [set(x.split("_")) for x in (a, b)]
    if words[0] & words[1]:
        score = max(score, 0.5)
    for x in words[0]:
        for y in words[1]:
            if x and y and (x.startswith(y) or y.startswith(x)):
                score = max(score, 0.4 + 0.3 * min(len(x), len(y)) / max(len(x), len(y)))
    return score


def graph(fields: dict[str, tuple[str, tuple[str, ...]]]) -> list[tuple[str, str, str]]:
    """Labelled edges of an object: has field, has type, nests field; ``fields`` gives each field's type and the paths below it."""
    edges = []
    for k, (code, deep) in fields.items():
        edges += [("", "has", f"f:{k}"), (f"f:{k}", "type", f"t:{code}")]
        for path in deep:
            name, _, c = path.rpartition(":")
            above, _, _ = name.rpartition(".")
            node = f"d:{k}.{name}"
            edges += [(f"d:{k}.{above}" if above else f"f:{k}", "nests", node), (node, "type", f"t:{c}")]
    return edges


@lru_cache(maxsize=512)
def _propagation(left: tuple, right: tuple) -> tuple[dict[tuple[str, str], int], np.ndarray]:
    """The pairs of nodes of two graphs that equal edges connect, and how far each pair's score flows to each other pair."""
    pairs: dict[tuple[str, str], int] = {}
    flows: list[tuple[int, int, str]] = []
    by_label: dict[str, list[tuple[str, str]]] = {}
    for c, label, d in graph(dict(right)):
        by_label.setdefault(label, []).append((c, d))
    for a, label, b in graph(dict(left)):
        for c, d in by_label.get(label, ()):
            i, j = pairs.setdefault((a, c), len(pairs)), pairs.setdefault((b, d), len(pairs))
            flows.append((i, j, label))
    out: dict[tuple[int, str, bool], int] = {}
    for i, j, label in flows:
        out[i, label, True] = out.get((i, label, True), 0) + 1
        out[j, label, False] = out.get((j, label, False), 0) + 1
    m = np.zeros((len(pairs), len(pairs)))
    for i, j, label in flows:
        m[j, i] += 1 / out[i, label, True]
        m[i, j] += 1 / out[j, label, False]
    return pairs, m


def flood(left: dict[str, tuple[str, tuple[str, ...]]], right: dict[str, tuple[str, tuple[str, ...]]], start: dict[tuple[str, str], float], rounds: int = 50, eps: float = 1e-4) -> dict[tuple[str, str], float]:
    """Similarity flooding over two object graphs: the converged score of each field pair.

    ``start`` has the first scores of field pairs; equal types and equal names of nested fields start with 1.
    """
    pairs, m = _propagation(tuple(left.items()), tuple(right.items()))
    sigma0 = np.zeros(len(pairs))
    for (a, b), i in pairs.items():
        if a[:2] == "f:" and b[:2] == "f:":
            sigma0[i] = start.get((a[2:], b[2:]), 0.0)
        elif a == b or a[:2] == "d:" and a.partition(".")[2] == b.partition(".")[2]:
            sigma0[i] = 1.0
    sigma = sigma0.copy()
    for _ in range(rounds):
        new = sigma0 + sigma + m @ (sigma0 + sigma)
        new /= new.max() if len(new) and new.max() else 1
        done = len(new) == 0 or np.abs(new - sigma).max() < eps
        sigma = new
        if done:
            break
    return {(a[2:], b[2:]): float(sigma[i]) for (a, b), i in pairs.items() if a[:2] == "f:" and b[:2] == "f:"}


#: First score of "no counterpart", and the most a name adds to a pair whose values are not wholly unlike.
NONE_SCORE, NAME_SCORE = 0.3, 0.3


def correspond(node: Node, keys: dict[str, str], deep: dict[str, list[str]], stats: dict[str, np.ndarray], known: dict[str, np.ndarray]) -> dict[str, str]:
    """Missing required field -> the found name that carries its values, by converged scores alone.

    ``known`` has the baseline's value statistics by path; they and the names only give the first scores.
    """
    missing = [k for k, f in node.fields.items() if f.required and k not in keys]
    extra = [k for k, code in keys.items() if k not in node.fields and code != "0"]
    if not missing or not extra:
        return {}
    start: dict[tuple[str, str], float] = {(k, k): 1.0 for k in keys if k in node.fields}
    for m in missing:
        child = node.fields[m]
        for e in extra:
            base = known.get(child.path)
            v = value_similarity(base, stats[e], child.code) if base is not None else 0.6 * (keys[e] == child.code)
            if child.code == "o":
                v *= 0.4  # what two objects share is seen below them
            name = name_similarity(m, e)
            start[m, e] = v + NAME_SCORE * name * (name >= 0.4 and v > 0.05)
        start[m, "\0" + m] = NONE_SCORE
    left = {k: (f.code, _below(f) if k in missing else ()) for k, f in node.fields.items()}
    right = {k: (code, tuple(deep.get(k, ())) if k in extra else ()) for k, code in keys.items()} | {"\0" + m: (node.fields[m].code, ()) for m in missing}
    score = flood(left, right, start)
    taken: dict[str, str] = {}
    for m, e in sorted(((m, e) for m in missing for e in extra), key=lambda p: (-score.get(p, 0.0), p)):
        if m not in taken and e not in taken.values() and score.get((m, e), 0.0) > score.get((m, "\0" + m), 0.0):
            taken[m] = e
    return taken


def _known(table: DataFrame, baseline: list[dict]) -> dict[str, dict[str, np.ndarray]]:
    """Value statistics of the baseline's fields where they stand as the baseline has them, over all rows.

    At most one row for each row of the baseline comes to the driver.
    """
    paths = F.when(F.col("obj_path") == "", F.col("field")).otherwise(F.concat_ws(".", "obj_path", "field"))
    want = {(r["src"], r["field_path"]) for r in baseline}
    rows = table.withColumn("path", paths).where(F.concat_ws(" ", "src", "path").isin([" ".join(w) for w in sorted(want)]))
    kept = rows.groupBy("src", "path").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(STATS))])
    out: dict[str, dict[str, np.ndarray]] = {}
    for r in kept.limit(len(want)).collect():
        out.setdefault(r["src"], {})[r["path"]] = np.array([r[f"s{i}"] for i in range(len(STATS))])
    return out


def _matched(table: DataFrame, baseline: list[dict]) -> DataFrame:
    """One row for each change and shape, and for each rename."""
    known = _known(table, baseline)
    names = [f"s{i}" for i in range(len(STATS))]
    # A name's values count over the whole document: one shape alone may have only empty or null ones.
    by_name = table.groupBy("src", "doc_key", "obj_path", "field").agg(F.array(*[F.sum(n) for n in names]).alias("sums"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("deep")))).alias("deep"))
    keys = ("src", "obj_path", "field")
    a, b = table.select("src", "doc_key", "obj_path", "shape", "field", "pages").alias("a"), by_name.alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("doc_key", *keys)]).select("a.*", "b.sums", "b.deep")
    stats = F.collect_list(F.struct("field", "sums", "deep"))
    whole = joined.groupBy("src", "doc_key", "obj_path", "shape").agg(F.max("pages").alias("pages"), stats.alias("stats"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roots = compile_baseline(baseline)
        by_path: dict[tuple[str, str], Node] = {}
        for src, root in roots.items():
            todo = [root]
            while todo:
                node = todo.pop()
                if (src, node.path) not in by_path:
                    by_path[src, node.path] = node
                    todo += [*node.fields.values(), *([node.item] if node.item else [])]
        for batch in batches:
            out: list[tuple] = []
            for src, doc, path, shape, pages, values in batch.itertuples(index=False, name=None):
                node, s = by_path[src, path], json.loads(shape)
                keys, sums, deep = dict(s["keys"]), {v["field"]: np.asarray(v["sums"]) for v in values}, {v["field"]: list(v["deep"]) for v in values}
                kinds = {k: code if code != "0" or not sums[k][0] else "snbao"[int(np.argmax(sums[k][1:6]))] for k, code in keys.items()}
                renamed = correspond(node, kinds, deep, sums, known.get(src, {}))
                prefix = f"{path}." if path else ""
                for name, field in node.fields.items():
                    if name in keys:
                        if keys[name] not in ("0", field.code):
                            out.append((src, doc, field.path, "retyped", field.path, pages))
                        elif name in s["items"]:
                            out.append((src, doc, field.path + "[]", "retyped", field.path + "[]", pages))
                    elif name in renamed:
                        out.append((src, doc, field.path, "renamed", prefix + renamed[name], pages))
                    elif field.required:
                        out.append((src, doc, field.path, "removed", None, pages))
                for k in keys:
                    if k not in node.fields and k not in renamed.values():
                        out.append((src, doc, prefix + k, "added", prefix + k, pages))
            yield pd.DataFrame(out, columns=["src", "doc_key", "field_path", "change_kind", "found_path", "pages"])

    return whole.mapInPandas(run, CHANGE_SCHEMA)


def baseline_rows(schema: DataFrame) -> list[dict]:
    """The rows of page_schema; bounded: a layout's fields, not data."""
    return [r.asDict() for r in schema.select("src", "field_path", "json_type", "required").collect()]


def renames_and_changes(sources: list[tuple[DataFrame, str, str, str]], schema: DataFrame) -> DataFrame:
    """As :func:`changes`, with one row for each ``found_path``: a field may have other names on other pages."""
    baseline = baseline_rows(schema)
    table = None
    for df, key, column, src in sources:
        part = shapes(df, key, column, src, baseline)
        table = part if table is None else table.unionByName(part)
    assert table is not None
    found = _matched(cut(table), baseline)
    return found.groupBy("src", "doc_key", "field_path", "change_kind", "found_path").agg(F.max("pages").alias("pages"))


def changes(sources: list[tuple[DataFrame, str, str, str]], schema: DataFrame) -> DataFrame:
    """Each change per document: (src, doc_key, field_path, change_kind, found_path, pages).

    ``sources`` are (table, document key column, JSON column, src). ``pages`` is
    the number of pages with it, by the shape that has most.
    """
    found = renames_and_changes(sources, schema)
    return found.groupBy("src", "doc_key", "field_path", "change_kind").agg(F.max("found_path").alias("found_path"), F.max("pages").alias("pages"))


UNIFIED_SCHEMA = (
    "src string, row_id bigint, doc_key string, page_index bigint, width double, height double, input_path string, settings string, "
    "elements array<struct<path string, label string, content string, x1 double, y1 double, x2 double, y2 double, id string, ord bigint, confidence double, extra string>>, "
    "boxes array<struct<cls_id bigint, label string, score double, x1 double, y1 double, x2 double, y2 double, extra string>>, "
    "line_scores array<double>, line_boxes array<struct<x1 double, y1 double, x2 double, y2 double>>, layout_extra string, ocr_extra string, extra string"
)


def _as_number(v: object) -> float | None:
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, str):
        v = v.strip().removesuffix("px")
    try:
        x = float(v)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return x if math.isfinite(x) else None


def _as_int(v: object) -> int | None:
    x = _as_number(v)
    return None if x is None or abs(x) >= 2**63 else int(x)


CORNERS = ("x1", "y1", "x2", "y2")


class _Fields:
    """An object's fields under their baseline names. What a column takes whole leaves ``left``; the rest is its ``extra``.

    ``names`` gives for each found path the (pages, field) it may stand for; a
    name is applied where the object lacks the field, the one with most pages first.
    """

    __slots__ = ("left",)

    def __init__(self, obj: dict, prefix: str, names: dict[str, list[tuple[int, str]]]):
        self.left = dict(obj)
        if names:
            for _, k, field in sorted((-n, k, field) for k in obj for n, field in names.get(prefix + k, ())):
                if field not in self.left and k in self.left:
                    self.left[field] = self.left.pop(k)

    def take(self, name: str, cast: Callable[[object], object]) -> object:
        """The value as the column has it; what the cast cannot hold stays in ``left``."""
        v = self.left.get(name)
        x = None if v is None else cast(v)
        if v is None or x is not None and (type(x) is not int or x == _as_number(v)):
            self.left.pop(name, None)
            if isinstance(x, str) and isinstance(v, dict) and isinstance(v.get("raw"), str) and len(v) > 1:
                self.left[name] = {k: y for k, y in v.items() if k != "raw"}
        return x

    def objects(self, name: str) -> list:
        """The entries of a list of objects; entries that are none stay in ``left`` with their positions."""
        v = self.left.get(name)
        if v is None or isinstance(v, (list, dict)):
            self.left.pop(name, None)
        items = items_of(v)
        if odd := [[i, x] for i, x in enumerate(items) if x is not None and not isinstance(x, dict)]:
            self.left[f"{name}[]"] = odd
        return items

    def box(self, name: str, prefix: str, names: dict[str, list[tuple[int, str]]]) -> dict[str, float | None]:
        v = self.left.pop(name, None)
        if isinstance(v, dict):
            inner = _Fields(v, f"{prefix}{name}.", names)
            corners = tuple(inner.take(k, _as_number) for k in CORNERS)
            v = inner.left or None
        elif None not in (corners := box_of(v)):
            v = None
        if v is not None:
            self.left[name] = v
        return dict(zip(CORNERS, corners))

    def extra(self) -> str | None:
        return json.dumps(self.left, ensure_ascii=False) if self.left else None


def unify(df: DataFrame, id_col: str, key_col: str, json_col: str, src: str, report: DataFrame) -> DataFrame:
    """Pages of one source as rows of :data:`UNIFIED_SCHEMA`.

    ``report`` is the result of :func:`renames_and_changes`; its renames are
    joined by document (an equi-join; adaptive execution splits a hot document).
    Fields are renamed at every level and cast. What the baseline lacks, and
    what a cast cannot hold, goes as JSON to the ``extra`` of its own object:
    page, element, box, or ``layout_extra`` and ``ocr_extra``. Pages that cannot
    be parsed keep their keys, with nulls. Names inside an object that is itself
    renamed are mapped where the report has them for the document, else they
    stay in ``extra``.
    """
    renames = report.where((F.col("src") == src) & (F.col("change_kind") == "renamed")).groupBy(F.col("doc_key").alias("of_doc")).agg(F.collect_list(F.struct("found_path", "pages", "field_path")).alias("renames"))
    pages = df.select(df[id_col].cast("bigint").alias("row_id"), df[key_col].cast("string").alias("doc_key"), df[json_col].alias("doc"))
    joined = pages.join(renames, F.col("doc_key").eqNullSafe(F.col("of_doc")), "left").select("row_id", "doc_key", "doc", "renames")
    cached = src == "page_cache"
    outer, settings_name = ("parsing_res_list", "model_settings") if cached else ("elements", "engine")
    label, content, box, order = ("block_label", "block_content", "block_bbox", "block_order") if cached else ("type", "text", "bbox", "order_index")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row_id, key, doc, renames in batch.itertuples(index=False, name=None):
                page = parse(doc)
                if page is None:
                    rows.append((src, row_id, key, *[None] * 12))
                    continue
                names: dict[str, list[tuple[int, str]]] = {}
                for r in renames if renames is not None else ():
                    names.setdefault(r["found_path"], []).append((r["pages"], r["field_path"].rpartition(".")[2]))
                top = _Fields(page, "", names)
                name = outer
                if outer not in top.left and (other := outer_list(page, src)):
                    name = next(k for k, v in top.left.items() if v is other)
                elements: list[dict] = []
                stack = [("", top.objects(name))]
                while stack:
                    prefix, items = stack.pop()
                    for i, x in enumerate(items):
                        if isinstance(x, dict):
                            e = _Fields(x, f"{outer}[].", names)
                            path = f"{prefix}.{i}" if prefix else str(i)
                            elements.append({"path": path, "label": e.take(label, _text), "content": e.take(content, _text), **e.box(box, f"{outer}[].", names), "id": e.take("block_id", _text), "ord": e.take(order, _as_int), "confidence": e.take("confidence", _as_number)})
                            if below := e.objects("children"):
                                stack.append((path, below))
                            elements[-1]["extra"] = e.extra()
                boxes: list[dict] = []
                scores = line_boxes = layout_extra = ocr_extra = None
                if cached and isinstance(top.left.get("layout_det_res"), dict):
                    layout = _Fields(top.left.pop("layout_det_res"), "layout_det_res.", names)
                    for x in layout.objects("boxes"):
                        if isinstance(x, dict):
                            b = _Fields(x, "layout_det_res.boxes[].", names)
                            boxes.append({"cls_id": b.take("cls_id", _as_int), "label": b.take("label", _text), "score": b.take("score", _as_number), **b.box("coordinate", "layout_det_res.boxes[].", names)})
                            boxes[-1]["extra"] = b.extra()
                    layout_extra = layout.extra()
                if cached and isinstance(top.left.get("overall_ocr_res"), dict):
                    ocr = _Fields(top.left.pop("overall_ocr_res"), "overall_ocr_res.", names)
                    if isinstance(found := ocr.left.get("rec_scores"), list):
                        scores = [_as_number(s) for s in found]
                        if all(s is not None or v is None for s, v in zip(scores, found)):
                            del ocr.left["rec_scores"]
                    if isinstance(found := ocr.left.get("rec_boxes"), list):
                        line_boxes = [dict(zip(CORNERS, box_of(v))) for v in found]
                        if all(b["x1"] is not None and not (isinstance(v, dict) and len(v) > 4) or v is None for b, v in zip(line_boxes, found)):
                            del ocr.left["rec_boxes"]
                    ocr_extra = ocr.extra()
                settings = top.left.pop(settings_name, None)
                fixed = (top.take("page_index", _as_int), top.take("width", _as_number), top.take("height", _as_number), top.take("input_path", _text))
                rows.append((src, row_id, key, *fixed, None if settings is None else json.dumps(settings, ensure_ascii=False), elements, boxes, scores, line_boxes, layout_extra, ocr_extra, top.extra()))
            names_ = ["src", "row_id", "doc_key", "page_index", "width", "height", "input_path", "settings", "elements", "boxes", "line_scores", "line_boxes", "layout_extra", "ocr_extra", "extra"]
            frame = pd.DataFrame(rows, columns=names_)
            frame["page_index"] = frame["page_index"].astype("Int64")
            yield frame

    return joined.mapInPandas(run, UNIFIED_SCHEMA)
