"""Problem 4: deeply nested records into related flat tables.

Method: Dewey labelling. Every object of a JSON document gets its parent's
label and its own ordinal position (``3.0.1``; an object that is no list item
has position 0). The parent's label is the label without its last position, so
no join is needed to link rows; a node is known by its schema path and label.
Nodes are grouped by schema path into tables: pages, elements of every level,
detected boxes, line scores, and one for each other kind of object met.

Defined results
---------------
* null, empty, cut-off or non-object JSON gives one ``page`` row with
  ``parsed = false`` and nothing else;
* ``{}`` gives a page row with ``parsed = true`` and no children;
* null entries of a list keep their position but give no row; entries that are
  no objects stay as attribute ``name[]`` with their positions;
* a lone object in place of a list counts as a list of one;
* ``children`` that are neither list nor object stay an attribute;
* nesting may be of any depth: nothing here is recursive;
* equal input rows give equal output rows (nothing is deduplicated here);
* the input may have any further columns, of any name: only the id and JSON
  columns are read, and the output has the columns below and no other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "src string, row_id bigint, node string, dewey string, parent_dewey string, level int, ordinal int, "
    "schema_path string, label string, content string, x1 double, y1 double, x2 double, y2 double, "
    "score double, attributes map<string,string>"
)

#: Where each kind of page JSON keeps its lists, and the names a field may have.
LAYOUT = {
    "page_cache": {
        "elements": ("parsing_res_list",),
        "boxes": (("layout_det_res", "boxes"), ("layout_detection", "boxes")),
        "line_boxes": (("overall_ocr_res", "rec_boxes"),),
        "line_scores": (("overall_ocr_res", "rec_scores"), ("overall_ocr_res", "line_scores")),
    },
    "page_results": {"elements": ("elements",), "boxes": (), "line_boxes": (), "line_scores": ()},
}
LABELS = ("block_label", "type", "label", "blk_type", "category")
CONTENTS = ("block_content", "text", "content", "rec_text", "recognised")
BOXES = ("block_bbox", "bbox", "coordinate", "box", "region", "xyxy")
SCORES = ("confidence", "score", "det_score")


def unwrap(payload: object) -> dict | None:
    """The page object, also from inside the optional ``res`` wrapper."""
    if isinstance(payload, dict):
        inner = payload.get("res")
        return inner if isinstance(inner, dict) else payload
    return None


_SPACE, _SCALAR = re.compile(r"[ \t\n\r]*"), re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity")
_CONSTANTS = {"true": True, "false": False, "null": None}


def load_deep(text: str) -> object:
    """As ``json.loads``, without recursion; for texts nested too deeply for it."""
    root: list = []
    open_: list = [root]  # containers still open; of an object also the name whose value comes next
    names: list[str | None] = [None]
    at = _SPACE.match(text).end()
    fresh = True  # right after an opening bracket or at the start

    def put(value: object) -> None:
        if type(open_[-1]) is list:
            open_[-1].append(value)
        else:
            open_[-1][names[-1]] = value

    while True:
        c = text[at : at + 1]
        holder = open_[-1]
        if len(open_) > 1 and c == ("]" if type(holder) is list else "}") and (fresh or names[-1] != ","):
            open_.pop()
            names.pop()
            at, fresh = _SPACE.match(text, at + 1).end(), False
            if len(open_) > 1:
                names[-1] = None
        elif not fresh and len(open_) > 1 and c == "," and names[-1] is None:
            names[-1] = ","
            at = _SPACE.match(text, at + 1).end()
            continue
        elif not fresh and (len(open_) == 1 or names[-1] is None):
            break
        else:
            if type(holder) is dict:
                if c != '"':
                    raise ValueError("a name is missing")
                names[-1], at = scanstring(text, at + 1, True)
                at = _SPACE.match(text, at).end()
                if text[at : at + 1] != ":":
                    raise ValueError("a colon is missing")
                at = _SPACE.match(text, at + 1).end()
                c = text[at : at + 1]
            if c in ("{", "[") and c:
                new: list | dict = {} if c == "{" else []
                put(new)
                open_.append(new)
                names.append(None)
                at, fresh = _SPACE.match(text, at + 1).end(), True
                continue
            if c == '"':
                value, at = scanstring(text, at + 1, True)
            elif m := _SCALAR.match(text, at):
                value, at = _CONSTANTS.get(m.group(0), m.group(0)), m.end()
                if isinstance(value, str):
                    value = int(value) if value.lstrip("-").isdigit() else float(value)
            else:
                raise ValueError("a value is missing")
            put(value)
            at, fresh = _SPACE.match(text, at).end(), False
            names[-1] = None
        if len(open_) == 1:
            break
    if len(open_) > 1 or len(root) != 1 or at != len(text):
        raise ValueError("the text is cut off or goes on")
    return root[0]


def dump(value: object) -> str:
    """Compact JSON of a value of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        pass
    out: list[str] = []
    todo: list = [value]
    while todo:
        x = todo.pop()
        if type(x) is tuple:
            out.append(x[0])
        elif isinstance(x, (dict, list)):
            inner = [[(json.dumps(k, ensure_ascii=False) + ":",), v] for k, v in x.items()] if isinstance(x, dict) else [[v] for v in x]
            todo.append(("}" if isinstance(x, dict) else "]",))
            for i in range(len(inner) - 1, -1, -1):
                todo.extend(reversed(inner[i]))
                if i:
                    todo.append((",",))
            out.append("{" if isinstance(x, dict) else "[")
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def parse(text: str | None) -> dict | None:
    """The page object of a JSON text of any depth; None for what is no object or cannot be parsed."""
    if not text:
        return None
    try:
        return unwrap(json.loads(text))
    except RecursionError:
        pass
    except ValueError:
        return None
    try:
        return unwrap(load_deep(text))
    except ValueError:
        return None


def items_of(value: object) -> list:
    """A list as it is, a lone object as a list of one, anything else as no list."""
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


def outer_list(page: dict, src: str) -> list:
    """The page's outermost list of elements, also if a later layout renames it."""
    for name in LAYOUT[src]["elements"]:
        if name in page:
            return items_of(page[name])
    best: list = []
    for value in page.values():
        if isinstance(value, list) and len(value) > len(best) and any(isinstance(x, dict) and (any(k in x for k in LABELS) or "children" in x) for x in value):
            best = value
    return best


def _number(value: object) -> float | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        return float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def box_of(value: object) -> tuple:
    """Four numbers from a list, an ``x1..y2`` object or a comma-separated text; else nulls."""
    if isinstance(value, str):
        value = value.split(",")
    if isinstance(value, dict):
        value = [value.get(k) for k in ("x1", "y1", "x2", "y2")]
    if isinstance(value, list) and len(value) == 4:
        numbers = tuple(_number(v) for v in value)
        if None not in numbers:
            return numbers
    return (None, None, None, None)


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, list) and all(isinstance(x, str) for x in value):
        return "\n".join(value)
    if isinstance(value, dict) and isinstance(value.get("raw"), str):
        return value["raw"]
    return dump(value)


def _branches(value: object) -> bool:
    """Whether there is an object in a value, at any depth of lists."""
    if type(value) is dict:
        return True
    todo = [value] if type(value) is list else []
    while todo:
        for x in todo.pop():
            if type(x) is dict:
                return True
            if type(x) is list:
                todo.append(x)
    return False


#: Schema paths of elements - the outermost list, and all that stand in others' ``children`` - and of the object with the lines.
OUTER, INNER, OCR = "$.elements[]", "$.elements[].children[]", "$.overall_ocr_res"
_ONLY_ELEMENTS = frozenset({"element"})


def walk(page: dict, src: str, wanted: frozenset[str]) -> Iterator[tuple[str, str, str | None, int, int, str, object]]:
    """(node, dewey, parent_dewey, level, ordinal, schema_path, object) of a page's objects; a line has its (box, score)."""
    outer = outer_list(page, src)
    elsewhere = bool(wanted - {"element", "page"})
    boxes = {f"$.{a}.{b}[]" for a, b in LAYOUT[src]["boxes"]}
    stack: list[tuple[str, str, int, str, list]] = [("element", "", 0, OUTER, outer)]

    def below(x: dict, label: str, level: int, path: str, element: bool = False) -> None:
        for name, v in x.items():
            if not (type(v) is dict or type(v) is list) or element and name == "children" or v is outer or outer and v is outer[0] and not label:
                continue
            if _branches(v):
                at = f"{path}.{name}" + "[]" * (type(v) is list or f"{path}.{name}[]" in boxes)
                stack.append(("box" if at in boxes else "object", label, level, at, v if type(v) is list else [v]))

    if "page" in wanted:
        yield "page", "", None, 0, 0, "$", page
    if elsewhere:
        below(page, "", 0, "$")
    while stack:
        kind, prefix, level, path, items = stack.pop()
        for i, x in enumerate(items):
            if type(x) is not dict and type(x) is not list:
                continue
            label = f"{prefix}.{i}" if prefix else str(i)
            if type(x) is list:
                if elsewhere and kind != "element":
                    stack.append((kind, label, level, path + "[]", x))
                continue
            if kind in wanted:
                yield kind, label, prefix, level, i, path, x
            if kind == "element" and (inner := x.get("children")):
                stack.append(("element", label, level + 1, INNER, items_of(inner)))
            if elsewhere:
                below(x, label, level + 1, path, kind == "element")
                if "line" in wanted and path == OCR:
                    held = _line_lists(x, src)
                    lines, scores = held.get("line_boxes", []), held.get("line_scores", [])
                    for k in range(max(len(lines), len(scores))):
                        yield "line", f"{label}.{k}", label, level + 1, k, f"{path}.lines[]", (lines[k] if k < len(lines) else None, scores[k] if k < len(scores) else None)


def _line_lists(holder: dict, src: str) -> dict[str, list]:
    """The lists of line boxes and scores of a page's OCR object."""
    out: dict[str, list] = {}
    for kind in ("line_boxes", "line_scores"):
        for _, name in LAYOUT[src][kind]:
            if isinstance(v := holder.get(name), list):
                out.setdefault(kind, v)
    return out


def values(kind: str, x: object, src: str, path: str = "") -> tuple:
    """(label, content, x1, y1, x2, y2, score, attributes) of a node; what no column holds whole is an attribute or a node of its own."""
    if kind == "line":
        return (None, None, *box_of(x[0]), _number(x[1]), [])
    used = {name for lists in ("line_boxes", "line_scores") for _, name in LAYOUT[src][lists] if isinstance(x.get(name), list)} if path == OCR else set()
    found: list[object] = []
    for names in (LABELS, CONTENTS, BOXES, SCORES) if kind in ("element", "box") else ():
        name = next((n for n in names if x.get(n) is not None), None) if kind == "element" or names is not CONTENTS else None
        v = x.get(name) if name else None
        got = (box_of if names is BOXES else _number if names is SCORES else _text)(v)
        found.append(got)
        if name and (got is not None and not (type(v) is dict and type(got) is str) if names is not BOXES else got[0] is not None and (type(v) is not dict or len(v) == 4)):
            used.add(name)
    label, content, box, score = found or (None, None, box_of(None), None)
    attributes: list[tuple[str, str | None]] = []
    for name, v in x.items():
        if name in used:
            continue
        if type(v) is dict:
            continue
        if type(v) is list and _branches(v):
            if odd := [[i, y] for i, y in enumerate(v) if y is not None and not _branches(y)]:
                attributes.append((f"{name}[]", dump(odd)))
            continue
        attributes.append((name, v if v is None or isinstance(v, str) else dump(v)))
    return (label, content, *box, score, attributes)


def flatten_page(text: str | None, src: str, wanted: frozenset[str], with_values: bool = True) -> Iterator[tuple]:
    """Rows of :data:`NODE_SCHEMA` without src and row_id; without values these are null."""
    page = parse(text)
    nothing = (None,) * 8
    if page is None:
        if "page" in wanted:
            yield ("page", "", None, 0, 0, "$", *nothing[:-1], [("parsed", "false")])
        return
    for kind, *place, x in walk(page, src, wanted):
        row = values(kind, x, src, place[-1]) if with_values else nothing
        if kind == "page":
            row = (*nothing[:-1], [("parsed", "true"), *(row[-1] or [])])
        yield (kind, *place, *row)


_NODE_ARROW = pa.schema([
    ("src", pa.string()), ("row_id", pa.int64()), ("node", pa.string()), ("dewey", pa.string()), ("parent_dewey", pa.string()), ("level", pa.int32()), ("ordinal", pa.int32()),
    ("schema_path", pa.string()), ("label", pa.string()), ("content", pa.string()), ("x1", pa.float64()), ("y1", pa.float64()), ("x2", pa.float64()), ("y2", pa.float64()), ("score", pa.float64()), ("attributes", pa.map_(pa.string(), pa.string())),
])


def _input(df: DataFrame, id_col: str, json_col: str, src: str) -> DataFrame:
    return df.select(F.lit(src).alias("src"), df[id_col].cast("bigint").alias("row_id"), df[json_col].alias("doc"))


NODES = ("page", "element", "box", "line", "object")
#: Rows, and characters of their labels and contents, given to Spark at a time; memory only.
_ROWS, _CHARS = 10_000, 4_000_000


def flatten(df: DataFrame, id_col: str, json_col: str, src: str, nodes: tuple[str, ...] = NODES, with_values: bool = True) -> DataFrame:
    """Nodes of each row's JSON as rows of :data:`NODE_SCHEMA`; see the module's text.

    ``nodes`` names the tables wanted; without ``with_values`` only their labels
    and links are filled. No shuffle: each row is flattened where it is read.
    """
    wanted = frozenset(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[] for _ in _NODE_ARROW]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _NODE_ARROW)], schema=_NODE_ARROW)

        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for i, doc in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for node in flatten_page(doc, src, wanted, with_values):
                    rows.append((src, i, *node))
                    size += 2 * len(node[1])
                    if len(rows) >= _ROWS or size > _CHARS:
                        yield batch_of(rows)
                        rows, size = [], 0
            yield batch_of(rows)

    return _input(df, id_col, json_col, src).mapInArrow(run, NODE_SCHEMA)


def nested_elements(df: DataFrame, id_col: str, json_col: str, src: str) -> DataFrame:
    """(src, row_id, elem_path) of the elements inside others' ``children``: labels that :func:`flatten` gives below the outermost level.

    A JVM-side test skips rows whose text cannot have a ``children`` key.
    """
    doc = F.col(json_col)
    rows = df.select(id_col, json_col).where(doc.contains('"children"') | doc.contains("\\u"))
    return flatten(rows, id_col, json_col, src, ("element",), with_values=False).where("level > 0").select("src", "row_id", F.col("dewey").alias("elem_path"))


def attribute(name: str) -> Column:
    return F.col("attributes")[name]
