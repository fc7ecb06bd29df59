"""Files: listings, metadata blocks, configuration, pluggable engines, EPUB."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """(path, stem, suffix, length, modified) of files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("suffix"), "length", F.col("modificationTime").alias("modified"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images (origin, height, width, nChannels, data); invalid files are left out."""
    return spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")


def file_hash(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha1("content").alias("sha1"))


_VARIABLE = re.compile(r"\$\{([^}:-]+)(?::-([^}]*))?\}")


def expand(value: object, env: dict[str, str] | None = None) -> object:
    """``${NAME:-default}`` in texts and nested dicts replaced; a set but empty variable wins over the default. Lists stay as they are."""
    known = os.environ if env is None else env
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: known.get(m.group(1), m.group(2) or ""), value)
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    return value


@dataclass(frozen=True)
class Settings:
    """Parameters of the post-processing chain."""

    normalize_punctuation: bool = True
    remove_headers: bool = True
    remove_numbers: bool = True
    merge: bool = True
    noise_confidence: float = 0.3
    low_confidence: float = 0.5
    min_confidence: float = 0.5
    skip_first_pages: int = 0
    skip_last_pages: int = 0
    confidence_types: tuple[str, ...] = ("text", "paragraph_title", "doc_title", "content_title")
    extra: dict = field(default_factory=dict)


def settings(values: dict, env: dict[str, str] | None = None) -> Settings:
    """Settings from a parsed file, with variables expanded; unknown keys go to ``extra``."""
    given = expand(values, env)
    known = {f.name for f in fields(Settings)}
    return replace(Settings(), **{k: v for k, v in given.items() if k in known}, extra={k: v for k, v in given.items() if k not in known})


def read_meta(text: str | None) -> dict:
    """The YAML block between ``---`` lines as a dict; empty if there is none."""
    import yaml

    m = re.match(r"^---\s*\n(.*?)\n---\s*$", text or "", re.S)
    data = yaml.safe_load(m.group(1)) if m else None
    return data if isinstance(data, dict) else {}


def write_meta(meta: dict) -> str:
    """A YAML block with title, author, lang and, where set, date, publisher, rights and structure."""
    import yaml

    kept = {k: meta.get(k) for k in ("title", "author", "lang")} | {k: meta[k] for k in ("date", "publisher", "rights", "book_structure") if meta.get(k)}
    return "---\n" + yaml.safe_dump(kept, allow_unicode=True, default_flow_style=False, sort_keys=False).strip() + "\n---\n"


class PageReader(Protocol):
    """An OCR engine: opened once for each partition, gives page JSON for page images, and is closed."""

    def open(self) -> None: ...
    def read(self, image: bytes) -> str: ...
    def close(self) -> None: ...


_READERS: dict[str, Callable[[], PageReader]] = {}


def register_reader(name: str, make: Callable[[], PageReader]) -> None:
    _READERS[name] = make


def reader(name: str) -> Callable[[], PageReader]:
    if name not in _READERS:
        raise ValueError(f"unknown page reader: {name}")
    return _READERS[name]


def recognise(pages: DataFrame, make: Callable[[], PageReader]) -> DataFrame:
    """(path, page_json) through an engine; a page that fails has null JSON and its error."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        engine = make()
        engine.open()
        try:
            for frame in frames:
                out = []
                for path, content in zip(frame["path"], frame["content"]):
                    try:
                        out.append((path, engine.read(content), None))
                    except Exception as e:  # one page must not end the job
                        out.append((path, None, str(e)))
                yield pd.DataFrame(out, columns=["path", "page_json", "error"])
        finally:
            engine.close()

    return pages.select("path", "content").mapInPandas(run, "path string, page_json string, error string")


def _xhtml(md: str) -> tuple[str, list[tuple[int, str, str]]]:
    """Markdown blocks as XHTML, and the headings with their anchors."""
    from html import escape

    out, heads = [], []
    for n, block in enumerate(b.strip() for b in re.split(r"\n\s*\n", md)):
        if not block or block.startswith(":::"):
            continue
        if m := re.match(r"^(#{1,6})\s+(.+?)(?:\s*\{#([\w-]+)\})?\s*$", block):
            anchor = m.group(3) or f"h-{n}"
            heads.append((len(m.group(1)), m.group(2), anchor))
            out.append(f'<h{len(m.group(1))} id="{anchor}">{escape(m.group(2))}</h{len(m.group(1))}>')
        elif m := re.match(r"^!\[([^\]]*)\]\(([^)]+)\)$", block):
            out.append(f'<p><img src="{escape(m.group(2))}" alt="{escape(m.group(1))}"/></p>')
        elif block.startswith("- "):
            out.append("<ul>" + "".join(f"<li>{escape(x[2:])}</li>" for x in block.split("\n") if x.startswith("- ")) + "</ul>")
        elif block.startswith(">"):
            out.append(f"<blockquote><p>{escape(re.sub(r'^>', '', block).strip())}</p></blockquote>")
        else:
            out.append(f"<p>{escape(block)}</p>")
    return "\n".join(out), heads


def epub(title: str, author: str, lang: str, md: str) -> bytes:
    """A small EPUB 3: the ``mimetype`` first and stored, package, contents and one text file; equal input gives equal bytes."""
    import io
    import zipfile
    from html import escape

    body, heads = _xhtml(md)
    page = lambda t, b: f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="{escape(lang)}"><head><title>{escape(t)}</title></head><body>{b}</body></html>'
    nav = "".join(f'<li><a href="text.xhtml#{a}">{escape(t)}</a></li>' for k, t, a in heads if k <= 2) or '<li><a href="text.xhtml">Text</a></li>'
    parts = {
        "META-INF/container.xml": '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
        "book.opf": f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(title)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator><dc:language>{escape(lang)}</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="text" href="text.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="text"/></spine></package>',
        "nav.xhtml": page(title, f'<nav epub:type="toc"><ol>{nav}</ol></nav>'),
        "text.xhtml": page(title, body),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype", (1980, 1, 1, 0, 0, 0)), "application/epub+zip", zipfile.ZIP_STORED)
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def epubs(books: DataFrame) -> DataFrame:
    """(book_id, epub) from (book_id, title, author, lang, book_md)."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            yield pd.DataFrame({"book_id": f["book_id"], "epub": [epub(t or "Untitled", a or "Unknown", lang or "zh-CN", md or "") for t, a, lang, md in zip(f["title"], f["author"], f["lang"], f["book_md"])]})

    return books.select("book_id", "title", "author", "lang", "book_md").mapInPandas(run, "book_id string, epub binary")
