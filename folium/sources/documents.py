"""Collections of documents as tables: HTML strings, DOCX bytes, and back.

Parsing and writing are Arrow-batched kernels, one document per row, and never fail a job: what cannot be read
becomes a row with an error, and null documents give no row. Select the two columns that a kernel needs before it, since Spark cannot look inside.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folium.kernels import docx_read, html_read, html_write
from folium.kernels.docx_stream import text_rows_breaks
from folium.kernels.docx_write import assembled, write_docx
from folium.kernels.nodes import NODE_COLUMNS, NODE_SCHEMA, Document, flatten
from folium.kernels.package import PackageError, open_package

HTML_SCHEMA = "doc_id long, body string, header string, footer string, first_header string, first_footer string, watermark string, css string, page string, n_media int, error string"
DOCX_SCHEMA = "doc_id long, content binary, error string"
VARIABLE_SCHEMA = "doc_id long, ord int, source string, name string, placeholder string, sample_value string"


def read_docx_files(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """path and content of all packages below a folder, in any store that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _parts(batch: pa.RecordBatch, limit: int = 1 << 20, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `limit` bytes of content, which bounds the rows held at once."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and (held + size > limit or k - start >= rows):
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def _map(df: DataFrame, id: str, value: str, one: Callable[[int, object], list[dict]], schema: str) -> DataFrame:
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    maps = [f.name for f in arrow if pa.types.is_map(f.type)]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                found = [row for key, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if x is not None for row in one(key, x)]
                for name in maps:
                    for row in found:
                        row[name] = list((row.get(name) or {}).items())
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return df.select(df[id].cast("long").alias("doc_id"), df[value]).mapInArrow(kernel, schema)


def _document(kind: str, preprocess: Callable[[str], str] | None = None) -> Callable[[object], Document]:
    return (lambda x: html_read.from_html(x, preprocess=preprocess)) if kind == "html" else (lambda x: docx_read.read_docx(bytes(x)))


#: What a map makes of one document: rows of (key, document), and their schema.
Reader = tuple[Callable[[int, object], list[dict]], str]


def nodes_reader(kind: str = "html", preprocess: Callable[[str], str] | None = None, kinds: Sequence[str] | None = None, columns: Sequence[str] | None = None) -> Reader:
    """See nodes."""
    read = _document(kind, preprocess)
    wanted = [c for c in NODE_COLUMNS if columns is None or c in columns]
    if columns is not None and len(wanted) != len(set(columns)):
        raise ValueError(f"no columns of node tables: {sorted(set(columns).difference(NODE_COLUMNS))}")
    schema = ", ".join(c for c in NODE_SCHEMA.split(", ") if c.split()[0] in wanted)

    def one(key: int, value: object) -> list[dict]:
        try:
            return flatten(key, read(value), kinds, wanted)
        except (PackageError, RecursionError) as error:
            return [{"doc_id": key, "sec": 0, "part": "error", "node_id": 0, "ord": 0, "depth": 0, "kind": "error", "text": str(error), "style": {}}]

    return one, schema


def nodes(df: DataFrame, id: str, value: str, kind: str = "html", preprocess: Callable[[str], str] | None = None, kinds: Sequence[str] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The node table of every document (NODE_SCHEMA); kind "html" or "docx". Unreadable ones give one "error" node.

    preprocess: a function over each HTML string, such as html_read.ended_references. kinds, columns: of which nodes rows are made, beside
    "error", and of what; Spark cannot look inside the kernel, so what is filtered or left out behind it has been made.
    """
    return _map(df, id, value, *nodes_reader(kind, preprocess, kinds, columns))


ELEMENT_SCHEMA = "doc_id long, node_id int, end_id int, parent_id int, ord int, depth int, nth int, nth_last int, tag string, text string, attrs map<string,string>"


def elements(df: DataFrame, id: str, value: str) -> DataFrame:
    """The body of every HTML document as rows (ELEMENT_SCHEMA): elements, and texts as rows without a tag.

    Ids are pre-order; an element holds the ids up to its end_id. nth and nth_last count an element among its
    sibling elements, from 1; ord counts all children. The body itself has depth 0.
    """

    def one(key: int, html: str) -> list[dict]:
        rows: list[dict] = []
        stack: list = [(html_read.parse(html)[0], None, 0, 0, 1, 1)]
        while stack:
            node, parent, at, depth, nth, back = stack.pop()
            if depth is None:  # all below has been numbered
                rows[node]["end_id"] = len(rows) - 1
                continue
            number = len(rows)
            row = {"doc_id": key, "node_id": number, "end_id": number, "parent_id": parent, "ord": at, "depth": depth}
            if isinstance(node, str):
                rows.append(row | {"text": node, "attrs": {}})
                continue
            rows.append(row | {"nth": nth, "nth_last": back, "tag": node.tag, "attrs": node.attrs})
            stack.append((number, None, 0, None, 0, 0))
            total, seen, below = sum(not isinstance(c, str) for c in node.children), 0, []
            for k, child in enumerate(node.children):
                seen += not isinstance(child, str)
                below.append((child, number, k, depth + 1, seen, total - seen + 1))
            stack.extend(reversed(below))
        return rows

    return _map(df, id, value, one, ELEMENT_SCHEMA)


def _html_row(key: int, doc: Document, variables: list | None = None) -> dict:
    made = html_write.to_html(doc, variables)
    page = json.dumps(made.page) if made.page else None
    return {
        "doc_id": key, "body": made.body, "header": made.header, "footer": made.footer, "first_header": made.first_header, "first_footer": made.first_footer,
        "watermark": made.watermark, "css": made.css, "page": page, "n_media": len(made.media), "error": None,
    }


def html_reader(kind: str = "docx") -> Reader:
    """See to_html."""

    def one(key: int, value: object) -> list[dict]:
        try:
            return [_html_row(key, _document(kind)(value))]
        except (PackageError, RecursionError) as error:
            return [{"doc_id": key, "error": str(error)}]

    return one, HTML_SCHEMA


def to_html(df: DataFrame, id: str, value: str, kind: str = "docx") -> DataFrame:
    """Every document as HTML (HTML_SCHEMA); an unreadable one has only its error."""
    return _map(df, id, value, *html_reader(kind))


def _packed(key: int, make: Callable[[], bytes]) -> list[dict]:
    try:
        return [{"doc_id": key, "content": make(), "error": None}]
    except (PackageError, RecursionError, ValueError) as error:
        return [{"doc_id": key, "content": None, "error": f"{type(error).__name__}: {error}"}]


def _read(packed: Callable[[int, object], list[dict]], then: Reader | None) -> Reader:
    """Packages, or what `then` reads of those that were made."""
    if then is None:
        return packed, DOCX_SCHEMA
    read, schema = then
    return (lambda key, x: [row for p in packed(key, x) if p["content"] is not None for row in read(key, p["content"])]), schema


def to_docx(df: DataFrame, id: str, value: str, with_styles: bool = False, styles: dict | None = None, then: Reader | None = None) -> DataFrame:
    """HTML strings as DOCX bytes: (doc_id, content, error). with_styles: rules of <style> blocks apply first. then: see assemble."""
    read = html_read.from_html_with_styles if with_styles else html_read.from_html
    return _map(df, id, value, *_read(lambda key, x: _packed(key, lambda: write_docx(read(x), styles)), then))


def text_to_docx(df: DataFrame, id: str, value: str) -> DataFrame:
    """Plain texts as DOCX bytes, one paragraph each; line breaks and tabs stay."""
    from folium.kernels.nodes import Section, paragraph, run

    return _map(df, id, value, lambda key, x: _packed(key, lambda: write_docx(Document([Section([paragraph([run(x)])])]))), DOCX_SCHEMA)


def assemble(df: DataFrame, id: str, body: str, rels: str | None = None, parts: dict[str, tuple[str, str]] | None = None, then: Reader | None = None) -> DataFrame:
    """Packages from columns of ready markup: (doc_id, content, error).

    body holds what is inside the document's body, rels further <Relationship> elements; parts maps a relationship's
    id to its role ("header", "styles", ...) and the column of the whole part. A null body gives no row, a null part
    is left out. The markup is taken as it is: reading tells whether it is well-formed. then: html_reader() or nodes_reader("docx"),
    which read each package where it is made; a map of its own would keep a second worker in each task, and a batch of packages.
    """
    parts = parts or {}
    columns = [df[body].alias("body"), (df[rels] if rels else F.lit("")).alias("rels")] + [df[c].alias(f"part{k}") for k, (_, c) in enumerate(parts.values())]
    whole = df.select(df[id].alias("doc_id"), F.when(df[body].isNotNull(), F.to_json(F.struct(*columns))).alias("whole"))

    def made(text: str) -> bytes:
        given = json.loads(text)
        held = {rid: (role, given[f"part{k}"]) for k, (rid, (role, _)) in enumerate(parts.items()) if given.get(f"part{k}") is not None}
        return assembled(given["body"], given.get("rels") or "", held)

    return _map(whole, "doc_id", "whole", *_read(lambda key, x: _packed(key, lambda: made(x)), then))


def fidelity(df: DataFrame, id: str, value: str) -> DataFrame:
    """(doc_id, reads, covered, fixed_point) of every HTML document, all in one kernel.

    reads: it becomes a package that can be read; covered: the package's text is the page's, white space apart;
    fixed_point: a second round gives the same text.
    """
    tags = re.compile(r"<[^>]*>")
    plain = lambda body: "".join("".join(tags.split(body)).replace("&nbsp;", "").replace("&apos;", "'").split())

    def one(key: int, x: str) -> list[dict]:
        back = lambda doc: html_write.to_html(docx_read.read_docx(write_docx(doc))).body
        try:
            doc = html_read.from_html(x)
            direct, once = plain(html_write.to_html(doc).body), back(doc)
            first = plain(once)
            return [{"doc_id": key, "reads": True, "covered": direct == first, "fixed_point": first == plain(back(html_read.from_html(once)))}]
        except (PackageError, RecursionError, ValueError):
            return [{"doc_id": key, "reads": False, "covered": None, "fixed_point": None}]

    return _map(df, id, value, one, "doc_id long, reads boolean, covered boolean, fixed_point boolean")


def text_digests(df: DataFrame, id: str, value: str) -> DataFrame:
    """(doc_id, text_md5, n_rows, n_breaks, error) of every package, read as a stream: main parts may be larger than a tree could be held."""

    def one(key: int, value: object) -> list[dict]:
        try:
            digest, rows, breaks = text_rows_breaks(bytes(value))
        except PackageError as error:
            return [{"doc_id": key, "text_md5": None, "n_rows": None, "n_breaks": None, "error": str(error)}]
        return [{"doc_id": key, "text_md5": digest, "n_rows": rows, "n_breaks": breaks, "error": None}]

    return _map(df, id, value, one, "doc_id long, text_md5 string, n_rows long, n_breaks long, error string")


def variables(df: DataFrame, id: str, value: str, patterns: Sequence[str] = docx_read.PATTERNS) -> DataFrame:
    """Template variables of DOCX packages (VARIABLE_SCHEMA); an unreadable package gives one row with source "error"."""

    def one(key: int, value: object) -> list[dict]:
        try:
            found = docx_read.detect_variables(open_package(bytes(value)), patterns)
        except (PackageError, RecursionError) as error:
            return [{"doc_id": key, "ord": 0, "source": "error", "name": None, "placeholder": str(error), "sample_value": None}]
        return [{"doc_id": key, "ord": k, "source": v.source, "name": v.name, "placeholder": v.placeholder, "sample_value": v.sample} for k, v in enumerate(found)]

    return _map(df, id, value, one, VARIABLE_SCHEMA)


def parts(df: DataFrame, id: str, value: str) -> DataFrame:
    """(doc_id, path, role, n_bytes, mime): main part, parts by role and media of every package."""

    def one(key: int, value: object) -> list[dict]:
        try:
            package = open_package(bytes(value))
        except PackageError as error:
            return [{"doc_id": key, "path": None, "role": "error", "n_bytes": None, "mime": str(error)}]
        rows = [(package.main, "document", None)] + [(None, role, None) for role in package.parts]
        rows += [(p, "header", None) for p in package.headers] + [(p, "footer", None) for p in package.footers] + [(p, "media", len(b)) for p, b in package.media.items()]
        mime = lambda p: None if p is None else package.types["override"].get(p) or package.types["default"].get(p.rpartition(".")[2].lower())
        return [{"doc_id": key, "path": p, "role": r, "n_bytes": n, "mime": mime(p)} for p, r, n in rows]

    return _map(df, id, value, one, "doc_id long, path string, role string, n_bytes long, mime string")


def relationships(df: DataFrame, id: str, value: str) -> DataFrame:
    """(doc_id, part, ord, rid, type, target, external) of every package; an unreadable one gives one row of type "error"."""

    def one(key: int, value: object) -> list[dict]:
        try:
            package = open_package(bytes(value))
        except (PackageError, RecursionError) as error:
            return [{"doc_id": key, "part": None, "ord": 0, "rid": None, "type": "error", "target": str(error), "external": None}]
        return [{"doc_id": key, "part": p, "ord": k, "rid": r.id, "type": r.type, "target": r.target, "external": r.external} for p, rows in package.rels.items() for k, r in enumerate(rows)]

    return _map(df, id, value, one, "doc_id long, part string, ord int, rid string, type string, target string, external boolean")


def write_files(df: DataFrame, folder: str, id: str = "doc_id", content: str = "content") -> int:
    """Write each package as <folder>/<id>.docx from the executors; folder must be one that all of them share. Returns the count."""

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pathlib import Path

        base = Path(folder)
        base.mkdir(parents=True, exist_ok=True)
        for frame in frames:
            for key, data in zip(frame[id], frame[content]):
                target = base / f"{key}.docx"
                partial = target.with_suffix(".part")
                partial.write_bytes(data)
                partial.replace(target)  # a retried task overwrites the same file
            yield pd.DataFrame({"n": [len(frame)]})

    return int(df.select(id, content).mapInPandas(save, "n long").groupBy().sum("n").first()[0] or 0)
