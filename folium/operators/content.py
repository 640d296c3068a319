"""Conformance of markup: elements as rows, and content models run over them as automata.

`xml_elements` takes markup apart where it lies: a document is one value, so its tags are walked in one map and nothing is
dealt out; a parent is the last opening one level up. `violations` runs a deterministic automaton for each parent over its children. A
child is a map from states to states; maps compose, so the children of one parent may be cut into chunks that are composed
in parallel, and each chunk is replayed from the state that the chunks before it lead to. The automata are constants of the
tasks: rows hold children, never tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folium.session import cut

#: Children of a parent that are composed in one row.
CHUNK = 1024
NO_ELEMENTS = r"(?s)<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>|<![^>]*>"
TAG = r"""</?[A-Za-z_](?:"[^"]*"|'[^']*'|[^"'>])*>"""


@dataclass(frozen=True)
class Slot:
    """One place of a content model: the names that may stand there, and how often."""

    names: tuple[str, ...]
    required: bool = False
    many: bool = False


def slots(model: str) -> tuple[Slot, ...]:
    """A model in short: places in order, `a|b` for alternatives, then ? (at most one), * (any), + (one or more) or nothing (one); ANY is every other name."""
    return tuple(Slot(tuple(word.rstrip("?*+").split("|")), word[-1] not in "?*", word[-1] in "*+") for word in model.split())


#: Element orders of WordprocessingML parts (ECMA-376, part 1), for the parents that our writer makes.
MODELS = {
    "w:document": "w:background? w:body",
    "w:body": "w:p|w:tbl|w:sdt|w:bookmarkStart|w:bookmarkEnd* w:sectPr?",
    "w:p": "w:pPr? ANY*",
    "w:r": "w:rPr? ANY*",
    "w:tbl": "w:tblPr w:tblGrid w:tr|w:sdt*",
    "w:tblGrid": "w:gridCol*",
    "w:tr": "w:tblPrEx? w:trPr? w:tc|w:sdt+",
    "w:tc": "w:tcPr? w:p|w:tbl|w:sdt|w:bookmarkStart|w:bookmarkEnd+",
    "w:hyperlink": "ANY*",
    "w:sdt": "w:sdtPr? w:sdtEndPr? w:sdtContent?",
    "w:numPr": "w:ilvl? w:numId?",
    "w:tcPr": "w:cnfStyle? w:tcW? w:gridSpan? w:hMerge? w:vMerge? w:tcBorders? w:shd? w:noWrap? w:tcMar? w:textDirection? w:tcFitText? w:vAlign? w:hideMark?",
    "w:tblPr": "w:tblStyle? w:tblpPr? w:tblOverlap? w:bidiVisual? w:tblStyleRowBandSize? w:tblStyleColBandSize? w:tblW? w:jc? w:tblCellSpacing? w:tblInd? w:tblBorders? w:shd? w:tblLayout? w:tblCellMar? w:tblLook?",
    "w:tcBorders": "w:top? w:start|w:left? w:bottom? w:end|w:right? w:insideH? w:insideV?",
    "w:pBdr": "w:top? w:left? w:bottom? w:right? w:between? w:bar?",
    "w:sectPr": "w:headerReference|w:footerReference* w:footnotePr? w:endnotePr? w:type? w:pgSz? w:pgMar? w:paperSrc? w:pgBorders? w:lnNumType? w:pgNumType? w:cols? w:formProt? w:vAlign? w:noEndnote? w:titlePg? w:textDirection? w:bidi? w:rtlGutter? w:docGrid?",
    "w:pPr": "w:pStyle? w:keepNext? w:keepLines? w:pageBreakBefore? w:framePr? w:widowControl? w:numPr? w:suppressLineNumbers? w:pBdr? w:shd? w:tabs? w:suppressAutoHyphens? w:kinsoku? w:wordWrap? w:overflowPunct? w:topLinePunct? w:autoSpaceDE? w:autoSpaceDN? w:bidi? w:adjustRightInd? w:snapToGrid? w:spacing? w:ind? w:contextualSpacing? w:mirrorIndents? w:suppressOverlap? w:jc? w:textDirection? w:textAlignment? w:textboxTightWrap? w:outlineLvl? w:divId? w:cnfStyle? w:rPr? w:sectPr? w:pPrChange?",
    "w:rPr": "w:rStyle? w:rFonts? w:b? w:bCs? w:i? w:iCs? w:caps? w:smallCaps? w:strike? w:dstrike? w:outline? w:shadow? w:emboss? w:imprint? w:noProof? w:snapToGrid? w:vanish? w:webHidden? w:color? w:spacing? w:w? w:kern? w:position? w:sz? w:szCs? w:highlight? w:u? w:effect? w:bdr? w:shd? w:fitText? w:vertAlign? w:rtl? w:cs? w:em? w:lang? w:eastAsianLayout? w:specVanish? w:oMath?",
}


def automaton(places: Sequence[Slot]) -> tuple[dict[str, list[int]], dict[str, list[str | None]], dict[str, list[str | None]], list[str | None]]:
    """(next state, fault, place skipped) by name and state, and what is missing by final state.

    State 2 j: the first j places are behind; 2 j + 1: place j, which repeats, has been used. A faulty child leaves the
    state as it is, but one that skips a required place goes on.
    """
    states = range(2 * len(places) + 1)

    def skipped(state: int, to: int) -> str | None:
        first = state // 2 + state % 2
        return next(("|".join(p.names) for p in places[first:to] if p.required), None)

    moves, faults, skips = {}, {}, {}
    for name in {n for p in places for n in p.names}:
        moves[name], faults[name], skips[name] = [], [], []
        for s in states:
            to = next((j for j in range(s // 2, len(places)) if name in places[j].names), None)
            behind = any(name in p.names for p in places[: s // 2])
            moves[name].append(s if to is None else 2 * to + 1 if places[to].many else 2 * to + 2)
            last = s // 2 - 1
            faults[name].append(None if to is not None else "repeated" if s % 2 == 0 and last >= 0 and name in places[last].names else "misplaced" if behind else "unknown")
            skips[name].append(None if to is None else skipped(s, to))
    return moves, faults, skips, [skipped(s, len(places)) for s in states]


@dataclass(frozen=True)
class Model:
    """A parent's automaton: codes of names, and its tables by code and state."""

    codes: dict[str, int]
    moves: list[list[int]]
    faults: list[list[str | None]]
    skips: list[list[str | None]]
    ends: list[str | None]

    def code(self, name: str) -> int:
        """-1: a name that has no place."""
        found = self.codes.get(name)
        return self.codes.get("ANY", -1) if found is None else found


def compiled(models: dict[str, str] = MODELS) -> dict[str, Model]:
    """The automata by parent; as large as the models, whatever is checked."""
    out = {}
    for parent, model in models.items():
        moves, faults, skips, ends = automaton(slots(model))
        names = sorted(moves)
        out[parent] = Model({n: k for k, n in enumerate(names)}, [moves[n] for n in names], [faults[n] for n in names], [skips[n] for n in names], ends)
    return out


ELEMENT_SCHEMA = "node_id int, end_id int, parent_id int, parent string, pos int, depth int, name string, tag string"
#: Elements that are handed over together.
ROWS = 1 << 14
_NAME = re.compile(r"</?([^\s/>]+)", re.ASCII)
_TAGS, _OTHERS = re.compile(TAG), re.compile(NO_ELEMENTS)


def elements_of(xml: str) -> list[list]:
    """The elements of one document, in the order of ELEMENT_SCHEMA."""
    rows: list[list] = []
    opened: dict[int, list] = {}  # the last row opened at each depth
    below: dict[int | None, int] = {}  # children so far
    depth = 0
    for at, tag in enumerate(_TAGS.findall(_OTHERS.sub("", xml))):
        if tag[1] == "/":
            depth -= 1
            if depth in opened and opened[depth][1] is None:
                opened[depth][1] = at
            continue
        up = opened.get(depth - 1, (None, None, None, None, None, None, None))
        below[up[0]] = below.get(up[0], 0) + 1
        alone = tag.endswith("/>")
        rows.append([at, at if alone else None, up[0], up[6], below[up[0]], depth, _NAME.match(tag)[1], tag])
        if not alone:
            opened[depth] = rows[-1]
            depth += 1
    return rows


def xml_elements(df: DataFrame, keys: Sequence[str], xml: str) -> DataFrame:
    """(keys, node_id, end_id, parent_id, parent, pos, depth, name, tag) of well-formed markup.

    node_id and end_id are the places of an element's tags among all tags, so an element holds those between; pos
    counts a parent's children from 1. Comments, instructions and character data sections hold no elements. Null markup gives
    no rows. A document that is not well-formed gives the elements that its tags make.
    """
    given = df.select(*keys, F.col(xml).cast("string").alias("_xml"))
    schema = StructType(given.select(*keys).schema.fields + StructType.fromDDL(ELEMENT_SCHEMA).fields)
    arrow = to_arrow_schema(schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(len(keys)).to_pylist()):
                if text is not None:
                    rows += elements_of(text)
                    at += [k] * (len(rows) - len(at))
                if len(rows) >= ROWS or k + 1 == batch.num_rows:
                    own = [batch.column(i).take(pa.array(at, pa.int32())) for i in range(len(keys))]
                    found = zip(*rows) if rows else [[]] * (len(arrow) - len(keys))
                    yield pa.RecordBatch.from_arrays(own + [pa.array(list(c), f.type) for c, f in zip(found, list(arrow)[len(keys) :])], schema=arrow)
                    at, rows = [], []

    return given.mapInArrow(kernel, schema)


def violations(children: DataFrame, keys: Sequence[str], models: dict[str, str] = MODELS, chunk: int = CHUNK) -> DataFrame:
    """(keys, parent, pos, name, fault): what breaks the content model of its parent.

    children has keys (which name one parent), parent (its element name), pos and name. Faults: unknown (in no place of the
    model), repeated, misplaced (its place has passed), and missing (name is the required place that pos skips; pos is
    null if the children end before it). Parents without a model are not checked; a parent without children is not seen, so
    rows with a null name stand for empty ones. Equal positions are taken in the order of their names.
    """
    automata = compiled(models)
    part = F.floor((F.coalesce("pos", F.lit(1)) - 1) / chunk)
    entry = F.when(F.col("name").isNotNull(), F.struct(F.col("pos").cast("int").alias("pos"), "name"))
    grouped = children.filter(F.col("parent").isin(*automata)).groupBy(*keys, "parent", part.alias("chunk")).agg(F.array_sort(F.collect_list(entry)).alias("items"))
    named = cut(grouped, "content")
    # only parents of several chunks need to know the state that a chunk begins with
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "parent")]
    long = named.filter("chunk <> 0").select(*[F.col(k).alias(f"_{k}") for k in (*keys, "parent")]).distinct()
    own = StructType(named.select(*keys, "parent", "chunk").schema.fields)
    several = named.join(long, on, "left_semi").select(*keys, "parent", "chunk", F.col("items.name").alias("names"))
    maps = several.mapInArrow(partial(_composed, automata), StructType(own.fields + StructType.fromDDL("map array<int>").fields))
    entries = maps.repartition(*keys, "parent").sortWithinPartitions(*keys, "parent", "chunk").mapInArrow(_walked, StructType(own.fields + StructType.fromDDL("state int, last boolean").fields))
    entries = entries.select(*[F.col(k).alias(f"_{k}") for k in (*keys, "parent", "chunk")], "state", "last")
    ready = named.join(entries, [*on, F.col("chunk") == F.col("_chunk")], "left").select(*keys, "parent", F.coalesce("state", F.lit(0)).alias("state"), F.coalesce("last", F.lit(True)).alias("last"), "items")
    return ready.mapInArrow(partial(_replayed, automata), StructType(named.select(*keys, "parent").schema.fields + StructType.fromDDL("pos int, name string, fault string").fields))


#: Children that are held as Python values at once.
ITEMS = 1 << 16


def _bounded(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ITEMS children, which the lists in the column hold, or of one row: a batch counts rows, and a row is up to a chunk."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + ITEMS, "right")))
        yield batch.slice(start, end - start)
        start = end


def _coded(names: pa.Array, parents: list[str], automata: dict[str, Model]) -> tuple[list[str], list[int], dict[str, list[int]]]:
    """Distinct names, the place of each child's name among them, and their codes by parent."""
    found = names.dictionary_encode()
    distinct = found.dictionary.to_pylist()
    return distinct, found.indices.to_pylist(), {p: [automata[p].code(n) for n in distinct] for p in set(parents)}


def _composed(automata: dict[str, Model], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A map from states to states for each chunk of children."""
    moves = {p: np.array(m.moves, dtype=np.int32) for p, m in automata.items()}
    for batch in batches:
        for part in _bounded(batch, "names"):
            parents, maps, end = part.column("parent").to_pylist(), [], 0
            _, which, codes = _coded(part.column("names").flatten(), parents, automata)
            for parent, n in zip(parents, pc.list_value_length(part.column("names")).to_pylist()):
                states, start, end = np.arange(len(automata[parent].ends), dtype=np.int32), end, end + n
                for at in which[start:end]:
                    if (code := codes[parent][at]) >= 0:
                        states = moves[parent][code][states]
                maps.append(states)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(maps, pa.list_(pa.int32()))], names=[*part.schema.names[:-1], "map"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each chunk of a parent begins with, of maps in their order; a row waits for the one behind it."""
    key, state, held = None, 0, None
    for batch in batches:
        states, lasts = [], []
        first = held
        for k, parent in enumerate(zip(*[c.to_pylist() for c in batch.columns[:-2]])):
            if parent != key:
                state = 0
            if k or held is not None:
                lasts.append(parent != key)
            key = parent
            states.append(state)
            state = batch.column(batch.num_columns - 1)[k].values[state].as_py()
        if not states:
            continue
        rows = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(states, pa.int32())], names=[*batch.schema.names[:-1], "state"])
        ready = pa.Table.from_batches([first, rows] if first is not None else [rows]).combine_chunks()
        held = ready.slice(ready.num_rows - 1).combine_chunks().to_batches()[0]
        yield from ready.slice(0, ready.num_rows - 1).append_column("last", pa.array(lasts, pa.bool_())).to_batches()
    if held is not None:
        yield pa.RecordBatch.from_arrays([*held.columns, pa.array([True])], names=[*held.schema.names, "last"])


def _replayed(automata: dict[str, Model], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The faults of each chunk, from the state that it begins with."""
    for batch in batches:
        for part in _bounded(batch, "items"):
            at, found, end = [], [], 0
            items = part.column("items").flatten()
            parents, places = part.column("parent").to_pylist(), items.field("pos").to_pylist()
            names, which, codes = _coded(items.field("name"), parents, automata)
            counts = pc.list_value_length(part.column("items")).to_pylist()
            for k, (parent, state, last, n) in enumerate(zip(parents, part.column("state").to_pylist(), part.column("last").to_pylist(), counts)):
                model, start, end = automata[parent], end, end + n
                for i in range(start, end):
                    code = codes[parent][which[i]]
                    fault = "unknown" if code < 0 else model.faults[code][state]
                    if fault is not None:
                        found.append((places[i], names[which[i]], fault))
                    if code >= 0:
                        if model.skips[code][state] is not None:
                            found.append((places[i], model.skips[code][state], "missing"))
                        state = model.moves[code][state]
                if last and model.ends[state] is not None:
                    found.append((None, model.ends[state], "missing"))
                at += [k] * (len(found) - len(at))
            own = [part.column(i).take(pa.array(at, pa.int32())) for i in range(part.num_columns - 3)]
            told = list(zip(*found)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([*own, pa.array(told[0], pa.int32()), pa.array(told[1], pa.string()), pa.array(told[2], pa.string())], names=[*part.schema.names[:-3], "pos", "name", "fault"])
