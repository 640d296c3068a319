"""Benchmark decontamination by template canonicalisation.

A text's words are reduced to templates: numbers, units after numbers and names become typed placeholders, all
else is lower-cased and stripped of marks at its edges. Windows of WINDOW template words are hashed and joined
with the windows of the benchmark items. Where they meet, the document and the item are aligned, and the values
behind the placeholders must be consistent: one value of the item always stands for one value in the document.
So a question whose numbers, names or units were replaced is found as well as a copy.

A capitalised word that begins a sentence may be a name or not, so windows are typed both ways.
Beside each typed window stands an exact one of the values themselves, with case folded. It needs no literal
words, so copies are found however rich in numbers, units or names they are.

The join by hash is a broadcast one of checked size: the benchmark goes to the tasks in parts of at most
MAX_SHIPPED words, and every part meets all documents, so nothing of a document is moved.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.text import count_words
from folium.llm.words import filter_rows, slices, split_words
from folium.session import cut

WINDOW = 8
#: A typed window needs so many words that are not placeholders.
LITERAL = 4
#: A document holds an item if it covers this share of the item's windows ...
COVERAGE = 0.5
#: ... or so many template words of it in one run.
RUN = 13
#: Benchmark words, hence windows, that are shipped to tasks at once (8 bytes a hash and some 100 a word).
MAX_SHIPPED = 2_000_000

NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
#: Unit words that count as a unit directly after a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent % dollar dollars euro euros cent cents usd eur gbp c f k degrees degree hz khz mhz ghz w kw v a j kj cal kcal mph kmh".split()
)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"^\d[\d.,:/]*$")
_GLUED = re.compile(r"^(\d[\d.,]*)([a-z%]+)$")
_NAME = re.compile(r"^[^\W\d_][^\W\d_A-Z]+$")
_ENDINGS = frozenset(".!?:;\"'…")
SCHEMA = "doc_id long, item_id long, contaminated boolean, n_matched long, n_windows long, coverage double, longest_run long, n_slots long, reparameterised boolean"


def templates(text: str, initial: bool = False) -> tuple[list[str], list[str]]:
    """The template words of a text and, beside each, the value behind it.

    With `initial`, a word that begins a sentence can be a name too.
    """
    words: list[str] = []
    values: list[str] = []
    starts = True  # the next word begins a sentence
    for raw in _WORD.findall(text):
        bare = _EDGE.sub("", raw)
        if bare:
            low = bare.lower()
            glued = _GLUED.match(low)
            if _NUMBER.match(low):
                words.append(NUMBER)
            elif glued and glued[2] in UNITS:
                words.append(NUMBER)
                values.append(glued[1])
                words.append(UNIT)
                low = glued[2]
            elif low in UNITS and words and words[-1] == NUMBER:
                words.append(UNIT)
            elif (initial or not starts) and bare[0].isupper() and _NAME.match(bare):
                words.append(NAME)
            else:
                words.append(low)
            values.append(low)
        starts = raw[-1] in _ENDINGS
    return words, values


def _mix(ids: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of each run of `window` word hashes."""
    out = np.zeros(max(0, len(ids) - window + 1), np.uint64)
    for k in range(window):
        out = (out ^ ids[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))


_EMPTY, _IS_NUMBER, _IS_GLUED, _IS_UNIT, _CAN_NAME, _ENDS = 1, 2, 4, 8, 16, 32


_NUMBER_CODE, _UNIT_CODE, _NAME_CODE = (np.uint64(_hash(x)) for x in (NUMBER, UNIT, NAME))


class Reader(dict):
    """Reads a text into template-word hashes, remembering each distinct word's class; bounded.

    It gives what templates() gives, without the values: hashes() of a text equals the hashes of its
    template words, in arrays instead of a loop over words.
    """

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.kinds = np.zeros(4096, np.uint8)
        self.codes, self.units = np.zeros(4096, np.uint64), np.zeros(4096, np.uint64)

    def __missing__(self, raw: str) -> int:
        n = len(self)
        if n >= len(self.kinds):
            self.kinds, self.codes, self.units = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kinds, self.codes, self.units))
        bare = _EDGE.sub("", raw)
        low = bare.lower()
        glued = _GLUED.match(low)
        kind = _ENDS if raw[-1] in _ENDINGS else 0
        if not bare:
            kind |= _EMPTY
        elif _NUMBER.match(low):
            kind |= _IS_NUMBER
        elif glued and glued[2] in UNITS:
            kind |= _IS_GLUED
        else:
            kind |= (_IS_UNIT if low in UNITS else 0) | (_CAN_NAME if bare[0].isupper() and _NAME.match(bare) else 0)
        self.kinds[n], self.codes[n] = kind, _hash(glued[1] if kind & _IS_GLUED else low)
        if kind & _IS_GLUED:
            self.units[n] = _hash(glued[2])
        self[raw] = n
        return n

    def hashes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts in a row: hash of each template word, whether it is a literal one, each text's offset."""
        typed, literal, *_, offsets = self.readings(texts)
        return typed, literal, offsets

    def readings(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """hashes(); before the offsets the hashes and literal words with initial names, and the hash of each value."""
        if len(self) > self.most:
            self._reset()
        codes, offsets, words = split_words(texts)
        at = np.array([self[w] if w else 0 for w in words], np.int64)[codes]
        kinds, codes, units = self.kinds[at], self.codes[at], self.units[at]
        starts = np.ones(len(kinds), np.bool_)
        starts[1:] = kinds[:-1] & _ENDS > 0
        first = offsets[:-1][np.diff(offsets) > 0]
        starts[first] = True
        full = kinds & _EMPTY == 0
        kinds, codes, units, starts = kinds[full], codes[full], units[full], starts[full]
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        first = offsets[:-1][np.diff(offsets) > 0]
        after = np.zeros(len(kinds), np.bool_)
        after[1:] = kinds[:-1] & _IS_NUMBER > 0
        after[first] = False
        number, glued = kinds & (_IS_NUMBER | _IS_GLUED) > 0, kinds & _IS_GLUED > 0
        unit = (kinds & _IS_UNIT > 0) & after
        shaped = (kinds & _CAN_NAME > 0) & ~unit
        name = shaped & ~starts
        typed = np.where(number, _NUMBER_CODE, np.where(unit, _UNIT_CODE, np.where(name, _NAME_CODE, codes)))
        literal = ~(number | unit | name)
        loose, fixed = np.where(shaped, _NAME_CODE, typed), literal & ~shaped
        if glued.any():
            times = glued + 1
            ends = np.cumsum(times)
            offsets = np.concatenate([[0], ends])[offsets]
            last = ends[glued] - 1
            typed, literal, loose, fixed, codes = (np.repeat(x, times) for x in (typed, literal, loose, fixed, codes))
            typed[last] = loose[last] = _UNIT_CODE
            codes[last] = units[glued]
        return typed, literal, loose, fixed, codes, offsets


@lru_cache(maxsize=1)
def reader() -> Reader:
    """The worker's reader: what it has learnt about words serves later tasks too."""
    return Reader()


def windows(codes: np.ndarray, literal: np.ndarray, offsets: np.ndarray, window: int, least: int | None = None, unlike: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each window that lies in one text and holds enough literal words.

    With `unlike`, marks of words, only of windows that hold one of them.
    """
    found = _mix(codes, window)
    count = lambda marks: (t := np.concatenate([[0], np.cumsum(marks)]))[window:] - t[: max(0, len(t) - window)]
    good = count(literal) >= (min(LITERAL, window) if least is None else least)
    if unlike is not None:
        good &= count(unlike) > 0
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(found)]
    good &= np.arange(len(found)) + window <= offsets[1:][text]
    return text[good], found[good]


def every_window(typed: np.ndarray, literal: np.ndarray, loose: np.ndarray, fixed: np.ndarray, exact: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each window in the three readings of Reader.readings(); where a reading changes nothing, once."""
    parts = [
        windows(typed, literal, offsets, window),
        windows(loose, fixed, offsets, window, unlike=literal & ~fixed),
        windows(exact, literal, offsets, window, least=0, unlike=~literal),
    ]
    return tuple(np.concatenate(x) for x in zip(*parts))


class Table:
    """A set of hashes with a bit map before the exact look-up."""

    def __init__(self, hashes: set[int]):
        self.sorted = np.array(sorted(hashes), np.uint64)
        self.bits = np.zeros(1 << 20, np.bool_)
        self.bits[self.sorted & np.uint64((1 << 20) - 1)] = True

    def among(self, found: np.ndarray) -> np.ndarray:
        """Places in `found` of hashes that are in the table."""
        at = np.nonzero(self.bits[found & np.uint64((1 << 20) - 1)])[0]
        near = np.minimum(np.searchsorted(self.sorted, found[at]), len(self.sorted) - 1)
        return at[self.sorted[near] == found[at]]


def _window_of(n: int, window: int) -> int:
    """Items shorter than a window are one window of their own length."""
    return min(window, n)


def readings(text: str) -> tuple[list[str], list[str], list[str], str]:
    """templates() of a text, its template words with initial names, and its words with all marks, case folded, in one line."""
    return *templates(text), templates(text, True)[0], " ".join(_WORD.findall(text)).lower()


def _stands(line: str, item: str) -> bool:
    """Whether the item, without marks at its ends, stands in the line as whole words."""
    bare = _EDGE.sub("", item)
    return bool(re.search(rf"(?<!\w){re.escape(bare)}(?!\w)", line))


def _places(words: list[str], want: list[str], starts: list[int], w: int) -> dict[int, list[int]]:
    """Starts of the item's windows by diagonal, where the document has the same window."""
    at = defaultdict(list)
    for i in starts:
        at[tuple(want[i : i + w])].append(i)
    diagonals = defaultdict(list)
    first = {p[0] for p in at}
    for j in range(len(words) - w + 1):
        if words[j] in first:
            for i in at.get(tuple(words[j : j + w]), ()):
                diagonals[j - i].append(i)
    return diagonals


def _consistent(starts: list[int], shift: int, want: list[str], had: list[str], values: list[str], w: int) -> tuple[list[int], dict]:
    """The windows of a diagonal that agree on the value of each of the item's slots, and the slots."""
    slots: dict[tuple[str, str], str] = {}
    good = []
    for i in sorted(starts):
        own: dict[tuple[str, str], str] = {}
        fits = True
        for k in range(i, i + w):
            if want[k][0] == "<":
                key = (want[k], had[k])
                value = values[k + shift]
                if slots.get(key, own.get(key, value)) != value:
                    fits = False
                    break
                own[key] = value
        if fits:
            slots.update(own)
            good.append(i)
    return good, slots


def verify(doc: tuple, item: tuple, window: int) -> dict | None:
    """Align a document with an item; None unless enough of the item is there with consistent slots.

    doc and item are readings() or templates(). The item's windows are looked up in the document and grouped by
    diagonal (document place minus item place). On a diagonal, a window counts if it is typed alike in one of the
    two ways and every placeholder's value maps to one value only, or if its values are equal. Coverage is of the
    windows with enough literal words or of all, whichever is more. An item shorter than a window without a typed
    one must stand there with its marks.
    """
    (words, values), (want, had) = doc[:2], item[:2]
    w = _window_of(len(want), window)
    if w < 2:
        return None
    every = list(range(len(want) - w + 1))
    enough = lambda named: [i for i in every if sum(x[0] != "<" for x in named[i : i + w]) >= min(LITERAL, w)]
    typed = enough(want)
    if not typed and w < window and len(doc) > 2 and not _stands(doc[3], item[3]):
        return None
    ways = [(want, _places(words, want, typed, w)), (had, _places(values, had, every, w))]
    if len(doc) > 2 and item[2] != want:
        ways.append((item[2], _places(doc[2], item[2], enough(item[2]), w)))
    best = None
    covered: set[int] = set()
    for shift in {d for _, places in ways for d in places}:
        good: set[int] = set()
        slots: dict[tuple[str, str], str] = {}
        for named, places in ways:
            held, own = _consistent(places.get(shift, []), shift, named, had, values, w)
            good.update(held)
            slots = own | slots
        if not good:
            continue
        for k in {k for i in good for k in range(i, i + w) if want[k][0] == "<"}:
            slots.setdefault((want[k], had[k]), values[k + shift])
        run = longest = 1
        ordered = sorted(good)
        for a, b in zip(ordered, ordered[1:]):
            run = run + 1 if b == a + 1 else 1
            longest = max(longest, run)
        covered |= good
        found = (longest + w - 1, len(slots), any(k[1] != v for k, v in slots.items()))
        best = max(best, found) if best else found
    if best is None:
        return None
    matched, total = len(covered), len(every)
    some = len(covered.intersection(typed))
    if typed and some * total >= matched * len(typed):
        matched, total = some, len(typed)
    coverage = matched / total
    if coverage < COVERAGE and best[0] < RUN:
        return None
    return {"n_matched": matched, "n_windows": total, "coverage": coverage, "longest_run": best[0], "n_slots": best[1], "reparameterised": best[2]}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in range(9)]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


class Index:
    """The windows of item rows by hash. Rows count by their place in `items`, so repeated and null ids do not matter."""

    def __init__(self, items: list[tuple[int | None, str]], window: int):
        self.window, self.ids, self.known = window, [i for i, _ in items], [readings(t) for _, t in items]
        self.owner: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, text) in enumerate(items):
            found = reader().readings(pa.array([text]))
            if (w := _window_of(len(found[0]), window)) >= 2:
                for h in set(every_window(*found, w)[1].tolist()):
                    self.owner[w][h].append(k)
        self.tables = {w: Table(set(x)) for w, x in self.owner.items() if x}

    def meet(self, texts: pa.Array) -> dict[int, list[int]]:
        """text -> item rows that share a window with it."""
        here: dict[int, set[int]] = defaultdict(set)
        seen = reader().readings(texts)
        for w, table in self.tables.items():
            at, found = every_window(*seen, w)
            for k in table.among(found).tolist():
                here[int(at[k])].update(self.owner[w][int(found[k])])
        return {k: sorted(v) for k, v in sorted(here.items())}

    def hits(self, texts: pa.Array, all_of: bool = True) -> Iterator[tuple[int, int, dict]]:
        """(text, item row, evidence) of every item that a text holds; without `all_of`, the first of each text."""
        for k, rows in self.meet(texts).items():
            doc = readings(texts[k].as_py())
            for row in rows:
                if hit := verify(doc, self.known[row], self.window):
                    yield k, row, hit
                    if not all_of:
                        break


_built: dict[str, Index] = {}


def _index(key: str, shared, window: int) -> Index:
    """The worker's index of a shipped part: built once, kept for later tasks; two at most are kept."""
    if key not in _built:
        while len(_built) > 1:
            del _built[next(iter(_built))]
        _built[key] = Index(shared.value, window)
    return _built[key]


def parts_of(items: DataFrame, most: int) -> Iterator[list[tuple[int | None, str]]]:
    """The item rows in parts of at most `most` words (a single longer item is a part of its own).

    Rows are dealt to buckets by a hash; buckets that are too large are dealt again. Only one part is on the
    driver at a time, so neither the driver nor a broadcast grows with the benchmark.
    """
    sized = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text <> ''")
    sized = sized.withColumn("_n", count_words(F.col("text")) + 1)
    total, most = sized.agg(F.sum("_n")).first()[0] or 0, max(1, most)
    if total > most:
        sized = cut(sized, "items")
    pending = [(sized, total, 1)] if total else []
    while pending:
        rows, size, salt = pending.pop()
        if size <= most or rows.limit(2).count() == 1:
            yield [(r["item_id"], r["text"]) for r in rows.select("item_id", "text").collect()]
            continue
        into = max(2, -(-2 * size // most))
        # equal rows would share a bucket for ever, so from the second deal on a row's place in its file counts too
        spot = F.pmod(F.xxhash64("text", "item_id", F.lit(salt), *([F.monotonically_increasing_id()] if salt > 1 else [])), F.lit(into))
        dealt = cut(rows.withColumn("_b", spot), "items")
        sizes = dealt.groupBy("_b").agg(F.sum("_n").alias("n")).collect()  # one row a bucket
        pending += [(dealt.filter(F.col("_b") == r["_b"]).drop("_b"), r["n"], salt + 1) for r in sizes]


def _shipped(docs: DataFrame, items: list[tuple[int | None, str]], window: int) -> DataFrame:
    """The evidence rows of one part of the benchmark: its windows are looked up while a text is at hand."""
    sent, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(key, sent, window)
        for batch in batches:
            rows = []
            for part in slices(batch):
                ids = part.column(0).to_pylist()
                rows += [
                    (ids[k], index.ids[row], True, x["n_matched"], x["n_windows"], x["coverage"], x["longest_run"], x["n_slots"], x["reparameterised"]) for k, row, x in index.hits(part.column(1))
                ]
            yield _batch(rows)

    return docs.select("doc_id", "text").mapInArrow(kernel, SCHEMA)


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """One row per document row and benchmark row that it holds, with the evidence; clean documents give no row.

    docs needs doc_id and text, items item_id and text; other columns are not read, so clashing names do not
    matter. Null and empty texts hold nothing, items with fewer than two words match nothing, items shorter than
    a window are matched as a whole. Rows with null ids count like any other and give rows with null ids.
    Repeated items or documents give repeated rows, also where one id has several texts. Empty tables give an
    empty result. A benchmark of more than `max_shipped` words is read in parts, each against all documents;
    the rows are the same however it is divided.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [_shipped(plain, part, window) for part in parts_of(items, max_shipped)]
    return reduce(DataFrame.union, found) if found else plain.sparkSession.createDataFrame([], SCHEMA)


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; all columns stay, and nothing is shuffled.

    Each row is judged by its own text, so null and repeated ids do not matter; null and empty texts stay.
    """
    out = docs
    for part in parts_of(items, max_shipped):
        sent, key = docs.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex

        def held(texts: pa.Array, sent=sent, key=key) -> np.ndarray:
            bad = np.zeros(len(texts), np.bool_)
            bad[[k for k, _, _ in _index(key, sent, window).hits(texts, all_of=False)]] = True
            return ~bad

        out = filter_rows(out, "text", held)
    return out
