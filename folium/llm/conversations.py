"""Conversations damaged and repaired at least cost: A* on the edit lattice.

1. Each row is damaged by a hash of its key (`damaged`), as columns.
2. Rows lose their texts: a row becomes its order within the conversation and one symbol, which holds the initial of
   its role and its first fault. Symbols are gathered for each segment of SEGMENT turn numbers, so a conversation of
   any share of the rows is dealt over many tasks.
3. A segment's symbols span a lattice: (rows consumed, state of the role grammar). A* searches it with the keys
   (cost plus heuristic, audit); the heuristic sums two for each faulty row ahead, for it must be deleted (blank,
   duplicate) or costs at least that (truncated: deleted or kept for five), so it is a sum over suffixes and consistent.
4. A conversation of several segments composes them: each is searched from all four states to all four, in parallel,
   and (cost, audit) pairs are added up in order. Two audits of equal cost for the same rows are never each other's
   beginning, as each further insertion costs, so the least of the parts makes the least whole.
5. The texts move once, sorted behind their segment's edits, and stream through a hash in constant memory.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.session import cut, spread

#: Turn numbers of a segment.
SEGMENT = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of `(s?(ua)+)?` by the role that leads to the next: start, after s, after u, after a.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
WANTED = "uuau"
NAMES = {"u": "user", "a": "assistant"}
#: A row's symbol: its role's initial, small for a sound row, else the fault's letter by initial.
INITIALS, FAULTS = "sua-", ("", "blank", "duplicate", "truncated")
SYMBOLS = {chr(ord("A") + 4 * f + i): (INITIALS[i], FAULTS[f]) for f in range(4) for i in range(4)}
FLOW = {"su", "ua", "au"}


def search(symbols: str, state: int, ends: tuple[int, ...]) -> dict[int, tuple[int, str]]:
    """For each end state, or only the best of `ends` if they are ENDS, the least (cost, audit) from `state`.

    The first time a node leaves the queue its (cost, audit) is the least: the heuristic depends on the place alone.
    """
    rows = [SYMBOLS[x] for x in symbols]
    ahead = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if rows[i][1] else 0)
    queue = [(ahead[0], "", 0, state)]
    closed: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    push = heapq.heappush
    while queue:
        key, audit, i, q = heapq.heappop(queue)
        if (i, q) in closed:
            continue
        closed.add((i, q))
        cost = key - ahead[i]
        if i == len(rows):
            if q in ends:
                found[q] = (cost, audit)
                if ends is ENDS or len(found) == len(ends):
                    return found
        else:
            initial, fault = rows[i]
            rest = cost + ahead[i + 1]
            push(queue, (rest + DELETE, audit + "D", i + 1, q))
            if fault in ("", "truncated"):
                more = TRUNCATED if fault else 0
                if (q, initial) in NEXT:
                    push(queue, (rest + KEEP + more, audit + "K", i + 1, NEXT[q, initial]))
                push(queue, (rest + REROLE + more, audit + "R", i + 1, NEXT[q, WANTED[q]]))
        push(queue, (key + INSERT, audit + "I", i, NEXT[q, WANTED[q]]))
    return found


@lru_cache(maxsize=1 << 16)
def repaired(symbols: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return min(search(symbols, 0, ENDS).values())


def crossings(symbols: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) of a segment for every pair of states that some edits connect."""
    return [(a, b, *best) for a in range(4) for b, best in sorted(search(symbols, a, (0, 1, 2, 3) if a == 0 else (1, 2, 3) if a == 1 else (2, 3)).items())]


def composed(segments: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[str]]:
    """The cost and the audit of each segment, for a conversation cut into segments."""
    best: dict[int, tuple[int, str, tuple]] = {0: (0, "", ())}
    for crossing in segments:
        step: dict[int, tuple[int, str, tuple]] = {}
        for a, b, cost, audit in crossing:
            if a in best:
                before = best[a]
                to = (before[0] + cost, before[1] + audit, (before[2], audit))
                if b not in step or to[:2] < step[b][:2]:
                    step[b] = to
        best = step
    cost, _, trail = min((best[q] for q in ENDS if q in best), key=lambda x: x[:2])
    parts: list[str] = []
    while trail:
        trail, audit = trail
        parts.append(audit)
    return cost, parts[::-1]


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copies after damage: 0 copies if the row is dropped, 2 if it is repeated."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(show(conv_id), F.lit(":"), show(turn)).cast("binary")), F.lit(20))
    plain = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), show(role).alias("role"), show(text).alias("text"), code.alias("code"))
    damage = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return plain.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), damage.alias("text"), F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("copies"))


def segments(rows: DataFrame) -> DataFrame:
    """conv_id, part, symbols, low, high, turns: each conversation's symbols by segments of its turn numbers.

    `rows` is what `placed` gives. Rows of one turn are ordered by role, then by the SHA-256 of the text. A conversation
    whose rows were all dropped keeps its segments, without symbols.
    """
    light = rows.select("conv_id", "part", "turn", "role", "digest", "copies", "fault")
    same = Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    live = light.filter(F.col("copies") > 0).withColumn("again", F.row_number().over(same) > 1)
    first_letter = F.substring("role", 1, 1)
    initial = F.when(first_letter.isin(*INITIALS[:3]), F.instr(F.lit(INITIALS), first_letter) - 1).otherwise(3)
    symbol = lambda fault: F.chr(F.lit(ord("A")) + 4 * fault + initial)
    first = F.when(F.col("fault") == 1, 1).when(F.col("again"), 2).otherwise(F.col("fault"))
    # a repeated row is its own duplicate, unless it is blank
    second = F.when(F.col("copies") == 2, symbol(F.when(F.col("fault") == 1, 1).otherwise(2))).otherwise("")
    live = live.select("conv_id", "part", "turn", "role", "digest", "again", "copies", F.concat(symbol(first), second).alias("symbol"))
    gone = light.filter(F.col("copies") == 0).select("conv_id", "part", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(False).alias("again"), "copies", F.lit("").alias("symbol")).distinct()
    entry = F.when(F.col("copies") > 0, F.struct("turn", "role", "digest", "again", "symbol"))
    return live.unionByName(gone).groupBy("conv_id", "part").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["symbol"]), "").alias("symbols"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"),
    )


def placed(rows: DataFrame) -> DataFrame:
    """`damaged` rows with their segment (`part`), the digest of the text, and the fault that the row shows by itself."""
    bare = F.rtrim(F.col("text"), F.lit("\x20\x09\x0a\x0b\x0c\x0d"))
    fault = F.when(bare == "", 1).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(3)
    part = F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62)))
    return rows.select("conv_id", part.cast("long").alias("part"), "turn", "role", "text", "copies", F.unhex(F.sha2("text", 256)).alias("digest"), fault.alias("fault"))


def edits(parts: DataFrame) -> DataFrame:
    """The segments with their edits (`audit`) and, on each conversation's first segment, its cost."""
    counted = parts.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    shape = f"conv_id {parts.schema['conv_id'].dataType.simpleString()}, part long, symbols string, low long, high long, turns long"

    def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
        kept = ["conv_id", "part", "symbols", "low", "high", "turns"]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns.values()], names=[*kept, *columns])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [repaired(x) for x in batch.column("symbols").to_pylist()]
            yield with_columns(batch, cost=pa.array([c for c, _ in found], pa.int64()), audit=pa.array([a for _, a in found], pa.string()))

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        for batch in batches:
            found = [[dict(zip(("a", "b", "cost", "audit"), x)) for x in crossings(s)] for s in batch.column("symbols").to_pylist()]
            yield with_columns(batch, ways=pa.array(found, kind))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["conv_id"]):
            table = pa.Table.from_batches(run)
            cost, parts = composed([[(x["a"], x["b"], x["cost"], x["audit"]) for x in ways] for ways in table.column("ways").to_pylist()])
            costs = pa.array([cost] + [0] * (len(parts) - 1), pa.int64())
            done = table.drop_columns(["ways"]).append_column("cost", costs).append_column("audit", pa.array(parts, pa.string()))
            yield from done.combine_chunks().to_batches()

    solved = f"{shape}, cost long, audit string"
    one = counted.filter(F.col("of") == 1).drop("of").mapInArrow(alone, solved)
    many = counted.filter(F.col("of") > 1).drop("of").repartition("conv_id", "part").mapInArrow(matrix, f"{shape}, ways array<struct<a int, b int, cost long, audit string>>")
    return one.unionByName(many.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(joined, solved))


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive rows of one key, of a sorted stream, as lists of slices."""
    run: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        names = list(zip(*[batch.column(k).to_pylist() for k in key]))
        start = 0
        for i, name in enumerate(names):
            if run and i == start and name != last or i > start and name != names[i - 1]:
                if i > start:
                    run.append(batch.slice(start, i - start))
                yield run
                run, start = [], i
            if i == start and not run:
                last = name
        if batch.num_rows > start:
            run.append(batch.slice(start))
            last = names[-1]
    if run:
        yield run


class _Report:
    """Counts and the hash of one conversation, fed segment by segment and text by text."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.hash, self.written = conv_id, hashlib.sha256(), False
        self.faults = dict.fromkeys(FAULTS, 0)
        self.illegal = self.cost = self.turns = 0
        self.low = self.high = None
        self.last, self.state, self.audit, self.todo, self.at = "", 0, [], "", 0

    def segment(self, symbols: str, low, high, turns: int, cost: int, audit: str) -> None:
        self.end_segment()
        for initial, fault in map(SYMBOLS.__getitem__, symbols):
            self.faults[fault] += 1
            self.illegal += bool(self.last) and self.last + initial not in FLOW
            self.last = initial
        if low is not None:
            self.low, self.high = low if self.low is None else min(low, self.low), high if self.high is None else max(high, self.high)
        self.turns, self.cost, self.todo, self.at = self.turns + turns, self.cost + cost, audit, 0
        self.audit.append(audit)

    def write(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.written else "") + role + ":" + text).encode())
        self.written = True

    def inserts(self) -> None:
        while self.at < len(self.todo) and self.todo[self.at] == "I":
            role = WANTED[self.state]
            self.write(NAMES[role], "")
            self.state, self.at = NEXT[self.state, role], self.at + 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit, self.at = self.todo[self.at], self.at + 1
        if edit != "D":
            initial = role[:1] if edit == "K" else WANTED[self.state]
            self.write(role if edit == "K" else NAMES[initial], text)
            self.state = NEXT[self.state, initial]

    def end_segment(self) -> None:
        self.inserts()

    def values(self) -> tuple:
        self.end_segment()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of `rows`: faults after damage, and the cheapest repair.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Nulls count as one space (a
    null turn stays null in the order, first); a null conv_id is a conversation. Rows of one turn are ordered
    by role, then by the SHA-256 of the text; repeated rows follow each other and all but the first are duplicates.
    Roles beside s, u, a by their initial can be rerolled or deleted. Extra columns are not read. A conversation without rows
    after damage has zeros, an empty audit and the hash of the empty string; an empty table gives an empty result.
    """
    texts = placed(damaged(spread(rows), conv_id, turn, role, text))
    done = cut(edits(cut(segments(texts), "segments")), "edits")
    name = done.schema["conv_id"].dataType.simpleString()
    none = lambda kind, *columns: [F.lit(None).cast(kind).alias(c) for c in columns]
    heads = done.select("conv_id", "part", F.lit(0).alias("side"), "low", "high", "turns", "cost", "symbols", "audit", *none("long", "turn"), *none("string", "role", "text"), *none("binary", "digest"), F.lit(0).alias("copies"))
    bodies = texts.filter(F.col("copies") > 0).select("conv_id", "part", F.lit(1).alias("side"), *none("long", "low", "high", "turns", "cost"), *none("string", "symbols", "audit"), "turn", "role", "text", "digest", "copies")
    order = ["conv_id", "part", "side", "turn", "role", "digest"]
    ordered = heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions(*order).drop("turn", "digest")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [None, *[pa.int64()] * 6, pa.string(), pa.string()]
        out: list[tuple] = []
        now: _Report | None = None
        for batch in batches:
            kinds[0] = batch.schema.field("conv_id").type
            for c, side, low, high, turns, cost, symbols, audit, role_, text_, copies in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "side", "low", "high", "turns", "cost", "symbols", "audit", "role", "text", "copies")]):
                if now is None or c != now.conv_id:
                    if now is not None:
                        out.append(now.values())
                    now = _Report(c)
                if side == 0:
                    now.segment(symbols, low, high, turns, cost, audit)
                for _ in range(copies):
                    now.row(role_, text_)
            if len(out) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)
                out = []
        if now is not None:
            out.append(now.values())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    return ordered.mapInArrow(report, f"conv_id {name}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
