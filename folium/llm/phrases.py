"""Phrases of two and three words by level-wise passes (Apriori), scored at their weakest cut.

1. A level's candidates are words, or the k-grams both of whose (k-1)-grams are frequent. A pass counts them by hash alone:
   a task hands over sorted 32-bit hashes with saturated counts, packed by bucket, five bytes a distinct gram. Hashes that
   reach `least` hold every frequent gram and few others, as grams that share a hash only add up.
2. The next pass counts the grams of those hashes as they are, which gives the level exactly, and at the same time hashes
   the candidates of the next level. Exact counts travel packed too: a bucket's phrases in order, compressed.
3. Hashes of frequent grams go to the tasks as a sorted list, up to HASHES of them; beyond, as a bit map of BITS bits, so
   what is sent is bounded however many grams are frequent. Both only let through too many grams, never too few.
4. Cuts take their counts from the level tables by joins; scores are exact (decimals of 38 digits).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.words import slices, split_words
from folium.session import cut

LEAST, TOP, LENGTH, COVER = 10, 2000, 3, 50
#: Frequent hashes that are sent as a list (8 bytes each); beyond, the bits of the map that stands for it.
HASHES, BITS = 1 << 22, 1 << 28
#: What ends a piece. Each becomes the word ".", which no other word can be.
ENDS = "[.,;:!?\\x0A-\\x0D]"
#: Distinct words of a task, and sums it holds before it hands them over; word numbers take 21 bits, so three fit a key.
WORDS, SUMS = 1 << 19, 1 << 19
#: Hashes a task holds before it packs them, and words of the corpus for each bucket.
HELD, BUCKET = 1 << 21, 1 << 22
#: Bytes of text that are split into words at once.
PART = 6 << 20
NUMBER = 21
#: Counts by hash stop here.
MOST = 255


def gram_hash(parts: list[np.ndarray]) -> np.ndarray:
    """A hash of word hashes in order."""
    out = parts[0].copy()
    for x in parts[1:]:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x
    return out ^ (out >> np.uint64(31)) if len(parts) > 1 else out


def short(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket (a power of two many) and 32 bits of a hash."""
    bits = buckets.bit_length() - 1
    low = h & np.uint64(0xFFFFFFFF)
    return low | ((h >> np.uint64(64 - bits)) << np.uint64(32)) if bits else low


class Known:
    """Membership among the short hashes of a level, with no false absence."""

    def __init__(self, buckets: int, hashes: np.ndarray | None, bits: np.ndarray | None = None):
        self.buckets, self.hashes, self.bits = buckets, hashes, bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        found = short(h, self.buckets)
        if self.hashes is None:
            at = found % np.uint64(len(self.bits) * 64)
            return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        if not len(self.hashes):
            return np.zeros(len(found), np.bool_)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        return self.hashes[at] == found


def known(level: DataFrame, buckets: int, most: int = HASHES, bits: int = BITS) -> Known:
    """The short hashes `s` of a level in bounded memory: a list of at most `most`, else a map of `bits` bits."""
    if level.limit(most + 1).count() <= most:
        return Known(buckets, np.unique(level.select("s").toArrow().column("s").to_numpy().view(np.uint64)))
    place = F.pmod(F.col("s"), F.lit(bits))
    words = level.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("word"))
    found = words.toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("at").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return Known(buckets, None, out)


class Slice:
    """The words of one lang in a slice of texts: their numbers, hashes, and where grams of k words begin."""

    def __init__(self, lang: str, texts: pa.Array):
        import xxhash

        self.lang = lang
        self.found, offsets, self.words = split_words(pc.replace_substring_regex(pc.ascii_lower(texts), ENDS, " . "))
        digest = xxhash.xxh64_intdigest
        self.hashes = np.fromiter((digest(f"{lang}\x00{w}") for w in self.words), np.uint64, len(self.words))
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.usable = np.ones(len(self.found), np.bool_) if "." not in self.words else self.found != self.words.index(".")

    def begins(self, k: int) -> np.ndarray:
        n = len(self.found)
        if n < k:
            return np.zeros(0, np.int64)
        ok = self.usable[: n - k + 1] & (self.text[: n - k + 1] == self.text[k - 1 :])
        for j in range(1, k):
            ok &= self.usable[j : n - k + 1 + j]
        return np.nonzero(ok)[0]

    def grams(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the k-grams that begin at `at`."""
        return gram_hash([self.hashes[self.found[at + j]] for j in range(k)])


def merged(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, the keys sorted."""
    key, value = np.concatenate(keys), np.concatenate(sums)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.nonzero(np.append(True, key[1:] != key[:-1]))[0] if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(value, first) if len(first) else value


class Exact:
    """Counts the k-grams of a task that `wanted` holds, as they are; words are numbered per lang as they come."""

    def __init__(self, k: int, wanted: Known):
        self.k, self.wanted, self.buckets = k, wanted, wanted.buckets
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, dict[str, int]] = {}
        self.words: list[str] = []
        self.langs: list[str] = []
        self.hashes: list[np.ndarray] = []
        self.keys: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.sums: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.held = 0

    def _numbered(self, part: Slice, used: np.ndarray) -> np.ndarray:
        """Task-wide numbers of a slice's word codes; only `used` codes get one."""
        have, start = self.numbers.setdefault(part.lang, {}), len(self.words)
        words = [part.words[i] for i in used.tolist()]
        out = [have.setdefault(word, start) for word in words]  # new words all get `start` here
        new = [i for i, number in enumerate(out) if number == start]
        for number, i in enumerate(new, start):
            have[words[i]] = out[i] = number
        self.words += [words[i] for i in new]
        self.langs += [part.lang] * len(new)
        self.hashes.append(part.hashes[used[new]] if new else np.zeros(0, np.uint64))
        table = np.zeros(len(part.words), np.int64)
        table[used] = out
        return table

    def add(self, part: Slice) -> None:
        k, at = self.k, part.begins(self.k)
        at = at[self.wanted.holds(part.grams(at, k))]
        if not len(at):
            return
        codes = [part.found[at + j] for j in range(k)]
        table = self._numbered(part, np.unique(np.concatenate([np.unique(c) for c in codes])))
        key = table[codes[0]]
        for c in codes[1:]:
            key = (key << NUMBER) | table[c]
        keys, sums = np.unique(key, return_counts=True)
        self.keys.append(keys)
        self.sums.append(sums)
        self.held += len(keys)
        if self.held > 2 * SUMS:
            self._merge()

    def _merge(self) -> None:
        keys, sums = merged(self.keys, self.sums)
        self.keys, self.sums, self.held = [keys], [sums], len(keys)

    def full(self) -> bool:
        return self.held > SUMS or len(self.words) > WORDS

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What was counted since the last call: packs of (phrases, counts) by lang and bucket."""
        self._merge()
        keys, sums, k = self.keys[0], self.sums[0], self.k
        langs = np.array(self.langs, object)
        words = pa.array(self.words, pa.string())
        hashes = np.concatenate([*self.hashes, np.zeros(0, np.uint64)])
        numbers = [(keys >> (NUMBER * (k - 1 - j))) & ((1 << NUMBER) - 1) for j in range(k)]
        bucket = (short(gram_hash([hashes[x] for x in numbers]), self.buckets) >> np.uint64(32)).astype(np.int32)
        for lang in self.numbers:
            own = np.nonzero(langs[numbers[0]] == lang)[0] if len(self.numbers) > 1 else np.arange(len(keys))
            own = own[np.argsort(bucket[own], kind="stable")]
            parts = [words.take(pa.array(x[own])) for x in numbers]
            phrases = (pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]).to_pylist()
            names, starts = np.unique(bucket[own], return_index=True)
            packs = [packed(phrases[x:y], sums[own[x:y]]) for x, y in zip(starts, np.append(starts[1:], len(own)))]
            yield _rows(len(names), lang=pa.array([lang] * len(names), pa.string()), bucket=pa.array(names), pack=pa.array(packs, pa.binary()))
        self.clear()


def packed(phrases: list[str], sums: np.ndarray) -> bytes:
    """How many, their counts, and the phrases in order, one a line (no word holds a line end)."""
    order = sorted(range(len(phrases)), key=phrases.__getitem__)
    return zlib.compress(np.append(len(order), sums[order]).astype(np.int64).tobytes() + "\n".join([phrases[i] for i in order]).encode(), 1)


def unpacked(pack: bytes) -> tuple[list[str], np.ndarray]:
    raw = zlib.decompress(pack)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return raw[8 + 8 * n :].decode().split("\n"), np.frombuffer(raw, np.int64, n, 8)


class Hashed:
    """Counts the hashes of a task's words, or of its k-grams whose (k-1)-grams `before` holds; of words also their number by lang."""

    def __init__(self, k: int, before: Known | None, buckets: int):
        self.k, self.before, self.buckets = k, before, buckets
        self.clear()

    def clear(self) -> None:
        self.keys: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.sums: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.totals: dict[str, int] = {}
        self.held = 0

    def add(self, part: Slice) -> None:
        k, at = self.k, part.begins(self.k)
        if not len(at):
            return
        if k == 1:
            self.totals[part.lang] = self.totals.get(part.lang, 0) + len(at)
        elif k == 2:  # once a word
            frequent = self.before.holds(part.hashes)
            at = at[frequent[part.found[at]] & frequent[part.found[at + 1]]]
        else:
            at = at[self.before.holds(part.grams(at, k - 1))]
            at = at[self.before.holds(part.grams(at + 1, k - 1))]
        keys, sums = np.unique(short(part.grams(at, k), self.buckets), return_counts=True)
        self.keys.append(keys)
        self.sums.append(np.minimum(sums, MOST))
        self.held += len(keys)
        if self.held > HELD:
            keys, sums = merged(self.keys, self.sums)
            self.keys, self.sums, self.held = [keys], [np.minimum(sums, MOST)], len(keys)

    def full(self) -> bool:
        return self.held > HELD // 2

    def rows(self) -> Iterator[pa.RecordBatch]:
        keys, sums = merged(self.keys, self.sums)
        sums, bucket = np.minimum(sums, MOST).astype(np.uint8), (keys >> np.uint64(32)).astype(np.int32)
        names, starts = np.unique(bucket, return_index=True)
        ends = np.append(starts[1:], len(keys))
        lows = keys.astype(np.uint32)
        packs = [lows[a:b].tobytes() + sums[a:b].tobytes() for a, b in zip(starts, ends)]
        yield _rows(len(names), bucket=pa.array(names), pack=pa.array(packs, pa.binary()))
        yield _rows(len(self.totals), lang=pa.array(list(self.totals), pa.string()), n=pa.array(list(self.totals.values()), pa.int64()))
        self.clear()


_KINDS = {"lang": pa.string(), "n": pa.int64(), "bucket": pa.int32(), "pack": pa.binary()}
_SCHEMA = "lang string, n long, bucket int, pack binary"


def _rows(count: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(count, kind)) for name, kind in _KINDS.items()], names=list(_KINDS))


def swept(texts: DataFrame, exact: tuple[int, Known] | None, hashed: tuple[int, Known | None, int] | None) -> DataFrame:
    """One pass, written: packs of exact counts (lang, bucket, pack), of hashes (bucket, pack), and numbers of words (lang, n)."""
    sent = texts.sparkSession.sparkContext.broadcast((exact, hashed))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, hashed = sent.value
        counters = [*([Exact(*exact)] if exact else []), *([Hashed(*hashed)] if hashed else [])]
        for batch in batches:
            for part in slices(batch, limit=PART):
                codes = part.column(0).dictionary_encode()
                for c, lang in enumerate(codes.dictionary.to_pylist()):
                    own = Slice(lang, part.column(1).filter(pc.equal(codes.indices, c)) if len(codes.dictionary) > 1 else part.column(1))
                    for counter in counters:
                        counter.add(own)
                for counter in counters:
                    if counter.full():
                        yield from counter.rows()
        for counter in counters:
            yield from counter.rows()

    return cut(texts.mapInArrow(kernel, _SCHEMA), "sweep")


def summed(rows: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f): exact counts of all tasks that reach `least`. A group holds some BUCKET phrases at most."""

    def total(table: pa.Table) -> pa.Table:
        parts = [unpacked(pack) for pack in table.column("pack").to_pylist()]
        every = pa.table({"phrase": pa.chunked_array([pa.array(p, pa.string()) for p, _ in parts]), "f": np.concatenate([f for _, f in parts])})
        sums = every.group_by("phrase").aggregate([("f", "sum")])
        kept = sums.filter(pc.greater_equal(sums.column("f_sum"), least))
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * kept.num_rows, pa.string()), "phrase": kept.column("phrase"), "f": kept.column("f_sum")})

    return rows.filter(F.col("lang").isNotNull() & F.col("pack").isNotNull()).select("lang", "bucket", "pack").groupBy("lang", "bucket").applyInArrow(total, "lang string, phrase string, f long")


def frequent_hashes(rows: DataFrame, least: int) -> DataFrame:
    """s: the short hashes whose counts reach `least`; a bucket holds some BUCKET hashes at most."""

    def reached(table: pa.Table) -> pa.Table:
        keys, sums = [], []
        for pack in table.column("pack").to_pylist():
            n = len(pack) // 5
            keys.append(np.frombuffer(pack, np.uint32, n))
            sums.append(np.frombuffer(pack, np.uint8, n, 4 * n).astype(np.int64))
        key, total = merged(keys, sums)
        kept = key[total >= min(least, MOST)].astype(np.int64)
        return pa.table({"s": pa.array(kept | (table.column("bucket")[0].as_py() << 32))})

    return rows.filter(F.col("lang").isNull()).select("bucket", "pack").groupBy("bucket").applyInArrow(reached, "s long")


def levels(docs: DataFrame, least: int = LEAST, length: int = LENGTH, text: str = "text", lang: str = "lang", most: int = HASHES, bits: int = BITS) -> tuple[DataFrame, list[DataFrame]]:
    """(totals, levels): words of each lang (lang, n), and the frequent k-grams (lang, phrase, f) for k = 1..length."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # buckets by the size of the table: a bucket takes the hashes of some 4 bytes a word and BUCKET words
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << (size // 4 // BUCKET).bit_length()
    rows = swept(texts, None, (1, None, buckets))
    totals = rows.filter(F.col("n").isNotNull()).groupBy("lang").agg(F.sum("n").alias("n"))
    found = []
    for k in range(1, length + 1):
        held = known(cut(frequent_hashes(rows, least), "hashes"), buckets, most, bits)
        rows = swept(texts, (k, held), (k + 1, held, buckets) if k < length else None)
        found.append(cut(summed(rows, least), "level"))
    return totals, found


def scored(level: DataFrame, k: int, found: list[DataFrame]) -> DataFrame:
    """The k-grams of `level` with l, r and score of the cut that scores lowest, ties to the first."""
    out = level.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    for j in range(1, k):
        left = found[j - 1].select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias(f"l{j}"))
        right = found[k - j - 1].select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias(f"r{j}"))
        out = out.join(left, (F.col("lang") == F.col("_lang")) & (F.array_join(F.slice("w", 1, j), " ") == F.col("_part"))).drop("_lang", "_part")
        out = out.join(right, (F.col("lang") == F.col("_lang")) & (F.array_join(F.slice("w", j + 1, k - j), " ") == F.col("_part"))).drop("_lang", "_part")
    whole = lambda x: F.col(x).cast("decimal(14,0)")
    score = lambda j: F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (whole("a") * whole("a")), whole(f"l{j}") * whole(f"r{j}")).cast("long")
    cuts = F.array_min(F.array(*[F.struct(score(j).alias("score"), F.lit(j).alias("cut"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")) for j in range(1, k)]))
    return out.select("lang", "phrase", "a", cuts.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, length: int = LENGTH, cover: int = COVER, text: str = "text", lang: str = "lang", most: int = HASHES, bits: int = BITS) -> DataFrame:
    """Each lang's first `top` phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut into pieces at .,;:!? and line ends, pieces into words at spaces and tabs. A null text
    counts as empty, a null lang as `und`. Phrases have 2 to `length` words (at most 3: their keys fit 63 bits)
    and `least` occurrences; one that a longer phrase of at least `cover` percent of its occurrences holds is left
    out. Repeated rows count as often as they occur; other columns are not read; an empty table gives an empty result.
    """
    if not 2 <= length <= 3:
        raise ValueError("phrases have two or three words")
    totals, found = levels(docs, least, length, text, lang, most, bits)
    kept = []
    for k in range(2, length + 1):
        mine = scored(found[k - 1], k, found)
        if k < length:
            w = F.split("phrase", " ")
            inner = F.explode(F.array_distinct(F.array(*[F.array_join(F.slice(w, i, k), " ") for i in range(1, length - k + 2)])))
            longer = found[length - 1].select("lang", inner.alias("part"), "f").groupBy(F.col("lang").alias("_lang"), F.col("part").alias("_part")).agg(F.max("f").alias("_most"))
            same = (mine["lang"] == longer["_lang"]) & (mine["phrase"] == longer["_part"]) & (longer["_most"] * 100 >= mine["a"] * cover)
            mine = mine.join(longer, same, "left_anti")
        kept.append(mine)
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.join(totals.withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
