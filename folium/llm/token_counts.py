"""Token counts by distinct pre-tokens.

Byte-level BPE splits a text into pre-tokens first and never merges across them, so a text's token count is the
sum over its distinct pre-tokens of frequency times pieces. Each worker keeps the pieces of the pre-tokens it has
met (a bounded table): a pre-token is encoded once, joined to the per-document frequencies and summed. No ids
of whole texts are made, and nothing is shuffled.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

#: The pre-token rule of the "ByteLevel" pre-tokenizer with use_regex (a fixed value of the public format).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens a worker remembers; beyond, the table starts anew.
MEMORY = 400_000
#: Pre-tokens longer than this are not remembered.
LONGEST = 64
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Pieces(dict):
    """pre-token -> number of pieces, encoded on first sight."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.encode = Tokenizer.from_str(spec).encode

    def __missing__(self, word: str) -> int:
        n = len(self.encode(word, add_special_tokens=False).ids)
        if len(word) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def _counter(spec: str):
    import regex

    pieces, find = Pieces(spec), regex.compile(PRETOKEN).findall
    added = [x["content"] for x in json.loads(spec).get("added_tokens", [])]
    special = regex.compile("|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None

    def count(text: str) -> int:
        parts, total = [text], 0
        if special is not None and any(x in text for x in added):
            parts = special.split(text)
            total = len(parts) - 1  # each special string is one token
        for part in parts:
            total += sum([n * pieces[word] for word, n in Counter(find(part)).items()])
        return total

    return count


def supported(spec: str) -> bool:
    """Whether the file's rules are those that counting by pre-token relies on."""
    rules = json.loads(spec)
    pre = rules.get("pre_tokenizer") or {}
    plain = all(not (x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized")) for x in rules.get("added_tokens", []))
    return rules["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not rules.get("normalizer") and plain


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    tokenizer: path of a tokenizers .json with a byte-level BPE; its text is sent with the task (some MB, the
    size of a vocabulary file), so executors need no such path. Null texts count as empty: 0 bytes, 0 tokens.
    Repeated rows give repeated results; other columns are not read; an empty table gives an empty result.
    """
    spec = Path(tokenizer).read_text(encoding="utf-8")
    if not supported(spec):
        raise ValueError("only byte-level BPE files without normaliser or prefix space can be counted by pre-token")
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(shared.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            tokens = [count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode("utf-8", "replace")) for x in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([x > limit for x in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(kernel, SCHEMA)
