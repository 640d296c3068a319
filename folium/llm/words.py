"""Words of a batch of texts as arrays, for the Arrow kernels of this package."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at once (one longer text is a slice of its own).
SLICE = 4 << 20


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `limit` bytes of text, so that a kernel's memory does not grow with the batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    edges = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def release() -> None:
    """Give memory that was freed back to the system, where the C library can; the driver goes on for long after training."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(codes, offsets, words): word k of text i is words[codes[offsets[i] + k]].

    Words are runs without ASCII white space; null texts have none. words holds each distinct word once.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    encoded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    codes, words = encoded.indices.to_numpy(), encoded.dictionary.to_pylist()
    if "" in words:  # white space at a text's edges leaves empty words
        full = codes != words.index("")
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        codes = codes[full]
    return codes, offsets, words


def filter_rows(docs: DataFrame, column: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """docs with the rows that `keep` marks, given the texts of `column`; only that column goes to Python, and nothing is shuffled."""

    def kernel(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            parts = slices(pa.RecordBatch.from_arrays([batch], names=["text"]), 0)
            yield pa.array(np.concatenate([np.zeros(0, np.bool_), *[keep(part.column(0)) for part in parts]]), pa.bool_())

    kernel.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.filter(F.arrow_udf(kernel, "boolean")(F.coalesce(docs[column].cast("string"), F.lit(""))))
