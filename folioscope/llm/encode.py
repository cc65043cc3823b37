"""Problem 7: the whole corpus as ids of a public byte-level BPE vocabulary.

Texts are cut where a rolling hash of the last ``WINDOW`` characters hits a pattern, so equal passages give equal chunks
wherever they stand, and a chunk is encoded once and kept in a bounded cache of the Python worker. What is kept of a
chunk is its core: from its first to its last sync point, a place where a piece of the splitting pattern begins whatever
stands around it (a single space between two letters). A join of chunks is repaired by re-encoding from the last sync
point before it to the first one after it, over as many chunks as that takes; there the re-encoded ids agree exactly with
those of the next core. The stage is narrow: no shuffle, no state by document.

Defined results: null and empty texts give the empty list; strings of special tokens in a text are ordinary text. There is
one row a doc_id: documents repeat texts, not ids; rows without doc_id are kept under null.
"""

from __future__ import annotations

import base64
import os
import re
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files lie; every function takes another place as a parameter.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the splitting pattern of this public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters under the rolling hash, mean distance of hits (a power of two) and least length of a chunk.
WINDOW, EVERY, LEAST = 16, 512, 128
#: Bound of the cache of one Python worker, in characters of the chunks that it holds.
CACHE_CHARS = 4_000_000

_sync = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


def cuts(text: str) -> list[int]:
    """The ends of the text's chunks, the last at its end."""
    n = len(text)
    if n <= 2 * LEAST:
        return [n]
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) * np.uint32(0x9E3779B1)
    width, base = 1, 0x01000193
    while width < WINDOW:  # by doubling: the hash of 2w characters from two of w
        h = h[:-width] * np.uint32(base) + h[width:]
        width, base = width * 2, base * base % 2**32
    h ^= h >> np.uint32(15)
    hits = np.flatnonzero((h & np.uint32(EVERY - 1)) == 0) + WINDOW
    out, last = [], 0
    for p in hits.tolist():
        if p - last >= LEAST and n - p >= LEAST:
            out.append(p)
            last = p
    return [*out, n]


class ChunkEncoder:
    """Encodes texts by content-defined chunks with one vocabulary; one object a Python worker."""

    def __init__(self, folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
        import tiktoken

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.codec = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: OrderedDict[str, tuple[int, int, np.ndarray]] = OrderedDict()
        self.held = self.reused = self.encoded = 0

    def plain(self, text: str) -> np.ndarray:
        return self.codec.encode_to_numpy(text, disallowed_special=()).astype(np.int32, copy=False)

    def core(self, chunk: str) -> tuple[int, int, np.ndarray]:
        """(first sync point, last one, the ids between them) of a chunk; (n, n, none) if it has fewer than two."""
        got = self.cache.get(chunk)
        if got is not None:
            self.cache.move_to_end(chunk)
            self.reused += 1
            return got
        first = _sync.search(chunk)
        a = first.start() if first else len(chunk)
        b = len(chunk)
        while b > a:
            b = chunk.rfind(" ", a, b)
            if b <= a or _sync.match(chunk, b):
                break
        got = (a, b, self.plain(chunk[a:b])) if b > a else (len(chunk), len(chunk), np.empty(0, dtype=np.int32))
        self.encoded += 1
        self.cache[chunk] = got
        self.held += len(chunk)
        while self.held > CACHE_CHARS:
            self.held -= len(self.cache.popitem(last=False)[0])
        return got

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.int32)
        ends = cuts(text)
        if len(ends) == 1:
            return self.plain(text)
        out, begin, open_from = [], 0, 0
        for end in ends:
            a, b, ids = self.core(text[begin:end])
            if b > a:
                out += [self.plain(text[open_from : begin + a]), ids]
                open_from = begin + b
            begin = end
        out.append(self.plain(text[open_from:]))
        return np.concatenate(out)


@lru_cache(2)
def encoder(folder: str, name: str) -> ChunkEncoder:
    return ChunkEncoder(folder, name)


def ids(docs: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, ids) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, name).ids
        for batch in batches:
            parts = [encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(parts) + 1, dtype=np.int32)
            np.cumsum([len(p) for p in parts], out=offsets[1:])
            values = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(docs: DataFrame, *keep: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """The kept columns and n_tokens of every document; texts themselves go no further than the Python worker."""
    kept = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, name).ids
        for batch in batches:
            counts = [len(encode(t)) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_tokens long"
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, out)
