"""Encoding of texts with a public byte-level BPE vocabulary (problem 6).

Method: contiguous rank array. A word's part boundaries and the ranks of adjacent part pairs lie in two parallel
arrays; the minimum is searched by scan, its boundary deleted, and the two neighbouring ranks refreshed. Words
longer than ``LONG`` bytes use a heap over linked boundaries instead, since a scan per merge is quadratic.
Encoded words are remembered per worker.

Defined results: null and empty texts give the empty list; special-token strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LONG = 256
REMEMBERED = 400_000
BIG = 1 << 60


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Encoder:
    """One vocabulary: ``rank`` by byte string."""

    def __init__(self, path: str, pattern: str | None = None):
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.words = regex.compile(pattern or split_pattern())
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one word."""
        whole = self.rank.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) > LONG:
            return self._long(piece)
        rank = self.rank
        start = list(range(len(piece) + 1))
        pair = [rank.get(piece[i : i + 2], BIG) for i in range(len(piece) - 1)]
        while pair:
            low = min(pair)
            if low == BIG:
                break
            i = pair.index(low)
            del start[i + 1], pair[i]
            if i < len(pair):
                pair[i] = rank.get(piece[start[i] : start[i + 2]], BIG)
            if i:
                pair[i - 1] = rank.get(piece[start[i - 1] : start[i + 1]], BIG)
        return tuple(rank[piece[a:b]] for a, b in zip(start, start[1:]))

    def _long(self, piece: bytes) -> tuple[int, ...]:
        rank, n = self.rank, len(piece)
        nxt, prv, alive = list(range(1, n + 2)), list(range(-1, n)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or nxt[i] >= n or nxt[nxt[i]] != end:
                continue  # one of the two parts has changed since
            j = nxt[i]
            alive[j] = False
            nxt[i] = end
            if end < n:
                prv[end] = i
                if (r := rank.get(piece[i : nxt[end]])) is not None:
                    heapq.heappush(heap, (r, i, nxt[end]))
            if (p := prv[i]) >= 0 and (r := rank.get(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : nxt[i]]])
            i = nxt[i]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known, add = self.known, out.extend
        for w in self.words.findall(text):
            ids = known.get(w)
            if ids is None:
                ids = self.word(w.encode("utf-8", "replace"))
                if len(w) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[w] = ids
            add(ids)
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


_ENCODERS: dict[tuple[str, str | None], Encoder] = {}


def encoder(path: str, pattern: str | None = None) -> Encoder:
    """The worker's encoder of a vocabulary, made once."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of every row."""
    path = path or vocabulary_path()
    pattern = split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            ids = [enc.encode(t) for t in b.column(1).to_pylist()]
            ends = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = pa.array(np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(ends[-1])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """Columns ``keep`` and the number of tokens of every row."""
    path = path or vocabulary_path()
    pattern = split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            n = pa.array([enc.count(t) for t in b.column(len(keep)).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], names=[*keep, name])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text)).mapInArrow(run, f"{kinds}, `{name}` bigint")
