"""TF-IDF without a table of the documents' terms: each pass counts them in Arrow batches and passes on sums only.

A table (key, term) has a row for every distinct term of every document, many times the texts. Here the documents' words
are written once, one row a key, and every pass makes the terms anew: words and pairs (``pairs``) or the character n-grams
of words (``grams``). A batch's distinct words are looked at once, whatever the number of documents that have them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..plans.runtime import local_view, materialize, ranked
from . import features as FE

SLICE_WORDS = 150_000  # words handled at once
HELD_TERMS = 1_000_000  # terms a task counts before it passes their sums on
HELD_CELLS = 2_000_000  # sums of (label, term) a task holds before it passes them on
DENSE_CELLS = 24_000_000  # cells of the centroids a worker holds; more labels are scored in blocks
PIECE_CELLS = 3_000_000  # products made at once


def runs(text: Column) -> Column:
    """Runs of anything but blanks in the lower-cased text, for ``grams``; ``X.words`` are for ``pairs``."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\S+"), F.lit(0))


def documents(df: DataFrame, of: Callable[[Column], Column], chars: int, key: str = "row_id", text: str = "text", labels: str | None = None) -> DataFrame:
    """(key, words, labels): one row a key with the words of its texts' first ``chars`` characters, each text followed by
    a null, and the numbers in its rows' arrays ``labels``, if any.

    The texts are shuffled once, cut already, with their labels.
    """
    own = F.coalesce(F.col(labels), F.array()) if labels else F.array()
    each = df.select(key, X.truncate(text, chars).alias("t"), own.cast("array<int>").alias("own"))
    per = each.groupBy(key).agg(F.collect_list("t").alias("ts"), *[F.flatten(F.collect_list("own")).alias("labels")] * bool(labels))
    ended = F.transform("ts", lambda t: F.concat(of(t), F.array(F.lit(None).cast("string"))))
    return materialize(per.select(key, F.flatten(ended).alias("words"), *["labels"] * bool(labels)), "document-words")


# terms of a batch -------------------------------------------------------------------------------------------------------
def _spread(start: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of the given starts and widths: the number of each element's range, and the element."""
    src = np.repeat(np.arange(len(width)), width)
    return src, np.arange(len(src)) - np.repeat(np.cumsum(width) - width, width) + start[src]


def pairs(distinct: list[str], word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(document, term) of every occurrence of a word or of two neighbouring words, and the terms."""
    n = len(distinct)
    one = np.flatnonzero(word >= 0)
    at = np.flatnonzero((word[:-1] >= 0) & (word[1:] >= 0))  # a null stands between two texts
    two, second = np.unique(word[at] * n + word[at + 1], return_inverse=True)
    named = [f"{distinct[a]} {distinct[b]}" for a, b in zip((two // max(1, n)).tolist(), (two % max(1, n)).tolist())]
    return np.concatenate((doc[one], doc[at])), np.concatenate((word[one], second + n)), distinct + named


def _expand(distinct: list[str], least: int = 3, most: int = 5) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The n-grams of each blank-padded word: (number a word, n-grams word by word, their strings)."""
    text = "".join([f" {w} " for w in distinct])
    char = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    there = np.zeros(0x110000, np.int64)
    there[char] = 1
    base = int(there.sum()) + 1
    if base**most >= 1 << 63:  # codes don't fit: fewer words at a time, or one by one
        if len(distinct) > 1:
            parts = [_expand(distinct[: len(distinct) // 2]), _expand(distinct[len(distinct) // 2 :])]
        else:
            own = [text[a : a + n] for n in range(least, most + 1) for a in range(len(text) - n + 1)]
            parts = [(np.array([len(own)]), np.arange(len(own)), own)]
        known: dict[str, int] = {}
        ids = [np.array([known.setdefault(s, len(known)) for s in names], np.int64)[g] for _, g, names in parts]
        return np.concatenate([p[0] for p in parts]), np.concatenate(ids), list(known)
    c = np.cumsum(there)[char]
    size = np.array([len(w) + 2 for w in distinct], np.int64)
    begin = np.cumsum(size) - size
    word = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(char)) - begin[word]
    counts = np.stack([np.maximum(0, size - n + 1) for n in range(least, most + 1)])
    width = counts.sum(axis=0)
    start, before = np.cumsum(width) - width, np.cumsum(counts, axis=0) - counts
    code, place, at = np.zeros(int(width.sum()), np.int64), np.zeros(int(width.sum()), np.int64), np.arange(len(char))
    so_far = np.zeros(len(char), np.int64)
    for n in range(1, most + 1):
        at = at[inside[at] + n <= size[word[at]]]
        so_far[at] = so_far[at] * base + c[at + n - 1]
        if n >= least:
            dest = start[word[at]] + before[n - least][word[at]] + inside[at]
            code[dest], place[dest] = so_far[at], at * 8 + n
    _, first, ids = np.unique(code, return_index=True, return_inverse=True)
    p = place[first]
    return width, ids, [text[a : a + n] for a, n in zip((p >> 3).tolist(), (p & 7).tolist())]


def grams(distinct: list[str], word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(document, term) of every occurrence of an n-gram of a word, and the terms."""
    width, ids, named = _expand(distinct)
    ok = word >= 0
    word, doc = word[ok], doc[ok]
    src, idx = _spread((np.cumsum(width) - width)[word], width[word])
    return doc[src], ids[idx], named


def _slices(col: pa.ListArray) -> Iterator[tuple[int, pa.ListArray]]:
    """A column of words in pieces of about ``SLICE_WORDS``."""
    ends = col.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE_WORDS, side="right")) - 1)
        yield lo, col.slice(lo, hi - lo)
        lo = hi


def counted(kind: Callable, col: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(document, term, tf) by document and term, and the terms of some documents' words."""
    flat = col.flatten().dictionary_encode()
    word = flat.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy(zero_copy_only=False)))
    doc, term, named = kind(flat.dictionary.to_pylist(), word, doc)
    n = max(1, len(named))
    both = np.sort((doc * n + term).astype(np.int32 if len(col) * n < 1 << 31 else np.int64))
    at = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
    return both[at] // n, both[at] % n, np.diff(np.append(at, len(both))), named


# frequencies ------------------------------------------------------------------------------------------------------------
def _frequencies(kind: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, int] = {}
        sums = np.zeros((2, 1 << 16), np.int64)

        def out() -> pa.RecordBatch:
            cols = [pa.array(list(ids), pa.string()), *(pa.array(s[: len(ids)]) for s in sums)]
            return pa.RecordBatch.from_arrays(cols, names=["term", "df", "cf"])

        for b in batches:
            for _, col in _slices(b.column(0)):
                _, term, tf, named = counted(kind, col)
                at = np.fromiter((ids.setdefault(s, len(ids)) for s in named), np.int64, len(named))
                if len(ids) > sums.shape[1]:
                    sums = np.concatenate((sums, np.zeros((2, max(len(ids), sums.shape[1])), np.int64)), axis=1)
                sums[0, at] += np.bincount(term, minlength=len(named))
                sums[1, at] += np.bincount(term, tf, minlength=len(named)).astype(np.int64)
                if len(ids) > HELD_TERMS:
                    yield out()
                    ids, sums = {}, np.zeros((2, 1 << 16), np.int64)
        yield out()

    return run


def fit(docs: DataFrame, kind: Callable, n_docs: int, min_df: int = 3, max_features: int = 300_000) -> DataFrame:
    """Term table (term, df, idf, number) as ``features.fit`` has it, numbered from 1; ``max_features`` bounds what later passes hold of it."""
    part = docs.select("words").mapInArrow(_frequencies(kind), "term string, df bigint, cf bigint")
    per = part.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return materialize(ranked(FE.chosen(per, n_docs, min_df, max_features), [F.col("term")], "number"), "term-table")


# weights ----------------------------------------------------------------------------------------------------------------
_TERMS: dict[str, tuple[dict[str, int], np.ndarray]] = {}
_MEANS: dict[tuple[str, int, int], np.ndarray] = {}


def _parts(path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    import pyarrow.dataset as ds

    fs, p = local_view(path)
    return ds.dataset(p, filesystem=fs, format="parquet", partitioning=None).to_batches(columns=columns)


def _table(path: str) -> tuple[dict[str, int], np.ndarray]:
    """(term -> place, idf by place) of a term table, once a worker."""
    if path not in _TERMS:
        _TERMS.clear()
        ids, idf = {}, {}
        for b in _parts(path, ["term", "number", "idf"]):
            at = (b.column(1).to_numpy() - 1).tolist()
            ids.update(zip(b.column(0).to_pylist(), at))
            idf.update(zip(at, b.column(2).to_pylist()))
        _TERMS[path] = ids, np.array([idf[i] for i in range(len(idf))])
    return _TERMS[path]


def _dense(path: str, first: int, norms: np.ndarray, n_terms: int) -> np.ndarray:
    """Centroids of the labels from ``first`` on, as many as ``norms``, by place of the term; once a worker."""
    at = path, first, len(norms)
    if at not in _MEANS:
        _MEANS.clear()
        cents = np.zeros((n_terms, len(norms)))
        for b in _parts(path, ["cell", "m"]):
            label, term = np.divmod(b.column(0).to_numpy(), max(1, n_terms))
            own = (label >= first) & (label < first + len(norms))
            cents[term[own], label[own] - first] = b.column(1).to_numpy()[own] / norms[label[own] - first]
        _MEANS[at] = cents
    return _MEANS[at]


def _weighed(kind: Callable, col: pa.ListArray, ids: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term number, w) of some documents' words: (1 + ln tf) * idf, L2-normalised a document."""
    doc, term, tf, named = counted(kind, col)
    number = np.fromiter((ids.get(s, -1) for s in named), np.int64, len(named))[term]
    ok = number >= 0
    doc, number, x = doc[ok], number[ok], (1.0 + np.log(tf[ok])) * idf[number[ok]]
    norm = np.maximum(np.sqrt(np.bincount(doc, x * x, minlength=len(col))), 1e-9)
    return doc, number, x / norm[doc]


def summed(docs: DataFrame, kind: Callable, terms: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, n_terms, w): number and sum of the weights of each document that has any."""
    path = terms._tessera_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, idf = _table(path)
        for b in batches:
            for lo, col in _slices(b.column(1)):
                doc, _, w = _weighed(kind, col, ids, idf)
                n = np.bincount(doc, minlength=len(col))
                has = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + has)), pa.array(n[has]), pa.array(np.bincount(doc, w, minlength=len(col))[has])], names=[key, "n_terms", "w"])

    return docs.select(key, "words").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_terms bigint, w double")


class Centroids:
    """Means of the labels' documents and their lengths, from one pass over ``documents`` with labels.

    ``means(cell, m)``: a cell is a label's number times the terms plus the term's number less 1. ``norms`` has one
    number a label, 0 for a label without documents.
    """

    def __init__(self, docs: DataFrame, kind: Callable, terms: DataFrame, n_labels: int, key: str = "row_id"):
        self.docs, self.kind, self.terms, self.key, self.n_terms = docs, kind, terms, key, terms.count()
        n = docs.select(F.explode("labels").alias("label_id")).groupBy("label_id").agg(F.count("*").alias("n"))
        n = docs.sparkSession.createDataFrame([(r.label_id, r.n) for r in n.collect()], "label_id int, n bigint")  # one row a label
        own = F.when(F.col(key).isNotNull(), F.col("labels")).otherwise(F.array().cast("array<int>")).alias("labels")
        some = docs.filter(F.size("labels") > 0).select("words", own)
        s = some.mapInArrow(_cells(kind, terms._tessera_path, self.n_terms), "cell bigint, s double").groupBy("cell").agg(F.sum("s").alias("s"))
        label = F.floor(F.col("cell") / F.lit(max(1, self.n_terms))).cast("int").alias("label_id")
        self.means = materialize(s.withColumn("label_id", label).join(F.broadcast(n), "label_id").select("cell", "label_id", (F.col("s") / F.col("n")).alias("m")), "means")
        norms = {r.label_id: r.q for r in self.means.groupBy("label_id").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("q")).collect()}
        self.norms = np.array([max(norms.get(i, 0.0), 1e-9) for i in range(n_labels)])

    def table(self) -> DataFrame:
        """(label_id, term, c)."""
        norms = self.docs.sparkSession.createDataFrame(list(enumerate(self.norms.tolist())), "label_id int, norm double")
        at = self.means.withColumn("number", F.col("cell") - F.col("label_id").cast("bigint") * self.n_terms + 1)
        at = at.join(F.broadcast(norms), "label_id").select("label_id", "number", (F.col("m") / F.col("norm")).alias("c"))
        return at.join(F.broadcast(self.terms.select("number", "term")), "number").select("label_id", "term", "c")

    def scores(self) -> DataFrame:
        """(key, label_id, score): dot product over common terms, for every document and label that have any.

        A worker holds the centroids of a block of labels, term by term; any number of labels is scored, in as many blocks as they need.
        """
        size, key, out = max(1, DENSE_CELLS // max(1, self.n_terms)), self.key, None
        for first in range(0, max(1, len(self.norms)), size):
            run = _scored(self.kind, self.terms._tessera_path, self.means._tessera_path, first, self.norms[first : first + size], key)
            one = self.docs.select(key, "words").mapInArrow(run, f"{key} {self.docs.schema[key].dataType.simpleString()}, label_id int, score double")
            out = one if out is None else out.unionByName(one)
        return out


def _cells(kind: Callable, path: str, n_terms: int):
    """Sums of the weights of each (label, term) in parts: documents' words and labels to (cell, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, idf = _table(path)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            cell, s = (np.concatenate(x) for x in zip(*held))
            cell, at = np.unique(cell, return_inverse=True)
            return cell, np.bincount(at, s, minlength=len(cell))

        for b in batches:
            for lo, col in _slices(b.column(0)):
                doc, number, w = _weighed(kind, col, ids, idf)
                mine = b.column(1).slice(lo, len(col))
                label, ends = mine.flatten().to_numpy(zero_copy_only=False).astype(np.int64), mine.offsets.to_numpy().astype(np.int64)
                src, idx = _spread((ends[:-1] - ends[0])[doc], np.diff(ends)[doc])
                held.append((label[idx] * n_terms + number[src], w[src]))
                if sum(len(c) for c, _ in held) > HELD_CELLS:
                    held = [merged()]
                    if len(held[0][0]) > HELD_CELLS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["cell", "s"])
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["cell", "s"])

    return run


def _scored(kind: Callable, path: str, means: str, first: int, norms: np.ndarray, key: str):
    """Documents' keys and words to (key, label_id, score) for the labels from ``first`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, idf = _table(path)
        cents, most = _dense(means, first, norms, len(ids)), max(1, PIECE_CELLS // max(1, len(norms)))
        for b in batches:
            for lo, col in _slices(b.column(1)):
                doc, number, w = _weighed(kind, col, ids, idf)
                has, begin = np.unique(doc, return_index=True)
                ends = np.append(begin, len(doc))
                for k, stop in _pieces(ends, most):
                    a, z = ends[k], ends[stop]
                    score = np.add.reduceat(cents[number[a:z]] * w[a:z, None], ends[k:stop] - a, axis=0)
                    row, label = np.nonzero(score)  # all weights are above 0
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + has[k:stop][row])), pa.array((first + label).astype(np.int32)), pa.array(score[row, label])], names=[key, "label_id", "score"])

    return run


def _pieces(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` entries."""
    lo, n = 0, len(ends) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1))
        yield lo, hi
        lo = hi
