"""Exact substring dedup over words, by level-wise doubling.

A window of 50 words is removed if its word sequence also starts in a document with a
smaller doc_id. A window can repeat only if shorter runs inside it do, so lengths go up
from ``START`` by at most doubling, here 13, 25, 50:

* first level: each window notes one run of 13 words inside it, the least by hash, which is
  the same one in each of its copies. So all windows are judged by few distinct runs.
* each further level: every window whose run repeats in another document is extended to
  twice the length (around the run, inside the window); the others are gone for good. The
  loop ends when no window survives, or at the windows themselves: those that start in an
  earlier document too are removed. Longer levels can't add anything, for a word is covered
  by a removed window of 50 words or by none.

Runs are compared by hashes of 62 bits of their words, modulo two primes, and whole windows by
two of them, 124 bits. Documents with the same words throughout (by their sha256)
are settled first: the smallest doc_id of them goes through the levels, of the others every
word goes (if there are 50). So copies never meet in one task. Texts are dealt once, into
buckets by doc_id; each level shuffles what is known about documents to them.

Null, empty and short texts lose nothing. Rows with equal doc_id are compared with smaller
doc_ids, not with each other. A null doc_id is no smaller than any and loses nothing. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, batches_of, broadcast_if_small, buckets_for
from .words import PrimeRuns, flat, in_pieces, split

WINDOW = 50
START = 13


def levels(window: int, start: int) -> list[int]:
    """Two or more lengths up to ``window``, each at most twice the one before, from ``start`` on if that is less."""
    out = [-(-window // 2), window]
    while (half := -(-out[0] // 2)) >= start:
        out.insert(0, half)
    return out


def noted(h: np.ndarray, span: int) -> np.ndarray:
    """For each stretch of ``span`` places, its least one; of equals the first."""
    n = len(h) - span + 1
    view = np.lib.stride_tricks.sliding_window_view(h, span)
    out = np.empty(n, dtype=np.int64)
    for a in range(0, n, 65536):
        out[a : a + 65536] = view[a : a + 65536].argmin(1) + np.arange(a, min(a + 65536, n))
    return out


def noted_of(runs: PrimeRuns, a: int, b: int, window: int, first: int) -> np.ndarray:
    """The noted place of each window of the text with words a to b, counted from a."""
    return noted(runs.of(np.arange(a, b - first + 1), first), window - first + 1)


def _first_level(window: int, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches):
            each, start = split(piece.column("text").to_pylist())
            runs, n = PrimeRuns(flat(each)), np.diff(start)
            values = [runs.of(a + np.unique(noted_of(runs, a, b, window, first)), first) if b - a >= window else np.zeros(0, np.uint64) for a, b in zip(start, start[1:])]
            whole = runs.of(start[:-1], n).view(np.int64)
            kept = [hashlib.sha256(b" ".join(words)).hexdigest() for words in each]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(whole), pa.array(kept), _lists([v.view(np.int64) for v in values], pa.int64())], ["doc_id", "n_words", "print", "kept_sha256", "values"])

    return run


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), kind))


def _next_level(window: int, first: int, before: int, length: int):
    """Windows whose run of ``before`` words repeats (``hits``), with their runs of ``length`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, limit=1 << 20):
            each, start = split(piece.column("text").to_pylist())
            word, n = flat(each), np.diff(start)
            runs, second = PrimeRuns(word), PrimeRuns(word, 1) if length == window else None
            prints = runs.of(start[:-1], n).view(np.int64)
            known, hits = piece.column("print").to_numpy(), piece.column("hits")
            places, values, others = [], [], []
            for k, (a, b) in enumerate(zip(start, start[1:])):
                at = np.zeros(0, np.int64)
                if b - a >= window and prints[k] == known[k]:
                    place = noted_of(runs, a, b, window, first)
                    # the run of a level begins where the noted one does, or ends with the window
                    of = lambda s, size: a + np.minimum(place[s], s + window - size)  # noqa: E731, B023
                    s = np.arange(len(place))
                    at = np.flatnonzero(np.isin(runs.of(of(s, before), before).view(np.int64), hits[k].values.to_numpy()))
                    value = runs.of(of(at, length), length).view(np.int64)
                else:
                    value = at
                if length < window:
                    value, at = np.unique(value), at[:0]
                others.append(second.of(a + at, window).view(np.int64) if second else at)
                places.append(at)
                values.append(value)
            lists = [_lists(places, pa.int32()), _lists(values, pa.int64()), _lists(others, pa.int64())]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("print"), *lists], ["doc_id", "print", "places", "values", "others"])

    return run


def _ranges(window: int):
    """Places of removed windows to ranges of removed words, two numbers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places in batch.column("places"):
                p = np.sort(places.values.to_numpy())
                cut = np.flatnonzero(np.diff(p) > window)
                out.append(np.stack((p[np.concatenate(([0], cut + 1))], p[np.concatenate((cut, [len(p) - 1]))] + window), 1).ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "print", "ranges"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in in_pieces(batches):
        each, start = split(piece.column("text").to_pylist())
        prints = PrimeRuns(flat(each)).of(start[:-1], np.diff(start)).view(np.int64)
        rows = []
        for k, (words, ranges) in enumerate(zip(each, piece.column("ranges"))):
            if prints[k] != piece.column("print")[k].as_py():
                continue  # another text under the same doc_id
            r = ranges.values.to_numpy()
            keep, last = [], 0
            for a, b in zip(r[::2], r[1::2]):
                keep += words[last:a]
                last = b
            keep += words[last:]
            rows.append((piece.column("doc_id")[k].as_py(), int(prints[k]), len(words) - len(keep), b" ".join(keep)))
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int64()), (3, pa.binary()))], ["doc_id", "print", "n_removed", "kept"])


class SubstringDedup:
    def __init__(self, docs: DataFrame, window: int = WINDOW, start: int = START):
        self.spark, self.window, self.levels = docs.sparkSession, window, levels(window, start)
        batches_of(self.spark)
        self.space = Workspace(self.spark, "substrings")
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
        self.docs = self.space.keep_dealt(docs, "docs", "doc_id", buckets_for(docs, "text"))

    def _with_text(self, known: DataFrame) -> DataFrame:
        return self.docs.join(known.hint("shuffle_hash"), "doc_id")

    def known(self) -> DataFrame:
        """One row a document: n_words, print, kept_sha256 of all its words, and ``first``, the smallest doc_id with its words."""
        if not hasattr(self, "_known"):
            level = self.space.keep(self.docs.mapInArrow(_first_level(self.window, self.levels[0]), "doc_id long, n_words long, print long, kept_sha256 string, values array<long>"), "noted")
            repeated = level.where("n_words > 0").groupBy("kept_sha256").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
            repeated = self.space.keep(repeated, "repeated")
            self._known = level.join(broadcast_if_small(repeated, 3 * repeated.count()), "kept_sha256", "left").withColumn("first", F.coalesce("first", "doc_id"))
        return self._known

    def _hits(self, rows: DataFrame, length: int) -> DataFrame:
        """(doc_id, print, hits): of ``rows`` (doc_id, print, value) the values that another document has too."""
        rows = self.space.keep(rows, f"values-{length}")
        twice = rows.groupBy("value").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("value")
        # written, so that the join has shuffles of its own, which Spark splits where a value is in very many documents
        twice = self.space.keep(twice, f"twice-{length}")
        hits = rows.join(twice, "value", "left_semi").groupBy("doc_id", "print").agg(F.collect_list("value").alias("hits"))
        return self.space.keep(hits, f"hits-{length}")

    def removed(self) -> DataFrame:
        """(doc_id, print, ranges) of the documents that are not whole copies and lose words; ranges of word places."""
        space, w = self.space, self.window
        rows = self.known().where(f"n_words >= {w} AND doc_id = first").select("doc_id", "print", F.explode("values").alias("value")).distinct()
        for before, length in zip(self.levels, self.levels[1:]):
            hits = self._hits(rows, before)
            full = self._with_text(hits).select("doc_id", "text", "print", "hits").mapInArrow(_next_level(w, self.levels[0], before, length), "doc_id long, print long, places array<int>, values array<long>, others array<long>")
            full = space.keep(full.where(F.size("values") > 0), f"level-{length}")
            space.drop(f"values-{before}")
            rows = full.select("doc_id", "print", F.explode("values").alias("value"))
            if full.isEmpty():
                break
        rows = full.select("doc_id", "print", F.explode(F.arrays_zip("places", "values", "others")).alias("x")).select("doc_id", "print", F.col("x.places").alias("place"), F.col("x.values").alias("value"), F.col("x.others").alias("other"))
        first = space.keep(rows.groupBy("value", "other").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("value", "other", "a"), "first")
        late = rows.join(first, ["value", "other"]).where("doc_id > a").groupBy("doc_id", "print").agg(F.collect_list("place").alias("places"))
        return space.keep(late.mapInArrow(_ranges(w), "doc_id long, print long, ranges array<int>"), "ranges")

    def result(self) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256 for each row."""
        ranges = self.removed()
        cut = self._with_text(ranges).select("doc_id", "text", "print", "ranges").mapInArrow(_cut, "doc_id long, print long, n_removed long, kept binary")
        cut = self.space.keep(cut.select("doc_id", "print", "n_removed", F.sha2("kept", 256).alias("cut_sha256")).distinct(), "cut")
        copy = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= self.window)
        rows = self.known().drop("halves").join(cut, ["doc_id", "print"], "left")
        return rows.select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("cut_sha256", "kept_sha256")).alias("kept_sha256"),
        )


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    return SubstringDedup(docs, window).result()
