"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed terms over all documents.
2. The benchmark is taken in blocks of about ``PASSAGES`` passages. For each a randomised SVD
   of the TF-IDF passages: tasks multiply their passages with a random matrix and its
   successor, the sums (terms of the block x rank, no passages) give the basis. Directions
   are divided by their singular values (damped), so that rare topics weigh as much as
   common ones; a passage that holds an item then lies near it whatever else it holds.
3. Every document is cut into stretches of 16 words; 32 words (for items of up to 32) and 48
   words (for longer ones, in passages of 48 words), every 16, are projected, and the items
   with a cosine of ``COSINE`` or more are a passage's candidates. Nothing else finds any.
4. Around a candidate (an item's length on either side) the item's words are counted, and
   where there are enough the longest common subsequence with the whole item is taken. A
   document leaks the item if that holds 80% of the item's words, or 60% and the item's
   answer (its last quarter) nearly whole: a paraphrase that keeps the answer.

Items of 5 to 7 words leak where all their words follow one another, shorter ones where they
are the whole document: fewer words in common say nothing. Null items are left out. Null and
empty texts leak nothing. Rows are judged one by one, repeated ones alike; items with one
item_id are items of their own. A benchmark of more than ``TOGETHER`` blocks takes one pass
over the documents for each so many, so what is broadcast is bounded. Empty tables give no
rows, or no leaks. Other columns are ignored (or kept, by ``keep_clean``).
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, batches_of
from .words import U64, Runs, hashes, in_pieces, mix

BITS = 16
TERMS = 1 << BITS
RANK, EXTRA = 192, 16
#: Words of a stretch, and the stretches of a passage: for short items, and for others.
STRETCH, SHORT, FULL = 16, 2, 3
PASSAGES, TOGETHER = 256, 16
COSINE, DAMPING = 0.45, 0.6
LEAST_WORDS, LEAST_RUN = 8, 5
LEAK, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
SEED = 41
#: Lower case; signs are spaces.
PLAIN = bytes(32 if chr(c) in string.punctuation else c + 32 if 65 <= c <= 90 else c for c in range(256))


def term_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text starts."""
    each = [t.translate(PLAIN).split() if t else [] for t in texts]
    start = np.concatenate(([0], np.cumsum([len(w) for w in each], dtype=np.int64)))
    return hashes([w for words in each for w in words]), start


def buckets(word: np.ndarray) -> np.ndarray:
    return (mix(word, 7) >> U64(64 - BITS)).astype(np.int32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: how many of its documents have each term."""
    total, docs = np.zeros(TERMS, np.int64), 0
    for piece in in_pieces(batches):
        word, start = term_words(piece.column("text").to_pylist())
        doc = np.repeat(np.arange(len(start) - 1), np.diff(start))
        pairs = np.sort(doc * TERMS + buckets(word))
        pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))] if len(pairs) else pairs
        total += np.bincount(pairs % TERMS, minlength=TERMS)
        docs += len(start) - 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int64)), pa.array(np.append(total[at], docs))], ["term", "n"])


def idf_of(docs: DataFrame) -> np.ndarray:
    """log((N + 1) / (df + 1)) + 1 of each term; the driver gets 2**16 numbers."""
    rows = docs.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(_frequencies, "term long, n long")
    got = rows.groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df, n = np.zeros(TERMS), float(got.n[got.term == -1].sum())
    at = got.term >= 0
    df[got.term[at]] = got.n[at]
    return np.log((n + 1) / (df + 1)) + 1


def item_passages(words: np.ndarray, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, tf-idf weights) of an item's passages of 48 words, every 24; the last ends with the item."""
    size, out = FULL * STRETCH, []
    last = max(len(words) - size, 0)
    for a in sorted({*range(0, last + 1, size // 2), last}):
        i, n = np.unique(buckets(words[a : a + size]), return_counts=True)
        out.append((i, n * idf[i]))
    return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in in_pieces(batches):
        word, _ = term_words(piece.column("text").to_pylist())
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.unique(buckets(word)), pa.int32())})


def _gram(shared, slab: int):
    """A' (A m) of a task's passages A, in slabs of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, row, m = shared.value
        total = np.zeros(m.shape, np.float64)
        for piece in in_pieces(batches):
            word, start = term_words(piece.column("text").to_pylist())
            for a, b in zip(start, start[1:]):
                if b - a >= LEAST_WORDS:
                    for i, v in item_passages(word[a:b], idf):
                        total[row[i]] += v[:, None] * (v @ m[row[i]])
        for k in range(0, len(m), slab):
            if total[k : k + slab].any():
                yield pa.RecordBatch.from_pydict({"slab": [k], "part": [total[k : k + slab].astype(np.float32).tobytes()]})

    return run


def _add(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(p.as_py(), np.float32) for p in table["part"].combine_chunks()]
    return pa.table({"slab": pa.array([table["slab"][0].as_py()], pa.int64()), "part": [sum(p.astype(np.float64) for p in parts).astype(np.float32).tobytes()]})


def basis(items: DataFrame, idf: np.ndarray, rank: int = RANK, tasks: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors of the items' passages, by randomised SVD, over the damped singular values.

    (the row of each term, rows x rank): only terms of the items have a row of their own,
    the others share the last one, which is zero. There are 2**16 terms at most.
    """
    slab, sc = 2048, items.sparkSession.sparkContext
    spread = items.select(F.col("text").cast("string").cast("binary").alias("text")).repartition(tasks)
    terms = np.sort(spread.mapInArrow(_terms, "term int").distinct().toPandas().term.to_numpy(np.int32))
    row = np.full(TERMS, len(terms), np.int32)
    row[terms] = np.arange(len(terms))
    if not len(terms):
        return row, np.zeros((1, 1), np.float32)
    m = np.random.default_rng(SEED).standard_normal((len(terms), rank + EXTRA), np.float32)
    m = m[:, : len(terms)]
    for step in range(2):
        shared = sc.broadcast((idf, row, m))
        got = spread.mapInArrow(_gram(shared, slab), "slab long, part binary").groupBy("slab").applyInArrow(_add, "slab long, part binary")
        z = np.zeros(m.shape, np.float32)
        for r in got.toLocalIterator():
            z[r["slab"] : r["slab"] + slab] = np.frombuffer(r["part"], np.float32).reshape(-1, z.shape[1])
        shared.destroy()
        if step == 0:
            m = np.linalg.qr(z)[0]
    # m' A'A m is small; its eigenvectors turn m towards the singular vectors
    values, turn = np.linalg.eigh((m.T @ z).astype(np.float64))
    keep = np.argsort(-values)[:rank]
    keep = keep[values[keep] > 1e-6 * max(values.max(), 1e-30)]
    single = np.sqrt(values[keep])
    space = ((m @ turn[:, keep].astype(np.float32)) / np.sqrt(single**2 + (DAMPING * single.mean()) ** 2)).astype(np.float32)
    return row, np.concatenate((space, np.zeros((1, space.shape[1]), np.float32)))


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with a row of bits."""
    places: dict[int, int] = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    row = full = (1 << len(a)) - 1
    for w in b:
        u = row & places.get(w, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


class Block:
    """What tasks need of some benchmark items; its size is bounded by the number of their passages."""

    def __init__(self, ids: list[int], texts: list[bytes], idf: np.ndarray, row: np.ndarray, space: np.ndarray):
        word, start = term_words(texts)
        self.row, self.weights = row, space.copy()
        known = np.flatnonzero(row < len(space) - 1)
        self.weights[row[known]] *= idf[known, None].astype(np.float32)
        self.ids, self.words, of, rows = [], [], [], []
        self.runs: dict[int, dict[int, list[int]]] = {}  # of short items: length, hash, items
        for k, (a, b) in enumerate(zip(start, start[1:])):
            if b - a >= LEAST_WORDS:
                for i, v in item_passages(word[a:b], idf):
                    rows.append(v.astype(np.float32) @ space[row[i]])
                    of.append(len(self.ids))
            elif b > a:
                whole = int(Runs(word[a:b]).of(np.zeros(1, np.int64), int(b - a))[0])
                self.runs.setdefault(int(b - a), {}).setdefault(whole, []).append(len(self.ids))
            else:
                continue
            self.ids.append(ids[k])
            self.words.append(word[a:b])
        self.size = np.array([len(w) for w in self.words], np.int64)
        rows, of = np.array(rows, np.float32).reshape(len(rows), space.shape[1]), np.array(of, np.int64)
        rows /= np.maximum(np.linalg.norm(rows, axis=1), 1e-12)[:, None]
        short = self.size[of] <= SHORT * STRETCH if len(of) else np.zeros(0, bool)
        #: (stretches of a passage, items' passages as columns, their items)
        self.scales = [(n, np.ascontiguousarray(rows[at].T), of[at]) for n, at in ((SHORT, short), (FULL, ~short)) if at.any()]
        # the items' words, numbered, in a table of one row an item
        self.vocabulary = np.unique(word)
        self.table = np.full((len(self.words), int(self.size.max(initial=0))), len(self.vocabulary), np.int32)
        for k, w in enumerate(self.words):
            self.table[k, : len(w)] = np.searchsorted(self.vocabulary, w)

    def search(self, texts: list[bytes | None]) -> list[dict[int, float]]:
        """For each text the items it leaks, with the share of their words."""
        out: list[dict[int, float]] = [{} for _ in texts]
        if not self.ids:
            return out
        word, start = term_words(texts)
        doc, at, item, near = self._candidates(buckets(word), start)
        enough = self._enough(word, start, doc, at, item)
        doc, at, item, near = doc[enough], at[enough], item[enough], near[enough]
        # near passages first: a verbatim copy settles its item before the item's other places
        for k in np.argsort(-near, kind="stable"):
            d, i = int(doc[k]), int(item[k])
            found = out[d]
            if found.get(i, 0.0) < 1.0:
                share = self._verify(self.words[i], word[start[d] : start[d + 1]], int(at[k] - start[d]))
                if share:
                    found[i] = max(share, found.get(i, 0.0))
        self._whole_runs(word, start, out)
        return out

    def _candidates(self, term: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word of a passage, item, cosine) wherever a passage lies near one of the item's."""
        n = -(-np.diff(start) // STRETCH)
        of = np.repeat(np.arange(len(n)), n)
        first = start[of] + STRETCH * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
        last = np.repeat(np.cumsum(n), n)  # stretches of a text end here
        found = []
        step = 2048
        for s in range(0, len(of), step):
            e = min(s + step, len(of))
            y = self._projected(term, first[s : e + FULL - 1], start[of[s : e + FULL - 1] + 1])
            for size, columns, items in self.scales:
                p = y[: e - s].copy()
                for j in range(1, size):
                    more = np.flatnonzero(np.arange(s, e) + j < last[s:e])
                    p[more] += y[more + j]
                p /= np.maximum(np.linalg.norm(p, axis=1), 1e-12)[:, None]
                c = p @ columns
                w, col = np.nonzero(c >= COSINE)
                found.append((of[s + w], first[s + w], items[col], c[w, col]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)

    def _projected(self, term: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The sum of the terms of each stretch in the latent space."""
        at = begin[:, None] + np.arange(STRETCH)
        # words beyond the text, like those of no item, have the last row, which is zero
        row = np.where(at < end[:, None], self.row[term[np.minimum(at, len(term) - 1)]], len(self.weights) - 1)
        y = np.zeros((len(begin), self.weights.shape[1]), np.float32)
        one = np.empty_like(y)
        for k in range(STRETCH):
            np.take(self.weights, row[:, k], axis=0, out=one)
            y += one
        return y

    def _enough(self, word: np.ndarray, start: np.ndarray, doc: np.ndarray, at: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether enough of the item's words are around a candidate for the word rules to hold."""
        out = np.zeros(len(at), bool)
        if not len(at):
            return out
        number = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
        number = np.where(self.vocabulary[number] == word, number, len(self.vocabulary)).astype(np.int32)
        order = np.argsort(at, kind="stable")
        for part in np.split(order, range(256, len(order), 256)):
            places, back = np.unique(at[part], return_inverse=True)
            there = np.zeros((len(places), len(self.vocabulary) + 1), bool)
            reach = np.zeros(len(places), np.int64)
            np.maximum.at(reach, back, self.size[item[part]])
            texts = np.zeros(len(places), np.int64)
            texts[back] = doc[part]
            for k, (p, r, d) in enumerate(zip(places, reach, texts)):
                there[k, number[max(start[d], p - r) : min(start[d + 1], p + FULL * STRETCH + r)]] = True
            there[:, -1] = False
            out[part] = there[back[:, None], self.table[item[part]]].sum(1) >= PARAPHRASE * self.size[item[part]]
        return out

    def _whole_runs(self, word: np.ndarray, start: np.ndarray, out: list[dict[int, float]]) -> None:
        """Items of too few words for the rest: whole runs of words, or whole texts."""
        if not self.runs:
            return
        runs, n = Runs(word), np.diff(start)
        for length, known in self.runs.items():
            at = np.arange(max(0, len(word) - length + 1)) if length >= LEAST_RUN else start[:-1][n == length]
            d = np.searchsorted(start, at, side="right") - 1
            at, d = at[at + length <= start[d + 1]], d[at + length <= start[d + 1]]
            value = runs.of(at, length)
            for k in np.flatnonzero(np.isin(value, np.array(list(known), dtype=U64))):
                for i in known[int(value[k])]:
                    out[int(d[k])][i] = 1.0

    @staticmethod
    def _verify(item: np.ndarray, word: np.ndarray, at: int) -> float:
        n = len(item)
        text, words = word[max(0, at - n) : at + FULL * STRETCH + n].tolist(), item.tolist()
        share = lcs(words, text) / n
        if share >= LEAK:
            return share
        answer = words[-max(3, n // 4) :]
        return share if share >= PARAPHRASE and lcs(answer, text) >= ANSWER * len(answer) else 0.0


def _blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple[list, bool]]:
    """The benchmark as broadcast blocks, up to ``TOGETHER`` at a time, and whether they are the last; the idf is made once."""
    spark = docs.sparkSession
    batches_of(spark)
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    # about one passage for each 24 words
    n, passages = items.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.lit(1), F.ceil(F.size(F.split("text", r"\s+")) / 24) - 1)), F.lit(0))).first()
    if not n:
        return
    idf = idf_of(docs)
    blocks = -(-int(passages) // PASSAGES)
    for first in range(0, blocks, TOGETHER):
        made = []
        for k in range(first, min(first + TOGETHER, blocks)):
            own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
            rows = own.orderBy("item_id", "text").collect()
            if rows:
                row, space = basis(own, idf)
                made.append(spark.sparkContext.broadcast(Block([r.item_id for r in rows], [r.text.encode() for r in rows], idf, row, space)))
        yield made, first + TOGETHER >= blocks


FOUND = "n_items long, best_item long, best_share double"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, best_item, best_share for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), F.lit(0).cast("long").alias("n_items"), F.lit(None).cast("long").alias("best_item"), F.lit(0.0).alias("best_share"))
    space, before = None, None
    for k, (blocks, last) in enumerate(_blocks(docs, benchmark)):
        if before is not None:  # what an earlier pass found, with the texts, is written: its blocks can go
            space = space or Workspace(docs.sparkSession, "leaks")
            rows = space.keep(rows, f"pass-{k}")
            for b in before:
                b.destroy()
            if k > 1:
                space.drop(f"pass-{k - 1}")
        rows, before = rows.mapInArrow(_judge(blocks, last), f"doc_id long, {FOUND}" if last else f"doc_id long, text binary, {FOUND}"), blocks
    return rows.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "best_item", "best_share")


def _judge(blocks: list, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches):
            texts = piece.column("text").to_pylist()
            count, best = piece.column("n_items").to_pylist(), [(s, None if i is None else -i) for s, i in zip(piece.column("best_share").to_pylist(), piece.column("best_item").to_pylist())]
            for block in blocks:
                ids = block.value.ids
                for k, found in enumerate(block.value.search(texts)):
                    count[k] += len(found)
                    best[k] = max([best[k], *((s, -ids[i]) for i, s in found.items())], key=lambda x: (x[0], x[1] is not None, x[1] or 0))
            columns = [pa.array(count, pa.int64()), pa.array([None if i is None else -i for _, i in best], pa.int64()), pa.array([float(s) for s, _ in best])]
            out = pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text"), *columns], ["doc_id", "text", "n_items", "best_item", "best_share"])
            yield out.select(["doc_id", "n_items", "best_item", "best_share"]) if last else out

    return run


def _clean(blocks: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches):
            texts = piece.column("text").cast(pa.binary()).to_pylist()
            leaked = np.zeros(len(texts), bool)
            for block in blocks:
                leaked |= [bool(f) for f in block.value.search(texts)]
            yield piece.filter(pa.array(~leaked))

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    out, space, before = docs, None, None
    for k, (blocks, _) in enumerate(_blocks(docs, benchmark)):
        if before is not None:
            space = space or Workspace(docs.sparkSession, "clean")
            out = space.keep(out, f"pass-{k}")
            for b in before:
                b.destroy()
            if k > 1:
                space.drop(f"pass-{k - 1}")
        out, before = out.mapInArrow(_clean(blocks), docs.schema), blocks
    return out
