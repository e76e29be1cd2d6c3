"""Language identification with n-gram filters whose slots hold one bit a language.

Grams are 2 to 5 letters in a row of the lower-cased words, with the words' ends as signs of
their own. A gram belongs to a language if it has at least a fifth of the frequency there that
it has in the language where it is most frequent; so what is as common everywhere belongs to
all, and a stray foreign line to none.

* Learning: grams are counted by task and language, added up by Spark, and judged; each gram
  that belongs somewhere has a mask with a bit a language. A Bloom filter for each language
  would be a column of bits; here they are sliced: slot i of one table holds bit i of all the
  filters, side by side. A gram's mask is or-ed into three slots.
* Prediction: and-ing a gram's three slots gives all languages that hold it, at once. Bits are
  counted for each language. A filter that is full to a share f says yes to a strange gram with
  p = f ** 3; of n grams with c bits, (c - n p) / (1 - p) are held. The shares of held grams of
  the four orders are averaged; the language with most wins, of ties the one with more
  learning text.

The filters are learnt from all labelled rows that are not held out as long as a language has
up to ``MAX_BYTES`` of text; beyond that from about so many bytes of it, documents being taken
whole by the hash of their doc_id. So the model is bounded, and no language fills it.

A text that is null or without letters is ``und`` with score 0; so is every text if nothing
could be learnt. A text none of whose grams are known has the language with most text, and
score 0. Repeated rows score alike; a null doc_id is not held out. Conflicting languages of
repeated rows count each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, batches_of
from .fitting import held_out, score_rows
from .words import U64, in_pieces, mix

UNKNOWN = "und"
ORDERS = (2, 3, 4, 5)
MODULUS, REMAINDER = 4, 2
#: About so much text of a language is learnt from.
MAX_BYTES = 16 << 20
#: A gram belongs where it is at least so frequent against where it is most frequent, and was seen so often.
RATIO, LEAST = 0.2, 3
HASHES, SLOTS_A_GRAM = 3, 4
#: Distinct grams that a task counts before it hands them on.
HELD = 1 << 18
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once a process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
    return _letters


def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h ^ code) * U64(0x9E3779B97F4A7C15)
    return h ^ (h >> U64(29))


def grams(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, text) of the grams of all texts, for each order; a gram's hash goes on from that of its beginning."""
    lower = [(t or b"").decode("utf-8", "replace").lower() for t in texts]
    code = np.frombuffer("\n".join(["", *lower, ""]).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in lower])
    owner = np.concatenate((owner, owner[-1:])) if len(texts) else np.zeros(len(code), np.int32)
    code = np.where(letters()[code], code, 0)
    # signs in a row are one sign; the sign before a text's first word is its own
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0)
    code, owner = code[keep].astype(U64), owner[keep]
    inside, h, within, parts = code > 0, _step(code, U64(1)), None, []
    for n in range(2, max(ORDERS) + 1):
        m = max(len(code) - n + 1, 0)
        h = _step(h[:m], code[n - 1 : n - 1 + m])
        # letters between the first and the last sign
        within = inside[1 : 1 + m] if n == 3 else within[:m] & inside[n - 2 : n - 2 + m] if n > 3 else np.ones(m, bool)
        if n in ORDERS:
            at = np.flatnonzero(within)
            parts.append((h[at], np.where(inside[at], owner[at], owner[at + 1])))
    return parts


def slots(h: np.ndarray, size: int) -> list[np.ndarray]:
    """The slots of each gram, from parts of its hash; ``size`` is a power of two."""
    if size > 1 << 21:
        return [(mix(h, 100 + k) & U64(size - 1)).astype(np.int64) for k in range(HASHES)]
    return [(h >> U64(1 + 21 * k) & U64(size - 1)).astype(np.int64) for k in range(HASHES)]


#: The bits of each byte.
_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.float64)


@dataclass
class Filters:
    """``table`` (slots, bytes of 8 languages), ``false``: how often each language's filter says yes to a strange gram."""

    languages: list[str]
    table: np.ndarray
    false: np.ndarray

    def masks(self, h: np.ndarray) -> np.ndarray:
        """All languages that hold each gram, as bits: one row of bytes a gram."""
        a, *rest = slots(h, len(self.table))
        found = self.table[a]
        for b in rest:
            found &= self.table[b]
        return found

    def shares(self, texts: list[bytes | None]) -> np.ndarray:
        """The share of each text's grams that each language holds, less what its filter says yes to wrongly."""
        k, total, orders = len(self.languages), np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for h, text in grams(texts):
            found = self.masks(h)
            count = np.bincount(text, minlength=len(texts)).astype(np.float64)
            # equal masks of a text are counted together, then their bits
            yes = [np.bincount(text * 256 + found[:, w], minlength=256 * len(texts)).reshape(-1, 256) @ _BITS for w in range(found.shape[1])]
            held = (np.concatenate(yes, axis=1)[:, :k] - count[:, None] * self.false) / np.maximum(1 - self.false, 1e-9)
            total += np.maximum(held, 0) / np.maximum(count, 1)[:, None]
            orders += count > 0
        return total / np.maximum(orders, 1)[:, None]

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        """(language, score from 0 to 1: the winner's share of all languages' shares) of each text."""
        shares = self.shares(texts)
        if not len(self.languages) or not len(texts):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = shares.argmax(1)
        score = shares.max(1) / np.maximum(shares.sum(1), 1e-12)
        known = np.array([bool(t) and any(map(str.isalpha, t.decode("utf-8", "replace"))) for t in texts], bool)
        return [self.languages[k] if on else UNKNOWN for k, on in zip(best, known)], np.where(known, np.minimum(score, 1.0), 0.0)


def _count(numbers: dict[str, int]):
    """Each task's grams by language, with counts; handed on whenever many have come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1].astype(np.int32)), pa.array(counts)], ["gram", "language", "n"])

        for piece in in_pieces(batches):
            h, text = (np.concatenate(x) for x in zip(*grams(piece.column("text").to_pylist())))
            language = np.array([numbers[x] for x in piece.column("lang").to_pylist()], np.int64)[text]
            for k in np.unique(language):
                g, n = np.unique(h[language == k], return_counts=True)
                keys = np.concatenate((keys, np.stack((g.view(np.int64), np.full(len(g), k)), 1)))
                counts = np.concatenate((counts, n))
            if len(keys) > 4 * HELD:
                keys, counts = _added(keys, counts)
                if len(keys) > HELD:
                    yield out()
                    keys, counts = keys[:0], counts[:0]
        keys, counts = _added(keys, counts)
        yield out()

    return run


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys[:, 0], keys[:, 1]))
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), (np.diff(keys, axis=0) != 0).any(1))))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _slot_rows(size: int):
    """(slot, byte, mask) of each gram's slots; ``languages`` are the bits to set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, lists = batch.column("gram").to_numpy().view(U64), batch.column("languages")
            row, bit = np.repeat(np.arange(len(h)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            mask = np.zeros((len(h), 1 + int(bit.max(initial=0)) // 8), np.int64)
            np.bitwise_or.at(mask, (row, bit // 8), 1 << bit.astype(np.int64) % 8)
            at, byte = np.nonzero(mask)
            three = [s[at] for s in slots(h, size)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(three)), pa.array(np.tile(byte, HASHES).astype(np.int32)), pa.array(np.tile(mask[at, byte], HASHES))], ["slot", "byte", "mask"])

    return run


def train(docs: DataFrame, held: Column | None = None, max_bytes: int = MAX_BYTES) -> Filters:
    """From text and lang of the rows of ``docs`` that are not ``held`` out."""
    spark = docs.sparkSession
    batches_of(spark)
    space = Workspace(spark, "languages")
    held = held_out(F.col("doc_id"), MODULUS, REMAINDER) if held is None else held
    rows = docs.where(~held & F.col("lang").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    # one row a language
    sizes = {r["lang"]: r["bytes"] for r in rows.groupBy("lang").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).collect()}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    numbers, width = {x: k for k, x in enumerate(languages)}, max(1, -(-len(languages) // 8))
    if not languages:
        return Filters([], np.zeros((1, 1), np.uint8), np.zeros(0))
    rate = F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, max_bytes / max(sizes[x], 1)))])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_003)) < F.element_at(rate, F.col("lang")) * 1_000_003)
    parts = drawn.select("lang", "text").mapInArrow(_count(numbers), "gram long, language int, n long")
    counts = space.keep(parts.groupBy("gram", "language").agg(F.sum("n").alias("n")), "counts")
    totals = {r["language"]: r["n"] for r in counts.groupBy("language").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Filters(languages, np.zeros((1, width), np.uint8), np.zeros(len(languages)))
    total = F.create_map(*[F.lit(v) for k, n in totals.items() for v in (k, float(n))])
    often = counts.withColumn("often", F.col("n") / F.element_at(total, F.col("language")))
    most = often.groupBy("gram").agg(F.max("often").alias("most"), F.sum("n").alias("all"), F.collect_list(F.struct("language", "often")).alias("each"))
    belongs = F.transform(F.filter("each", lambda x: x["often"] >= RATIO * F.col("most")), lambda x: x["language"])
    known = space.keep(most.where(F.col("all") >= LEAST).select("gram", belongs.alias("languages")), "known")
    size = 1 << max(10, int(np.ceil(np.log2(SLOTS_A_GRAM * max(known.count(), 1)))))
    # bounded by the text that is learnt from
    filled = known.mapInArrow(_slot_rows(size), "slot long, byte int, mask long").groupBy("slot", "byte").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros((size, width), np.uint8)
    table[filled["slot"].to_numpy(), filled["byte"].to_numpy()] = filled["mask"].to_numpy()
    full = np.unpackbits(table, axis=1, bitorder="little").mean(0)[: len(languages)]
    return Filters(languages, table, full**HASHES)


def identify(docs: DataFrame, model: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.false))

    def start():
        filters = Filters(*shared.value)

        def of(texts):
            language, score = filters.predict(texts)
            return [pa.array(score), pa.array(language, pa.string())]

        return of

    rows = score_rows(docs, start, ", lang_pred string")
    return rows.select("doc_id", held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), "lang_pred", "score")
