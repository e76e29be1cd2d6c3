"""Fill-in-the-middle: documents cut at two places, prefix, suffix and middle put in another order.

Cuts are counted in units that a small automaton over bytes ends (code points, unless another
is given), found by a parallel scan:

1. A chunk of a text is any stretch of its bytes; it may begin inside a unit. It is scanned
   from every state at once and gives a function from the state before it to the state after
   it, and the number of units it ends for each state it may begin in.
2. Such functions are composed, in any grouping: pieces of 256 bytes to chunks, chunks to
   documents. So the state in which a chunk is really entered, and the units before it, follow
   from the small functions of the chunks before it alone.
3. A cut after so many units lies in the one chunk where the running count passes it; only
   that chunk is scanned again, from its entry state, for the byte.

A text of one chunk is done where it is read. The chunks of longer ones are dealt to all
tasks, and what they give is gathered by text: some bytes a chunk. A second automaton, scanned
with the first, counts the marks ``<P>``, ``<S>`` and ``<M>`` in the text.

The draws h1 to h4 are the first four 8-digit groups, as unsigned numbers, of the hex sha256
of ``1:`` and the doc_id. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1)
of n units, the middle after the larger. A text is left plain if it is empty or has one of the
marks, or if h3 % 100 >= 90; else the form is spm if h4 % 100 < 20, and psm otherwise.

A null text counts as empty. A null doc_id has no draws, its text is plain. Rows that repeat a
doc_id are formatted each by itself. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, batches_of
from .words import in_pieces

MARKS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_BELOW = 90, 20
#: Bytes of a chunk, and of the pieces that it is scanned in side by side.
CHUNK, LANE = 1 << 16, 256


@dataclass(frozen=True)
class Automaton:
    """``after[state, byte]``: the next state; ``ends[state, byte]``: whether a unit ends with the byte. State 0 begins."""

    after: np.ndarray
    ends: np.ndarray


def code_points() -> Automaton:
    """The state is the number of bytes that the code point still lacks; a byte out of place is passed over."""
    after, ends = np.zeros((4, 256), np.int64), np.zeros((4, 256), np.int64)
    lacking = np.zeros(256, np.int64)
    lacking[0xC0:0xE0], lacking[0xE0:0xF0], lacking[0xF0:0xF8] = 1, 2, 3
    tail = slice(0x80, 0xC0)
    for state in range(4):
        after[state], ends[state] = lacking, lacking == 0
        after[state, tail], ends[state, tail] = max(state - 1, 0), state == 1
    return Automaton(after, ends)


def marks() -> Automaton:
    """Ends a unit with each mark: states are how much of one has been read."""
    after, ends = np.zeros((3, 256), np.int64), np.zeros((3, 256), np.int64)
    after[:, ord("<")] = 1
    after[1, [ord(m[1]) for m in MARKS]] = 2
    ends[2, ord(">")] = 1
    return Automaton(after, ends)


def side_by_side(*automata: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of all states of all automata, with a 257th sign that changes nothing; and where each automaton's states begin."""
    first = np.concatenate(([0], np.cumsum([len(a.after) for a in automata])))
    after = np.concatenate([a.after + k for a, k in zip(automata, first)])
    still = np.arange(len(after))[:, None]
    ends = np.concatenate([a.ends for a in automata])
    return np.concatenate((after, still), 1) * 257, np.concatenate((ends, 0 * still), 1), first


class Scan:
    """Chunks cut into lanes, each lane's function and counts, and their compositions."""

    def __init__(self, automata: tuple[Automaton, ...], chunks: list[bytes]):
        self.after, self.ends, self.first = side_by_side(*automata)
        sizes = np.array([len(c) for c in chunks], np.int64)
        self.lanes = np.maximum(-(-sizes // LANE), 1)
        self.start = np.concatenate(([0], np.cumsum(self.lanes)))
        self.sign = np.full((LANE, self.start[-1]), 256, np.int64)
        flat = np.frombuffer(b"".join(chunks), np.uint8)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.sign[place % LANE, np.repeat(self.start[:-1], sizes) + place // LANE] = flat
        states = len(self.after)
        now = np.tile(np.arange(states)[:, None] * 257, (1, self.start[-1]))
        self.count = np.zeros_like(now)
        for row in self.sign:
            at = now + row
            self.count += self.ends.take(at)
            now = self.after.take(at)
        self.function = now // 257

    def composed(self) -> tuple[np.ndarray, np.ndarray]:
        """(function, counts) of each chunk: neighbours are put together pairwise until one is left of each chunk."""
        f, c, lanes = self.function, self.count, self.lanes
        while lanes.max(initial=1) > 1:
            start = np.concatenate(([0], np.cumsum(lanes)))
            half = (lanes + 1) // 2
            left = np.repeat(start[:-1], half) + 2 * (np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half))
            alone = left + 1 >= np.repeat(start[1:], half)
            right = np.where(alone, left, left + 1)
            g, d = f[:, left], c[:, left]
            f = np.where(alone, g, f[g, right])
            c = np.where(alone, d, d + c[g, right])
            lanes = half
        return f, c

    def entered(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For chunks entered in ``state``: the state in which each lane is entered, and the units its chunk has ended before it."""
        begin, before = np.zeros(self.start[-1], np.int64), np.zeros(self.start[-1], np.int64)
        now, count = state.copy(), np.zeros(len(state), np.int64)
        for k in range(self.lanes.max(initial=0)):
            on = np.flatnonzero(self.lanes > k)
            lane = self.start[on] + k
            begin[lane], before[lane] = now[on], count[on]
            count[on] += self.count[now[on], lane]
            now[on] = self.function[now[on], lane]
        return begin, before

    def select(self, state: np.ndarray, units: np.ndarray) -> np.ndarray:
        """For chunks entered in ``state``: the byte after which ``units`` units have ended (0: the beginning)."""
        begin, before = self.entered(state)
        chunk = np.repeat(np.arange(len(self.lanes)), self.lanes)
        # the last lane that has ended fewer units before it
        fewer = before < units[chunk]
        lane = self.start[:-1] + np.maximum(np.bincount(chunk, weights=fewer, minlength=len(units)).astype(np.int64) - 1, 0)
        now, left, found = begin[lane] * 257, units - before[lane], np.zeros(len(units), np.int64)
        for k, row in enumerate(self.sign[:, lane]):
            at = now + row
            ended = self.ends.take(at)
            left = left - ended
            found = np.where((left == 0) & (ended == 1), k + 1, found)
            now = self.after.take(at)
        return np.where(units == 0, 0, (lane - self.start[:-1]) * LANE + found)


def draws(n: np.ndarray, h: list[np.ndarray], marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units before the first cut, before the second, whether the text is left plain)."""
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    return np.minimum(one, two), np.maximum(one, two), (n == 0) | marked | (h[2] % 100 >= PLAIN_FROM)


FOUND = "n long, plain boolean, spm boolean, first long, second long, first_byte long, second_byte long"


def _numbers(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def _found(batch: pa.RecordBatch, kept: list[str], columns: list) -> pa.RecordBatch:
    names = [*kept, *(x.split()[0] for x in FOUND.split(", "))]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, columns)], names)


def _whole(units: Automaton):
    """Texts of one chunk: scanned, counted and cut in one go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches):
            scan = Scan((units, marks()), piece.column("text").to_pylist())
            _, count = scan.composed()
            h = _numbers(piece, ["h1", "h2", "h3", "h4"])
            n = count[0]
            first, second, plain = draws(n, h, count[scan.first[1]] > 0)
            begin = np.zeros(len(n), np.int64)
            yield _found(piece, ["doc_id", "text"], [n, plain, h[3] % 100 < SPM_BELOW, first, second, scan.select(begin, first), scan.select(begin, second)])

    return run


def _summaries(units: Automaton):
    """Chunks to their functions and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, "chunk"):
            f, c = Scan((units, marks()), piece.column("chunk").to_pylist()).composed()
            yield pa.RecordBatch.from_arrays([piece.column("key"), piece.column("k"), *piece.select(["h1", "h2", "h3", "h4"]).columns, pa.array(list(f.T)), pa.array(list(c.T))], ["key", "k", "h1", "h2", "h3", "h4", "function", "count"])

    return run


def _resolve(states: int):
    """One text's chunks, in order: its units, and for both cuts the chunk, its entry state and the units to go in it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        f, c = np.stack(table["function"].to_numpy()), np.stack(table["count"].to_numpy())
        unit, mark = np.int64(0), np.int64(states)
        entry, before, marked = np.zeros(len(f), np.int64), np.zeros(len(f) + 1, np.int64), 0
        for k in range(len(f)):
            entry[k], before[k + 1] = unit, before[k] + c[k, unit]
            marked += c[k, mark]
            unit, mark = f[k, unit], f[k, mark]
        h = [table[x].to_numpy()[:1] for x in ("h1", "h2", "h3", "h4")]
        first, second, plain = draws(before[-1:], h, np.array([marked > 0]))
        out = {"key": [table["key"][0].as_py()], "n": before[-1:], "plain": plain, "spm": h[3] % 100 < SPM_BELOW}
        for name, units in (("first", first), ("second", second)):
            at = np.maximum(np.searchsorted(before, units) - 1, 0)
            out |= {name: units, f"{name}_k": at, f"{name}_state": entry[at], f"{name}_left": units - before[at]}
        return pa.table(out)

    return run


RESOLVED = "key string, n long, plain boolean, spm boolean, first long, first_k long, first_state long, first_left long, second long, second_k long, second_state long, second_left long"


def _select(units: Automaton, chunk: int):
    """The bytes of both cuts, from the two chunks they lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches):
            byte = []
            for name in ("first", "second"):
                k, state, left = _numbers(piece, [f"{name}_k", f"{name}_state", f"{name}_left"])
                byte.append(k * chunk + Scan((units,), piece.column(f"{name}_chunk").to_pylist()).select(state, left))
            yield _found(piece, ["doc_id", "text"], [*_numbers(piece, ["n", "plain", "spm", "first", "second"]), *byte])

    return run


def _with_draws(docs: DataFrame) -> DataFrame:
    """(doc_id, text in bytes, h1 to h4); without a doc_id h3 is one that leaves the text plain."""
    sha = F.sha2(F.concat(F.lit("1:"), F.col("doc_id").cast("string")), 256)
    h = {f"h{k + 1}": F.coalesce(F.conv(F.substring(sha, 8 * k + 1, 8), 16, 10).cast("long"), F.lit(PLAIN_FROM).cast("long")) for k in range(4)}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.withColumns(h)


def cut_places(docs: DataFrame, units: Automaton | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text, n, plain, spm, first, second, first_byte, second_byte): text in bytes, the cuts in units and in bytes."""
    units = units or code_points()
    batches_of(docs.sparkSession)
    space, schema = Workspace(docs.sparkSession, "infill"), f"doc_id long, text binary, {FOUND}"
    rows = _with_draws(docs)
    size = F.octet_length("text")
    short = rows.where(size <= chunk).mapInArrow(_whole(units), schema)
    long = rows.where(size > chunk).withColumn("key", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text"), 256))
    numbers = F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / chunk))
    dealt = long.select("key", "h1", "h2", "h3", "h4", "text", F.explode(numbers).alias("k"))
    piece = lambda k: F.substring("text", (F.col(k) * chunk + 1).cast("int"), F.lit(chunk))
    dealt = dealt.select("key", "h1", "h2", "h3", "h4", "k", piece("k").alias("chunk")).repartition("key", "k")
    summaries = dealt.mapInArrow(_summaries(units), "key string, k long, h1 long, h2 long, h3 long, h4 long, function array<long>, count array<long>")
    # rows that repeat a long text give the same chunks again; a text has at most 2 GB / chunk of them
    resolved = summaries.dropDuplicates(["key", "k"]).groupBy("key").applyInArrow(_resolve(len(units.after)), RESOLVED)
    resolved = space.keep(resolved, "resolved")
    joined = long.select("key", "doc_id", "text").join(resolved, "key").withColumns({"first_chunk": piece("first_k"), "second_chunk": piece("second_k")})
    return short.union(joined.mapInArrow(_select(units, chunk), schema))


def _between(text: Column, start: Column | int, end: Column | None = None) -> Column:
    """Bytes from ``start`` (counted from 0) to ``end`` as text."""
    begin = F.lit(start) if isinstance(start, int) else start
    size = F.lit(2**31 - 1) if end is None else end - begin
    return F.substring(text, (begin + 1).cast("int"), size.cast("int")).cast("string")


def fill_in_middle(docs: DataFrame, units: Automaton | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row; the two lengths in units, null where plain."""
    c = cut_places(docs, units, chunk)
    prefix, middle, suffix = _between(F.col("text"), 0, F.col("first_byte")), _between(F.col("text"), F.col("first_byte"), F.col("second_byte")), _between(F.col("text"), F.col("second_byte"))
    p, s, m = map(F.lit, MARKS)
    form = F.when(F.col("plain"), "plain").when(F.col("spm"), "spm").otherwise("psm")
    output = F.when(form == "plain", F.col("text").cast("string")).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    split = lambda x: F.when(~F.col("plain"), x)
    return c.select("doc_id", "n", form.alias("form"), split(F.col("first")).alias("prefix_chars"), split(F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from: each of its marks occurs in it once."""
    p, s, m = (F.locate(x, output) for x in MARKS)
    part = lambda a, b=None: F.substring(output, a + 3, F.lit(2**31 - 1) if b is None else b - a - 3)
    return F.when(form == "psm", F.concat(part(p, s), part(m), part(s, m))).when(form == "spm", F.concat(part(p, m), part(m), part(s, p))).otherwise(output)
