"""Jaccard join of word 5-gram sets by T-occurrence search (DivideSkip), and the classes it links.

Sets x and y with 100 * |x & y| >= 80 * |x | y| share at least T(x) = ceil(0.8 * |x|)
members, so y occurs in T of the inverted lists of x's members. DivideSkip sets the
L = T - ``COUNTED`` longest lists of x aside; whatever reaches T occurs in ``COUNTED`` of
the others, the short ones.

1. Which lists are long is found out from all members of every eighth document: members
   in three length classes become bits of fixed size (a false bit calls a short list long,
   which is right with any fixed order of the lists). Only the order follows from this.
2. Each document's set is made once, in that order: by length class, then by hash. Its
   first |x| - L members are the short lists' keys. Documents with equal sets are one class
   and its smallest doc_id stands for it.
3. Spark builds the short lists by key; lists of one document link nothing and go. Those a
   document occurs in are merged with a heap that counts; candidates that occur in
   T - L of them, and could reach the similarity by their sizes and by the parities of
   their hashed members (which bound the overlap from above), stay.
4. Lists longer than 2 * ``LONG`` among the keys (those of large groups of near copies,
   all of whose lists are long) are never merged: their documents are compared with
   two of them, and then with those that could still reach the overlap without any short list.
5. Candidates are verified by binary probes into the inverted lists of all members: first
   each document with its likeliest candidate and with the centres, then whatever is not
   in one component already. So a group of near copies costs as many comparisons as it
   has documents, unless they don't link; nothing that links is left out.

Null and empty texts have no set and link with nothing; a text shorter than five words is
one member. Repeated rows with one doc_id are one document if their texts are equal, else
each is a document of its own under the doc_id they share. Null doc_ids are left as they are,
unlinked. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, batches_of, broadcast_if_small, components
from .words import Runs, flat, in_pieces, mix, split

WIDTH = 5
LONG = 32
#: T - L: in so many short lists a document must be met.
COUNTED = 3
#: One document in so many is looked at to tell long lists; a list is in class k if it has at least so many of them.
EVERY, CLASSES = 8, (4, 32, 256)
#: Slots that tell the class of a list by its hash, and how many lists go into them at most: the longest.
SLOTS, MOST_LONG = 1 << 23, 1 << 21
SLAB = SLOTS >> 6
#: Documents of a long list that a task holds at a time, about.
PART = 2048


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct members of each text's set."""
    each, start = split(texts, lower=True)
    runs = Runs(flat(each))
    size = np.diff(start)
    length = np.minimum(size, width)
    count = np.where(size > 0, size - length + 1, 0)
    first = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(start[:-1], count) + np.arange(first[-1]) - np.repeat(first[:-1], count)
    members = runs.of(at, np.repeat(length, count)).view(np.int64)
    return [np.unique(members[a:b]) for a, b in zip(first, first[1:])]


def needed(n: int) -> int:
    """T of a set of n members."""
    return (4 * n + 4) // 5


def short_keys(n: int) -> int:
    """How many lists remain when the L longest are set aside."""
    return n - needed(n) + min(COUNTED, needed(n))


def class_slot(members: np.ndarray) -> np.ndarray:
    return (mix(members.view(np.uint64), 5) >> np.uint64(64 - (SLOTS - 1).bit_length())).view(np.int64)


def in_order(members: np.ndarray, classes: np.ndarray | None) -> tuple[np.ndarray, int, int]:
    """The keys of the short lists, shortest class first, how many of them are in no class of long lists, and how common all members are (0 to 300)."""
    n = len(members)
    if classes is None or not n:
        return members[: short_keys(n)] if n else members, min(n, short_keys(n)) if n else 0, 0
    slot = class_slot(members)
    level = np.bitwise_count(classes[slot])
    keys = np.argsort(level, kind="stable")[: short_keys(n)]
    return members[keys], int((level[keys] == 0).sum()), int(100 * level.sum(dtype=np.int64) // n)


def parities(members: np.ndarray) -> bytes:
    """For each of about as many slots as there are members, whether an odd number of them falls there."""
    slots = max(64, 1 << (len(members) - 1).bit_length())
    odd = np.bincount(members & (slots - 1), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ(x: bytes, y: bytes) -> int:
    """Members that are in one of the sets only are at least so many."""
    if len(x) < len(y):
        x, y = y, x
    a, bits = int.from_bytes(x, "little"), 8 * len(x)
    while bits > 8 * len(y):
        bits //= 2
        a = a >> bits ^ a & (1 << bits) - 1
    return (a ^ int.from_bytes(y, "little")).bit_count()


def _list_array(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(k) for k in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _signatures(classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = classes.value if classes is not None else None
        for piece in in_pieces(batches):
            sets = shingle_sets(piece.column("text").to_pylist())
            prints = [[int(mix(s.view(np.uint64), salt).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets] for salt in (1, 2)]
            keys = [in_order(s, known) for s in sets]
            bits = pa.array([parities(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("tie"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(p, pa.int64()) for p in prints), _list_array([k[:n] for k, n, _ in keys]), _list_array([k[n:] for k, n, _ in keys]), pa.array([c for _, _, c in keys], pa.int32()), bits],
                ["doc_id", "tie", "n_shingles", "f1", "f2", "keys", "late", "common", "bits"],
            )

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in in_pieces(batches):
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), _list_array(shingle_sets(piece.column("text").to_pylist()))], ["doc", "members"])


def _class_part(table: pa.Table) -> pa.Table:
    """One slab of the class bits: a byte a slot, with a bit for each class."""
    table = table.combine_chunks()
    part = np.zeros(SLAB, np.uint8)
    np.bitwise_or.at(part, table["slot"].to_numpy(), table["level"].to_numpy().astype(np.uint8))
    return pa.table({"slab": pa.array([table["slab"][0].as_py()], pa.int64()), "part": [part.tobytes()]})


def merge(doc: int, lists: list[list[int]], times: list[int], least: int) -> list[tuple[int, int]]:
    """Heap-merge of a document's short lists (sorted; each stands for ``times`` keys): the later documents met ``least`` times, with their counts."""
    out, last, count = [], None, 0
    rest = [[(other, n) for other in x[bisect_right(x, doc) :]] for x, n in zip(lists, times)]
    for other, n in heapq.merge(*rest):
        if other != last:
            if count >= least:
                out.append((last, count))
            last, count = other, 0
        count += n
    if count >= least:
        out.append((last, count))
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, n, listed, lists in zip(*(batch.column(c).to_pylist() for c in ("doc", "n", "listed")), batch.column("lists")):
            # one document's lists at a time become Python numbers; long lists may make up the rest of the count
            x = lists.values
            out += [(doc, *found) for found in merge(doc, x.field("list").to_pylist(), x.field("times").to_pylist(), 1 if listed else min(COUNTED, needed(n)))]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["a", "b", "met"])


def _others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document the documents of its long lists, once each, in other components, that it may link with.

    Documents that share a short list are found by that; any others have no more members in
    common than the lesser ``left``.
    """
    for batch in batches:
        docs, ns, lefts, comps = (batch.column(c).to_numpy() for c in ("doc", "n", "left", "comp"))
        out_a, out_b = [], []
        for doc, n, left, comp, lists in zip(docs, ns, lefts, comps, batch.column("lists")):
            x = lists.values.flatten()
            d, m, most, c = (x.field(f).to_numpy() for f in ("doc", "n", "left", "comp"))
            found = np.unique(d[(c != comp) & (9 * np.minimum(most, left) >= 4 * (m + n)) & (5 * np.minimum(m, n) >= 4 * np.maximum(m, n))])
            out_a.append(np.minimum(found, doc))
            out_b.append(np.maximum(found, doc))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (out_a, out_b)], ["a", "b"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parities leave the overlap possible: 2 * overlap is at most na + nb - differing members."""
    for batch in batches:
        size = np.add(batch.column("na").to_numpy(), batch.column("nb").to_numpy()).tolist()
        keep = [n >= 9 * differ(x, y) for n, x, y in zip(size, batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        yield batch.select(["a", "b", "met"]).filter(pa.array(keep, pa.bool_()))


def probes(x: pa.ListArray, y: pa.ListArray) -> np.ndarray:
    """Of each pair of sets the members in common: inverted lists over the candidates ``y``, probed for each of x's members."""
    n = len(x)
    pair_x, pair_y = (np.repeat(np.arange(n), np.diff(s.offsets.to_numpy())) for s in (x, y))
    kx, ky = x.flatten().to_numpy(), y.flatten().to_numpy()
    lists, k = np.unique(ky, return_inverse=True)
    if not len(lists) or not len(kx):
        return np.zeros(n, np.int64)
    postings = np.sort(k * n + pair_y)
    at = np.minimum(np.searchsorted(lists, kx), len(lists) - 1)
    there = lists[at] == kx
    wanted = at[there] * n + pair_x[there]
    found = np.minimum(np.searchsorted(postings, wanted), len(postings) - 1)
    return np.bincount(pair_x[there][postings[found] == wanted], minlength=n)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        size = np.diff(x.offsets.to_numpy()) + np.diff(y.offsets.to_numpy())
        for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // 500_000)) + 1):
            if len(part):
                a, b = int(part[0]), len(part)
                keep = 9 * probes(x.slice(a, b), y.slice(a, b)) >= 4 * size[part]
                yield batch.slice(a, b).select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class JaccardJoin:
    """One run over ``docs``; ``classes()`` is the result."""

    def __init__(self, docs: DataFrame, long: int = LONG, every: int = EVERY):
        self.spark, self.long, self.every = docs.sparkSession, long, every
        batches_of(self.spark)
        self.space = Workspace(self.spark, "jaccard")
        text = F.col("text").cast("string").cast("binary")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("tie"))

    def _classes_of_lists(self):
        """A broadcast byte for each of ``SLOTS`` slots, or None if no list is long."""
        seen = self.docs.where(F.pmod(F.xxhash64("doc_id", F.lit("length")), F.lit(self.every)) == 0)
        counts = seen.mapInArrow(_members, "doc long, members array<long>").select(F.explode("members").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(f"n >= {CLASSES[0]}")
        counts = self.space.keep(counts, "long-lists")
        # the longest ones only, should there be too many: by powers of two of their lengths
        by_size = {r.p: r.c for r in counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("c")).collect()}
        least, total = CLASSES[0], 0
        for p in sorted(by_size, reverse=True):
            total += by_size[p]
            if total > MOST_LONG:
                least = 1 << p + 1
                break
        if not by_size:
            return None

        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slot, n = class_slot(batch.column("key").to_numpy()), batch.column("n").to_numpy()
                level = sum((n >= c).astype(np.int64) << k for k, c in enumerate(CLASSES))
                yield pa.RecordBatch.from_arrays([pa.array(slot // SLAB), pa.array(slot % SLAB), pa.array(level)], ["slab", "slot", "level"])

        parts = counts.where(F.col("n") >= least).mapInArrow(slots, "slab long, slot long, level long").groupBy("slab").applyInArrow(_class_part, "slab long, part binary")
        out = np.zeros(SLOTS, np.uint8)
        for r in parts.toLocalIterator():
            out[r["slab"] * SLAB : (r["slab"] + 1) * SLAB] = np.frombuffer(r["part"], np.uint8)
        return self.spark.sparkContext.broadcast(out)

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of the distinct ``pairs`` (a, b) that reach the similarity."""
        ids = self.space.keep(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"{name}-ids")
        members = self.docs.join(broadcast_if_small(ids, ids.count()), "doc_id", "left_semi").mapInArrow(_members, "doc long, members array<long>")
        members = self.space.keep(members, f"{name}-members")
        both = pairs.join(members.withColumnsRenamed({"doc": "a", "members": "x"}), "a").join(members.withColumnsRenamed({"doc": "b", "members": "y"}), "b")
        linked = self.space.keep(both.select("a", "b", "x", "y").mapInArrow(_probe, "a long, b long"), f"{name}-links")
        self.space.drop(f"{name}-members")
        return linked

    def _likely(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of ``pairs`` (a, b, met) that their counts, sizes and parities leave possible."""
        x, y = (self.bits.withColumnsRenamed({"doc": d, "n": f"n{d}", "bits": c, "listed": f"l{d}"}) for d, c in (("a", "x"), ("b", "y")))
        met = F.least(F.lit(COUNTED), F.floor((4 * F.least("na", "nb") + 4) / 5))
        # where both are in long lists, others of these may make up the count
        possible = pairs.join(x, "a").join(y, "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)").where((F.col("met") >= met) | F.col("la") & F.col("lb"))
        return self.space.keep(possible.select("a", "b", "met", "na", "nb", "x", "y").mapInArrow(_possible, "a long, b long, met long"), name)

    def sets(self) -> DataFrame:
        """(doc_id, tie, n_shingles, f1, f2, keys, late, common, bits) of each row; doc_id here stands for one text only."""
        if not hasattr(self, "_sets"):
            classes = self._classes_of_lists()
            schema = "doc_id long, tie long, n_shingles long, f1 long, f2 long, keys array<long>, late array<long>, common int, bits binary"
            self._sets = self.space.keep(self.docs.mapInArrow(_signatures(classes), schema), "sets")
            if classes is not None:
                classes.destroy()
            self._sets = self._apart(self._sets)
        return self._sets

    def _apart(self, sets: DataFrame) -> DataFrame:
        """Texts that share a doc_id get one each, should there be any; ``shared`` has the one they share."""
        shared = sets.where("doc_id IS NOT NULL").select("doc_id", "tie").groupBy("doc_id").agg(F.min("tie").alias("lo"), F.max("tie").alias("hi")).where("lo < hi").select(F.col("doc_id").alias("shared"))
        shared = self.space.keep(shared, "shared")
        n = shared.count()
        self.shared = None
        if n:
            few = broadcast_if_small(shared, n)
            own = F.when(F.col("shared").isNotNull(), F.xxhash64("doc_id", "tie")).otherwise(F.col("doc_id"))
            each = lambda df: df.join(few, df["doc_id"] == few["shared"], "left").withColumn("doc_id", own)
            self.docs, sets = each(self.docs).drop("shared"), each(sets)
            self.shared = self.space.keep(sets.where("shared IS NOT NULL").select("doc_id", "shared").distinct(), "own-ids")
            sets = sets.drop("shared")
        return sets

    def _under_shared(self, rows: DataFrame) -> DataFrame:
        """The classes' rows with the doc_ids that texts share again, and each component's smallest one."""
        rows = rows.withColumn("group", F.col("component_id"))
        if self.shared is None:
            return rows
        rows = rows.join(self.shared, "doc_id", "left").withColumn("doc_id", F.coalesce("shared", "doc_id")).drop("shared")
        least = rows.groupBy("group").agg(F.min("doc_id").alias("least"))
        return rows.join(least, "group", "left").select("doc_id", "tie", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "group")

    def classes(self) -> DataFrame:
        """doc_id, tie, n_shingles, component_id, group for each row; equal component_ids may be two groups where texts share a doc_id."""
        space, sets = self.space, self.sets()
        filled = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
        same = space.keep(filled.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).where("rows > 1"), "same")
        copies = filled.select("doc_id", "n_shingles", "f1", "f2").join(broadcast_if_small(same, 5 * same.count()), ["n_shingles", "f1", "f2"]).where("doc_id <> rep").select("doc_id", "f1", "rep").distinct()
        copies = space.keep(copies, "copies")
        few = broadcast_if_small(copies, 3 * copies.count())
        reps = filled.join(few, ["doc_id", "f1"], "left_anti").select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "common", "keys", "late", "bits")
        linked = self._linked(reps)
        rows = sets.select("doc_id", "tie", "n_shingles", "f1").join(few, ["doc_id", "f1"], "left").withColumn("rep", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")))
        rows = rows.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "tie", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
        return self._under_shared(rows)

    def _lists(self, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Short lists (list, times), and (key, doc, n, left, common) of the long ones.

        ``left``: how many members may be in common with a document that no short list shares.
        The first members in common, in the order, are keys of both; if they are of the long
        classes then all in common are. Where a key outside these classes has a long list, all may be.
        """
        # one shuffle deals the keys; counts and lists both come from it
        postings = reps.select("doc", "n", "common", F.size("keys").alias("rare"), F.explode("keys").alias("key")).repartition("key")
        counts = postings.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
        rows = self.space.keep(postings.join(counts, "key"), "rows")
        short = rows.where(F.col("df") <= 2 * self.long).groupBy("key").agg(F.array_sort(F.collect_set("doc")).alias("list"))
        short = short.groupBy("list").agg(F.count("*").alias("times"))
        late = reps.select(F.explode("late").alias("key"), "doc", "n", "common", F.size("keys").alias("rare"))
        more = rows.where(F.col("df") > 2 * self.long).select("key", "doc", "n", "common", "rare")
        among = self.space.keep(more.groupBy("doc").agg(F.countDistinct("key").alias("among")), "among")
        listed = late.union(more).join(broadcast_if_small(among, 2 * among.count()), "doc", "left")
        return short, listed.select("key", "doc", "n", F.when(F.col("among").isNull(), F.col("n") - F.col("rare")).otherwise(F.col("n")).alias("left"), "common")

    def _linked(self, reps: DataFrame) -> DataFrame:
        """(node, component) of the documents that link with others."""
        space = self.space
        short, listed = self._lists(reps)
        listed = space.keep(listed, "listed")
        among = space.keep(listed.select("doc", F.lit(True).alias("listed")).distinct(), "in-long-lists")
        self.bits = space.keep(reps.select("doc", "n", "bits").join(broadcast_if_small(among, among.count()), "doc", "left").fillna(False, ["listed"]), "bits")
        lists = short.select(F.explode("list").alias("doc"), F.struct("list", "times").alias("l")).groupBy("doc").agg(F.collect_list("l").alias("lists"))
        lists = lists.join(self.bits.select("doc", "n", "listed"), "doc").select("doc", "n", "listed", "lists")
        pairs = self._likely(lists.mapInArrow(_merge, "a long, b long, met long").dropDuplicates(["a", "b"]), "pairs")
        # first each document with its likeliest candidate, and those of long lists with their centres
        ends = pairs.select("a", "b", "met").union(pairs.select("b", "a", "met"))
        first = ends.groupBy("a").agg(F.max_by("b", F.struct("met", -F.col("b"))).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        tried = space.keep(first.union(self._stars(listed)).distinct(), "tried")
        now = components(self._verified(tried, "tried"), space, "components-first")
        # then whatever no component holds yet
        ends = now.select("node", "component")
        apart = pairs.join(ends.withColumnsRenamed({"node": "a", "component": "ca"}), "a", "left").join(ends.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
        rest = space.keep(apart.union(self._between(listed, now)).distinct().join(tried, ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            now = components(now.select(F.col("node").alias("a"), F.col("component").alias("b")).union(self._verified(rest, "rest")), space, "components")
        return now

    def _stars(self, listed: DataFrame) -> DataFrame:
        """(a, b): each document of a long list with two of the list's documents, where sizes and parities leave a link possible."""
        # the document most of whose members are common ones is what the others are copies of, if anything is; and one by a hash
        order = [F.struct("common", -F.col("doc")), F.xxhash64("doc")]
        centres = listed.groupBy("key").agg(*[F.max_by("doc", x).alias(f"c{k}") for k, x in enumerate(order)]).select("key", F.array("c0", "c1").alias("centres"))
        centres = self.space.keep(centres, "centres")
        star = listed.join(broadcast_if_small(centres, 3 * centres.count()), "key").select("doc", F.explode("centres").alias("c")).where("doc <> c")
        star = star.select(F.least("doc", "c").alias("a"), F.greatest("doc", "c").alias("b")).distinct()
        return self._likely(star.withColumn("met", F.lit(COUNTED).cast("long")), "stars").select("a", "b")

    def _between(self, listed: DataFrame, now: DataFrame) -> DataFrame:
        """Pairs of long lists in different components that sizes and parities leave possible.

        Of two such documents one at least is not of the list's largest component, so the
        lists go to these documents only, in parts of about ``PART`` by the others' hashes.
        """
        space = self.space
        named = listed.join(now.withColumnsRenamed({"node": "doc", "component": "comp"}), "doc", "left").select("key", "doc", "n", "left", F.coalesce("comp", "doc").alias("comp"))
        named = space.keep(named, "named")
        per = named.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("c"), F.count("*").alias("comps"))
        # lists whose documents are all of one component link nothing new
        per = space.keep(per.where("comps > 1").select("key", "main", "c"), "several")
        n, longest = per.agg(F.count("*"), F.max("c")).first()
        if not n:
            return self.spark.createDataFrame([], "a long, b long")
        parts = max(1, -(-int(longest) // PART))
        named = space.keep(named.join(broadcast_if_small(per.select("key", "main"), 2 * n), "key"), "named-several")
        # a document with too many members in short lists links by these only
        named = named.where("5 * left >= 4 * n")
        lists = named.groupBy("key", F.pmod(F.xxhash64("doc", F.lit("part")), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("doc", "n", "left", "comp")).alias("list"))
        loose = named.where("comp <> main").select("key", "doc", "n", "left", "comp")
        met = loose.join(lists, "key").groupBy("doc", "n", "left", "comp", "part").agg(F.collect_list("list").alias("lists")).mapInArrow(_others, "a long, b long").distinct()
        return self._likely(met.withColumn("met", F.lit(COUNTED).cast("long")), "between").select("a", "b")


def link_documents(docs: DataFrame, long: int = LONG, every: int = EVERY) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    return JaccardJoin(docs, long, every).classes().drop("tie", "group")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest doc_id (then: least hash of the text), once if repeated; rows without a set all stay."""
    join = JaccardJoin(docs)
    space = Workspace(docs.sparkSession, "keep-one")
    rows = space.keep(join.classes().where("n_shingles > 0 AND doc_id IS NOT NULL"), "rows-of-classes")
    several = rows.groupBy("group").agg(F.min(F.struct("doc_id", "tie")).alias("kept"), F.count("*").alias("rows")).where("rows > 1")
    several = space.keep(several.select("group", F.col("kept.doc_id").alias("kept_id"), F.col("kept.tie").alias("kept_tie")), "several")
    gone = rows.join(several, "group").where("doc_id <> kept_id OR tie <> kept_tie").select("doc_id", "tie").distinct()
    gone = space.keep(gone, "gone")
    again = space.keep(rows.groupBy("doc_id", "tie").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", "tie"), "again")
    tie = F.coalesce(F.xxhash64(docs["text"].cast("string").cast("binary")), F.lit(0))
    on = lambda t: (docs["doc_id"].cast("long") == t["doc_id"]) & (tie == t["tie"])
    n_again = again.count()
    left = docs.join(broadcast_if_small(gone, 2 * gone.count()), on(gone), "left_anti")
    if not n_again:
        return left
    again = broadcast_if_small(again, 2 * n_again)
    return left.join(again, on(again), "left_anti").union(left.join(again, on(again), "left_semi").dropDuplicates(["doc_id", "text"]))
