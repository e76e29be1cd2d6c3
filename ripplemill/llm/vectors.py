"""Near-duplicate vectors by a forest of random-projection trees.

1. Equal vectors are one class with a count throughout.
2. Hot spots: in a bounded sample of each label's vectors, centres with many vectors nearly
   parallel to them are looked for. All vectors within half the linking angle of a centre
   form a ball; any two of them link, so their links are a sum and need no comparison.
3. Trees start at one node for each label (and number of components) and split at the
   median of a random projection; a fixed small share of vectors on either side of it goes
   to both children (spill). Thresholds come from a bounded sample of a node's vectors;
   every vector is sent down. A round splits all nodes that are too large by up to six
   levels, so a few rounds reach leaves of some hundred vectors whatever the table's size.
   Where half of a node's vectors project to about the same value, those are dealt by a
   hash and all others go to both sides, so that every split makes nodes smaller. A node
   where many sampled pairs link (besides those inside a ball) is not split any more: it is
   compared whole, in blocks of pairs that many tasks share.
4. Vectors are compared inside leaves only, in double precision whatever the table's type;
   a pair that several leaves hold counts in the one with the least number.

A leaf gives each vector's count of links and a spanning forest of them, never its pairs.

Vectors that are null, zero or have null, NaN or infinite components, or no label, link
with nothing and are their own components. Rows that share a vec_id are counted each; with
a null vec_id they link with nothing. Vectors of different lengths never link. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import Workspace, batches_of, broadcast_if_small, components

COSINE = 0.93
#: Two vectors that are both so near a centre link: twice its angle is less than that of ``COSINE``.
BALL = 0.9824
#: A ball is made where at least so much of a label's sampled vectors is in it; so many centres a label at most.
BALL_SHARE, CENTRES = 0.02, 16
TREES = 6
LEAF = 256
SPILL = 0.05
#: A node is compared whole if so many of its sampled pairs link.
DENSE = 0.06
#: Vectors of a node that its thresholds are taken from, about.
SAMPLE = 4096
LEVELS = 6
SEED = 29


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows; the vectors of a node have one length."""
    x = column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _directions(node: int, splits: int, width: int) -> np.ndarray:
    return np.random.default_rng([SEED, node & (1 << 64) - 1]).standard_normal((splits, width)).astype(np.float32)


def _centres(table: pa.Table) -> pa.Table:
    """The hot spots of one label's sample: unit vectors, one after another."""
    table = table.combine_chunks().sort_by("vec_id")
    x = _matrix(table["vec"].chunk(0))[:2048]
    near = x @ x.T >= COSINE
    free, found = np.ones(len(x), bool), []
    while len(found) < CENTRES and free.any():
        k = int(np.argmax((near & free).sum(1) * free))
        centre = x[near[k] & free].mean(0)
        centre /= np.linalg.norm(centre)
        inside = free & (x @ centre >= BALL)
        if inside.sum() >= max(8, BALL_SHARE * len(x)):
            found.append(centre)
        elif (near[k] & free).sum() < BALL_SHARE * len(x):
            break
        free &= ~(inside | near[k])
    return pa.table({"root": pa.array([table["root"][0].as_py()], pa.int64()), "centres": pa.array([np.concatenate(found) if found else np.zeros(0)], pa.list_(pa.float64()))})


def _in_ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of the nearest centre's ball, where a vector is inside one."""
    for batch in batches:
        ball, inside = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
        for root, at in _grouped(batch.column("root").to_numpy()):
            centres = batch.column("centres")[int(at[0])].as_py()
            if centres:
                x = _matrix(batch.column("vec").take(pa.array(at)))
                p = x @ np.array(centres).reshape(-1, x.shape[1]).T
                inside[at] = p.max(1) >= BALL
                ball[at] = _child(root, p.argmax(1))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("copies"), batch.column("root"), batch.column("vec"), pa.array(ball, mask=~inside)], ["vec_id", "copies", "root", "vec", "ball"])


def _child(node: int, k: np.ndarray) -> np.ndarray:
    first = np.random.SeedSequence([SEED, node & (1 << 64) - 1]).generate_state(1, np.uint64)[0]
    return (first + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _grouped(key: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(key, places) of each distinct key."""
    order = np.argsort(key, kind="stable")
    return [(int(key[at[0]]), at) for at in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(at)]


def _dense(x: np.ndarray, ball: np.ndarray) -> bool:
    """Whether many pairs of some of a node's vectors link, besides those that a ball holds."""
    if len(x) < 32:
        return False
    x, ball = x[:: -(-len(x) // 128)], ball[:: -(-len(x) // 128)]
    near = x @ x.T >= COSINE
    near &= (ball[:, None] != ball) | (ball[:, None] == 0)
    np.fill_diagonal(near, False)
    return near.sum() >= DENSE * len(x) * (len(x) - 1)


def _fit(table: pa.Table) -> pa.Table:
    """Thresholds of the splits below one node; children of split k are 2k + 1 and 2k + 2.

    ``kind``: 0 a split, 1 one where vectors between the thresholds are dealt by a hash, 2 none.
    """
    table = table.combine_chunks().sort_by("vec_id")
    node, levels = table["node"][0].as_py(), table["levels"][0].as_py()
    x, ball, coin = _matrix(table["vec"].chunk(0)).astype(np.float32), table["ball"].to_numpy(), table["coin"].to_numpy()
    d = _directions(node, 2**levels - 1, x.shape[1])
    lo, hi, kind, rows = [0.0] * len(d), [0.0] * len(d), [0] * len(d), {0: np.arange(len(x))}
    for k in range(len(d)):
        at = rows.pop(k, np.zeros(0, np.int64))
        if not len(at):
            continue
        if _dense(x[at], ball[at]):
            kind[k] = 2
            continue
        p = x[at] @ d[k]
        lo[k], hi[k] = (float(v) for v in np.quantile(p, [0.5 - SPILL, 0.5 + SPILL]))
        kind[k] = int(((p >= lo[k]) & (p <= hi[k])).mean() > 0.5)
        left, right = _sides(p, np.float64(lo[k]), np.float64(hi[k]), np.int64(kind[k]), coin[at] >> k % 60 & 1)
        rows[2 * k + 1], rows[2 * k + 2] = at[left], at[right]
    return pa.table({"node": pa.array([node], pa.int64()), "lo": pa.array([lo], pa.list_(pa.float64())), "hi": pa.array([hi], pa.list_(pa.float64())), "kind": pa.array([kind], pa.list_(pa.int32()))})


def _sides(p, lo, hi, kind, coin):
    left, right = p <= hi, p >= lo
    dealt = (kind == 1) & left & right
    return (left | (kind == 1)) & ~(dealt & (coin == 1)), (right | (kind == 1)) & ~(dealt & (coin == 0))


def _route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector to the nodes below its own that it belongs to; ``whole`` where a node is split no more."""
    for batch in batches:
        for node, at in _grouped(batch.column("node").to_numpy()):
            part = batch.take(pa.array(at))
            x = _matrix(part.column("vec")).astype(np.float32)
            lo, hi, kind = (np.array(part.column(c)[0].as_py()) for c in ("lo", "hi", "kind"))
            p, coin = x @ _directions(node, len(lo), x.shape[1]).T, part.column("coin").to_numpy()
            row, split, done = np.arange(len(x)), np.zeros(len(x), np.int64), []
            for _ in range(int(np.log2(len(lo) + 1))):
                stays = kind[split] == 2
                done.append((row[stays], split[stays], np.ones(stays.sum(), bool)))
                row, split = row[~stays], split[~stays]
                left, right = _sides(p[row, split], lo[split], hi[split], kind[split], coin[row] >> split % 60 & 1)
                row, split = np.concatenate((row[left], row[right])), np.concatenate((2 * split[left] + 1, 2 * split[right] + 2))
            done.append((row, split, np.zeros(len(row), bool)))
            row, split, whole = (np.concatenate(z) for z in zip(*done))
            out = part.select(["vec_id", "copies", "ball", "rep", "coin", "vec"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(_child(node, split)), pa.array(whole)], ["vec_id", "copies", "ball", "rep", "coin", "vec", "node", "whole"])


def forest(vectors: DataFrame, space: Workspace) -> DataFrame:
    """``vectors`` (vec_id, copies, ball, rep, root, vec) as rows (.., vec, node, size), one for each leaf a vector is in."""
    columns = ["vec_id", "copies", "ball", "rep", "coin", "vec", "node"]
    rows = vectors.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(TREES)))).withColumn("node", F.xxhash64("root", "tree")).withColumn("coin", F.xxhash64("vec_id", F.lit("coin"))).select(*columns, F.lit(False).alias("whole"))
    schema = rows.schema
    done, k = None, 0
    while True:
        sizes = space.keep(rows.groupBy("node").agg(F.count("*").alias("size"), F.max("whole").alias("stop")), f"sizes-{k}")
        large = sizes.where((F.col("size") > 2 * LEAF) & ~F.col("stop")).select("node", "size")
        n_large, n_nodes = large.count(), sizes.count()
        ends = sizes.where((F.col("size") <= 2 * LEAF) | F.col("stop")).select("node", "size")
        leaves = rows.select(*columns).join(broadcast_if_small(ends, 2 * (n_nodes - n_large)), "node").select(*columns, "size")
        done = leaves if done is None else done.union(leaves)
        if not n_large:
            return done
        large = large.withColumn("levels", F.least(F.lit(LEVELS), F.ceil(F.log2(F.col("size") / (2 * LEAF)))).cast("int"))
        held = rows.join(broadcast_if_small(large, 3 * n_large), "node")
        # the chance of a row follows from its node's size, so that a sample is about as large for any node
        sample = held.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1_000_003)) * F.col("size") <= F.lit(SAMPLE * 1_000_003))
        splits = space.keep(sample.select("node", "vec_id", F.coalesce("ball", F.lit(0)).alias("ball"), "coin", "vec", "levels").groupBy("node").applyInArrow(_fit, "node long, lo array<double>, hi array<double>, kind array<int>"), f"splits-{k}")
        # broadcast is bounded by values, not rows: a node has up to 3 * 63 of them
        routed = rows.join(broadcast_if_small(splits, n_large * 192), "node").select(*columns, "lo", "hi", "kind").sortWithinPartitions("node").mapInArrow(_route, schema)
        k += 1
        rows = space.keep(routed, f"forest-{k}")


def _compare(table: pa.Table) -> pa.Table:
    """Links inside one leaf, or between two blocks of one: counts of the pairs that have no leaf before this, and a spanning forest."""
    table = table.combine_chunks().sort_by("vec_id")
    node, x = table["node"][0].as_py(), _matrix(table["vec"].chunk(0))
    near = x @ x.T >= COSINE
    np.fill_diagonal(near, False)
    ball, block = table["ball"].to_numpy(zero_copy_only=False), table["block"].to_numpy()
    near &= (ball[:, None] != ball) | (ball[:, None] == 0)
    if table["one"][0].as_py() != table["other"][0].as_py():
        near &= block[:, None] != block
    said = np.flatnonzero(near.any(1))
    near, rows = near[said][:, said], table.take(pa.array(said))
    n = len(said)
    rep, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
    # only leaves before this one matter
    each = [[v for v in leaves if v < node] for leaves in rows["leaves"].to_pylist()]
    width = max(map(len, each), default=0)
    none = np.iinfo(np.int64).max
    codes = np.full((n, width), none)
    for r, v in enumerate(each):
        codes[r, : len(v)] = v
    count = np.zeros(n, np.int64)
    a, b = np.nonzero(np.triu(near, 1))
    step = max(1, 4_000_000 // max(1, width * width))
    for s in range(0, len(a), step):
        i, j = a[s : s + step], b[s : s + step]
        before = np.zeros(len(i), bool)
        for c in range(width):
            v = codes[i, c][:, None]
            before |= ((codes[j] == v) & (v < none)).any(1)
        np.add.at(count, i[~before], copies[j[~before]])
        np.add.at(count, j[~before], copies[i[~before]])
    root, seen = np.arange(n), np.zeros(n, bool)
    for r in range(n):
        edge = np.array([] if seen[r] else [r], dtype=np.int64)
        while len(edge):
            seen[edge] = True
            root[edge] = r
            edge = np.flatnonzero(near[edge].any(0) & ~seen)
    return pa.table({"vec_id": rows["vec_id"], "links": count, "a": rep, "b": rep[root]})


def _balls(classes: DataFrame, space: Workspace, element: str) -> DataFrame:
    """``classes`` (vec_id, copies, root, vec) with the ball a vector is in, if any, its least vec_id and its number of vectors."""
    roots = classes.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") > 2 * LEAF)
    roots = space.keep(roots, "roots")
    held = classes.join(broadcast_if_small(roots, 2 * roots.count()), "root")
    sample = held.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1_000_003)) * F.col("size") <= F.lit(SAMPLE * 1_000_003))
    centres = sample.select("root", "vec_id", "vec").groupBy("root").applyInArrow(_centres, "root long, centres array<double>").where(F.size("centres") > 0)
    centres = space.keep(centres, "centres")
    values = centres.agg(F.coalesce(F.sum(F.size("centres")), F.lit(0))).first()[0]
    if not values:
        return classes.select("*", F.lit(None).cast("long").alias("ball"), F.col("vec_id").alias("rep"), F.lit(0).cast("long").alias("in_ball"))
    marked = classes.join(broadcast_if_small(centres, values), "root", "left").select("vec_id", "copies", "root", "vec", "centres").sortWithinPartitions("root")
    marked = space.keep(marked.mapInArrow(_in_ball, f"vec_id long, copies long, root long, vec array<{element}>, ball long"), "marked")
    balls = space.keep(marked.where("ball IS NOT NULL").groupBy("ball").agg(F.min("vec_id").alias("rep"), F.sum("copies").alias("in_ball")), "balls")
    marked = marked.join(broadcast_if_small(balls, 3 * balls.count()), "ball", "left")
    return marked.select("vec_id", "copies", "root", "vec", "ball", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("in_ball", F.lit(0)).alias("in_ball"))


def link_vectors(vectors: DataFrame) -> DataFrame:
    """``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept for each row."""
    spark = vectors.sparkSession
    batches_of(spark)
    space = Workspace(spark, "vectors")
    element = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("vec"), "label")
    x = "coalesce(x, double('nan'))"
    fine = F.expr(f"label IS NOT NULL AND vec_id IS NOT NULL AND size(vec) > 0 AND forall(vec, x -> NOT isnan({x}) AND abs({x}) < double('inf')) AND exists(vec, x -> x <> 0)")
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("root", F.when(F.col("fine"), F.xxhash64("label", F.size("vec"))))
    good = rows.where("fine")
    classes = space.keep(good.groupBy("root", "vec").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")).select("vec_id", "copies", "root", "vec"), "classes")
    balled = space.keep(_balls(classes, space, element), "balled")
    leaves = space.keep(forest(balled, space), "leaves")
    lists = leaves.groupBy("vec_id").agg(F.sort_array(F.collect_set("node")).alias("leaves"))
    # a group is a leaf of at most 2 * LEAF vectors, or two blocks of about LEAF vectors of a node that is compared whole
    parts = F.greatest(F.ceil(F.col("size") / (2 * LEAF)), F.lit(1)).cast("int")
    dealt = leaves.join(lists, "vec_id").withColumn("block", F.when(F.col("size") > 2 * LEAF, F.pmod(F.xxhash64("vec_id", "node"), 2 * parts)).otherwise(0).cast("int"))
    every = F.when(F.col("size") > 2 * LEAF, F.sequence(F.lit(0), 2 * parts - 1)).otherwise(F.array(F.lit(0)))
    dealt = dealt.withColumn("with", F.explode(every)).select("vec_id", "copies", F.coalesce("ball", F.lit(0)).alias("ball"), "rep", "vec", "leaves", "node", "block", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"))
    found = space.keep(dealt.groupBy("node", "one", "other").applyInArrow(_compare, "vec_id long, links long, a long, b long"), "found")
    linked = components(found.select("a", "b"), space)
    own = F.when(F.col("in_ball") > 0, F.col("in_ball")).otherwise(F.col("copies")) - 1
    per_class = balled.select("vec_id", "copies", "rep", "in_ball", "root", "vec").join(found.groupBy("vec_id").agg(F.sum("links").alias("links")), "vec_id", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = space.keep(per_class.select("root", "vec", (F.coalesce("links", F.lit(0)) + own).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "per-class")
    out = good.join(per_class, ["root", "vec"]).select("vec_id", "n_links", "component_id")
    out = out.union(rows.where("NOT fine").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
