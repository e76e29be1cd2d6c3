"""A bounded seen-set in front of a stream: what it remembers is a fixed number of ids a shard, whatever the stream's length."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed value: ids that are remembered, over all shards; beyond it the older half goes.
MOST = 20_000
SHARDS = 64
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shard_of(platform: Column, record_id: Column, shards: int) -> Column:
    """The shard of a record, from the md5 of ``platform:id``."""
    key = F.concat(F.coalesce(platform, F.lit("unknown")), F.lit(":"), F.coalesce(record_id, F.lit("")))
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def remember(ids: list[str], known: set[str], key: str, most: int) -> bool:
    """A new ``key`` joins the remembered ones (``ids``, oldest first, and as a set); whether the older half had to go, beyond ``most``."""
    ids.append(key)
    known.add(key)
    if len(ids) <= most:
        return False
    del ids[: most // 2]
    return True


class SeenSet(StatefulProcessor):
    """State of one shard: its remembered ids in order. Rows of a micro-batch are taken by partition and offset; bad ones pass."""

    def __init__(self, most: int, columns: list[str]):
        self.most, self.columns = most, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ids", "ids array<string>")

    def handleInputRows(self, key: Any, rows: Iterable[Row], timer_values: Any) -> Iterator[Row]:
        ids = list(self.state.get()[0]) if self.state.exists() else []
        known = set(ids)
        for r in sorted(rows, key=lambda r: (r["partition"], r["offset"])):
            if r["error"] is None:
                name = f"{'unknown' if r['platform'] is None else r['platform']}:{r['id']}"
                if name in known:
                    continue
                if remember(ids, known, name, self.most):
                    known = set(ids)
            yield Row(**{c: r[c] for c in self.columns})
        self.state.update((ids,))

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession):
    """Stateful processors keep their state in RocksDB; the session's own choice comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    _ = spark.streams.active  # starts what tasks ask for their state, which a query over a table does not
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def first_seen(records: DataFrame, most: int = MOST, shards: int = SHARDS) -> DataFrame:
    """Of ``records`` (partition, offset, platform, id, error, ..) of a stream or a table those whose (platform, id) its shard doesn't remember.

    Rows with an error pass. A row's shard follows from its key, a bad row's from its offset, so
    bad rows are spread too. Start the query inside ``rocks``.
    """
    bad = F.pmod(F.xxhash64("partition", "offset"), F.lit(shards)).cast("int")
    keyed = records.withColumn("shard_", F.when(F.col("error").isNull(), shard_of(F.col("platform"), F.col("id"), shards)).otherwise(bad))
    return keyed.groupBy("shard_").transformWithState(SeenSet(max(1, most // shards), records.columns), records.schema, "Append", "None")
