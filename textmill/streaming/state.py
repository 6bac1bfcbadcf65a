"""Streams with keyed state: the newest events, and reuse of results with an expiry, kept in the state store.

State lives in RocksDB files under the checkpoint, so a restarted query goes on where it stopped, and what a
query holds can be read back as a table without a version of its own for each batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textmill.plans import analytics

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys that the newest events are dealt to: the state holds so many times the capacity.
SLOTS = 16
EVENT = "ts timestamp, event_id long, provider string, applied boolean"


class Newest(StatefulProcessor):
    """The n newest events of a key, in a list that never grows beyond them."""

    def __init__(self, n: int, ttl_ms: int | None = None) -> None:
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("newest", EVENT, self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        for part in rows:
            best += list(part[["ts", "event_id", "provider", "applied"]].itertuples(index=False, name=None))
            best = sorted(set(best), key=lambda r: (r[0], r[1]), reverse=True)[: self.n]
        self.kept.put([(pd.Timestamp(t).to_pydatetime(), int(i), p, bool(a)) for t, i, p, a in best])
        yield pd.DataFrame({"slot": [key[0]], "held": [len(best)]})

    def close(self) -> None:
        pass


class Remembered(StatefulProcessor):
    """The first event of each content; later ones are hits until it expires, ttl_ms after it was stored."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "event_id long", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ids = pd.concat([part["event_id"] for part in rows]).sort_values().to_numpy()  # the numbers of one key in one batch of files
        known = self.first.exists()
        if not known:
            self.first.update((int(ids[0]),))
        yield pd.DataFrame({"digest": key[0], "event_id": ids, "first_id": self.first.get()[0], "hit": [known or i > 0 for i in range(len(ids))]})

    def close(self) -> None:
        pass


def in_state(grouped: Any, processor: Newest | Remembered, schema: str) -> DataFrame:
    return grouped.transformWithStateInPandas(processor, schema, "Update", "ProcessingTime" if processor.ttl_ms else "None")


#: State goes to RocksDB; a query whose state expires would otherwise run empty batches for ever, to look at its clock.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def started(result: DataFrame, checkpoint: str, folder: str | None = None) -> StreamingQuery:
    """The query over what is there; its rows go to a folder, a part for each batch, or nowhere, if only its state counts. A query keeps the settings that it starts with."""

    def put(batch: DataFrame, epoch: int) -> None:
        if folder:
            batch.write.mode("overwrite").parquet(f"{folder}/batch={epoch}")
        else:
            batch.write.format("noop").mode("overwrite").save()

    conf = result.sparkSession.conf
    before = {k: conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            conf.set(k, v)
        return result.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def keep_newest(stream: DataFrame, checkpoint: str, n: int = analytics.CAPACITY, ttl_ms: int | None = None, slots: int = SLOTS) -> StreamingQuery:
    """Keeps the n newest events of each slot in state; see newest()."""
    rows = stream.select(F.pmod(F.xxhash64("event_id"), F.lit(slots)).alias("slot"), "ts", "event_id", "provider", "applied")
    return started(in_state(rows.groupBy("slot"), Newest(n, ttl_ms), "slot long, held long"), checkpoint)


def newest(spark: SparkSession, checkpoint: str, n: int = analytics.CAPACITY) -> DataFrame:
    """The n newest of all events that a query of keep_newest() holds now, read from its state alone."""
    held = spark.read.format("statestore").option("stateVarName", "newest").option("flattenCollectionTypes", "true").load(checkpoint)
    return analytics.recent(held.select("list_element.*"), n)


def reuse(stream: DataFrame, text: str, checkpoint: str, folder: str, ttl_ms: int | None = None) -> StreamingQuery:
    """digest, event_id, first_id and hit of each event: whether its content was met before and has not expired since."""
    rows = stream.select(F.sha2(text, 256).alias("digest"), "event_id")
    return started(in_state(rows.groupBy("digest"), Remembered(ttl_ms), "digest string, event_id long, first_id long, hit boolean"), checkpoint, folder)
