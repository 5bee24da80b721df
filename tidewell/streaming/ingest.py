"""Streaming ingest into Bronze tables, with a supervisor."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.schemas import bronze_table_of
from tidewell.sources.wire import project_bronze
from tidewell.table.managed import CARRIED, ManagedTable

MAX_RESTARTS, FIRST_BACKOFF, LONGEST_BACKOFF, STABLE_SECONDS = 5, 10, 160, 600
LANDING = "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"


def kafka_stream(spark: SparkSession, servers: str, topics: list[str], max_per_trigger: int = 20_000) -> DataFrame:
    """Records of a broker; needs Spark's Kafka package on the class path."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    return r.option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", max_per_trigger).load()


def file_stream(spark: SparkSession, path: str, max_files: int = 4) -> DataFrame:
    """The same records from Parquet files that land in a folder."""
    return spark.readStream.schema(LANDING).option("maxFilesPerTrigger", max_files).parquet(path)


def epoch_mark(query: str, epoch: int) -> dict[str, str]:
    """What the snapshot of an epoch's rows records; every later snapshot carries it on, whatever made it."""
    return {f"{CARRIED}{query}": str(epoch)}


def has_epoch(table: ManagedTable, query: str, epoch: int) -> bool:
    """Whether the table holds the epoch's rows. Epochs of a query only grow, so a query that starts over from a new
    checkpoint needs a new name."""
    return int(table.snapshot()["summary"].get(f"{CARRIED}{query}", -1)) >= epoch


def router(tables: dict[str, ManagedTable], query: str, unrouted: ManagedTable | None = None) -> Callable[[DataFrame, int], None]:
    """Appends each topic's rows of a batch to its table. A batch that ran before, for a table that has it, is skipped:
    the snapshots record query and epoch, so a restart neither loses nor repeats rows. Rows of other topics, or of none,
    go to ``unrouted`` if it is given, and are left out otherwise."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            present = {r["topic"] for r in batch.select("topic").distinct().collect()}  # the topics subscribed to
            known = [t for t in sorted(present, key=str) if bronze_table_of(t or "") in tables]
            parts = [(tables[bronze_table_of(t)], F.col("topic") == t) for t in known]
            if unrouted and len(known) < len(present):
                parts.append((unrouted, ~F.coalesce(F.col("topic").isin(known), F.lit(False))))
            for table, mine in parts:
                if not has_epoch(table, query, epoch):
                    table.append(batch.where(mine), epoch_mark(query, epoch))
        finally:
            batch.unpersist()

    return write


def start(stream: DataFrame, tables: dict[str, ManagedTable], checkpoint: str, query: str = "bronze", every: str | None = "60 seconds", unrouted: ManagedTable | None = None):
    """Starts the ingest; ``every`` None takes what is there and stops."""
    w = project_bronze(stream).writeStream.foreachBatch(router(tables, query, unrouted)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def supervise(launch: Callable, alert: Callable[[str], None] = print, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> int:
    """Runs queries made by ``launch`` until one ends by itself; returns the number of restarts.

    A failed query is started again from its checkpoint after 10, 20, 40, 80 and 160 seconds; one that lasted 600 seconds
    or more resets the count. When the restarts are used up, alerts and raises. A failing alert never ends the job.
    """
    failures = restarts = 0
    while True:
        began = clock()
        try:
            launch().awaitTermination()
            return restarts
        except StreamingQueryException as e:
            if clock() - began >= STABLE_SECONDS:
                failures = 0
            failures += 1
            if failures > MAX_RESTARTS:
                try:
                    alert(f"ingest failed {failures} times: {str(e)[:300]}")
                except Exception:  # noqa: BLE001 - the first error matters more
                    pass
                raise
            restarts += 1
            sleep(min(FIRST_BACKOFF * 2 ** (failures - 1), LONGEST_BACKOFF))
