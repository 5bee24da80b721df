"""The streaming form of late-event handling: per-source low watermarks with idle time-outs.

State that must outlive a batch is small or mergeable: the latest arrival of each source and the watermark reached (in a
file for every epoch; older ones are removed), and partial counts of the open periods (appended by day, summed when a
period closes, dropped when their day is over). Results go to three managed tables: ``partials``, ``closed`` (one final
row for each period and kind) and ``diverted``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.late_events import IDLE, LATENESS, PERIOD, periods
from tidewell.streaming.ingest import epoch_mark, has_epoch
from tidewell.table.files import CommitConflict, create_json, delete, make_dirs, names, read_json
from tidewell.table.managed import ManagedTable

PARTIALS = "period_start bigint, event_type string, n bigint, day bigint"
CLOSED = "period_start bigint, event_type string, n bigint, closed_at bigint"
DIVERTED = "event_id string, source string, event_type string, period_start bigint, arrival timestamp"
DAY = 86_400
KEPT_MARKS = 10


class LateEvents:
    """A ``foreachBatch`` function over events with ``event_id, source, event_type, event_timestamp, arrival``.

    Each source's watermark is its latest arrival less ``lateness``. A period closes when the low watermark, the least
    over the sources that aren't idle, has passed its end; a source is idle when the newest arrival of all is more than
    ``idle`` seconds ahead of its own. The low watermark never goes back, so a source that returns from idleness finds
    closed periods closed. Diverted are records beyond their source's bound and records of a closed period.
    """

    def __init__(self, spark: SparkSession, root: str, name: str = "late", period: int = PERIOD, lateness: int = LATENESS, idle: int = IDLE):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        self.period, self.lateness, self.idle = period, lateness, idle
        make_dirs(spark, f"{self.root}/marks")
        make = lambda n, ddl, by=None: ManagedTable.create_if_not_exists(spark, f"{self.root}/{n}", ddl, by)
        self.partials, self.closed, self.diverted = make("partials", PARTIALS, ["day"]), make("closed", CLOSED), make("diverted", DIVERTED)

    def _marks(self, before: int | None = None) -> dict:
        """``sources`` (latest arrival of each) and ``low`` (the watermark reached, or None) of the last epoch ``before``."""
        done = [e for e in self._epochs() if before is None or e < before]
        return read_json(self.spark, f"{self.root}/marks/{max(done):012d}.json") if done else {"sources": {}, "low": None}

    def _epochs(self) -> list[int]:
        return [int(n[:-5]) for n in names(self.spark, f"{self.root}/marks") if n.endswith(".json") and not n.startswith(".")]

    def _once(self, table: ManagedTable, df: DataFrame, epoch: int) -> None:
        if not has_epoch(table, self.name, epoch):
            table.append(df, epoch_mark(self.name, epoch))

    def low_watermark(self, marks: dict) -> int | None:
        """Epoch seconds up to which periods are closed: at least what was reached before."""
        now = max(marks["sources"].values(), default=None)
        if now is None:
            return marks["low"]
        low = min(m for m in marks["sources"].values() if now - m <= self.idle) - self.lateness
        return low if marks["low"] is None else max(low, marks["low"])

    def _open(self, low: int) -> DataFrame:
        """Partial counts of the periods that end after ``low``; other days aren't read."""
        first = (low - self.period) // DAY
        return self.partials.scan(where=lambda p: int(p["day"]) >= first).where(F.col("period_start") + self.period > low)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            earlier = self._marks(epoch)
            latest = batch.where(F.col("arrival").isNotNull()).groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.max(F.unix_seconds("arrival")).alias("at"))
            sources = dict(earlier["sources"])
            for r in latest.collect():  # the producers
                sources[r["s"]] = max(sources.get(r["s"], r["at"]), r["at"])
            shut = earlier["low"]
            p = periods(batch, period=self.period)
            own: Column = F.col("delay_us") > self.lateness * 1_000_000  # its source's watermark, at its arrival, is past the end
            beyond = own | (F.lit(False) if shut is None else F.col("period_start") + self.period <= shut)
            kept = p.where(~beyond).groupBy("period_start", "event_type").agg(F.count(F.lit(1)).alias("n"))
            self._once(self.diverted, p.where(beyond), epoch)
            self._once(self.partials, kept.withColumn("day", F.expr(f"(period_start - pmod(period_start, {DAY})) div {DAY}")), epoch)
            low = self.low_watermark({"sources": sources, "low": shut})
            if low is not None and low != shut:
                ripe = (self.partials.scan() if shut is None else self._open(shut)).where(F.col("period_start") + self.period <= low)
                final = ripe.groupBy("period_start", "event_type").agg(F.sum("n").alias("n")).withColumn("closed_at", F.lit(low + self.lateness))
                self._once(self.closed, final, epoch)
            try:
                create_json(self.spark, f"{self.root}/marks/{epoch:012d}.json", {"sources": sources, "low": low})
            except CommitConflict:
                pass  # this epoch ran before
            if low is not None:
                # days whose every period is closed are over; the marks of this epoch are down, so no rerun needs them
                self.partials.drop_partitions(lambda p: (int(p["day"]) + 1) * DAY + self.period <= low)
            for old in sorted(self._epochs())[:-KEPT_MARKS]:
                delete(self.spark, f"{self.root}/marks/{old:012d}.json")
        finally:
            batch.unpersist()

    def open_counts(self) -> DataFrame:
        """Counts so far of the periods that aren't closed."""
        low = self._marks()["low"]
        p = self.partials.scan() if low is None else self._open(low)
        return p.groupBy("period_start", "event_type").agg(F.sum("n").alias("n"))
