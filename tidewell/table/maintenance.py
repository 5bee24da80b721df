"""Upkeep of managed tables: compaction, snapshot expiry, orphan removal, always in this order."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from tidewell.operators.compaction import checksum, first_fit_decreasing
from tidewell.table.files import CommitConflict, delete, walk
from tidewell.table.managed import ManagedTable, short

OPERATIONS = ("compact", "expire", "orphan")


COMMIT_BYTES = 8 * 1024**3
#: Files of a commit up to which the plan is sent to all tasks: about 20 MB.
BROADCAST_FILES = 200_000


def compact(table: ManagedTable, min_input_files: int = 5, max_commits: int = 10) -> dict:
    """Bin-packs the files below the target size of each partition with at least ``min_input_files`` of them.

    Partial progress: partitions go in up to ``max_commits`` commits of some gigabytes each; one that meets a conflict is
    left for the next run. All bins of a commit are written by one job, and rows and checksums compared before it.
    """
    spark, target = table.spark, table.properties["target-bytes"]
    base = table.snapshot()
    groups: dict[tuple, list[dict]] = {}
    for e in table._entries(base):
        if e["bytes"] < target * 0.75:
            groups.setdefault(tuple(sorted(e["partition"].items(), key=str)), []).append(e)
    todo = [g for _, g in sorted(groups.items(), key=str) if len(g) >= min_input_files]
    total = sum(e["bytes"] for g in todo for e in g)
    commits = max(1, min(max_commits, len(todo), -(-total // COMMIT_BYTES)))
    before = after = failed = 0
    for chunk in np.array_split(np.arange(len(todo)), commits):
        files = [e for k in chunk for e in todo[k]]
        if not files:
            continue
        bins = [(short(e["path"]), int(b)) for k in chunk for e, b in zip(todo[k], first_fit_decreasing(np.array([e["bytes"] for e in todo[k]]), target))]
        old = table._read([e["path"] for e in files])
        plan = spark.createDataFrame(bins, "__short string, __bin int")
        if len(bins) <= BROADCAST_FILES:  # a row a file
            plan = F.broadcast(plan)
        placed = old.withColumn("__short", F.substring_index(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), "/data/", -1)).join(plan, "__short")
        added = table._stage(placed, F.col("__bin"))
        new = table._read([e["path"] for e in added])
        if old.agg(*checksum(old.columns)).first() != new.agg(*checksum(new.columns)).first():
            raise RuntimeError(f"{table.name}: compacted rows differ")
        try:
            table._commit(base, "replace", added, {e["path"] for e in files})
            before, after = before + len(files), after + len(added)
        except CommitConflict:
            failed += len(chunk)
    return {"rewritten_files": before, "added_files": after, "failed_partitions": failed}


def expire(table: ManagedTable, older_than_ms: int, retain_last: int = 5) -> dict:
    """Drops snapshots older than ``older_than_ms`` but for the last ones, and the files only they name."""
    versions = table.versions()
    snaps = {v: table.snapshot(v) for v in versions}
    kept = set(versions[-max(1, retain_last):]) | {v for v in versions if snaps[v]["committed_at"] >= older_than_ms}
    gone = [v for v in versions if v not in kept]
    live_manifests = {m for v in kept for m in snaps[v]["manifests"]}
    live_files = {e["path"] for v in kept for e in table._entries(snaps[v])}
    dead_files = {e["path"] for v in gone for e in table._entries(snaps[v])} - live_files
    dead_manifests = {m for v in gone for m in snaps[v]["manifests"]} - live_manifests
    for v in gone:  # snapshots first: no reader finds one whose files are gone
        delete(table.spark, f"{table.root}/metadata/v{v}.json")
    for m in dead_manifests:
        delete(table.spark, f"{table.root}/manifests/{m}")
    for p in dead_files:
        delete(table.spark, p)
    return {"expired_snapshots": len(gone), "deleted_files": len(dead_files)}


def remove_orphans(table: ManagedTable, older_than_hours: float = 72, now_ms: int | None = None) -> dict:
    """Deletes files that no snapshot names and that are older than the limit, which is at least 24 hours, as younger
    ones may belong to a commit under way."""
    hours = max(24, older_than_hours)
    limit = (now_ms or int(time.time() * 1000)) - hours * 3_600_000
    named = {short(e["path"]) for v in table.versions() for e in table._entries(table.snapshot(v))}
    manifests = {m for v in table.versions() for m in table.snapshot(v)["manifests"]}
    dead = [p for p, _, ms in walk(table.spark, f"{table.root}/data") if short(p) not in named and ms < limit and not p.endswith("_SUCCESS")]
    dead += [p for p, _, ms in walk(table.spark, f"{table.root}/manifests") if p.rpartition("/")[2] not in manifests and ms < limit]
    for p in dead:
        delete(table.spark, p)
    return {"deleted_orphans": len(dead), "older_than_hours": hours}


def maintain(table: ManagedTable, ops: list[str], older_than_ms: int = 0, retain_last: int = 5, orphan_hours: float = 72, min_input_files: int = 5, dry_run: bool = False) -> dict:
    """Runs the named operations in the fixed order; unknown names are ignored; a dry run only reports figures."""
    before = table.metrics()
    if dry_run:
        return {"before": before, "after": before, "ran": []}
    run = {
        "compact": lambda: compact(table, min_input_files),
        "expire": lambda: expire(table, older_than_ms, retain_last),
        "orphan": lambda: remove_orphans(table, orphan_hours),
    }
    results = {o: run[o]() for o in OPERATIONS if o in ops}
    return {"before": before, "after": table.metrics(), "ran": list(results), **results}
