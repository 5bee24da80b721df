"""Consolidating many small files: frozen manifest, first-fit decreasing, verified rewrite, atomic commit."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import materialise, scratch, shipped
from tidewell.table.files import create_json, make_dirs, read_json

SMALL_BYTES = 16_384
MIN_FILES = 5
TARGET_BYTES = 128 * 1024 * 1024
#: Files that one task packs; a partition with more of them is packed in blocks.
BLOCK_FILES = 20_000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size. A size beyond the capacity gets a bin of its own.

    A tree over the bins' free space finds the first bin that fits in logarithmic time.
    """
    n = len(sizes)
    width = 1 << max(0, int(n - 1).bit_length())
    free = np.full(2 * width, capacity, dtype=np.int64)
    out = np.empty(n, dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        s = min(int(sizes[i]), capacity)
        k = 1
        while k < width:
            k *= 2
            if free[k] < s:
                k += 1
        out[i] = k - width
        free[k] -= s
        while k > 1:
            k //= 2
            free[k] = max(free[2 * k], free[2 * k + 1])
    return out


def frozen_manifest(listing: DataFrame, records: DataFrame, on: dict[str, str], path: str = "file_path") -> DataFrame:
    """Each listed file once, if the table holds rows of it; written down, so that later listings change nothing.

    ``on`` maps the columns of ``records`` that tell a row's file to those of ``listing``. Empty files and files never
    committed have no rows and stay out. Nulls in these columns match no file.
    """
    once = listing.where(F.col(path).isNotNull()).groupBy(path).agg(*(F.max(c).alias(c) for c in listing.columns if c != path))
    held = records.groupBy(*on).agg(F.count(F.lit(1)).alias("rows_held")).select("rows_held", *(F.col(a).alias(b) for a, b in on.items()))
    return materialise(once.join(held, list(on.values())), "manifest")


def candidates(manifest: DataFrame, partition: list[str], size: str = "file_size_in_bytes", min_files: int = MIN_FILES, small: int = SMALL_BYTES) -> DataFrame:
    """Partitions with more than ``min_files`` files that are smaller than ``small`` on average."""
    per = manifest.groupBy(*partition).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))
    return per.where((F.col("files") > min_files) & (F.col("bytes") < F.col("files") * small))


def plan_bins(manifest: DataFrame, chosen: DataFrame, partition: list[str], on: list[str], size: str = "file_size_in_bytes", target: int = TARGET_BYTES, block: int = BLOCK_FILES) -> DataFrame:
    """``(on..., block, bin)``: the bin that the rows of each file of the chosen partitions go to, packed within a partition.

    Files that share all of ``on``, as when one task rolls over to a second file, can't be told apart by their rows; they
    are packed as one. A task packs at most about ``block`` files; a partition with more is packed in blocks by the hash
    of ``on``, which costs at most one half-full bin a block.
    """
    shipped(manifest.sparkSession)
    files = manifest.groupBy(*on).agg(F.sum(size).alias("__size")).join(chosen.select(*partition, F.col("files").alias("__files")), partition)
    blocks = F.pmod(F.xxhash64(*on), F.ceil(F.col("__files") / block)).cast("int")
    files = files.select(*on, "__size", blocks.alias("block"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "__size") + ", bin bigint"

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(on, kind="stable").reset_index(drop=True)
        return pdf.assign(bin=first_fit_decreasing(pdf["__size"].fillna(0).to_numpy(np.int64), target)).drop(columns="__size")

    return files.groupBy(*partition, "block").applyInPandas(pack, schema)


def checksum(columns: list[str]) -> list:
    """Row count and two sums of row hashes: equal for equal multisets of rows in any order, sensitive to repeats."""
    h = F.xxhash64(*columns)
    return [F.count(F.lit(1)).alias("n"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("lo"), F.sum(F.shiftrightunsigned(h, 32)).alias("hi")]


def compact(spark: SparkSession, listing: DataFrame, records: DataFrame, partition: list[str], on: dict[str, str], root: str | None = None, min_files: int = MIN_FILES, small: int = SMALL_BYTES, target: int = TARGET_BYTES) -> DataFrame:
    """Rewrites the partitions with too many small files; returns one row for each rewritten partition.

    Columns: ``partition``, ``files_before``, ``files_after``, ``n_records``. The rows of all bins are written in one
    job, each bin to one file; then rows and files are counted and checksums compared for every partition against the
    source. Only if all agree a version is committed that names the manifest of the table from now on: every new file,
    and every live file of the partitions left alone (``live_files`` reads it). The version either appears whole or, if
    another writer was first, not at all. A failure before that leaves the table as it was. Null keys and sizes are
    allowed: the former match no file, the latter count as 0. Without files or rows nothing is rewritten.
    """
    manifest = frozen_manifest(listing, records, on)
    chosen = materialise(candidates(manifest, partition, min_files=min_files, small=small), "candidates")
    bins = plan_bins(manifest, chosen, partition, list(on.values()), target=target)
    columns = records.columns
    match = [records[a] == bins[b] for a, b in on.items()]
    moved = records.join(bins, match).select(*(records[c] for c in columns), F.concat_ws("-", bins["block"], bins["bin"]).alias("__bin"))
    root = root or scratch(spark, "compacted")
    data = f"{root}/data/{uuid.uuid4().hex}"
    # rows of one bin, at most a target file, meet in one task; it writes them to one file
    moved.repartition(*(F.col(c) for c in partition), "__bin").sortWithinPartitions(*partition, "__bin").write.partitionBy(*partition, "__bin").parquet(data)
    written = spark.read.schema(moved.schema).parquet(data).withColumns({"__file": F.col("_metadata.file_path"), "__bytes": F.col("_metadata.file_size")})
    before = records.join(chosen.select(*partition), partition, "left_semi").groupBy(*partition).agg(*checksum(columns))
    added = materialise(written.groupBy(*partition, "__file", "__bytes").agg(*checksum(columns)), "added-files")
    after = added.groupBy(*partition).agg(*(F.sum(c).alias(f"{c}_after") for c in ("n", "lo", "hi")), F.count(F.lit(1)).alias("files_after"))
    both = before.join(after, partition, "left")
    both = both.join(chosen.select(*partition, F.col("files").alias("files_before")), partition)
    report = materialise(both, "verified")
    wrong = report.where(~(F.col("n").eqNullSafe(F.col("n_after")) & F.col("lo").eqNullSafe(F.col("lo_after")) & F.col("hi").eqNullSafe(F.col("hi_after")))).limit(5).collect()
    if wrong:
        raise RuntimeError(f"rewritten rows differ, nothing is committed: {wrong}")
    _commit(spark, root, manifest, chosen, added, partition, report.count())
    return report.select(*partition, "files_before", "files_after", F.col("n").alias("n_records"))


def _commit(spark: SparkSession, root: str, manifest: DataFrame, chosen: DataFrame, added: DataFrame, partition: list[str], rewritten: int) -> None:
    """Version 1 on top of the listing. The manifest is written by tasks, as it may name millions of files; the driver
    writes only its name."""
    kept = manifest.join(chosen.select(*partition), partition, "left_anti")
    live = kept.select(*partition, "file_path", F.col("file_size_in_bytes").alias("bytes"), F.col("rows_held").alias("records"), F.lit(False).alias("rewritten"))
    live = live.unionByName(added.select(*partition, F.col("__file").alias("file_path"), F.col("__bytes").alias("bytes"), F.col("n").alias("records"), F.lit(True).alias("rewritten")))
    make_dirs(spark, f"{root}/metadata")
    name = f"{root}/metadata/manifest-{uuid.uuid4().hex}"
    live.write.parquet(name)
    create_json(spark, f"{root}/metadata/v1.json", {"operation": "replace", "manifest": name, "rewritten_partitions": rewritten})


def live_files(spark: SparkSession, root: str) -> DataFrame:
    """``(partition..., file_path, bytes, records, rewritten)``: the files of the committed table."""
    return spark.read.parquet(read_json(spark, f"{root}/metadata/v1.json")["manifest"])
