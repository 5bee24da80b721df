"""Exactly one copy of each message: an index of identifiers seen, as sorted arrays by hash prefix.

``IdentifierIndex`` lives in a shared folder. Each generation holds one sorted array of identifiers for each hash
prefix, in a folder of its own name; a generation counts only once a commit names it, so that tasks run twice, jobs lost
halfway and writers that were too late leave nothing but unnamed files. A batch is reduced to its distinct identifiers
first (combined on the map side: no group of copies is gathered), then the identifiers of one prefix, a bounded number,
are binary-searched in the arrays of the live generations; those not found are novel, and become the next run. From
``max_runs`` live runs on, they are merged into one.

Prefixes are the leading bits of a hash. Their number grows with the index: a generation with more bits finds its
identifiers in the arrays that older ones keep under fewer bits, until a merge cuts those anew.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import shipped
from tidewell.table.files import create_json, make_dirs, names, read_json

MAX_RUNS = 8
IDS_PER_PREFIX = 250_000
LEAST_BITS, MOST_BITS = 4, 24
RESULT = "id string, batch string, n bigint, first_at bigint, known boolean"


def _load(path: str) -> np.ndarray | None:
    import pyarrow.fs as pafs

    fs, p = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(p).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_file(p) as f:
        return np.load(f, allow_pickle=False)


def _save(path: str, run: np.ndarray) -> None:
    """Writes the array whole or not at all. A task run again makes the same array, so whichever comes first stays."""
    import pyarrow.fs as pafs

    fs, p = pafs.FileSystem.from_uri(path)
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    hidden = f"{p}.{uuid.uuid4().hex}"
    with fs.open_output_stream(hidden) as f:
        np.save(f, run, allow_pickle=False)
    try:
        fs.move(hidden, p)
    except OSError:
        if fs.get_file_info(p).type == pafs.FileType.NotFound:
            raise
        fs.delete_file(hidden)


def contains(run: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of ``ids`` the sorted ``run`` holds, by binary search."""
    if not len(run):
        return np.zeros(len(ids), dtype=bool)
    at = np.searchsorted(run, ids)
    return (at < len(run)) & (run[np.minimum(at, len(run) - 1)] == ids)


def merge_runs(runs: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(runs)) if runs else np.empty(0, dtype="S1")


def _runs(root: str, live: list[dict], prefix: int, bits: int) -> list[np.ndarray]:
    """The live arrays that hold identifiers of ``prefix``; those kept under fewer bits hold its neighbours' as well."""
    found = (_load(f"{root}/runs/{g['name']}/{prefix >> (bits - g['bits'])}.npy") for g in live)
    return [r for r in found if r is not None]


def _of_prefix(run: np.ndarray, prefix: int, bits: int) -> np.ndarray:
    """The identifiers of ``run`` that belong to ``prefix``; the last byte isn't theirs."""
    mine = np.fromiter((zlib.crc32(x[:-1]) >> (32 - bits) == prefix for x in run.tolist()), dtype=bool, count=len(run))
    return run[mine]


class IdentifierIndex:
    def __init__(self, spark: SparkSession, root: str, bits: int = LEAST_BITS, max_runs: int = MAX_RUNS, ids_per_prefix: int = IDS_PER_PREFIX):
        self.spark, self.root = shipped(spark), root
        self.max_runs, self.ids_per_prefix = max_runs, ids_per_prefix
        make_dirs(spark, f"{root}/commits")
        done = [n for n in names(spark, f"{root}/commits") if n.endswith(".json") and not n.startswith(".")]
        last = read_json(spark, f"{root}/commits/{done[-1]}") if done else {"version": 0, "live": [], "bits": bits}
        self.version, self.live, self.bits = last["version"], last["live"], last["bits"]

    def ingest(self, df: DataFrame, ident: Column, batch: Column, order: Column) -> DataFrame:
        """``(id, batch, n, first_at, known)`` for each identifier of each batch, and a commit of the new identifiers.

        ``n`` copies came in the batch, the first at ``order`` (a bigint); ``known`` tells that an earlier batch, of this
        call or before, had the identifier already. Batches count in the order of their names. Rows without identifier
        are left out; a null batch comes first, as the empty name. A call that fails leaves the index as it was, and can
        be made again; of two writers at a time one fails.
        """
        rows = df.select(ident.alias("id"), F.coalesce(batch.cast("string"), F.lit("")).alias("batch"), order.cast("bigint").alias("at")).where(F.col("id").isNotNull())
        local = rows.groupBy("id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
        held = sum(g["ids"] for g in self.live) + df.count()  # at most so many identifiers from here on
        bits = min(MOST_BITS, max(self.bits, int(held / self.ids_per_prefix).bit_length()))
        live, root, name = list(self.live), self.root, uuid.uuid4().hex
        merging = len(live) + 1 >= self.max_runs
        base = f"{root}/runs/{name}"

        def probe(pdf: pd.DataFrame) -> pd.DataFrame:
            prefix = int(pdf["prefix"].iloc[0])
            # sorted by batch, then identifier: each batch is a slice
            pdf = pdf.sort_values(["batch", "id"], kind="stable").reset_index(drop=True)
            old = _runs(root, live, prefix, bits)
            ids = np.array([x.encode() + b"." for x in pdf["id"]], dtype=bytes)  # the dot keeps the end from being stripped
            runs, known = list(old), np.zeros(len(ids), dtype=bool)
            cuts = np.flatnonzero(np.r_[True, pdf["batch"].to_numpy()[1:] != pdf["batch"].to_numpy()[:-1], True])
            new: list[np.ndarray] = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = ids[a:b]
                seen = np.zeros(len(part), dtype=bool)
                for r in runs:
                    seen |= contains(r, part)
                known[a:b] = seen
                new.append(np.unique(part[~seen]))
                if len(new) >= MAX_RUNS:
                    new = [merge_runs(new)]
                runs = old + new
            kept = [_of_prefix(r, prefix, bits) for r in old] if merging else []
            _save(f"{base}/{prefix}.npy", merge_runs(kept + new))
            return pdf.assign(known=known)[["id", "batch", "n", "first_at", "known"]]

        prefixed = local.withColumn("prefix", F.shiftright(F.crc32(F.col("id").cast("binary")), 32 - bits).cast("int"))
        result = prefixed.groupBy("prefix").applyInPandas(probe, RESULT)
        path = f"{root}/results/{name}"
        result.write.parquet(path)  # the runs are complete once this is
        if merging:
            self._carry(live, name, bits)
        result = self.spark.read.schema(RESULT).parquet(path)
        novel = result.where(~F.col("known")).count()
        now = {"name": name, "bits": bits, "ids": novel + (sum(g["ids"] for g in live) if merging else 0)}
        commit = {"version": self.version + 1, "live": [now] if merging else [*live, now], "bits": bits}
        create_json(self.spark, f"{root}/commits/{commit['version']:012d}.json", commit)
        self.version, self.live, self.bits = commit["version"], commit["live"], bits
        return result

    def ingest_slices(self, df: DataFrame, ident: Column, batch: Column, order: Column, slices: int) -> DataFrame:
        """``ingest`` of consecutive batches, about the same number of rows at a time; results of all calls in one."""
        name = F.coalesce(batch.cast("string"), F.lit(""))
        sizes = sorted((r["b"], r["n"]) for r in df.groupBy(name.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a batch
        total, seen, bounds = sum(n for _, n in sizes), 0, []
        for b, n in sizes:
            if seen >= total * (len(bounds) + 1) / slices:
                bounds.append(b)
            seen += n
        parts = []
        for lo, hi in zip([None, *bounds], [*bounds, None]):
            inside = (F.lit(True) if lo is None else name >= lo) & (F.lit(True) if hi is None else name < hi)
            parts.append(self.ingest(df.where(inside), ident, batch, order))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _carry(self, live: list[dict], name: str, bits: int) -> None:
        """Merges the runs of the prefixes that the batch didn't touch."""
        root = self.root

        def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for k in map(int, pdf["id"]):
                    if _load(f"{root}/runs/{name}/{k}.npy") is None and (old := _runs(root, live, k, bits)):
                        _save(f"{root}/runs/{name}/{k}.npy", merge_runs([_of_prefix(r, k, bits) for r in old]))
                yield pdf.iloc[:0]

        self.spark.range(0, 1 << bits, 1, min(1 << bits, 256)).mapInPandas(carry, "id bigint").count()


def copies(result: DataFrame) -> DataFrame:
    """Identifiers with more than one copy, whether in one batch or across batches."""
    return result.where((F.col("n") > 1) | F.col("known")).select("id").distinct()


def kept(result: DataFrame) -> DataFrame:
    """``(id, batch, first_at)`` of the one copy to keep: the first of the first batch that has it."""
    return result.where(~F.col("known")).select("id", "batch", "first_at")


def kept_rows(df: DataFrame, result: DataFrame, ident: Column, batch: Column, order: Column, ties: tuple[str, ...] = ()) -> DataFrame:
    """The whole rows to keep of ``df``, whose ``result`` came from ``ingest``, with their bare identifier as ``__id``.

    Of each identifier that no earlier call knew, the row first by batch and ``order``; one without order comes last.
    Equal rows in that are told apart by ``ties``, then by all other columns, nulls first. A row without identifier is
    kept as it is.
    """
    rest = [c for c in df.columns if c not in ties]
    at = order.cast("bigint")
    rank = F.struct(at.isNull().alias("__late"), F.coalesce(batch.cast("string"), F.lit("")).alias("__batch"), at.alias("__at"), *ties, *rest)
    known = df.where(ident.isNotNull()).groupBy(ident.alias("__id")).agg(F.min(rank).alias("__r"))
    novel = kept(result).select(F.col("id").alias("__id"))
    known = known.join(novel, "__id", "left_semi").select("__id", *(F.col(f"__r.{c}").alias(c) for c in df.columns))
    alone = df.where(ident.isNull()).select(F.lit(None).cast("string").alias("__id"), *df.columns)
    return known.unionByName(alone)
