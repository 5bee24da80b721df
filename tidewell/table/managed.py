"""A transactional table on Parquet files: snapshots, upserts, deletes, partition overwrite, metadata tables.

Layout: ``metadata/v{N}.json`` is snapshot N, created without overwriting, so that of two writers one fails;
``manifests/*.json`` list data files with partition, size and row count; ``data/`` holds the files. A snapshot names its
manifests; commits that add files add a manifest, commits that remove files rewrite just the manifests that list them.
Readers take the files of one snapshot, pruned by partition, so they see one state whatever is committed meanwhile.

Partition columns stay in the data files as well; directories carry them under another name.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.conf import RuntimeConfig

from tidewell.table.files import CommitConflict, create_json, delete, make_dirs, names, read_json

TARGET_BYTES = 128 * 1024 * 1024
RETRIES = 5
#: Summary entries that every later snapshot takes over from the one before.
CARRIED = "epoch."
#: A row in a shuffle takes about so many times the bytes it takes in a file.
SHUFFLED = 2
NULL_NAME = "__HIVE_DEFAULT_PARTITION__"


def short(path: str) -> str:
    """A data file's path below the table's folder, the same for both spellings that Spark and Hadoop give it."""
    return path.rpartition("/data/")[2]


class ManagedTable:
    def __init__(self, spark: SparkSession, root: str, name: str = ""):
        self.spark, self.root = spark, root.rstrip("/")
        self.name = name or self.root.rpartition("/")[2]
        info = read_json(spark, f"{self.root}/table.json")
        self.schema, self.partition, self.properties = info["schema"], info["partition"], info["properties"]

    # --- creation and snapshots ---

    @classmethod
    def create_if_not_exists(cls, spark: SparkSession, root: str, schema: str, partition: list[str] | None = None, properties: dict | None = None, name: str = "") -> ManagedTable:
        root = root.rstrip("/")
        for d in ("metadata", "manifests", "data"):
            make_dirs(spark, f"{root}/{d}")
        try:
            create_json(spark, f"{root}/table.json", {"schema": schema, "partition": partition or [], "properties": {"target-bytes": TARGET_BYTES} | (properties or {})})
        except CommitConflict:
            pass  # it exists
        return cls(spark, root, name)

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in names(self.spark, f"{self.root}/metadata") if n.startswith("v") and n.endswith(".json"))

    def snapshot(self, version: int | None = None) -> dict:
        if version is None:
            all_ = self.versions()
            if not all_:
                return {"version": 0, "manifests": [], "summary": {}}
            version = all_[-1]
        return read_json(self.spark, f"{self.root}/metadata/v{version}.json")

    def _entries(self, snapshot: dict) -> list[dict]:
        return [e | {"manifest": m} for m in snapshot["manifests"] for e in read_json(self.spark, f"{self.root}/manifests/{m}")]

    # --- reading ---

    def scan(self, where: Callable[[dict], bool] | None = None, version: int | None = None, at_least: dict[str, str] | None = None) -> DataFrame:
        """The rows of a snapshot, of the files whose partition values (a dict of texts) satisfy ``where``.

        ``at_least`` leaves out files whose greatest value of a column of the ``stats`` property is below the one given
        (as its text sorts, which dates and timestamps do), or null throughout. It prunes files; the filter on rows stays
        the caller's.
        """
        files = [
            e["path"] for e in self._entries(self.snapshot(version))
            if (where is None or where(e["partition"])) and all((e.get("max", {}).get(c, v) or "") >= v for c, v in (at_least or {}).items())
        ]
        return self._read(files)

    def view(self, name: str, **kw) -> None:
        """Registers the rows of ``scan(**kw)`` under a name for SQL, as of the snapshot of now."""
        self.scan(**kw).createOrReplaceTempView(name)

    def _read(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*files)

    # --- writing ---

    def _stage(self, df: DataFrame, group: Column | None = None) -> list[dict]:
        """Writes ``df`` to new files, which belong to no snapshot yet; their manifest entries.

        ``group`` numbers the file within its partition that a row goes to.
        """
        columns = self.spark.createDataFrame([], self.schema).columns
        base = f"{self.root}/data/{uuid.uuid4().hex}"
        tag = {f"_p_{c}": F.col(c) for c in self.partition} | ({} if group is None else {"_g": group})
        out, tags = df.select(*columns, *(c.alias(t) for t, c in tag.items())), list(tag)
        if group is not None:
            out = out.repartition(*tags)  # a group fits into one file
        else:
            out = out.hint("rebalance", *map(F.col, tags)) if tags else out.hint("rebalance")
        with self._advised(df.sparkSession.conf, coalesce=not tags):
            (out.write.partitionBy(*tags) if tags else out.write).parquet(base)
        stats = self.properties.get("stats", [])
        # rows are counted from footers: no column is read but those of the stats property
        written = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(base)
        read = written.groupBy(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_size").alias("__bytes"))
        entries = []
        for r in read.agg(F.count(F.lit(1)).alias("__n"), *(F.max(c).cast("string").alias(f"__max_{c}") for c in stats)).collect():  # a row a file
            path = f"{self.root}/data/{short(unquote(r['__file']))}"
            entries.append({"path": path, "bytes": r["__bytes"], "records": r["__n"], "partition": self._partition_of(path)} | ({"max": {c: r[f"__max_{c}"] for c in stats}} if stats else {}))
        return sorted(entries, key=lambda e: e["path"])

    def _partition_of(self, path: str) -> dict[str, str | None]:
        """The partition values of a new file, from the names of its folders."""
        named = dict(x.split("=", 1) for x in short(path).split("/") if "=" in x)
        value = {c: named[f"_p_{c}"] for c in self.partition}
        return {c: None if v == NULL_NAME else unquote(v) for c, v in value.items()}

    @contextlib.contextmanager
    def _advised(self, conf: RuntimeConfig, coalesce: bool) -> Iterator[None]:
        """Writes inside aim at files of the target size: AQE splits partitions beyond it and, if ``coalesce``, joins those
        below. ``conf`` is that of the written rows' session, which in a stream is one of its own. A partitioned table's need not be joined, as each of its partitions makes a file anyway."""
        want = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": str(int(self.properties["target-bytes"]) * SHUFFLED), "spark.sql.adaptive.coalescePartitions.enabled": str(coalesce).lower()}
        before = {k: conf.get(k, None) for k in want}
        for k, v in want.items():
            conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def _commit(self, base: dict, operation: str, added: list[dict], removed: set[str], extra: dict | None = None, replaces: Callable[[dict], bool] | None = None) -> dict:
        """A new snapshot on top of the newest. Fails if another commit removed one of the files to remove, or, for
        ``replaces``, added files that this one would have replaced."""
        known = {e["path"] for e in self._entries(base)} if (removed or replaces) else set()
        for _ in range(RETRIES):
            now = self.snapshot()
            live = self._entries(now) if (removed or replaces) else []
            if now["version"] != base["version"] and (removed or replaces):
                here = {e["path"] for e in live}
                if not removed <= here or (replaces and any(replaces(e["partition"]) for e in live if e["path"] not in known)):
                    raise CommitConflict(f"{self.name}: files changed since version {base['version']}")
            manifests = list(now["manifests"])
            if removed:
                hit = {e["manifest"] for e in live if e["path"] in removed}
                rest = [{k: v for k, v in e.items() if k != "manifest"} for e in live if e["manifest"] in hit and e["path"] not in removed]
                manifests = [m for m in manifests if m not in hit] + ([self._manifest(rest)] if rest else [])
            if added:
                manifests.append(self._manifest(added))
            gone = [e for e in live if e["path"] in removed]
            summary = {
                "added-data-files": str(len(added)), "deleted-data-files": str(len(gone)),
                "added-records": str(sum(e["records"] for e in added)), "deleted-records": str(sum(e["records"] for e in gone)),
            } | {k: v for k, v in now["summary"].items() if k.startswith(CARRIED)} | (extra or {})
            snap = {
                "version": now["version"] + 1, "snapshot_id": uuid.uuid4().hex, "parent": now["version"] or None, "committed_at": int(time.time() * 1000),
                "operation": operation, "summary": summary, "manifests": manifests,
            }
            try:
                create_json(self.spark, f"{self.root}/metadata/v{snap['version']}.json", snap)
                return snap
            except CommitConflict:
                continue
        raise CommitConflict(f"{self.name}: no commit in {RETRIES} tries")

    def _manifest(self, entries: list[dict]) -> str:
        name = f"{uuid.uuid4().hex}.json"
        create_json(self.spark, f"{self.root}/manifests/{name}", entries)
        return name

    def append(self, df: DataFrame, extra: dict | None = None) -> dict | None:
        base, added = self.snapshot(), self._stage(df)
        return self._commit(base, "append", added, set(), extra) if added else None

    def overwrite_partitions(self, df: DataFrame) -> dict | None:
        """Replaces the partitions that ``df`` has rows of, and no other."""
        base, added = self.snapshot(), self._stage(df)
        if not added:
            return None
        touched = [e["partition"] for e in added]
        replaces = lambda p: p in touched
        return self._commit(base, "overwrite", added, {e["path"] for e in self._entries(base) if replaces(e["partition"])}, replaces=replaces)

    def delete_where(self, predicate: Column) -> dict | None:
        """Removes the rows for which the predicate is true; rows for which it is null stay. Rewrites only files with matches."""
        base = self.snapshot()
        files = [e["path"] for e in self._entries(base)]
        hit = self._files_of(self._read(files).where(predicate), files)
        if not hit:
            return None
        added = self._stage(self._read(sorted(hit)).where(~F.coalesce(predicate, F.lit(False))))
        return self._commit(base, "delete", added, hit)

    def _files_of(self, rows: DataFrame, files: list[str]) -> set[str]:
        return self._named(rows.select(F.col("_metadata.file_path")).distinct(), files) if files else set()

    def _named(self, found: DataFrame, files: list[str]) -> set[str]:
        """Those of ``files`` that the rows of ``found`` name, no more than the driver lists anyway."""
        by_name = {short(p): p for p in files}
        return {by_name[short(unquote(r[0]))] for r in found.collect()} if files else set()

    def drop_partitions(self, where: Callable[[dict], bool]) -> dict | None:
        """Removes the files of the partitions whose values satisfy ``where``; no data is read."""
        base = self.snapshot()
        gone = {e["path"] for e in self._entries(base) if where(e["partition"])}
        return self._commit(base, "delete", [], gone) if gone else None

    def merge(self, source: DataFrame, key: str, ignore: tuple[str, ...] = ("updated_at",)) -> dict | None:
        """Upsert by ``key``: rows that differ in any column outside ``key`` and ``ignore`` (nulls equal) are replaced, new
        ones added, equal ones keep all of their old values. Nothing to change means no snapshot.

        Keys alone find the files that hold rows of the source; only those files are compared and, if a row of them
        changes, rewritten. A row whose partition moves leaves its old one. Two rows of ``source`` with one key raise
        ``ValueError`` and change nothing, as it isn't told which of them should stand; null keys match nothing and are
        added. Files that another writer adds meanwhile may hold the same keys, so that is a conflict.
        """
        base = self.snapshot()
        files = [e["path"] for e in self._entries(base)]
        columns = self.spark.createDataFrame([], self.schema).columns
        compared = [c for c in columns if c != key and c not in ignore]
        if not files:  # all rows are new
            added = self._stage(source)
            self._refuse_repeated(self._read([e["path"] for e in added]), key, added)
            return self._commit(base, "overwrite", added, set(), replaces=lambda _: True) if added else None
        work = f"{self.root}/data/_merge-{uuid.uuid4().hex}"
        try:
            source.select(*columns).write.parquet(f"{work}/source")
            source = self.spark.read.schema(self.schema).parquet(f"{work}/source")
            self._refuse_repeated(source, key)
            keys = self._read(files).select(key, F.col("_metadata.file_path").alias("__file"))
            near = self._named(keys.join(source.select(key), key, "left_semi").select("__file").distinct(), files)
            if not near:
                rows, hit = source, set()
                if source.isEmpty():
                    return None
            else:
                target = self._read(sorted(near))
                old = target.select(F.col(key).alias("__k"), F.struct(*compared).alias("__old"), F.col("_metadata.file_path").alias("__file"))
                both = source.join(old, source[key] == old["__k"], "left")
                same = F.col("__old").isNotNull()
                for c in compared:
                    same = same & F.col(c).eqNullSafe(F.col(f"__old.{c}"))
                both.where(~same).select(*columns, "__file").write.parquet(f"{work}/delta")
                delta = self.spark.read.parquet(f"{work}/delta")
                hit = self._named(delta.where(F.col("__file").isNotNull()).select("__file").distinct(), files)
                rows = delta.select(*columns)
                if hit:
                    changed = delta.where(F.col("__file").isNotNull()).select(key)
                    rows = self._read(sorted(hit)).join(changed, key, "left_anti").select(*columns).unionByName(rows)
                elif delta.isEmpty():
                    return None
            added = self._stage(rows)
        finally:
            delete(self.spark, work)
        return self._commit(base, "overwrite", added, hit, replaces=lambda _: True)

    def _refuse_repeated(self, source: DataFrame, key: str, staged: list[dict] | None = None) -> None:
        found = source.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(3).collect()
        if found:
            for e in staged or []:
                delete(self.spark, e["path"])
            raise ValueError(f"{self.name}: several source rows for one key, as {[r[key] for r in found]}")

    def changed_partitions(self, since: int, to: int | None = None) -> list[dict]:
        """Partitions that gained or lost files between two snapshots; 0 stands for the empty table."""
        files = lambda s: {e["path"]: e["partition"] for e in self._entries(s)}
        old = files(self.snapshot(since)) if since else {}
        new = files(self.snapshot(to))
        changed = [p for f, p in (*old.items(), *new.items()) if (f in old) != (f in new)]
        return [dict(x) for x in {tuple(sorted(p.items())) for p in changed}]

    # --- metadata tables ---

    def snapshots(self) -> DataFrame:
        rows = [self.snapshot(v) for v in self.versions()]
        data = [(r["version"], r["snapshot_id"], r["parent"], r["committed_at"], r["operation"], r["summary"]) for r in rows]
        df = self.spark.createDataFrame(data, "version bigint, snapshot_id string, parent bigint, ms bigint, operation string, summary map<string,string>")
        return df.withColumn("committed_at", F.timestamp_millis("ms")).drop("ms")

    def files(self, version: int | None = None) -> DataFrame:
        rows = [(e["path"], e["bytes"], e["records"], e["partition"]) for e in self._entries(self.snapshot(version))]
        return self.spark.createDataFrame(rows, "file_path string, file_size_in_bytes bigint, record_count bigint, partition map<string,string>")

    def manifests(self) -> DataFrame:
        rows = [(m, len(read_json(self.spark, f"{self.root}/manifests/{m}"))) for m in self.snapshot()["manifests"]]
        return self.spark.createDataFrame(rows, "path string, data_files bigint")

    def metrics(self) -> dict:
        f = self.files().agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.round(F.avg("file_size_in_bytes") / 1048576, 2), F.lit(0.0)).alias("avg_mb"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("records")).first()
        return f.asDict() | {"snapshots": len(self.versions())}
