"""The run history: an append-only Parquet table, read latest-wins.

Many small appends are put together by :func:`compact_runs`. Compacted files lie beside the table, and a
manifest of the same name says which files are live, which they replace, and what range of run ids and
times each holds. It is written last and replaced as a whole version, so a compaction that is lost leaves
the table as it was, and a reader always sees one version. Files that no manifest knows
have been appended since and are live. Nothing is deleted; old files can go once no reader of an older
version is left.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WRITERS = 16  # tasks that share a day and suite when runs are saved
TARGET_BYTES = 128 << 20  # of a compacted file
# Of the sizes tried, the least that holds the ids of a file; without it every file has a filter of 1 MB.
_BLOOM = {"parquet.bloom.filter.enabled#run_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
DEFAULT_RECENT = 10  # fixed value: runs listed when no limit is given


def save_runs(runs: DataFrame, path: str, ingest_seq: int) -> None:
    """Append runs. A run saved again simply has a later ``ingest_seq``.

    The table is laid out by day and suite, so a history query reads only its own days. A
    retried task rewrites its own files: the append commits as a whole.
    """
    if "created_at" not in runs.columns:
        runs = runs.withColumn(
            "created_at",
            F.date_format(
                F.convert_timezone(
                    F.current_timezone(), F.lit("UTC"),
                    F.current_timestamp().cast("timestamp_ntz"),
                ),
                "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
            ),
        )
    (
        runs.withColumns(
            {
                "ingest_seq": F.lit(ingest_seq).cast("long"),
                "run_date": F.substring("created_at", 1, 10),
                "suite": F.col("suite_id"),
            }
        )
        .repartition("run_date", "suite", F.pmod(F.xxhash64("run_id"), F.lit(WRITERS)))
        .sortWithinPartitions("run_date", "suite", "run_id")
        .write.mode("append")
        .options(**_BLOOM)
        .partitionBy("run_date", "suite")
        .parquet(path)
    )


_MANIFEST = (
    "root string, file string, live boolean, bytes long, n long, first_id string, last_id string, "
    "first_at string, last_at string"
)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest manifest of a table: one row per file it knows; nothing before the first compaction."""
    folder = f"{path.rstrip('/')}.manifest"
    if not _exists(spark, folder):
        return None
    every = spark.read.schema(f"{_MANIFEST}, version long").parquet(folder)
    newest = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == newest)


def _named(file: str) -> str:
    """The one form in which a file is known; Spark writes local ones in two ways."""
    return file.replace("file:///", "file:/", 1)


def _files(spark: SparkSession, root: str, files: list[str]) -> DataFrame:
    """The rows of some files; names are URIs, and a path is read as it is spelt."""
    return spark.read.option("basePath", root).parquet(*map(unquote, files))


def _described(df: DataFrame, root: str) -> DataFrame:
    """Manifest rows of the files of a table; reads run ids and times only."""
    file = F.replace(F.col("_metadata.file_path"), F.lit("file:///"), F.lit("file:/"))
    return df.groupBy(file.alias("file")).agg(
        F.max("_metadata.file_size").alias("bytes"), F.count(F.lit(1)).alias("n"),
        F.min("run_id").alias("first_id"), F.max("run_id").alias("last_id"),
        F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
    ).select(F.lit(root).alias("root"), "file", F.lit(True).alias("live"), "bytes", "n", "first_id", "last_id", "first_at", "last_at")


def _appended(spark: SparkSession, path: str, known: DataFrame | None) -> list[str]:
    """The files of the table that no manifest knows: names only."""
    files = set(map(_named, spark.read.parquet(path).inputFiles()))
    if known is not None:
        files -= {r["file"] for r in known.select("file").collect()}
    return sorted(files)


def compact_runs(spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES) -> None:
    """Put what was appended, and compacted files of less than half the target, into files of about the target.

    Rows are laid out by day, suite and run id, so a file holds a narrow range of ids; no version of
    a run is left out.
    """
    path = path.rstrip("/")
    known = manifest(spark, path)
    appended = _appended(spark, path, known)
    rows = [] if known is None else [r.asDict() for r in known.drop("version").collect()]
    small = [r for r in rows if r["live"] and r["bytes"] < target_bytes // 2]
    if len(appended) + len(small) < 2:
        return
    parts = [_files(spark, path, appended)] if appended else []
    for root in sorted({r["root"] for r in small}):
        parts.append(_files(spark, root, [r["file"] for r in small if r["root"] == root]))
    found = _described(parts[0], path).collect() if appended else []
    whole = sum(r["bytes"] for r in found) + sum(r["bytes"] for r in small)
    out = f"{path}.compacted/{uuid.uuid4().hex}"
    order = ("run_date", "suite", "run_id")
    (
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        .repartitionByRange(max(1, math.ceil(whole / target_bytes)), *order).sortWithinPartitions(*order, "ingest_seq")
        .write.options(**_BLOOM).partitionBy("run_date", "suite").parquet(out)
    )
    gone = [{**r.asDict(), "live": False} for r in found] + [{**r, "live": False} for r in small]
    kept = [r for r in rows if r not in small]
    old = spark.createDataFrame([tuple(r[c.split()[0]] for c in _MANIFEST.split(", ")) for r in gone + kept], _MANIFEST)
    version = 0 if known is None else known.agg(F.max("version")).first()[0] + 1
    new = _described(spark.read.parquet(out), out)
    old.unionByName(new).coalesce(1).write.parquet(f"{path}.manifest/version={version}")


def read_runs(
    spark: SparkSession, path: str, run_id: str | None = None, since: str | None = None, until: str | None = None
) -> DataFrame:
    """All saved versions, of one run or of those created from ``since`` to ``until`` if given.

    Compacted files whose ranges exclude what is asked for are not opened.
    """
    path = path.rstrip("/")
    known = manifest(spark, path)
    if known is None:
        parts = [spark.read.parquet(path)]
    else:
        wanted = known.where("live")
        if run_id is not None:
            wanted = wanted.where((F.col("first_id") <= run_id) & (F.col("last_id") >= run_id))
        if since is not None:
            wanted = wanted.where(F.col("last_at") >= since)
        if until is not None:
            wanted = wanted.where(F.col("first_at") <= until)
        held = wanted.groupBy("root").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("root").collect()
        parts = [_files(spark, r["root"], r["files"]) for r in held]
        appended = _appended(spark, path, known)
        if appended:
            parts.append(_files(spark, path, appended))
        if not parts:
            parts = [spark.read.parquet(path).limit(0)]
    runs = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for column, low, high in (("run_id", run_id, run_id), ("created_at", since, until)):
        if low is not None:
            runs = runs.where(F.col(column) >= low)
        if high is not None:
            runs = runs.where(F.col(column) <= high)
    return runs


def latest_by(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the highest version of each key; versions of a key are distinct.

    Only keys and versions are aggregated, as numbers in a hash table that combines on the
    map side; the other columns are joined to what is left.
    """
    last = df.groupBy(key).agg(F.max(version).alias(version))
    return df.join(last, [key, version], "left_semi")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last saved version of each run."""
    return latest_by(runs, "run_id", "ingest_seq")


def recent_runs(runs: DataFrame, limit: int = DEFAULT_RECENT) -> DataFrame:
    """Newest first; equal times by run id.

    The runs are chosen by id, version and time only, and their rows are fetched afterwards.
    """
    narrow = runs.groupBy("run_id").agg(
        F.max("ingest_seq").alias("ingest_seq"), F.max_by("created_at", "ingest_seq").alias("t")
    )
    order = (F.col("t").desc(), F.col("run_id"))
    chosen = narrow.orderBy(*order).limit(limit).select("run_id", "ingest_seq")
    found = runs.join(chosen, ["run_id", "ingest_seq"], "left_semi")
    return found.orderBy(F.col("created_at").desc(), "run_id").limit(limit)


def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    """The run with this id, or no row. The filter reaches the Parquet scan."""
    return latest_runs(runs.filter(F.col("run_id") == run_id))
