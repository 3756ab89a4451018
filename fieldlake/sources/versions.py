"""Published versions of a set of tables: new folders per build, one pointer written last.

Layout below a root::

    <table>/build=<build>/...      data files of one build, never changed afterwards
    manifests/<token>/             one row per instrument: which build holds it, its statistics, its last error
    commits/<number>.json          names the manifest that counts; the largest number is the current version

A build writes its folders first, then a manifest with the instruments it replaced,
then the next commit.  The commit file appears under its name by a rename that fails
if the name is taken, so of two builds that end at once the second one merges its
instruments into the first one's manifest and commits again.  A build that fails
earlier leaves folders that no manifest names: readers never see them, and ``vacuum``
removes them.  The file system must have such a rename, as HDFS and local disks do.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY_SCHEMA = (
    "instrument_id string, build string, bronze_objects bigint, data_rows_total bigint, data_rows_unique bigint, "
    "duplicates_removed bigint, attempt string, error string"
)
ENTRY = [part.split()[0] for part in ENTRY_SCHEMA.split(", ")]
ATTEMPTS = 20


def new_build() -> str:
    """A name that no other build has; names sort by time."""
    return f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:12]}"


def hadoop_files(spark: SparkSession, path: str):
    """Hadoop's view of a folder: ``(FileSystem, Path)``."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    files, folder = hadoop_files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(folder)) if files.exists(folder) else []


def commits(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all commits, oldest first."""
    return [int(name.removesuffix(".json")) for name in names(spark, f"{root}/commits") if name[0].isdigit()]


def manifest_path(spark: SparkSession, root: str, number: int) -> str:
    """Folder of the manifest that a commit names."""
    row = spark.read.schema("manifest string").json(f"{root}/commits/{number:012d}.json").first()
    return f"{root}/manifests/{row.manifest}"


def manifest(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """One row per instrument of a version, the current one unless ``number`` names another; empty before the first commit."""
    if number is None:
        known = commits(spark, root)
        if not known:
            return spark.createDataFrame([], ENTRY_SCHEMA)
        number = known[-1]
    return spark.read.schema(ENTRY_SCHEMA).parquet(manifest_path(spark, root, number))


def _commit(spark: SparkSession, root: str, number: int, token: str) -> bool:
    """Write commit ``number``; false if another build has it."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    files, folder = hadoop_files(spark, f"{root}/commits")
    files.mkdirs(folder)
    waiting, target = (hadoop.Path(f"{root}/commits/{name}") for name in (f".{token}", f"{number:012d}.json"))
    out = files.create(waiting, True)
    out.write(bytearray(json.dumps({"manifest": token}).encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(files.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(waiting), files.makeQualified(target), options)
    except Py4JJavaError as error:
        files.delete(waiting, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def publish(spark: SparkSession, root: str, entries: DataFrame) -> int:
    """Make ``entries`` (``ENTRY_SCHEMA``) count; other instruments keep theirs.  Returns the commit's number.

    An entry with an error keeps the build and the statistics that the instrument had.
    """
    names = [c for c in ENTRY if c not in ("instrument_id", "attempt", "error")]
    for _ in range(ATTEMPTS):
        known = commits(spark, root)
        number = known[-1] + 1 if known else 1
        old = manifest(spark, root, known[-1] if known else None)
        new, old = entries.select(*ENTRY).alias("new"), old.alias("old")
        fresh = F.col("new.instrument_id").isNotNull() & F.col("new.error").isNull()
        merged = old.join(new, F.col("old.instrument_id") == F.col("new.instrument_id"), "full").select(
            F.coalesce("new.instrument_id", "old.instrument_id").alias("instrument_id"),
            *[F.when(fresh, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in names],
            *[F.when(F.col("new.instrument_id").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in ("attempt", "error")],
        )
        token = new_build()
        merged.select(*ENTRY).write.parquet(f"{root}/manifests/{token}")
        if _commit(spark, root, number, token):
            return number
    raise RuntimeError(f"no commit in {root} after {ATTEMPTS} attempts: other builds commit all the time")


def read_live(spark: SparkSession, root: str, table: str, schema: str, live: DataFrame) -> DataFrame:
    """Rows of a table whose (build, instrument) is in ``live``.

    Only folders of builds that count are listed: one per build that still holds an
    instrument, so there are never more of them than instruments.
    """
    builds = [r.build for r in live.select("build").distinct().collect()]
    if not builds:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, build string").option("basePath", f"{root}/{table}")
    found = rows.parquet(*(f"{root}/{table}/build={b}" for b in sorted(builds)))
    return found.join(live.select("build", "instrument_id"), ["build", "instrument_id"], "left_semi").drop("build")


def vacuum(spark: SparkSession, root: str, tables: list[str], keep: int = 2) -> list[str]:
    """Remove folders of builds that none of the last ``keep`` commits names; returns their names.

    Readers of older versions and running builds must have ended.
    """
    kept = commits(spark, root)[-max(1, keep):]
    used = {r.build for n in kept for r in manifest(spark, root, n).select("build").distinct().collect()}
    removed = []
    for table in tables:
        for name in names(spark, f"{root}/{table}"):
            if name.startswith("build=") and name.removeprefix("build=") not in used:
                files, folder = hadoop_files(spark, f"{root}/{table}/{name}")
                files.delete(folder, True)
                removed.append(f"{table}/{name}")
    return removed
