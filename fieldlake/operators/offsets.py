"""Per-file offset tables: normal form and merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE = ["instrument_id", "file"]


def checkpoint_normalize(payloads: DataFrame, known_files: DataFrame) -> DataFrame:
    """Offsets ``instrument_id, file, offset`` from stored payloads.

    ``payloads``: instrument_id, files MAP<STRING,BIGINT>, offset BIGINT.  A file
    map is taken as it is.  An old single offset (no map) goes to the last known
    file of the instrument in name order, if it is above zero and there is one.
    """
    has_map = F.col("files").isNotNull()
    mapped = payloads.filter(has_map).select("instrument_id", F.explode("files").alias("file", "offset"))
    mapped = mapped.select(*FILE, F.coalesce("offset", F.lit(0)).cast("bigint").alias("offset"))
    last = known_files.groupBy("instrument_id").agg(F.max("file").alias("file"))
    legacy = payloads.filter(~has_map & (F.col("offset") > 0)).join(last, "instrument_id")
    return mapped.unionByName(legacy.select(*FILE, F.col("offset").cast("bigint").alias("offset")))


def checkpoint_merge(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Union of two offset tables with the larger offset per file.

    ``recovered`` marks files where the remote copy was ahead.  One partial
    aggregate instead of a full outer join.
    """
    both = local.select(*FILE, F.col("offset").alias("_local"), F.lit(None).cast("bigint").alias("_remote")).unionByName(
        remote.select(*FILE, F.lit(None).cast("bigint").alias("_local"), F.col("offset").alias("_remote"))
    )
    here, there = (F.coalesce(F.max(c), F.lit(0).cast("bigint")) for c in ("_local", "_remote"))
    return both.groupBy(*FILE).agg(F.greatest(here, there).alias("offset"), (there > here).alias("recovered"))


def checkpoint_keys(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Files known to either side."""
    return local.select(*FILE).unionByName(remote.select(*FILE)).distinct()
