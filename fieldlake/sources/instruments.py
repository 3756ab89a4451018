"""The instrument dimension, read from a JSON configuration file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONFIG_SCHEMA = (
    "instruments ARRAY<STRUCT<id STRING, display_name STRING, location STRING, ingestion_type STRING, "
    "data_glob STRING, data_file STRING, active BOOLEAN>>"
)


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    """``instrument_id, ordinal, display_name, location, ingestion_type, globs, active``.

    ``data_glob`` may be one pattern or a list of them; the older ``data_file``
    names a single path.  Order in the file is the reporting order.
    """
    raw = spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(path)
    entries = raw.select(F.posexplode("instruments").alias("ordinal", "i"))
    # A list arrives as its JSON text, because the column is declared as text.
    is_list = F.startswith(F.col("i.data_glob"), F.lit("["))
    globs = F.when(is_list, F.from_json("i.data_glob", "array<string>")).otherwise(
        F.array_compact(F.array(F.coalesce("i.data_glob", "i.data_file")))
    )
    return entries.select(
        F.col("i.id").alias("instrument_id"),
        "ordinal",
        "i.display_name",
        "i.location",
        "i.ingestion_type",
        globs.alias("globs"),
        F.coalesce("i.active", F.lit(True)).alias("active"),
    )


def instruments_from_ids(ids: DataFrame) -> DataFrame:
    """A dimension out of distinct ``instrument_id`` values, in name order."""
    order = Window.orderBy("instrument_id")
    return ids.select("instrument_id").distinct().withColumn("ordinal", F.row_number().over(order) - 1)
