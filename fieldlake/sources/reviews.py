"""Review items as JSON files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.functions.times import partition_columns

ITEM_SCHEMA = (
    "id string, type string, instrument_id string, status string, scope string, reason string, notes string, "
    "created_at string, row_key string, row_keys array<string>, timestamp string, start_time string, "
    "end_time string, start string, `end` string, original_values map<string,string>, "
    "corrected_values map<string,string>"
)
COLUMNS = [part.strip(" `").split()[0].strip("`") for part in ITEM_SCHEMA.replace("string,string", "").split(", ")]
PARTITIONS = ["instrument_id", "type", "year", "month"]
_CORRUPT = "_corrupt_record"


def with_item_columns(items: DataFrame) -> DataFrame:
    """Bring any subset of the item columns to the full item schema."""
    schema = items.sparkSession.createDataFrame([], ITEM_SCHEMA).schema
    kept = [c for c in ("_s3_key",) if c in items.columns]
    return items.select(
        *[
            F.col(f.name) if f.name in items.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema
        ],
        *kept,
    )


def read_review_items(spark: SparkSession, path: str, documents: bool = False) -> DataFrame:
    """Review items with their source key ``_s3_key``; unreadable ones are skipped, and none are there before the first write.

    ``documents`` reads one (pretty-printed) JSON object per file, otherwise one
    object per line as ``write_review_items`` writes them.
    """
    reader = (
        spark.read.schema(f"{ITEM_SCHEMA}, {_CORRUPT} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .option("multiLine", documents)
        .option("recursiveFileLookup", documents)
    )
    try:
        stored = reader.json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{ITEM_SCHEMA}, _s3_key string").select(*COLUMNS, "_s3_key")
    items = stored.filter(F.col(_CORRUPT).isNull() & F.col("id").isNotNull())
    file = F.col("_metadata.file_path")
    key = file if documents else F.concat_ws("#", file, F.col("id"))
    return items.select(*[F.col(c) for c in COLUMNS], key.alias("_s3_key"))


def write_review_items(items: DataFrame, path: str) -> None:
    """Append accepted items below ``instrument_id/type/year/month`` of creation."""
    year, month = partition_columns(F.col("created_at").cast("timestamp"))
    (
        with_item_columns(items)
        .select(*COLUMNS)
        .withColumns({"year": year, "month": month})
        .write.mode("append")
        .partitionBy(*PARTITIONS)
        .json(path)
    )
