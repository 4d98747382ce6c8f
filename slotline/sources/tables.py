"""Readers and writers. Every reader declares its schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotline import fixed, schemas
from slotline.session import stage

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


DAMAGED = "damaged_row"


def read_observations_csv(
    spark: SparkSession, path: str, timestamp_format: str | None = None, mode: str = "FAILFAST"
) -> DataFrame:
    """The raw feed with its source header, renamed to the library's columns. A row that cannot be read fails the read."""
    return _feed(spark, path, timestamp_format, mode).select(*fixed.SOURCE_HEADER.values())


def split_observations_csv(
    spark: SparkSession, path: str, timestamp_format: str | None = None, header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The readable rows of the feed, and the damaged ones as text (``damaged_row``): none is lost between the two.

    Damaged are rows with a field that does not fit its column's type, with missing or with surplus fields.
    """
    rows = _feed(spark, path, timestamp_format, "PERMISSIVE", header)
    # The reader refuses a scan of the text column alone, and a row counts as damaged by all its fields: a written copy serves both.
    seen = stage(rows, "feed")
    return seen.where(F.col(DAMAGED).isNull()).drop(DAMAGED), seen.where(F.col(DAMAGED).isNotNull()).select(DAMAGED)


def _feed(spark: SparkSession, path: str, timestamp_format: str | None, mode: str, header: bool = True) -> DataFrame:
    kinds = {f.name: f.dataType for f in schemas.OBSERVATIONS}
    declared = [T.StructField(h, kinds[c]) for h, c in fixed.SOURCE_HEADER.items()]
    reader = spark.read.schema(T.StructType([*declared, T.StructField(DAMAGED, T.StringType())]))
    reader = reader.option("header", header).option("mode", mode).option("columnNameOfCorruptRecord", DAMAGED)
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format)
    # Without pruning in the parser a row is judged by all its fields, whatever is selected later.
    return reader.option("columnPruning", False).csv(path).withColumnsRenamed(fixed.SOURCE_HEADER)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A stored table; types come back as written. ``columns`` prunes the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    fmt: str = "parquet",
    mode: str = "overwrite",
    header: bool = True,
) -> None:
    """Replace a stored table. Partition columns are clustered first, so that each task does
    not open a file in every partition; AQE splits the clusters that are too large."""
    out = df.hint("rebalance", *partition_by) if partition_by else df
    writer = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", header)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def publish(tables: dict[str, DataFrame], database: str | None = None) -> list[str]:
    """Save named tables with replace semantics."""
    names = []
    for name, df in tables.items():
        full = f"{database}.{name}" if database else name
        df.write.mode("overwrite").format("parquet").saveAsTable(full)
        names.append(full)
    return names


def register(tables: dict[str, DataFrame]) -> list[str]:
    """The same tables as session views, for SQL access without writing."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return list(tables)


def write_report(df: DataFrame, path: str) -> None:
    """A report row (nested structs allowed) as JSON with explicit nulls."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def encode_payload(df: DataFrame, keep: Sequence[str], payload: str = "payload_json") -> DataFrame:
    """Each row as a JSON document: NaN becomes null, nulls are kept, instants are ISO."""
    columns = [
        F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
        if f.dataType.typeName() in ("double", "float")
        else F.col(f.name)
        for f in df.schema
    ]
    doc = F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "timestampFormat": ISO_MICROS})
    return df.select(*keep, doc.alias(payload))


def decode_payload(df: DataFrame, schema: T.StructType, payload: str = "payload_json") -> DataFrame:
    doc = F.from_json(payload, schema, {"timestampFormat": ISO_MICROS})
    return df.select(doc.alias("_p")).select("_p.*")


def union_history(base: DataFrame, live: DataFrame) -> DataFrame:
    """Stored history plus live rows, in the shape of the stored history."""
    shared = [c for c in live.columns if c in base.columns]
    return base.unionByName(live.select(*shared), allowMissingColumns=True).select(*base.columns)
