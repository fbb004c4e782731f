"""Stored bars: a Parquet table partitioned by year that upserts rewrite year by year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.ingest import upsert
from barloom.sources.files import scratch

KEY = ("instrument_id", "trade_date")
#: Tables of this process's applications, by application and input.
_STORED: dict[tuple[str, str], str] = {}


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_bars(bars: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Bars in folders by year, sorted by instrument within files; a year is as many files as its tasks are, not one.

    mode "overwrite" replaces the years that bars has and leaves all others as they are.
    """
    rows = bars.withColumn("year", F.year("trade_date")).repartitionByRange("year", "instrument_id").sortWithinPartitions("year", *KEY)
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year").parquet(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stored_once(spark: SparkSession, name: str, make) -> DataFrame:
    """The stored table of that name, written by make() at its first use in this application, or again if it was cleared away."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _STORED or not exists(spark, _STORED[key] + "/_SUCCESS"):
        path = scratch(spark, "bars")
        write_bars(make(), path)
        _STORED[key] = path
    return read_bars(spark, _STORED[key])


def in_range(bars: DataFrame, ids: list[int] | None, start: str, end: str) -> DataFrame:
    """Bars of the ids (all, if None) from start to end: only the range's years are listed, only matching row groups are read."""
    rows = bars.where(F.col("year").between(int(start[:4]), int(end[:4])) & F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return rows if ids is None else rows.where(F.col("instrument_id").isin(*ids))


def _replaced(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Writes whole years over themselves, by way of a staged copy: they were read from the same folder."""
    staged = scratch(spark, "staged")
    rows.drop("year").write.parquet(staged)
    write_bars(spark.read.parquet(staged), path, "overwrite")


def upsert_bars(spark: SparkSession, path: str, incoming: DataFrame, revisions: str | None = None) -> DataFrame:
    """Merges incoming bars into the stored ones; returns counts by year and change.

    Only the years of incoming bars are read, and only those with a new or changed bar are written. The values
    that updates replace are appended to the table at revisions. A second run of the same bars writes nothing.
    """
    years = [r[0] for r in incoming.select(F.year("trade_date").alias("y")).distinct().collect()]  # as many numbers as years
    stored = read_bars(spark, path).where(F.col("year").isin(*years)) if years else read_bars(spark, path).limit(0)
    merged = upsert(stored.drop("year"), incoming.select(stored.drop("year").columns), list(KEY)).withColumn("year", F.year("trade_date"))
    staged = scratch(spark, "merged")
    merged.write.parquet(staged)
    merged = spark.read.parquet(staged)
    touched = [r[0] for r in merged.where("change in ('inserted', 'updated')").select("year").distinct().collect()]
    if touched:
        if revisions:
            merged.where("change = 'updated'").select(*KEY, "old.*").write.mode("append").parquet(revisions)
        write_bars(merged.where(F.col("year").isin(*touched)).select(*KEY, "row.*"), path, "overwrite")
    return merged.groupBy("year", "change").agg(F.count("*").alias("n"))


def set_price_basis(spark: SparkSession, path: str, instruments: DataFrame, basis: str) -> None:
    """Relabels all bars of the instruments; years without one of their bars stay as they are."""
    bars = read_bars(spark, path)
    marked = bars.join(instruments.select("instrument_id").distinct().withColumn("marked", F.lit(True)), "instrument_id", "left")
    touched = [r[0] for r in marked.where(F.col("marked") & (F.coalesce("price_basis", F.lit("")) != basis)).select("year").distinct().collect()]
    if touched:
        rows = marked.where(F.col("year").isin(*touched)).withColumn("price_basis", F.when(F.col("marked"), basis).otherwise(F.col("price_basis")))
        _replaced(spark, path, rows.select(bars.columns))
