"""Files: scratch folders that a whole cluster shares, checked CSV sources, versioned datasets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Folders made where none was set, by application.
_OWN_DIRS: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only where none is set and all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="barloom-")
        base = _OWN_DIRS[app]
    return f"{base.rstrip('/')}/barloom-{uuid.uuid4().hex}/{name}"


def fields_digest(df: DataFrame) -> Column:
    """One number per row from the text of all its columns, the same in any engine: 32 bits of an md5."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in sorted(df.columns)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint")


def content_hash(df: DataFrame) -> DataFrame:
    """Row count and an order-free digest of all values: how the rows are stored makes no difference."""
    return df.select(fields_digest(df).alias("h")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("h"), F.lit(0)).alias("h_sum"), F.coalesce(F.expr("bit_xor(h)"), F.lit(0)).alias("h_xor"))


def fingerprints(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n_rows, columns, h_sum, h_xor of each table: an order-free digest of all its columns, whatever their types."""
    def one(name: str, df: DataFrame) -> DataFrame:
        h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
        shape = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(df.schema, key=lambda f: f.name))
        # xxhash64 skips nulls: their places count as well
        nulls = F.xxhash64(*[F.col(f"`{c}`").isNull() for c in sorted(df.columns)])
        h = F.xxhash64(h, nulls)
        return df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.lit(shape).alias("columns"), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0).cast("decimal(20,0)")).alias("h_sum"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("h_xor"))

    rows = [one(name, df) for name, df in sorted(tables.items())]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fingerprints of two stores side by side: name, rows_a, rows_b, state (same, differs, columns differ, missing in a, missing in b)."""
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, F.col("x.name") == F.col("y.name"), "full")
    state = (
        F.when(F.col("x.name").isNull(), "missing in a").when(F.col("y.name").isNull(), "missing in b").when(F.col("x.columns") != F.col("y.columns"), "columns differ")
        .when((F.col("x.n_rows") != F.col("y.n_rows")) | (F.col("x.h_sum") != F.col("y.h_sum")) | (F.col("x.h_xor") != F.col("y.h_xor")), "differs").otherwise("same")
    )
    return both.select(F.coalesce("x.name", "y.name").alias("name"), F.col("x.n_rows").alias("rows_a"), F.col("y.n_rows").alias("rows_b"), state.alias("state"))


def manifest(df: DataFrame) -> DataFrame:
    """Rows, dates, instruments, first and last date, and the null share of every other column."""
    other = [c for c in df.columns if c not in ("trade_date", "instrument_id")]
    return df.agg(
        F.count("*").alias("n_rows"), F.count_distinct("trade_date").alias("n_dates"), F.count_distinct("instrument_id").alias("n_instruments"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"),
        *[(F.count_if(F.col(c).isNull()) / F.count("*")).alias(f"null_{c}") for c in other],
    )


def write_dataset(df: DataFrame, path: str) -> None:
    """Zstandard Parquet by year; the folder appears when the job commits."""
    df.withColumn("year", F.year("trade_date")).repartition("year").write.mode("errorifexists").option("compression", "zstd").partitionBy("year").parquet(path)


def read_dataset(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """The rows, refused if their digest isn't the expected one."""
    df = spark.read.parquet(path).drop("year")
    if expected is not None:
        a, b = content_hash(df).first(), expected.first()
        if tuple(a) != tuple(b):
            raise ValueError(f"{path}: content {tuple(a)}, expected {tuple(b)}")
    return df


def resolve_versions(recipes: DataFrame) -> DataFrame:
    """recipe, content by built: the version of each build; the same content reuses the version it had first."""
    w = Window.partitionBy("recipe").orderBy("first_built")
    first = recipes.groupBy("recipe", "content").agg(F.min("built").alias("first_built"))
    return first.withColumn("version", F.row_number().over(w).cast("bigint"))


def retained(versions: DataFrame, used: DataFrame, keep: int) -> DataFrame:
    """Versions with `kept`: among the newest of their recipe, or used by a model (recipe, version)."""
    newest = F.row_number().over(Window.partitionBy("recipe").orderBy(F.desc("version"))) <= keep
    marked = versions.withColumn("kept", newest).join(used.select("recipe", "version").distinct().withColumn("in_use", F.lit(True)), ["recipe", "version"], "left")
    return marked.withColumn("kept", F.col("kept") | F.coalesce("in_use", F.lit(False))).select(*versions.columns, "kept")


def snapshot_csv(spark: SparkSession, path: str, exchanges: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of a membership snapshot: comments, upper case, domains, weights in [0, 1], repeated symbols."""
    schema = "symbol string, previous_symbol string, exchange string, weight string, status string"
    raw = spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)
    up = lambda c: F.upper(F.trim(F.col(c)))
    rows = raw.select(up("symbol").alias("symbol"), up("previous_symbol").alias("previous_symbol"), up("exchange").alias("exchange"), F.col("weight").try_cast("double").alias("weight"), F.lower(F.trim("status")).alias("status"))
    n = F.count("*").over(Window.partitionBy("symbol"))
    problem = (
        F.when(F.col("symbol").isNull() | (F.col("symbol") == ""), "empty symbol").when(n > 1, "repeated symbol").when(~F.col("exchange").isin(*exchanges), "unknown exchange")
        .when(~F.coalesce("status", F.lit("active")).isin("active", "suspended", "delisted"), "unknown status").when(~F.coalesce(F.col("weight").between(0, 1), F.lit(True)), "weight outside [0, 1]")
        .when(F.col("previous_symbol") == F.col("symbol"), "renamed to itself")
    )
    rows = rows.withColumn("problem", problem)
    return rows.where("problem is null").drop("problem"), rows.where("problem is not null")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of a text list: what follows # falls away, upper case, the first occurrence wins."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.upper(F.trim(F.split("value", "#")[0])).alias("symbol"))
    return lines.where("symbol != ''").groupBy("symbol").agg(F.min("line_no").alias("line_no"))
