"""Shards of bounded size by extendible hashing, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import written

#: Production byte limit of a shard, and the hash bits that a directory can use.
LIMIT, BITS = 16 << 20, 40


def hash_bits(key: Column) -> Column:
    """The first 40 bits of the key's md5 as a number: any SQL engine has it."""
    return F.conv(F.substring(F.md5(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")), 1, 10), 16, 10).cast("bigint")


def _buckets(sums: DataFrame, low: int, high: int) -> DataFrame:
    """Bytes of every bucket of depth low to high, from (bits, bytes)."""
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("bits", BITS - d).alias("prefix")) for d in range(low, high + 1)]))
    return sums.select(at.alias("at"), "bytes").groupBy("at.depth", "at.prefix").agg(F.sum("bytes").alias("bucket_bytes"))


def _leaves(buckets: DataFrame, limit: int) -> DataFrame:
    """Buckets that fit and whose parent, if it was counted, does not."""
    parents = buckets.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"), F.col("bucket_bytes").alias("parent_bytes"))
    return buckets.where(F.col("bucket_bytes") <= limit).join(parents, ["depth", "prefix"], "left").where(F.coalesce(F.col("parent_bytes") > limit, F.lit(True))).drop("parent_bytes")


def directory(sums: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """(bits, depth, prefix, bucket_bytes) for each row of (bits, bytes) that a bucket of depth low to high holds."""
    leaves = _leaves(_buckets(sums, low, high), limit)
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("bits", BITS - d).alias("prefix")) for d in range(low, high + 1)]))
    return sums.select("bits", at.alias("at")).select("bits", "at.depth", "at.prefix").join(leaves, ["depth", "prefix"])


def extendible_shards(docs: DataFrame, limit: int = LIMIT, carry: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, depth, prefix, page, shard, shard_bytes, and the column `carry` if one is named.

    The directory is indexed by the leading bits of a hash of doc_id. A bucket with over `limit` bytes of
    UTF-8 text splits on the next bit, and only it, until every bucket fits; shard is "depth-prefix-page".
    The directory is counted on sums by the first bits (16 times more cells than the total needs); only what
    doesn't fit there is counted by all 40 bits. A bucket over the limit even then holds one long row or rows
    that repeat a doc_id: it is cut into pages, rows over half the limit alone and the others by running
    bytes, so that only a single row over the limit makes a page over it. Null and empty texts have 0 bytes;
    a null doc_id hashes as an empty key.
    """
    more = [carry] if carry else []
    rows = docs.select(
        *more,
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("n_bytes"),
    ).withColumn("bits", hash_bits(F.col("doc_id")))
    rows = written(rows, "sizes")  # ids, sizes and hashes: read several times below
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    first = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 4)
    cell = F.shiftleft(F.shiftright("bits", BITS - first), BITS - first)
    rows = rows.withColumn("cell", cell)
    coarse = rows.groupBy(F.col("cell").alias("bits")).agg(F.sum("n_bytes").alias("bytes"))
    upper = directory(coarse, limit, 0, first).select(F.col("bits").alias("cell"), "depth", "prefix", "bucket_bytes")
    held = rows.join(upper, "cell", "left")
    fits, rest = held.where("depth is not null"), held.where("depth is null").select("doc_id", "n_bytes", "bits", *more)
    fine = rest.groupBy("bits").agg(F.sum("n_bytes").alias("bytes"))
    rest = rest.join(directory(fine, limit, first + 1, BITS), "bits", "left") if first < BITS else rest.withColumns({"depth": F.lit(None).cast("int"), "prefix": F.lit(None).cast("bigint"), "bucket_bytes": F.lit(None).cast("bigint")})
    deep, over = rest.where("depth is not null"), rest.where("depth is null")

    large = F.col("n_bytes") * 2 > limit
    kind = Window.partitionBy("bits", large.cast("int"))
    order = kind.orderBy("doc_id", "n_bytes")
    upto = F.coalesce(F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    alone = F.sum(large.cast("int")).over(Window.partitionBy("bits"))
    page = F.when(large, F.row_number().over(order) - 1).otherwise(alone + F.floor(upto * 2 / limit))
    over = over.withColumn("page", page.cast("bigint")).select(
        "doc_id", "n_bytes", F.lit(BITS).alias("depth"), F.col("bits").alias("prefix"), F.sum("n_bytes").over(Window.partitionBy("bits", "page")).alias("bucket_bytes"), "page", *more
    )
    columns = ["doc_id", "n_bytes", "depth", "prefix", "bucket_bytes", *more]
    whole = fits.select(columns).unionByName(deep.select(columns))
    return whole.withColumn("page", F.lit(0).cast("bigint")).unionByName(over).select(
        "doc_id", "n_bytes", "depth", "prefix", "page", F.concat_ws("-", "depth", "prefix", "page").alias("shard"), F.col("bucket_bytes").alias("shard_bytes"), *more
    )


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Writes each row once, in its shard's folder under path, and returns the rows of extendible_shards().

    The row travels with its plan, whatever its doc_id. Folders are named by the column "shard", with underscores added while the documents
    have a column of that name.
    """
    folder = "shard"
    while folder in docs.columns:
        folder += "_"
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("barloom_row"))
    plan = written(extendible_shards(rows, limit, "barloom_row"), "shards")
    plan.select(F.col("shard").alias(folder), "barloom_row.*").repartition(folder).write.partitionBy(folder).parquet(path)
    return plan.drop("barloom_row")


def shards_sql(limit: int = LIMIT) -> str:
    """The same rows in SQL over `documents`, for ids that don't repeat."""
    return f"""
    WITH d AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
                      CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10)) AS BIGINT) AS bits FROM documents),
    lv AS (SELECT CAST(range AS INTEGER) AS depth FROM range(0, {BITS + 1})),
    b AS (SELECT depth, bits >> ({BITS} - depth) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM d, lv GROUP BY ALL),
    f AS (SELECT doc_id, n_bytes, bits, min(b.depth) AS depth FROM d, b
          WHERE b.prefix = d.bits >> ({BITS} - b.depth) AND b.bytes <= {limit} GROUP BY ALL),
    g AS (SELECT d.doc_id, d.n_bytes, d.bits, coalesce(f.depth, {BITS}) AS depth FROM d LEFT JOIN f USING (doc_id))
    SELECT g.doc_id, g.n_bytes, g.depth, b.prefix, CAST(0 AS BIGINT) AS page,
           g.depth || '-' || b.prefix || '-0' AS shard, b.bytes AS shard_bytes
    FROM g JOIN b ON b.depth = g.depth AND b.prefix = g.bits >> ({BITS} - g.depth)"""
