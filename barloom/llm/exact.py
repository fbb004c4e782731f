"""Exact duplicate texts through an extendible-hash index kept on shared files."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import by_arrow, written
from barloom.llm.sharding import BITS, directory

#: Distinct texts that a bucket of the index may hold before it splits.
CAPACITY = 2048
#: Bytes of text that one task remembers to fold its own copies before they travel.
REMEMBERED = 32 << 20

RUN = "doc_id bigint, h bigint, sha string, head bigint, n bigint, text binary"


def normalised(text):
    """Every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def with_buckets(heads: DataFrame, capacity: int, total: int) -> DataFrame:
    """Adds bucket and depth: the directory is doubled, one hash bit more each time, until no bucket holds over `capacity` rows.

    Keys are counted by so many leading bits that cells are 16 times as many as full buckets, and only what is overfull
    even there by all BITS; so the directory grows with the table and is a table itself. A bucket is named by its first
    slot at full depth, so that names stay when the directory doubles. Rows of one hash share a bucket whatever their number.
    """
    first = min(BITS, max(0, math.ceil(math.log2(max(1, total / capacity)))) + 4)
    bits = F.shiftrightunsigned("h", 64 - BITS)
    keyed = heads.withColumn("bits", bits).withColumn("cell", F.shiftleft(F.shiftright(bits, BITS - first), BITS - first))
    coarse = written(keyed.groupBy(F.col("cell").alias("bits")).agg(F.count("*").alias("bytes")), "cells")
    slot = lambda df, key: df.select(F.col("bits").alias(key), F.call_function("shiftleft", F.col("prefix"), F.lit(BITS) - F.col("depth")).alias(f"{key}_bucket"), F.col("depth").alias(f"{key}_depth"))
    upper = written(slot(directory(coarse, capacity, 0, first), "cell"), "slots")
    placed = keyed.join(upper, "cell", "left")
    over = written(coarse.select(F.col("bits").alias("cell")).join(upper, "cell", "left_anti"), "overfull")
    if first == BITS or over.isEmpty():
        return placed.select(*heads.columns, F.coalesce("cell_bucket", "bits").alias("bucket"), F.coalesce("cell_depth", F.lit(BITS)).alias("depth"))
    fine = keyed.join(over, "cell", "left_semi").groupBy("bits").agg(F.count("*").alias("bytes"))
    lower = written(slot(directory(fine, capacity, first + 1, BITS), "bits"), "slots")
    placed = placed.join(lower, "bits", "left")
    return placed.select(*heads.columns, F.coalesce("cell_bucket", "bits_bucket", "bits").alias("bucket"), F.coalesce("cell_depth", "bits_depth", F.lit(BITS)).alias("depth"))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the first row of this task that has the same bytes; only such first rows keep the text."""
    chains: dict[int, list[list]] = {}
    size = 0
    for batch in batches:
        ids, hs, shas, texts = (batch.column(c).to_pylist() for c in ("doc_id", "h", "sha", "text"))
        heads, kept = [], []
        for i, h, t in zip(ids, hs, texts):
            for entry in chains.get(h, ()):
                if entry[1] == t:
                    heads.append(entry[0])
                    kept.append(None)
                    break
            else:
                if size > REMEMBERED:
                    chains, size = {}, 0
                if i is not None:
                    chains.setdefault(h, []).append([i, t])
                    size += len(t) + 200
                heads.append(i)
                kept.append(t)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(shas), pa.array(heads, pa.int64()), pa.array([1] * len(ids), pa.int64()), pa.array(kept, pa.binary())],
            ["doc_id", "h", "sha", "head", "n", "text"],
        )


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's rows in order of hash: texts of one hash form a chain, told apart by their bytes."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "text", "bucket", "sha")))

    out: list[tuple] = []

    def batch_of(x: list[tuple]) -> pa.RecordBatch:
        *numbers, sha = zip(*x)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.array(sha)], ["h", "link", "local", "keep_id", "bucket", "sha"])

    for h, group in groupby(rows(), key=lambda r: r[0]):
        chain: list[tuple[bytes, str, list]] = []
        for _, i, t, bucket, sha in group:
            for text, _, locals_ in chain:
                if text == t:
                    locals_.append(i)
                    break
            else:
                chain.append((t, sha, [i]))
        for link, (_, sha, locals_) in enumerate(chain):
            keep = min((i for i in locals_ if i is not None), default=None)
            out += [(h, link, i, keep, bucket, sha) for i in locals_]
        if len(out) >= 8192:
            yield batch_of(out)
            out = []
    if out:
        yield batch_of(out)


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(run, index), both on shared files.

    run has a row for each document: its hash, digest and the first equal document of its task. index has
    a row for each such first document: its bucket, its place in the chain of its hash (link) and the
    smallest doc_id of its text. Only their number reaches the driver.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised(F.col("text")).alias("t"))
    keyed = base.select("doc_id", F.xxhash64("t").alias("h"), F.sha2("t", 256).alias("sha"), F.encode("t", "UTF-8").alias("text"))
    run = written(by_arrow(keyed, _folded, RUN), "run")
    heads = run.where("text is not null").select("h", "doc_id", "text", "sha")
    dealt = with_buckets(heads, capacity, heads.count()).select("h", "doc_id", "text", "bucket", "sha").repartition("bucket").sortWithinPartitions("bucket", "h", "doc_id")
    index = written(by_arrow(dealt, _chained, "h bigint, link bigint, local bigint, keep_id bigint, bucket bigint, sha string"), "index")
    return run, index


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    Texts are equal when their bytes are after every run of ASCII white space became one space; a null text
    is an empty one. The smallest doc_id of a text stays. Documents are hashed, tasks fold their own copies,
    and the rest goes to the owners of hash ranges, which an extendible directory cuts to at most `capacity`
    texts; owners chain equal hashes and compare bytes. Rows that repeat both doc_id and text count in
    group_size and are all marked kept if their doc_id is. A null doc_id loses against any other; among
    null ones alone keep_id is null and every row is kept.
    """
    run, index = build_index(docs, capacity)
    owners = index.dropDuplicates(["sha", "local"])
    local = run.groupBy("sha", "head").agg(F.sum("n").alias("n"))
    text = Window.partitionBy("h", "link")
    owned = (
        local.join(owners, (local.sha == owners.sha) & local["head"].eqNullSafe(owners["local"]))
        .select(local.sha.alias("own_sha"), local["head"].alias("own_head"), "keep_id", "bucket", F.sum("n").over(text).alias("group_size"))
    )
    owned = written(owned, "owners")  # a join of two plain exchanges is one whose hot keys Spark can split
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return (
        run.select("doc_id", "sha", "head")
        .join(owned, (F.col("sha") == F.col("own_sha")) & F.col("head").eqNullSafe(F.col("own_head")), "left")
        .select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"), "bucket")
    )
