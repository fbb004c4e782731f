"""Near-duplicate vectors by sign hashing in several tables, exact cosines and connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import by_arrow, kept, mixed, shipped, written
from barloom.llm.minhash import connected, with_sides

#: The share of pairs at the very threshold that may meet in no table; pairs above it are lost less often.
MISSED = 1e-3
#: Members up to which a bucket gives pairs; larger buckets are compared in tiles of twice TILE members at most.
FEW, TILE = 32, 1024
#: Bits of the sketch that rules out pairs before their vectors are fetched, in words of 64, and how many deviations a pair may lie off.
WORDS, SLACK = 4, 8.0


def tables_for(n: int, cosine: float) -> tuple[int, int]:
    """(bits, tables): bits so many that a vector meets few strangers in a table of n, tables so many that all but MISSED of pairs at the threshold meet."""
    bits = min(max(8, math.ceil(math.log2(n + 1)) + 2), 62)
    meet = (1 - math.acos(min(max(cosine, -1.0), 1.0)) / math.pi) ** bits
    return bits, 1 if meet >= 1 else max(1, math.ceil(math.log(MISSED) / math.log1p(-meet)))


def directions(data: bytes, kind: str) -> np.ndarray:
    """The vector at length 1; scaled first, so that neither squares of tiny nor of huge components leave the range of doubles."""
    x = np.frombuffer(data, kind).astype(np.float64)
    x = x / np.abs(x).max()
    return x / math.sqrt(float(x @ x))


def _keyed(kind: str):
    """The vector as bytes, with a digest by which equal vectors meet; both null where it can't be near anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            vecs = batch.column("vec")
            good = np.array(batch.column("good").to_pylist(), bool)
            flat, offsets = vecs.values.to_numpy(zero_copy_only=False).astype(kind), vecs.offsets.to_numpy()
            data = [(flat[offsets[i] : offsets[i + 1]] + 0.0).astype(kind).tobytes() if good[i] else None for i in range(len(good))]  # + 0.0: -0 becomes 0
            digest = [hashlib.blake2b(d, digest_size=16).digest() if d else None for d in data]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(good))), batch.column("vec_id"), pa.array(digest, pa.binary()), pa.array(data, pa.binary())], ["row", "vec_id", "digest", "data"])
            row += len(good)

    return run


def _hashed(kind: str, bits: int, tables: int, seed: int):
    """Table keys (sign bits, table and length together) and the sketch of each vector; planes are drawn by length and seed."""

    def planes(d: int):
        return np.random.default_rng([seed, d]).standard_normal((d, bits * tables + 64 * WORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for batch in batches:
            x = [directions(d, kind) for d in batch.column("data").to_pylist()]
            dims = np.array([len(v) for v in x])
            keys, sketch = np.zeros((len(x), tables), np.int64), np.zeros((len(x), WORDS), np.int64)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                for at in range(0, len(rows), 4096):
                    part = rows[at : at + 4096]
                    signs = np.stack([x[i] for i in part]) @ kept(f"planes {d} {seed} {bits} {tables}", lambda: planes(d)) > 0
                    h = (signs[:, : bits * tables].reshape(len(part), tables, bits) * weight).sum(2, dtype=np.uint64)
                    place = np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d)
                    keys[part] = mixed(mixed(h) ^ mixed(place)).view(np.int64)
                    sketch[part] = np.packbits(signs[:, bits * tables :], axis=1).view("<i8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(list(keys), pa.list_(pa.int64())), *[pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(WORDS)]], ["node", "keys", *[f"s{j}" for j in range(WORDS)]]
            )

    return run


def _linked(kind: str, cosine: float):
    """Pairs whose cosine reaches the threshold, with the numbers of equal vectors at both ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("data_a").to_pylist(), batch.column("data_b").to_pylist()):
                keep.append(len(a) == len(b) and float(directions(a, kind) @ directions(b, kind)) >= cosine)
            columns = ["a", "b", "copies_a", "copies_b"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns], columns).filter(pa.array(keep, pa.bool_()))

    return run


def _tile(kind: str, cosine: float):
    """Of one tile of a crowded bucket: how many vectors each member links with, and the smallest member that it is connected with.

    A pair that shares several crowded buckets counts in the one with the smallest key. Members of the tile's two blocks are compared across;
    in a tile of one block, among themselves.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bucket, low, high = key
        n = len(rows)
        node, side = rows["node"].to_numpy(), rows["block"].to_numpy()
        own = np.zeros((n, 0), np.float32)
        earlier = [[k for k in keys if k < bucket] for keys in rows["crowded"]]
        number = {k: j for j, k in enumerate(sorted({k for keys in earlier for k in keys}))}
        if number:
            own = np.zeros((n, len(number)), np.float32)
            for i, keys in enumerate(earlier):
                own[i, [number[k] for k in keys]] = 1
        x = [directions(d, kind) for d in rows["data"]]
        dims = np.array([len(v) for v in x])
        linked = np.zeros((n, n), bool)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            v = np.stack([x[i] for i in at])
            linked[np.ix_(at, at)] = v @ v.T >= cosine
        np.fill_diagonal(linked, False)
        if low != high:
            linked &= side[:, None] != side[None, :]
        root, last = node.copy(), None
        while last is None or (root != last).any():  # the smallest node spreads along links
            last = root
            root = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(1))
        fresh = linked & (own @ own.T == 0)
        count = fresh @ rows["copies"].to_numpy().astype(np.float64)
        return pd.DataFrame({"node": node, "links": count.astype("int64"), "root": root})

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector; links are pairs with a cosine of at least `cosine`.

    Equal vectors are one node and link with each other. Nodes meet where the signs of their products with random planes
    agree in one of several tables (bits and tables follow from the table's rows and the threshold: a pair at the threshold is missed with a probability of 0.001,
    at a cosine of 0.98 below 10^-8). Small buckets give pairs, which a sketch of 256 further signs filters before their
    vectors are fetched; crowded buckets are compared in tiles that give numbers of links and a root for each member, no pairs. Every link is confirmed by its
    cosine in doubles. n_links counts the other vectors linked with, component_id is the smallest vec_id reachable, kept marks it.

    Vectors that are null, zero, empty or hold null, NaN or infinite components link with nothing, nor do vectors of different lengths. Rows that
    repeat a vec_id are vectors of their own. A null vec_id counts as a link but names no component: of such rows alone component_id
    is null, and they are kept.
    """
    spark = vectors.sparkSession
    shipped(spark)
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    x = F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists(x, lambda v: v != 0)
    given = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("vec"), (x.isNotNull() & ~F.coalesce(bad, F.lit(True))).alias("good"))
    rows = written(by_arrow(given, _keyed(kind), "row bigint, vec_id bigint, digest binary, data binary"), "vectors")

    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("row").alias("node"), F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    bits, tables = tables_for(classes.count(), cosine)
    nodes = written(rows.select(F.col("row").alias("node"), "data").join(classes.select("node", "copies"), "node"), "nodes")
    hashed = written(by_arrow(nodes.select("node", "data"), _hashed(kind, bits, tables, seed), "node bigint, keys array<bigint>, " + ", ".join(f"s{j} bigint" for j in range(WORDS))), "signs")

    met = hashed.select(F.explode("keys").alias("key"), "node")
    sizes = written(met.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    met = written(met.join(sizes, "key"), "members")
    crowd = met.where(F.col("members") > FEW)
    crowds = written(crowd.groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("crowded")), "crowds")

    # pairs of small buckets
    signs = hashed.drop("keys")
    small = written(met.where(F.col("members") <= FEW).select("key", "node").join(signs, "node"), "small")
    p, q = small.alias("p"), small.alias("q")
    apart = sum((F.bit_count(F.col(f"p.s{j}").bitwiseXOR(F.col(f"q.s{j}"))) for j in range(WORDS)), F.lit(0))
    share = math.acos(min(max(cosine, -1.0), 1.0)) / math.pi
    most = 64 * WORDS * share + SLACK * math.sqrt(64 * WORDS * share * (1 - share))
    pairs = p.join(q, F.col("p.key") == F.col("q.key")).where((F.col("p.node") > F.col("q.node")) & (apart <= most)).select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()
    pairs = written(pairs, "pairs")
    of = lambda s: crowds.select(F.col("node").alias(s), F.col("crowded").alias(f"crowded_{s}"))
    # a pair that shares a crowded bucket counts there
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(~F.coalesce(F.arrays_overlap("crowded_a", "crowded_b"), F.lit(False))).select("a", "b")
    sides = nodes.select(F.col("node").alias("doc_id"), F.struct("data", "copies").alias("side"))
    both = with_sides(written(pairs, "candidates"), sides, "side").select("a", "b", F.col("side_a.data").alias("data_a"), F.col("side_b.data").alias("data_b"), F.col("side_a.copies").alias("copies_a"), F.col("side_b.copies").alias("copies_b"))
    links = written(by_arrow(both, _linked(kind, cosine), "a bigint, b bigint, copies_a bigint, copies_b bigint"), "pairs")

    # crowded buckets, in tiles of two blocks
    blocks = F.ceil(F.col("members") / TILE)
    placed = crowd.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = placed.join(crowds, "node").join(nodes, "node").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "block", "copies", "data", "crowded")
    # a tile of one block holds its rows once; so does one of two
    tiles = written(placed.groupBy("key", "low", "high").applyInPandas(_tile(kind, cosine), "node bigint, links bigint, root bigint"), "tiles")

    edges = links.select("a", "b").unionByName(tiles.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    roots = connected(edges)
    count = links.select("a", F.col("copies_b").alias("n")).unionByName(links.select(F.col("b").alias("a"), F.col("copies_a").alias("n"))).unionByName(tiles.select(F.col("node").alias("a"), F.col("links").alias("n")))
    count = written(count.groupBy("a").agg(F.sum("n").alias("n")), "counts")
    rooted = classes.join(roots, "node", "left").select("digest", "node", "first_id", "copies", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted.join(count, rooted.node == count.a, "left").select("digest", "root", "first_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "rooted")
    first = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("nodes")), "components")
    # only nodes with links look up a name
    named = rooted.join(first.where("nodes > 1").select(F.col("root").alias("r"), "component_id"), F.col("root") == F.col("r"), "left").select("digest", "n_links", F.coalesce("component_id", "first_id").alias("component_id"))
    named = written(named, "named")
    out = rows.select("vec_id", "digest").join(named.withColumnRenamed("digest", "of"), F.col("digest") == F.col("of"), "left")
    bad_row = F.col("digest").isNull()
    component = F.when(bad_row, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def near_sql(cosine: float = 0.95) -> str:
    """The same rows in DuckDB SQL over all pairs, for ids that don't repeat."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {cosine}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a"""
