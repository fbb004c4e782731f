"""Vectors compressed to codes of eight entries: rounds over Hilbert-sorted blocks with boxes and sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import by_arrow, written

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Rows of a block: they share a box, sums and a list of entries that may be nearest.
BLOCK = 64
#: Below the first, sums of integer products are exact in a double; below the second in 64 bits.
EXACT, LONG = 2**53, 2**63


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of whole numbers (n x d, each of `bits` bits, d * bits <= 63) along a Hilbert curve through all of them."""
    axes = x.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):  # undo the turns of each level, from the coarsest
        low = np.uint64((1 << b) - 1)
        for i in range(len(axes)):
            hit = (axes[i] >> np.uint64(b)) & one == one
            swap = np.where(hit, np.uint64(0), (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(hit, low, swap)
            axes[i] ^= swap
    for i in range(1, len(axes)):  # Gray code across the axes
        axes[i] ^= axes[i - 1]
    flip = np.zeros(axes.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((axes[-1] >> np.uint64(b)) & one == one, np.uint64((1 << b) - 1), np.uint64(0))
    axes ^= flip
    key = np.zeros(axes.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for a in axes:
            key = (key << one) | ((a >> np.uint64(b)) & one)
    return key


def hilbert_order(x: np.ndarray) -> np.ndarray:
    """The rows' order along a Hilbert curve through their common box, on a grid as fine as 62 bits allow (at most 62 axes count)."""
    d = min(x.shape[1], 62)
    if not d or len(x) < 2:
        return np.arange(len(x))
    bits = min(62 // d, 16)
    y = x[:, :d].astype(np.float64)
    low = y.min(0)
    wide = np.maximum(y.max(0) - low, 1)
    grid = np.minimum((y - low) / wide * (1 << bits), (1 << bits) - 1)
    return np.argsort(hilbert_keys(grid.astype(np.int64), bits), kind="stable")


def most_of(*arrays: np.ndarray) -> int:
    return max([max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size] or [0])


def exactly(most: int, times: int, *arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as doubles, 64-bit or Python's whole numbers, whichever keeps sums of `times` squares of differences exact."""
    need = 4 * max(times, 1) * most * most
    kind = np.float64 if need < EXACT else np.int64 if need < LONG else object
    return [a.astype(kind) for a in arrays]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry (ties to the lower) and the squared distance, exactly."""
    x, entries = exactly(most_of(x, entries), x.shape[1], x, entries)
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    square = (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)
    at = square.argmin(1)
    return at, square[np.arange(len(x)), at]


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Blocks by entries: whether the entry is as near to the block's box as any entry's farthest point of it, so that it can be nearest to a row."""
    low, high, entries = exactly(most_of(low, high, entries), low.shape[1], low, high, entries)
    if not low.shape[1]:
        return np.arange(len(entries))[None, :] == np.zeros(len(low), int)[:, None]
    e, zero = entries[None], entries[:1, :1] * 0
    near = np.maximum(np.maximum(low[:, None] - e, e - high[:, None]), zero)
    far = np.maximum(e - low[:, None], high[:, None] - e)
    return (near * near).sum(2) <= (far * far).sum(2).min(1)[:, None]


class Part:
    """One part position of a segment: rows along the curve, in flat blocks of BLOCK rows with boxes and sums."""

    def __init__(self, flat: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray | None):
        self.flat, self.low, self.high = flat, low, high
        self.sums = sums if sums is not None else np.add.reduceat(flat.astype(object), np.arange(0, len(flat), BLOCK), axis=0)

    def groups(self, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(blocks, entries that may be nearest) for each distinct list of entries."""
        may = shortlists(self.low, self.high, entries)
        packed = np.packbits(may, axis=1)
        for kind in np.unique(packed, axis=0):
            blocks = np.flatnonzero((packed == kind).all(1))
            yield blocks, np.flatnonzero(may[blocks[0]])

    def rows(self, blocks: np.ndarray) -> np.ndarray:
        at = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        return at[at < len(self.flat)]

    def sizes(self, blocks: np.ndarray) -> np.ndarray:
        return np.minimum(len(self.flat) - blocks * BLOCK, BLOCK)


def whole_sum(x: np.ndarray) -> list[int]:
    """Sums by column as Python's numbers."""
    kind = np.int64 if most_of(x) * max(len(x), 1) < LONG else object
    return [int(v) for v in x.astype(kind).sum(0)] if len(x) else [0] * x.shape[1]


def _segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment for each batch and vector length; each part position has its own order of the rows."""
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        vecs = batch.column("vec")
        flat, offsets = vecs.values.to_numpy(zero_copy_only=False), vecs.offsets.to_numpy()
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            x = flat[offsets[rows][:, None] + np.arange(d)].astype(np.int64)
            most = most_of(x)
            width = 2 if most < 2**15 else 4 if most < 2**31 else 8
            starts = np.arange(0, len(x), BLOCK)
            order, data, low, high, sums = [], [], [], [], []
            for p in range(PARTS):
                part = x[:, p * d // PARTS : (p + 1) * d // PARTS]
                at = hilbert_order(part)
                part = part[at]
                order.append(at.astype("<i4").tobytes())
                data.append(part.astype(f"<i{width}").tobytes())
                low.append(np.minimum.reduceat(part, starts, axis=0).astype("<i8").tobytes())
                high.append(np.maximum.reduceat(part, starts, axis=0).astype("<i8").tobytes())
                sums.append(np.add.reduceat(part, starts, axis=0).astype("<i8").tobytes() if most * BLOCK < LONG else None)
            take = pa.array(rows)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), batch.column(c).take(take)) for c in ("vec_id", "label")]
            binary = [pa.array([v], pa.list_(pa.binary())) for v in (order, data, low, high, sums)]
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *lists, pa.array([width], pa.int32()), *binary], ["dim", "vec_id", "label", "width", "order", "data", "low", "high", "sums"])


def _parts(batch: pa.RecordBatch, i: int) -> Iterator[Part]:
    d, width = batch.column("dim")[i].as_py() // PARTS, batch.column("width")[i].as_py()
    n = len(batch.column("vec_id")[i].values)
    data, low, high, sums = (batch.column(c)[i].as_py() for c in ("data", "low", "high", "sums"))
    wide = lambda b: np.frombuffer(b, "<i8").reshape(-(-n // BLOCK), d)
    for p in range(PARTS):
        yield Part(np.frombuffer(data[p], f"<i{width}").reshape(n, d).astype(np.int64), wide(low[p]), wide(high[p]), wide(sums[p]) if sums[p] is not None else None)


def _round(books: dict[int, list[np.ndarray]]):
    """Counts and component sums of each entry's parts; blocks whose list has one entry give their stored sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], list[int]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                d = batch.column("dim")[i].as_py()
                for p, part in enumerate(_parts(batch, i)):
                    for blocks, may in part.groups(books[d][p]):
                        if len(may) == 1:
                            found = [(may[0], int(part.sizes(blocks).sum()), whole_sum(part.sums[blocks]))]
                        else:
                            x = part.flat[part.rows(blocks)]
                            at, _ = nearest(x, books[d][p][may])
                            found = [(may[k], int((at == k).sum()), whole_sum(x[at == k])) for k in np.unique(at)]
                        for entry, n, sums in found:
                            have = total.setdefault((d, p, int(entry)), [0] * (d // PARTS + 1))
                            for j, v in enumerate([n, *sums]):
                                have[j] += v
        rows = [(d, p, e, at - 1, Decimal(v)) for (d, p, e), have in total.items() for at, v in enumerate(have)]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["dim", "part", "entry", "place", "value"])

    return run


def _assigned(books: dict[int, list[np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                d = batch.column("dim")[i].as_py()
                ids, labels = (batch.column(c)[i].values for c in ("vec_id", "label"))
                codes, error = np.zeros((len(ids), PARTS), np.uint8), np.zeros(len(ids), object)
                orders = batch.column("order")[i].as_py()
                for p, part in enumerate(_parts(batch, i)):
                    order = np.frombuffer(orders[p], "<i4")
                    for blocks, may in part.groups(books[d][p]):
                        rows = part.rows(blocks)
                        at, far = nearest(part.flat[rows], books[d][p][may])
                        codes[order[rows], p] = may[at]
                        error[order[rows]] += np.array([int(v) for v in far], object)
                code = [row.tobytes().hex() for row in codes]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([d] * len(ids), pa.int32()), pa.array(code, pa.string()), pa.array([min(int(e), LONG - 1) for e in error], pa.int64())], ["vec_id", "label", "dim", "code", "error"])

    return run


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, vec (floor(scale * component)), dim; without vectors that are null or hold null, NaN or infinite components, or can't be cut into PARTS equal parts."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", x.alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(False)) & (F.size("x") % PARTS == 0))
    return rows.select("vec_id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("bigint")).alias("vec"), F.size("x").alias("dim"))


def vector_segments(data: DataFrame) -> DataFrame:
    """The vectors as segments of some thousand rows, each part position sorted along its Hilbert curve and cut into blocks."""
    kind = data.schema["label"].dataType.simpleString()
    schema = f"dim int, vec_id array<bigint>, label array<{kind}>, width int, order array<binary>, data array<binary>, low array<binary>, high array<binary>, sums array<binary>"
    return written(by_arrow(data, _segmented, schema), "segments")


def fit_codebooks(data: DataFrame, segments: DataFrame, rounds: int = ROUNDS) -> dict[int, list[np.ndarray]]:
    """Codebooks (entries by components) of each part position, by vector length.

    They start as the parts of the first ENTRIES rows by vec_id (null last; then by vector). A round sends the driver one number for each
    entry and component of the codebooks, never rows.
    """
    books = {}
    for (d,) in segments.select("dim").distinct().collect():
        rows = data.where(F.col("dim") == d).orderBy(F.asc_nulls_last("vec_id"), "vec").limit(ENTRIES).select("vec").collect()
        first = np.array([r[0] for r in rows], np.int64).reshape(len(rows), d)
        books[d] = [first[:, p * d // PARTS : (p + 1) * d // PARTS] for p in range(PARTS)]
    parts = segments.select("dim", "vec_id", "width", "data", "low", "high", "sums")
    for _ in range(rounds if books else 0):
        sums = by_arrow(parts, _round(books), "dim int, part int, entry int, place int, value decimal(38,0)")
        found: dict[tuple[int, int, int], dict[int, int]] = {}
        for d, p, e, at, v in sums.groupBy("dim", "part", "entry", "place").agg(F.sum("value")).collect():
            found.setdefault((d, p, e), {})[at] = int(v)
        books = {d: [b.copy() for b in of] for d, of in books.items()}
        for (d, p, e), values in found.items():
            books[d][p][e] = [values[j] // values[-1] for j in range(d // PARTS)]
    return books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def compressed(vectors: DataFrame, scale: int = 4096, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row per kept vector.

    Left out: vectors that are null, hold null, NaN or infinite components, or whose length is no multiple of PARTS. Each vector length has
    codebooks (and a digest) of its own, of fewer entries where it has fewer rows. Rows that repeat a vec_id or have none are rows like others.
    Components beyond 64 bits become the nearest number of 64 bits, and so do errors.

    Segments are sorted where they lie: rows are never shuffled. In each round a block's box decides which entries can be
    nearest to its rows; exact integer kernels choose among these, and blocks with one such entry add their stored sums.
    """
    data = whole_vectors(vectors, scale)
    segments = vector_segments(data)
    books = fit_codebooks(data, segments, rounds)
    kind = data.schema["label"].dataType.simpleString()
    out = by_arrow(segments, _assigned(books), f"vec_id bigint, label {kind}, dim int, code string, error bigint")
    out = written(out, "codes")
    sums = out.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG - 1).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    sums = written(sums.withColumnRenamed("label", "of"), "labels")
    digest = F.lit(None).cast("string")
    for d, of in books.items():
        digest = F.when(F.col("dim") == d, books_digest(of)).otherwise(digest)
    return out.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def codes_sql(scale: int = 4096, rounds: int = ROUNDS) -> str:
    """The same rows in DuckDB SQL, for vectors of one length and ids that don't repeat."""
    part, place = "(i - 1) * 8 // n", "(i - 1) % (n // 8)"
    out = f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, embedding AS x, len(embedding) AS n FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) % 8 = 0),
x AS MATERIALIZED (SELECT vec_id, {part} AS part, {place} AS place, CAST(floor({scale} * CAST(x[i] AS DOUBLE)) AS BIGINT) AS v FROM v, range(1, 65536) r(i) WHERE i <= n),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {ENTRIES}),
b0 AS MATERIALIZED (SELECT part, entry, place, v FROM x JOIN s USING (vec_id))"""
    for r in range(rounds + 1):
        out += f""",
d{r} AS MATERIALIZED (SELECT vec_id, part, entry, sum((x.v - b.v) * (x.v - b.v)) AS far FROM x JOIN b{r} b USING (part, place) GROUP BY vec_id, part, entry),
a{r} AS MATERIALIZED (SELECT vec_id, part, entry, far FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY far, entry) = 1)"""
        if r < rounds:
            out += f""",
m{r} AS (SELECT part, entry, place, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM x JOIN a{r} USING (vec_id, part) GROUP BY part, entry, place),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (part, entry, place))"""
    return out + f""",
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) FROM b{rounds}) AS codebooks_sha256 FROM c JOIN v USING (vec_id)"""
