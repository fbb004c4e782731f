"""Exact top-k by inner product as a Voronoi kNN join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import by_arrow, shipped, written

#: Vectors a cell aims at (in large tables there are as many cells as the root of the rows) and rows of a block.
CELL_ROWS, BLOCK_ROWS = 2048, 4096
#: Bytes that a task may hold for the queries of its team, parts that a team's blocks make at least (a block each), pairs of query and row a part.
TEAM_BYTES, PARTS, PART_PAIRS = 1 << 26, 32, 1 << 35
#: Queries and rows that are multiplied at once; rows of a cell from which it is worth asking who needs it.
QUERY_STEP, ROW_STEP, FEW_ROWS = 512, 1024, 64
#: Bytes, as 64-bit numbers, of the rows drawn for a first bound, and one in how many rows at most.
SAMPLE_BYTES, SAMPLE_SHARE = 1 << 24, 16
#: Below these, sums of integer products are exact in a float, in a double and in 64 bits.
SHORT, EXACT, LONG = 2.0**24, 2.0**53, 2.0**63
LEAST = -(2**63)


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, vec array<bigint>, dim): floor(scale * component), components as doubles.

    Vectors that are null or hold null, NaN or infinite components are left out.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("x").isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("bigint")).alias("vec"), F.size("x").alias("dim"))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products of integer rows, exactly; beyond 64 bits the nearest number of 64 bits."""
    most = float(np.abs(q.astype(float)).max()) * float(np.abs(x.astype(float)).max()) * q.shape[1] if q.size and x.size else 0.0
    if most < EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < LONG:
        return q @ x.T
    whole = q.astype(object) @ x.astype(object).T
    return np.array([[min(max(v, -(2**63)), 2**63 - 1) for v in row] for row in whole], np.int64).reshape(whole.shape)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(1))


def _rows_of(vecs: pa.Array, rows: np.ndarray, d: int) -> np.ndarray:
    """Those vectors of a list column, all of length d."""
    flat, offsets = vecs.values.to_numpy(zero_copy_only=False), vecs.offsets.to_numpy()
    return flat[offsets[rows][:, None] + np.arange(d)]


def packed(x: np.ndarray) -> pa.Array:
    """Integer rows as bytes, in the narrowest of 16, 32 and 64 bits that holds all of them."""
    most = max(int(x.max()), -int(x.min()) - 1) if x.size else 0
    x = np.ascontiguousarray(x.astype(next(t for t in ("<i2", "<i4", "<i8") if most <= np.iinfo(t).max)))
    offsets = np.arange(len(x) + 1, dtype=np.int64) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)]).cast(pa.binary())


def unpacked(column: pa.Array, d: int) -> np.ndarray:
    """What packed() made, of vectors of length d."""
    column = column.cast(pa.large_binary())
    if not d or not len(column):
        return np.zeros((len(column), d), np.int16)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data, width = np.frombuffer(column.buffers()[2], np.uint8), np.diff(offsets) // d
    out = np.zeros((len(column), d), f"<i{width.max()}")
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        own = data[offsets[0] : offsets[-1]] if len(rows) == len(out) else data[offsets[rows][:, None] + np.arange(d * w)]
        out[rows] = own.reshape(-1).view(f"<i{w}").reshape(-1, d)
    return out


def _located(pivots: dict[int, np.ndarray], every: int):
    """Each vector's nearest pivot and distance to it; pivots by dimension. Only a query keeps its vector as a list, and has its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            dims, who = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "vec_id"))
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                x = _rows_of(batch.column("vec"), rows, d)
                cell, far, norm = np.zeros(len(rows), np.int32), np.zeros(len(rows)), lengths(x)
                p = pivots[d].astype(np.float64)
                # any cell will do for a row, so that floats are good enough to choose it
                kind = np.float32 if max(norm.max(), lengths(p).max()) < SHORT else np.float64
                half, turned = ((p * p).sum(1) / 2).astype(kind), np.ascontiguousarray(p.T, kind)
                step = max(1, (1 << 20) // len(p))
                for at in range(0, len(rows), step):
                    part = x[at : at + step]
                    own = part.astype(kind) @ turned
                    cell[at : at + step] = own = np.subtract(half, own, out=own).argmin(1)
                    # measured from the difference, as the expansion above cancels
                    far[at : at + step] = lengths(part - p[own])
                asks = who[rows] % every == 0
                vec = batch.column("vec").take(pa.array(np.where(asks, rows, -1), mask=~asks))
                turns = pa.array((turn + np.arange(len(rows))) % (1 << 30), pa.int32())
                turn += len(rows)
                columns = [pa.array(who[rows]), packed(x), vec, pa.array(dims[rows]), pa.array(cell), pa.array(far), pa.array(norm), turns]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "packed", "vec", "dim", "cell", "far", "norm", "turn"])

    return run


def _needed(pivots: dict[int, np.ndarray], drawn: dict[int, tuple[np.ndarray, np.ndarray]], radius: dict[int, np.ndarray], near: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int):
    """For each query a lower bound on its k-th best score, and in one row of a batch for each team the cells that could beat some query's bound.

    drawn: vec_ids and vectors of some rows; radius: of each cell, -1 if nothing lies in it; near: for each vector length
    the cell, distance to the pivot and vec_id of the k rows nearest to each pivot.
    """

    def from_near(q: np.ndarray, who: np.ndarray, norm: np.ndarray, d: int) -> np.ndarray:
        """Rows of the data score at least q.p - |q| * distance: the k-th best of these bounds the k-th best of all."""
        cell, far, row = near[d]
        if len(cell) < k:
            return np.full(len(q), LEAST, np.int64)
        low, reach = products(q, pivots[d])[:, cell].astype(np.float64), norm[:, None] * far
        low = low - reach - 1e-9 * (np.abs(low) + reach) - 1
        low[row == who[:, None]] = -np.inf
        return np.floor(np.maximum(np.partition(low, len(cell) - k, axis=1)[:, len(cell) - k], LEAST)).astype(np.int64)

    def reached(q: np.ndarray, norm: np.ndarray, least: np.ndarray, d: int) -> np.ndarray:
        """q.x <= q.p + |q| * radius for every x of p's cell; a part in 10^9 more for rounding."""
        own, reach = products(q, pivots[d]).astype(np.float64), norm[:, None] * np.maximum(radius[d], 0)
        return (own + reach + 1e-9 * (np.abs(own) + reach) + 1 >= least[:, None]) & (radius[d] >= 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, who, team, norm = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "vec_id", "team", "norm"))
            least, cells = np.zeros(len(dims), np.int64), [None] * len(dims)
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                q, own, far = _rows_of(batch.column("vec"), rows, d), who[rows], norm[rows]
                step = max(1, (1 << 20) // max(len(pivots[d]), len(near[d][0])))
                steps = [slice(at, at + step) for at in range(0, len(rows), step)]
                asked = _Team(own, q, np.concatenate([from_near(q[i], own[i], far[i], d) for i in steps]), k)
                asked.meet(*drawn[d], np.arange(len(rows)))
                least[rows] = asked.line
                teams, first, place = np.unique(team[rows], return_index=True, return_inverse=True)
                wanted = np.zeros((len(teams), len(pivots[d])), bool)
                for i in steps:
                    np.logical_or.at(wanted, place[i], reached(q[i], far[i], asked.line[i], d))
                for t, r in zip(wanted, rows[first]):
                    cells[r] = np.flatnonzero(t).tolist()
            columns = [*(batch.column(c) for c in ("vec_id", "packed", "dim", "team")), pa.array(least), pa.array(cells, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "packed", "dim", "team", "least", "cells"])

    return run


class _Team:
    """The queries that meet the rows of one part, and their best rows so far: scores and vec_ids in order, `have` of them."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.k, self.norm = ids, k, lengths(q)
        self.forms, self.longest = {q.dtype: q}, float(self.norm.max())
        self.whole = q
        self.line = least.copy()  # no lower score can be among the best
        self.score, self.row, self.have = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64), np.zeros(len(ids), np.int64)

    def form(self, kind) -> np.ndarray:
        if kind not in self.forms:
            self.forms = {kind: self.whole.astype(kind)}
        return self.forms[kind]

    def who_needs(self, pivot: np.ndarray, radius: float) -> np.ndarray:
        """The queries for which a row of that cell could be among the best."""
        far = float(lengths(pivot[None])[0])
        kind = np.float32 if self.longest * far < SHORT * 0.999 else np.float64
        own, reach = (self.form(kind) @ pivot.astype(kind)).astype(np.float64), self.norm * radius
        return np.flatnonzero(own + reach + 1e-9 * (self.norm * far + reach) + 1 >= self.line)

    def meet(self, ids: np.ndarray, x: np.ndarray, asking: np.ndarray) -> None:
        """Holds rows against the queries at those places."""
        if not len(ids) or not len(asking):
            return
        # |q| * |x| bounds every sum of products of their components, in whatever order
        most = self.longest * float(lengths(x).max())
        kind = np.float32 if most < SHORT * 0.999 else np.float64 if most < EXACT * 0.999 else None
        x = x.astype(kind or np.int64)
        q = self.form(kind) if kind else self.whole
        often = int(np.unique(ids, return_counts=True)[1].max())
        for at in range(0, len(asking), QUERY_STEP):
            who, found, held = asking[at : at + QUERY_STEP], [], 0
            own = q[who] if kind else q[who].astype(np.int64)
            for b in range(0, len(x), ROW_STEP):
                part = x[b : b + ROW_STEP]
                r, v, c = self.passing(who, own @ part.T if kind else products(own, part), kind, often)
                if len(r):
                    found.append((r, v, ids[b + c]))
                    held += len(r)
                if found and (held > 2 * self.k * len(who) or b + ROW_STEP >= len(x)):
                    self.keep(*(np.concatenate(f) for f in zip(*found)))
                    found, held = [], 0

    def passing(self, who: np.ndarray, s: np.ndarray, kind, often: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, scores and places of the rows that reach their query's line; a vec_id has at most `often` rows."""
        line = self.line[who]
        if kind:  # scores of a kind are all above its bound
            line = np.maximum(line, -int(SHORT if kind is np.float32 else EXACT)).astype(kind)
        hit = np.flatnonzero(s.max(1) >= line)
        if len(hit) < len(who):
            who, s, line = who[hit], s[hit], line[hit]
        found = np.flatnonzero(s >= line[:, None])
        at = s.shape[1] - self.k - often
        if at >= 0 and len(found) > 4 * self.k * len(hit):
            # many pass: the k-th best of these rows is a line too; a query's own rows don't count
            line = np.maximum(line, np.partition(s, at, axis=1)[:, at])
            self.line[who] = np.maximum(self.line[who], line.astype(np.int64))
            found = np.flatnonzero(s >= line[:, None])
        r, c = np.divmod(found, s.shape[1])
        return who[r], s.reshape(-1)[found].astype(np.int64), c

    def keep(self, q: np.ndarray, v: np.ndarray, i: np.ndarray) -> None:
        """Merges found rows with those that these queries have."""
        last, last_row = self.score[q, self.k - 1], self.row[q, self.k - 1]
        fine = (i != self.ids[q]) & ((self.have[q] < self.k) | (v > last) | ((v == last) & (i < last_row)))
        q, v, i = q[fine], v[fine], i[fine]
        own = np.unique(q)
        a, b = np.nonzero(np.arange(self.k) < self.have[own][:, None])
        q, v, i = np.concatenate([q, own[a]]), np.concatenate([v, self.score[own[a], b]]), np.concatenate([i, self.row[own[a], b]])
        order = np.lexsort((i, ~v, q))
        q, v, i = q[order], v[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = place < self.k
        self.score[q[best], place[best]], self.row[q[best], place[best]] = v[best], i[best]
        self.have[own] = np.minimum(np.searchsorted(q, own, "right") - np.searchsorted(q, own), self.k)
        full = own[self.have[own] == self.k]
        self.line[full] = np.maximum(self.line[full], self.score[full, self.k - 1])

    def best(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.ids), 1 << 13):
            a, b = np.nonzero(np.arange(self.k) < self.have[at : at + (1 << 13)][:, None])
            a += at
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[a]), pa.array(self.row[a, b]), pa.array(self.score[a, b])], ["query_id", "vec_id", "score"])


def _solved(pivots: dict[int, np.ndarray], radius: dict[int, np.ndarray], k: int):
    """The best k rows of each part for each of its queries; a part's queries come before its rows, and these cell by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, team = None, [], None
        for batch in batches:
            part, asks, cell = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "asks", "cell"))
            turns = [0, *(np.flatnonzero((np.diff(part) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1).tolist(), len(part)]
            for a, b in zip(turns, turns[1:]):
                if a == b:
                    continue
                if part[a] != at:
                    if team:
                        yield from team.best()
                    at, asked, team = part[a], [], None
                own = batch.slice(a, b - a)
                d = own.column("dim")[0].as_py()
                ids, x = own.column("vec_id").to_numpy(), unpacked(own.column("packed"), d)
                if asks[a]:
                    asked.append((ids, x, own.column("least").to_numpy()))
                    continue
                if asked:
                    team, asked = _Team(*(np.concatenate(c) for c in zip(*asked)), k), []
                if team:
                    everyone, rest = np.arange(len(team.ids)), []
                    runs = [0, *(np.flatnonzero(np.diff(cell[a:b])) + 1).tolist(), b - a]
                    for e, f in zip(runs, runs[1:]):
                        c = int(cell[a + e])
                        who = team.who_needs(pivots[d][c], float(radius[d][c])) if f - e >= FEW_ROWS else everyone
                        if 4 * len(who) > 3 * len(everyone):
                            rest.append(np.arange(e, f))
                        else:
                            team.meet(ids[e:f], x[e:f], who)
                    if rest:
                        rest = np.concatenate(rest)
                        team.meet(ids[rest], x[rest], everyone)
        if team:
            yield from team.best()

    return run


def _pivots(data: DataFrame, n: dict[int, int], k: int) -> dict[int, np.ndarray]:
    """Rows for each vector length, the first by a hash of their ids.

    They are put in order as a table, so that the driver gets the rows that it keeps alone, not as many from each task; only
    hashes that can be among the first are looked at, unless too few are.
    """
    pivots = {}
    for d, c in n.items():
        few = max(k + 2, min(c // CELL_ROWS, math.isqrt(c)))
        own, rows = data.where(F.col("dim") == d), []
        for some in (own.where(_share((2 * few + 64) / c)), own):
            if len(rows) < min(few, c):
                rows = written(some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(few), "pivots").collect()
        pivots[d] = np.array([r["vec"] for r in rows], np.int64).reshape(len(rows), d)
    return pivots


def _share(share: float):
    """Rows of about that share of all ids, by hash."""
    return F.xxhash64("vec_id") <= F.lit(min(LEAST + int(share * 2**64), 2**63 - 1))


def _drawn(located: DataFrame, n: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """vec_ids and vectors of some rows for each vector length, as many as SAMPLE_BYTES hold."""
    drawn = {}
    for d, c in n.items():
        most = max(1, min(SAMPLE_BYTES // (8 * d + 8), c // SAMPLE_SHARE))
        rows = located.where((F.col("dim") == d) & _share(1.2 * most / c)).select("vec_id", "packed").limit(most).toArrow()
        drawn[d] = rows["vec_id"].to_numpy(), unpacked(rows["packed"].combine_chunks(), d)
    return drawn


def top_k(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row whose vec_id is divisible by `every`.

    Candidates are all other rows of the same length; ties go to the smaller vec_id. Pivots (rows for each vector
    length, drawn by hash, at most as many as the root of the rows) part the data into cells. Queries are grouped by
    pivot as well. The k rows nearest to each pivot are a cell's summary: they, and some drawn rows, bound a query's k-th best
    score from below, and a cell's pivot and radius bound its scores from above, so that blocks of a cell are replicated
    only to the teams of queries that it could serve. A team has as many queries as a task may hold; its blocks are
    dealt to parts, cell after cell, and each part is one task that has the team's queries and lets the rows of its blocks
    pass, asking once more for each cell which queries need it. The best k of each part are merged. Queries travel once
    a part and rows once a team, as bytes; neither is ever multiplied by cells, and only tables of blocks and teams are broadcast.
    Rows that repeat a vec_id count each as candidates; as a query such an id is its first
    vector in order. Rows with a null vec_id take no part. Sums beyond 64 bits become the nearest number of 64 bits.
    """
    spark = vectors.sparkSession
    shipped(spark)
    data = integer_vectors(vectors)
    n = {r[0]: r[1] for r in data.groupBy("dim").agg(F.count("*")).collect()}
    pivots = _pivots(data, n, k)
    schema = "vec_id bigint, packed binary, vec array<bigint>, dim int, cell int, far double, norm double, turn int"
    located = written(by_arrow(data, _located(pivots, every), schema), "vectors")
    drawn = _drawn(located, n)
    radius, rows_in = ({d: np.full(len(p), v) for d, p in pivots.items()} for v in (-1.0, 0))
    for d, c, far, m in located.groupBy("dim", "cell").agg(F.max("far"), F.count("*")).collect():
        radius[d][c], rows_in[d][c] = far, m
    # the k rows nearest to each pivot: k numbers a cell, first within tasks
    rows = located.select("dim", "cell", "far", "vec_id", F.spark_partition_id().alias("task"))
    for by in (("dim", "cell", "task"), ("dim", "cell")):
        rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("far", "vec_id"))).where(F.col("at") <= k)
    nearest = rows.select("dim", "cell", "far", "vec_id").toPandas()
    near = {d: tuple(nearest.loc[nearest["dim"] == d, c].to_numpy() for c in ("cell", "far", "vec_id")) for d in n}

    same = F.min(F.struct("vec", "packed", "dim", "cell", "norm")).alias("q")
    queries = located.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(same).select("vec_id", "q.*")
    asked = {(r[0], r[1]): r[2] for r in queries.groupBy("dim", "cell").agg(F.count("*")).collect()}
    # neighbouring cells make a team until it has its share of queries; a crowded cell makes several
    base, team, have, last = [], -1, 0, None
    for d in sorted(n):
        p = pivots[d].astype(float)
        most = max(1, TEAM_BYTES // (12 * d + 16 * k + 64))
        for c in np.argsort(((p - p[:1]) ** 2).sum(1), kind="stable").tolist():
            if m := asked.get((d, c), 0):
                if last != d or have + m > most:
                    team, have = team + 1, 0
                split = -(-m // most)
                base.append((d, c, team, split))
                team, have, last = team + split - 1, have + m, d
    homes = spark.createDataFrame(base, "dim int, cell int, first_team int, split int")
    grouped = queries.join(homes, ["dim", "cell"]).withColumn("team", F.col("first_team") + F.pmod(F.xxhash64("vec_id"), F.col("split")).cast("int"))
    schema = "vec_id bigint, packed binary, dim int, team int, least bigint, cells array<int>"
    bounded = written(by_arrow(grouped.select("vec_id", "vec", "packed", "dim", "team", "norm"), _needed(pivots, drawn, radius, near, k), schema), "queries")

    # a row for each cell, one for each team and cell it needs, and one for each of the cell's blocks: tables of some rows a block
    counted = [(int(d), c, int(m), -(-int(m) // BLOCK_ROWS)) for d in n for c, m in enumerate(rows_in[d]) if m]
    cells = spark.createDataFrame(counted, "dim int, cell int, rows bigint, blocks int")
    needs = bounded.select("dim", "team", F.explode("cells").alias("cell")).distinct().join(F.broadcast(cells), ["dim", "cell"])
    totals = needs.groupBy("team").agg(F.sum("rows").alias("rows"), F.sum("blocks").alias("blocks"))
    parts, deals = 0, []
    for t, m, some, asks in sorted(totals.join(bounded.groupBy("team").agg(F.count("*").alias("asks")), "team").collect()):
        own = max(min(PARTS, some), -(-m * asks // PART_PAIRS))
        deals.append((t, parts, own, m))
        parts += own
    deals = F.broadcast(spark.createDataFrame(deals, "team int, first int, parts int, total bigint"))
    before = F.sum(F.col("rows") / F.col("blocks")).over(Window.partitionBy("team").orderBy("cell", "block").rowsBetween(Window.unboundedPreceding, -1))
    placed = needs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("before", F.coalesce(before, F.lit(0.0))).join(deals, "team")
    part = F.col("first") + F.least(F.floor(F.col("before") * F.col("parts") / F.col("total")), F.col("parts") - 1).cast("int")
    placed = written(placed.groupBy("dim", "cell", "block", "blocks").agg(F.collect_list(part).alias("to")), "blocks")

    of = located.select("vec_id", "packed", "dim", "cell", "turn").join(F.broadcast(cells.select("dim", "cell", "blocks")), ["dim", "cell"])
    of = of.withColumn("block", F.col("turn") % F.col("blocks")).join(F.broadcast(placed.drop("blocks")), ["dim", "cell", "block"])
    sent = of.select(F.explode("to").alias("part"), F.lit(False).alias("asks"), "vec_id", "packed", "dim", "cell", F.lit(None).cast("bigint").alias("least"))
    everywhere = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1))
    asking = bounded.join(deals, "team").select(everywhere.alias("part"), F.lit(True).alias("asks"), "vec_id", "packed", "dim", F.lit(-1).alias("cell"), "least")
    met = asking.unionByName(sent).repartitionById(max(parts, 1), F.col("part")).sortWithinPartitions("part", F.desc("asks"), "cell")
    found = by_arrow(met, _solved(pivots, radius, k), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
