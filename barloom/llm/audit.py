"""How filters interact: every order of five filters, from a sparse document-term matrix and flags."""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import as_bytes, by_arrow, cut_text, gathered, written

#: Bytes of text that one shard of the matrix aims at; a longer text is a shard of its own.
SHARD_BYTES = 16 << 20
#: Ranges of hashes in which words are numbered.
WORD_RANGES = 1 << 14

FILTERS = "ABCDE"
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_INNER = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"

_ROW = pa.struct([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("upper", pa.bool_()), ("marks", pa.bool_())])
_ROW_SQL = "array<struct<doc_id:bigint, part:string, digest:binary, upper:boolean, marks:boolean>>"


def counted(text: bytes) -> Counter:
    """How often each word occurs; bytes.split() parts at the white space of the contract. Long texts go by parts."""
    words: Counter = Counter()
    for part in cut_text(text):
        words.update(part.split())
    return words


def fresh() -> tuple:
    """An empty shard's rows, row ends, words (a new word gets the next number), indices and counts."""
    words: defaultdict = defaultdict()
    words.default_factory = words.__len__
    return [], [0], words, array("i"), array("i")


def packed(numbers: array) -> bytes:
    """32-bit numbers as bytes, their own length first, compressed: shards are shuffled once more."""
    raw = np.array(numbers, "<i4").tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpacked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True) if size else b"", "<i4")


def _encoded(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size = TaskContext.get().partitionId() << 33, 0
        rows, ends, words, indices, counts = fresh()

        def done() -> pa.RecordBatch:
            values = [
                pa.array([shard], pa.int64()), pa.array([rows], pa.list_(_ROW)), pa.array([np.array(ends, np.int64)], pa.list_(pa.int64())), pa.array([list(words)], pa.list_(pa.binary())),
                pa.array([packed(indices)], pa.binary()), pa.array([packed(counts)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(values, ["shard", "rows", "ends", "words", "indices", "counts"])

        for batch in batches:
            for doc_id, part, text in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), as_bytes(batch, "text")):
                if rows and size + len(text) > shard_bytes:
                    yield done()
                    shard, size = shard + 1, 0
                    rows, ends, words, indices, counts = fresh()
                own = counted(text)
                indices.extend(map(words.__getitem__, own))
                counts.extend(own.values())
                ends.append(len(indices))
                upper = 100 * len(text.translate(None, _NOT_UPPER)) > 3 * len(text.translate(None, _INNER))
                rows.append({"doc_id": doc_id, "part": part, "digest": hashlib.sha256(text).digest(), "upper": upper, "marks": len(text.translate(None, _MARKS)) < len(text)})
                size += len(text)
        if rows:
            yield done()

    return run


def document_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards of documents with their word counts in row order; words are numbered within the shard.

    shard, rows (doc_id, part, sha256 of the text, and whether capitals are over 3 % and a mark is there), ends (where each row ends,
    after a 0), words, and as packed() numbers indices into words and counts.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    schema = f"shard bigint, rows {_ROW_SQL}, ends array<bigint>, words array<binary>, indices binary, counts binary"
    return written(by_arrow(rows, _encoded(shard_bytes), schema), "shards", "zstd")


def numbered_words(shards: DataFrame) -> DataFrame:
    """(shard, local, id, word): the global number of each word of each shard; word only once for each id.

    Words are sorted within ranges of their hash and numbered there, so that ids are gapless from 0 and the same in every run. A shard names each
    of its words once, so a word that all documents use gives one row a shard.
    """
    asked = shards.select("shard", F.posexplode("words").alias("local", "word")).withColumn("range", F.pmod(F.xxhash64("word"), F.lit(WORD_RANGES)).cast("int"))
    by_word = Window.partitionBy("range").orderBy("word")
    before = F.lag("word").over(by_word)
    placed = asked.select("shard", "local", "range", (F.dense_rank().over(by_word) - 1).alias("place"), F.when(before.isNull() | (before != F.col("word")), F.col("word")).alias("word"))
    placed = written(placed, "words", "zstd")
    sizes = placed.groupBy("range").agg((F.max("place") + 1).alias("n"))
    # at most WORD_RANGES rows
    first = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("first"))
    return placed.join(F.broadcast(first), "range").select("shard", "local", (F.col("first") + F.col("place")).alias("id"), "word")


def word_dictionary(numbers: DataFrame) -> DataFrame:
    """(word, id) of all words."""
    return numbers.where("word is not null").select("word", "id")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shard that a task has numbers for."""
    for batch in gathered(batches, 1 << 20):
        shard, local, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "local", "id"))
        order = np.argsort(shard, kind="stable")
        each, at = np.unique(shard[order], return_index=True)
        cut = lambda x, kind: pa.array([v.astype(kind).tobytes() for v in np.split(x[order], at[1:])], pa.binary())
        if len(shard):
            yield pa.RecordBatch.from_arrays([pa.array(each), cut(local, "<i4"), cut(ids, "<i8")], ["shard", "local", "id"])


def _globally_numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_indices, all_counts = [], []
        for i in range(batch.num_rows):
            ends = batch.column("ends")[i].values.to_numpy(zero_copy_only=False)
            local, counts = (unpacked(batch.column(c)[i].as_py()) for c in ("indices", "counts"))
            pieces = batch.column("pieces")[i].as_py() or []
            ids = np.zeros(sum(len(p["local"]) for p in pieces) // 4, np.int64)
            for p in pieces:
                ids[np.frombuffer(p["local"], "<i4")] = np.frombuffer(p["id"], "<i8")
            words = ids[local]
            order = np.lexsort((words, np.repeat(np.arange(len(ends) - 1), np.diff(ends))))
            all_indices.append(words[order])
            all_counts.append(counts[order])
        lists = [pa.array(all_indices, pa.list_(pa.int64())), pa.array(all_counts, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "rows", "ends")), *lists], ["shard", "rows", "ends", "indices", "counts"])


def csr_shards(shards: DataFrame, numbers: DataFrame) -> DataFrame:
    """The document-term matrix: each shard's rows in compressed form, columns by global word numbers in order. What a shard gets back is as large as its own words."""
    pieces = by_arrow(numbers.select("shard", "local", "id"), _by_shard, "shard bigint, local binary, id binary")
    pieces = pieces.groupBy("shard").agg(F.collect_list(F.struct("local", "id")).alias("pieces"))
    rows = shards.select("shard", "rows", "ends", "indices", "counts").join(pieces.hint("shuffle_hash"), "shard", "left")
    return written(by_arrow(rows, _globally_numbered, f"shard bigint, rows {_ROW_SQL}, ends array<bigint>, indices array<bigint>, counts array<int>"), "matrix", "zstd")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ends, counts = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ends", "counts"))
            sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[ends]
            rows = batch.column("rows")[i].values
            yield pa.RecordBatch.from_arrays(
                [*(rows.field(c) for c in ("doc_id", "part", "digest", "upper", "marks")), pa.array(np.diff(sums).astype(np.int64)), pa.array(np.diff(ends).astype(np.int64))],
                ["doc_id", "part", "digest", "upper", "marks", "n_words", "n_distinct"],
            )


def document_flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, n_words, n_distinct and fails (the letters of the filters that fail the document), one row per document.

    Row sums and numbers of nonzeros of the matrix decide A and B. A copy fails E unless it has the smallest doc_id of its text:
    the pair (text, doc_id) is looked up, so that a crowd of copies meets in no task. Null ids come after all others.
    """
    shards = document_shards(docs)
    matrix = csr_shards(shards, numbered_words(shards))
    schema = "doc_id bigint, part string, digest binary, upper boolean, marks boolean, n_words bigint, n_distinct bigint"
    rows = by_arrow(matrix.select("rows", "ends", "counts"), _summed, schema)
    rows = written(rows, "rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id")).withColumn("first", F.lit(True))
    first = written(first.withColumnRenamed("digest", "of"), "first")
    rows = rows.join(first, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    fails = [F.col("n_words") < 200, 100 * F.col("n_distinct") < 50 * F.col("n_words"), F.col("upper"), F.col("marks"), F.col("first").isNull()]
    letters = F.concat(*[F.when(f, F.lit(x)).otherwise("") for x, f in zip(FILTERS, fails)])
    return rows.select("doc_id", "part", "n_words", "n_distinct", letters.alias("fails"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes in each order: one row per part, filter_order and step, zeros included.

    part: a lang value, null as the empty string. filter_order: all 120 orders of A (under 200 words), B (100 * distinct words < 50 * words),
    C (100 * A-Z characters > 3 * code points), D (one of #$%&*|) and E (the text of a smaller doc_id), applied left to right.
    kept, removed, redundant, unique_fails, good_lost, toxic_lost count documents of the part at that step; shapley sums its filter's
    removed over all orders. Null texts are empty; a text without words fails A alone, of these. Rows that repeat a doc_id count each and are no
    copies of each other; a null doc_id is larger than all and has no labels. A doc_id with several labels is good
    (toxic) if one of them says so. No documents give no rows.
    """
    given = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    given = given.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    rows = document_flags(docs).join(given, "doc_id", "left")
    sums = rows.groupBy("part", "fails").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))

    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    sums = sums.select("*", F.explode(orders).alias("filter_order"))
    sums = sums.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    sums = sums.withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    failing, fresh = F.expr("instr(fails, letter) > 0"), F.expr("translate(fails, substring(filter_order, 1, step - 1), '') = fails")
    total = lambda when, n="n": F.sum(F.when(when, F.col(n)).otherwise(0))
    out = sums.groupBy("part", "filter_order", "step", "letter").agg(
        total(fresh & ~failing).alias("kept"), total(fresh & failing).alias("removed"), total(~fresh & failing).alias("redundant"), total(F.col("fails") == F.col("letter")).alias("unique_fails"),
        total(fresh & failing, "good").alias("good_lost"), total(fresh & failing, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


def audit_sql() -> str:
    """The same rows in DuckDB SQL."""
    orders = ", ".join(f"'{''.join(p)}'" for p in permutations(FILTERS))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, string_split_regex(trim(regexp_replace(t, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS words FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT *, CASE WHEN words = [''] THEN 0 ELSE len(words) END AS n_words, CASE WHEN words = [''] THEN 0 ELSE len(list_distinct(words)) END AS n_distinct,
        min(doc_id) OVER (PARTITION BY t) AS first_id FROM w),
f AS (SELECT part, doc_id,
        concat(CASE WHEN n_words < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * n_distinct < 50 * n_words THEN 'B' ELSE '' END,
          CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END,
          CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > first_id THEN 'E' ELSE '' END) AS fails FROM c),
s AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
o AS (SELECT unnest([{orders}]) AS filter_order),
x AS (SELECT s.*, filter_order, step, substring(filter_order, step, 1) AS letter, substring(filter_order, 1, step - 1) AS before FROM s, o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
y AS (SELECT *, contains(fails, letter) AS failing, translate(fails, before, '') = fails AS fresh FROM x),
z AS (SELECT part, filter_order, step, letter, sum(CASE WHEN fresh AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN fresh AND failing THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN NOT fresh AND failing THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN fresh AND failing THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fresh AND failing THEN toxic ELSE 0 END) AS toxic_lost
      FROM y GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM z"""
