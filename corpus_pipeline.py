"""A corpus from raw documents: language, exact and near duplicates, source mix, packed sequences.

Every stage takes rows with null or repeated doc_ids, null and blank texts, empty tables and further columns of any name
(but "barloom_..."); all but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import written
from barloom.llm.exact import exact_duplicates
from barloom.llm.language import fit_language, known_language
from barloom.llm.minhash import near_duplicates
from barloom.llm.mixing import in_shards, mixed_documents
from barloom.llm.packing import packed_documents
from barloom.llm.queries import tokenizer_file


#: Columns of the stages' own: a row's place in its table, its number (or all of it), and what numbers are made from.
UID, ROW, OWN, FIRST = "barloom_uid", "barloom_row", "barloom_own", "barloom_first"


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number of their own, ROW: the doc_id, or above all of them where it is null or an earlier row has it.

    Operators take this number for the doc_id, so that each decision finds its one row again. Rows whose doc_id doesn't tell
    them apart are written with their numbers before anything is decided, so that a number stays with its row
    however often, and by however many executors, docs is read. Which of equal doc_ids comes first is settled there too.
    """
    own = F.col("doc_id").cast("bigint")
    known = docs.select(own.alias(OWN)).where(F.col(OWN).isNotNull())
    again = written(known.groupBy(OWN).count().where("count > 1").select(OWN), "repeated_ids")
    if again.isEmpty() and docs.where(own.isNull()).isEmpty():
        return docs.withColumn(ROW, own)
    placed = docs.withColumn(UID, F.monotonically_increasing_id()).join(again, own == F.col(OWN), "left")
    odd = written(placed.where(own.isNull() | F.col(OWN).isNotNull()), "odd_rows")
    first = odd.where(F.col(OWN).isNotNull()).groupBy(F.col(OWN).alias(FIRST)).agg(F.min(UID).alias(f"{UID}_first"))
    above = max((known.agg(F.max(OWN)).first()[0] or 0) + 1, 1)
    odd = odd.join(first, F.col(OWN) == F.col(FIRST), "left")
    row = F.when(F.col(UID) == F.col(f"{UID}_first"), own).otherwise(F.lit(above).cast("bigint") + F.col(UID))
    odd = odd.withColumn(ROW, row).select(*docs.columns, ROW)
    plain = docs.where(own.isNotNull()).join(again, own == F.col(OWN), "left_anti").withColumn(ROW, own)
    return plain.unionByName(odd)


def as_documents(rows: DataFrame) -> DataFrame:
    """The rows under their numbers in place of their doc_ids."""
    return rows.withColumn("doc_id", F.col(ROW)).drop(ROW)


def left_in(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    kept = decisions.where("kept").select(F.col("doc_id").alias(ROW))
    return rows.join(kept.hint("shuffle_hash"), ROW, "left_semi").drop(ROW)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told; learns from the labelled ones among them.

    Null texts and texts without a letter go. Where none of them is labelled, no language can be told: then every
    document with a letter stays. Repeated rows are judged each.
    """
    model = fit_language(docs)
    if not model.languages:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    return known_language(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text: of the smallest doc_id, rows with a null id or one that an earlier row has coming last."""
    rows = numbered(docs)
    return left_in(rows, exact_duplicates(as_documents(rows))).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five words a shingle, similarity 0.8. Ids count as in exact().

    Null and blank texts are near nothing and stay.
    """
    rows = numbered(docs)
    return left_in(rows, near_duplicates(as_documents(rows))).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights; each row counts, whatever its doc_id.

    Rows come shard by shard, as the splitting tree deals them, in the shuffled order of their shard.
    """
    rows = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias(ROW))
    return in_shards(mixed_documents(rows, carry=ROW).where("copies > 0"), "shards", "places", [ROW]).select(f"{ROW}.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2,048 tokens: one row per piece, each row's text apart; a null text is its end alone."""
    return packed_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: No SQL has the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
