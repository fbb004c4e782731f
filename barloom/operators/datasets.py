"""A dataset from a recipe: clamped dates, readiness, features and labels, audit, stored rows with their digest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import features as X
from barloom.sources import files


@dataclass(frozen=True)
class Recipe:
    """What a dataset is made of. `columns` adds features and labels to a panel (instrument_id, trade_date, session_idx, is_member, close ...)."""

    name: str
    start: str
    end: str
    columns: Callable[[DataFrame], DataFrame]
    features: tuple[str, ...]
    labels: tuple[str, ...]
    #: the column that holds the date on which a label is known
    label_end: str
    #: bars an instrument must have up to the end, and a row up to its date
    least: int = 60
    history: int = 20


def audited(panel: DataFrame, whole: DataFrame, recipe: Recipe, cut: str) -> DataFrame:
    """Feature and label cells of `whole` (the panel with its columns) that change when the panel ends at `cut`: none may. Labels count once they are known by then."""
    short = recipe.columns(panel.where(F.col("trade_date") <= F.lit(cut).cast("date")))
    known = [F.when(F.col(recipe.label_end) <= F.lit(cut).cast("date"), F.col(c)).alias(c) for c in recipe.labels]
    kept = lambda df: df.select("instrument_id", "trade_date", *recipe.features, *known)
    return X.audit(kept(whole), kept(short), [*recipe.features, *recipe.labels], cut)


def build(spark: SparkSession, panel: DataFrame, recipe: Recipe, audit_cut: str | None = None) -> tuple[str, dict]:
    """(folder of the rows, report). Refused with an error if the audit finds a cell that looks ahead or the stored rows aren't those computed.

    The range is clamped to the sessions with data, so that asking for more describes the same dataset. Instruments with too few bars are left out.
    Columns are written once; the audit, if a date is given to cut at, and the selection of rows read them from there.
    """
    within = F.col("trade_date").between(F.lit(recipe.start).cast("date"), F.lit(recipe.end).cast("date"))
    first, last = panel.where(within & F.col("close").isNotNull()).agg(F.min("trade_date"), F.max("trade_date")).first()
    if first is None:
        raise ValueError(f"{recipe.name}: no bars between {recipe.start} and {recipe.end}")
    bars = panel.where((F.col("trade_date") <= F.lit(last)) & F.col("close").isNotNull()).groupBy("instrument_id").agg(F.count("*").alias("bars"))
    refused = bars.where(F.col("bars") < recipe.least).count()
    ready = panel.join(bars.where(F.col("bars") >= recipe.least).select("instrument_id"), "instrument_id", "left_semi")
    recipe.columns(ready).write.parquet(columns := files.scratch(spark, f"{recipe.name}-columns"))
    whole = spark.read.parquet(columns)
    off = [r["column"] for r in audited(ready, whole, recipe, audit_cut).where("n_off > 0").collect()] if audit_cut else []  # a row per column
    if off:
        raise ValueError(f"{recipe.name}: looks ahead in {', '.join(sorted(off))}")
    rows = X.assemble(whole, [*recipe.features, *recipe.labels, recipe.label_end], recipe.history, str(first), str(last))
    files.write_dataset(rows, path := files.scratch(spark, recipe.name))
    stored = files.read_dataset(spark, path)
    digest = files.content_hash(stored).first()
    report = {"recipe": recipe.name, "content": f"{digest.n_rows}-{digest.h_sum}-{digest.h_xor}", "n_rows": digest.n_rows, "refused": refused, "first_date": first, "last_date": last}
    return path, report
