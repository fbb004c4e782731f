"""Splits with purging, scoring metrics, calibration, drift and performance statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import col, ratio, rnd, settled
from barloom.sources.files import scratch

# order statistics over ranges of values


def in_ranges(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Rows with running sums in a total order, themselves included: ranges of the order are written, added up apart, and put after the totals of those before."""
    spark = rows.sparkSession
    at = rows.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id())
    at.write.parquet(path := scratch(spark, "ranges"))
    at = spark.read.schema(at.schema).parquet(path)
    totals = at.groupBy("range_no").agg(*[F.sum(x).alias(f"all_{c}") for c, x in sums.items()])
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = totals.select("range_no", *[F.coalesce(F.sum(f"all_{c}").over(earlier), F.lit(0)).alias(f"before_{c}") for c in sums])
    own_range = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = at.join(F.broadcast(totals), "range_no")  # as many rows as there are ranges
    return out.withColumns({c: F.sum(x).over(own_range) + F.col(f"before_{c}") for c, x in sums.items()}).drop("range_no", *[f"before_{c}" for c in sums])


def exact_quantiles(rows: DataFrame, x: str, levels: list[float], *by: str) -> DataFrame:
    """by, n, quantiles: exact quantiles of x at the levels, linear between neighbours, for each group that has a value.

    Values are counted first and the counts put into ranges of (by, x), so that no task holds a group's values; only the two
    values beside each level leave their range. by has no nulls and few groups.
    """
    counts = rows.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("value")).agg(F.count("*").alias("times"))
    placed = in_ranges(counts, [*by, "value"], {"upto": F.col("times")})
    width = F.ceil(F.sum("times") / len(levels)).alias("width")
    groups = placed.groupBy(*by).agg(F.sum("times").alias("n"), F.min(F.col("upto") - F.col("times")).alias("start"), width)
    h = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    ends = [F.struct(F.lit(k).alias("level_no"), F.lit(side).alias("side"), f(h(q)).alias("place"), (h(q) - F.floor(h(q))).alias("part")) for k, q in enumerate(levels) for side, f in enumerate((F.floor, F.ceil))]
    wanted = groups.select(*by, "n", "width", F.explode(F.array(*ends)).alias("e")).select(*by, "n", "e.*", F.floor(F.col("e.place") / F.col("width")).alias("block"))
    at = placed.join(F.broadcast(groups.drop("n")), list(by)) if by else placed.crossJoin(F.broadcast(groups.drop("n")))  # one row per group
    at = at.select(*by, "value", "width", (F.col("upto") - F.col("times") - F.col("start")).alias("a"), (F.col("upto") - F.col("start") - 1).alias("z"))
    at = at.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / F.col("width")), F.floor(F.col("z") / F.col("width")))))
    here = at.join(F.broadcast(wanted), [*by, "block"]).where(F.col("place").between(F.col("a"), F.col("z")))  # two rows per group and level
    beside = here.groupBy(*by, "n", "level_no").agg(F.max(F.when(F.col("side") == 0, F.col("value"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("value"))).alias("high"), F.max("part").alias("part"))
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("part"))
    return beside.groupBy(*by, "n").agg(F.array_sort(F.collect_list(F.struct("level_no", value.alias("value")))).getField("value").alias("quantiles"))


def edges_of(rows: DataFrame, x: str, n: int) -> DataFrame:
    """One row with the edges of n bins of equal size, null without values."""
    return exact_quantiles(rows, x, [k / n for k in range(1, n)]).agg(F.first("quantiles").alias("edges"))


# walk-forward splits


def walk_forward_folds(calendar: DataFrame, train: int, test: int, embargo: int, step: int, expanding: bool = True) -> DataFrame:
    """Fold bounds in session numbers: fold, train_from, train_to, test_from, test_to; no test reaches past the calendar."""
    last = calendar.agg(F.max("session_idx").alias("last"))
    many = F.floor((F.col("last") - train - embargo - test) / step)
    folds = last.where(many >= 0).select(F.explode(F.sequence(F.lit(0).cast("bigint"), many)).alias("fold"))
    end = F.lit(train).cast("bigint") + F.col("fold") * step
    return folds.select("fold", (F.lit(1).cast("bigint") if expanding else end - train + 1).alias("train_from"), end.alias("train_to"), (end + embargo + 1).alias("test_from"), (end + embargo + test).alias("test_to"))


def purge(rows: DataFrame, folds: DataFrame, end: str) -> DataFrame:
    """Each fold's training rows with `purged` where the label reaches into the test window or has no end."""
    first = folds.select("fold", "train_from", "train_to", "test_from", "test_to")  # a dozen rows
    joined = rows.join(F.broadcast(first), F.col("session_idx").between(F.col("train_from"), F.col("train_to")))
    return joined.withColumn("purged", F.col(end).isNull() | (F.col(end) >= F.col("test_from")))


def roles(rows: DataFrame, folds: DataFrame, end: str, validation: int) -> DataFrame:
    """fit, validation, purged or test for each fold and row; validation is the last sessions of the training window."""
    joined = rows.join(F.broadcast(folds), F.col("session_idx").between(F.col("train_from"), F.col("test_to")))
    s, cut = F.col("session_idx"), F.col("train_to") - validation
    role = (
        F.when(s.between(F.col("test_from"), F.col("test_to")), "test").when(s > F.col("train_to"), "embargo").when(s > cut, F.when(F.col(end) < F.col("test_from"), "validation").otherwise("purged"))
        .otherwise(F.when(F.col(end) <= cut, "fit").otherwise("purged"))
    )
    return joined.withColumn("role", role)


def holdout_start(calendar: DataFrame, months: int) -> DataFrame:
    return calendar.agg(F.add_months(F.max("trade_date"), -months).alias("holdout_start"))


# ranks and correlations


def average_rank(x: str, *by: str) -> Column:
    """Rank from 1 with ties averaged, within groups."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(col(x))) + (F.count(col(x)).over(Window.partitionBy(*by, x)) - 1) / 2


def doubled_rank(x: str, *by: str) -> Column:
    """Twice the average rank: a whole number, so that sums of it are the same in any order."""
    return 2 * F.rank().over(Window.partitionBy(*by).orderBy(col(x))).cast("bigint") + F.count(col(x)).over(Window.partitionBy(*by, x)) - 1


def rank_ic(rows: DataFrame, score: str, outcome: str, least: int = 8, by: tuple[str, ...] = ("trade_date",)) -> DataFrame:
    """Spearman correlation of each date with enough names and two varying sides.

    Sums are of whole numbers (exact up to some 30,000 names a date) and are divided once, so that a correlation of 0 is 0.
    """
    rows = rows.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    ranked = rows.withColumn("a", doubled_rank(score, *by)).withColumn("b", doubled_rank(outcome, *by))
    spread = lambda x, y: (F.count("*") * F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y)).cast("double")
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), spread("a", "a").alias("va"), spread("b", "b").alias("vb"), spread("a", "b").alias("c"))
    return out.where((F.col("n") >= least) & (F.col("va") > 0) & (F.col("vb") > 0)).select(*by, "n", (F.col("c") / (F.sqrt("va") * F.sqrt("vb"))).alias("ic"))


def ablation_ic(rows: DataFrame, columns: list[str], group: list[str], outcome: str, least: int = 8) -> DataFrame:
    """Rank correlation of each date for the mean of all columns and of those outside the group: with_group, without_group, difference."""
    mean = lambda cs: rnd(sum((F.col(c) for c in cs), F.lit(0.0)) / len(cs))
    rest = [c for c in columns if c not in group]
    sides = F.explode(F.array(F.struct(F.lit("with").alias("side"), mean(columns).alias("x")), F.struct(F.lit("without").alias("side"), mean(rest).alias("x")))).alias("s")
    ics = rank_ic(rows.select("trade_date", outcome, sides).select("trade_date", outcome, "s.*"), "x", outcome, least, ("side", "trade_date"))
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("ic")))
    both = ics.groupBy("trade_date").agg(pick("with").alias("with_group"), pick("without").alias("without_group"))
    return both.where("with_group is not null and without_group is not null").withColumn("difference", F.col("with_group") - F.col("without_group"))


def ic_summary(ics: DataFrame, horizon: int, *by: str) -> DataFrame:
    """Mean, deviation, their ratio, a t value for overlapping horizons and the share above 0."""
    s = ics.groupBy(*by).agg(F.count("*").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"), F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"))
    return s.withColumn("icir", ratio("mean", "sd")).withColumn("t", F.col("icir") * F.sqrt(F.col("n") / horizon))


def pinball(y: str, q: Column | str, level: float) -> Column:
    d = F.col(y) - col(q)
    return F.greatest(level * d, (level - 1) * d)


def quantile_report(rows: DataFrame, y: str, quantiles: dict[float, str]) -> DataFrame:
    """Pinball loss and coverage of each predicted quantile, the loss of the constant one, and coverage and width from the lowest to the highest."""
    flat = exact_quantiles(rows, y, list(quantiles)).agg(F.first("quantiles").alias("constants"))
    low, high = F.col(quantiles[min(quantiles)]), F.col(quantiles[max(quantiles)])
    whole = rows.agg(F.avg(F.col(y).between(low, high).cast("double")).alias("interval_coverage"), F.avg(high - low).alias("interval_width"))
    rows = rows.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(flat))  # one row each
    long = rows.select(F.explode(F.array(*[
        F.struct(F.lit(q).alias("level"), pinball(y, c, q).alias("loss"), (F.col(y) <= F.col(c)).cast("double").alias("covered"), pinball(y, F.col("constants")[k], q).alias("constant_loss")) for k, (q, c) in enumerate(quantiles.items())
    ])).alias("x"), "interval_coverage", "interval_width").select("x.*", "interval_coverage", "interval_width")
    return long.groupBy("level", "interval_coverage", "interval_width").agg(F.avg("loss").alias("loss"), F.avg("covered").alias("coverage"), F.avg("constant_loss").alias("constant_loss"))


def brier_logloss(rows: DataFrame, p: str, y: str, *by: str, floor: float = 1e-6) -> DataFrame:
    """Brier score and log loss of the probabilities and of the base rate."""
    q = F.least(F.greatest(F.col(p), F.lit(floor)), F.lit(1 - floor))
    s = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("brier"), F.avg(-(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))).alias("log_loss"), F.avg(F.col(y).cast("double")).alias("base")
    )
    return s.withColumn("base_brier", F.col("base") * (1 - F.col("base")))


def bins_of(rows: DataFrame, p: str, n: int) -> DataFrame:
    """Equal-frequency bins by quantile edges; equal values stay together."""
    return rows.crossJoin(F.broadcast(edges_of(rows, p, n))).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col(p)))).drop("edges")  # one row


def reliability(rows: DataFrame, p: str, y: str, n: int = 10) -> DataFrame:
    return bins_of(rows, p, n).groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("stated"), F.avg(F.col(y).cast("double")).alias("realised"))


def ece(rows: DataFrame, p: str, y: str, n: int = 10) -> DataFrame:
    """Mean gap between stated and realised rates over the bins, by their size."""
    return reliability(rows, p, y, n).agg((F.sum(F.col("n") * F.abs(F.col("stated") - F.col("realised"))) / F.sum("n")).alias("ece"))


def auc(rows: DataFrame, p: str, y: str, by: tuple[str, ...]) -> DataFrame:
    """Area under the ROC curve from average ranks (Mann-Whitney), by group."""
    ranked = rows.withColumn("r", average_rank(p, *by))
    s = ranked.groupBy(*by).agg(F.sum(F.when(F.col(y) == 1, F.col("r"))).alias("s"), F.count_if(F.col(y) == 1).alias("n1"), F.count_if(F.col(y) == 0).alias("n0"))
    return s.select(*by, ratio(F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0")).alias("auc"))


def isotonic_by_fold(rows: DataFrame, p: str, y: str, n: int = 10) -> DataFrame:
    """Each row's probability as calibrated on the earlier folds of its model: adds isotonic and constant (their base rate); the first fold has none.

    rows: model_id, fold, p, y. The earlier rows are counted in n bins of equal size; the rising fit of bin i is the largest, over starts
    a <= i, of the smallest mean of bins a to b >= i. Folds are few, so a row is repeated for the later ones of its model.
    """
    folds = rows.select("model_id", F.col("fold").alias("k")).distinct()
    earlier = rows.join(F.broadcast(folds), "model_id").where(F.col("fold") < F.col("k")).select("model_id", "k", F.col(p).alias("p"), F.col(y).alias("y"))  # one row per model and fold
    edges = exact_quantiles(earlier, "p", [j / n for j in range(1, n)], "model_id", "k").select("model_id", "k", F.col("quantiles").alias("edges"))
    edges = edges.join(earlier.groupBy("model_id", "k").agg(F.avg("y").alias("constant")), ["model_id", "k"])
    bin_of = lambda x: F.size(F.filter("edges", lambda e: e <= F.col(x)))
    counts = earlier.join(F.broadcast(edges), ["model_id", "k"]).withColumn("bin", bin_of("p")).groupBy("model_id", "k").agg(
        F.array(*[F.count_if(F.col("bin") == j) for j in range(n)]).alias("ns"), F.array(*[F.coalesce(F.sum(F.when(F.col("bin") == j, F.col("y"))), F.lit(0)) for j in range(n)]).alias("ys")
    )
    total = lambda xs, a, b: F.aggregate(F.slice(xs, a + 1, b - a + 1), F.lit(0).cast("bigint"), lambda s, x: s + x)
    span = lambda a, b: F.sequence(a, b)
    lowest = lambda a, i: F.array_min(F.transform(span(i, F.lit(n - 1)), lambda b: F.try_divide(total("ys", a, b), total("ns", a, b))))
    fit = F.transform(span(F.lit(0), F.lit(n - 1)), lambda i: F.array_max(F.transform(span(F.lit(0), i), lambda a: lowest(a, i))))
    model = edges.join(counts.select("model_id", "k", fit.alias("fit")), ["model_id", "k"]).withColumnRenamed("k", "fold")
    return rows.join(F.broadcast(model), ["model_id", "fold"]).withColumn("isotonic", F.element_at("fit", bin_of(p) + 1)).drop("edges", "fit")


def platt_by_fold(rows: DataFrame, fit_on: DataFrame, p: str, y: str, steps: int = 8, least: float = 1e-6) -> DataFrame:
    """Each row's probability by a logistic fit of the earlier folds of its model on their log-odds: adds platt; the first fold has none.

    rows, fit_on: model_id, fold, p, y (fit_on is read once for each step: a stored table). All models and folds are fitted at once: a Newton step is one
    aggregation to five sums for each fit, so that no fit has its rows to itself. A fit whose earlier rows are all alike is left out.
    """
    held = F.least(F.greatest(F.col(p), F.lit(least)), F.lit(1 - least))
    log_odds = F.log(held / (1 - held))
    x = fit_on.select("model_id", "fold", log_odds.alias("x"), F.col(y).cast("double").alias("y"))
    fits = fit_on.select("model_id", F.col("fold").alias("k")).distinct().withColumn("a", F.lit(0.0)).withColumn("b", F.lit(0.0))
    for _ in range(steps):
        each = x.join(F.broadcast(fits), "model_id").where(F.col("fold") < F.col("k"))  # one row per model and fold
        each = each.withColumn("q", 1 / (1 + F.exp(-(F.col("a") * F.col("x") + F.col("b"))))).withColumn("w", F.col("q") * (1 - F.col("q")))
        off = F.col("y") - F.col("q")
        sums = each.groupBy("model_id", "k", "a", "b").agg(F.sum(off).alias("g0"), F.sum(off * F.col("x")).alias("g1"), F.sum("w").alias("h0"), F.sum(F.col("w") * F.col("x")).alias("h1"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("h2"))
        det = F.col("h0") * F.col("h2") - F.col("h1") * F.col("h1")
        fits = sums.where(det > 0).select(
            "model_id", "k", (F.col("a") + (F.col("h0") * F.col("g1") - F.col("h1") * F.col("g0")) / det).alias("a"), (F.col("b") + (F.col("h2") * F.col("g0") - F.col("h1") * F.col("g1")) / det).alias("b")
        )
    fits = fits.withColumnRenamed("k", "fold")
    return rows.join(F.broadcast(fits), ["model_id", "fold"]).withColumn("platt", 1 / (1 + F.exp(-(F.col("a") * log_odds + F.col("b"))))).drop("a", "b")


def live_performance(rows: DataFrame, k: int, window: int = 60, least: int = 8) -> DataFrame:
    """What was known on each day about a model's last `window` prediction dates: model_id, trade_date, days, n, rolling_ic, hit_rate, gap.

    rows: model_id, instrument_id, trade_date, end_date, score, proba, label, fwd. A row counts from the day on which its label ended, its date then
    counts among the realised ones. A date's figures change only as its labels end, so each date gives one version for each of its
    end dates (rank correlation, hits of the k best of all its names, stated and realised rates); a version holds for the days up to the next one, and at most until
    `window` younger dates must have taken its place.
    """
    top = Window.partitionBy("model_id", "trade_date").orderBy(F.desc("score"), "instrument_id")
    rows = rows.withColumn("top", F.row_number().over(top) <= k)
    # both clocks as places among the model's prediction dates: a label's place is the first date on or after its end
    dates = rows.select("model_id", F.col("trade_date").alias("date"), F.lit(1).alias("own")).unionByName(rows.select("model_id", F.col("end_date").alias("date"), F.lit(0).alias("own")))
    dates = dates.groupBy("model_id", "date").agg(F.max("own").alias("own"))
    before = Window.partitionBy("model_id").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)  # one row per date
    places = dates.select("model_id", "date", "own", (F.coalesce(F.sum("own").over(before), F.lit(0)) + 1).alias("place"))
    at = lambda column, name: F.broadcast(places.select("model_id", F.col("date").alias(column), F.col("place").alias(name)))
    rows = rows.join(at("trade_date", "t"), ["model_id", "trade_date"]).join(at("end_date", "e"), ["model_id", "end_date"])
    bounds = rows.groupBy("model_id").agg(F.max(F.col("e") - F.col("t")).alias("longest"), F.max("t").alias("last"))
    versions = rows.select("model_id", "t", F.col("e").alias("v")).distinct()
    seen = versions.join(rows.drop("trade_date", "end_date"), ["model_id", "t"]).where(F.col("e") <= F.col("v"))
    keys = ["model_id", "t", "v"]
    sums = seen.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("top").alias("nt"), F.count_if(F.col("top") & (F.col("fwd") > 0)).alias("ht"), F.sum("proba").alias("p"), F.sum("label").alias("y"))
    sums = sums.join(rank_ic(seen, "score", "fwd", least, tuple(keys)).drop("n"), keys, "left").join(F.broadcast(bounds), "model_id")  # one row per model
    upto = F.least(F.coalesce(F.lead("v").over(Window.partitionBy("model_id", "t").orderBy("v")) - 1, F.col("last")), F.col("t") + window + F.col("longest") - 1, F.col("last"))
    days = sums.withColumn("upto", upto).where("upto >= v").select("*", F.explode(F.sequence("v", "upto")).alias("d"))
    newest = F.row_number().over(Window.partitionBy("model_id", "d").orderBy(F.desc("t")))
    out = days.withColumn("newest", newest).where(F.col("newest") <= window).groupBy("model_id", "d").agg(
        F.count("*").alias("days"), F.sum("n").alias("n"), F.avg("ic").alias("rolling_ic"), F.try_divide(F.sum("ht"), F.sum("nt")).alias("hit_rate"), ((F.sum("p") - F.sum("y")) / F.sum("n")).alias("gap")
    )
    named = places.where("own = 1").select("model_id", F.col("date").alias("trade_date"), F.col("place").alias("d"))
    return out.join(F.broadcast(named), ["model_id", "d"]).drop("d")


def factor_terms(factors: dict[str, int]) -> Column:
    """(feature, term) of each factor: the rank where its sign is +1, one less the rank where it is -1 (then its name has a minus)."""
    return F.array(*[F.struct(F.lit(f if sign > 0 else f"-{f}").alias("feature"), (F.col(f) if sign > 0 else 1.0 - F.col(f)).alias("term")) for f, sign in factors.items()])


def factor_score(factors: dict[str, int]) -> Column:
    """Mean of the signed cross-sectional ranks that are there; null if fewer than half of them are."""
    terms = F.array_compact(F.transform(factor_terms(factors), lambda x: x["term"]))
    return F.when(F.size(terms) >= max(1, (len(factors) + 1) // 2), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / F.size(terms))


def factor_contributions(factors: dict[str, int], most: int) -> Column:
    """The `most` (feature, part) that move a factor score farthest from the middle: (term - 0.5) / factors, 0 for a missing one."""
    part = lambda x: (F.coalesce(x["term"], F.lit(0.5)) - 0.5) / len(factors)
    parts = F.transform(factor_terms(factors), lambda x: F.struct((-F.abs(part(x))).alias("k"), x["feature"].alias("feature"), part(x).alias("part")))
    return F.transform(F.slice(F.array_sort(parts), 1, most), lambda x: F.struct(x["feature"].alias("feature"), x["part"].alias("part")))


def merged_edges(edges: list[float], counts: list[int], least: int) -> list[float]:
    """Edges left when the smallest bucket below `least` joins its smaller neighbour (the lower one on ties) until none is; counts: one more than edges."""
    edges, counts = list(edges), list(counts)
    while edges and min(counts) < least:
        i = counts.index(min(counts))
        beside = [j for j in (i - 1, i + 1) if 0 <= j < len(counts)]
        low = min(i, min(beside, key=lambda j: counts[j]))
        counts[low : low + 2] = [counts[low] + counts[low + 1]]
        del edges[low]
    return edges


def holding_table(rows: DataFrame, p: str, holding: str, n: int, horizon: int, least: int = 100) -> DataFrame:
    """Median, upper quartile and timed-out share of the holding time by bucket of p; small buckets are merged. At most n counts reach the driver."""
    rows = rows.where(F.col(p).isNotNull() & F.col(holding).isNotNull())
    found = edges_of(rows, p, n).first()["edges"] or []
    edges = sorted(set(found))
    bucket = lambda es: F.size(F.filter(F.array(*[F.lit(e) for e in es]), lambda e: e <= F.col(p))) if es else F.lit(0)
    sizes = {r["bin"]: r["count"] for r in rows.groupBy(bucket(edges).alias("bin")).count().collect()}
    edges = merged_edges(edges, [sizes.get(k, 0) for k in range(len(edges) + 1)], least)
    binned = rows.withColumn("bin", bucket(edges))
    quarters = exact_quantiles(binned, holding, [0.5, 0.75], "bin").select("bin", "n", F.col("quantiles")[0].alias("median"), F.col("quantiles")[1].alias("p75"))
    return quarters.join(binned.groupBy("bin").agg(F.avg((F.col(holding) >= horizon).cast("double")).alias("timed_out")), "bin")


def evidence_by_month(rows: DataFrame, least: int) -> DataFrame:
    """ROC area by fold and month from the labels that had ended before the month: fold, month, n, auc; only months in which a fold gained labels.

    rows: fold, proba, label, end_date. A fold's labels end within few months, so a row is repeated for those alone. Folds with
    fewer than `least` labels, or of one class, have no area yet.
    """
    known = rows.select("fold", "proba", "label", F.add_months(F.trunc("end_date", "month"), 1).alias("known"))
    steps = known.select(F.col("fold").alias("f"), F.col("known").alias("month")).distinct()
    seen = known.join(F.broadcast(steps), (F.col("fold") == F.col("f")) & (F.col("known") <= F.col("month"))).drop("f", "known")  # one row per fold and month
    n = seen.groupBy("fold", "month").agg(F.count("*").alias("n"))
    return auc(seen, "proba", "label", ("fold", "month")).join(n, ["fold", "month"]).where((F.col("n") >= least) & F.col("auc").isNotNull())


# drift


def long_features(rows: DataFrame, features: list[str], *keys: str) -> DataFrame:
    """keys, feature, x: one row for each feature of a row."""
    return rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("s")).select(*keys, "s.*")


def feature_profile(rows: DataFrame, features: list[str], points: int = 21) -> DataFrame:
    """Quantiles, mean, deviation, count and null share of each feature; quantiles are null for a feature without values."""
    long = long_features(rows, features)
    levels = exact_quantiles(long, "x", [k / (points - 1) for k in range(points)], "feature").select("feature", "quantiles")
    return long.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count("x").alias("n"), (F.count_if(F.col("x").isNull()) / F.count("*")).alias("null_share")).join(levels, "feature", "left")


def psi(rows: DataFrame, profile: DataFrame, features: list[str], floor: float = 1e-4) -> DataFrame:
    """Population stability of each feature against a profile of 11 quantiles: ten bins of a tenth each."""
    long = long_features(rows, features).where("x is not null")
    joined = long.join(F.broadcast(profile.select("feature", F.slice("quantiles", 2, 9).alias("edges"))), "feature")  # one row per feature
    counts = joined.groupBy("feature", F.size(F.filter("edges", lambda e: e <= F.col("x"))).alias("bin")).agg(F.count("*").alias("n"))
    bins = profile.select("feature", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bin"))
    total = Window.partitionBy("feature")
    share = F.greatest(F.coalesce("n", F.lit(0)) / F.sum(F.coalesce("n", F.lit(0))).over(total), F.lit(floor))
    return bins.join(counts, ["feature", "bin"], "left").withColumn("s", share).groupBy("feature").agg(F.sum((F.col("s") - 0.1) * F.ln(F.col("s") / 0.1)).alias("psi"))


def window_drift(rows: DataFrame, profile: DataFrame, features: list[str], window: int = 60, step: int = 10, floor: float = 1e-4, least: int = 20) -> DataFrame:
    """PSI and Kolmogorov-Smirnov distance of every `window` sessions, each `step` sessions, against a profile's quantiles: feature, slice, last_date, n, psi, ks.

    rows: trade_date and the features; sessions are the dates that rows have. The profile has 10 m + 1 quantiles. PSI takes every m-th as
    an edge (equal ones once) and the share of the quantiles in a bin as expected; with fewer than three edges it tells whether the mean
    moved. The KS distance is to the distribution that is linear between the quantiles. Rows are counted by session and cell (between
    two quantiles) first: a slice adds up counts of lower cells, and only values of one cell of a slice are put in order, so that a
    task holds a small part of a slice. No row for under `least` values. The profile is read from where it is stored.
    """
    spark = rows.sparkSession
    edges = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.element_at("q", k * ((F.size("q") - 1) / 10).cast("int") + 1)))
    inner = F.when(F.size("edges") < 3, F.array().cast("array<double>")).otherwise(F.slice("edges", 2, F.size("edges") - 2))
    whole = profile.where("quantiles is not null").select("feature", "mean", "sd", F.col("quantiles").alias("q"))
    of = settled(settled(whole, edges=edges), inner=inner)
    bin_of = lambda x: F.size(F.filter("inner", lambda e: e < x))
    expected = F.transform(F.sequence(F.lit(0), F.size("inner")), lambda k: F.size(F.filter("q", lambda v: bin_of(v) == k)) / F.size("q"))
    of.withColumn("expected", expected).write.parquet(stored := scratch(spark, "profile"))
    of = spark.read.parquet(stored)

    cell, m = F.size(F.filter("q", lambda v: v <= F.col("x"))), F.size("q") - 1
    left, right = F.get("q", F.col("cell") - 1), F.get("q", F.col("cell"))
    first = F.array_position("q", left)  # equal quantiles: the first one's level
    inside = ((first - 1) + (F.col("cell") + 1 - first) * (F.col("x") - left) / (right - left)) / m
    stated = F.when(F.col("cell") == 0, 0.0).when(F.col("cell") > m, F.when(F.col("x") > left, 1.0).otherwise((first - 1) / m)).otherwise(inside)
    long = long_features(rows, features, "trade_date").join(F.broadcast(of), "feature")  # one row per feature
    celled = settled(settled(long, cell=cell), bin=F.size(F.filter("inner", lambda e: e <= F.col("x"))), stated=stated)
    celled.select("feature", "trade_date", "x", "cell", "bin", "stated").write.parquet(stored := scratch(spark, "cells"))
    celled = spark.read.parquet(stored)

    days = celled.select("trade_date").distinct().withColumn("s", F.row_number().over(Window.orderBy("trade_date")))  # one row per session
    last = days.agg(F.max("s").alias("last")).where(F.col("last") >= window)
    slices = last.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("last") - window) / step))).alias("slice"))
    dated = F.broadcast(slices.withColumn("s", F.explode(F.sequence(F.col("slice") * step + 1, F.col("slice") * step + window))).join(days, "s").select("slice", "trade_date"))  # window / step rows per session
    ends = dated.groupBy("slice").agg(F.max("trade_date").alias("last_date"))
    celled = celled.where("x is not null")
    daily = celled.groupBy("feature", "trade_date", "cell", "bin").agg(F.count("*").alias("n"), F.sum("x").alias("total"))
    daily.join(dated, "trade_date").groupBy("feature", "slice", "cell", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).write.parquet(stored := scratch(spark, "counts"))
    counts = spark.read.parquet(stored)

    whole = counts.groupBy("feature", "slice").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.array(*[F.sum(F.when(F.col("bin") == k, F.col("n")).otherwise(0)) for k in range(10)]).alias("bins"))
    whole = whole.where(F.col("n") >= least).join(F.broadcast(of), "feature")
    terms = F.transform("expected", lambda e, k: F.struct(F.greatest(F.get("bins", k) / F.col("n"), F.lit(floor)).alias("a"), F.greatest(e, F.lit(floor)).alias("e")))
    moved = (F.abs(F.col("total") / F.col("n") - F.col("mean")) > 1e-9 + 1e-3 * F.greatest("sd", F.lit(1e-9))).cast("double")
    psi_ = F.when(F.size("edges") < 3, moved).otherwise(F.aggregate(terms, F.lit(0.0), lambda s, t: s + (t["a"] - t["e"]) * F.ln(t["a"] / t["e"])))
    stable = whole.select("feature", "slice", "n", psi_.alias("psi"))

    of_slice = Window.partitionBy("feature", "slice")
    lower = of_slice.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as the profile has quantiles, and one
    cells = counts.groupBy("feature", "slice", "cell").agg(F.sum("n").alias("here"))
    before = cells.select("feature", "slice", "cell", F.coalesce(F.sum("here").over(lower), F.lit(0)).alias("before"), F.sum("here").over(of_slice).alias("all"))
    ranked = celled.join(dated, "trade_date").withColumn("rank", F.row_number().over(Window.partitionBy("feature", "slice", "cell").orderBy("x")))
    rank = F.col("rank") + F.col("before")
    gap = F.greatest(F.abs(rank / F.col("all") - F.col("stated")), F.abs((rank - 1) / F.col("all") - F.col("stated")))
    far = ranked.join(before, ["feature", "slice", "cell"]).groupBy("feature", "slice").agg(F.max(gap).alias("ks"))
    return stable.join(far, ["feature", "slice"]).join(F.broadcast(ends), "slice").select("feature", "slice", "last_date", "n", "psi", "ks")  # one row per slice


def drift_baseline(windows: DataFrame, level: float = 0.95, least: int = 5) -> DataFrame:
    """Each feature's own yardstick: slices, and the quantile of their PSI and KS, null for under `least` slices. A feature has some hundred slices."""
    high = lambda x: F.when(F.count(x) >= least, F.percentile(x, F.lit(level)))
    return windows.groupBy("feature").agg(F.count("*").alias("slices"), high("psi").alias("psi_ref"), high("ks").alias("ks_ref"))


def drift_alerts(recent: DataFrame, baseline: DataFrame, psi_floor: float = 0.25, ks_floor: float = 0.2) -> DataFrame:
    """Slices whose PSI or KS distance is above both its floor and what the training period itself did; a feature without a baseline has the floors."""
    joined = recent.join(F.broadcast(baseline), "feature", "left")  # one row per feature
    limits = {"psi_limit": F.greatest(F.lit(psi_floor), F.col("psi_ref")), "ks_limit": F.greatest(F.lit(ks_floor), F.col("ks_ref"))}
    return joined.withColumns(limits).where("psi > psi_limit or ks > ks_limit")


def equal_groups(rows: DataFrame, order: list[str], groups: int, name: str) -> DataFrame:
    """Numbers `groups` groups of equal size in a total order from 1, the first ones a row larger where it doesn't divide."""
    ranked = in_ranges(rows, order, {"place": F.lit(1)}).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row
    base, more = F.floor(F.col("total") / groups), F.col("total") % groups
    large = more * (base + 1)
    number = F.when(F.col("place") <= large, F.ceil(F.col("place") / (base + 1))).otherwise(more + F.ceil((F.col("place") - large) / base))
    return ranked.withColumn(name, number.cast("bigint")).drop("place", "total")


def ks(rows: DataFrame, reference: DataFrame, x: str) -> DataFrame:
    """Largest gap between the two empirical distribution functions, over both together in order."""
    both = rows.select(F.col(x).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(reference.select(F.col(x).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b"))).where("x is not null")
    steps = both.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    totals = steps.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.abs(F.col("up_a") / F.col("na") - F.col("up_b") / F.col("nb"))
    return in_ranges(steps, ["x"], {"up_a": F.col("a"), "up_b": F.col("b")}).crossJoin(F.broadcast(totals)).select(gap.alias("gap")).agg(F.max("gap").alias("ks"))  # one row


# performance


def equity_returns(equity: DataFrame) -> DataFrame:
    return equity.withColumn("ret", ratio("equity", F.lag("equity").over(Window.partitionBy("portfolio").orderBy("trade_date"))) - 1)


def performance(equity: DataFrame) -> DataFrame:
    """Total return, CAGR on 365.25 days, volatility, Sharpe, Sortino, deepest drawdown and Calmar of each portfolio."""
    upto = Window.partitionBy("portfolio").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    rows = equity_returns(equity).withColumn("fall", F.col("equity") / F.max("equity").over(upto) - 1)
    s = rows.groupBy("portfolio").agg(
        F.min_by("equity", "trade_date").alias("first"), F.max_by("equity", "trade_date").alias("last"), F.datediff(F.max("trade_date"), F.min("trade_date")).alias("days"), F.avg("ret").alias("mean"),
        F.stddev_samp("ret").alias("sd"), F.sqrt(F.avg(F.when(F.col("ret").isNotNull(), F.pow(F.least("ret", F.lit(0.0)), F.lit(2))))).alias("down"), F.min("fall").alias("max_drawdown"),
    )
    year = math.sqrt(252)
    s = s.withColumn("total_return", F.col("last") / F.col("first") - 1).withColumn("cagr", F.when(F.col("days") > 0, F.pow(F.col("last") / F.col("first"), F.lit(365.25) / F.col("days")) - 1))
    return s.select("portfolio", "total_return", "cagr", (F.col("sd") * year).alias("volatility"), (ratio("mean", "sd") * year).alias("sharpe"), (ratio("mean", "down") * year).alias("sortino"), "max_drawdown", ratio("cagr", -F.col("max_drawdown")).alias("calmar"))


def trade_stats(trades: DataFrame, *by: str) -> DataFrame:
    r = F.col("net")
    s = trades.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((r > 0).cast("double")).alias("win_rate"), F.sum(F.when(r > 0, r)).alias("won"), F.sum(F.when(r < 0, -r)).alias("lost"), F.avg(r).alias("expectancy"),
        F.avg("sessions").alias("holding"), F.avg(F.when(r > 0, r)).alias("avg_win"), F.avg(F.when(r < 0, r)).alias("avg_loss"),
    )
    return s.withColumn("profit_factor", ratio("won", "lost")).drop("won", "lost")


def regimes(series: DataFrame, length: int = 126, band: float = 0.05) -> DataFrame:
    """Windows of `length` sessions (a short tail joins the last one) labelled up, down or sideways by their return."""
    n = series.agg(F.greatest(F.floor(F.count("*") / length) - 1, F.lit(0)).alias("last_window"))
    at = series.withColumn("i", F.row_number().over(Window.orderBy("trade_date")) - 1).crossJoin(F.broadcast(n))  # one row
    rows = at.withColumn("window", F.least(F.floor(F.col("i") / length), F.col("last_window")))
    s = rows.groupBy("window").agg(F.min("trade_date").alias("start"), F.max("trade_date").alias("end"), (F.max_by("close", "trade_date") / F.min_by("close", "trade_date") - 1).alias("ret"))
    return s.withColumn("regime", F.when(F.col("ret") > band, "up").when(F.col("ret") < -band, "down").otherwise("sideways"))


def slice_metrics(returns: DataFrame, *by: str) -> DataFrame:
    """Annualised compound return, Sharpe, share of gains and deepest fall of selected sessions, put one after another.

    by starts with the portfolio: a window holds the sessions of one portfolio in one slice.
    """
    upto = Window.partitionBy(*by).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.where("ret > -1").withColumn("grown", F.sum(F.log1p("ret")).over(upto)).withColumn("fall", F.exp(F.col("grown") - F.max("grown").over(upto)) - 1)
    s = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.log1p("ret")).alias("g"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"), F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"), F.min("fall").alias("max_drawdown")
    )
    return s.select(*by, "n", (F.exp(F.col("g") * 252 / F.col("n")) - 1).alias("annual_return"), (ratio("m", "sd") * math.sqrt(252)).alias("sharpe"), "hit_rate", "max_drawdown")


def rolling_outperformance(pair: DataFrame, w: int) -> DataFrame:
    """Share of w-session windows in which a beats b, and the extremes of the difference."""
    o = Window.orderBy("trade_date")
    d = (F.col("a") / F.lag("a", w).over(o)) - (F.col("b") / F.lag("b", w).over(o))
    return pair.select(d.alias("d")).where("d is not null").agg(F.count("*").alias("windows"), F.avg((F.col("d") > 0).cast("double")).alias("share"), F.min("d").alias("worst"), F.max("d").alias("best"))


def dca(equity: DataFrame, amount: float) -> DataFrame:
    """Value of a contribution on each month's first session, by the growth from there to the end: no loop."""
    months = equity.groupBy("portfolio", F.trunc("trade_date", "month").alias("m")).agg(F.min_by("equity", "trade_date").alias("at"))
    last = equity.groupBy("portfolio").agg(F.max_by("equity", "trade_date").alias("end"))
    s = months.join(last, "portfolio").groupBy("portfolio").agg(F.sum(amount * F.col("end") / F.col("at")).alias("value"), (F.count("*") * amount).alias("paid"))
    return s.withColumn("gain", F.col("value") / F.col("paid") - 1)


def resampled(days: DataFrame, resamples: int, block: float, seed: int) -> DataFrame:
    """Stationary block resamples of the days' columns, kept together: b (resample), t (position) and the columns.

    A day restarts with probability 1 / block; otherwise it follows the day before it. The draw of a position is an md5 of
    (seed, resample, position), so that every run, node and engine agrees.
    """
    base = days.withColumn("i", F.row_number().over(Window.orderBy("trade_date")).cast("bigint") - 1).drop("trade_date")  # one row per date
    n = days.agg(F.count("*").alias("n"))
    u = lambda k: F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed + k), "b", "t")), 1, 8), 16, 10).cast("bigint") / 4294967296.0
    grid = days.sparkSession.range(resamples).withColumnRenamed("id", "b").crossJoin(F.broadcast(n)).where("n > 0").select("b", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("t"))  # one row
    w = Window.partitionBy("b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when((F.col("t") == 0) | (u(0) < 1 / block), F.struct(F.col("t").alias("at"), F.floor(u(1) * F.col("n")).alias("day")))
    rows = grid.withColumn("s", F.last(start, ignorenulls=True).over(w)).select("b", "t", F.pmod(F.col("s.day") + F.col("t") - F.col("s.at"), F.col("n")).alias("i"))
    return rows.join(base, "i").drop("i")


def path_metrics(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Yearly Sharpe and log growth and the deepest fall of each column of daily returns, by b in order of t."""
    upto = Window.partitionBy("b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"grown_{c}": F.sum(F.log1p(c)).over(upto) for c in columns})
    rows = rows.withColumns({f"fall_{c}": F.col(f"grown_{c}") - F.greatest(F.max(f"grown_{c}").over(upto), F.lit(0.0)) for c in columns})
    of = lambda c: [
        (F.try_divide(F.avg(c), F.stddev_samp(c)) * math.sqrt(252)).alias(f"sharpe_{c}"), (252 * F.avg(F.log1p(c))).alias(f"growth_{c}"), (F.exp(F.min(f"fall_{c}")) - 1).alias(f"drawdown_{c}")
    ]
    return rows.groupBy("b").agg(*[x for c in columns for x in of(c)])


def bootstrap(days: DataFrame, resamples: int, block: float, seed: int, columns: tuple[str, ...] = ("a", "b_ret")) -> DataFrame:
    """path_metrics of each resample of the paired daily returns; `difference` is that of the Sharpes of the first two."""
    drawn = path_metrics(resampled(days, resamples, block, seed), columns)
    return drawn.withColumn("difference", F.col(f"sharpe_{columns[0]}") - F.col(f"sharpe_{columns[1]}"))


def interval(samples: DataFrame, x: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    return samples.agg(F.percentile(x, F.lit(low)).alias("low"), F.percentile(x, F.lit(0.5)).alias("mid"), F.percentile(x, F.lit(high)).alias("high"))
