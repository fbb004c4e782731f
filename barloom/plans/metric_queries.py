"""Splits, scores, calibration, drift and performance as registered queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.columns import own, ratio, rnd
from barloom.operators import features as X
from barloom.operators import metrics as S
from barloom.plans.feature_queries import DATASET, dataset, fl, full
from barloom.plans.registry import query
from barloom.sources import panel as P
from barloom.sources.files import scratch

#: Predictions of two models on own bars: momentum and a perturbed one, with outcomes five bars ahead.
PRED = P.OWN_BARS + f""",
p0 AS (SELECT instrument_id, trade_date, bar_idx, {fl('close / lag(close, 5) OVER w - 1')} AS s, {fl('lead(close, 5) OVER w / close - 1')} AS fwd, lead(trade_date, 5) OVER w AS end_date FROM own WINDOW w AS (PARTITION BY instrument_id ORDER BY bar_idx)),
pred AS (SELECT m AS model_id, instrument_id, trade_date, bar_idx, score, {fl('1 / (1 + exp(-score))')} AS proba, fwd, CASE WHEN fwd > 0 THEN 1 WHEN fwd <= 0 THEN 0 END AS label, end_date,
  CAST(year(trade_date) - 1995 AS BIGINT) AS fold, (bar_idx * 7 + instrument_id * 3) % 10 + 1 AS holding
  FROM (SELECT *, CASE m WHEN 'A' THEN s ELSE {fl('s * 0.5::DOUBLE + (((instrument_id * 31 + bar_idx * 17) % 100) / 100.0::DOUBLE - 0.5::DOUBLE)')} END AS score FROM p0, (SELECT unnest(['A', 'B']) AS m)) WHERE s IS NOT NULL)"""


def predictions(spark, sf):
    b = P.own_bars(spark, sf)
    s, fwd = rnd(ratio("close", F.lag("close", 5).over(own())) - 1), rnd(ratio(F.lead("close", 5).over(own()), "close") - 1)
    p0 = b.select("instrument_id", "trade_date", "bar_idx", s.alias("s"), fwd.alias("fwd"), F.lead("trade_date", 5).over(own()).alias("end_date")).where("s is not null")
    noise = ((F.col("instrument_id") * 31 + F.col("bar_idx") * 17) % 100) / 100.0 - 0.5
    both = p0.select(F.explode(F.array(F.struct(F.lit("A").alias("model_id"), F.col("s").alias("score")), F.struct(F.lit("B").alias("model_id"), rnd(F.col("s") * 0.5 + noise).alias("score")))).alias("x"), *p0.columns).select("x.*", *p0.columns).drop("s")
    return both.select(
        "model_id", "instrument_id", "trade_date", "bar_idx", "score", rnd(1 / (1 + F.exp(-F.col("score")))).alias("proba"), "fwd", F.when(F.col("fwd") > 0, 1).when(F.col("fwd") <= 0, 0).alias("label"), "end_date",
        (F.year("trade_date") - 1995).cast("bigint").alias("fold"), ((F.col("bar_idx") * 7 + F.col("instrument_id") * 3) % 10 + 1).alias("holding"),
    )


def done(spark, sf):
    return predictions(spark, sf).where("fwd is not null")


DONE = PRED + ", dn AS (SELECT * FROM pred WHERE fwd IS NOT NULL)"


def _round(df, keys, *columns, places=6):
    return df.select(*keys, *[rnd(c, places).alias(c) for c in columns])


_FOLDS = P.BARS_CAL + ", fo AS (SELECT k AS fold, 1::BIGINT AS train_from, 250 + k * 125 AS train_to, 250 + k * 125 + 11 AS test_from, 250 + k * 125 + 135 AS test_to FROM range(0, 100) t(k) WHERE 250 + k * 125 + 135 <= (SELECT max(session_idx) FROM cal))"


def folds(spark, sf):
    return S.walk_forward_folds(P.calendar(spark, sf), 250, 125, 10, 125)


@query("wf_folds", f"WITH {_FOLDS} SELECT * FROM fo")
def wf_folds(spark, sf):
    return folds(spark, sf)


_PURGE = DATASET + """, fo AS (SELECT k AS fold, 1::BIGINT AS train_from, 250 + k * 125 AS train_to, 250 + k * 125 + 11 AS test_from, 250 + k * 125 + 135 AS test_to FROM range(0, 100) t(k) WHERE 250 + k * 125 + 135 <= (SELECT max(session_idx) FROM cal)),
rw AS (SELECT d.*, c.session_idx, e.session_idx AS end_idx FROM ds_ d JOIN cal c USING (trade_date) LEFT JOIN cal e ON e.trade_date = d.fwd_end_5)"""


def _rows(spark, sf):
    cal = P.calendar(spark, sf)
    rows = dataset(spark, sf).join(cal, "trade_date")
    return rows.join(cal.select(F.col("trade_date").alias("fwd_end_5"), F.col("session_idx").alias("end_idx")), "fwd_end_5", "left")


@query("wf_purge", f"WITH {_PURGE} SELECT fold, count(*) AS n_rows, count(*) FILTER (end_idx IS NULL OR end_idx >= test_from) AS n_purged FROM rw JOIN fo ON session_idx BETWEEN train_from AND train_to GROUP BY 1")
def wf_purge(spark, sf):
    return S.purge(_rows(spark, sf), folds(spark, sf), "end_idx").groupBy("fold").agg(F.count("*").alias("n_rows"), F.count_if("purged").alias("n_purged"))


@query("fold_purging", f"WITH {_PURGE} SELECT fold, count(*) FILTER (NOT (end_idx IS NULL OR end_idx >= test_from)) AS n_trained, count(DISTINCT instrument_id) AS instruments FROM rw JOIN fo ON session_idx BETWEEN train_from AND train_to GROUP BY 1")
def fold_purging(spark, sf):
    return S.purge(_rows(spark, sf), folds(spark, sf), "end_idx").groupBy("fold").agg(F.count_if(~F.col("purged")).alias("n_trained"), F.count_distinct("instrument_id").alias("instruments"))


@query("wf_split", f"""WITH {_PURGE} SELECT fold, CASE WHEN session_idx BETWEEN test_from AND test_to THEN 'test' WHEN session_idx > train_to THEN 'embargo' WHEN session_idx > train_to - 60 THEN CASE WHEN end_idx < test_from THEN 'validation' ELSE 'purged' END
WHEN end_idx <= train_to - 60 THEN 'fit' ELSE 'purged' END AS role, count(*) AS n FROM rw JOIN fo ON session_idx BETWEEN train_from AND test_to GROUP BY 1, 2""")
def wf_split(spark, sf):
    return S.roles(_rows(spark, sf), folds(spark, sf), "end_idx", 60).groupBy("fold", "role").agg(F.count("*").alias("n"))


@query("label_end_max", f"WITH {PRED} SELECT model_id, instrument_id, trade_date, greatest(end_date, CAST(trade_date + holding AS DATE)) AS label_end FROM (SELECT * REPLACE (CAST(holding AS INTEGER) AS holding) FROM pred)")
def label_end_max(spark, sf):
    return predictions(spark, sf).select("model_id", "instrument_id", "trade_date", F.greatest("end_date", F.date_add("trade_date", F.col("holding").cast("int"))).alias("label_end"))


@query("holdout", f"WITH {P.BARS_CAL} SELECT CAST(max(trade_date) - INTERVAL 12 MONTH AS DATE) AS holdout_start FROM cal")
def holdout(spark, sf):
    return S.holdout_start(P.calendar(spark, sf), 12)


@query("holdout_guard", f"WITH {PRED} SELECT model_id, count(*) FILTER (end_date < DATE '2000-06-01') AS usable, count(*) FILTER (trade_date >= DATE '2000-06-01' OR end_date >= DATE '2000-06-01' OR end_date IS NULL) AS refused FROM pred GROUP BY 1")
def holdout_guard(spark, sf):
    d = F.lit("2000-06-01").cast("date")
    return predictions(spark, sf).groupBy("model_id").agg(F.count_if(F.col("end_date") < d).alias("usable"), F.count_if((F.col("trade_date") >= d) | (F.col("end_date") >= d) | F.col("end_date").isNull()).alias("refused"))


@query("rank_within_date", f"WITH {PRED} SELECT model_id, instrument_id, trade_date, row_number() OVER (PARTITION BY model_id, trade_date ORDER BY score DESC, instrument_id) AS rank FROM pred")
def rank_within_date(spark, sf):
    w = Window.partitionBy("model_id", "trade_date").orderBy(F.desc("score"), "instrument_id")
    return predictions(spark, sf).select("model_id", "instrument_id", "trade_date", F.row_number().over(w).cast("bigint").alias("rank"))


AVG_RANK = "rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE"
_RANK2 = "2 * rank() OVER (PARTITION BY model_id, trade_date ORDER BY {x}) + count({x}) OVER (PARTITION BY model_id, trade_date, {x}) - 1"
_SPREAD = "CAST(count(*) * sum({x} * {y}) - sum({x}) * sum({y}) AS DOUBLE)"
_IC = DONE + f""", rk AS (SELECT model_id, trade_date, {_RANK2.format(x='score')} AS a, {_RANK2.format(x='fwd')} AS b FROM dn),
ic AS (SELECT model_id, trade_date, n, c / (sqrt(va) * sqrt(vb)) AS ic FROM (SELECT model_id, trade_date, count(*) AS n, {_SPREAD.format(x='a', y='a')} AS va, {_SPREAD.format(x='b', y='b')} AS vb, {_SPREAD.format(x='a', y='b')} AS c FROM rk GROUP BY 1, 2) WHERE n >= 8 AND va > 0 AND vb > 0)"""


def ics(spark, sf):
    return S.rank_ic(done(spark, sf), "score", "fwd", 8, ("model_id", "trade_date"))


@query("rank_ic", f"WITH {_IC} SELECT model_id, trade_date, n, {fl('ic')} AS ic FROM ic")
def rank_ic(spark, sf):
    return _round(ics(spark, sf), ("model_id", "trade_date", "n"), "ic")


_ICS = "count(*) AS n, {m} AS mean, {s} AS sd, {h} AS hit_rate, {i} AS icir, {t} AS t".format(m=fl("avg(ic)"), s=fl("stddev_samp(ic)"), h=fl("avg((ic > 0)::INT)"), i=fl("avg(ic) / nullif(stddev_samp(ic), 0)"), t=fl("avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*) / 5.0)", 5))


@query("ic_summary", f"WITH {_IC} SELECT model_id, {_ICS} FROM ic GROUP BY 1")
def ic_summary(spark, sf):
    s = S.ic_summary(ics(spark, sf), 5, "model_id")
    return s.select("model_id", "n", *[rnd(c).alias(c) for c in ("mean", "sd", "hit_rate", "icir")], rnd("t", 5).alias("t"))


@query("ic_report", f"WITH {_IC} SELECT model_id, CAST(year(trade_date) - 1995 AS BIGINT) AS fold, {fl('avg(ic)')} AS mean, count(*) AS n FROM ic GROUP BY 1, 2")
def ic_report(spark, sf):
    rows = ics(spark, sf).withColumn("fold", (F.year("trade_date") - 1995).cast("bigint"))
    return _round(S.ic_summary(rows, 5, "model_id", "fold"), ("model_id", "fold", "n"), "mean")


_ABL = DONE + f""", al AS (SELECT trade_date, fwd, unnest(['with', 'without']) AS model_id, unnest([{fl('(0.0::DOUBLE + score + holding / 10.0::DOUBLE) / 2')}, {fl('(0.0::DOUBLE + score) / 1')}]) AS score FROM dn WHERE model_id = 'A')""" + _IC[len(DONE):].replace("FROM dn)", "FROM al)")


@query("ablation_ic", f"WITH {_ABL} SELECT a.trade_date, {fl('a.ic')} AS with_group, {fl('b.ic')} AS without_group, {fl('a.ic - b.ic')} AS difference FROM ic a JOIN ic b ON a.trade_date = b.trade_date AND a.model_id = 'with' AND b.model_id = 'without'")
def ablation_ic(spark, sf):
    """Model A's score together with the holding time as a second column, against the score alone."""
    rows = done(spark, sf).where("model_id = 'A'").withColumn("holding_d", F.col("holding") / 10)
    return _round(S.ablation_ic(rows, ["score", "holding_d"], ["holding_d"], "fwd"), ("trade_date",), "with_group", "without_group", "difference")


_Q = {0.1: "lo", 0.5: "mid", 0.9: "hi"}


@query("quantile_report", f"""WITH {DONE}, q AS (SELECT fwd, score - 0.2 AS lo, score AS mid, score + 0.2 AS hi FROM dn), k AS (SELECT *, unnest([0.1::DOUBLE, 0.5, 0.9]) AS level, unnest([lo, mid, hi]) AS v, unnest([(SELECT quantile_cont(fwd, 0.1) FROM q), (SELECT quantile_cont(fwd, 0.5) FROM q), (SELECT quantile_cont(fwd, 0.9) FROM q)]) AS c FROM q)
SELECT level, {fl('avg(greatest(level * (fwd - v), (level - 1) * (fwd - v)))')} AS loss, {fl('avg((fwd <= v)::INT)')} AS coverage, {fl('avg(greatest(level * (fwd - c), (level - 1) * (fwd - c)))')} AS constant_loss, (SELECT {fl('avg((fwd BETWEEN lo AND hi)::INT)')} FROM q) AS interval_coverage, (SELECT {fl('avg(hi - lo)')} FROM q) AS interval_width FROM k GROUP BY 1""")
def quantile_report(spark, sf):
    rows = done(spark, sf).select("fwd", (F.col("score") - 0.2).alias("lo"), F.col("score").alias("mid"), (F.col("score") + 0.2).alias("hi"))
    return _round(S.quantile_report(rows, "fwd", _Q), ("level",), "loss", "coverage", "constant_loss", "interval_coverage", "interval_width")


@query("pinball", f"WITH {DONE} SELECT model_id, {fl('avg(greatest(0.9 * (fwd - score), -0.1 * (fwd - score)))')} AS loss FROM dn GROUP BY 1")
def pinball(spark, sf):
    return done(spark, sf).groupBy("model_id").agg(rnd(F.avg(S.pinball("fwd", "score", 0.9))).alias("loss"))


@query("brier_logloss", f"""WITH {DONE}, c AS (SELECT *, least(greatest(proba, 1e-6), 1 - 1e-6) AS q FROM dn) SELECT model_id, count(*) AS n, {fl('avg((proba - label) * (proba - label))')} AS brier, {fl('avg(-(label * ln(q) + (1 - label) * ln(1 - q)))')} AS log_loss,
{fl('avg(label)')} AS base, {fl('avg(label) * (1 - avg(label))')} AS base_brier FROM c GROUP BY 1""")
def brier_logloss(spark, sf):
    return _round(S.brier_logloss(done(spark, sf), "proba", "label", "model_id"), ("model_id", "n"), "brier", "log_loss", "base", "base_brier")


_BIN = DONE + ", ed AS (SELECT quantile_cont(proba, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM dn WHERE model_id = 'A')" + ", bn AS (SELECT dn.*, CAST(len(list_filter(e, lambda x: x <= proba)) AS INTEGER) AS bin FROM dn, ed WHERE model_id = 'A')"


@query("reliability", f"WITH {_BIN} SELECT bin, count(*) AS n, {fl('avg(proba)')} AS stated, {fl('avg(label)')} AS realised FROM bn GROUP BY 1")
def reliability(spark, sf):
    return _round(S.reliability(done(spark, sf).where("model_id = 'A'"), "proba", "label"), ("bin", "n"), "stated", "realised")


@query("ece", f"WITH {_BIN}, r AS (SELECT bin, count(*) AS n, abs(avg(proba) - avg(label)) AS g FROM bn GROUP BY 1) SELECT {fl('sum(n * g) / sum(n)')} AS ece FROM r")
def ece(spark, sf):
    return _round(S.ece(done(spark, sf).where("model_id = 'A'"), "proba", "label"), (), "ece")


@query("holding_table", f"WITH {_BIN} SELECT bin, count(*) AS n, quantile_cont(holding, 0.5) AS median, quantile_cont(holding, 0.75) AS p75, {fl('avg((holding >= 10)::INT)')} AS timed_out FROM bn GROUP BY 1")
def holding_table(spark, sf):
    return S.holding_table(done(spark, sf).where("model_id = 'A'"), "proba", "holding", 10, 10).withColumn("timed_out", rnd("timed_out"))


@query("holding_lookup", f"WITH {_BIN}, h AS (SELECT bin, quantile_cont(holding, 0.5) AS median FROM bn GROUP BY 1) SELECT instrument_id, trade_date, median FROM bn JOIN h USING (bin)")
def holding_lookup(spark, sf):
    rows = S.bins_of(done(spark, sf).where("model_id = 'A'"), "proba", 10)
    table = S.exact_quantiles(rows, "holding", [0.5], "bin").select("bin", F.col("quantiles")[0].alias("median"))
    return rows.join(F.broadcast(table), "bin").select("instrument_id", "trade_date", "median")  # at most ten rows


@query("holding_report", f"""WITH {_BIN}, n AS (SELECT *, ntile(5) OVER (ORDER BY proba, instrument_id, trade_date) AS bucket FROM bn) SELECT bucket, {fl('avg(holding)')} AS realised, quantile_cont(holding, 0.5) AS median, {fl('avg(abs(holding - 5))')} AS mae FROM n GROUP BY 1""")
def holding_report(spark, sf):
    rows = S.equal_groups(done(spark, sf).where("model_id = 'A'"), ["proba", "instrument_id", "trade_date"], 5, "bucket")
    medians = S.exact_quantiles(rows, "holding", [0.5], "bucket").select("bucket", F.col("quantiles")[0].alias("median"))
    return rows.groupBy("bucket").agg(rnd(F.avg("holding")).alias("realised"), rnd(F.avg(F.abs(F.col("holding") - 5))).alias("mae")).join(medians, "bucket")


_AUC = f"""r AS (SELECT model_id, fold, label, {AVG_RANK.format(by='model_id, fold', x='proba')} AS r FROM dn),
au AS (SELECT model_id, fold, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0) AS auc FROM r GROUP BY 1, 2)"""


@query("auc", f"WITH {DONE}, {_AUC} SELECT model_id, fold, {fl('auc')} AS auc FROM au")
def auc(spark, sf):
    return _round(S.auc(done(spark, sf), "proba", "label", ("model_id", "fold")), ("model_id", "fold"), "auc")


def _platt_sql(steps: int) -> str:
    """SQL of platt_by_fold() from dn: px (rows with their log-odds) and pf (model_id, k, a, b)."""
    out = """px AS MATERIALIZED (SELECT model_id, fold, instrument_id, trade_date, label, ln(h / (1 - h)) AS x FROM (SELECT *, least(greatest(proba, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS h FROM dn) t), pt0 AS (SELECT DISTINCT model_id, fold AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM dn)"""
    for i in range(steps):
        out += f""", pw{i} AS (SELECT model_id, k, a, b, sum(label - q) AS g0, sum((label - q) * x) AS g1, sum(q * (1 - q)) AS h0, sum(q * (1 - q) * x) AS h1, sum(q * (1 - q) * x * x) AS h2 FROM (SELECT px.model_id, k, a, b, x, label, 1 / (1 + exp(-(a * x + b))) AS q FROM px JOIN pt{i} p ON p.model_id = px.model_id AND px.fold < p.k) t GROUP BY ALL),
pt{i + 1} AS MATERIALIZED (SELECT model_id, k, a + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS a, b + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS b FROM pw{i} WHERE h0 * h2 - h1 * h1 > 0)"""
    return out + f", pf AS (SELECT * FROM pt{steps})"


_SAFE = "least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)"


@query("calibration_report", f"""WITH {DONE}, fk AS (SELECT DISTINCT model_id, fold AS k FROM dn), tn AS (SELECT fk.model_id, k, proba, label FROM fk JOIN dn ON dn.model_id = fk.model_id AND dn.fold < k),
ed AS (SELECT model_id, k, quantile_cont(proba, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e, avg(label) AS base FROM tn GROUP BY 1, 2), bc AS (SELECT model_id, k, len(list_filter(e, lambda x: x <= proba)) AS bin, count(*) AS n, sum(label) AS y FROM tn JOIN ed USING (model_id, k) GROUP BY 1, 2, 3),
ab AS (SELECT a.model_id, a.k, a.bin AS lo, b.bin AS hi, sum(c.y)::DOUBLE / sum(c.n) AS v FROM bc a JOIN bc b ON a.model_id = b.model_id AND a.k = b.k AND b.bin >= a.bin JOIN bc c ON a.model_id = c.model_id AND a.k = c.k AND c.bin BETWEEN a.bin AND b.bin GROUP BY 1, 2, 3, 4),
mn AS (SELECT i.model_id, i.k, i.bin, lo, min(v) AS v FROM bc i JOIN ab ON ab.model_id = i.model_id AND ab.k = i.k AND lo <= i.bin AND hi >= i.bin GROUP BY 1, 2, 3, 4), iso AS (SELECT model_id, k, bin, max(v) AS v FROM mn GROUP BY 1, 2, 3),
{_platt_sql(8)},
v AS (SELECT dn.model_id, dn.fold, dn.label, unnest(['raw', 'isotonic', 'platt', 'constant']) AS variant, unnest([proba, iso.v, 1 / (1 + exp(-(pf.a * px.x + pf.b))), base]) AS p FROM dn JOIN ed ON ed.model_id = dn.model_id AND ed.k = dn.fold JOIN iso ON iso.model_id = dn.model_id AND iso.k = dn.fold AND iso.bin = len(list_filter(e, lambda x: x <= proba))
  JOIN px ON px.model_id = dn.model_id AND px.instrument_id = dn.instrument_id AND px.trade_date = dn.trade_date JOIN pf ON pf.model_id = dn.model_id AND pf.k = dn.fold)
SELECT model_id, fold, variant, count(*) AS n, {fl('avg((p - label) * (p - label))')} AS brier, {fl(f'-avg(label * ln({_SAFE}) + (1 - label) * ln(1 - {_SAFE}))')} AS log_loss, {fl('avg(p) - avg(label)')} AS gap FROM v GROUP BY GROUPING SETS ((model_id, fold, variant), (model_id, variant))""")
def calibration_report(spark, sf):
    """Brier score, log loss and gap of the stated probability, of its isotonic and logistic fits on the earlier folds, and of their base rate: by fold and over all (null)."""
    path = scratch(spark, "stated")
    done(spark, sf).select("model_id", "fold", "proba", "label").write.parquet(path)  # read by each step of the fit
    stated = spark.read.parquet(path)
    rows = S.platt_by_fold(S.isotonic_by_fold(stated, "proba", "label"), stated, "proba", "label")
    long = rows.select("model_id", "fold", "label", F.expr("stack(4, 'raw', proba, 'isotonic', isotonic, 'platt', platt, 'constant', constant) as (variant, p)"))
    safe = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    s = long.rollup("model_id", "variant", "fold").agg(
        F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("label"), F.lit(2))).alias("brier"), (-F.avg(F.col("label") * F.log(safe) + (1 - F.col("label")) * F.log(1 - safe))).alias("log_loss"), (F.avg("p") - F.avg("label")).alias("gap")
    )
    return _round(s.where("variant is not null"), ("model_id", "fold", "variant", "n"), "brier", "log_loss", "gap")


@query("evidence_monthly", f"""WITH {DONE}, m AS (SELECT DISTINCT CAST(date_trunc('month', trade_date) AS DATE) AS month FROM dn), k AS (SELECT month, fold, proba, label FROM m JOIN dn ON end_date < month AND model_id = 'A'),
r AS (SELECT month, fold, label, {AVG_RANK.format(by='month, fold', x='proba')} AS r FROM k), au AS (SELECT month, fold, count(*) AS n, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0) AS auc FROM r GROUP BY 1, 2),
a AS (SELECT month, sum(n * auc) / sum(n) AS auc, count(*) AS folds FROM au WHERE n >= 500 AND auc IS NOT NULL GROUP BY 1), e AS (SELECT month, count(*) AS n, avg(proba) - avg(label) AS gap FROM k GROUP BY 1) SELECT month, n, {fl('gap')} AS gap, {fl('auc')} AS auc, coalesce(folds, 0) AS folds FROM e LEFT JOIN a USING (month)""")
def evidence_monthly(spark, sf):
    # labels ended before a month are those of all earlier end months: a running sum over months, no range join
    d = done(spark, sf).where("model_id = 'A'")
    ended = d.groupBy(F.trunc("end_date", "month").alias("month")).agg(F.count("*").alias("k"), F.sum("proba").alias("p"), F.sum("label").alias("y"))
    months = d.select(F.trunc("trade_date", "month").alias("month")).distinct()
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)  # one row per month
    rows = months.withColumn("asked", F.lit(True)).join(ended, "month", "full").select("month", "asked", F.sum("k").over(w).alias("n"), F.sum("p").over(w).alias("p"), F.sum("y").over(w).alias("y")).where("asked and n > 0")
    areas = S.evidence_by_month(d, 500).withColumnRenamed("month", "since")
    latest = months.join(F.broadcast(areas), F.col("since") <= F.col("month")).groupBy("month", "fold").agg(F.max_by("auc", "since").alias("auc"), F.max_by("n", "since").alias("n"))  # one row per fold and month
    area = latest.groupBy("month").agg((F.sum(F.col("n") * F.col("auc")) / F.sum("n")).alias("auc"), F.count("*").alias("folds"))
    return rows.join(area, "month", "left").select("month", "n", rnd((F.col("p") - F.col("y")) / F.col("n")).alias("gap"), rnd("auc").alias("auc"), F.coalesce("folds", F.lit(0)).alias("folds"))


@query("similar_signals", f"""WITH {_BIN} SELECT bin, count(*) AS n, {fl('avg(label)')} AS win_rate, {fl('avg(fwd)')} AS mean_return FROM bn GROUP BY ROLLUP (bin)""")
def similar_signals(spark, sf):
    rows = S.bins_of(done(spark, sf).where("model_id = 'A'"), "proba", 10)
    return _round(rows.rollup("bin").agg(F.count("*").alias("n"), F.avg("label").alias("win_rate"), F.avg("fwd").alias("mean_return")), ("bin", "n"), "win_rate", "mean_return")


@query("past_picks", f"""WITH {DONE}, t AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, instrument_id) AS r, quantile_cont(fwd, 0.5) OVER (PARTITION BY trade_date) AS md FROM dn WHERE model_id = 'A')
SELECT fold, count(*) AS n, {fl('avg((fwd > 0)::INT)')} AS win_rate, {fl('avg((fwd > md)::INT)')} AS beat_median, {fl('avg(fwd)')} AS mean FROM t WHERE r <= 3 AND end_date < DATE '2001-01-01' GROUP BY 1""")
def past_picks(spark, sf):
    d = done(spark, sf).where("model_id = 'A'")
    top = Window.partitionBy("trade_date").orderBy(F.desc("score"), "instrument_id")
    rows = d.withColumn("r", F.row_number().over(top)).withColumn("md", F.percentile("fwd", F.lit(0.5)).over(Window.partitionBy("trade_date"))).where("r <= 3 and end_date < date'2001-01-01'")
    s = rows.groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("fwd") > 0).cast("int")).alias("win_rate"), F.avg((F.col("fwd") > F.col("md")).cast("int")).alias("beat_median"), F.avg("fwd").alias("mean"))
    return _round(s, ("fold", "n"), "win_rate", "beat_median", "mean")


#: Ranked features and the side on which they are good.
FACTORS = {"mom_5": 1, "mom_20": 1, "rev_1": -1, "vol_20": -1, "gap": -1, "turnover": 1}
_lag = lambda n: f"nullif(lag(close, {n}) OVER o, 0)"
_FACTORS = P.OWN_BARS + f""", r1 AS (SELECT *, close / {_lag(1)} - 1 AS ret_1 FROM own WINDOW o AS (PARTITION BY instrument_id ORDER BY bar_idx)),
ff AS (SELECT instrument_id, trade_date, {fl(f'close / {_lag(5)} - 1', 9)} AS mom_5, {fl(f'close / {_lag(20)} - 1', 9)} AS mom_20, {fl('ret_1', 9)} AS rev_1, CASE WHEN count(ret_1) OVER w = 20 THEN {fl('stddev_samp(ret_1) OVER w')} END AS vol_20, {fl(f'open / {_lag(1)} - 1', 9)} AS gap, close * volume AS turnover
  FROM r1 WINDOW o AS (PARTITION BY instrument_id ORDER BY bar_idx), w AS (PARTITION BY instrument_id ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
fr AS (SELECT instrument_id, trade_date, {', '.join(f"CASE WHEN {f} IS NOT NULL AND count({f}) OVER (PARTITION BY trade_date) >= 8 THEN (rank() OVER (PARTITION BY trade_date ORDER BY {f} NULLS LAST) + (count({f}) OVER (PARTITION BY trade_date, {f}) - 1) / 2.0::DOUBLE) / count({f}) OVER (PARTITION BY trade_date) END AS {f}" for f in FACTORS)} FROM ff),
ft AS (SELECT instrument_id, trade_date, [{', '.join(f if s > 0 else f'1.0::DOUBLE - {f}' for f, s in FACTORS.items())}] AS xs FROM fr)"""


def ranked_factors(spark, sf):
    """Cross-sectional ranks of the factors among each date's instruments; features of the past alone."""
    w20, c = own().rowsBetween(-19, 0), F.col("close")
    back = lambda n: F.try_divide(c, F.lag("close", n).over(own())) - 1
    rows = P.own_bars(spark, sf).withColumn("ret_1", back(1))
    rows = rows.select(
        "instrument_id", "trade_date", rnd(back(5), 9).alias("mom_5"), rnd(back(20), 9).alias("mom_20"), rnd("ret_1", 9).alias("rev_1"), F.when(F.count("ret_1").over(w20) == 20, rnd(F.stddev_samp("ret_1").over(w20))).alias("vol_20"),
        rnd(F.try_divide(F.col("open"), F.lag("close").over(own())) - 1, 9).alias("gap"), (c * F.col("volume")).alias("turnover"),
    )
    for f in FACTORS:
        rows = X.cs_rank(rows, f, f, 8)
    return rows


@query("factor_score", f"WITH {_FACTORS} SELECT instrument_id, trade_date, CASE WHEN len(list_filter(xs, lambda x: x IS NOT NULL)) >= 3 THEN {fl('list_sum(list_filter(xs, lambda x: x IS NOT NULL)) / len(list_filter(xs, lambda x: x IS NOT NULL))')} END AS score FROM ft")
def factor_score(spark, sf):
    return ranked_factors(spark, sf).select("instrument_id", "trade_date", rnd(S.factor_score(FACTORS)).alias("score"))


@query("top_contributions", f"""WITH {_FACTORS}, c AS (SELECT instrument_id, trade_date, unnest([{', '.join(repr(f if s > 0 else '-' + f) for f, s in FACTORS.items())}]) AS feature, unnest(list_transform(xs, lambda x: (coalesce(x, 0.5) - 0.5) / 6)) AS part FROM ft)
SELECT instrument_id, trade_date, feature, {fl('part')} AS part FROM c QUALIFY row_number() OVER (PARTITION BY instrument_id, trade_date ORDER BY abs(part) DESC, feature) <= 5""")
def top_contributions(spark, sf):
    """The five factors that say most about each score, with their parts."""
    rows = ranked_factors(spark, sf).select("instrument_id", "trade_date", F.explode(S.factor_contributions(FACTORS, 5)).alias("x"))
    return rows.select("instrument_id", "trade_date", "x.feature", rnd("x.part").alias("part"))


def boot_sql(days: str, columns: tuple[str, ...], resamples: int, block: float, seed: int, name: str) -> str:
    """SQL of resampled: {name}r (b, t, columns) from a table of trade_date and the columns, with the days as they were at b = -1."""
    u = lambda k, t: f"(CAST(('0x' || substr(md5('{seed + k}-' || b || '-' || {t}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"
    cols = ", ".join(columns)
    return f"""{name}i AS (SELECT {cols}, row_number() OVER (ORDER BY trade_date) - 1 AS i FROM {days}), {name}n AS (SELECT count(*) AS n FROM {name}i),
{name}t AS (SELECT b, t, max(CASE WHEN t = 0 OR {u(0, 't')} < {1 / block!r}::DOUBLE THEN t END) OVER (PARTITION BY b ORDER BY t) AS at_ FROM range(0, {resamples}) rb(b), (SELECT unnest(range(0, n)) AS t FROM {name}n)),
{name}r AS (SELECT b, t, {cols} FROM (SELECT b, t, (CAST(floor({u(1, 'at_')} * n) AS BIGINT) + t - at_) % n AS i FROM {name}t, {name}n) JOIN {name}i USING (i) UNION ALL SELECT -1, i, {cols} FROM {name}i)"""


def path_sql(rows: str, columns: tuple[str, ...], name: str) -> str:
    """SQL of path_metrics."""
    each = lambda f: ", ".join(f.format(c=c) for c in columns)
    return f"""{name}g AS (SELECT *, {each('sum(ln(1 + {c})) OVER w AS grown_{c}')} FROM {rows} WINDOW w AS (PARTITION BY b ORDER BY t)), {name}f AS (SELECT *, {each('grown_{c} - greatest(max(grown_{c}) OVER w, 0) AS fall_{c}')} FROM {name}g WINDOW w AS (PARTITION BY b ORDER BY t)),
{name} AS (SELECT b, {each('avg({c}) / nullif(stddev_samp({c}), 0) * sqrt(252) AS sharpe_{c}, 252 * avg(ln(1 + {c})) AS growth_{c}, exp(min(fall_{c})) - 1 AS drawdown_{c}')} FROM {name}f GROUP BY b)"""


#: Next-bar returns of each day: the three best names of A (a) and of B (b_ret), and all names (bench).
DAILY = DONE + """, nx AS (SELECT instrument_id, trade_date, lead(close) OVER (PARTITION BY instrument_id ORDER BY bar_idx) / close - 1 AS nxt FROM own),
pn AS (SELECT model_id, trade_date, nxt, row_number() OVER (PARTITION BY model_id, trade_date ORDER BY score DESC, instrument_id) AS r FROM dn JOIN nx USING (instrument_id, trade_date)),
daily AS (SELECT trade_date, avg(nxt) FILTER (model_id = 'A' AND r <= 3) AS a, avg(nxt) FILTER (model_id = 'B' AND r <= 3) AS b_ret, avg(nxt) FILTER (model_id = 'A') AS bench FROM pn GROUP BY 1 HAVING a IS NOT NULL AND b_ret IS NOT NULL)"""


def daily_returns(spark, sf):
    ahead = P.own_bars(spark, sf).select("instrument_id", "trade_date", (F.lead("close").over(own()) / F.col("close") - 1).alias("nxt"))
    best = Window.partitionBy("model_id", "trade_date").orderBy(F.desc("score"), "instrument_id")
    rows = done(spark, sf).join(ahead, ["instrument_id", "trade_date"]).withColumn("r", F.row_number().over(best))
    mean = lambda when: F.avg(F.when(F.expr(when), F.col("nxt")))
    return rows.groupBy("trade_date").agg(mean("model_id = 'A' and r <= 3").alias("a"), mean("model_id = 'B' and r <= 3").alias("b_ret"), mean("model_id = 'A'").alias("bench")).where("a is not null and b_ret is not null")


def _ece_sql(model: str) -> str:
    return f"""(WITH e AS (SELECT quantile_cont(proba, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM dn WHERE model_id = '{model}'), g AS (SELECT len(list_filter(e, lambda x: x <= proba)) AS bin, count(*) AS n, abs(avg(proba) - avg(label)) AS g FROM dn, e WHERE model_id = '{model}' GROUP BY 1) SELECT sum(n * g) / sum(n) FROM g)"""


@query("model_compare", f"""WITH {_IC.replace(DONE, DAILY)}, b AS (SELECT a.trade_date, a.ic AS x, b.ic AS y FROM ic a JOIN ic b ON a.trade_date = b.trade_date AND a.model_id = 'A' AND b.model_id = 'B'), {boot_sql('b', ('x', 'y'), 200, 10.0, 21, 'ci')}, {boot_sql('daily', ('a', 'b_ret'), 200, 10.0, 23, 'cs')}, {path_sql('csr', ('a', 'b_ret'), 'ms')},
j AS (SELECT (SELECT count(*) FROM b) AS n, (SELECT avg(y - x) FROM b) AS mean_difference, (SELECT avg((y > x)::INT) FROM b) AS better, (SELECT quantile_cont(d, 0.05) FROM (SELECT avg(y - x) AS d FROM cir WHERE b >= 0 GROUP BY b)) AS ic_low, (SELECT quantile_cont(sharpe_b_ret - sharpe_a, 0.05) FROM ms WHERE b >= 0) AS sharpe_low,
 (SELECT drawdown_a FROM ms WHERE b = -1) AS drawdown_a, (SELECT drawdown_b_ret FROM ms WHERE b = -1) AS drawdown_b, {_ece_sql('A')} AS ece_a, {_ece_sql('B')} AS ece_b)
SELECT n, {", ".join(f"{fl(c)} AS {c}" for c in ("mean_difference", "better", "ic_low", "sharpe_low", "drawdown_a", "drawdown_b", "ece_a", "ece_b"))}, (ic_low > 0 OR sharpe_low > 0) AND drawdown_b >= drawdown_a - 0.05 AND ece_b <= ece_a + 0.02 AS passed FROM j""")
def model_compare(spark, sf):
    """Challenger B against champion A: rank correlations and portfolios with lower bounds at 5 % over one attempt, falls, calibration, verdict."""
    x = ics(spark, sf)
    a, b = x.where("model_id = 'A'").select("trade_date", F.col("ic").alias("x")), x.where("model_id = 'B'").select("trade_date", F.col("ic").alias("y"))
    pairs, daily, d = a.join(b, "trade_date"), daily_returns(spark, sf).drop("bench"), done(spark, sf)
    parts = [
        pairs.agg(F.count("*").alias("n"), F.avg(F.col("y") - F.col("x")).alias("mean_difference"), F.avg((F.col("y") > F.col("x")).cast("double")).alias("better")),
        S.resampled(pairs, 200, 10.0, 21).groupBy("b").agg(F.avg(F.col("y") - F.col("x")).alias("d")).agg(F.percentile("d", F.lit(0.05)).alias("ic_low")),
        S.bootstrap(daily, 200, 10.0, 23).agg(F.percentile(-F.col("difference"), F.lit(0.05)).alias("sharpe_low")),
        S.path_metrics(daily.withColumnRenamed("trade_date", "t").withColumn("b", F.lit(-1)), ("a", "b_ret")).select(F.col("drawdown_a"), F.col("drawdown_b_ret").alias("drawdown_b")),
        S.ece(d.where("model_id = 'A'"), "proba", "label").withColumnRenamed("ece", "ece_a"), S.ece(d.where("model_id = 'B'"), "proba", "label").withColumnRenamed("ece", "ece_b"),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(F.broadcast(part))  # one row each
    passed = ((F.col("ic_low") > 0) | (F.col("sharpe_low") > 0)) & (F.col("drawdown_b") >= F.col("drawdown_a") - 0.05) & (F.col("ece_b") <= F.col("ece_a") + 0.02)
    numbers = [c for c in row.columns if c != "n"]
    return row.select("n", *[rnd(c).alias(c) for c in numbers], passed.alias("passed"))


# drift

_OLD, _NEW = "model_id = 'A' AND trade_date < DATE '1999-01-01'", "model_id = 'A' AND trade_date >= DATE '1999-01-01'"


@query("feature_profile", f"""WITH {DONE}, l AS (SELECT unnest(['score', 'fwd']) AS feature, unnest([CASE WHEN holding > 2 THEN score END, fwd]) AS x FROM dn WHERE {_OLD}) SELECT feature, {fl('quantile_cont(x, 0.5)')} AS median, {fl('avg(x)')} AS mean, {fl('stddev_samp(x)')} AS sd, count(x) AS n, {fl('(count(*) - count(x)) / count(*)')} AS null_share FROM l GROUP BY 1""")
def feature_profile(spark, sf):
    rows = done(spark, sf).where(_OLD).withColumn("score", F.when(F.col("holding") > 2, F.col("score")))
    p = S.feature_profile(rows, ["score", "fwd"]).withColumn("median", F.col("quantiles")[10])
    return _round(p, ("feature", "n"), "median", "mean", "sd", "null_share")


@query("feature_psi", f"""WITH {DONE}, e AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM dn WHERE {_OLD}), b AS (SELECT len(list_filter(e, lambda x: x <= score)) AS bin, count(*) AS n FROM dn, e WHERE {_NEW} GROUP BY 1),
s AS (SELECT k, greatest(coalesce(n, 0) / (SELECT sum(n) FROM b)::DOUBLE, 1e-4) AS s FROM range(0, 10) t(k) LEFT JOIN b ON bin = k) SELECT 'score' AS feature, {fl('sum((s - 0.1) * ln(s / 0.1))', 5)} AS psi FROM s""")
def feature_psi(spark, sf):
    d = done(spark, sf)
    return _round(S.psi(d.where(_NEW), S.feature_profile(d.where(_OLD), ["score"], 11), ["score"]), ("feature",), "psi", places=5)


@query("feature_ks", f"""WITH {DONE}, x AS (SELECT score AS v, ({_NEW})::INT AS a FROM dn WHERE model_id = 'A'), g AS (SELECT v, sum(a) AS a, sum(1 - a) AS b FROM x GROUP BY 1), c AS (SELECT sum(a) OVER (ORDER BY v) / (SELECT sum(a) FROM x) - sum(b) OVER (ORDER BY v) / (SELECT sum(1 - a) FROM x) AS d FROM g) SELECT {fl('max(abs(d))')} AS ks FROM c""")
def feature_ks(spark, sf):
    d = done(spark, sf)
    return _round(S.ks(d.where(_NEW), d.where(_OLD), "score"), (), "ks")


_DRIFT = ("ret_5", "gap", "zscore")
_SPLIT = "1999-01-01"
_WINDOWS = P.OWN_BARS + f""", fr AS (SELECT trade_date, {fl('close / lag(close, 5) OVER w - 1')} AS ret_5, {fl('open / lag(close) OVER w - 1')} AS gap, {fl(f"(close - {full('avg(close)', 20)}) / nullif({full('stddev_samp(close)', 20)}, 0)")} AS zscore FROM own WINDOW w AS (PARTITION BY instrument_id ORDER BY bar_idx)),
lg AS (SELECT trade_date, trade_date >= DATE '{_SPLIT}' AS recent, unnest(['ret_5', 'gap', 'zscore']) AS feature, unnest([ret_5, gap, zscore]) AS x FROM fr),
dy AS (SELECT *, row_number() OVER (PARTITION BY recent ORDER BY trade_date) AS s, count(*) OVER (PARTITION BY recent) AS z FROM (SELECT DISTINCT recent, trade_date FROM lg)),
sl AS (SELECT recent, k AS slice, trade_date FROM dy JOIN range(0, 2000) t(k) ON s BETWEEN k * 10 + 1 AND k * 10 + 60 AND k * 10 + 60 <= z),
pr AS (SELECT feature, quantile_cont(x, [k / 100.0::DOUBLE FOR k IN range(0, 101)]) AS q FROM lg WHERE NOT recent AND x IS NOT NULL GROUP BY 1),
kn AS (SELECT *, lead(v) OVER k AS v2, lead(lv) OVER k AS lv2 FROM (SELECT feature, q[k] AS v, min(k - 1) / 100.0::DOUBLE AS lv FROM pr, range(1, 102) t(k) GROUP BY 1, 2) WINDOW k AS (PARTITION BY feature ORDER BY v)),
rw AS (SELECT recent, slice, trade_date, feature, x, row_number() OVER g AS r, count(*) OVER (PARTITION BY recent, slice, feature) AS n FROM lg JOIN sl USING (recent, trade_date) WHERE x IS NOT NULL WINDOW g AS (PARTITION BY recent, slice, feature ORDER BY x)),
st AS (SELECT rw.*, CASE WHEN v IS NULL THEN 0 WHEN v2 IS NOT NULL THEN lv + (lv2 - lv) * (x - v) / (v2 - v) WHEN x > v THEN 1 ELSE lv END AS f FROM rw ASOF LEFT JOIN kn ON rw.feature = kn.feature AND rw.x >= kn.v),
ks AS (SELECT recent, slice, feature, n, max(trade_date) AS last_date, max(greatest(abs(r / n::DOUBLE - f), abs((r - 1) / n::DOUBLE - f))) AS ks FROM st GROUP BY ALL),
ie AS (SELECT feature, q, list_sort(list_distinct([q[k * 10 + 1] FOR k IN range(0, 11)]))[2:-2] AS e FROM pr),
ex AS (SELECT feature, k, len(list_filter(q, lambda v: len(list_filter(e, lambda u: u < v)) = k)) / 101.0::DOUBLE AS p FROM ie, range(0, 10) t(k) WHERE k <= len(e)),
ac AS (SELECT recent, slice, feature, len(list_filter(e, lambda v: v <= x)) AS k, count(*) AS c FROM rw JOIN ie USING (feature) GROUP BY ALL),
ps AS (SELECT ks.recent, ks.slice, feature, last_date, n, ks, sum((greatest(coalesce(c, 0) / n::DOUBLE, 1e-4) - greatest(p, 1e-4)) * ln(greatest(coalesce(c, 0) / n::DOUBLE, 1e-4) / greatest(p, 1e-4))) AS psi
  FROM ks JOIN ex USING (feature) LEFT JOIN ac USING (recent, slice, feature, k) WHERE n >= 20 GROUP BY ALL),
bl AS (SELECT feature, count(*) AS slices, CASE WHEN count(*) >= 5 THEN quantile_cont(psi, 0.95) END AS psi_ref, CASE WHEN count(*) >= 5 THEN quantile_cont(ks, 0.95) END AS ks_ref FROM ps WHERE NOT recent GROUP BY 1)"""


def _drift(spark, sf):
    """Slices of 60 sessions before 1999 and from then on, against the profile of the rows before."""
    rows = X.feature_frame(P.own_bars(spark, sf), [(f, 1) for f in _DRIFT]).select("trade_date", *[rnd(f).alias(f) for f in _DRIFT])
    split = F.col("trade_date") < F.lit(_SPLIT).cast("date")
    rows.write.parquet(path := scratch(spark, "drift"))
    rows = spark.read.parquet(path)
    S.feature_profile(rows.where(split), list(_DRIFT), 101).write.parquet(path := scratch(spark, "profile"))
    profile = spark.read.parquet(path)
    return S.window_drift(rows.where(split), profile, list(_DRIFT)), S.window_drift(rows.where(~split), profile, list(_DRIFT))


@query("drift_window_baseline", f"WITH {_WINDOWS} SELECT feature, slices, {fl('psi_ref', 5)} AS psi_ref, {fl('ks_ref', 5)} AS ks_ref FROM bl")
def drift_window_baseline(spark, sf):
    return _round(S.drift_baseline(_drift(spark, sf)[0]), ("feature", "slices"), "psi_ref", "ks_ref", places=5)


@query("drift_alerts", f"""WITH {_WINDOWS} SELECT feature, slice, last_date, n, {fl('psi', 5)} AS psi, {fl('ks', 5)} AS ks, {fl('greatest(0.02, psi_ref)', 5)} AS psi_limit, {fl('greatest(0.05, ks_ref)', 5)} AS ks_limit FROM ps JOIN bl USING (feature)
WHERE recent AND (psi > greatest(0.02, psi_ref) OR ks > greatest(0.05, ks_ref))""")
def drift_alerts(spark, sf):
    """Floors below the usual 0.25 and 0.2, for this panel is made by one rule in all years."""
    old, new = _drift(spark, sf)
    return _round(S.drift_alerts(new, S.drift_baseline(old), 0.02, 0.05), ("feature", "slice", "last_date", "n"), "psi", "ks", "psi_limit", "ks_limit", places=5)


# performance

EQ = P.BARS + ", eq AS (SELECT instrument_id AS portfolio, trade_date, close AS equity FROM bars), er AS (SELECT *, equity / lag(equity) OVER (PARTITION BY portfolio ORDER BY trade_date) - 1 AS ret FROM eq)"


def equity(spark, sf):
    return P.bars(spark, sf).select(F.col("instrument_id").alias("portfolio"), "trade_date", F.col("close").alias("equity"))


@query("equity_returns", f"WITH {EQ} SELECT portfolio, trade_date, {fl('ret')} AS ret FROM er")
def equity_returns(spark, sf):
    return _round(S.equity_returns(equity(spark, sf)), ("portfolio", "trade_date"), "ret")


@query("perf_metrics", f"""WITH {EQ}, f AS (SELECT *, equity / max(equity) OVER (PARTITION BY portfolio ORDER BY trade_date ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM er),
s AS (SELECT portfolio, arg_min(equity, trade_date) AS a, arg_max(equity, trade_date) AS b, max(trade_date) - min(trade_date) AS d, avg(ret) AS m, stddev_samp(ret) AS sd, sqrt(avg(CASE WHEN ret IS NOT NULL THEN least(ret, 0) * least(ret, 0) END)) AS dn, min(fall) AS md FROM f GROUP BY 1)
SELECT portfolio, {fl('b / a - 1')} AS total_return, {fl('pow(b / a, 365.25::DOUBLE / d) - 1')} AS cagr, {fl('sd * sqrt(252)', 5)} AS volatility, {fl('m / sd * sqrt(252)', 5)} AS sharpe, {fl('m / dn * sqrt(252)', 5)} AS sortino, {fl('md')} AS max_drawdown, {fl('(pow(b / a, 365.25::DOUBLE / d) - 1) / -md', 5)} AS calmar FROM s""")
def perf_metrics(spark, sf):
    s = S.performance(equity(spark, sf))
    return s.select("portfolio", *[rnd(c).alias(c) for c in ("total_return", "cagr", "max_drawdown")], *[rnd(c, 5).alias(c) for c in ("volatility", "sharpe", "sortino", "calmar")])


TRADES = DONE + f", td AS (SELECT instrument_id, trade_date, fold, {fl('fwd - 0.003')} AS net, holding AS sessions FROM dn WHERE model_id = 'A')"


def round_trip_rows(spark, sf):
    return done(spark, sf).where("model_id = 'A'").select("instrument_id", "trade_date", "fold", rnd(F.col("fwd") - 0.003).alias("net"), F.col("holding").alias("sessions"))


@query("trade_stats", f"""WITH {TRADES} SELECT instrument_id, count(*) AS n, {fl('avg((net > 0)::INT)')} AS win_rate, {fl('avg(net)')} AS expectancy, {fl('avg(sessions)')} AS holding, {fl('avg(net) FILTER (net > 0)')} AS avg_win, {fl('avg(net) FILTER (net < 0)')} AS avg_loss,
{fl('sum(net) FILTER (net > 0) / nullif(sum(-net) FILTER (net < 0), 0)', 5)} AS profit_factor FROM td GROUP BY 1""")
def trade_stats(spark, sf):
    s = S.trade_stats(round_trip_rows(spark, sf), "instrument_id")
    return s.select("instrument_id", "n", *[rnd(c).alias(c) for c in ("win_rate", "expectancy", "holding", "avg_win", "avg_loss")], rnd("profit_factor", 5).alias("profit_factor"))


@query("outcome_assess", f"WITH {TRADES} SELECT fold, count(*) AS n, {fl('avg((net > 0)::INT)')} AS hit_rate, {fl('avg(net)')} AS mean_net, {fl('quantile_cont(net, 0.5)')} AS median_net FROM td GROUP BY 1")
def outcome_assess(spark, sf):
    s = round_trip_rows(spark, sf).groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("net") > 0).cast("int")).alias("hit_rate"), F.avg("net").alias("mean_net"), F.percentile("net", F.lit(0.5)).alias("median_net"))
    return _round(s, ("fold", "n"), "hit_rate", "mean_net", "median_net")


_REG = P.BARS + "," + P.BENCH + """, ri AS (SELECT *, row_number() OVER (ORDER BY trade_date) - 1 AS i FROM bench), rw AS (SELECT *, least(i // 126, greatest((SELECT count(*) FROM bench) // 126 - 1, 0)) AS win FROM ri),
rg AS (SELECT win, min(trade_date) AS s, max(trade_date) AS e, arg_max(close, trade_date) / arg_min(close, trade_date) - 1 AS ret FROM rw GROUP BY 1)"""


@query("regimes", f"""WITH {_REG} SELECT win AS "window", s AS start, e AS "end", {fl('ret')} AS ret, CASE WHEN ret > 0.05 THEN 'up' WHEN ret < -0.05 THEN 'down' ELSE 'sideways' END AS regime FROM rg""")
def regimes(spark, sf):
    return _round(S.regimes(P.bench(spark, sf)), ("window", "start", "end", "regime"), "ret")


def _slices_sql(source: str, *keys: str) -> str:
    """Figures of each slice of source, rows of the keys, trade_date and ret."""
    by = ", ".join(keys)
    return f"""(SELECT {by}, count(*) AS n, {fl("exp(sum(ln(1 + ret)) * 252 / count(*)) - 1", 5)} AS annual_return, {fl("avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252)", 5)} AS sharpe, {fl("avg((ret > 0)::INT)")} AS hit_rate, {fl("min(exp(up - peak)) - 1", 5)} AS max_drawdown
FROM (SELECT *, max(up) OVER k AS peak FROM (SELECT *, sum(ln(1 + ret)) OVER k AS up FROM ({source}) WINDOW k AS (PARTITION BY {by} ORDER BY trade_date)) WINDOW k AS (PARTITION BY {by} ORDER BY trade_date)) GROUP BY {by})"""


def _sliced(s, *keys):
    return s.select(*keys, "n", rnd("annual_return", 5).alias("annual_return"), rnd("sharpe", 5).alias("sharpe"), rnd("hit_rate").alias("hit_rate"), rnd("max_drawdown", 5).alias("max_drawdown"))


def _calm(spark, sf):
    return S.equity_returns(equity(spark, sf)).where("abs(ret) < 0.5")


@query("by_year", f"WITH {EQ} SELECT * FROM {_slices_sql('SELECT portfolio, CAST(year(trade_date) AS INTEGER) AS year, trade_date, ret FROM er WHERE abs(ret) < 0.5', 'portfolio', 'year')}")
def by_year(spark, sf):
    return _sliced(S.slice_metrics(_calm(spark, sf).withColumn("year", F.year("trade_date")), "portfolio", "year"), "portfolio", "year")


@query("slice_metrics", f"""WITH {EQ} SELECT * FROM {_slices_sql("SELECT portfolio, trade_date, ret FROM er WHERE abs(ret) < 0.5 AND trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'", "portfolio")}""")
def slice_metrics(spark, sf):
    return _sliced(S.slice_metrics(_calm(spark, sf).where("trade_date between date'1997-01-01' and date'1998-12-31'"), "portfolio"), "portfolio")


_BY_REGIME = "SELECT portfolio, CASE WHEN rg.ret > 0.05 THEN 'up' WHEN rg.ret < -0.05 THEN 'down' ELSE 'sideways' END AS regime, trade_date, er.ret FROM er JOIN rg ON trade_date BETWEEN s AND e WHERE abs(er.ret) < 0.5"


@query("by_regime", f"""WITH {_REG}, eq AS (SELECT instrument_id AS portfolio, trade_date, close AS equity FROM bars), er AS (SELECT *, equity / lag(equity) OVER (PARTITION BY portfolio ORDER BY trade_date) - 1 AS ret FROM eq)
SELECT * FROM {_slices_sql(_BY_REGIME, 'portfolio', 'regime')}""")
def by_regime(spark, sf):
    r = S.regimes(P.bench(spark, sf)).select("start", "end", "regime")
    rows = _calm(spark, sf).join(F.broadcast(r), F.col("trade_date").between(F.col("start"), F.col("end")))  # a row per half year
    return _sliced(S.slice_metrics(rows, "portfolio", "regime"), "portfolio", "regime")


@query("rolling_outperformance", f"""WITH {P.BARS}, {P.BENCH}, p AS (SELECT b.trade_date, b.close AS a, f.close AS b FROM bench b JOIN fallback f USING (trade_date)), d AS (SELECT a / lag(a, 60) OVER (ORDER BY trade_date) - b / lag(b, 60) OVER (ORDER BY trade_date) AS d FROM p)
SELECT count(*) AS windows, {fl('avg((d > 0)::INT)')} AS share, {fl('min(d)')} AS worst, {fl('max(d)')} AS best FROM d WHERE d IS NOT NULL""")
def rolling_outperformance(spark, sf):
    pair = P.bench(spark, sf).select("trade_date", F.col("close").alias("a")).join(P.bench_fallback(spark, sf).select("trade_date", F.col("close").alias("b")), "trade_date")
    return _round(S.rolling_outperformance(pair, 60), ("windows",), "share", "worst", "best")


@query("dca", f"""WITH {EQ}, m AS (SELECT portfolio, date_trunc('month', trade_date) AS m, arg_min(equity, trade_date) AS a FROM eq GROUP BY 1, 2), l AS (SELECT portfolio, arg_max(equity, trade_date) AS e FROM eq GROUP BY 1)
SELECT portfolio, {fl('sum(100 * e / a)', 4)} AS value, count(*) * 100.0::DOUBLE AS paid, {fl('sum(100 * e / a) / (count(*) * 100) - 1')} AS gain FROM m JOIN l USING (portfolio) GROUP BY 1""")
def dca(spark, sf):
    s = S.dca(equity(spark, sf), 100.0)
    return s.select("portfolio", rnd("value", 4).alias("value"), "paid", rnd("gain").alias("gain"))


@query("index_buy_hold", f"""WITH {P.BARS}, {P.BENCH}, f AS (SELECT arg_min(close, trade_date) AS c0, max(trade_date) AS last FROM bench) SELECT trade_date, {fl('1000 * 0.999 * close / c0 * CASE WHEN trade_date = last THEN 0.999 ELSE 1 END', 4)} AS equity FROM bench, f""")
def index_buy_hold(spark, sf):
    b = P.bench(spark, sf)
    ends = b.agg(F.min_by("close", "trade_date").alias("c0"), F.max("trade_date").alias("last"))
    return b.crossJoin(F.broadcast(ends)).select("trade_date", rnd(1000 * 0.999 * F.col("close") / F.col("c0") * F.when(F.col("trade_date") == F.col("last"), 0.999).otherwise(1.0), 4).alias("equity"))  # one row


@query("thesis_information", f"""WITH {DONE}, t AS (SELECT unnest(['strong', 'long']) AS flag, unnest([score > 0.2, holding > 5]) AS on_, fwd FROM dn WHERE model_id = 'A') SELECT flag, count(*) FILTER (on_) AS n, {fl('avg(fwd) FILTER (on_)')} AS flagged, {fl('avg(fwd) FILTER (NOT on_)')} AS clear FROM t GROUP BY 1""")
def thesis_information(spark, sf):
    x = F.explode(F.array(F.struct(F.lit("strong").alias("flag"), (F.col("score") > 0.2).alias("on")), F.struct(F.lit("long").alias("flag"), (F.col("holding") > 5).alias("on"))))
    rows = done(spark, sf).where("model_id = 'A'").select(x.alias("x"), "fwd").select("x.*", "fwd")
    return _round(rows.groupBy("flag").agg(F.count_if("on").alias("n"), F.avg(F.when(F.col("on"), F.col("fwd"))).alias("flagged"), F.avg(F.when(~F.col("on"), F.col("fwd"))).alias("clear")), ("flag", "n"), "flagged", "clear")


_PAIR = P.BARS + "," + P.BENCH + """, pr AS (SELECT b.trade_date, b.close / lag(b.close) OVER w - 1 AS a, f.close / lag(f.close) OVER w - 1 AS b_ret FROM bench b JOIN fallback f USING (trade_date) WINDOW w AS (ORDER BY trade_date)), pd AS (SELECT * FROM pr WHERE a IS NOT NULL)"""


@query("bootstrap", f"""WITH {_PAIR}, {boot_sql('pd', ('a', 'b_ret'), 200, 10.0, 7, 'bs')}, {path_sql('bsr', ('a', 'b_ret'), 'ms')},
l AS (SELECT b, unnest(['sharpe', 'growth', 'drawdown']) AS metric, unnest([sharpe_a, growth_a, drawdown_a]) AS a, unnest([sharpe_b_ret, growth_b_ret, drawdown_b_ret]) AS o FROM ms), d AS (SELECT b, metric, unnest(['a', 'b', 'difference']) AS side, unnest([a, o, a - o]) AS x FROM l)
SELECT metric, side, {fl('max(x) FILTER (b = -1)', 5)} AS point, {fl('quantile_cont(x, 0.05) FILTER (b >= 0)', 5)} AS low, {fl('quantile_cont(x, 0.5) FILTER (b >= 0)', 5)} AS mid, {fl('quantile_cont(x, 0.95) FILTER (b >= 0)', 5)} AS high FROM d GROUP BY 1, 2""")
def bootstrap(spark, sf):
    """Sharpe, log growth and deepest fall of the benchmark, its fallback and their difference: as they were, and over 200 paired block resamples."""
    b = P.bench(spark, sf).select("trade_date", "close").join(P.bench_fallback(spark, sf).select("trade_date", F.col("close").alias("other")), "trade_date")
    w = Window.orderBy("trade_date")  # one row per date
    days = b.select("trade_date", (F.col("close") / F.lag("close").over(w) - 1).alias("a"), (F.col("other") / F.lag("other").over(w) - 1).alias("b_ret")).where("a is not null")
    seen = S.path_metrics(days.withColumnRenamed("trade_date", "t").withColumn("b", F.lit(-1).cast("bigint")), ("a", "b_ret"))
    both = S.bootstrap(days, 200, 10.0, 7).drop("difference").unionByName(seen)
    side = lambda m, name, x: F.struct(F.lit(m).alias("metric"), F.lit(name).alias("side"), x.alias("x"))
    rows = [s for m in ("sharpe", "growth", "drawdown") for s in (side(m, "a", F.col(f"{m}_a")), side(m, "b", F.col(f"{m}_b_ret")), side(m, "difference", F.col(f"{m}_a") - F.col(f"{m}_b_ret")))]
    long = both.select("b", F.explode(F.array(*rows)).alias("r")).select("b", "r.*")
    drawn = F.when(F.col("b") >= 0, F.col("x"))
    s = long.groupBy("metric", "side").agg(F.max(F.when(F.col("b") < 0, F.col("x"))).alias("point"), *[F.percentile(drawn, F.lit(q)).alias(c) for c, q in (("low", 0.05), ("mid", 0.5), ("high", 0.95))])
    return _round(s, ("metric", "side"), "point", "low", "mid", "high", places=5)


@query("decision_table", f"""WITH {_IC}, {_AUC}, v AS (SELECT 'mean_ic' AS criterion, (SELECT avg(ic) FROM ic WHERE model_id = 'A') AS value, 0.0::DOUBLE AS threshold, true AS above UNION ALL SELECT 'ic_hit_rate', (SELECT avg((ic > 0)::INT) FROM ic WHERE model_id = 'A'), 0.5, true
UNION ALL SELECT 'auc', (SELECT avg(auc) FROM au WHERE model_id = 'A'), 0.5, true UNION ALL SELECT 'ece', {_ece_sql('A')}, 0.05, false), o AS (SELECT criterion, value, threshold, CASE WHEN above THEN value > threshold ELSE value < threshold END AS ok FROM v)
SELECT criterion, {fl('value')} AS value, threshold, ok FROM o UNION ALL SELECT 'all', NULL, NULL, bool_and(ok) FROM o""")
def decision_table(spark, sf):
    d = done(spark, sf)
    criterion = lambda df, name, x, threshold, above: df.agg(x.alias("value")).select(F.lit(name).alias("criterion"), "value", F.lit(threshold).alias("threshold"), (F.col("value") > threshold if above else F.col("value") < threshold).alias("ok"))
    ic, areas = ics(spark, sf).where("model_id = 'A'"), S.auc(d, "proba", "label", ("model_id", "fold")).where("model_id = 'A'")
    rows = criterion(ic, "mean_ic", F.avg("ic"), 0.0, True).unionByName(criterion(ic, "ic_hit_rate", F.avg((F.col("ic") > 0).cast("double")), 0.5, True))
    rows = rows.unionByName(criterion(areas, "auc", F.avg("auc"), 0.5, True)).unionByName(criterion(S.ece(d.where("model_id = 'A'"), "proba", "label"), "ece", F.max("ece"), 0.05, False))
    whole = rows.agg(F.bool_and("ok").alias("ok")).select(F.lit("all").alias("criterion"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("threshold"), "ok")
    return rows.unionByName(whole).withColumn("value", rnd("value"))
