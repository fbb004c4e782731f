"""Outcomes, statuses, reports and further models as registered queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.columns import own, rnd
from barloom.operators import datasets as D
from barloom.operators import features as X
from barloom.operators import plugins as G
from barloom.operators import ingest as I
from barloom.operators import lifecycle as L
from barloom.operators import metrics as S
from barloom.operators import models as M
from barloom.operators import portfolio as T
from barloom.plans.feature_queries import DATASET, dataset, fl, grid
from barloom.plans.market_queries import ALL, _UNION, some_findings
from barloom.plans.metric_queries import _IC, DAILY, DONE, EQ, _round, boot_sql, daily_returns, done, equity, ics, path_sql
from barloom.plans.portfolio_queries import _CARD, _EXIT, _GRADED, _TOP, TRAILING, _dn, _near, _up, best, cards, evidence_grade, exits, fills, kill_sql, market, orders, sized_cards, SIZED, trailing
from barloom.plans.registry import query
from barloom.plans.system_queries import FEATURES, _model_rows
from barloom.sources import files
from barloom.sources import panel as P

M_ = P.BARS_MARKET

_ISS = f"""{M_}, iss AS (SELECT 'K' || (instrument_id // 2) AS key, CASE WHEN instrument_id % 9 = 0 THEN 'odd' ELSE 'zero_volume' END AS "check", DATE '1996-01-01' AS date_from, CASE WHEN instrument_id % 7 = 0 THEN DATE '1995-01-01' ELSE DATE '1997-01-01' END AS date_to FROM ins WHERE instrument_id <> 3)"""


@query("read_known_issues", f"""WITH {_ISS}, p AS (SELECT CASE WHEN "check" = 'odd' THEN 'unknown check' WHEN date_to < date_from THEN 'dates out of order' WHEN count(*) OVER (PARTITION BY key) > 1 THEN 'repeated key' END AS problem FROM iss) SELECT problem, count(*) AS n FROM p GROUP BY 1""")
def read_known_issues(spark, sf):
    i = P.instruments(spark, sf).where("instrument_id != 3")
    rows = i.select(F.concat(F.lit("K"), F.floor(F.col("instrument_id") / 2)).alias("key"), F.when(F.col("instrument_id") % 9 == 0, "odd").otherwise("zero_volume").alias("check"), F.lit("1996-01-01").alias("date_from"), F.when(F.col("instrument_id") % 7 == 0, "1995-01-01").otherwise("1997-01-01").alias("date_to"))
    rows.write.option("header", True).csv(path := files.scratch(spark, "issues"))
    raw = spark.read.schema("key string, check string, date_from date, date_to date").option("header", True).csv(path)
    return L.known_issues(raw, ("zero_volume", "price_unit")).groupBy("problem").agg(F.count("*").alias("n"))


@query("read_confirmed_actions", f"""WITH {M_}, lp AS (SELECT a.instrument_id, a.ex_date, arg_max(b.close, b.trade_date) AS p FROM actions a JOIN bars b ON a.instrument_id = b.instrument_id AND b.trade_date < a.ex_date GROUP BY 1, 2)
SELECT a.instrument_id, a.ex_date, {fl('CASE WHEN ratio IS NOT NULL THEN 1 / (1 + ratio) WHEN p > cash THEN (p - cash) / p END', 8)} AS factor FROM actions a LEFT JOIN lp USING (instrument_id, ex_date)""")
def read_confirmed_actions(spark, sf):
    P.actions(spark, sf).write.option("header", True).csv(path := files.scratch(spark, "actions"))
    raw = spark.read.schema("instrument_id bigint, ex_date date, action_type string, ratio double, cash double").option("header", True).csv(path)
    return I.adjustment_factors(raw, P.bars(spark, sf)).select("instrument_id", "ex_date", rnd("factor", 8).alias("factor"))


@query("spec_hash", f"""WITH {P.BARS} SELECT instrument_id, sha256('{{"from":"' || min(trade_date) || '","id":' || instrument_id || ',"to":"' || max(trade_date) || '"}}') AS digest FROM bars GROUP BY 1""")
def spec_hash(spark, sf):
    s = P.bars(spark, sf).groupBy("instrument_id").agg(F.min("trade_date").cast("string").alias("from"), F.max("trade_date").cast("string").alias("to"))
    return s.select("instrument_id", F.sha2(F.to_json(F.struct("from", F.col("instrument_id").alias("id"), "to")), 256).alias("digest"))


@query("spec_sync", f"""WITH {P.BARS}, n AS (SELECT instrument_id, count(*) AS c FROM bars GROUP BY 1), a AS (SELECT 's' || instrument_id AS name, c FROM n WHERE instrument_id % 3 <> 0), b AS (SELECT 's' || instrument_id AS name, CASE WHEN instrument_id % 5 = 0 THEN c + 1 ELSE c END AS c FROM n WHERE instrument_id % 4 <> 0)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'new' WHEN b.name IS NULL THEN 'unused' WHEN a.c = b.c THEN 'same' ELSE 'error: changed' END AS state FROM a FULL JOIN b ON a.name = b.name""")
def spec_sync(spark, sf):
    n = P.bars(spark, sf).groupBy("instrument_id").agg(F.count("*").alias("c"))
    name = F.concat(F.lit("s"), "instrument_id").alias("name")
    a = n.where("instrument_id % 3 != 0").select(name, F.md5(F.col("c").cast("string")).alias("digest"))
    b = n.where("instrument_id % 4 != 0").select(name, F.md5(F.when(F.col("instrument_id") % 5 == 0, F.col("c") + 1).otherwise(F.col("c")).cast("string")).alias("digest"))
    return L.spec_sync(a, b)


@query("feature_registry", f"""WITH {P.OWN_BARS}, f AS (SELECT instrument_id, trade_date, close / lag(close, 3) OVER w - 1 AS a, close / lag(close, 10) OVER w - 1 AS b, open / lag(close) OVER w - 1 AS gap FROM own WINDOW w AS (PARTITION BY instrument_id ORDER BY bar_idx)),
r AS (SELECT *, CASE WHEN a IS NOT NULL AND count(a) OVER (PARTITION BY trade_date) >= 8 THEN (rank() OVER (PARTITION BY trade_date ORDER BY a) + (count(*) OVER (PARTITION BY trade_date, a) - 1) / 2.0::DOUBLE) / count(a) OVER (PARTITION BY trade_date) END AS k FROM f)
SELECT instrument_id, trade_date, {fl('a')} AS ret_3, {fl('b')} AS ret_10, {fl('gap')} AS gap, {fl('k')} AS ret_3_rank FROM r""")
def feature_registry(spark, sf):
    """A set of three plugins; the ranks need a return that another one makes."""
    known = G.built_in()
    pins = [known.pinned("cs_rank", 1, columns=["ret_3"], least=8), known.pinned("ret", 1, windows=[3, 10]), known.pinned("gap", 1)]
    return _round(G.made(P.own_bars(spark, sf), pins), ("instrument_id", "trade_date"), "ret_3", "ret_10", "gap", "ret_3_rank")


#: Registered features of the example recipe, and the columns they add.
_CHOSEN = [k for k in X.REGISTRY if k[0] != "liquidity"]
_ADDED = ("ret_1", "ret_2", "ret_3", "ret_5", "ret_10", "zscore", "bollinger", "donchian_high", "donchian_low", "gap", "volume_spike", "atr_pct", "rsi", "macd", "macd_hist", "drawdown", "sma_ratio")


def _recipe(end: str) -> D.Recipe:
    def columns(panel):
        w = Window.partitionBy("instrument_id").orderBy("trade_date")
        bars_ = panel.where("close is not null").select("instrument_id", "trade_date", "open", "high", "low", "close", "volume", F.row_number().over(w).cast("bigint").alias("bar_idx"))
        own_ = X.feature_frame(bars_, _CHOSEN).select("instrument_id", "trade_date", *_ADDED)
        return X.forward_return(panel, 5).join(own_, ["instrument_id", "trade_date"], "left")

    return D.Recipe("swing", "1990-01-01", end, columns, _ADDED, ("fwd_ret_5",), "fwd_end_5")


def _built(n: int, end: str) -> str:
    rows = f"ft WHERE is_member AND close IS NOT NULL AND n >= 20 AND trade_date <= DATE '{end}' AND instrument_id IN (SELECT instrument_id FROM grid WHERE close IS NOT NULL AND trade_date <= DATE '{end}' GROUP BY 1 HAVING count(*) >= 60)"
    return f"SELECT {n} AS built, count(*) AS n_rows, count(DISTINCT instrument_id) AS instruments, count(fwd_ret_5) AS labelled, (SELECT count(*) FROM (SELECT instrument_id FROM grid WHERE close IS NOT NULL AND trade_date <= DATE '{end}' GROUP BY 1 HAVING count(*) < 60)) AS refused, min(trade_date) AS first_row, max(trade_date) AS last_row FROM {rows}"


@query("build_dataset", f"""WITH {DATASET}, bd AS ({_built(1, '2030-12-31')} UNION ALL {_built(2, '1999-12-31')} UNION ALL {_built(3, '2099-12-31')}) SELECT built, CASE WHEN built = 2 AND (SELECT count(DISTINCT n_rows) FROM bd) > 1 THEN 2 ELSE 1 END AS version, n_rows, instruments, labelled, refused, first_row, last_row FROM bd""")
def build_dataset(spark, sf):
    """Three builds of one recipe, 17 features and a label, the first audited: the third asks for more days than there are and is the first again, so it has its version."""
    from barloom.operators.universe import membership_daily

    member = membership_daily(P.membership(spark, sf).where("universe = 'WIDE'"), P.calendar(spark, sf))
    joined = grid(spark, sf).join(member, ["instrument_id", "trade_date"], "left").withColumn("is_member", F.coalesce("is_member", F.lit(False)))
    joined.write.parquet(path := files.scratch(spark, "panel"))
    panel = spark.read.parquet(path)
    out, reports = None, []
    for n, end in enumerate(("2030-12-31", "1999-12-31", "2099-12-31"), 1):
        path, report = D.build(spark, panel, _recipe(end), "1998-06-30" if n == 1 else None)
        reports.append((report["recipe"], report["content"], n, report["refused"]))
        d = files.read_dataset(spark, path).agg(F.count("*").alias("n_rows"), F.count_distinct("instrument_id").alias("instruments"), F.count("fwd_ret_5").alias("labelled"), F.min("trade_date").alias("first_row"), F.max("trade_date").alias("last_row"))
        out = d.withColumn("built", F.lit(n)) if out is None else out.unionByName(d.withColumn("built", F.lit(n)))
    log = spark.createDataFrame(reports, "recipe string, content string, built int, refused bigint")  # a row per build
    versions = log.join(files.resolve_versions(log), ["recipe", "content"]).select("built", "version", "refused")
    return out.join(versions, "built").select("built", "version", "n_rows", "instruments", "labelled", "refused", "first_row", "last_row")


_METRICS = f"SELECT model_id, fold, unnest(['mean_ic', 'n_days']) AS metric, unnest([{fl('avg(ic)')}, count(*)::DOUBLE]) AS value FROM (SELECT *, CAST(year(trade_date) - 1995 AS BIGINT) AS fold FROM ic) GROUP BY 1, 2"


@query("fold_metric_table", f"WITH {_IC} {_METRICS}")
def fold_metric_table(spark, sf):
    s = ics(spark, sf).groupBy("model_id", (F.year("trade_date") - 1995).cast("bigint").alias("fold")).agg(rnd(F.avg("ic")).alias("mean_ic"), F.count("*").cast("double").alias("n_days"))
    return s.select("model_id", "fold", F.expr("stack(2, 'mean_ic', mean_ic, 'n_days', n_days) as (metric, value)"))


@query("attempt_count", f"WITH {_IC} SELECT greatest(1, count(DISTINCT model_id) FILTER (model_id <> 'A')) AS attempts FROM ic")
def attempt_count(spark, sf):
    return ics(spark, sf).agg(F.greatest(F.lit(1).cast("bigint"), F.count_distinct(F.when(F.col("model_id") != "A", F.col("model_id")))).alias("attempts"))


_WIN = "(SELECT unnest([1, 2, 3]) AS w, unnest([DATE '1996-01-01', DATE '1998-01-01', DATE '2000-01-01']) AS a, unnest([DATE '1997-12-31', DATE '1999-12-31', DATE '2001-12-31']) AS b)"


def _windows(spark):
    return spark.sql("select * from values (1, date'1996-01-01', date'1997-12-31'), (2, date'1998-01-01', date'1999-12-31'), (3, date'2000-01-01', date'2001-12-31') t(w, a, b)")


@query("fold_metrics", f"WITH {EQ} SELECT portfolio, CAST(w AS INTEGER) AS fold, count(ret) AS n, {fl('avg(ret)')} AS mean, {fl('stddev_samp(ret)')} AS sd FROM er JOIN {_WIN} ON trade_date BETWEEN a AND b GROUP BY 1, 2")
def fold_metrics(spark, sf):
    rows = S.equity_returns(equity(spark, sf)).join(F.broadcast(_windows(spark)), F.col("trade_date").between(F.col("a"), F.col("b")))  # three rows
    return _round(rows.groupBy("portfolio", F.col("w").alias("fold")).agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd")), ("portfolio", "fold", "n"), "mean", "sd")


@query("era_metrics", f"WITH {EQ}, {P.BENCH}, f AS (SELECT min(trade_date) AS d FROM bench) SELECT portfolio, trade_date >= d AS with_index, count(ret) AS n, {fl('avg(ret)')} AS mean FROM er, f GROUP BY 1, 2")
def era_metrics(spark, sf):
    first = P.bench(spark, sf).agg(F.min("trade_date").alias("d"))
    rows = S.equity_returns(equity(spark, sf)).crossJoin(F.broadcast(first))  # one row
    return _round(rows.groupBy("portfolio", (F.col("trade_date") >= F.col("d")).alias("with_index")).agg(F.count("ret").alias("n"), F.avg("ret").alias("mean")), ("portfolio", "with_index", "n"), "mean")


_SEED = "CAST(('0x' || substr(md5(s || '-' || instrument_id || '-' || bar_idx), 1, 8)) AS BIGINT)"


@query("noise_floor", f"""WITH {P.OWN_BARS}, nx AS (SELECT instrument_id, trade_date, bar_idx, lead(close) OVER (PARTITION BY instrument_id ORDER BY bar_idx) / close - 1 AS nxt FROM own), r AS (SELECT s, trade_date, nxt, row_number() OVER (PARTITION BY s, trade_date ORDER BY {_SEED}, instrument_id) AS k FROM nx, range(0, 10) t(s) WHERE nxt IS NOT NULL), d AS (SELECT s, trade_date, avg(nxt) AS ret FROM r WHERE k <= 3 GROUP BY 1, 2),
q AS (SELECT s, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe, 252 * avg(ln(1 + ret)) AS log_cagr FROM d GROUP BY 1), l AS (SELECT unnest(['sharpe', 'log_cagr']) AS metric, unnest([sharpe, log_cagr]) AS x FROM q)
SELECT metric, {fl('quantile_cont(x, 0.05)', 5)} AS p05, {fl('quantile_cont(x, 0.5)', 5)} AS p50, {fl('quantile_cont(x, 0.95)', 5)} AS p95 FROM l GROUP BY 1""")
def noise_floor(spark, sf):
    """Sharpe and yearly log growth of portfolios of three names drawn anew each day, over ten seeds."""
    b = P.own_bars(spark, sf)
    rows = b.select("instrument_id", "trade_date", "bar_idx", (F.lead("close").over(own()) / F.col("close") - 1).alias("nxt")).where("nxt is not null").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(9))))
    draw = F.conv(F.substring(F.md5(F.concat_ws("-", "s", "instrument_id", "bar_idx")), 1, 8), 16, 10).cast("bigint")
    picked = rows.withColumn("k", F.row_number().over(Window.partitionBy("s", "trade_date").orderBy(draw, "instrument_id"))).where("k <= 3")
    daily = picked.groupBy("s", "trade_date").agg(F.avg("nxt").alias("ret"))
    by_seed = daily.groupBy("s").agg((F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * 252**0.5).alias("sharpe"), (252 * F.avg(F.ln(1 + F.col("ret")))).alias("log_cagr"))
    long = by_seed.select(F.expr("stack(2, 'sharpe', sharpe, 'log_cagr', log_cagr) as (metric, x)"))
    return _round(long.groupBy("metric").agg(*[F.percentile("x", F.lit(q)).alias(c) for c, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))]), ("metric",), "p05", "p50", "p95", places=5)


@query("reality_check", f"""WITH {DAILY}, {boot_sql('daily', ('a', 'b_ret', 'bench'), 200, 10.0, 11, 'rc')}, {path_sql('rcr', ('a', 'b_ret', 'bench'), 'ms')}, d AS (SELECT b, sharpe_a - sharpe_bench AS a, sharpe_b_ret - sharpe_bench AS o FROM ms), z AS (SELECT a AS a0, o AS o0, greatest(a, o) AS st FROM d WHERE b = -1)
SELECT {fl('any_value(st)', 5)} AS statistic, avg((greatest(a - a0, o - o0) >= st)::INT) AS p_value, count(*) AS resamples FROM d, z WHERE b >= 0""")
def reality_check(spark, sf):
    """Share of resamples in which the best centred Sharpe difference to the benchmark beats what was seen: small if the best is no accident.

    Candidates are the top three names of models A and B, held for a bar; the benchmark is all names.
    """
    daily, names = daily_returns(spark, sf), ("a", "b_ret", "bench")
    gap = lambda df: df.select((F.col("sharpe_a") - F.col("sharpe_bench")).alias("a"), (F.col("sharpe_b_ret") - F.col("sharpe_bench")).alias("o"))
    seen = gap(S.path_metrics(daily.withColumnRenamed("trade_date", "t").withColumn("b", F.lit(-1)), names)).withColumnsRenamed({"a": "a0", "o": "o0"})
    drawn = gap(S.bootstrap(daily, 200, 10.0, 11, names)).crossJoin(F.broadcast(seen))  # one row
    statistic, best_one = F.greatest("a0", "o0"), F.greatest(F.col("a") - F.col("a0"), F.col("o") - F.col("o0"))
    return drawn.agg(rnd(F.max(statistic), 5).alias("statistic"), F.avg((best_one >= statistic).cast("double")).alias("p_value"), F.count("*").alias("resamples"))


@query("dca_irr", f"""WITH RECURSIVE {EQ}, m AS (SELECT portfolio, min(trade_date) AS d, arg_min(equity, trade_date) AS at_ FROM eq GROUP BY portfolio, date_trunc('month', trade_date)), n AS (SELECT portfolio, min(trade_date) AS d0, max(trade_date) AS d1, arg_max(equity, trade_date) AS e FROM eq GROUP BY 1),
fw AS (SELECT portfolio, (d - d0)::DOUBLE AS days, 100.0::DOUBLE AS amount FROM m JOIN n USING (portfolio) UNION ALL SELECT portfolio, max(d1 - d0)::DOUBLE, -sum(100 * e / at_) FROM m JOIN n USING (portfolio) GROUP BY 1),
bi(k, portfolio, lo, hi) AS (SELECT 0, portfolio, -0.99::DOUBLE, 10.0::DOUBLE FROM n UNION ALL SELECT k + 1, portfolio, CASE WHEN v > 0 THEN lo ELSE mid END, CASE WHEN v > 0 THEN mid ELSE hi END
 FROM (SELECT k, b.portfolio, lo, hi, (lo + hi) / 2 AS mid, sum(amount * pow(1 + (lo + hi) / 2, -days / 365.25::DOUBLE)) AS v FROM bi b JOIN fw ON fw.portfolio = b.portfolio WHERE k < 60 GROUP BY k, b.portfolio, lo, hi))
SELECT portfolio, {fl('(lo + hi) / 2')} AS rate FROM bi WHERE k = 60""")
def dca_irr(spark, sf):
    e = equity(spark, sf)
    months = e.groupBy("portfolio", F.trunc("trade_date", "month").alias("m")).agg(F.min("trade_date").alias("d"), F.min_by("equity", "trade_date").alias("at"))
    ends = e.groupBy("portfolio").agg(F.min("trade_date").alias("d0"), F.max("trade_date").alias("d1"), F.max_by("equity", "trade_date").alias("end"))
    rows = months.join(ends, "portfolio")
    paid = rows.select("portfolio", F.datediff("d", "d0").cast("double").alias("days"), F.lit(100.0).alias("amount"))
    got = rows.groupBy("portfolio").agg(F.max(F.datediff("d1", "d0")).cast("double").alias("days"), (-F.sum(100 * F.col("end") / F.col("at"))).alias("amount"))
    return _round(L.internal_rate(paid.unionByName(got)), ("portfolio",), "rate")


@query("thesis_flags", f"WITH {DONE} SELECT instrument_id, trade_date, score > 0.2 AS strong, holding > 5 AS long_hold, score > 0.2 AND holding > 5 AS both FROM dn WHERE model_id = 'A'")
def thesis_flags(spark, sf):
    strong, long_ = F.col("score") > 0.2, F.col("holding") > 5
    return done(spark, sf).where("model_id = 'A'").select("instrument_id", "trade_date", strong.alias("strong"), long_.alias("long_hold"), (strong & long_).alias("both"))


@query("live_performance", f"""WITH {DONE}, tk AS (SELECT *, row_number() OVER (PARTITION BY model_id, trade_date ORDER BY score DESC, instrument_id) AS r FROM dn), vs AS (SELECT DISTINCT model_id, trade_date, end_date AS e FROM dn),
sn AS (SELECT vs.model_id, vs.trade_date, vs.e, score, fwd, r, proba, label FROM vs JOIN tk ON tk.model_id = vs.model_id AND tk.trade_date = vs.trade_date AND tk.end_date <= vs.e),
rk AS (SELECT *, 2 * rank() OVER (PARTITION BY model_id, trade_date, e ORDER BY score) + count(*) OVER (PARTITION BY model_id, trade_date, e, score) - 1 AS a, 2 * rank() OVER (PARTITION BY model_id, trade_date, e ORDER BY fwd) + count(*) OVER (PARTITION BY model_id, trade_date, e, fwd) - 1 AS b FROM sn),
sm AS MATERIALIZED (SELECT model_id, trade_date, e, count(*) AS n, count(*) FILTER (r <= 5) AS nt, count(*) FILTER (r <= 5 AND fwd > 0) AS ht, sum(proba) AS p, sum(label) AS y, CAST(count(*) * sum(a * a) - sum(a) * sum(a) AS DOUBLE) AS va, CAST(count(*) * sum(b * b) - sum(b) * sum(b) AS DOUBLE) AS vb, CAST(count(*) * sum(a * b) - sum(a) * sum(b) AS DOUBLE) AS c FROM rk GROUP BY 1, 2, 3),
ev AS (SELECT DISTINCT model_id, trade_date AS day FROM dn), kn AS (SELECT ev.day, sm.* FROM ev JOIN sm ON sm.model_id = ev.model_id AND sm.e <= ev.day AND sm.trade_date > ev.day - 150 QUALIFY row_number() OVER (PARTITION BY sm.model_id, ev.day, sm.trade_date ORDER BY sm.e DESC) = 1),
nw AS (SELECT * FROM kn QUALIFY row_number() OVER (PARTITION BY model_id, day ORDER BY trade_date DESC) <= 60)
SELECT model_id, day AS trade_date, count(*) AS days, CAST(sum(n) AS BIGINT) AS n, {fl('avg(CASE WHEN n >= 8 AND va > 0 AND vb > 0 THEN c / (sqrt(va) * sqrt(vb)) END)')} AS rolling_ic, {fl('sum(ht) / nullif(sum(nt), 0)')} AS hit_rate, {fl('(sum(p) - sum(y)) / sum(n)')} AS gap FROM nw GROUP BY 1, 2""")
def live_performance(spark, sf):
    """Of the last 60 dates with an ended label, as known on each day: mean rank correlation, share of gains among the five best, stated less realised rate."""
    return _round(S.live_performance(done(spark, sf), 5), ("model_id", "trade_date", "days", "n"), "rolling_ic", "hit_rate", "gap")


@query("ops_metrics", f"""WITH {_EXIT} SELECT count(*) AS orders, count(price) AS filled, {fl('count(price) / nullif(count(*), 0)')} AS fill_rate, count(*) FILTER (reason = 'expired') AS expired, (SELECT {fl('avg(exit - entry - 10)')} FROM ex2) AS hold_deviation,
(SELECT count(*) FILTER (valid_from > DATE '1999-12-01' AND valid_from <= DATE '2000-02-29') + count(*) FILTER (valid_to > DATE '1999-12-01' AND valid_to <= DATE '2000-02-29') FROM membership) AS universe_changes_90d FROM fills""")
def ops_metrics(spark, sf):
    """Fill rate, sessions held beyond the ten stated, and members that came or went in the 90 days up to 2000-02-29."""
    f = fills(spark, sf).agg(F.count("*").alias("orders"), F.count("price").alias("filled"), rnd(F.try_divide(F.count("price"), F.count("*"))).alias("fill_rate"), F.count_if(F.col("reason") == "expired").alias("expired"))
    held = exits(spark, sf).agg(rnd(F.avg(F.col("exit") - F.col("entry") - 10)).alias("hold_deviation"))
    recent = lambda c: F.count_if((F.col(c) > F.date_sub(F.lit("2000-02-29").cast("date"), 90)) & (F.col(c) <= "2000-02-29"))
    changes = P.membership(spark, sf).agg((recent("valid_from") + recent("valid_to")).alias("universe_changes_90d"))
    return f.crossJoin(F.broadcast(held)).crossJoin(F.broadcast(changes))  # one row each


_BREACH = _IC + """, bs AS (SELECT model_id, avg(ic) AS m, avg((ic > 0)::INT) AS h FROM ic GROUP BY 1), bg AS (SELECT model_id, abs(avg(proba) - avg(label)) AS g FROM dn GROUP BY 1), br AS (SELECT model_id, metric, severity FROM (SELECT model_id, 'mean_ic' AS metric, CASE WHEN m < -0.05 THEN 'error' WHEN m < 0.02 THEN 'warning' END AS severity FROM bs
UNION ALL SELECT model_id, 'hit_rate', CASE WHEN h < 0.4 THEN 'error' WHEN h < 0.52 THEN 'warning' END FROM bs UNION ALL SELECT model_id, 'calibration', CASE WHEN g > 0.1 THEN 'error' WHEN g > 0.01 THEN 'warning' END FROM bg) WHERE severity IS NOT NULL)"""


@query("breach_rules", f"WITH {_BREACH} SELECT model_id, metric, severity FROM br")
def breach_rules(spark, sf):
    s = ics(spark, sf).groupBy("model_id").agg(F.avg("ic").alias("m"), F.avg((F.col("ic") > 0).cast("int")).alias("h"))
    s = s.join(done(spark, sf).groupBy("model_id").agg(F.abs(F.avg("proba") - F.avg("label")).alias("g")), "model_id", "full")
    rule = lambda name, error, warning: F.struct(F.lit(name).alias("metric"), F.when(F.expr(error), "error").when(F.expr(warning), "warning").alias("severity"))
    rules = F.array(rule("mean_ic", "m < -0.05", "m < 0.02"), rule("hit_rate", "h < 0.4", "h < 0.52"), rule("calibration", "g > 0.1", "g > 0.01"))
    return s.select("model_id", F.explode(rules).alias("x")).select("model_id", "x.*").where("severity is not null")


@query("retrain_due", f"""WITH {_BREACH}, l AS (SELECT model_id, max(trade_date) AS last, max(trade_date) FILTER (fold < 4) AS trained, CASE model_id WHEN 'A' THEN 'core:2' ELSE 'core:1' END AS features FROM dn GROUP BY 1)
SELECT model_id, 'schedule' AS kind, CAST(last - trained AS BIGINT) AS age_days FROM l WHERE last - trained > 365 UNION ALL SELECT model_id, 'new_feature_set', NULL FROM l WHERE features <> 'core:2' UNION ALL SELECT model_id, metric, NULL FROM br""")
def retrain_due(spark, sf):
    """Why a model is due: its training data is over a year old, the features in force are not those it was fitted on, or a metric is in breach."""
    s = done(spark, sf).groupBy("model_id").agg(F.max("trade_date").alias("last"), F.max(F.when(F.col("fold") < 4, F.col("trade_date"))).alias("trained"))
    fitted_on = F.when(F.col("model_id") == "A", "core:2").otherwise("core:1")
    return L.retrain_reasons(s.withColumn("features", fitted_on), breach_rules(spark, sf), "core:2", 365)


_LOG = DONE + ", lg AS (SELECT 'swing' || instrument_id % 3 AS strategy, model_id || '-' || fold AS model_id, max(trade_date) AS at_, CASE WHEN fold % 2 = 0 THEN 'champion' ELSE 'shadow' END AS status FROM dn GROUP BY instrument_id % 3, model_id, fold)"


@query("status_history", f"WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY at_ DESC, model_id DESC) AS r FROM lg WHERE status = 'champion') SELECT strategy, max(model_id) FILTER (r = 1) AS champion, max(model_id) FILTER (r = 2) AS previous FROM r WHERE r <= 2 GROUP BY 1")
def status_history(spark, sf):
    log = done(spark, sf).groupBy(F.concat(F.lit("swing"), F.col("instrument_id") % 3).alias("strategy"), "model_id", "fold").agg(F.max("trade_date").alias("at"))
    return L.champions(log.select("strategy", F.concat_ws("-", "model_id", "fold").alias("model_id"), "at", F.when(F.col("fold") % 2 == 0, "champion").otherwise("shadow").alias("status")))


@query("barrier_orders", f"""WITH {_CARD} SELECT instrument_id, trade_date, {fl('2.0::DOUBLE * atr / close')} AS stop_pct, {fl('4.0::DOUBLE * atr / close')} AS target_pct, 10 AS max_hold FROM sg WHERE atr IS NOT NULL""")
def barrier_orders(spark, sf):
    return cards(spark, sf).where("atr is not null").select("instrument_id", "trade_date", rnd(2.0 * F.col("atr") / F.col("close")).alias("stop_pct"), rnd(4.0 * F.col("atr") / F.col("close")).alias("target_pct"), F.lit(10).alias("max_hold"))


_RC = TRAILING + """, xx AS (SELECT grp, instrument_id, i, ret - avg(ret) OVER (PARTITION BY grp, instrument_id) AS x FROM trail), pp AS (SELECT a.grp, a.instrument_id, b.instrument_id AS other, avg(a.x * b.x) AS s, avg(a.x * b.x * a.x * b.x) AS q, count(*) AS n FROM xx a JOIN xx b ON a.grp = b.grp AND a.i = b.i GROUP BY 1, 2, 3),
tt AS (SELECT grp, sum(s) FILTER (instrument_id = other) / count(*) FILTER (instrument_id = other) AS mu, sum(s * s) - count(*) FILTER (instrument_id = other) * pow(sum(s) FILTER (instrument_id = other) / count(*) FILTER (instrument_id = other), 2) AS apart, sum((q - s * s) / n) AS noise FROM pp GROUP BY 1)"""


@query("returns_cov", f"WITH {_RC} SELECT grp, instrument_id, other, {fl('CASE WHEN apart > 0 THEN least(noise, apart) / apart ELSE 1 END * CASE WHEN instrument_id = other THEN mu ELSE 0 END + (1 - CASE WHEN apart > 0 THEN least(noise, apart) / apart ELSE 1 END) * s', 5)} AS covariance FROM pp JOIN tt USING (grp)")
def returns_cov(spark, sf):
    return _round(L.shrunk_covariance(trailing(spark, sf)), ("grp", "instrument_id", "other"), "covariance", places=5)


@query("target_weights", f"""WITH {_TOP}, v AS (SELECT *, abs(score) + 0.01 AS vol FROM tp) SELECT 'equal' AS scheme, instrument_id, trade_date, {fl('1.0::DOUBLE / count(*) OVER (PARTITION BY trade_date)')} AS weight FROM v UNION ALL SELECT 'inverse', instrument_id, trade_date, {fl('(1 / vol) / sum(1 / vol) OVER (PARTITION BY trade_date)')} FROM v""")
def target_weights(spark, sf):
    rows = best(spark, sf).withColumn("vol", F.abs("score") + 0.01)
    a = T.equal_weights(rows).withColumn("scheme", F.lit("equal"))
    b = T.inverse_volatility_weights(rows, "vol").withColumn("scheme", F.lit("inverse"))
    return _round(a.unionByName(b), ("scheme", "instrument_id", "trade_date"), "weight")


def _exit_sql(trades: str, target: str, settle: int, name: str) -> str:
    """SQL of bracket_exits on mkt for a table of trades with entry, price, stop, max_hold and a target column."""
    return f"""{name}e AS (SELECT t.trade_id, g.session_idx, CASE WHEN g.open <= stop THEN row(g.open, 'stop gap') WHEN g.open >= {target} THEN row(g.open, 'target gap') WHEN g.low <= stop THEN row(stop, 'stop') WHEN g.high >= {target} THEN row({target}, 'target') WHEN g.session_idx >= entry + max_hold THEN row(g.close, 'time') END AS e
 FROM {trades} t LEFT JOIN mkt g ON g.instrument_id = t.instrument_id AND g.session_idx BETWEEN entry + {settle + 1} AND entry + max_hold + 5 AND g.close IS NOT NULL AND NOT suspended AND NOT down_locked),
{name} AS (SELECT trade_id, x[1] AS exit, x[2][1] AS exit_price, coalesce(x[2][2], 'open') AS reason FROM (SELECT trade_id, arg_min(row(session_idx, e), session_idx) FILTER (e IS NOT NULL) AS x FROM {name}e GROUP BY 1))"""


@query("partial_target", f"""WITH {_EXIT}, tt AS (SELECT order_id AS trade_id, instrument_id, session_idx AS entry, price, price * 0.6::DOUBLE AS stop, price * 1.2::DOUBLE AS target1, price * 1.6::DOUBLE AS target, 12 AS max_hold FROM fills WHERE price IS NOT NULL), {_exit_sql('tt', 'target1', 2, 'xa')}, {_exit_sql('tt', 'target', 2, 'xb')},
one AS (SELECT trade_id, exit AS exit1, exit_price AS price1 FROM xa WHERE reason IN ('target', 'target gap')), lt AS (SELECT trade_id, instrument_id, exit1 AS entry, price, price AS stop, target, max_hold - (exit1 - entry) AS max_hold FROM tt JOIN one USING (trade_id)), {_exit_sql('lt', 'target', 0, 'xc')}
SELECT trade_id, NULL AS exit1, NULL::DOUBLE AS price1, exit AS exit2, {fl('exit_price', 4)} AS price2, {fl('exit_price', 4)} AS mean_price FROM xb WHERE trade_id NOT IN (SELECT trade_id FROM one)
UNION ALL SELECT trade_id, exit1, {fl('price1', 4)}, exit, {fl('exit_price', 4)}, {fl('0.5::DOUBLE * price1 + (1 - 0.5::DOUBLE) * exit_price', 4)} FROM one LEFT JOIN xc USING (trade_id)""")
def partial_target(spark, sf):
    f = fills(spark, sf).where("price is not null")
    p = F.col("price")
    t = f.select(F.col("order_id").alias("trade_id"), "instrument_id", F.col("session_idx").alias("entry"), "price", (p * 0.6).alias("stop"), (p * 1.2).alias("target1"), (p * 1.6).alias("target"), F.lit(12).alias("max_hold"))
    return _round(L.partial_targets(t, market(spark, sf), 0.5), ("trade_id", "exit1", "exit2"), "price1", "price2", "mean_price", places=4)


@query("prob_calibration", f"WITH {_GRADED} SELECT model_id, grade, CASE WHEN proba >= 0.55 THEN 'high' WHEN proba >= 0.48 THEN 'mid' ELSE 'low' END AS kind, count(*) AS n, {fl('avg(proba)')} AS stated, {fl('avg(label)')} AS realised FROM dn JOIN gd USING (model_id, fold) GROUP BY 1, 2, 3")
def prob_calibration(spark, sf):
    kind = F.when(F.col("proba") >= 0.55, "high").when(F.col("proba") >= 0.48, "mid").otherwise("low")
    rows = done(spark, sf).join(F.broadcast(evidence_grade(spark, sf)), ["model_id", "fold"])  # one row per model and fold
    s = rows.groupBy("model_id", "grade", kind.alias("kind")).agg(F.count("*").alias("n"), F.avg("proba").alias("stated"), F.avg("label").alias("realised"))
    return _round(s, ("model_id", "grade", "kind", "n"), "stated", "realised")


@query("invest_outcomes", f"WITH {DONE} SELECT model_id, fold, count(*) AS n, {fl('avg((fwd BETWEEN score - 0.2 AND score + 0.2)::INT)')} AS coverage, {fl('avg(fwd)')} AS mean FROM dn GROUP BY 1, 2")
def invest_outcomes(spark, sf):
    inside = F.col("fwd").between(F.col("score") - 0.2, F.col("score") + 0.2)
    return _round(done(spark, sf).groupBy("model_id", "fold").agg(F.count("*").alias("n"), F.avg(inside.cast("int")).alias("coverage"), F.avg("fwd").alias("mean")), ("model_id", "fold", "n"), "coverage", "mean")


_STATUS = _EXIT + ", st AS (SELECT f.order_id, f.instrument_id, f.session_idx AS entry, f.price, x.exit, CASE WHEN f.reason LIKE 'cancelled%' THEN 'cancelled' WHEN f.reason IS NOT NULL THEN 'expired' WHEN x.exit IS NULL THEN 'open' ELSE 'closed' END AS status FROM fills f LEFT JOIN ex2 x ON x.trade_id = f.order_id)"


def _statuses(spark, sf):
    x = exits(spark, sf).select(F.col("trade_id").alias("order_id"), "exit", "exit_price")
    s = F.when(F.col("reason").startswith("cancelled"), "cancelled").when(F.col("reason").isNotNull(), "expired").when(F.col("exit").isNull(), "open").otherwise("closed")
    return fills(spark, sf).join(x, "order_id", "left").select("order_id", "instrument_id", F.col("session_idx").alias("entry"), "price", "exit", "exit_price", s.alias("status"))


@query("order_status_map", f"WITH {_STATUS} SELECT order_id, status FROM st")
def order_status_map(spark, sf):
    return _statuses(spark, sf).select("order_id", "status")


@query("recommendation_status", f"""WITH {_STATUS}, {P.BENCH}, bs AS (SELECT session_idx, b.close FROM bench b JOIN cal USING (trade_date)), ex3 AS (SELECT order_id, max(g.high) / any_value(price) - 1 AS mfe, min(g.low) / any_value(price) - 1 AS mae FROM st JOIN grid g ON g.instrument_id = st.instrument_id AND g.session_idx BETWEEN entry AND exit WHERE status = 'closed' GROUP BY 1)
SELECT order_id, {fl('mfe')} AS mfe, {fl('mae')} AS mae, {fl('(exit_price - x.price) / (x.price * 0.4)')} AS realised_r, {fl('b2.close / b1.close - 1')} AS benchmark FROM ex3 JOIN ex2 x ON x.trade_id = order_id LEFT JOIN bs b1 ON b1.session_idx = x.entry LEFT JOIN bs b2 ON b2.session_idx = x.exit""")
def recommendation_status(spark, sf):
    """Closed orders: best and worst excursion, result in units of the risk to the stop, and the benchmark over the same sessions."""
    g = grid(spark, sf).select(F.col("instrument_id").alias("gid"), "session_idx", "high", "low")
    s = _statuses(spark, sf).where("status = 'closed'")
    rows = s.join(g, (F.col("instrument_id") == F.col("gid")) & F.col("session_idx").between(F.col("entry"), F.col("exit")))
    out = rows.groupBy("order_id", "price", "entry", "exit", "exit_price").agg((F.max("high") / F.first("price") - 1).alias("mfe"), (F.min("low") / F.first("price") - 1).alias("mae"))
    out = out.withColumn("realised_r", (F.col("exit_price") - F.col("price")) / (F.col("price") * 0.4))
    level = P.bench(spark, sf).join(P.calendar(spark, sf), "trade_date")
    at = lambda name, to: F.broadcast(level.select(F.col("session_idx").alias(name), F.col("close").alias(to)))  # noqa: E731  one row per session
    return _round(out.join(at("entry", "b1"), "entry", "left").join(at("exit", "b2"), "exit", "left").withColumn("benchmark", F.col("b2") / F.col("b1") - 1), ("order_id",), "mfe", "mae", "realised_r", "benchmark")


@query("open_recommendations", f"WITH {_STATUS} SELECT order_id, instrument_id FROM st WHERE entry <= 497 AND (exit IS NULL OR exit > 497)")
def open_recommendations(spark, sf):
    return _statuses(spark, sf).where("entry <= 497 and (exit is null or exit > 497)").select("order_id", "instrument_id")


@query("trades_table", f"WITH {_STATUS} SELECT order_id, st.exit - st.entry AS sessions, {fl('exit_price / st.price - 1')} AS ret, exit_price > st.price AS win FROM st JOIN ex2 x ON x.trade_id = st.order_id WHERE status = 'closed'")
def trades_table(spark, sf):
    s = _statuses(spark, sf).where("status = 'closed'")
    return s.select("order_id", (F.col("exit") - F.col("entry")).alias("sessions"), rnd(F.col("exit_price") / F.col("price") - 1).alias("ret"), (F.col("exit_price") > F.col("price")).alias("win"))


@query("portfolio_snapshots", f"""WITH {_EXIT}, stp_ AS (SELECT instrument_id, entry AS s, 100 AS step, -100 * price AS flow FROM ex2 UNION ALL SELECT instrument_id, exit, -100, 100 * exit_price FROM ex2 WHERE exit IS NOT NULL), sq AS (SELECT instrument_id, s, sum(step) AS step, sum(flow) AS flow FROM stp_ GROUP BY 1, 2),
hd AS (SELECT g.instrument_id % 3 AS portfolio, g.instrument_id, session_idx, trade_date, flow, CAST(coalesce(sum(step) OVER w, 0) AS BIGINT) AS held, coalesce(last_value(close IGNORE NULLS) OVER w, 0) AS px FROM grid g LEFT JOIN sq ON sq.instrument_id = g.instrument_id AND s = session_idx WINDOW w AS (PARTITION BY g.instrument_id ORDER BY session_idx ROWS UNBOUNDED PRECEDING)),
dy AS (SELECT portfolio, session_idx, trade_date, coalesce(sum(flow), 0) AS flow, sum(held * px) AS mv, coalesce(string_agg(instrument_id || ':' || held, ',' ORDER BY instrument_id) FILTER (held > 0), '') AS open_ FROM hd GROUP BY 1, 2, 3),
cs AS (SELECT *, 10000000.0::DOUBLE + sum(flow) OVER (PARTITION BY portfolio ORDER BY session_idx ROWS UNBOUNDED PRECEDING) AS cash FROM dy), pk AS (SELECT *, max(cash + mv) OVER (PARTITION BY portfolio ORDER BY session_idx ROWS UNBOUNDED PRECEDING) AS peak, max(session_idx) OVER (PARTITION BY portfolio) AS latest FROM cs)
SELECT portfolio, trade_date, {fl('cash', 2)} AS cash, {fl('cash + mv', 2)} AS equity, {fl('peak', 2)} AS peak, {fl('(cash + mv) / peak - 1')} AS drawdown, {fl('mv / nullif(cash + mv, 0)')} AS exposure, CASE WHEN session_idx = latest THEN open_ END AS positions FROM pk""")
def portfolio_snapshots(spark, sf):
    """Three portfolios hold the trades of the example's fills, a lot each."""
    own_portfolio = (F.col("instrument_id") % 3).alias("portfolio")
    trades = exits(spark, sf).select(own_portfolio, "instrument_id", "entry", "price", "exit", "exit_price")
    closes = grid(spark, sf).select(own_portfolio, "instrument_id", "session_idx", "trade_date", "close")
    s = L.portfolio_snapshots(trades, closes, 10_000_000.0)
    return s.select("portfolio", "trade_date", *[rnd(c, 2).alias(c) for c in ("cash", "equity", "peak")], rnd("drawdown").alias("drawdown"), rnd("exposure").alias("exposure"), "positions")


@query("exposure_stats", f"WITH {_TOP}, d AS (SELECT trade_date, count(*) * 0.15::DOUBLE AS e FROM tp GROUP BY 1) SELECT {fl('avg(e)')} AS mean, {fl('max(e)')} AS most, {fl('min(e)')} AS least, count(*) AS days FROM d")
def exposure_stats(spark, sf):
    d = best(spark, sf).groupBy("trade_date").agg((F.count("*") * 0.15).alias("e"))
    return d.agg(rnd(F.avg("e")).alias("mean"), rnd(F.max("e")).alias("most"), rnd(F.min("e")).alias("least"), F.count("*").alias("days"))


@query("open_alerts", f"""WITH {ALL}, fi AS ({_UNION}) SELECT instrument_id, trade_date, "check", severity FROM fi WHERE severity IN ('error', 'warning') AND instrument_id % 4 <> 0""")
def open_alerts(spark, sf):
    return some_findings(spark, sf).where("severity in ('error', 'warning') and instrument_id % 4 != 0").select("instrument_id", "trade_date", "check", "severity")


_INV = DONE + f""", si AS (SELECT instrument_id, trade_date, close, score - 0.2 AS q10, score AS q50, score + 0.2 AS q90, {_up('close * 0.9::DOUBLE')} AS floor_, {_dn('close * 1.1::DOUBLE')} AS ceil_, proba / 4 AS w FROM dn JOIN own USING (instrument_id, trade_date) WHERE model_id = 'A'),
zn AS (SELECT *, greatest({_dn('close * (1 - 0.03::DOUBLE)')}, floor_) AS zl, least({_dn('close * (1 + 0.01::DOUBLE)')}, ceil_) AS zh, least(w, 0.13::DOUBLE) AS weight FROM si), rf AS (SELECT *, least(greatest({_near('(zl + zh) / 2')}, zl), zh) AS ref FROM zn),
iv AS (SELECT instrument_id, trade_date, zl, zh, greatest({_dn('ref * (1 + q10)')}, 0.01) AS bear, {_near('ref * (1 + q50)')} AS base, {_up('ref * (1 + q90)')} AS bull, weight, floor(weight * 10000000.0::DOUBLE / (zh * 100)) * 100 AS q, floor_ FROM rf)"""


_REFUSAL = "CASE WHEN zl > zh OR zh <= floor_ THEN 'zone outside the band' WHEN q < 100 THEN 'less than a lot' END"
_REFUSED = f"coalesce({_REFUSAL}, 'accepted')"


@query("card_invest_levels", f"WITH {_INV} SELECT instrument_id, trade_date, {fl('zl', 4)} AS zone_low, {fl('zh', 4)} AS zone_high, {fl('bear', 4)} AS bear, {fl('base', 4)} AS base, {fl('bull', 4)} AS bull, {fl('weight', 4)} AS weight, CAST(q AS BIGINT) AS quantity, {_REFUSAL} AS reason FROM iv")
def card_invest_levels(spark, sf):
    cards_ = _invest_cards(spark, sf).withColumn("quantity", F.col("quantity").cast("bigint"))
    return _round(cards_, ("instrument_id", "trade_date", "quantity", "reason"), "zone_low", "zone_high", "bear", "base", "bull", "weight", places=4)


def _invest_cards(spark, sf):
    p = F.col("close")
    rows = done(spark, sf).where("model_id = 'A'").join(P.bars(spark, sf).select("instrument_id", "trade_date", "close"), ["instrument_id", "trade_date"])
    rows = rows.select(
        "instrument_id", "trade_date", "close", (F.col("score") - 0.2).alias("q10"), F.col("score").alias("q50"), (F.col("score") + 0.2).alias("q90"),
        T.tick_round(p * 0.9, True).alias("floor"), T.tick_round(p * 1.1, False).alias("ceiling"), (F.col("proba") / 4).alias("weight"),
    )
    return T.invest_levels(rows, 10_000_000.0, 0.13)


_STEP = "m AS (SELECT min(session_idx) AS s FROM cal GROUP BY year(trade_date), quarter(trade_date)), step_ AS (SELECT trade_date, session_idx, CASE WHEN session_idx IN (SELECT s FROM m) THEN 'rebalance' WHEN session_idx - 10 IN (SELECT s FROM m) THEN 'second tranche' ELSE 'none' END AS step FROM cal)"


@query("invest_step_due", f"WITH {P.BARS_CAL}, {_STEP} SELECT * FROM step_")
def invest_step_due(spark, sf):
    return _steps(spark, sf)


def _steps(spark, sf):
    cal = P.calendar(spark, sf)
    q = T.rebalance_sessions(cal, "quarter").select("session_idx")
    due = q.select("session_idx", F.lit("rebalance").alias("step")).unionByName(q.select((F.col("session_idx") + 10).alias("session_idx"), F.lit("second tranche").alias("step"))).groupBy("session_idx").agg(F.min("step").alias("step"))
    return cal.join(due, "session_idx", "left").select("trade_date", "session_idx", F.coalesce("step", F.lit("none")).alias("step"))


_CARDS_ONLY = SIZED.removeprefix(P.OWN_BARS).lstrip(", \n")
#: The book of each session: every fifth name, another fifth each 20 sessions, is held in invest; 0.4 % is at risk; no card while the mean close is in a stop.
_BOOK = f"""{P.BENCH}, beq AS MATERIALIZED (SELECT 1 AS portfolio, row_number() OVER (ORDER BY trade_date) - 1 AS i, row_number() OVER (ORDER BY trade_date) AS session_idx, trade_date, close AS equity FROM bench), {kill_sql('beq', 0.3, 5)},
held AS (SELECT trade_date, instrument_id FROM cal, (SELECT DISTINCT instrument_id FROM bars) WHERE (instrument_id + session_idx // 20) % 5 = 0),
bk AS MATERIALIZED (SELECT cal.trade_date, coalesce(n, 0) * 0.02::DOUBLE AS ui, coalesce(state <> 'trading', false) AS stopped FROM cal LEFT JOIN (SELECT trade_date, count(*) AS n FROM held GROUP BY 1) USING (trade_date) LEFT JOIN (SELECT trade_date, state FROM ks JOIN beq USING (i)) USING (trade_date))"""


def _book(spark, sf):
    held = P.calendar(spark, sf).join(P.instruments(spark, sf), (F.col("instrument_id") + F.floor(F.col("session_idx") / 20)) % 5 == 0).select("trade_date", "instrument_id")
    names = held.groupBy("trade_date").agg(F.map_from_entries(F.collect_list(F.struct("instrument_id", F.lit(0.02)))).alias("names"), F.create_map(F.lit("invest"), F.count("*") * 0.02).alias("used"))
    b = P.bench(spark, sf).select(F.lit(1).alias("portfolio"), F.datediff("trade_date", F.lit("1990-01-01")).alias("session_idx"), F.col("close").alias("equity"))
    stopped = T.kill_states(b, 0.3, 5).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("session_idx")).alias("trade_date"), (F.col("state") != "trading").alias("stopped"))
    return P.calendar(spark, sf).select("trade_date").join(names, "trade_date", "left").join(stopped, "trade_date", "left").withColumn("open_risk", F.lit(0.004))


def _aggregate_sql(cards_: str) -> str:
    """SQL of accepted_cards() as ag, from a table of trade_date, k (from 1), sleeve, instrument_id, weight, quantity, price, risk_share and held (in all sleeves)."""
    lots = lambda room: f"floor({room} * 10000000.0::DOUBLE / (price * 100)) * 100"
    fit = lambda w, q, room, x, rows: f"SELECT *, {room} >= {w} - 1e-12 AS keep{x}, {room} >= {w} - 1e-12 OR ({room} >= 0.5 * {w} AND {lots(room)} >= 100) AS ok{x}, CASE WHEN {room} >= {w} - 1e-12 THEN {w} ELSE {lots(room)} * price / 10000000.0::DOUBLE END AS w{x}, CASE WHEN {room} >= {w} - 1e-12 THEN {q} ELSE {lots(room)} END AS q{x} FROM ({rows}) r{x}"
    rows = f"""SELECT c.*, a.us, a.ui, a.risk, a.acc, b.stopped, CASE WHEN c.sleeve = 'swing' THEN 0.3::DOUBLE - a.us ELSE 0.4::DOUBLE - a.ui END AS room1,
      0.08::DOUBLE - (c.held + coalesce(list_sum(list_transform(list_filter(a.acc, lambda x: x.i = c.instrument_id), lambda x: x.w)), 0)) AS room2 FROM ag a JOIN {cards_} c ON c.trade_date = a.trade_date AND c.k = a.k + 1 JOIN bk b ON b.trade_date = c.trade_date"""
    return f"""ag(trade_date, k, us, ui, risk, acc, sleeve, instrument_id, weight, quantity, decision) AS (
    SELECT trade_date, CAST(0 AS BIGINT), 0.0::DOUBLE, ui, 0.004::DOUBLE, CAST([] AS STRUCT(i BIGINT, w DOUBLE)[]), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM bk
    UNION ALL SELECT trade_date, k, us + CASE WHEN took AND sleeve = 'swing' THEN w2 ELSE 0 END, ui + CASE WHEN took AND sleeve = 'invest' THEN w2 ELSE 0 END, risk + CASE WHEN took THEN coalesce(q2 * risk_share, 0) ELSE 0 END,
      CASE WHEN took THEN list_append(acc, {{'i': instrument_id, 'w': w2}}) ELSE acc END, sleeve, instrument_id, CASE WHEN took THEN w2 ELSE 0 END, CAST(CASE WHEN took THEN q2 ELSE 0 END AS BIGINT), decision
    FROM (SELECT *, decision IN ('accepted', 'shrunk') AS took FROM (SELECT *, CASE WHEN stopped THEN 'kill switch' WHEN NOT ok1 THEN 'sleeve full' WHEN NOT ok2 THEN 'name full' WHEN risk + q2 * risk_share > 0.02 + 1e-12 THEN 'open risk' WHEN NOT keep1 OR NOT keep2 THEN 'shrunk' ELSE 'accepted' END AS decision
      FROM ({fit('w1', 'q1', 'room2', '2', fit('weight', 'quantity', 'room1', '1', rows))}) z) y) x)"""


def _cards_sql(picked: str = "") -> str:
    return f"""cds AS MATERIALIZED (SELECT u.*, row_number() OVER (PARTITION BY u.trade_date ORDER BY rank) AS k, CASE WHEN h.instrument_id IS NULL THEN 0.0::DOUBLE ELSE 0.02 END AS held FROM (
  SELECT trade_date, instrument_id AS rank, 'swing' AS sleeve, instrument_id, weight, quantity, zone_high AS price, (ref - stop) / 10000000.0::DOUBLE AS risk_share FROM sized WHERE refused IS NULL
  UNION ALL SELECT trade_date, 1000 + instrument_id, 'invest', instrument_id, weight, CAST(q AS BIGINT), zh, NULL FROM iv JOIN step_ USING (trade_date) WHERE step <> 'none' AND {_REFUSAL} IS NULL) u {picked} LEFT JOIN held h ON h.trade_date = u.trade_date AND h.instrument_id = u.instrument_id JOIN bk ON bk.trade_date = u.trade_date)"""


def _taken(spark, sf, swing, invest):
    """Decisions on cards of both sleeves: swing cards first, by instrument."""
    s = swing.where("refused is null").select("trade_date", F.col("instrument_id").alias("rank"), F.lit("swing").alias("sleeve"), "instrument_id", "weight", F.col("quantity").cast("bigint").alias("quantity"), F.col("zone_high").alias("price"), ((F.col("reference") - F.col("stop")) / 10_000_000.0).alias("risk_share"))
    i = invest.where("reason is null").select("trade_date", (F.col("instrument_id") + 1000).alias("rank"), F.lit("invest").alias("sleeve"), "instrument_id", "weight", F.col("quantity").cast("bigint").alias("quantity"), F.col("zone_high").alias("price"), F.lit(None).cast("double").alias("risk_share"))
    cal = F.broadcast(P.calendar(spark, sf).select("trade_date"))  # one row per session
    return L.accepted_cards(s.unionByName(i).join(cal, "trade_date"), {"swing": 0.3, "invest": 0.4}, 0.08, 0.02, 10_000_000.0, _book(spark, sf))


def _due_invest_cards(spark, sf):
    return _invest_cards(spark, sf).join(F.broadcast(_steps(spark, sf).where("step != 'none'").select("trade_date")), "trade_date")  # two rows a quarter


_BOTH = f"RECURSIVE {_INV}, {P.CAL}, {_STEP}, {_CARDS_ONLY}, {_BOOK}"


@query("card_aggregate", f"WITH {_BOTH}, {_cards_sql()}, {_aggregate_sql('cds')} SELECT trade_date, sleeve, instrument_id, {fl('weight')} AS weight, quantity, decision FROM ag WHERE k > 0")
def card_aggregate(spark, sf):
    """What the portfolio takes of all cards of a session: budgets of two sleeves, a cap per name over both, open risk, the kill switch."""
    rows = _taken(spark, sf, sized_cards(spark, sf), _due_invest_cards(spark, sf))
    return rows.select("trade_date", "sleeve", "instrument_id", rnd("weight").alias("weight"), "quantity", "decision")


_PICKED = "JOIN pk ON pk.trade_date = u.trade_date AND pk.instrument_id = u.instrument_id"


@query("card_plan", f"""WITH {_BOTH}, pk AS MATERIALIZED (SELECT instrument_id, trade_date FROM dn WHERE model_id = 'A' QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, instrument_id) <= 5), {_cards_sql(_PICKED)}, {_aggregate_sql('cds')},
cp AS (SELECT 'swing' AS sleeve, trade_date, reason AS outcome FROM rr JOIN pk USING (instrument_id, trade_date) WHERE reason IS NOT NULL UNION ALL SELECT 'swing', trade_date, refused FROM sized JOIN pk USING (instrument_id, trade_date) WHERE refused IS NOT NULL
UNION ALL SELECT 'invest', iv.trade_date, {_REFUSAL} FROM iv JOIN pk USING (instrument_id, trade_date) JOIN step_ USING (trade_date) WHERE step <> 'none' AND {_REFUSAL} IS NOT NULL UNION ALL SELECT sleeve, trade_date, decision FROM ag WHERE k > 0)
SELECT sleeve, outcome, CAST(year(trade_date) AS INTEGER) AS year, count(*) AS n FROM cp GROUP BY 1, 2, 3""")
def card_plan(spark, sf):
    """Cards of the five best of each date: swing cards daily, invest cards at quarterly rebalances and their second tranches; taken, cut or why not, by year."""
    picks = best(spark, sf).select("instrument_id", "trade_date")
    swing, invest = cards(spark, sf).join(picks, ["instrument_id", "trade_date"]), _due_invest_cards(spark, sf).join(picks, ["instrument_id", "trade_date"])
    sized = sized_cards(spark, sf).join(picks, ["instrument_id", "trade_date"])
    refused = lambda rows, sleeve, why: rows.where(f"{why} is not null").select(F.lit(sleeve).alias("sleeve"), "trade_date", F.col(why).alias("outcome"))
    rows = refused(swing, "swing", "reason").unionByName(refused(sized, "swing", "refused")).unionByName(refused(invest, "invest", "reason"))
    rows = rows.unionByName(_taken(spark, sf, sized, invest).select("sleeve", "trade_date", F.col("decision").alias("outcome")))
    return rows.groupBy("sleeve", "outcome", F.year("trade_date").alias("year")).agg(F.count("*").alias("n"))


@query("sleeve_expand", f"WITH {_TOP} SELECT sleeve, instrument_id, trade_date, sleeve || '-' || instrument_id AS key FROM tp, (SELECT unnest(['swing', 'invest']) AS sleeve)")
def sleeve_expand(spark, sf):
    rows = best(spark, sf).withColumn("sleeve", F.explode(F.array(F.lit("swing"), F.lit("invest"))))
    return rows.select("sleeve", "instrument_id", "trade_date", F.concat_ws("-", "sleeve", "instrument_id").alias("key"))


@query("daily_report_tables", f"""WITH {_EXIT}, dn0 AS (SELECT instrument_id, trade_date, floor((close / lag(close, 5) OVER w - 1) * 1e6 + 0.5) / 1e6 AS score, floor((lead(close, 5) OVER w / close - 1) * 1e6 + 0.5) / 1e6 AS fwd FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY trade_date)), tp AS (SELECT * FROM dn0 WHERE score IS NOT NULL AND fwd IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, instrument_id) <= 5),
d AS (SELECT c.session_idx AS s, c.trade_date AS d FROM cal c WHERE c.trade_date = (SELECT max(trade_date) FROM tp JOIN cal USING (trade_date))), eq AS (SELECT instrument_id, trade_date, close, close / max(close) OVER (PARTITION BY instrument_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM bars)
SELECT 'picks' AS section, CAST(instrument_id AS VARCHAR) AS key, {fl('score')} AS value FROM tp, d WHERE trade_date = d UNION ALL SELECT 'closes', CAST(instrument_id AS VARCHAR), close FROM bars, d WHERE trade_date = d UNION ALL SELECT 'drawdown', CAST(instrument_id AS VARCHAR), {fl('fall')} FROM eq, d WHERE trade_date = d
UNION ALL SELECT 'orders', CAST(order_id AS VARCHAR), low FROM od, d WHERE first <= s AND last >= s UNION ALL SELECT 'positions', CAST(trade_id AS VARCHAR), {fl('price', 4)} FROM ex2, d WHERE entry <= s AND (exit IS NULL OR exit > s) UNION ALL SELECT 'closed', CAST(trade_id AS VARCHAR), {fl('exit_price / price - 1')} FROM ex2, d WHERE exit <= s AND exit > s - 20""")
def daily_report_tables(spark, sf):
    """The tables of the last day with picks, one below the other: picks, closes, drawdowns, working orders, open positions, and trades closed in 20 sessions."""
    top = best(spark, sf)
    day = F.broadcast(top.join(P.calendar(spark, sf), "trade_date").agg(F.max("trade_date").alias("trade_date"), F.max("session_idx").alias("s")))  # one row
    part = lambda rows, section, key, value: rows.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), value.alias("value"))
    w = Window.partitionBy("instrument_id").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    b = P.bars(spark, sf).withColumn("fall", F.col("close") / F.max("close").over(w) - 1).join(day.drop("s"), "trade_date")
    trades, at = exits(spark, sf).crossJoin(day.select("s")), F.col("s")
    out = part(top.join(day.drop("s"), "trade_date"), "picks", "instrument_id", rnd("score")).unionByName(part(b, "closes", "instrument_id", F.col("close"))).unionByName(part(b, "drawdown", "instrument_id", rnd("fall")))
    out = out.unionByName(part(orders(spark, sf).crossJoin(day.select("s")).where(at.between(F.col("first"), F.col("last"))), "orders", "order_id", F.col("low")))
    held = trades.where((F.col("entry") <= at) & (F.col("exit").isNull() | (F.col("exit") > at)))
    closed = trades.where((F.col("exit") <= at) & (F.col("exit") > at - 20))
    return out.unionByName(part(held, "positions", "trade_id", rnd("price", 4))).unionByName(part(closed, "closed", "trade_id", rnd(F.col("exit_price") / F.col("price") - 1)))


# models


@query("wf_final_fit")
def wf_final_fit(spark, sf):
    rows = _model_rows(spark, sf)
    return M.fit_linear(rows.where("trade_date < date'2000-06-01'"), FEATURES, "fwd", 0.01).transform(rows.where("trade_date >= date'2000-07-01'")).select("instrument_id", "trade_date", "score_ml")


@query("score_range")
def score_range(spark, sf):
    """Scores, ranks, calibrated probabilities and scenario quantiles of a quarter, by a model stored and loaded again."""
    rows = _model_rows(spark, sf)
    fitted = rows.where("fold < 4")
    path = M.save_model(M.fit_rank_trees(fitted, FEATURES, "fwd", 5), files.scratch(spark, "model"))
    scored = M.score_range(spark, path, rows, "2000-01-01", "2000-03-31").withColumnRenamed("proba", "p")
    proba = M.fit_isotonic(fitted, "proba", "label").transform(scored)
    out = M.scenario_quantiles(fitted, proba, "score", "fwd", 5)
    return out.select("instrument_id", "trade_date", "score_ml", "rank", F.col("calibrated").alias("proba"), *[F.col("scenarios")[i].alias(q) for i, q in enumerate(("q10", "q50", "q90"))])


@query("grid_tune")
def grid_tune(spark, sf):
    """Ridge and elastic net on the forward rank, every point with its mean daily rank correlation on the validation fold, the best of each family marked."""
    rows = M.forward_rank(_model_rows(spark, sf), "fwd", "fwd_rank")
    grid = [(0.001, 0.0), (0.1, 0.0), (10.0, 0.0), (0.001, 0.5), (0.01, 0.5), (0.01, 0.9)]
    return M.tune(rows.where("fold < 3"), rows.where("fold = 3"), FEATURES, "fwd_rank", "fwd", grid)


@query("meta_label")
def meta_label(spark, sf):
    """A logistic filter on earlier trades, judged on the later ones by the gain of what it keeps and that gain's lower bound."""
    later = M.meta_filter(_model_rows(spark, sf), FEATURES, "fwd", "1999-01-01")
    return M.filter_gain(later, "fwd", 200, 7)


@query("recalibrate")
def recalibrate(spark, sf):
    rows = _model_rows(spark, sf)
    later = M.fit_isotonic(rows.where("fold < 4"), "proba", "label").transform(rows.where("fold >= 4").withColumnRenamed("proba", "p"))
    return later.agg(F.avg(F.pow(F.col("p") - F.col("label"), F.lit(2))).alias("before"), F.avg(F.pow(F.col("calibrated") - F.col("label"), F.lit(2))).alias("after"))
