"""Panel preparation, features, labels and datasets as registered queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.columns import change, dates, rnd, sessions
from barloom.operators import features as X
from barloom.plans.registry import query
from barloom.sources import panel as P

OWN = P.OWN_BARS
W = "WINDOW w AS (PARTITION BY instrument_id ORDER BY bar_idx)"


def fl(x: str, places: int = 6) -> str:
    """The SQL of functions.columns.rnd."""
    return f"floor(({x}) * 1e{places} + 0.5) / 1e{places}"


def full(agg: str, n: int, x: str = "close") -> str:
    """An aggregate over the last n rows, null until all have a value."""
    over = f"OVER (PARTITION BY instrument_id ORDER BY bar_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} = {n} THEN {agg} {over} END"


def prior(agg: str, n: int) -> str:
    return f"{agg} OVER (PARTITION BY instrument_id ORDER BY bar_idx ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _out(df, *columns, places=6):
    return df.select("instrument_id", "trade_date", *[rnd(c, places).alias(c) for c in columns])


def _feature(name: str, sql: str, make, *columns: str):
    """A feature over own bars with its SQL over `own`."""

    @query(name, sql)
    def run(spark, sf):
        return _out(make(P.own_bars(spark, sf), spark, sf), *columns)


def _simple(name: str, make, columns: dict[str, str]):
    inner = ", ".join(f"{fl(e)} AS {c}" for c, e in columns.items())
    _feature(name, f"WITH {OWN} SELECT instrument_id, trade_date, {inner} FROM own {W}", lambda df, spark, sf: make(df), *columns)


_simple("feat_ret", lambda df: X.feature_frame(df, [(f"ret_{n}", 1) for n in (1, 2, 3, 5, 10)]), {f"ret_{n}": f"close / lag(close, {n}) OVER w - 1" for n in (1, 2, 3, 5, 10)})
_simple("feat_gap", X.gap, {"gap": "open / lag(close) OVER w - 1"})
_simple("feat_zscore", X.zscore, {"zscore": f"(close - {full('avg(close)', 20)}) / nullif({full('stddev_samp(close)', 20)}, 0)"})
_simple("feat_bollinger", X.bollinger, {"bollinger": f"(close - ({full('avg(close)', 20)} - 2 * {full('stddev_samp(close)', 20)})) / nullif(4 * {full('stddev_samp(close)', 20)}, 0)"})
_simple("feat_donchian", X.donchian, {"donchian_high": f"CASE WHEN {prior('count(close)', 20)} = 20 THEN close / {prior('max(high)', 20)} - 1 END", "donchian_low": f"CASE WHEN {prior('count(close)', 20)} = 20 THEN close / {prior('min(low)', 20)} - 1 END"})
_simple("feat_volume_spike", X.volume_spike, {"volume_spike": f"CASE WHEN {prior('count(volume)', 20)} = 20 THEN volume / nullif({prior('quantile_cont(volume, 0.5)', 20)}, 0) END"})
_simple("feat_momentum_skip", lambda df: X.momentum(X.momentum(X.momentum(df, 3), 6), 12), {f"mom_{m}m": f"lag(close, 21) OVER w / lag(close, {21 + 21 * m}) OVER w - 1" for m in (3, 6, 12)})
_simple("feat_drawdown", X.drawdown, {"drawdown": f"close / {full('max(close)', 252)} - 1"})
_simple("feat_sma_ratio", X.sma_ratio, {"sma_ratio": f"close / {full('avg(close)', 200)} - 1"})
_simple("feat_liquidity_v1", X.liquidity_level, {"liq_level": f"ln({full('quantile_cont(close * volume, 0.5)', 60)})", "liq_zero_share": full("avg(CASE WHEN volume = 0 THEN 1.0::DOUBLE ELSE 0.0 END)", 60)})
_simple("feat_liquidity_v2", X.liquidity_trend, {"liq_trend": f"ln({full('quantile_cont(close * volume, 0.5)', 60)} / {full('quantile_cont(close * volume, 0.5)', 252)})", "liq_zero_share": full("avg(CASE WHEN volume = 0 THEN 1.0::DOUBLE ELSE 0.0 END)", 60)})

_R1 = OWN + f", rr AS (SELECT *, close / lag(close) OVER w - 1 AS r1 FROM own {W})"
_feature("feat_volatility", f"WITH {_R1} SELECT instrument_id, trade_date, {fl(full('stddev_samp(r1)', 63, 'r1') + ' * sqrt(252)')} AS vol_63, {fl(full('stddev_samp(r1)', 126, 'r1') + ' * sqrt(252)')} AS vol_126 FROM rr", lambda df, spark, sf: X.volatility(X.volatility(df, 63), 126), "vol_63", "vol_126")

_TR = OWN + f""", pc AS (SELECT *, lag(close) OVER w AS p FROM own {W}), tr_ AS (SELECT *, greatest(high - low, abs(high - p), abs(low - p)) AS tr FROM pc)"""
_feature("true_range", f"WITH {_TR} SELECT instrument_id, trade_date, {fl('tr')} AS tr FROM tr_", lambda df, spark, sf: df.withColumn("tr", X.true_range()), "tr")


def ema(source: str, x: str, alpha: str, out: str, start: int = 1) -> str:
    """A recursive mean, one step per bar, from bar `start` on."""
    return f"""{out}(instrument_id, bar_idx, y) AS (SELECT instrument_id, bar_idx, {x} FROM {source} WHERE bar_idx = {start}
  UNION ALL SELECT s.instrument_id, s.bar_idx, {alpha} * s.{x} + (1 - {alpha}) * e.y FROM {out} e JOIN {source} s ON s.instrument_id = e.instrument_id AND s.bar_idx = e.bar_idx + 1)"""


A14, A12, A26, A9 = "(1.0::DOUBLE / 14)", "(2.0::DOUBLE / 13)", "(2.0::DOUBLE / 27)", "(2.0::DOUBLE / 10)"
_feature("ewm", f"WITH RECURSIVE {OWN}, {ema('own', 'close', A12, 'e')} SELECT instrument_id, trade_date, {fl('CASE WHEN bar_idx >= 12 THEN y END', 4)} AS ema_12 FROM own JOIN e USING (instrument_id, bar_idx)",
         lambda df, spark, sf: X.ewm(df, "close", "ema_12", 2 / 13, 12).withColumn("ema_12", rnd("ema_12", 4)), "ema_12")
_feature("atr", f"WITH RECURSIVE {_TR}, {ema('tr_', 'tr', A14, 'e')} SELECT instrument_id, trade_date, {fl('CASE WHEN bar_idx >= 14 THEN y END', 4)} AS atr FROM tr_ JOIN e USING (instrument_id, bar_idx)",
         lambda df, spark, sf: X.atr_pct(df).withColumn("atr", rnd("atr", 4)), "atr")
_feature("feat_atr_pct", f"WITH RECURSIVE {_TR}, {ema('tr_', 'tr', A14, 'e')} SELECT instrument_id, trade_date, {fl('CASE WHEN bar_idx >= 14 THEN y / close END')} AS atr_pct FROM tr_ JOIN e USING (instrument_id, bar_idx)",
         lambda df, spark, sf: X.atr_pct(df), "atr_pct")
_feature("feat_rsi", f"""WITH RECURSIVE {OWN}, st AS (SELECT *, close - lag(close) OVER w AS d FROM own {W}), gl AS (SELECT *, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM st),
{ema('gl', 'g', A14, 'u', 2)}, {ema('gl', 'l', A14, 'v', 2)}
SELECT o.instrument_id, o.trade_date, CASE WHEN o.bar_idx >= 15 THEN {fl('CASE WHEN v.y = 0 AND u.y = 0 THEN 50 WHEN v.y = 0 THEN 100 ELSE 100 - 100 / (1 + u.y / v.y) END', 4)} END AS rsi
FROM own o LEFT JOIN u USING (instrument_id, bar_idx) LEFT JOIN v USING (instrument_id, bar_idx)""", lambda df, spark, sf: X.rsi(df).withColumn("rsi", rnd("rsi", 4)), "rsi")
_feature("feat_macd", f"""WITH RECURSIVE {OWN}, {ema('own', 'close', A12, 'f')}, {ema('own', 'close', A26, 's')},
ln_ AS (SELECT o.instrument_id, o.trade_date, o.bar_idx, o.close, CASE WHEN o.bar_idx >= 26 THEN f.y - s.y END AS line FROM own o JOIN f USING (instrument_id, bar_idx) JOIN s USING (instrument_id, bar_idx)),
{ema('ln_', 'line', A9, 'g', 26)}
SELECT l.instrument_id, l.trade_date, {fl('line / close')} AS macd, {fl('CASE WHEN l.bar_idx >= 34 THEN (line - g.y) / close END')} AS macd_hist FROM ln_ l LEFT JOIN g USING (instrument_id, bar_idx)""",
         lambda df, spark, sf: X.macd(df), "macd", "macd_hist")
_OB = OWN + "," + P.BENCH + f", ob AS (SELECT own.*, bench.close AS b FROM own LEFT JOIN bench USING (trade_date))"
_feature("feat_rel_strength", f"WITH {_OB} SELECT instrument_id, trade_date, " + ", ".join(fl(f"(close / lag(close, {n}) OVER w - 1) - (b / lag(b, {n}) OVER w - 1)") + f" AS rel_strength_{n}" for n in (5, 10)) + f" FROM ob {W}",
         lambda df, spark, sf: X.rel_strength(X.rel_strength(df, P.bench(spark, sf), 5), P.bench(spark, sf), 10), "rel_strength_5", "rel_strength_10")
_DB = "OVER (PARTITION BY instrument_id ORDER BY bar_idx ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)"
_feature("feat_downside_beta", f"""WITH {_OB}, fb AS (SELECT *, last_value(b IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS fb FROM ob),
dr AS (SELECT *, close / lag(close) OVER w - 1 AS r, fb / lag(fb) OVER w - 1 AS m FROM fb {W}), dm AS (SELECT *, CASE WHEN m < 0 AND r IS NOT NULL THEN m END AS dm, CASE WHEN m < 0 THEN r END AS dr FROM dr)
SELECT instrument_id, trade_date, CASE WHEN count(r) {_DB} = 126 AND count(dm) {_DB} >= 20 AND var_pop(dm) {_DB} > 1e-14 THEN {fl(f'covar_pop(dr, dm) {_DB} / var_pop(dm) {_DB}', 5)} END AS downside_beta FROM dm""",
         lambda df, spark, sf: X.downside_beta(df, P.bench(spark, sf)).withColumn("downside_beta", rnd("downside_beta", 5)), "downside_beta")


@query("feature_frame", f"WITH {OWN} SELECT instrument_id, trade_date, {fl('close / lag(close, 5) OVER w - 1')} AS ret_5, {fl('open / lag(close) OVER w - 1')} AS gap, {fl('close / ' + full('avg(close)', 200) + ' - 1')} AS sma_ratio FROM own {W}")
def feature_frame(spark, sf):
    return _out(X.feature_frame(P.own_bars(spark, sf), [("ret_5", 1), ("gap", 1), ("sma_ratio", 1)]), "ret_5", "gap", "sma_ratio")


CS = "CASE WHEN {x} IS NOT NULL AND count({x}) OVER (PARTITION BY trade_date) >= {n} THEN (rank() OVER (PARTITION BY trade_date ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY trade_date, {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER (PARTITION BY trade_date) END"
_RETS = OWN + f", fr AS (SELECT *, {fl('close / lag(close, 5) OVER w - 1')} AS ret_5 FROM own {W})"


def _ret5(spark, sf):
    return X.ret(P.own_bars(spark, sf), 5).withColumn("ret_5", rnd("ret_5"))


@query("cs_rank", f"WITH {_RETS} SELECT instrument_id, trade_date, {fl(CS.format(x='ret_5', n=8))} AS ret_5_rank FROM fr")
def cs_rank(spark, sf):
    return _out(X.cs_rank(_ret5(spark, sf), "ret_5", "ret_5_rank", 8), "ret_5_rank")


@query("fundamentals_asof", f"""WITH {P.BARS}, pub AS (SELECT instrument_id, trade_date + 45 AS published, volume AS book, n_trades::DOUBLE AS quality FROM bars WHERE day(trade_date) = 1)
SELECT b.instrument_id, b.trade_date, p.book, p.quality FROM bars b ASOF LEFT JOIN pub p ON b.instrument_id = p.instrument_id AND b.trade_date >= p.published""")
def fundamentals_asof(spark, sf):
    b = P.bars(spark, sf)
    pub = b.where(F.dayofmonth("trade_date") == 1).select("instrument_id", F.date_add("trade_date", 45).alias("published"), F.col("volume").alias("book"), F.col("n_trades").cast("double").alias("quality"))
    return X.known_fundamentals(b, pub, ["book", "quality"])


# panel preparation

GRID = P.BARS_CAL + """,
grid AS (SELECT i.instrument_id, c.trade_date, c.session_idx, b.open, b.high, b.low, b.close, b.volume
         FROM cal c CROSS JOIN (SELECT DISTINCT instrument_id FROM bars) i LEFT JOIN bars b ON b.instrument_id = i.instrument_id AND b.trade_date = c.trade_date)"""
GW = "WINDOW g AS (PARTITION BY instrument_id ORDER BY session_idx)"


def grid(spark, sf):
    return X.densify(P.bars(spark, sf), P.calendar(spark, sf)).select("instrument_id", "trade_date", "session_idx", "open", "high", "low", "close", "volume")


@query("panel_densify", f"WITH {GRID} SELECT instrument_id, trade_date, session_idx, close, volume FROM grid")
def panel_densify(spark, sf):
    return grid(spark, sf).select("instrument_id", "trade_date", "session_idx", "close", "volume")


@query("repair_ohlc", f"""WITH {P.DIRTY}, e AS (SELECT *, least(open, high, low, close) <= 0 AS bad FROM dirty), f AS (SELECT instrument_id, trade_date, open, CASE WHEN NOT bad THEN greatest(high, close, low) END AS h,
CASE WHEN NOT bad THEN least(low, close, high) END AS l, CASE WHEN NOT bad THEN close END AS c, bad OR greatest(high, close, low) <> high OR least(low, close, high) <> low AS repaired FROM e)
SELECT instrument_id, trade_date, CASE WHEN open BETWEEN l AND h THEN open END AS open, h AS high, l AS low, c AS close, repaired FROM f""")
def repair_ohlc(spark, sf):
    from barloom.operators.quality import repaired

    return repaired(P.bars_dirty(spark, sf)).select("instrument_id", "trade_date", "open", "high", "low", "close", "repaired")


_BG = P.BARS_CAL + "," + P.BENCH + ", hole AS (SELECT * FROM bench WHERE day(trade_date) NOT BETWEEN 10 AND 16)"


@query("bench_ffill", f"""WITH {_BG} SELECT trade_date, last_value(close IGNORE NULLS) OVER (ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS close FROM cal LEFT JOIN hole USING (trade_date)""")
def bench_ffill(spark, sf):
    rows = P.calendar(spark, sf).join(P.bench(spark, sf).where("dayofmonth(trade_date) not between 10 and 16"), "trade_date", "left")
    w = Window.orderBy("trade_date").rowsBetween(-5, 0)  # one row per date
    return rows.select("trade_date", F.last("close", ignorenulls=True).over(w).alias("close"))


@query("bench_splice", f"""WITH {P.BARS}, {P.BENCH}, f AS (SELECT trade_date AS d, close AS c FROM bench ORDER BY trade_date LIMIT 1), r AS (SELECT d, c / fallback.close AS k FROM f JOIN fallback ON trade_date = d)
SELECT coalesce(b.trade_date, x.trade_date) AS trade_date, {fl('CASE WHEN x.trade_date < r.d THEN x.close * r.k ELSE b.close END', 4)} AS close FROM fallback x FULL JOIN bench b ON b.trade_date = x.trade_date, r""")
def bench_splice(spark, sf):
    main, spare = P.bench(spark, sf), P.bench_fallback(spark, sf)
    first = main.agg(F.min("trade_date").alias("d"), F.min_by("close", "trade_date").alias("c")).join(spare.withColumnsRenamed({"trade_date": "d", "close": "x"}), "d").select("d", (F.col("c") / F.col("x")).alias("k"))
    both = spare.select("trade_date", F.col("close").alias("spare")).join(main, "trade_date", "full").crossJoin(F.broadcast(first))  # one row
    return both.select("trade_date", rnd(F.when(F.col("trade_date") < F.col("d"), F.col("spare") * F.col("k")).otherwise(F.col("close")), 4).alias("close"))


@query("bench_info", f"WITH {_BG} SELECT min(trade_date) FILTER (close IS NOT NULL) AS first_date, {fl('count(close) / count(*)')} AS coverage FROM cal LEFT JOIN hole USING (trade_date)")
def bench_info(spark, sf):
    rows = P.calendar(spark, sf).join(P.bench(spark, sf).where("dayofmonth(trade_date) not between 10 and 16"), "trade_date", "left")
    return rows.agg(F.min(F.when(F.col("close").isNotNull(), F.col("trade_date"))).alias("first_date"), rnd(F.count("close") / F.count("*")).alias("coverage"))


@query("panel_truncate", f"WITH {GRID} SELECT instrument_id, trade_date, close FROM grid WHERE trade_date <= DATE '1998-12-31'")
def panel_truncate(spark, sf):
    return grid(spark, sf).where("trade_date <= date'1998-12-31'").select("instrument_id", "trade_date", "close")


@query("own_bar_rows", f"WITH {GRID} SELECT instrument_id, trade_date, row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date) AS bar_idx FROM grid WHERE close IS NOT NULL")
def own_bar_rows(spark, sf):
    return X.numbered(grid(spark, sf).where("close is not null")).select("instrument_id", "trade_date", "bar_idx")


# labels and datasets


@query("label_fwd_return", f"WITH {GRID} SELECT instrument_id, trade_date, {fl('lead(close, 5) OVER g / close - 1')} AS fwd_ret_5, lead(trade_date, 5) OVER g AS fwd_end_5 FROM grid {GW}")
def label_fwd_return(spark, sf):
    return X.forward_return(grid(spark, sf), 5).select("instrument_id", "trade_date", rnd("fwd_ret_5").alias("fwd_ret_5"), "fwd_end_5")


@query("label_fwd_rank", f"WITH {GRID}, f AS (SELECT instrument_id, trade_date, {fl('lead(close, 5) OVER g / close - 1')} AS x FROM grid {GW}) SELECT instrument_id, trade_date, {fl(CS.format(x='x', n=8))} AS fwd_rank_5 FROM f")
def label_fwd_rank(spark, sf):
    rows = X.forward_return(grid(spark, sf), 5).withColumn("fwd_ret_5", rnd("fwd_ret_5"))
    return X.cs_rank(rows, "fwd_ret_5", "fwd_rank_5", 8).select("instrument_id", "trade_date", rnd("fwd_rank_5").alias("fwd_rank_5"))


def _barrier_sql(stop: str, target: str, h: int) -> str:
    return f"""WITH {GRID}, gr AS (SELECT *, {fl(f'CASE WHEN count(close) OVER b = 20 THEN avg(high - low) OVER b END', 4)} AS rg FROM grid WINDOW b AS (PARTITION BY instrument_id ORDER BY session_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
t AS (SELECT instrument_id, session_idx, trade_date, close, close - {stop} * rg AS dn, close + {target} * rg AS up, lead(session_idx, {h}) OVER g AS fit, lead(close, {h}) OVER g AS lc, lead(trade_date, {h}) OVER g AS ld FROM gr {GW}),
hit AS (SELECT t.instrument_id, t.session_idx, x.session_idx AS k, x.open, x.low, x.trade_date AS hd FROM t JOIN gr x ON x.instrument_id = t.instrument_id AND x.session_idx BETWEEN t.session_idx + 1 AND t.session_idx + {h} AND (x.low <= t.dn OR x.high >= t.up)
  QUALIFY row_number() OVER (PARTITION BY t.instrument_id, t.session_idx ORDER BY x.session_idx) = 1),
j AS (SELECT t.*, hit.k, hit.open AS ho, hit.low AS hl, hd, fit IS NOT NULL AND dn IS NOT NULL AND (hit.k IS NOT NULL OR lc IS NOT NULL) AS ok FROM t LEFT JOIN hit USING (instrument_id, session_idx))
SELECT instrument_id, trade_date, CASE WHEN ok THEN CASE WHEN k IS NULL THEN 0 WHEN hl <= dn THEN -1 ELSE 1 END END AS tb_label, CAST(CASE WHEN ok THEN coalesce(k - session_idx, {h}) END AS BIGINT) AS tb_time,
{fl('CASE WHEN ok THEN (CASE WHEN k IS NULL THEN lc WHEN hl <= dn THEN least(ho, dn) ELSE greatest(ho, up) END) / close - 1 END', 5)} AS tb_ret, CASE WHEN ok THEN coalesce(hd, ld) END AS tb_end FROM j"""


def _barrier(spark, sf, stop, target, h):
    g = grid(spark, sf)
    frame = sessions().rowsBetween(-19, 0)
    g = g.withColumn("rg", rnd(F.when(F.count("close").over(frame) == 20, F.avg(F.col("high") - F.col("low")).over(frame)), 4))
    return X.triple_barrier(g, "rg", stop, target, h).select("instrument_id", "trade_date", "tb_label", F.col("tb_time").cast("bigint").alias("tb_time"), rnd("tb_ret", 5).alias("tb_ret"), "tb_end")


@query("label_triple_barrier", _barrier_sql("0.25::DOUBLE", "0.5::DOUBLE", 10))
def label_triple_barrier(spark, sf):
    return _barrier(spark, sf, 0.25, 0.5, 10)


@query("barrier_1_1", _barrier_sql("1.0::DOUBLE", "1.0::DOUBLE", 5))
def barrier_1_1(spark, sf):
    return _barrier(spark, sf, 1.0, 1.0, 5)


MEMBER = "EXISTS (SELECT 1 FROM membership m WHERE m.universe = 'WIDE' AND m.instrument_id = grid.instrument_id AND grid.trade_date >= m.valid_from AND (m.valid_to IS NULL OR grid.trade_date < m.valid_to))"
DATASET = GRID + "," + P.MARKET + f""",
ft AS (SELECT instrument_id, trade_date, session_idx, close, {MEMBER} AS is_member, {fl('close / lag(close, 5) OVER g - 1')} AS f_ret_5, {fl('lead(close, 5) OVER g / close - 1')} AS fwd_ret_5, lead(trade_date, 5) OVER g AS fwd_end_5,
  count(close) OVER (PARTITION BY instrument_id ORDER BY session_idx ROWS UNBOUNDED PRECEDING) AS n FROM grid {GW}),
ds_ AS (SELECT trade_date, instrument_id, f_ret_5, fwd_ret_5, fwd_end_5 FROM ft WHERE is_member AND close IS NOT NULL AND n >= 20 AND trade_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31')"""


def dataset(spark, sf):
    """Members with a bar and 20 own bars, 1996 to 2000: a five-session feature and its forward label."""
    from barloom.operators.universe import membership_daily

    g = grid(spark, sf)
    member = membership_daily(P.membership(spark, sf).where("universe = 'WIDE'"), P.calendar(spark, sf))
    g = g.join(member, ["instrument_id", "trade_date"], "left").withColumn("is_member", F.coalesce("is_member", F.lit(False)))
    g = g.withColumn("f_ret_5", rnd(change("close", 5, sessions())))
    g = X.forward_return(g, 5).withColumn("fwd_ret_5", rnd("fwd_ret_5"))
    return X.assemble(g, ["f_ret_5", "fwd_ret_5", "fwd_end_5"], 20, "1996-01-01", "2000-12-31")


@query("dataset_assemble", f"WITH {DATASET} SELECT * FROM ds_")
def dataset_assemble(spark, sf):
    return dataset(spark, sf)


@query("warmup", f"WITH {OWN} SELECT instrument_id, count(*) FILTER (bar_idx > 252) AS n_warm FROM own GROUP BY 1")
def warmup(spark, sf):
    need = X.warmup([("ret_5", 1), ("drawdown", 1), ("rsi", 1)])
    return P.own_bars(spark, sf).groupBy("instrument_id").agg(F.count_if(F.col("bar_idx") > need).alias("n_warm"))


@query("audit_no_lookahead", "SELECT * FROM (VALUES ('gap', 0::BIGINT, NULL::DATE), ('ret_5', 0, NULL), ('zscore', 0, NULL)) t(\"column\", n_off, first_off)")
def audit_no_lookahead(spark, sf):
    make = lambda df: X.feature_frame(df, [("ret_5", 1), ("zscore", 1), ("gap", 1)])
    b = P.own_bars(spark, sf)
    return X.audit(make(b), make(b.where("trade_date <= date'1998-06-30'")), ["ret_5", "zscore", "gap"], "1998-06-30")


@query("audit_label_horizon", f"""WITH {GRID}, x AS (SELECT trade_date FROM cal ORDER BY trade_date DESC LIMIT 1 OFFSET 200)
SELECT 'fwd_ret_5' AS "column", count(*) FILTER (a IS NOT NULL) AS n_off, min(trade_date) FILTER (a IS NOT NULL) AS first_off FROM (
 SELECT g.trade_date, lead(close, 5) OVER (PARTITION BY instrument_id ORDER BY session_idx) / close AS a, session_idx FROM grid g)
WHERE session_idx <= (SELECT max(session_idx) FROM cal) - 200 AND session_idx > (SELECT max(session_idx) FROM cal) - 205""")
def audit_label_horizon(spark, sf):
    g = grid(spark, sf)
    last = P.calendar(spark, sf).agg((F.max("session_idx") - 200).alias("cut"))
    cut = g.join(F.broadcast(last), F.col("session_idx") <= F.col("cut")).drop("cut")  # one row
    until = cut.agg(F.max("trade_date")).first()[0]
    # the last five sessions before the cut lose their labels and none before them
    return X.audit(X.forward_return(g, 5), X.forward_return(cut, 5), ["fwd_ret_5"], str(until or "1900-01-01"))


@query("audit_cut_dates", f"""WITH {P.BARS_CAL}, n AS (SELECT max(session_idx) AS n FROM cal) SELECT trade_date FROM cal, n WHERE session_idx IN (SELECT CAST(floor(0.25 * n) AS BIGINT) + CAST(floor(k * 0.5 * n / 4) AS BIGINT) FROM n, range(0, 5) t(k))""")
def audit_cut_dates(spark, sf):
    cal = P.calendar(spark, sf)
    n = cal.agg(F.max("session_idx").alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    at = n.select((F.floor(F.col("n") * 0.25) + F.floor(F.col("k") * 0.5 * F.col("n") / 4)).alias("session_idx")).distinct()
    return cal.join(at, "session_idx", "left_semi").select("trade_date")
