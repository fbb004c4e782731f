"""Portfolio construction and trade evaluation as registered queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.columns import change, own, rnd, sessions
from barloom.operators import metrics as M
from barloom.operators import portfolio as T
from barloom.plans.feature_queries import GRID, GW, fl, grid
from barloom.plans.metric_queries import _AUC, DONE, PRED, _round, done, predictions
from barloom.plans.registry import query
from barloom.sources import panel as P

_CALS = P.BARS_CAL


@query("rebalance_sessions", f"""WITH {_CALS} SELECT 'week' AS period, min(session_idx) AS session_idx, min(trade_date) AS trade_date FROM cal GROUP BY isoyear(trade_date), weekofyear(trade_date) UNION ALL
SELECT 'month', min(session_idx), min(trade_date) FROM cal GROUP BY year(trade_date), month(trade_date) UNION ALL SELECT 'quarter', min(session_idx), min(trade_date) FROM cal GROUP BY year(trade_date), quarter(trade_date)""")
def rebalance_sessions(spark, sf):
    out = None
    for p in ("week", "month", "quarter"):
        rows = T.rebalance_sessions(P.calendar(spark, sf), p).select(F.lit(p).alias("period"), "session_idx", "trade_date")
        out = rows if out is None else out.unionByName(rows)
    return out


_TOP = DONE + ", tp AS (SELECT instrument_id, trade_date, score, proba, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, instrument_id) AS rank FROM dn WHERE model_id = 'A' QUALIFY rank <= 5)"


def best(spark, sf):
    return T.top_k(done(spark, sf).where("model_id = 'A'"), "score", 5)


@query("top_k", f"WITH {_TOP} SELECT instrument_id, trade_date, rank FROM tp")
def top_k(spark, sf):
    return best(spark, sf).select("instrument_id", "trade_date", F.col("rank").cast("bigint").alias("rank"))


@query("weights_equal", f"WITH {_TOP} SELECT instrument_id, trade_date, {fl('1.0::DOUBLE / count(*) OVER (PARTITION BY trade_date)')} AS weight FROM tp")
def weights_equal(spark, sf):
    return _round(T.equal_weights(best(spark, sf)), ("instrument_id", "trade_date"), "weight")


_VOL = "CASE WHEN abs(score) > 0.02 THEN abs(score) END"


@query("weights_inverse_vol", f"""WITH {_TOP}, v AS (SELECT *, {_VOL} AS vol FROM tp) SELECT instrument_id, trade_date, {fl('CASE WHEN count(vol) OVER d < count(*) OVER d THEN 1.0::DOUBLE / count(*) OVER d ELSE (1 / vol) / sum(1 / vol) OVER d END')} AS weight FROM v WINDOW d AS (PARTITION BY trade_date)""")
def weights_inverse_vol(spark, sf):
    rows = best(spark, sf).withColumn("vol", F.when(F.abs("score") > 0.02, F.abs("score")))
    return _round(T.inverse_volatility_weights(rows, "vol"), ("instrument_id", "trade_date"), "weight")


_CAPPED = f"""{_TOP}, w0 AS (SELECT instrument_id, trade_date, (abs(score) + 0.01) / sum(abs(score) + 0.01) OVER (PARTITION BY trade_date) AS w FROM tp),
it(k, instrument_id, trade_date, w, x, full_) AS (SELECT 0, instrument_id, trade_date, w, w, false FROM w0 UNION ALL
 SELECT k + 1, instrument_id, trade_date, w, CASE WHEN full_ OR x > 0.3 THEN 0.3::DOUBLE ELSE x + coalesce(sum(CASE WHEN x > 0.3 THEN x - 0.3 ELSE 0 END) OVER d * x / nullif(sum(CASE WHEN NOT full_ AND x <= 0.3 AND x < 0.3 THEN x ELSE 0 END) OVER d, 0), 0) END, full_ OR x > 0.3 FROM it WHERE k < 12 WINDOW d AS (PARTITION BY trade_date))"""


@query("weight_cap", f"WITH RECURSIVE {_CAPPED} SELECT instrument_id, trade_date, {fl('x')} AS weight FROM it WHERE k = 12")
def weight_cap(spark, sf):
    rows = best(spark, sf)
    raw = F.abs("score") + 0.01
    rows = rows.withColumn("weight", raw / F.sum(raw).over(Window.partitionBy("trade_date")))
    return T.capped_weights(rows, 0.3).select("instrument_id", "trade_date", rnd("capped").alias("weight"))


@query("prob_filter", f"WITH {DONE} SELECT model_id, instrument_id, trade_date, CASE WHEN proba >= 1.02 * 0.5 THEN score END AS score FROM dn")
def prob_filter(spark, sf):
    return T.prob_filter(done(spark, sf), "score", "proba", 1.02, 0.5).select("model_id", "instrument_id", "trade_date", "score")


@query("topk_targets", f"WITH {_TOP} SELECT trade_date, instrument_id, 0.2::DOUBLE AS weight, {fl('1 - count(*) OVER (PARTITION BY trade_date) * 0.2::DOUBLE')} AS cash FROM tp")
def topk_targets(spark, sf):
    """A fifth for each of five names; what fewer names leave is cash."""
    held = F.count("*").over(Window.partitionBy("trade_date")) * 0.2
    return best(spark, sf).select("trade_date", "instrument_id", F.lit(0.2).alias("weight"), rnd(1 - held).alias("cash"))


@query("baseline_scores", f"""WITH {DONE}, r AS (SELECT instrument_id, trade_date, rank() OVER (PARTITION BY trade_date ORDER BY score) AS a, rank() OVER (PARTITION BY trade_date ORDER BY holding) AS b, count(*) OVER (PARTITION BY trade_date) AS n FROM dn WHERE model_id = 'A') SELECT instrument_id, trade_date, {fl('(a + b) / (2.0::DOUBLE * n)')} AS mean_rank, 1.0::DOUBLE AS constant, CAST(('0x' || substr(md5('17-' || trade_date || '-' || instrument_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS random FROM r""")
def baseline_scores(spark, sf):
    d = Window.partitionBy("trade_date")
    rows = done(spark, sf).where("model_id = 'A'")
    return rows.select("instrument_id", "trade_date", rnd((F.rank().over(d.orderBy("score")) + F.rank().over(d.orderBy("holding"))) / (2.0 * F.count("*").over(d))).alias("mean_rank"), F.lit(1.0).alias("constant"), T.seeded_random(17, "trade_date", "instrument_id").alias("random"))


@query("rebalance_targets", f"""WITH {_CALS}, m AS (SELECT min(trade_date) AS trade_date FROM cal GROUP BY year(trade_date), month(trade_date)), own AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date) AS bar_idx FROM bars), s AS (SELECT instrument_id, trade_date, {fl('close / lag(close, 5) OVER w - 1')} AS score FROM own WINDOW w AS (PARTITION BY instrument_id ORDER BY bar_idx))
SELECT instrument_id, trade_date, 0.25::DOUBLE AS weight FROM s SEMI JOIN m USING (trade_date) WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, instrument_id) <= 4""")
def rebalance_targets(spark, sf):
    days = T.rebalance_sessions(P.calendar(spark, sf), "month").select("trade_date")
    rows = P.own_bars(spark, sf).withColumn("score", rnd(change("close", 5))).join(F.broadcast(days), "trade_date")  # one row per month
    return T.top_k(rows, "score", 4).select("instrument_id", "trade_date", F.lit(0.25).alias("weight"))


@query("tranche_targets", f"""WITH RECURSIVE {_TOP}, {P.CAL}, rb AS (SELECT min(session_idx) AS session_idx, min(trade_date) AS trade_date FROM cal GROUP BY year(trade_date), month(trade_date)),
tg AS (SELECT session_idx, instrument_id, 0.2::DOUBLE AS weight FROM tp JOIN rb USING (trade_date)), rs AS (SELECT session_idx, row_number() OVER o AS n, coalesce(lead(session_idx) OVER o, (SELECT max(session_idx) + 1 FROM cal)) AS stop FROM rb WINDOW o AS (ORDER BY session_idx)),
rd AS (SELECT n, session_idx, CASE WHEN session_idx IN (SELECT session_idx FROM tg) THEN least(3, (stop - 1 - session_idx) // 8 + 1) ELSE 0 END AS done FROM rs),
gd AS (SELECT n, rd.session_idx, done, i.instrument_id, coalesce(weight, 0) AS t FROM rd CROSS JOIN (SELECT DISTINCT instrument_id FROM tg) i LEFT JOIN tg ON tg.session_idx = rd.session_idx AND tg.instrument_id = i.instrument_id),
ph(n, session_idx, done, instrument_id, t, before, held) AS (SELECT n, session_idx, done, instrument_id, t, 0.0::DOUBLE, t * done / 3 FROM gd WHERE n = 1
 UNION ALL SELECT gd.n, gd.session_idx, gd.done, gd.instrument_id, gd.t, ph.held, ph.held + (gd.t - ph.held) * gd.done / 3 FROM ph JOIN gd ON gd.n = ph.n + 1 AND gd.instrument_id = ph.instrument_id),
st AS (SELECT session_idx + (k - 1) * 8 AS session_idx, instrument_id, before + (t - before) * k / 3 AS w FROM ph JOIN range(1, 4) r(k) ON k <= done WHERE before > 1e-9 OR t > 0) SELECT session_idx, instrument_id, {fl('w')} AS weight FROM st WHERE w > 1e-9""")
def tranche_targets(spark, sf):
    """Three steps, eight sessions apart, towards the five best names of each month's first session; the third is often dropped."""
    cal = P.calendar(spark, sf)
    months = T.rebalance_sessions(cal, "month")
    t = best(spark, sf).join(F.broadcast(months), "trade_date").select("session_idx", "instrument_id", F.lit(0.2).alias("weight"))  # one row per month
    return _round(T.tranches(t, months.select("session_idx"), cal.agg(F.max("session_idx").alias("session_idx")), 3, 8), ("session_idx", "instrument_id"), "weight")


@query("regime_off", f"""WITH {P.BARS}, {P.BENCH}, s AS (SELECT trade_date, close, CASE WHEN count(*) OVER w = 200 THEN avg(close) OVER w END AS m FROM bench WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)) SELECT trade_date, coalesce(close < m, false) AS off FROM s""")
def regime_off(spark, sf):
    w = Window.orderBy("trade_date").rowsBetween(-199, 0)  # one row per date
    rows = P.bench(spark, sf).withColumn("m", F.when(F.count("*").over(w) == 200, F.avg("close").over(w)))
    return rows.select("trade_date", F.coalesce(F.col("close") < F.col("m"), F.lit(False)).alias("off"))


@query("infer_bands", f"""WITH {GRID}, m AS (SELECT *, abs(close / nullif(lag(close) OVER g, 0) - 1) AS mv FROM grid {GW}), x AS (SELECT *, max(mv) OVER (PARTITION BY instrument_id ORDER BY session_idx ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) - 0.005 AS mx FROM m)
SELECT instrument_id, session_idx, CASE WHEN mx IS NULL THEN NULL WHEN mx <= 0.5 THEN 0.5::DOUBLE WHEN mx <= 2 THEN 2.0 ELSE 9.0 END AS band FROM x""")
def infer_bands(spark, sf):
    return T.inferred_band(grid(spark, sf), (0.5, 2.0, 9.0)).select("instrument_id", "session_idx", "band")


@query("tick_round", f"WITH {P.BARS}, t AS (SELECT instrument_id, trade_date, close / 100 AS p FROM bars), k AS (SELECT *, CASE WHEN p < 10 THEN 0.01::DOUBLE WHEN p < 50 THEN 0.05 ELSE 0.1 END AS t FROM t) SELECT instrument_id, trade_date, {fl('ceil(p / t - 1e-9) * t')} AS up, {fl('floor(p / t + 1e-9) * t')} AS down FROM k")
def tick_round(spark, sf):
    p = F.col("close") / 100
    return P.bars(spark, sf).withColumn("p", p).select("instrument_id", "trade_date", rnd(T.tick_round("p", True)).alias("up"), rnd(T.tick_round("p", False)).alias("down"))


@query("trade_costs", f"WITH {P.BARS}, s AS (SELECT *, CASE WHEN n_trades % 2 = 0 THEN 'sell' ELSE 'buy' END AS side FROM bars) SELECT instrument_id, trade_date, side, m AS multiplier, {fl('volume * close * (0.0015 + 0.0005 + CASE WHEN side = $$sell$$ THEN 0.001 ELSE 0 END) * m', 4)} AS cost FROM s, (SELECT unnest([1.0::DOUBLE, 2.0]) AS m)")
def trade_costs(spark, sf):
    rows = P.bars(spark, sf).withColumn("side", F.when(F.col("n_trades") % 2 == 0, "sell").otherwise("buy")).withColumn("multiplier", F.explode(F.array(F.lit(1.0), F.lit(2.0))))
    return rows.select("instrument_id", "trade_date", "side", "multiplier", rnd(T.trade_cost(F.col("side"), F.col("volume"), F.col("close"), times=F.col("multiplier")), 4).alias("cost"))


@query("lot_size", f"WITH {P.BARS} SELECT instrument_id, trade_date, CAST(floor(1000000 / (close * 100)) * 100 AS BIGINT) AS quantity FROM bars")
def lot_size(spark, sf):
    return P.bars(spark, sf).select("instrument_id", "trade_date", T.lots(F.lit(1000000.0), F.col("close")).cast("bigint").alias("quantity"))


# orders: every 15th session of an instrument, kind by id

def _tk(x: str) -> str:
    return f"(CASE WHEN {x} < 10 THEN 0.01::DOUBLE WHEN {x} < 50 THEN 0.05 ELSE 0.1 END)"


def _dn(x: str) -> str:
    return f"(floor(({x}) / {_tk(x)} + 1e-9) * {_tk(x)})"


def _up(x: str) -> str:
    return f"(ceil(({x}) / {_tk(x)} - 1e-9) * {_tk(x)})"


def _near(x: str) -> str:
    return f"(floor(({x}) / {_tk(x)} + 0.5) * {_tk(x)})"


_MKT = GRID + "," + P.MARKET + f""",
rf0 AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY session_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ref FROM grid),
mkt AS (SELECT g.instrument_id, session_idx, open, high, low, close, coalesce(high = low AND high >= {_dn('ref * 1.3::DOUBLE')}, false) AS up_locked, coalesce(high = low AND low <= {_up('ref * 0.7::DOUBLE')}, false) AS down_locked,
 EXISTS (SELECT 1 FROM statuses s WHERE s.status = 'suspended' AND s.instrument_id = g.instrument_id AND g.trade_date >= s.valid_from AND g.trade_date < s.valid_to) AS suspended FROM rf0 g)"""

_ORD = _MKT + """,
od AS (SELECT instrument_id * 100000 + session_idx AS order_id, instrument_id, session_idx + 1 AS first, session_idx + 3 AS last, ['open', 'limit', 'stop', 'zone'][instrument_id % 4 + 1] AS kind,
 floor(close * 0.9 * 10000.0 + 0.5) / 10000.0 AS low, floor(close * 1.05 * 10000.0 + 0.5) / 10000.0 AS high, floor(close * 1.4 * 10000.0 + 0.5) / 10000.0 AS cap, close FROM grid WHERE close IS NOT NULL AND session_idx % 15 = 0),
se AS (SELECT o.*, g.session_idx, CASE WHEN NOT suspended THEN g.open END AS open, g.high AS bh, g.low AS bl, suspended, up_locked FROM od o LEFT JOIN mkt g ON g.instrument_id = o.instrument_id AND g.session_idx BETWEEN o.first AND o.last AND (g.open IS NOT NULL OR suspended)),
pr_ AS (SELECT *, CASE WHEN open <= cap AND NOT up_locked THEN CASE WHEN kind = 'open' THEN open WHEN kind = 'limit' AND bl <= high THEN least(open, high) WHEN kind = 'stop' AND bh >= low THEN greatest(open, low) WHEN kind = 'zone' AND open BETWEEN low AND high THEN open END END AS price FROM se),
ag AS (SELECT order_id, instrument_id, arg_min(row(session_idx, price), session_idx) FILTER (price IS NOT NULL) AS f, bool_or(coalesce(session_idx = first AND open > cap, false)) AS gone, count(open) AS n, count(*) FILTER (suspended) AS halts, count(*) FILTER (open IS NOT NULL AND up_locked) AS locks FROM pr_ GROUP BY 1, 2),
fills AS (SELECT order_id, instrument_id, CASE WHEN f IS NOT NULL AND NOT gone THEN f[1] END AS session_idx, CASE WHEN f IS NOT NULL AND NOT gone THEN f[2] END AS price,
 CASE WHEN gone THEN 'cancelled: opened above cap' WHEN n = 0 AND halts > 0 THEN 'suspended' WHEN n = 0 THEN 'no bar' WHEN f IS NULL AND locks = n THEN 'locked at the ceiling' WHEN f IS NULL THEN 'expired' END AS reason FROM ag)"""


def orders(spark, sf):
    g = grid(spark, sf).where("close is not null and session_idx % 15 = 0")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("open", "limit", "stop", "zone")]), (F.col("instrument_id") % 4 + 1).cast("int"))
    return g.select((F.col("instrument_id") * 100000 + F.col("session_idx")).alias("order_id"), "instrument_id", (F.col("session_idx") + 1).alias("first"), (F.col("session_idx") + 3).alias("last"), kind.alias("kind"), *[rnd(F.col("close") * k, 4).alias(c) for c, k in (("low", 0.9), ("high", 1.05), ("cap", 1.4))])


def market(spark, sf):
    return T.market_conditions(grid(spark, sf), P.status_history(spark, sf), 0.3)


def fills(spark, sf):
    return T.entry_fills(orders(spark, sf), market(spark, sf))


@query("entry_fill", f"WITH {_ORD} SELECT order_id, session_idx, price, reason FROM fills")
def entry_fill(spark, sf):
    return fills(spark, sf).select("order_id", "session_idx", "price", "reason")


@query("order_stats", f"WITH {_ORD} SELECT coalesce(reason, 'filled') AS outcome, count(*) AS n FROM fills GROUP BY 1")
def order_stats(spark, sf):
    return fills(spark, sf).groupBy(F.coalesce("reason", F.lit("filled")).alias("outcome")).agg(F.count("*").alias("n"))


_EXIT = _ORD + """,
tr2 AS (SELECT order_id AS trade_id, instrument_id, session_idx AS entry, price, floor(price * 0.6 * 10000.0 + 0.5) / 10000.0 AS stop, floor(price * 1.5 * 10000.0 + 0.5) / 10000.0 AS target FROM fills WHERE price IS NOT NULL),
ev AS (SELECT t.*, g.session_idx, CASE WHEN g.open <= stop THEN row(g.open, 'stop gap') WHEN g.open >= target THEN row(g.open, 'target gap') WHEN g.low <= stop THEN row(stop, 'stop') WHEN g.high >= target THEN row(target, 'target') WHEN g.session_idx >= entry + 10 THEN row(g.close, 'time') END AS e
 FROM tr2 t LEFT JOIN mkt g ON g.instrument_id = t.instrument_id AND g.session_idx BETWEEN entry + 3 AND entry + 15 AND g.close IS NOT NULL AND NOT suspended AND NOT down_locked),
exits AS (SELECT trade_id, instrument_id, entry, price, arg_min(row(session_idx, e), session_idx) FILTER (e IS NOT NULL) AS x FROM ev GROUP BY 1, 2, 3, 4),
ex2 AS (SELECT trade_id, instrument_id, entry, price, x[1] AS exit, x[2][1] AS exit_price, coalesce(x[2][2], 'open') AS reason FROM exits)"""


def exits(spark, sf):
    f = fills(spark, sf).where("price is not null")
    t = f.select(F.col("order_id").alias("trade_id"), "instrument_id", F.col("session_idx").alias("entry"), "price", rnd(F.col("price") * 0.6, 4).alias("stop"), rnd(F.col("price") * 1.5, 4).alias("target"), F.lit(10).alias("max_hold"))
    return T.bracket_exits(t, market(spark, sf))


@query("bracket_exit", f"WITH {_EXIT} SELECT trade_id, exit, exit_price, reason FROM ex2")
def bracket_exit(spark, sf):
    return exits(spark, sf).select("trade_id", "exit", "exit_price", "reason")


@query("round_trips", f"WITH {_EXIT} SELECT trade_id, exit - entry AS sessions, {fl('exit_price / price - 1')} AS gross, {fl('exit_price * 0.997 / (price * 1.002) - 1')} AS net, reason FROM ex2 WHERE exit IS NOT NULL")
def round_trips(spark, sf):
    return exits(spark, sf).where("exit is not null").select("trade_id", (F.col("exit") - F.col("entry")).alias("sessions"), rnd(F.col("exit_price") / F.col("price") - 1).alias("gross"), rnd(F.col("exit_price") * 0.997 / (F.col("price") * 1.002) - 1).alias("net"), "reason")


_KIND = "['open', 'limit', 'stop', 'zone'][instrument_id % 4 + 1]"


@query("swing_outcomes", f"""WITH {_EXIT} SELECT {_KIND} AS kind, reason, count(*) AS n, {fl('avg((exit_price - price) / (price * 0.4))', 5)} AS mean_r, {fl('avg(exit - entry)')} AS holding, {fl('avg(exit - entry - 10)')} AS beyond_stated,
{fl('avg(exit_price / (floor(price * 0.6 * 10000.0 + 0.5) / 10000.0) - 1) FILTER (starts_with(reason, $$stop$$))', 5)} AS stop_slippage FROM ex2 GROUP BY 1, 2""")
def swing_outcomes(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("open", "limit", "stop", "zone")]), (F.col("instrument_id") % 4 + 1).cast("int"))
    held, stop = F.col("exit") - F.col("entry"), rnd(F.col("price") * 0.6, 4)
    s = exits(spark, sf).groupBy(kind.alias("kind"), "reason").agg(
        F.count("*").alias("n"), F.avg((F.col("exit_price") - F.col("price")) / (F.col("price") * 0.4)).alias("r"), F.avg(held).alias("h"), F.avg(held - 10).alias("d"), F.avg(F.when(F.col("reason").startswith("stop"), F.col("exit_price") / stop - 1)).alias("s")
    )
    return s.select("kind", "reason", "n", rnd("r", 5).alias("mean_r"), rnd("h").alias("holding"), rnd("d").alias("beyond_stated"), rnd("s", 5).alias("stop_slippage"))


_LIFE = _EXIT + """,
fl_ AS (SELECT trade_id * 2 AS fill_id, instrument_id, entry AS session_idx, 'buy' AS side, 100 AS quantity, price FROM ex2 WHERE exit IS NOT NULL UNION ALL SELECT trade_id * 2 + 1, instrument_id, exit, 'sell', 100, exit_price FROM ex2 WHERE exit IS NOT NULL),
q AS (SELECT *, sum(CASE side WHEN 'buy' THEN quantity ELSE -quantity END) OVER (PARTITION BY instrument_id ORDER BY session_idx, fill_id) AS q FROM fl_),
lc AS (SELECT *, coalesce(sum((q = 0)::INT) OVER (PARTITION BY instrument_id ORDER BY session_idx, fill_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM q)"""


def trade_fills(spark, sf):
    e = exits(spark, sf).where("exit is not null")
    row = lambda add, at, side, price: F.struct((F.col("trade_id") * 2 + add).alias("fill_id"), F.col(at).alias("session_idx"), F.lit(side).alias("side"), F.col(price).alias("price"))
    return e.select("instrument_id", F.explode(F.array(row(0, "entry", "buy", "price"), row(1, "exit", "sell", "exit_price"))).alias("x")).select("instrument_id", "x.*", F.lit(100).cast("bigint").alias("quantity"))


@query("positions_from_fills", f"WITH {_LIFE} SELECT instrument_id, CAST(k AS BIGINT) AS lifecycle, min(session_idx) AS opened, max(session_idx) AS last_fill, CAST(max(q) AS BIGINT) AS most, count(*) AS fills FROM lc GROUP BY 1, 2")
def positions_from_fills(spark, sf):
    s = T.lifecycles(trade_fills(spark, sf))
    return s.select("instrument_id", F.col("lifecycle").cast("bigint").alias("lifecycle"), "opened", F.col("closed").alias("last_fill"), "most", "fills")


@query("sleeve_pnl", f"""WITH {_LIFE}, lc0 AS (SELECT instrument_id, arg_max(close, trade_date) AS last FROM bars GROUP BY 1), cf AS (SELECT instrument_id, CASE side WHEN 'buy' THEN -quantity * price ELSE quantity * price END AS cash, 0.0::DOUBLE AS held FROM fl_ UNION ALL SELECT instrument_id, -100 * price, 100 * last FROM ex2 JOIN lc0 USING (instrument_id) WHERE exit IS NULL)
SELECT instrument_id % 2 AS sleeve, {fl('sum(cash)', 2)} AS cash_flow, {fl('sum(held)', 2)} AS value_held, {fl('sum(cash + held)', 2)} AS pnl, count(*) AS fills FROM cf GROUP BY 1""")
def sleeve_pnl(spark, sf):
    """Cash flow of all fills of a sleeve, and what it still holds at the last close."""
    last = P.bars(spark, sf).groupBy("instrument_id").agg(F.max_by("close", "trade_date").alias("last"))
    held = exits(spark, sf).where("exit is null").join(F.broadcast(last), "instrument_id").select("instrument_id", (-100 * F.col("price")).alias("cash"), (100 * F.col("last")).alias("held"))  # one row per instrument
    value = F.col("quantity") * F.col("price")
    done_ = trade_fills(spark, sf).select("instrument_id", F.when(F.col("side") == "buy", -value).otherwise(value).alias("cash"), F.lit(0.0).alias("held"))
    s = done_.unionByName(held).groupBy((F.col("instrument_id") % 2).alias("sleeve")).agg(F.sum("cash").alias("c"), F.sum("held").alias("h"), F.sum(F.col("cash") + F.col("held")).alias("p"), F.count("*").alias("fills"))
    return s.select("sleeve", rnd("c", 2).alias("cash_flow"), rnd("h", 2).alias("value_held"), rnd("p", 2).alias("pnl"), "fills")


_WR = GRID + f""",
wt AS (SELECT 1::BIGINT AS portfolio, instrument_id, session_idx, ((instrument_id + session_idx // 20) % 5) / 50.0::DOUBLE AS weight FROM grid), rt AS (SELECT instrument_id, session_idx, close / nullif(lag(close) OVER g, 0) - 1 AS ret FROM grid {GW}),
hb AS (SELECT w.*, coalesce(lag(weight) OVER (PARTITION BY portfolio, instrument_id ORDER BY session_idx), 0) AS p FROM wt w), dd AS (SELECT portfolio, session_idx, sum(p * coalesce(ret, 0)) AS gross, sum(abs(weight - p)) AS turnover FROM hb LEFT JOIN rt USING (instrument_id, session_idx) GROUP BY 1, 2)"""


def _weights(spark, sf, multipliers=(1.0,)):
    g = grid(spark, sf)
    w = g.select(F.lit(1).cast("bigint").alias("portfolio"), "instrument_id", "session_idx", (((F.col("instrument_id") + F.floor(F.col("session_idx") / 20)) % 5) / 50.0).alias("weight"))
    r = g.select("instrument_id", "session_idx", change("close", 1, sessions()).alias("ret"))
    return T.weight_returns(w, r, 0.002, multipliers)


@query("weight_returns", f"WITH {_WR} SELECT portfolio, session_idx, {fl('gross')} AS gross, {fl('turnover')} AS turnover, {fl('gross - 0.002 * turnover')} AS net FROM dd")
def weight_returns(spark, sf):
    return _round(_weights(spark, sf), ("portfolio", "session_idx"), "gross", "turnover", "net")


@query("cost_sensitivity", f"WITH {_WR} SELECT m AS multiplier, {fl('avg(gross - 0.002 * m * turnover)')} AS mean_net, {fl('sum(0.002 * m * turnover)', 5)} AS cost FROM dd, (SELECT unnest([0.0::DOUBLE, 1.0, 2.0, 3.0]) AS m) GROUP BY 1")
def cost_sensitivity(spark, sf):
    s = _weights(spark, sf, (0, 1, 2, 3)).groupBy("multiplier").agg(F.avg("net").alias("n"), F.sum(F.col("gross") - F.col("net")).alias("c"))
    return s.select("multiplier", rnd("n").alias("mean_net"), rnd("c", 5).alias("cost"))


def kill_sql(equity: str, stop: float, cooldown: int) -> str:
    """SQL of kill_states() as ks, from a table of portfolio, i (from 0), session_idx, equity; the statement must say RECURSIVE."""
    peak = "CASE WHEN k.until > e.i THEN k.peak WHEN k.until = e.i THEN e.equity ELSE greatest(k.peak, e.equity) END"
    return f"""ks(portfolio, i, session_idx, peak, until, state) AS (SELECT portfolio, i, session_idx, equity, CAST(-1 AS BIGINT), 'trading' FROM {equity} WHERE i = 0
 UNION ALL SELECT portfolio, i, session_idx, peak, CASE WHEN state = 'stopped' THEN i + {cooldown} ELSE until END, state FROM (SELECT e.portfolio, e.i, e.session_idx, k.until, {peak} AS peak,
   CASE WHEN k.until > e.i THEN 'cooling' WHEN e.equity / ({peak}) - 1 <= -{stop}::DOUBLE THEN 'stopped' ELSE 'trading' END AS state FROM ks k JOIN {equity} e ON e.portfolio = k.portfolio AND e.i = k.i + 1) n)"""


@query("kill_state", f"""WITH RECURSIVE {P.OWN_BARS}, eq AS MATERIALIZED (SELECT instrument_id AS portfolio, bar_idx AS session_idx, close AS equity, bar_idx - 1 AS i FROM own), {kill_sql('eq', 0.2, 10)} SELECT portfolio, session_idx, state FROM ks""")
def kill_state(spark, sf):
    b = P.own_bars(spark, sf).select(F.col("instrument_id").alias("portfolio"), F.col("bar_idx").alias("session_idx"), F.col("close").alias("equity"))
    return T.kill_states(b, 0.2, 10)


#: The eight best names of model A at each quarter's first session, with their returns of the 252 sessions up to it.
TRAILING = DONE + f""",{P.CAL}, qs AS (SELECT min(session_idx) AS grp, min(trade_date) AS trade_date FROM cal GROUP BY year(trade_date), quarter(trade_date)),
pk AS (SELECT grp, instrument_id FROM dn JOIN qs USING (trade_date) WHERE model_id = 'A' QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, instrument_id) <= 8),
gr AS (SELECT i.instrument_id, c.session_idx, b.close FROM cal c CROSS JOIN (SELECT DISTINCT instrument_id FROM bars) i LEFT JOIN bars b ON b.instrument_id = i.instrument_id AND b.trade_date = c.trade_date),
sr AS (SELECT instrument_id, session_idx, close / nullif(lag(close) OVER (PARTITION BY instrument_id ORDER BY session_idx), 0) - 1 AS ret FROM gr),
tr0 AS (SELECT grp, instrument_id, session_idx AS i, ret, count(ret) OVER (PARTITION BY grp, instrument_id) >= 60 AS seen FROM pk JOIN sr USING (instrument_id) WHERE session_idx BETWEEN grp - 251 AND grp),
trail AS (SELECT grp, instrument_id, i, coalesce(CASE WHEN seen THEN ret ELSE avg(ret) FILTER (seen) OVER (PARTITION BY grp, i) END, 0) AS ret FROM tr0)"""


def trailing(spark, sf):
    q = T.rebalance_sessions(P.calendar(spark, sf), "quarter").select(F.col("session_idx").alias("grp"), "trade_date")
    rows = done(spark, sf).where("model_id = 'A'").join(F.broadcast(q), "trade_date")  # one row per quarter
    r = grid(spark, sf).select("instrument_id", "session_idx", change("close", 1, sessions()).alias("ret"))
    return T.trailing_returns(T.top_k(rows, "score", 8, by=("grp",)), r, 252)


@query("risk_parity")
def risk_parity(spark, sf):
    return T.risk_parity(trailing(spark, sf))


def _last(n: int, least: int, agg: str, x: str) -> str:
    w = f"OVER (PARTITION BY instrument_id ORDER BY bar_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) {w} >= {least} THEN {agg}({x}) {w} END"


_SCALED = "CAST(floor(close * 10000.0 + 0.5) AS BIGINT)"
_MC = P.OWN_BARS + f""", mv AS (SELECT *, abs(close / nullif(lag(close) OVER (PARTITION BY instrument_id ORDER BY bar_idx), 0) - 1) AS m FROM own), mx AS (SELECT *, max(m) OVER (PARTITION BY instrument_id ORDER BY bar_idx ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) - 0.005 AS most FROM mv),
bd AS (SELECT *, CASE WHEN most IS NULL THEN NULL WHEN most <= 0.2 THEN 0.2::DOUBLE WHEN most <= 0.5 THEN 0.5 ELSE 0.9 END AS band FROM mx), nb AS (SELECT *, coalesce(lead(band) OVER (PARTITION BY instrument_id ORDER BY bar_idx), band, 0.2) AS next_band FROM bd),
mc AS (SELECT instrument_id, trade_date, {_last(20, 20, 'max', 'high')} AS high_20, {_last(60, 20, 'max', 'high')} AS high_60, {_last(252, 120, 'max', 'high')} AS high_252, {_last(50, 50, 'sum', _SCALED)} / 50 / 10000.0::DOUBLE AS sma_50, {_last(200, 200, 'sum', _SCALED)} / 200 / 10000.0::DOUBLE AS sma_200,
 {_up('close * (1 - next_band)')} AS next_floor, {_dn('close * (1 + next_band)')} AS next_ceiling FROM nb)"""


@query("market_context", f"WITH {_MC} SELECT instrument_id, trade_date, high_20, high_60, high_252, {fl('sma_50')} AS sma_50, {fl('sma_200')} AS sma_200, {fl('next_floor', 4)} AS next_floor, {fl('next_ceiling', 4)} AS next_ceiling FROM mc")
def market_context(spark, sf):
    """Highs and means of an instrument's own bars, and floor and ceiling of its next one by the band known by then."""
    frame = lambda n: own().rowsBetween(-(n - 1), 0)
    high = lambda n, least: F.when(F.count("close").over(frame(n)) >= least, F.max("high").over(frame(n)))
    mean = lambda n: F.when(F.count("close").over(frame(n)) == n, F.sum(F.floor(F.col("close") * 10000 + 0.5)).over(frame(n)) / n / 10000.0)  # noqa: E731  whole numbers add up alike in any order
    rows = T.inferred_band(P.own_bars(spark, sf).withColumn("session_idx", F.col("bar_idx")), (0.2, 0.5, 0.9))
    band = F.coalesce(F.lead("band").over(own()), "band", F.lit(0.2))
    rows = rows.select(
        "instrument_id", "trade_date", "close", high(20, 20).alias("high_20"), high(60, 20).alias("high_60"), high(252, 120).alias("high_252"), rnd(mean(50)).alias("sma_50"), rnd(mean(200)).alias("sma_200"), band.alias("b")
    )
    p = F.col("close")
    return rows.select("instrument_id", "trade_date", "high_20", "high_60", "high_252", "sma_50", "sma_200", rnd(T.tick_round(p * (1 - F.col("b")), True), 4).alias("next_floor"), rnd(T.tick_round(p * (1 + F.col("b")), False), 4).alias("next_ceiling"))


_GRADED = f"""{DONE}, {_AUC}, eg AS (SELECT model_id, fold, count(*) AS n, avg(proba) - avg(label) AS g FROM dn GROUP BY 1, 2), gd AS (SELECT model_id, fold, CASE WHEN n >= 500 AND auc >= 0.55 AND abs(g) <= 0.05 THEN 'A' WHEN n >= 200 AND auc >= 0.52 AND abs(g) <= 0.1 THEN 'B' WHEN n >= 50 THEN 'C' ELSE 'D' END AS grade FROM eg JOIN au USING (model_id, fold))"""


@query("evidence_grade", f"WITH {_GRADED} SELECT model_id, fold, grade FROM gd")
def evidence_grade(spark, sf):
    d = done(spark, sf)
    s = d.groupBy("model_id", "fold").agg(F.count("*").alias("n"), (F.avg("proba") - F.avg("label")).alias("g"))
    areas = M.auc(d, "proba", "label", ("model_id", "fold"))
    return s.join(F.broadcast(areas), ["model_id", "fold"]).select("model_id", "fold", T.evidence_grade(F.col("n"), F.col("auc"), F.col("g")).alias("grade"))  # one row per model and fold


_CARD = P.OWN_BARS + f""",
sg AS (SELECT instrument_id, trade_date, close, CASE WHEN count(close) OVER w = 14 THEN floor(avg(high - low) OVER w / 5 * 10000.0 + 0.5) / 10000.0 END AS atr, 0.15::DOUBLE AS band, {_up('close * (1 - 0.15::DOUBLE)')} AS floor_, {_dn('close * (1 + 0.15::DOUBLE)')} AS ceil_,
  CASE WHEN count(close) OVER h20 = 20 THEN max(high) OVER h20 END AS high_20, CASE WHEN count(close) OVER h60 = 60 THEN max(high) OVER h60 END AS high_60
  FROM own WINDOW w AS (PARTITION BY instrument_id ORDER BY bar_idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), h20 AS (PARTITION BY instrument_id ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), h60 AS (PARTITION BY instrument_id ORDER BY bar_idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
tg AS (SELECT *, {_up('high_20 + 0.1::DOUBLE * atr')} AS up_ FROM sg),
st_ AS (SELECT *, CASE WHEN close >= high_20 * (1 - 0.02::DOUBLE) THEN 'breakout' ELSE 'pullback' END AS style FROM tg),
zn_ AS (SELECT *, CASE WHEN atr IS NULL THEN NULL WHEN style = 'breakout' THEN up_ END AS trigger_, CASE WHEN atr IS NULL THEN NULL WHEN style = 'breakout' THEN greatest(up_, floor_) ELSE greatest({_dn('close - 0.6::DOUBLE * atr')}, floor_) END AS zone_low,
  CASE WHEN atr IS NULL THEN NULL WHEN style = 'breakout' THEN least(greatest(up_, {_dn('up_ + 0.3::DOUBLE * atr')}), ceil_) ELSE least({_dn('close - 0.15::DOUBLE * atr')}, ceil_) END AS zone_high FROM st_),
rf_ AS (SELECT *, CASE WHEN zone_low IS NULL THEN NULL ELSE least(greatest({_near('(zone_low + zone_high) / 2')}, zone_low), zone_high) END AS ref FROM zn_),
lv AS (SELECT *, {_dn('ref - 1.0::DOUBLE * atr')} AS stop, CASE WHEN high_60 > ref THEN {_dn('high_60 - ' + _tk('high_60'))} END AS limit_, {_up('ref + 1.0::DOUBLE * atr')} AS want1, {_up('ref + 2.0::DOUBLE * atr')} AS want2 FROM rf_),
tt_ AS (SELECT *, CASE WHEN ref IS NULL THEN NULL WHEN limit_ < want2 THEN limit_ ELSE want2 END AS target2, CASE WHEN ref IS NULL THEN NULL ELSE least(want1, want2, coalesce(limit_, want2)) END AS target1, limit_ < want2 AS over_ FROM lv),
rr AS (SELECT *, CASE WHEN ref IS NOT NULL THEN coalesce(over_, false) END AS capped, CASE WHEN atr IS NULL THEN 'no volatility' WHEN trigger_ > ceil_ THEN 'trigger above the ceiling' WHEN zone_low > zone_high OR zone_high <= floor_ THEN 'zone outside the band' WHEN stop <= 0 OR stop >= ref THEN 'no valid stop'
  WHEN limit_ <= ref + {_tk('ref')} THEN 'resistance too near' WHEN target1 <= ref THEN 'target not above entry' WHEN (target2 - ref) / nullif(ref - stop, 0) < 1.5 THEN 'reward below risk' END AS reason FROM tt_)"""


def cards(spark, sf):
    """Cards of all bars, with a band of 15 %."""
    over = lambda n: own().rowsBetween(-(n - 1), 0)
    full = lambda n, x: F.when(F.count("close").over(over(n)) == n, x)
    band = F.lit(0.15)
    s = P.own_bars(spark, sf).select(
        "instrument_id", "trade_date", "close", full(14, rnd(F.avg(F.col("high") - F.col("low")).over(over(14)) / 5, 4)).alias("atr"), band.alias("band"),
        T.tick_round(F.col("close") * (1 - band), True).alias("floor"), T.tick_round(F.col("close") * (1 + band), False).alias("ceiling"),
        *[full(n, F.max("high").over(over(n))).alias(f"high_{n}") for n in (20, 60)],
    )
    return T.card_levels(s)


@query("card_levels", f"""WITH {_CARD} SELECT instrument_id, trade_date, style, {fl('trigger_', 4)} AS trigger, {fl('zone_low', 4)} AS zone_low, {fl('zone_high', 4)} AS zone_high, {fl('ref', 4)} AS reference, {fl('stop', 4)} AS stop, {fl('target1', 4)} AS target1, {fl('target2', 4)} AS target2, capped, reason FROM rr""")
def card_levels(spark, sf):
    return _round(cards(spark, sf), ("instrument_id", "trade_date", "style", "capped", "reason"), "trigger", "zone_low", "zone_high", "reference", "stop", "target1", "target2", places=4)


#: Sized cards: names may take a tenth, less what a third of them hold elsewhere.
SIZED = _CARD + """, zw AS (SELECT *, least(0.1::DOUBLE, 0.01::DOUBLE / nullif((ref - stop) / ref, 0), CASE WHEN instrument_id % 3 = 0 THEN 0.04::DOUBLE ELSE 0.1::DOUBLE END) AS wanted FROM rr WHERE reason IS NULL),
zq AS (SELECT *, CAST(floor(10000000.0::DOUBLE * wanted / (zone_high * 100)) * 100 AS BIGINT) AS qty FROM zw),
sized AS (SELECT instrument_id, trade_date, zone_high, ref, stop, CASE WHEN qty >= 100 THEN qty END AS quantity, CASE WHEN qty >= 100 THEN qty * zone_high / 10000000.0::DOUBLE END AS weight, CASE WHEN qty >= 100 THEN qty * (ref - stop) / 10000000.0::DOUBLE END AS risk,
  CASE WHEN qty >= 100 THEN NULL ELSE 'less than a lot' END AS refused FROM zq)"""


def sized_cards(spark, sf):
    room = F.when(F.col("instrument_id") % 3 == 0, 0.04).otherwise(0.1)
    return T.card_sizing(cards(spark, sf).where("reason is null"), 10_000_000.0, 0.01, 0.1, room)


@query("card_sizing", f"WITH {SIZED} SELECT instrument_id, trade_date, {fl('weight')} AS weight, quantity, {fl('risk')} AS risk, refused FROM sized")
def card_sizing(spark, sf):
    s = sized_cards(spark, sf)
    return s.select("instrument_id", "trade_date", rnd("weight").alias("weight"), F.col("quantity").cast("bigint").alias("quantity"), rnd("risk").alias("risk"), "refused")


_PROBLEMS = f"""[CASE WHEN stop IS NULL THEN 'no stop' END, CASE WHEN target1 IS NULL THEN 'no target' END, CASE WHEN stop >= zone_low THEN 'stop not below zone' END, CASE WHEN zone_low > zone_high THEN 'zone upside down' END, CASE WHEN target1 <= zone_high THEN 'target not above zone' END,
CASE WHEN abs(stop / {_tk('stop')} - round(stop / {_tk('stop')})) > 1e-6 THEN 'stop off tick' END, CASE WHEN abs(target1 / {_tk('target1')} - round(target1 / {_tk('target1')})) > 1e-6 THEN 'target off tick' END, CASE WHEN zone_low < close * (1 - band) OR zone_high > close * (1 + band) THEN 'zone outside the band' END]"""


@query("card_validate", f"""WITH {_CARD}, pb AS (SELECT instrument_id, unnest(list_filter({_PROBLEMS}, lambda x: x IS NOT NULL)) AS problem FROM (SELECT * REPLACE (CASE WHEN instrument_id % 10 = 0 THEN 0.01::DOUBLE ELSE band END AS band, CASE WHEN instrument_id % 10 = 1 THEN stop + 0.013::DOUBLE ELSE stop END AS stop) FROM rr)) SELECT instrument_id, problem, count(*) AS n FROM pb GROUP BY 1, 2""")
def card_validate(spark, sf):
    """Problems by instrument; every tenth has a narrow band, every tenth a stop off the ticks."""
    k = F.col("instrument_id") % 10
    rows = cards(spark, sf).withColumn("band", F.when(k == 0, 0.01).otherwise(F.col("band"))).withColumn("stop", F.when(k == 1, F.col("stop") + 0.013).otherwise(F.col("stop")))
    return rows.select("instrument_id", F.explode(T.card_problems(rows)).alias("problem")).groupBy("instrument_id", "problem").agg(F.count("*").alias("n"))


def _weekday_sql(x: str) -> str:
    return f"CAST({x} + CASE isodow({x}) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS DATE)"


_NEXT = {c: f"CAST(date_trunc('{c}', c.trade_date) + INTERVAL {n} AS DATE)" for c, n in (("week", "7 DAY"), ("month", "1 MONTH"), ("quarter", "3 MONTH"))}


@query("next_schedule", f"""WITH {_CALS}, e AS (SELECT max(trade_date) AS last, max(session_idx) AS n FROM cal) SELECT c.trade_date, coalesce(n.trade_date, list_filter(list_transform(range(1, 10), lambda k: CAST(e.last + CAST(k AS INTEGER) AS DATE)), lambda d: isodow(d) <= 5)[c.session_idx + 3 - e.n]) AS third_session,
{", ".join(f"{_weekday_sql(x)} AS next_{c}" for c, x in _NEXT.items())} FROM cal c CROSS JOIN e LEFT JOIN cal n ON n.session_idx = c.session_idx + 3""")
def next_schedule(spark, sf):
    """The third session after each (weekdays beyond the last known one), and the first weekday of the next week, month and quarter."""
    cal = P.calendar(spark, sf)
    return T.session_after(cal, 3, "third_session").select("trade_date", "third_session", *[T.next_period("trade_date", p).alias(f"next_{p}") for p in ("week", "month", "quarter")])


@query("sleeve_overlap", f"""WITH {DONE}, tp AS (SELECT model_id, trade_date, instrument_id, abs(score) + 0.01 AS x FROM dn QUALIFY row_number() OVER (PARTITION BY model_id, trade_date ORDER BY score DESC, instrument_id) <= 5),
w AS (SELECT model_id AS sleeve, trade_date, instrument_id, x / sum(x) OVER (PARTITION BY model_id, trade_date) AS weight FROM tp), o AS (SELECT trade_date, instrument_id, count(DISTINCT sleeve) AS sleeves, sum(weight) AS combined FROM w GROUP BY 1, 2)
SELECT trade_date, count(*) AS names, {fl('max(combined)')} AS most FROM o WHERE sleeves > 1 GROUP BY 1""")
def sleeve_overlap(spark, sf):
    top = T.top_k(done(spark, sf), "score", 5, by=("model_id", "trade_date")).withColumn("x", F.abs("score") + 0.01)
    targets = top.select(F.col("model_id").alias("sleeve"), "trade_date", "instrument_id", (F.col("x") / F.sum("x").over(Window.partitionBy("model_id", "trade_date"))).alias("weight"))
    return T.sleeve_overlap(targets).groupBy("trade_date").agg(F.count("*").alias("names"), rnd(F.max("combined")).alias("most"))


@query("cards_insert_only", f"WITH {_TOP} SELECT instrument_id, trade_date, 'stored' AS origin FROM tp WHERE rank <= 2 UNION ALL SELECT instrument_id, trade_date, 'new' FROM tp WHERE rank > 2")
def cards_insert_only(spark, sf):
    a = best(spark, sf)
    stored = a.where("rank <= 2").select("instrument_id", "trade_date")
    new = a.select("instrument_id", "trade_date").join(stored, ["instrument_id", "trade_date"], "left_anti")
    return stored.withColumn("origin", F.lit("stored")).unionByName(new.withColumn("origin", F.lit("new")))


@query("target_book_asof", f"WITH {_TOP}, l AS (SELECT trade_date FROM tp WHERE trade_date <= DATE '1999-06-30' ORDER BY trade_date DESC LIMIT 1) SELECT instrument_id, trade_date FROM tp SEMI JOIN l USING (trade_date)")
def target_book_asof(spark, sf):
    a = best(spark, sf).where("trade_date <= date'1999-06-30'")
    return a.join(F.broadcast(a.agg(F.max("trade_date").alias("trade_date"))), "trade_date", "left_semi").select("instrument_id", "trade_date")  # one row


@query("predictions_upsert", f"WITH {PRED}, u AS (SELECT model_id, instrument_id, trade_date, score, 1 AS run FROM pred UNION ALL SELECT model_id, instrument_id, trade_date, score + 1, 2 FROM pred WHERE instrument_id % 5 = 0) SELECT model_id, instrument_id, trade_date, arg_max(score, run) AS score FROM u GROUP BY 1, 2, 3")
def predictions_upsert(spark, sf):
    p = predictions(spark, sf).select("model_id", "instrument_id", "trade_date", "score", F.lit(1).alias("run"))
    both = p.unionByName(p.where("instrument_id % 5 = 0").select("model_id", "instrument_id", "trade_date", (F.col("score") + 1).alias("score"), F.lit(2).alias("run")))
    return both.groupBy("model_id", "instrument_id", "trade_date").agg(F.max_by("score", "run").alias("score"))
