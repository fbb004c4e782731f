"""Universes and data quality as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import rnd
from barloom.operators import quality as Q
from barloom.operators import universe as U
from barloom.plans.feature_queries import fl
from barloom.plans.registry import query
from barloom.sources import panel as P

M = P.BARS_MARKET
AT = "valid_from <= DATE '{d}' AND (valid_to IS NULL OR DATE '{d}' < valid_to)"


def at(d: str) -> str:
    return AT.format(d=d)


def _asof(u: str, d: str) -> str:
    return f"""SELECT m.instrument_id, s.symbol FROM (SELECT * FROM membership WHERE universe = '{u}' AND {at(d)}) m JOIN (SELECT * FROM symbols WHERE {at(d)}) s USING (instrument_id)
WHERE m.instrument_id NOT IN (SELECT instrument_id FROM statuses WHERE {at(d)})"""


def _members(spark, sf, u, d):
    return U.members_asof(P.membership(spark, sf), P.symbol_history(spark, sf), P.status_history(spark, sf), u, d)


@query("members_asof", f"WITH {M} {_asof('WIDE', '1997-03-15')}")
def members_asof(spark, sf):
    return _members(spark, sf, "WIDE", "1997-03-15")


@query("members_between", f"""WITH {M}, n AS (SELECT instrument_id, coalesce(arg_max(symbol, valid_from) FILTER (valid_from <= DATE '1998-06-30'), arg_max(symbol, valid_from)) AS symbol FROM symbols GROUP BY 1)
SELECT instrument_id, symbol FROM (SELECT DISTINCT instrument_id FROM membership WHERE universe = 'CORE' AND valid_from <= DATE '1998-06-30' AND (valid_to IS NULL OR valid_to > DATE '1998-01-01')) JOIN n USING (instrument_id)""")
def members_between(spark, sf):
    return U.members_between(P.membership(spark, sf), P.symbol_history(spark, sf), "CORE", "1998-01-01", "1998-06-30")


@query("training_trading_members", f"WITH {M}, t AS ({_asof('WIDE', '2000-01-15')}), c AS ({_asof('CORE', '2000-01-15')}) SELECT 'training' AS role, * FROM t UNION ALL SELECT 'trading', * FROM c")
def training_trading_members(spark, sf):
    d = "2000-01-15"
    return _members(spark, sf, "WIDE", d).select(F.lit("training").alias("role"), "*").unionByName(_members(spark, sf, "CORE", d).select(F.lit("trading").alias("role"), "*"))


@query("outside_training", f"WITH {M}, t AS ({_asof('WIDE', '2000-01-15')}), c AS ({_asof('CORE', '1999-06-15')}) SELECT instrument_id FROM c WHERE instrument_id NOT IN (SELECT instrument_id FROM t)")
def outside_training(spark, sf):
    return _members(spark, sf, "CORE", "1999-06-15").join(_members(spark, sf, "WIDE", "2000-01-15"), "instrument_id", "left_anti").select("instrument_id")


@query("membership_daily", f"WITH {P.BARS_CAL}, {P.MARKET} SELECT DISTINCT trade_date, instrument_id, true AS is_member FROM membership JOIN cal ON trade_date >= valid_from AND (valid_to IS NULL OR trade_date < valid_to) WHERE universe = 'CORE'")
def membership_daily(spark, sf):
    return U.membership_daily(P.membership(spark, sf).where("universe = 'CORE'"), P.calendar(spark, sf))


@query("symbol_asof", f"WITH {M} SELECT instrument_id, symbol, exchange FROM symbols QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY ({at('1996-06-30')})::INT DESC, valid_from DESC) = 1")
def symbol_asof(spark, sf):
    return U.symbols_asof(P.symbol_history(spark, sf), "1996-06-30")


@query("status_asof", f"WITH {M} SELECT instrument_id, coalesce(status, 'active') AS status FROM ins LEFT JOIN (SELECT * FROM statuses WHERE {at('2000-07-01')}) USING (instrument_id)")
def status_asof(spark, sf):
    return U.status_asof(P.instruments(spark, sf), P.status_history(spark, sf), "2000-07-01")


@query("exchange_band_daily", f"""WITH {M} SELECT b.instrument_id, b.trade_date, coalesce(map {{'XA': 0.07::DOUBLE, 'XB': 0.1, 'XC': 0.15}}[exchange], 0.15) AS band FROM bars b LEFT JOIN symbols s
ON s.instrument_id = b.instrument_id AND b.trade_date >= valid_from AND (valid_to IS NULL OR b.trade_date < valid_to)""")
def exchange_band_daily(spark, sf):
    return U.bands_daily(P.bars(spark, sf).select("instrument_id", "trade_date"), P.symbol_history(spark, sf), {"XA": 0.07, "XB": 0.1, "XC": 0.15})


@query("interval_integrity", f"""WITH {M}, bad AS (SELECT * FROM symbols UNION ALL SELECT instrument_id + 1, symbol, exchange, DATE '1998-01-01', NULL FROM symbols WHERE instrument_id = 14 AND valid_to IS NULL),
mm AS (SELECT universe, instrument_id, CASE WHEN instrument_id = 3 THEN DATE '1990-01-01' ELSE valid_from END AS valid_from, valid_to FROM membership)
SELECT 'ticker overlap' AS finding, instrument_id, valid_from FROM bad QUALIFY lead(valid_from) OVER (PARTITION BY instrument_id ORDER BY valid_from) < coalesce(valid_to, DATE '9999-12-31')
UNION ALL SELECT * FROM (SELECT 'shared ticker', instrument_id, valid_from FROM bad QUALIFY lead(valid_from) OVER (PARTITION BY symbol ORDER BY valid_from) < coalesce(valid_to, DATE '9999-12-31'))
UNION ALL SELECT 'membership without ticker', instrument_id, valid_from FROM mm WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.instrument_id = mm.instrument_id AND b.valid_from <= mm.valid_from AND (b.valid_to IS NULL OR mm.valid_from < b.valid_to))""")
def interval_integrity(spark, sf):
    s = P.symbol_history(spark, sf)
    extra = s.where("instrument_id = 14 and valid_to is null").select((F.col("instrument_id") + 1).alias("instrument_id"), "symbol", "exchange", F.lit("1998-01-01").cast("date").alias("valid_from"), "valid_to")
    m = P.membership(spark, sf).withColumn("valid_from", F.when(F.col("instrument_id") == 3, F.lit("1990-01-01").cast("date")).otherwise(F.col("valid_from")))
    return U.integrity(s.unionByName(extra), P.status_history(spark, sf), m)


_OPEN = "op AS (SELECT instrument_id, symbol, exchange, 1.0::DOUBLE AS weight, 'active' AS status FROM symbols WHERE valid_to IS NULL AND instrument_id <> 2)"
_SNAP = """sn AS (SELECT instrument_id, CASE WHEN instrument_id = 5 THEN 'NEW5' ELSE symbol END AS symbol, CASE WHEN instrument_id = 6 THEN 'XZ' ELSE exchange END AS exchange,
CASE WHEN instrument_id = 8 THEN 0.5::DOUBLE ELSE 1.0 END AS weight, CASE WHEN instrument_id = 9 THEN 'suspended' WHEN instrument_id = 10 THEN 'delisted' ELSE 'active' END AS status FROM symbols WHERE valid_to IS NULL AND instrument_id <> 3)"""


def _snapshot(spark, sf):
    now = P.symbol_history(spark, sf).where("valid_to is null")
    old = now.where("instrument_id != 2").select("instrument_id", "symbol", "exchange", F.lit(1.0).alias("weight"), F.lit("active").alias("status"))
    pick = lambda k, value, other: F.when(F.col("instrument_id") == k, F.lit(value)).otherwise(other)
    new = now.where("instrument_id != 3").select(
        "instrument_id", pick(5, "NEW5", F.col("symbol")).alias("symbol"), pick(6, "XZ", F.col("exchange")).alias("exchange"), pick(8, 0.5, F.lit(1.0)).alias("weight"),
        pick(9, "suspended", pick(10, "delisted", F.lit("active"))).alias("status"),
    )
    return old, new


@query("snapshot_diff", f"""WITH {M}, {_OPEN}, {_SNAP}, b AS (SELECT coalesce(op.instrument_id, sn.instrument_id) AS id, op, sn FROM op FULL JOIN sn ON op.instrument_id = sn.instrument_id),
x AS (SELECT id, 'add' AS action, NULL AS o, sn.symbol AS n FROM b WHERE op.instrument_id IS NULL UNION ALL SELECT id, 'remove', op.symbol, NULL FROM b WHERE sn.instrument_id IS NULL
UNION ALL SELECT id, 'rename', op.symbol, sn.symbol FROM b WHERE op.symbol <> sn.symbol UNION ALL SELECT id, 'exchange', op.exchange, sn.exchange FROM b WHERE op.exchange <> sn.exchange
UNION ALL SELECT id, 'weight_change', CAST(op.weight AS VARCHAR), CAST(sn.weight AS VARCHAR) FROM b WHERE op.weight <> sn.weight
UNION ALL SELECT id, CASE sn.status WHEN 'suspended' THEN 'suspend' WHEN 'delisted' THEN 'delist' ELSE 'resume' END, op.status, sn.status FROM b WHERE op.status <> sn.status)
SELECT id AS instrument_id, action, o AS old_value, n AS new_value, DATE '2001-01-02' AS effective_date FROM x""")
def snapshot_diff(spark, sf):
    return U.snapshot_diff(*_snapshot(spark, sf), "2001-01-02")


@query("snapshot_apply", f"""WITH {M}, {_SNAP}, lv AS (SELECT instrument_id, weight FROM sn WHERE status <> 'delisted') SELECT h.instrument_id, valid_from, CASE WHEN valid_to IS NULL AND (lv.weight IS NULL OR lv.weight <> h.weight) THEN DATE '2001-01-02' ELSE valid_to END AS valid_to, h.weight FROM mb h LEFT JOIN lv USING (instrument_id)
UNION ALL SELECT lv.instrument_id, DATE '2001-01-02', NULL, lv.weight FROM lv LEFT JOIN (SELECT * FROM mb WHERE valid_to IS NULL) o USING (instrument_id) WHERE o.instrument_id IS NULL OR o.weight <> lv.weight""")
def snapshot_apply(spark, sf):
    """Membership rows after the snapshot of snapshot_diff."""
    history = P.membership(spark, sf).where("universe = 'WIDE'").drop("universe")
    return U.apply_snapshot(history, _snapshot(spark, sf)[1], "2001-01-02")


_CH = "ch AS (SELECT instrument_id, 'N' || symbol AS new_value FROM symbols WHERE valid_to IS NULL AND instrument_id % 8 = 0)"


def _changes(spark, sf, prefix="N", column="symbol"):
    return P.symbol_history(spark, sf).where("valid_to is null and instrument_id % 8 = 0").select("instrument_id", F.concat(F.lit(prefix), column).alias("new_value"))


@query("scd2_rename", f"""WITH {M}, {_CH} SELECT s.instrument_id, symbol, exchange, valid_from, CASE WHEN valid_to IS NULL AND new_value IS NOT NULL THEN DATE '2001-01-02' ELSE valid_to END AS valid_to FROM symbols s LEFT JOIN ch USING (instrument_id)
UNION ALL SELECT s.instrument_id, new_value, exchange, DATE '2001-01-02', NULL FROM symbols s JOIN ch USING (instrument_id) WHERE valid_to IS NULL""")
def scd2_rename(spark, sf):
    return U.close_and_open(P.symbol_history(spark, sf), _changes(spark, sf), "symbol", "2001-01-02")


@query("scd2_exchange", f"""WITH {M}, h AS (SELECT instrument_id, symbol, CASE WHEN instrument_id % 16 = 0 THEN NULL ELSE exchange END AS exchange, valid_from, valid_to FROM symbols)
SELECT instrument_id, symbol, CASE WHEN instrument_id % 16 = 0 AND valid_to IS NULL THEN 'Z' || (SELECT exchange FROM symbols s WHERE s.instrument_id = h.instrument_id AND s.valid_to IS NULL) ELSE exchange END AS exchange, valid_from,
 CASE WHEN instrument_id % 8 = 0 AND instrument_id % 16 <> 0 AND valid_to IS NULL THEN DATE '2001-01-02' ELSE valid_to END AS valid_to FROM h
UNION ALL SELECT instrument_id, symbol, 'Z' || exchange, DATE '2001-01-02', NULL FROM h WHERE instrument_id % 8 = 0 AND instrument_id % 16 <> 0 AND valid_to IS NULL""")
def scd2_exchange(spark, sf):
    h = P.symbol_history(spark, sf)
    return U.set_exchange(h.withColumn("exchange", F.when(F.col("instrument_id") % 16 != 0, F.col("exchange"))), _changes(spark, sf, "Z", "exchange"), "2001-01-02")


_STAT = f"""{M}, w AS (SELECT instrument_id, CASE instrument_id % 3 WHEN 0 THEN 'suspended' WHEN 1 THEN 'delisted' ELSE 'active' END AS status FROM ins),
j AS (SELECT w.instrument_id, coalesce(s.status, 'active') AS was, w.status AS wanted FROM w LEFT JOIN (SELECT * FROM statuses WHERE {at('2000-07-01')}) s USING (instrument_id)),
sx AS (SELECT *, CASE WHEN was = 'delisted' THEN 'refused: delisted' WHEN was = wanted THEN 'unchanged' WHEN wanted = 'active' THEN 'closed' WHEN was = 'active' THEN 'opened' ELSE 'rolled' END AS result FROM j)"""


def _wanted(spark, sf):
    k = F.col("instrument_id") % 3
    return P.instruments(spark, sf).withColumn("status", F.when(k == 0, "suspended").when(k == 1, "delisted").otherwise("active"))


@query("scd2_status", f"WITH {_STAT} SELECT * FROM sx")
def scd2_status(spark, sf):
    return U.set_status(P.status_history(spark, sf), _wanted(spark, sf), "2000-07-01")


@query("scd2_status_apply", f"""WITH {_STAT} SELECT s.instrument_id, status, valid_from, CASE WHEN result IN ('closed', 'rolled') AND {at('2000-07-01')} THEN DATE '2000-07-01' ELSE valid_to END AS valid_to FROM statuses s LEFT JOIN sx USING (instrument_id)
UNION ALL SELECT instrument_id, wanted, DATE '2000-07-01', NULL FROM sx WHERE result IN ('opened', 'rolled')""")
def scd2_status_apply(spark, sf):
    """Status rows after the transitions of scd2_status."""
    return U.apply_status(P.status_history(spark, sf), _wanted(spark, sf), "2000-07-01")


_LIQ = f"""WITH {P.BARS}, l AS (SELECT * FROM bars WHERE NOT (instrument_id = 7 AND trade_date > DATE '2001-01-01') AND NOT (instrument_id = 9 AND trade_date > DATE '1995-01-31') QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date DESC) <= 60),
st AS (SELECT instrument_id, quantile_cont(close * volume, 0.5) AS value, count(*) AS n, max(trade_date) AS last FROM l GROUP BY 1),
rs AS (SELECT *, CASE WHEN n < 60 THEN 'too few bars' WHEN last < DATE '2001-10-01' THEN 'stale' END AS reason FROM st)"""


def _liquid(spark, sf):
    b = P.bars(spark, sf).where("not (instrument_id = 7 and trade_date > date'2001-01-01') and not (instrument_id = 9 and trade_date > date'1995-01-31')")
    return U.liquidity_universe(b, 60, 10, "2001-10-01")


@query("liquidity_rank_universe", f"{_LIQ} SELECT instrument_id, {fl('value', 4)} AS value FROM rs WHERE reason IS NULL ORDER BY rs.value DESC, instrument_id LIMIT 10")
def liquidity_rank_universe(spark, sf):
    return _liquid(spark, sf)[0].select("instrument_id", rnd("value", 4).alias("value"))


@query("liquidity_exclusions", f"{_LIQ} SELECT instrument_id, n, last, reason FROM rs WHERE reason IS NOT NULL")
def liquidity_exclusions(spark, sf):
    return _liquid(spark, sf)[1]


@query("universe_snapshot_csv", f"{_LIQ}, t AS (SELECT instrument_id FROM rs WHERE reason IS NULL ORDER BY rs.value DESC, instrument_id LIMIT 10) SELECT instrument_id, greatest(DATE '1995-06-01', min(trade_date)) AS valid_from FROM t JOIN bars USING (instrument_id) GROUP BY 1")
def universe_snapshot_csv(spark, sf):
    first = P.bars(spark, sf).groupBy("instrument_id").agg(F.greatest(F.lit("1995-06-01").cast("date"), F.min("trade_date")).alias("valid_from"))
    return _liquid(spark, sf)[0].select("instrument_id").join(first, "instrument_id")


@query("removed_member_flags", f"WITH {M} SELECT instrument_id, instrument_id NOT IN (SELECT instrument_id FROM membership WHERE universe = 'WIDE' AND {at('2000-06-01')}) AS flagged FROM ins WHERE instrument_id % 2 = 1")
def removed_member_flags(spark, sf):
    now = P.membership(spark, sf).where("universe = 'WIDE'").where(U.valid(F.lit("2000-06-01").cast("date"))).select("instrument_id", F.lit(True).alias("there")).distinct()
    return P.instruments(spark, sf).where("instrument_id % 2 = 1").join(now, "instrument_id", "left").select("instrument_id", F.col("there").isNull().alias("flagged"))


# data quality

D = P.DIRTY
DCAL = D + "," + P.CAL


def _sql_money(x: str) -> str:
    c = f"CAST(floor(abs({x}) * 10000 + 0.5) AS BIGINT)"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || ({c} // 10000) || '.' || lpad(CAST({c} % 10000 AS VARCHAR), 4, '0'))"


def _f(check: str, severity: str, detail: str, source: str, date: str = "trade_date") -> str:
    return f"SELECT instrument_id, {date} AS trade_date, '{check}' AS \"check\", '{severity}' AS severity, {detail} AS detail FROM {source}"


LAG = "lag({x}) OVER (PARTITION BY instrument_id ORDER BY trade_date)"
DUP = "(SELECT * FROM dirty UNION ALL SELECT * FROM dirty WHERE day(trade_date) = 9 AND instrument_id = 4)"
CHECKS = {
    "no_data": _f("no_data", "error", "'no bars'", "ins WHERE instrument_id NOT IN (SELECT instrument_id FROM dirty WHERE instrument_id % 6 <> 0)", "NULL::DATE"),
    "duplicate_bar": _f("duplicate_bar", "error", "count(*) || ' rows'", DUP) + " GROUP BY instrument_id, trade_date HAVING count(*) > 1",
    "ohlc_inconsistent": _f("ohlc_inconsistent", "error", "'off by ' || " + _sql_money("(greatest(greatest(open, close, low) - high, low - least(open, close, high)) * 100 / nullif(close, 0))") + " || '% of close'", "dirty WHERE greatest(open, close, low) > high OR low > least(open, close, high)"),
    "nonpositive_price": _f("nonpositive_price", "error", "'lowest ' || " + _sql_money("least(open, high, low, close)"), "dirty WHERE least(open, high, low, close) <= 0"),
    "price_unit": _f("price_unit", "error", "'close ' || " + _sql_money("close"), f"(SELECT *, close / nullif({LAG.format(x='close')}, 0) AS r FROM dirty) WHERE close NOT BETWEEN 1 AND 100000 OR r >= 50 OR r <= 1 / 50.0::DOUBLE"),
    "zero_volume": _f("zero_volume", "info", "'no volume'", "dirty WHERE volume = 0"),
    "repeated_bar": _f("repeated_bar", "warning", "'same as the bar before'", f"(SELECT instrument_id, trade_date, row(open, high, low, close, volume) AS x, {LAG.format(x='row(open, high, low, close, volume)')} AS p FROM rep) WHERE x = p"),
    "volume_spike": _f("volume_spike", "warning", _sql_money("(volume / m)") + " || ' times the median'", "(SELECT *, quantile_cont(volume, 0.5) OVER f AS m, count(volume) OVER f AS k_ FROM dirty WINDOW f AS (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) WHERE k_ >= 30 AND m > 0 AND volume / m > 30"),
    "big_move": _f("big_move", "warning", _sql_money("(r * 100)") + " || '% in ' || dd || ' days'", f"(SELECT *, close / nullif({LAG.format(x='close')}, 0) - 1 AS r, trade_date - {LAG.format(x='trade_date')} AS dd FROM dirty) WHERE abs(r) > 0.5::DOUBLE + 0.005::DOUBLE"),
    "missing_trading_day": _f("missing_trading_day", "warning", "'no bar'", "(SELECT s.instrument_id, c.trade_date FROM (SELECT instrument_id, min(trade_date) AS a, max(trade_date) AS b FROM dirty GROUP BY 1) s JOIN cal c ON c.trade_date BETWEEN a AND b) z WHERE NOT EXISTS (SELECT 1 FROM dirty d WHERE d.instrument_id = z.instrument_id AND d.trade_date = z.trade_date)"),
    "extra_day": _f("extra_day", "warning", "'off the calendar'", "dirty WHERE trade_date NOT IN (SELECT trade_date FROM cal)"),
    "stale_series": _f("stale_series", "warning", "((SELECT max(trade_date) FROM cal) - trade_date) || ' days old'", "(SELECT instrument_id, max(trade_date) AS trade_date FROM dirty GROUP BY 1) WHERE trade_date < (SELECT max(trade_date) FROM cal)"),
}
ALL = DCAL + "," + P.MARKET + ", rep AS (SELECT instrument_id, trade_date, open, high, low, close, volume FROM dirty UNION ALL SELECT instrument_id, CAST(trade_date + 1 AS DATE), open, high, low, close, volume FROM (SELECT *, lead(trade_date) OVER (PARTITION BY instrument_id ORDER BY trade_date) AS nx FROM dirty) WHERE day(trade_date) = 20 AND nx > trade_date + 1)"


def _repeated(b):
    from pyspark.sql import Window

    nx = F.lead("trade_date").over(Window.partitionBy("instrument_id").orderBy("trade_date"))
    more = b.withColumn("nx", nx).where("day(trade_date) = 20 and nx > date_add(trade_date, 1)").withColumn("trade_date", F.date_add("trade_date", 1)).drop("nx")
    return b.unionByName(more)


def checks(spark, sf):
    """Each check's findings by name."""
    b, cal = P.bars_dirty(spark, sf), P.calendar(spark, sf)
    return {
        "no_data": lambda: Q.no_data(P.instruments(spark, sf), b.where("instrument_id % 6 != 0")),
        "duplicate_bar": lambda: Q.duplicate_bar(b.unionByName(b.where("day(trade_date) = 9 and instrument_id = 4"))),
        "ohlc_inconsistent": lambda: Q.ohlc_inconsistent(b), "nonpositive_price": lambda: Q.nonpositive_price(b), "price_unit": lambda: Q.price_unit(b, 1, 100000, 50),
        "zero_volume": lambda: Q.zero_volume(b), "repeated_bar": lambda: Q.repeated_bar(_repeated(b)), "volume_spike": lambda: Q.volume_spike(b), "big_move": lambda: Q.big_move(b, 0.5, 0.005),
        "missing_trading_day": lambda: Q.missing_trading_day(b, cal), "extra_day": lambda: Q.extra_day(b, cal), "stale_series": lambda: Q.stale_series(b, cal),
    }


for _name in CHECKS:

    @query(f"dq_{_name}", f"WITH {ALL} {CHECKS[_name]}")
    def _run(spark, sf, _name=_name):
        return checks(spark, sf)[_name]()


@query("dq_return_outlier", f"""WITH {D}, far AS (SELECT * REPLACE (CASE WHEN (date_diff('day', DATE '1995-01-01', trade_date) + instrument_id * 13) % 97 = 3 THEN close * 1000 ELSE close END AS close) FROM dirty), r AS (SELECT *, ln(close / nullif({LAG.format(x='close')}, 0)) AS lr FROM far WHERE close > 0), q AS (SELECT *, quantile_cont(lr, 0.5) OVER (PARTITION BY instrument_id) AS m, count(*) OVER (PARTITION BY instrument_id) AS n FROM r WHERE lr IS NOT NULL),
d AS (SELECT *, abs(lr - m) AS d FROM q WHERE n >= 60), z AS (SELECT *, d / nullif(1.4826 * quantile_cont(d, 0.5) OVER (PARTITION BY instrument_id), 0) AS z FROM d) SELECT instrument_id, trade_date FROM z WHERE z > 8""")
def dq_return_outlier(spark, sf):
    """Outliers among bars of which some are a million times too high: prices of this panel jump so far that a thousand times is no outlier."""
    far = F.pmod(P.day_key() + F.col("instrument_id") * 13, F.lit(97)) == 3
    bars = P.bars_dirty(spark, sf).withColumn("close", F.when(far, F.col("close") * 1000).otherwise(F.col("close")))
    return Q.return_outlier(bars).select("instrument_id", "trade_date")


@query("dq_vendor_duplicate", "SELECT user_id AS instrument_id, CAST(ts AS DATE) AS trade_date, 'vendor_duplicate' AS \"check\", 'info' AS severity, 'merged ' || count(*) AS detail FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def dq_vendor_duplicate(spark, sf):
    n = P.events(spark, sf).groupBy("user_id", F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("n")).where("n > 1")
    lines = n.groupBy("user_id").agg(F.to_json(F.collect_list(F.concat_ws(" ", "user_id", "d", F.lit("merged"), "n"))).alias("warnings"))
    return Q.vendor_duplicates(lines)


_UNION = " UNION ALL ".join(f"SELECT * FROM ({CHECKS[k]})" for k in ("ohlc_inconsistent", "nonpositive_price", "price_unit", "zero_volume", "extra_day"))


def some_findings(spark, sf):
    c = checks(spark, sf)
    out = None
    for k in ("ohlc_inconsistent", "nonpositive_price", "price_unit", "zero_volume", "extra_day"):
        out = c[k]() if out is None else out.unionByName(c[k]())
    return out


@query("dq_summary", f"""WITH {ALL}, fi AS ({_UNION}) SELECT "check", severity, count(*) AS findings, count(DISTINCT instrument_id) AS instruments, min(CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) AS severity_rank FROM fi GROUP BY 1, 2""")
def dq_summary(spark, sf):
    return Q.summary(some_findings(spark, sf))


_ISSUES = """iss(issue_id, c, i, a, b) AS (VALUES (1, 'zero_volume', NULL::BIGINT, DATE '1996-01-01', DATE '1998-12-31'), (2, 'price_unit', 5, NULL::DATE, NULL::DATE), (3, 'zero_volume', 4, NULL, NULL))"""


def _issues(spark):
    return spark.sql("select * from values (1, 'zero_volume', cast(null as bigint), date'1996-01-01', date'1998-12-31'), (2, 'price_unit', 5L, cast(null as date), cast(null as date)), (3, 'zero_volume', 4L, null, null) t(issue_id, check, instrument_id, date_from, date_to)")


_EXP = f"""{ALL}, fi AS ({_UNION}), {_ISSUES}, ex AS (SELECT instrument_id, trade_date, "check", severity, (SELECT min(issue_id) FROM iss WHERE c = fi."check" AND (i IS NULL OR i = fi.instrument_id) AND (a IS NULL OR fi.trade_date >= a) AND (b IS NULL OR fi.trade_date <= b)) AS issue_id FROM fi)"""


@query("dq_explain", f"""WITH {_EXP} SELECT *, CASE WHEN issue_id IS NULL THEN 'open' ELSE 'explained' END AS state FROM ex""")
def dq_explain(spark, sf):
    return Q.explained(some_findings(spark, sf), _issues(spark)).drop("detail")


@query("dq_blocking", f"""WITH {_EXP} SELECT instrument_id, trade_date, "check" FROM ex WHERE issue_id IS NULL AND severity = 'error'""")
def dq_blocking(spark, sf):
    return Q.explained(some_findings(spark, sf), _issues(spark)).where("state = 'open' and severity = 'error'").select("instrument_id", "trade_date", "check")


@query("dq_findings_upsert", f"""WITH {ALL}, fi AS ({_UNION}), s AS (SELECT DISTINCT instrument_id, "check", trade_date FROM fi WHERE instrument_id % 2 = 0), f AS (SELECT DISTINCT instrument_id, "check", trade_date FROM fi WHERE instrument_id % 3 = 0)
SELECT coalesce(s.instrument_id, f.instrument_id) AS instrument_id, coalesce(s."check", f."check") AS "check", coalesce(s.trade_date, f.trade_date) AS trade_date, CASE WHEN s.instrument_id IS NULL THEN 'new' WHEN f.instrument_id IS NULL THEN 'resolved' ELSE 'refreshed' END AS state
FROM s FULL JOIN f ON s.instrument_id = f.instrument_id AND s."check" = f."check" AND s.trade_date = f.trade_date""")
def dq_findings_upsert(spark, sf):
    f = some_findings(spark, sf)
    return Q.findings_upsert(f.where("instrument_id % 2 = 0"), f.where("instrument_id % 3 = 0"))


@query("dq_coverage", f"""WITH {D}, ba AS (SELECT *, CASE WHEN instrument_id IN (2, 4) THEN 'adjusted' WHEN instrument_id <> 6 THEN 'raw' END AS price_basis FROM dirty), n AS (SELECT instrument_id, count(*) AS n, min(trade_date) AS a, max(trade_date) AS b FROM ba GROUP BY 1),
s8 AS (SELECT string_agg(concat_ws(':', instrument_id, n, a, b), ',' ORDER BY n, instrument_id) AS shortest FROM (SELECT * FROM n ORDER BY n, instrument_id LIMIT 8)), bs AS (SELECT string_agg(x, ',' ORDER BY x) AS basis FROM (SELECT coalesce(price_basis, 'none') || '=' || count(*) AS x FROM ba GROUP BY price_basis))
SELECT count(*) AS instruments, min(n) AS least, quantile_cont(n, 0.5) AS median, max(n) AS most, any_value(shortest) AS shortest, any_value(basis) AS basis FROM n, s8, bs""")
def dq_coverage(spark, sf):
    basis = F.when(F.col("instrument_id").isin(2, 4), "adjusted").when(F.col("instrument_id") != 6, "raw")
    return Q.coverage(P.bars_dirty(spark, sf).withColumn("price_basis", basis))


@query("dq_findings_pivot", f"""WITH {_EXP} SELECT "check", severity, count(*) FILTER (issue_id IS NULL) AS open, count(*) FILTER (issue_id IS NOT NULL) AS explained FROM ex GROUP BY 1, 2""")
def dq_findings_pivot(spark, sf):
    return Q.findings_pivot(Q.explained(some_findings(spark, sf), _issues(spark)))


@query("data_day_checks", f"""WITH {M}, l AS (SELECT instrument_id, max(trade_date) AS d FROM bars WHERE trade_date <= DATE '1999-03-10' AND instrument_id <> 8 GROUP BY 1)
SELECT count(*) AS members, count(*) FILTER (d = DATE '1999-03-10') AS with_bar, count(*) FILTER (d IS NULL OR DATE '1999-03-10' - d > 10) AS stale FROM ins LEFT JOIN l USING (instrument_id)""")
def data_day_checks(spark, sf):
    return Q.day_checks(P.instruments(spark, sf), P.bars(spark, sf).where("instrument_id != 8"), "1999-03-10")
