"""Sources, ingestion, change capture and calendars as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import rnd
from barloom.operators import ingest as I
from barloom.plans.registry import query
from barloom.sources import panel as P
from barloom.sources import store
from barloom.sources.files import scratch
from barloom.sources.store import in_range

B = P.BARS


@query("scan_bars", f"WITH {B} SELECT instrument_id, trade_date, open, high, low, close, volume FROM bars WHERE instrument_id IN (1, 3, 5, 7) AND trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
def scan_bars(spark, sf):
    rows = in_range(P.bar_table(spark, sf), [1, 3, 5, 7], "1997-01-01", "1998-12-31")
    return rows.select("instrument_id", "trade_date", *I.FIELDS)


@query("scan_calendar", f"WITH {P.BARS_CAL} SELECT trade_date FROM cal WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")
def scan_calendar(spark, sf):
    return I.scan_calendar(P.calendar(spark, sf), "1997-01-01", "1997-12-31")


@query("consensus_calendar", f"WITH {P.BARS_CAL} SELECT trade_date, session_idx FROM cal")
def consensus_calendar(spark, sf):
    return P.calendar(spark, sf)


@query("final_bar_filter", f"WITH {B} SELECT instrument_id, trade_date, close FROM bars WHERE trade_date < DATE '1999-06-15'")
def final_bar_filter(spark, sf):
    return I.final_bars(P.bars(spark, sf), "1999-06-15 15:00:00").select("instrument_id", "trade_date", "close")


@query("incremental_plan", f"""WITH {P.BARS_MARKET}, s AS (SELECT instrument_id, max(trade_date) AS d FROM bars WHERE instrument_id % 4 <> 0 GROUP BY 1)
SELECT instrument_id, CASE WHEN d IS NULL THEN DATE '1995-06-01' ELSE greatest(DATE '1995-06-01', CAST(d - 10 AS DATE)) END AS fetch_from, CASE WHEN d IS NULL THEN 'full' ELSE 'incremental' END AS mode
FROM ins LEFT JOIN s USING (instrument_id)""")
def incremental_plan(spark, sf):
    return I.incremental_plan(P.instruments(spark, sf), P.bars(spark, sf).where("instrument_id % 4 != 0"), "1995-06-01")


_CLASS = P.NEXT + """,
cl AS (SELECT coalesce(n.instrument_id, b.instrument_id) AS instrument_id, coalesce(n.trade_date, b.trade_date) AS trade_date,
  CASE WHEN n.instrument_id IS NULL THEN 'kept' WHEN b.instrument_id IS NULL THEN 'inserted'
       WHEN (n.open, n.high, n.low, n.close, n.volume) = (b.open, b.high, b.low, b.close, b.volume) THEN 'unchanged' ELSE 'updated' END AS change,
  coalesce(n.close, b.close) AS close, b.close AS old_close
  FROM bars b FULL JOIN nxt n ON b.instrument_id = n.instrument_id AND b.trade_date = n.trade_date)"""


def _classified(spark, sf):
    return I.upsert(P.bars(spark, sf), P.bars_next(spark, sf), ["instrument_id", "trade_date"])


@query("bar_upsert_classify", f"WITH {_CLASS} SELECT instrument_id, trade_date, change, close FROM cl")
def bar_upsert_classify(spark, sf):
    return _classified(spark, sf).select("instrument_id", "trade_date", "change", "row.close")


@query("bar_store_upsert", f"WITH {_CLASS} SELECT CAST(year(trade_date) AS INTEGER) AS year, change, count(*) AS n FROM cl WHERE year(trade_date) IN (SELECT year(trade_date) FROM nxt) GROUP BY 1, 2")
def bar_store_upsert(spark, sf):
    """A later fetch merged into a stored copy of the bars: counts by year and change; years that it doesn't touch stay as they were."""
    path = scratch(spark, "bars")
    store.write_bars(P.bars(spark, sf), path)
    return store.upsert_bars(spark, path, P.bars_next(spark, sf), scratch(spark, "revisions"))


@query("bar_revisions", f"WITH {_CLASS} SELECT instrument_id, trade_date, old_close AS close FROM cl WHERE change = 'updated'")
def bar_revisions(spark, sf):
    return _classified(spark, sf).where("change = 'updated'").select("instrument_id", "trade_date", "old.close")


@query("ingest_run_stats", f"""WITH {_CLASS} SELECT instrument_id, count(*) FILTER (change = 'inserted') AS inserted, count(*) FILTER (change = 'updated') AS updated,
count(*) FILTER (change = 'unchanged') AS unchanged FROM cl WHERE change <> 'kept' GROUP BY ROLLUP (instrument_id)""")
def ingest_run_stats(spark, sf):
    return I.ingest_stats(_classified(spark, sf).where("change != 'kept'"))


@query("bar_drift", f"""WITH {P.NEXT} SELECT b.instrument_id, count(*) FILTER (b.close = 0 OR abs(n.close - b.close) / b.close > 0.001) AS n_off,
bool_or(b.close = 0 OR abs(n.close - b.close) / b.close > 0.001) AS drifted FROM bars b JOIN nxt n USING (instrument_id, trade_date) GROUP BY 1""")
def bar_drift(spark, sf):
    return I.drifted(P.bars(spark, sf), P.bars_next(spark, sf))


@query("intraday_upsert", f"""WITH {P.INTRADAY}, o AS (SELECT * FROM intraday WHERE bar_time < TIMESTAMP '2024-01-20'),
n AS (SELECT * REPLACE (CASE WHEN hour(bar_time) = 5 THEN close + 1 ELSE close END AS close) FROM intraday WHERE bar_time >= TIMESTAMP '2024-01-18')
SELECT coalesce(n.instrument, o.instrument) AS instrument, coalesce(n.bar_time, o.bar_time) AS bar_time,
CASE WHEN n.instrument IS NULL THEN 'kept' WHEN o.instrument IS NULL THEN 'inserted' WHEN (n.open, n.high, n.low, n.close, n.volume) = (o.open, o.high, o.low, o.close, o.volume) THEN 'unchanged' ELSE 'updated' END AS change
FROM o FULL JOIN n ON o.instrument = n.instrument AND o.bar_time = n.bar_time""")
def intraday_upsert(spark, sf):
    x = P.intraday(spark, sf)
    old, new = x.where("bar_time < timestamp'2024-01-20'"), x.where("bar_time >= timestamp'2024-01-18'").withColumn("close", F.when(F.hour("bar_time") == 5, F.col("close") + 1).otherwise(F.col("close")))
    return I.upsert(old, new, ["instrument", "bar_time"]).select("instrument", "bar_time", "change")


@query("calendar_sync", f"""WITH {P.BARS_CAL}, st AS (SELECT trade_date FROM cal WHERE session_idx % 50 <> 0 UNION SELECT DATE '2030-01-01')
SELECT coalesce(st.trade_date, cal.trade_date) AS trade_date, CASE WHEN st.trade_date IS NULL THEN 'added' ELSE 'removed' END AS action FROM st FULL JOIN cal ON st.trade_date = cal.trade_date WHERE st.trade_date IS NULL OR cal.trade_date IS NULL""")
def calendar_sync(spark, sf):
    cal = P.calendar(spark, sf)
    return I.calendar_sync(cal.where("session_idx % 50 != 0").select("trade_date").unionByName(spark.sql("select date'2030-01-01' as trade_date")), cal)


@query("calendar_gaps", f"""WITH {P.BARS_CAL}, d AS (SELECT CAST(unnest(generate_series((SELECT min(trade_date) FROM cal), (SELECT max(trade_date) FROM cal), INTERVAL 1 DAY)) AS DATE) AS x),
g AS (SELECT x FROM d WHERE isodow(x) <= 5 AND x NOT IN (SELECT trade_date FROM cal))
SELECT CAST(year(x) AS INTEGER) AS year, count(*) FILTER (x NOT IN (SELECT trade_date FROM bars)) AS no_bar, count(*) FILTER (x IN (SELECT trade_date FROM bars)) AS partial FROM g GROUP BY 1""")
def calendar_gaps(spark, sf):
    return I.calendar_gaps(P.calendar(spark, sf), P.bars(spark, sf))


_WINDOW = "valid_from <= DATE '2000-12-31' AND (valid_to IS NULL OR valid_to > DATE '2000-01-01')"
_LABELS = f"""SELECT instrument_id, arg_min(label, r) AS label FROM (SELECT instrument_id, 'core' AS label, 0 AS r FROM membership WHERE universe = 'CORE' AND {_WINDOW}
UNION ALL SELECT instrument_id, 'wide', 1 FROM membership WHERE universe = 'WIDE' AND {_WINDOW} UNION ALL SELECT instrument_id, 'index', 2 FROM ins WHERE instrument_id <= 2) GROUP BY 1"""


def _labelled(spark, sf):
    m = P.membership(spark, sf).where(_WINDOW)
    name = lambda u: m.where(F.col("universe") == u).select("instrument_id", F.lit(u.lower()).alias("label"))
    return I.first_label(name("CORE"), name("WIDE"), P.instruments(spark, sf).where("instrument_id <= 2").withColumn("label", F.lit("index")))


@query("ingest_targets", f"WITH {P.BARS_MARKET} {_LABELS}")
def ingest_targets(spark, sf):
    return _labelled(spark, sf)


@query("quality_targets", f"WITH {P.BARS_MARKET}, x AS ({_LABELS}) SELECT label, count(*) AS n FROM x GROUP BY 1")
def quality_targets(spark, sf):
    return _labelled(spark, sf).groupBy("label").agg(F.count("*").alias("n"))


@query("readiness", f"""WITH {P.BARS_MARKET}, s AS (SELECT instrument_id, count(*) AS n FROM bars WHERE trade_date <= DATE '1996-01-31' AND instrument_id <> 4 GROUP BY 1)
SELECT instrument_id, coalesce(n, 0) AS sessions, coalesce(n, 0) >= 200 AS ready, CASE WHEN coalesce(n, 0) < 200 THEN 'has ' || coalesce(n, 0) || ' of 200 sessions' END AS reason FROM ins LEFT JOIN s USING (instrument_id)""")
def readiness(spark, sf):
    return I.readiness(P.instruments(spark, sf), P.bars(spark, sf).where("instrument_id != 4"), "1996-01-31", 200)


@query("new_instruments", f"WITH {P.BARS_MARKET} SELECT instrument_id FROM ins WHERE instrument_id NOT IN (SELECT instrument_id FROM bars WHERE instrument_id % 3 <> 0)")
def new_instruments(spark, sf):
    return I.without_bars(P.instruments(spark, sf), P.bars(spark, sf).where("instrument_id % 3 != 0"))


@query("readiness_alert_sync", f"""WITH {P.BARS_MARKET}, o AS (SELECT instrument_id FROM ins WHERE instrument_id % 2 = 0), b AS (SELECT instrument_id FROM ins WHERE instrument_id % 3 = 0)
SELECT coalesce(o.instrument_id, b.instrument_id) AS instrument_id, CASE WHEN o.instrument_id IS NULL THEN 'open' WHEN b.instrument_id IS NULL THEN 'acknowledge' ELSE 'keep' END AS action FROM o FULL JOIN b ON o.instrument_id = b.instrument_id""")
def readiness_alert_sync(spark, sf):
    i = P.instruments(spark, sf)
    return I.readiness_alerts(i.where("instrument_id % 2 = 0"), i.where("instrument_id % 3 = 0"))


_REV = P.BARS + """,
rev AS (SELECT instrument_id, trade_date, open, high, low, close * 0.5 AS close, volume, TIMESTAMP '2003-01-01' AS superseded_at FROM bars WHERE instrument_id % 2 = 0 AND day(trade_date) = 10
        UNION ALL SELECT instrument_id, trade_date, open, high, low, close * 2, volume, TIMESTAMP '2002-06-01' FROM bars WHERE instrument_id % 4 = 0 AND day(trade_date) = 10)"""


@query("bars_as_known", f"""WITH {_REV}, w AS (SELECT * FROM rev WHERE superseded_at > TIMESTAMP '2002-01-01' QUALIFY row_number() OVER (PARTITION BY instrument_id, trade_date ORDER BY superseded_at) = 1)
SELECT b.instrument_id, b.trade_date, coalesce(w.close, b.close) AS close, w.close IS NOT NULL AS revised FROM bars b LEFT JOIN w ON w.instrument_id = b.instrument_id AND w.trade_date = b.trade_date
WHERE b.trade_date <= DATE '2002-01-01' QUALIFY row_number() OVER (PARTITION BY b.instrument_id ORDER BY b.trade_date DESC) <= 250""")
def bars_as_known(spark, sf):
    b = P.bars(spark, sf)
    cut = b.where(F.dayofmonth("trade_date") == 10)
    rev = cut.where("instrument_id % 2 = 0").withColumns({"close": F.col("close") * 0.5, "superseded_at": F.lit("2003-01-01").cast("timestamp")})
    rev = rev.unionByName(cut.where("instrument_id % 4 = 0").withColumns({"close": F.col("close") * 2, "superseded_at": F.lit("2002-06-01").cast("timestamp")}))
    return I.as_known(b, rev, F.lit("2002-01-01").cast("timestamp"), 250).select("instrument_id", "trade_date", "close", "revised")


@query("bar_fingerprint", f"""WITH {B}, l AS (SELECT instrument_id, trade_date, concat_ws('|', CAST(trade_date AS VARCHAR), CAST(floor(open * 10000 + 0.5) AS BIGINT), CAST(floor(high * 10000 + 0.5) AS BIGINT),
CAST(floor(low * 10000 + 0.5) AS BIGINT), CAST(floor(close * 10000 + 0.5) AS BIGINT), CAST(floor(volume * 10000 + 0.5) AS BIGINT)) AS line FROM bars)
SELECT instrument_id, sha256(string_agg(line, chr(10) ORDER BY trade_date)) AS fingerprint, count(*) AS n_bars FROM l GROUP BY 1""")
def bar_fingerprint(spark, sf):
    return I.bar_fingerprint(P.bars(spark, sf))


_FACT = P.BARS_MARKET + """,
fa AS (SELECT instrument_id, ex_date AS effective_date, CASE WHEN action_type = 'split' THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS factor, 2 AS version FROM actions
       UNION ALL SELECT instrument_id, ex_date, 0.1::DOUBLE, 1 FROM actions)"""


def _factors(spark, sf):
    a = P.actions(spark, sf)
    rows = a.select("instrument_id", F.col("ex_date").alias("effective_date"), F.when(F.col("action_type") == "split", F.lit(0.5)).otherwise(0.9).alias("factor"), F.lit(2).alias("version"))
    return rows.unionByName(a.select("instrument_id", F.col("ex_date").alias("effective_date"), F.lit(0.1).alias("factor"), F.lit(1).alias("version")))


@query("price_adjusted", f"""WITH {_FACT}, n AS (SELECT * FROM fa QUALIFY version = max(version) OVER (PARTITION BY instrument_id)),
p AS (SELECT b.instrument_id, b.trade_date, any_value(b.close) AS close, any_value(b.volume) AS volume, coalesce(product(n.factor), 1) AS f FROM bars b LEFT JOIN n ON n.instrument_id = b.instrument_id AND n.effective_date > b.trade_date GROUP BY 1, 2)
SELECT instrument_id, trade_date, floor(close * f * 10000.0 + 0.5) / 10000.0 AS close, volume FROM p""")
def price_adjusted(spark, sf):
    return I.adjusted_prices(P.bars(spark, sf), _factors(spark, sf)).select("instrument_id", "trade_date", "close", "volume")


_GAP = P.BARS_CAL + """,
gp AS (SELECT instrument_id, trade_date, open, lag(close) OVER w AS prev, session_idx - lag(session_idx) OVER w AS k FROM bars JOIN cal USING (trade_date) WINDOW w AS (PARTITION BY instrument_id ORDER BY trade_date)),
gc AS (SELECT instrument_id, trade_date AS ex_date, open / prev - 1 AS gap, k FROM gp WHERE prev IS NOT NULL AND (open / prev - 1 < pow(0.93::DOUBLE, k) - 1 - 0.005::DOUBLE OR open / prev - 1 > pow(1.07::DOUBLE, k) - 1 + 0.005::DOUBLE))"""


def _gaps(spark, sf):
    return I.gap_candidates(P.bars(spark, sf), P.calendar(spark, sf), 0.07, 0.005)


@query("gap_candidates", f"WITH {_GAP} SELECT instrument_id, ex_date, floor(gap * 1000000 + 0.5) / 1000000 AS gap, k AS sessions FROM gc")
def gap_candidates(spark, sf):
    return _gaps(spark, sf)


@query("candidate_lifecycle", f"""WITH {_GAP}, st AS (SELECT instrument_id, CASE WHEN instrument_id % 3 = 0 THEN CAST(ex_date + 1 AS DATE) ELSE ex_date END AS ex_date FROM gc WHERE instrument_id % 2 = 1)
SELECT coalesce(st.instrument_id, gc.instrument_id) AS instrument_id, coalesce(st.ex_date, gc.ex_date) AS ex_date, CASE WHEN st.instrument_id IS NULL THEN 'new' WHEN gc.instrument_id IS NULL THEN 'stale' ELSE 'refreshed' END AS state
FROM st FULL JOIN gc ON st.instrument_id = gc.instrument_id AND st.ex_date = gc.ex_date""")
def candidate_lifecycle(spark, sf):
    g = _gaps(spark, sf)
    stored = g.where("instrument_id % 2 = 1").select("instrument_id", F.when(F.col("instrument_id") % 3 == 0, F.date_add("ex_date", 1)).otherwise(F.col("ex_date")).alias("ex_date"))
    return I.candidate_lifecycle(stored, g)


_ADJ = P.BARS_MARKET + """,
lp AS (SELECT a.instrument_id, a.ex_date, arg_max(b.close, b.trade_date) AS p FROM actions a JOIN bars b ON a.instrument_id = b.instrument_id AND b.trade_date < a.ex_date GROUP BY 1, 2),
af AS (SELECT a.instrument_id, a.ex_date, a.action_type, p, cash, CASE WHEN ratio IS NOT NULL AND ratio > -1 THEN 1 / (1 + ratio) WHEN cash IS NOT NULL AND p > cash THEN (p - cash) / p END AS f FROM actions a LEFT JOIN lp USING (instrument_id, ex_date))"""


@query("adj_factor", f"""WITH {_ADJ} SELECT instrument_id, ex_date, action_type, floor(f * 100000000 + 0.5) / 100000000 AS factor,
CASE WHEN f IS NOT NULL THEN NULL WHEN p IS NULL THEN 'no close before ex-date' ELSE 'cash not below close' END AS problem FROM af""")
def adj_factor(spark, sf):
    return I.adjustment_factors(P.actions(spark, sf), P.bars(spark, sf)).withColumn("factor", rnd("factor", 8))


@query("factor_version", f"""WITH {_FACT}, w AS (SELECT instrument_id, list_sort(list(row(effective_date, factor))) AS x FROM fa WHERE version = 2 GROUP BY 1),
h AS (SELECT instrument_id, list_sort(list(row(effective_date, CASE WHEN instrument_id % 12 = 0 THEN factor ELSE factor * 2 END))) AS y, 3 AS v FROM fa WHERE version = 2 AND instrument_id % 18 <> 0 GROUP BY 1)
SELECT instrument_id, CAST(coalesce(v, 0) + CASE WHEN coalesce(x = y, false) THEN 0 ELSE 1 END AS BIGINT) AS version, NOT coalesce(x = y, false) AS changed FROM w LEFT JOIN h USING (instrument_id)""")
def factor_version(spark, sf):
    f = _factors(spark, sf).where("version = 2").select("instrument_id", F.col("effective_date").alias("ex_date"), "factor")
    current = f.where("instrument_id % 18 != 0").withColumns({"factor": F.when(F.col("instrument_id") % 12 == 0, F.col("factor")).otherwise(F.col("factor") * 2), "version": F.lit(3)})
    return I.factor_versions(f, current)


@query("set_price_basis", f"WITH {B} SELECT instrument_id, trade_date, CASE WHEN instrument_id IN (2, 4) THEN 'adjusted' ELSE 'raw' END AS price_basis FROM bars")
def set_price_basis(spark, sf):
    """Relabels two instruments in a stored copy, year by year."""
    path = scratch(spark, "basis")
    store.write_bars(P.bars(spark, sf).withColumn("price_basis", F.lit("raw")), path)
    store.set_price_basis(spark, path, P.instruments(spark, sf).where("instrument_id in (2, 4)"), "adjusted")
    return store.read_bars(spark, path).select("instrument_id", "trade_date", "price_basis")


@query("merge_day_fragments", """SELECT user_id, CAST(ts AS DATE) AS trade_date, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS BIGINT) AS volume, count(*) AS n_fragments
FROM events WHERE value IS NOT NULL GROUP BY 1, 2""")
def merge_day_fragments(spark, sf):
    e = P.events(spark, sf).where("value is not null")
    rows = e.select("user_id", F.col("ts").cast("date").alias("trade_date"), F.struct("ts", "event_id").alias("at"), *[F.col("value").alias(c) for c in ("open", "high", "low", "close")], F.lit(1).cast("bigint").alias("volume"))
    return I.merge_fragments(rows, ["user_id", "trade_date"], F.col("at"))


@query("dedupe_keep_last", """SELECT user_id, event_type, date_trunc('hour', ts) AS ts, arg_max(value, event_id) AS value, count(*) - 1 AS n_replaced FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3""")
def dedupe_keep_last(spark, sf):
    e = P.events(spark, sf).where("value is not null").select("user_id", "event_type", F.date_trunc("hour", "ts").alias("ts"), "event_id", "value")
    return I.keep_last(e, ["user_id", "event_type", "ts"], "event_id").drop("event_id")


@query("normalize_vendor_bars", """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id, value FROM events WHERE value IS NOT NULL AND user_id % 10 <> 0)
SELECT user_id, CAST((to_timestamp(t) AT TIME ZONE 'UTC' + INTERVAL 7 HOUR) AS DATE) AS trade_date, t, CAST(CAST(CAST(value AS DECIMAL(18,4)) * 10 AS DECIMAL(18,4)) AS DOUBLE) AS close, event_id % 1000 AS volume FROM e""")
def normalize_vendor_bars(spark, sf):
    return I.vendor_bars(P.vendor_payloads(spark, sf), "user_id", 10, "Asia/Bangkok").select("user_id", "trade_date", "t", "close", "volume")
