"""Panel inputs derived from the star schema: bars per brand and what a market database keeps beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.columns import rnd


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line item: instrument_id (rank of the brand), trade_date, price, quantity, seq."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    brands = part.select("p_brand").distinct()  # as many rows as there are brands
    ids = brands.withColumn("instrument_id", F.dense_rank().over(Window.orderBy("p_brand")).cast("bigint"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    keyed = part.join(F.broadcast(ids), "p_brand")
    return lines.join(keyed, lines.l_partkey == keyed.p_partkey).select(
        "instrument_id", F.col("l_shipdate").cast("date").alias("trade_date"), rnd(F.col("l_extendedprice") / F.col("l_quantity"), 4).alias("price"),
        F.col("l_quantity").alias("quantity"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("seq"),
    )


def bar_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored daily bars, partitioned by year: derived from the line items once in an application."""
    from barloom.sources.store import stored_once

    return stored_once(spark, sf_dir, lambda: derived_bars(spark, sf_dir))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: instrument_id, trade_date, open, high, low, close, volume, n_trades."""
    return bar_table(spark, sf_dir).drop("year")


def derived_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars from line items: first, highest, lowest and last price of an instrument's day, and its volume."""
    return trades(spark, sf_dir).groupBy("instrument_id", "trade_date").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
        F.sum("quantity").alias("volume"), F.count("*").alias("n_trades"),
    )


BARS = """
tr AS (SELECT i.instrument_id, CAST(l.l_shipdate AS DATE) AS trade_date, floor(l.l_extendedprice / l.l_quantity * 10000.0 + 0.5) / 10000.0 AS price,
              l.l_quantity AS quantity, l.l_orderkey * 16 + l.l_linenumber AS seq
       FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
       JOIN (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) AS instrument_id FROM (SELECT DISTINCT p_brand FROM part)) i ON i.p_brand = p.p_brand),
bars AS (SELECT instrument_id, trade_date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close,
                sum(quantity) AS volume, count(*) AS n_trades FROM tr GROUP BY ALL)"""


def day_key(date: str = "trade_date"):
    """Days since 1995-01-01: what the derived tables vary by."""
    return F.datediff(F.col(date), F.lit("1995-01-01").cast("date"))


def bars_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with planted faults: a high below the close, no volume, a price a thousand times too large, days missing."""
    k = F.pmod(day_key() + F.col("instrument_id") * 13, F.lit(97))
    b = bars(spark, sf_dir).withColumn("k", k).where("k != 5")
    return b.select(
        "instrument_id", "trade_date", "open",
        F.when(F.col("k") == 1, F.col("close") - 1).otherwise(F.col("high")).alias("high"), "low",
        F.when(F.col("k") == 3, F.col("close") * 1000).when(F.col("k") == 7, F.lit(0.0)).otherwise(F.col("close")).alias("close"),
        F.when(F.col("k") == 2, F.lit(0.0)).when(F.col("k") == 4, F.col("volume") * 100).otherwise(F.col("volume")).alias("volume"), "n_trades",
    )


DIRTY = BARS + """,
dk AS (SELECT *, (date_diff('day', DATE '1995-01-01', trade_date) + instrument_id * 13) % 97 AS k FROM bars),
dirty AS (SELECT instrument_id, trade_date, open, CASE WHEN k = 1 THEN close - 1 ELSE high END AS high, low,
                 CASE WHEN k = 3 THEN close * 1000 WHEN k = 7 THEN 0.0 ELSE close END AS close,
                 CASE WHEN k = 2 THEN 0.0 WHEN k = 4 THEN volume * 100 ELSE volume END AS volume, n_trades FROM dk WHERE k <> 5)"""


def bars_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later fetch: only 1999 on, some closes changed, three days added after the last of every fifth instrument."""
    b = bars(spark, sf_dir).where(F.col("trade_date") >= "1999-01-01")
    k = F.pmod(day_key() + F.col("instrument_id"), F.lit(41))
    changed = b.withColumn("close", F.when(k == 0, rnd(F.col("close") * 1.05, 4)).otherwise(F.col("close")))
    last = b.where(F.col("instrument_id") % 5 == 0).groupBy("instrument_id").agg(F.max_by(F.struct("trade_date", "open", "high", "low", "close", "volume", "n_trades"), "trade_date").alias("x"))
    new = last.select("instrument_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("d"), "x.*").withColumn("trade_date", F.expr("date_add(trade_date, d)"))
    return changed.unionByName(new.drop("d"))


NEXT = BARS + """,
nb AS (SELECT * FROM bars WHERE trade_date >= DATE '1999-01-01'),
nl AS (SELECT * FROM nb WHERE instrument_id % 5 = 0 QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date DESC) = 1),
nxt AS (SELECT instrument_id, trade_date, open, high, low,
               CASE WHEN (date_diff('day', DATE '1995-01-01', trade_date) + instrument_id) % 41 = 0 THEN floor(close * 1.05 * 10000.0 + 0.5) / 10000.0 ELSE close END AS close, volume, n_trades FROM nb
        UNION ALL SELECT instrument_id, CAST(trade_date + CAST(d AS INTEGER) AS DATE), open, high, low, close, volume, n_trades FROM nl, (SELECT unnest([1, 2, 3]) AS d))"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates on which at least half of the active instruments traded, numbered from 1."""
    from barloom.operators.ingest import consensus_calendar

    return consensus_calendar(bars(spark, sf_dir))


CAL = """
sp AS (SELECT instrument_id, min(trade_date) AS f, max(trade_date) + 10 AS g FROM bars GROUP BY 1),
ds AS (SELECT trade_date, count(DISTINCT instrument_id) AS n FROM bars GROUP BY 1),
cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session_idx FROM (
  SELECT ds.trade_date, any_value(n) AS n, count(*) AS active FROM ds JOIN sp ON ds.trade_date BETWEEN sp.f AND sp.g GROUP BY 1) WHERE n >= greatest(1, 0.5 * active))"""
BARS_CAL = BARS + "," + CAL


def own_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars numbered within their instrument."""
    w = Window.partitionBy("instrument_id").orderBy("trade_date")
    return bars(spark, sf_dir).withColumn("bar_idx", F.row_number().over(w).cast("bigint"))


OWN_BARS = BARS + """,
own AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date) AS bar_idx FROM bars)"""


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark: mean close of each date from 1996-06-01 on."""
    return bars(spark, sf_dir).where(F.col("trade_date") >= "1996-06-01").groupBy("trade_date").agg((F.floor(F.sum(F.floor(F.col("close") * 10000 + 0.5)) / F.count("*")) / 10000.0).alias("close"))


def bench_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback benchmark: highest close of each date."""
    return bars(spark, sf_dir).groupBy("trade_date").agg(F.max("close").alias("close"))


BENCH = """
bench AS (SELECT trade_date, floor(sum(CAST(floor(close * 10000.0 + 0.5) AS BIGINT)) / count(*)) / 10000.0 AS close FROM bars WHERE trade_date >= DATE '1996-06-01' GROUP BY 1),
fallback AS (SELECT trade_date, max(close) AS close FROM bars GROUP BY 1)"""


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("instrument_id").distinct()


def symbol_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers with half-open validity: every seventh instrument was renamed on 1998-07-01."""
    i = instruments(spark, sf_dir)
    exchange = F.element_at(F.array(F.lit("XA"), F.lit("XB"), F.lit("XC")), (F.col("instrument_id") % 3 + 1).cast("int"))
    sym = F.concat(F.lit("S"), F.lpad(F.col("instrument_id").cast("string"), 3, "0"))
    base = i.select("instrument_id", sym.alias("symbol"), exchange.alias("exchange"))
    renamed = F.col("instrument_id") % 7 == 0
    day = F.lit("1998-07-01").cast("date")
    first = base.select("instrument_id", F.when(renamed, F.concat(F.lit("OLD"), "symbol")).otherwise(F.col("symbol")).alias("symbol"), "exchange", F.lit("1995-01-01").cast("date").alias("valid_from"), F.when(renamed, day).alias("valid_to"))
    return first.unionByName(base.where(renamed).select("instrument_id", "symbol", "exchange", day.alias("valid_from"), F.lit(None).cast("date").alias("valid_to")))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Universe membership: staggered starts, every fifth ends on 1999-12-31; CORE holds odd ids, WIDE all."""
    i = instruments(spark, sf_dir)
    rows = i.select(
        "instrument_id", F.expr("date_add(date'1995-01-01', cast(30 * (instrument_id % 7) as int))").alias("valid_from"),
        F.when(F.col("instrument_id") % 5 == 0, F.lit("1999-12-31").cast("date")).alias("valid_to"), F.lit(1.0).alias("weight"),
    )
    return rows.select(F.lit("WIDE").alias("universe"), "*").unionByName(rows.where("instrument_id % 2 = 1").select(F.lit("CORE").alias("universe"), "*"))


def status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh instrument is suspended for 60 days, every thirteenth delisted on 2000-06-01."""
    i = instruments(spark, sf_dir)
    row = lambda rows, status, a, b: rows.select("instrument_id", F.lit(status).alias("status"), F.lit(a).cast("date").alias("valid_from"), F.lit(b).cast("date").alias("valid_to"))
    return row(i.where("instrument_id % 11 = 0"), "suspended", "1997-03-01", "1997-04-30").unionByName(row(i.where("instrument_id % 13 = 0"), "delisted", "2000-06-01", None))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split and a cash dividend of every sixth instrument."""
    i = instruments(spark, sf_dir).where("instrument_id % 6 = 0")
    make = lambda day, kind, ratio, cash: i.select("instrument_id", F.expr(f"date_add(date'{day}', cast(instrument_id as int))").alias("ex_date"), F.lit(kind).alias("action_type"), F.lit(ratio).cast("double").alias("ratio"), F.lit(cash).cast("double").alias("cash"))
    return make("1996-05-01", "split", 1.0, None).unionByName(make("1998-05-01", "dividend", None, 10.0))


MARKET = """
ins AS (SELECT DISTINCT instrument_id FROM tr),
sb AS (SELECT instrument_id, 'S' || lpad(CAST(instrument_id AS VARCHAR), 3, '0') AS symbol, ['XA', 'XB', 'XC'][CAST(instrument_id % 3 + 1 AS BIGINT)] AS exchange FROM ins),
symbols AS (SELECT instrument_id, CASE WHEN instrument_id % 7 = 0 THEN 'OLD' || symbol ELSE symbol END AS symbol, exchange, DATE '1995-01-01' AS valid_from,
                   CASE WHEN instrument_id % 7 = 0 THEN DATE '1998-07-01' END AS valid_to FROM sb
            UNION ALL SELECT instrument_id, symbol, exchange, DATE '1998-07-01', NULL FROM sb WHERE instrument_id % 7 = 0),
mb AS (SELECT instrument_id, CAST(DATE '1995-01-01' + CAST(30 * (instrument_id % 7) AS INTEGER) AS DATE) AS valid_from,
              CASE WHEN instrument_id % 5 = 0 THEN DATE '1999-12-31' END AS valid_to, 1.0::DOUBLE AS weight FROM ins),
membership AS (SELECT 'WIDE' AS universe, * FROM mb UNION ALL SELECT 'CORE', * FROM mb WHERE instrument_id % 2 = 1),
statuses AS (SELECT instrument_id, 'suspended' AS status, DATE '1997-03-01' AS valid_from, DATE '1997-04-30' AS valid_to FROM ins WHERE instrument_id % 11 = 0
             UNION ALL SELECT instrument_id, 'delisted', DATE '2000-06-01', NULL FROM ins WHERE instrument_id % 13 = 0),
actions AS (SELECT instrument_id, CAST(DATE '1996-05-01' + CAST(instrument_id AS INTEGER) AS DATE) AS ex_date, 'split' AS action_type, 1.0::DOUBLE AS ratio, NULL::DOUBLE AS cash FROM ins WHERE instrument_id % 6 = 0
            UNION ALL SELECT instrument_id, CAST(DATE '1998-05-01' + CAST(instrument_id AS INTEGER) AS DATE), 'dividend', NULL, 10.0 FROM ins WHERE instrument_id % 6 = 0)"""
BARS_MARKET = BARS + "," + MARKET


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def vendor_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor answers as JSON of parallel arrays, one per user; every tenth lacks its last close."""
    e = events(spark, sf_dir).where(F.col("value").isNotNull())
    arrays = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.unix_timestamp("ts").alias("t"), "event_id", "value"))).alias("x"))
    t, v = F.transform("x", lambda r: r["t"]), F.transform("x", lambda r: r["value"])
    short = F.when(F.col("user_id") % 10 == 0, F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0)))).otherwise(v)
    return arrays.select("user_id", F.to_json(F.struct(t.alias("t"), v.alias("o"), v.alias("h"), v.alias("l"), short.alias("c"), F.transform("x", lambda r: r["event_id"] % 1000).alias("v"))).alias("payload"))


def intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type."""
    e = events(spark, sf_dir).where(F.col("value").isNotNull()).withColumn("bar_time", F.date_trunc("hour", "ts"))
    at = F.struct("ts", "event_id")
    return e.groupBy(F.col("event_type").alias("instrument"), "bar_time").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume")
    )


INTRADAY = """
intraday AS (SELECT event_type AS instrument, date_trunc('hour', ts) AS bar_time, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
                    arg_max(value, row(ts, event_id)) AS close, count(*) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"""
