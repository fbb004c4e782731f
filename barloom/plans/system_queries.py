"""Files, streams and models as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import rnd
from barloom.operators import models as M
from barloom.plans.feature_queries import DATASET, dataset, fl
from barloom.plans.metric_queries import DONE, EQ, done, equity
from barloom.plans.registry import query
from barloom.sources import files as S
from barloom.sources import panel as P
from barloom.streaming import bars as Z

_H = "CAST(('0x' || substr(md5(concat_ws('|', {cols})), 1, 8)) AS BIGINT)"


def _text(*cols: str) -> str:
    return _H.format(cols=", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in cols))


_CAL_HASH = P.BARS_CAL + f", hh AS (SELECT {_text('session_idx', 'trade_date')} AS h FROM cal)"


@query("content_hash", f"WITH {_CAL_HASH} SELECT count(*) AS n_rows, CAST(coalesce(sum(h), 0) AS BIGINT) AS h_sum, coalesce(bit_xor(h), 0) AS h_xor FROM hh")
def content_hash(spark, sf):
    return S.content_hash(P.calendar(spark, sf))


@query("dataset_manifest", f"WITH {DATASET} SELECT count(*) AS n_rows, count(DISTINCT trade_date) AS n_dates, count(DISTINCT instrument_id) AS n_instruments, min(trade_date) AS first_date, max(trade_date) AS last_date, "
       + ", ".join(f"{fl(f'(count(*) - count({c})) / nullif(count(*), 0)')} AS null_{c}" for c in ("f_ret_5", "fwd_ret_5", "fwd_end_5")) + " FROM ds_")
def dataset_manifest(spark, sf):
    m = S.manifest(dataset(spark, sf))
    return m.select(*[rnd(c).alias(c) if c.startswith("null_") else F.col(c) for c in m.columns])


@query("write_dataset", f"WITH {DATASET} SELECT * FROM ds_")
def write_dataset(spark, sf):
    df = dataset(spark, sf)
    S.write_dataset(df, path := S.scratch(spark, "dataset"))
    return S.read_dataset(spark, path)


@query("read_dataset", f"WITH {DATASET} SELECT instrument_id, count(*) AS n FROM ds_ GROUP BY 1")
def read_dataset(spark, sf):
    df = dataset(spark, sf)
    S.write_dataset(df, path := S.scratch(spark, "dataset"))
    return S.read_dataset(spark, path, S.content_hash(df)).groupBy("instrument_id").agg(F.count("*").alias("n"))


_BUILDS = f"""{P.BARS}, b AS (SELECT 'r' || instrument_id % 3 AS recipe, 'c' || instrument_id % 4 AS content, instrument_id AS built FROM (SELECT DISTINCT instrument_id FROM bars)), v AS (SELECT recipe, content, min(built) AS first_built FROM b GROUP BY 1, 2), vv AS (SELECT *, row_number() OVER (PARTITION BY recipe ORDER BY first_built) AS version FROM v)"""


def _builds(spark, sf):
    i = P.bars(spark, sf).select("instrument_id").distinct()
    return S.resolve_versions(i.select(F.concat(F.lit("r"), F.col("instrument_id") % 3).alias("recipe"), F.concat(F.lit("c"), F.col("instrument_id") % 4).alias("content"), F.col("instrument_id").alias("built")))


@query("dataset_version_resolve", f"WITH {_BUILDS} SELECT *, row_number() OVER (PARTITION BY recipe ORDER BY version DESC) <= 2 OR version = 1 AND recipe <> 'r1' AS kept FROM vv")
def dataset_version_resolve(spark, sf):
    """Versions of each recipe, and whether one is kept: the two newest, and the first of two recipes, which models use."""
    v = _builds(spark, sf)
    return S.retained(v, v.where("version = 1 and recipe != 'r1'").select("recipe", "version"), 2)


@query("load_latest_dataset", f"WITH {_BUILDS} SELECT recipe, arg_max(content, version) AS content, max(version) AS version FROM vv GROUP BY 1")
def load_latest_dataset(spark, sf):
    return _builds(spark, sf).groupBy("recipe").agg(F.max_by("content", "version").alias("content"), F.max("version").alias("version"))


@query("table_fingerprint", f"""SELECT 'part' AS name, count(*) AS n_rows, CAST(sum({_text('p_brand', 'p_partkey', 'p_size', 'p_type')}) AS BIGINT) AS h_sum, bit_xor({_text('p_brand', 'p_partkey', 'p_size', 'p_type')}) AS h_xor FROM part
UNION ALL SELECT 'nation', count(*), CAST(sum({_text('n_name', 'n_nationkey', 'n_regionkey')}) AS BIGINT), bit_xor({_text('n_name', 'n_nationkey', 'n_regionkey')}) FROM nation""")
def table_fingerprint(spark, sf):
    a = P.table(spark, sf, "part").select("p_brand", "p_partkey", "p_size", "p_type")
    b = P.table(spark, sf, "nation").select("n_name", "n_nationkey", "n_regionkey")
    return S.content_hash(a).select(F.lit("part").alias("name"), "*").unionByName(S.content_hash(b).select(F.lit("nation").alias("name"), "*"))


_STORE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("store_compare", " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS rows_a, " + {"supplier": "NULL", "part": "count(*) FILTER (p_size <> 1)", "nation": "count(*)", "orders": "count(*)"}.get(t, "count(*)")
    + " AS rows_b, '" + {"supplier": "missing in b", "part": "differs", "nation": "differs", "orders": "columns differ"}.get(t, "same") + f"' AS state FROM {t}" for t in _STORE))
def store_compare(spark, sf):
    """All tables and columns against a second store in which parts of size 1 are gone, a nation is renamed, orders lack a column and suppliers are missing."""
    a = {t: P.table(spark, sf, t) for t in _STORE}
    b = {t: df for t, df in a.items() if t != "supplier"}
    b["part"] = a["part"].where("p_size != 1")
    b["nation"] = a["nation"].withColumn("n_name", F.when(F.col("n_nationkey") == 3, "renamed").otherwise(F.col("n_name")))
    b["orders"] = a["orders"].drop("o_orderdate")
    return S.compared(S.fingerprints(a), S.fingerprints(b))


@query("equity_csv_sink", f"WITH {EQ} SELECT portfolio, trade_date, {fl('equity')} AS equity FROM eq")
def equity_csv_sink(spark, sf):
    path = S.scratch(spark, "equity")
    equity(spark, sf).select("portfolio", "trade_date", F.format_string("%.6f", "equity").alias("equity")).write.option("header", True).csv(path)
    return spark.read.schema("portfolio bigint, trade_date date, equity double").option("header", True).csv(path)


_SNAPROWS = P.BARS_MARKET + """, sr AS (SELECT CASE WHEN instrument_id = 4 THEN '' WHEN instrument_id = 6 THEN 'S005' ELSE symbol END AS symbol, CASE WHEN instrument_id = 7 THEN symbol END AS previous_symbol, CASE WHEN instrument_id = 8 THEN 'QQ' ELSE exchange END AS exchange,
 CASE WHEN instrument_id = 9 THEN 1.5::DOUBLE ELSE 0.5 END AS weight, CASE WHEN instrument_id = 10 THEN 'gone' ELSE 'active' END AS status FROM symbols WHERE valid_to IS NULL)"""


@query("read_snapshot_csv", f"""WITH {_SNAPROWS}, j AS (SELECT symbol, CASE WHEN symbol = '' THEN 'empty symbol' WHEN count(*) OVER (PARTITION BY symbol) > 1 THEN 'repeated symbol' WHEN exchange = 'QQ' THEN 'unknown exchange' WHEN status = 'gone' THEN 'unknown status' WHEN weight > 1 THEN 'weight outside [0, 1]' WHEN previous_symbol = symbol THEN 'renamed to itself' END AS problem FROM sr)
SELECT coalesce(problem, 'accepted') AS outcome, count(*) AS n FROM j GROUP BY 1""")
def read_snapshot_csv(spark, sf):
    s = P.symbol_history(spark, sf).where("valid_to is null")
    i = F.col("instrument_id")
    rows = s.select(
        F.when(i == 4, " ").when(i == 6, " s005 ").otherwise(F.lower("symbol")).alias("symbol"), F.when(i == 7, F.col("symbol")).alias("previous_symbol"), F.when(i == 8, "QQ").otherwise(F.col("exchange")).alias("exchange"),
        F.when(i == 9, "1.5").otherwise("0.5").alias("weight"), F.when(i == 10, "gone").otherwise("active").alias("status"),
    )
    rows.write.option("header", True).csv(path := S.scratch(spark, "snapshot"))
    good, bad = S.snapshot_csv(spark, path, ("XA", "XB", "XC"))
    outcome = good.select(F.lit("accepted").alias("outcome")).unionByName(bad.select(F.col("problem").alias("outcome")))
    return outcome.groupBy("outcome").agg(F.count("*").alias("n"))


@query("read_candidates", "SELECT DISTINCT upper(trim(split_part(p_name, '#', 1))) AS symbol FROM part")
def read_candidates(spark, sf):
    P.table(spark, sf, "part").select(F.concat("p_name", F.lit(" # note")).alias("value")).write.text(path := S.scratch(spark, "candidates"))
    return S.candidates(spark, path).select("symbol")


# streams


@query("stream_intraday_bars", """WITH b AS (SELECT event_type AS instrument, date_trunc('hour', ts) AS bar_time, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT * FROM b WHERE bar_time + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events WHERE value IS NOT NULL) - INTERVAL 1 HOUR""")
def stream_intraday_bars(spark, sf):
    return Z.drained(Z.hourly_bars(Z.event_stream(spark, f"{sf}/events.parquet"), "1 hour"), "bars")


@query("stream_upsert", """WITH n AS (SELECT event_id, user_id, value FROM events WHERE value IS NOT NULL), o AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END AS value FROM n WHERE event_id % 2 = 0)
SELECT 0 AS batch, event_id, 'inserted' AS change FROM o UNION ALL SELECT 1, n.event_id, CASE WHEN o.event_id IS NULL THEN 'inserted' WHEN (o.user_id, o.value) = (n.user_id, n.value) THEN 'unchanged' ELSE 'updated' END FROM n LEFT JOIN o USING (event_id)""")
def stream_upsert(spark, sf):
    rows = P.events(spark, sf).where("value is not null").select("event_id", "user_id", "value")
    first = rows.where("event_id % 2 = 0").withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("value") + 1).otherwise(F.col("value")))
    path = S.scratch(spark, "fetches")  # two fetches, each a file: the second meets what the first left
    for part in (first, rows):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return Z.upserted(stream, "upserts", ["event_id"], ("user_id", "value"), F.floor(F.col("event_id") / 1000)).select(F.col("batch").cast("int").alias("batch"), "event_id", "change")


@query("stream_alert_dedupe", """WITH RECURSIVE out_ AS (SELECT user_id, event_type, arg_min(event_id, row(ts, event_id)) AS event_id, min(ts) AS ts FROM events GROUP BY 1, 2
UNION ALL SELECT user_id, event_type, event_id, ts FROM (SELECT e.user_id, e.event_type, e.event_id, e.ts, row_number() OVER (PARTITION BY e.user_id, e.event_type ORDER BY e.ts, e.event_id) AS k FROM out_ o JOIN events e ON e.user_id = o.user_id AND e.event_type = o.event_type AND e.ts > o.ts + INTERVAL 36 HOUR) WHERE k = 1)
SELECT event_id FROM out_""")
def stream_alert_dedupe(spark, sf):
    stream = Z.suppressed(Z.event_stream(spark, f"{sf}/events.parquet"), 36, ["user_id", "event_type"])
    return Z.drained(stream, "alerts")


@query("alert_gap_dedupe", """WITH a AS (SELECT event_id, user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) SELECT event_id FROM a WHERE p IS NULL OR ts - p > INTERVAL 36 HOUR""")
def alert_gap_dedupe(spark, sf):
    """Alerts after 36 hours of silence: the gap is to the alert before, whether that one went out or not (stream_alert_dedupe asks for one that did)."""
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return P.events(spark, sf).withColumn("p", before).where("p is null or ts - p > interval 36 hours").select("event_id")


# models: compared on behaviour in the tests, as no SQL fits them

FEATURES = ["score", "proba", "holding_d"]


def _model_rows(spark, sf):
    return done(spark, sf).where("model_id = 'A'").select("instrument_id", "trade_date", "fold", "score", "proba", F.col("holding").cast("double").alias("holding_d"), "fwd", "label").cache()


@query("ml_linear")
def ml_linear(spark, sf):
    rows = _model_rows(spark, sf)
    model = M.fit_linear(rows.where("fold < 4"), FEATURES, "fwd", 0.01)
    return M.linear_contributions(model, rows.where("fold >= 4"), FEATURES).select("instrument_id", "trade_date", "score_ml", "contributions")


@query("ml_rank_gbt")
def ml_rank_gbt(spark, sf):
    """Trees on the rank of the forward return among its date's; fold 3 stops the boosting."""
    rows = M.forward_rank(_model_rows(spark, sf), "fwd", "fwd_rank").withColumn("held", F.col("fold") == 3)
    return M.fit_rank_trees(rows.where("fold < 4"), FEATURES, "fwd_rank", 20, validation="held").transform(rows.where("fold >= 4")).select("instrument_id", "trade_date", "score_ml")


@query("ml_event_gbt")
def ml_event_gbt(spark, sf):
    rows = _model_rows(spark, sf)
    return M.event_probability(M.fit_event_trees(rows.where("fold < 4"), FEATURES, "label", 5), rows.where("fold >= 4")).select("instrument_id", "trade_date", "proba_ml")


@query("feature_importance")
def feature_importance(spark, sf):
    rows = _model_rows(spark, sf)
    return spark.createDataFrame(M.importances(M.fit_rank_trees(rows.where("fold < 4"), FEATURES, "fwd", 5), FEATURES), "feature string, share double")


@query("calib_isotonic")
def calib_isotonic(spark, sf):
    rows = _model_rows(spark, sf)
    return M.fit_isotonic(rows.where("fold < 4"), "proba", "label").transform(rows.where("fold >= 4").withColumnRenamed("proba", "p")).select("instrument_id", "trade_date", "calibrated")


@query("calib_platt")
def calib_platt(spark, sf):
    rows = _model_rows(spark, sf)
    out = M.fit_platt(rows.where("fold < 4"), "proba", "label").transform(M.logit(rows.where("fold >= 4"), "proba"))
    from pyspark.ml.functions import vector_to_array

    return out.select("instrument_id", "trade_date", vector_to_array("probability")[1].alias("calibrated"))


@query("wf_predict")
def wf_predict(spark, sf):
    rows = _model_rows(spark, sf)
    folds = [r.fold for r in rows.select("fold").distinct().orderBy("fold").collect()][1:]  # one row per year; the first has nothing before it
    return M.walk_forward(rows, folds, "fold", lambda t: M.fit_linear(t, FEATURES, "fwd", 0.01), lambda m, t: m.transform(t).select("instrument_id", "trade_date", "fold", "score_ml"))


@query("scenario_quantiles", f"""WITH {DONE}, f AS (SELECT * FROM dn WHERE model_id = 'A' AND fold < 4), t AS (SELECT * FROM dn WHERE model_id = 'A' AND fold >= 4), e AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS e FROM f),
q AS (SELECT len(list_filter(e, lambda x: x <= score)) AS b, quantile_cont(fwd, 0.1) AS q10, quantile_cont(fwd, 0.5) AS q50, quantile_cont(fwd, 0.9) AS q90 FROM f, e GROUP BY 1)
SELECT instrument_id, trade_date, {fl('q10')} AS q10, {fl('q50')} AS q50, {fl('q90')} AS q90 FROM t, e LEFT JOIN q ON b = len(list_filter(e, lambda x: x <= score))""")
def scenario_quantiles(spark, sf):
    rows = done(spark, sf).where("model_id = 'A'")
    out = M.scenario_quantiles(rows.where("fold < 4"), rows.where("fold >= 4"), "score", "fwd", 5)
    return out.select("instrument_id", "trade_date", *[rnd(F.col("scenarios")[i]).alias(c) for i, c in enumerate(("q10", "q50", "q90"))])
