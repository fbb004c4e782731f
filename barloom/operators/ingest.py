"""Ingestion, change capture, calendars and corporate actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import ratio, rnd

FIELDS = ("open", "high", "low", "close", "volume")


def scan_calendar(calendar: DataFrame, start: str, end: str) -> DataFrame:
    return calendar.where(F.col("trade_date").between(start, end)).select("trade_date").orderBy("trade_date")


def consensus_calendar(bars: DataFrame, share: float = 0.5, grace: int = 10) -> DataFrame:
    """Dates with bars of at least `share` of the active instruments, numbered from 1.

    An instrument is active from its first bar to `grace` days after its last. Active counts are running
    sums of +1 and -1 per date, so that no range join is needed; the numbering sorts one row per date.
    """
    spans = bars.groupBy("instrument_id").agg(F.min("trade_date").alias("first"), F.date_add(F.max("trade_date"), grace + 1).alias("stop"))
    steps = spans.select(F.explode(F.array(F.struct(F.col("first").alias("d"), F.lit(1).alias("step")), F.struct(F.col("stop").alias("d"), F.lit(-1).alias("step")))).alias("x")).select("x.*")
    seen = bars.groupBy(F.col("trade_date").alias("d")).agg(F.count_distinct("instrument_id").alias("n"))
    daily = steps.groupBy("d").agg(F.sum("step").alias("step")).join(seen, "d", "full")
    active = F.sum(F.coalesce("step", F.lit(0))).over(Window.orderBy("d"))
    days = daily.withColumn("active", active).where(F.col("n") >= F.greatest(F.lit(1.0), share * F.col("active")))
    return days.select(F.col("d").alias("trade_date"), F.row_number().over(Window.orderBy("d")).cast("bigint").alias("session_idx"))


def final_bars(bars: DataFrame, now: str, close_hour: int = 16, buffer_hours: int = 1) -> DataFrame:
    """Bars before today, and today's once the close and a buffer have passed."""
    t = F.lit(now).cast("timestamp")
    done = F.hour(t) >= close_hour + buffer_hours
    return bars.where((F.col("trade_date") < t.cast("date")) | ((F.col("trade_date") == t.cast("date")) & done))


def incremental_plan(targets: DataFrame, bars: DataFrame, start: str, overlap: int = 10) -> DataFrame:
    """What to fetch: all from `start` without bars, else from `overlap` days before the last."""
    last = bars.groupBy("instrument_id").agg(F.max("trade_date").alias("last_date"))
    begin = F.lit(start).cast("date")
    return targets.join(last, "instrument_id", "left").select(
        "instrument_id", F.coalesce(F.greatest(begin, F.date_sub("last_date", overlap)), begin).alias("fetch_from"), F.when(F.col("last_date").isNull(), "full").otherwise("incremental").alias("mode")
    )


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Every key with its class (inserted, updated, unchanged, kept), the values after and before the write."""
    old = stored.select(*key, F.struct(*fields).alias("old"))
    new = incoming.select(*key, F.struct(*fields).alias("new"))
    kind = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "inserted").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    return old.join(new, key, "full").select(*key, kind.alias("change"), F.coalesce("new", "old").alias("row"), "old")


def drifted(stored: DataFrame, incoming: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Instruments of which some overlapping close moved by more than the tolerance: to be rewritten whole."""
    old, new = stored.select("instrument_id", "trade_date", F.col("close").alias("old")), incoming.select("instrument_id", "trade_date", F.col("close").alias("new"))
    off = (F.col("old") == 0) | (F.abs(F.col("new") - F.col("old")) / F.col("old") > tolerance)
    return old.join(new, ["instrument_id", "trade_date"]).groupBy("instrument_id").agg(F.count_if(off).alias("n_off"), F.bool_or(off).alias("drifted"))


def ingest_stats(classified: DataFrame) -> DataFrame:
    """Counts of each class by instrument, and over all in a row with a null id."""
    count = lambda k: F.count_if(F.col("change") == k).alias(k)
    return classified.rollup("instrument_id").agg(count("inserted"), count("updated"), count("unchanged"))


def calendar_sync(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Dates to add and to remove."""
    both = stored.select("trade_date").withColumn("s", F.lit(1)).join(computed.select("trade_date").withColumn("c", F.lit(1)), "trade_date", "full")
    return both.where("s is null or c is null").select("trade_date", F.when(F.col("s").isNull(), "added").otherwise("removed").alias("action"))


def calendar_gaps(calendar: DataFrame, bars: DataFrame) -> DataFrame:
    """Weekdays of the calendar's span without a session, by year: those without a bar, and those with too few."""
    span = calendar.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("trade_date")).where(~F.dayofweek("trade_date").isin(1, 7))
    with_bar = bars.select("trade_date").distinct().withColumn("has_bar", F.lit(True))
    gaps = days.join(calendar.select("trade_date"), "trade_date", "left_anti").join(with_bar, "trade_date", "left")
    return gaps.groupBy(F.year("trade_date").alias("year")).agg(F.count_if(F.col("has_bar").isNull()).alias("no_bar"), F.count_if("has_bar").alias("partial"))


def first_label(*labelled: DataFrame) -> DataFrame:
    """Union of (instrument_id, label) lists; the first list that names an instrument labels it."""
    rows = None
    for rank, df in enumerate(labelled):
        part = df.select("instrument_id", "label", F.lit(rank).alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("instrument_id").agg(F.min_by("label", F.struct("rank", "label")).alias("label"))


def readiness(members: DataFrame, bars: DataFrame, as_of: str, least: int) -> DataFrame:
    """Sessions of each member up to a date, and whether that is enough."""
    n = bars.where(F.col("trade_date") <= as_of).groupBy("instrument_id").agg(F.count("*").alias("sessions"))
    out = members.select("instrument_id").distinct().join(n, "instrument_id", "left").withColumn("sessions", F.coalesce("sessions", F.lit(0)))
    return out.withColumn("ready", F.col("sessions") >= least).withColumn("reason", F.when(~F.col("ready"), F.concat(F.lit("has "), "sessions", F.lit(f" of {least} sessions"))))


def without_bars(targets: DataFrame, bars: DataFrame) -> DataFrame:
    return targets.select("instrument_id").distinct().join(bars.select("instrument_id").distinct(), "instrument_id", "left_anti")


def readiness_alerts(open_alerts: DataFrame, blocked: DataFrame) -> DataFrame:
    """One open alert per blocked instrument: what to open, keep and acknowledge."""
    both = open_alerts.select("instrument_id").distinct().withColumn("o", F.lit(1)).join(blocked.select("instrument_id").distinct().withColumn("b", F.lit(1)), "instrument_id", "full")
    return both.select("instrument_id", F.when(F.col("o").isNull(), "open").when(F.col("b").isNull(), "acknowledge").otherwise("keep").alias("action"))


def as_known(bars: DataFrame, revisions: DataFrame, known_at: Column, n: int) -> DataFrame:
    """The last n bars of each instrument as they stood: the earliest revision superseded after that moment wins."""
    old = revisions.where(F.col("superseded_at") > known_at).groupBy("instrument_id", "trade_date").agg(F.min_by(F.struct(*FIELDS), "superseded_at").alias("was"))
    last = Window.partitionBy("instrument_id").orderBy(F.desc("trade_date"))
    rows = bars.where(F.col("trade_date") <= known_at.cast("date")).join(old, ["instrument_id", "trade_date"], "left")
    rows = rows.withColumn("r", F.row_number().over(last)).where(F.col("r") <= n).withColumn("x", F.coalesce("was", F.struct(*FIELDS)))
    return rows.select("instrument_id", "trade_date", "x.*", F.col("was").isNotNull().alias("revised"))


def bar_fingerprint(bars: DataFrame) -> DataFrame:
    """sha256 over an instrument's ordered bars as text, one line a bar."""
    cents = lambda c: F.format_string("%d", F.floor(F.col(c) * 10000 + 0.5))
    line = F.concat_ws("|", F.col("trade_date").cast("string"), *[cents(c) for c in FIELDS])
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("trade_date", line.alias("line")))), lambda x: x["line"]), "\n")
    return bars.groupBy("instrument_id").agg(F.sha2(lines, 256).alias("fingerprint"), F.count("*").alias("n_bars"))


def adjusted_prices(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Bars times the product of later factors of the current version.

    Factors become half-open date spans with their suffix product, so that a bar meets one row and not many.
    """
    newest = Window.partitionBy("instrument_id")
    current = factors.withColumn("top", F.max("version").over(newest)).where("version = top")
    later = Window.partitionBy("instrument_id").orderBy(F.desc("effective_date"))
    spans = current.groupBy("instrument_id", "effective_date").agg(F.product("factor").alias("f")).select(
        "instrument_id", F.col("effective_date").alias("stop"), F.lead("effective_date").over(later).alias("start"), F.product("f").over(later).alias("product")
    )
    b = bars.alias("b").join(spans.alias("s"), (F.col("b.instrument_id") == F.col("s.instrument_id")) & (F.col("b.trade_date") < F.col("stop")) & (F.col("start").isNull() | (F.col("b.trade_date") >= F.col("start"))), "left")
    f = F.coalesce("product", F.lit(1.0))
    return b.select("b.instrument_id", "b.trade_date", *[rnd(F.col(c) * f, 4).alias(c) for c in FIELDS[:4]], F.col("b.volume").alias("volume"))


def gap_candidates(bars: DataFrame, calendar: DataFrame, band: float, tolerance: float) -> DataFrame:
    """Opens that left the band compounded over the sessions since the previous bar."""
    numbered = bars.join(calendar, "trade_date")
    w = Window.partitionBy("instrument_id").orderBy("trade_date")
    rows = numbered.select("instrument_id", "trade_date", "open", F.lag("close").over(w).alias("previous"), (F.col("session_idx") - F.lag("session_idx").over(w)).alias("k")).where("previous is not null")
    gap = ratio("open", "previous") - 1
    low, high = F.pow(F.lit(1 - band), F.col("k")) - 1 - tolerance, F.pow(F.lit(1 + band), F.col("k")) - 1 + tolerance
    return rows.withColumn("gap", gap).where((F.col("gap") < low) | (F.col("gap") > high)).select("instrument_id", F.col("trade_date").alias("ex_date"), rnd("gap").alias("gap"), F.col("k").alias("sessions"))


def candidate_lifecycle(stored: DataFrame, found: DataFrame) -> DataFrame:
    """new, refreshed and stale candidates by (instrument_id, ex_date)."""
    key = ["instrument_id", "ex_date"]
    both = stored.select(*key, F.lit(1).alias("s")).join(found.select(*key, F.lit(1).alias("f")), key, "full")
    return both.select(*key, F.when(F.col("s").isNull(), "new").when(F.col("f").isNull(), "stale").otherwise("refreshed").alias("state"))


def adjustment_factors(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """A factor per action: explicit, 1 / (1 + ratio), or (P - cash) / P at the last close before the ex-date; else a reason."""
    before = actions.select("instrument_id", "ex_date").distinct().join(bars.select("instrument_id", "trade_date", "close"), "instrument_id").where("trade_date < ex_date")
    last = before.groupBy("instrument_id", "ex_date").agg(F.max_by("close", "trade_date").alias("p"))
    rows = actions.join(last, ["instrument_id", "ex_date"], "left")
    factor = F.when(F.col("ratio").isNotNull() & (F.col("ratio") > -1), 1 / (1 + F.col("ratio"))).when(F.col("cash").isNotNull() & (F.col("p") > F.col("cash")), ratio(F.col("p") - F.col("cash"), "p"))
    problem = F.when(factor.isNotNull(), None).when(F.col("p").isNull(), "no close before ex-date").otherwise("cash not below close")
    return rows.select("instrument_id", "ex_date", "action_type", rnd(factor, 12).alias("factor"), problem.alias("problem"))


def factor_versions(confirmed: DataFrame, current: DataFrame) -> DataFrame:
    """Next version of each instrument's factors: one more only if the confirmed set differs from the current one."""
    bag = lambda df, name: df.groupBy("instrument_id").agg(F.array_sort(F.collect_set(F.struct("ex_date", "factor"))).alias(name))
    version = current.groupBy("instrument_id").agg(F.max("version").alias("version"))
    both = bag(confirmed, "want").join(bag(current, "have"), "instrument_id", "left").join(version, "instrument_id", "left")
    same = F.coalesce(F.col("want") == F.col("have"), F.lit(False))
    return both.select("instrument_id", (F.coalesce("version", F.lit(0)) + F.when(same, 0).otherwise(1)).cast("bigint").alias("version"), (~same).alias("changed"))


def merge_fragments(fragments: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Several rows of one day: open of the first, highest high, lowest low, close of the last, summed volume."""
    return fragments.groupBy(*key).agg(
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n_fragments")
    )


def keep_last(rows: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """The last arrival of each key, with how many it replaced."""
    values = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), arrival).alias("x"), (F.count("*") - 1).alias("n_replaced")).select(*key, "x.*", "n_replaced")


def vendor_bars(payloads: DataFrame, key: str, multiplier: float, zone: str) -> DataFrame:
    """Rows from JSON of parallel arrays; answers whose arrays differ in length come back with n_bad and no bars."""
    schema = "t array<bigint>, o array<double>, h array<double>, l array<double>, c array<double>, v array<bigint>"
    p = payloads.select(key, F.from_json("payload", schema).alias("p")).select(key, "p.*")
    equal = F.array_min(F.array(*[F.size(x) for x in "tohlcv"])) == F.array_max(F.array(*[F.size(x) for x in "tohlcv"]))
    rows = p.where(equal).select(key, F.explode(F.arrays_zip(*"tohlcv")).alias("x"))
    money = lambda x: (F.col(f"x.{x}").cast("decimal(18,4)") * F.lit(multiplier).cast("decimal(18,4)")).cast("decimal(18,4)").cast("double")
    return rows.select(
        key, F.from_utc_timestamp(F.timestamp_seconds("x.t"), zone).cast("date").alias("trade_date"), F.col("x.t").alias("t"),
        money("o").alias("open"), money("h").alias("high"), money("l").alias("low"), money("c").alias("close"), F.col("x.v").alias("volume"),
    )
