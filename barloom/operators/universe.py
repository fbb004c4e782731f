"""Point-in-time universes on half-open validity intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31"


def valid(on: Column) -> Column:
    """Rows whose [valid_from, valid_to) holds the date."""
    return (F.col("valid_from") <= on) & (F.col("valid_to").isNull() | (on < F.col("valid_to")))


def _day(x: str | Column) -> Column:
    return F.lit(x).cast("date") if isinstance(x, str) else x


def members_asof(membership: DataFrame, symbols: DataFrame, statuses: DataFrame, universe: str, on: str, active_only: bool = True) -> DataFrame:
    """Members on a date with the ticker then valid; suspended and delisted ones are left out if asked."""
    d = _day(on)
    rows = membership.where((F.col("universe") == universe) & valid(d)).select("instrument_id").join(symbols.where(valid(d)).select("instrument_id", "symbol"), "instrument_id")
    if active_only:
        rows = rows.join(statuses.where(valid(d) & F.col("status").isin("suspended", "delisted")).select("instrument_id"), "instrument_id", "left_anti")
    return rows


def members_between(membership: DataFrame, symbols: DataFrame, universe: str, start: str, end: str) -> DataFrame:
    """Whoever was a member in [start, end], by the latest ticker up to the end, else the last there is."""
    s, e = _day(start), _day(end)
    ever = membership.where((F.col("universe") == universe) & (F.col("valid_from") <= e) & (F.col("valid_to").isNull() | (F.col("valid_to") > s))).select("instrument_id").distinct()
    names = symbols.groupBy("instrument_id").agg(
        F.coalesce(F.max_by(F.when(F.col("valid_from") <= e, F.col("symbol")), F.when(F.col("valid_from") <= e, F.col("valid_from"))), F.max_by("symbol", "valid_from")).alias("symbol")
    )
    return ever.join(names, "instrument_id", "left")


def membership_daily(membership: DataFrame, calendar: DataFrame) -> DataFrame:
    """(trade_date, instrument_id, is_member): intervals met with the sessions inside them."""
    days = calendar.select("trade_date")  # one row per session; intervals are the stream side
    hit = membership.join(F.broadcast(days), (F.col("trade_date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("trade_date") < F.col("valid_to"))))
    return hit.select("trade_date", "instrument_id").distinct().withColumn("is_member", F.lit(True))


def symbols_asof(symbols: DataFrame, on: str) -> DataFrame:
    """Ticker of each instrument on a date; the latest row where none is valid."""
    best = Window.partitionBy("instrument_id").orderBy(F.desc(valid(_day(on)).cast("int")), F.desc("valid_from"))
    return symbols.withColumn("r", F.row_number().over(best)).where("r = 1").select("instrument_id", "symbol", "exchange")


def status_asof(instruments: DataFrame, statuses: DataFrame, on: str) -> DataFrame:
    now = statuses.where(valid(_day(on))).groupBy("instrument_id").agg(F.max_by("status", "valid_from").alias("status"))
    return instruments.select("instrument_id").distinct().join(now, "instrument_id", "left").select("instrument_id", F.coalesce("status", F.lit("active")).alias("status"))


def bands_daily(rows: DataFrame, symbols: DataFrame, bands: dict[str, float]) -> DataFrame:
    """The price band of each row's exchange on its date; the widest where no exchange is known."""
    s = symbols.select(F.col("instrument_id").alias("sid"), "exchange", "valid_from", "valid_to")
    joined = rows.join(s, (F.col("instrument_id") == F.col("sid")) & (F.col("trade_date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("trade_date") < F.col("valid_to"))), "left")
    band = F.create_map(*[F.lit(x) for kv in bands.items() for x in kv])
    return joined.select(*rows.columns, F.coalesce(F.try_element_at(band, F.col("exchange")), F.lit(max(bands.values()))).alias("band"))


def integrity(symbols: DataFrame, statuses: DataFrame, membership: DataFrame) -> DataFrame:
    """Findings: overlapping intervals by instrument, ticker, status and membership, and memberships that start without a ticker."""
    far = F.lit(FOREVER).cast("date")

    def overlaps(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("valid_from")
        rows = df.withColumn("next_from", F.lead("valid_from").over(w)).where(F.col("next_from") < F.coalesce("valid_to", far))
        return rows.select(F.lit(kind).alias("finding"), "instrument_id", "valid_from")

    s = symbols.select(F.col("instrument_id").alias("sid"), F.col("valid_from").alias("sf"), F.col("valid_to").alias("st"))
    covered = (F.col("sid") == F.col("instrument_id")) & (F.col("sf") <= F.col("valid_from")) & (F.col("st").isNull() | (F.col("valid_from") < F.col("st")))
    bare = membership.join(s, covered, "left_anti").select(F.lit("membership without ticker").alias("finding"), "instrument_id", "valid_from")
    out = overlaps(symbols, ["instrument_id"], "ticker overlap").unionByName(overlaps(symbols, ["symbol"], "shared ticker")).unionByName(overlaps(statuses, ["instrument_id"], "status overlap"))
    return out.unionByName(overlaps(membership, ["universe", "instrument_id"], "membership overlap")).unionByName(bare)


def snapshot_diff(open_rows: DataFrame, snapshot: DataFrame, effective: str) -> DataFrame:
    """A row per change that a snapshot asks for: add, remove, weight_change, rename, exchange, suspend, resume, delist.

    Both sides have instrument_id, symbol, exchange, weight and status; an instrument can have several changes.
    """
    old = open_rows.select("instrument_id", F.struct("symbol", "exchange", "weight", "status").alias("o"))
    new = snapshot.select("instrument_id", F.struct("symbol", "exchange", "weight", "status").alias("n"))
    both = old.join(new, "instrument_id", "full")
    o, n = F.col("o"), F.col("n")
    there = o.isNotNull() & n.isNotNull()
    moved = lambda f: there & ~o[f].eqNullSafe(n[f])
    rules = [
        ("add", o.isNull(), F.lit(None).cast("string"), n["symbol"]), ("remove", n.isNull(), o["symbol"], F.lit(None).cast("string")),
        ("rename", moved("symbol"), o["symbol"], n["symbol"]), ("exchange", moved("exchange"), o["exchange"], n["exchange"]),
        ("weight_change", moved("weight"), o["weight"].cast("string"), n["weight"].cast("string")),
        ("suspend", moved("status") & (n["status"] == "suspended"), o["status"], n["status"]),
        ("resume", moved("status") & (n["status"] == "active"), o["status"], n["status"]), ("delist", moved("status") & (n["status"] == "delisted"), o["status"], n["status"]),
    ]
    made = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(k).alias("action"), a.alias("old_value"), b.alias("new_value"))) for k, rule, a, b in rules]))
    return both.select("instrument_id", F.explode(made).alias("x")).select("instrument_id", "x.*", _day(effective).alias("effective_date"))


def close_and_open(history: DataFrame, changes: DataFrame, value: str, effective: str) -> DataFrame:
    """Slowly changing rows: an open row with a change ends at the date and a new one starts; history stays."""
    d = _day(effective)
    c = changes.select("instrument_id", F.col("new_value").alias("to"))
    rows = history.join(c, "instrument_id", "left").withColumn("hit", F.col("to").isNotNull() & F.col("valid_to").isNull() & ~F.col(value).eqNullSafe(F.col("to")))
    keep = rows.withColumn("valid_to", F.when(F.col("hit"), d).otherwise(F.col("valid_to")))
    made = rows.where("hit").withColumn(value, F.col("to")).withColumn("valid_from", d).withColumn("valid_to", F.lit(None).cast("date"))
    return keep.unionByName(made).select(*history.columns)


def rename_clashes(history: DataFrame, changes: DataFrame, effective: str) -> DataFrame:
    """New tickers that another instrument holds on that date."""
    held = history.where(valid(_day(effective))).select(F.col("instrument_id").alias("holder"), F.col("symbol").alias("new_value"))
    return changes.join(held, "new_value").where("holder != instrument_id").select("instrument_id", "new_value", "holder")


def set_exchange(history: DataFrame, changes: DataFrame, effective: str) -> DataFrame:
    """An unknown exchange is filled in place, a known one that changes rolls the row."""
    c = changes.select("instrument_id", F.col("new_value").alias("to"))
    filled = history.join(c, "instrument_id", "left").withColumn("exchange", F.when(F.col("exchange").isNull() & F.col("valid_to").isNull(), F.col("to")).otherwise(F.col("exchange"))).select(*history.columns)
    return close_and_open(filled, changes, "exchange", effective)


def set_status(statuses: DataFrame, wanted: DataFrame, effective: str) -> DataFrame:
    """Transitions between active, suspended and delisted with the reason when refused; delisted is terminal."""
    d = _day(effective)
    now = statuses.where(valid(d)).groupBy("instrument_id").agg(F.max_by("status", "valid_from").alias("was"))
    rows = wanted.join(now, "instrument_id", "left").withColumn("was", F.coalesce("was", F.lit("active")))
    result = F.when(F.col("was") == "delisted", "refused: delisted").when(F.col("was") == F.col("status"), "unchanged").when(F.col("status") == "active", "closed").when(F.col("was") == "active", "opened").otherwise("rolled")
    return rows.select("instrument_id", "was", F.col("status").alias("wanted"), result.alias("result"))


def apply_status(statuses: DataFrame, wanted: DataFrame, effective: str) -> DataFrame:
    """The status history after the transitions of set_status: what holds at the date ends there where it changes, new ones start; the rest stays."""
    d = _day(effective)
    made = set_status(statuses, wanted, effective).select("instrument_id", F.col("wanted").alias("to"), "result")
    rows = statuses.join(made.select("instrument_id", "result"), "instrument_id", "left")
    ends = F.col("result").isin("closed", "rolled") & valid(d)
    kept = rows.withColumn("valid_to", F.when(ends, d).otherwise(F.col("valid_to")))
    opened = made.where(F.col("result").isin("opened", "rolled")).select("instrument_id", F.col("to").alias("status"), d.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return kept.select("instrument_id", "status", "valid_from", "valid_to").unionByName(opened)


def apply_snapshot(history: DataFrame, snapshot: DataFrame, effective: str) -> DataFrame:
    """Membership after a snapshot: rows of names that are absent, delisted or of another weight end at the date, new ones start; history stays.

    history: instrument_id, valid_from, valid_to, weight; snapshot: instrument_id, weight, status and, where given, valid_from. A date before
    the latest recorded change is an error. An earlier valid_from counts in an empty universe alone.
    """
    d = _day(effective)
    latest = history.agg(F.greatest(F.max("valid_from"), F.max("valid_to"))).first()[0]  # one date
    if latest is not None and str(latest) > effective:
        raise ValueError(f"{effective} is before the latest recorded change, {latest}")
    live = snapshot.where(F.coalesce("status", F.lit("active")) != "delisted")
    since = F.least(F.coalesce("valid_from", d), d) if latest is None and "valid_from" in snapshot.columns else d
    live = live.select("instrument_id", F.col("weight").alias("to"), since.alias("since"), F.lit(True).alias("listed"))
    rows = history.join(live.drop("since"), "instrument_id", "left")
    is_open, other = F.col("valid_to").isNull(), ~F.col("weight").eqNullSafe(F.col("to"))
    today = is_open & F.col("listed") & (F.col("valid_from") == d)  # begun on this very date: set anew in place
    ends = is_open & (F.col("listed").isNull() | other) & ~F.coalesce(today, F.lit(False))
    kept = rows.select("instrument_id", "valid_from", F.when(ends, d).otherwise(F.col("valid_to")).alias("valid_to"), F.when(today, F.col("to")).otherwise(F.col("weight")).alias("weight"))
    held = history.where("valid_to is null").select("instrument_id", F.col("weight").alias("was"), F.col("valid_from").alias("began"))
    fresh = live.join(held, "instrument_id", "left").where(F.col("began").isNull() | ((F.col("began") < d) & ~F.col("was").eqNullSafe(F.col("to"))))
    return kept.unionByName(fresh.select("instrument_id", F.col("since").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.col("to").alias("weight")))


def liquidity_universe(bars: DataFrame, n: int, top: int, latest: str) -> tuple[DataFrame, DataFrame]:
    """(chosen, excluded): the `top` instruments by median value traded over their last n bars; too short or stale ones are excluded with a reason."""
    w = Window.partitionBy("instrument_id").orderBy(F.desc("trade_date"))
    last = bars.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    stats = last.groupBy("instrument_id").agg(F.percentile(F.col("close") * F.col("volume"), F.lit(0.5)).alias("value"), F.count("*").alias("n"), F.max("trade_date").alias("last"))
    reason = F.when(F.col("n") < n, "too few bars").when(F.col("last") < F.lit(latest).cast("date"), "stale")
    stats = stats.withColumn("reason", reason)
    fit = stats.where("reason is null").orderBy(F.desc("value"), "instrument_id").limit(top)
    return fit.select("instrument_id", "value"), stats.where("reason is not null").select("instrument_id", "n", "last", "reason")
