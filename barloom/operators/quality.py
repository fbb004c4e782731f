"""Data-quality checks on bars: each yields findings (instrument_id, trade_date, check, severity, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import ratio, rnd

SEVERITY = ("error", "warning", "info")


def _w() -> Window:
    return Window.partitionBy("instrument_id").orderBy("trade_date")


def finding(df: DataFrame, check: str, severity: str, detail: Column, date: Column | str = "trade_date") -> DataFrame:
    d = F.col(date) if isinstance(date, str) else date
    return df.select("instrument_id", d.alias("trade_date"), F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))


def money(x: Column) -> Column:
    """A number as text with four decimals, the same in every engine."""
    cents = F.floor(F.abs(x) * 10000 + 0.5)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(cents / 10000).cast("string"), F.lit("."), F.lpad((cents % 10000).cast("string"), 4, "0"))


def repaired(bars: DataFrame) -> DataFrame:
    """A price at or below 0 empties the bar; high and low are widened to hold the close; an open outside them goes."""
    bad = F.least("open", "high", "low", "close") <= 0
    rows = bars.withColumn("bad", bad)
    hi, lo = F.greatest("high", "close", "low"), F.least("low", "close", "high")
    rows = rows.withColumn("h", F.when(~F.col("bad"), hi)).withColumn("l", F.when(~F.col("bad"), lo))
    return rows.select(
        "instrument_id", "trade_date", F.when(F.col("open").between(F.col("l"), F.col("h")), F.col("open")).alias("open"), F.col("h").alias("high"), F.col("l").alias("low"),
        F.when(~F.col("bad"), F.col("close")).alias("close"), "volume", (F.col("bad") | (hi != F.col("high")) | (lo != F.col("low"))).alias("repaired"),
    )


def no_data(targets: DataFrame, bars: DataFrame) -> DataFrame:
    rows = targets.select("instrument_id").distinct().join(bars.select("instrument_id").distinct(), "instrument_id", "left_anti")
    return finding(rows, "no_data", "error", F.lit("no bars"), F.lit(None).cast("date"))


def duplicate_bar(bars: DataFrame) -> DataFrame:
    rows = bars.groupBy("instrument_id", "trade_date").agg(F.count("*").alias("n")).where("n > 1")
    return finding(rows, "duplicate_bar", "error", F.concat("n", F.lit(" rows")))


def ohlc_inconsistent(bars: DataFrame) -> DataFrame:
    over, under = F.greatest("open", "close", "low") - F.col("high"), F.col("low") - F.least("open", "close", "high")
    size = ratio(F.greatest(over, under) * 100, "close")
    return finding(bars.where((over > 0) | (under > 0)), "ohlc_inconsistent", "error", F.concat(F.lit("off by "), money(size), F.lit("% of close")))


def nonpositive_price(bars: DataFrame) -> DataFrame:
    low = F.least("open", "high", "low", "close")
    missing = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
    return finding(bars.where((low <= 0) | missing), "nonpositive_price", "error", F.concat(F.lit("lowest "), F.coalesce(money(low), F.lit("?"))))


def price_unit(bars: DataFrame, low: float, high: float, jump: float) -> DataFrame:
    """A close outside [low, high], or `jump` times the day before or less than its inverse."""
    r = ratio("close", F.lag("close").over(_w()))
    rows = bars.withColumn("r", r).where(~F.col("close").between(low, high) | (F.col("r") >= jump) | (F.col("r") <= 1 / jump))
    return finding(rows, "price_unit", "error", F.concat(F.lit("close "), money(F.col("close"))))


def zero_volume(bars: DataFrame) -> DataFrame:
    return finding(bars.where("volume = 0"), "zero_volume", "info", F.lit("no volume"))


def repeated_bar(bars: DataFrame) -> DataFrame:
    fields = F.struct("open", "high", "low", "close", "volume")
    rows = bars.withColumn("x", fields).withColumn("before", F.lag("x").over(_w())).where("x = before")
    return finding(rows, "repeated_bar", "warning", F.lit("same as the bar before"))


def volume_spike(bars: DataFrame, n: int = 60, least: int = 30, times: float = 30) -> DataFrame:
    frame = _w().rowsBetween(-n, -1)
    rows = bars.withColumn("m", F.percentile("volume", F.lit(0.5)).over(frame)).withColumn("k", F.count("volume").over(frame))
    rows = rows.where((F.col("k") >= least) & (F.col("m") > 0) & (F.col("volume") / F.col("m") > times))
    return finding(rows, "volume_spike", "warning", F.concat(money(F.col("volume") / F.col("m")), F.lit(" times the median")))


def big_move(bars: DataFrame, band: float, tolerance: float) -> DataFrame:
    w = _w()
    rows = bars.withColumn("r", ratio("close", F.lag("close").over(w)) - 1).withColumn("days", F.datediff("trade_date", F.lag("trade_date").over(w)))
    return finding(rows.where(F.abs("r") > band + tolerance), "big_move", "warning", F.concat(money(F.col("r") * 100), F.lit("% in "), "days", F.lit(" days")))


def return_outlier(bars: DataFrame, limit: float = 8, least: int = 60) -> DataFrame:
    """Log returns over `limit` scaled median deviations from the instrument's median."""
    rows = bars.where("close > 0").withColumn("lr", F.ln(ratio("close", F.lag("close").over(_w())))).where("lr is not null")
    mid = rows.groupBy("instrument_id").agg(F.percentile("lr", F.lit(0.5)).alias("m"), F.count("*").alias("n")).where(F.col("n") >= least)
    rows = rows.join(mid, "instrument_id").withColumn("d", F.abs(F.col("lr") - F.col("m")))
    mad = rows.groupBy("instrument_id").agg(F.percentile("d", F.lit(0.5)).alias("mad"))
    rows = rows.join(mad, "instrument_id").withColumn("z", F.try_divide(F.col("d"), 1.4826 * F.col("mad"))).where(F.col("z") > limit)
    return finding(rows, "return_outlier", "warning", F.concat(rnd("z", 1).cast("string"), F.lit(" deviations")))


def missing_trading_day(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    spans = bars.groupBy("instrument_id").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    due = spans.join(F.broadcast(calendar.select("trade_date")), F.col("trade_date").between(F.col("a"), F.col("b")))  # one row per session
    return finding(due.join(bars.select("instrument_id", "trade_date"), ["instrument_id", "trade_date"], "left_anti"), "missing_trading_day", "warning", F.lit("no bar"))


def extra_day(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    return finding(bars.join(calendar.select("trade_date"), "trade_date", "left_anti"), "extra_day", "warning", F.lit("off the calendar"))


def stale_series(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    last = calendar.agg(F.max("trade_date").alias("newest"))
    rows = bars.groupBy("instrument_id").agg(F.max("trade_date").alias("trade_date")).crossJoin(F.broadcast(last)).where("trade_date < newest")  # one row
    return finding(rows, "stale_series", "warning", F.concat(F.datediff("newest", "trade_date"), F.lit(" days old")))


def vendor_duplicates(warnings: DataFrame) -> DataFrame:
    """Merged fragments from the warnings of runs, given as a JSON array of texts "<id> <date> merged <n>"."""
    lines = warnings.select(F.explode(F.from_json("warnings", "array<string>")).alias("line")).where(F.col("line").rlike(r"^\d+ \d{4}-\d\d-\d\d merged \d+$"))
    part = lambda k: F.regexp_extract("line", r"^(\d+) (\S+) merged (\d+)$", k)
    rows = lines.select(part(1).cast("bigint").alias("instrument_id"), part(2).cast("date").alias("trade_date"), part(3).alias("n"))
    return finding(rows, "vendor_duplicate", "info", F.concat(F.lit("merged "), "n"))


def severity_rank(x: Column | str = "severity") -> Column:
    s = F.col(x) if isinstance(x, str) else x
    return F.when(s == "error", 0).when(s == "warning", 1).otherwise(2)


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("check", "severity").agg(F.count("*").alias("findings"), F.count_distinct("instrument_id").alias("instruments"), F.min(severity_rank()).alias("severity_rank"))


def explained(findings: DataFrame, issues: DataFrame) -> DataFrame:
    """Each finding with the first known issue that covers it, and its state."""
    i = issues.select(F.col("issue_id"), F.col("check").alias("ic"), F.col("instrument_id").alias("ii"), "date_from", "date_to")
    covers = (F.col("check") == F.col("ic")) & (F.col("ii").isNull() | (F.col("ii") == F.col("instrument_id")))
    covers = covers & (F.col("date_from").isNull() | (F.col("trade_date") >= F.col("date_from"))) & (F.col("date_to").isNull() | (F.col("trade_date") <= F.col("date_to")))
    hit = findings.join(i, covers, "left").groupBy(*findings.columns).agg(F.min("issue_id").alias("issue_id"))
    return hit.withColumn("state", F.when(F.col("issue_id").isNull(), "open").otherwise("explained"))


def findings_upsert(stored: DataFrame, found: DataFrame) -> DataFrame:
    """new, refreshed and resolved findings by (instrument, check, date)."""
    key = ["instrument_id", "check", "trade_date"]
    s, f = stored.select(*key).distinct().withColumn("s", F.lit(1)), found.select(*key).distinct().withColumn("f", F.lit(1))
    return s.join(f, key, "full").select(*key, F.when(F.col("s").isNull(), "new").when(F.col("f").isNull(), "resolved").otherwise("refreshed").alias("state"))


def coverage(bars: DataFrame, shortest: int = 8) -> DataFrame:
    """One row: bars per instrument (least, median, most), the shortest histories (instrument, sessions, first and last bar) and counts of each price basis."""
    n = bars.groupBy("instrument_id").agg(F.count("*").alias("n"), F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))
    short = n.orderBy("n", "instrument_id").limit(shortest).agg(F.array_sort(F.collect_list(F.struct("n", "instrument_id", "first", "last"))).alias("x"))
    short = short.select(F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["instrument_id"], r["n"], r["first"], r["last"])), ",").alias("shortest"))
    basis = bars.groupBy("price_basis").agg(F.count("*").alias("k")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.coalesce("price_basis", F.lit("none")), "k"))), ",").alias("basis"))
    counts = n.agg(F.count("*").alias("instruments"), F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"))
    return counts.crossJoin(F.broadcast(short)).crossJoin(F.broadcast(basis))  # one row each


def findings_pivot(findings: DataFrame) -> DataFrame:
    """check, severity, open, explained: findings in each state as columns, errors first."""
    wide = findings.groupBy("check", "severity").pivot("state", ["open", "explained"]).agg(F.count(F.lit(1)))
    order = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return wide.select("check", "severity", F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("explained", F.lit(0)).alias("explained")).orderBy(order, "check")


def day_checks(members: DataFrame, bars: DataFrame, on: str) -> DataFrame:
    """Share of members with a bar on a day, and members whose last bar is older than ten days."""
    d = F.lit(on).cast("date")
    last = bars.where(F.col("trade_date") <= d).groupBy("instrument_id").agg(F.max("trade_date").alias("last"))
    rows = members.select("instrument_id").distinct().join(last, "instrument_id", "left")
    return rows.agg(F.count("*").alias("members"), F.count_if(F.col("last") == d).alias("with_bar"), F.count_if(F.col("last").isNull() | (F.datediff(d, "last") > 10)).alias("stale"))
