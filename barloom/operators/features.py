"""Per-instrument features over own bars, cross-sectional ranks, forward labels and dataset assembly.

Rows carry instrument_id, trade_date, bar_idx (own bars) or session_idx (calendar), open, high, low, close,
volume. A feature at a row uses that row and earlier ones only; labels look ahead by calendar sessions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import change, col, dates, own, ratio, rolling, sessions

YEAR = 252


def numbered(bars: DataFrame) -> DataFrame:
    """Own-bar numbers from 1."""
    return bars.withColumn("bar_idx", F.row_number().over(Window.partitionBy("instrument_id").orderBy("trade_date")).cast("bigint"))


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def true_range() -> Column:
    """Largest of high-low and the distances of both from the previous close; null without high or low."""
    before = F.lag("close").over(own())
    r = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return F.when(F.col("high").isNotNull() & F.col("low").isNotNull(), r)


def ewm(df: DataFrame, x: str, out: str, alpha: float, least: int) -> DataFrame:
    """Adds the exponential mean of x (seeded with its first value) as window sums, null for the first least - 1 values.

    With b = 1 - alpha, a value is a sum of b^(t-i) w_i x_i, w_0 = 1 and w_i = alpha. Values are taken in blocks
    in which powers of b stay in range; a block gets the end value of the block before, and what is older than
    that has a weight below 1e-17.
    """
    if alpha >= 1:
        return df.withColumn(out, F.col(x))
    block = max(64, min(512, int(600 / -math.log(1 - alpha))))
    if block * -math.log(1 - alpha) < 40:  # slow decay: one block reaches over the whole tail
        block = int(40 / -math.log(1 - alpha)) + 1
    n = F.when(col(x).isNotNull(), F.count(col(x)).over(own()) - 1)
    b = 1 - alpha
    df = df.withColumn("ewm_n", n).withColumn("ewm_b", F.floor(F.col("ewm_n") / block)).withColumn("ewm_k", F.col("ewm_n") % block)
    weight = F.when(F.col("ewm_n") == 0, 1.0).otherwise(alpha)
    inside = Window.partitionBy("instrument_id", "ewm_b").orderBy("ewm_k").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("ewm_s", F.pow(F.lit(b), F.col("ewm_k")) * F.sum(weight * F.col(x) * F.pow(F.lit(b), -F.col("ewm_k"))).over(inside))
    end = F.when(F.col("ewm_k") == block - 1, F.col("ewm_s"))
    before = F.max(end).over(Window.partitionBy("instrument_id").orderBy("ewm_b").rangeBetween(-1, -1))
    value = F.col("ewm_s") + F.coalesce(before * F.pow(F.lit(b), F.col("ewm_k") + 1), F.lit(0.0))
    return df.withColumn(out, F.when(F.col("ewm_n") >= least - 1, value)).drop("ewm_n", "ewm_b", "ewm_k", "ewm_s")


# features: name -> (function of (df, parameters) adding columns, warm-up in own bars)


def ret(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn(f"ret_{n}", change("close", n))


def atr_pct(df: DataFrame, n: int = 14) -> DataFrame:
    return ewm(df.withColumn("tr", true_range()), "tr", "atr", 1 / n, n).withColumn("atr_pct", ratio("atr", "close"))


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """100 when nothing was lost, 50 when nothing moved."""
    step = F.col("close") - F.lag("close").over(own())
    df = df.withColumn("gain", F.greatest(step, F.when(step.isNotNull(), 0.0))).withColumn("loss", F.greatest(-step, F.when(step.isNotNull(), 0.0)))
    df = ewm(ewm(df, "gain", "up", 1 / n, n), "loss", "down", 1 / n, n)
    value = F.when((F.col("down") == 0) & (F.col("up") == 0), 50.0).when(F.col("down") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("up", "down")))
    return df.withColumn("rsi", F.when(F.col("up").isNotNull(), value)).drop("gain", "loss", "up", "down")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ewm(ewm(df, "close", "fast", 2 / (fast + 1), fast), "close", "slow", 2 / (slow + 1), slow).withColumn("line", F.col("fast") - F.col("slow"))
    df = ewm(df, "line", "signal", 2 / (signal + 1), signal)
    return df.withColumn("macd", ratio("line", "close")).withColumn("macd_hist", ratio(F.col("line") - F.col("signal"), "close")).drop("fast", "slow", "line", "signal")


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    mid, sd = rolling(F.avg, "close", n), rolling(F.stddev_samp, "close", n)
    return df.withColumn("bollinger", ratio(F.col("close") - (mid - k * sd), 2 * k * sd))


def donchian(df: DataFrame, n: int = 20) -> DataFrame:
    frame = own().rowsBetween(-n, -1)
    full = F.count("close").over(frame) == n
    return df.withColumn("donchian_high", F.when(full, ratio("close", F.max("high").over(frame)) - 1)).withColumn("donchian_low", F.when(full, ratio("close", F.min("low").over(frame)) - 1))


def zscore(df: DataFrame, n: int = 20) -> DataFrame:
    return df.withColumn("zscore", ratio(F.col("close") - rolling(F.avg, "close", n), rolling(F.stddev_samp, "close", n)))


def gap(df: DataFrame) -> DataFrame:
    return df.withColumn("gap", ratio("open", F.lag("close").over(own())) - 1)


def volume_spike(df: DataFrame, n: int = 20) -> DataFrame:
    frame = own().rowsBetween(-n, -1)
    return df.withColumn("volume_spike", F.when(F.count("volume").over(frame) == n, ratio("volume", median(F.col("volume")).over(frame))))


def rel_strength(df: DataFrame, bench: DataFrame, n: int) -> DataFrame:
    """Own return less the benchmark's over the same own bars."""
    df = df.join(F.broadcast(bench.select("trade_date", F.col("close").alias("bench"))), "trade_date", "left")  # one row per date
    return df.withColumn(f"rel_strength_{n}", change("close", n) - change("bench", n)).drop("bench")


def momentum(df: DataFrame, months: int, skip: int = 21) -> DataFrame:
    lag = lambda n: F.lag("close", n).over(own())
    return df.withColumn(f"mom_{months}m", ratio(lag(skip), lag(skip + 21 * months)) - 1)


def volatility(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("r1", change("close", 1)).withColumn(f"vol_{n}", rolling(F.stddev_samp, "r1", n) * math.sqrt(YEAR)).drop("r1")


def downside_beta(df: DataFrame, bench: DataFrame, n: int = 126, least: int = 20) -> DataFrame:
    """Population covariance over variance on the days when the benchmark fell."""
    df = df.join(F.broadcast(bench.select("trade_date", F.col("close").alias("bench"))), "trade_date", "left")
    filled = F.last("bench", ignorenulls=True).over(own().rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("bench", filled).withColumn("r", change("close", 1)).withColumn("m", change("bench", 1))
    down = (F.col("m") < 0) & F.col("r").isNotNull()
    # sums of n rows as differences of running sums, so that each row is added once
    terms = {"k": F.lit(1.0), "x": F.col("m"), "y": F.col("r"), "xy": F.col("m") * F.col("r"), "xx": F.col("m") * F.col("m")}
    upto = own().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"n_r": F.count("r").over(upto), **{f"s_{c}": F.sum(F.when(down, x).otherwise(0.0)).over(upto) for c, x in terms.items()}})
    s = lambda c: F.col(c) - F.coalesce(F.lag(c, n).over(own()), F.lit(0))
    df = df.withColumns({c: s(c) for c in ("n_r", *[f"s_{c}" for c in terms])})
    k, x, y, xy, xx = F.nullif(F.col("s_k"), F.lit(0.0)), *(F.col(f"s_{c}") for c in terms if c != "k")
    cov, var = xy / k - x / k * (y / k), xx / k - x / k * (x / k)
    return df.withColumn("downside_beta", F.when((F.col("n_r") == n) & (k >= least) & (var > 1e-14), F.try_divide(cov, var))).drop("bench", "r", "m", "n_r", *[f"s_{c}" for c in terms])


def drawdown(df: DataFrame, n: int = YEAR) -> DataFrame:
    return df.withColumn("drawdown", ratio("close", rolling(F.max, "close", n)) - 1)


def sma_ratio(df: DataFrame, n: int = 200) -> DataFrame:
    return df.withColumn("sma_ratio", ratio("close", rolling(F.avg, "close", n)) - 1)


def liquidity_level(df: DataFrame, n: int = 60) -> DataFrame:
    value = F.col("close") * F.col("volume")
    return df.withColumn("liq_level", F.ln(rolling(median, value, n))).withColumn("liq_zero_share", rolling(F.avg, (F.col("volume") == 0).cast("double"), n))


def liquidity_trend(df: DataFrame, n: int = 60, long: int = YEAR) -> DataFrame:
    value = F.col("close") * F.col("volume")
    return df.withColumn("liq_trend", F.ln(ratio(rolling(median, value, n), rolling(median, value, long)))).withColumn("liq_zero_share", rolling(F.avg, (F.col("volume") == 0).cast("double"), n))


#: Names that would tell a model which instrument it sees.
IDENTIFYING = ("instrument_id", "symbol", "isin", "exchange")
REGISTRY: dict[tuple[str, int], tuple[Callable[..., DataFrame], int]] = {}


def register(name: str, version: int, warmup: int, f: Callable[..., DataFrame]) -> None:
    """Adds a feature; a (name, version) never changes its meaning, and names of instruments are no features."""
    if (name, version) in REGISTRY or name in IDENTIFYING:
        raise ValueError(f"{name} {version} can't be registered")
    REGISTRY[name, version] = f, warmup


for _n in (1, 2, 3, 5, 10):
    register(f"ret_{_n}", 1, _n, lambda df, n=_n: ret(df, n))
for _name, _warm, _f in (("zscore", 20, zscore), ("bollinger", 20, bollinger), ("donchian", 20, donchian), ("gap", 1, gap), ("volume_spike", 20, volume_spike), ("atr_pct", 14, atr_pct), ("rsi", 14, rsi), ("macd", 35, macd), ("drawdown", YEAR, drawdown), ("sma_ratio", 200, sma_ratio), ("liquidity", 60, liquidity_level)):
    register(_name, 1, _warm, _f)
register("liquidity", 2, YEAR, liquidity_trend)


def feature_frame(df: DataFrame, features: list[tuple[str, int]]) -> DataFrame:
    """Adds the registered features in order; all share one sort by instrument."""
    for key in features:
        df = REGISTRY[key][0](df)
    return df


def warmup(features: list[tuple[str, int]]) -> int:
    return max((REGISTRY[k][1] for k in features), default=0)


def cs_rank(df: DataFrame, x: str, out: str, least: int = 1, member: Column | None = None) -> DataFrame:
    """Percentile rank in (0, 1] among a date's members with a value, ties averaged; null below `least` of them."""
    value = F.when(member, col(x)) if member is not None else col(x)
    df = df.withColumn("cs_x", value)
    w, same = dates(), Window.partitionBy("trade_date", "cs_x")
    n = F.count("cs_x").over(w)
    rank = F.rank().over(w.orderBy(F.col("cs_x").asc_nulls_last())) + (F.count("cs_x").over(same) - 1) / 2
    return df.withColumn(out, F.when(F.col("cs_x").isNotNull() & (n >= least), rank / n)).drop("cs_x")


def known_fundamentals(rows: DataFrame, published: DataFrame, fields: list[str]) -> DataFrame:
    """The newest published values at each row's date: a union in date order and the last value before."""
    at = Window.partitionBy("instrument_id").orderBy("on", "is_row").rowsBetween(Window.unboundedPreceding, 0)
    left = rows.select("instrument_id", "trade_date", F.col("trade_date").alias("on"), F.lit(1).alias("is_row"), *[F.lit(None).cast("double").alias(f) for f in fields])
    right = published.select("instrument_id", F.lit(None).cast("date").alias("trade_date"), F.col("published").alias("on"), F.lit(0).alias("is_row"), *fields)
    filled = left.unionByName(right).select("instrument_id", "trade_date", "is_row", *[F.last(f, ignorenulls=True).over(at).alias(f) for f in fields])
    return filled.where("is_row = 1").drop("is_row")


def densify(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """A row for each (session, instrument); a missing bar is null. Bars off the calendar fall away."""
    grid = F.broadcast(calendar.select("trade_date", "session_idx")).crossJoin(bars.select("instrument_id").distinct())  # dates times instruments is the size of the panel
    return grid.join(bars, ["instrument_id", "trade_date"], "left")


def forward_return(grid: DataFrame, h: int) -> DataFrame:
    """Return to h sessions ahead and that session's date; null if either close is missing."""
    w = sessions()
    return grid.withColumn(f"fwd_ret_{h}", ratio(F.lead("close", h).over(w), "close") - 1).withColumn(f"fwd_end_{h}", F.lead("trade_date", h).over(w))


def triple_barrier(grid: DataFrame, atr: str, stop: float, target: float, h: int) -> DataFrame:
    """tb_label (-1 stop, 1 target, 0 time), tb_time, tb_ret, tb_end over sessions t+1 .. t+h.

    The stop wins on a day that touches both; a gap through a barrier exits at the open; sessions without a
    bar are passed over. Null when the window doesn't fit the calendar, or a time-out has no close.
    """
    w = sessions()
    ahead = F.collect_list(F.struct("session_idx", "open", "high", "low", "trade_date")).over(w.rowsBetween(1, h))
    down, up = F.col("close") - stop * col(atr), F.col("close") + target * col(atr)
    df = grid.withColumn("tb_down", down).withColumn("tb_up", up).withColumn("tb_ahead", ahead)
    touching = F.filter("tb_ahead", lambda b: (b["low"] <= F.col("tb_down")) | (b["high"] >= F.col("tb_up")))
    df = df.withColumn("tb_hit", F.get(touching, F.lit(0)))
    fits = F.lead("session_idx", h).over(w).isNotNull() & F.col("tb_down").isNotNull()
    x = F.col("tb_hit")
    stopped = x["low"] <= F.col("tb_down")
    price = F.when(stopped, F.least(x["open"], F.col("tb_down"))).otherwise(F.greatest(x["open"], F.col("tb_up")))
    last, last_date = F.lead("close", h).over(w), F.lead("trade_date", h).over(w)
    touched = x.isNotNull()
    usable = fits & (touched | last.isNotNull())
    return df.select(
        *grid.columns,
        F.when(usable, F.when(touched, F.when(stopped, -1).otherwise(1)).otherwise(0)).alias("tb_label"),
        F.when(usable, F.when(touched, x["session_idx"] - F.col("session_idx")).otherwise(h)).alias("tb_time"),
        F.when(usable, ratio(F.when(touched, price).otherwise(last), "close") - 1).alias("tb_ret"),
        F.when(usable, F.when(touched, x["trade_date"]).otherwise(last_date)).alias("tb_end"),
    )


def assemble(grid: DataFrame, columns: list[str], history: int, start: str, end: str) -> DataFrame:
    """Rows of members with a bar and enough own history in a date range; filters come after all windows."""
    n = F.count("close").over(sessions().rowsBetween(Window.unboundedPreceding, 0))
    rows = grid.withColumn("own_bars", n).where(F.col("is_member") & F.col("close").isNotNull() & (F.col("own_bars") >= history) & F.col("trade_date").between(start, end))
    return rows.select("trade_date", "instrument_id", *columns)


def audit(full: DataFrame, cut: DataFrame, columns: list[str], until: str, tolerance: float = 1e-9) -> DataFrame:
    """Cells at or before `until` that change when later data is taken away: per column, how many and the first."""
    key = ["instrument_id", "trade_date"]
    a, b = full.where(F.col("trade_date") <= until), cut.where(F.col("trade_date") <= until)
    both = a.select(*key, *[F.col(c).alias(f"{c}_a") for c in columns]).join(b.select(*key, *[F.col(c).alias(f"{c}_b") for c in columns]), key, "full")
    cells = both.select(*key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_a").alias("a"), F.col(f"{c}_b").alias("b")) for c in columns])).alias("x")).select(*key, "x.*")
    off = (F.col("a").isNull() != F.col("b").isNull()) | (F.abs(F.col("a") - F.col("b")) > tolerance * F.greatest(F.lit(1e-12), F.abs(F.col("a"))))
    return cells.groupBy("column").agg(F.count_if(off).alias("n_off"), F.min(F.when(off, F.struct("trade_date", "instrument_id")))["trade_date"].alias("first_off"))
