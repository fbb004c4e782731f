"""Weights, schedules, orders against bars, and what trades came to: set-based, no event loop."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import col, ratio, settled

# schedules and weights


def rebalance_sessions(calendar: DataFrame, period: str) -> DataFrame:
    """First session of each ISO week, month or quarter."""
    d = F.col("trade_date")
    keys = {"week": [F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d)], "month": [F.year(d), F.month(d)], "quarter": [F.year(d), F.quarter(d)]}[period]
    return calendar.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.min("session_idx").alias("session_idx"), F.min("trade_date").alias("trade_date")).select("session_idx", "trade_date")


def session_after(calendar: DataFrame, k: int, name: str) -> DataFrame:
    """The k-th session after each; beyond the last known session it goes on by weekdays."""
    ahead = calendar.select((F.col("session_idx") - k).alias("session_idx"), F.col("trade_date").alias(name))
    end = calendar.agg(F.max("trade_date").alias("last_date"), F.max("session_idx").alias("last_idx"))
    days = F.filter(F.sequence(F.date_add("last_date", 1), F.date_add("last_date", 2 * k + 3)), lambda d: F.weekday(d) < 5)
    rows = calendar.join(ahead, "session_idx", "left").crossJoin(F.broadcast(end))  # one row
    return rows.withColumn(name, F.coalesce(name, F.try_element_at(days, (F.col("session_idx") + k - F.col("last_idx")).cast("int")))).drop("last_date", "last_idx")


def next_period(date: str, period: str) -> Column:
    """First weekday of the week, month or quarter after a date's own."""
    start = F.trunc(date, period)
    after = {"week": F.date_add(start, 7), "month": F.add_months(start, 1), "quarter": F.add_months(start, 3)}[period]
    return F.date_add(after, F.when(F.weekday(after) == 5, 2).when(F.weekday(after) == 6, 1).otherwise(0))


def seeded_random(seed: int, *keys: str) -> Column:
    """A number in [0, 1) drawn by md5 of the seed and the keys: the same in every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), *[F.col(k) for k in keys])), 1, 8), 16, 10).cast("bigint") / 4294967296.0


def top_k(rows: DataFrame, score: str, k: int, highest: bool = True, by: tuple[str, ...] = ("trade_date",)) -> DataFrame:
    """The k best of each group, nulls never, ties by instrument."""
    order = F.col(score).desc() if highest else F.col(score).asc()
    w = Window.partitionBy(*by).orderBy(order, "instrument_id")
    return rows.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def equal_weights(rows: DataFrame) -> DataFrame:
    return rows.withColumn("weight", 1 / F.count("*").over(Window.partitionBy("trade_date")))


def inverse_volatility_weights(rows: DataFrame, vol: str) -> DataFrame:
    """In proportion to 1 / vol; equal where any volatility of the date is missing or 0."""
    w = Window.partitionBy("trade_date")
    bad = F.max((F.col(vol).isNull() | (F.col(vol) <= 0)).cast("int")).over(w) == 1
    inverse = F.try_divide(F.lit(1.0), F.col(vol))
    return rows.withColumn("weight", F.when(bad, 1 / F.count("*").over(w)).otherwise(inverse / F.sum(inverse).over(w)))


def capped_weights(rows: DataFrame, cap: float) -> DataFrame:
    """No weight above the cap; the excess goes to the others pro rata until none is above; the rest stays cash.

    In order of weight, the names that end at the cap are a prefix: those i for which the cap is below
    w_i * (1 - i * cap) / (sum of the weights from i on). So one sort with running sums is enough.
    """
    w = Window.partitionBy("trade_date").orderBy(F.desc("weight"), "instrument_id")
    before = F.coalesce(F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("weight").over(Window.partitionBy("trade_date"))
    i = F.row_number().over(w) - 1
    rows = rows.withColumn("cap_rest", total - before).withColumn("cap_room", total - i * cap)
    over = F.col("weight") * F.col("cap_room") > cap * F.col("cap_rest")
    rows = rows.withColumn("cap_over", over & (F.col("cap_rest") > 0))
    n = F.sum(F.col("cap_over").cast("int")).over(Window.partitionBy("trade_date"))
    free = F.sum(F.when(~F.col("cap_over"), F.col("weight"))).over(Window.partitionBy("trade_date"))
    value = F.when(F.col("cap_over"), F.lit(cap)).otherwise(F.least(F.lit(cap), F.col("weight") * ratio(total - n * cap, free)))
    return rows.withColumn("capped", value).drop("cap_rest", "cap_room", "cap_over")


def prob_filter(rows: DataFrame, score: str, proba: str, multiple: float, base: float) -> DataFrame:
    return rows.withColumn(score, F.when(F.col(proba) >= multiple * base, F.col(score)))


def tranches(targets: DataFrame, schedule: DataFrame, last: DataFrame, steps: int, spacing: int) -> DataFrame:
    """From the weights held to the target in equal steps, `spacing` sessions apart: (session_idx, instrument_id, weight).

    targets: session_idx, instrument_id, weight > 0, at most once each; schedule: session_idx of all rebalances; last: one row,
    session_idx of the last session. Steps that would fall on the next rebalance or later are dropped, so that what is held then is
    only part of the way: p' = p + (target - p) * done / steps. A rebalance without targets changes nothing. A name's path is one
    array over the rebalances, which are few.
    """
    order = Window.orderBy("session_idx")  # one row per rebalance
    with_names = targets.select("session_idx", F.lit(1).alias("any")).distinct()
    ahead = schedule.crossJoin(F.broadcast(last.withColumnRenamed("session_idx", "last"))).withColumn("stop", F.coalesce(F.lead("session_idx").over(order), F.col("last") + 1))  # one row
    room = F.least(F.lit(steps), F.floor((F.col("stop") - 1 - F.col("session_idx")) / spacing) + 1)
    plan = ahead.join(with_names, "session_idx", "left").select("session_idx", F.when(F.col("any") == 1, room).otherwise(0).cast("int").alias("done"))
    plan = plan.agg(F.array_sort(F.collect_list(F.struct("session_idx", "done"))).alias("plan"))
    names = targets.groupBy("instrument_id").agg(F.map_from_entries(F.collect_list(F.struct("session_idx", "weight"))).alias("wanted"))
    target = lambda r: F.coalesce(F.try_element_at("wanted", r["session_idx"]), F.lit(0.0))
    move = lambda s, r: F.struct(
        (s["held"] + (target(r) - s["held"]) * r["done"] / steps).alias("held"),
        F.array_append(s["path"], F.struct(r["session_idx"].alias("session_idx"), r["done"].alias("done"), s["held"].alias("before"), target(r).alias("target"))).alias("path"),
    )
    start = F.struct(F.lit(0.0).alias("held"), F.expr("cast(array() as array<struct<session_idx: bigint, done: int, before: double, target: double>>)").alias("path"))
    path = names.crossJoin(F.broadcast(plan)).select("instrument_id", F.explode(F.aggregate("plan", start, move, lambda s: s["path"])).alias("x")).select("instrument_id", "x.*")  # one row
    rows = path.where("done > 0 and (before > 1e-9 or target > 0)").withColumn("step", F.explode(F.sequence(F.lit(1), F.col("done"))))
    weight = F.col("before") + (F.col("target") - F.col("before")) * F.col("step") / steps
    return rows.select((F.col("session_idx") + (F.col("step") - 1) * spacing).alias("session_idx"), "instrument_id", weight.alias("weight")).where("weight > 1e-9")


def trailing_returns(picks: DataFrame, returns: DataFrame, window: int, least: int = 60) -> DataFrame:
    """The last `window` sessions' returns of the names chosen at each rebalance: (grp, instrument_id, i, ret), without gaps.

    picks: grp (session of the rebalance), instrument_id; returns: session_idx, instrument_id, ret. A name with fewer than `least`
    returns takes the mean of the group's others on that day; other gaps are 0. A pick asks for its `window` days by key, so the join
    is on equal columns.
    """
    days = F.explode(F.sequence(F.greatest(F.col("grp") - window + 1, F.lit(1).cast("bigint")), F.col("grp")))
    wanted = picks.select("grp", "instrument_id", days.alias("session_idx"))
    rows = wanted.join(returns.select("session_idx", "instrument_id", "ret"), ["session_idx", "instrument_id"], "left")
    rows = rows.withColumn("seen", F.count("ret").over(Window.partitionBy("grp", "instrument_id")) >= least)
    mean = F.avg(F.when(F.col("seen"), F.col("ret"))).over(Window.partitionBy("grp", "session_idx"))
    value = F.coalesce(F.when(F.col("seen"), F.col("ret")).otherwise(mean), F.lit(0.0))
    return rows.select("grp", "instrument_id", F.col("session_idx").alias("i"), value.alias("ret"))


def sleeve_overlap(targets: DataFrame) -> DataFrame:
    """Names that two or more sleeves hold on a day, with their number and their summed weight. targets: sleeve, trade_date, instrument_id, weight."""
    s = targets.groupBy("trade_date", "instrument_id").agg(F.count_distinct("sleeve").alias("sleeves"), F.sum("weight").alias("combined"))
    return s.where("sleeves > 1")


def risk_parity(returns: DataFrame, rounds: int = 200) -> DataFrame:
    """Equal risk contributions by fixed-point steps on the covariance of each group's columns of names.

    returns: grp, instrument_id, i (day number), ret. A group holds the names chosen at one rebalance: K by K.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        wide = pdf.pivot_table(index="i", columns="instrument_id", values="ret").dropna()
        c = np.cov(wide.to_numpy().T, bias=True).reshape(wide.shape[1], -1) + 1e-12 * np.eye(wide.shape[1])
        w = np.full(len(c), 1 / len(c))
        for _ in range(rounds):
            w = np.sqrt(w / np.maximum(c @ w, 1e-18))
            w /= w.sum()
        share = w * (c @ w) / (w @ c @ w)
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "instrument_id": wide.columns.astype("int64"), "weight": w, "risk_share": share})

    return returns.groupBy("grp").applyInPandas(solve, "grp bigint, instrument_id bigint, weight double, risk_share double")


# market mechanics


def tick(price: Column | str) -> Column:
    """Tick size by price."""
    p = col(price)
    return F.when(p < 10, 0.01).when(p < 50, 0.05).otherwise(0.1)


def tick_round(price: Column | str, up: bool) -> Column:
    """To the tick above or below, a billionth of a tick being no difference."""
    p, t = col(price), tick(price)
    n = F.ceil(p / t - 1e-9) if up else F.floor(p / t + 1e-9)
    return n * t


def trade_cost(side: Column, quantity: Column, price: Column, fee: float = 0.0015, tax: float = 0.001, slip: float = 0.0005, times: Column | float = 1.0) -> Column:
    """Fee on both sides, tax on sales, adverse slippage, all times a multiplier."""
    value = quantity * price
    return value * (fee + slip + F.when(side == "sell", tax).otherwise(0.0)) * times


def lots(cash: Column, price: Column, lot: int = 100) -> Column:
    return F.floor(F.try_divide(cash, price * lot)) * lot


def inferred_band(grid: DataFrame, allowed: tuple[float, ...] = (0.07, 0.1, 0.15)) -> DataFrame:
    """Smallest allowed band that holds the largest move of the last 252 sessions, less half a percent, known the day before."""
    w = Window.partitionBy("instrument_id").orderBy("session_idx")
    move = F.abs(ratio("close", F.lag("close").over(w)) - 1)
    most = F.max("move").over(w.rowsBetween(-252, -1)) - 0.005
    band = F.lit(allowed[-1])
    for b in reversed(allowed[:-1]):
        band = F.when(F.col("most") <= b, b).otherwise(band)
    return grid.withColumn("move", move).withColumn("most", most).withColumn("band", F.when(F.col("most").isNotNull(), band)).drop("move", "most")


# orders against bars


def market_conditions(grid: DataFrame, statuses: DataFrame, band: float) -> DataFrame:
    """Bars with what stops a trade: suspended, up_locked (all at the ceiling: nobody sells), down_locked (all at the floor: nobody buys).

    grid: instrument_id, trade_date, session_idx, prices; statuses: intervals [valid_from, valid_to). The band is taken around the
    last close before the session.
    """
    w = Window.partitionBy("instrument_id").orderBy("session_idx").rowsBetween(Window.unboundedPreceding, -1)
    s = statuses.where("status = 'suspended'").select(F.col("instrument_id").alias("sid"), "valid_from", "valid_to", F.lit(True).alias("stopped")).distinct()
    on = (F.col("instrument_id") == F.col("sid")) & (F.col("trade_date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("trade_date") < F.col("valid_to")))
    rows = grid.withColumn("ref", F.last("close", ignorenulls=True).over(w)).join(s, on, "left")
    one_price = F.col("high") == F.col("low")
    up = one_price & (F.col("high") >= tick_round(F.col("ref") * (1 + band), False))
    down = one_price & (F.col("low") <= tick_round(F.col("ref") * (1 - band), True))
    no = F.lit(False)
    return rows.select(*grid.columns, F.coalesce("stopped", no).alias("suspended"), F.coalesce(up, no).alias("up_locked"), F.coalesce(down, no).alias("down_locked"))


def entry_fills(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """First fill of each order in its sessions, or why there is none.

    orders: order_id, instrument_id, first, last (session numbers), kind (open, limit, stop, zone), low, high,
    cap; bars: of market_conditions. open: at the open; limit: at the lower of open and limit; stop: at the higher of open and
    trigger; zone: at an open inside [low, high]. An open above the cap cancels the order on its first session. Sessions
    suspended or locked at the ceiling fill nothing.
    """
    b = bars.where("open is not null or suspended").select(F.col("instrument_id").alias("bid"), "session_idx", F.when(~F.col("suspended"), F.col("open")).alias("open"), F.col("high").alias("bh"), F.col("low").alias("bl"), "suspended", "up_locked")
    seen = orders.join(b, (F.col("instrument_id") == F.col("bid")) & F.col("session_idx").between(F.col("first"), F.col("last")), "left")
    o, kind = F.col("open"), F.col("kind")
    price = (
        F.when(kind == "open", o).when((kind == "limit") & (F.col("bl") <= F.col("high")), F.least(o, F.col("high")))
        .when((kind == "stop") & (F.col("bh") >= F.col("low")), F.greatest(o, F.col("low"))).when((kind == "zone") & o.between(F.col("low"), F.col("high")), o)
    )
    price = F.when((o <= F.col("cap")) & ~F.col("up_locked"), price)
    gone = (F.col("session_idx") == F.col("first")) & (o > F.col("cap"))
    s = seen.withColumn("price", price).groupBy("order_id", "instrument_id").agg(
        F.min_by(F.struct("session_idx", "price"), F.when(F.col("price").isNotNull(), F.col("session_idx"))).alias("fill"), F.max(F.coalesce(gone, F.lit(False))).alias("gone"),
        F.count("open").alias("sessions"), F.count_if("suspended").alias("halts"), F.count_if(F.col("open").isNotNull() & F.col("up_locked")).alias("locks"),
    )
    ok = F.col("fill.price").isNotNull() & ~F.col("gone")
    reason = (
        F.when(F.col("gone"), "cancelled: opened above cap").when((F.col("sessions") == 0) & (F.col("halts") > 0), "suspended").when(F.col("sessions") == 0, "no bar")
        .when(~ok & (F.col("locks") == F.col("sessions")), "locked at the ceiling").when(~ok, "expired")
    )
    return s.select("order_id", "instrument_id", F.when(ok, F.col("fill.session_idx")).alias("session_idx"), F.when(ok, F.col("fill.price")).alias("price"), reason.alias("reason"))


def bracket_exits(trades: DataFrame, bars: DataFrame, settle: int = 2, grace: int = 5) -> DataFrame:
    """First exit after settlement: stop gap, target gap, stop, target, or time at the close of the last session.

    trades: trade_id, instrument_id, entry (session), price, stop, target, max_hold; bars: of market_conditions. Sessions suspended
    or locked at the floor are skipped; a time exit that falls on one is made in the next `grace` sessions, else the trade stays open.
    """
    b = bars.where("close is not null and not suspended and not down_locked").select(F.col("instrument_id").alias("bid"), "session_idx", F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"))
    on = (F.col("instrument_id") == F.col("bid")) & F.col("session_idx").between(F.col("entry") + settle + 1, F.col("entry") + F.col("max_hold") + grace)
    o = F.col("o")
    event = (
        F.when(o <= F.col("stop"), F.struct(o.alias("price"), F.lit("stop gap").alias("reason"))).when(o >= F.col("target"), F.struct(o.alias("price"), F.lit("target gap").alias("reason")))
        .when(F.col("l") <= F.col("stop"), F.struct(F.col("stop").alias("price"), F.lit("stop").alias("reason"))).when(F.col("h") >= F.col("target"), F.struct(F.col("target").alias("price"), F.lit("target").alias("reason")))
        .when(F.col("session_idx") >= F.col("entry") + F.col("max_hold"), F.struct(F.col("c").alias("price"), F.lit("time").alias("reason")))
    )
    rows = trades.join(b, on, "left").withColumn("event", event)
    s = rows.groupBy("trade_id", "instrument_id", "price", "entry").agg(F.min_by(F.struct("session_idx", "event"), F.when(F.col("event").isNotNull(), F.col("session_idx"))).alias("x"))
    return s.select("trade_id", "instrument_id", "entry", "price", F.col("x.session_idx").alias("exit"), F.col("x.event.price").alias("exit_price"), F.coalesce("x.event.reason", F.lit("open")).alias("reason"))


def lifecycles(fills: DataFrame) -> DataFrame:
    """Positions opened by a first buy and closed when the quantity is 0 again: gaps and islands on a running sum."""
    w = Window.partitionBy("instrument_id").orderBy("session_idx", "fill_id").rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    rows = fills.withColumn("q", F.sum(signed).over(w))
    done = F.coalesce(F.sum((F.col("q") == 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("lifecycle", done)
    return rows.groupBy("instrument_id", "lifecycle").agg(
        F.min("session_idx").alias("opened"), F.when(F.min_by("q", -F.col("fill_id")) == 0, F.max("session_idx")).alias("closed"), F.max("q").alias("most"), F.count("*").alias("fills"),
        F.sum(F.when(F.col("side") == "buy", -F.col("quantity") * F.col("price")).otherwise(F.col("quantity") * F.col("price"))).alias("cash"),
    )


def weight_returns(weights: DataFrame, returns: DataFrame, rate: float, multipliers: tuple[float, ...] = (1.0,)) -> DataFrame:
    """Daily portfolio return from weights held since the day before, less rate * turnover, for each cost multiplier."""
    w = Window.partitionBy("portfolio", "instrument_id").orderBy("session_idx")
    held = weights.withColumn("before", F.coalesce(F.lag("weight").over(w), F.lit(0.0)))
    rows = held.join(returns, ["instrument_id", "session_idx"], "left")
    daily = rows.groupBy("portfolio", "session_idx").agg(F.sum(F.col("before") * F.coalesce("ret", F.lit(0.0))).alias("gross"), F.sum(F.abs(F.col("weight") - F.col("before"))).alias("turnover"))
    times = F.explode(F.array(*[F.lit(float(m)) for m in multipliers])).alias("multiplier")
    return daily.select("portfolio", "session_idx", times, "gross", "turnover").withColumn("net", F.col("gross") - rate * F.col("multiplier") * F.col("turnover"))


def kill_states(equity: DataFrame, stop: float, cooldown: int) -> DataFrame:
    """trading, stopped or cooling for each session of each portfolio (portfolio, session_idx, equity).

    A fall of `stop` below the peak stops trading; `cooldown` sessions after the stop it resumes, with the peak starting at that session's
    equity. A portfolio's state is folded over its sessions in order, one number each; only its stops are kept.
    """
    ordered = equity.groupBy("portfolio").agg(F.array_sort(F.collect_list(F.struct("session_idx", "equity"))).alias("days"))
    start = F.struct(F.lit(0).alias("i"), F.lit(None).cast("double").alias("peak"), F.lit(-1).alias("until"), F.array().cast("array<int>").alias("stops"))

    def step(s: Column, day: Column) -> Column:
        cooling = (s["until"] > s["i"])
        peak = F.when(cooling, s["peak"]).when(s["until"] == s["i"], day["equity"]).otherwise(F.greatest(s["peak"], day["equity"]))  # greatest() skips the null at the start
        falls = ~cooling & (F.try_divide(day["equity"], peak) - 1 <= -stop)
        falls = F.coalesce(falls, F.lit(False))
        return F.struct(
            (s["i"] + 1).alias("i"), peak.alias("peak"), F.when(falls, s["i"] + cooldown).otherwise(s["until"]).alias("until"), F.when(falls, F.concat(s["stops"], F.array(s["i"]))).otherwise(s["stops"]).alias("stops")
        )

    folded = ordered.select("portfolio", "days", F.aggregate("days", start, step)["stops"].alias("stops"))
    rows = folded.select("portfolio", "stops", F.posexplode("days").alias("i", "day"))
    last = F.expr("array_max(filter(stops, x -> x <= i))")
    state = F.when(last.isNull() | (F.col("i") >= last + cooldown), F.when(last == F.col("i"), "stopped").otherwise("trading")).when(last == F.col("i"), "stopped").otherwise("cooling")
    return rows.select("portfolio", F.col("day.session_idx").alias("session_idx"), state.alias("state"))


def evidence_grade(n: Column, area: Column, gap: Column) -> Column:
    """A to D from the number of cases, the ROC area and the calibration gap."""
    g = F.abs(gap)
    return F.when((n >= 500) & (area >= 0.55) & (g <= 0.05), "A").when((n >= 200) & (area >= 0.52) & (g <= 0.1), "B").when(n >= 50, "C").otherwise("D")


# fixed values of the card rules: shares of the close, or multiples of the average range
BREAKOUT_WITHIN = 0.02
BREAKOUT_BUFFER, BREAKOUT_ZONE = 0.1, 0.3
PULLBACK = (0.6, 0.15)
AT_OPEN = (-0.01, 0.01)


def nearest(price: Column | str) -> Column:
    """To the nearest tick, halves up."""
    return F.floor(col(price) / tick(price) + 0.5) * tick(price)


def card_levels(signals: DataFrame, style: str = "auto", stop_atr: float = 1.0, target_atr: tuple[float, float] = (1.0, 2.0), least: float = 1.5) -> DataFrame:
    """Entry style, zone, stop and targets on ticks inside the next session's band, and why a card is refused.

    signals: close, atr, floor, ceiling (of the next session), high_20, high_60. Styles: `pullback` is a limit zone below the close,
    `breakout` a trigger above the 20-session high (not chased far beyond it), `open` a zone around the close; `auto` takes a breakout
    where the close is near that high. Targets end a tick below the 60-session high where it lies above the entry; the reward to the
    second target must be `least` times the risk.
    """
    p, a = F.col("close"), F.col("atr")
    near_high = F.coalesce(p >= F.col("high_20") * (1 - BREAKOUT_WITHIN), F.lit(False))
    rows = signals.withColumn("style", F.when(near_high, "breakout").otherwise("pullback") if style == "auto" else F.lit(style))
    is_ = lambda name: F.col("style") == name
    rows = settled(rows, trigger=F.when(is_("breakout"), tick_round(F.col("high_20") + BREAKOUT_BUFFER * a, True)))
    low = F.when(is_("breakout"), F.col("trigger")).when(is_("pullback"), tick_round(p - PULLBACK[0] * a, False)).otherwise(tick_round(p * (1 + AT_OPEN[0]), False))
    high = F.when(is_("breakout"), F.greatest(F.col("trigger"), tick_round(F.col("trigger") + BREAKOUT_ZONE * a, False))).when(is_("pullback"), tick_round(p - PULLBACK[1] * a, False)).otherwise(tick_round(p * (1 + AT_OPEN[1]), False))
    rows = settled(rows, zone_low=F.when(low.isNotNull(), F.greatest(low, F.col("floor"))), zone_high=F.when(high.isNotNull(), F.least(high, F.col("ceiling"))))
    rows = settled(rows, reference=F.when(F.col("zone_low").isNotNull(), F.least(F.greatest(nearest((F.col("zone_low") + F.col("zone_high")) / 2), F.col("zone_low")), F.col("zone_high"))))
    ref, top = F.col("reference"), F.col("high_60")
    rows = rows.withColumn("stop", tick_round(ref - stop_atr * a, False)).withColumn("limit", F.when(top > ref, tick_round(top - tick(top), False)))
    rows = rows.withColumn("wanted", tick_round(ref + target_atr[1] * a, True)).withColumn("target2", F.when(F.col("wanted").isNotNull(), F.least("wanted", "limit")))
    rows = rows.withColumn("target1", F.when(F.col("wanted").isNotNull(), F.least(tick_round(ref + target_atr[0] * a, True), F.col("limit"), F.col("target2")))).withColumn("capped", F.col("target2") < F.col("wanted"))
    rows = rows.withColumn("reward_risk", F.try_divide(F.col("target2") - ref, ref - F.col("stop")))
    reason = (
        F.when(a.isNull(), "no volatility").when(is_("breakout") & F.col("high_20").isNull(), "no high to break").when(F.col("trigger") > F.col("ceiling"), "trigger above the ceiling")
        .when((F.col("zone_low") > F.col("zone_high")) | (F.col("zone_high") <= F.col("floor")), "zone outside the band").when((F.col("stop") <= 0) | (F.col("stop") >= ref), "no valid stop")
        .when(F.col("limit") <= ref + tick(ref), "resistance too near").when(F.col("target1") <= ref, "target not above entry").when(F.col("reward_risk") < least, "reward below risk")
    )
    return rows.withColumn("reason", reason).drop("limit", "wanted")


def invest_levels(signals: DataFrame, capital: float, cap: float, below: float = -0.03, above: float = 0.01, lot: int = 100) -> DataFrame:
    """Zone, reference and scenario prices on ticks, weight under a cap, lots, or why there is no card.

    signals: close, floor, ceiling (of the next session), q10, q50, q90 (returns), weight. The zone is the close less and plus its
    shares, inside the floor and ceiling; scenario prices start from the tick nearest to its middle, kept inside it.
    """
    p = F.col("close")
    rows = signals.withColumn("zone_low", F.greatest(tick_round(p * (1 + below), False), F.col("floor"))).withColumn("zone_high", F.least(tick_round(p * (1 + above), False), F.col("ceiling")))
    rows = rows.withColumn("reference", F.least(F.greatest(nearest((F.col("zone_low") + F.col("zone_high")) / 2), F.col("zone_low")), F.col("zone_high")))
    at = lambda q: F.col("reference") * (1 + F.col(q))
    rows = rows.withColumn("bear", F.greatest(tick_round(at("q10"), False), F.lit(0.01))).withColumn("base", nearest(at("q50"))).withColumn("bull", tick_round(at("q90"), True))
    rows = rows.withColumn("weight", F.least(F.col("weight"), F.lit(cap))).withColumn("quantity", lots(F.col("weight") * capital, F.col("zone_high"), lot))
    missing = F.col("q10").isNull() | F.col("q50").isNull() | F.col("q90").isNull()
    off = (F.col("zone_low") > F.col("zone_high")) | (F.col("zone_high") <= F.col("floor"))
    reason = F.when(p.isNull() | (p <= 0), "no price").when(missing, "no scenarios").when(off, "zone outside the band").when(F.col("quantity") < lot, "less than a lot")
    return rows.withColumn("reason", reason)


def card_sizing(cards: DataFrame, capital: float, risk: float, cap: float, room: Column | None = None, lot: int = 100) -> DataFrame:
    """Weight, quantity, what the stop would cost, and why a card can't be sized.

    The way from the reference price to the stop costs `risk` of the capital; the weight is held under a cap and under the room that its name has
    left, and is then that of the whole lots that it buys at the zone's top. Under one lot there is no card.
    """
    wanted = F.least(F.lit(cap), ratio(F.lit(risk), ratio(F.col("reference") - F.col("stop"), F.col("reference"))))
    if room is not None:
        wanted = F.least(wanted, F.when(room.isNotNull(), F.greatest(room, F.lit(0.0))))  # no room is named: no limit
    rows = settled(cards.withColumn("wanted", wanted), quantity=lots(F.lit(capital) * F.col("wanted"), F.col("zone_high"), lot))
    few = F.coalesce(F.col("quantity") < lot, F.lit(True))
    sized = lambda x: F.when(~few, x)
    at_stop = F.col("quantity") * (F.col("reference") - F.col("stop"))
    return rows.withColumns({
        "weight": sized(F.col("quantity") * F.col("zone_high") / capital), "risk_if_stop": sized(at_stop), "risk": sized(at_stop / capital), "refused": F.when(few, "less than a lot"), "quantity": sized(F.col("quantity")),
    }).drop("wanted")


def card_problems(cards: DataFrame) -> Column:
    """What is wrong with a card: missing parts, order of levels, off-tick prices, an entry zone outside the band around the close."""
    off_tick = lambda c: F.abs(F.col(c) / tick(c) - F.round(F.col(c) / tick(c))) > 1e-6
    checks = [
        ("no stop", F.col("stop").isNull()), ("no target", F.col("target1").isNull()), ("stop not below zone", F.col("stop") >= F.col("zone_low")),
        ("zone upside down", F.col("zone_low") > F.col("zone_high")), ("target not above zone", F.col("target1") <= F.col("zone_high")), ("stop off tick", off_tick("stop")), ("target off tick", off_tick("target1")),
        ("zone outside the band", (F.col("zone_low") < F.col("close") * (1 - F.col("band"))) | (F.col("zone_high") > F.col("close") * (1 + F.col("band")))),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(text)) for text, c in checks]))
