"""What follows a model into use: outcomes, statuses, alerts, reports, and money-weighted returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.portfolio import bracket_exits


def known_issues(raw: DataFrame, checks: tuple[str, ...]) -> DataFrame:
    """Rows of an issue list with the reason why one is refused: unknown check, dates in the wrong order, repeated key."""
    n = F.count("*").over(Window.partitionBy("key"))
    problem = F.when(~F.col("check").isin(*checks), "unknown check").when(F.col("date_to") < F.col("date_from"), "dates out of order").when(n > 1, "repeated key")
    return raw.withColumn("problem", problem)


def spec_sync(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Specs by name: new, same, or an error where a stored one has other content."""
    both = stored.select("name", F.col("digest").alias("a")).join(wanted.select("name", F.col("digest").alias("b")), "name", "full")
    return both.select("name", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "unused").when(F.col("a") == F.col("b"), "same").otherwise("error: changed").alias("state"))


def champions(log: DataFrame) -> DataFrame:
    """Champion now and before of each strategy from a status log: the last two that were promoted."""
    w = Window.partitionBy("strategy").orderBy(F.desc("at"), F.desc("model_id"))
    rows = log.where("status = 'champion'").withColumn("r", F.row_number().over(w)).where("r <= 2")
    return rows.groupBy("strategy").agg(F.max(F.when(F.col("r") == 1, F.col("model_id"))).alias("champion"), F.max(F.when(F.col("r") == 2, F.col("model_id"))).alias("previous"))


def retrain_reasons(models: DataFrame, breaches: DataFrame, features: str, days: int) -> DataFrame:
    """Reasons to fit a model again: model_id, kind, age_days (of a schedule). models: model_id, last, trained, features; breaches: model_id, metric."""
    age, none = F.datediff("last", "trained").cast("bigint"), F.lit(None).cast("bigint")
    old = models.where(age > days).select("model_id", F.lit("schedule").alias("kind"), age.alias("age_days"))
    other = models.where(F.col("features") != features).select("model_id", F.lit("new_feature_set").alias("kind"), none.alias("age_days"))
    return old.unionByName(other).unionByName(breaches.select("model_id", F.col("metric").alias("kind"), none.alias("age_days")))


def shrunk_covariance(returns: DataFrame) -> DataFrame:
    """Covariances of all pairs of a group's names, drawn towards the mean variance as far as their own noise asks.

    returns: grp, instrument_id, i, ret. Pairs meet on (grp, i), so a group's square of names is all there is.
    """
    mean = Window.partitionBy("grp", "instrument_id")
    x = returns.withColumn("x", F.col("ret") - F.avg("ret").over(mean)).select("grp", "instrument_id", "i", "x")
    pairs = x.join(x.select("grp", "i", F.col("instrument_id").alias("other"), F.col("x").alias("y")), ["grp", "i"])
    s = pairs.groupBy("grp", "instrument_id", "other").agg(F.avg(F.col("x") * F.col("y")).alias("s"), F.avg(F.pow(F.col("x") * F.col("y"), F.lit(2))).alias("q"), F.count("*").alias("n"))
    t = s.groupBy("grp").agg(
        F.sum(F.when(F.col("instrument_id") == F.col("other"), F.col("s"))).alias("trace"), F.count_if(F.col("instrument_id") == F.col("other")).alias("p"), F.sum(F.pow("s", F.lit(2))).alias("ss"), F.sum((F.col("q") - F.pow("s", F.lit(2))) / F.col("n")).alias("noise")
    ).withColumn("mu", F.col("trace") / F.col("p"))
    t = t.withColumn("apart", F.col("ss") - F.col("p") * F.col("mu") * F.col("mu")).withColumn("shrink", F.when(F.col("apart") > 0, F.least(F.col("noise"), F.col("apart")) / F.col("apart")).otherwise(1.0))
    both = s.join(F.broadcast(t.select("grp", "mu", "shrink")), "grp")  # one row per rebalance
    own = F.when(F.col("instrument_id") == F.col("other"), F.col("mu")).otherwise(0.0)
    return both.select("grp", "instrument_id", "other", (F.col("shrink") * own + (1 - F.col("shrink")) * F.col("s")).alias("covariance"), "shrink")


def internal_rate(flows: DataFrame, rounds: int = 200) -> DataFrame:
    """Yearly money-weighted rate of each portfolio's flows (days, amount) by bisection, inside one expression."""
    f = flows.groupBy("portfolio").agg(F.collect_list(F.struct("days", "amount")).alias("flows"))  # as many as there are months
    value = lambda rate: F.aggregate("flows", F.lit(0.0), lambda a, x: a + x["amount"] * F.pow(1 + rate, -x["days"] / 365.25))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        positive = value(mid) > 0
        return F.struct(F.when(positive, s["lo"]).otherwise(mid).alias("lo"), F.when(positive, mid).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(-0.99).alias("lo"), F.lit(10.0).alias("hi"))
    return f.select("portfolio", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2).alias("rate"))


def partial_targets(trades: DataFrame, bars: DataFrame, share: float) -> DataFrame:
    """A share sold at target1 with the stop at the entry price from the next session on; the rest exits by the bracket.

    trades: as for bracket_exits, with target1. One row per trade: both exits and their mean price.
    """
    first = bracket_exits(trades.withColumn("target", F.col("target1")), bars)
    at_one = first.where(F.col("reason").isin("target", "target gap")).select("trade_id", F.col("exit").alias("exit1"), F.col("exit_price").alias("price1"))
    plain = bracket_exits(trades, bars).join(at_one, "trade_id", "left_anti").select("trade_id", F.lit(None).cast("bigint").alias("exit1"), F.lit(None).cast("double").alias("price1"), F.col("exit").alias("exit2"), F.col("exit_price").alias("price2"))
    later = trades.join(at_one, "trade_id").withColumn("stop", F.col("price")).withColumn("max_hold", F.col("max_hold") - (F.col("exit1") - F.col("entry"))).withColumn("entry", F.col("exit1"))
    rest = bracket_exits(later.select("trade_id", "instrument_id", "entry", "price", "stop", "target", "max_hold"), bars, 0).select("trade_id", F.col("exit").alias("exit2"), F.col("exit_price").alias("price2"))
    out = plain.unionByName(at_one.join(rest, "trade_id", "left").select("trade_id", "exit1", "price1", "exit2", "price2"))
    mean = F.when(F.col("price1").isNull(), F.col("price2")).otherwise(share * F.col("price1") + (1 - share) * F.col("price2"))
    return out.withColumn("mean_price", mean)


def _let(x: Column, f) -> Column:
    """f(x) with x computed once, inside another expression."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _added(m: Column, key: Column, value: Column) -> Column:
    """The map with value added to the key's."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, F.coalesce(F.try_element_at(m, key), F.lit(0.0)) + value))


def accepted_cards(cards: DataFrame, budgets: dict[str, float], name_cap: float, risk_cap: float, capital: float, book: DataFrame | None = None, lot: int = 100) -> DataFrame:
    """Takes each day's cards in order under the portfolio's limits: trade_date, sleeve, instrument_id, weight, quantity, decision.

    cards: trade_date, rank (order of the day), sleeve, instrument_id, weight, quantity, price, risk_share (loss at the stop of one share, as a
    share of capital; null where no stop is held). book: trade_date, used (sleeve -> weight held), names (instrument -> weight
    held in all sleeves), open_risk, stopped (no card is taken); a day without one starts empty.

    A card over what its sleeve or its name has left is cut to whole lots that fit if at least half of it does, else refused; one
    whose stop would take the open risk over risk_cap is refused whole. Each decision needs those before it: a day's cards, at most
    its picks, are folded in order by one expression.
    """
    fields = ["rank", "sleeve", "instrument_id", "weight", "quantity", "price", "risk_share"]
    days = cards.groupBy("trade_date").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("cards"))
    days = days.join(book.select("trade_date", "used", "names", "open_risk", "stopped"), "trade_date", "left") if book is not None else days.selectExpr("*", "null used", "null names", "null open_risk", "null stopped")
    empty = lambda kind: F.create_map().cast(kind)
    start = F.struct(
        F.coalesce(F.col("used").cast("map<string,double>"), empty("map<string,double>")).alias("used"), F.coalesce(F.col("names").cast("map<bigint,double>"), empty("map<bigint,double>")).alias("names"),
        F.coalesce(F.col("open_risk").cast("double"), F.lit(0.0)).alias("risk"), F.array().cast("array<struct<sleeve:string,instrument_id:bigint,weight:double,quantity:bigint,decision:string>>").alias("out"),
    )
    budget = F.create_map(*[F.lit(x) for pair in budgets.items() for x in pair])
    stopped = F.coalesce(F.col("stopped").cast("boolean"), F.lit(False))
    none = F.lit(0.0)

    def fitted(w: Column, q: Column, room: Column, price: Column) -> Column:
        keep = room >= w - 1e-12
        shares = F.floor(F.try_divide(room * capital, price * lot)) * lot
        ok = keep | ((room >= 0.5 * w) & (shares >= lot))
        return F.struct(F.when(keep, w).otherwise(shares * price / capital).alias("w"), F.when(keep, q).otherwise(shares).cast("bigint").alias("q"), F.coalesce(ok, F.lit(False)).alias("ok"), (~keep).alias("cut"))

    def decided(s: Column, c: Column, a: Column, b: Column) -> Column:
        at_risk = s["risk"] + b["q"] * c["risk_share"] > risk_cap + 1e-12
        decision = (
            F.when(stopped, "kill switch").when(~a["ok"], "sleeve full").when(~b["ok"], "name full").when(F.coalesce(at_risk, F.lit(False)), "open risk").when(a["cut"] | b["cut"], "shrunk").otherwise("accepted")
        )
        return F.struct(decision.alias("decision"), b["w"].alias("w"), b["q"].alias("q"))

    def carried(s: Column, c: Column, d: Column) -> Column:
        taken = d["decision"].isin("accepted", "shrunk")
        w, q = F.when(taken, d["w"]).otherwise(none), F.when(taken, d["q"]).otherwise(0).cast("bigint")
        row = F.struct(c["sleeve"].alias("sleeve"), c["instrument_id"].cast("bigint").alias("instrument_id"), w.alias("weight"), q.alias("quantity"), d["decision"].alias("decision"))
        return F.struct(
            _added(s["used"], c["sleeve"], w).alias("used"), _added(s["names"], c["instrument_id"].cast("bigint"), w).alias("names"),
            (s["risk"] + F.coalesce(q * c["risk_share"], none)).alias("risk"), F.concat(s["out"], F.array(row)).alias("out"),
        )

    def step(s: Column, c: Column) -> Column:
        room = F.coalesce(F.try_element_at(budget, c["sleeve"]), none) - F.coalesce(F.try_element_at(s["used"], c["sleeve"]), none)
        left = F.lit(name_cap) - F.coalesce(F.try_element_at(s["names"], c["instrument_id"].cast("bigint")), none)
        return _let(fitted(c["weight"], c["quantity"], room, c["price"]), lambda a: _let(fitted(a["w"], a["q"], left, c["price"]), lambda b: _let(decided(s, c, a, b), lambda d: carried(s, c, d))))

    return days.select("trade_date", F.explode(F.aggregate("cards", start, step)["out"]).alias("x")).select("trade_date", "x.*")


def portfolio_snapshots(trades: DataFrame, closes: DataFrame, capital: float, lot: int = 100) -> DataFrame:
    """Cash, equity, peak, drawdown, exposure and positions of each portfolio and session.

    trades: portfolio, instrument_id, entry, price, exit, exit_price (null while open), a lot each; closes: portfolio, instrument_id,
    session_idx, trade_date, close (null without a bar: the last one counts). Quantities are running sums of steps, so that no trade
    meets all the sessions it lasts. Positions (instrument:quantity, by instrument) are listed for the last session only.
    """
    bought = trades.select("portfolio", "instrument_id", F.col("entry").alias("session_idx"), F.lit(lot).alias("step"), (-lot * F.col("price")).alias("flow"))
    sold = trades.where("exit is not null").select("portfolio", "instrument_id", F.col("exit").alias("session_idx"), F.lit(-lot).alias("step"), (lot * F.col("exit_price")).alias("flow"))
    keys = ["portfolio", "instrument_id", "session_idx"]
    steps = bought.unionByName(sold).groupBy(*keys).agg(F.sum("step").alias("step"), F.sum("flow").alias("flow"))
    w = Window.partitionBy("portfolio", "instrument_id").orderBy("session_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = closes.join(steps, keys, "left").withColumn("held", F.coalesce(F.sum("step").over(w), F.lit(0))).withColumn("last_close", F.coalesce(F.last("close", True).over(w), F.lit(0.0)))
    position = F.when(F.col("held") > 0, F.struct("instrument_id", "held"))
    day = rows.groupBy("portfolio", "session_idx", "trade_date").agg(
        F.coalesce(F.sum("flow"), F.lit(0.0)).alias("flow"), F.sum(F.col("held") * F.col("last_close")).alias("market_value"), F.array_sort(F.collect_list(position)).alias("open")
    )
    past = Window.partitionBy("portfolio").orderBy("session_idx").rowsBetween(Window.unboundedPreceding, 0)  # one row per session
    day = day.withColumn("cash", F.sum("flow").over(past) + capital).withColumn("equity", F.col("cash") + F.col("market_value")).withColumn("peak", F.max("equity").over(past))
    latest = F.col("session_idx") == F.max("session_idx").over(Window.partitionBy("portfolio"))
    listed = F.array_join(F.transform("open", lambda x: F.concat_ws(":", x["instrument_id"], x["held"])), ",")
    return day.select(
        "portfolio", "trade_date", "cash", "equity", "peak", (F.col("equity") / F.col("peak") - 1).alias("drawdown"), F.try_divide("market_value", "equity").alias("exposure"), F.when(latest, listed).alias("positions")
    )
