"""Hand-worked cases and planted behaviour, for what a table comparison doesn't show."""

import datetime
import math
import pathlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import datasets as D
from barloom.operators import features as X
from barloom.operators import ingest as I
from barloom.operators import lifecycle as L
from barloom.operators import metrics as S
from barloom.operators import models as M
from barloom.operators import plugins as G
from barloom.operators import portfolio as T
from barloom.operators import universe as U
from barloom.sources import files, store
from barloom.sources.files import scratch
from barloom.streaming import bars as Z

D0 = datetime.date(2020, 1, 1)


def panel(spark, closes, instrument=1):
    rows = [(instrument, D0 + datetime.timedelta(days=i), i + 1, float(c), float(c) + 1, float(c) - 1, float(c), 100.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "instrument_id bigint, trade_date date, bar_idx bigint, open double, high double, low double, close double, volume double")


def values(df, column):
    return [r[column] for r in df.orderBy("bar_idx").collect()]


@pytest.mark.parametrize("alpha", [2 / 13, 1 / 14, 0.9, 0.01])
def test_ewm_equals_recursion_over_long_series(spark, alpha):
    rng = random.Random(1)
    xs = [rng.gauss(0, 3) for _ in range(3000)]
    got = values(X.ewm(panel(spark, xs), "close", "y", alpha, 5), "y")
    want = pd.Series(xs).ewm(alpha=alpha, adjust=False, min_periods=5).mean()
    assert got[:4] == [None] * 4
    np.testing.assert_allclose(got[4:], want[4:], rtol=1e-9, atol=1e-9)


def test_rsi_flat_and_rising(spark):
    assert values(X.rsi(panel(spark, [5.0] * 20)), "rsi")[-1] == 50
    assert values(X.rsi(panel(spark, range(1, 21))), "rsi")[-1] == 100


def test_features_never_see_the_future(spark):
    rng = random.Random(2)
    xs = list(np.cumsum([rng.gauss(0, 1) for _ in range(300)]) + 100)
    make = lambda n: X.feature_frame(panel(spark, xs[:n]), [k for k in X.REGISTRY if k != ("liquidity", 2)])
    off = X.audit(make(300), make(200), ["ret_5", "rsi", "macd", "zscore", "bollinger", "donchian_high"], str(D0 + datetime.timedelta(days=199)))
    assert {r.n_off for r in off.collect()} == {0}


def test_a_leak_is_caught(spark):
    leak = lambda df: df.withColumn("leak", F.lead("close").over(X.own()))
    xs = list(range(1, 60))
    off = X.audit(leak(panel(spark, xs)), leak(panel(spark, xs[:40])), ["leak"], str(D0 + datetime.timedelta(days=39)))
    assert off.first().n_off == 1


def test_registry_refuses_names_of_instruments():
    with pytest.raises(ValueError):
        X.register("symbol", 1, 0, X.gap)
    with pytest.raises(ValueError):
        X.register("gap", 1, 0, X.gap)


def test_triple_barrier_stop_wins_and_gap_exits_at_open(spark):
    bars = [(10.0, 10.5, 9.5, 10.0), (10.0, 14.0, 6.0, 10.0), (10.0, 10.2, 9.9, 10.0), (20.0, 21.0, 19.0, 20.0)]
    rows = [(1, i + 1, D0 + datetime.timedelta(days=i), *b, 1.0) for i, b in enumerate(bars)]
    g = spark.createDataFrame(rows, "instrument_id bigint, session_idx bigint, trade_date date, open double, high double, low double, close double, atr double")
    out = {r.session_idx: r for r in X.triple_barrier(g, "atr", 2, 2, 1).collect()}
    assert (out[1].tb_label, out[1].tb_ret) == (-1, pytest.approx(-0.2))  # both touched: the stop
    assert (out[3].tb_label, out[3].tb_ret) == (1, pytest.approx(1.0))  # opens beyond the target
    assert out[2].tb_label == 0 and out[4].tb_label is None


def test_cs_rank_averages_ties(spark):
    df = spark.createDataFrame([(D0, i, x) for i, x in enumerate([1.0, 2.0, 2.0, 3.0, None])], "trade_date date, instrument_id bigint, x double")
    assert {r.instrument_id: r.r for r in X.cs_rank(df, "x", "r").collect()} == {0: 0.25, 1: 0.625, 2: 0.625, 3: 1.0, 4: None}


def test_capped_weights_hand_case(spark):
    df = spark.createDataFrame([(D0, i, w) for i, w in enumerate([0.5, 0.3, 0.15, 0.05])], "trade_date date, instrument_id bigint, weight double")
    got = {r.instrument_id: r.capped for r in T.capped_weights(df, 0.35).collect()}
    assert got == pytest.approx({0: 0.35, 1: 0.35, 2: 0.225, 3: 0.075})
    few = {r.instrument_id: r.capped for r in T.capped_weights(df.where("instrument_id < 2"), 0.3).collect()}
    assert few == pytest.approx({0: 0.3, 1: 0.3})  # the rest stays cash


def test_risk_parity_shares_are_equal(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, [0.01, 0.02, 0.04], (250, 3))
    df = spark.createDataFrame([(1, j, i, float(x[i, j])) for i in range(250) for j in range(3)], "grp bigint, instrument_id bigint, i bigint, ret double")
    rows = T.risk_parity(df).collect()
    assert sum(r.weight for r in rows) == pytest.approx(1) and all(r.risk_share == pytest.approx(1 / 3, abs=1e-3) for r in rows)


def test_internal_rate_doubles_in_a_year(spark):
    df = spark.createDataFrame([(1, 0.0, 100.0), (1, 365.25, -200.0)], "portfolio bigint, days double, amount double")
    assert L.internal_rate(df).first().rate == pytest.approx(1.0)


def test_kill_switch_cools_down(spark):
    df = spark.createDataFrame([(1, i, e) for i, e in enumerate([100.0, 120.0, 90.0, 80.0, 85.0, 86.0])], "portfolio bigint, session_idx bigint, equity double")
    assert [r.state for r in T.kill_states(df, 0.2, 2).orderBy("session_idx").collect()] == ["trading", "trading", "stopped", "cooling", "trading", "trading"]
    # after the stop the peak starts anew at the session that trades again: 60 of 85 stops, 70 of 85 doesn't
    df = spark.createDataFrame([(p, i * 7, e) for p, path in ((1, [100.0, 79.0, 85.0, 70.0, 60.0, 10.0]), (2, [100.0]), (3, [0.0, 0.0, 5.0])) for i, e in enumerate(path)], "portfolio bigint, session_idx bigint, equity double")
    got = T.kill_states(df, 0.2, 1).orderBy("portfolio", "session_idx").collect()
    assert [r.state for r in got] == ["trading", "stopped", "trading", "trading", "stopped", "trading", "trading", "trading", "trading", "trading"]


def taken(spark, cards, book=None, **limits):
    schema = "trade_date date, rank bigint, sleeve string, instrument_id bigint, weight double, quantity bigint, price double, risk_share double"
    df = spark.createDataFrame([(D0, k, *c) for k, c in enumerate(cards)], schema)
    if book is not None:
        book = spark.createDataFrame([(D0, *book)], "trade_date date, used map<string,double>, names map<bigint,double>, open_risk double, stopped boolean")
    limits = {"budgets": {"swing": 0.2651, "invest": 0.4}, "name_cap": 0.1251, "risk_cap": 1.0, "capital": 1e6} | limits
    return [(round(r.weight, 4), r.quantity, r.decision) for r in L.accepted_cards(df, book=book, **limits).collect()]


def test_cards_are_cut_to_lots_or_refused(spark):
    card = lambda i, w=0.1, price=10.0, sleeve="swing", risk=None: (sleeve, i, w, round(w * 1e6 / price), price, risk)
    assert taken(spark, [card(i) for i in range(4)]) == [(0.1, 10000, "accepted"), (0.1, 10000, "accepted"), (0.065, 6500, "shrunk"), (0.0, 0, "sleeve full")]
    # whole lots: what is left of a million buys 16 lots of 100 at 40; under half, or under a lot, is refused
    assert taken(spark, [card(1), card(2), card(3, 0.1, 40.0)])[2] == (0.064, 1600, "shrunk")
    assert taken(spark, [card(1), card(2), card(3, 0.1, 700.0)])[2] == taken(spark, [card(1), card(2), card(3, 0.14)], name_cap=0.2)[2] == (0.0, 0, "sleeve full")
    # a name counts over both sleeves
    assert taken(spark, [card(1), card(1, 0.1, 10.0, "invest"), card(1, 0.03, 10.0, "invest")]) == [(0.1, 10000, "accepted"), (0.0, 0, "name full"), (0.025, 2500, "shrunk")]
    # open risk refuses and never cuts; a card without a stop adds none
    risky = [card(1, 0.1, 10.0, "swing", 1e-6), card(2, 0.1, 10.0, "swing", 1e-6), card(3, 0.1, 10.0, "invest"), card(4, 0.01, 10.0, "swing", 1e-6)]
    assert [d for _, _, d in taken(spark, risky, risk_cap=0.015)] == ["accepted", "open risk", "accepted", "accepted"]


def test_cards_meet_the_book(spark):
    card = lambda i, w=0.1, sleeve="swing", risk=None: (sleeve, i, w, round(w * 1e5), 10.0, risk)
    assert [d for _, _, d in taken(spark, [card(1), card(2)], ({"swing": 0.1}, {1: 0.1}, 0.0, False))] == ["name full", "accepted"]
    assert [d for _, _, d in taken(spark, [card(1, risk=1e-6)], (None, None, 0.995, False))] == ["open risk"]
    assert [d for _, _, d in taken(spark, [card(1), card(2, sleeve="invest")], (None, None, 0.0, True))] == ["kill switch"] * 2


def test_sizing_follows_the_reference_price(spark):
    df = spark.createDataFrame([(1, 10.2, 10.0, 9.0), (2, 10.2, 10.0, 9.9), (3, 1200.0, 1100.0, 500.0), (4, 10.2, 10.0, 9.5)], "instrument_id bigint, zone_high double, reference double, stop double")
    got = {r.instrument_id: r for r in T.card_sizing(df, 1e6, 0.01, 0.15, F.when(F.col("instrument_id") == 4, 0.05)).collect()}
    assert (got[1].quantity, round(got[1].weight, 5), round(got[1].risk_if_stop, 6)) == (9800, 0.09996, 9800.0)  # a tenth of the capital in whole lots at the top of the zone
    assert got[2].quantity == 14700 and got[4].quantity == 4900
    assert got[3].refused == "less than a lot" and got[3].quantity is None and got[3].weight is None


def files_of(path):
    return {str(f): f.stat().st_mtime_ns for f in pathlib.Path(path).rglob("*.parquet")}


def test_stored_bars_rewrite_touched_years_only(spark, tmp_path):
    day = lambda y, d: datetime.date(y, 3, d)
    bar = lambda i, d, c: (i, d, c, c, c, c, 1.0, 1)
    schema = "instrument_id bigint, trade_date date, open double, high double, low double, close double, volume double, n_trades bigint"
    path, revisions = str(tmp_path / "bars"), str(tmp_path / "revisions")
    store.write_bars(spark.createDataFrame([bar(i, day(y, d), 10.0) for i in (1, 2) for y in (2019, 2020, 2021) for d in (1, 2)], schema), path)
    plan = store.in_range(store.read_bars(spark, path), [1], "2020-01-01", "2020-12-31")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "year#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    before = files_of(path)
    incoming = spark.createDataFrame([bar(1, day(2020, 1), 11.0), bar(2, day(2020, 3), 12.0), bar(1, day(2021, 1), 10.0)], schema)
    done = {(r.year, r.change): r.n for r in store.upsert_bars(spark, path, incoming, revisions).collect()}
    assert done == {(2020, "updated"): 1, (2020, "inserted"): 1, (2020, "kept"): 3, (2021, "unchanged"): 1, (2021, "kept"): 3}
    after = files_of(path)
    same = {f for f in before if before[f] == after.get(f)}
    assert same == {f for f in before if "year=2020" not in f} and not any("year=2020" in f and f in before for f in after)
    rows = {(r.instrument_id, r.trade_date): r.close for r in store.read_bars(spark, path).collect()}
    assert len(rows) == 13 and rows[1, day(2020, 1)] == 11.0 and rows[2, day(2020, 3)] == 12.0 and rows[1, day(2019, 1)] == 10.0
    assert [(r.instrument_id, r.close) for r in spark.read.parquet(revisions).collect()] == [(1, 10.0)]
    store.upsert_bars(spark, path, incoming, revisions).collect()
    assert files_of(path) == after and spark.read.parquet(revisions).count() == 1


def test_price_basis_in_stored_bars(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = [(1, datetime.date(2019, 1, 2), "raw"), (2, datetime.date(2019, 1, 2), "raw"), (2, datetime.date(2020, 1, 2), "raw")]
    store.write_bars(spark.createDataFrame(rows, "instrument_id bigint, trade_date date, price_basis string"), path)
    before = files_of(path)
    store.set_price_basis(spark, path, spark.createDataFrame([(1,)], "instrument_id bigint"), "adjusted")
    assert {(r.instrument_id, r.year, r.price_basis) for r in store.read_bars(spark, path).collect()} == {(1, 2019, "adjusted"), (2, 2019, "raw"), (2, 2020, "raw")}
    assert {f for f, t in files_of(path).items() if before.get(f) == t} == {f for f in before if "year=2020" in f}


def brute_live(rows, k, window, least):
    """For each day: the rows whose label has ended, of the last dates that have one."""
    out = {}
    for day in sorted({r["trade_date"] for r in rows}):
        done = [r for r in rows if r["trade_date"] <= day and r["end_date"] <= day]
        dates = sorted({r["trade_date"] for r in done})[-window:]
        if not dates:
            continue
        ics, hits, tops, own = [], 0, 0, []
        for d in dates:
            part = [r for r in done if r["trade_date"] == d]
            best = sorted((r for r in rows if r["trade_date"] == d), key=lambda r: (-r["score"], r["instrument_id"]))[:k]
            best = [r for r in best if r["end_date"] <= day]
            hits, tops = hits + sum(r["fwd"] > 0 for r in best), tops + len(best)
            own += part
            if len(part) >= least and (c := spearman([r["score"] for r in part], [r["fwd"] for r in part])) is not None:
                ics.append(c)
        gap = (sum(r["proba"] for r in own) - sum(r["label"] for r in own)) / len(own)
        out[day] = (len(dates), len(own), sum(ics) / len(ics) if ics else None, hits / tops if tops else None, gap)
    return out


def spearman(x, y):
    rank = lambda v: pd.Series(v).rank().to_numpy()
    a, b = rank(x), rank(y)
    return None if a.std() == 0 or b.std() == 0 else float(np.corrcoef(a, b)[0, 1])


def test_live_performance_counts_ended_labels_only(spark):
    rng = random.Random(4)
    rows = []
    for t in range(40):
        for i in range(rng.choice([0, 3, 6, 6])):
            ends = t + rng.choice([1, 2, 5, 9])
            rows.append({"model_id": "A", "instrument_id": i, "trade_date": D0 + datetime.timedelta(days=2 * t), "end_date": D0 + datetime.timedelta(days=2 * ends + rng.choice([0, 1])), "score": rng.choice([0.1, 0.2, 0.3, 0.4]), "proba": rng.random(), "label": rng.randint(0, 1), "fwd": rng.choice([-0.1, 0.0, 0.1, 0.2])})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "model_id string, instrument_id bigint, trade_date date, end_date date, score double, proba double, label int, fwd double")
    got = {r.trade_date: (r.days, r.n, r.rolling_ic, r.hit_rate, r.gap) for r in S.live_performance(df, 2, 7, 3).collect()}
    want = brute_live(rows, 2, 7, 3)
    assert got.keys() == want.keys() and len(want) > 20
    for day in want:
        assert got[day] == pytest.approx(want[day], abs=1e-9), day


def test_logistic_fits_of_folds_recover_their_line(spark):
    rng = np.random.default_rng(12)
    rows = []
    for model, a, b in (("A", 0.5, 0.3), ("B", 2.0, -1.0)):
        for fold in range(3):
            p = rng.uniform(0.05, 0.95, 4000)
            q = 1 / (1 + np.exp(-(a * np.log(p / (1 - p)) + b)))
            rows += [(model, fold, float(x), int(rng.random() < y), float(y)) for x, y in zip(p, q)]
    rows += [("C", fold, 0.5, 1, 1.0) for fold in range(2)]  # all alike: no fit
    df = spark.createDataFrame(rows, "model_id string, fold int, proba double, label int, truth double")
    out = S.platt_by_fold(df, df, "proba", "label")
    off = {(r.model_id, r.fold): r.off for r in out.groupBy("model_id", "fold").agg(F.max(F.abs(F.col("platt") - F.col("truth"))).alias("off")).collect()}
    assert set(off) == {(m, f) for m in "AB" for f in (1, 2)} and max(off.values()) < 0.06


def test_factor_scores_need_half_of_their_ranks(spark):
    factors = {"a": 1, "b": -1, "c": 1}
    df = spark.createDataFrame([(1, 1.0, 0.25, None), (2, None, None, 0.9), (3, 0.5, 0.5, 0.5), (4, None, None, None)], "i int, a double, b double, c double")
    got = {r.i: (r.s, [(x.feature, round(x.part, 4)) for x in r.x]) for r in df.select("i", S.factor_score(factors).alias("s"), S.factor_contributions(factors, 2).alias("x")).collect()}
    assert got[1] == (0.875, [("a", 0.1667), ("-b", 0.0833)]) and got[2] == (None, [("c", 0.1333), ("-b", 0.0)])
    assert got[3][0] == 0.5 and got[4][0] is None


def test_bootstrap_centres_on_the_sample(spark):
    rng = np.random.default_rng(1)
    rows = [(D0 + datetime.timedelta(days=i), float(a), float(a) - 0.001) for i, a in enumerate(rng.normal(0.001, 0.01, 300))]
    df = spark.createDataFrame(rows, "trade_date date, a double, b_ret double")
    b = S.bootstrap(df, 100, 10.0, 3)
    assert b.count() == 100
    r = S.interval(b, "difference").first()
    assert r.low > 0 and r.low < r.mid < r.high
    again = [r.difference for r in S.bootstrap(df, 100, 10.0, 3).orderBy("b").collect()]
    assert again == pytest.approx([r.difference for r in b.orderBy("b").collect()])


def test_rank_ic_of_a_perfect_score_is_one(spark):
    df = spark.createDataFrame([(D0, i, float(i), float(i) ** 3) for i in range(10)], "trade_date date, instrument_id bigint, s double, y double")
    assert S.rank_ic(df, "s", "y").first().ic == pytest.approx(1)
    assert S.rank_ic(df.withColumn("s", F.lit(1.0)), "s", "y").count() == 0


def test_dataset_is_refused_when_its_content_differs(spark, tmp_path):
    df = panel(spark, range(1, 30))
    files.write_dataset(df, str(tmp_path / "d"))
    assert files.read_dataset(spark, str(tmp_path / "d"), files.content_hash(df)).count() == 29
    with pytest.raises(ValueError):
        files.read_dataset(spark, str(tmp_path / "d"), files.content_hash(df.where("bar_idx > 1")))


def test_upsert_is_idempotent(spark):
    old, new = panel(spark, range(1, 10)), panel(spark, [1, 2, 30, 4, 5, 6, 7, 8, 9, 10])
    key = ["instrument_id", "trade_date"]
    first = I.upsert(old, new, key)
    assert {r.change: r["count"] for r in first.groupBy("change").count().collect()} == {"unchanged": 8, "updated": 1, "inserted": 1}
    again = I.upsert(first.select(*key, "row.*"), new, key)
    assert {r.change for r in again.collect()} == {"unchanged"}


def test_rename_keeps_history(spark):
    h = spark.createDataFrame([(1, "OLD", "XA", D0, None)], "instrument_id bigint, symbol string, exchange string, valid_from date, valid_to date")
    c = spark.createDataFrame([(1, "NEW")], "instrument_id bigint, new_value string")
    once = U.close_and_open(h, c, "symbol", "2021-01-01")
    assert [(r.symbol, str(r.valid_to)) for r in once.orderBy("valid_from").collect()] == [("OLD", "2021-01-01"), ("NEW", "None")]
    assert U.close_and_open(once, c, "symbol", "2021-01-01").count() == 2


def test_calibration_improves_a_skewed_probability(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 1, 4000)
    rows = [(float(x), int(rng.uniform() < x * x)) for x in p]
    df = spark.createDataFrame(rows, "proba double, label int")
    out = M.fit_isotonic(df, "proba", "label", 20).transform(df.withColumnRenamed("proba", "p"))
    before, after = out.agg(F.avg((F.col("p") - F.col("label")) ** 2), F.avg((F.col("calibrated") - F.col("label")) ** 2)).first()
    assert after < before - 0.01
    assert math.isfinite(after)


def test_tranches_are_dropped_at_the_next_rebalance(spark):
    t = spark.createDataFrame([(1, 7, 0.6), (1, 8, 0.3), (10, 7, 0.6), (40, 8, 0.9)], "session_idx bigint, instrument_id bigint, weight double")
    schedule = spark.createDataFrame([(1,), (10,), (20,), (40,)], "session_idx bigint")  # nobody is wanted at 20: nothing moves
    last = spark.createDataFrame([(45,)], "session_idx bigint")
    got = {(r.session_idx, r.instrument_id): round(r.weight, 6) for r in T.tranches(t, schedule, last, 3, 5).collect()}
    assert got == {
        (1, 7): 0.2, (1, 8): 0.1, (6, 7): 0.4, (6, 8): 0.2,  # the third step would fall on 11
        (10, 7): round(0.4 + 0.2 / 3, 6), (10, 8): round(0.2 - 0.2 / 3, 6), (15, 7): round(0.4 + 0.4 / 3, 6), (15, 8): round(0.2 / 3, 6),
        (40, 7): round((0.4 + 0.4 / 3) * 2 / 3, 6), (40, 8): round(0.2 / 3 + (0.9 - 0.2 / 3) / 3, 6), (45, 7): round((0.4 + 0.4 / 3) / 3, 6), (45, 8): round(0.2 / 3 + (0.9 - 0.2 / 3) * 2 / 3, 6),
    }


def test_trailing_returns_fill_thin_names_with_the_mean(spark):
    picks = spark.createDataFrame([(4, 1), (4, 2), (4, 3)], "grp bigint, instrument_id bigint")
    seen = [(i, k, 0.1 * i * k) for i in range(1, 5) for k in (1, 2) if (i, k) != (3, 2)] + [(4, 3, 9.0)]
    r = spark.createDataFrame(seen, "session_idx bigint, instrument_id bigint, ret double")
    got = {(x.instrument_id, x.i): round(x.ret, 6) for x in T.trailing_returns(picks, r, 3, 2).collect()}
    assert got == {(1, 2): 0.2, (1, 3): 0.3, (1, 4): 0.4, (2, 2): 0.4, (2, 3): 0.0, (2, 4): 0.8, (3, 2): 0.3, (3, 3): 0.3, (3, 4): 0.6}


def test_sleeves_that_share_a_name(spark):
    t = spark.createDataFrame([("a", D0, 1, 0.2), ("b", D0, 1, 0.3), ("a", D0, 2, 0.5)], "sleeve string, trade_date date, instrument_id bigint, weight double")
    assert [(r.instrument_id, r.sleeves, r.combined) for r in T.sleeve_overlap(t).collect()] == [(1, 2, pytest.approx(0.5))]


def test_invest_levels_and_refusals(spark):
    rows = [(1, 20.0, 18.0, 22.0, -0.1, 0.05, 0.2, 0.5), (2, 20.0, 20.5, 22.0, -0.1, 0.05, 0.2, 0.5), (3, 20.0, 18.0, 22.0, None, 0.05, 0.2, 0.5), (4, 20.0, 18.0, 22.0, -0.1, 0.05, 0.2, 0.0001), (5, None, 18.0, 22.0, -0.1, 0.05, 0.2, 0.5)]
    df = spark.createDataFrame(rows, "instrument_id bigint, close double, floor double, ceiling double, q10 double, q50 double, q90 double, weight double")
    got = {r.instrument_id: r for r in T.invest_levels(df, 1_000_000.0, 0.1).collect()}
    a = got[1]
    assert (a.zone_low, a.zone_high, a.reference, a.bear, a.base, a.bull) == pytest.approx((19.4, 20.2, 19.8, 17.8, 20.8, 23.8))
    assert (a.weight, a.quantity, a.reason) == (0.1, 4900, None)
    assert [got[k].reason for k in (2, 3, 4, 5)] == ["zone outside the band", "no scenarios", "less than a lot", "no price"]


def test_small_buckets_join_their_smaller_neighbour():
    assert S.merged_edges([0.1, 0.2, 0.3], [5, 50, 200, 200], 100) == [0.3]
    assert S.merged_edges([0.1, 0.2], [100, 3, 40], 40) == [0.1]
    assert S.merged_edges([0.1], [1, 1], 100) == []
    assert S.merged_edges([], [7], 100) == []


def test_evidence_uses_only_labels_that_ended(spark):
    rows = [(0, p, y, datetime.date(2020, 1, 5 + i)) for i, (p, y) in enumerate([(0.1, 0), (0.9, 1)])] + [(0, 0.5, 1, datetime.date(2020, 3, 1)), (1, 0.3, 1, datetime.date(2020, 3, 2))]
    df = spark.createDataFrame(rows, "fold int, proba double, label int, end_date date")
    got = {(r.fold, str(r.month)): (r.n, r.auc) for r in S.evidence_by_month(df, 1).collect()}
    assert got == {(0, "2020-02-01"): (2, 1.0), (0, "2020-04-01"): (3, 1.0)}  # fold 1 has one class


def test_path_metrics_by_hand(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 1, -0.5), (0, 2, 0.2)], "b bigint, t bigint, a double")
    r = S.path_metrics(df, ("a",)).first()
    assert r.drawdown_a == pytest.approx(-0.5) and r.growth_a == pytest.approx(84 * math.log(1.1 * 0.5 * 1.2))


def test_reasons_to_fit_again(spark):
    m = spark.createDataFrame([("A", datetime.date(2021, 6, 1), D0, "v2"), ("B", D0, D0, "v1")], "model_id string, last date, trained date, features string")
    b = spark.createDataFrame([("B", "mean_ic")], "model_id string, metric string")
    assert {(r.model_id, r.kind) for r in L.retrain_reasons(m, b, "v2", 365).collect()} == {("A", "schedule"), ("B", "new_feature_set"), ("B", "mean_ic")}


def market_rows(spark, bars, statuses=()):
    """bars: (session, open, high, low, close) of instrument 1 on consecutive days."""
    g = spark.createDataFrame([(1, D0 + datetime.timedelta(days=b[0]), *[float(x) if k else x for k, x in enumerate(b)]) for b in bars], "instrument_id bigint, trade_date date, session_idx bigint, open double, high double, low double, close double")
    s = spark.createDataFrame(list(statuses), "instrument_id bigint, status string, valid_from date, valid_to date")
    return T.market_conditions(g, s, 0.1)


def test_locked_and_suspended_sessions_fill_nothing(spark):
    halted = [(1, "suspended", D0 + datetime.timedelta(days=5), D0 + datetime.timedelta(days=7))]
    m = market_rows(spark, [(1, 20, 20, 20, 20), (2, 22, 22, 22, 22), (3, 22, 23, 21, 22), (4, 25, 26, 24, 25), (5, 25, 25, 25, 25), (6, 25, 25, 25, 25)], halted)
    assert {r.session_idx for r in m.where("up_locked").collect()} == {2} and {r.session_idx for r in m.where("suspended").collect()} == {5, 6}
    orders = [(1, 1, 2, 3, "open", 0.0, 0.0, 24.0), (2, 1, 2, 2, "open", 0.0, 0.0, 24.0), (3, 1, 4, 4, "open", 0.0, 0.0, 24.0), (4, 1, 5, 6, "open", 0.0, 0.0, 99.0), (5, 1, 8, 9, "open", 0.0, 0.0, 99.0), (6, 1, 3, 3, "limit", 0.0, 20.0, 99.0)]
    o = spark.createDataFrame(orders, "order_id bigint, instrument_id bigint, first bigint, last bigint, kind string, low double, high double, cap double")
    got = {r.order_id: (r.session_idx, r.price, r.reason) for r in T.entry_fills(o, m).collect()}
    assert got == {1: (3, 22.0, None), 2: (None, None, "locked at the ceiling"), 3: (None, None, "cancelled: opened above cap"), 4: (None, None, "suspended"), 5: (None, None, "no bar"), 6: (None, None, "expired")}


def test_exits_skip_floors_and_time_exits_wait(spark):
    m = market_rows(spark, [(1, 20, 20.5, 19.5, 20), (2, 20, 20.5, 19.5, 20), (3, 20, 20.5, 19.5, 20), (4, 18, 18, 18, 18), (5, 17, 17.5, 16.5, 17), (6, 17, 17.5, 16.5, 17)])
    assert {r.session_idx for r in m.where("down_locked").collect()} == {4}
    trades = [(1, 1, 1, 20.0, 18.5, 30.0, 10), (2, 1, 1, 20.0, 1.0, 30.0, 3), (3, 1, 1, 20.0, 1.0, 30.0, 10)]
    t = spark.createDataFrame(trades, "trade_id bigint, instrument_id bigint, entry bigint, price double, stop double, target double, max_hold bigint")
    got = {r.trade_id: (r.exit, r.exit_price, r.reason) for r in T.bracket_exits(t, m).collect()}
    assert got == {1: (5, 17.0, "stop gap"), 2: (5, 17.0, "time"), 3: (None, None, "open")}  # session 4 is locked at the floor


def test_next_dates(spark):
    cal = spark.createDataFrame([(datetime.date(2024, 5, 30), 1), (datetime.date(2024, 5, 31), 2)], "trade_date date, session_idx bigint")
    rows = T.session_after(cal, 3, "third").select("third", *[T.next_period("trade_date", p).alias(p) for p in ("week", "month", "quarter")]).orderBy("third").collect()
    assert [str(r.third) for r in rows] == ["2024-06-04", "2024-06-05"]  # one more session, then weekdays
    assert (str(rows[0].week), str(rows[0].month), str(rows[0].quarter)) == ("2024-06-03", "2024-06-03", "2024-07-01")


def test_versions_in_use_are_kept(spark):
    v = spark.createDataFrame([("r", k) for k in range(1, 5)], "recipe string, version bigint")
    assert {r.version: r.kept for r in files.retained(v, v.where("version = 1"), 2).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_snapshot_ends_and_starts_membership(spark):
    day = lambda k: D0 + datetime.timedelta(days=k)
    h = spark.createDataFrame([(1, D0, None, 1.0), (2, D0, None, 1.0), (3, D0, None, 1.0), (4, D0, day(5), 1.0), (6, D0, None, 1.0)], "instrument_id bigint, valid_from date, valid_to date, weight double")
    s = spark.createDataFrame([(1, 1.0, "active"), (2, 0.5, None), (4, 1.0, "suspended"), (5, 2.0, "active"), (6, 1.0, "delisted")], "instrument_id bigint, weight double, status string")
    out = U.apply_snapshot(h, s, str(day(9)))
    key = lambda r: (r.instrument_id, (r.valid_from - D0).days, r.valid_to and (r.valid_to - D0).days, r.weight)
    assert {key(r) for r in out.collect()} == {(1, 0, None, 1.0), (2, 0, 9, 1.0), (2, 9, None, 0.5), (3, 0, 9, 1.0), (4, 0, 5, 1.0), (4, 9, None, 1.0), (5, 9, None, 2.0), (6, 0, 9, 1.0)}
    assert {key(r) for r in U.apply_snapshot(out, s, str(day(9))).collect()} == {key(r) for r in out.collect()}  # again: nothing changes
    with pytest.raises(ValueError):
        U.apply_snapshot(out, s, str(day(8)))
    early = s.withColumn("valid_from", F.lit(D0))
    assert {r.valid_from for r in U.apply_snapshot(h.limit(0), early, str(day(9))).collect()} == {D0}


def test_isotonic_by_fold_rises_and_sees_earlier_folds_only(spark):
    rows = [("m", k, i / 100, int((i * 7 + k) % 100 < i)) for k in range(3) for i in range(100)]
    df = spark.createDataFrame(rows, "model_id string, fold bigint, proba double, label int")
    got = S.isotonic_by_fold(df, "proba", "label").orderBy("fold", "proba").collect()
    assert {r.fold for r in got} == {1, 2}
    for k in (1, 2):
        fit = [r.isotonic for r in got if r.fold == k]
        assert fit == sorted(fit) and all(0 <= x <= 1 for x in fit)
    first = df.where("fold = 0").agg(F.avg("label")).first()[0]
    assert {round(r.constant, 9) for r in got if r.fold == 1} == {round(first, 9)}


def test_ablation_shows_what_a_column_adds(spark):
    df = spark.createDataFrame([(D0, float(i), float((i * 7) % 10), float(i)) for i in range(10)], "trade_date date, good double, noise double, y double")
    r = S.ablation_ic(df, ["good", "noise"], ["noise"], "y").first()
    assert r.without_group == pytest.approx(1) and r.with_group < 1 and r.difference == pytest.approx(r.with_group - 1)


def test_card_problems_by_hand(spark):
    rows = [(1, 20.0, 0.1, 19.5, 20.2, 18.0, 25.0), (2, 20.0, 0.01, 19.5, 20.2, 19.6, 20.0), (3, 20.0, 0.1, 20.5, 20.2, None, 25.02), (4, 20.0, 0.1, 19.5, 20.2, 18.013, None)]
    df = spark.createDataFrame(rows, "instrument_id bigint, close double, band double, zone_low double, zone_high double, stop double, target1 double")
    got = {r.instrument_id: set(r.p) for r in df.select("instrument_id", T.card_problems(df).alias("p")).collect()}
    assert got == {
        1: set(), 2: {"stop not below zone", "target not above zone", "zone outside the band"}, 3: {"no stop", "zone upside down", "target off tick"}, 4: {"no target", "stop off tick"},
    }


def test_card_levels_by_style(spark):
    columns = "id int, close double, atr double, floor double, ceiling double, high_20 double, high_60 double"
    rows = [(1, 20.0, 2.0, 17.0, 23.0, 25.0, 30.0), (2, 20.0, 2.0, 17.0, 23.0, 25.0, 20.5), (3, 20.0, 2.0, 17.0, 23.0, 20.1, 20.1), (4, 20.0, None, 17.0, 23.0, 25.0, 30.0), (5, 20.0, 2.0, 17.0, 20.25, 20.1, 20.1), (6, 20.0, 2.0, 19.9, 23.0, 25.0, 30.0), (7, 20.0, 2.0, 17.0, 23.0, 25.0, 19.35)]
    df = spark.createDataFrame(rows, columns)
    fields = ("style", "trigger", "zone_low", "zone_high", "reference", "stop", "target1", "target2", "capped", "reason")
    plain = lambda r: tuple(round(r[f], 4) if isinstance(r[f], float) else r[f] for f in fields)
    got = {r.id: plain(r) for r in T.card_levels(df).collect()}
    assert got[1] == ("pullback", None, 18.8, 19.7, 19.25, 17.25, 21.25, 23.25, False, None)
    assert got[2] == ("pullback", None, 18.8, 19.7, 19.25, 17.25, 20.45, 20.45, True, "reward below risk")
    assert got[3] == ("breakout", 20.3, 20.3, 20.9, 20.6, 18.6, 22.6, 24.6, False, None)
    assert got[4] == ("pullback", None, None, None, None, None, None, None, None, "no volatility")
    assert [got[k][-1] for k in (5, 6, 7)] == ["trigger above the ceiling", "zone outside the band", "resistance too near"]
    at_open = T.card_levels(df.where("id = 1"), "open").first()
    assert (round(at_open.zone_low, 4), round(at_open.zone_high, 4), round(at_open.reference, 4)) == (19.8, 20.2, 20.0)
    assert T.card_levels(df.drop("high_20").selectExpr("*", "cast(null as double) high_20"), "breakout").where("reason = 'no high to break'").count() == 6


@pytest.fixture(scope="module")
def planted(spark):
    """60 dates of 12 names in 3 folds: fwd follows x with a little noise, and y not at all."""
    rng = random.Random(5)
    rows = []
    for d in range(60):
        for i in range(12):
            x, y = rng.gauss(0, 1), rng.gauss(0, 1)
            rows.append((i, D0 + datetime.timedelta(days=d), d // 20, x, y, 0.5 * x + rng.gauss(0, 0.05), float(rng.random() < 1 / (1 + math.exp(-2 * x)))))
    return spark.createDataFrame(rows, "instrument_id int, trade_date date, fold int, x double, y double, fwd double, label double").cache()


def test_linear_contributions_add_up(planted):
    model = M.fit_linear(planted, ["x", "y"], "fwd", 0.0)
    intercept = model.stages[-1].intercept
    rows = M.linear_contributions(model, planted, ["x", "y"]).collect()
    assert all(abs(sum(r.contributions) + intercept - r.score_ml) < 1e-9 for r in rows)
    assert all(abs(r.score_ml - 0.5 * r.x) < 0.05 for r in rows)


def test_tuning_marks_the_best_of_each_family(planted):
    grid = [(0.001, 0.0), (1000.0, 0.9), (0.01, 0.5)]
    got = {r.point: r for r in M.tune(planted.where("fold < 2"), planted.where("fold = 2"), ["x", "y"], "fwd", "fwd", grid).collect()}
    assert (got[0].family, got[0].best, got[0].days) == ("ridge", True, 20) and got[0].mean_ic > 0.95
    assert got[1].mean_ic is None and not got[1].best  # all coefficients are 0
    assert got[2].best and got[2].mean_ic > 0.95


def test_walk_forward_sees_earlier_folds_only(planted):
    turned = planted.withColumn("fwd", F.when(F.col("fold") == 2, -F.col("fwd")).otherwise(F.col("fwd")))
    out = M.walk_forward(turned, [1, 2], "fold", lambda t: M.fit_linear(t, ["x", "y"], "fwd", 0.0), lambda m, t: m.transform(t))
    corr = {r.fold: r.c for r in out.groupBy("fold").agg(F.corr("score_ml", "fwd").alias("c")).collect()}
    assert corr[1] > 0.95 and corr[2] < -0.95


def test_trees_rank_and_stored_models_score_alike(spark, planted):
    ranked = M.forward_rank(planted, "fwd", "r").withColumn("held", F.col("fold") == 1)
    assert ranked.agg(F.min("r"), F.max("r")).first()[:] == (0.0, 1.0)
    model = M.fit_rank_trees(ranked.where("fold < 2"), ["x", "y"], "r", 20, validation="held")
    assert dict(M.importances(model, ["x", "y"]))["x"] > 0.7
    path = M.save_model(model, files.scratch(spark, "model"))
    got = M.score_range(spark, path, planted, "2020-02-15", "2020-02-20").collect()
    assert len(got) == 72 and sorted(r.rank for r in got if r.trade_date == datetime.date(2020, 2, 15)) == list(range(1, 13))
    want = {(r.instrument_id, r.trade_date): r.score_ml for r in model.transform(planted).collect()}
    assert all(r.score_ml == want[r.instrument_id, r.trade_date] for r in got)
    assert np.corrcoef([r.score_ml for r in got], [r.fwd for r in got])[0, 1] > 0.8


def test_meta_filter_keeps_a_share_and_gains(planted):
    later = M.meta_filter(planted, ["x", "y"], "fwd", "2020-02-10", keep=0.6)
    assert later.count() == 240
    r = M.filter_gain(later, "fwd", 100, 3).first()
    rows = later.collect()
    kept = [x.fwd for x in rows if x.kept]
    assert r.trades == 240 and r.kept == len(kept) and abs(r.mean_kept - np.mean(kept)) < 1e-12
    assert abs(r.gain - (np.mean(kept) - np.mean([x.fwd for x in rows]))) < 1e-12 and 0 < r.lower_bound < r.gain
    noise = M.filter_gain(later.withColumn("kept", F.col("instrument_id") % 2 == 0), "fwd", 100, 3).first()
    assert noise.lower_bound < 0


def test_platt_scaling_of_overconfident_odds(planted):
    stated = planted.withColumn("p", 1 / (1 + F.exp(-6 * F.col("x"))))
    model = M.fit_platt(stated, "p", "label")
    assert abs(model.stages[-1].coefficients[0] - 1 / 3) < 0.08  # the odds were stated three times too strong
    trees = M.fit_event_trees(planted.where("fold < 2"), ["x", "y"], "label", 5)
    r = M.event_probability(trees, planted.where("fold = 2")).agg(F.corr("proba_ml", "x").alias("c"), F.min("proba_ml").alias("a"), F.max("proba_ml").alias("b")).first()
    assert r.c > 0.8 and 0 <= r.a < r.b <= 1


def test_a_build_refuses_what_looks_ahead(spark):
    rows = [(i, D0 + datetime.timedelta(days=d), d + 1, True, 10.0 + (d * 7 + i) % 5) for i in (1, 2) for d in range(80)] + [(3, D0, 1, True, 10.0)]
    df = spark.createDataFrame(rows, "instrument_id int, trade_date date, session_idx int, is_member boolean, close double")

    def recipe(shift):
        def columns(panel):
            return X.forward_return(panel, 3).withColumn("f", F.lag("close", shift).over(X.sessions()))

        return D.Recipe("small", "2019-01-01", "2030-01-01", columns, ("f",), ("fwd_ret_3",), "fwd_end_3")

    path, report = D.build(spark, df, recipe(2), "2020-02-10")
    assert (report["n_rows"], report["refused"], report["last_date"]) == (2 * (80 - 19), 1, D0 + datetime.timedelta(days=79))
    assert files.read_dataset(spark, path).where("fwd_ret_3 is null").count() == 6
    assert D.build(spark, df, recipe(2))[1]["content"] == report["content"]
    with pytest.raises(ValueError, match="looks ahead in f"):
        D.build(spark, df, recipe(-1), "2020-02-10")
    with pytest.raises(ValueError, match="no bars"):
        D.build(spark, df.where("close is null"), recipe(2))


def test_snapshots_of_two_trades(spark):
    closes = spark.createDataFrame([(1, 7, s, D0 + datetime.timedelta(days=s), c) for s, c in ((1, 10.0), (2, 12.0), (3, None), (4, 9.0))], "portfolio int, instrument_id int, session_idx int, trade_date date, close double")
    trades = spark.createDataFrame([(1, 7, 1, 10.0, 2, 12.0), (1, 7, 2, 11.0, None, None)], "portfolio int, instrument_id int, entry int, price double, exit int, exit_price double")
    got = [(r.cash, r.equity, r.peak, round(r.exposure, 4), r.positions) for r in L.portfolio_snapshots(trades, closes, 2000.0).orderBy("trade_date").collect()]
    assert got == [(1000.0, 2000.0, 2000.0, 0.5, None), (1100.0, 2300.0, 2300.0, 0.5217, None), (1100.0, 2300.0, 2300.0, 0.5217, None), (1100.0, 2000.0, 2300.0, 0.45, "7:100")]


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=501), "b": np.repeat([1.0, 2.0], [400, 3]), "c": np.array([7.0]), "d": rng.integers(0, 4, 60).astype(float)}
    rows = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("e", None)], "g string, x double")
    levels = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in S.exact_quantiles(rows, "x", levels, "g").collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g]["n"] == len(xs)
        assert got[g]["quantiles"] == pytest.approx(list(np.quantile(xs, levels)))
    assert S.edges_of(rows.where("g = 'e'"), "x", 4).first()["edges"] is None


def test_window_drift_with_ties_and_a_constant(spark):
    rng = np.random.default_rng(6)
    days = pd.date_range("2020-01-01", periods=40).date
    make = lambda shift: [(d, float(rng.integers(0, 6)) + shift, 1.0 + (shift > 0), None if k else float(rng.normal() + shift)) for d in days for k in (0, 0, 1)]
    schema = "trade_date date, tied double, constant double, plain double"
    old, new = make(0), make(1)
    names = ["tied", "constant", "plain"]
    S.feature_profile(spark.createDataFrame(old, schema), names, 101).write.parquet(path := scratch(spark, "profile"))
    got = {(r["feature"], r["slice"]): r for r in S.window_drift(spark.createDataFrame(new, schema), spark.read.parquet(path), names, 20, 10).collect()}
    assert len(got) == 9
    for i, f in enumerate(names, 1):
        ref = np.array([r[i] for r in old if r[i] is not None])
        q = np.quantile(ref, np.linspace(0, 1, 101))
        knots, at = np.unique(q, return_index=True)
        for k in range(3):
            v = np.sort([r[i] for r in new if r[0] in set(days[k * 10 : k * 10 + 20]) and r[i] is not None])
            stated = np.interp(v, knots, at / 100, left=0.0, right=1.0)
            ranks = np.arange(1, len(v) + 1) / len(v)
            assert got[f, k]["ks"] == pytest.approx(max(np.abs(ranks - stated).max(), np.abs(ranks - 1 / len(v) - stated).max()))
            assert got[f, k]["n"] == len(v)
            inner = np.unique(q[::10])[1:-1]
            if f == "constant":
                assert got[f, k]["psi"] == 1.0
                continue
            share = lambda xs: np.maximum([np.mean(b) for b in xs], 1e-4)
            e = share([np.searchsorted(inner, q, "left") == b for b in range(len(inner) + 1)])
            a = share([np.searchsorted(inner, v, "right") == b for b in range(len(inner) + 1)])
            assert got[f, k]["psi"] == pytest.approx(float(np.sum((a - e) * np.log(a / e))))


def test_drift_limits_are_the_larger_of_floor_and_baseline(spark):
    windows = spark.createDataFrame([("x", k, 0.1 * k, 0.01) for k in range(5)] + [("y", k, 0.9, 0.9) for k in range(4)], "feature string, slice int, psi double, ks double")
    base = {r["feature"]: r for r in S.drift_baseline(windows).collect()}
    assert base["x"]["psi_ref"] == pytest.approx(0.38) and base["y"]["psi_ref"] is None and base["y"]["slices"] == 4
    recent = spark.createDataFrame([("x", 0, 0.3, 0.1), ("x", 1, 0.4, 0.1), ("x", 2, 0.0, 0.21), ("y", 0, 0.26, 0.0), ("z", 0, 0.2, 0.3), ("z", 1, 0.2, 0.1)], "feature string, slice int, psi double, ks double")
    assert sorted((r["feature"], r["slice"]) for r in S.drift_alerts(recent, S.drift_baseline(windows)).collect()) == [("x", 1), ("x", 2), ("y", 0), ("z", 0)]


def test_alert_state_goes_after_the_silence(spark):
    at = lambda h: datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=h)
    path = scratch(spark, "alerts")
    for batch in ([(1, "a", at(0)), (2, "a", at(30)), (3, "b", at(31))], [(4, "a", at(37)), (5, "c", at(100))], [(6, "b", at(101)), (7, "c", at(102))]):
        spark.createDataFrame(batch, "event_id bigint, k string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("event_id bigint, k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    query = Z.suppressed(stream, 36, ["k"]).writeStream.format("memory").queryName("alerts_out").option("checkpointLocation", scratch(spark, "alerts_state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r[0] for r in spark.table("alerts_out").collect()) == [1, 3, 4, 5, 6]
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) == 3 and kept[-1] == 2  # a's row is gone, b's was made anew


def test_stream_upsert_writes_touched_parts_only(spark):
    path, table = scratch(spark, "fetches"), scratch(spark, "table")
    for batch in ([(1, 1.0), (11, 1.0), (21, 1.0)], [(11, 2.0), (12, 1.0), (21, 1.0)], [(21, 1.0)], [(1, 3.0)]):
        spark.createDataFrame(batch, "id bigint, value double").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("id bigint, value double").option("maxFilesPerTrigger", 1).parquet(path)
    changes = Z.upserted(stream, "ups", ["id"], ("value",), F.floor(F.col("id") / 10), table)
    assert sorted((r["batch"], r["id"], r["change"]) for r in changes.collect()) == [
        (0, 1, "inserted"), (0, 11, "inserted"), (0, 21, "inserted"), (1, 11, "updated"), (1, 12, "inserted"), (1, 21, "unchanged"), (2, 21, "unchanged"), (3, 1, "updated")]
    assert sorted(tuple(r) for r in Z.current(spark, table).select("id", "value").collect()) == [(1, 3.0), (11, 2.0), (12, 1.0), (21, 1.0)]
    written = spark.read.schema("part bigint, batch bigint").parquet(f"{table}/parts").collect()
    assert sorted((r["batch"], r["part"]) for r in written) == [(0, 0), (0, 1), (0, 2), (1, 1), (3, 0)]


def test_plugin_sets_are_refused_before_any_plan():
    known = G.built_in()
    log_ret = G.Plugin("ret", 2, "ts", lambda df: df.withColumn("log_ret", F.lit(0.0)), lambda: ["log_ret"])
    pin = known.pinned("ret", 1, windows=[1])
    known.add(log_ret)
    known.add(log_ret)
    assert pin.columns == ["ret_1"] and known.get("ret", 2) is log_ret
    refused = [
        ("there already", lambda: known.add(G.Plugin("ret", 2, "ts", lambda df: df, lambda: ["other"]))),
        ("only versions", lambda: known.pinned("ret", 9)),
        ("no plugin", lambda: known.pinned("nope", 1)),
        ("no kind", lambda: known.add(G.Plugin("x", 1, "row", lambda df: df, lambda: ["x"]))),
        ("numbers from 1", lambda: known.add(G.Plugin("x", 0, "ts", lambda df: df, lambda: ["x"]))),
        ("takes no", lambda: known.pinned("ret", 1, window=[3])),
        ("different whole numbers", lambda: known.pinned("ret", 1, windows=[0])),
        ("without plugins", lambda: G.checked([])),
        ("is made by", lambda: G.checked([pin, known.pinned("ret", 1, windows=[5, 1])])),
        ("which nothing in the set makes", lambda: G.checked([pin, known.pinned("cs_rank", 1, columns=["ret_3"])])),
        ("look ahead", lambda: G.checked([known.pinned("fwd_ret", 1), known.pinned("cs_rank", 1, columns=["fwd_ret_5"])])),
        ("tells an instrument", lambda: G.checked([G.Pinned(G.Plugin("s", 1, "ts", lambda df: df, lambda: ["Symbol"]), {})])),
        ("none are given", lambda: G.made(None, [known.pinned("published", 1, fields=["eps"])])),
    ]
    for words, f in refused:
        with pytest.raises(G.PluginError, match=words):
            f()
    assert G.warmup([pin, known.pinned("rsi", 1)]) == 14


def test_a_plugin_set_of_all_kinds(spark):
    known = G.built_in()
    df = panel(spark, [10, 11, 12, 15], 1).unionByName(panel(spark, [10, 12, 13, 13], 2)).withColumn("session_idx", F.col("bar_idx"))
    published = spark.createDataFrame([(1, D0 + datetime.timedelta(days=1), 2.5)], "instrument_id bigint, published date, eps double")
    pins = [known.pinned("fwd_ret", 1, h=1), known.pinned("cs_rank", 1, columns=["ret_1"]), known.pinned("published", 1, fields=["eps"]), known.pinned("ret", 1, windows=[1])]
    got = {(r["instrument_id"], r["bar_idx"]): r for r in G.made(df, pins, published, F.col("bar_idx") > 1).collect()}
    assert len(got) == 8 and got[1, 2]["ret_1"] == pytest.approx(0.1)
    assert [got[i, k]["ret_1_rank"] for k in (1, 2, 4) for i in (1, 2)] == [None, None, 0.5, 1.0, 1.0, 0.5]
    assert [got[1, k]["eps"] for k in (1, 2, 4)] == [None, 2.5, 2.5] and got[2, 4]["eps"] is None
    assert got[1, 3]["fwd_ret_1"] == pytest.approx(0.25) and got[1, 4]["fwd_ret_1"] is None


def test_slice_drawdown_puts_sessions_one_after_another(spark):
    days = [D0 + datetime.timedelta(days=i) for i in range(6)]
    rets = [("x", 0.10), ("y", -0.50), ("x", -0.20), ("y", 0.30), ("x", 0.05), ("x", -0.10)]
    rows = spark.createDataFrame([(1, d, s, r) for d, (s, r) in zip(days, rets)], "portfolio int, trade_date date, slice string, ret double")
    got = {r["slice"]: r for r in S.slice_metrics(rows, "portfolio", "slice").collect()}
    assert got["x"]["max_drawdown"] == pytest.approx(0.8 * 1.05 * 0.9 - 1)
    assert got["y"]["max_drawdown"] == pytest.approx(0.0)  # the curve starts after its first session
    assert got["x"]["annual_return"] == pytest.approx((1.1 * 0.8 * 1.05 * 0.9) ** (252 / 4) - 1)



def test_alerts_by_groups_of_keys_are_those_of_a_loop(spark):
    rng = np.random.default_rng(5)
    n, gap = 4000, 36 * 3_600_000_000
    hours = rng.integers(0, 700, n)
    keys = [(None if k == 7 else int(k), None if k % 11 == 3 else "ab"[k % 2]) for k in rng.integers(0, 60, n)]
    rows = [(i, *k, datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=int(h))) for i, (k, h) in enumerate(zip(keys, hours))]
    want, last, chunks = set(), {}, 4
    for i, u, e, t in sorted(rows, key=lambda r: (r[3], r[0])):
        if (u, e) not in last or t - last[u, e] > datetime.timedelta(microseconds=gap):
            want.add(i)
            last[u, e] = t
    rows.sort(key=lambda r: r[3])
    path = scratch(spark, "alerts")
    schema = "event_id bigint, user bigint, kind string, ts timestamp"
    for c in range(chunks):  # fetches in order of time
        spark.createDataFrame(rows[c * n // chunks : (c + 1) * n // chunks], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    calls = Z.suppressed(stream, 36, ["user", "kind"]).writeStream.format("memory").queryName("grouped_out").option("checkpointLocation", scratch(spark, "grouped_state")).trigger(availableNow=True).start()
    calls.awaitTermination()
    assert sorted(r[0] for r in spark.table("grouped_out").collect()) == sorted(want)


def test_alert_state_is_one_for_many_keys(spark, monkeypatch):
    monkeypatch.setattr(Z, "GROUPS", 8)
    path = scratch(spark, "alerts")
    at = datetime.datetime(2020, 1, 1)
    spark.createDataFrame([(i, i, at) for i in range(500)], "event_id bigint, k bigint, ts timestamp").coalesce(1).write.parquet(path)
    query = Z.suppressed(spark.readStream.schema("event_id bigint, k bigint, ts timestamp").parquet(path), 36, ["k"]).writeStream.format("memory").queryName("few_out").option("checkpointLocation", scratch(spark, "few_state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("few_out").count() == 500
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) == 8  # a row for each of 500 keys before
