"""Operators that cut long series, many values or many intervals: each against a plain loop, with small pieces."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fathomlab.errors import ValidationError
from fathomlab.model import Instrument
from fathomlab.operators import intervals, ordered, quantiles, research, scan, simulate
from fathomlab.operators.ordered import next_at
from fathomlab.plans.builtin import builtin_plugins
from fathomlab.plans.plugins import Plugin
from fathomlab.sources.bar_files import import_bars
from fathomlab.sources.matrix import feature_matrix, keys_of, matrix_from_rows, null_counts

T0 = datetime(2024, 3, 1)
BAR = "instrument string, ts timestamp_ntz, open double, high double, low double, close double, tick_volume double, volume double, spread double"


def walk(rng, n, instrument="a", minutes=1):
    rows, price = [], 100.0
    for k in range(n):
        close = price + rng.uniform(-1, 1)
        rows.append((instrument, T0 + timedelta(minutes=minutes * k), price, max(price, close) + rng.random(), min(price, close) - rng.random(), close, float(rng.randrange(1, 9)), 0.0, float(k % 7)))
        price = close
    return rows


def test_recurrences_over_several_levels_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(scan, "SPAN", 8)
    monkeypatch.setattr(scan, "WIDTH", 4)
    rng = random.Random(1)
    rows = walk(rng, 700) + walk(rng, 37, "b") + walk(rng, 3, "c")
    specs = [("e20", "close", 20, 2 / 21), ("w5", "high", 5, 1 / 5), ("one", "close", 1, 1.0)]
    got = {(r["instrument"], r["ts"]): (r["e20"], r["w5"], r["one"]) for r in scan.recurrences(spark.createDataFrame(rows, BAR), specs, ["instrument"]).collect()}
    for name in "abc":
        series = [r for r in rows if r[0] == name]
        for j, (_, value, n, alpha) in enumerate(specs):
            state, at = None, 5 if value == "close" else 3
            for k, r in enumerate(series):
                if k == n - 1:
                    state = sum(x[at] for x in series[:n]) / n
                elif k >= n:
                    state += alpha * (r[at] - state)
                want = got[(name, r[1])][j]
                assert (want is None) == (state is None) and (state is None or abs(want - state) < 1e-9)


def test_first_touch_equals_a_scan(spark, monkeypatch):
    monkeypatch.setattr(simulate, "BITS", 2)
    rng = random.Random(2)
    rows = walk(rng, 300) + walk(rng, 50, "b")
    bars = simulate.numbered(spark.createDataFrame(rows, BAR))
    asks = []
    for k in range(80):
        name, n = rng.choice((("a", 300), ("b", 50)))
        at = rng.randrange(1, n + 1)
        own = [r for r in rows if r[0] == name]
        price, wide = own[at - 1][2], rng.choice((0.5, 3, 8, 30))
        asks.append((f"t{k}", name, at, price - wide, price + wide * rng.random() * 2))
    p = spark.createDataFrame(asks, "trade_id string, instrument string, entry_at long, under double, over double")
    got = {r["trade_id"]: r["hit_at"] for r in simulate.first_touch(p, bars).collect()}
    for trade, name, at, under, over in asks:
        own = [r for r in rows if r[0] == name]
        assert got.get(trade) == next((k + 1 for k in range(at - 1, len(own)) if own[k][4] <= under or own[k][3] >= over), None)


def test_next_at_looks_over_slices(spark):
    rng = random.Random(3)
    times = sorted(rng.sample(range(5000), 60))
    asked = [(k, rng.randrange(5200)) for k in range(200)]
    at = lambda m: T0 + timedelta(minutes=m)
    series = spark.createDataFrame([("a", at(m)) for m in times], "key string, ts timestamp_ntz")
    wanted = spark.createDataFrame([("a", k, at(m)) for k, m in asked], "key string, k long, due timestamp_ntz")
    got = {r["k"]: r["found"] for r in next_at(wanted, series, "key", "due", "ts", "found").collect()}
    assert got == {k: next((at(t) for t in times if t >= m), None) for k, m in asked}


@pytest.mark.parametrize("few", [4, 4096])
def test_quantiles_equal_sorted_lists(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BINS", 8)
    rng = random.Random(4)
    groups = {"ties": [rng.choice((1, 1, 1, 5)) for _ in range(90)], "wide": [rng.choice((-1, 1)) * 10 ** rng.randrange(0, 12) for _ in range(200)], "one": [7], "two": [1, 2], None: [3, 9, 4], "none": [None]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r["g"]: list(r["q"]) for r in quantiles.group_quantiles(spark.createDataFrame(rows, "g string, v long"), ["g"], "v", probs).collect()}
    assert set(got) == set(groups) - {"none"}
    for g, q in got.items():
        own = sorted(groups[g])
        for p, x in zip(probs, q):
            h = (len(own) - 1) * p
            low = own[int(h)]
            high = own[min(int(h) + 1, len(own) - 1)]
            assert abs(x - (low + (h - int(h)) * (high - low))) < 1e-6 * max(1, abs(x))


def test_intervals_equal_nested_loops(spark):
    rng = random.Random(5)
    day = lambda k: T0 + timedelta(days=k)
    cut = lambda n: [(k, day(a), day(a + rng.choice((0, 1, 20, 400)))) for k, a in enumerate(rng.randrange(900) for _ in range(n))]
    left, right, points = cut(40), cut(40), [(k, day(rng.randrange(1300))) for k in range(150)]
    at = lambda rows, *names: spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n in 'ijk' else 'timestamp_ntz'}" for n in names))
    pairs = {(r["i"], r["j"]) for r in intervals.overlaps(at(left, "i", "a", "b"), at(right, "j", "c", "d"), "a", "b", "c", "d").collect()}
    assert pairs == {(i, j) for i, a, b in left for j, c, d in right if a < d and c < b and a < b and c < d}
    held = intervals.inside(at(points, "k", "ts"), "ts", at(left, "i", "a", "b"), "a", "b").collect()
    assert sorted((r["k"], r["i"]) for r in held) == sorted((k, i) for k, t in points for i, a, b in left if a <= t < b)
    plan = intervals.inside(at(points, "k", "ts"), "ts", at(left, "i", "a", "b"), "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_walked_numbers_runs_over_slices(spark):
    rng = random.Random(6)
    rows = [("g", T0 + timedelta(hours=7 * k), k, rng.choice((-5, -5, 0, 4, 4, 4))) for k in range(400)]
    got = ordered.walked(spark.createDataFrame(rows, "g string, entry_ts timestamp_ntz, id long, pnl_cents long"), ["g"]).orderBy("i").collect()
    total, peak, run, before = 0, 0, -1, None
    for k, (r, row) in enumerate(zip(got, rows)):
        total, sign = total + row[3], (row[3] > 0) - (row[3] < 0)
        peak, run, before = max(peak, total), run + (sign != before), sign
        assert (r["i"], r["equity"], r["peak"]) == (k, total, peak)
        assert r["run"] - got[0]["run"] == run


def test_first_line_of_a_key_is_imported_once(spark, tmp_path):
    from fathomlab.operators.catalog import Catalog

    f = tmp_path / "bars.csv"
    f.write_text("2024.01.02,10:00:00,100,110,90,105,1,0,1\n2024.01.02,10:00:00,50,60,40,55,1,0,1\nwrong,10:01:00,1,1,1,1,1,0,1\n2024.01.02,10:01:00,105,106,104,105,1,0,2\n")
    store, catalog = str(tmp_path / "store"), Catalog(spark, str(tmp_path / "catalog"))
    first = import_bars(spark, str(f), store, "i", catalog=catalog)
    assert (first.read, first.accepted, first.rejected, first.inserted, first.duplicates) == (4, 3, 1, 2, 1)
    assert [r["open"] for r in spark.read.parquet(store).orderBy("ts").collect()] == [100, 105]
    again = import_bars(spark, str(f), store, "i", catalog=catalog)
    assert again.repeated == first.batch and again.read == 0
    batch = catalog.batches().collect()
    assert len(batch) == 1 and batch[0]["errors"] == ["3: bad date"] and batch[0]["accepted"] == 3
    f.write_text(f.read_text() + "2024.01.02,10:02:00,1,2,1,2,1,0,1\n")
    assert import_bars(spark, str(f), store, "i", catalog=catalog).inserted == 1
    assert import_bars(spark, str(f), store, "i").inserted == 0


def test_matrix_of_stored_features(spark):
    rows = [(1, '{"a.x": 1.5, "b": "2"}', 5), (2, '{"a.x": null, "b": ""}', None), (3, '{"b": "Infinity", "c": "word"}', 7), (4, "not json", 1), (5, None, 2), (6, "{}", 3)]
    d = spark.createDataFrame(rows, "id long, f string, pnl long")
    assert sorted((r["key"], r["kind"], r["n"], r["n_numbers"]) for r in keys_of(d, "f").collect()) == [("a.x", "number", 1, 1), ("b", "mixed", 2, 1), ("c", "text", 1, 0)]
    m = feature_matrix(d, "f", ["id", "pnl"], "pnl")
    assert sorted(map(tuple, m.collect())) == [(1, 5, 1.5, 2.0, None), (2, 0, None, None, None), (3, 7, None, None, None), (4, 1, None, None, None), (5, 2, None, None, None), (6, 3, None, None, None)]
    assert sorted(map(tuple, null_counts(m, ["a_x", "b"]).collect())) == [("a_x", 6, 5), ("b", 6, 5)]
    with pytest.raises(ValidationError):
        feature_matrix(d, "f", ["id", "a_x"], keys=["a.x"])
    own = matrix_from_rows(spark, [{"id": 1, "a.x": True, "b": float("nan")}, {"id": 2, "b": "3"}], ["a.x", "b"], {"id": "long"})
    assert sorted(map(tuple, own.collect())) == [(1, 1.0, None), (2, None, 3.0)]
    assert feature_matrix(d.limit(0), "f", ["id"]).columns == ["id"]


def test_features_do_not_depend_on_slices_and_failures_stay_alone(spark):
    bars = spark.createDataFrame(walk(random.Random(7), 400, minutes=60), BAR)
    ins = Instrument("a", "A", "UTC", open_minute=540, close_minute=960)
    plain = builtin_plugins(ins, 60)
    want = research.feature_rows(bars, plain).orderBy("ts").collect()
    # known at a bar is known from the bars up to it
    some = research.feature_rows(bars.limit(10_000).filter(F.col("ts") <= want[299]["ts"]), plain).orderBy("ts").collect()
    keys = [k.replace(".", "_") for p in plain.ordered("feature") for k in p.provides]
    for k in keys:
        a, b = want[299][k], some[299][k]
        assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9 * max(1, abs(a))), k
    plain.add(Plugin("own-bad", "1.0.0", "feature", lambda d: d.withColumn("own_x", F.raise_error(F.lit("broken")).cast("double")), ("own.x",)))
    failed = {}
    rows = research.feature_rows(bars, plain, {"core-candle": {"nothing": 1}}, failed)
    assert sorted(failed) == ["core-candle", "own-bad"]
    one = rows.filter("own_x IS NOT NULL OR candle_range IS NOT NULL").isEmpty()
    assert one and rows.filter("trend_ema20 IS NOT NULL").count() == 381


def test_synthetic_days_have_a_profile_and_join_up(spark):
    import numpy as np

    from fathomlab.sources.synthetic import BASE, factors, generate_bars

    rows = generate_bars(spark, "2024-01-01", 140, tz="UTC").orderBy("ts").toPandas()
    assert len(rows) == 100 * 480 and set(rows["ts"].dt.weekday) == {0, 1, 2, 3, 4}
    minute = rows["ts"].dt.hour * 60 + rows["ts"].dt.minute
    move = (rows["close"] - rows["open"]).abs()
    opened, lunch = move[(minute >= 570) & (minute < 585)].mean(), move[(minute >= 690) & (minute < 840)].mean()
    assert 3.5 < opened / lunch < 5 and abs(factors(np.array([569, 570, 584, 585, 959, 960])) - [0.45, 3.2, 3.2, 2.0, 1.6, 0.4]).max() == 0
    assert (rows["open"].to_numpy()[1:] == rows["close"].to_numpy()[:-1])[minute.to_numpy()[1:] != 480].all()
    assert (rows["low"] <= rows[["open", "close"]].min(axis=1)).all() and (rows["high"] >= rows[["open", "close"]].max(axis=1)).all()
    days = move.groupby(rows["ts"].dt.date).mean().to_numpy()
    assert np.corrcoef(days[:-1], days[1:])[0, 1] > 0.3 and BASE / 4 < days.mean() < BASE * 4
    again = generate_bars(spark, "2024-01-01", 140, tz="UTC").orderBy("ts").limit(50).toPandas()
    assert again["close"].tolist() == rows["close"].tolist()[:50]
