import datetime as dt
import random

from almagest.operators import pit

DAY = lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)


def test_knowable_against_loops(spark):
    """Named periods, near filings, defaults; ties, repeats, nulls, a ticker with a third of the rows."""
    rng = random.Random(2)
    name = lambda: rng.choice(["hot", None, *[f"t{i}" for i in range(6)], "hot", "hot"])
    reports = [(i, name(), DAY(rng.randint(0, 900)) if rng.random() > 0.05 else None) for i in range(200)]
    reports += reports[:3]
    filings = [(name(), DAY(rng.randint(0, 1000)) if rng.random() > 0.05 else None, rng.choice([None, None, rng.choice(reports)[2]])) for _ in range(300)]
    got = spark.createDataFrame(reports, "id int, ticker string, pe date")
    got = sorted((r.id, r.knowable or DAY(-1), r.by) for r in pit.knowable(got, spark.createDataFrame(filings, "ticker string, filing_day date, period_end date")).collect())
    want = []
    for i, t, pe in reports:
        own = [(d, p) for f, d, p in filings if f == t and t is not None and d is not None] if pe else []
        named = [d for d, p in own if p == pe and (d - pe).days <= 120]
        near = [d for d, _ in own if 6 <= (d - pe).days <= 120]
        if named:
            want.append((i, min(named) + dt.timedelta(1), "period"))
        elif near:
            want.append((i, min(near) + dt.timedelta(1), "near"))
        else:
            want.append((i, pe + dt.timedelta(60) if pe else DAY(-1), "default"))
    assert got == sorted(want)


def test_states_against_loops_and_nothing_is_seen_early(spark):
    rng = random.Random(3)
    rows = []
    for t in ("a", "b", "c"):
        for q in range(14):
            pe = DAY(91 * q)
            rows.append((t, pe, pe + dt.timedelta(rng.randint(10, 200)), float(q) if rng.random() > 0.1 else None, rng.random() if rng.random() > 0.2 else None, float(100 + q)))
    df = spark.createDataFrame(rows, "ticker string, pe date, knowable date, eps double, margin double, cash double")
    states = pit.trailing_states(df, ["eps"], ["margin"], ["cash"])
    dates = spark.createDataFrame([(t, DAY(30 * k)) for t in ("a", "b", "c", "none") for k in range(50)], "ticker string, date date")
    got = {(r.ticker, r.date): r for r in pit.at_dates(dates, states, ["pe", "ttm_eps", "ttm_margin", "latest_cash", "public"]).collect()}
    for t in ("a", "b", "c", "none"):
        for k in range(50):
            seen = sorted((r for r in rows if r[0] == t and r[2] <= DAY(30 * k)), key=lambda r: r[1])[-4:]
            if not seen:
                assert (t, DAY(30 * k)) not in got
                continue
            r = got[t, DAY(30 * k)]
            full = len(seen) == 4 and (seen[-1][1] - seen[0][1]).days <= 300
            eps, margins = [x[3] for x in seen], [x[4] for x in seen if x[4] is not None]
            assert r.pe == seen[-1][1] and r.public == seen[-1][2] and r.latest_cash == seen[-1][5]
            assert r.ttm_eps == (sum(eps) if full and None not in eps else None)
            assert (r.ttm_margin is None) == (not full or len(margins) < 3)
    assert pit.trailing_states(df.limit(0), ["eps"]).count() == 0


def test_columns_by_any_name():
    assert pit.resolve_columns(["Ticker", "IS_EPS", "eps", "Revenue", "bs_tot_asset"]) == {"eps": "IS_EPS", "sales": "Revenue", "total_assets": "bs_tot_asset"}
    assert pit.resolve_columns([]) == {}


def test_first_definition_of_quality_that_there_is(spark):
    rows = [(f"t{i}", DAY(0), 10.0 + i, 100.0, float(i), -5.0 if i == 3 else 50.0, 0.1 * i, 1.0 + i, 10.0 if i != 2 else 0.0) for i in range(6)]
    df = spark.createDataFrame(rows, "ticker string, date date, gross_profit double, total_assets double, net_income double, equity double, gross_margin double, ebit double, sales double")
    one = lambda d, c="quality": {r.ticker: r[c] for r in pit.quality(d).collect()}
    assert one(df)["t1"] == 0.11 and one(df, "quality_def")["t1"] == "gross_profit_assets"
    roe = one(df.drop("gross_profit"))
    assert roe["t3"] is None and roe["t5"] == 0.1
    blend = one(df.drop("gross_profit", "equity"))
    assert blend["t2"] is None and blend["t5"] == 0.5 and abs(blend["t0"] - ((1 / 6 - 0.5) + (1 / 5 - 0.5)) / 2) < 1e-12
    assert one(df.select("ticker", "date", "gross_margin"), "quality_def")["t0"] == "unavailable"


def test_value_counts_losses_as_zero(spark):
    rows = [("a", 4.0, 40.0), ("b", -2.0, 30.0), ("c", 1.0, 0.0), ("d", None, 10.0)]
    got = {r.ticker: r.value for r in pit.value(spark.createDataFrame(rows, "ticker string, eps double, close double"), "close").collect()}
    assert got == {"a": 0.1, "b": 0.0, "c": None, "d": None}
    cash = pit.value(spark.createDataFrame([("a", 2.0, 40.0)], "ticker string, fcf_per_share double, close double"), "close").collect()[0]
    assert cash.value == 0.05 and cash.value_def == "fcf_yield"
    assert pit.value(spark.createDataFrame([("a", 40.0)], "ticker string, close double"), "close").collect()[0].value_def == "unavailable"
