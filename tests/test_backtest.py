"""Backtests against a plain loop over days, and books that know nothing of the future."""

import numpy as np
import pandas as pd
import pytest

from almagest.operators import backtest as bt
from almagest.operators import books, models

SCENARIOS = [
    bt.Scenario("plain", {"a": 1.0, "b": 0.5}, n=6, exit_rank=6, quota=2, keeps=False, band=0.0, every=3),
    bt.Scenario("bands", {"a": 1.0, "b": 0.5}, n=6, exit_rank=12, quota=2, band=0.03, every=3, offset=1, beta_max=1.0, stress_cash=0.25),
    bt.Scenario("late", {"a": 1.0}, n=16, exit_rank=20, quota=5, band=0.02, lag=2, every=4, flat_bps=10.0),
    bt.Scenario("open", {"a": 1.0, "b": 0.5}, n=6, exit_rank=12, quota=2, band=0.02, every=3, at_open=True),
    bt.Scenario("panic", {"a": 1.0, "b": 1.0}, n=5, exit_rank=9, quota=3, every=5, halve_in_panic="a", cost_times=2.0, stress_cash=0.5),
]


def tables(days=40, names=30, seed=0):
    rng = np.random.default_rng(seed)
    returns = pd.DataFrame([(f"t{i:02d}", d, rng.normal(0, 0.05) if rng.random() > 0.1 else None, rng.normal(0, 0.02) if rng.random() > 0.2 else None) for i in range(names) for d in range(days) if rng.random() > 0.15 or d == 0], columns=["ticker", "day_idx", "ret", "overnight"])
    rows = []
    for d in range(10, days):
        stress, panic = bool(d % 7 < 3), bool(d % 5 < 2)
        if d == 23:
            continue  # a day on which nothing may be held
        for i in range(names):
            if rng.random() > 0.25:
                rows.append((f"t{i:02d}", d, f"g{i % 4}" if i % 9 else None, rng.uniform(0.5, 1.8) if i % 5 else None, rng.uniform(0, 3), [5.0, 10.0, 20.0][i % 3], i % 4 == 0, stress, panic, round(rng.normal(), 3), round(rng.normal(), 3) if i % 7 else None))
    pool = pd.DataFrame(rows, columns=["ticker", "day_idx", "grp", "beta", "amihud", "bps", "near", "stress", "panic", "z_a", "z_b"])
    return pool, returns


def plain(s, pool, returns, book_value):
    """The definition, day by day."""
    ret = {(r.ticker, r.day_idx): r.ret for r in returns.itertuples() if r.ret == r.ret and r.ret is not None}
    on = {(r.ticker, r.day_idx): (r.overnight if r.overnight == r.overnight and r.overnight is not None else 0.0) for r in returns.itertuples()}
    rest = {key: (1 + ret.get(key, 0.0)) / (1 + o) - 1 for key, o in on.items()}
    first, last = pool.day_idx.min() + s.lag, returns.day_idx.max()
    held, value, out, paid_by = {}, 1.0, [], None

    def cost(changes, signal):
        now = pool[pool.day_idx == signal].set_index("ticker")
        total = 0.0
        for t, c in changes.items():
            c = abs(c)
            if s.flat_bps:
                total += c * s.flat_bps / 1e4
                continue
            bps = now.bps[t] if t in now.index else 20.0
            worst = now.amihud.max() if len(now) else 0.0
            total += c * bps / 1e4 + (now.amihud[t] if t in now.index else worst) * book_value * value / 1e6 * c * c
        return total * s.cost_times

    for day in range(first, last + 1):
        trades = day == first or day % s.every == s.offset
        earned = on if s.at_open and trades else ret
        gross = sum(w * earned.get((t, day), 0.0) for t, w in held.items())
        held = {t: w * (1 + earned.get((t, day), 0.0)) / (1 + gross) for t, w in held.items()}
        turnover = paid = 0.0
        if trades:
            paid_by = day - s.lag
            now = pool[pool.day_idx == paid_by].copy()
            target = {}
            if len(now):
                wa = {f: w * (0.5 if s.halve_in_panic == f and now.panic.iloc[0] else 1) for f, w in s.weights.items()}
                now["score"] = (sum(now[f"z_{f}"].fillna(0) * w for f, w in wa.items()) / sum(wa.values())).round(9)
                now = now.sort_values(["score", "ticker"], ascending=[False, True]).reset_index(drop=True)
                rank = {t: i + 1 for i, t in enumerate(now.ticker)}
                group = {t: g if isinstance(g, str) else None for t, g in zip(now.ticker, now.grp)}
                picks = books.select_banded(rank, group, list(held) if s.keeps else [], s.n, s.exit_rank if s.keeps else s.n, s.quota)
                near = dict(zip(now.ticker, now.near))
                weigh = lambda p: bt.equal_under_caps(np.array([near[t] for t in p]))
                invested = 1 - s.stress_cash if now.stress.iloc[0] else 1.0
                if s.beta_max:
                    at = {t: i for i, t in enumerate(now.ticker)}
                    got = models.beta_limited([at[t] for t in picks], np.array([rank[t] for t in now.ticker]), np.array([group[t] for t in now.ticker], dtype=object), now.beta.to_numpy(float), lambda p: weigh([now.ticker[i] for i in p]), s.beta_max, invested, s.exit_rank, s.quota)
                    picks = [now.ticker[i] for i in got]
                target = dict(zip(picks, weigh(picks) * invested))
            new = bt.banded(held, target, s.band)
            changes = {t: new.get(t, 0.0) - held.get(t, 0.0) for t in {**held, **new}}
            turnover, paid, held = sum(map(abs, changes.values())), cost(changes, paid_by), new
            if s.at_open:
                inside = sum(w * rest.get((t, day), 0.0) for t, w in held.items())
                held = {t: w * (1 + rest.get((t, day), 0.0)) / (1 + inside) for t, w in held.items()}
                gross = (1 + gross) * (1 + inside) - 1
        value *= 1 + gross - paid
        out.append([day, gross - paid, gross, turnover, paid])
    leave = cost({t: -w for t, w in held.items()}, paid_by)
    out[-1][1] -= leave
    out[-1][3] += sum(held.values())
    out[-1][4] += leave
    return np.array(out)


@pytest.fixture(scope="module")
def made(spark):
    pool, returns = tables()
    schema = "ticker string, day_idx long, grp string, beta double, amihud double, bps double, near boolean, stress boolean, panic boolean, z_a double, z_b double"
    frame = lambda df, schema: spark.createDataFrame(df.astype(object).where(df.notna(), None), schema)
    return pool, returns, frame(pool, schema), frame(returns, "ticker string, day_idx long, ret double, overnight double")


def test_against_days_in_turn(made):
    pool, returns, p, r = made
    daily = bt.run(p, r, SCENARIOS, book_value=5e4)["daily"].toPandas()
    for s in SCENARIOS:
        got = daily[daily.scenario == s.name].sort_values("day_idx")[["day_idx", "ret", "gross", "turnover", "cost"]].to_numpy(float)
        want = plain(s, pool, returns, 5e4)
        assert got.shape == want.shape and np.allclose(got, want, atol=1e-9), s.name
    assert len(bt.summary(bt.run(p, r, SCENARIOS[:1])["daily"], 252).collect()) == 1


def test_the_future_changes_nothing(made, spark):
    _, _, p, r = made
    whole = bt.run(p, r, SCENARIOS)["books"].filter("day_idx <= 24").toPandas()
    cut = bt.run(p.filter("day_idx <= 24"), r.filter("day_idx <= 24"), SCENARIOS)["books"].filter("day_idx <= 24").toPandas()
    key = lambda df: sorted((x.scenario, x.day_idx, x.ticker, round(x.before, 12), round(x.weight, 12)) for x in df.itertuples())
    assert key(whole) == key(cut) and len(whole)


def test_nothing_to_hold(made):
    _, _, p, r = made
    assert bt.run(p.limit(0), r, SCENARIOS)["daily"].count() == 0
    assert bt.run(p, r.limit(0), SCENARIOS)["daily"].count() == 0


def test_chance_depends_on_the_seed_only(made):
    _, _, p, r = made
    twice = [bt.Scenario("x", {}, n=5, seed=3, every=6), bt.Scenario("y", {}, n=5, seed=3, every=6), bt.Scenario("z", {}, n=5, seed=4, every=6), bt.Scenario("noise", {"a": 1.0}, n=5, noise=1.0, every=6)]
    b = bt.run(p, r, twice)["books"].filter("weight > 0").toPandas()
    names = {s: sorted(zip(g.day_idx, g.ticker)) for s, g in b.groupby("scenario")}
    assert names["x"] == names["y"] != names["z"] and names["noise"]


def test_small_trades_are_not_made():
    got = bt.banded({"A": 0.27, "B": 0.33, "C": 0.40}, {"A": 0.26, "B": 0.24, "D": 0.50}, 0.02)
    assert got["A"] == 0.27 and abs(sum(got.values()) - 1) < 1e-12 and got["B"] < 0.33 and "C" not in got
    assert bt.banded({}, {"A": 1.0}, 0.02) == {"A": 1.0}
    assert abs(sum(bt.banded({"A": 0.5, "B": 0.5}, {"A": 0.51, "B": 0.49}, 0.02).values()) - 1) < 1e-12


def test_open_at_the_close_before_changes_nothing(made):
    """Where the night brings nothing, books that trade at the open earn what the day brings as well."""
    _, _, p, r = made
    two = [bt.Scenario("close", {"a": 1.0}, n=5, every=4), bt.Scenario("open", {"a": 1.0}, n=5, every=4, at_open=True)]
    b = bt.run(p, r.drop("overnight"), two)["books"].filter("weight > 0").toPandas()
    first = b[b.day_idx == b.day_idx.min()]
    assert sorted(first[first.scenario == "close"].ticker) == sorted(first[first.scenario == "open"].ticker)


def test_any_function_can_choose(made):
    _, _, p, r = made
    own = bt.Scenario("own", {"a": 1.0}, every=5, band=0.0, strategy=lambda now, held: {t: 0.5 for t in now["ticker"][:2]})
    b = bt.run(p, r, [own])["books"].filter("weight > 0").toPandas()
    assert (b.weight == 0.5).all() and (b.groupby("day_idx").size() == 2).all()
