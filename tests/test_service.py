import datetime as dt

import pytest

from almagest import service as sv
from almagest.__main__ import main

FOLDER = "/root/testdata/sf0.01"


def test_health_says_what_is_missing(spark, tmp_path):
    assert all(r.there and r.n > 0 for r in sv.health(spark, FOLDER).collect())
    assert not any(r.there for r in sv.health(spark, str(tmp_path)).collect())
    assert sv.last_day(spark, FOLDER).first().last_day == dt.date(2025, 12, 31)
    assert sv.calendar_of(spark, FOLDER).count() > 700


def test_books_and_records(spark):
    book = sv.holdings(spark, FOLDER).collect()
    assert 5 <= len(book) <= 16 and abs(sum(r.weight for r in book) - 1) < 1e-9 and len({r.as_of for r in book}) == 1
    assert [r.rnk for r in sv.model(spark, FOLDER).collect()] == list(range(1, 31))
    all_records = sv.decisions(spark, FOLDER, dt.date(1990, 1, 1), dt.date(2030, 1, 1)).collect()
    middle = sorted(all_records, key=lambda r: r.data_through)[40]
    known = sv.decide(spark, FOLDER, f"{middle.data_through} 16:00 ET").collect()[0]
    assert known.data_through == middle.data_through and known.decided_on == middle.decided_on
    assert known.target_holdings == middle.target_holdings  # later bars change nothing
    assert sv.decide(spark, FOLDER, "1997-01-01").count() == 0
    with pytest.raises(ValueError):
        sv.decide(spark, FOLDER, "soon")
    with pytest.raises(ValueError):
        sv.decisions(spark, FOLDER, dt.date(2024, 1, 2), dt.date(2024, 1, 1))


def test_a_kept_book_never_looks_ahead(spark):
    book = [("A", 0.6), ("CASHHOLDING", 0.4)]
    got = sv.frozen(spark, book, dt.date(2024, 1, 5), dt.date(2024, 1, 6), dt.date(2024, 1, 31)).collect()[0]
    assert got.execution_date == dt.date(2024, 1, 8) and len(got.target_holdings) == 2
    for start, end in ((dt.date(2024, 1, 5), dt.date(2024, 2, 1)), (dt.date(2024, 1, 6), dt.date(2024, 1, 7))):
        with pytest.raises(ValueError):
            sv.frozen(spark, book, dt.date(2024, 1, 5), start, end)


def test_backtest_and_screen(spark):
    names = [r.ticker for r in sv.screen(spark, FOLDER, limit=3).collect()]
    request = sv.BacktestRequest(names, dt.date(2024, 1, 1), dt.date(2024, 12, 31))
    free, paid = (sv.backtest(spark, FOLDER, sv.BacktestRequest(names, request.start, request.end, cost_bps=c)).collect()[0] for c in (0.0, 50.0))
    assert free.n_days == paid.n_days > 200 and free.total_return > paid.total_return
    for bad in ({"rebalance": "hourly"}, {"cost_bps": -1.0}, {"weights": [0.5, 0.5]}, {"end": dt.date(2023, 1, 1)}, {"end": dt.date(2024, 1, 2)}):
        with pytest.raises(ValueError):
            sv.backtest(spark, FOLDER, sv.BacktestRequest(**{"tickers": names, "start": request.start, "end": request.end, **bad}))
    with pytest.raises(ValueError):
        sv.screen(spark, FOLDER, limit=1000)
    rows = sv.screen(spark, FOLDER, sector_contains="FINANC", limit=200).collect()
    assert len(rows) < sv.screen(spark, FOLDER, limit=200).count()


def test_what_was_known_of_a_ticker(spark):
    ticker = spark.read.parquet(f"{FOLDER}/fundamentals_actuals.parquet").filter("ticker is not null").groupBy("ticker").count().orderBy("count", ascending=False).first().ticker
    early, late = (sv.known_on(spark, FOLDER, ticker, d).collect() for d in (dt.date(2023, 1, 1), dt.date(2026, 1, 1)))
    assert len(early) < len(late) and {r.date for r in early} <= {r.date for r in late}
    assert all(r.known_us <= 1672635600_000000 for r in early)


def test_command_line(spark, tmp_path):
    main(["ttm", "/root/testdata/sf0.001", "--out", str(tmp_path / "o"), "--format", "csv"])
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).count() > 0
    with pytest.raises(SystemExit):
        main(["nothing", "/root/testdata/sf0.001"])
