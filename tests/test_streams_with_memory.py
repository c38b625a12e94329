import datetime as dt

import numpy as np

from almagest.operators import books, models
from almagest.streaming import events as ev

DAY = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)


def run(spark, df, batches, name, make, tmp_path):
    """The rows of a stream over ``batches`` of rows, one a micro-batch."""
    for part in batches:
        spark.createDataFrame(part, df).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = make(spark.readStream.schema(df).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    return spark.table(name).collect()


def test_probabilities_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(0, np.where(np.arange(60) % 30 > 20, 2.5, 0.7))
    model = {"pi": np.array([0.9, 0.1]), "move": np.array([[0.97, 0.03], [0.06, 0.94]]), "mean": np.array([0.0, -0.2]), "sd": np.array([0.7, 2.2])}
    rows = [("a", DAY(i), float(v)) for i, v in enumerate(x)]
    got = run(spark, "name string, date date, ret double", [rows[:25], [*rows[25:40], ("b", DAY(40), None)], rows[40:]], "p_stress", lambda s: ev.stress_probabilities(s, model), tmp_path)
    want = models.filtered(x, model["pi"], model["move"], model["mean"], model["sd"])[0][:, 1]
    assert np.allclose([r.p_stress for r in sorted(got, key=lambda r: r.date)], want) and len(got) == 60


def test_books_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [("x", DAY(7 * k), f"t{t}", f"g{t % 3}", int(r) + 1) for k in range(6) for t, r in enumerate(rng.permutation(20))]
    got = run(spark, "portfolio string, date date, ticker string, grp string, rnk int", [rows[:60], rows[60:80], rows[80:]], "books", lambda s: ev.carried_books(s, 5, 9, 2), tmp_path)
    held, want = [], set()
    for k in range(6):
        part = [r for r in rows if r[1] == DAY(7 * k)]
        held = books.select_banded({r[2]: r[4] for r in part}, {r[2]: r[3] for r in part}, held, 5, 9, 2)
        want |= {(DAY(7 * k), t) for t in held}
    assert {(r.date, r.ticker) for r in got} == want


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema = "ticker string, period date, known timestamp"
    for k in range(2):
        spark.createDataFrame([("a", DAY(k), dt.datetime(2024, 5, 1 + 3 * k))], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ev.start(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == k + 1
    assert ev.known_by(spark.read.schema(schema).parquet(str(tmp_path / "in"))).count() == 2
