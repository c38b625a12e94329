"""Trading days: decisions, executions and fits in force on a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decision_days(dates: DataFrame) -> DataFrame:
    """Every calendar day from the first to the last trading day of ``dates``, a table with a column ``date``.

    ``trades``; ``closed_weekday``, a Monday to Friday without trading; ``data_before_close`` and ``data_after_close``,
    the last trading day whose close is known in the course of the day and from its close on; ``rebalances``, the last
    trading day of an ISO week (the last day of all can't be told and isn't one); ``decided_on``, the last of these up
    to the day, null before the first; ``executes_on``, the next trading day after it, null at the end. A market has
    one row a day, so the windows over all of them stay small.
    """
    days = dates.select(F.col("date").cast("date").alias("date")).dropna().distinct()
    span = days.agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("day"))
    df = span.join(days.select(F.col("date").alias("day"), F.lit(True).alias("open")), "day", "left")
    order = Window.orderBy("day")
    upto, before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    at = F.when(F.col("open"), F.col("day"))
    df = df.select("day", F.coalesce("open", F.lit(False)).alias("trades"), F.max(at).over(upto).alias("data_after_close"), F.max(at).over(before).alias("data_before_close"), F.min(at).over(after).alias("executes_on"))
    ends = F.coalesce(F.col("trades") & (F.date_trunc("week", "executes_on") != F.date_trunc("week", "day")), F.lit(False))
    df = df.withColumn("rebalances", ends).withColumn("decided_on", F.max(F.when(F.col("rebalances"), F.col("day"))).over(upto))
    closed = ~F.col("trades") & (F.weekday("day") < 5)
    return df.select("day", "trades", closed.alias("closed_weekday"), "data_after_close", "data_before_close", "rebalances", "decided_on", "executes_on")


def execution_day(decisions: DataFrame, at_us: str, dates: DataFrame, opens: str = "09:30") -> DataFrame:
    """``decisions`` with ``executes_on``: the day of ``at_us`` if it trades and hasn't opened yet then, else the next.

    ``at_us`` holds microseconds since 1970 on the clock of the market. Decisions outside the calendar, or with a null
    time, are left out. The calendar is broadcast: a row per day.
    """
    hour, minute = map(int, opens.split(":"))
    days = decision_days(dates).select("day", "trades", F.col("executes_on").alias("__next"))
    seconds = F.floor(F.col(at_us) / F.lit(1_000_000))
    day, early = F.date_from_unix_date(F.floor(seconds / F.lit(86400)).cast("int")), F.pmod(seconds, F.lit(86400)) < hour * 3600 + minute * 60
    df = decisions.drop("day", "trades", "executes_on").withColumn("day", day).join(F.broadcast(days), "day")
    return df.withColumn("executes_on", F.when(F.col("trades") & early, F.col("day")).otherwise(F.col("__next"))).drop("day", "trades", "__next")


def groups_at(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """Rows of ``ticker, date`` with ``fit_year`` and ``grp`` of the schedule (``fit_year, ticker, grp``) in force.

    That is the latest fit of the date's year or before, or the earliest of all. Names it lacks are ``other``. Which
    fit a year has is looked up in the distinct years only; rows meet groups by equality of year and ticker.
    """
    fits = schedule.select("fit_year").distinct().agg(F.sort_array(F.collect_list("fit_year")).alias("fits"))  # one row, a number per year
    own = F.filter("fits", lambda y: y <= F.year("date"))
    df = rows.drop("fit_year", "grp").join(F.broadcast(fits)).withColumn("fit_year", F.coalesce(F.try_element_at(own, F.lit(-1)), F.try_element_at("fits", F.lit(1)))).drop("fits")
    return df.join(schedule, ["fit_year", "ticker"], "left").withColumn("grp", F.coalesce("grp", F.lit("other")))


def days_to_next(rows: DataFrame, events: DataFrame, entity: str, day: str, event_day: str, out: str) -> DataFrame:
    """``rows`` with ``out``: days from ``day`` to the next event of the entity on it or after it, null where none comes.

    Rows and distinct event days of an entity are put in one order and the next event is carried back, so no row meets
    all events. Rows with a null entity or day get null.
    """
    marks = events.select(F.col(entity).alias("__e"), F.col(event_day).cast("date").alias("__d")).dropna().distinct().withColumn("__event", F.col("__d"))
    asked = rows.select(F.col(entity).alias("__e"), F.col(day).cast("date").alias("__d")).dropna().distinct().withColumn("__event", F.lit(None).cast("date"))
    order = Window.partitionBy("__e").orderBy("__d").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    both = marks.withColumn("__asked", F.lit(False)).unionByName(asked.withColumn("__asked", F.lit(True)))
    found = both.withColumn("__next", F.min("__event").over(order)).filter("__asked").select("__e", "__d", "__next")
    joined = rows.drop(out).join(found, (F.col(entity) == F.col("__e")) & (F.col(day).cast("date") == F.col("__d")), "left")
    return joined.withColumn(out, F.datediff("__next", "__d")).drop("__e", "__d", "__next")
