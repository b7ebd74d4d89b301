"""Trading calendars as tables: open days, sessions, phases, deadlines by open minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The regular sessions of a day in minutes after midnight, and the early close.
SESSIONS = ((570, 690), (780, 900))
EARLY_CLOSE = 690


def calendar(spark: SparkSession, start: str, end: str, holidays: list[tuple[str, str]], early: list[str]) -> DataFrame:
    """(day, is_open, early) of every date in [start, end]: weekends and holiday ranges are closed."""
    days = spark.sql(f"SELECT explode(sequence(date'{start}', date'{end}')) AS day")
    closed = F.dayofweek("day").isin(1, 7)
    for a, b in holidays:
        closed = closed | F.col("day").between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    return days.select("day", (~closed).alias("is_open"), F.col("day").cast("string").isin(*early).alias("early"))


def spans(days: DataFrame) -> DataFrame:
    """(day, open_min, close_min) of open days' sessions."""
    each = F.array(*[F.struct(F.lit(a).alias("open_min"), F.lit(b).alias("close_min")) for a, b in SESSIONS])
    s = days.where("is_open").select("day", "early", F.explode(each).alias("s"))
    return s.where(~F.col("early") | (F.col("s.open_min") < EARLY_CLOSE)).select("day", "s.open_min", F.when(F.col("early"), F.least("s.close_min", F.lit(EARLY_CLOSE))).otherwise(F.col("s.close_min")).alias("close_min"))


def phase(is_open: Column, minute: Column) -> Column:
    return F.when(~is_open | (minute < SESSIONS[0][0]), "premarket").when(minute < SESSIONS[-1][1], "intraday").otherwise("postmarket")


def numbered(days: DataFrame) -> DataFrame:
    """Open days with their number; a calendar is a bounded table, so one window over it is fine."""
    return days.where("is_open").withColumn("nth", F.row_number().over(Window.orderBy("day")).cast("long"))


def clock(days: DataFrame) -> DataFrame:
    """Sessions with the open minutes that went before each."""
    s = spans(days)
    w = Window.orderBy("day", "open_min").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("before", F.coalesce(F.sum(F.col("close_min") - F.col("open_min")).over(w), F.lit(0)))


def advance(moments: DataFrame, days: DataFrame, minutes: int) -> DataFrame:
    """(id, due_day, due_min): each moment (id, day, minute) moved on by open minutes; outside sessions it starts at the next one.

    Both steps are joins on equal keys with tables of the calendar's size: its days with their sessions, and its open
    minutes by number. Moments on days that the calendar doesn't hold, and those due after its end, give no row.
    """
    c = clock(days)
    sessions = c.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("open_min", "close_min", "before"))).alias("sessions"))
    ends = c.groupBy("day").agg(F.sum(F.col("close_min") - F.col("open_min")).alias("length"))
    gone = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    each = days.select("day").join(ends, "day", "left").withColumn("after", F.coalesce(F.sum("length").over(gone), F.lit(0))).join(sessions, "day", "left")
    m = moments.join(each.select("day", "after", F.coalesce("sessions", F.array().cast(sessions.schema["sessions"].dataType)).alias("sessions")), "day")
    s = F.try_element_at(F.filter("sessions", lambda s: s["close_min"] > F.col("minute")), F.lit(1))
    worked = m.select("id", s.alias("s"), "minute", "after").select("id", (F.coalesce(F.col("s.before") + F.greatest(F.col("minute") - F.col("s.open_min"), F.lit(0)), F.col("after")) + minutes).alias("goal"))
    due = c.select(F.col("day").alias("due_day"), F.col("open_min"), F.explode(F.sequence(F.lit(1), F.col("close_min") - F.col("open_min"))).alias("nth"), "before")
    due = due.select("due_day", (F.col("open_min") + F.col("nth")).cast("long").alias("due_min"), (F.col("before") + F.col("nth")).alias("goal"))
    return worked.join(due, "goal").select("id", "due_day", "due_min")


#: The clock of each market.
ZONES = {"A": "Asia/Shanghai", "HK": "Asia/Hong_Kong", "US": "America/New_York", "UK": "Europe/London"}


def local_time(instant: Column, market: Column) -> Column:
    """The market's own clock at an instant (microseconds of UTC), as microseconds of a naive clock; an unknown market has Shanghai's.

    The zone is a literal in each branch, so that Spark doesn't look it up for each row; summer time counts.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    naive = F.timestamp_add("MICROSECOND", instant, epoch)
    at = lambda zone: F.timestamp_diff("MICROSECOND", epoch, F.convert_timezone(F.lit("UTC"), F.lit(zone), naive))
    out = at(ZONES["A"])
    for name, zone in ZONES.items():
        out = F.when(market == name, at(zone)).otherwise(out)
    return out
