"""Calendar coverage: which day of which family has its packet, and what can be closed."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The longest span and the most families of a coverage matrix (fixed values).
MOST_DAYS, MOST_FAMILIES = 366, 50


def coverage(packets: DataFrame, first: str, last: str, today: str, family: str = "family", day: str = "day", created: str = "created", expected: Column | None = None) -> DataFrame:
    """family, day, state for every family and day from first to last: OPEN from today on, NOT_EXPECTED where
    expected (a condition on family and day) says so, MISSING without a packet, BACKFILL where it was made
    on a later day, else COMPLETE. More than MOST_DAYS days or MOST_FAMILIES families are an error."""
    if (date.fromisoformat(last) - date.fromisoformat(first)).days >= MOST_DAYS:
        raise ValueError(f"at most {MOST_DAYS} days")
    families = packets.select(family).distinct()
    if families.limit(MOST_FAMILIES + 1).count() > MOST_FAMILIES:
        raise ValueError(f"at most {MOST_FAMILIES} families")
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    grid = families.withColumn(day, F.explode(days))
    made = packets.groupBy(family, day).agg(F.min(F.to_date(created)).alias("_made"))
    state = F.when(F.col(day) >= F.lit(today).cast("date"), "OPEN").when(~(F.lit(True) if expected is None else expected), "NOT_EXPECTED").when(F.col("_made").isNull(), "MISSING").when(F.col("_made") > F.col(day), "BACKFILL").otherwise("COMPLETE")
    return grid.join(made, [family, day], "left").select(family, day, state.alias("state"))


def closable_days(states: DataFrame, day: str = "day") -> DataFrame:
    """day, closable, missing, backfills: a day can be closed once no family has it open or missing."""
    gaps = F.count_if(F.col("state").isin("OPEN", "MISSING"))
    return states.groupBy(day).agg((gaps == 0).alias("closable"), F.count_if(F.col("state") == "MISSING").alias("missing"), F.count_if(F.col("state") == "BACKFILL").alias("backfills"))


def scan_packets(notes: DataFrame, zone: str, family: str = "family", day: str = "date", created: str = "created_at") -> DataFrame:
    """family, day, created (the earliest, as a day of the zone), unparsed (notes of the family whose date is
    none) from notes with dates as text and moments in UTC."""
    parsed = notes.withColumn("_d", F.expr(f"try_cast({day} as date)"))
    bad = parsed.groupBy(family).agg(F.count_if(F.col("_d").isNull()).alias("unparsed"))
    good = parsed.where("_d is not null").groupBy(family, F.col("_d").alias("day")).agg(F.to_date(F.from_utc_timestamp(F.min(created), zone)).alias("created"))
    return good.join(bad, family)


def iso_week(day: Column) -> Column:
    """2026-W05: the ISO week with the ISO year."""
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), day).cast("int"), F.weekofyear(day))


def month_week(day: Column) -> Column:
    """The week of the month: days 1 to 7 are the first."""
    return F.expr("1").cast("int") * F.floor((F.dayofmonth(day) - 1) / 7).cast("int") + 1


def weeks_due(states: DataFrame, family: str = "family", day: str = "day") -> DataFrame:
    """family and week (its Monday) for full weeks without an open or missing day."""
    week = F.date_trunc("week", F.col(day)).cast("date")
    grouped = states.groupBy(family, week.alias("week")).agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("state").isin("OPEN", "MISSING")).alias("gaps"))
    return grouped.where("days = 7 and gaps = 0").select(family, "week")


def months_due(states: DataFrame, family: str = "family", day: str = "day") -> DataFrame:
    """family and month (its first day) for whole calendar months without an open or missing day."""
    month = F.date_trunc("month", F.col(day)).cast("date")
    grouped = states.groupBy(family, month.alias("month")).agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("state").isin("OPEN", "MISSING")).alias("gaps"))
    return grouped.where((F.col("days") == F.dayofmonth(F.last_day("month"))) & (F.col("gaps") == 0)).select(family, "month")
