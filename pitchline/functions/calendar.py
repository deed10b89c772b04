"""Season calendar.  The date of reference is always an argument, never the wall clock."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A season starts in July; where results and fixtures are published.
SEASON_FIRST_MONTH = 7
RESULTS_URL = "https://www.football-data.co.uk/mmz4281/{code}/E0.csv"
FIXTURES_URL = "https://fixturedownload.com/download/{slug}-GMTStandardTime.csv"


def season_start_year(day: Column) -> Column:
    """The year in which the day's season started; null for a null day."""
    return F.year(day) - (F.month(day) < SEASON_FIRST_MONTH).cast("int")


def current_season(as_of: date) -> int:
    return as_of.year - (as_of.month < SEASON_FIRST_MONTH)


def season_code(start: int) -> str:
    return f"{start % 100:02d}{(start + 1) % 100:02d}"


def season_label(start: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def season_slug(start: int) -> str:
    return f"epl-{start}"


def results_url(start: int) -> str:
    return RESULTS_URL.format(code=season_code(start))


def fixtures_url(start: int) -> str:
    return FIXTURES_URL.format(slug=season_slug(start))


def lenient_date(text: Column) -> Column:
    """Day-first date with or without a time of day; null where neither form fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in ("d/M/yyyy H:mm", "d/M/yyyy", "d/M/yy")]).cast("timestamp_ntz")
