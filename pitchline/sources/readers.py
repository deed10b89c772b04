"""Sources.  Network and landing stay outside Spark; tables have explicit schemas."""

from __future__ import annotations

import csv
import io
import re
import urllib.request
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import fixtures_url, lenient_date, results_url, season_label
from ..functions.names import known_name
from ..operators.cleaning import BOUNDS, CORE, FIXTURE_CORE, OPTIONAL, require_columns
from ..operators.reconcile import FILE_NAME
from . import files

TIMEOUT_S = 30
_INT = [c for c in BOUNDS if c not in ("HxG", "AxG")]
#: The season in the name of a raw file.
SEASON_IN_NAME = r"_(\d{4})\.csv"


class DataSourceError(RuntimeError):
    """A source that can't be reached, or whose answer isn't a usable table."""


def fetch_csv(url: str, name: str, opener: Callable[..., object] = urllib.request.urlopen) -> str:
    """The table at ``url`` as text: status 200, not blank, at least three columns and one row."""
    try:
        with opener(url, timeout=TIMEOUT_S) as r:
            status, raw = getattr(r, "status", 200), r.read()
    except OSError as e:
        raise DataSourceError(f"{name}: {e}") from e
    if status != 200:
        raise DataSourceError(f"{name}: status {status}")
    text = raw.decode("utf-8-sig", "replace")
    rows = list(csv.reader(io.StringIO(text)))
    if not text.strip() or len(rows) < 2 or len(rows[0]) < 3:
        raise DataSourceError(f"{name}: not a table")
    return text


def header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names of a CSV file: its first line that isn't blank, () without one.

    A column without a name, or with that of one further left (in any case), is called ``_c`` and its place.
    """
    line = next((x for x in files.lines(spark, path) if x.strip()), None)
    names: list[str] = []
    for i, name in enumerate(next(csv.reader([line])) if line else []):
        name = name.strip()
        names.append(f"_c{i}" if not name or name.lower() in {n.lower() for n in names} else name)
    return tuple(names)


def read_csv(spark: SparkSession, paths: str | list[str], since: int | None = None) -> DataFrame:
    """CSV files (paths or patterns) by column name, all columns as text, and ``_file``, the file's name.

    Each file's values stand under its own header: files of one header are read together, and those of different
    headers are united by name, so a column that a file lacks is null there.  With ``since``, files
    of earlier seasons by their name, or of none, aren't opened.  Blank files have no rows.
    """
    found = [f for p in ([paths] if isinstance(paths, str) else paths) for f in files.found(spark, p)]
    if not found:
        raise DataSourceError(f"no files match {paths}")
    if since is not None:
        found = [f for f in found if (m := re.search(SEASON_IN_NAME, f.rsplit("/", 1)[-1])) and int(m[1]) >= since]
    groups: dict[tuple[str, ...], list[str]] = {}
    for f in found:  # one line of each file
        if names := header(spark, f):
            groups.setdefault(names, []).append(f)
    frames = []
    for names, same in groups.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        frames.append(spark.read.option("header", True).option("encoding", "UTF-8").schema(schema).csv(same).select(*[F.col(f"`{n}`") for n in names], F.col("_metadata.file_name").alias("_file")))
    if not frames:
        raise DataSourceError(f"no files with a header match {paths}" + ("" if since is None else f" since {since}"))
    return union_seasons(frames)


def season_of_file(name: str = "_file"):
    return F.try_element_at(F.regexp_extract_all(name, F.lit(SEASON_IN_NAME)), F.lit(1)).cast("int")


def results(spark: SparkSession, paths: str | list[str], since: int | None = None) -> DataFrame:
    """Typed results: lenient dates and numbers (bad ones null), canonical names, season of the file."""
    raw = require_columns(read_csv(spark, paths, since), CORE, "results")
    names = {c: F.expr(f"try_cast(`{c}` as int)") for c in _INT if c in raw.columns} | {c: F.expr(f"try_cast(`{c}` as double)") for c in ("HxG", "AxG") if c in raw.columns}
    out = raw.withColumns({**names, "Date": F.to_date(lenient_date(F.col("Date"))), "HomeTeam": known_name(F.col("HomeTeam")), "AwayTeam": known_name(F.col("AwayTeam")), "SeasonStartYear": season_of_file()})
    return out.withColumn("Season", season_label(F.col("SeasonStartYear")))


def fixtures(spark: SparkSession, paths: str | list[str], since: int | None = None) -> DataFrame:
    raw = require_columns(read_csv(spark, paths, since), FIXTURE_CORE, "fixtures")
    out = raw.withColumns({"Round Number": F.expr("try_cast(`Round Number` as int)"), "Date": lenient_date(F.col("Date")), "Home Team": known_name(F.col("Home Team")), "Away Team": known_name(F.col("Away Team")), "SeasonStartYear": season_of_file()})
    return out.withColumn("Season", season_label(F.col("SeasonStartYear")))


def union_seasons(frames: list[DataFrame]) -> DataFrame:
    """Seasons by column name; columns that a season lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def prediction_documents(spark: SparkSession, path: str, schema: str | None = None, parent: bool = False) -> DataFrame:
    """Prediction files with prediction_time from their names; other names and malformed files are skipped.

    With ``parent`` each prediction is a folder of that name, of files with a document a line, as Spark writes them.
    """
    reader = spark.read.option("multiLine", not parent).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    df = (reader.schema(f"{schema}, _bad string") if schema else reader).json(path)
    df = df.select("*", F.regexp_extract(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1) if parent else F.col("_metadata.file_name"), FILE_NAME, 1).alias("_stamp"))
    df = df.filter(F.col("_bad").isNull()).drop("_bad") if "_bad" in df.columns else df
    return df.filter(F.col("_stamp") != "").withColumn("prediction_time", F.try_to_timestamp("_stamp", F.lit("yyyyMMdd_HHmmss"))).drop("_stamp")


def update_all(last: int, seasons_back: int, land: Callable[[str, int, str], None], have: Callable[[str, int], bool], force: bool = False, fetch: Callable[[str, str], str] = fetch_csv) -> tuple[list[dict], list[str]]:
    """Lands results and fixtures of the last seasons: (provenance rows, errors).

    A finished season's results are fetched once; the current season's, and all fixtures, every time.
    Errors are gathered by source, so one that fails doesn't hide the others; callers stop before cleaning.
    """
    done, errors = [], []
    for start in range(last - seasons_back + 1, last + 1):
        for kind, url in (("results", results_url(start)), ("fixtures", fixtures_url(start))):
            if kind == "results" and start < last and not force and have(kind, start):
                continue
            try:
                text = fetch(url, f"{kind} {start}")
            except DataSourceError as e:
                errors.append(str(e))
                continue
            land(kind, start, text)
            done.append({"kind": kind, "season": start, "downloaded_at": datetime.now(UTC).isoformat(), "row_count": max(0, sum(1 for _ in csv.reader(io.StringIO(text))) - 1), "source_url": url})
    return done, errors
