"""Model versions and published predictions on disk: small documents as JSON, tables as Parquet, classifiers as Spark ML writes them."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.ml import classification
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ensemble, predict
from ..sources import files, sinks
from .models import Fitted, Preparation
from .pipelines import Trained
from .score_fit import ScoreModel
from .trees import TreesModel


def write_document(spark: SparkSession, doc: dict, path: str, overwrite: bool = False) -> None:
    """One JSON document; an existing one stays unless ``overwrite``."""
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "error").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def versions(spark: SparkSession, root: str) -> DataFrame:
    """(path, version) of the model versions under ``root`` that are complete: those with a card."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{root}/model_v*/card").select("path")
    except AnalysisException:
        return spark.createDataFrame([], "path string, version int")
    path = F.regexp_extract("path", r"^(.*model_v\d+)/", 1)
    return files.select(path.alias("path"), F.regexp_extract(path, r"(\d+)$", 1).cast("int").alias("version")).distinct()


def next_path(spark: SparkSession, root: str) -> tuple[str, str | None]:
    """(path of the next version, path of the newest one or None)."""
    r = predict.latest_version(versions(spark, root)).first()
    return f"{root}/model_v{r['next_version']:03d}", r["path"]


def save(spark: SparkSession, trained: Trained, path: str, rows: dict[str, int] | None = None) -> None:
    """A version under ``path``, its card last; an existing version is never overwritten."""
    kinds = {}
    for name, f in trained.classifiers.items():
        f.model.write().save(f"{path}/classifiers/{name}")
        p = f.preparation
        kinds[name] = {"kind": type(f.model).__name__, "scaled": f.scaled, "columns": p.columns, "median": p.median, "mean": p.mean, "deviation": p.deviation}
    s = trained.scores
    s.teams(spark).write.parquet(f"{path}/score_teams")
    trained.reports.write.parquet(f"{path}/reports")
    weights = {r["model"]: r["weight"] for r in trained.weights.collect()}  # a row a model
    write_document(spark, {"columns": trained.columns, "classifiers": kinds, "scores": {"advantage": s.advantage, "base": s.base, "rho": s.rho}, "weights": weights, "slope": trained.platt.slope, "intercept": trained.platt.intercept, "rows": rows or {}}, f"{path}/parameters")
    reports = [r.asDict() for r in trained.reports.orderBy("log_loss").collect()]
    write_document(spark, {"card": sinks.model_card(path.rsplit("model_", 1)[-1], rows or {}, reports)}, f"{path}/card")


def load(spark: SparkSession, path: str) -> Trained:
    """The version that ``save`` wrote under ``path``."""
    doc = read_document(spark, f"{path}/parameters")
    fitted = {}
    for name, k in doc["classifiers"].items():
        kind = TreesModel if k["kind"] == TreesModel.__name__ else getattr(classification, k["kind"])
        model = kind.load(f"{path}/classifiers/{name}")
        fitted[name] = Fitted(name, model, Preparation(k["columns"], k["median"], k["mean"], k["deviation"]), k["scaled"])
    teams = spark.read.parquet(f"{path}/score_teams").collect()  # as many as the fit had on the driver
    scores = ScoreModel({t["team"]: t["attack"] for t in teams}, {t["team"]: t["defence"] for t in teams}, **doc["scores"])
    weights = spark.createDataFrame(sorted(doc["weights"].items()), "model string, weight double")
    return Trained(doc["columns"], fitted, scores, weights, ensemble.Platt(tuple(doc["slope"]), tuple(doc["intercept"])), spark.read.parquet(f"{path}/reports"))


def publish(documents: DataFrame, root: str, season: int, round_number: int, made: datetime) -> str:
    """Writes a round's documents and their flat rows, then points to them; returns the documents' path.

    The pointer is one file, replaced in one step when all else is written: a reader finds the old round or the new one.
    """
    spark = documents.sparkSession
    stamp = f"{made:%Y%m%d_%H%M%S}"
    name = f"predictions_{season}_R{round_number}_{stamp}"
    path = f"{root}/{name}.json"
    sinks.write_documents(documents, path)
    sinks.write_csv(predict.flat(spark.read.schema(documents.schema).json(path)), f"{root}/flat/{name}.csv")
    files.write_text(spark, f"{root}/latest.json", json.dumps({"season": season, "round": round_number, "prediction_time": stamp, "source": path}))
    return path


def latest(spark: SparkSession, root: str) -> tuple[dict, DataFrame]:
    """(what the latest pointer says, the documents it points to)."""
    said = json.loads("".join(files.lines(spark, f"{root}/latest.json")))
    return said, spark.read.json(said["source"])
