"""Plans with fitted parts: scaled features, an estimator, steps after prediction; saved and loaded as a folder.

Fitting is aggregation (one pass for all moments) and Spark ML; predicting is projection. A row that fails keeps its row_id and takes the fill
value, if there is one.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.plans.plan import Plan


def _clip(y: Column, lo: float | None, hi: float | None) -> Column:
    y = y if lo is None else F.greatest(y, F.lit(float(lo)))
    return y if hi is None else F.least(y, F.lit(float(hi)))


#: Steps after prediction: name -> factory of Column -> Column.
POST: dict[str, Callable[..., Callable[[Column], Column]]] = {
    "clip": lambda lo=None, hi=None: lambda y: _clip(y, lo, hi),
    "round": lambda digits=0: lambda y: F.round(y, digits),
    "threshold": lambda at=0.5: lambda y: (y >= at).cast("double"),
    "scale": lambda factor=1.0, shift=0.0: lambda y: y * factor + shift,
    "log10": lambda: lambda y: F.log10(y),
}


def array_moments(df: DataFrame, col: str) -> list[tuple[float, float]]:
    """By position the mean and the population standard deviation (1 where nothing varies); one row a position comes to the driver."""
    d = df.select(F.posexplode(col).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return [(r.m, r.s or 1.0) for r in d.orderBy("i").collect()]


def scale_array(col: str, moments: list[tuple[float, float]]) -> Column:
    m, s = (F.array(*[F.lit(float(x)) for x in xs]) for xs in zip(*moments))
    return F.zip_with(F.zip_with(col, m, lambda x, y: x - y), s, lambda x, y: x / y)


@dataclass
class Pipeline:
    """plan: its vector outputs, one after the other, are the features. scaled: names of outputs to standardise. post: (step, params) in order."""

    plan: Plan
    scaled: tuple[str, ...] = ()
    estimator: Estimator | None = None
    post: tuple[tuple[str, dict], ...] = ()
    fill: float | None = None
    reinsert: bool = True
    moments: dict[str, list[tuple[float, float]]] = field(default_factory=dict)
    model: Model | None = None
    fitted: bool = False

    def __post_init__(self) -> None:
        names = [s.name for s in self.plan.outputs]
        if unknown := [n for n in self.scaled if n not in names]:
            raise ValueError(f"no such outputs: {unknown}")
        if unknown := [n for n, _ in self.post if n not in POST]:
            raise ValueError(f"unknown steps after prediction: {unknown}; known: {sorted(POST)}")

    def _read(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        return self.plan.apply(df, keep=keep).where("err IS NULL").drop("err")

    def _features(self, d: DataFrame) -> DataFrame:
        parts = [scale_array(s.name, self.moments[s.name]) if s.name in self.scaled else F.col(s.name) for s in self.plan.outputs]
        parts = [p if "array" in d.schema[s.name].dataType.simpleString() else F.array(p.cast("double")) for p, s in zip(parts, self.plan.outputs)]
        return d.withColumn("features", F.concat(*parts)).drop(*[s.name for s in self.plan.outputs])

    def fit(self, df: DataFrame) -> Pipeline:
        """df: row_id, input and, for an estimator, y. Rows that fail are left out. Gives a fitted pipeline; this one stays as it is."""
        d = self._read(df, ("y",) if self.estimator else ())
        out = replace(self, moments={n: array_moments(d, n) for n in self.scaled}, fitted=True)
        if self.estimator:
            out.model = self.estimator.fit(out._features(d).withColumn("features", array_to_vector("features")))
        return out

    def _check(self) -> None:
        if not self.fitted and (self.scaled or self.estimator):
            raise ValueError("not fitted")

    def transform(self, df: DataFrame) -> DataFrame:
        """-> row_id, features, of the rows that do not fail."""
        self._check()
        return self._features(self._read(df)).select("row_id", "features")

    def predict(self, df: DataFrame) -> DataFrame:
        """-> row_id, prediction, of every row, or of those that do not fail."""
        if self.model is None:
            raise ValueError("no fitted model")
        p = self.model.transform(self.transform(df).withColumn("features", array_to_vector("features")))
        y = F.col("prediction")
        for name, params in self.post:
            y = POST[name](**params)(y)
        p = p.select("row_id", y.alias("prediction"), F.lit(True).alias("there"))
        if not self.reinsert:
            return p.drop("there")
        out = df.select("row_id").join(p, "row_id", "left")
        return out.select("row_id", F.when(F.col("there"), F.col("prediction")).otherwise(F.lit(self.fill).cast("double")).alias("prediction"))

    def save(self, spark: SparkSession, folder: str) -> None:
        """Into a folder that all executors see: the plan, the moments and the steps as JSON, the model as Spark ML writes it."""
        state = {"plan": self.plan.to_json(), "scaled": self.scaled, "post": self.post, "fill": self.fill, "reinsert": self.reinsert, "moments": self.moments, "fitted": self.fitted, "model": self.model is not None}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/state")
        if self.model is not None:
            self.model.write().overwrite().save(f"{folder}/model")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Pipeline:
        s = json.loads(spark.read.text(f"{folder}/state").first().value)
        out = Pipeline(Plan.from_json(s["plan"]), tuple(s["scaled"]), None, tuple((n, p) for n, p in s["post"]), s["fill"], s["reinsert"], {k: [tuple(x) for x in v] for k, v in s["moments"].items()}, None, s["fitted"])
        if s["model"]:
            out.model = DefaultParamsReader.loadParamsInstance(f"{folder}/model", spark.sparkContext)
        return out


def fold_metrics(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """df: fold and what the metrics (aggregates) need -> metric, mean, std (population) over the folds."""
    each = df.groupBy("fold").agg(*[c.alias(n) for n, c in metrics.items()])
    long = each.select(F.explode(F.create_map(*[x for n in metrics for x in (F.lit(n), F.col(n).cast("double"))])).alias("metric", "v"))
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
