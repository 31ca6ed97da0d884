"""Estimators on Spark ML: forest baselines, ensembles over splits, calibrated and conformal classifiers and regressors.

Inputs have row_id, features (an array of doubles or a vector) and y. Members are fitted as Spark jobs over the whole training side; what reaches
the driver are fitted models and calibration curves on pooled scores.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.functions.shared import checkpoint
from retort.operators import conformal, splits, stats
from retort.operators.numbering import quantiles
from retort.plans.plan import Plan, Step


def with_vector(df: DataFrame) -> DataFrame:
    return df if df.schema["features"].dataType.typeName() == "vectorudt" or "Vector" in str(df.schema["features"].dataType) else df.withColumn("features", array_to_vector("features"))


def rf_classifier(n_trees: int = 500, seed: int = 42, **kw) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=n_trees, featureSubsetStrategy="log2", seed=seed, **kw)


def rf_regressor(n_trees: int = 500, seed: int = 42, **kw) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=n_trees, featureSubsetStrategy="log2", seed=seed, **kw)


#: Descriptors and counted circular fingerprints side by side.
BASELINE_PLAN = Plan(Step.of("read", "auto"), (), (Step.of("features", "concat", parts=[["descriptors", {}], ["morgan", {"n_bits": 2048, "radius": 2, "counted": True}]]),))


@dataclass
class Baseline:
    """Molecules -> features -> columns that vary -> forest. Rows that cannot be read get the fill value, if there is one."""

    classifier: bool = True
    n_trees: int = 500
    seed: int = 42
    fill: float | None = None
    error_handling: bool = False
    keep: list[int] = field(default_factory=list)
    model: Model | None = None

    def _features(self, df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        return BASELINE_PLAN.apply(df, keep=keep).where("err IS NULL").drop("err")

    def fit(self, df: DataFrame) -> Baseline:
        d = self._features(df, ("y",))
        var = d.select("row_id", F.posexplode("features").alias("i", "v")).groupBy("i").agg(F.var_pop("v").alias("s")).where("s > 0")
        self.keep = sorted(r.i for r in var.select("i").collect())  # at most one number a feature
        make = rf_classifier if self.classifier else rf_regressor
        self.model = make(self.n_trees, self.seed).fit(with_vector(self._cut(d)))
        return self

    def _cut(self, d: DataFrame) -> DataFrame:
        at = F.array(*[F.lit(i) for i in self.keep])
        return d.withColumn("features", F.transform(at, lambda i: F.get("features", i)))

    def predict(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("not fitted")
        p = self.model.transform(with_vector(self._cut(self._features(df, ())))).select("row_id", "prediction")
        return df.select("row_id").join(p, "row_id", "left").withColumn("prediction", F.coalesce("prediction", F.lit(self.fill))) if self.error_handling else p


@dataclass
class Ensemble:
    """Clones of an estimator, one a split; mean and spread, or a vote."""

    make: Callable[[int], Estimator]
    n_members: int = 10
    sampler: Callable[[DataFrame], DataFrame] | None = None
    seed: int = 42
    models: list[Model] = field(default_factory=list)

    def fit(self, df: DataFrame) -> Ensemble:
        d = with_vector(df).cache()
        s = self.sampler(d.select("row_id")) if self.sampler else splits.bootstrap(d.select("row_id"), self.n_members, seed=self.seed)
        # rows meet their draws once, for all members
        drawn = d.join(s.where("role = 'train'").select("row_id", F.col("split_id").alias("_split")), "row_id").cache()
        ids = sorted(r._split for r in drawn.select("_split").distinct().collect())
        self.models = [self.make(self.seed + i).fit(drawn.where(F.col("_split") == i).drop("_split")) for i in ids]
        drawn.unpersist(), d.unpersist()
        return self

    def members(self, df: DataFrame) -> DataFrame:
        if not self.models:
            raise ValueError("not fitted")
        out = None
        for k, m in enumerate(self.models):
            p = m.transform(with_vector(df))
            p = p.select("row_id", F.lit(k).alias("member"), F.col("prediction").alias("y"), (vector_to_array("probability") if "probability" in p.columns else F.array().cast("array<double>")).alias("proba"))
            out = p if out is None else out.union(p)
        return out

    def predict_mean(self, df: DataFrame) -> DataFrame:
        return stats.ensemble_mean(self.members(df))

    def predict_hard(self, df: DataFrame) -> DataFrame:
        return stats.hard_vote(self.members(df))

    def predict_soft(self, df: DataFrame, classes: list) -> DataFrame:
        return stats.soft_vote(self.members(df), classes)


@dataclass
class Calibrated:
    """A binary classifier whose probabilities are calibrated on held-out folds: sigmoid, isotonic, or temperature.

    class_weight 'balanced' weighs the calibration rows. ensemble: one pair of model and calibrator a fold, averaged; else one calibrator on all
    out-of-fold scores and one model on all rows.
    """

    make: Callable[[int], Estimator]
    method: str = "sigmoid"
    n_folds: int = 5
    ensemble: bool = True
    class_weight: str | None = None
    seed: int = 42
    pairs: list[tuple[Model, Callable[[Column], Column]]] = field(default_factory=list)

    def _score(self, m: Model, df: DataFrame) -> DataFrame:
        p = vector_to_array(F.col("probability"))
        p1 = F.least(F.greatest(F.get(p, F.lit(1)), F.lit(1e-9)), F.lit(1 - 1e-9))
        return m.transform(df).withColumn("score", F.log(p1 / (1 - p1)))

    def _calibrator(self, scored: DataFrame) -> Callable[[Column], Column]:
        d = scored.select("score", "y")
        d = d.join(F.broadcast(stats.balanced_weights(d, "y")), "y") if self.class_weight == "balanced" else d.withColumn("weight", F.lit(1.0))
        if self.method == "sigmoid":
            lr = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight").fit(d.withColumn("x", array_to_vector(F.array("score"))))
            a, b = float(lr.coefficients[0]), float(lr.intercept)
            return lambda s: 1 / (1 + F.exp(-(s * a + b)))
        if self.method == "temperature":
            if self.class_weight:
                import warnings

                warnings.warn("temperature scaling takes no class weights", stacklevel=2)
            grid = [2 ** (k / 4) for k in range(-16, 17)]
            loss = d.agg(*[F.avg(F.log1p(F.exp(-F.when(F.col("y") == 1, F.col("score")).otherwise(-F.col("score")) / t))).alias(f"t{i}") for i, t in enumerate(grid)]).first()
            t = min(zip(loss, grid))[1]
            return lambda s: 1 / (1 + F.exp(-s / t))
        if self.method == "isotonic":
            m = IsotonicRegression(featuresCol="score", labelCol="y", weightCol="weight").fit(d)
            xs, ys = m.boundaries.toArray().tolist(), m.predictions.toArray().tolist()

            def curve(s: Column) -> Column:
                out = F.lit(ys[0])
                for x0, y0, x1, y1 in zip(xs, ys, xs[1:], ys[1:]):
                    out = F.when(s >= x1, y1).when(s > x0, y0 + (y1 - y0) * (s - x0) / max(x1 - x0, 1e-300)).otherwise(out) if x1 > x0 else out
                return out

            return curve
        raise ValueError(f"unknown method {self.method!r}")

    def fit(self, df: DataFrame) -> Calibrated:
        if self.method not in ("sigmoid", "isotonic", "temperature"):
            raise ValueError(f"unknown method {self.method!r}")
        if df.groupBy("y").count().where(F.col("count") < self.n_folds).count():
            raise ValueError("a class has fewer rows than folds")
        d = with_vector(df)
        d = d.join(splits.stratified_folds(d.select("row_id", F.col("y").alias("stratum")), self.n_folds, self.seed).select("row_id", "fold"), "row_id").cache()
        models = [self.make(self.seed + k).fit(d.where(F.col("fold") != k)) for k in range(self.n_folds)]
        scored = [self._score(m, d.where(F.col("fold") == k)) for k, m in enumerate(models)]
        if self.ensemble:
            self.pairs = [(m, self._calibrator(s)) for m, s in zip(models, scored)]
        else:
            every = scored[0].select("score", "y")
            for s in scored[1:]:
                every = every.union(s.select("score", "y"))
            self.pairs = [(self.make(self.seed).fit(d), self._calibrator(every))]
        d.unpersist()
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """row_id, p: the probability of class 1."""
        out = None
        for m, f in self.pairs:
            p = self._score(m, with_vector(df)).select("row_id", f(F.col("score")).alias("p"))
            out = p if out is None else out.union(p)
        if out is None:
            raise ValueError("not fitted")
        return out.groupBy("row_id").agg(F.avg("p").alias("p"))


@dataclass
class ConformalClassifier:
    """Split conformal prediction around a fitted or fittable classifier of classes 0..k-1."""

    estimator: Estimator | Model
    n_classes: int = 2
    mondrian: bool = False
    nonconformity: str = "hinge"
    model: Model | None = None
    cal: DataFrame | None = None

    def fit(self, df: DataFrame) -> ConformalClassifier:
        self.model = self.estimator.fit(with_vector(df)) if isinstance(self.estimator, Estimator) else self.estimator
        return self

    def _scores(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("not fitted")
        p = self.model.transform(with_vector(df)).withColumn("proba", vector_to_array("probability"))
        return conformal.class_scores(p, self.nonconformity, self.n_classes)

    def calibrate(self, df: DataFrame) -> ConformalClassifier:
        self.cal = self._scores(df).select(F.col("y").cast("int").alias("label"), F.get("scores", F.col("y").cast("int")).alias("score"))
        return self

    def predict_p(self, df: DataFrame) -> DataFrame:
        if self.cal is None:
            raise ValueError("not calibrated")
        return conformal.p_values(self.cal, self._scores(df).select("row_id", F.posexplode("scores").alias("label", "score")), self.mondrian)

    def predict_set(self, df: DataFrame, confidence: float = 0.9) -> DataFrame:
        return conformal.prediction_sets(self.predict_p(df), confidence)

    def evaluate(self, df: DataFrame, confidence: float = 0.9) -> DataFrame:
        return conformal.evaluate_sets(self.predict_set(df, confidence), df.select("row_id", F.col("y").cast("int").alias("label")))


@dataclass
class CrossConformalClassifier:
    """A conformal classifier a fold; the median of their p-values."""

    make: Callable[[int], Estimator]
    n_classes: int = 2
    n_folds: int = 5
    mondrian: bool = False
    nonconformity: str = "hinge"
    seed: int = 42
    parts: list[ConformalClassifier] = field(default_factory=list)

    def fit(self, df: DataFrame) -> CrossConformalClassifier:
        d = with_vector(df)
        d = d.join(splits.stratified_folds(d.select("row_id", F.col("y").alias("stratum")), self.n_folds, self.seed).select("row_id", "fold"), "row_id")
        d = checkpoint(d)  # every fold fits and calibrates on it
        self.parts = [
            ConformalClassifier(self.make(self.seed + k), self.n_classes, self.mondrian, self.nonconformity).fit(d.where(F.col("fold") != k)).calibrate(d.where(F.col("fold") == k)) for k in range(self.n_folds)
        ]
        return self

    def predict_p(self, df: DataFrame) -> DataFrame:
        out = None
        for k, c in enumerate(self.parts):
            p = c.predict_p(df).withColumn("fold", F.lit(k))
            out = p if out is None else out.union(p)
        return conformal.cross_p_values(out)

    def predict_set(self, df: DataFrame, confidence: float = 0.9) -> DataFrame:
        return conformal.prediction_sets(self.predict_p(df), confidence)


@dataclass
class ConformalRegressor:
    """Split conformal intervals around a regressor; mondrian by bins of the prediction."""

    estimator: Estimator
    n_bins: int = 0
    model: Model | None = None
    cal: DataFrame | None = None
    edges: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame) -> ConformalRegressor:
        self.model = self.estimator.fit(with_vector(df))
        return self

    def _pred(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("not fitted")
        p = self.model.transform(with_vector(df)).withColumnRenamed("prediction", "pred")
        b = F.lit(0)
        for e in self.edges:
            b = b + (F.col("pred") > e).cast("int")
        return p.withColumn("bin", b)

    def calibrate(self, df: DataFrame) -> ConformalRegressor:
        if self.n_bins > 1:
            self.edges = quantiles(self._pred(df), "pred", [i / self.n_bins for i in range(1, self.n_bins)])
        self.cal = self._pred(df).select("y", "pred", "bin")
        return self

    def predict_int(self, df: DataFrame, confidence: float = 0.9) -> DataFrame:
        if self.cal is None:
            raise ValueError("not calibrated")
        return conformal.intervals(self.cal, self._pred(df), confidence, bool(self.edges))


@dataclass
class CrossConformalRegressor:
    """A conformal regressor a fold, folds stratified by percentiles of y; the mean of their bounds."""

    make: Callable[[int], Estimator]
    n_folds: int = 5
    n_bins: int = 0
    n_groups: int = 10
    seed: int = 42
    parts: list[ConformalRegressor] = field(default_factory=list)

    def fit(self, df: DataFrame) -> CrossConformalRegressor:
        d = with_vector(df)
        folds = splits.stratified_folds(splits.percentile_bins(d.select("row_id", "y"), self.n_groups), self.n_folds, self.seed)
        d = checkpoint(d.join(folds.select("row_id", "fold"), "row_id"))  # every fold fits and calibrates on it
        self.parts = [ConformalRegressor(self.make(self.seed + k), self.n_bins).fit(d.where(F.col("fold") != k)).calibrate(d.where(F.col("fold") == k)) for k in range(self.n_folds)]
        return self

    def predict_int(self, df: DataFrame, confidence: float = 0.9) -> DataFrame:
        out = None
        for k, c in enumerate(self.parts):
            p = c.predict_int(df, confidence).withColumn("fold", F.lit(k))
            out = p if out is None else out.union(p)
        if out is None:
            raise ValueError("not fitted")
        return conformal.cross_intervals(out)


#: Sign bits of the first components, the features of the queries below; few enough that SQL replays a naive Bayes fit.
N_SIGNS = 4


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    signs = F.transform(F.slice("embedding", 1, N_SIGNS), lambda v: (v > 0).cast("double"))
    return e.select(F.col("vec_id").alias("row_id"), signs.alias("features"), (F.col("label") % 2).cast("double").alias("y"))


def _bayes(_: int = 0) -> NaiveBayes:
    return NaiveBayes(featuresCol="features", labelCol="y", modelType="bernoulli", smoothing=1.0)


def _parts(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return e.where("row_id % 4 > 1"), e.where("row_id % 4 = 1"), e.where("row_id % 4 = 0")


def q_ensemble_vote(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    m = Ensemble(_bayes, 3).fit(e.where("row_id % 4 <> 0"))
    test = e.where("row_id % 4 = 0")
    return m.predict_hard(test).withColumnRenamed("y", "hard").join(m.predict_soft(test, [0.0, 1.0]).withColumnRenamed("y", "soft"), "row_id")


def q_calibrated(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    p = Calibrated(_bayes, "isotonic", 3, ensemble=False).fit(e.where("row_id % 4 <> 0")).predict_proba(e.where("row_id % 4 = 0"))
    return p.select("row_id", F.round("p", 5).alias("p"))


def q_conformal_classifier(spark, sf_dir):
    fit, cal, test = _parts(spark, sf_dir)
    p = ConformalClassifier(_bayes()).fit(fit).calibrate(cal).predict_p(test)
    return p.select("row_id", F.col("label").cast("long").alias("label"), F.round("p", 6).alias("p"))


def q_conformal_evaluated(spark, sf_dir):
    fit, cal, test = _parts(spark, sf_dir)
    out = ConformalClassifier(_bayes(), mondrian=True).fit(fit).calibrate(cal).evaluate(test, 0.8)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def q_cross_conformal(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    p = CrossConformalClassifier(_bayes, n_folds=3).fit(e.where("row_id % 4 <> 0")).predict_p(e.where("row_id % 4 = 0"))
    return p.select("row_id", F.col("label").cast("long").alias("label"), F.round("p", 6).alias("p"))


def _orders(spark, sf_dir):
    """Price by the day of the order, one number as the only feature."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    return o.select(F.col("o_orderkey").alias("row_id"), F.array(day).alias("features"), F.col("o_totalprice").cast("double").alias("y"))


def _line(_: int = 0) -> LinearRegression:
    return LinearRegression(featuresCol="features", labelCol="y", solver="normal")


def _rounded(iv: DataFrame) -> DataFrame:
    return iv.select("row_id", F.round("lo", 2).alias("lo"), F.round("hi", 2).alias("hi"))


def q_conformal_regressor(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return _rounded(ConformalRegressor(_line()).fit(o.where("row_id % 4 > 1")).calibrate(o.where("row_id % 4 = 1")).predict_int(o.where("row_id % 4 = 0"), 0.9))


def q_conformal_regressor_evaluated(spark, sf_dir):
    o = _orders(spark, sf_dir)
    iv = ConformalRegressor(_line()).fit(o.where("row_id % 4 > 1")).calibrate(o.where("row_id % 4 = 1")).predict_int(o.where("row_id % 4 = 0"), 0.9)
    out = conformal.evaluate_intervals(iv, o.select("row_id", "y"))
    return out.select(*[F.round(c, 3).alias(c) for c in out.columns])


def q_cross_conformal_regressor(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return _rounded(CrossConformalRegressor(_line, n_folds=3, n_groups=5).fit(o.where("row_id % 4 <> 0")).predict_int(o.where("row_id % 4 = 0"), 0.9))


def q_ensemble_regression(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return Ensemble(_line, 3).fit(o.where("row_id % 4 <> 0")).predict_mean(o.where("row_id % 4 = 0")).select("row_id", F.round("mean", 2).alias("mean"), F.round("std", 2).alias("std"))


QUERIES = {
    "ensemble_vote": q_ensemble_vote, "calibrated_classifier": q_calibrated, "conformal_classifier": q_conformal_classifier, "conformal_classifier_evaluated": q_conformal_evaluated, "cross_conformal_classifier": q_cross_conformal,
    "conformal_regressor": q_conformal_regressor, "conformal_regressor_evaluated": q_conformal_regressor_evaluated, "cross_conformal_regressor": q_cross_conformal_regressor, "ensemble_regression": q_ensemble_regression,
}

_H = splits._H
_E = f"WITH e AS (SELECT vec_id AS row_id, label % 2 AS y, [{', '.join(f'(embedding[{i + 1}] > 0)::INT' for i in range(N_SIGNS))}] AS x FROM embeddings), "


def _bayes_sql(train: str, rows: str) -> str:
    """CTEs: b (m, y, x... fitted by member m of train), s (m, row_id, truth, p1) over rows (m, row_id, y, x)."""
    bits = range(1, N_SIGNS + 1)
    each = " + ".join(f"CASE WHEN r.x[{i}] = 1 THEN ln(c{i} + 1) - ln(n + 2) ELSE ln(1 - (c{i} + 1) / (n + 2)) END" for i in bits)
    return (
        f"b AS (SELECT m, y, count(*)::DOUBLE AS n, {', '.join(f'sum(x[{i}])::DOUBLE AS c{i}' for i in bits)} FROM ({train}) GROUP BY m, y), t AS (SELECT m, sum(n) AS total FROM b GROUP BY m), "
        f"j AS (SELECT r.m, r.row_id, r.y AS truth, b.y, exp(ln(n + 1) - ln(total + 2) + {each}) AS v FROM ({rows}) r JOIN b ON b.m = r.m JOIN t ON t.m = r.m), "
        "s AS (SELECT m, row_id, truth, sum(v) FILTER (y = 1) / sum(v) AS p1 FROM j GROUP BY m, row_id, truth)"
    )


def _drawn(table: str, members: int) -> str:
    """Bootstrap draws of the rows not divisible by four: m, and the columns of the table."""
    at = _H.format("'42:' || m || ':' || pos")
    return f"""SELECT m, d.* FROM (SELECT m, CAST(floor({at} * n / 4294967296) AS BIGINT) AS i FROM (SELECT count(*) AS n FROM {table} WHERE row_id % 4 <> 0), range({members}) a(m), range((SELECT count(*) FROM {table} WHERE row_id % 4 <> 0)) c(pos))
        JOIN (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS i FROM {table} WHERE row_id % 4 <> 0) d USING (i)"""


_FOLDS = f"f AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY {_H.format(chr(39) + '42:' + chr(39) + ' || row_id')}, row_id) - 1) % 3 AS fold FROM e WHERE row_id % 4 <> 0), "
_OTHER_FOLDS = "SELECT m, f.* FROM f, range(3) a(m) WHERE fold <> m"
_P1 = "CASE label WHEN 1 THEN 1 - p1 ELSE p1 END"
_CLASSES = "(SELECT unnest([0, 1]) AS label)"
_ONE_SPLIT = _E + _bayes_sql("SELECT 0 AS m, * FROM e WHERE row_id % 4 > 1", "SELECT 0 AS m, * FROM e WHERE row_id % 4 < 2") + f""", k AS (SELECT truth AS label, {_P1.replace('label', 'truth')} AS score FROM s WHERE row_id % 4 = 1),
q AS (SELECT row_id, truth, label, {_P1} AS score FROM s, {_CLASSES} WHERE row_id % 4 = 0) """
_P_VALUE = "((SELECT count(*) FROM k WHERE k.score >= q.score - 1e-12{0}) + 1) / ((SELECT count(*) FROM k WHERE true{0}) + 1)"
_DAYS = "WITH e AS (SELECT o_orderkey AS row_id, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x, CAST(o_totalprice AS DOUBLE) AS y FROM orders), "
_REGRESSOR = _DAYS + """l AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM e WHERE row_id % 4 > 1), p AS (SELECT row_id, y, b + a * x AS pred FROM e, l WHERE row_id % 4 < 2),
r AS (SELECT abs(y - pred) AS r, row_number() OVER (ORDER BY abs(y - pred) DESC) AS i, count(*) OVER () AS n FROM p WHERE row_id % 4 = 1), q AS (SELECT r AS q FROM r WHERE i = floor((1 - 0.9::DOUBLE) * (n + 1) + 1e-12)),
v AS (SELECT row_id, y, pred - q AS lo, pred + q AS hi FROM p, q WHERE row_id % 4 = 0) """
ORACLE_SQL = {
    "ensemble_vote": _E + _bayes_sql(_drawn("e", 3), "SELECT m, e.* FROM e, range(3) a(m) WHERE row_id % 4 = 0")
    + " SELECT row_id, CASE WHEN sum((p1 > 0.5)::INT) >= 2 THEN 1.0 ELSE 0.0 END AS hard, CASE WHEN avg(p1) > 0.5 THEN 1.0 ELSE 0.0 END AS soft FROM s GROUP BY row_id",
    "conformal_classifier": _ONE_SPLIT + f"SELECT row_id, label, round({_P_VALUE.format('')}, 6) AS p FROM q",
    "conformal_classifier_evaluated": _ONE_SPLIT + f", v AS (SELECT row_id, truth, label, {_P_VALUE.format(' AND k.label = q.label')} >= 1 - 0.8::DOUBLE AS member FROM q), "
    "w AS (SELECT row_id, count(*) FILTER (member) AS size, count(*) FILTER (member AND label = truth) AS hit FROM v GROUP BY row_id) "
    "SELECT round(avg((hit = 0)::INT), 6) AS error, round(avg(size), 6) AS avg_c, round(avg((size = 1)::INT), 6) AS one_c, round(avg((size = 0)::INT), 6) AS empty FROM w",
    "cross_conformal_classifier": _E + _FOLDS + _bayes_sql(_OTHER_FOLDS, "SELECT fold AS m, row_id, y, x FROM f UNION ALL SELECT m, row_id, y, x FROM e, range(3) a(m) WHERE row_id % 4 = 0")
    + f", k AS (SELECT m, {_P1.replace('label', 'truth')} AS score FROM s WHERE row_id % 4 <> 0), q AS (SELECT m, row_id, label, {_P1} AS score FROM s, {_CLASSES} WHERE row_id % 4 = 0) "
    f"SELECT row_id, label, round(quantile_cont({_P_VALUE.format(' AND k.m = q.m')}, 0.5), 6) AS p FROM q GROUP BY row_id, label",
    # isotonic regression of the out-of-fold scores by its max-min formula, linear between the scores; the model of all rows is member 3
    "calibrated_classifier": _E + _FOLDS + _bayes_sql(_OTHER_FOLDS + " UNION ALL SELECT 3 AS m, *, 0 AS fold FROM e WHERE row_id % 4 <> 0", "SELECT fold AS m, row_id, y, x FROM f UNION ALL SELECT 3, row_id, y, x FROM e WHERE row_id % 4 = 0")
    + """, o AS (SELECT round(ln(p1 / (1 - p1)), 9) AS x, avg(truth) AS y, count(*) AS w FROM s WHERE m < 3 GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY x) AS i FROM o),
    g AS (SELECT a.i AS lo, b.i AS hi, sum(c.y * c.w) / sum(c.w) AS g FROM i a JOIN i b ON a.i <= b.i JOIN i c ON c.i BETWEEN a.i AND b.i GROUP BY 1, 2),
    h AS (SELECT i.i, lo, min(g) AS g FROM i JOIN g ON lo <= i.i AND hi >= i.i GROUP BY 1, 2), z AS (SELECT i.i, i.x, max(g) AS y FROM i JOIN h USING (i) GROUP BY 1, 2),
    u AS (SELECT row_id, round(ln(p1 / (1 - p1)), 9) AS x FROM s WHERE m = 3)
    SELECT row_id, round(CASE WHEN lo.x IS NULL THEN hi.y WHEN hi.x IS NULL OR hi.x = lo.x THEN lo.y ELSE lo.y + (hi.y - lo.y) * (u.x - lo.x) / (hi.x - lo.x) END, 5) AS p
    FROM u LEFT JOIN z lo ON lo.i = (SELECT max(i) FROM z WHERE z.x <= u.x) LEFT JOIN z hi ON hi.i = (SELECT min(i) FROM z WHERE z.x >= u.x)""",
    "conformal_regressor": _REGRESSOR + "SELECT row_id, round(lo, 2) AS lo, round(hi, 2) AS hi FROM v",
    "conformal_regressor_evaluated": _REGRESSOR + "SELECT round(avg((y < lo OR y > hi)::INT), 3) AS error, round(avg(hi - lo), 3) AS eff_mean, round(median(hi - lo), 3) AS eff_med FROM v",
    "cross_conformal_regressor": _DAYS + f"""c AS (SELECT quantile_cont(y, [0.2, 0.4, 0.6, 0.8]) AS c FROM e WHERE row_id % 4 <> 0), g AS (SELECT e.*, len(list_filter(c, lambda v: y > v)) AS stratum FROM e, c WHERE row_id % 4 <> 0),
    f AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY {_H.format("'42:' || row_id")}, row_id) - 1) % 3 AS fold FROM g), l AS (SELECT m, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM f, range(3) t(m) WHERE fold <> m GROUP BY m),
    r AS (SELECT m, abs(y - b - a * x) AS r, row_number() OVER (PARTITION BY m ORDER BY abs(y - b - a * x) DESC) AS i, count(*) OVER (PARTITION BY m) AS n FROM f JOIN l ON fold = m),
    q AS (SELECT m, r AS q FROM r WHERE i = floor((1 - 0.9::DOUBLE) * (n + 1) + 1e-12))
    SELECT row_id, round(avg(b + a * x - q), 2) AS lo, round(avg(b + a * x + q), 2) AS hi FROM e, l JOIN q USING (m) WHERE row_id % 4 = 0 GROUP BY row_id""",
    "ensemble_regression": _DAYS + f"l AS (SELECT m, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM ({_drawn('e', 3)}) GROUP BY m) SELECT row_id, round(avg(b + a * x), 2) AS mean, round(stddev_pop(b + a * x), 2) AS std FROM e, l WHERE row_id % 4 = 0 GROUP BY row_id",
}
