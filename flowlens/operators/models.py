"""Trained detectors with Spark ML.

* routine: StandardScaler + GBTClassifier (400 trees, depth 7, step 0.05,
  row and feature subsampling 0.9, class weight ``scale_pos_weight``);
  :func:`~flowlens.operators.boosting.train_boosted` is the second-order form with an L2 term and columns drawn for each tree;
* anomaly: min-max scaling + PCA bottleneck of 12; the score is the mean
  squared reconstruction error of the centred vector;
  ``train_autoencoder`` is the non-linear form: a bottleneck network that
  starts from those components;
* context: attention over the window's rows in their order
  (``train_attention``, networks trained by gradients summed over partitions);
  pooled sequence features (mean / std / max / last per feature) into a
  multilayer perceptron are the plainer form;
* forest (legacy): mean imputation from the training fold, min-max,
  RandomForest with 100 trees.

Models are saved as Spark ML pipelines or rows of parameters; :func:`load_detectors` falls back to
the normal-profile surrogates when a model is absent.
"""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, MinMaxScaler, PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FEATURES, LABEL
from ..session import materialised
from ..settings import DEFAULT_FLOW, DEFAULT_THRESHOLDS, FlowConfig, Thresholds
from .boosting import BoostedModel, boosted_scores
from .dataset import class_weights, stratified_split
from .evaluation import evaluate, exact_quantiles
from .networks import AttentionNet, Autoencoder, fit_network, predict_column
from .scoring import score_flows
from .sequences import fit_sequence_standardizer


def _proba1(df: DataFrame, col: str = "probability") -> F.Column:
    return vector_to_array(F.col(col))[1]


# -- M8 ---------------------------------------------------------------------
def train_routine(train: DataFrame, seed: int = 42, max_iter: int = 400, max_depth: int = 7) -> PipelineModel:
    w = class_weights(train).first()["scale_pos_weight"]
    data = train.withColumn("_w", F.when(F.col(LABEL) == 1, F.lit(float(w))).otherwise(F.lit(1.0)))
    gbt = GBTClassifier(featuresCol="scaled", labelCol=LABEL, weightCol="_w", maxIter=max_iter,
                        maxDepth=max_depth, stepSize=0.05, subsamplingRate=0.9, featureSubsetStrategy="0.9",
                        minInstancesPerNode=2, seed=seed)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="vec", handleInvalid="keep"),
                            StandardScaler(inputCol="vec", outputCol="scaled", withMean=True, withStd=True), gbt])
    return _fit_persisted(pipe, data.select(*FEATURES, LABEL, "_w"))


#: Rows of a task of an iterative fit, where there are fewer than the shuffle's partitions give.
FIT_ROWS = 16_384


def _fit_persisted(pipe: Pipeline, data: DataFrame) -> PipelineModel:
    """Iterative estimators scan their input once per iteration: materialise
    the (narrow) training input once, fit, release it.

    A fit is thousands of short stages with a task for each partition of its
    input, so the partitions follow the rows, not the shuffle's setting.
    """
    from pyspark import StorageLevel

    cached = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return pipe.fit(cached.coalesce(max(1, -(-cached.count() // FIT_ROWS))))
    finally:
        cached.unpersist()


def routine_scores(model: PipelineModel | BoostedModel, df: DataFrame) -> DataFrame:
    if isinstance(model, BoostedModel):
        return boosted_scores(model, df)
    out = model.transform(df)
    return out.withColumn("routine_score", _proba1(out)).drop("vec", "scaled", "rawPrediction", "probability")


def feature_importances(model: PipelineModel | BoostedModel, top: int = 12) -> DataFrame:
    """O2: the top feature importances of the boosted trees."""
    from pyspark.sql import SparkSession

    if isinstance(model, BoostedModel):
        shares = model.importances().items()
    else:
        shares = zip(FEATURES, map(float, model.stages[-1].featureImportances.toArray()))
    rows = sorted(shares, key=lambda t: (-t[1], t[0]))[:top]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")


# -- M9 ---------------------------------------------------------------------
@dataclass(frozen=True)
class AnomalyModel:
    lo: tuple[float, ...]
    span: tuple[float, ...]
    mean: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]   # k vectors of length 52
    threshold: float | None = None


def train_anomaly(flows: DataFrame, k: int = 12, percentile: float = 0.99) -> AnomalyModel:
    """Fit on normal flows: min-max scale, PCA(k) on the scaled vectors,
    threshold = percentile of the normal reconstruction error."""
    normal = flows.filter(F.col(LABEL) == 0).select(*FEATURES)
    row = normal.agg(*[F.min(f).alias(f"lo_{f}") for f in FEATURES],
                     *[(F.max(f) - F.min(f)).alias(f"sp_{f}") for f in FEATURES]).first()
    lo = tuple(float(row[f"lo_{f}"]) for f in FEATURES)
    span = tuple(float(row[f"sp_{f}"]) or 1.0 for f in FEATURES)
    scaled = normal.select(*[((F.col(f) - lo[i]) / span[i]).alias(f) for i, f in enumerate(FEATURES)])
    vec = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(scaled)
    pca = PCA(k=k, inputCol="v", outputCol="p").fit(vec)
    mean = tuple(float(x) for x in scaled.agg(*[F.avg(f) for f in FEATURES]).first())
    comps = tuple(tuple(float(x) for x in pca.pc.toArray()[:, j]) for j in range(k))
    model = AnomalyModel(lo, span, mean, comps)
    errs = reconstruction_error(flows.filter(F.col(LABEL) == 0), model)
    thr = exact_quantiles(errs, "anomaly_error", [percentile]).first()["value"]
    return AnomalyModel(lo, span, mean, comps, float(thr))


@dataclass(frozen=True)
class AutoencoderModel:
    """A trained :class:`~flowlens.operators.networks.Autoencoder` over min-max scaled, centred features."""
    lo: tuple[float, ...]
    span: tuple[float, ...]
    mean: tuple[float, ...]
    hidden: int
    bottleneck: int
    theta: tuple[float, ...]
    threshold: float | None = None

    @property
    def net(self) -> Autoencoder:
        return Autoencoder(len(FEATURES), self.hidden, self.bottleneck)


def _scaled_array(model) -> F.Column:
    return F.array(*[(F.col(f).cast("double") - model.lo[i]) / model.span[i] - model.mean[i] for i, f in enumerate(FEATURES)])


def train_autoencoder(flows: DataFrame, k: int = 12, hidden: int = 32, percentile: float = 0.99, rounds: int = 100,
                      step: float = 0.003, seed: int = 42) -> AutoencoderModel:
    """Non-linear form of :func:`train_anomaly`: fitted on normal flows from its principal components on; the threshold is
    the percentile of the network's own error on them."""
    pca = train_anomaly(flows, k, percentile)
    model = AutoencoderModel(pca.lo, pca.span, pca.mean, hidden, k, ())
    normal = flows.filter(F.col(LABEL) == 0)
    data = normal.select(_scaled_array(model).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"))
    theta = fit_network(model.net, data, rounds, step, seed, model.net.from_components(np.array(pca.components), seed))
    model = dataclasses.replace(model, theta=tuple(theta.tolist()))
    thr = exact_quantiles(reconstruction_error(normal, model), "anomaly_error", [percentile]).first()["value"]
    return dataclasses.replace(model, threshold=float(thr))


def reconstruction_error(df: DataFrame, model: AnomalyModel | AutoencoderModel) -> DataFrame:
    """Mean squared error of the reconstruction, per row (numpy per batch)."""
    if isinstance(model, AutoencoderModel):
        scaled = df.withColumn("_x", _scaled_array(model))
        return predict_column(scaled, model.net, np.array(model.theta), "_x", "anomaly_error").drop("_x")
    lo, span, mu, comps = model.lo, model.span, model.mean, model.components
    keep = [c for c in df.columns]
    schema = T.StructType(df.schema.fields + [T.StructField("anomaly_error", T.DoubleType())])

    def fn(batches):
        import numpy as np
        import pyarrow as pa

        V = np.asarray(comps).T          # 52 x k
        L, S, M = np.asarray(lo), np.asarray(span), np.asarray(mu)
        for b in batches:
            x = np.column_stack([b.column(f).to_numpy(zero_copy_only=False).astype(float) for f in FEATURES])
            xc = (x - L) / S - M
            r = xc @ V @ V.T
            err = np.mean((xc - r) ** 2, axis=1)
            yield pa.RecordBatch.from_arrays(list(b.columns) + [pa.array(err)], names=keep + ["anomaly_error"])
    return df.mapInArrow(fn, schema)


# -- M10 --------------------------------------------------------------------
def pooled_sequences(seqs: DataFrame) -> DataFrame:
    """Sequence windows -> mean / std / max / last of each feature (208 columns)."""
    cols = []
    for i, f in enumerate(FEATURES):
        xs = F.transform("window", lambda r, i=i: r[i])
        cnt = F.size("window").cast("double")
        mean = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / cnt
        sq = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x * x) / cnt
        cols += [mean.alias(f"mean_{f}"), F.sqrt(F.greatest(sq - mean * mean, F.lit(0.0))).alias(f"std_{f}"),
                 F.array_max(xs).alias(f"max_{f}"), F.element_at(xs, -1).alias(f"last_{f}")]
    return seqs.select("host", "seq_no", LABEL, *cols)


def train_context(seqs: DataFrame, seed: int = 42, hidden: int = 32, max_iter: int = 100) -> PipelineModel:
    pooled = pooled_sequences(seqs)
    feats = [c for c in pooled.columns if c not in ("host", "seq_no", LABEL)]
    mlp = MultilayerPerceptronClassifier(featuresCol="scaled", labelCol=LABEL, layers=[len(feats), hidden, 2],
                                         maxIter=max_iter, seed=seed)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="vec", handleInvalid="keep"),
                            StandardScaler(inputCol="vec", outputCol="scaled", withMean=True, withStd=True), mlp])
    return _fit_persisted(pipe, pooled.select(*feats, LABEL))


def context_scores(model: PipelineModel, seqs: DataFrame) -> DataFrame:
    out = model.transform(pooled_sequences(seqs))
    return out.select("host", "seq_no", LABEL, "prediction", _proba1(out).alias("context_score"))


@dataclass(frozen=True)
class ContextModel:
    """A trained attention network over standardised windows."""
    length: int
    mean: tuple[float, ...]
    sd: tuple[float, ...]
    width: int
    hidden: int
    theta: tuple[float, ...]

    @property
    def net(self) -> AttentionNet:
        return AttentionNet(self.length, len(FEATURES), self.width, self.hidden)


def _window_array(model: ContextModel) -> F.Column:
    """The window as one array, row by row, standardised (padding rows too)."""
    mean, sd = (F.array(*map(F.lit, v)) for v in (model.mean, model.sd))
    return F.flatten(F.transform("window", lambda row: F.zip_with(
        F.zip_with(row, mean, lambda a, m: a.cast("double") - m), sd, lambda a, s: a / s)))


def train_attention(seqs: DataFrame, length: int = DEFAULT_FLOW.sequence_len, width: int = 16, hidden: int = 16,
                    rounds: int = 100, step: float = 0.01, seed: int = 42) -> ContextModel:
    """A classifier of windows that sees the order of their rows; attacks weigh as much as the rest."""
    stats = {r["feature"]: (r["mean"], r["sd"]) for r in fit_sequence_standardizer(seqs).collect()}
    model = ContextModel(length, tuple(stats[f][0] for f in FEATURES), tuple(stats[f][1] for f in FEATURES), width, hidden, ())
    n, pos = seqs.agg(F.count("*"), F.sum(F.col(LABEL).cast("double"))).first()
    heavy = (n - pos) / pos if pos and pos < n else 1.0
    data = seqs.select(_window_array(model).alias("x"), F.col(LABEL).cast("double").alias("y"),
                       F.when(F.col(LABEL) == 1, F.lit(float(heavy))).otherwise(F.lit(1.0)).alias("w"))
    return dataclasses.replace(model, theta=tuple(fit_network(model.net, data, rounds, step, seed).tolist()))


def attention_scores(model: ContextModel, seqs: DataFrame) -> DataFrame:
    """``seqs`` with ``context_score`` in place of the windows."""
    flat = seqs.withColumn("_x", _window_array(model)).drop("window")
    return predict_column(flat, model.net, np.array(model.theta), "_x", "context_score").drop("_x")


def context_of_flows(scored: DataFrame, model: ContextModel, wanted: F.Column, host_col: str = "src_ip") -> DataFrame:
    """``scored`` (with ``_pos``, a flow's place among its host's flows) with ``ctx_raw`` from the model.

    Only flows that are ``wanted`` (the context gate is open) get windows: the host's last ``length`` flows, zero rows in
    front where there are fewer. Each takes its rows by (host, place), so no task holds a host.
    """
    L = model.length
    host = F.coalesce(F.col(host_col), F.lit(""))
    rows = materialised(scored.drop("ctx_raw").withColumn("_host", host), "context-flows")
    asks = rows.filter(wanted).select("_host", F.col("_pos").alias("_ask"), F.explode(
        F.sequence(F.greatest(F.col("_pos") - L + 1, F.lit(1).cast("long")), F.col("_pos"))).alias("_pos"))
    flat = rows.select("_host", "_pos", F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("row"))
    held = asks.join(flat, ["_host", "_pos"]).groupBy("_host", "_ask").agg(
        F.sort_array(F.collect_list(F.struct("_pos", "row"))).alias("rows"))  # at most ``length`` rows
    zero = F.array_repeat(F.array_repeat(F.lit(0.0), len(FEATURES)), F.lit(L) - F.size("rows"))
    windows = held.select("_host", F.col("_ask").alias("_pos"), F.concat(zero, F.transform("rows", lambda r: r["row"])).alias("window"))
    found = attention_scores(model, windows).withColumnRenamed("context_score", "ctx_raw")
    return rows.join(found, ["_host", "_pos"], "left").drop("_host")


# -- M17 --------------------------------------------------------------------
def train_forest(train: DataFrame, feature_cols: list[str], seed: int = 42, trees: int = 100) -> PipelineModel:
    """Legacy forest: mean imputation (training fold), min-max, 100 trees."""
    imp_out = [f"i_{c}" for c in feature_cols]
    pipe = Pipeline(stages=[
        Imputer(inputCols=feature_cols, outputCols=imp_out, strategy="mean"),
        VectorAssembler(inputCols=imp_out, outputCol="vec", handleInvalid="keep"),
        MinMaxScaler(inputCol="vec", outputCol="scaled"),
        RandomForestClassifier(featuresCol="scaled", labelCol=LABEL, numTrees=trees, seed=seed)])
    return _fit_persisted(pipe, train.select(*feature_cols, LABEL))


# -- M18 / M7 with trained models ---------------------------------------------
@dataclass(frozen=True)
class Detectors:
    """Trained models of the barriers; None takes the surrogate."""
    routine: PipelineModel | BoostedModel | None = None
    anomaly: AnomalyModel | AutoencoderModel | None = None
    context: ContextModel | None = None


def save_detectors(spark, detectors: Detectors, model_dir: str) -> None:
    """Write the models under ``model_dir`` (shared storage); the anomaly threshold lies in the model's row."""
    for sub, model in (("routine", detectors.routine), ("anomaly", detectors.anomaly), ("context", detectors.context)):
        if isinstance(model, PipelineModel):
            model.write().overwrite().save(os.path.join(model_dir, sub))
        elif model is not None:
            row = (type(model).__name__, json.dumps(dataclasses.asdict(model)))
            spark.createDataFrame([row], _MODEL_SCHEMA).write.mode("overwrite").parquet(os.path.join(model_dir, sub))


_MODEL_SCHEMA = "kind string, fields string"


def _load_routine(spark, path: str) -> PipelineModel | BoostedModel:
    """Either form; the error of the pipeline where neither loads."""
    try:
        return PipelineModel.load(path)
    except Exception:
        try:
            return _load_row(spark, path)
        except Exception:  # noqa: BLE001 - the first error says more
            pass
        raise


def _load_row(spark, path: str) -> AnomalyModel | AutoencoderModel | ContextModel | BoostedModel:
    row = spark.read.schema(_MODEL_SCHEMA).parquet(path).first()
    kinds = {c.__name__: c for c in (AnomalyModel, AutoencoderModel, ContextModel, BoostedModel)}

    def fixed(x):
        return tuple(map(fixed, x)) if isinstance(x, list) else x

    return kinds[row.kind](**{k: fixed(v) for k, v in json.loads(row.fields).items()})


def _load(spark, model_dir: str) -> dict:
    """Per saved model its value, or the error that loading raised."""
    found = {}
    for sub, read in (("routine", lambda path: _load_routine(spark, path)), ("context", lambda path: _load_row(spark, path)),
                      ("anomaly", lambda path: _load_row(spark, path))):
        try:
            found[sub] = read(os.path.join(model_dir, sub))
        except Exception as exc:  # noqa: BLE001 - reported in the health table; the surrogate takes over
            found[sub] = exc
    return found


def read_detectors(spark, model_dir: str) -> Detectors:
    """The saved models; a barrier whose model doesn't load takes its surrogate."""
    found = {k: None if isinstance(v, Exception) else v for k, v in _load(spark, model_dir).items()}
    return Detectors(found["routine"], found["anomaly"], found["context"])


def load_detectors(spark, model_dir: str) -> DataFrame:
    """Health table: per barrier, ``model`` when a saved model loads, otherwise ``surrogate`` with the error."""
    found = _load(spark, model_dir)
    rows = []
    for name, sub in (("routine_xgboost", "routine"), ("context_transformer", "context"),
                      ("zero_day_autoencoder", "anomaly")):
        bad = isinstance(found[sub], Exception)
        rows.append((name, True, "surrogate" if bad else "model",
                     str(found[sub]).splitlines()[0][:200] if bad else None))
    return spark.createDataFrame(rows, "name string, available boolean, mode string, error string")


def score_with_models(flows: DataFrame, profile, detectors: Detectors, t: Thresholds = DEFAULT_THRESHOLDS,
                      cfg: FlowConfig = DEFAULT_FLOW) -> DataFrame:
    """M7 with the trained models there are; the anomaly model brings its own threshold."""
    routine = anomaly = context = None
    if detectors.context is not None:
        def context(df, wanted):
            return context_of_flows(df, detectors.context, wanted)
    if detectors.routine is not None:
        def routine(df):
            return routine_scores(detectors.routine, df).drop("prediction")
    if detectors.anomaly is not None:
        def anomaly(df):
            return reconstruction_error(df, detectors.anomaly).withColumnRenamed("anomaly_error", "anomaly_score")
        if detectors.anomaly.threshold is not None:
            t = dataclasses.replace(t, autoencoder=detectors.anomaly.threshold)
    return score_flows(flows, profile, t, cfg, routine=routine, anomaly=anomaly, context=context)


def holdout(flows: DataFrame, test_frac: float = 0.2, seed: int = 42, row_id: F.Column | None = None):
    s = stratified_split(flows, test_frac, seed, row_id)
    return s.filter(~F.col("is_test")).drop("is_test"), s.filter(F.col("is_test")).drop("is_test")


__all__ = ["train_routine", "routine_scores", "feature_importances", "train_anomaly", "reconstruction_error",
           "pooled_sequences", "train_context", "context_scores", "train_attention", "attention_scores", "train_autoencoder", "train_forest", "load_detectors", "holdout",
           "Detectors", "save_detectors", "read_detectors", "score_with_models",
           "evaluate", "MinMaxScaler", "StandardScaler"]
