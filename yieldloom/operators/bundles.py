"""Stored model bundles: published atomically, checked when loaded, applied to new traces.

A bundle folder holds ``versions/<id>/model`` (a fitted pipeline), ``versions/<id>/facts.json`` (feature schema, input
contract, recipe, metrics) and ``CURRENT``, the id of the published version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.operators import cmp, models
from yieldloom.operators.contracts import ContractError, require_columns
from yieldloom.operators.metrics import champion, regression_metrics
from yieldloom.operators.sets import align_feature_schema
from yieldloom.operators.traces import feature_rows, pivot_features
from yieldloom.session import pin


@dataclass(frozen=True)
class TraceContract:
    """What a batch of traces must have: columns, keys and the allowed stages; all columns but the stage are numbers."""

    columns: tuple[str, ...] = cmp.TRACE_COLUMNS
    keys: tuple[str, ...] = cmp.KEYS
    time: str = "TIMESTAMP"
    stage: str = "STAGE"
    stages: tuple[str, ...] = ("A", "B")
    source: str = "_source_index"


@dataclass(frozen=True)
class Facts:
    """Everything but the model that a bundle needs to be applied."""

    name: str
    target: str
    features: tuple[str, ...]
    recipe: str
    contract: TraceContract
    metrics: Mapping[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Bundle:
    model: PipelineModel
    facts: Facts
    version: str


@dataclass(frozen=True)
class Scored:
    """Predictions by key and one row about the batch."""

    predictions: DataFrame
    report: DataFrame


def signal_recipe(traces: DataFrame) -> DataFrame:
    """Statistics of every signal and of the sampling itself, long form."""
    order = ["TIMESTAMP", "_source_index"]
    signals = feature_rows(cmp.cmp_signal_stats(cmp.long_signals(traces)), cmp.KEYS, ["signal"])
    return signals.unionByName(feature_rows(cmp.cmp_process_stats(traces, order=order), cmp.KEYS, []))


#: Named ways from validated traces to long features; a bundle stores the name.
RECIPES: dict[str, Callable[[DataFrame], DataFrame]] = {"polishing": cmp.cmp_features, "signals": signal_recipe}


# --- storage ----------------------------------------------------------------
def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    _, place, files = _hadoop(spark, path)
    out = files.create(place, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    try:
        return spark.read.text(path, wholetext=True).first()[0]
    except AnalysisException as absent:
        raise FileNotFoundError(f"no bundle file {path}") from absent


def switch(spark: SparkSession, root: str, version: str) -> None:
    """Makes a version the published one: a written file replaces ``CURRENT`` in one rename."""
    fresh = f"{root}/CURRENT.{uuid.uuid4().hex}"
    write_text(spark, fresh, version)
    jvm, source, _ = _hadoop(spark, fresh)
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(source, target, how)


def publish(spark: SparkSession, root: str, model: PipelineModel, facts: Facts) -> str:
    """Writes a new version whole, then switches to it; readers see the old one or the new one, never a part."""
    version = uuid.uuid4().hex
    model.save(f"{root}/versions/{version}/model")
    write_text(spark, f"{root}/versions/{version}/facts.json", json.dumps(asdict(facts)))
    switch(spark, root, version)
    return version


def load_bundle(spark: SparkSession, root: str, minimum_r2: float = 0.8) -> Bundle:
    """The published bundle. One without features or without a held-out r2 above the minimum is refused."""
    version = read_text(spark, f"{root}/CURRENT").strip()
    read = json.loads(read_text(spark, f"{root}/versions/{version}/facts.json"))
    absent = {"name", "target", "features", "recipe", "contract", "metrics"} - set(read)
    if absent:
        raise ContractError(f"the bundle lacks {sorted(absent)}")
    r2 = read["metrics"].get("r2")
    if r2 is None or not r2 > minimum_r2:
        raise ContractError(f"the bundle's held-out r2 {r2} is not above {minimum_r2}")
    if not read["features"]:
        raise ContractError("the bundle has no feature schema")
    if read["recipe"] not in RECIPES:
        raise ContractError(f"unknown recipe {read['recipe']}")
    contract = TraceContract(**{k: tuple(v) if isinstance(v, list) else v for k, v in read["contract"].items()})
    facts = Facts(read["name"], read["target"], tuple(read["features"]), read["recipe"], contract, read["metrics"])
    return Bundle(PipelineModel.load(f"{root}/versions/{version}/model"), facts, version)


# --- learning ---------------------------------------------------------------
def prepared(features: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Exactly the schema's features as doubles, absent ones NULL, with their missing indicators."""
    return models.indicator_columns(align_feature_schema(features, names, keep), names)


def publish_champion(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, candidates: Mapping[str, tuple[Estimator, dict]], root: str, *, recipe: str, contract: TraceContract | None = None, fold: str = "fold") -> Bundle:
    """Chooses the candidate of the highest pooled out-of-fold r2, refits it on all rows and publishes it with its metrics."""
    df = pin(df.select(*dict.fromkeys([*keys, *features, target, fold])))
    ledger = pin(models.oof_ledger(df, keys, features, target, candidates, fold=fold))
    best = champion(regression_metrics(ledger, ["model"])).first()
    known = models.observed_features(df, features)
    model, options = candidates[best["model"]]
    ready = prepared(df, known, [*keys, target]).withColumn(target, F.col(target).cast("double")).filter(F.col(target).isNotNull())
    fitted = models.pipeline(known, target, model, **options).fit(ready)
    scores = {name: float(best[name]) for name in ("r2", "rmse", "mae") if best[name] is not None}
    facts = Facts(best["model"], target, tuple(known), recipe, contract or TraceContract(), scores)
    version = publish(df.sparkSession, root, fitted, facts)
    return Bundle(fitted, facts, version)


# --- scoring ----------------------------------------------------------------
def validate_traces(traces: DataFrame, contract: TraceContract) -> DataFrame:
    """The contract's columns with trimmed upper-case stages and numbers elsewhere.

    A missing column, another stage or a row without key or time is refused; other cells that are no numbers become
    NULL. A batch without a source column has one source. Columns beyond the contract are dropped.
    """
    require_columns(traces, contract.columns)
    names = [c for c in contract.columns if c != contract.stage]
    source = F.col(contract.source).try_cast("double") if contract.source in traces.columns else F.lit(0.0)
    clean = traces.select(
        *[F.col(f"`{c}`").try_cast("double").alias(c) for c in names],
        F.upper(F.trim(F.col(contract.stage).cast("string"))).alias(contract.stage), source.alias(contract.source),
    )
    stage = F.coalesce(F.col(contract.stage).isin(*contract.stages), F.lit(False))
    known = F.lit(True)
    for name in dict.fromkeys([*contract.keys, contract.time]):
        known = known & F.col(name).isNotNull()
    faults = clean.agg(F.count_if(~stage).alias("stages"), F.count_if(~known).alias("keys")).first()
    if faults["stages"]:
        raise ContractError(f"{faults['stages']} rows with a stage other than {list(contract.stages)}")
    if faults["keys"]:
        raise ContractError(f"{faults['keys']} rows without a number for a key or the time")
    return clean


def batch_features(clean: DataFrame, facts: Facts) -> DataFrame:
    """One row per key with the bundle's features; those that the batch lacks are NULL."""
    return pivot_features(RECIPES[facts.recipe](clean), facts.contract.keys, facts.features)


def score_new_traces(traces: DataFrame, bundle: Bundle) -> Scored:
    """Validates a batch, computes the stored recipe's features, aligns them to the schema and predicts.

    predictions: the keys as in the batch, ``predicted`` and the held-out r2 of the model. report: rows, samples, stages,
    features without any value in the batch (imputed) and whether the target stands in the input. A prediction that
    is no finite number is an error. An empty batch has no predictions and lacks all features.
    """
    facts = bundle.facts
    clean = pin(validate_traces(traces, facts.contract))
    features = pin(batch_features(clean, facts))
    keys = list(facts.contract.keys)
    value = F.col("prediction")
    scored = bundle.model.transform(prepared(features, facts.features, keys)).select(*keys, value.alias("predicted"), F.lit(facts.metrics["r2"]).alias("model_r2"))
    scored = pin(scored)
    broken = scored.filter(F.col("predicted").isNull() | F.isnan("predicted") | (F.abs("predicted") == float("inf"))).count()
    if broken:
        raise ContractError(f"{broken} predictions are no finite numbers")
    empty = [F.when(F.count(F.col(f"`{f}`")) == 0, F.lit(f)) for f in facts.features]
    about = features.agg(F.count(F.lit(1)).alias("samples"), F.array_compact(F.array(*empty)).alias("absent_features"))
    rows = clean.agg(F.count(F.lit(1)).alias("trace_rows"), F.array_sort(F.collect_set(facts.contract.stage)).alias("stages"))  # at most the allowed stages
    report = rows.crossJoin(F.broadcast(about)).withColumn("target_in_input", F.lit(facts.target in traces.columns))  # one row each
    return Scored(scored, report)
