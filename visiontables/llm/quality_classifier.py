"""Quality classifier with hierarchical empirical Bayes.

A logistic model reads a document's own evidence from a few measures of its whole text. How good the documents of its host
and of its path under that host are is the prior: the classifier's mean over a path is shrunk towards its host's, a host's
towards the global one, the more the fewer documents there are. How strongly comes from the data: the variance between hosts,
and between paths, beyond what documents within them vary. A document's own share is taken out of its prior.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visiontables.llm.logistic import Logistic, fit
from visiontables.llm.quality_rules import measure
from visiontables.llm.words import buffers, runs, sums
from visiontables.operators.stages import materialize

#: Labelled documents that the document model is fitted on, at most; the first ones by hash.
MOST_LABELLED = 20_000
THRESHOLD = 0.3
#: Bounds of the number of documents that a prior counts for.
STRENGTH = (2.0, 1e6)

_UPPER, _LETTER, _DIGIT, _MARK, _BAR, _SHOUT = (np.zeros(256, dtype=bool) for _ in range(6))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
_MARK[list(b"#*$%&<>")] = True
_BAR[124] = True
_SHOUT[33] = True


def text_features(texts: pa.Array) -> np.ndarray:
    """Rows of: log words, word length, shares of marks, bars, exclamations, upper case and digits, repeated words, repeated lines, ratio."""
    return np.concatenate([_features(part) for part in runs(texts)] or [_features(texts)])


def _features(texts: pa.Array) -> np.ndarray:
    data, offsets = buffers(texts)
    seen = measure(texts)
    words = np.maximum(seen.column("n_words").to_numpy().astype(float), 1)
    chars = np.maximum(seen.column("word_chars").to_numpy().astype(float), 1)
    letters = np.maximum(sums(_LETTER[data], offsets), 1)
    per_word = [np.minimum(sums(flags[data], offsets) / words, 3) for flags in (_MARK, _BAR, _SHOUT)]
    ratio = np.asarray([1.0 if r is None else r for r in seen.column("ratio").to_pylist()], dtype=float)
    return np.column_stack((np.log(words), np.minimum(chars / words, 30), *per_word, sums(_UPPER[data], offsets) / letters, sums(_DIGIT[data], offsets) / chars,
                            seen.column("n_repeat_words").to_numpy() / words, seen.column("n_dup_lines").to_numpy() / words, np.minimum(ratio, 2)))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def features_of(text: pa.Array) -> pa.Array:
    table = text_features(text)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * table.shape[1], pa.int32()), pa.array(table.ravel()))


@dataclass(frozen=True)
class SiteModel:
    """Document model, global mean of its probabilities, and how many documents the prior above counts for at both levels."""

    document: Logistic
    mean: float
    host_strength: float
    path_strength: float


def _evidence(features: Column, model: Logistic) -> Column:
    """The document model's logit."""
    total = F.lit(model.bias)
    for k, w in enumerate(model.weights):
        total = total + F.lit(w) * features[k]
    return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))


def _logistic(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, parents: str | None, mean: float, variance: float) -> float:
    """Documents that a group's prior counts for: within variance over variance between groups, by the method of moments."""
    n, s = F.col("n"), F.col("s")
    centre = F.lit(mean) if parents is None else F.col(parents)
    row = groups.agg(F.sum(n * (s / n - centre) ** 2), F.sum(n), F.sum(n * n), F.count("*")).first()
    if not row[1] or row[1] - row[2] / row[1] <= 0:
        return STRENGTH[1]
    between = (row[0] - (row[3] - 1) * variance) / (row[1] - row[2] / row[1])
    return min(STRENGTH[1], max(STRENGTH[0], variance / between)) if between > 0 else STRENGTH[1]


def fit_sites(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", most_labelled: int = MOST_LABELLED) -> tuple[SiteModel, DataFrame]:
    """The model, and a table (host, path, n, s, host_n, host_s) of document counts and summed probabilities."""
    sample = materialize(labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
                         .groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled), "labelled")
    rows = materialize(docs.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), features_of("text").alias("features")), "features")
    seen = rows.join(F.broadcast(sample), "doc_id").select("features", "quality").toPandas()
    width = len(text_features(pa.array([""]))[0])
    document = fit(np.stack(seen["features"].to_list()) if len(seen) else np.zeros((0, width)), seen["quality"].to_numpy(float))
    p = _logistic(_evidence(F.col("features"), document))
    paths = materialize(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")), "paths")
    hosts = paths.groupBy(F.col("host").alias("_host")).agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    sites = materialize(paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).select("host", "path", "n", "s", "host_n", "host_s"), "sites")
    n, s, q = paths.agg(F.sum("n"), F.sum("s"), F.sum("q")).first()
    mean = min(0.999, max(0.001, s / n)) if n else 0.5
    variance = max(1e-6, q / n - (s / n) ** 2) if n else 0.25
    host_strength = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_s").alias("s")), None, mean, variance)
    path_strength = _strength(sites.select("n", "s", (F.col("host_s") / F.col("host_n")).alias("centre")), "centre", mean, variance)
    return SiteModel(document, mean, host_strength, path_strength), sites


def _scored(docs: DataFrame, carry: Column, labels: DataFrame, host: str, path: str, most_labelled: int) -> DataFrame:
    """``carry`` of each row of ``docs`` as _row, with the struct _quality_verdict_."""
    model, sites = fit_sites(docs, labels, host, path, most_labelled)
    table = sites.select(F.col("host").alias("_site_host_"), F.col("path").alias("_site_path_"), F.struct("n", "s", "host_n", "host_s").alias("_site_"))
    own = docs.select(carry.alias("_row"), F.col(host).alias("_host_"), F.col(path).alias("_path_"), _evidence(features_of("text"), model.document).alias("_evidence_"))
    met = own.join(table, F.col("_host_").eqNullSafe(F.col("_site_host_")) & F.col("_path_").eqNullSafe(F.col("_site_path_")), "left")
    p = _logistic(F.col("_evidence_"))
    clip = lambda x: F.greatest(F.lit(0.001), F.least(F.lit(0.999), x))
    at = F.col("_site_")
    host_prior = clip((at["host_s"] - p + model.host_strength * model.mean) / (at["host_n"] - 1 + model.host_strength))
    path_prior = clip((at["s"] - p + model.path_strength * host_prior) / (at["n"] - 1 + model.path_strength))
    weight = F.col("_evidence_") - math.log(model.mean / (1 - model.mean))
    verdict = F.struct(F.col("_evidence_").alias("evidence"), p.alias("document_score"), host_prior.alias("host_prior"), path_prior.alias("path_prior"), _logistic(weight + _logit(path_prior)).alias("score"))
    return met.select("_row", verdict.alias("_quality_verdict_"))


def classify_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, evidence, document_score, host_prior, path_prior, score, kept, one row per row of ``docs``.

    ``score`` is the posterior that a document is good, kept if it reaches ``threshold``. NULL and empty texts have the
    features of no words; a NULL host or path is a group of its own; documents labelled more than once count as bad if one
    label says so; repeated rows score alike. Without labels of both kinds the evidence is the same for all. No rows give
    no rows. Other columns are not read.
    """
    got = _scored(docs, F.struct("doc_id"), labels, host, path, most_labelled)
    return got.select("_row.doc_id", "_quality_verdict_.*").withColumn("kept", F.col("score") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """The rows of ``docs`` that ``classify_quality`` keeps, with all their columns, whatever their names."""
    return _scored(docs, F.struct("*"), labels, host, path, most_labelled).where(F.col("_quality_verdict_.score") >= threshold).select("_row.*")
