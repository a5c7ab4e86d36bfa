"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Every document becomes a vector of six transformed statistics (``FEATURES``).
For each (language, source), each language and the whole corpus the location
and scatter of the densest ``SUPPORT`` of the vectors are estimated from three
starts (medians with quartile ranges, means with covariances, medians with
covariances): concentration steps keep the share of rows with the smallest
Mahalanobis distances and re-estimate from them, until the determinant falls by
no more than ``LEAST_FALL`` (of its logarithm; at most ``MOST_STEPS`` steps), and the
start that ends with the least determinant gives the estimate.  A document is judged by the
narrowest group with at least ``LEAST`` documents and rejected if its squared
distance exceeds ``CUTOFF``.  Scatter has a floor per feature (``FLOOR``), so a
statistic that hardly varies does not reject for a trifle.

All rows take part in every step, as Spark aggregates: vectors are integers
(thousandths), so sums are exact and the estimate does not depend on the
partitioning; distances are binned on a log scale, so the share's quantile
comes from a count per bin.  A group of any size is summed before the
shuffle.  Estimates are tables, one row per group, joined on the group's key.

Base rules: fewer than ``MIN_WORDS`` words, or over 20 % of the words inside
repeated five-word windows.  Documents that fail them do not shape the
estimates.

Defined results: null and empty texts have no words and fail the base rules;
null language and null source are values of their own; where no group has
``LEAST`` documents the method keeps.  Every row is judged by itself, so
repeated rows get equal verdicts.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from . import textstats
from .frames import stored, table

MIN_WORDS = 10
REPEAT_PERCENT = 20
SUPPORT = 0.75
MOST_STEPS, LEAST_FALL = 20, 1e-3
LEAST = 50
CUTOFF = 50.0
SCALE = 1000
FEATURES = ("words", "length", "symbols", "repeats", "upper", "punct")
#: smallest standard deviation of each feature
FLOOR = (0.5, 0.3, 0.05, 0.08, 0.05, 0.05)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_D = len(FEATURES)


def _vectors(c: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed statistics, in thousandths."""
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    x = np.stack([np.log(words), c["word_chars"] / words, np.sqrt(c["n_symbols"] / chars),
                  np.sqrt(c["n_repeat_words"] / words), np.sqrt(c["n_upper"] / chars),
                  np.sqrt(c["n_punct"] / chars)], axis=1)
    x[:, 1] = np.minimum(x[:, 1], 1000.0)
    return np.rint(x * SCALE).astype(np.int64)


def _measure(batches):
    for batch in tk.chunked(batches, "text"):
        c = textstats.counts(batch.column("text"))
        x = _vectors(c)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("doc_id", "lang", "source")), *(pa.array(c[n].astype(np.int64)) for n in COUNTS),
             pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), _D).cast(pa.list_(pa.int64()))],
            names=["doc_id", "lang", "source", *COUNTS, "x"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, the vector x and a row number."""
    kinds = dict(docs.dtypes)
    out = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(
        _measure, f"doc_id {kinds['doc_id']}, lang string, source string, "
                  + ", ".join(f"{c} long" for c in COUNTS) + ", x array<long>")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.select("*", failed.alias("base_failed"), F.monotonically_increasing_id().alias("rid"))


def _keys() -> Column:
    """The document's groups, narrowest first."""
    lang, source = (F.coalesce(F.concat(F.lit("="), c), F.lit("null")) for c in ("lang", "source"))
    return F.array(F.struct(F.lit(0).alias("level"), F.concat_ws("\x01", F.lit("s"), lang, source).alias("key")),
                   F.struct(F.lit(1).alias("level"), F.concat_ws("\x01", F.lit("l"), lang).alias("key")),
                   F.struct(F.lit(2).alias("level"), F.lit("all").alias("key")))


def _distance() -> Column:
    """Squared Mahalanobis distance of x from ``mean`` with the precision matrix ``prec``."""
    diff = [f"(x[{i}] / {float(SCALE)} - mean[{i}])" for i in range(_D)]
    return F.expr(" + ".join(f"prec[{i * _D + j}] * {diff[i]} * {diff[j]}" for i in range(_D) for j in range(_D)))


def _chi2_cdf(x: float, d: int) -> float:
    """For even d."""
    terms = [1.0]
    for k in range(1, d // 2):
        terms.append(terms[-1] * x / 2 / k)
    return 1 - np.exp(-x / 2) * sum(terms)


def consistency(support: float, d: int = _D) -> float:
    """Factor that makes the scatter of a normal sample's densest share its covariance."""
    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, d) < support else (lo, mid)
    return support / _chi2_cdf(lo, d + 2)


def precision(cov: np.ndarray) -> np.ndarray:
    """Inverse scatter after the floor: variances are lifted, correlations stay."""
    floor = np.asarray(FLOOR)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scale = np.maximum(sd, floor)
    corr = cov / np.maximum(np.outer(scale, scale), 1e-300)
    corr = 0.9 * corr + 0.1 * np.diag(np.diag(corr))
    np.fill_diagonal(corr, 1.0)
    return np.linalg.inv(corr * np.outer(scale, scale))


def _moments(r, h: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and precision of the scatter, from sums over ``h`` rows."""
    m = np.asarray(r.s, dtype=float) / h / SCALE
    second = np.zeros((_D, _D))
    second[np.triu_indices(_D)] = np.asarray(r.ss, dtype=float) / h / SCALE ** 2
    second = np.triu(second) + np.triu(second, 1).T
    return m, precision(factor * (second - np.outer(m, m)))


_COLUMNS = ["key", "start", "n", "mean", "prec", "det"]
_PARAMS = "key string, start int, n long, mean array<double>, prec array<double>, det double"


def _start(frames):
    for pdf in frames:
        rows = []
        for r in pdf.itertuples(index=False):
            q = np.asarray(r.q, dtype=float).reshape(_D, 3) / SCALE
            sd = np.maximum((q[:, 2] - q[:, 0]) / 1.349, FLOOR)
            m, prec = _moments(r, r.n, 1.0)
            for i, (mean, p) in enumerate(((q[:, 1], np.diag(1 / sd ** 2)), (m, prec), (q[:, 1], prec))):
                rows.append((r.key, i, r.n, list(mean), list(p.reshape(-1)), np.inf))
        yield pd.DataFrame(rows, columns=_COLUMNS)


def _step(frames):
    factor = consistency(SUPPORT)
    for pdf in frames:
        rows = []
        for r in pdf.itertuples(index=False):
            m, prec = _moments(r, r.h, factor)
            rows.append((r.key, r.start, r.n, list(m), list(prec.reshape(-1)), -np.linalg.slogdet(prec)[1]))
        yield pd.DataFrame(rows, columns=_COLUMNS)


def estimates(rows: DataFrame) -> DataFrame:
    """MCD estimates: key, n, mean, prec.  ``rows``: rid, level, key, x."""
    q = F.flatten(F.array(*[F.percentile(F.col("x")[i], F.array(*map(F.lit, (0.25, 0.5, 0.75)))) for i in range(_D)]))
    s = F.array(*[F.sum(F.col("x")[i]) for i in range(_D)])
    ss = F.array(*[F.sum((F.col("x")[i] * F.col("x")[j]).cast("decimal(30,0)")).cast("double")
                   for i in range(_D) for j in range(i, _D)])
    now = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), q.alias("q"), s.alias("s"), ss.alias("ss"))
                 .mapInPandas(_start, _PARAMS), "mcd-start")
    done = []
    for _ in range(MOST_STEPS):
        binned = stored(rows.join(now, "key").select(
            "key", "start", "n", "x", F.least(F.log2(1 + _distance()) * 64, F.lit(6400.0)).cast("int").alias("bin")),
            "mcd-bins")
        # written first: only then can Spark split the rows of a hot group in the join
        limit = stored(binned.groupBy("key", "start").agg(F.percentile("bin", F.lit(SUPPORT)).alias("limit")), "mcd-limit")
        near = binned.join(limit, ["key", "start"]).where("bin <= limit")
        new = stored(near.groupBy("key", "start").agg(
            F.max("n").alias("n"), F.count(F.lit(1)).alias("h"), s.alias("s"), ss.alias("ss"))
            .mapInPandas(_step, _PARAMS), "mcd-step")
        both = new.join(now.select("key", "start", F.col("det").alias("was")), ["key", "start"])
        falls = F.col("det") < F.col("was") - LEAST_FALL
        done.append(now.join(both.where(~falls).select("key", "start"), ["key", "start"], "left_semi"))
        now = stored(both.where(falls).select(*_COLUMNS), "mcd-going")
        if not now.limit(1).count():
            break
    else:
        done.append(now)
    ends = done[0]
    for d in done[1:]:
        ends = ends.unionByName(d)
    # equal determinants (to nine digits): the first start
    best = F.min_by(F.struct("n", "mean", "prec"), F.struct(F.round("det", 9), "start")).alias("e")
    return stored(ends.groupBy("key").agg(best).select("key", "e.*"), "mcd")


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """One row per document: counts, base_failed, distance (null if not judged), kept."""
    stats = stored(measured(docs), "quality-stats")
    rows = stats.where("not base_failed").select("rid", "x", F.explode(_keys()).alias("g")).select(
        "rid", "x", "g.level", "g.key")
    judged = (rows.join(estimates(rows), "key").where(F.col("n") >= LEAST)
              .groupBy("rid").agg(F.min_by(_distance(), "level").alias("distance")))
    return (stats.join(judged, "rid", "left")
            .select("doc_id", *COUNTS, "base_failed", "distance",
                    (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept")))


def op3(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
