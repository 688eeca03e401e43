"""Quality rules: robust multivariate outliers of text statistics.

Each group of a language and a source gets a minimum-covariance-determinant estimate
of the centre and scatter of its transformed statistics. Texts whose Mahalanobis
distance from it is too large are rejected, besides those that fail the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.common import field, fresh, per_row
from corpus_engine.runtime import durable

SYMBOLS = "#*$%&|<>"
STATISTICS = ("log_words", "word_length", "symbols", "dup_lines", "repeats")
SIZE = len(STATISTICS)
#: Share of a group that the estimate covers.
COVER = 0.75
#: Concentration goes on while it lowers the logarithm of a determinant by more than this.
GAIN = 1e-3
#: Groups of fewer texts use the estimate of their language, then of all texts.
LEAST = 100
#: Standard deviations are never taken as smaller than this, in transformed units.
FLOOR = (0.4, 0.3, 0.4, 0.3, 0.3)
#: Median and a far quantile (1 - 1e-9) of the chi-square distribution with five degrees of freedom.
CHI_MEDIAN, CHI_FAR = 4.3515, 51.6


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # splits at ASCII white space only
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.encode().strip()]
    repeated = 0
    if len(words) >= 4:
        code = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
        pair = pd.factorize(code[:-1] * (code.max() + 1) + code[1:])[0].astype(np.int64)
        triple = pair[:-1] * (code.max() + 1) + code[2:]
        _, inverse, count = np.unique(triple, return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        hit = np.zeros(len(words), dtype=bool)
        for k in range(3):
            hit[k : k + len(twice)] |= twice
        repeated = int(hit.sum())
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated


def statistics(df: DataFrame, text: str = "text") -> Column:
    """A struct column of the base statistics."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def make():
        return lambda texts: pd.DataFrame([text_statistics(t) for t in texts], columns=names)

    return per_row(make, ", ".join(f"{n} long" for n in names), field(text))


def transformed(s: Column) -> Column:
    """The statistics on scales on which ordinary texts spread evenly."""
    words = F.greatest(s["n_words"], F.lit(1)).cast("double")
    return F.array(
        F.log(words),
        s["word_chars"] / words,
        F.log1p(100 * s["n_symbols"] / F.greatest(s["word_chars"], F.lit(1))),
        F.log1p(100 * s["n_dup_lines"] / words),
        F.log1p(100 * s["n_repeat_words"] / words),
    )


def _scatter(moments: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from sums of the values and of their products."""
    mean = moments[:SIZE] / n
    cov = np.zeros((SIZE, SIZE))
    cov[np.triu_indices(SIZE)] = moments[SIZE:] / n
    cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)
    # a direction without spread gets the floor
    return mean, cov + np.diag(np.maximum(np.square(FLOOR) - np.diag(cov), 0))


def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of summed moments to centre, precision matrix and log determinant."""
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            mean, cov = _scatter(np.asarray(row.moments, dtype=float), float(row.n))
            out.append((row.grp, row.trial, mean, np.linalg.inv(cov).ravel(), np.linalg.slogdet(cov)[1]))
        yield pd.DataFrame(out, columns=["grp", "trial", "mean", "precision", "log_det"])


_ESTIMATE = "grp string, trial int, mean array<double>, precision array<double>, log_det double"


def distance(x: Column, mean: Column, precision: Column) -> Column:
    """Squared Mahalanobis distance."""
    centred = [x[i] - mean[i] for i in range(SIZE)]
    terms = [precision[i * SIZE + j] * centred[i] * centred[j] for i in range(SIZE) for j in range(SIZE)]
    return sum(terms[1:], terms[0])


def _moments(rows: DataFrame) -> DataFrame:
    x = F.col("x")
    sums = [F.sum(x[i]) for i in range(SIZE)]
    sums += [F.sum(x[i] * x[j]) for i in range(SIZE) for j in range(i, SIZE)]
    return rows.groupBy("grp", "trial").agg(F.count("*").alias("n"), F.array(*sums).alias("moments"))


def concentrate(rows: DataFrame, now: DataFrame, cover: float) -> DataFrame:
    """``now`` estimated again from the ``cover`` nearest rows of each group, with ``fell``: by how much log_det fell."""
    x = F.col("x")
    far = rows.join(now, "grp").select("grp", "trial", "x", distance(x, F.col("mean"), F.col("precision")).alias("d"))
    # written, so that its size is known and the many rows of a group need not meet
    limit = durable(far.groupBy("grp", "trial").agg(F.percentile_approx("d", cover, 1000).alias("limit")))
    near = far.join(limit, ["grp", "trial"]).filter(F.col("d") <= F.col("limit"))
    after = _moments(near).mapInPandas(estimate, _ESTIMATE)
    before = now.select("grp", "trial", F.struct("log_det", "mean", "precision").alias("before"))
    fell = F.col("before.log_det") - F.col("log_det")
    after = after.join(before, ["grp", "trial"]).withColumn("fell", fell)
    # sketched quantiles may raise it a little: then the estimate before stays
    better = [F.when(fell < 0, F.col("before")[c]).otherwise(F.col(c)).alias(c) for c in ("mean", "precision", "log_det")]
    return durable(after.select("grp", "trial", *better, "fell"))


def robust_estimates(rows: DataFrame, cover: float = COVER, gain: float = GAIN) -> DataFrame:
    """``grp, mean, precision, scale`` of rows (``grp, x``): fast minimum covariance determinant.

    Two starts (medians with median deviations; all rows) are concentrated: keep the
    ``cover`` nearest of each group, estimate again, until the determinant falls no
    more; groups that are done leave. The start with the smaller determinant wins.
    ``scale`` makes the median distance that of a normal distribution. Only sums and
    sketches are shuffled, with map-side combination; tables of a row a group are
    written, so that joins with them are chosen by their size.
    """
    x = F.col("x")
    middle = rows.groupBy("grp").agg(F.array(*(F.percentile_approx(x[i], 0.5, 1000) for i in range(SIZE))).alias("m"))
    middle = durable(middle)
    off = rows.join(middle, "grp").withColumn("x", F.array(*(F.abs(x[i] - F.col("m")[i]) for i in range(SIZE))))
    spread = off.groupBy("grp").agg(
        F.first("m").alias("mean"),
        F.array(*(1.4826 * F.percentile_approx(x[i], 0.5, 1000) for i in range(SIZE))).alias("sd"),
    )
    floored = [F.greatest(F.col("sd")[i], F.lit(FLOOR[i])) for i in range(SIZE)]
    diagonal = [1 / F.pow(floored[i], 2) if i == j else F.lit(0.0) for i in range(SIZE) for j in range(SIZE)]
    first = spread.select("grp", F.lit(0).alias("trial"), "mean", F.array(*diagonal).alias("precision"), F.lit(0.0).alias("log_det"))
    plain = _moments(rows.withColumn("trial", F.lit(1))).mapInPandas(estimate, _ESTIMATE)
    # neither start is an estimate from a cover set yet, so the first step always counts
    now = durable(first.unionByName(plain).withColumn("log_det", F.lit(float("inf"))))
    done = now.limit(0)
    while not now.isEmpty():
        after = concentrate(rows, now, cover)
        done = done.unionByName(after.filter(F.col("fell") <= gain).drop("fell"))
        now = after.filter(F.col("fell") > gain).drop("fell")
    best = done.groupBy("grp").agg(F.min_by(F.struct("mean", "precision"), F.struct("log_det", "trial")).alias("e"))
    best = durable(best.select("grp", "e.*"))
    d = rows.join(best, "grp").select("grp", distance(x, F.col("mean"), F.col("precision")).alias("d"))
    scale = d.groupBy("grp").agg((F.percentile_approx("d", 0.5, 1000) / CHI_MEDIAN).alias("scale"))
    return best.join(scale, "grp").withColumn("scale", F.greatest("scale", F.lit(1.0)))


def judge(
    documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", far: float = CHI_FAR
) -> DataFrame:
    """Replace the text by its statistics, base_failed, distance and kept.

    base_failed: fewer than 50 words, or more than half of them in repeated 3-word
    windows. kept: not base_failed and a scaled distance of at most ``far``. A null or
    empty text has no words and fails; a null language or source is a group of its
    own; groups of fewer than ``LEAST`` texts use their language's estimate, then that
    of all texts. Failed texts don't enter the estimates. Repeated rows stay; other
    columns pass through, and one named like a result is replaced. The text is left
    out because the rows are written once before the estimates are made.
    """
    results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")
    made, x, grp, wide, all_ = (fresh(documents, c) for c in ("made", "x", "grp", "wide", "all"))
    keep = [field(c) for c in documents.columns if c not in (*results, text)]
    s = field(made)
    failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
    measured = documents.withColumn(made, statistics(documents, text)).select(
        *keep,
        s.alias(made),
        transformed(s).alias(x),
        F.to_json(F.struct(field(lang).alias("l"), field(source).alias("s")), {"ignoreNullFields": "false"}).alias(grp),
        F.to_json(F.struct(field(lang).alias("l")), {"ignoreNullFields": "false"}).alias(wide),
        F.lit("all").alias(all_),
    )
    measured = durable(measured)
    good = measured.filter(~failed)
    rows = good.select(field(x).alias("x"), F.explode(F.array(field(grp), field(wide), field(all_))).alias("grp"))
    sizes = rows.groupBy("grp").count().filter((F.col("count") >= LEAST) | (F.col("grp") == "all")).select("grp")
    large = durable(sizes)
    estimates = durable(robust_estimates(durable(rows.join(large, "grp"))))

    # the narrowest level that has an estimate
    levels = durable(good.select(field(grp).alias("g"), field(wide).alias("w"), field(all_).alias("a")).distinct())
    ranked = levels.select("g", F.posexplode(F.array("g", "w", "a")).alias("level", "grp")).join(estimates, "grp")
    chosen = ranked.groupBy("g").agg(F.min_by(F.struct("mean", "precision", "scale"), "level").alias("estimate"))
    mine = fresh(measured, "estimate")
    chosen = durable(chosen.select(F.col("g").alias(grp), F.col("estimate").alias(mine)))
    joined = measured.join(chosen, grp, "left")
    d = distance(field(x), field(mine)["mean"], field(mine)["precision"]) / field(mine)["scale"]
    return joined.select(
        *keep,
        *(s[n].alias(n) for n in results[:5]),
        failed.alias("base_failed"),
        d.alias("distance"),
        F.coalesce(~failed & (d <= far), F.lit(False)).alias("kept"),
    )
