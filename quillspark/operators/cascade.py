"""Model cascades: a cheap proxy scores all rows, an oracle labels a budgeted sample, a threshold is learnt with a guarantee.

The bounds are one-sided Hoeffding-Serfling bounds for sampling without replacement with a union bound over the
candidate thresholds, so each guarantee holds with probability 1 - delta at least.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GUARANTEES = ("accuracy", "precision", "recall", "precision+recall")


@dataclass(frozen=True)
class Cascade:
    guarantee: str = "recall"
    target: float = 0.9
    delta: float = 0.05
    label_budget: int = 400
    steps: int = 20
    seed: int = 42

    def __post_init__(self):
        if self.guarantee not in GUARANTEES:
            raise ValueError(f"unknown guarantee: {self.guarantee}")
        if not 0 < self.target < 1 or not 0 < self.delta < 1 or self.label_budget < 1:
            raise ValueError("target and delta lie between 0 and 1, the budget is positive")


def lower_bound(successes: int, n: int, population: int, delta: float) -> float:
    """A value below the population's rate with probability 1 - delta, from n draws without replacement."""
    if n == 0:
        return 0.0
    left = (1 - (n - 1) / population) if n <= population / 2 else (1 - n / population) * (1 + 1 / n)
    return successes / n - math.sqrt(max(0.0, left) * math.log(1 / delta) / (2 * n))


def learn(scores: list[float], labels: dict[int, bool], conf: Cascade) -> float:
    """The threshold at and above which the proxy's rows are accepted; inf where no threshold is safe.

    scores: all rows' proxy scores; labels: the oracle's on a uniform sample of them, by row.
    """
    ranked = sorted(set(scores))
    cuts = {ranked[int(i * (len(ranked) - 1) / conf.steps)] for i in range(conf.steps + 1)} if ranked else set()
    return threshold([(scores[i], y) for i, y in labels.items()], {t: sum(s >= t for s in scores) for t in cuts}, len(scores), conf)


def threshold(drawn: list[tuple[float, bool]], above: dict[float, int], population: int, conf: Cascade) -> float:
    """As ``learn``, from the sample's scores and labels and, for each candidate cut, how many of all ``population``
    rows score at or above it."""
    cuts = sorted(above)
    delta = conf.delta / max(1, len(cuts)) / (2 if conf.guarantee == "precision+recall" else 1)

    def precision(t: float) -> float:
        inside = [y for s, y in drawn if s >= t]
        return lower_bound(sum(inside), len(inside), max(1, above[t]), delta)

    def recall(t: float) -> float:
        good = [s for s, y in drawn if y]
        return lower_bound(sum(s >= t for s in good), len(good), max(1, population), delta)

    if conf.guarantee == "precision":
        return min((t for t in cuts if precision(t) >= conf.target), default=math.inf)
    if conf.guarantee == "recall":
        return max((t for t in cuts if recall(t) >= conf.target), default=-math.inf)
    both = [t for t in cuts if precision(t) >= conf.target and recall(t) >= conf.target]
    return max(both, default=math.nan)


def counts_above(scored: DataFrame, score: Column, steps: int) -> dict[float, int]:
    """Candidate cuts (quantiles of all rows' ``score``) and how many rows lie at or above each, by two aggregates."""
    cuts = scored.agg(F.percentile_approx(score, [i / steps for i in range(steps + 1)], 10_000)).first()[0]
    if not cuts:
        return {}
    cuts = sorted(set(cuts))
    row = scored.agg(*[F.count(F.when(score >= F.lit(t), 1)).alias(f"c{k}") for k, t in enumerate(cuts)]).first()
    return dict(zip(cuts, row, strict=True))


def run(df: DataFrame, *, score, oracle: Callable[[DataFrame], DataFrame], conf: Cascade, order: list[str], keep: str = "keep") -> DataFrame:
    """``df`` with ``keep`` and ``__source`` (proxy or oracle).

    oracle: rows to rows with the boolean ``label``; it sees the sample (``label_budget`` rows at most) and, for accuracy
    and where no threshold is safe, the rows the proxy can't decide. Rows labelled by the oracle keep its label.
    """
    scored = df.withColumn("__score", score)
    noise = F.xxhash64(F.lit(conf.seed), *order)
    sample = oracle(scored.orderBy(noise, *order).limit(conf.label_budget)).select(*order, "__score", "label")
    drawn = [(r["__score"], r["label"]) for r in sample.collect()]  # the budget bounds it
    population = scored.count()
    labelled = F.broadcast(sample.drop("__score"))
    if conf.guarantee == "accuracy":
        # Confident rows of either sign are the proxy's; certainty is the distance from one half.
        sure = [abs(s - 0.5) for s, _ in drawn]
        right = {i: (s >= 0.5) == y for i, (s, y) in enumerate(drawn)}
        above = counts_above(scored, F.abs(F.col("__score") - 0.5), conf.steps)
        cuts = sorted(above)
        safe = math.inf
        for t in cuts:
            inside = [i for i, c in enumerate(sure) if c >= t]
            if lower_bound(sum(right[i] for i in inside), len(inside), max(1, above[t]), conf.delta / len(cuts)) >= conf.target:
                safe = t
                break
        unsure = F.abs(F.col("__score") - 0.5) < safe if safe < math.inf else F.lit(True)
        accept = F.col("__score") >= 0.5
    else:
        t = threshold(drawn, counts_above(scored, F.col("__score"), conf.steps), population, conf)
        if conf.guarantee in ("precision", "recall"):
            accept = F.lit(False) if t == math.inf else F.lit(True) if t == -math.inf else F.col("__score") >= t
            unsure = F.lit(t == math.inf)
        else:
            unsure, accept = (F.lit(True), F.lit(False)) if math.isnan(t) else (F.lit(False), F.col("__score") >= t)
    rows = scored.join(labelled, order, "left")
    asked = rows.where(F.col("label").isNull() & unsure)
    told = oracle(asked.drop("label")).select(*df.columns, F.col("label").alias(keep), F.lit("oracle").alias("__source"))
    known = rows.where(F.col("label").isNotNull() | ~unsure)
    rest = known.select(*df.columns, F.coalesce("label", accept).alias(keep), F.when(F.col("label").isNotNull(), "oracle").otherwise("proxy").alias("__source"))
    return rest.unionByName(told)


def logistic_proxy(df: DataFrame, *, vector: str, label: str, order: list[str], slice_rows: int = 200, seed: int = 42):
    """(model, training ids): a logistic head on embeddings, fitted on a labelled slice; None if the slice has one class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    part = df.orderBy(F.xxhash64(F.lit(seed), *order)).limit(slice_rows)
    part = part.select(*order, array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"))
    if part.select("label").distinct().count() < 2:
        return None, part.select(*order)
    return LogisticRegression(regParam=0.01).fit(part), part.select(*order)
