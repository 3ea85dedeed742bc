"""Evaluation of a similarity against labelled job pairs: coverages, grids, AUC-ROC and ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim


def job_skill_pairs(skills: DataFrame, edges: DataFrame) -> DataFrame:
    """Scores (dense, sparse) of the skills of each labelled job pair (code_a, code_b, label); edges are joined first."""
    s = skills.withColumn("sparse_norm", sim.sparse_norm(F.col("sparse")))
    a, b = (s.select(F.col("job_id").alias(f"code_{x}"), F.col("pos").alias(f"pos_{x}"), F.col("dense").alias(f"dense_{x}"), F.col("sparse").alias(f"sparse_{x}"), F.col("sparse_norm").alias(f"norm_{x}")) for x in "ab")
    p = edges.join(a, "code_a").join(b, "code_b")
    return p.select("code_a", "code_b", "label", "pos_a", "pos_b", sim.dot(F.col("dense_a"), F.col("dense_b")).alias("dense"), sim.sparse_cosine(F.col("sparse_a"), F.col("sparse_b"), F.col("norm_a"), F.col("norm_b")).alias("sparse"))


def _bests(pairs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Best value of each skill of either side in the other job: side, keys, best."""
    a = pairs.groupBy(*keys, "pos_a").agg(F.max(value).alias("best")).select(*keys, F.lit("a").alias("side"), "best")
    b = pairs.groupBy(*keys, "pos_b").agg(F.max(value).alias("best")).select(*keys, F.lit("b").alias("side"), "best")
    return a.unionByName(b)


def coverages(pairs: DataFrame, thresholds: Sequence[float], value: str = "dense") -> DataFrame:
    """Share of B's skills that A covers (a_vers_b), of A's that B covers, and their mean, at each threshold.

    The bests are made once for all thresholds.
    """
    keys = ["code_a", "code_b", "label"]
    bests = _bests(pairs, keys, value)
    grid = F.explode(F.array(*map(F.lit, thresholds)))
    c = bests.withColumn("seuil_sim", grid).groupBy(*keys, "seuil_sim").agg(
        F.avg(F.when(F.col("side") == "b", (F.col("best") >= F.col("seuil_sim")).cast("double"))).alias("a_vers_b"),
        F.avg(F.when(F.col("side") == "a", (F.col("best") >= F.col("seuil_sim")).cast("double"))).alias("b_vers_a"),
    )
    return c.withColumn("couverture", (F.col("a_vers_b") + F.col("b_vers_a")) / 2)


def continuous(pairs: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Mean of the mean best hybrid scores of both directions, for each dense weight (sparse: 1 - dense)."""
    keys = ["code_a", "code_b", "label", "poids_dense"]
    p = pairs.withColumn("poids_dense", F.explode(F.array(*map(F.lit, weights)))).withColumn("hybride", F.col("poids_dense") * F.col("dense") + (1 - F.col("poids_dense")) * F.col("sparse"))
    side = _bests(p, keys, "hybride").groupBy(*keys, "side").agg(F.avg("best").alias("m"))
    return side.groupBy(*keys).agg(F.avg("m").alias("score"))


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(predictions: DataFrame, keys: list[str], count: str | None = None) -> DataFrame:
    """TP, FP, FN, TN and accuracy, precision, recall, F1 (0 for an empty denominator) of (label, predicted) by keys.

    A row counts once, or as often as its column ``count`` says.
    """
    t, p, n = F.col("label"), F.col("predicted"), F.col(count) if count else F.lit(1)
    cells = {"tp": t & p, "fp": ~t & p, "fn": t & ~p, "tn": ~t & ~p}
    m = predictions.groupBy(*keys).agg(*(F.sum(F.when(which, n).otherwise(0)).cast("long").alias(name) for name, which in cells.items()))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    m = m.withColumns({"accuracy": _ratio(tp + tn, tp + fp + fn + tn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)})
    return m.withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))


def threshold_grid(pairs: DataFrame, similarity: Sequence[float], coverage: Sequence[float], value: str = "dense") -> DataFrame:
    """Confusion metrics of every (similarity, coverage) threshold; coverage is made once for a similarity threshold."""
    return coverage_grid(coverages(pairs, similarity, value), coverage)


def coverage_grid(covered: DataFrame, coverage: Sequence[float]) -> DataFrame:
    """Confusion metrics of every (similarity, coverage) threshold, from coverages at each similarity threshold, or their counts ``n``."""
    # Coverages are ratios of small numbers: their few different values are counted before the grid multiplies them
    many = F.sum("n") if "n" in covered.columns else F.count(F.lit(1))
    few = covered.groupBy("seuil_sim", "label", "couverture").agg(many.alias("_n"))
    c = few.withColumn("seuil_couv", F.explode(F.array(*map(F.lit, coverage))))
    return confusion(c.withColumn("predicted", F.col("couverture") >= F.col("seuil_couv")), ["seuil_sim", "seuil_couv"], "_n")


def best_configuration(grid: DataFrame) -> DataFrame:
    """First in grid order of the configurations with the best F1, recall and precision."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"), "seuil_sim", "seuil_couv")
    return grid.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def auc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve: the share of (positive, negative) pairs in order, equal scores half; null where only one class is there.

    Scores are counted, then compared inside buckets of neighbouring scores; only the buckets' totals meet in one task.
    """
    up, down = F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("n")
    few = scores.groupBy(*keys, "score").agg(up, down)
    # The whole part and 16 bits behind it keep the order; null comes first
    few = few.withColumn("_b", F.when(F.col("score").isNotNull(), F.floor(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), F.col("score"))) * 65536)))

    def below(by: list[str], order: str):
        return F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    inside = F.sum(F.col("p") * (F.col("_below") + F.col("n") / 2.0))
    buckets = few.withColumn("_below", below([*keys, "_b"], "score")).groupBy(*keys, "_b").agg(inside.alias("_u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    total = buckets.withColumn("_below", below(keys, "_b")).groupBy(*keys).agg(F.sum(F.col("_u") + F.col("p") * F.col("_below")).alias("_u"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    p, n = F.col("positives"), F.col("negatives")
    return total.withColumn("auc", F.when((p > 0) & (n > 0), F.col("_u") / (p * n))).drop("_u")


def best_weights(sweep: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    return sweep.withColumn("_m", F.max("auc").over(Window.partitionBy(F.lit(1)))).where(F.col("auc") >= F.col("_m") - tolerance).drop("_m")


def top_errors(predictions: DataFrame, k: int = 10) -> DataFrame:
    """The k false positives and the k false negatives of the highest coverage."""
    kind = F.when(~F.col("label") & F.col("predicted"), "FP").when(F.col("label") & ~F.col("predicted"), "FN")
    p = predictions.withColumn("erreur", kind).where(F.col("erreur").isNotNull())
    w = Window.partitionBy("erreur").orderBy(F.desc("couverture"), "code_a", "code_b")
    return p.withColumn("rang", F.row_number().over(w)).where(F.col("rang") <= k)


def neighbours(edges: DataFrame) -> DataFrame:
    """Adjacency of undirected edges (code_a, code_b)."""
    e = edges.select(F.col("code_a").alias("code"), F.col("code_b").alias("voisin"))
    return e.union(e.select("voisin", "code")).distinct()


def recall_mrr(rankings: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Recall@k and MRR@k of rankings (code, item, rang) over codes that have neighbours and a ranking."""
    near = neighbours(edges)
    many = near.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    top = rankings.where(F.col("rang") <= k)
    hits = top.join(near, (top["code"] == near["code"]) & (top["item"] == near["voisin"])).groupBy(top["code"]).agg(F.countDistinct("item").alias("hits"), F.min("rang").alias("first"))
    asked = many.join(rankings.select("code").distinct(), "code", "left_semi").join(hits, "code", "left")
    mean = asked.agg(F.count(F.lit(1)).alias("queries"), F.avg(F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))
    return mean.select("queries", F.coalesce("recall", F.lit(0.0)).alias("recall_at_k"), F.coalesce("mrr", F.lit(0.0)).alias("mrr"))
