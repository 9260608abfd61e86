"""Measures of scores against truth, and conformal calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.ordered import quantiles, running


def f1_scores(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1), 0 where a share has no base, from one count of pairs."""
    pairs = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(zero)
    both = pairs.select(F.col("t").alias("label"), F.col("n").alias("of_truth"), zero.alias("of_guess"), hit.alias("hit")).union(pairs.select("p", zero, "n", zero))
    s = both.groupBy("label").agg(F.sum("of_truth").alias("t"), F.sum("of_guess").alias("p"), F.sum("hit").alias("h"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return s.select("label", share("h", "p").alias("precision"), share("h", "t").alias("recall"), F.when(F.col("p") + F.col("t") > 0, 2 * F.col("h") / (F.col("p") + F.col("t"))).otherwise(0.0).alias("f1"))


def macro_f1(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return f1_scores(rows, truth, predicted).agg(F.avg("f1").alias("macro_f1"))


def by_score(rows: DataFrame, y: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a distinct score (of each group): positives and negatives with it."""
    return rows.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))


def average_precision(rows: DataFrame, y: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum over thresholds of the gain in recall times the precision there; ties are one threshold.
    Null without positives. `by` names columns of groups that are measured each."""
    steps = running(by_score(rows, y, score, by), "score", {"tp": ("sum", F.col("pos")), "all": ("sum", F.col("pos") + F.col("neg"))}, by, descending=True)
    return steps.groupBy(*by).agg((F.sum(F.col("pos") * F.col("tp") / F.col("all")) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))


def rank_auc(rows: DataFrame, y: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The chance that a positive scores over a negative, ties half; null without either."""
    steps = running(by_score(rows, y, score, by), "score", {"upto": ("sum", F.col("neg"))}, by)
    return steps.groupBy(*by).agg((F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def best_threshold(rows: DataFrame, y: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The score (of each group) with the best F1 if all from it on count as positive, and that
    F1; the lowest of equal ones. Looks at every distinct score."""
    steps = running(by_score(rows, y, score, by), "score", {"tp": ("sum", F.col("pos")), "all": ("sum", F.col("pos") + F.col("neg"))}, by, descending=True)
    total = steps.groupBy(*by).agg(F.sum("pos").alias("total"))
    steps = steps.join(F.broadcast(total), list(by)) if by else steps.crossJoin(F.broadcast(total))
    f1 = 2 * F.col("tp") / F.nullif(F.col("all") + F.col("total"), F.lit(0))
    best = F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("low")))
    return steps.groupBy(*by).agg(best.alias("b")).select(*by, (-F.col("b.low")).alias("threshold"), F.col("b.f1").alias("f1"))


def recall_at_fpr(rows: DataFrame, y: str, score: str, fpr: float) -> DataFrame:
    """The share of positives at or over the score that a share `fpr` of negatives passes."""
    bound = quantiles(rows.where(F.col(y) == 0), score, [1 - fpr]).select(F.get("values", F.lit(0)).alias("threshold"))
    return rows.where(F.col(y) == 1).crossJoin(F.broadcast(bound)).agg(F.first("threshold").alias("threshold"), F.avg((F.col(score) >= F.col("threshold")).cast("double")).alias("recall"))


def ece_bins(rows: DataFrame, conf: str, correct: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) over bins (lo, hi]; a confidence of 0 is in none."""
    own = rows.where(F.col(conf) > 0).withColumn("bin", (F.ceil(F.col(conf) * bins) - 1).cast("long"))
    return own.groupBy("bin").agg(F.count("*").alias("n"), F.avg(conf).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def ece(rows: DataFrame, conf: str, correct: str, bins: int = 10) -> DataFrame:
    total = rows.agg(F.count("*").alias("all"))
    gaps = ece_bins(rows, conf, correct, bins).crossJoin(F.broadcast(total))
    return gaps.agg(F.coalesce(F.sum(F.col("n") / F.col("all") * F.abs(F.col("confidence") - F.col("accuracy"))), F.lit(0.0)).alias("ece"))


def threshold_tuning(rows: DataFrame, y: str, score: str, steps: int = 40) -> DataFrame:
    """The quantile of the scores with the best F1, and it; the lowest of equal ones."""
    at = [i / steps for i in range(1, steps)]
    cuts = quantiles(rows, score, at).select(F.explode(F.array_distinct("values")).alias("threshold"))
    scored = by_score(rows, y, score).crossJoin(F.broadcast(cuts))  # distinct scores x at most 39 thresholds
    over = F.col("score") >= F.col("threshold")
    f1 = 2 * F.sum(F.when(over, F.col("pos")).otherwise(0)) / (F.sum(F.when(over, F.col("pos") + F.col("neg")).otherwise(0)) + F.sum("pos"))
    return scored.groupBy("threshold").agg(f1.alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


def temporal_cut(rows: DataFrame, time: str, share: float) -> DataFrame:
    """Rows with `train`: whether their time is before the quantile of all times."""
    cut = quantiles(rows, time, [share]).select(F.get("values", F.lit(0)).alias("cut"))
    return rows.crossJoin(F.broadcast(cut)).withColumn("train", F.col(time) < F.col("cut")).drop("cut")


def temporal_parts(rows: DataFrame, window: str, shares: tuple[float, ...]) -> DataFrame:
    """Rows with `part`, 0 for the first share of all windows from the first to the last, 1 for
    the next and so on: (0.60, 0.15, 0.25) fits, calibrates and tests on whole windows."""
    if abs(sum(shares) - 1) > 1e-9 or min(shares) <= 0:
        raise ValueError("shares must be positive and sum up to 1")
    ends = rows.agg(F.min(window).alias("lo"), F.max(window).alias("hi"))
    at = lambda share: F.col("lo") + F.floor((F.col("hi") - F.col("lo") + 1) * F.lit(round(share, 9)))
    bounds = [at(sum(shares[: i + 1])) for i in range(len(shares) - 1)]
    part = sum(((F.col(window) >= b).cast("int") for b in bounds), F.lit(0))
    return rows.crossJoin(F.broadcast(ends)).withColumn("part", part).drop("lo", "hi")


def feature_agreement(rows: DataFrame, pairs: dict[str, tuple[str, str]], rtol: float = 1e-6, atol: float = 1e-9) -> DataFrame:
    """(feature, r, relative_error, share_close) of two versions of each feature; columns that
    don't vary correlate by definition."""
    out = None
    for name, (a, b) in pairs.items():
        x, y = F.col(a), F.col(b)
        r = F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y)).otherwise(1.0)
        close = F.abs(x - y) <= atol + rtol * F.abs(y)
        one = rows.agg(F.lit(name).alias("feature"), r.alias("r"), F.avg(F.abs(x - y) / F.greatest(F.abs(x), F.lit(1.0))).alias("relative_error"), F.avg(close.cast("double")).alias("share_close"))
        out = one if out is None else out.unionByName(one)
    return out


class Conformal:
    """Split conformal prediction with abstention; `classes` are the probability columns' labels."""

    def __init__(self, alpha: float = 0.1, mondrian: bool = False):
        if not 0 < alpha < 1:
            raise ValueError("alpha must be between 0 and 1")
        self.alpha, self.mondrian = alpha, mondrian

    def thresholds(self, rows: DataFrame, probs: str, label: str, classes: int) -> DataFrame:
        """(label, threshold): the k-th smallest of 1 - p(truth), k = ceil((m + 1)(1 - alpha)) in
        1..m; 1.0 for a class without rows. Marginal: the same for all classes."""
        scores = rows.select(F.col(label).alias("label"), (1 - F.get(F.col(probs), F.col(label))).alias("s"))
        scores = scores if self.mondrian else scores.withColumn("label", F.lit(-1))
        n = scores.groupBy("label").agg(F.count("*").alias("m"))
        k = F.greatest(F.lit(1), F.least(F.col("m"), F.ceil(F.round((F.col("m") + 1) * (1 - self.alpha), 9))))
        # equal scores are counted, and the one that holds the k-th place of its label is taken
        counts = scores.groupBy("label", "s").agg(F.count("*").alias("n"))
        held = running(counts, "s", {"upto": ("sum", F.col("n"))}, by=("label",)).join(F.broadcast(n), "label")
        ranked = held.where((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)).select("label", F.col("s").alias("threshold"))
        all_classes = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
        if self.mondrian:
            return all_classes.join(ranked, "label", "left").select("label", F.coalesce("threshold", F.lit(1.0)).alias("threshold"))
        one = ranked.agg(F.coalesce(F.max("threshold"), F.lit(1.0)).alias("threshold"))
        return all_classes.crossJoin(F.broadcast(one))

    def decide(self, rows: DataFrame, probs: str, thresholds: DataFrame) -> DataFrame:
        """Rows with predicted (first of equal probabilities), confidence, set_size, in_set and
        abstained. Marginal: abstain unless one class is in the set. Mondrian: abstain where the
        predicted class is not credible by its own threshold."""
        t = thresholds.agg(F.array_sort(F.collect_list(F.struct("label", "threshold"))).alias("t"))
        p = F.col(probs)
        out = rows.crossJoin(F.broadcast(t)).withColumn("t", F.col("t.threshold"))
        out = out.withColumn("in_set", F.zip_with(p, "t", lambda a, b: 1 - a <= b)).withColumn("predicted", (F.array_position(p, F.array_max(p)) - 1).cast("int")).withColumn("confidence", F.array_max(p))
        out = out.withColumn("set_size", F.size(F.filter("in_set", lambda x: x)).cast("long"))
        return out.withColumn("abstained", ~F.get("in_set", F.col("predicted")) if self.mondrian else F.col("set_size") != 1).drop("t")

    @staticmethod
    def worst_class_coverage(decided: DataFrame, label: str) -> DataFrame:
        """(label, coverage) of the class whose truth is in the set least often; the smaller label of equal ones."""
        per = decided.groupBy(F.col(label).alias("label")).agg(F.avg(F.get("in_set", F.col(label)).cast("double")).alias("coverage"))
        return per.agg(F.min_by("label", F.struct("coverage", "label")).alias("label"), F.min("coverage").alias("coverage"))

    @staticmethod
    def report(decided: DataFrame, label: str, by_class: bool = False) -> DataFrame:
        """Coverage (truth in the set), abstention, and accuracy of what is decided."""
        hit = F.get("in_set", F.col(label)).cast("double")
        right = F.when(~F.col("abstained"), (F.col("predicted") == F.col(label)).cast("double"))
        grouped = decided.groupBy(F.col(label).alias("label")) if by_class else decided.groupBy()
        return grouped.agg(F.count("*").alias("n"), F.avg(hit).alias("coverage"), F.avg(F.col("abstained").cast("double")).alias("abstention"), F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy"))
