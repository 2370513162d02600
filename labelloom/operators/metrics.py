"""Classification metrics, all built from one small confusion aggregate or from scores in long form.

``labels`` is the closed label list; absent labels count as 0 in macro means.
``by`` carries run or fold columns through every metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.operators.ordering import BUCKET, order_buckets, running_totals
from labelloom.session import bounded_values, checked_broadcast, materialize

# Fixed value: probabilities are clipped to [EPS, 1 - EPS] before the logarithm.
EPS = 2.220446049250313e-16
METRICS = [
    "accuracy", "precision_macro", "recall_macro", "f1_macro",
    "precision_weighted", "recall_weighted", "f1_weighted",
]


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def observed_labels(preds: DataFrame, true: str = "true_label", pred: str = "pred_label") -> list:
    both = preds.select(F.explode(F.array(true, pred)).alias("label"))
    return bounded_values(both, "label")


def confusion(preds: DataFrame, labels, by=(), true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """Zero-filled counts ``n`` by (by, true_label, pred_label)."""
    by = list(by)
    counts = preds.groupBy(*by, F.col(true).alias("true_label"), F.col(pred).alias("pred_label")) \
        .agg(F.count("*").alias("n"))
    # Zeros are added as rows and summed away, so no join with the label grid is needed.
    base = counts.select(*by).distinct() if by else preds.sparkSession.range(1).select()
    zeros = base.withColumn("true_label", F.explode(_literals(labels))) \
        .withColumn("pred_label", F.explode(_literals(labels))).withColumn("n", F.lit(0).cast("bigint"))
    return counts.unionByName(zeros).groupBy(*by, "true_label", "pred_label").agg(F.sum("n").alias("n"))


def confusion_matrix(preds: DataFrame, labels, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """Square matrix: one row per true label, one ``pred_<label>`` column per label."""
    long = confusion(preds, labels, (), true, pred)
    cells = [F.sum(F.when(F.col("pred_label") == F.lit(l), F.col("n")).otherwise(0)).alias(f"pred_{l}") for l in labels]
    return long.where(F.col("true_label").isin(list(labels))).groupBy("true_label").agg(*cells)


def confusion_norm(preds: DataFrame, labels, by=(), true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """Counts with the share of their true label; an empty row gives 0."""
    long = confusion(preds, labels, by, true, pred)
    total = F.sum("n").over(W.partitionBy(*by, "true_label"))
    return long.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def accuracy(preds: DataFrame, by=(), true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    # A missing prediction is a wrong one.
    hit = F.coalesce(F.col(true) == F.col(pred), F.lit(False)).cast("int")
    return preds.groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _share(a: Column, b: Column) -> Column:
    """a / b, NaN where there is nothing to divide by."""
    return F.when(b > 0, a / b).otherwise(F.lit(float("nan")))


def class_scores(conf: DataFrame, by=()) -> DataFrame:
    """precision, recall, f1, support per label from a confusion table (a few rows per run)."""
    by = list(by)
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)
    sides = conf.select(*by, F.inline(F.array(
        F.struct(F.col("true_label").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.alias("tp")),
        F.struct(F.col("pred_label").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
    )))
    per = sides.groupBy(*by, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )
    per = per.withColumn("precision", _ratio(F.col("tp"), F.col("predicted")))
    per = per.withColumn("recall", _ratio(F.col("tp"), F.col("support")))
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return per.withColumn("f1", f1)


def prf_from_confusion(conf: DataFrame, labels, by=()) -> DataFrame:
    """One row per run: accuracy and macro/weighted precision, recall and F1 over ``labels``."""
    per = class_scores(conf, by)
    inside = F.col("label").isin(list(labels))
    n = F.sum("support")
    aggs = [n.cast("bigint").alias("n"), _ratio(F.sum("tp"), n).alias("accuracy")]
    weight = F.when(inside, F.col("support")).otherwise(0)
    for m in ("precision", "recall", "f1"):
        own = F.when(inside, F.col(m)).otherwise(0.0)
        aggs.append((F.sum(own) / len(labels)).alias(f"{m}_macro"))
        aggs.append(_ratio(F.sum(own * weight), F.sum(weight)).alias(f"{m}_weighted"))
    return per.groupBy(*by).agg(*aggs)


def prf(preds: DataFrame, labels, by=(), true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    return prf_from_confusion(confusion(preds, labels, by, true, pred), labels, by)


def class_report(preds: DataFrame, labels, by=(), true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """Per-class rows plus accuracy, macro avg and weighted avg rows."""
    return report_from_confusion(confusion(preds, labels, by, true, pred), labels, by)


def report_from_confusion(conf: DataFrame, labels, by=()) -> DataFrame:
    """Every class feeds its own row and the three summary rows, in one aggregation."""
    per = class_scores(conf, by)
    inside = F.col("label").isin(list(labels))
    own = F.when(inside, F.col("label").cast("string"))
    rows = per.withColumn("inside", inside).withColumn(
        "line", F.explode(F.array_compact(F.array(own, F.lit("accuracy"), F.lit("macro avg"), F.lit("weighted avg"))))
    )
    weight = F.when(F.col("inside"), F.col("support")).otherwise(0)

    def value(m: str) -> Column:
        mine = F.when(F.col("inside"), F.col(m)).otherwise(0.0)
        return (
            F.when(F.col("line") == "accuracy", _ratio(F.sum("tp"), F.sum("support")))
            .when(F.col("line") == "macro avg", F.sum(mine) / len(labels))
            .when(F.col("line") == "weighted avg", _ratio(F.sum(mine * weight), F.sum(weight)))
            .otherwise(F.sum(mine)).alias(m)
        )

    out = rows.groupBy(*by, "line").agg(*[value(m) for m in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    return out.withColumnRenamed("line", "label")


def per_class_f1(preds: DataFrame, labels, run: str, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    per = class_scores(confusion(preds, labels, [run], true, pred), [run])
    return per.where(F.col("label").isin(list(labels))).select(run, "label", "f1", "support")


def fold_metrics(preds: DataFrame, labels, fold: str = "fold", true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """Metrics per fold and a pooled row with fold -1, all from one confusion aggregate."""
    conf = confusion(preds, labels, [fold], true, pred)
    kind = conf.schema[fold].dataType
    each = conf.withColumn(fold, F.explode(F.array(F.col(fold), F.lit(-1).cast(kind))))
    pooled = each.groupBy(fold, "true_label", "pred_label").agg(F.sum("n").alias("n"))
    return prf_from_confusion(pooled, labels, [fold])


def unpivot_metrics(table: DataFrame, keys: list[str], metrics=None) -> DataFrame:
    metrics = [m for m in (metrics or METRICS) if m in table.columns]
    return table.unpivot(keys, metrics, "metric", "value")


def fold_summary(fm: DataFrame, fold: str = "fold", metrics=None) -> DataFrame:
    """Mean and population standard deviation over folds, with the number of folds seen."""
    long = unpivot_metrics(fm.where(F.col(fold) >= 0), [fold], metrics)
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n_folds")
    )


def boot_summary(fm: DataFrame, key: str = "iteration", metrics=None) -> DataFrame:
    """Mean, population deviation and the exact 2.5 / 97.5 percentiles per metric."""
    long = unpivot_metrics(fm, [key], metrics)
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.percentile("value", 0.025).alias("ci_low"), F.percentile("value", 0.975).alias("ci_high"),
    )


def metric_box(fm: DataFrame, key: str, metrics=None) -> DataFrame:
    """Five-number summary per metric."""
    long = unpivot_metrics(fm, [key], metrics)
    return long.groupBy("metric").agg(
        F.min("value").alias("low"), F.percentile("value", 0.25).alias("q1"),
        F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.75).alias("q3"),
        F.max("value").alias("high"),
    )


# Score-based metrics. ``scores`` is long: row_id, true_label, label, score.

def score_steps(scores: DataFrame, by=("label",), positive: Column | None = None, score: str = "score") -> DataFrame:
    """Positives and negatives at or above every distinct score, per class.

    Equal scores collapse first, so a heavily repeated score is one row. The
    running counts go over score buckets, so one class may hold all rows.
    """
    by = list(by)
    positive = positive if positive is not None else F.col("true_label") == F.col("label")
    steps = scores.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    steps = materialize(steps, "score-steps")
    steps = order_buckets(steps, "score").withColumn(BUCKET, -F.col(BUCKET))
    return running_totals(
        steps, by, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, group_totals=True
    ).drop(BUCKET)


def auc_from_steps(steps: DataFrame, by=("label",)) -> DataFrame:
    """Exact area with ties counted half."""
    below = F.col("fp_total") - F.col("fp")
    wins = F.col("pos").cast("double") * (below + F.col("neg") / 2.0)
    p, n = F.max("tp_total"), F.max("fp_total")
    area = F.when((p > 0) & (n > 0), F.sum(wins) / (p.cast("double") * n)).otherwise(F.lit(float("nan")))
    return steps.groupBy(*by).agg(area.alias("auc"), p.alias("support"))


def roc_auc(scores: DataFrame, labels, by=()) -> DataFrame:
    """One row (per run or fold): one-vs-rest AUC, macro and support-weighted; NaN when a class has no positives."""
    by = list(by)
    per = auc_from_steps(score_steps(scores, [*by, "label"]), [*by, "label"]).where(F.col("label").isin(list(labels)))
    nan = F.lit(float("nan"))
    # NaN passes through sums, so a class without positives makes both means NaN.
    present = F.count("*") == len(labels)
    return per.groupBy(*by).agg(
        F.when(present, F.sum("auc") / len(labels)).otherwise(nan).alias("roc_auc_macro"),
        F.when(present, F.sum(F.col("auc") * F.col("support")) / F.sum("support")).otherwise(nan)
        .alias("roc_auc_weighted"),
    )


def roc_points(scores: DataFrame, top: int = 10) -> DataFrame:
    """FPR/TPR at every distinct score of the ``top`` classes by support; (0, 0) is implied."""
    steps = score_steps(scores)
    support = scores.where(F.col("true_label") == F.col("label")).groupBy("label").agg(F.count("*").alias("support"))
    best = support.orderBy(F.desc("support"), "label").limit(top).select("label")
    return steps.join(F.broadcast(best), "label", "left_semi").select(
        "label", F.col("score").alias("threshold"),
        _share(F.col("fp"), F.col("fp_total")).alias("fpr"), _share(F.col("tp"), F.col("tp_total")).alias("tpr"),
    )


def pr_points(scores: DataFrame, by=("label",), positive: Column | None = None, score: str = "score") -> DataFrame:
    steps = score_steps(scores, by, positive, score)
    return steps.select(
        *by, F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        _share(F.col("tp"), F.col("tp_total")).alias("recall"),
    )


def avg_precision(scores: DataFrame, by=("label",), positive: Column | None = None, score: str = "score") -> DataFrame:
    """Step-wise average precision: sum of recall gains times precision; NaN without positives."""
    steps = score_steps(scores, by, positive, score)
    gain = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return steps.groupBy(*by).agg(_share(F.sum(gain), F.max("tp_total")).alias("average_precision"))


def log_loss(scores: DataFrame, by=()) -> DataFrame:
    """-mean ln p(true); rows are normalised, an all-zero row is uniform, scores are aligned by label name."""
    own = F.max(F.when(F.col("label") == F.col("true_label"), F.col("score")))
    rows = scores.groupBy(*by, "row_id").agg(
        F.when(F.sum("score") > 0, F.coalesce(own, F.lit(0.0)) / F.sum("score"))
        .otherwise(1.0 / F.count("*")).alias("p")
    )
    clipped = F.least(F.lit(1 - EPS), F.greatest(F.lit(EPS), F.col("p")))
    return rows.groupBy(*by).agg(F.avg(-F.log(clipped)).alias("log_loss"))


def binary_metrics(preds: DataFrame, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """accuracy, precision, recall, F1 of class 1, ROC AUC, average precision and log loss in one row.

    Everything is read off the table of distinct scores in one aggregation.
    """
    steps = score_steps(preds.withColumn("all", F.lit(1)), ["all"], F.col(y) == 1, p)
    hat, s = F.col("score") >= threshold, F.col("score")

    def clip(c: Column) -> Column:
        return F.least(F.lit(1 - EPS), F.greatest(F.lit(EPS), c))

    loss = -(F.col("pos") * F.log(clip(s)) + F.col("neg") * F.log(clip(1 - s)))
    gain = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    wins = F.col("pos").cast("double") * (F.col("fp_total") - F.col("fp") + F.col("neg") / 2.0)
    nan = F.lit(float("nan"))
    sums = steps.agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("p"), F.sum("neg").alias("q"),
        F.sum(F.when(hat, F.col("pos")).otherwise(0)).alias("hit"), F.sum(F.when(hat, F.col("neg")).otherwise(0)).alias("false"),
        F.sum(loss).alias("loss"), F.sum(gain).alias("gain"), F.sum(wins).alias("wins"),
    )
    hit, false, pos, neg = F.col("hit"), F.col("false"), F.col("p"), F.col("q")
    return sums.select(
        "n", _ratio(hit + neg - false, F.col("n")).alias("accuracy"), _ratio(hit, hit + false).alias("precision"),
        _ratio(hit, pos).alias("recall"), _ratio(2 * hit, hit + false + pos).alias("f1"),
        F.when((pos > 0) & (neg > 0), F.col("wins") / (pos.cast("double") * neg)).otherwise(nan).alias("roc_auc"),
        _ratio(F.col("gain"), pos).alias("average_precision"), F.when(F.col("n") > 0, F.col("loss") / F.col("n")).alias("log_loss"),
    )


def errors(preds: DataFrame, by=(), true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """Rows, wrong rows, unparsable rows and the error rate."""
    wrong = ~F.col(true).eqNullSafe(F.col(pred))
    return preds.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(wrong).alias("n_wrong"),
        F.count_if(F.col("parse_error")).alias("n_parse_error"),
        F.avg(wrong.cast("int")).alias("error_rate"),
    )


def top_confusions(preds: DataFrame, n: int = 10, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    wrong = preds.where(F.col(true) != F.col(pred))
    return wrong.groupBy(true, pred).agg(F.count("*").alias("n")).orderBy(F.desc("n"), true, pred).limit(n)


def histogram(df: DataFrame, value: str, group: str, bins: int = 40) -> DataFrame:
    """Density per bin between the smallest and largest value of each group; null values are left out."""
    df = df.where(F.col(value).isNotNull())
    bounds = df.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("total"))
    counts = df.groupBy(group, value).agg(F.count("*").alias("__c"))
    rows = counts.join(checked_broadcast(bounds), group)
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / width).cast("int"))
    rows = rows.withColumn("width", width).withColumn("bin", F.when(width > 0, at).otherwise(0))
    return rows.groupBy(group, "bin", "lo", "width", "total").agg(F.sum("__c").alias("n")).select(
        group, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left"), "n",
        F.when(F.col("width") > 0, F.col("n") / (F.col("total") * F.col("width"))).alias("density"),
    )


def latency(timings: DataFrame, run: str = "run") -> DataFrame:
    """Mean total, rows/s, ms/row and percentiles over repeats, overall and per stage.

    ``timings`` has (run, repeat, stage, seconds, n).
    """
    whole = timings.groupBy(run, "repeat").agg(F.sum("seconds").alias("seconds"), F.max("n").alias("n")) \
        .withColumn("stage", F.lit("total"))
    each = timings.select(run, "repeat", "seconds", "n", "stage")
    both = whole.select(*each.columns).unionByName(each)
    ms = F.col("seconds") / F.col("n") * 1000
    mean = F.avg("seconds")
    return both.groupBy(run, "stage").agg(
        F.count("*").alias("n_repeats"), mean.alias("total_s"), (F.max("n") / mean).alias("rows_per_s"),
        (mean / F.max("n") * 1000).alias("ms_per_row"),
        F.percentile(ms, 0.5).alias("p50_ms"), F.percentile(ms, 0.95).alias("p95_ms"),
        F.percentile(ms, 0.99).alias("p99_ms"),
    )


def best(results: DataFrame, by: list[str], metric: str, tie: str) -> DataFrame:
    """Best row per group by ``metric``, ties by the smaller ``tie`` name."""
    order = W.partitionBy(*by).orderBy(F.desc(metric), tie)
    return results.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def align_scores(preds: DataFrame, key: str, probability: str, classes: list, labels: list) -> DataFrame:
    """Long scores over the fixed label list from a probability array; classes it doesn't reach get 0."""
    at = {c: i + 1 for i, c in enumerate(classes)}
    values = F.array(*[
        F.struct(F.lit(l).alias("label"),
                 F.coalesce(F.try_element_at(F.col(probability), F.lit(at[l])), F.lit(0.0)).cast("double").alias("score")
                 if l in at else F.lit(0.0).alias("score"))
        for l in labels
    ])
    return preds.select(key, F.inline(values))
