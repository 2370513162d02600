"""Corpus planning: parameter grids, weighted assignment and prompt rendering."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom import domain
from labelloom.functions.keys import draw, uniform
from labelloom.functions.render import PLAN_TEMPLATES, fill
from labelloom.functions.text import lookup
from labelloom.operators.ordering import position_rank


def cumulative(weights: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """Upper interval bound of every category after normalising the weights."""
    total = sum(w for _, w in weights)
    bounds, acc = [], 0.0
    for name, w in weights:
        acc += w / total
        bounds.append((name, acc))
    return bounds


def pick_weighted(key, purpose: str, weights: list[tuple[str, float]]) -> Column:
    """Category whose cumulative interval holds the keyed uniform draw."""
    u = uniform(key, purpose)
    bounds = cumulative(weights)
    out = None
    for name, hi in bounds[:-1]:
        out = F.when(u < hi, name) if out is None else out.when(u < hi, name)
    return out.otherwise(bounds[-1][0]) if out is not None else F.lit(bounds[-1][0])


def pick_uniform(key, purpose: str, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (draw(key, purpose) % len(values) + 1).cast("int"))


def pick_other(key, own: Column, labels: list[str], ratio: float) -> Column:
    """With probability ``ratio`` a label other than ``own``, uniformly; else null."""
    order = F.create_map(*[F.lit(x) for i, l in enumerate(labels) for x in (l, i)])
    at = F.element_at(order, own)
    other = draw(key, "secondary") % (len(labels) - 1)
    other = F.when(other >= at, other + 1).otherwise(other)
    value = F.element_at(F.array(*[F.lit(l) for l in labels]), (other + 1).cast("int"))
    return F.when(uniform(key, "multi_intent") < ratio, value)


def plan_params(key) -> dict[str, Column]:
    return {
        "temperature": F.round(F.lit(0.65) + uniform(key, "temperature") * 0.40, 2),
        "top_p": F.round(F.lit(0.30) + uniform(key, "top_p") * 0.48, 2),
        "top_k": (draw(key, "top_k") % 50 + 30).cast("int"),
        "seed": (draw(key, "seed") % 99998 + 1).cast("int"),
    }


def plan_flags(key, label: Column, multi: Column) -> dict[str, Column]:
    return {
        "is_multi_intent": multi,
        "is_ambiguous": (uniform(key, "ambiguous") < domain.AMBIGUOUS_RATIO) & ~multi,
        "is_spam": label.isin(domain.SPAM_CLASSES) | (uniform(key, "spam") < domain.SPAM_RATIO),
        "language": F.when(draw(key, "language") % 5 < 4, "es").otherwise("en"),
    }


def corpus_plan(df: DataFrame, key: str) -> DataFrame:
    """The 17-column generation plan for the keys of ``df``; a pure projection."""
    plan = df.select(F.col(key).alias("email_id"))
    plan = plan.withColumn("class_label", pick_weighted("email_id", "class", domain.WEIGHTS))
    plan = plan.withColumn(
        "secondary_label", pick_other("email_id", F.col("class_label"), domain.LABELS, domain.MULTI_INTENT_RATIO)
    )
    plan = plan.withColumns(plan_flags("email_id", F.col("class_label"), F.col("secondary_label").isNotNull()))
    plan = plan.withColumns({
        "tone": pick_uniform("email_id", "tone", domain.TONES),
        "sender_profile": pick_uniform("email_id", "profile", domain.SENDER_PROFILES),
        "email_length": pick_weighted("email_id", "length", domain.LENGTH_WEIGHTS),
        "noise_level": pick_weighted("email_id", "noise", domain.NOISE_WEIGHTS),
        "channel": pick_uniform("email_id", "channel", domain.CHANNELS),
    })
    return plan.withColumns(plan_params("email_id"))


def assign_models(df: DataFrame, key: str, models: list[str], strategy: str = "round-robin",
                  weights: list[float] | None = None) -> DataFrame:
    """Add ``model_assigned``: round-robin in key order, weighted, or random."""
    if strategy == "round-robin":
        names = F.array(*[F.lit(m) for m in models])
        ranked = position_rank(df, [], key, rank_col="__rank")
        model = F.element_at(names, ((F.col("__rank") - 1) % len(models) + 1).cast("int"))
        return ranked.withColumn("model_assigned", model).drop("__rank", "__rank_total")
    if strategy == "weighted":
        weights = weights or [1.0 / len(models)] * len(models)
        return df.withColumn("model_assigned", pick_weighted(key, "model", list(zip(models, weights))))
    return df.withColumn("model_assigned", pick_uniform(key, "model", models))


def param_grid(spark: SparkSession, dims: dict[str, list], cap: int | None = None) -> DataFrame:
    """Combinations of closed value lists in product order, at most ``cap``.

    The i-th combination is read off the digits of i in mixed radix, so the
    grid is a projection over a range and no join is needed.
    """
    total = prod(len(v) for v in dims.values())
    grid = spark.range(min(cap, total) if cap is not None else total)
    stride = total
    for name, values in dims.items():
        stride //= len(values)
        digit = F.floor(F.col("id") / stride) % len(values)
        grid = grid.withColumn(name, F.element_at(F.array(*[F.lit(v) for v in values]), (digit + 1).cast("int")))
    return grid.withColumnRenamed("id", "combo")


def with_fingerprint(grid: DataFrame, template: str, slots: list[str]) -> DataFrame:
    """Render the prompt of each combination and keep the first of equal prompts."""
    prompt = fill(template, {s: F.col(s).cast("string") for s in slots})
    grid = grid.withColumn("prompt", prompt).withColumn("fp", F.md5("prompt"))
    first = grid.groupBy("fp").agg(F.min("combo").alias("combo"))
    return grid.join(first.select("combo"), "combo", "left_semi")


def cross_models(prompts: DataFrame, models: list[str]) -> DataFrame:
    """Every prompt with every model of a closed list."""
    return prompts.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def render_plan(plan: DataFrame, templates=None) -> DataFrame:
    """Generation prompt per plan row; templates rotate in key order."""
    templates = templates or PLAN_TEMPLATES
    desc = lookup("class_label", domain.DESCRIPTIONS, domain.DEFAULT_CLASS_HINT)
    second = lookup("secondary_label", domain.DESCRIPTIONS, "")
    slots = {
        "class_label": F.col("class_label"),
        "class_description": desc,
        "sender_profile": F.col("sender_profile"),
        "tone": F.col("tone"),
        "channel": F.col("channel"),
        "language": F.when(F.col("language") == "en", "en inglés (English)").otherwise("en español"),
        "length_hint": lookup("email_length", domain.LENGTH_HINTS, domain.DEFAULT_LENGTH_HINT),
        "noise_hint": lookup("noise_level", domain.NOISE_HINTS, domain.DEFAULT_NOISE_HINT),
        "secondary_hint": F.when(
            F.col("is_multi_intent") & F.col("secondary_label").isNotNull(),
            F.concat(F.lit("Intención secundaria: "), F.col("secondary_label"), F.lit(" ("), second, F.lit(").")),
        ).otherwise(""),
        "ambiguity_hint": F.when(F.col("is_ambiguous"), "Debe ser ambiguo.").otherwise(""),
        "is_spam": F.col("is_spam").cast("string"),
        "is_multi_intent": F.col("is_multi_intent").cast("string"),
        "is_ambiguous": F.col("is_ambiguous").cast("string"),
        "secondary_label": F.coalesce("secondary_label", F.lit("N/A")),
    }
    ranked = position_rank(plan, [], "email_id", rank_col="__rank").drop("__rank_total")
    turn = (F.col("__rank") - 1) % len(templates)
    prompt, name = None, F.concat(F.lit("plantilla_"), (turn + 1).cast("string"))
    for i, t in enumerate(templates):
        prompt = F.when(turn == i, fill(t, slots)) if prompt is None else prompt.when(turn == i, fill(t, slots))
    return ranked.withColumn("template_id", name).withColumn("prompt", prompt).drop("__rank")
