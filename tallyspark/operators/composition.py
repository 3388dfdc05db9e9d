"""Recombined and role-swapped scenarios, prompts, and what is measured on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import power_relation
from . import sequence
from .hypothesis import mcnemar
from .resampling import hash_pick

PROMPTS = {
    "plain": 'Situation: {situation}\n{speaker_role} to {listener_role}: "{utterance}"\nName the label.',
    "perspective": 'Take the view of the {speaker_role}.\nSituation: {situation}\n{speaker_role} to {listener_role}: "{utterance}"\nName the label.',
    "patterns": 'Say first which indirect pattern fits, if any.\nSituation: {situation}\n{speaker_role} to {listener_role}: "{utterance}"\nName the label.',
    "counterfactual": 'Would this fit if it were meant sincerely?\nSituation: {situation}\n{speaker_role} to {listener_role}: "{utterance}"\nName the label.',
}


def render(template, **fields):
    """A Column that fills {name} places of a template (a string or Column) with columns."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, c in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return out


def rendered_prompts(scenarios: DataFrame, template: str = "plain", templates: dict[str, str] = PROMPTS) -> DataFrame:
    """(scenario_id, prompt). ``scenarios``: scenario_id, situation, utterance, speaker_role, listener_role."""
    if template not in templates:
        raise ValueError(f"unknown template: {template}")
    names = ("situation", "speaker_role", "listener_role", "utterance")
    return scenarios.select("scenario_id", render(templates[template], **{n: n for n in names}).alias("prompt"))


def prompt_fanout(scenarios: DataFrame, templates: dict[str, str] = PROMPTS) -> DataFrame:
    """(scenario_id, intervention, prompt): each scenario under each template; an explode of a literal, no join."""
    names = ("situation", "speaker_role", "listener_role", "utterance")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("intervention"), F.lit(t).alias("template")) for k, t in templates.items()])).alias("t")
    x = scenarios.select("*", each)
    return x.select("scenario_id", F.col("t.intervention").alias("intervention"), render(F.col("t.template"), **{n: n for n in names}).alias("prompt"))


def swap_roles(utterances: DataFrame) -> DataFrame:
    """(scenario_id, speaker_role, listener_role, original_power, swapped_power), roles swapped."""
    return utterances.select(
        "scenario_id",
        F.col("listener_role").alias("speaker_role"),
        F.col("speaker_role").alias("listener_role"),
        power_relation("speaker_role", "listener_role", "composition").alias("original_power"),
        power_relation("listener_role", "speaker_role", "composition").alias("swapped_power"),
    )


def _numbered(strata: DataFrame) -> DataFrame:
    """(subtype, id, i): the place of each id in its stratum from 0, numbered by ranges of ids."""
    numbered = sequence.numbered(strata.select("subtype", "id"), "subtype", "id")
    return numbered.select("subtype", "id", (F.col("position") - 1).cast("bigint").alias("i"))


def stratified_recombinations(strata: DataFrame, per_pair: int = 10, seed: int = 42) -> DataFrame:
    """(source_subtype, context_subtype, draw, utterance_id, context_id): per_pair draws for each ordered pair of strata.

    The utterance comes from the first stratum and the context from the second.
    """
    numbered = _numbered(strata)
    sizes = numbered.groupBy("subtype").agg(F.count("*").alias("n"))
    a, b = sizes.select(F.col("subtype").alias("source_subtype"), F.col("n").alias("na")), sizes.select(F.col("subtype").alias("context_subtype"), F.col("n").alias("nb"))
    grid = a.join(b, F.col("source_subtype") != F.col("context_subtype")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(per_pair - 1))))
    which = lambda side: F.concat_ws("/", "source_subtype", "context_subtype", F.lit(side))
    grid = grid.select("source_subtype", "context_subtype", "draw", hash_pick(seed, which("u"), F.col("draw").cast("string"), F.col("na")).alias("ui"), hash_pick(seed, which("c"), F.col("draw").cast("string"), F.col("nb")).alias("ci"))
    return _resolve(grid, numbered)


def _resolve(grid: DataFrame, numbered: DataFrame) -> DataFrame:
    u = numbered.select(F.col("subtype").alias("s1"), F.col("i").alias("i1"), F.col("id").alias("utterance_id"))
    c = numbered.select(F.col("subtype").alias("s2"), F.col("i").alias("i2"), F.col("id").alias("context_id"))
    j = grid.join(u, (F.col("source_subtype") == F.col("s1")) & (F.col("ui") == F.col("i1"))).join(c, (F.col("context_subtype") == F.col("s2")) & (F.col("ci") == F.col("i2")))
    return j.select("source_subtype", "context_subtype", "draw", "utterance_id", "context_id")


def recombinations(strata: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """(source_subtype, context_subtype, draw, utterance_id, context_id): n draws with replacement of two different strata."""
    numbered = _numbered(strata)
    sizes = numbered.groupBy("subtype").agg(F.count("*").alias("n"))
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct("subtype", "n"))).alias("s"))  # one entry a stratum, of which there are as many as subtypes
    draws = strata.sparkSession.range(n).select(F.col("id").alias("draw")).join(F.broadcast(listed)).where(F.size("s") >= 2)
    k = F.size("s").cast("bigint")
    d = F.col("draw").cast("string")
    first = hash_pick(seed, F.lit("first"), d, k)
    step = hash_pick(seed, F.lit("second"), d, k - 1) + 1
    at = lambda i: F.element_at("s", (i + 1).cast("int"))
    picked = draws.select(F.col("draw").cast("int").alias("draw"), at(first).alias("a"), at((first + step) % k).alias("b"))
    d = F.col("draw").cast("string")
    grid = picked.select(F.col("a.subtype").alias("source_subtype"), F.col("b.subtype").alias("context_subtype"), "draw", hash_pick(seed, F.lit("u"), d, F.col("a.n")).alias("ui"), hash_pick(seed, F.lit("c"), d, F.col("b.n")).alias("ci"))
    return _resolve(grid, numbered)


def _rates(rows: DataFrame, by: str, **of: str) -> DataFrame:
    """Means of 0/1 columns by a column and overall; rows are summed by it before the overall row is made."""
    cells = rows.groupBy(by).agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{name}") for name, c in of.items()])
    g = cells.groupingSets([[by], []], by).agg(F.grouping_id(by).alias("overall"), F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), *[F.sum(f"__{name}").alias(f"__{name}") for name in of])
    return g.select("overall", by, "n", *[F.try_divide(f"__{name}", "n").alias(name) for name in of])


def compositional(recombined: DataFrame) -> DataFrame:
    """Rates by pair u->c of strata and overall.

    ``recombined``: source_subtype, context_subtype, original_correct (0/1), predicted, utterance_gold, context_gold.
    A recombined prediction is right if it is either label; the score is right / original (0 if that is 0).
    """
    u, c = (F.col("predicted") == F.col("utterance_gold")), (F.col("predicted") == F.col("context_gold"))
    x = recombined.select(F.concat("source_subtype", F.lit("->"), "context_subtype").alias("pair"), "original_correct", u.cast("int").alias("u"), c.cast("int").alias("c"), (u | c).cast("int").alias("e"))
    g = _rates(x, "pair", original_accuracy="original_correct", utterance_rate="u", context_rate="c", recombined_accuracy="e")
    return g.withColumn("drop", F.col("original_accuracy") - F.col("recombined_accuracy")).withColumn("score", F.coalesce(F.try_divide("recombined_accuracy", "original_accuracy"), F.lit(0.0)))


def role_swap_effects(pairs: DataFrame) -> DataFrame:
    """Accuracy before and after the swap and change rate, by transition a->b and overall.

    ``pairs``: original_power, swapped_power, original, swapped, truth.
    """
    x = pairs.select(F.concat("original_power", F.lit("->"), "swapped_power").alias("transition"), (F.col("original") == F.col("truth")).cast("int").alias("a"), (F.col("swapped") == F.col("truth")).cast("int").alias("b"), (F.col("original") != F.col("swapped")).cast("int").alias("ch"))
    g = _rates(x, "transition", original_accuracy="a", swapped_accuracy="b", change_rate="ch")
    return g.withColumn("drop", F.col("original_accuracy") - F.col("swapped_accuracy"))


def intervention_effects(results: DataFrame) -> DataFrame:
    """By intervention: n, baseline and treated accuracy, improvement, discordant counts and McNemar's chi2.

    ``results``: intervention, baseline (0/1), treated (0/1), joined by scenario before.
    """
    b, c = (F.col("baseline") == 1) & (F.col("treated") == 0), (F.col("baseline") == 0) & (F.col("treated") == 1)
    g = results.groupBy("intervention").agg(F.count("*").alias("n"), F.avg("baseline").alias("baseline_accuracy"), F.avg("treated").alias("treated_accuracy"), F.sum(b.cast("int")).alias("b"), F.sum(c.cast("int")).alias("c"))
    gap = F.abs(F.col("b") - F.col("c")) - 1
    return g.withColumn("improvement", F.col("treated_accuracy") - F.col("baseline_accuracy")).withColumn("chi2", F.coalesce(F.try_divide((gap * gap).cast("double"), F.col("b") + F.col("c")), F.lit(0.0)))


__all__ = ["compositional", "intervention_effects", "mcnemar", "prompt_fanout", "recombinations", "rendered_prompts", "role_swap_effects", "stratified_recombinations", "swap_roles"]
