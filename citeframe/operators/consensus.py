"""Consensus over repeated answers, weighted run summary, run-over-run diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeframe import constants as C
from citeframe.functions.numbers import round_percent, round_score

GROUP_KEY = ["site_id", "run_id", "prompt_id"]
SIGNALS = [name for name, _ in C.STABILITY_SIGNALS]


def _seen_values(scores: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Distinct non-empty values of ``columns`` per key in first-seen order.

    Values are counted down to (key, column, value) before anything is collected, so the arrays
    only hold the few distinct names of a group.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in columns])
    long = scores.select(*keys, "answer_ord", F.explode(pairs).alias("p")).select(*keys, "answer_ord", "p.*")
    first = long.filter(F.length("value") > 0).groupBy(*keys, "kind", "value").agg(F.min("answer_ord").alias("seen"))
    return first.groupBy(*keys).agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("seen", "value")))).alias(c)
            for c in columns
        ]
    ).select(*keys, *[F.col(f"{c}.value").alias(c) for c in columns])


def _mixed(values: Column) -> Column:
    return F.when(F.size(values) == 1, values[0]).when(F.size(values) > 1, F.lit("mixed"))


def _joined(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.array_join(values, ", ")).otherwise(F.lit("unknown"))


def prompt_groups(scores: DataFrame) -> DataFrame:
    """Consensus per (site, run, prompt): strict majorities, consensus rates, medians, instability.

    A group is reduced by partial aggregation; the medians keep one counter per distinct score.
    """
    n = F.count("*")
    aggs = [n.alias("sample_count")]
    aggs += [F.sum(s).alias(f"_{s}") for s in SIGNALS]
    aggs += [F.median(m).alias(f"_{m}") for m in ("accuracy", "fact_coverage", "signal_alignment", "competitive_position_score")]
    aggs.append((F.sum("rank_coverage_rate") / n).alias("rank_coverage_rate"))
    fixed = ["category", "priority", "prompt", "expected_signal", "intent", "holdout"]
    aggs += [F.first(c).alias(c) for c in fixed]
    df = scores.groupBy(*GROUP_KEY).agg(*aggs)
    total = F.col("sample_count")
    rates = {s: round_percent(F.greatest(F.col(f"_{s}"), total - F.col(f"_{s}")) / total) for s in SIGNALS}
    df = df.withColumns({f"{s}_consensus": rate for s, rate in rates.items()})
    shaky = F.filter(
        F.array(*[F.when(F.col(f"{s}_consensus") < 100, F.lit(label)) for s, label in C.STABILITY_SIGNALS]),
        lambda x: x.isNotNull(),
    )
    mean = sum((F.col(f"{s}_consensus") / F.lit(100.0) for s in SIGNALS), F.lit(0.0)) / len(SIGNALS)
    out = {s: (F.col(f"_{s}") * 2 > total).cast("int") for s in SIGNALS}
    out |= {m: round_score(F.col(f"_{m}")) for m in ("accuracy", "fact_coverage", "signal_alignment", "competitive_position_score")}
    df = df.withColumns(out | {"unstable_signals": shaky, "consensus_rate": round_percent(mean)})
    note = F.concat(F.lit("Signals varied across repeated samples: "), F.array_join("unstable_signals", ", "), F.lit("."))
    df = df.withColumns(
        {
            "stable": F.size("unstable_signals") == 0,
            "spread_note": F.when((total > 1) & (F.size("unstable_signals") > 0), note),
        }
    )
    seen = _seen_values(scores, GROUP_KEY, ["provider", "model", "locale"])
    seen = seen.select(
        *GROUP_KEY, _joined(F.col("provider")).alias("provider"), _joined(F.col("model")).alias("model"),
        _mixed(F.col("locale")).alias("locale"),
    )
    kept = GROUP_KEY + fixed + ["sample_count", "stable", "consensus_rate", "spread_note", "unstable_signals"] + SIGNALS
    kept += ["accuracy", "fact_coverage", "signal_alignment", "competitive_position_score", "rank_coverage_rate"]
    return df.select(*kept).join(seen, GROUP_KEY, "left")


def eval_summary(groups: DataFrame, scores: DataFrame) -> DataFrame:
    """Priority-weighted rates per run over the prompts that are not held out."""
    keys = ["site_id", "run_id"]
    active = ~F.col("holdout")
    weight = F.lit(None).cast("double")
    for name, w in C.PRIORITY_WEIGHT.items():
        weight = F.when(F.col("priority") == name, w).otherwise(weight)
    weight = F.when(active, weight)

    def rate(column: str) -> Column:
        return F.coalesce(round_percent(F.sum(F.col(column) * weight) / F.sum(weight)), F.lit(0))

    position = F.col("competitive_position_score")
    known = F.when(position.isNotNull(), weight)
    repeated = active & (F.col("sample_count") > 1)
    n_repeated = F.count_if(repeated)
    n_stable = F.count_if(repeated & F.col("stable"))
    per_group = groups.groupBy(*keys).agg(
        F.count_if(active).alias("prompt_count"),
        F.count_if(F.col("holdout")).alias("holdout_prompt_count"),
        rate("mention").alias("mention_rate"),
        rate("accurate_mention").alias("accurate_mention_rate"),
        rate("owned_citation").alias("owned_citation_rate"),
        rate("trusted_citation").alias("trusted_citation_rate"),
        rate("recommendation").alias("recommendation_rate"),
        rate("misrepresented").alias("misrepresentation_rate"),
        rate("competitor_excluded").alias("competitor_exclusion_gap"),
        rate("fact_coverage").alias("fact_coverage_score"),
        rate("accuracy").alias("accuracy_rate"),
        rate("vavr").alias("vavr"),
        round_score(F.sum(position * known) / F.sum(known)).alias("competitive_position_score"),
        n_repeated.alias("repeated_prompt_count"),
        F.coalesce(round_percent(n_stable / F.nullif(n_repeated, F.lit(0))), F.lit(0)).alias("stable_prompt_rate"),
        (n_repeated - n_stable).alias("unstable_prompt_count"),
    )
    ranked = F.count_if(active & F.col("rank_position").isNotNull())
    per_answer = scores.groupBy(*keys).agg(
        F.count("*").alias("sample_count"),
        round_percent(ranked / F.greatest(F.count_if(active), F.lit(1))).alias("rank_coverage_rate"),
    )
    seen = _seen_values(scores, keys, ["locale"]).select(*keys, _mixed(F.col("locale")).alias("locale"))
    return per_group.join(per_answer, keys).join(seen, keys, "left")


def eval_diff(summaries: DataFrame, runs: DataFrame) -> DataFrame:
    """Ten metrics of each run next to those of the site's run before it in time; NULL for the first run.

    ``runs`` is (site_id, run_id, generated_at), one row per run; runs of one time follow in order of run_id, and
    a run without a time comes first.
    """
    summaries = summaries.join(runs.select("site_id", "run_id", "generated_at"), ["site_id", "run_id"], "left")
    w = Window.partitionBy("site_id").orderBy("generated_at", "run_id")
    rows = [
        F.struct(
            F.lit(i).alias("metric_ord"), F.lit(label).alias("label"), F.col(name).alias("current"),
            F.lag(name).over(w).alias("previous"),
        )
        for i, (name, label) in enumerate(C.DIFF_METRICS)
    ]
    df = summaries.select("site_id", "run_id", F.array(*rows).alias("m"))
    df = df.select("site_id", "run_id", F.explode("m").alias("m")).select("site_id", "run_id", "m.*")
    return df.withColumn("delta", F.col("current") - F.col("previous"))


def apply_eval(audit: DataFrame, summaries: DataFrame, mode: str = "eval") -> DataFrame:
    """Audit summary of each run with vavr, sample count and locale of its answers attached."""
    s = summaries.select("site_id", "run_id", F.col("vavr").alias("_vavr"), "sample_count", "locale")
    df = audit.join(s, "site_id", "left")
    return df.withColumns(
        {
            "vavr": F.coalesce("_vavr", "vavr"),
            "sample_count": F.coalesce("sample_count", F.lit(0)).cast("long"),
            "mode": F.when(F.col("run_id").isNotNull(), F.lit(mode)).otherwise(F.lit("audit")),
        }
    ).drop("_vavr")
