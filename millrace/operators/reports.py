"""Queries over records of runs: funnels, shares, rankings, risks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import significance, stats


def io_counts(before: DataFrame, after: DataFrame, stage: str, step: int, dataset: str = "source") -> DataFrame:
    """step, stage, dataset, records_in, records_out: rows of each dataset before and after a stage, from partial sums."""
    one = before.select(F.col(dataset).cast("string").alias("dataset"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    two = after.select(F.col(dataset).cast("string").alias("dataset"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    own = one.unionByName(two).groupBy("dataset").agg(F.sum("i").alias("records_in"), F.sum("o").alias("records_out"))
    return own.select(F.lit(step).alias("step"), F.lit(stage).alias("stage"), "dataset", "records_in", "records_out")


def funnel(runs: DataFrame, stages: Sequence[str]) -> DataFrame:
    """step, stage, records_in, records_out, drop_rate of each of `stages`, in all datasets; nulls for one without a record."""
    named = runs.sparkSession.createDataFrame(list(enumerate(stages)), "step int, stage string")
    own = runs.groupBy("stage").agg(F.sum("records_in").alias("records_in"), F.sum("records_out").alias("records_out"))
    rate = F.when(F.col("records_in") > 0, F.round((F.col("records_in") - F.col("records_out")) / F.col("records_in"), 6))
    return named.join(own, "stage", "left").select("step", "stage", "records_in", "records_out", rate.alias("drop_rate"))


def mixture_shares(by_dataset: DataFrame) -> DataFrame:
    """dataset, words, share of corpus_stats() by source, the largest first."""
    return by_dataset.select(F.col("source").alias("dataset"), F.col("word_count").alias("words"), F.col("share_of_total_words").alias("share")).orderBy(F.desc("words"), "dataset")


def contamination_risk(task_runs: DataFrame, pretrain: DataFrame) -> DataFrame:
    """task, dataset, role, shared_sources of the latest run (by started) of each task and dataset whose source_keys hold names
    of pretrain (name); others aren't listed. Names are joined by ', ' in order."""
    latest = task_runs.groupBy("task", "dataset").agg(F.max_by(F.struct("role", "source_keys"), "started").alias("r")).select("task", "dataset", "r.role", F.explode(F.array_distinct("r.source_keys")).alias("name"))
    found = latest.join(pretrain.select("name").distinct(), "name", "left_semi")
    return found.groupBy("task", "dataset", "role").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("shared_sources"))


def top_rates(per: DataFrame, least: int = 50, k: int = 12) -> DataFrame:
    """dataset, n_embedded, n, rate of per (source, kind, n): the k datasets of at least `least` documents in which the largest
    share is embedded; ties by name."""
    own = per.groupBy(F.col("source").alias("dataset")).agg(F.sum(F.when(F.col("kind") == "embedded", F.col("n")).otherwise(0)).alias("n_embedded"), F.sum("n").alias("n"))
    return own.filter(F.col("n") >= least).withColumn("rate", F.round(F.col("n_embedded") / F.col("n"), 6)).orderBy(F.desc("rate"), "dataset").limit(k)


def label_distribution(examples: DataFrame, label: str | None = None, spans: str | None = None) -> DataFrame:
    """split, label, n: examples by label, or by each label of their spans (array of structs with label)."""
    labels = F.explode(F.transform(F.col(spans), lambda s: s["label"])) if spans else F.col(label)
    return examples.select("split", labels.alias("label")).withColumn("label", F.col("label").cast("string")).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def point_estimate(units: DataFrame, by: Sequence[str], combine: Callable[[Mapping[str, Column]], Column], parts: Sequence[str]) -> DataFrame:
    """by and value: combine(the sums of `parts`) of each group; 0 where it is undefined."""
    sums = units.groupBy(*by).agg(*(F.sum(p).alias(p) for p in parts))
    return sums.select(*by, F.round(F.coalesce(combine({p: F.col(p) for p in parts}).cast("double"), F.lit(0.0)), 6).alias("value"))


def ranking(points: DataFrame, by: Sequence[str], higher_is_better: bool = True) -> DataFrame:
    """points (by, run, value) plus rank, best first; ties by run."""
    return stats.ranked(points, by, [F.desc("value") if higher_is_better else F.asc("value"), F.asc("run")])


def pair_block(values: DataFrame, by: Sequence[str] = (), level: float = 0.95, alpha: float = 0.05) -> DataFrame:
    """by, a, b, median, low, high, p, p_holm, significant of all runs a < b of values (by, run, resample, value): differences
    in the same resample, Holm's correction over the pairs of a group."""
    d = significance.run_differences(values, by).withColumnRenamed("d", "value")
    keys = [*by, "a", "b"]
    middle = d.groupBy(*keys).agg(F.round(F.median("value"), 6).alias("median"))
    p = significance.two_sided_p(d, keys, "value").withColumn("id", F.concat_ws(":", "a", "b")).withColumn("fam", F.concat_ws(":", F.lit(""), *by))
    out = middle.join(significance.percentile_interval(d, keys, level=level), keys).join(stats.holm(p, "fam").drop("fam", "id"), keys)
    return out.withColumn("significant", F.col("p_holm") < alpha)


def vocabulary_seed(seed: int, vocab: int, track: int = 0) -> int:
    """The seed of a vocabulary's resamples (track 0), of its second track (1), of its pairs (2)."""
    return seed * 1_000_003 + vocab * 2 + (0, 1, 500_000)[track]


def compare_by_vocabulary(units: DataFrame, numerator: str, denominator: str, resamples: int = 2000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """units (vocab, run, unit, numerator, denominator) -> (vocab, run, value, std, low, high of each run; pair_block() by vocab).

    Each vocabulary has resamples of its own, which its runs share. One plan for each vocabulary, of which there are few."""
    every = None
    for vocab in sorted(r[0] for r in units.select("vocab").distinct().collect()):
        own = significance.bootstrap_ratios(units.filter(F.col("vocab") == vocab), numerator, denominator, resamples, vocabulary_seed(seed, vocab)).withColumn("vocab", F.lit(vocab).cast("long"))
        every = own if every is None else every.unionByName(own)
    points = point_estimate(units, ["vocab", "run"], lambda s: s[numerator] / s[denominator], [numerator, denominator])
    spread = every.groupBy("vocab", "run").agg(F.round(F.stddev_samp("value"), 6).alias("std"))
    runs = points.join(spread, ["vocab", "run"]).join(significance.percentile_interval(every, ["vocab", "run"]), ["vocab", "run"])
    return runs, pair_block(every, ["vocab"])
