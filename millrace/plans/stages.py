"""Named stages over Parquet tables, each run recorded, and run again only where something before it changed."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Config = Mapping[str, object]


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[DataFrame, Config], DataFrame]
    defaults: Config = field(default_factory=dict)


def deep_merge(base: Config, over: Config) -> dict:
    """base with over's values; mappings are merged, anything else is replaced."""
    both = lambda k: isinstance(base.get(k), Mapping) and isinstance(over[k], Mapping)
    return {**base, **{k: deep_merge(base[k], over[k]) if both(k) else over[k] for k in over}}


def flatten(config: Config, prefix: str = "", most: int = 500) -> dict[str, str]:
    """Dotted names to values as strings of at most `most` characters (run tracking's limit)."""
    out: dict[str, str] = {}
    for k, v in config.items():
        out |= flatten(v, f"{prefix}{k}.", most) if isinstance(v, Mapping) else {f"{prefix}{k}": str(v)[:most]}
    return out


def config_hash(config: Config, extra: str = "") -> str:
    canonical = json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)
    return hashlib.sha256(f"{canonical}\0{extra}".encode()).hexdigest()


def check_overrides(stages: Sequence[Stage], overrides: Mapping[str, Config], datasets: Sequence[str]) -> None:
    """ValueError for overrides of unknown datasets, stages or settings."""
    known = {s.name: s.defaults for s in stages}
    for dataset, sections in overrides.items():
        if dataset not in datasets:
            raise ValueError(f"override of unknown dataset {dataset}")
        for name, config in sections.items():
            if name not in known:
                raise ValueError(f"override of unknown stage {name} for {dataset}")
            if odd := sorted(set(config) - set(known[name])):
                raise ValueError(f"override of unknown settings {odd} of {name} for {dataset}")


def with_settings(docs: DataFrame, stage: Stage, overrides: Mapping[str, Config], dataset: str = "source") -> DataFrame:
    """docs plus a column of each of the stage's settings, by dataset: thresholds become columns, no dataset a run of its own.

    The joined side has a row for each overridden dataset.
    """
    rows = [{dataset: k, **{f"_{n}": v.get(stage.name, {}).get(n) for n in stage.defaults}} for k, v in overrides.items() if stage.name in v]
    if rows:
        schema = ", ".join([f"`{dataset}` string", *(f"`_{n}` {'string' if isinstance(v, str) else 'double'}" for n, v in stage.defaults.items())])
        table = docs.sparkSession.createDataFrame([tuple(None if x is None else x if isinstance(x, str) else float(x) for x in r.values()) for r in rows], schema)
        docs = docs.join(F.broadcast(table), dataset, "left")
    else:
        docs = docs.select("*", *(F.lit(None).alias(f"_{n}") for n in stage.defaults))
    return docs.select(*[c for c in docs.columns if c not in {f"_{n}" for n in stage.defaults}], *(F.coalesce(f"_{n}", F.lit(v)).alias(n) for n, v in stage.defaults.items()))


def run_stages(spark: SparkSession, docs: DataFrame, stages: Sequence[Stage], folder: str, config: Mapping[str, Config] | None = None, fingerprint: str = "", force: Sequence[str] = (), dataset: str = "source") -> DataFrame:
    """Run stages in order, each from the table that the one before wrote to <folder>/<k>_<name>.

    A stage whose record (in <folder>/_runs, a local or mounted folder) has the hash of its settings, of all settings before
    it and of the input's fingerprint isn't run again; forcing one runs all after it too. Counts by dataset are recorded.
    """
    from millrace.sources.storage import write_json

    config, before, stale = config or {}, fingerprint, False
    runs = f"{folder.removeprefix('file://')}/_runs"
    os.makedirs(runs, exist_ok=True)
    counts = lambda df: {r[0]: r[1] for r in df.groupBy(dataset).count().toLocalIterator()}  # noqa: E731 # a row a dataset
    for k, stage in enumerate(stages):
        own = deep_merge(stage.defaults, config.get(stage.name, {}))
        before, at, record = config_hash({stage.name: own}, before), f"{folder}/{k:02d}_{stage.name}", f"{runs}/{k:02d}_{stage.name}.json"
        stale = stale or stage.name in force or not os.path.exists(record) or json.load(open(record, encoding="utf-8"))["config_hash"] != before
        if stale:
            n_in = counts(docs)
            stage.run(docs, own).write.mode("overwrite").parquet(at)
            write_json(record, {"stage": stage.name, "step": k, "config_hash": before, "config": own, "records_in": n_in, "records_out": counts(spark.read.parquet(at))})
        docs = spark.read.parquet(at)
    return docs


def funnel(spark: SparkSession, folder: str) -> DataFrame:
    """step, stage, dataset, records_in, records_out, drop_rate of the recorded runs."""
    runs = f"{folder.removeprefix('file://')}/_runs"
    rows = []
    for name in sorted(os.listdir(runs)):
        with open(f"{runs}/{name}", encoding="utf-8") as f:
            r = json.load(f)
        rows += [(r["step"], r["stage"], d, n, r["records_out"].get(d, 0)) for d, n in r["records_in"].items()]
    out = spark.createDataFrame(rows, "step int, stage string, dataset string, records_in long, records_out long")
    return out.withColumn("drop_rate", F.when(F.col("records_in") > 0, F.round((F.col("records_in") - F.col("records_out")) / F.col("records_in"), 6)))


def fingerprint(spark: SparkSession, path: str) -> str:
    """A hash of name, size and time of change of all files under a path, by the file system's listing alone."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, rows = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        rows.append(f"{f.getPath().toString()}\t{f.getLen()}\t{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(rows)).encode()).hexdigest()


def recount(spark: SparkSession, folder: str, dataset: str = "source") -> DataFrame:
    """step, stage, dataset, recorded, counted of the last output of each recorded stage, counted anew."""
    recorded = funnel(spark, folder).select("step", "stage", "dataset", F.col("records_out").alias("recorded"))
    out = None
    for r in recorded.select("step", "stage").distinct().collect():  # a row a stage
        n = spark.read.parquet(f"{folder}/{r['step']:02d}_{r['stage']}").groupBy(F.col(dataset).alias("dataset")).agg(F.count(F.lit(1)).alias("counted")).withColumn("step", F.lit(r["step"]))
        out = n if out is None else out.unionByName(n)
    return recorded.join(out, ["step", "dataset"], "left").select("step", "stage", "dataset", "recorded", F.coalesce("counted", F.lit(0)).alias("counted"))


def not_empty(datasets: DataFrame, upstream: DataFrame, dataset: str = "source") -> DataFrame:
    """The rows of datasets (dataset, ...) of which upstream has a row; the others have nothing to run on."""
    return datasets.join(upstream.select(F.col(dataset).alias("dataset")).distinct(), "dataset", "left_semi")


def each(datasets: Sequence[str], run: Callable[[str], object]) -> tuple[dict[str, object], dict[str, str]]:
    """(results, errors) of run(dataset) for each dataset; one that fails doesn't stop the others. Spark schedules the jobs."""
    results, errors = {}, {}
    for name in datasets:
        try:
            results[name] = run(name)
        except Exception as e:
            errors[name] = f"{type(e).__name__}: {e}"
    return results, errors


def track(spark: SparkSession, runs: str, digest: str, values: Mapping[str, str]) -> None:
    """Append a run's values to the table `runs`; the latest row of a digest counts, see tracked()."""
    spark.createDataFrame([(digest, dict(values))], "digest string, values map<string,string>").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(runs)


def tracked(spark: SparkSession, runs: str) -> DataFrame:
    """digest, values, at: the latest row of each digest."""
    return spark.read.parquet(runs).groupBy("digest").agg(F.max_by("values", "at").alias("values"), F.max("at").alias("at"))


def sweep(spark: SparkSession, backends: Sequence[str], vocabularies: Sequence[int], done: Sequence[str] = ()) -> DataFrame:
    """key, tokenizer, vocab of all pairs, <tokenizer>-<vocab>, without those that are done."""
    rows = [(f"{b}-{v}", b, v) for b in backends for v in vocabularies if f"{b}-{v}" not in set(done)]
    return spark.createDataFrame(rows, "key string, tokenizer string, vocab long")


def load_catalog(path: str, roles: Sequence[str] = ("pretrain", "benchmark", "lexicon")) -> dict[str, dict]:
    """Datasets of a JSON catalogue, <path>, with those of <path without suffix>.local.json merged in. ValueError for a role
    that isn't known."""
    with open(path, encoding="utf-8") as f:
        out = json.load(f)
    local = f"{os.path.splitext(path)[0]}.local.json"
    if os.path.exists(local):
        with open(local, encoding="utf-8") as f:
            out = deep_merge(out, json.load(f))
    if odd := sorted(k for k, v in out.items() if v.get("role", "pretrain") not in roles):
        raise ValueError(f"unknown role of {', '.join(odd)}")
    return out
