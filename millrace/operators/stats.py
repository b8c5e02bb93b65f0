"""Corpus statistics, sampling, rankings, tokenizer and significance measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as t
from millrace.operators.curate import STOP_WORDS
from millrace.sources.storage import settled, small

ALL_STOPS = sorted({w for ws in STOP_WORDS.values() for w in ws})


def content_words(docs: DataFrame, stops: Sequence[str] = ALL_STOPS) -> DataFrame:
    """docs plus n_content: lower-case words of two characters or more with a letter, not listed."""
    own = F.filter(t.words(F.lower("text")), lambda x: t.is_word(x) & ~x.isin(*stops))
    return docs.withColumn("n_content", F.size(own).cast("long"))


def corpus_stats(docs: DataFrame, by: str | None = None) -> DataFrame:
    """doc_count, word_count, avg_doc_words and share_of_total_words, in all or by a column (null: _unknown)."""
    counted = content_words(docs)
    name = [F.coalesce(F.col(by).cast("string"), F.lit("_unknown")).alias(by)] if by else []
    own = counted.groupBy(*name).agg(F.count(F.lit(1)).alias("doc_count"), F.coalesce(F.sum("n_content"), F.lit(0)).alias("word_count"))
    average = F.round(F.when(F.col("doc_count") > 0, F.col("word_count") / F.col("doc_count")).otherwise(0.0), 6).alias("avg_doc_words")
    if not by:
        return own.select("doc_count", "word_count", average)
    total = F.sum("word_count").over(Window.partitionBy())  # a row for each group, not for each document
    share = F.round(F.when(total > 0, F.col("word_count") / total).otherwise(0.0), 6).alias("share_of_total_words")
    return own.select(by, "doc_count", "word_count", average, share)


def word_freq_top_k(docs: DataFrame, k: int = 200) -> DataFrame:
    """The k most frequent content words; ties by the word."""
    own = docs.select(F.explode(t.words(F.lower("text"))).alias("word")).filter(t.is_word(F.col("word")) & ~F.col("word").isin(*ALL_STOPS))
    return own.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(k)


def dataset_to_domain(docs: DataFrame, dataset: str = "source", domain: str = "lang") -> DataFrame:
    return docs.groupBy(F.col(dataset).alias("dataset")).agg(F.when(F.min(domain) != F.max(domain), "_mixed").otherwise(F.min(domain)).alias("domain"))


def source_profile(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows, empty texts and missing required fields by source."""
    missing = [F.count_if(F.col(f).isNull() | (F.col(f).cast("string") == "")).alias(f"missing_{f}") for f in fields]
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty_text"), *missing)


def doc_units(docs: DataFrame) -> DataFrame:
    """doc_id, tokens, words, chars, bytes."""
    toks = t.split_words(F.col("text"))
    return docs.select("doc_id", F.size(toks).cast("long").alias("tokens"), F.size(F.filter(toks, lambda x: x.rlike(r"\p{L}"))).cast("long").alias("words"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))


def tokenizer_ratios(units: DataFrame) -> DataFrame:
    """Ratios of sums; 0 where the divisor is 0."""
    over = lambda a, b: F.round(F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(0.0), 6)
    return units.agg(over("tokens", "words").alias("fertility"), over("tokens", "bytes").alias("tokens_per_byte"), over("chars", "tokens").alias("chars_per_token"), F.sum("tokens").alias("ctc_total"))


def renyi_efficiency(counts: DataFrame, alpha: float = 2.5) -> DataFrame:
    """counts (n) -> Renyi entropy of order alpha over the log of the number of types, in [0, 1]; 0 for one type or none."""
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
    p = F.col("n") / F.col("total")
    if alpha == 1:
        h = -F.sum(p * F.ln(p))
    else:
        h = F.ln(F.sum(F.pow(p, F.lit(alpha)))) / (1 - alpha)
    own = counts.crossJoin(F.broadcast(total)).agg(h.alias("h"), F.first("types").alias("types"))  # total is one row
    return own.select(F.round(F.when(F.col("types") > 1, F.greatest(F.least(F.col("h") / F.ln("types"), F.lit(1.0)), F.lit(0.0))).otherwise(0.0), 6).alias("renyi_efficiency"))


def quotas(total: int, weights: Mapping[str, float], sources: Sequence[str]) -> dict[str, int]:
    """Each source's part of a total by weight (1 where none is given); sources of weight 0 or less have none."""
    own = {s: weights.get(s, 1.0) for s in sources}
    whole = sum(w for w in own.values() if w > 0)
    return {s: int(total * w / whole) for s, w in own.items() if w > 0}


def source_quota(docs: DataFrame, quota: int | Mapping[str, int], dataset: str = "source", of: str = "bytes") -> DataFrame:
    """docs plus before: documents of each source, in hash order, until their bytes (of="docs": they themselves, one at least)
    reach the quota; the one that crosses it is in. A mapping gives a quota for each source; sources without one go.

    Sums by source and by the first three digits of the hash, at most 4,096 rows a source, tell which of these parts are
    wanted; only their documents are shuffled, part by part.
    """
    key = F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256)
    size = (F.octet_length("text") if of == "bytes" else F.lit(1)).cast("long")
    least = F.lit(1 if of == "docs" else 0)
    if isinstance(quota, int):
        most = F.greatest(F.lit(quota), least)
    else:
        most = F.greatest(F.coalesce(*(F.when(F.col(dataset) == k, F.lit(v)) for k, v in quota.items()), F.lit(-1)), least) if quota else F.lit(-1)
        docs = docs.filter(F.col(dataset).isin(*quota))
    rows = docs.withColumns({"_k": key, "_size": F.coalesce(size, F.lit(0))}).withColumn("_part", F.substring("_k", 1, 3))
    parts = rows.groupBy(F.col(dataset).alias("_d"), "_part").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("_d").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    wanted = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).select("_d", F.col("_part").alias("_p"), "_before")
    met = rows.join(small(settled(wanted, "quota"), 64), F.col(dataset).eqNullSafe(F.col("_d")) & (F.col("_part") == F.col("_p"))).filter(F.col("_before") < most)
    within = Window.partitionBy("_d", "_part").orderBy("_k", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    out = met.withColumn("before", F.col("_before") + F.coalesce(F.sum("_size").over(within), F.lit(0))).filter(F.col("before") < most)
    return out.select(*docs.columns, "before")


def holm(tests: DataFrame, family: str, p: str = "p") -> DataFrame:
    """tests plus p_holm: the running maximum of (m - k) * p within a family, at most 1."""
    m = F.count(F.lit(1)).over(Window.partitionBy(family))
    w = Window.partitionBy(family).orderBy(p, "id")
    step = tests.withColumn("_s", (m - F.row_number().over(w) + 1) * F.col(p))
    return step.withColumn("p_holm", F.round(F.least(F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)), 6)).drop("_s")


def latest_by(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    """rows plus rank within `by`."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
