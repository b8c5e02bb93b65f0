"""Converters of task records to examples. Records are rows; a missing optional column counts as null."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as t

#: Spellings of the three sentiment labels.
SENTIMENT = {"negative": "negative", "neutral": "neutral", "positive": "positive", "neg": "negative", "neu": "neutral", "pos": "positive"}


def col(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None)


def full(c: Column) -> Column:
    """The value, null if it is an empty string."""
    return F.nullif(c.cast("string"), F.lit(""))


def example_id(rows: DataFrame, dataset: str, names: Sequence[str] = ("id", "idx")) -> Column:
    """uid, else the first of `names` that has a value (as it is if it holds ':', else dataset:value), else source:doc_id;
    null if the record has none of these."""
    own = [full(col(rows, n)) for n in names]
    named = [F.when(o.contains(":"), o).otherwise(F.concat_ws(":", F.lit(dataset), o)) for o in own]
    return F.coalesce(full(col(rows, "uid")), *(F.when(o.isNotNull(), n) for o, n in zip(own, named)), t.uid(F.coalesce(col(rows, "source").cast("string"), F.lit(dataset)), col(rows, "doc_id")))


def allowed(label: Column, allow: Sequence[str] | None) -> Column:
    """Every label is allowed by None; an empty one always is."""
    return F.lit(True) if allow is None else F.coalesce(label.cast("string").isin(*allow, ""), F.lit(False))


def nli(rows: DataFrame, dataset: str, allow: Sequence[str] | None = None) -> DataFrame:
    """id, premise, hypothesis, label; rows that lack premise or hypothesis go."""
    label = F.coalesce(col(rows, "label").cast("string"), F.lit(""))
    kept = rows.filter(F.col("premise").isNotNull() & F.col("hypothesis").isNotNull())
    return kept.select(example_id(rows, dataset).alias("id"), "premise", "hypothesis", label.alias("label")).filter(allowed(F.col("label"), allow))


def boolq(rows: DataFrame, dataset: str) -> DataFrame:
    """id, passage (else paragraph), question, label (false if it can't be read)."""
    passage = F.coalesce(full(col(rows, "passage")), full(col(rows, "paragraph")), F.lit(""))
    return rows.select(example_id(rows, dataset).alias("id"), passage.alias("passage"), F.coalesce("question", F.lit("")).alias("question"), _flag(rows))


def _flag(rows: DataFrame) -> Column:
    return F.coalesce(t.coerce_bool(col(rows, "label")), F.lit(False)).alias("label")


def wsc(rows: DataFrame, dataset: str) -> DataFrame:
    """id, text, span1, span2 (start, end in words, text), label; target is a struct of span1_text, span1_index, ..."""

    def span(k: int) -> Column:
        text, at = F.coalesce(F.col(f"target.span{k}_text"), F.lit("")), F.coalesce(F.col(f"target.span{k}_index").cast("int"), F.lit(0))
        return F.struct(at.alias("start"), (at + F.size(t.spaced(text))).alias("end"), text.alias("text")).alias(f"span{k}")

    return rows.select(example_id(rows, dataset).alias("id"), F.coalesce("text", F.lit("")).alias("text"), span(1), span(2), _flag(rows))


def wic(rows: DataFrame, dataset: str) -> DataFrame:
    return rows.select(example_id(rows, dataset).alias("id"), *(F.coalesce(col(rows, c).cast("string"), F.lit("")).alias(c) for c in ("sentence1", "sentence2", "word")), _flag(rows))


def copa(rows: DataFrame, dataset: str) -> DataFrame:
    """id, premise, choice1, choice2, question ("cause" if empty), label (0 if it can't be read)."""
    texts = [F.coalesce(col(rows, c).cast("string"), F.lit("")).alias(c) for c in ("premise", "choice1", "choice2")]
    label = F.coalesce(col(rows, "label").cast("string").try_cast("int"), F.lit(0)).alias("label")
    return rows.select(example_id(rows, dataset).alias("id"), *texts, F.coalesce(full(col(rows, "question")), F.lit("cause")).alias("question"), label)


def multirc(rows: DataFrame, dataset: str) -> DataFrame:
    """rows (idx, passage: text and questions of question, idx, answers of text, idx, label) -> a boolq row an answer."""
    q = rows.select("idx", F.col("passage.text").alias("passage"), F.posexplode("passage.questions").alias("qi", "q"))
    a = q.select("idx", "passage", F.coalesce("q.idx", "qi").alias("qi"), "q.question", F.posexplode("q.answers").alias("ai", "a"))
    key = F.format_string("%s:%s-q%s-a%s", F.lit(dataset), "idx", "qi", F.coalesce("a.idx", "ai"))
    question = F.trim(F.concat(F.coalesce("question", F.lit("")), F.lit("\n"), F.coalesce("a.text", F.lit(""))))
    return a.select(key.alias("id"), F.coalesce("passage", F.lit("")).alias("passage"), F.regexp_replace(question, r"^\s+|\s+$", "").alias("question"), F.coalesce(t.coerce_bool(F.col("a.label")), F.lit(False)).alias("label"))


def spans(rows: DataFrame, dataset: str, allow: Sequence[str] | None = None) -> DataFrame:
    """id, text, spans (start, end, label) of rows that have spans; spans of other labels go, their document stays."""
    kept = F.filter("spans", lambda s: F.lit(True) if allow is None else s["label"].isin(*allow))
    return rows.filter(F.col("spans").isNotNull()).select(example_id(rows, dataset).alias("id"), "text", kept.alias("spans"))


def sentiment_label(*places: Column) -> Column:
    """The first place that has a value, in the three classes; null if it isn't known."""
    raw = F.lower(F.trim(F.coalesce(*map(full, places))))
    return F.element_at(F.create_map(*(F.lit(x) for kv in SENTIMENT.items() for x in kv)), raw)


def sentiment(rows: DataFrame, dataset: str, allow: Sequence[str] | None = None) -> DataFrame:
    """id, text, label from label, sentiment, then those of metadata (a map); rows of unknown label or no text go."""
    places = [col(rows, "label"), col(rows, "sentiment")]
    if "metadata" in rows.columns:
        places += [F.col("metadata")["label"], F.col("metadata")["sentiment"]]
    out = rows.select(example_id(rows, dataset).alias("id"), "text", sentiment_label(*places).alias("label"))
    return out.filter("label is not null and text is not null").filter(allowed(F.col("label"), allow))


def assign_splits(examples: DataFrame, targets: Sequence[str] = ("train", "validation", "test"), held_out: bool = False, key: str = "id", bucket: Callable[[Column], Column] = t.blake_bucket) -> DataFrame:
    """examples plus split, from the key's bucket of 100 (BLAKE2s; t.hash_bucket is SHA-256): 70/15/15, held out 0/50/50. A split that isn't a target becomes train if
    that is one (never where held out), else the first target; so no row is lost."""
    allowed_ = [s for s in targets if not (held_out and s == "train")]
    if not allowed_:
        raise ValueError("no split to assign")
    own = bucket(F.col(key))
    raw = t.split_of(own, 0, 50) if held_out else t.split_of(own)
    return examples.withColumn("split", F.when(raw.isin(*allowed_), raw).otherwise("train" if "train" in allowed_ else allowed_[0]))
