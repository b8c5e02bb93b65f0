"""Inflected forms cut into stem and suffix along their lemma, and what lexicons of such forms are asked for."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vowels that come and go, classes of words that aren't inflected, and consonants that alternate at the end of
#: a stem, in the order in which they are tried.
VOWELS = "aeiou"
INDECLINABLE = "SCQIY"
ALTERNATIONS = [("sk", "šč"), ("st", "šč"), ("zg", "žj"), ("k", "č"), ("k", "c"), ("g", "ž"), ("g", "z"), ("h", "š"), ("h", "s"), ("c", "č"), ("z", "ž"), ("s", "š"), ("t", "č"), ("d", "j"), ("l", "lj"), ("n", "nj")]
#: What may begin the rest of the form and that of the lemma and still count as one stem.
CHANGES = [pair for base, other in ALTERNATIONS for pair in ((other, base), (base, other))]


def stem_length(form: str, lemma: str) -> int:
    """How many characters of the form belong to the stem that it shares with the lemma, both in lower case.

    Equal beginnings are taken off both; then an alternation, a vowel that only the lemma has, or one that only the form has,
    whichever first applies; and so on until nothing does."""
    rest, other = form, lemma
    while rest and other:
        if same := len(os.path.commonprefix([rest, other])):
            rest, other = rest[same:], other[same:]
        elif pair := next((c for c in CHANGES if rest.startswith(c[0]) and other.startswith(c[1])), None):
            rest, other = rest[len(pair[0]) :], other[len(pair[1]) :]
        elif other[0] in VOWELS and other[1:2] == rest[0]:
            other = other[1:]
        elif rest[0] in VOWELS and rest[1:2] == other[0]:
            rest = rest[1:]
        else:
            break
    return len(form) - len(rest)


def segment(form: str, lemma: str, msd: str | None = None, least: int = 2) -> tuple[list[str], list[str]]:
    """(morphemes, labels) of a form. Uninflected words, forms of several words and forms that are all stem are one `stem`; a
    shared stem under `least` characters isn't trusted: one `whole`."""
    if (msd and msd[0].upper() in INDECLINABLE) or " " in form:
        return [form], ["stem"]
    n = stem_length(form.lower(), lemma.lower())
    if n >= len(form):
        return [form], ["stem"]
    return ([form], ["whole"]) if n < least else ([form[:n], form[n:]], ["stem", "suffix"])


def derive(entries: DataFrame, least: int = 2) -> DataFrame:
    """entries (lemma, forms array<struct<form, msd>>) -> form, morphemes, labels, lemma, msd, a row for each form. Entries
    without lemma and empty forms are skipped."""
    rows = entries.filter(F.coalesce("lemma", F.lit("")) != "").select("lemma", F.explode("forms").alias("f")).select("lemma", "f.form", "f.msd").filter(F.coalesce("form", F.lit("")) != "")

    @F.pandas_udf("morphemes array<string>, labels array<string>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for forms, lemmas, msds in batches:
            yield pd.DataFrame([segment(f, x, m, least) for f, x, m in zip(forms, lemmas, msds)], columns=["morphemes", "labels"])

    return rows.withColumn("s", cut("form", "lemma", "msd")).select("form", "s.morphemes", "s.labels", "lemma", "msd")


def reliable(lexicon: DataFrame) -> DataFrame:
    """Segmentations without the label `whole`."""
    return lexicon.filter(~F.array_contains("labels", "whole"))


def form_sample(lexicon: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n forms of the smallest hash, in the order of forms; the hash depends on the seed alone."""
    return lexicon.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), "form"), 256), "form").limit(n).orderBy("form")


def morpheme_budget(lexicon: DataFrame, n: int) -> DataFrame:
    """morpheme, n: the n most frequent morphemes of a lexicon; ties by the morpheme."""
    return lexicon.select(F.explode("morphemes").alias("morpheme")).groupBy("morpheme").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "morpheme").limit(n)


def valid_in_all(forms: DataFrame, runs: int) -> DataFrame:
    """form of forms (run, form, valid) that are valid in each of `runs` runs."""
    return forms.groupBy("form").agg(F.min(F.col("valid").cast("int")).alias("v"), F.count_distinct("run").alias("n")).filter((F.col("v") == 1) & (F.col("n") == runs)).select("form")


def encode_by_table(words: DataFrame, table: DataFrame) -> DataFrame:
    """words (word, rest array<string>) plus pieces: the table's (form, morphemes), else rest, what another tokenizer gives."""
    from millrace.operators.morphology import lookup

    found = lookup(words, table)
    return found.withColumn("pieces", F.when(F.size("morphemes") > 1, F.col("morphemes")).otherwise(F.col("rest"))).drop("morphemes")

