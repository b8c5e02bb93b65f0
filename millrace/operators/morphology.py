"""Morphological lexicons, and how tokens agree with them. A lexicon has form, morphemes array<string>."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as t
from millrace.sources.storage import small


def boundaries(pieces: Column) -> Column:
    """Inner boundaries of pieces put in a row, in characters, ascending."""
    ends = t.running(F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: F.length(x)))
    return F.when(F.size(pieces) > 1, ends).otherwise(F.array().cast("array<int>"))


def merge_lexicons(lexicons: Sequence[DataFrame]) -> DataFrame:
    """One row a form: the one of more morphemes; of equals that of the earlier lexicon, then the smaller morphemes."""
    every = None
    for i, lexicon in enumerate(lexicons):
        own = lexicon.select("form", "morphemes").withColumn("_p", F.lit(i))
        every = own if every is None else every.unionByName(own)
    best = F.min(F.struct((-F.size("morphemes")).alias("n"), "_p", "morphemes")).alias("b")
    return every.groupBy("form").agg(best).select("form", F.col("b.morphemes").alias("morphemes"))


def lookup(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """words (word, ...) plus morphemes, [word] for what isn't listed. Lexicons of bounded size are broadcast."""
    side = small(lexicon.select(F.col("form").alias("word"), "morphemes"), F.octet_length("word") * 2 + 64)
    return words.join(side, "word", "left").withColumn("morphemes", F.coalesce("morphemes", F.array("word")))


def form_stats(rows: DataFrame) -> DataFrame:
    """rows (form, morphemes, pieces) -> form, valid, tp, predicted, gold: boundaries in both, in pieces, in morphemes.

    A form whose pieces in a row aren't the form isn't valid and counts 0 throughout.
    """
    valid = F.coalesce(F.array_join("pieces", "") == F.col("form"), F.lit(False))
    n = lambda c: F.when(valid, F.size(c)).otherwise(0).cast("long")
    p, g = boundaries(F.col("pieces")), boundaries(F.col("morphemes"))
    return rows.select("form", valid.alias("valid"), n(F.array_intersect(p, g)).alias("tp"), n(p).alias("predicted"), n(g).alias("gold"))


def morph_score(stats: DataFrame) -> DataFrame:
    """Precision, recall and F1 over all boundaries of valid forms, and the share of valid forms; 0 where undefined."""
    over = lambda a, b: F.round(F.coalesce(F.when(b > 0, a / b), F.lit(0.0)), 6)
    s = F.sum
    return stats.agg(over(s("tp"), s("predicted")).alias("precision"), over(s("tp"), s("gold")).alias("recall"), over(2 * s("tp"), s("predicted") + s("gold")).alias("f1"), over(F.count_if("valid"), F.count(F.lit(1))).alias("coverage"))


def segment_distance(rows: DataFrame) -> DataFrame:
    """rows (form, morphemes, pieces) plus edit: the Levenshtein distance of the two lists, a segment being one symbol."""

    def one(a: Sequence[str], b: Sequence[str]) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    @F.pandas_udf("long")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(list(x) if x is not None else [], list(y) if y is not None else []) for x, y in zip(a, b)], dtype="int64")

    return rows.withColumn("edit", distance("morphemes", "pieces"))


def grouped_pairs(rows: DataFrame, keys: str, most: int = 200, seed: int = 0) -> DataFrame:
    """key, a, b: all pairs of forms a < b that share an element of `keys`, for keys of at most `most` pairs; `most` distinct
    ones of the others, drawn by hash from all pairs of the key."""
    own = rows.select("form", F.explode(F.array_distinct(keys)).alias("key")).distinct()
    own = own.withColumn("j", F.row_number().over(Window.partitionBy("key").orderBy("form")).cast("long") - 1)
    total = own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.expr("n * (n - 1) div 2").alias("total"))
    every = F.sequence(F.lit(0).cast("long"), F.col("total") - 1)
    mixed = lambda x: F.xxhash64(F.lit(seed), F.col("key"), x)
    dealt = F.transform(F.array_sort(F.transform(every, lambda x: F.struct(mixed(x).alias("h"), x.alias("x")))), lambda p: p["x"])
    drawn = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(8 * most)), lambda i: F.pmod(mixed(i), F.col("total"))))
    picked = F.when(F.col("total") <= most, every).when(F.col("total") <= 8 * most, F.slice(dealt, 1, most)).otherwise(F.slice(drawn, 1, most))
    # Pair number x of ranks i < j is j * (j - 1) / 2 + i; the root may be one off.
    j = F.floor((F.sqrt(8 * F.col("x") + 1) + 1) / 2)
    pairs = total.select("key", F.explode(picked).alias("x")).withColumn("j", j)
    pairs = pairs.withColumn("j", F.expr("CASE WHEN j * (j - 1) div 2 > x THEN j - 1 WHEN j * (j + 1) div 2 <= x THEN j + 1 ELSE j END"))
    pairs = pairs.withColumn("i", F.expr("x - j * (j - 1) div 2"))
    one, two = own.select("key", F.col("j").alias("i"), F.col("form").alias("a")), own.select("key", "j", F.col("form").alias("b"))
    return pairs.join(one, ["key", "i"]).join(two, ["key", "j"]).select("key", "a", "b")


def consistency(rows: DataFrame, most: int = 200, seed: int = 0) -> DataFrame:
    """rows (form, morphemes, pieces) -> precision P(shared morpheme | shared piece), recall the reverse, f1."""
    shared = rows.groupBy("form").agg(F.first("morphemes").alias("m"), F.first("pieces").alias("p"))

    def rate(keys: str, other: str) -> DataFrame:
        p = grouped_pairs(rows, keys, most, seed).select("a", "b").distinct()
        left, right = shared.select(F.col("form").alias("a"), F.col(other).alias("x")), shared.select(F.col("form").alias("b"), F.col(other).alias("y"))
        return p.join(left, "a").join(right, "b").agg(F.coalesce(F.avg(F.arrays_overlap("x", "y").cast("double")), F.lit(0.0)).alias("v"))

    both = rate("pieces", "m").select(F.col("v").alias("precision")).crossJoin(rate("morphemes", "p").select(F.col("v").alias("recall")))  # one row each
    total = F.col("precision") + F.col("recall")
    return both.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def inventory(lexicon: DataFrame) -> DataFrame:
    """morpheme, n, n_initial, n_final: how often it occurs, begins a form, ends one."""
    rows = lexicon.select(F.posexplode("morphemes").alias("i", "morpheme"), F.size("morphemes").alias("size"))
    return rows.groupBy("morpheme").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("i") == 0).alias("n_initial"), F.count_if(F.col("i") == F.col("size") - 1).alias("n_final"))


def collisions(lexicon: DataFrame) -> DataFrame:
    """form, n: forms of more than one segmentation, and how many they have."""
    return lexicon.groupBy("form").agg(F.count_distinct("morphemes").alias("n")).filter("n > 1")
