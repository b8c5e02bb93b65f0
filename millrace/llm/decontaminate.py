"""Benchmark decontamination with built-in functions only: size-partitioned MinHash containment search, exact check.

Texts become sets of five-word shingles (words: runs of letters and digits in lower case), held as 64-bit hashes; an item of
fewer words is one shingle of its own length, and documents then have shingles of that length too. An item counts as
contained in a document that holds at least `share` of the item's shingles, however long the document.

Search. Items are partitioned by size, class c holding 2**c to 2**(c+1) - 1 shingles. The signature of an item of class c
is its m(c) smallest hashes under one random order, with m(c) = floor((1 - share) * (2**(c+1) - 1)) + 1. A document that
lacks all of them lacks more than (1 - share) of the item; so every containing document meets the signature, whatever its
own size, and only documents that meet one are looked at again. Documents have no signature of a fixed length: an item of 12
shingles in a document of 2,000 has a Jaccard similarity of 0.006, so 256 MinHash values would agree in 1.5 places on
average, and in none for every fifth such pair.
Check. For each such pair, the item's shingles that are in the document are counted exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, key_rows, packed, small, unpacked
from millrace.llm.pii import let

WORDS, SHARE = 5, 0.8
#: Items of fewer words are found, but no document is dropped for them: such words stand in most texts.
LEAST_WORDS = 3


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def shingles(text: Column, sizes: Sequence[Column | int] = (WORDS,)) -> Column:
    """array<long> of the distinct shingles of a text, of each of the sizes; none of a size that it has too few words for."""

    def of(w: Column, size: Column | int) -> Column:
        size = F.lit(size) if isinstance(size, int) else size
        some = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, size)))
        return F.when((F.size(w) >= size) & (size > 0), some).otherwise(F.array().cast("array<bigint>"))

    return let(words_of(text), lambda w: F.array_distinct(F.concat(*(of(w, k) for k in sizes))))


def signatures(items: DataFrame, share: float = SHARE) -> DataFrame:
    """item_id, n, shingles -> item_id, hash: the m(c) smallest hashes of each item."""
    top = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1
    m = (F.floor((1 - F.lit(share)) * top + 1e-9) + 1).cast("int")
    order = F.transform("shingles", lambda h: F.struct(F.xxhash64(h, F.lit(11)).alias("by"), h.alias("h")))
    return items.select("item_id", F.explode(F.transform(F.slice(F.array_sort(order), F.lit(1), F.least(m, F.col("n"))), lambda x: x["h"])).alias("hash"))


def contained(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least_words: int = 1) -> DataFrame:
    """One row for each (document, item) with the item contained: _key, doc_id, item_id, n_shingles, n_shared, containment.

    docs: _key, doc_id, text (key_rows); benchmark: item_id, text. Items of fewer than least_words words, or none, are
    contained in nothing; null texts likewise. Equal item texts are each reported; null item_id is reported as null. Empty
    tables give no rows.
    """
    sized = benchmark.select("item_id", "text", F.least(F.size(words_of(F.col("text"))), F.lit(WORDS)).alias("k")).filter(F.col("k") >= max(1, min(least_words, WORDS)))
    items = cut(sized.select("item_id", "k", shingles(F.col("text"), [F.col("k")]).alias("shingles")).withColumn("n", F.size("shingles")).withColumn("item", F.xxhash64(F.array_sort("shingles"))))
    sizes = sorted({WORDS} | {r["k"] for r in items.select("k").distinct().collect()})  # at most WORDS numbers
    width = 40 + 8 * F.size("shingles")
    unique = items.dropDuplicates(["item"]).select(F.col("item").alias("item_id"), "n", "shingles")
    wanted = small(signatures(unique, share), 32)
    own = docs.select("_key", shingles(F.col("text"), sizes).alias("shingles"))
    pairs = cut(own.select("_key", F.explode("shingles").alias("hash")).join(wanted, "hash").select("_key", "item_id").distinct())
    suspects = small(pairs.select("_key").distinct(), 32)
    held = docs.select("_key", "doc_id", "text").join(suspects, "_key", "left_semi").select("_key", "doc_id", shingles(F.col("text"), sizes).alias("held"))
    both = held.join(small(pairs, 32), "_key").join(small(unique, width), "item_id")
    shared = both.withColumn("n_shared", F.size(F.array_intersect("shingles", "held"))).filter(F.col("n_shared") >= F.lit(share) * F.col("n") - 1e-9)
    named = items.select(F.col("item"), F.col("item_id").alias("named"))
    return shared.join(named, shared["item_id"] == named["item"]).select("_key", "doc_id", F.col("named").alias("item_id"), F.col("n").cast("long").alias("n_shingles"), F.col("n_shared").cast("long").alias("n_shared"), F.round(F.col("n_shared") / F.col("n"), 6).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents that contain no item of least_words words or more, with the columns of docs, whatever their names. Null
    and empty texts stay."""
    keyed = key_rows(packed(docs))
    found = small(cut(contained(keyed, benchmark, share, least_words).select("_key").distinct()), 32)
    return unpacked(keyed.join(found, "_key", "left_anti"), docs.columns)


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 5) AS k FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark) WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b))),
bs AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, round(n_shared / n_shingles, 6) AS containment
FROM c JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles - 1e-9
"""
