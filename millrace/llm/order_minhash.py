"""Near-duplicates by Order MinHash, verified by banded alignment.

A document's k-mers are its five-word shingles, each labelled with its occurrence number in the document, so repeats
count. A sketch takes the `picks` k-mers of smallest hash under its own random order and hashes them in the order in which
they stand in the text: equal sketches mean shared k-mers in one order, which follows edit similarity, not set overlap.
Copies of a text are collapsed to one representative first. Representatives with an equal sketch form a bucket, and each is
paired with the bucket's smallest. A pair is verified by aligning the two k-mer sequences within the band that the threshold
allows: similarity is matched / (all - matched), matches being in order. Classes are the connected components of verified
pairs.

Where a bucket is not one component by then, its members may be like others than the smallest. They are compared by rarest
k-mers, without loss (see overlapping()), so every link between documents that share a sketch is met, or joins documents
that are connected already.

Groups stay small: bucket minima come from partial sums, every row meets one partner a bucket, joins can split a hot key,
texts travel only for documents that are in a pair or in an open bucket, and components are found by star contraction on the
pairs alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import bounded_batches, cut, few, key_rows, mix64, packed, random_table, small, text_blocks, tidy, unpacked, words


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    sketches: int = 16
    picks: int = 3


_ODD = np.uint64(0x9E3779B97F4A7C15)


def kmers(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(labelled k-mer hashes of a block's documents in text order, first of each document)."""
    h, _, _, doc = words(data, offsets)
    n = max(len(h) - k + 1, 0)
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s = s * np.uint64(0x100000001B3) + h[i : n + i]
    inside = doc[:n] == doc[k - 1 : n + k - 1]
    s, doc = mix64(s[inside]), doc[:n][inside]
    first = np.searchsorted(doc, np.arange(len(offsets)))
    both = s ^ (mix64(doc.astype(np.uint64) + np.uint64(1)) * _ODD)
    order = np.argsort(both, kind="stable")
    run = both[order]
    fresh = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, bool)
    at = np.arange(len(run))
    label = np.empty(len(run), np.uint64)
    label[order] = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    return mix64(s + label * _ODD), first


def sketch(labelled: np.ndarray, seeds: np.ndarray, picks: int) -> np.ndarray:
    """One 64-bit sketch for each seed; none for a document without k-mers."""
    n = len(labelled)
    if not n:
        return np.zeros(0, np.int64)
    out = np.empty(len(seeds), np.uint64)
    wide = max(1, (1 << 20) // n)
    for a in range(0, len(seeds), wide):
        part = seeds[a : a + wide]
        h = (labelled[None, :] ^ part[:, None]) * _ODD
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        at = np.argpartition(h, picks - 1, axis=1)[:, :picks] if n > picks else np.tile(np.arange(n), (len(part), 1))
        at.sort(axis=1)
        got = part.copy()
        for c in range(at.shape[1]):
            got = mix64(got * np.uint64(0x100000001B3) + labelled[at[:, c]])
        out[a : a + wide] = got
    return out.view(np.int64)


def sketches(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs (_key, text) -> _key, d1, d2 (128-bit digest of the text), n (k-mers), sketches array<long>. Row by row."""
    seeds = random_table(s.sketches, 99)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column("text")):
                labelled, first = kmers(data, offsets, s.words)
                whole = data.tobytes()
                digest = np.frombuffer(b"".join(hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(offsets.tolist(), offsets[1:].tolist())), "<i8").reshape(-1, 2)
                found = [sketch(labelled[a:b], seeds, s.picks) for a, b in zip(first.tolist(), first[1:].tolist())]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column("_key").slice(i, j - i), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(np.diff(first).astype(np.int32)), lists], ["_key", "d1", "d2", "n", "sketches"])

    return bounded_batches(docs.select("_key", "text")).mapInArrow(run, "_key long, d1 long, d2 long, n int, sketches array<long>")


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the k-mers of a and b that match in order are at least `similarity` of all of them.

    The alignment is bit-parallel: one integer holds a row of the table. Cells further from the diagonal than the number of
    k-mers that may stay unmatched can't be on a good enough path; the band leaves them out.
    """
    n, m = len(a), len(b)
    least = int(np.ceil(similarity * (n + m) / (1 + similarity) - 1e-9))
    if min(n, m) < least or not least:
        return False
    same = min(n, m)
    diff = np.flatnonzero(a[:same] != b[:same])
    head = int(diff[0]) if len(diff) else same
    rest = same - head
    back = np.flatnonzero(a[n - rest :][::-1] != b[m - rest :][::-1]) if rest else np.zeros(0, int)
    tail = int(back[0]) if len(back) else rest
    if head + tail >= least:
        return True
    x, y, need = a[head : n - tail], b[head : m - tail], least - head - tail
    if len(np.intersect1d(x, y)) < need:  # labelled k-mers are distinct, so this bounds the matches
        return False
    band = n + m - 2 * least
    where = {v: i for i, v in enumerate(x.tolist())}
    full = (1 << len(x)) - 1
    row = full
    for j, v in enumerate(y.tolist()):
        i = where.get(v)
        if i is not None and abs(i - j) <= band:
            u = row & (1 << i)
            row = ((row + u) | (row - u)) & full
    return len(x) - row.bit_count() >= need


def verified(pairs: DataFrame, docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows (a, b) of pairs whose texts align. docs: _key, text."""
    keys = small(cut(pairs.select(F.explode(F.array("a", "b")).alias("_key")).distinct()))
    texts = docs.select("_key", "text").join(keys, "_key", "left_semi")
    one = texts.select(F.col("_key").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("_key").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            a, ok = batch.column("a").to_pylist(), []
            text_a = batch.column("text_a")
            for i, j, data, offsets in text_blocks(batch.column("text_b")):
                labelled, first = kmers(data, offsets, s.words)
                for r in range(i, j):
                    if a[r] != last:
                        for _, _, d, o in text_blocks(text_a.slice(r, 1)):
                            last, left = a[r], kmers(d, o, s.words)[0]
                    ok.append(aligned(left, labelled[first[r - i] : first[r - i + 1]], s.similarity))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return bounded_batches(pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")).mapInArrow(run, "a long, b long")


def reaches(n: Column, rank: Column, m: Column, other: Column, similarity: float) -> Column:
    """Whether documents of n and m k-mers can be similar if the first one they share, in a common order, is number `rank` of
    the one and number `other` of the other: what is left of both must hold as many matches as similarity asks for."""
    least = F.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)
    return (n - rank + 1 >= least) & (m - other + 1 >= least)


def pairs_of(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def star(rows: DataFrame, s: Settings) -> DataFrame:
    """rows (band, value, _key, n) -> distinct pairs (a, b): each _key and the smallest of its bucket, of sizes that can be
    similar."""
    one = F.lit(1)
    least = cut(rows.groupBy("band", "value").agg(F.min(F.struct("_key", "n")).alias("c"), F.count(one).alias("size")).filter("size > 1").drop("size"))
    near = rows.join(least, ["band", "value"]).filter((F.col("_key") != F.col("c._key")) & reaches(F.col("n"), one, F.col("c.n"), one, s.similarity))
    return near.select(*pairs_of(F.col("_key"), F.col("c._key"))).distinct()


def linked(signed: DataFrame, docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """node, root of the representatives that have verified pairs: the components that the links between like members of a
    bucket make; signed: _key, n, sketches."""
    spark = signed.sparkSession
    rows = signed.filter("n > 0").select("_key", "n", F.posexplode("sketches").alias("band", "value"))
    tried = cut(star(rows, s))
    tree = components(verified(tried, docs, s))
    rooted = rows.join(tree.withColumnRenamed("node", "_key"), "_key", "left").withColumn("root", F.coalesce("root", "_key"))
    open_ = cut(rooted.groupBy("band", "value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band", "value"))
    left = cut(rooted.join(open_, ["band", "value"], "left_semi").select("_key", "n").distinct())
    if left.isEmpty():
        return tree
    tidy(spark)
    heads = rarest(left, docs, s)
    for central in (True, False):
        tidy(spark)
        rooted = heads.join(tree.withColumnRenamed("node", "_key"), "_key", "left").withColumn("root", F.coalesce("root", "_key"))
        found = cut(overlapping(cut(rooted), s, central).join(tried, ["a", "b"], "left_anti"))
        if not found.isEmpty():
            tree = components(tree.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(found, docs, s)))
            tried = tried.unionByName(found)
    return tree


def rarest(left: DataFrame, docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """left (_key, n) -> _key, n, v, rank: its k-mers v, numbered from the rarest among left (ties by value), as far as a first
    shared one can stand, without those that no other document has.

    Documents of n and m k-mers, n the larger, are similar only if they share `similarity` of the n; so the first shared one
    is among the first n - ceil(similarity * n) + 1 of each (prefix filter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column("text")):
                labelled, first = kmers(data, offsets, s.words)
                yield pa.RecordBatch.from_arrays([batch.column("_key").slice(i, j - i), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(labelled.view(np.int64)))], ["_key", "v"])

    texts = docs.select("_key", "text").join(small(left.select("_key")), "_key", "left_semi")
    held = cut(bounded_batches(texts).mapInArrow(run, "_key long, v array<long>")).select("_key", F.size("v").alias("n"), F.explode("v").alias("v"))
    common = cut(held.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))  # c is 1 for all others
    order = Window.partitionBy("_key").orderBy("c", "v")
    head = F.col("n") - F.ceil(s.similarity * F.col("n") - 1e-9) + 1
    ranked = held.join(common, "v", "left").withColumn("c", F.coalesce("c", F.lit(1))).withColumn("rank", F.row_number().over(order))
    return cut(ranked.filter((F.col("rank") <= head) & (F.col("c") > 1)).select("_key", "n", "v", "rank"))


def overlapping(heads: DataFrame, s: Settings, central: bool) -> DataFrame:
    """Distinct pairs (a, b), a < b, of heads (rarest() with root) of different roots that share a k-mer v and can be similar,
    by their sizes and the numbers of v in both.

    central: pairs of each document and the one of v's in which v has the smallest number for its size. It has the least that
    is its own, so whoever is like any of a family is likely like it; one partner a row. Else: all such pairs, among them
    every similar pair of different roots. What a family has in common has high numbers, which leave too little behind them.
    """
    of = heads.groupBy("v").agg(F.min(F.struct((F.col("rank") / F.col("n")).alias("at"), "_key", "n", "rank", "root")).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    of = cut(of.filter("lo <> hi").select("v", F.col("c._key").alias("b"), F.col("c.n").alias("m"), F.col("c.rank").alias("other"), F.col("c.root").alias("far")))
    one = heads.withColumnRenamed("_key", "a")
    if central:
        two, once = of, F.col("a") != F.col("b")
    else:
        one = cut(one.join(of.select("v"), "v", "left_semi"))
        two, once = one.select("v", F.col("a").alias("b"), F.col("n").alias("m"), F.col("rank").alias("other"), F.col("root").alias("far")), F.col("a") < F.col("b")
    can = reaches(F.col("n"), F.col("rank"), F.col("m"), F.col("other"), s.similarity)
    one, two = one.alias("x"), two.alias("y")
    met = one.join(two, (F.col("x.v") == F.col("y.v")) & once & (F.col("root") != F.col("far")) & can)
    return met.select(*pairs_of(F.col("a"), F.col("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, root (the component's smallest node) of every node that is in an edge.

    Alternates large-star and small-star contraction until nothing changes; a round is two grouped minima and two joins on
    the edges, written to the shared folder. Only a count and a checksum reach the driver.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    print_of = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = print_of(now)
    now = few(now, before[0])
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(few(large, before[0]))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(few(small_star.distinct(), before[0]))
        after = print_of(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def classes(keyed: DataFrame, s: Settings = Settings()) -> DataFrame:
    """keyed (_key, text) -> _key, root: the smallest _key of its class."""
    signed = cut(sketches(keyed, s))
    reps = cut(signed.groupBy("d1", "d2").agg(F.min(F.struct("_key", "n", "sketches")).alias("r")).select("d1", "d2", "r.*"))
    tree = linked(reps.drop("d1", "d2"), keyed, s)
    rooted = reps.select("d1", "d2", F.col("_key").alias("rep")).join(tree.withColumnRenamed("node", "rep"), "rep", "left")
    return signed.select("_key", "d1", "d2").join(rooted, ["d1", "d2"]).select("_key", F.coalesce("root", "rep").alias("root"))


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row a document of docs (doc_id, text): doc_id, class_id (the smallest doc_id of its class), keep (it is that one).

    Equal texts are one class, whatever their length; null and empty texts are equal. A text of fewer than five words is
    like its copies alone. Repeated ids (null ids too) are documents of their own, in the order of their texts; further
    columns are not read. An empty table gives no rows.
    """
    keyed = key_rows(docs.select("doc_id", "text"))
    found = classes(keyed, s)
    ids = keyed.select("_key", "doc_id")
    named = found.join(ids, "_key").join(ids.select(F.col("_key").alias("root"), F.col("doc_id").alias("class_id")), "root")
    return named.select("doc_id", "class_id", (F.col("_key") == F.col("root")).alias("keep"))


def first_of_each(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents that are the first of their class, with the columns of docs, whatever their names."""
    keyed = key_rows(packed(docs))
    others = small(cut(classes(keyed.select("_key", "text"), s).filter("_key <> root").select("_key")))
    return unpacked(keyed.join(others, "_key", "left_anti"), docs.columns)
