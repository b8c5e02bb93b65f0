"""Exact substring dedup by difference-cover suffix sorting.

Every byte that a 100-byte string covers which also starts earlier (smaller document, or same document, earlier start) is
removed. Sorting all suffixes of a corpus in one global order would shuffle two thirds of all positions at each level, many
times the input; so suffixes are first dealt, without loss, into independent sets:

1. Anchors. Of the 24-byte strings in a 100-byte window the one of least hash (leftmost of equals) is the window's anchor.
   Equal windows have equal anchors, so windows can be equal only where an anchor's hash occurs twice. Consecutive windows
   with one anchor form a run, a row; runs whose anchor hash is alone drop out.
2. Equal runs are collapsed to the first, by partial minima; of the others every window is a repeat.
3. Remaining runs, with their bytes, go to sets by anchor hash, as many sets as the counted bytes need at SET_BYTES each. In
   a set the difference-cover algorithm sorts the suffixes: sampled triples are sorted and named, names are sorted
   recursively, the rest is merged in; adjacent suffixes that share 100 bytes form a group, of which all but the first go.
4. An anchor whose runs hold more than SET_BYTES (a very common line with many surroundings) makes no set: its runs are dealt
   anew by the next longer anchor, from step 1. The last anchor is the window itself, so that equal windows alone meet, and
   these are collapsed; no set grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunk_dedup import remove
from millrace.llm.common import bounded_batches, dropped, gram_hashes, key_rows, mix64, stored, text_blocks, text_bytes, _BYTE, _INV, _STEP, _powers

LENGTH = 100
#: Bytes of the anchors of each dealing, and of a set.
GRAMS = (24, 56, 84, LENGTH)
SET_BYTES = 1 << 19


def anchors(data: np.ndarray, offsets: np.ndarray, gram: int = GRAMS[0], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(first window start, windows - 1, hash, identity) of each run of a block; starts are in the block.

    The identity is a hash of all bytes that the run's windows cover and of where its anchor is in them."""
    h = gram_hashes(data, gram)
    wide = length - gram + 1
    n = len(h) - wide + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    value, place, reach = h, np.arange(len(h), dtype=np.int32), 1
    while reach < wide:
        step = min(reach, wide - reach)
        size = len(value) - step
        left = value[:size] <= value[step:]
        value, place = np.where(left, value[:size], value[step:]), np.where(left, place[:size], place[step:])
        reach += step
    start = np.arange(n)
    doc_end = offsets[np.searchsorted(offsets, start, "right")]
    start = start[start + length <= doc_end]
    at = place[start].astype(np.int64)
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]) if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    lo, hi, at = start[first], start[last], at[first]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_STEP, len(data)), out=total[1:])
    whole = (total[hi + length] - total[lo]) * _powers(_INV, len(data) + 1)[lo]
    return lo, hi - lo, h[at], mix64(whole + ((at - lo) * 1024 + (hi - lo)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def runs(docs: DataFrame) -> DataFrame:
    """docs (_key, text) -> anchor, same (hashes), _key, lo (first window), more (windows - 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_key").to_numpy()
            for i, j, data, offsets in text_blocks(batch.column("text"), raw=True):
                lo, more, h, same = anchors(data, offsets)
                doc = np.searchsorted(offsets, lo, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), same.view(np.int64), keys[i:j][doc], (lo - offsets[doc]).astype(np.int32), more.astype(np.int32))], ["anchor", "same", "_key", "lo", "more"])

    return bounded_batches(docs.select("_key", "text")).mapInArrow(run, "anchor long, same long, _key long, lo int, more int")


def runs_of_pieces(pieces: DataFrame, gram: int) -> DataFrame:
    """pieces (_key, lo, body) -> anchor, same, _key, lo, more, body: the runs of the pieces, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, base = batch.column("_key").to_numpy(), batch.column("lo").to_numpy()
            for i, j, data, offsets in text_blocks(batch.column("body"), raw=True):
                lo, more, h, same = anchors(data, offsets, gram)
                own, whole = np.searchsorted(offsets, lo, "right") - 1, data.tobytes()
                body = pa.array([whole[a : a + m + LENGTH] for a, m in zip(lo.tolist(), more.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*map(pa.array, (h.view(np.int64), same.view(np.int64), keys[i:j][own], (base[i:j][own] + lo - offsets[own]).astype(np.int32), more.astype(np.int32))), body], ["anchor", "same", "_key", "lo", "more", "body"])

    return bounded_batches(pieces.select("_key", "lo", "body")).mapInArrow(run, "anchor long, same long, _key long, lo int, more int, body binary")


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions of s (values of 1 or more) in the order of their suffixes, by the difference cover {1, 2} modulo 3.

    Suffixes that share more than `depth` values may stand in any order: the recursion ends once names cover that many."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    top = int(t.max()) + 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    pairs = t[sample] * top + t[sample + 1]
    if top >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    named, name = np.unique(pairs * top + t[sample + 2], return_inverse=True)
    if len(named) < len(sample) and depth > 3:
        # Names of the positions 1 mod 3, a terminator, names of those 2 mod 3: suffixes of this are suffixes of s.
        lower = np.concatenate([name[: len(one)] + 2, [1], name[len(one) :] + 2])
        order = suffix_array(lower, -(-depth // 3))
        order = order[order != len(one)]
        order = np.where(order < len(one), order, order - 1)
        name = np.empty(len(sample), np.int64)
        name[order] = np.arange(len(sample))
    else:
        order = np.argsort(name, kind="stable")
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = name + 1
    sampled = sample[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    big = len(sample) + 2
    key = t[rest] * big + rank[rest + 1]
    rest = rest[np.argsort(key, kind="stable")]
    in_one = sampled[sampled % 3 == 1]
    in_two = sampled[sampled % 3 == 2]
    deep = t * top + np.concatenate([t[1:], [0]]) if top < 1 << 20 else np.unique(t * top + np.concatenate([t[1:], [0]]), return_inverse=True)[1]
    before = np.searchsorted(t[in_one] * big + rank[in_one + 1], t[rest] * big + rank[rest + 1])
    before += np.searchsorted(deep[in_two] * big + rank[in_two + 2], deep[rest] * big + rank[rest + 2])
    # Where the recursion ended early, suffixes alike beyond depth stand in any order and counts may step back among them.
    where = np.arange(len(rest)) + np.maximum.accumulate(before)
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[where] = False
    out[where] = rest
    out[free] = sampled
    return out


def groups(data: np.ndarray, valid: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, group of each): equal groups have equal `length`-byte prefixes. valid: positions to take."""
    order = suffix_array(data.astype(np.int64) + 1, length)
    order = order[valid[order]]
    eight = np.zeros(len(data), np.uint64)
    for i in range(8):
        eight[: len(data) - i] |= data[i:].astype(np.uint64) << np.uint64(8 * i)
    same = np.ones(max(len(order) - 1, 0), bool)
    for o in [*range(0, length - 8, 8), length - 8]:
        same &= eight[order[1:] + o] == eight[order[:-1] + o]
    return order, np.concatenate([[0], np.cumsum(~same)]) if len(order) else order


def repeats_in_set(keys: np.ndarray, lo: np.ndarray, more: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, start, stop) of what is repeated: runs with their bytes; no two runs share a window."""
    own = np.repeat(np.arange(len(keys)), np.diff(offsets))
    inside = np.arange(len(data)) - offsets[:-1][own]
    order, group = groups(data, inside <= more[own])
    key, start = keys[own[order]], lo[own[order]] + inside[order]
    ranked = np.lexsort((start, key, group))
    later = np.concatenate([[False], group[ranked][1:] == group[ranked][:-1]]) if len(ranked) else np.zeros(0, bool)
    key, start = key[ranked][later], start[ranked][later]
    by = np.lexsort((start, key))
    key, start = key[by], start[by]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] > start[:-1] + LENGTH)]) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1 if len(first) else first
    return key[first], start[first], start[last] + LENGTH


def bodies(keyed: DataFrame, todo: DataFrame) -> DataFrame:
    """todo (anchor, _key, lo, more, hot) with the bytes that its windows cover, from keyed (_key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            lists, keys = batch.column("runs"), batch.column("_key").to_numpy()
            own = np.repeat(np.arange(len(keys)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            anchor, lo, more, hot = (flat.field(i) for i in range(4))
            whole, begin = data.tobytes(), (offsets[own] + lo.to_numpy()).tolist()
            yield pa.RecordBatch.from_arrays([anchor, pa.array(keys[own]), lo, more, hot, pa.array([whole[a : a + m + LENGTH] for a, m in zip(begin, more.to_pylist())], pa.binary())], ["anchor", "_key", "lo", "more", "hot", "body"])

    todo = todo.groupBy("_key").agg(F.collect_list(F.struct("anchor", "lo", "more", "hot")).alias("runs"))
    return bounded_batches(keyed.select("_key", "text").join(todo, "_key")).mapInArrow(run, "anchor long, _key long, lo int, more int, hot boolean, body binary")


def in_sets(held: DataFrame, sets: int) -> DataFrame:
    """_key, start, stop of what is repeated in held (anchor, _key, lo, more, body), sorted set by set."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        data, offsets = text_bytes(table["body"])
        got = repeats_in_set(table["_key"].to_numpy(), table["lo"].to_numpy().astype(np.int64), table["more"].to_numpy(), data, offsets)
        return pa.table({"_key": pa.array(got[0], pa.int64()), "start": pa.array(got[1].astype(np.int32)), "stop": pa.array(got[2].astype(np.int32))})

    dealt = held.select(F.pmod(F.xxhash64("anchor"), F.lit(sets)).alias("set"), "_key", "lo", "more", "body")
    return dealt.groupBy("set").applyInArrow(run, "_key long, start int, stop int")


def repeats(keyed: DataFrame, set_bytes: int = SET_BYTES) -> DataFrame:
    """keyed (_key, text) -> _key, spans array<struct<start, stop>>."""
    every = runs(keyed)
    again = stored(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "suffix-again")
    near = stored(every.join(again, "anchor"), "suffix-near")
    dropped(again)
    found: list[DataFrame] = []
    for level, gram in enumerate(GRAMS):
        if level:
            near = stored(runs_of_pieces(hot, gram), "suffix-near")
            dropped(hot)
        first = near.groupBy("anchor", "same").agg(F.min(F.struct("_key", "lo", "more")).alias("f"), F.count(F.lit(1)).alias("n"))
        first = stored(first.select("anchor", "same", "f.*", "n"), "suffix-first")
        some = first.filter("n > 1").select("anchor", "same", F.struct("_key", "lo").alias("f"))
        copies = near.join(some, ["anchor", "same"]).filter(F.struct("_key", "lo") != F.col("f")).select("_key", F.col("lo").alias("start"), _stop().alias("stop"))
        varied = stored(first.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("more") + LENGTH).alias("size")).filter("n > 1").select("anchor", "size"), "suffix-varied")
        too_large = F.col("size") > (set_bytes if gram < LENGTH else 1 << 62)
        total, n_hot = varied.agg(F.sum(F.when(~too_large, F.col("size"))), F.count_if(too_large)).first()
        todo = first.join(varied, "anchor").select("anchor", "_key", "lo", "more", too_large.alias("hot"))
        held = near.join(todo, ["anchor", "_key", "lo", "more"]).select("anchor", "_key", "lo", "more", "hot", "body") if level else bodies(keyed, todo)
        held = stored(held, "suffix-held") if n_hot else held
        found.append(stored(copies, "suffix-copies"))
        found.append(stored(in_sets(held.filter("not hot"), -(-(total or 0) // set_bytes) or 1), "suffix-found"))
        hot = stored(held.filter("hot").select("_key", "lo", "body"), "suffix-hot") if n_hot else None
        dropped(near, first, varied, *([held] if n_hot else []))
        if hot is None:
            break
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    out = stored(spans.groupBy("_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "suffix-spans")
    dropped(*found)
    return out


def _stop() -> Column:
    return F.col("lo") + F.col("more") + LENGTH


def dedup(docs: DataFrame, set_bytes: int = SET_BYTES) -> DataFrame:
    """One row a document of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept binary.

    Texts are bytes, as they are (UTF-8 or not); null is empty; matches do not cross documents; strings are judged on the input. Repeated ids
    (null ids too) are documents of their own, in the order of their texts. Texts under 100 bytes are kept whole. Further
    columns are not read. An empty table gives no rows.
    """
    keyed = key_rows(docs.select("doc_id", "text"))
    return remove(keyed, repeats(keyed, set_bytes))
