"""Substring dedup by content-defined chunking: gear rolling hash, variable chunks, dedup by digest.

A cut follows a byte where the gear hash of the last 32 bytes, sum of GEAR[byte] << age, has its top bits zero. Where a
text is cut depends on nearby bytes alone, so an insertion moves no cut but those beside it. Of chunks of equal digest the
first by (document, position) stays, the others are removed, where repeated chunks in a row make up `least` bytes or the
whole document: a few words that two texts happen to share aren't a repeated passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, dropped, key_rows, random_table, stored, text_blocks, text_bytes


@dataclass(frozen=True)
class Settings:
    """Bytes: no chunk but a document's only one is shorter than low; low + 2**bits is the mean; high is a forced cut; least
    is the shortest run of repeated chunks that is removed from a document that isn't all repeated."""

    low: int = 24
    bits: int = 4
    high: int = 1024
    least: int = 64


GEAR = (random_table(256, 1234) >> np.uint64(32)).astype(np.uint32)
WINDOW = 32


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At i, the sum of GEAR[data[i - a]] << a for a from 0 to 31, by doubling; the first 31 lack bytes before them."""
    h, reach = GEAR[data], 1
    while reach < WINDOW:
        grown = h.copy()
        grown[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = grown, reach * 2
    return h


def document_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """gear_hashes() of a block's documents, each as if alone: no cut depends on the document before."""
    h = gear_hashes(data)
    if len(data):
        at = offsets[:-1, None] + np.arange(WINDOW - 1)
        own = GEAR[data[np.minimum(at, len(data) - 1)]]
        reach = 1
        while reach < WINDOW:
            grown = own.copy()
            grown[:, reach:] += own[:, :-reach] << np.uint32(reach)
            own, reach = grown, reach * 2
        inside = at < offsets[1:, None]
        h[at[inside]] = own[inside]
    return h


def cuts(data: np.ndarray, offsets: np.ndarray, s: Settings = Settings()) -> list[list[int]]:
    """For each document of a block: where its chunks end (in the block). The last chunk takes a tail shorter than low."""
    where = np.flatnonzero(document_hashes(data, offsets) >> np.uint32(32 - s.bits) == 0) + 1
    at, places, out = np.searchsorted(where, offsets, "right").tolist(), where.tolist(), []
    for d, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        ends, last = [], a
        for c in [*places[at[d] : at[d + 1]], b]:
            while c - last > s.high:
                last += s.high
                ends.append(last)
            if c - last >= s.low and c < b:
                ends.append(c)
                last = c
        if b > a:
            if ends and b - ends[-1] < s.low:
                ends.pop()
            ends.append(b)
        out.append(ends)
    return out


def chunks(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs (_key, text) -> _key, start int, size int, d1 long, d2 long (a 128-bit digest), a row for each chunk.

    A document shorter than s.low is one chunk, an empty one has none. Texts are bytes, as they are (UTF-8 or not)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_key").to_numpy()
            for i, j, data, offsets in text_blocks(batch.column("text"), raw=True):
                whole, ends = data.tobytes(), cuts(data, offsets, s)
                n = np.array([len(e) for e in ends])
                stop = np.array([x for e in ends for x in e], np.int64)
                begin = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
                own = np.repeat(np.arange(j - i), n)
                digest = np.frombuffer(b"".join([hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), stop.tolist())]), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[i:j][own], (begin - offsets[own]).astype(np.int32), (stop - begin).astype(np.int32), digest[:, 0], digest[:, 1])], ["_key", "start", "size", "d1", "d2"])

    return bounded_batches(docs.select("_key", "text")).mapInArrow(run, "_key long, start int, size int, d1 long, d2 long")


def repeated(pieces: DataFrame) -> DataFrame:
    """_key, spans array<struct<start, stop>>: what to remove.

    Digests that occur twice are found by partial counts and minima and stored, so that a chunk of a third of all documents
    is a row a task there; then all chunks are joined with them, a plain join, whose hot partitions can be split.
    """
    first = pieces.groupBy("d1", "d2").agg(F.min(F.struct("_key", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = stored(first.select("d1", "d2", F.col("first._key").alias("k"), F.col("first.start").alias("at")), "chunk-first")
    again = pieces.join(first, ["d1", "d2"]).filter((F.col("_key") != F.col("k")) | (F.col("start") != F.col("at")))
    out = stored(again.groupBy("_key").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("stop"))).alias("spans")), "chunk-spans")
    dropped(first)
    return out


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, stop) rows."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > top[:-1]]))
    return np.stack([spans[new, 0], top[np.append(new[1:], len(spans)) - 1]], 1)


def remove(docs: DataFrame, spans: DataFrame, least: int = 0) -> DataFrame:
    """docs (_key, doc_id, text) without the bytes of spans (_key, spans array<struct<start, stop>>): doc_id, n_bytes,
    n_removed, n_spans, kept binary. Runs of under `least` bytes stay, but for one that is the whole document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            spans, rows = batch.column("spans"), []
            for d, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                got = spans[d].values
                runs = merged(np.stack([got.field(0).to_numpy(), got.field(1).to_numpy()], 1)) if got is not None else np.zeros((0, 2), int)
                runs = runs[(runs[:, 1] - runs[:, 0] >= least) | (runs[:, 1] - runs[:, 0] == b - a)]
                edge = [0, *runs.ravel().tolist(), b - a]
                whole = data[a:b].tobytes()
                rows.append((b - a, int((runs[:, 1] - runs[:, 0]).sum()), len(runs), b"".join([whole[x:y] for x, y in zip(edge[::2], edge[1::2])])))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = docs.select("_key", "doc_id", "text").join(spans, "_key", "left").select("doc_id", "text", "spans")
    return bounded_batches(joined).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row a document of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept binary.

    Null texts are empty; a text shorter than s.low is one chunk; repeated ids (null ids too) are documents of their own, in the order of their texts; of equal
    chunks the first by (doc_id, position) stays. Further columns are not read. An empty table gives no rows.
    """
    keyed = key_rows(docs.select("doc_id", "text"))
    return remove(keyed, repeated(chunks(keyed, s)), s.least)
