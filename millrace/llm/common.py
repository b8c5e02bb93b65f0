"""Shared helpers: the shared folder, row keys, Arrow text columns as numpy bytes, vectorised hashing."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer document is a block of its own.
BLOCK_BYTES = 1 << 19
ARROW_ROWS = 500
#: Bytes up to which a side of a join is broadcast.
BROADCAST_BYTES = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where none is set, one of its own if Spark runs in
    this process alone, else an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
            sc.setCheckpointDir(f"/tmp/checkpoints/{uuid.uuid4().hex}")
        folder = sc._jsc.sc().getCheckpointDir().get()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: lineage ends, a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def few(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as its rows need, at most as a shuffle has: small steps shall not write thousands of files."""
    return df.coalesce(min(tasks_for(df.sparkSession), rows // 100_000 + 1))


def tidy(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished jobs once the driver has collected what refers to them. Ask it to, where the
    next step fills the same disks. No result depends on it: what is read later is in the shared folder."""
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame, kind: str) -> DataFrame:
    """df, written to the shared folder and read again; see tidy()."""
    spark, at = df.sparkSession, scratch(df.sparkSession, kind)
    df.write.parquet(at)
    del df
    tidy(spark)
    return spark.read.parquet(at)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared ones."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*frames: DataFrame) -> None:
    """Delete the files of stored() tables that are no longer read."""
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            delete(df.sparkSession, folder)


def bounded_batches(df: DataFrame) -> DataFrame:
    """df; batches of its texts to Python hold ARROW_ROWS rows, unless the session sets a number of its own.

    Spark's default of 10,000 rows makes batches of tens of MB, of which each task holds several, in and out of the JVM.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return df


def first_of_ids(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Of the rows (doc_id, text, ...) of a task the first of each doc_id, whole texts, up to most_bytes of text in all; a text
    that would exceed it is left out. All batches are read."""
    seen: set[int | None] = set()
    left = most_bytes
    for batch in batches:
        take = []
        for key, size in zip(batch.column("doc_id").to_pylist(), np.diff(text_bytes(batch.column("text"))[1]).tolist()):
            take.append(key not in seen and size <= left)
            if take[-1]:
                seen.add(key)
                left -= size
        if any(take):
            yield batch.filter(pa.array(take, pa.bool_()))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and _row, a struct of all other columns, so that none clashes with those that operators add."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others).alias("_row") if others else F.lit(0).alias("_row"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that packed() was given, in their order."""
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col("_row").getField(c).alias(c) for c in columns))


def small(df: DataFrame, width: int | Column = 16, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if its rows, of `width` bytes each (a number, or a column for rows of differing size), hold at most
    most_bytes; beyond, a join shuffles both sides on the key. df should be cheap to read."""
    if isinstance(width, int):
        rows = most_bytes // width
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= most_bytes else df


def tasks_for(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def key_rows(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """df with a unique long `_key` that ascends with (id, text).

    Where ids are unique and not null the id is the key. Otherwise rows are sorted, numbered and written once, so that
    repeated ids and null ids (which come first) are documents of their own and the numbers stay the same on a retry.
    """
    odd = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(id_col).isNull())
    if odd.isEmpty():
        return df.withColumn("_key", F.col(id_col).cast("long"))
    return cut(df.orderBy(F.col(id_col).asc_nulls_first(), "text").withColumn("_key", F.monotonically_increasing_id()))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, n + 1 offsets) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]] if len(at) else whole, at - at[0] if len(at) else np.zeros(1, np.int64)


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def valid_utf8(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same block; where bytes are no UTF-8, each document with U+FFFD in their place."""
    try:
        data.tobytes().decode("utf-8")
        return data, offsets
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode("utf-8", "replace").encode("utf-8") for a, b in zip(offsets, offsets[1:])]
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES, raw: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets from 0) of a text column's blocks of whole documents; raw: bytes as they are,
    UTF-8 or not."""
    data, offsets = text_bytes(column)
    for i, j in blocks(offsets, limit):
        own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield i, j, *(own if raw else valid_utf8(*own))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_table(n: int, seed: int) -> np.ndarray:
    """n 64-bit values that depend on seed alone."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = random_table(256, 7)
_STEP = 0x9E3779B97F4A7C55


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings of data, by doubling: O(len * log k) without a loop over bytes."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, out, done = _BYTE[data], None, 0
    size, left = 1, k
    while left:
        if left & 1:
            piece = power[done : done + n]
            out = piece.copy() if out is None else out * np.uint64(pow(_STEP, size, 1 << 64)) + piece
            done += size
        left >>= 1
        if left:
            power = power[: len(power) - size] * np.uint64(pow(_STEP, size, 1 << 64)) + power[size:]
            size *= 2
    return mix64(out)


def code_points(data: np.ndarray) -> np.ndarray:
    """The code points of UTF-8 bytes."""
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)


_FOLD: np.ndarray | None = None


def folded(points: np.ndarray) -> np.ndarray:
    """Code points in lower case, where that is one code point."""
    global _FOLD
    if _FOLD is None:
        low = [chr(i).lower() if not 0xD800 <= i < 0xE000 else chr(i) for i in range(0x10000)]
        _FOLD = np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(low)], np.uint32)
    out, high = _FOLD.take(points, mode="clip"), points > 0xFFFF
    out[high] = points[high]
    return out


_INV = pow(_STEP, -1, 1 << 64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte, document) of each word of a block.

    A word is a run of letters and numbers of any script, whatever their case. Words end at the end of their document.
    """
    from millrace.llm.bytebpe import NUMBER, classes

    if not len(data) or data.max() < 128:
        points, heads, firsts = data, None, offsets
        inside, value = classes()[:128].take(data) <= NUMBER, _BYTE.take(folded(np.arange(128, dtype=np.uint32)).take(data))
    else:
        points, heads = code_points(data), np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
        inside, firsts = classes().take(points) <= NUMBER, np.searchsorted(heads, offsets)
        points = folded(points)
        value = _BYTE.take(points & np.uint32(0xFF))
        wide = np.flatnonzero(points > 127)
        value[wide] = mix64(points[wide].astype(np.uint64) + np.uint64(_STEP))
    n = len(points)
    edge = np.zeros(n + 1, bool)
    edge[firsts[(firsts > 0) & (firsts < n)]] = True
    before, after = np.concatenate([[False], inside]), np.concatenate([inside, [False]])
    begins, ends = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
    del edge, before, after, inside, points
    value *= _powers(_STEP, n + 1)[:-1]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    del value
    h = mix64((total[ends] - total[begins]) * _powers(_INV, n + 1)[begins] + (ends - begins).astype(np.uint64))
    doc = np.searchsorted(firsts, begins, "right") - 1
    if heads is not None:
        byte = np.append(heads, np.int32(len(data)))
        begins, ends = byte[begins].astype(np.int64), byte[ends].astype(np.int64)
    return h, begins, ends, doc


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if (kept := _POWERS.get(base)) is not None and len(kept) >= n:
        return kept[:n]
    out = np.ones(max(n, BLOCK_BYTES + 1), np.uint64)
    size = 1
    while size < len(out):
        more = min(size, len(out) - size)
        out[size : size + more] = out[:more] * np.uint64(pow(base, size, 1 << 64))
        size += more
    if len(out) == BLOCK_BYTES + 1:  # those of a longer text are not kept
        _POWERS[base] = out
    return out[:n]
