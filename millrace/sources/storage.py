"""The shared folder, sinks, and archives."""

from __future__ import annotations

import gzip
import json
import lzma
import os
import shutil
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as t


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new name in the folder that driver and executors share (spark.checkpoint.dir); where none is set, in a local one if
    Spark runs in this process alone, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return f"{(base or '/tmp/checkpoints').rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def settled(df: DataFrame, kind: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    at = shared_folder(df.sparkSession, kind)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def small(df: DataFrame, width: int | Column = 16, most_bytes: int = 1 << 25) -> DataFrame:
    """df, to be broadcast if its rows, of `width` bytes each (a number, or a column), hold at most most_bytes; beyond, a join
    shuffles both sides on the key. df should be cheap to read."""
    if isinstance(width, int):
        rows = most_bytes // width
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= most_bytes else df


def short_batches(df: DataFrame) -> DataFrame:
    """df; batches of its texts to Python hold 500 rows and end with the one that brings them to 8 MB, unless the session sets
    numbers of its own. With Spark's defaults, 10,000 rows of any size, a batch of texts holds tens of MB, several times over.
    """
    conf = df.sparkSession.conf
    for name, default, ours in (("maxRecordsPerBatch", "10000", 500), ("maxBytesPerBatch", "67108864b", 1 << 23)):
        if conf.get(f"spark.sql.execution.arrow.{name}") == default:
            conf.set(f"spark.sql.execution.arrow.{name}", ours)
    return df


def write_shards(docs: DataFrame, folder: str, rows: int = 0, by: str | None = None) -> None:
    """Gzip JSONL shards, a folder for each value of `by`; a shard is closed after `rows` rows (0: at the end of its task).

    Rows aren't shuffled: a task writes what it holds. Null fields are left out.
    """
    writer = docs.write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", rows)
    (writer.partitionBy(by) if by else writer).json(folder)


def write_byte_shards(docs: DataFrame, folder: str, most_bytes: int = 200_000_000, level: int = 6) -> DataFrame:
    """Gzip JSONL shards that end with the row that brings their compressed size to most_bytes; returns path, rows, bytes.

    A task writes its own shards, <partition>-<five-digit number>.jsonl.gz, under the attempt's name, and renames them. Rows
    aren't shuffled. Nulls are left out."""
    target, rows = folder, docs.select(F.to_json(F.struct(*docs.columns)).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        where, base = pafs.FileSystem.from_uri(target)
        where.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        sink = zipped = None
        rows = held = 0

        def name(final: bool) -> str:
            return f"{base}/{'' if final else f'.{context.taskAttemptId()}.'}{context.partitionId():05d}-{len(done):05d}.jsonl.gz"

        def close() -> None:
            sink.write(zipped.flush())
            size = sink.tell()
            sink.close()
            where.move(name(False), name(True))
            done.append((name(True), rows, size))

        for batch in batches:
            for line in batch.column("line").to_pylist():
                if sink is None:
                    sink, zipped, rows, held = where.open_output_stream(name(False), compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                data = zipped.compress(line.encode() + b"\n")
                held += len(line)
                if held >= 1 << 16:  # what the compressor holds back counts too
                    data, held = data + zipped.flush(zlib.Z_SYNC_FLUSH), 0
                sink.write(data)
                rows += 1
                if sink.tell() >= most_bytes:
                    close()
                    sink = None
        if sink is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "rows", "bytes"])

    return settled(rows.mapInArrow(run, "path string, rows long, bytes long"), "byte-shards")


def write_lexicon(lexicon: DataFrame, folder: str) -> None:
    """Segmentations (form, morphemes, labels, lemma, msd, ...) as JSONL shards."""
    lexicon.write.mode("overwrite").json(folder)


def read_lexicon_table(spark: SparkSession, folder: str) -> DataFrame:
    """What write_lexicon() wrote; of a form's segmentations the one of the smallest lemma, msd and morphemes stays."""
    rows = spark.read.schema("form string, morphemes array<string>, labels array<string>, lemma string, msd string, verified boolean").json(folder)
    best = F.min(F.struct("lemma", "msd", "morphemes", "labels", "verified")).alias("b")
    return rows.groupBy("form").agg(best).select("form", "b.morphemes", "b.labels", "b.lemma", "b.msd", "b.verified")


def write_splits(examples: DataFrame, folder: str, splits: Sequence[str]) -> DataFrame:
    """Write the rows of declared splits, and return split, n for each of these, 0 included. Others (and null) are dropped."""
    kept = examples.filter(F.col("split").isin(*splits))
    write_shards(kept, folder, by="split")
    named = examples.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    return named.join(kept.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"))


def write_with_sidecar(docs: DataFrame, folder: str, annotations: Sequence[str]) -> bool:
    """Texts to <folder>/text; annotation columns by uid to <folder>/annotations, only if a row has any. True if so."""
    docs.drop(*annotations).write.mode("overwrite").json(f"{folder}/text")
    some = docs.filter(F.coalesce(*(F.col(a).isNotNull() for a in annotations)) & (F.coalesce(*(F.col(a).cast("string") for a in annotations)).isNotNull()))
    if some.isEmpty():
        return False
    docs.select("uid", *annotations).write.mode("overwrite").option("compression", "gzip").json(f"{folder}/annotations")
    return True


def write_kept_and_excluded(docs: DataFrame, keep: Column, folder: str) -> DataFrame:
    """One pass: rows to <folder>/kept=true and, where keep is false or null, kept=false. Returns all rows with `kept`."""
    docs.withColumn("kept", F.coalesce(keep, F.lit(False))).write.mode("overwrite").partitionBy("kept").parquet(folder)
    return docs.sparkSession.read.parquet(folder).withColumn("kept", F.col("kept").cast("boolean"))


def write_line_sample(docs: DataFrame, folder: str) -> None:
    """A line for each document, white space made single blanks; empty texts write none."""
    lines = docs.select(t.flatten_spaces(F.col("text")).alias("value")).filter("value <> ''")
    lines.write.mode("overwrite").text(folder)


def write_stats(by_group: DataFrame, totals: DataFrame, folder: str, key: str) -> None:
    """aggregate.json and per_dataset/<key>.json; by_group has a row for each dataset."""
    Path(folder, "per_dataset").mkdir(parents=True, exist_ok=True)
    write_json(f"{folder}/aggregate.json", totals.first().asDict())
    for row in by_group.toLocalIterator():
        write_json(f"{folder}/per_dataset/{row[key]}.json", row.asDict())


def write_json(path: str, value: object) -> None:
    """Written under a name of its own and renamed, so that a reader sees all of it or nothing."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1, sort_keys=True, default=str)
    os.replace(own, path)


def markdown_report(rows: DataFrame, metrics: Sequence[str], lower_is_better: Sequence[str] = ()) -> str:
    """A Markdown table of a few runs (tokenizer, vocab, one struct value[, low, high] or number for each metric)."""
    out = ["| tokenizer | vocab | " + " | ".join(f"{m} {'↓' if m in lower_is_better else '↑'}" for m in metrics) + " |", "|---" * (len(metrics) + 2) + "|"]
    for r in rows.orderBy("tokenizer", "vocab").collect():  # a row for each run
        cells = []
        for m in metrics:
            v = r[m]
            cells.append("–" if v is None else f"{v:.4f}" if isinstance(v, (int, float)) else f"{v['value']:.4f} [{v['low']:.4f}, {v['high']:.4f}]")
        out.append(f"| {r['tokenizer']} | {r['vocab']} | " + " | ".join(cells) + " |")
    return "\n".join(out) + "\n"


def unpack(archive: str, folder: str) -> list[str]:
    """Unpack .gz, .xz, .zst, .zip, and tar archives in these, into folder; returns the files. Other names: ValueError."""
    path, to = Path(archive), Path(folder)
    to.mkdir(parents=True, exist_ok=True)
    name = path.name.lower()
    if name.endswith(".zip"):
        with zipfile.ZipFile(path) as z:
            z.extractall(to)
    elif name.endswith((".tar.gz", ".tgz", ".tar.xz", ".tar")):
        with tarfile.open(path) as z:
            z.extractall(to, filter="data")
    elif name.endswith((".tar.zst", ".tar.zstd")):
        with open(path, "rb") as f, zstandard.ZstdDecompressor().stream_reader(f) as s, tarfile.open(fileobj=s, mode="r|") as z:
            z.extractall(to, filter="data")
    elif name.endswith((".gz", ".xz", ".zst")):
        opener = {".gz": gzip.open, ".xz": lzma.open, ".zst": zstandard.open}[path.suffix.lower()]
        with opener(path, "rb") as f, open(to / path.stem, "wb") as g:
            shutil.copyfileobj(f, g)
    else:
        raise ValueError(f"{archive}: no known archive")
    return sorted(str(p) for p in to.rglob("*") if p.is_file())
