"""Token ids in sorted-string-table shards: prefix-compressed blocks, a sparse block index, a Bloom filter, a footer.

File layout, integers little-endian, varints of seven bits a byte:

    block*   zstd of: entry*, each varint(shared) varint(rest) varint(len(value)) rest value;
             every RESTART-th entry shares nothing; then uint32 offsets of those entries, uint32 their number
    index    for each block: varint(len(last key)) last key varint(offset) varint(length)
    bloom    uint32 number of hashes, then the bits
    footer   FOOTER: offset and length of index, of bloom, entries, tokens, magic

A key is 0x00 for a null identifier, else 0x01 and the identifier with its sign bit flipped, big-endian, so that byte order
is numeric order and nulls come first. A value is one byte, the width of an id (2 or 4), then the ids. A lookup asks the
Bloom filter, bisects the index, reads one block, bisects its restarts, and walks at most RESTART entries.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bytebpe import SliceCache, local_file, of_process, ship, states_of_neighbours
from millrace.llm.common import bounded_batches, mix64, scratch, tasks_for, text_blocks

MAGIC, RESTART, BLOCK_TARGET = b"MRSST001", 16, 1 << 16
FOOTER = struct.Struct("<QQQQQQ8s")
BITS_A_KEY, HASHES = 10, 7
#: Distinct pre-tokens after which a worker's cache begins a new generation.
KEPT = 500_000


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def pack_ids(ids: np.ndarray) -> bytes:
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1).astype(np.uint32)


def _probes(keys: list[bytes], n_bits: int, hashes: int) -> np.ndarray:
    h = mix64(np.array([zlib.crc32(k) << 32 | zlib.adler32(k) for k in keys], np.uint64))
    one, two = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF) | np.uint64(1)
    return (one[:, None] + np.arange(hashes, dtype=np.uint64) * two[:, None]) % np.uint64(n_bits)


class Writer:
    """Writes one shard; keys must come in ascending order (equal keys may repeat)."""

    def __init__(self, sink, level: int = 1):
        self.sink, self.zip = sink, zstandard.ZstdCompressor(level=level)
        self.at = self.entries = self.tokens = 0
        self.index: list[bytes] = []
        self.hashed: list[bytes] = []
        self._reset()

    def _reset(self) -> None:
        self.rows, self.restarts, self.size, self.n, self.last = [], [], 0, 0, b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value, shared = pack_ids(ids), 0
        if self.n % RESTART:
            shared = len(os.path.commonprefix([self.last, key]))
        else:
            self.restarts.append(self.size)
        row = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.rows.append(row)
        self.size, self.n, self.last = self.size + len(row), self.n + 1, key
        self.entries, self.tokens = self.entries + 1, self.tokens + len(ids)
        self.hashed.append(key)
        if self.size >= BLOCK_TARGET:
            self._flush()

    def _flush(self) -> None:
        if self.n:
            data = self.zip.compress(b"".join(self.rows) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts)))
            self.sink.write(data)
            self.index.append(_varint(len(self.last)) + self.last + _varint(self.at) + _varint(len(data)))
            self.at += len(data)
            self._reset()

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        n_bits = max(64, -(-len(self.hashed) * BITS_A_KEY // 8) * 8)
        bits = np.zeros(n_bits, np.uint8)
        if self.hashed:
            bits[_probes(self.hashed, n_bits, HASHES).ravel()] = 1
        bloom = struct.pack("<I", HASHES) + np.packbits(bits).tobytes()
        self.sink.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.entries, self.tokens, MAGIC))
        self.sink.close()


class Reader:
    """Reads one shard; `get` looks a key up, `scan` yields everything in order."""

    def __init__(self, uri: str):
        where, path = pafs.FileSystem.from_uri(uri)
        self.file = where.open_input_file(path)
        size = self.file.size()
        *parts, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        i_at, i_len, b_at, b_len, self.entries, self.tokens = parts
        data, at = self._read(i_at, i_len), 0
        self.last: list[bytes] = []
        self.where: list[tuple[int, int]] = []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.last.append(data[at : at + n])
            start, at = _read_varint(data, at + n)
            length, at = _read_varint(data, at)
            self.where.append((start, length))
        bloom = self._read(b_at, b_len)
        self.hashes, self.bits = struct.unpack_from("<I", bloom)[0], np.frombuffer(bloom, np.uint8, offset=4)
        self.unzip = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> tuple[bytes, tuple[int, ...], int]:
        data = self.unzip.decompress(self._read(*self.where[i]))
        (n,) = struct.unpack_from("<I", data, len(data) - 4)
        return data, struct.unpack_from(f"<{n}I", data, len(data) - 4 - 4 * n), len(data) - 4 - 4 * n

    @staticmethod
    def _entries(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < end:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, unpack_ids(data[at : at + size])
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.where)):
            data, _, end = self._block(i)
            for key, ids in self._entries(data, 0, end):
                yield id_of(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        at = _probes([key_of(doc_id)], len(self.bits) * 8, self.hashes)[0].astype(np.int64)
        return bool(np.all(self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1))

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first document of that identifier, or None."""
        key = key_of(doc_id)
        if not self.where or not self.may_hold(doc_id) or (i := bisect_left(self.last, key)) == len(self.last):
            return None
        data, restarts, end = self._block(i)
        heads = [next(self._entries(data, r, end))[0] for r in restarts]
        for found, ids in self._entries(data, restarts[max(0, bisect_left(heads, key) - 1)], end):
            if found >= key:
                return ids if found == key else None
        return None


def encode_apart(tokenizer, new: list[bytes], size: int = 200) -> list[bytes]:
    """Ids (little-endian uint32 bytes) of each of these pre-tokens of a byte-level tokenizer, by the library.

    A blank and what isn't white space always begin a pre-token, whatever stands before. Such pre-tokens are put together to
    texts of `size` of them, and the library's word numbers tell their ids apart; it is much quicker on few longer texts.
    All others, and texts whose words aren't as many as they should be, go through it one by one.
    """
    texts = [x.decode() for x in new]
    joined = [len(x) > 1 and x[0] == " " and not x[1].isspace() for x in texts]
    singles, out = [i for i, j in enumerate(joined) if not j], [b""] * len(texts)
    many = [i for i, j in enumerate(joined) if j]
    groups = [many[a : a + size] for a in range(0, len(many), size)]
    for group, e in zip(groups, tokenizer.encode_batch(["".join([texts[i] for i in group]) for group in groups], add_special_tokens=False)):
        ids, numbers = np.array(e.ids, "<u4").tobytes(), np.array(e.word_ids)
        at = [*(np.flatnonzero(np.diff(numbers, prepend=-1)) * 4).tolist(), len(ids)]
        if len(at) != len(group) + 1:
            singles.extend(group)
            continue
        for i, a, b in zip(group, at, at[1:]):
            out[i] = ids[a:b]
    for i, e in zip(singles, tokenizer.encode_batch([texts[i] for i in singles], add_special_tokens=False)):
        out[i] = np.array(e.ids, "<u4").tobytes()
    return out


class Encoder:
    """Texts to ids by the tokenizers library; `special_as_text` takes a special token's string in a text for ordinary text.

    A tokenizer of the byte-level pattern encodes each pre-token by itself, so a text's ids are its pre-tokens' ids in a row;
    each distinct pre-token then goes through the library once a worker process. Texts that hold the string of an added token
    go through it whole, and so do all texts of other tokenizers.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and spec.get("normalizer") is None
        self.added = [t["content"].encode() for t in added if not (special_as_text and t.get("special"))]
        self.cache = SliceCache(lambda new: encode_apart(self.tokenizer, new), KEPT, states_of_neighbours) if plain else None

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([x.decode() for x in texts], add_special_tokens=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each document of a block."""
        spans = [*zip(offsets.tolist(), offsets[1:].tolist())]
        if self.cache is None:
            return self.whole([data[a:b].tobytes() for a, b in spans])
        ids, at, _, _ = self.cache.encode(data, offsets)
        out = [ids[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]
        all_ = data.tobytes()
        if any(x in all_ for x in self.added):
            odd = [d for d, (a, b) in enumerate(spans) if any(all_.find(x, a, b) >= 0 for x in self.added)]
            for d, found in zip(odd, self.whole([all_[slice(*spans[d])] for d in odd])):
                out[d] = found
        return out


def write_shards(docs: DataFrame, tokenizer_file: str, folder: str, end_id: int = 2, shards: int | None = None, special_as_text: bool = False) -> list[dict]:
    """Encode docs (doc_id, text) and write them as shards in ascending doc_id order; a list with an item for each shard.

    Rows are dealt by doc_id ranges and sorted within (ties: by text), so shard k's keys all precede shard k + 1's. A shard
    is written to a file of the attempt's own and renamed, so a retried or doubled task leaves one whole file. Null texts
    are empty documents (the end id alone); null ids come first; repeated ids are kept, each as an entry; further columns
    are not read. Only one small row a shard reaches the driver: path, entries, tokens. An empty table makes no shards.
    """
    spark = docs.sparkSession
    ship(spark, tokenizer_file)
    n = shards or tasks_for(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        encoder = writer = None
        end = np.array([end_id], np.uint32)
        where, base = pafs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        own, final = f"{base}/.{part:06d}.{context.taskAttemptId()}", f"{base}/{part:06d}.sst"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = of_process(f"library {tokenizer_file} {special_as_text}", lambda: Encoder(local_file(tokenizer_file), special_as_text))
                writer = Writer(where.open_output_stream(own))
            ids = batch.column("doc_id").to_pylist()
            for i, j, data, offsets in text_blocks(batch.column("text")):
                for doc_id, x in zip(ids[i:j], encoder.encode(data, offsets)):
                    writer.add(key_of(doc_id), np.concatenate([x, end]))
        if writer is not None:
            writer.close()
            where.move(own, final)
            scheme = folder.partition("://")[0] + "://" if "://" in folder else "file:" if folder.startswith("file:") else ""
            uri = f"{scheme}{folder.partition('://')[2] or folder.removeprefix('file:')}/{part:06d}.sst"
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "path": [uri], "entries": pa.array([writer.entries], pa.int64()), "tokens": pa.array([writer.tokens], pa.int64())})

    dealt = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    written = bounded_batches(dealt).mapInArrow(run, "shard int, path string, entries long, tokens long").collect()
    out, base, first = [], 0, 0
    for r in sorted(written, key=lambda r: r["shard"]):
        out.append({**r.asDict(), "start": base, "first": first})
        base, first = base + r["tokens"], first + r["entries"]
    return out


def read_shards(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the shards, each read back from its file."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                rows = []
                for doc_id, ids in Reader(path).scan():
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame([(s["path"], s["start"]) for s in shards], "path string, start long")
    return bounded_batches(listed.repartition(len(shards))).mapInArrow(run, schema)


def token_shards(docs: DataFrame, tokenizer_file: str, end_id: int = 2) -> DataFrame:
    """Write docs as shards in the shared folder and return read_shards() of them."""
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, tokenizer_file, scratch(spark, "token-shards"), end_id))
