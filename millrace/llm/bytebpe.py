"""Byte-level BPE: pre-tokenisation without a regular expression, cached pair merging, decoding from offsets.

Pre-tokens are those of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Each code
point becomes one of a few classes; a class is a function from states to states, composition of such functions is
associative, and the state before every code point comes from a scan over blocks: compose each block's functions for all
entry states at once, scan the composed functions, replay each block from its known entry state. A boundary then is a
lookup in (state, class). The two rules that look ahead (contractions, the last blank of a run) are array comparisons
with neighbours.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import bounded_batches, code_points, text_blocks

#: Code-point classes.
LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)
#: The code points with the property White_Space.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The contractions of the pattern.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

_CLASS: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point; SPACE is U+0020 alone, which may lead a run, BLANK all other white space."""
    global _CLASS
    if _CLASS is None:
        out = np.full(0x110000, OTHER, np.uint8)
        every = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4").tobytes().decode("utf-32-le")
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                a, b = (x + 0x800 * (x >= 0xD800) for x in (m.start(), m.end() - 1))
                out[a : b + 1] = kind
        out[0xD800:0xE000] = OTHER
        out[WHITE_SPACE] = BLANK
        out[0x20] = SPACE
        _CLASS = out
    return _CLASS


#: States: what the code point before belongs to. OPEN is a blank run's last U+0020, which the next run takes as its own;
#: the states LETTER, NUMBER, OTHER go on with their class; START has no predecessor in the document.
OPEN, START = 4, 5
N_STATES, RESET = 6, 5
#: NEXT[class, state]; class RESET stands for a document's first code point and is followed by the class itself.
NEXT = np.array([[c if c < BLANK else (BLANK if c == BLANK else OPEN)] * N_STATES for c in range(5)], np.uint8)
#: CUT[class, state]: the run of the state ends before a code point of the class.
CUT = np.array([[not (s == c or s == OPEN and c < BLANK or s in (BLANK, OPEN) and c >= BLANK) for s in range(N_STATES)] for c in range(5)], bool)
BLOCK = 64


def states_before(kinds: np.ndarray, step: np.ndarray = NEXT, start: int = START) -> np.ndarray:
    """The state before each position, by a scan over composed transition functions in blocks of BLOCK symbols."""
    n, m = len(kinds), step.shape[1]
    if not n:
        return np.zeros(0, np.uint8)
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    maps = np.tile(np.arange(m, dtype=np.uint8), (rows, 1))
    flat = step.ravel()
    for j in range(BLOCK):
        maps = flat.take((grid[j] * np.uint8(m))[:, None] + maps)
    reach, lane = 1, np.arange(rows)[:, None]
    while reach < rows:  # inclusive scan: maps[i] = all blocks up to i, composed
        maps[reach:] = maps[lane[reach:], maps[:-reach]]
        reach *= 2
    state = np.concatenate([np.array([start], np.uint8), maps[:-1, start]])
    out = np.empty((BLOCK, rows), np.uint8)
    for j in range(BLOCK):
        out[j] = state
        state = flat.take(grid[j] * np.uint8(m) + state)
    return out.T.ravel()[:n]


def states_of_neighbours(kinds: np.ndarray) -> np.ndarray:
    """The same as states_before() for NEXT, whose functions are all constant: the state is the class before."""
    return np.concatenate([np.array([START], np.uint8), NEXT[:, 0].take(kinds[:-1])])


def boundaries(points: np.ndarray, firsts: np.ndarray, states: Callable[[np.ndarray], np.ndarray] = states_before) -> np.ndarray:
    """Sorted positions where a pre-token begins. points: code points of documents in a row; firsts: where each begins."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes().take(points)
    state = states(kind)
    first = np.zeros(n + 1, bool)
    first[firsts[firsts <= n]] = True
    first[n] = True
    cut = CUT.ravel().take(kind * np.uint8(N_STATES) + state)
    white = kind >= BLANK
    # A blank run with a successor gives up its last code point: U+0020 joins the successor, another stays alone.
    ends = white[:-1] & ~white[1:] & ~first[1:n]
    last = np.flatnonzero(ends)
    cut[last] = True
    alone = kind[last] != SPACE
    cut[last[~alone] + 1] = False
    cut[last[alone] + 1] = True
    cut |= first[:n]
    _contractions(points, kind, cut, first)
    return np.flatnonzero(cut)


def _contractions(points: np.ndarray, kind: np.ndarray, cut: np.ndarray, first: np.ndarray) -> None:
    """Where a pre-token would begin with an apostrophe and a contraction follows, the contraction is the pre-token."""
    n = len(points)
    at = np.flatnonzero((points == 0x27) & cut)
    at = at[at + 1 < n]
    at = at[~first[at + 1]]
    for p in at.tolist():
        if not cut[p]:
            continue
        for tail in CONTRACTIONS:
            e = p + 1 + len(tail)
            if e <= n and not first[p + 1 : e].any() and all(points[p + 1 + i] == ord(x) for i, x in enumerate(tail)):
                cut[p + 1 : e] = False
                if e < n and not cut[e]:
                    cut[e] = True
                break


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of one text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = [*boundaries(points, np.zeros(1, np.int64)).tolist(), len(text)]
    return [text[a:b] for a, b in zip(at, at[1:])]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the pair of lowest rank is merged first, the leftmost of equals; a heap, so n log n."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    parts = [piece[i : i + 1] for i in range(n)]
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if not parts[i] or j < 0 or ranks.get(pair := parts[i] + parts[j]) != r:
            continue
        parts[i], parts[j] = pair, b""
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (s := ranks.get(pair + parts[k])) is not None:
                heapq.heappush(heap, (s, i))
        if (h := before[i]) >= 0 and (s := ranks.get(parts[h] + pair)) is not None:
            heapq.heappush(heap, (s, h))
    return [ranks[p] for p in parts if p]


def read_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Numbers(dict):
    """A number for each key, given out in the order in which keys are first asked for; those keys are listed in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all ranges that begin at `begin` and hold `size`, in a row."""
    stop = np.cumsum(size)
    return np.repeat(begin - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)


class SliceCache:
    """Pre-token (UTF-8) -> its ids. `encode_new` turns a list of unseen pre-tokens into their ids as little-endian uint32.

    Pre-tokens are numbered; by number, `size` and `begin` tell where in `ids` those of a pre-token are. Once there are more
    than `most` numbers a new generation begins; what it needs of the last one is copied, not encoded again. Only the last
    generation is kept, so memory is bounded, and results are the same whatever is kept.
    """

    def __init__(self, encode_new: Callable[[list[bytes]], list[bytes]], most: int = 200_000, states: Callable = states_before):
        self.encode_new, self.most, self.states = encode_new, most, states
        self.old: dict[bytes, int] = {}
        self.old_ids = self.old_begin = self.old_size = None
        self._begin_generation()

    def _begin_generation(self) -> None:
        self.numbers, self.used, self.known = _Numbers(), 0, 0
        self.ids, self.begin, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _learn(self) -> None:
        """Give the ids of the pre-tokens that were numbered last their place."""
        new, find = self.numbers.new, self.old.get
        where = np.fromiter([find(x, -1) for x in new], np.int64, len(new))
        fresh = where < 0
        size, unseen = np.zeros(len(new), np.int64), [*compress(new, fresh.tolist())]
        got = self.encode_new(unseen) if unseen else []
        size[fresh] = np.fromiter(map(len, got), np.int64, len(got)) >> 2
        if len(got) < len(new):
            kept = where[~fresh]
            size[~fresh] = self.old_size.take(kept)
        stop = np.cumsum(size)
        n, k = self.known + len(new), self.used + int(stop[-1])
        if n > len(self.size):
            self.begin, self.size = np.resize(self.begin, 2 * n), np.resize(self.size, 2 * n)
        if k > len(self.ids):
            self.ids = np.resize(self.ids, 2 * k)
        flat, own = self.ids[self.used : k], np.repeat(fresh, size)
        flat[own] = np.frombuffer(b"".join(got), "<u4")
        if len(got) < len(new):
            flat[~own] = self.old_ids.take(_ranges(self.old_begin.take(kept), size[~fresh]))
        self.size[self.known : n] = size
        self.begin[self.known : n] = self.used + stop - size
        self.known, self.used = n, k
        self.numbers.new = []

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a block of documents: (all ids, n + 1 places where a document's ids begin, ends of its pre-tokens in code points
        of their document, n + 1 places where a document's ends begin)."""
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        points, firsts = code_points(data), np.searchsorted(heads, offsets)
        cuts = boundaries(points, firsts[:-1], self.states)
        to = np.searchsorted(cuts, firsts, "left")
        if not len(cuts):
            return np.zeros(0, np.uint32), to, cuts, to
        # 0xFF is in no UTF-8 text: put before every pre-token but the first, it lets bytes.split do the slicing.
        slices = np.insert(data, heads[cuts[1:]], 0xFF).tobytes().split(b"\xff")
        if self.known > self.most:
            self.old, self.old_ids, self.old_begin, self.old_size = self.numbers, self.ids, self.begin, self.size
            self._begin_generation()
        number = np.fromiter(map(self.numbers.__getitem__, slices), np.int32, len(slices))
        if self.numbers.new:
            self._learn()
        size = self.size.take(number).astype(np.int64)
        stop = np.cumsum(size)
        out = self.ids.take(_ranges(self.begin.take(number), size))
        ends = np.append(cuts[1:], len(points)) - np.repeat(firsts[:-1], np.diff(to))
        return out, np.concatenate([[0], stop])[to], ends, to


#: One cache for a worker process and vocabulary: later tasks of the process find what earlier ones encoded.
_CACHES: dict[str, object] = {}


def of_process(key: str, make: Callable[[], object]) -> object:
    if key not in _CACHES:
        _CACHES[key] = make()
    return _CACHES[key]


def rank_cache(ranks: dict[bytes, int]) -> SliceCache:
    return SliceCache(lambda new: [np.array(merge(x, ranks), "<u4").tobytes() for x in new])


def local_file(path: str) -> str:
    """The vocabulary where this executor finds it: at its path, else as the file that the driver sent."""
    import os

    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def ship(spark: SparkSession, path: str) -> None:
    spark.sparkContext.addFile(path)


#: What encode_documents() can return, and the types.
OUTPUTS = {"ids": "binary", "n_tokens": "long", "slice_ends": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, ranks_file: str, keep: Sequence[str] = ("doc_id",), outputs: Sequence[str] = ("ids", "n_tokens", "slice_ends", "decoded")) -> DataFrame:
    """docs (doc_id, text) -> the columns `keep` and, of OUTPUTS, those wanted: ids (little-endian uint32), n_tokens, where each
    pre-token ends (slice_ends, in code points), decoded, which is made from the ids alone, and digests of the ids (decimal,
    joined by commas) and of what was decoded, for which neither has to leave the task.

    Null or empty text: no ids and nothing decoded. Null ids, repeated rows and further columns are let through row by row, as
    they are. No shuffle; each task holds one block of text and a bounded cache.
    """
    ship(docs.sparkSession, ranks_file)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep), *(f"{k} {OUTPUTS[k]}" for k in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = of_process(f"ranks {ranks_file}", lambda: read_ranks(local_file(ranks_file)))
        cache = of_process(f"cache {ranks_file}", lambda: rank_cache(ranks))
        vocabulary, decimal = of_process(f"vocabulary {ranks_file}", lambda: (vocabulary_of(ranks), [b"%d" % i for i in range(max(ranks.values(), default=-1) + 1)]))
        sha = lambda parts: pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column("text")):
                ids, at, ends, place = cache.encode(data, offsets)
                parts = [ids[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]
                decoded = [decode(x, vocabulary) for x in parts] if {"decoded", "decoded_sha256"} & {*outputs} else []
                make = {
                    "ids": lambda: pa.array([x.tobytes() for x in parts], pa.binary()),
                    "n_tokens": lambda: pa.array(np.diff(at)),
                    "slice_ends": lambda: pa.ListArray.from_arrays(pa.array(place.astype(np.int32)), pa.array(ends.astype(np.int32))),
                    "decoded": lambda: pa.array(decoded, pa.binary()),
                    "ids_sha256": lambda: sha(b",".join(map(decimal.__getitem__, x.tolist())) for x in parts),
                    "decoded_sha256": lambda: sha(decoded),
                }
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in keep), *(make[k]() for k in outputs)], [*keep, *outputs])

    return bounded_batches(docs.select(*dict.fromkeys([*keep, "text"]))).mapInArrow(run, fields)


def vocabulary_of(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for k, v in ranks.items():
        out[v] = k
    return out


def decode(ids: bytes | np.ndarray, vocabulary: list[bytes]) -> bytes:
    """The bytes that ids (an array, or little-endian uint32) stand for."""
    return b"".join(map(vocabulary.__getitem__, (np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids).tolist()))


def digests(docs: DataFrame, ranks_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text of docs."""
    return encode_documents(docs, ranks_file, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
