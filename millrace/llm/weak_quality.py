"""Quality from weak labels: heuristic labellers vote, expectation-maximisation weighs them, a hashed scorer learns.

Each labeller votes bad (0), good (1) or abstains (2). Documents with equal votes are counted together, so the EM runs on
at most 3 ** len(LABELLERS) counted patterns, over all documents. It estimates for each labeller how often it votes what
on good and on bad documents, and for each pattern the posterior that such a document is good. Posteriors label a bounded
sample, on which a logistic scorer over hashed words and shape features is fitted, which then scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import bounded_batches, first_of_ids, text_blocks, words


@dataclass(frozen=True)
class Settings:
    """sample_rows bounds the rows that the scorer is fitted on, sample_bytes their texts in all; min_rows drops words rarer
    than it there."""

    bits: int = 18
    sample_rows: int = 6000
    sample_bytes: int = 1 << 26
    min_rows: int = 5
    rounds: int = 50
    epochs: int = 8
    rate: float = 0.3
    l2: float = 1e-3
    threshold: float = 0.5


BAD, GOOD, ABSTAIN = 0, 1, 2
SHAPES = ["repeat", "unique", "symbol", "upper", "digit", "blank", "stops", "length", "lines", "double", "bars"]
#: Frequent words of a few languages; prose has some of them.
STOP_WORDS = "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an they you der die und das von zu den mit sich des auf für ist im dem nicht ein eine als le la les et des en un du une que est pour qui dans de el los y por con para del se las su al lo como más".split()

#: name -> (feature, bad when, good when): bounds that a value has to be under or over.
LABELLERS = {
    "repeats_words": ("repeat", (">", 0.2), ("<", 0.02)),
    "varied_words": ("unique", ("<", 0.15), (">", 0.5)),
    "few_symbols": ("symbol", (">", 0.12), ("<", 0.06)),
    "few_capitals": ("upper", (">", 0.3), ("<", 0.08)),
    "few_digits": ("digit", (">", 0.15), ("<", 0.02)),
    "has_stop_words": ("stops", ("<", 0.01), (">", 0.08)),
    "word_length": ("length", (">", 12.0), ("<", 9.0)),
    "distinct_lines": ("lines", ("<", 0.6), (">", 0.9)),
    "few_separators": ("bars", (">", 0.1), ("<", 0.005)),
    "joined_punctuation": ("double", (">", 0.08), ("<", 0.01)),
}

_STOPS: np.ndarray | None = None


def stop_hashes() -> np.ndarray:
    global _STOPS
    if _STOPS is None:
        data = np.frombuffer(" ".join(STOP_WORDS).encode(), np.uint8)
        _STOPS = np.unique(words(data, np.array([0, len(data)]))[0])
    return _STOPS


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL = _table("#*%&$@^~|\\<>{}[]=+_!")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_DIGIT = _table("0123456789")
_PUNCT = _table("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_BAR = _table("|")
_BLANK = _table(" \t\r\n")


def _sums(hit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(hit) + 1, np.int64)
    np.cumsum(hit, out=total[1:])
    return np.diff(total[offsets]).astype(float)


def shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents x SHAPES, word hashes, first word of each document)."""
    h, begin, end, doc = words(data, offsets)
    n = len(offsets) - 1
    first = np.searchsorted(doc, np.arange(n + 1))
    size = np.diff(first).astype(float)
    some, chars = np.maximum(size, 1), np.maximum(np.diff(offsets), 1)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    slot, order = (h >> np.uint64(44)).astype(np.int64), np.arange(len(h), dtype=np.int32)
    seen, distinct = np.zeros(1 << 20, np.int32), np.zeros(n)
    for d, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
        seen[slot[a:b]] = order[a:b]
        distinct[d] = np.count_nonzero(seen[slot[a:b]] == order[a:b])
    stops = np.isin(h, stop_hashes())
    per_word = lambda x: np.bincount(doc, x, n)[:n] / some if len(doc) else np.zeros(n)
    punct = _PUNCT[data]
    double = np.zeros(len(data), bool)
    double[1:] = punct[1:] & (data[1:] == data[:-1])
    # A document shorter than the reference size is judged as if it went on like this: type-token ratios fall with length.
    expected = np.minimum(1.0, 3.0 / np.maximum(some, 9) ** 0.5 + 0.25)
    cols = [per_word(again), np.minimum(distinct / some / expected, 2.0), _sums(_SYMBOL[data], offsets) / chars, _sums(_UPPER[data], offsets) / np.maximum(_sums(_LETTER[data], offsets), 1), _sums(_DIGIT[data], offsets) / chars, _sums(_BLANK[data], offsets) / chars, per_word(stops), per_word(end - begin), _distinct_lines(data, offsets), _sums(double, offsets) / chars, _sums(_BAR[data], offsets) / some]
    return np.stack(cols, 1) if n else np.zeros((0, len(SHAPES))), h, first


def _distinct_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of a document's lines that are unlike the others."""
    whole, out = data.tobytes(), np.ones(len(offsets) - 1)
    for d, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        lines = [x for x in whole[a:b].split(b"\n") if x.strip()]
        if lines:
            out[d] = len(set(lines)) / len(lines)
    return out


def votes(shape: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """(documents x LABELLERS); all abstain on a document without words."""
    out = np.full((len(shape), len(LABELLERS)), ABSTAIN, np.int8)
    for k, (feature, bad, good) in enumerate(LABELLERS.values()):
        x = shape[:, SHAPES.index(feature)]
        for vote, (sign, bound) in ((GOOD, good), (BAD, bad)):
            out[(x > bound) if sign == ">" else (x < bound), k] = vote
    out[n_words == 0] = ABSTAIN
    return out


def patterns(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ (3 ** np.arange(v.shape[1], dtype=np.int64))


def expectation_maximisation(pattern: np.ndarray, count: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, P(vote | class) as class x labeller x 3, prior of good)."""
    k = len(LABELLERS)
    v = (pattern[:, None] // 3 ** np.arange(k)) % 3
    weight = np.where((v == ABSTAIN).all(1), 0.0, count)  # a document without a vote says nothing of the labellers
    good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
    post = np.clip((good + 1.0) / (good + 3.0 * bad + 2.0), 0.05, 0.95)  # a start: one bad vote says more than one good
    theta, prior = np.zeros((2, k, 3)), 0.5
    for _ in range(rounds):
        prior = float(np.clip((post * weight).sum() / max(weight.sum(), 1), 0.05, 0.95))
        for c, share in ((1, post * weight), (0, (1 - post) * weight)):
            for x in range(3):
                theta[c, :, x] = (share[:, None] * (v == x)).sum(0) + 1.0
            theta[c] /= theta[c].sum(1, keepdims=True)
        odds = np.log(prior / (1 - prior)) + sum(np.log(theta[1, j, v[:, j]]) - np.log(theta[0, j, v[:, j]]) for j in range(k))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, theta, prior


def vote_table(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, pattern long. Row by row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0, np.int64)]
            for _, _, data, offsets in text_blocks(batch.column("text")):
                shape, _, first = shapes(data, offsets)
                out.append(patterns(votes(shape, np.diff(first))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out))], ["doc_id", "pattern"])

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, pattern long")


@dataclass
class Model:
    posterior: dict[int, float]
    accuracies: dict[str, tuple[float, float]]
    weights: np.ndarray
    shape_weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    bias: float


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic regression on soft targets over (hashed words, shapes)."""
    size = 1 << s.bits
    count = np.zeros(size)
    for x, _ in rows:
        count[x] += 1
    kept = [x[count[x] >= s.min_rows] for x, _ in rows]
    shape = np.array([z for _, z in rows]) if rows else np.zeros((0, len(SHAPES)))
    centre, spread = (shape.mean(0), shape.std(0) + 1e-6) if rows else (np.zeros(len(SHAPES)), np.ones(len(SHAPES)))
    z = np.clip((shape - centre) / spread, -5, 5)
    w, g2 = np.zeros(size), np.full(size, 1e-8)
    u, u2, bias, b2 = np.zeros(len(SHAPES)), np.full(len(SHAPES), 1e-8), 0.0, 1e-8
    order = np.random.default_rng(0)
    for _ in range(s.epochs if rows else 0):
        for batch in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 64)):
            idx = np.concatenate([kept[i] for i in batch])
            sizes = np.array([len(kept[i]) for i in batch])
            owner = np.repeat(np.arange(len(batch)), sizes)
            value = np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)
            error = 1 / (1 + np.exp(-np.clip(np.bincount(owner, value * w[idx], len(batch)) + z[batch] @ u + bias, -30, 30))) - target[batch]
            touched, place = np.unique(idx, return_inverse=True)
            grad = np.bincount(place, value * error[owner], len(touched)) / len(batch) + s.l2 * w[touched]
            g2[touched] += grad**2
            w[touched] -= s.rate * grad / np.sqrt(g2[touched])
            slope = z[batch].T @ error / len(batch) + s.l2 * u
            u2 += slope**2
            u -= s.rate * slope / np.sqrt(u2)
            b2 += error.mean() ** 2
            bias -= s.rate * error.mean() / b2**0.5
    return w, u, centre, spread, bias


def _hashed(h: np.ndarray, first: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Distinct hashed words of each document."""
    slot = (h >> np.uint64(64 - bits)).astype(np.int32)
    seen, order = np.zeros(1 << bits, np.int32), np.arange(len(h), dtype=np.int32)
    for a, b in zip(first.tolist(), first[1:].tolist()):
        own = slot[a:b]
        seen[own] = order[a:b]
        yield own[seen[own] == order[a:b]]


def train(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Votes of all documents, EM over their counted patterns on the driver (at most 3 ** 10 rows), then the scorer.

    The scorer learns from at most s.sample_rows documents, those of the smallest hash of doc_id (of a repeated one, one text); their identifiers are
    broadcast to the texts. It is fitted in one executor task.
    """
    voted = vote_table(docs)
    counted = voted.groupBy("pattern").count().collect()
    pattern, count = np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], np.int64)
    post, theta, _ = expectation_maximisation(pattern, count, s.rounds)
    posterior = dict(zip(pattern.tolist(), post.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, target = [], []
        for batch in first_of_ids(batches, s.sample_bytes):
            for _, _, data, offsets in text_blocks(batch.column("text")):
                shape, h, first = shapes(data, offsets)
                rows.extend(zip(_hashed(h, first, s.bits), shape))
                target += [posterior.get(x, 0.5) for x in patterns(votes(shape, np.diff(first))).tolist()]
        w, *rest = fit(rows, np.array(target), s)
        u, centre, spread, bias = rest
        yield pa.RecordBatch.from_pydict({"w": [w.astype(np.float32).tobytes()], "u": [np.concatenate([u, centre, spread]).tobytes()], "bias": [float(bias)]})

    picked = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(s.sample_rows).drop("_h")
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").coalesce(1)
    got = bounded_batches(texts).mapInArrow(run, "w binary, u binary, bias double").collect()
    n = len(SHAPES)
    u = np.frombuffer(got[0]["u"]) if got else np.concatenate([np.zeros(2 * n), np.ones(n)])
    w = np.frombuffer(got[0]["w"], np.float32) if got else np.zeros(1 << s.bits, np.float32)
    named = {k: (float(theta[1, j, GOOD]), float(theta[0, j, BAD])) for j, k in enumerate(LABELLERS)}
    return Model(posterior, named, w, u[:n], u[n : 2 * n], u[2 * n :], got[0]["bias"] if got else 0.0)


def score(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """docs plus weak_posterior (of its votes), score (of the scorer) and keep (score >= s.threshold).

    Row by row. Null and empty texts have no words: their posterior is that of a document on which all labellers abstain,
    or 0.5 where there was none, and keep is false. Columns of docs of those three names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("weak_posterior", "score", "keep")
    more = [T.StructField("weak_posterior", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            post, out, some = [], [], []
            for _, _, data, offsets in text_blocks(batch.column("text")):
                shape, h, first = shapes(data, offsets)
                post += [m.posterior.get(x, 0.5) for x in patterns(votes(shape, np.diff(first))).tolist()]
                fixed = np.clip((shape - m.centre) / m.spread, -5, 5) @ m.shape_weights + m.bias
                out += [x + m.weights[i].sum(dtype=float) / max(len(i), 1) ** 0.5 for x, i in zip(fixed, _hashed(h, first, s.bits))]
                some += (np.diff(first) > 0).tolist()
            p = 1 / (1 + np.exp(-np.clip(np.array(out, float), -30, 30)))
            keep = (p >= s.threshold) & np.array(some, bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(post, float)), pa.array(p), pa.array(keep)], [*batch.schema.names, "weak_posterior", "score", "keep"])

    return bounded_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, *more]))
