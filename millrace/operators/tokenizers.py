"""Applying given tokenizers: merges, offsets, ids. Tokenizers are read, never trained."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as t
from millrace.operators.convert import with_values


def apply_merges(word: str, ranks: Mapping[tuple[str, str], int]) -> list[str]:
    """The pieces of a word: of the adjacent pairs that can be merged, all occurrences of the lowest rank's, until none can."""
    pieces = list(word)
    while len(pieces) > 1:
        rank, pair = min((ranks.get(p, len(ranks)), p) for p in zip(pieces, pieces[1:]))
        if rank == len(ranks):
            break
        out, i = [], 0
        while i < len(pieces):
            step = 2 if tuple(pieces[i : i + 2]) == pair else 1
            out.append("".join(pieces[i : i + step]))
            i += step
        pieces = out
    return pieces


def encode_words(docs: DataFrame, merges: Sequence[tuple[str, str]]) -> DataFrame:
    """docs plus pieces: those of the text's words and other characters, in order; [] of null. `merges` is a vocabulary's
    list (lowest rank first), sent to the tasks with the function. A task merges a word once,
    as long as it knows no more than 250,000."""
    ranks = {tuple(m): i for i, m in reversed([*enumerate(merges)])}

    @F.pandas_udf("array<string>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[str]] = {}
        for words in batches:
            if len(known) > 250_000:
                known.clear()
            for row in words:
                for w in row:
                    if w not in known:
                        known[w] = apply_merges(w, ranks)
            yield pd.Series([[p for w in row for p in known[w]] for row in words])

    return docs.withColumn("pieces", encode(t.split_words(F.col("text"))))


def clean_piece(piece: Column) -> Column:
    """A piece without marks of its place in the word: one leading ##, and any Ġ or ▁."""
    return F.regexp_replace(F.regexp_replace(piece, r"^##", ""), "[Ġ▁]", "")


def piece_offsets(text: Column, pieces: Column) -> Column:
    """[start, end) of each cleaned piece, searched from the end of the one before; one that isn't found begins there."""

    @F.pandas_udf("array<array<int>>")
    def offsets(texts: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for whole, row in zip(texts, rows):
            at, own = 0, []
            for p in row if row is not None else []:
                begin = max(whole.find(p, at), at) if p else at
                at = min(begin + len(p), len(whole))
                own.append([begin, at])
            out.append(own)
        return pd.Series(out, dtype=object)

    return offsets(F.coalesce(text, F.lit("")), F.transform(pieces, clean_piece))


def piece_ids(pieces: Column, vocabulary: Mapping[str, int], unknown: int | None = None) -> Column:
    """Ids of pieces; those not in the vocabulary have the id `unknown`, or are left out if there is none.

    The vocabulary is a literal of the plan: for those of a tokenizer's size (some 100,000 entries)."""
    table = F.create_map(*(F.lit(x) for kv in vocabulary.items() for x in kv))
    ids = F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), F.lit(unknown).cast("int")))
    return ids if unknown is not None else F.filter(ids, lambda i: i.isNotNull())


def score_texts(docs: DataFrame, model: Callable[[str], float], out: str = "score") -> DataFrame:
    """docs plus a pluggable model's score of each text (null counts as empty)."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(model).astype("float64")

    return docs.withColumn(out, score("text"))


def spam_model(docs: DataFrame, model: Callable[[str], float], threshold: float) -> DataFrame:
    """Documents whose score is under the threshold."""
    return score_texts(docs, model, "_score").filter(F.col("_score") < threshold).drop("_score")


def project_metadata(metadata: Column, keep: Sequence[str] | None = None, leave: Sequence[str] = (), value_transform: Callable[[Column, Column], Column] | None = None) -> Column:
    """A map's entries that are kept (all, or those named, in that order) and not left out, transformed by (key, value) if a
    function is given; null values go."""
    if keep is not None:
        entries = F.transform(F.array(*map(F.lit, keep)), lambda k: F.struct(k.alias("key"), F.try_element_at(metadata, k).alias("value")))
        metadata = F.map_from_entries(entries)
    kept = F.map_filter(metadata, lambda k, v: v.isNotNull() & (~k.isin(*leave) if leave else F.lit(True)))
    return with_values(kept, value_transform) if value_transform else kept


def encode_by_file(docs: DataFrame, path: str, kind: str = "tokenizers") -> DataFrame:
    """docs plus pieces: by a given tokenizer, a file of the tokenizers library (byte-level or character BPE, WordPiece) or
    (kind="sentencepiece") a model of unigrams or BPE with byte fallback. The file is sent to the tasks; null is []."""
    docs.sparkSession.sparkContext.addFile(path)
    name = path.rpartition("/")[2]

    @F.pandas_udf("array<string>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if kind == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(name))
            pieces = lambda texts: model.encode(texts, out_type=str, num_threads=1)
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(SparkFiles.get(name))
            pieces = lambda texts: [e.tokens for e in own.encode_batch(texts, add_special_tokens=False)]
        for texts in batches:
            yield pd.Series(pieces(texts.fillna("").tolist()), dtype=object)

    return docs.withColumn("pieces", encode("text"))
