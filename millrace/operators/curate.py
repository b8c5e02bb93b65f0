"""Curation: quality and repetition rules, spam, language, exact and sentence-level dedup."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as t
from millrace.sources.storage import settled, short_batches, small

#: As functions.text.WORD, for Python (up to the version of Unicode).
WORD = re.compile(r"\w+")
#: Characters of text whose n-grams are counted at once; a longer text is counted alone.
PART_CHARS = 1 << 19
#: Own short lists; a run brings its own as parameters.
STOP_WORDS = {
    "en": "the of and to in that is for with it as was on are be this have not by from at or which but were an they their has will".split(),
    "fr": "le la les et des un une que pour dans est pas qui sur au avec ce il plus par sont cette nous mais ou leur elle ses aux du".split(),
    "de": "der die das und ist nicht mit ein zu den von auf sich dem des eine als auch es an werden aus er hat dass wird bei nach wie noch".split(),
    "es": "el los las del y por con para lo se que una un su al como pero sus le ya este porque esta entre cuando muy sin sobre ser".split(),
}
SPAM_TERMS = {"seo": ["casino", "viagra", "cheap", "discount", "subscribe", "click"], "adult": ["xxx", "porn", "escort"]}
BLOCKED_DOMAINS = ["cheap-pills.example.com", "casino.example.net"]


@dataclass(frozen=True)
class Quality:
    min_words: int = 50
    max_words: int = 100_000
    min_mean_length: float = 3.0
    max_mean_length: float = 10.0
    max_symbols: float = 0.1
    max_bullets: float = 0.9
    max_ellipses: float = 0.3
    min_alphabetic: float = 0.8
    min_stop_words: int = 2


def quality_features(docs: DataFrame, stop_words: Sequence[str] | None = None) -> DataFrame:
    """docs plus the values that the quality rules look at. Row by row."""
    stops = list(stop_words) if stop_words is not None else sorted({w for ws in STOP_WORDS.values() for w in ws})
    w, ls = t.spaced(F.col("text")), t.lines(F.col("text"))
    share = lambda hits, all_: F.when(all_ > 0, hits / all_).otherwise(0.0)
    docs = docs.withColumn("_w", w).withColumn("_l", ls)
    n, m = F.size("_w"), F.size("_l")
    chars = F.aggregate("_w", F.lit(0), lambda a, x: a + F.length(x))
    return docs.select(
        *[c for c in docs.columns if c not in ("_w", "_l")],
        n.cast("long").alias("n_words"),
        share(chars, n).alias("mean_word_length"),
        share(F.regexp_count(F.col("text"), F.lit("#")), n).alias("hash_ratio"),
        share(F.regexp_count(F.col("text"), F.lit(r"\.\.\.|…")), n).alias("ellipsis_ratio"),
        share(F.size(F.filter("_l", lambda x: x.rlike(r"^[•*-]"))), m).alias("bullet_ratio"),
        share(F.size(F.filter("_l", lambda x: x.rlike(r"(\.\.\.|…)$"))), m).alias("ellipsis_lines"),
        share(F.size(F.filter("_w", lambda x: x.rlike(r"\p{L}"))), n).alias("alphabetic_ratio"),
        F.size(F.array_intersect(F.array_distinct(F.transform("_w", lambda x: F.lower(x))), F.array(*map(F.lit, stops)))).cast("long").alias("n_stop_words"),
    )


def quality_keep(q: Quality = Quality()) -> Column:
    c = F.col
    return (
        c("n_words").between(q.min_words, q.max_words) & c("mean_word_length").between(q.min_mean_length, q.max_mean_length)
        & (c("hash_ratio") <= q.max_symbols) & (c("ellipsis_ratio") <= q.max_symbols) & (c("bullet_ratio") <= q.max_bullets)
        & (c("ellipsis_lines") <= q.max_ellipses) & (c("alphabetic_ratio") >= q.min_alphabetic) & (c("n_stop_words") >= q.min_stop_words)
    )


def quality_filter(docs: DataFrame, q: Quality = Quality()) -> DataFrame:
    return quality_features(docs).filter(quality_keep(q)).select(*docs.columns)


def _chars(col: Column) -> Column:
    return F.aggregate(col, F.lit(0).cast("long"), lambda a, x: a + F.length(x))


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(0.0), 6)


def units(text: Column, unit: str) -> Column:
    """Lines, or paragraphs (between empty lines), trimmed, without empty ones."""
    return t.lines(text) if unit == "line" else F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\n+"), lambda x: F.trim(x)), lambda x: x != "")


def unit_ratios(pieces: Column) -> Column:
    """n_units, dup_fraction and dup_chars: how many pieces there are, and what share of them, and of their characters, is in
    pieces that stand before already."""
    return t.let(pieces, lambda p: t.let(F.array_distinct(p), lambda d: F.struct(F.size(p).cast("long").alias("n_units"), _ratio(F.size(p) - F.size(d), F.size(p)).alias("dup_fraction"), _ratio(_chars(p) - _chars(d), _chars(p)).alias("dup_chars"))))


def text_parts(texts: Sequence[str | None], most: int = PART_CHARS) -> Iterator[Sequence[str | None]]:
    """Successive slices of texts, of `most` characters at most; a longer text ends a slice."""
    begin = held = 0
    for i, x in enumerate(texts):
        size = len(x) if x else 0
        if held and held + size > most:
            yield texts[begin:i]
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield texts[begin:]


def count_ngrams(texts: Sequence[str | None], ns: Sequence[int]) -> dict[str, np.ndarray]:
    """What ngram_ratios() says of texts, counted at once; NaN for fewer than n words. ns ascends.

    Words are numbered, and an n-gram's number comes from that of its first n - 1 words and its last, so that nothing is built
    but arrays of numbers. Words are let go text by text."""
    known: dict[str, int] = {}
    put = known.setdefault
    held = [np.fromiter([put(w, len(known)) for w in WORD.findall(x)] if x else [], np.int64) for x in texts]
    size = np.array([len(x) for x in held], np.int64)
    doc, word = np.repeat(np.arange(len(held)), size), np.concatenate([np.zeros(0, np.int64), *held])
    length = np.fromiter(map(len, known), np.int64, len(known))[word]
    chars = np.bincount(doc, length, len(held))
    upto = np.concatenate([[0], np.cumsum(length)])
    code, out = doc * (len(known) + 1) + word, {}
    for n in range(2, ns[-1] + 1):
        m = max(len(word) - n + 1, 0)
        code = pd.factorize(code[:m] * (len(known) + 1) + word[n - 1 :])[0]
        if n not in ns:
            continue
        inside = np.flatnonzero(doc[:m] == doc[n - 1 :][:m])
        kinds, first, count = np.unique(code[inside], return_index=True, return_counts=True)
        at = inside[first]
        weight, own = upto[at + n] - upto[at], doc[at]
        top, order = np.zeros(len(held)), np.argsort(own, kind="stable")
        begins = np.flatnonzero(np.diff(own[order], prepend=-1))
        if len(begins):
            top[own[order][begins]] = np.maximum.reduceat((count * weight)[order], begins)
        some = size >= n
        for kind, value in (("top", top), ("dup", np.bincount(own, (count - 1) * weight, len(held)))):
            out[f"{kind}_{n}"] = np.divide(value, chars, out=np.full(len(held), np.nan), where=some)
    return out


def ngram_ratios(words_of: Column, ns: Sequence[int]) -> Column:
    """struct of top_<n> and dup_<n> for each n: the share of the words' characters in the most frequent n-gram, and in n-grams
    that stand before already; null for fewer than n words. words_of: a text in lower case.

    An Arrow batch is counted in parts of half a million characters, and nothing is shuffled. To Spark the values count as not
    deterministic, though they are: else a filter on them is pushed below them, and each text goes to Python twice."""
    ns = sorted(ns)
    fields = [f"{kind}_{n}" for n in ns for kind in ("top", "dup")]

    @F.pandas_udf(", ".join(f"{f} double" for f in fields))
    def ratios(texts: pd.Series) -> pd.DataFrame:
        parts = [count_ngrams(x, ns) for x in text_parts(texts.to_numpy())]
        out = {f: np.concatenate([np.zeros(0), *(x[f] for x in parts)]) for f in fields}
        return pd.DataFrame(out, columns=fields).astype(object).where(lambda x: x.notna(), None)

    return ratios.asNondeterministic()(words_of)


def line_repetition(docs: DataFrame, unit: str = "line") -> DataFrame:
    """doc_id and unit_ratios() of lines or paragraphs. Row by row."""
    return docs.select("doc_id", unit_ratios(units(F.col("text"), unit)).alias("_r")).select("doc_id", "_r.*")


def ngram_repetition(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, top_chars and dup_chars (ngram_ratios()) of documents of n words or more. Row by row, so repeated ids are
    documents of their own."""
    own = short_batches(docs).select("doc_id", ngram_ratios(F.lower("text"), [n]).alias("_r")).filter(F.col(f"_r.top_{n}").isNotNull())
    return own.select("doc_id", *(F.round(f"_r.{k}_{n}", 6).alias(f"{k}_chars") for k in ("top", "dup")))


@dataclass(frozen=True)
class Repetition:
    """A document goes if a ratio exceeds its threshold: of lines and paragraphs, of the most frequent n-gram, of n-grams that
    repeat."""

    lines: float = 0.30
    paragraphs: float = 0.30
    line_chars: float = 0.20
    paragraph_chars: float = 0.20
    top: tuple[tuple[int, float], ...] = ((2, 0.20), (3, 0.18), (4, 0.16))
    dup: tuple[tuple[int, float], ...] = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))


def repetition_reasons(docs: DataFrame, r: Repetition = Repetition()) -> DataFrame:
    """docs plus repetition: the names of the thresholds that are exceeded, comma-joined, '' for none. Row by row."""
    rows = short_batches(docs).withColumn("_lp", F.struct(unit_ratios(units(F.col("text"), "line")).alias("l"), unit_ratios(units(F.col("text"), "paragraph")).alias("p")))
    rows = rows.withColumn("_w", ngram_ratios(F.lower("text"), [n for n, _ in (*r.top, *r.dup)]))
    over = lambda name, ratio, most: F.when(ratio > most, F.lit(name))
    lp = F.col("_lp")
    hits = [over("lines", lp["l"]["dup_fraction"], r.lines), over("paragraphs", lp["p"]["dup_fraction"], r.paragraphs), over("line_chars", lp["l"]["dup_chars"], r.line_chars), over("paragraph_chars", lp["p"]["dup_chars"], r.paragraph_chars)]
    hits += [over(f"top_{n}", F.round(F.col("_w")[f"top_{n}"], 6), most) for n, most in r.top]
    hits += [over(f"dup_{n}", F.round(F.col("_w")[f"dup_{n}"], 6), most) for n, most in r.dup]
    return rows.withColumn("repetition", F.concat_ws(",", *hits)).drop("_lp", "_w")


def repetition_filter(docs: DataFrame, r: Repetition = Repetition()) -> DataFrame:
    """The documents that exceed no threshold, with the columns of docs."""
    return repetition_reasons(docs, r).filter("repetition = ''").select(*docs.columns)


def spam_url(pages: DataFrame, domains: Sequence[str] = BLOCKED_DOMAINS) -> DataFrame:
    """Pages whose host, or a parent of it with two labels or more, is listed: explode suffixes, semi-join the list."""
    spark = pages.sparkSession
    listed = spark.createDataFrame([(d,) for d in domains], "suffix string")
    hits = pages.select("page_id", F.explode(t.host_suffixes(t.host(F.col("url")))).alias("suffix")).join(F.broadcast(listed), "suffix", "left_semi")
    return pages.join(hits.select("page_id").distinct(), "page_id", "left_semi")


def term_pattern(terms: Sequence[str]) -> str:
    """Terms between non-word characters; the characters around a hit are part of it, so adjacent hits count once."""
    return r"(?:[^\p{L}\p{N}_]|^)(?:" + "|".join(terms) + r")(?:[^\p{L}\p{N}_]|$)"


def spam_flag(docs: DataFrame, terms: Mapping[str, Sequence[str]] = SPAM_TERMS, threshold: int = 1) -> DataFrame:
    """docs plus spam_reason: names of the lexicons with `threshold` hits or more, comma-joined, '' for none."""
    low = F.lower(F.coalesce("text", F.lit("")))
    return docs.withColumn("spam_reason", F.concat_ws(",", *(F.when(F.regexp_count(low, F.lit(term_pattern(v))) >= threshold, F.lit(f"{k}_lexicon")) for k, v in terms.items())))


@dataclass(frozen=True)
class Spam:
    """Lexicons by language, of which a document's own is used, else that of `default` (none: no hit); domains; a model's
    column, if there is one, and its threshold. `keep` is the share of flagged documents that stay, drawn by hash."""

    adult: Mapping[str, Sequence[str]] = field(default_factory=dict)
    seo: Mapping[str, Sequence[str]] = field(default_factory=dict)
    domains: Sequence[str] = ()
    default: str = "en"
    hits: int = 1
    model_threshold: float = 0.5
    keep: float = 0.0
    seed: int = 13


#: Languages whose terms have no boundaries.
UNSPACED = ("ja", "th", "zh")


def spam_reasons(docs: DataFrame, spam: Spam, language: str = "language", url: str | None = None, model: str | None = None) -> DataFrame:
    """docs plus spam_reason: of spam_url, adult_lexicon, spam_lexicon and spam_model those that hold, in this order,
    comma-joined; '' for none. Row by row; domains and terms are literals of the plan."""
    low, own = F.lower(F.coalesce("text", F.lit(""))), F.coalesce(F.col(language), F.lit(spam.default))

    def lexicon(terms: Mapping[str, Sequence[str]]) -> Column:
        count = lambda k: F.regexp_count(low, F.lit("(?:" + "|".join(terms[k]) + ")" if k in UNSPACED else term_pattern(terms[k]))) >= spam.hits
        mine = [F.when(own == k, count(k)) for k in terms if terms[k]]
        rest = count(spam.default) if terms.get(spam.default) else F.lit(False)
        return F.coalesce(*mine, F.when(~own.isin(*[k for k in terms if terms[k]]), rest), F.lit(False)) if mine else F.lit(False)

    listed = F.arrays_overlap(t.host_suffixes(t.host(F.col(url))), F.array(*map(F.lit, spam.domains))) if url and spam.domains else F.lit(False)
    reasons = [("spam_url", listed), ("adult_lexicon", lexicon(spam.adult)), ("spam_lexicon", lexicon(spam.seo))]
    if model:
        reasons.append(("spam_model", F.col(model) >= spam.model_threshold))
    return docs.withColumn("spam_reason", F.concat_ws(",", *(F.when(F.coalesce(hit, F.lit(False)), F.lit(name)) for name, hit in reasons)))


def spam_filter(docs: DataFrame, spam: Spam, language: str = "language", url: str | None = None, model: str | None = None, key: str = "doc_id") -> DataFrame:
    """spam_reasons() without flagged documents, but for the kept share of them, whose spam_reason tells why. The draw is by
    the hash of `key` and the seed, so it is the same on every run."""
    drawn = t.hash_bucket(F.concat_ws(":", F.lit(str(spam.seed)), F.col(key).cast("string")), 10_000) < int(spam.keep * 10_000)
    return spam_reasons(docs, spam, language, url, model).filter((F.col("spam_reason") == "") | drawn)


def language_tag(docs: DataFrame, margin: float = 0.1, max_chars: int | None = None, stop_words: Mapping[str, Sequence[str]] = STOP_WORDS) -> DataFrame:
    """docs plus language: the one whose frequent words are most of the text (of its first max_chars,
    if given); null if none is, or if the lead over
    the next is under `margin` of the hits. Built-in functions only."""
    w = t.words(F.lower(F.substring("text", 1, max_chars) if max_chars else F.col("text")))
    names = sorted(stop_words)
    counts = [_hits(stop_words[name]).alias(name) for name in names]
    scored = docs.withColumn("_w", w).select(*docs.columns, F.struct(*counts).alias("_c"))
    ranked = F.array_sort(F.array(*(F.struct((-F.col(f"_c.{n}")).alias("neg"), F.lit(n).alias("name")) for n in names)))
    scored = scored.withColumn("_r", ranked)
    best, second, all_ = -F.col("_r")[0]["neg"], -F.col("_r")[1]["neg"], sum((F.col(f"_c.{n}") for n in names), F.lit(0))
    sure = (best > 0) & ((best - second) / all_ >= margin)
    return scored.withColumn("language", F.when(sure, F.col("_r")[0]["name"])).drop("_c", "_r")


def language_filter(docs: DataFrame, targets: Sequence[str], candidates: Sequence[str] = (), keep_all: bool = False, margin: float = 0.1, max_chars: int | None = None, stop_words: Mapping[str, Sequence[str]] = STOP_WORDS) -> DataFrame:
    """language_tag() among candidates and targets, of which only documents in a target language stay (keep_all: all do).
    ValueError for a language without words."""
    names = dict.fromkeys([*candidates, *targets])
    if odd := [n for n in names if n not in stop_words]:
        raise ValueError(f"no words for {', '.join(odd)}; there are {', '.join(sorted(stop_words))}")
    tagged = language_tag(docs, margin, max_chars, {n: stop_words[n] for n in names})
    return tagged if keep_all else tagged.filter(F.col("language").isin(*targets))


def _hits(listed: Sequence[str]) -> Column:
    return F.size(F.filter("_w", lambda x: x.isin(*listed)))


def text_key(content: Column, precision: int = 128) -> Column:
    """The first bits of the SHA-256 of a content, null being one of its own. 64 or 32 bits save space, and merge unlike
    texts where hashes collide."""
    return F.coalesce(F.substring(F.unhex(F.sha2(content, 256)), 1, precision // 8), F.lit(b""))


def exact_dedup(docs: DataFrame, dataset: str = "source", content: Column | None = None, precision: int = 128, seen: DataFrame | None = None) -> DataFrame:
    """One row of each content (default: text), the first by (dataset, doc_id); of rows of one key, one.

    Hashes, keys and row numbers are shuffled to find which rows go (partial minima, then a join whose hot keys can be
    split); the rows themselves only if those are too many to broadcast. Rows whose hash is in seen (h) go too: the index of
    an earlier run, as text_key() gives it. docs must give its rows in the same order whenever it is read, as files do.
    """
    rows = docs.withColumn("_at", F.monotonically_increasing_id())
    keys = rows.select(text_key(F.col("text") if content is None else content, precision).alias("h"), F.col(dataset).alias("d"), F.col("doc_id").alias("i"), "_at")
    first = settled(keys.groupBy("h").agg(F.min(F.struct("d", "i", "_at")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "f._at"), "dedup-first")
    gone = keys.join(first.withColumnRenamed("_at", "f"), "h").filter(F.col("_at") != F.col("f")).select("_at")
    if seen is not None:
        gone = gone.unionByName(keys.join(seen.select("h"), "h", "left_semi").select("_at")).distinct()
    return rows.join(small(settled(gone, "dedup-gone")), "_at", "left_anti").drop("_at")


def sentence_dedup(docs: DataFrame, n: int = 3, min_words: int = 0, min_sentences: int = 1, dataset: str = "source") -> DataFrame:
    """Of every span of n sentences that occurs again, all but the first occurrence (by dataset, doc_id, position) go.

    All spans are judged on the input. A sentence in any span that goes is removed; the rest is joined by blanks; documents
    under the floors go. Documents of fewer than n sentences have no span and stay. Identifiers may be shared by datasets, or
    be null: rows are told apart by number, so docs must give them in the same order whenever it is read, as files do. Spans
    are matched by a 128-bit hash through minima with partial sums; texts are shuffled only if the positions to remove are too
    many to broadcast.
    """
    own = docs.select(F.monotonically_increasing_id().alias("_at"), dataset, "doc_id", t.sentences(F.col("text")).alias("s"))
    spans = own.select("_at", dataset, "doc_id", F.posexplode(t_spans("s", n)).alias("pos", "h"))
    first = spans.groupBy("h").agg(F.min(F.struct(dataset, "doc_id", "_at", "pos")).alias("f"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    first = settled(first.select("h", F.struct("f._at", "f.pos").alias("f")), "spans-first")
    gone = spans.join(first, "h").filter(F.struct("_at", "pos") != F.col("f")).groupBy("_at").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    left = own.join(small(settled(gone, "spans-gone"), 24 + 4 * F.size("gone")), "_at", "left")
    # A byte for each sentence that tells whether a span that goes begins there: looked up by place, whatever its number.
    none = F.array().cast("array<int>")
    marks = t.let(F.coalesce("gone", none), lambda g: F.array_join(F.transform(g, lambda p, k: F.concat(F.repeat(F.lit("0"), p - F.coalesce(F.get(g, k - 1), F.lit(-1)) - 1), F.lit("1"))), "")).cast("binary")
    covered = lambda m, i: F.contains(F.substring(m, F.greatest(i - n + 2, F.lit(1)), F.least(i + 1, F.lit(n))), F.lit(b"1"))
    kept = t.let(marks, lambda m: F.filter(F.col("s"), lambda x, i: ~covered(m, i)))
    out = left.select("doc_id", F.size("s").cast("long").alias("n_before"), F.when(F.col("gone").isNull(), F.col("s")).otherwise(kept).alias("kept"), dataset)
    out = out.select(dataset, "doc_id", "n_before", F.size("kept").cast("long").alias("n_after"), F.array_join("kept", " ").alias("text"))
    return out.filter((F.size(t.spaced(F.col("text"))) >= min_words) & (F.col("n_after") >= min_sentences))


def t_spans(col: str, n: int) -> Column:
    return F.transform(t.ngrams(F.col(col), n), lambda g: F.struct(F.xxhash64(g).alias("a"), F.xxhash64(F.lit(1), g).alias("b")))


def leakage(docs: DataFrame, lang: str = "lang", dataset: str = "source", margin: float = 0.1) -> DataFrame:
    """dataset, kind, n, chars, foreign_chars: documents by whether their lines are in the language that they are listed in.

    pure: no line is surely in another language; whole_foreign: some are, and none is in its own; embedded: both. Lines are
    tagged as by language_tag() (null: neither) and summed by document with partial sums. Documents without lines don't count.
    """
    lines = docs.select("doc_id", lang, dataset, F.explode(t.lines(F.col("text"))).alias("text"))
    tagged = language_tag(lines, margin)
    foreign, size = F.col("language") != F.col(lang), F.length("text").cast("long")
    per = tagged.groupBy("doc_id", dataset).agg(F.sum(size).alias("chars"), F.coalesce(F.sum(F.when(foreign, size)), F.lit(0)).alias("foreign_chars"), F.count_if(F.col("language") == F.col(lang)).alias("own"))
    kind = F.when(F.col("foreign_chars") == 0, "pure").when(F.col("own") == 0, "whole_foreign").otherwise("embedded")
    return per.groupBy(dataset, kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("foreign_chars").alias("foreign_chars"))


def leakage_parts(docs: DataFrame, lang: str = "lang", dataset: str = "source", margin: float = 0.1, least_chars: int = 0, max_paragraphs: int = 40) -> DataFrame:
    """dataset, doc_id, lang, text, size, language of the first max_paragraphs lines of each document, of those of least_chars
    characters or more; language is null where it is unsure."""
    lines = docs.select(dataset, "doc_id", lang, F.explode(F.slice(t.lines(F.col("text")), 1, max_paragraphs)).alias("text")).filter(F.length("text") >= least_chars)
    return language_tag(lines, margin).withColumn("size", F.length("text").cast("long"))


def leakage_languages(parts: DataFrame, lang: str = "lang", k: int = 10) -> DataFrame:
    """language, n, chars of the lines in another language than their document's: the k with most characters."""
    own = parts.filter(F.col("language") != F.col(lang)).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars"))
    return own.orderBy(F.desc("chars"), "language").limit(k)


def leakage_tokens(parts: DataFrame, tokens: Sequence[str], lang: str = "lang") -> DataFrame:
    """token, place, n: how often these words stand in lines of another language ("foreign") and of the document's ("own")."""
    found = parts.filter("language is not null").select(F.when(F.col("language") != F.col(lang), "foreign").otherwise("own").alias("place"), F.explode(t.words(F.lower("text"))).alias("token"))
    return found.filter(F.col("token").isin(*tokens)).groupBy("token", "place").agg(F.count(F.lit(1)).alias("n"))
