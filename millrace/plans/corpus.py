"""Queries over the driver's tables, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as t
from millrace.operators import curate, stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_once_held(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """As read(), without Parquet's vectored reads: they hold a row group's whole column a second time, beside the heap, until
    the task's thread ends. For texts that is hundreds of MB a task where row groups are large."""
    return spark.read.option("parquet.hadoop.vectored.io.enabled", "false").parquet(f"{sf_dir}/{name}.parquet")


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


STOPS = _list(stats.ALL_STOPS)
SPACED = r"regexp_extract_all(text, '[^ \t\r\n]+')"
LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
CONTENT = f"list_filter({WORDS}, lambda x: length(x) >= 2 AND regexp_matches(x, '\\p{{L}}') AND x NOT IN ({STOPS}))"
FEATURES = rf"""
f AS (SELECT *, {SPACED} AS w, {LINES} AS l FROM documents),
q AS (SELECT * EXCLUDE (w, l), len(w)::BIGINT AS n_words,
  CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) ELSE 0.0 END AS mean_word_length,
  CASE WHEN len(w) > 0 THEN len(regexp_extract_all(text, '#')) / len(w) ELSE 0.0 END AS hash_ratio,
  CASE WHEN len(w) > 0 THEN len(regexp_extract_all(text, '\.\.\.|…')) / len(w) ELSE 0.0 END AS ellipsis_ratio,
  CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: regexp_matches(x, '^[•*-]'))) / len(l) ELSE 0.0 END AS bullet_ratio,
  CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)$'))) / len(l) ELSE 0.0 END AS ellipsis_lines,
  CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) / len(w) ELSE 0.0 END AS alphabetic_ratio,
  len(list_intersect(list_distinct(list_transform(w, lambda x: lower(x))), [{STOPS}]))::BIGINT AS n_stop_words FROM f),
kept AS (SELECT * FROM q WHERE n_words BETWEEN 50 AND 100000 AND mean_word_length BETWEEN 3 AND 10 AND hash_ratio <= 0.1 AND ellipsis_ratio <= 0.1
  AND bullet_ratio <= 0.9 AND ellipsis_lines <= 0.3 AND alphabetic_ratio >= 0.8 AND n_stop_words >= 2)"""


@query(f"""WITH {FEATURES}, u AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY text ORDER BY source, doc_id) = 1),
c AS (SELECT source, count(*) AS doc_count, sum(len({CONTENT}))::BIGINT AS word_count FROM u GROUP BY source)
SELECT source, doc_count, word_count, round(word_count / doc_count, 6) AS avg_doc_words, round(word_count / sum(word_count) OVER (), 6) AS share_of_total_words FROM c""")
def stats_by_dataset(spark, d):
    # Copies are equally good or bad, so the cheaper operator, which reads its input more than once, comes first.
    return stats.corpus_stats(curate.quality_filter(curate.exact_dedup(read(spark, d, "documents"))), "source")


@query(f"SELECT count(*) AS doc_count, sum(len({CONTENT}))::BIGINT AS word_count, round(sum(len({CONTENT})) / count(*), 6) AS avg_doc_words FROM documents")
def corpus_totals(spark, d):
    return stats.corpus_stats(read(spark, d, "documents"))


@query(f"""WITH c AS (SELECT lang, count(*) AS doc_count, sum(len({CONTENT}))::BIGINT AS word_count FROM documents GROUP BY lang)
SELECT lang, doc_count, word_count, round(word_count / doc_count, 6) AS avg_doc_words, round(word_count / sum(word_count) OVER (), 6) AS share_of_total_words FROM c""")
def stats_by_domain(spark, d):
    return stats.corpus_stats(read(spark, d, "documents"), "lang")


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({CONTENT}) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 200")
def word_freq_top_k(spark, d):
    return stats.word_freq_top_k(read(spark, d, "documents"))


@query("SELECT source AS dataset, CASE WHEN min(lang) <> max(lang) THEN '_mixed' ELSE min(lang) END AS domain FROM documents GROUP BY source")
def dataset_to_domain(spark, d):
    return stats.dataset_to_domain(read(spark, d, "documents"))


@query(f"WITH {FEATURES} SELECT doc_id, n_words, round(mean_word_length, 6) AS mean_word_length, round(alphabetic_ratio, 6) AS alphabetic_ratio, round(bullet_ratio, 6) AS bullet_ratio, n_stop_words FROM kept")
def quality_filter(spark, d):
    own = curate.quality_features(read(spark, d, "documents")).filter(curate.quality_keep())
    r = lambda c: F.round(c, 6).alias(c)
    return own.select("doc_id", "n_words", r("mean_word_length"), r("alphabetic_ratio"), r("bullet_ratio"), "n_stop_words")


def _repetition_sql(pieces: str) -> str:
    return f"""WITH p AS (SELECT doc_id, {pieces} AS p FROM documents), u AS (SELECT doc_id, p, list_distinct(p) AS d FROM p)
SELECT doc_id, len(p)::BIGINT AS n_units, round(CASE WHEN len(p) > 0 THEN (len(p) - len(d)) / len(p) ELSE 0.0 END, 6) AS dup_fraction,
round(CASE WHEN len(p) > 0 THEN (list_sum(list_transform(p, lambda x: length(x))) - list_sum(list_transform(d, lambda x: length(x)))) / list_sum(list_transform(p, lambda x: length(x))) ELSE 0.0 END, 6) AS dup_chars FROM u"""


@query(_repetition_sql(LINES))
def line_repetition(spark, d):
    return curate.line_repetition(read(spark, d, "documents"))


@query(_repetition_sql(r"list_filter(list_transform(string_split_regex(text, '\n\n+'), lambda x: trim(x, ' ')), lambda x: x <> '')"))
def paragraph_repetition(spark, d):
    return curate.line_repetition(read(spark, d, "documents"), "paragraph")


for _n in range(2, 11):

    @query(
        rf"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, chars, array_to_string(w[i:i+{_n - 1}], ' ') AS g, list_sum(list_transform(w[i:i+{_n - 1}], lambda x: length(x))) AS size
  FROM (SELECT doc_id, w, list_sum(list_transform(w, lambda x: length(x))) AS chars, unnest(range(1, len(w) - {_n - 2})) AS i FROM w)),
c AS (SELECT doc_id, chars, g, size, count(*) AS c FROM g GROUP BY ALL)
SELECT doc_id, round(max(c * size) / chars, 6) AS top_chars, round(sum((c - 1) * size) / chars, 6) AS dup_chars FROM c GROUP BY doc_id, chars""",
        f"ngram_repetition_{_n}",
    )
    def _ngrams(spark, d, n=_n):
        return curate.ngram_repetition(read_once_held(spark, d, "documents"), n)


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY source, doc_id) = 1")
def exact_dedup(spark, d):
    return curate.exact_dedup(read(spark, d, "documents")).select("doc_id", "source")


@query(r"""WITH s AS (SELECT source, doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents),
sp AS (SELECT source, doc_id, i - 1 AS pos, array_to_string(s[i:i+2], ' ') AS h FROM (SELECT *, unnest(range(1, len(s) - 1)) AS i FROM s)),
m AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY source, doc_id, pos) AS rn FROM sp),
g AS (SELECT DISTINCT source, doc_id, pos + k AS pos FROM m, (VALUES (0), (1), (2)) v(k) WHERE rn > 1),
e AS (SELECT source, doc_id, i - 1 AS pos, s[i] AS x FROM (SELECT source, doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)),
k AS (SELECT e.source, e.doc_id, count(*) AS n_after, string_agg(x, ' ' ORDER BY e.pos) AS text FROM e LEFT JOIN g ON g.source = e.source AND g.doc_id = e.doc_id AND g.pos = e.pos WHERE g.pos IS NULL GROUP BY e.source, e.doc_id)
SELECT s.source, s.doc_id, len(s)::BIGINT AS n_before, n_after, text FROM s JOIN k ON s.source = k.source AND s.doc_id = k.doc_id""")
def sentence_dedup(spark, d):
    return curate.sentence_dedup(read(spark, d, "documents"))


@query(f"""WITH h AS (SELECT page_id, url, string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.') AS p FROM pages),
x AS (SELECT page_id, url, unnest(list_transform(range(1, len(p)), lambda i: array_to_string(p[i:], '.'))) AS s FROM h)
SELECT DISTINCT page_id, url FROM x WHERE s IN ({_list(curate.BLOCKED_DOMAINS)})""")
def spam_url(spark, d):
    return curate.spam_url(read(spark, d, "pages")).select("page_id", "url")


_REASON = "concat_ws(',', " + ", ".join(f"CASE WHEN len(regexp_extract_all(lower(text), '{curate.term_pattern(v)}')) >= 1 THEN '{k}_lexicon' END" for k, v in curate.SPAM_TERMS.items()) + ")"


@query(f"SELECT page_id, {_REASON.replace('text', 'html')} AS spam_reason FROM pages")
def spam_lexicon(spark, d):
    pages = read(spark, d, "pages").select("page_id", F.col("html").alias("text"))
    return curate.spam_flag(pages).select("page_id", "spam_reason")


@query(f"SELECT source, {_REASON} AS spam_reason, count(*) AS n FROM documents GROUP BY ALL")
def reason_counts(spark, d):
    return curate.spam_flag(read(spark, d, "documents")).groupBy("source", "spam_reason").agg(F.count(F.lit(1)).alias("n"))


_LANGS = sorted(curate.STOP_WORDS)
_LANGUAGE = rf"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents),
c AS (SELECT doc_id, lang, unnest([{_list(_LANGS)}]) AS name, unnest([{", ".join(f"len(list_filter(w, lambda x: x IN ({_list(curate.STOP_WORDS[k])})))" for k in _LANGS)}]) AS n FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, name) AS rn, lead(n) OVER (PARTITION BY doc_id ORDER BY n DESC, name) AS second, sum(n) OVER (PARTITION BY doc_id) AS total FROM c),
t AS (SELECT doc_id, lang, CASE WHEN n > 0 AND (n - second) / total >= 0.1 THEN name END AS language FROM r WHERE rn = 1)"""


@query(_LANGUAGE + " SELECT doc_id, language FROM t")
def language_tag(spark, d):
    return curate.language_tag(read(spark, d, "documents")).select("doc_id", "language")


@query(_LANGUAGE + " SELECT doc_id, language FROM t WHERE language IN ('en', 'de')")
def language_filter(spark, d):
    return curate.language_filter(read(spark, d, "documents"), ["en", "de"], _LANGS).select("doc_id", "language")


@query(_LANGUAGE + " SELECT lang, language, count(*) AS n FROM t GROUP BY ALL")
def language_agreement(spark, d):
    return curate.language_tag(read(spark, d, "documents")).groupBy("lang", "language").agg(F.count(F.lit(1)).alias("n"))


_UNITS = r"""u AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS t, text FROM documents),
units AS (SELECT doc_id, len(t)::BIGINT AS tokens, len(list_filter(t, lambda x: regexp_matches(x, '\p{L}')))::BIGINT AS words, length(text)::BIGINT AS chars, octet_length(encode(text))::BIGINT AS bytes FROM u)"""


@query(f"WITH {_UNITS} SELECT * FROM units")
def corpus_doc_stats(spark, d):
    return stats.doc_units(read(spark, d, "documents"))


@query(f"WITH {_UNITS} SELECT round(sum(tokens) / sum(words), 6) AS fertility, round(sum(tokens) / sum(bytes), 6) AS tokens_per_byte, round(sum(chars) / sum(tokens), 6) AS chars_per_token, sum(tokens)::BIGINT AS ctc_total FROM units")
def tokenizer_ratios(spark, d):
    return stats.tokenizer_ratios(stats.doc_units(read(spark, d, "documents")))


_COUNTS = f"c AS (SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY word), p AS (SELECT n / sum(n) OVER () AS p FROM c)"


@query(f"WITH {_COUNTS} SELECT round(ln(sum(pow(p, 2.5))) / (1 - 2.5) / ln(count(*)), 6) AS renyi_efficiency FROM p")
def renyi_efficiency(spark, d):
    words = read(spark, d, "documents").select(F.explode(t.words(F.lower("text"))).alias("word"))
    return stats.renyi_efficiency(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH {_COUNTS} SELECT round(-sum(p * ln(p)) / ln(count(*)), 6) AS renyi_efficiency FROM p")
def shannon_efficiency(spark, d):
    words = read(spark, d, "documents").select(F.explode(t.words(F.lower("text"))).alias("word"))
    return stats.renyi_efficiency(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), 1)


@query("SELECT source, count(*) AS n_rows, count(*) FILTER (trim(coalesce(text, '')) = '') AS empty_text, count(*) FILTER (lang IS NULL OR lang = '') AS missing_lang, count(*) FILTER (n_chars IS NULL) AS missing_n_chars FROM documents GROUP BY source")
def source_profile(spark, d):
    return stats.source_profile(read(spark, d, "documents"), ["lang", "n_chars"])


@query("SELECT doc_id, source, before::BIGINT AS before FROM (SELECT doc_id, source, coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 20000")
def sample_corpus(spark, d):
    return stats.source_quota(read(spark, d, "documents"), 20_000).select("doc_id", "source", "before")


_BUCKET = "(('0x' || substring(sha256(doc_id::VARCHAR), 1, 8))::UINTEGER % 100)::INT"


@query(f"SELECT doc_id, bucket, CASE WHEN bucket < 70 THEN 'train' WHEN bucket < 85 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, {_BUCKET} AS bucket FROM documents)")
def hash_split(spark, d):
    return read(spark, d, "documents").select("doc_id", t.hash_bucket(F.col("doc_id")).alias("bucket")).withColumn("split", t.split_of(F.col("bucket")))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_run(spark, d):
    return stats.latest_by(read(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("""WITH t AS (SELECT source AS fam, doc_id AS id, ((doc_id * 37) % 1000) / 20000.0::DOUBLE AS p FROM documents),
s AS (SELECT *, (count(*) OVER (PARTITION BY fam) - row_number() OVER (PARTITION BY fam ORDER BY p, id) + 1) * p AS s FROM t)
SELECT fam, id, p, round(least(max(s) OVER (PARTITION BY fam ORDER BY p, id ROWS UNBOUNDED PRECEDING), 1.0::DOUBLE), 6) AS p_holm FROM s""")
def holm(spark, d):
    tests = read(spark, d, "documents").select(F.col("source").alias("fam"), F.col("doc_id").alias("id"), ((F.col("doc_id") * 37 % 1000) / F.lit(20000.0)).alias("p"))
    return stats.holm(tests, "fam")


@query("SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (SELECT source || chr(9) || sum(octet_length(encode(text))) || chr(9) || count(*) AS line FROM documents GROUP BY source)")
def corpus_digest(spark, d):
    lines = read(spark, d, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("c")).select(F.concat_ws("\t", "source", "b", "c").alias("line"))
    return lines.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest"))  # a line for each source


@query(f"SELECT source, n_words, rank FROM (SELECT source, n_words, row_number() OVER (PARTITION BY source ORDER BY n_words DESC, doc_id) AS rank FROM (SELECT source, doc_id, len({SPACED})::BIGINT AS n_words FROM documents)) WHERE rank <= 3")
def longest_by_source(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("n_words"), "doc_id")
    own = read(spark, d, "documents").select("source", "doc_id", F.size(t.spaced(F.col("text"))).cast("long").alias("n_words"))
    return own.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").drop("doc_id")
