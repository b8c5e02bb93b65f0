"""Queries that go through files, records of runs, lexicons and converters, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as t
from millrace.operators import convert, curate, morphology, reports, segment, stats, tasks, tokenizers
from millrace.plans.corpus import _BUCKET, CONTENT, FEATURES, LINES, SPACED, WORDS, _list, query, read
from millrace.plans.formats import _LANG_COUNTS, _LEAK, _WORDS, _foreign_sql, _segmented
from millrace.sources import markup, records, storage

FLAT = r"trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ')"
_SPLIT = f"CASE WHEN {_BUCKET} < 70 THEN 'train' WHEN {_BUCKET} < 85 THEN 'validation' ELSE 'test' END"


def _split(docs):
    return docs.withColumn("split", t.split_of(t.hash_bucket(F.col("doc_id"))))


# Files: written by the library's own sinks and read again


@query("SELECT 'documents:' || doc_id AS uid, doc_id::VARCHAR AS doc_id, text FROM documents WHERE trim(text) <> ''")
def byte_shards(spark, d):
    """Gzip JSONL shards that are closed at 64 kB."""
    at = storage.shared_folder(spark, "bytes")
    storage.write_byte_shards(read(spark, d, "documents").select("doc_id", "text"), at, 1 << 16)
    return records.read_jsonl(spark, at, "documents").select("uid", "doc_id", "text")


@query("SELECT item_id::VARCHAR AS doc_id, text FROM benchmark WHERE trim(text) <> ''")
def json_round_trip(spark, d):
    """A JSON file for each item."""
    at = storage.shared_folder(spark, "json")
    read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text").write.option("maxRecordsPerFile", 1).json(at)
    return records.read_json(spark, at, "benchmark").select("doc_id", "text")


@query("SELECT doc_id::VARCHAR AS doc_id, source || chr(10) || chr(10) || trim(text, ' ') AS text FROM documents WHERE trim(text, ' ') <> ''")
def legal_sections(spark, d):
    """Legal records without text, whose sections are joined."""
    at = storage.shared_folder(spark, "legal")
    storage.write_byte_shards(read(spark, d, "documents").filter("trim(text) <> ''").select("doc_id", F.col("source").alias("jedro"), F.col("text").alias("izrek")), at)
    return records.read_legal(spark, at, "legal", ["claim"]).select("doc_id", "text")


@query("SELECT doc_id::VARCHAR AS id, text, source AS dataset FROM documents WHERE source IN ((SELECT min(source) FROM documents), (SELECT max(source) FROM documents))")
def curated_subset(spark, d):
    """Curated shards of all datasets, of which two are read."""
    docs, at = read(spark, d, "documents"), storage.shared_folder(spark, "curated")
    storage.write_byte_shards(docs.select(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("dataset"), F.col("lang").alias("domain")), at)
    first = docs.agg(F.min("source"), F.max("source")).first()  # two names
    return records.read_curated(spark, at, [first[0], first[1]]).select("id", "text", "dataset")


@query("SELECT doc_id::VARCHAR AS doc_id, text, 'documents:' || doc_id AS uid FROM documents WHERE trim(text) <> ''")
def columnar_scan(spark, d):
    return records.read_columnar(spark, f"{d}/documents.parquet", "documents").select("doc_id", "text", "uid")


@query(f"SELECT 'd:' || doc_id AS uid, text, len({SPACED})::BIGINT AS n_words FROM documents")
def annotation_join(spark, d):
    docs = read(spark, d, "documents").select(t.uid(F.lit("d"), F.col("doc_id")).alias("uid"), "text")
    return records.join_annotations(docs, docs.select("uid", F.size(t.spaced(F.col("text"))).cast("long").alias("n_words")))


@query("SELECT doc_id, quality::VARCHAR AS quality, CASE WHEN toxic = 1 THEN '1' END AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def sidecar_join(spark, d):
    """Labels as a metadata table in which '-' stands for nothing."""
    at = storage.shared_folder(spark, "sidecar")
    read(spark, d, "labels").select(F.concat(F.lit("doc_"), "doc_id").alias("key"), "quality", F.when(F.col("toxic") == 1, "1").otherwise("-").alias("toxic")).write.option("sep", "\t").option("header", True).csv(at)
    side = records.read_sidecar(spark, at, "key", {"quality": "quality", "toxic": "toxic"}).withColumn("_key", F.regexp_replace("_key", "^doc_", ""))
    docs = read(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), "doc_id").alias("stem"))
    return records.join_sidecar(docs, side, F.col("stem"), r"^f(\d+)$").select("doc_id", "quality", "toxic")


@query(f"SELECT item_id::VARCHAR AS id, replace({FLAT}, '\"', '') AS text, CASE WHEN item_id % 2 = 0 THEN 'positive' ELSE 'negative' END AS label FROM benchmark WHERE {FLAT} <> ''")
def sentiment_tsv(spark, d):
    at = storage.shared_folder(spark, "sentiment")
    rows = read(spark, d, "benchmark").select(F.lit("").alias("doc_id"), F.col("item_id").alias("id"), F.replace(t.flatten_spaces(F.col("text")), F.lit('"'), F.lit("")).alias("text"), F.when(F.col("item_id") % 2 == 0, "pos").otherwise("Negative").alias("polarity"))
    rows.write.option("sep", "\t").option("header", True).csv(at)
    found = records.read_sentiment_tsv(spark, [at])
    return found.select("id", "text", tasks.sentiment_label(F.col("label")).alias("label"))


@query(f"WITH {_WORDS} SELECT form AS lemma, array_to_string(morphemes, '+') AS morphemes, length(form) % 4 > 1 AS verified FROM m WHERE length(form) % 4 <> 1")
def word_relations(spark, d):
    """Splits of words as a relation table; one of score 0 is dropped, an empty score is not verified."""
    at, n = storage.shared_folder(spark, "relations"), F.length("form") % 4
    score = F.when(n == 0, "").when(n == 1, "0").otherwise((n - 1).cast("string"))
    none = F.lit("x")
    _segmented(spark, d).select(F.concat_ws("\t", none, "form", none, F.array_join("morphemes", "_"), none, F.lit("N"), none, none, none, F.lit("r"), none, score).alias("value")).write.text(at)
    return records.read_relations(spark, at).select("lemma", F.array_join("morphemes", "+").alias("morphemes"), "verified")


@query("SELECT 'e' || item_id AS entry_id, w[1] AS lemma, len(w)::BIGINT AS n_forms, w[1] = w[2] AS same FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark) WHERE len(w) > 1")
def lexicon_xml(spark, d):
    """An entry for each benchmark item: its first word is the lemma, all its words are forms."""
    words = t.find_all(F.col("text"), "[A-Za-z]+")
    form = lambda w, i: F.concat(F.lit("<wordForm><msd>"), i.cast("string"), F.lit("</msd><orthography><form>"), w, F.lit("</form></orthography></wordForm>"))
    rows = read(spark, d, "benchmark").withColumn("w", words).filter(F.size("w") > 1)
    body = F.concat(F.lit('<lexicon xmlns="http://example.org/x"><entry id="e'), F.col("item_id"), F.lit('"><head><lemma>'), F.get("w", F.lit(0)), F.lit("</lemma></head><body>"), F.array_join(F.transform("w", form), ""), F.lit("</body></entry></lexicon>"))
    found = markup.lexicon_of(rows.select(F.col("item_id").cast("string").alias("name"), F.encode(body, "utf-8").alias("content")))
    return found.select("entry_id", "lemma", F.size("forms").cast("long").alias("n_forms"), (F.get("forms", F.lit(0))["form"] == F.get("forms", F.lit(1))["form"]).alias("same"))


@query(r"SELECT 'i' || item_id AS doc_id, trim(text, ' ') || chr(10) || 'end' AS text, 'T' || item_id AS title FROM (SELECT item_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ') AS text FROM benchmark)")
def corpus_xml(spark, d):
    safe = F.replace(F.replace(t.flatten_spaces(F.col("text")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.concat(F.lit('<corpus><doc id="i'), F.col("item_id"), F.lit('" title="T'), F.col("item_id"), F.lit('" url=""><p> '), safe, F.lit(" </p><p> </p><p>end</p></doc></corpus>"))
    files = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.encode(body, "utf-8").alias("content"))
    return markup.parse(files, markup.corpus_xml, "benchmark").select("doc_id", "text", F.col("metadata")["title"].alias("title"))


@query(f"SELECT s.split, count(d.doc_id) AS n FROM (VALUES ('train'), ('test'), ('extra')) s(split) LEFT JOIN (SELECT doc_id, {_SPLIT} AS split FROM documents) d ON d.split = s.split GROUP BY s.split")
def split_writer(spark, d):
    return storage.write_splits(_split(read(spark, d, "documents").select("doc_id", "text")), storage.shared_folder(spark, "splits"), ["train", "test", "extra"])


@query(f"SELECT 'd:' || doc_id AS uid, len({SPACED})::BIGINT AS n_words FROM documents WHERE len({SPACED}) > 0")
def text_sidecar(spark, d):
    """Texts and their annotations in two tables, of which the second is read again."""
    at = storage.shared_folder(spark, "texts")
    n = F.size(t.spaced(F.col("text"))).cast("long")
    docs = read(spark, d, "documents").select(t.uid(F.lit("d"), F.col("doc_id")).alias("uid"), "text", F.when(n > 0, n).alias("n_words"))
    storage.write_with_sidecar(docs, at, ["n_words"])
    return spark.read.schema("uid string, n_words long").json(f"{at}/annotations").filter("n_words is not null")


@query(f"SELECT doc_id, len({SPACED}) >= 50 AS kept FROM documents")
def exclusion_sink(spark, d):
    docs = read(spark, d, "documents")
    return storage.write_kept_and_excluded(docs, F.size(t.spaced(F.col("text"))) >= 50, storage.shared_folder(spark, "kept")).select("doc_id", "kept")


@query(f"SELECT line, count(*) AS n FROM (SELECT {FLAT} AS line FROM documents) WHERE line <> '' GROUP BY line")
def sample_cache(spark, d):
    at = storage.shared_folder(spark, "lines")
    storage.write_line_sample(read(spark, d, "documents"), at)
    return spark.read.text(at).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_WORDS} SELECT form, array_to_string(morphemes, '+') AS morphemes FROM m")
def lexicon_tables(spark, d):
    at = storage.shared_folder(spark, "lexicon")
    storage.write_lexicon(_segmented(spark, d).select("form", "morphemes", F.col("form").alias("lemma")), at)
    return storage.read_lexicon_table(spark, at).select("form", F.array_join("morphemes", "+").alias("morphemes"))


@query("SELECT DISTINCT lower(source) AS term FROM documents WHERE source <> ''")
def term_list(spark, d):
    at = storage.shared_folder(spark, "terms")
    rows = read(spark, d, "documents").select(F.concat(F.lit("  "), F.upper("source")).alias("value"))
    rows.unionByName(spark.createDataFrame([("# note",), ("",)], "value string")).write.text(at)
    return records.read_terms_of(spark, {"xx": at}, "xx")


# Records


@query("SELECT text, source || ':' || doc_id AS id, source AS dataset, lang AS domain, doc_id, n_chars::VARCHAR AS n_chars, 'x' AS meta_domain FROM documents")
def convert_record(spark, d):
    docs = read(spark, d, "documents")
    rows = docs.select(t.uid(F.col("source"), F.col("doc_id")).alias("uid"), "source", "text", F.col("lang").alias("domain"), "doc_id", F.create_map(F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit("domain"), F.lit("x")).alias("metadata"))
    return convert.convert(rows, metadata=["n_chars", "domain"])


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN source ELSE 'idx-' || lpad(doc_id::VARCHAR, 8, '0') END AS id FROM documents")
def synthesized_ids(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("").alias("_id"), F.when(F.col("doc_id") % 3 == 1, F.col("source")).alias("uid"))
    return convert.numbered_ids(docs, convert.probe_doc_id(docs, ["id", "_id", "uid"]), F.col("doc_id")).select("doc_id", "id")


@query(rf"SELECT doc_id, array_to_string(list_transform(w, lambda x, i: x || CASE WHEN i < len(w) AND length(x) % 2 = 0 THEN ' ' ELSE '' END), '') AS text FROM (SELECT doc_id, {SPACED} AS w FROM documents)")
def render_sentence(spark, d):
    token = lambda w: F.struct(w.alias("form"), (F.length(w) % 2 == 0).alias("space_after"))
    docs = read(spark, d, "documents").select("doc_id", F.transform(t.spaced(F.col("text")), token).alias("tokens"))
    return docs.select("doc_id", records.render_sentence(F.col("tokens")).alias("text"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0') END AS at FROM events")
def iso_times(spark, d):
    return read(spark, d, "events").select("event_id", convert.iso8601(F.col("ts")).alias("at"))


@query("SELECT doc_id, lang || '-x' AS tokenizer, n_chars::BIGINT AS vocab FROM documents")
def run_keys(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.concat_ws("-", "lang", F.lit("x"), "n_chars").alias("key"))
    return docs.select("doc_id", convert.run_key(F.col("key")).alias("k")).select("doc_id", "k.*")


@query("SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0) ELSE printf('%.1f MiB', n / 1048576.0) END AS size FROM (SELECT doc_id, n_chars * 1000 AS n FROM documents)")
def human_bytes(spark, d):
    return read(spark, d, "documents").select("doc_id", convert.human_bytes(F.col("n_chars") * 1000).alias("size"))


@query()
def hash_split_blake2s(spark, d):
    """Splits by BLAKE2s, which neither SQL dialect has; a test holds them against hashlib."""
    return tasks.assign_splits(read(spark, d, "documents").select("doc_id"), key="doc_id")


# Converters


@query("SELECT 'documents:' || doc_id AS id, source AS sentence1, lang AS sentence2, '' AS word, n_chars % 2 = 1 AS label FROM documents")
def convert_wic(spark, d):
    return tasks.wic(read(spark, d, "documents").select("doc_id", F.col("source").alias("sentence1"), F.col("lang").alias("sentence2"), (F.col("n_chars") % 2).alias("label")), "documents")


@query("SELECT 'documents:' || doc_id AS id, source AS premise, lang AS choice1, '' AS choice2, CASE WHEN n_chars % 2 = 1 THEN 'effect' ELSE 'cause' END AS question, (n_chars % 2)::INT AS label FROM documents")
def convert_copa(spark, d):
    odd = F.col("n_chars") % 2
    rows = read(spark, d, "documents").select("doc_id", F.col("source").alias("premise"), F.col("lang").alias("choice1"), F.when(odd == 1, "effect").otherwise("").alias("question"), F.when(odd == 1, "1").otherwise("none").alias("label"))
    return tasks.copa(rows, "documents")


@query(f"SELECT 'documents:' || doc_id AS id, len(list_filter(w, lambda x: length(x) > 6))::BIGINT AS n_long FROM (SELECT doc_id, {SPACED} AS w FROM documents)")
def convert_spans(spark, d):
    """A span for each word, labelled by its length; one label is allowed."""
    span = lambda w, i: F.struct(i.alias("start"), (i + 1).alias("end"), F.when(F.length(w) > 6, "long").otherwise("short").alias("label"))
    rows = read(spark, d, "documents").select("doc_id", "text", F.transform(t.spaced(F.col("text")), span).alias("spans"))
    return tasks.spans(rows, "documents", ["long"]).select("id", F.size("spans").cast("long").alias("n_long"))


@query(r"""WITH c AS (SELECT conv_id, turn, text, lead(text) OVER w AS answer, first(text) OVER w AS passage FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT 'conversations:' || conv_id || '-q' || turn || '-a0' AS id, coalesce(passage, '') AS passage, regexp_replace(coalesce(text, '') || chr(10) || coalesce(answer, ''), '^\s+|\s+$', '', 'g') AS question, false AS label FROM c""")
def multirc_flatten(spark, d):
    """Each turn as a question whose one answer is the next turn."""
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    answer = lambda i: F.array(F.struct(F.get("t", i + 1)["text"].alias("text"), F.lit(0).alias("idx"), F.lit("").alias("label")))
    asked = F.transform("t", lambda x, i: F.struct(x["text"].alias("question"), x["turn"].alias("idx"), answer(i).alias("answers")))
    rows = turns.select(F.col("conv_id").alias("idx"), F.struct(F.get("t", F.lit(0))["text"].alias("text"), asked.alias("questions")).alias("passage"))
    return tasks.multirc(rows, "conversations")


@query(f"SELECT split, label, count(*) AS n FROM (SELECT l.toxic::VARCHAR AS label, {_SPLIT} AS split FROM labels l SEMI JOIN documents d ON d.doc_id = l.doc_id) GROUP BY ALL")
def label_distribution(spark, d):
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id"), "doc_id", "left_semi")
    return reports.label_distribution(_split(rows), "toxic")


@query(f"SELECT split, label, count(*) AS n FROM (SELECT {_SPLIT} AS split, unnest(list_transform({SPACED}, lambda x: CASE WHEN length(x) > 6 THEN 'long' ELSE 'short' END)) AS label FROM documents) GROUP BY ALL")
def span_label_distribution(spark, d):
    span = lambda w: F.struct(F.when(F.length(w) > 6, "long").otherwise("short").alias("label"))
    rows = read(spark, d, "documents").select("doc_id", F.transform(t.spaced(F.col("text")), span).alias("spans"))
    return reports.label_distribution(_split(rows), spans="spans")


# Curation


_RATIOS = [
    *(f"""p{k} AS (SELECT doc_id, {pieces} AS p FROM documents), r{k} AS (SELECT doc_id, CASE WHEN len(p) > 0 THEN round((len(p) - len(list_distinct(p))) / len(p), 6) ELSE 0 END AS f,
CASE WHEN len(p) > 0 THEN round((list_sum(list_transform(p, lambda x: length(x))) - list_sum(list_transform(list_distinct(p), lambda x: length(x)))) / list_sum(list_transform(p, lambda x: length(x))), 6) ELSE 0 END AS c FROM p{k})"""
      for k, pieces in enumerate((LINES, r"list_filter(list_transform(string_split_regex(text, '\n\n+'), lambda x: trim(x, ' ')), lambda x: x <> '')"))),
    f"w AS (SELECT doc_id, w, list_sum(list_transform(w, lambda x: length(x))) AS chars FROM (SELECT doc_id, {WORDS} AS w FROM documents))",
    *(f"""g{n} AS (SELECT doc_id, round(max(c * size) / any_value(chars), 6) AS top, round(sum((c - 1) * size) / any_value(chars), 6) AS dup FROM (
SELECT doc_id, chars, g, any_value(size) AS size, count(*) AS c FROM (SELECT doc_id, chars, array_to_string(w[i:i+{n - 1}], ' ') AS g, list_sum(list_transform(w[i:i+{n - 1}], lambda x: length(x))) AS size
FROM (SELECT *, unnest(range(1, len(w) - {n - 2})) AS i FROM w)) GROUP BY doc_id, chars, g) GROUP BY doc_id)""" for n in range(2, 11)),
]
_REP = curate.Repetition()
_TESTS = ["r0.f > 0.30", "r1.f > 0.30", "r0.c > 0.20", "r1.c > 0.20", *(f"coalesce(g{n}.top, 0) > {x}" for n, x in _REP.top), *(f"coalesce(g{n}.dup, 0) > {x}" for n, x in _REP.dup)]
_NAMES = ["lines", "paragraphs", "line_chars", "paragraph_chars", *(f"top_{n}" for n, _ in _REP.top), *(f"dup_{n}" for n, _ in _REP.dup)]


@query(f"""WITH {", ".join(_RATIOS)}
SELECT d.doc_id, concat_ws(',', {", ".join(f"CASE WHEN {x} THEN '{n}' END" for x, n in zip(_TESTS, _NAMES))}) AS repetition
FROM documents d JOIN r0 USING (doc_id) JOIN r1 USING (doc_id) {" ".join(f"LEFT JOIN g{n} USING (doc_id)" for n in range(2, 11))}""")
def repetition_reasons(spark, d):
    return curate.repetition_reasons(read(spark, d, "documents")).select("doc_id", "repetition")


@query(f"""WITH {", ".join(_RATIOS)}
SELECT d.doc_id FROM documents d JOIN r0 USING (doc_id) JOIN r1 USING (doc_id) {" ".join(f"LEFT JOIN g{n} USING (doc_id)" for n in range(2, 11))} WHERE NOT ({" OR ".join(_TESTS)})""")
def repetition_filter(spark, d):
    return curate.repetition_filter(read(spark, d, "documents")).select("doc_id")


_SPAM = curate.Spam(adult={"en": ["xxx", "porn"], "de": ["escort"]}, seo={"en": ["cheap", "discount", "click"]}, domains=curate.BLOCKED_DOMAINS, keep=0.25)
_PAGE_LANG = "CASE WHEN page_id % 3 = 0 THEN 'de' ELSE 'en' END"


def _hits(terms: list[str]) -> str:
    return f"len(regexp_extract_all(lower(html), '{curate.term_pattern(terms)}')) >= 1"


_HOST = "string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.')"
_FLAGGED = f"""SELECT page_id, concat_ws(',', CASE WHEN len(list_filter(range(1, len(p)), lambda i: array_to_string(p[i:], '.') IN ({_list(curate.BLOCKED_DOMAINS)}))) > 0 THEN 'spam_url' END,
CASE WHEN CASE WHEN {_PAGE_LANG} = 'de' THEN {_hits(["escort"])} ELSE {_hits(["xxx", "porn"])} END THEN 'adult_lexicon' END, CASE WHEN {_hits(["cheap", "discount", "click"])} THEN 'spam_lexicon' END,
CASE WHEN page_id % 10 = 0 THEN 'spam_model' END) AS spam_reason FROM (SELECT *, {_HOST} AS p FROM pages)"""


def _pages(spark, d):
    return read(spark, d, "pages").select("page_id", "url", F.col("html").alias("text"), F.when(F.col("page_id") % 3 == 0, "de").otherwise("en").alias("language"), F.when(F.col("page_id") % 10 == 0, 0.9).otherwise(0.1).alias("model"))


@query(_FLAGGED)
def spam_flag(spark, d):
    """URL, lexicons by language and a model's score, in their order."""
    return curate.spam_reasons(_pages(spark, d), _SPAM, url="url", model="model").select("page_id", "spam_reason")


@query(f"SELECT * FROM ({_FLAGGED}) WHERE spam_reason = '' OR ('0x' || substring(sha256('13:' || page_id), 1, 8))::UINTEGER % 10000 < 2500")
def keep_fraction(spark, d):
    """Flagged pages go, but for a quarter that is drawn by hash."""
    return curate.spam_filter(_pages(spark, d), _SPAM, url="url", model="model", key="page_id").select("page_id", "spam_reason")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY lower(source || n_chars) ORDER BY source, doc_id) = 1")
def exact_dedup_by_content(spark, d):
    """Another content than the text."""
    return curate.exact_dedup(read(spark, d, "documents"), content=F.lower(F.concat("source", "n_chars"))).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source = (SELECT min(source) FROM documents)) QUALIFY row_number() OVER (PARTITION BY text ORDER BY source, doc_id) = 1")
def exact_dedup_by_index(spark, d):
    """Against the index of an earlier run, that of the first source."""
    docs = read(spark, d, "documents")
    first = docs.agg(F.min("source")).first()[0]  # one name
    return curate.exact_dedup(docs, seen=docs.filter(F.col("source") == first).select(curate.text_key(F.col("text")).alias("h"))).select("doc_id")


_KINDS = f"""{_LEAK}c AS (SELECT doc_id, lang, source, n, {_LANG_COUNTS} FROM w), g AS (SELECT *, {_foreign_sql()} AS tag FROM c),
p AS (SELECT doc_id, source, sum(n)::BIGINT AS chars, coalesce(sum(n) FILTER (tag <> lang), 0)::BIGINT AS foreign_chars, count(*) FILTER (tag = lang) AS own FROM g GROUP BY doc_id, source),
k AS (SELECT source, CASE WHEN foreign_chars = 0 THEN 'pure' WHEN own = 0 THEN 'whole_foreign' ELSE 'embedded' END AS kind, count(*) AS n FROM p GROUP BY ALL)"""


@query(f"""{_KINDS} SELECT source AS dataset, n_embedded, n, rate FROM (SELECT source, coalesce(sum(n) FILTER (kind = 'embedded'), 0)::BIGINT AS n_embedded, sum(n)::BIGINT AS n,
round(coalesce(sum(n) FILTER (kind = 'embedded'), 0) / sum(n), 6) AS rate FROM k GROUP BY source) WHERE n >= 50 ORDER BY rate DESC, source LIMIT 12""")
def top_leakage_rates(spark, d):
    return reports.top_rates(curate.leakage(read(spark, d, "documents")))


_PARTS = f"""WITH l AS (SELECT doc_id, lang, unnest(({LINES})[1:40]) AS p FROM documents), w AS (SELECT doc_id, lang, length(p) AS n, p, regexp_extract_all(lower(p), '[\\p{{L}}\\p{{N}}_]+') AS w FROM l WHERE length(p) >= 20),
c AS (SELECT lang, n, p, w, {_LANG_COUNTS} FROM w), g AS (SELECT *, {_foreign_sql()} AS tag FROM c)"""


@query(f"{_PARTS} SELECT tag AS language, count(*) AS n, sum(n)::BIGINT AS chars FROM g WHERE tag <> lang GROUP BY tag ORDER BY chars DESC, language LIMIT 10")
def leakage_languages(spark, d):
    return curate.leakage_languages(curate.leakage_parts(read(spark, d, "documents"), least_chars=20))


@query(f"{_PARTS} SELECT token, CASE WHEN tag <> lang THEN 'foreign' ELSE 'own' END AS place, count(*) AS n FROM (SELECT tag, lang, unnest(list_filter(w, lambda x: x IN ('the', 'of', 'und', 'les'))) AS token FROM g WHERE tag IS NOT NULL) GROUP BY ALL")
def leakage_tokens(spark, d):
    return curate.leakage_tokens(curate.leakage_parts(read(spark, d, "documents"), least_chars=20), ["the", "of", "und", "les"])


@query("SELECT doc_id, source, before::BIGINT AS before FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR), doc_id) - 1 AS before FROM documents) WHERE before < CASE WHEN source = (SELECT min(source) FROM documents) THEN 1 ELSE 7 END AND source <> (SELECT max(source) FROM documents)")
def sample_by_documents(spark, d):
    """A quota of documents for each source, one at least; one source has none."""
    docs = read(spark, d, "documents")
    names = sorted(r[0] for r in docs.select("source").distinct().collect())  # a row a source
    own = dict.fromkeys(names, 7) | {names[0]: 0}
    del own[names[-1]]
    return stats.source_quota(docs, own, of="docs").select("doc_id", "source", "before")


# Reports


_STAGES = f"""WITH {FEATURES}, u AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY text ORDER BY source, doc_id) = 1),
a AS (SELECT source, count(*) AS n FROM documents GROUP BY source), b AS (SELECT source, count(*) AS n FROM kept GROUP BY source), c AS (SELECT source, count(*) AS n FROM u GROUP BY source),
r AS (SELECT 0 AS step, 'quality' AS stage, source AS dataset, a.n AS records_in, coalesce(b.n, 0)::BIGINT AS records_out FROM a LEFT JOIN b USING (source)
UNION ALL SELECT 1, 'exact_dedup', source, b.n, coalesce(c.n, 0) FROM b LEFT JOIN c USING (source))"""


def _runs(spark, d):
    docs = read(spark, d, "documents")
    good = storage.settled(curate.quality_filter(docs), "good")
    return reports.io_counts(docs, good, "quality", 0).unionByName(reports.io_counts(good, curate.exact_dedup(good), "exact_dedup", 1))


@query(f"{_STAGES} SELECT * FROM r")
def stage_io_counts(spark, d):
    return _runs(spark, d)


@query(f"""{_STAGES} SELECT s.step, s.stage, sum(records_in)::BIGINT AS records_in, sum(records_out)::BIGINT AS records_out, round((sum(records_in) - sum(records_out)) / sum(records_in), 6) AS drop_rate
FROM (VALUES (0, 'quality'), (1, 'exact_dedup'), (2, 'stats')) s(step, stage) LEFT JOIN r ON r.stage = s.stage GROUP BY s.step, s.stage""")
def survival_funnel(spark, d):
    return reports.funnel(_runs(spark, d), ["quality", "exact_dedup", "stats"])


@query(f"WITH c AS (SELECT source, sum(len({CONTENT}))::BIGINT AS n FROM documents GROUP BY source) SELECT source AS dataset, n AS words, round(n / sum(n) OVER (), 6) AS share FROM c")
def mixture_shares(spark, d):
    return reports.mixture_shares(stats.corpus_stats(read(spark, d, "documents"), "source"))


@query("""WITH r AS (SELECT lang AS task, source AS dataset, doc_id % 2 AS role, [source, lang, 'x'] AS keys FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id DESC) = 1),
p AS (SELECT DISTINCT lang AS name FROM documents WHERE n_chars % 5 = 0 UNION SELECT DISTINCT source FROM documents WHERE doc_id < 50)
SELECT task, dataset, role::VARCHAR AS role, array_to_string(list_sort(list(name)), ', ') AS shared_sources FROM (SELECT DISTINCT task, dataset, role, unnest(keys) AS name FROM r) JOIN p USING (name) GROUP BY ALL""")
def contamination_risk(spark, d):
    """Documents as runs of tasks, of which the latest of a language and source counts."""
    docs = read(spark, d, "documents")
    runs = docs.select(F.col("lang").alias("task"), F.col("source").alias("dataset"), (F.col("doc_id") % 2).cast("string").alias("role"), F.array("source", "lang", F.lit("x")).alias("source_keys"), F.col("doc_id").alias("started"))
    names = docs.filter("n_chars % 5 = 0").select(F.col("lang").alias("name")).union(docs.filter("doc_id < 50").select("source"))
    return reports.contamination_risk(runs, names)


_POINTS = "v AS (SELECT lang, source AS run, round(sum(n_chars) / sum(doc_id + 1), 6) AS value FROM documents GROUP BY lang, source)"


def _points(spark, d):
    units = read(spark, d, "documents").select("lang", F.col("source").alias("run"), F.col("n_chars").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return reports.point_estimate(units, ["lang", "run"], lambda s: s["a"] / s["b"], ["a", "b"])


@query(f"WITH {_POINTS} SELECT * FROM v")
def point_estimate(spark, d):
    return _points(spark, d)


@query(f"WITH {_POINTS} SELECT *, row_number() OVER (PARTITION BY lang ORDER BY value DESC, run)::INT AS rank FROM v")
def metric_ranking(spark, d):
    return reports.ranking(_points(spark, d), ["lang"])


@query("""WITH v AS (SELECT event_type AS run, user_id AS resample, avg(value) AS value FROM events GROUP BY ALL),
x AS (SELECT a.run AS a, b.run AS b, a.value - b.value AS v FROM v a JOIN v b ON a.resample = b.resample AND a.run < b.run),
q AS (SELECT a, b, round(median(v), 6) AS median, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round(least(1.0, 2 * least(avg((v <= 0)::INT), avg((v >= 0)::INT))), 6) AS p FROM x GROUP BY a, b),
s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, a || ':' || b) + 1) * p AS s FROM q),
h AS (SELECT * EXCLUDE (s), round(least(max(s) OVER (ORDER BY p, a || ':' || b ROWS UNBOUNDED PRECEDING), 1.0::DOUBLE), 6) AS p_holm FROM s)
SELECT *, p_holm < 0.05 AS significant FROM h""")
def pairwise_significance(spark, d):
    """Event types as runs, users as resamples."""
    values = read(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("resample")).agg(F.avg("value").alias("value"))
    return reports.pair_block(values)


# Lexicons and pieces


@query(f"WITH {_WORDS} SELECT form AS word, array_to_string(CASE WHEN length(form) % 2 = 0 THEN morphemes ELSE [form] END, '+') AS morphemes FROM m")
def morpheme_lookup(spark, d):
    rows = _segmented(spark, d)
    found = morphology.lookup(rows.select(F.col("form").alias("word")), rows.filter(F.length("form") % 2 == 0).select("form", "morphemes"))
    return found.select("word", F.array_join("morphemes", "+").alias("morphemes"))


@query(f"WITH {_WORDS} SELECT form, array_to_string(CASE WHEN len(morphemes) > 1 AND length(form) % 2 = 0 THEN morphemes ELSE pieces END, '+') AS pieces FROM m")
def encode_by_table(spark, d):
    rows = _segmented(spark, d)
    found = segment.encode_by_table(rows.select(F.col("form").alias("word"), F.col("pieces").alias("rest")), rows.filter(F.length("form") % 2 == 0).select("form", "morphemes"))
    return found.select(F.col("word").alias("form"), F.array_join("pieces", "+").alias("pieces"))


@query(f"WITH {_WORDS} SELECT form || 'a' AS form, CASE WHEN length(form) > 1 THEN form || '+a' ELSE form || 'a' END AS morphemes, CASE WHEN length(form) > 1 THEN 'stem+suffix' ELSE 'whole' END AS labels FROM f")
def derive_segmentation(spark, d):
    """Each word with an ending that its lemma lacks."""
    entries = _segmented(spark, d).select(F.col("form").alias("lemma"), F.array(F.struct(F.concat("form", F.lit("a")).alias("form"), F.lit("Ncfsn").alias("msd"))).alias("forms"))
    return segment.derive(entries).select("form", F.array_join("morphemes", "+").alias("morphemes"), F.array_join("labels", "+").alias("labels"))


@query(f"WITH {_WORDS} SELECT form || 'a' AS form FROM f WHERE length(form) > 1")
def reliable_segmentation(spark, d):
    entries = _segmented(spark, d).select(F.col("form").alias("lemma"), F.array(F.struct(F.concat("form", F.lit("a")).alias("form"), F.lit(None).cast("string").alias("msd"))).alias("forms"))
    return segment.reliable(segment.derive(entries)).select("form")


@query(f"WITH {_WORDS} SELECT form FROM (SELECT form FROM f ORDER BY sha256('7:' || form), form LIMIT 300)")
def form_sample(spark, d):
    return segment.form_sample(_segmented(spark, d), 300, 7).select("form")


@query(f"WITH {_WORDS} SELECT unnest(morphemes) AS morpheme, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, morpheme LIMIT 100")
def morpheme_budget(spark, d):
    return segment.morpheme_budget(_segmented(spark, d), 100)


@query("SELECT text AS form FROM (SELECT DISTINCT text, source FROM documents WHERE text <> '') GROUP BY text HAVING count(*) = (SELECT count(DISTINCT source) FROM documents) OR count(*) >= 2")
def valid_forms(spark, d):
    """Texts that two sources have."""
    docs = read(spark, d, "documents").filter("text <> ''").select(F.col("source").alias("run"), F.col("text").alias("form")).distinct()
    two = docs.join(docs.groupBy("form").agg(F.min("run").alias("lo"), F.max("run").alias("hi")), "form").filter((F.col("run") == F.col("lo")) | (F.col("run") == F.col("hi")))
    return segment.valid_in_all(two.select("run", "form", F.lit(True).alias("valid")), 2)


@query(rf"WITH x AS (SELECT item_id, {FLAT} AS text FROM benchmark), w AS (SELECT item_id, text, string_split(text, ' ') AS w FROM x) SELECT item_id, list_transform(range(1, len(w) + 1), lambda i: length(array_to_string(w[1:i], ' ')) - length(w[i]))::VARCHAR AS begins FROM w")
def encode_offsets(spark, d):
    """Where the words of an item begin, marked as a tokenizer marks them."""
    rows = read(spark, d, "benchmark").select("item_id", t.flatten_spaces(F.col("text")).alias("text"))
    spans = tokenizers.piece_offsets(F.col("text"), F.transform(F.split("text", " "), lambda w: F.concat(F.lit("Ġ"), w)))
    return rows.select("item_id", F.concat(F.lit("["), F.array_join(F.transform(spans, lambda s: s[0].cast("string")), ", "), F.lit("]")).alias("begins"))


@query(f"SELECT doc_id, coalesce(list_sum(list_transform(w, lambda x: CASE x WHEN 'the' THEN 1 WHEN 'and' THEN 2 ELSE 9 END)), 0)::BIGINT AS ids, len(list_filter(w, lambda x: x IN ('the', 'and')))::BIGINT AS known FROM (SELECT doc_id, {WORDS} AS w FROM documents)")
def encode_ids(spark, d):
    words = t.words(F.lower("text"))
    own = read(spark, d, "documents").select("doc_id", tokenizers.piece_ids(words, {"the": 1, "and": 2}, 9).alias("i"), tokenizers.piece_ids(words, {"the": 1, "and": 2}).alias("k"))
    return own.select("doc_id", F.aggregate("i", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"), F.size("k").cast("long").alias("known"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest(list_transform({SPACED}, lambda x: regexp_replace(regexp_replace(x, '^##', ''), '[Ġ▁]', '', 'g'))) AS word FROM documents) GROUP BY word")
def clean_pieces(spark, d):
    rows = read(spark, d, "documents").select(F.explode(t.spaced(F.col("text"))).alias("w"))
    return rows.select(tokenizers.clean_piece(F.col("w")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query()
def morph_consistency(spark, d):
    """F1 over pairs of words that share a morpheme or a piece; keys of very many words have 200 drawn pairs."""
    return morphology.consistency(_segmented(spark, d))


