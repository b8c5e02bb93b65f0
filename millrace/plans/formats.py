"""Queries of readers, writers, converters, morphology and significance, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as t
from millrace.operators import curate, morphology, significance, tasks, tokenizers
from millrace.plans import corpus
from millrace.plans.corpus import _BUCKET, FEATURES, query, read
from millrace.plans.stages import Stage, with_settings
from millrace.sources import markup, records, storage
from millrace.streaming.ingest import ingest

STRIP = r"regexp_replace({}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"
SENTENCES = r"list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: trim(x, ' ')), lambda x: x <> '')"


@query("SELECT 'documents:' || doc_id AS uid, text, lang, source FROM documents WHERE trim(text) <> ''")
def jsonl_round_trip(spark, d):
    """documents written as gzip JSONL shards and read back."""
    at = storage.shared_folder(spark, "jsonl")
    storage.write_shards(read(spark, d, "documents").select("doc_id", "text", "lang", F.col("source").alias("src")), at)
    docs = records.read_jsonl(spark, at, "documents", keep=["lang", "src"], pattern="*.json.gz")
    return docs.select("uid", "text", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["src"].alias("source"))


@query("SELECT source AS dataset, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def routed_shards(spark, d):
    """documents written to a folder for each source, read back by folder."""
    at = storage.shared_folder(spark, "routed")
    storage.write_shards(read(spark, d, "documents"), at, by="source")
    return spark.read.schema("doc_id long, text string, source string").json(at).groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(rf"""WITH b AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '(?:\r?\n){{2,}}'), lambda x: {STRIP.format("x")}), lambda x: x <> '') AS b FROM documents)
SELECT doc_id, i - 1 AS idx, b[i] AS block FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS i FROM b)""")
def text_blocks(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.posexplode(records.text_blocks(F.col("text"))).alias("idx", "block"))
    return docs.select("doc_id", F.col("idx").cast("long").alias("idx"), "block")


@query(rf"""WITH s AS (SELECT doc_id, {SENTENCES} AS s FROM documents)
SELECT 'd' || doc_id AS doc_id, len(s)::BIGINT AS n_sentences, list_sum(list_transform(s, lambda x: len(regexp_extract_all(x, '[^ \t\r\n]+'))))::BIGINT AS n_tokens, array_to_string(s, chr(10)) AS text FROM s WHERE len(s) > 0
AND list_sum(list_transform(s, lambda x: len(regexp_extract_all(x, '[^ \t\r\n]+')))) > 0""")
def conllu_round_trip(spark, d):
    """Each document's sentences rendered as CoNLL-U blocks, one file a document, and parsed."""
    row = lambda w: F.concat(F.lit("1\t"), w, F.lit("\t_\t_\t_\t_\t_\t_\t_\t_"))
    block = lambda x, i: F.concat(F.lit("# sent_id = d"), F.col("doc_id"), F.lit("."), i, F.lit("\n# text = "), x, F.lit("\n"), F.array_join(F.transform(t.spaced(x), row), "\n"))
    files = read(spark, d, "documents").select(F.concat(F.lit("f"), "doc_id").alias("name"), F.array_join(F.transform(t.sentences(F.col("text")), block), "\n\n").alias("content"))
    docs = records.conllu_documents(files, "documents")
    return docs.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.size("tokens").cast("long").alias("n_tokens"), "text")


@query(r"SELECT 'i' || item_id AS doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ') AS text FROM benchmark")
def tei_paragraphs(spark, d):
    """Each benchmark item as a TEI file of one paragraph, parsed."""
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><p xml:id="i'), "item_id", F.lit('">'), safe, F.lit("</p></body></text></TEI>"))
    files = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.encode(body, "utf-8").alias("content"))
    return markup.parse(files, markup.tei, "benchmark").select("doc_id", "text")


@query("SELECT DISTINCT text FROM documents")
def streamed_ingest(spark, d):
    """documents through the streaming ingest: new texts once each."""
    at = storage.shared_folder(spark, "ingest")
    docs = read(spark, d, "documents")
    docs.select("doc_id", "text").write.parquet(f"{at}/in")
    ingest(spark, f"{at}/in", "doc_id long, text string", f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").select("text")


@query("SELECT 'documents:' || doc_id AS id, text, CASE quality WHEN 1 THEN 'positive' ELSE 'negative' END AS label FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def convert_sentiment(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").filter("quality is not null")
    rows = rows.select("doc_id", "text", F.when(F.col("quality") == 1, " POS").otherwise("neg").alias("label"))
    return tasks.sentiment(rows, "documents")


@query("SELECT 'documents:' || doc_id AS id, text AS passage, source AS question, coalesce(toxic, 0) = 1 AS label FROM documents LEFT JOIN labels USING (doc_id)")
def convert_boolq(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return tasks.boolq(rows.select("doc_id", F.lit("").alias("passage"), F.col("text").alias("paragraph"), F.col("source").alias("question"), F.col("toxic").alias("label")), "documents")


@query("WITH c AS (SELECT conv_id, text AS premise, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS hypothesis, role AS label, turn FROM conversations) SELECT 'conversations:' || conv_id || '-' || turn AS id, premise, hypothesis, label FROM c WHERE hypothesis IS NOT NULL AND label = 'user'")
def convert_nli(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("premise"), F.lead("text").over(w).alias("hypothesis"), F.col("role").alias("label"))
    return tasks.nli(rows, "conversations", ["user"])


@query(rf"""WITH m AS (SELECT doc_id, text, regexp_extract(text, '[A-Za-z]+', 0) AS w FROM documents) SELECT 'documents:' || doc_id AS id, len(regexp_extract_all(text, '[^ \t\r\n]+'))::INT AS span_end, w AS word FROM m""")
def convert_wsc(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "text", F.struct(F.col("text").alias("span1_text"), F.lit(0).alias("span1_index"), F.regexp_extract("text", "[A-Za-z]+", 0).alias("span2_text"), F.lit(0).alias("span2_index")).alias("target"))
    return tasks.wsc(rows, "documents").select("id", F.col("span1.end").alias("span_end"), F.col("span2.text").alias("word"))


@query(f"SELECT split, count(*) AS n FROM (SELECT CASE WHEN b < 50 THEN 'validation' ELSE 'test' END AS split FROM (SELECT {_BUCKET} AS b FROM documents)) GROUP BY split")
def held_out_splits(spark, d):
    rows = tasks.assign_splits(read(spark, d, "documents"), held_out=True, key="doc_id", bucket=t.hash_bucket)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT source, lang, grouping(source) AS gs, grouping(lang) AS gl, count(*) AS doc_count, sum(length(text))::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((source), (lang), ()))
SELECT CASE WHEN gs = 0 THEN 'dataset' WHEN gl = 0 THEN 'domain' ELSE 'all' END AS level, coalesce(source, lang, '') AS name, doc_count, chars FROM g""")
def stats_all_levels(spark, d):
    """Totals by dataset, by domain and in all from one scan."""
    docs = read(spark, d, "documents").select("source", "lang", F.length("text").alias("c"))
    g = docs.groupingSets([["source"], ["lang"], []], "source", "lang").agg(F.grouping("source").alias("gs"), F.grouping("lang").alias("gl"), F.count(F.lit(1)).alias("doc_count"), F.sum("c").alias("chars"))
    level = F.when(F.col("gs") == 0, "dataset").when(F.col("gl") == 0, "domain").otherwise("all")
    return g.select(level.alias("level"), F.coalesce("source", "lang", F.lit("")).alias("name"), "doc_count", "chars")


_FIRST = "(SELECT min(source) FROM documents)"


@query(f"WITH {FEATURES.split('kept AS')[0].rstrip().rstrip(',')} SELECT doc_id FROM q WHERE n_words >= CASE WHEN source = {_FIRST} THEN 200 ELSE 50 END")
def quality_overrides(spark, d):
    """A setting that differs by dataset, as a column."""
    docs = read(spark, d, "documents")
    first = docs.agg(F.min("source")).first()[0]  # one name
    stage = Stage("quality", lambda df, c: df, {"min_words": 50.0})
    own = with_settings(curate.quality_features(docs), stage, {first: {"quality": {"min_words": 200}}})
    return own.filter(F.col("n_words") >= F.col("min_words")).select("doc_id")


_LEAK = r"""WITH l AS (SELECT doc_id, lang, source, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')) AS p FROM documents),
w AS (SELECT doc_id, lang, source, length(p) AS n, regexp_extract_all(lower(p), '[\p{L}\p{N}_]+') AS w FROM l),
"""
_LANG_COUNTS = ", ".join(f"len(list_filter(w, lambda x: x IN ({corpus._list(curate.STOP_WORDS[k])}))) AS c_{k}" for k in sorted(curate.STOP_WORDS))
_ALL = " + ".join(f"c_{k}" for k in sorted(curate.STOP_WORDS))


def _foreign_sql() -> str:
    names = sorted(curate.STOP_WORDS)
    tests = []
    for k in names:
        rest = "greatest(" + ", ".join(f"c_{j}" for j in names if j != k) + ")"
        tests.append(f"WHEN c_{k} > 0 AND c_{k} >= {rest} AND (c_{k} - {rest}) / ({_ALL}) >= 0.1 THEN '{k}'")
    return "CASE " + " ".join(tests) + " END"


@query(f"""{_LEAK}c AS (SELECT doc_id, lang, source, n, {_LANG_COUNTS} FROM w), g AS (SELECT *, {_foreign_sql()} AS tag FROM c),
p AS (SELECT doc_id, source, sum(n)::BIGINT AS chars, coalesce(sum(n) FILTER (tag <> lang), 0)::BIGINT AS foreign_chars, count(*) FILTER (tag = lang) AS own FROM g GROUP BY doc_id, source)
SELECT source, CASE WHEN foreign_chars = 0 THEN 'pure' WHEN own = 0 THEN 'whole_foreign' ELSE 'embedded' END AS kind, count(*) AS n, sum(chars)::BIGINT AS chars, sum(foreign_chars)::BIGINT AS foreign_chars FROM p GROUP BY ALL""")
def leakage_report(spark, d):
    return curate.leakage(read(spark, d, "documents"))


_WORDS = r"""f AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS form FROM documents),
m AS (SELECT form, CASE WHEN length(form) > 3 THEN [substring(form, 1, 3), substring(form, 4)] ELSE [form] END AS morphemes,
  CASE WHEN length(form) < 3 THEN [form] WHEN length(form) % 2 = 0 AND length(form) > 3 THEN [substring(form, 1, 3), substring(form, 4)] ELSE [substring(form, 1, 2), substring(form, 3)] END AS pieces FROM f),
s AS (SELECT form, (len(morphemes) = 2 AND length(pieces[1]) = 3)::INT AS tp, len(pieces) - 1 AS predicted, len(morphemes) - 1 AS gold FROM m)"""


def _segmented(spark, d):
    """The distinct lower-case words of documents, cut after the third letter, and by a rule that is at times another."""
    form = read(spark, d, "documents").select(F.explode(t.find_all(F.col("text"), "[a-z]+")).alias("form")).distinct()
    n, cut = F.length("form"), lambda k: F.array(F.substring("form", 1, k), F.expr(f"substring(form, {k + 1})"))
    pieces = F.when(n < 3, F.array("form")).when((n % 2 == 0) & (n > 3), cut(3)).otherwise(cut(2))
    return form.select("form", F.when(n > 3, cut(3)).otherwise(F.array("form")).alias("morphemes"), pieces.alias("pieces"))


@query(f"WITH {_WORDS} SELECT form, true AS valid, tp::BIGINT AS tp, predicted::BIGINT AS predicted, gold::BIGINT AS gold FROM s")
def morph_form_stats(spark, d):
    return morphology.form_stats(_segmented(spark, d))


@query(f"WITH {_WORDS} SELECT round(sum(tp) / sum(predicted), 6) AS precision, round(sum(tp) / sum(gold), 6) AS recall, round(2 * sum(tp) / (sum(predicted) + sum(gold)), 6) AS f1, 1.0::DOUBLE AS coverage FROM s")
def morph_score(spark, d):
    return morphology.morph_score(morphology.form_stats(_segmented(spark, d)))


@query(f"""WITH {_WORDS} SELECT morpheme, count(*) AS n, count(*) FILTER (i = 1) AS n_initial, count(*) FILTER (i = k) AS n_final
FROM (SELECT unnest(morphemes) AS morpheme, unnest(range(1, len(morphemes) + 1)) AS i, len(morphemes) AS k FROM m) GROUP BY morpheme""")
def morph_inventory(spark, d):
    return morphology.inventory(_segmented(spark, d))


@query(f"""WITH {_WORDS}, k AS (SELECT DISTINCT form, unnest(morphemes) AS key FROM m)
SELECT key, least(count(*) * (count(*) - 1) // 2, 200)::BIGINT AS n FROM k GROUP BY key HAVING count(*) > 1""")
def consistency_pairs(spark, d):
    """How many pairs each key has: all, or 200 drawn ones (by a hash that SQL doesn't have)."""
    pairs = morphology.grouped_pairs(_segmented(spark, d), "morphemes")
    return pairs.filter("a < b").groupBy("key").agg(F.count_distinct("a", "b").alias("n"))


@query(f"""WITH {_WORDS} SELECT form, CASE WHEN len(morphemes) = 1 AND len(pieces) = 1 THEN 0 WHEN len(morphemes) = 1 OR len(pieces) = 1 THEN 2
  WHEN morphemes[1] = pieces[1] THEN 0 ELSE 2 END::BIGINT AS edit FROM m""")
def morph_edit_distance(spark, d):
    return morphology.segment_distance(_segmented(spark, d)).select("form", "edit")


@query(f"WITH {_WORDS} SELECT form, array_to_string(CASE WHEN len(pieces) > len(morphemes) THEN pieces ELSE morphemes END, '+') AS morphemes FROM m")
def lexicon_merge(spark, d):
    rows = _segmented(spark, d)
    merged = morphology.merge_lexicons([rows, rows.select("form", F.col("pieces").alias("morphemes"))])
    return merged.select("form", F.array_join("morphemes", "+").alias("morphemes"))


@query("SELECT event_type, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY event_type")
def percentile_ci(spark, d):
    return significance.percentile_interval(read(spark, d, "events"), ["event_type"], level=0.95)


@query("SELECT l_returnflag, round(least(1.0, 2 * least(avg((v <= 0)::INT), avg((v >= 0)::INT))), 6) AS p FROM (SELECT l_returnflag, l_quantity - 10 AS v FROM lineitem) GROUP BY l_returnflag")
def bootstrap_p(spark, d):
    return significance.two_sided_p(read(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") - 10).alias("d")), ["l_returnflag"])


@query()
def bootstrap_distribution(spark, d):
    """200 resamples of characters a word for each source; a test holds them against plain loops."""
    units = read(spark, d, "documents").select(F.col("source").alias("run"), F.col("doc_id").alias("unit"), F.length("text").alias("c"), F.size(t.spaced(F.col("text"))).alias("w"))
    return significance.bootstrap_ratios(units, "c", "w", 200)


#: A short list of merges, so that SQL can say the result: letters are merged in this order.
MERGES = [("t", "h"), ("th", "e")]


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS w FROM documents),
n AS (SELECT doc_id, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS chars, list_sum(list_transform(w, lambda x: len(regexp_extract_all(x, 'th'))))::BIGINT AS th,
  list_sum(list_transform(w, lambda x: len(regexp_extract_all(x, 'the'))))::BIGINT AS the FROM w)
SELECT doc_id, coalesce(chars - th - the, 0) AS n_pieces, coalesce(the, 0) AS n_the FROM n""")
def encode_bpe(spark, d):
    own = tokenizers.encode_words(read(spark, d, "documents").select("doc_id", "text"), MERGES)
    return own.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.size(F.filter("pieces", lambda p: p == "the")).cast("long").alias("n_the"))


@query("SELECT doc_id FROM documents WHERE len(regexp_extract_all(coalesce(text, ''), '!')) < 2")
def spam_model(spark, d):
    """Documents that a pluggable model, here one that counts exclamation marks, scores under its threshold."""
    return tokenizers.spam_model(read(spark, d, "documents"), lambda s: s.count("!") / 2, 1.0).select("doc_id")


@query("SELECT event_id, event_type, user_id::VARCHAR AS user_id FROM events")
def project_metadata(spark, d):
    m = F.create_map(F.lit("type"), "event_type", F.lit("user"), F.col("user_id").cast("string"), F.lit("none"), F.lit(None).cast("string"))
    kept = tokenizers.project_metadata(m, leave=["other"])
    return read(spark, d, "events").select("event_id", kept.alias("m")).select("event_id", F.col("m")["type"].alias("event_type"), F.col("m")["user"].alias("user_id"))
