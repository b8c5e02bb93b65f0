"""Hand-checked values and properties."""

from pyspark.sql import functions as F

from millrace.functions import text as t
from millrace.operators import curate, stats


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_uniform_types_have_full_efficiency(spark):
    four, single = spark.createDataFrame([(5,)] * 4, "n long"), spark.createDataFrame([(5,)], "n long")
    assert stats.renyi_efficiency(four).first()[0] == 1.0
    assert stats.renyi_efficiency(four, 1).first()[0] == 1.0
    assert stats.renyi_efficiency(single).first()[0] == 0.0


def test_ratios_are_ratios_of_sums(spark):
    units = spark.createDataFrame([(1, 4, 2, 8, 8), (2, 6, 2, 12, 12)], "doc_id long, tokens long, words long, chars long, bytes long")
    assert stats.tokenizer_ratios(units).first()["fertility"] == 2.5


def test_terms_need_word_boundaries_and_share_them(spark):
    docs = spark.createDataFrame([(1, "a casinos"), (2, "xcasino"), (3, "casino casino casino"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["spam_reason"] for r in curate.spam_flag(docs).collect()}
    assert got == {1: "", 2: "", 3: "seo_lexicon", 4: ""}
    assert {r["doc_id"] for r in curate.spam_flag(docs, threshold=2).filter("spam_reason <> ''").collect()} == {3}
    assert not curate.spam_flag(docs, threshold=3).filter("spam_reason <> ''").collect()


def test_first_dataset_survives_exact_dedup(spark):
    docs = spark.createDataFrame([("beta", 1, "same"), ("alpha", 1, "same"), ("alpha", 2, "other"), ("alpha", 3, None), ("beta", 3, None)], "source string, doc_id long, text string")
    once = curate.exact_dedup(docs)
    assert {(r.source, r.doc_id) for r in once.collect()} == {("alpha", 1), ("alpha", 2), ("alpha", 3)}
    assert curate.exact_dedup(once).count() == 3


def test_shared_span_is_kept_once(spark):
    span = "One is here. Two is here. Three is here."
    docs = spark.createDataFrame([("a", 1, f"Start one. {span} End one."), ("b", 2, f"Start two. {span} End two."), ("b", 3, "Short."), ("b", 4, "")], "source string, doc_id long, text string")
    got = {r.doc_id: r.text for r in curate.sentence_dedup(docs).collect()}
    assert got[1].endswith("End one.") and "Two is here." in got[1]
    assert got[2] == "Start two. End two." and got[3] == "Short." and 4 not in got


def test_repeated_sentence_fails_the_repetition_rule(spark):
    docs = spark.createDataFrame([(1, "\n".join(["The same line."] * 8)), (2, "a\nb"), (3, ""), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.dup_fraction for r in curate.line_repetition(docs).collect()}
    assert got == {1: 0.875, 2: 0.0, 3: 0.0, 4: 0.0}


def test_hosts(spark):
    assert one(spark, t.host(F.col("u")), u="https://user@A.b.Example.com:80/x?y") == "a.b.example.com"
    assert one(spark, t.host(F.col("u")), u="not a url") is None
    assert one(spark, t.host_suffixes(F.col("u")), u="a.b.c") == ["a.b.c", "b.c"]


def test_ids_and_coercions(spark):
    assert one(spark, t.uid(F.lit("s"), F.col("u")), u="") is None
    assert one(spark, t.uid(F.lit("s"), F.col("u")), u="7") == "s:7"
    assert [one(spark, t.coerce_bool(F.col("u")), u=x) for x in ("Yes", "0", "0.5", "2", "maybe")] == [True, False, False, True, None]


def test_holm_is_monotone(spark):
    rows = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03])], "fam string, id long, p double")
    got = [r.p_holm for r in stats.holm(rows, "fam").orderBy("p").collect()]
    assert got == [0.03, 0.06, 0.06]


def test_split_is_stable_under_repartitioning(spark):
    ids = spark.range(200).withColumn("b", t.hash_bucket(F.col("id")))
    assert sorted(ids.repartition(7).collect()) == sorted(ids.collect())


def test_entry_runs_and_imports_without_optional_parts(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
