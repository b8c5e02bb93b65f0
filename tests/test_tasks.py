"""Converters, morphology, significance, stages and streaming on small cases."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import curate, morphology, significance, tasks
from millrace.plans import stages
from millrace.streaming.ingest import ingest


def test_nli_and_ids(spark):
    rows = spark.createDataFrame([("7", "p", "h", "yes"), ("a:8", "p", "h", ""), (None, None, "h", "yes"), ("9", "p", "h", "odd")], "idx string, premise string, hypothesis string, label string")
    assert {(r.id, r.label) for r in tasks.nli(rows, "d", ["yes"]).collect()} == {("d:7", "yes"), ("a:8", "")}


def test_choice_and_question_defaults(spark):
    rows = spark.createDataFrame([(1, "p", "a", "b", "", "x"), (2, "p", "a", "b", "effect", "1")], "idx long, premise string, choice1 string, choice2 string, question string, label string")
    assert [(r.question, r.label) for r in tasks.copa(rows, "d").orderBy("id").collect()] == [("cause", 0), ("effect", 1)]
    q = spark.createDataFrame([(1, None, "para", "q?", "yes"), (2, "pass", "para", None, "maybe")], "idx long, passage string, paragraph string, question string, label string")
    assert [(r.passage, r.question, r.label) for r in tasks.boolq(q, "d").orderBy("id").collect()] == [("para", "q?", True), ("pass", "", False)]


def test_multirc_flattens(spark):
    schema = "idx long, passage struct<text:string, questions:array<struct<idx:long, question:string, answers:array<struct<idx:long, text:string, label:string>>>>>"
    rows = spark.createDataFrame([(3, ("P", [(0, "Q", [(0, "A", "1"), (None, "B", None)])])), (4, ("E", []))], schema)
    got = sorted((r.id, r.question, r.label) for r in tasks.multirc(rows, "d").collect())
    assert got == [("d:3-q0-a0", "Q\nA", True), ("d:3-q0-a1", "Q\nB", False)]


def test_spans_and_sentiment(spark):
    rows = spark.createDataFrame([("1", "t", [(0, 1, "PER"), (2, 3, "LOC")]), ("2", "t", []), ("3", "t", None)], "id string, text string, spans array<struct<start:int,end:int,label:string>>")
    assert {r.id: len(r.spans) for r in tasks.spans(rows, "d", ["PER"]).collect()} == {"d:1": 1, "d:2": 0}
    rows = spark.createDataFrame([("1", "t", None, {"sentiment": "NEU"}), ("2", "t", "Pos ", {}), ("3", "t", "odd", None)], "id string, text string, label string, metadata map<string,string>")
    assert {(r.id, r.label) for r in tasks.sentiment(rows, "d").collect()} == {("d:1", "neutral"), ("d:2", "positive")}


def test_splits_keep_every_row(spark):
    ids = spark.range(500)
    held = tasks.assign_splits(ids, held_out=True)
    assert held.count() == 500 and {r.split for r in held.select("split").distinct().collect()} == {"validation", "test"}
    assert {r.split for r in tasks.assign_splits(ids, ["train"]).select("split").distinct().collect()} == {"train"}
    with pytest.raises(ValueError):
        tasks.assign_splits(ids, ["train"], held_out=True)


def lexicon(spark, *rows):
    return spark.createDataFrame(list(rows), "form string, morphemes array<string>")


def test_morphology(spark):
    rows = spark.createDataFrame([("abcd", ["ab", "cd"], ["ab", "c", "d"]), ("xy", ["xy"], ["x", "y"]), ("bad", ["b", "ad"], ["b", "?"]), ("null", ["null"], None)], "form string, morphemes array<string>, pieces array<string>")
    got = {r.form: (r.valid, r.tp, r.predicted, r.gold) for r in morphology.form_stats(rows).collect()}
    assert got == {"abcd": (True, 1, 2, 1), "xy": (True, 0, 1, 0), "bad": (False, 0, 0, 0), "null": (False, 0, 0, 0)}
    score = morphology.morph_score(morphology.form_stats(rows)).first()
    assert (score.precision, score.recall, score.f1, score.coverage) == (0.333333, 1.0, 0.5, 0.5)
    assert {r.form: r.edit for r in morphology.segment_distance(rows).collect()} == {"abcd": 2, "xy": 2, "bad": 1, "null": 1}
    merged = morphology.merge_lexicons([lexicon(spark, ("a", ["a"]), ("bc", ["b", "c"])), lexicon(spark, ("bc", ["bc"]), ("de", ["d", "e"]))])
    assert {r.form: r.morphemes for r in merged.collect()} == {"a": ["a"], "bc": ["b", "c"], "de": ["d", "e"]}
    same = spark.createDataFrame([(f"{p}{i}", [p, str(i)], [p, str(i)]) for p in "ab" for i in range(4)], "form string, morphemes array<string>, pieces array<string>")
    assert morphology.consistency(same).first().f1 == 1.0
    assert morphology.consistency(same.limit(0)).first().f1 == 0.0


def test_hot_key_makes_few_pairs(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("form"), F.array(F.lit("k")).alias("m"))
    assert morphology.grouped_pairs(rows, "m", 50).count() == 50


def test_small_keys_give_all_pairs_and_large_ones_200(spark):
    forms = [(f"{k}{i:03}", [k], [k, str(i % 2)]) for k, n in (("a", 20), ("b", 25), ("c", 300)) for i in range(n)]
    rows = spark.createDataFrame(forms, "form string, morphemes array<string>, pieces array<string>")
    got = [tuple(r) for r in morphology.grouped_pairs(rows, "morphemes").collect()]
    assert len(got) == len(set(got)) == 590 and all(a < b for _, a, b in got)
    assert {(a, b) for k, a, b in got if k == "a"} == {(f"a{i:03}", f"a{j:03}") for j in range(20) for i in range(j)}
    assert len({x for k, *p in got if k == "c" for x in p}) > 150
    few = spark.createDataFrame([("x1", ["m"], ["p"]), ("x2", ["m"], ["p"]), ("x3", ["m"], ["q"])], rows.schema)
    assert morphology.consistency(few).first().recall == pytest.approx(1 / 3)


def test_letters_and_p():
    T, N = True, False
    assert significance.compact_letters([[T, T, N], [T, T, T], [N, T, T]]) == ["a", "ab", "b"]
    assert significance.compact_letters([[T, N], [N, T]]) == ["a", "b"] and significance.compact_letters([]) == []


def test_bootstrap_pairs_runs(spark):
    units = spark.createDataFrame([(run, i, float(i % 7 + add), 2.0) for run, add in (("a", 0), ("b", 0), ("c", 3)) for i in range(300)], "run string, unit long, x double, y double")
    values = significance.bootstrap_ratios(units, "x", "y", 200, 7)
    assert sorted(map(tuple, values.collect())) == sorted(map(tuple, significance.bootstrap_ratios(units.repartition(5), "x", "y", 200, 7).collect()))
    p = {(r.a, r.b): r.p for r in significance.two_sided_p(significance.run_differences(values), ["a", "b"]).collect()}
    assert p == {("a", "b"): 1.0, ("a", "c"): 0.0, ("b", "c"): 0.0}
    ci = {r.run: r for r in significance.percentile_interval(values, ["run"]).collect()}
    assert ci["a"].low < 1.5 < ci["a"].high and ci["a"].high - ci["a"].low < 0.3
    assert significance.bootstrap_ratios(units.limit(0), "x", "y", 10).count() == 0


def test_stages_run_only_what_changed(spark, tmp_path):
    ran = []

    def keep(name):
        def run(df, config):
            ran.append(name)
            return df.filter(F.col("n") >= config["least"])

        return run

    docs = spark.createDataFrame([("a", 1), ("a", 5), ("b", 9)], "source string, n long")
    graph = [stages.Stage("one", keep("one"), {"least": 0}), stages.Stage("two", keep("two"), {"least": 3})]
    go = lambda config=None, **k: stages.run_stages(spark, docs, graph, str(tmp_path), config, **k).count()
    assert go() == 2 and go() == 2 and ran == ["one", "two"]
    assert go({"two": {"least": 6}}) == 1 and ran == ["one", "two", "two"]
    assert go({"two": {"least": 6}}, force=["one"]) == 1 and ran[3:] == ["one", "two"]
    assert {(r.stage, r.dataset): r.drop_rate for r in stages.funnel(spark, str(tmp_path)).collect()} == {("one", "a"): 0.0, ("one", "b"): 0.0, ("two", "a"): 1.0, ("two", "b"): 0.0}
    own = {(r.source, r.least) for r in stages.with_settings(docs, graph[1], {"a": {"two": {"least": 7}}}).collect()}
    assert own == {("a", 7), ("b", 3)}
    with pytest.raises(ValueError):
        stages.check_overrides(graph, {"a": {"two": {"odd": 1}}}, ["a"])
    stages.check_overrides(graph, {"a": {"two": {"least": 1}}}, ["a"])
    assert stages.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"c": 3}}) == {"a": {"b": 1, "c": 3}} and stages.flatten({"a": {"b": 1}}) == {"a.b": "1"}


def test_ingest_adds_only_new_texts(spark, tmp_path):
    go = lambda: ingest(spark, f"{tmp_path}/in", "doc_id long, text string", f"{tmp_path}/out", f"{tmp_path}/state")
    put = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(f"{tmp_path}/in")
    put([(1, "x"), (2, "x"), (3, None)])
    go()
    put([(4, "x"), (5, "y")])
    go()
    go()
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1, 3, 5}


def test_leakage_kinds(spark):
    en, de = "the cat and the dog of that is in it", "der hund und die katze ist nicht das"
    docs = spark.createDataFrame([(1, en, "en", "s"), (2, f"{en}\n{de}", "en", "s"), (3, de, "en", "s"), (4, "", "en", "s"), (5, None, "en", "s")], "doc_id long, text string, lang string, source string")
    got = {r.kind: (r.n, r.chars, r.foreign_chars) for r in curate.leakage(docs).collect()}
    assert got == {"pure": (1, len(en), 0), "embedded": (1, len(en) + len(de), len(de)), "whole_foreign": (1, len(de), len(de))}
