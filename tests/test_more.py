"""Operators that SQL can't express, against plain Python, and what reads from folders."""

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace import registry
from millrace.functions import text as t
from millrace.operators import convert, curate, reports, segment, significance, stats, tasks, tokenizers
from millrace.plans import corpus, stages
from millrace.sources import records, storage


def test_bootstrap_equals_plain_loops(spark):
    rows = [(run, u, float(u + k), 1.0 + u % 3) for k, run in enumerate("ab") for u in range(40)]
    got = {(r.run, r.resample): r.value for r in significance.bootstrap_ratios(spark.createDataFrame(rows, "run string, unit long, n double, d double"), "n", "d", 20, seed=5).collect()}
    keys = {r.unit: r.k for r in spark.range(40).select(F.col("id").alias("unit"), F.xxhash64("id").alias("k")).collect()}
    draws = {u: np.random.Generator(np.random.Philox(key=(5 << 64) | (k & (2**64 - 1)))).poisson(1.0, 20) for u, k in keys.items()}
    for run in "ab":
        for i in range(20):
            a = sum(draws[u][i] * n for r, u, n, _ in rows if r == run)
            b = sum(draws[u][i] * d for r, u, _, d in rows if r == run)
            assert got[run, i] == pytest.approx(a / b)


def test_blake_splits_equal_hashlib(spark):
    rows = tasks.assign_splits(spark.range(300).select(F.concat(F.lit("x:"), "id").alias("id"))).collect()
    bucket = lambda k: int(hashlib.blake2s(k.encode()).hexdigest()[:8], 16) % 100
    assert all(r.split == ("train" if (b := bucket(r.id)) < 70 else "validation" if b < 85 else "test") for r in rows)


def test_dedup_of_identifiers_shared_by_datasets(spark):
    rows = [("a", 1, "Alpha x. Beta x. Gamma x. Rest a."), ("b", 7, "Alpha x. Beta x. Gamma x. Rest b."), ("c", 7, "Alpha z. Beta z. Gamma z. Delta z."), (None, None, "One. Two."), ("c", 8, None), ("c", 7, "Alpha z. Beta z. Gamma z. Delta z.")]
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string")
    got = sorted((r.source or "", r.doc_id or 0, r.text) for r in curate.sentence_dedup(docs, min_sentences=0).collect())
    assert got == [("", 0, "One. Two."), ("a", 1, rows[0][2]), ("b", 7, "Rest b."), ("c", 7, ""), ("c", 7, rows[2][2]), ("c", 8, "")]
    assert sorted((r.source or "", r.doc_id or 0) for r in curate.exact_dedup(docs).collect()) == [("", 0), ("a", 1), ("b", 7), ("c", 7), ("c", 8)]
    plan = curate.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert not curate.exact_dedup(docs.limit(0)).collect() and not curate.sentence_dedup(docs.limit(0)).collect()


def test_repetition(spark):
    docs = spark.createDataFrame([(1, "The same sentence stands here again. " * 8), (2, " ".join(f"w{i}x{i * i}" for i in range(80))), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.repetition for r in curate.repetition_reasons(docs).collect()}
    assert "dup_5" in got[1] and "top_2" in got[1] and got[2] == got[3] == got[4] == ""
    assert sorted(r.doc_id for r in curate.repetition_filter(docs).collect()) == [2, 3, 4]
    assert [(r.doc_id, r.top_chars) for r in curate.ngram_repetition(docs, 80).collect()] == [(2, 1.0)]


@pytest.mark.parametrize("n", [7, 4, 5, 9, 8, 10, 3])
def test_ngrams_go_to_python_once_in_parts(spark, n):
    """Texts of several parts, one longer than a part, none, nulls and repeated ids; each text is counted once, a few at a time."""
    draw = random.Random(n)
    text = lambda words: " ".join(draw.choice(("Ä", "bb", "ccc", "dd_d", "e1")) for _ in range(words))
    rows = [(i // 2, text(draw.randrange(3 * n))) for i in range(1_100)] + [(-1, None), (-2, ""), (-3, text(n - 1)), (-4, text(n)), (-5, text(300_000)), (-6, text(200))]
    own = spark.newSession()
    table = own.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = curate.ngram_repetition(table, n)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "500"
    want = []
    for i, x in rows:
        w = re.findall(r"\w+", (x or "").lower())
        grams = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
        if counts := Counter(grams):
            size = {g: sum(map(len, g)) for g in counts}
            chars = sum(map(len, w))
            want.append((i, max(c * size[g] for g, c in counts.items()) / chars, sum((c - 1) * size[g] for g, c in counts.items()) / chars))
    rows = sorted(map(tuple, got.collect()))
    assert len(rows) == len(want) and np.allclose(rows, sorted(want), rtol=0, atol=1e-6)


@pytest.mark.parametrize("n", [3, 5, 4, 9, 8, 10])
def test_ngrams_hold_a_row_group_once(spark, tmp_path, n):
    """A row group of 96 MB: its bytes don't stay outside the heap after they were read (vectored reads kept them there)."""
    draw = random.Random(n)
    pq.write_table(pa.table({"doc_id": range(192), "text": [draw.randbytes(1 << 18).hex() for _ in range(191)] + ["a b " * n]}), f"{tmp_path}/documents.parquet", compression="none", use_dictionary=False)
    assert [r.doc_id for r in corpus.QUERIES[f"ngram_repetition_{n}"](spark, str(tmp_path)).collect()] == [191]
    java = spark._jvm.java.lang
    pools = java.management.ManagementFactory.getPlatformMXBeans(java.Class.forName("java.lang.management.BufferPoolMXBean"))
    assert next(p.getMemoryUsed() for p in pools if p.getName() == "direct") < 90 << 20


def test_repetition_goes_to_python_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.newSession().read.parquet(f"{tmp_path}/docs")
    assert curate.repetition_reasons(docs).filter("repetition <> ''")._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_parts_of_texts():
    texts = ["abc", None, "", "de", "x" * 9, "f", "g" * 4, None]
    assert list(curate.text_parts(texts, 5)) == [["abc", None, "", "de"], ["x" * 9], ["f", "g" * 4, None]]
    assert not list(curate.text_parts([])) and list(curate.text_parts([None])) == [[None]]


def test_running_sums(spark):
    for n in (0, 1, 63, 64, 65, 200):
        got = spark.range(1).select(t.running(F.array(*map(F.lit, range(n))).cast("array<int>"))).first()[0]
        assert got == np.cumsum(range(n)).tolist()


def test_segments():
    assert segment.segment("otroka", "otrok") == (["otrok", "a"], ["stem", "suffix"])
    assert segment.segment("psa", "pes") == (["ps", "a"], ["stem", "suffix"])
    assert segment.segment("roči", "roka") == (["roč", "i"], ["stem", "suffix"])
    assert segment.segment("in", "in", "Cc") == (["in"], ["stem"]) and segment.segment("sem", "biti") == (["sem"], ["whole"])


def test_convert_raises_without_identifier(spark):
    rows = spark.createDataFrame([("", "s", "x", {"a": "1"})], "uid string, source string, text string, metadata map<string,string>")
    with pytest.raises(Exception, match="record without uid from s"):
        convert.convert(rows).collect()
    got = convert.convert(rows.withColumn("uid", F.lit("s:1")), metadata=["a", "text"]).first()
    assert got.asDict() == {"text": "x", "id": "s:1", "dataset": "s", "a": "1", "meta_text": None}


def test_arrow_shards(spark, tmp_path):
    def write(name, rows, stream):
        table = pa.table({"id": [r[0] for r in rows], "text": [r[1] for r in rows]}, pa.schema([("id", pa.string()), ("text", pa.string())]))
        with pa.OSFile(f"{tmp_path}/{name}", "wb") as f, (pa.ipc.new_stream if stream else pa.ipc.new_file)(f, table.schema) as w:
            w.write_table(table, 2)

    write("a.arrow", [("x", "one"), (None, ""), (None, "three")], True)
    write("b.arrow", [("", "four"), ("y", "five")], False)
    got = records.read_arrow(spark, str(tmp_path), "hf", "c", {"train": ["a.arrow", "b.arrow"]}).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [("c:train:00000002", "three"), ("c:train:00000003", "four"), ("x", "one"), ("y", "five")]


def test_task_bundles(spark, tmp_path):
    own = tmp_path / "HumanT" / "boolq"
    own.mkdir(parents=True)
    (own / "train.jsonl").write_text('{"question": "q", "label": true}\nnot json\n')
    (own / "val.json").write_text('{"question": "v", "label": false}\n')
    got = records.read_task(spark, str(tmp_path), "humant", "BoolQ", "question string, label boolean").collect()
    assert sorted((r.split, r.question, r.label) for r in got) == [("train", "q", True), ("val", "v", False)]
    with pytest.raises(FileNotFoundError):
        records.task_files(spark, str(tmp_path), "googlemt", "BoolQ")


def test_registries():
    with pytest.raises(ValueError, match="there are"):
        registry.readers.get("none")
    registry.converters.register("own")(len)
    with pytest.raises(ValueError, match="already"):
        registry.converters.register("own")(max)
    assert registry.converters.get("own") is len


def test_run_records(spark, tmp_path):
    at = str(tmp_path)
    docs = spark.createDataFrame([("a", "x"), ("a", ""), ("b", "y")], "source string, text string")
    docs.write.parquet(f"{at}/in")
    kept = stages.Stage("kept", lambda df, c: df.filter("text <> ''"))
    stages.run_stages(spark, docs, [kept], f"{at}/out", fingerprint=stages.fingerprint(spark, f"{at}/in"))
    assert sorted((r.dataset, r.recorded, r.counted) for r in stages.recount(spark, f"{at}/out").collect()) == [("a", 1, 1), ("b", 1, 1)]
    assert stages.fingerprint(spark, f"{at}/in") == stages.fingerprint(spark, f"{at}/in") != stages.fingerprint(spark, f"{at}/out")
    listed = spark.createDataFrame([("a",), ("z",)], "dataset string")
    assert [r.dataset for r in stages.not_empty(listed, docs).collect()] == ["a"]
    assert stages.each(["1", "x"], int) == ({"1": 1}, {"x": "ValueError: invalid literal for int() with base 10: 'x'"})
    for v in ("1", "2"):
        stages.track(spark, f"{at}/runs", "d", {"n": v})
    assert [r["values"] for r in stages.tracked(spark, f"{at}/runs").collect()] == [{"n": "2"}]
    assert sorted(r.key for r in stages.sweep(spark, ["bpe", "unigram"], [16, 32], ["bpe-16"]).collect()) == ["bpe-32", "unigram-16", "unigram-32"]
    (tmp_path / "c.json").write_text(json.dumps({"x": {"role": "benchmark", "n": 1}}))
    (tmp_path / "c.local.json").write_text(json.dumps({"x": {"n": 2}}))
    assert stages.load_catalog(f"{at}/c.json") == {"x": {"role": "benchmark", "n": 2}}


def test_quotas():
    assert stats.quotas(100, {"a": 3, "c": 0}, ["a", "b", "c"]) == {"a": 75, "b": 25}


def test_given_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "An unlikely tokenizer"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.pieces for r in tokenizers.encode_by_file(docs, path).collect()}
    assert got == {1: Tokenizer.from_file(path).encode("An unlikely tokenizer", add_special_tokens=False).tokens, 2: []}
    pieces = tokenizers.encode_by_file(docs, public_tokenizers.path("piece_bpe_32k.model"), "sentencepiece").filter("doc_id = 1").first().pieces
    assert "".join(pieces).replace("▁", " ").strip() == "An unlikely tokenizer"


def test_shards_by_bytes(spark, tmp_path):
    rows = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1)
    got = storage.write_byte_shards(rows, f"file://{tmp_path}/s", 1 << 16).collect()
    assert len(got) > 1 and sum(r.rows for r in got) == 3000 and all(r.bytes >= 1 << 16 for r in sorted(got, key=lambda r: r.path)[:-1])
    assert spark.read.json(f"{tmp_path}/s").count() == 3000


def test_runs_are_compared_by_vocabulary(spark):
    units = spark.createDataFrame([(v, run, u, float(u % 5 + add), 1.0) for v in (16, 32) for run, add in (("a", 0), ("b", 0), ("c", 2)) for u in range(200)], "vocab long, run string, unit long, n double, d double")
    runs, pairs = reports.compare_by_vocabulary(units, "n", "d", 100, 3)
    got = {(r.vocab, r.run): (r.value, r.low <= r.value <= r.high, r.std > 0) for r in runs.collect()}
    assert got == {(v, run): (2.0 + 2 * (run == "c"), True, True) for v in (16, 32) for run in "abc"}
    assert {(r.vocab, r.a, r.b): r.significant for r in pairs.collect()} == {(v, a, b): b == "c" for v in (16, 32) for a, b in (("a", "b"), ("a", "c"), ("b", "c"))}


def test_languages(spark):
    docs = spark.createDataFrame([(1, "the cat is on the mat and it was that"), (2, "der Hund ist nicht mit dem Kind auf das"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in curate.language_filter(docs, ["de"], ["en"]).collect()] == [2]
    assert sorted((r.doc_id, r.language) for r in curate.language_filter(docs, ["de"], ["en"], keep_all=True).filter("doc_id < 3").collect()) == [(1, "en"), (2, "de")]
    with pytest.raises(ValueError, match="there are"):
        curate.language_filter(docs, ["xx"])
