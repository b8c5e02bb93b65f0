"""Readers and writers on small files."""

import gzip
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import markup, records, storage


def test_jsonl_skips_bad_and_empty_lines(spark, tmp_path):
    nested = {"doc_id": "n", "text": "A b. C", "paragraphs": [{"sentences": [{"tokens": [{"form": "A"}, {"form": "b", "space_after": False}, {"form": "."}]}, {"tokens": [{"form": "C"}]}]}]}
    lines = [json.dumps({"doc_id": "1", "text": "one", "url": "u"}), "", "{broken", json.dumps({"doc_id": "2", "text": "  "}), json.dumps({"doc_id": "", "text": "no id"}), json.dumps(nested)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.jsonl").write_text("\n".join(lines))
    got = {r.text: r for r in records.read_jsonl(spark, str(tmp_path), "src", keep=["url"]).collect()}
    assert set(got) == {"one", "no id", "A b. C"}
    assert got["one"].uid == "src:1" and got["one"].metadata == {"url": "u"} and got["one"].tokens is None and got["one"].sentences is None
    assert got["no id"].doc_id.startswith("a:")
    assert got["A b. C"].sentences == [[0, 3], [3, 4]] and [t.form for t in got["A b. C"].tokens] == ["A", "b", ".", "C"]
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "x.jsonl").write_text("")
    assert records.read_jsonl(spark, str(empty), "src").count() == 0


def test_json_arrays_and_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"doc_id": 1, "text": "x"}, {"doc_id": 2, "text": ""}]))
    (tmp_path / "b.json").write_text(json.dumps({"doc_id": 3, "text": "y"}))
    assert {(r.doc_id, r.text) for r in records.read_json(spark, str(tmp_path), "s").collect()} == {("1", "x"), ("3", "y")}


def test_text_blocks_are_numbered_without_blank_ones(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.txt").write_text("\n\n first\n  \nstill first \n\n\n\nsecond\n")
    got = [(r.doc_id, r.text) for r in records.read_text(spark, str(tmp_path), "s").orderBy("doc_id").collect()]
    assert got == [("d/f:000000", "first\n  \nstill first"), ("d/f:000001", "second")]


def token(i, form, misc="_"):
    return f"{i}\t{form}\t_\tNOUN\t_\tCase=Nom\t_\t_\t_\t{misc}"


def test_conllu_boundaries(spark):
    marked = "\n".join(["# newdoc id = one", "# sent_id = a.1", token(1, "Hi", "SpaceAfter=No"), token(2, "!"), "", "# sent_id = b.1", token("1-2", "skip"), token(1, "Yes"), "", "# newdoc id = two", "# text = Given  text", token(1, "x")])
    by_prefix = "\n".join(["# sent_id = e1.1", token(1, "a"), "", "# sent_id = e1.2", token(1, "b"), "", "# sent_id = e2.1", token(1, "c"), "", "# sent_id = none", "short\trow"])
    files = spark.createDataFrame([("x/m.conllu", marked), ("x/p.conllu", by_prefix), ("x/flat.conll", token(1, "z") + "\n\n" + token(1, "y")), ("x/empty.conllu", ""), ("x/null.conllu", None)], "name string, content string")
    got = {r.doc_id: r for r in records.conllu_documents(files, "s").collect()}
    assert {k: r.text for k, r in got.items()} == {"one": "Hi!\nYes", "two": "Given  text", "e1": "a\nb", "e2": "c", "flat": "z\ny"}
    assert got["one"].sentences == [[0, 2], [2, 3]] and got["one"].tokens[0].lemma is None and got["one"].tokens[0].upos == "NOUN"


def test_tei_shapes():
    spoken = b'<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><u xml:id="u1" who="#a"><s><w lemma="dan" msd="UPosTag=NOUN|Case=Nom">Dan</w><pc join="left" ana="mte:Z">.</pc></s></u><u><s><w ana="mte:Np">Ana</w></s></u></body></text></TEI>'
    one, two = markup.tei("f", spoken)
    assert one["doc_id"] == "u1" and one["text"] == "Dan." and one["metadata"] == [("who", "#a")] and one["tokens"][0]["feats"] == "Case=Nom"
    assert two["doc_id"] == "f:000001" and two["tokens"][0]["upos"] == "PROPN"
    loose = b'<TEI><text><body><s><w join="right">a</w><pc>,</pc><w>b</w></s><s><w>c</w></s></body></text></TEI>'
    (doc,) = markup.tei("f", loose)
    assert (doc["doc_id"], doc["text"], doc["sentences"]) == ("f", "a, b\nc", [[0, 3], [3, 4]])
    plain = b'<TEI><teiHeader><p>no</p></teiHeader><text><body><p xml:id="p1">Good <b>day</b>.</p><p> </p></body></text></TEI>'
    assert [(x["doc_id"], x["text"]) for x in markup.tei("f", plain)] == [("p1", "Good day.")]
    assert list(markup.tei("f", b"<TEI><text>")) == [] and list(markup.tei("f", b"")) == []


def test_xml_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "w.xml").write_text('<corpus><doc id="1" title="T" url=""><p> a </p><p/><p>b <i>c</i></p></doc><doc><p></p></doc></corpus>')
    (row,) = markup.read_corpus_xml(spark, str(tmp_path / "c"), "web").collect()
    assert (row.uid, row.text, row.metadata) == ("web:1", "a\nb c", {"title": "T"})
    (tmp_path / "l").mkdir()
    form = lambda f, m: f"<wordForm><msd>{m}</msd><formRepresentations><orthographyList><orthography><form>{f}</form></orthography></orthographyList><accentuation><form>x</form></accentuation></formRepresentations></wordForm>"
    (tmp_path / "l" / "a.xml").write_text(f'<lexicon><entry id="e"><head><headword><lemma>dan</lemma></headword></head><body><wordFormList>{form("dneva", "Ng")}{form("dan", "Nn")}</wordFormList></body></entry></lexicon>')
    (tmp_path / "l" / "a_mezzanine.xml").write_text("<lexicon/>")
    (entry,) = markup.read_lexicon(spark, str(tmp_path / "l")).collect()
    assert (entry.lemma, entry.lemma_msd, [f.form for f in entry.forms]) == ("dan", "Nn", ["dneva", "dan"])


def test_legal_precedence(spark, tmp_path):
    (tmp_path / "court").mkdir()
    rows = [{"doc_id": "1", "text": "t", "fullText": "f"}, {"doc_id": "2", "fullText": "f"}, {"doc_id": "3", "jedro": "j", "izrek": " ", "obrazlozitev": "o"}, {"doc_id": "4", "c1": "x", "c2": "y"}, {"doc_id": "5"}]
    (tmp_path / "court" / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = {r.doc_id: (r.text, r.subcorpus) for r in records.read_legal(spark, str(tmp_path), "law", ["c1", "c2"]).collect()}
    assert got == {"1": ("t", "court"), "2": ("f", "court"), "3": ("j\n\no", "court"), "4": ("x\n\ny", "court")}


def test_sidecar_last_row_wins(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("key\tauthor\ttags\na\tX\tp;q\nb\t-\t\na\tY\tr\n")
    side = records.read_sidecar(spark, str(tmp_path / "m.tsv"), "key", {"author": "by", "tags": "tags"}, {"tags": ";"})
    docs = spark.createDataFrame([("a-1",), ("b-1",), ("c-1",)], "name string")
    got = {r.name: (r.by, r.tags) for r in records.join_sidecar(docs, side, F.col("name"), r"^(\w)-").collect()}
    assert got == {"a-1": ("Y", ["r"]), "b-1": (None, None), "c-1": (None, None)}


def test_annotations_must_match(spark):
    texts = spark.createDataFrame([("s:1", "a"), ("s:2", "b")], "uid string, text string")
    notes = spark.createDataFrame([("s:1", "x"), ("s:2", None)], "uid string, forms string")
    assert {(r.uid, r.forms) for r in records.join_annotations(texts, notes).collect()} == {("s:1", "x"), ("s:2", None)}
    with pytest.raises(Exception, match="differ at uid s:2"):
        records.join_annotations(texts, notes.filter("uid = 's:1'")).collect()


def test_relations_and_terms(spark, tmp_path):
    row = lambda lemma, split, score: "\t".join(["0", lemma, "2", split, "4", "N", "6", "7", "8", "r1", "10", score])
    (tmp_path / "r.tsv").write_text("\n".join([row("abc", "ab_c", ""), row("abc", "a_bc", "1"), row("xy", "x_z", "1"), row("no", "n_o", "0"), "short"]))
    (got,) = records.read_relations(spark, str(tmp_path / "r.tsv")).collect()
    assert (got.lemma, got.morphemes, got.verified, got.rule_id) == ("abc", ["a", "bc"], True, "r1")
    (tmp_path / "t.txt").write_text("# head\n Foo \n\nfoo\nbar\n")
    assert {r.term for r in records.read_terms(spark, str(tmp_path / "t.txt")).collect()} == {"foo", "bar"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(i, "train" if i < 3 else "other" if i == 3 else None) for i in range(5)], "id long, split string")
    assert {(r.split, r.n) for r in storage.write_splits(rows, str(tmp_path / "s"), ["train", "test"]).collect()} == {("train", 3), ("test", 0)}
    docs = spark.createDataFrame([("s:1", "a", None)], "uid string, text string, forms string")
    assert not storage.write_with_sidecar(docs, str(tmp_path / "n"), ["forms"]) and not (tmp_path / "n" / "annotations").exists()
    assert storage.write_with_sidecar(docs.withColumn("forms", F.lit("x")), str(tmp_path / "n"), ["forms"])
    both = storage.write_kept_and_excluded(rows, F.col("split") == "train", str(tmp_path / "k"))
    assert both.filter("kept").count() == 3 and both.filter("not kept").count() == 2
    storage.write_line_sample(spark.createDataFrame([(" a\n b ",), ("",), (None,)], "text string"), str(tmp_path / "l"))
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["a b"]


def test_unpack(tmp_path):
    (tmp_path / "x.txt").write_text("hello")
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as z:
        z.add(tmp_path / "x.txt", "d/x.txt")
    with gzip.open(tmp_path / "y.txt.gz", "wt") as z:
        z.write("y")
    assert storage.unpack(str(tmp_path / "a.tar.gz"), str(tmp_path / "o"))[0].endswith("d/x.txt")
    assert open(storage.unpack(str(tmp_path / "y.txt.gz"), str(tmp_path / "p"))[0]).read() == "y"
    with pytest.raises(ValueError):
        storage.unpack(str(tmp_path / "x.txt"), str(tmp_path / "q"))


def test_conllu_files(spark, tmp_path):
    (tmp_path / "a.conllu").write_text(token(1, "Hi") + "\n\n" + token(1, "you") + "\n")
    (tmp_path / "b.conll").write_text("# newdoc id = n\n" + token(1, "x"))
    (tmp_path / "c.txt").write_text(token(1, "no"))
    assert {(r.doc_id, r.text) for r in records.read_conllu(spark, str(tmp_path), "s").collect()} == {("a", "Hi\nyou"), ("n", "x")}


def test_columnar_and_curated(spark, tmp_path):
    spark.createDataFrame([(None, "a"), ("k", "b"), ("", "c"), ("e", "")], "id string, text string").coalesce(1).write.parquet(str(tmp_path / "p"))
    got = {r.text: r.doc_id for r in records.read_columnar(spark, str(tmp_path / "p"), "s", config="cfg").collect()}
    assert got["b"] == "k" and got["a"].startswith("cfg:part-") and got["a"].endswith(":00000000") and got["c"].endswith(":00000002") and len(got) == 3
    (tmp_path / "c" / "d1").mkdir(parents=True)
    with gzip.open(tmp_path / "c" / "d1" / "0.jsonl.gz", "wt") as f:
        f.write(json.dumps({"id": "1", "text": "t"}) + "\n" + json.dumps({"id": "2", "text": "u", "dataset": "d2"}))
    assert {(r.id, r.dataset) for r in records.read_curated(spark, str(tmp_path / "c")).collect()} == {("1", "d1"), ("2", "d2")}
    assert [r.id for r in records.read_curated(spark, str(tmp_path / "c"), ["d2"]).collect()] == ["2"]


def test_sentiment_columns(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("nid\tcontent\ttext\tlabel\n1\t\tb\tpos\n2\ta\tb\t\n3\t\t\tneg\n")
    assert [tuple(r) for r in records.read_sentiment_tsv(spark, [str(tmp_path / "a.tsv")]).orderBy("id").collect()] == [("1", "b", "pos"), ("2", "a", None)]
