"""Given merges, offsets and ids."""

from pyspark.sql import functions as F

from millrace.operators import tokenizers as z

MERGES = [("a", "b"), ("ab", "c"), ("c", "a")]


def test_merges_take_the_lowest_rank_first():
    ranks = {m: i for i, m in enumerate(MERGES)}
    assert z.apply_merges("abcab", ranks) == ["abc", "ab"] and z.apply_merges("cab", ranks) == ["c", "ab"]
    assert z.apply_merges("xyz", ranks) == ["x", "y", "z"] and z.apply_merges("", ranks) == []


def test_pieces_offsets_and_ids(spark):
    docs = spark.createDataFrame([(1, "abc cab!"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.pieces for r in z.encode_words(docs, MERGES).collect()}
    assert got == {1: ["abc", "c", "ab", "!"], 2: [], 3: []}
    rows = z.encode_words(docs, MERGES).filter("doc_id = 1")
    row = rows.select(z.piece_offsets(F.col("text"), F.col("pieces")).alias("o"), z.piece_ids(F.col("pieces"), {"abc": 0, "c": 1}).alias("i"), z.piece_ids(F.col("pieces"), {"abc": 0, "c": 1}, 9).alias("u")).first()
    assert row.o == [[0, 3], [4, 5], [5, 7], [7, 8]] and row.i == [0, 1] and row.u == [0, 1, 9, 9]
    marked = spark.createDataFrame([("to be", ["to", "Ġbe", "??"])], "text string, pieces array<string>")
    assert marked.select(z.piece_offsets(F.col("text"), F.col("pieces"))).first()[0] == [[0, 2], [3, 5], [5, 5]]


def test_models_and_metadata(spark):
    docs = spark.createDataFrame([(1, "bad"), (2, None), (3, "fine")], "doc_id long, text string")
    assert {r.doc_id for r in z.spam_model(docs, lambda s: float("bad" in s), 0.5).collect()} == {2, 3}
    one = spark.createDataFrame([({"a": "1", "b": None, "c": "3"},)], "m map<string,string>")
    row = one.select(z.project_metadata(F.col("m"), ["c", "b", "x"]).alias("k"), z.project_metadata(F.col("m"), leave=["a"]).alias("l"), z.project_metadata(F.col("m")).alias("all")).first()
    assert (row.k, row.l, row["all"]) == ({"c": "3"}, {"c": "3"}, {"a": "1", "c": "3"})
