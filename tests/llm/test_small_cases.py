"""Each operator on a small table with nulls, empty and long texts, ties, repeated rows, and further columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bytebpe, chunk_dedup, decontaminate, multi_index, order_minhash, pii, sstable, suffix_dedup, toxicity, weak_quality
from millrace.llm.common import blocks, gram_hashes, key_rows

SCHEMA = "doc_id long, text string, score string, spans string, n long, keep string"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 9))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


BASE = prose(150, 1)
EDITED = BASE.replace(BASE.split()[70], "changed", 1)
ROWS = [(1, BASE), (2, BASE), (3, EDITED), (4, prose(140, 2)), (5, None), (6, ""), (7, "Hi."), (None, prose(90, 3)), (8, prose(60, 4) + " " + " ".join(BASE.split()[:60])), (9, prose(6000, 6)), (9, prose(80, 7)), (10, "ñandú 漢字 \U0001f600 'll\n\n  x" * 9), (None, prose(90, 3))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "a", "b", 1, "c") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def in_order():
    """Row numbers as key_rows orders them."""
    return sorted(range(len(ROWS)), key=lambda k: (ROWS[k][0] is not None, ROWS[k][0] or 0, ROWS[k][1] is not None, ROWS[k][1] or ""))


def test_keys_are_unique_and_ordered(docs):
    got = key_rows(docs).orderBy("_key").collect()
    assert len({r["_key"] for r in got}) == len(ROWS)
    assert [(r.doc_id, r.text) for r in got] == [ROWS[k] for k in in_order()]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 2.,'!\n\t é漢Ⅷstrevmld ", max_size=30))
def test_pre_tokens_equal_the_pattern(text):
    import regex

    assert bytebpe.pre_tokens(text) == regex.findall(public_tokenizers.PATTERN, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=300), st.integers(0, 5))
def test_scan_equals_the_loop(kinds, start):
    state, want = start, []
    for k in kinds:
        want.append(state)
        state = int(bytebpe.NEXT[k, state])
    assert bytebpe.states_before(np.array(kinds, np.uint8), start=start).tolist() == want


def test_bpe_equals_the_library(docs, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.digests(docs, path).collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := library.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in ROWS]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert not bytebpe.digests(empty, path).collect()
    for r in bytebpe.encode_documents(docs.filter("doc_id <> 9"), path, keep=["doc_id", "text", "keep"]).collect():
        ids, text = np.frombuffer(r.ids, "<u4").tolist(), r.text or ""
        assert ids == library.encode_ordinary(text) and bytes(r.decoded) == text.encode() and r.n_tokens == len(ids) and r.keep == "c"
        assert [text[a:b] for a, b in zip([0, *r.slice_ends], r.slice_ends)] == bytebpe.pre_tokens(text)


def test_shards_hold_every_document(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    shards = sstable.write_shards(docs, path, f"file://{tmp_path}/s", shards=3)
    want, start = [], 0
    for k in in_order():
        ids = np.array([*library.encode(ROWS[k][1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((ROWS[k][0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, sstable.read_shards(spark, shards).collect()), key=lambda r: r[1]) == want
    readers = [sstable.Reader(s["path"]) for s in shards]
    assert [r.get(4) is not None for r in readers].count(True) == 1 and all(r.get(999) is None for r in readers)
    assert not sstable.token_shards(empty, path).collect()


def test_many_blocks_and_prefixes(tmp_path):
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(f"file://{tmp_path}")
    writer = sstable.Writer(where.open_output_stream(f"{at}/x.sst"))
    ids = {k: np.arange(k % 700, dtype=np.uint32) * (300 if k % 3 else 1) for k in range(-500, 500, 3)}
    for k, v in ids.items():
        writer.add(sstable.key_of(k), v)
    writer.close()
    reader = sstable.Reader(f"file://{tmp_path}/x.sst")
    assert len(reader.where) > 3 and [k for k, _ in reader.scan()] == [*ids]
    assert all(np.array_equal(reader.get(k), v) for k, v in ids.items())
    assert sum(reader.may_hold(k) for k in range(10_000, 11_000)) < 60


def test_classes_of_near_duplicates(docs, empty):
    rows = order_minhash.near_duplicates(docs).collect()
    got = {r.doc_id: r.class_id for r in rows if r.doc_id not in (None, 9)}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 10: 10}
    assert sum(r.keep for r in rows if r.doc_id is None) == 1 and sum(r.keep for r in rows if r.doc_id == 9) == 2
    kept = order_minhash.first_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 4
    assert not order_minhash.near_duplicates(empty).collect()


def test_alignment_equals_the_table():
    r = np.random.default_rng(3)
    for _ in range(300):
        a = r.permutation(40)[: r.integers(1, 40)]
        b = np.array([x for x in a if r.random() > 0.08] + [99] * r.integers(0, 2))
        if r.random() < 0.3:
            b = b[::-1]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        n = table[-1, -1]
        assert order_minhash.aligned(a.astype(np.uint64), b.astype(np.uint64), 0.8) == (len(b) > 0 and n / (len(a) + len(b) - n) >= 0.8 - 1e-9)


def test_pairs_in_a_template_family_equal_brute_force(spark):
    r = random.Random(11)
    own = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    shared = own(284)
    texts = [shared + own(60) for _ in range(450)]  # 0.7 like one another
    texts += [shared + t[284:319] + own(25) for t in texts[300:]]  # 0.85 like the one, 0.7 like the rest
    head, rest = texts[:300], texts[300:]
    r.shuffle(rest)
    rows = [(i, " ".join(t)) for i, t in enumerate(head + rest)]
    offsets = np.cumsum([0, *(len(t) for _, t in rows)])
    labelled, first = order_minhash.kmers(np.frombuffer("".join(t for _, t in rows).encode(), np.uint8), offsets, 5)
    v, at, n = np.unique(labelled, return_inverse=True, return_counts=True)
    seen = np.zeros((len(rows), (n > 1).sum()), np.float32)
    twice = n[at] > 1
    seen[np.repeat(np.arange(len(rows)), np.diff(first))[twice], (np.cumsum(n > 1) - 1)[at[twice]]] = 1
    size, both = np.diff(first), seen @ seen.T
    like = np.argwhere(np.triu(both / (size[:, None] + size - both) >= 0.8, 1)).tolist()
    want = {(a, b) for a, b in like if order_minhash.aligned(labelled[first[a] : first[a + 1]], labelled[first[b] : first[b + 1]], 0.8)}
    got = {i.doc_id: i.class_id for i in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) == 150 and {(c, i) for i, c in got.items() if i != c} == want


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (5, 6), (6, 5)], "a long, b long")
    assert {(r.node, r.root) for r in order_minhash.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8), (5, 5), (6, 5)}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


def test_spans_equal_the_patterns(spark):
    r = random.Random(1)
    parts = ["a@b.c", "@", ".", "x%y@z.com", "1.2.3.4", "300.1.1.1", "001.02.3.255", " ", "-", "+", "+1 (706) 555-3138", "4539578763621486", "4539 5787 6362 1486", "é漢\U0001f600", "word", "12", "+49.", "\n", "(", "DE89370400440532013000", "a@b.c%d@e.f"]
    texts = [None, "", *("".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(400)), "a@b.cd 7 " * 400]
    frame = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    base = {"email", "ip", "card", "phone"}
    for row in frame.collect():
        want = brute_spans(texts[row.doc_id] or "")
        assert [(s.kind, s.start, s.stop) for s in row.pii if s.kind in base] == want
    digest = pii.digest(frame).collect()
    assert all(d.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in brute_spans(texts[d.doc_id] or "")).encode()).hexdigest() for d in digest)


def test_checksums_context_and_redaction(spark):
    texts = [(1, "IBAN DE89370400440532013000 or DE89370400440532013001"), (2, "SSN 123-45-6789"), (3, "part 123-45-6789"), (4, "mail é a@b.co now"), (5, None)]
    found = pii.find(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r.doc_id: [s.kind for s in r.pii] for r in found.collect()} == {1: ["iban"], 2: ["national_id"], 3: [], 4: ["email"], 5: []}
    assert {r.doc_id: r.text for r in pii.redact(found).collect()} == {1: "IBAN <IBAN> or DE89370400440532013001", 2: "SSN <NATIONAL_ID>", 3: "part 123-45-6789", 4: "mail é <EMAIL> now", 5: None}


def test_items_in_long_documents(spark, docs, empty):
    item = " ".join(ROWS[9][1].split()[3000:3030])
    items = spark.createDataFrame([(1, item.upper()), (2, "too short here"), (3, None), (4, " ".join(item.split()[:20]) + " " + prose(20, 77)), (5, item)], "item_id long, text string")
    got = decontaminate.contained(key_rows(docs), items).collect()
    assert sorted((r.doc_id, r.item_id, r.n_shared) for r in got) == [(9, 1, 26), (9, 5, 26)]
    assert decontaminate.decontaminate(docs, items).count() == len(ROWS) - 1
    assert not decontaminate.contained(key_rows(empty), items).collect()
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == len(ROWS)


def test_toxicity_learns_from_its_rows_alone(spark, docs, empty):
    r = random.Random(2)
    bad = {i: r.random() < 0.3 for i in range(400)}
    rows = spark.createDataFrame([(i, prose(40, i) + (" vilespeak" * 2 if bad[i] else "")) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bad[i])) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(rows, labels)
    learnt = {x.doc_id for x in toxicity.sample(rows, labels).collect()}
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i in learnt)
    held = [x for x in toxicity.score(rows, model).collect() if zlib.crc32(str(x.doc_id).encode()) % 4 == 2]
    assert len(held) > 50 and np.mean([x.predicted == bad[x.doc_id] for x in held]) > 0.95
    scored = toxicity.score(docs, model)
    assert all(0 <= x.score <= 1 for x in scored.collect()) and scored.columns == ["doc_id", "text", "spans", "n", "keep", "score", "predicted"]
    assert not toxicity.score(empty, toxicity.train(empty, labels)).collect()


def test_weak_labels_part_prose_from_noise(spark, docs, empty):
    rows = [(i, "the " + prose(60, i).replace(" ", " the ", 8)) for i in range(150)] + [(1000 + i, "buy " * 60 if i % 2 else "#!! %% && " * 40) for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.keep for r in weak_quality.score(frame, weak_quality.train(frame)).collect()}
    assert np.mean([got[i] for i in range(150)]) > 0.95 and np.mean([got[1000 + i] for i in range(50)]) < 0.1
    out = weak_quality.score(docs, weak_quality.train(docs)).collect()
    assert len(out) == len(ROWS) and not any(r.keep for r in out if not r.text)
    assert not weak_quality.score(empty, weak_quality.train(empty)).collect()


def test_neighbours_are_found(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 16)).astype("f4")
    x[300:330] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [1.0]), (None, x[0].tolist()), (704, [None] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    small = multi_index.Settings(block_rows=64)
    sims, hit, n = x.astype(float) @ x.astype(float).T, 0, 0
    for q, group in multi_index.neighbours(frame, 20, small).toPandas().groupby("query_id"):
        own = sims[q].copy()
        own[q] = -np.inf
        best = np.lexsort((np.arange(600), -own))[:20]
        assert group.vec_id.max() < 600 and group["rank"].tolist() == sorted(group["rank"]) and np.allclose(own[group.vec_id], group.score)
        hit, n = hit + len({*best.tolist()} & {*group.vec_id}), n + 20
    assert n == 600 and hit / n >= 0.9
    assert not multi_index.neighbours(frame.limit(0)).collect()


def templated(groups, common, shared, own, seed=0):
    """Pairs of documents that are similar within a pair, in a family of which all share `common` words."""
    template, rows = prose(common, seed).split(), []
    for g in range(groups):
        both = prose(shared, 10_000 * seed + 300 + 3 * g).split()
        for k in (1, 2):
            r = random.Random(1000 * seed + 2 * g + k)
            at = r.randrange(len(template))
            text = template[:at] + prose(own, 50_000 * (seed + 1) + 2 * g + k).split() + template[at:]
            rows.append((len(rows), " ".join(text[:40] + both + text[40:])))
    return rows


def brute_classes(rows):
    """The class of each row, by the alignment of all pairs."""
    data = [np.frombuffer(t.encode(), np.uint8) for _, t in rows]
    k = [order_minhash.kmers(d, np.array([0, len(d)]), 5)[0] for d in data]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    links = [(a, b) for a in range(len(rows)) for b in range(a) if order_minhash.aligned(k[b], k[a], 0.8)]
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [rows[find(i)][0] for i in range(len(rows))], links


def edited_family(n, seed):
    """Copies of one text with one to six edits, so that many are only like some of the others."""
    base, r, rows = prose(150, seed).split(), random.Random(seed), []
    for i in range(n):
        words = list(base)
        for _ in range(r.randint(1, 6)):
            words[r.randrange(len(words))] = r.choice(VOCABULARY)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("rows", [templated(45, 300, 15, 24), edited_family(110, 3) + [(1000 + i, t) for i, t in templated(30, 200, 10, 13, 1)]])
def test_no_link_is_lost_in_families(spark, rows):
    want, links = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(links) > 10 and [got[i] for i, _ in rows] == want


def test_words_of_any_script():
    from millrace.llm.common import words

    texts = ["Über über ÜBER", "漢字\u00a0漢字—漢字", "a\u2019b", "", "Ⅷ x"]
    data = "".join(texts).encode()
    h, begin, end, doc = words(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
    assert [data[a:b].decode() for a, b in zip(begin, end)] == ["Über", "über", "ÜBER", "漢字", "漢字", "漢字", "a", "b", "Ⅷ", "x"]
    assert len(set(h[:3])) == len(set(h[3:6])) == 1 and doc.tolist() == [0, 0, 0, 1, 1, 1, 2, 2, 4, 4]


def test_repeated_vec_ids_are_one_query_whatever_the_order(spark):
    r = np.random.default_rng(7)
    rows = [(i % 60, [float(x) for x in r.normal(size=8)]) for i in range(240)]
    schema = "vec_id long, embedding array<float>"
    got = [sorted(map(tuple, multi_index.neighbours(spark.createDataFrame(x, schema)).collect())) for x in (rows, rows[::-1])]
    assert got[0] == got[1] and len(got[0]) == 60
    first = np.float32(min(v for i, v in rows if i == 0)).astype(float)
    best = sorted(((-float(np.float32(v).astype(float) @ first), i) for i, v in rows if i))[:20]
    assert np.allclose([x[3] for x in got[0][:20]], [-x for x, _ in best])


def test_walk_sees_the_nearest_cells():
    r = np.random.default_rng(1)
    one, two, counts = r.normal(size=7), r.normal(size=7), r.integers(0, 5, 49)
    d = (one[:, None] + two[None, :]).ravel()
    order = np.argsort(d)
    for wanted in (1, 20, 60, counts.sum()):
        k = int(np.searchsorted(np.cumsum(counts[order]), wanted))
        assert multi_index.walk(one, two, counts, wanted) == pytest.approx(d[order][k])


def brute_repeats(texts, length=100):
    seen, out = set(), []
    for t in texts:
        b, covered = t if isinstance(t, bytes) else (t or "").encode(), None
        covered = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                covered[p : p + length] = True
            seen.add(b[p : p + length])
        out.append((len(b), int(covered.sum()), int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum()), np.frombuffer(b, np.uint8)[~covered].tobytes()))
    return out


def test_suffix_dedup_equals_brute_force(spark, docs, empty):
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(docs).collect())
    assert got == sorted(brute_repeats([ROWS[k][1] for k in in_order()]))
    odd = [(1, "ab" * 300), (2, "x" * 99), (3, "x" * 101), (4, "y" + "ab" * 60), (5, BASE[:100]), (6, "q" + BASE[:100] + "r"), (7, "é" * 80)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(spark.createDataFrame(odd, "doc_id long, text string")).collect())
    assert got == [(i, *x) for (i, _), x in zip(odd, brute_repeats([t for _, t in odd]))]
    assert not suffix_dedup.dedup(empty).collect()


@pytest.mark.parametrize("set_bytes", [1500, 1 << 19])
def test_suffix_dedup_of_hot_lines_and_any_bytes(spark, set_bytes):
    from pyspark.sql import functions as F

    line = prose(18, 77)  # about 110 bytes, in very many surroundings
    rows = [(i, f"{prose(9, 100 + i)} {line if i % 3 else line[:97]} {prose(9, 500 + i % 50)}".encode()) for i in range(200)]
    rows += [(200, b"\xff\xfe" + b"ab\xc3" * 60), (201, b"z" + b"ab\xc3" * 50 + b"\xff"), (202, BASE.encode() + b"\x80" + BASE.encode())]
    docs = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(docs, set_bytes).collect())
    assert got == [(i, *x) for (i, _), x in zip(rows, brute_repeats([b for _, b in rows]))]
    assert sum(r.n_removed for r in chunk_dedup.dedup(docs).collect()) > 0


def test_chunk_dedup_of_short_copies(spark):
    docs = spark.createDataFrame([(1, "Hi."), (2, "Hi."), (3, "Ho."), (4, ""), (5, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed, bytes(r.kept)) for r in chunk_dedup.dedup(docs).collect()) == [(1, 0, b"Hi."), (2, 3, b""), (3, 0, b"Ho."), (4, 0, b""), (5, 0, b"")]


def test_suffix_array_and_gram_hashes():
    r = random.Random(0)
    for _ in range(200):
        s = np.array([r.randint(1, 3) for _ in range(r.randint(1, 60))])
        assert suffix_dedup.suffix_array(s, 1000).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    data = np.frombuffer(b"abcabcabcaXabcab", np.uint8)
    for k in (1, 3, 5, 7):
        h = gram_hashes(data, k)
        assert len(h) == len(data) - k + 1 and all((h[i] == h[j]) == (bytes(data[i : i + k]) == bytes(data[j : j + k])) for i in range(len(h)) for j in range(len(h)))


def test_chunk_dedup_equals_brute_force(docs, empty):
    s, seen, want = chunk_dedup.Settings(), set(), []
    for k in in_order():
        b = (ROWS[k][1] or "").encode()
        ends = chunk_dedup.cuts(np.frombuffer(b, np.uint8), np.array([0, len(b)]), s)[0]
        spans, last = [], 0
        for e in ends:
            if b[last:e] in seen:
                spans.append((last, e))
            seen.add(b[last:e])
            last = e
        assert last == len(b) and all(y - x <= s.high + s.low for x, y in zip([0, *ends], ends))
        runs = np.array([(x, y) for x, y in chunk_dedup.merged(np.array(spans).reshape(-1, 2)) if y - x >= s.least or y - x == len(b)]).reshape(-1, 2)
        want.append((len(b), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), b"".join(b[x:y] for x, y in zip([0, *runs[:, 1].tolist()], [*runs[:, 0].tolist(), len(b)]))))
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in chunk_dedup.dedup(docs).collect()) == sorted(want)
    assert sum(x[1] for x in want) > 0 and not chunk_dedup.dedup(empty).collect()


def test_chunks_find_passages_of_fifty_words(spark):
    rows, size = [], {}
    for i in range(150):
        passage = prose(51, 1000 + i)
        size[2 * i + 1] = len(passage)
        rows += [(2 * i + k, f"{prose(60, 5000 + 4 * i + k)} {passage} {prose(60, 9000 + 4 * i + k)}") for k in (0, 1)]
    got = {r.doc_id: r.n_removed for r in chunk_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    share = [got[i] / n for i, n in size.items()]
    assert min(share) > 0 and sum(x >= 0.5 for x in share) > 0.9 * len(share)


def test_gear_hash_and_shifts():
    data = np.frombuffer(prose(300, 8).encode(), np.uint8)
    h = chunk_dedup.gear_hashes(data)
    with np.errstate(over="ignore"):
        assert h[500] == sum(chunk_dedup.GEAR[data[500 - a]] << np.uint32(a) for a in range(32)).astype(np.uint32)
    ends = chunk_dedup.cuts(data, np.array([0, len(data)]))[0]
    moved = chunk_dedup.cuts(np.concatenate([data[:1], data]), np.array([0, len(data) + 1]))[0]
    assert len({e + 1 for e in ends} & set(moved)) > 0.8 * len(ends)


def test_blocks_cover_all_rows():
    offsets = np.array([0, 0, 5, 100, 100, 101])
    assert [*blocks(offsets, 10)] == [(0, 2), (2, 3), (3, 5)]


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and 0 < out.count() <= n
    got = corpus_pipeline.run(spark, d)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < got.count() < n


def test_pipeline_stages_keep_columns_of_any_name(spark, docs):
    """Nulls, empty and repeated rows, an empty table, and columns that are named as the operators name their own."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.001"
    odd = docs.select("doc_id", "text", F.lit("x").alias("score"), F.lit("y").alias("predicted"), F.lit("z").alias("_key"), F.lit("p").alias("_pii"), F.lit("q").alias("a.b"), F.lit("r").alias("_row"))
    texts = sorted({t or "" for _, t in ROWS if t is not EDITED})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, d).collect()
        assert got[0].__fields__ == odd.columns and {tuple(r)[2:] for r in got} == {("x", "y", "z", "p", "q", "r")}
        kept = sorted({r.text or "" for r in got if r.text != EDITED})
        assert len(got) == (len(texts) if name == "near_duplicates" else len(ROWS)) and kept == texts
        assert not stage(spark, odd.limit(0), d).collect()
    last = corpus_pipeline.STAGES[-1][1](spark, odd, d).collect()
    assert len(last) == len(ROWS) and sum(r.n_tokens == 0 for r in last) == 2


def test_texts_longer_than_a_block(spark):
    """A text of two megabytes among short ones, through every operator that works on blocks."""
    from millrace.llm.common import BLOCK_BYTES

    long = " ".join(f"{w}{i}" for i, w in enumerate(prose(300_000, 21).split()))
    rows = [(1, "short one here"), (2, long), (3, long[: len(long) // 2]), (4, None)]
    assert len(long) > BLOCK_BYTES
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    half = len(long) // 2
    assert {r.doc_id: r.n_removed for r in suffix_dedup.dedup(docs).collect()} == {1: 0, 2: 0, 3: half, 4: 0}
    cut = {r.doc_id: r.n_removed for r in chunk_dedup.dedup(docs).collect()}
    assert cut[1] == cut[2] == cut[4] == 0 and half - 2048 < cut[3] <= half
    sha = hashlib.sha256(long.encode()).hexdigest()
    assert {r.doc_id: r.decoded_sha256 for r in bytebpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).collect()}[2] == sha


def test_em_equals_the_plain_one():
    """The EM over counted patterns against one over documents, and the accuracies of simulated labellers."""
    r, k = np.random.default_rng(3), len(weak_quality.LABELLERS)
    good, right = r.random(4000) < 0.7, np.linspace(0.65, 0.95, k)
    v = np.where(r.random((4000, k)) < 0.25, weak_quality.ABSTAIN, np.where(r.random((4000, k)) < right, good[:, None], ~good[:, None]).astype(int))
    pattern, place, count = np.unique(weak_quality.patterns(v.astype(np.int8)), return_inverse=True, return_counts=True)
    post, theta, prior = weak_quality.expectation_maximisation(pattern, count, 30)
    votes = [[int(x) for x in row] for row in v]
    own = []
    for row in votes:
        g, b = row.count(1), row.count(0)
        own.append(min(max((g + 1) / (g + 3 * b + 2), 0.05), 0.95))
    for _ in range(30):
        told = [(p, row) for p, row in zip(own, votes) if set(row) != {2}]
        share = min(max(sum(p for p, _ in told) / len(told), 0.05), 0.95)
        table = {(c, j): [1 + sum((p if c else 1 - p) for p, row in told if row[j] == x) for x in range(3)] for c in (0, 1) for j in range(k)}
        own = []
        for row in votes:
            odds = share / (1 - share)
            for j, x in enumerate(row):
                odds *= table[1, j][x] / sum(table[1, j]) / (table[0, j][x] / sum(table[0, j]))
            own.append(odds / (1 + odds))
    assert np.allclose(post[place], own, atol=1e-6) and abs(prior - 0.7) < 0.05
    assert np.mean((post[place] > 0.5) == good) > 0.95
    said = theta[1, :, weak_quality.GOOD] / (1 - theta[1, :, weak_quality.ABSTAIN])
    assert np.abs(said - right).max() < 0.06


def test_toxicity_fit_against_a_plain_one():
    """Weights have the sign of the log-count ratios, and rank held-out rows as a plain batch logistic regression does."""
    s, r = toxicity.Settings(bits=10, min_rows=2, min_ratio=0.0), np.random.default_rng(4)
    y = (r.random(600) < 0.3).astype(float)
    tilt = r.normal(size=200)
    rows = [np.flatnonzero(r.random(200) < 1 / (1 + np.exp(1.5 - tilt * (2 * t - 1)))).astype(np.int32) for t in y]
    w, bias = toxicity.fit(rows[:400], y[:400], s)
    x = np.zeros((600, 200))
    for i, row in enumerate(rows):
        x[i, row] = toxicity.length_norm(len(row))
    n1, n0 = y[:400].sum(), 400 - y[:400].sum()
    on = [[sum(j in set(rows[i].tolist()) for i in range(400) if y[i] == t) for j in range(200)] for t in (1, 0)]
    ratio = np.log((np.array(on[0]) + 1) / (n1 + 2)) - np.log((np.array(on[1]) + 1) / (n0 + 2))
    z, worth = x[:400] * ratio, np.where(y[:400] > 0, 200 / n1, 200 / n0)
    v, b = np.ones(200), 0.0
    for _ in range(3000):
        error = (1 / (1 + np.exp(-np.clip(z @ v + b, -30, 30))) - y[:400]) * worth
        v, b = v - 0.5 * (z.T @ error / 400 + s.l2 * v), b - 0.5 * error.mean()
    plain, own = x[400:] * ratio @ v + b, x[400:] @ w[:200] + bias
    right = lambda score: np.mean([a > c for a in score[y[400:] == 1] for c in score[y[400:] == 0]])
    strong = np.abs(ratio) > 0.5
    assert np.mean(np.sign(w[:200][strong]) == np.sign(ratio[strong])) > 0.95
    assert right(own) > 0.9 and abs(right(own) - right(plain)) < 0.03 and np.corrcoef(own, plain)[0, 1] > 0.9


def test_short_items_are_found(spark):
    bench = spark.createDataFrame([(1, "what is entropy"), (2, "Yes"), (3, "one two three four five six"), (4, "..."), (5, None)], "item_id long, text string")
    docs = key_rows(spark.createDataFrame([(1, "So what IS entropy, then?"), (2, "entropy is what"), (3, "yes yes"), (4, "zero one two three four five six"), (5, None)], "doc_id long, text string"))
    got = sorted((r.doc_id, r.item_id, r.n_shingles) for r in decontaminate.contained(docs, bench).collect())
    assert got == [(1, 1, 1), (3, 2, 1), (4, 3, 2)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs.drop("_key"), bench).collect()) == [2, 3, 5]


def test_redaction_of_overlapping_spans(spark):
    docs = spark.createDataFrame([(1, "+1 555 123 4567.bob@x.com end")], "doc_id long, text string")
    assert pii.redact(pii.find(docs)).first().text == "<PHONE> end"


@pytest.mark.parametrize("as_text", [False, True])
def test_ids_are_the_unaltered_librarys(as_text):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from millrace.llm.common import text_blocks

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a  b\u3000c 's 't don't ''s  \n\n x ", "\xa0\xa0z \u200b q \x1c a \x85c", "<|endoftext|> a<s>b", "a <|endoftext|> b", "", None, "x" * 3000 + " \u0301 \u00bd\u00b2 3x", " the the of" * 500, " <|endoftext|>" * 3]
    library = Tokenizer.from_file(path)
    if as_text:
        library.encode_special_tokens = True
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    encoder = sstable.Encoder(path, as_text)
    encoder.cache.most = 5  # generations change within the test
    for _ in range(3):
        got = [x.tolist() for _, _, data, offsets in text_blocks(pa.array(texts), 40) for x in encoder.encode(data, offsets)]
        assert got == want
    assert len(want[3]) == (10 if as_text else 5) - 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=300))
def test_states_of_neighbours_equal_the_scan(kinds):
    kinds = np.array(kinds, np.uint8)
    assert bytebpe.states_of_neighbours(kinds).tolist() == bytebpe.states_before(kinds).tolist()


def test_a_recurring_pre_token_goes_to_the_library_once(monkeypatch):
    seen = []
    monkeypatch.setattr(sstable, "encode_apart", lambda _, new: seen.extend(new) or [b"\1\0\0\0" * (len(x) % 3) for x in new])
    encoder = sstable.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = lambda a: "".join(f" {chr(97 + i % 26)}{chr(0x4E00 + i // 26 % 6000)}{chr(0xAC00 + i // 156_000)}" for i in range(a, a + 50_000)).encode()
    for a in [*range(0, 450_000, 50_000)] * 2:
        data = np.frombuffer(text(a), np.uint8)
        assert len(encoder.encode(data, np.array([0, len(data)]))[0]) == sum(len(x) % 3 for x in data.tobytes().replace(b" ", b"\xff ").split(b"\xff"))
    assert len(seen) == len(set(seen)) == 450_000


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=12), min_size=1, max_size=12))
def test_ids_dont_depend_on_what_the_cache_keeps(texts):
    ids = lambda x: np.frombuffer(x, np.uint8).astype("<u4")[1:].tobytes()
    small, large = (bytebpe.SliceCache(lambda new: [ids(x) for x in new], most) for most in (3, 1_000))
    for words in texts:
        data = np.frombuffer("".join(" " + "abcdefghijklm"[w] * (w % 4) for w in words).encode(), np.uint8)
        one, two = (c.encode(data, np.array([0, len(data)])) for c in (small, large))
        assert [x.tolist() for x in one] == [x.tolist() for x in two]
        want = b"".join(ids(x.encode()) for x in bytebpe.pre_tokens(data.tobytes().decode()))
        assert one[0].tobytes() == want
