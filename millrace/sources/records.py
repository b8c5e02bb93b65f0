"""Readers of line, JSON, text and table formats. All are lazy scans with declared schemas; bad records are skipped.

Each reader of documents returns uid, doc_id, text, source, domain and what it documents besides. Rows of null or blank text
are skipped. Where a source gives no identifier (null or empty), doc_id is <file stem>:<index>, or, where rows of a file
have no index without a shuffle, <file stem>:<16 hex digits of the text's SHA-256>.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as t

TOKENS = "array<struct<form:string,lemma:string,upos:string,feats:string,space_after:boolean>>"
NESTED = f"array<struct<sentences:array<struct<tokens:{TOKENS}>>>>"
#: Names that may hold an identifier, and the text and label columns of sentiment tables, in order.
ID_FIELDS = ["id", "_id", "docid", "doc_id", "uid", "url"]
SENTIMENT_TEXT = ["content", "text", "sentence", "paragraph", "tweet"]
SENTIMENT_LABEL = ["sentiment", "label", "polarity"]
SENTIMENT_ID = ["nid", "doc_id", "id"]
#: The parts of a legal record, by shape.
LEGAL_SECTIONS = ["jedro", "izrek", "obrazlozitev"]


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def first_of(columns: Sequence[Column]) -> Column:
    """The first that isn't null nor, as a string, empty."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns)) if columns else F.lit(None).cast("string")


def documents(rows: DataFrame, source: str, domain: str, *more: str) -> DataFrame:
    """The common columns of rows that have doc_id and text; rows of blank text go."""
    kept = rows.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return kept.select(t.uid(F.lit(source), F.col("doc_id")).alias("uid"), F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(source).alias("source"), F.lit(domain).alias("domain"), *more)


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)


def read_jsonl(spark: SparkSession, path: str, source: str, domain: str = "", text_field: str = "text", id_field: str = "doc_id", keep: Sequence[str] = (), pattern: str = "*.jsonl*") -> DataFrame:
    """One document a line; `keep` names top-level fields that become entries of metadata (map; nulls are left out).

    Nested paragraphs[].sentences[].tokens[] become tokens and sentence spans ([start, end) in tokens); both null if absent.
    """
    names = dict.fromkeys([text_field, id_field, *keep])
    schema = ", ".join([*(f"`{n}` string" for n in names), f"paragraphs {NESTED}"])
    rows = _lines(spark, path, pattern).filter(F.trim("value") != "").select(F.col("_metadata.file_path").alias("_file"), F.from_json("value", schema).alias("r"))
    field = lambda n: F.col("r").getField(n)
    text = field(text_field)
    doc_id = F.coalesce(first_of([field(id_field)]), F.concat_ws(":", stem(F.col("_file")), F.substring(F.sha2(text, 256), 1, 16)))
    metadata = F.map_filter(F.create_map(*(x for n in keep for x in (F.lit(n), field(n)))), lambda _, v: v.isNotNull()) if keep else F.create_map().cast("map<string,string>")
    sentences = F.flatten(F.transform(F.col("r.paragraphs"), lambda p: p["sentences"]))
    own = rows.select(doc_id.alias("doc_id"), text.alias("text"), metadata.alias("metadata"), F.transform(sentences, lambda s: s["tokens"]).alias("_s"))
    own = own.withColumn("tokens", F.flatten("_s")).withColumn("sentences", sentence_spans(F.transform("_s", lambda s: F.size(s))))
    return documents(own, source, domain, "metadata", "tokens", "sentences")


def sentence_spans(sizes: Column) -> Column:
    """[start, end) of each sentence from the sentences' sizes."""
    return F.when(sizes.isNotNull(), t.let(t.running(sizes), lambda e: F.transform(e, lambda x, i: F.array(F.coalesce(F.get(e, i - 1), F.lit(0)), x))))


def render_sentence(tokens: Column) -> Column:
    """Forms with a blank after each but the last and those of space_after = false."""
    last = F.size(tokens) - 1
    return F.array_join(F.transform(tokens, lambda x, i: F.concat(x["form"], F.when((i < last) & F.coalesce(x["space_after"], F.lit(True)), " ").otherwise(""))), "")


def read_json(spark: SparkSession, path: str, source: str, domain: str = "", text_field: str = "text", id_field: str = "doc_id") -> DataFrame:
    """Files of one object or an array of objects; what isn't an object is skipped."""
    schema = ", ".join(f"`{n}` string" for n in dict.fromkeys([text_field, id_field]))
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).schema(schema).json(path)
    rows = rows.select(F.col("_metadata.file_path").alias("_file"), F.col(text_field).alias("text"), F.col(id_field).alias("_id"))
    return documents(rows.withColumn("doc_id", F.coalesce(first_of([F.col("_id")]), F.concat_ws(":", stem(F.col("_file")), F.substring(F.sha2("text", 256), 1, 16)))), source, domain)


def text_blocks(content: Column) -> Column:
    """Blocks between empty lines, stripped; a line of blanks isn't empty. No empty blocks."""
    blocks = F.split(F.coalesce(content, F.lit("")), r"(?:\r?\n){2,}")
    return F.filter(F.transform(blocks, lambda b: F.regexp_replace(b, r"^[ \t\r\n]+|[ \t\r\n]+$", "")), lambda b: b != "")


def read_text(spark: SparkSession, path: str, source: str, domain: str = "") -> DataFrame:
    """A document for each block of a *.txt file; doc_id is <path under `path`, no suffix>:<six-digit index>."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    root = path.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), root), -1), r"\.[^.]*$", "")
    rows = files.select(name.alias("_name"), F.posexplode(text_blocks(F.col("value"))).alias("_i", "text"))
    return documents(rows.withColumn("doc_id", F.format_string("%s:%06d", "_name", "_i")), source, domain)


def read_legal(spark: SparkSession, path: str, source: str, claims: Sequence[str], domain: str = "legal", pattern: str = "*.jsonl*") -> DataFrame:
    """Legal JSONL: text, else fullText, else the sections, else the six claim fields (`claims`), joined by an empty line.
    subcorpus is the parent folder's name."""
    fields = ["doc_id", "text", "fullText", *LEGAL_SECTIONS, *claims]
    rows = _lines(spark, path, pattern).select(F.col("_metadata.file_path").alias("_file"), F.from_json("value", ", ".join(f"`{f}` string" for f in fields)).alias("r"))
    some = lambda n: F.nullif(F.trim(F.col("r").getField(n)), F.lit(""))
    joined = lambda names: F.nullif(F.concat_ws("\n\n", *map(some, names)), F.lit(""))
    text = F.coalesce(some("text"), some("fullText"), joined(LEGAL_SECTIONS), joined(claims))
    rows = rows.select(text.alias("text"), first_of([F.col("r.doc_id")]).alias("_id"), stem(F.col("_file")).alias("_stem"), F.element_at(F.split("_file", "/"), -2).alias("subcorpus"))
    return documents(rows.withColumn("doc_id", F.coalesce("_id", F.concat_ws(":", "_stem", F.substring(F.sha2("text", 256), 1, 16)))), source, domain, "subcorpus")


def read_columnar(spark: SparkSession, path: str, source: str, domain: str = "", text_field: str = "text", config: str = "data") -> DataFrame:
    """Parquet files of a config's folder; doc_id is the first identifier field there is, else config:<row index in file>."""
    rows = spark.read.parquet(path)
    ids = [F.col(c) for c in ID_FIELDS if c in rows.columns]
    place = F.format_string("%s:%s:%08d", F.lit(config), stem(F.col("_metadata.file_path")), F.col("_metadata.row_index"))
    return documents(rows.select(F.coalesce(first_of(ids), place).alias("doc_id"), F.col(text_field).alias("text")), source, domain)


def read_arrow(spark: SparkSession, path: str, source: str, config: str, splits: Mapping[str, Sequence[str]], domain: str = "", text_field: str = "text", rows: int = 10_000) -> DataFrame:
    """Arrow stream or file shards under `path`, listed by split in their order ('' for a dataset without splits).

    doc_id is the first identifier field that has a value, else config[:split]:<eight-digit row number in the split>, skipped
    rows counted. A first pass counts the rows of each shard, a number a file; then shards are read by tasks."""
    listed = [(i, split, name) for split, names in splits.items() for i, name in enumerate(names)]
    files = spark.read.format("binaryFile").load([f"{path.rstrip('/')}/{name}" for _, _, name in listed]).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def opened(content: pa.Buffer) -> Iterator[pa.RecordBatch]:
        if bytes(content[:6]) == b"ARROW1":
            held = pa.ipc.open_file(content)
            return (held.get_batch(i) for i in range(held.num_record_batches))
        return iter(pa.ipc.open_stream(content))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [sum(b.num_rows for b in opened(x.as_buffer())) for x in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sizes, pa.int64())], ["name", "n"])

    sizes = {r["name"]: r["n"] for r in files.mapInArrow(count, "name string, n long").collect()}
    begin: dict[str, tuple[str, int]] = {}
    for split, names in splits.items():
        at = 0
        for name in names:
            own = name.rpartition("/")[2]
            begin[own], at = (f"{config}:{split}" if split else config, at), at + sizes.get(own, 0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                prefix, at = begin[name]
                for part in opened(content.as_buffer()):
                    ids = [part.column(c).cast(pa.string()).to_pylist() for c in ID_FIELDS if c in part.schema.names]
                    texts = part.column(text_field).cast(pa.string()).to_pylist()
                    named = [next((x[k] for x in ids if x[k]), f"{prefix}:{at + k:08d}") for k in range(len(texts))]
                    at += len(texts)
                    for a in range(0, len(texts), rows):
                        yield pa.RecordBatch.from_arrays([pa.array(named[a : a + rows], pa.string()), pa.array(texts[a : a + rows], pa.string())], ["doc_id", "text"])

    return documents(files.mapInArrow(read, "doc_id string, text string"), source, domain)


#: Folders of the variants of a task bundle, and names of a split's file, in the order in which they are tried.
TASK_VARIANTS = {"humant": ["SuperGLUE-HumanT", "HumanT"], "googlemt": ["SuperGLUE-GoogleMT", "GoogleMT"]}
TASK_FILES = {"train": ["train.jsonl", "train.json"], "val": ["val.jsonl", "val.json"], "test": ["test.jsonl", "test.json"]}


def task_files(spark: SparkSession, root: str, variant: str, task: str) -> dict[str, str]:
    """split -> file of a task in a bundle: the variant's first folder that is there (else root, if it holds BoolQ), the task's
    folder in any case, the split's first file. Splits without one are left out. FileNotFoundError without a variant."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    inside = lambda at: {s.getPath().getName(): s.getPath().toString() for s in system.listStatus(spark._jvm.org.apache.hadoop.fs.Path(at))}
    top = inside(root)
    base = next((top[n] for n in TASK_VARIANTS.get(variant, []) if n in top), root if "BoolQ" in top else None)
    if base is None:
        raise FileNotFoundError(f"no folder of variant {variant} in {root}: tried {TASK_VARIANTS.get(variant, [])}")
    own = next((at for n, at in sorted(inside(base).items()) if n.lower() == task.lower()), None)
    held = inside(own) if own else {}
    return {split: next(held[n] for n in names if n in held) for split, names in TASK_FILES.items() if any(n in held for n in names)}


def read_task(spark: SparkSession, root: str, variant: str, task: str, schema: str) -> DataFrame:
    """The records of a task's splits, by `schema`, plus split; lines that are no JSON are skipped."""
    found = task_files(spark, root, variant, task)
    rows = None
    for split, path in found.items():
        own = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
        own = own.filter("_bad is null").drop("_bad").withColumn("split", F.lit(split))
        rows = own if rows is None else rows.unionByName(own)
    return rows if rows is not None else spark.createDataFrame([], f"{schema}, split string")


def read_curated(spark: SparkSession, path: str, datasets: Sequence[str] | None = None) -> DataFrame:
    """Curated shards <dataset>/<n>.jsonl.gz: id, text, dataset, domain; only named datasets, if any are named."""
    rows = spark.read.schema("id string, text string, dataset string, domain string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl.gz").json(path)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    rows = rows.select("id", "text", F.coalesce("dataset", folder).alias("dataset"), "domain")
    return rows.filter(F.col("dataset").isin(*datasets)) if datasets is not None else rows


def join_annotations(texts: DataFrame, annotations: DataFrame) -> DataFrame:
    """texts with annotations by uid. Raises, when run, if either side has a uid the other lacks, or repeats one."""
    left = texts.withColumn("_t", F.lit(1)).withColumn("_nt", F.count(F.lit(1)).over(Window.partitionBy("uid")))
    right = annotations.drop("doc_id").withColumn("_a", F.lit(1)).withColumn("_na", F.count(F.lit(1)).over(Window.partitionBy("uid")))
    both = left.join(right, "uid", "full")
    sound = F.col("_t").isNotNull() & F.col("_a").isNotNull() & (F.col("_nt") == 1) & (F.col("_na") == 1)
    return both.filter(F.when(sound, True).otherwise(F.raise_error(F.concat(F.lit("texts and annotations differ at uid "), F.coalesce("uid", F.lit("null")))))).drop("_t", "_a", "_nt", "_na")


def read_sidecar(spark: SparkSession, path: str, key: str, fields: Mapping[str, str], lists: Mapping[str, str] = {}, most: int = 1_000_000) -> DataFrame:
    """A metadata TSV: _key and, for each of `fields` (column -> name), its value; '' and '-' are null, `lists` (name ->
    separator) are split. Of rows of one key the last stays. `most` bounds what join_sidecar() broadcasts."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    value = lambda c, n: (lambda v: F.filter(F.split(v, lists[n]), lambda x: x != "") if n in lists else v)(F.when(~F.col(c).isin("", "-"), F.col(c)))
    own = rows.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_at"), *(value(c, n).alias(n) for c, n in fields.items()))
    return own.groupBy("_key").agg(*(F.max_by(n, "_at").alias(n) for n in fields.values()))


def join_sidecar(docs: DataFrame, sidecar: DataFrame, file_stem: Column, pattern: str | None = None, small: int = 1_000_000) -> DataFrame:
    """docs with the sidecar's columns, by the file stem or `pattern`'s first group in it. The sidecar is broadcast if it
    has at most `small` rows, else the sides are shuffled."""
    key = F.nullif(F.regexp_extract(file_stem, pattern, 1), F.lit("")) if pattern else file_stem
    side = F.broadcast(sidecar) if sidecar.limit(small + 1).count() <= small else sidecar
    return docs.withColumn("_key", key).join(side, "_key", "left").drop("_key")


def read_sentiment_tsv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """id, text, label of sentiment tables: the first column of each list that has a value; null where none has."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(list(paths))
    pick = lambda names: first_of([F.trim(F.col(n)) for n in names if n in rows.columns])
    return rows.select(pick(SENTIMENT_ID).alias("id"), pick(SENTIMENT_TEXT).alias("text"), pick(SENTIMENT_LABEL).alias("label")).filter("text is not null")


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """Word relations (TSV without header; fixed columns 1, 3, 5, 9, 11 from 0: lemma, split lemma, msd, rule, score).

    A row counts if it has ten fields, its split without '_' is the lemma, and its score isn't 0. Of a lemma's rows a
    verified one (a score above 0) stays before others, then the first of the file.
    """
    cells = F.split("value", "\t")
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("_at"), cells.alias("c")).filter(F.size("c") >= 10)
    rows = rows.select("_at", F.get("c", F.lit(1)).alias("lemma"), F.get("c", F.lit(3)).alias("d"), F.get("c", F.lit(5)).alias("msd"), F.get("c", F.lit(9)).alias("rule_id"), F.get("c", F.lit(11)).try_cast("int").alias("score"))
    rows = rows.filter((F.replace("d", F.lit("_"), F.lit("")) == F.col("lemma")) & ~F.col("score").eqNullSafe(F.lit(0)))
    rows = rows.withColumn("verified", F.coalesce(F.col("score") > 0, F.lit(False)))
    best = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("lemma").orderBy(F.desc("verified"), "_at"))).filter("_rn = 1")
    return best.select("lemma", F.filter(F.split("d", "_"), lambda x: x != "").alias("morphemes"), "msd", "verified", "rule_id")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """term: a word list's lines, trimmed, in lower case, once each; blank lines and those that begin with # are skipped."""
    term = F.lower(F.trim("value"))
    return spark.read.text(path).select(term.alias("term")).filter((F.col("term") != "") & ~F.col("term").startswith("#")).distinct()


def read_terms_of(spark: SparkSession, lists: Mapping[str, str], code: str) -> DataFrame:
    """read_terms() of a language's list (code -> path). ValueError, with the codes there are, for an unknown one."""
    if code not in lists:
        raise ValueError(f"no list for {code}; there are {', '.join(sorted(lists)) or 'none'}")
    return read_terms(spark, lists[code])


# CoNLL-U


def conllu_blocks(content: str) -> Iterator[tuple[dict[str, str], list[list[str]]]]:
    """(new document id, sent_id, text as far as they are said; rows of tokens) of each block of a file."""
    for block in re.split(r"\n\n+", content.replace("\r", "")):
        said, rows = {}, []
        for line in block.split("\n"):
            if line.startswith("#"):
                name, mark, value = line[1:].partition("=")
                if mark and value.strip():
                    said[name.strip()] = value.strip()
            elif len(cells := line.split("\t")) >= 10 and not {"-", "."} & {*cells[0]}:
                rows.append(cells)
        yield said, rows


def conllu_parts(content: str) -> Iterator[tuple[str | None, list[tuple[str | None, list[list[str]]]]]]:
    """(identifier, sentences as (said text, rows)) of each document of a file; see conllu_documents()."""
    held: list[tuple[str | None, list[list[str]]]] = []
    named = prefix = None
    marked = False
    for said, rows in conllu_blocks(content):
        new, (own, dot, _) = said.get("newdoc id"), said.get("sent_id", "").partition(".")
        own = own if dot and own else None
        if held and (new or not marked and own and prefix and own != prefix):
            yield named or prefix, held
            held, prefix = [], None
        if new:
            named, marked = new, True
        if rows:
            prefix = prefix or own
            held.append((said.get("text"), rows))
    if held:
        yield named or prefix, held


def conllu_documents(files: DataFrame, source: str, domain: str = "") -> DataFrame:
    """files (name, content: a whole file) -> documents plus tokens and sentences (spans in tokens).

    A document begins at `# newdoc id`; before a file's first such line, where the part of `sent_id` before the first dot
    changes; else it is the file. Ranges (1-2) and empty nodes (1.1) and rows of under ten columns are skipped, as are
    blocks without tokens. A sentence's text is its `# text`, else its rendered tokens. Sentences are joined by newlines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = lambda x: None if x == "_" else x
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                for doc_id, sentences in conllu_parts(content or ""):
                    rows = [c for _, own in sentences for c in own]
                    spaced = ["SpaceAfter=No" not in c[9] for c in rows]
                    ends = np.cumsum([len(own) for _, own in sentences])
                    texts = []
                    for (said, own), end in zip(sentences, ends.tolist()):
                        after = [*spaced[end - len(own) : end - 1], False]
                        texts.append(said if said is not None else "".join(c[1] + " " * s for c, s in zip(own, after)))
                    tokens = pa.StructArray.from_arrays([pa.array([c[1] for c in rows], pa.string()), *(pa.array([blank(c[k]) for c in rows], pa.string()) for k in (2, 3, 5)), pa.array(spaced, pa.bool_())], ["form", "lemma", "upos", "feats", "space_after"])
                    bounds = pa.array(np.stack([ends - [len(own) for _, own in sentences], ends], 1).ravel().astype(np.int32))
                    spans = pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1, dtype=np.int32) * 2), bounds)
                    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([doc_id], pa.string()), pa.array(["\n".join(texts)]), one(tokens), one(spans)], ["name", "doc_id", "text", "tokens", "sentences"])

    found = files.select("name", "content").mapInArrow(run, f"name string, doc_id string, text string, tokens {TOKENS}, sentences array<array<int>>")
    return documents(found.withColumn("doc_id", F.coalesce("doc_id", stem(F.col("name")))), source, domain, "tokens", "sentences")


def read_conllu(spark: SparkSession, path: str, source: str, domain: str = "") -> DataFrame:
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{conllu,conll}").text(path, wholetext=True)
    return conllu_documents(files.select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("content")), source, domain)
