"""Readers of XML corpora. Spark's XML source loses the order of mixed content, so files are parsed in Python tasks.

A file is one row of binaryFile (2 GB at most); the parser streams over it and drops elements once read. Files that aren't
well-formed give what was read before the error.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.records import documents

TOKEN_TYPE = pa.struct([("form", pa.string()), ("lemma", pa.string()), ("upos", pa.string()), ("feats", pa.string()), ("space_after", pa.bool_())])
FIELDS = pa.schema([("doc_id", pa.string()), ("text", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("tokens", pa.list_(TOKEN_TYPE)), ("sentences", pa.list_(pa.list_(pa.int32())))])
DDL = "doc_id string, text string, metadata map<string,string>, tokens array<struct<form:string,lemma:string,upos:string,feats:string,space_after:boolean>>, sentences array<array<int>>"
XML_ID = "{http://www.w3.org/XML/1998/namespace}id"
#: Categories of the compact tag set, and attributes of a corpus document that are kept.
CATEGORY = {"N": "NOUN", "V": "VERB", "A": "ADJ", "P": "PRON", "R": "ADV", "S": "ADP", "C": "CCONJ", "M": "NUM", "Q": "PART", "I": "INTJ", "Y": "X", "X": "X", "Z": "PUNCT"}
SUBTYPE = {"Np": "PROPN", "Va": "AUX", "Cs": "SCONJ"}


def local(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def tags_of(msd: str | None, ana: str | None) -> tuple[str | None, str | None]:
    """(upos, feats) of a token: from key=value pairs in msd, else from the mte: part of ana."""
    if msd:
        pairs = msd.split("|")
        upos = [p[8:] for p in pairs if p.startswith("UPosTag=")]
        return (upos[-1] if upos else None), "|".join(p for p in pairs if not p.startswith("UPosTag=")) or None
    code = next((p[4:] for p in (ana or "").split() if p.startswith("mte:")), "")
    return (SUBTYPE.get(code[:2]) or CATEGORY.get(code[0]), f"MTE={code}") if code else (None, None)


def sentence(node: ElementTree.Element) -> list[dict]:
    """Tokens of a sentence. join="right" or "both": no blank after; "left" or "both": none before."""
    out: list[dict] = []
    for x in node.iter():
        if local(x.tag) in ("w", "pc") and (form := "".join(x.itertext()).strip()):
            join = x.get("join", "")
            if join in ("left", "both") and out:
                out[-1]["space_after"] = False
            upos, feats = tags_of(x.get("msd"), x.get("ana"))
            out.append({"form": form, "lemma": x.get("lemma"), "upos": upos, "feats": feats, "space_after": join not in ("right", "both")})
    return out


def render(tokens: list[dict]) -> str:
    return "".join(x["form"] + (" " if x["space_after"] and i + 1 < len(tokens) else "") for i, x in enumerate(tokens))


def _annotated(doc_id: str, found: list[list[dict]], metadata: dict[str, str]) -> dict:
    at, spans = 0, []
    for s in found:
        spans.append([at, at + len(s)])
        at += len(s)
    return {"doc_id": doc_id, "text": "\n".join(map(render, found)), "metadata": [*metadata.items()], "tokens": [x for s in found for x in s], "sentences": spans}


def tei(name: str, content: bytes) -> Iterator[dict]:
    """With utterances, a document for each <u> (who and ana are metadata); with sentences alone, one for the file; else one
    for each <p> of the first <body>. An utterance without xml:id and a paragraph without one are named by their index."""
    loose: list[list[dict]] = []
    plain: list[tuple[str | None, str]] = []
    own: list[list[dict]] = []
    inside = bodies = spoken = 0
    try:
        for event, node in ElementTree.iterparse(io.BytesIO(content), ("start", "end")):
            tag = local(node.tag)
            if event == "start":
                inside += tag == "u"
                bodies += tag == "body"
                continue
            if tag == "s":
                if found := sentence(node):
                    (own if inside else loose).append(found)
                node.clear()
            elif tag == "u":
                inside -= 1
                if own:
                    yield _annotated(node.get(XML_ID) or f"{name}:{spoken:06d}", own, {k: node.get(k) for k in ("who", "ana") if node.get(k)})
                own, spoken = [], spoken + 1
                node.clear()
            elif tag == "p" and bodies == 1 and not inside and not loose:
                if text := " ".join("".join(node.itertext()).split()):
                    plain.append((node.get(XML_ID), text))
            elif tag == "body" and bodies == 1:
                bodies = 2  # later bodies hold no plain paragraphs
    except ElementTree.ParseError:
        pass
    if spoken:
        return
    if loose:
        yield _annotated(name, loose, {})
        return
    for i, (key, text) in enumerate(plain):
        yield {"doc_id": key or f"{name}:{i:06d}", "text": text, "metadata": [], "tokens": None, "sentences": None}


def corpus_xml(name: str, content: bytes, attributes: tuple[str, ...] = ("title", "url", "domain", "crawl_date", "file_type", "lang", "genre")) -> Iterator[dict]:
    """A document for each <doc>: its stripped <p> texts, joined by newlines; named attributes that aren't empty."""
    i = 0
    try:
        for _, node in ElementTree.iterparse(io.BytesIO(content), ("end",)):
            if local(node.tag) == "doc":
                texts = ["".join(p.itertext()).strip() for p in node.iter() if local(p.tag) == "p"]
                yield {"doc_id": node.get("id") or f"{name}:{i:06d}", "text": "\n".join(x for x in texts if x), "metadata": [(k, node.get(k)) for k in attributes if node.get(k)], "tokens": None, "sentences": None}
                i += 1
                node.clear()
    except ElementTree.ParseError:
        return


def parse(files: DataFrame, parser: Callable[[str, bytes], Iterator[dict]], source: str, domain: str = "", rows: int = 200) -> DataFrame:
    """files (name, content binary) -> documents plus metadata, tokens and sentences, in batches of `rows`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name"), batch.column("content")):
                held: list[dict] = []
                for doc in parser(name.as_py() or "", content.as_py() or b""):
                    held.append(doc)
                    if len(held) == rows:
                        yield pa.RecordBatch.from_pylist(held, FIELDS)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, FIELDS)

    return documents(files.select("name", "content").mapInArrow(run, DDL), source, domain, "metadata", "tokens", "sentences")


def _files(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("name"), "content")


def read_tei(spark: SparkSession, path: str, source: str, domain: str = "") -> DataFrame:
    return parse(_files(spark, path), tei, source, domain)


def read_corpus_xml(spark: SparkSession, path: str, source: str, domain: str = "") -> DataFrame:
    return parse(_files(spark, path), corpus_xml, source, domain)


def lexicon_entries(content: bytes) -> Iterator[dict]:
    """entry_id, lemma, lemma_msd (of the first form equal to the lemma, else of the first) and forms (form, msd) of each
    <entry> of an inflectional lexicon; tags in any namespace. Entries without lemma or forms are skipped."""
    try:
        for _, node in ElementTree.iterparse(io.BytesIO(content), ("end",)):
            if local(node.tag) != "entry":
                continue
            lemma = next(("".join(x.itertext()).strip() for x in node.iter() if local(x.tag) == "lemma"), "")
            forms = []
            for word in (x for x in node.iter() if local(x.tag) == "wordForm"):
                msd = next(("".join(x.itertext()).strip() for x in word.iter() if local(x.tag) == "msd"), None)
                written = ["".join(f.itertext()).strip() for o in word.iter() if local(o.tag) == "orthography" for f in o.iter() if local(f.tag) == "form"]
                forms += [{"form": f, "msd": msd} for f in written if f]
            if lemma and forms:
                yield {"entry_id": node.get("id"), "lemma": lemma, "lemma_msd": next((f["msd"] for f in forms if f["form"] == lemma), forms[0]["msd"]), "forms": forms}
            node.clear()
    except ElementTree.ParseError:
        return


def lexicon_of(files: DataFrame) -> DataFrame:
    """lexicon_entries() of files (name, content binary)."""
    schema = pa.schema([("entry_id", pa.string()), ("lemma", pa.string()), ("lemma_msd", pa.string()), ("forms", pa.list_(pa.struct([("form", pa.string()), ("msd", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                if found := [*lexicon_entries(content.as_py())]:
                    yield from pa.Table.from_pylist(found, schema).to_batches(max_chunksize=1000)

    return files.select("content").mapInArrow(run, "entry_id string, lemma string, lemma_msd string, forms array<struct<form:string,msd:string>>")


def read_lexicon(spark: SparkSession, path: str, skip: str = "_mezzanine.xml") -> DataFrame:
    """lexicon_entries() of every XML file but those whose name ends in `skip`."""
    return lexicon_of(_files(spark, path).filter(~F.concat("name", F.lit(".xml")).endswith(skip)))
