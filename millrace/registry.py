"""Names for extension points: readers, converters of task records, tokenizers. A plug-in is a function; see the aliases."""

from __future__ import annotations

from collections.abc import Callable
from typing import Generic, TypeVar

from pyspark.sql import Column, DataFrame, SparkSession

Reader = Callable[..., DataFrame]  # (spark, path, source, domain) -> documents
FileParser = Callable[[str, bytes], object]  # (file name, content) -> dicts of documents; see sources.markup.parse
Converter = Callable[..., DataFrame]  # (rows, dataset) -> examples
Tokenizer = Callable[[Column], Column]  # text -> array<string> of pieces
F_ = TypeVar("F_", bound=Callable)


class Registry(Generic[F_]):
    def __init__(self, kind: str):
        self.kind, self.known = kind, {}

    def register(self, name: str) -> Callable[[F_], F_]:
        """A decorator. ValueError for a name that is taken."""

        def put(f: F_) -> F_:
            if self.known.setdefault(name, f) is not f:
                raise ValueError(f"{self.kind} {name} is registered already")
            return f

        return put

    def get(self, name: str) -> F_:
        """ValueError, with the names there are, for an unknown one."""
        if name not in self.known:
            raise ValueError(f"no {self.kind} {name}; there are {', '.join(sorted(self.known)) or 'none'}")
        return self.known[name]


readers: Registry[Reader] = Registry("reader")
parsers: Registry[FileParser] = Registry("file parser")
converters: Registry[Converter] = Registry("converter")
tokenizers: Registry[Tokenizer] = Registry("tokenizer")


def read_files(spark: SparkSession, name: str, path: str, source: str, domain: str = "", pattern: str = "*") -> DataFrame:
    """Documents of the files of a path by a registered file parser, one task a group of files."""
    from millrace.sources import markup

    return markup.parse(markup._files(spark, path, pattern), parsers.get(name), source, domain)


def _built_in() -> None:
    from millrace.operators import tasks
    from millrace.sources import markup, records

    for name in ("jsonl", "json", "text", "conllu", "legal", "columnar"):
        readers.register(name)(getattr(records, f"read_{name}"))
    readers.register("tei")(markup.read_tei)
    readers.register("corpus_xml")(markup.read_corpus_xml)
    for name in ("nli", "boolq", "wsc", "wic", "copa", "multirc", "spans", "sentiment"):
        converters.register(name)(getattr(tasks, name))


_built_in()
