"""Extracted records to corpus records, and what identifies them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.records import first_of

#: Names of a corpus record that metadata may not take.
RESERVED = ("text", "id", "dataset", "domain", "doc_id", "annotations")


def convert(rows: DataFrame, text_field: str = "text", id_field: str = "doc_id", keep: Sequence[str] = ("domain", "doc_id"), metadata: Sequence[str] = ()) -> DataFrame:
    """rows (uid, source, text_field, ...) -> text, id, dataset, the kept fields and, flattened, entries of the map `metadata`.

    dataset is source. id_field is always kept, source never. A metadata entry of a reserved or kept name becomes
    meta_<name>. Raises, when run, at a row without uid or (null) text.
    """
    fields = [f for f in dict.fromkeys([*keep, id_field]) if f in rows.columns and f not in ("id", "source", text_field)]
    name = lambda k: f"meta_{k}" if k in RESERVED or k in fields else k
    uid, text = F.nullif(F.col("uid").cast("string"), F.lit("")), F.col(f"`{text_field}`")
    must = lambda c, what: F.when(c.isNotNull(), c).otherwise(F.raise_error(F.concat(F.lit(f"record without {what} from "), F.coalesce("source", F.lit("<unknown>")))))
    flat = [F.try_element_at("metadata", F.lit(k)).alias(name(k)) for k in metadata]
    notes = ["annotations"] if "annotations" in rows.columns else []
    return rows.select(must(text, "text").alias("text"), must(uid, "uid").alias("id"), F.coalesce("source", F.lit("<unknown>")).alias("dataset"), *(F.col(f"`{f}`") for f in fields), *flat, *notes)


def probe_doc_id(rows: DataFrame, candidates: Sequence[str]) -> Column:
    """The first of these fields that is there and, as a string, neither null nor empty."""
    return first_of([F.col(f"`{c}`") for c in candidates if c in rows.columns])


def numbered_ids(rows: DataFrame, own: Column, place: Column) -> DataFrame:
    """rows plus id: own, else idx-<eight digits of place>, the row's number in its source."""
    return rows.withColumn("id", F.coalesce(F.nullif(own.cast("string"), F.lit("")), F.concat(F.lit("idx-"), F.lpad(place.cast("string"), 8, "0"))))


def iso8601(at: Column) -> Column:
    """A timestamp in ISO 8601; fractions of a second as six digits, only if there are any."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(at, "SSSSSS") == "000000", whole).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def run_key(key: Column) -> Column:
    """struct of tokenizer and vocab of a key <tokenizer>-<vocab>, cut at the last hyphen; null for others."""
    part = lambda i: F.regexp_extract(key, r"^(.+)-(\d+)$", i)
    return F.when(key.rlike(r"^(.+)-(\d+)$"), F.struct(part(1).alias("tokenizer"), part(2).cast("long").alias("vocab")))


def human_bytes(n: Column) -> Column:
    """A byte count in the largest binary unit that leaves it at 1 or more, with one decimal (half to even) but for bytes."""
    units = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]
    power = F.least(F.greatest(F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) / 10), F.lit(0)), F.lit(6)).cast("int")
    # The logarithm may be a whole number too high or low next to a power.
    power = F.when(F.pow(F.lit(1024.0), power) > n, F.greatest(power - 1, F.lit(0))).otherwise(power)
    scaled = F.format_string("%.1f", F.bround(n / F.pow(F.lit(1024.0), power), 1))
    return F.concat_ws(" ", F.when(power == 0, n.cast("long").cast("string")).otherwise(scaled), F.get(F.array(*map(F.lit, units)), power))


def with_values(metadata: Column, value_transform: Callable[[Column, Column], Column]) -> Column:
    """A map's values transformed by (key, value); those that become null go."""
    return F.map_filter(F.transform_values(metadata, value_transform), lambda _, v: v.isNotNull())
