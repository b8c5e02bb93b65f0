"""Personal data with built-in functions only: patterns propose spans, checksums confirm them, context sets the score.

Positions come from the two halves of a pattern's matches: regexp_extract_all gives what matched, split what lies between,
and running sums of their lengths (in code points) give where. Matches of a kind are leftmost and do not overlap.

The four base kinds (email, ip, card, phone) are reported whenever their validator accepts them. The further kinds (iban,
short_card, national_id, access_key) are reported where their score, raised by a context word nearby, reaches the
threshold. Null and empty texts hold no spans. Everything is row by row: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column, low: int, high: int) -> Column:
    d = digits(match)
    return F.length(d).between(low, high) & F.call_function("luhn_check", d)


def mod97(match: Column) -> Column:
    """The IBAN checksum: four leading characters to the end, letters as 10 to 35, remainder 1."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    step = lambda acc, c: F.when(F.ascii(c) >= 65, acc * 100 + F.ascii(c) - 55).otherwise(acc * 10 + F.ascii(c) - 48) % 97
    return F.length(plain).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1)


@dataclass(frozen=True)
class Kind:
    """pattern: proposes; gate: a cheaper one that any match implies; check: confirms; score, context: see spans()."""

    name: str
    pattern: str
    gate: str | None
    check: Callable[[Column], Column] | None
    score: float
    context: str
    base: bool = True


#: Possessive quantifiers and look-behinds only spare the matcher hopeless retries; they match what the plain forms match.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", None, 0.8, "mail|contact|write to"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", None, lambda m: m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"), 0.6, "ip|address|host|server"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){15}(?:[ -]?[0-9])*+", None, lambda m: luhn(m, 16, 19), 0.7, "card|visa|credit|payment|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", lambda m: F.length(digits(m)).between(8, 15), 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None, mod97, 0.8, "iban|bank|account|konto|compte|cuenta", False),
    Kind("short_card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}(?![ -]?[0-9])", None, lambda m: luhn(m, 13, 15), 0.3, "card|amex|credit|payment|karte|carte|tarjeta", False),
    Kind("national_id", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", None, 0.3, "ssn|social security|tax id|national id", False),
    Kind("access_key", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", "AKIA", None, 0.8, "key|secret|token", False),
)
CONTEXT_BEFORE, CONTEXT_AFTER, CONTEXT_BONUS, THRESHOLD, STEP = 40, 20, 0.3, 0.5, 128


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, match>> of the pattern's matches, in code points, stop exclusive."""
    plus = lambda a, b: a + b

    def place(found: Column) -> Column:
        m, gaps = found["m"], found["gaps"]
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: F.length(g) + F.length(x))
        return let(F.struct(m.alias("m"), gaps.alias("gaps"), sizes.alias("sizes")), lambda v: let(F.struct(v["m"].alias("m"), v["gaps"].alias("gaps"), v["sizes"].alias("sizes"), sums(v).alias("sums")), spans_of))

    def sums(v: Column) -> Column:  # of all sizes before each STEP-th, so that a text with many matches stays cheap
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v["m"]) - 1) / STEP).cast("int")), lambda b: F.aggregate(F.slice(v["sizes"], F.lit(1), b * STEP), F.lit(0), plus))

    def spans_of(v: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            b = F.floor(i / STEP).cast("int")
            start = F.element_at(v["sums"], b + 1) + F.aggregate(F.slice(v["sizes"], b * STEP + 1, i % STEP), F.lit(0), plus) + F.length(F.element_at(v["gaps"], i + 1))
            return let(start, lambda s: F.struct(s.alias("start"), (s + F.length(x)).alias("stop"), x.alias("match")))

        return F.transform(v["m"], one)

    none = F.array().cast("array<struct<start:int,stop:int,match:string>>")
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), let(found, place)).otherwise(none)


def spans_of_kind(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, stop, score>> of one kind."""

    def scored(x: Column) -> Column:
        begin = F.greatest(x["start"] - CONTEXT_BEFORE, F.lit(0))
        near = F.concat(F.substr(text, begin + 1, x["start"] - begin), F.lit(" "), F.substr(text, x["stop"] + 1, F.lit(CONTEXT_AFTER)))
        bonus = F.when(F.lower(near).rlike(rf"(?<![a-z])(?:{kind.context})"), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), (F.lit(kind.score) + bonus).alias("score"))

    found = located(text, kind.pattern)
    if kind.check:
        found = F.filter(found, lambda x: kind.check(x["match"]))
    found = F.transform(found, scored)
    if not kind.base:
        found = F.filter(found, lambda x: x["score"] >= THRESHOLD)
    none = F.array().cast("array<struct<kind:string,start:int,stop:int,score:double>>")
    return F.when(F.contains(text, F.lit(kind.gate)), found).otherwise(none) if kind.gate else found


def find(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs plus `out`, array<struct<kind, start, stop, score>>: by kind as in KINDS, then by start. A column of that name
    is replaced; other columns, null ids and repeated rows go through as they are."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(out, F.concat(*(spans_of_kind(body, k) for k in KINDS)))


def listed(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans as text, of find()'s result."""
    base = [k.name for k in KINDS if k.base]

    def of(*kinds: str) -> Column:
        return F.filter("pii", lambda x: x["kind"].isin(*kinds))

    count = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *count, F.sha2(listed(of(*base)), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def redact(found: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """found with its spans replaced in the text by <KIND>; of spans that overlap the union goes, under the name of the one
    that starts first (ties: the longer). Texts without spans are left as they are."""
    body = F.col(text)
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("back"), x["stop"].alias("stop"), x["kind"].alias("kind"))))

    def step(acc: Column, x: Column) -> Column:
        grown = F.struct(F.concat(acc["done"], F.array(F.substr(body, acc["at"] + 1, x["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))).alias("done"), x["stop"].alias("at"))
        return F.when(x["start"] >= acc["at"], grown).otherwise(F.struct(acc["done"].alias("done"), F.greatest(acc["at"], x["stop"]).alias("at")))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(0).alias("at"))
    end = lambda acc: F.concat(F.array_join(acc["done"], ""), F.substr(body, acc["at"] + 1))
    return found.withColumn(text, F.when(F.size(spans) > 0, F.aggregate(ordered, start, step, end)).otherwise(body))
