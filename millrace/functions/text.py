"""Column functions over texts. Patterns name Unicode classes outright, so that other engines read them alike."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORD = r"[\p{L}\p{N}_]+"
EMPTY = "array<string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once. Inside a lambda a plain column would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column, part: int = 64) -> Column:
    """The sums of an array's elements up to each of them. Sums of parts come first, so that no element adds up all before;
    elements are taken one by one, as slice() copies the whole array."""

    def total(x: Column, low: Column, high: Column) -> Column:
        return F.when(low > high, F.lit(0)).otherwise(F.aggregate(F.sequence(low, high), F.lit(0), lambda s, k: s + F.get(x, k)))

    def of(x: Column) -> Column:
        last = F.size(x) - 1
        begin = lambda i: F.floor(i / part).cast("int") * part
        sums = F.transform(F.sequence(F.lit(0), F.floor(last / part).cast("int")), lambda k: total(x, k * part, F.least((k + 1) * part - 1, last)))
        before = lambda y: F.transform(y, lambda _, k: total(y, F.lit(0), k - 1))
        return let(let(sums, before), lambda b: F.transform(x, lambda _, i: F.get(b, F.floor(i / part).cast("int")) + total(x, begin(i), i)))

    return F.when(F.size(numbers) > 0, let(numbers.cast("array<int>"), of)).otherwise(F.when(numbers.isNotNull(), F.array().cast("array<int>")))


def find_all(text: Column, pattern: str) -> Column:
    """All matches of a text; none of a null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast(EMPTY))


def split_words(text: Column) -> Column:
    """Words and single other characters."""
    return find_all(text, TOKEN)


def words(text: Column) -> Column:
    return find_all(text, WORD)


def is_word(token: Column) -> Column:
    """Two characters or more, a letter among them."""
    return (F.length(token) >= 2) & token.rlike(r"\p{L}")


def spaced(text: Column) -> Column:
    """White-space separated words."""
    return find_all(text, r"[^ \t\r\n]+")


def lines(text: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(find_all(text, r"[^.!?\n]+[.!?]*"), lambda x: F.trim(x)), lambda x: x != "")


def flatten_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams; none of fewer than n tokens."""

    def every(w: Column) -> Column:
        # Elements one by one: slice() turns the whole array over for every n-gram.
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(n))))
        return F.when(F.size(w) >= n, grams).otherwise(F.array().cast(EMPTY))

    return let(tokens, every)


def uid(source: Column, doc_id: Column) -> Column:
    """source:doc_id, null where the identifier is null or empty."""
    own = F.nullif(doc_id.cast("string"), F.lit(""))
    return F.when(own.isNotNull(), F.concat_ws(":", source, own))


def host(url: Column) -> Column:
    """Host of a URL in lower case, null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_suffixes(name: Column) -> Column:
    """The host and each of its parents of at least two labels."""
    parts = F.split(name, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(F.size(parts) >= 2, every).otherwise(F.array().cast(EMPTY))


def coerce_bool(value: Column) -> Column:
    """true, yes, y, 1 and false, no, n, 0 in any case; numbers by their whole part; else null."""
    low = F.lower(F.trim(value.cast("string")))
    number = low.try_cast("double")
    return F.when(low.isin("true", "yes", "y"), True).when(low.isin("false", "no", "n"), False).when(number.isNotNull(), F.abs(number) >= 1)


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """A bucket from the first 32 bits of SHA-256."""
    return (F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def blake_bucket(key: Column) -> Column:
    """A bucket of 100 from the first 32 bits of BLAKE2s, which Spark doesn't have: in Arrow batches."""

    @F.pandas_udf("int")
    def bucket(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: int.from_bytes(hashlib.blake2s(k.encode()).digest()[:4], "big") % 100)

    return bucket(F.coalesce(key.cast("string"), F.lit("")))


def split_of(bucket: Column, train: int = 70, validation: int = 15) -> Column:
    return F.when(bucket < train, "train").when(bucket < train + validation, "validation").otherwise("test")
