"""Column functions over text. What Spark's functions cannot say exactly is an Arrow-batched pandas UDF."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from quill.functions.batches import by_slices

#: What separates search tokens, beside white space.
TOKEN_BREAKS = r"""\s,;!?()\[\]{}"'<>"""
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _each(form, text: pa.Array) -> pa.Array:
    return by_slices(lambda t: None if t is None else form(t), pa.string(), text)


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """NFKC, with runs of white space as one space."""
    return _each(lambda t: " ".join(unicodedata.normalize("NFKC", t).split()), text)


@F.arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """NFC, with runs of white space as one space."""
    return _each(lambda t: " ".join(unicodedata.normalize("NFC", t).split()), text)


@F.arrow_udf(StringType())
def folded(text: pa.Array) -> pa.Array:
    """NFC, white space collapsed, case folded."""
    return _each(lambda t: " ".join(unicodedata.normalize("NFC", t).split()).casefold(), text)


@F.arrow_udf(StringType())
def unaccented(text: pa.Array) -> pa.Array:
    """Words of [a-z0-9] after NFKD without combining marks; the stroked d counts as d."""

    def plain(t: str) -> str:
        bare = "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c))
        return " ".join(re.findall("[a-z0-9]+", bare.replace("đ", "d")))

    return _each(plain, text)


@F.pandas_udf(IntegerType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance over words."""

    def distance(x: list[str], y: list[str]) -> int:
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, q in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
        return row[-1]

    return pd.Series([distance((x or "").split(), (y or "").split()) for x, y in zip(a, b, strict=True)])


def tokens(text: Column) -> Column:
    """Search tokens in lower case; keeps c++, /api/v1 and skip_locked whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([^{TOKEN_BREAKS}]+)"), 1)


def words(text: Column) -> Column:
    """ASCII words in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)


def answer_key(text: Column) -> Column:
    """Accepted answers compare trimmed, collapsed and in lower case; marks stay."""
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def bare_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)[^\w]", "")


def redacted(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "[EMAIL]")


def char_grams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams of characters; a shorter text is its own gram."""
    return F.when(F.length(text) < n, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))))


def masked_shingles(text: Column, n: int = 5) -> Column:
    """Character shingles with runs of digits as #."""
    return char_grams(F.regexp_replace(F.lower(text), r"\d+", "#"), n)


def _shifted(split: Column, n: int, one) -> Column:
    """Distinct values of ``one`` over the runs of n words. Shifted slices are zipped: a lambda over positions would compute ``split`` anew for each of them."""
    m = F.greatest(F.size(split) - n + 1, F.lit(0))
    zipped = F.arrays_zip(*(F.slice(split, k + 1, m).alias(str(k)) for k in range(n)))
    return F.array_distinct(F.transform(zipped, lambda x: one(*(x[str(k)] for k in range(n)))))


def word_shingles(split: Column, n: int) -> Column:
    """Distinct n-word shingles of an array of words; none if it is shorter."""
    return _shifted(split, n, lambda *words: F.concat_ws(" ", *words))


def shingle_hashes(split: Column, n: int) -> Column:
    """The same as 64-bit hashes, without the texts of shingles."""
    return _shifted(split, n, F.xxhash64)


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two sets as arrays; ``empty`` is the value for two empty sets."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(float(empty))).otherwise(both / either)


def cer(reference: Column, prediction: Column) -> Column:
    """Character error rate; null for an empty reference, 1 for a missing prediction."""
    return F.when(F.length(reference) == 0, None).when(prediction.isNull(), 1.0).otherwise(F.levenshtein(reference, prediction) / F.length(reference))


def wer(reference: Column, prediction: Column) -> Column:
    n = F.size(F.filter(F.split(reference, r"\s+"), lambda w: w != ""))
    return F.when(n == 0, None).when(prediction.isNull(), 1.0).otherwise(word_distance(reference, prediction) / n)


def corruption(text: Column) -> Column:
    """Names of what looks broken: replacement characters, private use, controls, mojibake."""
    checks = {"replacement": r"\x{FFFD}", "private_use": r"[\x{E000}-\x{F8FF}]", "control": r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "mojibake": "Ã[\u0080-¿]|â€"}
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in checks.items())))


def numbers(text: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1))


def operators(text: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"([+*/=<>^-])"), 1))


def brace_balance(text: Column) -> Column:
    """0 if braces close in order, else how many stay open, or -1 if one closes too early."""
    step = lambda acc, c: F.when(acc < 0, acc).otherwise(acc + F.when(c == "{", 1).when(c == "}", -1).otherwise(0))
    return F.aggregate(F.regexp_extract_all(text, F.lit(r"([{}])"), 1), F.lit(0), step)


def templated_path(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "{id}")


def listed(text: Column, mark: str) -> Column:
    """Parts between marks, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, mark), lambda x: F.trim(x)), lambda x: x != "")


def math_field(field: Column) -> Column:
    """field, warning: a field with LaTeX in it that is one short formula is put between dollars; what is in doubt stays and is marked."""
    bare = F.trim(field)
    some = F.coalesce(bare.rlike(r"\\[A-Za-z]+|[_^]\{"), F.lit(False))
    sound = (brace_balance(bare) == 0) & (F.size(F.regexp_extract_all(bare, F.lit(r"((?<!\\)\$)"), 1)) % 2 == 0)
    marked = bare.contains("$") | bare.contains("\\(") | bare.contains("\\[")
    formula = bare.rlike("[=<>±×÷]") & (F.size(F.split(bare, r"\s+")) <= 12)
    shown = F.when(some & sound & ~marked & formula, F.concat(F.lit("$"), bare, F.lit("$"))).otherwise(field)
    return F.struct(shown.alias("field"), F.when(some & (~sound | ~marked & ~formula), "MATH_FORMAT_UNVERIFIED").alias("warning"))
