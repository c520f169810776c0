"""Cleaning, shingles and entities of texts."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from oppsift.functions.lexicon import CAPITALISED, MONEY_ENTITY, any_case

URL = r"https?://\S+"
MENTION = r"@[\p{L}\p{N}_]+"
PUNCTUATION = r"[^\p{L}\p{N}_\s]"
TAG = r"<[^>]+>"


def _resolved(text: str | None) -> str | None:
    if text is None:
        return None
    if "&" in text:
        text = html.unescape(text)
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


@F.arrow_udf(StringType())
def unescaped(text: pa.Array) -> pa.Array:
    """HTML entities resolved, then NFKC; Spark has neither (and Arrow's own NFKC leaves characters taken apart). Texts of
    ASCII characters without an ampersand, which stay as they are, aren't taken out of their buffers."""
    plain = pc.and_(pc.string_is_ascii(text), pc.invert(pc.match_substring(text, "&")))
    if pc.all(plain).as_py() is not False:
        return text
    odd = pc.invert(pc.fill_null(plain, True))
    return pc.replace_with_mask(text, odd, pa.array([_resolved(t) for t in text.filter(odd).to_pylist()], text.type))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def clean_text(text: Column) -> Column:
    """Entities resolved, NFKC, white space squeezed and trimmed; null becomes empty."""
    return squeezed(F.coalesce(unescaped(text), F.lit("")))


def dedup_text(cleaned: Column) -> Column:
    """A cleaned text without URLs, mentions, case and punctuation, in this order."""
    text = F.regexp_replace(F.regexp_replace(cleaned, URL, " "), MENTION, " ")
    return squeezed(F.regexp_replace(F.lower(text), PUNCTUATION, " "))


def strip_tags(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, TAG, " "), F.lit(""))


def words(normalised: Column) -> Column:
    return F.filter(F.split(normalised, " "), lambda w: w != "")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value found once: within a lambda an expression would be found again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _runs(normalised: Column, join: Callable[..., Column], empty: str, k: int) -> Column:
    """join(...) of each run of k words, distinct; of all words if there are fewer; nothing of none."""

    def runs(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: join(*(F.get(w, i + j) for j in range(k))))
        short = F.when(F.size(w) > 0, F.array(join(F.array_join(w, " ")))).otherwise(F.array().cast(empty))
        return F.when(F.size(w) >= k, F.array_distinct(every)).otherwise(short)

    return bound(words(normalised), runs)


def shingles(normalised: Column, k: int = 3) -> Column:
    """The distinct runs of k words; the whole text if it has fewer; none of an empty one."""
    return _runs(normalised, lambda *w: F.concat_ws(" ", *w), "array<string>", k)


def shingle_ids(normalised: Column, k: int = 3) -> Column:
    """64-bit hashes in place of the shingles: what sets are compared by."""
    return _runs(normalised, F.xxhash64, "array<bigint>", k)


def entities(text: Column) -> Column:
    """Amounts (without spaces), capitalised phrases of up to three words and over three characters, and hashtags, in lower case, distinct, sorted."""
    text = F.coalesce(text, F.lit(""))
    money = F.transform(F.regexp_extract_all(text, F.lit(any_case(MONEY_ENTITY)), F.lit(0)), lambda m: F.regexp_replace(F.lower(m), " ", ""))
    phrases = F.transform(F.filter(F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(0)), lambda p: F.length(p) > 3), lambda p: F.lower(p))
    hashtags = F.transform(F.regexp_extract_all(text, F.lit(r"#[\p{L}\p{N}_]+"), F.lit(0)), lambda h: F.lower(h))
    return F.array_sort(F.array_distinct(F.concat(money, phrases, hashtags)))


def minhash(items: Column, permutations: int = 128) -> Column:
    """A signature: for each seed the smallest hash of the items; null without items."""
    seeds = F.sequence(F.lit(0), F.lit(permutations - 1))
    return F.when(F.size(items) > 0, F.transform(seeds, lambda s: F.array_min(F.transform(items, lambda x: F.xxhash64(s, x)))))


def signature_similarity(a: Column, b: Column) -> Column:
    """The share of equal places of two signatures; 0 if one is missing."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.coalesce(equal / F.size(a), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def snippet(text: Column, width: int = 90) -> Column:
    one_line = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "\n", " ")
    return F.when(F.length(one_line) > width, F.concat(F.rtrim(F.substring(one_line, 1, width - 1)), F.lit("…"))).otherwise(one_line)
