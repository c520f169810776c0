"""URL filter: rules by host and path, else logistic regression on hashed character 3-grams of host and path.

All of it is column expressions. The model is trained on the small table LABELLED when first needed; its weights are whole
numbers, so that any engine adds them up to the same sum.
"""

from __future__ import annotations

import math
import string
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, SCALE = 4096, 1_000_000

#: (verdict, host, path): the longest that fits wins.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

# The training table, URLs that a crawl should leave out (1) and ordinary ones (0).
LABELLED = [
    ("http://www.cheap-pills.example.com/buy/now", 1), ("https://cheap-pills.example.org/en/12", 1), ("http://cheap-meds.example.net/pharmacy/offer", 1), ("https://pills-online.example.org/viagra/discount", 1),
    ("https://spam-farm.example.org/en/728", 1), ("http://spam-farm.example.net/fr/9", 1), ("https://m.spam-farm.example.org/de/31.html", 1), ("http://link-farm.example.org/links/page", 1),
    ("https://casino-royal.example.net/slots/win", 1), ("http://free-casino.example.org/bonus/spin", 1), ("https://poker-bonus.example.com/casino/play", 1), ("http://bet-now.example.net/sports/bet", 1),
    ("http://win-prize.example.org/claim/prize", 1), ("https://free-iphone.example.net/winner/claim", 1), ("http://click-bait.example.org/you-wont-believe", 1), ("https://adult-cams.example.net/xxx/live", 1),
    ("http://xxx-videos.example.org/porn/hot", 1), ("https://payday-loans.example.com/fast-cash", 1), ("http://crypto-doubler.example.net/invest/profit", 1), ("https://replica-watches.example.org/rolex/cheap", 1),
    ("http://warez-cracks.example.net/keygen/download", 1), ("https://malware-host.example.org/setup/exe", 1), ("http://seo-links.example.com/buy/backlinks", 1), ("https://doorway-pages.example.net/spam/index", 1),
    ("https://www.library.example.org/catalogue/books", 0), ("http://news.example.org/2024/05/local", 0), ("https://docs.example.net/guide/install", 0), ("https://blog.garden.example.org/en/853/", 0),
    ("http://museum.example.org/de/exhibits", 0), ("https://university.example.net/research/papers", 0), ("https://m.weather.example.org/en/today", 0), ("http://www.recipes.example.net/de/soup.html", 0),
    ("https://theatre.example.org/en/685", 0), ("http://river.example.net/en/770", 0), ("https://history.example.org/fr/474.html", 0), ("https://blog.science.example.net/en/960", 0),
    ("http://mathematics.example.org/es/533/", 0), ("https://www.hospital.example.org/contact", 0), ("https://city-council.example.net/minutes/2023", 0), ("http://school.example.org/timetable", 0),
    ("https://m.tintin.example.net/en/25", 0), ("https://thorne.example.org/en/148.html", 0), ("http://www.hearth.example.net/de/101", 0), ("https://thunder.example.org/de/671", 0),
    ("https://forum.example.org/thread/1234", 0), ("http://wiki.example.net/page/history", 0), ("https://code.example.org/project/readme", 0), ("https://travel.example.net/fr/paris", 0),
]


def grams(text: str) -> list[int]:
    """The buckets of the 3-grams of a text, as ``score_column`` has them."""
    codes = [ord(c) for c in text]
    return [(a * 961 + b * 31 + c) % BUCKETS for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)]


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    path = rest[end:]
    stop = min((k for k in map(path.find, "?#") if k >= 0), default=len(path))
    return rest[:end].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), path[:stop]


def marked(host: str, path: str) -> str:
    return f"^{host}{path}$"


@lru_cache(maxsize=4)
def train(table: tuple[tuple[str, int], ...] = tuple(LABELLED), steps: int = 400, rate: float = 8.0, ridge: float = 1e-3) -> tuple[int, tuple[int, ...]]:
    """(constant, weights of the buckets), times SCALE, for the mean of the weights over a text's 3-grams."""
    rows = []
    for url, label in table:
        found = grams(marked(*parts(url)))
        rows.append((found, 1 / max(1, len(found)), label))
    w, bias = {g: 0.0 for found, _, _ in rows for g in found}, 0.0
    for _ in range(steps):
        slope, shift = {g: ridge * v for g, v in w.items()}, 0.0
        for found, share, label in rows:
            error = (1 / (1 + math.exp(-bias - share * sum(w[g] for g in found))) - label) / len(rows)
            shift += error
            for g in found:
                slope[g] += error * share
        bias -= rate * 0.05 * shift
        for g, v in slope.items():
            w[g] -= rate * 10 * v
    return round(bias * SCALE), tuple(round(w.get(g, 0.0) * SCALE) for g in range(BUCKETS))


def host_column(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, with A-Z in lower case; empty for null or without "://"."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_column(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The (verdict, rule) that fits the host or a domain above it and starts the path; the longest, or null."""
    found = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(domain + start).alias("rule"))).otherwise(found)
    return found


def score_column(text: Column, model: tuple[int, tuple[int, ...]]) -> Column:
    """Over 0 for a text to block: the sum of the weights of its 3-grams and the constant for each."""
    bias, weights = model
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    n = F.greatest(F.length(text) - 2, F.lit(0))

    def weight(k: Column) -> Column:
        a, b, c = (F.ascii(F.substring(text, k + d, F.lit(1))) for d in range(3))
        return F.get(table, (a * 961 + b * 31 + c) % BUCKETS)

    each = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), weight)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(each, F.lit(0).cast("bigint"), lambda s, x: s + x) + n * F.lit(bias).cast("bigint")


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, model: tuple[int, tuple[int, ...]] | None = None) -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict.

    A null or empty url, or one without "://", has an empty host and path, no rule, and the model's verdict for an empty
    text, which is "allow". Repeated rows are judged alike; an empty table gives an empty result; other columns are
    ignored. Rules are a short list that becomes one expression.
    """
    model = model or train()
    out = pages.select("page_id", host_column(F.col("url")).alias("host"), path_column(F.col("url")).alias("path"))
    out = out.withColumn("found", rule_column(F.col("host"), F.col("path"), rules))
    method = F.when(score_column(F.concat(F.lit("^"), "host", "path", F.lit("$")), model) > 0, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), method).alias("verdict"))


def oracle_sql() -> str:
    """The same by DuckDB, with the default rules and model."""
    bias, weights = train()
    cases = "".join(
        f" WHEN (host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}') THEN {{'verdict': '{v}', 'rule': '{d}{p}'}}" for v, d, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    gram = " + ".join(f"unicode(substr(s, i + {d}, 1)) * {m}" for d, m in ((0, 961), (1, 31), (2, 1)))
    return rf"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT *, concat('^', host, path, '$') AS s, CASE{cases} END AS found FROM p),
m AS (SELECT {list(weights)}::BIGINT[] AS w),
g AS (SELECT f.*, coalesce(list_sum([w[({gram}) % {BUCKETS} + 1] FOR i IN range(1, length(s) - 1)]), 0) + greatest(length(s) - 2, 0) * {bias} AS score FROM f, m)
SELECT page_id, host, path, found.rule AS rule, coalesce(found.verdict, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM g
"""
