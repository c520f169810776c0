"""Clusters of a run to lasting opportunities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oppsift.checkpoints import measured, removed, written
from oppsift.functions import text as T
from oppsift.functions.similarity import common_sizes, ratio_bounds, set_lengths, token_ids, tokens
from oppsift.operators.duplicates import LENGTH_RATIO, SAME_FUZZY, by_turns, evidence, length_ratio, shingle_pairs, times

#: A text's characters are counted with a space for each word. If the words that it shares give a ratio f by themselves, those it
#: lacks are own <= (1 - f) * (2 * shared + own), which is at most this part of it.
MAY_LACK = 2 * (1 - SAME_FUZZY / 100) / (2 - SAME_FUZZY / 100)

#: So much of each text, in its rarest words, is looked for in the others.
LOOKED_FOR = 0.45

#: So many meetings of words, at most, are put together at a time, and in so many turns at most.
MEETINGS, MOST_TURNS = 20_000_000, 64

NAMES = ["key", "canonical_url", "content_hash", "normalized_text", "shingles", "entities", "words"]


def comparable(clusters: DataFrame) -> DataFrame:
    """Clusters (cluster_id, rep) as what ``duplicates.evidence`` compares; text hashes don't count across runs."""
    body = F.coalesce(F.nullif("rep.text", F.lit("")), F.col("rep.title"), F.lit(""))
    norm = F.coalesce(F.col("rep.normalized_text"), F.lit(""))
    return clusters.select(
        F.col("cluster_id").alias("key"), F.col("rep.canonical_url").alias("canonical_url"), F.lit(None).cast("string").alias("content_hash"), norm.alias("normalized_text"),
        T.shingle_ids(norm).alias("shingles"), T.entities(body).alias("entities"), F.size(T.words(norm)).alias("words"),
    )


def stored(opportunities: DataFrame) -> DataFrame:
    """Opportunities (opportunity_id, representative_text, representative_url, entities) in the same form."""
    norm = F.coalesce("representative_text", F.lit(""))
    return opportunities.select(
        F.col("opportunity_id").alias("key"), F.nullif("representative_url", F.lit("")).alias("canonical_url"), F.lit(None).cast("string").alias("content_hash"), norm.alias("normalized_text"),
        T.shingle_ids(norm).alias("shingles"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), F.size(T.words(norm)).alias("words"),
    )


def _rare_words(side: DataFrame, often: DataFrame) -> DataFrame:
    """(key, word, weight, df, least): the rarest words of each row, LOOKED_FOR of it, how many rows have each, and how much of them a like
    text shares."""
    flat = side.select("key", F.explode(F.array_distinct(T.words(F.col("normalized_text")))).alias("word")).withColumn("weight", F.length("word") + 1)
    mine = W.partitionBy("key")
    flat = flat.join(often, "word").withColumn("before", F.coalesce(F.sum("weight").over(mine.orderBy("df", "word").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rare = flat.withColumn("all", F.sum("weight").over(mine)).where(F.col("before") <= LOOKED_FOR * F.col("all"))
    return rare.select("key", "word", "weight", "df", (F.sum("weight").over(mine) - MAY_LACK * F.col("all")).alias("least"))


def word_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of rows that may reach the fuzzy rule by the words they share.

    If the words of one text are all in the other's, or all but so few that the ratio is reached by the common words, the other
    lacks at most MAY_LACK of it; so of its rarest words, LOOKED_FOR of it, the other has the rest. These words meet all words of the
    other side, both ways round, and pairs that share enough of them are kept if their bounds leave the rule open.
    """
    with_tokens = [s.select("key", "normalized_text", "words", tokens(F.col("normalized_text")).alias("tokens")) for s in (left, right)]
    sides, rows = {}, 0
    for n, s in zip("ab", with_tokens, strict=True):
        sides[n], seen = measured(s.withColumns({"ids": token_ids(F.col("tokens")), "size": set_lengths(F.col("tokens"))}).drop("tokens"), "words", n=F.count("*"))
        rows += seen["n"]
    every = {n: s.select("key", F.explode(F.array_distinct(T.words(F.col("normalized_text")))).alias("word")) for n, s in sides.items()}
    often = written(every["a"].unionByName(every["b"]).groupBy("word").agg(F.count("*").alias("df")), "often")
    found = []
    for n, m in (("a", "b"), ("b", "a")):
        # a word of one side meets all rows of the other that have it: for some ranges of keys at a time
        rare, met = measured(_rare_words(sides[n], often), "rare", n=F.sum("df"))
        turns = max(1, min(MOST_TURNS, -(-(met["n"] or 0) // MEETINGS)))
        other = every[m].withColumnRenamed("key", m)
        for k in range(turns):
            some = rare.where(F.pmod(F.xxhash64("key"), F.lit(turns)) == k) if turns > 1 else rare
            shared = some.withColumnRenamed("key", n).join(other, "word").groupBy("a", "b").agg(F.sum("weight").alias("shared"), F.max("least").alias("least"))
            found.append(written(shared.where(F.col("shared") >= F.col("least") - 1e-6).select("a", "b"), "met"))
        removed(rare)
    pairs, n = measured(reduce(DataFrame.unionByName, found).distinct(), "word-pairs", n=F.count("*"))
    removed(*found)

    def reaching(both: DataFrame) -> DataFrame:
        both = both.where(length_ratio(F.col("n"), F.col("m")) >= LENGTH_RATIO).withColumn("common", common_sizes(F.col("x"), F.col("y")))
        # words too long for their ids leave it open
        return both.where(F.coalesce(ratio_bounds(F.col("x_size"), F.col("y_size"), F.col("common.n"), F.col("common.chars"))[1] >= SAME_FUZZY, F.lit(True))).select("a", "b")

    mine, other = (sides[k].select(F.col("key").alias(k), F.col("ids").alias(x), F.col("size").alias(f"{x}_size"), F.col("words").alias(w)) for k, x, w in (("a", "x", "n"), ("b", "y", "m")))
    out, _ = by_turns(pairs, mine, other, times(n["n"], rows), reaching, "reaching", F.count("*"))
    removed(pairs, often, *sides.values())
    return out


def cross_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): rows of left with those of right that share a URL, enough shingles, two entities, or the words that the fuzzy
    rule needs; keys of both sides differ. (One shared entity alone decides nothing.)"""
    url = left.where("canonical_url is not null").select(F.col("key").alias("a"), "canonical_url").join(right.select(F.col("key").alias("b"), "canonical_url"), "canonical_url").select("a", "b")
    both = left.select(F.concat(F.lit("n:"), "key").alias("key"), "shingles").unionByName(right.select(F.concat(F.lit("s:"), "key").alias("key"), "shingles"))
    plain = [F.expr(f"substring({c}, 3)").alias(c) for c in ("a", "b")]
    near = shingle_pairs(both).where("a like 'n:%' and b like 's:%'").select(*plain)
    return url.unionByName(near).unionByName(word_pairs(left, right)).distinct()


def new_id(root: str = "cluster_id"):
    return F.substring(F.sha2(F.concat_ws("|", "run_id", root), 256), 1, 16)


def leaders(pairs: DataFrame, rounds: int = 1000) -> DataFrame:
    """(key, leader): in ascending order each key follows the smallest earlier leader that it is paired with, or leads.

    pairs: (a, b), a < b. Each round settles every key whose earlier neighbours are settled, all at once, so rounds follow the
    longest chain of dependence, not the number of keys.
    """
    edges = written(pairs.select("a", "b").distinct(), "leaders")
    keys = edges.select(F.col("a").alias("key")).union(edges.select("b")).distinct()
    known = written(keys.join(edges.select(F.col("b").alias("key")), "key", "left_anti").withColumn("leader", F.col("key")), "leaders")
    total, before = keys.count(), 0
    for _ in range(rounds):
        n = known.count()
        if n == total:
            return known
        if n == before:
            raise RuntimeError("leaders did not settle")
        before = n
        waiting = edges.join(known.select(F.col("key").alias("b")), "b", "left_anti")
        state = waiting.join(known.select(F.col("key").alias("a"), "leader"), "a", "left")
        ready = state.groupBy("b").agg(F.max(F.col("leader").isNull()).alias("open"), F.min(F.when(F.col("leader") == F.col("a"), F.col("a"))).alias("first"))
        # a known earlier leader settles a key only if no open earlier neighbour is before it
        first_open = state.where("leader is null").groupBy("b").agg(F.min("a").alias("first_open"))
        ready = ready.join(first_open, "b", "left").where("not open or first < first_open")
        known = written(known.unionByName(ready.select(F.col("b").alias("key"), F.coalesce("first", "b").alias("leader"))), "leaders")
    raise RuntimeError("leaders did not settle")


def resolve(clusters: DataFrame, opportunities: DataFrame, run_id: str) -> DataFrame:
    """(cluster_id, opportunity_id, is_new): the stored opportunity a cluster belongs to, the first by first_seen and id; else
    the one that an earlier cluster of this run founded; else a new one, whose id follows from run and cluster.
    """
    fresh, old = written(comparable(clusters), "fresh"), written(stored(opportunities), "stored")
    matched = evidence(cross_pairs(fresh, old), fresh, old).where("is_duplicate").select(F.col("a").alias("cluster_id"), F.col("b").alias("opportunity_id"))
    ranked = matched.join(opportunities.select("opportunity_id", "first_seen"), "opportunity_id")
    first = ranked.withColumn("n", F.row_number().over(W.partitionBy("cluster_id").orderBy("first_seen", "opportunity_id"))).where("n = 1")
    first = written(first.select("cluster_id", "opportunity_id"), "matched")
    rest = written(fresh.join(first.select(F.col("cluster_id").alias("key")), "key", "left_anti"), "rest")
    twin = rest.select([F.col(c) for c in NAMES])
    among = evidence(cross_pairs(rest, twin).where("a < b"), rest, twin).where("is_duplicate").select("a", "b")
    lead = leaders(among)
    founded = rest.select(F.col("key").alias("cluster_id")).join(lead.withColumnsRenamed({"key": "cluster_id"}), "cluster_id", "left")
    founded = founded.select("cluster_id", F.coalesce("leader", "cluster_id").alias("leader"), F.lit(run_id).alias("run_id"))
    founded = founded.select("cluster_id", new_id("leader").alias("opportunity_id"), F.lit(True).alias("is_new"))
    return first.withColumn("is_new", F.lit(False)).unionByName(founded)
