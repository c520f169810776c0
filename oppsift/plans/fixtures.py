"""Views of the star-schema and text tables as signals, and rows that exercise what invented prose does not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oppsift.functions import text as T
from oppsift.functions.scalars import content_hash

AS_OF = "2024-02-01 00:00:00"

# A phrase for each family of the lexicon, put before texts.
PHRASES = [
    "Orbit Labs giveaway: win bonus credits, sign up before the deadline",
    "Nimbus airdrop live, eligible wallets get 250 USDC, apply now",
    "Quarry grant program open, funding round for students, $2,000 prizes",
    "Summer hackathon, $10,000 prizes, registration deadline 12 October 2026 https://summerhack.example.org",
    "Free API access and free GPU trials, early access for beta testers",
    "Referral links pay rewards, invite 3 friends, referral programs open",
    "Enter your seed phrase to claim now",
    "Submit your wallet address, hurry, only 50 spots, airdrop soon",
    "Connect your wallet and drop your address, $MOON giveaway, last chance",
    "Act now: $150,000 guaranteed, details at bit.ly/zz9",
    "Breaking news: the Senate race and the stimulus bill, bonus for workers",
    "Federal Reserve interest rate hike, inflation rate up, election near",
    "Raffle: enter to win, randomly selected winners get rewards and credits",
    "Complete multiple steps, verify KYC, wait 5 days for review, small reward",
    "Just visit and sign up, one click, 40 points",
    "Rain expected later, nothing else to report",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out to all cores if its files come in fewer parts: a small file is one row group, which one task reads."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def phrased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a phrase before each text."""
    phrases = F.array(*map(F.lit, PHRASES))
    return table(spark, sf_dir, "documents").withColumn("text", F.concat(F.get(phrases, (F.col("doc_id") % len(PHRASES)).cast("int")), F.lit(" "), "text"))


def signals(docs: DataFrame) -> DataFrame:
    """documents as signals: author, likes and time follow from doc_id."""
    empty = F.lit("")
    rows = docs.select(
        "source", F.col("doc_id").cast("string").alias("source_id"), empty.alias("url"), F.concat(F.lit("u"), F.col("doc_id") % 37).alias("author"),
        F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("doc_id") * 60), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("published_at"),
        F.lit(None).cast("string").alias("title"), T.clean_text(F.col("text")).alias("text"),
        F.struct((F.col("doc_id") % 101).alias("likes"), F.lit(None).cast("bigint").alias("comments"), F.lit(None).cast("bigint").alias("views"), F.lit(None).cast("bigint").alias("score")).alias("engagement"),
        F.lit(None).cast("string").alias("subreddit"), F.lit(None).cast("string").alias("canonical_url"), F.col("doc_id").alias("pos"),
    )
    rows = rows.withColumn("normalized_text", T.dedup_text(F.col("text")))
    return rows.withColumn("content_hash", content_hash(F.col("canonical_url"), F.col("normalized_text")))


def snapshots(spark: SparkSession, sf_dir: str, by: str = "user_id") -> DataFrame:
    """events as a series: how many a user has had by the end of each day."""
    from pyspark.sql import Window as W

    daily = table(spark, sf_dir, "events").groupBy(F.col(by).cast("string").alias("opportunity_id"), F.date_trunc("day", "ts").alias("snapshot_at")).agg(F.count("*").alias("n"))
    run = W.partitionBy("opportunity_id").orderBy("snapshot_at")
    return daily.select("opportunity_id", "snapshot_at", F.sum("n").over(run).alias("signal_count"))


SNAPSHOTS_SQL = """
daily AS (SELECT user_id::VARCHAR AS opportunity_id, date_trunc('day', ts) AS snapshot_at, count(*) AS n FROM events GROUP BY ALL),
snapshots AS (SELECT opportunity_id, snapshot_at, sum(n) OVER (PARTITION BY opportunity_id ORDER BY snapshot_at)::BIGINT AS signal_count FROM daily)
"""


def phrased_sql(name: str = "phrased") -> str:
    values = ", ".join(f"({i}, '{p}')" for i, p in enumerate(PHRASES))
    return f"{name} AS (SELECT doc_id, source, lang, concat(p.t, ' ', d.text) AS text FROM documents d JOIN (VALUES {values}) p(i, t) ON d.doc_id % {len(PHRASES)} = p.i)"
