"""Checks of opportunities against web pages and one's own projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oppsift.checkpoints import measured, written
from oppsift.functions import lexicon as L
from oppsift.functions.similarity import ratio_of_tokens, tokens
from oppsift.functions.text import URL, bound
from oppsift.functions.urls import is_social, is_web

# Notes of a verification, and its limits.
NOT_TAGGED = "pas taggé hackathon"
NO_LINK = "aucun lien vers une page officielle trouvé dans le texte"
NO_PAGE = "lien(s) trouvé(s) mais la page n'a pas pu être chargée"
BLOCKED = "page protégée (anti-bot / connexion requise) — à vérifier toi-même"
VERIFIED = "vérifié"
DEADLINE_WINDOW, LEAST_MATCH, BLOCKED_CHARS, LINKS = 60, 60.0, 2000, 2


def candidate_urls(representative_url: Column, text: Column) -> Column:
    """Web links that are no social platform's: the representative one, then those in the text, distinct, in order."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, "[).,!…]+$", ""))
    every = F.concat(F.array(F.coalesce(representative_url, F.lit(""))), found)
    return F.array_distinct(F.filter(every, lambda u: is_web(u) & ~is_social(u)))


def looks_blocked(page: Column) -> Column:
    return (F.length(page) < BLOCKED_CHARS) & page.rlike(L.any_case(L.ANTI_BOT))


def deadline(page: Column, window: int = DEADLINE_WINDOW) -> Column:
    """ "deadline : <date>" by the first date within ``window`` characters after the word "deadline", whole; null without."""

    def dates_after(parts: Column) -> Column:
        # what follows each "deadline", further ones (at most 7 fit in the window) put back
        after = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.substring(F.array_join(F.slice(parts, i, 9), "deadline"), 1, window))
        return F.filter(F.transform(after, lambda p: F.regexp_substr(p, F.lit(L.PAGE_DATE))), lambda d: d.isNotNull())

    dates = bound(F.split(page, "(?i)deadline"), dates_after)
    return F.when(F.size(dates) > 0, F.concat(F.lit("deadline : "), F.get(dates, F.lit(0))))


def prize(page: Column) -> Column:
    return F.trim(F.regexp_substr(page, F.lit(L.any_case(L.PRIZE))))


def verify(scores: DataFrame, pages: DataFrame) -> DataFrame:
    """scores with checked, blocked, official_url, deadline_text, prize_text and note.

    pages (url, page_text) stands for fetching: of an opportunity's first two links the first with a page counts. Only those tagged as
    a hackathon are checked.
    """
    tagged = F.array_contains("relevance_reasons", "hackathon_or_competition")
    links = candidate_urls(F.col("representative_url"), F.col("representative_text"))
    rows = scores.withColumn("links", F.when(tagged, links))
    tries = rows.select("opportunity_id", F.posexplode(F.slice("links", 1, LINKS)).alias("place", "official_url"))
    hits = tries.join(pages.select(F.col("url").alias("official_url"), "page_text").where("page_text != ''"), "official_url")
    hits = hits.withColumn("n", F.row_number().over(W.partitionBy("opportunity_id").orderBy("place", "page_text"))).where("n = 1")
    blocked = looks_blocked(F.col("page_text"))
    hits = hits.select("opportunity_id", "official_url", blocked.alias("blocked"), F.when(~blocked, deadline(F.col("page_text"))).alias("deadline_text"), F.when(~blocked, prize(F.col("page_text"))).alias("prize_text"))
    out = rows.join(hits, "opportunity_id", "left")
    note = F.when(~tagged, NOT_TAGGED).when(F.size("links") == 0, NO_LINK).when(F.col("official_url").isNull(), NO_PAGE).when(F.col("blocked"), BLOCKED).otherwise(VERIFIED)
    return out.withColumns({"checked": tagged, "blocked": F.coalesce("blocked", F.lit(False)), "note": note}).drop("links")


def project_matches(hints: DataFrame, projects: DataFrame, least: float = LEAST_MATCH, block: int = 1000) -> DataFrame:
    """(opportunity_id, name, url, updated_at, match_score) of one's own projects (name, description, url, updatedAt) whose name or
    description is like a hint's words.

    The hints, the few opportunities to act on, are compared with all projects, which come in blocks of about ``block``; pairs
    that cannot reach ``least`` by their words and lengths are told without a comparison. A near spelling needs no common word, so
    no block is left out.
    """
    hint = hints.select("opportunity_id", tokens(F.lower(F.substring("representative_text", 1, 80))).alias("hint"))
    texts = projects.select("name", "url", F.col("updatedAt").alias("updated_at"), *(tokens(F.lower(F.coalesce(c, F.lit("")))).alias(to) for c, to in (("name", "low"), ("description", "about"))))
    texts, n = measured(texts, "projects", n=F.count("*"))
    blocks = max(1, -(-n["n"] // block))
    near = hint.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(texts.withColumn("block", F.pmod(F.xxhash64("name", "url"), F.lit(blocks)).cast("int")), "block")
    scored = near.withColumn("match_score", F.greatest(*(ratio_of_tokens(F.col("hint"), F.col(c), least) for c in ("low", "about")))).where(F.col("match_score") >= least)
    return scored.select("opportunity_id", "name", "url", "updated_at", F.round("match_score", 1).alias("match_score"))
