"""Texts for people: cards, details and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oppsift.functions.scalars import shown
from oppsift.functions.text import snippet

# Wording and bounds.
TIER_MARK = {"do_now": "🔥", "watch": "🟡"}
TIER_LABEL = {"do_now": "Faisable maintenant", "watch": "À surveiller"}
RISK_LEVELS = {"LOW": "faible", "MEDIUM": "moyen", "HIGH": "élevé"}
TRENDS = {"accelerating": "en accélération", "steady": "stable", "saturating": "en train de saturer", "insufficient_data": "pas assez de recul"}
LOW_EFFORT, MEDIUM_EFFORT = 0.35, 0.55
EFFORT = ("effort faible", "effort moyen", "effort élevé")
NEW, WHY, IGNORED, VERIFIED_HEAD, PRIZE_FACT = " · nouveau", "Pourquoi:", "Ignorée", "Vérifié sur la page officielle:", "dotation : "
OWN_REPOSITORY = 'ton repo "%s" correspond peut-être (%.0f%%)'
DETAIL_SCORE, DETAIL_RELEVANCE, DETAIL_SOURCES = "Score global : %s  ·  valeur estimée : %s", "Pertinence : %s%%", "Sources : %d signal(aux) · %s"
DETAIL_REWARD, DETAIL_NO_REWARD, DETAIL_EFFORT, DETAIL_RISK, DETAIL_TREND = "Récompense mentionnée : ", "non précisée dans le texte", "Effort estimé : ", "Risque : ", "Tendance : "
DETAIL_SINCE, DETAIL_WHY, DETAIL_CONCERNS, DETAIL_BLOCKED = "Détecté depuis : ", "Pourquoi ça vaut le coup :", "Points de vigilance :", "🔒 Page officielle protégée (anti-bot) — vérifie toi-même :"
BLOCKED_HEAD = "🔒 Vérification bloquée"
BLOCKED_BODY = "La page officielle est protégée (anti-bot ou connexion requise) — je ne peux pas la lire automatiquement. Tu veux bien checker toi-même ?"
SUMMARY, SUMMARY_NOTHING, SUMMARY_WATCH = "🔎 Scan terminé ({:.0f}s) — {} signaux analysés", "Rien d'actionnable maintenant.", " {} à surveiller — /top pour les voir."


def _lookup(value: Column, table: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), value), default)


def effort_label() -> Column:
    e = F.col("effort_score")
    return F.when(e < LOW_EFFORT, EFFORT[0]).when(e < MEDIUM_EFFORT, EFFORT[1]).otherwise(EFFORT[2])


def risk_label() -> Column:
    return _lookup(F.col("risk_level"), RISK_LEVELS, F.lower("risk_level"))


def trend_label() -> Column:
    return _lookup(F.col("trend"), TRENDS, F.col("trend"))


def platforms() -> Column:
    return F.array_join(F.array_sort("platforms"), "/")


def meta_line() -> Column:
    return F.concat_ws(" · ", F.nullif("money_mention", F.lit("")), effort_label(), platforms())


def _bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda w: F.concat(F.lit("• "), w)), "\n")


def _quoted(width: int) -> Column:
    return F.concat(F.lit('"'), snippet(F.col("representative_text"), width), F.lit('"'))


def _section(head: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"\n{head}\n"), _bullets(items)))


def facts(verified: bool, projects: bool = False) -> Column:
    """The lines of a verification that could be read, and of the project that is most like it; null without facts."""
    if not verified:
        return F.lit(None).cast("string")
    lines = [F.col("deadline_text"), F.concat(F.lit(PRIZE_FACT), "prize_text")]
    if projects:
        lines.append(F.when(F.col("match_name").isNotNull(), F.format_string(OWN_REPOSITORY, "match_name", "match_score")))
    return F.when(F.col("checked") & ~F.col("blocked"), _section(VERIFIED_HEAD, F.array_compact(F.array(*lines))))


def card(verified: bool = False, projects: bool = False) -> Column:
    """A decided row as the short notification. verified: the row has the columns of a verification, null where there is none;
    projects: and match_name and match_score."""
    head = F.concat(_lookup(F.col("tier"), TIER_MARK, F.lit("")), F.lit(" "), _lookup(F.col("tier"), TIER_LABEL, F.lit("")), F.when(F.col("is_new"), NEW).otherwise(""))
    return F.concat_ws("\n", head, _quoted(110), meta_line(), _section(WHY, F.slice("why", 1, 3)), facts(verified, projects))


def detail(verified: bool = True) -> Column:
    """A decided row in full, with first_seen and a verification (null where there is none)."""
    lines = [
        F.concat(_lookup(F.col("tier"), TIER_MARK, F.lit("⚪")), F.lit(" "), _lookup(F.col("tier"), TIER_LABEL, F.lit(IGNORED))),
        _quoted(220),
        F.lit(""),
        F.format_string(DETAIL_SCORE, shown(F.col("opportunity_score"), 2), shown(F.col("value_score"), 2)),
        F.concat(F.lit(DETAIL_REWARD), F.coalesce(F.nullif("money_mention", F.lit("")), F.lit(DETAIL_NO_REWARD))),
        F.concat(F.lit(DETAIL_EFFORT), effort_label()),
        F.concat(F.lit(DETAIL_RISK), risk_label()),
        F.format_string(DETAIL_RELEVANCE, shown(F.col("relevance_score") * 100, 0)),
        F.format_string(DETAIL_SOURCES, "signal_count", platforms()),
        F.concat(F.lit(DETAIL_TREND), trend_label()),
        F.concat(F.lit(DETAIL_SINCE), F.date_format("first_seen", "yyyy-MM-dd")) if verified else F.lit(None),
        _section(DETAIL_WHY, F.col("why")),
        _section(DETAIL_CONCERNS, F.col("concerns")),
        facts(verified),
        F.when(F.col("blocked"), F.concat(F.lit(f"\n{DETAIL_BLOCKED}\n"), F.coalesce("official_url", F.lit("")))) if verified else F.lit(None),
        F.when(F.col("representative_url") != "", F.concat(F.lit("\n"), F.col("representative_url"))),
    ]
    return F.concat_ws("\n", *lines)


def blocked_notice() -> Column:
    """What to tell the user of a page that is protected."""
    return F.concat(F.lit(BLOCKED_HEAD + "\n"), _quoted(90), F.lit(f"\n\n{BLOCKED_BODY}\n"), F.coalesce("official_url", F.lit("")))


def teaser() -> Column:
    """One line of at most 60 characters."""
    money = F.when(F.col("money_mention") != "", F.concat("money_mention", F.lit(" · "))).otherwise("")
    text = F.concat(_lookup(F.col("tier"), TIER_MARK, F.lit("")), F.lit(" "), money, snippet(F.col("representative_text"), 40))
    return F.when(F.length(text) > 60, F.concat(F.substring(text, 1, 59), F.lit("…"))).otherwise(text)


def run_summary(actions: DataFrame, signal_count: int, elapsed: float) -> str:
    """The text after a run: the best pick as a card, teasers of two more, else how many to watch. Reads few rows."""
    head = SUMMARY.format(elapsed, signal_count)
    best = actions.where("tier = 'do_now' and rank <= 3").orderBy("rank").select(card("checked" in actions.columns).alias("card"), teaser().alias("teaser")).collect()
    if best:
        return "\n\n".join([head, best[0]["card"], *(r["teaser"] for r in best[1:])])
    watch = actions.where("tier = 'watch'").count()
    return f"{head}\n\n{SUMMARY_NOTHING}" + (SUMMARY_WATCH.format(watch) if watch else "")
