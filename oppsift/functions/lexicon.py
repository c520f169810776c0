"""The words that tell what a text is about, and the expressions made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from oppsift.functions.scalars import squash

# Patterns (case-insensitive unless noted), weights, thresholds and labels that results depend on.
POSITIVE = {
    "giveaway": r"\bgiveaways?\b",
    "reward_or_prize": r"\b(rewards?|prizes?|bount(?:y|ies)|incentives?|bonus(?:es)?)\b",
    "credits_or_allocation": r"\b(credits?|allocations?|token distribution|airdrop allocation)\b",
    "free_access": r"\bfree (credits?|api|gpu|cloud|trials?|subscriptions?|access)\b",
    "eligibility_or_registration": r"\b(eligible|eligibility|registrations?|register now|sign ?up|apply now|whitelist(?:ed)?|allowlist(?:ed)?|waitlist(?:ed)?)\b",
    "deadline_or_scarcity": r"\b(deadlines?|limited spots|first \d+|first come|only \d+ ?(left|spots|slots)?)\b",
    "airdrop_or_distribution": r"\b(airdrops?|token distributions?|testnet rewards?)\b",
    "grant_or_funding": r"\b(grants?|funding rounds?|bounty programs?)\b",
    "hackathon_or_competition": r"\b(hackathons?|competition prizes?|challenge prizes?|coding challenges?)\b",
    "early_access_or_beta": r"\b(early access|beta testers?|beta rewards?|closed beta)\b",
    "referral": r"\b(referral rewards?|invite rewards?|refer a friend|referral (links?|programs?))\b",
}
NEGATIVE = {
    "conspiracy_or_politics": r"\b(conspiracy|senate race|election|parliament|president|congress(?:man|woman)?|prime minister)\b",
    "generic_news": r"\b(breaking news|poll shows|according to (police|officials))\b",
    "us_politics_or_macro_news": r"\b(white house|capitol hill|congress(?:ional)?|the senate|supreme court|federal reserve|the fed|national debt|gdp growth|inflation rate|interest rate hike|government shutdown|stimulus (?:package|bill)|state of the union|presidential election|midterms?)\b",
}
RISK = {
    "seed_phrase_or_private_key": (r"\b(seed phrases?|private keys?)\b", 0.9),
    "connect_wallet": (r"\bconnect (your )?wallets?\b", 0.2),
    "wallet_address_request": (r"\b(wallet address(es)?|submit(ting)? (your )?address(es)?|accepting (your )?(wallet )?address(es)?|drop your .*address(es)?|send.*your address(es)?)\b", 0.25),
    "urgency_language": (r"\b(hurry|act now|limited time|last chance|ends? (today|soon)|before it.?s too late|only \d+\s?(left|spots|slots)?|first \d+)", 0.15),
    "vague_crypto_giveaway": (r"\b(reply with|tag a friend|like\s*&?\s*(rt|retweet))\b.*\$[A-Z]{2,6}|\$[A-Z]{2,6}.*\b(giveaways?|airdrops?)\b", 0.2),
    "referral_farming": (r"\b(refer \d+ friends?|referral links?|invite \d+ friends?)\b", 0.1),
    "claim_now_unverifiable": (r"\bclaim now\b", 0.1),
    "disproportionate_promise": (r"\$\d{2,3},\d{3}\b", 0.2),
    "shortened_suspicious_link": (r"\b(bit\.ly|tinyurl\.com|cutt\.ly|is\.gd)/\S+", 0.1),
}
COMPOUND_TRIGGERS = ["connect_wallet", "wallet_address_request", "vague_crypto_giveaway"]
COMPOUND_REASON = "compounding:low_source_independence"
HIGH_EFFORT = r"\b(steps?|complete|tasks?|verify|verification|kyc|wait \d+ days?|apply|review|multiple)\b"
LOW_EFFORT = r"\b(just|simply|one click|sign up|click here|visit)\b"
MONEY_MENTION = r"\$\s?\d[\d,]*(?:\.\d+)?|\d[\d,]*\s?(?:usd|usdc|usdt|eth|sol|btc|pts?|points|credits)\b"
MONEY_ENTITY = r"\$\s?\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?\s?(?:usd|usdc|usdt|eth|sol|btc|pts?|points)\b"
CAPITALISED = r"\b(?:[A-Z][a-zA-Z0-9]{2,}(?:\s+[A-Z][a-zA-Z0-9]{2,}){0,2})\b"  # with case
SELECTIVE = r"\b(chance to win|sweepstakes|raffle|lucky winner|winners? will be (?:selected|chosen|announced|picked)|one (?:lucky )?winner|enter to win|drawing will be held|randomly selected)\b"
ANTI_BOT = r"verify you are human|checking your browser|complete the security check|enable javascript and cookies|unusual traffic|access denied|are you a robot|prove you.re not a robot|attention required"
PAGE_DATE = r"\d{1,2}\s+[A-Za-z]{3,9}\.?\s+\d{4}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}"  # with case
PRIZE = r"\$\s?[\d,]+(?:\.\d+)?(?:\s+in prizes?)?"
SOCIAL_DOMAINS = ["x.com", "twitter.com", "reddit.com", "news.ycombinator.com", "youtube.com", "youtu.be"]
RELEVANCE_LABELS = {
    "giveaway": "cadeau/giveaway explicite",
    "reward_or_prize": "récompense annoncée",
    "credits_or_allocation": "crédits/allocation mentionnés",
    "free_access": "accès gratuit",
    "eligibility_or_registration": "inscription ouverte",
    "deadline_or_scarcity": "places limitées ou deadline",
    "airdrop_or_distribution": "airdrop / distribution",
    "grant_or_funding": "grant ou financement",
    "hackathon_or_competition": "hackathon / compétition",
    "early_access_or_beta": "accès anticipé",
    "referral": "programme de parrainage",
}
RISK_LABELS = {
    "seed_phrase_or_private_key": "demande une seed phrase / clé privée",
    "connect_wallet": "demande de connecter un wallet",
    "wallet_address_request": "demande une adresse wallet",
    "urgency_language": "urgence artificielle",
    "vague_crypto_giveaway": "pattern giveaway crypto vague",
    "referral_farming": "farming de parrainage",
    "claim_now_unverifiable": '"claim now" invérifiable',
    "disproportionate_promise": "montant promis disproportionné",
    "shortened_suspicious_link": "lien raccourci suspect",
    "compounding:low_source_independence": "peu de sources indépendantes",
}
SELECTIVE_CONCERN = "tirage au sort / sélection — pas garanti même en participant"
OFF_TOPIC_CONCERN = "probablement hors-sujet (actualité/politique) malgré des mots-clés qui matchent"
# End of fixed values.


def any_case(pattern: str) -> str:
    return f"(?i){pattern}"


def tags(text: Column, patterns: dict[str, str], prefix: str = "") -> Column:
    """The names whose pattern occurs, in the order of the dictionary."""
    hits = [F.when(text.rlike(pattern), F.lit(prefix + name)) for name, pattern in patterns.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def clamp(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def positive_reasons(text: Column) -> Column:
    return tags(text, {k: any_case(v) for k, v in POSITIVE.items()})


def off_topic_reasons(text: Column) -> Column:
    return tags(text, {k: any_case(v) for k, v in NEGATIVE.items()}, "OFF-TOPIC:")


def relevance_score(positive: Column, negative: Column) -> Column:
    """From the two arrays of reasons; without any it is the base."""
    return clamp(F.lit(0.12) + F.lit(0.20) * F.least(F.size(positive), F.lit(4)) - F.lit(0.25) * F.least(F.size(negative), F.lit(3)))


def risk_reasons(text: Column) -> Column:
    case = {"disproportionate_promise"}
    return tags(text, {k: p if k in case else any_case(p) for k, (p, _) in RISK.items()})


def risk_total(reasons: Column) -> Column:
    """The weights of the reasons, with the bonus if the compounding reason is among them; not rounded."""
    weights = F.create_map(*(F.lit(x) for k, (_, w) in RISK.items() for x in (k, w)), F.lit(COMPOUND_REASON), F.lit(0.25))
    return clamp(F.aggregate(reasons, F.lit(0.0), lambda s, r: s + F.element_at(weights, r)))


def compounded(reasons: Column, independence: Column) -> Column:
    """reasons, and one more if a request for a wallet comes from few independent sources."""
    found = F.arrays_overlap(reasons, F.array(*map(F.lit, COMPOUND_TRIGGERS))) & (independence < 0.3)
    return F.when(found, F.concat(reasons, F.array(F.lit(COMPOUND_REASON)))).otherwise(reasons)


def risk_level(total: Column) -> Column:
    return F.when(total >= 0.6, "HIGH").when(total >= 0.3, "MEDIUM").otherwise("LOW")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(any_case(pattern)))


def effort_score(text: Column) -> Column:
    score = clamp(F.lit(0.3) + F.lit(0.15) * F.least(count(text, HIGH_EFFORT), F.lit(4)) - F.lit(0.15) * F.least(count(text, LOW_EFFORT), F.lit(3)))
    return F.when(text.isNotNull(), score).otherwise(0.3)


def money_score(text: Column) -> Column:
    return F.coalesce(squash(count(text, MONEY_MENTION), 5), F.lit(0.0))


def money_mention(text: Column) -> Column:
    """The first amount as written; empty without one."""
    return F.trim(F.coalesce(F.regexp_substr(text, F.lit(any_case(MONEY_MENTION))), F.lit("")))


def labelled(reasons: Column, labels: dict[str, str]) -> Column:
    """Each reason's label; one without a label stays."""
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.transform(reasons, lambda r: F.coalesce(F.element_at(table, r), r))
