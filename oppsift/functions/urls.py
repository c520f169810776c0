"""URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from oppsift.functions.lexicon import SOCIAL_DOMAINS

#: Query parameters that only track where a visitor came from.
TRACKERS = r"(?:utm_[^=&]*|ref|ref_src|fbclid|gclid|igshid|mc_cid|mc_eid|spm)"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without a default port, tracking parameters and fragment; null from an empty one."""
    url = F.nullif(F.trim(F.regexp_replace(url, r"#.*$", "")), F.lit(""))
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    rest = F.substring(url, F.length(head) + 1, F.length(url))
    head = F.regexp_replace(F.regexp_replace(F.lower(head), r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    rest = F.regexp_replace(rest, rf"(?<=[?&]){TRACKERS}=[^&]*", "")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&{2,}", "&"), r"\?&", "?"), r"[?&]$", "")
    return F.when(url.isNotNull(), F.concat(head, rest))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def is_social(url: Column) -> Column:
    """Is its host one of the social platforms', or below one."""
    h = host(url)
    found = F.lit(False)
    for d in SOCIAL_DOMAINS:
        found = found | (h == d) | h.endswith("." + d)
    return found


def is_web(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")
