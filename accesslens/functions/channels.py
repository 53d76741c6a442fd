"""Acquisition channel of a referrer domain.

Two definitions live side by side and give different answers on purpose:
`channel_by_list` (longer lists, own-site domains count as direct, matches on the
last two labels) and `channel_by_like` (short lists, matches anywhere).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = ["direct", "social", "search", "others"]

# The domain lists define the channels.
DIRECT_VALUES = ["direct", "(direct)", ""]
OWN_SITES = ["zanbil.ir", "znbl.ir", "www.zanbil.ir", "www.znbl.ir"]
SOCIAL_DOMAINS = [
    "facebook.com", "instagram.com", "twitter.com", "linkedin.com",
    "t.co", "fb.com", "lnkd.in", "social.com",
]
SEARCH_DOMAINS = ["google.com", "naver.com", "daum.net", "bing.com", "yahoo.com", "duckduckgo.com"]
SOCIAL_PATTERNS = ["facebook.com", "instagram.com", "twitter.com", "linkedin.com"]
SEARCH_PATTERNS = ["google.com", "naver.com", "daum.net", "bing.com"]


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    return reduce(or_, [text.contains(needle) for needle in needles])


def _is_site(domain: Column, sites: Iterable[str]) -> Column:
    return reduce(or_, [(domain == site) | domain.endswith("." + site) for site in sites])


def channel_by_list(
    domain: Column, own_sites: Sequence[str] = tuple(OWN_SITES), mode: str = "compat"
) -> Column:
    """direct / social / search / others by domain list, case-sensitive.

    `compat` looks for a listed name anywhere in the last two labels, so `t.co`
    is found in `microsoft.com` and `google.co.uk` (last labels `co.uk`) is
    others. `exact` accepts a listed domain and its subdomains only.
    """
    if mode == "compat":
        base = F.substring_index(domain, ".", -2)
        social, search = contains_any(base, SOCIAL_DOMAINS), contains_any(base, SEARCH_DOMAINS)
    elif mode == "exact":
        social, search = _is_site(domain, SOCIAL_DOMAINS), _is_site(domain, SEARCH_DOMAINS)
    else:
        raise ValueError(f"unknown mode: {mode}")
    return (
        F.when(domain.isNull() | domain.isin(DIRECT_VALUES + list(own_sites)), "direct")
        .when(social, "social")
        .when(search, "search")
        .otherwise("others")
    )


def is_direct(domain: Column) -> Column:
    return domain.isNull() | (domain == "")


def is_social(domain: Column) -> Column:
    return contains_any(domain, SOCIAL_PATTERNS)


def is_search(domain: Column) -> Column:
    return contains_any(domain, SEARCH_PATTERNS)


def channel_by_like(domain: Column) -> Column:
    """direct / social / search / others by substring; the first match wins."""
    return (
        F.when(is_direct(domain), "direct")
        .when(is_social(domain), "social")
        .when(is_search(domain), "search")
        .otherwise("others")
    )
