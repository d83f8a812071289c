"""Source type, authority and quality of a page."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domains (with their subdomains) whose type is known.
DOMAIN_TYPES = {
    "academic": ("arxiv.org", "aclanthology.org", "openreview.net", "pubmed.ncbi.nlm.nih.gov", "pmc.ncbi.nlm.nih.gov", "dl.acm.org", "ieeexplore.ieee.org", "nature.com", "sciencedirect.com", "scholar.google.com", "semanticscholar.org"),
    "standards_body": ("ietf.org", "w3.org", "iso.org", "nist.gov", "owasp.org"),
    "forum": ("stackoverflow.com", "stackexchange.com", "reddit.com", "news.ycombinator.com", "quora.com"),
    "social": ("x.com", "twitter.com", "linkedin.com", "facebook.com", "threads.net", "bsky.app", "mastodon.social", "t.me", "tiktok.com", "youtube.com", "youtu.be"),
    "official_docs": ("scikit-learn.org", "pytorch.org", "tensorflow.org", "huggingface.co"),
    "blog": ("medium.com", "towardsai.net", "plainenglish.io", "betterprogramming.pub", "levelup.gitconnected.com", "itnext.io", "substack.com", "dev.to", "hashnode.dev", "towardsdatascience.com"),
    "reference": ("wikipedia.org", "britannica.com", "encyclopedia.com"),
    "news": ("reuters.com", "apnews.com", "bbc.com", "nytimes.com", "wsj.com", "theguardian.com", "bloomberg.com", "ft.com", "techcrunch.com", "arstechnica.com", "theverge.com"),
}
# Signs of documentation and of blogs, types by suffix, base quality, authority, ranks, bonuses and penalties.
DOCS_PREFIXES = ("docs.", "developer.", "developers.", "api.", "learn.", "platform.")
DOCS_SUFFIXES = (".readthedocs.io", ".github.io", ".js.org", ".netlify.app")
DOCS_LABELS = ("docs", "documentation", "reference")
SUFFIX_TYPES = ((".gov", "government"), (".mil", "government"), (".edu", "academic"), (".ac.uk", "academic"))
DOCS_PATHS = ("/docs/", "/documentation/", "/reference/", "/api/", "/guide/")
BLOG_PATHS = ("/blog/", "/posts/", "/news/")
BASE = {"standards_body": 0.90, "official_docs": 0.85, "academic": 0.85, "government": 0.80, "news": 0.60, "vendor": 0.55, "reference": 0.70, "blog": 0.45, "forum": 0.35, "other": 0.50, "social": 0.20}
AUTHORITY = {"standards_body": "primary", "official_docs": "primary", "academic": "primary", "government": "primary", "reference": "secondary", "news": "secondary", "vendor": "secondary", "blog": "aggregator", "forum": "aggregator", "social": "aggregator", "other": "secondary"}
RANK = {"primary": 3, "secondary": 2, "aggregator": 1, "unknown": 0}
BONUS = {"primary": 0.15, "secondary": 0.08, "aggregator": 0.0, "unknown": 0.0}
PENALTY = {"social": -0.20, "blog": -0.08, "forum": -0.08}


def _lookup(table: dict, key: Column, default: object) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for x in chain(*table.items())))[key], F.lit(default))


def source_type(url: Column, domain: Column) -> Column:
    """The first that fits: known domain or its parent, documentation host, suffix of the domain, hint in the URL, `other`."""
    known = F.create_map(*(F.lit(x) for kind, names in DOMAIN_TYPES.items() for name in names for x in (name, kind)))
    labels = F.split(domain, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    exact = F.try_element_at(F.filter(F.transform(parents, lambda p: known[p]), lambda t: t.isNotNull()), F.lit(1))
    docs = domain.rlike("^(" + "|".join(p.replace(".", r"\.") for p in DOCS_PREFIXES) + ")") | domain.rlike("(" + "|".join(s.replace(".", r"\.") for s in DOCS_SUFFIXES) + ")$") | F.arrays_overlap(labels, F.array(*(F.lit(x) for x in DOCS_LABELS)))
    has = lambda hints: F.lower(url).rlike("(" + "|".join(hints) + ")")
    out = F.when(exact.isNotNull(), exact).when(docs, "official_docs")
    for suffix, kind in SUFFIX_TYPES:
        out = out.when(domain.endswith(suffix), kind)
    return out.when(has(DOCS_PATHS), "vendor").when(has(BLOG_PATHS), "blog").otherwise("other")


def base_quality(kind: Column) -> Column:
    return _lookup(BASE, kind, 0.5)


def authority(kind: Column) -> Column:
    return _lookup(AUTHORITY, kind, "unknown")


def authority_rank(kind: Column) -> Column:
    return _lookup(RANK, authority(kind), 0)


def recency_adjustment(published: Column, now: Column, horizon_months: Column) -> Column:
    months = F.datediff(now, published) / F.lit(30.44)
    known = published.isNotNull() & horizon_months.isNotNull()
    return F.when(~known, 0.0).when(months <= horizon_months, 0.08).when(months <= 2 * horizon_months, -0.05).otherwise(-0.15)


def quality_score(kind: Column, score: Column, words: Column, recency: Column) -> Column:
    """Base, the provider's score around 0.5, length and recency, held in [0, 1], to 3 digits."""
    clamped = F.least(F.greatest(F.coalesce(score, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    length = F.when(words < 120, -0.20).when(words > 600, 0.05).otherwise(0.0)
    return F.round(F.least(F.greatest(base_quality(kind) + (clamped - 0.5) * 0.20 + length + recency, F.lit(0.0)), F.lit(1.0)), 3)


def quality_reasons(kind: Column, words: Column, recency: Column) -> Column:
    return F.array_compact(F.array(F.concat(F.lit("type:"), kind), F.when(words < 120, "short"), F.when(words > 600, "long"), F.when(recency > 0, "recent"), F.when(recency < 0, "dated")))


def ranking_adjustment(kind: Column, explanatory: Column) -> Column:
    return _lookup(BONUS, authority(kind), 0.0) + F.when(explanatory, _lookup(PENALTY, kind, 0.0)).otherwise(0.0)
