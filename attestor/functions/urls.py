"""URL columns: canonical form, domains, sanitised form, PDF and safety tests. All expressions stay in the JVM."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parameters that name a campaign or a referrer, never a document.
TRACKING_PREFIXES = ("utm_", "pk_", "mc_", "ga_", "hsa_", "_hs")
TRACKING_NAMES = (
    "fbclid", "gclid", "dclid", "msclkid", "igshid", "mkt_tok", "yclid", "ref", "referrer", "source", "src", "campaign", "spm", "scid", "cmpid", "ncid", "sr_share",
    "at_medium", "at_campaign", "trk", "trkcampaign", "__twitter_impression", "guccounter", "ved", "usg",
)

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)\??([^#]*)"


def is_tracking(name: Column) -> Column:
    low = F.lower(name)
    return low.isin(*TRACKING_NAMES) | low.rlike("^(" + "|".join(TRACKING_PREFIXES) + ")")


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def _host(authority: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.regexp_extract(F.regexp_replace(authority, "^.*@", ""), "^([^:]*)", 1)), r"\.+$", "")
    return F.regexp_replace(bare, r"^www\.", "")


def domain(url: Column) -> Column:
    """Host in lower case without port, user, `www.` and trailing dot; '' where there is none."""
    return F.coalesce(_host(_part(F.trim(url), 2)), F.lit(""))


def canonical(url: Column) -> Column:
    """One spelling for each document: see the steps below. What can't be parsed stays as it is, null becomes ''."""
    raw = F.trim(url)
    scheme, authority = F.lower(_part(raw, 1)), _part(raw, 2)
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    place = F.concat(_host(authority), F.when(default, "").otherwise(F.concat(F.lit(":"), port)))
    path = F.coalesce(F.try_url_decode(F.replace(_part(raw, 3), F.lit("+"), F.lit("%2B"))), _part(raw, 3))
    path = F.regexp_replace(path, r"(/index\.html|/index\.htm|/index\.php|/default\.aspx)$", "")
    path = F.regexp_replace(F.regexp_replace(path, "/amp$", ""), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    pairs = F.filter(F.split(_part(raw, 4), "&"), lambda p: (p != "") & ~is_tracking(F.regexp_extract(p, "^[^=]*", 0)))
    query = F.array_join(F.array_sort(F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))), "&")
    whole = F.concat(scheme, F.lit("://"), place, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.coalesce(F.when((scheme == "") | (authority == ""), raw).otherwise(whole), F.lit(""))


def sanitized(url: Column) -> Column:
    """Scheme, host, port and path of http(s) URLs, without user, query and fragment; else ''."""
    scheme = F.lower(_part(F.trim(url), 1))
    place = F.lower(F.regexp_replace(_part(F.trim(url), 2), "^.*@", ""))
    return F.coalesce(F.when(scheme.isin("http", "https") & (place != ""), F.concat(scheme, F.lit("://"), place, _part(F.trim(url), 3))).otherwise(""), F.lit(""))


def looks_like_pdf(url: Column) -> Column:
    path = F.lower(_part(F.trim(url), 3))
    return F.coalesce(path.rlike(r"\.pdf$") | path.rlike("^/pdf/"), F.lit(False))


def host_of(sanitized_url: Column) -> Column:
    """The host of a sanitized URL without its port; '' for ''."""
    return F.regexp_replace(F.regexp_extract(sanitized_url, r"^https?://([^/]*)", 1), r":\d*$", "")


def same_document(a: Column, b: Column) -> Column:
    return canonical(a) == canonical(b)


# Ports that may be fetched from, and hosts that never are.
ALLOWED_PORTS = ("", "80", "443", "8080", "8443")
LOCAL_HOSTS = ("localhost", "metadata.google.internal", "metadata", "instance-data")


@F.pandas_udf(T.BooleanType())
def _blocked_v6(addresses: pd.Series) -> pd.Series:
    """Whether an IPv6 address, or the IPv4 address mapped into it, is not a public one. What is no address is blocked."""

    def blocked(text: str | None) -> bool:
        try:
            at = ipaddress.IPv6Address((text or "").split("%")[0])
        except ValueError:
            return True
        return not (at.ipv4_mapped or at).is_global or at.is_multicast

    return addresses.map(blocked)


def unsafe_reason(url: Column) -> Column:
    """Why a fetch of the URL is refused, null if it isn't: scheme, host, port, a local host or an address that is not public."""
    raw = F.trim(url)
    scheme, authority = F.lower(_part(raw, 1)), F.regexp_replace(_part(raw, 2), "^.*@", "")
    v6 = F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)
    host, port = _host(authority), F.regexp_extract(authority, r":(\d*)$", 1)
    port = F.when(authority.startswith("["), F.regexp_extract(authority, r"\]:(\d*)$", 1)).otherwise(port)
    octets = F.transform(F.split(F.regexp_extract(host, r"^\d+\.\d+\.\d+\.\d+$", 0), r"\."), lambda x: F.try_to_number(x, F.lit("999")).cast("int"))
    a, b, c = (F.try_element_at(octets, F.lit(i)) for i in (1, 2, 3))
    private = a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19))
    return (
        F.when(~F.coalesce(scheme.isin("http", "https"), F.lit(False)), "scheme")
        .when((host == "") & (v6 == ""), "no host")
        .when(~port.isin(*ALLOWED_PORTS), "port")
        .when(authority.startswith("["), F.when(_blocked_v6(F.when(authority.startswith("["), v6)), "blocked address"))
        .when(host.isin(*LOCAL_HOSTS) | host.endswith(".local") | host.endswith(".internal") | host.endswith(".localhost"), "local host")
        .when(F.coalesce(private, F.lit(False)), "private address")
    )
