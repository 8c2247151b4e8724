"""URL canonicalisation as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING_PARAMS = ("amp", "amp_js_v", "fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "mkt_tok", "ref", "ref_src", "ref_url", "spm", "yclid")
TRACKING_PREFIXES = ("utm_", "amp_", "ga_")


def _spaced(url: Column) -> Column:
    raw = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), " ", "")
    return F.when(raw == "", F.lit("")).when(~F.contains(raw, F.lit("://")) & ~raw.startswith("//"), F.concat(F.lit("https://"), raw)).otherwise(raw)


def host(url: Column) -> Column:
    """Lower-case host without www. and port."""
    h = F.lower(F.regexp_extract(_spaced(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(h, r"^www\.", "")


def plain(x: Column) -> Column:
    """A query's key or value decoded; what isn't well coded stays as it is."""
    return F.coalesce(F.try_url_decode(x), x)


def coded(x: Column) -> Column:
    """Coded anew: blanks as plus signs, only letters, digits and ``_.-~`` as they are."""
    out = F.url_encode(x)
    return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column, params: tuple[str, ...] = TRACKING_PARAMS, prefixes: tuple[str, ...] = TRACKING_PREFIXES) -> Column:
    """Scheme and host lowered, default port, tracking parameters, fragment and final slash gone, parameters sorted and coded anew."""
    raw = _spaced(url)
    scheme = F.coalesce(F.nullif(F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit("")), F.lit("https"))
    port = F.regexp_extract(raw, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#:]*:([0-9]+)", 1)
    port = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_extract(raw, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", F.lit("/")).when((path != "/") & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    pairs = F.split(F.regexp_extract(raw, r"\?([^#]*)", 1), "&")

    def wanted(p: Column) -> Column:
        key = F.lower(plain(F.split(p, "=", 2)[0]))
        track = key.isin(*params)
        for prefix in prefixes:
            track = track | key.startswith(prefix)
        return (p != "") & (key != "") & ~track

    kept = F.array_sort(F.transform(F.filter(pairs, wanted), lambda p: F.struct(F.lower(plain(F.split(p, "=", 2)[0])).alias("k"), plain(F.coalesce(F.get(F.split(p, "=", 2), F.lit(1)), F.lit(""))).alias("v"), plain(F.split(p, "=", 2)[0]).alias("key"))))
    query = F.array_join(F.transform(kept, lambda s: F.concat(coded(s["key"]), F.lit("="), coded(s["v"]))), "&")
    out = F.concat(scheme, F.lit("://"), host(url), port, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(raw == "", F.lit("")).otherwise(out)
