"""Identity: content hashes, stable ids, and keys of addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separator of hashed parts and the tracking parameters that identify no page.
UNIT = "\x1f"
REGISTRATION_TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")
PAGE_TRACKING = ("fbclid", "gclid")


def digest(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by the unit separator; null counts as empty."""
    return F.sha2(F.concat_ws(UNIT, *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts)), 256)


def stable_id(prefix: str, *values: Column | str) -> Column:
    """The prefix and the SHA-256 of a compact JSON array of the values as strings."""
    return F.concat(F.lit(prefix + ":"), F.sha2(F.to_json(F.array(*((F.col(v) if isinstance(v, str) else v).cast("string") for v in values))), 256))


def candidate_id(raw_id: Column, content_hash: Column, unit_id: Column | None = None) -> Column:
    """From the observation and its content; a unit's id is first hashed into the content's."""
    return F.concat(F.lit("candidate:"), digest(raw_id, content_hash if unit_id is None else digest(content_hash, unit_id)))


def occurrence_id(owner: Column, *parts: Column) -> Column:
    """``occurrence:`` and 24 hex digits of the hash of owner and parts."""
    values = F.array(owner.cast("string"), *(p.cast("string") for p in parts))
    return F.concat(F.lit("occurrence:"), F.substring(F.sha2(F.to_json(values), 256), 1, 24))


def identity_slot(kind: Column, position: Column) -> Column:
    return F.when(kind.isin("caption", "website_text") & position.isNull(), "primary").otherwise(F.concat_ws(":", kind, F.coalesce(position.cast("string"), F.lit("0"))))


def host(url: Column) -> Column:
    """Host in lower case without www.; null for what is no address."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"/+$", "")


def parameters(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda p: p != "")


def _queried(base: Column, params: Column) -> Column:
    return F.when(F.size(params) > 0, F.concat(base, F.lit("?"), F.array_join(params, "&"))).otherwise(base)


def website_key(url: Column) -> Column:
    """Host, path without a trailing slash, and sorted parameters but utm_ ones; the fragment does not count."""
    kept = F.array_sort(F.filter(parameters(url), lambda p: ~F.lower(p).startswith("utm_")))
    return _queried(F.concat(host(url), path(url)), kept)


def valid_url(url: Column) -> Column:
    """http(s), a host, no credentials and no white space."""
    return F.coalesce(url.rlike(r"^https?://[^\s/@?#]+([/?#][^\s]*)?$"), F.lit(False))


def registration_key(url: Column) -> Column:
    """The address without tracking parameters; null for home pages and for what may not be linked.

    Scheme, port, trailing slash, fragment and the order of parameters all tell
    addresses apart; a home page stays one whatever its parameters.
    """
    part = lambda k: F.regexp_extract(url, r"^([A-Za-z]+)://([^/?#\s]+)([^?#]*)(?:\?([^#]*))?(#.*)?$", k)
    name = lambda p: F.lower(F.coalesce(F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))), F.lit("")))
    kept = F.filter(F.split(part(4), "&"), lambda p: ~name(p).isin(*REGISTRATION_TRACKING))
    query, fragment = F.array_join(kept, "&"), F.when(F.char_length(part(5)) > 1, part(5)).otherwise("")
    whole = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), part(3), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), fragment)
    good = url.rlike(r"^(?i:https?)://[^\s/@?#:]+(:[0-9]{0,5})?([/?#]\S*)?$")
    return F.when(good & (F.regexp_replace(part(3), "/", "") != ""), whole)


def canonical_url(url: Column, drop: tuple[str, ...] = ()) -> Column:
    """An absolute address without fragment and without utm_, click and declared parameters."""
    gone = (*PAGE_TRACKING, *drop)
    name = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    kept = F.filter(parameters(url), lambda p: ~(name(p).startswith("utm_") | name(p).isin(*gone)))
    place = F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)  # host and port: another port is another site
    base = F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), F.lower(place), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    return F.when(valid_url(url), _queried(base, kept))


def detail_url(url: Column, prefixes: tuple[str, ...]) -> Column:
    """Is it an allowed prefix and one opaque segment?"""
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")).rlike("^(" + "|".join(prefixes) + ")/[A-Za-z0-9_-]+/?$"), F.lit(False))


def external_id(url: Column) -> Column:
    """The last path segment, or the hash of the address."""
    last = F.element_at(F.split(path(url), "/"), -1)
    return F.when(last != "", last).otherwise(F.sha2(url, 256))


def safe_component(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "-"), r"^[.-]+|[.-]+$", "")


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


# Path segments of account pages.
ACCOUNT = ("login", "logout", "signin", "signup", "auth", "account", "profile", "checkout", "tickets", "wallet", "admin")
_ADDRESS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\\\s]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _ADDRESS, k)


def _without_dots(path: Column) -> Column:
    """A path whose . and .. segments are resolved; none above the root."""
    parts = F.split(path, "/")
    step = lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(p)))
    done = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step)
    ends = F.element_at(parts, -1).isin(".", "..")
    return F.when(path == "", path).otherwise(F.concat(F.array_join(done, "/"), F.when(ends, "/").otherwise("")))


def joined_address(href: Column, base: Column) -> Column:
    """The absolute address that a link on a page names, without its fragment; null for white space or control characters in it."""
    bare, scheme, place, path = F.regexp_replace(href, "#.*$", ""), _part(base, 1), _part(base, 2), _part(base, 3)
    origin = F.concat(scheme, F.lit("://"), place)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    split = lambda whole: F.concat(_without_dots(F.regexp_extract(whole, r"^([^?]*)", 1)), F.regexp_extract(whole, r"^[^?]*(\?.*)?$", 1))
    out = (
        F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), bare).when(bare.startswith("//"), F.concat(scheme, F.lit(":"), bare)).when(bare == "", F.concat(origin, path, _part(base, 4)))
        .when(bare.startswith("?"), F.concat(origin, path, bare)).when(bare.startswith("/"), F.concat(origin, split(bare))).otherwise(F.concat(origin, split(F.concat(folder, bare))))
    )
    return F.when(~href.rlike(r"[\s\x00-\x1f]"), out)


def approved_address(url: Column, base: Column, drop: tuple[str, ...] = ()) -> Column:
    """An address of the same scheme, host and port as ``base``, without fragment and tracking parameters, else null.

    Also null: credentials, account pages, and paths that are encoded twice or
    hold dots as segments, backslashes or control characters.
    """
    port = lambda u: F.coalesce(F.nullif(F.regexp_extract(_part(u, 2), r":([0-9]+)$", 1), F.lit("")), F.when(F.lower(_part(u, 1)) == "https", "443").otherwise("80"))
    host_ = lambda u: F.lower(F.regexp_replace(_part(u, 2), r":[0-9]*$", ""))
    same = (F.lower(_part(url, 1)) == F.lower(_part(base, 1))) & (host_(url) == host_(base)) & (port(url) == port(base))
    plain = F.try_url_decode(F.replace(_part(url, 3), F.lit("+"), F.lit("%2B")))
    refused = plain.isNull() | plain.rlike(r"[%\\\x00-\x1f]") | F.exists(F.split(F.lower(plain), "/"), lambda p: p.isin(*ACCOUNT, ".", ".."))
    good = F.lower(_part(url, 1)).isin("http", "https") & (host_(url) != "") & ~F.contains(_part(url, 2), F.lit("@")) & ~url.rlike(r"[\s\\\x00-\x1f]")
    name = lambda p: F.lower(F.coalesce(F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))), F.lit("")))
    kept = F.filter(F.split(F.substring(_part(url, 4), F.lit(2), F.char_length(url)), "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(*PAGE_TRACKING, *drop))
    query = F.array_join(kept, "&")
    whole = F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)), F.when(_part(url, 3) == "", "/").otherwise(_part(url, 3)), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(same & good & ~refused, whole)


def detail_address(url: Column, base: Column, prefixes: tuple[str, ...], drop: tuple[str, ...] = ()) -> Column:
    """``approved_address`` of a detail: one opaque segment after an allowed folder; else null."""
    whole = approved_address(url, base, drop)
    allowed = "|".join(re.escape(p) for p in prefixes)
    return F.when(_part(whole, 3).rlike(f"^(?:{allowed})[A-Za-z0-9_-]+/?$"), whole)
