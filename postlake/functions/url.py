"""URLs as column expressions: canonical form, tracking parameters, domains, identity, relative references."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postlake.functions import vocabulary as V

_URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _parts(url: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Scheme, host (lower case, no trailing dot), port, path and query."""
    u = F.trim(url)
    scheme, authority, path, query = (F.regexp_extract(u, _URL, i) for i in (1, 2, 3, 4))
    authority = F.regexp_replace(authority, "^.*@", "")
    host = F.regexp_replace(F.lower(F.regexp_replace(authority, r":\d*$", "")), r"\.+$", "")
    return F.lower(scheme), host, F.regexp_extract(authority, r":(\d+)$", 1), path, query


def _own_port(scheme: Column, port: Column) -> Column:
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when(usual, "").otherwise(F.concat(F.lit(":"), port))


def is_tracking(name: Column) -> Column:
    n = F.lower(name)
    found = n.isin(*V.TRACKING)
    for prefix in V.TRACKING_PREFIXES:
        found = found | n.startswith(prefix)
    return found


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonicalize_url(url: Column) -> Column:
    """One form for all addresses of a page; null unless it's http(s) with a host.

    https, lower-case host without www., no default port, user, fragment, repeated or trailing slashes,
    blank or tracking parameters; other parameters sorted.
    """
    scheme, host, port, path, query = _parts(url)
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(path, "/+", "/")
    path = F.regexp_replace(path, r"[/\s]+$", "")  # white space, too, so that a path is the same with and without what followed it
    path = F.when(path == "", "/").otherwise(path)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=.")), lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    pairs = F.array_sort(F.filter(pairs, lambda p: ~is_tracking(p.k)))
    kept = F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p.k), F.lit("="), _encoded(p.v))), "&")
    made = F.concat(F.lit("https://"), host, _own_port(scheme, port), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(scheme.isin("http", "https") & (host != ""), made)


def registrable_domain(host_or_url: Column) -> Column:
    """The last two labels of a host, three below domains such as co.uk."""
    t = F.lower(F.trim(host_or_url))
    host = F.when(t.contains("://"), _parts(t)[1]).otherwise(t)
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    take = F.when(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").isin(*V.TWO_LEVEL), 3).otherwise(2)
    start = F.greatest(F.size(labels) - take + 1, F.lit(1))
    return F.array_join(F.slice(labels, start, F.lit(3)), ".")


def locator(value: Column) -> Column:
    """Identity of a board: a lower-case token, or a URL without default port, fragment and trailing slash, its query kept."""
    scheme, host, port, path, query = _parts(value)
    url = F.concat(scheme, F.lit("://"), host, _own_port(scheme, port), F.regexp_replace(path, "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.trim(value).rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.lower(F.trim(value)))


def resolve(base: Column, reference: Column) -> Column:
    """A reference against its page's URL: absolute, protocol-relative, from the root, or beside the page."""
    scheme, origin = F.regexp_extract(base, "^([a-z]+):", 1), F.regexp_extract(base, "^([a-z]+://[^/?#]*)", 1)
    page = F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(page.rlike("^[a-z]+://[^/]*$"), F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    return (
        F.when(reference.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), reference)
        .when(reference.startswith("//"), F.concat(scheme, F.lit(":"), reference))
        .when(reference.startswith("/"), F.concat(origin, reference))
        .otherwise(F.concat(folder, reference))
    )


def is_public_host(host: Column) -> Column:
    """Whether a host is a name, or an IPv4 address outside private, loopback, link-local, shared, multicast and reserved ranges."""
    parts = F.transform(F.split(host, r"\."), lambda x: x.try_cast("int"))
    is_ip = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    a, b = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    closed = (a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)))
    return F.when(is_ip, ~closed).otherwise((host != "") & (host != "localhost"))


def allowed_host(host: Column, allowed: list[str]) -> Column:
    """Whether a host is one of ``allowed`` or below one."""
    found = F.lit(False)
    for x in allowed:
        found = found | (host == x) | host.endswith("." + x)
    return found


def safe_segment(text: Column) -> Column:
    """A name that's safe as one segment of a path."""
    t = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-"), r"^[.-]+|[.-]+$", "")
    return F.when(t == "", "x").otherwise(F.substring(t, 1, 120))
