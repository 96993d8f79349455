"""Indicators in a text: addresses, hosts, IPs, URLs. All are arrays of distinct values in order of appearance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Options
from . import hosts, text
from . import patterns as P


def found(s: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(pattern), F.lit(group))


def found_where(sign, s: Column, pattern: str) -> Column:
    """As found; only texts with a sign that any match has are searched, as a sign is cheap and most texts have none."""
    return F.when(sign(F.coalesce(s, F.lit(""))), found(s, pattern)).otherwise(F.array().cast("array<string>"))


def raw_hosts(s: Column) -> Column:
    return found_where(lambda t: F.rlike(t, F.lit(P.HOST_SIGN)), s, P.HOST)


def raw_ipv4s(s: Column) -> Column:
    return found_where(lambda t: F.rlike(t, F.lit(P.IPV4_SIGN)), s, P.IPV4)


def emails(s: Column, options: Options = Options()) -> Column:
    """Lower-cased addresses whose host is valid."""
    pattern = P.EMAIL_WITH_TLD if options.email_needs_tld else P.EMAIL
    some = F.transform(found_where(lambda t: F.contains(t, F.lit("@")), s, pattern), F.lower)
    return F.array_distinct(F.filter(some, lambda a: hosts.valid_host(a, options.ip_routable, options.domain_needs_tld, options.suffixes).isNotNull()))


def domains(s: Column, options: Options = Options()) -> Column:
    """Lower-cased host names that stand between delimiters."""
    some = F.transform(raw_hosts(s), F.lower)
    return F.array_distinct(F.filter(some, lambda a: hosts.valid_host(a, options.ip_routable, options.domain_needs_tld, options.suffixes).isNotNull()))


def ipv4s(s: Column, options: Options = Options()) -> Column:
    out = hosts.valid_ipv4s(raw_ipv4s(s), options.ip_routable)
    out = F.filter(out, lambda a: hosts.valid_host(a, options.ip_routable, options.domain_needs_tld, options.suffixes).isNotNull())
    return F.array_distinct(F.array_except(out, F.array(*[F.lit(w) for w in options.ip_whitelist])) if options.ip_whitelist else out)


def raw_ipv6s(s: Column) -> Column:
    """Matches of the address pattern, which is tried only on texts with a sign of one."""
    return found_where(lambda t: F.rlike(t, F.lit(P.IPV6_SIGN)), s, P.IPV6)


def ipv6s(s: Column, options: Options = Options()) -> Column:
    """Short forms of IPv6 addresses."""
    out = hosts.valid_ipv6s(raw_ipv6s(s), options.ip_routable)
    return F.array_distinct(F.array_except(out, F.array(*[F.lit(w) for w in options.ip_whitelist])) if options.ip_whitelist else out)


def ips(s: Column, options: Options = Options()) -> Column:
    return F.array_distinct(F.concat(ipv4s(s, options), ipv6s(s, options)))


def domains_and_ips(s: Column) -> Column:
    """Hosts and IPs of a fragment, unvalidated, sorted."""
    return F.array_sort(F.array_distinct(F.concat(raw_hosts(s), raw_ipv4s(s), raw_ipv6s(s))))


def encoded_words(s: Column) -> Column:
    """Whether a raw header field holds RFC 2047 encoded words."""
    return F.rlike(s, F.lit(P.ENCODED_WORD))


def has_scheme(url: Column) -> Column:
    """Whether :/ stands within the first ten characters."""
    return F.instr(F.substring(url, 1, 10), ":/") > 0


def url_host(url: Column) -> Column:
    """Authority without user and port, brackets off, lower-cased, without dots at its end; empty if there is none."""
    full = F.when(has_scheme(url), url).otherwise(F.concat(F.lit("none://"), url))
    authority = F.element_at(F.split(F.regexp_extract(full, r"^[^:/?#]*://([^/?#]*)", 1), "@"), -1)
    name = F.when(F.startswith(authority, F.lit("[")), F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)).otherwise(F.split_part(authority, F.lit(":"), F.lit(1)))
    return F.regexp_replace(F.lower(name), r"\.+$", "")


def clean_url(url: Column, options: Options = Options()) -> Column:
    """A raw match as a clean URL, or null. Relative links and dotless hosts are not URLs."""
    u = F.regexp_replace(F.regexp_replace(url, r"(?U)^[\s'\"‘’“”«»]+", ""), r"[\r\n]", "")
    u = F.regexp_replace(F.regexp_replace(u, r"^([^#]*)#$", "$1"), r"^([^?#]*)\?(?=#|$)", "$1")  # an empty fragment, then an empty query
    scheme = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    u = F.concat(F.lower(scheme), F.substring(u, F.length(scheme) + 1, F.length(u)))
    host = url_host(u)
    valid = F.when(F.contains(host, F.lit(":")), F.when(hosts.is_global_ipv6(F.split_part(host, F.lit("%"), F.lit(1))), host) if options.ip_routable else host).otherwise(hosts.valid_host(host, options.ip_routable, options.domain_needs_tld, options.suffixes))
    cut = F.regexp_extract(u, r"(?s)^([^', \")}\\]*)", 1)
    clean = F.when(F.contains(cut, F.lit("&")), text.unescape_entities(cut)).otherwise(cut)
    good = (F.contains(url, F.lit(".")) | F.contains(url, F.lit("["))) & (F.length(host) > 0) & valid.isNotNull() & ~F.endswith(cut, F.lit("://"))
    return F.when(good, clean)


def links(html: Column) -> Column:
    """Values of href in links and of src in images, without quotes."""
    value = lambda t: F.when(F.startswith(F.lower(t), F.lit("a")), F.regexp_extract(t, P.attribute("href"), 1)).otherwise(F.regexp_extract(t, P.attribute("src"), 1))
    return F.filter(F.transform(found_where(lambda t: F.contains(t, F.lit("<")), html, P.LINK_TAG), lambda t: F.regexp_replace(value(t), "^[\"']", "")), lambda v: F.length(v) > 0)


def raw_urls(s: Column, options: Options = Options()) -> Column:
    """Runs of URL characters in text (glued ones split, ends trimmed) and, if asked for, links."""
    signs = lambda t: F.contains(F.lower(t), F.lit("http")) | F.contains(F.lower(t), F.lit("ftp")) | F.contains(F.lower(t), F.lit("www"))
    out = F.flatten(F.transform(found_where(signs, s, P.URL_OR_WWW if options.www else P.URL), lambda u: F.split(u, P.GLUED_WWW if options.www else P.GLUED)))
    out = F.transform(out, lambda u: F.regexp_replace(u, P.URL_END, "$1"))
    return F.concat(out, links(s)) if options.href else out


def urls(s: Column, options: Options = Options()) -> Column:
    """Clean URLs."""
    return F.array_distinct(F.filter(F.transform(raw_urls(s, options), lambda u: clean_url(u, options)), lambda u: u.isNotNull()))
