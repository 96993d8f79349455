"""Validation of hosts and addresses."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public generic top-level domains, and country domains in other scripts. Any two Latin
# letters count as a country's. Options.suffixes takes a full list instead.
GENERIC = (
    "com org net edu gov mil int arpa info biz name pro aero coop museum mobi jobs travel tel cat asia post xxx app dev io ai online site store shop blog cloud tech xyz top club "
    "live news world email media agency company digital network systems solutions services support team group global today space website page link click win bid loan work life "
    "example invalid test localhost คอม рф 中国 香港 台湾 한국 भारत"
).split()
# IPv4 networks that are private, shared or reserved (IANA special-purpose registry).
NOT_GLOBAL = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/29 192.0.0.8/32 192.0.0.11/32 192.0.0.12/30 192.0.0.16/28 192.0.0.32/27 192.0.0.64/26 192.0.0.128/25 "
    "192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4"
).split()
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
VALID_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def host_part(text: Column) -> Column:
    """What follows the last @, without brackets and white space at its ends and without a zone."""
    host = F.regexp_replace(F.element_at(F.split(text, "@"), -1), r"^[ \r\n\t\[\]]+|[ \r\n\t\[\]]+$", "")
    return F.split_part(host, F.lit("%"), F.lit(1))


def is_ipv4(host: Column) -> Column:
    return F.rlike(host, F.lit(VALID_IPV4))


def ipv4_number(host: Column) -> Column:
    parts = F.split(host, r"\.")
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.try_cast("long"))


def is_global_ipv4(host: Column) -> Column:
    n, inside = ipv4_number(host), F.lit(False)
    for net in map(ipaddress.ip_network, NOT_GLOBAL):
        inside = inside | n.between(int(net.network_address), int(net.broadcast_address))
    return ~inside


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ipv6_groups(text: Column) -> Column:
    """The eight numbers of an IPv6 address (RFC 4291, with dotted last 32 bits, too), or null."""
    number = lambda g: F.conv(g, 16, 10).cast("int")
    pair = lambda o, k: F.lower(F.hex(o[k].cast("int") * 256 + o[k + 1].cast("int")))
    dotted = F.regexp_extract(text, r"([0-9.]+)$", 1)
    octets = F.split(dotted, r"\.")
    plain = F.when(F.rlike(dotted, F.lit(VALID_IPV4)), F.concat(F.left(text, F.length(text) - F.length(dotted)), pair(octets, 0), F.lit(":"), pair(octets, 2))).otherwise(text)

    def spread(t: Column) -> Column:
        some = lambda s: F.filter(F.split(s, ":"), lambda g: F.length(g) > 0)
        left, right, cut = some(F.split_part(t, F.lit("::"), F.lit(1))), some(F.split_part(t, F.lit("::"), F.lit(2))), F.contains(t, F.lit("::"))
        zeros = F.lit(8) - F.size(left) - F.size(right)
        whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(zeros, F.lit(0))), right)
        good = F.rlike(t, F.lit(r"^(?i)(?!.*::.*::)(?!:[^:])(?!.*:::)(?!.*[^:]:$)[0-9a-f:]+$")) & F.when(cut, zeros > 0).otherwise(zeros == 0) & ~F.exists(whole, lambda g: F.length(g) > 4)
        return F.when(good, F.transform(whole, number))

    return _let(plain, spread)


def ipv6_short(groups: Column) -> Column:
    """The text of RFC 5952: lower case, the first longest run of zeros (two or more) as ::; IPv4-mapped addresses end dotted."""

    def short(t: Column) -> Column:
        out = t
        for n in range(2, 9):
            run = rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?:$|:)(.*)$"
            out = F.when(F.rlike(t, F.lit(run)), F.regexp_replace(t, run, "$1::$2")).otherwise(out)
        return out

    octets = [F.floor(groups[k] / 256) if high else groups[k] % 256 for k in (6, 7) for high in (True, False)]
    mapped = (groups[5] == 0xFFFF) & (F.aggregate(F.slice(groups, 1, 5), F.lit(0), lambda a, g: a + g) == 0)
    return F.when(mapped, F.concat(F.lit("::ffff:"), F.concat_ws(".", *octets))).otherwise(_let(F.array_join(F.transform(groups, lambda g: F.lower(F.hex(g))), ":"), short))


def ipv6_global(groups: Column) -> Column:
    """Neither private nor reserved (IANA's special-purpose registry): global unicast without its special blocks, multicast, site-local."""
    a, b, c, tail = groups[0], groups[1], groups[2], F.aggregate(F.slice(groups, 3, 5), F.lit(0), lambda x, g: x + g)
    # Global blocks inside 2001::/23.
    inside = ((b == 1) & (tail == 0) & groups[7].isin(1, 2)) | (b == 3) | ((b == 4) & (c == 0x112)) | b.between(0x20, 0x3F)
    special = (a == 0x2002) | ((a == 0x2001) & (((b < 0x200) & ~inside) | (b == 0xDB8))) | ((a == 0x3FFF) & (b < 0x1000))
    return (a.between(0x2000, 0x3FFF) & ~special) | (a >= 0xFEC0)


def is_global_ipv6(host: Column) -> Column:
    return F.coalesce(_let(ipv6_groups(host), ipv6_global), F.lit(False))


def has_suffix(host: Column, suffixes: tuple[str, ...] | None, known: bool) -> Column:
    """Any non-empty last label; or, if it has to be known, one that a rule covers.

    Rules as in public lists: a suffix, `*.` and a suffix for every label below it, or `!` and a host that is an exception to such a rule.
    """
    last = F.lower(F.element_at(F.split(host, r"\."), -1))
    if not known:
        return F.length(last) > 0
    if suffixes is None:
        return F.rlike(last, F.lit("^[a-z]{2}$")) | last.isin(GENERIC)
    labels = F.split(F.lower(host), r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    texts = lambda rules: F.array(*[F.lit(x) for x in rules]).cast("array<string>")
    plain = [x.lower().removeprefix("!") for x in suffixes if not x.startswith("*.")]
    wild = [x.lower()[2:] for x in suffixes if x.startswith("*.")]
    return F.arrays_overlap(tails, texts(plain)) | F.arrays_overlap(F.slice(tails, 2, F.greatest(F.size(tails) - 1, F.lit(0))), texts(wild))


def valid_host(text: Column, routable: bool = False, known: bool = False, suffixes: tuple[str, ...] | None = None) -> Column:
    """Host of an address, URL authority or bare name: its IPv4 or name, or null if it isn't valid.

    Text that looks like IPv4 but isn't (999.1.1.1) is judged as a name. IPv6 goes through valid_address.
    """
    host = host_part(text)
    ip = F.when(is_global_ipv4(host), host) if routable else host
    return F.when(is_ipv4(host), ip).when(has_suffix(host, suffixes, known), host)


def valid_address(text: Column, routable: bool = False, known: bool = False, suffixes: tuple[str, ...] | None = None) -> Column:
    """As valid_host; hosts with a colon are read as IPv6 and written in their short form."""
    host = host_part(text)
    groups = F.when(F.contains(host, F.lit(":")), ipv6_groups(host))
    six = _let(groups, lambda g: F.when(g.isNotNull() & (ipv6_global(g) if routable else F.lit(True)), ipv6_short(g)))
    return F.when(groups.isNotNull(), six).otherwise(valid_host(text, routable, known, suffixes))


def valid_ipv4s(found: Column, routable: bool = False) -> Column:
    """Keep valid IPv4 of an array; what only looks like one stays (a name, as any last label will do)."""
    keep = F.filter(found, lambda x: ~is_ipv4(x) | is_global_ipv4(x)) if routable else found
    return keep


def valid_ipv6s(found: Column, routable: bool = False) -> Column:
    """Short forms of the valid IPv6 of an array."""
    groups = F.filter(F.transform(found, ipv6_groups), lambda g: g.isNotNull())
    return F.transform(F.filter(groups, ipv6_global) if routable else groups, ipv6_short)
