"""Patterns for the JVM's regular expressions, from the grammars of RFC 1123, 3986, 4291, 5321 and 5322.

Runs are possessive and begin after a character of another kind (or where the last match ended), so
that long runs without a match cost linear time and no stack. URLs are taken as runs of URL characters and
trimmed afterwards, links as the attributes of a tag: each pattern does one step.
"""

# Characters of a local part (atoms of RFC 5322, dots, and the separators , and /) and of a host label.
LOCAL = r"a-zA-Z0-9.!#$%&'*+,\-/=?^_`{|}~"
LABEL = "a-zA-Z0-9-"
#: Characters of a host label at most.
LONGEST = 63

EMAIL = rf"((?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++(?:\.[{LABEL}]++)*+)"
EMAIL_WITH_TLD = rf"((?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++(?:\.[{LABEL}]++)++)"
ENCODED_WORD = r"=\?[^\s?]++\?[BbQq]\?[^\s?]*+\?="

#: Two labels or more; but for the first they have two characters or more, so that "e.g" and versions aren't hosts.
_NAME = rf"[{LABEL}]{{1,{LONGEST}}}+(?:\.[{LABEL}]{{2,{LONGEST}}}+)++"
# What may stand before and after a host in a text.
BEFORE_HOST, AFTER_HOST = r"\s(/<>|@'=", r"\s)/<>?#&'"
HOST = rf"(?<![^{BEFORE_HOST}])({_NAME})(?![^{AFTER_HOST}])"
RECEIVED_HOST = rf"(?:from|by)\s+({_NAME})"
#: Any text with a host has this, and any with an IPv4 address.
HOST_SIGN, IPV4_SIGN = rf"\.[{LABEL}]{{2}}", r"\.[0-9]{1,3}\.[0-9]"
IPV4 = r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"


def ipv6() -> str:
    """RFC 4291 text forms: up to n groups, ::, and what is left; the last 32 bits may be dotted."""
    group = "[0-9a-f]{1,4}"
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    last = rf"(?:{group}:{group}|(?:{octet}\.){{3}}{octet})"
    forms = [f"(?:{group}:){{6}}{last}", f"::(?:{group}:){{5}}{last}"]
    for before in range(7):
        head = f"(?:(?:{group}:){{0,{before}}}{group})?::"
        forms.append(head + (f"(?:{group}:){{{4 - before}}}{last}" if before < 5 else group if before == 5 else ""))
    return f"(?i)({'|'.join(forms)})"


IPV6 = ipv6()
#: Any text with an IPv6 address has this; as the other signs it begins with one fixed character, which is quick to find.
IPV6_SIGN = ":(?::|(?:[0-9A-Fa-f]{1,4}:){5})"

_QUOTES = "«»“”‘’"
#: Reserved and unreserved characters and the per cent sign of RFC 3986, and what RFC 3987 and careless senders add: all beyond
#: Latin-1's controls but white space and quotes.
_URL_CHARACTER = rf"[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%\x{{A1}}-\x{{10FFFF}}&&[^\s{_QUOTES}]]"
_HOST_CHARACTER = rf"[\w\-\x{{A1}}-\x{{10FFFF}}&&[^\s{_QUOTES}]]"
_SCHEMES = "(?:https?|ftps?)"
_WITH_SCHEME = rf"\b{_SCHEMES}:{_URL_CHARACTER}++"
#: Without a scheme only www hosts that something follows, at the start of a word or a quotation.
_WITHOUT_SCHEME = rf"(?<![^\s'\"{_QUOTES}])www[0-9]{{0,3}}(?:\.{_HOST_CHARACTER}{{1,{LONGEST}}}+)++\.*+(?::[0-9]{{1,5}}+)?[/?#]{_URL_CHARACTER}*+"
URL = f"(?iU)({_WITH_SCHEME})"
URL_OR_WWW = f"(?iU)({_WITH_SCHEME}|{_WITHOUT_SCHEME})"
#: What ends a sentence or a quotation and no URL, but for the brackets of an IPv6 host.
_NO_END = r"!;:.,'\[\]"
URL_END = rf"(?i)^({_SCHEMES}:/*+\[[^\]]*+\])[{_NO_END}]*+$|[{_NO_END}]++$"
#: Commas between URLs that are written in one word.
GLUED = rf"(?i),(?={_SCHEMES}:)"
GLUED_WWW = rf"(?i),(?={_SCHEMES}:|www[0-9]{{0,3}}\.)"

#: Name and attributes of links and images; quoted values may hold >, and the last quotation may lack its end.
LINK_TAG = r"(?i)<((?:a|img)[\s/](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:[\"'][^<>]*+)?)"


def attribute(name: str) -> str:
    """The value of an attribute, with the quote that opens it."""
    return rf"(?i)(?<=[\s/\"']){name}\s*+=\s*+(\"[^\"]*+|'[^']*+|[^\s\"'<>]++)"


INNERMOST = r"\([^()]*\)"
#: Levels of parentheses in one match.
DEEPEST = 64


def parentheses() -> str:
    """A parenthesised part with no more levels in it; each position is read by as many attempts as there are levels, at most."""
    out = r"\([^()]*+\)"
    for _ in range(DEEPEST - 1):
        out = rf"\((?:[^()]++|{out})*+\)"
    return out


PARENTHESES = parentheses()
EDGES = r"^[;\s]+|[;\s]+$"
