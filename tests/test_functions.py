"""Column functions on inputs of our own."""

import datetime

import pytest
from pyspark.sql import functions as F

from mailframe.config import Options
from mailframe.functions import dates, decoding, extract, hashing, hosts, text
from mailframe.functions import patterns as P


def one(spark, column, value=""):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("r")).first().r


def many(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.r for r in rows.select("i", column(F.col("s")).alias("r")).orderBy("i").collect()]


def test_emails(spark):
    s = "Ann.Lee+x@Mail.Example.com, <bob@localhost> a@b/c@d.org x@ y@-z.de Ann.Lee+x@mail.example.com"
    assert one(spark, extract.emails, s) == ["ann.lee+x@mail.example.com", "bob@localhost", "a@b", "/c@d.org", "y@-z.de"]
    assert one(spark, lambda c: extract.emails(c, Options(email_needs_tld=True)), s) == ["ann.lee+x@mail.example.com", "b/c@d.org", "y@-z.de"]
    assert one(spark, extract.emails, None) == [] and one(spark, extract.emails, "a" * 60000) == []


def test_domains(spark):
    s = "see www.Example.com and (sub.example.org) but not example.net. nor example.de:80; 'x-y.example.fr'\nlast.example.it"
    assert one(spark, extract.domains, s) == ["www.example.com", "sub.example.org", "x-y.example.fr", "last.example.it"]
    assert one(spark, extract.domains, f"{'l' * 64}.example.com {'l' * 63}.example.org") == ["l" * 63 + ".example.org"]
    assert one(spark, extract.domains, "<sub.example.org>/a.bc#") == ["sub.example.org", "a.bc"]


def test_ips(spark):
    s = "8.8.8.8 and 10.0.0.1, 999.1.1.1 [2001:DB8::1] 2606:2800:220:1:248:1893:25c8:1946 fe80::1 1.2.3"
    got = one(spark, extract.ips, s)
    assert got[:3] == ["8.8.8.8", "10.0.0.1", "999.1.1.1"] and {"2001:db8::1", "2606:2800:220:1:248:1893:25c8:1946", "fe80::1"} <= set(got)
    assert one(spark, lambda c: extract.ips(c, Options(ip_routable=True)), s) == ["8.8.8.8", "999.1.1.1", "2606:2800:220:1:248:1893:25c8:1946"]
    assert one(spark, lambda c: extract.ipv4s(c, Options(ip_whitelist=("8.8.8.8",))), s) == ["10.0.0.1", "999.1.1.1"]


@pytest.mark.parametrize(("s", "want"), [
    ("go to http://a.example.com/x?y=1&amp;z=2#f now", ["http://a.example.com/x?y=1&z=2#f"]),
    ("(https://b.example.com/), 'FTP://c.example.com/?'", ["https://b.example.com/", "ftp://c.example.com/"]),
    ("http://a.example.com,https://b.example.com/p,www3.example.com/q", ["http://a.example.com", "https://b.example.com/p", "www3.example.com/q"]),
    ("www.example.com is bare, www.example.com/path isn't, not.www.example.com/x", ["www.example.com/path"]),
    ("<a class=x href=\"example.com/a b\">", ["example.com/a"]), ("<img alt='' src='//cdn.example.com/i.png'>", []), ("<a href='/relative.html'>", []),
    ("http://localhost/ http://[2001:db8::1]/x hxxp://d.example.com", ["http://[2001:db8::1]/x"]),
    ("http://bücher.example/ä http://💌.example.com/📮", ["http://bücher.example/ä", "http://💌.example.com/📮"]),
    ("http://e.example.com..../p", ["http://e.example.com..../p"]), ("http://user:pw@f.example.com:8080/", ["http://user:pw@f.example.com:8080/"]),
])
def test_urls(spark, s, want):
    assert one(spark, extract.urls, s) == want


def test_url_options(spark):
    s = "www.example.com/a http://x.example.com <a href=y.example.com> http://z.example.jpg/ http://[fe80::1%25eth0]/b http://[2606:2800:220:1::1]/"
    assert "www.example.com/a" not in one(spark, lambda c: extract.urls(c, Options(www=False)), s)
    assert "y.example.com" not in one(spark, lambda c: extract.urls(c, Options(href=False)), s)
    assert "http://z.example.jpg/" not in one(spark, lambda c: extract.urls(c, Options(domain_needs_tld=True)), s)
    assert [u for u in one(spark, lambda c: extract.urls(c, Options(ip_routable=True)), s) if "[" in u] == ["http://[2606:2800:220:1::1]/"]


def test_long_texts_do_not_backtrack(spark):
    s = "http://xxx.example.com" + "�" * 30000 + " " + "a." * 30000 + " " + "www." * 3000
    assert one(spark, extract.urls, s)[0].startswith("http://xxx.example.com")


def test_hosts(spark):
    v = lambda c: hosts.valid_address(c)
    assert many(spark, v, ["a@[10.0.0.1]", "fe80:0::1%eth0", "host", "x@y.example ", "", "01.2.3.4"]) == ["10.0.0.1", "fe80::1", "host", "y.example", None, "01.2.3.4"]
    known = lambda c: hosts.valid_host(c, known=True, suffixes=("co.uk", "com"))
    assert many(spark, known, ["a.co.uk", "a.uk", "b.com", "com.x"]) == ["a.co.uk", None, "b.com", None]
    import ipaddress

    for ip in ("1.1.1.1", "10.1.1.1", "100.64.0.1", "192.0.0.9", "192.0.0.170", "198.19.0.1", "224.0.0.1", "240.0.0.1", "255.255.255.255", "172.32.0.1"):
        a = ipaddress.ip_address(ip)
        assert one(spark, hosts.is_global_ipv4, ip) == (a.is_global and not a.is_reserved), ip
    for ip in ("2606:2800::1", "2001:db8::1", "fe80::1", "::1", "2002::1", "2001:4860:4860::8888", "fc00::1"):
        a = ipaddress.ip_address(ip)
        assert one(spark, hosts.is_global_ipv6, ip) == (a.is_global and not a.is_reserved), ip


def test_ipv6_against_the_standard_library(spark):
    import ipaddress
    import random

    rng = random.Random(4)
    cases = ["::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:0:0:2:0:0:0:3", "1:0:0:2:0:0:3:4", "0:0:1:0:0:0:0:0", "::ffff:1.2.3.4", "::1.2.3.4", "64:ff9b::8.8.8.8", "1:2:3:4:5:6:1.2.3.4", "ABCD:00EF::0001",
             ":::", "1::2::3", "1:2:3", "12345::", "1:2:3:4:5:6:7:8:9", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "g::", "::300.1.1.1", "2001:1::1", "2001:1::2", "2001:1::4", "2001:3::9", "2001:4:112::1", "2001:4:113::1", "2001:20::1", "2001:3f::1", "2001:40::",
             "2002::1", "3fff:1000::1", "fec0::1", "ff02::1", "fe80::1", "fc00::1", "100::1", "4000::1"]
    for _ in range(150):
        cases.append(":".join(f"{rng.choice([0, 0, 0, 1, rng.randrange(65536)]):x}" for _ in range(8)))

    def parsed(t):
        try:
            return ipaddress.IPv6Address(t)
        except ValueError:
            return None

    assert many(spark, lambda c: hosts.ipv6_short(hosts.ipv6_groups(c)), cases) == [a and str(a) for a in map(parsed, cases)]
    assert many(spark, hosts.is_global_ipv6, cases) == [bool(a) and a.is_global and not a.is_reserved for a in map(parsed, cases)]


def test_suffix_rules(spark):
    known = lambda c: hosts.valid_host(c, known=True, suffixes=("uk", "co.uk", "*.ck", "!www.ck"))
    assert many(spark, known, ["a.co.uk", "ck", "x.ck", "a.x.ck", "www.ck", "a.www.ck", "a.com"]) == ["a.co.uk", None, "x.ck", "a.x.ck", "www.ck", "a.www.ck", None]


def test_text(spark):
    assert many(spark, text.without_parentheses, ["a(b(c)d)e", "(x", "((a)", "plain", None, "(" * 500 + "x" + ")" * 500 + "y", "()" * 4000 + "z"]) == ["ae", "(x", "(", "plain", None, "y", "z"]
    assert many(spark, text.trim_edges, [" ; a;b ;\n", "", ";"]) == ["a;b", "", ""]
    assert many(spark, text.file_extension, ["a.TXT", "a.tar.gz", "noext", ".hidden", "dir.x/file"]) == ["txt", "gz", None, None, None]
    import html

    cases = ["a&amp;lt;b", "&lt;&gt;", "&amp;#38;", "&#38;amp;", "&copy=1&notit;&eacute", "&#x1F600;&#0;&#xD800;&#99999999;", "&#150;&#x96;", "&", "&&;", "&nosuch;", "plain", "&CounterClockwiseContourIntegral;&lt"]
    assert many(spark, text.unescape_entities, cases) == [html.unescape(c) for c in cases]


def test_encoded_words(spark):
    cases = {
        "=?utf-8?q?Caf=C3=A9?=": "Café", "=?ISO-8859-1?B?R3L832U=?= x": "Grüße x", "a =?utf-8?b?YQ==?= =?utf-8?b?Yg==?= c": "a ab c", "plain": "plain", "=?utf-8?q?under_score?=": "under score",
        "=?utf-8?b?w6Q?=": "ä", "=?unknown-x?q?abc?=": "abc", "=?utf-8?q?a?=b": "ab", "=?utf-8?b?4pw=?= =?utf-8?b?kw==?=": "✓",
    }
    assert many(spark, decoding.decoded_field, list(cases)) == list(cases.values())
    assert one(spark, decoding.decoded_strictly, "=?utf-8?q?Caf=C3=A9?=") == "Café"
    assert decoding.decode_bytes("é".encode("latin-1")) and decoding.decode_bytes("é".encode(), "nonsense") == "é"


def test_dates(spark):
    values = ["Fri, 26 Apr 2013 13:15:55 +0200 (CEST)", "1 jan 2020 00:00:00 GMT", "26 Apr 2013 13:15", "junk", "", "Mon, 01 Jan 0001 00:00:00 +0000", "2021-03-04T05:06:07+01:00"]
    utc = lambda *a: datetime.datetime(*a)
    want = [utc(2013, 4, 26, 11, 15, 55), utc(2020, 1, 1), utc(2013, 4, 26, 13, 15), utc(1970, 1, 1), utc(1970, 1, 1), utc(1970, 1, 1), utc(2021, 3, 4, 4, 6, 7)]
    assert many(spark, lambda c: dates.parse_or_epoch(c).cast("timestamp_ntz"), values)[:5] == want[:5]
    assert many(spark, lambda c: dates.robust(c).cast("timestamp_ntz"), values) == want
    assert many(spark, dates.robust_iso, ["Wed, 1 Jul 2020 10:00:00 -0330", "Wed Jul 2020 09:08:07"]) == ["2020-07-01T10:00:00-03:30", "2020-07-01T09:08:07+00:00"]


def test_hashing(spark):
    import hashlib

    for kind in hashing.KINDS:
        assert one(spark, lambda c, k=kind: hashing.digest(c, k), "ä") == hashlib.new(kind, "ä".encode()).hexdigest()
    with pytest.raises(ValueError):
        hashing.digest(F.col("s"), "crc")
    assert one(spark, lambda c: hashing.media_signature(F.encode(c, "utf-8"))["mime_type_short"], "%PDF-1.7") == "application/pdf"


def test_parentheses_up_to_a_depth_take_one_match(spark):
    import re

    deep = lambda n: "(" * n + "x" + ")" * n
    assert many(spark, lambda c: F.regexp_replace(c, P.PARENTHESES, ""), [deep(P.DEEPEST), f"a(b{deep(P.DEEPEST - 1)}c", "((a)", ")(", "(a)(b"]) == ["", "a(bc", "(", ")(", "(b"]
    cases = [deep(P.DEEPEST), deep(P.DEEPEST + 1), "(y" + deep(P.DEEPEST), "(" * 3000 + deep(40), "(a\n(b)) c)("]
    want = []
    for text_ in cases:
        while (shorter := re.sub(P.INNERMOST, "", text_)) != text_:
            text_ = shorter
        want.append(text_)
    assert many(spark, text.without_parentheses, cases) == want


def test_names_of_entities_are_in_short_lists():
    import json
    from html.entities import html5

    buckets = json.loads(text._entities())
    assert {k: v for b in buckets for k, v in b.items()} == html5 and max(map(len, buckets)) <= 16


@pytest.mark.parametrize(("sign", "pattern", "with_it", "without"), [
    ("HOST_SIGN", "HOST", ["a.bc", "x (m.x-y.de)", "1.22.3a"], ["Ends here. And e.g. here, v1.2 or .", "a.b"]),
    ("IPV4_SIGN", "IPV4", ["1.2.3.4", "x999.999.999.999y"], ["1.5 and 2.", "1.2"]),
    ("IPV6_SIGN", "IPV6", ["::1", "a::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "::ffff:1.2.3.4", "1::2"], ["12:30:45", "note: a:b:c:d:e"]),
])
def test_signs_are_in_all_that_is_found(spark, sign, pattern, with_it, without):
    check = lambda c: F.struct(F.rlike(c, F.lit(getattr(P, sign))).alias("sign"), (F.size(extract.found(c, getattr(P, pattern))) > 0).alias("found"))
    assert [tuple(r) for r in many(spark, check, with_it)] == [(True, True)] * len(with_it)
    assert [r.sign for r in many(spark, check, without)] == [False] * len(without)


def test_texts_without_a_sign_are_not_searched(spark):
    for column in (extract.emails, extract.domains, extract.links, extract.urls, extract.raw_ipv4s):
        plan = spark.range(1).select(column(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
        assert "CASE WHEN" in plan
    assert many(spark, extract.urls, ["HTTP://a.example.com/x", "httpſ://b.example.com/", "WWW.c.example.com/d", "FtP://e.example.com/f"]) == [["http://a.example.com/x"], ["httpſ://b.example.com/"], ["WWW.c.example.com/d"], ["ftp://e.example.com/f"]]
