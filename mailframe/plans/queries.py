"""Queries and their DuckDB oracles, by name.

Two families: extractors run on text columns, and round trips, which render mails or Received lines
from columns, parse them and must give the columns back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Options
from ..functions import dates, extract, hashing, hosts, text
from ..operators import bodies, indicators, received, report
from ..sources import mail, render

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out to three tasks for each core, and 24 at least.

    A table of short rows is one split or few, whatever number of rows it has; what is made of a row costs far more than to move it.
    """
    return df.repartition(max(24, 3 * df.sparkSession.sparkContext.defaultParallelism), *keys)


_EMAIL_SQL = r"([a-zA-Z0-9.!#$%&''*+,\-/=?^_`{|}~]+@[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)*)"
_IP_SQL = r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"


# ---- extraction from text --------------------------------------------------------------------


@query(f"SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{_EMAIL_SQL}'))) AS email FROM documents")
def extract_emails(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.explode(extract.emails(F.col("text"))).alias("email"))


@query(f"SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{_EMAIL_SQL[:-2]}+)'))) AS email FROM documents")
def extract_emails_with_tld(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.explode(extract.emails(F.col("text"), Options(email_needs_tld=True))).alias("email"))


@query(f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_IP_SQL}')) AS ip FROM documents")
def extract_ipv4(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.explode(extract.ipv4s(F.col("text"))).alias("ip"))


@query(rf"""
WITH f AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_IP_SQL}')) AS ip FROM documents),
n AS (SELECT *, list_transform(string_split(ip, '.'), lambda x: CAST(x AS BIGINT)) AS o, regexp_matches(ip, '(^|\.)0[0-9]') AS padded FROM f),
v AS (SELECT *, o[1] * 16777216 + o[2] * 65536 + o[3] * 256 + o[4] AS num, NOT padded AND list_max(o) <= 255 AS valid FROM n)
SELECT doc_id, ip FROM v WHERE NOT valid OR NOT (
  num < 16777216 OR o[1] IN (10, 127) OR o[1] >= 240 OR (o[1] = 100 AND o[2] BETWEEN 64 AND 127) OR (o[1] = 169 AND o[2] = 254) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31)
  OR (o[1] = 192 AND o[2] = 0 AND o[3] = 0 AND o[4] NOT IN (9, 10)) OR (o[1] = 192 AND o[2] = 0 AND o[3] = 2) OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 198 AND o[2] IN (18, 19))
  OR (o[1] = 198 AND o[2] = 51 AND o[3] = 100) OR (o[1] = 203 AND o[2] = 0 AND o[3] = 113))
""")
def extract_routable_ipv4(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.explode(extract.ipv4s(F.col("text"), Options(ip_routable=True))).alias("ip"))


#: Hosts, found by another route: each delimiter is doubled, so that two hosts can share one; labels are counted by repetition.
def _hosts_sql(text: str) -> str:
    doubled = rf"regexp_replace({text}, '([\s()/<>|@''=?#&])', '\1\1', 'g')"
    return rf"regexp_extract_all({doubled}, '(?:^|[\s(/<>|@''=])((?:[[:alnum:]]|-){{1,63}}(?:\.(?:[[:alnum:]]|-){{2,63}})+)(?:$|[\s)/<>?#&''])', 1)"


@query(f"SELECT DISTINCT page_id, lower(unnest({_hosts_sql("url || ' ' || html")})) AS domain FROM pages")
def extract_domains(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.explode(extract.domains(F.concat_ws(" ", "url", "html"))).alias("domain"))


_HOST = "lower(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1))"


@query(f"SELECT page_id, {_HOST} AS host, 'mx-' || page_id || '-' || {_HOST} AS inner_host FROM pages")
def hosts_in_parentheses(spark, sf):
    """As Received lines have them: name (other name) and (name)."""
    p = read(spark, sf, "pages")
    host = F.regexp_extract("url", "://([^/?#]+)", 1)
    found = extract.domains(F.concat(F.lit("from ("), host, F.lit(")(MX-"), F.col("page_id"), F.lit("-"), host, F.lit(")by x.y")))
    return p.select("page_id", found[0].alias("host"), found[1].alias("inner_host"))


@query("""SELECT page_id, split_part(piece, '"', 1) AS href FROM (SELECT page_id, unnest(string_split(html, '<a href="')[2:]) AS piece FROM pages)""")
def extract_hrefs(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.explode(extract.links(F.col("html"))).alias("href"))


@query("""
SELECT p_partkey, unnest(['/p/' || p_partkey || '?a=1>0', 'img/' || p_partkey || '.png', 'q' || p_partkey, 'open/' || p_partkey]) AS link FROM part
""")
def link_forms(spark, sf):
    """Values with quotes of both kinds, without any, and with one that doesn't end; attributes of other names and tags of others."""
    k = F.col("p_partkey").cast("string")
    html = F.concat(
        F.lit("<A class=x data-href='no' HREF = '/p/"), k, F.lit("?a=1>0'>t</a> <img alt=\"a > b\" src=\"img/"), k, F.lit(".png\"/> <abbr href=no> <a name=n href=q"), k, F.lit("> <link href=no> <a href=\"open/"), k, F.lit("></a>"),
    )
    return read(spark, sf, "part").select("p_partkey", F.explode(extract.links(html)).alias("link"))


@query("""
SELECT o_orderkey, unnest(['2001:db8::' || n, 'fe80:1::2:0:0:' || n, '::ffff:10.0.0.' || o_orderkey % 256, '1:2:3:4:5:6:7:' || n]) AS ip
FROM (SELECT o_orderkey, format('{:x}', o_orderkey % 65535 + 1) AS n FROM orders)
""")
def ipv6_forms(spark, sf):
    """Addresses in long forms, with zeros in two places, mapped from IPv4, and in full."""
    o, n = read(spark, sf, "orders"), F.hex(F.col("o_orderkey") % 65535 + 1)
    line = F.concat(
        F.lit("a 2001:0DB8:0000:0000:0000:0000:0000:"), F.lpad(n, 4, "0"), F.lit(" [fe80:0001:0:0:2:0:0:"), n, F.lit("] b"), F.lit(" ::FFFF:10.0.0."), F.col("o_orderkey") % 256, F.lit(" 1:2:3:4:5:6:7:"), n, F.lit(" 12:30:45 c"),
    )
    return o.select("o_orderkey", F.explode(extract.ipv6s(line)).alias("ip"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '2600:' || n || '::1' WHEN 1 THEN '2001:4:112::' || n WHEN 4 THEN 'ff02::' || n END AS ip
FROM (SELECT o_orderkey, format('{:x}', o_orderkey % 65535 + 1) AS n FROM orders)
""")
def routable_ipv6(spark, sf):
    """Global addresses, global blocks inside a special one, documentation, unique local and multicast addresses."""
    o, n, k = read(spark, sf, "orders"), F.lower(F.hex(F.col("o_orderkey") % 65535 + 1)), F.col("o_orderkey") % 5
    ip = F.when(k == 0, F.concat(F.lit("2600:"), n, F.lit("::1"))).when(k == 1, F.concat(F.lit("2001:4:112::"), n)).when(k == 2, F.concat(F.lit("2001:db8::"), n)).when(k == 3, F.concat(F.lit("fd00::"), n)).otherwise(F.concat(F.lit("ff02::"), n))
    return o.select("o_orderkey", F.try_element_at(extract.ipv6s(ip, Options(ip_routable=True)), F.lit(1)).alias("ip"))


@query("SELECT c_custkey, c_name || '<é>&amp;€ ' || c_custkey || '™ ©=1&nosuch; &' AS plain FROM customer")
def unescape_entities(spark, sf):
    c = spread(read(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")
    return c.select("c_custkey", text.unescape_entities(F.concat("c_name", F.lit("&lt;&eacute;&gt;&#38;amp;&#x20AC;&#32;"), "c_custkey", F.lit("&#153;&#32;&copy=1&nosuch; &"))).alias("plain"))


@query("""
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'a.example.co.uk' WHEN 1 THEN 'b.any.ck' WHEN 2 THEN 'www.ck' WHEN 3 THEN 'any.ck' END AS host FROM customer
""")
def suffix_rules(spark, sf):
    """A plain rule, one with a wildcard and an exception to it; a host above the wildcard and one under no rule."""
    k = F.col("c_custkey") % 6
    host = F.when(k == 0, "a.example.co.uk").when(k == 1, "b.any.ck").when(k == 2, "www.ck").when(k == 3, "any.ck").when(k == 4, "ck").otherwise("a.example.zz")
    return read(spark, sf, "customer").select("c_custkey", hosts.valid_host(host, known=True, suffixes=("co.uk", "*.ck", "!www.ck")).alias("host"))


@query("SELECT page_id, url FROM pages")
def extract_urls(spark, sf):
    """The url, from the middle of a sentence."""
    p = read(spark, sf, "pages")
    return p.select("page_id", F.explode(extract.urls(F.concat(F.lit("see <"), "url", F.lit(">, and ")))).alias("url"))


@query("SELECT page_id, rtrim(url, '#?') AS url FROM pages UNION ALL SELECT page_id, 'ftp://ftp.example.com/' || page_id FROM pages")
def extract_glued_urls(spark, sf):
    """URLs that commas glue together; the scheme in upper case."""
    p = read(spark, sf, "pages")
    glued = F.concat(F.regexp_replace("url", "^http", "HTTP"), F.lit(",FTP://ftp.example.com/"), F.col("page_id"), F.lit("?#"))
    return p.select("page_id", F.explode(extract.urls(glued)).alias("url"))


@query(r"""
SELECT page_id, 'uri' AS kind, replace(url, '&', '&') AS value FROM pages
UNION ALL SELECT page_id, 'uri_noscheme', 'www.' || regexp_extract(url, '://([^/]+)/', 1) || '/a?b=1&c=2' FROM pages
UNION ALL SELECT page_id, 'uri_noscheme', regexp_extract(url, '://([^/]+)/', 1) || '/img.png' FROM pages
""")
def split_urls_by_scheme(spark, sf):
    p = read(spark, sf, "pages")
    host = F.regexp_extract("url", "://([^/]+)/", 1)
    mixed = F.concat(F.lit("x "), "url", F.lit(" 'www."), host, F.lit("/a?b=1&amp;c=2' <img alt=1 src=\""), host, F.lit("/img.png\"> <a href='/relative.html'>y</a>"))
    out = indicators.body_indicators(p.select("page_id", mixed.alias("text")))
    return indicators.indicator_rows(out.withColumns({k: F.array().cast("array<string>") for k in ("email", "domain", "ip")}), "page_id")


@query("SELECT page_id, lower(regexp_extract(url, '://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host FROM pages")
def url_hosts(spark, sf):
    return read(spark, sf, "pages").select("page_id", extract.url_host(F.concat(F.regexp_replace("url", "://", "://me:x@"), F.lit(""))).alias("host"))


@query(f"""
SELECT doc_id, 'email' AS kind, count(DISTINCT v) AS n FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{_EMAIL_SQL}'))) AS v FROM documents) GROUP BY 1
UNION ALL SELECT doc_id, 'ip', count(DISTINCT v) FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_IP_SQL}')) AS v FROM documents) GROUP BY 1
""")
def indicator_counts(spark, sf):
    found = indicators.body_indicators(read(spark, sf, "documents").select("doc_id", "text"))
    rows = indicators.indicator_rows(found, "doc_id", kinds=("email", "ip"))
    return rows.groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query(f"""
WITH f AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{_EMAIL_SQL}'))) AS email FROM documents)
SELECT doc_id, string_agg(sha256(email), ',' ORDER BY sha256(email)) AS hashes FROM f GROUP BY doc_id
""")
def hashed_emails(spark, sf):
    found = read(spark, sf, "documents").select("doc_id", extract.emails(F.col("text")).alias("email")).filter(F.size("email") > 0)
    return found.select("doc_id", F.array_join(F.array_sort(hashing.hashed(F.col("email"))), ",").alias("hashes"))


@query(f"""
WITH f AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_IP_SQL}')) AS value FROM documents), w AS (SELECT DISTINCT value FROM f WHERE doc_id % 2 = 0)
SELECT doc_id, value FROM f WHERE value NOT IN (SELECT value FROM w)
""")
def whitelisted_ips(spark, sf):
    """IPs without those on a list; the list is the IPs of documents with even ids."""
    rows = read(spark, sf, "documents").select("doc_id", F.lit("ip").alias("kind"), F.explode(extract.ipv4s(F.col("text"))).alias("value"))
    return indicators.without_listed(rows, rows.filter("doc_id % 2 = 0")).select("doc_id", "value")


@query(rf"""
WITH f AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_IP_SQL}')) AS value FROM documents),
o AS (SELECT *, list_transform(string_split(value, '.'), lambda x: CAST(x AS BIGINT)) AS o FROM f WHERE NOT regexp_matches(value, '(^|\.)0[0-9]')),
r AS (SELECT n_nationkey::BIGINT * 167772160 AS low, n_nationkey::BIGINT * 167772160 + 150000000 AS high, n_name AS name FROM nation)
SELECT doc_id, value, name FROM o JOIN r ON o[1] * 16777216 + o[2] * 65536 + o[3] * 256 + o[4] BETWEEN low AND high WHERE list_max(o) <= 255
""")
def ip_ranges(spark, sf):
    """IPs by a table of ranges."""
    rows = read(spark, sf, "documents").select("doc_id", F.explode(extract.ipv4s(F.col("text"))).alias("value"))
    low = F.col("n_nationkey").cast("long") * 167772160
    ranges = read(spark, sf, "nation").select(low.alias("low"), (low + 150000000).alias("high"), F.col("n_name").alias("name"))
    return indicators.in_ranges(rows, ranges, 22).select("doc_id", "value", "name")


# ---- digests ---------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, octet_length(encode(text)) AS size FROM documents")
def digests(spark, sf):
    d = hashing.digests(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", d["md5"].alias("md5"), d["sha1"].alias("sha1"), d["sha256"].alias("sha256"), hashing.size(F.encode("text", "utf-8")).alias("size"))


@query()
def digest_sha512(spark, sf):
    return read(spark, sf, "documents").select("doc_id", hashing.digest(F.col("text"), "sha512").alias("sha512"))


@query("SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_bodies(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", hashing.digest(F.col("text"), "sha256").alias("hash"))
    return d.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/zip' END AS mime_type_short FROM part
""")
def media_signatures(spark, sf):
    head = F.when(F.col("p_partkey") % 4 == 0, "255044462D312E37").when(F.col("p_partkey") % 4 == 1, "89504E470D0A1A0A00").when(F.col("p_partkey") % 4 == 2, "504B030414").otherwise("AABB")
    return read(spark, sf, "part").select("p_partkey", hashing.media_signature(F.unhex(head))["mime_type_short"].alias("mime_type_short"))


# ---- text functions --------------------------------------------------------------------------


@query("SELECT c_custkey, c_name || '  ' || c_mktsegment AS bare FROM customer")
def strip_parentheses(spark, sf):
    c = spread(read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    line = F.concat(F.lit("(a)"), "c_name", F.lit("(b (c (d)) e) (f)"), F.lit(" "), "c_mktsegment", F.lit("(" * 40 + "x" + ")" * 40))
    return c.select("c_custkey", text.without_parentheses(line).alias("bare"))


@query("SELECT c_custkey, c_name AS trimmed FROM customer")
def trim_edges(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", text.trim_edges(F.concat(F.lit(" ;;\t "), "c_name", F.lit(" ; \n;"))).alias("trimmed"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[\s\x0B]+', ' ', 'g')) AS flat_md5 FROM documents")
def flatten_white(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(text.flatten_white(F.col("text"))).alias("flat_md5"))


_PAIRS = lambda: F.array(
    F.struct(F.lit("Content-Type").alias("name"), F.lit("text/plain").alias("value")),
    F.struct(F.lit("X-Name").alias("name"), F.col("c_name").alias("value")),
    F.struct(F.lit("x-name").alias("name"), F.col("c_mktsegment").alias("value")),
    F.struct(F.lit("X-Empty").alias("name"), F.lit("").alias("value")),
    F.struct(F.lit("Content-type").alias("name"), F.concat(F.lit("Text/"), "c_mktsegment", F.lit(" ; charset=x")).alias("value")),
)


@query("""
SELECT c_custkey, unnest(['content-type', 'x-name']) AS name, unnest(['text/plain|Text/' || c_mktsegment || ' ; charset=x', c_name || '|' || c_mktsegment]) AS all_values FROM customer
""")
def header_map(spark, sf):
    m = text.headers_map(_PAIRS())
    return read(spark, sf, "customer").select("c_custkey", F.explode(m).alias("name", "v")).select("c_custkey", "name", F.array_join("v", "|").alias("all_values"))


@query("SELECT c_custkey, 'Text/' || c_mktsegment AS media_type, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS kept FROM customer")
def content_headers(spark, sf):
    """Media type, and how many headers stay with one body and with two."""
    c = read(spark, sf, "customer").withColumn("m", text.headers_map(_PAIRS()))
    return c.select("c_custkey", text.media_type(F.col("m")).alias("media_type"), F.size(text.content_headers(F.col("m"), F.when(F.col("c_custkey") % 2 == 0, 1).otherwise(2))).alias("kept"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lower(p_brand[1:5]) WHEN 1 THEN 'gz' END AS extension FROM part")
def file_extensions(spark, sf):
    p, k = read(spark, sf, "part"), F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat("p_name", F.lit("."), F.substring("p_brand", 1, 5))).when(k == 1, F.concat("p_name", F.lit(".tar.GZ"))).otherwise(F.concat(F.lit(".hidden"), "p_partkey"))
    return p.select("p_partkey", text.file_extension(F.regexp_replace(name, " ", "_")).alias("extension"))


# ---- dates -----------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN date_trunc('minute', o_orderdate) WHEN 5 THEN TIMESTAMP '1970-01-01' ELSE date_trunc('second', o_orderdate) END AS parsed FROM orders
""")
def normalise_dates(spark, sf):
    """Eight ways of writing a date, one of them junk, two of them (C's, and years of two digits) beyond the common formats."""
    o, k, d = read(spark, sf, "orders"), F.col("o_orderkey") % 6, F.col("o_orderdate")
    odd = F.col("o_orderkey") % 12 >= 6
    line = (
        F.when((k == 0) & odd, F.date_format(d, "EEE MMM d HH:mm:ss yyyy"))
        .when((k == 2) & odd, F.date_format(d, "d MMM yy HH:mm:ss +0000"))
        .when(k == 0, F.date_format(d, "EEE, d MMM yyyy HH:mm:ss +0000"))
        .when(k == 1, F.concat(F.date_format(d + F.expr("INTERVAL 2 HOURS"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0200 (CEST)")))
        .when(k == 2, F.concat(F.date_format(d - F.expr("INTERVAL '03:30' HOUR TO MINUTE"), "d MMM yyyy HH:mm:ss"), F.lit(" -0330")))
        .when(k == 3, F.concat(F.date_format(d - F.expr("INTERVAL 5 HOURS"), "d MMM yyyy HH:mm:ss"), F.lit(" EST")))
        .when(k == 4, F.date_format(d, "d MMM yyyy HH:mm"))
        .otherwise("no date at all")
    )
    return o.select("o_orderkey", dates.robust(line).cast("timestamp_ntz").alias("parsed"))


# ---- the path of a mail ----------------------------------------------------------------------


def hop_lines(spark, sf) -> DataFrame:
    """One Received line for each order, some of them malformed."""
    o = read(spark, sf, "orders")
    key, k = F.col("o_orderkey"), F.col("o_orderkey") % 8
    name = F.concat(F.lit("Mx"), "o_custkey", F.lit(".Example.com"))
    ip = F.concat_ws(".", F.lit("10"), F.floor(key / 65536) % 256, F.floor(key / 256) % 256, key % 256)
    full = render.hop_line(name, ip, F.lit("relay.example.net"), F.lit("ESMTPS id A1"), F.concat(F.lit("U"), "o_custkey", F.lit("@example.org")), F.col("o_orderdate"))
    line = (
        F.when(k == 5, F.concat(F.lit("by edge.example.net with local id "), "o_orderkey"))
        .when(k == 6, F.concat(full, F.lit(" Received: "), full))
        .when(k == 7, F.lit("nothing to see"))
        .otherwise(full)
    )
    return o.select(F.floor(key / 4).cast("string").alias("msg_id"), (key % 4).cast("int").alias("hop"), key.alias("o_orderkey"), line.alias("line"))


@query("""
SELECT o_orderkey,
  CASE WHEN o_orderkey % 8 < 5 THEN '10.' || (o_orderkey // 65536) % 256 || '.' || (o_orderkey // 256) % 256 || '.' || o_orderkey % 256 || ',mx' || o_custkey || '.example.com' END AS senders,
  CASE WHEN o_orderkey % 8 < 5 THEN 'relay.example.net' WHEN o_orderkey % 8 = 5 THEN 'edge.example.net' END AS relays,
  CASE WHEN o_orderkey % 8 < 5 THEN 'esmtps id a1' WHEN o_orderkey % 8 = 5 THEN 'local id ' || o_orderkey END AS protocol,
  CASE WHEN o_orderkey % 8 < 5 THEN 'u' || o_custkey || '@example.org' END AS recipients,
  CASE WHEN o_orderkey % 8 < 5 THEN date_trunc('second', o_orderdate) END AS at,
  CASE o_orderkey % 8 WHEN 6 THEN 'Merged Received headers' WHEN 7 THEN 'Nothing Parsable' END AS warnings
FROM orders
""")
def hop_fields(spark, sf):
    h = received.parse_hops(hop_lines(spark, sf))
    joined = lambda c: F.array_join(c, ",")
    return h.select(
        "o_orderkey", joined("from").alias("senders"), joined("by").alias("relays"), F.col("with").alias("protocol"), joined("for").alias("recipients"),
        F.col("date").cast("timestamp_ntz").alias("at"), joined("warning").alias("warnings"),
    )


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'from,by,with,for' ELSE 'by,from,for' END AS words FROM orders")
def hop_word_order(spark, sf):
    line = F.when(F.col("o_orderkey") % 2 == 0, "from a (for x) by b with c for d").otherwise("by b from a for c")
    return read(spark, sf, "orders").select("o_orderkey", F.array_join(received.word_order(received.normalised(line)), ",").alias("words"))


_MESSAGES = "SELECT CAST(o_orderkey // 4 AS VARCHAR) AS msg_id, o_orderkey % 4 AS hop, o_orderkey % 8 AS k, o_orderkey, o_custkey, o_orderdate FROM orders"


@query(f"""
SELECT msg_id, hop, nth, CASE WHEN nth > 1 THEN 'Duplicate SMTP by entrypoint' END AS warnings
FROM (SELECT msg_id, hop, row_number() OVER (PARTITION BY msg_id ORDER BY hop) AS nth FROM ({_MESSAGES}) WHERE k < 5)
""")
def entry_points(spark, sf):
    h = received.parse_hops(hop_lines(spark, sf))
    e = received.entry_points(h, Options(entry_hosts=("Relay.Example",)))
    return e.select("msg_id", "hop", "nth", F.array_join("warning", ",").alias("warnings"))


@query(f"""
SELECT msg_id, '10.' || (o_orderkey // 65536) % 256 || '.' || (o_orderkey // 256) % 256 || '.' || o_orderkey % 256 || ',mx' || o_custkey || '.example.com' AS src
FROM ({_MESSAGES}) WHERE k < 5 QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY hop DESC) = 1
""")
def received_src(spark, sf):
    h = received.parse_hops(hop_lines(spark, sf))
    return received.received_src(received.entry_points(h, Options(entry_hosts=("relay.example",)))).select("msg_id", F.array_join("received_src", ",").alias("src"))


@query(f"""
SELECT msg_id, count(*) AS hops, string_agg(DISTINCT CASE WHEN k < 5 THEN 'mx' || o_custkey || '.example.com' WHEN k = 6 THEN 'mx' || o_custkey || '.example.com' END, ',' ORDER BY CASE WHEN k < 5 THEN 'mx' || o_custkey || '.example.com' WHEN k = 6 THEN 'mx' || o_custkey || '.example.com' END) AS senders,
  string_agg(DISTINCT CASE WHEN k < 5 AND o_custkey % 2 = 1 THEN 'u' || o_custkey || '@example.org' END, ',' ORDER BY CASE WHEN k < 5 AND o_custkey % 2 = 1 THEN 'u' || o_custkey || '@example.org' END) AS recipients
FROM ({_MESSAGES}) GROUP BY msg_id
""")
def message_roll_up(spark, sf):
    """Hosts and recipients of all hops of a message; recipients with even numbers are whitelisted by a filter on the column."""
    h = received.parse_hops(hop_lines(spark, sf).withColumn("line", F.lower("line")))
    r = received.roll_up(received.hop_indicators(h))
    return r.select(
        "msg_id", F.size("received").cast("long").alias("hops"), F.nullif(F.array_join(F.filter("received_domain", lambda d: F.startswith(d, F.lit("mx"))), ","), F.lit("")).alias("senders"),
        F.nullif(F.array_join(F.filter("received_foremail", lambda a: F.rlike(a, F.lit("^u[0-9]*[13579]@"))), ","), F.lit("")).alias("recipients"),
    )


@query(f"""
SELECT msg_id, hop, CAST(epoch(date_trunc('second', d))::BIGINT - lag(epoch(date_trunc('second', d))::BIGINT) OVER (PARTITION BY msg_id ORDER BY hop DESC) AS DOUBLE) AS delay_s
FROM (SELECT *, CASE WHEN k < 5 THEN o_orderdate END AS d FROM ({_MESSAGES}))
""")
def hop_delays(spark, sf):
    return received.hop_delay(received.parse_hops(hop_lines(spark, sf))).select("msg_id", "hop", F.col("delay_s").cast("double").alias("delay_s"))


# ---- whole mails -----------------------------------------------------------------------------


@query("SELECT CAST(c_custkey AS VARCHAR) AS path, 'iso-8859-1' AS charset, 'quoted-printable' AS encoding, 'Grüße an ' || c_name || ' = ÿ' AS body FROM customer")
def quoted_latin1_bodies(spark, sf):
    """Quoted-printable with a soft line break, in an eight-bit charset."""
    head = f"From: a@example.com{render.END}Content-Type: text/plain; charset=ISO-8859-1{render.END}Content-Transfer-Encoding: Quoted-Printable{render.END}{render.END}"
    c = spread(read(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")
    c = c.select(F.col("c_custkey").cast("string").alias("path"), F.encode(F.concat(F.lit(f"{head}Gr=FC=DFe an =\r\n"), "c_name", F.lit(" =3D =FF")), "utf-8").alias("content"))
    part = F.col("parts")[0]
    return mail.parse_mails(c, fields=("path", "parts")).select("path", part["charset"].alias("charset"), part["encoding"].alias("encoding"), part["text"].alias("body"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 4 = 0 THEN '1970-01-01T00:00:00+00:00' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS date_iso,
  'c' || o_custkey || '@example.org,d@example.net' AS copies, CASE WHEN o_orderkey % 3 > 0 THEN 'box' || o_orderkey || '@example.com' END AS delivered
FROM orders
""")
def date_and_copy_headers(spark, sf):
    """Date, Cc with a display name that holds a comma, Delivered-To; every fourth mail has no date, every third no Delivered-To."""
    o, end = spread(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey"), F.lit(render.END)
    date = F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("Date: "), render.rfc_date(F.col("o_orderdate")), end)).otherwise("")
    delivered = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("Delivered-To: BOX"), "o_orderkey", F.lit("@example.com"), end)).otherwise("")
    content = F.concat(F.lit("From: a@example.com"), end, date, delivered, F.lit('Cc: "Last, First" <C'), "o_custkey", F.lit("@Example.org>,\r\n d@example.net"), end, end, F.lit("text"))
    m = mail.parse_mails(o.select(F.col("o_orderkey").cast("string").alias("path"), F.encode(content, "utf-8").alias("content")), fields=("path", "date_iso", "cc", "delivered_to"))
    return m.select("path", "date_iso", F.array_join("cc", ",").alias("copies"), F.array_join("delivered_to", ",").alias("delivered"))


def conversation_mails(spark, sf) -> DataFrame:
    return render.mails_of_conversations(read(spark, sf, "conversations")).withColumn("path", F.concat_ws("/", "conv_id", "turn"))


@query("""
SELECT conv_id || '/' || turn AS path, 'Größe ' || conv_id || '/' || turn AS subject, 'u' || conv_id || '@example.com' AS sender, role || '@example.org,copy@example.org' AS recipients,
  sha256(text) AS body_hash, length(text) AS n_chars
FROM conversations
""")
def mails_round_trip(spark, sf):
    m = mail.parse_mails(conversation_mails(spark, sf))
    body = F.col("parts")[0]["text"]
    return m.select("path", "subject", F.col("from").alias("sender"), F.array_join("to", ",").alias("recipients"), F.sha2(body, 256).alias("body_hash"), F.length(body).alias("n_chars"))


def document_mails(spark, sf) -> DataFrame:
    """One multipart mail for each page: the page as text and html, its url as the payload."""
    p = read(spark, sf, "pages")
    name = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("Report "), "page_id", F.when(F.col("page_id") % 3 == 1, ".PDF").otherwise("")))
    return p.select(F.col("page_id").cast("string").alias("path"), render.multipart(F.col("url"), F.col("html"), name, F.encode("url", "utf-8")).alias("content"))


@query("""
SELECT CAST(page_id AS VARCHAR) AS path, CASE WHEN page_id % 3 = 0 THEN 'part-000' ELSE 'Report ' || page_id || CASE WHEN page_id % 3 = 1 THEN '.PDF' ELSE '' END END AS filename,
  CASE WHEN page_id % 3 = 1 THEN 'pdf' END AS extension, octet_length(encode(url)) AS size, md5(url) AS md5, sha256(url) AS sha256, base64(encode(url)) AS raw
FROM pages
""")
def attachments_round_trip(spark, sf):
    m = mail.parse_mails(document_mails(spark, sf))
    a = bodies.attachments(m, Options(attachment_data=True), "path")
    return a.select("path", "filename", "extension", "size", F.col("hash.md5").alias("md5"), F.col("hash.sha256").alias("sha256"), "raw")


@query("""
SELECT CAST(page_id AS VARCHAR) AS path, 0 AS body_no, 'text/plain' AS content_type, sha256(url) AS hash, 'inner' AS boundary FROM pages
UNION ALL SELECT CAST(page_id AS VARCHAR), 1, 'text/html', sha256(html), 'inner' FROM pages
""")
def bodies_round_trip(spark, sf):
    m = mail.parse_mails(document_mails(spark, sf))
    return bodies.bodies(m, "path").select("path", "body_no", "content_type", "hash", "boundary")


@query("""
SELECT conv_id || '/' || turn AS path, 'forwarded' AS subject, 'part-000' AS filename, sha256(text) AS inner_hash, 2 AS n_parts FROM conversations
""")
def nested_mails(spark, sf):
    """A mail in a mail is an attachment, and its text a body."""
    c = conversation_mails(spark, sf)
    m = mail.parse_mails(c.select("path", render.nested(F.col("content")).alias("content")))
    attached = F.filter("parts", lambda p: p["is_attachment"])[0]
    body = F.filter("parts", lambda p: p["is_body"])[0]
    return m.select("path", "subject", attached["filename"].alias("filename"), F.sha2(body["text"], 256).alias("inner_hash"), F.size("parts").alias("n_parts"))


@query("""
SELECT conv_id || '/' || turn AS path, 'Größe ' || conv_id || '/' || turn AS subject, '1970-01-01T00:00:00+00:00' AS date_iso, 'copy@example.org' AS second_to, sha256(text) AS body_hash FROM conversations
""")
def reports_as_json(spark, sf):
    m = mail.parse_mails(conversation_mails(spark, sf))
    j = report.to_json(report.report(m, Options(raw_body=True), "path"))
    get = lambda p: F.get_json_object("json", p)
    return j.select("path", get("$.header.subject").alias("subject"), get("$.header.date_iso").alias("date_iso"), get("$.header.to[1]").alias("second_to"), get("$.body[0].hash").alias("body_hash"))


@query("SELECT 'example.com' AS sender_host, 2 * count(*) AS messages, 10 * count(*) AS indicators FROM conversations")
def sender_hosts(spark, sf):
    """Every mail is there twice, and has one address, two hosts, one URL and one IP."""
    c, number = spread(read(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn"), F.concat_ws("/", "conv_id", "turn")
    body = F.lit("write to a@b.example or see http://www.cc.example/p from 10.0.0.1")
    m = c.select(render.simple(body, F.lit("X <x@Example.com>"), F.lit("y@example.org"), number).alias("content"))
    return report.summary(mail.parse_mails(m.unionAll(m), fields=("from", "parts")))


@query("""
SELECT p_partkey, 'grüße ' || p_partkey || ' = ok' AS body, 'c' || p_partkey || '@x.example,d@y.example' AS cc, 'box@z.example' AS delivered_to, 'sales@w.example' AS sender,
  CASE WHEN p_partkey % 2 = 0 THEN '<id' || p_partkey || '@v.example>' END AS message_id, 'one|two ' || p_partkey AS dotted, sha256('grüße ' || p_partkey || ' = ok') AS hash
FROM part
""")
def header_repairs(spark, sf):
    """Quoted-printable Latin-1 bodies, copies, a sender without a parsable address, bracketed message ids, dots in header names."""
    p, k = spread(read(spark, sf, "part").select("p_partkey"), "p_partkey"), F.col("p_partkey").cast("string")
    raw = F.concat(
        F.lit("From: write to, Sales@w.example\r\nCc: C"), k, F.lit("@x.example,\r\n d@y.example\r\nDelivered-To: Box@z.example\r\nMessage-ID: "), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("[id"), k, F.lit("@v.example]"))).otherwise("[none]"),
        F.lit("\r\nX.Y: one\r\nx.y: two "), k, F.lit("\r\nContent-Type: text/plain; charset=ISO-8859-1\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\ngr=FC=DFe =\r\n"), k, F.lit(" =3D ok"),
    )
    m = mail.parse_mails(p.select(F.encode(raw, "utf-8").alias("content"), k.alias("path")), fields=("path", "msg_id", "cc", "delivered_to", "from", "headers", "parts"))
    b = bodies.bodies(m, "path", "cc", "delivered_to", "from", "headers")
    named = text.headers_map(F.col("headers"), colons=True)
    return b.select(
        F.col("path").cast("long").alias("p_partkey"), F.col("text").alias("body"), F.array_join("cc", ",").alias("cc"), F.array_join("delivered_to", ",").alias("delivered_to"), F.col("from").alias("sender"),
        F.try_element_at(named, F.lit("message-id"))[0].alias("message_id"), F.array_join(named["x:y"], "|").alias("dotted"), "hash",
    )


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'From can''t be parsed' WHEN 2 THEN 'Message-ID repaired' WHEN 3 THEN 'Date can''t be read' WHEN 4 THEN 'From can''t be parsed|Date can''t be read' END AS warnings
FROM part
""")
def header_warnings(spark, sf):
    """Sound headers, a sender without an address, a bracketed message id, a date that is none, and two of them."""
    p, k = spread(read(spark, sf, "part").select("p_partkey"), "p_partkey"), F.col("p_partkey")
    raw = F.concat(
        F.lit("From: "), F.when((k % 5).isin(1, 4), "the shop").otherwise("a@example.com"), F.lit("\r\nMessage-ID: "), F.when(k % 5 == 2, "[x@example.com]").otherwise("<x@example.com>"),
        F.lit("\r\nDate: "), F.when((k % 5).isin(3, 4), "unknown").otherwise("Fri, 26 Apr 2013 13:15:55 +0200"), F.lit("\r\n\r\ntext"),
    )
    m = mail.parse_mails(p.select(F.encode(raw, "utf-8").alias("content"), k.cast("string").alias("path")), fields=("path", "warnings"))
    return m.select(F.col("path").cast("long").alias("p_partkey"), F.array_join("warnings", "|").alias("warnings"))


@query("SELECT conv_id || '/' || turn AS path, 'Größe ' || conv_id || '/' || turn AS subject FROM conversations")
def bad_start(spark, sf):
    """Junk lines before the headers."""
    c = conversation_mails(spark, sf)
    junk = c.select("path", F.concat(F.encode(F.lit("junk\r\nmore junk\r\n"), "utf-8"), F.col("content")).alias("content"))
    return mail.parse_mails(junk, Options(skip_bad_start=True)).select("path", "subject")


@query("SELECT sha256(url) AS sha256, count(*) AS mails FROM pages GROUP BY 1")
def shared_attachments(spark, sf):
    a = bodies.attachments(mail.parse_mails(document_mails(spark, sf)))
    return a.groupBy(F.col("hash.sha256").alias("sha256")).agg(F.count("*").alias("mails"))


@query("SELECT page_id, 'example.' || right(regexp_extract(url, '://([^/]+)/', 1), 3) AS known, NULL::VARCHAR AS unknown FROM pages")
def known_suffixes(spark, sf):
    """Hosts under a known public suffix, and one under none."""
    host = F.regexp_extract("url", "://([^/]+)/", 1)
    check = lambda h: hosts.valid_host(h, known=True)
    return read(spark, sf, "pages").select("page_id", check(F.concat(F.lit("me@example."), F.substring(host, -3, 3))).alias("known"), check(F.concat(host, F.lit(".jpg"))).alias("unknown"))


@query(f"""
WITH t AS (SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, url || ' ' || html FROM pages),
f AS (
  SELECT DISTINCT origin, id, 'email' AS kind, lower(unnest(regexp_extract_all(text, '{_EMAIL_SQL}'))) AS value FROM t
  UNION ALL SELECT DISTINCT origin, id, 'ip', unnest(regexp_extract_all(text, '{_IP_SQL}')) FROM t
  UNION ALL SELECT DISTINCT origin, id, 'domain', lower(unnest({_hosts_sql('text')})) FROM t)
SELECT origin, kind, count(*) AS found, count(DISTINCT value) AS distinct_values FROM f GROUP BY origin, kind
""")
def flagship(spark, sf):
    """E-mail addresses, domains and IPs in documents and pages: how many, and how many different ones."""
    d = read(spark, sf, "documents").select(F.lit("documents").alias("origin"), "text")
    p = read(spark, sf, "pages").select(F.lit("pages").alias("origin"), F.concat_ws(" ", "url", "html").alias("text"))
    t, none = F.col("text"), F.array().cast("array<string>")
    found = d.unionByName(p).select("origin", extract.emails(t).alias("email"), extract.domains(t).alias("domain"), extract.ips(t).alias("ip"), none.alias("uri"), none.alias("uri_noscheme"))
    return indicators.indicator_rows(found, "origin").groupBy("origin", "kind").agg(F.count("*").alias("found"), F.countDistinct("value").alias("distinct_values"))
