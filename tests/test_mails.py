"""Whole mails: parsing, the path, reports, sources and streams."""

import base64
import email.utils
import json
import random
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from mailframe.config import Options
from mailframe.functions import decoding
from mailframe.operators import bodies, indicators, received, report
from mailframe.sources import mail, mime
from mailframe.streaming import first_seen, indicator_stream, mail_stream

HOP = "from gate7.shop.example (gate7.shop.example [198.51.100.23]) (cipher X (128/128)) by IN.post.example (Exim) with SMTPSA id 9Zk for <Orders@post.example>; Thu, 5 Nov 2015 08:07:06 -0500 (EST)"


def sample() -> bytes:
    m = EmailMessage()
    m["From"], m["To"], m["Cc"] = '"Doe, J." <J.Doe@Example.com>', "a@example.org, B <b@example.org>", "c@example.org"
    m["Subject"], m["Date"], m["Message-ID"] = "Grüße ✓", "Fri, 26 Apr 2013 13:15:55 +0200", "<x@example.com>"
    m["Received"] = HOP
    m.set_content("Look at http://www.example.com/a?b=1 or mail x@example.net from 8.8.4.4\n")
    m.add_alternative("<p>Hi <a href='http://www.example.com/a?b=1'>x</a> www.example.com</p>", subtype="html")
    m.add_attachment(b"%PDF-1.4 ...", maintype="application", subtype="pdf", filename="Réport.PDF")
    m.add_attachment(b"\x00\x01", maintype="application", subtype="octet-stream")
    m.add_attachment("<html>inner http://h.example.com</html>", subtype="html", filename="page.HTML")
    inner = EmailMessage()
    inner["Subject"] = "inner"
    inner.set_content("nested text y@example.net")
    m.add_attachment(inner)
    return m.as_bytes()


def table(spark, *contents):
    return spark.createDataFrame([(f"/m/{i}.eml", c) for i, c in enumerate(contents)], "path string, content binary")


def test_message(spark):
    (r,) = mail.parse_mails(table(spark, sample())).collect()
    assert (r.subject, r["from"], r.to, r.cc, r.delivered_to, r.date_iso, r.error, r.defect) == ("Grüße ✓", "j.doe@example.com", ["a@example.org", "b@example.org"], ["c@example.org"], None, "2013-04-26T13:15:55+02:00", None, None)
    assert [(p.content_type, p.is_body, p.is_attachment, p.filename) for p in r.parts] == [
        ("multipart/mixed", False, False, None), ("multipart/alternative", False, False, None), ("text/plain", True, False, None), ("text/html", True, False, None), ("application/pdf", False, True, "Réport.PDF"),
        ("application/octet-stream", False, True, "part-000"), ("text/html", True, True, "page.HTML"), ("message/rfc822", False, True, "part-000"), ("text/plain", True, False, None),
    ]
    assert r.parts[2].boundary and r.parts[8].boundary is None and r.parts[8].part_path == [4, 0]


def test_attachments_and_bodies(spark):
    m = mail.parse_mails(table(spark, sample()))
    a = {(r.filename, r.size): r for r in bodies.attachments(m, Options(attachment_data=True)).collect()}
    pdf = a["Réport.PDF", 12]
    assert (pdf.extension, pdf.mime_type_short, len(pdf.hash.sha512)) == ("pdf", "application/pdf", 128) and a["part-000", 2].raw == "AAE="
    b = bodies.bodies(m).orderBy("body_no").collect()
    assert [x.content_type for x in b] == ["text/plain", "text/html", "text/html", "text/plain"] and "subject" in b[3].content_header
    assert [r.is_attachment for r in mail.parts(mail.parse_mails(table(spark, sample()), Options(attachments=False))).collect()] == [False] * 9


def test_report(spark):
    options = Options(raw_body=True, entry_hosts=("in.post",), for_whitelist=("nobody@example.org",))
    r = json.loads(report.to_json(report.report(mail.parse_mails(table(spark, sample())), options)).first().json)
    h = r["header"]
    assert h["received_ip"] == ["198.51.100.23"] and h["received_foremail"] == ["orders@post.example"] and h["received_src"] == ["198.51.100.23", "gate7.shop.example"] and "received_email" not in h
    assert h["received_domain"] == ["gate7.shop.example", "in.post.example"] and h["received"][0]["with"] == "smtpsa id 9zk" and h["date"].startswith("2013-04-26T11:15:55")
    assert r["body"][0]["uri"] == ["http://www.example.com/a?b=1"] and r["body"][0]["email"] == ["x@example.net"] and r["body"][0]["ip"] == ["8.8.4.4"] and "cc" in h["header"]
    assert [a["filename"] for a in r["attachment"]] == ["Réport.PDF", "part-000", "page.HTML", "part-000"]
    hidden = json.loads(report.to_json(report.report(mail.parse_mails(table(spark, sample(), b"")), Options())).filter("json like '%uri_hash%'").first().json)
    assert "content" not in hidden["body"][0] and "uri" not in hidden["body"][0] and len(hidden["body"][0]["uri_hash"][0]) == 64


@pytest.mark.parametrize(("line", "want"), [
    (HOP, {"from": ["198.51.100.23", "gate7.shop.example"], "by": ["in.post.example"], "with": "smtpsa id 9zk", "for": ["orders@post.example"], "warning": None}),
    ("by b7.sub.example.net with relay (sender <q@w.example>) id 77 for pay-from-card@bank.example; Sat, 6 Mar 2021 09:10:11 +0300", {"from": None, "by": ["b7.sub.example.net"], "for": ["pay-from-card@bank.example"], "warning": None}),
    ("for a@example.com from b.example.com by c.example.com ", {"for": ["a@example.com"], "from": ["b.example.com"], "by": ["c.example.com"], "date": None}),
    ("by c.example.com for a@example.com from b.example.com", {"for": ["a@example.com"], "from": ["b.example.com"]}),
    ("", {"warning": ["Nothing Parsable"], "from": None}), ("from a received: from b", {"warning": ["Merged Received headers"], "from": None}),
    ("from(a)by(b) w.example.org with LMTP; Sun, 7 Mar 2021", {"warning": None}),
])
def test_hops(spark, line, want):
    r = received.parse_hops(spark.createDataFrame([(line,)], "line string")).first()
    assert {k: r[k] for k in want} == want


def test_duplicate_entry(spark):
    raw = b"".join(b"Received: from a%d.example.com by mx.example.org; Fri, 26 Apr 2013 13:15:5%d +0000\r\n" % (i, i) for i in range(3)) + b"Subject: s\r\n\r\nx"
    m = mail.parse_mails(table(spark, raw))
    e = received.entry_points(received.hops(m), Options(entry_hosts=("MX.example",))).orderBy("hop").collect()
    assert [(x.nth, x.warning) for x in e] == [(1, None), (2, [received.DUPLICATE]), (3, [received.DUPLICATE])]
    assert received.received_src(received.entry_points(received.hops(m), Options(entry_hosts=("mx.example",)))).first().received_src == ["a2.example.com"]
    assert [x.delay_s for x in received.hop_delay(received.hops(m)).orderBy("hop").collect()] == [-1, -1, None]


def test_header_repairs():
    p = lambda head: mime.parse(head + b"\r\n\r\nx")
    ids = lambda r: [h["value"] for h in r["headers"] if h["name"] == "message-id"]
    assert ids(p(b"Message-ID: <[a1@example.com]>")) == ["<a1@example.com>"] and ids(p(b"Message-ID: [nothing]")) == [""] and ids(p(b"Message-ID: <b@[10.0.0.1]>")) == [""]
    assert p(b"From: Test. <t@example.com>")["from"] == "t@example.com" and p(b"To: Test. <T@example.com>")["to"] == ["t@example.com"]
    assert p(b"From: =?utf-8?q?a=0D=0A?= <x@example.com>")["from"] == "x@example.com" and p(b"From: \"o@other.example\" <x@example.com>")["from"] == "x@example.com"
    assert p(b"From: none at all")["from"] == "none at all" and p(b"X: y")["from"] is None and p(b"X: y")["date_iso"].startswith("1970-01-01T00:00:00")
    assert p(b"To: a@localhost, b@c.example")["to"] == ["a@localhost", "b@c.example"] and mime.parse(b"To: a@localhost, b@c.example\n\n", Options(email_needs_tld=True))["to"] == ["b@c.example"]
    assert p(b"Subject: gr\xfc\xdfe")["subject"] == "grüße"
    assert p(b"From: none at all\r\nMessage-ID: [nothing]\r\nDate: ?")["warnings"] == [mime.BAD_FROM, mime.BAD_ID, mime.BAD_DATE] and p(b"X: y")["warnings"] is None
    assert p(b"Date: Thu, 1 Jan 1970 00:00:00 +0000")["warnings"] is None


def test_bad_start():
    raw = b"junk\nmore junk\nSubject: s\nX: y\n\nbody"
    assert mime.parse(raw, Options(skip_bad_start=True))["subject"] == "s" and mime.parse(raw)["subject"] == ""


def test_parse_never_fails(spark):
    rng, good = random.Random(3), sample()
    broken = [bytes(rng.randrange(256) for _ in range(rng.randrange(400))) for _ in range(60)]
    for _ in range(150):
        b = bytearray(good)
        for _ in range(rng.randrange(1, 40)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        broken.append(bytes(b[: rng.randrange(len(b))]))
    m = mail.parse_mails(table(spark, *broken, None))
    assert m.count() == 211 and m.filter("error is not null").count() == 0
    assert report.to_json(report.report(m, Options(raw_body=True))).filter("json is not null").count() == 211


def test_sources(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.eml").write_bytes(sample() + bytes([48 + i]))
    (tmp_path / "x.txt").write_text("no mail")
    assert mail.parse_mails(mail.files(spark, str(tmp_path))).count() == 5
    mail.register(spark)
    one = F.col("path") == str(tmp_path / "3.eml")
    df = spark.read.format("rfc822").option("filesPerTask", "2").load(str(tmp_path))
    assert df.count() == 5 and df.filter(one).first().subject == "Grüße ✓"
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert [r.subject for r in spark.read.format("rfc822").option("pushdown", "true").load(str(tmp_path)).filter(one).collect()] == ["Grüße ✓"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    table(spark, sample()).createOrReplaceTempView("raw_mails")
    assert spark.sql("SELECT p.content_type FROM raw_mails, LATERAL parse_rfc822(content) p WHERE p.is_attachment").count() == 4


def test_attachment_files_stay_in_their_folder(spark, tmp_path):
    raw = b'Content-Type: application/x; name="../../evil.sh"\r\nContent-Disposition: attachment; filename="../../evil.sh"\r\n\r\nboo'
    bodies.write_attachments(mail.parse_mails(table(spark, raw, sample())), str(tmp_path / "out"))
    names = sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file())
    assert len(names) == 5 and "0-evil.sh" in names and not list(tmp_path.glob("*evil*"))


def test_whitelist_and_ranges(spark):
    rows = spark.createDataFrame([(1, "ip", "10.0.0.1"), (2, "ip", "8.8.8.8"), (3, "email", "10.0.0.1")], "id int, kind string, value string")
    listed = spark.createDataFrame([("ip", "10.0.0.1")], "kind string, value string")
    assert sorted(r.id for r in indicators.without_listed(rows, listed).collect()) == [2, 3]
    ranges = spark.createDataFrame([(167772160, 184549375, "ten"), (0, 16777215, "zero")], "low long, high long, name string")
    assert sorted((r.id, r.name) for r in indicators.in_ranges(rows, ranges).collect()) == [(1, "ten"), (3, "ten")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    same = sample()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.eml").write_bytes(same)
    stream = indicator_stream(first_seen(mail_stream(spark, str(tmp_path / "in"))))
    q = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT kind, value FROM found").collect()
    assert ("email", "x@example.net") in {tuple(r) for r in got} and sum(r.value == "x@example.net" for r in got) == 1


def test_hop_dates_in_uncommon_formats(spark):
    odd = {"Mon Jan 2 10:00:00 2006": "2006-01-02 10:00:00", "2 Jan 06 10:00:00 +0100": "2006-01-02 09:00:00", "Mon, 2 Jan 2006 10:00:00 BST": "2006-01-02 10:00:00", "Mon, 2 Jan 2006 10:00:00 +0200": "2006-01-02 08:00:00", "no date": "1970-01-01 00:00:00"}
    lines = spark.createDataFrame([(f"from a.example.com by b.example.com with SMTP; {d}", d) for d in odd], "line string, d string")
    got = received.parse_hops(lines).filter("src is not null").selectExpr("d", "cast(cast(date as timestamp_ntz) as string) AS at").collect()
    assert {r.d: r.at for r in got} == odd


def test_repeated_mails_count_once_in_their_path(spark):
    raw = sample()
    m = mail.parse_mails(table(spark, raw, raw, raw))
    rolled = received.roll_up(received.hop_indicators(received.hops(m))).collect()
    assert len(rolled) == 1 and len(rolled[0].received) == 1
    assert [r.nth for r in received.entry_points(received.hops(m), Options(entry_hosts=("in.post",))).collect()] == [1]
    one, three = report.summary(mail.parse_mails(table(spark, raw))).first(), report.summary(m).first()
    assert (three.messages, three.indicators) == (3, 3 * one.indicators) and one.indicators > 5


LINES = [
    HOP, "from a.example.com by IN.post.example with SMTP; 2 Jan 06 10:00:00 +0100", "by in.post.example and other.in.post.example for <x@y.example>; Sat, 6 Mar 2021 09:10:11 +0300", "from a received: from b", "nothing",
    "from q@w.example by c.example.org ([2001:db8::7]) for a@b.example", "from ten.example ([10.0.0.7]) by in.post.example",
]


def test_reports_in_the_row_hold_what_the_tables_hold(spark):
    head = lambda lines: b"".join(b"Received: %s\r\n" % x.encode() for x in lines)
    raws = [head(LINES) + sample(), head(LINES[2:]) + b"\r\nno text", head(LINES[4:5]) + b"Subject: s\r\n\r\nx", b"Subject: none\r\n\r\nwww.example.com", b""]
    m = mail.parse_mails(table(spark, *raws))
    options = Options(raw_body=True, entry_hosts=("in.post", "other"), ip_whitelist=("10.0.0.7",), for_whitelist=("x@y.example",))
    got = {r.msg_id: r for r in report.report(m, options, "path").collect()}
    assert len(got) == 5
    hop_table = received.hops(m)
    entries = received.entry_points(hop_table, options)
    source = {r.msg_id: r.received_src for r in received.received_src(entries).collect()}
    twice = {(r.msg_id, r.hop): r.warning for r in entries.filter("nth > 1").collect()}
    rolled = {r.msg_id: r for r in received.roll_up(received.hop_indicators(hop_table, options)).collect()}
    assert len(twice) >= 4 and len(rolled) == 3 and len(source) == 2
    for key, r in got.items():
        want = rolled.get(key)
        for k in received.KINDS:
            assert r.header[k] == (want and want[k])
        assert r.header.received_src == source.get(key)
        assert [h.asDict() for h in r.header.received] == [h.asDict() | {"warning": twice.get((key, h.hop), h.warning)} for h in (want.received if want else ())]
    texts = {}
    for b in indicators.body_indicators(bodies.bodies(m), "text", options).orderBy("msg_id", "body_no").collect():
        texts.setdefault(b.msg_id, []).append(b)
    for key, r in got.items():
        names = ("uri", "uri_noscheme", "email", "domain", "ip", "content_header", "content_type", "hash", "boundary")
        assert [[x[k] or None for k in names] for x in r.body] == [[x[k] or None for k in names] for x in texts.get(key, [])]
    kept = {(a.msg_id, a.filename, a.hash) for a in bodies.attachments(m).collect()}
    assert {(key, a.filename, a.hash) for key, r in got.items() for a in r.attachment or ()} == kept and len(kept) == 4


def test_reports_are_not_shuffled(spark):
    raw = sample()
    out = report.to_json(report.report(mail.parse_mails(table(spark, raw, raw)), Options(entry_hosts=("in.post",), attachment_data=True)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    one, other = out.collect()
    assert one == other and json.loads(one.json)["attachment"][1]["raw"] == "AAE="


def test_command_line(spark, tmp_path, capsys):
    import mailreport

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one").write_bytes(sample())
    mailreport.main(["-i", str(tmp_path / "in"), "-d", "-r", "-b", "in.post, other", "-w", "8.8.4.4"])
    (line,) = [x for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    r = json.loads(line)
    assert r["header"]["received_src"] and r["attachment"][1]["raw"] == "AAE=" and r["body"][0]["email"] == ["x@example.net"] and "ip" not in r["body"][0]
    mailreport.main(["-i", str(tmp_path / "in" / "one"), "-o", str(tmp_path / "out")])
    hidden = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert "email_hash" in hidden["body"][0] and "email" not in hidden["body"][0] and "raw" not in hidden["attachment"][0]


def test_data_of_attachments_is_on_one_line(spark):
    data = bytes(range(200))
    raw = table(spark, b"From: a@x.example\r\nContent-Type: application/zip\r\nContent-Disposition: attachment\r\nContent-Transfer-Encoding: base64\r\n\r\n" + base64.encodebytes(data))
    options, want = Options(attachment_data=True), base64.b64encode(data).decode()
    assert bodies.attachments(mail.parse_mails(raw), options).first().raw == want
    assert report.report(mail.parse_mails(raw), options).first().attachment[0].raw == want


def test_chosen_fields_are_the_same_and_the_others_not_worked_out(monkeypatch):
    raw = sample()
    whole = mime.parse(raw)
    for fields in (("warnings",), ("date_iso", "cc", "delivered_to"), ("msg_id", "from", "headers", "parts")):
        assert mime.parse(raw, fields=fields) == {"path": None} | {k: whole[k] for k in fields}
    for odd in (b"From: a@b.example\r\nno colon\r\nCc: c@d.example\r\n\r\nx", b"Cc:\r\n c@d.example\r\n\r\nx", b"Cc: c@d.example", b": x\nCc: c@d.example\n\n"):
        assert mime.parse(odd, fields=("cc", "headers")).items() <= mime.parse(odd).items()
    monkeypatch.setattr(mime, "part_rows", None)
    assert mime.parse(raw, fields=("cc",))["cc"] == ["c@example.org"]


def test_a_date_that_is_none_is_searched_once(monkeypatch):
    asked = []
    monkeypatch.setattr(decoding, "fuzzy", type("Fuzzy", (), {"parse": staticmethod(lambda *a, **k: asked.append(a) or None)}))
    row = mime.parse(b"From: a@b.example\r\nDate: never mind 77\r\n\r\nx")
    assert row["warnings"] == [mime.BAD_DATE] and row["date_iso"] == "1970-01-01T00:00:00+00:00" and len(asked) == 1


@pytest.mark.parametrize("text", ["Fri, 26 Apr 2013 13:15:55 +0200", "1 feb 1000 00:00:00 -2359", "31 Dec 9999 23:59:59 -0100", "29 Feb 2023 01:02:03 +0000", "1 Jan 2001 24:00:00 +0100", "1 Jan 2001 10:00:00 -0000", "1 Jan 2001 10:00:00 +2400"])
def test_plain_dates_as_the_library_reads_them(text):
    try:
        want = email.utils.parsedate_to_datetime(text).isoformat()
    except ValueError:
        want = None
    got = decoding.plain_date(text)
    assert got is None or got.isoformat() == want


@pytest.mark.parametrize("text", ['"Last, First" <C1@Example.org>, d@example.net', "a@b.example", "A B <a@b.example> ,c@d.example"])
def test_plain_address_lists_as_the_library_reads_them(text):
    assert mime.plain_addresses(text) == [a for _, a in email.utils.getaddresses([text])]
    assert mime.plain_addresses(text + ",") is None and mime.plain_addresses("(x) " + text) is None
