"""The path of a mail, from its Received lines, in built-in expressions but for uncommon dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Options
from ..functions import dates, extract, hosts, text
from ..functions import patterns as P

WORDS = ("from", "by", "with", "for")
HOP = ("hop", "src", "from", "by", "with", "for", "date", "date_text", "warning")
KINDS = ("received_ip", "received_domain", "received_email", "received_foremail")
MERGED, NOTHING, DUPLICATE = "Merged Received headers", "Nothing Parsable", "Duplicate SMTP by entrypoint"


def normalised(line: Column) -> Column:
    """Lower case, parentheses and what is in them gone, one space between words."""
    low = F.lower(line)
    for c in ("(", ")", ";"):
        low = F.replace(low, F.lit(c), F.lit(f" {c} "))
    return F.trim(text.flatten_white(text.without_parentheses(low)))


def word_order(flat: Column) -> Column:
    """The words from, by, with, for that occur, by their first place."""
    places = F.array(*[F.struct(F.instr(flat, f"{w} ").alias("at"), F.lit(w).alias("word")) for w in WORDS])
    return F.transform(F.array_sort(F.filter(places, lambda p: p["at"] > 0)), lambda p: p["word"])


def _before(line: str) -> list:
    """Steps up to the date as text. Each gives columns from those before it, which `g` looks up by name."""

    def bare(g):
        dated = F.length(g("_date")) > 0
        rest = F.when(dated, F.replace(g("_flat"), g("_date"), F.lit(""))).otherwise(g("_flat"))
        return {"_dated": dated, "_merged": F.contains(g("_flat"), F.lit(" received: ")), "_bare": F.trim(rest)}

    return [
        lambda g: {"_flat": normalised(g(line)), "_low": F.lower(g(line))},
        lambda g: {"_date": dates.trailing(g("_flat"))},
        bare,
        lambda g: {"_words": word_order(g("_bare"))},
        lambda g: {"_usable": ~g("_merged") & (F.size(g("_words")) > 0)},
        lambda g: {"_text": F.when(g("_usable") & g("_dated"), g("_date"))},
    ]


def _after(line: str) -> list:
    """Steps from the date as a timestamp (_when) to the fields of a hop."""

    def head(g):
        # The date is cut off by its place, so that few patterns occur: one for each order of the words.
        place = F.length(g("_low")) - F.length(g("_date")) - F.instr(F.reverse(g("_low")), F.reverse(g("_date"))) + 1
        cut = F.when(~g("_dated"), g("_low")).when(F.contains(g("_low"), g("_date")), F.left(g("_low"), place))
        pattern = F.concat(F.lit("(?s)"), F.array_join(F.transform(g("_words"), lambda w: F.concat(w, F.lit(" (.*)"))), ""))
        return {"_head": F.when(g("_usable"), cut), "_pattern": pattern}

    def values(g):
        group = {w: F.array_position(g("_words"), w).cast("int") for w in WORDS}
        return {f"_{w}": F.nullif(text.trim_edges(F.when(group[w] > 0, F.call_function("regexp_extract", g("_head"), g("_pattern"), group[w]))), F.lit("")) for w in WORDS}

    def moved(g):
        split = F.split(g("_for"), " from ")
        tail = F.array_join(F.slice(split, 2, F.greatest(F.size(split) - 1, F.lit(0))), " ")
        return {"_sender": F.when(F.size(split) > 1, F.concat_ws(" ", g("_from"), tail)).otherwise(g("_from")), "_recipient": split[0]}

    def lists(g):
        found = {"_senders": extract.domains_and_ips(g("_sender")), "_relays": extract.domains_and_ips(g("_by"))}
        return found | {"_recipients": F.array_sort(F.array_distinct(extract.found(g("_recipient"), P.EMAIL)))}

    def fields(g):
        none_if_empty = lambda a: F.when(F.size(g(a)) > 0, g(a))
        return {
            "src": g(line),
            "from": none_if_empty("_senders"),
            "by": none_if_empty("_relays"),
            "with": g("_with"),
            "for": none_if_empty("_recipients"),
            "date_text": g("_text"),
            "warning": F.when(g("_merged"), F.array(F.lit(MERGED))).when(F.size(g("_words")) == 0, F.array(F.lit(NOTHING))),
            "date": F.when(g("_text").isNotNull(), g("_when")),
        }

    return [head, values, moved, lists, fields]


def parse_hops(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds src, from, by, with, for, date, date_text, warning for a column with one Received value a row.

    The words found in the line without parentheses give a pattern that is matched against the line with
    them, each word but the first at its last place. A line that doesn't match gives src and date only.
    A `for` that goes on with ` from ` gives that part to `from`.
    """
    df = lines
    for step in _before(line):
        df = fixed(df, **step(F.col))
    # Python functions stand outside generators; only dates in no common format have work to do in it.
    df = df.withColumn("_when", dates.robust(F.col("_text")))
    *steps, fields = _after(line)
    for step in steps:
        df = fixed(df, **step(F.col))
    out = fields(F.col)
    keep = [c for c in lines.columns if c not in out]
    return df.select(*keep, F.explode(F.array(F.struct(*[v.alias(k) for k, v in out.items()]))).alias("_hop")).select(*keep, "_hop.*")


def with_path(messages: DataFrame, name: str = "hops") -> DataFrame:
    """Adds the hops of a mail as an array of structs (hop, and the fields of parse_hops), newest first, empty without any.

    The same steps as in parse_hops, inside the row of the mail: nothing is shuffled.
    """
    none = F.array().cast("array<string>")
    df = fixed(messages, _path=F.transform(F.coalesce("received", none), lambda v, k: F.struct(k.alias("hop"), F.lower(v).alias("line"))))

    def step(df: DataFrame, made) -> DataFrame:
        def more(s: Column) -> Column:
            for k, v in made(lambda name: s[name]).items():
                s = s.withField(k, v)
            return s

        return fixed(df, _path=F.transform("_path", more))

    for made in [*_before("line"), lambda g: {"_fast": dates.parse(g("_text"))}]:
        df = step(df, made)
    odd = F.transform("_path", lambda s: F.when(s["_fast"].isNull(), s["_text"]))
    df = df.withColumn("_slow", dates.robust_isos(F.when(F.exists(odd, lambda t: t.isNotNull()), odd)))
    df = step(df, lambda g: {"_when": F.coalesce(g("_fast"), F.try_element_at("_slow", g("hop") + 1).cast("timestamp"), F.lit(dates.EPOCH).cast("timestamp"))})
    for made in _after("line"):
        df = step(df, made)
    return df.withColumn(name, F.transform("_path", lambda s: F.struct(*[s[k].alias(k) for k in HOP]))).drop("_path", "_slow")


def with_entries(messages: DataFrame, options: Options, name: str = "hops") -> DataFrame:
    """Adds received_src, the `from` of the outermost entry hop, and to hops through an entry host the warning from its second hit on.

    A hop hits as often as names in its `by` hold the host; this is entry_points and received_src inside one row.
    """
    none = F.array().cast("array<string>")
    hits = [_hits(h.lower()) for h in options.entry_hosts]
    counted = F.transform(name, lambda s: F.array(*[hit(F.coalesce(s["by"], none)) for hit in hits]))
    df = fixed(messages, _hits=counted)
    first = F.array(*[F.array_position(F.transform("_hits", lambda n: n[k] > 0), True) for k in range(len(hits))])
    df = fixed(df, _first=first)

    def one(s: Column) -> Column:
        n = F.try_element_at("_hits", s["hop"] + 1)
        again = F.exists(F.zip_with(n, "_first", lambda c, f: (c > 1) | ((c == 1) & (s["hop"] + 1 > f))), lambda x: x)
        more = F.concat(F.coalesce(s["warning"], none), F.array(F.lit(DUPLICATE)))
        return F.struct(*[(F.when(again, more).otherwise(s[k]) if k == "warning" else s[k]).alias(k) for k in HOP])

    entered = F.filter(name, lambda s: F.exists(F.try_element_at("_hits", s["hop"] + 1), lambda c: c > 0))
    source = F.try_element_at(F.transform(entered, lambda s: s["from"]), F.lit(-1))
    return fixed(df, **{name: F.transform(name, one), "received_src": source}).drop("_hits", "_first")


def _hits(host: str):
    return lambda names: F.size(F.filter(names, lambda b: F.contains(b, F.lit(host))))


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds (or replaces) columns that the optimizer won't put into later expressions again and again.

    A filter is pushed below a projection by writing out each column's expression in full; as these steps
    use each other several times, the text would grow exponentially. It isn't pushed below a generator.
    """
    made = F.struct(*[v.alias(k) for k, v in columns.items()])
    keep = [c for c in df.columns if c not in columns]
    return df.select("*", F.explode(F.array(made)).alias("_made")).select(*keep, "_made.*")


def hops(messages: DataFrame) -> DataFrame:
    """msg_id, hop (0 is the newest) and the parsed fields of every Received line; mails of equal bytes have one msg_id and count once."""
    lines = messages.select("msg_id", "received").dropDuplicates(["msg_id"]).select("msg_id", F.posexplode("received").alias("hop", "line")).withColumn("line", F.lower("line"))
    return parse_hops(lines)


def entry_points(hop_table: DataFrame, options: Options) -> DataFrame:
    """Hops with a `by` that holds an entry host: their place among the host's hops, and the warning from the second on."""
    names = F.array(*[F.lit(h.lower()) for h in options.entry_hosts])
    hit = hop_table.select("msg_id", "hop", "from", F.explode("by").alias("by"), "warning").select("*", F.explode(F.filter(names, lambda n: F.contains(F.col("by"), n))).alias("entry_host"))
    w = Window.partitionBy("msg_id", "entry_host").orderBy("hop", "by")
    count = F.row_number().over(w)
    warned = F.when(count > 1, F.concat(F.coalesce("warning", F.array().cast("array<string>")), F.array(F.lit(DUPLICATE)))).otherwise(F.col("warning"))
    return hit.withColumn("nth", count).withColumn("warning", warned)


def received_src(entries: DataFrame) -> DataFrame:
    """msg_id and the `from` of its outermost entry hop."""
    return entries.groupBy("msg_id").agg(F.max_by("from", F.struct("hop", "by")).alias("received_src"))


def _hop_lists(g, options: Options) -> dict[str, Column]:
    line = g("src")
    none = F.array().cast("array<string>")
    white = F.array(*[F.lit(x) for x in options.ip_whitelist]).cast("array<string>")
    ip4 = F.filter(F.array_except(extract.found(line, P.IPV4), white), lambda a: hosts.valid_host(a, options.ip_routable, options.domain_needs_tld, options.suffixes).isNotNull())
    own = F.coalesce(g("for"), none)
    mail = extract.found(line, P.EMAIL_WITH_TLD if options.email_needs_tld else P.EMAIL)
    return {
        "received_ip": F.concat(hosts.valid_ipv6s(F.array_except(extract.raw_ipv6s(line), white), options.ip_routable), ip4),
        "received_domain": F.filter(extract.found(line, P.RECEIVED_HOST), lambda d: ~hosts.is_ipv4(d)),
        "received_email": F.array_except(mail, own),
        "received_foremail": F.array_except(own, F.array(*[F.lit(x) for x in options.for_whitelist]).cast("array<string>")),
    }


def hop_indicators(hop_table: DataFrame, options: Options = Options()) -> DataFrame:
    """received_ip, received_domain, received_email, received_foremail of each hop.

    Whitelisted addresses are left out as they stand in the line; an IP isn't a domain; an address of
    the hop's own `for` isn't among its e-mail addresses.
    """
    return hop_table.select("*", *[v.alias(k) for k, v in _hop_lists(F.col, options).items()])


def with_path_indicators(messages: DataFrame, options: Options = Options(), name: str = "hops") -> DataFrame:
    """Adds the lists of hop_indicators from an array of hops, sorted and distinct over all hops, null where empty."""
    df = fixed(messages, _lists=F.transform(name, lambda s: F.struct(*[v.alias(k) for k, v in _hop_lists(lambda n: s[n], options).items()])))
    df = fixed(df, **{k: F.array_sort(F.array_distinct(F.flatten(F.col("_lists")[k]))) for k in KINDS}).drop("_lists")
    return df.withColumns({k: F.when(F.size(k) > 0, F.col(k)) for k in KINDS})


def roll_up(indicators: DataFrame) -> DataFrame:
    """One row a message: sorted distinct lists over its hops, null where empty; and all hops in order."""
    merged = {k: F.array_sort(F.array_distinct(F.flatten(F.collect_list(k)))) for k in KINDS}
    out = indicators.groupBy("msg_id").agg(F.sort_array(F.collect_list(F.struct(*HOP))).alias("received"), *[v.alias(k) for k, v in merged.items()])
    return out.select("msg_id", "received", *[F.when(F.size(k) > 0, F.col(k)).alias(k) for k in KINDS])


def hop_delay(hop_table: DataFrame) -> DataFrame:
    """Seconds between a hop and the older one before it."""
    w = Window.partitionBy("msg_id").orderBy(F.desc("hop"))
    return hop_table.select("msg_id", "hop", "date", (F.col("date").cast("long") - F.lag(F.col("date").cast("long")).over(w)).alias("delay_s"))
