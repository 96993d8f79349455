"""The automaton against a translation of globs to regular expressions."""

import random
import re

from mailframe.llm import url_filter as U


def translated(glob):
    out = []
    for token in re.findall(r"\*\*|\*|\?|[^*?]", glob):
        out.append({"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(token) or re.escape(token))
    return re.compile("".join(out), re.S)


def test_automaton_matches_regular_expressions():
    rng = random.Random(5)
    globs = ["", "*", "**", "a", "a*", "*a", "**a", "a**b", "?", "a?b", "*/b", "a/**", "é*", "**x**y**", "a" * 70 + "*", "a*b*a*b"]
    globs += ["".join(rng.choice(["a", "b", "/", "*", "**", "?"]) for _ in range(rng.randint(1, 9))) for _ in range(120)]
    texts = ["", "a", "é", "日本", "a" * 70 + "z", "a/b\nc"] + ["".join(rng.choice("ab/xé") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    hit = U.ShiftAnd(globs).match(texts)
    assert U.ShiftAnd(globs).words > 4
    for j, g in enumerate(globs):
        pattern = translated(g)
        assert [bool(pattern.fullmatch(t)) for t in texts] == hit[:, j].tolist(), g


def plain_rule(host, path):
    best = None
    for action, rule in U.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return best


URLS = [
    None, "", "no scheme.com/en/", "https://www.example.com/en/1", "https://m.example.com/en/1?x", "http://EXAMPLE.com/fr/", "http://a.net/es/9", "http://a.net/de/9", "http://net/fr/#x",
    "http://evil.org/x.com/", "http://example.com", "http://example.com?x=/en/", "x://y://z.com/en/", "https://casino-win.example.org/", "https://m.ads-track.example.org/a", "https://notads-x.org/ads-",
    "ftp://ÄÖ.com/É", "http://wwwexample.com/en/", "http://" + "a" * 5000 + ".net/fr/" + "b" * 5000,
]


def test_table(spark):
    rows = [(i, u, "clash", "x") for i, u in enumerate(URLS)] + [(3, URLS[3], "again", "y"), (None, URLS[4], "z", "z")]
    got = U.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is None:
            continue
        url = URLS[r.page_id]
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        rule = plain_rule(host, path)
        blocked = any(translated(g).fullmatch(host + path) for g in U.BLOCK_GLOBS)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule[1], rule[0] if rule else "block" if blocked else "allow")
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
