"""URL rules from a table against all rules tried on all URLs."""

import random
import re

from tillbook.llm.rule_table import filter_by_rules

RULES = "name string, verdict string, pattern string, rank int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expression(pattern):
    """The rule as a regular expression, read from the left."""
    text, front, end = pattern.translate(LOWER), "", ""
    if text.startswith("||"):
        text, front = text[2:], r"\A(?:[^/]*\.)?"
    elif text.startswith("|"):
        text, front = text[1:], r"\A"
    if text.endswith("|"):
        text, end = text[:-1], r"\Z"
    out = {"*": "(?s:.*)", "^": r"(?:[^a-z0-9_.%-]|\Z)"}
    return re.compile(front + "".join(out.get(c, re.escape(c)) for c in text) + end)


def plain(pages, rules, otherwise="allow"):
    known = [
        (rank or 0, len(p), p if name is None else name, verdict == "block", verdict, expression(p))
        for name, verdict, p, rank in set(rules) if verdict is not None and p is not None and re.search("[^*|]", p)
    ]
    out = {}
    for page, url in set(pages):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        place = (host + path).translate(LOWER)
        best = max((r[:5] for r in known if r[5].search(place)), default=None)
        out[page, url] = (host, path, best[2] if best else None, best[4] if best else otherwise)
    return out


def found(spark, pages, rules):
    df = spark.createDataFrame(pages, "page_id bigint, url string")
    rows = filter_by_rules(df, spark.createDataFrame(rules, RULES)).collect()
    got = {(r.page_id, r.url): (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(got) == len(rows)
    return got, sum(r.n_tried for r in rows)


WORDS = ["spam", "ads", "shop", "news", "x", "de", "img", "track", "7", "Login", "a-b", "caf\u00e9"]


def some_pages(draw, count):
    hosts = ["example.com", "m.example.com", "ads.net", "NEWS.org", "badexample.com", "shop.co.uk"]
    return [
        (n, f"https://{draw.choice(hosts)}/{'/'.join(draw.choice(WORDS) + draw.choice(['', '1', '_z', '.js']) for _ in range(draw.randrange(4)))}{draw.choice(['', '?q=spam', '#ads', '/'])}")
        for n in range(count)
    ]


def some_rules(draw, count):
    rules = []
    for n in range(count):
        body = draw.choice(["", "*", "/"]).join(draw.choice(WORDS) for _ in range(draw.randrange(1, 4)))
        host = draw.choice(["example.com", "ads.net", "news.org", "co.uk"])
        pattern = draw.choice([
            f"||{host}^", f"||{host}/{body}", f"|{host}/{body}", f"/{body}/", f"{body}|", body, f"*{body}^", f"^{body}^",
            f"/{body}*.js", f"site{n}.test/{body}", f"||host{n}.org^",
        ])
        rules.append((f"r{n}", draw.choice(["allow", "block"]), pattern, draw.choice([None, 0, 1])))
    return rules


def test_three_thousand_rules_decide_as_if_all_were_tried(spark):
    draw = random.Random(2)
    pages, rules = some_pages(draw, 250), some_rules(draw, 3000)
    got, tried = found(spark, pages, rules)
    assert got == plain(pages, rules)
    assert {v[3] for v in got.values()} == {"allow", "block"}
    # Against all rules on all URLs.
    assert 0 < tried < 0.35 * len(rules) * len(pages)


def test_odd_rules_and_odd_urls(spark):
    pages = [
        (1, None), (2, ""), (3, "no scheme/spam"), (4, "http://a.b/\u212a/x(1)[y]"), (None, "http://a.b/.+\\E\\Q"),
        (5, "http://A.B"), (5, "http://A.B"), (5, "http://a.b/long" + "g" * 5000), (6, "x://y\nz/ab"), (7, "http://h/ab"),
    ]
    rules = [
        (None, "block", "x(1)[y]", None), ("dot", "block", ".+", 3), ("quote", "allow", "\\e\\q", 5), (None, "block", None, 1),
        ("star", "block", "*", 9), ("bars", "block", "||", 9), (None, None, "a.b", 9), ("k", "block", "/k/", 9),
        ("two", "block", "ab", 0), ("two", "allow", "ab", 0), ("end", "block", "^", -5), ("same", "block", "/LONG*g|", 1),
        ("same", "block", "/LONG*g|", 1),
    ]
    assert found(spark, pages, rules)[0] == plain(pages, rules)
    assert found(spark, pages, [])[0] == plain(pages, [])
    assert found(spark, [], rules) == ({}, 0)


def test_further_columns_are_ignored(spark):
    pages = spark.createDataFrame([(1, "http://a.b/spam", "x", 1)], "page_id bigint, url string, `_page` string, place int")
    rules = spark.createDataFrame([("block", "/spam", "y", 1)], "verdict string, pattern string, regex string, key int")
    rows = filter_by_rules(pages, rules).collect()
    assert [(r.page_id, r.rule, r.verdict, r.n_tried) for r in rows] == [(1, "/spam", "block", 1)]
