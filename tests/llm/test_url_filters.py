"""URL filters against a loop over all rules."""

import random
import re

import pytest

from pointweave.llm import url_filters as u

PREFIX = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "bare.net", "")]
PATTERNS = [("block", "||spam-farm."), ("block", "/casino^"), ("block", "*pills*")]


def plain(url):
    at = (url or "").find("://")
    if at < 0:
        host = path = ""
    else:
        rest = url[at + 3 :]
        host = re.match(r"(?s)[^/?#]*", rest)[0]
        path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans(u.UPPER, u.LOWER))
    fits = [(len(h + p), h + p, v) for v, h, p in PREFIX if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2], None
    target = host + path
    hits = []
    for v, p in PATTERNS:
        r = {"||spam-farm.": r"(?s)^(?:[^/]*\.)?spam-farm\.", "/casino^": r"(?s)/casino(?:[^0-9A-Za-z]|$)", "*pills*": r"(?s).*pills.*"}[p]
        if re.search(r, target):
            hits.append((len(p), p, v))
    return host, path, None, max(hits)[2] if hits else "allow", max(hits)[1] if hits else None


def urls():
    rng = random.Random(2)
    hosts = ["example.org", "a.example.org", "notexample.org", "EXAMPLE.Org", "x.com", "com", "org", "spam-farm.net", "b.spam-farm.io", "xspam-farm.io", "bare.net", "w.bare.net:80", "cheappills.net", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/en/2", "/fr/9", "/de/9?q=/fr/", "/casino", "/casino/x", "/casinos", "//", "/a\nb", "/pills"]
    made = [f"{rng.choice(['http', 'https', 'ftp'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '#top', '?a=b://c', '?x'])}" for _ in range(600)]
    return [*made, None, "", "no scheme", "://", "a://b://c.com/fr/", "http://ünï.com/fr/ß", "x" * 20000 + "://org/"]


@pytest.fixture(scope="module")
def rules():
    return [u.prefix_rule(*r) for r in PREFIX] + [u.pattern_rule(*p) for p in PATTERNS]


#: Every name that the operator uses inside.
CLASHES = ["verdict", "_judged", "_best", "_target", "target", "best", "token", "tokens", "regex", "n", "count", "prefix", "chars", "rule", "a.b"]


@pytest.mark.parametrize("inline", [5000, 0])
def test_judgements(spark, rules, monkeypatch, inline):
    monkeypatch.setattr(u, "INLINE", inline or 1)
    rows = [(i, x, *CLASHES) for i, x in enumerate(urls())]
    schema = "page_id long, url string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    df = spark.createDataFrame([*rows, (0, rows[0][1], *CLASHES)], schema)
    judged = u.judge(df, rules)
    kept = [c for c in df.columns if c not in ("verdict", "rule")]
    assert judged.columns == [*kept, "host", "path", "rule", "pattern", "verdict"]
    got = judged.collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict, r.pattern) == plain(r.url), r.url
        assert all(r[c] == c for c in kept[2:])


def test_tokens_are_in_every_match(rules):
    by = {r.name: r.tokens for r in rules}
    assert by["example.org/en/1"] == ("example", "org", "en") and by["*pills*"] == () and by["||spam-farm."] == ("spam", "farm") and by["bare.net"] == ("bare", "net")


def test_many_rules_and_empty(spark):
    many = [u.prefix_rule("block", f"h{i}.test", f"/p{i}/") for i in range(500)]
    df = spark.createDataFrame([(i, f"http://www.h{i}.test/p{i}/x") for i in range(0, 600, 7)], "page_id long, url string")
    assert {r.page_id: r.rule for r in u.judge(df, many).collect()} == {i: f"h{i}.test/p{i}/" if i < 500 else None for i in range(0, 600, 7)}
    assert u.judge(df.limit(0), many).collect() == []
    assert {r.verdict for r in u.judge(df, []).collect()} == {"allow"}


def test_a_hundred_thousand_rules(spark):
    many = [u.prefix_rule("block", f"h{i}.test", f"/p{i}/") for i in range(100_000)] + [u.pattern_rule("block", "*q*")]
    df = spark.createDataFrame([(i, f"http://www.h{i}.test/p{i}/x") for i in range(0, 110_000, 997)] + [(-1, "http://q")], "page_id long, url string")
    want = {i: (f"h{i}.test/p{i}/", "block") if i < 100_000 else (None, "allow") for i in range(0, 110_000, 997)} | {-1: (None, "block")}
    assert {r.page_id: (r.rule, r.verdict) for r in u.judge(df, many).collect()} == want
