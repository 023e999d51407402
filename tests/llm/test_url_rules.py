import random
import re

from loadlens.llm.url_rules import FIXED_RULES, judge_urls, mine_rules

SCHEMA = "page_id long, url string, verdict string"
LABELS = "doc_id long, quality int, toxic int"


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
    fits = [
        (len(h + p), h + p, v)
        for h, p, v in FIXED_RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [
    "http://www.EXAMPLE.com/en/1?x=1", "https://blog.example.com/en/2", "http://example.com/EN/", "http://a.com",
    "http://com/", "http://xcom/", "http://a.net/es/1", "http://a.net/fr/", "http://net/fr/x#y", "http://a.net/frx/",
    "http://www.example.com?x=/en/", "http://Ä.COM/", "a://b://c.com/x", "no scheme", "", None, "://", "http://m.www.example.com/en/",
    "http://a.com/\n", "http:///en/", "http://h.com/" + "x/" * 3000,
]


def test_fixed_rules_against_brute_force(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "x"), (None, URLS[1], "")]
    none = spark.createDataFrame([], LABELS)
    got = judge_urls(spark.createDataFrame(rows, SCHEMA), none).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute(r.url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), r.url
    assert judge_urls(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(9)
    hosts, kinds = ["pills", "shop", "news", "blog"], ["buy", "read", "x"]
    rows, labels = [], []
    for i in range(600):
        host, kind = rng.choice(hosts), rng.choice(kinds)
        rows.append((i, f"http://{host}.org/{kind}/{i}", ""))
        bad = host == "pills" and kind == "buy"
        if i < 400:
            labels.append((i, int(not bad), 0) if rng.random() < 0.5 else (i, 1, int(bad)))
    labels += [(None, 0, 1), (5, None, None), (10**6, 0, 0)]
    pages, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    rules = mine_rules(pages, known, 0.02, 0.9, 1.5).collect()
    assert rules and all({"path:buy"} <= set(r.antecedent) for r in rules)
    assert all(r.index_token in r.antecedent for r in rules)
    for r in judge_urls(pages, known).collect():
        host, kind = re.match(r"http://(\w+)\.org/(\w+)/", r.url).groups()
        assert r.verdict == ("block" if (host, kind) == ("pills", "buy") else "allow")
