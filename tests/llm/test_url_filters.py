import random
import re

from tempaudit.llm.url_filters import judge


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")


def brute(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_nested_rules_against_brute_force(spark):
    rng = random.Random(3)
    labels = ["a", "b", "com", "org", "x-y", "ab", "ü"]
    hosts = [".".join(rng.choices(labels, k=rng.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/a", "/a/", "/a/b", "/A/b/c", "/ü/"]
    rules = sorted({(rng.choice(hosts), rng.choice(paths)) for _ in range(60)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [None, "", "no scheme", "http://", "https://ORG/A?x#y", "x\ny://com/a\nb", "http://a.com:80/a", "http://.com/", "ftp://a..com/a#/b"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=://z/', '#f'])}" for _ in range(400)]
    urls += ["https://a.b.com/a/b"] * 500  # one url holds more than a third
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    table = spark.createDataFrame(rules + [(None, "/", "block"), ("", "/", "block")], "host string, path string, action string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages, table).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i] == brute(u, rules), u


def test_empty_tables_and_equal_rules(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    one = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, None)], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, action string")
    tie = spark.createDataFrame([("b", None, "allow"), ("b", "", "block")], "host string, path string, action string")
    assert judge(pages, tie).count() == 0
    assert [r.verdict for r in judge(one, none).collect()] == ["allow"] * 3
    assert sorted(r.verdict for r in judge(one, tie).collect()) == ["allow", "block", "block"]
