import random
import re
from collections import Counter

from peerband.llm.url_rules import match_urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("example.org", "/en/", "allow"),
         ("example.org", "/en/12", "allow"), ("b.example.org", "", "block"), ("ample.org", "/", "block"),
         ("net", "/é", "block"), ("com", "/fr/", "block")]
URLS = [None, "", "no scheme", "http://", "://", "http://example.org", "http://EXAMPLE.org/es/1",
        "https://www.example.org/en/1", "http://example.org/en/123?x=/es/", "http://a.com/fr/#x",
        "http://example.org?/es/", "x://y://example.org/es/", "http://b.example.org", "a://net/é/1",
        "http://xb.example.org/en/2", "http://org./", "http://example.org:80/es/", "http://com/de/",
        "http://..org/x", "http://ÉXAMPLE.org/es/", "http://notexample.org/es/1", "http://u@a.com/de/",
        "http://a.example.org/es", "line\nbreak://example.org/es/\n?q", "http://example.org/en/1é"]


def plain(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    verdicts = {}
    for h, p, v in rules:
        verdicts[h, p] = max(v, verdicts.get((h, p), v))
    fits = [(len(h) + len(p), len(h), h, p) for h, p in verdicts
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "other"
    *_, h, p = max(fits)
    return host, path, h + p, verdicts[h, p]


def judge(spark, urls, rules):
    pages = spark.createDataFrame(
        [(n if n % 9 else None, u, "x", 1) for n, u in enumerate(urls)],
        "page_id long, url string, host string, row long").repartition(4)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = match_urls(pages, table, "page_id", "url", default="other").collect()
    assert Counter((r.id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter(
        (n if n % 9 else None, *plain(u, rules)) for n, u in enumerate(urls))


def test_urls_equal_plain_matching(spark):
    judge(spark, URLS * 2 + [URLS[6]] * 200, RULES)


def test_random_nested_rules(spark):
    rng = random.Random(4)
    hosts = [".".join(rng.choice(["a", "b", "aa", "org"]) for _ in range(n)) for n in (1, 2, 3) * 9]
    paths = ["/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(5))) for _ in range(40)]
    rules = [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"]))
             for _ in range(60)]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(paths)}" for _ in range(400)]
    judge(spark, urls, rules)


def test_no_rules_and_no_urls(spark):
    judge(spark, URLS[:5], RULES)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert match_urls(pages, none, "page_id", "url").first().verdict == "allow"
    table = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert match_urls(pages.where("false"), table, "page_id", "url").count() == 0
