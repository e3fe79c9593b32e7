"""URL rules: the index against trying every rule."""

import random
import re
from collections import Counter

from tidemark.llm import urlrules
from tidemark.llm.urlrules import Rule

PAGES = "page_id long, url string, verdict string"


def brute(url, rules):
    import re

    rules = sorted(set(rules), key=lambda r: (-r.rank, -len(r.pattern), r.pattern, r.action))
    return next((r for r in rules if re.search(r.regex(), url, re.S)), None)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))]


RULES = [Rule("block", "||com/en/", 1), Rule("allow", "||example.com/en/7", 1), Rule("block", "/ads/"), Rule("block", "||spam*^x|"), Rule("allow", "|good.example.com/a"), Rule("block", "*"), Rule("block", "track"), Rule("block", "-ad-"), Rule("allow", "||a.b^"), Rule("block", "end|")]


def test_only_closed_literals_are_tokens():
    assert Rule("block", "||example.com/en/7").tokens() == ["example", "com", "en"]
    assert Rule("block", "/ads/").tokens() == ["ads"] and Rule("block", "track").tokens() == [] and Rule("block", "*x*").tokens() == []
    assert Rule("block", "||spam*^x|").tokens() == ["x"] and Rule("block", "|good.a").tokens() == ["good"]
    index = urlrules.RuleIndex([Rule("block", "||example.com/en/")], Counter({"example": 5, "com": 9, "en": 2}))
    assert list(index.by_token) == ["en"]


def test_index_equals_trying_every_rule(spark):
    rnd = random.Random(10)
    bits = ["http://", "HTTPS://", "example", "Good", ".", "com", "/en/", "/en/7", "spam", "x", "?q=/ads/", "#f", "/ads/", "-ad-", "track", "a.b", "end", "é", "\n", "net"]
    urls = [None, "", "no scheme", "a://b://c", "://", "http://" + "x" * 100_000] + ["".join(rnd.choices(bits[:2] * 3 + bits, k=rnd.randint(1, 9))) for _ in range(500)]
    d = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], PAGES)
    for rules, at_once in ((RULES[:5] + RULES[6:], 1000), (RULES, 1000), (RULES[:5] + RULES[6:], 3)):
        for r in urlrules.judge(d, rules, rules_at_once=at_once).collect():
            host, path = parts(urls[r.page_id])
            want = brute(host + path, rules)
            assert (r.host, r.path) == (host, path)
            assert (r.pattern, r.verdict) == ((want.pattern, want.action) if want else (None, "allow"))


def test_signs_that_fold_to_letters_part_tokens_as_the_patterns_see_them():
    rules = [Rule("block", "/ads^"), Rule("block", "||shop.com^"), Rule("block", "/Track/"), Rule("allow", "|a.b/x|")]
    index = urlrules.RuleIndex(rules, Counter())
    rnd = random.Random(11)
    for _ in range(4000):
        url = "".join(rnd.choices(["x.com", "shop.com", "/ads", "/Track", "/track/", "a.b/x", "\u212a", "\u0130", "\u017f", "K", "k", "/", "é", "ß"], k=rnd.randint(1, 5)))
        assert index.best(url) == brute(url, rules)
    assert index.best("x.com/ads\u212a") == rules[0] and index.best("shop.com\u0130") == rules[1]


def test_no_rules_and_no_pages(spark):
    d = spark.createDataFrame([(1, "http://a/b", None), (1, "http://a/b", None)], PAGES)
    assert [r.verdict for r in urlrules.judge(d, []).collect()] == ["allow", "allow"]
    assert urlrules.judge(d.limit(0), RULES).count() == 0


def test_an_end_is_the_very_end():
    for pattern in ("/wp-login.php|", "/wp-login.php^"):
        r = re.compile(urlrules.Rule("block", pattern).regex())
        assert r.search("x.com/wp-login.php") and not re.search(urlrules.Rule("block", "/wp-login.php|").regex(), "x.com/wp-login.php\n")
