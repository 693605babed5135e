import random

import pytest

from lodestrata.llm.urlfilter import Rule, UrlTrie, filter_urls, split_url


def fits(rule, host, path):
    return (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)


def best(rules, host, path):
    return max((r for r in rules if host and fits(r, host, path)), key=lambda r: (len(r.text), len(r.host), r.verdict == "block"), default=None)


def cases(n=300):
    rng = random.Random(1)
    for _ in range(n):
        rules = [
            Rule(rng.choice(["allow", "block"]), ".".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))), rng.choice(["", "/", "/x", "/x/", "/xy", "/x/y", "//", "/x//y"]))
            for _ in range(rng.randrange(8))
        ]
        urls = [".".join(rng.choice(["a", "b", ""]) for _ in range(rng.randrange(5))) + rng.choice(["", "/", "/x", "/xy/x", "/x/y/y", "//x", "/x//yx"]) for _ in range(20)]
        yield rules, urls


def test_trie_matches_brute_force():
    for rules, urls in cases():
        trie = UrlTrie(rules)
        for url in urls:
            host, path = split_url("http://" + url)
            assert trie.match(host, path) == best(rules, host, path), (rules, url)


def test_a_longer_rule_wins_over_a_deeper_host():
    trie = UrlTrie([Rule.parse("block", "com/en/some/long"), Rule.parse("allow", "example.com/")])
    assert trie.match("www.example.com", "/en/some/longer").verdict == "block"
    assert trie.match("www.example.com", "/en/").verdict == "allow"


@pytest.mark.parametrize("size", [2, 100])
def test_pages_in_one_or_more_passes(spark, size):
    rules, _ = next(c for c in cases() if len(c[0]) == 7)
    rules = list({(r.host, r.path): r for r in rules}.values()) + [Rule.parse("block", "Example.com/en/"), Rule.parse("allow", "www.example.com")]
    urls = [None, "", "no scheme/x", "http://", "HTTP://a.B/x?q#f", "x://y://a.b/x", "http://www.EXAMPLE.com/en/1", "http://b.example.com/en/1#/x", "http://example.com?/en/", "http://a.b#/x", "http://user@a.b:80/x", "http://é.a.b/xÉ/" + "y" * 5000]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(4, urls[4], "r")], "page_id long, url string, rule string")
    got = filter_urls(df, rules, default="block", rules_per_trie=size).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path = split_url(urls[r.page_id])
        rule = best(rules, host, path)
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == ((rule.text, rule.verdict) if rule else (None, "block"))
    assert filter_urls(df.limit(0), rules).collect() == [] and filter_urls(df, []).where("verdict <> 'allow'").count() == 0


def test_bad_rules():
    for verdict, text in (("deny", "a.b"), ("block", "/x")):
        with pytest.raises(ValueError):
            Rule.parse(verdict, text)
