"""URL verdicts: rules against a plain version, trees on planted families of URLs."""

import random
import re

from seqlens.llm import url_filter

SCHEMA = "page_id long, url string, host string, rule string, label int"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "clash", "clash", 7) for i, u in enumerate(urls)], SCHEMA)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(url):
    host, path = parts(url)
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=None)


EDGES = [None, "", "no scheme", "://", "http://", "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/1", "http://example.com/en/", "http://www.example.com/en/x", "http://b.www.example.com/en/x?y", "http://xexample.com/en/1", "http://a.net/es/1", "http://a.net/fr/", "http://a.net/fr", "http://net/es/2", "http://a.org/en/#x", "http://a.com?x=://b.net/es/", "http://a.com#/x", "x://É.com/ü", "http://a.com:80/", "http://u@a.com/", "a://b://c.com/", "http://com/", "http://." + "a" * 50_000 + ".com/", "http://a.com/\n/x"]


def test_hosts_paths_and_rules(spark):
    got = url_filter.judged(pages(spark, EDGES * 2)).orderBy("page_id").collect()
    assert len(got) == 2 * len(EDGES)
    for r, url in zip(got, EDGES * 2):
        want = rule(url)
        assert (r.host, r.path) == parts(url), url
        assert r.rule == (want[3] if want else None), url
        assert r.verdict == (want[2] if want else r.verdict)
        assert r.verdict in ("allow", "block")


def test_no_pages(spark):
    assert url_filter.judged(pages(spark, [])).collect() == []


def test_one_label_only_allows(spark):
    got = url_filter.judged(pages(spark, ["http://a.org/1", "http://b.org/2", None])).collect()
    assert {(r.verdict, r.probability) for r in got} == {("allow", None)}


def planted(seed, n):
    """URLs of which label 1 are long, random, deep and full of parameters; no word tells them apart."""
    rng = random.Random(seed)
    def bad():
        name = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789-") for _ in range(rng.randint(14, 30)))
        return f"http://{name}.{rng.choice(['xyz', 'top', 'org'])}/" + "/".join(str(rng.randrange(10**6)) for _ in range(rng.randint(2, 6))) + "?" + "&".join(f"p{i}={rng.randrange(999)}" for i in range(rng.randint(2, 8)))
    def good():
        name = "".join(rng.choice(["ber", "lin", "new", "sta", "mar", "ket"]) for _ in range(rng.randint(1, 3)))
        return f"https://www.{name}.{rng.choice(['org', 'edu'])}/{rng.choice(['en', 'de'])}/" + rng.choice(["", "about", "page?id=3", "1234"])
    return [(bad(), 1) if rng.random() < 0.3 else (good(), 0) for _ in range(n)]


def test_held_out_urls(spark):
    known, held = planted(1, 600), planted(2, 400)
    labelled = spark.createDataFrame(known, "url string, label int")
    got = url_filter.judged(pages(spark, [u for u, _ in held]), labelled=labelled).orderBy("page_id").collect()
    right = sum((r.verdict == "block") == bool(label) for r, (_, label) in zip(got, held))
    assert right >= 0.97 * len(held)


def test_same_in_every_run(spark):
    urls = [u for u, _ in planted(3, 200)] + [f"http://best-casino-{i}.org/x/{i}" for i in range(40)]
    runs = [sorted((r.page_id, r.verdict, r.probability) for r in url_filter.judged(pages(spark, urls).repartition(n)).collect()) for n in (2, 5)]
    assert runs[0] == runs[1]
    assert sum(v == "block" for i, v, _ in runs[0] if i >= 200) >= 38


def test_features_by_hand(spark):
    row = url_filter.lexical(spark.createDataFrame([("https://a-b.c12.org/x/y//z?k=1&l=2#f", "a-b.c12.org", "/x/y//z")], "url string, host string, path string")).head()
    assert (row.depth, row.parameters, row.hyphens, row.labels, row.longest_label, row.query_length, row.scheme_secure) == (3, 2, 1, 3, 3, 7, 1)
    assert abs(row.host_digits - 2 / 11) < 1e-12
    assert abs(spark.range(1).select(url_filter.entropy(url_filter.F.lit("aabb")).alias("e")).head().e - 1) < 1e-12
