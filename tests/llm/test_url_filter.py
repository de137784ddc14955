import random

from tarnflow.llm import url_filter as uf


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cuts = [i for i, c in enumerate(rest) if c in "/?#"]
        host = rest[: cuts[0]] if cuts else rest
        rest = rest[len(host) :]
        cuts = [i for i, c in enumerate(rest) if c in "?#"]
        path = rest[: cuts[0]] if cuts else rest
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in rules:
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h) + len(p), len(h), verdict == "block", h, p)
            best = max(best or (key, verdict, h + p), (key, verdict, h + p))
    return (host, path, best[2] if best else None, best[1] if best else default)


ODD = [None, "", "no scheme", "http://", "http:///en/x", "https://COM/en/", "https://x.com/en/1", "https://xcom/en/1", "https://a.example.com/en/7?x#y", "https://example.com/en/8", "http://example.net/de/8", "http://m.example.net/de/81/", "http://net/de/", "http://net/de", "ftp://a.org/es/", "ftp://org?x/es/", "a://b://c/d", "http://u:p@h.com:80/en/", "http://É.com/en/ü", "http://x.com/EN/", "http://a.com\n/en/", "http://..com/en/", "http://com./en/", "http://" + "a." * 300 + "com/en/" + "x" * 5000]


def test_against_plain_python(spark):
    rng = random.Random(1)
    urls = ODD + ["".join(rng.choice(["http://", ":", "/", "?", "#", ".", "com", "net", "org", "example", "/en/", "/de/", "7", "8", "A"]) for _ in range(rng.randint(1, 9))) for _ in range(800)]
    df = spark.createDataFrame([(i, u, "?", "?", "?", "?") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string, k string")
    more = [*uf.RULES, ("allow", "com", "/en/"), ("block", None, "/x"), ("block", "", "/"), ("allow", "a.com", None), ("allow", "Example.Org", "/en")]
    fixed = [(v, h.lower(), p or "") for v, h, p in more if h]
    for rules, plain in ((uf.RULES, uf.RULES), (more, fixed)):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge(df, uf.rules_frame(spark, rules)).collect()}
        for i, u in enumerate(urls):
            want = brute(u, plain)
            if want[2] is not None:  # a rule said with both verdicts blocks
                said = {v for v, h, p in plain if h + p == want[2]}
                want = (*want[:3], "block" if "block" in said else "allow")
            assert got[i] == want, u


def test_repeats_and_nothing(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/"), (1, "http://a.com/en/"), (None, "http://b.net/de/9")], "page_id long, url string")
    got = sorted((tuple(r) for r in uf.judge(df, uf.rules_frame(spark, uf.RULES)).collect()), key=repr)
    assert got == sorted([(1, "a.com", "/en/", "com/en/", "block")] * 2 + [(None, "b.net", "/de/9", "net/de/", "allow")], key=repr)
    assert uf.judge(df.limit(0), uf.rules_frame(spark, uf.RULES)).count() == 0
    assert {r.verdict for r in uf.judge(df, uf.rules_frame(spark, []), default="block").collect()} == {"block"}
