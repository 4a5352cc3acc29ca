from tidemark.llm import urls


def brute(url):
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(r), r, v) for v, r in urls.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


URLS = [None, "", "no scheme/x", "http://A.COM", "http://a.com/", "https://www.Example.com/en/x?y#z", "http://example.com/en/", "http://notexample.com/en/1", "x://net/es/", "x://a.net/fr", "ftp://a.net/fr/://b", "http://a.com?q=/", "http://É.com/#/x", "http://a.org:80/en", "://"]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {r.page_id: r._url for r in urls.judge(df, labels).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule), u
        assert out[i].verdict == (verdict or "allow")


def test_mined_rules_block_what_labels_show(spark):
    rows = [(i, f"http://{'casino' if i % 4 == 0 else 'news'}.site{i % 3}.org/{'win' if i % 8 < 4 else 'a'}/{i}") for i in range(400)] + [(None, "http://casino.new.org/win/1"), (1000, "http://news.new.org/win/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 400, 2)] + [(0, 0, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    out = urls.judge(pages, labels, mining=urls.Mining(support=0.01, confidence=0.9)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r._url.verdict == ("block" if "casino" in r.url else "allow"), r
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none, labels).count() == 0


def test_long_urls_are_mined_whole(spark):
    """Tokens beyond the sixteenth decide: `bad` blocks, and `x1`, of blocked and of allowed long urls, doesn't."""
    words = "/".join(f"w{i}" for i in range(20))
    of = lambda i: "/bad" if i % 10 == 0 else "/x1" if i % 10 == 1 else ""
    pages = spark.createDataFrame([(i, f"http://s.org/{words}{of(i)}/{i}") for i in range(1000)] + [(2000, "http://t.org/bad"), (2001, "http://t.org/x1"), (2002, f"http://t.org/{words}")], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0 and (i % 10 != 1 or i % 20 == 1)), 0) for i in range(1000)], "doc_id long, quality int, toxic int")
    out = {r.page_id: r._url.verdict for r in urls.judge(pages, labels, mining=urls.Mining(support=0.01)).collect()}
    assert all(v == ("block" if i == 2000 or (i < 1000 and i % 10 == 0) else "allow") for i, v in out.items())


def test_tokens_of_the_same_urls_stand_for_each_other(spark):
    """A rule on tokens that only occur together holds for a url with any of them, with more of its items too."""
    labelled = [(i, f"http://s.org/{'a/b/' if i % 2 else ''}{'c/d/' if i % 4 < 2 else ''}{i}") for i in range(400)]
    more = [(1000, "http://s.org/a/d"), (1001, "http://s.org/b/c"), (1002, "http://s.org/a/b"), (1003, "http://s.org/c/d")]
    pages = spark.createDataFrame(labelled + more, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 != 1), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    out = {r.page_id: r._url.verdict for r in urls.judge(pages, labels, mining=urls.Mining(support=0.01)).collect()}
    assert all(v == ("block" if i in (1000, 1001) or (i < 400 and i % 4 == 1) else "allow") for i, v in out.items())
