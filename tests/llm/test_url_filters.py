import random

from meterlake.llm.url_filters import RULES, judge_urls

SCHEMA = "page_id long, url string, html string, verdict int, host string"
LINK = '<html><head><link rel="canonical" href="{}"></head>'


def test_decisions_follow_links_and_allow_goes_first(spark):
    rows = [
        (1, "http://a.com/en/1", None, 0, "x"),
        (2, "http://alias.net/x", LINK.format("http://a.com/en/1"), 0, "x"),
        (3, "http://b.net/y", '<meta http-equiv="refresh" content="0; url=http://alias.net/x">', 0, "x"),
        (4, "http://c.net/de/1", LINK.format("http://d.com/en/2"), 0, "x"),
        (5, "http://d.com/en/2", "", None, None),
        (6, "http://e.net/z", LINK.format("http://c.net/de/1"), 0, "x"),
        (7, "http://alone.net/q", "<p>canonical</p>", 0, "x"),
        (8, "http://logged.net/", None, 0, "x"),
        (9, None, LINK.format("http://a.com/en/1"), 0, "x"),
        (10, "no scheme", "", 0, "x"),
        (2, "http://alias.net/x", LINK.format("http://a.com/en/1"), 0, "x"),
    ]
    pages = spark.createDataFrame(rows, SCHEMA)
    log = spark.createDataFrame([("http://logged.net/", "http://b.net/y"), (None, "http://b.net/y")], "src string, dst string")
    got = judge_urls(pages, redirects=log).collect()
    assert len(got) == len(rows)
    verdicts = {r.page_id: r.verdict for r in got}
    # 5 keeps its own rule; 6 is an alias of an allowed and a blocked page
    assert verdicts == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow", 7: "allow", 8: "block", 9: "allow", 10: "allow"}
    assert {r.page_id: (r.host, r.path) for r in got if r.page_id > 8} == {9: ("", ""), 10: ("", "")}
    assert judge_urls(pages.limit(0)).count() == 0


def plain_rule(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_random_links_against_a_plain_walk(spark):
    rng = random.Random(8)
    names = [f"{h}{p}{i}" for h in ("a.com", "www.example.com", "b.net", "example.net", "c.org", "d.io") for p in ("/en/", "/de/", "/es/", "/x/") for i in (7, 8, 9)]
    urls = ["http://" + n for n in names]
    rows, links = [], []
    for i, u in enumerate(urls):
        to = rng.sample(urls, rng.choice([0, 0, 1, 1, 2]))
        links += [(i, urls.index(t)) for t in to]
        rows.append((i, u, "".join(LINK.format(t) for t in to), 0, "x"))
    rows += [(1000 + i, u, None, None, None) for i, u in enumerate(urls[:9])]
    long = "http://long.com/x/" + "y" * 300_000
    rows.append((2000, long, LINK.format("http://c.org/es/7"), 0, "x"))
    log = [(rng.choice(urls), rng.choice(urls)) for _ in range(12)] + [("http://unseen.io/", urls[3]), (long, "http://c.org/es/7")]
    links += [(urls.index(a), urls.index(b)) for a, b in log if a in urls and b in urls]
    group = {i: {i} for i in range(len(urls))}
    for a, b in links:
        if group[a] is not group[b]:
            merged = group[a] | group[b]
            group.update(dict.fromkeys(merged, merged))
    split = lambda n: (n.partition("/")[0], "/" + n.partition("/")[2])
    own = {i: plain_rule(*split(n)) for i, n in enumerate(names)}
    shared = {i: "allow" if any(own[j][0] == "allow" for j in g) else "block" if any(own[j][0] == "block" for j in g) else "allow" for i, g in group.items()}
    want = {i: (own[i][1], own[i][0] or shared[i]) for i in range(len(urls))}
    want |= {1000 + i: want[i] for i in range(9)}
    end = names.index("c.org/es/7")
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages, redirects=spark.createDataFrame(log, "src string, dst string")).collect()}
    assert got.pop(2000) == (None, shared[end])
    assert got == want
    assert {v for _, v in want.values()} == {"allow", "block"} and any(r is None and v == "block" for r, v in want.values())
