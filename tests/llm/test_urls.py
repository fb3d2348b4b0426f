"""URL rules and trust over the host graph."""

import random
import re

from tenderlake.llm import urls

SCHEMA = "page_id long, url string, html string, rule string"


def expected(url):
    """Host, path and rule of a url, plainly."""
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p) for _, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


URLS = [
    "http://www.example.com/en/1", "https://EXAMPLE.com/en/?x#y", "http://a.b.net/es/2", "http://net/fr/", "x", None, "",
    "http://com", "http://evilcom/", "ftp://a.com?q=/en/", "http://a.net/ES/1", "http://É.net/fr/1", "a://b://c/d", "http://example.com/en",
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, None, "old") for i, u in enumerate([*URLS, URLS[0]])], SCHEMA)
    rows = urls.judge_urls(df).collect()
    assert len(rows) == len(URLS) + 1
    verdicts = {h + p: v for v, h, p in urls.RULES}
    for r in rows:
        want = expected([*URLS, URLS[0]][r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == want
        if want[2]:
            assert r["verdict"] == verdicts[want[2]]
    assert urls.judge_urls(df.limit(0)).collect() == []


def brute_rank(edges, seeds, rounds=300):
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    rank = {h: (1 - urls.DAMPING) * s for h, s in seeds.items()}
    for _ in range(rounds):
        new = {h: (1 - urls.DAMPING) * s for h, s in seeds.items()}
        for (a, b), n in edges.items():
            new[b] = new.get(b, 0) + urls.DAMPING * rank.get(a, 0) * n / out[a]
        rank = new
    return rank


def test_spread_equals_plain_iteration(spark):
    edges = {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1, ("c", "a"): 1, ("d", "c"): 5}
    seeds = {"a": 1.0, "d": 0.5}
    table = spark.createDataFrame([(*e, n) for e, n in edges.items()], "src string, dst string, n long")
    start = spark.createDataFrame([(h, s, 1.0) for h, s in seeds.items()], "host string, own double, every double")
    got = {r["host"]: r for r in urls.spread(table, start).collect()}
    for host, want in brute_rank(edges, seeds).items():
        assert abs(got[host]["own"] - want) < 1e-4
    for host, want in brute_rank(edges, dict.fromkeys(seeds, 1.0)).items():
        assert abs(got[host]["every"] - want) < 1e-4


def test_verdicts_follow_the_ranks(spark, monkeypatch):
    link = '<a href="https://bad.net/es/1">x</a> <a HREF=//Bad.net>y</a> <a href="/own">z</a>'
    rows = [(i, f"http://bad.net/es/{i}", None, None) for i in range(4)]
    rows += [(10, "http://fan.net/x", link, None), (11, "http://calm.net/x", "<p>bad.net</p>", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(df).collect()}
    assert got[10] == "block" and got[11] == "allow" and got[0] == "block"
    monkeypatch.setattr(urls, "spread", lambda edges, seeds: seeds)
    assert {r["page_id"]: r["verdict"] for r in urls.judge_urls(df).collect()}[10] == "allow"


def page(i, host, *targets, path="/x"):
    return (i, f"http://{host}{path}", " ".join(f'<a href="http://{t}/">x</a>' for t in targets), None)


def verdicts(spark, pages):
    return {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(pages, SCHEMA)).collect()}


def test_blocks_spread_at_the_production_threshold(spark):
    bad = [page(0, "bad.net", path="/es/1")]
    got = verdicts(spark, [*bad, page(1, "fan.org", "bad.net")])
    assert got[1]["verdict"] == "block" and abs(got[1]["distrust"] - urls.DAMPING) < 1e-5
    fans = [page(i, f"fan{i}.org", "bad.net") for i in range(1, 11)]
    lone = [page(100 + i, f"lone{i}.net", path="/fr/1") for i in range(20)]
    got = verdicts(spark, [*bad, *fans, *lone, page(50, "other.org", "calm.org"), page(51, "calm.org")])
    assert {got[i]["verdict"] for i in range(1, 11)} == {"block"}
    assert all(abs(got[i]["distrust"] - urls.DAMPING) < 1e-5 for i in range(1, 11))
    assert got[50]["verdict"] == got[51]["verdict"] == "allow"


def test_linkers_do_not_clear_a_blocked_host(spark):
    blocked = [page(i, "bad.net", path="/es/1") for i in range(49)] + [page(49, "bad.net", path="/free")]
    got = verdicts(spark, [*blocked, page(60, "a.org", "bad.net"), page(61, "b.org", "a.org")])
    assert got[49]["rule"] is None and got[49]["verdict"] == "block"
    # Distrust fades with the distance: a linker's linker is not blocked.
    assert got[60]["verdict"] == "block" and got[61]["verdict"] == "allow"
    assert got[60]["distrust"] > got[61]["distrust"] > 0.3


def test_trust_and_distrust_equal_plain_iteration(spark):
    draw = random.Random(3)
    names = ["a.net", "b.net", "c.com", "d.com", *(f"h{i}.org" for i in range(12))]
    pages = []
    for i in range(150):
        host = draw.choice(names)
        path = draw.choice(["/es/1", "/x"]) if host.endswith("net") else "/x"
        pages.append(page(i, host, *draw.sample(names, draw.randint(0, 4)), path=path))
    share, edges = {n: [0, 0, 0] for n in names}, {}
    for p in pages:
        host, _, rule = expected(p[1])
        share[host][{None: 2, "com/": 0}.get(rule, 1)] += 1
        for t in re.findall("http://([^/]*)/", p[2]):
            if t != host:
                edges[host, t] = edges.get((host, t), 0) + 1
    share = {h: [x / max(sum(v), 1) for x in v] for h, v in share.items() if sum(v)}
    want = []
    for which in (0, 1):  # trust goes along the links, distrust against them
        way = {(a, b) if which == 0 else (b, a): n for (a, b), n in edges.items()}
        hosts = {h for e in way for h in e} | set(share)
        own = brute_rank(way, {h: share.get(h, [0, 0, 0])[which] for h in hosts})
        every = brute_rank(way, dict.fromkeys(hosts, 1.0))
        rank = {}
        for h, v in share.items():
            came, all_came = (r[h] - (1 - urls.DAMPING) * s for r, s in ((own, v[which]), (every, 1.0)))
            rank[h] = v[which] + urls.DAMPING * v[2] * (came / all_came if all_came > 1e-9 else 0.0)
        want.append(rank)
    got = verdicts(spark, pages)
    for r in got.values():
        trust, distrust = want[0][r["host"]], want[1][r["host"]]
        assert abs(r["trust"] - trust) < 1e-4 and abs(r["distrust"] - distrust) < 1e-4
        if r["rule"] is None:
            assert r["verdict"] == ("block" if distrust >= urls.THRESHOLD and distrust > trust else "allow")


def test_query(spark):
    from tenderlake.llm.queries import op10_urls

    folder = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = op10_urls(spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r["host"], r["path"], r["rule"]) == expected(pages[r["page_id"]])
        assert r["verdict"] in ("allow", "block")
