from collections import defaultdict

import pytest

from tremorlake.llm.url_filter import DAMPING, ROUNDS, RULES, judge


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    i = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[i:]
    j = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:i]), path[:j]


def rule(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text), default=None)


def brute(pages):
    edges, seeds, hosts = defaultdict(float), defaultdict(float), set()
    for _, url, links in pages:
        h, p = split(url)
        if not h:
            continue
        hosts.add(h)
        r = rule(h, p)
        if r:
            seeds[(0 if r.verdict == "allow" else 1, h)] += 1
        for t in {split("x:" + x if x.startswith("//") else x)[0] for x in links}:
            if t and t != h:
                edges[(h, t)] += 1
                hosts.add(t)
    chain = set()
    for h in hosts:
        x = h.split(".")
        chain |= {".".join(x[i:]) for i in range(max(1, len(x) - 1))}
    for h in chain:
        up = ".".join(h.split(".")[1:])
        if "." in up:
            edges[(h, up)] += 1
            edges[(up, h)] += 1
    out = []
    for kind in (0, 1):
        e = {(a, b) if kind == 0 else (b, a): w for (a, b), w in edges.items()}
        total = defaultdict(float)
        for (a, _), w in e.items():
            total[a] += w
        s = {h: w for (k, h), w in seeds.items() if k == kind}
        n = sum(s.values())
        s = {h: w / n for h, w in s.items()}
        r = dict(s)
        for _ in range(ROUNDS):
            new = defaultdict(float)
            for (a, b), w in e.items():
                new[b] += r.get(a, 0) * w / total[a]
            kept = sum(new.values())
            r = {h: DAMPING * new.get(h, 0) + (1 - DAMPING * kept) * s.get(h, 0) for h in {*new, *s}}
        out.append(r)
    return out


PAGES = [
    (1, "http://A.Example.NET/en/x?q#f", []),
    (2, "https://b.example.net/de/", ["http://spam.info/", "//c.example.org/z"]),
    (3, "https://c.example.org/fr/1", ["https://good.site/", "https://good.site/2", "/local"]),
    (4, "https://c.example.org/de/1", []),
    (5, "https://spam.info/a", ["http://b.example.net/"]),
    (6, "https://good.site/", []),
    (7, None, []),
    (8, "no url", []),
    (9, "http://net", []),
    (10, "http://net/", []),
    (11, "http://x.example.com/de/", []),
    (12, "http://x.example.com/en/de/", []),
    (13, "http://host?x://y/z", []),
    (14, "http://alone.zone/", []),
    (14, "http://alone.zone/", []),
]


def test_judge(spark):
    html = lambda links: "<p>" + "".join(f"<a class=x href=\"{x}\">t</a>" for x in links)
    df = spark.createDataFrame([(i, u, html(x) if x else None, "z") for i, u, x in PAGES], "page_id long, url string, html string, host string").repartition(3)
    got = judge(df).collect()
    assert len(got) == len(PAGES)
    trust, distrust = brute(PAGES)
    for r in got:
        url = next(u for i, u, _ in PAGES if i == r["page_id"])
        h, p = split(url)
        assert (r["host"], r["path"]) == (h, p)
        fit = rule(h, p)
        assert r["rule"] == (fit.text if fit else None)
        assert r["trust"] == pytest.approx(trust.get(h, 0), abs=1e-8) and r["distrust"] == pytest.approx(distrust.get(h, 0), abs=1e-8)
        assert r["verdict"] == (fit.verdict if fit else "block" if distrust.get(h, 0) > trust.get(h, 0) else "allow")
    by = {r["page_id"]: r["verdict"] for r in got}
    assert by[5] == "block" and by[6] == "allow" and by[14] == "allow"


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert judge(df).collect() == []
