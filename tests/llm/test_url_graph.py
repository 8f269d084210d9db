"""Host graph and propagation, against plain loops."""

import random
import re
from collections import Counter, defaultdict

from strandmill.llm import urlfilter

SCHEMA = "page_id long, url string, html string"


def plain_links(rows):
    """Links by host, read from rows of (host, html) whose links are written in one of four known ways."""
    out = Counter()
    for host, targets, base, relative in rows:
        out.update((host, t) for t in targets if t != host)
        if base and base != host:
            out[host, base] += relative
    return out


def plain_scores(hosts, links, seeds, kind, kin=0.5, damping=0.85, rounds=12):
    seen = set(hosts) | {h for pair in links for h in pair}
    related = defaultdict(set)
    for h in seen:
        name = re.sub(":[0-9]*$", "", h)
        if not name or re.fullmatch("[0-9.]*", name):
            continue
        chain = [h] + ([name] if name != h else [])
        labels = name.split(".")
        chain += [".".join(labels[i:]) for i in range(1, len(labels) - 1)]
        for low, high in zip(chain, chain[1:], strict=False):
            related[low].add(high)
            related[high].add(low)
    edges = {(a, b): n for (a, b), n in links.items()} if kind == "trust" else {(b, a): n for (a, b), n in links.items()}
    total = Counter()
    for (a, _), n in edges.items():
        total[a] += n
    part = Counter()
    for (a, b), n in edges.items():
        part[a, b] += (1 - kin if related[a] else 1) * n / total[a]
    for a, near in list(related.items()):
        for b in near:
            part[a, b] += (kin if a in seen else 1) / len(near)
    score = dict(seeds)
    for _ in range(rounds):
        fresh = Counter(seeds)
        for (a, b), p in part.items():
            fresh[b] += damping * p * score.get(a, 0)
        score = fresh
    return score


def made(seed):
    """50 hosts, some without links, some linked only, with links written in all ways."""
    rng = random.Random(seed)
    hosts = [f"{a}h{i}.{b}" for i, (a, b) in enumerate((rng.choice(["", "www.", "a.b."]), rng.choice(["example.com", "example.org", "x.net", "org"])) for _ in range(50))]
    pages, plain = [], []
    for i in range(400):
        host = rng.choice(hosts[:40])
        targets = [rng.choice(hosts) for _ in range(rng.choice([0, 0, 1, 3, 6]))] if hosts.index(host) % 4 else []
        ways = ['<a href="https://{}/x">', "<img src=//{}/y.png>", " see http://{}?q=1 ", "<a class=b href='HTTP://{}#top'>"]
        base, relative = (rng.choice(hosts), rng.randint(0, 3)) if rng.random() < 0.2 else (None, 0)
        html = "".join(rng.choice(ways).format(t) for t in targets) + "<a href=/r>" * (0 if base else 2)
        if base:
            html = f'<base href="http://{base}/">' + html + "<a href=rel/x><a href='#top'><a href=mailto:x@y>" * relative
            targets = [base, *targets]
        pages.append((i, f"http://{host}/{rng.choice(['es', 'en', 'fr'])}/p", html))
        plain.append((host, targets, base, relative))
    return hosts, pages, plain


def test_propagation_equals_loops(spark, monkeypatch):
    hosts, pages, plain = made(4)
    links = plain_links(plain)
    frame = spark.createDataFrame(pages, SCHEMA)
    rows = urlfilter.ruled(frame)
    assert {(r.src, r.dst): r.links for r in urlfilter.host_links(rows).collect()} == dict(links)
    share, n = defaultdict(Counter), Counter()
    for r in rows.collect():
        n[r.host] += 1
        share[r.ruling][r.host] += 1
    want = {k: plain_scores(n, links, {h: c / n[h] for h, c in share[v].items()}, k) for k, v in (("trust", "allow"), ("distrust", "block"))}

    def check():
        got = urlfilter.judge(frame).collect()
        assert len(got) == len(pages)
        for r in got:
            t, d = want["trust"].get(r.host, 0), want["distrust"].get(r.host, 0)
            assert abs(r.trust - t) < 1e-9 and abs(r.distrust - d) < 1e-9
            if r.rule is None:
                assert r.verdict == ("block" if d >= 1 / 3 and d > t else "allow")

    check()
    monkeypatch.setattr(urlfilter, "FAN", 3)  # every host is a hub
    monkeypatch.setattr(urlfilter.fanned, "__defaults__", ("inner", 3))
    check()


def test_long_and_odd_pages(spark):
    long = "<a href=" * 100_000 + "http://" * 50_000
    rows = [(1, "http://a.net/x", long), (2, "http://1.2.3.4:80/x", "<a href=//b.org>"), (3, "http://b.org:8080/", None), (4, None, "http://b.org"), (None, "x", "")]
    frame = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], SCHEMA + ", host string, trust double")
    got = {r.page_id: r for r in urlfilter.judge(frame).collect()}
    assert got[2].host == "1.2.3.4:80" and got[3].host == "b.org:8080" and got[None].host == "" and got[4].verdict == "allow"
    kin = urlfilter.kinships(spark.createDataFrame([("1.2.3.4",), ("b.org:8080",), ("x.y.org",), ("",), ("a..b.c",), ("org",)], "host string"))
    assert sorted((r.giver, r.host) for r in kin.collect()) == [("b.org", "b.org:8080"), ("b.org:8080", "b.org"), ("x.y.org", "y.org"), ("y.org", "x.y.org")]
