"""The template tree against a plain Python version, on deep paths, variable segments and siblings that merge."""

import re
from collections import Counter, defaultdict

import pytest

from trendweave.llm import url_templates

RULES = (("block", "shop.example", "/a/b/c/d/e/f/g/bad/"), ("allow", "shop.example", "/a/b/c/d/e/f/g/good/"), ("allow", "wiki.example", "/en/"), ("block", "wiki.example", "/x1/p"), ("block", "wiki.example", "/x2/p"), ("block", "wiki.example", "/x3/p1"))


def _brute(pages, rules, min_support=5, min_share=0.02, smoothing=4.0, z=1.96, purity=0.7):
    rows, shape = [], lambda s: re.sub("[0-9]+", "#", s)
    for _, url in pages:
        host, path = "", ""
        if url and "://" in url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", url[url.index("://") + 3 :], re.DOTALL).groups()
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rows.append((host, path, max(fits, key=lambda f: len(f[0])) if fits else None, [s for s in path.split("/") if s]))
    parents, shapes, words = Counter(), Counter(), Counter()
    for host, _, _, segs in rows:
        for d, s in enumerate(segs):
            at = (host, d, tuple(map(shape, segs[:d])))
            parents[at] += 1
            shapes[(*at, shape(s))] += 1
            words[(*at, s)] += 1
    names = []
    for host, _, _, segs in rows:
        own = []
        for d, s in enumerate(segs):
            at = (host, d, tuple(map(shape, segs[:d])))
            often = lambda n, at=at: n >= min_support and n >= min_share * parents[at]
            own.append(s if often(words[(*at, s)]) else shape(s) if often(shapes[(*at, shape(s))]) else "*")
        names.append(tuple(own))
    raw = defaultdict(lambda: [0, 0])
    for (host, _, rule, _), own in zip(rows, names, strict=True):
        for d in range(len(own) + 1):
            if rule:
                raw[host, own[:d]][0] += 1
                raw[host, own[:d]][1] += rule[1] == "block"
            else:
                raw[host, own[:d]]  # noqa: B018
    apart = lambda n, b, s: abs(b - n * s) > z * (n * s * (1 - s)) ** 0.5
    side, groups = {}, defaultdict(lambda: [0, 0])
    for (host, node), (n, b) in raw.items():
        if node and raw[host, node[:-1]][0] and n:
            s = raw[host, node[:-1]][1] / raw[host, node[:-1]][0]
            if apart(n, b, s):
                side[host, node] = (host, node[:-1], b > n * s)
                groups[side[host, node]][0] += n
                groups[side[host, node]][1] += b
    labelled = [r[2][1] == "block" for r in rows if r[2]]
    out = []
    for (page, _), (host, path, rule, _), own in zip(pages, rows, names, strict=True):
        share = (sum(labelled) + 1) / (len(labelled) + 2)
        for d in range(len(own) + 1):
            n, b = raw[host, own[:d]]
            if (host, own[:d]) in side:
                total, bad = groups[side[host, own[:d]]]
                if not apart(n, b, bad / total):
                    n, b = total, bad
            if n and apart(n, b, share):
                share = (b + smoothing * share) / (n + smoothing)
        out.append((-1 if page is None else page, host, path, rule and rule[0], rule[1] if rule else "block" if share >= purity else "allow", host + "/" + "/".join(own)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages():
    rows = [(i, f"http://shop.example/a/b/c/d/e/f/g/{'bad' if i % 2 else 'good'}/{i}") for i in range(60)]
    rows += [(100 + i, f"http://shop.example/a/b/c/d/e/f/g/{'bad' if i % 2 else 'good'}{'/' * (i % 3)}") for i in range(10)]
    rows += [(200 + i, f"https://Wiki.Example/{'en' if i % 3 else f'x{i % 4}'}/p{i % 7}?q#f") for i in range(200)]
    rows += [(None, "http://wiki.example/x1/q"), (7, None), (7, ""), (7, "no scheme"), (7, "http://"), (8, "http://wiki.example/x1/q"), (8, "http://wiki.example/x1/q"), (9, "ftp://other.example/" + "deep/" * 400)]
    return rows


def test_brute_force(spark, pages):
    table = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, _host string, _rid int")
    got = sorted(((-1 if r["page_id"] is None else r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["template"]) for r in url_templates.judge_urls(table, rules=RULES).collect()), key=repr)
    assert got == _brute(pages, RULES)
    deep = {r[4] for r in got if r[0] in (101, 103) and r[3] is None}
    assert deep == {"block"}  # branches that differ from the eighth segment on are told apart


def test_no_rules_and_empty(spark, pages):
    table = spark.createDataFrame(pages, "page_id long, url string")
    assert {r["verdict"] for r in url_templates.judge_urls(table, rules=()).collect()} == {"allow"}
    assert url_templates.judge_urls(table.limit(0)).count() == 0
