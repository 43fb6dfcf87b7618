"""URL verdicts: rules by a plain loop, templates by hand cases and a plain-Python tree."""
import random
import re
from collections import defaultdict

from docsift.llm import url_templates as U
from docsift.llm.queries import URL_RULES

SCHEMA = "page_id long, url string"


def fits(host, path, rules):
    best = None
    for verdict, text in rules:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            if best is None or len(text) > len(best[1]):
                best = (verdict, text)
    return best or (None, None)


def plain(rows, rules, min_rows=5, z=2, smooth=2, purity=80, depth=8):
    pages = []
    for i, url in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1], m[2]) if m else ("", "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        verdict, rule = fits(host, path, rules)
        tokens = re.sub("[0-9]+", "#", path)[1:].split("/") if path else []
        pages.append([i, host, path, rule, verdict, tokens[:depth] + (["??"] if len(tokens) > depth else []), ""])
    for d in range(depth + 1):
        here = [p for p in pages if len(p[5]) > d]
        count = defaultdict(int)
        for p in here:
            count[p[1], p[6], p[5][d]] += 1
        branch = defaultdict(list)
        of = lambda p: (p[1], p[6], p[5][d] if count[p[1], p[6], p[5][d]] >= min_rows else "?")
        for p in here:
            branch[of(p)].append(p)
        groups = defaultdict(list)
        for (host, node, name), own in branch.items():
            every = [p for p in here if (p[1], p[6]) == (host, node)]
            seen, all_seen = (sum(p[3] is not None for p in x) for x in (own, every))
            bad, all_bad = (sum(p[4] == "block" for p in x) for x in (own, every))
            off = bad * all_seen - all_bad * seen
            side = ("?" if name == "?" else "none" if not seen else
                    "alike" if off * off <= z * z * seen * all_bad * (all_seen - all_bad) else off > 0)
            ends = sum(len(p[5]) == d + 1 for p in own)
            groups[host, node, side, (8 * ends + len(own)) // (2 * len(own))].append(name)
        for (host, node, _, _), names in groups.items():
            label = names[0] if len(names) == 1 else f"{min(names)}?{len(names)}"
            for name in names:
                for p in branch[host, node, name]:
                    p.append(node + "/" + label)
        for p in here:
            p[6] = p.pop()
    seen, bad = sum(p[3] is not None for p in pages), sum(p[4] == "block" for p in pages)
    leaf = defaultdict(lambda: [0, 0])
    for p in pages:
        leaf[p[1], p[6]][0] += p[3] is not None
        leaf[p[1], p[6]][1] += p[4] == "block"
    out = []
    for i, host, path, rule, verdict, _, node in pages:
        n, k = leaf[host, node]
        learned = "block" if n and 100 * (k * seen + smooth * bad) >= purity * (n + smooth) * seen else "allow"
        out.append((i, host, path, rule, verdict or learned, host + node))
    return sorted(out, key=repr)


def judged(spark, rows, rules=URL_RULES, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in U.url_verdicts(df, rules, **kw).collect()), key=repr)


def crowd(seed=3, n=500):
    rng = random.Random(seed)
    hosts = ["a.net", "WWW.example.com", "www.shop.example.com", "b.org", "example.com", "com", "x.com.org"]
    rows = []
    for i in range(n):
        path = rng.choice(["", "/", "/en", "/en/", f"/es/{i}", f"/fr/{i}/", f"/en/{i}.html", f"/de/{i % 7}/a{i}/b",
                           f"/tag/{rng.choice('uvwxyz')}", "/es/x//y", f"/{rng.choice('abcde')}/{rng.choice('fgh')}/"])
        rows.append((i, f"http://{rng.choice(hosts[:2] if i % 2 else hosts)}{path}{rng.choice(['', '?q=1/2', '#t'])}"))
    return rows + [(1, None), (None, "no scheme"), (None, "http://"), (2, ""), (3, "a://B.NET/es/1?x://y"),
                   (4, "http://a.net/" + "s/" * 400), (5, "http://a.net/" + "9" * 20_000), (6, "x\n://a.net/es/\n/2")]


def test_equals_plain(spark):
    rows = crowd()
    assert judged(spark, rows) == plain(rows, URL_RULES)


def test_learned_verdicts(spark):
    rules = [("block", "h.net/bad/spam"), ("allow", "h.net/good/")]
    rows = ([(i, f"http://h.net/bad/spam{i}") for i in range(40)] + [(100 + i, f"http://h.net/bad/{i}") for i in range(5)]
            + [(200 + i, f"http://h.net/good/{i}") for i in range(20)] + [(300 + i, f"http://h.net/new/{i}") for i in range(20)])
    rows += [(400 + i, f"http://h.net/bad/x{chr(97 + i)}spam") for i in range(20)]     # rare segments: one wildcard
    got = {r[0]: r for r in judged(spark, rows, rules)}
    assert all(got[i][4] == "allow" for i in (*range(200, 220), *range(300, 320)))
    assert all(got[i][4] == "block" for i in range(40))
    assert sorted(got.values(), key=repr) == plain(rows, rules)


def test_merged_branches_share_evidence(spark):
    rules = [("block", f"h.org/{c}/0") for c in "abcdef"]
    rows = [(k * 100 + i, f"http://h.org/{c}/{i % 10}x") for k, c in enumerate("abcdef") for i in range(10)]
    got = judged(spark, rows, rules)
    assert got == plain(rows, rules) and {r[5] for r in got} == {"h.org/a?6/#x"}
    assert {r[4] for r in got} == {"block"}          # 6 labelled pages, all blocked; no branch alone has enough


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([(1, "http://a.net/es/1", "r", 1, "v")],
                               "page_id long, url string, rule string, n int, _rule string")
    out = U.url_verdicts(df, URL_RULES)
    assert [tuple(r) for r in out.collect()] == [(1, "a.net", "/es/1", "net/es/", "block", "a.net/?/?")]
    assert U.url_verdicts(df.limit(0), URL_RULES).count() == 0
