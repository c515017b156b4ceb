import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm_frames import clashing, empty

from readpaths.llm import queries as Q
from readpaths.llm import url_markov as U

PAGES = "page_id long, url string, html string"


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    best = None
    for verdict, rule in Q.URL_RULES:
        name, prefix = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best


def fold(host, path):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), host + path)
    return re.sub("[^a-z0./-]", "*", re.sub("[0-9]+", "0", text))


def plain(rows):
    """Verdicts with dictionaries."""
    ruled = [(i, *host_path(u)) for i, u, _ in rows]
    kinds = defaultdict(Counter)
    for _, h, p in ruled:
        kinds[fold(h, p)][(rule_of(h, p) or ("open",))[0]] += 1
    counts = {"allow": Counter(), "block": Counter()}
    grams = lambda t: [("^^^" + t + "$")[i : i + 4] for i in range(len(t) + 1)]
    for t, c in kinds.items():
        if zlib.crc32(t.encode()) % 5:
            for kind in counts:
                for g in grams(t):
                    counts[kind][g] += c[kind]

    def log_p(kind, gram):
        p = 1 / U.SYMBOLS
        for size in range(4):
            seen = Counter()
            for g, n in counts[kind].items():
                if g[3 - size : 3] == gram[3 - size : 3]:
                    seen[g[3]] += n
            seen += Counter()
            if seen:
                p = (seen[gram[3]] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return math.log(p)

    known = {}

    def score(t):
        total = 0
        for g in grams(t):
            if g not in known:
                known[g] = log_p("allow", g) - log_p("block", g)
            total += known[g]
        return total / (len(t) + 1)

    held = [(round(score(t), 2), c["allow"], c["block"]) for t, c in kinds.items() if (c["allow"] or c["block"]) and zlib.crc32(t.encode()) % 5 == 0]
    a, r = sum(x[1] for x in held), sum(x[2] for x in held)
    cut = -math.inf
    if a and r and sum(counts["allow"].values()) and sum(counts["block"].values()):
        gains = [(sum(x[2] for x in held if x[0] < c) / r - sum(x[1] for x in held if x[0] < c) / a, -c) for c in {x[0] for x in held}]
        cut = -max(gains)[1] - 0.005
    out = []
    for i, h, p in ruled:
        by = rule_of(h, p)
        s = None if by else score(fold(h, p))
        out.append((i, h, p, by and by[1], by[0] if by else "allow" if s >= cut else "block", s))
    return out, cut


def rows_of(n=400):
    hosts = ["www.example.com", "shop.example.com", "EXAMPLE.com", "news.site.com", "a.net", "b.a.net", "spam-casino.org", "good.org", "com", "xcom"]
    paths = ["/en/1", "/en/", "/es/casino", "/fr/x.html", "/de/77", "", "/", "/en?x=1", "/EN/9#t"]
    out = [(i, f"http{'s' * (i % 2)}://{hosts[i % 10]}{paths[(i // 10) % 9]}{i // 90 or ''}", "") for i in range(n)]
    return out + [(1000, None, None), (1001, "", ""), (1002, "no scheme", ""), (1003, "://", ""), (1004, "a://b://com/", ""), (None, "http://x.com/", ""), (5, out[5][1], ""), (5, out[5][1], ""), (1005, "http://é.net/es/" + "z" * 5000, "")]


def test_matches_plain_model(spark):
    rows = rows_of()
    out = U.judge(clashing(spark.createDataFrame(rows, PAGES).repartition(4), "host", "a", "gram", "folded"), Q.URL_RULES)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    key = lambda r: (str(r[0]), str(r[1:4]))
    want, cut = plain(rows)
    got = sorted((tuple(r) for r in out.collect()), key=key)
    assert len(got) == len(want) and math.isfinite(cut)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and (g[5] == pytest.approx(w[5], abs=1e-9) if w[5] is not None else g[5] is None)
        assert g[4] == w[4] or abs(w[5] - cut) < 1e-6
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}


def test_without_one_kind_all_unruled_are_allowed(spark):
    rows = [(i, f"http://h{i}.com/", "") for i in range(30)] + [(99, "http://other.org/x", "")]
    assert {r["verdict"] for r in U.judge(spark.createDataFrame(rows, PAGES), Q.URL_RULES).collect()} == {"allow"}


@pytest.mark.parametrize("kinds", ["allow", "block", "neither"])
def test_a_kind_missing_from_the_calibration_fold(spark, kinds):
    """Both kinds are learned from, but no URL of one (or either) kind is left to calibrate with: unruled URLs are allowed."""
    rows, n = [], Counter()
    for i in range(4000):
        url = f"https://{'www' if i % 2 else 'x'}.example.{'com' if i % 2 else 'net/es'}/p{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}"
        kind = "allow" if i % 2 else "block"
        calibrates = zlib.crc32(fold(*host_path(url)).encode()) % U.CALIBRATION_FOLDS == 0
        if calibrates and (kinds == "neither" or kind != kinds):
            continue
        n[kind, calibrates] += 1
        rows.append((i, url, None))
    rows.append((9000, "https://other.org/page", None))
    assert n["allow", False] and n["block", False] and bool(n[kinds, True]) == (kinds != "neither")
    got = {r["page_id"]: r["verdict"] for r in Q.url_markov.judge(spark.createDataFrame(rows, PAGES), Q.URL_RULES).collect()}
    assert len(got) == len(rows) and got[9000] == "allow"


def test_a_very_long_url(spark):
    rows = [(i, f"https://a.example.com/page/{i}", None) for i in range(20)] + [(i, f"https://a.net/es/{i}", None) for i in range(20, 40)]
    rows.append((99, "https://b.org/" + "ab1/" * 250_000, None))
    assert len(U.judge(spark.createDataFrame(rows, PAGES), Q.URL_RULES).collect()) == 41


def test_no_python_in_the_plan(spark):
    plan = U.judge(spark.createDataFrame(rows_of(50), PAGES), Q.URL_RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions", plan)


def test_empty_table(spark):
    assert U.judge(empty(spark, PAGES), Q.URL_RULES).count() == 0
