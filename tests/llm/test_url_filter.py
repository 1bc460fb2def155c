from datetime import date
from urllib.parse import urlsplit

import pytest

from sluiceway.llm import url_filter as u

ENTRIES = [
    ("a", "block", "Evil.example", date(2024, 1, 10), "add"), ("a", "block", "evil.example", date(2024, 2, 10), "remove"), ("a", "block", "evil.example", date(2024, 3, 10), "add"), ("a", "block", "evil.example", date(2024, 3, 10), "add"),
    ("b", "allow", "evil.example/good/", date(2024, 1, 1), "add"), ("c", "block", "example", date(2024, 5, 1), "add"), ("d", "block", "flash.example", date(2024, 1, 1), "add"), ("d", "block", "flash.example", date(2024, 1, 1), "remove"),
    ("e", "allow", "tie.org", date(2024, 1, 1), "add"), ("f", "block", "tie.org", date(2024, 1, 1), "add"), ("g", "block", None, date(2024, 1, 1), "add"), ("g", "block", "late.org", None, "add"), ("g", "block", "/", date(2024, 1, 1), "add"), ("h", "block", "deep.org/a/b", date(2024, 1, 1), "add"),
]
CAPTURES = [(k, *x) for k, x in enumerate([
    ("http://evil.example/x", date(2024, 1, 9)), ("http://evil.example/x", date(2024, 1, 10)), ("https://user@www.EVIL.example.:8080/x?q#f", date(2024, 2, 9)), ("http://evil.example/x", date(2024, 2, 10)), ("http://evil.example/Good/page", date(2024, 4, 1)), ("http://evil.example/goodness", date(2024, 4, 1)),
    ("http://notevil.example/", date(2024, 4, 1)), ("http://notevil.example/", date(2024, 5, 1)), ("http://flash.example", date(2024, 2, 2)), ("http://tie.org/", date(2024, 2, 2)), ("http://deep.org/a/b/c", date(2024, 2, 2)), ("http://deep.org/a/bc", date(2024, 2, 2)), (None, date(2024, 2, 2)), ("no url", date(2024, 2, 2)), ("", date(2024, 2, 2)), ("http://tie.org/", None), ("http:///path", date(2024, 2, 2)), ("http://tie.org/" + "a/" * 5000, date(2024, 2, 2)),
])]


def brute(captures):
    spans = []
    for name in {(e[0], (e[2] or "").lower().rstrip("/")) for e in ENTRIES}:
        own = sorted({(e[3], e[4], e[1]) for e in ENTRIES if (e[0], (e[2] or "").lower().rstrip("/")) == name and e[3]})
        for k, (at, op, verdict) in enumerate(own):
            to = own[k + 1][0] if k + 1 < len(own) else date.max
            if op == "add" and to > at and name[1]:
                spans.append((*name, verdict, at, to))
    out = []
    for key, url, at in captures:
        parts = urlsplit(url or "")
        host = (parts.netloc.rpartition("@")[2].partition(":")[0].lower().removesuffix(".")) if parts.scheme and url and "://" in url else ""
        whole = host + parts.path.lower() if host else ""
        hit = [(len(p), v == "block", p, n) for n, p, v, a, b in spans if at and host and a <= at < b and (host == p or host.endswith("." + p) if "/" not in p else whole == p or whole.startswith(p + "/"))]
        best = max(hit, default=None)
        out.append((key, host, at, len(hit), ",".join(sorted({h[3] for h in hit})), best and best[2], bool(best and best[1])))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1000, 0])
def test_against_brute_force(spark, most):
    entries = spark.createDataFrame(ENTRIES, "list string, verdict string, pattern string, at date, op string")
    rows = [*CAPTURES, CAPTURES[1], CAPTURES[1], (None, "http://tie.org", date(2024, 3, 3))]
    captures = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "page_id long, url string, fetched date, copies long, list string, pattern string")
    assert sorted((tuple(r) for r in u.filter_urls(captures, entries, most_intervals=most).collect()), key=str) == brute(rows)
    assert u.filter_urls(captures.limit(0), entries).count() == 0
    none = u.filter_urls(captures, entries.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.n_active or r.blocked for r in none)


def test_only_dataframe_functions(spark):
    plan = u.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_captures_of_one_host_and_without_any(spark):
    entries = spark.createDataFrame([("l", "block", "hot.example", date(2024, 1, 1), "add"), ("l", "block", "other.example", date(2024, 1, 1), "add")], "list string, verdict string, pattern string, at date, op string")
    rows = [(k, None if k % 3 == 0 else "http://hot.example/" + "p" * (20_000 if k == 1 else 3), date(2024, 2, 1)) for k in range(900)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date").repartition(3)
    for most in (1000, 0):
        found = u.filter_urls(captures, entries, most_intervals=most).collect()
        assert {r.page_id: (r.blocked, r.n_active, r.lists) for r in found} == {k: (k % 3 > 0, int(k % 3 > 0), "l" if k % 3 else "") for k in range(900)}
