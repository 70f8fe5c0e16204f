"""Operator 1 against brute force."""

import datetime
import random
import re

from cohortwise.llm.url_filters import intervals, temporal_filter

DAY = datetime.date(2024, 1, 1)
EVENTS = "list string, verdict string, kind string, value string, day date, action string"


def day(n):
    return None if n is None else DAY + datetime.timedelta(n)


def brute(url, on, events):
    """(verdict, list, kind, value, valid_from, n_active) for one capture."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    if url is None or on is None:
        return "none", None, None, None, None, 0
    host = m[1].lower().rstrip(".") if m else ""
    rest = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", url)
    steps = [s for s in rest[1].split("/") if s] if rest else []
    entries = {}
    for name, verdict, kind, value, d, action in events:
        if None not in (name, verdict, kind, value, d, action) and kind in ("domain", "path", "url") and action in ("add", "remove") and d <= on:
            by_day = entries.setdefault((name, verdict, kind, value.lower() if kind == "domain" else value), {})
            by_day[d] = by_day.get(d, False) or action == "add"
    found = []
    for (name, verdict, kind, value), by_day in entries.items():
        start = max(by_day)
        if not by_day[start]:
            continue
        hit = {"domain": bool(host) and (host == value or host.endswith("." + value)), "url": url == value,
               "path": bool(host) and "/".join([host, *steps, ""]).startswith(value + "/")}[kind]
        if hit:
            found.append(((["domain", "path", "url"].index(kind), len(value), verdict == "allow", start, [-ord(c) for c in name]), (verdict, name, kind, value, start)))
    return (*max(found)[1], len(found)) if found else ("none", None, None, None, None, 0)


def test_random_lists(spark):
    rng = random.Random(4)
    hosts = ["a.example.org", "b.a.example.org", "example.org", "other.net", "Example.ORG", "deep.er.b.a.example.org"]
    urls = [f"{rng.choice(['http', 'https', 'HTTP'])}://{rng.choice(['', 'u:p@'])}{rng.choice(hosts)}{rng.choice(['', ':80', '.'])}{rng.choice(['', '/', '/x', '/x/y', '//x/y/z', '/x?q=/y', '/x#/y'])}" for _ in range(300)]
    urls += [None, "", "no url", "http://", "mailto:a@example.org", "x" * 5000, "http://" + "a." * 300 + "org/" + "s/" * 500]
    values = {"domain": ["example.org", "A.example.org", "org", "net", "b.a.example.org"], "path": ["example.org", "example.org/x", "a.example.org/x/y", "other.net/x"], "url": [u for u in urls[:20]]}
    events = []
    for _ in range(150):
        kind = rng.choice(list(values))
        events.append((rng.choice(["one", "two", "on"]), rng.choice(["block", "allow"]), kind, rng.choice(values[kind]), day(rng.randint(0, 60)), rng.choice(["add", "add", "remove"])))
    events += [("n", "block", "domain", "org", None, "add"), ("n", None, "domain", "org", day(0), "add"), ("n", "block", "word", "org", day(0), "add"), ("n", "block", "domain", "org", day(0), "paint")]
    rows = [(i, rng.choice(urls) if i % 3 else urls[0], day(rng.choice([None, *range(70)])), "clash") for i in range(900)]  # a third has one URL
    captures = spark.createDataFrame(rows, "page_id int, url string, seen date, best string")
    got = temporal_filter(captures, spark.createDataFrame(events, EVENTS), "url", "seen").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.verdict, r.list, r.kind, r.value, r.valid_from, r.n_active) == brute(r.url, r.seen, events), (r, )
        assert r.best == "clash"


def test_intervals(spark):
    events = [("l", "block", "domain", "a", day(n), action) for n, action in ((0, "add"), (5, "remove"), (5, "add"), (9, "remove"), (9, "remove"), (12, "add"))]
    got = sorted((r.valid_from, r.valid_to) for r in intervals(spark.createDataFrame(events, EVENTS)).collect() if r.valid_to) 
    assert got == [(day(0), day(5)), (day(5), day(9))]


def test_nothing(spark):
    captures = spark.createDataFrame([(1, "http://a.org/", day(0))], "page_id int, url string, seen date")
    none = spark.createDataFrame([], EVENTS)
    assert [r.verdict for r in temporal_filter(captures, none, "url", "seen").collect()] == ["none"]
    assert temporal_filter(captures.limit(0), none, "url", "seen").count() == 0
