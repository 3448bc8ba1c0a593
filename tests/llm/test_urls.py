from __future__ import annotations

import datetime as dt
import random

from precinct.llm import urls

CAPTURES = "page_id bigint, url string, fetched date"
EVENTS = "list string, entry string, day date, action string"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def listed(events, kind, entry, on) -> bool:
    """The last day with events on or before ``on`` decides; an add outweighs a remove."""
    past = [e for e in events if e[0] == kind and e[1] == entry and e[2] <= on]
    last = max((e[2] for e in past), default=None)
    return any(e[3] == "add" for e in past if e[2] == last)


def test_verdicts_equal_a_replay_of_the_events(spark):
    rng = random.Random(5)
    hosts = ["a.example.com", "b.example.com", "example.org", "x.y.example.org"]
    entries = ["d:example.com", "d:a.example.com", "p:example.org/en", "p:example.org/en/x", "d:org", "p:a.example.com/en"]
    events = [
        (rng.choice(["block", "allow"]), rng.choice(entries), day(rng.randrange(30)), rng.choice(["add", "remove"]))
        for _ in range(80)
    ]
    captures = [
        (k, f"https://{rng.choice(hosts)}/{rng.choice(['en', 'en/x?q=1', 'enx', ''])}", day(rng.randrange(35)))
        for k in range(150)
    ]
    found = urls.filter_captures(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(events, EVENTS))
    rows = {r.page_id: r for r in found.collect()}
    for k, url, on in captures:
        host, _, path = url.removeprefix("https://").partition("/")
        active = []
        for entry in entries:
            kind, value = entry.split(":")
            if kind == "d":
                match = host == value or host.endswith("." + value)
            else:
                place = f"{host}/{path.split('?')[0]}"
                match = place == value or place.startswith(value + "/")
            active += [(entry, name) for name in ("block", "allow") if match and listed(events, name, entry, on)]
        best = max(active, key=lambda a: (len(a[0]), a[1] == "allow", a[0]), default=(None, "none"))
        assert (rows[k].n_active, rows[k].entry, rows[k].verdict) == (len(active), *best)


def test_trouble(spark):
    captures = [
        (1, None, day(1)), (2, "http://Spam.example.COM:80/x", None), (3, "not a url", day(1)),
        (4, "http://user@Spam.example.COM:80/x", day(1)), (4, "http://user@Spam.example.COM:80/x", day(1)), (5, "", day(1)),
        (6, "http://" + "a." * 300 + "com/" + "b/" * 300, day(1)),
    ]
    events = [("block", "d:spam.example.com", day(0), "add")] * 2 + [
        ("block", "d:spam.example.com", None, "remove"), (None, "d:com", day(0), "add"), ("block", "d:com", day(0), "hide"),
    ]
    frame = spark.createDataFrame(captures, CAPTURES).selectExpr("*", "'mine' AS entry", "'mine' AS found", "1 AS judged")
    lists = spark.createDataFrame(events, EVENTS)
    rows = urls.filter_captures(frame, lists).collect()
    assert sorted((r.page_id, r.verdict) for r in rows) == [
        (1, "none"), (2, "none"), (3, "none"), (4, "block"), (4, "block"), (5, "none"), (6, "none"),
    ]
    none = urls.filter_captures(frame, spark.createDataFrame([], EVENTS))
    assert {r.verdict for r in none.collect()} == {"none"}
    assert urls.filter_captures(spark.createDataFrame([], CAPTURES), lists).count() == 0
