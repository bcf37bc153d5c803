"""Sessions against a plain version that goes click by click."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import pytest

from termloom.llm import sessions

COLUMNS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double"
DAY = datetime(2024, 1, 1)


def plain(rows):
    best = {}
    for click, ts, arrived, client, kind, value in rows:
        if click is not None and client is not None and ts is not None:
            late = arrived is not None and arrived - ts > timedelta(minutes=60)
            final = kind == "purchase" and value is not None and value >= 60
            x = ((ts - datetime(1970, 1, 1)) // timedelta(microseconds=1), client, late, final, 0 if value is None else math.floor(value * 100 + 0.5))
            best[click] = min(best.get(click, x), x)
    clients, out = {}, []
    for click, (us, client, late, final, cents) in best.items():
        clients.setdefault(client, []).append((us, click, late, final, cents))
    for client, clicks in clients.items():
        clicks.sort()
        found = []
        for x in clicks:
            if x[2]:
                continue
            why = None
            if found:
                rows, last = found[-1][0], found[-1][0][-1]
                why = "end" if last[3] else "gap" if x[0] - last[0] >= 300 * 10**6 else "length" if x[0] - rows[0][0] > 7200 * 10**6 else None
                if why is None:
                    rows.append(x)
                    continue
                found[-1][1] = why
            found.append([[x], None])
        for k, (rows, why) in enumerate(found):
            stop = found[k + 1][0][0][0] if k + 1 < len(found) else math.inf
            n_late = sum(x[2] and rows[0][0] <= x[0] < stop for x in clicks)
            path = ",".join(str(x[1]) for x in rows)
            out.append((client, rows[0][1], rows[0][0], rows[-1][0], len(rows), n_late, sum(x[4] for x in rows), why or ("end" if rows[-1][3] else "none"), hashlib.sha256(path.encode()).hexdigest()))
    return sorted(out)


def some_clicks(rng, n, steps, final, gap):
    """Clicks of three clients, one of them with nine tenths; gap: chance of a certain break."""
    now, rows = dict.fromkeys((1, 2, 3), DAY), []
    for k in range(n):
        client = rng.choices((1, 2, 3), (90, 5, 5))[0]
        now[client] += timedelta(seconds=300 if rng.random() < gap else rng.choice(steps))
        rows.append((k, now[client], now[client] + timedelta(minutes=rng.choice((0, 0, 0, 70))), client, "purchase" if rng.random() < final else "view", rng.choice((None, 1.005, 59.99, 60.0))))
    return rows + rows[:40]


@pytest.mark.parametrize(
    ("parts", "steps", "final", "gap"),
    [(5, (0, 1, 20, 290, 299), 0.3, 0.1), (24, (1, 5, 280, 20), 0, 0), (13, (0, 60, 299), 0, 0.0004), (24, (0, 0, 0, 1), 0, 0), (9, (0, 0, 400), 0.5, 0)],
)
def test_like_click_by_click(spark, parts, steps, final, gap):
    """Islands inside a task, across some tasks, across nearly all of them; many equal times; most clicks final."""
    rows = some_clicks(random.Random(parts * len(steps)), 2500, steps, final, gap)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted(map(tuple, sessions.sessions(spark.createDataFrame(rows, COLUMNS)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain(rows)


def test_paths_in_pieces(spark, monkeypatch):
    """A walk that puts down its open session every few clicks gives the same rows, once the pieces are joined."""
    monkeypatch.setattr(sessions, "PIECE_IDS", 3)
    rows = some_clicks(random.Random(3), 400, (1, 20, 299), 0.1, 0.1)
    rules = sessions.Rules()
    clicks = sorted({(r[3], r[1], r[2] - r[1] > timedelta(minutes=60), r[0], r[4] == "purchase" and (r[5] or 0) >= 60) for r in rows})
    import numpy as np

    c = np.array([(cl, (ts - datetime(1970, 1, 1)) // timedelta(microseconds=1), k, 0, late, fin) for cl, ts, late, k, fin in clicks], dtype=sessions.CLICK)
    walk = sessions.Walk(0, rules)
    out = [r for s in range(0, len(c), 50) for r in walk.feed(c[s : s + 50])] + [walk.put_down(None, False)]
    assert any(r["kind"] == sessions.PIECE for r in out)
    df = spark.createDataFrame([tuple(r.get(n) for n in sessions.ARROW.names) for r in out], sessions.ROW)
    joined = sessions.joined_pieces(df.where("kind = 1")).collect()
    got = {(r["client_id"], r["session_id"]): (r["n_clicks"], r["n_late"], r["reason"], bytes(r["digest"]).hex()) for r in [*df.where("kind = 0").collect(), *joined]}
    assert got == {(x[0], x[1]): (x[4], x[5], x[7], x[8]) for x in plain(rows)}


def test_odd_clicks(spark):
    """Nulls in any column, clashing names, clicks that differ under one id, late clicks alone, one click, an empty table."""
    m = timedelta(minutes=1)
    rows = [
        (1, DAY, None, 1, None, None), (2, DAY, DAY, 1, "purchase", 60.0), (3, DAY, DAY, 1, "purchase", 60.0), (4, DAY, DAY + 61 * m, 1, "view", 5.0),
        (5, DAY - m, DAY + 90 * m, 1, None, 1.0), (None, DAY, DAY, 1, "view", 1.0), (6, None, DAY, 1, "view", 1.0), (7, DAY, DAY, None, "view", 1.0),
        (8, DAY + m, DAY, 2, "view", -0.005), (8, DAY, DAY, 2, "view", 2.0), (9, DAY, DAY + 61 * m, 3, "view", 2.0),
    ]
    df = spark.createDataFrame([(*r, "x", 0, 0) for r in rows], COLUMNS + ", client string, part int, rows int")
    assert sorted(map(tuple, sessions.sessions(df).collect())) == plain(rows)
    one = spark.createDataFrame(rows[:1], COLUMNS)
    assert sorted(map(tuple, sessions.sessions(one).collect())) == plain(rows[:1])
    assert sessions.sessions(spark.createDataFrame([], COLUMNS)).collect() == []
