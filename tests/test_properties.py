"""Random histories vs brute force for the two windowless rewrites:
last change per key (reference: LAG + ROW_NUMBER) and snapshot change
counts with duplicate rows (reference: left join + NOT EXISTS, n×m fan-out)."""

import datetime as dt
import random
from decimal import Decimal

from pumpwatch.operators import observations as ob

PSCHEMA = "station_id long, fuel_type string, fetched_at timestamp, price decimal(10,2)"


def history(seed, dups):
    rnd = random.Random(seed)
    rows = []
    for s in range(1, 6):
        for f in ("a", "b"):
            for d in range(1, 15):
                if rnd.random() < 0.3:
                    continue                      # gaps
                copies = rnd.randint(1, 3) if dups else 1
                for _ in range(copies):
                    rows.append((s, f, dt.datetime(2024, 1, d), Decimal(rnd.choice(
                        ["1.00", "1.04", "1.05", "2.00", "2.50", "3.00"]))))
    return rows


def brute_last_change(rows):
    out = {}
    by_key = {}
    for s, f, t, p in rows:
        by_key.setdefault((s, f), []).append((t, p))
    for k, h in by_key.items():
        h.sort()
        ch = [(h[i - 1], h[i]) for i in range(1, len(h)) if h[i][1] != h[i - 1][1]]
        if ch:
            (t0, p0), (t1, p1) = ch[-1]
            r1 = lambda x: float(x.quantize(Decimal("0.1"), rounding="ROUND_HALF_UP"))
            out[k] = (t0, t1, r1(p0), r1(p1), r1(p1 - p0))   # SQL ROUND: half up
    return out


def brute_changes(rows, last=10):
    times = sorted({t for _, _, t, _ in rows}, reverse=True)[: last + 1]
    out = {}
    for i, t in enumerate(times[:last]):
        if i + 1 >= len(times):
            out[t] = None
            continue
        pt = times[i + 1]
        cur = [(s, f, p) for s, f, tt, p in rows if tt == t]
        prv = [(s, f, p) for s, f, tt, p in rows if tt == pt]
        ins = upd = 0
        for s, f, p in cur:
            matches = [q for s2, f2, q in prv if (s2, f2) == (s, f)]
            if not matches:
                ins += 1
            upd += sum(1 for q in matches if q != p)
        cur_keys = {(s, f) for s, f, _ in cur}
        dels = sum(1 for s, f, _ in prv if (s, f) not in cur_keys)
        out[t] = ins + upd + dels
    return out


def test_last_change_random(spark):
    st = spark.createDataFrame([(i, f"S{i}", "c", "r") for i in range(1, 6)],
                               "id long, name string, city string, region string")
    for seed in range(4):
        rows = history(seed, dups=False)
        got = {(r.station_id, r.fuel_type): (r.prev_fetched_at, r.fetched_at, r.prev_price,
                                             r.price, r.delta)
               for r in ob.price_moves(spark.createDataFrame(rows, PSCHEMA), st).collect()}
        assert got == brute_last_change(rows)


def test_snapshot_changes_random_with_duplicates(spark):
    for seed in range(4):
        rows = history(seed, dups=True)
        got = {r.fetched_at: r.changes
               for r in ob.snapshot_changes(spark.createDataFrame(rows, PSCHEMA)).collect()}
        assert got == brute_changes(rows)
