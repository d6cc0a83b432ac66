"""The change feed of leaderboards against brute force, with odd rows, ties, late lines and few places."""
import datetime
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from barlane.llm import leaderboard

DAY0 = datetime.date(1970, 1, 1)
LINE = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp_ntz, batch string, day int"


def prepared(lines, vendors, items):
    """batch, seen, day, nation, item, cents of each line."""
    nation, price = {}, {}
    for v, n in vendors:
        if v is not None and n is not None:
            nation[v] = min(n, nation.get(v, n))
    for i, p in ((i, p) for i, p in items if i is not None):
        own = None if p is None else math.floor(100 * p + 0.5)
        price[i] = own if price.get(i) is None else price[i] if own is None else min(own, price[i])
    for sale, no, item, vendor, quantity, amount, flag, at, *_ in lines:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, no)).encode())
        seen = 19723 + h % 150 if at is None else (at.date() - DAY0).days
        day = seen + h % 7 + (20 if h % 5 == 0 else 0)
        cents = None
        if nation.get(vendor) is not None and item in price:
            cents = math.floor(100 * amount + 0.5) if amount is not None else 0 if quantity is None or price[item] is None else quantity * price[item]
            cents = -cents if flag == "returned" else cents
        yield min(10, max(1, 1 + math.floor((day - 19723) * 10 / 180))), seen, day, nation.get(vendor), item, cents


def brute(rows, places):
    rows = sorted(rows, key=lambda r: r[0])
    latest, days, before = None, defaultdict(lambda: defaultdict(int)), None
    batch_of, top = {}, None
    for batch, seen, day, nation, item, cents in rows:
        if batch != before:
            latest, before = top, batch
        top = seen if top is None else max(top, seen)
        if cents is not None and (latest is None or seen + 3 >= latest):
            days[nation, day][item] += cents
            batch_of[day] = batch
    total, board, out = defaultdict(lambda: defaultdict(int)), defaultdict(dict), []
    for nation, day in sorted(days, key=lambda k: k[1]):
        for item, cents in days[nation, day].items():
            total[nation][item] += cents
        best = sorted((i for i, c in total[nation].items() if c > 0), key=lambda i: (-total[nation][i], i))[:places]
        new, old = {i: n for n, i in enumerate(best, 1)}, board[nation]
        for i in old | new:
            if old.get(i) != new.get(i):
                change = "enter" if i not in old else "exit" if i not in new else "move"
                out.append((nation, day, i, batch_of[day], change, old.get(i), new.get(i), total[nation][i]))
        board[nation] = new
    return sorted(out, key=repr)


def test_equals_brute_force_on_odd_rows(spark):
    rng = random.Random(11)
    vendors = [(v, rng.choice([1, 2, 2, 3])) for v in range(12)] + [(12, None), (3, 7), (None, 1)]
    items = [(i, rng.choice([1.005, 2.0, 10.0, None])) for i in range(40)] + [(5, 0.5), (None, 1.0)]
    lines = []
    for s in range(900):
        at = None if rng.random() < 0.05 else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=min(149, rng.randint(0, 8) + s // 7), hours=rng.randint(0, 23))
        item = 1 if s % 3 == 0 else rng.choice([None, *range(44)])
        amount = rng.choice([None, 1.005, 5.0, 5.0, 20.0, 0.0])
        lines.append((None if s % 50 == 0 else s // 3, s % 3, item, 2 if s % 3 == 1 else rng.choice([None, *range(14)]), rng.choice([None, 1, 7]), amount, rng.choice(["kept", "returned", None]), at, "clash", 1))
    lines += lines[:40]
    made = leaderboard.enriched(
        spark.createDataFrame(lines, LINE).repartition(5), spark.createDataFrame(vendors, "vendor_id long, nation_id int"), spark.createDataFrame(items, "item_id long, price double"),
    )
    want = list(prepared(lines, vendors, items))
    assert Counter(map(tuple, made.collect())) == Counter(want)
    got = sorted((tuple(r) for r in leaderboard.changes(made, places=3, parts=3).collect()), key=repr)
    expected = brute(want, 3)
    assert {r[4] for r in expected} == {"enter", "exit", "move"} and len(expected) > 60
    assert got == expected


def test_an_empty_table_gives_an_empty_feed(spark):
    lines = spark.createDataFrame([], "batch int, seen long, day long, nation_id int, item_id long, cents long")
    got = leaderboard.changes(lines)
    assert got.collect() == [] and got.columns == [c.split()[0] for c in leaderboard.FEED.split(", ")]


@pytest.mark.parametrize("places", [1, 2, 5])
def test_best_breaks_ties_by_item(places):
    import numpy as np

    ids, cents = np.array([9, 4, 7, 1, 3, 8]), np.array([5, 5, 0, 5, -2, 9])
    want = sorted((i for i, c in zip(ids, cents) if c > 0), key=lambda i: (-dict(zip(ids, cents))[i], i))[:places]
    assert ids[leaderboard._best(ids, cents, places)].tolist() == want
