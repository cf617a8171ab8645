"""Common opponents of every contest against plain Python, and the queries over whole tables."""

import os
import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from priorwise.operators import network
from priorwise.plans import catalog

DATA = "/root/testdata/sf0.001"


def expected(rows):
    """(advantage, n_common) of each contest and side from rows (contest_id, entity, opponent, won, rank)."""
    by_entity = {}
    for row in sorted(rows, key=lambda x: (x[4], x[0])):
        by_entity.setdefault(row[1], []).append(row)

    def latest(entity, now, other):
        out = {}
        for _, _, o, won, r in by_entity[entity]:
            if r < now and won is not None and o != other:
                out[o] = (won, r)
        return out

    want = {}
    for c, e, o, _, now in rows:
        a, b = latest(e, now, o), latest(o, now, e)
        both = [(a[m], b[m]) for m in a.keys() & b.keys()]
        w = [((1 if x[0] else 0.8) + (1 if y[0] else 0.8)) / 2 * (0.5 ** ((now - x[1]) / 50) + 0.5 ** ((now - y[1]) / 50)) / 2 for x, y in both]
        total = sum((x[0] - y[0]) * k for (x, y), k in zip(both, w))
        want[c, e] = (round(total / sum(w), 6) if both else 0.0, len(both))
    return want


def made(r):
    rows = []
    for c in range(300):
        a, b = r.sample(range(12), 2) if c % 3 else (0, r.randrange(1, 12))  # one side of a third is the same
        won = r.choice((0, 1, None))
        rows += [(c, a, b, won, c // 4), (c, b, a, None if won is None else 1 - won, c // 4)]
    return rows


def test_common_opponents(spark):
    rows = made(random.Random(4))
    ledger = spark.createDataFrame(rows, "contest_id long, entity long, opponent long, won int, event_rank long")
    got = {(x.contest_id, x.entity): (round(x.advantage, 6) + 0.0, x.n_common) for x in network.common_opponents(ledger).collect()}
    want = expected(rows)
    assert got.keys() == want.keys() and all(got[k] == (pytest.approx(want[k][0], abs=2e-6), want[k][1]) for k in want)


def test_small_blocks_and_odd_rows(spark):
    """Snapshots carry what earlier blocks left; nulls, one-sided contests and repeated rows are taken."""
    rows = made(random.Random(9))
    schema = "contest_id long, entity long, opponent long, won int, event_rank long"
    want = expected(rows)
    for sides in (1, 50):
        got = {(x.contest_id, x.entity): (round(x.advantage, 6) + 0.0, x.n_common) for x in network.common_opponents(spark.createDataFrame(rows, schema), block_sides=sides).collect()}
        assert got.keys() == want.keys() and all(got[k] == (pytest.approx(want[k][0], abs=2e-6), want[k][1]) for k in want)
    one_sided = [r for r in rows if r[0] != 299 or r[1] < r[2]]
    odd = [*one_sided, one_sided[-1], (900, None, 3, 1, 5), (901, 3, None, 1, 5), (902, 3, 4, 1, None)]
    got = network.common_opponents(spark.createDataFrame(odd, schema)).collect()
    assert len(got) == len(odd) and all(x.n_common == 0 for x in got if x.contest_id >= 900)
    assert [(pytest.approx(want[299, x.entity][0], abs=2e-6), want[299, x.entity][1]) for x in got if x.contest_id == 299] == [(x.advantage, x.n_common) for x in got if x.contest_id == 299]
    assert network.common_opponents(spark.createDataFrame([], schema)).count() == 0


def test_joined_rows_follow_the_ledger(spark):
    """Four times the contests of the same entities join about four times the rows, not sixteen times."""
    counts = []
    for n in (400, 1600):
        r = random.Random(2)
        rows = []
        for c in range(n):
            a, b = r.sample(range(12), 2)
            rows += [(c, a, b, 1, c), (c, b, a, 0, c)]
        ledger = spark.createDataFrame(rows, "contest_id long, entity long, opponent long, won int, event_rank long")
        sides = ledger.selectExpr("contest_id __c", "entity who", "opponent met", "event_rank __r", "double(won) won", "1d weight")
        sides = sides.join(network._blocks(sides, "__r", 100), "__r")
        counts.append(network._snapshots(sides.where("won IS NOT NULL"), sides).count())
    assert counts[0] <= 12 * 11 * 8 and counts[1] < 5 * counts[0]


def test_many_entities_are_sent_few_times(spark, monkeypatch):
    """Of many entities a result travels to a few cells, not to every contest of its entity, and no cell holds a large share."""
    monkeypatch.setattr(network, "BLOCK_SIDES", 500)
    monkeypatch.setattr(network, "CELL_ROWS", 1000)
    r = random.Random(6)
    names = list(range(600))
    schema = "contest_id long, entity long, opponent long, won int, event_rank long"
    for mixed in (False, True):
        if mixed:
            r.shuffle(names)  # those who meet are no longer neighbours by name
        rows = []
        for c in range(3600):
            a, b = (names[c % 60 * 10 + k] for k in r.sample(range(10), 2))
            won = r.choice((0, 1, None))
            rows += [(c, a, b, won, c // 90), (c, b, a, None if won is None else 1 - won, c // 90)]
        ledger, want = spark.createDataFrame(rows, schema), expected(rows)
        for sides in (None, 700):
            got = {(x.contest_id, x.entity): (round(x.advantage, 6) + 0.0, x.n_common) for x in network.common_opponents(ledger, block_sides=sides).collect()}
            assert got.keys() == want.keys() and all(got[k] == (pytest.approx(want[k][0], abs=2e-6), want[k][1]) for k in want)
        sides = ledger.selectExpr("contest_id __c", "entity who", "opponent met", "event_rank __r", "double(won) won", "1d weight", "0 __b")
        packed = [(x.x, x.y, pa.ipc.open_stream(x.payload).read_all()) for x in network._cells(sides, None, 15).collect()]
        sizes = {}
        for x, y, t in packed:
            sizes[x, y] = sizes.get((x, y), 0) + t.num_rows
        assert sum(pc.sum(t.column("side")).as_py() for *_, t in packed) == len(rows)
        assert max(sizes.values()) < 1.5 * 2 * len(rows) / 15 and (mixed or sum(sizes.values()) < 2 * len(rows))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_whole_tables(spark):
    from priorwise.operators import pairs
    from priorwise.operators import windows as w
    from priorwise.plans.views import contests

    ledger = w.chronological_rank(pairs.perspectives(contests(spark, DATA)), "day")
    rows = [tuple(x) for x in ledger.select("contest_id", "entity", "opponent", F.col("won").cast("int"), "event_rank").collect()]
    want = expected(rows)
    got = catalog.QUERIES["common_opponents"](spark, DATA).collect()
    assert len(got) == len(rows)
    assert all((x.advantage, x.n_common) == (pytest.approx(want[x.contest_id, x.entity][0], abs=2e-6), want[x.contest_id, x.entity][1]) for x in got)
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert catalog.QUERIES["card_lines"](spark, DATA).agg(F.sum("n")).first()[0] == lines
