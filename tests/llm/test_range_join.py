import math

import numpy as np
import pytest

from foliomill.llm.graph import components
from foliomill.llm.op07_embedding_dedup import choose_pivots, close_pairs, op7_embedding_dedup, range_join, turned, visited

SMALL = "/root/testdata/sf0.01"


def brute(rows, cosine=0.98):
    good = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            x = x / np.abs(x).max()
            good[i] = (x / np.linalg.norm(x), label)
    links = {i: {j for j, (y, m) in good.items() if j != i and m == k and len(x) == len(y) and x @ y >= cosine} for i, (x, k) in good.items()}
    out = {i: (0, i, True) for i, _, _ in rows}
    done = set()
    for i in sorted(good):
        if i not in done:
            todo, seen = [i], {i}
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            done |= seen
            out |= {j: (len(links[j]), i, i == j) for j in seen}
    return out


def test_random(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8))
    rows = [(i, (centres[i % 40] + rng.normal(scale=0.05, size=8)).tolist(), int(i % 3)) for i in range(500)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(60)] + [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [1.0, None] * 4, 1)]
    rows += [(2003, [float("inf")] * 8, 1), (2004, [], 1), (2005, rows[0][1], None), (None, rows[0][1], 0), (2006, [1.0, 2.0], 0), (2007, [2.0, 4.0], 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, kept string")
    want = brute(rows)
    for cost, block in ((0.01, 4096), (0.01, 16), (1e9, 100)):
        monkeypatch.setattr("foliomill.llm.op07_embedding_dedup.ROW_COST", cost)
        got = range_join(frame, block=block)
        assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
        assert {r.vec_id: tuple(r)[1:] for r in got.collect()} == want
    assert range_join(frame.limit(0)).count() == 0
    assert range_join(frame.where("vec_id = 2000")).collect()[0].n_links == 0


def test_cells_hold_all_partners():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(3000, 5))
    points /= np.linalg.norm(points, axis=1)[:, None]
    pivots = choose_pivots(points[:500], 10**7, 1, 0.2)
    assert len(pivots) > 8
    own, seen = visited(points, pivots, 0.2)
    a, b = np.nonzero(points @ points.T >= 0.98)
    assert seen[b, own[a]].all()


def test_planes_leave_fewer_cells_than_distances():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(2000, 64))
    points /= np.linalg.norm(points, axis=1)[:, None]
    _, seen = visited(points, points[:64], 0.2)
    assert seen.mean() < 0.6


def test_few_pairs_are_compared_in_full():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(1500, 64))
    points[1000:] = points[:500] + rng.normal(scale=rng.choice([0.01, 0.1, 0.2, 0.3], size=(500, 1)), size=(500, 64))
    points /= np.linalg.norm(points, axis=1)[:, None]
    i, j, compared = close_pairs(points, turned(points), 0.98, np.arange(700), np.arange(1500))
    want = set(zip(*(x.tolist() for x in np.nonzero(points[:700] @ points.T >= 0.98))))
    assert set(zip(i.tolist(), j.tolist())) == want and len(want) > 800
    assert compared < 0.05 * 700 * 1500


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 200)], [(9, 4), (4, 9), (7, 3), (3, 1), (8, 7)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in [e for e in edges if e[0] != e[1]]:
        x, y = want.setdefault(a, a), want.setdefault(b, b)
        want = {k: min(x, y) if v in (x, y) else v for k, v in want.items()}
    assert got == want


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert {r.vec_id: tuple(r)[1:] for r in op7_embedding_dedup(spark, SMALL).collect()} == brute(rows)
