import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from foliomill.llm import op07_embedding_dedup as op07
from foliomill.llm.op07_embedding_dedup import range_join

from .test_range_join import brute


def frame_of(spark, rows, number="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{number}>, label int")


def on_disk(spark):
    """Bytes of shuffles and of what is saved between jobs."""
    context = spark.sparkContext
    shuffles = [d.getPath() for d in context._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    tops = [*shuffles, spark.conf.get("spark.checkpoint.dir").removeprefix("file:")]
    found = [os.path.join(at, name) for top in tops for at, _, names in os.walk(top) for name in names]
    return sum(os.path.getsize(f) for f in found if os.path.exists(f))


def test_disk_follows_the_vectors_not_their_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v, 0) for i, v in enumerate(rng.normal(size=(2000, 64)).astype(np.float32).tolist())]
    frame = frame_of(spark, rows, "float")
    before = on_disk(spark)
    assert range_join(frame, block=32).count() == 2000
    # 63 blocks meet one another; each vector is 256 bytes.
    assert on_disk(spark) - before < 10 * 256 * 2000


@pytest.mark.parametrize("number", ["float", "double"])
def test_blocks_and_dense_groups(spark, monkeypatch, number):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=24)
    near = centre + rng.normal(scale=0.12, size=(300, 24))
    vectors = [*near, *rng.normal(size=(100, 24)), *(3.0 * near[:20])]
    rows = [(i, np.asarray(v, np.float32 if number == "float" else np.float64).tolist(), i % 2) for i, v in enumerate(vectors)]
    rows += [(5000 - i, rows[2 * i][1], 0) for i in range(60)]  # equal vectors under smaller and larger ids
    rows += [(6000 + i, rng.normal(size=3).tolist(), 0) for i in range(40)]
    rows += [(7000 + i, [1.0, float(i)], 1) for i in range(40)]
    want = brute([(i, np.asarray(v, np.float32).tolist() if number == "float" else v, k) for i, v, k in rows])
    assert max(n for n, _, _ in want.values()) > 100
    for cost, block in ((0.001, 64), (1e9, 50)):
        monkeypatch.setattr(op07, "ROW_COST", cost)
        got = {r.vec_id: tuple(r)[1:] for r in range_join(frame_of(spark, rows, number), block=block).collect()}
        assert got == want


@pytest.mark.parametrize("pivots", [1, 12])
@pytest.mark.parametrize("share", [0, 1 / 16, 2])
def test_two_blocks_in_strips(tmp_path, monkeypatch, pivots, share):
    monkeypatch.setattr(op07, "STRIP", 9)
    monkeypatch.setattr(op07, "DENSE", share)  # all, some or no pairs in full at once
    monkeypatch.setattr(op07, "SEEN_ROWS", 25)
    monkeypatch.setattr(op07, "SEEN_CELLS", 5)
    rng = np.random.default_rng(8)
    vectors = np.concatenate([rng.normal(size=(40, 6)), 1 + rng.normal(scale=0.1, size=(60, 6))])[rng.permutation(100)]
    space = (op07.units(vectors[:pivots]), op07.fixed(6))
    cell, copies = op07.nearest(vectors, space[0]), rng.integers(1, 4, 100)
    blocks = []
    for number, rows in enumerate((np.arange(55), np.arange(55, 100))):
        rows = rows[np.argsort(cell[rows], kind="stable")] if number else rows  # in whatever order
        columns = {"kind": np.zeros(len(rows), np.int64), "cell": cell[rows].astype(np.int32), "node": rows, "copies": copies[rows]}
        columns |= {"size": np.full(len(rows), 6, np.int32), "raw": op07.binary(vectors[rows])}
        pq.write_table(pa.table(columns), tmp_path / f"{number}.parquet")
        blocks += op07.sides_of([f"file:{tmp_path}/{number}.parquet"], lambda size: space)
    units = op07.units(vectors)
    linked = units @ units.T >= 0.98
    np.fill_diagonal(linked, False)
    got, tied = np.zeros(100, np.int64), []
    for a, b in ((blocks[0], blocks[0]), (blocks[1], blocks[1]), (blocks[0], blocks[1])):
        for node, other, links in zip(*(c.to_pylist() for c in op07.links_between(a, b, space[0], 0.98).columns)):
            got[node] += links
            tied.append((node, other))
    assert got.tolist() == (linked @ copies).tolist() and got.max() > 20
    whole, found = op07.forest(*np.nonzero(linked), 100), op07.forest(*np.array(tied).T, 100)
    assert whole.tolist() == found.tolist()


def test_an_id_with_two_vectors_is_no_link_of_itself(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.01], 0), (2, [1.0, 0.02], 0), (2, [1.0, 0.02], 0)]
    got = sorted(tuple(r) for r in range_join(frame_of(spark, rows)).collect())
    # Two links of each vector of 1; the copies of 2 are one node of two rows.
    assert got == [(1, 4, 1, True), (1, 4, 1, True), (2, 3, 1, False), (2, 3, 1, False)]


def test_equal_points_are_in_one_cell_whatever_they_come_with():
    rng = np.random.default_rng(7)
    pivots = op07.units(rng.normal(size=(50, 33)))
    pivots[20] = pivots[3]
    points = op07.units(np.repeat(pivots[:10] + pivots[10:20], 30, axis=0))  # as near to one as to another
    whole = op07.nearest(points, pivots)
    assert (whole.reshape(10, 30) == whole[::30, None]).all()
    assert all(op07.nearest(points[i : i + 1], pivots)[0] == whole[i] for i in range(0, 300, 7))


def test_what_single_precision_cannot_tell_is_decided_in_double():
    angles = np.arccos(0.98) + np.array([-1e-9, 1e-9, -1e-6, 1e-6, -0.1, 0.1])
    raw = np.stack([np.cos([0, *angles]), np.sin([0, *angles])], axis=1)
    points = op07.units(raw)
    first = op07.turned(points)
    left, right = op07.factors(first)
    single = points.astype(np.float32)
    i, j, _ = op07.close_pairs(
        single, left, 0.98, np.arange(1), np.arange(1, 7), (single, right), lambda a, b: np.einsum("ij,ij->i", points[a], points[b])
    )
    assert j.tolist() == [0, 2, 4] and i.tolist() == [0, 0, 0]
