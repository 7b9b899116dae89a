from __future__ import annotations

import numpy as np
import pytest

from loomstead.llm import codes, neighbours

SCHEMA = "chunk_pk long, embedding array<float>, embedding_model string, embedding_dimensions int"


def exact(rows, k=5, least=0.85):
    out = set()
    fine = [r for r in rows if r[1] is not None and len(r[1]) == r[3] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    for m in {r[2] for r in fine}:
        own = sorted((r for r in fine if r[2] == m), key=lambda r: r[0])
        ids = [r[0] for r in own]
        x = np.array([r[1] for r in own], np.float32).astype(np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        s = np.round(x @ x.T, 6)
        np.fill_diagonal(s, -2)
        for i, row in enumerate(s):
            for j in np.argsort(-row, kind="stable")[:k]:
                if row[j] >= least:
                    out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def clustered(rng, n, dims, model, start):
    centres = rng.standard_normal((n // 12, dims))
    x = centres[rng.integers(0, len(centres), n)] + 0.22 * rng.standard_normal((n, dims))
    return [(start + i, (v * rng.uniform(0.5, 2)).astype(np.float32).tolist(), model, dims) for i, v in enumerate(x)]


def found(df, **more):
    return {(r.a, r.b) for r in neighbours.similar_pairs(df, **more).collect()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = clustered(rng, 1500, 64, "m", 0) + clustered(rng, 400, 20, "n", 5000)
    copy = out[3][1]
    out += [(9000 + i, copy, "m", 64) for i in range(40)] + [(9100 + i, [2 * x for x in copy], "m", 64) for i in range(3)]
    out += [(9500, None, "m", 64), (9501, [0.0] * 64, "m", 64), (9502, [1.0] * 63, "m", 64), (9503, [float("nan")] * 64, "m", 64), (9504, [None] * 64, "m", 64), (9505, [], "m", 0)]
    return out


def test_recall(spark, rows):
    got, want = found(spark.createDataFrame(rows, SCHEMA)), exact(rows)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_split_cells(spark, rows):
    """Many small cells."""
    got, want = found(spark.createDataFrame(rows, SCHEMA), cell=120, whole=100), exact(rows)
    assert len(got & want) >= 0.9 * len(want)


def test_drawn_index(spark, rows, monkeypatch):
    """Models beyond those that are learned."""
    monkeypatch.setattr(neighbours, "LEARNED", 1)
    got, want = found(spark.createDataFrame(rows, SCHEMA), cell=200, whole=100), exact(rows)
    assert len(got & want) >= 0.9 * len(want)


def test_near_copies_are_coded_again(spark):
    """A third of the rows are so alike that the model's codes don't tell them apart."""
    rng = np.random.default_rng(5)
    rows = clustered(rng, 1200, 32, "m", 0)
    centre = np.array(rows[7][1])
    alike = centre + 1e-4 * np.abs(centre).max() * rng.standard_normal((600, 32))
    far = [(10_000 + i, v.astype(np.float32).tolist(), "m", 32) for i, v in enumerate(alike)]
    got, want = found(spark.createDataFrame(rows + far, SCHEMA), cell=100, whole=50), exact(rows)
    other = {p for p in want if max(p) < 10_000 and 7 not in p}
    assert len(got & other) >= 0.9 * len(other)
    # Each of the alike has five partners; which ones, their short forms can't tell.
    partners: dict[int, int] = {}
    for a, b in got:
        partners[a], partners[b] = partners.get(a, 0) + 1, partners.get(b, 0) + 1
    assert sum(partners.get(i, 0) >= 5 for i, *_ in far) >= 0.95 * len(far)


def test_dense_cell_is_bounded():
    """In a cell of near copies every pair is a candidate; only the best of each row are held."""
    rng = np.random.default_rng(6)
    x = codes.unit_rows(1 + 0.05 * rng.standard_normal((3000, 24)))
    cell = codes.Cell(np.arange(3000), np.zeros(3000, np.uint32), codes.shortened(x))
    a, b, cosine = cell.best(5, 0.85)
    s = np.round(cell.units @ cell.units.T, 6)
    np.fill_diagonal(s, -2)
    assert (np.bincount(a, minlength=3000) == 5).all()
    assert (np.sort(cosine.reshape(3000, 5), axis=1) == np.sort(np.partition(s, -5, axis=1)[:, -5:], axis=1)).all()


def test_copies(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.3]
    rows = [(i, v, "m", 3) for i in range(10, 30)] + [(5, w, "m", 3), (40, [-1.0, 0.0, 0.0], "m", 3)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == exact(rows)


def test_few_and_none(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == set()
    one = spark.createDataFrame([(1, [1.0, 0.0], "m", 2)], SCHEMA)
    assert found(one) == set()
    two = spark.createDataFrame([(1, [1.0, 0.0], None, 2, 0, 0.0), (2, [1.0, 0.1], None, 2, 1, 0.0)], SCHEMA + ", id int, cosine double")
    assert found(two) == {(1, 2)}


def test_codes():
    rng = np.random.default_rng(1)
    x = codes.unit_rows(rng.standard_normal((500, 40)).astype(np.float32))
    rotation = codes.learn_rotation(x)
    bits = rotation.bits(x)
    assert bits.shape == (500, codes.BITS) and (np.abs(bits.mean(0) - 0.5) < 0.01).all()
    short = codes.restored(codes.shortened(x))
    assert (np.einsum("nd,nd->n", short, x) > 0.9999).all()
    index = codes.build_index(x, 500, 100)
    cells = index.cells(x, 1)
    assert cells.shape == (500, codes.TABLES * codes.PROBES) and (cells[:, ::codes.PROBES] != codes._NO_CELL).all()
    assert (index.cells(x[::-1].copy(), 1)[::-1] == cells).all()
    # A range of codes without a sample has a cell too.
    assert (codes.Index(index.rotation, index.trees).cells(-x, 1)[:, 0] != codes._NO_CELL).all()
    a, b = codes.class_keys(x)
    c, d = codes.class_keys(codes.unit_rows((x * 3).astype(np.float32)))
    assert len(set(a.tolist())) == 500 and (a == c).mean() > 0.8 and ((a == c) == (b == d)).all()
