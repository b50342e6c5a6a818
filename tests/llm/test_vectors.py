import numpy as np
import pytest

from quarry.llm import vectors


def _data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 64))
    for n in range(0, 200, 2):  # near copies: their cosine is far above the threshold
        x[n + 1] = x[n] + 0.05 * rng.normal(size=64)
    x[300:330] = x[300]  # exact copies
    x[400:404] = 2.5 * x[401]  # the same direction at another length
    return x.astype("f4")


def _frame(table, x):
    rows = [(n, v.tolist()) for n, v in enumerate(x)]
    rows += [(5, x[5].tolist()), (1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64), (1003, [1.0] * 48), (1004, [float("inf")] + [1.0] * 63), (None, x[0].tolist())]
    return table(rows, "chunk_id long, embedding array<float>")


def _cosines(x):
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    return u @ u.T


def test_pairs_are_those_of_brute_force(table):
    x = _data()
    cos = _cosines(x)
    expected = {(a, b) for a, b in zip(*np.nonzero(cos >= 0.9)) if a < b}
    got = vectors.similar_pairs(_frame(table, x), 0.9).collect()
    pairs = [(r.chunk_id_a, r.chunk_id_b) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == expected
    assert all(abs(r.cosine - cos[r.chunk_id_a, r.chunk_id_b]) < 1e-3 for r in got)


def test_neighbours_recall_and_copies(table):
    x = _data()
    cos = _cosines(x)
    np.fill_diagonal(cos, -2)
    got = vectors.similar_chunks(_frame(table, x), 10).collect()
    by = {}
    for r in got:
        by.setdefault(r.chunk_id, []).append((r["rank"], r.neighbour_id, r.cosine))
    assert set(by) == set(range(600))
    good = 0
    for n, found in by.items():
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 11)) and n not in {m for _, m, _ in found}
        good += sum(c >= np.sort(cos[n])[-10] - 1e-3 for _, _, c in found)
    assert good / 6000 >= 0.9
    assert [m for _, m, _ in sorted(by[310])] == [300, 301, 302, 303, 304, 305, 306, 307, 308, 309]


@pytest.mark.parametrize("spread", [1.0, 4.0])
def test_only_visited_cells_are_compared(table, spread):
    # Random directions are the hardest case; the share of entries visited follows the data, the recall stays.
    x = np.random.default_rng(9).normal(size=(6000, 64)).astype("f4")
    x[:, ::8] *= spread
    rows = vectors.collapsed(vectors.keyed(_frame(table, x)))[0]
    index = vectors.fit(rows, 10)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4")
    d1, d2 = index.halves(u[:300])
    radius = index.radius(d1, d2, int(index.share * 6000))
    visited = d1[:, :, None] + d2[:, None, :] <= radius[:, None, None] + vectors.SLACK
    assert (visited * index.sizes).sum((1, 2)).mean() < (0.2 if spread == 4 else 0.7) * 6000
    reach = vectors.REACH * np.sqrt(0.2 / 64)
    both = index.near(d1, index.first, reach)[:, :, None] & index.near(d2, index.second, reach)[:, None, :]
    one = index.near(d1, index.first, reach)[:, :, None] & np.ones_like(both)
    assert (both * index.sizes).sum() < 0.7 * (one * index.sizes).sum()  # the second codebook prunes as well
    cos = _cosines(x)
    np.fill_diagonal(cos, -2)
    tenth = np.sort(cos, axis=1)[:, -10]
    got = vectors.similar_chunks(_frame(table, x), 10).where("chunk_id < 6000").collect()
    assert sum(r.cosine >= tenth[r.chunk_id] - 1e-3 for r in got) >= 0.9 * 60_000


def test_slices_of_copies_lose_no_pair(table, monkeypatch):
    monkeypatch.setattr(vectors, "SLICE_ROWS", 7)
    x = _data()
    expected = {(a, b) for a, b in zip(*np.nonzero(_cosines(x) >= 0.9)) if a < b}
    got = [(r.chunk_id_a, r.chunk_id_b) for r in vectors.similar_pairs(_frame(table, x), 0.9).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    near = vectors.similar_chunks(_frame(table, x), 10).where("chunk_id = 310").orderBy("rank").collect()
    assert [r.neighbour_id for r in near] == list(range(300, 310))


def test_empty_and_single(table):
    none = table([], "chunk_id long, embedding array<float>")
    assert vectors.similar_pairs(none).count() == 0 and vectors.similar_chunks(none).count() == 0
    one = table([(1, [1.0] * 64)], "chunk_id long, embedding array<float>")
    assert vectors.similar_pairs(one).count() == 0 and vectors.similar_chunks(one).count() == 0
    unusable = table([(1, None), (2, [])], "chunk_id long, embedding array<float>")
    assert vectors.similar_pairs(unusable).count() == 0


def test_split_blocks_lose_nothing(table, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 20)
    x = _data()
    expected = {(a, b) for a, b in zip(*np.nonzero(_cosines(x) >= 0.9)) if a < b}
    got = {(r.chunk_id_a, r.chunk_id_b) for r in vectors.similar_pairs(_frame(table, x), 0.9).collect()}
    assert got == expected


def test_a_crowd_hides_no_pair(table):
    # Over 600 different vectors and 1,500 copies of one in a corner, in the blocks beside it pairs of cosine just over the threshold.
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    crowd = centre + 0.9 * rng.normal(size=(1200, 64))
    step = rng.normal(size=(1200, 64))
    step -= (step * crowd).sum(1, keepdims=True) / (crowd * crowd).sum(1, keepdims=True) * crowd
    step *= np.linalg.norm(crowd, axis=1, keepdims=True) / np.linalg.norm(step, axis=1, keepdims=True)
    x = np.concatenate([crowd, 0.91 * crowd + np.sqrt(1 - 0.91**2) * step, np.repeat(centre[None], 1500, 0)]).astype("f4")
    cos = _cosines(x[:2400])
    expected = {(a, b) for a, b in zip(*np.nonzero(cos >= 0.902)) if a < b}
    rows = vectors.collapsed(vectors.keyed(_frame(table, x)))[0]
    assert vectors.fit(rows).sizes.sum() == rows.count() == 2401
    got = {(r.chunk_id_a, r.chunk_id_b) for r in vectors.similar_pairs(_frame(table, x), 0.9).where("chunk_id_b < 2400").collect()}
    assert len(expected) >= 1200 and expected <= got
