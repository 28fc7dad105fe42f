import numpy as np

from siltwork.llm import nearest as V

SCHEMA = "item_id string, embedding array<float>, key string, cell int"


def brute(data, k=5):
    ok = {}
    for i, v in data:
        if i is not None and v is not None and len(v) == 64 and all(x is not None for x in v) and np.isfinite(v).all() and np.any(np.array(v)):
            ok[i] = np.array(v, float) / np.linalg.norm(v)
    ids = sorted(ok)
    x = np.array([ok[i] for i in ids])
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    out = set()
    for n, i in enumerate(ids):
        for j in np.argsort(-s[n], kind="stable")[: min(k, len(ids) - 1)]:
            out.add(tuple(sorted((i, ids[j]))))
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in data], SCHEMA)


def made(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 12), 64))
    x = centres[rng.integers(len(centres), size=n)] + 0.35 * rng.normal(size=(n, 64))
    return [(f"i{k:05}", v.astype(np.float32).tolist()) for k, v in enumerate(x)]


def test_ties_copies_and_unusable(spark, rows):
    data = made(300, 1)
    data += [(f"copy{n}", data[7][1]) for n in range(9)] + [(f"scaled{n}", [2.0 * x for x in data[8][1]]) for n in range(3)]
    data += [("null", None), ("empty", []), ("short", [1.0] * 63), ("zero", [0.0] * 64), ("nan", [float("nan")] + [1.0] * 63), ("hole", [None] + [1.0] * 63), (None, data[0][1])]
    data += [data[3]]
    assert {tuple(r) for r in V.pairs(frame(spark, data)).collect()} == brute(data)


def test_recall_on_many_cells(spark):
    data = made(3000, 2)
    want = brute(data)
    got = {tuple(r) for r in V.pairs(frame(spark, data)).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_few_and_none(spark):
    assert V.pairs(frame(spark, made(1, 3))).collect() == []
    assert V.pairs(frame(spark, made(3, 3)).limit(0)).collect() == []
    assert {tuple(r) for r in V.pairs(frame(spark, made(3, 3))).collect()} == brute(made(3, 3))


def test_codes_approach_the_vectors():
    x = V.unit([v for _, v in made(2000, 4)]).astype(np.float32)
    c = V.fit(x, 8)
    cell, codes, norm = V.encode(x, c)
    coded = c.coarse[cell] + sum(c.books[m][codes[:, m]] for m in range(V.BOOKS))
    assert np.allclose((coded * coded).sum(1), norm, atol=1e-4)
    left = ((x - coded) ** 2).sum(1).mean()
    assert left < 0.5 * ((x - c.coarse[cell]) ** 2).sum(1).mean()
    q = x[:5]
    lut = V.tables(q, c)
    score = (q @ c.coarse[cell].T) + sum(lut[m][:, codes[:, m]] for m in range(V.BOOKS))
    assert np.allclose(score, q @ coded.T, atol=1e-4)
