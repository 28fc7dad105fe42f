import random

from pyspark.sql import functions as F

from siltwork.operators import cascade
from siltwork.operators.merge import Snapshots

SCHEMA = "id string, ord int, text string, embedding array<double>"


def walk(rows, known=(), k=5, reach=0.6):
    """One item after the other against all leaders so far."""
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    led = {r[0]: (unit(r[3]), r[2]) for r in known if any(r[3])}
    out = {}
    for i, _, text, v in sorted(rows, key=lambda r: r[1]):
        if not any(v):
            out[i] = i
            continue
        u = unit(v)
        near = sorted((d, j) for j, (w, _) in led.items() if (d := round(sum((a - b) ** 2 for a, b in zip(u, w, strict=True)) ** 0.5, 6)) <= reach)[:k]
        out[i] = next((j for _, j in near if led[j][1] == text), i)
        if out[i] == i:
            led[i] = u, text
    return out


def test_resolution_against_one_pass(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"c{n:03}", n, rng.choice("abc"), [round(rng.gauss(0, 1), 2) for _ in range(3)]) for n in range(120)] + [("zero", 500, "a", [0.0, 0.0, 0.0])]
    same = lambda a, b: a["text"] == b["text"]
    got = {r.id: r.resolved for r in cascade.resolve(spark.createDataFrame(rows, SCHEMA), same, dimensions=3).collect()}
    assert got == walk(rows)
    index = Snapshots(spark, str(tmp_path / "index"), SCHEMA)
    first, then = rows[:60], rows[60:]
    one = {r.id: (r.resolved, r.is_new) for r in cascade.take_batch(index, spark.createDataFrame(first, SCHEMA), same, dimensions=3).collect()}
    kept = [r for r in first if one[r[0]][1]]
    two = {r.id: r.resolved for r in cascade.take_batch(index, spark.createDataFrame(then, SCHEMA), same, dimensions=3).collect()}
    assert two == walk(then, kept) and index.read().count() == len(kept) + sum(i == j for i, j in two.items())


def test_near_match_confirmed_or_not(spark):
    rows = [("a", 1, "x", [1.0, 0.0]), ("b", 2, "y", [1.0, 0.1])]
    for verdict, want in ((True, {"a": "a", "b": "a"}), (False, {"a": "a", "b": "b"}), (None, {"a": "a", "b": "b"})):
        got = cascade.resolve(spark.createDataFrame(rows, SCHEMA), lambda a, b, v=verdict: F.lit(v).cast("boolean"), dimensions=2)
        assert {r.id: r.resolved for r in got.collect()} == want


def test_exact_mentions_come_first(spark, rows):
    got = cascade.exact_first(spark.createDataFrame([("OpenAI", "company", 1), ("OpenAI", "company", 2), ("OpenAI", "tool", 3)], "name string, type string, ord int"))
    assert rows(got.select("ord", "first", "is_first")) == [(1, 1, True), (2, 1, False), (3, 3, True)]
    assert cascade.resolve(spark.createDataFrame([], SCHEMA), lambda a, b: F.lit(True), dimensions=2).collect() == []
