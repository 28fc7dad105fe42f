import random

import pytest

from siltwork.llm import mixing as M

DOCS, PLAN = "doc_id bigint, source string, text string, tokens int, copies int", "mix_id int, source string, target_share double, max_repeats int, budget_ratio double"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    data = []
    for i in range(600):
        source = rng.choice(["big"] * 6 + ["mid"] * 3 + ["tiny"])
        data.append((i, source, rng.choice(["word " * rng.randrange(1, 60), "the very same text of all"]), 7, 7))
    data += [(1000, "big", None, None, None), (1001, "mid", "", None, None), (1002, None, "no source", None, None), (1003, "other", "not listed", None, None), (None, "tiny", "no id", None, None)]
    return spark.createDataFrame(data, DOCS).cache()


def test_shares(spark, docs):
    plan = spark.createDataFrame([(1, "big", 0.5, 2, 0.4), (1, "mid", 0.4, 2, 0.4), (1, "tiny", 0.1, 2, 0.4), (2, "tiny", 0.9, 3, 1.0), (2, "big", 0.1, 1, 1.0), (3, "none", 1.0, 2, 1.0)], PLAN)
    drawn, shares = M.mix(docs, plan)
    s = {(r.mix_id, r.source): r for r in shares.collect()}
    assert all(abs(s[1, x].actual_share - t) < 0.02 for x, t in (("big", 0.5), ("mid", 0.4), ("tiny", 0.1)))
    total = sum(r.source_tokens for k, r in s.items() if k[0] == 1)
    assert abs(sum(r.mix_tokens for k, r in s.items() if k[0] == 1) - 0.4 * total) < 0.01 * total
    # A target that can't be met is filled up, what it lacks goes to the others as far as they have room.
    assert s[2, "tiny"].mix_tokens == 3 * s[2, "tiny"].source_tokens
    assert s[2, "big"].mix_tokens <= s[2, "big"].source_tokens and s[3, "none"].mix_tokens == 0
    rows = drawn.collect()
    caps = {(1, x): 2 for x in ("big", "mid", "tiny")} | {(2, "tiny"): 3, (2, "big"): 1}
    assert all(1 <= r.copies <= caps[r.mix_id, r.source] and r.tokens > 0 for r in rows)
    assert len({(r.mix_id, r.doc_id) for r in rows}) == len(rows)


def test_again_the_same_and_seeded(spark, docs):
    plan = spark.createDataFrame([(1, "big", 1.0, 1, 0.3)], PLAN)
    a, b, c = ({r.doc_id for r in M.mix(docs, plan, seed)[0].collect()} for seed in (1, 1, 2))
    assert a == b != c


def test_same_text_shares_the_chances_of_one(spark, docs):
    plan = spark.createDataFrame([(m, "big", 1.0, 1, 0.2) for m in range(12)], PLAN)
    rows = M.mix(docs, plan)[0].join(docs.select("doc_id", "text"), "doc_id").collect()
    same = sum(r.text.startswith("the very") for r in rows) / len(rows)
    assert same < 0.1


def test_empty_and_odd_plans(spark, docs):
    odd = spark.createDataFrame([(1, "big", None, 2, 0.5), (1, "mid", -1.0, 2, 0.5), (2, "big", 1.0, None, 0.5), (None, "big", 1.0, 1, 1.0), (3, None, 1.0, 1, 1.0), (4, "big", 0.0, 1, 0.5)], PLAN)
    drawn, shares = M.mix(docs, odd)
    assert drawn.count() == 0 and shares.count() == 4
    drawn, shares = M.mix(docs.limit(0), odd)
    assert drawn.count() == 0
    drawn, shares = M.mix(docs, odd.limit(0))
    assert drawn.count() == 0 and shares.count() == 0


def test_up_to_reaches_the_goal_over_bins(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "1 as g", "10 as size", "(id * 7919 % 5000) / 5000.0 as rank", "12345 as goal")
    for bins in (1, 16, 4096):
        got = M.up_to(rows, ["g"], "size", "goal", bins)
        assert abs(got.agg({"size": "sum"}).first()[0] - 12345) <= 5
        assert got.agg({"rank": "max"}).first()[0] < 0.26
