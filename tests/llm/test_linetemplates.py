import random
from collections import defaultdict

import pytest
import regex

from siltwork.llm import linetemplates as L

DOCS = "doc_id bigint, text string, source string, artifact_hash string, key string"
ARTIFACTS = "artifact_hash string, source string, hash string"
MANIFEST = "content_hash string, extra map<string,string>"


def brute(docs, artifacts, manifest, least, share):
    a = {h: s for h, s, _ in artifacts if s is not None}
    m = {h: (e or {}).get("list_id") or (e or {}).get("site") for h, e in manifest}
    src = {d[0]: d[2] or a.get(d[3]) or m.get(d[3]) for d in docs}
    total, seen = defaultdict(int), defaultdict(set)
    lines = []
    for i, text, *_ in docs:
        total[src[i]] += 1
        for n, line in enumerate((text or "").split("\n"), 1):
            key = regex.sub(r"\P{L}", "", line).lower()
            if key and src[i]:
                seen[src[i], key].add(i)
                lines.append((i, n, src[i], key))
    bad = {k for k, v in seen.items() if len(v) >= least and len(v) >= share * total[k[0]]}
    return sorted(((i, n) for i, n, s, k in lines if (s, k) in bad), key=repr)


def test_against_brute_force(spark, rows):
    rng = random.Random(3)
    boiler = ["Share · Save", "Sign  up now!", "SIGN UP NOW", "© 2024 Letter", "123", "", "​Share Save"]
    docs, artifacts, manifest = [], [], []
    for i in range(150):
        body = [rng.choice(boiler) if rng.random() < 0.5 else f"line {chr(97 + rng.randrange(26)) * 3} {rng.random()}" for _ in range(rng.randrange(6))]
        text = rng.choice(["\n".join(body)] * 8 + [None, ""])
        source = rng.choice(["s1", "s1", "s2", None, None])
        docs.append((i, text, source, f"h{i}", "x"))
        artifacts += [(f"h{i}", rng.choice(["s1", None]), "y")] * 2
        manifest.append((f"h{i}", rng.choice([None, {"site": "s3"}, {"list_id": "s2", "site": "s3"}])))
    a = {}
    artifacts = [(h, a.setdefault(h, s), k) for h, s, k in artifacts]
    got = L.repeated_lines(spark.createDataFrame(docs, DOCS), spark.createDataFrame(artifacts, ARTIFACTS), spark.createDataFrame(manifest, MANIFEST), 5, 0.1)
    assert rows(got) == brute(docs, artifacts, manifest, 5, 0.1) != []


def test_hot_source_and_long_lines(spark, rows):
    long = "word " * 50_000
    docs = [(i, f"{long}\nsame line\nown {i * 'x'}", "hot", None, "") for i in range(12)] + [(99, "same line", None, None, "")]
    got = L.repeated_lines(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ARTIFACTS), spark.createDataFrame([], MANIFEST))
    assert rows(got) == sorted([(i, n) for i in range(12) for n in (1, 2)], key=repr)
    clean = L.without_lines(spark.createDataFrame(docs, DOCS).select("doc_id", "text"), got)
    assert {r.doc_id: r.text for r in clean.collect()}[3] == "own xxx"
    assert {r.doc_id: r.text for r in clean.collect()}[99] == "same line"


def test_tree_flushes_without_loss(monkeypatch):
    tree = L.TemplateTree()
    for _ in range(3):
        tree.add("s", {"abc": 1, "abd": 2})
        tree.add(None, {"abc": 1})
    assert sorted(tree.drain(), key=repr) == sorted([("s", 1, 3), ("s", 2, 3), (None, 1, 3)], key=repr)
    assert list(tree.drain()) == []


def parse(*documents):
    """The tree of documents given as lists of letters, each line's key its hash."""
    tree = L.TemplateTree()
    for lines in documents:
        tree.add("s", {x: L.line_key(x) for x in lines})
    return tree


def test_differing_positions_become_wildcards():
    a, b, other = "dearfriendannathanksforreading", "dearfrientannathanksforreading", "dea" + "kka" * 5 + "ading"
    ((_, _, template),) = parse([a], [a, b], [b]).templates()
    own = [set(x) for x in zip(memoryview(L.positions(L._tokens(a))).cast("I"), memoryview(L.positions(L._tokens(b))).cast("I"), strict=True)]
    assert [x if x else None for x in memoryview(template.tokens).cast("I")] == [min(x) if len(x) == 1 else None for x in own]
    assert sum(len(x) == 2 for x in own) == 1
    assert (template.docs, template.lines) == (3, {L.line_key(a): 2, L.line_key(b): 2})
    assert len(list(parse([a], [b], [other]).templates())) == 2


@pytest.mark.parametrize("full", [1, 2, 32])
def test_merged_trees_cover_every_line(monkeypatch, full):
    monkeypatch.setattr(L, "LEAF", full)
    rng = random.Random(full)
    lines = ["so" + "".join(rng.choice(["ka", "te", "noma", "le"]) for _ in range(rng.choice([3, 6, 25]))) + "re" for _ in range(300)]
    trees, docs = [], defaultdict(int)
    for _ in range(6):
        documents = [set(rng.sample(lines, 4)) for _ in range(60)]
        for x in [x for d in documents for x in d]:
            docs[L.line_key(x)] += 1
        trees.append(list(parse(*documents).templates()))
    leaves = defaultdict(list)
    for _, path, template in [t for tree in trees for t in tree]:
        leaves[path].append(template)
    under = {}
    for path, parts in leaves.items():
        wholes = L.merged(p.tokens for p in parts)
        covered = defaultdict(int)
        for p, w in zip(parts, wholes, strict=True):
            covered[w] += p.docs
            for key in p.lines:
                assert under.setdefault(key, (path, w)) == (path, w)
        for p, w in zip(parts, wholes, strict=True):
            assert all(covered[w] >= docs[key] for key in p.lines)
        assert not any(a is not b and a.meets(b) for a in map(L.Template, covered) for b in map(L.Template, covered) if a.tokens != b.tokens)
    assert set(under) == set(docs)
    assert len(set(under.values())) < len(docs)


def test_lines_come_through_merged_templates(spark, rows):
    # Six documents in as many partitions: no tree of one holds more than a document of the line, or of the template.
    texts = [f"Thank A{c}na for reading this letter\nSame line for all of them" for c in "bcdfgh"]
    docs = spark.createDataFrame([(i, t, "s", None, "") for i, t in enumerate(texts)], DOCS).repartition(6, "doc_id")
    empty = spark.createDataFrame([], ARTIFACTS), spark.createDataFrame([], MANIFEST)
    parts = L.scan(docs).where("path is not null").select("source", "path", "template", "docs")
    whole = L.merge_leaves(parts).groupBy("path", "whole").agg({"docs": "sum"}).collect()
    assert sorted(r[2] for r in whole) == [6, 6]
    # One template covers all the thanks, but no line of it is in five documents.
    assert rows(L.repeated_lines(docs, *empty)) == [(i, 2) for i in range(6)]


@pytest.mark.parametrize("text, want", [("A-1 b\n2", ["ab", ""]), ("Ⅷ½x", ["x"]), ("é​É", ["éé"])])
def test_letters(text, want):
    assert L.letters(text) == want


def test_empty_tables(spark, rows):
    empty = spark.createDataFrame([], DOCS), spark.createDataFrame([], ARTIFACTS), spark.createDataFrame([], MANIFEST)
    assert rows(L.repeated_lines(*empty)) == []
