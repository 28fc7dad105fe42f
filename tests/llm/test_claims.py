import random

from siltwork.llm import assertions as A
from siltwork.llm import claimindex as C

SCHEMA = "claim_id string, batch_no int, text string, quote string, created_at timestamp, record string"


def claims(spark, data):
    return spark.createDataFrame([(i, b, t, q, None, "x") for i, b, t, q in data], SCHEMA)


def same(a, b):
    return A.repeats(A.record(a, None), A.record(b, None))


BASE = "In 2019, Ostiic Management found that plain-language contracts cut rework by 73.2 percent."


def test_same_assertion():
    for other in (
        "During 2019, Ostiic  Management noticed that plain-language contracts lowered rework by 73.2 per cent.",
        "At Ostiic Management, plain-language contracts cut rework by 73.2% in 2019 – as discussed.",
        "Claim - in 2019, Ostiic Management found that plaiin-language contrcts reduced rework by ７３.２ percent [quoted].",
    ):
        assert same(BASE, other), other


def test_different_assertion():
    for old, new in (("2019", "2021"), ("73.2", "72.3"), ("Ostiic", "Ostic"), (" cut ", " did not cut "), ("rework", "refunds"), ("plain-language contracts", "silent meetings"), ("cut", "raised")):
        assert not same(BASE, BASE.replace(old, new)), new


def test_canonical_form_round_trip():
    for text in (BASE, "", "!!", "No numbers here at all.", "ALL CAPS TEXT 5", "1,234.50 and 7"):
        a = A.read(text)
        assert A.parse(a.canonical()) == a


def test_capitals_take_names_from_the_quote():
    a = A.record("KALDIDKIN LOGISTICS REDUCED HIRING TIME BY 40.0% IN 2015.", "So for Kaldidkin Logistics, 2015: hiring time went down 40.0 percent.")
    assert A.repeats(a, A.record("Kaldidkin Logistics cut hiring time by 40.0 percent in 2015.", None))


def model(data):
    """The batches one after the other, each claim against every accepted one."""
    first = {}
    for i, b, t, q in sorted(data, key=lambda r: (r[1] or 0)):
        first.setdefault(i, (b or 0, A.record(t, q)))
    accepted, pairs = [], set()
    for batch in sorted({b for b, _ in first.values()}):
        new = []
        for i in sorted(first):
            b, r = first[i]
            if b != batch or A.parse(r.partition("\t")[0]).empty():
                continue
            hits = [j for j, other in accepted if A.repeats(r, other)]
            if hits:
                pairs.add(tuple(sorted((i, hits[0]))))
            else:
                new.append((i, r))
        accepted += new
    return sorted(pairs)


def test_against_sequential_model(spark, rows):
    rng = random.Random(1)
    firms, things = ["Acme Mills", "Borland Capital", "Corvin Systems"], ["rework", "stale tickets", "refunds abroad"]
    data = []
    for n in range(160):
        firm, thing, year, figure = rng.choice(firms), rng.choice(things), rng.choice((2019, 2021)), rng.choice((7.2, 12.4))
        shape = rng.choice(("In {y} {t} fell by {f}% at {c}.", "{c} cut {t} by {f} percent in {y}.", "{c} did not cut {t} by {f} percent in {y}.", "Note: {c} reduced {t} by {f} per cent in {y}"))
        data.append((f"c{n:03}", rng.randrange(5), shape.format(y=year, t=thing, f=figure, c=firm), None))
    data += [("n1", 3, None, None), ("n2", 4, "", ""), ("n3", 4, None, "Acme Mills cut rework by 7.2 percent in 2019."), ("c000", 4, data[0][2], None), ("long", 4, "word " * 30_000, None), ("n4", None, "Zeta Labs cut costs by 5 percent in 2001.", None), ("n5", 4, "Zeta Labs cut costs by 5 percent in 2001!", None)]
    got = rows(C.repeats(claims(spark, data)))
    assert got == model(data) and ("n4", "n5") in got and len(got) > 60


def test_common_substrings_are_narrowed_without_loss(spark, rows, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=12)) for _ in range(100)]
    data = [(f"a{n:03}", 0, f"Acme Mills cut {w} by 5 percent in 2020.", None) for n, w in enumerate(words)]
    data += [(f"b{n:03}", 1, t.replace("cut", "reduced"), None) for n, (_, _, t, _) in enumerate(data)]
    monkeypatch.setattr(C, "COMMON", 4)
    assert rows(C.repeats(claims(spark, data))) == [(f"a{n:03}", f"b{n:03}") for n in range(100)]


def test_empty_and_single_batch(spark, rows):
    assert rows(C.repeats(claims(spark, [("a", 0, BASE, None), ("b", 0, BASE, None)]))) == []
    assert rows(C.repeats(claims(spark, [("a", 0, BASE, None)]).limit(0))) == []


def records(spark, texts, prefix="c"):
    return spark.createDataFrame([(A.record(t, None), f"{prefix}{n:05}") for n, t in enumerate(texts)], "record string, claim_id string")


def test_an_index_is_opened_again_and_stays_few_segments(spark, rows, tmp_path):
    for n in range(6):
        index = C.ClaimIndex.open(spark, str(tmp_path / "index"))
        assert sum(s.claims for s in index.segments) == n
        index.add(records(spark, [f"Acme Mills cut item {n} by {n}.5 percent in 2020."], f"b{n}-"), 1)
    index = C.ClaimIndex.open(spark, str(tmp_path / "index"))
    assert len(index.segments) <= 3
    got = C.take(index, records(spark, ["Acme Mills reduced item 3 by 3.5 percent in 2020.", "Acme Mills reduced item 9 by 3.5 percent in 2020."]))
    assert [(r.new, r.claim_id) for r in got.collect()] == [("c00000", "b3-00000")]


def test_a_search_reads_a_part_of_the_index_only(spark, tmp_path):
    rng = random.Random(3)
    name = lambda: "".join(rng.choices("bcdfglmnprst", k=6)).title()
    known = [f"{name()} Mills cut rework by {rng.randrange(1, 999) / 10} percent in 20{rng.randrange(10, 25)}." for _ in range(600)]
    index = C.ClaimIndex.open(spark, str(tmp_path / "index"), shard=100)
    index.add(records(spark, known), len(known))
    got = index.search(records(spark, [known[7].replace("cut", "reduced"), known[300].replace("rework", "rewrok")], "n")).collect()
    assert sorted((r.new, r.claim_id) for r in got) == [("n00000", "c00007"), ("n00001", "c00300")]
    read, there = index.reads[-1]
    assert read <= 4 and there >= 20


def test_a_hot_shard_is_split_and_searched_whole(spark, rows, tmp_path):
    index = C.ClaimIndex.open(spark, str(tmp_path / "index"), shard=50)
    words = [f"{a}{b}nik{c}ert" for a in "bdfgk" for b in "aeiou" for c in "lmrs"]
    known = [f"Acme Mills likes {w} of all things." for w in words]
    index.add(records(spark, known), len(known))
    assert index._split(index.segments[0].path).where("parts > 1").count() > 0
    got = index.search(records(spark, [t.replace("likes", "likes,") for t in known], "n")).collect()
    assert len(got) == len(known)


def test_short_anchors_lose_nothing(spark, rows):
    rng = random.Random(11)
    subjects = ["acorns", "autumn letters", "garden queues", "ferry tickets", "harbour notes", "morning trains"]
    verbs = ["vanished overnight", "ignored readers", "arrived late", "doubled prices", "closed shops"]

    def spoilt(text):
        words = text.split(" ")
        at = max(range(len(words)), key=lambda k: len(words[k]))
        k = rng.randrange(2, len(words[at]) - 2)
        words[at] = words[at][:k] + rng.choice("klmxy") + words[at][k + 1 :]
        return " ".join(words)

    data = [("p0", 0, "5 percent of acorns vanished overnight.", None), ("p1", 1, "5 percent of akorns vanished overnight.", None), ("q0", 0, "Readers ignored autumn letters.", None), ("q1", 1, "Readers ignored outumn letters.", None)]
    for n in range(150):
        text = rng.choice(("", "", "3 percent of ", "In 2019 ")) + f"{rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(('', 'quietly', 'again'))}".strip() + "."
        data.append((f"r{n:03}", rng.randrange(3), text if rng.random() < 0.6 else spoilt(text), None))
    want, got = model(data), rows(C.repeats(claims(spark, data)))
    assert ("p0", "p1") in got and ("q0", "q1") in got
    # Spelling is not transitive, so that a claim may repeat several: it must come out, with one that it repeats.
    batch, text = {i: b for i, b, _, _ in data}, {i: t for i, _, t, _ in data}
    later = lambda pairs: {max(p, key=lambda i: batch[i]) for p in pairs}
    assert len(want) > 30 and later(got) == later(want) and all(same(text[a], text[b]) or same(text[b], text[a]) for a, b in got)


def test_texts_in_one_case_take_no_names_from_nowhere(spark, rows):
    data = [
        ("a0", 0, "At Rosternath Distribution, annotated transcripts cut missed deadlines by 8.0 percent in 2015.", None),
        ("a1", 1, "at rosternath distribution, annotated transcripts cut missed deadlines by 8.0 percent in 2015.", None),
        ("b0", 0, "by the end of 2017, headcount rose by 16.4% for galasrode logistics.", None),
        ("b1", 2, "By the end of 2017, headcount rose by 16.4% for Galasrode Logistics.", None),
        ("b2", 2, "By the end of 2017, headcount rose by 16.4% for Galasrade Logistics.", None),
        ("b3", 3, "BY THE END OF 2017, HEADCOUNT ROSE BY 16.4% FOR GALASRODE LOGISTICS.", None),
    ]
    got = rows(C.repeats(claims(spark, data)))
    assert got == model(data) and {("a0", "a1"), ("b0", "b1"), ("b0", "b3")} <= set(got) and not any("b2" in p for p in got)


def test_short_anchors_do_not_run_into_the_words(spark, rows):
    data = [
        ("a0", 0, "In 2019 annotated transcripts lowered errors by 5 percent", None), ("a1", 1, "In 2019 anotated transcripts lowered errors by 5 percent", None),
        ("b0", 0, "Silent meetings annoyed reviewers", None), ("b1", 1, "silent meetings anoyed reviewers", None),
        ("c0", 0, "At 7 percent bonuses reduced absences", None), ("c1", 1, "At 7 percent bonuses changed absences " + "through all of the year, as the letter said", None),
        ("d0", 0, "Acme Mills in 3 letters", None), ("d1", 1, "AcmeMills in 3 letters", None),
    ]
    want = model(data)
    assert ("a0", "a1") in want and rows(C.repeats(claims(spark, data))) == want


def test_every_word_of_a_quote_is_indexed(spark, rows):
    data = [
        # The quotes alone show it, and they share no word at their beginning.
        ("a0", 0, "Subtitles helped checkers.", "silent meetings annoyed everyone around"), ("a1", 1, "Transcripts assisted reviewers.", "sillent meetings annoyed everyone around"),
        # The name stands in the middle of a quote in one case; the texts share neither name nor word.
        ("b0", 0, "in 2019 ledgers vanished", "in 2019 quiet paperwork left rosternath cellars"), ("b1", 2, "In 2019 archives disappeared.", "In 2019 quiet paperwork left Rosternath cellars"),
        ("c0", 0, "Postcards pleased aunts.", "Marble counters gathered yesterday"), ("c1", 3, "Telegrams delighted uncles.", "marrble counters gathhered yesterday"),
    ]
    want = [("a0", "a1"), ("b0", "b1"), ("c0", "c1")]
    assert model(data) == want and rows(C.repeats(claims(spark, data))) == want


def test_without_figure_and_name_no_word_need_be_shared_as_written(spark, rows):
    data = [("a0", 0, "Silent meetings annoyed reviewers", None), ("a1", 1, "Sillent meetngs anoyed revviewers", None), ("a2", 1, "sillent meetngs anoyed revviewers", None), ("b1", 1, "Silent orchards pleased gardeners", None)]
    want = [("a0", "a1"), ("a0", "a2")]
    assert model(data) == want and rows(C.repeats(claims(spark, data))) == want


def test_jobs_of_a_search_do_not_grow_with_the_segments(spark, tmp_path):
    index = C.ClaimIndex(spark, str(tmp_path / "index"), shard=8)
    for n in (40, 18, 8, 3, 1):
        index.add(records(spark, [f"Acme{'x' * k} Mills cut item {k} by {n}.5 percent in 2020." for k in range(n)], f"b{n}-"), n)
    assert len(index.segments) == 5 and sum(s.folders > 1 for s in index.segments) >= 2
    status, jobs = spark.sparkContext.statusTracker(), []
    for segments in (index.segments[:1], index.segments):
        index.segments = segments
        group = f"search-{len(segments)}"
        spark.sparkContext.setJobGroup(group, "")
        got = index.search(records(spark, ["Acmex Mills reduced item 1 by 40.5 percent in 2020."])).collect()
        spark.sparkContext._jsc.clearJobGroup()
        assert [r.claim_id for r in got] == ["b40-00001"]
        jobs.append(len(status.getJobIdsForGroup(group)))
    assert jobs[1] < 2 * jobs[0], jobs
