import hashlib
import json

import pytest
from pyspark.sql import functions as F

from siltwork.functions import answers, keys, notes
from siltwork.functions import text as T
from siltwork.functions import vectors as V


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


LETTER = (
    "View this post on the web at https://x.example/p/1\n\nFirst line.   \n[ https://go.example/redirect/abc ]\n\n\n\nSecond © 2023 All rights\n"
    "Text [https://y.example/?utm_source=a] goes on.\nUNSUBSCRIBE here\nlast\n\n"
)


def test_newsletter(spark):
    assert one(spark, LETTER, T.canonical_url) == "https://x.example/p/1"
    assert one(spark, LETTER, T.without_boilerplate) == "First line.\n\nText goes on.\n\nlast"
    assert one(spark, "no link", T.canonical_url) is None


def test_long_runs_of_blanks_take_no_longer(spark):
    long = "a" + " " * 400_000 + "b\n" + "\t" * 400_000 + "[x]"
    assert one(spark, long, T.without_boilerplate).startswith("a ")


@pytest.mark.parametrize("text, n", [("a b\tc\n d", 4), ("", 0), (None, 0), ("  ", 0)])
def test_word_count(spark, text, n):
    assert one(spark, text, T.word_count) == n


def test_title(spark):
    df = spark.createDataFrame([("\n  \n Hello \nx", "u"), (" \n", "u"), (None, None), ("y" * 200, None)], "t string, u string")
    assert [r.y for r in df.select(T.title(F.col("t"), F.col("u")).alias("y")).collect()] == ["Hello", "u", None, "y" * 120]


def test_plain_before_html_and_headers(spark):
    df = spark.createDataFrame([(" plain ", "<p>h</p>", {"Message-ID": ["<1>", "<2>"]}), ("  ", "<p>a &amp; b</p><br><b>c</b><script>x</script>", {}), (None, None, None)], "t string, h string, m map<string,array<string>>")
    got = df.select(T.body(F.col("t"), F.col("h")).alias("b"), T.header(F.col("m"), "message-id").alias("i")).collect()
    assert [r.b for r in got] == ["plain", "a & b\nc", ""] and [r.i for r in got] == ["<1>", None, None]


@pytest.mark.parametrize("name, slug", [("OpenAI, Inc.", "openai-inc"), ("--", "entity"), ("É", "entity"), ("a  b", "a-b")])
def test_slug(spark, name, slug):
    assert one(spark, name, T.slug) == slug


def test_keys(spark):
    h = hashlib.sha256(b"x").hexdigest()
    assert one(spark, h, lambda c: T.raw_key(c, "a.md")) == f"sha256/{h[:2]}/{h[2:4]}/{h}/a.md"
    assert one(spark, h, lambda c: keys.claim_id(c, F.lit(7))) == f"claim-{h[:8]}-07"
    assert one(spark, h, lambda c: keys.claim_id(c, F.lit(123))) == f"claim-{h[:8]}-123"
    key = {"provider": "p", "model": 'm"q\\', "params": {"b": "2", "a": "1"}, "prompt_version": "v1", "input_hash": h}
    again = dict(reversed(key.items())) | {"params": {"a": "1", "b": "2"}}
    assert keys.key_digest(key) == keys.key_digest(again)
    params = F.create_map(*(F.lit(x) for x in ("b", "2", "a", "1")))
    assert one(spark, h, lambda c: keys.key_digest_column(F.lit("p"), F.lit('m"q\\'), params, F.lit("v1"), c)) == keys.key_digest(key)
    assert keys.key_digest(key | {"params": {"t": 0}}) != keys.key_digest(key | {"params": {"t": 0.0}})


CLAIM = {"claim": "A", "quote": "q"}


@pytest.mark.parametrize(
    "text, want",
    [
        (json.dumps([CLAIM]), [("A", "q")]), ("Sure!\n```json\n" + json.dumps([CLAIM]) + "\n```", [("A", "q")]), (json.dumps({"claims": [CLAIM, " B "]}), [("A", "q"), ("B", "")]),
        (json.dumps({"items": [{"text": "C"}, {"claim": " "}, 5, None]}), [("C", "")]), ("[]", []), ("garbage", []), (None, []), ('{"claims": 3}', []), ("```JSON\n[\"x\"]```", [("x", "")]),
    ],
)
def test_claims_of_answers(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(answers.claims_of("t").alias("c")).first()["c"]
    assert [(c["text"], c["quote"]) for c in got] == want


def test_entities_and_verdicts(spark):
    given = '{"entities": [{"name": " Ann ", "type": "Person"}, {"name": "x", "entity_type": "planet"}, "Tool", {"name": ""}]}'
    got = spark.createDataFrame([(given,)], "t string").select(answers.entities_of("t").alias("e")).first()["e"]
    assert [(e["name"], e["type"]) for e in got] == [("Ann", "person"), ("x", "other"), ("Tool", "other")]
    said = ['{"same": true}', 'so {"same": 1} then', '{"same": false}', "yes", "[1]", None]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, t string").select("i", answers.same_of("t").alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == [True, True, False, False, False, False]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r.n for r in df.select(V.normalised(F.col("v")).alias("n")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert one(spark, [3.0, 4.0], lambda v: V.distance(v, F.array(F.lit(0.0), F.lit(0.0))), "array<double>") == 5.0
    assert one(spark, "abc", V.hash_embedding) == [b / 255 for b in hashlib.sha256(b"abc").digest()[:8]]
    with pytest.raises(Exception, match="dimensions"):
        one(spark, [1.0], lambda v: V.checked(v, 2), "array<float>")


def test_notes(spark):
    with pytest.raises(ValueError):
        notes.frontmatter("poem", "derived", F.lit("h"), F.lit("2024-01-01"), "1")
    with pytest.raises(ValueError):
        notes.frontmatter("claim", "mine", F.lit("h"), F.lit("2024-01-01"), "1")
    m = spark.range(1).select(notes.frontmatter("source", "derived", F.lit("h"), F.lit("2024-01-01"), "1", claims_added=F.lit(0)).alias("m")).first().m
    assert m.type == "source" and m.claims_added == 0 and not m.locked and str(m.derived_at) == "2024-01-01"
    assert one(spark, "t", lambda c: notes.commentary_body(F.lit("n"), F.lit("a" * 20), c)) == "# Commentary n\n\n\nAnnotates: `aaaaaaaaaaaa`\n\n---\n\nt\n"
    assert one(spark, "t", lambda c: notes.commentary_body(F.lit("n"), F.lit(None).cast("string"), c)) == "# Commentary n\n\n\n---\n\nt\n"
