import pytest

from siltwork.llm import residue as R

RESIDUE = [
    "Please enable JavaScript to view this page.",
    "Error 503: service temporarily unavailable\n\nPlease refresh and try again.\nid 52756b0126af",
    "Menu  Search  Letters  Podcasts  Contact Der Dienst ist vorübergehend nicht erreichbar. Bitte versuchen Sie es später erneut. Kennung: 9dfd6c509b0a",
    '{"error": {"code": 400, "message": "quota exceeded", "request": "d9f73ccf5f23"}}',
    "Lorem ipsum amet semper congue nulla vitae tempor felis vitae gravida.",
    "TBD\nYour text goes here.",
    "foo bar baz foo bar",
    "Titre de la section\nVotre texte ici.",
    "By Georgina Darerkberg\nPlaceholder caption",
    "Ann Lee | senior writer\nText goes here",
    "Bob Holm | senior writer\nText goes here",
    "Cy Olsen | Senior Writer\nText goes here".replace("Senior Writer", "senior writer"),
    "<<FIRSTNAME>>, welcome to <<COMPANY>>",
    "Dear :first_name:, welcome",
    "Dear :guest_name:, welcome",
    "Hello , welcome back\nHello {{guest}}, welcome back",
    "Hello %city%, welcome back",
    "Hello , welcome back",
    "Página en mantenimiento. Vuelva más tarde.",
    "The page you requested could not be found because it may have been moved, renamed or deleted, or the address was typed wrong.",
    "Home | Archive | About | Sign in\n404 Not Found",
]
REAL = [
    "The permit was quiet; the shortlist was not.",
    "“Access denied” was the headline the archive team chose for the essay on closed archives.",
    "A gateway timeout (error 504) is not an apology, the night desk told the board.",
    "In the code sample, `${user.name}` and `%ORDER_ID%` are replaced at send time; see the pilot.",
    "404 Not Found\n\nBetween 1998 and 2014 the regional outage held while the archive team audited the founder call.",
    "Prices tell you less than queues. Not advice.",
    "The missing hikers were not found.",
    "Your browser history is a diary.",
    "Our shop has moved to Elm Street.",
    "Ein Fehler kostet uns viel Geld.",
    "Quietly the ferry service was temporarily unavailable during the storm.",
    "Anna Schmidt | gardening notes",
    "Hi {{first_name}}, a quick word before this week's piece on the supply line.",
]
BLANK = [None, "", "  \n\t", "12345 — 678", "---\n***"]
DOCS = "doc_id bigint, text string, source string, artifact_hash string, marks string"


@pytest.fixture(scope="module")
def found(spark):
    slots = ["Dear {{city}}, your note on %guest% was saved.", "Dear #{plan}, your note on [Link] was saved.\nTitle: {{city}}", "Title: %%AUTHOR%%"]
    texts = RESIDUE + slots + REAL + BLANK
    docs = [(i, t, "s" if i % 2 else None, f"h{i}", "") for i, t in enumerate(texts)]
    shared = [(1000 + i, f"Share this letter\n{'Real words of number ' + chr(97 + i) * 4 if i else ''}", "t", None, "") for i in range(6)]
    empty = spark.createDataFrame([], "artifact_hash string, source string"), spark.createDataFrame([], "content_hash string, extra map<string,string>")
    got = [r[0] for r in R.residue(spark.createDataFrame(docs + shared, DOCS), *empty).collect()]
    assert len(got) == len(set(got))
    return {i for i in got if i < 1000}, {i for i in got if i >= 1000}, texts


def test_residue_is_found(found):
    texts = found[2]
    assert [texts[i] for i in range(len(RESIDUE) + 3) if i not in found[0]] == []


def test_real_and_blank_are_not(found):
    texts = found[2]
    assert [texts[i] for i in sorted(found[0]) if i >= len(RESIDUE) + 3] == []


def test_only_repeated_lines_are_left(found):
    assert found[1] == {1000}


def test_very_long_text_and_empty_table(spark):
    for odd in ("x" * 100_000 + "y", "{" * 100_000, "[A" * 50_000, "a1" * 100_000, " " * 200_000 + "word", "%a" * 50_000, "By " + "Aa " * 50_000):
        assert isinstance(R.Marker()([odd], ["x"], [1]), tuple)
    docs = [(1, "nulla vitae " * 100_000, None, None, ""), (2, "real words here " * 100_000, None, None, "")]
    empty = spark.createDataFrame([], "artifact_hash string, source string"), spark.createDataFrame([], "content_hash string, extra map<string,string>")
    df = spark.createDataFrame(docs, DOCS)
    got = R.residue(df, *empty)
    assert [r[0] for r in got.collect()] == [1]
    assert [r.doc_id for r in R.without_residue(df, got).collect()] == [2]
    assert R.residue(df.limit(0), *empty).collect() == []


def test_a_name_that_never_varies_is_unfilled_too(spark):
    docs = [(i, "Dear {{first_name}}, thank you for your order.", None, None, "") for i in range(4)] + [(9, "Hi {{first_name}}, a quick word on the supply line.", None, None, "")]
    empty = spark.createDataFrame([], "artifact_hash string, source string"), spark.createDataFrame([], "content_hash string, extra map<string,string>")
    assert sorted(r[0] for r in R.residue(spark.createDataFrame(docs, DOCS), *empty).collect()) == [0, 1, 2, 3]


NONE = "artifact_hash string, source string", "content_hash string, extra map<string,string>"


def test_pages_of_any_wording_are_induced_from_repetition(spark):
    page, maxim = "Whoa there, this page took a holiday.\nref 9f8e7d6c5b4a", "Slow notes make fast meetings."
    odd = lambda i: "".join(chr(97 + (i * 7 + k * 3) % 26) for k in range(9))
    docs = [(i, page.replace("9f8e", f"{i:04}"), f"s{i}", None, "") for i in range(6)]
    docs += [(100 + i, f"{maxim}\nA letter on {odd(i)} and {odd(i + 5)}.", f"s{i}", None, "") for i in range(6)]
    docs += [(200, "A plain text that was copied.", "s1", None, ""), (201, "A plain text that was copied.", "s2", None, ""), (300, f"{page}\nThe holiday was long and {odd(3)} came.", "s9", None, ""), (400, maxim, "s9", None, "")]
    empty = [spark.createDataFrame([], x) for x in NONE]
    assert sorted(r[0] for r in R.residue(spark.createDataFrame(docs, DOCS), *empty).collect()) == list(range(6))


def test_a_name_kept_by_one_record_of_a_known_template(spark):
    docs = [(1, "Title: {{subject_line}} of today", None, None, ""), (2, "Ahoy {{subject_line}} and crew", None, None, ""), (3, "Ahoy there, crew of today", None, None, "")]
    empty = [spark.createDataFrame([], x) for x in NONE]
    assert sorted(r[0] for r in R.residue(spark.createDataFrame(docs, DOCS), *empty).collect()) == [1, 2]
