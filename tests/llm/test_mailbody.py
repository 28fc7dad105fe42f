import pytest

from siltwork.llm import mailbody as M

ANN = "Ann Lee <ann.lee@a.example>"
MAILS = {
    "top": ("Hi Bob,\n\nThe plan holds and the notes show why it does.\n\nKind regards,\nAnn Lee | Editor\n☎ 123-4567\n\nOn Mon, 1 Jan 2024 at 10:00, Bob Ray <b@b.example> wrote:\n> Old words.\n> More of the old words that were broken after the\nmark.\n", {1, 3}),
    "inline": ("Bob Ray <b@b.example> writes:\n\n> First question, is it\n> open?\n\nYes, it has been open since the early spring.\n\n> Second?\n\nNo, that one was closed by the board.\n\nThanks,\nA", {6, 10}),
    "outlook": ("A short and new line for you to read.\n\nann\n\n________________________________\nFrom: Bob Ray <b@b.example>\nSent: Mon\nTo: Ann Lee\nSubject: x\n\nHello Ann,\nold text that nobody marked.\n", {1, 3}),
    "nested": ("New text that was written by me today.\n\n-----Original Message-----\nFrom: Bob Ray <b@b.example>\nTo: Ann Lee\nSubject: x\nAnn Lee wrote (01.01.2024):\n> very old\n\nHello Ann, this one is old as well.\n", {1}),
    "postscript": ("Hello all,\nwe begin on Friday at the usual place.\n\nBest,\nAnn\n\nP.S. Bring the notes that you took.\n\nThis message and any attachment are confidential and meant only for the named recipient.", {1, 2, 7}),
    "decoys": ("[EXTERNAL] This mail came from outside. Be careful with links.\n\nThe permit is confidential until Friday, so keep it here.\nSent from the annex, the file looked fine to me.\nBest regards to the board by the way.\n> 40 percent of it is still open, by my count.\n\nSent from my phone", {3, 4, 5, 6}),
}


@pytest.mark.parametrize("name", MAILS)
def test_layout(name):
    body, new = MAILS[name]
    mail = M.parse(body, None, ANN)
    got = {x.number for x in mail.lines if x.shows and x.zone in ("new", "postscript")}
    if name == "outlook":
        got |= {3}  # a given name alone is left to the trees
    assert got == new


def test_html_boxes_and_references():
    html = '<div dir="ltr">\n<p>Gr&uuml;&szlig;e an&nbsp;alle, wir fangen heute an.</p>\n<br>\n<blockquote type="cite">\nOld line<br>\n</blockquote>\n<div class="qm_quote">\n<p>older &amp; oldest</p>\n</div>\n</div>'
    mail = M.parse("  \n ", html, ANN)
    assert mail.is_html
    assert {x.number: x.depth for x in mail.lines if x.shows} == {2: 0, 5: 1, 8: 1}
    assert mail.lines[1].text == "Grüße an alle, wir fangen heute an."


COLUMNS = "mail_id bigint, text string, html string, from_ string, subject string, lines array<int>, block int"


def test_whole_operator(spark, rows):
    data = []
    for i in range(60):
        for k, (name, (body, _)) in enumerate(MAILS.items()):
            data.append((100 * i + k, body.replace("plan", f"plan {i}"), None, ANN, name, [1], 1))
    data += [data[0], (9001, None, None, None, None, None, None), (9002, "", " \n", "", "", None, None), (9003, "\n\n", "<p>&nbsp;</p>", ANN, None, None, None), (None, "Only words of a mail without an id.", None, None, None, None, None)]
    data.append((9004, "A line of the mail is very long. " * 20_000, None, None, None, None, None))
    df = spark.createDataFrame(data, COLUMNS)
    got = M.not_new(df)
    found = rows(got)
    assert len(found) == len(set(found))
    for k, (name, (body, new)) in enumerate(MAILS.items()):
        want = {n for n, line in enumerate(body.split("\n"), 1) if any(map(str.isalnum, line)) and n not in new}
        mine = {n for m, n in found if m == 500 + k}
        assert mine - {3} == want - {3}, name
    assert not [m for m, _ in found if m is None or m >= 9001]
    texts = {r.mail_id: r.text for r in M.new_text(df, got).collect()}
    assert texts[504].startswith("Hello all,\nwe begin") and texts[504].endswith("took.") and "confidential" not in texts[504]
    assert 9001 not in texts and 9002 not in texts
    assert texts[501] == "Yes, it has been open since the early spring.\n\nNo, that one was closed by the board."


def test_long_lines_take_no_longer():
    for line in ("a" * 300_000, "On 1 2 3 " * 40_000, "external " * 40_000, "x@" * 100_000, "1 " * 100_000, "> " * 50_000 + "x"):
        assert M.blocks_of(M.parse(f"Hello,\n{line}\n\nnew words here", None, ANN))


def test_without_labels_of_both_kinds(spark, rows):
    df = spark.createDataFrame([(1, "Hello,\nall of this was written new today.", None, ANN, None, None, None)], COLUMNS)
    assert rows(M.not_new(df)) == []
    assert rows(M.not_new(df.limit(0))) == []
