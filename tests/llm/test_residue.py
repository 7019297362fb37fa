import pytest

from loamsift.llm.residue import Exemplars, find_residue, shown_out

PLAIN = "The server reads the page and the template from disk. A browser shows the page. "
BAD = {
    "Dear {{ first_name }}, welcome.": "slot",
    "Published: [INSERT DATE HERE]": "slot",
    "Contact <team goes here> first.": "slot",
    "# ${TITLE}": "slot",
    "Please enable JavaScript to view this page.": "script",
    "Harbor needs scripts to run. Enable them and reload.\n\nLoading...": "script",
    "# 502\n\nBad Gateway": "error",
    "HTTP ERROR 404 (Not Found)": "error",
    "Intro.\n\nSomething went wrong on our side. Try again in a few minutes.": "error",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.": "filler",
    "blah blah blah blah blah blah": "filler",
    "TODO: write this part.": "filler",
}
GOOD = [
    PLAIN,
    "The engine replaces `{{ author }}` by a name.",
    "```html\n<h1>{{ title }}</h1>\n```\nThis prints the title.",
    "```\nGET /items/{item_id}\n```",
    'The handler turns the message "Not Found" into JSON.',
    "Disable JavaScript in the browser to test the plain view.",
    "The linter warns about comments that start with TODO or XXX.",
    "> Something went wrong on our side. Try again in a few minutes.\n\nThat is how users see it.",
    "An error in the shared file means that the reader could not open the page.",
]


def test_texts(spark):
    rows = [(i, t) for i, t in enumerate([*BAD, *GOOD, *[PLAIN + str(k) for k in range(20)]])]
    got = {r.id: r.label for r in find_residue(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got == dict(enumerate(BAD.values()))


def test_nulls_repeats_long_texts_clashing_columns_and_empty_tables(spark):
    bad = "Please enable JavaScript to view this page."
    rows = [(1, None), (2, ""), (3, "  \r\n"), (4, bad), (4, bad), (5, PLAIN * 20000 + "\r\n" + bad + "\r\n"), (None, bad)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, label string")
    got = sorted((r.id or 0, r.label) for r in find_residue(df, "id", "text").collect())
    assert got == [(0, "script"), (4, "script"), (4, "script"), (5, "script")]
    assert find_residue(df.limit(0), "id", "text").count() == 0


def test_what_is_shown_is_left_out():
    t = shown_out("a `b` c\n~~~\nd\n~~~\n> e\n“f g” h <pre>i</pre>")
    assert [x in t for x in "abcdefghi"] == [True, False, True, False, False, False, False, True, False]


def test_the_index_holds_every_exemplar_under_its_rarest_concept():
    from collections import Counter

    from loamsift.llm.residue import BITS, union

    ex = Exemplars()
    ex.index(Counter({"PAGE": 900, "NOT": 950, "FIND": 20}), 1000)
    held = [row for rows in ex.where.values() for row in rows]
    for label, cs in ex.rows:
        whole = union([BITS[c] for c in cs])
        assert any(k == label and whole & part == part for k, part in held)
    # "page" and "not" are so common here that "find" and either of them weigh enough, but not "find" alone.
    assert all(part != BITS["FIND"] for _, part in ex.where[BITS["FIND"]])


# Further wordings of the same kinds of residue; two of them stand in the test tables, too.
FURTHER = {
    "script": ["We're sorry but this site doesn't work properly without JavaScript enabled.", "You must enable scripting in your browser to continue.", "JavaScript must be enabled in order for you to use this application.", "Your browser has JavaScript turned off.", "Ihr Browser unterstützt kein JavaScript.", "Cette application nécessite JavaScript.", "Su navegador no soporta JavaScript.", "Verifying your browser before proceeding."],
    "error": ["We can't find the page you requested.", "That address does not exist any more.", "The document has been removed.", "Access denied.", "You are not authorized to view this page.", "Your login has timed out.", "Service temporarily unavailable.", "Ein unerwarteter Fehler ist aufgetreten.", "La page demandée n'existe plus.", "No tiene permiso para ver esta página.", "Die Sitzung ist abgelaufen.", "504 Gateway Timeout", "Oops, an error occurred."],
    "filler": ["Insert your description here.", "Placeholder text", "This page is intentionally left blank.", "Content to follow.", "Ihr Text steht hier.", "Votre texte ici.", "Añada su texto aquí.", "TBD", "Site under construction.", "qwerty asdf zxcv"],
}
OWN_WORDS = [
    "The page cache cannot find an entry for the tenant that a worker removed from the index last night.",
    "If the page is not found, the router shows the closest match.",
    "The parser raises an exception whenever a template has no closing brace in its header.",
    "Scripts in the pipeline folder run in order of their names and need the worker role.",
    "Add a description of the retention policy to the manifest before each release of the cluster.",
    "Access to the vault is denied for tenants that have no billing contact in the registry.",
]


@pytest.mark.parametrize("label", sorted(FURTHER))
def test_further_wordings_are_found(label):
    got = labels(*FURTHER[label])
    assert sum(g == label for g in got) >= 0.9 * len(got), [t for t, g in zip(FURTHER[label], got) if g != label]


def test_texts_about_pages_and_errors_are_none():
    assert labels(*OWN_WORDS) == [None] * len(OWN_WORDS)


def labels(*texts):
    from collections import Counter

    from loamsift.llm.residue import match

    ex = Exemplars()
    ex.index(Counter(), 1000)
    return [match(ex, t) for t in texts]


def test_short_filler_counts():
    own = ["blah blah blah", "bla bla bla", "test test test", "xxx xxx xxx", "foo bar baz qux", "asdf qwer asdf jkl"]
    more = ["Lorem ipsum dolor sit amet.", "Consectetur adipiscing elit.", "# Guide\n\nLorem ipsum dolor.\n\nThe next part is written.", "lorem ipsum lorem ipsum", "asdf asdf asdf"]
    assert labels(*own, *more) == ["filler"] * 11
    assert labels("Non, non, non.", "In id est.", "Lorem ipsum", "Run the test.", "Test the test.", "`foo bar baz`", "Set foo to bar.", "The text lorem ipsum dolor is sample text.") == [None] * 8


def test_windows_cross_the_line_ends_of_a_paragraph():
    wrapped = [
        "The page you asked for could not be found.\nIt may have moved or been removed.",
        "Intro.\n\nThe page you asked\nfor could not be\r\nfound. It may have\nmoved or been\nremoved.\n\nEnd.",
        "- one\n- Please enable\n  JavaScript to\n  view this page.",
        "Status\nSomething went wrong on our side. Try again in a few minutes.\nBack",
    ]
    assert labels(*wrapped) == ["error", "error", "script", "error"]
    assert labels("# Please enable\nJavaScript to\n\nview this page.", "Please enable\n\n- JavaScript to\n- view this page.", "Users see \"Please enable\nJavaScript to view\nthis page.\" and leave.") == [None] * 3
