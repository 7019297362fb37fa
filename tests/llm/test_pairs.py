import pytest

from loamsift.llm.languages import Profiles, train
from loamsift.llm.pairs import COPY, EMPTY, LANGUAGE, REFUSAL, TRUNCATED, Judge, covered, flag_pairs, tiles
from loamsift.llm.parser import Parse

TEXTS = {
    "en": ["The server reads the option when it starts and keeps the value for a week. Once the cache is full, the oldest entry is removed before a new one is stored.", "You can set the limit with this option, which tells how long a client may wait for the answer of the store.", "After every change the copy is checked, and nothing is lost if the other side does not respond in time."],
    "de": ["Der Server liest die Einstellung beim Start und behält den Wert eine Woche lang. Sobald der Speicher voll ist, wird der älteste Eintrag gelöscht, bevor ein neuer angelegt wird.", "Mit dieser Einstellung legen Sie fest, wie lange eine Anfrage auf die Antwort warten darf, wenn die Größe überschritten ist.", "Nach jeder Änderung wird die Kopie geprüft, und nichts geht verloren, wenn die andere Seite nicht rechtzeitig antwortet."],
    "fr": ["Le serveur lit cette option au démarrage et garde la valeur pendant une semaine. Dès que la mémoire est pleine, l'entrée la plus ancienne est supprimée avant que la nouvelle ne soit écrite.", "Utilisez cette option pour indiquer combien de temps une requête peut attendre la réponse de la page.", "Après chaque changement la copie est vérifiée, et rien n'est perdu si l'autre côté ne répond pas à temps."],
    "es": ["El servidor lee esta opción al iniciar y guarda el valor durante una semana. Cuando la memoria está llena, la entrada más antigua se borra antes de que se escriba la nueva.", "Use esta opción para indicar cuánto tiempo puede esperar una llamada la respuesta de la página compartida.", "Después de cada cambio se comprueba la copia, y nada se pierde si el otro lado no responde a tiempo."],
}
JUDGE = Judge(Profiles(TEXTS))
defect = JUDGE.defect

Q = "How does Harbor rotate the signing key when `rotate_days` is set?"
G = "Set `rotate_days` to the number of days. After that time Harbor makes a new key and keeps the old one for a week."
ES = "La clave se cambia después de los días que indica la opción, y la antigua queda una semana en el almacén."


@pytest.mark.parametrize(
    "answer, want",
    [
        (G, None),
        (None, EMPTY),
        ("", EMPTY),
        (" [1] ", EMPTY),
        ("**", EMPTY),
        ("N/A", EMPTY),
        ("<p></p>", EMPTY),
        ("Answer:", EMPTY),
        ("​", EMPTY),
        ("`rotate_days` = 90", None),
        ("```yaml\nrotate_days: 90\n```", None),
        ("```yaml\nrotate_days: 90", TRUNCATED),
        ("Set `rotate_days` to the number of days. After that time Harbor makes a new", TRUNCATED),
        ("Set `rotate_days` to the number of days. After that time Harbor makes a ne", TRUNCATED),
        ("Set `rotate_days` to the number of days. After that…", TRUNCATED),
        ("Set `rotate_days` to the number of days. After that time Harbor makes a new key and keeps the old one for a week", None),
        ("Set `rotate_days` to the number of days. After that time Harbor makes a new key and keeps the old one for a week [2]", None),
        ("Set `rotate_days` to the number of days.\n\n- `rotate_days`\n- `keep_old`", None),
        ("Set the number of days with `rotate_da", TRUNCATED),
        ("There are two steps.\n\n1. Set `rotate_days` to the number of days.\n2. **", TRUNCATED),
        ("There are two steps.\n\n1. Set `rotate_days` to the number of days.\n2.", TRUNCATED),
        ("Use `rotate_days` para indicar si la copia protege la clave compartida.", LANGUAGE),
        ("I could not find `rotate_days` anywhere in the sources.", REFUSAL),
        ("I'm sorry, but I can't answer that.", REFUSAL),
        ("I'm not sure about older releases, but this is what the page says. " + G, None),
        (Q, COPY),
        (Q.upper(), COPY),
        ("You asked: " + Q, COPY),
        (Q + "\n\nAnswer:", COPY),
        (Q + " " + Q, COPY),
        (Q + " " + G, None),
        (ES, LANGUAGE),
        (G + ' A page in Spanish calls it "' + ES + '".', None),
    ],
)
def test_defects(answer, want):
    assert defect(Q, G, answer) == want


def test_a_refusal_is_right_where_the_golden_answer_declines():
    assert defect(Q, "None of the pages covers how Harbor rotates the key.", "I do not know.") is None
    assert defect("Comment Harbor change-t-il la clé ?", "La documentation ne dit pas si Harbor change la clé.", "Je ne sais pas.") is None
    assert defect(Q, None, "I do not know.") == REFUSAL
    assert defect(None, G, G) is None


def test_languages_and_scripts():
    language = JUDGE.profiles.language
    assert language("Die Schlüssel werden nach einer Woche gelöscht.") == "de"
    assert language("La clé est gardée pendant une semaine et puis supprimée.") == "fr"
    assert JUDGE.profiles.scores("Ключ хранится одну неделю")["cyrillic"] == 100
    assert defect(Q, G, "Ключ хранится одну неделю и потом удаляется.") == LANGUAGE


def test_the_parser_knows_what_is_open():
    assert Parse("a (b [c] d) `e (`").open == []
    assert Parse("a (b [c").open == ["(", "["]
    assert Parse("~~~\nx").open == ["fence"]
    assert Parse('he said "no').open == ['"']


def test_the_parser_reads_elements_emphasis_lists_and_tables():
    assert Parse("<ul><li>one<li>two").open == ["ul"]
    assert Parse("<ul>\n<li>one</li>\n</ul>\n\nThen <br> go on").open == []
    assert Parse("The <div class=").open == ["tag"]
    assert Parse("This is **impor").open == ["**"] and Parse("This is **important**").open == []
    assert Parse("See [the page](https://x").open == ["("]
    assert Parse("| a | b |\n|---|---|\n| 1 | 2 |\n| 3").open == ["row"] and Parse("| a | b |\n|---|---|\n| 1 | 2 |").open == []
    assert Parse("An (open one.\n\nThe next is whole.").open == []
    long = "word " * 500
    assert Parse(f'He says "{long}" and goes.').plain.split() == ["He", "says", "and", "goes."]


def test_tiles_are_greedy_and_marked_on_both_sides():
    assert sorted(tiles("a b c d a b".split(), "x a b y c d".split())) == [(0, 1, 2), (2, 4, 2)]
    assert tiles("a b c".split(), "c b a".split()) == []
    assert tiles("p q r s".split(), "q r s p q r s t".split())[0] == (0, 3, 4)
    assert covered("a b c d a b".split(), "x a b y c d".split()) == 6


# Further wordings; the shortest stand-ins for nothing stand in the test tables, too.
FURTHER = {
    REFUSAL: ["The handbook is silent on key rotation.", "That information isn't available to me.", "As a language model, I must refrain from giving advice.", "Nothing in the excerpts addresses this.", "I'm unable to determine that.", "There is no mention of it in the docs.", "We could not find any details about the signing key.", "Darüber steht in den Unterlagen nichts.", "Les extraits ne mentionnent rien à ce sujet.", "Los pasajes no contienen esa información."],
    EMPTY: ["Not applicable", "(none given)", "No answer provided.", "-", "null", "...", "Keine Antwort vorhanden", "Sin respuesta", "Brak odpowiedzi", "<div></div>"],
    LANGUAGE: ["Nach dieser Zeit wird ein neuer Schlüssel angelegt, und der alte bleibt noch eine Woche gültig."],
    TRUNCATED: ["<ul><li>Set the days</li><li>restart it.", "| option | days |\n|---|---|\n| `rotate_days` | 90 |\n| `keep", "Set `rotate_days` to", "Use **rotate", "After that"],
}


@pytest.mark.parametrize("kind", sorted(FURTHER))
def test_further_wordings_are_found(kind):
    got = [defect(Q, G, a) for a in FURTHER[kind]]
    assert sum(x == kind for x in got) >= 0.9 * len(got), [p for p in zip(FURTHER[kind], got) if p[1] != kind]


def test_a_short_value_and_a_long_quotation_are_proper():
    assert defect(Q, "90 days", "90 days") is None and defect(Q, G, "Yes") is None
    assert defect(Q, G, G + ' Elsewhere it says "' + (ES + " ") * 20 + '".') is None


def test_profiles_are_trained_on_labelled_rows(spark):
    rows = [(k, t) for k, ts in TEXTS.items() for t in ts] + [(None, "no label"), ("xx", "too few"), ("en", None), ("en", " ")]
    p = train(spark.createDataFrame(rows, "lang string, text string"), "text", "lang")
    assert p.names == ["de", "en", "es", "fr"] and p.language(ES) == "es"
    assert train(spark.createDataFrame([], "lang string, text string"), "text", "lang").names == []


def test_rows(spark):
    rows = [(1, Q, G, None, "x"), (1, Q, G, None, "x"), (2, Q, G, G, "y"), (3, None, None, None, "z"), (4, Q, G, G + " " + "word " * 200000 + ".", "long"), (None, Q, G, "", "n")]
    df = spark.createDataFrame(rows, "id long, question string, golden string, answer string, defect string")
    got = sorted((r.id or 0, r.defect) for r in flag_pairs(df, "id", "question", "golden", "answer").collect())
    assert got == [(0, EMPTY), (1, EMPTY), (1, EMPTY), (3, EMPTY)]
    assert flag_pairs(df.limit(0), "id", "question", "golden", "answer").count() == 0


def test_long_and_explained_refusals_are_seen():
    q, g = "How often does the keeper rotate the key?", "The keeper rotates the key every forty minutes, counted from startup."
    long = "I cannot answer this question from the sources. " + "The documentation does not mention anything about it. " * 10
    explained = "I don't know how often that happens. The pages cover the installation on several platforms and list the ports that must be open before the first run."
    answer = "I cannot say it shorter, sorry. The rotation happens every forty minutes, counted from startup, and nothing else triggers it."
    assert [defect(q, g, a) for a in (long, explained, answer)] == ["refusal", "refusal", None]
