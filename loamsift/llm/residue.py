"""Template residue and error-page text, by retrieval of labelled exemplars and TF-IDF containment.

Words are read as concepts: a lexicon of general vocabulary in several languages says which words stand for "page", "not", "find", "script" and so on, so that an exemplar is found
however it is worded. Labelled exemplars (script notices, error messages, filler) are combinations of concepts and stand in an inverted index under their rarest concept in the whole corpus. A passage
window of one or two sentences is compared with the exemplars that the index gives for it: they must be contained in it, weighted by inverse document
frequency, and the window in turn must consist mostly of the label's vocabulary (coverage), so that a text about scripts or errors, which has words of its own, is none. Sentences
with a condition ("if the page is not found ...") describe and don't count. Filler without meaning is seen by its form: the printers' Latin passage, words repeated, rows of keys.
Unfilled slots are recognised by their syntax, as they have no words to weigh. Code, inline code, quotations and block quotes are left out before: what is shown there is talked about, not left over.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from http import HTTPStatus
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, slices

#: The share of an exemplar's weight that a window must hold, and of a window's own words that its label's vocabulary must make up: of one sentence, of two.
CONTAINED, COVERED = 0.95, (0.65, 0.7)

# The lexicon, from general vocabulary. A star ends a stem; an underscore joins words that follow each other.
LEXICON = {
    "SCRIPT": "javascript js ecmascript script scripts scripting noscript skript* client_side_code",
    "BROWSER": "browser browsers navigateur navegador browsers",
    "ENABLE": "enable enabl* activate activat* turn_on turned_on turn_it_on switch_on switched_on switch_it_on switch_them_on allow allows allowing unblock aktivier* einschalten erlauben zulassen activer activez activé* autoris* activar active activa activad* activo habilit* permitir permita abilit* attiva* ative ativar",
    "DISABLED": "disabled off blocked deactivat* turned_off switched_off deaktivier* ausgeschaltet désactiv* desactiv* deshabilit* disabilitat* desativad*",
    "REQUIRE": "need needs needed require requires required must necessary depends depend relies benötig* erforder* braucht brauchen muss müssen nécessit* requis* requier* nécessaire doit devez requiere requier* necesit* necesari* debe preciso richiede richiest* necessario",
    "RUN": "run runs running start starts load loads loading work works display displayed show shown view viewing read see use open opens continue proceed render renders laden anzeigen sehen starten fortfahren weiter afficher voir charger continuer ver mostrar cargar continuar funcionar visualizz* visualiz*",
    "SUPPORT": "support supports supported unterstütz* prend_en_charge compatible soporta admite capable",
    "CHECK": "checking verifying verify check überprüf* prüfen vérifi* comprob* verific*",
    "COOKIE": "cookie cookies",
    "NOT": "not no cannot couldn can_t can_not doesn don isn wasn won hasn haven didn wouldn aren never nothing nowhere unable without none nicht kein keine keinen nichts ohne ne n pas sans aucun* sin ningun* ningún nunca non senza não sem impossible unmöglich imposible",
    "FIND": "find found locate located exist exists existing such match matches gefunden finden existiert gibt vorhanden trouv* existe existent encontr* trovat* esiste there",
    "MISSING": "missing gone moved removed deleted vanished introuvable déplacé* supprimé* verschoben gelöscht entfernt eliminad* movido borrad* cambiado inexistent* notfound unavailable_page",
    "PAGE": "page pages site website webpage url link address document documents file resource article path location app application viewer seite webseite adresse dokument ressource datei document* adresse ressource página página* sitio dirección recurso documento pagina documento aplicación anwendung",
    "REQUEST": "request requests requested asked looking looked looked_everywhere wanted tried angeforder* aufgerufen* gesuchte* demandé* cherch* recherch* solicit* buscad* busca* richiest* pedid*",
    "ERROR": "error errors exception failure fault problem trouble oops whoops crash crashed fehler ausnahme erreur erreurs problème fallo errore erro",
    "OCCUR": "occurred occur occurs happened encountered arose arisen thrown raised unexpected unhandled internal fatal aufgetreten passiert unerwartet* survenu* produit* inattendu* ocurrido producido inesperad*",
    "WRONG": "wrong went_wrong schief schiefgegangen mal_passé salió_mal",
    "RETRY": "again later retry reload refresh try back minutes moment shortly soon come erneut später versuchen nochmals neu réessay* ultérieurement tard inténte* intente vuelva intentar riprova novamente",
    "SERVER": "server servers service services system systems host gateway backend dienst dienste serveur servidor servicio servizio",
    "DOWN": "unavailable down maintenance overloaded offline unreachable busy outage reached temporarily wartung wartungsarbeiten indisponible mantenimiento disponible verfügbar erreichbar available accessible",
    "ACCESS": "permission permissions access authorized authorised authorization privileges rights berechtigung* zugriff zugang autorisation droits accès permiso permisos acceso autorizad* permesso accesso",
    "DENIED": "denied forbidden refused rejected restricted verweigert verboten refusé interdit denegad* prohibid* negato unauthorized unauthorised",
    "SESSION": "session login sitzung sesión sessione",
    "EXPIRED": "expired expire ended timed_out abgelaufen expiré* caducad* expirad* terminad* scaduta",
    "SIGNIN": "sign_in log_in signin login anmelden einloggen connecter reconnect* identif* iniciar inicie",
    "TRAFFIC": "traffic robot robots bot bots captcha human datenverkehr trafic tráfico network",
    "UNUSUAL": "unusual suspicious automated ungewöhnlich* inhabituel* inusual* seen detected",
    "BLOCK": "blocked block banned bloqué* bloquead* gesperrt",
    "CONNECT": "connect connection connecting establishing established database verbindung datenbank connexion conexión",
    "WHO": "team author authors editor editors writer maintainer maintainers redaktion autor équipe auteur equipo autor",
    "TEXT": "text texts part step content contents copy words wording paragraph sentence sentences description body_copy body caption overview summary title subtitle heading section inhalt beschreibung absatz überschrift texte contenu paragraphe titre description texto contenido párrafo descripción título testo conteúdo",
    "HERE": "here goes go place placed hier steht ici aquí qui aqui",
    "FOLLOW": "follow follows following soon coming later come added folgt folgen später venir suivre próximamente seguir prossimamente breve",
    "WRITE": "add insert enter replace write fill fill_in put type edit provide click einfügen ersetzen eingeben hinzufügen ajout* insér* saisi* remplac* añad* insert* escrib* reempla* inserisci",
    "YOUR": "your own ihr ihren ihre eigenen votre vos su sus tu tuo seu",
    "DUMMY": "dummy placeholder placeholders filler lipsum blindtext beispieltext platzhalter* fülltext factice fictif remplissage relleno segnaposto",
    "SAMPLE": "sample mock example exemple ejemplo prueba beispiel esempio",
    "INTENT": "intentionally left absichtlich gelassen intentionnellement laissé* intencionad*",
    "VOID": "empty blank vacant leer vide vacío vacía vuot*",
    "LAYOUT": "layout design template only box mise_en_page maquetación gestaltung nur",
    "UNFINISHED": "construction unfinished incomplete bau aufbau construction construcción costruzione",
    "TODO": "todo tbd fixme tba tbc wip xxx",
}
# Labelled exemplars as combinations of concepts.
EXEMPLARS = {
    "script": "ENABLE SCRIPT; SCRIPT DISABLED; SCRIPT REQUIRE; SCRIPT NOT RUN; SCRIPT NOT SUPPORT; SCRIPT BROWSER NOT; SCRIPT DOWN NOT; SCRIPT PAGE RUN; CHECK BROWSER; BROWSER SCRIPT SUPPORT; ENABLE COOKIE; ENABLE SCRIPT RETRY",
    "error": "PAGE NOT FIND; PAGE MISSING; ERROR OCCUR RUN PAGE; REQUEST NOT FIND; REQUEST MISSING; ERROR OCCUR; WRONG; WRONG RETRY; ERROR RETRY; NOT ACCESS; ACCESS DENIED; REQUEST BLOCK; REQUEST DENIED; TRAFFIC UNUSUAL; SESSION EXPIRED; SIGNIN RETRY; SERVER DOWN; PAGE DOWN NOT; PAGE DOWN RETRY; ERROR CONNECT; NOT CONNECT SERVER; ERROR PAGE; ERROR SERVER",
    "filler": "TEXT HERE; TEXT FOLLOW; TEXT FOLLOW WHO; DUMMY TEXT LAYOUT VOID; TODO WRITE; WRITE TEXT; WRITE YOUR TEXT; TEXT YOUR; DUMMY TEXT; DUMMY; SAMPLE TEXT LAYOUT; SAMPLE TEXT HERE; TEXT VOID INTENT; PAGE VOID INTENT; DUMMY TEXT NOT; UNFINISHED; TEXT UNFINISHED; TODO; TEXT YOUR PAGE; WRITE HERE",
}
# Words that may stand with any of them.
COMMON = set(
    "the a an of to and or is are was were be been it its that this these which with for from on in at by as you we i they our may has have had will please sorry your my if so just then them than after before do does did can could would should any all some few something someone side our up us out while here there other short "
    "der die das den dem des dies ein eine einen einem einer es ist sind war wird werden bitte und oder mit für von auf zu zum zur im in an sie wir ich ihr diese dieser dieses diesen um mehr hat haben "
    "le la les l un une des du de d et ou est sont être a été avec pour par sur dans en au aux que qu ce cette ces vous nous votre veuillez plus il y "
    "el los las una unos unas del y o es son ser con para por sobre al que se lo ha han su por_favor favor esta este más ya "
    "il lo gli di per con su non è si per_favore o os as um uma do da por para com não seu "
    "most many per about first once only also very over under between each every no because how what where who into again "
    "über unter nach vor bei aus durch gegen ohne zwischen jede jeder jedes jeden alle nur auch noch schon sehr aber wie was wo wer danach zuerst dann einmal ab kann damit sonst weil nicht als dass sich "
    "entre sans sous avant après depuis chaque tous toute toutes mais comme où donc puis qui si seule fois ne pas se "
    "entre sin hasta desde cada todo todos toda pero como donde luego después antes si sola vez no".split()
)
# Words that make a condition of a sentence.
CONDITIONS = set("if when whenever unless whether wenn falls sobald ob si quand lorsque lorsqu cuando quando".split())
# The printers' Latin passage.
LATIN = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
FUNCTION = COMMON - LATIN
# Names that programmers give to nothing, and the rows of keys.
NAMES = set("foo bar baz qux quux foobar".split())
ROWS = ("qwertyuiop", "qwertzuiop", "azertyuiop", "asdfghjkl", "qsdfghjklm", "zxcvbnm", "yxcvbnm", "wxcvbn", "1234567890")
#: Shorter words and passages are no rows of keys and no repetition.
KEYS, TIMES = 3, 3
#: Printers' Latin has a word of so many letters, and sentences of so many words have function words in every language of the lexicon.
PLAIN = 7
# Syntax of unfilled slots. Those of the first group occur in text by accident hardly ever.
SLOTS = [
    r"\{\{\{?\s*[#/^>&!]?\s*[A-Za-z_][\w .\-|:'\"()]*\}?\}\}", r"\{%-?\s*\w[^%{}\n]*-?%\}", r"\$\{\s*[A-Za-z_][\w.]*\s*\}", r"#\{\s*[A-Za-z_][\w.]*\s*\}", r"<%[=-]?\s*[A-Za-z_@][^%\n]*%>", r"<\?=?\s*(?:php )?\$?[A-Za-z_][^?\n]*\?>",
    r"%\([A-Za-z_]\w*\)[sdf]", r"\*\|[A-Z_:]+\|\*", r"%%[A-Za-z_]\w*%%", r"@@[A-Za-z_]\w*@@", r"\[\[[a-z_][\w.]*\]\]", r"(?<![\w_])__[A-Z][A-Z_]+__(?![\w_])", r"(?<!\w)\$[A-Za-z_]+\$(?!\w)",
    r"\[(?:INSERT|ENTER|ADD)\b[^\]\n]*\]", r"\[(?:insert|enter|add|your) [^\]\n]+\](?!\()", r"<(?:insert|your|enter) [^>\n]+>", r"<[^<>\n]+ goes here>", r"\[TB[DCA]\b[^\]\n]*\]", r"<[A-Z][A-Z_]{2,}>",
]
# The second group has other uses; there the name must look like a variable.
WEAK_SLOTS = [r"(?<![\w{$#%/=])\{[a-z]+(?:_[a-z]+)*\}(?![\w}/])", r"«[a-z]+(?:_[a-z]+)*»"]
#: Each pattern with a text that any match of it holds, which is looked for first.
_BEGINS = ("{{", "{%", "${", "#{", "<%", "<?", "%(", "*|", "%%", "@@", "[[", "__", "$", "[", "[", "<", " goes here>", "[TB", "<")
_SLOTS = [*((begin, re.compile(p)) for begin, p in zip(_BEGINS, SLOTS, strict=True)), *((begin, re.compile(p)) for begin, p in zip("{«", WEAK_SLOTS, strict=True))]


#: Stands for what is only shown: a word of its own, of no concept.
SHOWN_WORD = "shownpart"
SHOWN = f" {SHOWN_WORD} "
_CODE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\Z)", re.S | re.M)
_HTML_CODE = re.compile(r"<(pre|code|script|style)\b[^>]*>.*?</\1>", re.S | re.I)
_INLINE = re.compile(r"(`+)(?!`)[^\n]*?(?<!`)\1(?!`)")
_QUOTES = re.compile(r"\"[^\"\n]+\"|“[^”\n]+”|„[^“”\n]+[“”]|«\s[^»\n]+\s»|«[^»\n]* [^»\n]*»")
_BLOCK_QUOTE = re.compile(r"^ {0,3}>.*$", re.M)
#: Lines that are a block of their own, and such as begin one.
_ALONE = re.compile(r"\s*(?:#{1,6}(?:\s|$)|\||(?:[-*_]\s*){3,}$|=+\s*$|-+\s*$)")
_ITEM = re.compile(r"\s*(?:[-*+•]|\d{1,9}[.)])\s")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def shown_out(text: str) -> str:
    """The text without what it only shows: code and block quotes go, inline code and quotations leave a word behind."""
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    t = _CODE.sub("\n", t)
    if "<" in t:
        t = _HTML_CODE.sub(" ", t)
    t = _INLINE.sub(SHOWN, t)
    t = _BLOCK_QUOTE.sub("", t)
    return _QUOTES.sub(SHOWN, t)


def paragraphs(text: str) -> Iterator[list[str]]:
    """The lines of each paragraph. Blank lines and the Markdown blocks end one: headings, rules, list items and table rows."""
    lines: list[str] = []
    for line in text.split("\n"):
        alone = _ALONE.match(line)
        if lines and (alone or not line.strip() or _ITEM.match(line)):
            yield lines
            lines = []
        if alone:
            yield [line]
        elif line.strip():
            lines.append(line)
    if lines:
        yield lines


def passages(lines: list[str]) -> Iterator[list[list[str]]]:
    """The sentences, as words, of a paragraph whose lines are joined, then those of each of its lines.

    What is shown over a line end is left out once the lines are joined.
    """
    if len(lines) > 1:
        joined = " ".join(line.strip() for line in lines)
        yield [w for w in map(passage_words, _SENTENCE.split(_QUOTES.sub(SHOWN, _INLINE.sub(SHOWN, joined)))) if w]
    for line in lines:
        yield [w for w in map(passage_words, _SENTENCE.split(line)) if w]


def passage_words(s: str) -> list[str]:
    return WORD.findall(s.lower())


#: Each concept's bit.
BITS = {c: 1 << i for i, c in enumerate(LEXICON)}


class Lexicon:
    """Concepts of words, as sets of bits."""

    def __init__(self) -> None:
        self.whole: dict[str, int] = {}
        self.stems: dict[str, int] = {}
        self.joined: dict[str, list[tuple[tuple[str, ...], int]]] = {}
        for concept, line in LEXICON.items():
            for w in line.split():
                if "_" in w:
                    parts = tuple(w.split("_"))
                    self.joined.setdefault(parts[0], []).append((parts, BITS[concept]))
                else:
                    into = self.stems if w.endswith("*") else self.whole
                    w = w.rstrip("*")
                    into[w] = into.get(w, 0) | BITS[concept]
        self.lengths = sorted({len(x) for x in self.stems})
        self.begins = set(self.joined)
        self.seen: dict[str, int] = {}

    def of(self, w: str) -> int:
        """The concepts of one word."""
        got = self.seen.get(w)
        if got is None:
            got = self.whole.get(w, 0)
            for n in self.lengths:
                if n > len(w):
                    break
                got |= self.stems.get(w[:n], 0)
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[w] = got
        return got

    def read(self, words: list[str]) -> list[int]:
        """The concepts at each place; joined words count where they begin and after."""
        seen = self.seen
        out = [seen[w] if w in seen else self.of(w) for w in words]
        if not self.begins.isdisjoint(words):
            for i, w in enumerate(words):
                for parts, concept in self.joined.get(w, ()):
                    if tuple(words[i : i + len(parts)]) == parts:
                        for k in range(i, i + len(parts)):
                            out[k] |= concept
        return out


def union(concepts: list[int]) -> int:
    out = 0
    for c in concepts:
        out |= c
    return out


class Exemplars:
    """The labelled exemplars in an inverted index."""

    def __init__(self) -> None:
        self.lexicon = Lexicon()
        self.rows = [(label, tuple(line.split())) for label, block in EXEMPLARS.items() for line in block.split("; ")]
        self.vocabulary = {label: union([BITS[c] for k, cs in self.rows if k == label for c in cs]) for label in EXEMPLARS}
        # The names of HTTP errors are notices wherever they make up a passage.
        self.phrases = {tuple(passage_words(s.phrase)) for s in HTTPStatus if s >= 400}

    def index(self, count: Counter, documents: int) -> None:
        """Weighs the concepts by how rare they are in the corpus and keeps each exemplar under its rarest, as the smallest parts of it that weigh enough."""
        self.idf = {c: math.log((documents + 1) / (count[c] + 0.5)) + 0.1 for c in LEXICON}
        self.where: dict[int, list[tuple[str, int]]] = {}
        for label, cs in self.rows:
            total = sum(self.idf[c] for c in cs)
            falling = sorted(cs, key=lambda c: (-self.idf[c], c))
            enough: list[tuple[str, ...]] = []
            for n in range(1, len(cs) + 1):
                for part in combinations(falling, n):
                    if sum(self.idf[c] for c in part) >= CONTAINED * total and not any(set(e) <= set(part) for e in enough):
                        enough.append(part)
            for part in enough:
                self.where.setdefault(BITS[part[0]], []).append((label, union([BITS[c] for c in part])))
        self.rarest = union(list(self.where))

    def label(self, words: list[str], concepts: list[int], here: int, sentences: int = 1) -> str | None:
        """The label of the exemplar that a window, with the concepts ``here``, holds and mostly consists of."""
        if not here & self.rarest:
            return None
        hits = [label for c, rows in self.where.items() if here & c for label, cs in rows if here & cs == cs]
        if not hits or not CONDITIONS.isdisjoint(words):
            return None
        for label in dict.fromkeys(hits):
            known = self.vocabulary[label]
            own = [c & known != 0 for w, c in zip(words, concepts) if c & known or w not in COMMON and not w.isdigit() and len(w) > 1]
            if sum(own) >= COVERED[sentences - 1] * len(own):
                return label
        return None


def is_row_of_keys(w: str) -> bool:
    return len(w) >= KEYS and any(w in r or w[::-1] in r for r in ROWS)


def without_meaning(words: list[str], whole: bool = True) -> bool:
    """Printers' Latin, one word over and over, rows of keys, names for nothing, and, of ``whole`` sentences, those without a single function word of any language."""
    n = len(words)
    if n < TIMES:
        return False
    function = sum(map(FUNCTION.__contains__, words))
    if function > 0.2 * n:
        return False
    if "lorem" in words and "ipsum" in words and function <= 0.1 * n:
        return True
    latin = sum(map(LATIN.__contains__, words))
    if n >= 2 * TIMES and latin >= 0.8 * n or latin == n and max(map(len, words)) >= PLAIN:
        return True
    if whole and n >= PLAIN and not function and all(w.isalpha() and len(w) > 3 and w != SHOWN_WORD for w in words):
        return True
    if len(set(words)) * TIMES <= n and all(w.isalpha() and w not in COMMON for w in words):
        return True
    return all(is_row_of_keys(w) and not w.isdigit() for w in words) or all(w in NAMES for w in words) and len(NAMES.intersection(words)) >= TIMES


def _has_slot(text: str) -> bool:
    plain = html.unescape(text) if "&" in text else text
    return any(begin in plain and p.search(plain) for begin, p in _SLOTS)


def match(ex: Exemplars, text: str | None) -> str | None:
    """The label of the residue in the text, None if there is none: slot, script, error or filler."""
    if not text:
        return None
    t = shown_out(text)
    if _has_slot(t):
        return "slot"
    for lines in paragraphs(t):
        for nth, sentences in enumerate(passages(lines)):
            # The lines of a paragraph may be parts of sentences.
            whole = nth == 0
            last: tuple[list[str], list[int], int] | None = None
            for w in sentences:
                c = ex.lexicon.read(w)
                here = union(c)
                if without_meaning(w, whole):
                    return "filler"
                if len(w) <= 8:
                    core = tuple(x for x in w if not x.isdigit() and x not in ("error", "http", "status", "code"))
                    if core in ex.phrases and (len(w) > 1 or len(sentences) == 1 and not lines[0].lstrip().startswith("#")):
                        return "error"
                found = ex.label(w, c, here)
                if found is None and last:
                    both = last[0] + w
                    found = "filler" if without_meaning(both, whole) else ex.label(both, last[1] + c, last[2] | here, 2)
                if found:
                    return found
                last = (w, c, here)
    return None


def find_residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label): the documents whose text is or holds residue, with the kind found first.

    Equal texts get equal labels. NULL, empty and blank texts hold none; a text of any length is read whole; an empty table gives an empty result;
    rows come out as often as they come in; extra columns are ignored.
    """
    docs = df.select(F.col(key), F.col(text).alias("text__"))
    ex = Exemplars()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        n = 0
        for b in slices(batches, "text__"):
            for t in b.column(0).to_pylist():
                n += 1
                if t:
                    here = union(list(map(ex.lexicon.of, set(passage_words(t)))))
                    count.update(c for c, bit in BITS.items() if here & bit)
        names = [("", n), *count.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in names], type=pa.string()), pa.array([c for _, c in names], type=pa.int64())], names=["feature", "n"])

    got = {r[0]: r[1] for r in docs.select("text__").mapInArrow(frequencies, "feature string, n long").groupBy("feature").agg(F.sum("n")).collect()}
    ex.index(Counter(got), got.get("", 0))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("label", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text__"):
            found = pa.array([match(ex, t) for t in b.column(1).to_pylist()], type=pa.string())
            keep = found.is_valid()
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), found.filter(keep)], names=[key, "label"])

    return docs.mapInArrow(run, schema)
