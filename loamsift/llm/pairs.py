"""Broken prompt and response pairs: empty, truncated, refusing, copying and wrong-language answers.

An answer is parsed once by a pushdown parser (``parser``: fences, inline code, brackets, quotations, emphasis, elements, lists, tables), which tells what is left open
at its end, what is prose and what is only quoted. Greedy string tiling compares it with the question (is there anything else in it?) and
its last sentence with the golden answer's sentences (does it stop where one of them stops?). Refusals are recognised by a grammar of concepts: somebody, or the sources, deny
to know, to say or to hold something; what they deny to know is the complement and doesn't count. The language is told by the script and by character n-gram profiles (``languages``).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import words
from .languages import Profiles
from .parser import ITEM, Parse

#: An answer of fewer words outside code, whose end nothing shows, is a bare value.
LEAST_PROSE = 5
#: A refusal may hold this share of the golden answer's own words, and its sentence this share of words that are neither the grammar's nor the question's.
GOLDEN_TOLD, STRANGE = 0.1, 0.34
#: Questions are short; by so much, as a natural logarithm, one must speak for a language.
ASKED_MARGIN = 1.0
EMPTY, TRUNCATED, REFUSAL, COPY, LANGUAGE = "empty", "truncated", "refusal", "question_copy", "wrong_language"

# Words of which a stand-in for an answer consists, from general vocabulary.
VOID = set(
    "no none not null nil nan na n a undefined void empty blank unknown tbd tba todo missing answer answers response output result reply given provided available applicable supplied returned generated text content here "
    "keine keiner kein antwort vorhanden verfügbar angabe angaben leer unbekannt aucune aucun réponse pas de vide inconnu inconnue fournie disponible ninguna ninguno sin respuesta vacío desconocido proporcionada "
    "nessuna risposta senza vuoto sconosciuto nenhuma resposta sem vazio desconhecido brak odpowiedzi geen antwoord".split()
)
# Labels that may stand before a question that is given back.
LABELS = {"question", "q", "a", "answer", "you", "asked", "your", "is", "was", "the", "user", "prompt", "frage", "antwort", "ihre", "lautet", "sie", "fragten", "votre", "réponse", "vous", "avez", "demandé", "pregunta", "respuesta", "usted", "preguntó", "su"}

# The concepts of refusals, from general vocabulary; a star ends a stem.
GRAMMAR = {
    "NOT": "not no t cannot can't unable never nothing none nowhere neither nor without lack lacks lacking silent decline declines declined refuse refuses refrain abstain outside beyond insufficient unaware unclear unknown unsure unavailable undocumented impossible "
    "nicht nichts kein* weder ohne außerstande ablehnen unbekannt unmöglich ne n pas rien aucun* jamais sans impossible incapable inconnu* nada ningun* ningún sin nunca imposible desconocid* non nessun* não nenhum* sem nie nic geen niet",
    "SELF": "i we me my our us myself ich wir mir mich uns je j nous moi mon notre yo nosotros mi nuestro puedo podemos sé sabemos sabría tengo tenemos encuentro encontré dispongo disponemos he hemos io eu assistant model ai",
    "SOURCE": "context passage passages source sources reference references material materials document documents documentation docs page pages excerpt excerpts text texts handbook manual manuals guide guides knowledge corpus article articles notes files snippet snippets scope "
    "quelle quellen unterlagen texte texten kontext dokumentation dokument dokumente dokumenten seite seiten auszüge auszügen material handbuch contexte textes extraits éléments manuel fuente fuentes textos documento documentos documentación contexto pasaje pasajes página páginas contesto fonti contextos",
    "KNOW": "know knows known answer answers answered say says said tell tells help respond reply comment discuss explain explains explained assist provide provides provided give gives given find finds found see determine determined confirm infer share speak offer advise advice advising mention mentions mentioned cover covers covered describe describes described documented document address addresses addressed contain contains contained state states stated include includes included specify specified information info details detail data idea evidence clue sure certain able available allowed permitted enough discussing answering commenting "
    "weiß wissen sagen sagt antworten antwort beantworten beantwortet helfen finden finde gefunden erklären auskunft information* angaben dokumentiert beschrieben erwähnt erwähnen steht enthalten enthält möglich "
    "sais savoir savons dire dit dis disent disons parl* précis* répond* aider trouv* réponse indiqu* mentionn* document* décrit* décriv* expliqu* contien* saber decir* dice* responder* ayudar* encontrar encontrado respuesta información datos documentado describ* mencion* explic* figura figuran aparece posible indica* contien* trata* cubre* so sapere dire rispondere informazioni sei dizer responder informação",
    "THIS": "this that it there das dies es dazu darüber darauf hierzu ce cela ceci il c ça y esto eso hay ello questo isso sorry apologies unfortunately leider désolé désolée malheureusement regrets siento lamento afraid please bitte veuillez",
}
# Words that begin the complement of a denial.
COMPLEMENT = set("how whether what why which when where who about of on for regarding concerning if to from in because since wie ob was warum welche wann wo wer über zu für von comment si que qu pourquoi quel quelle quand où sur à de du des pour cómo qué por cuál cuándo dónde sobre a del de para come se perché su quando quanto".split())
# Function words, which say nothing of their own; those of the second line can't end a sentence.
FUNCTION = set(
    "am are is was were be been being do does did doing have has had having will would can could shall should may might must just only so very too as at by with but any all anything something anyone some such here now yet up out more less much really simply further rather based "
    "bin ist sind war kann können konnte möchte darf werde habe haben wurde wird aber auch nur hier mehr dieser diese diesen dem den des im am auf suis est sont été peux peut pouvons pouvez ai avons avez vous cette ces ces dans par mais aussi plus ici es son está están puede pueden ha han me le lo las los este esta estos estas pero también más aquí en".split()
)
_OPEN_WORDS = set("the a an of to and or with for from by in on at as that which if when while than into but der die das ein eine einen und oder mit für von zu dass wenn als le la les un une des du de et ou avec pour par dans que si el los las una unos y o con para por en que".split())

_CITATION = re.compile(r"\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_INVISIBLE = re.compile(r"[\u200b-\u200f\u2060\ufeff\u00ad]")
_END = re.compile(r"[.!?。！？…](?:[\"'”’»)\]*_`]|\s)*$")
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"'”’»)*]*\s+|\n{2,}|\n(?=\s*(?:[-*+•]|\d{1,3}[.)])\s)")
_CLAUSE = re.compile(r"[;:]\s|\s[–—-]\s")


def normal(text: str | None) -> str:
    """NFC, no invisible characters, LF line ends, no citation numbers."""
    t = _INVISIBLE.sub("", unicodedata.normalize("NFC", text or "")).replace("\r\n", "\n").replace("\r", "\n")
    return _CITATION.sub("", t)


def sentences(text: str) -> list[str]:
    return [s.strip() for s in _SENTENCE.split(text) if s and s.strip()]


def tiles(a: list[str], b: list[str], least: int = 2) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (i, j, n), the longest matches a[i:i+n] == b[j:j+n] of words not yet marked, longest first; they are marked in both, until none of ``least`` words is left."""
    where: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    free_a, free_b = [True] * len(a), [True] * len(b)
    out = []
    while True:
        best, found = least, []
        for i in range(len(a)):
            for j in where.get(a[i], ()) if free_a[i] else ():
                if i and j and free_a[i - 1] and free_b[j - 1] and a[i - 1] == b[j - 1]:
                    continue
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best or n == best and n >= least:
                    if n > best:
                        best, found = n, []
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                out.append((i, j, best))
                free_a[i : i + best] = free_b[j : j + best] = [False] * best


def covered(a: list[str], b: list[str], least: int = 2) -> int:
    """How many words of ``a`` tiles of ``b`` cover. ``a`` is taken in parts of twice the length of ``b``, each with a fresh ``b`` until nothing more is covered, as ``a`` may hold ``b`` again and again."""
    total, step = 0, max(8, 2 * len(b))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        while part:
            marked = tiles(part, b, least)
            if not marked:
                break
            gone = {i + k for i, _, n in marked for k in range(n)}
            total += len(gone)
            part = [w if i not in gone else "" for i, w in enumerate(part)]
            if all(w == "" for w in part):
                break
    return total


def is_copy(question: list[str], answer: list[str]) -> bool:
    """Whether the answer holds the question, perhaps restyled or repeated, and nothing else."""
    if not question or not answer:
        return False
    known = set(question)
    core = list(answer)
    while core and core[0] in LABELS and core[0] != question[0]:
        core.pop(0)
    while core and core[-1] in LABELS and core[-1] not in known:
        core.pop()
    # Tiles are made of words that both hold.
    if len(core) < 0.7 * len(question) or sum(w in known for w in core) < 0.8 * len(core):
        return False
    strange = sum(w not in known and w not in LABELS and len(w) > 3 for w in core)
    return covered(core, question) >= 0.8 * len(core) and strange <= 0.1 * len(core) or strange == 0 and sum(n for _, _, n in tiles(question, core[: 4 * len(question)])) >= 0.6 * len(question)


class _Grammar:
    def __init__(self) -> None:
        self.whole: dict[str, set[str]] = {}
        self.stems: list[tuple[str, str]] = []
        for k, line in GRAMMAR.items():
            for w in line.split():
                if w.endswith("*"):
                    self.stems.append((w[:-1], k))
                else:
                    self.whole.setdefault(w, set()).add(k)
        self.seen: dict[str, frozenset[str]] = {}

    def of(self, w: str) -> frozenset[str]:
        got = self.seen.get(w)
        if got is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            got = self.seen[w] = frozenset(self.whole.get(w, set()) | {k for s, k in self.stems if w.startswith(s)})
        return got


_grammar = _Grammar()


def denies(sentence: str, asked: set[str]) -> bool:
    """Whether one sentence denies to know, to say or to hold something, and says little else before the complement."""
    for clause in _CLAUSE.split(sentence):
        w = words(clause.replace("n't", " not"))
        here = [_grammar.of(x) for x in w]
        if not any("NOT" in c for c in here):
            continue
        no = next(i for i, c in enumerate(here) if "NOT" in c)
        know = next((i for i, c in enumerate(here) if "KNOW" in c), None)
        if know is None and not (set(w) & SELF_SUFFICIENT):
            continue
        end = max(no, know if know is not None else no) + 1
        while end < len(w) and w[end] not in COMPLEMENT:
            end += 1
        subject = set().union(*here[:end])
        if not subject & {"SELF", "SOURCE", "THIS"} and no > 0:
            rest = set().union(*here[end:]) if end < len(w) else set()
            if "SOURCE" not in rest:
                continue
        strange = sum(not c and x not in FUNCTION and x not in asked and x not in COMPLEMENT for x, c in zip(w[:end], here[:end]))
        if strange <= STRANGE * end:
            return True
    return False


#: Denials that need no word of knowing.
SELF_SUFFICIENT = set("silent decline declined refuse refrain abstain unaware unsure undocumented outside beyond außerstande".split())


def is_refusal(text: str, golden: str | None = None, question: str | None = None) -> bool:
    """Whether the text declines and tells nothing.

    Every sentence declines or is a short courtesy; or, where there is a golden answer, the first one declines and what follows
    holds hardly any of the golden answer's words that the question doesn't hold.
    """
    t = re.sub(r"`[^`\n]*`", " ", text).replace("’", "'").lower()
    parts = sentences(t)
    if not parts:
        return False
    asked = set(words(question or ""))
    hits = [denies(p, asked) for p in parts[:2]]
    if not any(hits) or not hits[0] and len(words(parts[0])) > 4:
        return False
    hits += [denies(p, asked) for p in parts[2:]]
    if all(h or len(words(p)) <= 12 and any("THIS" in _grammar.of(w) or "SELF" in _grammar.of(w) for w in words(p)) for h, p in zip(hits, parts)) and not golden:
        return True
    told = {w for w in words(golden or "") if len(w) > 3 and w not in FUNCTION and w not in COMPLEMENT and not _grammar.of(w)}.difference(asked)
    return all(hits) or bool(told) and len(told.intersection(words(text))) <= GOLDEN_TOLD * len(told)


@lru_cache(4096)
def _declining(golden: str) -> bool:
    """Whether a golden answer declines: its sentences all do."""
    parts = sentences(re.sub(r"`[^`\n]*`", " ", normal(golden)).replace("’", "'").lower())
    return bool(parts) and all(denies(p, set()) for p in parts)


@lru_cache(4096)
def _golden_words(golden: str) -> tuple[tuple[str, ...], ...]:
    return tuple(tuple(words(s)) for s in sentences(normal(golden)))


def ends_early(answer: str, parse: Parse, golden: str) -> bool:
    """Whether the answer breaks off: something is open at its end, or its last sentence has neither an end mark nor the end of one of the golden sentences."""
    if parse.open:
        return True
    text = answer.rstrip()
    tail = text.rstrip("*_\"'”») ")
    if tail.endswith("…") or tail.endswith("..."):
        return True
    if parse.tail in ("code", "table", "nothing"):
        return False
    prose = parse.prose.rstrip()
    if _END.search(prose):
        return False
    last = (sentences(prose) or [""])[-1]
    if parse.tail == "item":
        body = ITEM.sub("", last.split("\n")[-1]).strip()
        if re.fullmatch(r"`[^`]+`|\S+", body):
            return False
    w = words(last)
    if not w:
        return False
    best: tuple[float, bool] = (0.0, False)
    for g in _golden_words(golden):
        near = w[-2 * len(g) :]
        marked = tiles(near, list(g))
        share = sum(n for _, _, n in marked) / min(len(near), len(g))
        if share > best[0]:
            i, j, n = max(marked)
            # Where the last tile ends, the answer must have as many words left as the golden sentence, and not end within a word of it.
            here, there = len(near) - i - n, len(g) - j - n
            within = there >= here > 0 and near[-1] != g[j + n + here - 1] and g[j + n + here - 1].startswith(near[-1])
            # Few words tell something only where the tile reaches their end.
            if len(w) >= LEAST_PROSE or here == 0 or within:
                best = (share, here >= there and not within)
    if best[0] >= 0.5:
        return not best[1]
    if w[-1] in _OPEN_WORDS:
        return True
    return len(words(parse.plain)) >= LEAST_PROSE


def in_another_language(profiles: Profiles, asked: str | None, plain: str) -> bool:
    """Whether most of the text, by sentences, is in another language than the one asked in."""
    if asked is None:
        return False
    foreign = whole = 0
    for s in sentences(plain):
        n = len(words(s))
        whole += n
        foreign += n if profiles.other(asked, s) else 0
    return foreign >= 0.7 * whole > 0 or whole > 0 and foreign >= 0.5 * whole and profiles.other(asked, plain)


class Judge:
    """Tells the defect of pairs; what is found of a question is kept."""

    def __init__(self, profiles: Profiles | None = None) -> None:
        self.profiles = profiles or Profiles({})
        self.asked: dict[str, str | None] = {}

    def language_of(self, question: str) -> str | None:
        if question not in self.asked:
            if len(self.asked) > 100_000:
                self.asked.clear()
            self.asked[question] = self.profiles.language(Parse(normal(question)).plain, ASKED_MARGIN)
        return self.asked[question]

    def defect(self, question: str | None, golden: str | None, answer: str | None) -> str | None:
        """The defect of one pair, None for a proper answer.

        A NULL answer is empty. Without a question nothing is a copy and no language is wrong; without a golden answer a refusal counts as one.
        """
        text = normal(answer)
        bare = words(_TAG.sub(" ", text))
        if not bare or VOID.issuperset(bare):
            return EMPTY
        if is_copy(words(question or ""), bare):
            return COPY
        if is_refusal(text, golden, question):
            return None if golden and _declining(golden) else REFUSAL
        parse = Parse(text)
        if in_another_language(self.profiles, self.language_of(question or ""), parse.plain):
            return LANGUAGE
        if ends_early(text, parse, golden or ""):
            return TRUNCATED
        return None


def flag_pairs(df: DataFrame, key: str, question: str, golden: str, answer: str, profiles: Profiles | None = None) -> DataFrame:
    """(key, defect): the rows whose answer is no proper answer to the question, with the type of the defect.

    Equal rows give equal results; a NULL or empty answer is empty; rows with a NULL key come out with it; an empty table gives none; extra columns are ignored.
    A golden answer that declines makes a declining answer right. Without ``profiles`` no language is wrong but by its script.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("defect", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles)
        for b in batches:
            found = [judge.defect(q, g, a) for q, g, a in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, type=pa.string())], names=[key, "defect"])

    return df.select(F.col(key), F.col(question).alias("q__"), F.col(golden).alias("g__"), F.col(answer).alias("a__")).mapInArrow(run, schema).where("defect IS NOT NULL")
