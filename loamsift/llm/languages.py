"""The language of a text by character n-gram profiles, trained on a bounded sample of labelled rows."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import words

#: Labelled rows of each language that a profile is made of, and how much of each is read.
SAMPLE, SAMPLE_CHARS = 200, 2000
#: Languages of fewer labelled rows have no profile.
LEAST_ROWS = 3
ORDERS = (1, 2, 3, 4)
#: By how much, as a natural logarithm, a text must speak for one language rather than another.
MARGIN = 4.0


class Profiles:
    """Naive Bayes over the n-grams of words, with their ends. Unknown n-grams count alike in all languages."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.names = sorted(texts)
        counts = [[Counter() for _ in ORDERS] for _ in self.names]
        for c, k in zip(counts, self.names):
            # Each word counts by the root of how often it comes, so that a few frequent names don't make up a profile.
            for w, n in Counter(w for t in texts[k] for w in words(t) if not any(map(str.isdigit, w))).items():
                for at, o in enumerate(ORDERS):
                    for g in self.grams(w, o):
                        c[at][g] += math.sqrt(n)
        self.total = [[sum(c.values()) + 1 for c in per] for per in counts]
        self.size = [len(set().union(*(per[at] for per in counts))) + 1 if counts else 1 for at in range(len(ORDERS))]
        self.counts = counts
        self.seen: dict[str, tuple[float, ...]] = {}

    @staticmethod
    def grams(word: str, order: int) -> list[str]:
        w = f" {word} "
        return [w[i : i + order] for i in range(len(w) - order + 1)] if order > 1 else list(word)

    def word(self, w: str) -> tuple[float, ...]:
        """What a word says for each language; nothing with digits or of uncommon length."""
        got = self.seen.get(w)
        if got is None:
            out = []
            if len(w) >= 30 or any(map(str.isdigit, w)):
                return (0.0,) * len(self.names)
            for per, total in zip(self.counts, self.total):
                s = 0.0
                for at, o in enumerate(ORDERS):
                    gs = self.grams(w, o)
                    s += sum(math.log((per[at][g] + 0.5) / (total[at] + 0.5 * self.size[at])) for g in gs) / max(1, len(gs))
                out.append(s)
            if len(self.seen) > 200_000:
                self.seen.clear()
            got = self.seen[w] = tuple(out)
        return got

    def scores(self, text: str) -> dict[str, float]:
        """How much the text speaks for each language; one in another script than the Latin one speaks for that only."""
        script = other_script(text)
        if script:
            return {script: 100.0, **{k: 0.0 for k in self.names}}
        seen = self.seen
        each = [seen[w] if w in seen else self.word(w) for w in words(text)]
        return dict(zip(self.names, map(sum, zip(*each)))) if each else dict.fromkeys(self.names, 0.0)

    def language(self, text: str, margin: float = MARGIN) -> str | None:
        """The language of the text, None where too little tells."""
        best = sorted(self.scores(text).items(), key=lambda x: -x[1])
        return best[0][0] if len(best) > 1 and best[0][1] - best[1][1] >= margin else None

    def other(self, asked: str, text: str) -> bool:
        """Whether the text speaks for some language clearly rather than for the one asked in."""
        s = self.scores(text)
        return bool(s) and max(s.values()) - s.get(asked, 0.0) >= MARGIN


def other_script(text: str) -> str | None:
    """The script of most letters, if it isn't the Latin one."""
    if not text or max(text) < "ɐ":
        return None
    foreign = [ch for ch in text if ch >= "ɐ" and ch.isalpha() and not "Ḁ" <= ch < "ἀ"]
    if len(foreign) * 2 <= sum(map(str.isalpha, text)):
        return None
    return Counter(unicodedata.name(ch, "?").split(" ")[0].lower() for ch in foreign).most_common(1)[0][0]


def train(df: DataFrame, text: str, lang: str, sample: int = SAMPLE) -> Profiles:
    """Profiles of the languages named in ``lang``, each of at most ``sample`` labelled texts, the same ones for the same rows."""
    rows = df.where(F.col(lang).isNotNull() & (F.length(F.trim(text)) > 0)).select(F.col(lang).alias("k"), F.substring(text, 1, SAMPLE_CHARS).alias("t"))
    few = rows.withColumn("h", F.xxhash64("t")).withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("h"))).where(F.col("r") <= sample)
    got: dict[str, list[str]] = {}
    for r in few.select("k", "t").collect():
        got.setdefault(r[0], []).append(r[1])
    return Profiles({k: v for k, v in got.items() if len(v) >= LEAST_ROWS})
