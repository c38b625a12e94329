"""Scores for abusive, hateful or sexually explicit language by two Kneser-Ney models.

One model is fitted to phrases of such language, one to ordinary phrases. A phrase's score is the difference of their
log-likelihoods by length; a document's score is that of its worst phrase, so one sentence among many counts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled rows that the models are fitted to; they are picked by a hash of the document's id.
SAMPLE = 12_000
#: n-gram length, discount, rounds of relabelling, least number of phrases a word must occur in.
ORDER, DISCOUNT, TURNS, RARE = 3, 0.75, 4, 3
#: Added to a phrase's length, so that one odd word alone makes no high score.
PAD = 1.0
#: Score above which a phrase counts as toxic while the models are fitted.
LEAST = 0.5
#: A phrase in at least so many clean texts for each toxic one is ordinary; labels are wrong less often than that.
PLAIN = 0.25
#: Phrases, by their text and by their words, that a worker remembers the scores of.
REMEMBERED = 400_000
TOXIC = ("abusive", "hateful", "sexual")

# Letters of other scripts that look like Latin ones, and characters that stand for letters.
LOOKALIKES = str.maketrans("абвеёкмнорстухіјѕԁӏԛѡαβεικνορτυχ", "abbeekmhopctyxijsdiqwabeiknoptux")
STAND_INS = str.maketrans("013457@$!|€", "oieastasiie")
_INVISIBLE = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF])

_SPACED = re.compile(r"(?<![^\W\d_])[^\W\d_](?: [^\W\d_]){3,}(?![^\W\d_])")
_DOTTED = re.compile(r"(?<!\w)[^\W\d_]{1,2}(?:[.\-_·•][^\W\d_]{1,2}){2,}(?!\w)")
# What any text with letters set apart holds, found faster than the whole of it.
_MAYBE_SPACED = re.compile(r" [^\W\d_] [^\W\d_] ")
_MAYBE_DOTTED = re.compile(r"[.\-_·•][^\W\d_]{1,2}[.\-_·•]")
_PHRASE_END = re.compile(r"[.!?;:,)]+(?=\s|$)|[\n\r\"“”„«»()]+|\s[-–—]+\s|\.{3,}|…")
_WORD = re.compile(r"\d+(?:[.,]\d+)+|[^\W_][\w@$!|*€'’]*[^\W_]|[@$][^\W_][\w@$!|*€]*|[^\W_]")
_MARKED = re.compile(r"[0-9@$!|€*]")
_NUMERIC = re.compile(r"[\d.,]+(?:st|nd|rd|th|s|x|m|k|bn|mm|bps?|am|pm)?|q[1-4]|h[12]|fy\d+|[$€]\d[\d.,]*[a-z]{0,2}")
_RUN = re.compile(r"([^\W\d_])\1+")


def clean(text: str) -> str:
    """Compatibility forms, invisible characters, look-alikes and letters set apart brought back to plain words."""
    text = unicodedata.normalize("NFKC", text).translate(_INVISIBLE).casefold()
    if not text.isascii():
        text = text.translate(LOOKALIKES)
    if _MAYBE_SPACED.search(text):
        text = _SPACED.sub(lambda m: m[0].replace(" ", ""), text)
    if _MAYBE_DOTTED.search(text):
        text = _DOTTED.sub(lambda m: re.sub(r"[.\-_·•]", "", m[0]), text)
    return text


def word(raw: str) -> str:
    """A word as the models see it: numbers as one, stand-ins as letters, repeated letters once."""
    if _MARKED.search(raw):
        if _NUMERIC.fullmatch(raw):
            return "#"
        if raw.isdigit():
            return "#"
        raw = raw.translate(STAND_INS)
    return _RUN.sub(r"\1", raw.replace("’", "'"))


@lru_cache(maxsize=200_000)
def _words(chunk: str) -> tuple[str, ...]:
    return tuple(word(w) for w in _WORD.findall(chunk))


def parts(text: str | None) -> list[str]:
    """A cleaned text cut where phrases end."""
    return _PHRASE_END.split(clean(text)) if text else []


def words_of(part: str) -> tuple[str, ...]:
    return tuple(chain.from_iterable(map(_words, part.split())))


def phrases(text: str | None) -> list[tuple[str, ...]]:
    """The phrases of a text, as words; a text without words has none."""
    return [words for part in parts(text) if (words := words_of(part))]


@dataclass
class KneserNey:
    """Interpolated Kneser-Ney of weighted phrases; the shared backoff gives the lowest order."""

    shared: dict[str, float]
    unknown: float
    counts: list[dict[tuple[str, ...], float]] = field(default_factory=list)
    totals: list[dict[tuple[str, ...], float]] = field(default_factory=list)
    kinds: list[dict[tuple[str, ...], float]] = field(default_factory=list)

    def fit(self, weighted: Iterable[tuple[tuple[str, ...], float]]) -> KneserNey:
        full: dict[tuple[str, ...], float] = defaultdict(float)
        for words, weight in weighted:
            padded = ("<s>",) * (ORDER - 1) + words + ("</s>",)
            for i in range(len(padded) - ORDER + 1):
                full[padded[i : i + ORDER]] += weight
        levels = [full]
        for _ in range(ORDER - 1):  # how many different words come before
            lower: dict[tuple[str, ...], float] = defaultdict(float)
            for gram, weight in levels[-1].items():
                lower[gram[1:]] += min(1.0, weight)
            levels.append(lower)
        for level in levels:
            total: dict[tuple[str, ...], float] = defaultdict(float)
            kind: dict[tuple[str, ...], float] = defaultdict(float)
            for gram, weight in level.items():
                total[gram[:-1]] += weight
                kind[gram[:-1]] += min(DISCOUNT, weight)
            self.counts.append(dict(level))
            self.totals.append(dict(total))
            self.kinds.append(dict(kind))
        return self

    def probability(self, gram: tuple[str, ...]) -> float:
        p = self.shared.get(gram[-1], self.unknown)
        for level in range(ORDER - 1, -1, -1):
            key = gram[level:]
            total = self.totals[level].get(key[:-1])
            if total:
                own = self.counts[level].get(key, 0.0)
                p = (max(own - DISCOUNT, 0.0) + self.kinds[level][key[:-1]] * p) / total
        return p


@dataclass
class Model:
    """Both models, their words, words by their letters but vowels, and the score from which a document is found."""

    toxic: KneserNey
    ordinary: KneserNey
    vocabulary: frozenset[str]
    masked: dict[str, str]
    threshold: float
    ratios: dict[tuple[str, ...], float] = field(default_factory=dict)

    def known(self, words: tuple[str, ...]) -> tuple[str, ...]:
        out = []
        for w in words:
            if "*" in w:
                w = self.masked.get(mask(w), w)
            out.append(w if w in self.vocabulary else "<?>")
        return tuple(out)

    def phrase(self, words: tuple[str, ...]) -> float:
        known = self.known(words)
        padded = ("<s>",) * (ORDER - 1) + known + ("</s>",)
        total = 0.0
        for i in range(len(padded) - ORDER + 1):
            gram = padded[i : i + ORDER]
            ratio = self.ratios.get(gram)
            if ratio is None:
                ratio = self.ratios[gram] = math.log(self.toxic.probability(gram) / self.ordinary.probability(gram))
            total += ratio
        return total / (len(known) + 1 + PAD)

    def score(self, text: str | None, memory: dict[str | tuple[str, ...], float] | None = None) -> float:
        """Score of the worst phrase. ``memory`` holds scores by text and by words, so a phrase is scored once."""
        memory = {} if memory is None else memory
        worst = -math.inf
        for part in parts(text):
            s = memory.get(part)
            if s is None:
                if len(memory) > REMEMBERED:
                    memory.clear()
                words = words_of(part)
                s = memory.get(words)
                if s is None:
                    s = memory[words] = self.phrase(words) if words else -math.inf
                memory[part] = s
            if s > worst:
                worst = s
        return worst


def mask(w: str) -> str:
    """A word with its vowels and asterisks as asterisks."""
    return re.sub(r"[aeiou*]+", "*", w)


def _models(rows: dict[tuple[str, ...], list[float]]) -> tuple[KneserNey, KneserNey]:
    shared: dict[str, float] = defaultdict(float)
    seen: set[tuple[str, str]] = set()
    for words in rows:
        before = "<s>"
        for w in (*words, "</s>"):
            if (before, w) not in seen:
                seen.add((before, w))
                shared[w] += 1.0
            before = w
    total = sum(shared.values()) + len(shared) + 1
    base = {w: (n + 0.5) / total for w, n in shared.items()}
    return tuple(KneserNey(base, 0.5 / total).fit((words, c[k]) for words, c in rows.items() if c[k] > 0) for k in (0, 1))  # type: ignore[return-value]


def fit(texts: list[str], labels: list[bool]) -> Model:
    """Fit both models to texts that are labelled as a whole, some of them wrongly.

    Which phrase of a toxic text is toxic isn't known. Phrases start with their odds between toxic and ordinary texts.
    Then the texts are halved; models of one half score the phrases of the other, so no phrase vouches for itself. In
    a toxic text the phrases that score toxic count as such, all others as ordinary, and so do all that clean texts hold
    often enough; phrases that score toxic and are far more frequent in toxic texts don't count as ordinary even in texts labelled clean. After some turns both models are
    fitted to all. The threshold is the one best by F1 on the scores of the last turn, each from the other half.
    """
    read = [phrases(t) for t in texts]
    spread: dict[str, int] = defaultdict(int)
    in_toxic: dict[str, int] = defaultdict(int)
    for ps, toxic in zip(read, labels):
        for w in {w for p in ps for w in p}:
            spread[w] += 1
            in_toxic[w] += toxic
    vocabulary = frozenset(w for w, n in spread.items() if n >= RARE and "*" not in w)
    loose: dict[str, set[str]] = defaultdict(set)
    for w in vocabulary:
        if len(w) >= 4:
            loose[mask(w)].add(w)
    masked = {m: max(sorted(ws), key=lambda w: in_toxic[w] / (spread[w] + 5)) for m, ws in loose.items()}
    model = Model(None, None, vocabulary, masked, 0.0)  # type: ignore[arg-type]
    docs = [sorted({model.known(p) for p in ps}) for ps in read]
    n_toxic, n_clean = max(1, sum(labels)), max(1, len(labels) - sum(labels))
    here: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0.0, 0.0])
    for ps, toxic in zip(docs, labels):
        for p in ps:
            here[p][0 if toxic else 1] += 1
    plain = {p for p, (a, b) in here.items() if b and b >= PLAIN * a}
    score = [{p: LEAST + 1 if here[p][0] / n_toxic > 8 * here[p][1] / n_clean else 0.0 for p in here}] * 2
    for turn in range(TURNS + 1):
        rows: list[dict] = [defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0.0, 0.0])]
        for k, (ps, toxic) in enumerate(zip(docs, labels)):
            for p in ps:
                s = score[k % 2][p]
                if s <= LEAST or p in plain:
                    rows[k % 2][p][1] += 1
                elif toxic:
                    rows[k % 2][p][0] += 1
                elif here[p][0] / n_toxic <= 4 * here[p][1] / n_clean:
                    rows[k % 2][p][1] += 1
        if turn == TURNS:
            break
        score = [{}, {}]
        for half in (0, 1):
            model.toxic, model.ordinary = _models(rows[half])
            model.ratios.clear()
            score[1 - half] = {p: model.phrase(p) for p in {p for ps in docs[1 - half :: 2] for p in ps}}
    for p, (a, b) in rows[1].items():
        rows[0][p][0] += a
        rows[0][p][1] += b
    model.toxic, model.ordinary = _models(rows[0])
    model.ratios.clear()
    model.threshold = _threshold([(max((score[k % 2][p] for p in ps), default=-math.inf), x) for k, (ps, x) in enumerate(zip(docs, labels))])
    return model


def _threshold(held: list[tuple[float, bool]]) -> float:
    held = sorted(held, key=lambda r: -r[0])
    positives, hits, best, at = sum(x for _, x in held), 0, 0.0, math.inf
    for n, (s, x) in enumerate(held, 1):
        hits += x
        following = held[n][0] if n < len(held) else -math.inf
        f1 = 2 * hits / (n + positives) if positives else 0.0
        if f1 > best and math.isfinite(s) and following < s:
            best, at = f1, (s + following) / 2 if math.isfinite(following) else s
    return at


def labelled(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> pd.DataFrame:
    """At most ``sample`` reviewed documents with their verdict by the latest review (then the greatest label_id)."""
    verdict = F.lower(F.trim("verdict"))
    rows = labels.filter(verdict.isin("clean", *TOXIC)).dropna(subset=["doc_id"])
    rows = rows.groupBy("doc_id").agg(F.max(F.struct("reviewed_at", "label_id", verdict.alias("v"))).alias("r"))
    rows = rows.select("doc_id", (F.col("r.v") != "clean").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` ids, so their size has a bound.
    found = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(rows), "doc_id")
    return found.toPandas().sort_values("doc_id")


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Models fitted to the labelled sample; without usable labels every document scores zero and none is found."""
    rows = labelled(documents, labels, sample)
    return fit(rows["text"].tolist(), rows["toxic"].astype(bool).tolist())


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with ``score`` (null for texts without words) and ``found``.

    All other columns are kept; columns of these names are replaced. Whole texts are read. The model is sent to the
    executors once; its size is bounded by the labelled sample.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted, memory = held.value, {}
        for texts in batches:
            yield pd.Series([fitted.score(t, memory) if t else -math.inf for t in texts], dtype=np.float64)

    out = documents.drop("score", "found").withColumn("score", score("text"))
    out = out.withColumn("score", F.when(F.col("score") > float("-inf"), F.col("score")))
    return out.withColumn("found", F.coalesce(F.col("score") >= model.threshold, F.lit(False)))
