"""Toxicity: a weighted lexicon matched by Aho-Corasick.

A text is folded character by character (case, accents, homoglyphs, digits and signs that stand
for letters; marks and characters without width are passed over), and each folded character knows its place, so a match does. Terms count as whole words,
also where blanks or signs stand between all their letters; a match inside an exception phrase
does not count. The weights of the matches, as a sum and normalised by the text's length, give a score between 0 and
1. Weights and the two coefficients are fitted to labelled rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import bounded_sample, cut, with_struct

#: Insults of the starting lexicon, and phrases in which their words are no insult.
SEED_TERMS = """
idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile imbeciles cretin dimwit halfwit
loser losers pathetic worthless scum scumbag trash clown clowns disgusting filth vermin garbage
asshole bastard bitch bullshit crap jackass jerk slut whore wanker twat prick
pig pigs freak freaks creep creeps
abruti connard salaud imbecile cretin ordure
arschloch dummkopf trottel schwachkopf abschaum
gilipollas estupido estupida cabron imbecil
""".split()
EXCEPTION_PHRASES = [
    "trash can", "trash cans", "trash bin", "trash bag", "trash bags", "trash collection", "take out the trash",
    "clown fish", "clown car", "circus clown", "birthday clown", "garbage collection", "garbage collector", "garbage can",
    "guinea pig", "guinea pigs", "pig iron", "jerk chicken", "jerk seasoning", "pond scum", "soap scum",
    "sore loser bracket", "pigs in blankets", "prick of a needle",
]
#: Characters that look like a letter, by letter.
LOOKALIKES = {
    "a": "@4аαɑ", "b": "8ЬвƄ", "c": "сϲ¢", "d": "ԁɗ", "e": "3еεє€", "g": "9ɡ", "h": "һн", "i": "1!|іι¡", "j": "ј", "k": "кκ",
    "l": "ӏ", "m": "м", "n": "пηո", "o": "0оοσ", "p": "рρ", "q": "ԛ", "r": "гʀ", "s": "5$ѕ", "t": "7тτ+", "u": "υцս", "v": "ѵν", "w": "ԝω",
    "x": "хχ×", "y": "уγ", "z": "2ʐ",
}

HELD_OUT = 2
#: Labelled rows that the weights are fitted to, at most; which ones is decided by a hash of doc_id.
TRAINING_ROWS = 20_000
THRESHOLD = 0.3
#: Word stems that are looked for in toxic training rows without a known term: their lengths, the rows that must have
#: one (and the share of those rows), and the share of the training rows with it that must be toxic.
STEM_LENGTHS, STEM_ROWS, STEM_SHARE, STEM_PRECISION = (4, 5, 6), 4, 0.005, 0.8
#: Letters in a row, each by itself, that are read as spelled-out words.
SPELLED = 4


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Code point -> folded byte; 0x7F for what folds to nothing known, 0 for what is passed over."""
    table = np.full(0x110000, 0x7F, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Mn", "Me", "Cf"):
            table[code] = 0
        elif code < 128 or unicodedata.decomposition(c):
            base = unicodedata.normalize("NFKD", c)[:1].lower()
            if base.isascii():
                table[code] = ord(base) or 0x7F
    for code in [*range(9, 14), 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x3000]:
        table[code] = 32
    for letter, like in LOOKALIKES.items():
        for c in like + like.upper():
            if not (c.isascii() and c.isalpha()):
                table[ord(c)] = ord(letter)
    return table


@lru_cache(maxsize=1)
def _inside_word() -> np.ndarray:
    """Letters and digits, before folding."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool)


@dataclass
class Lexicon:
    """Term -> weight, stem of words -> weight, exception phrases and the coefficients of the score."""

    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEED_TERMS, 4.0))
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTION_PHRASES))
    coefficients: tuple[float, float, float] = (-3.0, 2.0, 0.5)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for stem, weight in self.stems.items():
            found.add_word(stem, (len(stem), weight, True))
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight, False))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None, False))
        found.make_automaton()
        return found

    def features(self, weight, n_words):
        """Weight of the matches as it is, and for each hundred words of a text to which twenty are added."""
        return np.log1p(weight), np.log1p(100 * np.asarray(weight) / (np.asarray(n_words) + 20))

    def score(self, weight, n_words):
        plain, dense = self.features(weight, n_words)
        a, b, c = self.coefficients
        return 1 / (1 + np.exp(-(a + b * plain + c * dense)))


def search(lexicon: Lexicon, automaton, texts: pa.Array) -> list[dict]:
    """Matches, their total weight, words and score of each text."""
    out = []
    for _, part in tb.slices(texts):
        first = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        raw = part.buffers()[2].slice(int(first[0]), int(first[-1] - first[0])).to_pybytes() if first[-1] > first[0] else b""
        data = np.frombuffer(raw, np.uint8)
        own = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), first - first[0])
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        folded = _folding()[points]
        place = np.flatnonzero(folded)  # of each folded character, among all
        zero, own = own, np.searchsorted(place, own)
        points, folded = points[place], folded[place]
        blank = np.append(folded == 32, True)
        begins = np.append(True, blank[:-1][: len(points)]) if len(points) else np.zeros(1, bool)
        begins = begins[: len(points)].copy()
        begins[own[:-1][own[:-1] < len(points)]] = True
        n_words = np.diff(np.append(0, np.cumsum(begins & ~blank[:-1]))[own]) if len(points) else np.zeros(len(part), int)
        matches: list[list[tuple[int, int, float]]] = [[] for _ in range(len(part))]
        inside = _inside_word()[points]
        hits = [
            (end + 1 - length, end + 1, weight, stem)
            for end, (length, weight, stem) in automaton.iter(folded.tobytes().decode("latin-1"))
        ]
        spelled = _spelled(automaton, folded, inside, own)
        if hits or spelled:
            rows = np.searchsorted(own, [h[0] for h in hits], "right") - 1
            reach = np.zeros(len(points) + 1, np.int64)  # by place, the furthest end of the exceptions that begin there
            whole = [(int(np.searchsorted(own, start, "right")) - 1, start, end, weight) for start, end, weight in spelled]
            for row, (start, end, weight, stem) in zip(rows.tolist(), hits):
                low, high = own[row], own[row + 1]
                if end > high or start > low and inside[start - 1] or not stem and end < high and inside[end]:
                    continue
                if weight is None:
                    reach[start] = max(reach[start], end)
                else:
                    whole.append((row, start, end, weight))
            # Of overlapping matches the heaviest counts, then the shortest.
            reach = np.maximum.accumulate(reach)
            taken = bytearray(len(points))
            for row, start, end, weight in sorted(whole, key=lambda h: (h[0], -h[3], h[2] - h[1], h[1])):
                if end <= reach[start] or 1 in taken[start:end]:
                    continue
                taken[start:end] = b"\1" * (end - start)
                matches[row].append((start, end, weight))
            for found in matches:
                found.sort()
        totals = np.array([sum(w for *_, w in m) for m in matches])
        scores = lexicon.score(totals, n_words)
        for row, found in enumerate(matches):
            out.append(
                {
                    "score": float(scores[row]),
                    "weight": float(totals[row]),
                    "n_words": int(n_words[row]),
                    "matches": [
                        {
                            "term": folded[s:e].tobytes().decode("latin-1"),
                            "start": int(place[s] - zero[row]),
                            "end": int(place[e - 1] + 1 - zero[row]),
                            "weight": w,
                        }
                        for s, e, w in found
                    ],
                }
            )
    return out


def _spelled(automaton, folded: np.ndarray, inside: np.ndarray, own: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, weight) of terms whose letters stand one by one, with one other character between each two."""
    n = len(folded)
    if n < 2 * SPELLED - 1:
        return []
    edge = np.zeros(n + 1, bool)
    edge[own] = True
    before = np.append(True, ~inside[:-1]) | edge[:-1]
    after = np.append(~inside[1:], True) | edge[1:]
    single = np.flatnonzero(inside & before & after)
    text = np.searchsorted(own, single, "right")
    joins = (np.diff(single) == 2) & (text[1:] == text[:-1])
    out = []
    for run in np.split(single, np.flatnonzero(~joins) + 1):
        if len(run) >= SPELLED:
            for end, (length, weight, stem) in automaton.iter(folded[run].tobytes().decode("latin-1")):
                if weight is not None and not stem and length >= SPELLED:
                    out.append((int(run[end + 1 - length]), int(run[end]) + 1, weight))
    return out


KIND = "struct<score:double,weight:double,n_words:long,matches:array<struct<term:string,start:long,end:long,weight:double>>>"


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``into``: score, weight, n_words and matches with code point places.

    Null and empty texts have no words and no matches and get the score of the intercept. Repeated rows score alike; a
    column named ``into`` is replaced. The lexicon is small and broadcast; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def work():
        automaton = shared.value.automaton()
        return lambda texts: search(shared.value, automaton, texts)

    return with_struct(docs, text, into, KIND, work)


def held_out(doc_id) -> F.Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Lexicon:
    """Lexicon with weights and coefficients fitted to at most ``rows`` labelled rows that are not held out.

    A term's weight is its smoothed log odds between toxic and clean rows. Stems of words that mark the toxic rows
    without a known term are added. Rows with a null label or doc_id are not used; with no toxic or no clean rows the starting
    lexicon is returned.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out(F.col("doc_id")))
    known = bounded_sample(known, rows, known.count(), "doc_id", "toxic")  # bounded, so it may be broadcast
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic"))
    if (found := sample.count()) > rows:  # a doc_id can stand on many rows
        sample = cut(bounded_sample(sample, rows, found, "doc_id", "text", "toxic").repartition(-(-rows // 500)))
    start = Lexicon()
    found = score(sample, start)
    terms = found.select("toxic", F.explode(F.array_distinct("toxicity.matches.term")).alias("term"))
    counts = {(r.term, r.toxic): r["count"] for r in terms.groupBy("term", "toxic").count().collect()}
    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return start

    def odds(in_bad: int, in_good: int) -> float:
        return math.log((in_bad + 0.5) / (bad + 1)) - math.log((in_good + 0.5) / (good + 1))

    seen = {term for term, _ in counts}
    weights = {t: max(0.0, odds(counts.get((t, 1), 0), counts.get((t, 0), 0))) if t in seen else 1.0 for t in SEED_TERMS}
    missed = found.filter("toxic = 1 AND size(toxicity.matches) = 0")
    stems = {s: odds(n, m) for s, n, m in _stems(missed, found.filter("toxic = 0"))}
    lexicon = Lexicon(weights={t: w for t, w in weights.items() if w > 0}, stems=stems)
    points = score(sample, lexicon).select("toxicity.weight", "toxicity.n_words", "toxic").toPandas()  # at most ``rows`` rows
    lexicon.coefficients = _logistic(lexicon, points)
    return lexicon


def _stems(missed: DataFrame, good: DataFrame) -> list[tuple[str, int, int]]:
    """(stem, toxic rows, clean rows) of word stems that mark the toxic rows ``missed``."""
    words = F.split(F.lower("text"), r"[^\p{L}]+")
    cuts = F.flatten(F.transform(words, lambda w: F.array(*[F.substring(w, 1, n) for n in STEM_LENGTHS])))
    stem = F.explode(F.array_distinct(F.filter(cuts, lambda s: F.length(s) >= STEM_LENGTHS[0]))).alias("stem")
    in_missed = missed.select(stem).groupBy("stem").agg(F.count("*").alias("n"))
    least = max(STEM_ROWS, STEM_SHARE * missed.count())
    in_good = good.select(stem).groupBy("stem").agg(F.count("*").alias("m"))
    few = in_missed.filter(F.col("n") >= least).join(in_good, "stem", "left").na.fill(0)
    few = few.filter(F.col("n") >= STEM_PRECISION * (F.col("n") + F.col("m") + 1))
    few = cut(few)  # each marks a share of a bounded number of rows, so they are few
    counts = {r.stem: (r.n, r.m) for r in few.collect()}
    # A greedy cover: each stem must mark rows that the stems before it do not.
    marked = missed.select(F.monotonically_increasing_id().alias("row"), stem).join(F.broadcast(few.select("stem")), "stem")
    own = marked.groupBy("row").agg(F.collect_set("stem").alias("stems")).collect() if counts else []
    open_rows, chosen = [set(r.stems) for r in own], []
    while open_rows:
        left = Counter(stem for row in open_rows for stem in row)
        best = max(left, key=lambda stem: (left[stem], len(stem), stem))
        if left[best] < least:
            break
        chosen.append((_folding()[np.frombuffer(best.encode("utf-32-le"), np.uint32)].tobytes().decode("latin-1"), *counts[best]))
        open_rows = [row for row in open_rows if best not in row]
    return chosen


def _logistic(lexicon: Lexicon, points) -> tuple[float, float, float]:
    """Newton's method for the ridge-regularised logistic regression on the two features."""
    x = np.column_stack([np.ones(len(points)), *lexicon.features(points["weight"].to_numpy(), points["n_words"].to_numpy())])
    y, beta = points["toxic"].to_numpy(), np.zeros(3)
    ridge = np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns from :func:`fit` and :func:`score`."""
    done = score(docs.select("doc_id", "text"), fit(docs, labels))
    return done.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("toxicity.matches").alias("n_matches"),
    )
