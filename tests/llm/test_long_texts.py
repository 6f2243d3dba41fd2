"""Texts of very many matches and of endless runs: the same results as plain patterns, in time that grows with the text."""

import random
import re
import time

import pyarrow as pa

from weft.llm import pii, toxicity

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_patterns_are_those_of_the_contract():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("ab@@._-1 ") for _ in range(rng.randint(1, 24)))
        assert [s for s in pii.base_spans(text) if s[2] == "email"] == [(*m.span(), "email") for m in EMAIL.finditer(text)]
        text = "".join(rng.choice("12.. a") for _ in range(rng.randint(1, 20)))
        assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in IP.finditer(text)]


def test_endless_runs():
    began = time.time()
    for text in ("1" * 10**6, "@" + "a" * 10**6, "a.b" * 400_000 + "@", "1." * 500_000, "@" * 300_000 + "a" * 10**6, "+1" + "(" * 10**6, "1 " * 500_000, "a@" * 500_000):
        pii.base_spans(text)
    assert time.time() - began < 60


def test_very_many_matches():
    lexicon = toxicity.Lexicon()
    term = next(iter(lexicon.weights))
    automaton = lexicon.automaton()
    few = toxicity.search(lexicon, automaton, pa.array([f"{term} and {term} "], pa.string()))[0]
    began = time.time()
    many, again = toxicity.search(lexicon, automaton, pa.array([f"{term} and {term} " * 50_000, f"{term} and {term} "], pa.string()))
    assert time.time() - began < 60
    assert len(few["matches"]) == 2 and len(many["matches"]) == 100_000 and again == few
    assert all(a["end"] <= b["start"] for a, b in zip(many["matches"], many["matches"][1:]))


def test_overlaps_and_exceptions_as_before():
    """Of overlapping matches the heaviest counts, then the shortest; none inside an exception."""
    lexicon = toxicity.Lexicon()
    terms, phrases = list(lexicon.weights)[:40], list(lexicon.exceptions)[:20]
    rng = random.Random(2)
    texts = [" ".join(rng.choice([rng.choice(terms), rng.choice(phrases) if phrases else "x", "and", "x"]) for _ in range(30)) for _ in range(100)]
    found = toxicity.search(lexicon, lexicon.automaton(), pa.array(texts, pa.string()))
    one = [toxicity.search(lexicon, lexicon.automaton(), pa.array([t], pa.string()))[0] for t in texts]
    assert found == one
    for text, told in zip(texts, found):
        for m in told["matches"]:
            covers = [(p.start(), p.end()) for phrase in phrases for p in re.finditer(rf"(?<![a-z0-9]){re.escape(phrase)}(?![a-z0-9])", text)]
            assert not any(a <= m["start"] and m["end"] <= b for a, b in covers)
