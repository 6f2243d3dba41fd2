"""Personal data: exact patterns, and a linear-chain conditional random field for what patterns miss.

The field reads word shapes. It is trained from a small labelled table (``TRAINING``) and decoded by Viterbi over
batches of word sequences in numpy. Every word of a text is read. A word in no run of words that could gain by
labels other than O, whatever the transitions, is O on the best path, so a text's path is that of the stretches between
such words.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import with_struct

#: Kinds of the patterns in the order of spans that start together; then the kinds that the field adds.
BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["secret", "contact"]
KINDS = BASE_KINDS + ADDED_KINDS

#: An address is looked for at each run of its first signs and a following @, an IP address only from the start of a run of digits: it is there, or nowhere in the run.
#: No run is gone through twice, so long ones take no longer than others of as many characters.
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]++(@?)"), re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Word sequences of about this many padded words are decoded together.
BATCH_WORDS = 1 << 14
#: Words, letters apart, whose scores a worker keeps.
KEPT_WORDS = 1 << 16

LABELS = ["O", "B-secret", "I-secret", "B-contact", "I-contact"]

#: The labelled table: a sequence a line, words as word/label (O where none is given). `{hex}`, `{key}`, `{num}`, `{name}`
#: and `{host}` stand for values drawn when the table is read.
TRAINING = """
the {name} of password={hex}/B-secret and the
in it password={hex}/B-secret is
for password: {hex}/B-secret on the
use passwd={key}/B-secret here
pwd={hex}/B-secret at
my password is {hex}/B-secret now
the secret={hex}/B-secret was
set token={hex}/B-secret for all
with api_key={key}/B-secret and
key AKIA{key}/B-secret in the
of AKIA{key}/B-secret that
on AKIA{key}/B-secret
AKIA{key}/B-secret the
this AKIA{key}/B-secret is AKIA{key}/B-secret too
reach {name}/B-contact (at)/I-contact {host}/I-contact (dot)/I-contact com/I-contact today
write to {name}/B-contact [at]/I-contact {host}/I-contact [dot]/I-contact org/I-contact and
mail {name}/B-contact at/I-contact {host}/I-contact dot/I-contact com/I-contact for more
ask {name}/B-contact (at)/I-contact {host}.com/I-contact about it
{name}/B-contact [at]/I-contact {host}.net/I-contact or
set token = "{sha}"/B-secret for all
token = "{sha}"/B-secret
TOKEN = "{SHA}"/B-secret OF
the secret = {hex}/B-secret in
with api_key = "{hex}"/B-secret and
of token: "{sha}"/B-secret the
on token="{sha}"/B-secret at
{name}. token = "{sha}"./B-secret {name}
PASSWORD={HEX}/B-secret THE
the commit "{sha}" was in
of commit {sha} and the
in revision "{sha}" the
hash = "{sha}" of
of "{sha}" and the
see "{sha}"
{name} | token = "{sha}"/B-secret | {name}
| token | "{sha}"/B-secret |
a token = of the
in the {num} of and
on {num}. of the
from {num} to {num} in
version {num}.{num} of the License.
CC BY-NC {num}.{num}. the
call +{num} ({num}) {num}-{num} or
{name}{num}@mail.{host}.com is the
at {num}.{num}.{num}.{num} the
card {num}{num}{num}{num} was
page={num} of the
ref={name} and
x={num} y={num}
the red dot on the map is
a dot com firm in
it is at the dot of
(at) least {num} of them
[at] the end of
#{num} in the list
{num}% of it = {num}
for password: {word}/B-secret on the
the password: {word}/B-secret
the password: {word}/B-secret {Name} {name}
{name} password: {word}/B-secret {Name} at
of password: {word}/B-secret {NAME} is
Password: {Word}/B-secret in
PASSWORD: {WORD}/B-secret THE
my password is {word}/B-secret now
so my password is {word}/B-secret
My password is {Word}/B-secret at
MY PASSWORD IS {WORD}/B-secret AND
password={word}/B-secret is
token = "{word}"/B-secret of
key {AKIA}/B-secret in the
of {AKIA}/B-secret that
{AKIA}/B-secret
{name} {AKIA}/B-secret {name}
{name} {name}/B-contact (at)/I-contact {host}/I-contact (dot)/I-contact com/I-contact {name}
Reach {Name}/B-contact (At)/I-contact {Host}/I-contact (Dot)/I-contact Com/I-contact Today
WRITE TO {NAME}/B-contact (AT)/I-contact {HOST}/I-contact (DOT)/I-contact COM/I-contact
{name}/B-contact [AT]/I-contact {host}/I-contact [DOT]/I-contact org/I-contact {name}
reach {name}/B-contact (at)/I-contact {host}/I-contact (dot)/I-contact {name}/I-contact
Ask {Name}/B-contact [At]/I-contact {Host}.com/I-contact about
the password is not the one
your password is too short
a password is needed and
the password: see the next page
a token of the {name} is in the
the secret is in the {word} of {name}
{name} {name} {name} {word} {name} {name}
{Name} {word} {name} {name}. {Name} {name}, {name} {WORD}
{NAME} {WORD} {NAME} {NAME}. {NAME} {WORD}
{Name} {Name} {Name} {Name} {Name} {Name} {Name} {Name} {Name} {Name}
{NAME} {NAME} {NAME} {NAME} {NAME} {NAME} {NAME} {NAME} {NAME} {NAME}
{name} {name} {name} {name} {name} {name} {name} {name} {name} {name}
at at at at at at at at at at
At At At At At At At At At At
is is is is is is is is is is my my my my my
to to to to to to to to is a is a is the is of at
{name} is a {name} is the {name} of is and is it
{num} {name} is a {num} is {name} {name} is. {Name} is {name},
a, the. of, and. in, not. for, that. it. on, see.
so my {name} is {name} and my {name} is
{name} dot dot dot dot {name} com com com com {name}
to {name} at {host} and to {name}
write to {name} at the {host}
mail is at {name} to {host}, {name}
ask the {name} at {host} to reach {name}
{name} is {word} to {name} at {name} is
{name} | {word} | {name} | {name}
{name}$$$ of%%% the&&& {num}***
""".strip()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the exact patterns in code points, leftmost and without overlap in each kind."""
    out = []
    if "@" in text:
        out += _emails(text)
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _emails(text: str) -> list[tuple[int, int, str]]:
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+` from the left."""
    out, end = [], 0
    for m in LOCAL.finditer(text):
        start = max(m.start(), end)
        domain = DOMAIN.match(text, m.end()) if m[1] and start < m.end() - 1 else None
        if domain:
            end = domain.end()
            out.append((start, end, "email"))
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


@lru_cache(maxsize=1 << 16)
def word_features(word: str) -> tuple[str, ...]:
    """Shape features of a word by itself."""
    core = word.strip("\"'.,;:!?()[]*#%&$") or word
    shape = re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", re.sub(r"\d", "0", core))
    runs = re.sub(r"(.)\1+", r"\1+", shape)
    digits, letters = sum(c.isdigit() for c in core), sum(c.isalpha() for c in core)
    lower, bare = core.lower(), word.lower().strip(",.;:!?")
    head = re.match(r"akia(?=[a-z0-9]{16}$)|[a-z_]+", lower)
    out = [
        "shape=" + runs[:8],
        f"length={min(len(core), 24) // 4}",
        "kind=" + ("mixed" if digits and letters else "digits" if digits else "letters" if letters else "signs"),
        "hex" if digits and len(core) >= 12 and re.fullmatch(r"[0-9a-f]+", lower) else "not hex",
        "quoted" if word[:1] == '"' else "plain",
        "caps" if digits and core.isupper() and core.isalnum() else "no caps",
        "head=" + (head[0] if head and head[0] in _HEADS else "none"),
        "key=" + (core.partition("=")[0].lower() if core.partition("=")[0].lower() in _HEADS else str("=" in core)),
        "at=" + str("@" in core),
        "dots=" + str(min(core.count("."), 3)),
        "bracket=" + str(word[:1] in "[("),
        "word=" + (bare if bare in _WORDS else "other"),
    ]
    return tuple(out)


_HEADS = {"password", "passwd", "pwd", "secret", "token", "api_key", "akia"}
_WORDS = {"password", "is", "at", "dot", "(at)", "[at]", "(dot)", "[dot]", "com", "org", "net", "to", "mail", "reach", "write", "ask", "my"}
#: Common words of clean text, also after a telling word.
_COMMON = ["the", "a", "of", "and", "in", "not", "too", "needed", "see", "for", "that", "it", "required", "wrong", "your", "on", "is", "to", "at", "my", "mail", "write", "ask"]
_WORDS |= set(_COMMON)


#: Places, from a word, of the words whose features it has.
STEPS = [0, -2, -1, 1, 2]
_NEAR = ("word=", "kind=", "head=", "edge")


def sequence_features(words: list[str]) -> list[list[str]]:
    """Features of each word in its sequence: its own and its neighbours'."""
    own = [word_features(w) for w in words]
    out = []
    for n, features in enumerate(own):
        near = list(features)
        for step in STEPS[1:]:
            other = own[n + step] if 0 <= n + step < len(own) else ("edge",)
            near += [f"{step}:{f}" for f in other if f.startswith(_NEAR)]
        out.append(near)
    return out


def training_rows(copies: int = 12) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of the labelled table, each line ``copies`` times with other drawn values.

    In two of three copies plain drawn words, labelled O, stand before and behind the line, as in a text.
    """
    rng = np.random.default_rng(7)
    draw = lambda letters, low, high: "".join(rng.choice(list(letters), rng.integers(low, high + 1)))
    hexa, upper, lower = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz"
    values = {
        "hex": lambda: draw(hexa, 12, 20),
        "sha": lambda: draw(hexa, 40, 40),
        "HEX": lambda: draw(hexa.upper(), 12, 20),
        "SHA": lambda: draw(hexa.upper(), 40, 40),
        "key": lambda: draw(upper, 16, 16),
        "num": lambda: draw("0123456789", 1, 4),
        "name": lambda: draw(lower, 3, 9),
        "host": lambda: draw(lower, 4, 8),
        "word": lambda: draw(lower, 6, 14),
        "AKIA": lambda: "AKIA" + draw(upper[:26], 16, 16),
        "Name": lambda: draw(lower, 3, 9).capitalize(),
        "NAME": lambda: draw(lower, 3, 9).upper(),
        "Host": lambda: draw(lower, 4, 8).capitalize(),
        "HOST": lambda: draw(lower, 4, 8).upper(),
        "Word": lambda: draw(lower, 6, 14).capitalize(),
        "WORD": lambda: draw(lower, 6, 14).upper(),
    }

    def prose(size: int) -> list[str]:
        out: list[str] = []
        for _ in range(size):
            if out and rng.random() < 0.2:
                out.append(out[-1])
                continue
            word = str(rng.choice(_COMMON)) if rng.random() < 0.4 else draw(lower + "é", 1, 10)
            word = [word, word, word, word.capitalize(), word.upper(), str(rng.integers(1, 3000))][rng.integers(6)]
            out.append(word + ["", "", "", ".", ",", ";"][rng.integers(6)] if rng.random() < 0.97 else "|")
        return out

    rows = []
    for line in TRAINING.splitlines():
        for copy in range(copies):
            pairs = [re.fullmatch(r"(.+?)(?:/([BI]-\w+))?", w).groups() for w in line.split()]
            words = [re.sub(r"\{(\w+)\}", lambda m: values[m[1]](), w) for w, _ in pairs]
            labels = [label or "O" for _, label in pairs]
            if copy % 3:
                words, labels = prose(3) + words + prose(3), ["O"] * 3 + labels + ["O"] * 3
            rows.append((words, labels))
    rows += [(prose(16), ["O"] * 16) for _ in range(25 * copies)]
    rows += [([w] * 12, ["O"] * 12) for word in _COMMON for w in (word, word.capitalize(), word.upper())]
    return rows


class Field:
    """Linear-chain conditional random field with feature weights and label transitions."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.vocabulary, self.weights, self.moves = vocabulary, weights, moves

    @staticmethod
    def fit(rows: list[tuple[list[str], list[str]]], steps: int = 150, rate: float = 0.15, ridge: float = 2e-4) -> Field:
        """Maximum likelihood with a ridge penalty by Adam; gradients by the forward-backward recursions over padded batches."""
        features = [sequence_features(words) for words, _ in rows]
        vocabulary = {f: n for n, f in enumerate(sorted({f for s in features for w in s for f in w}))}
        width, labels = max(map(len, features)), len(LABELS)
        truth, mask = np.zeros((len(rows), width), int), np.zeros((len(rows), width), bool)
        for r, (s, (_, own)) in enumerate(zip(features, rows)):
            truth[r, : len(s)], mask[r, : len(s)] = [LABELS.index(label) for label in own], True
        held = np.zeros((int(mask.sum()), len(vocabulary)))
        for n, w in enumerate(w for s in features for w in s):
            held[n, [vocabulary[f] for f in w]] = 1
        weights, moves = np.zeros((len(vocabulary), labels)), np.zeros((labels, labels))
        state = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
        one_hot = np.eye(labels)
        pairs = mask[:, 1:] & mask[:, :-1]
        seen = np.zeros_like(moves)
        np.add.at(seen, (truth[:, :-1][pairs], truth[:, 1:][pairs]), 1)
        for step in range(1, steps + 1):
            emit = np.zeros((len(rows), width, labels))
            emit[mask] = held @ weights
            alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
            alpha[:, 0] = emit[:, 0]
            for t in range(1, width):
                move = _log_sum(alpha[:, t - 1, :, None] + moves, 1) + emit[:, t]
                alpha[:, t] = np.where(mask[:, t, None], move, alpha[:, t - 1])
            for t in range(width - 2, -1, -1):
                back = _log_sum(moves + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(mask[:, t + 1, None], back, 0)
            total = _log_sum(alpha[:, -1], 1)
            chance = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
            error = (one_hot[truth] - chance) * mask[:, :, None]
            grad = held.T @ error[mask]
            joint = np.exp(
                alpha[:, :-1, :, None] + moves + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
            )
            grad_moves = seen - joint[pairs].sum(axis=0)
            for value, slope, first, second in ((weights, grad, *state[:2]), (moves, grad_moves, *state[2:])):
                slope = slope / len(rows) - ridge * value
                first[:] = 0.9 * first + 0.1 * slope
                second[:] = 0.99 * second + 0.01 * slope**2
                value += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        return Field(vocabulary, weights, moves)

    def decode(self, sequences: list[list[str]]) -> list[list[int]]:
        """Best label sequence of each word sequence."""
        emits = []
        for words in sequences:
            known = [[self.vocabulary[f] for f in features if f in self.vocabulary] for features in sequence_features(words)]
            emits.append(np.array([self.weights[k].sum(axis=0) for k in known]).reshape(-1, len(LABELS)))
        return [path.tolist() for path in self.best_paths(emits)]

    def best_paths(self, emits: list[np.ndarray]) -> list[np.ndarray]:
        """Best path through each table of label scores a word: Viterbi over batches of like length."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(emits)
        order = sorted((n for n in range(len(emits)) if len(emits[n])), key=lambda n: -len(emits[n]))
        at = 0
        while at < len(order):
            width = len(emits[order[at]])
            batch = order[at : at + max(1, BATCH_WORDS // width)]
            at += len(batch)
            emit = np.zeros((len(batch), width, len(LABELS)))
            lengths = np.array([len(emits[n]) for n in batch])
            for r, n in enumerate(batch):
                emit[r, : lengths[r]] = emits[n]
            best, back = emit[:, 0], np.zeros((len(batch), width, len(LABELS)), np.int8)
            for t in range(1, width):
                reach = best[:, :, None] + self.moves
                back[:, t] = reach.argmax(axis=1)
                best = np.where((t < lengths)[:, None], reach.max(axis=1) + emit[:, t], best)
            label = best.argmax(axis=1)
            paths = np.zeros((len(batch), width), int)
            for t in range(width - 1, -1, -1):
                inside = t < lengths
                paths[inside, t] = label[inside]
                if t:
                    label = np.where(inside, back[np.arange(len(batch)), t, label], label)
            for r, n in enumerate(batch):
                out[n] = paths[r, : lengths[r]]
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_kept"}

    def _scores(self, w: tb.Words) -> np.ndarray:
        """Label scores of each word of a slice from the features of itself and its neighbours in its text."""
        kept, table = self.__dict__.setdefault("_kept", ({}, np.zeros((KEPT_WORDS, len(STEPS), len(LABELS)))))
        distinct, first, place = np.unique(_likes(w), return_index=True, return_inverse=True)
        if len(kept) + len(distinct) > len(table):
            kept.clear()
        if len(distinct) > len(table):
            table = np.zeros((len(distinct), len(STEPS), len(LABELS)))
            self._kept = kept, table
        rows = np.empty(len(distinct), np.int64)
        for n, (h, i) in enumerate(zip(distinct.tolist(), first.tolist())):
            row = kept.get(h)
            if row is None:
                row = kept[h] = len(kept)
                table[row] = self._shares(word_features(w.data[w.starts[i] : w.ends[i]].tobytes().decode("utf-8", "replace")))
            rows[n] = row
        rows = rows[place]
        edge = self._shares(("edge",))
        text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        emit = table[rows, STEPS.index(0)]
        for k, step in enumerate(STEPS):
            if step:
                other = np.arange(len(rows)) + step
                inside = (other >= w.first[text]) & (other < w.first[text + 1])
                emit += np.where(inside[:, None], table[rows[np.where(inside, other, 0)], k], edge[k])
        return emit

    def _shares(self, features: tuple[str, ...]) -> np.ndarray:
        """What a word with ``features`` adds to the scores of the word from which it is at each of STEPS."""
        out = np.zeros((len(STEPS), len(LABELS)))
        for k, step in enumerate(STEPS):
            names = [f"{step}:{f}" for f in features if f.startswith(_NEAR)] if step else features
            out[k] = self.weights[[self.vocabulary[f] for f in names if f in self.vocabulary]].sum(axis=0)
        return out

    def label(self, w: tb.Words) -> np.ndarray:
        """Label of each word of a slice: the best path of each whole text."""
        out = np.zeros(len(w.starts), int)
        if not len(out):
            return out
        emit = self._scores(w)
        # A run of other labels gains over O at most its words' gains, each with the best move to its label from another than
        # O, and what entering and leaving the run adds. Words in no run that could gain are O.
        moves = self.moves - self.moves[0, 0]
        reach = moves[1:, 1:].max(axis=0)
        gain = (emit[:, 1:] - emit[:, :1] + reach).max(axis=1)
        # A text's first and last words have no move to them or from them, but in the path of O too.
        enter = max((moves[0, 1:] - reach).max(), (-self.moves[0, 0] - reach).max(), (-reach).max(), 0)
        leave = max(moves[1:, 0].max(), 0)
        sums = np.concatenate([[0], np.cumsum(gain)])
        behind = sums[1:] - np.minimum.accumulate(sums)[:-1]
        before = np.maximum.accumulate(sums[::-1])[::-1][1:] - sums[:-1]
        free = behind + before - gain + enter + leave > -1e-6
        at = np.flatnonzero(free)
        if not len(at):
            return out
        text = np.searchsorted(w.first, at, "right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] > at[:-1] + 1) | (text[1:] != text[:-1])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(at)) - 1
        # The O words beside a stretch come along.
        low = np.maximum(at[begin] - 1, w.first[text[begin]])
        high = np.minimum(at[last] + 2, w.first[text[last] + 1])
        for a, b, path in zip(low, high, self.best_paths([emit[a:b] for a, b in zip(low, high)])):
            out[a:b] = path
        return out


def _likes(w: tb.Words) -> np.ndarray:
    """A hash for each word so that words of equal hash have equal features: that of the word itself if it has a digit, = or _
    or a run of letters that features name, and otherwise that of the word with x and X for letters."""
    letter = _LETTER[w.data]
    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # Letters of neighbouring texts can touch, so runs end with their word.
    inner = w.starts[letter[w.starts] & ~np.isin(w.starts, begin)]
    begin, end = np.sort(np.append(begin, inner)), np.sort(np.append(end, inner))
    named = np.isin(tb.range_hashes(tb._LOWER[w.data], begin, end), _named_hashes()) | (end - begin == 20)
    marked = np.concatenate([[0], np.cumsum(_MARKS[w.data])])
    same = marked[w.ends] > marked[w.starts]
    same[np.searchsorted(w.starts, begin[named], "right") - 1] = True
    inside = np.zeros(len(w.data) + 1, np.int8)
    np.add.at(inside, w.starts[same], 1)
    np.add.at(inside, w.ends[same], -1)
    return tb.range_hashes(np.where(np.cumsum(inside, dtype=np.int8)[:-1] > 0, w.data, _SHAPES[w.data]), w.starts, w.ends)


@lru_cache(maxsize=1)
def _named_hashes() -> np.ndarray:
    runs = sorted({r for word in _WORDS | _HEADS for r in re.findall("[a-z]+", word)})
    return tb.words(pa.array([" ".join(runs)], pa.large_string()), tb.SPACED).hashes


_SHAPES = np.arange(256, dtype=np.uint8)
_SHAPES[0x61:0x7B], _SHAPES[0x41:0x5B] = ord("x"), ord("X")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARKS = np.zeros(256, bool)
_MARKS[[*range(0x30, 0x3A), ord("="), ord("_")]] = True


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def find(field: Field, texts: pa.Array) -> list[list[dict]]:
    """Spans of each text: the patterns' and those that the field adds where no pattern's span is."""
    out: list[list[dict]] = []
    for _, part in tb.slices(texts):
        strings = part.to_pylist()
        spans = [base_spans(t) for t in strings]
        w = tb.words(part, tb.SPACED, lower=False)
        labels = field.label(w)
        held = np.flatnonzero(labels)
        if len(held):
            char = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
            offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
            zero = char[offsets - offsets[0]]
            added: dict[int, set[tuple[int, int, str]]] = {}
            rows = np.searchsorted(w.first, held, "right") - 1
            for row in np.unique(rows).tolist():
                a = int(w.first[row])
                for begin, end, kind in _runs(labels[a : w.first[row + 1]].tolist()):
                    low, high = char[w.starts[a + begin]] - zero[row], char[w.ends[a + end - 1]] - zero[row]
                    low, high = _trim(strings[row], int(low), int(high))
                    if low < high and not any(s < high and low < e for s, e, _ in spans[row]):
                        added.setdefault(row, set()).add((low, high, kind))
            for row, more in added.items():
                last = 0
                for s in sorted(more, key=lambda s: (s[0], -s[1])):
                    if s[0] >= last:
                        spans[row].append(s)
                        last = s[1]
                spans[row].sort(key=lambda s: (s[0], KINDS.index(s[2])))
        out += [[{"kind": k, "start": s, "end": e} for s, e, k in own] for own in spans]
    return out


def _runs(path: list[int]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for n, label in enumerate(LABELS[p] for p in path):
        if label == "O":
            continue
        begin, kind = label[0] == "B", label[2:]
        if not begin and out and out[-1][1] == n and out[-1][2] == kind:
            out[-1] = (out[-1][0], n + 1, kind)
        else:
            out.append((n, n + 1, kind))
    return out


def _trim(text: str, low: int, high: int) -> tuple[int, int]:
    """Without quotes and punctuation around, and without the name before an equals sign."""
    while low < high and text[low] in "\"'(,;:*#%&$!":
        low += 1
    while low < high and text[high - 1] in "\"'),;:*#%&$!.?":
        high -= 1
    name = re.match(r"[A-Za-z_]+=[\"']*", text[low:high])
    return (low + name.end(), high) if name else (low, high)


KIND = "struct<spans:array<struct<kind:string,start:long,end:long>>>"


def find_personal_data(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with a struct ``into`` of spans: kind, start and end in code points, end exclusive, by start.

    Null and empty texts have none. Repeated rows get equal spans; a column named ``into`` is replaced. The field is trained
    from the labelled table on the driver, in some ten seconds, and broadcast; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_trained())
    return with_struct(docs, text, into, KIND, lambda: lambda texts: [{"spans": s} for s in find(shared.value, texts)])


@lru_cache(maxsize=1)
def _trained() -> Field:
    return Field.fit(training_rows())


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced by its kind in angle brackets; overlapping spans are one."""
    found = find_personal_data(docs, text, "__pii")
    body = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def put(state, span):
        keep = F.substring(body, (state["at"] + 1).cast("int"), F.greatest(span["start"] - state["at"], F.lit(0)).cast("int"))
        more = F.when(span["start"] >= state["at"], F.concat(keep, F.lit("<"), span["kind"], F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.concat(state["done"], more).alias("done"), F.greatest(state["at"], span["end"]).alias("at"))

    def finish(state):
        return F.concat(state["done"], F.substring(body, (state["at"] + 1).cast("int"), F.length(body)))

    masked = F.aggregate(F.col("__pii.spans"), start, put, finish)
    return found.withColumn(text, F.when(F.size("__pii.spans") > 0, masked).otherwise(F.col(text))).drop("__pii")


def op10(docs: DataFrame) -> DataFrame:
    """Contract columns from :func:`find_personal_data`."""
    found = find_personal_data(docs.select("doc_id", "text"))
    spans = F.col("pii.spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    written = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[count(kind) for kind in BASE_KINDS],
        F.sha2(written(F.filter(spans, lambda s: s["kind"].isin(BASE_KINDS))), 256).alias("base_sha256"),
        written(spans).alias("spans"),
    )
