"""Words are learned and looked up in bulk: calls do not grow with their number."""

import sys

import numpy as np

from weft.llm.alignment import Side, pack, summed, unpack
from weft.llm.common import Recent


class Letters(Side):
    """Ids of letters; `?` gives another letter back, `_` nothing."""

    def __init__(self):
        super().__init__([bytes([n]) for n in range(128)] + [b"ab", b""])

    def encode(self, words):
        return self.found


def calls(fn, *args):
    count = []
    sys.setprofile(lambda frame, event, arg: count.append(1) if event == "c_call" else None)
    try:
        out = fn(*args)
    finally:
        sys.setprofile(None)
    return out, len(count)


def test_learn_in_bulk():
    side, seen = Letters(), []
    for n in (10, 2000):
        words = [b"w%d" % k for k in range(n)] + [b"ab", b"ab", b"?", b"_", b"ab"]
        side.found = [list(w) for w in words[:-5]] + [[128], [97, 98], [33], [], [97, 129, 98]]
        ids, count = calls(side.learn, words)
        seen.append(count)
        bad = [-1]
        assert [np.frombuffer(i, np.int32).tolist() for i in ids] == side.found[:-3] + [bad, bad, [97, 129, 98]]
    assert seen[1] < seen[0] + 100


def test_known_words_in_bulk():
    recent, seen = Recent(10_000), []
    for n in (10, 2000):
        keys = [b"%d" % k for k in range(n)]
        recent.get_all(keys, lambda missing: [k + b"!" for k in missing])
        out, count = calls(recent.get_all, keys, lambda missing: [])
        assert out == [k + b"!" for k in keys]
        seen.append(count)
    assert seen[1] < seen[0] + 100


def test_words_last_asked_for_are_kept():
    recent, asked = Recent(4), []
    get = lambda *keys: recent.get_all(list(keys), lambda missing: asked.append(missing) or [k * 2 for k in missing])
    assert get("a", "b", "c") == ["aa", "bb", "cc"] and get("a", "d") == ["aa", "dd"] and get("e", "f") == ["ee", "ff"]
    assert get("a", "d", "b") == ["aa", "dd", "bb"] and asked == [["a", "b", "c"], ["d"], ["e", "f"], ["b"]]


def test_sums_and_packs():
    rng = np.random.default_rng(3)
    owner, key, count = rng.integers(0, 5, 400), rng.integers(0, 50_000 * 32_000, 30)[rng.integers(0, 30, 400)], rng.integers(1, 4, 400)
    first, keys, counts = summed(owner, key, count, 6)
    want: dict = {}
    for o, k, c in zip(owner.tolist(), key.tolist(), count.tolist()):
        want[o, k] = want.get((o, k), 0) + c
    assert [(o, k) for o in range(6) for k in keys[first[o] : first[o + 1]].tolist()] == sorted(want)
    assert counts.tolist() == [want[k] for k in sorted(want)]
    none = np.zeros(0, np.int64)
    assert [x.tolist() for x in summed(none, none, none, 2)] == [[0, 0, 0], [], []]
    for numbers in (keys, none, np.array([7, 3, 9])):
        assert unpack(pack(numbers), len(numbers)).tolist() == numbers.tolist()
