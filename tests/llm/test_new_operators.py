"""Prefix trie, tokenizer alignment and language identification against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from weft.llm import alignment, language_id, prefix_trie

SF = "/root/testdata/sf0.001"


# Prefix trie


def plain_trie(rows):
    """The contract by materialised texts."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, convs in members.items():
        own_saved = (len(convs) - 1) * len(path[-1][1].replace("\v", " ").replace("\f", " ").split()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += own_saved
            leaves[path[:d]] += not children[path]
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(rebuilt[c]) == len(path))
        parent = members[path[:-1]][0] if path else None
        out.append((convs[0], len(path), parent, len(convs), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "'clash' AS depth", "1 AS k1", "2 AS words", "3 AS part")


def test_trie(spark):
    random.seed(4)
    rows = [(c, t, random.choice(["user", "bot", None]), random.choice(["hi there", "no", "", None, "a  b\tc", "same words here"])) for c in range(-40, 160) for t in range(random.randint(0, 6))]
    rows += [(7, None, "user", "before all"), (7, None, None, None), (None, 1, "user", "nobody"), (33, 2, "bot", "tie"), (33, 2, "bot", "tie"), (33, 2, "a", "tie")]
    rows += [(1000, 0, "user", "alone"), (1025, 0, "u", "one"), (1025, 1, "u", "two")]
    assert trie_rows(prefix_trie.op11(conversations(spark, rows))) == plain_trie(rows)
    assert prefix_trie.op11(conversations(spark, rows[:0])).collect() == []


def test_trie_of_long_conversations(spark, monkeypatch):
    """A conversation over all partitions and chunks, copies of it, and one that leaves it late."""
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 5)
    long = [("user", f"turn {n % 7} {n}") for n in range(400)]
    rows = [(c, n, *t) for c in (3, 5, 70) for n, t in enumerate(long)]
    rows += [(8, n, *t) for n, t in enumerate(long[:300] + [("user", "other end")] * 5)]
    rows += [(c, n, "user", f"short {c % 5} {n}") for c in range(100, 180) for n in range(3)]
    assert trie_rows(prefix_trie.op11(conversations(spark, rows))) == plain_trie(rows)


def test_trie_verifies_its_groups(spark):
    """Hashes of few bits collide; the check finds it, and other hashes give the right nodes."""
    rows = [(c, t, "user", f"{c * t % 11}") for c in range(60) for t in range(5)]
    assert trie_rows(prefix_trie.trie(conversations(spark, rows), mask=1).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) == plain_trie(rows)


# Alignment


@pytest.fixture(scope="module")
def models():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain_tokens(models, text):
    """(tokens of A, tokens of B) as (id, bytes), of whole texts at once; none where bytes differ."""
    a, b = models
    if not text:
        return [], []
    letters = alignment.byte_letters()
    x = [(n, bytes(letters[c] for c in a.id_to_token(n))) for n in a.encode(" " + text, add_special_tokens=False).ids]
    y = [(n, bytes([int(b.id_to_piece(n)[3:5], 16)]) if b.is_byte(n) else b.id_to_piece(n).replace("▁", " ").encode()) for n in b.encode(text)]
    whole = (" " + text).encode()
    return (x, y) if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else ([], [])


def plain_groups(x, y):
    ends = [list(np.cumsum([len(t) for _, t in side], dtype=int)) for side in (x, y)]
    groups, last = [], 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        groups.append(tuple([n for (n, _), e in zip(side, own) if last < e <= end] for side, own in zip((x, y), ends)))
        last = end
    return groups


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  a  b "), (5, "a▁b"), (6, "<|endoftext|> <s> </s><unk>"), (7, "x" * 3000), (8, "漢字かな交じり文。" * 50 + " é́😀 \x00 　z\n\n\t  x"), (9, "the cat's 12345 don't"),
    (9, "the cat's 12345 don't"), (None, "hm 1 2 3"), (10, "▁"), (11, "word and words " * 2000), (12, "😀😁 " * 4 + "�" * 9), (13, "a b▁c " * 300), (14, "1.5e-3 == [x]\r\n\x85  end"),
]


@pytest.mark.parametrize("block", [1 << 21, 40])
def test_alignment(spark, models, monkeypatch, block):
    """Odd texts, long ones in several parts, and documents in several blocks."""
    monkeypatch.setattr(alignment, "PART_BYTES", 1000)
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", block)
    rows = ODD + [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    groups = [plain_groups(*plain_tokens(models, text)) for _, text in rows]
    links = [Counter((p, q) for x, y in g for p in x for q in y) for g in groups]
    held = Counter(pair for own in links for pair in own)
    best = Counter()
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    want = []
    for (doc_id, _), g, own in zip(rows, groups, links):
        listing = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        n_best = sum(k for (p, q), k in own.items() if held[p, q] == best[p])
        want.append(
            (doc_id, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()), n_best, sum(k * held[pair] for pair, k in own.items()), hashlib.sha256(listing.encode()).hexdigest() if g else "")
        )
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS block", "'x' AS aligned", "1 AS n_a")
    assert sorted(map(tuple, alignment.op12(df).collect()), key=str) == sorted(want, key=str)
    assert alignment.op12(df.limit(0)).collect() == []
    for row, g in zip(sorted(alignment.align(df).collect(), key=lambda r: (r.text or "", str(r.doc_id))), sorted(zip(rows, groups), key=lambda x: (x[0][1] or "", str(x[0][0])))):
        assert (row.aligned.a_ids, row.aligned.n_b) == ([n for x, _ in g[1] for n in x], [len(y) for _, y in g[1]])


# Language


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba"]
    own = language_id.Pieces(pieces)
    random.seed(2)
    log_p = np.log(np.random.default_rng(1).random((own.size, 2)))
    for word in ("a", "abab", "babaab", "aéb"):
        ids, sizes, others = own.lattice([np.frombuffer(word.encode("utf-32-le"), np.uint32)])
        p = own.rows(log_p, others)
        text, total = "▁" + word, np.zeros(2)
        counts = np.zeros((own.size, 2))
        for n in range(len(text)):
            for cuts in combinations(range(1, len(text)), n):
                parts = [text[i:j] for i, j in zip((0, *cuts), (*cuts, len(text)))]
                if all(x in pieces or len(x) == 1 for x in parts):
                    used = [k for x in parts for k in ([pieces.index(x)] if x in pieces else [own.n_pieces + b for b in x.encode()])]
                    chance = np.exp(log_p[used].sum(0))
                    total += chance
                    for k in used:
                        counts[k] += chance
        up, down = language_id.forward(ids, p), language_id.backward(ids, sizes, p)
        assert np.allclose(up[sizes[0], 0], np.log(total)) and np.allclose(down[0, 0], np.log(total))
        words = __import__("pyarrow").RecordBatch.from_pydict({"language": np.zeros(1, np.int32), "word": [word], "n": [3]})
        (found,) = language_id._expect(pieces, log_p)(iter([words]))
        told = dict(zip(found.column(1).to_pylist(), found.column(2).to_pylist()))
        for k in range(own.size):
            assert abs(told.get(k, 0) / language_id.UNIT - 3 * counts[k, 0] / total[0]) < 1e-3


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    told = language_id.op13(docs).collect()
    assert len(told) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in told)
    assert all(0 <= r.score <= 1 for r in told)
    out = [r.lang_pred == lang[r.doc_id] for r in told if r.held_out]
    assert sum(out) / len(out) > 0.98
    again = language_id.op13(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, told))


def test_odd_languages(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, "der Hund und die Katze", "de"), (4, None, "en"), (5, "12 34 !", "fr"), (6, "", None), (None, "the dog and the cat", None), (7, "x" * 100_000, None), (8, "漢字" * 300 + "\U0001f600 ퟿", None), (9, "̀̀", "de"), (3, "der Hund und die Katze", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'clash' AS language", "1 AS __hash", "2 AS held_out")
    told = language_id.identify(df, language_id.fit(df)).collect()
    got = {(r.doc_id, r.language.lang) for r in told}
    assert len(told) == len(rows) and {(1, "en"), (2, "fr"), (3, "de"), (None, "en"), (4, "und"), (5, "und"), (6, "und"), (9, "und")} <= got
    assert all(r.language.score == 0 for r in told if r.language.lang == "und")
    assert {r.lang_pred for r in language_id.op13(df.withColumn("lang", df.lang.substr(9, 1)).filter("doc_id < 0 OR lang = ''").limit(0)).collect()} == set()
    none = spark.createDataFrame([(1, "no labels at all", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_id.op13(none).collect()] == [("und", 0.0)]
