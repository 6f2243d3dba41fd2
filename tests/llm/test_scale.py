"""Cases that matter at scale: hot keys, many groups, colliding words and several passes, against plain Python."""

import hashlib
import heapq
import random
import re
from itertools import groupby

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from weft.llm import byte_bpe, decontaminate, fingerprints, licenses, near_dedup, sharding, textbytes, token_counts, toxicity, url_filter

from .test_brute_force import SF, shingle_set

#: Two words of which every polynomial modulo a power of two takes the same value.
TWINS = ["".join("ab"[bin(n).count("1") & 1] for n in range(2048)), "".join("ba"[bin(n).count("1") & 1] for n in range(2048))]


def test_colliding_words_differ():
    part = next(textbytes.slices(pa.array([" ".join(TWINS)])))[1]
    a, b = textbytes.words(part, textbytes.SPACED).hashes
    assert a != b


def test_colliding_words_everywhere(spark):
    docs = spark.createDataFrame(list(enumerate(TWINS)), "doc_id long, text string")
    assert [r.kept for r in near_dedup.op5(docs).collect()] == [True, True]
    coded = byte_bpe.encode(docs).orderBy("doc_id").collect()
    assert [bytes(r.bpe.decoded).decode() for r in coded] == TWINS
    assert coded[0].bpe.ids != coded[1].bpe.ids
    vocabulary = sorted({bytes([b]) for b in range(256)} | {b" a", b"bb"})
    counts = token_counts.Counter(token_counts.Automaton(vocabulary), b" ")(pa.array(TWINS))
    assert counts[0]["n_tokens"] == 2048 - TWINS[0].count("bb") and counts[1]["n_tokens"] == 2049 - TWINS[1].count("bb")


def test_long_words_are_contracted_as_others():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(byte_bpe.default_path())
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["a" * 5_000, "=-" * 700, "é漢字" * 400, "".join(rng.choice("ACGT") for _ in range(4_000)), "".join(rng.choice("etaoinshr") for _ in range(1_000))]
    got = byte_bpe.Codec(ranks, byte_bpe.default_pattern()).round_trip(pa.array(texts)).to_pylist()
    assert [g["ids"] for g in got] == [known.encode_ordinary(t) for t in texts]
    assert [g["decoded"].decode() for g in got] == texts


def test_both_contractions_agree():
    ranks = byte_bpe.read_ranks(byte_bpe.default_path())
    codec, rng = byte_bpe.Codec(ranks, byte_bpe.default_pattern()), random.Random(9)
    words = ["".join(rng.choice(["er", "in", "th", "a", "bb", "é", " "]) for _ in range(rng.randint(1, 30))).encode() for _ in range(400)]
    assert codec._contract(words, False) == codec._contract(words, True)


def _one_by_one(sizes, shards):
    heap, out = [(0, s) for s in range(shards)], []
    for size in sizes:
        load, shard = heapq.heappop(heap)
        out.append(shard)
        heapq.heappush(heap, (load + size, shard))
    return out


@pytest.mark.parametrize("shape", [0.6, 1.0, 3.0])
def test_schedule_is_that_of_all_groups_one_by_one(shape):
    rng = random.Random(1)
    sizes = sorted((int(rng.paretovariate(shape) * rng.choice([1, 7, 90])) for _ in range(50_000)), reverse=True)
    runs = sharding.schedule(((size, len(list(own))) for size, own in groupby(sizes)), 8)
    assert [order[i % len(order)] for _, first, end, order in runs for i in range(end - first)] == _one_by_one(sizes, 8)


def test_shards_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_PART", 200)
    rng = random.Random(2)
    rows = [(f"g{rng.randrange(3_000)}", rng.choice([1, 1, 1, 5, 300])) for _ in range(6_000)] + [("hot", 2)] * 3_000 + [(None, None)]
    df = spark.createDataFrame(rows, "g string, size long")
    placed = sharding.assign_shards(df, "g", "size")
    got = {r.g: r.shards for r in placed.groupBy(F.coalesce("g", F.lit("")).alias("g")).agg(F.collect_set("shard").alias("shards")).collect()}
    assert all(len(s) == 1 for s in got.values())
    sums = {}
    for g, size in rows:
        sums[g or ""] = sums.get(g or "", 0) + (size or 0)
    loads = [0] * 8
    for g, total in sums.items():
        loads[got[g][0]] += total
    want = [0] * 8
    order = sorted((s for s in sums.values() if s), reverse=True)
    for size, shard in zip(order, _one_by_one(order, 8)):
        want[shard] += size
    assert loads == want
    slots = sharding.number_slots(placed, "shard", ["g", "size"], len(rows)).groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect()
    assert all(r.s == list(range(len(r.s))) for r in slots)


def test_benchmark_in_several_passes(spark):
    rng = random.Random(4)
    words = [f"w{n}" for n in range(60)]
    items = [(f"i{n}", " ".join(rng.choice(words) for _ in range(rng.choice([3, 10, 40])))) for n in range(80)]
    docs = [(n, " ".join(rng.choice(words) for _ in range(50)) + " " + rng.choice(items)[1] * (n % 2)) for n in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    one = decontaminate.find_leaks(d, b).orderBy("doc_id").collect()
    several = decontaminate.find_leaks(d, b, words_per_pass=300).orderBy("doc_id").collect()
    assert [r.leaks for r in one] == [r.leaks for r in several] and any(r.leaks.hits for r in one)
    for r, (_, text) in zip(one, docs):
        own = f" {text} "
        found = {i for i, t in items for w in [t.split()] for k in range(max(1, len(w) - 9)) if f" {' '.join(w[k : k + 10])} " in own}
        assert r.leaks.item_ids == sorted(found)


def test_near_copies_around_a_common_text(spark):
    """Texts that share much with a common one, but mostly less than the threshold with each other, and chains among them."""
    rng = random.Random(6)
    common = [f"c{n}" for n in range(200)]
    texts = []
    for n in range(250):
        t = list(common)
        for at in rng.sample(range(200), rng.choice([1, 2, 5, 8, 12])):
            t[at] = f"x{n}-{at}"
        texts.append(" ".join(t))
    texts += [texts[0]] * 40 + [" ".join(f"o{n}-{k}" for k in range(30)) for n in range(20)] + [None, " "]
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in near_dedup.op5(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert len(set(got.values())) > 22


@pytest.mark.parametrize("kind", ["long", "string"])
def test_next_text_of_repeated_ids(spark, monkeypatch, kind):
    monkeypatch.setattr(fingerprints, "ROWS_PER_BUCKET", 5)
    rng = random.Random(8)
    ids = [None] * 40 + [7] * 60 + [rng.randrange(100, 200) for _ in range(100)]
    rows = [(None if i is None else i if kind == "long" else f"k{i}", f"text {n}") for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumn("h", F.xxhash64("text"))
    got = fingerprints.with_next(df, "doc_id", {"text": "after"}, F.col("h")).collect()
    order = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or (0 if kind == "long" else ""), r.h))
    assert [r.after for r in order] == [r.text for r in order[1:] + order[:1]]


def test_op8_over_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    vocabulary = set(byte_bpe.read_ranks(byte_bpe.default_path()))
    longest, memo = max(map(len, vocabulary)), {}

    def pieces(word):
        if word not in memo:
            rest, n = b" " + word, 0
            while rest:
                size = next(k for k in range(min(longest, len(rest)), 0, -1) if rest[:k] in vocabulary)
                rest, n = rest[size:], n + 1
            memo[word] = n
        return memo[word]

    for r in token_counts.op8(docs).collect():
        words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (texts[r.doc_id] or "").encode()) if w]
        assert (r.n_words, r.n_tokens) == (len(words), sum(map(pieces, words)))


def test_op1_over_the_table(spark):
    pages, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("pages", "labels"))
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in url_filter.op1(pages, labels).collect():
        m = re.match(r"^.*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "", re.S)
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [x for x in url_filter.RULES if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        best = max(fits, key=lambda x: len(x[1] + x[2]), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1] + best[2])
        assert r.verdict == (best[0] if best else "block" if r.rule_tokens else "allow")


def test_long_urls_are_mined_whole(spark):
    """Forty tokens that recur together are one item; a pair far apart in the order of tokens, each half of which is harmless, is a rule."""
    tokens = [f"query=k{n:02d}" for n in range(40)]
    rows = [(tokens + ["host=bad"], True)] * 60 + [(["host=good", f"path=p{n}"], False) for n in range(200)]
    rules, items = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"))
    assert [r.antecedent for r in rules.collect()] == [["host=bad"]]
    assert {(r.token, r["item"]) for r in items.collect()} == {(t, "host=bad") for t in [*tokens, "host=bad"]}
    pages = spark.createDataFrame([([t],) for t in [*tokens, "host=good"]], "tokens array<string>")
    assert {r.tokens[0] for r in url_filter.match(pages, rules, items).collect() if r.rule_tokens} == set(tokens)

    own = lambda n: [f"path=x{n}-{k}" for k in range(38)]
    rows = [(["host=a", *own(n), "query=z"], True) for n in range(60)]
    rows += [([t, *own(n + 100)], False) for n in range(90) for t in ("host=a", "query=z")]
    rules, _ = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"))
    assert [(r.antecedent, r.confidence) for r in rules.collect()] == [(["host=a", "query=z"], 1.0)]


FOLDED = {
    "you idiot": 1, "you i\u200bdi\u200bot": 1, "i\u0301diot": 1, "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d": 1, "an i d i o t here": 1,
    "i.d.i.o.t!": 1, "1d10t": 1, "trash can": 0, "trash": 1, "idiotic": 1, "xidiot": 0, "idiotx": 0, "a b c d e": 0, "": 0, "so i\u00addiot": 1,
}


def test_folding():
    lexicon = toxicity.Lexicon()
    for text, r in zip(FOLDED, toxicity.search(lexicon, lexicon.automaton(), pa.array(list(FOLDED)))):
        assert len(r["matches"]) == FOLDED[text], text
        assert all(0 <= m["start"] < m["end"] <= len(text) for m in r["matches"])


def test_toxicity_against_plain_matching(spark):
    """Plain ASCII texts, searched word by word."""
    lexicon, rng = toxicity.Lexicon(), random.Random(11)
    vocabulary = [*toxicity.SEED_TERMS[:20], "river", "trash", "can", "day", "guinea", "pig", "x"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    scored = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon).collect()
    for r in scored:
        text = texts[r.doc_id]
        covered = {i for p in toxicity.EXCEPTION_PHRASES for m in re.finditer(rf"\b{p}\b", text) for i in range(*m.span())}
        found = [m for m in re.finditer(r"\w+", text) if m[0] in lexicon.weights and not set(range(*m.span())) <= covered]
        assert sorted((m.start(), m.end()) for m in found) == [(m.start, m.end) for m in r.toxicity.matches]
        assert abs(r.toxicity.weight - sum(lexicon.weights[m[0]] for m in found)) < 1e-9
        assert r.toxicity.score == pytest.approx(lexicon.score(r.toxicity.weight, len(text.split())))


NOTICES = [
    ("Licensed under CC BY-ND 4.0.", "CC-BY-ND"), ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA"), ("Released under the ISC License.", "ISC"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL"), ("Released under the Eclipse Public License 2.0.", "EPL"),
    ("Code under the GNU Affero General Public License, version 3.", "AGPL"), ("// SPDX-License-Identifier: GPL-3.0-or-later", "GPL"),
    ("This is not licensed under the MIT License.", None), ("The license of the driver was made in the public domain of law.", None), ("", None), (None, None),
    ("intro\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\nfiles", "MIT"),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation", "GPL"),
]


def test_license_notices(spark):
    model = licenses.train(spark.read.parquet(f"{SF}/documents.parquet"))
    docs = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(NOTICES)], "doc_id long, text string")
    found = [(r.doc_id, r.family) for r in licenses.scan(docs, model).orderBy("doc_id").collect()]
    assert found == [(n, family) for n, (_, family) in enumerate(NOTICES) if family]


def test_notices_over_many_lines(spark):
    """However many lines a notice is wrapped to, also a word a line; told once, and where it stands."""
    model = licenses.train(spark.read.parquet(f"{SF}/documents.parquet"))
    notices = {
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "CC-BY",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "GPL",
    }
    cases = []
    for notice, family in notices.items():
        words = notice.split()
        for per_line in (1, 2, 4, 9):
            lines = [" ".join(words[k : k + per_line]) for k in range(0, len(words), per_line)]
            cases.append((family, ["a tale of rain", "and of the sea.", "", *lines, "", "the end of it"], len(lines)))
    docs = spark.createDataFrame([(n, "\n".join(lines)) for n, (_, lines, _) in enumerate(cases)], "doc_id long, text string")
    found = licenses.scan(docs, model).orderBy("doc_id").collect()
    assert [(r.doc_id, r.family) for r in found] == [(n, family) for n, (family, *_) in enumerate(cases)]
    assert all(3 <= r.number and r.number + r.lines - 1 <= 2 + cases[r.doc_id][2] for r in found)
    two = spark.createDataFrame([(1, "\n".join([*cases[1][1], *["some words of prose"] * 3, *cases[1][1]]))], "doc_id long, text string")
    assert [r.family for r in licenses.scan(two, model).collect()] == ["CC-BY", "CC-BY"]


def test_telling_words_lose_no_notice():
    """What has no telling word of a template's set holds too little of every template."""
    telling = set(licenses.telling_words([t for ts in licenses.notices().values() for t in ts]))
    for ts in licenses.notices().values():
        for t in ts:
            grams = licenses._grams_of(t)
            assert sum(not telling & set(g.split()) for g in grams) < licenses.TEMPLATE_SHARE * len(grams)


def test_fingerprints_of_repeated_rows_are_alike(spark):
    rows = [(1, "same words here for all of them"), (1, "same words here for all of them"), (2, None)]
    got = fingerprints.op2(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert all(len(r.edited_sha256) == len(hashlib.sha256().hexdigest()) for r in got)


SPOKEN = [
    ("You cannot use this unless it is licensed under the MIT License.", []), ("It is false that this was released under the MIT License.", []),
    ("This was previously released under the MIT License.", []), ("It was never, as some say, licensed under the GPLv3.", []),
    ("It is not a toy and is licensed under the MIT License.", ["MIT"]), ("Previously released under the BSD license, but now licensed under the MIT license.", ["MIT"]),
    ("MIT OR Apache-2.0", ["Apache-2.0", "MIT"]), ("SPDX-License-Identifier: (GPL-3.0-only AND ISC) OR BSD-3-Clause", ["BSD", "GPL", "ISC"]),
    ("NOT AND ALSO", []), ("SPDX-License-Identifier: Frobnicate", []), ("MIT License", ["MIT"]), ("# License: MIT", ["MIT"]), ("GPLv3", ["GPL"]), ("CC0", ["public-domain"]),
    ("Apache License 2.0", ["Apache-2.0"]), ("This project uses the Apache 2.0 license", ["Apache-2.0"]), ("Licensed under CC BY 3.0", ["CC-BY"]),
    ("Licensed under CC BY-SA 3.0", ["CC-BY-SA"]), ("Licensed under the EUPL.", ["EUPL"]), ("Released under the WTFPL license.", ["WTFPL"]),
    ("Released under the Artistic License 2.0.", ["Artistic-2.0"]), ("Released under the MIT licence.", ["MIT"]),
    ("Er kommt mit dem Zug und geht mit dir.", []), ("The GPLv3 is longer than many novels and is read by few.", []), ("My driving licence was renewed.", []),
    ("- " * 20_000, []), (" " * 20_000 + "MIT", []), ("not " * 20_000 + "license", []), ("A OR " * 20_000 + "MIT", ["MIT"]),
]


def test_license_names_expressions_and_denials(spark):
    model = licenses.train(spark.read.parquet(f"{SF}/documents.parquet"))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SPOKEN)], "doc_id long, text string")
    found: dict = {i: set() for i in range(len(SPOKEN))}
    for r in licenses.scan(docs, model).collect():
        found[r.doc_id].add(r.family)
    assert {SPOKEN[i][0][:80]: sorted(f) for i, f in found.items()} == {t[:80]: f for t, f in SPOKEN}


def license_units(text):
    """(number of the first line, lines, paragraph) of every line, operand and wrapped paragraph, telling words or not."""
    lines, out, most = regex.split(r"\r?\n", text or ""), [], licenses.reach()
    count = [len(license_words(line)) for line in lines]
    for n, line in enumerate(lines):
        if regex.search(licenses._EXPRESSION, line):
            names = regex.split(r"\s+(?:OR|AND)\s+", regex.sub("[()]", "", regex.sub(licenses._HEAD, "", line)))
            out += [(n, 1, "SPDX-License-Identifier: " + name) for name in names]
            continue
        out.append((n, 1, line))
        if count[n] and not regex.search(r"""[.!?:;]["')\]]*\s*$""", line):
            size = held = 0
            while n + size + 1 < len(lines) and count[n + size + 1] and held < most:
                size, held = size + 1, held + count[n + size + 1]
            if size:
                out.append((n, size + 1, " ".join(lines[n : n + size + 1])))
    return out


def license_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", lower.replace("licence", "license")) if w]


def license_likeness(text):
    """Share of the closest template of each family."""
    own = license_words(text)
    held = {*own, *(" ".join(p) for p in zip(own, own[1:]))}
    best = {k: max(len(held & set(g)) / len(g) for g in map(licenses._grams_of, ts)) for k, ts in licenses.TEMPLATES.items()}
    for k, ts in licenses.named().items():
        for t in ts:
            grams = set(licenses._grams_of(t.text))
            if held >= set(t.must):
                best[k] = max(best[k], len(held & grams) / len(held | grams if t.heading else grams))
    return best


def test_licenses_brute_force(spark):
    """Every line and wrapped paragraph of whole texts is judged one by one; only the classifier's chances come from Spark."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = licenses.train(docs)
    wrapped = "This work is licensed\nunder a Creative Commons\nAttribution 4.0 International\nLicense and is\nlicensed under the\nMIT License."
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + [t for t, _ in SPOKEN[:-4]] + [wrapped, "MIT OR ISC\r\n\r\nGPLv3\nGPL-2.0 AND GPL-3.0"]
    units = [(row, *u, regex.sub(licenses._DENIED, " ", u[2])) for row, text in enumerate(texts) for u in license_units(text)]
    frame = spark.createDataFrame([(i, u[-1]) for i, u in enumerate(units)], "i long, stands string")
    found: dict = {}
    for r in model.model.transform(licenses.vectors(frame, "stands")).select("i", "prediction", "probability").collect():
        row, number, size, _, stands = units[r.i]
        family, chance = model.families[int(r.prediction)], r.probability[int(r.prediction)]
        if r.prediction > 0 and chance >= model.threshold:
            likeness = license_likeness(stands)
            if likeness[family] >= max(licenses.TEMPLATE_SHARE, *likeness.values()):
                found.setdefault((row, family), []).append((number, size, likeness[family]))
    expected = set()
    for key, hits in found.items():
        single = {n for n, size, _ in hits if size == 1}
        expected |= {(*key, n, 1) for n in single}
        group: list = []
        for n, size, share in sorted(h for h in hits if h[1] > 1 and not single & set(range(h[0], sum(h[:2])))):
            if group and n > max(g[0] + g[1] - 1 for g in group):
                expected.add((*key, *min(group, key=lambda g: (-g[2], g[1], g[0]))[:2]))
                group = []
            group.append((n, size, share))
        if group:
            expected.add((*key, *min(group, key=lambda g: (-g[2], g[1], g[0]))[:2]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.family, r.number, r.lines) for r in licenses.scan(rows, model).collect()} == expected
    assert len(expected) > 20 and any(e[3] > 1 for e in expected)
