"""The pipeline's stages against plain Python on the smallest tables, each on what its predecessor kept."""

import os
import re

import pytest

import corpus_pipeline
from weft.llm import byte_bpe, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
UPPER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def smallest_linked(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def windows(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    n = min(10, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set(), w


def test_pipeline(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        kept.append({r.doc_id: r for r in docs.collect()})
    source = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}

    insults = re.compile(rf"(?i)(?<!\w)({'|'.join(toxicity.SEED_TERMS)})(?!\w)")
    assert set(kept[0]) == {i for i, r in source.items() if not insults.search(r.text)}

    homes = smallest_linked({i: shingle_set(r.text) for i, r in kept[0].items()})
    assert set(kept[1]) == {i for i, home in homes.items() if i == home}

    tests = [windows(r.text)[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = set().union(*tests)
    sizes = {len(p) for p in leaks}

    def clean(text):
        _, w = windows(text)
        return not any(tuple(w[i : i + n]) in leaks for n in sizes for i in range(len(w) - n + 1))

    assert set(kept[2]) == {i for i, r in kept[1].items() if clean(r.text)}

    personal = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+|\+1 \(\d{3}\) \d{3}-\d{4}|AKIA[A-Z0-9]{16}|password=[0-9a-f]{18}")
    assert set(kept[3]) == set(kept[2])
    for i, r in kept[3].items():
        assert not personal.search(r.text) and r.n_chars == len(r.text)
        before = kept[2][i].text
        pieces = [re.escape(p) for p in re.split(r"<(?:email|ip|card|phone|secret|contact)>", r.text)]
        assert re.fullmatch(r"[\s\S]+?".join(pieces), before)  # all but what was masked is as it was
        if not re.search(r"[0-9@=]|\bdot\b|[\[(]at[\])]", before):
            assert r.text == before

    ranks = byte_bpe.read_ranks(byte_bpe.default_path())
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(kept[4]) == set(kept[3])
    for i, r in kept[4].items():
        assert r.round_trip and list(r.ids) == reference.encode_ordinary(kept[3][i].text) and r.n_tokens == len(r.ids)
