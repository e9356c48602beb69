"""The corpus pipeline on a small corpus, stage by stage against brute force."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_documents import covered, words_of
from test_near_text import grams

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghilmnoprstuvé") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    passage, item = sentence(90), sentence(25)
    texts = [sentence(rng.randrange(30, 200)) for _ in range(240)]
    texts += [" ".join([rng.choice(words).upper() + "!!"] * 60) for _ in range(80)]  # junk
    texts += texts[:12] + [texts[3] + "\n"]  # copies
    texts += [f"{sentence(40)} {passage} {sentence(30)}" for _ in range(6)]
    texts += [f"{sentence(40)} {item} {sentence(30)}" for _ in range(4)] + [None, ""]
    docs = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(not 240 <= i < 320), 0) for i in range(320)]
    folder = tmp_path_factory.mktemp("sf")
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, item), (2, sentence(30))], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder), {d[0]: d[1] for d in docs}, [item]


def test_stages(spark, corpus):
    sf, texts, items = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "repeats", "decontaminate", "encode"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    f = dict(corpus_pipeline.STAGES)
    take = lambda df: {r.doc_id: r.text for r in df.collect()}

    good = take(one := f["quality"](spark, docs, sf).cache())
    assert not any(240 <= i < 320 for i in good) and sum(i < 240 for i in good) >= 236
    assert one.columns == docs.columns

    sets = {i: grams(t) for i, t in good.items()}
    near = lambda a, b: sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))
    root = {i: i for i in good}
    for _ in range(4):
        root = {i: min(root[j] for j in good if near(i, j)) for i in good}
    kept = take(two := f["near_dedup"](spark, one, sf).cache())
    assert kept == {i: t for i, t in good.items() if root[i] == i}

    ids = sorted(kept)
    raw = [(kept[i] or "").encode() for i in ids]
    want = {i: np.frombuffer(t, np.uint8)[~m].tobytes().decode("utf-8", "ignore") for i, t, m in zip(ids, raw, covered(raw, corpus_pipeline.REPEAT), strict=True)}
    cut = take(three := f["repeats"](spark, two, sf).cache())
    assert {i: t or "" for i, t in cut.items()} == want
    assert all(r.n_chars == len(r.text or "") for r in three.where("text IS NOT NULL").collect())
    assert any(want[i] != (kept[i] or "") for i in ids)

    def leaks(t):
        w = words_of(t)
        grams = {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
        return any(tuple(x[k : k + 10]) in grams for x in map(words_of, items) for k in range(len(x) - 9))

    clean = take(four := f["decontaminate"](spark, three, sf).cache())
    assert clean == {i: t for i, t in cut.items() if not leaks(t)} and len(clean) < len(cut)
    assert sorted(four.columns) == sorted(docs.columns)

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.ids for r in f["encode"](spark, four, sf).collect()}
    assert got == {i: own.encode_ordinary(t or "") for i, t in clean.items()}


def test_run_writes_and_reads_each_stage(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.count() > 200 and {"doc_id", "n_tokens", "ids"} <= set(out.columns)
