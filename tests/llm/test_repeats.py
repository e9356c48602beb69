"""The pipeline's repeats stage on passages of fifty words."""

import random

import numpy as np
from test_documents import covered

import corpus_pipeline


def test_fifty_word_passages_are_cut(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randrange(3, 8))) for _ in range(2000)]
    sentence = lambda n: " ".join(rng.choices(words, k=n))
    passages = [sentence(50) for _ in range(10)]
    texts = [f"{sentence(60)} {p} {sentence(40)}" for p in passages for _ in range(3)] + [sentence(100), None]
    assert all(250 <= len(p) < 400 for p in passages)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, docs, "").collect()}
    assert not any(p in (t or "") for p in passages for t in got.values())
    raw = [(t or "").encode() for t in texts]
    assert [got[i] or "" for i in range(len(raw))] == [np.frombuffer(t, np.uint8)[~m].tobytes().decode() for t, m in zip(raw, covered(raw, 250), strict=True)]
