"""Jaccard near-duplicates of the pipeline, held against brute force over all pairs."""

import random

import pytest

import corpus_pipeline
from cellforge.llm import near_text


def rows():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(500)]
    out = []
    for _ in range(40):
        base = rng.choices(words, k=rng.randrange(4, 250))
        out.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.04, 0.06):
            out.append(" ".join(rng.choice(words) if rng.random() < share else w for w in base))
    base = rng.choices(words, k=200)  # one passage's many copies, and a line that many texts have
    line = " ".join(rng.choices(words, k=40))
    out += [" ".join(rng.choice(words) if rng.random() < 0.01 else w for w in base) for _ in range(60)]
    out += [" ".join(rng.choices(words, k=rng.randrange(8, 60))) + " " + line for _ in range(60)]
    out += [None, "", " \n", "Two words", "two  WORDS", "other words"]
    rng.shuffle(out)
    return [*enumerate(out), (None, out[0]), (0, out[0]), (None, "alone " + out[1])]


def grams(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def words_of(text):
    return (text or "").lower().split()


@pytest.mark.parametrize("common,bucket", [(3, 16), (1, 2), (10_000, 100)])
def test_near_dedup_links_all_pairs_of_0_8(spark, monkeypatch, common, bucket):
    monkeypatch.setattr(near_text, "COMMON", common)
    monkeypatch.setattr(near_text, "BUCKET", bucket)
    data = rows()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    sets = [grams(t) for _, t in data]
    near = [[j for j, b in enumerate(sets) if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)) > 0] for a in sets]
    root = list(range(len(data)))
    while (new := [min(root[j] for j in n) for n in near]) != root:
        root = new
    least = {}
    for r, (i, _) in zip(root, data, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted({(repr(i), t) for r, (i, t) in zip(root, data, strict=True) if least[r] == i}, key=repr)
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted([(repr(r.doc_id), r.text) for r in got], key=repr) == want
    assert 100 < len(want) < len(data) - 150


def test_common_shingles_are_counted_in_all_texts(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(near_text, "SAMPLE", 50, raising=False)
    texts = [t for _, t in rows()]
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string").repartition(3)
    want = Counter(s for t in texts for s in near_text.shingles((t or "").encode()).tolist())
    s, n = near_text._common(docs, 5)
    assert dict(zip(s.tolist(), n.tolist(), strict=True)) == {k: v for k, v in want.items() if v >= near_text.COMMON}
