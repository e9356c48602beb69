"""Operators over documents, held against brute force on texts with all the odd cases."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cellforge.llm import byte_bpe, positional_index, rule_quality, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, d long, h string, n long, spans string, stats string"


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghéß") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = sentence(120), sentence(400)
    out = [None, "", " \n\t ", "one", "two words", base, base, base, base + " tail", "Head " + base, passage, sentence(30) + " " + passage, passage + " " + sentence(50), "the " * 400, "ab " * 300 + sentence(20), "ab " * 260, "x" * 500, "x" * 401 + "y" * 500]
    out += [sentence(rng.randrange(1, 200)) for _ in range(30)]
    out += [sentence(10) + passage[200:1000] + sentence(8) for _ in range(12)]
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    out = [(i, x, "en", "s", len(x or ""), "f", 1, "h", 2, "z", "s") for i, x in enumerate(t)]
    return [*out, out[5], out[0], (None, t[5], None, None, None, None, None, None, None, None, None), (None, None, *[None] * 9), (3, "other text of a taken id", *[None] * 9)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(*values):
    return tuple(repr(v) for v in values)


def covered(texts, least):
    seen = {}
    for t in texts:
        for i in range(len(t) - least + 1):
            k = t[i : i + least]
            seen[k] = seen.get(k, 0) + 1
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                m[i : i + least] = True
        out.append(m)
    return out


def expected_removals(rows, least=400):
    raw = [(r[1] or "").encode() for r in rows]
    for r, t, m in zip(rows, raw, covered(raw, least), strict=True):
        runs = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        yield key(r[0], len(t), int(m.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest())


@pytest.mark.parametrize("group", [4000, 3])
def test_repeats_are_removed_exactly(docs, rows, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)  # small: the counted windows do the work
    found = suffix_dedup.removals(docs).collect()
    got = [key(*r[:5]) for r in found]
    assert sorted(got) == sorted(expected_removals(rows))
    assert all(len(r.text.encode()) <= r.n_bytes - r.n_removed <= len(r.text.encode()) + 6 * r.n_spans for r in found)


def test_reach_before_an_anchor_stays_where_others_share_only_what_follows():
    contexts = [b"1xy_anchored", b"2xy_anchored", b"3xy-anchored"]
    left, right = suffix_dedup.repeat_reach(np.zeros(3, np.int64), np.full(3, 4), contexts, 8, 4)
    assert (left.tolist(), right.tolist()) == ([3, 3, 0], [8, 8, 8])


def test_contexts_that_end_in_zero_bytes_are_sorted_with_their_lengths():
    contexts = [b"1_anch\0\0", b"2_anch", b"3_anch\0\0"]
    left, right = suffix_dedup.repeat_reach(np.zeros(3, np.int64), np.full(3, 2), contexts, 7, 4)
    assert (left.tolist(), right.tolist()) == ([1, 0, 1], [6, 0, 6])
    contexts = [b"\0\0_anch1", b"_anch2", b"\0\0_anch3"]
    left, right = suffix_dedup.repeat_reach(np.zeros(3, np.int64), np.array([3, 1, 3]), contexts, 7, 4)
    assert (left.tolist(), right.tolist()) == ([3, 0, 3], [4, 0, 4])


@pytest.mark.parametrize("gram", [64, 128])
def test_a_run_is_found_whatever_stands_around_it(gram):
    rng = random.Random(3)
    word, up, _ = suffix_dedup._tables()
    for period in (1, 3, gram // 4 - 1, gram // 4):
        unit = bytes(rng.sample(range(1, 256), period))
        run = (unit * gram)[:gram]
        for _ in range(50):
            buffer = np.frombuffer(b"\0" + rng.randbytes(100) + b"\0" + run + b"\0" + rng.randbytes(100), np.uint8)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word[buffer] * up[: len(buffer)], dtype=np.uint64)])
            assert suffix_dedup.periodic_runs(buffer, sums, gram) == [(102, 102 + gram)]


def naive_repeats(texts, least):
    """Each repeated string of `least` bytes or more that no byte on a side extends in all its places, with these places."""
    places, found = {}, {}
    for d, t in enumerate(texts):
        for i in range(len(t) - least + 1):
            places.setdefault(t[i : i + least], []).append((d, i))
    work = [(w, p) for w, p in places.items() if len(p) > 1]
    while work:
        s, p = work.pop()
        sides = [{}, {}]
        for d, i in p:
            t = texts[d]
            for side, at in ((0, i - 1), (1, i + len(s))):
                sides[side].setdefault(t[at : at + 1] if 0 <= at < len(t) else (d, i), []).append((d, i))
        if len(sides[1]) > 1:
            if len(sides[0]) > 1:
                found[s] = sorted(p)
            work += [(s + b, q) for b, q in sides[1].items() if isinstance(b, bytes) and len(q) > 1]
        else:
            (b, q), = sides[1].items()
            if isinstance(b, bytes):
                work.append((s + b, q))
        # a string that all places extend to the left is met from there
    return found


@pytest.mark.parametrize("group", [4000, 2])
def test_maximal_repeats_are_listed_with_all_places(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(4)
    part = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    least, shared = 60, [part(n) for n in (60, 66, 75, 90)]
    texts = [part(50) + rng.choice(shared) + part(rng.randrange(40)) for _ in range(24)]
    texts += [f"{part(9)}{shared[2]}{part(7)}{shared[2]}", "Q" + shared[3][5:80] + "Z", "R" + shared[3][5:80] + "Z", part(10)]
    raw = [t.encode() for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {}
    for r in suffix_dedup.maximal_repeats(docs, least, 16).collect():
        got.setdefault((r["repeat"], r.length), []).append((r.doc_id, r.start))
    naive = naive_repeats(raw, least)
    listed = {}
    for (_, n), p in got.items():
        strings = {raw[d][i : i + n] for d, i in p}
        assert len(strings) == 1 and n >= least
        listed.setdefault(strings.pop(), set()).update(p)
    every = lambda s: {(d, i) for d, t in enumerate(raw) for i in range(len(t) - len(s) + 1) if t.startswith(s, i)}
    assert all(len(p) > 1 and p <= every(s) for s, p in listed.items())
    if group > 2:
        # strings that are no longer than contexts reach, with all their places
        short = {s: p for s, p in naive.items() if len(s) <= 60 + 16}
        assert short and all(listed.get(s) == set(p) for s, p in short.items())
    windows = {raw[d][i : i + least] for s, p in naive.items() for d, j in p[:1] for i in range(j, j + len(s) - least + 1)}
    assert all(any(w in s and every(w) <= {(d, i + s.index(w)) for d, i in p} for s, p in listed.items()) for w in windows)


def test_long_text_and_cut(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 20_000)
    suffix_dedup._tables.cache_clear()
    rng = random.Random(1)
    long = "".join(rng.choice("abcd éx") for _ in range(70_000))
    rows = [(1, long), (2, long[30_000:31_000] + "Q"), (3, "z" * 50_000), (4, "short")]
    got = {r.doc_id: r for r in suffix_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    suffix_dedup._tables.cache_clear()
    assert got[1].n_removed == len(long[30_000:31_000].encode()) and got[1].n_spans == 1
    assert got[2].n_removed == got[1].n_removed and got[3].n_removed == 50_000 and got[4].n_removed == 0


def test_cut_keeps_columns(docs):
    cut = suffix_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns
    got = cut.where("doc_id = 4").collect()
    assert [r.text for r in got] == ["two words"] and cut.count() == docs.count()


def test_intervals():
    assert list(suffix_dedup.prefix_intervals([0, 3, 5, 5, 2, 0, 4])) == [(5, 1, 3), (3, 0, 3), (2, 0, 4), (4, 5, 6)]


def naive_fingerprint(text):
    from xxhash import xxh64_intdigest

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    h = [xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(len(words) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [64, 1])
def test_simhash(docs, rows, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    fps = [naive_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in range(len(rows)) if bin(fps[i] ^ fps[j]).count("1") <= 2) for i in range(len(rows))]
    names = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            names[root[i]] = min(names.get(root[i], r[0]), r[0])
    want = sorted(key(r[0], f"{f:016x}", names.get(root[i])) for i, (r, f) in enumerate(zip(rows, fps, strict=True)))
    assert sorted(key(*r) for r in simhash.near_duplicates(docs).collect()) == want


def test_simhash_links_within_two_bits(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base]
    hot = [base[0] ^ (1 << i) ^ (1 << j) for i in range(14) for j in range(i)]  # one crowded bucket
    all_fps = sorted({*base, *near, *hot})
    signed = [f - (1 << 64) if f >> 63 else f for f in all_fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    parent = {f: f for f in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
        parent[find(a)] = find(b)
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
                assert find(a) == find(b)


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(5) == 1 and 6 not in ids and 7 not in ids


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_positional_index(spark, docs, rows):
    t = texts()
    items = [(1, " ".join(t[10].split()[5:30]).upper().replace("É", "é")), (2, "never seen anywhere at all in any of these texts of ours"), (3, t[21]), (3, t[21]), (4, "one"), (5, None), (6, "..."), (None, t[24]), (10, "The, the; THE")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, d string")
    want = []
    for r in rows:
        w = words_of(r[1])
        hit, ids = set(), set()
        for item, text in {(i, x) for i, x in items}:
            iw = words_of(text)
            n = min(10, len(iw))
            for s in range(len(iw) - n + 1) if iw else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[s : s + n]:
                        hit |= set(range(p, p + n))
                        ids |= {str(item)} if item is not None else set()
        want.append(key(r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    got = positional_index.decontaminate(docs, bench).drop("hit_ranges").collect()
    assert sorted(key(*r) for r in got) == sorted(want)


def test_many_hits_of_one_word(spark):
    rows = [(1, "one two " * 6000), (2, " one, ONE"), (3, "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, "One"), (8, "three")], "item_id long, text string")
    got = {r.doc_id: r for r in positional_index.decontaminate(docs, items, slop=3).collect()}
    assert (got[1].n_hit, len(got[1].hit_ranges)) == (6000, 6000) and got[1].hit_ranges[1] == (2, 3)
    assert (got[2].n_hit, got[2].hit_ranges) == (2, [(0, 2)]) and not got[3].contaminated and got[1].n_near == 0


def test_near_items_against_all_pairs(spark, docs, rows):
    t = texts()
    items = [(1, t[10]), (2, "one two"), (3, " ".join(t[20].split()[:4])), (4, "never said"), (None, t[21])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    said = {}
    for r in rows:
        for w in words_of(r[1]):
            said[w] = said.get(w, 0) + 1
    want = []
    for r in rows:
        at = {}
        for i, w in enumerate(words_of(r[1])):
            at.setdefault(w, []).append(i)
        n = 0
        for item, text in items:
            two = sorted({w for w in words_of(text) if w in said}, key=lambda w: (said[w], w.encode()))[:2]
            n += item is not None and len(two) == 2 and any(abs(p - q) <= 6 for p in at.get(two[0], ()) for q in at.get(two[1], ()))
        want.append(key(r[0], len(words_of(r[1])), n))
    got = positional_index.decontaminate(docs, bench, slop=6).select("doc_id", "n_words", "n_near").collect()
    assert sorted(key(*r) for r in got) == sorted(want) and any(r.n_near for r in got)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x y beta z z z z z z"), (2, "beta alpha"), (3, "alpha " + "z " * 30 + "beta"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "Alpha beta z")], "item_id long, text string")
    assert sorted(tuple(r) for r in positional_index.proximity(docs, items, 5).collect()) == [(1, 7), (2, 7)]


def test_byte_bpe_matches_the_reference_library(docs, rows):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in rows:
        ids = own.encode_ordinary(r[1] or "")
        want.append(key(r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()
    assert sorted(key(*r) for r in got) == sorted(want)


def test_byte_bpe_offsets(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    odd = "naïve 日本 🙂 <|endoftext|>  \n\n's" + "é" * 200
    d = spark.createDataFrame([(1, odd, 5), (2, None, 6)], "doc_id long, text string, ids int")
    enc = byte_bpe.encode(d, path, public_tokenizers.PATTERN)
    both = byte_bpe.decode(enc, path, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert bytes(both[0].decoded).decode() == odd and both[1].ids == [] and both[0].ends[-1] == len(odd)
    assert all(s < e for s, e in zip(both[0].starts, both[0].ends, strict=True))


def test_quality_is_learnt_and_held_out(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8)))
    good = lambda: " ".join(word() for _ in range(rng.randrange(20, 200))) + "."
    bad = lambda: " ".join([word().upper() + "!!"] * rng.randrange(20, 80))
    data = [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(1200)]
    docs = spark.createDataFrame([(a, b) for a, b, _ in data] + [(5000, None), (5001, ""), (None, "null id")], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in data] + [(5000, None), (9999, 1)], "doc_id long, quality int")
    model = rule_quality.fit(docs, labels)
    got = rule_quality.score(docs, model).select("doc_id", rule_quality.fold().alias("f"), "score").collect()
    assert len(got) == 1203 and all(0 <= r.score <= 1 for r in got)
    truth = {a: c for a, _, c in data}
    held = [r for r in got if r.f == 2 and r.doc_id in truth]
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 4 for r in held)
    assert sum((r.score >= 0.7) == bool(truth[r.doc_id]) for r in held) > 0.97 * len(held)


def test_quality_without_labels(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert rule_quality.fit(docs, labels).rules == ()
    assert rule_quality.score(none, rule_quality.fit(none, labels)).count() == 0


def test_empty_tables(spark, none):
    import public_tokenizers

    bench = spark.createDataFrame([], "item_id long, text string")
    assert suffix_dedup.removals(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert positional_index.decontaminate(none, bench).count() == 0
    assert byte_bpe.round_trip(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_no_items(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert positional_index.decontaminate(docs, bench).where("contaminated").count() == 0


def test_text_over_a_mebibyte(spark):
    rng = random.Random(3)  # nothing patched: Python workers split it where the parts overlap
    long = "".join(rng.choices("abcdefgh xyz", k=2_500_000))
    at = suffix_dedup.CHUNK_BYTES - 2_000
    rows = [(1, long), (2, "Q" + long[at : at + 700] + "Q")]
    got = {r.doc_id: r for r in suffix_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (700, 1) and got[2].n_removed == 700
    assert {r.doc_id: len(r.text) for r in suffix_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 2_499_300, 2: 2}


def test_dotted_and_clashing_columns(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, "some text", "x", 5, "q", [9]), (2, None, None, None, None, None)], "doc_id long, text string, `a.b` string, stats int, score string, ids array<int>")
    got = rule_quality.score(docs, rule_quality.Model(0.0, ()))
    assert got.columns == ["doc_id", "text", "a.b", "ids", "score"] and [r[2] for r in got.orderBy("doc_id").collect()] == ["x", None]
    coded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "text", "a.b", "stats", "score", "ids", "starts", "ends"]
    back = byte_bpe.decode(coded.withColumnRenamed("ids", "decoded"), path, public_tokenizers.PATTERN, ids="decoded")
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == {1: b"some text", 2: b""}
    assert byte_bpe.encode(docs.limit(0), path, public_tokenizers.PATTERN).count() == byte_bpe.decode(coded.limit(0), path, public_tokenizers.PATTERN).count() == 0


def quality_rows(n):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(200)]
    good = lambda: " ".join(rng.choices(words, k=rng.randrange(20, 200))).capitalize() + "."
    bad = lambda: " ".join(w.upper() + rng.choice(["!!", "$$", " |", ""]) for w in rng.choices(words[:20], k=rng.randrange(5, 300)))
    return [(i, good() if i % 3 else bad(), int(i % 3 > 0) if i % 17 else int(i % 3 == 0)) for i in range(n)]


def test_fit_does_not_depend_on_order_and_column_equals_arrays(spark):
    rows = quality_rows(900)
    rows += rows[:40] + [(5, "another text of a taken id", 1), (6, None, 0), (7, "word " * 60_000, 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    models = [rule_quality.fit(docs.repartition(n), labels.repartition(m), 500) for n, m in ((1, 4), (5, 1))]
    assert models[0] == models[1] and models[0].rules
    scored = rule_quality.with_statistics(docs).withColumn("score", models[0].column()).select("stats.*", "score").toPandas()
    assert np.abs(models[0].score(scored[list(rule_quality.STATS)].to_numpy(float)) - scored["score"].to_numpy()).max() < 1e-12


def test_fit_takes_all_labelled_rows(spark):
    rows = quality_rows(900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    x, y = np.array([rule_quality.statistics(t.encode()) for _, t, _ in known]), np.array([float(q) for *_, q in known])
    paths = rule_quality._paths(x, y)
    b, w = rule_quality._lasso(np.stack([rule_quality._holds(x, p) for p in paths], 1).astype(float), y)
    want = rule_quality.Model(b, tuple((float(a), p) for a, p in zip(w, paths, strict=True) if abs(a) > 1e-9))
    got = rule_quality.fit(docs, labels, 100)
    assert got.rules and np.abs(got.score(x) - want.score(x)).max() < 1e-6


@pytest.mark.parametrize("n", [1, 7, 500])
def test_thresholds_are_quantiles_of_all_rows(n):
    rng = np.random.default_rng(n)
    x = np.stack([rng.random(n), np.exp(rng.normal(0, 4, n)), rng.integers(0, 5, n).astype(float), rng.normal(0, 3, n), np.zeros(n)], 1)
    parts = np.array_split(x, 3)
    cuts = rule_quality._cuts(lambda f: sum(f(p, p[:, 0]) for p in parts), n, 5)
    for c, v in zip(cuts, x.T, strict=True):
        want = np.unique(np.quantile(v.astype(np.float32), np.linspace(0, 1, rule_quality.BINS + 1)[1:-1]))
        assert len(c) <= rule_quality.BINS - 1 and all(np.abs(want - a).min() <= 3e-7 * max(abs(a), 1e-30) for a in c) and all(np.abs(c - a).min() <= 3e-7 * max(abs(a), 1e-30) for a in want)


def test_lasso_is_at_its_optimum():
    rng = np.random.default_rng(3)
    r = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * r[:, 0] - 2 * r[:, 1] + 0.2)))).astype(float)
    b, w = rule_quality._lasso(r, y)
    grad = r.T @ (1 / (1 + np.exp(-(r @ w + b))) - y) / len(y)
    assert np.abs(grad[w != 0] + rule_quality.LASSO * np.sign(w[w != 0])).max() < 1e-6
    assert np.abs(grad).max() <= rule_quality.LASSO + 1e-6 and abs((1 / (1 + np.exp(-(r @ w + b))) - y).mean()) < 1e-6


def test_paths_split_as_a_search_over_all_thresholds():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 30, (300, 3)).astype(float)
    y = (x[:, 1] > 14).astype(float)
    first = min(rule_quality._paths(x, y), key=len)
    p = np.full(300, (y.mean() + 1e-3) / (1 + 2e-3))
    p = 1 / (1 + np.exp(-np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
    g, h = y - p, p * (1 - p) + 1e-6

    def gain(s, t):
        left = x[:, s] <= t
        if not rule_quality.LEAST_ROWS <= left.sum() <= 300 - rule_quality.LEAST_ROWS:
            return -1
        part = lambda m: g[m].sum() ** 2 / (h * m.sum() + 1)
        return part(left) + part(~left) - part(np.ones(300, bool))

    best = max((gain(s, t), s, t) for s in range(3) for t in np.unique(x[:, s]))
    assert (first[0][0], first[0][2]) == best[1:]


@pytest.mark.parametrize("what", ["labels", "documents", "benchmark", "one class"])
def test_pipeline_with_an_empty_table(spark, tmp_path, what):
    import corpus_pipeline

    rows = [(i, f"words of document {i} " * (i + 1), "en", "s", None) for i in range(12)] + [(None, None, None, None, None), (3, "", None, "s", 0)]
    labels = [] if what == "labels" else [(i, 1 if what == "one class" else i % 2, 0) for i in range(12)]
    bench = [] if what == "benchmark" else [(1, "document 5 words of document 5 words of document 5"), (2, None)]
    for name, data, schema in (("documents", [] if what == "documents" else rows, "doc_id long, text string, lang string, source string, n_chars long, score double"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame([(*r, 1.0) if name == "documents" else r for r in data], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and (out.count() == 0) == (what == "documents")
    if what in ("labels", "one class"):
        kept = corpus_pipeline.quality(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
        assert kept.count() == len(rows) and kept.columns == list(corpus_pipeline.COLUMNS)
