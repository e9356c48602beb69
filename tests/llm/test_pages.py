"""Operators over pages, vectors and conversations, held against brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from cellforge.llm import chat_snapshots, sphere_cells, url_filter, warc, wrapper_html
from cellforge.llm.common import scratch
from cellforge.llm.queries import URL_RULES

PAGE = "<html><head><title>t</title><style>p{{}}</style></head><body><div id='site-header'>Site</div><nav><a href=1>x</a></nav><div class='cookie-notice'>We use cookies</div>{body}<div class='comment-list'><p>first!</p></div><footer>&copy; f</footer></body></html>"


def pages_rows():
    a = PAGE.format(body="<article><h1>Head&amp;line</h1><p><b>Some\n  bold<br>text<p>More <script>var x='</p>'</script>here</article>")
    return [
        (1, "http://A.example.com/en/7?x=http://b.net/de/", a), (2, "https://a.example.com/en/8/", a), (3, "https://x.net/de/1", a + "é"), (4, "https://example.net/de/80", None), (5, "no scheme example.com/en/", ""), (6, None, "<p>only"),
        (7, "http://notexample.com/en/7", "plain"), (8, "http://sub.org/es/?q#f", a), (8, "http://sub.org/es/?q#f", a), (None, "://COM/en/", "x" * 50_000), (9, "http://org:80/es/", "<<<>>> <div class=\"a>b\" '"), (10, "http://example.com/EN/7", a), (11, "http:///en/", "<table><tr><td>x"),
    ]


SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in pages_rows()], SCHEMA + ", host string, n long, key long").repartition(3)


def key(*values):
    return tuple(repr(v) for v in values)


def judged(url):
    import re

    m = re.search("(?s)://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), h + p, a) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


@pytest.mark.parametrize("most,inline", [(20_000, 512), (0, 512), (20_000, 0), (0, 0)])
def test_url_filter(spark, pages, monkeypatch, most, inline):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", most)
    monkeypatch.setattr(url_filter, "INLINE", inline)
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    got = url_filter.judge(pages, rules).collect()
    assert sorted(key(*r) for r in got) == sorted(key(r[0], *judged(r[1])) for r in pages_rows())
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) AS key")
    bloom, blocks = url_filter.bloom_filter(keys, 3000)
    probe = spark.range(20000).selectExpr("concat('k', id) AS key", "id < 3000 AS member").withColumn("block", url_filter._block("key", blocks)).join(bloom, "block")
    for i, m in enumerate(url_filter._masks("key")):
        probe = probe.where((probe[f"w{i}"].bitwiseAND(m)) == m)
    members, others = probe.where("member").count(), probe.where("NOT member").count()
    assert members == 3000 and others < 0.01 * 17000


@pytest.mark.parametrize("least", [0, 10])
def test_warc_round_trip(spark, pages, least):
    got = sorted(key(*r) for r in warc.round_trip(spark, pages, least).collect())
    rows = [(r[0], (r[2] or "").encode()) for r in pages_rows()]
    want, done = [], set()
    for i, (p, b) in enumerate(rows):
        same = [q for q, c in rows if c == b and q is not None]
        top = max(same, default=None)
        sha = base64.b32encode(hashlib.sha1(b).digest()).decode()
        first = p == top and b not in done
        done |= {b} if first else set()
        revisit = len([1 for _, c in rows if c == b]) > 1 and len(b) >= least and not first
        want.append(key(p, len(b), sha, "revisit" if revisit else "response", top if revisit else None))
        assert i >= 0
    assert got == sorted(want)


def test_warc_files_are_whole_archives(spark, pages):
    folder = scratch(spark, "warc-test")
    index = warc.write(warc.plan(pages), folder).collect()
    by_file = {}
    for r in index:
        by_file.setdefault(r.file, []).append((r.offset, r.length))
    ids, refers = [], set()
    for f, spans in by_file.items():
        data = open(f.removeprefix("file://"), "rb").read()
        at = 0
        for off, n in sorted(spans):
            fields, _ = warc.parse(zlib.decompress(data[off : off + n], 31))
            assert off == at and fields["warc-type"] in ("response", "revisit")
            at += n
            ids.append(fields["warc-record-id"])
            refers |= {fields["warc-refers-to"]} if fields["warc-type"] == "revisit" else set()
        assert at == len(data)
    assert len(ids) == len(set(ids)) == len(pages_rows()) and refers and refers <= set(ids)


def test_warc_ranges():
    assert list(warc.ranges([0, 10, 200_000], [10, 5, 7])) == [(0, 15, 0, 2), (200_000, 200_007, 2, 3)]
    assert list(warc.ranges([], [])) == []


def test_warc_reads_selected_records(spark, pages):
    index = warc.write(warc.plan(pages), scratch(spark, "warc-some"))
    got = warc.read(index.where("page_id IN (7, 9)")).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {7: "plain", 9: pages_rows()[10][2]}


def test_article_text(spark, pages):
    got = {(r.page_id, r.url): r for r in wrapper_html.extract(pages).collect()}
    assert len(got) == len(pages_rows()) - 1
    r = got[(2, "https://a.example.com/en/8/")]
    assert r.text == "Head&line Some bold text More here" and r.n_chars == len(r.text)
    assert got[(4, "https://example.net/de/80")].text == "" and got[(5, "no scheme example.com/en/")].text == ""
    assert got[(6, None)].text == "only" and got[(7, "http://notexample.com/en/7")].text == "plain"


def test_template_of_a_host_is_left_out():
    page = "<html><body><div class=top>Welcome to the site</div><div><div class=c><p>{}</p><p>Always the same line</p><p>{} &lt;b&gt;</p></div></div><div class=low>All rights reserved</div></body></html>"
    x, y = page.format("First words of one", "and its end"), page.format("Other words here", "something else at the end")
    assert wrapper_html.main_text(x, wrapper_html.learn([x, y])) == "First words of one and its end <b>"
    assert "Always the same line" in wrapper_html.main_text(x) and wrapper_html.learn([x]) is None
    longer = page.format("An inserted line</p><p>First words", "and its end")  # one more block in the row
    assert wrapper_html.main_text(longer, wrapper_html.learn([x, y])) == "An inserted line First words and its end <b>"


def test_rows_of_equal_blocks_with_one_more():
    page = "<html><body><div>" + "<p>{}</p><p>Same line {{}}</p>" * 12 + "</div></body></html>"
    x, y, z = (page.format(*(f"{n} body {i}" for i in range(12))).format(*range(12)) for n in ("one", "two", "three"))
    odd = z.replace("<div>", "<div><p>one paragraph more</p>")
    assert wrapper_html.main_text(odd, wrapper_html.learn([x, y, z])) == " ".join(["one paragraph more", *(f"three body {i}" for i in range(12))])


def test_template_lines_of_an_article_are_left_out():
    page = "<html><body><article><h1>{}</h1><p>Share this story now</p><p>{}</p><p>Read more on our site</p></article></body></html>"
    x, y, z = page.format("One head", "The first body of words, longer than the lines around it"), page.format("Two", "Quite another body"), page.format("Three", "A third")
    assert wrapper_html.main_text(x, wrapper_html.learn([x, y, z])) == "One head The first body of words, longer than the lines around it"
    assert "Share this story now" in wrapper_html.main_text(x)  # without alignment
    copy = x.replace("One head", "One head, again")
    assert wrapper_html.main_text(x, wrapper_html.learn([x, copy, copy.replace("again", "again!")])).startswith("One head Share this story now The first body")  # copies of one article
    assert "Share this story now" in wrapper_html.main_text(x, wrapper_html.learn([x, y]))  # two articles may share a line


def test_names_inside_and_around_an_article():
    page = "<body><div class='page-header'><article><h1 class='post-header'>Head</h1><div class='related'>Kin</div><p class='share'>Said</p><div class='ad'>Buy</div><section id='comments'><p>First!</p></section></article></div><div class='related'>More</div></body>"
    assert wrapper_html.main_text(page) == "Head Kin Said"


def test_deep_pairs_and_repeated_rows(spark):
    deep = lambda t: "<div>" * 3000 + f"<p>{t}</p><p>Every page has it</p>" + "</div>" * 3000
    rows = [(i, "http://h.org/", deep(f"words of page {i}")) for i in range(4)] + [(9, "http://k.org/", "<article>" + deep("text") + "</article>")]
    got = wrapper_html.extract(spark.createDataFrame(rows * 2, SCHEMA)).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted([*((i, f"words of page {i}") for i in range(4)), (9, "text Every page has it")] * 2)


def random_tree(rng, size):
    labels, texts, parents = ["r"], [""], [-1]
    for i in range(1, size):
        labels.append(rng.choice("ab"))
        texts.append(rng.choice(["", "x", "y", "z"]))
        parents.append(rng.randrange(max(0, i - 5), i))
    # page order: a node comes before what follows its parent
    kids = [[j for j in range(size) if parents[j] == i] for i in range(size)]
    order, work = [], [0]
    while work:
        n = work.pop()
        order.append(n)
        work += kids[n][::-1]
    return wrapper_html.Tree([labels[n] for n in order], [texts[n] for n in order], [order.index(parents[n]) if n else -1 for n in order])


@pytest.mark.parametrize("table", [1 << 22, 1])
def test_alignment_has_the_largest_weight(monkeypatch, table):
    monkeypatch.setattr(wrapper_html, "TABLE", table)
    rng = random.Random(6)

    def naive(x, y, a, b):
        if x.labels[a] != y.labels[b]:
            return 0
        m = [[0] * (len(y.kids[b]) + 1) for _ in range(len(x.kids[a]) + 1)]
        for i, u in enumerate(x.kids[a]):
            for j, v in enumerate(y.kids[b]):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + naive(x, y, u, v))
        return 1 + 2 * (x.texts[a] == y.texts[b] != "") + m[-1][-1]

    for _ in range(150):
        x = random_tree(rng, rng.randrange(1, 25))
        y = x if rng.random() < 0.1 else random_tree(rng, rng.randrange(1, 25))
        pairs = wrapper_html.align(x, y)
        at = dict(pairs)
        assert len(at) == len(pairs) == len(set(at.values())) and all(x.labels[i] == y.labels[j] for i, j in pairs)
        assert all(i == 0 or at[x.parents[i]] == y.parents[j] for i, j in pairs)
        assert [j for _, j in sorted(pairs)] == sorted(at.values())
        assert sum(1 + 2 * (x.texts[i] == y.texts[j] != "") for i, j in pairs) == naive(x, y, 0, 0)


def test_copies_at_both_ends_of_a_host(spark):
    page = "<html><body><div><div><p>{}</p><p>Always the same line</p></div></div></body></html>"
    rows = [(i, "http://h.org/", page.format(t)) for i, t in enumerate(["First words of one", "Other words here", "Third", "First words of one"])]
    got = {r.page_id: r.text for r in wrapper_html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: "First words of one", 1: "Other words here", 2: "Third", 3: "First words of one"}


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(sphere_cells, "CELL_ROWS", 40)
    monkeypatch.setattr(sphere_cells, "BLOCK", 16)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(150, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.04
    rows = [(i, [float(v) for v in x], 0) for i, x in enumerate(np.concatenate([base, near, near[:5]]))]
    chain = [(300 + i, [float(np.cos(0.25 * i)), float(np.sin(0.25 * i)), *[0.0] * 14], 1) for i in range(12)]
    odd = [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan"), *[1.0] * 15], 1), (403, [None, *[1.0] * 15], 1), (404, [float("inf"), *[1.0] * 15], 1), (405, [], 2), (406, [1.0, 2.0], 3), (407, [2.0, 4.0], 3), (None, rows[0][1], 0), rows[3], (408, [1e-30] * 16, 0), (409, [1e30] * 16, 0)]
    rows += chain + odd
    got = sphere_cells.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), margin=0.3163).collect()

    def unit(v):
        if v is None or not v or any(c is None for c in v) or not np.isfinite(v).all() or not np.any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    u = [unit(r[1]) for r in rows]
    link = [[i != j and u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= 0.95 for j in range(len(rows))] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        new = [min([root[i], *(root[j] for j in range(len(rows)) if link[i][j])]) for i in range(len(rows))]
        if new == root:
            break
        root = new
    first = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            first[root[i]] = min(first.get(root[i], r[0]), r[0])
    want = sorted(key(r[0], int(sum(link[i])), first.get(root[i]), first.get(root[i]) == r[0]) for i, r in enumerate(rows))
    assert sorted(key(*r) for r in got) == want
    assert sphere_cells.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_at_the_default_margin(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6000, 64))
    near = base[:1500] / np.linalg.norm(base[:1500], axis=1)[:, None] + rng.normal(size=(1500, 64)) * 0.038
    x = np.concatenate([base, near])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.95).sum() - len(u)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = sphere_cells.near_duplicates(df).agg({"n_links": "sum"}).first()[0]
    assert links > 500 and 0.99 * links <= found <= links


def test_no_pair_of_few_dimensions_is_missed(spark, monkeypatch):
    monkeypatch.setattr(sphere_cells, "CELL_ROWS", 20)
    angle = np.random.default_rng(6).uniform(0, 2 * np.pi, 400)
    x = np.stack([np.cos(angle), np.sin(angle), *[np.zeros(400)] * 14], axis=1)  # differences point straight at bisectors
    links = (x @ x.T >= 0.95).sum() - len(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert sphere_cells.near_duplicates(df).agg({"n_links": "sum"}).first()[0] == links


def test_chat(spark):
    rng = random.Random(1)
    convs = {i: [(rng.choice(["user", "assistant"]), rng.choice("abc")) for _ in range(rng.randrange(1, 5))] for i in range(60)}
    convs[60] = [("user", None), (None, "x")]
    convs[61] = [("user", ""), (None, "x"), ("user", "end")]
    convs[62] = convs[0] + [("user", "longer")]
    convs[63] = [("user", "t" * 100_000)] * 3
    rows = [(c, 1000 * t, *m, 5) for c, ms in convs.items() for t, m in enumerate(ms)] + [(None, 0, "user", "null conv", 5), (70, None, "system", "s", 5), (70, 1, "user", "u", 5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long").repartition(3)
    got = {r.conv_id: r for r in chat_snapshots.render(turns).collect()}
    convs[None], convs[70] = [("user", "null conv")], [("system", "s"), ("user", "u")]
    keep = [c for c, m in convs.items() if not any((len(o) > len(m) and o[: len(m)] == m) or (o == m and c is not None and k is not None and k < c) for k, o in convs.items())]
    assert sorted(map(str, got)) == sorted(map(str, keep))
    assert got[70].rendered == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n" and got[70].n_turns == 2
    assert chat_snapshots.render(turns.limit(0)).count() == 0


def test_empty_pages(spark, pages):
    none = pages.limit(0)
    assert warc.round_trip(spark, none).count() == 0 and wrapper_html.extract(none).count() == 0


def test_conversations_that_repeat_and_odd_keys(spark):
    rows = [("null", 1, "user", "a", 9), ("null", 2, "bot", "b", 9), (None, 1, "user", "a", 9), (None, 2, "bot", "c", 9), ("x", 1, "user", "a", 9), ("x", 1, "user", "a", 9), ("y", 1, "user", "a", 9)]
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, at long")
    got = sorted((repr(r.conv_id), r.n_turns) for r in chat_snapshots.render(turns).collect())
    # y is a prefix of the others; the rows of x that repeat are two turns
    assert got == [("'null'", 2), ("'x'", 2), ("None", 2)]


def test_urls_of_an_empty_table(spark):
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    assert url_filter.judge(spark.createDataFrame([], SCHEMA), rules).count() == 0


def test_very_many_equal_vectors(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(5000)] + [(5000, [1.0, 0.01], 0), (5001, [0.0, 1.0], 0)]
    got = {r.vec_id: r for r in sphere_cells.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert (got[0].n_links, got[5000].n_links, got[5001].n_links) == (5000, 5000, 0) and got[5000].component_id == 0 and got[5001].kept
