"""Operators against brute force, exact round trips or held-out accuracy; nulls, empty tables and clashing columns."""

import itertools
import math
import random
import re
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest

from grafspan.llm import common, decontaminate, html_extract, language, lm_scoring, perplexity, piece_sampling, quality, token_files, url_filter

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def docs(tables):
    return {r.doc_id: r for r in tables("documents").collect()}


#: Rows with nulls in any column, ties, repeats and odd texts; columns that clash with names used inside.
ODD = [
    (1, "The cat sat on the mat, and the dog sat on the cat. " * 3, "en", "a", 5, "k"), (1, "The cat sat on the mat, and the dog sat on the cat. " * 3, "en", "a", 5, "k"), (None, "Ein Text ohne Nummer und mit Wörtern", "de", None, None, None),
    (2, None, None, None, None, None), (3, "", "en", "", 0, ""), (4, " \n\t ", "fr", "b", 3, "k"), (5, "\x00 \x01 ▁▁ \U0001f600 é ﬁ", None, "c", 9, "k"), (6, "x", "es", "d", 1, "k"), (7, "word " * 40_000, "en", "e", 200_000, "k"), (8, "12345 !!! ###", "en", "f", 13, "k"),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


def test_intermediate_tables_are_removed_on_demand(spark):
    import os

    kept = common.store(spark.range(3), "x")
    folder = common.work_dir(spark).removeprefix("file://")
    assert kept.count() == 3 and any(n.startswith("x-") for n in os.listdir(folder))
    # the tests' own session goes on to use the folder: another name is removed here
    other = "file://" + folder + "-other"
    os.makedirs(folder + "-other/y")
    original, common.work_dir = common.work_dir, lambda s: other
    try:
        common.clean(spark)
    finally:
        common.work_dir = original
    assert not os.path.exists(folder + "-other") and kept.count() == 3


# ---------------------------------------------------------------- 1
def test_url_filter_rules(spark):
    rules = url_filter.build_digest_array(spark.createDataFrame([*url_filter.RULES, (None, "x.y/"), ("allow", None)], "kind string, pattern string"))
    blocked = url_filter.build_digest_array(spark.createDataFrame([("block", "bad.example/"), ("block", "bad.example/")], "kind string, pattern string"))
    cases = {
        "https://example.org/es/a": ("example.org", "/es/a", "example.org/es/", "block"), "https://WWW.Example.ORG/en/17?q=/es/": ("www.example.org", "/en/17", "example.org/en/1", "block"), "http://a.org/x": ("a.org", "/x", "org/", "allow"), "http://org": ("org", "", None, "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "ftp://a.com/de/x#y": ("a.com", "/de/x", "com/de/", "block"), "http://a.com/fr/": ("a.com", "/fr/", "com/fr/", "allow"), "http://bad.example/": ("bad.example", "/", None, "block"), "http://x.bad.example?": ("x.bad.example", "", None, "allow"),
        "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://a.com:8/de/": ("a.com:8", "/de/", None, "allow"), "x://http://org/": ("http:", "//org/", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules, blocked).collect()}
    assert got == dict(enumerate(cases.values()))
    assert url_filter.judge_urls(pages.limit(0), rules, blocked).collect() == []


def test_url_digest_collisions_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: len(s))
    shard = [(len(p), p, k) for p, k in (("aa.x/", "block"), ("bb.x/", "allow"))]
    uri = f"file://{tempfile.mkdtemp()}/s.keys"
    common.put_file(uri, url_filter._shard_bytes(sorted(shard)))
    assert url_filter.Shard(uri).probe(np.array([5, 5, 5], np.uint64), ["bb.x/", "cc.x/", "aa.x/"]) == {"bb.x/": "allow", "aa.x/": "block"}


def test_urls_by_a_blocklist_of_many_shards(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARD_ROWS", 500)
    rng = random.Random(7)
    hosts = sorted({f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}.{rng.choice(['net', 'co.uk', 'io'])}" for _ in range(6000)})
    patterns = [h + "/" for h in hosts[:4000]] + [h + f"/p{k}" for k, h in enumerate(hosts[4000:5000])]
    blocked = url_filter.build_digest_array(spark.createDataFrame([("block", p) for p in patterns], "kind string, pattern string"))
    assert len(blocked) > 5 and len({m["low"] for m in blocked}) == len(blocked)
    rules = url_filter.build_digest_array(spark.createDataFrame([], "kind string, pattern string"))
    urls = [f"http://{'www.' * rng.randint(0, 1)}{h}/p{rng.randrange(1200)}/x" for h in rng.sample(hosts, 1500)]

    def brute(url):
        host, path = url_filter.split_url(url)
        parts = host.split(".")
        return any(f"{'.'.join(parts[i:])}{path[:n]}" in wanted for i in range(len(parts)) for n in range(1, len(path) + 1))

    wanted = set(patterns)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, rules, blocked).collect()}
    assert got == {k: "block" if brute(u) else "allow" for k, u in enumerate(urls)}
    assert 0 < sum(v == "block" for v in got.values()) < len(urls)


# ---------------------------------------------------------------- 2
def brute_windows(text, items):
    ws = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    words = ws(text)
    hit, found = set(), set()
    for item, body in items:
        w = ws(body)
        wins = {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
        for win in wins:
            for i in range(len(words) - len(win) + 1):
                if tuple(words[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    pool = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 2, 5, 13, 20, 40])))) for k in range(40)] + [(90, None), (91, "..."), (0, "repeated id with another text of words")]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    for k in range(0, 60, 3):
        texts[k] += " " + rng.choice(items[:40])[1].upper() + ", tail"
    texts += [None, "", "!!"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (4 << 20, 300):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = {r._row.doc_id: (r.n_words, sum(s.b - s.a for s in r.spans), r["items"]) for r in decontaminate.find_windows(docs, bench).collect()}
        want = {k: brute_windows(t, items) for k, t in enumerate(texts)}
        assert got == want
        clean = {r.doc_id for r in decontaminate.remove_contaminated(docs, bench).collect()}
        assert clean == {k for k, (n, h, _) in want.items() if not (h and 20 * h >= n)}


def test_decontamination_query_against_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(map(tuple, decontaminate.op2_decontaminate(spark, sf).collect())) == sorted(con.execute(decontaminate.op2_sql()).fetchall())


def test_decontamination_by_a_huge_item_and_equal_windows():
    import pyarrow as pa

    huge = " ".join(f"u{k}" for k in range(2_500_000))
    items = [("huge", huge.encode()), *[(f"same{k}", b"one two three four") for k in range(50)], ("one", b"u7"), ("rare", " ".join(f"u{k}" for k in range(100, 113)).encode())]
    index = decontaminate.Index(pa.py_buffer(decontaminate.index_bytes(items)))
    texts = [" ".join(f"U{k}" for k in range(2_400_000, 2_400_020)).encode(), b"zero ONE-two three, four", b"u7 x u8", " ".join(f"u{k}" for k in range(95, 115)).encode(), b"", b"one two three"]
    words = common.Words(texts, common.ALNUM_WORDS)
    spans, found = [[] for _ in texts], [set() for _ in texts]
    index.find(words, words.hashes(), texts, spans, found)
    assert [decontaminate._merged(s) for s in spans] == [[(0, 20)], [(1, 5)], [(0, 1)], [(0, 20)], [], []]
    assert found == [{"huge"}, {f"same{k}" for k in range(50)}, {"one"}, {"huge", "rare"}, set(), set()]


def test_decontamination_opens_many_blocks_one_after_the_other(spark, monkeypatch):
    bench = spark.createDataFrame([(k, f"a{k} b{k} c{k} d{k}") for k in range(60)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"x a{k} b{k} c{k} d{k} y") for k in range(0, 80, 3)], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    for held in (decontaminate.HELD_BYTES, 0):
        monkeypatch.setattr(decontaminate, "HELD_BYTES", held)
        assert {r._row.doc_id: r["items"] for r in decontaminate.find_windows(docs, bench).collect()} == {k: [str(k)] if k < 60 else [] for k in range(0, 80, 3)}


def test_decontamination_of_empty_tables(spark, odd, empty, tables):
    bench = tables("benchmark")
    assert decontaminate.remove_contaminated(empty, bench).collect() == []
    assert decontaminate.remove_contaminated(odd, bench.limit(0)).count() == len(ODD)
    assert decontaminate.remove_contaminated(odd, bench).columns == odd.columns


# ---------------------------------------------------------------- 3, 4
def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op3_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert all(r.held_out == (crc(i) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    assert sum(a == b for a, b in held) / len(held) > 0.85


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in language.op4_language(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()
    held = [(got[r.doc_id].lang_pred, r.lang) for r in docs if got[r.doc_id].held_out and r.lang and r.text]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    assert all((got[r.doc_id].lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in docs)


def test_numbers_are_no_letters(spark):
    for text, yes in (("½ ² 12 ٣ Ⅷ ①", False), ("½ x", True), ("日", True), ("", False), ("_ - !", False)):
        assert language.has_letter(text.encode()) == yes, text


def test_follow_the_leader_against_plain_loops():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(1 << language.BITS, 6, replace=False)), rng.random(6), int(rng.integers(3))) for _ in range(40)]
    rows += [(rows[k][0], rng.random(6), rows[k][2]) for k in range(20)]
    model = language.Model(["a", "b", "c"], np.ones(1 << language.BITS))
    language.ftrl(rows, model)

    z, n, zb, nb = {}, {}, [0.0] * 3, [0.0] * 3

    def solve(z, n, l1):
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((language.BETA + math.sqrt(n)) / language.ALPHA + language.L2)

    order = np.random.Generator(np.random.PCG64(3))
    for _ in range(language.EPOCHS):
        for r in order.permutation(len(rows)):
            at, v, y = rows[r]
            w = {(c, k): solve(z.get((c, k), 0.0), n.get((c, k), 0.0), language.L1) for c in at.tolist() for k in range(3)}
            b = [solve(zb[k], nb[k], 0.0) for k in range(3)]
            logit = [sum(x * w[c, k] for c, x in zip(at.tolist(), v, strict=True)) + b[k] for k in range(3)]
            e = [math.exp(x - max(logit)) for x in logit]
            g0 = [x / sum(e) - (k == y) for k, x in enumerate(e)]
            for c, x in zip(at.tolist(), v, strict=True):
                for k in range(3):
                    g, old = x * g0[k], n.get((c, k), 0.0)
                    z[c, k] = z.get((c, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / language.ALPHA * w[c, k]
                    n[c, k] = old + g * g
            for k in range(3):
                zb[k] += g0[k] - (math.sqrt(nb[k] + g0[k] ** 2) - math.sqrt(nb[k])) / language.ALPHA * b[k]
                nb[k] += g0[k] ** 2
    want = {c: solve(z[c], n[c], language.L1) for c in z}
    assert 0 < sum(x == 0 for x in want.values()) and len(model.values) == sum(x != 0 for x in want.values())
    for at, v, _ in rows:
        plain = [sum(x * want[c, k] for c, x in zip(at.tolist(), v, strict=True)) + solve(zb[k], nb[k], 0.0) for k in range(3)]
        assert np.allclose(model.logits(at, v), plain, atol=1e-5)


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGS", 3)
    docs = spark.createDataFrame([(k, f"{'abcdefgh'[k % 8] * 4} word {k % 8}", f"l{k % 8 if k % 8 < 3 or k < 40 else 0}") for k in range(400)], "doc_id long, text string, lang string")
    assert language.fit(docs).langs == ["l0", "l1", "l2"]


def test_ridge_against_a_direct_solve(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect() if r.doc_id in known and r.text is not None}

    def rows(part):
        ids = [i for i in texts if crc(i) % 3 == part]
        return quality.statistics([texts[i].encode() for i in ids]).astype(float), np.array([known[i] for i in ids], float)

    x, y = rows(0)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-6))
    z = model.design(x)
    penalty = quality.RIDGE * len(y) * np.diag([1.0] * quality.FEATURES + [0.0])
    assert np.allclose(z @ model.beta, z @ np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-4)
    # the calibration: a plain pass over the held rows, each pool's share of good ones
    u, v = rows(2)
    level = np.interp(model.raw(u), model.knots, model.levels)
    assert (np.diff(model.levels) >= 0).all() and abs(level.mean() - v.mean()) < 0.02


def test_random_features_approximate_the_kernel():
    model = quality.Model()
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, quality.N_STATS))
    z = model.design(x)[:, :-1]
    square = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-square / (2 * quality.N_STATS))).mean() < 0.06


def test_classifiers_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (None, 1), (7, None), (8, 0)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    assert quality.score(odd, model).count() == len(ODD)
    assert quality.remove_low_quality(odd, model).columns == odd.columns
    assert quality.score(empty, quality.fit(empty, labels.limit(0))).collect() == []
    assert {r.score for r in quality.score(odd, quality.fit(odd, labels.limit(0))).collect()} == {0.5}
    found = language.fit(odd)
    rows = language.predict(odd, found).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert language.remove_unidentified(odd, found).columns == odd.columns
    assert {r.lang_pred for r in language.predict(odd, language.fit(empty)).collect()} == {"und"}


def test_isotonic_levels_rise():
    x, y = quality.isotonic(np.arange(5.0), np.array([0.1, 0.5, 0.3, 0.2, 0.9]), np.ones(5))
    assert (np.diff(y) >= 0).all() and abs(y[1] - (0.5 + 0.3 + 0.2) / 3) < 1e-9 and len(x) == 3


# ---------------------------------------------------------------- 5
def test_viterbi_and_marginals_against_all_labellings():
    rng = np.random.default_rng(0)
    field = html_extract.Field()
    field.w, field.t = rng.normal(size=field.w.shape), rng.normal(size=(2, 2))
    x = (rng.random((6, field.w.shape[0])) < 0.2).astype(np.float32)
    e = x @ field.w
    every = list(itertools.product((0, 1), repeat=6))
    value = [sum(e[i, y[i]] for i in range(6)) + sum(field.t[a, b] for a, b in itertools.pairwise(y)) for y in every]
    assert tuple(field.decode(x)) == every[int(np.argmax(value))]
    p = np.exp(np.array(value) - np.logaddexp.reduce(value))
    want = np.array([[sum(q for q, y in zip(p, every, strict=True) if y[i] == k) for k in (0, 1)] for i in range(6)])
    got, _ = field._marginals(e[None], np.ones((1, 6), bool), np.ones((1, 5), bool))
    assert np.allclose(got[0], want)


def test_extraction_on_other_labelled_pages():
    field = html_extract.trained()
    right = total = 0
    for markup, labels in html_extract.labelled_pages(60, seed=99):
        blocks = html_extract.blocks_of(markup)
        if len(blocks) == len(labels):
            y = field.decode(html_extract.features_of(blocks))
            right += int((y == np.array(labels)).sum())
            total += len(labels)
    assert right / total > 0.95


def test_extraction_of_a_page(spark):
    page = "<html><head><title>t</title><style>x</style></head><body><nav><a href=1>Home</a> <a href=2>About</a></nav><article><h1>A &amp; B</h1><p>First  line\n of the story, with words&nbsp;and more of them.<script>bad()</script></p><p>Second paragraph here, with <b>bold</b> text and an end.</p></article><footer>&copy; 2020 someone</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, None), (3, "v", "", "x"), (4, "w", "<p", "x"), (1, "u", page, "x")], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract(pages, html_extract.trained()).orderBy("page_id").collect()]
    text = "A & B\nFirst line of the story, with words and more of them.\nSecond paragraph here, with bold text and an end."
    assert got[:4] == [(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0)]


def test_extraction_of_hand_written_pages():
    from .pages import PAGES

    field = html_extract.trained()
    got = [html_extract.main_text(page, field) for page, _ in PAGES]
    lines = [(g.split("\n"), w.split("\n")) for g, (_, w) in zip(got, PAGES, strict=True)]
    assert sum(g == w for g, (_, w) in zip(got, PAGES, strict=True)) >= 27
    assert sum(len([x for x in w if x not in g]) for g, w in lines) == 0
    assert sum(len([x for x in g if x not in w]) for g, w in lines) <= 3


def test_extraction_of_the_table_against_its_articles(spark, sf):
    """The blocks between the article tags, cut with patterns."""
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_extract.op5_html_extract(spark, sf).collect():
        inner = "".join(re.findall(r"(?s)<article>(.*?)</article>", pages[r.page_id] or ""))
        inner = re.sub(r"(?s)<!--.*?-->|<(script|style|form|aside|div|section)\b.*?</\1>", "", inner)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h\d|li|ul|ol|blockquote)\b[^>]*>", inner)]
        assert r.text == "\n".join(x for x in parts if x), r.page_id


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 200_000 + "</x>" * 200_000, "<a ''" * 400_000 + '"', "<a x='" * 300_000, "<a x=\"" * 200_000 + "<b y='" * 100_000, "<div>" * 200_000 + "<dt></dt>" * 100_000, "<p><i>" * 150_000 + "<div></div>" * 100_000,
        "<p><x>" + "<b>" * 200_000 + "<div></div>" * 90_000, "<script></script " * 120_000, "<" * 2_000_000, "<!--" * 500_000, "<a " + '="' * 1_000_000 + ">", "<td>" * 500_000, "<ul><li>" * 250_000, "<a class" + " " * 2_000_000 + "x>",
    ],
    ids=range(14),
)
def test_reading_takes_time_in_proportion(page):
    import time

    html_extract.blocks_of(page[: len(page) // 4])
    began = time.process_time()
    html_extract.blocks_of(page)
    assert time.process_time() - began < 8


def test_markup_that_ends_nowhere():
    texts = lambda page: [b.text for b in html_extract.blocks_of(page)]
    assert texts("<p>a < b and a<b</p>") == ["a < b and a"]
    assert texts("x </ y> z <p title='a>b'>one</p><p title=\"a>two</p>") == ["x z", "one", "two"]
    assert texts("<head><title>t</title><p>shown") == ["shown"]
    assert texts("a<!-- b") == ["a"] and texts("a<!doctype x>b") == ["ab"] and texts("<textarea><p>x</textarea>y") == ["<p>x", "y"]
    assert texts("<noscript>n</noscript><button>b</button><math><mi>x</mi></math>") == ["n", "b", "x"]
    assert html_extract.blocks_of("<p hidden>h")[0].hidden


def test_digits_are_counted_over_the_whole_block():
    blocks = html_extract.blocks_of(f"<p>{'word ' * 50}{'1234567 ' * 60}</p><p>{'1234567 ' * 30}{'word ' * 300}</p>")
    assert [x[html_extract.FEATURES.index("digits")] for x in html_extract.features_of(blocks)] == [1, 0]


# ---------------------------------------------------------------- 6
@pytest.fixture(scope="module")
def sampler():
    return piece_sampling.Sampler(piece_sampling.default_vocabulary())


def every_path(sampler, text):
    """All segmentations with their log probability, by walking the lattice."""
    codes, begins, sizes, _ = piece_sampling.segments_of([text])
    nodes = sampler.lattices.prepare(codes, begins, sizes)
    begin, to, _, logp, _ = sampler.lattices.arrays

    def paths(node):
        stop = begin[node + 1] if node + 1 < len(begin) else len(to)
        for e in range(begin[node], stop):
            if to[e] < 0:
                yield [e], float(logp[e])
            else:
                for rest, lp in paths(to[e]):
                    yield [e, *rest], float(logp[e]) + lp

    out = [([], 0.0)]
    for node in nodes.tolist():
        out = [(a + b, x + y) for a, x in out for b, y in paths(node)]
    return {tuple(sampler._ids(np.array(p)).tolist()): lp for p, lp in out}


def test_samples_are_distinct_lattice_paths(sampler):
    text = "the end"
    every = every_path(sampler, text)
    assert abs(sum(map(math.exp, every.values())) - 1) < 1e-9
    found = sampler.sample([5], [text], k=len(every) + 5)[0]
    ids = [tuple(x[0].tolist()) for x in found]
    assert len(set(ids)) == len(ids) == len(every) and set(ids) == set(every)
    assert all(abs(x[1] - every[i]) < 1e-6 for x, i in zip(found, ids, strict=True))
    assert all(a[2] >= b[2] for a, b in zip(found, found[1:], strict=False)) and all(x[3] == 1 for x in found)


def test_first_samples_follow_the_probabilities(sampler):
    text, n = "sets", 4000
    every = every_path(sampler, text)
    first = Counter(tuple(x[0][0].tolist()) for x in sampler.sample(list(range(n)), [text] * n, k=2))
    for ids, lp in every.items():
        p = math.exp(lp)
        assert abs(first[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_pieces_round_trip(spark, odd, empty):
    rows = piece_sampling.sample_pieces(odd, piece_sampling.default_vocabulary()).collect()
    assert {r.doc_id for r in rows if not r.round_trip} == {5}
    assert Counter(r.doc_id for r in rows)[1] == 4
    again = {(r.doc_id, r["sample"], r.ids_crc32) for r in piece_sampling.sample_pieces(odd.repartition(3), piece_sampling.default_vocabulary(), with_ids=False).collect()}
    assert again == {(r.doc_id, r["sample"], r.ids_crc32) for r in rows}
    assert piece_sampling.sample_pieces(empty, piece_sampling.default_vocabulary()).collect() == []


def test_decoding_agrees_with_the_library(sampler):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_sampling.default_vocabulary())
    texts = ["The end of it", " two  spaces ", "Größe, été 日本語 \U0001f600!", "a\nb\tc", "x" * 300, ""]
    for text, found in zip(texts, sampler.sample(list(range(len(texts))), texts), strict=True):
        for ids, *_ in found:
            decoded = sampler.vocabulary.decode(ids.tolist()).decode()
            assert decoded == text
            # the library strips the first of several leading marks as well
            assert library.decode(ids.tolist()).strip() == text.strip()


def test_samples_do_not_depend_on_their_company(sampler):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdé 日\U0001f600") for _ in range(rng.randint(1, 90))) for _ in range(200)]
    whole = sampler.sample(list(range(200)), texts)
    for i in range(0, 200, 23):
        alone = sampler.sample([i], [texts[i]])[0]
        assert [(x[0].tolist(), x[1:]) for x in alone] == [(x[0].tolist(), x[1:]) for x in whole[i]]


@pytest.mark.parametrize(("letters", "ways"), [("ab", 2), ("日本語の文", 1), ("日s本he", 2), ("\U0001f600\U0001f680", 1)])
def test_long_text_without_spaces(sampler, letters, ways):
    rng = random.Random(4)
    text = "".join(rng.choice(letters) for _ in range(200_000))
    found = sampler.sample([9], [text])[0]
    assert len({x[0].tobytes() for x in found}) == len(found) == ways
    assert all(sampler.vocabulary.decode(x[0].tolist()).decode() == text and math.isfinite(x[1]) for x in found)
    # against plain forward sums over the whole text
    v, s = sampler.vocabulary, piece_sampling.MARK + text
    total = [0.0] + [-math.inf] * len(s)
    for i in range(len(s)):
        ways_on = [(i + 1, v.byte_weight ** len(s[i].encode()))] if s[i] not in v.weight else []
        ways_on += [(j, v.weight[s[i:j]][1]) for j in range(i + 1, min(len(s), i + v.longest) + 1) if s[i:j] in v.weight]
        for j, w in ways_on:
            a, b = total[j], total[i] + math.log(w)
            total[j] = max(a, b) + math.log1p(math.exp(-abs(a - b)))
    for ids, lp, *_ in found:
        path = sum(math.log(w if (w := v.weight_of[p]) else v.byte_weight) for p in ids.tolist())
        assert math.isclose(lp, path - total[-1], rel_tol=1e-6, abs_tol=1e-4)


# ---------------------------------------------------------------- 8
def test_token_files_round_trip(spark, docs, sf, odd, empty, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(token_files, "SHARD_BYTES", 1 << 18)
    start = 0
    for r in token_files.op8_token_files(spark, sf).orderBy("doc_id").collect():
        ids = np.array([*library.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), r.doc_id
        start += len(ids)
    manifest = token_files.write_token_files(odd, path)
    assert sum(m["n_docs"] for m in manifest) == len(ODD)
    reader = token_files.ShardReader(manifest[-1]["uri"])
    assert [x.tolist() for x in reader.get(8)] == [[*library.encode("12345 !!! ###", add_special_tokens=False).ids, 1]]
    assert token_files.read_token_files(spark, token_files.write_token_files(empty, path)).collect() == []


def test_encoder_agrees_with_the_library():
    import public_tokenizers

    e = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert e.splits
    for x in ["It's <|endoftext|> HE'LL o'd 'S ÀÉÎ ſ ß ẞ İ ǅ ʼn x́ é  a ½ 12,5% Ω 日本 don't''re ...'ve", "Œuvre<|startoftext|>", " ", "", "a\x00b \x1c c d\x85e", "ªº µ × ÷ \u2028 z"]:
        assert e.encode([x.encode()])[0] == np.array(e.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x


def test_encoder_with_another_vocabulary():
    import public_tokenizers

    e = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not e.splits
    for x in ["Hello  world \n\n again", " leading", "", "日本 \t x"]:
        assert e.encode([x.encode()])[0] == np.array(e.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x


def test_damaged_frame_is_noticed(tmp_path):
    w = token_files.ShardWriter()
    w.add(3, np.arange(50, dtype="<u4").tobytes())
    data = bytearray(w.finish())
    data[-1 - 9 - 4] ^= 1
    (tmp_path / "x").write_bytes(data)
    with pytest.raises(ValueError):
        list(token_files.ShardReader(f"file://{tmp_path}/x"))


# ---------------------------------------------------------------- 9
def test_lm_counts_and_base_score(spark, docs, sf):
    tokens = {i: [*SPACE_WORDS.findall(lower(r.text)), None] for i, r in docs.items()}
    seen = Counter(w for i, ws in tokens.items() if crc(i) % 5 != 1 for w in ws)
    n, v = sum(seen.values()), len(seen)
    rows = {r.doc_id: r for r in lm_scoring.op9_lm_scoring(spark, sf).collect()}
    assert set(rows) == set(docs)
    for i, r in rows.items():
        ws = tokens[i]
        base = sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i) % 5 == 1, len(ws), sum(seen[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def brute_scores(rows):
    """Deleted interpolation by plain dictionaries: id -> score; the weights by the same steps of EM, on exact cells."""
    toks = {i: [*SPACE_WORDS.findall(lower(t)), "\0end"] for i, t in rows}
    learn = [i for i in toks if crc(i) % 5 != 1]
    fold = [i for i in learn if crc(i) % 5 == 2] or learn

    def grams(ws):
        s = ["\0start", "\0start", *ws]
        return Counter(ws), Counter(zip(s[1:], ws, strict=False)), Counter(zip(s, s[1:], ws, strict=False))

    every = [Counter(), Counter(), Counter()]
    own = {i: grams(toks[i]) for i in toks}
    for i in learn:
        for c, o in zip(every, own[i], strict=True):
            c.update(o)
    n, v = sum(every[0].values()), len(every[0])

    def parts(i):
        gone = own[i] if i in set(learn) else (Counter(), Counter(), Counter())
        c = lambda k, g: every[k][g] - gone[k][g]
        ws = toks[i]
        s = ["\0start", "\0start", *ws]
        docs = c(0, "\0end")
        for k, w in enumerate(ws):
            u, h = s[k], s[k + 1]
            one = docs if h == "\0start" else c(0, h)
            two = docs if h == "\0start" else c(1, (u, h))
            log = lambda x: math.frexp(x)[1]
            yield lm_scoring._LONG + log(two) if two > 0 else log(one), c(2, (u, h, w)) / max(two, 1), c(1, (h, w)) / max(one, 1), c(0, w) / max(1, n - (len(ws) if gone[0] else 0))

    cells = Counter()
    for i in fold:
        for b, *ps in parts(i):
            code = b
            for p in ps:
                code = code * 512 + (int(min(510, max(0, -np.round(lm_scoring.GRID * np.log2(p))))) if p > 0 else 511)
            cells[code] += 1
    w = lm_scoring.learn_weights(sorted(cells.items()), v)
    return {i: sum(math.log10(w[b, 0] * p3 + w[b, 1] * p2 + w[b, 2] * p1 + w[b, 3] / (v + 1)) for b, p3, p2, p1 in parts(i)) for i in toks}


@pytest.mark.parametrize("ids", [range(40), [k for k in range(200) if crc(k) % 5 in (0, 1)][:30]])
def test_lm_scores_against_plain_dictionaries(spark, ids):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(rng.randint(0, 40)))) for i in ids]
    rows[3] = (rows[3][0], rows[5][1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_scoring.score_texts(df).collect()}
    want = brute_scores(rows)
    assert set(got) == set(want)
    for i, s in got.items():
        assert math.isclose(s, want[i], rel_tol=1e-9), i


def test_lm_scores_do_not_depend_on_partitions(spark, tables):
    docs = tables("documents")
    a, b = ({r.doc_id: r for r in lm_scoring.score_texts(d).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert all(math.isclose(a[i].score, b[i].score, rel_tol=1e-9) and a[i].n_known == b[i].n_known for i in a) and set(a) == set(b)


def test_lm_documents_that_occur_twice_stand_out(spark):
    rng = random.Random(2)
    texts = [" ".join(f"{rng.choice('abcdefghij')}{rng.randrange(40)}" for _ in range(80)) for _ in range(300)]
    rows = list(enumerate(texts)) + [(1000 + k, texts[k]) for k in range(20)]
    got = {r.doc_id: r.score for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # a copy whose other one was held out is one of a kind to the model
    twice = [got[k] for k in range(20) if crc(1000 + k) % 5 != 1]
    once = sorted(got[k] for k in range(20, 300))
    assert len(twice) > 10 and min(twice) > once[-1]


def test_lm_keys_and_counts_round_trip():
    rng = np.random.default_rng(3)
    for order in range(3):
        free = np.uint64((1 << lm_scoring._FREE[order]) - 1)
        keys = np.unique(rng.integers(0, 2**64, 1000, dtype=np.uint64) & ~free)
        assert (lm_scoring._unpack_keys(lm_scoring._pack_keys(keys, order), order) == keys).all()
    for top in (3, 300, 1 << 40):
        c = rng.integers(0, top, 100)
        assert (lm_scoring._unpack_counts(lm_scoring._pack_counts(c)) == c).all()


def test_lm_probabilities_sum_to_one():
    code = lambda b, *q: ((b * 512 + q[0]) * 512 + q[1]) * 512 + q[2]
    cells = [(code(73, 2, 4, 20), 50), (code(73, 511, 511, 40), 10), (code(0, 511, 511, 511), 4), (code(1, 511, 0, 30), 9)]
    w = lm_scoring.learn_weights(cells, 1000)
    assert np.allclose(w.sum(1), 1) and (w[:, 2:] > 0).all() and (w[: lm_scoring._LONG, 0] == 0).all()


def test_lm_odd_rows(spark, odd, empty):
    rows = lm_scoring.score_texts(odd).collect()
    assert len(rows) == len(ODD) and all(r.n_tokens >= 1 for r in rows)
    assert lm_scoring.score_texts(empty).collect() == []


# ---------------------------------------------------------------- 10
def test_rule_counts_against_brute_force(spark, docs, sf):
    rows = {r.doc_id: r for r in perplexity.op10_quality_rules(spark, sf).collect()}
    assert set(rows) == set(docs)
    for i, r in rows.items():
        text = docs[i].text or ""
        w = SPACE_WORDS.findall(text)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + d for k, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if tri[t] > 1 for d in range(3)}
        lines, dup = set(), 0
        for line in text.split("\n"):
            if SPACE_WORDS.search(line):
                dup += line in lines
                lines.add(line)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def kneser_ney(texts):
    """log10 p(character | three before) by plain dictionaries."""
    pad = "\0\0\0"
    grams = {4: Counter(), 3: Counter(), 2: Counter(), 1: Counter()}
    for t in texts:
        s = pad + lower(t)
        grams[4].update(s[i - 3 : i + 1] for i in range(3, len(s)))
    for n in (3, 2, 1):
        for g in grams[n + 1]:
            grams[n][g[1:]] += 1
    discount = {}
    for n, c in grams.items():
        of = [sum(x == k for x in c.values()) for k in range(5)]
        if of[1] and of[2]:
            y = of[1] / (of[1] + 2 * of[2])
            raw = [1 - 2 * y * of[2] / of[1], 2 - 3 * y * of[3] / of[2], 3 - 4 * y * of[4] / of[3] if of[3] else 2.0]
            discount[n] = [min(max(v, 0.05), k - 0.05) for k, v in enumerate(raw, 1)]
        else:
            discount[n] = [0.5, 0.75, 0.9]

    def p(gram):
        n = len(gram)
        context = [(g, c) for g, c in grams[n].items() if g[:-1] == gram[:-1]]
        below = p(gram[1:]) if n > 1 else 1 / (len(grams[1]) + 1)
        if not context:
            return below
        total = sum(c for _, c in context)
        gamma = sum(discount[n][min(c, 3) - 1] for _, c in context) / total
        c = grams[n].get(gram, 0)
        return (c - discount[n][min(c, 3) - 1] if c else 0) / total + gamma * below

    return lambda text: sum(math.log10(p((pad + lower(text))[i - 3 : i + 1])) for i in range(3, len(text) + 3))


def test_perplexity_against_plain_dictionaries(spark):
    by = {"en": ["abracadabra", "a bra", "cab", "dab dab", "ABBA \U0001f600 bad"], "de": ["dada", "a da", "bad da"]}
    rows = [(k, t, lang) for k, (lang, t) in enumerate((g, t) for g, ts in by.items() for t in [*ts, "zebra a"])]
    learnt = spark.createDataFrame([r for r in rows if r[1] != "zebra a"], "doc_id long, text string, lang string")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.log_ppl for r in perplexity.judge(docs, perplexity.fit(learnt, every=True)).collect()}
    for k, t, lang in rows:
        fold = lambda x: "".join(chr(0xE000 + ord(c) % 0x1900) if ord(c) > 0xFFFF else c for c in x)
        assert math.isclose(got[k], -kneser_ney([fold(x) for x in by[lang]])(fold(t)) / len(t), rel_tol=1e-5), (t, lang)


def test_bands_and_verdicts_against_plain_lists(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = perplexity.op10_quality_rules(spark, sf).collect()
    prose = {}
    for r in rows:
        good = not r.base_failed and 10 * r.n_symbols <= r.n_words and 2 * r.n_words <= r.word_chars <= 12 * r.n_words and 20 * r.n_dup_lines <= r.n_words
        if good and r.log_ppl is not None:
            prose.setdefault(docs[r.doc_id].lang or "und", []).append(math.floor(r.log_ppl * perplexity.CELLS))
    for r in rows:
        cells = sorted(prose.get(docs[r.doc_id].lang or "und", []))
        if len(cells) < perplexity.LEAST_DOCS:
            assert r.low is None and r.kept == (not r.base_failed)
            continue
        q1, q3 = ((cells[math.ceil(k * len(cells) / 4) - 1] + 0.5) / perplexity.CELLS for k in (1, 3))
        reach = perplexity.REACH * (q3 - q1 + 0.01) * math.sqrt(1 + perplexity.SHORT / max(1, r.n_chars))
        assert math.isclose(r.low, q1 - reach, abs_tol=1e-9) and math.isclose(r.high, q3 + reach, abs_tol=1e-9)
        if r.log_ppl is not None:
            assert r.kept == (not r.base_failed and r.low <= r.log_ppl <= r.high)


def test_kneser_ney_sums_to_one(spark):
    texts = ["abracadabra", "a bra", "cab", "dab dab"]
    df = spark.createDataFrame([("xx", t) for t in texts], "_lang string, _text string")
    scorer = perplexity.Scorer(perplexity.store_model(perplexity.model_entries(df, every=True)))
    seen = sorted({ord(c) for t in texts for c in t})
    for context in ([0, 0, 0], [0, 0, ord("a")], [ord("a"), ord("b"), ord("r")], [ord("z"), ord("a"), ord("b")], [ord("z")] * 3):
        high = sum(np.uint64(c) << np.uint64(16 * (3 - k)) for k, c in enumerate(context))
        codes = np.array([high | np.uint64(c) for c in seen] + [high | np.uint64(0x4E00)], np.uint64)
        assert abs((10 ** scorer.resolve(codes, perplexity.salt_of("xx"))).sum() - 1) < 1e-4, context


def test_rules_on_odd_rows(spark, odd, empty):
    rows = perplexity.judge(odd, perplexity.fit(odd)).collect()
    assert len(rows) == len(ODD) and all(r.kept is not None for r in rows)
    assert perplexity.judge(empty, perplexity.fit(empty)).collect() == []
    assert len(perplexity.judge(odd, perplexity.fit(empty)).collect()) == len(ODD)


def test_bands_reject_junk_and_keep_clean_text(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    judged = [(labels[r.doc_id], r.kept) for r in perplexity.op10_quality_rules(spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    junk, clean = ([kept for y, kept in judged if y == label] for label in (0, 1))
    assert len(junk) > 20 and sum(junk) <= 0.1 * len(junk)
    assert len(clean) > 200 and sum(clean) >= 0.99 * len(clean)
