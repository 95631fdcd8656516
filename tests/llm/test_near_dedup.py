import random
import re

import pytest

from grafspan.llm import near_dedup

SCHEMA = "doc_id long, text string, component_id string"


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=85):
    """doc_id -> (n, component) by comparing all pairs."""
    rows = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, sa) in enumerate(rows):
        for b, sb in rows[k + 1 :]:
            both = len(sa & sb)
            if sa and sb and 100 * both >= percent * (len(sa) + len(sb) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in rows}


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def check(spark, rows, partitions=4, percent=85):
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], SCHEMA).repartition(partitions)
    got = near_dedup.near_duplicates(df, percent=percent).collect()
    assert len(got) == len(rows)
    want = brute(rows, percent)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_against_all_pairs(spark):
    rng = random.Random(3)
    texts = []
    for length, n, edits in ((300, 60, 12), (120, 60, 8), (40, 40, 3), (8, 20, 1)):
        texts += variants(rng, [f"w{rng.randrange(5000)}" for _ in range(length)], n, edits)
    texts += [None, "", "   ", "One two", "one  TWO", "a b c d e", "A b c d\te"] + [" ".join(f"u{rng.randrange(9999)}" for _ in range(60)) for _ in range(40)]
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_blocks_of_a_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(5)
    texts = variants(rng, [f"w{i}" for i in range(200)], 150, 16)
    check(spark, list(enumerate(texts)))


def test_whole_table_against_all_pairs(spark, sf, tables):
    docs = tables("documents")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.op7_near_dedup(spark, sf).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_nulls_repeats_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_dedup.near_duplicates(empty).collect() == []
    assert near_dedup.remove_near_duplicates(empty).columns == empty.columns
    rows = [(None, "a b c d e f", "x"), (5, "a b c d e f", "x"), (5, "a b c d e f", "x"), (7, "A B C D E F", "y"), (8, None, "z"), (None, "p q r s t", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (7, 2, 5), (8, 0, 8), (None, 1, None)], key=repr)
    left = near_dedup.remove_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.component_id) for r in left.collect()), key=repr) == sorted([(None, "x"), (5, "x"), (8, "z"), (None, None)], key=repr)


@pytest.mark.parametrize("length", [20_000])
def test_very_long_texts(spark, length):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    check(spark, list(enumerate([" ".join(base), " ".join(base[:-500]), " ".join(base[: length // 2])])))


def test_removal_links_from_four_fifths_on(spark):
    rng = random.Random(11)
    rows = []
    for k in range(0, 120, 2):
        base = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        cut = rng.randint(20, 39)  # of 200 shingles so many fewer: 0.805 to 0.9
        rows += [(k, " ".join(base)), (k + 1, " ".join(base[:-cut]))]
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], SCHEMA)
    assert {r.doc_id for r in near_dedup.remove_near_duplicates(df).collect()} == {i for i, _ in rows if i % 2 == 0}
    assert {r.doc_id for r in near_dedup.near_duplicates(df, percent=80).where("kept").collect()} == {i for i, (_, c) in brute(rows, 80).items() if i == c}


@pytest.mark.parametrize("percent", [30, 50, 70, 95])
def test_other_thresholds_against_all_pairs(spark, percent):
    rng = random.Random(percent)
    rows = []
    for k in range(0, 160, 2):
        base = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        # of 100 shingles so many are shared: on both sides of the threshold
        keep = max(8, min(104, 4 + percent + rng.randint(-12, 12)))
        rows += [(k, " ".join(base)), (k + 1, " ".join(base[:keep]))]
    assert sum(a != b for a, (_, b) in brute(rows, percent).items()) >= 20
    check(spark, rows, percent=percent)


def test_bands_miss_few_pairs_at_their_threshold():
    for percent in (20, 30, 50, 60, 70, 80, 85, 90):
        bands, rows = near_dedup.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands < 6e-7
    with pytest.raises(ValueError):
        near_dedup.banding(10)


def test_query_against_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(near_dedup.op7_sql()).fetchall()
    assert sorted(map(tuple, near_dedup.op7_near_dedup(spark, sf).collect())) == sorted(want)
