"""Quality rules with n-gram perplexity: modified Kneser-Ney models in sorted hash arrays, and bands by language.

The models are over characters (A-Z lower-cased), of order ORDER = 4: four 16-bit units fill one 64-bit key
exactly. There is one for each language, counted on the documents that pass the base rules and look like prose
(few symbols, words of usual length, few repeated lines), so that junk isn't what junk is measured by. Counts are
pre-aggregated in each task and summed by Spark, as are continuation counts, discounts and backoff weights, so that
no table of a model has to fit one machine. The entries, sorted by a 64-bit hash, lie in range-partitioned arrays
in the shared folder, which workers memory-map and search; a direct-mapped cache in front of them answers most
lookups.

A document is rejected if the log of its perplexity a character lies outside its language's band, which is set from
the quartiles of the documents that the language's model was counted on. Quartiles are those of a histogram with
cells of 1 / CELLS, so that they are the same however rows are partitioned.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ORDER = 4
#: n-grams of one task held at once before they are handed to Spark.
HELD = 1 << 20
SHARD_ROWS = 4_000_000
#: A band reaches so many interquartile ranges beyond the quartiles, more for a short text.
REACH, SHORT = 3.0, 400.0
CELLS = 1000
#: A language with fewer documents to count on has no band: its documents are judged by the base rules alone.
LEAST_DOCS = 20
#: Bands and discounts of so many languages are broadcast; beyond, they are joined by shuffles.
BROADCAST_LANGS = 10_000
_CACHE_BITS = 20
_SYMBOLS = common._table(lambda b: b in b"#*$%&|<>")


# ---------------------------------------------------------------- counting
def codes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(4-gram code of every character with its three predecessors, number of characters of each text).

    Characters above U+FFFF share the codes U+E000 to U+F8FF, and U+0000 is U+FFFE, as it stands for what is before
    a text."""
    units = [np.frombuffer(t.lower().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for t in texts]
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    pad = np.zeros(ORDER - 1, np.uint32)
    flat = np.concatenate([x for u in units for x in (pad, u)]) if units else pad
    own = np.ones(len(flat), bool)
    starts = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    for k in range(ORDER - 1):
        own[starts + k] = False
    u = np.where(flat > 0xFFFF, 0xE000 + flat % np.uint32(0x1900), flat).astype(np.uint64)
    u[(u == 0) & own] = 0xFFFE
    code = u.copy()
    for k in range(1, ORDER):
        code[k:] |= u[:-k] << np.uint64(16 * k)
    return code[own], sizes


def failed_base(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def looks_like_prose(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Passes the base rules, has at most a symbol in ten words, words of 2 to 12 characters on average, and no more
    repeated lines than a twentieth of its words."""
    words = counts["n_words"]
    return ~failed_base(counts) & (10 * counts["n_symbols"] <= words) & (counts["word_chars"] >= 2 * words) & (counts["word_chars"] <= 12 * words) & (20 * counts["n_dup_lines"] <= words)


def _by_language(langs: list[str]):
    """(language, places of its rows) of a batch."""
    places: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        places.setdefault(lang, []).append(k)
    return sorted(places.items())


def _count(every: bool):
    """(_lang, _text) -> language, 4-gram and its count in the texts that look like prose, or in every one."""

    def count(batches):
        held: dict[str, list] = {}
        size = 0

        def merged(parts):
            g, where = np.unique(np.concatenate([a for a, _ in parts]), return_inverse=True)
            return g, np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)

        def out():
            for lang, parts in sorted(held.items()):
                g, c = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], ["lang", "g", "c"])

        for b in batches:
            texts = common.as_bytes(b.column(1))
            good = np.ones(len(texts), bool) if every else looks_like_prose(text_counts(texts))
            for lang, at in _by_language(b.column(0).to_pylist()):
                mine = [texts[k] for k in at if good[k]]
                for i, j in common.pieces([len(t) + 1 for t in mine]):
                    code, _ = codes_of(mine[i:j])
                    held.setdefault(lang, []).append(np.unique(code, return_counts=True))
                    size += len(held[lang][-1][0])
                    if size > HELD:
                        held = {k: [merged(x)] for k, x in held.items()}
                        size = sum(len(x[0][0]) for x in held.values())
                        if size > HELD // 2:
                            yield from out()
                            held, size = {}, 0
        yield from out()

    return count


def _shift(column: str, units: int):
    return F.shiftrightunsigned(F.col(column), 16 * units)


def _low(column: str, units: int):
    return F.col(column).bitwiseAND(F.lit((1 << (16 * units)) - 1))


def _discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts of each language for counts 1, 2 and above."""
    r = counts.groupBy("lang").agg(*[F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    known = (F.col("n1") > 0) & (F.col("n2") > 0)

    def bounded(k, value, default):
        return F.when(known, F.least(F.greatest(value, F.lit(0.05)), F.lit(k - 0.05))).otherwise(F.lit(default)).alias(f"d{k}")

    third = F.when(F.col("n3") > 0, 3 - 4 * y * F.col("n4") / F.col("n3")).otherwise(2.0)
    return r.select("lang", bounded(1, 1 - 2 * y * F.col("n2") / F.col("n1"), 0.5), bounded(2, 2 - 3 * y * F.col("n3") / F.col("n2"), 0.75), bounded(3, third, 0.9))


def _for_all(by_language: DataFrame) -> DataFrame:
    """A table with a row for each language, to be joined: broadcast behind a check of its size, so that the other side
    isn't dealt out by language, of which one may have most rows."""
    return F.broadcast(by_language) if by_language.count() <= BROADCAST_LANGS else by_language


def model_entries(texts: DataFrame, every: bool = False) -> DataFrame:
    """(lang, n, g, logp, logg) from rows (language, text): n-gram g of order n with its log10 probability and the
    log10 weight with which it backs off as a context (each null where it isn't one). n = 0 has the probability of a
    character that the language's texts don't have."""
    top = common.store(texts.mapInArrow(common.frugal(_count(every)), "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c")), "kn-counts")
    tables = {ORDER: top}
    for n in range(ORDER - 1, 0, -1):
        # how many different characters come before: its continuation count
        tables[n] = tables[n + 1].groupBy("lang", _low("g", n).alias("g")).agg(F.count("*").alias("c"))
    entries, lower = [], None
    for n in range(1, ORDER + 1):
        table = tables[n] if n == ORDER else common.store(tables[n], f"kn-{n}")
        # the key of a context has no bits above its n - 1 units
        table = table.withColumn("h", _shift("g", 1) if n > 1 else F.lit(0).cast("long")).join(_for_all(common.store(_discounts(table), f"kn-d{n}")), "lang")
        table = table.withColumn("less", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        contexts = table.groupBy("lang", "h").agg(F.sum("c").alias("total"), (F.sum("less") / F.sum("c")).alias("gamma"), F.count("*").alias("kinds"))
        row = table.join(contexts, ["lang", "h"])
        if n == 1:
            # what is left is shared by all seen characters and the unseen one
            row = row.withColumn("low", 1 / (F.col("kinds") + 1))
            entries.append(contexts.select("lang", F.lit(0).alias("n"), F.lit(0).cast("long").alias("g"), F.log10(F.col("gamma") / (F.col("kinds") + 1)).alias("logp"), F.lit(None).cast("double").alias("logg")))
        else:
            row = row.withColumn("k", _low("g", n - 1)).join(lower.select("lang", F.col("g").alias("k"), F.col("p").alias("low")), ["lang", "k"])
        done = common.store(row.select("lang", "g", ((F.col("c") - F.col("less")) / F.col("total") + F.col("gamma") * F.col("low")).alias("p")), f"kn-p{n}")
        entries.append(done.select("lang", F.lit(n).alias("n"), "g", F.log10("p").alias("logp"), F.lit(None).cast("double").alias("logg")))
        if n > 1:
            entries.append(contexts.select("lang", F.lit(n - 1).alias("n"), F.col("h").alias("g"), F.lit(None).cast("double").alias("logp"), F.log10("gamma").alias("logg")))
        lower = done
    both = entries[0]
    for e in entries[1:]:
        both = both.unionByName(e)
    return both.groupBy("lang", "n", "g").agg(F.max("logp").alias("logp"), F.max("logg").alias("logg"))


def salt_of(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang))


def _hash(n, g: np.ndarray, salt) -> np.ndarray:
    """63 bits of an n-gram of a language; other n-grams meet with a chance of 1e-19 for each entry."""
    with np.errstate(over="ignore"):
        return common.mix(common.mix(g ^ (np.asarray(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) + salt) >> np.uint64(1)


def store_model(entries: DataFrame) -> list[dict]:
    """Write the entries as arrays sorted by hash, in range-partitioned shards; the manifest has a row a shard."""
    spark = entries.sparkSession
    folder = f"{common.work_dir(spark)}/kn-{uuid.uuid4().hex}"

    def key(batches):
        for b in batches:
            langs = b.column(0).dictionary_encode()
            salts = np.array([salt_of(x) for x in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()] if b.num_rows else np.empty(0, np.uint64)
            h = _hash(b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64), salts)
            # log10 of 1 where there is none: an unseen context backs off with weight 1; nan: not an n-gram
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), b.column(3).fill_null(math.nan), b.column(4).fill_null(0.0)], ["h", "logp", "logg"])

    def write(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if parts:
            h, p, g = (np.concatenate(x) for x in zip(*parts, strict=True))
            at = np.argsort(h)
            uri = f"{folder}/{uuid.uuid4().hex}.arrays"
            common.put_file(uri, np.int64(len(h)).tobytes() + h[at].astype("<u8").tobytes() + p[at].astype("<f4").tobytes() + g[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([int(h[at[0]])], pa.int64())], ["uri", "low"])

    keyed = entries.mapInArrow(common.frugal(key), "h long, logp double, logg double")
    shards = max(1, -(-entries.count() // SHARD_ROWS))
    placed = keyed.repartitionByRange(shards, "h") if shards > 1 else keyed.coalesce(1)
    # sorted here: sorting a frame that writes would write twice
    return sorted(({"uri": r.uri, "low": r.low} for r in placed.mapInArrow(common.frugal(write), "uri string, low long").collect()), key=lambda m: m["low"])


class Scorer:
    """Interpolated probabilities from the sorted arrays; most come from a direct-mapped cache."""

    def __init__(self, manifest: list[dict]):
        self.manifest = manifest
        self.shards: dict[int, tuple] = {}
        self.low = np.array([m["low"] for m in manifest], np.uint64)
        self.key, self.salt = np.zeros(1 << _CACHE_BITS, np.uint64), np.zeros(1 << _CACHE_BITS, np.uint64)
        self.value = np.zeros(1 << _CACHE_BITS, np.float32)

    def _shard(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if k not in self.shards:
            buffer = common.open_file(self.manifest[k]["uri"]).read_buffer()
            n = int(np.frombuffer(buffer, np.int64, 1)[0])
            self.shards[k] = (np.frombuffer(buffer, "<u8", n, 8), np.frombuffer(buffer, "<f4", n, 8 + 8 * n), np.frombuffer(buffer, "<f4", n, 8 + 12 * n))
        return self.shards[k]

    def _find(self, n: int, g: np.ndarray, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """(log10 p or nan, log10 backoff weight) of n-grams of order n."""
        h = _hash(n, g, salt)
        p, w = np.full(len(h), np.nan, np.float32), np.zeros(len(h), np.float32)
        which = np.maximum(np.searchsorted(self.low, h, "right") - 1, 0) if len(self.low) else np.empty(0, int)
        for s in np.unique(which):
            keys, logp, logg = self._shard(int(s))
            mine = np.flatnonzero(which == s)
            at = np.minimum(np.searchsorted(keys, h[mine]), len(keys) - 1)
            hit = keys[at] == h[mine]
            p[mine[hit]], w[mine[hit]] = logp[at[hit]], logg[at[hit]]
        return p, w

    def resolve(self, codes: np.ndarray, salt: np.uint64) -> np.ndarray:
        """log10 probabilities; nan for a language without a model."""
        out = np.full(len(codes), np.nan, np.float64)
        back = np.zeros(len(codes))
        for n in range(ORDER, -1, -1):
            open_ = np.flatnonzero(np.isnan(out))
            if not len(open_):
                break
            g = codes[open_] & np.uint64((1 << (16 * n)) - 1) if n < ORDER else codes[open_]
            p, _ = self._find(n, g, salt)
            out[open_] = p + back[open_]
            if n > 1:
                miss = open_[np.isnan(p)]
                context = (codes[miss] & np.uint64((1 << (16 * n)) - 1) if n < ORDER else codes[miss]) >> np.uint64(16)
                back[miss] += self._find(n - 1, context, salt)[1]
        return out

    def log_probabilities(self, codes: np.ndarray, lang: str) -> np.ndarray:
        salt = salt_of(lang)
        with np.errstate(over="ignore"):
            key = codes * np.uint64(0x9E3779B97F4A7C15) + salt
        slot = key >> np.uint64(64 - _CACHE_BITS)
        out = self.value[slot]
        miss = np.flatnonzero((self.key[slot] != codes) | (self.salt[slot] != salt))
        if len(miss):
            new, first, where = np.unique(codes[miss], return_index=True, return_inverse=True)
            p = self.resolve(new, salt).astype(np.float32)
            out[miss] = p[where]
            at = slot[miss[first]]
            self.key[at], self.salt[at], self.value[at] = new, salt, p
            # of several that fall into one slot the last is there; the salt and the key are of the same one
        return out


# ---------------------------------------------------------------- rules
def text_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for i, j in common.pieces([len(t) + 1 for t in texts]):
        words = common.Words(texts[i:j], lower=False)
        begin = words.offsets[:-1]
        out["n_words"][i:j] = words.count
        out["word_chars"][i:j] = np.add.reduceat(common.SPACE_WORDS[words.buf] & ((words.buf & 0xC0) != 0x80), begin, dtype=np.int64)
        out["n_symbols"][i:j] = np.add.reduceat(_SYMBOLS[words.buf], begin, dtype=np.int64)
        tri, owner = words.shingles(words.hashes(), 3)
        bounds = np.searchsorted(owner, np.arange(j - i + 1))
        for k in range(j - i):
            lines = [x for x in texts[i + k].split(b"\n") if x.strip()]
            out["n_dup_lines"][i + k] = len(lines) - len(set(lines))
            t = tri[bounds[k] : bounds[k + 1]]
            if len(t) > 1:
                order = np.argsort(t, kind="stable")
                s = t[order]
                same = s[1:] == s[:-1]
                twice = np.zeros(len(t), bool)
                twice[order[1:]] |= same
                twice[order[:-1]] |= same
                covered = np.zeros(len(t) + 2, bool)
                for d in range(3):
                    covered[d : d + len(t)] |= twice
                out["n_repeat_words"][i + k] = covered.sum()
    return out


def bands_of(scored: DataFrame) -> DataFrame:
    """(_lang, q1, q3) of languages with LEAST_DOCS documents that look like prose: quartiles from a histogram."""
    cells = scored.where("_prose AND log_ppl IS NOT NULL").groupBy("_lang", F.floor(F.col("log_ppl") * CELLS).alias("cell")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("_lang")
    run = cells.select("_lang", "cell", F.sum("n").over(w.orderBy("cell")).alias("upto"), F.sum("n").over(w).alias("all"))

    def quartile(k):
        return ((F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("cell"))) + 0.5) / CELLS).alias(f"q{k}")

    return run.where(F.col("all") >= LEAST_DOCS).groupBy("_lang").agg(quartile(1), quartile(3))


def judge(docs: DataFrame, manifest: list[dict], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each document: id, the counts, n_chars, log_ppl (log10 of the perplexity a character; null
    for an empty text or a language without a model), low and high (its band; null if there is none), base_failed, kept.

    A null text is empty, and fails. A null language is the language ``und``. Repeated rows are judged each.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scorer = Scorer(manifest)
        for b in batches:
            texts = common.as_bytes(b.column(2))
            counts = text_counts(texts)
            sizes, sums = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for lang, at in _by_language(b.column(1).to_pylist()):
                for i, j in common.pieces([len(texts[k]) + 1 for k in at]):
                    codes, n = codes_of([texts[k] for k in at[i:j]])
                    sums[at[i:j]] = np.bincount(np.repeat(np.arange(j - i), n), scorer.log_probabilities(codes, lang), j - i)
                    sizes[at[i:j]] = n
            ppl = pa.array(-sums / np.maximum(sizes, 1), mask=(sizes == 0) | np.isnan(sums))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c) for c in counts.values()], pa.array(looks_like_prose(counts)), pa.array(sizes), ppl], ["_id", "_lang", *counts, "_prose", "n_chars", "log_ppl"])

    rows = _rows(docs, id_col, text_col, lang_col)
    scored = common.store(rows.mapInArrow(common.frugal(run), f"_id {kind}, _lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, _prose boolean, n_chars long, log_ppl double"), "kn-scores")
    bands = _for_all(common.store(bands_of(scored), "kn-bands"))
    reach = REACH * (F.col("q3") - F.col("q1") + 0.01) * F.sqrt(1 + SHORT / F.greatest(F.col("n_chars"), F.lit(1)))
    out = scored.join(bands, "_lang", "left").withColumn("low", F.col("q1") - reach).withColumn("high", F.col("q3") + reach)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & inside)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_chars", "log_ppl", "low", "high"]
    return out.select(F.col("_id").alias(id_col), *names)


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("_lang"), F.col(f"`{text_col}`").alias("_text"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", every: bool = False) -> list[dict]:
    """The models of all languages of the documents, stored; the manifest of their arrays. every: counted on all
    texts, not only on those that look like prose."""
    common.ship(docs.sparkSession)
    return store_model(model_entries(_rows(docs, id_col, text_col, lang_col).select("_lang", "_text"), every))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs, fit(docs))
