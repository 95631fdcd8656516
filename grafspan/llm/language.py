"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Runs of one to three characters (A-Z lower-cased) are hashed to 2**16 columns; document frequencies are
counted over all rows to learn from. The weights are fitted by follow-the-regularised-leader with L1 and
L2 penalties, which leaves most of them zero, and probabilities are calibrated by one temperature, on
sampled documents that the weights have not seen.

The fit uses a sample of about TRAIN_PER_LANG documents (TRAIN_DOCS in all) of each of the LANGS languages that most
labelled rows have, chosen by a hash of the id; so what the driver holds and what is broadcast is bounded, however many values the
language column has. The weights that L1 leaves are kept and broadcast in sparse form.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TRAIN_PER_LANG = 1000
LANGS = 200
#: Sampled documents in all, about; with more than 20 languages each has fewer than TRAIN_PER_LANG.
TRAIN_DOCS = 20_000
BITS = 16
ORDERS = (1, 2, 3)
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def has_letter(text: bytes) -> bool:
    """Whether any character is a letter; fractions, superscripts and other numbers are none."""
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def columns_of(text: bytes) -> np.ndarray:
    """Hashed columns of all n-grams of a text, with repeats."""
    c = np.frombuffer(text.lower().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    out = []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(c) >= n:
                h = np.full(len(c) - n + 1, n, np.uint32)
                for k in range(n):
                    h = (h ^ c[k : len(c) - n + 1 + k]) * _MUL[k]
                    h ^= h >> np.uint32(15)
                out.append(h >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def vector(text: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of the TF-IDF vector, of length one."""
    count = np.bincount(columns_of(text), minlength=1 << BITS)
    at = np.flatnonzero(count)
    v = (1 + np.log(count[at])) * idf[at]
    norm = np.sqrt((v * v).sum())
    return at, (v / norm if norm > 0 else v)


class Model:
    """Weights by column: those of column c are values[start[c] : start[c + 1]], of the languages in lang."""

    def __init__(self, langs: list[str], idf: np.ndarray):
        self.langs, self.idf, self.temperature = langs, idf, 1.0
        self.bias = np.zeros(max(1, len(langs)))
        self.keep(np.zeros((1 << BITS, max(1, len(langs)))))

    def keep(self, weights: np.ndarray) -> None:
        column, self.lang = np.nonzero(weights)
        self.lang = self.lang.astype(np.int32)
        self.values = weights[column, self.lang].astype(np.float32)
        self.start = np.searchsorted(column, np.arange((1 << BITS) + 1))

    def logits(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        n = self.start[at + 1] - self.start[at]
        ends = np.cumsum(n)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - ends + n, n)
        return np.bincount(self.lang[place], self.values[place] * np.repeat(v, n), len(self.bias)) + self.bias

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for t in texts:
            if not self.langs or not has_letter(t):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            p = _softmax(self.logits(*vector(t, self.idf)) / self.temperature)
            k = int(p.argmax())
            langs.append(self.langs[k])
            scores.append(float(p[k]))
        return langs, scores


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], model: Model, seed: int = 3) -> None:
    """Follow-the-regularised-leader, one coordinate rate each; L1 keeps small coordinates at zero."""
    k = len(model.langs)
    # only columns that the sample has
    seen = np.unique(np.concatenate([a for a, _, _ in rows])) if rows else np.empty(0, np.int64)
    rows = [(np.searchsorted(seen, a), v, y) for a, v, y in rows]
    z, n = np.zeros((len(seen), k)), np.zeros((len(seen), k))
    zb, nb = np.zeros(k), np.zeros(k)

    def solve(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(EPOCHS):
        for r in order.permutation(len(rows)):
            at, v, y = rows[r]
            w, b = solve(z[at], n[at], L1), solve(zb, nb, 0.0)
            g0 = _softmax(v @ w + b)
            g0[y] -= 1
            g = v[:, None] * g0
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
            zb += g0 - (np.sqrt(nb + g0 * g0) - np.sqrt(nb)) / ALPHA * b
            nb += g0 * g0
    weights = np.zeros((1 << BITS, k), np.float32)
    weights[seen] = solve(z, n, L1)
    model.keep(weights)
    model.bias = solve(zb, nb, 0.0)


def _frequencies(batches):
    seen, docs = np.zeros(1 << BITS, np.int64), 0
    for b in batches:
        for t in common.as_bytes(b.column(0)):
            seen[np.bincount(columns_of(t), minlength=1 << BITS) > 0] += 1
            docs += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], docs))], ["c", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_PER_LANG) -> Model:
    """Learns from text and non-null lang of rows whose crc32(id as text) mod 3 is not 1; a row without an id isn't
    learnt from. Without such rows every prediction is ``und``. Document frequencies are those of all these rows,
    of rare languages too; only the LANGS most frequent languages can be predicted."""
    spark = docs.sparkSession
    common.ship(spark)
    known = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").alias("_lang")).where((common.crc_mod("_id", 3) != 1) & F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    counts = {r["_lang"]: r["count"] for r in known.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(LANGS).collect()}
    langs = sorted(counts)
    found = {r.c: r.n for r in known.select("_text").mapInArrow(common.frugal(_frequencies), "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toLocalIterator()}
    total = found.pop(-1, 0)
    idf = np.zeros(1 << BITS)
    for c, n in found.items():
        idf[c] = np.log((1 + total) / (1 + n)) + 1
    model = Model(langs, idf)
    if len(langs) == 0:
        return model
    per_lang = min(per_lang, max(1, TRAIN_DOCS // len(langs)))
    share = F.create_map(*[x for g in langs for x in (F.lit(g), F.lit(min(1.0, per_lang / counts[g])))])[F.col("_lang")]
    draw = F.pmod(F.xxhash64("_id", "_text"), F.lit(1 << 20)) / (1 << 20)
    # most rows leave before their text is turned into a vector; the sample is bounded by per_lang
    sample = known.where(draw < share).select("_text", "_lang", (F.pmod(F.xxhash64("_id", F.lit("t")), F.lit(5)) == 0).alias("later"))
    shared = spark.sparkContext.broadcast(idf)

    def vectors(batches):
        for b in batches:
            at, v = zip(*[vector(t, shared.value) for t in common.as_bytes(b.column(0))], strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array([x.astype(np.float32) for x in v], pa.list_(pa.float32())), b.column(1), b.column(2)], ["at", "v", "lang", "later"])

    number = {g: k for k, g in enumerate(langs)}
    now, later = [], []
    for b in sample.mapInArrow(common.frugal(vectors), "at array<int>, v array<float>, lang string, later boolean").toArrow().to_batches():
        for k in range(b.num_rows):
            row = (b.column(0)[k].values.to_numpy(), b.column(1)[k].values.to_numpy().astype(float), number[b.column(2)[k].as_py()])
            (later if b.column(3)[k].as_py() else now).append(row)
    now.sort(key=lambda r: (r[2], len(r[0]), float(r[1].sum())))
    ftrl(now or later, model)
    if later:
        logits, y = np.array([model.logits(a, v) for a, v, _ in later]), np.array([r[2] for r in later])
        grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; ``und`` with score 0 if the text is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            langs, scores = shared.value.predict(common.as_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    return common.with_text_only(docs, id_col, text_col).mapInArrow(common.frugal(run), f"`{id_col}` {kind}, lang_pred string, score double")


def remove_unidentified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows with a language, predicted with at least this probability; columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            langs, scores = shared.value.predict(common.as_bytes(b.column(text_col)))
            yield b.filter(pa.array([g != UNKNOWN and s >= least for g, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(common.frugal(run), docs.schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs)
    return predict(docs, model).select("doc_id", F.coalesce(common.crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
