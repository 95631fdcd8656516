"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Each text gives a vector of document statistics (lengths, shares of byte classes, repetition). Random
cosines of the standardised vector approximate a Gaussian kernel. Each partition sums its part of the
normal equations; the ridge solution of their total gives a raw score, and isotonic regression on rows
that were not used for it turns that into the share of good documents.

The fit uses at most TRAIN_ROWS labelled rows, those with the smallest hash of their id. Labels come only
from rows whose crc32(id as text) mod 3 is not 1: remainder 0 fits the ridge and 2 the calibration.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TRAIN_ROWS = 100_000
FEATURES = 256
RIDGE = 1e-4
#: Cells of raw score into which calibration rows are counted.
CELLS = 2000

_CLASSES = [
    common._table(lambda b: 65 <= b <= 90), common._table(lambda b: 97 <= b <= 122), common._table(lambda b: 48 <= b <= 57), common._table(lambda b: b >= 128), common._table(lambda b: b == 32), common._table(lambda b: b == 10),
    common._table(lambda b: b in b".,;:"), common._table(lambda b: b in b"!?"), common._table(lambda b: b in b"#*$%&<>"), common._table(lambda b: b in b"|/\\_=+~^{}[]@"), common._table(lambda b: b in b"\"'()-"),
]
N_STATS = len(_CLASSES) + 14


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of N_STATS document statistics for each text; zeros for an empty one."""
    rows = [_slice_statistics(texts[i:j]) for i, j in common.pieces([len(t) + 1 for t in texts])]
    return np.concatenate(rows) if rows else np.zeros((0, N_STATS), np.float32)


def _slice_statistics(texts: list[bytes]) -> np.ndarray:
    words = common.Words(texts, lower=False)
    n = len(texts)
    size = np.diff(words.offsets) - 1.0
    count = words.count.astype(float)
    some, many = np.maximum(size, 1), np.maximum(count, 1)
    out = np.zeros((n, N_STATS))
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(count)
    for k, table in enumerate(_CLASSES):
        out[:, 2 + k] = np.add.reduceat(table[words.buf], words.offsets[:-1], dtype=np.int64) / some
    # the \n that ends each text in the buffer isn't its own
    out[:, 2 + 5] -= 1 / some
    k = 2 + len(_CLASSES)
    length = (words.end - words.start).astype(float)
    total = lambda x: np.bincount(words.doc, x, n)
    mean = total(length) / many
    out[:, k] = mean
    out[:, k + 1] = np.sqrt(np.maximum(total(length**2) / many - mean**2, 0))
    last = words.buf[words.end - 1] if len(words.end) else words.buf[:0]
    first = words.buf[words.start] if len(words.start) else words.buf[:0]
    out[:, k + 2] = total(_CLASSES[8][last] | _CLASSES[7][last] | _CLASSES[9][last]) / many
    out[:, k + 3] = total(_CLASSES[0][first]) / many
    out[:, k + 4] = total(length == 1) / many
    out[:, k + 5] = total(length > 20) / many
    h = words.hashes()
    same = np.concatenate(([False], (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1]))) if len(h) else np.empty(0, bool)
    out[:, k + 6] = total(same) / many
    tri, owner = words.shingles(h, 3)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    for d in range(n):
        a, b = words.first[d], words.first[d + 1]
        if b > a:
            c = np.unique_counts(h[a:b]).counts
            out[d, k + 7], out[d, k + 8] = len(c) / (b - a), c.max() / (b - a)
            t = tri[bounds[d] : bounds[d + 1]]
            out[d, k + 9] = len(np.unique(t)) / len(t) if len(t) else 1
            lines = [x for x in texts[d].split(b"\n") if x.strip()]
            out[d, k + 10], out[d, k + 11] = len(set(lines)) / max(1, len(lines)), np.log1p((b - a) / max(1, len(lines)))
    return out.astype(np.float32)


class Model:
    """Raw scores by random cosines and ridge weights; calibrated by a step function of knots."""

    def __init__(self, seed: int = 5):
        g = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = np.zeros(N_STATS), np.ones(N_STATS)
        self.w = g.normal(0, 1 / np.sqrt(N_STATS), (N_STATS, FEATURES))
        self.phase = g.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.knots, self.levels = np.array([0.0]), np.array([0.5])

    def design(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / FEATURES) * np.cos(x @ self.w + self.phase)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.design(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots at the mean x of each pool and its level. x ascending."""
    pools: list[list[float]] = []
    for a, b, w in zip(x.tolist(), y.tolist(), weight.tolist(), strict=True):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def _stat_batches(batches):
    """(_id, _text, y, part) -> y, part, stats."""
    for b in batches:
        s = statistics(common.as_bytes(b.column(0)))
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(list(s), pa.list_(pa.float32()))], ["y", "part", "stats"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), N_STATS).astype(float)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    """Rows with a null id, label or text aren't learnt from. Without labelled rows every score is 0.5.
    Of repeated labels of an id the largest counts."""
    spark = docs.sparkSession
    common.ship(spark)
    rest = common.crc_mod(id_col, 3)
    known = labels.where(F.col(f"`{label_col}`").isNotNull() & (rest != 1)).groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.max(f"`{label_col}`").cast("double").alias("y"))
    chosen = common.checkpoint(known.orderBy(F.xxhash64("_id"), "_id").limit(train_rows))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).where("_text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), "_id").select("_text", "y", (F.crc32(F.col("_id").cast("string").cast("binary")) % 3).cast("int").alias("part"))
    rows = common.store(rows.mapInArrow(common.frugal(_stat_batches), "y double, part int, stats array<float>"), "quality-stats")
    model = Model()
    moments = rows.where("part = 0").agg(F.count("*"), *[f(F.col("stats")[k].cast("double")) for k in range(N_STATS) for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0]:
        return model
    model.mean = np.array(moments[1::2])
    model.scale = np.maximum(np.array(moments[2::2]), 1e-6)
    here = spark.sparkContext.broadcast(model)
    width = FEATURES + 1

    def sums(batches):
        a, c = np.zeros((width, width)), np.zeros(width)
        for b in batches:
            z = here.value.design(_matrix(b.column(1)))
            a, c = a + z.T @ z, c + z.T @ b.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(np.hstack([a, c[:, None]])), pa.list_(pa.float64()))], ["i", "row"])

    # the labelled sample is bounded, so are its partitions
    parts = rows.where("part = 0").select("y", "stats").coalesce(16).mapInArrow(common.frugal(sums), "i long, row array<double>")
    total = np.zeros((width, width + 1))
    for r in parts.toLocalIterator():
        total[r.i] += np.array(r.row)
    a = total[:, :-1] + RIDGE * moments[0] * np.diag([1.0] * FEATURES + [0.0])
    model.beta = np.linalg.lstsq(a, total[:, -1], rcond=None)[0]
    fitted = spark.sparkContext.broadcast(model)

    def raw(batches):
        for b in batches:
            cell = np.floor(np.clip(fitted.value.raw(_matrix(b.column(1))), -1, 2) * CELLS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell)], ["y", "cell"])

    cells = rows.where("part = 2").select("y", "stats").mapInArrow(common.frugal(raw), "y double, cell double").groupBy("cell").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("cell").toPandas()
    if len(cells):
        model.knots, model.levels = isotonic((cells.cell.to_numpy() + 0.5) / CELLS, cells.y.to_numpy(), cells.n.to_numpy(float))
    else:
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; a null text counts as empty. Labels, ids and other columns are no inputs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(statistics(common.as_bytes(b.column(1)))))], [id_col, "score"])

    return common.with_text_only(docs, id_col, text_col).mapInArrow(common.frugal(run), f"`{id_col}` {kind}, score double")


def remove_low_quality(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose score is at least ``least``, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = shared.value.score(statistics(common.as_bytes(b.column(text_col))))
            yield b.filter(pa.array(s >= least))

    return docs.mapInArrow(common.frugal(run), docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", F.coalesce(common.crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
