"""Near-duplicate detection: banded MinHash, odd sketches as filter, links confirmed on full sets.

1. A pass over the texts makes each document's shingle set (5-word runs of A-Z lower-cased words), its
   digest, MinHash values in bands (125 in 25 bands of 5 at a similarity of 0.85, 140 in 35 of 4 at 0.8), and an
   odd sketch: the least hash in each of 1024 bins is a MinHash sample, and all samples are folded into a parity
   bitmap of 2048 bits.
2. Documents with equal sets form a class at once; only class representatives go on.
3. Representatives meet in band buckets. Each is compared with the bucket's smallest id: pairs that the
   population count of the XORed sketches does not rule out are confirmed on their full sets, and
   components come from star contraction on the link table.
4. A bucket that still holds several components is checked across them, in blocks of bounded members and bytes:
   pairs pass the sketches, are left to the first band that they share, and are confirmed on their full sets
   where they meet. Only a link that joins two components leaves the task, so that what is written is
   bounded by the members, though all pairs across components are looked at. Components are then joined.

At a similarity of 0.85 a pair misses all bands with probability 5e-7, at a lower threshold's own with 1e-8 at most;
the sketch filter lies five standard deviations beyond the expectation at the threshold.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SHINGLE = 5
BANDS, ROWS = 25, 5
SKETCH_BITS, BINS = 2048, 1024
#: Members of a bucket, and bytes of their sets, that one task of step 4 has of each of its two blocks, about.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: A bucket of less than one block is dealt to so many smaller ones at most.
FEW_BLOCKS = 4


def banding(percent: int) -> tuple[int, int]:
    """(bands, values in each) for links from this similarity on: lower ones need shorter bands, and more of them."""
    if not 20 <= percent <= 100:
        raise ValueError("percent is from 20 to 100")
    if percent >= 85:
        return BANDS, ROWS
    rows = 4 if percent >= 70 else 3 if percent >= 50 else 2
    return math.ceil(math.log(1e-8) / math.log1p(-((percent / 100) ** rows))), rows


@functools.cache
def _hashes(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of k MinHash functions."""
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**64, k, dtype=np.uint64)


def sketch_limit(sizes: np.ndarray, similarity: float, deviations: float = 5) -> np.ndarray:
    """Largest XOR population count that pairs of this similarity are expected to show, by the sum of their set sizes."""
    union = sizes / (1 + similarity)
    rate = union / BINS
    # a bin's least hash is in one set only with probability 1 - similarity; the other set then has another, or none
    each = 2 - np.exp(-rate * (1 + similarity) / 2)
    bins = BINS * (1 - np.exp(-rate))
    diff = bins * (1 - similarity) * each
    by_sample = bins * similarity * (1 - similarity) * each**2 * (1 - np.exp(-rate))
    n = SKETCH_BITS
    mean = n / 2 * (1 - (1 - 2 / n) ** diff)
    by_fold = n / 4 * (1 - (1 - 4 / n) ** diff)
    return np.floor(mean + 2 + deviations * np.sqrt(by_sample * ((1 - 2 / n) ** diff) ** 2 + by_fold))


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, none without words."""
    out: list[np.ndarray] = []
    for i, j in common.pieces([len(t) + 1 for t in texts]):
        words = common.Words(texts[i:j])
        h = words.hashes()
        s, owner = words.shingles(h, n)
        bounds = np.searchsorted(owner, np.arange(j - i + 1))
        for k in range(j - i):
            if words.count[k] >= n:
                out.append(np.unique(s[bounds[k] : bounds[k + 1]]))
            elif words.count[k]:
                part = h[words.first[k] : words.first[k + 1]]
                with np.errstate(over="ignore"):
                    out.append(common.mix(np.array([(part * common.ORDER[: len(part)]).sum() + np.uint64(len(part))], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, sketch words) of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    mul, add = _hashes(bands * rows)
    low = np.empty((len(sets), bands * rows), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(bands * rows):
            low[:, k] = np.minimum.reduceat(flat * mul[k] + add[k], starts)
        low = common.mix(low)
        keys = low.reshape(len(sets), bands, rows) * common.ORDER[:rows]
        keys = common.mix(keys.sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * common.ORDER[9])
    return keys, np.concatenate([_sketches(sets[i : i + 512]) for i in range(0, len(sets), 512)])


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = owner * BINS + (flat >> np.uint64(54)).astype(np.int64)
    # sets are sorted, so that the first of each bin is its least
    first = np.flatnonzero(np.diff(place, prepend=-1))
    bit = (common.mix(flat[first]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    parity = np.bincount(owner[first] * SKETCH_BITS + bit, minlength=len(sets) * SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8).reshape(len(sets), SKETCH_BITS), axis=1).view(np.uint64)


def _longs(a: np.ndarray) -> pa.Array:
    """A list column from a matrix of 64-bit values."""
    rows, width = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(a).view(np.int64).ravel()))


def _sign(percent: int):
    """(_id, text) -> id, size, digest in two words, band keys, sketch."""
    n_bands, n_rows = banding(percent)

    def sign(batches):
        for batch in batches:
            ids, texts = batch.column(0), common.as_bytes(batch.column(1))
            for i, j in common.pieces([len(t) + 1 for t in texts]):
                sets = shingle_sets(texts[i:j])
                full = [k for k, s in enumerate(sets) if len(s)]
                bands, sketch = np.zeros((j - i, n_bands), np.uint64), np.zeros((j - i, SKETCH_BITS // 64), np.uint64)
                if full:
                    bands[full], sketch[full] = _signatures([sets[k] for k in full], n_bands, n_rows)
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), _longs(bands), _longs(sketch)],
                    ["_id", "n", "d1", "d2", "bands", "sketch"],
                )

    return sign


def _load_sets(batches):
    """(_id, text) -> id, digest and set as sorted 64-bit values."""
    for batch in batches:
        ids, texts = batch.column(0), common.as_bytes(batch.column(1))
        for i, j in common.pieces([len(t) + 1 for t in texts]):
            sets = shingle_sets(texts[i:j])
            raw = [s.tobytes() for s in sets]
            digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(raw, pa.binary())], ["id", "d1", "d2", "shingles"])


def _confirm(percent: int):
    """(a, b, sa, sb) -> the pairs with 100 * intersection >= percent * union."""

    def confirm(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    keep.append(False)
                    continue
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum()) if len(q) else 0
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _within(similarity: float):
    """(a, b, na, nb, sx, sy) -> the pairs that their sketches don't rule out."""

    def within(batches):
        for batch in batches:
            x, y = (batch.column(k).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1) for k in (4, 5))
            z = np.bitwise_count(x ^ y).sum(axis=1)
            yield batch.select([0, 1]).filter(pa.array(z <= sketch_limit(batch.column(2).to_numpy() + batch.column(3).to_numpy(), similarity)))

    return within


def _across(similarity: float, percent: int):
    """Members of one pair of blocks of a bucket -> links between different components, at most one fewer than
    there are components. A pair that shares an earlier band too is left to that band's bucket."""

    def across(table: pa.Table) -> pa.Table:
        side, ids, comp, size = (table.column(c).to_numpy() for c in ("side", "id", "comp", "n"))
        sketch, bands = (table.column(c).combine_chunks().flatten().to_numpy().reshape(len(ids), -1) for c in ("sketch", "bands"))
        sketch, key = sketch.view(np.uint64), table.column("key")[0].as_py()
        raw = table.column("shingles").to_pylist()
        owner = np.repeat(np.arange(len(ids)), [len(x) // 8 for x in raw])
        values, dense = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
        starts = np.searchsorted(owner, np.arange(len(ids)))
        del raw, owner
        ends = np.append(starts[1:], len(dense))
        _, root = np.unique(comp, return_inverse=True)
        mine = np.zeros(len(values), np.int32)
        links = []
        for i in range(len(ids)):
            # side 2: the block met with itself
            others = np.flatnonzero(((side == 2) & (np.arange(len(ids)) > i) if side[i] == 2 else side > side[i]) & (root != root[i]))
            if not len(others):
                continue
            z = np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1)
            others = others[z <= sketch_limit(size[others] + size[i], similarity)]
            same = bands[others] == bands[i]
            others = others[bands[i][same.argmax(axis=1)] == key] if len(others) else others
            if not len(others):
                continue
            mine[dense[starts[i] : ends[i]]] = 1
            both = np.array([mine[dense[starts[j] : ends[j]]].sum() for j in others])
            mine[dense[starts[i] : ends[i]]] = 0
            for j in others[100 * both >= percent * (size[others] + size[i] - both)]:
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        del values, dense, sketch, bands
        common.release()
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return across


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row for each document: id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets. component_id is the
    smallest id reachable, the own one included; kept is doc_id = component_id (null-safe).
    A null or empty text, or one without words, has no shingles and is linked with nothing. Rows that share
    an id count as one document with all their links. A row with a null id joins the component of documents
    with an equal set, and has a null component if none has an id. Other columns are not read.
    """
    spark = docs.sparkSession
    common.ship(spark)
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    signed = common.store(narrow.mapInArrow(common.frugal(_sign(percent)), "_id long, n long, d1 long, d2 long, bands array<long>, sketch array<long>"), "near-signatures")
    known = signed.where("n > 0 AND _id IS NOT NULL")
    classes = common.store(known.groupBy("d1", "d2").agg(F.min("_id").alias("id")), "near-classes")
    # rows that share id and set are one; a class's signature is that of its representative
    marked = known.withColumnRenamed("_id", "id").join(classes.hint("merge"), ["d1", "d2", "id"], "left_semi")

    # keys and sizes are written, so that both sides of their join come from plain exchanges, which are split where a
    # bucket holds much of all documents
    keys = common.store(marked.select("id", F.explode("bands").alias("key")).distinct(), "near-keys")
    buckets = common.store(keys.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("pivot")).where("size > 1"), "near-sizes")
    members = common.store(keys.join(buckets.hint("merge"), "key").select("key", "id", "pivot", "size"), "near-buckets")
    met = members.select("id").distinct()
    sketches = common.store(marked.join(met.hint("merge"), "id", "left_semi").select("id", "n", "sketch"), "near-sketches")

    # the joins are merge joins at any size: neither side is bounded
    sets = common.store(narrow.withColumnRenamed("_id", "id").join(met.hint("merge"), "id", "left_semi").select("id", "_text").mapInArrow(common.frugal(_load_sets), "id long, d1 long, d2 long, shingles binary"), "near-sets")
    similarity = percent / 100

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        return pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "sa", "sb").mapInArrow(common.frugal(_confirm(percent)), "a long, b long")

    star = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    x = sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sx"))
    y = sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sy"))
    star = star.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "na", "nb", "sx", "sy").mapInArrow(common.frugal(_within(similarity)), "a long, b long").distinct()
    comps = connected_components(confirmed(star, sets))

    # buckets that still hold several components
    at = common.store(members.where("size > 2").select("key", "id").join(comps, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp")), "near-at")
    open_keys = common.store(at.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key"), "near-open-keys")
    rest = common.store(at.join(open_keys.hint("merge"), "key", "left_semi"), "near-open")
    if not rest.isEmpty():
        here = rest.select("id").distinct()
        # a document that was given with several texts has a row for each
        known_sets = sets.join(here.hint("merge"), "id", "left_semi").dropDuplicates(["id", "d1", "d2"])
        known_sets = known_sets.join(marked.select("id", "d1", "d2", "n", "sketch", "bands").dropDuplicates(["id", "d1", "d2"]).hint("merge"), ["id", "d1", "d2"])
        # blocks are dealt on narrow rows; a bucket's sets are only moved to the block pairs that need them
        weight = rest.join(marked.groupBy("id").agg(F.max("n").alias("n")).hint("merge"), "id").groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES), F.least(F.lit(FEW_BLOCKS), F.ceil(F.count("*") * FEW_BLOCKS / BLOCK))).cast("int").alias("blocks"))
        dealt = rest.join(common.store(weight, "near-weights").hint("merge"), "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
        dealt = dealt.select("key", "id", "comp", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), side.alias("side"))
        full = dealt.join(known_sets.hint("merge"), "id")
        more = common.store(full.groupBy("key", "p", "q").applyInArrow(_across(similarity, percent), "a long, b long").distinct(), "near-more")
        if not more.isEmpty():
            comps = connected_components(comps.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))

    settled = classes.select("d1", "d2", "id").join(comps, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component"))
    found = signed.select("_id", "n", "d1", "d2").join(settled, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_id"))
    return found.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def remove_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One document of each group, columns unchanged: that with the smallest id (of repeated rows of it, one).

    Documents without an id can't be told apart by it and stay.
    """
    kept = near_duplicates(docs, id_col, text_col, percent).where("kept").select(id_col)
    copies = kept.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("_rows"))
    once, often = copies.where("_rows = 1").select(id_col), copies.where("_rows > 1").select(id_col)
    out = docs.join(once, id_col, "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    if not often.isEmpty():
        out = out.unionByName(docs.join(often, id_col, "left_semi").dropDuplicates([id_col]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


def op7_sql() -> str:
    return f"""
WITH RECURSIVE lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     d AS (SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM lowered),
     s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {SHINGLE - 2}))) AS i FROM d WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
               JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
     reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
     least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(coalesce(m, d.doc_id), d.doc_id) AS component_id, d.doc_id = least(coalesce(m, d.doc_id), d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON a = d.doc_id"""
