"""Benchmark decontamination by a prefix-filtered set join with exact windows.

Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] of the text with A-Z lower-cased. Every window of an
item (13 consecutive words; the whole item if it is shorter) must be found whole, so its necessary
prefix is one shingle: the rarest of its (up to) three-word shingles, rarity being counted over all
items of a block. Documents are joined on that shingle's 64-bit hash by a vectorised binary search; the
position of the shingle in the window bounds where the window can start, the window's length bounds where it
can end, and the words are compared as full strings, so that no hash decides.

The benchmark is the stated query set. It is dealt to blocks of bounded size; each is turned into a sorted
index by the task that has it and written to the shared folder, where the tasks that pass over the documents
memory-map it. Nothing of it is broadcast or comes to the driver but the blocks' names, and documents are
read once and never shuffled, whatever the number of blocks.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 13
SHINGLE = 3
#: Bytes of benchmark text in one block, about; an item stays whole. Its index takes some 15 times that.
BLOCK_BYTES = 4 << 20
#: Indexes of so many bytes stay open in a task; beyond that each is opened anew for each batch of documents.
HELD_BYTES = 256 << 20
_SPLIT = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_FILTER_BITS = 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SPLIT).split()


def _codes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words; runs of different lengths differ."""
    m = max(0, len(hashes) - n + 1)
    with np.errstate(over="ignore"):
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h + hashes[k : k + m] * common.ORDER[k]
    return common.mix(h)


# ---------------------------------------------------------------- index of a block
_ARRAYS = [("keys", "<u8"), ("at", "<i4"), ("length", "<i4"), ("begin", "<i8"), ("end", "<i8"), ("item_start", "<i8"), ("item", "<i4"), ("name_end", "<i8"), ("names", "u1"), ("text", "u1")]


def index_bytes(items: list[tuple[str, bytes]], window: int = WINDOW) -> bytes:
    """The windows of some items, sorted by the hash of their rarest shingle, as one file: a JSON line with the
    arrays' sizes, then the arrays. begin and end: the window's words in text, where they are parted by one space."""
    names = sorted({i for i, _ in items})
    number = {i: k for k, i in enumerate(names)}
    texts = [b" ".join(words_of(t)) for _, t in items]
    words = common.Words(texts, common.ALNUM_WORDS)
    h = words.hashes()
    names_of = np.array([number[i] for i, _ in items], np.int64)
    parts: dict[str, list] = {k: [] for k in ("keys", "at", "length", "begin", "end", "of")}
    sizes = []
    count = words.count
    for length in sorted(set(np.minimum(count[count > 0], window).tolist())):
        # windows of this length: of all longer items if it is the full one, else of the items that are no longer
        first = np.flatnonzero(words.doc[: len(h) - length + 1] == words.doc[length - 1 :])
        first = first[count[words.doc[first]] >= window] if length == window else first[count[words.doc[first]] == length]
        n = min(SHINGLE, length)
        sizes.append(n)
        codes = _codes(h, n)
        _, where, often = np.unique(codes, return_inverse=True, return_counts=True)
        often = often[where].astype(np.int32)
        at, least = np.zeros(len(first), np.int32), often[first]
        for k in range(1, length - n + 1):
            rarer = often[first + k] < least
            at[rarer], least[rarer] = k, often[first + k][rarer]
        parts["keys"].append(codes[first + at])
        parts["at"].append(at)
        parts["length"].append(np.full(len(first), length))
        parts["begin"].append(words.start[first])
        parts["end"].append(words.end[first + length - 1])
        parts["of"].append(names_of[words.doc[first]])
    flat = {k: np.concatenate(x) if x else np.empty(0, np.int64) for k, x in parts.items()}
    text = words.buf.tobytes()
    # equal windows become one entry with all its items; the strings decide
    order = np.lexsort((flat["begin"], flat["keys"].astype(np.uint64)))
    flat = {k: x[order] for k, x in flat.items()}
    run = np.cumsum(np.diff(flat["keys"].astype(np.uint64), prepend=np.uint64(0)) != 0)
    leader = np.arange(len(run))
    last, spellings = -1, {}
    for k in np.flatnonzero(np.bincount(run)[run] > 1).tolist() if len(run) else ():
        if run[k] != last:
            last, spellings = run[k], {}
        leader[k] = spellings.setdefault(text[flat["begin"][k] : flat["end"][k]], k)
    pick = np.flatnonzero(leader == np.arange(len(run)))
    pairs = np.unique(np.stack([np.searchsorted(pick, leader), flat["of"]], 1), axis=0)
    encoded = [x.encode() for x in names]
    arrays = {k: flat[k][pick] for k in ("keys", "at", "length", "begin", "end")}
    arrays |= {
        "item_start": np.searchsorted(pairs[:, 0], np.arange(len(pick) + 1)), "item": pairs[:, 1], "name_end": np.cumsum([len(x) for x in encoded]),
        "names": np.frombuffer(b"".join(encoded), np.uint8), "text": words.buf,
    }
    raw = [arrays[k].astype(t).tobytes() for k, t in _ARRAYS]
    raw = [x.ljust((len(x) + 7) // 8 * 8, b"\0") for x in raw]
    head = json.dumps({"n": [len(arrays[k]) for k, _ in _ARRAYS], "sizes": sorted(set(sizes))}).encode() + b"\n"
    return head[:-1].ljust((len(head) + 7) // 8 * 8 - 1) + b"\n" + b"".join(raw)


class Index:
    """Windows of one block of items, memory-mapped where the shared folder is mounted."""

    def __init__(self, data):
        head = data[: 1 << 12].to_pybytes() if isinstance(data, pa.Buffer) else bytes(data[: 1 << 12])
        at = head.index(b"\n") + 1
        told = json.loads(head[:at])
        self.sizes = told["sizes"]
        for n, (name, kind) in zip(told["n"], _ARRAYS, strict=True):
            setattr(self, name, np.frombuffer(data, kind, n, at))
            at += (n * np.dtype(kind).itemsize + 7) // 8 * 8
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.keys >> np.uint64(64 - _FILTER_BITS)] = True

    def items_of(self, entry: int) -> list[str]:
        out = []
        for k in self.item[self.item_start[entry] : self.item_start[entry + 1]].tolist():
            out.append(self.names[int(self.name_end[k - 1]) if k else 0 : int(self.name_end[k])].tobytes().decode())
        return out

    def find(self, words: common.Words, hashes: np.ndarray, texts: list[bytes], spans: list[list], items: list[set]) -> None:
        """Adds (start, end) of every occurrence of a window in each text, and the items found there."""
        spelled: dict[int, list[bytes]] = {}
        for n in self.sizes:
            codes = _codes(hashes, n)
            place = np.flatnonzero(self.maybe[codes >> np.uint64(64 - _FILTER_BITS)])
            place = place[words.doc[place] == words.doc[place + n - 1]]
            left, right = (np.searchsorted(self.keys, codes[place], side) for side in ("left", "right"))
            hit = np.flatnonzero(right > left)
            for p, a, b in zip(place[hit].tolist(), left[hit].tolist(), right[hit].tolist(), strict=True):
                d = int(words.doc[p])
                here = p - int(words.first[d])
                if d not in spelled:
                    spelled[d] = words_of(texts[d])
                mine = spelled[d]
                for e in range(a, b):
                    i, length = here - int(self.at[e]), int(self.length[e])
                    if min(SHINGLE, length) == n and i >= 0 and i + length <= len(mine) and b" ".join(mine[i : i + length]) == self.text[self.begin[e] : self.end[e]].tobytes():
                        spans[d].append((i, i + length))
                        items[d].update(self.items_of(e))


def store_index(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> list[str]:
    """Write the blocks' indexes to the shared folder; their names and sizes. Items are dealt to blocks by hash."""
    spark = benchmark.sparkSession
    common.ship(spark)
    rows = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("i"), F.col(f"`{text_col}`").alias("t")).where("t IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    folder = f"{common.work_dir(spark)}/windows-{uuid.uuid4().hex}"
    blocks = max(1, -(-total // BLOCK_BYTES))

    def build(batches):
        items = [(i, t.encode()) for b in batches for i, t in zip(b.column("i").to_pylist(), b.column("t").to_pylist(), strict=True)]
        if items:
            data = index_bytes(items, window)
            uri = f"{folder}/{uuid.uuid4().hex}.index"
            common.put_file(uri, data)
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(data)], pa.int64())], ["uri", "size"])

    placed = rows.coalesce(1) if blocks == 1 else rows.repartition(blocks, F.xxhash64("i", "t"))
    return sorted((r.uri, r.size) for r in common.store(placed.mapInArrow(common.frugal(build), "uri string, size long"), "windows").collect())


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPANS = "array<struct<a:long,b:long>>"


def find_windows(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", text_col: str = "text", window: int = WINDOW, keep: str = "all", share: int = 20) -> DataFrame:
    """Occurrences of benchmark windows in every document.

    keep="all": all columns of docs but for clashes are dropped: the result has ``_row`` (struct of the
    columns of docs without the text), n_words, spans (merged word ranges that are hit), items (ids as
    text, sorted as strings). keep="clean": the rows of docs, columns unchanged, that are not contaminated
    (n_hit > 0 and share * n_hit >= n_words).

    A null or empty text has no words and is clean. An item without words has no window; items with a
    null id count as the item ``null``. Repeated items count once, repeated documents are judged each.
    """
    common.ship(docs.sparkSession)
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None)
    state = docs.select(row.alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    kind = state.schema["_row"].dataType.simpleString()
    found = _scan(store_index(benchmark, item_col, item_text, window), share if keep == "clean" else 0)
    if keep == "all":
        return state.mapInArrow(common.frugal(found), f"_row {kind}, n_words long, spans {SPANS}, items array<string>")
    state = state.mapInArrow(common.frugal(found), f"_row {kind}, _text string")
    return state.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def _scan(blocks: list[tuple[str, int]], share: int):
    """mapInArrow function: what the blocks' windows find; with share > 0 the clean rows and their texts."""
    held = sum(size for _, size in blocks) <= HELD_BYTES

    def scan(batches):
        def opened(uri):
            return Index(common.open_file(uri).read_buffer())

        kept = [opened(uri) for uri, _ in blocks] if held else None
        for b in batches:
            texts = common.as_bytes(b.column("_text"))
            n_words = np.zeros(len(texts), np.int64)
            spans: list[list] = [[] for _ in texts]
            items: list[set] = [set() for _ in texts]
            for k in range(len(blocks)):
                index = kept[k] if kept else opened(blocks[k][0])
                for i, j in common.pieces([len(t) + 1 for t in texts]):
                    words = common.Words(texts[i:j], common.ALNUM_WORDS)
                    n_words[i:j] = words.count
                    index.find(words, words.hashes(), texts[i:j], spans[i:j], items[i:j])
            if not blocks:
                n_words[:] = [len(words_of(t)) for t in texts]
            merged = [_merged(s) for s in spans]
            if share:
                hit = np.array([sum(y - x for x, y in s) for s in merged], np.int64)
                yield b.filter(pa.array(~((hit > 0) & (share * hit >= n_words))))
            else:
                pairs = pa.array([[{"a": x, "b": y} for x, y in s] for s in merged], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
                yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(n_words), pairs, pa.array([sorted(x) for x in items], pa.list_(pa.string()))], ["_row", "n_words", "spans", "items"])

    return scan


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, columns unchanged."""
    return find_windows(docs, benchmark, keep="clean")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_windows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.b - x.a)
    return found.select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op2_sql() -> str:
    return f"""
WITH lowered AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     d AS (SELECT r, doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM lowered),
     b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
     wins AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS l, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS win
              FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - {WINDOW - 2}))) AS i FROM b WHERE len(w) > 0)),
     lens AS (SELECT DISTINCT l FROM wins),
     places AS (SELECT r, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS win FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)),
     hits AS (SELECT r, i, places.l AS l, item FROM places JOIN wins USING (l, win)),
     words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hits) GROUP BY r),
     found AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(found.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""
