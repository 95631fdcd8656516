"""Language-model scoring by deleted interpolation of a word trigram model.

p(w | u, v) = l3[b] * c(u, v, w) / c(u, v) + l2[b] * c(v, w) / c(v) + l1[b] * c(w) / N + l0[b] / (V + 1), with b the
bucket (power of two) of the frequency of the longest context that was seen. The weights are learned by
expectation-maximisation on held-out counts: the tokens of the training rows whose crc32(id) mod 5 is 2, each with the
occurrences of its own document deleted from the counts. Where no row falls there, all training rows serve.

A document that the model learnt from is scored in the same way, with its own tokens deleted: its score is what a
model of all other documents gives it, as it is for documents that were held out. So a document stands out only if
others are like it.

Counts are those of all training rows and never held in one place. Each task writes its rows as chunks of about
CHUNK_BYTES of text to the shared folder; from there on only names move, the texts themselves are not shuffled. A
chunk sends each of its distinct n-grams once, with its count there, to the n-gram's hash range, as sorted arrays; the
range adds the chunks' counts and answers each array with the totals; the chunk's tokens then find their totals by
position. So a frequent n-gram is one entry of each chunk. n-grams are told apart by hashes: words by 63 bits,
bigrams and trigrams by 48, so that among 10**9 kinds one in 300,000 takes another's counts as well.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

CHUNK_BYTES = 12 << 20
#: Distinct n-grams of all chunks in one hash range, about.
RANGE_ENTRIES = 1 << 21
EM_STEPS = 40
#: Steps of a factor of two into which EM sorts probabilities.
GRID = 2
_NONE = -9999
_END, _START = np.uint64(0x51ED270B3A5C9E21), np.uint64(0xA3B195354A39B70D)
#: Lowest bits of a key that are left out: of words, bigrams, trigrams.
_FREE = (1, 16, 16)
#: Buckets of contexts of two words lie above those of one.
_LONG = 70


# ---------------------------------------------------------------- chunks
def _write_chunks(folder: str):
    def write(batches):
        # rows of the fold have chunks of their own
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def close(fold):
            table = pa.Table.from_batches(held[fold]).combine_chunks()
            uri = f"{folder}/{uuid.uuid4().hex}.chunk"
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            common.put_file(uri, sink.getvalue().to_pybytes())
            held[fold], size[fold] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([fold])], ["chunk", "fold"])

        for b in batches:
            of = b.column("_fold").to_numpy(zero_copy_only=False).astype(bool)
            lengths = np.diff(np.append(0, np.cumsum([len(x) + 1 for x in common.as_bytes(b.column("_text"))])))
            for fold in (False, True):
                mine = np.flatnonzero(of == fold)
                for i, j in common.pieces(lengths[mine].tolist(), CHUNK_BYTES):
                    more = int(lengths[mine[i:j]].sum())
                    if size[fold] and size[fold] + more > CHUNK_BYTES:
                        yield close(fold)
                    held[fold].append(b.select(["_id", "_text", "_held", "_learn"]).take(pa.array(mine[i:j])))
                    size[fold] += more
        for fold in (False, True):
            if held[fold]:
                yield close(fold)

    return write


def _read_chunk(uri: str) -> pa.Table:
    return pa.ipc.open_file(common.open_file(uri)).read_all().combine_chunks()


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every token, its row, whether its row is learnt from); the end of a text is its last token."""
    texts = common.as_bytes(table.column("_text").combine_chunks())
    n = len(texts)
    token, row = [], []
    for i, j in common.pieces([len(t) + 1 for t in texts], 4 * common.SLICE_BYTES):
        words = common.Words(texts[i:j])
        part = np.full(len(words.start) + j - i, _END, np.uint64)
        part[np.arange(len(words.start)) + words.doc] = words.hashes()
        token.append(part)
        row.append(np.repeat(np.arange(i, j), words.count + 1))
    learn = table.column("_learn").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    row = np.concatenate(row) if n else np.empty(0, np.int64)
    return np.concatenate(token) if n else np.empty(0, np.uint64), row, learn[row]


def _keys(token: np.ndarray, row: np.ndarray):
    """Keys of the unigram, bigram and trigram that end at each token; their free bits are zero."""
    first = np.diff(row, prepend=-1) != 0
    one = np.empty_like(token)
    one[1:] = token[:-1]
    one[first] = _START
    two = np.empty_like(token)
    two[1:] = one[:-1]
    two[first] = _START
    with np.errstate(over="ignore"):
        pair = token * common.ORDER[0] + one * common.ORDER[1]
        yield token & ~np.uint64((1 << _FREE[0]) - 1)
        yield common.mix(pair) & ~np.uint64((1 << _FREE[1]) - 1)
        yield common.mix(pair + two * common.ORDER[2]) & ~np.uint64((1 << _FREE[2]) - 1)


# ---------------------------------------------------------------- counts
def _pack_counts(c: np.ndarray) -> bytes:
    """Counts in the narrowest of 8, 32 and 64 bits, compressed."""
    top = int(c.max()) if len(c) else 0
    kind = "<u1" if top < 256 else "<u4" if top < 1 << 32 else "<u8"
    return kind[-1].encode() + zstandard.ZstdCompressor(level=1).compress(c.astype(kind).tobytes())


def _unpack_counts(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), f"<u{b[:1].decode()}")


def _pack_keys(keys: np.ndarray, order: int) -> bytes:
    """Ascending keys as differences, byte by byte: the high bytes are nearly all zero."""
    steps = np.diff(keys >> np.uint64(_FREE[order]), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack_keys(b: bytes, order: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64) << np.uint64(_FREE[order])


_ASKED = "chunk string, ord int, range long, keys binary, counts binary"


def _ask(bits: int):
    def ask(batches):
        for b in batches:
            for uri in b.column("chunk").to_pylist():
                token, row, learn = _tokens(_read_chunk(uri))
                for order, keys in enumerate(_keys(token, row)):
                    marked = np.sort(keys | learn.astype(np.uint64))
                    bare = marked & ~np.uint64(1)
                    first = np.flatnonzero(np.diff(bare, prepend=~bare[:1]))
                    counts = np.add.reduceat((marked & np.uint64(1)).astype(np.int64), first)
                    bare = bare[first]
                    ranges = bare >> np.uint64(64 - bits)
                    cut = np.flatnonzero(np.diff(ranges, prepend=~ranges[:1])).tolist() + [len(bare)]
                    n = len(cut) - 1
                    cols = [[uri] * n, [order] * n, ranges[cut[:-1]].astype(np.int64), [_pack_keys(bare[i:j], order) for i, j in zip(cut, cut[1:], strict=False)], [_pack_counts(counts[i:j]) for i, j in zip(cut, cut[1:], strict=False)]]
                    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["chunk", "ord", "range", "keys", "counts"])

    return ask


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """The totals of every n-gram of one hash range, in the order in which each chunk asked."""
    order = key[0].as_py()
    asked = [_unpack_keys(k, order) for k in table.column("keys").to_pylist()]
    _, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.concatenate([_unpack_counts(c).astype(np.int64) for c in table.column("counts").to_pylist()])
    totals = np.bincount(inverse, counts).astype(np.int64)
    out, at = [], 0
    for a in asked:
        out.append(_pack_counts(totals[inverse[at : at + len(a)]]))
        at += len(a)
    n = len(out)
    # what this range adds to N and V, told once
    types, tokens = (int((totals > 0).sum()), int(counts.sum())) if order == 0 else (0, 0)
    return pa.table({"chunk": table.column("chunk"), "ord": pa.array([order] * n, pa.int32()), "range": pa.array([key[1].as_py()] * n, pa.int64()), "totals": pa.array(out, pa.binary()), "types": pa.array([types] + [0] * (n - 1), pa.int64()), "tokens": pa.array([tokens] + [0] * (n - 1), pa.int64())})


class Totals:
    """Of each token of a chunk: full, the training count of its word; and after the tokens of its own document are
    deleted: word, pair and triple, the counts of the n-grams that end there; one and two, those of their contexts;
    n, all training tokens."""

    def __init__(self, docs: pa.Table, answers: pa.Table, n: int):
        token, self.row, learn = _tokens(docs)
        order_of, range_of, blobs = answers.column("ord").to_numpy(), answers.column("range").to_numpy(), answers.column("totals").to_pylist()
        counts = []
        for order, keys in enumerate(_keys(token, self.row)):
            mine = np.flatnonzero(order_of == order)
            totals = np.concatenate([_unpack_counts(blobs[k]) for k in mine[np.argsort(range_of[mine])]]).astype(np.int64)
            # tokens of one kind lie together, and among them those of one document, as the sort is stable
            at = np.argsort(keys, kind="stable")
            kind = np.diff(keys[at], prepend=~keys[at[:1]]) != 0
            own = kind | (np.diff(self.row[at], prepend=-1) != 0)
            kind, own = np.cumsum(kind) - 1, np.cumsum(own) - 1
            if kind[-1] + 1 != len(totals):
                raise RuntimeError("a chunk's answers don't belong to its documents")
            found, mine = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            found[at], mine[at] = totals[kind], np.bincount(own)[own]
            if order == 0:
                self.full = found
            counts.append(found - mine * learn)
        self.word, self.pair, self.triple = counts
        first = np.diff(self.row, prepend=-1) != 0
        last = np.append(first[1:], True)
        # the start of a text is seen as often as an end: that of its own document is its last token
        begins = self.word[last][self.row]
        self.one, self.two = np.empty_like(self.word), np.empty_like(self.word)
        self.one[1:], self.two[1:] = self.word[:-1], self.pair[:-1]
        self.one[first] = self.two[first] = begins[first]
        length = np.bincount(self.row)[self.row]
        self.n = np.maximum(1, n - length * learn)
        self.learn = learn

    def buckets(self) -> np.ndarray:
        """0 without a known context, 1 + floor(log2) of the longest that is known, plus _LONG if it has two words."""
        log = lambda c: np.frexp(c.astype(float))[1].astype(np.int64)
        return np.where(self.two > 0, _LONG + log(self.two), log(self.one))

    def parts(self) -> list[np.ndarray]:
        """c(u, v, w) / c(u, v), c(v, w) / c(v), c(w) / N."""
        return [self.triple / np.maximum(self.two, 1), self.pair / np.maximum(self.one, 1), self.word / self.n]


# ---------------------------------------------------------------- weights
def _cells(n: int):
    """Counts of learnt tokens by bucket and the probabilities of the three orders, on a grid."""

    def cells(key: tuple, answers: pa.Table) -> pa.Table:
        t = Totals(_read_chunk(key[0].as_py()), answers, n)
        code = t.buckets()
        with np.errstate(divide="ignore"):
            for p in t.parts():
                # 256 steps of the grid and one for none
                code = code * 512 + np.where(p > 0, np.clip(-np.round(GRID * np.log2(p)), 0, 510), 511).astype(np.int64)
        kinds, counts = np.unique(code[t.learn], return_counts=True)
        return pa.table({"code": kinds, "n": counts})

    return cells


def learn_weights(cells: list[tuple[int, int]], types: int) -> np.ndarray:
    """Expectation-maximisation on (code, count): bucket -> [l3, l2, l1, l0]; a bucket without tokens takes those of
    the next lower one."""
    weights = np.tile(np.array([0.3, 0.2, 0.4, 0.1]), (2 * _LONG, 1))
    weights[:_LONG] = [0, 0.4, 0.5, 0.1]
    weights[0] = [0, 0, 0.9, 0.1]
    if cells:
        code, count = np.array([c for c, _ in cells], np.int64), np.array([n for _, n in cells], float)
        p = []
        for _ in range(3):
            code, q = code // 512, code % 512
            p.insert(0, np.where(q < 511, 2.0 ** (-q / GRID), 0.0))
        b, p = code, np.stack([*p, np.full(len(code), 1 / (types + 1))])
        for _ in range(EM_STEPS):
            part = weights[b].T * p
            part /= np.maximum(part.sum(0), 1e-300)
            total = np.stack([np.bincount(b, part[k] * count, 2 * _LONG) for k in range(4)], 1)
            seen = total.sum(1) > 0
            # one token's worth of each of the last two, so that no weight ends at zero where it can be needed
            total = total + np.array([0, 0, 1, 1])
            weights[seen] = total[seen] / total[seen].sum(1, keepdims=True)
        for k in range(1, 2 * _LONG):
            if k not in (1, _LONG) and not (b == k).any() and (k < _LONG or k > _LONG + 1):
                weights[k] = weights[k - 1]
    return weights


# ---------------------------------------------------------------- scores
def _score(n: int, v: int, weights: np.ndarray, kind: pa.DataType, id_col: str):
    def score(key: tuple, answers: pa.Table) -> pa.Table:
        docs = _read_chunk(key[0].as_py())
        rows, t = docs.num_rows, Totals(docs, answers, n)
        w = weights[t.buckets()]
        p = w[:, 3] / (v + 1)
        for k, part in enumerate(t.parts()):
            p = p + w[:, k] * part
        base = np.log10((t.full + 0.5) / (n + 0.5 * (v + 1)))
        return pa.table(
            {
                id_col: docs.column("_id").cast(kind), "held_out": docs.column("_held"), "n_tokens": np.bincount(t.row, minlength=rows), "n_known": np.bincount(t.row, t.full > 0, rows).astype(np.int64),
                "train_tokens": np.full(rows, n, np.int64), "base_score": np.bincount(t.row, base, rows), "score": np.bincount(t.row, np.log10(p), rows),
            }
        )

    return score


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and an end. A null or empty text has the end
    only. Rows whose crc32(id as text) mod 5 is 1 aren't learnt from, nor are rows without an id (held_out false).
    Repeated rows count each; other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rest = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), F.coalesce(rest == 1, F.lit(False)).alias("_held"), F.coalesce(rest != 1, F.lit(False)).alias("_learn"), F.coalesce(rest == 2, F.lit(False)).alias("_fold"))
    size = rows.agg(F.sum(F.octet_length("_text") + 1)).first()[0] or 0
    bits = min(32, max(8, math.ceil(math.log2(max(1, size / 5 / RANGE_ENTRIES)))))
    folder = f"{common.work_dir(spark)}/lm-{uuid.uuid4().hex}"
    chunks = common.store(rows.mapInArrow(common.frugal(_write_chunks(folder)), "chunk string, fold boolean"), "lm-chunks")
    n_chunks = max(1, chunks.count())
    asked = chunks.select("chunk").repartition(n_chunks, "chunk").mapInArrow(common.frugal(_ask(bits)), _ASKED)
    answers = common.store(asked.groupBy("ord", "range").applyInArrow(_answer, "chunk string, ord int, range long, totals binary, types long, tokens long"), "lm-totals")
    told = answers.agg(F.sum("types"), F.sum("tokens")).first()
    v, n = told[0] or 0, told[1] or 0
    # a chunk is much work for few bytes: partitions go by their number
    totals = answers.select("chunk", "ord", "range", "totals")

    fold = chunks.where("fold").select("chunk")
    some = fold if not fold.isEmpty() else chunks.select("chunk")
    cells = totals.join(some, "chunk", "left_semi").repartition(2 * n_chunks, "chunk").groupBy("chunk").applyInArrow(_cells(n), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    # at most a row for each cell of the grid that occurs
    weights = learn_weights([(r.code, r.n) for r in cells.toLocalIterator()], v)

    kind = docs.schema[id_col].dataType
    done = totals.repartition(2 * n_chunks, "chunk").groupBy("chunk").applyInArrow(_score(n, v, weights, to_arrow_type(kind), id_col), f"`{id_col}` {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
