"""Token-ID files: independent zstandard frames with a trailing seek table and per-frame checksums.

Layout of a shard:

* frames: each an ordinary zstandard frame holding the ids of consecutive documents as little-endian
  unsigned 32-bit integers. A frame closes at FRAME_IDS ids; a longer document has a frame of its own.
* a skippable frame (magic 0x184D2A50) with the document index: for each document its id (int64), a null
  flag (uint8), its number of ids (uint32) and its frame (uint32), as one zstandard frame.
* a skippable frame (magic 0x184D2A5E), the seek table: for each frame the compressed size, the
  decompressed size and the low 32 bits of the xxhash64 of its content (three uint32), then the number of
  frames (uint32), a flag byte and the footer magic 0x8F92EAB1, as in zstandard's seekable format.

A reader loads the footer, the table and the index, and decompresses only frames with wanted documents.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FRAME_IDS = 1 << 15
END_ID = 1
#: Bytes of text in one shard, at most, unless one document has more.
SHARD_BYTES = 32 << 20
#: Cached spellings in one worker; beyond that the cache starts anew.
CACHE_WORDS = 300_000
#: Documents whose texts are copied out of an Arrow batch at a time.
ROWS_AT_ONCE = 256
_INDEX, _TABLE, _FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class ShardWriter:
    def __init__(self, level: int = 1):
        self.out: list[bytes] = []
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []
        self.open: list[bytes] = []
        self.size = 0
        self.pack = zstandard.ZstdCompressor(level=level)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.open and self.size + len(ids) > 4 * FRAME_IDS:
            self._close()
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4, len(self.frames)))
        self.open.append(ids)
        self.size += len(ids)

    def _close(self) -> None:
        raw = b"".join(self.open)
        data = self.pack.compress(raw)
        self.frames.append((len(data), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.out.append(data)
        self.open, self.size = [], 0

    def finish(self) -> bytes:
        if self.open:
            self._close()
        cols = np.array([(a, c, d, b) for a, b, c, d in self.docs], [("id", "<i8"), ("n", "<u4"), ("frame", "<u4"), ("null", "u1")])
        index = self.pack.compress(cols.tobytes())
        table = b"".join(struct.pack("<3I", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, _FOOTER)
        return b"".join([*self.out, struct.pack("<2I", _INDEX, len(index)), index, struct.pack("<2I", _TABLE, len(table)), table])


class ShardReader:
    """Random access to a shard; only the frames of requested documents are decompressed."""

    def __init__(self, uri: str):
        self.file = common.open_file(uri)
        end = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != _FOOTER:
            raise ValueError(f"{uri}: no seek table")
        table_at = end - 9 - 12 * n - 8
        head = struct.unpack("<2I", self._read(table_at, 8))
        if head != (_TABLE, 12 * n + 9):
            raise ValueError(f"{uri}: damaged seek table")
        self.frames = np.frombuffer(self._read(table_at + 8, 12 * n), "<u4").reshape(-1, 3)
        self.starts = np.concatenate(([0], np.cumsum(self.frames[:, 0], dtype=np.int64)))
        magic, size = struct.unpack("<2I", self._read(int(self.starts[-1]), 8))
        if magic != _INDEX:
            raise ValueError(f"{uri}: no document index")
        raw = zstandard.ZstdDecompressor().decompress(self._read(int(self.starts[-1]) + 8, size))
        self.docs = np.frombuffer(raw, [("id", "<i8"), ("n", "<u4"), ("frame", "<u4"), ("null", "u1")])
        self.first = np.concatenate(([0], np.cumsum(self.docs["n"], dtype=np.int64)))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        size, whole, check = (int(x) for x in self.frames[k])
        raw = zstandard.ZstdDecompressor().decompress(self._read(int(self.starts[k]), size), max_output_size=whole) if whole else b""
        if len(raw) != whole or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k}: checksum mismatch")
        return raw

    def __iter__(self):
        """(doc id, ids as bytes, ids before it in the shard) of every document, in order."""
        last, raw, at = -1, b"", 0
        for (i, n, k, null), first in zip(self.docs.tolist(), self.first.tolist(), strict=False):
            if k != last:
                last, raw, at = k, self.frame(k), 0
            yield (None if null else i), raw[at : at + 4 * n], first
            at += 4 * n

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of the documents with this id; only their frames are read."""
        out = []
        for d in np.flatnonzero((self.docs["id"] == doc_id) & (self.docs["null"] == 0)):
            k = int(self.docs["frame"][d])
            at = 4 * int(self.first[d] - self.first[np.flatnonzero(self.docs["frame"] == k)[0]])
            out.append(np.frombuffer(self.frame(k)[at : at + 4 * int(self.docs["n"][d])], "<u4"))
        return out


#: Latin letters that are composed, stable under normalisation and have one plain lower-case form.
_LATIN = "".join(chr(c) for c in range(0xC0, 0x250) if chr(c).isalpha() and chr(c) != "\u0130" and len(chr(c).lower()) == 1 and unicodedata.is_normalized("NFC", chr(c)) and 0xC0 <= ord(chr(c).lower()) < 0x250)
#: Words of these characters only are split here; all others go to the library whole.
_PLAIN = re.compile(rf"[!-~{_LATIN}]+")
#: A single one of these after letters is a piece of its own.
_STOPS = b".,;:!?"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z{_LATIN}0-9]+")


def _byte_signs() -> dict[int, str]:
    """The character that stands for each byte: itself where it can be seen, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Spellings(dict):
    """Spelling -> its ids as bytes, found when first asked for. A piece is a spelling too, so that the pieces of
    longer spellings are kept here as well."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.tokenize = tokenizer, tokenizer.model.tokenize
        self.signs = _byte_signs()

    def __missing__(self, w: bytes) -> bytes:
        if w.isalpha():
            # ASCII letters only
            low = w.lower()
            found = self._piece(low) if low == w else self[low]
        elif w[-1] in _STOPS and w[:-1].isalpha():
            found = self[w[:-1].lower()] + self[w[-1:]]
        elif b"<|" not in w and _PLAIN.fullmatch(text := w.decode()):
            low = text.lower()
            parts = [low] if low.isalpha() else _PIECES.findall(low)
            if len(parts) > 1:
                found = b"".join([self[x.encode()] for x in parts])
            else:
                found = self._piece(w) if low == text else self[low.encode()]
        else:
            found = array("I", self.tokenizer.encode(w.decode(), add_special_tokens=False).ids).tobytes()
        self[w] = found
        return found

    def _piece(self, piece: bytes) -> bytes:
        signs = piece.decode() if piece.isascii() else "".join(map(self.signs.__getitem__, piece))
        return array("I", [t.id for t in self.tokenize(signs)]).tobytes()


class Encoder:
    """ids of whole texts. Where white space always parts tokens, as the normaliser and splitter known here make it,
    each spelling between ASCII white space is encoded once and kept: one of plain characters is split into the
    vocabulary's pieces here and its pieces go to the library's model; any other, and one that may hold a special
    token's text, goes through the whole library. With any other vocabulary whole texts go to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Spellings(self.tokenizer)
        self.splits = self._known_splitter()

    def _known_splitter(self) -> bool:
        parts = json.loads(self.tokenizer.to_str())
        kinds = [n["type"] for n in parts["normalizer"].get("normalizers", [])] if parts["normalizer"] else []
        spaces = [n["pattern"].get("Regex") for n in (parts["normalizer"] or {}).get("normalizers", []) if n["type"] == "Replace" and n["content"] == " "]
        split = parts["pre_tokenizer"].get("pretokenizers", []) if parts["pre_tokenizer"] else []
        pattern = split[0].get("pattern", {}).get("Regex") if len(split) == 2 else None
        return kinds == ["NFC", "Replace", "Lowercase"] and spaces == [r"\s+"] and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and split[1] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.splits:
            # white space may be a part of tokens: whole texts go to the library
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        get = self.known.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]


def _writer(folder: str, path: str):
    tail = struct.pack("<I", END_ID)

    def write(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        def done(shard, number):
            uri = f"{folder}/{uuid.uuid4().hex}.tok"
            common.put_file(uri, shard.finish())
            n = sum(d[2] for d in shard.docs)
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([number], pa.int64()), pa.array([n], pa.int64()), pa.array([len(shard.docs)], pa.int64())], ["uri", "number", "n_ids", "n_docs"])

        encoder, shard, size, number = Encoder(path), ShardWriter(), 0, 0
        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(at, ROWS_AT_ONCE)
                ids, texts = part.column(0).to_pylist(), common.as_bytes(part.column(1))
                for i, j in common.pieces([len(t) + 1 for t in texts]):
                    for doc, text, data in zip(ids[i:j], texts[i:j], encoder.encode(texts[i:j]), strict=True):
                        if shard.docs and size + len(text) > SHARD_BYTES:
                            # ranges are uneven; a shard and what a task holds of it are bounded all the same
                            yield done(shard, number)
                            shard, size, number = ShardWriter(), 0, number + 1
                        shard.add(doc, data + tail)
                        size += len(text)
        if shard.docs:
            yield done(shard, number)

    return write


def write_token_files(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode whole texts, end each with END_ID, and write shards in ascending id order (null ids first;
    rows that share an id in the order of their text's hash). The manifest, one entry for each shard in order,
    has its uri, the number of ids before it (base) and its size. An empty table has no shards."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    folder = f"{common.work_dir(spark)}/tokens-{uuid.uuid4().hex}"
    n = max(1, -(-size // SHARD_BYTES))
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text")]
    shards = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(common.frugal(_writer(folder, vocabulary)), "uri string, number long, n_ids long, n_docs long")
    # the number of shards is bounded by the input's size over SHARD_BYTES; only names and counts come here
    found = common.store(shards.withColumn("place", F.spark_partition_id()), "token-manifest")
    base, out = 0, []
    for r in sorted(found.collect(), key=lambda r: (r.place, r.number)):
        out.append({"uri": r.uri, "base": base, "n_ids": r.n_ids, "n_docs": r.n_docs})
        base += r.n_ids
    return out


def read_token_files(spark: SparkSession, manifest: list[dict], id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each document in the files: id, start (ids before it), n_tokens, ids_crc32, and its ids if asked for."""
    common.ship(spark)
    shards = spark.createDataFrame([(m["uri"], m["base"]) for m in manifest], "uri string, base long").repartition(max(1, len(manifest)))

    def read(batches):
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc, ids, first in ShardReader(uri):
                    rows.append((doc, base + first, len(ids) // 4, zlib.crc32(ids), ids))
                    if len(rows) >= 2000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    def batch(rows):
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
        if with_ids:
            cols.append(pa.array([np.frombuffer(r[4], "<u4").astype(np.int32) for r in rows], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, names)

    names = [id_col, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return shards.mapInArrow(common.frugal(read), f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op8_token_files(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return read_token_files(spark, write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary))
