"""URL filter over a memory-mapped sorted digest array.

Patterns are strings ``host/path``: a pattern fits its host and all subdomains if the url's path
starts with the pattern's path. Their 64-bit xxhash keys are stored sorted, in key-range shards in
the shared folder. A batch of urls builds its candidate strings (host suffixes x path prefixes of
the lengths that occur among the patterns), probes each shard with a vectorised binary search, and
confirms every hit against the stored full string, so that a collision can't give a wrong answer.
A list of any size works: a task opens a shard when a batch first needs it, which is settled by the keys' ranges, and
keeps it memory-mapped; where the shared folder isn't mounted, shards of HELD_BYTES in all are kept.

The query's own blocklist is a table, like any other: one parameter takes the DataFrame (kind, pattern).
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rules of the query, (kind, pattern).
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: Hosts of advertising, gambling, adult and spam sites that are blocked by default.
BLOCKED_HOSTS = [
    "ads-track.example.com",
    "adult-x.example.net",
    "casino-win.example.com",
    "cheap-pills.example.com",
    "free-bets.example.com",
    "spam-farm.example.com",
]
#: Patterns in one shard; a shard is about 60 bytes a pattern.
SHARD_ROWS = 2_000_000
HELD_BYTES = 512 << 20
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty if the url is null or has no ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((p for c in "?#" if (p := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


def _shard_bytes(rows: list[tuple[int, str, str]]) -> bytes:
    """rows: (key, pattern, kind), sorted. Layout: a JSON header line, keys, string ends, the strings."""
    blob = [f"{kind}\t{pattern}".encode() for _, pattern, kind in rows]
    head = json.dumps({"n": len(rows)}).encode() + b"\n"
    head = head[:-1].ljust((len(head) + 7) // 8 * 8 - 1) + b"\n"
    keys = np.array([k for k, _, _ in rows], np.uint64)
    ends = np.cumsum([len(b) for b in blob], dtype=np.uint64) if rows else np.empty(0, np.uint64)
    return head + keys.tobytes() + ends.tobytes() + b"".join(blob)


class Shard:
    def __init__(self, uri: str):
        self.file = common.open_file(uri)
        buffer = self.file.read_buffer()
        at = buffer[:256].to_pybytes().index(b"\n") + 1
        n = json.loads(buffer[:at].to_pybytes())["n"]
        self.keys = np.frombuffer(buffer, np.uint64, n, at)
        self.ends = np.frombuffer(buffer, np.uint64, n, at + 8 * n)
        self.blob, self.at = buffer, at + 16 * n

    def probe(self, digests: np.ndarray, strings: list[str]) -> dict[str, str]:
        """kind of each string that is stored. Equal keys are all compared with the full string."""
        found: dict[str, str] = {}
        left, right = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        for i in np.flatnonzero(right > left):
            for k in range(left[i], right[i]):
                a = int(self.ends[k - 1]) if k else 0
                kind, _, pattern = self.blob[self.at + a : self.at + int(self.ends[k])].to_pybytes().decode().partition("\t")
                if pattern == strings[i]:
                    found[pattern] = kind
        return found


class Shards:
    """All shards of a manifest, opened when they are first needed."""

    def __init__(self, manifest: list[dict]):
        self.manifest = sorted(manifest, key=lambda m: m["low"])
        self.low = np.array([m["low"] for m in self.manifest], np.uint64)
        self.keep = all(m["uri"].startswith("file:") for m in manifest) or sum(m["bytes"] for m in manifest) <= HELD_BYTES
        self.open: dict[int, Shard] = {}

    def probe(self, digests: np.ndarray, strings: list[str]) -> dict[str, str]:
        found: dict[str, str] = {}
        if not len(self.low):
            return found
        which = np.searchsorted(self.low, digests, "right") - 1
        for k in np.unique(which[which >= 0]).tolist():
            mine = np.flatnonzero(which == k)
            shard = self.open.get(k) or Shard(self.manifest[k]["uri"])
            if self.keep:
                self.open[k] = shard
            found |= shard.probe(digests[mine], [strings[i] for i in mine])
        return found


def build_digest_array(patterns: DataFrame) -> list[dict]:
    """Store patterns(kind, pattern) as sorted shards; the manifest has one entry for each shard.

    Null patterns are left out. Of a pattern with several kinds the first in string order stays.
    """
    spark = patterns.sparkSession
    common.ship(spark)
    folder = f"{common.work_dir(spark)}/urls-{uuid.uuid4().hex}"
    clean = patterns.where(F.col("pattern").isNotNull()).groupBy("pattern").agg(F.min("kind").alias("kind"))

    def digest(batches):
        for b in batches:
            p = b.column("pattern").to_pylist()
            keys = np.array([xxhash.xxh64_intdigest(x) for x in p], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column("pattern"), b.column("kind")], ["key", "pattern", "kind"])

    def write(batches):
        rows = []
        for b in batches:
            rows += zip(b.column("key").to_numpy().view(np.uint64).tolist(), b.column("pattern").to_pylist(), b.column("kind").to_pylist())
        if rows:
            rows.sort()
            uri, data = f"{folder}/{uuid.uuid4().hex}.keys", _shard_bytes(rows)
            common.put_file(uri, data)
            sizes = sorted({len(p) - p.find("/") if "/" in p else 0 for _, p, _ in rows})
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([json.dumps(sizes)]), pa.array([str(rows[0][0])]), pa.array([len(data)], pa.int64())], ["uri", "sizes", "low", "bytes"])

    keyed = clean.select("pattern", "kind").mapInArrow(common.frugal(digest), "key long, pattern string, kind string")
    shards = max(1, -(-clean.count() // SHARD_ROWS))
    # ranges of the key's own order, that of unsigned numbers; equal keys stay in one shard
    placed = keyed.repartitionByRange(shards, F.col("key").bitwiseXOR(F.lit(-(1 << 63)))) if shards > 1 else keyed.coalesce(1)
    return [{"uri": r.uri, "sizes": json.loads(r.sizes), "low": int(r.low), "bytes": r.bytes} for r in placed.mapInArrow(common.frugal(write), "uri string, sizes string, low string, bytes long").collect()]


def _candidates(host: str, path: str, sizes: list[int]) -> list[str]:
    parts = host.split(".")
    hosts = [".".join(parts[i:]) for i in range(len(parts))]
    return [h + path[:n] for h in hosts for n in sizes if n <= len(path)]


def judge_urls(pages: DataFrame, rules: list[dict], blocked: list[dict], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each page: id, host, path, rule, verdict.

    rules and blocked are manifests of build_digest_array. The longest fitting rule gives the verdict
    (of equally long ones that with the longer host); without a rule the url is blocked if a pattern
    of ``blocked`` fits, else allowed. A null or malformed url has an empty host and path, fits nothing
    and is allowed. Repeated rows are judged each; other columns of pages are not read.
    """
    common.ship(pages.sparkSession)
    sizes = sorted({n for m in rules + blocked for n in m["sizes"]})

    def judge(batches):
        stored = (Shards(rules), Shards(blocked))
        for b in batches:
            split = [split_url(u) for u in b.column(1).to_pylist()]
            options = [_candidates(h, p, sizes) for h, p in split]
            strings = list(dict.fromkeys(s for o in options for s in o))
            digests = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)
            fits: tuple[dict, dict] = ({}, {})
            for found, shards in zip(fits, stored, strict=True):
                found |= shards.probe(digests, strings)
            rule, verdict = [], []
            for o in options:
                best = max((s for s in o if s in fits[0]), key=lambda s: (len(s), s.find("/")), default=None)
                rule.append(best)
                verdict.append(fits[0][best] if best is not None else "block" if any(s in fits[1] for s in o) else "allow")
            cols = [b.column(0), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names)

    names = [id_col, "host", "path", "rule", "verdict"]
    kind = pages.schema[id_col].dataType.simpleString()
    return common.with_text_only(pages, id_col, url_col).mapInArrow(common.frugal(judge), f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def op1_url_filter(spark: SparkSession, sf_dir: str, blocklist: DataFrame | None = None) -> DataFrame:
    """blocklist: a table (kind, pattern) of any size; without one, the hosts above."""
    rules = build_digest_array(spark.createDataFrame(RULES, "kind string, pattern string"))
    if blocklist is None:
        blocklist = spark.createDataFrame([("block", h + "/") for h in BLOCKED_HOSTS], "kind string, pattern string")
    blocked = build_digest_array(blocklist)
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules, blocked)


def op1_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fit = "(host = {h} OR ends_with(host, '.' || {h})) AND starts_with(path, {p})"

    def lit(x: str) -> str:
        return "'" + x + "'"

    rules = ", ".join(f"({lit(k)}, {lit(p)}, {lit(p[: p.find('/')])}, {lit(p[p.find('/') :])})" for k, p in RULES)
    blocked = " OR ".join("(" + fit.format(h=lit(h), p="'/'") + ")" for h in BLOCKED_HOSTS)
    return f"""
WITH u AS (SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{upper}', '{lower}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         row_number() OVER () AS n FROM pages),
     r(kind, rule, h, p) AS (VALUES {rules}),
     best AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(kind, length(rule)) AS kind
              FROM u JOIN r ON {fit.format(h="h", p="p")} GROUP BY n)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN kind WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN best USING (n)"""
