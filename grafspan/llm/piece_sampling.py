"""Sampled SentencePiece segmentations: Gumbel top-k without replacement by perturbed A-star search.

A text's lattice has an edge for each vocabulary piece that fits at a place; a character without a piece of
its own has one edge of byte pieces. A piece of rank r weighs 1 / (r + RANK_SHIFT) (the vocabulary is of
merges, whose scores are ranks), a byte piece as the last rank. Backward sums of the weights give the exact
probability of every way on, so the search's bound is exact: the sampled path of a subtree follows these
probabilities, and the largest perturbed log-probability among the paths that leave it at a step is a Gumbel
variable located at their total, truncated at the parent's value. Each pop of the best such subtree emits one
more distinct segmentation; the value of the best one left after k pops is the threshold for the inclusion
scores 1 - exp(-exp(log p - threshold)).

No piece of the vocabulary has a space mark after another character, so the lattice of a text is the chain of
those of its segments (a space mark and what follows up to the next). The distinct segments of a slice of
documents are built together and all its documents sampled together, with numpy. Uniforms come from a hash of the
row key, the sample and the place, so that they don't depend on how rows are batched.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import common

SAMPLES = 2
RANK_SHIFT = 10.0
SLICE_CHARS = 1 << 19
#: Uniforms that are drawn ahead for each sample of a text; a search that needs more draws them one by one.
DRAWS = 8
MARK = "▁"
_G, _H = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


class Vocabulary:
    """Pieces with their weights, and a trie of them whose steps lie in an open-addressed table.

    piece_of: the piece that ends at each state of the trie, or -1; letter_of: the number of each character, 0 for
    those that no piece has."""

    def __init__(self, path: str):
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        size = s.vocab_size()
        self.byte = {}
        self.bytes_of = [b""] * size
        normal = []
        for i in range(size):
            p = s.id_to_piece(i)
            if s.is_byte(i):
                self.byte[int(p[3:-1], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:-1], 16)])
            elif not (s.is_control(i) or s.is_unknown(i) or s.is_unused(i)):
                normal.append((-s.get_score(i), i, p))
                self.bytes_of[i] = p.replace(MARK, " ").encode()
                if MARK in p.lstrip(MARK):
                    raise ValueError(f"piece {p!r} crosses a segment's start")
        total = sum(1 / (r + RANK_SHIFT) for r, _, _ in normal)
        self.weight = {p: (i, 1 / (r + RANK_SHIFT) / total) for r, i, p in normal}
        self.byte_weight = min(w for _, w in self.weight.values())
        self.longest = max(map(len, self.weight))
        self._grow()

    def _grow(self) -> None:
        letters = {c: k for k, c in enumerate(sorted({c for p in self.weight for c in p}), 1)}
        self.letter_of = np.zeros(0x110000, np.int32)
        self.letter_of[[ord(c) for c in letters]] = list(letters.values())
        self.bits = len(letters).bit_length()
        states, steps, ends = {"": 0}, [], {}
        for p, (i, _) in self.weight.items():
            for k in range(1, len(p) + 1):
                if p[:k] not in states:
                    states[p[:k]] = len(states)
                    steps.append((states[p[: k - 1]] << self.bits | letters[p[k - 1]], states[p[:k]]))
            ends[states[p]] = i
        self.piece_of = np.full(len(states), -1, np.int32)
        self.piece_of[list(ends)] = list(ends.values())
        self.weight_of = np.zeros(len(self.bytes_of))
        for i, w in self.weight.values():
            self.weight_of[i] = w
        self.slot_bits = (4 * len(steps)).bit_length()
        self.keys, self.next = np.full(1 << self.slot_bits, -1, np.int64), np.zeros(1 << self.slot_bits, np.int32)
        self.first = np.full(len(letters) + 1, -1, np.int32)
        self.first[[k for k, _ in steps if k >> self.bits == 0]] = [n for k, n in steps if k >> self.bits == 0]
        slots = self._slot(np.array([k for k, _ in steps], np.int64)).tolist()
        for (key, state), at in zip(steps, slots, strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.slot_bits) - 1)
            self.keys[at], self.next[at] = key, state

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The states that follow, -1 where the trie has none."""
        keys = states.astype(np.int64) << self.bits | letters
        at = self._slot(keys)
        there = self.keys[at]
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.slot_bits) - 1)
            there[open_] = self.keys[at[open_]]
            open_ = open_[(there[open_] != keys[open_]) & (there[open_] >= 0)]
        return np.where(there == keys, self.next[at], -1)

    def decode(self, ids) -> bytes:
        """The text of a list of ids; the mark that stands before a text is left out."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:]


class Lattices:
    """The lattices of a slice's distinct segments, as flat edge arrays, all built together.

    Nodes are ordered by their distance from their segment's end and then by segment, longer segments first, so
    that the backward sums of all segments at one distance are one numpy call. The end is node -1; a node's edges
    lie together; cumulative probabilities end at 2. Characters that need several bytes are marked by a negative
    number. Nothing is kept from slice to slice: a slice's texts bound what is held."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def prepare(self, codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Builds the lattices of the segments, given by their characters' places in codes; the first node of each.

        Equal segments are found by a 64-bit hash; were two others to meet, round_trip would tell."""
        v = self.vocabulary
        _, one, which = np.unique(common.span_hashes(codes, begins, begins + sizes), return_index=True, return_inverse=True)
        order = np.argsort(-sizes[one], kind="stable")
        begins, size = begins[one[order]], sizes[one[order]]
        letters = v.letter_of[codes]
        most = int(size[0]) if len(order) else 0
        # how many segments reach each distance, and the first node of each; distance 0 has the ends
        reach = np.append(np.searchsorted(-size, -np.arange(most + 1), "right"), 0)
        base = np.concatenate(([0], np.cumsum(reach)))
        nodes = int(base[most + 1])
        left = np.repeat(np.arange(most + 1), reach[:-1])[reach[0] :]
        rank = np.arange(reach[0], nodes) - base[left]
        place = (begins + size)[rank] - left
        starts = np.empty(len(order), np.int64)
        starts[order] = base[size] + np.arange(len(order)) - reach[0]

        rounds = []
        at = np.arange(len(place))
        state = v.first[letters[place]]
        piece = np.where(state >= 0, v.piece_of[state], -1)
        weight = np.where(piece >= 0, v.weight_of[piece], 0.0)
        for k in np.flatnonzero(piece < 0).tolist():
            c = int(codes[place[k]])
            piece[k] = v.byte[c] if c < 0x80 else -c
            weight[k] = v.byte_weight ** len(chr(c).encode())
        rounds.append((at, piece, weight))
        for n in range(2, v.longest + 1):
            on = np.flatnonzero((state >= 0) & (left[at] >= n))
            at = at[on]
            state = v.step(state[on], letters[place[at] + (n - 1)])
            piece = v.piece_of[state]
            found = np.flatnonzero((state >= 0) & (piece >= 0))
            rounds.append((at[found], piece[found], v.weight_of[piece[found]]))
        count = np.zeros(len(place), np.int64)
        for a, _, _ in rounds:
            count[a] += 1
        begin = np.cumsum(count) - count
        edges = int(count.sum())
        to, piece, weight = np.empty(edges, np.int64), np.empty(edges, np.int32), np.empty(edges)
        fill = begin.copy()
        for n, (a, p, w) in enumerate(rounds, 1):
            e = fill[a]
            to[e], piece[e], weight[e] = base[left[a] - n] + rank[a], p, w
            fill[a] += 1
        del rounds, fill

        beta = np.ones(nodes)
        bound = np.append(begin, edges)[np.minimum(base - reach[0], len(place)).clip(0)]
        for r in range(1, most + 1):
            a, b = int(bound[r]), int(bound[r + 1])
            here = begin[base[r] - reach[0] : base[r + 1] - reach[0]] - a
            x = weight[a:b] * beta[to[a:b]]
            total = np.add.reduceat(x, here)
            beta[base[r] : base[r + 1]] = total
            weight[a:b] = x / np.repeat(total, np.diff(here, append=b - a))
            for k in np.flatnonzero(total < 1e-150).tolist():
                # sums that later steps use are scaled together, lest those of a long segment vanish
                beta[base[max(0, r - v.longest) : r + 1] + k] *= 1e150
        cum = weight.copy()
        for k in range(1, int(count.max(initial=0))):
            e = begin[count > k] + k
            cum[e] += cum[e - 1]
        cum[begin + count - 1] = 2.0
        to -= reach[0]
        self.arrays = (begin, np.maximum(to, -1).astype(np.int32), piece, np.log(np.minimum(weight, 1.0)), cum)
        return starts[which]


def segments_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(characters of all texts, marked, with a mark before each; where each segment begins and its length; the
    number of segments of each text). A segment is a run of marks with what follows; an empty text has none."""
    codes = np.frombuffer("".join([MARK + t for t in texts if t]).encode("utf-32-le"), np.uint32).copy()
    codes[codes == 0x20] = ord(MARK)
    mark = codes == ord(MARK)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    length += length > 0
    first = np.cumsum(length) - length
    opens = mark.copy()
    opens[1:] &= ~mark[:-1]
    opens[first[length > 0]] = True
    begins = np.flatnonzero(opens)
    return codes, begins, np.diff(begins, append=len(codes)), np.diff(np.searchsorted(begins, np.append(first, len(codes))))


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((common.mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _draws(seed: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The uniforms of a text's search."""
    with np.errstate(over="ignore"):
        return _uniform(seed * _G + number * common.ORDER[4])


class Sampler:
    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.lattices = Lattices(self.vocabulary)

    def _walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled edges from each starting node to its segment's end: (edges in order, number of each start)."""
        begin, to, _, _, cum = self.lattices.arrays
        rounds, active, at = [], np.arange(len(node)), node
        count = np.zeros(len(node), np.int64)
        step = 0
        while len(active):
            with np.errstate(over="ignore"):
                u = _uniform(key[active] + np.uint64(step) * _G)
            e = begin[at].astype(np.int64)
            late = np.flatnonzero(u > cum[e])
            while len(late):
                e[late] += 1
                late = late[u[late] > cum[e[late]]]
            rounds.append((active, e))
            count[active] += 1
            at = to[e]
            on = at >= 0
            active, at = active[on], at[on]
            step += 1
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for k, (a, e) in enumerate(rounds):
            out[first[a] + k] = e
        return out, count

    def sample(self, keys: list[int], texts: list[str], k: int = SAMPLES) -> list[list[tuple]]:
        """For each text up to k (ids, log probability, perturbed value, inclusion score), best first."""
        codes, begins, lengths, sizes = segments_of(texts)
        node = self.lattices.prepare(codes, begins, lengths)
        seed = np.array(keys, np.uint64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        first = np.cumsum(sizes) - sizes
        with np.errstate(over="ignore"):
            edges, count = self._walk(node, seed[owner] + (np.arange(len(node)) - first[owner]).astype(np.uint64) * _H)
        ends = np.concatenate(([0], np.cumsum(count)))
        segment = np.repeat(np.arange(len(node)) - first[owner], count)
        draws = _draws(seed[:, None], np.arange(1, DRAWS * k + 1, dtype=np.uint64)).tolist()
        bound = ends[np.append(first, len(node))].tolist()
        searches = []
        for d, (a, n) in enumerate(zip(first.tolist(), sizes.tolist(), strict=True)):
            e = slice(bound[d], bound[d + 1])
            searches.append(_Search(self, seed[d], draws[d], node[a : a + n], edges[e], segment[e]))
        for r in range(1, k):
            asked = [(s, way) for s in searches if (way := s.pop()) is not None]
            if not asked:
                break
            starts = [s.starts(way) for s, way in asked]
            with np.errstate(over="ignore"):
                at = np.concatenate([s.seed + of.astype(np.uint64) * _H + np.uint64(r) * common.ORDER[5] for (s, _), (_, of) in zip(asked, starts, strict=True)])
            tails, count = self._walk(np.concatenate([x for x, _ in starts]), at)
            ends = np.concatenate(([0], np.cumsum(count)))
            a = 0
            for (s, way), (x, of) in zip(asked, starts, strict=True):
                b = a + len(x)
                s.push(way, tails[ends[a] : ends[b]], np.repeat(of, count[a:b]))
                a = b
        return [s.results() for s in searches]

    def _siblings(self, e: int) -> np.ndarray:
        """All edges of the node to which e belongs."""
        begin, to, *_ = self.lattices.arrays
        n = int(np.searchsorted(begin, e, "right")) - 1
        return np.arange(begin[n], begin[n + 1] if n + 1 < len(begin) else len(to))

    def _ids(self, edges: np.ndarray) -> np.ndarray:
        piece = self.lattices.arrays[2][edges]
        if (piece >= 0).all():
            return piece
        out: list[int] = []
        for p in piece.tolist():
            out.extend([p] if p >= 0 else [self.vocabulary.byte[x] for x in chr(-p).encode()])
        return np.array(out, np.int32)


def _log_less(a: float) -> float:
    """log(1 - exp(a)) for a <= 0."""
    return -math.inf if a >= 0 else math.log(-math.expm1(a))


class _Search:
    """Perturbed A-star over one text. The open subtrees are groups of ways that leave an emitted path at one of a
    range of its steps, or at one step by other edges than those taken. The largest perturbed value in a group is a
    Gumbel variable at the log of the group's mass, truncated at the value of the path from which it was cut; where
    in the group it lies follows the masses, which telescope along the path, so that no step has to be visited."""

    def __init__(self, sampler: Sampler, seed: np.uint64, draws: list[float], node: np.ndarray, edges: np.ndarray, segment: np.ndarray):
        self.sampler, self.seed, self.node = sampler, seed, node
        self.draws, self.drawn = draws, 0
        self.paths: list[tuple] = []
        self.groups: list[tuple] = []
        self.value = -math.log(-math.log(self._draw()))
        if len(edges):
            self._add(edges, segment, 0)

    def _draw(self) -> float:
        self.drawn += 1
        return self.draws[self.drawn - 1] if self.drawn <= len(self.draws) else float(_draws(self.seed, np.uint64([self.drawn]))[0])

    def _truncated(self, place: float) -> float:
        """A Gumbel variable located at place, given that it is below the present value."""
        a, b = -self.value, math.log(-math.log(self._draw())) - place
        top = max(a, b)
        return -(top + math.log(math.exp(a - top) + math.exp(b - top)))

    def _add(self, edges: np.ndarray, segment: np.ndarray, t: int) -> None:
        total = np.cumsum(self.sampler.lattices.arrays[3][edges])
        self.paths.append((edges, segment, total, self.value))
        self._range(len(self.paths) - 1, t, len(edges))

    def _before(self, path: int, t: int) -> float:
        return float(self.paths[path][2][t - 1]) if t else 0.0

    def _range(self, path: int, a: int, b: int) -> None:
        """Ways that leave the path at steps a to b - 1."""
        if a < b:
            start = self._before(path, a)
            mass = start + _log_less(float(self.paths[path][2][b - 1]) - start)
            if mass > -math.inf:
                self.groups.append((self._truncated(mass), path, a, b, None))

    def pop(self):
        """The best open way: (path, step, edge, edges that were taken there), or None if there is none."""
        if not self.groups:
            return None
        best = max(range(len(self.groups)), key=lambda g: self.groups[g][0])
        self.value, path, a, b, gone = self.groups.pop(best)
        edges, _, total, _ = self.paths[path]
        if gone is None:
            # smallest t at which the mass that has left reaches the drawn share
            start = self._before(path, a)
            share = math.log1p(self._draw() * math.expm1(float(total[b - 1]) - start))
            t = min(a + int(np.searchsorted(-total[a:b], -(start + share))), b - 1)
            while t > a and self.sampler.lattices.arrays[3][edges[t]] == 0:
                t -= 1
            self._range(path, a, t)
            self._range(path, t + 1, b)
            gone = [int(edges[t])]
        else:
            t = a
        logp = self.sampler.lattices.arrays[3]
        left = [e for e in self.sampler._siblings(int(edges[t])).tolist() if e not in gone]
        p = np.exp(logp[left])
        at = min(int(np.searchsorted(np.cumsum(p), self._draw() * p.sum())), len(left) - 1)
        gone = [*gone, left[at]]
        mass = float(p.sum() - p[at])
        if len(left) > 1 and mass > 0:
            self.groups.append((self._truncated(self._before(path, t) + math.log(mass)), path, t, t + 1, gone))
        return path, t, left[at]

    def starts(self, way) -> tuple[np.ndarray, np.ndarray]:
        """Where sampling goes on after the way's edge: nodes and the numbers of their segments."""
        path, t, e = way
        s, to = int(self.paths[path][1][t]), int(self.sampler.lattices.arrays[1][e])
        if to < 0:
            return self.node[s + 1 :], np.arange(s + 1, len(self.node))
        return np.concatenate(([to], self.node[s + 1 :])), np.arange(s, len(self.node))

    def push(self, way, tail: np.ndarray, segment: np.ndarray) -> None:
        path, t, e = way
        edges, of, _, _ = self.paths[path]
        self._add(np.concatenate((edges[:t], [e], tail)), np.concatenate((of[: t + 1], segment)), t + 1)

    def results(self) -> list[tuple]:
        if not self.paths:
            return [(np.empty(0, np.int32), 0.0, self.value, 1.0)]
        threshold = max((g[0] for g in self.groups), default=-math.inf)
        out = []
        for edges, _, total, value in self.paths:
            lp = float(total[-1])
            inclusion = 1.0 if threshold == -math.inf else -math.expm1(-math.exp(min(700.0, lp - threshold)))
            out.append((self.sampler._ids(edges), lp, value, inclusion))
        return out


def sample_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, with_ids: bool = True) -> DataFrame:
    """Up to k rows for each document: id, sample (1 is best), n_tokens, ids_crc32, log_prob, perturbed, inclusion,
    round_trip (whether decoding gives the text back), and ids if asked for.

    A text with fewer than k segmentations gives all it has, with inclusion 1; an empty or null one gives a row
    without ids. The row key is the id and the text, so rows that repeat both get the same samples. U+2581 in a
    text is the vocabulary's own mark and decodes to a space (round_trip is false); U+0000 is encoded as a byte.
    A text without spaces is one segment of any length. Other columns are not read.
    """
    common.ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        sampler = Sampler(vocabulary)
        decode = sampler.vocabulary.decode
        for b in batches:
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            names = ids.to_pylist()
            for i, j in common.pieces([len(t) + 1 for t in texts], SLICE_CHARS):
                keys = [xxhash.xxh3_64_intdigest(f"{names[r]}\0{texts[r]}".encode()) for r in range(i, j)]
                rows: list[list] = [[] for _ in range(9)]
                for r, found in enumerate(sampler.sample(keys, texts[i:j], k), i):
                    want = texts[r].encode()
                    for n, (pieces, lp, g, inclusion) in enumerate(found, 1):
                        p = np.asarray(pieces, np.int32)
                        for col, x in zip(rows, (r, n, len(p), zlib.crc32(p.astype("<u4").tobytes()), lp, g, inclusion, decode(p.tolist()) == want, p), strict=True):
                            col.append(x)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
                cols = [pa.array(c, t) for c, t in zip(rows, kinds, strict=False)]
                cols[0] = ids.take(cols[0])
                if with_ids:
                    ends = np.concatenate(([0], np.cumsum([len(p) for p in rows[8]]))).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows[8]) if rows[8] else np.empty(0, np.int32), pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, out)

    out = [id_col, "sample", "n_tokens", "ids_crc32", "log_prob", "perturbed", "inclusion", "round_trip"] + ["ids"] * with_ids
    return common.with_text_only(docs, id_col, text_col).mapInArrow(common.frugal(run), f"`{id_col}` {kind}, sample int, n_tokens long, ids_crc32 long, log_prob double, perturbed double, inclusion double, round_trip boolean" + ", ids array<int>" * with_ids)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_piece_sampling(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sample_pieces(docs, vocabulary or default_vocabulary(), with_ids=False)
