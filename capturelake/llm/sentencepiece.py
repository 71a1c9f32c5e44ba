"""SentencePiece encoding and decoding with sampled segmentations.

A text's lattice has a node between any two characters and an edge for every
piece; a segmentation is a path, and its probability is proportional to the
exponential of THETA times its pieces' scores.  The k paths with the greatest
log probability plus Gumbel noise are a sample of k distinct segmentations
without replacement.  They are found by a perturbed A* search: a frontier holds
sets of paths, each with the greatest perturbed value in it, drawn from a
Gumbel distribution that is truncated at the set it was cut from.  The best
set is taken from the frontier, a path is drawn from it, and what is left of it
is cut into smaller sets.

Most of the work, drawing the rest of a path, is done for all texts of a run
at once.  No piece crosses certain pairs of characters; the lattice is cut
there, and equal parts of it are built once and kept for the next texts.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from capturelake.llm.common import Bloom, bounded, map_batches, mix, pieces, release, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segmentations of a text, and the factor of the scores.
K, THETA = 4, 2e-4
#: Bytes of text whose lattice is built at once.
RUN_BYTES = 512 << 10
#: Nodes of lattices that a worker keeps for the next texts.
NODES = 1_500_000
LOW, HALF = np.uint64((1 << 31) - 1), np.float32(1 / (1 << 31))
#: The least log weight of a piece: one that the model all but forbids is rare.
LEAST = -12.0
#: From so many characters before its part's end on, a node's sum over paths is
#: kept as a logarithm (before, its product with LEAST is far from underflow).
FAR = 48
SPACE = "▁"


class Vocabulary:
    """A model file's pieces as arrays: a trie, and which pairs pieces cross."""

    def __init__(self, model: bytes) -> None:
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i) for i in plain}
        self.score = np.maximum(np.array([sp.get_score(i) for i in range(n)]) * THETA, LEAST)
        self.byte = np.full(256, sp.unk_id(), np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[3:5], 16)] = i
        self.bytes = [b"" if sp.is_control(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else text[i].replace(SPACE, " ").encode() for i in range(n)]
        self.length = np.fromiter(map(len, self.bytes), np.int64, n)
        self.place = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        letters = sorted({c for t in text.values() for c in t})
        self.size = len(letters) + 1
        self.code = np.zeros(0x110000, np.uint16)
        for k, c in enumerate(letters):
            self.code[ord(c)] = k + 1
        self.crossed = np.zeros((self.size, self.size), bool)
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i, t in text.items():
            codes = [int(self.code[ord(c)]) for c in t]
            for a, b in zip(codes, codes[1:], strict=False):
                self.crossed[a, b] = True
            at = 0
            for c in codes:
                at = nodes.setdefault((at, c), len(nodes) + 1)
            ends.setdefault(at, i)
        keys = np.array([a * self.size + c for a, c in nodes], np.int64)
        after = np.array(list(nodes.values()), np.int64)
        # a table of slots by hash; what finds its slot taken is in a sorted rest
        slot = self._slot(keys)
        _, first = np.unique(slot, return_index=True)
        self.keys, self.next = np.full(1 << self.slots, -1, np.int64), np.full(1 << self.slots, -1, np.int64)
        self.keys[slot[first]], self.next[slot[first]] = keys[first], after[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.rest, self.rest_next = keys[rest], after[rest]
        self.shared = np.zeros(1 << self.slots, bool)
        self.shared[slot[rest]] = True
        self.end = np.full(len(nodes) + 1, -1, np.int64)
        for node, i in ends.items():
            self.end[node] = i
        self.weight = np.exp(self.score)
        self.root = self.step(np.zeros(self.size, np.int64), np.arange(self.size))

    #: Bits of a slot's number.
    slots = 20

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slots)).astype(np.int64)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The trie's next nodes, -1 where there are none."""
        key = node * self.size + code
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.next[slot], -1)
        if len(self.rest):
            open_ = np.flatnonzero(self.shared[slot] & (out < 0))
            at = np.minimum(np.searchsorted(self.rest, key[open_]), len(self.rest) - 1)
            out[open_] = np.where(self.rest[at] == key[open_], self.rest_next[at], -1)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the pieces; undoes the space put before a text."""
        data = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return data[1:] if data.startswith(" ") and self.prefixed else data

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of many pieces, and where each piece's end."""
        size = self.length[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.place[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends

    @property
    def prefixed(self) -> bool:
        return self.sp.normalize("a").startswith(SPACE)


class Lattice:
    """The lattices of distinct parts, end to end.

    Node p is before character p of the parts' characters; a part's last node
    has no edges.  Edges are sorted by their first node: ``start[p]`` is the
    first of p; ``to`` their last nodes, -1 where a part ends; ``piece`` their
    pieces, or -1 for a character of several bytes of its own, which is then in
    ``chars``; ``chance`` the probability of each among the paths from its first
    node on, ``sum`` the sum of the probabilities up to each.
    """

    def __init__(self, v: Vocabulary, chars: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> None:
        n = len(codes)
        stop = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
        # edges by length: where they begin, and their pieces
        by: list[tuple[np.ndarray, np.ndarray]] = []
        at, node, length = np.arange(n), v.root[codes], 1
        count = np.zeros(n + 1, np.int64)
        while True:
            alive = np.flatnonzero(node >= 0)
            at, node = at[alive], node[alive]
            if length == 1:
                # a character that is no piece is written as its bytes, an edge of their scores
                own = np.where(chars < 0x80, v.byte[chars & 0x7F], -1)
                own[at] = np.where(v.end[node] >= 0, v.end[node], own[at])
                single = np.zeros(n, bool)
                single[at] = v.end[node] >= 0
                by.append((np.arange(n), own))
                count[:n] = 1
            else:
                hit = np.flatnonzero(v.end[node] >= 0)
                by.append((at[hit], v.end[node[hit]]))
                count[at[hit]] += 1
            inside = np.flatnonzero(at + length < stop[at])
            at, node = at[inside], node[inside]
            if not len(at):
                break
            node = v.step(node, codes[at + length].astype(np.int64))
            length += 1
        self.chars = chars
        self.start = np.cumsum(count) - count
        fill, size = self.start[:-1].copy(), int(self.start[-1])
        self.to, self.piece = (np.empty(size, np.int32) for _ in range(2))
        weight = np.empty(size)
        for length, (at, found) in enumerate(by, 1):
            place = fill[at]
            fill[at] += 1
            self.to[place], self.piece[place] = at + length, found
            weight[place] = v.weight[found]
        alone = np.flatnonzero(~single)
        wide = np.where(chars[alone] < 0x80, 1, np.where(chars[alone] < 0x800, 2, np.where(chars[alone] < 0x10000, 3, 4)))
        weight[self.start[alone]] = np.exp(v.score[v.byte[0]] * wide)
        del by, fill
        is_end = np.zeros(n + 1, bool)
        is_end[ends] = True
        # a node that ends a part begins the next: no path goes on there
        self.to[is_end[self.to]] = -1
        # the sum over all paths from each node to its part's end, from the back; of
        # nodes far from the end its logarithm
        back = np.ones(n + 2)
        self.chance = chance = np.empty(size)
        left = (stop - np.arange(n)) if n else np.zeros(0, np.int64)
        nodes = np.argsort(left, kind="stable")
        bounds = np.searchsorted(left[nodes], np.arange(1, (left.max() if n else 0) + 2))
        for level, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), 1):
            own = nodes[a:b]
            several = count[own]
            first = np.cumsum(several) - several
            edges = np.arange(int(several.sum())) + np.repeat(self.start[own] - first, several)
            if level == FAR:
                back = np.log(back)
            if level < FAR:
                value = weight[edges] * back[self.to[edges]]
                total = np.add.reduceat(value, first)
                back[own] = total
                chance[edges] = value / np.repeat(total, several)
            else:
                value = np.log(weight[edges]) + back[self.to[edges]]
                most = np.maximum.reduceat(value, first)
                value = np.exp(value - np.repeat(most, several))
                total = np.add.reduceat(value, first)
                back[own] = most + np.log(total)
                chance[edges] = value / np.repeat(total, several)
        total = np.cumsum(chance)
        before = np.concatenate([[0.0], total])[self.start[:-1]]
        self.sum = (total - np.repeat(before, count[:-1])).astype(np.float32)
        # the last edge of a node is also that for what rounding leaves
        self.sum[self.start[1:] - 1] = 2.0


class Lattices:
    """The lattices of all parts that a worker has met, one after another, so
    that a part that occurs in many texts is built once; emptied when there are
    more than NODES nodes.  ``first`` has each part's first node by its hash."""

    kinds = {"start": np.int64, "chars": np.uint32, "to": np.int32, "piece": np.int32, "chance": np.float64, "sum": np.float32}

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.nodes = self.edges = 0
        self.hashes, self.firsts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for name, kind in self.kinds.items():
            setattr(self, name, np.zeros(1, kind))

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if at + len(values) > len(held):
            more = np.empty(max(at + len(values), 3 * len(held) // 2), held.dtype)
            more[:at] = held[:at]
            setattr(self, name, more)
        getattr(self, name)[at : at + len(values)] = values

    def first(self, hashes: np.ndarray, begin: np.ndarray, sizes: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """The first nodes of parts, given by distinct hashes in order and by
        where they are in ``joined``; unknown ones are built."""
        if self.nodes > NODES:
            self.clear()
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        out = np.empty(len(hashes), np.int64)
        out[known] = self.firsts[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            begin, sizes = begin[new], sizes[new]
            ends = np.cumsum(sizes)
            chars = joined[np.arange(int(ends[-1])) - np.repeat(ends - sizes - begin, sizes)]
            made = Lattice(self.v, chars, self.v.code[chars], ends)
            out[new] = self.nodes + ends - sizes
            self._put("chars", self.nodes, chars)
            self._put("start", self.nodes, made.start + self.edges)
            self._put("to", self.edges, np.where(made.to >= 0, made.to + self.nodes, -1))
            for name in ("piece", "chance", "sum"):
                self._put(name, self.edges, getattr(made, name))
            self.nodes, self.edges = self.nodes + len(chars), self.edges + len(made.to)
            self.hashes, self.firsts = np.insert(self.hashes, at[new], hashes[new]), np.insert(self.firsts, at[new], out[new])
        return out

    def edges_of(self, edge: int) -> tuple[int, int]:
        """The edges that begin where ``edge`` does."""
        node = self.node(edge)
        return int(self.start[node]), int(self.start[node + 1])

    def node(self, edge: int | np.ndarray) -> int | np.ndarray:
        """The node where an edge begins."""
        return np.searchsorted(self.start[: self.nodes + 1], edge, side="right") - 1

    def walk(self, node: np.ndarray, seed: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a path from each node to its part's end: where each one's edges
        begin, and the edges.  The draws depend on ``seed`` and ``number`` alone."""
        which, edges, turn = [], [], 0
        own = np.argsort(node.astype(np.int32))  # near nodes together, for the caches
        at, h = node[own], mix(number[own], seed[own])
        steps = np.zeros(len(node), np.int64)
        while len(own):
            # the two halves of a hash are two numbers
            if turn % 2 == 0:
                h = mix(h, turn)
                u = (h >> np.uint64(33)).astype(np.int32).astype(np.float32) * HALF
            else:
                u = (h & LOW).astype(np.int32).astype(np.float32) * HALF
            e = self.start[at]
            open_ = np.flatnonzero(self.sum[e] <= u)
            while len(open_):
                e[open_] += 1
                open_ = open_[self.sum[e[open_]] <= u[open_]]
            which.append(own)
            edges.append(e)
            at = self.to[e]
            go = np.flatnonzero(at >= 0)
            steps[own[at < 0]] = turn + 1
            own, at, h, turn = own[go], at[go], h[go], turn + 1
        first = np.concatenate([[0], np.cumsum(steps)])
        out = np.empty(int(first[-1]), np.int64)
        for turn, (own, e) in enumerate(zip(which, edges, strict=True)):
            out[first[own] + turn] = e
        return first, out


def gumbel(mass: float, below: float, u: float) -> float:
    """The greatest perturbed value of a set with log mass ``mass`` that is
    known to be below ``below``."""
    noise = -math.log(u)
    gap = mass - below
    return mass - (gap + math.log1p(noise * math.exp(-gap)) if gap > 0 else math.log(math.exp(gap) + noise))


def _log_less_one(x: float) -> float:
    """log(1 - exp(x)) for x <= 0."""
    if x >= 0:
        return -math.inf
    return math.log(-math.expm1(x)) if x > -0.693 else math.log1p(-math.exp(x))


class _Path:
    """A path: its edges, their logs and the sums of these."""

    def __init__(self, edges: np.ndarray, log: np.ndarray) -> None:
        self.edges, self.log = edges, log
        self.sums = np.empty(len(log) + 1)
        self.sums[0] = 0.0
        np.cumsum(log, out=self.sums[1:])


class _Text:
    """The search over one text's lattice.  Sets on the frontier: the paths that
    share a path's edges before ``low`` and first leave it at one of its edges
    from ``low`` up to ``high``; of one place, not by the edges in ``cut``."""

    def __init__(self, lattice: Lattices, seed: int) -> None:
        self.lattice, self.seed, self.drawn = lattice, seed, 0
        self.frontier: list[tuple] = []
        self.found: list[tuple[_Path, float]] = []

    def draw(self) -> float:
        self.drawn += 1
        return ((xxhash.xxh3_64_intdigest(self.drawn.to_bytes(8, "little"), self.seed) >> 11) + 0.5) / 9007199254740992.0

    def push(self, path: _Path, low: int, high: int, cut: tuple[int, ...], below: float) -> None:
        if low > high:
            return
        if cut:
            node = self.lattice.edges_of(path.edges[low])
            left = [float(self.lattice.chance[e]) for e in range(*node) if e not in cut]
            mass = path.sums[low] + (math.log(sum(left)) if sum(left) > 0 else -math.inf)
        else:
            mass = path.sums[low] + _log_less_one(float(path.sums[high + 1] - path.sums[low]))
        if mass > -math.inf:
            heapq.heappush(self.frontier, (-gumbel(mass, below, self.draw()), self.drawn, path, low, high, cut))

    def leave(self, path: _Path, low: int, high: int, cut: tuple[int, ...]) -> tuple[int, int] | None:
        """Draw the place where a path of the set leaves, and by which edge."""
        if cut:
            place = low
        else:
            total = -math.expm1(float(path.sums[high + 1] - path.sums[low]))
            limit = path.sums[low] + math.log1p(-min(self.draw() * total, 1 - 1e-16))
            place = min(high, low + int(np.searchsorted(-path.sums[low + 1 : high + 2], -limit, side="left")))
            cut = (int(path.edges[place]),)
        node = self.lattice.edges_of(path.edges[place])
        others = [e for e in range(*node) if e not in cut]
        weights = np.cumsum(self.lattice.chance[others]) if others else np.zeros(0)
        if not len(weights) or weights[-1] <= 0:
            return None
        return place, others[min(len(others) - 1, int(np.searchsorted(weights, self.draw() * weights[-1], side="right")))]


class Encoder:
    def __init__(self, model: bytes, k: int = K) -> None:
        self.v, self.k = Vocabulary(model), k
        self.lattices = Lattices(self.v)

    def lattice(self, texts: list[str]) -> tuple[Lattices, np.ndarray, np.ndarray]:
        """The lattices, each part's first node in order of the texts, and where
        each text's parts end."""
        joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.v.code[joined]
        edge = np.ones(len(joined), bool)
        edge[1:] = ~self.v.crossed[codes[:-1], codes[1:]]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        edge[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        at = np.flatnonzero(edge)
        sizes = np.diff(np.concatenate([at, [len(joined)]]))
        # equal parts by a 64-bit hash of their characters and places
        with np.errstate(over="ignore"):
            place = np.arange(len(joined), dtype=np.uint64) - np.repeat(at, sizes).astype(np.uint64)
            h = (joined + (place << np.uint64(32)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        alone, which, part = np.unique(np.add.reduceat(h, at), return_index=True, return_inverse=True)
        first = self.lattices.first(alone, at[which], sizes[which], joined)
        return self.lattices, first[part], np.searchsorted(at, np.cumsum(lengths))

    def sample(self, texts: list[str], seeds: list[int], normal: list[str] | None = None) -> Iterator[list[tuple[np.ndarray, float, float, float]]]:
        """For each text its k segmentations (fewer, if it has fewer): (pieces,
        log probability, perturbed value, log inclusion probability)."""
        normal = [self.v.sp.normalize(t) for t in texts] if normal is None else normal
        if not any(normal):
            yield from ([(np.zeros(0, np.int64), 0.0, 0.0, 0.0)] for _ in texts)
            return
        lattice, first, ends = self.lattice(normal)
        starts = np.concatenate([[0], ends[:-1]])
        parts = ends - starts
        seed = np.array(seeds, np.uint64)
        number = np.arange(len(first)) - np.repeat(starts, parts)
        own, edges = lattice.walk(first, np.repeat(seed, parts), number.astype(np.uint64))
        cuts = own[np.concatenate([[0], ends])]
        searches, logs = [], np.log(lattice.chance[edges])
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            t = _Text(lattice, int(seed[i]))
            path = _Path(edges[a:b], logs[a:b])
            value = gumbel(0.0, math.inf, t.draw())
            t.found.append((path, value))
            t.push(path, 0, len(path.edges) - 1, (), value)
            searches.append(t)
        for turn in range(1, self.k):
            nodes, numbers, going = [], [], []
            for i, t in enumerate(searches):
                left = None
                while t.frontier and left is None:
                    value, _, path, low, high, cut = heapq.heappop(t.frontier)
                    left = t.leave(path, low, high, cut)
                if left is None:
                    continue
                place, edge = left
                # the rest: of this part, if the edge does not end it, and the parts after it
                part = int(np.count_nonzero(lattice.to[path.edges[:place]] < 0))
                inside = lattice.to[edge] >= 0
                rest = first[starts[i] + part + 1 : ends[i]]
                if inside:
                    nodes.append(lattice.to[edge : edge + 1])
                nodes.append(rest)
                numbers.append(np.arange(part if inside else part + 1, parts[i]))
                going.append((i, -value, path, low, high, cut, place, edge, len(numbers[-1])))
            if not going:
                break
            times = [g[-1] for g in going]
            whose = np.repeat(seed[[g[0] for g in going]], times)
            own, edges = lattice.walk(np.concatenate(nodes).astype(np.int64), whose, np.concatenate(numbers).astype(np.uint64) + np.uint64(turn << 40))
            logs, cuts = np.log(lattice.chance[edges]), own[np.concatenate([[0], np.cumsum(times)])]
            for (i, value, path, low, high, cut, place, edge, _), a, b in zip(going, cuts[:-1], cuts[1:], strict=True):
                new = _Path(np.concatenate([path.edges[:place], [edge], edges[a:b]]), np.concatenate([path.log[:place], [math.log(lattice.chance[edge])], logs[a:b]]))
                t = searches[i]
                t.found.append((new, value))
                if not cut:
                    t.push(path, low, place - 1, (), value)
                    t.push(path, place + 1, high, (), value)
                t.push(path, place, place, (*(cut or (int(path.edges[place]),)), int(edge)), value)
                t.push(new, place + 1, len(new.edges) - 1, (), value)
        for t in searches:
            # a path is in the sample if its value exceeds the next one's
            bar = -t.frontier[0][0] if t.frontier else -math.inf
            out = []
            for path, value in t.found:
                log = float(path.sums[-1])
                out.append((self.ids(lattice, path.edges), log, value, min(0.0, _log_chance(log - bar))))
            yield out

    def ids(self, lattice: Lattices, edges: np.ndarray) -> np.ndarray:
        found = lattice.piece[edges]
        own = np.flatnonzero(found < 0)
        if not len(own):
            return found
        chars = [chr(c).encode("utf-8", "surrogatepass") for c in lattice.chars[lattice.node(edges[own])]]
        return np.concatenate([x for piece in zip(np.split(found, own), [[], *([self.v.byte[b] for b in c] for c in chars)], strict=True) for x in (piece[1], piece[0][1:] if len(piece[1]) else piece[0])]).astype(np.int64)


def _log_chance(x: float) -> float:
    """log(1 - exp(-exp(x)))."""
    if x == math.inf or x > 4:
        return 0.0
    return x if x < -30 else math.log(-math.expm1(-math.exp(x)))


def _digest(ids: np.ndarray) -> str:
    return xxhash.xxh64_hexdigest(np.ascontiguousarray(ids, np.int32).data)


_ROWS = "doc_id long, copy int, sample int, ids array<int>, n_tokens long, log_prob double, perturbed double, log_inclusion double, ids_digest string, round_trip boolean"


def _encoded(e: Encoder, ids: list[int | None], copies: list[int], raw: list[bytes], seed: int) -> pa.RecordBatch:
    """The rows of some texts.  Copy 0 is seeded by its id (null: by its text),
    another copy by its number as well."""
    texts = [t.decode("utf-8", "replace") for t in raw]
    normal = [e.v.sp.normalize(t) for t in texts]
    keys = [f"{i}".encode() if i is not None else t for i, t in zip(ids, raw, strict=True)]
    seeds = [xxhash.xxh3_64_intdigest(k + b":%d" % c if c else k, seed) for k, c in zip(keys, copies, strict=True)]
    found = list(e.sample(texts, seeds, normal))
    times = [len(f) for f in found]
    rows = [r for f in found for r in f]
    n = np.array([len(r[0]) for r in rows])
    flat = np.concatenate([r[0] for r in rows]).astype(np.int32)
    # every row's ids are decoded and held against the normalised text
    whole = [t.replace(SPACE, " ").encode("utf-8", "surrogatepass") for t in normal]
    right, at, first = [], 0, 0
    for w, k in zip(whole, times, strict=True):
        some = n[at : at + k]
        spelled, ends = e.v.spelled(flat[first : first + int(some.sum())])
        cuts = np.concatenate([[0], np.append(0, ends)[np.cumsum(some)]])
        right += [spelled[a:b].tobytes() == w for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        at, first = at + k, first + int(some.sum())
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    number = np.concatenate([np.arange(k) for k in times]).astype(np.int32)
    spread = lambda x, kind: pa.array(x, kind).take(pa.array(np.repeat(np.arange(len(x)), times)))
    columns = [spread(ids, pa.int64()), spread(copies, pa.int32()), pa.array(number), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(n)]
    columns += [pa.array([r[k] for r in rows], pa.float64()) for k in (1, 2, 3)]
    columns += [pa.array([_digest(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]), pa.array(right, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _ROWS.split(", ")])


def encode(docs: DataFrame, model: str = MODEL, k: int = K, doc_id: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """(doc_id, copy, sample, ids, n_tokens, log_prob, perturbed,
    log_inclusion, ids_digest, round_trip): k distinct segmentations of every
    whole text.

    The choice is seeded by the row's id (a null id: by its text), so that
    reruns agree.  Rows that repeat both id and text are numbered as copies,
    and each copy has a seed of its own; to that end the rows of repeated ids,
    and only they, meet by id and text.  ``log_inclusion`` is the log of the
    chance of being in the sample given the best value outside it.  Null is an
    empty text, which has one segmentation without pieces; a text with fewer
    than k segmentations gives all.  ``round_trip`` says that decoding the ids
    gives the text as the model normalises it.  Other columns are not read; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(open(model, "rb").read())  # noqa: SIM115
    open_: list[Encoder] = []

    def run(batches: Iterator[pa.RecordBatch], numbered: bool, without: Bloom | None = None) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            if without is not None:
                batch = batch.filter(pa.array(~without.hits(batch.column(0))))
            if not open_:
                open_.append(Encoder(shared.value, k))
            for first, raw in pieces(batch.column(1), RUN_BYTES):
                ids, copies = batch.column(0).slice(first, len(raw)).to_pylist(), [0] * len(raw)
                if numbered:
                    for at, (i, t) in enumerate(zip(ids, raw, strict=True)):
                        key = xxhash.xxh3_64_intdigest(t, hash(i) & ((1 << 64) - 1))
                        copies[at] = seen.get(key, 0)
                        seen[key] = copies[at] + 1
                yield _encoded(open_[0], ids, copies, raw, seed)
                del raw
            del batch
        release()

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    again = written(chosen.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    bounded(chosen)
    if again.isEmpty():
        return chosen.mapInArrow(lambda batches: run(batches, False), _ROWS)
    repeated = Bloom(again.where("doc_id is not null"), "doc_id")
    # the rows that meet are left out by the same worker that encodes the others
    once = chosen.mapInArrow(lambda batches: run(batches, False, repeated), _ROWS)
    more = chosen.where(repeated(F.col("doc_id"))).repartition("doc_id", F.xxhash64("text"))
    return once.union(more.mapInArrow(lambda batches: run(batches, True), _ROWS))


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the column ``into`` (which they must not have yet): the text
    of their ids; null for null."""
    if into in rows.columns:
        raise ValueError(f"there is a column {into} already: name another one")
    shared, open_ = rows.sparkSession.sparkContext.broadcast(open(model, "rb").read()), []  # noqa: SIM115
    at = rows.columns.index(ids)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not open_:
            open_.append(Vocabulary(shared.value))
        made = [open_[0].decode(x) if x is not None else None for x in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, into])

    return map_batches(rows, run, StructType([*rows.schema.fields, StructField(into, StringType())]))
