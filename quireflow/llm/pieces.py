"""Sampled piece encoding: Gumbel top-k without replacement over the segmentation lattice.

A text, with spaces as U+2581 and one put before it, is cut into units at every
U+2581 that follows another character and around characters without a piece;
no piece crosses a cut (only runs of U+2581 join pieces across spaces, and
they stay within a unit), so the lattice of the text is the chain of its units'
lattices. Backward masses of the distinct units give every node's exact
conditional probabilities. The k segmentations with the largest perturbed
log-probabilities are found top-down: the best path inherits its parent's
Gumbel, the rest of every node on it gets a truncated one and joins the
frontier, and the largest of the frontier is expanded next (an A-star search whose
keys are exact). The (k+1)-th value is the threshold of the inclusion
probabilities. All noise is a hash of the row's key and the place, so results
don't depend on partitioning.

Piece weights are those of the frozen vocabulary: 1 / (rank + ``offset``), the
rank being the order of merges. Characters without a piece are spelled in byte
pieces. Decoding inverts encoding exactly, whatever the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm import shingles as S

_BAR = 0x2581
#: Stands for a U+2581 of the text itself, which is spelled in bytes.
_LITERAL = 0x110000
_BITS = 18
#: A process keeps the lattices of up to so many units between runs of texts, then only the half used most.
_UNITS = 240_000
_CHUNK = 1 << 20


@dataclass(frozen=True)
class Sampling:
    k: int = 2
    offset: float = 50.0
    seed: int = 1


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id; ``bytes_`` has the ids of the 256 byte pieces."""

    pieces: tuple[str, ...]
    usable: tuple[bool, ...]
    bytes_: tuple[int, ...]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads a SentencePiece model with byte pieces; the file is only needed on the driver."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = tuple(model.id_to_piece(i) for i in range(n))
        usable = tuple(not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n))
        by_value = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
        return cls(pieces, usable, tuple(by_value[b] for b in range(256)))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Lattice:
    """Piece lookup and weights of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary, offset: float):
        self.vocabulary = vocabulary
        mine = [i for i, (p, ok) in enumerate(zip(vocabulary.pieces, vocabulary.usable)) if ok and p]
        self.longest = max(len(vocabulary.pieces[i]) for i in mine)
        self.weight = np.full(len(vocabulary.pieces) + 1, -np.inf)
        self.weight[mine] = -np.log(np.arange(len(mine)) + offset)
        self.byte_weight = -np.log(len(mine) + offset)
        self.single = {ord(vocabulary.pieces[i]) for i in mine if len(vocabulary.pieces[i]) == 1}
        self.known = np.zeros(_LITERAL + 1, bool)
        self.known[list(self.single)] = True
        self.keys, self.ids = np.zeros(1 << _BITS, np.uint64), np.full(1 << _BITS, -1, np.int64)
        flat = np.concatenate([_points(vocabulary.pieces[i]) for i in mine])
        size = np.array([len(vocabulary.pieces[i]) for i in mine])
        end = np.cumsum(size)
        for i, h in zip(mine, _spans(_prefix(flat), end - size, size).tolist()):
            slot = h >> (64 - _BITS)
            while self.ids[slot] >= 0:
                slot = (slot + 1) & ((1 << _BITS) - 1)
            self.keys[slot], self.ids[slot] = h, i

        self.seen, self.edges = np.zeros(0, np.uint64), Edges.none()
        self.base, self.sizes, self.used = (np.zeros(0, np.int64) for _ in range(3))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids by hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        todo, slot = np.arange(len(h)), (h >> np.uint64(64 - _BITS)).astype(np.int64)
        while len(todo):
            id_ = self.ids[slot]
            hit = (self.keys[slot] == h[todo]) & (id_ >= 0)
            out[todo[hit]] = id_[hit]
            on = ~hit & (id_ >= 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << _BITS) - 1)
        return out

    def units(self, h: np.ndarray, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[Edges, np.ndarray]:
        """Edges that include those of the units (distinct hashes), and each one's first position there."""
        if len(self.seen) > _UNITS:
            self._forget()
        at = np.searchsorted(self.seen, h)
        new = np.ones(len(h), bool)
        if len(self.seen):
            new = self.seen[np.minimum(at, len(self.seen) - 1)] != h
        if new.any():
            mine, begin = size[new], np.cumsum(size[new]) - size[new]
            spread = np.arange(mine.sum()) - np.repeat(begin, mine) + np.repeat(start[new], mine)
            nodes = len(self.edges.row) - 1
            self.edges = self.edges.joined(self.build(points[spread], begin, mine))
            seen, base, sizes, used = (np.concatenate(x) for x in ((self.seen, h[new]), (self.base, begin + nodes), (self.sizes, mine), (self.used, np.zeros(len(mine), np.int64))))
            order = np.argsort(seen)
            self.seen, self.base, self.sizes, self.used = seen[order], base[order], sizes[order], used[order]
        at = np.searchsorted(self.seen, h)
        self.used[at] += 1
        return self.edges, self.base[at]

    def _forget(self) -> None:
        keep = np.sort(np.argsort(-self.used, kind="stable")[: _UNITS // 2])
        sizes = self.sizes[keep]
        begin = np.cumsum(sizes) - sizes
        nodes = np.arange(sizes.sum()) - np.repeat(begin, sizes) + np.repeat(self.base[keep], sizes)
        old, self.edges = self.edges, self.edges.only(nodes)
        del old
        self.seen, self.base, self.sizes, self.used = self.seen[keep], begin, sizes, self.used[keep] // 2

    def build(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Edges:
        """The units' edges, by position and length, with their conditional probabilities given the position."""
        n = len(points)
        end = np.repeat(starts + sizes, sizes)
        prefix = _prefix(points)
        spelled = np.flatnonzero(~self.known[points])
        sources, lengths, ids, weights = [spelled], [np.ones(len(spelled), np.int64)], [np.full(len(spelled), -1)], [_byte_count(points[spelled]) * self.byte_weight]
        at = np.arange(n)
        for length in range(1, self.longest + 1):
            at = at[at + length <= end[at]]
            if not len(at):
                break
            found = self.find(_spans(prefix, at, np.full(len(at), length)))
            hit = found >= 0
            sources.append(at[hit])
            lengths.append(np.full(len(sources[-1]), length))
            ids.append(found[hit])
            weights.append(self.weight[found[hit]])
        source, length, id_, weight = (np.concatenate(x) for x in (sources, lengths, ids, weights))
        order = np.argsort(source, kind="stable")
        source, length, id_, total = source[order], length[order], id_[order], weight[order]
        row = np.searchsorted(source, np.arange(n + 1))
        # backward masses, by the distance to the unit's end
        mass = np.zeros(n + 1)
        left = end[source] - source
        most = int(left.max()) if n else 0
        order = np.argsort(left.astype(np.uint16) if most < 1 << 16 else left, kind="stable")  # short keys are sorted by radix
        cuts = np.searchsorted(left[order], np.arange(1, most + 2))
        target = source + length
        inner = target < end[source]
        for d in range(len(cuts) - 1):
            e = order[cuts[d] : cuts[d + 1]]
            if not len(e):
                continue
            mine = source[e]
            total[e] += np.where(inner[e], mass[target[e]], 0.0)
            first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            top = np.maximum.reduceat(total[e], first)
            spread = np.repeat(top, np.diff(np.append(first, len(e))))
            mass[mine[first]] = top + np.log(np.add.reduceat(np.exp(total[e] - spread), first))
        chance = np.exp(total - mass[source])
        running = np.cumsum(chance)
        return Edges(row, length.astype(np.int8), id_.astype(np.int32), chance, running - np.repeat(np.concatenate([[0.0], running])[row[:-1]], np.diff(row)))


@dataclass
class Edges:
    """Edges ``row[i]`` to ``row[i + 1]`` leave position i: lengths, piece ids (-1: spelled in bytes), probabilities and their running sums."""

    row: np.ndarray
    length: np.ndarray
    id: np.ndarray
    chance: np.ndarray
    running: np.ndarray
    room: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def none(cls) -> Edges:
        return cls(np.zeros(1, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int32), np.zeros(0), np.zeros(0))

    def joined(self, more: Edges) -> Edges:
        """These edges and more; they are written behind these where the arrays have room, so that growing is amortised."""
        out, room = {}, dict(self.room)
        for k in ("row", "length", "id", "chance", "running"):
            old, new = getattr(self, k), getattr(more, k)
            if k == "row":
                old, new = old[:-1], new + len(self.id)
            size = len(old) + len(new)
            if k not in room or len(room[k]) < size:
                room[k] = np.empty(size + size // 2, old.dtype)
                room[k][: len(old)] = old
            room[k][len(old) : size] = new
            out[k] = room[k][:size]
        return Edges(**out, room=room)

    def only(self, nodes: np.ndarray) -> Edges:
        many = self.row[nodes + 1] - self.row[nodes]
        row = np.concatenate([[0], np.cumsum(many)])
        e = np.arange(row[-1]) - np.repeat(row[:-1], many) + np.repeat(self.row[nodes], many)
        return Edges(row, *(getattr(self, k)[e] for k in ("length", "id", "chance", "running")))

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of every node that a uniform number picks."""
        e, last = self.row[node].copy(), self.row[node + 1] - 1
        todo = np.flatnonzero((self.running[e] <= u) & (e < last))
        while len(todo):
            e[todo] += 1
            todo = todo[(self.running[e[todo]] <= u[todo]) & (e[todo] < last[todo])]
        return e

    def free(self, node: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """Probability of the node's edges that the bitmap does not take."""
        out, e, last = np.zeros(len(node)), self.row[node].copy(), self.row[node + 1]
        k, todo = 0, np.arange(len(node))
        while len(todo):
            out[todo] += np.where((taken[todo] >> k) & 1, 0.0, self.chance[e[todo] + k])
            k += 1
            todo = todo[e[todo] + k < last[todo]]
        return out

    def draw_free(self, node: np.ndarray, taken: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge that a number in (0, 1) picks among those not taken."""
        want = u * self.free(node, taken)
        out, e, last = np.full(len(node), -1), self.row[node], self.row[node + 1]
        sum_, k, todo = np.zeros(len(node)), 0, np.arange(len(node))
        while len(todo):
            ok = ((taken[todo] >> k) & 1) == 0
            mine = todo[ok]
            sum_[mine] += self.chance[e[mine] + k]
            settle = mine[(out[mine] < 0) | (sum_[mine] - self.chance[e[mine] + k] <= want[mine])]
            out[settle] = e[settle] + k
            k += 1
            todo = todo[e[todo] + k < last[todo]]
        return out


def _prefix(points: np.ndarray) -> np.ndarray:
    power, _ = S._power_tables(len(points) + 1)
    out = np.zeros(len(points) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], out=out[1:])
    return out


def _spans(prefix: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    _, inverse = S._power_tables(len(prefix))
    with np.errstate(over="ignore"):
        return S.mix((prefix[start + size] - prefix[start]) * inverse[start] + size.astype(np.uint64))


def _byte_count(points: np.ndarray) -> np.ndarray:
    return np.where(points == _LITERAL, 3, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))


class Batch:
    """The units and nodes of a run of texts."""

    def __init__(self, lattice: Lattice, texts: list[str]):
        self.lattice, self.texts = lattice, texts
        raw = [_points(t) for t in texts]
        parts = [np.concatenate([[_BAR], np.where(p == 32, _BAR, np.where(p == _BAR, _LITERAL, p))]) if len(p) else p for p in raw]
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        points = self.points = np.concatenate([np.zeros(0, np.int64), *parts])
        n = self.n = len(points)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.first))
        cut = np.zeros(n + 1, bool)
        cut[self.first] = True
        if n:
            bar, odd = points == _BAR, ~lattice.known[points]
            cut[1:n] |= (bar[1:] & ~bar[:-1]) | odd[1:] | odd[:-1]
        self.start = np.flatnonzero(cut[:n])
        self.size = np.diff(np.append(self.start, n))
        h = _spans(_prefix(points), self.start, self.size) if n else np.zeros(0, np.uint64)
        distinct, where, unit = np.unique(h, return_index=True, return_inverse=True)
        self.edges, base = lattice.units(distinct, points, self.start[where], self.size[where])
        self.of = np.repeat(np.arange(len(self.start), dtype=np.int32), self.size)
        self.node = (np.repeat((base[unit] - self.start).astype(np.int32), self.size) + np.arange(n, dtype=np.int32)) if n else np.zeros(0, np.int32)

    def uniform(self, keys: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
        """In (0, 1), by the text's key, the place in it and the draw."""
        with np.errstate(over="ignore"):
            # the text's mixed key less its first position, so that one addition gives both
            mixed = S.mix(keys + np.uint64(salt)) - self.first[:-1].astype(np.uint64)
            h = S.mix(mixed[self.doc[at]] + at.astype(np.uint64))
        return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)

    def walk(self, at: np.ndarray, path: np.ndarray, keys: np.ndarray, salt: int) -> None:
        """Draws edges from every position of ``at`` to its unit's end into ``path``."""
        edges = self.edges
        while len(at):
            node = self.node[at]
            e = edges.draw(node, self.uniform(keys, at, salt))
            path[at] = e
            after = at + edges.length[e]
            inside = after < self.n
            at, after = at[inside], after[inside]
            at = after[self.of[after] == self.of[at]]


#: Exact bounds of the noise: a uniform number has 53 bits, so that -log(-log(u)) is under 37.5; nodes this unlikely
#: stay unvalued until the largest value known falls below what they could reach.
_REACH, _LIKELY = 37.5, -45.0
#: Steps of a log-probability in a unit.
_FIXED = float(1 << 34)


class Path:
    """A segmentation of every text: edge by position (-1: no node), what was taken at the nodes, and the values of what is left there."""

    def __init__(self, batch: Batch, edge: np.ndarray, fresh: np.ndarray, bound: np.ndarray, keys: np.ndarray, salt: int):
        self.batch, self.keys, self.salt, self.bound = batch, keys, salt, bound
        nodes = self.nodes = np.flatnonzero(edge >= 0)
        self.edge = edge[nodes]
        self.doc = batch.doc[nodes]
        # in fixed point, so that sums don't depend on which texts stand before
        step = np.rint(np.log(np.maximum(batch.edges.chance[self.edge], 1e-300)) * _FIXED).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(step)])
        self.first = np.searchsorted(self.doc, np.arange(len(batch.texts) + 1))
        self.before = (total[:-1] - total[self.first[self.doc]]) / _FIXED
        self.log = (total[self.first[1:]] - total[self.first[:-1]]) / _FIXED
        self.taken = np.left_shift(1, self.edge - batch.edges.row[batch.node[nodes]])
        self.value = np.full(len(nodes), -np.inf)
        self.fresh = fresh[nodes]
        self.lazy = self.fresh & (self.before < _LIKELY)
        self.set(np.flatnonzero(self.fresh & ~self.lazy), bound, salt)

    def set(self, at: np.ndarray, bound: np.ndarray, salt: int) -> None:
        """Values what is left at these nodes: a Gumbel of its mass, truncated at the bound; -inf where nothing is left."""
        free = self.batch.edges.free(self.batch.node[self.nodes[at]], self.taken[at])
        self.value[at] = -np.inf
        at, free = at[free > 0], free[free > 0]
        place = self.before[at] + np.log(free)
        noise = np.log(-np.log(self.batch.uniform(self.keys, self.nodes[at], salt)))
        self.value[at] = -np.logaddexp(-bound[self.doc[at]], noise - place)

    def best(self) -> np.ndarray:
        """The largest value of every text."""
        out = np.full(len(self.first) - 1, -np.inf)
        some = np.flatnonzero(np.diff(self.first))
        if len(some):
            out[some] = np.maximum.reduceat(self.value, self.first[some])
        return out

    def settle(self, docs: np.ndarray) -> None:
        """Values the nodes put off in these texts."""
        at = np.flatnonzero(self.lazy & docs[self.doc])
        self.lazy[at] = False
        self.set(at, self.bound, self.salt)


def _largest(paths: list[Path]) -> np.ndarray:
    """The largest values by path and text, after valuing put-off nodes wherever they could be larger."""
    best = np.stack([p.best() for p in paths])
    unsure = best.max(axis=0) < _LIKELY + _REACH
    if unsure.any():
        for p in paths:
            p.settle(unsure)
        best = np.stack([p.best() for p in paths])
    return best


def top_k(batch: Batch, keys: np.ndarray, k: int) -> tuple[list[Path], np.ndarray, np.ndarray, np.ndarray]:
    """k paths, their log-probabilities and perturbed values by text (-inf: none), and the thresholds."""
    docs, n = len(batch.texts), batch.n
    logs, values = np.full((k, docs), -np.inf), np.full((k, docs), -np.inf)
    paths: list[Path] = []
    edges = batch.edges
    with np.errstate(over="ignore"):
        root = ((S.mix(S.mix(keys + np.uint64(7)) + np.uint64(9)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    for r in range(k):
        edge = np.full(n, -1, np.int64)
        if r == 0:
            values[0] = -np.log(-np.log(root))
            batch.walk(batch.start, edge, keys, 1)
            fresh, alive = np.ones(n, bool), np.ones(docs, bool)
        else:
            best = _largest(paths)
            source, values[r] = best.argmax(axis=0), best.max(axis=0)
            alive = np.isfinite(values[r])
            split = np.full(docs, n, np.int64)
            go = []
            for number, p in enumerate(paths):
                mine = alive & (source == number)
                chosen = np.flatnonzero(mine[p.doc] & (p.value == values[r][p.doc]))
                chosen = chosen[np.unique(p.doc[chosen], return_index=True)[1]]
                if not len(chosen):
                    continue
                at = p.nodes[chosen]
                split[p.doc[chosen]] = at
                copied = mine[p.doc] & (p.nodes < split[p.doc])
                edge[p.nodes[copied]] = p.edge[copied]
                # one of the pieces not yet taken at this node; the others stay with the older path, below the new value
                node = batch.node[at]
                e = edges.draw_free(node, p.taken[chosen], batch.uniform(keys, at, 1000 + r))
                edge[at] = e
                p.taken[chosen] |= np.left_shift(1, e - edges.row[node])
                p.set(chosen, values[r], 2000 + r)
                after = at + edges.length[e]
                inside = after < n
                go.append(after[inside][batch.of[after[inside]] == batch.of[at[inside]]])
            fresh = np.arange(n) > split[batch.doc]
            go.append(batch.start[fresh[batch.start] & (batch.start > split[batch.doc[batch.start]])])
            batch.walk(np.concatenate(go), edge, keys, 3 + 10 * r)
        path = Path(batch, edge, fresh, values[r], keys, 5 + 10 * r)
        logs[r, alive] = path.log[alive]
        paths.append(path)
    return paths, logs, values, _largest(paths).max(axis=0)


def piece_ids(path: Path) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a path over all texts and where each text's begin."""
    batch, nodes = path.batch, path.nodes
    ids = batch.edges.id[path.edge]
    counts = np.ones(len(nodes), np.int64)
    spelled = np.flatnonzero(ids < 0)
    if len(spelled):
        counts[spelled] = _byte_count(batch.points[nodes[spelled]])
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.repeat(ids, counts)
    for j in spelled:
        point = int(batch.points[nodes[j]])
        raw = chr(_BAR if point == _LITERAL else point).encode("utf-8", "surrogatepass")
        out[at[j] : at[j] + len(raw)] = [batch.lattice.vocabulary.bytes_[b] for b in raw]
    return out, at[path.first]


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text that was encoded."""
    spelled = {i: b for b, i in enumerate(vocabulary.bytes_)}
    raw = b"".join(bytes([spelled[i]]) if i in spelled else vocabulary.pieces[i].replace("▁", " ").encode() for i in ids)
    return raw.decode("utf-8", "surrogatepass")[1:]


_lattices: dict[tuple, Lattice] = {}


def _lattice(vocabulary: Vocabulary, offset: float) -> Lattice:
    """The lattice of a vocabulary, once in a process."""
    key = (hash(vocabulary.pieces), offset)
    if key not in _lattices:
        _lattices[key] = Lattice(vocabulary, offset)
    return _lattices[key]


def sample_pieces(docs: DataFrame, vocabulary: Vocabulary, s: Sampling = Sampling()) -> DataFrame:
    """doc_id, sample, ids, log_prob, perturbed, log_inclusion: up to k distinct segmentations of every whole text.

    ``sample`` counts from 0 in the order of the perturbed values. Fewer rows
    come out where a text has fewer segmentations; then all have inclusion
    probability 1 (log 0). A null or empty text has one, the empty one. The
    noise depends on the seed, doc_id and text only: repeated rows come out
    alike, also with a null doc_id. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(vocabulary, s.offset)
        for rows in batches:
            keys = rows.column(2).to_numpy().view(np.uint64)
            for i, j, data, offsets in S.chunks(rows.column(1), _CHUNK):
                raw = data.tobytes()
                batch = Batch(lattice, [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])])
                paths, logs, values, threshold = top_k(batch, keys[i:j], s.k)
                for r, path in enumerate(paths):
                    ids, at = piece_ids(path)
                    there = np.flatnonzero(np.isfinite(values[r]))
                    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    x = np.full(len(threshold), np.inf)
                    np.subtract(logs[r], threshold, out=x, where=np.isfinite(threshold))
                    inclusion = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.clip(x, -30, 700)))))
                    take = pa.array(there)
                    yield pa.RecordBatch.from_arrays([rows.column(0).slice(i, j - i).take(take), pa.array(np.full(len(there), r, np.int32)), lists.take(take), pa.array(logs[r][there]), pa.array(values[r][there]), pa.array(inclusion[there])], names=["doc_id", "sample", "ids", "log_prob", "perturbed", "log_inclusion"])

    key = F.xxhash64(F.lit(s.seed), F.col("doc_id").cast("string"), "text")
    return docs.select("doc_id", "text", key.alias("key")).mapInArrow(run, f"doc_id {kind}, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double")
