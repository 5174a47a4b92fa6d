"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text is a lattice of vocabulary pieces. A piece's probability follows Zipf's law over its
merge rank in the given model (``1 / (rank + 2)``, normalised; bytes rank last); nothing is
trained. Perturbed A-star search: a hypothesis is a path from the start of the text with the
mass of all its completions (exact, by a backward sum over the lattice), perturbed by a Gumbel
variable that is conditioned on the maximum of its parent. Popping the best hypothesis yields
the next sampled segmentation; all siblings off its path enter the agenda as one hypothesis,
perturbed jointly, since the maximum of Gumbels is a Gumbel of their summed mass; which of
them has it is drawn by mass when it is popped. After ``k`` pops the next best perturbation
is the threshold for inclusion scores (Kool et al., 2019). Gumbels are kept as ``-log T`` of
times: a child's time is its parent's plus an exponential.

Draws are hashes of the row's seed, the round and the character position, so a row's samples depend
on nothing but its key and text. Batches of texts advance together in numpy.

Spaces open a unit; no piece of this kind of model crosses from one unit to the next, and pieces of
several spaces are not used. Characters without a piece are bytes, and so is a literal U+2581,
so decoding gives back the exact text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spendlens.llm.common import runs_of

MARK = "▁"
RUN_CHARS = 250_000
#: Rows of a batch whose texts are Python strings at a time.
SLICE_ROWS = 1_000
#: Edges of remembered units in a worker process (20 bytes each); beyond, all are forgotten.
MOST_EDGES = 2_000_000
POINTS = 0x110000


@dataclass(frozen=True)
class Pieces:
    """A model's pieces: the text (spaces for marks) and log probability by id, and byte ids."""

    texts: list[str | None]
    log_p: np.ndarray
    bytes_: np.ndarray

    @classmethod
    def load(cls, path: str) -> Pieces:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        ids, bytes_ = [], np.zeros(256, np.int64)
        texts: list[str | None] = [None] * n
        for i in range(n):
            if model.is_byte(i):
                bytes_[int(model.id_to_piece(i)[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = model.id_to_piece(i).replace(MARK, " ")
                if " " in text[1:]:
                    if text.strip(" "):
                        raise ValueError(f"piece {i} crosses from one unit to the next")
                    continue  # several spaces
                texts[i] = text
                ids.append(i)
        ranked = sorted(ids, key=lambda i: -model.get_score(i))
        weight = np.zeros(n)
        weight[ranked] = 1 / (np.arange(len(ranked)) + 2)
        weight[bytes_] = 1 / (len(ranked) + 2)
        with np.errstate(divide="ignore"):
            return cls(texts, np.log(weight / weight.sum()), bytes_)

    @cached_property
    def sampler(self) -> Sampler:
        """One for all tasks of a worker process: later tasks find the trie and the lattices of known units."""
        return Sampler(self)

    def __getstate__(self) -> dict:
        return {name: own for name, own in self.__dict__.items() if name != "sampler"}

    def spelling(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces' bytes on end, and by id where its bytes begin and how many there are."""
        parts = [(t or "").encode() for t in self.texts]
        for octet, i in enumerate(self.bytes_.tolist()):
            parts[i] = bytes([octet])
        size = np.array([len(x) for x in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation; ids of no piece are left out."""
        return decode_all(np.asarray(ids, np.int64), np.array([len(ids)]), self.spelling())[0].decode("utf-8", "replace")


def decode_all(ids: np.ndarray, sizes: np.ndarray, spelling: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
    """The texts (UTF-8) of many segmentations on end, without the space before each."""
    octets, begin, size = spelling
    own = size[ids]
    stop = np.cumsum(own)
    text = octets[np.repeat(begin[ids] - stop + own, own) + np.arange(int(own.sum()))].tobytes()
    ends = np.r_[0, stop][np.cumsum(sizes)].tolist()
    return [text[a + 1 : b] for a, b in zip([0, *ends[:-1]], ends)]


class Trie:
    """Prefix tree over the pieces; steps for whole arrays of states at once."""

    BITS = 19

    def __init__(self, pieces: Pieces) -> None:
        steps: dict[tuple[int, int], int] = {}
        piece = [-1]
        for i, text in enumerate(pieces.texts):
            if text is None:
                continue
            state = 0
            for char in map(ord, text):
                to = steps.setdefault((state, char), len(piece))
                if to == len(piece):
                    piece.append(-1)
                state = to
            piece[state] = i
        while len(steps) * 2 > 1 << self.BITS:
            self.BITS += 1
        self.piece = np.array(piece, np.int64)
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.to = np.zeros(1 << self.BITS, np.int64)
        mask = (1 << self.BITS) - 1
        for (state, char), to in steps.items():
            key = state * POINTS + char
            slot = int(self._slot(np.array([key]))[0])
            while self.keys[slot] >= 0:
                slot = (slot + 1) & mask
            self.keys[slot], self.to[slot] = key, to

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """States after one more character, -1 where no piece goes on."""
        key = state * POINTS + char
        slot = self._slot(key)
        out = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        while len(left):
            at = slot[left]
            found = self.keys[at]
            hit = found == key[left]
            out[left[hit]] = self.to[at[hit]]
            left = left[~hit & (found >= 0)]
            slot[left] = (slot[left] + 1) & ((1 << self.BITS) - 1)
        return out


class Lattices:
    """Lattices of units, remembered: a node per character, edges with conditional probabilities.

    An edge's ``piece`` is an id, or the number of pieces plus a code point that is spelt in bytes.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.trie = pieces, Trie(pieces)
        self.forget()

    def forget(self) -> None:
        self.units: dict[str, int] = {}
        self.first = np.zeros(1, np.int64)  # by node: its first edge; a unit's last node has none
        self.to_end = np.zeros(0, np.int32)  # by node: characters to the unit's last node
        self._parts = {"to": np.int32, "piece": np.int32, "log_q": np.float64, "upto": np.float32}
        for name, kind in self._parts.items():
            setattr(self, name, np.zeros(0, kind))
        self._room: dict[str, np.ndarray] = {}

    def _extend(self, name: str, more: np.ndarray, keep: int) -> None:
        """Puts ``more`` behind the first ``keep`` values; room grows by a quarter, so that little is copied."""
        own = getattr(self, name)
        room, need = self._room.get(name, own), keep + len(more)
        if need > len(room):
            room = np.empty(max(need, len(room) * 5 // 4), own.dtype)
            room[:keep] = own[:keep]
            self._room[name] = room
        room[keep:need] = more
        setattr(self, name, room[:need])

    def span(self, edge: int) -> tuple[int, int]:
        """The edges that leave the node of ``edge``."""
        node = self.owner(edge)
        return int(self.first[node]), int(self.first[node + 1])

    def owner(self, edge: int) -> int:
        """The node that ``edge`` leaves."""
        return int(np.searchsorted(self.first, edge, side="right")) - 1

    def nodes(self, units: list[str]) -> np.ndarray:
        """The first node of each unit."""
        at = np.fromiter(map(self.units.get, units, repeat(-1)), np.int64, len(units))
        if (at < 0).any():
            if len(self.to) > MOST_EDGES:
                self.forget()
                return self.nodes(units)
            missing = np.flatnonzero(at < 0)
            new = [units[i] for i in missing.tolist()]
            self._add(list(dict.fromkeys(new)))
            at[missing] = np.fromiter(map(self.units.__getitem__, new), np.int64, len(new))
        return at

    def _add(self, new: list[str]) -> None:
        sizes = np.array([len(u) + 2 for u in new])  # a space before, a last node after
        text = f" {'\0 '.join(new)}\0"
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        stop = np.cumsum(sizes)
        last = np.zeros(len(chars), bool)
        last[stop - 1] = True
        to_end = np.repeat(stop, sizes) - 1 - np.arange(len(chars))
        # Nodes by their distance from the unit's end: what a node leads to stands before it.
        kind = np.uint16 if sizes.max() < 1 << 16 else np.int64
        order = np.argsort(to_end.astype(kind), kind="stable")
        rank = np.empty(len(chars), np.int32)
        rank[order] = np.arange(len(chars), dtype=np.int32)
        at, state, size = np.flatnonzero(~last), np.zeros(int((~last).sum()), np.int64), 0
        starts, ends, found = [], [], []
        many = np.zeros(len(chars), np.int32)
        while len(at):
            state = self.trie.step(state, chars[at + size])
            size += 1
            on = state >= 0
            piece = np.where(on, self.trie.piece[state], -1)
            if size == 1:
                piece = np.where(piece >= 0, piece, len(self.pieces.texts) + chars[at])
            whole = piece >= 0
            here = rank[at[whole]]
            many[here] += 1
            starts.append(here)
            ends.append(rank[at[whole] + size])
            found.append(piece[whole].astype(np.int32))
            on &= to_end[at] > size
            at, state = at[on], state[on]
        first = np.r_[0, np.cumsum(many, dtype=np.int64)]
        free, total = first[:-1].copy(), int(first[-1])
        to, piece = np.empty(total, np.int32), np.empty(total, np.int32)
        # Longest pieces first, as they are the likeliest.
        for start, end, own in zip(starts[::-1], ends[::-1], found[::-1]):
            spot = free[start]
            to[spot], piece[spot] = end, own
            free[start] = spot + 1
        log_q, beta, p = self.log_p(piece), np.zeros(len(chars)), np.empty(total)
        deep = np.searchsorted(to_end[order], np.arange(1, int(sizes.max()) + 1)).tolist()
        for n, m in zip(deep[:-1], deep[1:]):
            a, b = int(first[n]), int(first[m])
            head, own = first[n:m] - a, many[n:m]
            w = log_q[a:b] + beta[to[a:b]]
            top = np.maximum.reduceat(w, head)
            e = np.exp(w - np.repeat(top, own))
            mass = np.add.reduceat(e, head)
            beta[n:m] = top + np.log(mass)
            log_q[a:b] = w - np.repeat(beta[n:m], own)
            p[a:b] = e / np.repeat(mass, own)
        node, edge = len(self.first) - 1, len(self.to)
        run = np.r_[0.0, np.cumsum(p)]
        more = {"to": node + to, "piece": piece, "log_q": log_q, "upto": run[1:] - np.repeat(run[first[:-1]], many)}
        self._extend("first", edge + first, node)
        self._extend("to_end", to_end[order], node)
        for name in self._parts:
            self._extend(name, more[name], edge)
        self.units.update(zip(new, (node + rank[stop - sizes]).tolist()))

    def log_p(self, piece: np.ndarray) -> np.ndarray:
        n = len(self.pieces.texts)
        point = np.maximum(piece - n, 0)
        octets = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        plain = self.pieces.log_p[np.minimum(piece, n - 1)]
        return np.where(piece < n, plain, octets * self.pieces.log_p[self.pieces.bytes_[0]])


def _draw(seed: np.ndarray, salt: int, place: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1): splitmix64 of seed, salt and place."""
    x = seed + np.uint64(salt * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _draw_one(seed: int, salt: int, place: int) -> float:
    """The same for one value, without arrays."""
    whole = 0xFFFFFFFFFFFFFFFF
    x = (seed + salt * 0xD1342543DE82EF95 + (place + 1) * 0x9E3779B97F4A7C15) & whole
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & whole
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & whole
    x ^= x >> 31
    return ((x >> 11) + 0.5) / 2.0**53


@dataclass
class Paths:
    """One path for each of some texts, flat and in text order."""

    row: np.ndarray  # the text
    edge: np.ndarray
    place: np.ndarray  # character position in the text
    unit: np.ndarray


@dataclass
class Siblings:
    """A path and what leaves it from step ``floor`` on, but for edges ``gone`` (by step)."""

    edge: np.ndarray
    place: np.ndarray
    unit: np.ndarray
    floor: int
    gone: dict[int, set[int]]
    before: np.ndarray | None = None
    mass: np.ndarray | None = None


class Sampler:
    def __init__(self, pieces: Pieces) -> None:
        self.lattices = Lattices(pieces)

    def sample(self, texts: list[str], seeds: np.ndarray, k: int) -> list[tuple[int, int, np.ndarray, float, float, float]]:
        """(text, rank from 1, ids, log probability, log inclusion, Gumbel score) of each sample."""
        lat, n = self.lattices, len(texts)
        units: list[str] = []
        counts = np.zeros(n, np.int64)
        for at, text in enumerate(texts):
            parts = text.split(" ")
            counts[at] = len(parts)
            units += parts
        if not n:
            return []
        node = lat.nodes(units)
        lengths = lat.to_end[node].astype(np.int64)
        row = np.repeat(np.arange(n), counts)
        self.from_unit = np.r_[0, np.cumsum(counts)]
        origin = np.cumsum(lengths) - lengths
        self.node, self.row, self.place = node, row, origin - origin[self.from_unit[:-1]][row]
        self.seeds = seeds.astype(np.int64).view(np.uint64)
        # What the whole lattice of a text weighs cancels out: all masses are relative to it.
        now = self._descend(np.arange(len(units)), node, self.place, 1)
        rows, time = np.arange(n), np.log(-np.log(_draw(self.seeds, 2, np.zeros(n))))
        # By text: hypotheses (time, all siblings off path ``rank`` from step ``floor`` on).
        agenda: list[list[tuple[float, int, int]]] = [[] for _ in range(n)]
        paths: dict[tuple[int, int], Siblings] = {}
        floor = np.zeros(n, np.int64)
        done = []
        for rank in range(1, k + 1):
            at = np.searchsorted(now.row, np.r_[rows, n]).tolist()
            steps = lat.log_q[now.edge]
            log_q = np.add.reduceat(steps, at[:-1])
            shared = np.arange(len(steps)) - np.repeat(at[:-1], np.diff(at)) < np.repeat(floor[rows], np.diff(at))
            kept = np.add.reduceat(np.where(shared, steps, 0.0), at[:-1])
            # What leaves the path below its floor: all that the floor reaches, but the path.
            own = np.add.reduceat(np.where(shared, 0.0, steps), at[:-1])
            with np.errstate(divide="ignore"):
                left = kept + np.log(-np.expm1(own))
            wait = np.log(-np.log(_draw(self.seeds[rows], 4 * rank, np.zeros(len(rows)))))
            due = np.logaddexp(time, wait - left).tolist()
            for i, r in enumerate(rows.tolist()):
                part = slice(at[i], at[i + 1])
                paths[r, rank] = group = Siblings(now.edge[part], now.place[part], now.unit[part], int(floor[r]), {})
                done.append((r, rank, lat.piece[group.edge], float(log_q[i]), float(time[i])))
                if left[i] > -690:
                    agenda[r].append((due[i], rank))
            if rank == k:
                break
            popped = []
            for r in rows.tolist():
                if agenda[r]:
                    best = min(agenda[r])
                    agenda[r].remove(best)
                    popped.append((r, *best))
            if not popped:
                break
            rows, time = np.array([x[0] for x in popped]), np.array([x[1] for x in popped])
            now = self._branch(popped, paths, agenda, rank + 1, floor)
        out = []
        for r, rank, piece, log_prob, t in done:
            limit = min((x[0] for x in agenda[r]), default=np.inf)
            with np.errstate(over="ignore", divide="ignore"):
                inclusion = float(np.log(-np.expm1(-np.exp(log_prob + limit))))
            out.append((r, rank, piece, log_prob, inclusion, -t))
        return out

    def _push(self, agenda: list, r: int, rank: int, group: Siblings, t: float) -> None:
        """Puts what a pop has left of a group of siblings on the agenda, with its next time."""
        left = float(self._masses(group).sum())
        if left > 0:
            again = len(group.gone) * 64 + rank
            wait = np.log(-np.log(_draw_one(int(self.seeds[r]), 4 * again, 0)))
            agenda.append((float(np.logaddexp(t, wait - np.log(left))), rank))

    def _masses(self, group: Siblings) -> np.ndarray:
        """By step: mass of all siblings not yet taken; below 1e-300 of the text it counts as none."""
        lat = self.lattices
        if group.mass is None:
            p = np.exp(lat.log_q[group.edge])
            reach = np.cumprod(p)
            before = np.concatenate(([1.0], reach[:-1]))
            group.before = before
            group.mass = np.where(p < 1, before - reach, 0.0)
            group.mass[: group.floor] = 0.0
        for step, edges in group.gone.items():
            own = [e for e in range(*lat.span(group.edge[step])) if e not in edges and e != group.edge[step]]
            group.mass[step] = group.before[step] * float(np.exp(lat.log_q[own]).sum()) if own else 0.0
        return group.mass

    def _descend(self, unit: np.ndarray, node: np.ndarray, place: np.ndarray, rank: int) -> Paths:
        """Paths from a node of each unit to the unit's end, drawn by conditional probability."""
        lat, lane = self.lattices, np.arange(len(unit))
        seed, deep = self.seeds[self.row[unit]], lat.to_end[node]
        steps = []
        while len(lane):
            on = deep > 0
            lane, node, place, deep, seed = lane[on], node[on], place[on], deep[on], seed[on]
            if not len(lane):
                break
            lo, hi = lat.first[node], lat.first[node + 1]
            u = _draw(seed, 4 * rank + 1, place)
            edge, look = lo.copy(), np.arange(len(lo))
            while len(look):
                look = look[(lat.upto[edge[look]] <= u[look]) & (edge[look] + 1 < hi[look])]
                edge[look] += 1
            steps.append((lane, edge, place))
            node = lat.to[edge]
            left = lat.to_end[node]
            place, deep = place + (deep - left), left
        if not steps:
            empty = np.zeros(0, np.int64)
            return Paths(empty, empty, empty, empty)
        lanes, edge, place = (np.concatenate(x) for x in zip(*steps))
        order = np.argsort(lanes, kind="stable")
        units = unit[lanes[order]]
        return Paths(self.row[units], edge[order], place[order], units)

    def _branch(self, popped: list, paths: dict, agenda: list, rank: int, floor: np.ndarray) -> Paths:
        """Leaves each popped path by a sibling, chosen by mass, and completes it."""
        lat = self.lattices
        heads, unit, node, place = [], [], [], []
        for r, t, parent in popped:
            group = paths[r, parent]
            draw = [_draw_one(int(self.seeds[r]), 4 * rank + 2, place) for place in (0, 1)]
            run = self._masses(group).cumsum()
            step = int(np.searchsorted(run, draw[0] * run[-1], side="right"))
            gone = group.gone.setdefault(step, set())
            lo, hi = lat.span(group.edge[step])
            others = np.array([e for e in range(lo, hi) if e not in gone and e != group.edge[step]])
            upto = np.cumsum(np.exp(lat.log_q[others]))
            edge = int(others[min(int(np.searchsorted(upto, draw[1] * upto[-1], side="right")), len(others) - 1)])
            gone.add(edge)
            self._push(agenda[r], r, parent, group, t)
            kept = group.edge[: step + 1].copy()
            kept[step] = edge
            heads.append((kept, group.place[: step + 1], group.unit[: step + 1]))
            floor[r] = step + 1
            to, last = int(lat.to[edge]), int(group.unit[step])
            size = int(lat.to_end[lat.owner(edge)] - lat.to_end[to])
            stop = int(self.from_unit[r + 1])
            unit.append(np.arange(last, stop))
            node.append(np.concatenate(([to], self.node[last + 1 : stop])))
            place.append(np.concatenate(([group.place[step] + size], self.place[last + 1 : stop])))
        tail = self._descend(np.concatenate(unit), np.concatenate(node), np.concatenate(place), rank)
        rows = np.array([x[0] for x in popped])
        a, b = np.searchsorted(tail.row, rows).tolist(), np.searchsorted(tail.row, rows, side="right").tolist()
        edge, spot, units = (
            np.concatenate([x for h, i, j in zip(heads, a, b) for x in (h[m], flat[i:j])])
            for m, flat in enumerate((tail.edge, tail.place, tail.unit))
        )
        sizes = np.array([len(h[0]) + j - i for h, i, j in zip(heads, a, b)])
        return Paths(np.repeat(rows, sizes), edge, spot, units)


def _spell(pieces: Pieces, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replaces code points by their bytes' ids; ids and sizes of the lists."""
    n = len(pieces.texts)
    odd = np.flatnonzero(flat >= n)
    if not len(odd):
        return flat, sizes
    points, which = np.unique(flat[odd], return_inverse=True)
    by_point = [pieces.bytes_[list(chr(p - n).encode("utf-8", "surrogatepass"))] for p in points.tolist()]
    spelt = [by_point[i] for i in which.tolist()]
    many = np.ones(len(flat), np.int64)
    many[odd] = np.array([len(x) for x in by_point])[which]
    out = np.repeat(flat, many)
    at = (np.cumsum(many) - many)[odd]
    out[np.repeat(at, many[odd]) + np.arange(int(many[odd].sum())) - np.repeat(np.cumsum(many[odd]) - many[odd], many[odd])] = np.concatenate(spelt)
    ends = np.r_[0, np.cumsum(many)][np.cumsum(sizes)]
    return out, np.diff(ends, prepend=0)


def encode(
    docs: DataFrame, pieces: Pieces, *, k: int = 2, key: str = "doc_id", text: str = "text", seed: int = 0, verify: bool = False
) -> DataFrame:
    """Up to ``k`` distinct segmentations of each row's whole text.

    Columns: ``doc`` (the row without its text), ``sample`` (from 1, in the order drawn), ``ids``,
    ``log_prob`` (of the segmentation among all of the text), ``log_inclusion`` (of being among
    ``k`` drawn without replacement, given the threshold) and ``gumbel``. Texts with fewer than
    ``k`` segmentations give as many as there are; null counts as the empty text, which has
    one. Rows with equal keys and texts get equal samples; a null key is a key. Extra columns
    of any name stay inside ``doc``. With ``verify``, ``lossless`` says whether decoding gives
    the text again. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("doc"),
        F.col(text).alias("text"),
        F.xxhash64(F.col(key), F.lit(seed)).alias("seed"),
    )
    result = "sample int, ids array<int>, log_prob double, log_inclusion double, gumbel double"
    result += ", lossless boolean" * verify
    schema = StructType([rows.schema["doc"], *StructType.fromDDL(result)])

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, spelling = shared.value.sampler, shared.value.spelling()
        for batch in (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
            seeds = batch["seed"].to_numpy()
            for start, part in runs_of(batch["text"].to_pylist(), RUN_CHARS):
                found = sampler.sample(part, seeds[start : start + len(part)], k)
                row, rank, ids, log_prob, inclusion, gumbel = zip(*found)
                flat, sizes = _spell(shared.value, np.concatenate(ids), np.array([len(i) for i in ids]))
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype(np.int32), pa.array(flat, pa.int32()))
                columns = {
                    "doc": batch["doc"].take(pa.array(np.array(row) + start)),
                    "sample": pa.array(rank, pa.int32()),
                    "ids": lists,
                    "log_prob": pa.array(log_prob, pa.float64()),
                    "log_inclusion": pa.array(inclusion, pa.float64()),
                    "gumbel": pa.array(gumbel, pa.float64()),
                }
                if verify:
                    texts = [t.encode("utf-8", "surrogatepass") for t in part]
                    back = decode_all(flat, sizes, spelling)
                    columns["lossless"] = pa.array([texts[r] == x for r, x in zip(row, back)])
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(samples, schema)


def decoded(ids: Column, pieces: Pieces, spark: SparkSession) -> Column:
    """The text of a segmentation; null for null."""
    shared = spark.sparkContext.broadcast(pieces)

    @F.pandas_udf("string")
    def text(batch: pd.Series) -> pd.Series:
        own: Pieces = shared.value
        spelling = own.spelling()
        one = lambda x: decode_all(np.asarray(x, np.int64), np.array([len(x)]), spelling)[0]
        return batch.map(lambda x: None if x is None else one(x).decode("utf-8", "replace"))

    return text(ids)
