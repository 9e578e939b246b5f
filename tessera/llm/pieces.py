"""SentencePiece encoding and decoding with distinct sampled segmentations.

A text's lattice factorises into units (a word with the blanks before it, a line end), because no piece of
the vocabulary crosses from one to the next.  Pieces weigh as in a unigram model whose piece
probabilities follow the rank of the vocabulary (Zipf, to the power ``alpha``); characters that have no piece
go through byte pieces.  Forward sums over each distinct unit's lattice give exact conditional
probabilities.

Samples without replacement come from perturbed A-star search: the root has a Gumbel-distributed bound,
the best leaf below a node keeps the node's bound, and siblings along its path get bounds
conditioned to lie below it.  The next sample is the best leaf of the sibling with the greatest bound,
so segmentations are distinct and come in the order of their perturbed scores.  The bound of what
would come next gives each sample's inclusion probability.  All draws are functions of the row key.

Defined results: null texts count as empty; an empty text has one segmentation without pieces; a text with fewer
segmentations than asked for gives each once, however rare; repeated rows give the same samples; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import GOLD, arrow_schema, mix64, small_batches

SAMPLES = 2
ALPHA = 1.0
#: Characters whose lattices are held at once.
STEP = 1 << 21
#: Characters of distinct units whose lattices a task keeps at most, besides those of one slice.
CACHE_CHARS = 3 << 19
#: Bits of the table in which prefixes of pieces are looked up.
SLOT_BITS = 19
#: Units up to this length are grouped by exact length, longer ones by multiples of 8.
EXACT = 16
#: Below this mass what is left of a unit is summed over its lattice, not taken from 1, and sampled there.
SMALL_MASS = 1e-3
#: Draws of an alternative made together, and how often.
DRAWS, TRIES = 16, 64
PRIME = np.uint64(0x100000001B3)
BLANK = "▁"
#: Stands for a blank mark in the text itself; no valid text holds a lone surrogate.
OWN_MARK = "\ud800"
UNITS = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")


def utf8_size(code: np.ndarray) -> np.ndarray:
    """Bytes of each code point."""
    return 1 + (code > 0x7F).astype(np.int32) + (code > 0x7FF) + (code > 0xFFFF)


def uniform(key: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1), a function of 64-bit keys."""
    return (mix64(key) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def uniform32(key: np.ndarray) -> np.ndarray:
    """The same in single precision, in (0, 1]."""
    return (mix64(key) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24) + np.float32(2.0**-25)


class Numbers(dict):
    """Numbers what is asked for, in order of first sight."""

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        return n


class Spelled(dict):
    """The byte pieces of negative pieces (-1 - code point)."""

    def __init__(self, byte: np.ndarray):
        super().__init__()
        self.byte = byte

    def __missing__(self, piece: int) -> np.ndarray:
        c = chr(-1 - piece)
        out = self[piece] = self.byte[list((BLANK if c == OWN_MARK else c).encode())]
        return out


class Vocabulary:
    """Pieces of a SentencePiece model, to look up substrings and to decode."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n_pieces = self.sp.get_piece_size()
        self.text = [self.sp.id_to_piece(i) for i in range(n_pieces)]
        self.byte = np.zeros(256, dtype=np.int64)
        spells = [t.replace(BLANK, " ").encode() for t in self.text]
        own = []
        for i, t in enumerate(self.text):
            if self.sp.is_byte(i):
                self.byte[int(t[3:5], 16)] = i
                spells[i] = bytes([int(t[3:5], 16)])
            elif not (self.sp.is_control(i) or self.sp.is_unknown(i)) and len(UNITS.findall(t)) == 1:
                own.append(i)
        self.spelled = Spelled(self.byte)
        #: What pieces spell, in UTF-8, one after the other.
        self.letters = np.frombuffer(b"".join(spells), dtype=np.uint8)
        self.letters_of = np.array([len(x) for x in spells])
        self.letters_at = np.cumsum(self.letters_of) - self.letters_of
        rank = np.arange(len(own))
        logs = -alpha * np.log(rank + 2.0)
        self.byte_weight = float(-alpha * np.log(len(own) + 2.0) * 2)
        self.longest = max(len(self.text[i]) for i in own)
        # every prefix of a piece, so that a lookup ends where no piece goes on; rank -1: no piece itself
        of: dict[str, int] = {}
        for k, i in enumerate(own):
            for n in range(1, len(self.text[i])):
                of.setdefault(self.text[i][:n], -1)
            of[self.text[i]] = k
        known: dict[str, int] = {"": 0}
        for t in sorted(of, key=len):
            known[t] = (known[t[:-1]] * int(PRIME) + ord(t[-1]) + 1) & (2**64 - 1)
        h = np.array([known[t] for t in of], dtype=np.uint64)
        order = np.argsort(h)
        # slot: the only entry that falls there, -1 for several, the last entry (of no prefix) for none
        self.hashes, self.ranks = np.append(h[order], np.uint64(0)), np.append(np.array(list(of.values()))[order], -1)
        self.ids, self.weights = np.array(own, dtype=np.int32), logs.astype(np.float32)
        if len(np.unique(self.hashes)) != len(of) + 1:
            raise ValueError("piece hashes collide")
        slot = self.slot(self.hashes[:-1])
        self.slots = np.full(1 << SLOT_BITS, len(of), dtype=np.int32)
        self.slots[slot] = np.arange(len(of), dtype=np.int32)
        self.slots[np.bincount(slot, minlength=1 << SLOT_BITS) > 1] = -1
        self.by_id = np.zeros(n_pieces, dtype=np.float32)
        self.by_id[self.ids] = self.weights

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h * GOLD) >> np.uint64(64 - SLOT_BITS)

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is that of a prefix of a piece, and the rank of the piece that it is (-1: none)."""
        at = self.slots[self.slot(h)]
        several = np.flatnonzero(at < 0)
        if len(several):
            at[several] = np.minimum(np.searchsorted(self.hashes[:-1], h[several]), len(self.hashes) - 2)
        hit = self.hashes[at] == h
        return hit, np.where(hit, self.ranks[at], -1)

    def log_weights(self, ids: np.ndarray) -> np.ndarray:
        """Log weights of pieces; negative ones are characters by bytes."""
        out = self.by_id[np.maximum(ids, 0)]
        lost = ids < 0
        if lost.any():
            out[lost] = self.byte_weight * utf8_size(-1 - ids[lost].astype(np.int64))
        return out

    def normal(self, text: str) -> str:
        """The text as pieces spell it: blanks marked, one before the first word; a mark of the text itself goes by bytes."""
        return BLANK + text.replace(BLANK, OWN_MARK).replace(" ", BLANK) if text else ""

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text that pieces spell."""
        ids = np.asarray(ids, dtype=np.int64)
        size = self.letters_of[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ids) else 0) + np.repeat(self.letters_at[ids] - ends + size, size)
        return self.letters[at].tobytes().decode("utf-8", "replace")[1:]

    def with_bytes(self, ids: np.ndarray) -> np.ndarray:
        """Pieces with each negative one (-1 - code point) replaced by its byte pieces."""
        at = np.flatnonzero(ids < 0)
        own = list(map(self.spelled.__getitem__, ids[at].tolist()))
        size = np.ones(len(ids), dtype=np.int64)
        size[at] = list(map(len, own))
        out = np.repeat(ids, size)
        out[np.repeat(ids < 0, size)] = np.concatenate(own)
        return out

    def encode(self, text: str) -> list[int]:
        """The model's own segmentation."""
        return self.sp.encode(text)


class Lattices:
    """Forward sums and backward choices of units of one width, and sampling from them.

    Each is built for many units together, position by position, with the units side by side in memory.
    """

    NONE = np.int32(-(2**31))  #: no piece

    def __init__(self, vocabulary: Vocabulary, width: int):
        self.v, self.width, self.most, self.size = vocabulary, width, min(width, vocabulary.longest), 0
        self.length = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros((0, width + 1, self.most), dtype=np.int32)  # by end and length
        self.cumulative = np.zeros((0, width + 1, self.most), dtype=np.float32)
        self.total = np.zeros((0, width + 1))

    def add(self, units: list[str]) -> int:
        """Take in units; the row of the first."""
        first, self.size = self.size, self.size + len(units)
        if self.size > len(self.length):
            room = max(self.size, len(self.length) * 5 // 4)
            for name in ("length", "ids", "cumulative", "total"):
                old = getattr(self, name)
                new = np.empty((room, *old.shape[1:]), dtype=old.dtype)
                new[:first] = old[:first]
                setattr(self, name, new)
        self.build(units, slice(first, self.size))
        return first

    def build(self, units: list[str], rows: slice) -> None:
        v, n, width, most = self.v, len(units), self.width, self.most
        length = np.array([len(u) for u in units])
        codes = np.zeros((n, width + 1), dtype=np.uint64)  # 0 ends a unit
        flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes[np.arange(width + 1)[None, :] < length[:, None]] = flat.astype(np.uint64) + np.uint64(1)
        c = codes.T.reshape(-1)  # by place, then unit
        ids = np.full((width + 1, most, n), self.NONE)
        edge = np.full((width + 1, most, n), -np.inf, dtype=np.float32)
        edge_at, id_at, start = edge.reshape(-1), ids.reshape(-1), np.flatnonzero(c)
        h = c[start]
        to = start + (start // n + 1) * ((most - 1) * n) + n  # edge of length 1 from each place
        for k in range(most):
            hit, rank = v.lookup(h)
            own = rank >= 0
            at, r = to[own], rank[own]
            edge_at[at], id_at[at] = v.weights[r], v.ids[r]
            if k == 0 and not own.all():
                lost = ~own
                code = c[start[lost]].astype(np.int64) - 1
                edge_at[to[lost]], id_at[to[lost]] = v.byte_weight * utf8_size(code), -1 - code
            start, h, to = start[hit] + n, h[hit], to[hit] + (most + 1) * n
            if len(start) == 0:
                break
            with np.errstate(over="ignore"):
                h = h * PRIME + c[np.minimum(start, len(c) - 1)]
        total = np.zeros((width + 1, n))
        cumulative = np.zeros((width + 1, most, n), dtype=np.float32)
        for j in range(1, width + 1):
            k = min(j, most)
            x = total[j - k : j][::-1] + edge[j, :k]
            top = x.max(axis=0)
            top[np.isneginf(top)] = 0.0  # beyond the unit's end
            p = np.exp((x - top).astype(np.float32))
            s = np.maximum(p.sum(axis=0), np.float32(1e-30))
            total[j] = top + np.log(s)
            np.cumsum(p, axis=0, out=cumulative[j, :k])
            cumulative[j, :k] /= np.maximum(cumulative[j, k - 1], np.float32(1e-30))  # 1 from the last piece on, so that none is drawn after it
            cumulative[j, k:] = 1.0
        self.length[rows], self.ids[rows], self.cumulative[rows], self.total[rows] = length, ids.transpose(2, 0, 1), cumulative.transpose(2, 0, 1), total.T

    def edges(self, unit, j) -> np.ndarray:
        """Log weights of the pieces that end at ``j``, by length."""
        ids = self.ids[unit, j]
        return np.where(ids == self.NONE, -np.inf, self.v.log_weights(np.where(ids == self.NONE, 0, ids)))

    def sample(self, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each draw: pieces from last to first (negative: a character by bytes), how many."""
        n = len(unit)
        out = np.zeros((n, self.width), dtype=np.int32)
        count = np.zeros(n, dtype=np.int64)
        live, u, at = np.arange(n), unit, self.length[unit]
        for step in range(self.width):
            r = uniform32(key + np.uint64(step) * PRIME)
            k = (self.cumulative[u, at] >= r[:, None]).argmax(axis=1)
            out[live, step] = self.ids[u, at, k]
            at = at - k - 1
            more = at > 0
            count[live[~more]] = step + 1
            live, u, at, key = live[more], u[more], at[more], key[more]
            if len(live) == 0:
                break
        return out[:, : int(count.max(initial=1))], count

    def log_rest(self, unit: np.ndarray) -> np.ndarray:
        """For each unit the log mass of all segmentations but the best one, summed without subtraction.

        Exact where the best one has most of the mass at each of its places, as in units that it dominates.
        """
        rest, suffix = np.zeros(len(unit)), np.ones(len(unit))
        live, at = np.arange(len(unit)), self.length[unit]
        back = np.arange(1, self.most + 1)
        while len(live):
            u = unit[live]
            places = at[:, None] - back[None, :]
            w = np.where(places >= 0, self.total[u[:, None], np.maximum(places, 0)], -np.inf) + self.edges(u, at) - self.total[u, at][:, None]
            p = np.exp(w)
            k, rows = p.argmax(axis=1), np.arange(len(live))
            best = p[rows, k]
            p[rows, k] = 0.0
            rest[live] += suffix[live] * p.sum(axis=1)
            suffix[live] *= best
            at = at - k - 1
            live, at = live[at > 0], at[at > 0]
        with np.errstate(divide="ignore"):
            return np.log(rest)


def below(phi: np.ndarray, bound: float | np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables with locations ``phi``, conditioned to lie below ``bound``."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return np.where(np.isneginf(phi), -np.inf, phi - np.logaddexp(phi - bound, np.log(-np.log(u))))


class Remainder:
    """A unit's segmentations but for some taken ones: their mass, summed without subtraction, and exact samples."""

    def __init__(self, lattice: Lattices, row: int, taken: list[list[int]]):
        self.edge, self.ids, self.total, self.n = lattice.edges(row, slice(None)), lattice.ids[row], lattice.total[row], int(lattice.length[row])
        # the suffixes of taken paths (piece lengths, last first): position and longer suffixes by the next length
        self.nodes: list[tuple[int, dict[int, int]]] = [(self.n, {})]
        for path in taken:
            at = 0
            for size in reversed(path):
                j, more = self.nodes[at]
                if size not in more:
                    more[size] = len(self.nodes)
                    self.nodes.append((j - size, {}))
                at = more[size]
        self.left = np.full(len(self.nodes), -np.inf)
        for i in range(len(self.nodes) - 1, -1, -1):
            if self.nodes[i][0]:
                self.left[i] = np.logaddexp.reduce(self.weights(*self.nodes[i]))
        self.log_mass = float(self.left[0] - self.total[self.n])

    def weights(self, j: int, more: dict[int, int]) -> np.ndarray:
        """Log weights of the last piece's lengths before position ``j``."""
        k = min(j, self.edge.shape[1])
        below_ = self.total[j - k : j][::-1].copy()
        for size, i in more.items():
            below_[size - 1] = self.left[i]
        return self.edge[j, :k].astype(np.float64) + below_

    def sample(self, key: np.ndarray) -> tuple[np.ndarray, float]:
        """Pieces in text order and log probability in the whole lattice."""
        out, log_p, j, at, step = [], -float(self.total[self.n]), self.n, 0, 0
        while j:
            more = self.nodes[at][1] if at is not None else {}
            w = self.weights(j, more)
            c = np.cumsum(np.exp(w - w.max()))
            with np.errstate(over="ignore"):
                u = float(uniform(key + np.uint64(step) * PRIME)[0])
            k = int(np.searchsorted(c, u * c[-1]))
            out.append(self.ids[j, k])
            log_p += float(self.edge[j, k])
            j, at, step = j - k - 1, more.get(k + 1), step + 1
        return np.array(out[::-1], dtype=np.int32), min(log_p, 0.0)


class Path:
    """One sampled segmentation: which draw each unit takes, bounds of its siblings."""

    __slots__ = ("choice", "log_p", "bounds", "bound", "alternatives", "shut")

    def __init__(self, choice, log_p, bounds, bound, alternatives):
        self.choice, self.log_p, self.bounds, self.bound, self.alternatives = choice, log_p, bounds, bound, alternatives
        self.shut: dict[int, list] = {}  # unit -> other alternatives taken there


class Sampler:
    """Distinct segmentations of many texts at once."""

    def __init__(self, vocabulary: Vocabulary, samples: int = SAMPLES, seed: int = 0):
        self.v, self.k, self.seed = vocabulary, samples, seed
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.group, self.row, self.held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
        self.lattices: list[Lattices] = []
        self.widths: dict[int, int] = {}
        #: By unit: log mass of all segmentations, and of all but the best (nan: not computed yet).
        self.mass, self.rests = np.zeros(0), np.zeros(0)

    def remainder(self, unit: int, taken: list[np.ndarray]) -> Remainder:
        sizes = [[1 if i < 0 else len(self.v.text[i]) for i in x.tolist()] for x in taken]
        return Remainder(self.lattices[self.group[unit]], int(self.row[unit]), sizes)

    def log_rest(self, log_p: np.ndarray, units: np.ndarray) -> np.ndarray:
        """log(1 - p) for each unit's draw; minus infinity if there is no other."""
        rest = -np.expm1(log_p)
        out = np.log(np.maximum(rest, SMALL_MASS))
        small = np.flatnonzero(rest < SMALL_MASS)
        if len(small):
            u = units[small]  # a draw with nearly all mass is always the unit's best one
            new = np.unique(u[np.isnan(self.rests[u])])
            for g in np.unique(self.group[new]).tolist():
                own = new[self.group[new] == g]
                self.rests[own] = self.lattices[g].log_rest(self.row[own])
            out[small] = self.rests[u]
        return out

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """The units of each text by number; lattices of units not seen before are added."""
        if self.held > CACHE_CHARS:
            self.forget()
        known, old = self.known, len(self.known)
        per_doc = [list(map(known.__getitem__, UNITS.findall(self.v.normal(t)))) for t in texts]
        names = list(islice(known, old, None))
        length = np.array([len(u) for u in names], dtype=np.int64)
        self.held += int(length.sum())
        widths = np.where(length <= EXACT, length, -(-length // 8) * 8)
        group, row = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
        for w in np.unique(widths).tolist():
            at = np.flatnonzero(widths == w)
            g = self.widths.setdefault(w, len(self.lattices))
            if g == len(self.lattices):
                self.lattices.append(Lattices(self.v, w))
            group[at], row[at] = g, self.lattices[g].add([names[i] for i in at]) + np.arange(len(at))
        self.group, self.row = np.concatenate([self.group, group]), np.concatenate([self.row, row])
        self.rests = np.concatenate([self.rests, np.full(len(names), np.nan)])
        self.mass = np.concatenate([self.mass, np.zeros(len(names))])
        for g, lattice in enumerate(self.lattices):
            at = old + np.flatnonzero(group == g)
            self.mass[at] = lattice.total[self.row[at], lattice.length[self.row[at]]]
        return per_doc

    def draw(self, unit: np.ndarray, key: np.ndarray, wanted: np.ndarray | None = None):
        """Flat pieces in text order, bounds of each draw's, and log probabilities; only those ``wanted`` are drawn."""
        parts, count, log_p = [], np.zeros(len(unit), dtype=np.int64), np.full(len(unit), -1.0)
        drawn = np.arange(len(unit)) if wanted is None else np.flatnonzero(wanted)
        group = self.group[unit[drawn]].astype(np.int16)  # sorted by radix
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(len(self.lattices) + 1))
        order = drawn[order]
        for g, lattice in enumerate(self.lattices):
            at = order[cuts[g] : cuts[g + 1]]
            if len(at):
                out, count[at] = lattice.sample(self.row[unit[at]], key[at])
                parts.append((at, out))
        bounds = np.concatenate([[0], np.cumsum(count)])
        flat = np.zeros(bounds[-1], dtype=np.int32)
        for at, out in parts:
            n, to = count[at], bounds[at + 1] - 1
            for step in range(out.shape[1]):
                if step:
                    more = n > step
                    n, to, out = n[more], to[more], out[more]
                flat[to - step] = out[:, step]
        if len(drawn):
            log_p[drawn] = np.minimum(np.add.reduceat(self.v.log_weights(flat).astype(np.float64), bounds[drawn]) - self.mass[unit[drawn]], 0.0)
        return flat, bounds, log_p

    def keys(self, seeds: np.ndarray, unit_no: np.ndarray, salt: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(seeds + unit_no.astype(np.uint64) * GOLD + np.uint64(salt + 1) * np.uint64(0xD6E8FEB86659FD93))

    def __call__(self, texts: list[str], row_keys: list[str]) -> list[list[tuple[np.ndarray, float, float]]]:
        """For each text its samples: pieces, log probability, inclusion probability."""
        per_doc = self.numbers(texts)
        sizes = np.array(list(map(len, per_doc)), dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        unit = np.fromiter(chain.from_iterable(per_doc), dtype=np.int64, count=int(sizes.sum()))
        doc_seed = np.array([xxhash.xxh3_64_intdigest(k, self.seed) for k in row_keys], dtype=np.uint64)
        seeds, number = np.repeat(doc_seed, sizes), np.arange(len(unit)) - np.repeat(starts[:-1], sizes)
        draws = [self.draw(unit, self.keys(seeds, number, 0))]
        bound_draws = [uniform(self.keys(seeds, number, 1000 + j)) for j in range(self.k)]
        again = uniform(self.keys(np.repeat(doc_seed, self.k), np.tile(np.arange(self.k), len(texts)), 2000)).reshape(-1, self.k)
        roots = -np.log(-np.log(uniform(self.keys(doc_seed, np.zeros(len(texts)), 3000))))
        lp = draws[0][2]
        before = np.cumsum(lp) - lp
        before -= np.repeat(before[starts[:-1][sizes > 0]], sizes[sizes > 0])
        bounds = below(before + self.log_rest(lp, unit), np.repeat(roots, sizes), bound_draws[0])
        none = np.zeros(len(unit), dtype=np.int64)
        paths = [[Path(none[a:z], lp[a:z], bounds[a:z], float(r), {})] for a, z, r in zip(starts, starts[1:], roots, strict=False)]
        for j in range(1, self.k):
            nodes, found, pending = {}, {}, [d for d, own in enumerate(paths) if len(own) == j]
            while pending:
                tried = {}
                for d in pending:
                    best = max(((float(p.bounds.max()), i) for i, p in enumerate(paths[d]) if len(p.bounds)), default=(-np.inf, 0))
                    if best[0] > -np.inf:
                        tried[d] = (best[0], best[1], int(paths[d][best[1]].bounds.argmax()))
                got = self.others(paths, tried, starts, unit, doc_seed, draws, j)
                nodes |= {d: tried[d] for d in got}
                found |= got
                pending = [d for d in tried if d not in got]
                for d in pending:  # nothing else there: on with the next best
                    _, i, t = tried[d]
                    paths[d][i].bounds[t] = -np.inf
            wanted = np.zeros(len(unit), dtype=bool)
            for d in found:
                wanted[starts[d] + nodes[d][2] : starts[d + 1]] = True
            draws.append(self.draw(unit, self.keys(seeds, number, j), wanted))
            rests, made = self.log_rest(draws[j][2], unit), []
            for d, (bound, i, t) in nodes.items():
                p, a, z = paths[d][i], starts[d], starts[d + 1]
                ids, log_p = found[d]
                choice, lp = p.choice.copy(), p.log_p.copy()
                choice[t:], lp[t:] = j, draws[j][2][a + t : z]
                lp[t] = log_p
                head = np.cumsum(lp)
                made.append((d, p, t, ids, log_p, bound, choice, lp, head[t + 1 :] - lp[t + 1 :] + rests[a + t + 1 : z]))
            phi = np.concatenate([x[-1] for x in made]) if made else np.zeros(0)
            tails = np.array([len(x[-1]) for x in made], dtype=np.int64)
            after = np.concatenate([np.arange(starts[x[0] + 1] - len(x[-1]), starts[x[0] + 1]) for x in made]) if made else np.zeros(0, dtype=np.int64)
            tail_bounds = np.split(below(phi, np.repeat([x[5] for x in made], tails), bound_draws[j][after]), np.cumsum(tails)[:-1]) if made else []
            for (d, p, t, ids, log_p, bound, choice, lp, _), tail in zip(made, tail_bounds, strict=True):
                a = starts[d]
                bounds = np.concatenate([np.full(t + 1, -np.inf), tail])
                alternatives = {k: v for k, v in p.alternatives.items() if k < t} | {t: ids}
                paths[d].append(Path(choice, lp, bounds, bound, alternatives))
                shut = p.shut.setdefault(t, [])
                shut.append((ids, log_p))
                left = 1 - np.exp(p.log_p[t]) - sum(np.exp(x) for _, x in shut)
                log_left = np.log(left) if left >= SMALL_MASS else self.remainder(int(unit[a + t]), self.taken(p, t, draws, a)).log_mass
                location = p.log_p[:t].sum() + log_left
                p.bounds[t] = below(np.array([location]), bound, again[d, j : j + 1])[0]
        return [self.results(own, draws, starts[d]) for d, own in enumerate(paths)]

    def pieces_at(self, path: Path, t: int, draws, start: int) -> np.ndarray:
        if t in path.alternatives:
            return path.alternatives[t]
        flat, bounds, _ = draws[path.choice[t]]
        return flat[bounds[start + t] : bounds[start + t + 1]]

    def taken(self, path: Path, t: int, draws, start: int) -> list[np.ndarray]:
        return [self.pieces_at(path, t, draws, start)] + [x for x, _ in path.shut.get(t, [])]

    def others(self, paths, nodes, starts, unit, doc_seed, draws, j: int) -> dict:
        """For each node another segmentation of its unit than those taken there, by its conditional probability."""
        found, todo, few = {}, {}, {}
        for d, (_, i, t) in nodes.items():
            p = paths[d][i]
            left = 1 - np.exp(p.log_p[t]) - sum(np.exp(x) for _, x in p.shut.get(t, []))
            (few if left < SMALL_MASS else todo)[d] = nodes[d]
        for turn in range(TRIES):
            if not todo:
                break
            docs = np.array(list(todo))
            units = np.array([unit[starts[d] + todo[d][2]] for d in docs])
            key = self.keys(np.repeat(doc_seed[docs], DRAWS), np.tile(np.arange(DRAWS), len(docs)), 10_000 + TRIES * j + turn)
            flat, bounds, log_p = self.draw(np.repeat(units, DRAWS), key)
            for n, d in enumerate(docs.tolist()):
                _, i, t = todo[d]
                p = paths[d][i]
                taken = [x.tobytes() for x in self.taken(p, t, draws, starts[d])]
                for m in range(n * DRAWS, (n + 1) * DRAWS):
                    x = flat[bounds[m] : bounds[m + 1]]
                    if x.tobytes() not in taken:
                        found[d] = (x.copy(), float(log_p[m]))
                        del todo[d]
                        break
        for d, (_, i, t) in (few | todo).items():  # rare alternatives: from the lattice without the taken ones
            rest = self.remainder(int(unit[starts[d] + t]), self.taken(paths[d][i], t, draws, starts[d]))
            if rest.log_mass > -np.inf:
                found[d] = rest.sample(self.keys(doc_seed[d : d + 1], np.array([t]), 500_000 + j))
        return found

    def results(self, own: list[Path], draws, start: int):
        rest = max((float(p.bounds.max()) for p in own if len(p.bounds)), default=-np.inf)
        out = []
        for p in own:
            parts, t, n = [], 0, len(p.choice)
            for cut in [*sorted(p.alternatives), n]:
                while t < cut:  # runs of one draw
                    c = p.choice[t]
                    end = t + int(np.argmax(p.choice[t:cut] != c)) if (p.choice[t:cut] != c).any() else cut
                    flat, bounds, _ = draws[c]
                    parts.append(flat[bounds[start + t] : bounds[start + end]])
                    t = end
                if cut < n:
                    parts.append(p.alternatives[cut])
                    t = cut + 1
            ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
            if (ids < 0).any():
                ids = self.v.with_bytes(ids)
            log_p = float(p.log_p.sum())
            out.append((ids, log_p, 1.0 if rest == -np.inf else float(-np.expm1(-np.exp(log_p - rest)))))
        return out


_vocabularies: dict[tuple[str, float], Vocabulary] = {}


_samplers: dict[tuple, Sampler] = {}


def vocabulary(path: str, alpha: float = ALPHA) -> Vocabulary:
    if (path, alpha) not in _vocabularies:
        _vocabularies[path, alpha] = Vocabulary(path, alpha)
    return _vocabularies[path, alpha]


def sample_segmentations(docs: DataFrame, path: str, samples: int = SAMPLES, alpha: float = ALPHA, seed: int = 0, with_ids: bool = True) -> DataFrame:
    """doc_id, sample (from 0), n_pieces, ids_crc32 (little-endian 32 bits), log_prob, inclusion, decodes; and ids."""
    small_batches(docs.sparkSession)
    ddl = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, inclusion double, decodes boolean" + (", ids array<int>" if with_ids else "")
    schema = arrow_schema(ddl)

    def slices(texts):
        a = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > STEP:
                yield a, i
                a, size = i, 0
            size += len(t)
        if a < len(texts):
            yield a, len(texts)

    def run(batches):
        v = vocabulary(path, alpha)
        sampler = _samplers.setdefault((path, alpha, samples, seed), Sampler(v, samples, seed))  # later tasks know its lattices
        for b in batches:
            texts, names = [t or "" for t in b.column(1).to_pylist()], b.column(0).to_pylist()
            for i, j in slices(texts):
                rows = []
                for doc_id, text, found in zip(names[i:j], texts[i:j], sampler(texts[i:j], [str(x) for x in names[i:j]]), strict=True):
                    for n, (ids, log_p, inclusion) in enumerate(found):
                        row = (doc_id, n, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), log_p, inclusion, v.decode(ids) == text)
                        rows.append((*row, ids) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)
