"""Encoding into pieces of a given BPE model with seeded merge-dropout, and lossless decoding.

Merges wait in an agenda, best score first, leftmost among equals. When a candidate comes up, a hash keyed by the
seed, the whole text, the place of the stretch in it and the candidate's three borders decides whether it is skipped,
so a segmentation can be repeated anywhere and on any number of machines, while another seed, another text or another
place in the same text gives another one. Whatever is skipped, the pieces spell the text: decoding gives it back exactly.

A text is cut where no piece of the model can reach across (checked when the model is read). A bounded cache keeps of a
stretch only what no key changes: its pieces without dropout and the candidates met on the way to them. An occurrence
at whose place none of these candidates is skipped has those pieces; all others are merged anew, many at a time.
Characters that the model lacks, and the model's own mark for a space where it stands in a text, become byte pieces.

Defined cases: null gives null, the empty text no pieces; equal texts have equal pieces; other columns
pass through; with dropout 0 the pieces are those of the model's own encoder (save for its space mark).
"""

from __future__ import annotations

import heapq
import re
import sys
import types
import zlib
from dataclasses import dataclass, field
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the model lies unless a caller names another.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
DROPOUT = 0.1
#: Stretches a worker keeps at most, and places it keeps free for those of one block.
CACHE, FREE = 200_000, 1 << 16
#: Longer stretches are merged one by one with a heap.
SHORT = 48
#: Characters that are encoded together, and rows that are merged together.
BLOCK_CHARS, BLOCK_ROWS = 1 << 18, 1 << 14
_STRETCH = re.compile(r" *[^\W\d_\u00b2]+| *(?:[^\w ]|[\d_\u00b2])+| +")
_MASK = (1 << 64) - 1


@dataclass
class Vocabulary:
    """Pieces with id and score, byte pieces, and the bytes each id spells."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    spelled: list[bytes]
    cuts: bool
    cost: dict[str, float] = field(init=False)

    def __post_init__(self):
        self.cost = {piece: -score for piece, (_, score) in self.pieces.items()}


def read_model(path: str = MODEL) -> Vocabulary:
    """Read a model file on the driver; tasks get the vocabulary, not the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, spelled = {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[1:-1], 16)
            byte_ids[value] = i
            spelled.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelled.append(b"")
        else:
            pieces[piece] = (i, model.get_score(i))
            spelled.append(piece.replace(MARK, " ").encode())
    cuts = all(len(_STRETCH.findall(p.replace(MARK, " "))) == 1 for p in pieces)
    return Vocabulary(pieces, byte_ids, spelled, cuts)


_A, _B, _C, _PLACE, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD1B54A32D192ED03, 0xD6E8FEB86659FD93


def _skipped(base: int, a: int, b: int, c: int, limit: int) -> bool:
    h = (base + a * _A + b * _B + c * _C) & _MASK
    return (((h ^ (h >> 32)) * _MIX) & _MASK) >> 32 < limit


def text_key(text: str, seed: int) -> int:
    """What the skips of a text depend on besides their places."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, key=f"{seed}".encode()).digest(), "little")


def place_key(key: int, place: int) -> int:
    """The same for the stretch at a place (0, 1, ...) of the text."""
    h = (key + (place + 1) * _PLACE) & _MASK
    h = ((h ^ (h >> 32)) * _MIX) & _MASK
    return h ^ (h >> 29)


def segment(vocabulary: Vocabulary, text: str, dropout: float, base: int) -> list[int]:
    """Ids of one stretch (spaces already as marks); ``base`` is its place key."""
    limit = int(dropout * (1 << 32))
    parts = _merged(vocabulary, text, base, limit) if len(text) <= SHORT else _merged_long(vocabulary, text, base, limit)
    out = []
    for part in parts:
        found = vocabulary.pieces.get(part)
        if found is not None:
            out.append(found[0])
        else:
            out.extend(vocabulary.byte_ids[x] for x in part.encode("utf-8", "surrogatepass"))
    return out


def _merged(vocabulary: Vocabulary, text: str, base: int, limit: int) -> list[str]:
    """The agenda of a short stretch is a list in the order of the text."""
    cost, none = vocabulary.cost, 1e30
    parts, borders = list(text), list(range(len(text) + 1))
    agenda = [cost.get(x + y, none) for x, y in zip(parts, parts[1:])]
    while agenda:
        best = min(agenda)
        if best == none:
            break
        i = agenda.index(best)
        if limit and _skipped(base, borders[i], borders[i + 1], borders[i + 2], limit):
            agenda[i] = none
            continue
        joined = parts[i] + parts[i + 1]
        parts[i : i + 2] = [joined]
        del borders[i + 1], agenda[i]
        if i < len(agenda):
            agenda[i] = cost.get(joined + parts[i + 1], none)
        if i:
            agenda[i - 1] = cost.get(parts[i - 1] + joined, none)
    return parts


def _merged_long(vocabulary: Vocabulary, text: str, base: int, limit: int) -> list[str]:
    """The same with a heap, for stretches of any length."""
    cost, n = vocabulary.cost, len(text)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    agenda: list[tuple[float, int, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if b < n and (found := cost.get(text[a : end[b]])) is not None:
            heapq.heappush(agenda, (found, a, b, end[b]))

    for a in range(n - 1):
        offer(a)
    while agenda:
        _, a, b, c = heapq.heappop(agenda)
        if not (alive[a] and alive[b] and end[a] == b and end[b] == c):
            continue  # one of the two has merged meanwhile
        if limit and _skipped(base, a, b, c, limit):
            continue
        alive[b], end[a] = False, c
        if c < n:
            before[c] = a
            offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, a = [], 0
    while a < n:
        out.append(text[a : end[a]])
        a = end[a]
    return out


class _Merges:
    """The model as arrays: symbols are numbers (pieces first, then characters that are no piece), and a table of
    pairs gives the rank and the symbol of their merge."""

    WIDTH, BITS, EMPTY, NONE = 1 << 21, 19, -(1 << 62), np.iinfo(np.int32).max

    def __init__(self, vocabulary: Vocabulary):
        names = list(vocabulary.pieces)
        number = {p: i for i, p in enumerate(names)}
        self.n, self.byte_ids = len(names), np.array(vocabulary.byte_ids, np.int32)
        self.piece = np.array([vocabulary.pieces[p][0] for p in names], np.int32)
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.n
        for p, i in number.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[32] = self.symbol[ord(MARK)]
        rank = np.unique([vocabulary.cost[p] for p in names], return_inverse=True)[1]
        of = lambda x: number.get(x, self.n + ord(x) if len(x) == 1 else -1)
        pairs = [(x * self.WIDTH + y, i) for p, i in number.items() for k in range(1, len(p)) if (x := of(p[:k])) >= 0 and (y := of(p[k:])) >= 0]
        while len(pairs) * 4 > 1 << self.BITS:
            self.BITS += 1
        size = 1 << self.BITS
        self.key, self.rank, self.into = np.full(size, self.EMPTY), np.full(size, self.NONE, np.int32), np.zeros(size, np.int32)
        home = self._home(np.array([k for k, _ in pairs], np.int64)).tolist()
        taken = [False] * size
        for (k, i), h in zip(pairs, home):
            while taken[h]:
                h = (h + 1) & (size - 1)
            taken[h], self.key[h], self.rank[h], self.into[h] = True, k, rank[i], i

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(_A)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def pairs(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if they do not merge) and merged symbol of neighbours; -1 stands for no neighbour."""
        key = x * np.int64(self.WIDTH) + y
        at = self._home(key)
        got = self.key[at]
        rest = np.flatnonzero((got != key) & (got != self.EMPTY))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.key) - 1)
            got = self.key[at[rest]]
            rest = rest[(got != key[rest]) & (got != self.EMPTY)]
        return np.where(self.key[at] == key, self.rank[at], self.NONE), self.into[at]

    def merge(self, symbols: np.ndarray, lengths: np.ndarray, base: np.ndarray | None, limit: int):
        """Merge many short stretches at a time, laid end to end. Gives (symbols, their counts, candidates, their counts);
        candidates are the borders as ``_skipped`` sums them, and are listed only where nothing is skipped (no ``base``)."""
        n, starts = len(lengths), np.cumsum(lengths) - lengths
        counts, marks = np.zeros(n, np.int64), np.zeros(n, np.int64)
        order = np.argsort(lengths, kind="stable")
        parts, seen = [], []
        for at in range(0, n, BLOCK_ROWS):
            rows = order[at : at + BLOCK_ROWS]
            out, count, trace, of = self._block(symbols, starts[rows], lengths[rows], None if base is None else base[rows], limit)
            counts[rows] = count
            parts.append(out)
            if base is None:
                marks[rows] = np.bincount(of, minlength=len(rows))
                seen.append(trace[np.argsort(of, kind="stable")])
        join = lambda found, kind: np.concatenate(found) if found else np.zeros(0, kind)
        return (
            _reordered(join(parts, np.int64), counts, order), counts,
            _reordered(join(seen, np.uint64), marks, order) if base is None else None, marks,
        )

    def _block(self, symbols, starts, lengths, base, limit):
        n, width = len(lengths), int(lengths.max()) + 1  # the last column stays empty
        place = np.arange(width)
        inside = place < lengths[:, None]
        sym = np.where(inside, symbols[np.minimum(starts[:, None] + place, len(symbols) - 1)], -1).astype(np.int64)
        rank = np.full((n, width), self.NONE, np.int32)
        rank[:, :-1] = self.pairs(sym[:, :-1].ravel(), sym[:, 1:].ravel())[0].reshape(n, -1)
        grid, sym, rank, alive = rank, sym.ravel(), rank.ravel(), inside.ravel().copy()
        end, before = np.tile(place + 1, n), np.tile(place - 1, n)
        rows, traces, owners = np.arange(n), [], []
        while len(rows):
            sub = grid[rows]
            a = sub.argmin(1)
            ok = sub[np.arange(len(rows)), a] != self.NONE
            rows, a = rows[ok], a[ok]
            line = rows * width
            fa = line + a
            b = end[fa]
            c = end[line + b]
            rank[fa] = self.NONE
            h = a.astype(np.uint64) * np.uint64(_A) + b.astype(np.uint64) * np.uint64(_B) + c.astype(np.uint64) * np.uint64(_C)
            if base is None:
                traces.append(h)
                owners.append(rows)
                who = rows
            else:
                go = ~_skips(h + base[rows], limit)
                who, line, fa, a, b, c = rows[go], line[go], fa[go], a[go], b[go], c[go]
            fb, fc = line + b, line + c
            merged = self.pairs(sym[fa], sym[fb])[1]
            sym[fa], end[fa], before[fc], alive[fb], rank[fb] = merged, c, a, False, self.NONE
            left = a > 0
            fp = (line + before[fa])[left]
            rank[np.concatenate([fa, fp])] = self.pairs(np.concatenate([sym[fa], sym[fp]]), np.concatenate([sym[fc], sym[fa[left]]]))[0]
        count = alive.reshape(n, width).sum(1)
        if base is not None:
            return sym[alive], count, None, None
        return sym[alive], count, np.concatenate(traces) if traces else np.zeros(0, np.uint64), np.concatenate(owners) if owners else np.zeros(0, np.int64)

    def ids(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of symbols, bytes for characters that are no piece, and how many each stretch has."""
        odd = np.flatnonzero(symbols >= self.n)
        if not len(odd):
            return self.piece[symbols], counts
        wide = np.ones(len(symbols), np.int64)
        spelled = [chr(x).encode("utf-8", "surrogatepass") for x in (symbols[odd] - self.n).tolist()]
        wide[odd] = [len(x) for x in spelled]
        starts = np.cumsum(wide) - wide
        out = np.zeros(int(wide.sum()), np.int32)
        plain = symbols < self.n
        out[starts[plain]] = self.piece[symbols[plain]]
        out[_ranges(starts[odd], wide[odd])] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return out, _sums(wide, counts)


def _skips(h: np.ndarray, limit: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) * np.uint64(_MIX)) >> np.uint64(32) < np.uint64(limit)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lengths[0] of them), then those of starts[1], and so on."""
    first = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - first, lengths)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values``, ``counts`` long each."""
    total, ends = np.concatenate([[0], np.cumsum(values)]), np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _reordered(values: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Runs that lie in the ``order`` of their owners, in the owners' own order; ``counts`` are by owner."""
    laid = counts[order]
    starts = np.zeros(len(counts), np.int64)
    starts[order] = np.cumsum(laid) - laid
    return values[_ranges(starts, counts)]


class _Runs:
    """Runs of numbers end to end, with room to grow."""

    def __init__(self, kind):
        self.data, self.starts, self.counts, self.used, self.n = np.zeros(1024, kind), np.zeros(1024, np.int64), np.zeros(1024, np.int32), 0, 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        for name, more in (("data", self.used + len(values)), ("starts", self.n + len(counts)), ("counts", self.n + len(counts))):
            if (old := getattr(self, name)).size < more:
                setattr(self, name, np.concatenate([old, np.zeros(max(more - old.size, old.size // 2), old.dtype)]))
        self.data[self.used : self.used + len(values)] = values
        self.starts[self.n : self.n + len(counts)] = self.used + np.cumsum(counts) - counts
        self.counts[self.n : self.n + len(counts)] = counts
        self.used, self.n = self.used + len(values), self.n + len(counts)


class Encoder:
    """Texts to ids, for one seed."""

    def __init__(self, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = 0):
        self.vocabulary, self.dropout, self.seed, self.limit = vocabulary, dropout, seed, int(dropout * (1 << 32))
        self.merges = _Merges(vocabulary)
        self._forget()

    def _forget(self) -> None:
        """Empty the cache but for the mark of a space, which is spelled in bytes."""
        self.known = {MARK: 0}
        self.symbols, self.ids, self.candidates = _Runs(np.int32), _Runs(np.int32), _Runs(np.uint64)
        mark = self.merges.byte_ids[list(MARK.encode())]
        for runs, values in ((self.symbols, mark[:0]), (self.ids, mark), (self.candidates, np.zeros(0, np.uint64))):
            runs.add(values, np.array([len(values)]))

    def _learn(self, stretches: list[str]) -> None:
        codes = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols, lengths = self.merges.symbol[codes], np.array([len(s) for s in stretches])
        merged, counts, seen, n_seen = self.merges.merge(symbols, lengths, None, 0)
        self.known.update(zip(stretches, range(self.ids.n, self.ids.n + len(stretches))))
        self.symbols.add(symbols, lengths)
        self.ids.add(*self.merges.ids(merged, counts))
        self.candidates.add(seen, n_seen)

    def _stretches(self, text: str) -> list[str]:
        out = []
        for i, part in enumerate((" " + text).split(MARK)):
            if i:
                out.append(MARK)
            out += _STRETCH.findall(part) if self.vocabulary.cuts else [part] if part else []
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        values, counts, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= BLOCK_CHARS):
                size += len(texts[stop] or "")
                stop += 1
            found = self._encode_block(texts[at:stop])
            values.append(found[0])
            counts.append(found[1])
            at = stop
        return np.concatenate(values), np.concatenate(counts)

    def _encode_block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) + FREE > CACHE:
            self._forget()
        stretches, per_text = [], []
        for t in texts:
            own = self._stretches(t) if t else []
            stretches += own
            per_text.append(len(own))
        per_text = np.array(per_text, np.int64)
        node = np.fromiter(map(self.known.get, stretches, repeat(-1)), np.int64, len(stretches))
        new = np.flatnonzero(node < 0).tolist()
        if new:
            short = list(dict.fromkeys(s for i in new if len(s := stretches[i]) <= SHORT))[: CACHE - len(self.known)]
            if short:  # what finds no place is merged one by one, like the longer ones
                self._learn(short)
                node[new] = [self.known.get(stretches[i], -1) for i in new]
        long = np.flatnonzero(node < 0)
        home = np.maximum(node, 0)
        starts, lengths = self.ids.starts[home], self.ids.counts[home].astype(np.int64)
        sources, used = [self.ids.data[: self.ids.used]], self.ids.used
        base = None
        if self.limit:
            keys = np.array([text_key(t, self.seed) if t else 0 for t in texts], np.uint64)
            place = _ranges(np.zeros(len(texts), np.int64), per_text)
            h = np.repeat(keys, per_text) + (place + 1).astype(np.uint64) * np.uint64(_PLACE)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX)
            base = h ^ (h >> np.uint64(29))
            met = self.candidates.counts[home].astype(np.int64)
            skipped = _skips(self.candidates.data[_ranges(self.candidates.starts[home], met)] + np.repeat(base, met), self.limit)
            redo = np.flatnonzero((_sums(skipped, met) > 0) & (node >= 0))
            if len(redo):
                n = self.symbols.counts[node[redo]].astype(np.int64)
                symbols = self.symbols.data[_ranges(self.symbols.starts[node[redo]], n)]
                ids, n = self.merges.ids(*self.merges.merge(symbols, n, base[redo], self.limit)[:2])
                starts[redo], lengths[redo] = used + np.cumsum(n) - n, n
                sources.append(ids)
                used += len(ids)
        for i in long.tolist():
            ids = np.array(segment(self.vocabulary, stretches[i].replace(" ", MARK), self.dropout, int(base[i]) if self.limit else 0), np.int32)
            starts[i], lengths[i] = used, len(ids)
            sources.append(ids)
            used += len(ids)
        return np.concatenate(sources)[_ranges(starts, lengths)], _sums(lengths, per_text)


def _kept(name: tuple, make):
    """The encoder of this worker process, so that its caches outlive a task; one at a time is kept."""
    holder = sys.modules.setdefault("_frameloom_pieces", types.ModuleType("_frameloom_pieces"))
    if getattr(holder, "name", None) != name:
        holder.name, holder.encoder = name, make()
    return holder.encoder


def decode(vocabulary: Vocabulary, ids: np.ndarray | list[int]) -> str:
    """The text that the ids spell."""
    return b"".join([vocabulary.spelled[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


def encode_column(vocabulary: Vocabulary, text: Column, dropout: float = DROPOUT, seed: int = 0) -> Column:
    """Ids of every text, as array<int>."""
    name = (zlib.crc32(repr(sorted(vocabulary.pieces.items())).encode()), dropout, seed)

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        encoder = _kept(name, lambda: Encoder(vocabulary, dropout, seed))
        values, counts = encoder.encode_all(texts.to_pylist())
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=texts.is_null() if texts.null_count else None)

    return encoded.asNondeterministic()(text)


def decode_column(vocabulary: Vocabulary, ids: Column) -> Column:
    """The text of every array of ids."""
    spelled = np.array([*vocabulary.spelled, b""], object)

    @F.arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        offsets, values = np.asarray(lists.offsets), np.asarray(lists.values)
        out = []
        for i in range(len(lists)):
            if not lists[i].is_valid:
                out.append(None)
            else:
                out.append(b"".join(spelled[values[offsets[i] : offsets[i + 1]]].tolist()).decode("utf-8", "surrogatepass")[1:])
        return pa.array(out, pa.string())

    return decoded.asNondeterministic()(ids)


def round_trip_column(vocabulary: Vocabulary, text: Column, dropout: float = DROPOUT, seed: int = 0) -> Column:
    """struct<ids, lossless>: the ids of every text, and whether they decode to it. One worker does both."""
    name = (zlib.crc32(repr(sorted(vocabulary.pieces.items())).encode()), dropout, seed)

    @F.arrow_udf("struct<ids: array<int>, lossless: boolean>")
    def told(texts: pa.Array) -> pa.Array:
        encoder = _kept(name, lambda: Encoder(vocabulary, dropout, seed))
        own = texts.to_pylist()
        values, counts = encoder.encode_all(own)
        ends = np.concatenate([[0], np.cumsum(counts)])
        spelled = encoder.vocabulary.spelled
        same = []
        for t, a, b in zip(own, ends[:-1].tolist(), ends[1:].tolist()):
            # the text behind a space, which is the model's own mark of a beginning; no text has no piece
            want = b" " + t.encode("utf-8", "surrogatepass") if t else b""
            same.append(t is None or b"".join(map(spelled.__getitem__, values[a:b].tolist())) == want)
        mask = texts.is_null() if texts.null_count else None
        ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values), mask=mask)
        return pa.StructArray.from_arrays([ids, pa.array(same)], ["ids", "lossless"])

    return told.asNondeterministic()(text)
