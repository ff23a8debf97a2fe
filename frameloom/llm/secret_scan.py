"""Secret scan: exact patterns, and a linear-chain conditional random field that adds spans of its own.

The field tags every token of a line as begin, inside or outside of a secret from its shape, its neighbours
and features of the file, and is decoded by Viterbi over the whole text. It is trained in numpy on a bounded, keyed sample of
different texts: those with a pattern's span, those without, and the latter once more with secrets planted that no pattern names
(prefixed and mixed keys, bearer tokens, passwords in connections and in prose) beside look-alikes that are none (dates, numbers, links,
identifiers). Context or shape is hidden in part of the training windows, so each must be able to stand alone.
Pattern spans always stay; a span of the field goes only where they cover all of it.

Decoding is exact but not done token by token: where outside beats the other tags by more than all transitions
can make good, the best path is outside whatever stands around, so only the tokens between such points
are decoded.

Defined cases: a null or empty text has no spans; offsets count code points, ends are exclusive; repeated
rows fare alike; very long texts are read whole, and a training text gives windows from all its length; other columns pass
through; a table where no pattern is found, an empty one too, trains no field.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.store import stored
from frameloom.llm.words import blocks, buffers, run_hashes

#: Texts the field is trained on, at most: half of them with a secret, half without.
SAMPLE_TEXTS = 3000
#: Tokens of a training window, and windows with and without a secret, at most; half of those without hold a long token with digits.
TRAIN_LENGTH, TRAIN_WINDOWS = 48, 2000
KINDS = ("assign", "access", "hex", "crf")
SPANS = "array<struct<kind:string,start:long,end:long>>"
# fixed values
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_KEYS = (
    "password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "key", "auth", "bearer", "credential", "authorization",
    "passphrase", "credentials", "api-key", "access_key", "private_key",
)
#: One in so many clean words of a training text is followed by something planted, and no text gets more than ``PLANTS``.
PLANT_EVERY, PLANTS = 60, 12

# bytes: white space 0, parts of words 1, other characters 2
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[[ord(c) for c in "+/_-"]] = 1
_CLASS[128:] = 1
# what a token contains
_A_TO_F, _LOWER, _UPPER, _DIGIT, _SIGN, _OTHER, _MARK = 1, 2, 4, 8, 16, 32, 64
_FLAG = np.zeros(256, np.uint8)
_FLAG[97:103], _FLAG[103:123], _FLAG[65:91], _FLAG[48:58] = _A_TO_F, _LOWER, _UPPER, _DIGIT
_FLAG[[ord(c) for c in "+/_-"]] = _SIGN
_FLAG[128:] = _OTHER
_FLAG[(_CLASS == 2)] = _MARK


def _shape(flags: int) -> int:
    """Twelve kinds of token by the characters in it."""
    lower, digit, upper, sign = flags & 3, flags & _DIGIT, flags & _UPPER, flags & _SIGN
    if flags & _MARK:
        return 0
    if flags & _OTHER:
        return 1
    if not digit:
        return 2 if sign else 3 if lower and not upper else 4 if lower else 5
    if sign:
        return 6
    if not lower and not upper:
        return 7
    if not upper:
        return 8 if not flags & _LOWER else 9
    return 10 if not lower else 11


_SHAPE = np.array([_shape(f) for f in range(128)], np.int64)
_LENGTHS = np.array([4, 8, 12, 16, 24, 40])
#: Category of a token as a neighbour: mark kinds by their byte, words by shape.
_MARK_KIND = np.full(256, 4, np.int64)
_MARK_KIND[ord(":")], _MARK_KIND[ord("=")], _MARK_KIND[ord('"')], _MARK_KIND[ord("'")] = 1, 2, 3, 3
_NEAR = 17  # line edge, four mark kinds, twelve shapes
#: How often a token changes between lower case, capitals, digits and signs.
_TURNS = np.array([1, 2, 4, 7, 11])
_SIZES = (12 * 7, _NEAR, _NEAR, len(_KEYS) + 1, 4, 3 * (len(_TURNS) + 1), len(_KEYS) + 1)
_OFFSETS = np.concatenate([[0], np.cumsum(_SIZES)])


def _key_hashes() -> np.ndarray:
    data, at = buffers(pa.array(_KEYS))
    return run_hashes(data, at[:-1], at[1:])


_KEY_HASH = _key_hashes()
_KEY_ORDER = np.argsort(_KEY_HASH)
_KEY_SIZES = np.unique([len(k) for k in _KEYS])
_CASE = np.select([_FLAG & 3 > 0, _FLAG == _UPPER, _FLAG == _DIGIT], [1, 2, 3], 0).astype(np.int8)


def _key_number(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 and up for tokens that are a key in any letter case, else 0."""
    out = np.zeros(len(starts), np.int64)
    like = np.flatnonzero(np.isin(ends - starts, _KEY_SIZES))
    if len(like):
        found = run_hashes(data, starts[like], ends[like])
        at = np.minimum(np.searchsorted(_KEY_HASH[_KEY_ORDER], found), len(_KEYS) - 1)
        out[like] = np.where(_KEY_HASH[_KEY_ORDER][at] == found, _KEY_ORDER[at] + 1, 0)
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Tokens of a block of texts: places, first of a line, text number and seven features each."""
    kind = _CLASS[data]
    first, last = kind > 0, kind > 0
    same = (kind[1:] == kind[:-1]) & (kind[1:] == 1)
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    same[edge - 1] = False
    first[1:] &= ~same
    last[:-1] &= ~same
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return {"starts": starts}
    flags = np.bitwise_or.reduceat(_FLAG[data], starts)
    shape = _SHAPE[flags]
    text = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.concatenate([np.flatnonzero((data == 10) | (data == 13)), edge])
    head = np.zeros(len(starts), bool)
    head[0] = True
    at = np.searchsorted(starts, np.sort(breaks))
    head[at[at < len(starts)]] = True
    mark = np.where(shape == 0, _MARK_KIND[data[starts]], 0)
    near = np.where(shape == 0, mark, shape + 4)
    before, after = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    before[1:] = np.where(head[1:], 0, near[:-1])
    after[:-1] = np.where(head[1:], 0, near[1:])
    # the name this token is assigned to: key, mark, token with at most two quotes between them
    key, is_key = np.zeros(len(starts), np.int64), _key_number(data, starts, ends)
    signs = np.flatnonzero((mark == 1) | (mark == 2))
    line = np.cumsum(head)
    for back in (1, 2):
        owner = signs - back
        fine = (owner >= 0) & (is_key[owner] > 0) & (line[owner] == line[signs])
        if back == 2:
            fine &= mark[signs - 1] == 3
        owner, of = owner[fine], signs[fine]
        for ahead in (1, 2):
            to = of + ahead
            ok = to < len(starts)
            if ahead == 2:
                ok &= mark[np.minimum(of + 1, len(starts) - 1)] == 3
            ok[ok] &= line[to[ok]] == line[of[ok]]
            key[to[ok]] = is_key[owner[ok]]
    # a key one or two tokens before, with or without a mark
    close = np.zeros(len(starts), np.int64)
    for back in (2, 1):
        same_line = line[back:] == line[:-back]
        close[back:] = np.where(same_line & (is_key[:-back] > 0), is_key[:-back], close[back:])
    case = _CASE[data]
    changes = np.cumsum(np.r_[0, case[1:] != case[:-1]])
    turns = changes[ends - 1] - changes[starts]
    size = np.searchsorted([12, 24], ends - starts, "right")
    marks = np.bincount(text, shape == 0, len(offsets) - 1) / np.maximum(np.bincount(text, minlength=len(offsets) - 1), 1)
    named = np.bincount(text, key > 0, len(offsets) - 1) > 0
    file = (marks > 0.25) * 2 + named
    features = np.stack([
        shape * 7 + np.searchsorted(_LENGTHS, ends - starts, "right"), before, after, key, file[text].astype(np.int64),
        size * (len(_TURNS) + 1) + np.searchsorted(_TURNS, turns, "right"), close,
    ]) + _OFFSETS[:-1, None]
    return {"starts": starts, "ends": ends, "head": head, "text": text, "features": features}


@dataclass
class Field:
    """Weights of a linear chain: emission by feature and tag, and tag to tag (outside, begin, inside)."""

    emission: np.ndarray
    move: np.ndarray


def viterbi(score: np.ndarray, head: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best tags of sequences laid end to end; ``head`` marks the first token of each."""
    n = len(score)
    out = np.zeros(n, np.int8)
    other = np.array([[move[a, s] + move[s, b] - move[a, 0] - move[0, b] for a in range(3) for b in range(3)] for s in (1, 2)]).max()
    ends = np.array([move[a, s] - move[a, 0] for s in (1, 2) for a in range(3)] + [move[s, b] - move[0, b] for s in (1, 2) for b in range(3)]).max()
    sure = score[:, 0] - score[:, 1:].max(1) > max(other, ends, 0) + 1e-9
    # a piece: tokens between sure points; the sure ones beside it are its fixed ends
    unsure = np.flatnonzero(~sure)
    if not len(unsure):
        return out
    cut = np.r_[True, (np.diff(unsure) > 1) | head[unsure[1:]]]
    begin = unsure[cut]
    length = np.diff(np.r_[np.flatnonzero(cut), len(unsure)])
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    stop = begin + length
    value = score[begin] + np.where(head[begin][:, None], 0, move[0][None, :])
    back = [np.zeros((len(begin), 3), np.int8)]
    final = np.zeros((len(begin), 3))
    for step in range(int(length[0])):
        if step:
            active = int(np.searchsorted(-length, -step, "left"))
            path = value[:active, :, None] + move[None]
            back.append(path.argmax(1).astype(np.int8))
            value = path.max(1) + score[begin[:active] + step]
        done = length == step + 1
        final[done] = value[done[: len(value)]] if len(value) < len(done) else value[done]
    closed = (stop < n) & ~head[np.minimum(stop, n - 1)]
    tag = (final + np.where(closed[:, None], move[:, 0][None, :], 0)).argmax(1)
    for step in range(int(length[0]) - 1, -1, -1):
        active = np.flatnonzero(length > step)
        out[begin[active] + step] = tag[active]
        if step:
            tag[active] = back[step][active, tag[active]]
    return out


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes of what the patterns find."""
    found = []
    if b":" in text or b"=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


def _value_spans(text: bytes) -> list[tuple[int, int]]:
    """The secret itself, without the name it is assigned to."""
    found = [m.span(2) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    return found + [m.span() for m in _ACCESS.finditer(text)] + [m.span() for m in _HEX.finditer(text)]


def _drawn(rng: np.random.Generator, letters: str, low: int, high: int) -> str:
    return "".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(low, high + 1))))


_MIXED, _WORD = string.ascii_letters + string.digits, string.ascii_lowercase


def secret_like(rng: np.random.Generator) -> tuple[str, str, str]:
    """Text before, a secret, text after."""
    pick = lambda *of: of[int(rng.integers(len(of)))]
    name = pick(*_KEYS)
    name = pick(name, name.upper(), name.capitalize())
    kind = int(rng.integers(6))
    if kind == 0:  # a prefix that names the issuer
        parts = [_drawn(rng, _WORD, 2, 6) for _ in range(int(rng.integers(1, 3)))]
        sign = pick("_", "-")
        return pick("", name + ": ", name + "="), sign.join([*parts, _drawn(rng, _MIXED, 16, 44)]), ""
    if kind == 1:  # a name and its value
        return name + pick(":", "=", " = ", ": ", ': "', " "), _drawn(rng, _MIXED, 12, 24) + _drawn(rng, _MIXED + "+/_-", 0, 8), ""
    if kind == 2:  # bearer token of one to three parts
        parts = [_drawn(rng, _MIXED + "_-", 18, 48) for _ in range(int(rng.integers(1, 4)))]
        return pick("", "Authorization: ", "authorization=") + pick("Bearer ", "bearer "), "e" + ".".join(parts), ""
    if kind == 3:  # password inside a connection
        secret = _drawn(rng, _MIXED, 8, 20)
        return f"{_drawn(rng, _WORD, 4, 8)}://{_drawn(rng, _WORD, 3, 8)}:", secret, f"@{_drawn(rng, _WORD, 3, 9)}.{_drawn(rng, _WORD, 2, 3)}/{_drawn(rng, _WORD, 2, 6)}"
    if kind == 4:  # password in prose
        word = _drawn(rng, _WORD, 4, 8).capitalize() + _drawn(rng, string.digits, 1, 3) + _drawn(rng, _MIXED, 2, 5)
        return name + pick(" is ", ": ", "=", " "), word + pick("&", "!", "#", "$") + _drawn(rng, _MIXED, 1, 3), ""
    return "", _drawn(rng, _MIXED + pick("", "+/"), 20, 48) + pick("", "", "="), ""


def look_alike(rng: np.random.Generator) -> str:
    """What is no secret, though it has digits, length or a name before it."""
    pick = lambda *of: of[int(rng.integers(len(of)))]
    digits = lambda low, high: _drawn(rng, string.digits, low, high)
    word = lambda: _drawn(rng, _WORD, 2, 10)
    kind = int(rng.integers(7))
    if kind == 0:
        return f"{digits(4, 4)}-{digits(2, 2)}-{digits(2, 2)}" + pick("", f"T{digits(2, 2)}:{digits(2, 2)}:{digits(2, 2)}Z")
    if kind == 1:
        return pick("+", "") + pick(" ", "-", "").join(digits(2, 4) for _ in range(int(rng.integers(3, 6))))
    if kind == 2:
        return f"https://{word()}.{word()}/" + pick("/", "-").join(word() for _ in range(3)) + pick("", digits(1, 5), f"?{word()}={digits(1, 4)}")
    if kind == 3:
        return pick("_", "-", "").join(pick(word(), word().capitalize()) for _ in range(3)) + pick("", digits(1, 3))
    if kind == 4:
        return pick(*_KEYS) + pick(": ", " = ", " is ", " ") + word()
    if kind == 5:
        return _drawn(rng, string.ascii_uppercase, 2, 2) + digits(2, 2) + "".join(" " + digits(4, 4) for _ in range(4))
    return f"v{digits(1, 2)}.{digits(1, 2)}.{digits(1, 2)}" + pick("", f"-{word()}{digits(1, 2)}")


def planted(text: str, seed: int = 1) -> tuple[bytes, list[tuple[int, int]]]:
    """A text with secrets and look-alikes behind some of its spaces, and the secrets' places in bytes."""
    raw = text.encode()
    rng = np.random.default_rng([seed, zlib.crc32(raw)])
    n = min(PLANTS, 2 + raw.count(b" ") // PLANT_EVERY)
    spots = sorted({raw.find(b" ", int(x)) for x in rng.integers(0, len(raw) + 1, n)} - {-1}) or [len(raw)]
    parts, spans, at, size = [], [], 0, 0

    def put(piece: bytes) -> None:
        nonlocal size
        parts.append(piece)
        size += len(piece)

    for spot in spots:
        put(raw[at:spot] + b" ")
        at = spot
        if rng.random() < 0.6:
            before, secret, after = (x.encode() for x in secret_like(rng))
            put(before)
            spans.append((size, size + len(secret)))
            put(secret + after)
        else:
            put(look_alike(rng).encode())
    put(raw[at:])
    return b"".join(parts), spans


def likelihood(emission: np.ndarray, move: np.ndarray, kinds: np.ndarray, of: np.ndarray, y: np.ndarray, inside: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of windows and its gradient by emission and move, by scaled forward and backward sums.

    kinds: the features of every kind of token; of: kind by window and place; y: tags; inside: places that a window has.
    """
    length = of.shape[1]
    one = np.eye(3)[y] * inside[..., None]
    score = emission[kinds].sum(1)[of]
    most = score.max(2)
    value, step = np.exp(score - most[..., None]), np.exp(move)
    alpha, beta, scale = np.zeros_like(score), np.ones_like(score), np.ones(score.shape[:2])
    for k in range(length):
        new = (alpha[:, k - 1] @ step if k else 1.0) * value[:, k]
        total = new.sum(1)
        on = inside[:, k]
        scale[on, k] = total[on]
        alpha[:, k] = np.where(on[:, None], new / total[:, None], alpha[:, k - 1])
    pair = np.zeros((3, 3))
    for k in range(length - 2, -1, -1):
        on = inside[:, k + 1, None]
        ahead = value[:, k + 1] * beta[:, k + 1] / scale[:, k + 1, None] * on
        pair += step * (alpha[:, k].T @ ahead)
        beta[:, k] = np.where(on, ahead @ step.T, 1.0)
    delta = (one - alpha * beta * inside[..., None]).reshape(-1, 3)
    by_kind = np.stack([np.bincount(of.ravel(), delta[:, s], len(kinds)) for s in range(3)])
    by_emission = np.stack([sum(np.bincount(f, d, len(emission)) for f in kinds.T) for d in by_kind], 1)
    gold = np.einsum("nla,nlb->ab", one[:, :-1], one[:, 1:])
    told = (one * score).sum() + (gold * move).sum() - np.log(scale).sum() - (most * inside).sum()
    return float(told), by_emission, gold - pair


def _labelled(texts: list[str | None], seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, tags, heads) of the texts and, for those without a pattern, of their planted copies, block by block."""

    def tagged(part: np.ndarray, at: np.ndarray, spans: list[list[tuple[int, int]]]):
        t = tokens(part, at)
        tag = np.zeros(len(t["starts"]), np.int64)
        for i, own in enumerate(spans if len(tag) else []):
            for s, e in own:
                lo = np.searchsorted(t["ends"], s + at[i], "right")
                hi = np.searchsorted(t["starts"], e + at[i], "left")
                tag[lo:hi] = 2
                tag[lo : lo + 1] = 1
        if len(tag):
            yield t["features"].astype(np.int16), tag, t["head"]

    data, offsets = buffers(pa.array(texts, pa.string()))
    for a, b in blocks(offsets, 1 << 20):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        spans = [_value_spans(part[at[i] : at[i + 1]].tobytes()) for i in range(b - a)]
        yield from tagged(part, at, spans)
        made = [planted(text, seed) for text, own in zip(texts[a:b], spans) if text and not own]
        if made:
            more, heads = buffers(pa.array([t for t, _ in made], pa.binary()))
            # what a pattern finds in a planted text is a secret too; the planted places win
            both = [own + [v for v in _value_spans(t) if not any(v[0] < e and s < v[1] for s, e in own)] for t, own in made]
            yield from tagged(more, heads, both)


def fit(texts: list[str | None], seed: int = 1, steps: int = 160) -> Field | None:
    """Maximum likelihood by Adam over windows of tokens, half of them with a secret where there are enough."""
    if not any(base_spans(t.encode()) for t in texts if t):
        return None
    rng = np.random.default_rng(seed)
    feats, tags, heads = zip(*_labelled(texts, seed))
    feats, tags, heads = np.concatenate(feats, 1), np.concatenate(tags), np.concatenate(heads)
    lines = np.flatnonzero(heads)
    begin = np.concatenate([np.arange(a, b, TRAIN_LENGTH) for a, b in zip(lines, np.r_[lines[1:], len(tags)])])
    stop = np.minimum(begin + TRAIN_LENGTH, np.r_[begin[1:], len(tags)])
    secret = np.add.reduceat(tags > 0, begin) > 0
    shape, length = np.divmod(feats[0], 7)
    hard = np.add.reduceat((shape >= 6) & (length >= 2), begin) > 0
    with_, plain, odd = (rng.permutation(np.flatnonzero(w)) for w in (secret, ~secret & ~hard, ~secret & hard))
    odd = odd[: max(TRAIN_WINDOWS // 2, TRAIN_WINDOWS - len(plain))]
    rows = np.concatenate([with_[:TRAIN_WINDOWS], odd, plain[: TRAIN_WINDOWS - len(odd)]])
    grid = begin[rows, None] + np.arange(TRAIN_LENGTH)
    inside = grid < stop[rows, None]
    grid = np.minimum(grid, len(tags) - 1)
    x, y = feats[:, grid].copy(), np.where(inside, tags[grid], 0)
    # shape must be able to stand without neighbours, name and file, and these without shape
    hidden = rng.random(len(rows))
    own, around = [0, 5], [1, 2, 3, 4, 6]
    x[np.ix_(around, hidden < 0.5)] = _OFFSETS[-1]  # the last weight stays 0
    x[np.ix_(own, hidden > 0.9)] = _OFFSETS[-1]
    kinds, of = np.unique(x.reshape(len(x), -1), axis=1, return_inverse=True)
    kinds, of = kinds.T.astype(np.int64), of.reshape(y.shape)
    emission, move = np.zeros((_OFFSETS[-1] + 1, 3)), np.zeros((3, 3))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (emission, move)]
    for step in range(1, steps + 1):
        _, by_emission, by_move = likelihood(emission, move, kinds, of, y, inside)
        for value, g, (m, v) in ((emission, by_emission - 0.02 * emission, state[0]), (move, by_move - 0.02 * move, state[1])):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            value += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8)
        emission[-1] = 0
    return Field(emission, move)


def _covered(start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    """Whether the pattern spans together hold all of a span."""
    for s, k, e in sorted(spans):
        if k < 3 and s <= start < e:
            start = e
    return start >= end


def find(texts: pa.Array, field: Field | None) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of every text in code points, by start, then kind."""
    data, offsets = buffers(texts)
    out: list[list[tuple[str, int, int]]] = []
    for a, b in blocks(offsets, 1 << 20):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        whole = [part[at[i] : at[i + 1]].tobytes() for i in range(b - a)]
        spans = [base_spans(t) for t in whole]
        t = tokens(part, at) if field is not None else {"starts": ()}
        if len(t["starts"]):
            score = sum(field.emission[f] for f in t["features"])
            tag = viterbi(score, t["head"], field.move)
            hit = np.flatnonzero(tag)
            opens = (tag[hit] == 1) | np.r_[True, np.diff(hit) > 1] | t["head"][hit] if len(hit) else hit
            first = hit[opens] if len(hit) else hit
            last = hit[np.r_[np.flatnonzero(opens)[1:], len(hit)] - 1] if len(hit) else hit
            for i, j in zip(first, last):
                n = int(t["text"][i])
                s, e = int(t["starts"][i] - at[n]), int(t["ends"][j] - at[n])
                if not _covered(s, e, spans[n]):
                    spans[n].append((s, 3, e))
        for text, found in zip(whole, spans):
            plain = not found or text.isascii()
            place = (lambda x: x) if plain else (lambda x, t=text: len(t[:x].decode("utf-8", "replace")))
            out.append([(KINDS[k], place(s), place(e)) for s, k, e in sorted(found)])
    return out


def fit_on(documents: DataFrame, doc: str = "doc_id", text: str = "text", sample: int = SAMPLE_TEXTS, seed: int = 1) -> Field | None:
    """Fit on up to half of ``sample`` different texts in which a pattern is found and as many in which none is, those
    with the smallest keyed hash, in one task; only weights reach the driver. Copies count once."""

    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        data, offsets = buffers(texts)
        return pa.array([bool(base_spans(data[a:b].tobytes())) for a, b in zip(offsets, offsets[1:])], pa.bool_())

    tag = F.xxhash64(F.col(text), F.lit(seed))
    told = documents.where(F.col(text).isNotNull()).select(tag.alias("tag"), F.col(doc).alias("id"), holds(F.col(text)).alias("secret"))
    told = stored(told.groupBy("tag").agg(F.min("id").alias("id"), F.max("secret").alias("secret")), "secret-sample")
    some = lambda secret: told.where(F.col("secret") == secret).orderBy("tag").limit(sample // 2)
    ids = some(True).unionAll(some(False)).select("tag", "id")
    rows = documents.select(tag.alias("key"), F.col(doc).alias("of"), F.col(text).alias("text"))
    found = rows.join(F.broadcast(ids), (F.col("key") == F.col("tag")) & F.col("of").eqNullSafe(F.col("id")))
    chosen = found.groupBy("key").agg(F.max("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sorted((k, t) for b in batches for k, t in zip(*(c.to_pylist() for c in b.columns)))
        field = fit([t for _, t in texts], seed) if texts else None
        if field is not None:
            yield pa.RecordBatch.from_arrays([pa.array([field.emission.tobytes()], pa.binary()), pa.array([field.move.tobytes()], pa.binary())], ["emission", "move"])

    made = chosen.repartition(1).mapInArrow(run, "emission binary, move binary").collect()
    return Field(*(np.frombuffer(made[0][c]).reshape(-1, 3) for c in ("emission", "move"))) if made else None


def spans_column(field: Field | None, text: Column) -> Column:
    """Every span of a text, by start, then kind."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        rows = [[{"kind": k, "start": s, "end": e} for k, s, e in found] for found in find(texts, field)]
        return pa.array(rows, kind)

    return spans.asNondeterministic()(text)


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined with commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked_column(field: Field | None, text: Column, mask: str = "[secret]") -> Column:
    """The text with every span (joined where they overlap) replaced by ``mask``."""

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(texts.to_pylist(), find(texts, field)):
            if t is not None and found:
                pieces, at = [], 0
                for _, s, e in found:
                    if s >= at:
                        pieces += [t[at:s], mask]
                    at = max(at, e)
                t = "".join([*pieces, t[at:]])
            out.append(t)
        return pa.array(out, pa.string())

    return masked.asNondeterministic()(text)


def find_secrets(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with ``spans``."""
    return documents.withColumn("spans", spans_column(fit_on(documents, doc, text), F.col(text)))
