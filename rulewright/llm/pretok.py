"""Pre-tokenisation without regex: codepoint classes and an associative scan of transition functions.

Each character becomes a class, each class a function from the state before it to the state after it.
The functions that occur form a small semigroup, so composing two of them is one lookup in a byte table
and the states of a whole batch of texts come from a work-efficient prefix scan in numpy.

Two rule sets are known, named after what they do with white space:

* ``"byte"``: contractions, letters, numbers or other signs, each with one leading blank, white space.
* ``"word"``: contractions, letters, single numbers, other signs; white space separates and is dropped.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, SPACE_LAST, BLANK_LAST = range(8)
#: Added to the class of a text's first character, which always starts a piece.
FIRST = 8
#: The code points with the property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_L, _N, _O, _W, _B, _ONE, _TWO, _END = range(8)  # states: in letters, ..., after a blank, 1 or 2 letters of a contraction to come


@lru_cache(None)
def class_table() -> np.ndarray:
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    table[WHITE_SPACE] = SPACE
    return table


def _step(rules: str, kind: int, state: int) -> tuple[bool, int]:
    """Whether a character of this class starts a piece after this state, and the state after it."""
    blank = state == _B
    if kind == LETTER:
        if state in (_ONE, _TWO):
            return False, _END if state == _ONE else _ONE
        return not (state == _L or blank), _L
    if kind == NUMBER:
        return (not (state == _N or blank), _N) if rules == "byte" else (True, _END)
    if kind in (OTHER, SHORT, LONG):
        if state == _O or blank:
            return False, _O
        return True, {OTHER: _O, SHORT: _ONE, LONG: _TWO}[kind]
    if rules == "word":
        return True, _END
    if kind == SPACE:
        return state != _W, _W
    return True, _B if kind == BLANK_LAST else _END


class Rules:
    """The transition functions of a rule set, closed under composition."""

    def __init__(self, rules: str):
        base = []
        for kind in range(16):
            base.append(tuple(_step(rules, kind % FIRST, _END if kind >= FIRST else s)[1] for s in range(8)))
        self.starts = np.array([kind >= FIRST or _step(rules, kind % FIRST, s)[0] for kind in range(16) for s in range(8)])
        known = {f: i for i, f in enumerate(dict.fromkeys(base))}
        todo = list(known)
        while todo:
            f = todo.pop()
            for g in list(known):
                for a, b in ((f, g), (g, f)):
                    h = tuple(b[a[s]] for s in range(8))
                    if h not in known:
                        known[h] = len(known)
                        todo.append(h)
        self.size = len(known)
        funcs = list(known)
        self.of_class = np.array([known[f] for f in base], np.uint8)
        self.after = np.array([f[0] for f in funcs], np.uint8)
        self.compose = np.array([known[tuple(g[f[s]] for s in range(8))] for f in funcs for g in funcs], np.uint8)

    def scan(self, f: np.ndarray) -> np.ndarray:
        """Inclusive prefix compositions, pairing neighbours and recursing on half the length."""
        n = len(f)
        if n < 2:
            return f
        pairs = self._both(f[0 : n - 1 : 2], f[1::2])
        odd = self.scan(pairs)
        out = np.empty(n, np.uint8)
        out[0] = f[0]
        out[1::2] = odd
        out[2::2] = self._both(odd[: (n - 1) // 2], f[2::2])
        return out

    def _both(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        return self.compose[first.astype(np.intp) * self.size + then]


@lru_cache(None)
def rules_of(name: str) -> Rules:
    return Rules(name)


def classes(cp: np.ndarray, firsts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Classes of the code points of concatenated non-empty texts, with what lies ahead folded in."""
    cls = class_table()[cp]
    space = cls == SPACE
    ahead = np.empty_like(space)
    ahead[:-1] = space[1:]
    ahead[ends - 1] = True  # a run at the end of a text is one piece
    last = np.flatnonzero(space & ~ahead)
    cls[last] = np.where(cp[last] == 32, BLANK_LAST, SPACE_LAST)
    marks = np.flatnonzero(cp == 39)
    if len(marks):
        end = ends[np.searchsorted(ends, marks, "right")]
        padded = np.append(cp, [0, 0])
        one = np.where(marks + 1 < end, padded[marks + 1], 0)
        two = np.where(marks + 2 < end, padded[marks + 2], 0)
        cls[marks[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        long = np.zeros(len(marks), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        cls[marks[long]] = LONG
    cls[firsts] += FIRST
    return cls


def split(texts: list[str], rules: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(pieces of all texts in order, number of pieces of each text, start of each piece in its text)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    every = "".join(texts)
    if not every:
        return [], np.zeros(len(texts), np.int64), np.zeros(0, np.int64)
    cp = np.frombuffer(every.encode("utf-32-le", "surrogatepass"), np.uint32)
    all_ends = np.cumsum(lengths)
    full = lengths > 0
    firsts, ends = (all_ends - lengths)[full], all_ends[full]
    cls = classes(cp, firsts, ends)
    r = rules_of(rules)
    state = r.after[r.scan(r.of_class[cls])]
    before = np.empty_like(state)
    before[0], before[1:] = 0, state[:-1]
    starts = np.flatnonzero(r.starts[cls.astype(np.intp) * 8 + before])
    stops = np.append(starts[1:], len(cp))
    if rules == "word":
        keep = class_table()[cp[starts]] != SPACE
        starts, stops = starts[keep], stops[keep]
    counts = np.diff(np.searchsorted(starts, np.append(0, all_ends)))
    pieces = [every[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
    return pieces, counts, starts - np.repeat(all_ends - lengths, counts)


def chunks(texts: list[str], most: int = 1_000_000):
    """(from, to) of runs of texts of at most ``most`` characters together, or one longer text."""
    begin = size = 0
    for i, n in enumerate(map(len, texts)):
        if size and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


class PieceCache:
    """Ids of pieces seen so far, in one flat array. When it would hold more than ``limit`` pieces, those that
    were used least often make room."""

    def __init__(self, encode, limit: int):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.lens, self.used = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _make_room(self) -> None:
        """Keeps at most half of the limit: the pieces used most often."""
        least = np.sort(self.used)[-max(1, min(len(self.used), self.limit // 2))]
        keep = np.flatnonzero(self.used > max(least, 1))
        number = np.full(len(self.used), -1)
        number[keep] = np.arange(len(keep))
        kept, new = {}, number.tolist()
        for piece, old in self.index.items():
            if new[old] >= 0:
                kept[piece] = new[old]
        self.index = kept
        self.flat = self.flat[spread(self.starts[keep], self.lens[keep])]
        self.lens, self.used = self.lens[keep], self.used[keep] // 2
        self.starts = np.cumsum(self.lens, dtype=np.int64) - self.lens

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids of each piece)."""
        new = set(pieces).difference(self.index)
        if new:
            if self.index and len(self.index) + len(new) > self.limit:
                self._make_room()
                new = set(pieces).difference(self.index)
            added = list(new)
            lists = self.encode(added)
            lens = np.fromiter(map(len, lists), np.int32, len(lists))
            flat = np.fromiter((i for ids in lists for i in ids), np.int32, int(lens.sum()))
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(lens, dtype=np.int64) - lens)
            self.lens, self.used = np.append(self.lens, lens), np.append(self.used, np.zeros(len(lens), np.int32))
            self.flat = np.append(self.flat, flat)
            self.index.update(zip(added, range(len(self.index), len(self.index) + len(added))))
        k = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        self.used += np.bincount(k, minlength=len(self.used)).astype(np.int32)
        lens = self.lens[k]
        return self.flat[spread(self.starts[k], lens)], lens


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenated ranges [start, start + len)."""
    ends = np.cumsum(lens)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


def text_sums(lens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``lens`` over consecutive groups of ``counts`` entries; empty groups give 0."""
    total = np.append(0, np.cumsum(lens))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class TextEncoder:
    """Ids of whole texts: ``split``, then cached pieces."""

    def __init__(self, encode, rules: str, limit: int = 500_000):
        self.rules, self.cache = rules, PieceCache(encode, limit)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        ids, lens = [], []
        for a, b in chunks(texts):
            pieces, counts, _ = split(texts[a:b], self.rules)
            got, per_piece = self.cache(pieces)
            ids.append(got)
            lens.append(text_sums(per_piece, counts))
        return (np.concatenate(ids), np.concatenate(lens)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))


_BUILT: dict = {}


def once(key, build):
    """One object for each Python worker, however many tasks it runs."""
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]
