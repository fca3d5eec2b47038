"""Byte-level BPE as finite-state machines.

Two deterministic transducers stand for a tokenizer file:

* the *splitter*, 14 states over 12 character classes, marks where the
  pre-tokenizer starts a piece.  A chunk of text is a map from entry state to
  exit state; the maps of all chunks compose through a parallel prefix scan,
  which gives the entry state of every chunk at once.
* the *counter* reads a piece's bytes and emits token-count changes.  After a
  prefix p its state holds, for each suffix of p that can still grow into a
  token, the vocabulary-trie node, the last token before that suffix and the
  relative count.  Exactly one token can end a prefix's encoding, because an
  encoding is valid just when each adjacent pair of its tokens encodes to
  itself; so the count after every byte is known and the machine is
  deterministic.  States are compiled on demand and forgotten beyond a bound.
"""

from __future__ import annotations

import functools
import json
from array import array

import numpy as np
import regex
import tiktoken

from tessera.llm.common import held

# Character classes.
END, LETTER, ONE, R, V, ELL, E, NUMBER, OTHER, QUOTE, SPACE, BLANK = range(12)
# States.
START, IN_L, IN_N, IN_O, Q, QR, QV, QL, CUT, S1, SN, B1, BN = range(13)
STATES, CLASSES = 13, 12
LETTERS = (LETTER, ONE, R, V, ELL, E)


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        found = "".join(regex.findall(pattern, every))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    for c in "stmd":
        out[ord(c)] = ONE
    for c, kind in (("r", R), ("v", V), ("l", ELL), ("e", E), ("'", QUOTE), (" ", SPACE)):
        out[ord(c)] = kind
    return out


@functools.cache
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and marks by (state, class); mark 1: a piece starts here, 2: one starts a character before."""
    nxt = np.zeros((STATES, CLASSES), np.uint8)
    mark = np.zeros((STATES, CLASSES), np.uint8)
    fresh = {NUMBER: IN_N, OTHER: IN_O, QUOTE: Q, SPACE: S1, BLANK: B1, **dict.fromkeys(LETTERS, IN_L)}
    for s in range(STATES):
        mark[s, END] = 2 * (s in (QR, QV, QL))
        for c, to in fresh.items():  # unless said otherwise, a new piece starts
            nxt[s, c], mark[s, c] = to, 1
    for c in LETTERS:
        nxt[IN_L, c], mark[IN_L, c] = IN_L, 0
        for s, needed in ((QR, E), (QV, E), (QL, ELL)):  # 're 've 'll, or a lone quote before letters
            nxt[s, c], mark[s, c] = (CUT, 0) if c == needed else (IN_L, 2)
    for s in (QR, QV, QL):
        for c in (NUMBER, OTHER, QUOTE, SPACE, BLANK):
            mark[s, c] = 3
    nxt[IN_N, NUMBER], mark[IN_N, NUMBER] = IN_N, 0
    for s in (IN_O, Q):
        for c in (OTHER, QUOTE):
            nxt[s, c], mark[s, c] = IN_O, 0
    for c, to in ((ONE, CUT), (R, QR), (V, QV), (ELL, QL)):
        nxt[Q, c], mark[Q, c] = to, 0
    for s in (S1, SN):  # the last space of a run belongs to what follows
        for c in (*LETTERS, NUMBER, OTHER, QUOTE):
            nxt[s, c], mark[s, c] = (IN_O if c == QUOTE else fresh[c]), 0 if s == S1 else 2
    for c in (*LETTERS, NUMBER, OTHER, QUOTE):  # another blank at the end of a run stands alone
        mark[BN, c] = 3
    for s in (S1, SN, B1, BN):
        nxt[s, SPACE], mark[s, SPACE], nxt[s, BLANK], mark[s, BLANK] = SN, 0, BN, 0
    return nxt, mark


@functools.cache
def leaps(width: int = 3) -> np.ndarray:
    """The state map of every ``width`` consecutive classes, flat by (classes, state)."""
    nxt = splitter()[0]
    maps = np.arange(STATES, dtype=np.uint8)[None, :]
    for _ in range(width):  # nxt[maps, c] for each class c, the latest class last
        maps = np.stack([nxt[:, c][maps] for c in range(CLASSES)], axis=1).reshape(-1, STATES)
    return maps.ravel()


def starts(kinds: np.ndarray, chunk: int = 126) -> np.ndarray:
    """Where pieces start in a sequence of classes; END stands between texts.

    Every chunk's state map is found for all entry states together, three
    characters a step; the maps compose in log2(chunks) doubling steps, and a
    second sweep from the entry states thus known emits the marks.
    """
    n = -(-(len(kinds) + 1) // chunk)
    grid = np.zeros(n * chunk, np.uint8)
    grid[: len(kinds)] = kinds
    grid = np.ascontiguousarray(grid.reshape(n, chunk).T)
    threes = ((grid[0::3].astype(np.uint16) * CLASSES + grid[1::3]) * CLASSES + grid[2::3]) * STATES
    far = leaps(3)
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8)[:, None], (STATES, n))
    for row in threes:
        maps = far[row + maps]
    maps = np.ascontiguousarray(maps.T)
    step = 1
    while step < n:  # Hillis-Steele: maps[i] becomes the map of chunks 0..i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    state = np.zeros(n, np.uint8)
    state[1:] = maps[:-1, START]
    marks = np.empty((chunk, n), np.uint8)
    nxt, mark = splitter()
    flat, flat_mark = nxt.T.ravel(), mark.T.ravel()
    for k, row in enumerate(grid):
        at = row * np.uint8(STATES) + state
        marks[k] = flat_mark[at]
        state = flat[at]
    marks = marks.T.ravel()
    found = (marks & 1).astype(bool)
    found[:-1] |= marks[1:] > 1
    return np.flatnonzero(found)


GROUPS = np.array([0, 1, 1, 1, 1, 1, 1, 2, 3, 3, 4, 4], np.uint8)


def direct_starts(kinds: np.ndarray) -> np.ndarray:
    """The same starts from runs of like characters; the last character of ``kinds`` is END."""
    g = GROUPS[kinds]
    run = np.flatnonzero(np.diff(g, prepend=np.uint8(9)))
    kind, stop = g[run], np.append(run[1:], len(g))
    out = np.zeros(len(g), bool)
    words = run[(kind > 0) & (kind < 4)]
    before = kinds[words - 1]  # of the first, the last END
    out[words - (before == SPACE)] = True
    blank = kind == 4
    first, last = run[blank], stop[blank] - 1
    long, ended, spaced = last > first, g[np.minimum(last + 1, len(g) - 1)] == 0, kinds[last] == SPACE
    out[first[long | ended | ~spaced]] = True
    out[last[~ended & ~spaced]] = True
    # A quote that starts a piece, and is alone in its run, takes s t m d re ve ll.
    quotes = np.flatnonzero(kinds == QUOTE)
    quotes = quotes[out[quotes] & (g[quotes + 1] == 1)]
    if len(quotes):
        a, b = kinds[quotes + 1], kinds[np.minimum(quotes + 2, len(kinds) - 1)]
        two = ((a == R) | (a == V)) & (b == E) | (a == ELL) & (b == ELL)
        taken = two | (a == ONE)
        out[quotes[taken] + 1] = False
        ends = quotes[taken] + 2 + two[taken]
        out[ends[g[ends] > 0]] = True
    return np.flatnonzero(out)


def _byte_letters() -> dict[str, int]:
    """The printable stand-in for every byte in tokenizer files: itself where printable, else 256 and up in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Remembered(dict):
    """A function's values by argument; forgets everything beyond ``most``, so memory is bounded."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = got = self.make(key)
        return got


class Machine:
    """The counter of one tokenizer file (byte-level BPE, .json), compiled on demand."""

    def __init__(self, path: str, most_states: int = 150_000, most_pieces: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(map(letters.__getitem__, s))
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.split_of: dict[int, tuple[int, int]] = {}  # a merged token's two parts
        self.merge: dict[tuple[int, int], int] = {}  # two parts to their token
        for x, y in pairs:
            a, b = raw(x), raw(y)
            self.merge[ids[a], ids[b]] = c = ids[a + b]
            self.split_of.setdefault(c, (ids[a], ids[b]))
        if sorted(self.split_of) != list(self.split_of):
            raise ValueError("token ids must follow the order of the merges")
        self.vocabulary = ids
        self.trie: dict[int, int] = {}  # node << 8 | byte -> node
        self.token: dict[int, int] = {}  # node -> the token that ends there
        self.inner: set[int] = set()
        for t, i in ids.items():
            node = 0
            for b in t:
                self.inner.add(node)
                node = self.trie.setdefault(node << 8 | b, len(self.trie) + 1)
            self.token[node] = i
        self.most_states = most_states
        self.counts = Remembered(self._count, most_pieces)  # piece -> number of tokens
        self.coded = Remembered(self._code, 2 * most_pieces)  # piece -> ids, little-endian unsigned 32-bit
        self._forget()

    def _forget(self) -> None:
        first = array("i", (0, -1, 0)).tobytes()
        self.states, self.number, self.step, self.ends, self.pairs = [first], {first: 0}, {}, array("i", [-1]), {}

    def adjacent(self, a: int, b: int) -> bool:
        """May token b follow token a?  Undo their merges, latest first: no merge across the border may come before."""
        got = self.pairs.get(a << 32 | b)
        if got is not None:
            return got
        x, y, limit, ok = a, b, 1 << 60, None
        while ok is None:
            c = self.merge.get((x, y))
            if c is not None and c < limit:
                ok = False
            elif x > y:
                limit = x
                x = self.split_of.get(x, (x, x))[1]
                if x == limit:
                    limit = y + 1
                    y = self.split_of.get(y, (y, y))[0]
                    if y + 1 == limit:
                        ok = True
            else:
                limit = y + 1
                y = self.split_of.get(y, (y, y))[0]
                if y + 1 == limit:
                    limit = x
                    x = self.split_of.get(x, (x, x))[1]
                    if x == limit:
                        ok = True
        self.pairs[a << 32 | b] = ok
        return ok

    def _compile(self, s: int, b: int) -> tuple[int, int]:
        """The state after byte b and the change of the token count: a state is (node, last token before it, count) by suffix."""
        grown, last, at, state = [], -1, 0, array("i", self.states[s])
        trie, inner, token = self.trie, self.inner, self.token
        for k in range(0, len(state), 3):
            to = trie.get(state[k] << 8 | b)
            if to is not None:
                before, count = state[k + 1], state[k + 2]
                if last < 0 and (t := token.get(to, -1)) >= 0 and (before < 0 or self.adjacent(before, t)):
                    last, at = t, count + 1
                if to in inner:
                    grown.append((to, before, count))
        key = array("i", (*(x for to, before, count in grown for x in (to, before, count - at)), 0, last, 0)).tobytes()
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
            self.ends.append(last)
        self.step[s << 8 | b] = got = number << 8 | at + 128
        return got

    def count(self, piece: bytes) -> int:
        """How many tokens a pre-tokenizer's piece has: the sum of the transitions' emissions."""
        if len(self.states) > self.most_states:
            self._forget()
        s, n = 0, -128 * len(piece)
        get = self.step.get
        for b in piece:
            got = get(s << 8 | b) or self._compile(s, b)
            s = got >> 8
            n += got & 255
        return n

    def _count(self, piece: str) -> int:
        return 1 if piece in self.specials else self.count(piece.encode())

    @functools.cached_property
    def merger(self) -> tiktoken.Encoding:
        """The same vocabulary as merge ranks, for the ids of pieces that are not remembered."""
        return tiktoken.Encoding("pieces", pat_str=r"\S+|\s+", mergeable_ranks=self.vocabulary, special_tokens={})

    def _code(self, piece: str) -> bytes:
        ids = [self.specials[piece]] if piece in self.specials else self.merger._encode_single_piece(piece)
        return array("I", ids).tobytes()

    def segments(self, text: str) -> list[str]:
        """A text cut at special strings, which stand at odd places."""
        for special in self.specials:
            if special in text:
                return regex.split("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")", text)
        return [text]

    def split(self, texts: list[str], scan: bool = True) -> tuple[list[list[str]], list[int]]:
        """The pieces of each text; a special string is a piece of its own (it is in ``specials``).

        Returns all pieces in order, and for each text the number of its pieces.
        """
        parts, owner = [], []
        for i, text in enumerate(texts):
            if text:
                segments = self.segments(text)
                parts += segments
                owner += [i] * len(segments)
        if not parts:
            return [], [0] * len(texts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        big = "\0".join(parts) + "\0"
        kinds = classes()[np.frombuffer(big.encode("utf-32-le"), np.uint32)]
        ends = np.cumsum(sizes + 1) - 1
        begins = ends - sizes
        kinds[ends] = END
        special = [k for k, p in enumerate(parts) if p in self.specials] if len(parts) > len(set(owner)) else []
        for k in special:
            kinds[begins[k] : ends[k]] = END
        at = starts(kinds) if scan else direct_starts(kinds)
        if special:
            at = np.sort(np.concatenate([at, begins[special]]))
        edge = np.append(np.searchsorted(at, begins), len(at))
        each = np.diff(edge)
        stop = np.append(at[1:], len(big))
        full = each > 0
        stop[edge[1:][full] - 1] = ends[full]
        pieces = [big[a:b] for a, b in zip(at.tolist(), stop.tolist(), strict=True)]
        counts = np.bincount(np.asarray(owner), weights=each, minlength=len(texts)).astype(np.int64)
        return pieces, counts.tolist()


def machine(path: str) -> Machine:
    """A worker's machine for a tokenizer file, kept until another operator needs the memory."""
    return held(path, lambda: Machine(path))
