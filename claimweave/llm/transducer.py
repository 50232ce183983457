"""Finite-state counting of byte-level BPE tokens, in numpy and small tables inside Python workers.

Two deterministic transducers stand in for the tokenizer. The first reads character classes and marks where
pre-tokens start. Texts are laid end to end and cut into chunks; each chunk is summarised as a map from entry to exit
state, the maps are composed by a parallel prefix scan, and every chunk then runs from its true entry state.
The second reads the bytes of a pre-token and annotates each transition with the net number of tokens it emits.
Its states are compiled when they are first reached: a state knows, for each place as far back as the
longest vocabulary entry that may still be completed, the last token of the encoding up to there. One byte more
is encoded by the only vocabulary entry that ends there and stands next to the token before it in an
encoding of the two together, so the count changes by what lies between.

Defined results: an empty or null text has no token; texts that repeat have equal counts; an empty list gives an empty one; a text of
any length is cut into parts of bounded size.
"""

from __future__ import annotations

import functools
import json

import numpy as np

# character classes, then symbols: a class with what its right context decides
LETTER, NUMBER, OTHER, APOS1, APOS2, BLANK, LAST_SPACE, LAST_BLANK, STOP = range(9)
# states: nothing read; in letters, numbers, others, blanks; after a space that opens a pre-token; one or two characters of a contraction to come
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, OPENED, ONE_MORE, TWO_MORE = range(8)
CHUNK = 512
#: Code points laid end to end at once; longer texts are cut at a blank after a non-blank, where a pre-token always ends.
GROUP = 2_000_000
#: Compiled transitions and remembered pre-tokens, per worker; when full they are forgotten and compiled again.
MOST_TRANSITIONS, MOST_WORDS = 400_000, 400_000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a pre-token starts, by state and symbol."""
    follow = np.zeros((8, 9), dtype=np.uint8)
    starts = np.ones((8, 9), dtype=bool)
    target = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APOS1: ONE_MORE, APOS2: TWO_MORE, BLANK: IN_BLANKS, LAST_SPACE: OPENED, LAST_BLANK: FRESH, STOP: FRESH}
    for symbol, state in target.items():
        follow[:, symbol] = state
    for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (BLANK, IN_BLANKS)):
        starts[run, symbol] = False
        starts[OPENED, symbol] = symbol == BLANK
    for symbol in (APOS1, APOS2):  # a contraction is one only where a pre-token starts
        for state in (IN_OTHERS, OPENED):
            follow[state, symbol], starts[state, symbol] = IN_OTHERS, False
    for state, then in ((ONE_MORE, FRESH), (TWO_MORE, ONE_MORE)):
        follow[state, :STOP], starts[state, :STOP] = then, False
    return follow, starts


FOLLOW, STARTS = _tables()


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point, asked of the library so that its Unicode version counts."""
    from tokenizers import Regex, pre_tokenizers

    points = np.concatenate([np.arange(0xD800, dtype=np.uint32), np.arange(0xE000, 0x110000, dtype=np.uint32)])
    everything, out = points.astype("<u4").tobytes().decode("utf-32-le"), np.full(0x110000, OTHER, dtype=np.uint8)
    for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        splitter = pre_tokenizers.Split(Regex(name), "removed", invert=True)
        for at in range(0, len(points), 4096):
            for _, (a, b) in splitter.pre_tokenize_str(everything[at:at + 4096]):
                out[points[at + a:at + b]] = kind
    return out


def symbols(points: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Symbol of every code point; ``stops`` are places between texts."""
    sym = classes()[points]
    sym[stops] = STOP
    after = np.append(sym[1:], STOP)
    last = (sym == BLANK) & (after != BLANK) & (after != STOP)
    apos = np.flatnonzero((points == 39) & (sym != STOP))
    sym[last] = np.where(points[last] == 32, LAST_SPACE, LAST_BLANK)
    if len(apos):
        padded = np.append(np.where(sym == STOP, 0, points), [0, 0])
        one, two = padded[apos + 1], padded[apos + 2]
        sym[apos[np.isin(one, [ord(c) for c in "stmd"])]] = APOS1
        pair = one * 256 + np.where(two < 256, two, 0)
        sym[apos[np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])]] = APOS2
    return sym


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps (one per row) under composition, in log(rows) vector steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


def pretoken_starts(sym: np.ndarray) -> np.ndarray:
    """Places where a pre-token (or a stop) begins."""
    chunks = -(-len(sym) // CHUNK)
    grid = np.full(chunks * CHUNK, STOP, dtype=np.uint8)
    grid[: len(sym)] = sym
    columns = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (chunks, 1))
    for column in columns:
        maps = FOLLOW[maps, column[:, None]]
    state = np.zeros(chunks, dtype=np.uint8)
    state[1:] = compose_scan(maps)[:-1, FRESH]
    marks = np.empty((CHUNK, chunks), dtype=bool)
    for i, column in enumerate(columns):
        marks[i] = STARTS[state, column]
        state = FOLLOW[state, column]
    return np.flatnonzero(marks.T.reshape(-1)[: len(sym)])


def byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Bytes printable in Latin-1 stand for themselves, the others follow from 256 on in order.
    """
    printable = {b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class MergeMachine:
    """Counts the tokens of a pre-token by a transducer over its bytes, compiled as it is used."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.special = [t["content"] for t in config["added_tokens"]]
        self.model = Tokenizer.from_file(path).model
        self.vocab = set(config["model"]["vocab"])
        self.heads = {t[:i] for t in self.vocab for i in range(len(t))}  # what may still grow into an entry
        self.names = byte_names()
        self.words: dict[str, int] = {}
        self.fits: dict[tuple, bool] = {}
        self.forget()

    def forget(self) -> None:
        # a state: the text that may still grow into a vocabulary entry, and for each place in it where one could
        # have begun the last token up to there and the count relative to now
        first = ("", ((None, 0),))
        self.numbers, self.states, self.moves, self.shapes = {first: 0}, [first], {}, {}

    def places(self, head: str) -> list[int]:
        """How far back the places of a head lie."""
        return [d for d in range(len(head), -1, -1) if head[len(head) - d:] in self.heads]

    def shape(self, head: str, char: str) -> tuple:
        """What a byte more means whatever the tokens: entries that may end here with the place before them, next head, places kept."""
        text, old = head + char, self.places(head)
        ends = tuple((old.index(n - 1), text[len(text) - n:]) for n in range(len(text), 0, -1) if text[len(text) - n:] in self.vocab)
        keep = next(n for n in range(len(text), -1, -1) if text[len(text) - n:] in self.heads)
        after = text[len(text) - keep:]
        return ends, after, tuple(old.index(d - 1) for d in self.places(after) if d)

    def adjacent(self, a: str | None, b: str) -> bool:
        """Whether ``a`` and ``b`` are neighbours in the encoding of the two together (alone, if nothing precedes)."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > MOST_TRANSITIONS:
                self.fits.clear()
            want = [b] if a is None else [a, b]
            known = self.fits[a, b] = [t.value for t in self.model.tokenize("".join(want))] == want
        return known

    def compile(self, state: int, char: str) -> tuple[int, int]:
        head, places = self.states[state]
        shape = self.shapes.get((head, char))
        if shape is None:
            shape = self.shapes[head, char] = self.shape(head, char)
        ends, after, kept = shape
        for at, token in ends:
            if self.adjacent(places[at][0], token):
                emitted = places[at][1] + 1
                break
        else:
            raise ValueError(f"no token ends with {char!r}")
        target = after, (*[(places[i][0], places[i][1] - emitted) for i in kept], (token, 0))
        number = self.numbers.setdefault(target, len(self.states))
        if number == len(self.states):
            self.states.append(target)
        self.moves[state, char] = number, emitted
        return number, emitted

    def count(self, word: str) -> int:
        if len(self.moves) > MOST_TRANSITIONS:
            self.forget()
        names, moves, state, total = self.names, self.moves, 0, 0
        for byte in word.encode("utf-8"):
            move = moves.get((state, names[byte])) or self.compile(state, names[byte])
            state = move[0]
            total += move[1]
        return total

    def counts(self, text: str, bounds: list[int]) -> list[int]:
        """Tokens of each piece ``text[bounds[i]:bounds[i + 1]]``."""
        words = self.words
        if len(words) > MOST_WORDS:
            words.clear()
        parts = [text[a:b] for a, b in zip(bounds, bounds[1:])]
        out = list(map(words.get, parts))
        while None in out:  # a new word counts for all its places in this group
            new = {p for p, n in zip(parts, out) if n is None}
            words.update((p, self.count(p)) for p in new)
            out = list(map(words.get, parts))
            for p in new:
                if len(p) > 64:
                    del words[p]
        return out


@functools.cache
def machine(path: str) -> MergeMachine:
    return MergeMachine(path)


def pieces(text: str, size: int = GROUP) -> list[str]:
    """The text, cut near every ``size`` characters between a non-blank and a blank."""
    out, start = [], 0
    while len(text) - start > size:
        cut = start + size
        while cut < len(text) and not (text[cut] in " \n\t\r" and text[cut - 1] not in " \n\t\r" and not text[cut - 1].isspace()):
            cut += 1
        out.append(text[start:cut])
        start = cut
    return [*out, text[start:]] if start else [text]


def token_counts(texts: list[str], path: str) -> list[int]:
    """Tokens of every text."""
    m, totals = machine(path), [0] * len(texts)
    group, owners, size = [], [], 0

    def settle() -> None:
        if not group:
            return
        joined = "\0".join(group) + "\0"
        ends = np.cumsum([len(g) + 1 for g in group])
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        starts = pretoken_starts(symbols(points, ends - 1))
        emitted = np.array(m.counts(joined, [*starts.tolist(), len(joined)]), dtype=np.int64)
        emitted[np.isin(starts, ends - 1)] = 0
        sums = np.concatenate([[0], np.cumsum(emitted)])[np.searchsorted(starts, ends - 1)]
        for owner, n in zip(owners, np.diff(sums, prepend=0).tolist()):
            totals[owner] += n
        group.clear()
        owners.clear()

    for i, text in enumerate(texts):
        parts = [text]
        for mark in m.special:
            parts = [x for p in parts for x in p.split(mark)]
        totals[i] += len(parts) - 1
        for part in (x for p in parts if p for x in pieces(p)):
            group.append(part)
            owners.append(i)
            size += len(part) + 1
            if size >= GROUP:
                settle()
                size = 0
    settle()
    return totals
