"""Numbers that describe the form of texts, for many texts at once, in numpy, for Python workers. None looks at what a text is about."""

from __future__ import annotations

import numpy as np

from claimweave.llm import shingle_arrays as A

NAMES = (
    "log_chars", "word_chars", "upper", "digits", "sentence_marks", "marks_inside", "symbols", "exclaims", "bars", "blanks", "lines", "beyond_ascii", "words_a_sentence", "words_a_line",
    "short_lines", "same_lines", "distinct_words", "distinct_pairs", "top_word", "capital_words", "long_words", "one_letter", "symbol_words", "upper_words")
_SETS = {"upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "ends": b".!?", "inside": b",;:", "exclaims": b"!", "bars": b"|", "newline": b"\n"}
_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in b".,;:!?'\"()-|")


def _members(buf: np.ndarray, members) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table[buf]


def features(texts: list[str]) -> np.ndarray:
    """One row of ``NAMES`` per text. A text without characters or words has zeros where nothing can be measured."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(raw) + b"\n"
    buf = np.frombuffer(joined, dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    starts = ends - [len(r) + 1 for r in raw]
    size = np.maximum(ends - starts - 1, 0).astype(float)

    def per_text(mask: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[ends - 1] - sums[starts] if at is None else sums[at[1:]] - sums[at[:-1]]).astype(float)

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros_like(a, dtype=float), where=b > 0)

    kinds = {name: per_text(_members(buf, members)) for name, members in _SETS.items()}
    tail = per_text((buf & 0xC0) == 0x80)
    chars = size - tail
    beyond = per_text(buf >= 0xC0)
    symbol = _members(buf, _SYMBOLS)
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.diff(blank.astype(np.int8), prepend=1)
    w_start, w_end = np.flatnonzero(edge == -1), np.flatnonzero((edge == 1) & (np.arange(len(buf)) > 0))
    hashes, at = A.word_hashes([r.lower() for r in raw])
    words = np.diff(at).astype(float)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    upper, symbols = np.concatenate([[0], np.cumsum(_members(buf, range(65, 91)))]), np.concatenate([[0], np.cumsum(symbol)])
    heads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    length = heads[w_end] - heads[w_start]
    capital = _members(buf, range(65, 91))[w_start] if len(w_start) else np.zeros(0, dtype=bool)
    all_upper = (upper[w_end] - upper[w_start] >= 2) & ((upper[w_end] - upper[w_start]) * 2 > length)
    has_symbol = symbols[w_end] > symbols[w_start]

    def distinct(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values per text and the count of the most frequent one."""
        if not len(values):
            return np.zeros(len(texts)), np.zeros(len(texts))
        order = np.lexsort((values, of))
        v, o = values[order], of[order]
        first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])]))
        runs = np.diff(np.append(first, len(v)))
        most = np.zeros(len(texts))
        np.maximum.at(most, o[first], runs)
        return np.bincount(o[first], minlength=len(texts)).astype(float), most

    kinds_of_words, top = distinct(hashes, owner)
    together = hashes[:-1] * A.PLACE[3] + hashes[1:] if len(hashes) else hashes
    inside = owner[:-1] == owner[1:]
    pairs, _ = distinct(together[inside], owner[:-1][inside])
    # lines: hashes of their bytes by the same prefix sums as words
    line_end = np.flatnonzero(buf == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    line_owner = np.searchsorted(ends, line_start, side="right")
    total = np.concatenate([[A.U(0)], np.cumsum(A.BYTE_VALUES[buf] * np.cumprod(np.full(len(buf), A.U(A._P)), dtype=A.U), dtype=A.U)])
    _, down = A._powers(1 << max(len(buf) - 1, 1).bit_length())
    line_hash = (total[line_end] - total[line_start]) * down[line_start]
    line_size = line_end - line_start
    real = line_size > 0
    lines = np.bincount(line_owner[real], minlength=len(texts)).astype(float)
    line_kinds, _ = distinct(line_hash[real], line_owner[real])
    short = np.bincount(line_owner[real & (line_size < 30)], minlength=len(texts)).astype(float)

    def of_words(mask: np.ndarray) -> np.ndarray:
        return share(np.bincount(owner[mask], minlength=len(texts)).astype(float), words)

    columns = (
        np.log1p(chars), share(np.bincount(owner, weights=length, minlength=len(texts)), words), share(kinds["upper"], kinds["upper"] + kinds["lower"]), share(kinds["digits"], chars),
        share(kinds["ends"], words), share(kinds["inside"], words), share(per_text(symbol), chars), share(kinds["exclaims"], words), share(kinds["bars"], words), share(per_text(blank), chars),
        share(lines, words), share(beyond, chars), share(words, kinds["ends"] + 1), share(words, np.maximum(lines, 1)), share(short, lines), share(lines - line_kinds, lines),
        share(kinds_of_words, words), share(pairs, np.maximum(words - 1, 0)), share(top, words), of_words(capital), of_words(length > 15), of_words(length == 1), of_words(has_symbol), of_words(all_upper))
    return np.column_stack(columns)
