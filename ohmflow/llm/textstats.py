"""Counts of a text, for many texts at once (used by the quality operators)."""

from __future__ import annotations

import numpy as np

from . import textkit as tk

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True
UPPER = tk.byte_class((0x41, 0x5A))
PUNCT = tk.byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
NOT_NEWLINE = ~tk.byte_class((0x0A, 0x0A))
REPEAT_WINDOW = 5


def repeated(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Flags of the values found twice or more in their row."""
    if not len(values):
        return np.zeros(0, dtype=bool)
    key = tk.mix(values ^ tk.mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.empty(len(s), dtype=bool)
    out[order] = twice
    return out


def lines_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All \\n-separated lines, empty ones too: byte starts, ends, and each row's first line."""
    breaks = np.flatnonzero(~NOT_NEWLINE[data])
    row = np.searchsorted(offs, breaks, side="right") - 1
    n = np.bincount(row, minlength=len(offs) - 1) + 1
    first = tk.sums0(n)
    starts, ends = np.empty(first[-1], dtype=np.int64), np.empty(first[-1], dtype=np.int64)
    starts[first[:-1]] = offs[:-1]
    ends[first[1:] - 1] = offs[1:]
    at = np.arange(len(breaks)) + row                        # a row has one line more than breaks
    ends[at] = breaks
    starts[at + 1] = breaks + 1
    return starts, ends, first


def counts(arr) -> dict[str, np.ndarray]:
    """Per row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and further counts."""
    data, offs = tk.utf8(arr)
    starts, ends, first = tk.spans(data, offs, tk.NOT_SPACE)
    lead, symbol = tk.sums0(tk.LEAD[data].astype(np.int64)), tk.sums0(SYMBOLS[data].astype(np.int64))
    upper, punct = tk.sums0(UPPER[data].astype(np.int64)), tk.sums0(PUNCT[data].astype(np.int64))
    of = lambda p: p[offs[1:]] - p[offs[:-1]]
    chars = tk.sums0(lead[ends] - lead[starts])
    words = tk.span_hash(data, starts, ends)
    win = tk.windows(first, REPEAT_WINDOW)
    twice = win[repeated(tk.range_hash(words, win, win + REPEAT_WINDOW, 4), tk.rows_of(first)[win])]
    again = tk.cover(twice, twice + REPEAT_WINDOW, len(words))
    ls, le, lf = lines_of(data, offs)
    some = np.searchsorted(starts, le) > np.searchsorted(starts, ls)      # lines with a word
    ls, le, lrow = ls[some], le[some], tk.rows_of(lf)[some]
    key = tk.mix(tk.span_hash(data, ls, le) ^ tk.mix(lrow.astype(np.uint64) + np.uint64(1)))
    firsts = np.unique(key, return_index=True)[1]
    later = np.ones(len(key), dtype=bool)
    later[firsts] = False
    n_rows = len(offs) - 1
    return {
        "n_words": np.diff(first), "word_chars": chars[first[1:]] - chars[first[:-1]], "n_symbols": of(symbol),
        "n_dup_lines": np.bincount(lrow[later], minlength=n_rows), "n_repeat_words": tk.per_row(again, first),
        "n_upper": of(upper), "n_punct": of(punct), "n_lines": np.bincount(lrow, minlength=n_rows),
    }
