"""Statistics of whole texts, computed for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import text as T

NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
SYMBOLS = b"#*$%&|<>"
_SEGMENT = 1 << 18
#: The names of what :func:`statistics` returns, in order.
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits", "n_punct", "n_bars", "n_bangs", "n_distinct", "n_short", "entropy")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_CLASSES = np.stack([
    _class(bytes(b for b in range(256) if not 0x80 <= b <= 0xBF and not T.SPACE[b])),
    _class(SYMBOLS),
    _class(bytes(b for b in range(256) if not 0x80 <= b <= 0xBF)),
    _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b".,;:?'\"()-"), _class(b"|"), _class(b"!"),
], axis=1)


def _per_text(first: np.ndarray, flags: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]


def _salted(keys: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    """The keys, apart for each of n texts."""
    return keys ^ T.mix(T.mix(np.arange(n, dtype=np.uint64) + np.uint64(1 << 40)) + np.uint64(0x5851F42D4C957F2D))[text_of]


def _distinct(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct keys of each text.  A single text's (it may be long) are sorted in place."""
    n = len(first) - 1
    if n == 1:
        keys.sort()
        return np.array([len(keys) and 1 + np.count_nonzero(keys[1:] != keys[:-1])])
    text_of = np.repeat(np.arange(n), np.diff(first))
    order, new = T.groups_of_equal(_salted(keys, text_of, n))
    return np.bincount(text_of[order[new]], minlength=n)


def _repeated(words: np.ndarray, first: np.ndarray, size: int = 8) -> np.ndarray:
    """Words of each text in windows of ``size`` words that occur twice or more in it."""
    n = len(first) - 1
    if n == 1:
        return np.array([_repeated_in_one(words, size)])
    keys, at = T.windows(words, first, size)
    order, new = T.groups_of_equal(_salted(keys, np.repeat(np.arange(n), np.diff(first))[at], n))
    cover = np.zeros(len(words) + 1, np.int64)
    again = at[order[~(new & np.append(new[1:], True))]]
    np.add.at(cover, again, 1)
    np.add.at(cover, again + size, -1)
    return _per_text(first, np.cumsum(cover)[:-1] > 0)


def _repeated_in_one(words: np.ndarray, size: int) -> int:
    """The hashes of all windows are sorted once to learn which repeat, and made again, segment by
    segment, to mark the words of those."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    spans = [(a, min(n, a + _SEGMENT)) for a in range(0, n, _SEGMENT)]
    made = lambda a, b: T.windows(words[a : b + size - 1], np.array([0, b + size - 1 - a]), size)[0]
    ranked = np.concatenate([made(a, b) for a, b in spans])
    ranked.sort()
    again = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(again):
        return 0
    covered = np.zeros(len(words), bool)
    for a, b in spans:
        own = made(a, b)
        hit = again[np.minimum(np.searchsorted(again, own), len(again) - 1)] == own
        for j in range(size):
            covered[a + j : b + j] |= hit
    return int(np.count_nonzero(covered))


def statistics(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row of :data:`NAMES` for each text (null: empty).

    Words are runs outside ``\\x20 \\x09-\\x0D``; a line that repeats an earlier line of the
    text and has a word is a duplicate; words in 8-word windows that occur twice or more in the
    text are repeated; n_short are words of up to three bytes.
    """
    offsets, data = T.string_buffers(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)))
    if not len(data):
        return out
    hist = np.zeros((n, 256), np.int64)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for at in range(a, b, _SEGMENT):
            hist[k] += np.bincount(data[at : min(b, at + _SEGMENT)], minlength=256)
    chars = hist @ _CLASSES
    starts, ends, first = T.word_spans(offsets, data)
    short = _per_text(first, ends - starts <= 3)
    del ends
    line_start, line_end, line_first = T.word_spans(offsets, data, NEWLINE)
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    del starts, line_start, line_end
    n_lines = _per_text(line_first, has_word)
    lines, _ = T.word_hashes(offsets, data, lower=False, gaps=NEWLINE)
    dup = n_lines - _distinct(lines[has_word], np.concatenate([[0], np.cumsum(n_lines)]))
    del lines, has_word
    words, _ = T.word_hashes(offsets, data, lower=False)
    repeated = _repeated(words, first)
    distinct = _distinct(words, first)
    share = hist / np.maximum(hist.sum(axis=1), 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.nansum(np.where(share > 0, share * np.log2(share), 0), axis=1)
    columns = (np.diff(first), chars[:, 0], chars[:, 1], dup, repeated, chars[:, 2], n_lines, *(chars[:, k] for k in range(3, 8)), distinct, short, entropy)
    for k, c in enumerate(columns):
        out[:, k] = c
    return out


def features(stats: np.ndarray) -> np.ndarray:
    """Near-normal transforms of the statistics: logarithms of sizes, square roots of shares."""
    s = dict(zip(NAMES, stats.T))
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_chars"], 1), np.maximum(s["n_lines"], 1)
    root = lambda a, b: np.sqrt(np.clip(a / b, 0, None))
    return np.stack([
        np.log1p(s["n_words"]), np.log1p(s["word_chars"] / words), np.log1p(words / lines),
        root(s["n_symbols"], chars), root(s["n_bars"], chars), root(s["n_bangs"], chars),
        root(s["n_upper"], chars), root(s["n_digits"], chars), root(s["n_punct"], chars),
        root(s["n_dup_lines"], lines), root(s["n_repeat_words"], words),
        np.log1p(s["n_distinct"]) - np.log1p(s["n_words"]) * 0.85, root(s["n_short"], words), s["entropy"],
    ], axis=1)


FEATURES = ("log_words", "word_length", "line_length", "symbols", "bars", "bangs", "upper", "digits", "punct", "dup_lines", "repeat_words", "distinct", "short", "entropy")
