"""Counts of a slice of texts that the quality operators share."""

from __future__ import annotations

import numpy as np

from scorelake.llm import arrays as A

CLASSES = ("lower", "upper", "digit", "blank", "stop", "mark", "symbol", "wide")

# The characters counted as symbols by the rules.
SYMBOLS = b"#*$%&|<>"


def _class_table() -> np.ndarray:
    """Class of every byte; the bytes that continue a character of UTF-8 have none (255)."""
    table = np.full(256, CLASSES.index("symbol"), np.uint8)
    for name, chars in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)),
                        ("blank", (*range(9, 14), 32)), ("stop", b".,;:'\"()-?"), ("mark", b"!"),
                        ("wide", range(0xC0, 256)), (None, range(0x80, 0xC0))):
        table[list(chars)] = 255 if name is None else CLASSES.index(name)
    return table


CLASS_OF_BYTE = _class_table()
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def base_counts(words: A.Words, h: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, offsets = words.data, words.offsets
    leads = (data & 0xC0) != 0x80
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": A.sums(leads & words.solid, offsets),
        "n_symbols": A.sums(_IS_SYMBOL[data], offsets),
        "n_dup_lines": repeated_lines(words),
        "n_repeat_words": repeated_words(words, h, 3),
    }


def repeated_lines(words: A.Words) -> np.ndarray:
    """Lines that hold a word and equal an earlier line of their text."""
    data, offsets = words.data, words.offsets
    n = len(offsets) - 1
    cuts = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate((offsets[:-1][offsets[:-1] < offsets[1:]], cuts + 1)))
    start = start[start < len(data)]
    if not len(start):
        return np.zeros(n, np.int64)
    text = np.searchsorted(offsets, start, side="right") - 1
    ends = np.append(start[1:], len(data))
    stop = np.where(data[ends - 1] == 10, ends - 1, ends)
    full = np.add.reduceat(words.solid.astype(np.int64), start) > 0
    start, stop, text = start[full], stop[full], text[full]
    key = A.joined(A.run_hashes(A.byte_sums(data), start, stop), text.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    again = order[1:][key[order[1:]] == key[order[:-1]]]
    return np.bincount(text[again], minlength=n)


def repeated_words(words: A.Words, h: np.ndarray, k: int) -> np.ndarray:
    """Words inside runs of ``k`` words that occur twice or more in their text, the first time included."""
    n = len(h)
    inside = words.window_mask(k)
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(len(words.counts), np.int64)
    key = A.joined(A.window_hashes(h, k)[at], words.text_of_word()[at].astype(np.uint64))
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(words.counts), np.int64)
    at = at[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
    cover = np.zeros(n + k, np.int64)
    cover[at] += 1
    cover[at + k] -= 1
    return A.sums(np.cumsum(cover)[:n] > 0, words.bounds)


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Characters of each class, one row for each text."""
    kind = CLASS_OF_BYTE[data]
    out = np.empty((len(offsets) - 1, len(CLASSES)), np.int64)
    for c in range(len(CLASSES)):
        out[:, c] = A.sums(kind == c, offsets)
    return out
