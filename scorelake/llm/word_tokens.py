"""Token ids of whole texts by a word-level byte-pair tokenizer file.

The tokenizer lower-cases, drops white space and merges inside the pieces of each word, so a word's ids do
not depend on its neighbours. Each distinct word of a slice of texts is tokenized once, all in one call of
``tiktoken`` over the tokenizer's own vocabulary with its merge order as ranks; texts are then put together from
the words' ids in numpy. A piece's end is a character of its own there, which the vocabulary's word-end entries
absorb first. Words for which the two libraries could differ go to ``tokenizers`` itself: those holding that
character, a special token, white space of Unicode, letters whose case depends on their place, or more than
``LONG`` bytes. So do words with a character that the libraries' tables of Unicode, which are of different versions, treat
unlike: every character beyond ASCII is tried in both when a worker first meets it.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa

from scorelake.llm import arrays as A

#: Bytes from which on a word is left to ``tokenizers``.
LONG = 400
END = "\x00"
#: Bytes of text whose distinct words are tokenized together, which bounds the memory of a task.
SLICE = 2 << 20

# Fixed value: the pattern of the tokenizer's pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.cache
def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabularies of byte-level tokenizers."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        letters, end = byte_letters(), held["model"]["end_of_word_suffix"]
        special = {t["content"] for t in held["added_tokens"]}
        # Characters a special token can start with, and those that case or white space rules treat by context.
        self.odd = regex.compile("[\\s\x1c-\x1fΣİ]|" + "|".join(regex.escape(t) for t in sorted(special)))
        ranks: dict[bytes, int] = {}
        for token, rank in held["model"]["vocab"].items():
            if token not in special:
                stem = token.removesuffix(end)
                ranks[bytes(letters[c] for c in stem) + (END.encode() if stem != token else b"")] = rank
        self.fast = tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})
        self.gap = ranks[b" " + END.encode()]
        self.pieces = regex.compile(PIECES + "| ")
        self.alike: set[str] = set(map(chr, range(128)))
        self.unlike: set[str] = set()

    def _quick(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that spaces part, and how many each has."""
        found = self.pieces.findall(unicodedata.normalize("NFC", text).lower())
        found.append("")
        ids = np.array(self.fast.encode_ordinary(END.join(found)), np.uint32)
        gaps = np.flatnonzero(ids == self.gap)
        return np.delete(ids, gaps), np.diff(np.concatenate(([-1], gaps, [len(ids)]))) - 1

    def _exact(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.exact.encode_batch_fast(words, add_special_tokens=False)]

    def _try(self, letters: list[str]) -> None:
        """Learn for new characters whether both libraries give the same ids: as a letter or mark among letters, among
        signs, and before and after marks, whose order follows from the class of each."""
        words = [w for c in letters for w in (f"a{c}a", f".{c}.", f"a\u0345{c}", f"a{c}\u0334")]
        ids, size = self._quick(" ".join(words))
        if len(size) != len(words) and len(letters) > 1:  # one of them parts words here
            for c in letters:
                self._try([c])
            return
        ends = np.cumsum(size)
        quick = [ids[a:b].tolist() for a, b in zip(ends - size, ends)]
        same = [a == b for a, b in zip(quick, self._exact(words))] if len(size) == len(words) else [False] * 4
        for i, c in enumerate(letters):
            # Marks beyond the first plane may compose in one version and not in the other.
            alike = all(same[4 * i:4 * i + 4]) and not (c > "\uffff" and unicodedata.category(c)[0] == "M")
            (self.alike if alike else self.unlike).add(c)

    def _hard(self, word: str) -> bool:
        return END in word or bool(self.odd.search(word)) or not self.unlike.isdisjoint(word)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has. No word holds a separator of texts."""
        text = b" ".join(words).decode("utf-8", "replace")
        if not text.isascii():
            self._try([c for c in set(text) - self.alike - self.unlike if not self.odd.search(c)])
        hard = [i for i, w in enumerate(words) if len(w) >= LONG]
        if hard or self._hard(text.replace(" ", "")):
            hard = [i for i, w in enumerate(words) if len(w) >= LONG or self._hard(w.decode("utf-8", "replace"))]
            out = set(hard)
            text = " ".join(w.decode("utf-8", "replace") for i, w in enumerate(words) if i not in out)
        size = np.zeros(len(words), np.int64)
        ids = np.empty(0, np.uint32)
        if len(hard) < len(words):
            easy = np.ones(len(words), bool)
            easy[hard] = False
            ids, size[easy] = self._quick(text)
        if hard:
            more = self._exact([words[i].decode("utf-8", "replace") for i in hard])
            parts, at = [], 0
            ends = np.cumsum(size)
            for i, e in zip(hard, more):
                parts += [ids[at:ends[i]], np.array(e, np.uint32)]
                at, size[i] = ends[i], len(e)
            ids = np.concatenate([*parts, ids[at:]])
        return ids, size

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and where each begins and ends among them."""
        words = A.Words(data, offsets)
        if not len(words.start):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        _, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        raw = data.tobytes()
        flat, size = self.words([raw[a:b] for a, b in zip(words.start[first].tolist(), words.stop[first].tolist())])
        begin = np.cumsum(size) - size
        n = size[inverse]
        ends = np.concatenate(([0], np.cumsum(n)))
        place = np.arange(ends[-1]) + np.repeat(begin[inverse] - ends[:-1], n)
        return flat[place], ends[words.bounds]


@functools.cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process."""
    return WordTokenizer(path)


def token_slices(column: pa.Array, path: str):
    """(first row, ids, bounds) of each slice of texts."""
    tokenizer = word_tokenizer(path)
    for low, _, data, offsets in A.slices(column, SLICE):
        ids, bounds = tokenizer.slice(data, offsets)
        yield low, ids, bounds
