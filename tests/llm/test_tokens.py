import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from scorelake.llm import packing as P
from scorelake.llm.byte_tokens import byte_tokenizer, decoded, encoded
from scorelake.llm.word_tokens import token_slices

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORD_FILE, BYTE_FILE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def texts():
    rng = random.Random(3)
    odd = ["", " ", "a\x00b c", "İstanbul ΣΑΣ ΟΔΟΣ", "it's we'LL don't 12 345", "<|endoftext|> x<|startoftext|>y<|endoftext|>", "é é ́x a\xa0b a b",
           "x" * 1000, "漢字かな 漢 字" * 40, "\x1ca b\x1fc", "!!!'s ..'ll", "​zero ﻿bom", "🙂👍🏽 ok", "ǅ ẞ ﬁ K Å", "a\u0085b", "Ab" * 700,
           "=" * 3000 + " end", " " * 900 + "x", "\n" * 700, "1" * 800, "ab ab" * 500, "loooo" * 400 + "\n\n  " + "-" * 513 + "'s"]
    letters = "aab eé'x \n.1漢<|"
    odd += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 400))) for _ in range(150)]
    odd += ["".join(rng.choice("abcdehinorst") for _ in range(rng.randint(257, 3000))) for _ in range(25)]
    return odd


def test_word_tokens_equal_the_library():
    given = [None, *texts()]
    tokenizer = Tokenizer.from_file(WORD_FILE)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in given]
    got = []
    for _, ids, bounds in token_slices(pa.array(given), WORD_FILE):
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == want


def test_word_tokens_of_every_code_point():
    rng = random.Random(8)
    letters = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    given = [f"x{c}y {c} .{c}" for c in letters[:0x32000]] + [f"{c}z{c}" for c in letters[0x32000::97]]
    for low in range(0, 0x1F000, 64):  # texts of a few letters of one block, where marks meet marks
        block = letters[low:low + 64] + ["a", "\u0301", " "]
        given += ["".join(rng.choice(block) for _ in range(12)) for _ in range(4)]
    tokenizer = Tokenizer.from_file(WORD_FILE)
    want = [e.ids for e in tokenizer.encode_batch(given, add_special_tokens=False)]
    got = []
    for _, ids, bounds in token_slices(pa.array(given), WORD_FILE):
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert [g for g, a, b in zip(given, got, want) if a != b] == []


def test_byte_tokens_equal_the_library_and_come_back(spark):
    given = [(i, t, 0) for i, t in enumerate([None, *texts()])] + [(None, "x", 0), (1, "x", 0), (1, "x", 0)]
    tokenizer = Tokenizer.from_file(BYTE_FILE)
    docs = spark.createDataFrame(given, "doc_id long, text string, ids int")
    ids = encoded(docs, BYTE_FILE, public_tokenizers.PATTERN, ["doc_id"])
    rows = ids.collect()
    assert len(rows) == len(given)
    for (i, text, _), r in zip(given, rows):
        assert r.doc_id == i and r.ids == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)[:60]
    back = decoded(ids, BYTE_FILE, public_tokenizers.PATTERN, ["doc_id"]).collect()
    assert [r.text for r in back] == [t or "" for _, t, _ in given]
    assert encoded(docs.limit(0), BYTE_FILE, public_tokenizers.PATTERN, ["doc_id"]).collect() == []
    lists = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [r.text for r in decoded(lists, BYTE_FILE, public_tokenizers.PATTERN, ["k"]).collect()] == ["", ""]


@pytest.mark.parametrize("seed", range(3))
def test_tree_joins_equal_merging_whole(seed):
    tokenizer = byte_tokenizer(BYTE_FILE, public_tokenizers.PATTERN)
    rng = random.Random(seed)
    for _ in range(60):
        alphabet = rng.choice(["ab", "aehinrst", "ationeg", "é漢a", "lo", "z"])
        data = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 1500))).encode()
        assert tokenizer.piece(data) == tokenizer.fast._core_bpe.encode_single_piece(data)


def pieces_of(rows):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    return docs, sequences


def test_packing_keeps_every_id_once_and_pads_little(spark):
    rng = random.Random(4)
    tokenizer = Tokenizer.from_file(WORD_FILE)
    given = {i: " ".join(rng.choice(["alpha", "beta", "it's", "gamma!", "42"]) for _ in range(int(rng.lognormvariate(5, 1.3)))) for i in range(600)}
    given |= {600: None, 601: "", 602: " \n", 603: "word " * 30_000}
    docs = spark.createDataFrame(list(given.items()), "doc_id long, text string").repartition(3)
    rows = P.packed(docs, WORD_FILE).collect()
    by_doc, by_sequence = pieces_of(rows)
    assert set(by_doc) == set(given)
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [t for r in pieces for t in r.ids] == [*tokenizer.encode(given[i] or "", add_special_tokens=False).ids, 1]
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces[:-1]]]).tolist()
        assert all(r.length == len(r.ids) > 0 and r.doc_tokens == sum(x.length for x in pieces) for r in pieces)
    padding = total = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        size = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == np.cumsum([0, *[r.length for r in pieces[:-1]]]).tolist() and size <= P.CAPACITY
        total += size
        padding += 0 if size & (size - 1) == 0 else P.CAPACITY - size
    assert padding < 0.02 * total


def test_packing_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c", 1), (3, "a", 2), (3, "a", 2)], "doc_id long, text string, sequence_id int")
    rows = P.packed(docs, WORD_FILE, capacity=8).collect()
    assert sorted((r.doc_id or -1, r.doc_tokens) for r in rows if r.start == 0) == [(-1, 4), (3, 2), (3, 2)]
    assert P.packed(docs.limit(0), WORD_FILE).collect() == []
    with pytest.raises(ValueError):
        P.packed(docs, WORD_FILE, capacity=1000)


def test_cuts_fill_their_classes():
    for capacity in (64, 2048):
        doc, start, size, kind = P.cuts(np.arange(0, 3 * capacity), capacity)
        assert (size * kind <= capacity).all() and (size > 0).all()
        assert (size * kind >= (1 - P.SLACK) * capacity - kind).all()
        assert np.array_equal(np.bincount(doc, size, 3 * capacity), np.arange(0, 3 * capacity))


def test_digest_of_pieces(spark):
    from scorelake.llm.token_queries import _piece_digests

    rows = P.packed(spark.createDataFrame([(1, "one two three " * 900)], "doc_id long, text string"), WORD_FILE)
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    crc = {(r.start): r.ids_crc32 for r in rows.mapInArrow(_piece_digests, kinds).collect()}
    assert crc == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows.collect()}
