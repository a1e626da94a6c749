import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scorelake.llm import alignment as L
from scorelake.llm.alignment import aligned_documents, alignments, pair_counts, piece_tokenizer, same_bytes
from scorelake.llm.byte_tokens import byte_letters

FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    letters = byte_letters()
    a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in range(a.get_vocab_size())]
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in range(b.get_piece_size()) for p in [b.id_to_piece(i)]]
    return a, b, a_bytes, b_bytes


def plainly(texts, sides):
    """Per text its groups, straight from the definition."""
    a, b, a_bytes, b_bytes = sides
    out = []
    for text in texts:
        groups = []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            want = (" " + text).encode()
            if all(b"".join(t[i] for i in x) == want for x, t in zip(ids, (a_bytes, b_bytes))):
                ends = [np.cumsum([len(t[i]) for i in x]).tolist() for x, t in zip(ids, (a_bytes, b_bytes))]
                low = [0, 0]
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    high = [e.index(cut) + 1 for e in ends]
                    groups.append(tuple(x[s:t] for x, s, t in zip(ids, low, high)))
                    low = high
        out.append(groups)
    return out


def results(texts, sides):
    held = plainly(texts, sides)
    links = [Counter((x, y) for p, q in groups for x in p for y in q) for groups in held]
    count = Counter(pair for c in links for pair in c)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    rows = []
    for groups, own in zip(held, links):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        rows.append((sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), own.total(),
                     sum(n for (x, y), n in own.items() if count[x, y] == best[x]), sum(n * count[p] for p, n in own.items()),
                     hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return rows, count


def texts():
    rng = random.Random(2)
    words = "the of running naïve Übergröße 漢字かな 🙂👍🏽 <|endoftext|> </s> <unk> <0x41> don't 12345 3.14 x_y --- … ﬁ   ​ été über straße niño".split(" ")
    out = [None, "", " ", "  ", "\n", "a", " a", "a ", "x  y\t\tz\r\n\n  w", "has ▁ in it", "▁", "\x00", "a\x00b", "﻿bom", "é", " ", "ab" * 400,
           "漢字" * 300, "=" * 700, " " * 300 + "x", "word " * 900, "<|endoftext|>", "the", "the", "the"]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 50))) for _ in range(120)]
    out += ["".join(rng.choice("ab \né漢.1") for _ in range(rng.randint(1, 200))) for _ in range(80)]
    out += [out[30]] * 40
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("small", [False, True])
def test_equal_to_the_definition(spark, sides, monkeypatch, small):
    if small:
        for name, value in (("HELD_PAIRS", 4), ("CUT", 20)):
            monkeypatch.setattr(L, name, value)
    given = texts()
    docs = spark.createDataFrame([(i if i % 9 else None, t, i, "x") for i, t in enumerate(given)], "doc_id long, text string, n_a int, row string")
    out = aligned_documents(docs.repartition(3), *FILES, top_pairs=7 if small else L.TOP_PAIRS)
    got = sorted([(r.doc_id, *(r[c] for c in COLUMNS)) for r in out.collect()], key=repr)
    rows, _ = results(given, sides)
    assert got == sorted([(i if i % 9 else None, *r) for i, r in enumerate(rows)], key=repr)


def test_pair_counts(spark, sides):
    given = texts()
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    found = pair_counts(alignments(docs, *FILES), *FILES).collect()
    _, count = results(given, sides)
    assert {(r.a, r.b): r.documents for r in found} == dict(count) and len(found) == len(count)


def test_same_bytes_and_cut_texts(sides):
    _, b, a_bytes, b_bytes = sides
    same = same_bytes(*FILES)
    known = set(b_bytes[3:])
    assert len(same) == len(a_bytes)
    for i, x in enumerate(a_bytes[:-1]):
        assert b_bytes[same[i]] == x if same[i] >= 0 else x not in known
    held, rng = piece_tokenizer(FILES[2]), random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "the", " ", "  ", "    ", "é", "漢", "\n", "x ", " "]) for _ in range(rng.randint(1, 60)))
        cut, L.CUT = L.CUT, rng.randint(1, 30)
        try:
            assert held.encode(text).tolist() == b.encode(text)
        finally:
            L.CUT = cut


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert aligned_documents(docs, *FILES).collect() == []
    docs = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert [tuple(r[c] for c in COLUMNS) for r in aligned_documents(docs, *FILES).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
