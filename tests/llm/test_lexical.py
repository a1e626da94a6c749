import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import plain
from scorelake.llm import arrays as A
from scorelake.llm import lexical as L
from scorelake.llm.lexical import ranked_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(plain.lower(text))


def ranking(docs, items, k):
    """(item, rank, doc_id, score), straight from the definition; nulls after all ids."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for doc, bag in bags:
            m = 75 + 25 * bag.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * bag[t] // (1000 * bag[t] + 12 * m))
                        for t in terms(text) if bag[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return out


def corpus():
    rng = random.Random(6)
    words = ["the", "Of", "naïve", "x1", "42", "漢字", "ÀB", "àb", "it's", "co-op", "z_z", "tail."] + [f"w{i}" for i in range(60)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    texts = [None, "", " .,-", "\x00\x00", "the", "THE the", "word " * 20000] + [text(rng.randint(1, 60)) for _ in range(150)]
    texts += [texts[20]] * 60 + [texts[21] + " !"] * 30 + ["of the w1"] * 25  # groups of one bag
    docs = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    docs += [(3000, text(9)), (3000, text(9)), (None, texts[20]), (None, "w1 w2 w3")]
    items = [(i, text(rng.randint(1, 30))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "?!"), (103, "unknown"), (104, "the the THE of"), (104, "the the THE of"), (None, "w1 W1 w2"),
              (105, texts[20]), (106, "word " * 3000)]
    return docs, items


@pytest.mark.parametrize("k,block", [(20, 1 << 20), (3, 300)])
def test_rankings_equal_the_definition(spark, monkeypatch, k, block):
    if k == 3:
        monkeypatch.setattr(L, "HELD_SCORES", 200)
    docs, items = corpus()
    held = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, item_id string").repartition(5)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id int, text string, doc_id long").repartition(2)
    out = ranked_documents(held, asked, k, block_bytes=block)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.schema["item_id"].dataType == asked.schema["item_id"].dataType
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(ranking(docs, items, k), key=repr)


def test_empty_tables_and_items_without_terms(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_documents(docs.limit(0), items).collect() == []
    assert ranked_documents(docs, items.limit(0)).collect() == []
    assert ranked_documents(docs, items.selectExpr("item_id", "'..' as text")).collect() == []
    only_blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert ranked_documents(only_blank, items).collect() == []


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    words = ["aa", "bb", "ab", "abc", "q"]
    monkeypatch.setattr(A, "run_hashes", lambda total, start, stop: (stop - start).astype(np.uint64) % np.uint64(2))
    known = L.Vocabulary([w.encode() for w in words])
    text = "bb zz abc AB q aa r aab"
    data = np.frombuffer(text.encode(), np.uint8)
    at, number = known.numbers(L.Terms(data, np.array([0, len(data)])))
    assert [(text.split()[i].lower(), words[n]) for i, n in zip(at, number)] == [(w, w) for w in ("bb", "abc", "ab", "q", "aa")]
