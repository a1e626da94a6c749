import random

import pytest

import plain
from scorelake.llm.repeats import repeated_passages, without_repeats

LENGTH = 50


def corpus(seed=6):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randint(0, 3000)}"
    run = lambda n: [word() for _ in range(n)]
    shared = [run(n) for n in (49, 50, 51, 60, 85, 130, 400)]
    texts = [None, "", "short", " ".join(["again"] * 300)]
    for _ in range(60):
        parts = run(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(shared)
            cut = rng.randint(0, 10) if rng.random() < 0.4 else 0
            parts += passage[cut:] + run(rng.randint(0, 70))
        texts.append(" ".join(parts))
    whole = run(300)
    texts += [" ".join(whole)] * 3 + ["  ".join(whole[:200] + ["odd"] + whole[201:])]
    texts.append(" ".join(run(60) + shared[5] + run(5) + shared[5]))
    return texts


def tables(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string").coalesce(1)


@pytest.mark.parametrize("seed", [6, 7])
def test_passages_against_every_window(spark, seed):
    texts = corpus(seed)
    want = plain.repeated_words(texts, LENGTH)
    got = {}
    for r in repeated_passages(tables(spark, texts)).collect():
        for k in range(r.n_words - LENGTH + 1):
            place = (r.doc_id, r.start_word + k)
            assert place not in got
            got[place] = (r.first_doc_id, r.first_word + k)
    assert got == want
    assert len({i for i, _ in want}) > 20


def test_cut_texts(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4")  # batches with and without a cut in one task
    try:
        check_cut_texts(spark)
    finally:
        spark.conf.set(name, before)


def check_cut_texts(spark):
    texts = [f"lone text {i}" for i in range(20)] + corpus()
    want = plain.repeated_words(texts, LENGTH)
    left = {}
    for i, text in enumerate(texts):
        gone = {s + k for (d, s), first in want.items() if d == i and first != (d, s) for k in range(LENGTH)}
        if not gone:
            left[i] = text
        elif len(gone) < len(plain.words(text)):
            left[i] = [w for s, w in enumerate(plain.words(text)) if s not in gone]
    out = without_repeats(tables(spark, texts))
    assert out.columns == ["doc_id", "text", "row"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert set(got) == set(left)
    for i, text in left.items():
        assert got[i] == text if not isinstance(text, list) else plain.words(got[i]) == text
    assert repeated_passages(out).collect() == [] or all(r.first_doc_id is not None for r in repeated_passages(out).collect())


def test_ids_that_are_null_or_repeat_and_an_empty_table(spark):
    text = " ".join(f"t{i}" for i in range(70))
    rows = [(None, text), (4, text), (4, text), (5, "b"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = repeated_passages(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in found if r.doc_id) == [(False, 4), (False, 4)] and len(found) == 3
    assert all((r.first_doc_id, r.first_word, r.n_words) == (None, 0, 70) for r in found)
    assert sorted(map(str, (tuple(r) for r in without_repeats(docs).collect()))) == sorted(map(str, [(None, text), (5, "b"), (None, None)]))
    assert repeated_passages(docs.limit(0)).collect() == [] and without_repeats(docs.limit(0)).collect() == []


def test_a_very_long_text_with_itself(spark):
    rng = random.Random(1)
    half = " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(60_000))
    found = repeated_passages(spark.createDataFrame([(1, half + " mid " + half)], "doc_id long, text string")).collect()
    assert sorted((r.start_word, r.n_words, r.first_word) for r in found) == [(0, 60_000, 0), (60_001, 60_000, 0)]
