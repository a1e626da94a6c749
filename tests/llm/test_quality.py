import random

import numpy as np
import pytest

import plain
from scorelake.llm import arrays as A
from scorelake.llm import quality_rank as R
from scorelake.llm import quality_rules as Q
from scorelake.llm import text_measures as M

COMMON = {"en": "the of and to in is it on as was".split(), "xx": "ba be bi bo bu da de di do du".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(COMMON[lang]) if rng.random() < 0.4 else "".join(rng.choice("aeioklmnrst") for _ in range(rng.randint(3, 8)))
                    for _ in range(n))


def given():
    rng = random.Random(2)
    rows = [(prose(rng, lang, rng.randint(120, 300)), lang) for lang in ("en", "xx") for _ in range(40)]
    odd = [" ".join(w + "###" for w in prose(rng, "en", 150).split()), prose(rng, "en", 150).upper() + "!!",
           " ".join("%d" % rng.randint(0, 9**9) for _ in range(150)), " ".join("zz%dq" % rng.randint(0, 99999) for _ in range(300))]
    rest = [None, "", " \n\t", "a b\na b\n a b\n\na b", "x y z x y z x y z", "é" * 300, "tab\there\x0bnow\x0cthen\r\n# | <b>", "w " * 3000,
            prose(rng, "en", 49), prose(rng, "en", 50), "long " + "y" * 200_000]
    return [(i, t, lang) for i, (t, lang) in enumerate(rows + [(t, "en") for t in odd] + [(t, None) for t in rest] + rows[:2])]


def test_rules_against_plain_counts(spark):
    rows = given()
    table = spark.createDataFrame([(i, t, lang, 1) for i, t, lang in rows], "doc_id long, text string, lang string, kept int")
    got = {r.doc_id: r for r in Q.quality_rules(table, ["doc_id"]).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        n, chars, symbols, lines, inside = plain.base_counts(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, inside), text
        assert r.base_failed == (n < 50 or 100 * inside > 50 * n)
        assert not (r.kept and r.base_failed)
    assert all(got[i].kept for i in range(80))
    assert not any(got[i].kept for i in range(80, 84))
    assert got[0].language == "en" and got[79].language == "xx"


def test_references_against_plain_shares(spark):
    rows = given()
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    ref = Q.references(table)
    assert ref.languages == ("en", "xx")
    used = [w for _, t, lang in rows if lang == "en" for w in plain.words(plain.lower(t))]
    common = {w for w in set(used) if 200 * used.count(w) >= len(used)}
    data, offsets = A.text_bytes(__import__("pyarrow").array([" ".join(sorted(common))]))
    keys = A.signed(A.Words(data, offsets).hashes())
    own = ref.words[0][:-1] > 0
    assert set(ref.common[own]) == set(keys.tolist())
    assert np.allclose(ref.words.sum(axis=1), 1) and np.allclose(ref.classes.sum(axis=1), 1)


def test_distance():
    p, q = np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]]), np.array([0.5, 0.5, 0.0])
    assert np.allclose(Q.js_distance(p, q), [0, 1])
    a, b = np.array([[0.9, 0.1]]), np.array([0.5, 0.5])
    m = (a[0] + b) / 2
    assert np.isclose(Q.js_distance(a, b)[0] ** 2, (sum(a[0] * np.log2(a[0] / m)) + sum(b * np.log2(b / m))) / 2)


def test_no_references_without_enough_words(spark):
    table = spark.createDataFrame([(1, "few words " * 10, "en"), (2, " ".join(f"v{i}" for i in range(80)), None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in Q.quality_rules(table, ["doc_id"]).collect()}
    assert not got[1].kept and got[2].kept and got[2].language is None and got[2].class_distance is None
    assert Q.quality_rules(table.limit(0), ["doc_id"]).collect() == []


def test_copies_and_repetitive_texts_do_not_move_a_reference(spark):
    rng = random.Random(4)
    clean = [prose(rng, "en", 200) for _ in range(40)]
    plain_ref = Q.references(spark.createDataFrame([(t, "en") for t in clean], "text string, lang string"))
    flood = " ".join(f"z{i}" for i in range(150))
    odd = [flood] * 200 + ["la li lo " * 4000, "mo mu " * 9000]
    moved = Q.references(spark.createDataFrame([(t, "en") for t in clean + odd], "text string, lang string").repartition(5))
    both = [dict(zip(r.common.tolist(), r.words[0])) for r in (plain_ref, moved)]
    assert all(abs(share - both[1].get(key, 0)) < 0.02 for key, share in both[0].items())
    # One text of many words weighs as much as one of a thousand.
    long_text = " ".join(f"q{i % 100}" if i % 2 else f"u{i}" for i in range(40_000))
    moved = Q.references(spark.createDataFrame([(t, "en") for t in [*clean, long_text]], "text string, lang string"))
    assert abs(moved.words[0][-1] - plain_ref.words[0][-1]) < 0.1


def test_a_language_without_a_reference_is_not_held_against_others(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, "en", 200), "en") for i in range(40)]
    other = " ".join("".join(rng.choice("бвгджзклмн") for _ in range(5)) for _ in range(150))
    rows += [(100, other, "yy"), (101, other, None), (102, "у " * 150, "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in Q.quality_rules(docs, ["doc_id"]).collect()}
    assert got[100].kept and got[100].language is None and got[100].word_distance is None
    assert not got[101].kept and not got[102].kept and got[0].kept and got[0].language == "en"


def labelled(n=600):
    rng = random.Random(8)
    out = []
    for i in range(n):
        good = rng.random() < 0.8
        text = prose(rng, "en", rng.randint(30, 200))
        if not good:
            text = rng.choice([text.upper() + "!!!", " ".join(w + "$$$" for w in text.split()), " ".join([text.split()[0]] * 60)])
        out.append((i, text, int(good)))
    return out


def test_ranking_on_documents_it_never_saw(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, "x"), (9001, "", "x"), (None, "some words", "x")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(0, None, 0), (None, 1, 0), (9001, 5, 0)], "doc_id long, quality int, toxic int")
    model = R.learned(docs, labels)
    got = {r.doc_id: r.score for r in R.quality_scores(docs, model, ["doc_id"]).collect()}
    unseen = [(got[i] >= R.CUT_SCORE) == bool(q) for i, _, q in rows if plain.held_out(i)]
    assert len(unseen) > 80 and np.mean(unseen) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[9000] == got[9001]


def test_labels_of_held_out_documents_do_not_count(spark):
    rows = labelled(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    models = []
    for flip in (False, True):
        labels = [(i, 1 - q if flip and plain.held_out(i) else q) for i, _, q in rows]
        models.append(R.learned(docs, spark.createDataFrame(labels, "doc_id long, quality int")))
    assert np.allclose(models[0].weights, models[1].weights) and models[0].cut == models[1].cut


@pytest.mark.parametrize("rows", [[], [(1, 1)], [(1, 0), (2, 0)]])
def test_no_pair_of_labels(spark, rows):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    model = R.learned(docs, labels)
    assert model is None and {r.score for r in R.quality_scores(docs, model, ["doc_id"]).collect()} == {0.5}
    assert R.quality_scores(docs.limit(0), model, ["doc_id"]).collect() == []


def test_features_do_not_depend_on_the_slice():
    import pyarrow as pa

    texts = [t for _, t, _ in given()]
    whole = np.concatenate([R.features(A.Words(d, o)) for _, _, d, o in A.slices(pa.array(texts))])
    alone = np.concatenate([R.features(A.Words(d, o)) for t in texts for _, _, d, o in A.slices(pa.array([t], pa.string()))])
    assert np.allclose(whole, alone)


def test_repeated_lines_at_the_edges():
    import pyarrow as pa

    texts = ["a\na", "a\n", "\n\n", "a\nb\na\nb\n a", None, "a", "b\r\nb\r\nb"]
    for _, _, d, o in A.slices(pa.array(texts)):
        assert M.repeated_lines(A.Words(d, o)).tolist() == [plain.base_counts(t)[3] for t in texts]
