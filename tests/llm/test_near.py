import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from scorelake.llm import near_text as N
from scorelake.llm.components import components
from scorelake.llm.near_text import near_duplicates
from scorelake.llm.vectors import near_vectors

VOCAB = [f"w{i}" for i in range(400)]


def altered(rng, words, share):
    return [rng.choice(VOCAB) if rng.random() < share else w for w in words]


def corpus(seed=3):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "one", "One", "two words", "TWO words", "a b c", "a b c", "é à", "x" * 5000]
    for n in (4, 6, 12, 30, 63, 64, 70, 80, 81, 90, 200, 1200):
        base = [rng.choice(VOCAB) for _ in range(n)]
        texts += [" ".join(base), "  ".join(base).upper()]
        texts += [" ".join(altered(rng, base, share)) for share in (0.02, 0.05, 0.08, 0.1, 0.15, 0.3) for _ in range(2)]
        texts += [" ".join(base[:-1]), " ".join(base[1:] + ["tail"])]
    rng.shuffle(texts)
    return texts


def found(df, key):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_all_pairs(spark, size):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(texts)], "doc_id long, text string, key string, row int").repartition(5)
    got = found(near_duplicates(docs, size=size, limit=0.8), "doc_id")
    counts, roots = plain.near_components(texts, size, 0.8)
    assert [got[i].n_shingles for i in range(len(texts))] == counts
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert all(got[i].kept == (roots[i] == i) for i in range(len(texts)))
    assert len(set(roots)) < len(texts) - 40


def test_a_bucket_of_many_near_copies_and_a_chain(spark):
    rng = random.Random(5)
    base = [rng.choice(VOCAB) for _ in range(150)]
    texts = [" ".join(altered(rng, base, 0.01)) for _ in range(300)]
    words = list(base)
    for i in range(0, 120, 4):  # every text is near the one before it, not the first
        words[i:i + 4] = ["z%d" % i] * 4
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = found(near_duplicates(docs, size=2, limit=0.8), "doc_id")
    _, roots = plain.near_components(texts, 2, 0.8)
    assert [got[i].component_id for i in range(len(texts))] == roots


def test_null_and_repeated_ids_and_an_empty_table(spark):
    docs = spark.createDataFrame([(7, "a b c d"), (None, "a b c d"), (7, "a b c d"), (3, "A B c d"), (None, "else where now"), (5, None), (5, None)],
                                 "doc_id long, text string")
    rows = near_duplicates(docs, size=2, limit=0.8).collect()
    same = [r for r in rows if r.component_id == 3]
    assert sorted((r.doc_id is None, r.doc_id) for r in same if r.doc_id) == [(False, 3), (False, 7), (False, 7)]
    assert len(same) == 4 and [r.doc_id for r in same if r.kept] == [3]
    assert sum(r.kept for r in rows) == 1 + 1 + 2
    assert near_duplicates(docs.limit(0)).collect() == []


def test_registers_and_estimate():
    assert N.registers(np.array([1 << 59, 1, 0], np.uint64), 60).tolist() == [0, 59 << 10, 60 << 10]
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate((a[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)))
    for sketch in (N.small_sketch, N.large_sketch):
        x, y = (np.frombuffer(sketch(np.unique(s)), "<u2")[None] for s in (a, b))
        assert abs(N.estimated(x, y, np.array([1000.0]), np.array([1000.0]))[0] - 800 / 1200) < 0.17


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    out = [None, [0.0] * 16, [1.0, None] * 8, [float("nan")] + [1.0] * 15, [float("inf")] + [0.0] * 15, [1.0, 2.0], [2.0, 4.0], [], [1e300] * 16, [1e-300] * 16]
    for spread in (0.02, 0.05, 0.08, 0.12):
        centre = rng.standard_normal(16)
        out += [list(map(float, centre / np.linalg.norm(centre) + spread * rng.standard_normal(16))) for _ in range(60)]
    out += [list(map(float, v)) for v in rng.standard_normal((200, 16))]
    out += [out[50], out[50]]
    return out


def test_near_vectors_against_all_pairs(spark):
    given = vectors()
    table = spark.createDataFrame([(i, v, "k") for i, v in enumerate(given)], "vec_id long, embedding array<double>, row string")
    got = found(near_vectors(table), "vec_id")
    links, roots = plain.vector_components(given, 0.9)
    assert [got[i].n_links for i in range(len(given))] == links
    assert [got[i].component_id for i in range(len(given))] == roots
    assert max(links) > 55 and 0 < sum(links) < 40_000
    assert all(got[i].kept == (roots[i] == i) for i in range(len(given)))


def test_recall_at_the_limit(spark):
    """Pairs just inside the limit, each alone among many vectors, where windows matter most."""
    rng = np.random.default_rng(9)
    a = rng.standard_normal((1500, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.standard_normal((1500, 32))
    side -= (side * a).sum(axis=1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = rng.uniform(0.9001, 0.93, 1500)[:, None]
    b = cosine * a + np.sqrt(1 - cosine**2) * side
    table = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(np.concatenate((a, b)))], "vec_id long, embedding array<double>")
    got = found(near_vectors(table), "vec_id")
    hits = sum(got[i + 1500].component_id == i for i in range(1500))
    assert hits >= 1490, hits
    assert near_vectors(table.limit(0)).collect() == []
    assert near_vectors(table.select(F.lit(None).cast("long").alias("vec_id"), "embedding").limit(2)).collect()[0].component_id is None


def test_a_dense_group_that_folds_into_no_ball(spark):
    """Thousands of vectors of mutual cosine 0.92 beside spread ones: every link is found, whatever the group's size."""
    rng = np.random.default_rng(12)
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)
    side = rng.standard_normal((4000, 64))
    side -= (side @ centre)[:, None] * centre
    side /= np.linalg.norm(side, axis=1)[:, None]
    group = np.sqrt(0.92) * centre + np.sqrt(0.08) * side
    spread = rng.standard_normal((3000, 64))
    given = np.concatenate((group, spread / np.linalg.norm(spread, axis=1)[:, None]))
    links = (given @ given.T >= 0.9).sum(axis=1) - 1
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(given)], "vec_id long, embedding array<double>").repartition(8)
    got = found(near_vectors(table), "vec_id")
    n = np.array([got[i].n_links for i in range(len(given))])
    assert links.sum() > 12_000_000 and (n <= links).all()
    assert n.sum() >= 0.9995 * links.sum(), n.sum() / links.sum()
    assert all(got[i].component_id == 0 for i in range(4000))


def test_links_between_members_at_facing_rims_of_two_balls(spark):
    """Heads stand 0.84 rad apart, their members 0.44: only the members link."""
    rng = np.random.default_rng(21)
    a, side = (rng.standard_normal((600, 64)) for _ in range(2))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side -= (side * a).sum(axis=1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    placed = [np.cos(angle) * a + np.sin(angle) * side for angle in (0, 0.2, 0.64, 0.84)]
    given = np.concatenate((*placed, rng.standard_normal((8000, 64))))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(given)], "vec_id long, embedding array<double>").repartition(8)
    got = found(near_vectors(table), "vec_id")
    assert sum(got[i + 1800].component_id == i for i in range(600)) >= 598
    assert sum(got[i + 600].n_links == 2 for i in range(600)) >= 598
