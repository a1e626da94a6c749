"""Every stage of the pipeline against a plain version, on documents with nulls, repeats and clashing columns."""

import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import plain
import public_tokenizers

STAGES = dict(corpus_pipeline.STAGES)
WORDS = "the of and to in is it on as was".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice("aeioklmnrst") for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    rng = random.Random(12)
    shared = prose(rng, 90)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(80)]
    texts += [t + " " + shared + " " + prose(rng, 40) for t in texts[:6]]
    texts += [texts[10], texts[10], texts[11].upper(), " ".join(texts[12].split()[:-1]), None, "", " ", "too short"]
    texts += [" ".join(w + "###" for w in prose(rng, 80).split()) for _ in range(20)]
    rows = [(i, t, "en", "s", 0 if t is None else len(t), i % 2, None) for i, t in enumerate(texts)] + [(10, texts[10], "en", "s", len(texts[10]), 7, "x")]
    folder = tmp_path_factory.mktemp("tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, kept string"
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0 if t and "###" in t else 1, 0) for i, t in enumerate(texts) if t and len(t) > 20 and i % 9]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_are_the_ones_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "minhash_near_dedup", "suffix_dedup", "packing"]


@pytest.mark.parametrize("name", ["quality_classifier", "quality_rules", "minhash_near_dedup", "suffix_dedup"])
def test_columns_stay_and_empty_tables_pass(spark, given, name):
    docs = documents(spark, given)
    out = STAGES[name](spark, docs, given)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    kept = {r.doc_id for r in out.collect()}
    assert kept <= {r.doc_id for r in docs.collect()}
    assert STAGES[name](spark, docs.limit(0), given).collect() == []


def test_filters_drop_junk_and_keep_prose(spark, given):
    docs = documents(spark, given)
    junk = {r.doc_id for r in docs.collect() if r.text and "###" in r.text}
    for name in ("quality_classifier", "quality_rules"):
        kept = {r.doc_id for r in STAGES[name](spark, docs, given).collect()}
        assert not kept & junk and set(range(80)) <= kept
    ruled = {r.doc_id for r in STAGES["quality_rules"](spark, docs, given).collect()}
    assert all(len(plain.words(r.text)) >= 50 for r in docs.collect() if r.doc_id in ruled)


def test_one_of_each_group_stays(spark, given):
    docs = documents(spark, given)
    rows = docs.collect()
    _, roots = plain.near_components([r.text for r in rows], 5, 0.8)
    groups = {}
    for r, root in zip(rows, roots):
        groups.setdefault(root, []).append(r.doc_id)
    out = [r.doc_id for r in STAGES["minhash_near_dedup"](spark, docs, given).collect()]
    assert sorted(out) == sorted(min(ids) for ids in groups.values())


def test_lengths_follow_cut_texts(spark, given):
    out = STAGES["suffix_dedup"](spark, documents(spark, given), given).collect()
    assert all(r.n_chars == len(r.text) for r in out if r.text is not None)
    assert plain.repeated_words([r.text for r in out], 50) == {}


def test_the_whole_run_packs_what_all_stages_kept(spark, given):
    pieces = corpus_pipeline.run(spark, given).collect()
    docs = documents(spark, given)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{given}/{name}.parquet"
        stage(spark, docs, given).write.parquet(path)
        docs = spark.read.parquet(path)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}
    got = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == want and 70 < len(want) < 110
