"""Columns that bear the names of added ones, ids that a third of all rows share, and labels of very many languages."""

import random

import public_tokenizers
from pyspark.sql import functions as F

from scorelake.llm import quality_rank as R
from scorelake.llm import quality_rules as Q
from scorelake.llm import warc as W
from scorelake.llm.byte_tokens import decoded, encoded
from scorelake.llm.sharding import sharded
from scorelake.llm.storage import stored
from scorelake.session import scratch_path

BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_keys_named_like_added_columns_come_back_renamed(spark):
    docs = spark.createDataFrame([(1, "a b c " * 30, 7, "l", 8, True)], "doc_id long, text string, ids int, `ids_` string, score int, Kept boolean")
    ids = encoded(docs, BYTE_FILE, public_tokenizers.PATTERN, ["doc_id", "ids", "ids_"])
    assert ids.columns == ["doc_id", "ids__", "ids_", "ids"]
    row = ids.first()
    assert (row["ids__"], row["ids_"], len(row["ids"]) > 10) == (7, "l", True)
    back = decoded(docs.select("text").crossJoin(ids), BYTE_FILE, public_tokenizers.PATTERN, ["doc_id", "text"])
    assert back.columns == ["doc_id", "text_", "text"] and back.first()["text"] == back.first()["text_"]
    scores = R.quality_scores(docs, None, ["score", "doc_id"])
    assert scores.columns == ["score_", "doc_id", "score"] and tuple(scores.first()) == (8, 1, 0.5)
    rules = Q.quality_rules(docs.withColumn("lang", F.lit("en")), ["Kept", "doc_id"])
    assert rules.columns[:2] == ["Kept_", "doc_id"] and rules.columns[-1] == "kept" and rules.first()["Kept_"] is True


def test_shard_columns_come_back_renamed(spark):
    rows = stored(spark.createDataFrame([(i, 5, i % 7, "x") for i in range(50)], "doc_id long, shard long, slot long, Shard_ string"), "rows")
    out = sharded(rows, "slot", "doc_id", "shard", 4)
    assert out.columns == ["doc_id", "shard__", "slot_", "Shard_", "shard", "slot"]
    got = out.collect()
    assert sorted((r["doc_id"], r["shard__"], r["slot_"]) for r in got) == [(i, 5, i % 7) for i in range(50)]
    assert {r["shard"] for r in got} == set(range(4))


def test_a_page_id_of_a_third_of_all_rows_is_cut_over_files(spark):
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"u{i}", f"page {i} " * 150) for i in range(300)]
    folder = scratch_path(spark, "warc-test")
    manifest = W.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), folder, least=12)
    files = manifest.collect()
    assert len({f.shard for f in files}) >= 8 and max(f.records for f in files) < 100
    got = W.read_warc(manifest, folder).collect()
    assert sorted((r.page_id or 0, bytes(r.payload).decode(), r.record_type) for r in got) == sorted((i or 0, h, "response") for i, _, h in rows)


def test_labels_of_very_many_languages(spark, monkeypatch):
    monkeypatch.setattr(Q, "MAX_LANGUAGES", 2)
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(1200)), lang) for i, lang in enumerate("l0 l1 l2".split() * 3 + ["l0", "l2", "l2", "l3"])]
    ref = Q.references(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert ref.languages == ("l0", "l2")


def test_repeated_ids_push_no_label_out(spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_LABELLED", 40)
    docs = [(i, ("good words that follow one another " if i % 2 else "%% ## || ") * 20 + str(i)) for i in range(40)]
    extra = [(1, f"## repeated {i}") for i in range(500)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    held = []
    monkeypatch.setattr(R, "fitted", lambda x, good: held.append((x.shape[0], int(good.sum()))))
    known = [i for i, _ in docs if spark.range(1).select(F.crc32(F.lit(str(i))) % 5).first()[0]]
    R.learned(spark.createDataFrame(docs + extra, "doc_id long, text string"), labels)
    assert held == [(len(known), sum(i % 2 for i in known))]
