import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scorelake.llm import token_files as T
from scorelake.llm.elias_fano import SAMPLE, EliasFano, pack
from scorelake.llm.token_files import documents_at, read_tokens, write_tokens
from scorelake.session import scratch_path

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
END = 2


def sequences():
    rng = np.random.default_rng(4)
    yield []
    yield [7]
    yield [-(1 << 63), (1 << 63) - 1]
    yield [5] * 1000
    yield list(range(3000))
    yield np.sort(rng.integers(-(1 << 63), (1 << 63) - 1, 2000)).tolist()
    yield np.cumsum(rng.integers(1, 900, 5000)).tolist()
    yield sorted([3] * 700 + [1 << 40] * 700)  # a block of set bits far from the next
    yield np.cumsum((rng.random(4000) < 0.01) * 100_000).tolist()


@pytest.mark.parametrize("values", list(sequences()))
def test_packed_numbers_come_back(values):
    data = b"head" + pack(np.array(values, np.int64)) + b"tail"
    held = EliasFano(lambda at, size: data[at:at + size], 4)
    assert len(held) == len(values) and held.all().tolist() == values and held.end == len(data) - 4
    rng = random.Random(1)
    places = [rng.randrange(len(values)) for _ in range(300)] if values else []
    assert held.select(np.array(places, np.int64)).tolist() == [values[i] for i in places]
    with pytest.raises(IndexError):
        held.select(np.array([len(values)]))


def test_numbers_take_little_space_and_selects_read_little():
    values = np.cumsum(np.random.default_rng(2).integers(1, 1200, 200_000))
    data = pack(values)
    assert 8 * len(data) < len(values) * (np.log2(values[-1] / len(values)) + 3.2)
    read = []
    held = EliasFano(lambda at, size: read.append(size) or data[at:at + size])
    assert held.select(np.array([123_456])).tolist() == [values[123_456]] and sum(read) < 16 * SAMPLE
    with pytest.raises(ValueError):
        pack(np.array([2, 1]))


def rows():
    rng = random.Random(9)
    texts = [None, "", " \n", "one", "<|endoftext|> two", "é漢 🙂", "long " * 5000] + [
        " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    out = [(rng.randint(-50, 10_000), t) for t in texts]
    out += [(None, "no id"), (None, None), (None, "none")] + [(77, f"copy {i} " * 20) for i in range(120)] + [(78, "same")] * 100
    rng.shuffle(out)
    return [(i, t, 0, "x") for i, t in out]


@pytest.mark.parametrize("roll", [None, 40])
def test_files_hold_every_document_in_order(spark, monkeypatch, roll):
    if roll:
        monkeypatch.setattr(T, "ROLL_DOCS", roll)
        monkeypatch.setattr(T, "READ_IDS", 100)
    given = rows()
    docs = spark.createDataFrame(given, "doc_id long, text string, start int, shard string").repartition(3)
    folder = scratch_path(spark, "tokens")
    manifest = write_tokens(docs, WORD_FILE, folder, END)
    files = manifest.collect()
    got = sorted(read_tokens(manifest, folder).collect(), key=lambda r: r.number)
    tokenizer = Tokenizer.from_file(WORD_FILE)
    want = sorted([(i is not None, i or 0, [*tokenizer.encode(t or "", add_special_tokens=False).ids, END]) for i, t, *_ in given])
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in got) == want
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[:2] for w in want]
    assert [r.number for r in got] == list(range(len(given)))
    assert [r.start for r in got] == np.cumsum([0, *[len(r.ids) for r in got]])[:-1].tolist()
    assert sum(f.docs for f in files) == len(given) and sum(f.ids for f in files) == sum(len(r.ids) for r in got)
    # An id that many rows share is cut over files.
    assert len({f.file for f in files for r in got if r.doc_id in (77, 78) and f.first <= r.number < f.first + f.docs}) > 1
    wanted = [0, 1, 5, len(given) - 1, 5, len(given), -1, None] + list(range(40, 90))
    asked = spark.createDataFrame([(n,) for n in wanted], "number long").repartition(3)
    some = documents_at(manifest, folder, asked).collect()
    assert sorted(some) == sorted(got[n] for n in wanted if n is not None and 0 <= n < len(given))


def test_no_documents_and_equal_bytes_on_every_run(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    folder = scratch_path(spark, "tokens")
    manifest = write_tokens(empty, WORD_FILE, folder, END)
    assert manifest.collect() == [] and read_tokens(manifest, folder).collect() == []
    assert documents_at(manifest, folder, spark.range(3).toDF("number")).collect() == []
    docs = spark.createDataFrame([(i % 7, f"text {i}") for i in range(60)], "doc_id long, text string")
    runs = []
    for n in (1, 1):
        folder = scratch_path(spark, "tokens")
        write_tokens(docs.repartition(n).sortWithinPartitions("text"), WORD_FILE, folder, END)
        files = spark.read.format("binaryFile").load(folder)
        runs.append(sorted((r.name, bytes(r.content)) for r in files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").collect()))
    assert runs[0] == runs[1] and len(runs[0]) > 1
