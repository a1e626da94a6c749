import gzip
import hashlib
import random
import zlib

import pytest

from scorelake.llm import warc as W
from scorelake.llm.sharding import LOWEST, range_of, sharded, splitters_of, write_shards
from scorelake.session import scratch_path

from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, digest string"


def pages():
    rng = random.Random(5)
    big = ["<p>" + "".join(rng.choice("abcdef é") for _ in range(rng.randint(1100, 4000))) for _ in range(4)]
    rows = [(i, f"http://h{i % 7}/p?q={i}", rng.choice(big) if rng.random() < 0.5 else f"<i>{i}" * rng.randint(1, 900), "x") for i in range(200)]
    return rows + [(500, None, None, "x"), (501, "http://a b/é\n", "", "x"), (502, "u", "x" * 999, "x"), (503, "u", "x" * 999, "x"),
                   (504, "b", "y" * 1000, "x"), (504, "a", "y" * 1000, "x"), (12, "z", "y" * 1000, "x"), (None, "n", "n" * 2000, "x"), (505, "n", "n" * 2000, "x"),
                   (506, "l", "long é " * 300_000, "x")]


def want(rows):
    lead = {}
    for page, _, html, _ in rows:
        if html and len(html.encode()) >= 1000 and page is not None:
            lead[html] = max(lead.get(html, page), page)
    out, seen = [], set()
    for page, url, html, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        data = (html or "").encode()
        first = lead.get(html, page)
        revisit = html in lead and (page != first or (page, html) in seen)
        seen.add((page, html))
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_pages_come_back_from_archives(spark):
    rows = pages()
    table = spark.createDataFrame(rows, PAGES).repartition(4)
    folder = scratch_path(spark, "warc-test")
    manifest = W.write_warc(table, folder, roll=20_000, least=5)
    files = manifest.collect()
    assert len({f.shard for f in files}) > 2 and len(files) > len({f.shard for f in files}) and sum(f.records for f in files) == len(rows)
    got = W.read_warc(manifest, folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(rows)
    given = {(r[0], r[2] or "") for r in rows}
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert all((r.page_id, bytes(r.payload).decode()) in given for r in got if r.payload is not None)


def test_files_are_the_same_on_every_run_and_open_with_gzip(spark):
    table = spark.createDataFrame(pages(), PAGES)
    runs = []
    for n in (1, 6):
        folder = scratch_path(spark, "warc-test")
        files = sorted(map(tuple, W.write_warc(table.repartition(n), folder, roll=50_000, least=3).collect()))
        runs.append(files)
        path = folder.removeprefix("file://")
        with gzip.open(f"{path}/{files[0][0]}") as file:
            assert file.read(8) == b"WARC/1.1"
    assert runs[0] == runs[1]


def test_no_pages(spark):
    table = spark.createDataFrame([], PAGES)
    folder = scratch_path(spark, "warc-test")
    manifest = W.write_warc(table, folder)
    assert manifest.collect() == [] and W.read_warc(manifest, folder).collect() == []


def test_a_broken_archive_is_refused():
    record = W.page_record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), 0, None, False)
    data = W._member(record)
    assert [*W.members(data + data)] == [record, record]
    with pytest.raises((ValueError, zlib.error)):
        list(W.members(data[:-12]))
    fields, block = W.parse_record(record)
    assert fields["x-page-id"] == "1" and block.endswith(b"payload")


def shards_of(spark, rows, n=16):
    table = spark.createDataFrame(rows, "k long, id long, size long, shard_no string")
    return sharded(table, "k", "id", "size", n).collect()


@pytest.mark.parametrize("hot", [False, True])
def test_shards_have_near_equal_bytes_and_gapless_slots(spark, hot):
    rng = random.Random(7)
    rows = [(5 if hot and rng.random() < 0.4 else rng.getrandbits(62) - (1 << 61), i, 1 + int(rng.paretovariate(1.2) * 40) % 3000, "x") for i in range(6000)]
    out = shards_of(spark, rows)
    assert sorted((r.k, r.id, r.size) for r in out) == sorted(r[:3] for r in rows)
    total, largest = sum(r[2] for r in rows), max(r[2] for r in rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(16))
    ends = []
    for shard in range(16):
        own = sorted(by[shard], key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 16) <= largest + 1
        order = [(r.k, r.id) for r in own]
        assert order == sorted(order)
        ends += [order[0], order[-1]]
    assert ends == sorted(ends)


def test_splitters_cut_a_hot_key_and_place_rows(spark):
    rows = [(0 if i % 3 else i, i, 10) for i in range(9000)]
    table = spark.createDataFrame(rows, "k long, id long, size long")
    splitters, total = splitters_of(table, "k", "id", "size", least=30)
    assert total == 90_000
    placed = table.select("k", "id", range_of(splitters)(F.col("k"), F.col("id")).alias("r")).collect()
    pairs = list(zip(*(x.tolist() for x in splitters)))
    assert all(r.r == sum(p <= (r.k, r.id) for p in pairs) for r in placed)
    sizes = [sum(10 for r in placed if r.r == i) for i in range(len(pairs) + 1)]
    assert max(sizes) <= 2 * total / 30


def test_shards_of_odd_tables(spark):
    assert shards_of(spark, []) == []
    out = shards_of(spark, [(None, None, None, None)] * 3 + [(1, 1, 0, "a")] * 5, 4)
    assert len(out) == 8 and sorted((r.shard, r.slot) for r in out) == sorted({(r.shard, r.slot) for r in out})
    assert LOWEST == -(2**63)


def test_written_shards(spark):
    table = spark.createDataFrame([(i * 7 % 50, i, 5, "t") for i in range(200)], "k long, id long, size long, note string")
    placed = sharded(table, "k", "id", "size", 4)
    path = scratch_path(spark, "shards-test")
    write_shards(placed, path)
    back = spark.read.parquet(path)
    assert sorted((r.id, r.shard, r.slot) for r in back.collect()) == sorted((r.id, r.shard, r.slot) for r in placed.collect())
