"""WARC archives of all pages, and shards of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.llm.registry import query, table
from scorelake.llm.sharding import sharded
from scorelake.llm.storage import stored
from scorelake.llm.warc import read_warc, write_warc
from scorelake.session import scratch_path

WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
l AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS lead FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN lead = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN lead <> page_id THEN lead END AS refers_to
FROM l
"""


@query("op7_warc_writer", WARC_SQL)
def op7(spark, sf_dir):
    folder = scratch_path(spark, "warc")
    manifest = write_warc(table(spark, sf_dir, "pages"), folder)
    records = read_warc(manifest, folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_sampled_splitters")
def op8(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"))
    placed = sharded(stored(rows, "document-sizes"), "text_hash", "doc_id", "size", 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
