"""WARC archives with a Zstandard dictionary: writer, reader, and the round trip.

Each Spark partition becomes one ``.warc.zst`` file in the shared folder: a leading skippable frame
holds the dictionary, then every record is a frame of its own.  The dictionary is trained on the
driver from a bounded sample of records.  A task writes under a name of its own attempt and reports
it, and only reported files are read, so repeated and speculative attempts do no harm.

Of pages with equal payloads of at least ``least_bytes`` the one with the largest id is stored, the
others become revisits that name it.  Equal payloads are found by digest and length, with a partial
maximum before the shuffle.  Null html is an empty payload.  Pages without an id are left out;
repeated ids with equal payloads are archived as often as they come.  A payload of any length is one record, held in memory
by one task at a time; extra columns are not archived; an empty table gives no file and no row.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger.llm.common import read_table, sample_by_hash, store, work_dir

#: Fixed value of the format: the magic number of the skippable frame that holds a dictionary.
DICT_MAGIC = 0x184D2A5D
#: Fixed value of Zstandard: the magic number of a frame.
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, content binary"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder in the shared store (file, hdfs, s3 and so on)."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def plan_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.where(F.col("page_id").isNotNull()).select("page_id", "url", payload.alias("payload"))
    key = p.select("page_id", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    best = key.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes")
    best = best.agg(F.max("page_id").alias("response_id"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    p = p.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    p = p.join(best, ["payload_digest", "payload_bytes"], "left")
    other = F.col("response_id").isNotNull() & (F.col("response_id") != F.col("page_id"))
    return p.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("response_id")).alias("refers_to"),
    )


def record_id(page_id: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>"


def make_record(row: dict) -> bytes:
    """A WARC/1.1 record; a revisit keeps the HTTP header, whose Content-Length is the payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    body = http + (row["payload"] if row["record_type"] == "response" else b"")
    uri = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['page_id'])}", f"WARC-Target-URI: {uri}",
        f"WARC-Page-ID: {row['page_id']}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if row["record_type"] == "revisit":
        head += [f"WARC-Refers-To: {record_id(row['refers_to'])}", f"WARC-Refers-To-Page-ID: {row['refers_to']}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The row of a record; digest and length of a response are taken from its bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, content = body.partition(b"\r\n\r\n")
    row = {"page_id": int(fields["WARC-Page-ID"]), "record_type": fields["WARC-Type"], "target_uri": fields["WARC-Target-URI"], "content": content, "refers_to": None}
    if row["record_type"] == "response":
        return row | {"payload_bytes": len(content), "payload_digest": hashlib.sha1(content).hexdigest()}
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return row | {"payload_bytes": length, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": int(fields["WARC-Refers-To-Page-ID"])}


def train_dictionary(pages: DataFrame, sample_rows: int = 400, sample_bytes: int = 32_768, dict_bytes: int = 65_536) -> bytes:
    """From at most ``sample_rows`` pages, each with at most ``sample_bytes`` of payload (a bounded sample; all
    records are archived whole).  The ids are chosen first and payloads are cut on the executors, so what
    comes to the driver is at most their product.  Too little material gives the sample itself as a
    raw-content dictionary."""
    ids = sample_by_hash(pages, "page_id", sample_rows)
    payload = F.substring(F.coalesce("html", F.lit("")).cast("binary"), 1, sample_bytes)
    some = pages.select("page_id", "url", payload.alias("payload")).join(F.broadcast(ids), "page_id", "left_semi")
    rows = some.groupBy("page_id").agg(F.min(F.struct("payload", "url")).alias("p")).select("page_id", "p.*").collect()
    made = {"record_type": "response", "refers_to": None}
    samples = [make_record(r.asDict() | made | {"payload": bytes(r["payload"]), "payload_bytes": len(r["payload"]), "payload_digest": hashlib.sha1(r["payload"]).hexdigest()}) for r in sorted(rows, key=lambda r: r["page_id"])]
    try:
        return zstandard.train_dictionary(dict_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:dict_bytes] or b"WARC/1.1\r\nWARC-Type: response\r\n"


def write_archives(records: DataFrame, folder: str, dictionary: bytes, level: int = 3) -> DataFrame:
    """Writes one archive per partition; returns (file, n_records) of the files that count, already written."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store_, path = open_folder(folder)
        zdict = zstandard.ZstdCompressionDict(dictionary)
        packer = zstandard.ZstdCompressor(level=level, dict_data=zdict)
        name, out, n = f"part-{uuid.uuid4().hex}.warc.zst", None, 0
        for batch in batches:
            for row in batch.to_dict("records"):
                if out is None:
                    out = store_.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary)
                row["refers_to"] = None if pd.isna(row["refers_to"]) else int(row["refers_to"])
                out.write(packer.compress(make_record(row)))
                n += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [name], "n_records": [n]})

    store_, path = open_folder(folder)
    store_.create_dir(path, recursive=True)
    return store(records.mapInPandas(write, "file string, n_records long"), folder, "manifest")


def iter_records(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Records of an open archive, one frame at a time, with the dictionary of its leading frame."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICT_MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    left = b""
    while True:
        frame, out, begun = unpacker.decompressobj(), io.BytesIO(), False
        while not frame.eof:
            data = left or stream.read(chunk)
            left = b""
            if not data:
                if begun:
                    raise ValueError("the archive ends inside a record")
                return
            begun = True
            out.write(frame.decompress(data))
        left = frame.unused_data
        yield out.getvalue()


def read_archives(manifest: DataFrame, folder: str, with_content: bool = True) -> DataFrame:
    """Rows of all records of the files in ``manifest``; a task takes whole files, batch by batch."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store_, path = open_folder(folder)
        columns = [c.split()[0] for c in ROWS.split(", ")]
        for batch in batches:
            for name in batch["file"]:
                rows: list[dict] = []
                with store_.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for raw in iter_records(stream):
                        row = parse_record(raw)
                        rows.append(row if with_content else row | {"content": None})
                        if len(rows) >= 256:
                            yield pd.DataFrame(rows, columns=columns).astype({"refers_to": "Int64"})
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype({"refers_to": "Int64"})

    return manifest.repartition(max(1, manifest.count()), "file").mapInPandas(read, ROWS)


def archive_pages(pages: DataFrame, least_bytes: int = 1000, with_content: bool = True) -> DataFrame:
    """Archives ``pages`` (page_id, url, html) and returns what the archives hold."""
    folder = work_dir(pages.sparkSession)
    manifest = write_archives(plan_records(pages, least_bytes), folder, train_dictionary(pages))
    return read_archives(manifest, folder, with_content)


def op10_warc(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return archive_pages(pages, with_content=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op10_warc": op10_warc}
ORACLES = {
    "op10_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS payload_digest FROM pages WHERE page_id IS NOT NULL),
q AS (SELECT page_id, octet_length(b) AS payload_bytes, payload_digest,
  max(page_id) OVER (PARTITION BY payload_digest, octet_length(b)) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
FROM q
"""
}
