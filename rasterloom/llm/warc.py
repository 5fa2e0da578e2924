"""Operator 1: WARC archives, and a normaliser for monolithically compressed ones.

write_archives() writes pages as WARC records, one gzip stream over each whole file, by Spark's text sink; an archive
holds RECORDS_AN_ARCHIVE records at most. normalise() inflates each such stream once, piece by piece, rewrites every
record as a gzip member of its own and writes a sidecar index (archive, record_no, offset, length) beside each archive;
read_index() finds them and read_records() fetches single members by them. Files are written under another name and
renamed, and a rerun task writes the same bytes, so lost executors leave no half archive. The query's source archives are
emptied one by one as their new form is in place. Archives are read and written
as streams: memory is bounded by the longest record.

Of records with equal payloads of at least `MIN_REVISIT` bytes, those with the smallest page_id are responses,
the others revisit it. Groups of equal payloads are found by partial sums of digests and joined; adaptive execution
splits the join where one payload fills a third of the table.

Defined cases: null html is an empty payload; a null url gives no target header, line ends in urls are
percent-encoded; a null page_id is kept as null and never named as response if its group has another; repeated
rows each get a record, and all rows that repeat the smallest page_id are responses; an empty table gives no rows;
other columns are not used; a stream that is cut off is an error, also if it is cut between records.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import fresh_path, table

MIN_REVISIT = 100
RECORDS_AN_ARCHIVE = 20_000
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
INDEX = "archive string, record_no long, offset long, length long, record_id string, warc_type string, target_uri string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
INDEXED = ".index.jsonl"
_INDEX = [c.split()[0] for c in INDEX.split(", ")]
_STEP = 1 << 18


def records(pages: DataFrame) -> DataFrame:
    """Each page with the text of its WARC record, without the record's closing line ends."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    groups = rows.filter(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    found = rows.join(groups.filter("n > 1").select("digest", "first"), "digest", "left")
    revisit = F.coalesce((F.col("bytes") >= MIN_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))

    def name(c: str):
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))

    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    fields = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", name("page_id")),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        ("WARC-Refers-To", F.when(revisit, name("first"))),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("X-Payload-Length", F.col("bytes").cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", (F.when(revisit, 0).otherwise(F.col("bytes")) + len(HTTP)).cast("string")),
    ]
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), v) for k, v in fields])
    return found.select(F.concat(head, F.lit(END), F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """One gzip stream a file; the text sink's line separator is the end of a WARC record."""
    records(pages).write.option("maxRecordsPerFile", RECORDS_AN_ARCHIVE).option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def inflate(blocks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip stream, piece by piece; several gzip members read as one stream."""
    z, begun = zlib.decompressobj(31), False
    for block in blocks:
        while block:
            z, begun = (zlib.decompressobj(31) if z.eof else z), True
            if out := z.decompress(block, _STEP):
                yield out
            block = z.unused_data if z.eof else z.unconsumed_tail
    if out := z.flush():
        yield out
    if begun and not z.eof:
        raise ValueError("the archive's gzip stream is cut off")


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and bytes of each record, its closing line ends included."""
    end, held = END.encode(), bytearray()
    need = None
    fields: dict[str, str] = {}
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                if (cut := held.find(end)) < 0:
                    break
                fields = head_fields(bytes(held[:cut]))
                need = cut + len(end) + int(fields["content-length"]) + len(end)
            if len(held) < need:
                break
            yield fields, bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends inside a record")


def head_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}


def _store(uri: str):
    from pyarrow import fs

    local = uri.startswith("file:/") and not uri.startswith("file://")
    return fs.FileSystem.from_uri("file://" + uri[5:] if local else uri)


def _blocks(uri: str) -> Iterator[bytes]:
    store, path = _store(uri)
    with store.open_input_stream(path, compression=None) as f:
        while block := f.read(_STEP):
            yield block


def normalise(spark: SparkSession, source: str, out: str, consume: bool = False) -> DataFrame:
    """Rewrite all archives of source into out, a gzip member a record, with an index beside each; returns the index.

    consume: each archive of source is emptied once its new form is in place, so both forms of all never lie on disk
    together. A task that is run again finds the empty file and the new form, and leaves them.
    """
    import uuid

    from pyarrow import fs

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = _store(out)
        for path in (p for batch in batches for p in batch["path"]):
            name = path.rsplit("/", 1)[-1].split(".")[0] + ".warc.gz"
            old, place = _store(path)
            size = old.get_file_info(place).size
            if consume and not size and store.get_file_info(f"{folder}/{name}{INDEXED}").type == fs.FileType.File:
                continue
            at, draft = 0, f"{folder}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft, compression=None) as f, store.open_output_stream(draft + INDEXED, compression=None) as g:
                for no, (fields, record) in enumerate(split_records(inflate(_blocks(path)))):
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = z.compress(record) + z.flush()
                    f.write(member)
                    row = (f"{out}/{name}", no, at, len(member), fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"))
                    g.write(json.dumps(dict(zip(_INDEX, row, strict=True))).encode() + b"\n")
                    at += len(member)
            if old.get_file_info(place).size != size:
                raise ValueError(f"{path} was rewritten by another run of this task")
            store.move(draft, f"{folder}/{name}")
            store.move(draft + INDEXED, f"{folder}/{name}{INDEXED}")
            if consume:
                old.open_output_stream(place, compression=None).close()
            yield pd.DataFrame({"n": [no + 1 if at else 0]})

    store, folder = _store(out)
    store.create_dir(folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    files.mapInPandas(rewrite, "n long").agg(F.sum("n")).collect()
    return read_index(spark, out)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar indices of all archives of a folder."""
    return spark.read.schema(INDEX).option("pathGlobFilter", f"*{INDEXED}").json(folder)


def read_records(index: DataFrame) -> DataFrame:
    """Fetch each record by its place in the index and read its page back."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, f = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(batch["archive"], batch["offset"], batch["length"], strict=True):
                if archive != opened:
                    store, path = _store(archive)
                    opened, f = archive, store.open_input_file(path)
                f.seek(offset)
                record = zlib.decompress(f.read(length), 31)
                head, _, block = record.partition(END.encode())
                fields = head_fields(head)
                page, kind = fields["warc-record-id"][10:-1], fields["warc-type"]
                if kind == "response":
                    payload = block[len(HTTP) : -len(END)]
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                else:
                    size, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
                first = fields.get("warc-refers-to")
                rows.append((None if page == "null" else int(page), size, digest, kind, int(first[10:-1]) if first else None))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = index.select("archive", "offset", "length").repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")
    return placed.mapInPandas(fetch, RECORDS)


def op1_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fresh_path(spark, "warc-raw")
    write_archives(table(spark, sf_dir, "pages"), raw)
    return read_records(normalise(spark, raw, fresh_path(spark, "warc"), consume=True))


ORACLES = {
    "op1_warc_roundtrip": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first = page_id OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id OR (page_id IS NULL AND first IS NOT NULL) THEN first END AS refers_to
        FROM g
    """,
}
