"""WARC archives of pages, compressed with Zstandard and one dictionary.

An archive begins with a skippable frame that holds the dictionary; one frame follows for each record. Payloads that occur
before are not stored again: of equal payloads of at least ``min_bytes`` bytes the row with the largest id is a response,
the others are revisit records that name it. Writers put each file under a name of its own and move it into place when
it is whole, so a repeated task replaces its own files. The reader decodes frame by frame, so memory is bounded by the
longest record, and checks the version line, the lengths, and the digests of blocks and payloads. ``round_trip`` also checks that
every revisit names a response of its own digest and length.

Null payloads are empty. A null URL leaves its header out; control characters in one are escaped. Ids of any text are escaped,
line breaks and empty text included. A null id is written without a name and comes back as null; it is never the largest, unless all ids of the payload are null (then each is a
response). Rows of equal id and payload are all responses or all revisits. An empty table gives no archives and no rows.
Only the three named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import hinted
from tallyward.session import checkpoint_dir, settle

# Fixed values of the formats: the magic numbers of the dictionary frame and of an ordinary frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1\r\n"
LENGTH_FIELD = "WARC-Payload-Length"

DICTIONARY_BYTES = 32 << 10
DICTIONARY_ROWS = 256
DICTIONARY_ROW_BYTES = 32 << 10
FILE_BYTES = 64 << 20
READ_BYTES = 1 << 20
ROW_BATCH_BYTES = 4 << 20


def train_dictionary(pages: DataFrame, payload: str, rows: int = DICTIONARY_ROWS) -> bytes:
    """A dictionary from at most ``rows`` different payloads of up to DICTIONARY_ROW_BYTES bytes, chosen by hash; empty if they are too few.

    Hashes below a threshold are about twice as many as are wanted at any size of the table, so few payloads are moved.
    """
    small = pages.select(F.col(payload).alias("p")).where(F.octet_length("p").between(1, DICTIONARY_ROW_BYTES)).withColumn("h", F.xxhash64("p"))
    different = small.agg(F.approx_count_distinct("h")).first()[0]
    if different > 2 * rows:
        small = small.where(F.col("h") < -(2**63) + 2**65 * rows // different)
    sample = [r["p"].encode() for r in small.groupBy("h").agg(F.min("p").alias("p")).orderBy("h").limit(rows).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def roles(pages: DataFrame, page_id: str, url: str, payload: str, min_bytes: int) -> DataFrame:
    """(id, url, payload, digest, role, refers): which row of equal payloads is the response."""
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # only payloads that occur more than once go into the table that is joined back
    large = rows.where(F.octet_length("payload") >= min_bytes)
    repeated = large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where("n > 1").drop("n")
    joined = rows.join(hinted(settle(repeated)), "digest", "left")
    revisit = F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top"))
    return joined.select("id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("role"), F.when(revisit, F.col("top")).alias("refers"))


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def urn(id_) -> str:
    return "<urn:page>" if id_ is None else f"<urn:page:{quote(str(id_), safe='')}>"


def named(urn_: str) -> str | None:
    """The id in a name that ``urn`` made."""
    found = re.fullmatch(r"<urn:page(?::(.*))?>", urn_)[1]
    return None if found is None else unquote(found)


def record(id_, url, payload: bytes, digest: str, role: str, refers) -> bytes:
    """One WARC record; the digest is the payload's in base 32."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if role == "response" else http
    head = [f"WARC-Type: {role}", f"WARC-Record-ID: {urn(id_)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if role == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"{LENGTH_FIELD}: {len(payload)}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields and the payload of a record; raises where a length or digest doesn't hold."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not data.startswith(VERSION) or not gap:
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in head[len(VERSION) :].decode().split("\r\n"))
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, {size} announced")
    block = rest[:size]
    if fields["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("block digest differs")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and (
        fields["WARC-Payload-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() or int(fields[LENGTH_FIELD]) != len(payload)
    ):
        raise ValueError("payload differs from its digest or length")
    return fields | {"payload": payload if fields["WARC-Type"] == "response" else None}


def frames(read):
    """The dictionary frame's content, then each record, of a stream given by ``read(n)``."""
    head = read(8)
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    stored = b""
    while len(stored) < size:
        stored += (more := read(size - len(stored)))
        if not more:
            raise ValueError("dictionary cut short")
    if stored[:4] == struct.pack("<I", FRAME_MAGIC):
        stored = zstandard.ZstdDecompressor().decompressobj().decompress(stored)
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stored)) if stored else zstandard.ZstdDecompressor()
    waiting = b""
    while True:
        waiting = waiting or read(READ_BYTES)
        if not waiting:
            return
        one, parts = plain.decompressobj(), []
        while not one.eof:
            parts.append(one.decompress(waiting))
            waiting = one.unused_data if one.eof else read(READ_BYTES)
            if not waiting and not one.eof:
                raise ValueError("record cut short")
        yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives below ``folder``, a place that every executor reaches; returns (path, records) of each file."""
    trained = train_dictionary(pages, payload)
    dictionary = pages.sparkSession.sparkContext.broadcast(trained)

    def write(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        shared = zstandard.ZstdCompressionDict(dictionary.value) if dictionary.value else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True)
        out = path = trial = None
        done, records, at = [], 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                fs.move(trial, path)
                done.append((path, records))
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{base}/part-{task.partitionId():06d}-{len(done):06d}.warc.zst"
                    trial = f"{path}.{task.taskAttemptId()}"
                    out, records = fs.open_output_stream(trial, compression=None), 0
                    at = out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary.value)) + dictionary.value)
                data = record(row["id"], row["url"], row["payload"].encode(), base32(row["digest"]), row["role"], row["refers"])
                at += out.write(packer.compress(data))
                records += 1
                if at >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.string()), "records": pa.array([n for _, n in done], pa.int64())})

    return settle(roles(pages, page_id, url, payload, min_bytes).mapInArrow(write, "path string, records long"))


def read_archives(files: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """(id, type, url, refers, digest, bytes[, payload]) of every record of the files; ids are text."""
    schema = "id string, type string, url string, refers string, digest string, bytes long" + ", payload binary" * with_payload

    def load(batches):
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        names = ["id", "type", "url", "refers", "digest", "bytes"] + ["payload"] * with_payload
        kinds = [pa.string()] * 5 + [pa.int64()] + [pa.binary()] * with_payload

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held, found = [], 0, 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for data in frames(stream.read):
                        f, found = parse(data), found + 1
                        refers = named(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None
                        row = (named(f["WARC-Record-ID"]), f["WARC-Type"], f.get("WARC-Target-URI"), refers, f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f[LENGTH_FIELD]))
                        rows.append(row + (f["payload"],) * with_payload)
                        held += len(data)
                        if held >= ROW_BATCH_BYTES or len(rows) >= 10_000:
                            yield pack(rows)
                            rows, held = [], 0
                if found != expected:
                    raise ValueError(f"{path} has {found} records of {expected}")
                if rows:
                    yield pack(rows)

    return files.select("path", "records").mapInArrow(load, schema)


def archive_folder(spark) -> str:
    """A fresh folder in the shared checkpoint folder, as a URI."""
    base = checkpoint_dir(spark)
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/warc-{uuid.uuid4().hex}"


def check_revisits(records: DataFrame) -> None:
    """Raise where a revisit names no response of its digest and length."""
    what = ["id", "digest", "bytes"]
    meant = records.where("type = 'revisit'").groupBy(F.col("refers").alias("id"), "digest", "bytes").agg(F.count(F.lit(1)).alias("n"))
    lost = meant.join(records.where("type = 'response'").select(*what), what, "left_anti").take(1)
    if lost:
        raise ValueError(f"{lost[0]['n']} revisits of {lost[0]['id']} find no such response")


def round_trip(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write ``pages``, read them back, and return page_id, payload_bytes, payload_digest, record_type and refers_to."""
    kind = dict(pages.dtypes)[page_id]
    files = write_archives(pages, folder, page_id, url, payload, min_bytes)
    records = settle(read_archives(files, folder, with_payload=False))
    check_revisits(records)
    return records.select(
        F.col("id").cast(kind).alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers").cast(kind).alias("refers_to"),
    )
