"""WARC archives in Zstandard: writer, reader and revisit records.

Format. An archive starts with one skippable frame that holds a Zstandard
dictionary, trained on the archive's own first records; then every record is
one frame. The reader loads the dictionary from the leading skippable frame
(raw or itself compressed), finds each frame's end from its block headers,
decodes one frame to one record and checks: version line, header syntax,
mandatory fields, ``Content-Length`` against the block, the closing blank
lines, the HTTP length and the payload digest.

Archives are rows ``(archive, n_records, content)`` of a table that Spark
commits in the shared folder, so a lost task leaves no half archive;
``export_files`` and ``read_files`` take them to and from ``.warc.zst`` files.
An archive rolls over at ``ARCHIVE_BYTES`` of payload, which bounds the memory
of writer and reader; a single longer record stands alone.

Cases: a null html has an empty payload. Payloads under ``REVISIT_BYTES`` are
always responses. Of longer equal payloads the largest ``page_id`` is the
response; rows that repeat that id are responses too, since none of them is
another page. Null ids revisit the largest id, and are responses if the group
has no other. Control characters and blanks in a url are percent-encoded in the
header; a null url has no target field. Other columns are not read. An empty
table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import as_text, pick, written

REVISIT_BYTES = 1000
#: payloads with over one part in so many of all copies
HOT_PAYLOADS = 1000
ARCHIVE_BYTES = 4 << 20
DICT_BYTES = 32 << 10
SAMPLE_BYTES = 512 << 10
LEVEL = 3
#: fixed values of the formats
SKIPPABLE_DICT = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

FIELD = regex.compile(rb"([!#$%&'*+\-.^_`|~0-9A-Za-z]+):[ \t]*(.*)", regex.DOTALL)
READ = ("archive string, page_id long, url string, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long, error string")


class WarcError(ValueError):
    """A record or frame that breaks the format."""


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, size: int, sha1: str,
           refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header of the full payload only."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {size}\r\n\r\n").encode()
    block = http + (payload if kind == "response" else b"")
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    uid = hashlib.md5(f"{page_id} {kind} {sha1}".encode()).hexdigest()
    head = ["WARC/1.1", f"WARC-Type: {kind}",
            f"WARC-Record-ID: <urn:uuid:{uid[:8]}-{uid[8:12]}-{uid[12:16]}-{uid[16:20]}-{uid[20:]}>",
            f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """Dictionary frame and one frame per record."""
    sample, size = [], 0
    for r in records:
        sample.append(r[:8192])
        size += len(sample[-1])
        if size > SAMPLE_BYTES:
            break
    words, out = None, []
    if len(sample) >= 16:
        try:
            words = zstandard.train_dictionary(min(DICT_BYTES, max(1024, size // 8)), sample)
        except zstandard.ZstdError:
            words = None  # too little or too uniform text: frames go without a dictionary
    raw = words.as_bytes() if words else b""
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(raw) if raw else b""
    out.append(struct.pack("<II", SKIPPABLE_DICT, len(packed)) + packed)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True, write_content_size=True)
    out += [press.compress(r) for r in records]
    return b"".join(out)


def frame_end(data: memoryview, at: int) -> int:
    """The end of the frame that starts at ``at``, from its headers alone."""
    if len(data) - at < 5:
        raise WarcError("cut frame")
    magic = struct.unpack_from("<I", data, at)[0]
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0] if len(data) - at >= 8 else len(data) + 1
    elif magic == ZSTD_MAGIC:
        try:
            end = at + zstandard.frame_header_size(data[at:at + 18])
        except zstandard.ZstdError as e:
            raise WarcError(f"frame header: {e}") from e
        while True:
            if end + 3 > len(data):
                raise WarcError("cut frame")
            head = int.from_bytes(data[end:end + 3], "little")
            end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            if head & 1:
                break
        end += 4 * (data[at + 4] >> 2 & 1)
    else:
        raise WarcError("no frame")
    if end > len(data):
        raise WarcError("cut frame")
    return end


def frames(content: bytes):
    """Yield the decoded bytes of every record's frame, one after the other."""
    data, at = memoryview(content), 0
    if not len(data):
        return
    words = None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE_DICT:
        at = frame_end(data, 0)
        raw = bytes(data[8:at])
        if raw[:4] == struct.pack("<I", ZSTD_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        words = zstandard.ZstdCompressionDict(raw) if raw else None
    reader = zstandard.ZstdDecompressor(dict_data=words)
    while at < len(data):
        end = frame_end(data, at)
        if struct.unpack_from("<I", data, at)[0] == ZSTD_MAGIC:
            try:
                yield reader.decompressobj().decompress(data[at:end])
            except zstandard.ZstdError as e:
                raise WarcError(f"frame: {e}") from e
        at = end


def fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    # a line that begins with white space goes on with the one before
    for line in regex.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n"):
        m = FIELD.fullmatch(line)
        if not m:
            raise WarcError(f"header line {line[:40]!r}")
        out[m[1].decode().lower()] = m[2].decode("utf-8", "replace").strip()
    return out


def number(head: dict[str, str], name: str) -> int | None:
    value = head.get(name)
    if value is None:
        return None
    if not regex.fullmatch(r"-?[0-9]+", value):
        raise WarcError(f"{name} isn't a number")
    return int(value)


def parse(raw: bytes) -> dict:
    """Check one record and return its fields; ``payload`` is None for a revisit."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not sep or version not in VERSIONS:
        raise WarcError("no WARC version line")
    h = fields(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise WarcError(f"no {name}")
    size = number(h, "content-length")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError("Content-Length doesn't match the block")
    out = {"page_id": number(h, "x-page-id"), "url": h.get("warc-target-uri"), "record_type": h["warc-type"],
           "refers_to": number(h, "x-refers-to-page-id"), "payload": None, "payload_bytes": size,
           "payload_digest": None}
    told = h.get("warc-payload-digest", "")
    if told.startswith("sha1:"):
        try:
            out["payload_digest"] = base64.b32decode(told[5:]).hex()
        except ValueError as e:  # also what base64 raises of other letters
            raise WarcError("WARC-Payload-Digest isn't base32") from e
    if h["warc-type"] in ("response", "revisit"):
        status, sep, payload = rest[:size].partition(b"\r\n\r\n")
        if not sep or not status.startswith(b"HTTP/"):
            raise WarcError("no HTTP header")
        length = number(fields(status.partition(b"\r\n")[2]), "content-length")
        out["payload_bytes"] = len(payload) if length is None else length
        if h["warc-type"] == "response":
            if length is not None and length != len(payload):
                raise WarcError("HTTP length doesn't match the payload")
            if out["payload_digest"] not in (None, hashlib.sha1(payload).hexdigest()):
                raise WarcError("payload digest doesn't match")
            out["payload_digest"] = hashlib.sha1(payload).hexdigest()
            out["payload"] = payload
    return out


def with_roles(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, html, size, sha1, revisit, refers_to``. Only digests are
    grouped, merged in each task first; short payloads get keys that match none."""
    html = as_text(F.col(html_col))
    rows = (pick(df, id_col, url_col, html_col)
            .select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
            .withColumn("size", F.octet_length("html").cast("long"))
            .withColumn("sha1", F.sha1(F.col("html").cast("binary"))))
    heads = written(rows.where(F.col("size") >= REVISIT_BYTES).groupBy("sha1")
                    .agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "warc-heads")
    # payloads with so many copies are HOT_PAYLOADS at most: their rows are looked up where
    # they are, and get a key of their own in the join that finds the others
    total = heads.agg(F.sum("copies")).first()[0] or 0
    hot = heads.where(F.col("copies") > total / HOT_PAYLOADS).select("sha1", F.col("head").alias("hot"))
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    key = F.when((F.col("size") >= REVISIT_BYTES) & F.col("hot").isNull(), F.col("sha1")).otherwise(alone)
    found = rows.join(F.broadcast(hot), "sha1", "left").withColumn("key", key).join(
        heads.select(F.col("sha1").alias("key"), F.col("head").alias("cold")), "key", "left")
    head = F.when(F.col("size") >= REVISIT_BYTES, F.coalesce("hot", "cold"))
    revisit = head.isNotNull() & ~F.col("page_id").eqNullSafe(head)
    return found.select("page_id", "url", "html", "size", "sha1", revisit.alias("revisit"), F.when(revisit, head).alias("refers_to"))


def write_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Archives of all rows as ``archive, n_records, content``."""

    def work(batches):
        run, size, n = [], 0, 0

        def flush():
            nonlocal run, size, n
            content = archive(run)
            row = pa.RecordBatch.from_arrays(
                [pa.array([f"{hashlib.md5(content).hexdigest()}.warc.zst"]), pa.array([len(run)], pa.int64()),
                 pa.array([content], pa.binary())], names=["archive", "n_records", "content"])
            run, size, n = [], 0, n + 1
            return row

        for batch in batches:
            for r in batch.select(["page_id", "url", "size", "sha1", "revisit", "refers_to", "html"]).to_pylist():
                kind = "revisit" if r["revisit"] else "response"
                run.append(record(kind, r["page_id"], r["url"], r["html"].encode(), r["size"], r["sha1"],
                                  r["refers_to"]))
                size += len(run[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if run:
            yield flush()

    rows = with_roles(df, id_col, url_col, html_col)
    return written(rows.mapInArrow(work, "archive string, n_records long, content binary"), "warc")


def read_archives(archives: DataFrame, payload: bool = False, strict: bool = True) -> DataFrame:
    """One row per record of a table with ``archive`` and ``content``. A broken
    record ends the job if ``strict``, else it is a row with ``error`` (the rest
    of an archive with a broken frame can't be found and is that one row)."""
    names = [f.split()[0] for f in READ.split(", ")]
    types = {"string": pa.string(), "long": pa.int64()}
    kinds = [types[f.split()[1]] for f in READ.split(", ")] + [pa.binary()] * payload

    def records(name, content):
        try:
            for raw in frames(content):
                try:
                    yield parse(raw) | {"archive": name}
                except WarcError as e:
                    if strict:
                        raise
                    yield {"archive": name, "error": str(e)}
        except WarcError as e:
            if strict:
                raise WarcError(f"{name}: {e}") from e
            yield {"archive": name, "error": str(e)}

    def batch_of(rows):
        cols = [pa.array([r.get(c) for r in rows], t) for c, t in zip(names + ["payload"] * payload, kinds)]
        return pa.RecordBatch.from_arrays(cols, names=names + ["payload"] * payload)

    def work(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                run, size = [], 0
                for r in records(name, content.as_py() or b""):
                    if not payload:
                        r.pop("payload", None)
                    run.append(r)
                    size += 200 + len(r.get("payload") or b"")
                    if size > ARCHIVE_BYTES:
                        yield batch_of(run)
                        run, size = [], 0
                yield batch_of(run)

    return archives.select("archive", "content").mapInArrow(work, READ + ", payload binary" * payload)


def export_files(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a file of a folder that every executor mounts;
    returns ``archive, n_bytes``. A file appears under its name only when whole."""

    def work(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = os.path.join(folder, f".{name}.{os.getpid()}")
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, os.path.join(folder, name))
                rows.append((name, len(content)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                              pa.array([r[1] for r in rows], pa.int64())],
                                             names=["archive", "n_bytes"])

    return archives.select("archive", "content").mapInArrow(work, "archive string, n_bytes long")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as ``archive, content``, for ``read_archives``."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def round_trip(df: DataFrame) -> DataFrame:
    """Write every page to archives and read the archives back."""
    return read_archives(write_archives(df)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
