"""WARC archives: write pages as request, response or revisit, and metadata records; read them and assemble captures.

Writing: of equal payloads of at least ``LEAST`` bytes the page with the largest id is a response, the others revisit
it. Spark's text writer puts the records into gzip files in the shared folder, so a lost task leaves nothing behind;
every record ends with the line end that the writer adds. Reading: each file is unpacked and parsed as a stream, and
request and metadata records join their response through WARC-Concurrent-To, one nested row per capture.

Null html counts as empty; a null url is left out of the record; a page without id is a response that nobody revisits;
repeated rows are captures of their own; a capture without request or metadata has null there.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from netsieve.session import materialize, run_dir

LEAST = 1000  # bytes of a payload that may be revisited
PER_FILE = 6000  # records in a file at most
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WHEN = "2020-01-01T00:00:00Z"


def _record(kind: str, rid: str, block: bytes, content: str, **fields: str | None) -> bytes:
    """The bytes of a record, without its very last line end."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{rid}>", f"WARC-Date: {WHEN}"]
    head += [f"{k.replace('_', '-')}: {_line(v)}" for k, v in fields.items() if v is not None]
    head += [f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r"


def _line(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.splitlines())


def page_records(name: str, page_id, url: str | None, payload: bytes, refers_to, refers_url: str | None) -> list[bytes]:
    """The three records of one page."""
    ids = [str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}/{part}")) for part in ("request", "response", "metadata")]
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    together = f"<urn:uuid:{ids[1]}>"
    path = _line(url) if url else "/"
    request = _record("request", ids[0], f"GET {path} HTTP/1.1\r\n\r\n".encode(), "application/http; msgtype=request", WARC_Target_URI=url, WARC_Concurrent_To=together)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "application/http; msgtype=response"
    if refers_to is None:
        answer = _record("response", ids[1], head + payload, kind, WARC_Target_URI=url, WARC_Payload_Digest=digest)
    else:
        answer = _record("revisit", ids[1], head, kind, WARC_Target_URI=url, WARC_Payload_Digest=digest, WARC_Profile=REVISIT, WARC_Refers_To_Target_URI=refers_url)
    said = {"page-id": page_id, "payload-bytes": len(payload), "refers-to-page": refers_to}
    block = "".join(f"{k}: {v}\r\n" for k, v in said.items() if v is not None).encode()
    return [request, answer, _record("metadata", ids[2], block, "application/warc-fields", WARC_Target_URI=url, WARC_Concurrent_To=together)]


def write_archives(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files below ``path``."""
    base = pages.selectExpr("page_id", "url", "CAST(coalesce(html, '') AS BINARY) AS payload")
    named = base.where(F.col("page_id").isNotNull() & (F.octet_length("payload") >= least)).select("page_id", "url", F.sha1("payload").alias("digest"))
    # a digest that many pages share is reduced on the map side, and the table of shared digests is read anew for the join
    shared = named.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(shared.select("digest", "first"), "payloads")
    again = named.join(shared, "digest").where("page_id <> first.page_id").groupBy("page_id").agg(F.max("digest").alias("revisits"), F.max("first").alias("first"))
    rows = base.join(again, "page_id", "left").select("page_id", "url", "payload", "revisits", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            out = []
            for page, url, payload, digest, to, to_url in b.itertuples(index=False):
                page, to = (None if pd.isna(x) else int(x) for x in (page, to))
                if to is not None and hashlib.sha1(payload).hexdigest() != digest:  # another row of the same id
                    to = None
                out += page_records(f"{path}/{part}/{n}", page, url, payload, to, to_url)
                n += 1
            yield pd.DataFrame({"record": out})

    records = rows.mapInPandas(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


class _Stream:
    """Reads lines and blocks from a packed file without unpacking all of it."""

    def __init__(self, packed: bytes):
        self.packed, self.at, self.inflate, self.buffer = packed, 0, zlib.decompressobj(47), bytearray()

    def _more(self) -> bool:
        if self.inflate.eof:
            rest = self.inflate.unused_data
            if not rest:
                return False
            self.packed, self.at, self.inflate = rest + self.packed[self.at :], 0, zlib.decompressobj(47)
        part = self.packed[self.at : self.at + (1 << 16)]
        if not part:
            return False
        self.at += len(part)
        self.buffer += self.inflate.decompress(part)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Everything up to ``mark``, which is skipped; None at the end."""
        seen = 0
        while (i := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self._more():
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        if len(self.buffer) < n:
            raise ValueError("a record is cut short")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def parse(packed: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of a file."""
    stream = _Stream(packed)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield fields, stream.take(int(fields["content-length"]))
        stream.take(4)


RECORD = "type string, record_id string, concurrent_to string, target_uri string, payload_digest string, payload_bytes long, payload binary, http string, fields map<string,string>"


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of all archives below ``path``. Responses carry the digest and size of the payload as read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in RECORD.split(", ")]
        for b in batches:
            for packed in b["content"]:
                rows, size = [], 0
                for f, block in parse(packed):
                    kind, digest, n, payload, http, said = f["warc-type"], None, None, None, None, None
                    if kind in ("response", "revisit", "request"):
                        http_head, _, body = block.partition(b"\r\n\r\n")
                        http = http_head.decode("utf-8", "replace")
                        if kind == "response":
                            digest, n, payload = hashlib.sha1(body).hexdigest(), len(body), body if with_payload else None
                            size += len(body) if with_payload else 0
                    else:
                        said = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines()) if k}
                    if digest is None and "warc-payload-digest" in f:
                        digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                    rows.append((kind, f["warc-record-id"], f.get("warc-concurrent-to"), f.get("warc-target-uri"), digest, n, payload, http, said))
                    if size > 1 << 24 or len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=cols)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=cols)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``response`` (or revisit), and the first ``request`` and ``metadata`` by record id that
    name it in WARC-Concurrent-To."""
    answers = records.where("type IN ('response', 'revisit')").select("record_id", F.struct("type", "record_id", "target_uri", "payload_digest", "payload_bytes", "http", "payload").alias("response"))
    sides = records.where("type IN ('request', 'metadata') AND concurrent_to IS NOT NULL")

    def first(kind: str, *cols: str) -> F.Column:
        return F.min(F.when(F.col("type") == kind, F.struct("record_id", *cols))).alias(kind)

    by_id = sides.withColumn("said", F.to_json("fields")).groupBy(F.col("concurrent_to").alias("record_id")).agg(first("request", "target_uri", "http"), first("metadata", "said"))
    joined = answers.join(by_id, "record_id", "left")
    said = F.from_json("metadata.said", "map<string,string>")
    return joined.select("response", "request", F.when(F.col("metadata").isNotNull(), F.struct(F.col("metadata.record_id").alias("record_id"), said.alias("fields"))).alias("metadata"))


def archive(pages: DataFrame, with_payload: bool = True, least: int = LEAST) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read their captures back."""
    path = run_dir(pages.sparkSession, "warc")
    write_archives(pages, path, least)
    return assemble(read_records(pages.sparkSession, path, with_payload))


def page_rows(captures: DataFrame) -> DataFrame:
    """Per capture: page, payload size and digest, kind of record, and the page that a revisit refers to."""
    said = F.col("metadata.fields")
    return captures.select(
        said["page-id"].cast("long").alias("page_id"),
        F.coalesce(F.col("response.payload_bytes"), said["payload-bytes"].cast("long")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        said["refers-to-page"].cast("long").alias("refers_to"),
    )
