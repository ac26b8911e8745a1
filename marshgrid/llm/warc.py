r"""WARC archives, index first.

Writing: every task writes one archive of gzip members, one record each, under a name of its
own, and returns an index row per record: file, offset, length, URL, digest.  The index is a
Spark table; a task that is run again leaves its first archive unused, for the index does not
name it.  Reading: the index selects records, rows are sorted by file and offset, neighbouring
byte ranges are read in one request, and records are cut out of what was read.

A payload that was stored before (equal digest and size) becomes a revisit of the record with
the smallest id; payloads below ``min_bytes`` are always stored.

Defined results: a null payload is empty; a null URL leaves the header out; control characters
in a URL are percent-encoded in the record, not in the index; rows that repeat an id and
payload are stored each; a null id is read back as null; an empty table has no archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marshgrid.llm import common as C

#: Requests: ranges closer than GAP are read together, up to about SPAN bytes.
GAP, SPAN = 64 << 10, 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member.  The block is an HTTP head and, unless a revisit, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    plain = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(plain) + squeeze.flush()


def parse(member: bytes) -> dict:
    """Fields of one record; a stored payload is checked against its digest."""
    plain = zlib.decompress(member, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    stored = field["WARC-Type"] == "response"
    if stored and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"payload of {field['WARC-Record-ID']} is damaged")

    def number(name):
        value = field[name].removeprefix("<urn:page:").removesuffix(">") if name in field else "None"
        return None if value == "None" else int(value)
    return {"page_id": number("WARC-Record-ID"), "url": field.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
            "record_type": field["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload": payload if stored else None}


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], names=list(names))


def _write_batches(folder: str):
    def run(batches):
        target, sink, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for page_id, url, html, hex_, head in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "head"))):
                if sink is None:
                    fs, name = _fs(target)
                    sink = fs.open_output_stream(name, compression=None)  # the members are compressed already
                digest = base64.b32encode(bytes.fromhex(hex_)).decode()
                member = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, head)
                sink.write(member)
                rows.append((page_id, target, at, len(member), url, digest, "response" if head is None else "revisit", head))
                at += len(member)
            if rows:
                yield _batch(rows, _INDEX)
        if sink is not None:
            sink.close()
    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html") -> DataFrame:
    """Write a record per row below ``folder`` (default: the shared folder) and return the index."""
    spark = pages.sparkSession
    C.ship(spark)
    folder = folder or C.shared_folder(spark, "warc")
    fs, name = _fs(folder)
    fs.create_dir(name, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha1": F.sha1("html"), "size": F.octet_length("html"), "pid": F.coalesce("page_id", F.lit((1 << 63) - 1))})
    # Digests alone decide who revisits whom; they are combined on the map side.
    digests = rows.where(F.col("size") >= min_bytes).select("pid", "page_id", "sha1", "size")
    firsts = digests.groupBy("sha1", "size").agg(F.min("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "size", "head")
    again = digests.join(firsts, ["sha1", "size"]).where("head <> pid").select("pid", "sha1", "size", "head").distinct()
    # Payloads move once, dealt out by id: a digest that many pages share does not gather in one archive.
    dealt = rows.join(again, ["pid", "sha1", "size"], "left").select("page_id", "url", "html", "sha1", "head")
    return C.saved(dealt.mapInArrow(_write_batches(folder), _INDEX), "warc-index")


def _read_batches(with_payload: bool):
    def run(batches):
        pending: list[tuple] = []  # neighbouring records of one file
        file, opened = None, None

        def fetch():
            begin, end = pending[0][0], pending[-1][0] + pending[-1][1]
            raw = opened.read_at(end - begin, begin)
            out = []
            for offset, length in pending:
                got = parse(raw[offset - begin:offset - begin + length])
                if not with_payload:
                    got["payload"] = None
                out.append(tuple(got.values()))
            pending.clear()
            return _batch(out, _RECORD)
        for batch in batches:
            for uri, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if pending and (uri != file or offset - sum(pending[-1]) > GAP or offset + length - pending[0][0] > SPAN):
                    yield fetch()
                if uri != file:
                    if opened is not None:
                        opened.close()
                    fs, name = _fs(uri)
                    file, opened = uri, fs.open_input_file(name)
                pending.append((offset, length))
        if pending:
            yield fetch()
        if opened is not None:
            opened.close()
    return run


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the rows of ``index`` name, from sorted and coalesced byte ranges.

    Columns page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload
    (null for revisits, or if not asked for).
    """
    C.ship(index.sparkSession)
    # As many tasks as archives: index rows are small, what they stand for is not.
    n = max(1, index.select("file").distinct().count())
    ranges = index.select("file", "offset", "length").repartition(n, "file").sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(_read_batches(with_payload), _RECORD)
