"""WARC archives: write records, normalise monolithic gzip files to one member per record, read back by offset.

The first archives are what a text writer with gzip makes: one gzip stream around all records of a file. The normaliser
inflates each stream once, front to back, rewrites every record as a gzip member of its own, and writes a sidecar index
(one JSON line per record with archive, offset and length) beside the archive. Readers then fetch single members.
Files are moved to their final names when complete, so repeated or speculative attempts replace equal content.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_arrow, shared_folder, written

CRLF = "\r\n"
INDEX = "archive string, offset bigint, length bigint, record_id string, record_type string, payload_digest string"
RECORDS = (
    "record_id string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1; 5 hexadecimal digits are 4 digits to base 32."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to.

    Of records with equal payloads of at least ``min_bytes``, the smallest page_id is the response and the others
    revisit it. A null html is empty. Rows that repeat the smallest id are responses too; rows without id sort last, and
    are responses where no row with that payload has an id.
    """
    made = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    made = made.withColumns({"payload_bytes": F.octet_length("html").cast("bigint"), "payload_digest": base32_sha1(F.col("html").cast("binary"))})
    # one row per repeated payload after partial aggregation, so a payload of very many pages is no hot group; written,
    # so that Spark knows the table's size when it plans the join and moves pages only if it is large
    first = made.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    repeated = (F.col("n") > 1) & (F.col("payload_bytes") >= min_bytes) & F.col("first_id").isNotNull()
    first = written(first.filter(repeated).drop("n"), "payloads")
    joined = made.join(first, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest",
                         F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def record_text(date: str) -> Column:
    """A whole record; header values lose control characters, which would end a header line."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    lines = [
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), shown("page_id"), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x1f\x7f]", "%20"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(">"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines), F.lit(CRLF * 2), block)


def write_monolithic(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 20_000) -> None:
    """One gzip stream per file around all its records, each followed by two line ends."""
    writer = records.select(record_text(date).alias("value")).write.option("compression", "gzip")
    writer.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).text(path)


def inflate(content: bytes, chunk: int = 1 << 16) -> Iterator[bytes]:
    """Inflated bytes of a gzip file, read once; a cut-off stream is an error."""
    view, at = memoryview(content), 0
    while at < len(view):
        inflater = zlib.decompressobj(31)
        while not inflater.eof:
            if at >= len(view):
                raise ValueError("gzip stream ends early")
            part = view[at : at + chunk]
            at += len(part)
            yield inflater.decompress(part)
        at -= len(inflater.unused_data)


def split_records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of each record in a stream, with one record held at a time."""
    held, ended = bytearray(), False
    while True:
        head = held.find(b"\r\n\r\n")
        need = None
        if head >= 0:
            headers = parse_headers(bytes(held[:head]))
            need = head + 4 + int(headers["content-length"])
        if need is not None and len(held) >= need + 4:
            if held[need : need + 4] != b"\r\n\r\n":
                raise ValueError("record does not end where its length says")
            yield headers, bytes(held[: need + 4])
            del held[: need + 4]
            continue
        if ended:
            if held:
                raise ValueError("archive ends inside a record")
            return
        for part in parts:
            held += part
            # fetch in large steps: a long record is searched for its end only when it can be complete
            if len(held) >= (need or 0) + 4:
                break
        else:
            ended = True


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split(CRLF)
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path as Hadoop writes it."""
    return fs.FileSystem.from_uri("file://" + path[len("file:") :] if path.startswith("file:/") and not path.startswith("file://") else path)


def put(store: fs.FileSystem, path: str, data: list[bytes]) -> None:
    draft = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(draft, compression=None) as out:
        for part in data:
            out.write(part)
    store.move(draft, path)


def normalise(spark: SparkSession, source: str, target: str, level: int = 4) -> DataFrame:
    """Rewrite every archive below ``source`` into ``target``; returns the index, which the sidecars hold as well."""
    store, folder = file_system(target)
    store.create_dir(folder, recursive=True)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out_store, out_folder = file_system(target)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = path.rsplit("/", 1)[-1].split(".", 1)[0] + ".warc.gz"
                members, index, offset = [], [], 0
                for headers, record in split_records(inflate(content.as_py())):
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    members.append(packer.compress(record) + packer.flush())
                    index.append({"archive": name, "offset": offset, "length": len(members[-1]), "record_id": headers["warc-record-id"],
                                  "record_type": headers["warc-type"], "payload_digest": headers.get("warc-payload-digest")})
                    offset += len(members[-1])
                put(out_store, f"{out_folder}/{name}", members)
                put(out_store, f"{out_folder}/{name}.idx", [(json.dumps(x) + "\n").encode() for x in index])
                yield {k: [x[k] for x in index] for k in ("archive", "offset", "length", "record_id", "record_type", "payload_digest")}

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source)
    done = map_arrow(files.select("path", "content"), rewrite, INDEX)
    done.write.format("noop").mode("overwrite").save()
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(target)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Fetch the records an index lists, member by member."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        store, root = file_system(folder)
        name, file = None, None
        for batch in batches:
            rows, size = [], 0
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != name:
                    name, file = archive, store.open_input_file(f"{root}/{archive}")
                file.seek(offset)
                rows.append(parsed(zlib.decompress(file.read(length), 31)))
                size += len(rows[-1][-1] or b"")
                if size > 16 << 20:
                    yield named(rows)
                    rows, size = [], 0
            yield named(rows)

    return map_arrow(index.select("archive", "offset", "length"), fetch, RECORDS)


def named(rows: list[tuple]) -> dict:
    names = [c.split()[0] for c in RECORDS.split(", ")]
    return dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}


def page_number(uri: str) -> int | None:
    value = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


def parsed(record: bytes) -> tuple:
    head, _, rest = record[:-4].partition(b"\r\n\r\n")
    headers = parse_headers(head)
    payload = rest.partition(b"\r\n\r\n")[2]
    revisit = headers["warc-type"] == "revisit"
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
    size = int(headers["warc-payload-length"]) if revisit else len(payload)
    return (headers["warc-record-id"], page_number(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], page_number(headers.get("warc-refers-to", "")), size, digest,
            None if revisit else payload)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as monolithic archives, normalise them and read every record back through the index.

    An empty table gives no records; repeated rows are records of their own; other columns are not read.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_monolithic(with_revisits(pages, min_bytes), f"{folder}/monolithic")
    index = normalise(spark, f"{folder}/monolithic", f"{folder}/records")
    return read_records(index, f"{folder}/records")
