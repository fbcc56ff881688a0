"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A record is a row: warc_type, record_id, target_uri, date, refers_to, content_type,
block_digest, payload_digest, headers (an ordered array of name and value) and block (binary).
``read`` and ``write`` go between rows and .warc or .warc.gz files, one gzip member a record
(several where it is over 8 MB), without loss where headers are UTF-8; ``from_pages`` makes response records of a table of pages; ``derive`` makes of
each response

- a metadata record (application/warc-fields): source status, type, length and digest, the
  title and the number of links, and
- a conversion record (text/plain): the text without markup, scripts and styles,

both with WARC-Refers-To the response's id, its target and date.  Ids are made from the
digest of what they name, so reruns agree; digests are sha256 in lower-case hex.

A body is read by the charset that its header names: Latin-1 (and its Windows relative, which
agrees with it on letters) as such, anything else as UTF-8 with U+FFFD for what is not.

Defined cases: a null URL, block or body is empty; responses without text give an empty
conversion, and so do those whose type is an image, sound, film, font or archive; records of
other types derive nothing; repeated pages give repeated records; headers that derivation does
not know stay in the response.  Numeric entities and compressed or chunked bodies stay as they are.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HEADERS = "array<struct<name:string,value:string>>"
RECORD = f"warc_type string, record_id string, target_uri string, date string, refers_to string, content_type string, block_digest string, payload_digest string, headers {_HEADERS}, block binary"
_NAMED = {"WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "WARC-Refers-To": "refers_to", "Content-Type": "content_type", "WARC-Block-Digest": "block_digest", "WARC-Payload-Digest": "payload_digest"}
DATE = "2024-01-01T00:00:00Z"
#: The entities that plain text decodes.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&bull;", "•"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"), ("&amp;", "&"))


def plain_text(html: Column) -> Column:
    """Without comments, scripts, styles and tags; entities decoded; blanks collapsed, one line a block."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style"):
        text = F.regexp_replace(text, rf"(?is)<{tag}[^>]*>.*?</{tag}[^>]*>", " ")
    text = F.regexp_replace(text, r"\s+", " ")
    text = F.regexp_replace(text, r"(?i)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|title|head|body|html|nav|footer|header|section|article)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.regexp_replace(text, r"[ \t]*\n[ \t\n]*", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"^[ \n]+|[ \n]+$", "")


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def _id(kind: str, of: Column) -> Column:
    """An id in the form of a UUID, from a hash of the kind and what is named."""
    h = F.md5(F.concat(F.lit(kind + " "), of).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _headers(**named: Column) -> Column:
    """The headers that have a value, in order."""
    names = {v: k for k, v in _NAMED.items()}
    every = F.array(*(F.struct(F.lit(names[k]).alias("name"), v.alias("value")) for k, v in named.items()))
    return F.filter(every, lambda h: h["value"].isNotNull())


def _record(df: DataFrame, keep: list[str], **named: Column) -> DataFrame:
    block = named.pop("block")
    order = ["warc_type", "record_id", "target_uri", "date", "refers_to", "content_type", "block_digest", "payload_digest"]
    full = {k: named.get(k, F.lit(None).cast("string")) for k in order}
    return df.select(*keep, *(v.alias(k) for k, v in full.items()), _headers(**full).alias("headers"), block.alias("block"))


def from_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    """A response record for each page, with ``page_id``."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("u"), F.concat(head, body).alias("b"), _digest(body).alias("p"))
    rows = rows.withColumn("d", _digest(F.col("b")))
    return _record(rows, ["page_id"], warc_type=F.lit("response"), record_id=_id("response", F.concat_ws(" ", "page_id", "u", "d")), target_uri=F.col("u"), date=F.lit(date), content_type=F.lit("application/http; msgtype=response"), block_digest=F.col("d"), payload_digest=F.col("p"), block=F.col("b"))


def _bodies(responses: DataFrame) -> DataFrame:
    """``__head`` and ``__html`` of each response, parted as bytes at the first empty line; without one, all is body."""
    rows = responses.withColumn("__block", F.coalesce("block", F.lit(b"")))
    rows = rows.withColumn("__before", F.substring_index(F.col("__block").cast("string"), "\r\n\r\n", 1))
    size = F.octet_length("__before")
    whole = size == F.octet_length("__block")
    rows = rows.withColumn("__head", F.when(whole, F.lit("")).otherwise(F.make_valid_utf8("__before")))
    rows = rows.withColumn("__body", F.when(whole, F.col("__block")).otherwise(F.substring("__block", size + 5, F.octet_length("__block"))))
    kind = F.lower(F.regexp_extract("__head", r"(?im)^content-type:([^\r\n]*)", 1))
    latin = kind.rlike(r"charset=\s*[\"']?(iso-?8859-1|latin-?1|windows-1252|cp1252)\b")
    other = kind.rlike(r"^\s*((image|audio|video|font)/|application/(octet-stream|pdf|zip|x-zip|gzip|x-gzip)\b)")
    return rows.withColumn("__html", F.when(other, F.lit("")).when(latin, F.decode("__body", "ISO-8859-1")).otherwise(F.make_valid_utf8(F.col("__body").cast("string"))))


def derive(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Metadata and conversion records of the responses; ``keep`` are columns to carry along."""
    rows = _bodies(records.where("warc_type = 'response'"))
    fields = F.concat(
        F.lit("status: "), F.regexp_extract("__head", r"^HTTP/[0-9.]+ ([0-9]+)", 1),
        F.lit("\r\nsourceContentType: "), F.regexp_extract("__head", r"(?im)^content-type:[ ]*([^\r\n]*)", 1),
        F.lit("\r\nsourceLength: "), F.octet_length("__block").cast("string"),
        F.lit("\r\nsourceDigest: "), F.coalesce("payload_digest", F.lit("")),
        F.lit("\r\ntitle: "), F.trim(F.regexp_replace(F.regexp_extract("__html", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")),
        F.lit("\r\noutlinks: "), F.size(F.regexp_extract_all("__html", F.lit(r"(?i)<a\s[^>]*href"), F.lit(0))).cast("string"), F.lit("\r\n"),
    ).cast("binary")
    made = F.array(F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content"), fields.alias("made")), F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content"), plain_text(F.col("__html")).cast("binary").alias("made")))
    each = rows.select(*keep, F.col("record_id").alias("__from"), F.col("target_uri").alias("__uri"), F.col("date").alias("__date"), F.inline(made))
    each = each.withColumn("__digest", _digest(F.col("made")))
    ids = F.when(F.col("type") == "metadata", _id("metadata", F.concat_ws(" ", "__from", "__digest"))).otherwise(_id("conversion", F.concat_ws(" ", "__from", "__digest")))
    return _record(each, list(keep), warc_type=F.col("type"), record_id=ids, target_uri=F.col("__uri"), date=F.col("__date"), refers_to=F.col("__from"), content_type=F.col("content"), block_digest=F.col("__digest"), block=F.col("made"))


def serialised(headers: list[dict], block: bytes) -> bytes:
    """One record as it stands in a file."""
    lines = [f"{h['name']}: {h['value']}" for h in headers] + [f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "".join(x + "\r\n" for x in lines) + "\r\n").encode() + block + b"\r\n\r\n"


def parsed(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of one uncompressed stream, one at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers, size = [], 0
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and headers:
                headers[-1]["value"] += " " + line.decode().strip()
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.append({"name": name.strip(), "value": value.strip()})
        size = next((int(h["value"]) for h in headers if h["name"].lower() == "content-length"), 0)
        headers = [h for h in headers if h["name"].lower() != "content-length"]
        first = {h["name"].lower(): h["value"] for h in reversed(headers)}
        yield {own: first.get(name.lower()) for name, own in _NAMED.items()} | {"headers": headers, "block": stream.read(size)}


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    text = pa.string()
    fields = [(n, text) for n in ("warc_type", "record_id", "target_uri", "date", "refers_to", "content_type", "block_digest", "payload_digest")]
    fields += [("headers", pa.list_(pa.struct([("name", text), ("value", text)]))), ("block", pa.binary())]
    return pa.RecordBatch.from_pylist(rows, pa.schema(fields))


def read(spark: SparkSession, path: str, rows_at_once: int = 256) -> DataFrame:
    """Records of the .warc and .warc.gz files under ``path``; a file is one task's, as gzip cannot be split."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                raw = io.BytesIO(content.as_py())
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
                some: list[dict] = []
                for record in parsed(stream):
                    some.append(record)
                    if len(some) == rows_at_once:
                        yield _arrow(some)
                        some = []
                if some:
                    yield _arrow(some)

    return files.mapInArrow(records, RECORD)


def write(records: DataFrame, path: str, compress: bool = True, records_a_file: int = 10_000) -> None:
    """Write records as files of whole records under ``path``, through Spark's own text writer.

    The writer ends every row with a separator of at least a byte.  A gzip member of under
    16 MB ends with a zero byte (its length's last), a plain record with two line ends: that
    stands in as the separator, so the files are exactly the records.
    """
    part = 1 << 23

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for headers, block in zip(batch.column(0), batch.column(1), strict=True):
                one = serialised(headers.as_py(), block.as_py() or b"")
                out = [gzip.compress(one[k : k + part], mtime=0)[:-1] for k in range(0, len(one), part)] if compress else [one[:-4]]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = records.select("headers", "block").mapInArrow(members, "value binary").select(F.col("value").cast("string"))
    rows.write.option("lineSep", "\0" if compress else "\r\n\r\n").option("maxRecordsPerFile", records_a_file).text(path)


def digests(records: DataFrame) -> DataFrame:
    """Records without their blocks: what a query can be compared on."""
    return records.select("page_id", "warc_type", "record_id", "target_uri", "refers_to", "content_type", "block_digest", F.octet_length("block").cast("long").alias("n_bytes"))

