"""WARC derivatives: response records to linked metadata and plain-text conversion records.

Every derived record keeps the identifier of its source in refers_to, the source's HTTP header block and the digest
of its payload. Identifiers are made from the source's, so that a rerun gives the same records.

Files are read by Spark's text source with the version line as separator, as bytes: plain files are split over tasks and
compressed ones (by their suffix, member by member) stream through one, so a task holds a record and not a file. Records
are cut along their Content-Length: rows are put together again until it is reached, so a payload may hold anything, the
version line included; versions 1.0 and 1.1 are known. A record that reaches over the end of its split is not whole there;
files with such records are read once more, each by one task in order. Payloads are bytes throughout; a record that ends
before its length, or has no length, is marked ``whole`` false and not derived. ``silent_files`` names files that give nothing.

Outlinks are those of every anchor, whatever the case, quotes and place of its href. Character references, named (those of
HTML 4), decimal and hexadecimal, become their characters; a code that is none becomes the replacement character.

Defined results: a null page body is an empty payload, a null address an empty target. Payload bytes that are not UTF-8
are read as replacement characters in titles and text; length and digest are those of the bytes. Repeated pages give
repeated records with equal identifiers. Only page_id is kept of further columns, whatever their names; an empty table
gives no records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, materialize, setting, table

VERSION = "WARC/1.0"
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"

# Elements that break lines.
BREAKING = "p|div|li|ul|ol|br|h[1-6]|tr|table|title|article|section|header|footer|nav|pre|blockquote|main|aside"
HIDDEN = (r"(?s)<!--.*?-->", r"(?is)<script[^>]*>.*?</script[^>]*>", r"(?is)<style[^>]*>.*?</style[^>]*>", r"(?is)<head[^>]*>.*?</head[^>]*>")
BREAK = f"(?i)</?({BREAKING})(/|[ \\t\\r\\n][^>]*)?>"
TAG = r"(?s)<[/!]?[A-Za-z][^>]*>"
SPACES = "[ \\t\\r\\f\\x0B]+"
LINES = " ?\\n[ \\n]*"
EDGES = "^[ \\n]+|[ \\n]+$"
TITLE = r"(?is)<title[^>]*>(.*?)</title[^>]*>"
LINK = r"""(?is)<a[ \t\r\n](?:[^>]*?[ \t\r\n])?href[ \t\r\n]*=[ \t\r\n]*("[^"]*"|'[^']*'|[^ \t\r\n"'>]+)"""
QUOTES = "^[\"']|[\"']$"
REFERENCE = "&(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]*);"
#: Names of HTML 4, and what a space that does not break becomes here: a space.
NAMES = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"nbsp": " "}
UNKNOWN = "\ufffd"
#: Names that most pages hold, which need no pattern, and what tells that a text holds others.
COMMON, UNCOMMON = ("nbsp", "lt", "gt", "quot", "#39", "copy", "middot"), "&(#[0-9xX]|(?!amp;)[A-Za-z][A-Za-z0-9]*;)"


def uuid_of(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def character(reference: Column) -> Column:
    """What a reference, without its first and last sign, stands for."""
    code = F.when(reference.rlike("^#[xX]"), F.conv(F.substring(reference, 3, 8), 16, 10)).otherwise(F.substring(reference, 2, 8)).cast("long")
    real = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
    made = F.when(code == 160, " ").when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(UNKNOWN)
    known = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.when(reference.startswith("#"), made).otherwise(F.coalesce(F.try_element_at(known, reference), F.concat(F.lit("&"), reference, F.lit(";"))))


def characters(text: Column) -> Column:
    """The text with its references replaced, each once: what a reference gives is not read again."""
    for name in COMMON:  # none of these gives a sign that begins a reference
        text = F.replace(text, F.lit(f"&{name};"), F.lit(NAMES.get(name, "'")))

    def rest(held: Column) -> Column:
        between, references = F.split(held, REFERENCE, -1), F.regexp_extract_all(held, F.lit(REFERENCE), 1)
        made = F.concat_ws("", F.flatten(F.zip_with(between, F.transform(references, character), lambda b, c: F.array(b, F.coalesce(c, F.lit(""))))))
        return F.when(~F.contains(held, F.lit("&")), held).when(F.regexp_like(held, F.lit(UNCOMMON)), made).otherwise(F.replace(held, F.lit("&amp;"), F.lit("&")))

    return F.get(F.transform(F.array(text), rest), F.lit(0))  # worked out once, read several times


def outlinks(payload: Column) -> Column:
    """Targets of all anchors, in order."""
    bare = lambda v: F.when(v.startswith('"') | v.startswith("'"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    found = F.transform(F.regexp_extract_all(payload, F.lit(LINK), 1), bare)
    return F.transform(found, lambda v: F.when(F.contains(v, F.lit("&")), characters(v)).otherwise(v))


def plain_text(html: Column) -> Column:
    """Visible text, one line for each block."""
    for pattern in HIDDEN:
        html = F.regexp_replace(html, pattern, " ")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, "[\\r\\n]+", " "), BREAK, "\n"), TAG, "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(characters(text), SPACES, " "), LINES, "\n"), EDGES, "")


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of a page table: record_id, target_uri, date, http_header, payload, payload_digest."""
    payload = F.coalesce("html", F.lit(""))
    uri = F.coalesce("url", F.lit(""))
    header = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"))
    return pages.select("page_id", uuid_of(F.lit("response"), F.col("page_id").cast("string"), uri).alias("record_id"), uri.alias("target_uri"), F.lit(date).alias("date"), header.alias("http_header"), payload.alias("payload"), digest(payload).alias("payload_digest"))


def text_of(payload: Column) -> Column:
    """Bytes as text, those that are not UTF-8 as replacement characters."""
    return F.call_function("make_valid_utf8", payload.cast("string"))


def derivatives(records: DataFrame) -> DataFrame:
    """One metadata and one conversion record for each response, linked to it and to each other."""
    title = characters(F.regexp_replace(F.regexp_extract("payload", TITLE, 1), "[ \\t\\r\\n]+", " "))
    links = F.col("links")
    fields = F.concat(F.lit("title: "), title, F.lit(f"{CRLF}outlinks: "), F.size(links).cast("string"), F.when(F.size(links) > 0, F.concat(F.lit(CRLF), F.concat_ws(CRLF, F.transform(links, lambda u: F.concat(F.lit("outlink: "), u))))).otherwise(""))
    kept = [c for c in ("page_id", "record_id", "target_uri", "date", "http_header", "payload_digest") if c in records.columns]
    if "whole" in records.columns:
        records = records.where("whole")
    records = records.select(*kept, "payload")
    if dict(records.dtypes)["payload"] == "binary":
        records = records.withColumn("payload", text_of(F.col("payload")))
    records = records.select(*kept, "payload", outlinks(F.col("payload")).alias("links"))
    both = records.select(*kept, F.inline(F.array(F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")), F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), plain_text(F.col("payload")).alias("block")))))
    return both.select(
        *[c for c in kept if c not in ("record_id", "http_header", "payload_digest")],
        "record_type",
        uuid_of(F.col("record_type"), F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        uuid_of(F.when(F.col("record_type") == "metadata", "conversion").otherwise("metadata"), F.col("record_id")).alias("concurrent_to"),
        "content_type",
        F.col("http_header").alias("source_header"),
        F.col("payload_digest").alias("source_digest"),
        digest(F.col("block")).alias("block_digest"),
        F.octet_length("block").cast("long").alias("content_length"),
        "block",
    )


def serialised(records: DataFrame) -> DataFrame:
    """Column record: header lines and block of derived records, without the version line and the end."""
    lines = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Source-Payload-Digest", "source_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    source = F.concat(F.lit("WARC-Source-HTTP-Header: "), F.replace("source_header", F.lit(CRLF), F.lit("; ")))
    head = F.concat_ws(CRLF, *[F.concat(F.lit(f"{n}: "), F.col(c).cast("string")) for n, c in lines], source)
    return records.select(F.concat(head, F.lit(CRLF + CRLF), F.col("block")).alias("record"))


def serialised_responses(records: DataFrame) -> DataFrame:
    """The same for response records."""
    block = F.concat(F.col("http_header"), F.lit(CRLF + CRLF), F.col("payload"))
    lines = [("WARC-Type", F.lit("response")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("date")), ("WARC-Payload-Digest", F.col("payload_digest")), ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(block).cast("string"))]
    head = F.concat_ws(CRLF, *[F.concat(F.lit(f"{n}: "), c) for n, c in lines])
    return records.select(F.concat(head, F.lit(CRLF + CRLF), block).alias("record"))


def write_warc(serial: DataFrame, path: str, compression: str = "none") -> None:
    """Files of records; each begins with the version line and ends with two line ends, as strict readers ask."""
    serial.select(F.concat(F.lit(VERSION + CRLF), F.col("record")).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", compression).mode("overwrite").text(path)


HEAD = re.compile(rb"WARC/1\.[01]\r\n")
FIELD = re.compile(rb"(?m)^([^:\r\n]+):[ \t]*([^\r\n]*)")
SEPARATOR = CRLF + CRLF + "WARC/1."


def cut_records(data: bytes, more: bool = False) -> Iterator[tuple[dict[str, str], bytes, bool] | int]:
    """Header fields, block and wholeness of records. After a broken record the next version line is sought.

    With ``more`` to come, cutting stops before a record that is not there in full, and ends with the place where it begins.
    """
    at = 0
    while found := HEAD.search(data, at):
        end = data.find(b"\r\n\r\n", found.end())
        if end < 0:
            if more:
                break
            yield {}, b"", False
            return
        fields = {k.decode("latin1").lower(): v.decode("utf8", "replace").strip() for k, v in FIELD.findall(data[found.end() : end + 2])}
        size = fields.get("content-length", "")
        begin = end + 4
        stop = begin + int(size) if size.isdecimal() else -1
        if more and stop + 4 > len(data):
            break
        after = data[stop : stop + 4] if 0 <= stop <= len(data) else None
        whole = after is not None and (after == b"\r\n\r\n" or (stop + len(after) == len(data) and not after.strip()))
        if not whole:
            nearest = HEAD.search(data, begin)
            if more and not nearest:
                break
            stop = nearest.start() if nearest else len(data)
        yield fields, data[begin:stop], whole
        at = stop
    if more:
        yield found.start() if found else len(data)


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("warc-record-id", "warc-target-uri", "warc-date", "warc-payload-digest")
    separator, rows, held, last = SEPARATOR.encode(), [], b"", None

    def taken(file: str, more: bool) -> int:
        reached = 0
        for record in cut_records(held, more):
            if isinstance(record, int):
                reached = record
            else:
                fields, block, whole = record
                if not whole or fields.get("warc-type", "").lower() == "response":
                    header, _, payload = block.partition(b"\r\n\r\n")
                    rows.append((*(fields.get(n, "") for n in names), header.decode("utf8", "replace"), payload, whole, file, fields.get("warc-type", "").lower() == "response"))
        return reached

    def flushed() -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.binary(), pa.bool_(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["record_id", "target_uri", "date", "payload_digest", "http_header", "payload", "whole", "file", "response"])
        rows.clear()

    for batch in batches:
        for value, file in zip(column(batch, "value"), column(batch, "file").to_pylist(), strict=True):
            if file != last:
                taken(last, False)
                held, last = b"", file
            piece = value.as_buffer().to_pybytes()
            # the reader took the separator away; what follows one ends the record before it
            held = held + separator + piece if held or not HEAD.match(piece) else piece
            held = held[taken(file, True) :]
            if len(rows) >= 100:
                yield from flushed()
    taken(last, False)
    if rows:
        yield from flushed()


def _records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    pieces = spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    return pieces.mapInArrow(_responses, "record_id string, target_uri string, date string, payload_digest string, http_header string, payload binary, whole boolean, file string, response boolean")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, compressed or not, payloads as bytes, with their ``file``, and ``whole`` false where the length does not match."""
    found = _records(spark, path)
    torn = [r["file"] for r in found.where("not whole").select("file").distinct().collect()]
    if torn:  # broken, or cut by the border of a split: each again by one task
        with setting(spark, "spark.sql.files.maxPartitionBytes", str(1 << 40)), setting(spark, "spark.sql.files.openCostInBytes", str(1 << 40)):  # a file a task
            again = materialize(_records(spark, torn), "torn")
        found = found.where(~F.col("file").isin(torn)).unionByName(again)
    return found.where("response").drop("response")


def silent_files(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """Files of a folder that gave no response record: file, length."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    return listed.join(records.select("file").distinct(), "file", "left_anti")


def op1_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    """Derived records of every page."""
    return derivatives(responses(table(spark, sf_dir, "pages")))


def oracle() -> str:
    """The same rows in DuckDB SQL."""

    def q(text: str) -> str:
        inside = text.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '")
        return f"('{inside}')"

    def uuid(*parts: str) -> str:
        h = "md5(" + " || '|' || ".join(parts) + ")"
        return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"

    names = "MAP {" + ", ".join(f"{q(n)}: {q(c)}" for n, c in NAMES.items()) + "}"
    code = "CASE WHEN starts_with(lower(r), '#x') THEN CAST('0x' || substr(r, 3) AS BIGINT) ELSE CAST(substr(r, 2) AS BIGINT) END"
    real = f"({code} > 0 AND {code} < 55296) OR ({code} > 57343 AND {code} < 1114112)"
    letter = f"CASE WHEN starts_with(r, '#') THEN CASE WHEN {code} = 160 THEN ' ' WHEN {real} THEN chr(CAST({code} AS INTEGER)) ELSE {q(UNKNOWN)} END ELSE coalesce({names}[r], '&' || r || ';') END"

    def replaced(text: str) -> str:
        between, references = f"string_split_regex({text}, {q(REFERENCE)})", f"regexp_extract_all({text}, {q(REFERENCE)}, 1)"
        return f"array_to_string(list_transform(list_zip({between}, list_transform({references}, lambda r: {letter})), lambda z: z[1] || coalesce(z[2], '')), '')"

    def sub(text: str, pattern: str, to: str) -> str:
        return f"regexp_replace({text}, {q(pattern)}, {q(to)}, 'g')"

    body = "payload"
    for pattern in HIDDEN:
        body = sub(body, pattern, " ")
    body = sub(sub(sub(body, "[\\r\\n]+", " "), BREAK, "\n"), TAG, "")
    body = sub(sub(sub(replaced(body), SPACES, " "), LINES, "\n"), EDGES, "")
    title = replaced(sub(f"regexp_extract(payload, {q(TITLE)}, 1)", "[ \\t\\r\\n]+", " "))
    links = f"list_transform(regexp_extract_all(payload, {q(LINK)}, 1), lambda v: {replaced(sub('v', QUOTES, ''))})"
    fields = f"'title: ' || {title} || {q(CRLF)} || 'outlinks: ' || len({links}) || CASE WHEN len({links}) > 0 THEN {q(CRLF)} || array_to_string(list_transform({links}, lambda u: 'outlink: ' || u), {q(CRLF)}) ELSE '' END"
    header = f"'HTTP/1.1 200 OK' || {q(CRLF)} || 'Content-Type: text/html; charset=utf-8' || {q(CRLF)} || 'Content-Length: ' || strlen(payload)"
    return f"""WITH src AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
resp AS (SELECT *, {uuid("'response'", "CAST(page_id AS VARCHAR)", "target_uri")} AS refers_to, {header} AS source_header, 'sha256:' || sha256(payload) AS source_digest FROM src),
both_ AS (SELECT page_id, target_uri, refers_to, source_header, source_digest, 'metadata' AS record_type, 'application/warc-fields' AS content_type, {fields} AS block FROM resp
UNION ALL SELECT page_id, target_uri, refers_to, source_header, source_digest, 'conversion', 'text/plain', {body} FROM resp)
SELECT page_id, target_uri, '{DATE}' AS date, record_type, {uuid("record_type", "refers_to")} AS record_id, refers_to, {uuid("CASE WHEN record_type = 'metadata' THEN 'conversion' ELSE 'metadata' END", "refers_to")} AS concurrent_to,
content_type, source_header, source_digest, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length, block FROM both_"""
