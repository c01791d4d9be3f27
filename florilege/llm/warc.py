"""WARC archives: writing captures, reading records back, and assembling transactions.

A capture is three records: the request, the response (or a revisit of an earlier response with an equal payload) and metadata.
Request and metadata name the response in WARC-Concurrent-To. Archives are gzip files of WARC/1.1 records, each of bounded size,
written by Spark's text sink with CRLF CRLF (the mark that ends a record) as separator, and read by the binaryFile source, so both
work on any file system that Spark does. The reader follows Content-Length, so payloads may hold any bytes; what cannot be read
becomes a row with an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.llm.hot import join_by_key
from florilege.llm.idfilter import split_by_ids
from florilege.llm.storage import materialize
from florilege.llm.worker import begin

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Uncompressed bytes of an archive file, beyond which it takes no further capture; one larger capture has a file of its own.
FILE_BYTES = 32 << 20
#: Payloads that occur more than once up to which their digests are broadcast.
BROADCAST_DIGESTS = 100_000
DATE = "2024-01-01T00:00:00Z"
RECORDS = "warc_type string, record_id string, concurrent_to array<string>, target_uri string, page_id long, refers_to long, content_type string, block_bytes long, stated_bytes long, stated_digest string, payload_bytes long, payload_digest string, payload binary, fields string, error string"
_END = "\r\n\r\n"


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, html, payload_digest, payload_bytes, refers_to`` of ``pages(page_id, url, html)``.

    Of equal payloads of at least ``least`` bytes the smallest page_id is the response, and all rows with that page_id; rows
    with other page_ids, null too, revisit it and have no html. If no page_id is known, all are responses. A null html counts as
    empty; other columns are ignored; an empty table gives no rows. Payloads are not shuffled: digests that come more than once
    are broadcast if they are few; else revisits are found among ids and digests, and a bitmap of them picks the responses.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    rows = rows.withColumn("capture_key", F.xxhash64("payload_digest", "page_id"))
    lean = materialize(rows.drop("html"), "pages")
    same = lean.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    same = materialize(same.where("n > 1 and refers_to is not null").select("payload_digest", "refers_to", "n"), "same-payloads")
    columns = ["page_id", "url", "html", "payload_digest", "payload_bytes", "refers_to"]
    other = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    if same.count() <= BROADCAST_DIGESTS:
        met = rows.join(F.broadcast(same.drop("n")), "payload_digest", "left").withColumn("refers_to", F.when(other, F.col("refers_to")))
        return met.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html"))).select(*columns)
    revisits = materialize(join_by_key(lean, same, ["payload_digest"], "n").where(other), "revisits")
    known = revisits.select("capture_key", F.col("payload_digest").alias("d"), F.col("page_id").alias("p"))
    is_ = (F.col("payload_digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p"))
    maybe, responses = split_by_ids(rows, "capture_key", known, "capture_key")
    # responses that the bitmap takes for revisits are told by their ids and digests too
    others = split_by_ids(lean, "capture_key", known, "capture_key")[0].join(known.drop("capture_key").distinct(), is_, "left_anti")
    others = materialize(others.select("capture_key", F.col("payload_digest").alias("d"), F.col("page_id").alias("p")).distinct(), "taken-for-revisits")
    responses = responses.unionByName(split_by_ids(maybe, "capture_key", others, "capture_key")[0].join(others.drop("capture_key"), is_, "left_semi"))
    responses = responses.withColumn("refers_to", F.lit(None).cast("long"))
    return responses.select(*columns).unionByName(revisits.withColumn("html", F.lit(None).cast("string")).select(*columns))


def _record(kind: str | Column, record_id: Column, block: Column, content_type: str, *fields: Column) -> Column:
    """One record without its end mark; ``fields`` are whole header lines with CRLF, or null for none."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = [F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), record_id, F.lit(f"\r\nWARC-Date: {DATE}\r\nContent-Type: {content_type}\r\n")]
    return F.concat(*head, *(F.coalesce(f, F.lit("")) for f in fields), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END), block)


def _urn(what: str) -> Column:
    h = F.md5(F.concat(F.lit(f"{what}/"), F.col("capture")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_archives(captures: DataFrame, path: str) -> None:
    """Write rows of :func:`with_revisits` as archives: a request, a response or revisit, and a metadata record each.

    Line breaks and other control characters in a url become %20, so that no url can end a header. A null url has no
    target line. A task that is run again writes its files anew. Captures are gathered to files by their bytes.
    """
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    target, page = _line("WARC-Target-URI", uri), _line("WARC-Page-ID", F.col("page_id").cast("string"))
    host = F.coalesce(F.regexp_extract(uri, "^[a-z]+://([^/?#]*)", 1), F.lit(""))
    where = F.coalesce(F.regexp_extract(uri, "^[a-z]+://[^/?#]*([^#]*)", 1), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END))
    revisit = F.col("refers_to").isNotNull()
    response, together = _urn("response"), _line("WARC-Concurrent-To", _urn("response"))
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest")))
    profile = F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), _line("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string"))))
    records = [
        _record("request", _urn("request"), F.concat(F.lit("GET "), F.when(where == "", "/").otherwise(where), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(_END)), "application/http; msgtype=request", target, together),
        _record(F.when(revisit, "revisit").otherwise("response"), response, F.concat(http, F.when(revisit, "").otherwise(F.coalesce("html", F.lit("")))), "application/http; msgtype=response", target, page, digest, profile),
        _record("metadata", _urn("metadata"), F.concat(F.lit("charset: UTF-8\r\npayloadBytes: "), F.col("payload_bytes").cast("string"), F.lit("\r\n")), "application/warc-fields", target, together),
    ]
    named = captures.withColumn("capture", F.concat_ws("/", F.col("page_id").cast("string"), F.monotonically_increasing_id().cast("string")))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("warc")
        held, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                raw = value.as_buffer().to_pybytes()
                if held and size + len(raw) > FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([_END.encode().join(held)]).cast(pa.string())], ["value"])
                    held, size = [], 0
                held.append(raw)
                size += len(raw)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_END.encode().join(held)]).cast(pa.string())], ["value"])

    files = named.select(F.concat_ws(_END, *records).alias("value")).mapInArrow(gather, "value string")
    files.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def inflate(content: bytes) -> Iterator[bytes]:
    """Uncompressed bytes of a gzip file of one or more members, in bounded parts; other bytes as they are."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    rest = content
    while rest:
        unzip = zlib.decompressobj(31)
        data = rest
        while data and not unzip.eof:
            yield unzip.decompress(data, 1 << 20)
            data = unzip.unconsumed_tail
        yield unzip.flush()
        rest = unzip.unused_data


def _fields(head: bytes) -> dict[str, list[str]]:
    """Values by name in lower case; a line that begins with a blank goes on with the one before."""
    out: dict[str, list[str]] = {}
    last: list[str] = []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            last[-1] = f"{last[-1]} {line.strip()}".strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = out.setdefault(name.strip().lower(), [])
            last.append(value.strip())
    return out


def _number(values: list[str] | None) -> int | None:
    """The number that a field has once; ValueError for anything else."""
    if not values:
        return None
    if len(values) > 1 or not values[0].isascii() or not values[0].isdigit():
        raise ValueError(f"no number: {values[0][:40]!r}")
    return int(values[0])


def parse(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, list[str]], bytes, str | None]]:
    """Header fields, block and error of each record.

    A record without a proper length has an error and no block; reading goes on at the next one that begins after an empty line.
    So has the last, if the archive ends within it, or if its bytes cannot be inflated.
    """
    held, lost, failed = bytearray(), False, None
    while True:
        try:
            part = next(parts, None)
        except (zlib.error, EOFError) as e:
            part, failed = None, f"{type(e).__name__}: {e}"
        if part is None:
            break
        held += part
        at = 0
        while True:
            if lost:
                found = held.find(b"\r\n\r\nWARC/", at)
                if found < 0:
                    at = max(at, len(held) - 8)
                    break
                at, lost = found, False
            while held.startswith(b"\r\n", at):
                at += 2
            end = held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            fields = _fields(bytes(held[held.find(b"\r\n", at) : end]))
            try:
                length = _number(fields.get("content-length"))
                if length is None or not held.startswith(b"WARC/", at):
                    raise ValueError("no length" if length is None else "no record begins here")
            except ValueError as e:
                yield fields, b"", str(e)
                at, lost = end, True
                continue
            stop = end + 4 + length
            if len(held) < stop:
                break
            yield fields, bytes(held[end + 4 : stop]), None
            at = stop
        del held[:at]
    if failed or (held.strip() and not lost):
        yield {}, b"", failed or "the archive ends within a record"


def _row(fields: dict[str, list[str]], block: bytes, error: str | None, payloads: bool) -> dict[str, object]:
    one = lambda name: fields[name][0] if name in fields else None
    numbers = {}
    for name in ("warc-page-id", "warc-refers-to-page-id"):
        try:
            numbers[name] = _number(fields.get(name))
        except ValueError as e:
            error = error or f"{name}: {e}"
    http = (one("content-type") or "").startswith("application/http")
    head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    try:
        stated = _number(_fields(head).get("content-length"))
    except ValueError:
        stated = None
    return {
        "warc_type": one("warc-type"), "record_id": one("warc-record-id"), "concurrent_to": fields.get("warc-concurrent-to"), "target_uri": one("warc-target-uri"),
        "page_id": numbers.get("warc-page-id"), "refers_to": numbers.get("warc-refers-to-page-id"), "content_type": one("content-type"), "block_bytes": len(block),
        "stated_bytes": stated, "stated_digest": (one("warc-payload-digest") or "").removeprefix("sha256:") or None,
        "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "payload": payload if payloads else None,
        "fields": head.decode("utf-8", "replace") if http else block.decode("utf-8", "replace"), "error": error,
    }


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; ``payloads`` says whether the payload bytes come along.

    A record that cannot be read has an ``error`` and what is known of it; it ends nothing but itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in RECORDS.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
        begin("warc")
        schema = pa.schema([(n, kinds[x.split(" ")[1]]) for n, x in zip(names, RECORDS.split(", "), strict=True)])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block, error in parse(inflate(content.as_buffer().to_pybytes())):
                    rows.append(_row(fields, block, error, payloads))
                    size += len(block) if payloads else 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit, with its request and its metadata records.

    A request or metadata record belongs to a capture if either names the other in one of its concurrent-to fields, or else if
    it is so joined to a request that belongs to the capture. ``request`` is the one with the least id, null if there is none;
    ``metadata`` is an array, empty if there is none. Requests and metadata without a capture give no row, nor do records with
    an error. The records are written once, so that archives are parsed once; what is joined are ids. Record ids are unique,
    so no key is hot, but for a capture that very many records name.
    """
    records = materialize(records.where("error is null"), "records")
    response = F.col("warc_type").isin("response", "revisit")
    names = records.where(F.col("concurrent_to").isNotNull()).select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    links = names.unionByName(names.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    ends = records.where(response | (F.col("warc_type") == "request")).select(F.col("record_id").alias("b"), response.alias("is_capture")).distinct()
    named = materialize(links.join(ends, "b"), "links")
    direct = named.where("is_capture").select("a", F.col("b").alias("of"))
    through = named.where("not is_capture").select("a", F.col("b").alias("via")).join(direct.select(F.col("a").alias("via"), "of"), "via")
    member = direct.unionByName(through.join(direct, "a", "left_anti").select("a", "of")).distinct()
    brief = F.struct("record_id", "target_uri", "content_type", "fields")
    others = records.where(F.col("warc_type").isin("request", "metadata")).select("warc_type", "record_id", brief.alias("brief"))
    by = others.join(member, F.col("record_id") == F.col("a")).groupBy("of").agg(
        F.min(F.when(F.col("warc_type") == "request", F.col("brief"))).alias("request"),
        F.array_sort(F.collect_list(F.when(F.col("warc_type") == "metadata", F.col("brief")))).alias("metadata"),
    )
    joined = records.where(response).join(by, F.col("record_id") == F.col("of"), "left")
    nested = F.struct("record_id", "target_uri", "content_type", "fields", "block_bytes", "payload")
    empty = F.expr("filter(array(struct(record_id, target_uri, content_type, fields)), x -> false)")
    size = F.when(F.col("warc_type") == "revisit", F.col("stated_bytes")).otherwise(F.col("payload_bytes"))
    digest = F.when(F.col("warc_type") == "revisit", F.col("stated_digest")).otherwise(F.col("payload_digest"))
    return joined.select("page_id", "warc_type", "refers_to", size.alias("payload_bytes"), digest.alias("payload_digest"), nested.alias("response"), "request", F.coalesce("metadata", empty).alias("metadata"))
