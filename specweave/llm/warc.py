"""WARC archives with revisit resolution.

Headers alone (id, URL, payload length and SHA-1) are shuffled by payload digest, those of digests with
very many records stay where they are. Of the responses that share a digest the one of the smallest id
stays a response; the others, and revisit records of that digest, become revisits that refer to it. These
verdicts come back to the rows by digest and id, so that no task gets all copies of a payload: by a
broadcast if they are few, else rows move once, as evenly as their ids. Archives are then written anew: a
record per row with fresh headers, revisits without a payload.

A record ends in two line ends, which are the separator of Spark's text sink; so the
archives are gzip files written by Spark itself to any store it knows. They are read as whole
files, whose size ``records_per_file`` bounds, one record at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.llm.common import BROADCAST_ROWS, hot_keys, sized, stored

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_URN = "urn:specweave:record:"
_EOL = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary, intact boolean"


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: each five bytes of the hash are eight digits."""
    hexed = F.sha1(payload)
    digits = []
    for five in range(4):
        value = F.conv(F.substring(hexed, five * 10 + 1, 10), 16, 10).cast("long")
        digits += [F.substring(F.lit(_BASE32), (F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for shift in range(35, -1, -5)]
    return F.concat(*digits)


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """headers (``id``, ``uri``, ``payload_digest``, ``payload_bytes`` and optionally
    ``record_type`` and ``refers_to``) with the resolved ``record_type``, ``refers_to`` and
    ``refers_to_uri``.

    Payloads below least_bytes stay responses. Rows that repeat the smallest id all stay
    responses. A null id never is the smallest, and a digest of null ids only has no
    revisits. A revisit without any response of its digest keeps what it refers to.
    """
    if "record_type" not in headers.columns:
        headers = headers.withColumn("record_type", F.lit("response"))
    if "refers_to" not in headers.columns:
        headers = headers.withColumn("refers_to", F.lit(None).cast(headers.schema["id"].dataType))
    first = headers.filter((F.col("record_type") == "response") & (F.col("payload_bytes") >= least_bytes)).groupBy("payload_digest").agg(F.min("id").alias("first"), F.min_by("uri", "id").alias("first_uri"), F.count("*").alias("n"))
    revisited = headers.filter("record_type = 'revisit'").select(F.col("payload_digest").alias("revisited")).distinct()
    first = first.join(revisited, first["payload_digest"] == revisited["revisited"], "left").filter("first is not null and (n > 1 or revisited is not null)")
    first = stored(first.select(F.col("payload_digest").alias("__digest"), F.col("first").alias("__first"), F.col("first_uri").alias("__uri"), "n"), "first")
    n_first, hot = first.count(), hot_keys(first, "__digest", headers.count())
    first, same = first.drop("n"), F.col("payload_digest") == F.col("__digest")
    if n_first > BROADCAST_ROWS and hot:
        is_hot = F.coalesce(F.col("payload_digest").isin(hot), F.lit(False))
        joined = headers.filter(is_hot).join(F.broadcast(first.filter(F.col("__digest").isin(hot))), same, "left").unionByName(headers.filter(~is_hot).join(first.filter(~F.col("__digest").isin(hot)), same, "left"))
    else:
        joined = headers.join(sized(first, n_first), same, "left")
    other = F.col("__first").isNotNull() & (F.col("payload_bytes") >= least_bytes) & ~((F.col("record_type") == "response") & F.col("id").eqNullSafe(F.col("__first")))
    return joined.select(
        *[F.col(f"`{c}`") for c in headers.columns if c not in ("record_type", "refers_to")],
        F.when(other, "revisit").otherwise(F.col("record_type")).alias("record_type"),
        F.when(other, F.col("__first")).otherwise(F.col("refers_to")).alias("refers_to"),
        F.when(other, F.col("__uri")).alias("refers_to_uri"),
    )


def record(date: str) -> Column:
    """The text of a record without its end, from the columns of `resolve` and ``payload``."""

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\r\n]", ""), F.lit(_EOL)), F.lit(""))

    revisit = F.col("record_type") == "revisit"
    urn = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    block = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_EOL * 2), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{_EOL}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn("id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", urn("refers_to")), line("WARC-Refers-To-Target-URI", F.col("refers_to_uri")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
    )
    return F.concat(head, line("Content-Length", F.octet_length(block).cast("string")), F.lit(_EOL), block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", records_per_file: int = 1000) -> None:
    """Write a record per row of pages, deduplicated, to gzip archives in path.

    A null payload is empty, a null URL gives no target; payloads of any length are written whole. Rows that repeat an id and
    a payload have the same verdict. Other columns are not read. An empty table gives an archive without
    records. Archives are read one by one, a record at a time: where payloads are very long, records_per_file
    should be less."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), digest(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"), payload.alias("payload"))
    headers = stored(rows.drop("payload"), "headers")
    changed = resolve(headers, least_bytes).filter("record_type = 'revisit'").select(F.col("id").alias("__id"), F.col("payload_digest").alias("__of"), "record_type", "refers_to", "refers_to_uri").distinct()
    changed = stored(changed, "revisits")
    known = rows.join(sized(changed, changed.count()), F.col("id").eqNullSafe(F.col("__id")) & (F.col("payload_digest") == F.col("__of")), "left")
    known = known.withColumn("record_type", F.coalesce("record_type", F.lit("response")))
    known.select(record(date).alias("value")).write.option("lineSep", _EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_archive(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """The records of an uncompressed archive, one at a time, as rows of RECORDS."""
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.lower()] = value.strip()
        length = int(head["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("an archive ends within a record")
        http, _, payload = block.partition(b"\r\n\r\n")
        kind = head["warc-type"]
        size = next((int(h.split(b":", 1)[1]) for h in http.split(b"\r\n") if h.lower().startswith(b"content-length:")), len(payload))
        name = lambda key: head.get(key, "").removeprefix(f"<{_URN}").removesuffix(">") or None
        said = head.get("warc-payload-digest", "").removeprefix("sha1:")
        intact = None if kind == "revisit" else len(payload) == size and said == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        yield name("warc-record-id"), kind, head.get("warc-target-uri"), said, size, name("warc-refers-to"), None if kind == "revisit" else payload, intact


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives in path, with the columns RECORDS (payload null unless
    with_payload, and for revisits). payload_bytes is that of the full payload; intact tells whether a
    response's payload has the length and digest that its headers state."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                held, size = [], 0
                for row in parse_archive(gzip.GzipFile(fileobj=io.BytesIO(content))):
                    held.append(row if with_payload else (*row[:6], None, row[7]))
                    size += len(row[6] or b"") if with_payload else 0
                    if size > 1 << 23 or len(held) >= 5000:
                        yield pd.DataFrame(held, columns=names)
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, RECORDS)
