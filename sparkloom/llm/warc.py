"""WARC archives as a chunked record table.

A payload is cut into rows (record, chunk number, bytes) where it is read, before it is shuffled, joined or given to
Python. Digests are carried from chunk to chunk, chunks are written as segments of a WARC record (`continuation`
records after the first), and reading gives chunk rows again, each with the digest of its payload so far. Python holds
one chunk.

Spark's text writer and reader do the input and output, so that archives can be in any store Spark reaches and a lost
task is simply run again. Files are gzip-compressed, hence read in one piece and in order, and a payload's segments
stay in one file. The reader takes lines and counts bytes by Content-Length, so a payload may hold the start of a
record, and an oversized record from elsewhere is read in chunks as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import broadcast_if_small, saved, shared_path

CHUNK = 64 * 1024
END = "\r\n\r\n"


def chunk_rows(records: DataFrame, id_col: str, payload: Column, chunk_bytes: int = CHUNK, *more: str) -> DataFrame:
    """(id_col, *more, n_bytes, chunk_no, data): every record has at least one, perhaps empty, chunk. Null payloads are empty.

    The chunk is cut in the same generated code that numbers it, from the record where it was read; a row has no more than its chunk.
    """
    data = F.coalesce(payload.cast("binary"), F.lit(b""))
    rows = records.select(id_col, *more, data.alias("__all"), F.octet_length(data).alias("n_bytes"))
    last = F.greatest(F.ceil(F.col("n_bytes") / chunk_bytes).cast("int") - 1, F.lit(0))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return rows.select(id_col, *more, "n_bytes", "chunk_no", F.substr("__all", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data"))


def digests(chunks: DataFrame, *keys: str) -> DataFrame:
    """(*keys, n_bytes, digest) of each record, from its chunks in order."""
    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, left = None, 0
        for batch in batches:
            done = []
            for *key, total, no, data in zip(*(batch[c] for c in keys), batch["n_bytes"], batch["chunk_no"], batch["data"], strict=True):
                if no == 0:
                    state, left = hashlib.sha1(), total
                state.update(data)
                left -= len(data)
                if left <= 0:
                    done.append((*key, total, state.hexdigest()))
            yield pd.DataFrame(done, columns=[*keys, "n_bytes", "digest"])

    return chunks.select(*keys, "n_bytes", "chunk_no", "data").mapInPandas(run, f"{kinds}, n_bytes long, digest string")


def decide(records: DataFrame, id_col: str, min_bytes: int = 1000) -> DataFrame:
    """records (id_col, n_bytes, digest, ...) with refers_to: of those with equal payloads of min_bytes or more, all but the largest identifier refer to it."""
    same = records.filter(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes").agg(F.max(id_col).alias("__first"), F.count(F.lit(1)).alias("__n"))
    same = saved(same.filter("__n > 1").select("digest", "n_bytes", "__first"), "same-payload")
    out = records.join(broadcast_if_small(same), ["digest", "n_bytes"], "left")
    return out.select(*records.columns, F.when(F.col(id_col) != F.col("__first"), F.col("__first")).alias("refers_to"))


def _head(fields: list[tuple[str, object]], size: int) -> bytes:
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {size}", "", ""]
    return "\r\n".join(lines).encode()


def write(records: DataFrame, path: str, id_col: str, url_col: str, payload_col: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 1000, chunk_bytes: int = CHUNK) -> None:
    """Archive records under path. Identifiers are unique integers; null urls and payloads are empty.
    Rows without an identifier can't be named in an archive and have no record. Other columns are not looked at.

    Of records with equal payloads of at least min_bytes bytes the one with the largest identifier is a response, the
    others revisit it; smaller ones are responses. Rows that repeat an identifier have a record each, under one name and
    each by its own payload. Payloads are written whole, however long. An empty table gives an archive without records.
    """
    records = records.filter(F.col(id_col).isNotNull())
    rows = records.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.xxhash64(payload_col).alias("hash"),
        F.monotonically_increasing_id().alias("row"), F.col(payload_col).alias("payload"),
    )
    chunks = chunk_rows(rows, "id", F.col("payload"), chunk_bytes, "url", "hash", "row")
    light = saved(digests(chunks, "id", "hash").distinct(), "digests")
    plan = saved(decide(light, "id", min_bytes).select("id", "hash", "digest", "refers_to"), "plan")
    small = broadcast_if_small(plan)
    if small is plan:  # chunks are shuffled; a record's stay together, as a dealing that is asked for is not split
        chunks = chunks.repartition("id", "hash").join(plan, ["id", "hash"]).sortWithinPartitions("id", "hash", "row", "chunk_no")
    else:
        chunks = chunks.join(small, ["id", "hash"])
    chunks = chunks.filter("refers_to is null or chunk_no = 0").withColumn("data", F.when(F.col("refers_to").isNull(), F.col("data")))
    columns = ["id", "url", "digest", "refers_to", "n_bytes", "chunk_no", "data"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = left = 0
        for batch in batches:
            out = []
            for key, url, digest, to, total, no, data in zip(*(batch[c] for c in columns), strict=True):
                name = f"<urn:sparkloom:record:{key}>"
                url = " ".join(str(url).split("\r\n")).replace("\n", " ").replace("\r", " ")
                common = [("WARC-Record-ID", name), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Payload-Length", total)]
                if not pd.isna(to):
                    fields = [("WARC-Type", "revisit"), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:sparkloom:record:{int(to)}>")]
                    out.append(_head(fields, 0))
                    continue
                if no == 0:
                    number, left = 0, total
                left -= len(data)
                number += 1
                part, ends = bytes(data), left <= 0
                if number == 1:
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {total}\r\n\r\n".encode()
                    fields = [("WARC-Type", "response"), *common, ("Content-Type", "application/http;msgtype=response"), ("WARC-Segment-Number", None if ends else 1)]
                    out.append(_head(fields, len(http) + len(part)) + http + part)
                else:
                    fields = [
                        ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:sparkloom:record:{key}:{number}>"), ("WARC-Target-URI", url), ("WARC-Date", date),
                        ("WARC-Segment-Number", number), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Total-Length", total + len(http) if ends else None),
                    ]
                    out.append(_head(fields, len(part)) + part)
            yield pd.DataFrame({"value": out}, columns=["value"], dtype=object)

    lines = chunks.select(*columns).mapInPandas(run, "value binary")
    lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


READ = "record_id string, url string, record_type string, refers_to string, payload_length long, payload_digest string, chunk_no int, last boolean, n_bytes long, sha1 string, data binary"


@dataclass
class _Reader:
    """Lines of one archive in, rows of READ out."""

    with_data: bool
    rows: list[tuple] = field(default_factory=list)
    state: str = "between"  # records; then head, http (the head inside a response), body
    fields: dict[str, str] = field(default_factory=dict)
    left: int = 0
    first: dict[str, str] = field(default_factory=dict)
    sha1: object = None
    seen: int = 0
    no: int = -1
    held: list[bytes] = field(default_factory=list)
    held_bytes: int = 0

    def line(self, line: bytes) -> None:
        if self.state == "body":
            self._take(line)
        elif self.state == "between":
            if line.startswith(b"WARC/"):
                self.state, self.fields = "head", {}
        elif self.state == "head":
            text = line.rstrip(b"\r")
            if text:
                k, colon, v = text.partition(b":")
                if colon:
                    self.fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
            else:
                self._open()
        else:
            self.left -= len(line) + 1
            if self.left <= 0 or line in (b"\r", b""):
                self.state = "body"
                self._take(None)

    def _open(self) -> None:
        f = self.fields
        if "warc-type" not in f or not f.get("content-length", "").isdigit():
            self.state = "between"
            return
        self.left = int(f["content-length"])
        if f["warc-type"] == "continuation" and f.get("warc-segment-origin-id") != self.first.get("warc-record-id"):
            self.first = {}  # of a record that isn't here
        elif f["warc-type"] != "continuation":
            self.first, self.sha1, self.seen, self.no = f, hashlib.sha1(), 0, -1
        http = f["warc-type"] != "continuation" and f.get("content-type", "").startswith("application/http")
        self.state = "http" if http and self.left else "body"
        if self.state == "body":
            self._take(None)

    def _take(self, line: bytes | None) -> None:
        if line is not None:
            part = (line + b"\n")[: self.left] if self.left <= len(line) else line + b"\n"
            self.left -= len(part)
            self.held.append(part)
            self.held_bytes += len(part)
        if self.left <= 0:
            self._give(True)
            self.state = "between"
        elif self.held_bytes >= CHUNK:
            self._give(False)

    def _give(self, whole: bool) -> None:
        """A chunk row from what is held; whole: it ends its WARC record."""
        data, self.held, self.held_bytes = b"".join(self.held), [], 0
        f = self.first
        if not f:
            return
        self.no += 1
        self.sha1.update(data)
        self.seen += len(data)
        last = whole and ("warc-segment-total-length" in self.fields if self.fields is not f else "warc-segment-number" not in f)
        self.rows.append((
            f.get("warc-record-id"), f.get("warc-target-uri"), f["warc-type"], f.get("warc-refers-to"),
            int(f["payload-length"]) if f.get("payload-length", "").isdigit() else None, f.get("warc-payload-digest", "").rpartition(":")[2] or None,
            self.no, last, self.seen, self.sha1.hexdigest(), data if self.with_data else None,
        ))


def read_chunks(spark, path: str, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives under path.

    One row for each chunk: the record's headers, chunk_no, n_bytes and sha1 of the payload up to and with this chunk,
    whether it is the last, and the bytes (null unless with_data). HTTP heads are not part of payloads. What is between
    records is skipped, and so are continuations of records that are not before them in their file. A record that
    breaks off at its file's end has no last chunk. A chunk has CHUNK bytes and the rest of a line; lines are held whole.
    Archives are gzip files, or plain ones of one input split: Spark would cut larger ones, which is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, reader = None, _Reader(with_data)
        for batch in batches:
            for value, of in zip(batch["value"], batch["file"], strict=True):
                if of != file:
                    file, reader = of, _Reader(with_data, reader.rows)
                reader.line(bytes(value))
            yield pd.DataFrame(reader.rows, columns=[c.split()[0] for c in READ.split(", ")], dtype=object)
            reader.rows = []

    whole = F.raise_error(F.lit("a plain archive is larger than an input split: compress it or raise spark.sql.files.maxPartitionBytes"))
    of = F.when(F.input_file_block_start() > 0, whole.cast("long")).otherwise(F.xxhash64(F.input_file_name()))
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary").alias("value"), of.alias("file")).mapInPandas(run, READ)


def archive(records: DataFrame, id_col: str, url_col: str, payload_col: str, **options) -> str:
    """Write records to a new archive folder among the shared ones; returns its path."""
    path = shared_path(records.sparkSession, "warc")
    write(records, path, id_col, url_col, payload_col, **options)
    return path
