"""WARC archives of pages, and a reader that salvages what is left of damaged ones.

Each record is a gzip member of its own. A page whose payload another page also has is a revisit record that names that page;
only one of equal payloads is stored. The reader checks every member and every record's lengths and digests; where a check
fails it looks for the next place that reads as a record, goes on there, and reports the bytes between as a gap.
"""
from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import committed, open_folder, partitions, stored

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
#: Bytes read from a file at once.
READ = 1 << 20
HEAD = 1 << 20
#: A record cannot be larger than what a binary column holds.
MOST = (1 << 31) - 1
_LINE = re.compile(rb"WARC/\d\.\d\r\n")

RECORDS = (
    "path string, at bigint, page_id bigint, record_type string, url string, payload_bytes bigint, payload_digest string, "
    "refers_to bigint, payload binary")
GAPS = "path string, at bigint, n_bytes bigint, reason string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _one_line(url: str | None) -> str:
    """A url as a header value: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: an HTTP response, or a revisit that keeps its header and refers to the page with the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Target-URI", _one_line(url)),
        ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    if revisit:
        head += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n"
    return lines + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def with_originals(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, refers_to, revisit): of equal payloads of at least `least` bytes the largest page_id is the original.

    Null payloads are empty. Rows that repeat the original's id and payload are originals, too; null ids come last, so a payload
    that only pages without id have has no revisits. Only ids and digests are grouped; the payloads move once, by page.
    """
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    size = F.octet_length("html")
    keys = rows.select("page_id", size.alias("size"), F.sha1(F.encode("html", "UTF-8")).alias("sha1"))
    shared = keys.where(F.col("size") >= least).groupBy(F.col("sha1").alias("_sha1"), F.col("size").alias("_size")).agg(
        F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and refers_to is not null")
    later = keys.join(shared, (F.col("sha1") == F.col("_sha1")) & (F.col("size") == F.col("_size")))
    later = later.where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    # a page id that repeats with different payloads needs the digest, too
    later = later.select(F.col("page_id").alias("_id"), F.col("sha1").alias("_d"), "refers_to").distinct()
    joined = rows.withColumn("_sha1", F.sha1(F.encode("html", "UTF-8"))).join(
        later, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_sha1") == F.col("_d")), "left")
    return joined.select("page_id", "url", "html", "refers_to", F.col("_d").isNotNull().alias("revisit"))


def write_archives(pages: DataFrame, folder: str, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes one archive per task into `folder`; returns (path, n_records, n_bytes). A task that runs again replaces its own file."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, n, size = f"pages-{TaskContext.get().partitionId():06d}.warc.gz", 0, 0
        with committed(folder, name) as out:
            for batch in batches:
                for page, link, text, refers_to, revisit in batch[["page_id", "url", "html", "refers_to", "revisit"]].itertuples(index=False):
                    payload = text.encode()
                    page, refers_to = (None if pd.isna(x) else int(x) for x in (page, refers_to))
                    raw = _member(record(page, link, payload, digest(payload), refers_to, revisit))
                    out.write(raw)
                    n, size = n + 1, size + len(raw)
        yield pd.DataFrame({"path": [name], "n_records": [n], "n_bytes": [size]})

    rows = with_originals(pages, least, page_id, url, html).withColumns(
        {"page_id": F.col("page_id").cast("decimal(20,0)"), "refers_to": F.col("refers_to").cast("decimal(20,0)")})
    # the join has dealt the pages out already
    return stored(rows.mapInPandas(write, "path string, n_records bigint, n_bytes bigint"), "archives")


@dataclass
class _File:
    """Forward reads of an open file, with a window of bytes that were read and not yet dropped."""

    source: object
    window: bytearray = field(default_factory=bytearray)
    at: int = 0
    ended: bool = False

    def more(self) -> bool:
        part = b"" if self.ended else self.source.read(READ)
        self.ended = not part
        self.window += part
        return bool(part)

    def drop(self, n: int) -> None:
        del self.window[:n]
        self.at += n


def _inflated(file: _File) -> tuple[bytes, int] | None:
    """The gzip member at the window's start and its length, or None if it is not whole and sound."""
    unpack, out, fed = zlib.decompressobj(31), bytearray(), 0
    while True:
        part = bytes(file.window[fed : fed + READ])
        fed += len(part)
        if not part and not file.more():
            return None
        try:
            out += unpack.decompress(part)
        except zlib.error:
            return None
        if unpack.eof:
            return bytes(out), fed - len(unpack.unused_data)


def parse(raw: bytes) -> dict | None:
    """The record in `raw` and its length, or None if its head, lengths or digests do not agree."""
    found, split = _LINE.match(raw), raw.find(b"\r\n\r\n")
    if not found or split < 0:
        return None
    head = {}
    for line in raw[found.end() : split].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not head.get("content-length", "").isdigit():
        return None
    begin, size = split + 4, int(head["content-length"])
    block = raw[begin : begin + size]
    if len(block) < size or raw[begin + size : begin + size + 4] != b"\r\n\r\n":
        return None
    if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{digest(block)}":
        return None
    kind, http = head.get("warc-type"), block.find(b"\r\n\r\n") + 4
    length = re.search(rb"(?i)\r\nContent-Length: *(\d+)\r\n", block[:http])
    payload = block[http:] if http >= 4 else block
    claimed = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    n = len(payload)
    if kind == "revisit":
        payload, n = None, int(length[1]) if length else None
    elif claimed not in (None, digest(payload)) or (length and int(length[1]) != n):
        return None
    return {
        "page_id": _page(head.get("warc-record-id")), "record_type": kind, "url": head.get("warc-target-uri"), "payload_bytes": n,
        "payload_digest": claimed or digest(payload or b""), "refers_to": _page(head.get("warc-refers-to")), "payload": payload,
        "n": begin + size + 4}


def _needed(window: bytearray) -> int:
    """Bytes that the record at the window's start claims to have; a head longer than HEAD or a claim over MOST is damage."""
    split = window.find(b"\r\n\r\n")
    if split < 0:
        return len(window) + 1 if len(window) < HEAD else 0
    size = re.search(rb"(?i)\r\nContent-Length: *(\d+)\r\n", window[: split + 2])
    total = split + 8 + (int(size[1]) if size else 0)
    return total if total <= MOST else 0


def salvaged(source) -> Iterator[tuple[str, int, dict | int, str]]:
    """("record", place, record, "") and ("gap", place, bytes, reason) of an open archive, in order.

    Compressed archives go on at the next member that inflates whole to a sound record, plain ones at the next version line with a
    sound record. A whole member that holds more, or whose first record fails, is read like a plain archive; its records and gaps
    have the member's place, and such a gap counts inflated bytes. Bytes are read forward once; what is kept is one record, or the bytes from the next possible start.
    """
    file = _File(source)
    gap, reason = 0, ""
    while file.window or file.more():
        while len(file.window) < 16 and file.more():
            pass
        got, why = None, "no record starts here"
        if file.window.startswith(MAGIC):
            member, why = _inflated(file), "gzip member is damaged or cut off"
            if member:
                got, why = parse(member[0]), "record in a whole gzip member fails its checks"
                if got and got["n"] == len(member[0]):
                    got["n"] = member[1]
                else:
                    got, inside = None, list(salvaged(io.BytesIO(member[0])))
                    if any(kind == "record" for kind, *_ in inside):
                        if gap:
                            yield "gap", file.at - gap, gap, reason
                            gap = 0
                        yield from ((kind, file.at, found, note and f"inside a gzip member: {note}") for kind, _, found, note in inside)
                        file.drop(member[1])
                        continue
        elif _LINE.match(file.window):
            why = "record fails its checks or is cut off"
            while len(file.window) < _needed(file.window) and file.more():
                pass
            got = parse(bytes(file.window[: _needed(file.window)]))
        if got:
            if gap:
                yield "gap", file.at - gap, gap, reason
                gap = 0
            yield "record", file.at, got, ""
            file.drop(got.pop("n"))
            continue
        reason = reason if gap else why
        skip = _next_start(file)
        file.drop(skip)
        gap += skip
    if gap:
        yield "gap", file.at - gap, gap, reason


def _next_start(file: _File) -> int:
    """Bytes up to the next place after this one that looks like a member or a version line."""
    while True:
        member, line = file.window.find(MAGIC, 1), _LINE.search(file.window, 1)
        places = [p for p in (member, line.start() if line else -1) if p > 0]
        if places:
            return min(places)
        if len(file.window) > 2 * READ or not file.more():
            return len(file.window) if file.ended else len(file.window) - 16


def _read(folder: str, listed: DataFrame, what: str, schema: str) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, root = open_folder(folder)
        for batch in batches:
            for path in batch["path"]:
                rows, size = [], 0
                with filesystem.open_input_stream(f"{root}/{path}", compression=None) as source:
                    for kind, at, got, reason in salvaged(source):
                        if kind == what:
                            rows.append({"path": path, "at": at} | (got if kind == "record" else {"n_bytes": got, "reason": reason}))
                            size += len(got.get("payload") or b"") if kind == "record" else 0
                        if len(rows) >= 1000 or size > 8 * READ:
                            yield frame(rows)
                            rows, size = [], 0
                yield frame(rows)

    def frame(rows: list[dict]) -> pd.DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        out = pd.DataFrame([{c: r.get(c) for c in names} for r in rows], columns=names, dtype=object)
        return out.astype({c: "Int64" for c in ("at", "page_id", "payload_bytes", "refers_to", "n_bytes") if c in names})

    # a file is read from its start to its end by one task
    return listed.select("path").repartition(partitions(listed.sparkSession), "path").mapInPandas(read, schema)


def read_archives(spark: SparkSession, folder: str, listed: DataFrame) -> DataFrame:
    """Records of the archives whose `path` below `folder` is listed, with payloads (null for revisits)."""
    return _read(folder, listed, "record", RECORDS)


def read_gaps(spark: SparkSession, folder: str, listed: DataFrame) -> DataFrame:
    """The byte ranges that hold no sound record: the quarantine log."""
    return _read(folder, listed, "gap", GAPS)


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha1(html) as hex from p),
o as (select *, max(page_id) over (partition by hex) as original from d),
b as (select *, list_transform(generate_series(0, 7), lambda g: ('0x' || substr(hex, 5 * g + 1, 5))::integer) as fives from o)
select page_id, payload_bytes,
    array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((fives[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31) + 1, 1)), '') as payload_digest,
    case when page_id = original then 'response' else 'revisit' end as record_type,
    case when page_id = original then null else original end as refers_to
from b
"""
