"""WARC archives: a writer with payload deduplication, and a splittable reader.

Writer: every record is a gzip member of its own. Of records with equal payloads
of at least ``min_bytes`` the one with the largest id is a response; the others
are revisit records without a payload that refer to it. Each task writes one file
under a name of that attempt's own and then reports it; only reported files are
read, so retried attempts leave nothing but an orphan file.

Reader: files are cut into byte ranges, and a task scans its range for the gzip
magic. A candidate is a member only if it decodes to a WARC header and its
checksum holds; anything else is passed over by one byte. A task owns the records
that start inside its range, and reads the last one beyond the range's end. After
a member the next is tried right behind it. A response's digest is computed from
what is read and must equal the recorded one.

Null payloads are empty. A null id is the smallest; with no other id for a payload
its record is a response. Rows that repeat the largest id are responses each. An
empty table gives no files and no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import exact_id, id_list, nullable, shared_folder, stored
from roadloom.llm.token_store import open_store, parallelism

MAGIC = b"\x1f\x8b\x08"
ID = "<urn:roadloom:page:{}>"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to, revisit: bool) -> bytes:
    """One gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {ID.format('null' if page_id is None else page_id)}", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        lines += [f"WARC-Refers-To: {ID.format(refers_to)}", f"WARC-Profile: {REVISIT}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes):
    """(page_id, url, payload_bytes, digest, type, refers_to, payload or None) of a decoded member."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        fields[name.lower()] = value
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda uri: None if uri is None or uri.endswith(":null>") else int(uri.rpartition(":")[2].rstrip(">"))
    recorded = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        return number(fields["warc-record-id"]), fields.get("warc-target-uri"), size, recorded, "revisit", number(fields["warc-refers-to"]), None
    if digest(payload) != recorded:
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return number(fields["warc-record-id"]), fields.get("warc-target-uri"), len(payload), recorded, "response", None, payload


def members(f, size: int, start: int, end: int, step: int = 1 << 20):
    """The decoded members of an open file that start in [start, end)."""
    at, window, base = start, b"", start

    def have(n: int) -> bytes:
        """At least ``n`` bytes from ``at`` on, or all there are."""
        nonlocal window, base
        if base < at:
            window, base = window[at - base :], at
        while len(window) < n and base + len(window) < size:
            f.seek(base + len(window))
            more = f.read(min(max(step, n - len(window)), size - base - len(window)))
            if not more:
                raise EOFError(f"file ends before byte {size}")
            window += more
        return window

    while at < end:
        data = have(step)
        found = data.find(MAGIC)
        if found < 0:
            if base + len(data) >= size:
                return
            at += len(data) - len(MAGIC) + 1
            continue
        at += found
        if at >= end:
            return
        data, out = have(max(step, 4096)), []
        try:
            ok = zlib.decompressobj(31).decompress(data[:4096], 64).startswith(b"WARC/1.")
            unpack = zlib.decompressobj(31)
            if ok:
                out.append(unpack.decompress(data))
            while ok and not unpack.eof:
                used = len(data)
                data = have(2 * used)
                ok = len(data) > used  # or else cut short
                out.append(unpack.decompress(data[used:]))
        except zlib.error:
            ok = False
        if not ok:
            at += 1
            continue
        yield b"".join(out)
        at += len(data) - len(unpack.unused_data)


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)`` below ``folder``; (path, bytes) of the files."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    # Roles are settled on digests alone; the payloads are dealt by page, so a common one is no task's own.
    newest = rows.groupBy("sha").agg(F.max("page_id").alias("newest"))
    roles = rows.select("page_id", "sha", F.octet_length("html").alias("n")).distinct().join(newest, "sha")
    roles = roles.select(
        F.col("page_id").alias("of"), F.col("sha").alias("what"), "newest",
        F.coalesce((F.col("n") >= min_bytes) & F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest")), F.lit(False)).alias("revisit"),
    )
    roles = rows.join(roles, rows["page_id"].eqNullSafe(roles["of"]) & (rows["sha"] == roles["what"]))

    def run(batches):
        import uuid

        import pandas as pd
        from pyspark import TaskContext

        uri = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        system, path = open_store(uri)
        out, size = None, 0
        for batch in batches:
            for i, url, html, to, revisit in zip(id_list(batch, "page_id"), batch["url"], batch["html"], id_list(batch, "newest"), batch["revisit"].tolist()):
                if out is None:
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)  # the members are compressed already
                data = record(i, url, html.encode("utf-8", "surrogatepass"), to, revisit)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [uri], "bytes": [size]})

    return stored(roles.select(*exact_id("page_id"), "url", "html", *exact_id("newest"), "revisit").mapInPandas(run, "path string, bytes long"), "warc-files")


def read_archive(files: DataFrame, split_bytes: int = 4 << 20, payloads: bool = False) -> DataFrame:
    """The records of ``files(path, bytes)``; with ``payloads`` also the payload (null for revisits)."""
    splits = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    splits = splits.repartition(parallelism(splits), "path", "start")
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches):
        import pandas as pd

        def frame(rows):
            out = pd.DataFrame(rows, columns=[*names, "payload"], dtype=object)
            out = out.assign(page_id=nullable([r[0] for r in rows]), payload_bytes=out["payload_bytes"].astype("int64"), refers_to=nullable([r[5] for r in rows]))
            return out if payloads else out[names]

        for batch in batches:
            for uri, size, start in batch[["path", "bytes", "start"]].itertuples(index=False):
                system, path = open_store(uri)
                rows, held = [], 0
                with system.open_input_file(path) as f:
                    for member in members(f, int(size), int(start), min(int(start) + split_bytes, int(size))):
                        rows.append(parse(member))
                        held += len(member)
                        if held > 8 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                yield frame(rows)

    return splits.mapInPandas(run, RECORDS + (", payload binary" if payloads else ""))


def archived(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to an archive and read its records back."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    return read_archive(write_archive(pages, folder, min_bytes))
