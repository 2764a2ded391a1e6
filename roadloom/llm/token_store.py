"""Token ids in binary files, in ascending doc_id order, and their reader.

A file is a run of blocks; a block holds whole documents, about ``BLOCK_IDS`` ids
(a longer document is a block of its own):

    magic "RLS8" | u32 documents, ids, words, escapes
    i64 doc_id x documents | u8 doc_id-is-null x documents | u32 ids x documents
    u32 place x escapes | u64 word x words            (Simple-8b, little-endian)

The texts are dealt by ranges of doc_id, sorted and written by one task a range,
under a name of that attempt's own; the task then reports its segments (runs of
blocks with their offset, bytes, documents and ids). Only reported segments are
read, so retried or speculative attempts leave nothing but an orphan file. The
report is the catalogue of the store: ids before a segment are sums over it.

Null texts are empty; null doc_ids come first; rows that repeat a doc_id are
ordered by a hash of their text; an empty table gives an empty store. Extra
columns are not read.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm import simple8b
from roadloom.llm.common import exact_id, id_list, nullable, shared_folder, stored
from roadloom.llm.tokens import PieceEncoder

MAGIC = b"RLS8"
BLOCK_IDS = 32_768
SEGMENT_IDS = 1_000_000
#: Characters encoded at a time (a longer text alone).
ENCODED_CHARACTERS = 4_000_000
#: Pieces a worker remembers here, some 200 bytes each.
KEPT_PIECES = 800_000
CATALOGUE = "file_no int, segment int, path string, offset long, bytes long, documents long, ids long"


def open_store(uri: str):
    """The file system of a URI or path, and the path in it; Hadoop's ways of writing them are understood."""
    import re

    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]://", "s3://", uri))
    return fs.FileSystem.from_uri(uri if re.match(r"^\w+://", uri) else f"file://{uri}")


def parallelism(pieces: DataFrame) -> int:
    """Tasks for reading ``pieces`` of files: rows so few would else be gathered in one task."""
    return max(1, min(pieces.count(), 4 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def block_bytes(doc_ids, ids: list[bytes], widths=None) -> bytes:
    import numpy as np

    values = np.frombuffer(b"".join(ids), "<u4")
    words, escapes = simple8b.encode(values, widths)
    null = np.array([i is None for i in doc_ids], np.uint8)
    return b"".join(
        (
            MAGIC,
            struct.pack("<4I", len(ids), len(values), len(words), len(escapes)),
            np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes(),
            null.tobytes(),
            np.array([len(x) // 4 for x in ids], "<u4").tobytes(),
            escapes.astype("<u4").tobytes(),
            words.astype("<u8").tobytes(),
        )
    )


def read_blocks(data: bytes):
    """(doc_ids with None for null, ids of each, all ids as uint32) of each block in ``data``."""
    import numpy as np

    at = 0

    def column(kind, n):
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    while at < len(data):
        if data[at : at + 4] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        n, total, words, escapes = struct.unpack_from("<4I", data, at + 4)
        at += 20
        doc_ids, null, lengths = column("<i8", n), column("u1", n), column("<u4", n)
        places = column("<u4", escapes)
        values = simple8b.decode(column("<u8", words), places, total)
        yield [None if x else i for i, x in zip(doc_ids.tolist(), null.tolist())], lengths, values.astype("<u4")


def write_store(docs: DataFrame, tokenizer_json: str, end_id: int, folder: str) -> DataFrame:
    """Encode and write ``docs(doc_id, text)`` below ``folder``; the catalogue."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one file of a few MB

    def run(batches):
        import uuid

        import pandas as pd
        from pyspark import TaskContext

        encoder, end, widths = PieceEncoder(shared.value, KEPT_PIECES), end_id.to_bytes(4, "little"), simple8b.width_table()
        file_no = TaskContext.get().partitionId()
        uri = f"{folder}/part-{file_no:06d}-{uuid.uuid4().hex}.s8b"
        system, path = open_store(uri)
        out, rows, segment = None, [], [0, 0, 0, 0]  # offset, bytes, documents, ids
        doc_ids, ids, held = [], [], 0

        def close_segment():
            nonlocal segment
            if segment[1]:
                rows.append((file_no, len(rows), uri, *segment))
                segment = [segment[0] + segment[1], 0, 0, 0]

        def close_block():
            nonlocal out, doc_ids, ids, held
            if doc_ids:
                if out is None:
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                data = block_bytes(doc_ids, ids, widths)
                out.write(data)
                segment[1:] = segment[1] + len(data), segment[2] + len(ids), segment[3] + held
                doc_ids, ids, held = [], [], 0
                if segment[3] >= SEGMENT_IDS:
                    close_segment()

        for batch in batches:
            sizes = batch["text"].str.len().fillna(0).to_numpy("int64").cumsum()
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(sizes.searchsorted((sizes[lo - 1] if lo else 0) + ENCODED_CHARACTERS, side="right")))
                part, lo = batch.iloc[lo:hi], hi
                for i, x in zip(id_list(part), encoder.encode(part["text"])):
                    doc_ids.append(i)
                    ids.append(x + end)
                    held += len(x) // 4 + 1
                    if held >= BLOCK_IDS:
                        close_block()
        close_block()
        close_segment()
        if out is not None:
            out.close()
        yield pd.DataFrame(rows, columns=["file_no", "segment", "path", "offset", "bytes", "documents", "ids"])

    rows = docs.select(*exact_id(), "text")
    order = [F.col("no_doc_id").desc(), F.col("doc_id"), F.xxhash64("text")]  # null ids first
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ordered.mapInPandas(run, CATALOGUE), "token-catalogue")


def read_store(catalogue: DataFrame, digest: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, or its ids in place of the digest."""
    files = catalogue.groupBy("file_no").agg(F.sum("ids").alias("n"))  # one row a file
    before_file = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file_no", F.coalesce(F.sum("n").over(before_file), F.lit(0)).alias("file_start"))
    before_segment = Window.partitionBy("file_no").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = catalogue.withColumn("own", F.coalesce(F.sum("ids").over(before_segment), F.lit(0))).join(files, "file_no")
    segments = segments.select("path", "offset", "bytes", (F.col("file_start") + F.col("own")).alias("start"))
    segments = segments.repartition(parallelism(catalogue), "path", "offset")

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for path, offset, size, start in batch[["path", "offset", "bytes", "start"]].itertuples(index=False):
                system, path = open_store(path)  # a URI
                with system.open_input_file(path) as f:
                    f.seek(int(offset))
                    data = f.read(int(size))
                parts = {"doc_id": [], "start": [], "n_tokens": [], "last": []}
                for doc_ids, lengths, values in read_blocks(data):
                    ends = np.cumsum(lengths.astype(np.int64))
                    begins = ends - lengths
                    own = memoryview(values.tobytes())
                    cuts = [own[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())]
                    parts["doc_id"] += doc_ids
                    parts["start"].append(start + begins)
                    parts["n_tokens"].append(lengths.astype(np.int64))
                    parts["last"] += [zlib.crc32(c) for c in cuts] if digest else [np.frombuffer(c, "<u4").astype(np.int64) for c in cuts]
                    start += int(ends[-1]) if len(ends) else 0
                if parts["doc_id"]:
                    yield pd.DataFrame({"doc_id": nullable(parts["doc_id"]), "start": np.concatenate(parts["start"]), "n_tokens": np.concatenate(parts["n_tokens"]), "last": parts["last"]})

    out = segments.mapInPandas(run, f"doc_id long, start long, n_tokens long, last {'long' if digest else 'array<long>'}")
    return out.withColumnRenamed("last", "ids_crc32" if digest else "ids")


def stored_tokens(docs: DataFrame, tokenizer_json: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write ``docs(doc_id, text)`` to a store and read back (doc_id, start, n_tokens, ids_crc32)."""
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    return read_store(write_store(docs, tokenizer_json, end_id, folder))
