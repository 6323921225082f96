"""Token ids as length-delimited binary records with a separate offset index.

A record is framed as

    length   8 bytes, little-endian
    check    4 bytes, masked CRC-32 of the length bytes
    payload  ``length`` bytes: doc_id (8), token count (4), ids (4 each), little-endian
    check    4 bytes, masked CRC-32 of the payload

The mask turns a checksum by 15 bits and adds a constant, so that a checksum
stored inside checksummed data does not weaken it.  CRC-32 is the polynomial of
zlib, which both Python and the JVM compute natively.

Each task writes files of its own in the shared folder, under a name that holds
its partition and a fresh identifier, and yields index rows only for files that
it has closed.  A retried or speculative task writes other files; the index is
built from the attempts that Spark accepted, so it never refers to a half
written file.  The index is a Parquet table (doc_id, file, start, size,
n_tokens): a reader shuffles or shards the index and seeks.

Defined cases: a null or empty text is a record of no tokens; a null ``doc_id``
is stored as -1 and is null in the index; a text of any length is one record;
repeated rows are stored each on its own, and so are rows that share an id;
records keep the order of their rows within a file; other columns, whatever
their names, are not read; an empty table gives an empty index; an id that isn't
a number fails the cast to bigint.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame

from keylattice.llm.bpe import DEFAULT_VOCABULARY, ChunkEncoder
from keylattice.llm.shared import new_path
from keylattice.llm.textkit import slices

MASK = 0xA282EAD8
#: A new file is begun once one has this many bytes.
FILE_BYTES = 256 << 20
SCHEMA = "doc_id bigint, file string, start bigint, size bigint, n_tokens int, checksum bigint"


def masked(data: bytes | memoryview) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> tuple[bytes, int]:
    head = struct.pack("<Q", len(payload))
    check = masked(payload)
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", check))), check


def write_records(docs: DataFrame, path: str | None = None, vocabulary: str = DEFAULT_VOCABULARY, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every document as one record below ``path`` and return the offset index."""
    spark = docs.sparkSession
    path = path or new_path(spark, "records")

    def run(batches):
        from pyspark import TaskContext

        where, folder = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        folder += "/data"
        where.create_dir(folder, recursive=True)
        encode = ChunkEncoder(vocabulary)
        part, out, at, rows = TaskContext.get().partitionId(), None, 0, []
        name = ""

        def close():
            nonlocal out, rows
            out.close()
            ids, starts, sizes, counts, checks = zip(*rows)
            full = [name] * len(rows)
            rows, out = [], None
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(full), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int32()), pa.array(checks, pa.int64())],
                names=["doc_id", "file", "start", "size", "n_tokens", "checksum"],
            )

        for b in slices(batches):
            ids, first = encode(b.column("text"))
            ids = ids.astype("<i4")
            for k, doc in enumerate(b.column("doc_id").to_pylist()):
                if out is None:
                    name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.rec"
                    out, at = where.open_output_stream(f"{folder}/{name}"), 0
                own = ids[first[k] : first[k + 1]]
                record, check = frame(struct.pack("<qI", -1 if doc is None else doc, len(own)) + own.tobytes())
                out.write(record)
                rows.append((doc, at, len(record), len(own), check))
                at += len(record)
                if at >= file_bytes:
                    yield close()
        if out is not None:
            yield close()

    index = f"{path}/index"
    docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA).write.parquet(index)
    found = spark.read.schema(SCHEMA).parquet(index)
    found.records_path = path
    return found


def read_record(data: bytes) -> tuple[int, np.ndarray]:
    """Check a framed record and return its document and ids."""
    (n,) = struct.unpack_from("<Q", data)
    if struct.unpack_from("<I", data, 8)[0] != masked(data[:8]):
        raise ValueError("the length of a record is damaged")
    payload = data[12 : 12 + n]
    if len(payload) != n or struct.unpack_from("<I", data, 12 + n)[0] != masked(payload):
        raise ValueError("a record is damaged")
    doc, count = struct.unpack_from("<qI", payload)
    return doc, np.frombuffer(payload, "<i4", count, 12)


def read_records(rows: Iterator, path: str) -> Iterator[tuple[int, np.ndarray]]:
    """The records of these index rows, in their order."""
    where, folder = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    opened = {}
    for r in rows:
        if r["file"] not in opened:
            opened[r["file"]] = where.open_input_file(f"{folder}/data/{r['file']}")
        f = opened[r["file"]]
        f.seek(r["start"])
        yield read_record(f.read(r["size"]))
