"""Token-id files: flat unsigned integers plus 64-bit document offsets.

A data set is a folder of shards. Shard ``k`` holds the documents of one range
of doc_id in ascending order, as three flat little-endian files:

* ``.bin``  the ids of its documents one after another (16-bit where the
  vocabulary fits, else 32-bit), each document closed by the end id;
* ``.idx``  n + 1 signed 64-bit offsets into ``.bin``, in ids;
* ``.doc``  n signed 64-bit doc_ids; the smallest 64-bit number stands for null.

The table of shards (name, documents, ids, base) is what ties them together:
a shard's base is the prefix sum of the ids of the shards before it. A task
that is run again writes files of another name; only the names in the table count.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from omiclattice.llm import tokens
from omiclattice.llm.storage import picked, settle, shared_folder

NO_ID = np.iinfo(np.int64).min
SHARDS = "shard int, name string, n_docs long, n_tokens long, width int"


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and write the shards; returns the shard table with bases.

    A null or empty text is a document of the end id alone. Rows with a null
    doc_id come first, rows with the same doc_id in order of a hash of their
    texts. An empty table gives no shards. Other columns are left aside.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        width = 2 if max(enc.size - 1, end_id) < 1 << 16 else 4
        close = np.array([end_id], f"<u{width}").tobytes()
        shard = TaskContext.get().partitionId()
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        lengths, ids = [], []
        with store.open_output_stream(f"{root}/{name}.bin") as out:
            for rows, texts in tokens.runs(batches, text):
                ids += [NO_ID if d is None else d for d in rows.column(doc_id).to_pylist()]
                for found in enc.encode(texts):
                    lengths.append(len(found) // 4 + 1)
                    out.write(np.frombuffer(found, "<u4").astype(f"<u{width}").tobytes() + close)
        if not ids:
            return
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
        for kind, data in (("idx", offsets), ("doc", np.array(ids, "<i8"))):
            with store.open_output_stream(f"{root}/{name}.{kind}") as out:
                out.write(data.tobytes())
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "name": [name], "n_docs": pa.array([len(ids)], pa.int64()),
            "n_tokens": pa.array([int(offsets[-1])], pa.int64()), "width": pa.array([width], pa.int32())})

    # the row's place in the input parts rows that repeat, so that no range is larger than the others
    keys = [F.col(f"`{doc_id}`").asc_nulls_first(), F.xxhash64(F.col(f"`{text}`")), F.col("__place")]
    ordered = picked(docs, doc_id, text).withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    shards = settle(ordered.mapInArrow(write, SHARDS))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def _mapped(store, path: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped into memory where it is a local file, else read."""
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_shards(shards: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of a data set: doc_id, start (ids of all before it), n_tokens, ids_crc32 and, on demand, ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for s in (row for b in batches for row in b.to_pylist()):
            at, stem = s["base"], f"{root}/{s['name']}"
            ids = _mapped(store, f"{stem}.bin", f"<u{s['width']}")
            idx, doc = _mapped(store, f"{stem}.idx", "<i8"), _mapped(store, f"{stem}.doc", "<i8")
            for i in range(0, len(doc), 4096):
                part = idx[i:i + 4097]
                got = [ids[a:b].astype("<u4") for a, b in zip(part[:-1], part[1:])]
                cols = {
                    "doc_id": pa.array(doc[i:i + 4096], pa.int64(), mask=doc[i:i + 4096] == NO_ID),
                    "start": pa.array(part[:-1] + at, pa.int64()),
                    "n_tokens": pa.array(np.diff(part), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in got], pa.int64())}
                if with_ids:
                    cols["ids"] = pa.array([x.astype("i8") for x in got], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return shards.repartition(max(1, shards.count()), "shard").mapInArrow(read, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_shards(write_shards(docs, folder, tokens.tokenizer_path(), end_id=2), folder)
