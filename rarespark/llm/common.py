"""What the operators share: inputs, the shared folder, and byte-level views of Arrow text.

Executors are stateless: everything that must outlive a task is either a Spark shuffle or a file
in the folder that ``spark.checkpoint.dir`` names, written under its final name only when whole,
so a task that runs twice (or on two executors) leaves the same file.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(mod: int, col: str = "doc_id"):
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local one is made for a
    master that runs in this process; beside other masters this is an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not (sc.master or "").startswith("local") or (sc.master or "").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rarespark-shared-")
        atexit.register(shutil.rmtree, root[7:], True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def new_dir(spark: SparkSession, name: str) -> str:
    """A new, empty folder below the shared one; removed when the driver's Python ends."""
    uri = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    filesystem, path = resolve(uri)
    filesystem.create_dir(path, recursive=True)
    atexit.register(remove, uri)
    return uri


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def remove(uri: str) -> None:
    filesystem, path = resolve(uri)
    try:
        filesystem.delete_dir(path)
    except OSError:
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    uri = new_dir(spark, name) + "/t"
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def write_file(uri: str, parts: list[np.ndarray]) -> None:
    """Write whole arrays one after the other; the name appears only when all is there. A second
    run of the same task may find it there, with the same content, where a move can't replace it."""
    filesystem, path = resolve(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with filesystem.open_output_stream(part) as out:
        for x in parts:
            out.write(np.ascontiguousarray(x).view(np.uint8).data)
    try:
        filesystem.move(part, path)
    except OSError:
        if not filesystem.get_file_info(path).is_file:
            raise
        filesystem.delete_file(part)


_FETCHED: dict[str, str] = {}


def local_path(uri: str) -> str:
    """A path that can be memory-mapped. Shared folders that are mounted are mapped in place;
    from other stores a worker fetches a file once and drops it when it ends."""
    filesystem, path = resolve(uri)
    if isinstance(filesystem, pafs.LocalFileSystem):
        return path
    if uri not in _FETCHED:
        if not _FETCHED:
            _FETCHED[""] = tempfile.mkdtemp(prefix="rarespark-")
            atexit.register(shutil.rmtree, _FETCHED[""], True)
        to = os.path.join(_FETCHED[""], uuid.uuid4().hex)
        pafs.copy_files(path, to, source_filesystem=filesystem, destination_filesystem=pafs.LocalFileSystem())
        _FETCHED[uri] = to
    return _FETCHED[uri]


def mapped(uri: str, dtype, count: int, offset: int = 0) -> np.ndarray:
    if not count:
        return np.empty(0, dtype)
    return np.memmap(local_path(uri), dtype=dtype, mode="r", offset=offset, shape=(count,))


# ---- text as bytes ---------------------------------------------------------------------------


def text_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and its n + 1 offsets; null is empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    n = len(col)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``most`` bytes together, or one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


def release() -> None:
    """Give memory that arrays no longer use back to the system; workers live on between tasks, and
    what each keeps adds up over the stages of a job."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def batches(it, text: str = "text", most: int = CHUNK_BYTES):
    """For each chunk of rows of each Arrow batch: the rows, their bytes and offsets."""
    for batch in it:
        buf, offs = text_view(batch.column(batch.schema.get_field_index(text)))
        for i, j in chunks(offs, most):
            yield batch.slice(i, j - i), buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        del batch, buf
        release()


def sub_batches(it, text: str = "text", most: int = CHUNK_BYTES):
    for rows, _, _ in batches(it, text, most):
        yield rows


def lower_ascii() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    return lut


def words(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of bytes that ``inside`` marks; no run
    crosses a row's end."""
    n = len(buf)
    if not n:
        e = np.empty(0, np.int64)
        return e, e, e
    m = inside[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    starts = np.flatnonzero(m & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:]
    ends = np.flatnonzero(m & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def extended(df: DataFrame, ddl: str):
    """``df``'s schema with more fields."""
    from pyspark.sql.types import StructType

    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def carried(rows: pa.RecordBatch, text: str, keep_text: bool) -> tuple[list[pa.Array], list[str]]:
    """The columns that an operator passes on, and their names."""
    at = [i for i, c in enumerate(rows.schema.names) if keep_text or c != text]
    return [rows.column(i) for i in at], [rows.schema.names[i] for i in at]
