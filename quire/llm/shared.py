"""The shared folder: written tables that cut lineage, and array files that workers memory-map.

Everything here goes to the folder named by ``spark.checkpoint.dir``, which the driver and all
executors see. Only where that setting is absent (tests, a laptop) a temporary folder stands in.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import json
import os
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegralType, StringType

#: Broadcast bound: a side is broadcast only when its measured size stays below it.
BROADCAST_BYTES = 8 << 20
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a fresh temporary one only in local mode and where none is configured."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def integer_id(df: DataFrame, name: str) -> None:
    """Ids of operators that order or number by id must be integers; a clear error beats a failed cast."""
    kind = df.select(F.col(f"`{name}`")).schema[0].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{name} must be an integer column, not {kind.simpleString()}")


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, through Hadoop so that any store works."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _drop_late(path: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run's files; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_drop_late, path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The plan above it then starts from files that outlive any executor, with sizes that Catalyst
    knows; unlike a local checkpoint nothing is lost with a machine.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def uncut(df: DataFrame) -> None:
    """Delete a table written by :func:`cut` that no later plan reads."""
    drop(df.sparkSession, df._quire_path)


def measured_bytes(df: DataFrame) -> int:
    """What the rows of ``df`` take in a broadcast: a slot of 8 bytes a column, 24 a row, and the strings and arrays."""
    wide = [F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, StringType | BinaryType)]
    many = [F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, ArrayType)]
    extra = sum((F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in wide), F.lit(0)) + sum((F.coalesce(F.sum(F.greatest(F.size(c), F.lit(0)) * 16 + 16), F.lit(0)) for c in many), F.lit(0))
    rows, more = df.agg(F.count("*"), extra).first()
    return rows * (24 + 8 * len(df.columns)) + more


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the measured size stays under ``limit``.

    Beyond it the join is left to Catalyst, which shuffles both sides.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def lean(run):
    """``run`` for mapInArrow; at its end the worker gives freed memory back, as it lives on idle."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a libc without it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def bound_batches(spark: SparkSession) -> None:
    """Hand texts to workers in batches of at most ``BATCH_ROWS`` rows, unless the session says otherwise.

    Spark's default of 10,000 rows of long texts is held twice in the JVM and once in Python.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def parts_of(docs: DataFrame, text_col: str, part_bytes: int) -> int:
    """Parts for what grows with the texts: one for ``part_bytes`` of them, the session's shuffle partitions at least."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string"))), F.lit(0))).first()[0]
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))


def keep_columns(df: DataFrame, taken: list[str]) -> list[str]:
    """Columns of ``df`` that do not clash (case-insensitively) with those an operator adds."""
    low = {x.lower() for x in taken}
    return [c for c in df.columns if c.lower() not in low]


# ---- array files -----------------------------------------------------------------------------

def local_path(uri: str) -> str | None:
    """The path of a file URI or plain path; None for other stores."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write_arrays(uri: str, arrays: dict[str, np.ndarray], meta: dict | None = None) -> None:
    """One file of named arrays: a JSON header, then 64-byte aligned payloads.

    Written under a temporary name and renamed, so a retried or doubled task leaves a whole file.
    """
    at, spec = 0, {}
    for name, a in arrays.items():
        spec[name] = [a.dtype.str, at, len(a)]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps({"arrays": spec, "meta": meta or {}}).encode()
    head += b" " * (-(len(head) + 8) % 64)

    def put(out):
        out.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(b"\0" * (-a.nbytes % 64))

    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as out:
            put(out)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri)
    part = f"{name}.{uuid.uuid4().hex}.part"
    store.create_dir(os.path.dirname(name), recursive=True)
    with store.open_output_stream(part) as out:
        put(out)
    store.move(part, name)


def open_arrays(uri: str) -> tuple[dict[str, np.ndarray], dict]:
    """Arrays and meta of a file from :func:`write_arrays`: memory-mapped where the store has paths."""
    path = local_path(uri)
    if path is not None:
        raw = np.memmap(path, np.uint8, mode="r")
    else:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(uri)
        with store.open_input_file(name) as f:
            raw = np.frombuffer(f.read_buffer(), np.uint8)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    out = {}
    for name, (kind, at, count) in head["arrays"].items():
        start = 8 + n + at
        out[name] = raw[start : start + count * np.dtype(kind).itemsize].view(kind)
    return out, head["meta"]


@lru_cache(maxsize=4096)
def open_cached(uri: str) -> tuple[dict[str, np.ndarray], dict]:
    """As :func:`open_arrays`; a worker process maps each file once."""
    return open_arrays(uri)
