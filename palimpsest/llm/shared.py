"""Shared-folder tables that cut lineage, and small Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one on this machine if the master is local, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "palimpsest-shared")
    return named.rstrip("/")


_scopes: list[list[tuple[SparkSession, str]]] = []


def cut(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the written table.

    A later stage that loses an executor rereads the files instead of recomputing, and values that
    depend on the task that made them (segment and partition numbers) stay what they were. The files go at the end
    of the innermost :func:`scratch`, with ``keep`` at that of the one around it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._palimpsest_path = path
    if len(_scopes) > keep:
        _scopes[-1 - keep].append((spark, path))
    return out


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables that :func:`cut` writes in here are deleted at the end, but for those it keeps."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def keep(df: DataFrame) -> None:
    """A table of :func:`cut` of the innermost :func:`scratch` stays as long as those of the one around it."""
    for scope, outer in zip(_scopes[-1:], [*_scopes[-2:-1], []], strict=False):
        for entry in [e for e in scope if e[1] == getattr(df, "_palimpsest_path", None)]:
            scope.remove(entry)
            outer.append(entry)


def whole_tables(spark: SparkSession, path: str) -> list[str]:
    """Names of the tables in a folder that were written to their end; none if there is no such folder."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(where):
        return []
    found = [x.getPath() for x in files.listStatus(where)]
    return sorted(x.getName() for x in found if files.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut` that no later plan reads."""
    if path := getattr(df, "_palimpsest_path", None):
        _delete(df.sparkSession, path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def strings(column) -> list[str]:
    """Values of a text column; null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch in the order of ``schema``."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one unit of work at a time: those of equal numbers in the first three columns, by which rows are sorted."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        own = [np.asarray(b.column(k)) for k in range(3)]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in own])) + 1
        edges = [0, *new.tolist(), b.num_rows]
        for s, e in zip(edges, edges[1:], strict=False):
            which = tuple(int(c[s]) for c in own)
            if which != now and held:
                yield _joined(held)
                held = []
            now = which
            held.append(b.slice(s, e - s))
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def tidy() -> None:
    """Hand memory that a finished piece of work freed back to the system: workers are reused, and idle ones count."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


_caches: dict[str, object] = {}
_last = ""


def claim(name: str, *caches) -> None:
    """Called where a worker starts on an operator's rows: what other operators have cached in it goes."""
    global _last
    if _last != name:
        for other, held in _caches.items():
            if other != name:
                for c in held:
                    c.clear()
        _caches[name] = caches
        _last = name
        tidy()
