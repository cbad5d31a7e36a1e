"""Sorted number arrays in files of the shared folder, and their way through a shuffle.

A task sends numbers as few rows: one packed block for each bucket. The rows that meet in a bucket hold blocks, which are sorted and merged with numpy.
Files lie in the folder of ``spark.checkpoint.dir``, which every executor must reach as a path (a mounted folder), since workers map them.
"""
from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import SparkSession

from pagewright.session import shared_folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, for files that workers write and map."""
    where = urlparse(shared_folder(spark))
    if where.scheme not in ("", "file"):
        raise ValueError("spark.checkpoint.dir must be a folder mounted on every machine: workers map files in it")
    return f"{unquote(where.path)}/{name}-{uuid.uuid4().hex[:12]}"


def save(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array whole or not at all, so a task that is lost or run twice leaves one good file."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    unfinished = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(unfinished, "wb") as out:
        np.save(out, values)
    os.replace(unfinished, f"{folder}/{name}.npy")


@lru_cache(maxsize=1024)
def mapped(folder: str, name: str) -> np.ndarray:
    return np.load(f"{folder}/{name}.npy", mmap_mode="r")


def packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length as one block. Put the sorted one first: its differences, byte by byte, take little room."""
    n, parts = len(columns[0]), []
    for i, column in enumerate(columns):
        values = np.ascontiguousarray(column)
        if i == 0 and n:
            values = np.concatenate([values[:1], np.diff(values)])
        parts.append(values.view(np.uint8).reshape(n, values.itemsize).T.tobytes())
    return zstandard.compress(b"".join(parts), 1)


def unpacked(block: bytes, *kinds: type) -> list[np.ndarray]:
    data = zstandard.decompress(block)
    width = sum(np.dtype(k).itemsize for k in kinds)
    n, at, out = len(data) // width, 0, []
    for i, kind in enumerate(kinds):
        size = np.dtype(kind).itemsize
        values = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(n)
        out.append(np.cumsum(values, dtype=kind) if i == 0 else values)
        at += n * size
    return out


def summed(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, ascending, and the sums of each column of counts."""
    if not len(keys):
        return [keys, *counts]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[first], *(np.add.reduceat(c[order], first) for c in counts)]


def place(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key lies in a sorted array, and whether it is there."""
    at = np.searchsorted(sorted_keys, keys)
    found = np.zeros(len(keys), bool)
    inside = at < len(sorted_keys)
    found[inside] = sorted_keys[at[inside]] == keys[inside]
    return at, found


def blocks_by_bucket(buckets: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A packed block for each bucket of columns that their first one sorts: rows ``(bucket, block)``."""
    order = np.argsort(buckets, kind="stable")
    names, starts = np.unique(buckets[order], return_index=True)
    ends = [*starts[1:], len(order)]
    blocks = [packed(*(c[order[a:b]] for c in columns)) for a, b in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(blocks, pa.large_binary())], ["bucket", "block"])


def by_bucket(batches, *kinds: type) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of each bucket of a partition's rows, its blocks put end to end; one bucket is unpacked at a time."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(bucket, []).append(block)
    while held:
        bucket, blocks = held.popitem()
        yield bucket, [np.concatenate(c) for c in zip(*(unpacked(b, *kinds) for b in blocks), strict=True)]
