"""Documents packed into blocks, and questions that blocks put to the whole corpus.

A block holds some megabytes of documents as one compressed value. Blocks are written once, into a
table bucketed by their number, so that whatever is gathered for a block later meets it without
shuffling texts again. A question is a sorted array of 64-bit keys: its slices go to ranges of the
key space, are merged there with those of all other blocks, and answers in the same order go back.
A key is sent once per block however often it occurs there, so that no key makes a task large.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path

#: Bytes of text in a block, and of it worked on at a time.
BLOCK, PART = 16 << 20, 1 << 20
#: Keys in a range of the key space, about.
RANGE_KEYS = 1 << 20


def squeezed(array: np.ndarray) -> bytes:
    """An array as compressed bytes; equal bytes of the elements lie together."""
    flat = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.dtype.itemsize)
    return zstandard.compress(flat.T.tobytes(), 1)


def widened(data: bytes, dtype) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(flat.reshape(size, len(flat) // size).T).view(dtype).reshape(-1)


def squeezed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences."""
    return squeezed(np.diff(keys, prepend=np.uint64(0)))


def widened_keys(data: bytes) -> np.ndarray:
    return np.cumsum(widened(data, np.uint64), dtype=np.uint64)


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return zstandard.compress(sink.getvalue(), 3)


def unpacked(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(payload)).read_all()


def pack(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A bucketed table of blocks: block, bytes (of text), payload (all columns of df)."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, size = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(waiting)
            return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "bytes": pa.array([size], pa.int64()), "payload": pa.array([_packed(rows)], pa.binary())})

        for batch in batches:
            weight = batch.column(at).nbytes / max(batch.num_rows, 1)
            step = max(1, int(BLOCK / 8 / max(weight, 1)))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                waiting.append(part)
                size += part.column(at).nbytes
                if size >= BLOCK:
                    yield block()
                    number, waiting, size = number + 1, [], 0
        if waiting:
            yield block()

    spark = df.sparkSession
    packed = df.mapInArrow(run, "block long, bytes long, payload binary")
    name = f"blocks_{uuid.uuid4().hex}"
    buckets = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # payloads are compressed already
    packed.write.option("path", new_path(spark, name)).option("compression", "none").bucketBy(buckets, "block").saveAsTable(name)
    return spark.table(name)


def ranges(blocks: DataFrame) -> int:
    """Into how many ranges the key space is cut for these blocks: a power of two."""
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    return 1 << max(4, int(total // (8 * RANGE_KEYS)).bit_length())


def sliced(keys: np.ndarray, parts: int) -> list[tuple[int, slice]]:
    """The slices of sorted keys that fall into the ranges, empty ones left out."""
    shift = np.uint64(64 - (parts.bit_length() - 1))
    cuts = np.searchsorted(keys, np.arange(parts, dtype=np.uint64) << shift)
    cuts = [*cuts.tolist(), len(keys)]
    return [(r, slice(a, b)) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def questions(blocks: DataFrame, keys: Callable[[pa.Table], Iterable[np.ndarray]], parts: int, dtype: str) -> DataFrame:
    """(part, block, keys, weights): what each block asks. keys gives the sorted distinct keys of
    a block and a weight for each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, payload in zip(frame["block"], frame["payload"]):
                own, weights = keys(unpacked(payload))
                weights = np.asarray(weights).astype(dtype)
                rows = [(r, block, squeezed_keys(own[s]), squeezed(weights[s])) for r, s in sliced(own, parts)]
                yield pd.DataFrame(rows, columns=["part", "block", "keys", "weights"])

    return blocks.select("block", "payload").mapInPandas(run, "part int, block long, keys binary, weights binary")


def answers(asked: DataFrame, merge: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], dtype: str) -> DataFrame:
    """(block, part, values). merge gets the distinct keys of a range, for every asked key its
    place among them, and its weight; it returns a value for every asked key."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys = [widened_keys(k) for k in group["keys"]]
        sizes = np.cumsum([0, *map(len, keys)])
        weights = np.concatenate([widened(w, dtype) for w in group["weights"]])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        values = merge(distinct, place, weights)
        return pd.DataFrame(
            {
                "block": group["block"],
                "part": group["part"],
                "values": [squeezed(values[a:b]) for a, b in zip(sizes, sizes[1:])],
            }
        )

    return asked.groupBy("part").applyInPandas(run, "block long, part int, values binary")


def told(values: pd.DataFrame, dtype) -> np.ndarray:
    """The values for all keys of a block, in the order of the keys."""
    ordered = values.sort_values("part")["values"]
    return np.concatenate([widened(v, dtype) for v in ordered]) if len(ordered) else np.zeros(0, dtype)


def meet(blocks: DataFrame, answered: DataFrame, work: Callable[[pa.Table, pd.DataFrame], Iterable[pd.DataFrame]], schema: str) -> DataFrame:
    """Runs work on every block together with what it was answered."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = [f for payload in own["payload"] for f in work(unpacked(payload), got)]
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in columns})

    left = blocks.select("block", "payload").groupBy("block")
    return left.cogroup(answered.groupBy("block")).applyInPandas(run, schema)


def parts_of(rows: pa.Table, text_col: str = "text") -> Iterator[pa.Table]:
    """The rows of a block, about a megabyte of text at a time."""
    step = max(1, int(rows.num_rows * PART / max(rows.column(text_col).nbytes, 1)))
    for at in range(0, rows.num_rows, step):
        yield rows.slice(at, step)
