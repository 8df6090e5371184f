"""Token ids as flat files of unsigned integers with 64-bit document offsets.

A folder holds, for every part of the documents in their order:

- ``tokens-K.bin``: the ids one after another, little-endian, of 2 bytes where the vocabulary
  allows it, else of 4;
- ``offsets-K.bin``: little-endian 64-bit integers, the place of each document's first id among the
  ids of the whole folder, and one more for the end of the part;
- ``documents-K.arrow``: the documents' ids and other columns, as an uncompressed Arrow file;
- ``manifest``: a Parquet table of parts: names, counts, where the part begins, bytes of an id;
- ``schema.json``: the columns of the documents.

Bounds of parts come from a sample of the documents' ids; a document is encoded where it is read,
its ids go to its part, are sorted there and written. Counts of parts are added up to prefix sums, from which each part gets its base; only then
are offsets written. A part is written under another name and moved when it is whole, so a task that
is run again leaves the same files. All files can be memory-mapped: `TokenFiles` opens a folder for
random access, `read` gives its documents back as a DataFrame.

Defined results: a null or empty text has no ids but the end id; documents come in the order of
their id, null first, those of equal id in the order of a hash of their ids (which of two equal
documents comes first shows nowhere); other columns are carried along, those named ids, n_tokens or
start are replaced; an empty table gives a folder with an empty manifest. Special tokens written out
in a text become their id, as the library does by default.
"""

from __future__ import annotations

import bisect
import json
import os
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved
from .units import ByteLevel, Memo, by_place, chunks, per_text, units

#: Bytes of text and documents of a part, about; ids read at a time; sampled documents for each part.
PART_BYTES, PART_ROWS, READ_TOKENS, SAMPLED = 256 << 20, 200_000, 4 << 20, 20
SCHEMA = "schema.json"

_MANIFEST = (
    "part int, tokens string, offsets string, documents string, width int, n_docs long, n_tokens long"
)


def _library(content: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_buffer(content)


_MEMOS: dict[int, Memo] = {}


def unit_memo(content: bytes) -> Memo:
    """Ids by the tokenizers library, kept for the next task of the same worker."""
    key = hash(content)
    if key not in _MEMOS:
        side = ByteLevel(_library(content))
        _MEMOS.clear()
        _MEMOS[key] = Memo(lambda new: [side(new)])
    return _MEMOS[key]


def id_width(content: bytes, end_id: int | None) -> int:
    """Bytes of an id."""
    return 2 if max(_library(content).get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4


def _content(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def bounds_of(df: DataFrame, order: str, text_col: str, least: int) -> list:
    """Sorted values of a column that cut the documents into parts of about equal size. They come
    from a sample of some documents for each part; the number of parts is at least `least`. A value
    that stands for many documents may bound several parts."""
    value = F.col(f"`{order}`")
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(f"`{text_col}`"))).first()
    parts = max(least, -(-(size or 0) // PART_BYTES), -(-n // PART_ROWS))
    drawn = df.select(value.alias("v")).sample(min(1.0, SAMPLED * parts / max(n, 1)), seed=7)
    values = sorted((r["v"] for r in drawn.collect()), key=lambda v: (v is not None, v))  # a few for each file
    return [values[len(values) * k // parts] for k in range(1, parts)] if values else []


def part_of(value, tie: int, bounds: list) -> int:
    """The part of a document; those of a value that bounds several parts go by a 64-bit hash."""
    nulls = bisect.bisect_left(bounds, True, key=lambda v: v is not None)
    low, high = 0, nulls
    if value is not None:
        low, high = bisect.bisect_left(bounds, value, nulls), bisect.bisect_right(bounds, value, nulls)
    return low + (tie * (high - low + 1) >> 64)


def encode(df: DataFrame, path: str, order: str, bounds: list, text_col: str = "text", end_id: int | None = None) -> DataFrame:
    """df without its text, with `n_tokens`, `ids` (binary, as in the files), and in front of all
    the part and a hash that tells documents of one id apart."""
    content = _content(path)
    width = id_width(content, end_id)
    # a tokenizer's file, of fixed size, and a bound for each part
    sent = df.sparkSession.sparkContext.broadcast((content, bounds))
    kept = [f for f in df.schema.fields if f.name != text_col]
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    schema = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_tie", T.LongType()), *kept, *added])
    order_at, text_at, kept_at = df.columns.index(order), df.columns.index(text_col), [df.columns.index(f.name) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, bounds = sent.value
        memo = unit_memo(content)
        for batch in batches:
            for a, b in chunks(batch.column(text_at)):
                flat, counts = [], []
                for text in batch.column(text_at)[a:b].to_pylist():
                    own = units(text) if text else []
                    if own:
                        own[0] = (own[0],)
                    flat += own
                    counts.append(len(own))
                ids, sizes = memo.gather(0, memo.look_up(flat))
                n = per_text(sizes, counts)
                if end_id is not None:
                    ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                data = ids.astype(f"<u{width}").tobytes()
                ends = (np.concatenate([[0], np.cumsum(n)]) * width).astype(np.int32)
                ties = [xxhash.xxh64_intdigest(data[i:j]) for i, j in zip(ends.tolist(), ends[1:].tolist())]
                parts = [part_of(v, t, bounds) for v, t in zip(batch.column(order_at)[a:b].to_pylist(), ties)]
                binary = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(data)])
                # hashes are sorted as signed numbers, in the same order
                signed = pa.array((np.array(ties, np.uint64) ^ np.uint64(1 << 63)).view(np.int64))
                columns = [batch.column(k)[a:b] for k in kept_at]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), signed, *columns, pa.array(n), binary], names=schema.names)

    return by_place(df).mapInArrow(run, schema)


def file_system(folder: str) -> tuple[pfs.FileSystem, str]:
    """What reads and writes below a folder, given as an URI or as an absolute path."""
    return pfs.FileSystem.from_uri(folder)


def _moved(fs: pfs.FileSystem, path: str, write) -> None:
    """Writes a file under a name of its own, then gives it its name."""
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as sink:
        write(sink)
    fs.move(own, path)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches cut where the part in their first column changes."""
    for batch in batches:
        part = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        yield from ((int(part[a]), batch.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if b > a)


def write(df: DataFrame, folder: str, path: str, order: str = "doc_id", text_col: str = "text", end_id: int | None = None) -> DataFrame:
    """Writes the token files of documents, in the order of a column; returns the manifest."""
    spark, width = df.sparkSession, id_width(_content(path), end_id)
    df = df.drop("ids", "n_tokens", "start")
    bounds = bounds_of(df, order, text_col, int(spark.conf.get("spark.sql.shuffle.partitions")))
    encoded = encode(df, path, order, bounds, text_col, end_id)
    about_docs = T.StructType(encoded.schema.fields[2:-1])
    fs, root = file_system(folder)
    fs.create_dir(root)
    _moved(fs, f"{root}/{SCHEMA}", lambda sink: sink.write(about_docs.json().encode()))
    keys = ["_part", F.col(f"`{order}`").asc_nulls_first(), "_tie"]
    ordered = encoded.repartitionById(len(bounds) + 1, "_part").sortWithinPartitions(*keys)
    ids_at = ordered.columns.index("ids")
    rest = {k: c for k, c in enumerate(ordered.columns) if c not in ("_part", "_tie", "ids")}

    def write_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _MEMOS.clear()  # this worker may have encoded before
        fs, root = file_system(folder)
        for part, runs in groupby(_runs(batches), key=lambda run: run[0]):
            about: list[pa.RecordBatch] = []
            names = [f"tokens-{part:06d}.bin", f"offsets-{part:06d}.bin", f"documents-{part:06d}.arrow"]

            def tokens_of(sink) -> None:
                for _, batch in runs:
                    for ids in batch.column(ids_at):
                        sink.write(ids.as_buffer())
                    about.append(pa.RecordBatch.from_arrays([batch.column(k) for k in rest], names=list(rest.values())))

            def documents_of(sink) -> None:
                with pa.ipc.new_file(sink, about[0].schema) as file:
                    for batch in about:
                        file.write_batch(batch)

            _moved(fs, f"{root}/{names[0]}", tokens_of)
            _moved(fs, f"{root}/{names[2]}", documents_of)
            total = sum(int(b.column("n_tokens").to_numpy().sum()) for b in about)
            values = [part, *names, width, sum(b.num_rows for b in about), total]
            yield pa.RecordBatch.from_pylist([dict(zip(_COLUMNS, values))], schema=_ARROW)

    written = saved(by_place(ordered).mapInArrow(write_parts, _MANIFEST), "parts")
    based = with_bases(written)

    def write_offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['documents']}") as source, pa.ipc.open_file(source) as file:
                    sizes = np.concatenate([file.get_batch(k).column("n_tokens").to_numpy() for k in range(file.num_record_batches)])
                starts = row["first_token"] + np.concatenate([[0], np.cumsum(sizes)])
                _moved(fs, f"{root}/{row['offsets']}", lambda sink: sink.write(starts.astype("<i8").tobytes()))
            yield batch

    finished = based.repartition(len(bounds) + 1).mapInArrow(write_offsets, based.schema)
    finished.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(based.schema).parquet(f"{folder}/manifest")


_COLUMNS = [c.split()[0] for c in _MANIFEST.split(", ")]
_ARROW = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in _MANIFEST.split(", ")])


def with_bases(parts: DataFrame) -> DataFrame:
    """Parts with first_doc and first_token: sums over the parts before, by groups of 1,024 parts."""
    group = F.shiftright("part", 10)
    sums = {"n_docs": "first_doc", "n_tokens": "first_token"}
    over = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)  # one row per 1,024 files
    groups = parts.groupBy(group.alias("_group")).agg(*[F.sum(c).alias(c) for c in sums])
    groups = groups.select("_group", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"_{c}") for c in sums])
    within = Window.partitionBy("_group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumn("_group", group).join(groups, "_group")
    before = {out: F.col(f"_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c, out in sums.items()}
    return rows.withColumns(before).drop("_group", *[f"_{c}" for c in sums])


class TokenFiles:
    """A folder of token files, opened for random access by document number or place."""

    def __init__(self, folder: str):
        self.fs, self.root = file_system(folder)
        import pyarrow.parquet as pq

        self.parts = sorted(pq.read_table(f"{self.root}/manifest", filesystem=self.fs).to_pylist(), key=lambda p: p["part"])
        self.first_docs = [p["first_doc"] for p in self.parts]
        self.n_docs = sum(p["n_docs"] for p in self.parts)
        self.n_tokens = sum(p["n_tokens"] for p in self.parts)

    def __len__(self) -> int:
        return self.n_docs

    def tokens(self, part: dict) -> np.ndarray:
        return mapped(self.fs, f"{self.root}/{part['tokens']}", f"<u{part['width']}")

    def __getitem__(self, number: int) -> np.ndarray:
        """The ids of a document by its number in the order of the files."""
        if not 0 <= number < self.n_docs:
            raise IndexError(number)
        part = self.parts[bisect.bisect_right(self.first_docs, number) - 1]
        starts = mapped(self.fs, f"{self.root}/{part['offsets']}", "<i8")
        a, b = starts[number - part["first_doc"] :][:2] - part["first_token"]
        return self.tokens(part)[a:b]


def mapped(fs: pfs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the file system is a mounted one, else read."""
    if isinstance(fs, pfs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with fs.open_input_file(path) as source:
        return np.frombuffer(source.read_buffer(), dtype)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a folder, read back from its files: their columns, n_tokens, `start` (the
    ids of all documents before) and `ids` (binary, 32-bit little-endian)."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    parts = manifest.select("part", "tokens", "offsets", "documents", "width", "first_token")
    fs, root = file_system(folder)
    with fs.open_input_file(f"{root}/{SCHEMA}") as source:
        columns = T.StructType.fromJson(json.loads(source.read())).fields
    schema = T.StructType([*columns, T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for row in (r for batch in batches for r in batch.to_pylist()):
            ids = mapped(fs, f"{root}/{row['tokens']}", f"<u{row['width']}")
            starts = mapped(fs, f"{root}/{row['offsets']}", "<i8")
            local, at = starts - row["first_token"], 0
            with fs.open_input_file(f"{root}/{row['documents']}") as source, pa.ipc.open_file(source) as file:
                for k in range(file.num_record_batches):
                    batch = file.get_batch(k)
                    while batch.num_rows:
                        step = max(1, int(np.searchsorted(local, local[at] + READ_TOKENS)) - at)
                        some, batch = batch.slice(0, step), batch.slice(step)
                        end = at + some.num_rows
                        data = np.asarray(ids[local[at] : local[end]]).astype("<u4")
                        bounds = ((local[at : end + 1] - local[at]) * 4).astype(np.int32)
                        binary = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
                        begin = pa.array(np.asarray(starts[at:end], dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([*some.columns, begin, binary], names=schema.names)
                        at = end

    return parts.repartition(max(1, manifest.count())).mapInArrow(run, schema)
