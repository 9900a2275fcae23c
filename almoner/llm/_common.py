"""What the operators of this subpackage share: shared storage, Arrow batches, tokens."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def q(name: str) -> str:
    """The column of exactly this name, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own, but only if all run on this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet under the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def dropped(*frames: DataFrame | None) -> None:
    """Deletes the folders of stored tables that nothing reads any more; other tables are left alone."""
    for df in frames:
        if path := getattr(df, "__dict__", {}).get("stored_at"):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, which it does when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_batches(df: DataFrame, columns: list[str], fn: Callable, fields: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """Adds columns that fn makes from whole Arrow batches of the named columns.

    fn gets an iterator of lists of pyarrow arrays (one per name in columns) and yields, for each, the values of the new
    fields. keep: the columns to carry along (all, if None). A kept column of a new field's name, in any case, gives way to it.
    """
    new = {f.name.lower() for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([T.StructField(c, df.schema[c].dataType, True) for c in keep] + fields)
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(schema)
        held: list[pa.RecordBatch] = []

        def inputs():
            for b in batches:
                if b.num_rows:
                    held.append(b)
                    yield b.columns[:n]

        for values in fn(inputs()):
            b = held.pop()
            made = [v if isinstance(v, pa.Array) else pa.array(v, type=out.field(len(keep) + i).type) for i, v in enumerate(values)]
            carried = [x.cast(out.field(i).type) for i, x in enumerate(b.columns[n:])]
            yield pa.RecordBatch.from_arrays(carried + made, schema=out)

    source = df.select(*[F.col(q(c)).alias(f"__in{i}") for i, c in enumerate(columns)], *[F.col(q(c)).alias(f"__keep{i}") for i, c in enumerate(keep)])
    return source.mapInArrow(run, schema)


def texts_of(array: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [x or "" for x in array.to_pylist()]


def crc_bucket(column: str, mod: int):
    """crc32 of a column as text, modulo mod; null where the column is null."""
    return F.pmod(F.crc32(F.col(q(column)).cast("string").cast("binary")), F.lit(mod))


LETTERS_AND_MARKS = re.compile(r"([^\W\d_]+)([^\w\s]*)")


class Encoder:
    """A tokenizers file, applied chunk by chunk with a bounded memory of chunks already met.

    Exact for tokenizers whose normalizer and pre-tokenizer never look across white space, drop it, fold case and keep
    runs of letters apart from runs of marks: then a text's ids are those of its chunks between blanks, one after the
    other. Ids are held as little-endian unsigned 16-bit numbers where the vocabulary allows that, else 32-bit ones.
    """

    def __init__(self, path: str, most: int = 900_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.most = most
        encoder = self

        class Known(dict):
            def __missing__(self, chunk):
                return encoder.learn(chunk)

        self.known = Known()

    def _bytes(self, encoding) -> bytes:
        return np.asarray(encoding.ids, dtype=self.dtype).tobytes()

    def learn(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        m = LETTERS_AND_MARKS.fullmatch(chunk) if len(chunk) < 64 and max(chunk) < "ɐ" else None
        low = m[1].lower() if m else ""
        if not low.isalpha():
            out = self._bytes(self.whole.encode(chunk, add_special_tokens=False))
        elif low == chunk:
            out = self._bytes(self.bare.encode(low, add_special_tokens=False))
        else:
            out = self.known[low] + (self._marks(m[2]) if m[2] else b"")
        if len(chunk) < 64:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[chunk] = out
        return out

    def _marks(self, run: str) -> bytes:
        out = self.known.get(run)
        if out is None:
            out = self.known[run] = self._bytes(self.whole.encode(run, add_special_tokens=False))
        return out

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))

    def crc32(self, ids: bytes) -> int:
        return zlib.crc32(np.frombuffer(ids, self.dtype).astype("<u4").tobytes())


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]
