"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a table may be broadcast; beyond them joins shuffle.
MAX_BROADCAST_BYTES = 64 << 20
#: Bits of the bitmap of hashed ids that spares rows a shuffle, and the ids up to which it tells enough of them apart.
BITMAP_BITS, BITMAP_IDS = 1 << 28, 1 << 27

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_POLY = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share.

    ``spark.checkpoint.dir`` decides it.  Only where that is unset is one chosen
    here: a temporary folder in local mode, else one beside the warehouse.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            local = context.master.startswith("local") and not context.master.startswith("local-cluster")
            folder = tempfile.mkdtemp(prefix="corpuslab-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write to Parquet in the shared folder and read it again; also says where."""
    path = f"{folder or shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files and checkpoints that nothing refers to any more.

    It only learns of them when the driver collects garbage, which a driver
    that does little else may not do for half an hour.
    """
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A checkpoint folder of its own for what is done inside, deleted at the end."""
    context, before = spark.sparkContext, shared_folder(spark)
    own = f"{before}/scratch-{uuid.uuid4().hex}"
    context.setCheckpointDir(own)
    try:
        yield
    finally:
        getattr(context._jsc.sc(), "checkpointDir_$eq")(spark._jvm.scala.Option.apply(before))
        discard(spark, own)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it is stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        base = Path(tempfile.mkdtemp(prefix="corpuslab-")) / package.name
        context.addPyFile(shutil.make_archive(str(base), "zip", package.parent, package.name))
        _SHIPPED.add(context.applicationId)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes that a row takes in a broadcast table."""

    def one(name: str, kind: T.DataType) -> Column:
        col = F.col(f"`{name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(col), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            each = F.lit(16) if not isinstance(kind.elementType, (T.StringType, T.BinaryType)) else F.lit(64)
            return F.coalesce(F.size(col), F.lit(0)) * each + 24
        return F.lit(16)

    return sum((one(f.name, f.dataType).cast("long") for f in df.schema.fields), F.lit(32).cast("long"))


def fits(df: DataFrame, limit: int | None = None) -> bool:
    """Whether the rows of ``df``, measured, take at most ``limit`` bytes."""
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= (MAX_BROADCAST_BYTES if limit is None else limit)


def sized(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df``, hinted for broadcast only if its bytes are measured to be within ``limit``."""
    return F.broadcast(df) if fits(df, limit) else df


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """All columns as one struct ``row``, so that their names meet no others, and ``more`` beside it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame | None:
    """``rows`` with ``_maybe``: whether a bitmap of the hashed ids may hold their ``_key``.

    Its pieces of 4 kB are made by a distributed aggregate and broadcast, 32 MB
    at most; None where there are too many ids for it to tell them apart.
    """
    if ids.count() > BITMAP_IDS:
        return None
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP_BITS))
    piece, bit = (lambda c: F.shiftright(at(c), 15)), (lambda c: at(c).bitwiseAND(F.lit(32767)))
    bitmap = ids.groupBy(piece(F.col("_id")).alias("_piece")).agg(F.bitmap_construct_agg(bit(F.col("_id"))).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit(F.col("_key")), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, bit(F.col("_key")).bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return rows.withColumn("_piece", piece(F.col("_key"))).join(F.broadcast(bitmap), "_piece", "left").withColumn("_maybe", hit).drop("_piece", "_bits")


def without(df: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key isn't in the one column of ``ids``; null keys stay.

    Few ids are broadcast.  Of more, a bitmap lets all rows pass that can't be
    meant, and only the others are shuffled to meet the ids.
    """
    ids = checkpoint(ids.select(F.col(ids.columns[0]).alias("_id")).filter("_id is not null").distinct())
    rows, same = packed(df, _key=key), F.col("_key") == F.col("_id")
    if fits(ids):
        return rows.join(F.broadcast(ids), same, "left_anti").select("row.*")
    marked = _marked(rows, ids)
    if marked is None:
        return rows.join(ids, same, "left_anti").select("row.*")
    return marked.filter("not _maybe").select("row").unionByName(marked.filter("_maybe").join(ids, same, "left_anti").select("row")).select("row.*")


def among(df: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """The rows of ``df``, each as a struct ``row``, joined to the table ``ids`` by its column ``_id``, in the same ways as ``without``."""
    rows, same = packed(df, _key=key), F.col("_key") == F.col("_id")
    if fits(ids):
        return rows.join(F.broadcast(ids), same)
    marked = _marked(rows, ids)
    return (rows if marked is None else marked.filter("_maybe")).join(ids, same)


def crc_bucket(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(modulus))


def map_rows(df: DataFrame, fn: Callable[[list], list | None], schema: str) -> DataFrame:
    """Apply ``fn`` to the columns (as Python lists) of each Arrow batch.

    ``fn`` takes a list of columns and returns the columns of ``schema``.
    """
    ship(df.sparkSession)
    names = [f.name for f in _fields(schema)]
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                out = fn([c.to_pylist() for c in piece.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow, strict=True)], names)

    return df.mapInArrow(run, schema)


def row_test(spark: SparkSession, fn: Callable[[list], list], text: Column) -> Column:
    """``fn`` of a batch of values, a boolean for each, as a column: rows can be filtered by it without a join."""
    ship(spark)

    @F.arrow_udf("boolean")
    def run(values: pa.Array) -> pa.Array:
        out: list = []
        for piece in slices(pa.RecordBatch.from_arrays([values], ["v"])):
            out += fn(piece.column(0).to_pylist())
        return pa.array(out, pa.bool_())

    return run(text)


def slices(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece holds about ``limit`` bytes (one row at least)."""
    parts = max(1, -(-batch.nbytes // limit))
    step = max(1, -(-batch.num_rows // parts))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _fields(schema: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema).fields


def _arrow(schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in _fields(schema)]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, a bijection."""
    h = (h ^ (h >> _S33)) * _M1
    h = (h ^ (h >> _S33)) * _M2
    return h ^ (h >> _S33)


def _table(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_POLY) + np.uint64(seed))


_BYTE = _table(256, 0xB17E)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(4096, 1 << (n - 1).bit_length())
    if size not in _POW:
        with np.errstate(over="ignore"):
            up, down = np.full(size, np.uint64(_POLY)), np.full(size, np.uint64(pow(_POLY, -1, 1 << 64)))
            up[0] = down[0] = np.uint64(1)
            _POW[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _POW[size]


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.

    A polynomial over bytes, taken from prefix sums, so that no word is touched
    one by one.  Texts are cut at white space into pieces of about a megabyte.
    """
    out, at = [], 0
    low = text.translate(_LOWER)
    while at < len(low):
        end = min(len(low), at + _CHUNK)
        while end < len(low) and not _SPACE[low[end]]:
            end += 1
        out.append(_piece(np.frombuffer(low, np.uint8, end - at, at)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _piece(b: np.ndarray) -> np.ndarray:
    gap = np.ones(len(b) + 2, np.int8)
    gap[1:-1] = _SPACE[b]
    edge = np.flatnonzero(np.diff(gap))
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[b] * up[: len(b)], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_hashes(text: bytes | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles.

    Texts with fewer than ``width`` words have one shingle, all their words;
    texts without words have none.
    """
    words = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(words):
        return words
    span = min(width, len(words))
    with np.errstate(over="ignore"):
        h = np.full(len(words) - span + 1, np.uint64(span))
        for k in range(span):
            h = mix(h * np.uint64(_POLY) + words[k : k + len(h)])
    return np.unique(h)
