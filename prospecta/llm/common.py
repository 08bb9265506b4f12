"""What the operators share: the cluster's shared folder, written stages, text batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a Python worker holds as numpy arrays at once; a longer text makes a batch of its own.
SLICE_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only if unset."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir()
        if not folder:
            context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='prospecta-')}")
            folder = context.getCheckpointDir()
    return folder.rstrip("/")


def _no_dictionary(hashes: Iterable[str]) -> dict[str, str]:
    """Options of a write: a dictionary of values that hardly repeat costs time and is thrown away."""
    return {f"parquet.enable.dictionary#{x}": "false" for x in hashes}


def written(df: DataFrame, name: str, hashes: Iterable[str] = ()) -> DataFrame:
    """df as a table in the shared folder: lost executors cost no recomputation, and later joins see its size. hashes: columns
    of values that hardly repeat."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/prospecta/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **_no_dictionary(hashes)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has the driver drop plans that are done with, so that Spark's cleaner removes their shuffle files now and not at its
    next chance."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucketed(parts: Iterable[DataFrame], name: str, key: str) -> DataFrame:
    """Rows of all parts as a table in the shared folder, in as many buckets of `key` as shuffles have partitions: joins of it
    with itself by that key move nothing. What a part has exchanged is let go before the next is made."""
    table = f"{name}_{uuid.uuid4().hex}"
    for df in parts:
        spark = df.sparkSession
        n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{shared_folder(spark)}/prospecta/{table}"
        df.write.mode("append").bucketBy(n, key).options(compression="zstd", path=path, **_no_dictionary(df.columns)).saveAsTable(table)
        del df
        release(spark)
    return spark.table(table)


def numbered(docs: DataFrame, name: str = "row_number") -> tuple[DataFrame, str]:
    """(docs with a number for each row, the number's column, which no column of docs is called). Written once, so that all
    reads agree on it; rows of equal or null ids are told apart by it."""
    taken = {x.lower() for x in docs.columns}
    while name in taken:
        name = f"_{name}"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def docs_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, whatever else the table has; a null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone. lower() does the same, faster, where all characters are ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


#: Elements of a long array are summed and numbered block by block: appending to an array copies it, so arrays that grow are kept short.
BLOCK = 128


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value made once and not anew for each element of what follows."""
    return F.transform(F.array(value), then)[0]


def block_starts(pieces: Column) -> Column:
    """Where each block of BLOCK pieces (of length n) begins."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), lambda i: F.aggregate(F.slice(pieces, i * BLOCK + 1, BLOCK), F.lit(0).cast("long"), lambda n, x: n + x.n))
    return F.aggregate(
        blocks, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, n: F.struct((acc.at + n).alias("at"), F.array_append(acc.out, acc.at).alias("out")), lambda acc: acc.out)


def slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of text, or of one row."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words [^\\x20\\x09-\\x0D]+ of each text: (code of each word, number of words by text, distinct words)."""
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    of = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(split)).astype(np.int64))
    words = split.flatten()
    full = np.asarray(pc.binary_length(words)) > 0
    if not full.all():
        words, of = words.filter(pa.array(full)), of[full]
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return np.asarray(coded.indices).astype(np.int64), np.bincount(of, minlength=len(texts)), coded.dictionary


def strings(array: pa.Array) -> list[str]:
    """As to_pylist() of an array of strings without nulls, several times faster."""
    return array.to_numpy(zero_copy_only=False).tolist()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
