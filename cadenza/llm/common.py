"""What several operators of this subpackage share: intermediate tables and token helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps A-Z to a-z and leaves every other byte alone.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one named by ``spark.checkpoint.dir``; where that is unset, a new temporary folder becomes the session's
    checkpoint folder, but only on a local master: a cluster's machines don't share such a folder, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Tables:
    """The tables that ``materialize`` wrote inside one ``owned`` block; only their owner removes them."""

    def __init__(self):
        self.paths: list[str] = []

    def remove(self, spark: SparkSession, *needed: DataFrame) -> None:
        """Removes these tables, but for those that the frames ``needed`` read."""
        plain = lambda p: p.split(":", 1)[-1].lstrip("/")
        held = {plain(f.rsplit("/", 1)[0]) for df in needed for f in df.inputFiles()}
        for path in [p for p in self.paths if plain(p) not in held]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            self.paths.remove(path)


_OWNER: ContextVar[Tables | None] = ContextVar("owner of the tables", default=None)


@contextmanager
def owned() -> Iterator[Tables]:
    """Tables written inside belong to this block; what it hasn't removed at its end goes to the block around it, if any.

    Results of operators read such tables: remove them only when the results were written elsewhere, or name them.
    Tables written outside of any block belong to nobody and are never removed by this library.
    """
    tables, outer = Tables(), _OWNER.get()
    token = _OWNER.set(tables)
    try:
        yield tables
    finally:
        _OWNER.reset(token)
        if outer is not None:
            outer.paths += tables.paths


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later stages don't recompute its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    owner = _OWNER.get()
    if owner is not None:
        owner.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def named(column: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame, *more: Column, keep: Iterable[str] | None = None) -> DataFrame:
    """``df`` with its columns (or ``keep``) in one, the struct ``row``, beside ``more``: names of a caller and an operator can't clash."""
    return df.select(F.struct(*map(named, df.columns if keep is None else keep)).alias("row"), *more)


def column_at(batch: pa.RecordBatch, path: str) -> pa.Array:
    """A column of a batch, or with dots a field of a struct column."""
    head, *rest = path.split(".")
    out = batch.column(head)
    for name in rest:
        out = out.field(name)
    return out


def slices(batch: pa.RecordBatch, text: str, rows: int = 500, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, of at most so many rows and bytes of the column ``text``; a longer text is a part by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = min(max(int(np.searchsorted(ends, before + size, "right")), start + 1), start + rows)
        yield batch.slice(start, stop - start)
        start = stop


def is_held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: As ASCII_LOWER, and turns every ASCII byte but letters and digits into a space.
ALNUM_LOWER = bytes(32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else ASCII_LOWER[b] for b in range(256))


class TokenHashes(dict):
    """64-bit hashes of tokens (bytes), those of up to ``longest`` bytes kept while there are fewer than ``most``."""

    def __init__(self, most: int = 400_000, longest: int = 64):
        super().__init__()
        self.most, self.longest = most, longest

    def __missing__(self, token: bytes) -> int:
        value = self.of(token)
        if len(token) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[token] = value
        return value

    def of(self, token: bytes) -> int:
        return xxhash.xxh64_intdigest(token)

    def array(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def alnum_tokens(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_LOWER).split() if text else []


def space_tokens(text: str | None) -> list[bytes]:
    """Runs of anything but a space and the control characters 9 to 13, with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []
