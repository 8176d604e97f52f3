"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.store import materialize, shared_dir

__all__ = ["WHITE", "WORD", "forget", "held_out", "joined_bytes", "materialize", "partitions", "shared_dir", "slices", "spare", "table"]

#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = bytes([0x20, *range(0x09, 0x0E)])
WORD = r"[^\x20\x09-\x0D]+"


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores after them where df has columns of these names in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a table that materialize wrote, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for rows whose labels must not be learned; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined_bytes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, each followed by a line feed; and the start of each text,
    with the total length at the end."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if lower:
        parts = [p.lower() for p in parts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    parts.append(b"")
    return np.frombuffer(b"\n".join(parts), np.uint8), starts


def slices(sizes: list[int], limit: int):
    """Cut 0..len(sizes) into runs whose sizes add up to limit or so, one item at least."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)
