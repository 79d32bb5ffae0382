"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corelev.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table below the session's shared checkpoint folder (``by``: a folder for each value): cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class WordHash(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bounded number of words (see ``tidy``)."""

    def __missing__(self, word):
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def tidy(self, most: int = 100_000):
        if len(self) > most:
            self.clear()


def utf8(column) -> list:
    """The UTF-8 bytes of an Arrow string column's values; null becomes empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches, rows: int = 2000, byte_limit: int = 16 << 20):
    """Arrow batches cut into pieces of at most ``rows`` rows and about ``byte_limit`` bytes (one row at least)."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        step = max(1, min(rows, int(n * byte_limit / max(1, b.nbytes))))
        for i in range(0, n, step):
            yield b.slice(i, step)
