"""What the operators share: words, and tables written to the shared folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argentic.session import shared_folder

#: The white space that separates words, as a set and as a pattern.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; none for null and for blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def lower_ascii(text: Column) -> Column:
    """The text with A-Z in lower case and all other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, parts: int) -> Column:
    """The part, 0 to parts - 1, that a document's id falls in."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


#: Rows and bytes that Spark hands to Python at a time: whole texts, of which both sides hold a batch for each running task.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_ROWS rows and BATCH_BYTES bytes, or one row, at most from now on; a session that asks for smaller ones keeps them."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of what came before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0
        small_batches(spark)
        atexit.register(self._forget)

    def save(self, df: DataFrame, packed: bool = False) -> DataFrame:
        """``packed``: values are large and compressed already; pages of them would take as much memory again to compress."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path, compression="none" if packed else None)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more, and let Spark clear the shuffles that made them."""
        for df in tables:
            self._delete(df._scratch_path)
        self.spark._jvm.System.gc()

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _forget(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended, and the folder with it
            pass


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
