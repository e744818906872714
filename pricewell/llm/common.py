"""What the operators of this subpackage share: word rules, table access, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space and the control characters 0x09-0x0D part words; everything else belongs to them.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Array of the words of a text; null text has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only in local mode, where one machine is all there is, it may be unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="pricewell-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Tables that ``keep`` wrote and ``released`` has not deleted.
_kept: list[str] = []


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage and survives lost executors. The schema is passed on, so that reading needs no job. The table stays until
    ``released`` deletes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pricewell-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the tables kept within the block when it ends, but for those whose paths were put into the list it gives."""
    begin, spared = len(_kept), []
    yield spared
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in [p for p in _kept[begin:] if p not in spared]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _kept.remove(path)


def last_kept() -> str:
    """Path of the table that ``keep`` wrote last."""
    return _kept[-1]


def unit_draw(*parts: Column) -> Column:
    """A number in (0, 1) that depends only on ``parts``: 48 bits of an MD5, so SQL engines agree on it."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
