"""Shared folder, tables that cut lineage, and file access from executors."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: later stages do not depend on lost executors."""
    path = new_folder(df.sparkSession, name) + "/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """(pyarrow file system, path) for a folder or file of the shared folder; used on executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def clashing(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep only; names are taken exactly (a column `TEXT` beside `text` doesn't clash)."""
    at = [place_of(df, name) for name in keep]
    plain = unique_names(df)
    return plain.select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, keep, strict=True)])


def unique_names(df: DataFrame) -> DataFrame:
    """df with the columns _0, _1, ...: names that differ in case only, or not at all, can then be told apart."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def place_of(df: DataFrame, name: str) -> int:
    """Place of a column, taken exactly where there is one and without regard to case otherwise."""
    at = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not at:
        raise ValueError(f"column {name!r} is missing; there are {df.columns}")
    return at[0]


def keys(df: DataFrame, *names: str) -> DataFrame:
    """df with these long columns as strings. A long column with a null reaches pandas as doubles, which lose the low bits
    of large ids; strings come through whole, and `longs` turns them back."""
    return df.withColumns({n: F.col(n).cast("long").cast("string") for n in names})


def longs(values) -> pd.api.extensions.ExtensionArray:
    """A nullable column of whole numbers from strings, ints and nulls, exact over all 64 bits."""
    found = [None if x is None or x is pd.NA or x != x else int(x) for x in values]
    data = np.fromiter((0 if x is None else x for x in found), np.int64, len(found))
    return pd.arrays.IntegerArray(data, np.fromiter((x is None for x in found), bool, len(found)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession, value):
    """A function that gives value on executors. Broadcasts know only installed modules, so classes go by value."""
    from pyspark import cloudpickle

    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get():
        import pickle

        return pickle.loads(sent.value)

    return get
