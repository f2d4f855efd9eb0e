"""An append-only store of text vectors: data folders of Parquet, and a manifest that says which of them count."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class VectorStore:
    """Vectors of texts under one model, ``key, vector``; the key is the SHA-256 of model and text.

    An append writes a data folder and then an entry of the manifest, whose file appears under its final name in one
    step. Readers take the folders that entries name and nothing else, so a writer that dies in between leaves a folder
    that nobody sees; ``truncate`` removes such folders. Two writers cannot take the same entry: the later one takes the
    next. A store opened with another model or dimension is an error.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, dim: int):
        self.spark, self.path, self.model, self.dim = spark, path.rstrip("/"), model, dim
        self.jvm = spark.sparkContext._jvm
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._put("meta.json", {"model": model, "dim": dim})
        meta = self._get("meta.json")
        if (meta["model"], meta["dim"]) != (model, dim):
            raise ValueError(f"the store at {path} holds {meta['model']} with {meta['dim']} numbers, not {model} with {dim}")

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _put(self, name: str, value: dict) -> bool:
        """Write a small file that appears whole or not at all; False if the name is taken."""
        if self.fs.exists(self._at(name)):
            return False
        part = self._at(f"_parts/{uuid.uuid4().hex}")
        out = self.fs.create(part, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        self.fs.mkdirs(self._at(name).getParent())
        if self.fs.exists(self._at(name)) or not self.fs.rename(part, self._at(name)):
            self.fs.delete(part, False)
            return False
        return True

    def _get(self, name: str) -> dict:
        # files of a few hundred bytes
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first().value)

    def _names(self, folder: str) -> list[str]:
        if not self.fs.exists(self._at(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(folder)) if not s.getPath().getName().startswith((".", "_")))

    def entries(self) -> list[dict]:
        """The manifest: ``folder, n`` of every append that counts, in their order."""
        return [self._get(f"manifest/{name}") for name in self._names("manifest")]

    def key(self, text: Column) -> Column:
        return F.sha2(F.concat(F.lit(f"{self.model}::"), text), 256)

    def read(self) -> DataFrame:
        """``key, vector`` of all appends that count."""
        folders = [f"{self.path}/data/{e['folder']}" for e in self.entries()]
        schema = "key string, vector array<float>"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def missing(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """Distinct texts without a vector, ``key, text``; null is no text."""
        wanted = texts.filter(F.col(text).isNotNull()).select(self.key(F.col(text)).alias("key"), F.col(text).alias("text")).distinct()
        return wanted.join(self.read().select("key"), "key", "left_anti")

    def add(self, rows: DataFrame, text: str = "text", vector: str = "vector") -> int:
        """Append vectors (``text, vector``) of texts that have none yet; how many were appended.

        Of a text that repeats one vector is taken. A vector of another dimension is an error, and nothing is appended.
        """
        wrong = F.raise_error(F.concat(F.lit(f"a vector has not {self.dim} numbers but "), F.size(vector).cast("string")))
        checked = F.when(F.size(vector) == self.dim, F.col(vector).cast("array<float>")).otherwise(wrong)
        new = rows.filter(F.col(text).isNotNull()).select(self.key(F.col(text)).alias("key"), checked.alias("vector"))
        new = new.groupBy("key").agg(F.min("vector").alias("vector")).join(self.read().select("key"), "key", "left_anti")
        folder = uuid.uuid4().hex
        new.write.parquet(f"{self.path}/data/{folder}")
        n = self.spark.read.parquet(f"{self.path}/data/{folder}").count()
        self._commit(folder, n)
        return n

    def _commit(self, folder: str, n: int) -> None:
        number = len(self._names("manifest"))
        while not self._put(f"manifest/{number:08}.json", {"folder": folder, "n": n}):
            number += 1

    def orphans(self) -> list[str]:
        """Data folders of appends that did not get into the manifest, or are still being written."""
        known = {e["folder"] for e in self.entries()}
        return [name for name in self._names("data") if name not in known]

    def truncate(self) -> int:
        """Remove what dead writers left, when no writer is at work; how many folders."""
        gone = self.orphans()
        for name in gone:
            self.fs.delete(self._at(f"data/{name}"), True)
        self.fs.delete(self._at("_parts"), True)
        return len(gone)

    def lookup(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """``texts`` with a column ``vector``; null where the store has none. Repeated texts stay."""
        keyed = texts.withColumn("__key", self.key(F.col(text)))
        return keyed.join(self.read().withColumnRenamed("key", "__key"), "__key", "left").drop("__key")
