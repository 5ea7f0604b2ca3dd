"""State as numbered snapshots: several tables that change together or not at all.

A snapshot's tables lie in ``number=N``, a folder that nobody reads before the manifest ``manifests/N.json`` stands; the manifest is
written last, in one step, and never over another one. A run that is killed between two tables leaves a folder without a
manifest, which the next run writes over; readers always get the last whole snapshot. Of two runs that write one number, the second one fails at its manifest.

The JSON side reads and writes the state as three files of one object each, as archives without Spark keep it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The tables of the state, and the files and names that hold them as JSON.
SCHEMAS = {
    "processed": "hash string, source string, target string",
    "pending": "file string, suggestion string, national_id string, registry_no string, source string",
    "person_index": "key string, name string, national_id string, registry_no string",
}
FILES = {"processed": ".islenmis_hashler.json", "pending": "dogrulanmali.json", "person_index": "person_data.json"}
NAMES = {"source": "kaynak", "target": "hedef", "suggestion": "isim", "name": "isim", "national_id": "tc_no", "registry_no": "sicil_no"}


class SnapshotExists(Exception):
    """Another run wrote this number first."""


class Snapshots:
    """Snapshots below ``path``, in any store that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Of whole snapshots, ascending."""
        folder, files = self._files(f"{self.path}/manifests")
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdecimal())

    def save(self, tables: dict[str, DataFrame], number: int | None = None) -> int:
        """Write the tables as one snapshot and return its number, by default the next one.

        The tables may read an earlier snapshot: that one isn't touched.
        """
        number = (self.numbers() or [0])[-1] + 1 if number is None else number
        if number in self.numbers():
            raise SnapshotExists(f"snapshot {number} stands already: {self.path}")
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/number={number}/{name}")  # what a killed run left goes
        self._commit(number, {name: df.schema.jsonValue() for name, df in tables.items()})
        return number

    def _commit(self, number: int, schemas: dict) -> None:
        """The manifest is written aside and then renamed, which fails if it stands."""
        jvm = self.spark._jvm
        target, files = self._files(f"{self.path}/manifests/{number}.json")
        aside, _ = self._files(f"{self.path}/manifests/.{number}-{jvm.java.util.UUID.randomUUID()}")
        out = files.create(aside, False)
        try:
            out.write(bytearray(json.dumps({"number": number, "tables": schemas}).encode()))
        finally:
            out.close()
        if files.exists(target) or not files.rename(aside, target):
            files.delete(aside, False)
            raise SnapshotExists(f"snapshot {number} stands already: {self.path}")

    def load(self, number: int | None = None) -> dict[str, DataFrame]:
        """The tables of a whole snapshot, by default the last one; without any, empty tables of the state."""
        if number is None and not self.numbers():
            return {name: self.spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
        number = self.numbers()[-1] if number is None else number
        path, files = self._files(f"{self.path}/manifests/{number}.json")
        manifest = self.spark.read.text(path.toString(), wholetext=True).first()
        schemas = {name: StructType.fromJson(s) for name, s in json.loads(manifest[0])["tables"].items()}
        return {name: self.spark.read.schema(schema).parquet(f"{self.path}/number={number}/{name}") for name, schema in schemas.items()}

    def keep(self, last: int) -> None:
        """Delete all but the last whole snapshots: the manifest first, so that none is ever half there."""
        for number in self.numbers()[:-last] if last else self.numbers():
            for name in (f"manifests/{number}.json", f"number={number}"):
                path, files = self._files(f"{self.path}/{name}")
                files.delete(path, True)


def add_to(state: dict[str, DataFrame], added: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The state with what a run adds (``archive.state_after``): later rows of a hash or a queued file replace earlier ones; index rows are kept as they are."""

    def latest(name: str, key: str) -> DataFrame:
        new = added[name].select(*state[name].columns)
        return state[name].join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new.dropDuplicates([key]))

    index = state["person_index"]
    return {"processed": latest("processed", "hash"), "pending": latest("pending", "file"), "person_index": index.unionByName(added["person_index"].select(*index.columns))}


def used_names(files: DataFrame) -> DataFrame:
    """(name) of files (folder, file) that stand in the archive or in verification, which share one set of names; PDFs only."""
    there = files.where(F.col("folder").isin("archive", "verify") & F.col("file").endswith(".pdf"))
    return there.select(F.regexp_replace("file", r"\.pdf$", "").alias("name")).distinct()


def _named(schema: str, but: str) -> list[str]:
    return [c for c in StructType.fromDDL(schema).names if c != but]


def read_json_state(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three tables from their JSON files; a file that isn't there gives an empty table, a missing value an empty string."""
    out = {}
    for name, schema in SCHEMAS.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{FILES[name]}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            out[name] = spark.createDataFrame([], schema)
            continue
        key = StructType.fromDDL(schema).names[0]
        columns = _named(schema, key)
        entry = "struct<" + ", ".join(dict.fromkeys(f"{NAMES.get(c, c)}: string" for c in columns)) + ">"
        value = f"array<{entry}>" if name == "person_index" else entry
        # A name with a dot before it counts as hidden, so the file is read as bytes by its path.
        text = spark.createDataFrame([(_text(spark, path),)], "value string")
        rows = text.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias(key, "_x"))
        rows = rows.select(key, F.explode("_x").alias("_x")) if name == "person_index" else rows
        out[name] = rows.select(key, *(F.coalesce(F.col(f"_x.{NAMES.get(c, c)}"), F.lit("")).alias(c) for c in columns))
    return out


def _text(spark: SparkSession, path) -> str:
    """A JSON state file whole: one object can't be split."""
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def json_rows(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """For each table (key, entry): the key and its JSON value, in key order; the index has a list for each key."""

    def entry(name: str, key: str) -> Column:
        return F.struct(*(F.col(c).alias(NAMES.get(c, c)) for c in _named(SCHEMAS[name], key)))

    out = {}
    for name, df in tables.items():
        key = StructType.fromDDL(SCHEMAS[name]).names[0]
        own = F.array_sort(F.collect_list(entry(name, key))) if name == "person_index" else F.min(entry(name, key))
        out[name] = df.groupBy(F.col(key).alias("key")).agg(F.to_json(own).alias("entry")).orderBy("key")
    return out


def write_json_state(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as a JSON file of one object; entries are streamed to it one by one."""
    spark = next(iter(tables.values())).sparkSession
    for name, rows in json_rows(tables).items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{FILES[name]}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(b"{")
            for k, row in enumerate(rows.toLocalIterator()):
                out.write(bytearray(f"{',' * bool(k)}\n  {json.dumps(row.key, ensure_ascii=False)}: {row.entry}".encode()))
            out.write(b"\n}\n")
        finally:
            out.close()
