"""Files in and out by Spark's data source interface: arrivals as a stream, and parts of documents as named files.

Paths are those of ``pyarrow.fs`` (a plain path, or a URI of a store that it knows), and the folder must be one that all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

STAGING = "_staging"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(path)
    return store, root.rstrip("/")


def _there(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != fs.FileType.NotFound


# ---- parts of documents as files -------------------------------------------------------------


@dataclass
class Staged(WriterCommitMessage):
    names: list[tuple[str, str]]


class NamedFilesWriter(DataSourceWriter):
    """Rows (name, content) as files of a folder: all of them or none, and never over one that is there.

    A task writes to a staging folder of the run; only when every task has ended well the files are moved to their names. A name that
    stands already, that two rows share, or that leads out of the folder ends the write, and an ended write leaves no file. (A task that Spark is
    still ending when the write is taken back may leave staged bytes, in the staging folder alone; no other run reads them.)
    """

    def __init__(self, path: str) -> None:
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Staged:
        (store, root), names = _opened(self.path), []
        folder = f"{root}/{STAGING}/{self.run}"
        for row in rows:
            if not row.name or "/" in row.name or row.name in (".", "..", STAGING):
                raise ValueError(f"no file name: {row.name!r}")
            if _there(store, f"{root}/{row.name}"):
                raise FileExistsError(f"it stands already and isn't written over: {row.name}")
            store.create_dir(folder, recursive=True)
            staged = f"{folder}/{uuid.uuid4().hex}"  # an attempt that was lost leaves its own, which nobody names
            with store.open_output_stream(staged) as out:
                out.write(bytes(row.content or b""))
            names.append((staged, row.name))
        return Staged(names)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = _opened(self.path)
        files, moved = [x for m in messages if m for x in m.names], []
        try:
            if len({name for _, name in files}) < len(files):
                raise FileExistsError("two rows share a name")
            for staged, name in files:
                if _there(store, f"{root}/{name}"):
                    raise FileExistsError(f"it stands already and isn't written over: {name}")
                store.move(staged, f"{root}/{name}")
                moved.append(name)
        except Exception:
            for name in moved:
                store.delete_file(f"{root}/{name}")
            raise
        finally:
            self._clear(store, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if _there(store, f"{root}/{STAGING}/{self.run}"):
            store.delete_dir(f"{root}/{STAGING}/{self.run}")
        if _there(store, f"{root}/{STAGING}") and not store.get_file_info(fs.FileSelector(f"{root}/{STAGING}")):
            store.delete_dir(f"{root}/{STAGING}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"])


def part_files(pages: DataFrame, groups: DataFrame, stem: Column) -> DataFrame:
    """(name, content): for each letter of a document its pages' bytes in page order, in a file ``stem_letter.pdf``.

    pages has doc_id, page_no and content, groups doc_id, letter and page_no; the pages of a letter needn't be neighbours. stem is a column of groups. A letter without
    pages gives no file; a page that the document doesn't have is an error.
    """
    rows = groups.withColumn("_stem", stem).join(pages.withColumn("_there", F.lit(True)), ["doc_id", "page_no"], "left")
    missing = F.raise_error(F.format_string("page %s of %s isn't there", F.col("page_no").cast("string"), F.col("doc_id").cast("string")))
    content = F.when(F.col("_there"), F.coalesce("content", F.lit(b""))).otherwise(missing)
    listed = F.array_sort(F.collect_list(F.struct("page_no", content.alias("content"))))
    joined = F.aggregate(listed, F.lit(b""), lambda a, x: F.concat(a, x["content"]))
    return rows.groupBy("doc_id", "letter", "_stem").agg(joined.alias("content")).select(F.concat("_stem", F.lit("_"), "letter", F.lit(".pdf")).alias("name"), "content")


def write_files(spark: SparkSession, files: DataFrame, folder: str) -> None:
    """Write (name, content) as files of a folder, all or none."""
    spark.dataSource.register(NamedFiles)
    files.select("name", "content").write.format("named_files").mode("append").save(folder)


# ---- arrivals --------------------------------------------------------------------------------


@dataclass
class Arrived(InputPartition):
    paths: list[str]


class ArrivalsReader(DataSourceStreamReader):
    """Files of a folder in the order in which they were first seen.

    What was seen is noted in numbered files of the folder ``log``, so an offset is how many files were noted so far, and it leads to the same files after a restart, however old
    a file is that was moved there later. Names are kept, not contents; a file counts by its name, once.
    """

    def __init__(self, path: str, log: str, files: int) -> None:
        self.path, self.log, self.files = path, log, files

    def _noted(self) -> list[str]:
        store, root = _opened(self.log)
        if not _there(store, root):
            return []
        notes = sorted((i.path for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".json")), key=lambda p: int(p.rsplit("/", 1)[1][:-5]))
        names = []
        for note in notes:
            with store.open_input_stream(note) as f:
                names += json.loads(f.read())
        return names

    def initialOffset(self) -> dict:
        return {"seen": 0}

    def latestOffset(self) -> dict:
        (store, root), (notes, log), noted = _opened(self.path), _opened(self.log), self._noted()
        known = set(noted)
        found = [i.base_name for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and i.base_name[0] not in "._"]
        new = sorted(n for n in found if n not in known)
        if new:
            notes.create_dir(log, recursive=True)
            aside = f"{log}/.{uuid.uuid4().hex}"
            with notes.open_output_stream(aside) as f:
                f.write(json.dumps(new).encode())
            notes.move(aside, f"{log}/{len(noted)}.json")
        return {"seen": len(noted) + len(new)}

    def partitions(self, start: dict, end: dict) -> list[Arrived]:
        names = self._noted()[start["seen"] : end["seen"]]
        return [Arrived(names[k : k + self.files]) for k in range(0, len(names), self.files)]

    def read(self, partition: Arrived) -> Iterator[tuple]:
        store, root = _opened(self.path)
        for name in partition.paths:
            if not name.lower().endswith(".pdf"):
                yield name, None, "only PDF files"
                continue
            try:
                with store.open_input_stream(f"{root}/{name}") as f:
                    yield name, f.read(), ""
            except OSError as e:
                yield name, None, f"can't be opened: {type(e).__name__}"

    def commit(self, end: dict) -> None:
        pass


class Arrivals(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrivals"

    def schema(self) -> str:
        return "file_name string, content binary, problem string"

    def streamReader(self, schema: StructType) -> ArrivalsReader:
        return ArrivalsReader(self.options["path"], self.options["log"], int(self.options.get("filesperpartition", "100")))


def arrivals(spark: SparkSession, folder: str, log: str, files: int = 100) -> DataFrame:
    """A stream (file_name, content, problem) of the files that arrive in a folder; what isn't a PDF or can't be opened has a problem and no content."""
    spark.dataSource.register(Arrivals)
    return spark.readStream.format("arrivals").option("log", log).option("filesPerPartition", files).load(folder)


def registered(files: DataFrame) -> DataFrame:
    """Arrived files as queued documents: doc_id (a hash of name and bytes), file, state and version; those with a problem are left out."""
    good = files.where("problem = ''")
    return good.select(F.sha2(F.concat(F.col("file_name").cast("binary"), F.lit(b"\0"), "content"), 256).alias("doc_id"), F.col("file_name").alias("file"), F.lit("queued").alias("state"), F.lit("").alias("bucket"), F.lit(1).alias("version"), "content")


def open_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, page_no, letter) of each page of documents (doc_id, n_pages), all of them open."""
    return documents.where("n_pages > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n_pages").cast("int"))).alias("page_no"), F.lit("?").alias("letter"))
