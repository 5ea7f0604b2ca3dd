"""Files by a commit protocol, and arrivals that are read once."""

import os

import pytest
from pyspark.sql import functions as F

from folio.sources.files import STAGING, Arrivals, NamedFilesWriter, arrivals, open_pages, part_files, registered, write_files

PAGES, GROUPS = "doc_id string, page_no int, content binary", "doc_id string, letter string, page_no int"


def files_of(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir() if p.name != STAGING} if folder.exists() else {}


def test_page_groups_become_named_files(spark, tmp_path):
    pages = spark.createDataFrame([("d", k, b"<%d>" % k) for k in range(1, 6)] + [("e", 1, b"e"), ("e", 2, None)], PAGES)
    groups = spark.createDataFrame([("d", "A", 5), ("d", "A", 1), ("d", "B", 3), ("e", "A", 1), ("e", "A", 2)], GROUPS)
    files = part_files(pages, groups, F.concat(F.lit("scan-"), "doc_id"))
    write_files(spark, files.repartition(3), str(tmp_path / "out"))
    assert files_of(tmp_path / "out") == {"scan-d_A.pdf": b"<1><5>", "scan-d_B.pdf": b"<3>", "scan-e_A.pdf": b"e"}
    with pytest.raises(Exception, match="page 9 of d isn't there"):
        part_files(pages, spark.createDataFrame([("d", "A", 9)], GROUPS), F.col("doc_id")).collect()


def test_a_failed_write_leaves_nothing_and_nothing_is_written_over(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.range(40).select(F.concat(F.lit("f"), "id", F.lit(".pdf")).alias("name"), F.lit(b"new").alias("content"))
    failing = rows.repartition(4).withColumn("content", F.when(F.col("name") == "f39.pdf", F.raise_error(F.lit("no page")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no page"):
        write_files(spark, failing, str(out))
    assert files_of(out) == {}
    out.mkdir(exist_ok=True)
    (out / "f7.pdf").write_bytes(b"old")
    with pytest.raises(Exception, match="written over"):
        write_files(spark, rows.repartition(4), str(out))
    assert files_of(out) == {"f7.pdf": b"old"}
    with pytest.raises(Exception, match="share a name"):
        write_files(spark, rows.limit(1).union(rows.limit(1)), str(tmp_path / "twice"))
    assert files_of(tmp_path / "twice") == {}
    with pytest.raises(Exception, match="no file name"):
        write_files(spark, rows.limit(1).withColumn("name", F.lit("../x")), str(tmp_path / "path"))
    write_files(spark, rows.where("name <> 'f7.pdf'"), str(out))
    assert len(files_of(out)) == 40


def test_a_commit_that_fails_half_way_takes_back_what_it_moved(tmp_path):
    class Row:
        def __init__(self, name):
            self.name, self.content = name, b"x"

    writer = NamedFilesWriter(str(tmp_path))
    message = writer.write(iter([Row("a"), Row("b")]))
    (tmp_path / "b").write_bytes(b"came meanwhile")
    with pytest.raises(FileExistsError):
        writer.commit([message, None])
    assert files_of(tmp_path) == {"b": b"came meanwhile"}


def take(spark, tmp_path):
    stream = registered(arrivals(spark, str(tmp_path / "in"), str(tmp_path / "log"), files=2)).select("doc_id", "file", F.length("content").alias("n"))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start().awaitTermination()
    return sorted((r.file, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_arrivals_are_read_once_over_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("b.pdf", "a.PDF", "notes.txt", ".hidden.pdf"):
        (tmp_path / "in" / name).write_bytes(name.encode())
    assert take(spark, tmp_path) == [("a.PDF", 5), ("b.pdf", 5)]
    assert take(spark, tmp_path) == [("a.PDF", 5), ("b.pdf", 5)]
    old = tmp_path / "in" / "0.pdf"
    old.write_bytes(b"0")
    os.utime(old, (1, 1))  # older than all that was read
    assert take(spark, tmp_path) == [("0.pdf", 1), ("a.PDF", 5), ("b.pdf", 5)]


def test_what_is_no_pdf_has_a_problem(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_bytes(b"x")
    reader = Arrivals({"path": str(tmp_path / "in"), "log": str(tmp_path / "log")}).streamReader(None)
    end = reader.latestOffset()
    assert [tuple(r) for p in reader.partitions(reader.initialOffset(), end) for r in reader.read(p)] == [("x.txt", None, "only PDF files")]
    (tmp_path / "in" / "gone.pdf").write_bytes(b"y")
    later = reader.latestOffset()
    (tmp_path / "in" / "gone.pdf").unlink()
    assert [r[2] for p in reader.partitions(end, later) for r in reader.read(p)] == ["can't be opened: FileNotFoundError"]


def test_every_page_is_open_at_first(spark):
    got = open_pages(spark.createDataFrame([("a", 2), ("b", 0), ("c", None)], "doc_id string, n_pages int")).collect()
    assert sorted(tuple(r) for r in got) == [("a", 1, "?"), ("a", 2, "?")]
