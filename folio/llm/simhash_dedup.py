"""SimHash near-duplicates through tables of distances to reference fingerprints.

Two fingerprints link if they differ in at most two of their 64 bits. The references
(pivots) are the zero fingerprint and, for each block of two neighbouring bits, the
fingerprint that has just that block set. By the triangle inequality the distances of
linked fingerprints to any pivot differ by at most two. The distances to the zero pivot
and to a block's pivot also give the number of bits set in the block, a coordinate that
two differing bits can change in at most two blocks. So of six groups of coordinates at
least four are equal for linked fingerprints: each fingerprint takes the 15 choices of
four groups as keys, pairs that share a key are compared by the largest difference of
their pivot distances, and those left are verified bit by bit.

A key with more than ``BUCKET`` fingerprints isn't paired up. Its members link through
the fingerprints one bit away instead: two fingerprints differ in at most two bits if
and only if they have a neighbour within one bit in common. That takes 65 rows for each
member, in groups of 65 at most, and loses no link.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import materialize, small_batches

SHINGLE, SEED, BUCKET = 3, 42, 32
BLOCKS = 32
#: First and number of blocks of each group of coordinates.
GROUPS = [(0, 6), (6, 6), (12, 5), (17, 5), (22, 5), (27, 5)]
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def majority(digests: np.ndarray) -> int:
    """Bits set in over half of the digests, rows of eight bytes; none for no rows."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(digests), 250):  # sums of up to 250 bits fit a byte
        counts += np.unpackbits(digests[at : at + 250], axis=1).sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > len(digests)).tobytes(), "big")


def fingerprint(text: bytes) -> int:
    """SimHash of one UTF-8 text: bits set in over half of its shingles' hashes."""
    words = text.translate(_LOWER).split()
    n = len(words) - SHINGLE + 1
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    digest, join = xxhash.xxh64_digest, b" ".join
    hashes = b"".join([digest(join(x), SEED) for x in zip(words, words[1:], words[2:])])
    return majority(np.frombuffer(hashes, np.uint8).reshape(n, 8))


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        found = np.array([fingerprint(x.as_py() or b"") for x in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])


def simhashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each text as a signed long; null and empty texts have 0."""
    return small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints, "id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


PIVOTS = [0, *(_signed(3 << (2 * b)) for b in range(BLOCKS))]
#: What turns a fingerprint into itself and those one bit away.
NEAR = [0, *(_signed(1 << b) for b in range(64))]


def _distances(fp):
    """Hamming distances to the pivots, as an array."""
    return F.transform(F.array(*map(F.lit, PIVOTS)), lambda p: F.bit_count(fp.bitwiseXOR(p)).cast("byte"))


def links(fps: DataFrame) -> DataFrame:
    """Linked pairs (u, v) of the distinct fingerprints in column fp, enough of them that whatever is linked is connected."""
    # A row becomes 15 keys and 33 distances, so the few MB of fingerprints are spread over all tasks first.
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), fps.sparkSession.sparkContext.defaultParallelism)
    table = fps.repartition(tasks).select("fp", _distances(F.col("fp")).alias("d"))
    coordinates = F.transform(F.slice("d", 2, BLOCKS), lambda x: F.col("d")[0] - x)
    groups = F.array(*(F.xxhash64(F.slice("c", first + 1, n)) for first, n in GROUPS))
    keys = F.array(*(F.xxhash64(F.lit(k), *(F.col("g")[g] for g in chosen)) for k, chosen in enumerate(combinations(range(6), 4))))
    keyed = table.select("fp", coordinates.alias("c")).select("fp", groups.alias("g")).select("fp", F.explode(keys).alias("key"))
    keyed = materialize(keyed)
    keyed = materialize(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    small, large = keyed.where(F.col("n") <= BUCKET), keyed.where(F.col("n") > BUCKET).select("fp").distinct()
    x, y = small.select("key", F.col("fp").alias("u")), small.select("key", F.col("fp").alias("v"))
    far = F.greatest(*(F.abs(F.bit_count(F.col("u").bitwiseXOR(F.lit(p))) - F.bit_count(F.col("v").bitwiseXOR(F.lit(p)))) for p in PIVOTS))
    pairs = x.join(y, "key").where("u < v").where(far <= 2).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2).select("u", "v")
    near = F.transform(F.array(*map(F.lit, NEAR)), lambda bit: F.col("fp").bitwiseXOR(bit))
    star = large.select("fp", F.explode(near).alias("near")).withColumn("u", F.min("fp").over(Window.partitionBy("near"))).where("u < fp").select("u", F.col("fp").alias("v"))
    return pairs.unionByName(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v); root is the least node of its component.

    Rounds of large and small stars: each round hangs neighbours on the least one, and
    the number of rounds grows with the logarithm of the longest path.
    """
    edges, before = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
        around = edges.union(edges.select("v", "u"))  # u > v in all edges, so none comes twice
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "v")
        large = edges.join(least, "v").select("u", F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id, the least id linked through any chain.

    Texts without words, null ones too, have fingerprint zero and link like others; texts of one or two
    words are one shingle; texts of any length are read whole. Rows with a null id take part and are returned; their
    component_id is null if no row of their group has an id. Rows that
    repeat an id come back as often, each with the group of its own text. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    found = materialize(simhashes(docs, id_col, text_col))
    classes = materialize(found.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(classes.select("fp"))).withColumnRenamed("node", "fp")
    classes = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    members = classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return found.join(members, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
