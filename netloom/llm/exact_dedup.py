"""Exact copies through a sharded cuckoo-filter index of live digests (Fan et al., 2014).

A document's key is the SHA-256 of its text with A-Z in lower case. Keys are spread over shards by
hash. A shard holds a cuckoo filter of 16-bit fingerprints and the full keys in buckets: a miss in
the filter proves a key new, a hit is held against the bucket's keys. When an insertion finds no
place, the filter is built anew, twice as large, from the stored keys.
"""

from __future__ import annotations

import hashlib
import math
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import cut, spread_join, with_fields

KEYS_PER_SHARD = 50_000
SLOTS = 4
KICKS = 200
#: Rows of one key are first counted in this many slices, so that no task meets all of them.
SLICES = 16

ENTRY = "shard int, digest binary, n_bytes long, keep_id long, keep_row long, group_size long, filter binary"


class CuckooFilter:
    """Fingerprints of keys in ``n_buckets`` (a power of two) buckets of four."""

    def __init__(self, n_buckets: int = 64, cells: bytes | None = None):
        self.mask = n_buckets - 1
        self.cells = array("H", cells if cells is not None else bytes(2 * SLOTS * n_buckets))

    def places(self, key: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & self.mask
        return print_, first, self._other(first, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return bucket ^ (print_ * 0x5BD1E995 & self.mask)

    def has(self, key: bytes) -> bool:
        print_, a, b = self.places(key)
        return print_ in self.cells[a * SLOTS : a * SLOTS + SLOTS] or print_ in self.cells[b * SLOTS : b * SLOTS + SLOTS]

    def _swap(self, bucket: int, old: int, new: int) -> bool:
        for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if self.cells[at] == old:
                self.cells[at] = new
                return True
        return False

    def add(self, key: bytes) -> bool:
        """False if no place was found; a fingerprint is then without a home and the filter must be rebuilt."""
        print_, a, b = self.places(key)
        if self._swap(a, 0, print_) or self._swap(b, 0, print_):
            return True
        bucket = a
        for kick in range(KICKS):
            at = bucket * SLOTS + kick % SLOTS
            print_, self.cells[at] = self.cells[at], print_
            bucket = self._other(bucket, print_)
            if self._swap(bucket, 0, print_):
                return True
        return False

    def remove(self, key: bytes) -> bool:
        """Only for keys known to be in the filter."""
        print_, a, b = self.places(key)
        return self._swap(a, print_, 0) or self._swap(b, print_, 0)


class Shard:
    """A filter and, by bucket, the keys it stands for with their values."""

    def __init__(self, cells: bytes | None = None):
        self.filter = CuckooFilter(len(cells) // (2 * SLOTS), cells) if cells else CuckooFilter()
        self.content: dict[int, dict[bytes, list]] = {}
        self.n_keys = 0

    def bucket(self, key: bytes) -> dict[bytes, list]:
        return self.content.setdefault(self.filter.places(key)[1], {})

    def find(self, key: bytes) -> list | None:
        return self.bucket(key).get(key) if self.filter.has(key) else None

    def restore(self, key: bytes, value: list) -> None:
        self.bucket(key)[key] = value
        self.n_keys += 1

    def insert(self, key: bytes, value: list) -> None:
        if not self.filter.add(key):
            self._grow(key)
        self.restore(key, value)

    def delete(self, key: bytes) -> bool:
        if self.find(key) is None:
            return False
        self.filter.remove(key)
        del self.bucket(key)[key]
        self.n_keys -= 1
        return True

    def entries(self):
        return ((key, value) for bucket in self.content.values() for key, value in bucket.items())

    def _grow(self, extra: bytes) -> None:
        held = list(self.entries())
        size = self.filter.mask + 1
        while True:
            size *= 2
            self.filter = CuckooFilter(size)
            if all(self.filter.add(key) for key, _ in held) and self.filter.add(extra):
                break
        self.content, self.n_keys = {}, 0
        for key, value in held:
            self.restore(key, value)


def _lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()  # bytes.lower() touches A-Z only


def digests(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``digest`` and ``n_bytes`` of the normalised text; null counts as empty."""
    own = docs.drop("digest", "n_bytes")
    schema = with_fields(own.schema, "digest binary, n_bytes long")

    def run(batches):
        for batch in batches:
            texts = [_lowered(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()),
                    pa.array([len(x) for x in texts], pa.int64()),
                ],
                names=[*batch.schema.names, "digest", "n_bytes"],
            )

    return own.mapInArrow(run, schema)


def _shard(n_shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n_shards)).cast("int").alias("shard")


def insertions(keyed: DataFrame, n_shards: int) -> DataFrame:
    """Changes that insert the rows of ``keyed`` (digest, n_bytes, doc_id, _row), counted per slice of a key."""
    return (
        keyed.groupBy("digest", "n_bytes", F.pmod(F.xxhash64("_row"), F.lit(SLICES)).alias("_slice"))
        .agg(F.max(F.struct("doc_id", "_row")).alias("_last"), F.count("*").alias("group_size"))
        .select(
            _shard(n_shards), F.lit("+").alias("op"), "digest", "n_bytes",
            F.col("_last.doc_id").alias("keep_id"), F.col("_last._row").alias("keep_row"), "group_size",
        )
    )


def deletions(keyed: DataFrame, n_shards: int) -> DataFrame:
    """Changes that delete the digests in ``keyed``, whole groups at a time."""
    gone = keyed.select("digest", "n_bytes").distinct()
    none = F.lit(None).cast("long")
    return gone.select(
        _shard(n_shards), F.lit("-").alias("op"), "digest", "n_bytes",
        none.alias("keep_id"), none.alias("keep_row"), none.alias("group_size"),
    )


def _later(a: tuple, b: tuple) -> tuple:
    """The larger (doc_id, row); a null id is the smallest."""
    return max(a, b, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def _update(entries: pa.Table, changes: pa.Table) -> pa.Table:
    held = entries.to_pylist()
    shard = Shard(next((x["filter"] for x in held if x["digest"] is None), None))
    for x in held:
        if x["digest"] is not None:
            shard.restore(x["digest"], [x["n_bytes"], (x["keep_id"], x["keep_row"]), x["group_size"]])
    # deletions first: what is deleted and inserted in one batch is live afterwards
    for x in sorted(changes.to_pylist(), key=lambda x: x["op"] == "+"):
        found = shard.find(x["digest"])
        if x["op"] == "-":
            shard.delete(x["digest"])
        elif found is None:
            shard.insert(x["digest"], [x["n_bytes"], (x["keep_id"], x["keep_row"]), x["group_size"]])
        else:
            found[1] = _later(found[1], (x["keep_id"], x["keep_row"]))
            found[2] += x["group_size"]
    number = (held or changes.slice(0, 1).to_pylist())[0]["shard"]
    rows = [(number, key, size, *last, n, None) for key, (size, last, n) in shard.entries()]
    rows.append((number, None, None, None, None, None, shard.filter.cells.tobytes()))
    kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in ENTRY.split(", ")]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def empty_index(spark) -> DataFrame:
    return spark.createDataFrame([], ENTRY)


def apply_changes(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The index after ``changes``: one row per live digest and one with the filter of each shard.

    Written out, the result is the index of the next call; the number of shards must stay the same.
    """
    return index.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_update, ENTRY)


def shards_for(rows: int) -> int:
    return max(1, math.ceil(rows / KEYS_PER_SHARD))


def decide(keyed: DataFrame) -> DataFrame:
    """Every row of a written table (doc_id, digest, n_bytes, _row) with its group and whether it stays."""
    changes = insertions(keyed, shards_for(keyed.count()))
    index = cut(apply_changes(empty_index(keyed.sparkSession), changes))
    groups = index.where("digest is not null").select("digest", "keep_id", "keep_row", "group_size")
    return spread_join(keyed, groups, "digest", "group_size").withColumn("kept", F.expr("_row = keep_row"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``.

    Of equal texts the row with the largest doc_id stays; null ids are smaller than all others.
    Of repeated rows, equal in id and text, one stays. An empty table gives no rows. Other columns
    of the input are not looked at.
    """
    keyed = cut(digests(docs.select("doc_id", "text")).drop("text").withColumn("_row", F.monotonically_increasing_id()))
    return decide(keyed).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns unchanged."""
    numbered = cut(digests(docs.select(F.struct(*docs.columns).alias("_all"), "doc_id", "text")).drop("text").withColumn("_row", F.monotonically_increasing_id()))
    gone = decide(numbered.drop("_all")).where("not kept").select("_row")
    return numbered.join(gone, "_row", "left_anti").select("_all.*")
