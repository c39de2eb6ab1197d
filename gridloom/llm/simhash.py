"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distance, components.

A fingerprint has 64 bits; pairs at distance 3 or less agree in at least two of five blocks, so
each distinct fingerprint is dealt to ten buckets of some 26 agreeing bits. A bucket's pairs are
verified in place and only a spanning forest of its links leaves the task, never all pairs. A
bucket of more than ``bucket_rows`` fingerprints is not compared: its members are dealt again by
four blocks of the bits not yet fixed (three differing bits leave one block alone), until it is
small or until at most three bits are free, when all members are linked by construction. No link
is lost that way.

Nulls count as empty texts; an empty text has fingerprint zero and is linked like any other.
Repeated rows keep their own output rows; rows without an id
take part, but give no component their id. Columns other than the id and the text are ignored.
An empty table gives an empty result. A text of any length is held once with its words. Of equal
ids in a component any is the least.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm._common import bounded_batches, may_meet, stored, table, unused
from gridloom.llm.components import connected_components

DISTANCE = 3
_PIECE = 1 << 15


def fingerprint(text: bytes, words_a_shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of UTF-8 bytes; votes are summed piecewise, so memory is bounded by the text."""
    digest = xxhash.xxh64_intdigest
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < words_a_shingle:
        return digest(b" ".join(words), seed)
    votes, n = np.zeros(64, np.int64), len(words) - words_a_shingle + 1
    for at in range(0, n, _PIECE):
        part = words[at : min(at + _PIECE, n) + words_a_shingle - 1]
        h = np.array([digest(b" ".join(s), seed) for s in zip(*(part[i:] for i in range(words_a_shingle)))], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.array([fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in batch.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per input row, the fingerprint as a signed 64-bit integer."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(_fingerprints, "id bigint, fp bigint")


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(bits, dtype=np.int64), n) if len(x)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def first_masks(distance: int = DISTANCE) -> list[int]:
    blocks = _blocks(list(range(64)), distance + 2)
    return [_signed(_mask(x) | _mask(y)) for x, y in combinations(blocks, 2)]


class _Forest:
    """Union-find over the rows of one piece, labels kept flat."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        kept = []
        while len(i):
            differ = self.label[i] != self.label[j]
            i, j = i[differ], j[differ]
            if not len(i):
                break
            a, b = int(i[0]), int(j[0])
            kept.append((a, b))
            x, y = sorted((self.label[a], self.label[b]))
            self.label[self.label == y] = x
            i, j = i[1:], j[1:]
        return kept


def _link(key: np.ndarray, fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within each run of equal keys."""
    forest, out, step = _Forest(len(key)), [], 1
    at = np.arange(len(key) - 1)
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        near = at[np.bitwise_count((fp[at] ^ fp[at + step]).view(np.uint64)) <= distance]
        out += forest.add(near, near + step)
        step += 1
    return [(int(fp[a]), int(fp[b])) for a, b in out]


def _linker(bucket_rows: int, distance: int):
    """Over rows (key, mask, fp) sorted by key, mask: rows (a, b, null) for links, (null, fp, mask) to deal again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        rest, hot = (empty, empty, empty), None

        def out(links, again=()):
            a = [x for x, _ in links] + [None] * len(again)
            b = [y for _, y in links] + [f for _, f in again]
            m = [None] * len(links) + [x for x, _ in again]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(m, pa.int64())], names=["a", "b", "mask"])

        def deal(mask, fps):
            free = [i for i in range(64) if not (mask >> i) & 1]
            if len(free) <= distance:
                return [(hot[2], int(f)) for f in fps if int(f) != hot[2]], []
            finer = [_signed((mask | _mask(b)) & (1 << 64) - 1) for b in _blocks(free, distance + 1)]
            return [], [(m, int(f)) for f in fps for m in finer]

        for batch in batches:
            key, mask, fp = (np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns))
            if hot:
                n = int(np.searchsorted((key != hot[0]) | (mask != hot[1]), True))
                if n:
                    yield out(*deal(hot[1] & (1 << 64) - 1, fp[:n]))
                key, mask, fp = key[n:], mask[n:], fp[n:]
                hot = hot if not len(key) else None
            if not len(key):
                rest = (empty, empty, empty)
                continue
            last = int(np.searchsorted(key, key[-1]))
            if len(key) - last > bucket_rows and (mask[last:] == mask[-1]).all():
                hot = (key[-1], int(mask[-1]), int(fp[last]))
                yield out(*deal(hot[1] & (1 << 64) - 1, fp[last:]))
                rest = (empty, empty, empty)
            else:
                rest = (key[last:], mask[last:], fp[last:])
            if links := _link(key[:last], fp[:last], distance):
                yield out(links)
        if len(rest[0]) and (links := _link(rest[0], rest[2], distance)):
            yield out(links)

    return run


def links(distinct: DataFrame, distance: int = DISTANCE, bucket_rows: int = 4096) -> DataFrame:
    """(a, b): links among distinct fingerprints that join the same fingerprints as all pairs at
    the distance or less would. distinct: column fp."""
    dealt = distinct.select(F.explode(F.array(*(F.lit(m).cast("bigint") for m in first_masks(distance)))).alias("mask"), "fp")
    found = None
    while True:
        keyed = dealt.select(F.xxhash64("mask", F.col("mask").bitwiseAND(F.col("fp"))).alias("key"), "mask", "fp")
        out = stored(keyed.repartition("key").sortWithinPartitions("key", "mask").mapInArrow(_linker(bucket_rows, distance), "a bigint, b bigint, mask bigint"), "links")
        new = out.where("a is not null").select("a", "b")
        found = new if found is None else found.unionByName(new)
        dealt = out.where("a is null").select("mask", F.col("b").alias("fp")).distinct()
        if out.where("a is null").limit(1).count() == 0:
            return found


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(id, fp, component, component_id) of every row; component names the component by its least
    fingerprint (signed), component_id is the least id reachable over links."""
    marked = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("id").alias("first_id"))
    groups = connected_components(links(distinct.select("fp"), distance))
    classes = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = classes.select("fp", "component").join(least, "component").select("fp", "component", "component_id")
    return marked.join(named, "fp").select("id", "fp", "component", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component: the one with the least id. Where rows with that id differ,
    each component keeps of its own the one of least fingerprint, text and other columns; rows without
    an id can't be told apart and stay. Texts whose id meets none that is dropped or repeated by a bit
    map of fixed size stay without a shuffle; the keys that stay are joined back to the others. Rows of
    repeated ids alone are fingerprinted again."""
    bounded_batches(spark)
    found = stored(components(docs).where("id is not null").select(F.col("id").alias("doc_id"), "fp", "component", (F.col("id") == F.col("component_id")).alias("least")), "found")
    ids = stored(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("least").alias("least")), "ids")
    keep = ids.where("least").select("doc_id", "n")
    (may,) = unused(docs, "near_may")
    marked = may_meet(docs, ids.where("not least or n > 1"), "doc_id", may)
    all_columns = [f"`{c}`" for c in docs.columns]
    rest = marked.where(F.col(may)).select(*all_columns)
    kept = rest.join(keep.where("n = 1"), "doc_id", "left_semi").select(*all_columns)
    out = marked.where(~F.col(may) | F.col("doc_id").isNull()).select(*all_columns).unionByName(kept)
    if keep.where("n > 1").limit(1).count() == 0:
        return out
    shown = docs.columns
    fp, of, rank = unused(docs, "near_fp", "near_of", "near_rank")
    again = rest.join(keep.where("n > 1"), "doc_id", "left_semi").select(*(f"`{c}`" for c in shown)).distinct()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shown.index("text")
        for batch in batches:
            made = [fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in batch.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(made, np.uint64).view(np.int64))], names=[*shown, fp])

    marked = again.mapInArrow(mark, T.StructType([*again.schema.fields, T.StructField(fp, T.LongType())]))
    first = found.where("least").join(keep.where("n > 1"), "doc_id", "left_semi").groupBy("doc_id", "component").agg(F.min("fp").alias("fp"))
    chosen = first.select(F.col("doc_id").alias(of), F.col("fp").alias(rank))
    met = marked.join(chosen, (F.col("doc_id") == F.col(of)) & (F.col(fp) == F.col(rank)), "left_semi")
    order = Window.partitionBy("doc_id", fp).orderBy("text", *(F.col(f"`{c}`").cast("string") for c in shown if c not in ("doc_id", "text")))
    one = met.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*(f"`{c}`" for c in shown))
    return out.unionByName(one)
