"""Substring dedup: paragraphs met by content, verified, clustered, and removed but for one copy.

Two kinds of paragraph are compared. *Lines* of any length that are equal are met by hash; those of
``SHINGLE`` words or more collide in MinHash bands over five-word shingles too (``BANDS`` x ``ROWS``: a
pair at Jaccard 0.8 is met with probability 0.995); colliding lines are verified by their exact Jaccard
similarity and clustered by connected components. *Windows* of ``WINDOW`` words catch passages inside longer text: of every run of
``WINDOW`` + 1 consecutive windows the one of least hash is chosen, so any passage of at least
2 * ``WINDOW`` words that repeats has a chosen window in common, wherever it stands. Chosen windows
are only seeds: around each that two documents share, at every place where it stands, all windows
within reach are compared. A repeated passage of 2 * ``WINDOW`` words or more has a seed within reach
of each of its windows, so all its words are found; a shorter one, if it has a seed.

Equal lines and windows collapse to one class by hash before anything is compared, so copies cost a
row each. A bucket with more than ``BUCKET`` different lines or ``BUCKET_WORDS`` words is cut into
blocks, and each pair of blocks is compared in a task of its own; a task emits a spanning forest of
the links it finds. No bucket is capped.

All paragraphs are compared, whatever their length; what is found counts as a repeated passage where
the paragraphs found in a text, overlapping or side by side, cover ``min_words`` words in a run, so
common short lines leave a document as it is.

The copy with the least document id stays. Only repeats across different document ids count. Words
are compared with A-Z lower-cased. Nulls count as empty texts; rows without an id take no part;
repeated rows of one id are copies of one document. The first text of the stage's result keeps all
it had. An empty table gives an empty result. A text of any length is read whole, in a slice of its
own. Ties can't arise: the copy is the least id. Other columns pass untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._common import WORD, bounded_batches, may_meet, stored, table, unused
from gridloom.llm._units import slices
from gridloom.llm.components import connected_components

SHINGLE, WINDOW, MIN_WORDS = 5, 25, 50
BANDS, ROWS, SIMILARITY, BUCKET, BUCKET_WORDS = 10, 4, 0.8, 2048, 1 << 18
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_SLICE = 1 << 20
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, _U), np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                p = np.full(size, b, _U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BASE), _Powers(_STEP)
_RANDOM = np.random.default_rng(7)
_A = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1)
_B = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _ranges(x: np.ndarray, powers: _Powers, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run x[start:end], equal for equal runs."""
    up, down = powers.upto(len(x))
    total = np.concatenate([np.zeros(1, _U), np.cumsum((x + _U(1)) * up[: len(x)], dtype=_U)])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


class Words:
    """The words of the texts of a slice: byte spans, hashes, their text and line."""

    def __init__(self, texts: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        inside = ~_IS_SPACE[data]
        edge = inside.copy()
        edge[1:] &= ~inside[:-1]
        begins = self.offsets[:-1][self.offsets[:-1] < len(data)]  # empty texts at the end begin nowhere
        edge[begins] = inside[begins]
        self.start = np.flatnonzero(edge)
        stop = np.zeros(len(data) + 1, bool)
        stop[1:] = inside
        stop[1:-1] &= ~inside[1:] | edge[1:]
        self.end = np.flatnonzero(stop)
        self.hash = _ranges(_LOWER[data].astype(_U), _BYTES, self.start, self.end)
        self.text = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, self.offsets[:-1])  # of each text
        self.n = np.diff(np.append(self.first, len(self.start)))
        # lines are numbered over the slice; a text begins a line
        line = np.cumsum(data == 10)
        self.line = (line[self.start] if len(data) else np.zeros(0, np.int64)) + self.text

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, last word + 1) of each line with a word."""
        new = np.flatnonzero(np.diff(self.line, prepend=-1))
        return new, np.append(new[1:], len(self.line))

    def shingles(self) -> np.ndarray:
        """The hash of the shingle at each word; those at the slice's end are cut short."""
        n = len(self.hash)
        at = np.arange(n)
        return _ranges(self.hash, _WORDS, at, np.minimum(at + SHINGLE, n))


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over x[i:i+n] for every i that has n values."""
    size, out = 1, x
    while 2 * size <= n:
        out = f(out[:-size], out[size:])
        size *= 2
    return f(out[: len(x) - n + 1], out[n - size : n - size + len(x) - n + 1])


def _windows(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the chosen windows."""
    at = np.arange(len(w.hash))
    ok = at + WINDOW <= (w.first + w.n)[w.text]
    at = at[ok]
    if not len(at):
        return at, np.zeros(0, _U)
    h, run = _ranges(w.hash, _WORDS, at, at + WINDOW), WINDOW + 1
    top = np.iinfo(np.uint64).max
    place = at + run * w.text[at] + run  # texts apart by a whole run
    row = np.full(int(place[-1]) + 2 * run, top, _U)
    row[place] = h
    least = np.concatenate([np.zeros(run - 1, _U), _sliding(row, run, np.minimum)])
    least[least == top] = 0
    chosen = _sliding(np.concatenate([least, np.zeros(run - 1, _U)]), run, np.maximum)[place + 0] == h
    return at[chosen], h[chosen]


_UNITS = "kind tinyint, key bigint, doc_id bigint, first int, n int, class bigint"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a line (key and class: its content). kind 1: a band of a line, once a slice. kind 2: a chosen window, once a text."""

    def out(w, kind, key, doc, first, n, cls=None):
        rows = len(key)
        classes = pa.nulls(rows, pa.int64()) if cls is None else pa.array(cls.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.full(rows, kind, np.int8)), pa.array(key.view(np.int64)), pa.array(doc), pa.array(first.astype(np.int32)), pa.array(np.asarray(n, np.int32)), classes], names=["kind", "key", "doc_id", "first", "n", "class"])

    for batch in batches:
        for part in slices(batch, 1, _SLICE):
            w, ids = Words(part.column(1)), part.column(0).to_numpy()
            if not len(w.start):
                continue
            at, h = _windows(w)
            if len(at):
                _, one = np.unique(np.stack([w.text[at].astype(_U), h]), axis=1, return_index=True)
                at, h = at[one], h[one]
                yield out(w, 2, h, ids[w.text[at]], at - w.first[w.text[at]], np.full(len(at), WINDOW))
            a, b = w.lines()
            cls = _ranges(w.hash, _WORDS, a, b)
            yield out(w, 0, cls, ids[w.text[a]], a - w.first[w.text[a]], b - a, cls)
            _, one = np.unique(cls, return_index=True)
            one = np.sort(one[(b - a)[one] >= SHINGLE])
            if not len(one):
                continue
            a, b, cls = a[one], b[one], cls[one]
            doc, first = ids[w.text[a]], a - w.first[w.text[a]]
            shingles = w.shingles()
            n = b - a - SHINGLE + 1
            flat = shingles[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            starts = np.cumsum(n) - n
            for band in range(BANDS):
                key = np.full(len(a), band, _U)
                for k in range(band * ROWS, (band + 1) * ROWS):
                    key = _mix(key * _U(_BASE) + np.minimum.reduceat(flat * _A[k] + _B[k], starts))
                yield out(w, 1, key, doc, first, b - a, cls)


def _of(hashes: np.ndarray, text: np.ndarray, wanted: pa.Array) -> np.ndarray:
    """Which hashes, in order of their texts, are in the list of their text."""
    lists = np.split(wanted.flatten().to_numpy().view(_U), np.cumsum(wanted.value_lengths().to_numpy())[:-1])
    ends = np.searchsorted(text, np.arange(len(lists) + 1))
    return np.concatenate([np.isin(hashes[x:y], s) for x, y, s in zip(ends, ends[1:], lists)])


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, seeds, lines): every window that starts at most WINDOW words from a seed, but
    those inside the given lines, which go as a whole and whose windows their first copy has."""
    for batch in batches:
        for part in slices(batch, 1, _SLICE):
            w, ids = Words(part.column(1)), part.column(0).to_numpy()
            at, h = _windows(w)
            at = at[_of(h, w.text[at], part.column(2))]
            # the starts of windows lie between a text's first word and the last that has a whole window
            first, last = w.first[w.text[at]], (w.first + w.n - WINDOW)[w.text[at]]
            depth = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(depth, np.maximum(at - WINDOW, first), 1)
            np.add.at(depth, np.minimum(at + WINDOW, last) + 1, -1)
            a, b = w.lines()
            known = _of(_ranges(w.hash, _WORDS, a, b), w.text[a], part.column(3))
            inside = np.zeros(len(depth), np.int64)
            np.add.at(inside, a[known], 1)
            np.add.at(inside, b[known] - WINDOW + 1, -1)
            at = np.flatnonzero((np.cumsum(depth) > 0) & (np.cumsum(inside) == 0))
            if len(at):
                key = _ranges(w.hash, _WORDS, at, at + WINDOW)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[w.text[at]]), pa.array((at - w.first[w.text[at]]).astype(np.int32))], names=["key", "doc_id", "first"])


def _copied(units: DataFrame) -> DataFrame:
    """(key, copy_of): the contents that stand in two documents or more, and the least of these."""
    return units.groupBy("key").agg(F.min("doc_id").alias("copy_of"), F.max("doc_id").alias("hi")).where("copy_of <> hi").select("key", "copy_of")


def shared_windows(docs: DataFrame, seeds: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, first, n, copy_of): runs of windows that stand in a document of lesser id too.

    lines: doc_id, key, n of those that are known to. Windows inside those of 2 * WINDOW words or more
    are left out: such a line has a seed within reach of each of its windows in its first copy as well,
    so that copy has them all, under a lesser id."""
    wanted = seeds.join(_copied(seeds).select("key"), "key").groupBy("doc_id").agg(F.collect_set("key").alias("seeds"))
    wanted = stored(wanted, "wanted")
    known = lines.where(F.col("n") >= 2 * WINDOW).groupBy("doc_id").agg(F.collect_set("key").alias("lines"))
    may = may_meet(docs, wanted, "doc_id", "may").where("may").drop("may")
    around = may.join(wanted.join(known, "doc_id", "left"), "doc_id").select("doc_id", "text", "seeds", F.coalesce("lines", F.expr("cast(array() as array<bigint>)")).alias("lines"))
    windows = stored(around.mapInArrow(_around, "key bigint, doc_id bigint, first int"), "windows")
    met = windows.join(_copied(windows), "key").where("doc_id <> copy_of")
    # the starts of a run grow with their rank
    run = F.col("first") - F.dense_rank().over(Window.partitionBy("doc_id", "copy_of").orderBy("first"))
    spans = met.select("doc_id", "copy_of", "first", run.alias("run")).groupBy("doc_id", "copy_of", "run").agg(F.min("first").alias("first"), F.max("first").alias("last"))
    return spans.select("doc_id", "first", (F.col("last") - F.col("first") + WINDOW).alias("n"), "copy_of")


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, wanted classes): the distinct shingles of each wanted line."""
    for batch in batches:
        for part in slices(batch, 0, _SLICE):
            w = Words(part.column(0))
            wanted = [set(x) for x in part.column(1).to_pylist()]
            a, b = w.lines()
            long = b - a >= SHINGLE
            a, b = a[long], b[long]
            if not len(a):
                continue
            cls = _ranges(w.hash, _WORDS, a, b).view(np.int64)
            shingles = w.shingles()
            rows = [(int(c), np.unique(shingles[x : y - SHINGLE + 1]).view(np.int64)) for c, x, y, t in zip(cls, a, b, w.text[a]) if int(c) in wanted[t]]
            if rows:
                yield pa.RecordBatch.from_pydict({"class": pa.array([r[0] for r in rows], pa.int64()), "shingles": pa.array([r[1] for r in rows], pa.list_(pa.int64()))})


def _bucket_links(sets: list[np.ndarray], names: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs at the similarity or more. side: the block of each member; with
    two blocks only pairs across count, the others have a task of their own."""
    sizes = np.array([len(s) for s in sets])
    member = np.repeat(np.arange(len(sets)), sizes)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    holders, starts = member[order], np.searchsorted(shingle[order], np.arange(shingle.max() + 2))
    upto = np.cumsum(sizes)
    label, out, both = np.arange(len(sets)), [], len(set(side.tolist())) > 1
    for i in range(len(sets)):
        mine = shingle[upto[i] - sizes[i] : upto[i]]
        n = starts[mine + 1] - starts[mine]
        take = np.repeat(starts[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(holders[take], minlength=len(sets))
        near = common >= SIMILARITY * (sizes[i] + sizes - common) - 1e-9
        near[: i + 1] = False
        if both:
            near &= side != side[i]
        for j in np.flatnonzero(near):
            if label[j] != label[i]:
                out.append((int(names[i]), int(names[j])))
                label[label == label[j]] = label[i]
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, side, class, shingles) sorted by bucket; a bucket's rows are bounded."""

    def done(rows):
        names = np.array([r[2] for r in rows], np.int64)
        found = _bucket_links([r[3] for r in rows], names, np.array([r[1] for r in rows]))
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    rows: list = []
    for batch in batches:
        bucket, side, cls = (batch.column(k).to_numpy() for k in range(3))
        for i in range(len(bucket)):
            if rows and rows[-1][0] != bucket[i]:
                if len(rows) > 1:
                    yield done(rows)
                rows = []
            rows.append((bucket[i], side[i], cls[i], batch.column(3)[i].values.to_numpy()))
    if len(rows) > 1:
        yield done(rows)


def near_lines(docs: DataFrame, bands: DataFrame) -> DataFrame:
    """(class, component): lines with a different line at the similarity or more, by class."""
    met = bands.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("key")
    members = stored(bands.join(met, "key").groupBy("key", "class").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("words")), "members")
    # bands that hold the same lines are one bucket
    groups = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.expr("sum(cast(xxhash64(class) as decimal(38,0)))").alias("h")).groupBy("n", "h").agg(F.min("key").alias("key"), F.max("words").alias("all_words"))
    wanted = stored(members.groupBy("class").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_list("class").alias("classes")), "wanted")
    may = may_meet(docs, wanted, "doc_id", "may").where("may").drop("may")
    sets = may.join(wanted, "doc_id").select("text", "classes").mapInArrow(_shingle_sets, "class bigint, shingles array<bigint>").dropDuplicates(["class"])
    blocks = F.greatest(F.ceil(F.col("n") / BUCKET), F.ceil(F.col("all_words") / BUCKET_WORDS)).cast("int")
    parted = members.join(groups, "key").select("key", "class", blocks.alias("k"), F.pmod(F.xxhash64("class"), blocks).cast("int").alias("c"))
    tasks = parted.select("class", "c", "key", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    tasks = tasks.select("class", F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("bucket"), F.col("c").alias("side"))
    rows = tasks.join(sets, "class").select("bucket", "side", "class", "shingles")
    links = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_verify, "a bigint, b bigint")
    return connected_components(links).withColumnRenamed("node", "class")


def _passages(spans: DataFrame, min_words: int) -> DataFrame:
    """The spans inside runs of min_words words or more, all of a document's spans taken together."""
    order = Window.partitionBy("doc_id").orderBy("first", "n")
    upto = F.max(F.col("first") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("first") <= F.col("upto"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = spans.withColumn("upto", upto).withColumn("run", run)
    whole = Window.partitionBy("doc_id", "run")
    long = marked.withColumn("words", F.max(F.col("first") + F.col("n")).over(whole) - F.min("first").over(whole))
    return long.where(F.col("words") >= min_words).select(*spans.columns)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, first, n, copy_of): spans of words that stand in a document of lesser id too, those in
    runs of at least min_words words."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    units = stored(rows.mapInArrow(_units, _UNITS), "units")
    exact = units.where("kind = 0")
    same = stored(exact.join(_copied(exact), "key").where("doc_id <> copy_of").select("key", "doc_id", "first", "n", "copy_of"), "same")
    inside = shared_windows(rows, units.where("kind = 2").select("key", "doc_id"), same)
    near = near_lines(rows, units.where("kind = 1"))
    lines = exact.join(near, "class")
    least = lines.groupBy("component").agg(F.min("doc_id").alias("copy_of"))
    alike = lines.join(least, "component").where("doc_id <> copy_of").select("doc_id", "first", "n", "copy_of")
    return stored(_passages(same.drop("key").unionByName(alike).unionByName(inside), min_words), "repeats")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and each document that it repeats: where the repeated words begin and
    end, the number of spans, and the spans themselves (first word, words) in order."""
    found = repeats(table(spark, sf_dir, "documents"))
    span = F.struct(F.col("first").cast("bigint").alias("first"), F.col("n").cast("bigint").alias("n"))
    return found.groupBy("doc_id", "copy_of").agg(F.min("first").cast("bigint").alias("first_word"), F.count("*").alias("n_spans"), F.max(F.col("first") + F.col("n")).cast("bigint").alias("end_word"), F.array_sort(F.collect_set(span)).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first column's texts without the spans of words in the second."""
    for batch in batches:
        for part in slices(batch, 0, _SLICE):
            texts = part.column(0)
            spans = part.column(1).to_pylist()
            if any(spans):
                out = texts.to_pylist()
                w = Words(pc.fill_null(texts, ""))
                for i, cuts in enumerate(spans):
                    if not cuts or out[i] is None:
                        continue
                    raw, base, a = out[i].encode(), int(w.offsets[i]), int(w.first[i])
                    gone = np.zeros(int(w.n[i]) + 1, bool)
                    for s in cuts:
                        gone[s["first"] : s["first"] + s["n"]] = True
                    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0)).tolist()
                    kept, at = [], 0
                    for x, y in zip(edges[::2], edges[1::2]):
                        kept.append(raw[at : int(w.start[a + x]) - base].rstrip(b" "))
                        at = int(w.end[a + y - 1]) - base
                    out[i] = b"".join([*kept, raw[at:]]).decode()
                texts = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([texts, *part.columns[2:]], names=["text", *part.schema.names[2:]])


def stage_substring(spark: SparkSession, docs: DataFrame, sf_dir: str, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without their repeated passages; those left without a word go."""
    bounded_batches(spark)
    cut_id, cut_spans, may = unused(docs, "cut_id", "cut_spans", "may_meet")
    spans = stored(repeats(docs, min_words).groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias(cut_spans)), "cuts")
    others = [c for c in docs.columns if c != "text"]
    marked = may_meet(docs, spans, "doc_id", may)
    met = marked.where(may).join(spans.withColumnRenamed("doc_id", cut_id), F.col("doc_id") == F.col(cut_id), "left").select("text", cut_spans, *(f"`{c}`" for c in others))
    whole = docs.select("text", *(f"`{c}`" for c in others))
    rest = marked.where(~F.col(may)).select(*(f"`{c}`" for c in whole.columns))
    done = met.mapInArrow(_cut, whole.schema).unionByName(rest).where(F.col("text").rlike(WORD)).withColumn("n_chars", F.length("text").cast("bigint"))
    return done.select(*(f"`{c}`" for c in docs.columns))
