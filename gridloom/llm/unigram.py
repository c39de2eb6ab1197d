"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A text is a space marker followed by the text with spaces as markers. Pieces hold a marker only at
their start and no line feed (checked), so the best path never crosses a cut before a run of
markers or around a line feed, and each distinct unit between cuts is solved once. Characters
without a piece cost ``unknown`` and become byte pieces. A marker character that stands in the
text itself becomes byte pieces too, so decoding gives every text back byte for byte.

The public model is of the merge kind: its scores are ranks. They are read as Zipf's law has them,
log p = -log((rank + 2.7) log(1.78 V)); a model of the unigram kind is used as it is.

Nulls count as empty texts, which have no piece. Repeated rows keep their own output rows. Of paths
of equal score the one whose last piece starts first is taken. An empty table gives an empty result.
A text of any length is solved unit by unit. Other columns pass untouched, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm._common import bounded_batches, table
from gridloom.llm._units import encoded, gather, slices, spread, totals

MARK = "▁"
_UNITS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
#: Stands for a marker character of a text's own in lists of units; no unit holds a line feed and more.
OWN = f"\n{MARK}"


class DoubleArray:
    """Keys as byte strings; next state of s by byte c is base[s] + c where check holds s."""

    def __init__(self, keys: dict[bytes, int]):
        tree: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for key, value in keys.items():
            at = 0
            for c in key:
                if c not in tree[at]:
                    tree[at][c] = len(tree)
                    tree.append({})
                    ends.append(-1)
                at = tree[at][c]
            ends[at] = value
        size = 2 * len(tree) + 512
        base, check, value = [0] * size, [-1] * size, [-1] * size
        free, place, todo = 1, {0: 0}, [0]
        check[0] = 0
        for node in todo:
            s, children = place[node], sorted(tree[node])
            value[s] = ends[node]
            if not children:
                base[s] = size
                continue
            while check[free] >= 0:
                free += 1
            b, tried = max(1, free - children[0]), 0
            while any(check[b + c] >= 0 for c in children):
                b, tried = b + 1, tried + 1
                if b + 256 >= len(check):
                    for a, fill in ((base, 0), (check, -1), (value, -1)):
                        a.extend([fill] * 65536)
            if tried > 64 and free < b:
                free += 1
            base[s] = b
            for c in children:
                check[b + c] = s
                place[tree[node][c]] = b + c
                todo.append(tree[node][c])
        top = max(place.values()) + 257
        for a, fill in ((base, 0), (check, -1), (value, -1)):
            a.extend([fill] * max(0, top - len(a)))
        self.base, self.check, self.value = base[:top], check[:top], value[:top]
        # a leaf leads nowhere: its base points at a run that belongs to no state
        self.base = [min(x, top - 257) if x < size else top - 257 for x in self.base]
        for i in range(top - 257 + 1, top):
            self.check[i] = -1

    def prefixes(self, text: bytes, start: int = 0) -> list[tuple[int, int]]:
        """(end, value) of the keys that text has at start."""
        out, s = [], 0
        for j in range(start, len(text)):
            t = self.base[s] + text[j]
            if self.check[t] != s or t == 0:
                break
            s = t
            if self.value[s] >= 0:
                out.append((j + 1, self.value[s]))
        return out


class Unigram:
    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int]):
        """pieces: id and log score; byte_ids: the ids of the 256 byte pieces."""
        for p in pieces:
            if MARK in p.lstrip(MARK) or "\n" in p:
                raise ValueError(f"piece {p!r} crosses a cut")
        self.pieces, self.byte_ids = pieces, byte_ids
        self.unknown = min(s for _, s in pieces.values()) - 10.0
        self.longest = max(map(len, pieces))
        self.score = dict(pieces.values())
        self.trie = DoubleArray({p.encode(): i for p, (i, _) in pieces.items()})
        top = max(max(byte_ids), *(i for i, _ in pieces.values())) + 1
        self.arrays = tuple(np.array(x, dtype=np.int32) for x in (self.trie.base, self.trie.check, self.trie.value))
        self.scores = np.zeros(top)
        for i, x in pieces.values():
            self.scores[i] = x
        self.bytes_ids = np.array(byte_ids, dtype=np.int32)
        self.bytes_of = [b""] * top
        for p, (i, _) in pieces.items():
            self.bytes_of[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([b])

    def viterbi(self, unit: str) -> list[int]:
        """Ids of the best path; of equal scores the one whose last piece starts first."""
        text = unit.encode()
        base, check, value, score, unknown = self.trie.base, self.trie.check, self.trie.value, self.score, self.unknown
        n = len(text)
        best, came, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0], at = 0.0, 0
        while at < n:
            c = text[at]
            step = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            s, mine, single = 0, best[at], False
            for j in range(at, n):
                t = base[s] + text[j]
                if check[t] != s:
                    break
                s, v = t, value[t]
                if v >= 0:
                    e, x = j + 1, mine + score[v]
                    single |= e - at == step
                    if x > best[e]:
                        best[e], came[e], piece[e] = x, at, v
            e = at + step
            if not single and mine + unknown > best[e]:
                best[e], came[e], piece[e] = mine + unknown, at, -1
            at = e
        out: list[int] = []
        while n:
            a = came[n]
            out += [piece[n]] if piece[n] >= 0 else [self.byte_ids[b] for b in reversed(text[a:n])]
            n = a
        return out[::-1]

    def solve(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """viterbi of many units at once: their bytes one after another, with n + 1 offsets. All ids,
        and how many each unit has. Every start walks the trie in step with the others; edges are
        relaxed by distance from the unit's start, so ties fall as in viterbi."""
        base, check, value = self.arrays
        sizes = np.diff(offsets)
        word = np.repeat(np.arange(len(sizes)), sizes)
        end_of = np.repeat(offsets[1:], sizes)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[starts]
        char = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        known = np.zeros(len(starts), bool)
        who, at, state, edges = np.arange(len(starts)), starts.copy(), np.zeros(len(starts), np.int32), []
        while len(who):
            n = base[state] + data[at]
            ok = check[n] == state
            who, at, state = who[ok], at[ok] + 1, n[ok]
            v = value[state]
            hit = v >= 0
            edges.append((who[hit], at[hit], v[hit]))
            known[who[hit][at[hit] - starts[who[hit]] == char[who[hit]]]] = True
            more = at < end_of[starts[who]]
            who, at, state = who[more], at[more], state[more]
        lost = np.flatnonzero(~known)
        edges.append((lost, starts[lost] + char[lost], np.full(len(lost), -1, np.int32)))
        who, end, v = (np.concatenate(x) for x in zip(*edges))
        a = starts[who]
        w = word[a]
        gain = np.where(v >= 0, self.scores[v], self.unknown)
        depth = a - offsets[w]
        order = np.argsort(depth, kind="stable")
        a, end, v, gain, depth = a[order] + w[order], end[order] + w[order], v[order], gain[order], depth[order]
        nodes = len(data) + len(sizes)
        best, came, piece = np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes, np.int32)
        first = offsets[:-1] + np.arange(len(sizes))
        best[first] = 0.0
        for lo, hi in zip(*(lambda c: (np.concatenate([[0], c]), np.concatenate([c, [len(depth)]])))(np.flatnonzero(np.diff(depth)) + 1)):
            x = best[a[lo:hi]] + gain[lo:hi]
            up = x > best[end[lo:hi]]
            to = end[lo:hi][up]
            best[to], came[to], piece[to] = x[up], a[lo:hi][up], v[lo:hi][up]
        walk, now, who = [], first + sizes, np.arange(len(sizes))
        who = who[sizes > 0]
        now = now[sizes > 0]
        while len(who):
            prev = came[now]
            walk.append((who, piece[now], prev, now - prev))
            who, now = who[prev > first[who]], prev[prev > first[who]]
        if not walk:
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        step = np.repeat(np.arange(len(walk)), [len(x[0]) for x in walk])
        who, ids, prev, size = (np.concatenate(x) for x in zip(*walk))
        order = np.lexsort((-step, who))
        who, ids, prev, size = who[order], ids[order], prev[order], size[order]
        n = np.where(ids >= 0, 1, size)
        out = np.repeat(ids, n)
        if (ids < 0).any():
            within = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
            where = np.repeat(prev - who, n) + within
            out = np.where(out >= 0, out, self.bytes_ids[data[np.minimum(where, len(data) - 1)]])
        return out.astype("<i4"), np.bincount(who, weights=n, minlength=len(sizes)).astype(np.int64)

    def units(self, text: str) -> list[str | None]:
        """The units of a text; None stands for a marker character of the text's own."""
        out: list[str | None] = []
        for k, part in enumerate(text.split(MARK) if text else []):
            out += [None] * (k > 0) + _UNITS.findall(("" if k else MARK) + part.replace(" ", MARK))
        return out

    def encode(self, text: str) -> list[int]:
        """The definition: one text, unit by unit."""
        literal = [self.byte_ids[b] for b in MARK.encode()]
        return [i for u in self.units(text) for i in (literal if u is None else self.viterbi(u))]

    def decode(self, ids) -> str:
        return b"".join(self.bytes_of[i] for i in ids)[1:].decode()


@lru_cache(2)
def public_model(path: str) -> Unigram:
    """A SentencePiece model file; only its pieces and scores are read."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    scores = {i: m.get_score(i) for i in plain}
    if min(scores.values()) < -1000:
        scores = {i: -math.log((min(-s, n) + 2.7) * math.log(1.78 * n)) for i, s in scores.items()}
    return Unigram({m.id_to_piece(i): (i, scores[i]) for i in plain}, [i for i in range(n) if m.is_byte(i)])


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def split_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Units of each text as a list array, and which texts need the long way instead (a space at
    the start, runs of spaces, or marker characters of their own: their list is empty). An empty unit stands for nothing."""
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.match_substring(texts, MARK))
    plain = pc.if_else(odd, pa.scalar("", texts.type), texts)
    marked = pc.replace_substring(pc.replace_substring(plain, " ", " " + MARK), "\n", " \n ")
    marked = pc.if_else(pc.equal(plain, ""), pa.scalar("", texts.type), pc.binary_join_element_wise(MARK, marked, ""))
    return pc.split_pattern(marked, " "), odd.to_numpy(zero_copy_only=False).astype(bool)


def flat(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array."""
    offsets = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1].astype(np.int64)
    data = np.frombuffer(units.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def solved(model: Unigram, data: np.ndarray, offsets: np.ndarray, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """model.solve in parts of at most so many bytes (or one unit), which bounds its working memory."""
    ids, sizes, at = [np.zeros(0, "<i4")], [np.zeros(0, np.int64)], 0
    while at < len(offsets) - 1:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        found = model.solve(data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at])
        ids.append(found[0])
        sizes.append(found[1])
        at = upto
    return np.concatenate(ids), np.concatenate(sizes)


def long_way(model: Unigram, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """encoded() of the odd texts, whose units are told apart text by text."""
    lists = [[OWN if u is None else u for u in model.units(t)] for t in texts.filter(pa.array(odd)).to_pylist()]
    return encoded(pa.array(lists, pa.list_(pa.string())))


def _solved_long(model: Unigram, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ids, n = solved(model, *flat(units))
    at = pc.index(units, OWN).as_py()
    if at >= 0:
        start, own = int(n[:at].sum()), np.array([model.byte_ids[b] for b in MARK.encode()], "<i4")
        ids, n[at] = np.concatenate([ids[:start], own, ids[start + n[at] :]]), len(own)
    return ids, n


def ids_of(model: Unigram, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each text has. Each distinct unit is solved once."""
    lists, odd = split_units(texts)
    sizes, units, index = encoded(lists)
    ids, n = gather(*solved(model, *flat(units)), index)
    lengths = totals(n, sizes)
    if odd.any():
        sizes, units, index = long_way(model, texts, odd)
        more, n = gather(*_solved_long(model, units), index)
        of_odd = totals(n, sizes)
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        for i, part in zip(np.flatnonzero(odd), np.split(more, np.cumsum(of_odd)[:-1])):
            parts[i] = part
        lengths[odd] = of_odd
        ids = np.concatenate(parts)
    return ids, lengths


def _bytes(model: Unigram, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    raw, n = spread(model.bytes_of, ids, 1, "u1")
    ends = np.cumsum(totals(n, lengths))
    whole = raw.tobytes()
    return [whole[a:b][1:] for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())]


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with the text column replaced by array<int> out_col of piece ids."""
    keep = [c for c in docs.columns if c not in (text_col, out_col)]
    schema = docs.select(*(f"`{c}`" for c in keep)).schema.add(out_col, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = public_model(path)
        for batch in batches:
            for part in slices(batch, 0):
                ids, lengths = ids_of(model, part.column(0))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], lists], names=[*keep, out_col])

    return docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text_col), *(f"`{c}`" for c in keep)).mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """coded with the ids column replaced by the text; a null list gives an empty text."""
    keep = [c for c in coded.columns if c not in (ids_col, out_col)]
    schema = coded.select(*(f"`{c}`" for c in keep)).schema.add(out_col, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = public_model(path)
        for batch in batches:
            lists = batch.column(0)
            for at in range(0, len(lists), 256):
                part = lists.slice(at, 256)
                n = pc.list_value_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = _bytes(model, part.flatten().to_numpy(), n)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, 256) for c in batch.columns[1:]), pa.array([t.decode() for t in texts], pa.string())], names=[*keep, out_col])

    return coded.select(F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>")).alias(ids_col), *(f"`{c}`" for c in keep)).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, n_byte_pieces, ids_crc32, same): of the encoded text; same: decoding gives it back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = public_model(path)
        is_byte = np.zeros(len(model.bytes_of), bool)
        is_byte[model.byte_ids] = True
        for batch in batches:
            for part in slices(batch, 1):
                ids, lengths = ids_of(model, part.column(1))
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                back = _bytes(model, ids, lengths)
                same = pc.equal(pa.array(back, pa.binary()), part.column(1).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths), pa.array(totals(is_byte[ids], lengths)), pa.array(crc, pa.int64()), same], names=["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "same"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, same boolean")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model_path())


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with piece ids in place of the text."""
    bounded_batches(spark)
    return encode(docs, model_path()).withColumn("n_pieces", F.size("ids").cast("bigint"))
