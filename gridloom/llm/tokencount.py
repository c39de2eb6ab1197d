"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of a slice go into a trie, level by level. Each node carries the unigram
forward score of its prefix and the piece count of the best path; pieces under way are carried
from a node to all its children, so a prefix shared by many pre-tokens is solved once. A
pre-token's count is read at its terminal node. Where a level holds no more than ``FEW`` nodes, each
is followed along its path by the same recurrence, from the scores that its prefix has. The counts
equal the number of pieces of Viterbi segmentation (``unigram``), ties included.

Nulls count as empty texts with no token. Repeated rows keep their own output rows. An empty table
gives an empty result. A text of any length is counted whole, in slices of its own. Columns besides
the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._common import table
from gridloom.llm._units import encoded, slices, totals
from gridloom.llm.unigram import MARK, OWN, Unigram, flat, long_way, model_path, public_model, split_units

#: Nodes in a level that are worth a step of all together.
FEW = 4


def _along(model: Unigram, rest: bytes, best: float, count: int, head: tuple[float, int, int, int], under: list[tuple[int, int, float, int]]) -> int:
    """The count at the end of a path: rest follows a node with these values; head: score, count, bytes
    left and size of the character under way; under: (state, length, score, count) of the pieces under
    way, longest first."""
    base, check, value, scores, unknown = model.trie.base, model.trie.check, model.trie.value, model.score, model.unknown
    h_best, h_count, h_left, h_size = head
    for c in rest:
        if not h_left:
            under.append((0, 0, best, count))
            h_best, h_count, h_size = best, count, 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            h_left = h_size
        h_left -= 1
        best, count, single, after = -math.inf, 0, False, []
        for state, length, x, n in under:
            t = base[state] + c
            if check[t] != state:
                continue
            after.append((t, length + 1, x, n))
            v = value[t]
            if v >= 0:
                single |= length + 1 == h_size
                if x + scores[v] > best:
                    best, count = x + scores[v], n + 1
        if not h_left and not single and h_best + unknown > best:
            best, count = h_best + unknown, h_count + h_size
        under = after
    return count


def terminal_counts(model: Unigram, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Pieces of each unit; the units' bytes stand one after another."""
    base, check, value = model.arrays
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), np.int64)
    live = np.flatnonzero(sizes > 0)
    node = np.zeros(len(live), np.int64)  # of each live unit, at this depth
    best, count = np.zeros(1), np.zeros(1, np.int64)  # of each node
    head_best, head_count, head_left, head_size = best, count, np.zeros(1, np.int64), np.zeros(1, np.int64)  # the character under way
    none = np.zeros(0, np.int64)
    p_node, p_state, p_len, p_best, p_count = none, np.zeros(0, np.int32), none, np.zeros(0), none  # pieces under way, longest first
    depth = 0
    while len(live) > FEW:
        whole = head_left == 0
        new = np.flatnonzero(whole)
        p_node, p_state, p_len = np.concatenate([p_node, new]), np.concatenate([p_state, np.zeros(len(new), np.int32)]), np.concatenate([p_len, np.zeros(len(new), np.int64)])
        p_best, p_count = np.concatenate([p_best, best[new]]), np.concatenate([p_count, count[new]])
        order = np.argsort(p_node, kind="stable")
        p_node, p_state, p_len, p_best, p_count = (x[order] for x in (p_node, p_state, p_len, p_best, p_count))
        key, node = np.unique(node * 256 + data[offsets[live] + depth], return_inverse=True)
        parent, byte = key >> 8, (key & 255).astype(np.uint8)
        char = np.where(byte < 0x80, 1, np.where(byte < 0xE0, 2, np.where(byte < 0xF0, 3, 4)))
        head_best, head_count = np.where(whole[parent], best[parent], head_best[parent]), np.where(whole[parent], count[parent], head_count[parent])
        head_size = np.where(whole[parent], char, head_size[parent])
        head_left = np.where(whole[parent], char, head_left[parent]) - 1
        first, last = np.searchsorted(p_node, parent), np.searchsorted(p_node, parent, side="right")
        n = last - first
        ends = np.cumsum(n)
        take = np.repeat(first - (ends - n), n) + np.arange(ends[-1])
        to = np.repeat(np.arange(len(key)), n)
        state = base[p_state[take]] + byte[to]
        ok = check[state] == p_state[take]
        take, p_node, p_state = take[ok], to[ok], state[ok]
        p_len, p_best, p_count = p_len[take] + 1, p_best[take], p_count[take]
        v = value[p_state]
        hit = v >= 0
        at, score = p_node[hit], p_best[hit] + model.scores[v[hit]]
        best, count = np.full(len(key), -np.inf), np.zeros(len(key), np.int64)
        np.maximum.at(best, at, score)
        top = np.flatnonzero(score == best[at])[::-1]
        count[at[top]] = p_count[hit][top] + 1
        single = np.zeros(len(key), bool)
        single[at[p_len[hit] == head_size[at]]] = True
        lost = (head_left == 0) & ~single & (head_best + model.unknown > best)
        best, count = np.where(lost, head_best + model.unknown, best), np.where(lost, head_count + head_size, count)
        depth += 1
        done = sizes[live] == depth
        out[live[done]] = count[node[done]]
        live, node = live[~done], node[~done]
    for i, k in zip(live.tolist(), node.tolist()):
        mine = p_node == k
        under = list(zip(p_state[mine].tolist(), p_len[mine].tolist(), p_best[mine].tolist(), p_count[mine].tolist()))
        head = float(head_best[k]), int(head_count[k]), int(head_left[k]), int(head_size[k])
        out[i] = _along(model, data[offsets[i] + depth : offsets[i + 1]].tobytes(), float(best[k]), int(count[k]), head, under)
    return out


def counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = public_model(path)
        for batch in batches:
            for part in slices(batch, 1):
                lists, odd = split_units(part.column(1))
                sizes, units, index = encoded(lists)
                data, offsets = flat(units)
                tokens = totals(terminal_counts(model, data, offsets)[index], sizes)
                pretokens = totals((np.diff(offsets) > 0).astype(np.int64)[index], sizes)
                if odd.any():
                    sizes, units, index = long_way(model, part.column(1), odd)
                    n = terminal_counts(model, *flat(units))
                    n[pc.equal(units, OWN).to_numpy(zero_copy_only=False).astype(bool)] = len(MARK.encode())
                    tokens[odd], pretokens[odd] = totals(n[index], sizes), sizes
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pretokens), pa.array(tokens)], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select("doc_id", F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).mapInArrow(run, "doc_id bigint, n_pretokens bigint, n_tokens bigint")


def op9_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(table(spark, sf_dir, "documents"), model_path())
