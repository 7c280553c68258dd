"""Hard negatives of anchors by a secondary-sort shuffle of packed score keys.

1. Anchors are a stated part of the rows. Rows are dealt to shards of bounded size and anchors to blocks of bounded
   size; a cell is one shard with one block, so a pair of an anchor and a row is scored in one task and in none
   else. No cell, and no block, holds more than its bounds, however often a label or a vector occurs.
2. In each cell an anchor keeps its first ``positives`` rows of the same label; the first of all cells are its
   positives.
3. Each positive is a window of scores. In each cell an anchor keeps the first ``negatives`` rows of other labels in each of
   its windows: no other row of the cell can be among the first of all cells.
4. What is kept is packed into keys (anchor, descending score, positives first, id) of bytes that sort as numbers
   do. Keys are dealt by anchor and sorted within partitions. One pass over a partition opens a window at each
   positive, gives each negative to the windows it lies in, and forgets a window once it is full or passed. No
   anchor's rows are held.

Defined results: rows with a null id take no part, nor do those with a null label, a null vector or a null or non-finite
component; of rows that repeat an id the one with the smallest label, then vector, counts; shorter vectors are filled
with zeros; components beyond a long are its limits and sums of products wrap around as longs do; a positive score below zero has
an empty window; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gridwarden.llm.common import schema_of
from gridwarden.session import cut_lineage, temporary

#: Rows of a shard and anchors of a block, on average; a cell scores their product.
SHARD_ROWS, BLOCK_ANCHORS = 1024, 2048
#: Scores held at once by a task.
TILE = 1 << 21

_KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("negative", "u1"), ("id", ">u8")])
_FLIP = np.uint64(1 << 63)
_OUT = schema_of("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def pack(anchor: np.ndarray, score: np.ndarray, negative: np.ndarray, row: np.ndarray) -> list[bytes]:
    """Keys that sort as bytes by anchor, descending score, positives first, id."""
    keys = np.empty(len(anchor), _KEY)
    keys["anchor"] = anchor.view(np.uint64) ^ _FLIP
    keys["score"] = ~(score.view(np.uint64) ^ _FLIP)
    keys["negative"] = negative
    keys["id"] = row.view(np.uint64) ^ _FLIP
    raw = keys.tobytes()
    return [raw[i : i + _KEY.itemsize] for i in range(0, len(raw), _KEY.itemsize)]


def unpack(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The four parts of packed keys."""
    found = np.frombuffer(b"".join(keys), _KEY)
    plain = lambda name, flip: (found[name].astype(np.uint64) ^ flip).view(np.int64)
    return plain("anchor", _FLIP), plain("score", ~_FLIP), found["negative"].astype(bool), plain("id", _FLIP)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Whole components, one row a vector, filled with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products; in doubles where these are exact, else in longs."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def window(positive_score: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest score of a negative: low * p <= 100 * n <= high * p."""
    return -(-low * positive_score // 100), high * positive_score // 100


def _column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name).combine_chunks()
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def _cell(anchors: pa.Table, rows: pa.Table):
    """Tiles of a cell: places of anchors, their scores with all rows, and the rows' ids and labels; rows in order of their ids."""
    if not anchors.num_rows or not rows.num_rows:
        return
    rows = rows.sort_by("id")
    both = [_column(t, "vector") for t in (anchors, rows)]
    width = max(int(np.diff(v.offsets.to_numpy()).max(initial=0)) for v in both)
    a, b = (_matrix(v, width) for v in both)
    ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
    step = max(1, TILE // len(ids))
    for at in range(0, len(a), step):
        yield slice(at, at + step), _scores(a[at : at + step], b), ids, labels


def mine_hard_negatives(
    df: DataFrame,
    anchors: Column,
    vec_id: str = "vec_id",
    vector: str = "vector",
    label: str = "label",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    shard_rows: int = SHARD_ROWS,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vector`` holds whole numbers; ``anchors`` is a condition on ``vec_id``. A negative of a positive with score p has a
    score n with low * p <= 100 * n <= high * p.
    """
    with temporary(df.sparkSession) as keep:
        named = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<long>").alias("vector"), anchors.alias("anchor"))
        whole = named.filter("id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)")
        whole = whole.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("row")).select("id", "row.*")
        whole = cut_lineage(whole, "mined-rows")
        counts = whole.agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors")).first()
        shards, blocks = -(-counts["rows"] // shard_rows) or 1, -(-counts["anchors"] // block_anchors) or 1
        dealt = lambda name, n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name)
        every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
        rows = whole.select(dealt("shard", shards), every("block", blocks), "id", "label", "vector")
        # new names for the same columns, as rows and anchors come from one table
        chosen = whole.filter("anchor").select(dealt("block", blocks), *[F.col(c).alias(c) for c in ("id", "label", "vector")])
        cells = rows.groupBy("block", "shard")
        kept = schema_of("anchor long, key binary")
        arrow = to_arrow_schema(kept)

        def keys(places, scores, negative, ids, anchor_ids) -> pa.Table:
            """Keys of the chosen (anchor, row) places of a tile."""
            i, j = places
            owner = anchor_ids[i]
            return pa.Table.from_arrays([pa.array(owner), pa.array(pack(owner, scores[i, j], np.full(len(i), negative, np.uint8), ids[j]), pa.binary())], schema=arrow)

        def first_positives(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            for part, scores, ids, labels in _cell(right, left):
                own, own_labels = right.column("id").to_numpy()[part], right.column("label").to_numpy()[part]
                for value in np.unique(own_labels):
                    same, among = np.flatnonzero(own_labels == value), np.flatnonzero(labels == value)
                    if not len(among):
                        continue
                    # ids are in order, so a stable sort leaves ties by id; one more than asked for, as one may be the anchor
                    order = among[np.argsort(-scores[np.ix_(same, among)], axis=1, kind="stable")[:, : positives + 1]]
                    other = ids[order] != own[same][:, None]
                    other &= np.cumsum(other, axis=1) <= positives
                    k, rank = np.nonzero(other)
                    out.append(keys((same[k], order[k, rank]), scores, 0, ids, own))
            return pa.concat_tables(out) if out else arrow.empty_table()

        found = cells.cogroup(chosen.select("*", every("shard", shards)).groupBy("block", "shard")).applyInArrow(first_positives, kept)

        def first_of_all(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, seen = None, 0
            for part in parts:
                owner, score, _, row = unpack(part.column(1).to_pylist())
                take = []
                for i, a in enumerate(owner.tolist()):
                    last, seen = a, (seen if a == last else 0) + 1
                    if seen <= positives:
                        take.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(x[take]) for x in (owner, row, score)], schema=to_arrow_schema(of_anchor))

        of_anchor = schema_of("anchor long, positive long, score long")
        best = cut_lineage(found.repartition("anchor").sortWithinPartitions("key").mapInArrow(first_of_all, of_anchor), "mined-positives")
        listed = best.groupBy("anchor").agg(F.array_sort(F.collect_list("score")).alias("scores"))
        chosen = chosen.join(listed, chosen["id"] == listed["anchor"]).select(*[F.col(c).alias(c) for c in ("block", "id", "vector", "label", "scores")], every("shard", shards))

        def first_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            windows = _column(right, "scores").to_pylist() if right.num_rows else []
            for part, scores, ids, labels in _cell(right, left):
                own, own_labels = right.column("id").to_numpy()[part], right.column("label").to_numpy()[part]
                order = np.argsort(-scores, axis=1, kind="stable")
                picked_i, picked_j = [], []
                for i, positive_scores in enumerate(windows[part]):
                    ranked = order[i][labels[order[i]] != own_labels[i]]
                    falling = -scores[i, ranked]
                    chosen_ = set()
                    for p in set(positive_scores):
                        least, most = window(p, low, high)
                        at = int(np.searchsorted(falling, -most))
                        end = min(int(np.searchsorted(falling, -least, "right")), at + negatives)
                        chosen_.update(ranked[at:end].tolist())
                    picked_i += [i] * len(chosen_)
                    picked_j += chosen_
                if picked_i:
                    out.append(keys((np.array(picked_i), np.array(picked_j)), scores, 1, ids, own))
            return pa.concat_tables(out) if out else arrow.empty_table()

        near = cells.cogroup(chosen.groupBy("block", "shard")).applyInArrow(first_negatives, kept)

        def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                a, row, score = (part.column(i).to_numpy() for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(pack(a, score, np.zeros(len(a), np.uint8), row), pa.binary())], schema=arrow)

        def stream(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, opened = None, []  # a window: positive, its score, least and largest score, negatives given
            for part in parts:
                made = []
                for a, score, negative, row in zip(*(x.tolist() for x in unpack(part.column(1).to_pylist())), strict=True):
                    if a != last:
                        last, opened = a, []
                    if not negative:
                        opened.append([row, score, *window(score, low, high), 0])
                        continue
                    opened = [w for w in opened if w[4] < negatives and score >= w[2]]
                    for w in opened:
                        if score <= w[3]:
                            w[4] += 1
                            made.append((a, w[0], w[4], row, w[1], score))
                columns = list(zip(*made, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(_OUT), strict=True)], schema=to_arrow_schema(_OUT))

        every_key = near.union(best.mapInArrow(packed, kept))
        return keep(every_key.repartition("anchor").sortWithinPartitions("key").mapInArrow(stream, _OUT), "mined")
