"""Exact Jaccard join of word shingle sets: subsets of small sets, inverted lists of large ones.

All sets are ordered alike, rare shingles first. Two linked sets share k of the first ``n - o + k`` shingles of each,
where o is the least overlap that a link needs.

1. One pass counts each text's shingles, names the set by a 64-bit number, and counts shingles in a table of fixed size; that
   gives the order. Texts with equal sets are one class, and only classes are joined.
2. A second pass emits the first shingles of each set (k = 2). Those that only one set has end here.
3. The lists of the others are exact, so the costs of both ways are known for each size: subsets to enumerate and move
   for a set, or list entries to move and sets in those lists to compare. The boundary with the least sum divides small from large sets.
   Small sets meet in subsets of two shingles, large sets meet all sets in the lists of single shingles. Sets too
   different in size are in groups of their own.
4. A group never makes all its pairs. Its members are compared with its smallest set, the pivot: sizes first, then parity
   bitmaps (their differing bits are at most the sets' difference), then whole sets. Only groups whose members still
   lie in several components stay open.
5. In open groups of at most ``pair_up_to`` members the parity maps of those in different components are compared in one
   task, which emits only pairs that may be linked. In a larger one let x be no partner of the
   pivot h. Any y in the group is as large as h at least, so a link of x and y needs more common shingles than x
   shares with h: they share some beyond h. Members are grouped anew by what they have beyond h, again
   the rarest first, and so on. A pivot has nothing beyond itself and is in none of the later groups, so this ends.

No candidate is left out by chance; only equal 64-bit numbers of different shingles or sets could deceive (about one
pair in 10^19).

Defined results: a null or blank text has an empty set, links with nothing and is its own component; a null id
links with nothing and has a null component; rows that repeat an id are one document, in whatever order they come; an empty table gives no
rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gridwarden.llm.common import likely_among, schema_of
from gridwarden.llm.graph import joined_components
from gridwarden.llm.shingles import batches, shingle_numbers, word_numbers
from gridwarden.session import cut_lineage, temporary

#: Counters of the table that gives the order, by the first bits of a shingle.
ORDER_BITS = 20
#: Least bits of the parity map of a set; a map has as many bits as its set has shingles, or up to twice as many.
PARITY_BITS = 512
#: Comparisons of parity maps that cost as much as moving a row.
COMPARES_A_ROW = 16
#: Members of an open group that are compared by their parity maps in one task.
PAIR_UP_TO = 4096


def _sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """Distinct shingles of each text, in ascending order."""
    for part in batches(texts):
        for numbers in shingle_numbers(*word_numbers(part), size):
            yield np.unique(numbers)


def _name(numbers: np.ndarray) -> int:
    return int.from_bytes(blake2b(numbers.tobytes(), digest_size=8).digest(), "little", signed=True)


def _parity(numbers: np.ndarray) -> bytes:
    """Whether each residue occurs an odd number of times."""
    bits = max(PARITY_BITS, 1 << (len(numbers) - 1).bit_length()) if len(numbers) else PARITY_BITS
    return np.packbits(np.bincount((numbers & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _folded(bits: list[bytes], size: int) -> np.ndarray:
    """Parity maps as rows of ``size`` bytes: the parts of a longer map are added modulo 2."""
    out = np.empty((len(bits), size // 8), np.uint64)
    for i, b in enumerate(bits):
        own = np.frombuffer(b, np.uint64)
        out[i] = own if len(own) == size // 8 else np.bitwise_xor.reduce(own.reshape(-1, size // 8))
    return out


def _may_link(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose maps differ in no more bits than linked sets of these sizes differ in shingles."""
    differ = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return differ <= na + nb - 2 * -(-percent * (na + nb) // (100 + percent))


def _map(df: DataFrame, fn, made: str) -> DataFrame:
    """Arrow batches through ``fn``, which yields tuples of columns."""
    schema = schema_of(made)
    arrow = to_arrow_schema(schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(parts):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def _slices(parts: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


def counted_sets(docs: DataFrame, size: int) -> DataFrame:
    """(_id, _n, _set, _bits) of each text, and rows (_bucket, _count) of the counters that are full in some task."""

    def fn(parts):
        counts = np.zeros(1 << ORDER_BITS, np.int64)
        for part in _slices(parts):
            n, name, bits = [], [], []
            for numbers in _sets(part.column(1).to_pylist(), size):
                np.add.at(counts, (numbers >> np.uint64(64 - ORDER_BITS)).astype(np.int64), 1)
                n.append(len(numbers))
                name.append(_name(numbers) if len(numbers) else None)
                bits.append(_parity(numbers))
            none = [None] * len(n)
            yield part.column(0), n, name, bits, none, none
        full = np.flatnonzero(counts > 16 + 4 * counts.mean())
        none = [None] * len(full)
        yield none, none, none, none, full.tolist(), counts[full].tolist()

    return _map(docs, fn, "_id long, _n long, _set long, _bits binary, _bucket long, _count long")


def _order(counted: DataFrame) -> Broadcast:
    """Level of each counter: at most 2^ORDER_BITS rows come to the driver, one byte each goes out."""
    full = counted.filter("_bucket is not null").groupBy("_bucket").agg(F.sum("_count").alias("_count"))
    found = full.select("_bucket", F.ceil(F.log2("_count")).cast("int").alias("_level")).toPandas()
    level = np.zeros(1 << ORDER_BITS, np.uint8)
    level[found["_bucket"].to_numpy(np.int64)] = found["_level"].to_numpy(np.int64) + 1
    return counted.sparkSession.sparkContext.broadcast(level.tobytes())


def first_shingles(docs: DataFrame, size: int, percent: int, order: Broadcast) -> DataFrame:
    """(_key, _set, _n, _rank): the first shingles of each set that can link with another one."""

    def fn(parts):
        level = np.frombuffer(order.value, np.uint8)
        for part in _slices(parts):
            keys, names, sizes = [], [], []
            for numbers in _sets(part.column(1).to_pylist(), size):
                n = len(numbers)
                if 100 * n < percent * (n + 1) and 100 * (n - 1) < percent * n:
                    continue
                take = min(n, n - -(-percent * n // 100) + 2)
                chosen = np.lexsort((numbers, level[(numbers >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]))[:take]
                keys.append(numbers[chosen])
                names.append(_name(numbers))
                sizes.append(n)
            if keys:
                times = [len(k) for k in keys]
                yield np.concatenate(keys).view(np.int64), np.repeat(np.array(names, np.int64), times), np.repeat(np.array(sizes, np.int64), times), np.concatenate([np.arange(t) for t in times])

    return _map(docs, fn, "_key long, _set long, _n long, _rank long")


def whole_sets(docs: DataFrame, size: int) -> DataFrame:
    """(_id, _set, _numbers) of each text that has words."""

    def fn(parts):
        for part in _slices(parts, 64):
            rows = [(i, _name(numbers), numbers.tobytes()) for i, numbers in zip(part.column(0).to_pylist(), _sets(part.column(1).to_pylist(), size), strict=True) if len(numbers)]
            if rows:
                yield tuple(zip(*rows, strict=True))

    return _map(docs, fn, "_id long, _set long, _numbers binary")


def _size_class(n: Column) -> Column:
    """Sizes up to 255 alone, larger ones in steps of a sixteenth of a power of e: a few hundred classes at most."""
    return F.when(n < 256, n).otherwise(256 + F.floor(16 * F.log(n / 256.0)))


def choose_boundary(costs: list[tuple[int, int, int]]) -> int:
    """Least class of the large sets, from (class, cost of subsets, cost of lists)."""
    costs = sorted(costs)
    best, at = sum(c[2] for c in costs), 0
    total = best
    for k, subsets, lists in costs:
        total += subsets - lists
        if total < best:
            best, at = total, k + 1
    return at


def first_groups(shared: DataFrame, percent: int, boundary: int | None = None) -> DataFrame:
    """(parent, grp, set, n): sets that meet in a subset or in a list; sets of one group differ in size by two bands at most."""
    counts = shared.groupBy("_key").agg(F.count("*").alias("_m"))
    known = cut_lineage(shared.join(counts, "_key").withColumn("_class", _size_class(F.col("_n"))), "jaccard-lists")
    single = F.expr(f"_rank < _n - ({percent} * _n + 99) div 100 + 1")
    if boundary is None:
        # a subset is a row that moves; so is a list entry, and each other set of the list is compared by its map
        a_set = known.groupBy("_set", "_class").agg(F.count("*").alias("_q"), F.sum(F.when(single, F.col("_m") - 1 + COMPARES_A_ROW)).alias("_lists"))
        costs = a_set.groupBy("_class").agg(F.sum(F.expr(f"_q * (_q - 1) div 2 * {COMPARES_A_ROW}")).alias("_subsets"), F.sum("_lists").alias("_lists"))
        boundary = choose_boundary([(r["_class"], r["_subsets"] or 0, r["_lists"] or 0) for r in costs.collect()])
    large = F.col("_class") >= boundary
    least = known.filter(large).agg(F.min("_n")).first()[0]
    lists = known.filter(single & (F.lit(100) * F.col("_n") >= percent * (least or 0))).select("_key", F.col("_set").alias("set"), F.col("_n").alias("n"), large.alias("_large")) if least else None
    own = known.filter(~large).groupBy("_set", "_n").agg(F.array_sort(F.collect_list("_key")).alias("_keys"))
    pairs = F.expr("flatten(transform(_keys, (x, i) -> transform(slice(_keys, 1, i), y -> xxhash64(y, x))))")
    subsets = own.select(F.explode(pairs).alias("_key"), F.col("_set").alias("set"), F.col("_n").alias("n"), F.lit(True).alias("_large"))
    # a link's sizes differ by a factor of 100 / percent; bands are a little wider, so it lies in a band or two next to each other
    band = F.floor(F.log("n") / log(100 / (percent - 1)))
    every = [subsets.withColumn("_kind", F.lit(2))] + ([lists.withColumn("_kind", F.lit(1))] if lists is not None else [])
    placed = every[0] if len(every) == 1 else every[0].unionByName(every[1])
    placed = placed.withColumn("_band", band).withColumn("parent", F.explode(F.array(F.col("_band"), F.col("_band") - 1)))
    placed = placed.select("parent", F.xxhash64("_kind", "_key", "parent").alias("grp"), "set", "n", "_large", (F.col("_band") == F.col("parent")).alias("_own"))
    # a set is in a group once, so a count tells whether there are several
    met = placed.groupBy("grp").agg(F.count("*").alias("_m"), F.max("_own").alias("_any"), F.max("_large").alias("_one")).filter("_m > 1 and _any and _one")
    met = cut_lineage(met.select("grp"), "jaccard-met")
    return likely_among(placed, "grp", met).join(met, "grp").select("parent", "grp", "set", "n").distinct()


class _Known:
    """All members of groups (_set, _id, _n, _bits), and the comparison of pairs of them.

    Whole sets are made again from the texts of those that sizes and bits leave over: few move, and no more than once a step.
    """

    def __init__(self, members: DataFrame, docs: DataFrame, size: int, percent: int):
        self.members, self.docs, self.size, self.percent = members, docs, size, percent

    def _with_members(self, pairs: DataFrame, *columns: str) -> DataFrame:
        """Pairs with the id and the given columns of b, then of a: a hot a is split by the skew join."""
        for end in ("b", "a"):
            of = self.members.select(F.col("_set").alias(end), F.col("_id").alias(f"_id{end}"), *[F.col(c).alias(f"{c}{end}") for c in columns])
            pairs = pairs.join(of, end)
        return pairs

    def _with_sets(self, pairs: DataFrame, *columns: str) -> DataFrame:
        """(columns, a, b, numbers of a, numbers of b) of pairs that know their ids; stored texts are read once for all ends."""
        ids = pairs.select(F.col("_ida").alias("_id")).union(pairs.select("_idb"))
        sets = cut_lineage(whole_sets(likely_among(self.docs, "_id", ids), self.size), "jaccard-whole")
        for end in ("b", "a"):
            of = sets.select(F.col("_set").alias(end), F.col("_id").alias(f"_id{end}"), F.col("_numbers").alias(f"_{end}"))
            pairs = pairs.join(of, [end, f"_id{end}"])
        return pairs.select(*columns, "a", "b", "_a", "_b")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that are linked: by size, by parity maps, by whole sets."""
        percent = self.percent

        def by_bits(parts):
            for part in _slices(parts, 1024):
                na, nb = part.column(4).to_numpy(), part.column(5).to_numpy()
                left, right = part.column(6).to_pylist(), part.column(7).to_pylist()
                least = np.array([min(len(x), len(y)) for x, y in zip(left, right, strict=True)])
                keep = np.zeros(part.num_rows, bool)
                for size in np.unique(least):
                    at = np.flatnonzero(least == size)
                    maps = [_folded([side[i] for i in at], int(size)) for side in (left, right)]
                    keep[at] = _may_link(na[at], nb[at], *maps, percent)
                chosen = pa.array(np.flatnonzero(keep))
                yield tuple(part.column(i).take(chosen) for i in range(4))

        def by_sets(parts):
            last, of_last = None, np.zeros(0, np.uint64)
            for part in parts:
                a, b, keep = part.column(0).to_pylist(), part.column(1).to_pylist(), []
                for i in range(part.num_rows):
                    if a[i] != last:
                        last, of_last = a[i], np.frombuffer(part.column(2)[i].as_buffer(), np.uint64)
                    other = np.frombuffer(part.column(3)[i].as_buffer(), np.uint64)
                    both = _common(of_last, other)
                    if 100 * both >= percent * (len(of_last) + len(other) - both):
                        keep.append(i)
                yield [a[i] for i in keep], [b[i] for i in keep]

        near = self._with_members(pairs, "_n", "_bits").filter(f"100 * least(_na, _nb) >= {percent} * greatest(_na, _nb)").select("a", "b", "_ida", "_idb", "_na", "_nb", "_bitsa", "_bitsb")
        near = cut_lineage(_map(near, by_bits, "a long, b long, _ida long, _idb long"), "jaccard-near")
        return _map(self._with_sets(near), by_sets, "a long, b long")

    def near_in_groups(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, b) of (grp, b, label) rows that one group has in different components and that sizes and parity maps leave over.

        A group's maps are compared in one task, so groups must be of bounded size; only what is left over is a row.
        """
        percent = self.percent
        schema = schema_of("a long, b long")
        arrow = to_arrow_schema(schema)

        def compare(group: pa.Table) -> pa.Table:
            group = group.sort_by("_n")
            n, label, node = (group.column(c).to_numpy() for c in ("_n", "label", "b"))
            bits = group.column("_bits").to_pylist()
            first, second = [], []
            # sets of much different size are never compared, so maps of a stretch are folded to its shortest
            high = np.searchsorted(percent * n, 100 * n, "right")
            size, maps, end = 0, None, 0
            for i in range(len(n) - 1):
                if maps is None or len(bits[i]) != size or high[i] > end:
                    size, begin, end = len(bits[i]), i, int(high[min(len(n) - 1, i + 256)])
                    maps = _folded(bits[begin:end], size)
                near = np.arange(i + 1, high[i])
                near = near[label[near] != label[i]]
                near = near[_may_link(n[i], n[near], maps[i - begin], maps[near - begin], percent)]
                first += [node[i]] * len(near)
                second += node[near].tolist()
            a, b = np.array(first, np.int64), np.array(second, np.int64)
            return pa.Table.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=arrow)

        known = self.members.select(F.col("_set").alias("b"), "_n", "_bits")
        return rows.select("grp", "b", "label").join(known, "b").groupBy("grp").applyInArrow(compare, schema).distinct()

    def beyond(self, members: DataFrame) -> DataFrame:
        """For (grp, a = pivot, b = member, label): n, shared with a, linked with a, the numbers that b has and a lacks."""
        percent = self.percent

        def fn(parts):
            last, of_last = None, np.zeros(0, np.uint64)
            for part in _slices(parts, 64):
                grp, label, a, b = (part.column(i).to_pylist() for i in range(4))
                rows = []
                for i in range(part.num_rows):
                    if a[i] != last:
                        last, of_last = a[i], np.frombuffer(part.column(4)[i].as_buffer(), np.uint64)
                    other = np.frombuffer(part.column(5)[i].as_buffer(), np.uint64)
                    more = np.setdiff1d(other, of_last, assume_unique=True)
                    both = len(other) - len(more)
                    rows.append((grp[i], b[i], label[i], len(other), len(of_last), both, 100 * both >= percent * (len(of_last) + len(more)), more.view(np.int64).tolist()))
                yield tuple(zip(*rows, strict=True))

        return _map(self._with_sets(self._with_members(members), "grp", "label"), fn, "grp long, b long, label long, n long, na long, shared long, linked boolean, more array<long>")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Common numbers of two ascending arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _labelled(rows: DataFrame, labels: DataFrame | None, node: str) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col(node))
    found = labels.select(F.col("node").alias(node), F.col("component"))
    return rows.join(found, node, "left").withColumn("label", F.coalesce("component", node)).drop("component")


def _several(rows: DataFrame, by: str) -> DataFrame:
    """Groups whose members lie in several components, with their size."""
    return rows.groupBy(by).agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count("*").alias("_size")).filter("_low != _high").select(by, "_size")


def _around_pivots(groups: DataFrame) -> DataFrame:
    """(parent, grp, a, set, n): each group's members and the set they are compared with.

    That is its smallest set, or the smallest set of another group with the same parent that holds this one: so
    groups of much the same members are compared once.
    """
    least = F.min(F.struct("n", "set")).alias("_pivot")
    pivots = groups.groupBy("parent", "grp").agg(least)
    of_set = groups.join(pivots, ["parent", "grp"]).groupBy("parent", "set").agg(F.min("_pivot").alias("_over"))
    over = pivots.select("parent", "grp", F.col("_pivot.set").alias("set")).join(of_set, ["parent", "set"]).select("parent", "grp", F.col("_over.set").alias("a"))
    return groups.join(over, ["parent", "grp"]).select("parent", "grp", "a", "set", "n")


def _to_centres(around: DataFrame) -> DataFrame:
    """Pairs of each member with the member that is in the most groups around its pivot: often the text that others were made from.

    They prove nothing about the others, but most links of near copies are among them, and fewer groups stay open.
    """
    degree = around.groupBy("parent", "a", "set").agg(F.count("*").alias("_degree"))
    centre = degree.groupBy("parent", "a").agg(F.max(F.struct("_degree", "set")).alias("_c")).select("parent", "a", F.col("_c.set").alias("_centre"))
    met = degree.join(centre, ["parent", "a"]).filter("set != _centre")
    return met.select(F.least("set", "_centre").alias("a"), F.greatest("set", "_centre").alias("b"))


def _regrouped(beyond: DataFrame, percent: int) -> DataFrame:
    """New groups (parent, grp, set, n) of what members of open groups share beyond the pivot."""
    least_y = f"greatest(na, ({percent} * n + 99) div 100)"
    need = F.expr(f"greatest(1, ({percent} * (n + {least_y}) + {99 + percent}) div {100 + percent} - shared)")
    single = beyond.withColumn("_need", need).select("grp", "b", "label", "n", "linked", "_need", F.explode("more").alias("_s"))
    common = single.groupBy("grp", "_s").agg(F.count("*").alias("_m"), F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low != _high").select("grp", "_s", "_m")
    single = cut_lineage(single.join(common, ["grp", "_s"]), "jaccard-beyond")
    own = Window.partitionBy("grp", "b")
    ranked = single.filter("not linked").withColumn("_rank", F.row_number().over(own.orderBy("_m", "_s"))).withColumn("_k", F.count("*").over(own))
    front = ranked.filter("_rank <= _k - _need + 1").select("grp", "_s", "b", "label", "n")
    met = single.filter("linked").join(front.select("grp", "_s").distinct(), ["grp", "_s"], "left_semi").select("grp", "_s", "b", "label", "n").union(front)
    met = cut_lineage(met, "jaccard-met")
    open_ = met.groupBy("grp", "_s").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low != _high").select("grp", "_s")
    return met.join(open_, ["grp", "_s"]).select(F.col("grp").alias("parent"), F.xxhash64("grp", "_s").alias("grp"), F.col("b").alias("set"), "n")


def linked_components(groups: DataFrame, known: _Known, pair_up_to: int = PAIR_UP_TO) -> DataFrame | None:
    """(node, component) of all linked sets; None if there is no group."""
    labels = None
    spark = groups.sparkSession
    while not groups.isEmpty():
        with temporary(spark) as keep:
            around = cut_lineage(_around_pivots(groups), "jaccard-around")
            pairs = around.filter("a != set").select("a", F.col("set").alias("b")).union(_to_centres(around)).distinct()
            labels = keep(joined_components(labels, cut_lineage(known.links(pairs), "jaccard-links")), "jaccard-labels")
            # groups with one pivot are one group, unless that is too large: then each is taken as it is
            every = around.select(F.xxhash64("parent", "a").alias("merged"), F.col("grp").alias("single"), "a", F.col("set").alias("b"))
            every = cut_lineage(_labelled(every, labels, "b"), "jaccard-open")
            merged = every.select(F.col("merged").alias("grp"), "b", "label").distinct()
            sizes = cut_lineage(_several(merged, "grp"), "jaccard-sizes")
            few = merged.join(sizes.filter(F.col("_size") <= pair_up_to), "grp")
            large = every.join(sizes.filter(F.col("_size") > pair_up_to).select(F.col("grp").alias("merged")), "merged").withColumnRenamed("single", "grp")
            large = cut_lineage(large.join(_several(large, "grp"), "grp"), "jaccard-large")
            few = few.unionByName(large.filter(F.col("_size") <= pair_up_to).select("grp", "b", "label", "_size"))
            pairs = known.near_in_groups(few)
            labels = keep(joined_components(labels, cut_lineage(known.links(pairs), "jaccard-links")), "jaccard-labels")
            many = large.filter(F.col("_size") > pair_up_to).select(F.col("merged").alias("grp"), "a", "b").distinct()
            many = _labelled(many, labels, "b")
            many = cut_lineage(many.join(_several(many, "grp").select("grp"), "grp", "left_semi"), "jaccard-many")
            if many.isEmpty():
                return labels
            groups = keep(_regrouped(cut_lineage(known.beyond(many), "jaccard-rest"), known.percent), "jaccard-groups")
    return labels


def jaccard_components(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = 4,
    percent: int = 85,
    pair_up_to: int = PAIR_UP_TO,
    boundary: int | None = None,
) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``df``.

    ``boundary`` fixes the least size class of large sets; None chooses it by cost. ``pair_up_to`` is the size up to which an open
    group is compared in one task. Neither changes the result.
    """
    with temporary(df.sparkSession) as keep:
        docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"))
        counted = cut_lineage(counted_sets(docs, size), "jaccard-sets")
        order = _order(counted)
        every = counted.filter("_n is not null").select("_id", "_n", "_set", "_bits")
        named = every.filter("_id is not null and _set is not null")
        own = docs.filter("_id is not null")
        first = cut_lineage(first_shingles(own, size, percent, order), "jaccard-first")
        lists = cut_lineage(first.groupBy("_key").agg(F.count("*").alias("_m")).filter("_m > 1").select("_key"), "jaccard-keys")
        shared = likely_among(first, "_key", lists).join(lists, "_key").distinct()
        several = shared.groupBy("_key").agg(F.count("*").alias("_m")).filter("_m > 1").select("_key")
        shared = cut_lineage(shared.join(several, "_key"), "jaccard-shared")
        groups = cut_lineage(first_groups(shared, percent, boundary), "jaccard-groups")
        met = groups.select(F.col("set").alias("_set")).distinct()
        members = named.groupBy("_set").agg(F.min(F.struct("_id", "_n", "_bits")).alias("_one")).join(met, "_set").select("_set", "_one.*")
        labels = linked_components(groups, _Known(cut_lineage(members, "jaccard-members"), own, size, percent), pair_up_to)
        order.unpersist()
        # texts of one id are one document
        repeated = named.groupBy("_id").agg(F.min("_set").alias("_low"), F.max("_set").alias("_high")).filter("_low != _high")
        repeats = cut_lineage(named.join(repeated, "_id").select(F.col("_low").alias("a"), F.col("_set").alias("b")).filter("a != b").distinct(), "jaccard-repeats")
        labels = joined_components(labels, repeats)
        placed = cut_lineage(_labelled(every.drop("_bits"), labels, "_set"), "jaccard-placed")
        smallest = placed.filter("_id is not null and label is not null").groupBy("label").agg(F.min("_id").alias("_least"))
        out = placed.join(smallest, "label", "left")
        component = F.when(F.col("_id").isNotNull(), F.coalesce("_least", "_id"))
        return keep(out.select(F.col("_id").alias(doc_id), F.col("_n").alias("n_shingles"), component.alias("component_id")), "jaccard-result")
