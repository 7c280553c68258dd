"""Near-duplicates: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

1. One pass gives each text its number of distinct shingles, a digest of the set, band keys and a signature.
   Texts with equal sets are one class, represented by their smallest id.
2. Rows with a common band key form a bucket. A bucket never makes all its pairs: every member is compared
   with one pivot, the member that meets the most others in all of its buckets.
3. A pair's signatures are compared batch by batch. After each batch the posterior of a similarity of at
   least the threshold (uniform prior) is known; below ``miss`` the pair is dropped. Survivors are confirmed
   on their full word shingles.
4. What the pivot leaves open is closed exactly. Let x not be linked with its pivot h. If x and y share no
   shingle outside h, their intersection is within that of x and h, so they can be linked only if y is
   smaller than a bound from x and h. Hence the members of a bucket that still lie in several components
   are grouped anew by the shingles they have beyond the pivot, and those few small enough are paired
   directly; the groups get pivots of their own, and so on until none is open. A pivot has no shingle beyond
   itself and is in no later group, so this ends.

Links are missed only if no band key agrees (0.8^7 in 48 bands: about one pair in 80,000 at exactly the
threshold, far fewer above it) or by ``miss``.

Defined results: a null or blank text has an empty set, links with nothing and is kept; a null id links
with nothing, has a null component and is kept; rows that repeat an id are one document, whatever their texts and
order; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gridwarden.llm.common import likely_among, per_row, schema_of, words
from gridwarden.llm.graph import joined_components
from gridwarden.llm.shingles import batches, hash_family, mix, shingle_numbers, word_numbers
from gridwarden.session import cut_lineage, temporary

BANDS, ROWS = 48, 7
SIGNATURE, STEP = 128, 32


def signatures(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS, keep: Sequence[str] = ("_id",)) -> DataFrame:
    """The kept columns of rows with a ``_text``, _n (distinct shingles), _digest of the set, _keys (one a band), _signature (16 bits of each of the first minima)."""

    def setup():
        a, b = hash_family(bands * rows, 7)
        a, b = a[:, None], b[:, None]
        weights = np.random.default_rng(11).integers(1, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salt = np.arange(bands, dtype=np.uint64) << np.uint64(56)

        def one(numbers):
            found = np.unique(numbers)
            if not len(found):
                return 0, None, [], b""
            short = (found >> np.uint64(32)).astype(np.uint32)
            least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
            for at in range(0, len(short), 512):
                np.minimum(least, (short[at : at + 512] * a + b).min(axis=1), out=least)
            keys = mix((least.reshape(bands, rows).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64) + salt)
            return len(found), blake2b(found.tobytes(), digest_size=16).digest(), keys.view(np.int64).tolist(), (least[:SIGNATURE] >> np.uint32(16)).astype(np.uint16).tobytes()

        def fn(texts):
            out = [one(x) for part in batches(texts) for x in shingle_numbers(*word_numbers(part), size)]
            return list(zip(*out, strict=True)) or [[]] * 4

        return fn

    return per_row(docs, setup, "_n long, _digest binary, _keys array<long>, _signature binary", ["_text"], keep)


def fewest_matches(share: float, miss: float, signature: int = SIGNATURE, step: int = STEP) -> list[int]:
    """Per batch the least number of equal places that keeps a pair: below it P(similarity >= share) < miss.

    With a uniform prior, P(s >= t | m of n equal) is the chance of at most m successes in n + 1 trials at t.
    """
    out = []
    for n in range(step, signature + 1, step):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * share**m * (1 - share) ** (n + 1 - m)
            if total >= miss:
                out.append(m)
                break
    return out


def _prune(pairs: DataFrame, known: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) whose signatures survive all batches and whose sizes allow a link."""
    least = fewest_matches(percent / 100, miss)
    arrow = to_arrow_schema(schema_of("a long, b long"))

    def run(parts):
        for part in parts:
            n = part.num_rows
            left, right = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint16).reshape(n, SIGNATURE) for i in (2, 3))
            alive, equal = np.arange(n), np.zeros(n, np.int64)
            for k, m in enumerate(least):
                place = slice(k * STEP, (k + 1) * STEP)
                equal[alive] += (left[alive, place] == right[alive, place]).sum(axis=1)
                alive = alive[equal[alive] >= m]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(alive)), part.column(1).take(pa.array(alive))], schema=arrow)

    known = likely_among(known, "_id", _ends(pairs))
    a = known.select(F.col("_id").alias("a"), F.col("_n").alias("_na"), F.col("_signature").alias("_sa"))
    b = known.select(F.col("_id").alias("b"), F.col("_n").alias("_nb"), F.col("_signature").alias("_sb"))
    met = pairs.join(b, "b").join(a, "a").filter(f"100 * least(_na, _nb) >= {percent} * greatest(_na, _nb)")
    return met.select("a", "b", "_sa", "_sb").mapInArrow(run, schema_of("a long, b long"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("_id")).union(pairs.select("b"))


def _shingle_set(text: str, size: int) -> set[tuple[str, ...]]:
    found = words(text)
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} or ({tuple(found)} if found else set())


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the given ids (and of few others), stored: later joins move these and not the whole table.

    No exact join follows here: the optimizer would put it first and shuffle every text.
    """
    return cut_lineage(likely_among(docs, "_id", ids).dropDuplicates(["_id"]), "near-texts")


def _with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (a, b, ...) with the text of b, then of the pivot a; a hot pivot is split by the skew join."""
    of_b = texts.select(F.col("_id").alias("b"), F.col("_text").alias("_tb"))
    of_a = texts.select(F.col("_id").alias("a"), F.col("_text").alias("_ta"))
    return rows.join(of_b, "b").join(of_a, "a")


def _confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) linked by their full shingle sets."""
    texts = _texts_of(docs, _ends(pairs))
    arrow = to_arrow_schema(schema_of("a long, b long"))

    def run(parts):
        last, of_last = None, set()
        for part in parts:
            a, b, keep = part.column(0).to_pylist(), part.column(1).to_pylist(), []
            for i in range(part.num_rows):
                if a[i] != last:
                    last, of_last = a[i], _shingle_set(part.column(2)[i].as_py(), size)
                other = _shingle_set(part.column(3)[i].as_py(), size)
                both = len(of_last & other)
                if 100 * both >= percent * (len(of_last) + len(other) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], schema=arrow)

    return _with_texts(pairs, texts).select("a", "b", "_ta", "_tb").mapInArrow(run, schema_of("a long, b long"))


def _beyond(members: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """For (grp, a = pivot, b = member, label): shared count, sizes, whether linked, numbers of b's shingles that a lacks."""
    texts = _texts_of(docs, _ends(members))
    out = schema_of("grp long, b long, label long, shared long, n long, linked boolean, more array<long>")
    arrow = to_arrow_schema(out)

    def run(parts):
        last, of_last = None, np.zeros(0, np.uint64)
        for part in parts:
            grp, label, a, b = (part.column(i).to_pylist() for i in range(4))
            for i in range(part.num_rows):
                if a[i] != last:
                    last, of_last = a[i], np.unique(shingle_numbers(*word_numbers([part.column(4)[i].as_py() or ""]), size)[0])
                own = np.unique(shingle_numbers(*word_numbers([part.column(5)[i].as_py() or ""]), size)[0])
                more = np.setdiff1d(own, of_last, assume_unique=True)
                shared = len(own) - len(more)
                linked = 100 * shared >= percent * (len(own) + len(of_last) - shared)
                row = {"grp": grp[i], "b": b[i], "label": label[i], "shared": shared, "n": len(own), "linked": linked, "more": more.view(np.int64).tolist()}
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return _with_texts(members, texts).select("grp", "label", "a", "b", "_ta", "_tb").mapInArrow(run, out)


def _open_pairs(beyond: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """What members of open groups still have to be compared: pairs (a, b), and new groups (grp, a = pivot, b).

    A link of x (not linked with the pivot) and y needs ceil(p (n_x + n_y) / (100 + p)) common shingles, of which at most
    ``shared`` lie in the pivot. Without a common one beyond the pivot, y must be small: those are paired. Else
    at least t of x's shingles beyond the pivot are common, so one of them is among all but the t - 1 last in any fixed
    order; rare ones come first, and first of all those that no other component has.
    """
    smallest = beyond.groupBy("grp").agg(F.min("n").alias("_least"))
    least_y = F.expr(f"greatest(_least, ({percent} * n + 99) div 100)")
    need = F.greatest(F.lit(1), F.expr(f"({percent} * (n + _ny) + {99 + percent}) div {100 + percent} - shared"))
    room = F.expr(f"((100 + {percent}) * shared - {percent} * n) div {percent}")
    loose = beyond.filter("not linked").join(smallest, "grp").withColumn("_ny", least_y).withColumn("_need", need).withColumn("_room", room)
    x = loose.filter("_room >= _ny").select("grp", F.col("b").alias("a"), F.col("label").alias("_la"), "_room")
    small = x.join(beyond.select("grp", "b", "label", "n"), "grp").filter("n <= _room and label != _la and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    single = beyond.select("grp", "b", "label", "linked", F.size("more").alias("_more"), F.explode("more").alias("_s"))
    common = single.groupBy("grp", "_s").agg(F.count("*").alias("_m"), F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low != _high").select("grp", "_s", "_m")
    single = single.join(common, ["grp", "_s"])
    own = Window.partitionBy("grp", "b")
    ranked = single.filter("not linked").join(loose.select("grp", "b", "_need"), ["grp", "b"])
    ranked = ranked.withColumn("_rank", F.row_number().over(own.orderBy("_m", "_s"))).withColumn("_k", F.count("*").over(own))
    front = ranked.filter("_rank <= _k - _need + 1").select("grp", "_s", "b", "label", "_more")
    met = single.filter("linked").join(front.select("grp", "_s").distinct(), ["grp", "_s"], "left_semi").select("grp", "_s", "b", "label", "_more", F.lit(False).alias("_front")).union(front.withColumn("_front", F.lit(True)))
    return small.distinct(), met


def _regrouped(met: DataFrame) -> DataFrame:
    """New groups (grp, a, b): members with a common shingle, around the one that has the least beyond the old pivot."""
    heads = met.groupBy("grp", "_s").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.min(F.struct("_more", "b")).alias("_head")).filter("_low != _high").select("grp", "_s", F.col("_head.b").alias("a"))
    return met.join(heads, ["grp", "_s"]).filter("a != b").select(F.xxhash64("grp", "a").alias("grp"), "a", "b").distinct()


def _spelled_out(met: DataFrame) -> DataFrame:
    """The pairs (a, b) themselves: of those with a common shingle, one in front, and of two components."""
    x = met.filter("_front").select("grp", "_s", F.col("b").alias("a"), F.col("label").alias("_la"))
    return x.join(met.select("grp", "_s", "b", "label"), ["grp", "_s"]).filter("_la != label").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


#: Pairs per row of an open group up to which the open pairs are compared one by one; beyond it they are grouped again.
PAIRS_A_ROW = 64


def links(known: DataFrame, every: DataFrame, docs: DataFrame, size: int, percent: int, miss: float) -> DataFrame | None:
    """Components (node, component) of the linked classes; ``known`` has one row per class, ``every`` one per text."""
    keyed = known.select("_id", F.explode("_keys").alias("_key"))
    shared = keyed.groupBy("_key").agg(F.count("*").alias("_m")).filter("_m > 1")
    met = cut_lineage(keyed.join(shared, "_key").select("_key", "_id", "_m"), "near-buckets")
    degree = met.groupBy("_id").agg(F.sum("_m").alias("_degree"))
    graded = met.join(degree, "_id")
    top = lambda degree, node: F.max(F.struct(degree, (-F.col(node)).alias("_neg"))).alias("_top")
    pivot = graded.groupBy("_key").agg(top("_degree", "_id")).select("_key", (-F.col("_top._neg")).alias("a"), F.col("_top._degree").alias("_da"))
    met = cut_lineage(met.join(pivot, "_key").select("a", "_da", F.col("_id").alias("b")).distinct(), "near-met")
    # a pivot that is a member of another one's bucket hands over its members: all its buckets are one group
    over = met.groupBy(F.col("b").alias("a")).agg(top("_da", "a")).select("a", (-F.col("_top._neg")).alias("_over"))
    groups = met.join(over, "a").select(F.col("_over").alias("a"), "b").union(met.select("a", "b").filter("a = b").join(over, "a").select(F.col("_over").alias("a"), "b"))
    groups = cut_lineage(groups.filter("a != b").select(F.col("a").alias("grp"), "a", "b").distinct(), "near-groups")
    pairs, labels = groups.select("a", "b").distinct(), None
    while True:
        with temporary(known.sparkSession) as keep:
            found = cut_lineage(_prune(pairs, every, percent, miss), "near-survivors")
            labels = keep(joined_components(labels, cut_lineage(_confirm(found, docs, size, percent), "near-links")), "near-labels")
            if groups is None:
                return labels
            of_b = labels.select(F.col("node").alias("b"), "component")
            members = groups.join(of_b, "b", "left").select("grp", "a", "b", F.coalesce("component", "b").alias("label"))
            several = members.groupBy("grp").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low != _high").select("grp")
            members = cut_lineage(members.join(several, "grp", "left_semi"), "near-open")
            rows = members.count()
            if not rows:
                return labels
            small, open_rows = _open_pairs(cut_lineage(_beyond(members, docs, size, percent), "near-beyond"), percent)
            open_rows = cut_lineage(open_rows, "near-open")
            load = open_rows.groupBy("grp", "_s").agg((F.count_if("_front") * F.count("*")).alias("_pairs")).agg(F.sum("_pairs")).first()[0] or 0
            if load <= PAIRS_A_ROW * rows:
                groups, pairs = None, _spelled_out(open_rows)
            else:
                groups = keep(_regrouped(open_rows), "near-groups")
                pairs = groups.select("a", "b")
            pairs = keep(pairs.union(small).distinct(), "near-pairs")
        if pairs.isEmpty():
            return labels


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 2, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``df``."""
    with temporary(df.sparkSession) as keep:
        doc = F.col(f"`{doc_id}`").cast("long")
        # a row is known by its id and text together: rows may repeat an id with another text
        node = F.when(doc.isNotNull(), F.xxhash64(doc, F.col(f"`{text}`")))
        docs = df.select(node.alias("_id"), doc.alias("_doc"), F.col(f"`{text}`").alias("_text"))
        every = cut_lineage(signatures(docs, size, keep=("_id", "_doc")), "near-signatures")
        counted = every.filter("_n > 0 and _id is not null").groupBy("_digest").agg(F.min("_id").alias("_first"), F.min("_id").alias("_low"), F.max("_id").alias("_high"))
        copies = cut_lineage(counted.filter("_low != _high").select("_digest", "_first"), "near-copies")
        known = every.join(copies, "_digest", "left").withColumn("_rep", F.coalesce("_first", "_id"))
        labels = links(known.filter("_n > 0 and _id = _rep"), every.filter("_n > 0"), docs.select("_id", "_text"), size, percent, miss)
        # texts of one id are one document
        named = known.select("_doc", "_id", "_n", F.when(F.col("_n") > 0, F.col("_rep")).alias("_rep"))
        repeated = named.filter("_doc is not null").groupBy("_doc").agg(F.min("_rep").alias("_low"), F.max("_rep").alias("_high")).filter("_low != _high")
        extra = cut_lineage(named.join(repeated, "_doc").filter("_rep != _low").select(F.col("_low").alias("a"), F.col("_rep").alias("b")).distinct(), "near-repeats")
        labels = joined_components(labels, extra)
        named = named.join(labels.withColumnRenamed("node", "_rep"), "_rep", "left").withColumn("_label", F.coalesce("component", "_rep"))
        named = cut_lineage(named.select("_doc", "_n", "_label"), "near-labelled")
        smallest = named.filter("_doc is not null and _label is not null").groupBy("_label").agg(F.min("_doc").alias("_least"))
        component = F.when(F.col("_doc").isNotNull(), F.coalesce("_least", "_doc"))
        out = named.join(smallest, "_label", "left").select(F.col("_doc").alias(doc_id), F.col("_n").alias("n_shingles"), component.alias("component_id"))
        return keep(out.withColumn("kept", F.coalesce(F.col(f"`{doc_id}`") == F.col("component_id"), F.lit(True))), "near-result")
