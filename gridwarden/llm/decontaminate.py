"""Benchmark decontamination: size-partitioned MinHash containment search, confirmed on exact shingles.

Items are partitioned by their number of shingles (powers of two). For each partition every document is
cut into windows of four times the partition's lower bound, one beginning at each half window, so a short item meets a
long document at a similarity of about a quarter and not of one in thousands. Each of ``functions``
MinHash functions is a band of its own: an item and a window that share a minimum share that shingle, and
the pair is a candidate. Wherever a share c of an item's shingles stand in a document, a function finds one
with a chance of at least about c / 5; with 64 functions and c = 0.8 about one pair in 70,000 is missed.

Broadcast are two bit arrays of fixed size (2^24 bits each), whatever the number of items: which minima and
which shingles items have. A document row leaves its task only if it hits, and if it may hold enough shingles
for the smallest item; false hits cost a join row, none is lost. Confirmation counts the exact words of the shingles.

Defined results: null or blank items and texts match nothing; an item of fewer words than a shingle is one shingle
of all its words and matches only texts that are equal to it; null ids are kept as null; repeated
rows give repeated pairs once; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gridwarden.llm.common import SLICE_ROWS, schema_of, words
from gridwarden.llm.shingles import batches, hash_family, shingle_numbers, word_numbers
from gridwarden.session import cut_lineage, temporary

WORDS, PERCENT, FUNCTIONS = 5, 80, 64
BITS = 1 << 24
_MASK = np.uint64(BITS - 1)


def _minima(short: np.ndarray, starts: np.ndarray, functions: int) -> np.ndarray:
    """Minimum of each hash function over the runs of 32-bit numbers that begin at ``starts``."""
    a, b = hash_family(functions, 23)
    out = np.empty((functions, len(starts)), np.uint32)
    for k in range(functions):
        out[k] = np.minimum.reduceat(short * a[k] + b[k], starts)
    return out


def _signs(minima: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit sign of (partition, function, minimum)."""
    function = np.arange(len(minima), dtype=np.uint64)[:, None]
    return (np.uint64(level) << np.uint64(48)) | (function << np.uint64(32)) | minima.astype(np.uint64)


def _places(signs: np.ndarray) -> np.ndarray:
    """Bit of a sign in the fixed array."""
    return (signs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS.bit_length() + 1)


def _level(n: int) -> int:
    return n.bit_length() - 1


def _texts_of(found: list[str], size: int) -> list[str]:
    """Shingles as texts; a text with fewer words is one shingle, marked so that it equals no part of a longer one."""
    if len(found) >= size:
        return [" ".join(found[i : i + size]) for i in range(len(found) - size + 1)]
    return ["\n" + " ".join(found)] if found else []


def item_shingles(items: DataFrame, item_id: str, text: str, size: int, functions: int) -> DataFrame:
    """item, n, level, signs array<long>, bits array<long> of its shingles, shingles array<string>; items without words are left out."""
    schema = schema_of("item long, n int, level int, signs array<long>, bits array<long>, shingles array<string>")
    arrow = to_arrow_schema(schema)

    def run(parts):
        for part in parts:
            rows = []
            for item, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                numbers = np.unique(shingle_numbers(*word_numbers([value or ""]), size)[0])
                if len(numbers):
                    level = _level(len(numbers))
                    signs = _signs(_minima((numbers >> np.uint64(32)).astype(np.uint32), np.array([0]), functions), level)[:, 0]
                    rows.append({"item": item, "n": len(numbers), "level": level, "signs": signs.view(np.int64).tolist(), "bits": (numbers & _MASK).astype(np.int64).tolist(), "shingles": sorted(set(_texts_of(words(value), size)))})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    chosen = items.select(F.col(f"`{item_id}`").cast("long").alias("item"), F.col(f"`{text}`").alias("_text"))
    return chosen.mapInArrow(run, schema)


def _bit_array(places: DataFrame) -> bytes:
    """One bit per place that occurs; at most BITS / 64 rows reach the driver."""
    in_words = places.select(F.expr("place div 64").alias("w"), F.expr("shiftleft(1L, int(place % 64))").alias("v"))
    out = np.zeros(BITS // 64, np.int64)
    for r in in_words.groupBy("w").agg(F.bit_or("v").alias("v")).collect():
        out[r["w"]] = r["v"]
    return out.tobytes()


def _sign_places(signs: DataFrame) -> DataFrame:
    def run(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array(_places(part.column(0).to_numpy().view(np.uint64)).astype(np.int64))], names=["place"])

    return signs.mapInArrow(run, schema_of("place long"))


def _sign_hits(numbers: list[np.ndarray], levels: list[int], functions: int, marked: np.ndarray) -> dict[int, list[np.ndarray]]:
    """Signs of windows that the marked bits have, by the number of the text; all texts of a batch at once."""
    lengths = np.array([len(x) for x in numbers])
    short = (np.concatenate(numbers) >> np.uint64(32)).astype(np.uint32)
    half = 1 << (levels[0] + 1)
    texts = np.flatnonzero(lengths)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    starts = np.concatenate([np.arange(offsets[t], offsets[t + 1], half) for t in texts]) if len(texts) else np.zeros(0, np.int64)
    if not len(starts):
        return {}
    owner = np.repeat(texts, -(-lengths[texts] // half))
    least, out = _minima(short, starts, functions), {}
    for level in range(levels[0], levels[-1] + 1):
        if level > levels[0]:  # two blocks make one of the next level
            firsts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            place = np.arange(len(owner)) - np.repeat(firsts, np.diff(np.concatenate([firsts, [len(owner)]])))
            even = np.flatnonzero(place % 2 == 0)
            least, owner = np.minimum.reduceat(least, even, axis=1), owner[even]
        if level in levels:
            windows = least.copy()
            same = np.flatnonzero(owner[1:] == owner[:-1])
            windows[:, same] = np.minimum(least[:, same], least[:, same + 1])
            signs = _signs(windows, level)
            for k, block in np.argwhere(marked[_places(signs)]):
                out.setdefault(int(owner[block]), []).append(signs[k, block])
    return out


def candidates(docs: DataFrame, known: DataFrame, doc_id: str, text: str, size: int, percent: int, functions: int) -> DataFrame:
    """_row, _id, signs array<long> (minima that some item may have), shingles array<string> (those that some item may have)."""
    levels = sorted(r[0] for r in known.select("level").distinct().collect())  # at most 31
    schema = schema_of("_id long, signs array<long>, shingles array<string>")
    if not levels:
        return docs.sparkSession.createDataFrame([], schema).withColumn("_row", F.lit(0).cast("long"))
    fewest = -(-percent * known.agg(F.min("n")).first()[0] // 100)
    marked = docs.sparkSession.sparkContext.broadcast((_bit_array(_sign_places(known.select(F.explode("signs").alias("s")))), _bit_array(known.select(F.explode("bits").alias("place")))))
    arrow = to_arrow_schema(schema)

    def run(parts):
        of_signs, of_shingles = (np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little").view(bool) for x in marked.value)

        def rows_of(held, ids):
            numbers = shingle_numbers(*word_numbers(held), size)
            for i, signs in _sign_hits(numbers, levels, functions, of_signs).items():
                inside = np.flatnonzero(of_shingles[(numbers[i] & _MASK).astype(np.int64)])
                if len(inside) >= fewest:
                    texts = _texts_of(words(held[i]), size)
                    yield {"_id": ids[i], "signs": np.unique(np.array(signs, np.uint64)).view(np.int64).tolist(), "shingles": sorted({texts[j] for j in inside.tolist()})}

        for part in parts:
            for at in range(0, part.num_rows, SLICE_ROWS):
                ids, texts, done = part.column(0).slice(at, SLICE_ROWS).to_pylist(), part.column(1).slice(at, SLICE_ROWS).to_pylist(), 0
                for held in batches(texts):
                    yield pa.RecordBatch.from_pylist(list(rows_of(held, ids[done:])), schema=arrow)
                    done += len(held)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)
    return rows.withColumn("_row", F.monotonically_increasing_id())


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WORDS, percent: int = PERCENT, functions: int = FUNCTIONS) -> DataFrame:
    """doc_id, item_id, shared, n_item: pairs in which at least ``percent`` of the item's distinct shingles stand in the document."""
    with temporary(docs.sparkSession) as keep:
        known = cut_lineage(item_shingles(items, item_id, item_text, size, functions).withColumn("_entry", F.monotonically_increasing_id()), "bench-items")
        found = cut_lineage(candidates(docs, known, doc_id, text, size, percent, functions), "bench-hits")
        of_items = known.select("_entry", F.explode("signs").alias("_sign"))
        pairs = found.select("_row", F.explode("signs").alias("_sign")).join(of_items, "_sign").select("_row", "_entry").distinct()
        of_docs = found.select("_row", F.col("_id").alias(doc_id), F.col("shingles").alias("_d"))
        full = pairs.join(of_docs, "_row").join(known.select("_entry", F.col("item").alias(item_id), F.col("shingles").alias("_i")), "_entry")
        out = full.select(doc_id, item_id, F.size(F.array_intersect("_i", "_d")).cast("long").alias("shared"), F.size("_i").cast("long").alias("n_item"))
        pairs = out.filter(f"100 * shared >= {percent} * n_item").groupBy(doc_id, item_id).agg(F.max("shared").alias("shared"), F.max("n_item").alias("n_item"))
        return keep(pairs, "bench-pairs")


#: DuckDB: all pairs that share a shingle, counted; words between ASCII white space, A-Z in lower case.
SQL = r"""
WITH cut AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark
), shingles AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [chr(10) || array_to_string(w, ' ')] ELSE [] END) AS s FROM cut
), sizes AS (SELECT id, count(*) AS n_item FROM shingles WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared, any_value(z.n_item) AS n_item
FROM shingles d JOIN shingles b ON d.kind = 0 AND b.kind = 1 AND d.s = b.s JOIN sizes z ON z.id = b.id
GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * any_value(z.n_item)
"""
