"""Language by rank-order profiles: the most frequent n-grams of a text against those of each language.

A profile lists a language's ``profile_size`` most frequent n-grams (of 1 to 3 letters, word boundaries
as blanks) by falling count, ties by the n-gram. A text's list is compared by the out-of-place measure: the sum of the
differences in rank, ``profile_size`` for an n-gram the profile lacks. The smallest distance wins, ties by
name. The score is 1 less the distance over the largest possible one.

Counts run over all training texts: each task counts per language with sorted arrays, sends its counts, and
only languages x profile_size rows reach the driver.

Defined results: a null text, one without a letter, or a corpus without training rows gives ``und`` and
score 0; a null id counts as remainder 0; repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gridwarden.llm.common import SLICE_ROWS, per_row, schema_of

UNKNOWN = "und"
PROFILE_SIZE = 400
GRAM = 3
_BLANK = 32
#: Distinct n-grams a task may hold for a language before it sends their counts.
_HELD = 500_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Per code point: the code point if it is a letter, else a blank."""
    return np.array([i if chr(i).isalpha() else _BLANK for i in range(sys.maxunicode + 1)], np.uint64)


def grams(text: str, gram: int = GRAM) -> np.ndarray:
    """All n-grams of 1 to ``gram`` (at most 3) signs as 64-bit numbers, 21 bits a sign; none that is blank alone."""
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = codes == _BLANK
    codes = codes[~(blank & np.concatenate([[True], blank[:-1]]))] if len(codes) else codes
    if not len(codes):
        return codes
    codes = np.concatenate([[np.uint64(_BLANK)], codes] + ([[np.uint64(_BLANK)]] if codes[-1] != _BLANK else []))
    out, grown = [codes[codes != _BLANK]], codes
    for n in range(1, gram):
        grown = (grown[:-1] << np.uint64(21)) | codes[n:]
        out.append(grown)
    return np.concatenate(out)


_COUNTS = schema_of("lang string, gram long, n long")


def gram_counts(df: DataFrame, text: str, lang: str, gram: int = GRAM) -> DataFrame:
    """(lang, gram, n) over all rows with both a text and a language."""
    arrow = to_arrow_schema(_COUNTS)

    def rows(name, keys, counts):
        return pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part, by = batch.slice(at, SLICE_ROWS), {}
                for value, name in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by.setdefault(name, []).append(value)
                for name, texts in by.items():
                    keys, counts = np.unique(grams("\n".join(texts), gram), return_counts=True)
                    if name in held:
                        both = np.concatenate([held[name][0], keys])
                        keys, where = np.unique(both, return_inverse=True)
                        counts = np.bincount(where, np.concatenate([held[name][1], counts])).astype(np.int64)
                    held[name] = keys, counts
                    if len(keys) > _HELD:
                        yield rows(name, *held.pop(name))
        for name, (keys, counts) in held.items():
            yield rows(name, keys, counts)

    chosen = df.filter(F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{text}`").alias("_text"), F.col(f"`{lang}`").alias("_lang"))
    return chosen.mapInArrow(run, _COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Profiles:
    """Ranks of the n-grams of all languages, as one sorted array and one row of ranks a language."""

    def __init__(self, lists: dict[str, list[int]], size: int):
        self.size = size
        self.names = sorted(name for name, keys in lists.items() if keys)
        self.keys = np.unique(np.array([k for name in self.names for k in lists[name]], np.uint64))
        self.ranks = np.full((len(self.names), len(self.keys)), -1, np.int64)
        for i, name in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.keys, np.array(lists[name], np.uint64))] = np.arange(len(lists[name]))

    def predict(self, text: str | None, gram: int = GRAM) -> tuple[str, float]:
        found = grams(text or "", gram)
        if not len(found) or not self.names:
            return UNKNOWN, 0.0
        keys, counts = np.unique(found, return_counts=True)
        keys = keys[np.argsort(-counts, kind="stable")[: self.size]]
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        ranks = self.ranks[:, place]
        off = np.where((ranks >= 0) & (self.keys[place] == keys), np.abs(ranks - np.arange(len(keys))), self.size)
        distance = off.sum(axis=1)
        best = int(distance.argmin())
        return self.names[best], 1.0 - float(distance[best]) / (self.size * len(keys))


def learn_profiles(df: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE, gram: int = GRAM) -> Profiles:
    """Profiles of all languages in ``df``; the driver gets at most ``size`` rows a language."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = gram_counts(df, text, lang, gram).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= size)
    lists: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "gram", "_rank").collect(), key=lambda r: (r["lang"], r["_rank"])):
        lists.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(lists, size)


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, profiles: Profiles, text: str = "text", keep: Sequence[str] = ("doc_id",), gram: int = GRAM) -> DataFrame:
    """``keep`` columns, lang_pred, score (0 to 1)."""

    def setup():
        return lambda texts: list(zip(*[profiles.predict(t, gram) for t in texts], strict=True)) or [[], []]

    return per_row(df, setup, "lang_pred string, score double", [text], keep)


def learn_and_identify(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Profiles from the rows that are not held out; predictions, from the text alone, for all rows."""
    profiles = learn_profiles(df.filter(~held_out(doc_id)), text, lang)
    return identify(df, profiles, text, keep)
