"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

The base patterns give spans that stay as they are. The nodes of a document's field are those spans, with
their kinds observed, and the free candidates between them: chunks of digits and tokens with an at sign.
Neighbouring nodes share chain potentials; nodes with the same or a similar value (equal last nine digits,
equal mailbox and host name) share skip potentials, however far apart. Loopy sum-product messages, with
damping, make labels of one value agree through the document; a free candidate becomes a span if its
marginal reaches ``least_marginal``.

Fitting is piecewise: a weighted multinomial regression for the nodes, smoothed log ratios for the two kinds of
edges. Its input are counts over all documents of discrete feature vectors and label pairs, at most
``_FEATURES`` x labels and twice labels squared rows, whatever the corpus. Patterns miss things, so
"no entity" is a noisy label: node scores are held within ``clip``.

Each node links to the next one with its key only, so a value that repeats n times makes n - 1 edges.

Defined results: a null text counts as empty; repeated rows give repeated rows; an empty table fits a field
of zero weights and gives no rows; spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gridwarden.llm.common import SLICE_ROWS, per_row, schema_of

#: Kinds in the listed order; label 0 is "no entity".
KINDS = ("email", "ip", "card", "phone")
_L = len(KINDS) + 1

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins: the look-behind keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# a chunk that a letter follows is none, nor is any part of it: it is passed over as a whole, so none is read twice
_CHUNK = re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20().:/-]{0,2}[0-9])*+")
_LETTER = re.compile(r"[0-9A-Za-z]")
_AT = re.compile(r"[^\s@]{0,64}@[^\s@]{1,255}")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed and then start; linear in the text."""
    out = []
    before, free = 0, 0
    at = text.find("@")
    while at >= 0:
        # the part before the sign is the whole run of its characters, not before the last match's end
        low = max(before, free)
        start = low + len(text[low:at].rstrip(_LOCAL))
        if start < at and (host := _HOST.match(text, at + 1)):
            out.append(("email", start, host.end()))
            free = host.end()
        before = at + 1
        at = text.find("@", max(before, free))
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- the field's nodes and edges -------------------------------------------------------------------


def _features(value: str) -> tuple[int, ...]:
    """Discrete features of a node: digit count band, at sign, plus, four dotted parts, checksum, separators."""
    digits = _digits(value)
    band = sum(len(digits) >= n for n in (1, 7, 9, 11, 13, 16, 20))
    return band, int("@" in value), int(value[:1] == "+"), int(value.count(".") == 3), int(13 <= len(digits) <= 19 and _luhn(digits)), int(any(c in value for c in " ()-"))


_SIZES = (8, 2, 2, 2, 2, 2)
_FEATURES = int(np.prod(_SIZES))


def _design(features: np.ndarray) -> np.ndarray:
    """Feature vectors as indicator columns behind a constant one."""
    return np.hstack([np.ones((len(features), 1))] + [np.eye(n)[features[:, i]] for i, n in enumerate(_SIZES)])


def _key(value: str) -> str | None:
    """Values with the same key are the same or similar."""
    if "@" in value:
        box, _, host = value.lower().strip(".,;:!?()[]<>\"'").partition("@")
        return f"{box}@{host.partition('.')[0]}"
    digits = _digits(value)
    return digits[-9:] if len(digits) >= 7 else None


def nodes_of(text: str, base: Sequence[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label): base spans with their labels, free candidates (label -1) that touch none of them, by start."""
    held = sorted((a, b, KINDS.index(kind) + 1) for kind, a, b in base)
    kept = []
    for a, b, label in held:  # of spans that overlap, the first stands for both
        if not kept or a >= kept[-1][1]:
            kept.append((a, b, label))
    found = [m.span() for m in _CHUNK.finditer(text) if m.end() - m.start() >= 7 and not _LETTER.match(text, m.end())] if _DIGIT.search(text) else []
    if "@" in text:
        found += [m.span() for m in _AT.finditer(text)]
    out, i, end = list(kept), 0, -1
    for a, b in sorted(found):
        while i < len(kept) and kept[i][1] <= a:
            i += 1
        if a >= end and not (i < len(kept) and kept[i][0] < b):
            out.append((a, b, -1))
            end = b
    return sorted(out)


def edges_of(text: str, nodes: Sequence[tuple[int, int, int]], reach: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges of neighbours within ``reach`` characters; skip edges to the next node with the same key."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= reach]
    last: dict[str, int] = {}
    skip = []
    for i, (a, b, _) in enumerate(nodes):
        key = _key(text[a:b])
        if key is not None:
            if key in last:
                skip.append((last[key], i))
            last[key] = i
    return chain, skip


# --- fitting ---------------------------------------------------------------------------------------

REACH = 40
_COUNTS = schema_of("part string, features array<int>, first int, second int, n long")


def field_counts(df: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """Counts over all documents: of (features, label) per node, of (label, label) per chain and observed skip edge."""
    arrow = to_arrow_schema(_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for value in batch.column(0).slice(at, SLICE_ROWS).to_pylist():
                    if not value or not ("@" in value or _DIGIT.search(value)):
                        continue
                    nodes = nodes_of(value, base_spans(value))
                    labels = [max(0, n[2]) for n in nodes]
                    counts.update(("node", _features(value[a:b]), k, 0) for (a, b, _), k in zip(nodes, labels, strict=True))
                    chain, skip = edges_of(value, nodes, reach)
                    counts.update(("chain", (), labels[i], labels[j]) for i, j in chain)
                    counts.update(("skip", (), labels[i], labels[j]) for i, j in skip if labels[i] and labels[j])
        yield pa.RecordBatch.from_pylist([{"part": p, "features": list(f), "first": a, "second": b, "n": n} for (p, f, a, b), n in counts.items()], schema=arrow)

    return df.select(F.col(f"`{text}`").alias("_text")).mapInArrow(run, _COUNTS).groupBy("part", "features", "first", "second").agg(F.sum("n").alias("n"))


class Field:
    """Weights of nodes and log potentials of the two kinds of edges."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip


def _ratio(pairs: np.ndarray) -> np.ndarray:
    """Symmetric log ratio of pair counts to what independent labels would give."""
    both = pairs + pairs.T
    share = both / both.sum()
    one = share.sum(axis=1)
    return np.log(share / np.outer(one, one))


def fit_field(counts: list, steps: int = 400, rate: float = 0.5, penalty: float = 1e-3, agree: float = 99.0) -> Field:
    """Field from the counted rows. ``agree`` is the prior count of skip edges with equal labels, against 1 of unequal."""
    rows = [r for r in counts if r["part"] == "node"]
    chain, skip = np.ones((_L, _L)), np.ones((_L, _L)) + np.eye(_L) * (agree - 1)
    for r in counts:
        if r["part"] != "node":
            (chain if r["part"] == "chain" else skip)[r["first"], r["second"]] += r["n"]
    weights = np.zeros((1 + sum(_SIZES), _L))
    if rows:
        rows.sort(key=lambda r: (list(r["features"]), r["first"]))
        x, n = _design(np.array([r["features"] for r in rows])), np.array([r["n"] for r in rows], float)
        y = np.eye(_L)[[r["first"] for r in rows]]
        n /= n.sum()
        for _ in range(steps):
            score = x @ weights
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            weights -= rate * (x.T @ ((p - y) * n[:, None]) + penalty * weights)
    logs = np.log(skip + skip.T)
    return Field(weights, np.clip(_ratio(chain), -2, 2), logs - logs.max())


# --- inference -------------------------------------------------------------------------------------


def _normal(logs: np.ndarray) -> np.ndarray:
    top = logs.max(axis=-1, keepdims=True)
    return logs - top - np.log(np.exp(logs - top).sum(axis=-1, keepdims=True))


def marginals(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray, rounds: int, damping: float) -> np.ndarray:
    """Log marginals by loopy sum-product. ``edges`` (m x 2), ``potentials`` (m x labels x labels, first end first)."""
    if not len(edges):
        return _normal(unary)
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    both = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
    m = len(edges)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    messages = np.zeros((2 * m, unary.shape[1]))
    belief = unary
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, target, messages)
        out = (belief[source] - messages[back])[:, :, None] + both
        top = out.max(axis=1, keepdims=True)
        new = _normal((top + np.log(np.exp(out - top).sum(axis=1, keepdims=True)))[:, 0, :])
        change = np.abs(new - messages).max()
        messages = damping * messages + (1 - damping) * new
        if change < 1e-4:
            break
    belief = unary.copy()
    np.add.at(belief, target, messages)
    return _normal(belief)


def added_spans(text: str, base: Sequence[tuple[str, int, int]], field: Field, reach: int = REACH, rounds: int = 30, damping: float = 0.3, clip: float = 2.0, least_marginal: float = 0.9) -> list[tuple[str, int, int]]:
    """Spans of free candidates whose most likely label is an entity with at least the given marginal."""
    nodes = nodes_of(text, base)
    if all(n[2] >= 0 for n in nodes):
        return []
    scores = _design(np.array([_features(text[a:b]) for a, b, _ in nodes])) @ field.weights
    unary = _normal(np.clip(scores - scores.mean(axis=1, keepdims=True), -clip / 2, clip / 2))
    for i, (_, _, label) in enumerate(nodes):
        if label >= 0:
            unary[i] = -50.0
            unary[i, label] = 0.0
    chain, skip = edges_of(text, nodes, reach)
    edges = np.array(chain + skip, dtype=np.int64).reshape(-1, 2)
    potentials = np.concatenate([np.repeat(field.chain[None], len(chain), 0), np.repeat(field.skip[None], len(skip), 0)])
    logs = marginals(unary, edges, potentials, rounds, damping)
    out = []
    for (a, b, label), row in zip(nodes, logs, strict=True):
        best = int(row.argmax())
        if label < 0 and best and row[best] >= np.log(least_marginal):
            out.append((KINDS[best - 1], a, b))
    return out


# --- on tables -------------------------------------------------------------------------------------


def joined(spans: Sequence[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def masked(text: str, spans: Sequence[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union is replaced once."""
    parts, end = [], 0
    for a, b, kind in sorted((a, b, kind) for kind, a, b in spans):
        if a >= end:
            parts += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*parts, text[end:]])


def learn_field(df: DataFrame, text: str = "text") -> Field:
    """Field fitted on counts over all rows (a few hundred rows reach the driver)."""
    return fit_field(field_counts(df, text).collect())


def find_personal_data(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), field: Field | None = None, with_masked: bool = False) -> DataFrame:
    """``keep`` columns, one count per kind of base span, base_sha256 of the base spans, spans (base and added).

    ``with_masked`` adds ``masked``, the text with all spans replaced (null stays null).
    """
    known = field or learn_field(df, text)

    def setup():
        order = {kind: i for i, kind in enumerate(KINDS)}

        def one(value):
            content = value or ""
            base = base_spans(content) if "@" in content or _DIGIT.search(content) else []
            spans = base
            if content and ("@" in content or _DIGIT.search(content)):
                spans = sorted(base + added_spans(content, base, known), key=lambda s: (order[s[0]], s[1]))
            row = [*[sum(s[0] == kind for s in base) for kind in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)]
            return [*row, masked(value, spans) if spans and value else value] if with_masked else row

        return lambda texts: list(zip(*map(one, texts), strict=True)) or [[]] * (7 if with_masked else 6)

    made = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", masked string" * with_masked
    return per_row(df, setup, made, [text], keep)
