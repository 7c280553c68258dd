"""Secret scans with one combined automaton for all rules (see ``automaton``).

Least lengths are checked after the match, so a failing match is dropped without a second try. Only the
rule for hexadecimal runs counts inside the automaton (its matches are whole runs, which makes it the same):
counters of several classes would multiply the states.

Defined results: a null or empty text has no spans; repeated rows give repeated rows; spans are in code
points, end exclusive; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import DataFrame

from gridwarden.llm.automaton import Scanner
from gridwarden.llm.common import per_row

_KEYS = "password|passwd|secret|token|api_?key"
#: (name, pattern, letters in either case, least bytes of a match or of an assignment's value). The first three
#: are the base rules, in the listed order.
BASE = ("assign", "access", "hex")
RULES: tuple[tuple[str, str, bool, int], ...] = (
    ("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, 8),
    ("access", r"AKIA[A-Z0-9]+", False, 16),
    ("hex", r"[0-9a-f]{32,}", False, 32),
    ("private_key", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----", False, 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 40),
    ("prefixed", r"(gh[pousr]_[A-Za-z0-9]+|xox[abprs]-[A-Za-z0-9-]+|sk_live_[A-Za-z0-9]+|AIza[A-Za-z0-9_-]+)", False, 24),
)


@lru_cache(maxsize=4)
def scanner_of(rules: tuple[tuple[str, str, bool, int], ...]) -> Scanner:
    return Scanner({name: (pattern, any_case) for name, pattern, any_case, _ in rules})


def _measured(kind: str, match: bytes) -> int:
    """Bytes of a match; of an assignment, those of its value: behind the first sign, spaces and one quote."""
    if kind != "assign":
        return len(match)
    sign = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    rest = match[sign + 1 :].lstrip(b" ")
    return len(rest) - (rest[:1] in (b'"', b"'"))


def secret_spans(scanner: Scanner, least: Mapping[str, int], text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of the rules."""
    data = (text or "").encode("utf-8")
    found = [s for s in scanner.spans(data) if _measured(s[0], data[s[1] : s[2]]) >= least[s[0]]]
    if len(text or "") == len(data) or not found:
        return found
    out, bytes_done, chars_done = [], 0, 0
    for kind, a, b in found:
        chars_done += len(data[bytes_done:a].decode("utf-8"))
        bytes_done = a
        out.append((kind, chars_done, chars_done + b - a))  # all rules match ASCII only
    return out


def joined(spans: Sequence[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def find_secrets(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[tuple[str, str, bool, int]] = RULES) -> DataFrame:
    """``keep`` columns, one count per base rule, base_sha256 of the base spans, spans of all rules.

    Rules beyond the base ones add spans; they never take one away.
    """
    fixed = tuple(rules)

    def setup():
        scanner, least = scanner_of(fixed), {r[0]: r[3] for r in fixed}

        def one(value):
            spans = secret_spans(scanner, least, value)
            base = [s for s in spans if s[0] in BASE]
            return *[sum(s[0] == kind for s in base) for kind in BASE], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)

        return lambda texts: list(zip(*map(one, texts), strict=True)) or [[]] * 5

    return per_row(df, setup, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", [text], keep)
