"""Secrets in texts: fixed patterns, and windows of high Shannon entropy over candidate strings.

A candidate is a run of token characters. Within it, every run of one character class is read by a window whose
entropy is kept up by counts: one character enters, one leaves. The window has a fixed width; a run that is shorter,
down to the least length, is one window, and the threshold falls with the logarithm of its width. If any window is at
or above the class's threshold, the whole candidate is a span of the kind ``entropy``, unless the allow-list fits it.
Of a span that a pattern has found in part, the rest stays a span, unless it is a name that the allow-list fits and a
separator sets apart (``my_`` before ``token=``).

A null text is empty and has no spans; repeated rows give repeated results; other columns are not read. Spans
are in code points, the end exclusive, ordered by start, then by kind as in :data:`KINDS`.
"""

from __future__ import annotations

import re
from math import log2

from pyspark.sql import DataFrame, functions as F

from strata.llm.text import SPANS, map_columns, map_text

KINDS = ("assign", "access", "hex", "entropy")

# The patterns and least lengths of the base rules. Letters of the keywords in either ASCII case only.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
BASE = {
    "assign": (r"(KEYWORD)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}

#: Character classes with the least entropy, in bits, of a whole window. About one in twenty random strings of a class
#: and of a window's width is below it.
CLASSES = {"hex": (r"[0-9a-f]+", 3.0), "upper": (r"[A-Z0-9]+", 3.5), "base64": (r"[A-Za-z0-9+/_=-]+", 3.75)}
WINDOW = 20
#: Characters of the shortest candidate and run.
LEAST = 16
SEPARATORS = set("/+_=-")
PLACEHOLDER = "EXAMPLE|Example|example|PLACEHOLDER|Placeholder|placeholder"
#: Words of plausible length: of one case, or Capitalised ones in a row, the first in lower case or not (camelCase).
WORD = r"(?:[A-Z]{1,24}|(?:[a-z]{1,24}|[A-Z][a-z]{2,23}|[A-Z][a-z]?(?![A-Za-z]))(?:[A-Z][a-z]{2,23})*+)"
#: Candidates that are no secrets: numbers, words with one number before or after, dates, what begins or ends as a
#: placeholder, paths of words.
ALLOWED = (
    r"[0-9+/_=-]+",
    rf"[0-9]*{WORD}?[0-9]*",
    rf"(?:{PLACEHOLDER}).*|.*(?:{PLACEHOLDER})(?:KEY|Key|key)?",
    rf"(?:{WORD}?[0-9]{{0,6}}[/_=-])*{WORD}?[0-9]{{0,6}}",
)


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORD = "|".join(map(_either_case, KEYWORDS))
PATTERNS = {kind: (re.compile(p.replace("KEYWORD", KEYWORD)), group, least) for kind, (p, group, least) in BASE.items()}
# Runs shorter than the least length are never wanted, so the engine may skip them.
PATTERNS["hex"] = (re.compile(r"[0-9a-f]{32,}"), 0, 32)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base rules."""
    found = []
    for place, kind in enumerate(KINDS[:-1]):
        pattern, group, least = PATTERNS[kind]
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), place, m.end()))
    return sorted(found)


def high_entropy(run: str, window: int, threshold: float) -> list[tuple[int, int]]:
    """Joined windows of ``run`` with at least ``threshold`` bits.

    With counts c over the window, the entropy is log2(window) - sum(c * log2(c)) / window; only the counts of
    the characters that enter and leave change.
    """
    if len(run) < window:
        return []
    weight = [0.0] + [c * log2(c) for c in range(1, window + 2)]  # one enters before one leaves
    most = (log2(window) - threshold) * window + 1e-9
    counts: dict[str, int] = {}
    total, found = 0.0, []
    for at, c in enumerate(run):
        n = counts.get(c, 0)
        total += weight[n + 1] - weight[n]
        counts[c] = n + 1
        if at >= window:
            gone = run[at - window]
            n = counts[gone]
            total += weight[n - 1] - weight[n]
            counts[gone] = n - 1
        start = at - window + 1
        if start >= 0 and total <= most:
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], at + 1)
            else:
                found.append((start, at + 1))
    return found


def outside(spans: list[tuple[int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What is left of the ordered, disjoint ``spans`` without the places ``taken``."""
    covered: list[list[int]] = []
    for a, b in sorted((s, e) for s, _, e in taken):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(b, covered[-1][1])
        else:
            covered.append([a, b])
    out, i = [], 0
    for a, b in spans:
        while i < len(covered) and covered[i][1] <= a:
            i += 1
        k = i
        while k < len(covered) and covered[k][0] < b:
            if a < covered[k][0]:
                out.append((a, covered[k][0]))
            a = max(a, covered[k][1])
            k += 1
        if a < b:
            out.append((a, b))
    return out


class Scanner:
    def __init__(self, classes=CLASSES, window=WINDOW, allowed=ALLOWED):
        self.classes = [(re.compile(p), limit) for p, limit in classes.values()]
        self.window, self.least = window, min(LEAST, window)
        self.candidate = re.compile(rf"[A-Za-z0-9+/_=-]{{{self.least},}}")
        self.allowed = re.compile("|".join(f"(?:{p})" for p in allowed)) if allowed else None

    def entropy_spans(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        found = []
        for m in self.candidate.finditer(text):
            word = m.group()
            if self.allowed and self.allowed.fullmatch(word):
                continue
            if any(self.high(run.group(), limit) for pattern, limit in self.classes for run in pattern.finditer(word)):
                found.append(m.span())
        starts, ends = {s for s, _, _ in taken}, {e for _, _, e in taken}
        left = outside(found, taken)
        return [(a, len(KINDS) - 1, b) for a, b in left if not self.named(text, a, b, starts, ends)]

    def high(self, run: str, limit: float) -> bool:
        """Whether a window of ``run``, or the run itself if it is shorter, reaches the threshold of its width."""
        width = min(len(run), self.window)
        return width >= self.least and bool(high_entropy(run, width, limit * log2(width) / log2(self.window)))

    def named(self, text: str, start: int, end: int, starts: set[int], ends: set[int]) -> bool:
        """Whether what a base span left of a candidate is only a name before or after it, apart by a separator."""
        beside = [text[end - 1]] * (end in starts) + [text[start]] * (start in ends)
        return bool(beside and self.allowed and set(beside) <= SEPARATORS and self.allowed.fullmatch(text, start, end))

    def spans(self, text: str) -> tuple[list, list]:
        base = base_spans(text)
        return base, sorted(base + self.entropy_spans(text, base))


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with every joined span replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _named(spans):
    return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]


def find_secrets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes=CLASSES, window: int = WINDOW, allowed=ALLOWED
) -> DataFrame:
    """``id_col``, ``base`` and ``spans`` (arrays of kind, start, end) of every whole text."""
    scanner = Scanner(classes, window, allowed)

    def run(ids, texts):
        found = [scanner.spans(t or "") for t in texts]
        return {id_col: ids, "base": [_named(b) for b, _ in found], "spans": [_named(s) for _, s in found]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, text_col), run, f"`{id_col}` {kind}, base {SPANS}, spans {SPANS}")


def redact(
    df: DataFrame, mark: str = "[SECRET]", text_col: str = "text", classes=CLASSES, window: int = WINDOW, allowed=ALLOWED
) -> DataFrame:
    """The rows of ``df``, all columns, with every secret in the text replaced by ``mark``; null texts stay null."""
    scanner = Scanner(classes, window, allowed)

    def clean(text):
        return text if text is None else redacted(text, scanner.spans(text)[1], mark)

    return map_text(df.select(F.struct("*").alias("_row")), df.schema, text_col, clean)
