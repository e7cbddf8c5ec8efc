"""Secret scan of whole texts.

Three fixed patterns give the base spans. On top of them, every candidate string is scanned with a sliding window:
the Shannon entropy of the window is kept up to date from character counts as the window moves by one (one count
goes up, one goes down), per character class with a threshold of its own. Windows above the threshold that touch
become one span. Spans are suppressed where an allow-list says the string is harmless; base spans are never dropped.

Defined results: null and empty texts have no spans. Offsets are code points, ends exclusive. Each row is worked on alone,
so repeated rows give repeated results. Work per text is linear in its length.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, functions as F

from statwitness.llm.common import column, map_rows

# --- fixed values: the base patterns and their least lengths ---
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_HINT = re.compile(r"(?:passw|secret|token|api_?key)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters with the prefix; shorter runs hold no longer match
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
BASE_KINDS = ("assign", "access", "hex")

# --- entropy windows: class, its characters, window, bits per character ---
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9a-fA-F]{20,}"), 20, 2.9),
    ("entropy_alnum", re.compile(r"[A-Za-z0-9]{20,}"), 20, 3.6),
    ("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 3.8),
)
KINDS = BASE_KINDS + tuple(c[0] for c in CLASSES)

# --- allow-list: identifiers and placeholders that are no secrets ---
ALLOW = (
    re.compile(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.IGNORECASE),  # UUID
    re.compile(r"^(?:[a-z]+|[A-Z][a-z]+|[A-Z]+)(?:[-_/](?:[a-z]+|[A-Z][a-z]+|[A-Z]+))*[-_/]?$"),  # words joined by separators
    re.compile(r"^[0-9]+$"),
    re.compile(r"^(.{1,4})\1+.{0,3}$"),  # a short pattern repeated
)
# a span that holds one of these as a whole word is no secret; neither parts of words nor words outside the span count
PLACEHOLDER = re.compile(r"(?<![A-Za-z0-9])(?:example|sample|dummy|placeholder|changeme|lorem|test)(?![A-Za-z0-9])", re.IGNORECASE)


def high_windows(s: str, width: int, bits: float) -> list[tuple[int, int]]:
    """Maximal spans of ``s`` covered by windows whose entropy is at least ``bits``. With counts c of a window of w
    characters the entropy is log2 w - sum(c log2 c) / w; a step changes two terms of the sum."""
    if len(s) < width:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    most = (math.log2(width) - bits) * width + 1e-9
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        total += term[c + 1] - term[c]
        counts[ch] = c + 1
        if i >= width:
            old = s[i - width]
            c = counts[old]
            total += term[c - 1] - term[c]
            counts[old] = c - 1
        if i >= width - 1 and total <= most:
            start = i - width + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def allowed(s: str) -> bool:
    return any(p.search(s) for p in ALLOW)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    out = []
    if ASSIGN_HINT.search(text):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def entropy_spans(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Added spans: not inside a base span, nor inside an added span of an earlier class."""
    taken = [(s, e) for s, _, e in base]
    out = []
    for m in CANDIDATE.finditer(text):
        if allowed(m[0]):
            continue
        words = [w.span() for w in PLACEHOLDER.finditer(text, m.start(), m.end())]
        for kind, members, width, bits in CLASSES:
            for run in members.finditer(m[0]):
                for s, e in high_windows(run[0], width, bits):
                    s, e = s + m.start() + run.start(), e + m.start() + run.start()
                    if allowed(text[s:e]) or any(s <= a and b <= e for a, b in words) or any(a <= s and e <= b for a, b in taken):
                        continue
                    taken.append((s, e))
                    out.append((s, kind, e))
    return out


def scan(text: str | None) -> tuple[list, list]:
    """Base and added spans (start, kind, end), each by start, then kind in the order of ``KINDS``."""
    text = text or ""
    order = {k: i for i, k in enumerate(KINDS)}
    base = base_spans(text)
    return (sorted(base, key=lambda x: (x[0], order[x[1]])),
            sorted(entropy_spans(text, base), key=lambda x: (x[0], order[x[1]])))


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id and ``spans``, an array of (kind, start, end, base)."""

    def fn(ids, texts):
        order = {k: i for i, k in enumerate(KINDS)}
        out = []
        for t in texts:
            base, more = scan(t)
            both = [(s, k, e, True) for s, k, e in base] + [(s, k, e, False) for s, k, e in more]
            both.sort(key=lambda x: (x[0], order[x[1]]))
            out.append([{"kind": k, "start": s, "end": e, "base": b} for s, k, e, b in both])
        return ids, out

    rows = docs.select(column(doc_id).alias("id"), column(text).cast("string").alias("text"))
    id_type = dict(rows.dtypes)["id"]
    return map_rows(rows, fn, ["id", "text"], f"id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones joined, replaced by ``mark``."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])



def summary(found: DataFrame) -> DataFrame:
    """Counts of base kinds, the digest of the base spans and all spans as text."""
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["base"])
    of_kind = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        F.col("id").alias("doc_id"), *[of_kind(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.concat_ws(",", F.transform(base, text)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", text)).alias("spans"))
