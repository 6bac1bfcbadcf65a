"""Operator 5: secrets in texts, by fixed patterns and by a token-efficiency test.

Base kinds (leftmost non-overlapping matches, failing ones dropped afterwards): ``assign``, ``access``
and ``hex``. The method adds ``random``: a run of credential characters that a byte-level BPE
vocabulary spends many tokens on, i.e. with few characters a token, unless it is a digest of known
length, a UUID or another identifier (numbers alone and words joined by ``/ = _ -`` are), or overlaps a base
span. The ratio decides, whatever kinds of characters a run has. Where a run as a whole does not show it,
UUIDs and digests are taken out, and the parts between ``/ = _ -`` and a window over the tokens are judged
on their own, so that a key behind a path, or next to a UUID, is found; its span is the part or the windows.
Runs of 12 to 15 characters are judged if they have digits and letters of both cases, by a lower ratio.

Defined cases: a null text counts as empty and has no spans; rows with a null or repeated doc_id are
scanned like any others, one row out for each row in; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textmill.llm import common

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Runs that may be credentials; those without a letter are numbers.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
LETTER = re.compile(r"[A-Za-z]")
ALL_KINDS = re.compile(r"(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9]+")
CASE = re.compile(r"[a-z](?=[A-Z])")
PART = re.compile(r"[A-Za-z0-9+]{16,}")
HEX_PART = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: UUIDs and digests that stand alone within a run.
HOLE = re.compile(r"(?<![A-Za-z0-9+])(?:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})(?![A-Za-z0-9+])", re.I)
#: Known digests (by their length in hex) and identifiers are no secrets.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I)
UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[_/=-](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))+")
ORDER = {"assign": 0, "access": 1, "hex": 2, "random": 3}
#: Characters a token: long words have more than two, random letters of one case 1.7, random base64 1.3.
MAX_RATIO, BRIEF_RATIO = 2.0, 1.5
#: The same for parts of less than LONG characters, for windows, and for parts of hex digits, whose tokens are longer; separators that a window may hold.
SHORT_RATIO, WINDOW_RATIO, HEX_RATIO, LONG, WINDOW, SEPARATORS = 1.8, 1.6, 2.3, 20, 16, 2


@lru_cache(2)
def encoding(path: str, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def known(run: str) -> bool:
    return bool(DIGEST.fullmatch(run) or UUID.fullmatch(run) or IDENTIFIER.fullmatch(run))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], ORDER[x[2]]))


def mixed(run: str) -> bool:
    """Whether a run has both a digit and a letter, or changes its letters' case time and again."""
    if any(c.isdigit() for c in run):
        return any(c.isalpha() for c in run)
    return len(CASE.findall(run)) >= 3


def dense_windows(run: str, enc, share: float) -> list[tuple[int, int]]:
    """Unions of the token windows of WINDOW characters, with a digit and a letter and few separators, that have few characters a token."""
    ends = [0]
    for t in enc.encode_ordinary(run):
        ends.append(ends[-1] + len(enc.decode_single_token_bytes(t)))
    out: list[tuple[int, int]] = []
    hi = 0
    for lo in range(len(ends)):
        while hi < len(ends) and ends[hi] - ends[lo] < WINDOW:
            hi += 1
        if hi == len(ends):
            break
        a, b = ends[lo], ends[hi]
        if (b - a) / (hi - lo) < WINDOW_RATIO * share and mixed(w := run[a:b]) and sum(c in "/=_-" for c in w) <= SEPARATORS:
            if out and a <= out[-1][1]:
                out[-1] = out[-1][0], b
            else:
                out.append((a, b))
    return out


def inner_spans(run: str, enc, max_ratio: float) -> list[tuple[int, int]]:
    """The parts and windows of a run, between UUIDs and digests, that look random; overlapping ones as one."""
    found, at, share = [], 0, max_ratio / MAX_RATIO
    for lo, hi in [*(m.span() for m in HOLE.finditer(run)), (len(run), len(run))]:
        piece = run[at:lo]
        if len(piece) >= WINDOW:
            for m in PART.finditer(piece):
                if LETTER.search(m[0]) and not known(m[0]):
                    several = mixed(m[0])
                    limit = HEX_RATIO * share if several and HEX_PART.fullmatch(m[0]) else max_ratio if len(m[0]) >= LONG or not several else SHORT_RATIO * share
                    if len(m[0]) / len(enc.encode_ordinary(m[0])) < limit:
                        found.append((at + m.start(), at + m.end()))
            if mixed(piece):
                found += [(at + a, at + b) for a, b in dense_windows(piece, enc, share)]
        at = hi
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


class Taken:
    """Whether a stretch meets one of the spans (sorted by start), by one look-up."""

    def __init__(self, spans: list[tuple[int, int, str]]) -> None:
        self.starts = [a for a, _, _ in spans]
        self.ends = list(accumulate((b for _, b, _ in spans), max))

    def meets(self, lo: int, hi: int) -> bool:
        k = bisect_left(self.starts, hi)
        return k > 0 and self.ends[k - 1] > lo


def random_spans(text: str, base: list[tuple[int, int, str]], enc, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, str]]:
    out, taken = [], Taken(base)
    for m in RUN.finditer(text):
        run = m[0]
        if not LETTER.search(run) or known(run):
            continue
        free = not taken.meets(m.start(), m.end())
        if len(run) < WINDOW:
            if free and ALL_KINDS.fullmatch(run) and len(run) / len(enc.encode_ordinary(run)) < BRIEF_RATIO * max_ratio / MAX_RATIO:
                out.append((m.start(), m.end(), "random"))
            continue
        if free and len(run) >= LONG and mixed(run) and not UUID.search(run) and len(run) / len(enc.encode_ordinary(run)) < max_ratio:
            out.append((m.start(), m.end(), "random"))
            continue
        inner = [(m.start() + a, m.start() + b) for a, b in inner_spans(run, enc, max_ratio)]
        out += [(a, b, "random") for a, b in inner if not taken.meets(a, b)]
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, max_ratio: float = MAX_RATIO, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep, n_assign, n_access, n_hex, n_random, base_sha256, spans and redacted (each span replaced by its kind)."""
    own = default_vocabulary() if vocabulary is None else (vocabulary, pattern)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, rows = encoding(*own), []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            spans = sorted(base + random_spans(text, base, enc, max_ratio), key=lambda x: (x[0], ORDER[x[2]]))
            n = [sum(k == kind for _, _, k in spans) for kind in ORDER]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redact(text, spans)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 3
        cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in keep), *cols], names=["doc_id", *keep, *NAMES])

    d = docs.select("doc_id", *keep, "text")
    schema = ", ".join(f"`{c}` {kind}" for c, kind in d.dtypes[:-1])
    return common.by_batch(d, scan, f"{schema}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, redacted string")


NAMES = ["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "redacted"]


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each maximal run of overlapping spans replaced by its first kind in brackets."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(common.read(spark, sf_dir, "documents")).drop("redacted")
