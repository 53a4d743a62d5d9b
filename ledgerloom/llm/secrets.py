"""Secret scans: fixed kinds plus a sliding-window Shannon entropy over candidate strings.

Base kinds (leftmost, not overlapping within a kind):
  assign  a key word, a separator and a value of 6 or more characters; the value is the span
  access  AKIA and capitals or digits, 20 or more characters
  hex     a run of 0-9a-f of 24 or more characters

The entropy scan looks at runs of letters, digits and +/_- of 20 or more characters.  A window
slides over each run; counts of its characters, and from them the entropy, are kept up by one
subtraction and one addition a step.  A run is a secret if its best window passes the
threshold of the run's character class and no allow-list rule suppresses it.

Offsets are code points, end exclusive.  Null texts are empty; texts of any length are scanned
whole; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import byte_texts

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEY_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

WINDOW = 20
#: bits a character that the best window of a run must reach, by the run's class; None: never a secret, as
#: digits alone are numbers of things.  `letters` are of one case but for capitals that begin words, `cased` of two.
THRESHOLDS = {"digits": None, "letters": 4.05, "cased": 3.9, "hex": 3.0, "mixed": 3.7}
#: names out of words of fewer letters than this aren't secrets, whatever their entropy
WORD = 12
#: runs that are never secrets by themselves: fixed values
ALLOWED = [
    re.compile(rb"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(rb"(?i).*(example|placeholder|changeme|xxxx|your[_-]?(key|token)).*"),
    re.compile(rb"[0-9]+([/_+-][0-9]+)*"),
]
#: letters, perhaps in several words, with a few digits at the end: held to the thresholds of letters
WORDS = re.compile(rb"[A-Za-z]+([/_+-][A-Za-z]+)*[/_-]?[0-9]{0,4}")

_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_RUN = np.zeros(256, bool)
_RUN[[*b"0123456789+/_-", *range(65, 91), *range(97, 123)]] = True
_LOG = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def runs(data: np.ndarray, members: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of member bytes that are `least` long or longer."""
    inside = np.concatenate(([False], members[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def letters_of(run: bytes) -> str:
    """Whether capitals stand within words, not only where one begins."""
    inner = sum(65 <= b <= 90 and 97 <= a <= 122 for a, b in zip(run, run[1:], strict=False))
    return "cased" if inner >= 3 else "letters"


def class_of(run: bytes) -> str:
    digits = sum(48 <= c <= 57 for c in run)
    if digits == 0:
        return letters_of(run)
    if digits == sum(c not in b"+/_-" for c in run):
        return "digits"
    return "hex" if all(c in b"0123456789abcdefABCDEF" for c in run) else "mixed"


def best_entropy(run: bytes, window: int = WINDOW) -> float:
    """Highest Shannon entropy, in bits a character, of any window of the run."""
    window = min(window, len(run))
    if not window:
        return 0.0
    counts = [0] * 256
    total = 0.0  # sum of n log n over the counts
    best = 0.0
    for i, c in enumerate(run):
        if i >= window:
            old = run[i - window]
            total += _LOG[counts[old] - 1] - _LOG[counts[old]]
            counts[old] -= 1
        total += _LOG[counts[c] + 1] - _LOG[counts[c]]
        counts[c] += 1
        if i >= window - 1:
            best = max(best, math.log2(window) - total / window)
    return best


def is_secret_run(run: bytes) -> bool:
    kind = class_of(run)
    if WORDS.fullmatch(run):
        if max(map(len, re.split(rb"[^A-Za-z]+", run))) < WORD:
            return False
        kind = letters_of(run)
    least = THRESHOLDS[kind]
    return least is not None and best_entropy(run) >= least and not any(p.fullmatch(run) for p in ALLOWED)


def find(text: str, data: bytes) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, by start, then by kind as listed in KINDS."""
    spans = []
    low = data.lower()
    if any(k in low for k in KEY_WORDS):
        spans += [("assign", *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in data:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    array = np.frombuffer(data, np.uint8)
    found = [("hex", s, e) for s, e in runs(array, _HEX, 24)]
    found += [("entropy", s, e) for s, e in runs(array, _RUN, WINDOW) if is_secret_run(data[s:e])]
    if found and len(data) != len(text):  # from bytes to code points
        begins = np.cumsum((array & 0xC0) != 0x80)
        found = [(k, int(begins[s]) - 1, int(begins[s]) - 1 + e - s) for k, s, e in found]
    base = spans + [f for f in found if f[0] == "hex"]
    spans = base + [f for f in found if f[0] == "entropy" and not any(s < f[2] and f[1] < e for _, s, e in base)]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column and `spans` array<struct<kind, start, end>>."""
    rows = df.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = [
                [dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(d.decode(), d)]
                for d in byte_texts(b.column(1))
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], [id_col, "spans"])

    return rows.mapInArrow(
        run, f"{id_col} {dict(rows.dtypes)[id_col]}, spans array<struct<kind: string, start: long, end: long>>"
    )


def report(df: DataFrame) -> DataFrame:
    """Counts by kind and digests of the spans, for every document."""
    rows = df.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            sums, all_spans = [], []
            for d in byte_texts(b.column(1)):
                spans = find(d.decode(), d)
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in spans))
                sums.append(hashlib.sha256(joined([s for s in spans if s[0] != "entropy"]).encode()).hexdigest())
                all_spans.append(joined(spans))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(sums), pa.array(all_spans)],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return rows.mapInArrow(
        run,
        f"doc_id {dict(rows.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, n_entropy long,"
        " base_sha256 string, spans string",
    )


def redact(df: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The input with every secret in `text` replaced by a mark and `n_chars`, if there, set anew.

    Overlapping spans are replaced together.  Rows without secrets are returned unchanged.
    """
    at = df.columns.index("text")
    chars = df.columns.index("n_chars") if "n_chars" in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            lengths = b.column(chars).to_pylist() if chars is not None else []
            for i, t in enumerate(texts):
                out, done, hits = [], 0, False
                for _, s, e in find(t, t.encode()) if t else ():
                    if s >= done:
                        out += [t[done:s], mark]
                    done, hits = max(done, e), True
                if hits:
                    texts[i] = "".join([*out, t[done:]])
                    if lengths:
                        lengths[i] = len(texts[i])
            columns = list(b.columns)
            columns[at] = pa.array(texts, columns[at].type)
            if lengths:
                columns[chars] = pa.array(lengths, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return df.mapInArrow(run, df.schema)
