"""Secrets in texts: fixed patterns, and strings that pass for random.

Candidates are runs of 20 or more characters that encodings use, with a letter
and a digit. The encoding is inferred from the characters seen. Three tests ask
whether the string could be uniform noise in that alphabet: chi-squared counts,
runs above and below the middle symbol, and lag-1 serial correlation; Fisher's
method makes one p-value of them. Random strings have evenly spread p-values,
words and identifiers small ones, the smaller the longer they are. So in each
stratum of encoding and length the number of random strings is estimated from
the upper half of the p-values, and the lowest p-value is chosen at which the
expected share of non-random strings among those kept is FDR at most. Each
distinct string counts once, however often it is copied, and every stratum
starts from a prior of PRIOR random strings and as many with p under FDR: a
lone string is kept if its p is not suspicious. The price is that about two
non-random strings a stratum, FDR of the prior, can be kept beyond the rule.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import stage

# The base patterns and their least lengths.
ASSIGN = r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "random")

FDR = 0.05
BINS = 200
#: Prior strings of each sort in a stratum: 1 / (1 + PRIOR * (1 - p)) is at most FDR for p up to a half.
PRIOR = 40
LEAST_RANDOM = 20
#: name, pattern of the whole string, symbols in order. The first that fits is taken.
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), _DIGITS + "abcdef"),
    ("base32", re.compile(r"[A-Z2-7]+"), _UPPER + "234567"),
    ("base36", re.compile(r"[0-9a-z]+|[0-9A-Z]+"), _DIGITS + _LOWER),
    ("base62", re.compile(r"[0-9A-Za-z]+"), _DIGITS + _UPPER + _LOWER),
    ("base64", re.compile(r"[0-9A-Za-z+/]+"), _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", re.compile(r"[0-9A-Za-z_-]+"), _UPPER + _LOWER + _DIGITS + "-_"),
)


def infer_encoding(s: str):
    """(name, symbol values, alphabet size) of a candidate, or None for a mixture."""
    for name, pattern, symbols in ENCODINGS:
        if pattern.fullmatch(s):
            body = s.lower() if name in ("hex", "base36") else s
            return name, [symbols.index(c) for c in body], len(symbols)
    return None


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_p(x: list[int], m: int) -> float:
    """Upper tail of the counts' chi-squared, by the cube-root normal approximation."""
    counts = [0] * m
    for v in x:
        counts[v] += 1
    stat = m / len(x) * sum(c * c for c in counts) - len(x)
    k = m - 1
    z = ((stat / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs_p(x: list[int], m: int) -> float:
    """Number of runs of symbols below and above the middle of the alphabet, two-sided."""
    high = [2 * v >= m for v in x]
    a, n = sum(high), len(x)
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    runs = 1 + sum(p != q for p, q in zip(high, high[1:]))
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    return _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial_p(x: list[int], m: int) -> float:
    """Lag-1 correlation of the symbol values, two-sided."""
    n, mean = len(x), sum(x) / len(x)
    d = [v - mean for v in x]
    var = sum(v * v for v in d)
    if var == 0:
        return 0.0
    r = sum(p * q for p, q in zip(d, d[1:])) / var
    return _normal_tail((r + 1 / n) * math.sqrt(n))


def randomness_p(x: list[int], m: int) -> float:
    """Fisher's combination of the three tests."""
    half = -sum(math.log(max(t(x, m), 1e-300)) for t in (chi_squared_p, runs_p, serial_p))
    return math.exp(-half) * (1 + half + half * half / 2)


_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_RANDOM},}}")
_ASSIGN, _ACCESS = re.compile(ASSIGN), re.compile(ACCESS)
_HEX = re.compile(HEX.replace("+", f"{{{LEAST['hex']},}}"))  # the same matches: runs are maximal
_WORDS = ("password", "passwd", "secret", "token", "api")


def find_spans(text: str) -> list[tuple]:
    """(kind, start, end, stratum, p) of base matches and of random candidates that touch none."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", *m.span(), None, None) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", *m.span(), None, None) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [("hex", *m.span(), None, None) for m in _HEX.finditer(text)]
    base = [x[1:3] for x in out]
    for m in _CANDIDATE.finditer(text):
        s = m[0]
        if s.isalpha() or not any(c.isdigit() for c in s) or s.isdigit():
            continue
        if any(a < m.end() and m.start() < b for a, b in base) or not (kind := infer_encoding(s)):
            continue
        out.append(("random", *m.span(), f"{kind[0]}:{len(s).bit_length()}", randomness_p(*kind[1:])))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


_SPANS = "array<struct<kind:string,start:long,end:long,stratum:string,p:double,key:string>>"


def _keyed_spans(text: str) -> list[dict]:
    """The spans with ``key``, a hash of the string of a random candidate."""
    return [dict(zip(("kind", "start", "end", "stratum", "p"), x), key=xxhash.xxh3_128_hexdigest(text[x[1]:x[2]]) if x[0] == "random" else None)
            for x in find_spans(text)]


def _scan(batches):
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.string()), ("p", pa.float64()), ("key", pa.string())])
    for batch in batches:
        spans = [_keyed_spans(str(t)) if t.is_valid else [] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], names=["id", "spans"])


def thresholds(counts: dict[str, list[int]]) -> dict[str, float]:
    """Least p-value kept in each stratum, from histograms of BINS equal bins."""
    out, low = {}, int(FDR * BINS)
    for stratum, found in counts.items():
        bins = [n + PRIOR / BINS + (PRIOR / low if i < low else 0) for i, n in enumerate(found)]
        random = 2 * sum(bins[BINS // 2:])
        out[stratum] = 1.0
        for t in range(BINS):
            kept = sum(bins[t:])
            if kept and 1 - min(random * (1 - t / BINS), kept) / kept <= FDR:
                out[stratum] = t / BINS
                break
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans), one row per row of ``docs``; spans are (kind, start,
    end, p) by start, in code points, end exclusive. Kinds ``assign``,
    ``access`` and ``hex`` are the fixed patterns; ``random`` are strings kept
    by the false-discovery rule, which never overlap a fixed one. Null and
    empty texts have no spans; repeated rows and null ids are kept as they are.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = stage(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scan, f"id {kind}, spans {_SPANS}"), "spans")
    p = found.select(F.explode("spans").alias("s")).where("s.kind = 'random'").select("s.stratum", "s.key", F.least(F.floor(F.col("s.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    p = p.distinct()  # a string once, however often it is copied
    counts: dict[str, list[int]] = {}
    for stratum, b, n in p.groupBy("stratum", "bin").count().collect():  # encodings x length bins x BINS at most
        counts.setdefault(stratum, [0] * BINS)[b] = n
    least = F.create_map(*[F.lit(x) for kv in sorted(thresholds(counts).items()) for x in kv]) if counts else F.create_map().cast("map<string,double>")
    kept = F.filter("spans", lambda s: (s["kind"] != "random") | (s["p"] >= F.coalesce(F.element_at(least, s["stratum"]), F.lit(2.0))))
    kept = F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["p"].alias("p")))
    return found.select(F.col("id").alias(id_col), kept.alias("spans"))


def span_text(spans):
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
