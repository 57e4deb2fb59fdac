"""Secret scans: base patterns, and weak parts linked by an interval join within a scope."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import alone, small_batches


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.isalpha() else c for c in word)


#: ASCII letters of the keywords in either case, and no other case folding.
ASSIGN = re.compile(rf"(?:{_either('password')}|{_either('passwd')}|{_either('secret')}|{_either('token')}|{_either('api')}_?{_either('key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Weak parts, which count only beside their complements: identifiers, unlabelled random strings, hosts that take credentials.
WEAK_ACCESS = re.compile(r"(?<![A-Z0-9])(?:ASIA|AGPA|AIDA|AROA)[A-Z0-9]{12,}|\b(?:client|account|access|user)_?id[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._-]{4,}")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}")
URL = re.compile(r"\b(?:https?|s3|jdbc|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>]+")
#: A host of any number of labels, read once from its first letter; it takes credentials if it ends so.
HOST = re.compile(r"(?<![\w.-])[a-z0-9-]++(?:\.[a-z0-9-]++)++(?::[0-9]++)?+(?!\w)")
HOSTS = (".amazonaws.com", ".internal")
SCOPE = re.compile(r"\n[ \t]*\n")
ORDER = ("assign", "access", "hex", "weak_access", "weak_secret", "weak_endpoint")
#: Bits a character that an unlabelled string must have.
MIN_ENTROPY = 3.5
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_weak long"


def _entropy(s: str) -> float:
    return -sum((k := s.count(c) / len(s)) * math.log2(k) for c in set(s))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], ORDER.index(x[2])))


def inside(spans: list[tuple[int, int, str]]):
    """A test whether [a, b) meets one of the spans, by binary search."""
    starts, ends = [a for a, _, _ in spans], []
    for _, b, _ in spans:
        ends.append(max(b, ends[-1]) if ends else b)

    def test(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i > 0 and ends[i - 1] > a

    return test


def endpoints(text: str) -> list[tuple[int, int]]:
    """URLs, and hosts outside them that take credentials."""
    found = [(m.start(), m.end()) for m in URL.finditer(text)] if "://" in text else []
    if any(x in text for x in HOSTS):
        in_url = inside([(a, b, "") for a, b in found])
        found += [(m.start(), m.end()) for m in HOST.finditer(text) if m[0].partition(":")[0].endswith(HOSTS) and not in_url(m.start(), m.end())]
    return sorted(found)


def weak_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak parts whose complements lie in the same scope, however far apart.

    A weak secret needs an identifier in its scope, a weak identifier a secret, an endpoint both. Scopes end at blank lines;
    parts are joined with them by binary search.
    """
    covered = inside(base)
    weak = [(m.start(), m.end(), "weak_access") for m in WEAK_ACCESS.finditer(text) if not covered(m.start(), m.end())]
    if not weak and not any(k == "access" for _, _, k in base):
        return []  # every rule needs an identifier
    weak += [(m.start(), m.end(), "weak_secret") for m in WEAK_SECRET.finditer(text) if not covered(m.start(), m.end()) and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]) and _entropy(m[0]) >= MIN_ENTROPY]
    weak += [(a, b, "weak_endpoint") for a, b in endpoints(text) if not covered(a, b)]
    cuts = [m.start() for m in SCOPE.finditer(text)]
    role = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "access", "weak_access": "access", "weak_endpoint": "endpoint"}
    held: dict[int, set[str]] = {}
    for a, _, kind in [*base, *weak]:
        held.setdefault(bisect_left(cuts, a), set()).add(role[kind])
    needs = {"weak_secret": {"access"}, "weak_access": {"secret"}, "weak_endpoint": {"access", "secret"}}
    return [(a, b, kind) for a, b, kind in weak if needs[kind] <= held[bisect_left(cuts, a)]]


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans by start then kind."""
    base = base_spans(text)
    weak = weak_spans(text, base)
    return base, sorted([*base, *weak], key=lambda x: (x[0], ORDER.index(x[2]))) if weak else base


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mark; the endpoints stay."""
    out, at = [], 0
    for a, b, kind in spans:
        if kind == "weak_endpoint" or b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alone()
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            base, spans = scan(text or "")
            kinds = [k for _, _, k in base]
            rows.append((*(kinds.count(k) for k in ORDER[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_weak"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """A row for each row of docs with its spans in code points; a null text has none.

    The interval join runs where the text is: parts are searched in the sorted scopes, no pairs are made, nothing is
    exchanged, and a long text takes time in proportion. Repeated rows get a row each; other columns are not read; an empty
    table gives no rows.
    """
    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_scan, RESULT)


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alone()
    for batch in batches:
        i, n = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
        texts = [None if t is None else redact(t, scan(t)[1]) for t in batch.column(i).to_pylist()]
        columns = list(batch.columns)
        columns[i] = pa.array(texts, batch.column(i).type)
        if n >= 0 and pa.types.is_integer(batch.column(n).type):
            columns[n] = pa.array([None if t is None else len(t) for t in texts], batch.column(n).type)
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with secrets and linked identifiers replaced in text; every row stays, repeated ones too, a null text stays null.

    A column n_chars of whole numbers is set to match; one of another type, and all other columns, pass through. A long
    text is one row; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_redact, docs.schema)
