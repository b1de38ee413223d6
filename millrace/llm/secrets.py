"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty for what no pattern knows.

A candidate is a run of at least 16 secret-like characters (letters with three digits, or a digit and letters of both
cases) in a sensitive context: a part of an identifier such as ``key`` or ``bearer`` (whole parts only, so neither
``monkey`` nor ``author``) that ends at most ``NEAR`` characters before it.  Its novelty is what it adds, in compressed
bytes, to a frame whose compressor was primed with a dictionary of identifiers and with the code around the candidate:
names, paths and repeated constants compress away against the two, random strings don't.  Candidates at or above
``MIN_RATIO`` marginal bytes a character are reported as ``novelty``.

The dictionary is learned: parts of identifiers (runs of four or more letters in words that mix letters with digits,
underscores, hyphens or inner capitals), counted over all documents; the ``DICTIONARY`` parts that stand in the most
documents, at least ``PART_DOCUMENTS``.  Parts are too short to carry a secret, even one that many copies repeat.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import as_text

KINDS = ("assign", "access", "hex", "novelty")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 or more in all; shorter runs fail
HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = "key|apikey|secret|token|password|passwd|pwd|credential|bearer|authorization|auth|private|signature|session"
#: Whole parts of identifiers: api_key, apiKey, API-KEY, Authorization; the next letter mustn't go on with the word.
SENSITIVE = re.compile(rf"(?<![A-Za-z])(?i:{_WORDS})(?i:s)?(?![a-z])|(?<=[a-z0-9])(?:{'|'.join(w.capitalize() for w in _WORDS.split('|'))})s?(?![a-z])", re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}", re.ASCII)
#: A word with a digit, an underscore, a hyphen or a capital after its first letters; it is tried once, at its beginning.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_-])[A-Z]*+[a-z]++[A-Z0-9_-][A-Za-z0-9_-]*+|(?<![A-Za-z0-9_-])[A-Z]++[0-9_-][A-Za-z0-9_-]*+", re.ASCII)
#: Of an identifier: a capitalised or lower-case run, or capitals, of four letters or more.
PART = re.compile(r"[A-Z]?[a-z]{4,}|[A-Z]{4,}", re.ASCII)
#: Characters before a candidate in which a sensitive word counts, and on each side that prime the compressor.
NEAR, AROUND = 48, 2048
MIN_RATIO, MIN_BYTES = 0.8, 12
#: Characters above which the compressor also codes letters by their frequency, and the ratio from there on.
LONG, LONG_RATIO = 256, 0.45
#: Parts in the dictionary, and the documents in which one must stand at least.
DICTIONARY, PART_DOCUMENTS = 2000, 3
#: Parts that a task counts before it hands them on.
HELD = 200_000

#: What any dictionary has: alphabets, digits, fillers, common words of code.
ALWAYS = (
    "abcdefghijklmnopqrstuvwxyz 0123456789 0000000000000000 ffffffffffffffff xxxxxxxxxxxxxxxx example localhost return function import class const static "
    "api access auth client config configuration database default environment private public refresh secret service session signature token user password document version final value string number manager handler factory request response connection name"
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost non-overlapping for each kind."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return in_order(spans)


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


@lru_cache(4)
def _dictionary(parts: tuple[str, ...]) -> tuple[str, frozenset[str]]:
    return " ".join([ALWAYS, *parts]), frozenset([*ALWAYS.split(), *parts])


def novelty(candidate: str, before: str, after: str, parts: tuple[str, ...] = ()) -> int:
    """Marginal compressed bytes of the candidate, given its surroundings and the identifiers.

    Cases count alike, as identifiers are written in either.  Whole parts that the dictionary knows are taken out first:
    a reference to so few letters costs the compressor as many bytes as the letters.
    """
    dictionary, known = _dictionary(parts)
    own = PART.sub(lambda m: "" if m[0].lower() in known else m[0], candidate).lower()
    primed = zstandard.ZstdCompressionDict((dictionary + "\n" + (after + "\n" + before).lower()).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compress = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False).compress
    return len(compress(own.encode())) - len(compress(b""))


def _secret_like(own: str) -> bool:
    digits = sum(map(own.count, "0123456789"))
    return bool(re.search("[A-Za-z]", own)) and (digits >= 3 or digits > 0 and own.lower() != own and own.upper() != own)


def novel_spans(text: str, parts: tuple[str, ...] = ()) -> list[tuple[int, int, str]]:
    """One scan for candidates and one for sensitive words, side by side: linear in the text."""
    spans = []
    words = SENSITIVE.finditer(text)
    ahead, last = next(words, None), -NEAR - 1
    if ahead is None:
        return spans
    for c in CANDIDATE.finditer(text):
        a, b = c.span()
        # The last sensitive word that begins before the candidate; one that begins it or stands in it doesn't count.
        while ahead is not None and ahead.end() <= a:
            last, ahead = ahead.end(), next(words, None)
        if a - last > NEAR or not _secret_like(own := c[0]):
            continue
        # What equals the candidate elsewhere nearby must not hide it.
        before, after = (text[max(0, a - AROUND) : a].replace(own, " "), text[b : b + AROUND].replace(own, " "))
        added = novelty(own, before, after, parts)
        if added >= MIN_BYTES and added >= (MIN_RATIO if len(own) <= LONG else LONG_RATIO) * len(own):
            spans.append((a, b, "novelty"))
    return spans


def parts_of(text: str) -> set[str]:
    return {p.lower() for m in IDENTIFIER.finditer(text) for p in PART.findall(m[0])}


def learn(documents: DataFrame, size: int = DICTIONARY, least: int = PART_DOCUMENTS) -> tuple[str, ...]:
    """The identifier parts that stand in the most documents (column text), the commonest last, nearest to what is compressed."""

    def run(batches):
        n: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0):
                for p in parts_of(text.as_py() or ""):
                    n[p] = n.get(p, 0) + 1
            if len(n) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["part", "n"])
                n = {}
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["part", "n"])

    counted = documents.mapInArrow(run, "part string, n long").groupBy("part").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return tuple(r.part for r in counted.orderBy(F.desc("n"), "part").limit(size).collect()[::-1])


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_novelty long, base_sha256 string, spans string"


def scan(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: doc_id, counts by kind, base_sha256 (of the base spans), spans (all, ``kind:start:end``).

    A null or empty text has no span: counts 0, the hash of the empty string, an empty ``spans``.  A null id stays null;
    repeated rows give a row each (and count as often for the dictionary); an empty table gives none; other columns are
    not read.
    """
    rows = documents.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), as_text(text_column).alias("text"))
    parts = learn(rows.select("text"))

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = novel_spans(text, parts)
                n = [sum(k == kind for _, _, k in base + more) for kind in KINDS]
                rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(in_order(base + more))))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(columns))],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_novelty", "base_sha256", "spans"],
            )

    return rows.mapInArrow(run, SCHEMA)
