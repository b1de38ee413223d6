"""BPE encoding and decoding by tree concatenation.

A text longer than ``LEAF`` characters is cut into leaves, wherever the length says, in words or between them; the leaves
go to the library in one batch and are joined pairwise in a balanced tree.  A join re-encodes a window around the cut
and widens it until a token of the window equals, in id and in characters covered, a token of the left side and one of the
right side.  Shorter texts are encoded by the library too: at ASCII white space, across which this vocabulary never merges, so
that a worker encodes a word that it has met before only once.

Why one agreeing token on each side is enough: a sequence of tokens is the BPE encoding of its text exactly if every two
neighbours are the encoding of their own text.  All neighbours left of the agreeing token were neighbours in the left
side, those from it to the right were neighbours in the window, and likewise on the other end.  Window edges never fall
before a combining character, so normalisation can't reach across them, and tokens near an artificial edge don't count
as agreeing (word ends, contractions and special tokens are decided there by what follows).

Tasks are the parallelism on a cluster, so the library's own threads stay off unless TOKENIZERS_PARALLELISM asks for them.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import as_text, chunks, keeps, serving

#: Characters of a text above which it is cut into leaves of so many, and of the first window on each side of a join.
LEAF, WINDOW = 32768, 64
#: Characters next to an artificial edge in which agreement doesn't count: longer than a special token or contraction.
EDGE = 32
#: Bytes of text that are encoded at once.
BATCH = 1 << 21

#: Words kept by a worker, and most bytes of one; memory stays below about 200 MB.
CACHE, CACHED_BYTES = 500_000, 48

Token = tuple[int, int, int]  # id, first character, end
Entry = tuple[int, bytes, bytes]  # number of ids, ids in decimal by one space, decoded


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(4)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def safe_cut(text: str, at: int) -> int:
    """The nearest place at or before ``at`` where the next character can't combine with what stands before."""
    while at > 0:
        c = text[at]
        if c < "̀" or not (unicodedata.category(c)[0] == "M" or "ᅠ" <= c <= "ᇿ" or "ힰ" <= c <= "퟿" or unicodedata.combining(c)):
            break
        at -= 1
    return at


def _near(side: list[tuple], place: int, right: bool) -> list[tuple[Token, int, int]]:
    """The tokens of a side (a list of spans) from its end, or its beginning, as far as ``place``: with span and number."""
    found = []
    for i in range(len(side) - 1, -1, -1) if right else range(len(side)):
        ids, encoding, shift, first, last = side[i]
        for k in range(last - 1, first - 1, -1) if right else range(first, last):
            a, b = encoding.token_to_chars(k)
            a, b = a + shift, b + shift
            if (b <= place) if right else (a >= place):
                return found
            if a < b:
                found.append(((ids[k], a, b), i, k))
    return found


def encode_long(text: str, encode, leaf: int = LEAF, window: int = WINDOW, edge: int = EDGE) -> list[int]:
    """The ids of a long text: leaves in one batch, then joins, pair by pair, up the tree.

    A side of a join is a list of spans (ids, encoding, first character, first token, end) of leaves and windows; where a token
    stands is only asked for near the cuts.
    """
    cuts = [0]
    while len(text) - cuts[-1] > leaf:
        at = safe_cut(text, cuts[-1] + leaf)
        cuts.append(at if at > cuts[-1] else cuts[-1] + leaf)
        if cuts[-1] >= len(text):
            cuts.pop()
            break
    edges = [*cuts, len(text)]
    level = [(edges[k], edges[k + 1], [_span(e, edges[k])]) for k, e in enumerate(encode([text[a:b] for a, b in zip(edges, edges[1:], strict=False)]))]
    while len(level) > 1:
        joined = []
        for k in range(0, len(level) - 1, 2):
            (a, m, x), (_, b, y) = level[k], level[k + 1]
            joined.append((a, b, join(text, a, m, b, x, y, encode, window, edge)))
        level = joined + level[len(level) & ~1 :]
    return [i for ids, _, _, first, last in level[0][2] for i in ids[first:last]]


def _span(encoding, shift: int) -> tuple:
    return encoding.ids, encoding, shift, 0, len(encoding.ids)


def join(text: str, a: int, m: int, b: int, x: list[tuple], y: list[tuple], encode, window: int = WINDOW, edge: int = EDGE) -> list[tuple]:
    """The spans of text[a:b] from those of text[a:m] and text[m:b]."""
    size = window
    while True:
        lo, hi = max(a, m - size), min(b, m + size)
        lo, hi = (max(a, safe_cut(text, lo)) if lo > a else a), (max(m, safe_cut(text, hi)) if hi < b else b)
        ids, encoding, shift, _, n = _span(encode([text[lo:hi]])[0], lo)
        new = {(i, p + shift, q + shift): k for k, (i, (p, q)) in enumerate(zip(ids, encoding.offsets, strict=True))}
        first, last, left, right = 0, n, [], []
        if lo > a:  # the first token that both have, away from the window's edge
            both = [(new[t], i, k) for t, i, k in _near(x, lo + edge, True) if t in new and t[1] >= lo + edge and t[2] <= m]
            if not both:
                size *= 2
                continue
            first, i, k = min(both)
            left = [*x[:i], (*x[i][:4], k)]
        if hi < b:  # the last one
            both = [(new[t], i, k) for t, i, k in _near(y, hi - edge, False) if t in new and t[2] <= hi - edge and t[1] >= m]
            if not both:
                size *= 2
                continue
            last, i, k = max(both)
            right = [(*y[i][:3], k, y[i][4]), *y[i + 1 :]]
        return [*left, (ids, encoding, shift, first, last), *right]


class Encoder:
    """Encodes texts: long ones as trees of leaves, short ones word by word, with the ids of recent words at hand."""

    def __init__(self, path: str, leaf: int = LEAF):
        self.library, self.leaf = tokenizer(path), leaf
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.pieces = [(self.library.id_to_token(i) or "").encode() for i in range(size)]
        self.decimals = [b"%d" % i for i in range(size)]
        self.young: dict[bytes, Entry] = {}
        self.old: dict[bytes, Entry] = {}
        self.long_texts = 0

    def whole(self, texts: list[str]):
        return self.library.encode_batch(texts, add_special_tokens=False)

    def entry(self, ids: list[int]) -> Entry:
        return len(ids), b" ".join([self.decimals[i] for i in ids]), b" ".join([self.pieces[i] for i in ids])

    def words(self, texts: list[bytes]) -> list[list[Entry]]:
        """The entries of each text's words."""
        split = [t.split() for t in texts]
        known, young, old, fresh = {}, self.young, self.old, []
        for w in set().union(*split) if split else ():
            e = young.get(w)
            if e is None and (e := old.get(w)) is None:
                fresh.append(w)
            else:
                known[w] = young[w] = e
        for k in range(0, len(fresh), 8192):
            own = fresh[k : k + 8192]
            for w, e in zip(own, self.library.encode_batch_fast([w.decode() for w in own], add_special_tokens=False), strict=True):
                known[w] = e = self.entry(e.ids)
                if len(w) <= CACHED_BYTES:
                    young[w] = e
        if len(young) > CACHE // 2:
            self.young, self.old = {}, young
        return [[known[w] for w in ws] for ws in split]

    def texts(self, texts: list[bytes]) -> list[Entry]:
        """Of each text, number of ids, ids in decimal, and decoded."""
        strings = [t.decode() if len(t) > self.leaf else None for t in texts]
        is_long = [t is not None and len(t) > self.leaf for t in strings]
        short = iter(self.words([t for t, own in zip(texts, is_long, strict=True) if not own]))
        out = []
        for t, own in zip(strings, is_long, strict=True):
            if own:
                self.long_texts += 1
                out.append(self.entry(encode_long(t, self.whole, self.leaf)))
            else:
                entries = [e for e in next(short) if e[0]]
                out.append((sum([e[0] for e in entries]), b" ".join([e[1] for e in entries]), b" ".join([e[2] for e in entries])))
        return out

    def ids(self, text: str) -> list[int]:
        return [int(i) for i in self.texts([text.encode()])[0][1].split()]

    def decode(self, ids: list[int]) -> str:
        """The library's decode(ids, skip_special_tokens=False) of a vocabulary without decoder: the pieces, by one space."""
        return self.entry(ids)[2].decode()


@lru_cache(4)
def _encoder(path: str) -> Encoder:
    """One in a worker and vocabulary."""
    return Encoder(path)


def _drop() -> None:
    _encoder.cache_clear()
    tokenizer.cache_clear()


keeps("bpe", _drop)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long"


def encode_documents(documents: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_chars; with_ids adds ``ids`` (array) and ``decoded``.

    A null or empty text has no token and hashes of the empty string.  A null id stays null; repeated rows give a row
    each; an empty table gives none; other columns, whatever their names, are not read.
    """
    path = path or default_path()
    schema = SCHEMA + (", ids array<int>, decoded string" if with_ids else "")

    @serving("bpe")
    def run(batches):
        coder = _encoder(path)
        for batch in batches:
            own = batch.column(0)
            rows: list[tuple] = []
            for _, part in chunks(batch.column(1), BATCH):
                for n, ids, decoded in coder.texts(part):
                    text = decoded.decode()
                    row = (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), len(text))
                    rows.append((*row, [int(i) for i in ids.split()], text) if with_ids else row)
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * (6 if with_ids else 4)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.string()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([own.cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=False))], names[: len(columns) + 1])

    return documents.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), as_text(text_column).alias("text")).mapInArrow(run, schema)


def decode_ids(ids: list[int], path: str | None = None) -> str:
    """The text of ids, special tokens included."""
    return _encoder(path or default_path()).decode(ids)
