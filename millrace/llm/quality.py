"""Quality rules: fixed base rules, and n-gram perplexity in language-specific bands.

The perplexity model is a modified Kneser-Ney character model (kneser_ney.py) counted in Spark over whole documents.  A
document's figure is its bits a character (the logarithm of its perplexity).  For each language the bands are the
median of that figure over all documents that pass the base rules, plus and minus ``WIDTH`` robust standard deviations.

A model that has learned junk finds it likely, so it is counted twice: first over all documents, then over those that pass the
base rules and lie within ``TRIM`` deviations of their language's median under the first model, in bits a character and in
bits a word.  The second model judges all documents.  Sums are in fixed point, so results don't depend on how rows are dealt out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kneser_ney as kn
from ._text import HELD, Tally, as_text, chunks, cut, fresh, keeps, mix, powers, serve, serving, span_hashes, words_of

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Robust standard deviations on each side, for the verdict and for what the second model learns; and the least deviation, as
#: a share of the median.
WIDTH, TRIM, LEAST = 6.0, 2.5, 0.005
#: Most trigrams that are sent to the executors (16 bytes each): beyond, the rarest stay distributed and are joined (``with_rest``).
MOST = 4_000_000
#: Documents a language needs for bands of its own; with fewer, those of all languages together hold.
ENOUGH = 30
FIXED = 1 << 16
#: Bins of the histogram of the logarithm of a figure, in a factor of two; they have no upper end.
BINS = 2048

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_ROLL = 0xC2B2AE3D27D4EB4F | 1


def repeated(hashes: np.ndarray, first: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """For each text (words first[k]:first[k+1]), its words that stand in a window of ``size`` words found twice or more in it."""
    n, docs = len(hashes), len(first) - 1
    if n < size:
        return np.zeros(docs, np.int64)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(_ROLL, n), out=run[1:])
    doc = np.repeat(np.arange(docs), np.diff(first))
    at = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
    key = mix(mix((run[at + size] - run[at]) * powers(pow(_ROLL, -1, 1 << 64), n)[at]) + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    own = at[twice]
    np.add.at(cover, own, 1)
    np.add.at(cover, own + size, -1)
    return np.bincount(doc, np.cumsum(cover[:n]) > 0, docs).astype(np.int64)


def base_figures(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, starts, ends, first, at = words_of(texts)
    raw = np.frombuffer(data, np.uint8)
    run = lambda x: np.concatenate([[0], np.cumsum(x)])
    points = run((raw & 0xC0) != 0x80)
    chars, symbols = run(points[ends] - points[starts]), run(_SYMBOL[raw])
    hashes = span_hashes(raw, starts, ends)
    # Lines: every text ends with a line end of its own, so its last line has one too.
    stop = np.flatnonzero(raw == 10)
    begin = np.concatenate([[0], stop[:-1] + 1])
    doc = np.searchsorted(at, begin, "right") - 1
    some = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, doc = begin[some], stop[some], doc[some]
    key = mix(span_hashes(raw, begin, stop) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, one = np.unique(key, return_index=True)
    n = len(texts)
    return {
        "n_words": np.diff(first),
        "word_chars": np.diff(chars[first]),
        "n_symbols": np.diff(symbols[at]),
        "n_dup_lines": np.bincount(doc, minlength=n) - np.bincount(doc[one], minlength=n),
        "n_repeat_words": repeated(hashes, first),
    }


def fails_base(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)


def trigram_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all trigrams of the texts, each begun anew, and of each text the number of its first (one more at the end)."""
    points = np.frombuffer(b"\n\n".join([b"", *texts]).decode().encode("utf-32-le"), np.uint32)
    s = kn.fold(points).astype(np.int64)
    keys = s[:-2] << 2 * kn.BITS | s[1:-1] << kn.BITS | s[2:]
    lengths = np.array([len(t.decode()) for t in texts])
    begin = np.cumsum(lengths + 2) - lengths - 2  # a text's first character is two places after it
    own = np.ones(len(keys), bool)
    own[begin[1:] - 1], own[begin[1:] - 2] = False, False
    return keys[own], np.concatenate([[0], np.cumsum(lengths)])


@dataclass
class Learned:
    """A model, whole: what is sent, and where that isn't all, the keys that are, and the rest (key, more): how many bits, in fixed
    point, each has more than it would have if not seen."""

    model: Broadcast
    sent: np.ndarray | None = None
    rest: DataFrame | None = None


def count(texts: DataFrame, chosen: Callable[[list[bytes], list, np.ndarray], np.ndarray] | None = None, sent: np.ndarray | None = None) -> Learned:
    """The model of all texts, or of those chosen (texts: text, lang, more; the last two as chosen needs them).

    All trigrams have their part in it.  With more than MOST, the rarest aren't sent, or those that ``sent`` doesn't hold: for
    a second model those that the first sends, so that none that is common anywhere has to be joined.
    """
    share = texts.sparkSession.sparkContext.broadcast

    @serving("quality")
    def run(batches):
        held = Tally()
        for batch in batches:
            languages, more = (None, None) if chosen is None else (batch.column(1).to_pylist(), batch.column(2).to_numpy())
            for at, part in chunks(batch.column(0)):
                end = at + len(part)
                own = part if chosen is None else [t for t, ok in zip(part, chosen(part, languages[at:end], more[at:end]), strict=True) if ok]
                if own:
                    held.add(trigram_keys(own)[0])
                if held.held > HELD and held.full():
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.take()], ["key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.take()], ["key", "n"])

    counted = cut((texts if chosen else texts.select("text")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    if sent is None:
        # How many have each count, in doublings: the least count that at most MOST have.
        sizes = {r.b: r.k for r in counted.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count("*").alias("k")).collect()}
        low, kept = max(sizes, default=0) + 1, 0
        while low > 0 and kept + sizes.get(low - 1, 0) <= MOST:
            low -= 1
            kept += sizes.get(low, 0)
        rows = (counted.filter(F.col("n") >= (1 << low)) if low else counted).toArrow()
        keys, n = rows["key"].to_numpy(), rows["n"].to_numpy()
        if not low:
            return Learned(share(kn.Model(keys, n)))
        order = np.argsort(keys)
        sent, n = keys[order], n[order]
    else:
        n = None
    held = share(sent)

    def those(here: bool):
        @serving("quality")
        def run(batches):
            sent = held.value
            for batch in batches:
                key = batch.column(0).to_numpy()
                at = np.minimum(np.searchsorted(sent, key), max(len(sent) - 1, 0))
                yield batch.filter(pa.array((sent[at] == key) == here if len(sent) else np.full(len(key), not here)))

        return counted.mapInArrow(run, "key long, n long")

    if n is None:
        rows, n = those(True).toArrow(), np.zeros(len(sent), np.int64)
        n[np.searchsorted(sent, rows["key"].to_numpy())] = rows["n"].to_numpy()
    shared = share(kn.Model(sent, n, _sums(counted)))

    @serving("quality")
    def more(batches):
        model = shared.value
        for batch in batches:
            key, n = (c.to_numpy() for c in batch.columns)
            bits = [np.rint(model.bits(key, x).astype(np.float32) * FIXED).astype(np.int64) for x in (n, np.zeros(len(n), np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits[0] - bits[1])], ["key", "more"])

    return Learned(shared, sent, cut(those(False).mapInArrow(more, "key long, more long")))


def _sums(counted: DataFrame) -> kn.Sums:
    """What a model needs of all trigrams (key, n); the driver gets at most SYMBOLS ** 2 rows."""
    sizes = {r.n: r.k for r in counted.filter("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    two = counted.groupBy(F.col("key").bitwiseAND(F.lit((1 << 2 * kn.BITS) - 1)).alias("k")).agg(F.count("*").alias("n")).toArrow()
    few = [F.count(F.when(F.least("n", F.lit(3)) == k, 1)).alias(f"n{k}") for k in (1, 2, 3)]
    contexts = counted.groupBy(F.shiftright("key", kn.BITS).alias("k")).agg(F.sum("n").alias("n"), *few).toArrow()
    by_two, by_context = (np.argsort(t["k"].to_numpy()) for t in (two, contexts))
    two = [two[c].to_numpy()[by_two] for c in ("k", "n")]
    own = [contexts[c].to_numpy()[by_context] for c in ("k", "n", "n1", "n2", "n3")]
    return kn.Sums([sizes.get(k, 0) for k in (1, 2, 3, 4)], *two, own[0], own[1].astype(float), tuple(own[2:]))


def with_rest(frame: DataFrame, text: F.Column, by: Learned) -> tuple[DataFrame, str]:
    """The frame and a new column's name: the bits, in fixed point, that a text has more by the trigrams that aren't sent.

    Only where there are such is anything shuffled: their occurrences by key, and the texts by their 64-bit hash, which stands
    for a text (its rows have equal sums, so these are divided by how many there are).
    """
    name, own = fresh("more", frame.columns), fresh("_hash", frame.columns)
    if by.rest is None:
        return frame.withColumn(name, F.lit(0).cast("long")), name
    model = by.model
    hashed = frame.select(F.xxhash64(text).alias(own), text.alias("text")).filter(F.length("text") > 0)

    @serving("quality")
    def run(batches):
        for batch in batches:
            h = batch.column(0).to_numpy()
            for at, part in chunks(batch.column(1)):
                keys, first = trigram_keys(part)
                lost = np.flatnonzero(~model.value.holds(keys))
                of = at + np.searchsorted(first, lost, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h[of]), pa.array(keys[lost])], [own, "key"])

    found = hashed.mapInArrow(run, f"`{own}` long, key long").join(by.rest, "key").groupBy(own).agg(F.sum("more").alias("sum"))
    found = found.join(hashed.groupBy(own).agg(F.count("*").alias("copies")), own).select(own, F.expr("sum div copies").alias(name))
    joined = frame.withColumn(own, F.when(F.length(text) > 0, F.xxhash64(text))).join(found, own, "left").drop(own)
    return joined.withColumn(name, F.coalesce(name, F.lit(0))), name


_scorers: list[kn.Scorer] = []
keeps("quality", _scorers.clear)


def scorer(model: Broadcast) -> kn.Scorer:
    """One in a worker and model, so that its table is filled once."""
    if not _scorers or _scorers[0].model is not model.value:
        _scorers[:] = [kn.Scorer(model.value)]
    return _scorers[0]


def figures_of(texts: list[bytes], by: kn.Scorer, more: np.ndarray) -> dict[str, np.ndarray]:
    """The base figures of texts and their bits a character and a word (0 without any), rounded to 1/65536; more: of ``with_rest``."""
    own = base_figures(texts)
    keys, first = trigram_keys(texts)
    sums = np.concatenate([[0], np.cumsum(np.rint(by.bits(keys) * FIXED).astype(np.int64))])
    bits = np.diff(sums[first]) + more
    own["bits"] = np.rint(bits / np.maximum(np.diff(first), 1)) / FIXED
    own["word_bits"] = np.rint(bits / np.maximum(own["n_words"], 1)) / FIXED
    return own


def figures(texts: pa.Array, by: kn.Scorer, more: pa.Array) -> dict[str, np.ndarray]:
    more = more.to_numpy()
    parts = [figures_of(part, by, more[at : at + len(part)]) for at, part in chunks(texts)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


Bands = dict[str | None, tuple[float, float]]


def bands(texts: DataFrame, by: Learned, width: float) -> dict[str, Bands]:
    """For bits a character and bits a word: lowest and highest of each language; under None those of all together. texts: text, lang, more."""
    model = by.model

    @serving("quality")
    def run(batches):
        for batch in batches:
            f = figures(batch.column(0), scorer(model), batch.column(2))
            if not f:
                continue
            ok = ~fails_base(f["n_words"], f["n_repeat_words"])
            for figure in ("bits", "word_bits"):
                bins = np.floor(np.log2(np.maximum(f[figure], 1 / FIXED)) * BINS).astype(np.int32)[ok]
                yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(ok)), pa.array([figure] * len(bins), pa.string()), pa.array(bins)], ["lang", "figure", "bin"])

    rows = texts.mapInArrow(run, "lang string, figure string, bin int").groupBy("lang", "figure", "bin").count().collect()
    out: dict[str, Bands] = {}
    for figure in ("bits", "word_bits"):
        found: dict[str | None, Counter] = {None: Counter()}
        for r in rows:
            if r.figure == figure:
                found.setdefault(r.lang, Counter())[r.bin] += r["count"]
                found[None][r.bin] += r["count"]
        out[figure] = {k: _band(h, width) for k, h in found.items() if k is None or h.total() >= ENOUGH}
    return out


def _band(bins: Counter, width: float) -> tuple[float, float]:
    if not bins:
        return 0.0, float("inf")
    at = sorted(bins)
    x, histogram = 2 ** ((np.array(at) + 0.5) / BINS), np.array([bins[k] for k in at])

    def middle(values: np.ndarray) -> float:
        order = np.argsort(values, kind="stable")
        return float(values[order[np.searchsorted(np.cumsum(histogram[order]), histogram.sum() / 2)]])

    m = middle(x)
    spread = width * max(LEAST * m, 1.4826 * middle(np.abs(x - m)))
    return m - spread, m + spread


def within(values: np.ndarray, languages: list[str | None], limits: Bands) -> np.ndarray:
    lows, highs = zip(*(limits.get(x or "", limits[None]) for x in languages), strict=True) if languages else ((), ())
    return (values >= np.array(lows)) & (values <= np.array(highs))


def verdicts(f: dict[str, np.ndarray], languages: list[str | None], limits: Bands) -> np.ndarray:
    return ~fails_base(f["n_words"], f["n_repeat_words"]) & within(f["bits"], languages, limits)


def learned(documents: DataFrame, text_column: str, lang_column: str, width: float) -> tuple[Learned, Bands]:
    """The second model and its bands."""
    texts = documents.select(as_text(text_column).alias("text"), F.coalesce(as_text(lang_column), F.lit("")).alias("lang"))
    measured = lambda by: with_rest(texts, F.col("text"), by)[0].select("text", "lang", "more")
    first = count(texts)
    model, seen = first.model, measured(first)
    near = bands(seen, first, TRIM)

    def chosen(texts: list[bytes], languages: list, more: np.ndarray) -> np.ndarray:
        f = figures_of(texts, scorer(model), more)
        return verdicts(f, languages, near["bits"]) & within(f["word_bits"], languages, near["word_bits"])

    second = count(seen, chosen, first.sent)
    return second, bands(measured(second), second, width)["bits"]


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, bits_per_char double, bits_per_word double"


def judge(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", width: float = WIDTH) -> DataFrame:
    """One row per row: doc_id, the base figures, base_failed, kept, bits_per_char, bits_per_word.

    A null or empty text has no words and fails the base rules.  A null language is a language of its own; one with
    fewer than ``ENOUGH`` documents uses the bands of all.  Null ids stay null; repeated rows give a row each (and count
    as often); an empty table gives none; other columns are not read.
    """
    by, limits = learned(documents, text_column, lang_column, width)
    model = by.model

    @serving("quality")
    def run(batches):
        for batch in batches:
            f = figures(batch.column(1), scorer(model), batch.column(3))
            if not f:
                continue
            kept = verdicts(f, batch.column(2).to_pylist(), limits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(f[k].astype(np.int64)) for k in NAMES), pa.array(fails_base(f["n_words"], f["n_repeat_words"])), pa.array(kept), pa.array(f["bits"].astype(float)), pa.array(f["word_bits"].astype(float))],
                ["doc_id", *NAMES, "base_failed", "kept", "bits_per_char", "bits_per_word"],
            )

    rows = documents.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), as_text(text_column).alias("text"), as_text(lang_column).alias("lang"))
    return with_rest(rows, F.col("text"), by)[0].select("doc_id", "text", "lang", "more").mapInArrow(run, SCHEMA)


def keep(documents: DataFrame, text_column: str = "text", lang_column: str = "lang", width: float = WIDTH) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    by, limits = learned(documents, text_column, lang_column, width)
    model = by.model

    @F.arrow_udf("boolean")
    def good(text: pa.Array, lang: pa.Array, more: pa.Array) -> pa.Array:
        serve("quality")
        if not len(text):
            return pa.array([], pa.bool_())
        return pa.array(verdicts(figures(text, scorer(model), more), lang.to_pylist(), limits))

    rows, more = with_rest(documents, as_text(text_column), by)
    return rows.filter(good(as_text(text_column), as_text(lang_column), F.col(more))).select(*(F.col(f"`{c}`") for c in documents.columns))
