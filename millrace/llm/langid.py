"""Language identification: averaged hashed subword embeddings, a linear softmax, SGD in numpy, calibrated rejection.

Features are the character 1- to 4-grams of the lower-cased words (with a mark on each side), hashed into ``BUCKETS``.
A text's vector is the mean embedding of its grams; its logits are a linear map of that mean.  For prediction the two are
multiplied out once, so that a gram costs one row of as many numbers as there are languages.

The classifier is fitted on at most ``PER_LANGUAGE`` different labelled rows of a language, and ``MOST_ROWS`` in all, those
with the smallest hashes of id and text (a documented, bounded sample, cut on the executors; what reaches the driver are
hashed counts of at most ``BUCKETS`` entries of 6 bytes a row, never texts).  One in five of them calibrates the temperature of the softmax and the score below which ``rejected`` is true.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import as_text, chunks, mix, remainder

BUCKETS, DIM, PER_LANGUAGE, EPOCHS, RATE = 1 << 15, 16, 1000, 6, 0.6
#: Rejection: of the calibration rows that stay accepted, at most this share may be wrong.
ERROR = 0.01
ORDERS = (1, 2, 3, 4)
#: Rows that the classifier is fitted on, of all languages together; steps of the descent at least, however few the rows.
MOST_ROWS, STEPS = 8000, 4000


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text; all but letters become 0, runs of 0 become one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    high = int(points.max(initial=0)) + 1
    points[~_letters(high)[points]] = 0
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    return points[keep]


_letter_table = np.zeros(0, bool)


def _letters(n: int) -> np.ndarray:
    global _letter_table
    if len(_letter_table) < n:
        _letter_table = np.array([chr(i).isalpha() for i in range(max(n, 0x3000))])
    return _letter_table


def grams(points: np.ndarray, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, (the places of its grams, their buckets). A gram may begin or end with a 0 but hold none inside."""
    found = []
    rolled = np.zeros(len(points), np.uint64)
    inside = np.ones(len(points), bool)
    for n in ORDERS:
        size = len(points) - n + 1
        if size < 1:
            break
        last = points[n - 1 :].astype(np.uint64)
        rolled = rolled[:size] * np.uint64(0x100000001B3) + last + np.uint64(7)
        inside = inside[:size] if n < 3 else inside[:size] & (points[n - 2 : n - 2 + size] != 0)
        ok = inside if n > 2 else points != 0 if n == 1 else (points[:-1] != 0) | (points[1:] != 0)
        at = np.flatnonzero(ok)
        found.append((at, (mix(rolled[at] + np.uint64(n << 57)) & np.uint64(buckets - 1)).astype(np.int64)))
    return found


def features(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    points = letters_of(f" {text} ")
    own = [b for _, b in grams(points, buckets)]
    return np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Model:
    def __init__(self, languages: list[str], table: np.ndarray, temperature: float, accept: float):
        self.languages, self.table, self.temperature, self.accept = languages, table, temperature, accept

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, probability, whether there is a letter) of each text, worked through together."""
        own = [letters_of(f" {t} ") for t in texts]
        ends = np.cumsum([len(p) for p in own])
        points = np.concatenate(own) if own else np.zeros(0, np.uint32)
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for at, buckets in grams(points, len(self.table)):
            doc = np.searchsorted(ends, at, "right")
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(doc, self.table[buckets, k], len(texts))
            n += np.bincount(doc, minlength=len(texts))
        z = total / np.maximum(n, 1)[:, None]
        p = softmax(z / self.temperature)
        return p.argmax(1), p.max(1), n > 0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[int, str, np.ndarray, np.ndarray]], buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """rows: (order key, language, buckets, counts). Deterministic for the same rows in any order."""
    rows = sorted((r for r in rows if len(r[2])), key=lambda r: (r[0], r[1], len(r[2])))
    languages = sorted({r[1] for r in rows})
    if not languages:
        return Model(["und"], np.zeros((buckets, 1), np.float32), 1.0, 0.0)
    random = np.random.default_rng(seed)
    data = [(np.asarray(b, np.int64), np.asarray(c, np.float64) / max(1, int(np.sum(c))), languages.index(lang)) for _, lang, b, c in rows]
    held = [d for k, d in enumerate(data) if k % 5 == 4] or data
    train = [d for k, d in enumerate(data) if k % 5 != 4]
    embed, soft = random.normal(0, 1 / dim, (buckets, dim)), np.zeros((dim, len(languages)))
    epochs = max(epochs, -(-STEPS // max(1, len(train))))
    total, step = epochs * len(train), 0
    for _ in range(epochs):
        for k in random.permutation(len(train)):
            b, w, y = train[k]
            lr = rate * (1 - step / total)
            step += 1
            v = w @ embed[b]
            g = softmax(v @ soft)
            g[y] -= 1
            back = soft @ g
            soft -= lr * np.outer(v, g)
            embed[b] -= (lr * 20) * w[:, None] * back  # a gram's share in the mean is small
    table = embed @ soft
    z, y = np.array([w @ table[b] for b, w, _ in held]), np.array([d[2] for d in held])
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
    temperature = min(np.geomspace(0.02, 8, 61), key=loss)
    p = softmax(z / temperature)
    score, wrong = p.max(1), p.argmax(1) != y
    order = np.argsort(-score, kind="stable")
    good = np.flatnonzero(np.cumsum(wrong[order]) <= ERROR * np.arange(1, len(order) + 1))
    accept = float(score[order[good[-1]]]) if len(good) else 1.0
    return Model(languages, table.astype(np.float32), float(temperature), accept)


def sample(documents: DataFrame, id_column: str, text_column: str, label_column: str, per_language: int) -> list[tuple]:
    """Hashed features of at most per_language rows of each language: different rows with the smallest hashes."""
    labelled = documents.filter(F.col(f"`{label_column}`").isNotNull() & as_text(text_column).isNotNull()).select(
        F.xxhash64(as_text(id_column), as_text(text_column)).alias("h"), as_text(label_column).alias("lang"), as_text(text_column).alias("text")
    )
    # Different rows only: repeats of one row, however many, count once.
    counts = {r.lang: r.n for r in labelled.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    per_language = max(1, min(per_language, MOST_ROWS // len(counts)))
    # The share of hashes that gives a little more than is needed; the exact number is cut by rank.
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.3 * per_language / n + 50 / n))])
    near = labelled.filter((F.shiftrightunsigned("h", 1) / F.lit(2.0**63)) <= share[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 1), "h"))
    chosen = near.withColumn("r", rank).filter(F.col("r") <= per_language).select("h", "lang", "text")

    def run(batches):
        for batch in batches:
            own = [features(t.as_py() or "") for t in batch.column(2)]
            packed = [pa.array([x[k].astype(kind).tobytes() for x in own], pa.binary()) for k, kind in ((0, "<u2"), (1, "<i4"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], ["h", "lang", "buckets", "counts"])

    return [(r.h & (1 << 63) - 1, r.lang, np.frombuffer(r.buckets, "<u2").astype(np.int64), np.frombuffer(r.counts, "<i4")) for r in chosen.mapInArrow(run, "h long, lang string, buckets binary, counts binary").collect()]


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def identify(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", folds: int = 3, held: int = 1, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per row: doc_id, held_out (crc32(id as text) mod folds is held), lang_pred, score, rejected.

    Learns from rows with a label, a text and an id that aren't held out.  A null text, or one without a letter, is
    ``und`` with score 0 and rejected.  A null id is not learned from and not held out.  Without any row to learn from
    every prediction is ``und``.  An empty table gives no row; other columns are not read; ties go to the language that
    sorts first.
    """
    learn = documents.filter(remainder(id_column, folds) != held)
    model = fit(sample(learn, id_column, text_column, label_column, per_language))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            lang, score, letter = [], [], []
            for _, part in chunks(batch.column(2)):
                k, p, some = model.predict([t.decode() for t in part])
                lang += [model.languages[i] if ok else "und" for i, ok in zip(k, some, strict=True)]
                score += [float(x) if ok else 0.0 for x, ok in zip(p, some, strict=True)]
                letter += some.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([not ok or s < model.accept for s, ok in zip(score, letter, strict=True)], pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    rows = documents.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(remainder(id_column, folds) == held, F.lit(False)).alias("held_out"), as_text(text_column).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
