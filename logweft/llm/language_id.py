"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts become code points (A-Z lower-cased, other ASCII non-letters read as
blanks); the 1-, 2- and 3-grams of a text are hashed into one table of
2 ** BITS features.  Training sums feature counts by language; the matrix of
log probabilities (languages x features, floats) is broadcast, its size bounded
by `most_languages`.  A batch is scored by gathering rows of the matrix
for all its n-grams and adding them up between text bounds.

Fitting uses a bounded sample, `per_language` rows of each language at most
(in expectation), chosen by a hash of the identifier, and the `most_languages`
commonest values of lang; a language's prior is its
share of all training rows, and prediction reads whole texts of all rows.

Defined cases: a null text or one without a letter gets `und` with score 0, as
does every text when there is nothing to learn from; null languages are not
learned from; texts in languages beyond the bound get the nearest learned one; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import sliced

BITS = 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
PER_LANGUAGE = 6000
#: values of lang that are learned at most, the commonest: each is a row of 2**BITS float32 in the broadcast
MOST_LANGUAGES = 128
UNKNOWN = "und"
#: code points handled at once
CHUNK = 1 << 19
_MAP = np.array([x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 else 32 for x in range(128)], np.uint32)


def has_letter(text: str) -> bool:
    """Whether a text has a letter: a code point of Unicode's categories L (numbers such as ² or ½ are none)."""
    return any(map(str.isalpha, text))


def _features(texts: list[str]):
    """(order's features at each code point, start and end of each text) of the texts laid one after another, two blanks after each."""
    codes = np.frombuffer("  ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < 128, _MAP[np.minimum(codes, 127)], codes)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.concatenate([[0], np.cumsum(size + 2)[:-1]])
    tail = np.concatenate([codes, np.full(max(ORDERS), 32, np.uint32)])
    out = []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            h = np.full(len(codes), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for j in range(n):
                h = (h ^ tail[j : j + len(codes)]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
            out.append(h * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))
    return out, start, start + size


def _pieces(texts: list[str]):
    """Runs of whole texts of about CHUNK code points."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= CHUNK:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


class Model:
    """Languages and their float32 log-probability matrix."""

    def __init__(self, counts: dict[str, np.ndarray], rows: dict[str, int]):
        self.languages = sorted(counts)
        total = max(1, sum(rows.values()))
        self.prior = np.array([np.log(rows[x] / total) for x in self.languages])
        self.matrix = np.array([np.log((counts[x] + SMOOTHING) / (counts[x].sum() + SMOOTHING * (1 << BITS))) for x in self.languages], np.float32).reshape(-1, 1 << BITS)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Most probable language and its posterior probability."""
        labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        usable = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        for a, b in _pieces([texts[i] for i in usable]):
            rows = usable[a:b]
            features, start, end = _features([texts[i] for i in rows])
            bounds = np.stack([start, end], 1).ravel()
            log = np.zeros((len(self.languages), len(rows)))
            for k, weights in enumerate(self.matrix):
                total = weights[features[0]].astype(np.float64)
                for f in features[1:]:
                    total += weights[f]
                log[k] = np.add.reduceat(total, bounds)[::2] + self.prior[k]
            best = log.argmax(0)
            share = 1 / np.exp(log - log.max(0)).sum(0)
            for i, k, s in zip(rows, best, share):
                labels[i], scores[i] = self.languages[k], s
        return labels, scores


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in sliced(batches, 1):
        by: dict[str, list[str]] = {}
        for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by.setdefault(lang, []).append(t)
        for lang, texts in by.items():
            rows[lang] = rows.get(lang, 0) + len(texts)
            total = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
            for a, b in _pieces(texts):
                features, start, end = _features(texts[a:b])
                inside = np.zeros(len(features[0]) + 1, np.int8)
                np.add.at(inside, start, 1)
                np.add.at(inside, end, -1)
                inside = np.cumsum(inside[:-1]) > 0
                for f in features:
                    total += np.bincount(f[inside], minlength=1 << BITS)
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([rows[x] for x in counts], pa.int64()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], names=["lang", "n", "counts"])


def _add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"lang": [key[0].as_py()], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the rows of docs where `learn` holds, about per_language of each language and most_languages languages (the commonest, ties by name) at most."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("i"))
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if not found:
        return Model({}, {})
    share = F.create_map(*[F.lit(x) for lang, n in found.items() for x in (lang, min(1.0, per_language / n))])[F.col("lang")]
    sample = rows.where(F.col("lang").isin(list(found))).where(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    parts = sample.coalesce(32).mapInArrow(_count, "lang string, n long, counts binary")
    got = parts.groupBy("lang").applyInArrow(_add, "lang string, n long, counts binary").collect()
    return Model({r.lang: np.frombuffer(bytes(r.counts), np.int64) for r in got}, {r.lang: found[r.lang] for r in got})


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score put first; columns of those names in docs go."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in sliced(batches, place):
            labels, scores = held.value.predict(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(scores), *batch.columns], names=["lang_pred", "score", *batch.schema.names])

    return docs.mapInArrow(run, "lang_pred string, score double, " + ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in sliced(batches, place):
            yield batch.filter(pa.array([bool(t and has_letter(t)) for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))
