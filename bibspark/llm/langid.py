"""Language identification: the family first, then one-versus-one linear support vector machines within it.

Features: letters of the lower-cased text, other characters as word ends; counts of 1-, 2- and 3-grams, hashed into
``N_FEATURES``, square roots, unit length. A text is counted whole, in blocks of characters, so memory doesn't grow with
its length.

Level 1 tells families of languages apart with one linear machine for each pair of families; level 2 has one for each
pair of languages of a family. A vote is the machines' sigmoid of the margin; a class is scored by the mean of its
votes. As the best of a vote has half of it or more even for a text that is like nothing learnt, the score of a prediction is
the product of both levels' and of a resemblance (0 to 1): the text's mean surprise under the language's distribution of
n-grams, less what is typical of texts of that language. The typical surprise is that of each half of the training rows
under the other half. Up to ``NEAR`` nats more a text resembles the language fully, from ``FAR`` on not at all.

Training: at most ``PER_LANGUAGE`` labelled documents for each language (a documented bound), the first in the order of a
hash of the doc_id, so that the choice is random and the same on each run. Only rows near that bound are featured; one task
of an executor learns from them (10 MB of features a language) and sends the machines back, a few hundred kB. Prediction
is one pass over the documents with no shuffle.

Defined results: null text or a text without a letter is ``und`` with score 0, as is every text if there is nothing to
learn from; with one language, that one, with the resemblance as its score. A language learnt from a single text is not
known well enough to tell what is unlike it, and has resemblance 1. Repeated rows get equal results, an empty table no rows. Ties go to
the language that is first by code point. Columns besides doc_id, text and lang are not looked at, and lang only for
training; a column named ``language`` is replaced.
"""

from __future__ import annotations

import pickle
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, trim

N_FEATURES = 1 << 12
PER_LANGUAGE = 600
BLOCK = 1 << 17  # characters; the result doesn't depend on it
TASKS = 8
UNKNOWN = "und"
#: Nats above the typical surprise of a language. Held-out texts stay below, junk and other languages come out above.
NEAR, FAR = 1.15, 1.35

#: The families of common languages. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn ur mr ne pa gu",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


def _codes(raw: np.ndarray) -> np.ndarray:
    """The code points of letters as they are, others as 0."""
    letter = (raw >= 97) & (raw <= 122)
    high = np.flatnonzero(raw >= 128)
    if len(high):
        seen, back = np.unique(raw[high], return_inverse=True)
        letter[high] = np.array([chr(c).isalpha() for c in seen.tolist()])[back]
    return np.where(letter, raw, np.uint32(0))


def features(text: str | None, n: int = N_FEATURES, block: int = BLOCK) -> np.ndarray | None:
    """The unit vector of a text, or None if it has no letter.

    The text is read as one sequence: its letters, with one 0 for each run of others, and at both ends. A block takes the last
    two places of the one before along, so that counts are those of the whole text whatever the size of blocks.
    """
    total, some, low = np.zeros(n, np.int64), False, (text or "").lower()
    carry = np.zeros(0, np.uint32)
    for at in range(0, len(low) + 1, block):
        x = _codes(np.frombuffer(low[at : at + block].encode("utf-32-le", "surrogatepass"), np.uint32))
        some = some or bool(x.any())
        edge = np.zeros(1, np.uint32)
        x = np.concatenate([carry if at else edge, x, edge[: at + block > len(low)]])
        seen = len(carry)
        keep = (x > 0) | np.concatenate([[True], x[:-1] > 0])
        keep[:seen] = True
        x = x[keep]
        one = x * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (x[1:] * np.uint32(0x85EBCA77) + np.uint32(1))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (x[2:] * np.uint32(0x27D4EB2F) + np.uint32(7))) * np.uint32(0x165667B1)
        for size, h in enumerate((one, two, three)):
            new = h[max(0, seen - size) :]  # those that end at a new place
            total += np.bincount((new >> np.uint32(15)) & np.uint32(n - 1), minlength=n)
        carry = x[-2:]
    if not some:
        return None
    v = np.sqrt(total.astype(np.float32))
    return v / np.linalg.norm(v)


def _svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 240) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss; classes weigh the same. The last column of ``x`` is 1.

    Accelerated gradient steps: the objective is strongly convex with a condition of 1 + 4 c at most, so the error falls by a
    factor of about 1 - 1 / 9 a step, below what single precision shows.
    """
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * c
    w = np.zeros(x.shape[1], np.float32)
    look, condition = w.copy(), np.sqrt(1.0 + 4.0 * c)
    rate, push = np.float32(1.0 / condition**2), np.float32((condition - 1) / (condition + 1))
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ look))
        new = look - rate * (look - 2 * ((cost * slack * y) @ x))
        look, w = new + push * (new - w), new
    return w


class Model:
    """families: names; langs: the languages of each; weights of the machines of each level."""

    def __init__(self, langs: list[str], x: np.ndarray) -> None:
        """``langs``: of the rows of ``x``, a matrix of feature vectors with a last column of ones, sorted by language."""
        names = np.array(langs, dtype=object)
        self.langs = sorted(set(langs))
        places = {k: np.flatnonzero(names == k) for k in self.langs}
        family = {k: FAMILY_OF.get(k, f"only {k}") for k in self.langs}
        self.families = sorted(set(family.values()))
        self.members = {f: [k for k in self.langs if family[k] == f] for f in self.families}
        groups = {f: np.concatenate([places[k] for k in self.members[f]]) for f in self.families}
        self.top = self._pairs(self.families, groups, x)
        self.within = {f: self._pairs(self.members[f], places, x) for f in self.families}
        self.usual = {k: self._usual(x[at, :-1]) for k, at in places.items()}

    @staticmethod
    def _pairs(names: list[str], places: dict[str, np.ndarray], x: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        pairs = list(combinations(range(len(names)), 2))
        rows = []
        for i, j in pairs:
            a, b = places[names[i]], places[names[j]]
            rows.append(_svm(x[np.concatenate([a, b])], np.concatenate([np.ones(len(a)), -np.ones(len(b))]).astype(np.float32)))
        return pairs, np.stack(rows) if rows else np.zeros((0, N_FEATURES + 1), np.float32)

    @staticmethod
    def _usual(x: np.ndarray) -> tuple[np.ndarray, float]:
        """Surprise at each n-gram, and the typical mean of texts that were not learnt from."""
        shares = np.unique(x, axis=0) ** 2  # sorted, and copies don't stand on both sides
        surprise = lambda rows: -np.log((rows.mean(axis=0) + 0.1 / N_FEATURES) / 1.1)
        halves = shares[::2], shares[1::2]
        typical = np.concatenate([halves[0] @ surprise(halves[1]), halves[1] @ surprise(halves[0])]).mean() if len(shares) > 1 else np.inf
        return surprise(shares), float(typical)

    def _resemblance(self, lang: str, v: np.ndarray) -> float:
        surprise, typical = self.usual[lang]
        return min(1.0, max(0.0, (FAR - float((v * v) @ surprise) + typical) / (FAR - NEAR)))

    @staticmethod
    def _vote(names: list[str], machines, v: np.ndarray) -> tuple[str, float]:
        pairs, w = machines
        if len(names) == 1:
            return names[0], 1.0
        p = 1 / (1 + np.exp(-3.0 * (w[:, :-1] @ v + w[:, -1]).astype(np.float64)))
        total = np.zeros(len(names))
        for (i, j), x in zip(pairs, p.tolist()):
            total[i] += x
            total[j] += 1 - x
        best = int(np.argmax(total))
        return names[best], float(total[best]) / (len(names) - 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        v = features(text) if self.langs else None
        if v is None:
            return UNKNOWN, 0.0
        family, p = self._vote(self.families, self.top, v)
        lang, q = self._vote(self.members[family], self.within[family], v)
        return lang, min(1.0, p * q) * self._resemblance(lang, v)


def _featured(batches):
    only("langid")
    for batch in batches:
        rows = [(lang, o, features(text)) for lang, o, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "o", "text")))]
        rows = [(lang, o, v.astype(np.float16).tobytes()) for lang, o, v in rows if v is not None]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["lang", "o", "v"])


def _fit(batches, per_language: int):
    """The model of all rows of the one partition: of each language the first ``per_language`` in the order of ``o``."""
    only("langid")
    by_lang: dict[str, list] = {}
    for batch in batches:
        for lang, o, v in zip(*(batch.column(c).to_pylist() for c in ("lang", "o", "v"))):
            by_lang.setdefault(lang, []).append((o, v))
    chosen = [(lang, v) for lang in sorted(by_lang) for _, v in sorted(by_lang[lang])[:per_language]]
    by_lang.clear()
    x = np.ones((len(chosen), N_FEATURES + 1), np.float32)
    for i, (_, v) in enumerate(chosen):
        x[i, :-1] = np.frombuffer(v, np.float16)
    model = pickle.dumps(Model([lang for lang, _ in chosen], x))
    del x
    trim()
    yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from ``labelled`` (doc_id, text, lang): at most ``per_language`` rows of each language."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # A threshold on a hash of the id, from counts, leaves about twice as many rows as are chosen, of frequent languages too:
    # no language is ranked in one place. There is a count for each language, as there will be weights in the model.
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.col("lang").alias("l"), "n")
    o = F.xxhash64(F.lit("langid"), F.coalesce(F.col("doc_id").cast("string"), F.hex(F.xxhash64("text"))))
    place = F.shiftrightunsigned(o, 11) / F.lit(float(1 << 53))
    rows = usable.withColumn("o", o).join(F.broadcast(counts), F.col("l") == F.col("lang")).where(place * F.col("n") < 2 * per_language + 200)
    rows = rows.groupBy("lang", "o").agg(F.min("text").alias("text"))  # rows that repeat an id count once
    vectors = rows.repartition(TASKS, "lang", "o").mapInArrow(_featured, "lang string, o long, v binary")
    got = vectors.repartition(1).mapInArrow(partial(_fit, per_language=per_language), "model binary").collect()  # one row, some hundred kB
    return pickle.loads(got[0]["model"]) if got else Model([], np.ones((0, N_FEATURES + 1), np.float32))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs``, then lang_pred and score (in a struct column ``language``)."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def tell(texts: pa.Array) -> pa.Array:
        global _loaded
        only("langid")
        if _loaded is None or _loaded[0] is not shared.value:
            _loaded = (shared.value, pickle.loads(shared.value))
        got = [_loaded[1].predict(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang_pred", "score"])

    # evaluated once, though both a filter and a projection may look at the result
    return docs.withColumn("language", tell.asNondeterministic()(F.col("text")))


_loaded = None


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"))
