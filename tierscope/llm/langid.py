"""Language ID by hierarchical discrimination.

A text becomes the hashed counts of its byte trigrams (square root, length 1).
A linear SVM per family (one-versus-rest) picks the language family; inside the
family, one-versus-one linear SVMs vote for the language. The SVMs are fitted by
dual coordinate descent on at most ``MAX_ROWS`` labelled rows, picked by a hash;
counts of languages and all predictions cover every row and whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import arrow_schema, column, replaced

DIMS = 4096
PER_LANGUAGE = 500   # rows to learn from for each language, about
LEAST = 8           # rows of a language, however many languages there are
MAX_ROWS = 4000      # and for all languages together
UNKNOWN = "und"
_STEP = 1 << 20      # a long text is counted in steps of this many bytes

# Language families by ISO 639-1 code. A code not listed is a
# family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "mr", "ne", "bn", "gu", "pa"],
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0], lang)


def features(text: str) -> np.ndarray:
    """Hashed byte-trigram counts of a whole text: square root, length 1."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogateescape"), np.uint8)
    counts = np.zeros(DIMS, np.int64)
    for at in range(0, max(1, len(raw) - 2), _STEP):
        b = raw[at:at + _STEP + 2].astype(np.uint32)
        h = (b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]) * np.uint32(2654435761)
        counts += np.bincount(h >> np.uint32(20), minlength=DIMS)
    x = np.sqrt(counts).astype(np.float32)
    return x / max(float(np.linalg.norm(x)), 1e-12)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 20) -> np.ndarray:
    """L2-loss linear SVM (bias as a constant feature) by dual coordinate descent
    (Hsieh et al. 2008), in a fixed order."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    q = np.einsum("ij,ij->i", x, x) + 0.5 / c
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / c
            new = max(alpha[i] - g / q[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w.astype(np.float32)


@dataclass
class Model:
    """Families with their SVMs and, for each family, its languages and the SVM
    of each pair of them (positive: the first language)."""

    families: list[str] = field(default_factory=list)
    family_w: np.ndarray | None = None
    languages: dict[str, list[str]] = field(default_factory=dict)
    pair_w: dict[str, dict[tuple[int, int], np.ndarray]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """Language and score (0 to 1: the logistic of the smallest margin that
        decided) for each row of features."""
        if not self.families:
            return [(UNKNOWN, 0.0)] * len(x)
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        if len(self.families) > 1:
            margin = x @ self.family_w.T
            best = margin.argmax(1)
            sure = margin[np.arange(len(x)), best]
        else:
            best, sure = np.zeros(len(x), int), np.full(len(x), 8.0)
        out: list = [None] * len(x)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            langs = self.languages[name]
            votes, margins = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            for (a, b), w in self.pair_w[name].items():
                m = x[rows] @ w
                votes[:, a] += m > 0
                votes[:, b] += m <= 0
                margins[:, a] += m
                margins[:, b] -= m
            order = votes * 1e6 + margins
            pick = order.argmax(1)
            for k, r in enumerate(rows):
                m = sure[r]
                if len(langs) > 1:
                    m = min(m, margins[k, pick[k]] / (len(langs) - 1))
                out[r] = (langs[pick[k]], 1 / (1 + math.exp(-max(-30.0, min(30.0, 4 * float(m))))))
        return out


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null id isn't learned from either,
    but doesn't count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS) -> Model:
    """Learn from rows with a text that has a letter, a language and an id that
    isn't held out: of every language about ``per_language`` different rows, or its
    share of ``max_rows`` if that is less, but ``LEAST`` at least. Rows that repeat one
    id and text count once. An empty table gives a model that knows no language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                      & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("lang").cast("string").alias("lang"), "text",
        F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 30)).alias("draw"))
    # one row per language
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()}
    if not counts:
        return Model()
    want = max(LEAST, min(per_language, max_rows // len(counts)))
    limits = docs.sparkSession.createDataFrame(
        [(lang, int(min(1.0, want / n) * (1 << 30)) + 1) for lang, n in counts.items()], "lang string, below bigint")
    chosen = rows.join(F.broadcast(limits), "lang").where("draw < below").select("lang", "text", "draw").dropDuplicates(
        ["lang", "draw"])

    def run(batches):
        for batch in batches:
            lang, draw, x = [], [], []
            for name, d, text in zip(column(batch, "lang"), column(batch, "draw"), column(batch, "text")):
                if has_letter(text):
                    lang.append(name)
                    draw.append(d)
                    x.append(features(text).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(draw, pa.int64()), pa.array(x, pa.binary())],
                names=["lang", "draw", "x"])

    got = sorted(((r["lang"], r["draw"], bytes(r["x"]))
                  for r in chosen.mapInArrow(run, "lang string, draw bigint, x binary").collect()))
    if not got:
        return Model()
    return _train([g[0] for g in got], np.stack([np.frombuffer(g[2], np.float32) for g in got]))


def _train(lang: list[str], x: np.ndarray) -> Model:
    names = np.array(lang)
    family = np.array([family_of(n) for n in lang])
    model = Model(families=sorted(set(family)))
    if len(model.families) > 1:
        model.family_w = np.stack([fit_svm(x, np.where(family == f, 1.0, -1.0))
                                   for f in model.families])
    for f in model.families:
        langs = model.languages[f] = sorted(set(names[family == f]))
        model.pair_w[f] = {}
        for a in range(len(langs)):
            for b in range(a + 1, len(langs)):
                own = (names == langs[a]) | (names == langs[b])
                model.pair_w[f][a, b] = fit_svm(x[own], np.where(names[own] == langs[a], 1.0, -1.0))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus ``lang_pred string`` and ``score double``; ``und`` with score 0
    for a text that is null or has no letter. Only ``text`` is read. Columns of
    ``docs`` with these names are replaced."""
    df = replaced(docs, {"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)})
    schema, arrow = df.schema, arrow_schema(df.schema)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = df.columns

    def run(batches):
        model = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols = dict(zip(names, part.columns))
                texts = list(column(part, "text"))
                known = [i for i, t in enumerate(texts) if has_letter(t)]
                out = [(UNKNOWN, 0.0)] * len(texts)
                if known:
                    found = model.predict(np.stack([features(texts[i]) for i in known]))
                    for i, p in zip(known, found):
                        out[i] = p
                cols["lang_pred"] = pa.array([p[0] for p in out], pa.string())
                cols["score"] = pa.array([p[1] for p in out], pa.float64())
                yield pa.RecordBatch.from_arrays([cols[n] for n in names], schema=arrow)

    return df.mapInArrow(run, schema)
