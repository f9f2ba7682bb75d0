"""Language identification in two levels: the family first, then pairwise linear machines inside it.

Features are the byte trigrams of the whole text (lower-cased, runs of other characters as one
space), hashed to ``DIMENSIONS`` slots, square-rooted and scaled to length one. A linear support
vector machine per family (one against the rest) picks the family; inside a family every pair of
languages has a machine of its own, and the language with most wins, then the largest summed margin,
is predicted.

Training uses a bounded sample: up to ``SAMPLE`` labelled rows in all, about the same number of each
language, chosen by a hash of the id. The model is a fixed number of weight vectors. Every text is
predicted from all of its characters.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partner_analytics.llm.common import by_chunk, free, id_bucket

DIMENSIONS, SAMPLE = 4096, 2000
UNDETERMINED = "und"

#: fixed values: the family of a language code; a code not named here is a family of its own
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "indic": "bn gu hi mr ne pa si ur",
    "turkic": "az kk tr tk uz",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def _other() -> np.ndarray:
    """Bytes that become one space: ASCII characters that are no letters; A-Z become a-z."""
    table = np.arange(256, dtype=np.uint8)
    for i in range(128):
        low = chr(i).lower()
        table[i] = ord(low) if low.isalpha() else 32
    return table


TABLE = _other()


def features(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vector of hashed byte trigrams; zeros where there is none."""
    raw = TABLE[np.frombuffer((" " + text + " ").encode(), np.uint8)]
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])].astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(dimensions, np.float32)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    slot = (code * np.uint32(2654435761)) >> np.uint32(32 - (dimensions.bit_length() - 1))
    counts = np.sqrt(np.bincount(slot, minlength=dimensions))
    return (counts / np.linalg.norm(counts)).astype(np.float32)


def train_machine(x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear support vector machine (averaged stochastic subgradient of the hinge loss); y is -1 or 1."""
    rng = np.random.default_rng(0)
    weight, bias, mean, mean_bias, step = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 0
    share = {s: 0.5 / max(1e-9, (y == s).mean()) for s in (-1, 1)}
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 16)):
            step += 1
            eta = 1 / (rate * (step + 100))
            xs, ys = x[rows], y[rows]
            wrong = np.where(ys * (xs @ weight + bias) < 1, ys * np.where(ys > 0, share[1], share[-1]), 0) / len(rows)
            weight = (1 - eta * rate) * weight + eta * (wrong @ xs)
            bias += 0.01 * eta * wrong.sum()
            if epoch >= epochs // 2:
                mean += weight
                mean_bias += bias
    last = max(1, step - (epochs // 2) * max(1, len(x) // 16))
    weight, bias = mean / last, mean_bias / last
    scale = np.mean(np.abs(x @ weight + bias)) or 1.0  # margins of all machines on one scale
    return weight / scale, bias / scale


@dataclass(frozen=True)
class Model:
    families: dict[str, list[str]]
    family_names: list[str]
    family_weights: np.ndarray
    family_bias: np.ndarray
    pairs: dict[tuple[str, str], tuple[np.ndarray, float]]

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """(language, score) of each row; the score is how sure the closest of all decisions is."""
        if not self.family_names:
            return [(UNDETERMINED, 0.0)] * len(x)
        margin = x @ self.family_weights.T + self.family_bias
        out = []
        pair_margin = {pair: x @ w + b for pair, (w, b) in self.pairs.items()}
        for row, values in enumerate(margin):
            order = np.argsort(-values, kind="stable")
            gap = values[order[0]] - values[order[1]] if len(order) > 1 else 8.0
            codes = self.families[self.family_names[order[0]]]
            wins = {c: [0, 0.0] for c in codes}
            for a, b in itertools.combinations(codes, 2):
                value = float(pair_margin[a, b][row])
                wins[a if value >= 0 else b][0] += 1
                wins[a][1] += value
                wins[b][1] -= value
            best = max(codes, key=lambda c: (*wins[c], c))
            rivals = [abs(float(pair_margin[min(best, c), max(best, c)][row])) for c in codes if c != best]
            out.append((best, float(1 / (1 + np.exp(-2 * min([gap, *rivals]))))))
        return out


def train(sample: list[tuple[str, np.ndarray]]) -> Model:
    """The model of (lang, feature vector) rows."""
    lang = np.array([code for code, _ in sample], dtype=object)
    x = np.stack([v for _, v in sample]) if sample else np.zeros((0, DIMENSIONS), np.float32)
    families: dict[str, list[str]] = {}
    for code in sorted(set(lang)):
        families.setdefault(FAMILY_OF.get(code, code), []).append(code)
    names = sorted(families)
    family = np.array([FAMILY_OF.get(code, code) for code in lang], dtype=object)
    machines = [train_machine(x, np.where(family == name, 1, -1)) for name in names]
    if len(names) == 1:
        machines = [(np.zeros(DIMENSIONS), 0.0)]
    pairs = {}
    for codes in families.values():
        for a, b in itertools.combinations(codes, 2):
            own = (lang == a) | (lang == b)
            pairs[a, b] = train_machine(x[own], np.where(lang[own] == a, 1, -1))
    return Model(families, names, np.array([w for w, _ in machines]).reshape(len(names), DIMENSIONS),
                 np.array([b for _, b in machines]), pairs)


def training_sample(docs: DataFrame, learns: Column, lang_col: str, size: int) -> list[tuple[str, np.ndarray]]:
    """(lang, features) of at most ``size`` labelled rows, spread over the languages by a hash of the id."""
    labelled = docs.filter(learns & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(size).collect()}
    if not counts:
        return []
    each = size / len(counts)
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    share = F.create_map(*[F.lit(v) for code, n in counts.items() for v in (code, min(1.0, each / n))])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        vectors = [features(text) for text in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [part.column("lang"), pa.array([v.tobytes() for v in vectors], pa.binary())], ["lang", "v"])

    # only vectors of a fixed length come to the driver; about ``size`` rows pass the draw
    texts = labelled.filter(draw < share[F.col(lang_col)]).filter(F.col("text").rlike(r"\p{L}"))
    rows = texts.select(F.col(lang_col).alias("lang"), "text").mapInArrow(by_chunk(run), "lang string, v binary")
    return [(r["lang"], np.frombuffer(r["v"], np.float32)) for r in rows.limit(2 * size).collect()]


def identified(docs: DataFrame, learns: Column, id_col: str, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """``docs`` with the language and its score as two columns more, at the end."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                         F.col(lang_col).cast("string").alias("lang"), learns.alias("learns"))
    model = train(training_sample(source, F.col("learns"), "lang", sample))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights for each pair of languages
    names = docs.columns
    lang, points = free(docs, "_lang"), free(docs, "_score")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(names.index(text_col)).to_pylist()
        rows = [i for i, ok in enumerate(part.column(len(names)).to_pylist()) if ok]
        found = [(UNDETERMINED, 0.0)] * len(texts)
        for at in range(0, len(rows), 256):
            own = rows[at:at + 256]
            for i, result in zip(own, shared.value.predict(np.stack([features(texts[i]) for i in own]))):
                found[i] = result
        return pa.RecordBatch.from_arrays(
            [*part.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
            [*names, lang, points])

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(free(docs, "_letters"))
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(points, T.DoubleType())])
    return docs.select("*", letters).mapInArrow(by_chunk(run, text_col), schema)


def identify(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             sample: int = SAMPLE) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``; ``learns`` marks the rows to learn from.

    A text that is null, empty or without letters is ``und`` with score 0; so is every text where no
    row can be learned from. Labels, ids and other columns are no inputs of a prediction. Repeated
    rows get equal results; very long texts are read whole.
    """
    needed = docs.select(id_col, text_col, lang_col)
    found = identified(needed, learns, id_col, text_col, lang_col, sample)
    return found.select(F.col(id_col).alias("doc_id"), *[F.col(x).alias(y) for x, y in zip(found.columns[-2:], ("lang_pred", "score"))])


def in_known_language(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text",
                      lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``docs`` without those whose language stays undetermined; all columns stay."""
    found = identified(docs, learns, id_col, text_col, lang_col, sample)
    return found.filter(F.col(found.columns[-2]) != UNDETERMINED).select(*docs.columns)


def learns_from(id_column: Column) -> Column:
    """Rows whose crc32 of the id as text, modulo 4, is not 2."""
    return id_bucket(id_column, 4) != 2
