"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import as_bytes, by_arrow, chunks, crc_mod

#: n-gram lengths and hash cells of each.
ORDERS, CELLS = (2, 3, 4), 1 << 16
#: Grams after which more text no longer sharpens a margin (long texts repeat themselves).
SATURATION = 400.0
#: The column that tells _tagged() which texts have a letter.
LETTER = "barloom_has_letter"
#: A text is ambiguous when the second best language has at least this share of the best one's score.
AMBIGUOUS = 0.8

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of texts as (place of the first, how many, cell of each gram, first gram of each text and the end)."""
    for at, part in chunks(texts, 1 << 19):
        b = _FOLD[np.frombuffer(b" " + b"  ".join(part) + b"    ", np.uint8)].astype(np.uint64)
        n = len(b) - 4
        ends = np.concatenate([[0], np.minimum(np.cumsum([len(t) + 2 for t in part]), n)])
        codes = np.empty((len(ORDERS), n), np.int64)
        gram = b[:n].copy()
        for j in range(1, max(ORDERS)):
            gram = (gram << np.uint64(8)) | b[j : n + j]
            if j + 1 in ORDERS:
                k = ORDERS.index(j + 1)
                codes[k] = (gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64) + k * CELLS
        yield at, len(part), codes, ends


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A row of +1 and -1 for each of n languages: all splits in two for up to 5, else random ones kept far apart."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        return np.array([[1 if (s >> i) & 1 else -1 for s in range(1, 2 ** (n - 1))] for i in range(n)], np.int8)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, apart = None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (n, bits), dtype=np.int8) * 2 - 1
        code = code[:, np.abs(code.sum(0, dtype=int)) < n]
        d = ((code[:, None] != code[None]).sum(2) + np.eye(n, dtype=int) * bits).min()
        if d > apart:
            best, apart = code, d
    return best


@dataclass
class LanguageModel:
    """Languages in order, their codewords, gram weights for each bit, and how well each bit tells each language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-odds of each bit over a text's grams, and the number of grams."""
        out, many = np.zeros((len(texts), self.code.shape[1]), np.float64), np.zeros(len(texts))
        for at, n, codes, ends in grams(texts):
            for k in range(len(ORDERS)):
                out[at : at + n] += np.add.reduceat(self.weights[codes[k]], ends[:-1], axis=0)
            many[at : at + n] = np.maximum(1, np.diff(ends))
        return out / (many[:, None] * len(ORDERS)), many

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the nearest codeword, its probability, and whether the second is close."""
        mean, many = self.margins(texts)
        margin = mean * np.minimum(many, SATURATION)[:, None] / 4
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None])
        total = (loss * self.trust[None]).sum(2)
        p = np.exp(-(total - total.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, 1)
        second = top[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, p[np.arange(len(p)), best], second >= AMBIGUOUS * top[:, -1]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), as_bytes(batch, "text")
        for lang in set(langs):
            own = sums.setdefault(lang, np.zeros(len(ORDERS) * CELLS, np.int64))
            for _, _, codes, _ in grams([t for t, x in zip(texts, langs) if x == lang]):
                own += np.bincount(codes.ravel(), minlength=len(own))
    for lang, own in sums.items():
        cells = np.flatnonzero(own)
        for at in range(0, len(cells), 1 << 16):
            c = cells[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(c.astype(np.int32)), pa.array(own[c])], ["lang", "cell", "n"])


def fit_language(docs: DataFrame) -> LanguageModel:
    """Learns from every labelled document outside the held-out quarter; the driver gets one count per language and cell."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sums = by_arrow(rows, _counted, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(sums.column("lang").to_pylist()))
    if not languages:
        return LanguageModel([], codewords(0), np.zeros((len(ORDERS) * CELLS, 1), np.float32), np.zeros((0, 1)))
    place = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(languages), len(ORDERS) * CELLS))
    counts[[place[x] for x in sums.column("lang").to_pylist()], sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    share = np.empty_like(counts)
    for k in range(len(ORDERS)):
        own = counts[:, k * CELLS : (k + 1) * CELLS]
        share[:, k * CELLS : (k + 1) * CELLS] = (own + 0.02) / (own.sum(1, keepdims=True) + 0.02 * CELLS)
    code = codewords(len(languages))
    up, down = (code > 0).astype(float), (code < 0).astype(float)
    weights = np.log(up.T @ share / np.maximum(1, up.sum(0))[:, None] + 1e-12) - np.log(down.T @ share / np.maximum(1, down.sum(0))[:, None] + 1e-12)
    # a bit counts for a language as far as it separates it on the counts themselves
    gain = np.maximum((share @ weights.T) / len(ORDERS) * code, 1e-3)
    return LanguageModel(languages, code, np.ascontiguousarray(weights.T.astype(np.float32)), gain / gain.mean(1, keepdims=True))


def _tagged(model: LanguageModel, columns: list[str], reject: bool):
    names = np.array([*model.languages, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch, "text")
            letter = np.array(batch.column(LETTER).to_pylist(), bool)
            if model.languages and len(texts):
                best, p, close = model.predict(texts)
            else:
                best, p, close = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), bool)
                letter = np.zeros(len(texts), bool)
            kept = [batch.column(c) for c in columns]
            if reject:
                yield pa.RecordBatch.from_arrays(kept, columns).filter(pa.array(letter & ~close))
            else:
                own = [pa.array(np.where(letter, names[best], "und").tolist(), pa.string()), pa.array(np.where(letter, p, 0.0)), pa.array(letter & close)]
                yield pa.RecordBatch.from_arrays([*kept, *own], [*columns, "lang_pred", "score", "ambiguous"])

    return run


def _letters(docs: DataFrame):
    return F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous.

    Bits of language codewords are predicted from hashed byte n-grams; the codeword of the least weighted
    logistic loss wins. score is its share of exp(-loss); ambiguous marks a close second. A null text or
    one without a letter is `und` with score 0, and so is every text when nothing could be learned. Texts
    are read whole. Rows that repeat a doc_id are predicted each; a null doc_id counts as not held out.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
        F.col("text").cast("string").alias("text"), _letters(docs).alias(LETTER),
    )
    return by_arrow(rows, _tagged(model, ["doc_id", "held_out"], False), "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean")


def known_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents whose language is told: neither `und` nor ambiguous. All columns stay as they are."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return by_arrow(docs.withColumn(LETTER, _letters(docs)), _tagged(model, docs.columns, True), schema)
