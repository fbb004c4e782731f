"""Toxicity of texts after noisy-channel restoration of leetspeak, spacing and repetition."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import as_bytes, by_arrow, chunks, crc_mod, written

#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c"}
#: Channel costs in nats: a sign for a letter, a sign that means nothing, a letter run that is one letter, or two.
SIGN, NOISE, RUN_ONE, RUN_TWO = 1.0, 3.0, 0.5, 1.5
#: Cost of joining signs of a spelled-out run over a separator other than the run's usual one.
ODD_JOIN = 4.0
#: Symbols of the character model: a word's edge, a-z, and 32 classes of other bytes.
SYMBOLS = 59
#: Words' first letters that are features beside the whole word.
STEMS = (4, 5, 6)
#: What a feature needs: toxic documents, evidence (log-likelihood ratio; it must also be SLACK above twice the log of the number
#: of features tested, so that less than one of them is expected to get in by chance), and the log of how much likelier it is in toxic documents.
FEWEST, EVIDENCE, SLACK, LIFT = 4, 20.0, 2.0, 4.0
#: Sums of weights are calibrated on a histogram with cells of a quarter, the last for all above.
CELLS = 240
#: Tokens whose restoration one Python worker remembers, and the longest that it remembers; longer ones are decoded each time.
REMEMBERED, LONGEST = 300_000, 40

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = 27 + (np.arange(128, 256) & 31)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPELLED = re.compile(rb"(?<![a-z0-9\x80-\xff])(?:[a-z0-9@$!|+](?:[ .\-_*]{1,3}|(?=$))){3,}(?:[a-z0-9@$!|+](?![a-z0-9\x80-\xff]))?")
_SIGN = re.compile(r"([a-z0-9@$!|+])([ .\-_*]*)")
_TOKEN = re.compile(rb"[a-z0-9\x80-\xff@$!|+(]+")
_WORD = re.compile(rb"[a-z\x80-\xff]+")
_ODD = re.compile(rb"[a-z\x80-\xff][0-9@$!|+(]|[0-9@$!|+(][a-z\x80-\xff]|([a-z])\1\1")


def character_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of three symbols in a row, words being parted by their edges."""
    out = np.zeros(SYMBOLS**3, np.int64)
    for _, part in chunks(texts):
        s = _SYMBOL[_LOWER[np.frombuffer(b"  " + b"  ".join(part) + b"  ", np.uint8)]]
        out += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(out))
    return out


class Restorer:
    """Decodes an odd token to the likeliest word: a character lattice under a trigram model, by Viterbi."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        two, one = c.sum(0) + 0.1, c.sum((0, 1)) + 0.1
        lower = (two + 2 * one / one.sum()) / (two.sum(1, keepdims=True) + 2)
        self.logp = np.log((c + 5 * lower[None]) / (c.sum(2, keepdims=True) + 5)).tolist()
        self.known: dict[bytes, set[bytes]] = {}

    def arcs(self, c: str, i: int, j: int) -> list[tuple[int, str, float]]:
        """(next place, letters, cost) from place i, where a run of the sign c goes on to j."""
        out: list[tuple[int, str, float]] = []
        for letter in LEET.get(c, "") or (c if c.isalpha() else ""):
            cost = SIGN if c in LEET else 0.0
            out.append((i + 1, letter, cost))
            if j - i >= 3:
                out += [(j, letter, cost + RUN_ONE), (j, letter * 2, cost + RUN_TWO)]
        if not c.isalpha():
            out.append((i + 1, "", NOISE))
        return out

    def decode(self, token: str, odd: list[bool] | None = None) -> str:
        """The best words; "" if the token is all noise.

        Of a spelled-out run, odd tells for each sign whether the separator before it is another than the run's usual
        one. Each separator either joins (at a cost if odd) or is a word's edge, by the trigram model. Words so far are
        linked back to front, so that what is kept grows with the token's length alone, times the states at one place.
        """
        size, logp = len(token), self.logp
        ends, joins = [size] * (size + 1), [0.0] * (size + 1)
        for i in range(size - 2, -1, -1):
            ends[i] = ends[i + 1] if token[i] == token[i + 1] else i + 1
        for i in range(1, size):
            joins[i] = joins[i - 1] + (ODD_JOIN if odd and odd[i] else 0.0)
        joins[size] = joins[size - 1]
        ahead: dict[int, dict[tuple[int, int], tuple[float, tuple | None]]] = {0: {(0, 0): (0.0, None)}}
        for i in range(size):
            here = ahead.pop(i, None)
            if not here:
                continue
            if odd and i:
                for (a, b), (score, word) in list(here.items()):
                    if b:  # not again after an edge; the cost of joining was in the arc to this place
                        s = score + (joins[i] - joins[i - 1]) + logp[a][b][0]
                        if s > here.get((b, 0), (-math.inf,))[0]:
                            here[(b, 0)] = (s, (word, " "))
            arcs = self.arcs(token[i], i, ends[i])
            for (a, b), (score, word) in here.items():
                for j, letters, cost in arcs:
                    x, y, s = a, b, score - cost - (joins[j] - joins[i])
                    for letter in letters:
                        for byte in letter.encode():
                            z = int(_SYMBOL[byte])
                            s += logp[x][y][z]
                            x, y = y, z
                    there = ahead.setdefault(j, {})
                    old = there.get((x, y))
                    if old is None or s > old[0]:
                        there[(x, y)] = (s, (word, letters) if letters else word)
        last = [(s + logp[x][y][0], w) for (x, y), (s, w) in ahead.get(size, {}).items()]
        word, out = max(last, key=lambda r: r[0], default=(0.0, None))[1], []
        while word:
            word, letters = word
            out.append(letters)
        return "".join(reversed(out))

    def remembered(self, key: bytes, words: Callable[[], set[bytes]]) -> set[bytes]:
        """Words of a token; those of a token over LONGEST are worked out each time."""
        if len(key) > LONGEST:
            return words()
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known = {}
            got = self.known[key] = words()
        return got

    def restored(self, token: bytes) -> set[bytes]:
        return self.remembered(token, lambda: {self.decode(token.decode(errors="ignore")).encode()})

    def spelled(self, run: bytes) -> set[bytes]:
        """Words of single signs in a row: all joined, joined between odd separators, and parted by the lattice."""

        def words() -> set[bytes]:
            signs, gaps = zip(*_SIGN.findall(run.decode()))
            usual = Counter(gaps[:-1]).most_common(1)[0][0]
            odd = [False, *(g != usual for g in gaps[:-1])]
            token = "".join(signs)
            cuts = [0, *(i for i, x in enumerate(odd) if x), len(token)]
            out = {self.decode(t) for t in {token, *(token[a:b] for a, b in zip(cuts, cuts[1:]))}}
            return {w.encode() for w in out.union(self.decode(token, odd).split())}

        return self.remembered(run, words)

    def words(self, text: bytes) -> Counter:
        """How often a whole text has each word, as it stands or as restored."""
        text = text.lower()
        out = Counter(_WORD.findall(text))
        if _ODD.search(text):
            for token, times in Counter(t for t in _TOKEN.findall(text) if _ODD.search(t)).items():
                found = self.restored(token) | self.restored(token.rstrip(b"!$@|+("))
                for w in found.difference(_WORD.findall(token)):
                    out[w] += times
        for run, times in Counter(m[0] for m in _SPELLED.finditer(text)).items():
            for w in self.spelled(run):
                out[w] += times
        out.pop(b"", None)
        return out


def features(words: Iterable[bytes]) -> set[bytes]:
    """The words, and their stems with a mark."""
    out = set(words)
    own = list(out)
    for n in STEMS:
        out.update([w[:n] + b"*" for w in own if len(w) > n])
    return out


@dataclass
class ToxicityModel:
    """Character counts, log-likelihood ratios of telling words and stems, and how a sum of them becomes log-odds."""

    characters: np.ndarray
    weights: dict[bytes, float] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = -3.5

    def __post_init__(self) -> None:
        #: The first letters of all features: a word without them has no weight, whole or by a stem.
        self.starts = {f[: STEMS[0]] for f in self.weights}

    def weight(self, w: bytes) -> float:
        """The largest of a word's own weight and its stems', or 0."""
        get = self.weights.get
        x = get(w, 0.0)
        if len(w) > STEMS[0]:
            x = max(x, get(w[:4] + b"*", 0.0), get(w[:5] + b"*", 0.0) if len(w) > 5 else 0.0, get(w[:6] + b"*", 0.0) if len(w) > 6 else 0.0)
        return x

    def total(self, words: dict[bytes, int]) -> float:
        """Sum of weights over all uses of words."""
        out, starts, size = 0.0, self.starts, STEMS[0]
        for w, times in words.items():
            if w[:size] in starts:
                out += times * self.weight(w)
        return out

    def score(self, words: dict[bytes, int]) -> float:
        z = self.slope * self.total(words) + self.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def calibrated(histogram: dict[tuple[int, int], int]) -> tuple[float, float]:
    """Slope and offset of a logistic curve through counts by (cell, label), by Newton steps with a weak prior."""
    cells = np.array([c for c, _ in histogram], float) / 4
    y = np.array([k for _, k in histogram], float)
    n = np.array(list(histogram.values()), float)
    prior, beta = np.array([1.0, -3.5]), np.array([1.0, -3.5])
    x = np.stack([cells, np.ones(len(cells))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        slope = x @ (n * (y - p)) - (beta - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))) @ x.T + np.eye(2), slope)
        beta = beta + np.clip(step, -1, 1)
        beta[0] = max(beta[0], 0.05)
    return float(beta[0]), float(beta[1])


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        total += character_counts(as_bytes(batch, "text"))
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])


def _worded(characters):
    """The distinct words of labelled texts with their counts: decoded once, read by all that follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Restorer(characters.value)
        for batch in batches:
            found = [own.words(t) for t in as_bytes(batch, "text")]
            words, times = pa.array([list(x) for x in found], pa.list_(pa.binary())), pa.array([list(x.values()) for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), words, times], ["toxic", "words", "times"])

    return run


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a task have each feature, by label."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flushed() -> Iterator[pa.RecordBatch]:
        for label, own in enumerate(counts):
            items = list(own.items())
            for at in range(0, len(items), 1 << 16):
                names, n = zip(*items[at : at + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([label] * len(n), pa.int32()), pa.array(n, pa.int64())], ["feature", "toxic", "n"])
            own.clear()

    for batch in batches:
        for words, label in zip(batch.column("words").to_pylist(), batch.column("toxic").to_pylist()):
            counts[label].update(features(words))
        if len(counts[0]) + len(counts[1]) > 500_000:
            yield from flushed()
    yield from flushed()


def telling(known: DataFrame, n0: int, n1: int) -> DataFrame:
    """The features that tell toxic documents, with their weights: feature, weight.

    Both classes are counted for all features, whatever share of the toxic documents has them. A stem's counts leave out those of its most
    frequent word (of words in as many toxic documents the last by its bytes), whose documents are among its own.
    """
    per_task = by_arrow(known.select("words", "toxic"), _featured, "feature binary, toxic int, n bigint")
    of = lambda k: F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0))
    counts = written(per_task.groupBy("feature").agg(of(1).alias("a"), of(0).alias("b")).where(F.col("a") >= FEWEST), "features")
    tested = counts.count()
    star, size = F.lit(bytearray(b"*")), F.octet_length("feature")
    stems = F.filter(F.array(*(F.when(size > k, F.concat(F.substring("feature", 1, k), star)) for k in STEMS)), lambda x: x.isNotNull())
    words = counts.where(F.substring("feature", -1, 1) != star).withColumn("stem", F.explode(stems))
    leaders = words.groupBy("stem").agg(F.max(F.struct("a", "feature", "b")).alias("lead"))
    both = counts.join(leaders, F.col("feature") == F.col("stem"), "left").select("feature", *((F.col(x) - F.coalesce(F.col(f"lead.{x}"), F.lit(0))).alias(x) for x in "ab"))

    def term(k: Column, n: int, p: Column) -> Column:
        return F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)

    a, b, p = F.col("a"), F.col("b"), (F.col("a") + F.col("b")) / F.lit(float(n0 + n1))
    ratio = 2 * (term(a, n1, p) + term(b, n0, p) + term(n1 - a, n1, 1 - p) + term(n0 - b, n0, 1 - p))
    weight = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    enough = max(EVIDENCE, 2 * math.log(max(tested, 1)) + SLACK)
    return both.where("a > 0").select("feature", weight.alias("weight"), ratio.alias("ratio")).where((F.col("weight") >= LIFT) & (F.col("ratio") >= enough)).select("feature", "weight")


def _summed(model):
    """How many rows of a task have each sum of weights, by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        told = model.value
        for batch in batches:
            words, times = batch.column("words"), batch.column("times").flatten()
            flat, row = words.flatten(), pc.list_parent_indices(words)
            found: dict[int, dict[bytes, int]] = {}  # only words that begin as a feature does are taken out of their columns
            near = pc.is_in(pc.binary_slice(flat, 0, STEMS[0]), pa.array(list(told.starts), flat.type))
            for i, w, k in zip(*(c.filter(near).to_pylist() for c in (row, flat, times))):
                found.setdefault(i, {})[w] = k
            for i, y in enumerate(batch.column("toxic").to_pylist()):
                counts[min(CELLS, int(4 * told.total(found.get(i, {})))), y] += 1
        cells, labels = zip(*counts) if counts else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(labels, pa.int32()), pa.array(list(counts.values()), pa.int64())], ["cell", "toxic", "n"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns characters from all training texts, and features from the labelled training rows.

    Training rows are those whose crc32(doc_id) mod 5 is not 0. Only features
    that tell much are kept (see telling()), as weak ones add up in long texts; they are what each task holds. Sums of weights over all uses are then calibrated on all
    of these rows, so that one word alone, which clean texts have too, need not decide. A doc_id with both labels counts in both classes.
    """
    spark = docs.sparkSession
    train = docs.where(crc_mod(F.col("doc_id"), 5) != 0).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sums = by_arrow(train.select("text"), _characters, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    characters = np.zeros(SYMBOLS**3, np.int64)
    characters[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(characters)
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    known = written(by_arrow(train.join(marks.hint("shuffle_hash"), "doc_id").select("text", "toxic"), _worded(shared), "toxic int, words array<binary>, times array<bigint>"), "labelled")
    size = {r[0]: r[1] for r in known.groupBy("toxic").agg(F.count("*")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n1:
        return ToxicityModel(characters)
    told = telling(known, n0, n1).toArrow()
    model = ToxicityModel(characters, dict(zip(told.column("feature").to_pylist(), told.column("weight").to_pylist())))
    told_by = by_arrow(known, _summed(spark.sparkContext.broadcast(model)), "cell int, toxic int, n bigint").groupBy("cell", "toxic").agg(F.sum("n").alias("n"))
    model.slope, model.offset = calibrated({(r[0], r[1]): r[2] for r in told_by.collect()})
    return model


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Tokens with signs among letters, letters three times in a row, or single characters in a row (to one word
    or several) are decoded by Viterbi over a character lattice under a trigram model; the words of the whole text, as they stand and
    as restored, and their stems are then looked up, and the weights of all their uses added. Null and blank texts get the
    score of a text without a feature. Rows that repeat a doc_id are scored each; a null doc_id counts as
    held out, as its crc32 is taken as 0.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, told = Restorer(shared.value.characters), shared.value
        for batch in batches:
            score = [told.score(own.words(t)) for t in as_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], ["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return by_arrow(rows, run, "doc_id bigint, held_out boolean, score double, predicted int")
