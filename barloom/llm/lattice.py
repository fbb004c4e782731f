"""Document likelihood from subword lattices: an existing vocabulary, all segmentations, weights tuned on the corpus."""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import as_bytes, by_arrow, crc_mod, gathered, prefix_hashes, slice_hashes, written
from barloom.llm.tokens import SPACE_MARK
from barloom.llm.tokens import plain_vocabulary as vocabulary

#: Words with at least one in so many of all training tokens (so at most so many words) have their scores sent to every
#: task; the others' are joined. Scores are the same either way.
FREQUENT = 1 << 16
#: Words above LONG bytes are taken one by one.
LONG = 192
END = b"\n"
#: Share that the given weights keep in every re-estimation; these end when one gains fewer nats a training token than SETTLED.
GIVEN, SETTLED = 0.1, 0.01
LN10 = float(np.log(10))
#: Words whose least likely segmentation is above exp(-PLAIN) are added up as they are, longer ones by their logs.
PLAIN = 600.0
#: A piece is looked up only where its size's table of 2^16 hash prefixes has a mark.
_SPREAD, _PREFIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(48)


class Pieces:
    """The vocabulary's pieces as byte strings with log-probabilities, and the 256 bytes to fall back on.

    A text is a run of pieces and an end; a word begins with a mark, which is a space here, so that a piece that begins
    a word ends the one before. `logp` has a row for each piece and a last one for the end; their weights sum to one.
    """

    def __init__(self, names: list[bytes], logp: np.ndarray):
        self.names, self.logp = names, logp
        hashes = []
        for name in names:
            sums, back = prefix_hashes(np.frombuffer(name, np.uint8))
            hashes.append(int(slice_hashes(sums, back, np.array([0]), np.array([len(name)]))[0]))
        keys = np.array(hashes, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.sizes = np.array([len(x) for x in names])
        self.by_name = {x: i for i, x in enumerate(names)}
        self.lengths = sorted({*map(int, self.sizes)})
        self.marked, self.sorted = {}, {}
        for size in self.lengths:
            own = self.marked[size] = np.zeros(1 << 16, bool)
            own[(keys[self.sizes == size] * _SPREAD) >> _PREFIX] = True
            who = order[self.sizes[order] == size]
            self.sorted[size] = (keys[who], who)
        self.bytes = np.array([self.by_name.get(bytes([b]), -1) for b in range(256)])

    def weighing(self, logp: np.ndarray) -> Pieces:
        """The same pieces with other weights."""
        other = copy.copy(self)
        other.logp = logp
        return other

    def find(self, h: np.ndarray, size: int) -> np.ndarray:
        """Place of the piece with each hash and that size, -1 for none."""
        keys, who = self.sorted[size]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, who[at], -1)

    def matches(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For words of one length (rows of bytes): start, end, and the rows that have a piece there with these pieces, by end."""
        m, n = words.shape
        flat, back = prefix_hashes(words.ravel())
        sums, back = np.concatenate([flat[:-1].reshape(m, n).T, flat[None, n::n]]), np.ascontiguousarray(back[: m * n].reshape(m, n).T)
        for e in range(1, n + 1):
            for size in self.lengths:
                if size > e:
                    break
                if size == 1:
                    who = self.bytes[words[:, e - 1]]
                    rows = np.flatnonzero(who >= 0)
                    if len(rows):
                        yield e - 1, e, rows, who[rows]
                    continue
                h = (sums[e] - sums[e - size]) * back[e - size]
                rows = np.flatnonzero(self.marked[size][(h * _SPREAD) >> _PREFIX])
                if len(rows):
                    who = self.find(h[rows], size)
                    hit = who >= 0
                    if hit.any():
                        yield e - size, e, rows[hit], who[hit]

    def plain(self, size: int) -> bool:
        """Whether words of that size are added up as they are: no segmentation of theirs can fall below what a double holds."""
        return size * -float(self.logp[:-1].min()) < PLAIN

    def sums(self, words: np.ndarray) -> tuple[np.ndarray, list]:
        """forward() without logs, for words that are plain()."""
        m, n = words.shape
        weight = np.exp(self.logp)
        alpha = np.zeros((n + 1, m))
        alpha[0] = 1.0
        arcs = []
        for start, end, rows, who in self.matches(words):
            step = weight[who]
            alpha[end][rows] += alpha[start][rows] * step
            arcs.append((start, end, rows, who, step))
        return alpha, arcs

    def forward(self, words: np.ndarray) -> tuple[np.ndarray, list]:
        """For words of one length (rows of bytes): log-sums over segmentations of each prefix, and the arcs used."""
        m, n = words.shape
        alpha = np.full((n + 1, m), -np.inf)
        alpha[0] = 0.0
        arcs = []
        for start, end, rows, who in self.matches(words):
            step = self.logp[who]
            alpha[end][rows] = np.logaddexp(alpha[end][rows], alpha[start][rows] + step)
            arcs.append((start, end, rows, who, step))
        return alpha, arcs

    def ending(self, word: bytes, e: int) -> list[tuple[int, int]]:
        """(start, piece) of the pieces that end at place e of a word."""
        return [(e - size, i) for size in self.lengths if size <= e and (i := self.by_name.get(word[e - size : e])) is not None]

    def prefixes(self, word: bytes) -> np.ndarray:
        """The log-sum of each prefix of a single long word; arcs are found anew where they are needed, so that a byte takes one number."""
        alpha = np.full(len(word) + 1, -np.inf)
        alpha[0] = 0.0
        for e in range(1, len(word) + 1):
            terms = np.array([alpha[start] + self.logp[i] for start, i in self.ending(word, e)])
            top = terms.max()
            alpha[e] = top + np.log(np.exp(terms - top).sum())
        return alpha

    def one(self, word: bytes) -> float:
        """The log-sum of a single long word."""
        return float(self.prefixes(word)[-1])

    def log_marginals(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability, summed over all its segmentations."""
        out = np.zeros(len(words))
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        for size, rows in by_size.items():
            if size > LONG:
                for i in rows:
                    out[i] = self.one(words[i])
            elif size:
                for at in range(0, len(rows), step := max(64, 65536 // size)):
                    part = rows[at : at + step]
                    spelled = np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), size)
                    out[part] = np.log(self.sums(spelled)[0][-1]) if self.plain(size) else self.forward(spelled)[0][-1]
        return out

    def expected(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of words that occur so many times."""
        return self.uses(words, times)[0]

    def uses(self, words: list[bytes], times: np.ndarray) -> tuple[np.ndarray, float]:
        """expected(), and the natural log of the probability of all these words."""
        out, whole = np.zeros(len(self.logp)), 0.0
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w:
                by_size.setdefault(len(w), []).append(i)
        for size, rows in by_size.items():
            if size > LONG:
                for w, k in ((words[i], times[i]) for i in rows):
                    alpha = self.prefixes(w)
                    whole += k * alpha[-1]
                    beta = np.full(size + 1, -np.inf)
                    beta[size] = 0.0
                    for end in range(size, 0, -1):
                        for start, i in self.ending(w, end):
                            step = self.logp[i] + beta[end]
                            beta[start] = np.logaddexp(beta[start], step)
                            out[i] += k * np.exp(alpha[start] + step - alpha[-1])
                continue
            for at in range(0, len(rows), step := max(64, 65536 // size)):
                part, k = [words[i] for i in rows[at : at + step]], times[rows[at : at + step]]
                spelled = np.frombuffer(b"".join(part), np.uint8).reshape(len(part), size)
                if self.plain(size):
                    alpha, arcs = self.sums(spelled)
                    whole += float(k @ np.log(alpha[-1]))
                    share, beta, used = k / alpha[-1], np.zeros((size + 1, len(part))), []
                    beta[size] = 1.0
                    for start, end, own, _, weight in reversed(arcs):
                        through = weight * beta[end][own]
                        beta[start][own] += through
                        used.append(share[own] * (alpha[start][own] * through))
                    out += np.bincount(np.concatenate([who for _, _, _, who, _ in reversed(arcs)]), np.concatenate(used), len(out))
                    continue
                alpha, arcs = self.forward(spelled)
                whole += float(k @ alpha[-1])
                beta = np.full((size + 1, len(part)), -np.inf)
                beta[size] = 0.0
                for start, end, own, who, weight in reversed(arcs):
                    through = beta[end][own] + weight
                    beta[start][own] = np.logaddexp(beta[start][own], through)
                    out += np.bincount(who, k[own] * np.exp(alpha[start][own] + through - alpha[-1][own]), len(out))
        return out, whole


def starting_pieces(path: str) -> Pieces:
    """Pieces without ASCII capitals (texts have none) weighted by the scores of the file, all bytes, and the end.

    The scores of a merge vocabulary are negative ranks; we let a rank r weigh 1 / (r + 20), as word ranks do. The end is
    one of the file's signs of rank 0.
    """
    weight: dict[bytes, float] = {bytes([b]): 1e-6 for b in range(256)}
    for piece, score in vocabulary(path):
        text = piece.replace(SPACE_MARK, " ").encode()
        if text and text == text.lower():
            weight[text] = max(weight.get(text, 0.0), 1.0 / (20.0 - min(0.0, score)))
    p = np.array([*weight.values(), 1 / 20])
    return Pieces(list(weight), np.log(p / p.sum()))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's words with their counts in training rows (0 for words of held-out rows only)."""
    counts: Counter = Counter()

    def flushed() -> Iterator[pa.RecordBatch]:
        items = list(counts.items())
        for at in range(0, len(items), 1 << 16):
            words, n = zip(*items[at : at + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

    for batch in batches:
        for text, held in zip(as_bytes(batch, "text"), batch.column("held_out").to_pylist()):
            words = text.lower().split()
            if held:
                for w in set(words):
                    counts.setdefault(w, 0)
                counts.setdefault(END, 0)
            else:
                counts.update(words)
                counts[END] += 1
        if len(counts) > 1_000_000:
            yield from flushed()
            counts.clear()
    yield from flushed()


def _uses(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, whole = np.zeros(len(pieces.logp) + 1), len(pieces.logp)  # the last is the log-likelihood
        for batch in gathered(batches):
            uses, likely = pieces.uses([b" " + w for w in batch.column("word").to_pylist()], batch.column("c").to_numpy(zero_copy_only=False).astype(float))
            total[:whole] += uses
            total[whole] += likely
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["piece", "uses"])

    return run


def _weighed(pieces: Pieces, n: int, v: int):
    """Words with log10 of both probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            words, c = batch.column("word").to_pylist(), batch.column("c").to_numpy(zero_copy_only=False).astype(float)
            spelled = pieces.log_marginals([b"" if w == END else b" " + w for w in words])
            logs = np.where([w == END for w in words], pieces.logp[-1], spelled) / LN10
            base = np.log10((c + 1) / (n + v + 1))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(base), pa.array(logs)], ["word", "c", "base_log", "model_log"])

    return run


def _looked_up(frequent):
    """A row for each text with the sums over frequent words, and one for each other word in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        for batch in batches:
            uid, doc, held, word, n, known, base, model = ([] for _ in range(8))
            for u, i, h, text in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "held_out")), as_bytes(batch, "text")):
                words = text.lower().split()
                words.append(END)
                k, b, m, rare = 0, 0.0, 0.0, 0
                for w, times in Counter(words).items():
                    row = table.get(w)
                    if row is None:
                        rare += 1
                        word.append(w)
                        n.append(times)
                    else:
                        k += times * (row[0] > 0)
                        b += times * row[1]
                        m += times * row[2]
                uid += [u] * (rare + 1)
                doc += [None] * rare + [i]
                held += [None] * rare + [h]
                word.append(None)
                n.append(len(words))
                known += [0] * rare + [k]
                base += [0.0] * rare + [b]
                model += [0.0] * rare + [m]
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid, pa.int64()), pa.array(doc, pa.int64()), pa.array(held, pa.bool_()), pa.array(word, pa.binary()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(model)],
                ["uid", "doc_id", "held_out", "word", "n", "known", "base", "model"],
            )

    return run


def lattice_scores(docs: DataFrame, path: str, settled: float = SETTLED) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Tokens are words (A-Z lower-cased) and one end per text. Training rows are those whose crc32(doc_id) mod 7
    is not 2. base_score adds log10((c + 1) / (N + V + 1)). score is the marginal of the
    text over all its segmentations in pieces of the existing vocabulary: each word, known or not, with its mark adds the
    log of the sum over its segmentations, by a forward recursion (in the log for long words; no piece has a mark inside), and the end its own
    weight. A piece's weight is the vocabulary's own in a share of GIVEN, for the rest its expected uses in the training
    words under the weights before, by the words' counts, again and again until a round finds the training words less than
    `settled` nats a token likelier than the round before did. So what every task holds is one number per piece. Counts of words stay distributed
    but for those above one in FREQUENT tokens (so at most FREQUENT), which only spares their join. A null
    text is empty and has its end alone. Rows that repeat a doc_id are trained on and scored each; a null
    doc_id counts as a training row. With no training row the given weights stand.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"),
        (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"), F.col("text").cast("string").alias("text"),
    )
    counts = written(by_arrow(rows.select("text", "held_out"), _words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c")), "words")
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0))).first()
    pieces = starting_pieces(path)
    given = np.exp(pieces.logp)
    trained = counts.where((F.col("c") > 0) & (F.col("word") != F.lit(END))).select("word", "c")
    before, gain = -np.inf, np.inf
    while n and gain >= settled * n:
        found = by_arrow(trained, _uses(pieces), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        got = np.zeros(len(given) + 1)
        got[found.column("piece").to_numpy()] = found.column("uses").to_numpy()
        got, likely = got[:-1], float(got[-1]) + ends * pieces.logp[-1]
        gain, before = likely - before, likely
        got[-1] = ends
        if got.sum():
            pieces = pieces.weighing(np.log(GIVEN * given + (1 - GIVEN) * got / got.sum()))
    weighed = written(by_arrow(counts, _weighed(pieces, n, v), "word binary, c bigint, base_log double, model_log double"), "weights")
    top = weighed.where(F.col("c") >= max(1.0, n / FREQUENT)).toArrow()
    frequent = spark.sparkContext.broadcast({w: (c, b, m) for w, c, b, m in zip(*(top.column(x).to_pylist() for x in ("word", "c", "base_log", "model_log")))})
    looked = written(by_arrow(rows, _looked_up(frequent), "uid bigint, doc_id bigint, held_out boolean, word binary, n bigint, known bigint, base double, model double"), "looked_up")
    rare = looked.where("word is not null").select("uid", "word", "n").join(weighed.where(F.col("c") < max(1.0, n / FREQUENT)), "word", "left")
    rare = rare.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.col("base_log")).alias("more_base"), F.sum(F.col("n") * F.col("model_log")).alias("more_model")
    )
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return looked.where("word is null").join(rare, "uid", "left").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), add("known", "more_known").cast("bigint").alias("n_known"), F.lit(int(n)).cast("bigint").alias("train_tokens"),
        add("base", "more_base").alias("base_score"), add("model", "more_model").alias("score"),
    )
