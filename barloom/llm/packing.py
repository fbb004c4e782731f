"""Packing token pieces into windows by non-negative least squares over a length histogram."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import as_bytes, by_arrow, kept, written

WINDOW = 2048
#: Histogram cells; a longer window is counted in coarser units, so that the driver's part never grows.
CELLS = 2048
#: White-space-free chunks and words whose ids one Python worker remembers, and the longest such chunk: some 200 MB together.
REMEMBERED, REMEMBERED_WORDS, LONGEST = 500_000, 500_000, 64

#: ASCII punctuation without the apostrophe (which can begin a word of the tokenizer), and lower-case Latin words.
_PUNCT = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary has for each byte: printable Latin-1 as it is, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(other)) for b in range(256)}


class ChunkIds:
    """Token ids of white-space-free chunks as little-endian unsigned 32-bit, remembered by chunk.

    The tokenizer of word_bpe_49k.json drops white space and lower-cases before it splits, so that a text's
    ids are those of its chunks in order. Plain chunks (letters, then punctuation) split once more. Special tokens that are
    spelled out in a text are found in it before it is lower-cased; their chunks go to the tokenizer as they stand.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special)) if special else rb"(?!)")
        self.special_start = os.path.commonprefix(special)
        # the same merges, held once, over words that need no normalising and are split already
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        self.letters = byte_letters() | {32: " "}
        names = self.tokenizer.get_vocab()
        ends = np.zeros(max(names.values()) + 1, bool)
        ends[[i for t, i in names.items() if t.endswith("</w>")]] = True
        self.ends, self.known, self.atoms = ends, {}, {}

    def _encode_atoms(self, atoms: list[bytes]) -> None:
        """Atoms are one word of the tokenizer each and end at an id with the mark of a word's end."""
        for at in range(0, len(atoms), 50_000):
            part = atoms[at : at + 50_000]
            text = b" ".join(part).decode("latin-1").translate(self.letters)
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cut = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            self.atoms.update(zip(part, (raw[i:j] for i, j in zip([0, *cut], cut)), strict=True))

    def learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """The ids of chunks: of plain ones from a word and its punctuation, of others as the tokenizer has them."""
        if len(self.atoms) > REMEMBERED_WORDS:
            self.atoms = {}
        atoms, need, plain, other = self.atoms, set(), [], []
        for c in chunks:
            a = c.rstrip(_PUNCT)
            if not a or a.isalpha() or _LETTERS.fullmatch(a):
                t = c[len(a) :]
                if a and a not in atoms:
                    need.add(a)
                if t and t not in atoms:
                    need.add(t)
                plain.append((c, a, t))
            else:
                other.append(c)
        self._encode_atoms(list(need))
        out = {c: atoms[c] if not (a and t) else atoms[a] + atoms[t] for c, a, t in plain}
        self.tokenizer.encode_special_tokens = True  # what only lower-casing made a special token is none
        for c, x in zip(other, self.tokenizer.encode_batch_fast([c.decode() for c in other], add_special_tokens=False)):
            out[c] = np.array(x.ids, np.uint32).tobytes()
        return out

    def as_it_stands(self, chunk: bytes) -> bytes:
        """The ids of a chunk in which a special token is spelled out."""
        self.tokenizer.encode_special_tokens = False
        return np.array(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids, np.uint32).tobytes()

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text. Very long chunks are not remembered; of too many, those stay that come again in these texts."""
        if len(self.known) > REMEMBERED:
            again = Counter(w for t in texts for w in t.lower().split())
            self.known = {w: self.known[w] for w, n in again.items() if n > 1 and w in self.known}
        get, fresh, split, found = self.known.get, set(), [], []
        for t in texts:
            if self.special_start in t and self.special.search(t):
                words = [w if self.special.search(w) else w.lower() for w in t.split()]
                parts = [self.as_it_stands(w) if self.special.search(w) else get(w) for w in words]
            else:
                words = t.lower().split()
                parts = list(map(get, words))
            if None in parts:
                fresh.update([w for w, p in zip(words, parts) if p is None])
            split.append(words)
            found.append(parts)
        new = self.learn(fresh)
        self.known.update((c, x) for c, x in new.items() if len(c) <= LONGEST)
        for words, parts in zip(split, found):
            yield b"".join([new[w] if p is None else p for w, p in zip(words, parts)] if None in parts else parts)


def token_pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 1, digest: bool = False) -> DataFrame:
    """Cuts every document's ids (with end_id last) into full windows and a rest: one row a piece.

    doc_id, doc_tokens, start, length, and ids (little-endian unsigned 32-bit) or, with digest, their ids_crc32; then
    pack_task and pack_rank, which number the pieces of each length within their task. A null text is empty.
    """
    name = f"ids of {path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own, end, seen = kept(name, lambda: ChunkIds(path)), np.uint32(end_id).tobytes(), Counter()
        task = TaskContext.get().partitionId()
        for batch in batches:
            doc, total, start, length, ids, rank = [], [], [], [], [], []
            for i, x in zip(batch.column("doc_id").to_pylist(), own.encode(as_bytes(batch, "text"))):
                x += end
                n = len(x) // 4
                for a in range(0, n, window):
                    m = min(window, n - a)
                    part = x[4 * a : 4 * (a + m)]
                    doc.append(i)
                    total.append(n)
                    start.append(a)
                    length.append(m)
                    ids.append(zlib.crc32(part) if digest else part)
                    rank.append(seen[m])
                    seen[m] += 1
            columns = [pa.array(c, pa.int64()) for c in (doc, total, start, length)] + [pa.array(ids, pa.int64() if digest else pa.binary()), pa.array([task] * len(doc), pa.int64()), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc_tokens", "start", "length", held, "pack_task", "pack_rank"])

    held = "ids_crc32" if digest else "ids"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id bigint, doc_tokens bigint, start bigint, length bigint, {held} {'bigint' if digest else 'binary'}, pack_task bigint, pack_rank bigint"
    return by_arrow(rows, run, schema, name)


def combinations(cells: int) -> np.ndarray:
    """Every way to fill `cells` with one to three lengths, as rows (a >= b >= c, 0 for none): pairs first."""
    rows = [(cells, 0, 0)] + [(cells - b, b, 0) for b in range(1, cells // 2 + 1)]
    for c in range(1, cells // 3 + 1):
        b = np.arange(c, (cells - c) // 2 + 1)
        rows += list(zip((cells - c - b).tolist(), b.tolist(), [c] * len(b)))
    return np.array(rows, np.int64)


def non_negative_least_squares(combos: np.ndarray, counts: np.ndarray, sweeps: int = 16) -> np.ndarray:
    """x >= 0 with small |A x - counts|, A's columns the combinations: coordinate descent.

    The first sweep starts from a feasible point: it visits the combinations of the most frequent lengths
    first, gives each what its lengths have left and so leaves most at 0. Later sweeps minimise over those
    above 0 and, each fourth time, over those whose residuals say that they should grow.
    """
    rest = counts.astype(float).tolist()
    x = np.zeros(len(combos))
    rest[0] = 0.0

    def visit(which: np.ndarray, sweep: int) -> float:
        moved = 0.0
        for k, (a, b, c) in zip(which.tolist(), combos[which].tolist()):
            # the column holds how often each length occurs
            if b == 0:
                g, q = rest[a], 1.0
            elif c == 0:
                g, q = (rest[a] + rest[b], 2.0) if a != b else (2 * rest[a], 4.0)
            else:
                g = rest[a] + rest[b] + rest[c]
                q = 3.0 if a != b != c else (9.0 if a == b == c else 5.0)
            step = max(-x[k], g / q)
            if sweep == 0:
                step = min(rest[n] / (a, b, c).count(n) for n in (a, b, c) if n)
            if step:
                x[k] += step
                rest[a] -= step
                if b:
                    rest[b] -= step
                if c:
                    rest[c] -= step
                moved += abs(step)
        return moved

    for sweep in range(sweeps):
        r = np.array(rest)
        r[0] = 0
        gain = r[combos].sum(1)
        if sweep == 0:
            which = np.flatnonzero(np.all((counts[combos] > 0) | (combos == 0), 1))
            most = np.where(combos[which] > 0, counts[combos[which]], 0).max(1)
            which = which[np.argsort(-most, kind="stable")]
        elif sweep % 4:
            which = np.flatnonzero(x > 0)
        else:
            which = np.flatnonzero((x > 0) | (gain > 0.5))
        if len(which) == 0 or visit(which, sweep) < 1e-3 * max(1.0, counts.sum()):
            if sweep > 4:
                break
    return x


def pack_plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences) that use up the histogram {length: pieces} exactly; lengths sum to at most window.

    Combinations of up to three lengths that fill the window are repeated as least squares asks, rounded and
    held to what there is; what remains is packed greedily, longest first, each time with the longest that fit.
    """
    unit = -(-window // CELLS)
    cells = window // unit
    left = {n: c for n, c in histogram.items() if c > 0}
    plan: list[tuple[tuple[int, ...], int]] = []
    if full := left.pop(window, 0):
        plan.append(((window,), full))
    by_cell: dict[int, list[int]] = {}
    counts = np.zeros(cells + 1, np.int64)
    for n, c in sorted(left.items()):
        cell = -(-n // unit)
        if cell <= cells:
            by_cell.setdefault(cell, []).append(n)
            counts[cell] += c
    combos = combinations(cells)
    x = non_negative_least_squares(combos, counts)
    for k in sorted(np.flatnonzero(x >= 0.5).tolist(), key=lambda k: (-x[k], k)):
        want = int(x[k] + 0.5)
        parts = [int(p) for p in combos[k] if p]
        while want > 0:
            chosen: list[int] = []
            for p in parts:
                free = [n for n in by_cell.get(p, ()) if left.get(n, 0) > chosen.count(n)]
                if not free:
                    break
                chosen.append(free[-1])
            if len(chosen) < len(parts):
                break
            times = min(want, *(left[n] // chosen.count(n) for n in chosen))
            for n in chosen:
                left[n] -= times
            plan.append((tuple(chosen), times))
            want -= times
    lengths = sorted(n for n, c in left.items() if c > 0)
    while lengths:
        used: dict[int, int] = {}
        room, at = window, len(lengths) - 1
        while at >= 0 and room > 0:
            n = lengths[at]
            take = min(room // n, left[n] - used.get(n, 0))
            if take:
                used[n] = take
                room -= take * n
            at -= 1
        times = min(left[n] // k for n, k in used.items())
        plan.append((tuple(n for n, k in sorted(used.items(), reverse=True) for _ in range(k)), times))
        for n, k in used.items():
            left[n] -= k * times
        lengths = [n for n in lengths if left[n] > 0]
    return plan


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length its runs of places, in order: first rank, first sequence, places in a sequence, first offset."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for lengths, times in plan:
        offset = 0
        for n in dict.fromkeys(lengths):
            k = lengths.count(n)
            out.setdefault(n, []).append((ranks.get(n, 0), base, k, offset))
            ranks[n] = ranks.get(n, 0) + k * times
            offset += k * n
        base += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in out.items()}


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to the rows of token_pieces(), written before: at most `window` in a sequence, no gaps.

    Pieces are numbered by their tasks' own numbers and the counts of earlier tasks, so that no length, full windows
    included, meets in one task; the driver holds only the histogram (at most `window` numbers) and the plan made from it.
    """
    columns = [c for c in pieces.columns if c not in ("pack_task", "pack_rank")]
    by_task = pieces.groupBy("length", "pack_task").agg(F.count("*").alias("pack_n"))
    histogram = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("pack_n")).collect()}
    places = pieces.sparkSession.sparkContext.broadcast(slots(pack_plan(histogram, window)))
    before = F.coalesce(F.sum("pack_n").over(Window.partitionBy("length").orderBy("pack_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = by_task.select("length", "pack_task", before.alias("pack_first"))
    ranked = pieces.join(firsts, ["length", "pack_task"]).withColumn("pack_rank", F.col("pack_rank") + F.col("pack_first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("pack_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                first, base, many, at = table[int(n)]
                k = np.searchsorted(first, rank[rows], "right") - 1
                j = rank[rows] - first[k]
                sequence[rows] = base[k] + j // many[k]
                offset[rows] = at[k] + j % many[k] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name in columns)
    return by_arrow(ranked.select(*columns, "pack_rank"), run, f"{own}, sequence_id bigint, offset bigint")


def packed_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """Packs all documents: a row per piece with doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its tokenizer ids and end_id; it is cut at multiples of `window`, so that only its rest
    shares a sequence. A null or blank text is end_id alone. Rows that repeat a doc_id are packed each.
    """
    pieces = written(token_pieces(docs, path, window, end_id, digest=True), "pieces")
    return pack(pieces, window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
