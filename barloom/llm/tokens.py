"""Token counts of a unigram tokenizer by Aho-Corasick matching and a count-only Viterbi."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import as_bytes, by_arrow, kept

#: What a tokenizer of this kind adds to its lowest score for a character that no piece covers.
UNKNOWN_PENALTY = 10.0
#: Words whose counts one Python worker remembers, and the longest such word.
REMEMBERED, LONGEST = 500_000, 200
SPACE_MARK = "▁"
#: The score of a place that no segmentation reaches.
NEVER = float("-inf")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id, of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


@lru_cache(maxsize=4)
def plain_vocabulary(path: str) -> list[tuple[str, float]]:
    """vocabulary() without the model's control, unknown, unused and byte pieces: pieces that stand for their own characters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [x for i, x in enumerate(vocabulary(path)) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]


class UnigramCounter:
    """Counts the tokens of the best segmentation of a text, with the ties of the usual unigram tokenizer.

    At each end of a match, candidates come in order of their start, and only a higher score replaces an
    earlier one. A character without a piece of its own may stand as unknown, at the lowest score less
    UNKNOWN_PENALTY; with byte fallback it then counts as its UTF-8 bytes, if all of these are pieces, else
    neighbouring unknowns count as one.
    """

    def __init__(self, path: str):
        import ahocorasick

        pieces = vocabulary(path)
        self.matches = ahocorasick.Automaton()
        seen: dict[str, float] = {}
        for piece, score in pieces:
            if piece:
                seen[piece] = score
        for piece, score in seen.items():
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.single = {p for p in seen if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in seen for b in range(256))
        # words may be cut before a mark only if no piece has one after another character
        self.cut = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in seen)
        # neighbours inside some piece; between others every segmentation has a cut
        self.pairs = {p[i : i + 2] for p in seen for i in range(len(p) - 1)}
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Tokens of one text in which spaces are marks already."""
        n = len(text)
        best, many, open_ = array("d", [NEVER]) * (n + 1), array("q", [0]) * (n + 1), bytearray(n + 1)
        best[0] = 0.0
        matches = self.matches.iter(text)  # in order of their ends
        end, (size, score) = next(matches, (n, (0, 0.0)))
        for e in range(1, n + 1):
            top, pieces, unknown, here = NEVER, 0, False, []
            while end == e - 1:
                here.append((e - size, score))
                end, (size, score) = next(matches, (n, (0, 0.0)))
            for start, score_ in sorted(here):
                if best[start] + score_ > top:
                    top, pieces, unknown = best[start] + score_, many[start] + 1, False
            c = text[e - 1]
            if c not in self.single and best[e - 1] + self.unknown > top:
                top = best[e - 1] + self.unknown
                if self.bytes:
                    pieces = many[e - 1] + len(c.encode())
                else:
                    pieces, unknown = many[e - 1] + (not open_[e - 1]), True
            best[e], many[e], open_[e] = top, pieces, unknown
        return many[n]

    def tokens(self, text: str) -> int:
        """Tokens of a raw text: a mark before it and for each space."""
        marked = SPACE_MARK + text.replace(" ", SPACE_MARK) if text else ""
        if not self.cut:
            return self.count(marked)
        total = 0
        for word in re.findall(f"{SPACE_MARK}+[^{SPACE_MARK}]*", marked):
            n = self.known.get(word)
            total += self.learned(word) if n is None else n
        return total

    def learned(self, word: str) -> int:
        """Counts a word in parts that no piece joins, and remembers it."""
        parts, at = [], 0
        if self.bytes:  # else unknowns fuse over a cut
            for i in range(1, len(word)):
                if word[i - 1 : i + 1] not in self.pairs:
                    parts.append(word[at:i])
                    at = i
        parts.append(word[at:])
        if len(self.known) >= REMEMBERED:
            self.known = {}
        n = 0
        for part in parts:
            m = self.known.get(part)
            if m is None:
                m = self.count(part)
                if len(part) <= LONGEST:
                    self.known[part] = m
            n += m
        if len(word) <= LONGEST:
            self.known[word] = n
        return n


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_chars.

    n_tokens is the length of the best segmentation of the whole text under the pieces and scores of the
    vocabulary file, as a unigram tokenizer gives it (a mark stands for each space and before the text).
    Where no piece crosses into a word, words are counted once and remembered; else the text is one lattice.
    A null or empty text has 0 tokens. Rows that repeat a doc_id are counted each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(f"counts of {path}", lambda: UnigramCounter(path))
        for batch in batches:
            texts = [t.decode() for t in as_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([own.tokens(t) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64())], ["doc_id", "n_tokens", "n_chars"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return by_arrow(rows, run, "doc_id bigint, n_tokens bigint, n_chars bigint", f"counts of {path}")
