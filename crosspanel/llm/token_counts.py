"""Token counts of a unigram vocabulary without making the tokens (operator 3).

An Aho-Corasick automaton lists every vocabulary piece that ends at a place; the
Viterbi recursion carries the best score and how many pieces it took, nothing to
trace back. Ties go as in the tokenizer: a path replaces another only if it is
better, and starts are tried from the left, so the longest last piece wins. A
character no piece covers alone is unknown, ten below the worst score; unknown
neighbours are one piece, or, where the model has byte pieces, each is as many
pieces as it has bytes in UTF-8 (its score stays that of an unknown one).

White space: a space becomes the mark U+2581, one more goes in front of the
text. A text is cut where a mark follows another character; if a piece of the
vocabulary has a mark after another character, nothing is cut. Null and empty
texts have no tokens and score 0.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.text import Remembered

MARK, PENALTY = "▁", 10.0


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a model file, without control, unknown and byte pieces."""
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())
            if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]


def has_byte_pieces(path: str) -> bool:
    """Whether a model file spells characters it doesn't cover in bytes."""
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=path)
    return any(model.is_byte(k) for k in range(model.get_piece_size()))


def automaton(vocabulary: list[tuple[str, float]]) -> tuple[ahocorasick.Automaton, float]:
    """The automaton of the pieces and the score of an unknown character."""
    pieces = ahocorasick.Automaton()
    for piece, score in vocabulary:
        pieces.add_word(piece, (len(piece), score))
    pieces.make_automaton()
    return pieces, min(score for _, score in vocabulary) - PENALTY


def count(pieces: ahocorasick.Automaton, unknown: float, text: str, byte_pieces: bool = False) -> tuple[int, float]:
    """How many pieces the best path takes, and its score."""
    n = len(text)
    ends: list[list] = [[] for _ in range(n + 1)]
    alone = [False] * n
    for last, piece in pieces.iter(text):
        ends[last + 1].append(piece)
        if piece[0] == 1:
            alone[last] = True
    score, taken, open_ = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
    for end in range(1, n + 1):
        best = None
        for size, value in sorted(ends[end], reverse=True) if len(ends[end]) > 1 else ends[end]:
            here = score[end - size] + value
            if best is None or here > best:
                best, at = here, end - size
        if not alone[end - 1]:
            here = score[end - 1] + unknown
            if best is None or here > best:
                score[end], open_[end] = here, True
                taken[end] = taken[end - 1] + (
                    len(text[end - 1].encode()) if byte_pieces else not open_[end - 1])
                continue
        score[end], taken[end] = best, taken[at] + 1
    return taken[n], score[n]


def _count(vocabulary: list[tuple[str, float]], text: int, byte_pieces: bool):
    def run(batches):
        pieces, unknown = automaton(vocabulary)
        whole = any(MARK in p.lstrip(MARK) for p, _ in vocabulary) or MARK not in dict(vocabulary)
        cut = re.compile(f"{MARK}+[^{MARK}]*")
        known = Remembered(lambda chunks: [count(pieces, unknown, c, byte_pieces) for c in chunks])
        for batch in batches:
            tokens, scores = [], []
            for value in batch.column(text):
                value = value.as_py()
                marked = MARK + value.replace(" ", MARK) if value else ""
                found = known.of([marked] if whole and marked else cut.findall(marked))
                tokens.append(sum(n for n, _ in found))
                scores.append(sum((s for _, s in found), 0.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())],
                [*batch.schema.names, "n_tokens", "score"])
    return run


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]], byte_pieces: bool = False) -> DataFrame:
    """(doc_id, n_tokens, score) of each row of ``docs(doc_id, text)``; score is the best path's."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: _count(sent.value, 1, byte_pieces)(batches),
        f"doc_id {kind}, text string, n_tokens long, score double").drop("text")
