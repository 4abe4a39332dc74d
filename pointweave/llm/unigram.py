"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

A pre-token is a word (a run of anything but ASCII white space) with a word mark before it. Its best segmentation is the
one of greatest total score; a code point that no piece covers costs its UTF-8 bytes as byte tokens. The distinct
pre-tokens of a batch are walked as a trie (in sorted order, so that a word goes on from the prefix it shares with the one
before): each trie node's forward score and token count are computed once, for all words below it, and the
terminal nodes' counts are stored. Among equally good segmentations the one with fewer tokens counts.

Piece scores are a fixed rule of the vocabulary file's rank order: -ln(rank + 2) (a Zipf law); no tokenizer is trained.
Null text has 0 tokens. Repeated rows are counted row by row; other columns do not matter. An empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import lean_batches

MARK = "▁"
BYTE_SCORE = -14.0
#: Words whose counts a worker keeps at a time.
KEPT_WORDS = 600_000

_WORD = re.compile(r"[\x20\x09-\x0D]+")


def vocabulary(model_path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file with their Zipf scores, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return {model.id_to_piece(i): -math.log(rank + 2) for rank, i in enumerate(pieces)}


class TrieCounter:
    """Counts tokens of words; one forward step per distinct prefix."""

    def __init__(self, scores: dict[str, float]):
        #: every ending of a piece, with its score if it is a piece itself: a search backwards stops at the first miss
        self.endings: dict[str, float | None] = {piece[k:]: None for piece in scores for k in range(1, len(piece))}
        self.endings.update(scores)
        self.known: dict[str, int] = {}

    def step(self, full: str, end: int, best: list[float], count: list[int]) -> None:
        """Append the forward score and token count of full[:end], given those of all shorter prefixes."""
        endings = self.endings
        width = len(full[end - 1].encode("utf-8", "surrogatepass"))
        top, n = best[end - 1] + BYTE_SCORE * width, count[end - 1] + width
        begin = end - 1
        while begin >= 0:
            s = endings.get(full[begin:end], 0)
            if s == 0:
                break
            if s is not None:
                s += best[begin]
                if s >= top:
                    k = count[begin] + 1
                    if s > top or k < n:
                        top, n = s, k
            begin -= 1
        best.append(top)
        count.append(n)

    def learn(self, new: list[str]) -> None:
        path = ""
        best, count = [0.0], [0]  # per prefix length of the current trie path
        for word in sorted(new):
            full = MARK + word
            same, most = 0, min(len(path), len(full))
            while same < most and path[same] == full[same]:
                same += 1
            del best[same + 1 :], count[same + 1 :]
            for end in range(same + 1, len(full) + 1):
                self.step(full, end, best, count)
            path = full
            self.known[word] = count[-1]

    def totals(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        docs = [[w for w in _WORD.split(t or "") if w] for t in texts]
        self.learn(list(set().union(*docs).difference(self.known)))
        return [sum(map(self.known.__getitem__, d)) for d in docs]


@functools.cache
def shared_counter(model_path: str) -> TrieCounter:
    """One counter for all tasks of a worker."""
    return TrieCounter(vocabulary(model_path))


def _counter(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared_counter(model_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                texts = batch.column(1).slice(lo, 1024).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 1024), pa.array(trie.totals(texts), pa.int64())], ["doc_id", "n_tokens"])

    return run


def token_counts(df: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_tokens."""
    lean_batches(df.sparkSession)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(_counter(model_path), "doc_id long, n_tokens long")
