"""Token counts by trie-shared dynamic programming over a unigram piece vocabulary.

A text is cut into pre-tokens that no piece crosses (a run of spaces with the word after it, or a
line feed).  Distinct pre-tokens form a trie, walked in sorted order; the forward score of a node
(the best sum of piece scores over all segmentations of its prefix) and the number of tokens on
that path are computed once for all pre-tokens that share the prefix, and the count at each
pre-token's end is stored.  A text's count is the sum over its pre-tokens.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import text as T

_PRE = re.compile(" *[^ \n]+|\n| +")
#: Bytes that a process keeps for pre-tokens met before, about.
CACHE_BYTES = 48 << 20
_ENTRY = 160
_UNKNOWN_PENALTY = 10.0
_counters: dict[str, Counter] = {}


class Counter:
    """Counts of pre-tokens under the pieces of a sentencepiece model file.

    A file of merges has ranks in place of log-probabilities (its scores are their negatives);
    with ``ranks`` a piece of rank r has the log-probability of Zipf's law, -ln((r + 1) H), H
    being the sum of 1 / (r + 1), which is a model and no score that the file holds; without, the
    file's scores are taken as they are.  Spaces are written as U+2581.  A character that no piece covers is as many tokens as it has
    UTF-8 bytes (one if the vocabulary has no bytes), at the least score less a penalty.  Of
    equal scores the segmentation with the longer last piece wins."""

    def __init__(self, path: str, ranks: bool = True) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i))]
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if ranks:
            total = math.fsum(1 / (1 - v) for v in self.scores.values())
            self.scores = {p: -math.log((1 - v) * total) for p, v in self.scores.items()}
        self.bytes = any(model.is_byte(i) for i in ids)
        self.longest = max(map(len, self.scores))
        self.unknown = min(self.scores.values()) - _UNKNOWN_PENALTY
        self.known = T.Known(CACHE_BYTES, _ENTRY)

    def learn(self, words: Iterable[str]) -> Iterator[tuple[str, int]]:
        """The counts of pre-tokens: one forward step for each node of their trie."""
        scores, longest, last = self.scores.get, self.longest, ""
        forward, number = array("d", [0.0]), array("q", [0])
        for word in sorted(words):
            own = word.replace(" ", "▁")
            shared, most = 0, min(len(own), len(last))
            while shared < most and own[shared] == last[shared]:
                shared += 1
            del forward[shared + 1 :], number[shared + 1 :]
            for d in range(shared + 1, len(own) + 1):
                best, tokens = None, 0
                for start in range(max(0, d - longest), d):
                    score = scores(own[start:d])
                    if score is not None and (best is None or forward[start] + score > best):
                        best, tokens = forward[start] + score, number[start] + 1
                if scores(own[d - 1]) is None and (best is None or forward[d - 1] + self.unknown > best):
                    best, tokens = forward[d - 1] + self.unknown, number[d - 1] + (len(own[d - 1].encode()) if self.bytes else 1)
                forward.append(best)
                number.append(tokens)
            last = own
            yield word, number[-1]

    def _parts(self, parts: list[str]) -> list[tuple[int, int]]:
        words = [_PRE.findall(t) for t in parts]
        get = self.known.add(set().union(*words), self.learn)
        return [(sum(map(get, w)), len(w)) for w in words]

    def count(self, texts: Iterable[str], most: int = 1 << 20) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of each text; about ``most`` characters at a time."""
        out: list[list[int]] = []
        parts: list[tuple[int, str]] = []

        def flush() -> None:
            for (i, _), (n, m) in zip(parts, self._parts([t for _, t in parts])):
                out[i][0] += n
                out[i][1] += m
            parts.clear()

        size = 0
        for i, text in enumerate(texts):
            out.append([0, 0])
            for k, part in enumerate(T.pieces(text, most) if text else ()):  # no pre-token has a cut within
                parts.append((i, part if k else " " + part))
                size += len(part)
                if size >= most:
                    flush()
                    size = 0
        flush()
        return [(n, m) for n, m in out]


def counter(path: str) -> Counter:
    """The counter of a model file, one for each process."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Query op4: doc_id, n_tokens and n_pre_tokens for each row of ``docs``.

    Null and empty texts have no tokens; other texts start with a space as the vocabulary's
    pieces do; repeated rows are counted each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for part in T.slices(batch, "text", 1 << 20):
                found = own.count([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["doc_id", "n_tokens", "n_pre_tokens"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return scratch.map_arrow(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_pre_tokens long")
