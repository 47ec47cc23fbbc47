"""Token counts by heap-and-linked-list byte-pair merging, without making identifiers.

The vocabulary file of a public sentencepiece BPE model gives pieces and ranks. A text is put into the
model's form (a dummy space in front, spaces as U+2581) and cut where no piece of the vocabulary spans
a cut: before each run of spaces. Within a cut the lowest-rank adjacent pair, leftmost among ties, is
popped from a heap and merged in a linked list until none is left. The count is the number of initial
symbols minus the merges; a symbol that is not in the vocabulary counts its UTF-8 bytes instead.

Spark deals the documents over tasks; no row leaves its partition, so a hot source costs nothing and
nothing is shuffled. A task remembers the counts of short cuts it has met, up to ``MEMO`` of them.

Null and empty texts have 0 tokens. Texts are processed whole, whatever their length. Repeated rows give
repeated rows, an empty table an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cuts of text whose counts a task remembers, and the longest that it remembers, in characters.
MEMO, MEMO_CHARS = 600_000, 24

SPACE = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


@lru_cache(maxsize=4)
def vocabulary(path: str) -> dict[str, float]:
    """Pieces that merging can make or that count as one symbol -> rank (lower merges first)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        model.id_to_piece(i): -model.get_score(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }


def count_merged(symbols: str, ranks: dict[str, float]) -> int:
    """Tokens of one cut of text. ``symbols``: its characters, the initial symbols."""
    n = len(symbols)
    unknown = sum(len(c.encode()) - 1 for c in symbols if c not in ranks)
    if n == 1:
        return 1 + unknown
    piece: list[str] = list(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i] + piece[i + 1])) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, length = heapq.heappop(heap)
        j = after[i]
        # An entry is stale if either side has been merged since it was pushed.
        if not piece[i] or j >= n or len(piece[i]) + len(piece[j]) != length:
            continue
        piece[i] += piece[j]
        piece[j] = ""
        k = after[i] = after[j]
        merges += 1
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i] + piece[k])) is not None:
                heapq.heappush(heap, (r, i, length + len(piece[k])))
        h = before[i]
        if h >= 0 and (r := ranks.get(piece[h] + piece[i])) is not None:
            heapq.heappush(heap, (r, h, len(piece[h]) + length))
    return n - merges + unknown


_CUTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class _Memo(dict):
    """Counts of the cuts met so far."""

    def __init__(self, ranks: dict[str, float]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, cut: str) -> int:
        n = count_merged(cut, self.ranks)
        if len(cut) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[cut] = n
        return n


@lru_cache(maxsize=4)
def _memo(path: str) -> _Memo:
    return _Memo(vocabulary(path))


def counter(path: str) -> Callable[[str], int]:
    """Text -> number of tokens, by the model file at ``path``."""
    memo = _memo(path)

    def count(text: str) -> int:
        if not text:
            return 0
        return sum(map(memo.__getitem__, _CUTS.findall(SPACE + text.replace(" ", SPACE))))

    return count


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path)
        for batch in batches:
            tokens = pa.array([count(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), tokens, pa.array((n.as_py() > limit for n in tokens), pa.bool_(), size=len(tokens))],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, SCHEMA)
