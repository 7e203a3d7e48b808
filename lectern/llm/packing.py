"""Token-id output: documents packed into rows of fixed length by best-fit decreasing.

Each task tokenises its documents and packs them by windows of a bounded number of tokens, so nothing is shuffled, a
hot source costs no more than another and memory does not grow with the input. A document longer than a row is cut into
pieces without loss. Pieces, longest first, go to the open row with the least room that still holds them; a segment
tree over the possible capacities finds it in logarithmic time. A packed row holds its ids as little-endian bytes, so
the rows of a file make a matrix, with the cumulative lengths of its segments and the offsets where positions restart.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import textops as X

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text before byte-pair merging, as the vocabulary was made with it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 50_256
ROW_TOKENS = 2048
#: A window is packed when it holds this many tokens.
WINDOW_TOKENS = 1 << 22


class OpenRows:
    """Rows that still have room, by capacity. Leaf ``c`` of the tree tells whether a row has exactly ``c`` left."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (row, room) with the least room of at least ``need``."""
        node = need + self.leaves
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[node] = 0
            node >>= 1
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node >>= 1
        return row, room


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers, best fit decreasing. Every length is between 1 and ``capacity``."""
    rows: list[list[int]] = []
    room = OpenRows(capacity)
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = room.take(lengths[piece])
        row, left = found or (len(rows), capacity)
        if found is None:
            rows.append([])
        rows[row].append(piece)
        if left > lengths[piece]:
            room.add(row, left - lengths[piece])
    return rows


def encoder(vocabulary: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


COLUMNS = (
    "part int, window int, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<bigint>, pieces array<int>"
)
FIELDS = pa.schema(
    [
        ("part", pa.int32()), ("window", pa.int32()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())),
    ]
)


def packed_rows(
    docs: list[tuple[int | None, np.ndarray]], capacity: int, end_id: int, part: int, window: int
) -> Iterator[pa.RecordBatch]:
    """The packed rows of one window as batches."""
    pieces = [(d, k, i) for d, (_, ids) in enumerate(docs) for k, i in enumerate(range(0, len(ids), capacity))]
    lengths = [min(capacity, len(docs[d][1]) - i) for d, _, i in pieces]
    out: list[dict] = []
    for number, members in enumerate(pack(lengths, capacity)):
        ids = np.full(capacity, end_id, docs[0][1].dtype)
        ends = [0]
        for p in members:
            d, _, i = pieces[p]
            ids[ends[-1] : ends[-1] + lengths[p]] = docs[d][1][i : i + lengths[p]]
            ends.append(ends[-1] + lengths[p])
        out.append(
            {
                "part": part, "window": window, "row": number, "n_tokens": ends[-1], "ids": ids.tobytes(),
                "cu_seqlens": ends, "position_resets": ends[:-1],
                "doc_ids": [docs[pieces[p][0]][0] for p in members], "pieces": [pieces[p][1] for p in members],
            }
        )
        if len(out) == 512:
            yield pa.RecordBatch.from_pylist(out, FIELDS)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, FIELDS)


def pack_documents(
    docs: DataFrame, vocabulary: str = VOCABULARY, row_tokens: int = ROW_TOKENS, end_id: int = END_ID,
    window_tokens: int = WINDOW_TOKENS,
) -> DataFrame:
    """Packed rows of the documents (doc_id, text) of each partition, in their order.

    Every document, null and empty texts too, ends with ``end_id``; so each has a segment, and the ids of its pieces
    in order, without the last, decode to its text. ``n_tokens`` ids of a row are of segments, the rest is padding with
    ``end_id``. Ids take two bytes where the vocabulary allows, else four. Equal doc_ids stay separate documents.
    (part, window, row) names a row; on the same splits reruns agree. An empty table gives no rows.
    """
    ranks = Path(vocabulary).read_bytes()  # about a megabyte, sent with the tasks
    width = np.dtype("<u2") if end_id < 1 << 16 and ranks.count(b"\n") < 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).encode_ordinary
        part, window, held, waiting = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for doc_id, text in zip(ids_of, X.texts_of(batch.column(1)), strict=True):
                ids = np.array([*encode(text.decode("utf-8", "replace")), end_id], width)
                waiting.append((doc_id, ids))
                held += len(ids)
                if held >= window_tokens:
                    yield from packed_rows(waiting, row_tokens, end_id, part, window)
                    window, held, waiting = window + 1, 0, []
        if waiting:
            yield from packed_rows(waiting, row_tokens, end_id, part, window)

    return docs.select("doc_id", "text").mapInArrow(run, COLUMNS)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; the ``ids`` of its rows, one after the other, are the id matrix."""
    packed.write.parquet(path)


def position_ids(cu_seqlens: Column) -> Column:
    """Positions of a row's tokens: 0, 1, ... from each reset on."""
    lengths = F.transform(F.sequence(F.lit(1), F.size(cu_seqlens) - 1), lambda i: F.element_at(cu_seqlens, i + 1) - F.element_at(cu_seqlens, i))
    return F.flatten(F.transform(lengths, lambda n: F.sequence(F.lit(0), n - 1)))


def digest(packed: DataFrame) -> DataFrame:
    """A packed row without its ids, which a hash stands for."""
    return packed.withColumn("ids_sha256", F.sha2("ids", 256)).drop("ids")
