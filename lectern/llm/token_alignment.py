"""Alignment of two tokenizers' tokens by lockstep merging.

Byte offsets make both token sequences of a text cut the same bytes. One numpy state vector holds an A and a B pointer for
every lane; a step emits the link of each lane's two tokens, advances the pointer whose token ends first (both at a common
end, which is a cut) and drops finished lanes. A document is a lane; a long one makes several, between common ends, so a
step always works on many. How often two ids are linked is counted over the corpus from per-document counts; a bounded
number of the most frequent pairs goes to every task, the other pairs are joined.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import textops as X
from lectern.llm.packing import PATTERN
from lectern.session import materialise

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
LANE_TOKENS = 256
#: A tokens searched for a common end at which a long document is cut into lanes.
SEARCH = 32
#: Pairs whose counts are sent to every task: 17 bytes each, so about 4 MB at any size of the corpus.
FREQUENT = 1 << 18
#: Texts of these characters only go through the faster library; all Unicode versions agree on their classes.
PLAIN = re.compile("[\t\n\r -~¡-ȳ‐-‧‰-⁞€]*")


def byte_vocabulary(text: str) -> tuple[list[bytes], dict[bytes, int]]:
    """The bytes of each id of a byte-level vocabulary file, and its ids by bytes without the special tokens."""
    parsed = json.loads(text)
    # Byte-level names: printable bytes stand for themselves, the others for the characters from U+0100 on.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes([back[c] for c in name]): i for name, i in parsed["model"]["vocab"].items() if all(c in back for c in name)}
    special = {t["id"]: t["content"].encode() for t in parsed["added_tokens"]}
    names = {i: name for name, i in ranks.items()} | special
    return [names.get(i, b"") for i in range(max(names) + 1)], {name: i for name, i in ranks.items() if i not in special}


class ByteTokens:
    """Token ids of the byte-level vocabulary, whose ids rise in the order of its merges."""

    def __init__(self, vocabulary: str, ranks: dict[bytes, int]) -> None:
        self.vocabulary, self.slow = vocabulary, None
        self.fast = tiktoken.Encoding("aligned", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = [self.fast.encode_ordinary(t) if PLAIN.fullmatch(t) else None for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        if rest and self.slow is None:
            self.slow = Tokenizer.from_str(self.vocabulary)
            self.slow.encode_special_tokens = True  # their strings in a text are ordinary text
        for i in rest:
            out[i] = self.slow.encode(texts[i], add_special_tokens=False).ids
        return out


class PieceTokens:
    """Token ids of the piece vocabulary, which puts a space before the text."""

    def __init__(self, model: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.model.get_piece_size())
        names = self.model.id_to_piece(list(ids))
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(ids, names, strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def merge(ends_a: np.ndarray, ends_b: np.ndarray, starts: np.ndarray, lane_tokens: int = LANE_TOKENS) -> tuple[np.ndarray, ...]:
    """(link_a, link_b, cut_a, cut_b): token numbers of the links, in no order, and of the last tokens of groups.

    ``ends`` are the tokens' end offsets in the joined bytes of all documents, ``starts`` the (A, B) numbers of the
    documents' first tokens and, at last, the numbers of tokens.
    """
    first_a, first_b, last_a = starts[:-1, 0], starts[:-1, 1], starts[1:, 0]
    # Long documents: common ends soon after every lane_tokens-th token begin further lanes.
    count = np.maximum((last_a - first_a - 1) // lane_tokens, 0)
    owner = np.repeat(np.arange(len(count)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
    near = (first_a[owner] + nth * lane_tokens)[:, None] + np.arange(min(SEARCH, lane_tokens))
    inside = near < last_a[owner][:, None] - 1
    ends = ends_a[np.minimum(near, len(ends_a) - 1)] if len(near) else np.zeros(near.shape, np.int64)
    at = np.searchsorted(ends_b, ends)
    common = inside & (ends_b[np.minimum(at, len(ends_b) - 1)] == ends) if len(near) else inside
    row = np.flatnonzero(common.any(axis=1))
    column = common[row].argmax(axis=1)
    a = np.concatenate([first_a, near[row, column] + 1])
    b = np.concatenate([first_b, at[row, column] + 1])
    doc = np.concatenate([np.arange(len(count)), owner[row]])
    order = np.argsort(a, kind="stable")
    a, b, doc = a[order], b[order], doc[order]
    # A lane stops where the next one of its document begins.
    stop = np.concatenate([np.where(doc[1:] == doc[:-1], a[1:], last_a[doc[:-1]]), last_a[doc[-1:]]])
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    live = a < stop
    a, b, stop = a[live], b[live], stop[live]
    while len(a):
        end_a, end_b = ends_a[a], ends_b[b]
        links_a.append(a)
        links_b.append(b)
        cut = end_a == end_b
        cuts_a.append(a[cut])
        cuts_b.append(b[cut])
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
        live = a < stop
        if not live.all():
            a, b, stop = a[live], b[live], stop[live]
    join = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)])
    return join(links_a), join(links_b), np.sort(join(cuts_a)), np.sort(join(cuts_b))


def lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


ALIGNED = "key bigint, doc_id bigint, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>, links_a array<int>, links_b array<int>"


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def aligner(byte_bpe: str, pieces: str) -> Batches:
    """The function that turns batches of key, doc_id and text into those of ``align``, each of about a megabyte of text."""
    vocabulary, model = Path(byte_bpe).read_text(), Path(pieces).read_bytes()  # two megabytes, sent with the tasks
    bytes_a, ranks = byte_vocabulary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        side_a, side_b = ByteTokens(vocabulary, ranks), PieceTokens(model)
        size_a, size_b = (np.array([len(x) for x in side]) for side in (bytes_a, side_b.bytes))
        for batch in batches:
            texts = X.texts_of(batch.column(2))
            for lo, hi in X.chunks(texts):
                plain = [t.decode() for t in texts[lo:hi]]
                both = []
                for text, a, b in zip(plain, side_a.encode([" " + t for t in plain]), side_b.encode(plain), strict=True):
                    want = b" " + text.encode()
                    whole = text and b"".join([bytes_a[i] for i in a]) == want == b"".join([side_b.bytes[i] for i in b])
                    both.append((a, b) if whole else ([], []))
                starts = np.zeros((len(both) + 1, 2), np.int64)
                starts[1:] = np.cumsum([[len(a), len(b)] for a, b in both], axis=0)
                a, b = (np.fromiter(chain.from_iterable(pair[k] for pair in both), np.int64, starts[-1, k]) for k in (0, 1))
                link_a, link_b, cut_a, cut_b = merge(np.cumsum(size_a[a]), np.cumsum(size_b[b]), starts)
                order = np.argsort(link_a * (len(b) + 1) + link_b)
                link_a, link_b = link_a[order], link_b[order]
                of_link, of_cut = np.searchsorted(link_a, starts[:, 0]), np.searchsorted(cut_a, starts[:, 0])
                base = np.repeat(starts[:-1], np.diff(of_link), axis=0)
                cut_base = np.repeat(starts[:-1], np.diff(of_cut), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                        lists(starts[:, 0], a), lists(starts[:, 1], b),
                        lists(of_cut, cut_a + 1 - cut_base[:, 0]), lists(of_cut, cut_b + 1 - cut_base[:, 1]),
                        lists(of_link, link_a - base[:, 0]), lists(of_link, link_b - base[:, 1]),
                    ],
                    ["key", "doc_id", "a_ids", "b_ids", "a_ends", "b_ends", "links_a", "links_b"],
                )

    return run


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("bigint"), "text")


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): both token sequences, the groups and the links.

    ``a_ids`` and ``b_ids`` are the tokens of space+text; a group ends before the token numbers ``a_ends[k]`` and
    ``b_ends[k]``; ``links_a[k]`` and ``links_b[k]`` are two tokens whose bytes overlap, by ``a`` and then ``b``. Texts
    that are null, empty, or not given back by either tokenizer's bytes have empty arrays. Repeated rows and null
    doc_ids are rows like others; ``key`` tells rows apart. Other columns are ignored. An empty table gives no rows.
    """
    return keyed(docs).mapInArrow(aligner(byte_bpe, pieces), ALIGNED)


class Numbers:
    """Decimal ids, each with one separator after it, as rows of bytes."""

    SEPARATORS = b",|;"

    def __init__(self) -> None:
        self.rows, self.sizes = np.zeros((0, 1), np.uint8), np.zeros(0, np.int64)

    def reach(self, n: int) -> None:
        if 3 * n > len(self.sizes):
            names = np.array([b"%d" % i for i in range(max(n, 1 << 16))])
            digits = np.char.str_len(names)
            rows = np.zeros((len(names), 3, names.itemsize + 1), np.uint8)
            rows[:, :, :-1] = np.frombuffer(names.tobytes(), np.uint8).reshape(len(names), 1, -1)
            rows[np.arange(len(names)), :, digits] = np.frombuffer(self.SEPARATORS, np.uint8)
            self.rows, self.sizes = rows.reshape(-1, rows.shape[2]), np.repeat(digits + 1, 3)

    def text(self, ids: np.ndarray, separator: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids as text, and the offset after each."""
        self.reach(int(ids.max()) + 1 if len(ids) else 1)
        at = ids * 3 + separator
        sizes = self.sizes[at]
        return self.rows[at][np.arange(self.rows.shape[1]) < sizes[:, None]].tobytes(), np.cumsum(sizes)


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The joined values of a list column and its offsets, from 0."""
    values = batch.column(batch.schema.get_field_index(name))
    offsets = values.offsets.to_numpy().astype(np.int64)
    return values.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64), offsets - offsets[0]


DIGEST = "key bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each row of ``align``, the hash of its groups, and its linked id pairs (a << 32 | b) with how often they are linked."""
    numbers = Numbers()
    for batch in batches:
        n = batch.num_rows
        (a, of_a), (b, of_b), (end_a, of_g), (end_b, _), (link_a, of_l), (link_b, _) = (
            column(batch, c) for c in ("a_ids", "b_ids", "a_ends", "b_ends", "links_a", "links_b")
        )
        row_of_group, row_of_link = np.repeat(np.arange(n), np.diff(of_g)), np.repeat(np.arange(n), np.diff(of_l))
        end_a, end_b = end_a + of_a[row_of_group], end_b + of_b[row_of_group]
        # A token stands after all B tokens of earlier groups, a B token after all A tokens up to its group.
        sizes_a, sizes_b = np.diff(end_a, prepend=0), np.diff(end_b, prepend=0)
        place_a = np.arange(len(a)) + np.repeat(end_b - sizes_b, sizes_a)
        place_b = np.arange(len(b)) + np.repeat(end_a, sizes_b)
        ids, separator = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        ids[place_a], ids[place_b] = a, b
        separator[place_a[end_a - 1]], separator[place_b[end_b - 1]] = 1, 2
        text, after = numbers.text(ids, separator)
        edges = np.concatenate([[0], after])[of_a + of_b]
        hashes = [hashlib.sha256(text[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        pair = a[link_a + of_a[row_of_link]] << 32 | b[link_b + of_b[row_of_link]]
        order = np.lexsort((pair, row_of_link))
        pair, row = pair[order], row_of_link[order]
        new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])]) if len(pair) else np.zeros(0, bool))
        of_p = np.searchsorted(row[new], np.arange(n + 1))
        times = np.diff(np.concatenate([new, [len(pair)]]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), *[pa.array(np.diff(x)) for x in (of_a, of_b, of_g, of_l)], pa.array(hashes, pa.string()),
                pa.ListArray.from_arrays(pa.array(of_p.astype(np.int32)), pa.array(pair[new])), lists(of_p, times),
            ],
            ["key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
        )


def digest(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """``digested`` of ``align`` in one task: token lists do not pass through the JVM, which would gather large batches."""
    align_batches = aligner(byte_bpe, pieces)
    return keyed(docs).mapInArrow(lambda batches: digested(align_batches(batches)), DIGEST)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, links, best): links of each id pair over all rows, and whether no pair of its B id has more."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("links"))
    # A window holds at most as many rows as A has ids.
    most = F.max("links").over(W.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    return counts.select("pair", "links", (F.col("links") == most).alias("best"))


def pair_sums(rows: DataFrame, frequent: int | None = None) -> DataFrame:
    """The rows of ``digest`` (written), with ``n_best`` and ``count_sum`` in place of the pairs."""
    counts = materialise(pair_counts(rows), "pair_counts")
    top = counts.orderBy(F.desc("links"), "pair").limit(FREQUENT if frequent is None else frequent).toArrow().sort_by("pair")
    known, links, best = (top[c].to_numpy() for c in ("pair", "links", "best"))
    shared = rows.sparkSession.sparkContext.broadcast((known, links, best.astype(bool)))
    kept = "key bigint, n_best bigint, count_sum bigint, pairs array<bigint>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, links, best = shared.value
        for batch in batches:
            (pair, of_p), (times, _) = column(batch, "pairs"), column(batch, "times")
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            found = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            sums = []
            for value in (best, links):
                part = np.zeros(len(pair), np.int64)
                part[found] = value[at[found]] * times[found]
                total = np.concatenate([[0], np.cumsum(part)])
                sums.append(total[of_p[1:]] - total[of_p[:-1]])
            of_rest = np.concatenate([[0], np.cumsum(~found)])[of_p]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *map(pa.array, sums),
                    pa.ListArray.from_arrays(pa.array(of_rest.astype(np.int32)), pa.array(pair[~found])), lists(of_rest, times[~found]),
                ],
                ["key", "n_best", "count_sum", "pairs", "times"],
            )

    seen = materialise(rows.select("key", "pairs", "times").mapInArrow(run, kept), "frequent_pairs")
    rest = seen.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("key", F.col("p.pairs").alias("pair"), "p.times")
    joined = rest.join(counts, "pair").select(
        "key", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("links") * F.col("times")).alias("count_sum")
    )
    parts = seen.select("key", "n_best", "count_sum").union(joined).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_best", "count_sum")])
    return rows.drop("pairs", "times").join(parts, "key")


def compare_tokenizers(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, frequent: int | None = None) -> DataFrame:
    """One row per row of ``docs``: token, group and link counts, and how its links' id pairs stand in the corpus."""
    rows = materialise(digest(docs, byte_bpe, pieces), "aligned")
    return pair_sums(rows, frequent).drop("key")
