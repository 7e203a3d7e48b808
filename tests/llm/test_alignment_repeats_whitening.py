"""Token alignment, repeated passages and whitening against brute force, with nulls, ties and repeated rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lectern.llm import substring_dedup, token_alignment, whitening

EXTRA = "key string, pairs int, row string, part int, n long, print string"
FILL = ("k", 1, "r", 2, 3, "p")


def frame(spark, rows, schema):
    return spark.createDataFrame([(*r, *FILL) for r in rows], f"{schema}, {EXTRA}")


def aligned_texts():
    rng = random.Random(11)
    pieces = ["the", "naïve", "straße", "日本語", "🙂👍🏽", "<|endoftext|>", "<s>", "<0x41>", "don't", "  ", "\t", "\n\n", "antidisestablishment", "x" * 40, "3.14", "ﬁ", " ", "\x1c"]
    out = [None, "", " ", "a", "a", "▁under", " wide", "word " * 900, "no" * 2000]
    out += [rng.choice(["", " "]).join(rng.choice(pieces) for _ in range(rng.randrange(1, 400))) for _ in range(25)]
    return [*out, out[-1]]


def expected_alignment(rows):
    byte_bpe = Tokenizer.from_file(token_alignment.BYTE_BPE)
    byte_bpe.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=token_alignment.PIECES)
    # The usual table of byte-level names, made by its rule.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    name = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in plain):
        name[b] = chr(256 + k)
    back = {c: b for b, c in name.items()}
    found, counts = [], Counter()
    for text in rows:
        a_ids = byte_bpe.encode(" " + (text or ""), add_special_tokens=False).ids
        b_ids = pieces.encode(text or "")
        a_bytes = [bytes(back[c] for c in byte_bpe.id_to_token(i)) for i in a_ids]
        b_bytes = []
        for i in b_ids:
            p = pieces.id_to_piece(i)
            b_bytes.append(bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode())
        want = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            found.append(None)
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
        begins = [[0, *e[:-1]] for e in ends]
        links = []
        for i in range(len(a_ids)):
            for j in range(max(0, np.searchsorted(ends[1], begins[0][i], "right")), len(b_ids)):
                if begins[1][j] >= ends[0][i]:
                    break
                links.append((a_ids[i], b_ids[j]))
        groups, last = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            sides = [",".join(str(t) for t, e in zip(ids, e_, strict=True) if last < e <= cut) for ids, e_ in ((a_ids, ends[0]), (b_ids, ends[1]))]
            groups.append("|".join(sides))
            last = cut
        counts.update(links)
        found.append((len(a_ids), len(b_ids), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if f is None
        else (*f[:3], len(f[3]), sum(counts[x] == most[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]) for f in found
    ]


@pytest.mark.parametrize("frequent", [None, 40, 0])
def test_token_alignment(spark, frequent):
    texts = aligned_texts()
    docs = frame(spark, [(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    fields = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = token_alignment.compare_tokenizers(docs, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = Counter((r.doc_id, *(r[f] for f in fields)) for r in got.collect())
    assert got == Counter((i if i % 7 else None, *w) for i, w in enumerate(expected_alignment(texts)))
    if frequent is None:
        assert token_alignment.compare_tokenizers(docs.limit(0)).count() == 0


def test_alignment_outputs_tokens_and_links(spark):
    text = "Grüße, naïve 日本語 readers! " * 60
    row = token_alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    byte_bpe = Tokenizer.from_file(token_alignment.BYTE_BPE)
    assert byte_bpe.decode(row.a_ids) == " " + text
    assert (row.a_ends[-1], row.b_ends[-1]) == (len(row.a_ids), len(row.b_ids)) and row.a_ends == sorted(set(row.a_ends))
    steps = [(b - a, d - c) for (a, c), (b, d) in zip(zip(row.links_a, row.links_b, strict=True), zip(row.links_a[1:], row.links_b[1:], strict=True), strict=False)]
    assert set(steps) <= {(0, 1), (1, 0), (1, 1)}


@pytest.mark.parametrize("lane", [1, 3, 64])
def test_merge_in_lanes_is_the_merge(lane):
    rng = np.random.default_rng(lane)
    lengths = [0, 1, 500, 0, 77, 2000]
    ends, starts, base = ([], []), [(0, 0)], 0
    for n in lengths:
        for side in (0, 1):
            ends[side].extend(base + np.unique(np.append(rng.integers(1, n + 1, n // 2), n)) if n else [])
        base += n
        starts.append((len(ends[0]), len(ends[1])))
    args = np.array(ends[0]), np.array(ends[1]), np.array(starts)
    whole, cut = (token_alignment.merge(*args, lane_tokens=k) for k in (10**9, lane))
    assert sorted(zip(*whole[:2], strict=True)) == sorted(zip(*cut[:2], strict=True))
    assert all((a == b).all() for a, b in zip(whole[2:], cut[2:], strict=True))


def repeat_texts():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passage, other = some(60), some(35)
    texts = [None, "", " \n ", "short text", " ".join(some(34)), "z " * 200, "a b " * 40, "é ü  \t" + " ".join(other)]
    for k in range(12):
        texts.append(" ".join(some(20) + passage[k % 5 : 60 - k % 7] + some(15) + (other if k % 3 else [])))
    near = some(150)
    for k in range(6):
        copy = list(near)
        copy[25 * k] = "changed"
        texts.append("\n".join(copy))
    twin = " ".join(some(50))
    inside = some(40)
    return [*texts, twin, twin.replace(" ", "\t "), " ".join(inside + some(3) + inside), " ".join(some(30)), " ".join(some(35))]


def expected_repeats(texts, n=35):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("filter_bits", [64, 1 << 20])
def test_repeated_passages(spark, filter_bits):
    texts = repeat_texts()
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    docs = frame(spark, rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in substring_dedup.remove_repeats(docs, filter_bits=filter_bits).collect())
    assert got == Counter((i, *w) for (i, _), w in zip(rows, expected_repeats(texts), strict=True))
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_repeated_rows_of_one_document(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text[:-1])], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == [(1, 40), (1, 40), (2, 39)]


def paths_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    _, spans, shift = substring_dedup.repeats(docs, filter_bits=1 << 16)
    pieces = substring_dedup.compact(spans.select("start", "n", "home"), shift).collect()
    return sorted((p.path, p.offset, p["size"], p.copies) for p in pieces)


def test_paths_are_compacted(spark):
    """A passage whose parts have homes in different documents is one path, and its pieces tile it."""
    line = [f"p{i}" for i in range(120)]
    got = paths_of(spark, [" ".join(x) for x in (["x1"] + line[:70] + ["x2"], ["y1"] + line[30:] + ["y2"], ["u1", *line, "u2"], ["v1", *line, "v2"])])
    # Of the 86 windows the first 30 are in three texts, the next six in all, the last 50 in three.
    assert len({p for p, *_ in got}) == 1 and [x[1:] for x in got] == [(0, 30, 3), (30, 6, 4), (36, 50, 3)]


def test_paths_part_where_the_graph_branches_and_circles_end(spark):
    line = [f"p{i}" for i in range(70)]
    fork = paths_of(spark, [" ".join([*line, *[f"{e}{i}" for i in range(40)], f"end{k}"]) for k, e in enumerate("xxyy")])
    assert sorted(sum(s for q, _, s, _ in fork if q == p) for p in {p for p, *_ in fork}) == [36, 40, 40]
    circle = paths_of(spark, ["a b c " * 30, "q " + "a b c " * 30])
    assert sum(s for _, _, s, _ in circle) == 3 and len({p for p, *_ in circle}) == 1


def test_other_words_at_a_home_are_noticed(spark):
    texts = [" ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))]
    docs = spark.createDataFrame([(i, t + " " + t) for i, t in enumerate(texts)], "doc_id long, text string")
    found, spans, shift = substring_dedup.repeats(docs, filter_bits=64)
    assert not substring_dedup.contradicted(substring_dedup.remove_spans(found, spans, shift, 35))
    wrong = spans.withColumn("home", spans.home.bitwiseXOR(1 << shift))
    assert substring_dedup.contradicted(substring_dedup.remove_spans(found, wrong, shift, 35))


def vectors():
    rng = np.random.default_rng(13)
    mixed = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 3
    rows = [(i if i % 11 else None, v.tolist()) for i, v in enumerate(mixed)]
    rows += [rows[5], (900, rows[7][1]), (901, None), (902, [None] * 6), (903, [float("nan")] + [0.0] * 5), (904, [float("inf")] * 6), (905, [1.0]), (906, []), (907, [1e30] * 6)]
    return rows


@pytest.mark.parametrize(("matrix_rows", "block"), [(None, 4096), (90, 16)])
def test_whitening(spark, monkeypatch, matrix_rows, block):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    rows = vectors()
    got = whitening.whiten(frame(spark, rows, "vec_id long, embedding array<double>").repartition(4), 4, matrix_rows).collect()
    good = [r for r in rows if r[1] and len(r[1]) == 6 and all(v is not None and abs(v) < 1e20 for v in r[1])]
    x = np.floor(64 * np.array([v for _, v in good])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, basis = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, basis = values[::-1], basis[:, ::-1]
    z = (x - sums / n) @ basis / np.sqrt(values)
    assert len(got) == 4 * len(good) and {r.n for r in got} == {n}
    by_row = Counter((r.vec_id, r.deviation) for r in got if r.component == 1)
    assert by_row == Counter((i, int(((n * v - sums) ** 2).sum())) for (i, _), v in zip(good, x, strict=True))
    for c in range(4):
        mine = sorted((r.deviation, r.whitened) for r in got if r.component == c + 1)
        want = sorted((int(((n * v - sums) ** 2).sum()), w) for v, w in zip(x, z[:, c], strict=True))
        flip = 1 if abs(mine[0][1] - want[0][1]) < 1e-6 else -1
        assert np.allclose([flip * w for _, w in mine], [w for _, w in want], atol=1e-8)
    assert all(abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-8 for r in got)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {
        (i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)
    }
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 5.0]) for i in range(9)], schema)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-9
