"""The pipeline's stages, as run() applies them, each against a plain version on its own input."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lectern.llm import packing, textops, toxicity

SPACE_WORD = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
TOXIC, COPIES, TESTED = range(0, 60), range(100, 130), range(140, 150)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    some = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    passage, base = some(14), some(120)
    docs, labels = [], []
    for i in range(300):
        words = some(rng.randrange(30, 200))
        if i in TOXIC:
            words[3] = words[11] = "vilestuff"
        if i in COPIES:
            words = [w if rng.random() < 0.98 else "changed" for w in base]
        if i in TESTED:
            words[8:8] = [w.upper() for w in passage]
        docs.append((i, " ".join(words), "en" if i % 3 else "de", "abc"[i % 7 % 3] if i % 11 else None))
        labels.append((i, 1, int(i in TOXIC)))
    docs += [(300, None, None, None), (301, "", "en", "a"), (302, docs[200][1], "en", "a"), (200, docs[200][1], *docs[200][2:])]
    docs += [(303, "one", "en", "b"), (304, " ".join(some(30_000)), "en", "c"), (305, "One", None, "hot")]
    folder = str(tmp_path_factory.mktemp("tables"))
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    write([(*d, None if d[1] is None else len(d[1])) for d in docs], COLUMNS, "documents")
    write(labels[::2] + labels[1::4], "doc_id long, quality int, toxic int", "labels")
    write([(1, " ".join(passage)), (2, None), (3, "absent words here")], "item_id long, text string", "benchmark")
    return folder, passage


@pytest.fixture(scope="module")
def ran(spark, tables):
    """The rows that run() hands from stage to stage, the documents first."""
    folder, _ = tables
    frames, write = [spark.read.parquet(f"{folder}/documents.parquet")], corpus_pipeline.materialise
    with pytest.MonkeyPatch.context() as m:
        m.setattr(corpus_pipeline, "materialise", lambda df, label: frames.append(write(df, label)) or frames[-1])
        out = corpus_pipeline.run(spark, folder)
    assert out is frames[-1] and len(frames) == 6
    assert all(f.columns == frames[0].columns for f in frames[:-1])
    return [sorted(f.collect(), key=repr) for f in frames]


def test_toxic_documents_go(spark, tables, ran):
    folder, _ = tables
    before, after = ran[:2]
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    chain = toxicity.train(docs, toxicity.categories_of(docs, labels), toxicity.CATEGORIES)
    tables_of = [dict(zip(link.features.tolist(), link.weights.tolist(), strict=True)) for link in chain]

    def score(text):
        _, names = toxicity.feature_hashes([(text or "").encode()], textops.Powers())
        chances = []
        for link, weight in zip(chain, tables_of, strict=True):
            z = sum(weight.get(n, 0.0) for n in set(names.tolist())) + link.bias + sum(w * p for w, p in zip(link.earlier, chances, strict=True))
            chances.append(1 / (1 + np.exp(-z)))
        return chances[-1]

    assert after == [r for r in before if score(r.text) < toxicity.THRESHOLD]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == set(TOXIC)


def test_one_of_each_group_of_near_copies_stays(ran):
    before, after = ran[1:3]
    sets = {}
    for r in before:
        w = re.findall(SPACE_WORD, lower(r.text))
        sets[r.doc_id] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()
    component = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                near = sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
                if near and component[b] < component[a]:
                    component[a], changed = component[b], True
    stay = {i for i in sets if component[i] == i}
    assert {r.doc_id for r in after} == stay
    assert len(after) == len(stay)
    assert COPIES[0] in stay and not stay & {302, 305} and len(stay & set(COPIES)) < 10
    rows = {r.doc_id: r for r in before}
    assert all(rows[r.doc_id] == r for r in after)


def test_documents_with_a_test_passage_go(tables, ran):
    before, after = ran[2:4]
    windows = [[lower(w) for w in tables[1][k : k + 10]] for k in range(5)] + [["absent", "words", "here"]]

    def hit(text):
        w = re.findall(LETTERS, lower(text))
        return any(w[k : k + len(g)] == g for g in windows for k in range(len(w)))

    assert after == [r for r in before if not hit(r.text)]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == set(TESTED)


def test_sources_meet_their_targets(ran):
    before, after = ran[3:5]
    size = lambda r: len(re.findall(SPACE_WORD, r.text or ""))
    total, taken = Counter(), Counter()
    for r in before:
        total[r.source] += size(r)
    for r in after:
        taken[r.source] += size(r)
    order = sorted(s for s in total if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    rest, free, target = 1.5 * sum(total.values()), set(order), {}
    while over := [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 2 * total[s]]:
        target |= {s: 2 * total[s] for s in over}
        rest -= sum(2 * total[s] for s in over)
        free -= set(over)
    target |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
    often = Counter(after)
    assert set(often) <= set(before) and max(often.values()) <= 2
    for s in order:
        spare = [size(r) for r in before if r.source == s and size(r) and often[r] < 2]
        assert taken[s] <= target[s] + 1e-6 and target[s] - taken[s] < min(spare, default=1)


def test_packed_rows_give_the_mixed_texts_back(ran):
    before, packed = ran[4:6]
    decode = packing.encoder(open(packing.VOCABULARY, "rb").read()).decode
    pieces = {}
    for r in packed:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == packing.ROW_TOKENS and set(ids[r.n_tokens :].tolist()) <= {packing.END_ID}
        for a, b, d, k in zip(r.cu_seqlens[:-1], r.cu_seqlens[1:], r.doc_ids, r.pieces, strict=True):
            pieces.setdefault(d, {}).setdefault(k, []).append(ids[a:b].tolist())
    often = Counter(r.doc_id for r in before)
    text = {r.doc_id: r.text or "" for r in before}
    assert set(pieces) == set(often)
    for d, parts in pieces.items():
        # Equal documents have equal pieces, so each piece comes as often as its document.
        assert sorted(parts) == list(range(len(parts))) and all(len(p) == often[d] for p in parts.values())
        assert all(x == p[0] for p in parts.values() for x in p)
        whole = [i for k in range(len(parts)) for i in parts[k][0]]
        assert whole[-1] == packing.END_ID and decode(whole[:-1]) == text[d]


def test_an_empty_table_passes_all_stages(spark, tables, tmp_path):
    folder, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
