import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions.vectors import hash_vector
from lectern.operators import keywords as K
from lectern.operators import knowledge as N
from lectern.operators import store as S
from lectern.operators import terms as X
from tests import specs

LETTERS = "ab你好 c"


def _lcs(a, b):
    return (len(a) + len(b) - _indel(a, b)) // 2


def _indel(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(left[j - 1] if x == y else min(left[j], row[-1]) + 1)
    return row[-1]


def _ratio(a, b):
    return 200.0 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def _partial(w, t):
    if len(w) == len(t):
        return max(_one_way(w, t), _one_way(t, w))
    return _one_way(*sorted((w, t), key=len))


def _one_way(short, long):
    if not short:
        return 0.0
    m, n = len(short), len(long)
    spans = {(max(0, i), min(n, i + m)) for i in range(1 - m, n)}
    return max(_ratio(short, long[a:b]) for a, b in spans if b > a)


def _random(n, longest, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(1, longest))) for _ in range(n)]


@pytest.mark.parametrize("threshold", [50, 75, 90])
@pytest.mark.parametrize("blocks", [False, True])
def test_fuzzy_search_equals_brute_force(spark, monkeypatch, threshold, blocks):
    monkeypatch.setattr(K, "BATCH_CHARS", 90)
    if blocks:
        monkeypatch.setattr(K, "BLOCK_KEYWORDS", 3)
        monkeypatch.setattr(K, "BLOCK_SEGMENTS", 20)
    texts, words = _random(60, 14, threshold), sorted(set(w.strip() for w in _random(12, 7, 9)) - {""})
    seg = spark.createDataFrame(list(enumerate(texts)), "uid int, text string")
    kw = spark.createDataFrame([(w,) for w in words], "keyword string")
    got = {(r.uid, r.keyword): (r.match_type, r.similarity) for r in K.search_keywords(seg, kw, ["uid"], threshold).collect()}
    want = {}
    for i, t in enumerate(texts):
        for w in words:
            if w.lower() in t.lower():
                want[(i, w)] = ("exact", 100.0)
            elif _partial(w, t) >= threshold:
                want[(i, w)] = ("fuzzy", round(_partial(w, t), 1))
    assert got == want


def test_equal_texts_are_compared_once_and_windows_cross_tiles(spark, monkeypatch):
    monkeypatch.setattr(K, "TILE", 8)
    monkeypatch.setattr(K, "OUT_ROWS", 5)
    texts, words = _random(40, 30, 5) * 3 + [None], [*_random(10, 12, 6), "ab" * 40]
    words = sorted({w.strip() for w in words} - {""})
    texts += ["xy" + "ab" * 38 + "cab"]
    hits = K._match_batch(pd.DataFrame({"uid": range(len(texts))}), pd.Series(texts, dtype=object), words, 60)
    got = {(uid, w): (kind, sim, swapped) for uid, w, kind, sim, swapped in hits.itertuples(index=False)}
    want = {
        (i, w): ("exact" if w.lower() in t.lower() else "fuzzy", round(_partial(w.lower(), t.lower()), 1), len(t) < len(w))
        for i, t in enumerate(texts) if t for w in words if _partial(w.lower(), t.lower()) >= 60
    }
    assert got == want and len(got) == len(hits)
    seg = spark.createDataFrame(list(enumerate(texts)), "uid int, text string").repartition(3)
    found = K.search_keywords(seg, spark.createDataFrame([(w,) for w in words], "keyword string"), ["uid"], 60)
    rows = [tuple(r) for r in found.collect()]
    assert {r[:2]: r[2:] for r in rows} == want and len(rows) == len(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [text" in plan[plan.index("MapInArrow") :]


def test_batches_of_texts_are_joined(monkeypatch):
    monkeypatch.setattr(K, "BATCH_CHARS", 10)
    batches = [pa.RecordBatch.from_pydict({"text": x}, pa.schema([("text", pa.string())])) for x in (["abc", "d"], ["efghi"], [], ["jk", None, "lmnopqrstuvwxyz", "a"], ["b"])]
    got = [b["text"].to_pylist() for b in K.together(iter(batches))]
    assert got == [["abc", "d", "efghi", "jk"], [None, "lmnopqrstuvwxyz"], ["a", "b"]]


def test_equal_lengths_are_compared_both_ways(spark):
    for a, b in (("abcY", "aXbc"), ("aXbc", "abcY")):
        assert K.partial_ratio(a, b) == _partial(a, b) == pytest.approx(600 / 7)
        segments = spark.createDataFrame([(1, a)], "id long, text string")
        hit = K.search_keywords(segments, spark.createDataFrame([(b,)], "keyword string"), ["id"], 80).first()
        assert (hit.match_type, hit.similarity, hit.swapped) == ("fuzzy", 85.7, False)


def test_search_summary_counts_failed_files(spark):
    segments = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "rec string, seg int")
    matches = spark.createDataFrame([("a", 1, "k"), ("a", 1, "l"), ("a", 2, "k"), ("c", 1, "k")], "rec string, seg int, keyword string")
    files = spark.createDataFrame([("a", None), ("b", None), ("c", None), ("d", "no audio"), ("d", "no audio"), ("e", "broken")], "rec string, error string")
    got = K.search_summary(segments, matches, "rec", ["rec", "seg"], files).first().asDict()
    assert got == {"total_segments": 4, "total_files": 5, "matched_segments": 3, "matched_files": 2, "failed_files": 2}
    none = K.search_summary(segments, matches.limit(0), "rec", ["seg"]).first()
    assert (none.matched_segments, none.matched_files, none.total_files) == (0, 0, 3)


def test_anchor_ratios():
    assert round(K.indel_ratio("蓝心妹", "蓝心湄"), 1) == 66.7
    assert K.indel_ratio("剪辑", "剪映") == 50.0
    assert K.partial_ratio("用户体检", "我们的用户体验") == 75.0


def test_literal_and_joined_containment_agree(spark):
    texts, words = _random(80, 20, 4), _random(30, 9, 5)
    seg = spark.createDataFrame(list(enumerate(texts)), "uid int, text string")
    kw = K.distinct_keywords(spark.createDataFrame([(w,) for w in words], "keyword string"))
    a = K._match_literals(seg, [r.keyword for r in kw.collect()]).select("uid", "keyword")
    b = K._match_grams(seg, kw).select("uid", "keyword")
    want = sorted((i, w) for i, t in enumerate(texts) for w in {x.strip() for x in words} - {""} if w in t)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) == want


def test_joined_containment_by_blocks(spark):
    texts = ["aaaaaaaaaa", "xABABABABab", "😀éß😀éß😀éß", "no", "ab", "a", "", "the theme then"]
    words = ["a", "ab", "aaa", "aaaa", "abab", "ababab", "é", "ß😀é", "the theme then", "he the", "n"]
    seg = spark.createDataFrame(list(enumerate(texts)), "uid int, text string")
    kw = K.distinct_keywords(spark.createDataFrame([(w,) for w in words], "keyword string"))
    found = K._match_grams(seg, kw).select("uid", "keyword")
    assert sorted(map(tuple, found.collect())) == sorted((i, w) for i, t in enumerate(texts) for w in words if w in t.lower())
    assert "(?=" not in found._jdf.queryExecution().analyzed().toString()  # blocks, not every place


CASES = [
    ("就是F幺零这个排球队的蓝心妹现在怎么样", "篮球队 蓝心湄 剪映", "就是F幺零这个篮球队的蓝心湄现在怎么样"),
    ("我们在剪映里打开工程", "剪映", "我们在剪映里打开工程"),
    ("蓝心湄的演出很好", "蓝心湄", "蓝心湄的演出很好"),
    ("这个剪映版本不错达摩院的模型也好", "剪映 达摩院", "这个剪映版本不错达摩院的模型也好"),
    ("蓝心的天很蓝", "蓝心湄", "蓝心的天很蓝"),
    ("他们的用户体验做得好", "剪映", "他们的用户体验做得好"),
]
LEXICON = dict(zip("九级周潇齐新娘心上剪辑映", "jiu ji zhou xiao qi xin niang xin shang jian ji ying".split()))


@pytest.mark.parametrize("lexicon", [None, LEXICON])
@pytest.mark.parametrize("text,terms,want", CASES)
def test_term_cases(spark, text, terms, want, lexicon):
    seg = spark.createDataFrame([(1, text)], "uid int, text string")
    got = X.correct_terms(seg, ["uid"], terms, lexicon).first()
    assert got.text == want and len(got.text) == len(text)


def test_terms_by_sound(spark):
    seg = spark.createDataFrame([(1, "我叫九九级"), (2, "心上人剪辑")], "uid int, text string")
    got = [r.text for r in X.correct_terms(seg, ["uid"], "周潇齐 新娘 剪映", LEXICON, compat=True).orderBy("uid").collect()]
    assert got == ["我叫周潇齐", "心上人剪辑"]
    assert X.syllable_score("ji", "qi") == 88.0 and X.syllable_score("ji", "zhou") == 0.0
    assert X.syllable_score("zhi", "zi", True) == 60.0 and X.syllable_score("zhi", "zi") == 88.0


def test_pronunciation_join_equals_the_helper(spark):
    pairs = spark.createDataFrame([(1, "九九级", "周潇齐"), (2, "心上", "新娘"), (3, "剪辑", "剪映")], "pair_id int, cand string, term string")
    lex = spark.createDataFrame(list(LEXICON.items()), "char string, syllable string")
    got = X.pronunciation_match(pairs, lex, compat=True).collect()
    assert [(r.pair_id, round(r.similarity, 1)) for r in got] == [(1, 56.7)]


def test_corrections_equal_a_sequential_scan(spark, monkeypatch):
    monkeypatch.setattr(K, "BATCH_CHARS", 70)
    texts, words = _random(80, 18, 12), [w for w in _random(10, 5, 13) if len(w) > 1 and " " not in w]

    def scan(text):
        for w in X.parse_terms(words):
            out, i = "", 0
            while i < len(text):
                c = text[i : i + len(w)]
                edge = len(c) == len(w) and (c[0] == w[0] or c[-1] == w[-1])
                if edge and _ratio(c, w) >= 60:
                    out, i = out + w, i + len(w)
                else:
                    out, i = out + text[i], i + 1
            text = out
        return text

    seg = spark.createDataFrame(list(enumerate(texts)), "uid int, text string")
    got = [r.text for r in X.correct_terms(seg, ["uid"], words).orderBy("uid").collect()]
    assert got == [scan(t) for t in texts]


@pytest.mark.parametrize("blocks", [False, True])
def test_vector_search_equals_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(N, "BROADCAST_QUERIES", 7)
        monkeypatch.setattr(N, "BLOCK_CHUNKS", 11)
    rng = np.random.default_rng(1)
    mat = rng.normal(size=(40, 6))
    mat /= np.linalg.norm(mat, axis=1, keepdims=True)
    mat[5] = mat[6]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(mat)]
    q = spark.createDataFrame(rows, "query_id int, embedding array<double>")
    c = spark.createDataFrame(rows, "chunk_id int, embedding array<double>")
    got = sorted(tuple(r) for r in N.search_vectors(q, c, 4, 0.35, skip_self=True).collect())
    want = []
    for i in range(40):
        order = sorted((j for j in range(40) if j != i), key=lambda j: (-round(mat[i] @ mat[j], 9), j))[:4]
        want += [(i, n, j, round(float(mat[i] @ mat[j]), 4)) for n, j in enumerate(order, 1) if round(mat[i] @ mat[j], 4) >= 0.35]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)])


def _files(root):
    return {str(p.relative_to(root)) for p in root.rglob("part-*") if "columns" not in str(p)}


def test_stored_knowledge_base(spark, tmp_path):
    root = tmp_path / "kb"
    path = str(root)
    names = ["a", "b", "c", None]
    docs = spark.createDataFrame([(s, f"text of {s}") for s in names], "source string, text string")
    chunks = N.index_documents(docs)
    S.create(spark, path, chunks, buckets=8)
    assert S.load(spark, path).count() == 0 and S.load(spark, path).columns == chunks.columns
    assert S.upsert(spark, path, chunks) == 1
    before = _files(root)
    changed = spark.createDataFrame([("a", "new"), (None, "nameless")], "source string, text string")
    assert S.upsert(spark, path, N.index_documents(changed)) == 2
    texts = lambda v=None: {r.source: r.text for r in S.load(spark, path, v).collect()}
    assert texts() == {"a": "new", "b": "text of b", "c": "text of c", None: "nameless"}
    assert texts(1) == {s: f"text of {s}" for s in names}
    # Old files stay, and the change wrote the buckets of its two sources only.
    after = _files(root)
    assert before <= after
    of = {r.source: r.b for r in docs.select("source", S._bucket("source", 8).alias("b")).collect()}
    written = {int(f.split("bucket=")[1].split("/")[0]) for f in after - before if "bucket=" in f}
    assert written == {of["a"], of[None]}
    gone = lambda *s: spark.createDataFrame([(x,) for x in s], "source string")
    assert S.delete(spark, path, gone("unknown")) == 0 and S.version_of(spark, path) == 2
    assert S.delete(spark, path, gone("a", "a", None)) == 2 and set(texts()) == {"b", "c"}
    assert S.upsert(spark, path, chunks.limit(0)) == 4 and set(texts()) == {"b", "c"}
    S.reset(spark, path)
    assert texts() == {} and set(texts(2)) == set(names)
    S.upsert(spark, path, chunks)
    assert set(texts()) == set(names)


def test_a_failed_write_leaves_the_version_before_it(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "kb")
    rows = spark.createDataFrame([("a", "one"), ("b", "two"), ("b", "two")], "source string, text string")
    S.create(spark, path, rows, buckets=4)
    S.upsert(spark, path, rows)
    broken = rows.withColumn("text", F.when(F.col("source") == "b", F.raise_error(F.lit("lost"))).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        S.upsert(spark, path, broken)
    # Nor does data count that was written without its log file.
    with monkeypatch.context() as m:
        m.setattr(S, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            S.delete(spark, path, rows)
    assert sorted(map(tuple, S.load(spark, path).collect())) == [("a", "one"), ("b", "two"), ("b", "two")]
    assert S.version_of(spark, path) == 1


def test_embedding_has_unit_length():
    assert abs(np.linalg.norm(hash_vector("知识 base")) - 1) < 1e-9
    assert not hash_vector("x").any()


def test_vectors_and_best_hits_by_batch():
    from lectern.functions.vectors import hash_vectors
    from lectern.operators import knowledge as N

    texts = ["知识 base", "x", "", "ab" * 300, "é😀é"] * 120
    assert (hash_vectors(texts) == np.stack([hash_vector(t) for t in texts])).all() and hash_vectors([]).shape == (0, 64)
    rnd = np.random.default_rng(3)
    q, c = rnd.integers(0, 3, (4, 2)) / 2.0, rnd.integers(0, 3, (200, 2)) / 2.0  # few values: many ties
    ids, asked, kept = np.array([f"c{i:03d}" for i in range(200)]), np.array([f"c{i:03d}" for i in range(4)]), []
    plain = N._keep

    def counted(hits, k):
        kept.append(len(hits))
        return plain(hits, k)

    N._keep = counted
    try:
        got = N._best(asked, q, ids, c, 3, 0.0, True)
        spread = N._best(asked, q, ids, rnd.random((200, 2)), 3, 0.0, True)
    finally:
        N._keep = plain
    want = [(a, i, d) for a, row in zip(asked, q @ c.T) for d, i in sorted(((round(d, 9), i) for d, i in zip(row, ids) if i != a), key=lambda x: (-x[0], x[1]))[:3]]
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(want)
    assert len(spread) == 12 and kept[-1] == sum(3 if v.any() else 199 for v in q)


def test_edit_distance(spark):
    from lectern.functions.distance import edit_distance

    rnd = random.Random(2)
    pairs = [("café", "cafe"), ("你好", "你们好"), ("", "a"), ("a😀", "a"), ("", "")]
    for n in (1, 63, 64, 65, 128, 150):
        a = "".join(rnd.choice("abé你😀") for _ in range(n))
        pairs += [(a, a), (a, a[::2]), (a, "".join(rnd.choice("ab你z") for _ in range(rnd.randint(0, 140))))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)] + [(99, None, "a")], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(edit_distance("a", "b")).collect()]
    assert got == [specs.edit_distance(a, b) for a, b in pairs] + [None]
    jvm = df.filter("i < 99").orderBy("i").select(F.levenshtein("a", "b")).collect()
    assert got[:-1] == [r[0] for r in jvm]


def test_edit_distance_by_core_band_and_bound():
    from lectern.functions import distance as E

    rnd = random.Random(5)
    pairs = [("a" * 70 + "tion" + "b" * 70, "a" * 70 + "shun" + "b" * 70), ("x" * 40, ""), ("seek", "siik"), ("noses", "noe")]
    for n in [30, 33, 64, 65, 96, 97, 128, 130, 190]:
        for edits in (1, 12, 31, 32, 60):
            a = "".join(rnd.choice("abcde é😀") for _ in range(n))
            b = list(a)
            for _ in range(edits):
                i = rnd.randrange(len(b))
                b[i : i + rnd.randint(0, 2)] = [rnd.choice("abxy😀")] * rnd.randint(0, 2) or ["z"]
            pairs += [(a, "".join(b)), ("".join(b), a)]
    assert list(E.distances(*map(list, zip(*pairs)))) == [specs.edit_distance(a, b) for a, b in pairs]
    # What two texts share at their ends is not measured, and equal cores are measured once.
    assert E._core("nation", "nashun") == ("tio", "shu") and E._core("in", "inn") == ("", "n")


def test_scored_texts_meet_once_a_uid(spark):
    from lectern.operators import scoring as S
    from lectern.plans import bindings as B
    from tests.conftest import SMALL

    refs = spark.createDataFrame([("u", "Nation."), ("v", "ab"), ("w", "c")], "uid string, ref string")
    long = [("u", "a", "x", "nashun"), ("u", "b", "x", "nation"), ("v", "a", "x", None), ("v", "b", "x", "b")]
    hyps = spark.createDataFrame(long, "uid string, system string, condition string, hyp string")
    packed = hyps.groupBy("uid").agg(F.collect_list(F.struct("system", "condition", "hyp")).alias("hyps"))
    want = S.score_pairs(refs, hyps)
    got = S.score_variants(refs, packed).select(want.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 4
    a, b = (hyps.filter(F.col("system") == s).select("uid", "hyp") for s in "ab")
    both = a.withColumnRenamed("hyp", "hyp_a").join(b.withColumnRenamed("hyp", "hyp_b"), "uid")
    pairs = S.paired_systems(refs, a, b)
    assert sorted(S.paired_columns(refs, both).select(pairs.columns).collect()) == sorted(pairs.collect())
    assert B.condition_hypotheses(spark, SMALL).columns == ["uid", "hyps"]


def test_a_reference_is_measured_against_all_its_variants_at_once(spark, monkeypatch):
    """One call a uid, texts that repeat, missing ones, and a memory that is emptied on the way."""
    from lectern.functions import distance as E
    from lectern.operators import scoring as S

    monkeypatch.setattr(E, "MET", 3)
    texts = [*_random(6, 12, 3), "abcab", "abca", "", None]
    rows = [(i, texts[i % 10], [texts[(i * k) % 10] for k in range(1, 5)] if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, x string, ys array<string>").coalesce(1)
    got = {r.i: r.d for r in df.select("i", E.edit_distances("x", "ys").alias("d")).collect()}
    assert got == {
        i: None if ys is None else [None if x is None or y is None else specs.edit_distance(x, y) for y in ys] for i, x, ys in rows
    }
    refs = spark.createDataFrame([("u", "Nation.")], "uid string, ref string")
    hyps = spark.createDataFrame([("u", [("a", "nashun"), ("b", None)])], "uid string, hyps array<struct<system: string, hyp: string>>")
    plan = S.score_variants(refs, hyps)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("ArrowEvalPython")  # the pairs are made after measuring


def test_short_texts_by_batch_equal_the_sequential_ratio():
    texts, words = _random(300, 9, 21) + ["", None, "a\0b"], _random(12, 11, 22) + ["ab" * 17, "a\0"]
    batch = K.TextBatch(texts, words)
    assert batch.codes.itemsize == 1  # a byte a character while the letters are few
    short = batch.short_texts(40)
    for w in words:
        n = int(np.searchsorted(short.sizes, len(w), side="right"))
        got = batch.ratios_inside(short.codes[: len(w), :n], short.sizes[:n], w)
        assert np.allclose(got, [_one_way(t, w) for t in short.texts[:n]])


def test_fixes_follow_the_terms_over_blocks(spark, monkeypatch):
    """Fixes of a row in the order of the terms, then of the text; rows without any, null texts, terms in two blocks."""
    monkeypatch.setattr(X, "TERM_BLOCK", 1)
    rows = [(1, "abxd abcd zz abyd"), (2, None), (3, "qq"), (4, "xyq"), (5, "")]
    got = X.correct_terms(spark.createDataFrame(rows, "uid int, text string"), ["uid"], ["abcd", "xyz"]).orderBy("uid").collect()
    assert [(r.uid, r.text) for r in got] == [(1, "abcd abcd zz abcd"), (2, None), (3, "qq"), (4, "xyz"), (5, "")]
    fixes = [[(f["from"], f["to"], f["similarity"]) for f in r.fixes] for r in got]
    assert fixes == [[("abxd", "abcd", 75.0), ("abyd", "abcd", 75.0)], [], [], [("xyq", "xyz", 66.7)], []]
    found = X.distinct_fixes(X.correct_terms(spark.createDataFrame([*rows, (1, "abxd")], "uid int, text string"), ["uid"], ["abcd"]), "uid", [])
    assert sorted(tuple(r) for r in found.collect()) == [(1, "abxd", "abcd", 75.0, 2), (1, "abyd", "abcd", 75.0, 1)]


def test_pronunciation_scores_a_pair_of_words_once(spark, monkeypatch):
    """Pairs that repeat all come out, also under one id, and no word is exploded once a pair."""
    monkeypatch.setattr(X, "SALTS", 3)
    pairs = spark.range(300).selectExpr("id div 2 as pair_id", "'九九级' as cand", "'周潇齐' as term")
    lex = spark.createDataFrame(list(LEXICON.items()), "char string, syllable string")
    got = X.pronunciation_match(pairs, lex, compat=True)
    assert sorted((r.pair_id, round(r.similarity, 1)) for r in got.collect()) == sorted((i // 2, 56.7) for i in range(300))
