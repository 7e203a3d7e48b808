import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import chains
from lectern.operators import cues as C
from lectern.operators import lines as L
from lectern.operators.ordered import Running, global_rank, running, time_shard
from lectern.plans import cue_queries as Q
from tests import specs


def _random_cues(seed, recs=3, n=60, spread=20000):
    """One recording holds most of the rows."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        rec = "hot" if rnd.random() < 0.7 else f"r{rnd.randrange(recs)}"
        s = rnd.randrange(spread)
        rows.append((rec, i, s, s + rnd.choice([-50, 0, 100, 900, 4000]), rnd.choice("abc")))
    return rows


def _by_rec(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("seed,spread", [(1, 3000), (2, 60000), (3, 400000)])
def test_folds_equal_the_sequential_rule(spark, seed, spread):
    rows = _random_cues(seed, spread=spread)
    df = spark.createDataFrame(rows, "rec_id string, cue_no bigint, start_ms bigint, end_ms bigint, text string")
    width = spread // 7
    mono = {(r.rec_id, r.cue_no): (r.start_ms, r.end_ms) for r in C.monotone_times(df, width=width).collect()}
    merged = {}
    for r in C.merge_cues(df, width=width).collect():
        merged.setdefault(r.rec_id, []).append((r.start_ms, r.end_ms, r.text))
    for rec, group in _by_rec(rows).items():
        specs.check_monotone([(g[2], g[3]) for g in group], [mono[(rec, g[1])] for g in group])
        specs.check_merged([(g[2], g[3], g[4]) for g in group], sorted(merged.get(rec, [])))


@pytest.mark.parametrize("seed,spread", [(1, 3000), (5, 2_000_000)])
def test_pointers_equal_the_fold(spark, monkeypatch, seed, spread):
    """Runs of any length by pointers over blocks of five cues, three levels of blocks deep, against the fold."""
    rows = _random_cues(seed, n=170, spread=spread) + [("gapless", i, 700 * i, 700 * i + [600, 900, 800][i % 3], "x") for i in range(170)]
    df = spark.createDataFrame(rows, "rec_id string, cue_no bigint, start_ms bigint, end_ms bigint, text string")
    want = [sorted(map(tuple, f(df, width=20_000).collect())) for f in (C.monotone_times, C.merge_cues)]
    monkeypatch.setattr(C, "LONG_RUN", 3)
    monkeypatch.setattr(chains, "BLOCK", 5)
    assert [sorted(map(tuple, f(df, width=20_000).collect())) for f in (C.monotone_times, C.merge_cues)] == want
    assert C.monotone_times(df.limit(0)).count() == C.merge_cues(df.limit(0)).count() == 0


def test_first_above_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chains, "BLOCK", 4)
    rnd = random.Random(3)
    values = [(k, p, rnd.randrange(40)) for k in ("a", "b") for p in range(90)]
    queries = [(k, q, rnd.randrange(90), rnd.randrange(45)) for k in ("a", "b") for q in range(150)]
    got = chains.first_above(
        spark.createDataFrame(queries, "k string, q long, pos long, v long"), spark.createDataFrame(values, "k string, pos long, v long"), ["k"]
    )
    found = {(r.k, r.q): r.found for r in got.collect()}
    for k, q, pos, v in queries:
        assert found.get((k, q)) == next((p for n, p, x in values if n == k and p > pos and x > v), None)


def test_sharded_windows_equal_plain_windows(spark):
    rows = _random_cues(7, n=200)
    df = spark.createDataFrame(rows, "rec_id string, cue_no bigint, start_ms bigint, end_ms bigint, text string")
    df = df.withColumn("maybe", F.when(F.col("cue_no") % 3 == 0, F.col("end_ms")))
    specs_ = [
        Running("nx", "lead", F.col("start_ms")), Running("pv", "lag", F.col("maybe")),
        Running("total", "sum", F.col("cue_no")), Running("top", "max", F.col("end_ms")),
        Running("seen", "last", F.col("maybe")), Running("soon", "next", F.col("maybe")),
    ]
    got = running(df, ["rec_id"], C.ORDER, time_shard("start_ms", 3000), specs_)
    df.createOrReplaceTempView("c")
    want = spark.sql(
        """SELECT rec_id, cue_no, lead(start_ms) OVER w AS nx, lag(maybe) OVER w AS pv, sum(cue_no) OVER w AS total,
        max(end_ms) OVER w AS top, last_value(maybe) IGNORE NULLS OVER w AS seen,
        first_value(maybe) IGNORE NULLS OVER (PARTITION BY rec_id ORDER BY start_ms, cue_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS soon
        FROM c WINDOW w AS (PARTITION BY rec_id ORDER BY start_ms, cue_no)"""
    )
    names = ["rec_id", "cue_no", "nx", "pv", "total", "top", "seen", "soon"]
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, want.select(*names).collect()))


def test_chained_windows_read_their_source_once(spark, tmp_path):
    rows = [(r[0], r[1], r[2]) for r in _random_cues(4)]
    spark.createDataFrame(rows, "rec string, id long, at long").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    shard = F.floor(F.col("at") / 3000)
    for name in ("a", "b", "c"):
        df = running(df, ["rec"], ["at", "id"], shard, [Running(name, "sum", F.col("id")), Running(f"{name}_last", "lag", F.col("at"))])
    assert len(df.collect()) == len(rows)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1


def test_global_rank(spark):
    df = spark.range(500).withColumn("k", F.md5(F.col("id").cast("string")))
    ranked = global_rank(df, ["k"], F.conv(F.substring("k", 1, 1), 16, 10).cast("int"))
    rows = [r.k for r in ranked.orderBy("rank").collect()]
    assert rows == sorted(rows)
    assert ranked.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()[:] == (1, 500, 500)


def test_gap_fill_leaves_no_gap(spark):
    rows = _random_cues(11, spread=90000)
    df = spark.createDataFrame(rows, "rec_id string, cue_no bigint, start_ms bigint, end_ms bigint, text string")
    filled = C.fill_gaps(df).collect()
    for group in _by_rec([(r.rec_id, r.cue_no, r.cue_no, 0, r) for r in filled]).values():
        cues = [g[4] for g in group]
        assert [c.cue_no for c in cues] == list(range(1, len(cues) + 1))
        assert all(b.start_ms - a.end_ms <= C.MAX_GAP_MS for a, b in zip(cues, cues[1:]))


def test_offset_and_first_cue(spark):
    seg = spark.createDataFrame(
        [("r", 1, "那个我再问一下，就是咱们院里这个篮球队还有足球队这个训练情况，最近练得怎么样？", 0, 12000)],
        "rec_id string, seg_no int, text string, start_ms bigint, end_ms bigint",
    )
    cues = L.generate_cues(seg, 1.5, 15).orderBy("cue_no").collect()
    block = C.srt_blocks(L.generate_cues(seg, 1.5, 15)).orderBy("cue_no").first().block
    assert block.startswith("1\n00:00:01,500 -->")
    assert cues[-1].end_ms == 13500 + C.TAIL_MS
    assert all(a.end_ms <= max(b.start_ms - 1, a.start_ms + 200) for a, b in zip(cues, cues[1:]))


def test_lines_take_times_from_their_characters(spark):
    times = [(i * 100, i * 100 + 80) for i in range(6)]
    seg = spark.createDataFrame(
        [("r", 1, "一二三四五六", 0, 600, times)],
        "rec_id string, seg_no int, text string, start_ms bigint, end_ms bigint, char_times array<struct<s:bigint,e:bigint>>",
    )
    cues = L.generate_cues(seg, 0, 5).orderBy("cue_no").collect()
    assert [(c.start_ms, c.text) for c in cues] == [(0, "一二三四五"), (500, "六")]
    assert cues[0].end_ms == 499 and cues[1].end_ms == 700 + C.TAIL_MS


def test_character_segments(spark):
    text = "你好。世界 ,再见"
    rows, t = [], 0
    for i, ch in enumerate(text):
        t += 5000 if i == 6 else 100
        rows.append(("r", i, ch, t, t + 50))
    df = spark.createDataFrame(rows, "rec_id string, pos bigint, ch string, start_ms bigint, end_ms bigint")
    got = C.char_segments(df).orderBy("seg_no").collect()
    assert [g.text for g in got] == ["你好。", "世界,再见"]
    assert all(len(g.char_times) == len(g.text) for g in got)


def test_reattach_and_fill(spark):
    segs = spark.createDataFrame(
        [("r", 1, "，a", 0, 5), ("r", 2, "b", 10, 15), ("r", 3, "。", 20, 25), ("r", 4, "，c", 30, 35)],
        "rec_id string, seg_no bigint, text string, start_ms bigint, end_ms bigint",
    )
    got = C.reattach_leading_marks(segs).orderBy("run_no", "start_ms").collect()
    assert [g.text for g in got] == ["，a", "b", "。，c"]  # a full stop may lead a line
    chars = spark.createDataFrame(
        [("r", 0, None, None), ("r", 1, 5, 9), ("r", 2, None, None), ("s", 0, None, None)],
        "rec_id string, pos bigint, start_ms bigint, end_ms bigint",
    )
    filled = C.fill_times(chars, ["pos"], F.lit(0)).orderBy("rec_id", "pos").collect()
    assert [(f.start_ms, f.end_ms) for f in filled] == [(5, 5), (5, 9), (9, 9), (0, 0)]


def test_overlap_pairs_are_found_once(spark):
    rnd = random.Random(5)
    a = [("r", i, s := rnd.randrange(50000), s + rnd.randrange(1, 30000), "t") for i in range(40)]
    b = [("r", s := rnd.randrange(50000), s + rnd.randrange(1, 30000)) for _ in range(30)]
    cues = spark.createDataFrame(a, "rec_id string, cue_no bigint, start_ms bigint, end_ms bigint, text string")
    quiet = spark.createDataFrame(b, "rec_id string, start_ms bigint, end_ms bigint")
    got = C.captions_over_silence(cues, quiet, 7000).select("cue_no", "silence_start", "silence_end").collect()
    want = [(x[1], y[1], y[2]) for x in a for y in b if x[2] < y[2] and y[1] < x[3]]
    assert sorted(tuple(g) for g in got) == sorted(want)


def test_batch_subtitles(spark):
    rows = [
        ("a", 0, "<|zh|>你好世界。今天天气很好！", 0.0, 700.0), ("a", 1, " <|x|> ", 700.0, 900.0), ("a", 2, None, 0.0, 0.0),
        ("a", 3, "早", 600.0, 650.0), ("a", 4, "晚安。", 5000.0, 4000.0), ("b", 0, "whole text", 0.0, 0.0), ("c", 0, "没有时长", None, None),
    ]
    segments = spark.createDataFrame(rows, "rec_id string, seg_no int, text string, start_ms double, end_ms double")
    durations = spark.createDataFrame([("a", 9e9), ("b", 2500.0)], "rec_id string, duration_ms double")
    got = [tuple(r) for r in L.batch_subtitles(segments, durations).orderBy("rec_id", "cue_no").collect()]
    assert got == [
        ("a", 1, 0.0, 280.0, "你好世界。"), ("a", 2, 280.0, 700.0, "今天天气很好！"), ("a", 3, 700.0, 1000.0, "早"), ("a", 4, 5000.0, 6000.0, "晚安。"),
        ("b", 1, 0.0, 2500.0, "whole text"), ("c", 1, 0.0, 1000.0, "没有时长"),
    ]
    assert L.batch_subtitles(segments.limit(0)).count() == 0


def test_monotone_times_keep_fractions_and_a_given_order(spark):
    rows = [("r", 1, 10.5, 20.25), ("r", 2, 0.0, 5.0), ("r", 3, 400.75, 400.75), ("q", 1, 1.0, 2.0)]
    cues = spark.createDataFrame(rows, "rec_id string, cue_no long, start_ms double, end_ms double")
    got = sorted(tuple(r) for r in C.monotone_times(cues, order=["cue_no"], shard=F.floor(F.col("cue_no") / 2)).collect())
    assert got == [("q", 1, 1.0, 2.0), ("r", 1, 10.5, 20.25), ("r", 2, 20.25, 320.25), ("r", 3, 400.75, 700.75)]


def test_generated_cues_of_many_and_of_long_sentences(spark, tmp_path):
    """Times past 32 bits; of two pieces with one number the earlier sentence goes first, each in its own time."""
    rows = [(1, "s", "en", "a." * 21_600), (2, "s", "en", "b" * 40_030 + ".c")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.generated_cues(spark, str(tmp_path)).orderBy("rec_id", "cue_no").collect()
    many, long = ([r for r in got if r.rec_id == i] for i in (1, 2))
    assert [(r.cue_no, r.start_ms, r.text) for r in many] == [(i + 1, i * 100_000 + 1500, "a") for i in range(21_600)]
    assert [(r.cue_no, r.start_ms, r.text) for r in long[-3:]] == [
        (2701, 4_001_500, "b" * 15), (2702, 4_003_000, "b" * 15), (2703, 101_500, "c")
    ]


@pytest.mark.parametrize("timed", [False, True])
def test_stretches_are_cut_like_single_characters(timed):
    """Wide letters, times that are missing, too few or too many, and a batch that is a slice of another."""
    rnd = random.Random(31)
    rows, want = [], []
    for rec in range(60):
        text = "".join(rnd.choice("ab é好😀。!") for _ in range(rnd.randint(1, 9)))
        t, times = 0, []
        for _ in range(rnd.choice([len(text)] * 3 + [len(text) + 2, len(text) - 1, 0])):
            t += rnd.choice([0, 0, 0, 1500])
            times.append(rnd.choice([{"start": t, "end": t + 100}] * 9 + [{"start": None, "end": t + 100}, None]))
            t += 100
        times = rnd.choice([times] * 9 + [None])
        rows.append({"rec_id": rec, "pos": rec * 7, "text": text, "times": times})
        at = lambda i, name: ((times or [])[i : i + 1] or [None])[0] and times[i][name]  # noqa: B023, E731
        cuts = [0]
        for i in range(1, len(text)):
            s, e = at(i, "start"), at(i - 1, "end")
            if text[i - 1] in C.SENTENCE_MARKS or (s is not None and e is not None and s - e >= C.PAUSE_MS):
                cuts.append(i)
        for b, e in zip(cuts, [*cuts[1:], len(text)]):
            row = {"rec_id": rec, "pos": rec * 7, "b": b, "text": text[b:e], "_start": at(b, "start"), "_end": at(e - 1, "end")}
            want.append((rec, row | ({"times": (times or [])[b:e]} if timed else {})))
    moment = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("rec_id", pa.int32()), ("pos", pa.int64()), ("text", pa.string()), ("times", moment)]))
    assert C.cut_stretches(batch, C.PAUSE_MS, timed).to_pylist() == [row for _, row in want]
    part = C.cut_stretches(batch.slice(20, 15), C.PAUSE_MS, timed).to_pylist()
    assert part == [row for rec, row in want if 20 <= rec < 35]
    assert C.cut_stretches(batch.slice(0, 0), C.PAUSE_MS, timed).num_rows == 0


def test_text_segments_equal_character_segments_over_borders(spark):
    """Stretches may end inside a sentence: the same segments as from single characters, with no row a character."""
    rnd = random.Random(8)
    stretches, chars = [], []
    for rec in range(6):
        t = pos = 0
        for _ in range(rnd.randint(1, 12)):
            text = "".join(rnd.choice("ab 。,！ 好") for _ in range(rnd.randint(0, 7)))
            times = []
            for ch in text:
                t += rnd.choice([0, 0, 0, 1500])
                times.append((t, t + 100))
                chars.append((rec, pos + len(times) - 1, ch, t, t + 100))
                t += 100
            stretches.append((rec, pos, text, times))
            pos += len(text)
    types = "rec_id int, pos bigint, text string, times array<struct<start: bigint, end: bigint>>"
    texts = C.text_segments(spark.createDataFrame(stretches, types).dropDuplicates(["rec_id", "pos", "text"]))
    single = C.char_segments(spark.createDataFrame(chars, "rec_id int, pos bigint, ch string, start_ms bigint, end_ms bigint"))
    got, want = (sorted(tuple(r) for r in df.collect()) for df in (texts, single))
    assert got == want and all(len(r[2]) == len(r[5]) for r in got)
    # The model: pieces end after a mark or before a pause, are trimmed, and join the one before if led by a closing mark.
    model = {}
    for rec in range(6):
        pieces, last = [], None
        for _, _, ch, s, e in (c for c in chars if c[0] == rec):
            if last is None or last[0] in "。！" or s - last[1] >= C.PAUSE_MS:
                pieces.append([])
            pieces[-1].append((ch, s, e))
            last = (ch, e)
        for piece in pieces:
            while piece and piece[0][0] == " ":
                piece.pop(0)
            while piece and piece[-1][0] == " ":
                piece.pop()
            if piece:
                said = model.setdefault(rec, [])
                if said and piece[0][0] in C.LEADING_MARKS:
                    said[-1] += piece
                else:
                    said.append(list(piece))
    assert [(r[0], r[2], r[3], r[4]) for r in got] == [
        (rec, "".join(c[0] for c in seg), seg[0][1], seg[-1][2]) for rec in sorted(model) for seg in model[rec]
    ]


def test_spans_of_whole_texts(spark):
    rows = [(1, "a!b?? c"), (2, " ! \n;x"), (3, ""), (4, None), (5, "no mark"), (6, "x;"), (7, "a! ")]
    got = C.sentence_spans(spark.createDataFrame(rows, "rec_id int, text string"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 0, 0, 2), (1, 1, 2, 4), (1, 2, 4, 5), (1, 3, 5, 7), (2, 0, 0, 2), (2, 1, 2, 5), (2, 2, 5, 6), (5, 0, 0, 7), (6, 0, 0, 2), (7, 0, 0, 2)
    ]
