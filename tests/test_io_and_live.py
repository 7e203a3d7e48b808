import difflib
import json
import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions import alignment
from lectern.operators import datasets as A
from lectern.operators import dialogue as D
from lectern.operators import jobs as J
from lectern.operators import scorer as M
from lectern.operators import scoring as S
from lectern.sources import readers as R
from lectern.sources import sinks as K
from lectern.streaming import live as V


def test_uid_text_last_line_wins(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("u1\told\n\nu2 \t a\tb \nu1\tnew\nu3\n", encoding="utf-8")
    got = {r.uid: r.text for r in R.read_uid_text(spark, str(tmp_path / "h.tsv")).collect()}
    assert got == {"u1": "new", "u2": "a\tb", "u3": ""}


def test_manifest_and_positions(spark, tmp_path):
    (tmp_path / "a").write_text("u1 x.wav\nu2\nu3　y z.wav\nu4 w\n", encoding="utf-8")
    (tmp_path / "b").write_text("u1 hello there\nu2 t\nu9 t\n", encoding="utf-8")
    assert R.read_manifest(spark, str(tmp_path / "a")).count() == 3
    pairs = A.pair_by_position(
        R.read_positions(spark, str(tmp_path / "a"), "path"), R.read_positions(spark, str(tmp_path / "b"), "text")
    ).orderBy("line_no").collect()
    assert [p.status for p in pairs] == ["matched", "malformed", "mismatch", "left_only"]
    assert pairs[2].error == "UTT mismatch: u3 vs u9"


SRT = "﻿1\r\n00:00:02,5 --> 00:00:03.000\r\nsecond\r\n42\r\n\r\n00:00:01,000 --> 00:00:01,500\rfirst\rline\r\r3\n00:00:05,000 --> 00:00:06,000\n\n"


def test_subtitle_dialects(spark):
    files = spark.createDataFrame([("r", SRT)], "rec_id string, body string")
    got = [(c.cue_no, c.start_ms, c.end_ms, c.lines) for c in R.parse_subtitles(files).orderBy("cue_no").collect()]
    assert got == [(1, 1000, 1500, ["first", "line"]), (2, 2005, 3000, ["second"])]
    strict = R.parse_subtitles(files, "strict").orderBy("cue_no").collect()
    assert [(c.start_ms, c.lines) for c in strict] == [(2005, ["second 42"]), (1000, ["first line"])]


def test_a_time_line_ends_the_cue_before_it(spark):
    body = "00:00:01,000 --> 00:00:02,000 \nfirst \n  more\t\n2\n00:00:03.000 --> 00:00:04.000\nsecond\n\nstray\n00:00:05,000 --> 00:00:06,000\n00:00:07,000 --> 00:00:08,000\nlast"
    files = spark.createDataFrame([("r", body), ("empty", ""), ("none", None)], "rec_id string, body string")
    got = [(c.rec_id, c.cue_no, c.start_ms, c.lines) for c in R.parse_subtitles(files).orderBy("cue_no").collect()]
    assert got == [("r", 1, 1000, ["first", "  more"]), ("r", 2, 3000, ["second"]), ("r", 3, 7000, ["last"])]


CUE = "rec_id string, cue_no int, start_ms bigint, end_ms bigint, text string"


def test_styled_subtitles_of_recordings_with_nothing_to_show(spark, tmp_path):
    cues = [("r", i, i * 10, i * 10 + 5, f"t{i}\nx") for i in range(1, 41)]
    cues += [("gaps", 1, 0, 5, "\u200b"), ("gaps", 2, 5, 9, "\u200b"), ("silent", 1, 0, 5, " "), ("silent", 2, 5, 9, None)]
    K.write_ass(spark.createDataFrame(cues, CUE), str(tmp_path / "out"))
    got = {}
    for part in sorted((tmp_path / "out").glob("rec_id=*/*.txt")):
        got.setdefault(part.parent.name, []).extend(part.read_bytes().decode().split("\r\n")[:-1])
    assert sorted(got) == ["rec_id=gaps", "rec_id=r"]
    assert got["rec_id=gaps"] == K.ASS_HEAD == got["rec_id=r"][: len(K.ASS_HEAD)]
    assert [x.rpartition(",")[2] for x in got["rec_id=r"][len(K.ASS_HEAD) :]] == [f"t{i}\\Nx" for i in range(1, 41)]


@pytest.mark.parametrize("cue", [("r", 2, None, 9, "t"), ("r", 2, 5, None, "t"), (None, 2, 5, 9, "t"), ("", 2, 5, 9, "t"), ("r", None, 5, 9, "t")])
def test_a_cue_that_cannot_be_written_fails_the_styled_subtitles(spark, tmp_path, cue):
    with pytest.raises(Exception, match="lacks its recording, number or a time"):
        K.write_ass(spark.createDataFrame([("r", 1, 0, 5, "t"), cue], CUE), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


@pytest.mark.parametrize("dialect", ["tolerant", "strict"])
def test_subtitles_read_in_splits(spark, tmp_path, dialect):
    rnd = random.Random(8)
    pieces = [
        "", " \t", "\u3000", "7", "text", "more text ", "  lead", "\ufeff12", "00:00:0{},5 --> 00:00:09.000", "x 0:0:{},120 --> 0:1:2,3 y",
    ]
    bodies = {"r\u00e9c": SRT, "empty": "", "blank": "\n\n \r\n", "open": "no time\nat all"}
    for n in range(12):
        lines = [rnd.choice(pieces).format(rnd.randrange(10)) for _ in range(rnd.randrange(1, 60))]
        bodies[f"r{n}"] = "".join(x + rnd.choice(["\n", "\r\n", "\r"]) for x in lines) + rnd.choice(["", "tail"])
    for name, body in bodies.items():
        (tmp_path / f"{name}.srt").write_bytes(body.encode())
    files = spark.createDataFrame(list(bodies.items()), "rec_id string, body string")
    want = sorted(map(tuple, R.parse_subtitles(files, dialect).collect()))
    assert len(want) > 20
    try:
        for size in ("40", "333", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert sorted(map(tuple, R.read_subtitles(spark, str(tmp_path), dialect).collect())) == want
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
        assert R.text_lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 40
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_recording_in_several_files(spark, tmp_path):
    folder = tmp_path / "rec_id=a"
    folder.mkdir()
    (folder / "part-0.txt").write_text("00:00:01,000 --> 00:00:02,000\nfirst\n")
    (folder / "part-1.txt").write_text("goes on\n\n00:00:03,000 --> 00:00:04,000\nsecond\n")
    got = R.read_subtitles(spark, str(tmp_path), rec=lambda path: F.regexp_extract(path, "rec_id=([^/]*)/", 1), recursiveFileLookup="true")
    assert [(r.rec_id, r.cue_no, r.lines) for r in got.orderBy("cue_no").collect()] == [("a", 1, ["first", "goes on"]), ("a", 2, ["second"])]


def test_documents_utf8_gbk_and_errors(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("知识".encode("gbk") + b"\xff")
    (tmp_path / "b.MD").write_text("# 标题", encoding="utf-8")
    (tmp_path / "c.pdf").write_bytes(b"x")
    (tmp_path / "d.log").write_text(" \n", encoding="utf-8")
    docs, errors = R.read_documents(spark, str(tmp_path))
    assert {r.source: r.text for r in docs.collect()} == {"a.txt": "知识", "b.MD": "# 标题"}
    assert {r.source: r.error for r in errors.collect()} == {"c.pdf": R.UNSUPPORTED, "d.log": R.EMPTY}


def test_media_listing(spark, tmp_path):
    for n in ("b.MP4", "a.wav", "x.txt", "batchsub_1.wav", "y.temp.wav"):
        (tmp_path / n).write_bytes(b"1")
    got = [r.path.rsplit("/", 1)[1] for r in R.list_media(spark, [str(tmp_path)]).collect()]
    assert got == ["a.wav", "b.MP4"]


def test_token_times_become_segments(spark):
    rows = [("r", "你好", None, [("你", 0.0, 0.5), ("好", 0.5, 1.0)]), ("s", "x", [("<|zh|>hi", 1, 2, None)], None)]
    res = spark.createDataFrame(rows, R.schemas.RESULTS)
    chars = R.token_chars(res.filter("rec_id = 'r'")).orderBy("pos").collect()
    assert [(c.ch, c.start_ms, c.end_ms) for c in chars] == [("你", 0, 500), ("好", 500, 1000)]
    seg = R.result_segments(res).orderBy("rec_id").collect()
    assert [(s.speaker, s.text) for s in seg] == [("说话人0", "你好"), ("说话人未知", "hi")]


def test_srt_file_parts_are_in_order(spark, tmp_path):
    cues = spark.range(1, 400).select(
        F.lit("r").alias("rec_id"), F.col("id").alias("cue_no"), (F.col("id") * 10).alias("start_ms"),
        (F.col("id") * 10 + 5).alias("end_ms"), F.concat(F.lit("t"), "id").alias("text"),
    )
    K.write_srt(cues.repartition(5), str(tmp_path / "srt"), "plain")
    parts = sorted((tmp_path / "srt" / "rec_id=r").glob("part-*"))
    body = "".join(p.read_text(encoding="utf-8") for p in parts)
    assert body.startswith("﻿1\n00:00:00,010 --> 00:00:00,015\nt1\n\n2\n")
    assert [int(x) for x in body.lstrip("﻿").split("\n")[::4] if x] == list(range(1, 400))


def test_batch_scorer_retries_row_by_row(spark):
    def make():
        def run(items):
            if "bad" in items:
                raise ValueError("no")
            return [x.upper() for x in items]

        return run

    df = spark.createDataFrame([(i, x) for i, x in enumerate(["a", "bad", "c"])], "i int, path string").coalesce(1)
    assert [r.text for r in M.recognise(df, make).orderBy("i").collect()] == ["A", "", "C"]
    kept = M.score_rows(df, make, "path", "p", on_error="input").orderBy("i").collect()
    assert [(r.p, r.error) for r in kept] == [("A", None), ("bad", "no"), ("C", None)]


def test_plan_outputs(spark):
    files = spark.createDataFrame([("b/x.mp4",), ("a/x.wav",), ("a/y.wav",), ("a/y.wav",), ("z",)], "path string")
    have = spark.createDataFrame([("subtitle/y.srt",)], "target string")
    got = {r.path: r.status for r in J.plan_outputs(files, have).collect()}
    assert got == {"a/x.wav": "todo", "b/x.mp4": "conflict", "a/y.wav": "skipped", "z": "todo"}
    forced = {r.path: r.status for r in J.plan_outputs(files, have, force=True).collect()}
    assert forced["a/y.wav"] == "todo"


def test_rtf_of_the_published_timings(spark):
    t = spark.createDataFrame([(4.1, 0.18), (43.8, 0.63), (30.3, 0.34), (4.1, 0.25), (0.0, 9.0)], "duration_s double, cost_s double")
    r = J.rtf_summary(t).first()
    assert r.n == 4 and round(r.mean_rtf, 3) == 0.033 and round(r.speed) == 59


def test_degradation_of_published_rates(spark):
    refs = spark.createDataFrame([("u", "abcd"), ("v", "")], "uid string, ref string")
    hyps = spark.createDataFrame([("u", "a", "clean", "abcx"), ("u", "a", "noise", "xyzd"), ("v", "a", "clean", "q")], "uid string, system string, condition string, hyp string")
    m = {r.condition: r for r in S.robustness_matrix(S.score_pairs(refs, hyps), S.reference_totals(refs)).collect()}
    assert m["clean"].cer == 2 / 5 and m["noise"].cer == 3 / 5 and m["noise"].degradation == pytest.approx(1.5)
    inner = {r.condition: r for r in S.cer(S.score_pairs(refs, hyps), S.reference_totals(refs), ["condition"]).collect()}
    assert inner["clean"].cer == 1 / 4 and inner["noise"].missing == 1


def test_mixture_total(spark):
    sizes = {"clean": 11986, "n1": 7000, "n2": 7000, "n3": 7000, "n4": 7000, "talks": 13675}
    mixed = A.mixture({k: spark.range(n) for k, n in sizes.items()})
    assert A.mixture_counts(mixed).filter("corpus is null").first().n == 53661


def test_history_is_trimmed(spark):
    turns = spark.createDataFrame(
        [("s", i, "user" if i % 2 else "assistant", f"m{i}" if i != 5 else "") for i in range(40)],
        "session_id string, turn bigint, role string, content string",
    )
    assert D.session_history(turns).count() == 16
    assert sorted(r.turn for r in D.prompt_history(turns).collect()) == list(range(34, 40))


def test_context_prompt_cases(spark):
    q = spark.createDataFrame([(1, "how", "s"), (2, "why", "t")], "query_id int, question string, session_id string")
    hits = spark.createDataFrame([(1, 1, "a.md", "0.9", "text\nmore"), (1, 2, "b.md", "0.8", "x" * 300), (1, 3, "a.md", "0.5", "z")], "query_id int, rank int, source string, score string, text string")
    past = spark.createDataFrame([("s", 1, "user", "hi"), ("s", 2, "assistant", " ")], "session_id string, turn bigint, role string, content string")
    got = {r.query_id: r for r in D.context_prompt(q, hits, past, "SYS").collect()}
    assert [m.role for m in got[1].messages] == ["system", "user", "user"]
    assert got[1].sources == ["a.md", "b.md"] and got[1].answer is None
    assert got[2].answer == D.NOTHING_FOUND and got[2].messages is None and got[2].sources == []
    plain = {r.query_id: r for r in D.context_prompt(q, hits, has_answerer=False).collect()}
    assert plain[1].answer.startswith(D.NO_ANSWERER + "\n\n【a.md】text more\n\n【b.md】" + "x" * 200 + "…")


def test_context_prompt_reads_the_hits_once(spark):
    q = spark.createDataFrame([(1, "how")], "query_id int, question string")
    hits = spark.createDataFrame([(1, 1, "a.md", "0.9", "text")], "query_id int, rank int, source string, score string, text string")
    plan = D.context_prompt(q, hits, has_answerer=False)._jdf.queryExecution().analyzed().toString()
    assert plan.count("LogicalRDD") == 2


def _fragments(spark):
    rows = [(f"s{i % 3}", i, f"2024-01-01 00:00:{i % 60:02d}", [" ", "a", "b", "c"][i % 4], i % 7 == 6) for i in range(60)]
    return spark.createDataFrame(rows, "session_id string, seq bigint, ts string, text string, is_final boolean").withColumn("ts", F.col("ts").cast("timestamp"))


def _spread(df, path, triggers, seed):
    """Write the fragments to a file for each trigger, dealt at random, then one that closes all sessions."""
    rows = [r.asDict() | {"ts": r.ts.isoformat()} for r in df.collect()]
    random.Random(seed).shuffle(rows)
    path.mkdir()
    rows = [rows[i::triggers] for i in range(triggers)] + [[{"session_id": "end", "seq": 0, "ts": "2024-01-02T00:00:00", "text": "", "is_final": False}]]
    for i, part in enumerate(rows):
        name = path / f"{i}.json"
        name.write_text("\n".join(json.dumps(r) for r in part))
        os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))  # files are read oldest first


@pytest.mark.parametrize(("triggers", "idle_ms"), [(1, 366 * 86_400_000), (5, 366 * 86_400_000), (5, 4_000)])
def test_streams_equal_their_batch_twins(spark, tmp_path, triggers, idle_ms):
    """In any order of arrival within the watermark's delay, with and without silences."""
    df = _fragments(spark).filter("seq % 11 not in (3, 4)")
    _spread(df, tmp_path / "in", triggers, triggers)
    stream = lambda: R.read_fragments(spark, str(tmp_path / "in"), "json", 1)
    twin_idle = idle_ms if idle_ms < 10_000 else None
    captions = V.run_available(V.accumulate_captions(stream(), idle_ms, 10 * idle_ms), spark, "t")
    got = sorted(tuple(r) for r in V.stream_finals(captions).select("session_id", "utt_no", "seq", "text").collect())
    want = sorted(tuple(r) for r in V.caption_finals(df, twin_idle).collect())
    assert got == want and len(set((s, no) for s, no, _, _ in got)) == len(got)
    chunks = V.run_available(V.rechunk_stream(stream(), 3, idle_ms, 10 * idle_ms), spark, "t").drop("batch")
    assert sorted(map(tuple, chunks.collect())) == sorted(map(tuple, V.rechunk_batch(df, 3, twin_idle).collect()))


def test_silences_and_late_fragments(spark, tmp_path):
    rows = [
        [("s", 1, "00:00:00", "a", False), ("s", 3, "00:00:02", "c", False)], [("s", 2, "00:00:01", "b", False)], [("s", 4, "01:00:00", "d", True)],
        [("t", 1, "01:00:01", "", False)], [("s", 9, "00:20:00", "late", False)], [("s", 5, "02:00:00", "e", False)], [("end", 0, "23:00:00", "", False)],
    ]
    (tmp_path / "in").mkdir()
    for i, part in enumerate(rows):
        name = tmp_path / "in" / f"{i}.json"
        name.write_text("\n".join(json.dumps({"session_id": s, "seq": q, "ts": f"2024-01-01T{t}", "text": x, "is_final": f}) for s, q, t, x, f in part))
        os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))
    late = []
    out = V.run_available(
        V.accumulate_captions(R.read_fragments(spark, str(tmp_path / "in"), "json", 1)), spark, "t", ended=lambda q: late.append(V.late_rows(q))
    )
    finals = [(r.utt_no, r.seq, r.text) for r in V.stream_finals(out).filter("session_id = 's'").orderBy("utt_no").collect()]
    assert finals == [(0, 3, "abc"), (1, 4, "d"), (2, 5, "e")] and late == [1]


def test_memory_keeps_the_last_turns_in_any_order(spark, tmp_path):
    turns = [{"session_id": "s", "turn": i, "role": "user", "content": f"m{i}" if i != 5 else ""} for i in range(40)]
    random.Random(3).shuffle(turns)
    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, turns[k::5])))
    stream = spark.readStream.schema("session_id string, turn bigint, role string, content string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = V.run_available(V.session_memory(stream, 4), spark, "t", "update").orderBy(F.desc("batch")).first()
    assert [t["turn"] for t in json.loads(out.history)] == list(range(32, 40))


def test_samples_are_valid_json(spark, tmp_path):
    u = spark.createDataFrame([("u1", "a.wav", "你好", 3.726), ("u2", "b.wav", "x", None)], "uid string, path string, text string, duration_s double")
    s = A.build_samples(u)
    K.write_samples(s.filter("error is null").orderBy("uid"), str(tmp_path / "s"), ["speech_length"])
    line = next((tmp_path / "s").glob("part-*")).read_text(encoding="utf-8").strip()
    assert "你好" in line and json.loads(line)["speech_length"] == 371
    assert s.filter("error is not null").first().error == "WAV not found: b.wav"


def difflib_times(text, heard, times):
    """The plain form: the standard library's blocks, then filling forward and backward."""
    out = [None] * len(text)
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, heard, text, autojunk=False).get_opcodes():
        for k in range(j2 - j1):
            if tag == "equal":
                out[j1 + k] = times[i1 + k]
            elif tag == "replace":
                out[j1 + k] = times[i1 + min(i2 - i1 - 1, int((k + 0.5) * (i2 - i1) / (j2 - j1)))]
    known = [t for t in out if t is not None]
    last = None
    for k, t in enumerate(out):
        if t is None:
            out[k] = (last, last) if last is not None else (known[0][0],) * 2 if known else (0, 0)
        else:
            last = t[1]
    return out


@pytest.mark.parametrize("cells", [0, 1 << 12])
def test_aligned_chars_against_the_standard_library(spark, monkeypatch, cells):
    monkeypatch.setattr(alignment, "CELLS", cells)
    rng = random.Random(5)
    pairs = [("", ""), ("abc", ""), ("", "abc"), ("!a", "a"), ("..", "xy"), ("F幺零🙂。", "m二零🙂"), ("aaaa", "aaaaaaa"), ("abab" * 9, "baba" * 7)]
    for _ in range(60):
        heard = "".join(rng.choice("ab cd") for _ in range(rng.randrange(60)))
        text = "".join(rng.choice([c, c, c, c + ",", "", "x"]) for c in heard)
        pairs.append((text, heard))
    for text, heard in pairs:
        times = [(10 * i, 10 * i + 7) for i in range(len(heard))]
        got = [
            (0, 0) if s["kind"] == alignment.NONE else times[s["at"]] if s["kind"] == alignment.OWN else (times[s["at"]][s["kind"] == alignment.AFTER],) * 2
            for s in alignment.sources_of(text, heard)
        ]
        assert got == difflib_times(text, heard, times), (text, heard)


def test_aligned_chars_of_results(spark):
    token = lambda s, a, b: (s, a, b)
    rows = [
        ("r", "<|zh|>Hi, there. 🙂you", None, [token("hi", 1.0, 2.0), token("", 2.0, 2.1), token("there", 2.0, 2.5), token("🙂you", 9.0, 9.4)]),
        ("none", "text", None, [token("", 0.0, 1.0), token(None, 0.0, 1.0)]), ("blank", " ", None, [token("a", 0.0, 1.0)]), ("null", None, None, [token("a", 0.0, 1.0)]),
    ]
    res = spark.createDataFrame([(i, t, None, ts) for i, t, _, ts in rows], R.schemas.RESULTS)
    chars = R.aligned_chars(res.filter("rec_id = 'r'")).orderBy("pos").collect()
    text = "Hi, there. 🙂you"
    heard = "hithere🙂you"
    times = [(1000, 1500), (1500, 2000), *[(2000 + 100 * i, 2100 + 100 * i) for i in range(5)], *[(9000 + 100 * i, 9100 + 100 * i) for i in range(4)]]
    assert "".join(c.ch for c in chars) == text
    assert [(c.start_ms, c.end_ms) for c in chars] == difflib_times(text, heard, times)
    segments = R.result_segments(res).orderBy("rec_id", "seg_no").collect()
    assert [(s.rec_id, s.seg_no, s.text, s.start_ms, s.end_ms) for s in segments] == [
        ("blank", 0, "", 0, 0), ("none", 0, "text", 0, 0), ("null", 0, "", 0, 0), ("r", 0, "Hi, there.", 1000, 2500), ("r", 1, "🙂you", 9000, 9400),
    ]


def test_alignment_of_a_long_text_is_quick():
    rng = random.Random(9)
    heard = "".join(rng.choice("abcdefghijklmnop ") for _ in range(60_000))
    text = "".join(c.upper() if k % 997 == 0 else c for k, c in enumerate(heard))
    start = time.process_time()
    assert len(alignment.sources_of(text, heard)) == 60_000 and time.process_time() - start < 60


@pytest.mark.parametrize("n", [1, 7, 40, 500])
def test_systematic_sample_equals_plain_slicing(spark, monkeypatch, n):
    """Null and repeated uids, equal rows, more ranges than shuffle partitions, a column of maps."""
    monkeypatch.setattr("lectern.operators.ordered.RANGE_ROWS", 13)
    rows = [(f"u{i * 37 % 101:03d}", i) for i in range(101)] + [("u050", 1000 + i) for i in range(60)] + [("u051", 7)] * 30 + [(None, 5), (None, 5)]
    df = spark.createDataFrame(rows, "uid string, x int").withColumn("m", F.create_map(F.lit("k"), "x"))
    got = A.systematic_sample(df, "uid", n).select("uid", "x", F.xxhash64("uid", "x").alias("h")).collect()
    hashed = df.select("uid", "x", F.xxhash64("uid", "x").alias("h")).collect()
    order = sorted(hashed, key=lambda r: (r.uid is not None, r.uid or "", r.h))
    want = order[:: max(1, len(order) // n)][:n]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert A.systematic_sample(df.limit(0), "uid", n).count() == 0


def test_split_takes_every_eighth_in_digest_order(spark):
    import hashlib

    df = spark.range(1000).withColumnRenamed("id", "utt_id")
    got = {r.utt_id for r in A.train_val_split(df).filter("split = 'val'").collect()}
    order = sorted(range(1000), key=lambda i: hashlib.md5(f"{A.SHUFFLE_SEED}#{i}".encode()).hexdigest())
    assert got == set(order[:: A.VAL_EVERY])


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path, monkeypatch):
    for i in range(60):
        (tmp_path / f"rec_id={i}").mkdir()
        (tmp_path / f"rec_id={i}" / "part.txt").write_text(f"line {i}\n")
    monkeypatch.setattr(R, "LISTERS", 7)
    before, context = spark.conf.get(R.LISTING), spark.sparkContext
    context.setJobGroup("listing", "listing")
    lines = R.read_text(spark, str(tmp_path), recursiveFileLookup="true")
    context.setJobGroup("reading", "reading")
    jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup("listing")]
    tasks = [context.statusTracker().getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    assert tasks and max(tasks) == 7 and spark.conf.get(R.LISTING) == before
    assert sorted(r.value for r in lines.collect()) == sorted(f"line {i}" for i in range(60))


@pytest.mark.parametrize("dialect", ["tolerant", "strict"])
def test_lines_of_a_subtitle_block_go_without_their_paths(spark, tmp_path, monkeypatch, dialect):
    monkeypatch.setattr(R, "SHARD_LINES", 7)
    for part in range(3):
        (tmp_path / f"part-{part}.txt").write_text("".join(f"{i}\n00:00:{part}{i},000 --> 00:00:{part}{i},500\nsaid {part} {i}\n\n" for i in range(9)))
    read = R.read_subtitles(spark, str(tmp_path), dialect, lambda path: F.lit("all"), maxPartitionBytes="100")
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    gathered = [x.split("Aggregate", 1)[1] for x in plan.splitlines() if "collect_list(" in x]
    assert gathered and not any("file" in x or "_shard" in x for x in gathered)
    assert [(r.cue_no, *r.lines) for r in read.orderBy("cue_no").collect()] == [(9 * p + i + 1, f"said {p} {i}") for p in range(3) for i in range(9)]


def test_texts_of_uids_that_occur_once_are_not_shuffled(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("".join(f"u{i}\tsaid {i}\n" for i in range(40)) + "u7\tagain\n\tno uid\n\tno uid, later\n")
    read = R.read_uid_text(spark, str(tmp_path / "h.tsv"))
    assert {r.uid: r.text for r in read.collect()} == {f"u{i}": f"said {i}" for i in range(40)} | {"u7": "again", "": "no uid, later"}
    plan = read._jdf.queryExecution().executedPlan().toString()
    join = next(x for x in plan.splitlines() if "LeftAnti" in x)
    assert "BroadcastHashJoin" in join


def test_sessions_without_rows_to_emit_send_no_frames():
    class Handle:
        def __getattr__(self, name):
            return lambda *a, **k: self

    step = V.InOrder(V.Chunks(4), 1000, 2000)
    step.init(Handle())
    rows = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01"]), "seq": [1], "text": ["a"], "is_final": [False]})
    assert list(step.handleInputRows((1,), iter([rows]), None)) == []
    assert [len(f) for f in step._frames([(1, 0, 1, "a", 1)])] == [1]
