import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import lines as L
from tests import specs


def _values(spark, column, rows, name="x"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_norm_and_tags(spark):
    assert _values(spark, T.norm("x"), ["Ａb c，。D-e　f\t“g”", "…a"]) == ["ａbcdefg", "…a"]
    assert _values(spark, T.strip_tags("x"), ["<|zh|><|Speech|> hi ", None]) == ["hi", ""]


def test_breaking_lines_strips_a_text_once(spark):
    df = spark.createDataFrame([("<|zh|> one. twofold",)], "x string").select(L.break_lines_punct("x").alias("v"))
    assert df.first().v == ["one.", "twofold"]
    assert df._jdf.queryExecution().analyzed().toString().count(T.RICH_TEXT_TAG) == 1


def test_clocks(spark):
    df = spark.createDataFrame([(-5.0,), (1499.5,), (1500.5,), (3723004.0,)], "ms double")
    assert [r[0] for r in df.select(T.clock("ms")).collect()] == [
        "00:00:00,000", "00:00:01,500", "00:00:01,500", "01:02:03,004",
    ]
    whole = spark.createDataFrame([(994,), (995,), (3600000,)], "ms bigint")
    assert [r[0] for r in whole.select(T.clock_centis("ms")).collect()] == ["0:00:00.99", "0:00:01.00", "1:00:00.00"]


@pytest.mark.parametrize(
    "duration,frames",
    [(3.726, 371), (24.610, 2459), (11.650, 1163), (13.881, 1386), (3.800, 378), (25.490, 2547), (29.899, 2988), (26.544, 2652)],
)
def test_frames(spark, duration, frames):
    assert spark.range(1).select(T.frames(F.lit(duration))).first()[0] == frames


def test_error_ladder(spark):
    got = _values(spark, T.classify_error("x"), ["code 401", "Insufficient funds", "404 x", "Timed out", "SSL broke", "y" * 300])
    assert got[:5] == ["401", "402", "404", "timeout", "connection"]
    assert got[5] == "other: " + "y" * 200


def test_keyword_list(spark):
    assert _values(spark, T.parse_keywords("x"), [" a，b, a ,,c", ""]) == [["a", "b", "c"], []]


PIECES = ["你好", "的", "了", "。", "！", "？！", "，", "、", "；", " ", "abc", "word ", "x.", " y", "3.14", "…", "很长的一段话没有标点", "<|zh|>", "\n", "a" * 9]


def _random_texts(n, longest, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


def test_greedy_lines_match_the_rule(spark):
    for limit in (5, 15):
        texts = _random_texts(150, 30, limit)
        got = _values(spark, L.break_lines_greedy("x", limit), texts)
        for t, lines in zip(texts, got):
            specs.check_greedy_lines(t, lines, limit, L.CLOSING_MARKS, L.SOFT_CUT_CHARS)


def test_sample_sentences_break_cleanly(spark):
    texts = [
        "那个我再问一下，就是咱们院里这个篮球队还有足球队这个训练情况，最近练得怎么样？",
        "好大家上午好这个一直以来咱们商场的销售情况都很好特别是最近营业额有很大的提升",
        "短句", "今天天气不错我们去公园散步然后顺便买点东西回家做午饭",
    ]
    for lines in _values(spark, L.break_lines_greedy("x", 15), texts):
        assert all(len(x) <= 15 for x in lines)
        assert not any(x in "。！？，" for x in lines)


def cjk_share(text):
    return sum("一" <= c <= "鿿" for c in text) / max(1, len(text))


def test_punct_lines_match_the_rule(spark):
    for limit in (6, 20):
        texts = _random_texts(150, 40, 100 + limit)
        got = _values(spark, L.break_lines_punct("x", limit), texts)
        for t, lines in zip(texts, got):
            t = re.sub(r"<\|[^|]*\|>", "", t).strip()
            wide = limit if cjk_share(t) >= 0.3 else int(limit * L.WIDE_FACTOR)
            specs.check_punct_lines(t, lines, wide, T.SENTENCE_END_CHARS, T.CLAUSE_CHARS, L.CUT_CHARS)


def test_chunks_match_the_rule(spark):
    rnd = random.Random(3)
    bits = ["# Head\n", "\n\n", "para text ", "句子。", "long " * 8, "x" * 30, "\n", "？", " ## no", "\r\n", "  ### Sub\n"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    for size, overlap in ((40, 8), (25, 0)):
        got = _values(spark, L.chunks_of("x", size, overlap), texts)
        for t, parts in zip(texts, got):
            specs.check_chunks(t, parts, size, overlap)


def test_no_python_in_line_plans(spark):
    df = spark.createDataFrame([("a",)], "x string").select(L.break_lines_punct("x"), L.chunks_of("x"))
    assert "Python" not in df._jdf.queryExecution().toString()
