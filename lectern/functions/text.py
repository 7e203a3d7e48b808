"""Column expressions on text and media time. Everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------
# Character classes, labels and formats that decide the results.
SCORING_DROPPED = "。？！，、；：.,?!;:·-—_\"'“”‘’（）()[]【】<>《》~`|/\\"
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPOKEN_NUMERALS = "[零一二三四五六七八九十百千万亿两]"
WRITTEN_DIGITS = "\\d"
CJK_PUNCTUATION = "[。，、？！；：]"
RICH_TEXT_TAG = "<\\|[^|]*\\|>"
SENTENCE_END_CHARS = "。！？!?…"
CLAUSE_CHARS = "，；：,;:"
ALL_PUNCTUATION = SENTENCE_END_CHARS + CLAUSE_CHARS + "、“”‘’\"'（）()《》〈〉【】—－-…~·"
UNKNOWN_SPEAKER = "未知"
UNKNOWN_SOURCE = "未知来源"
SPEAKER_PREFIX = "说话人"
ERROR_CLASSES = [
    # (class, case-sensitive code, case-insensitive words)
    ("401", "401", ["invalid_api_key", "authentication"]),
    ("402", "402", ["insufficient", "balance"]),
    ("404", "404", ["model_not_found"]),
    ("timeout", None, ["timeout", "timed out"]),
    ("connection", None, ["connect", "ssl", "proxy"]),
]
# ---------------------------------------------------------------------------------------


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def char_class(chars: str, negate: bool = False) -> str:
    """A Java regex class matching exactly (or none of) the given characters."""
    body = "".join("\\" + ch if ch in "[]^-&\\" else ch for ch in chars)
    return f"[{'^' if negate else ''}{body}]"


def strip(c: Column | str) -> Column:
    """Trim Unicode white space at both ends (``trim`` knows only U+0020)."""
    return F.regexp_replace(col(c), "(?U)^\\s+|\\s+\\z", "")


def is_blank(c: Column | str) -> Column:
    return F.coalesce(F.length(strip(c)), F.lit(0)) == 0


def or_default(c: Column | str, default: str) -> Column:
    """NULL and the empty string both fall back to ``default``."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))


def strip_tags(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), RICH_TEXT_TAG, ""))


def norm(c: Column | str) -> Column:
    """The scoring form of a text: punctuation and white space removed, lower case.

    ``translate`` looks each character up once; a regex class of this size is three times slower.
    """
    return F.lower(F.translate(col(c), SCORING_DROPPED + WHITE_SPACE, ""))


def spoken_text(c: Column | str) -> Column:
    """Silence marks become spaces, white space runs shrink to one space."""
    return F.regexp_replace(F.replace(col(c), F.lit("/sil"), F.lit(" ")), "(?U)\\s+", " ")


def words_only(c: Column | str) -> Column:
    """Keep word characters, white space and CJK ideographs."""
    return F.regexp_replace(col(c), "(?U)[^\\w\\s\\u3000\\u4e00-\\u9fff]+", "")


def clock(ms: Column | str) -> Column:
    """``HH:MM:SS,mmm``; rounded half to even, never negative."""
    t = F.greatest(F.lit(0), F.bround(col(ms).cast("double"), 0)).cast("bigint")
    return _clock(t, ",")


def _clock(t: Column, dot: str) -> Column:
    def div(a: Column, n: int) -> Column:
        return F.floor(a / F.lit(n)).cast("bigint")

    hours = div(t, 3_600_000)
    return F.format_string(
        f"%02d:%02d:%02d{dot}%03d", hours, div(t, 60_000) % 60, div(t, 1000) % 60, t % 1000
    )


def clock_centis(ms: Column | str) -> Column:
    """``H:MM:SS.cc`` with centiseconds rounded half up."""
    cs = F.floor((col(ms) + 5) / 10).cast("bigint")
    return F.format_string(
        "%d:%02d:%02d.%02d",
        F.floor(cs / 360_000).cast("bigint"),
        F.floor(cs / 6000).cast("bigint") % 60,
        F.floor(cs / 100).cast("bigint") % 60,
        cs % 100,
    )


def parse_clock(line: Column | str, first_group: int) -> Column:
    """Milliseconds from four consecutive groups of a cue's time line; ``,5`` means 5 ms."""
    parts = [
        F.regexp_extract(col(line), CUE_TIMES, first_group + i).cast("bigint") for i in range(4)
    ]
    return ((parts[0] * 60 + parts[1]) * 60 + parts[2]) * 1000 + parts[3]


# Fixed value: the time line of a subtitle cue.
CUE_TIMES = (
    "(\\d{1,2}):(\\d{1,2}):(\\d{1,2})[,.](\\d{1,3})\\s*-->\\s*"
    "(\\d{1,2}):(\\d{1,2}):(\\d{1,2})[,.](\\d{1,3})"
)


def has_numeral_style(
    ref: Column | str,
    base: Column | str,
    ref_pattern: str = SPOKEN_NUMERALS,
    base_pattern: str = WRITTEN_DIGITS,
) -> Column:
    """The reference spells a number while the baseline writes digits (both normalised)."""
    return col(ref).rlike(ref_pattern) & col(base).rlike(base_pattern)


def has_punct(c: Column | str, pattern: str = CJK_PUNCTUATION) -> Column:
    return col(c).rlike(pattern)


def cjk_count(c: Column | str) -> Column:
    return F.length(F.regexp_replace(col(c), "[^\\u4e00-\\u9fff]", ""))


def is_cjk_dominant(c: Column | str) -> Column:
    return cjk_count(c) >= F.greatest(F.lit(1.0), F.length(col(c)) * F.lit(0.3))


def effective_len(c: Column | str) -> Column:
    """Characters that are neither punctuation nor white space, at least one."""
    dropped = "(?U)[" + char_class(ALL_PUNCTUATION)[1:-1] + "\\s]"
    return F.greatest(F.lit(1), F.length(F.regexp_replace(col(c), dropped, "")))


def length_bucket(n: Column | str) -> Column:
    n = col(n)
    return F.when(n < 12, "<12").when(n <= 25, "12-25").otherwise(">25")


def recording_of(uid: Column | str) -> Column:
    """Second underscore field of an utterance id, first nine characters."""
    return F.substring(F.split_part(col(uid), F.lit("_"), F.lit(2)), 1, 9)


def clip(c: Column | str, limit: int) -> Column:
    """One-line preview: trimmed, newlines as spaces, cut with an ellipsis."""
    flat = F.replace(strip(F.coalesce(col(c), F.lit(""))), F.lit("\n"), F.lit(" "))
    cut = F.concat(F.substring(flat, 1, limit), F.lit("…"))
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def fingerprint(c: Column | str) -> Column:
    return F.substring(F.md5(col(c)), 1, 12)


def chunk_id(source: Column | str, digest: Column | str, chunk: Column | str) -> Column:
    return F.concat_ws("#", col(source), col(digest), col(chunk).cast("string"))


def parse_keywords(c: Column | str) -> Column:
    """Comma list (half or full width) to trimmed, non-empty, ordered distinct terms."""
    parts = F.split(F.replace(F.coalesce(col(c), F.lit("")), F.lit("，"), F.lit(",")), ",")
    return F.array_distinct(F.filter(F.transform(parts, strip), lambda t: t != ""))


def parse_hotwords(c: Column | str) -> Column:
    """Hot words separated by white space, commas, enumeration commas or semicolons."""
    parts = F.split(F.coalesce(col(c), F.lit("")), "(?U)[\\s,，、;；]+")
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def classify_error(c: Column | str) -> Column:
    """Ordered rules over an error message; anything else keeps its first 200 characters."""
    msg, low = col(c), F.lower(col(c))
    out = None
    for label, code, words in ERROR_CLASSES:
        rule = F.lit(False) if code is None else msg.contains(code)
        for w in words:
            rule = rule | low.contains(w)
        out = F.when(rule, label) if out is None else out.when(rule, label)
    return out.otherwise(F.concat(F.lit("other: "), F.substring(msg, 1, 200)))


def frames(duration_s: Column | str) -> Column:
    """Feature frames of a clip: 25 ms windows every 10 ms."""
    return (F.floor((col(duration_s) * 1000 - 25) / 10) + 1).cast("bigint")


def audio_tokens(n_frames: Column | str) -> Column:
    """Tokens left after three halvings of the frame count."""
    n = col(n_frames)
    for _ in range(2):
        n = F.lit(1) + F.floor((n - 1) / 2).cast("bigint")
    return (F.floor((n - 1) / 2) + 1).cast("bigint")


def token_seconds(frame: Column | str) -> Column:
    return col(frame) * F.lit(6) * F.lit(10) / F.lit(1000)


def repair_end(start: Column | str, end: Column | str, text: Column | str) -> Column:
    """A cue that does not advance lasts 200 ms per character, at least a second."""
    guess = col(start) + F.greatest(F.lit(1000), F.length(col(text)) * 200)
    return F.when(col(end) <= col(start), guess).otherwise(col(end))


def shift_start(start: Column | str, offset_ms: int) -> Column:
    return F.greatest(F.lit(0), F.coalesce(col(start), F.lit(0)) + offset_ms)


def shift_end(shifted_start: Column | str, end: Column | str, offset_ms: int) -> Column:
    end = F.coalesce(col(end), F.lit(0)) + offset_ms
    return F.greatest(col(shifted_start) + 200, end)


def speaker_label(spk: Column | str) -> Column:
    return F.concat(F.lit(SPEAKER_PREFIX), F.coalesce(col(spk).cast("string"), F.lit(UNKNOWN_SPEAKER)))


def media_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, whatever the session time zone."""
    ts = col(ts)
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    return (
        days.cast("bigint") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    ).cast("bigint")
