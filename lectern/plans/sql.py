"""SQL fragments shared by the DuckDB twins."""

# The SQL engine measures edit distance in bytes, so letters with accents are mapped one to one
# to capitals, which lower-cased text no longer holds.
NORM_CLASS = r"""[。？！，、；：.,?!;:·\-—_"''“”‘’（）()\[\]【】<>《》~`|/\\\s]"""


def norm(x: str) -> str:
    return f"lower(regexp_replace({x}, '{NORM_CLASS}', '', 'g'))"


def bytes_safe(x: str) -> str:
    return f"translate({x}, 'àâáäçéèêëíîïñóôöùúûüßœæ', 'ABCDEFGHIJKLMNOPQRSTUVW')"


def edits(a: str, b: str) -> str:
    return f"levenshtein({bytes_safe(a)}, {bytes_safe(b)})"


SENTENCES = r"""
_u AS (SELECT doc_id, source, lang, regexp_split_to_array(text, '[.!?\n]') AS p FROM documents),
_s AS (SELECT doc_id, source, lang, i AS sent_no, trim(p[i + 1]) AS s
       FROM (SELECT *, unnest(range(0, len(p))) AS i FROM _u)),
_p AS (SELECT *, unnest(range(0, (length(s) - 1) // 400 + 1)) AS piece FROM _s WHERE s <> ''),
sent AS (SELECT concat_ws('_', source, doc_id, sent_no, piece) AS uid, doc_id, source, lang, sent_no,
                piece, substring(s, (piece * 400 + 1)::INT, 400) AS text FROM _p)
"""

WHOLE_SENTENCES = r"""
_u AS (SELECT doc_id, source, lang, regexp_split_to_array(text, '[.!?\n]') AS p FROM documents),
_s AS (SELECT doc_id, source, lang, i AS sent_no, trim(p[i + 1]) AS text
       FROM (SELECT *, unnest(range(0, len(p))) AS i FROM _u)),
sent AS (SELECT concat_ws('_', source, doc_id, sent_no) AS uid, doc_id, source, lang, sent_no, text FROM _s WHERE text <> '')
"""

SYSTEM_A = "replace(text, 'tion', 'shun')"
SYSTEM_B = "replace(replace(text, 'tion', 'shun'), 'th', 'd')"
DECODED = "doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"


def under(condition: str, x: str) -> str:
    return {
        "clean": x,
        "slow": f"substring({x}, 1, greatest(0, length({x}) - 1)::INT)",
        "fast": f"replace({x}, ' ', '')",
        "pitch": f"replace({x}, 'e', 'i')",
        "noise": f"replace({x}, 's', '')",
    }[condition]


CONDITIONS = ["clean", "slow", "fast", "pitch", "noise"]
_HYPS = " UNION ALL ".join(
    f"SELECT uid, '{s}' AS system, '{c}' AS condition, {under(c, x)} AS hyp, text FROM sent WHERE {DECODED}"
    for s, x in (("a", SYSTEM_A), ("b", SYSTEM_B))
    for c in CONDITIONS
)
SCORED = f"""{SENTENCES},
_n AS (SELECT uid, system, condition, {norm('text')} AS r, {norm('hyp')} AS h FROM ({_HYPS})),
scored AS (SELECT uid, system, condition, {edits('r', 'h')} AS errors, length(r) AS ref_len, r = h AS exact
           FROM _n),
_rl AS (SELECT length({norm('text')}) AS n FROM sent),
totals AS (SELECT count(*) AS n_ref, sum(n) AS len_ref, sum(greatest(1, n)) AS len_floor,
                  count(*) FILTER (n = 0) AS empty_ref FROM _rl)
"""

PAIRS = f"""{SENTENCES},
_n AS (SELECT *, {norm('text')} AS r, {norm(SYSTEM_A)} AS h_a, {norm(SYSTEM_B)} AS h_b
       FROM sent WHERE {DECODED}),
pairs AS (SELECT uid, doc_id, source, lang, sent_no, piece, r, h_a, h_b, {edits('r', 'h_a')} AS errors_a,
                 {edits('r', 'h_b')} AS errors_b, length(r) AS ref_len FROM _n)
"""

CUES = """
cues AS (SELECT user_id AS rec_id, event_id AS cue_no, epoch_us(ts) // 1000000 - 1704067200 AS start_ms,
                epoch_us(ts) // 1000000 - 1704067200 + floor(round(value * 100, 4))::BIGINT AS end_ms,
                event_type AS text FROM events)
"""


def by_class(sums: str, extra: str = "") -> str:
    """Projection of change measures from errors_a, errors_b and ref_len sums."""
    return f"""
SELECT {extra} n, errors_a, errors_b, ref_len, errors_a / greatest(1, ref_len) AS cer_a,
       errors_b / greatest(1, ref_len) AS cer_b,
       errors_b / greatest(1, ref_len) - errors_a / greatest(1, ref_len) AS delta,
       CASE WHEN errors_a = 0 THEN 0.0
            ELSE (errors_b / greatest(1, ref_len) - errors_a / greatest(1, ref_len))
                 / (errors_a / greatest(1, ref_len)) * 100 END AS relative_pct
FROM ({sums})"""


SUMS = "count(*) AS n, sum(errors_a)::BIGINT AS errors_a, sum(errors_b)::BIGINT AS errors_b, sum(ref_len)::BIGINT AS ref_len"
