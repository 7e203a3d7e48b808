"""Explicit schemas of the tables the jobs exchange."""

RESULTS = (
    "rec_id STRING, text STRING, "
    "sentence_info ARRAY<STRUCT<text: STRING, start: BIGINT, end: BIGINT, spk: STRING>>, "
    "timestamps ARRAY<STRUCT<token: STRING, start_time: DOUBLE, end_time: DOUBLE>>"
)
SEGMENTS = "rec_id STRING, seg_no INT, speaker STRING, text STRING, start_ms BIGINT, end_ms BIGINT"
CUES = "rec_id STRING, cue_no BIGINT, start_ms BIGINT, end_ms BIGINT, lines ARRAY<STRING>"
SAMPLES = (
    "messages ARRAY<STRUCT<role: STRING, content: STRING>>, "
    "speech_length BIGINT, text_length BIGINT"
)
REPORT = (
    "tag STRING, model STRING, n_sample BIGINT, "
    "conditions MAP<STRING, STRUCT<cer: DOUBLE, sent_acc: DOUBLE, n: BIGINT, sec: DOUBLE>>"
)
FRAGMENTS = "session_id STRING, seq BIGINT, ts TIMESTAMP, text STRING, is_final BOOLEAN"
