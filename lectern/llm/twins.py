"""DuckDB twins of the operators whose whole result SQL can state."""

from __future__ import annotations

from lectern.llm.decontaminate import WINDOW
from lectern.llm.quality_rules import MEASURES, MIN_GROUP, MIN_WORDS, REPEAT_PERCENT, SPREADS
from lectern.llm.substring_dedup import WINDOW as REPEAT_WINDOW

#: Rates per measure, as in ``quality_rules.rates``.
RATES = {
    "word_length": "100 * word_chars // greatest(n_words, 1)",
    "symbol_rate": "100 * n_symbols // greatest(n_words, 1)",
    "dup_line_rate": "100 * n_dup_lines // greatest(n_lines, 1)",
}


def quality_sql() -> str:
    """Counts by words and lines, quantile buckets per (language, source), language and all, limits, verdict."""
    entries = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM rated WHERE NOT base_failed" for m in RATES)
    level = """SELECT {keys}measure, max(total) AS n, min(bucket) FILTER (100 * upto >= 25 * total) AS q1,
        min(bucket) FILTER (100 * upto >= 75 * total) AS q3 FROM (
        SELECT {keys}measure, bucket, sum(count(*)) OVER (PARTITION BY {keys}measure ORDER BY bucket) AS upto,
        sum(count(*)) OVER (PARTITION BY {keys}measure) AS total FROM buckets GROUP BY {keys}measure, bucket)
        GROUP BY {keys}measure"""
    verdict, joins = [], []
    for m, (lower, least) in MEASURES.items():
        for name, on in (("a", "d.lang IS NOT DISTINCT FROM {t}.lang AND d.source IS NOT DISTINCT FROM {t}.source"),
                         ("b", "d.lang IS NOT DISTINCT FROM {t}.lang"), ("w", "true")):
            t = f"{name}_{m}"
            enough = "" if name == "w" else f" AND {t}.n >= {MIN_GROUP}"
            joins.append(f"LEFT JOIN level_{name} {t} ON {on.format(t=t)} AND {t}.measure = '{m}'{enough}")
        q1, q3 = (f"coalesce(a_{m}.{q}, b_{m}.{q}, w_{m}.{q})" for q in ("q1", "q3"))
        spread = f"{SPREADS} * greatest({q3} - {q1}, {least})"
        verdict.append(f"coalesce(d.{m} <= {q3} + {spread}, true)")
        if lower:
            verdict.append(f"coalesce(d.{m} >= {q1} - {spread}, true)")
    return rf"""
    WITH given AS (
        SELECT row_number() OVER () AS row_no, doc_id, lang, source, coalesce(text, '') AS text FROM documents
    ), words AS (
        SELECT row_no, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM given
    ), windows AS (
        SELECT row_no, i, array_to_string(w[i : i + 4], ' ') AS gram
        FROM (SELECT row_no, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
    ), twice AS (
        SELECT row_no, i FROM windows QUALIFY count(*) OVER (PARTITION BY row_no, gram) > 1
    ), repeated AS (
        SELECT row_no, count(DISTINCT pos) AS n_repeat_words
        FROM (SELECT row_no, unnest(range(i, i + 5)) AS pos FROM twice) GROUP BY row_no
    ), lines AS (
        SELECT row_no, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
        FROM (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM given)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_no
    ), counted AS (
        SELECT g.doc_id, g.lang, g.source, len(w)::BIGINT AS n_words,
            length(array_to_string(w, ''))::BIGINT AS word_chars,
            length(regexp_replace(g.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
            coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
            coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
        FROM given g JOIN words USING (row_no) LEFT JOIN repeated USING (row_no) LEFT JOIN lines USING (row_no)
    ), rated AS (
        SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
            {", ".join(f"{x} AS {m}" for m, x in RATES.items())}
        FROM counted
    ), buckets AS (
        SELECT lang, source, measure, v - v % (1::BIGINT << greatest(length(ltrim(bin(v), '0')) - 7, 0)::INT) AS bucket
        FROM ({entries})
    ), level_a AS ({level.format(keys="lang, source, ")}
    ), level_b AS ({level.format(keys="lang, ")}
    ), level_w AS ({level.format(keys="")})
    SELECT d.doc_id, d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed,
        NOT d.base_failed AND {" AND ".join(verdict)} AS kept
    FROM rated d {" ".join(joins)}"""


def decontaminate_sql() -> str:
    """Windows of the items joined with windows of the same length in the documents."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
    WITH docs AS (
        SELECT row_number() OVER () AS row_no, doc_id, {words} AS w FROM documents
    ), items AS (
        SELECT item_id, w, least(len(w), {WINDOW}) AS size FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0
    ), wanted AS (
        SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS gram
        FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM items)
    ), places AS (
        SELECT row_no, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram
        FROM (SELECT row_no, w, size, unnest(range(1, len(w) - size + 2)) AS i
              FROM docs, (SELECT DISTINCT size FROM items) WHERE len(w) >= size)
    ), hits AS (
        SELECT row_no, i, size, item_id FROM places JOIN wanted USING (size, gram)
    ), covered AS (
        SELECT row_no, count(DISTINCT pos) AS n_hit
        FROM (SELECT row_no, unnest(range(i, i + size)) AS pos FROM (SELECT DISTINCT row_no, i, size FROM hits)) GROUP BY row_no
    ), found AS (
        SELECT row_no, count(*) AS n_items, string_agg(coalesce(item_id::VARCHAR, 'null'), ',' ORDER BY coalesce(item_id::VARCHAR, 'null')) AS ids
        FROM (SELECT DISTINCT row_no, item_id FROM hits) GROUP BY row_no
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN covered USING (row_no) LEFT JOIN found USING (row_no)"""


def substring_sql() -> str:
    """Every window that occurs twice covers its words; the others are kept."""
    return rf"""
    WITH given AS (
        SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), windows AS (
        SELECT row_no, i, md5(array_to_string(w[i : i + {REPEAT_WINDOW - 1}], ' ')) AS name
        FROM (SELECT row_no, w, unnest(range(1, len(w) - {REPEAT_WINDOW - 2})) AS i FROM given WHERE len(w) >= {REPEAT_WINDOW})
    ), twice AS (
        SELECT row_no, i FROM windows QUALIFY count(*) OVER (PARTITION BY name) > 1
    ), gone AS (
        SELECT DISTINCT row_no, unnest(range(i, i + {REPEAT_WINDOW})) AS k FROM twice
    ), words AS (
        SELECT row_no, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM given
    ), kept AS (
        SELECT row_no, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN gone USING (row_no, k) GROUP BY row_no
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM given LEFT JOIN kept USING (row_no)
    """


def fixity_sql() -> str:
    """Records of the pages, their places and hashes, and the damage that the query does to its replica.

    Page ids are unique, as in the given tables, and a page ends in a character of one byte.
    """
    # CRC-32 over the characters of a short ASCII string: each is added to the register, which then takes eight steps.
    crc32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[unicode(k)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]
 FOR k IN string_split({0}, '')])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END))"""
    return rf"""WITH r AS (SELECT page_id, concat('pages-', page_id // 1000, '.warc') AS archive, concat(E'WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:',
 page_id, E'>\r\nWARC-Target-URI: ', url, E'\r\nContent-Type: text/html\r\nContent-Length: ', strlen(coalesce(html, '')), E'\r\n\r\n', html, E'\r\n\r\n') AS record FROM pages),
p AS (SELECT *, strlen(record) AS n_bytes, (sum(strlen(record)) OVER (PARTITION BY archive ORDER BY page_id) - strlen(record))::BIGINT AS "offset",
 {crc32.format('archive')} % 5 = 0 AND page_id % 1000 >= 900 AS gone, {crc32.format('page_id::VARCHAR')} % 50 = 7 AS flipped FROM r),
q AS (SELECT *, CASE WHEN flipped THEN concat(substring(record, 1, length(record) - 5), '?', substring(record, length(record) - 3, 4)) ELSE record END AS other FROM p)
SELECT archive, "offset", n_bytes, CASE WHEN gone THEN 'missing' ELSE 'changed' END AS problem, sha256('\x00'::BLOB || encode(record)) AS hash_a,
 CASE WHEN NOT gone THEN sha256('\x00'::BLOB || encode(other)) END AS hash_b, page_id FROM q WHERE gone OR record <> other"""
