"""The queries that SQL can express, as SQL for DuckDB."""

from __future__ import annotations

from trailspark.llm.quality import STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

#: Measures and verdicts of the quality rules for the rows of `{docs}` (doc_id, text).
QUALITY = rf"""
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words
      AND word_chars / n_words BETWEEN 2 AND 14
      AND n_symbols / n_words <= 0.3
      AND n_capitals / n_words <= 0.5
      AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5)
      AND (n_words < 50 OR n_stops / n_words >= 0.01) AS kept
  FROM (
    SELECT doc_id, len(words)::BIGINT AS n_words,
      length(array_to_string(words, ''))::BIGINT AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      len(lines) AS n_lines,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      len(list_filter(words, lambda w: lower(w) IN ({_STOPS}))) AS n_stops,
      len(list_filter(words, lambda w: length(w) > 1 AND upper(w) = w AND lower(w) <> w)) AS n_capitals,
      coalesce(covered, 0)::BIGINT AS n_repeat_words
    FROM (
      SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
      FROM (SELECT doc_id, coalesce(text, '') AS text FROM {{docs}})
    )
    LEFT JOIN (
      SELECT doc_id, count(DISTINCT start + k) AS covered
      FROM (
        SELECT doc_id, start FROM (
          SELECT doc_id, start, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM (
            SELECT doc_id, start, array_to_string(words[start:start + 7], ' ') AS gram FROM (
              SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS start FROM (
                SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
                FROM {{docs}})))) WHERE n > 1
      ), (SELECT unnest(range(0, 8)) AS k)
      GROUP BY doc_id
    ) USING (doc_id)
  )
"""

#: Cut points as list positions of the units of a text; the parts by joining list slices.
FILL_MIDDLE = r"""
  SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
  FROM (
    SELECT doc_id, text, n, array_to_string(units[1:a], '') AS prefix,
      array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
        THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM (
      SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b
      FROM (
        SELECT doc_id, text, units, len(units)::BIGINT AS n, CAST('0x' || digest[1:8] AS BIGINT) AS h1,
          CAST('0x' || digest[9:16] AS BIGINT) AS h2, CAST('0x' || digest[17:24] AS BIGINT) AS h3,
          CAST('0x' || digest[25:32] AS BIGINT) AS h4
        FROM (
          SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
            regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
          FROM documents))))
"""

#: The records the archives should give back.
WARC = """
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32),
      lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((CAST('0x' || digest[10 * (k // 8) + 1:10 * (k // 8) + 10] AS BIGINT)
        >> (5 * (7 - k % 8))) & 31 AS BIGINT) + 1]), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
  FROM (
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS digest,
      min(page_id) OVER (PARTITION BY html) AS first
    FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))
"""

_ROUND = """
near{n} AS MATERIALIZED (
  SELECT row, min({{'d': list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))), 'j': j}}) AS near
  FROM vectors, centroids{n} GROUP BY row
)"""

_MOVE = """
means{m} AS MATERIALIZED (
  SELECT j, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c
  FROM (
    SELECT near.j AS j, i, sum(v[i])::HUGEINT AS total, count(*) AS n
    FROM near{n} JOIN vectors USING (row), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL
  ) GROUP BY j
), centroids{m} AS MATERIALIZED (
  SELECT j, coalesce(means{m}.c, centroids{n}.c) AS c FROM centroids{n} LEFT JOIN means{m} USING (j)
)"""


def _clusters(rounds: int) -> str:
    steps = [_ROUND.format(n=n) for n in range(rounds + 1)]
    moves = [_MOVE.format(n=n, m=n + 1) for n in range(rounds)]
    chain = ",".join(text for n in range(rounds + 1) for text in (steps[n], *moves[n : n + 1]))
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
    list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), centroids0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY digest, v) - 1 AS j, v AS c
  FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS digest, v FROM vectors ORDER BY digest, v LIMIT 40)
), {chain}
SELECT vec_id, CAST(near.j AS INTEGER) AS cluster, CAST(near.d AS BIGINT) AS distance,
  CAST(sum(near.d) OVER (PARTITION BY near.j) AS BIGINT) AS cluster_inertia, CAST(sum(near.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{rounds} JOIN vectors USING (row) JOIN centroids{rounds} ON centroids{rounds}.j = near.j"""


ORACLES = {
    "op9_quality_rules": QUALITY.format(docs="documents"),
    "op11_fill_middle": FILL_MIDDLE,
    "op12_warc": WARC,
    "op13_centroids": _clusters(5),
}
