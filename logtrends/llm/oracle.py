"""SQL (DuckDB) for the registered queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

# the digest is 8 groups of 5 hexadecimal digits; 20 bits are 4 letters
op2 = f"""
WITH pages_ AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hashed AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h FROM pages_),
digested AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda i:
    array_to_string(list_transform([15, 10, 5, 0], lambda s:
      substr('{_BASE32}', (((('0x' || substr(h, CAST(5 * i + 1 AS INT), 5))::BIGINT >> s) & 31) + 1)::INT, 1)), '')), '') AS payload_digest
  FROM hashed),
first AS (SELECT payload_digest, min(page_id) AS response FROM digested GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN response IS NOT NULL AND response IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN response IS DISTINCT FROM page_id THEN response END AS refers_to
FROM digested JOIN first USING (payload_digest)
"""

op3 = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

op8 = f"""
WITH listed AS (SELECT doc_id, {_WORDS} AS w FROM documents),
placed AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM listed),
keyed AS (
  SELECT doc_id, p, word, CASE WHEN p + 19 <= n THEN
    string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS run FROM placed),
first AS (SELECT run, min({{'d': doc_id, 'p': p}}) AS src FROM keyed WHERE run IS NOT NULL GROUP BY run HAVING count(*) > 1),
told AS (SELECT k.doc_id, k.p, k.word, coalesce(src.d <> k.doc_id OR src.p <> k.p, false)::INT AS again FROM keyed k LEFT JOIN first USING (run)),
gone AS (SELECT doc_id, p, word, max(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM told),
kept AS (
  SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (gone = 0), '') AS kept
  FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""


def _spans(name: str, pattern: str, number: int) -> str:
    """Places of all matches of one kind: lengths of the pieces between them and of the matches, added up."""
    value = f"regexp_extract(m, '{pattern}', 2)" if name == "assign" else "m"
    return f"""
  SELECT row, owner, repository, kind, m, value, stop - length(m) AS start, stop FROM (
    SELECT row, owner, repository, {number} AS kind, m, {value} AS value,
      sum(length(gap) + length(m)) OVER (PARTITION BY row ORDER BY place) AS stop
    FROM (
      SELECT row, owner, repository, unnest(range(1, len(found) + 1)) AS place, unnest(found) AS m, unnest(gaps[1:len(found)]) AS gap FROM (
        SELECT row, owner, repository, regexp_extract_all(t, '{pattern}') AS found, regexp_split_to_array(t, '{pattern}') AS gaps FROM texts)))"""


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_PLACEHOLDER = "(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|abcdef|^0?123456|[^0-9]0?123456"

op11 = f"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, source AS owner, concat_ws('/', source, lang) AS repository, coalesce(text, '') AS t FROM documents),
every AS ({_spans("assign", _ASSIGN, 0)} UNION ALL {_spans("access", "AKIA[A-Z0-9]+", 1)} UNION ALL {_spans("hex", "[0-9a-f]+", 2)}
  UNION ALL {_spans("opaque", "[A-Za-z0-9+/_-]+", 3)}),
long AS (
  SELECT *, ['assign', 'access', 'hex', 'opaque'][kind + 1] AS name,
    regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(value, '{_PLACEHOLDER}')
      AND len(list_filter(range(1, length(value) - 3), lambda i: replace(substr(value, i, 5), substr(value, i, 1), '') = '')) = 0 AS looks,
    regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AS mixed
  FROM every WHERE length(value) >= [6, 20, 24, 20][kind + 1]),
clear AS (
  SELECT * FROM long o WHERE kind < 3 OR looks AND NOT EXISTS (
    SELECT 1 FROM long b WHERE b.row = o.row AND b.kind < 3 AND b.start < o.stop AND o.start < b.stop)),
held AS (
  SELECT value, count(DISTINCT coalesce('=' || owner, '')) AS n_owners, max(looks) AS looks, max(kind < 3) AS known FROM clear GROUP BY value),
judged AS (
  SELECT c.*, known, CASE WHEN n_owners >= 3 THEN 'example' WHEN n_owners > 1 THEN 'shared' WHEN h.looks THEN 'live' ELSE 'weak' END AS verdict
  FROM clear c JOIN held h USING (value)),
stays AS (SELECT *, concat_ws(':', name, start, stop) AS span FROM judged WHERE kind < 3 OR verdict = 'live' AND (mixed OR known)),
told AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans,
    count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'shared') AS n_shared, count(*) FILTER (verdict = 'example') AS n_example
  FROM stays GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(n_example, 0) AS n_example
FROM texts LEFT JOIN told USING (row)
"""

# the remainder of each byte value comes from eight steps of the shift register, the checksum of a word from one step per byte
op12 = r"""
WITH steps AS (
  SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS crc
  FROM (SELECT unnest(range(256)) AS b)),
cut AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS row, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, 0, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
words AS (SELECT side, row, unnest(w) AS word FROM cut),
counted AS (SELECT side, row, word, count(*) AS n FROM words GROUP BY ALL),
coded AS (
  SELECT word, xor(4294967295, list_reduce(
    list_transform(range(0, octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS INT), 2))::BIGINT),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295)) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM counted), steps),
shares AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM counted JOIN coded USING (word) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM shares),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM shares, sums),
weights AS (SELECT row, sum(n * gain)::BIGINT AS weight FROM counted JOIN coded USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
scored AS (
  SELECT id AS doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM cut LEFT JOIN weights USING (row) WHERE side = 'd'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM ranked
"""

op13 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS one, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS two,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS kind, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS form FROM cut),
parts AS (
  SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR kind >= 50 THEN 'plain'
      WHEN form < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(one, two)], '') AS p, array_to_string(u[least(one, two) + 1:greatest(one, two)], '') AS m,
    array_to_string(u[greatest(one, two) + 1:n], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

ORACLE = {
    "op2_warc_index": op2,
    "op3_norm_buckets": op3,
    "op8_repeated_spans": op8,
    "op11_owned_secrets": op11,
    "op12_importance_resampling": op12,
    "op13_fill_in_middle": op13,
}
