"""The registered queries as SQL on the same tables."""

from __future__ import annotations

from logtrends.functions.keywords import STOP_WORDS
from logtrends.functions.text import VARIABLE, VERBS
from logtrends.plans.analysis import SWEEP


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(_quote(w) for w in words) + ")"


BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
MICROS = "'%Y-%m-%d %H:%M:%S.%f'"
MINUTE = "'%Y-%m-%d-%H-%M'"
ESCAPE = r"regexp_replace({}, '([^\p{{L}}\p{{N}} ])', '\\\1', 'g')"

UNESCAPE = r"regexp_replace(replace(x, chr(1), '\*'), '\\(.)', '\1', 'g')"

# -- lines of documents ---------------------------------------------------------------------

DOC_ALL = """
doc_all AS (
  SELECT CAST(doc_id AS VARCHAR) AS log_id, unnest(generate_series(1, len(parts))) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
)"""
DOCS = DOC_ALL + f""",
doc_lines AS (
  SELECT log_id, line_no, trim(line, {BLANKS}) AS line FROM doc_all WHERE trim(line, {BLANKS}) <> ''
),
tok AS (SELECT log_id, line_no, line, string_split_regex(line, ' +') AS t FROM doc_lines)"""
SHAPES = DOCS + f""",
masked AS (
  SELECT *, list_transform(t, lambda x: CASE WHEN regexp_full_match(x, {_quote('(?i)(?:' + VARIABLE + ')')}) THEN '<*>' ELSE x END) AS m
  FROM tok
),
shaped AS (
  SELECT log_id, line_no, line, t, array_to_string(list_filter(m, lambda x, i: x <> '<*>' OR i = 1 OR m[i - 1] <> '<*>'), ' ') AS shape,
    array_to_string(list_filter(list_transform(t, lambda x, i: CASE WHEN lower(x) IN {_in(VERBS)}
      THEN x || '@' || CAST(i - 1 AS VARCHAR) ELSE '' END), lambda x: x <> ''), ' ') AS verb_key
  FROM masked
)"""

# -- lines of events ------------------------------------------------------------------------

EVENTS = r"""
ev AS (
  SELECT *, CAST(regexp_extract(props, '"k": ?(-?[0-9]+)', 1) AS BIGINT) AS k FROM events
),
lines AS (
  SELECT CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS log_id, ts,
    row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS line_no,
    event_type || ' k ' || CAST(k AS VARCHAR) AS line
  FROM ev
)"""
TEMPLATES = EVENTS + """,
tpl AS (
  SELECT event_type || ' *' AS pattern, '^(?:' || event_type || ' .+)' AS regex,
    row_number() OVER (ORDER BY event_type) - 1 AS template_id
  FROM (SELECT DISTINCT event_type FROM events)
),
assigned AS (
  SELECT log_id, line_no, line, template_id FROM lines JOIN tpl ON regexp_matches(line, regex)
)"""
RICH = EVENTS + """,
raw AS (
  SELECT '*' AS pattern, '^(?:.+)' AS regex, 0 AS n_literals
  UNION ALL
  SELECT DISTINCT event_type || ' *', '^(?:' || event_type || ' .+)', 1 FROM events
  UNION ALL
  SELECT DISTINCT event_type || ' k ' || CAST(d AS VARCHAR) || '*', '^(?:' || event_type || ' k ' || CAST(d AS VARCHAR) || '.+)', 3
  FROM events CROSS JOIN generate_series(0, 9) AS g(d)
),
tpl AS (SELECT *, row_number() OVER (ORDER BY pattern) - 1 AS template_id FROM raw),
hits AS (SELECT log_id, line_no, template_id, n_literals FROM lines JOIN tpl ON regexp_matches(line, regex))"""
GRAPHS = TEMPLATES + """,
vec AS (SELECT log_id, list_sort(list(DISTINCT template_id)) AS ids FROM assigned GROUP BY log_id),
steps AS (
  SELECT log_id, line_no, template_id AS src, lead(template_id) OVER (PARTITION BY log_id ORDER BY line_no) AS dst FROM assigned
),
edges AS (
  SELECT log_id, src, dst, min(line_no) AS first_pos, count(*) AS n FROM steps WHERE dst IS NOT NULL GROUP BY ALL
)"""
DAYS = GRAPHS + """,
days AS (
  SELECT log_id, string_split(log_id, '/')[2] AS cluster_id,
    min(log_id) OVER (PARTITION BY string_split(log_id, '/')[2]) AS medoid_log_id
  FROM vec
)"""
DIFF = "(len({a}) + len({b}) - 2 * len(list_intersect({a}, {b})))"


def _diff(a: str, b: str) -> str:
    return DIFF.format(a=a, b=b)


# At a threshold below 1 a cluster is a group of equal vectors.
CLUSTERS = GRAPHS + """,
clusters AS (
  SELECT log_id, min(log_id) OVER (PARTITION BY ids) AS cluster_id, count(*) OVER (PARTITION BY ids) AS size FROM vec
)"""


def _nearest(items: str) -> str:
    return CLUSTERS + f""",
items AS ({items}),
graph AS (
  SELECT cluster_id, log_id, coalesce(s, []) AS s
  FROM clusters LEFT JOIN (SELECT log_id, list_sort(list(item)) AS s FROM items GROUP BY log_id) USING (log_id)
),
sets AS (SELECT cluster_id, s, count(*) AS weight FROM graph GROUP BY ALL),
apart AS (
  SELECT a.cluster_id, a.s, min({_diff('a.s', 'b.s')}) AS d
  FROM sets a JOIN sets b ON a.cluster_id = b.cluster_id AND a.s <> b.s GROUP BY ALL
),
nn AS (
  SELECT g.cluster_id, g.log_id, CASE WHEN weight > 1 THEN 0 ELSE d END AS nn
  FROM graph g JOIN sets USING (cluster_id, s) LEFT JOIN apart USING (cluster_id, s)
  WHERE weight > 1 OR d IS NOT NULL
)"""


NEAREST = _nearest("SELECT log_id, CAST(src * 1000 + dst AS BIGINT) AS item FROM edges")
NEAREST_DEGREE = _nearest(
    "SELECT log_id, CAST(src * 1000 + unnest(range(count(*))) AS BIGINT) AS item FROM edges GROUP BY log_id, src"
)


def _outliers(small: int) -> str:
    return NEAREST + f""",
sent AS (SELECT * FROM nn SEMI JOIN (SELECT * FROM clusters WHERE size > {small}) c USING (log_id)),
sums AS (
  SELECT cluster_id, CAST(count(*) AS HUGEINT) AS n, CAST(sum(nn) AS HUGEINT) AS s, CAST(sum(nn * nn) AS HUGEINT) AS q
  FROM sent GROUP BY cluster_id
),
outliers AS (
  SELECT cluster_id, log_id, nn FROM sent JOIN sums USING (cluster_id)
  WHERE n * nn - s > 2 * sqrt(CAST(n * q - s * s AS DOUBLE))
)"""


OUTLIERS = _outliers(4)
MISSING = OUTLIERS + """,
missing AS (
  SELECT o.log_id, e.src, e.dst FROM outliers o JOIN edges e ON e.log_id = o.log_id
  WHERE NOT EXISTS (SELECT 1 FROM edges b WHERE b.log_id = o.cluster_id AND b.src = e.src AND b.dst = e.dst)
),
dvec AS (
  SELECT log_id, list_sort(list(DISTINCT v)) AS ids
  FROM (SELECT log_id, src AS v FROM missing UNION ALL SELECT log_id, dst FROM missing) GROUP BY log_id
),
dclusters AS (
  SELECT min(log_id) OVER (PARTITION BY ids) AS cluster_id, log_id, count(*) OVER (PARTITION BY ids) AS size FROM dvec
)"""

# The same with the rich templates, whose transitions make long paths, and clusters of up to 60 logs compared with every baseline.
RICH_GRAPHS = RICH + """,
assigned AS (SELECT log_id, line_no, arg_min(template_id, (-n_literals) * 1000 + template_id) AS template_id FROM hits GROUP BY log_id, line_no),
vec AS (SELECT log_id, list_sort(list(DISTINCT template_id)) AS ids FROM hits GROUP BY log_id),
""" + GRAPHS[GRAPHS.index("steps AS ("):]
RICH_MISSING = _outliers(60).replace(GRAPHS, RICH_GRAPHS) + """,
normal AS (SELECT DISTINCT src, dst FROM edges WHERE log_id IN (SELECT cluster_id FROM clusters WHERE size > 60)),
rmissing AS (
  SELECT o.log_id, e.src, e.dst FROM outliers o JOIN edges e ON e.log_id = o.log_id
  WHERE NOT EXISTS (SELECT 1 FROM edges b WHERE b.log_id = o.cluster_id AND b.src = e.src AND b.dst = e.dst)
  UNION ALL
  SELECT e.log_id, e.src, e.dst FROM clusters c JOIN edges e ON e.log_id = c.log_id
  WHERE size <= 60 AND NOT EXISTS (SELECT 1 FROM normal n WHERE n.src = e.src AND n.dst = e.dst)
)"""

# -- posts ----------------------------------------------------------------------------------

POSTS = r"""
pe AS (
  SELECT e.*, d.text AS body, CAST(regexp_extract(props, '"k": ?(-?[0-9]+)', 1) AS BIGINT) AS k,
    event_id % 4 AS t, CAST(floor(value) AS BIGINT) AS units
  FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)
),
p AS (
  SELECT event_id AS post_id, ts, k, user_id,
    CASE WHEN t = 0 THEN 'reddit' WHEN t = 1 THEN 'twitter' WHEN t = 2 THEN 'meetup' WHEN event_id % 8 = 3 THEN 'unknown' END AS type,
    CASE WHEN t = 0 THEN body END AS title,
    CASE WHEN t = 0 AND k % 10 <> 0 THEN units END AS score,
    CASE WHEN t = 0 THEN k END AS num_comments,
    CASE WHEN t = 1 AND k % 11 <> 0 THEN body END AS text,
    CASE WHEN t = 1 THEN k END AS retweet_count,
    CASE WHEN t = 1 THEN units END AS favorite_count,
    CASE WHEN t = 1 AND k % 9 <> 0 THEN k % 7 END AS reply_count,
    CASE WHEN t = 2 THEN string_split(body, chr(10))[1] END AS name,
    CASE WHEN t = 2 AND strpos(body, chr(10)) > 0 THEN substr(body, strpos(body, chr(10)) + 1) END AS description,
    t = 2 AND k % 2 <> 0 AS at_venue
  FROM pe
)"""


def _keywords(text: str) -> str:
    words = rf"string_split_regex(trim(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}} ]+', ' | ', 'g')), ' +')"
    marked = f"list_transform({words}, lambda w: CASE WHEN w IN {_in(STOP_WORDS)} THEN '|' ELSE w END)"
    return f"list_filter(list_transform(string_split(array_to_string({marked}, ' '), '|'), lambda x: trim(x)), lambda x: x <> '')"


MEETUPS = """
m AS (
  SELECT *, 'City ' || CAST(user_id % 10 AS VARCHAR) AS city, 'Country ' || CAST(user_id % 3 AS VARCHAR) AS country,
    CASE WHEN (at_venue AND k % 4 <> 0) OR (NOT at_venue AND k % 5 <> 0) THEN 'State ' || CAST(k % 7 AS VARCHAR) ELSE 'None' END AS state,
    CASE WHEN at_venue THEN 'Hall ' || CAST(k AS VARCHAR) || ', Street ' || CAST(user_id AS VARCHAR)
      || CASE WHEN k % 3 = 0 THEN ', Floor 2' ELSE '' END ELSE 'None' END AS venue_text,
    CASE WHEN k % 3 <> 0 THEN 'cat' || CAST(k % 6 AS VARCHAR) ELSE 'None' END AS category
  FROM p WHERE type = 'meetup'
)"""
REDDIT = POSTS + f""",
rk AS (SELECT ts, score, num_comments, unnest({_keywords('title')}) AS keyword FROM p WHERE type = 'reddit'),
rm AS (
  SELECT date_trunc('minute', ts) AS minute, keyword, CAST(sum(num_comments) AS BIGINT) AS num_comments, CAST(sum(score) AS BIGINT) AS score
  FROM rk GROUP BY ALL
)"""
_TWITTER = f"""
tk AS (
  SELECT ts, retweet_count, favorite_count, reply_count, unnest({_keywords('text')}) AS keyword FROM p
  WHERE type = 'twitter' AND text IS NOT NULL
),
tm AS (
  SELECT date_trunc('minute', ts) AS minute, keyword, CAST(sum(retweet_count) AS BIGINT) AS retweets,
    CAST(sum(favorite_count) AS BIGINT) AS favorites, CAST(sum(reply_count) AS BIGINT) AS replies
  FROM tk GROUP BY ALL
)"""
TWITTER = POSTS + "," + _TWITTER


def _scores(merged: str) -> str:
    return REDDIT + "," + _TWITTER + f""",
newest AS (SELECT max(ts) AS as_of FROM events),
both_sources AS (
  SELECT minute, keyword, 1 AS prio, CASE WHEN num_comments IS NULL OR score IS NULL THEN 0
    ELSE CAST(trunc(CAST(0.2 AS DOUBLE) * num_comments + CAST(0.8 AS DOUBLE) * score) AS BIGINT) END AS score FROM rm
  UNION ALL
  SELECT minute, keyword, 2, CASE WHEN replies IS NULL OR retweets IS NULL OR favorites IS NULL THEN 0
    ELSE CAST(trunc(CAST(0.2 AS DOUBLE) * replies + CAST(0.5 AS DOUBLE) * retweets + CAST(0.3 AS DOUBLE) * favorites) AS BIGINT) END FROM tm
),
ms AS (
  SELECT minute, keyword, CAST({merged} AS BIGINT) AS score FROM both_sources, newest
  WHERE minute < date_trunc('minute', as_of) GROUP BY ALL
)"""


SCORES = _scores("max_by(score, prio)")
SCORES_SUM = _scores("sum(score)")


def _trend(period: str, shown: str) -> str:
    return f"""WITH {SCORES},
totals AS (SELECT {period} AS period, keyword, CAST(sum(score) AS BIGINT) AS score FROM ms GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY score DESC, keyword) AS rank FROM totals)
SELECT keyword, strftime(period, {shown}) AS period, score, rank FROM ranked WHERE rank <= 10"""


ORACLE: dict[str, str] = {
    "log_lines": f"WITH {DOCS} SELECT log_id, line_no, line FROM doc_lines",
    "infer_then_match": f"WITH {DOCS} SELECT log_id, line_no, line FROM doc_lines",
    "recent_lines": f"""WITH {EVENTS} SELECT log_id, line_no, line, strftime(ts, {MICROS}) AS ts FROM lines
        WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""",
    "chunk_lines": f"""WITH {DOC_ALL} SELECT log_id, line_no,
        (row_number() OVER (ORDER BY log_id, line_no) - 1) // 200 AS chunk_id FROM doc_all""",
    "chunk_lines_per_log": f"WITH {DOC_ALL} SELECT log_id, line_no, (line_no - 1) // 5 AS chunk_id FROM doc_all",
    "drop_lines_with": f"WITH {DOC_ALL} SELECT log_id, line_no, line FROM doc_all WHERE NOT contains(line, 'the')",
    "logs_with": f"WITH {DOC_ALL} SELECT DISTINCT log_id FROM doc_all WHERE contains(line, 'the')",
    "tokens": f"WITH {DOCS} SELECT log_id, line_no, len(t) AS n_tokens, array_to_string(t, '|') AS tokens FROM tok",
    "mask_lines": f"WITH {SHAPES} SELECT log_id, line_no, shape FROM shaped",
    "verb_key": f"WITH {SHAPES} SELECT log_id, line_no, verb_key FROM shaped",
    "shape_groups": f"""WITH {SHAPES} SELECT verb_key, count(DISTINCT shape) AS n_shapes, count(*) AS n_lines, min(shape) AS example
        FROM shaped GROUP BY verb_key""",
    "compile_templates": f"""WITH {SHAPES},
        pat AS (SELECT DISTINCT array_to_string(list_transform(string_split(shape, ' '),
          lambda x: CASE WHEN x = '<*>' THEN '*' ELSE {ESCAPE.format('x')} END), ' ') AS pattern FROM shaped),
        cut AS (SELECT pattern, list_transform(string_split(replace(pattern, '\\*', chr(1)), '*'),
          lambda x: {ESCAPE.format(UNESCAPE)}) AS pieces FROM pat)
        SELECT pattern, len(list_filter(string_split(pattern, ' '), lambda x: x <> '*' AND x <> '')) AS n_literals,
          '(?s)^(?:' || pieces[1] || array_to_string(list_transform(pieces[2:],
            lambda x: CASE WHEN x = '' THEN '.' ELSE '(?>.+?' || x || ')' END), '') || ')' AS regex
        FROM cut""",
    "templates_roundtrip": f"WITH {RICH} SELECT template_id, pattern, n_literals FROM tpl",
    "match_all": f"WITH {RICH} SELECT log_id, line_no, template_id FROM hits",
    "assign_template": f"""WITH {RICH} SELECT log_id, line_no, arg_min(template_id, (-n_literals) * 1000 + template_id) AS template_id
        FROM hits GROUP BY log_id, line_no""",
    "assign_first": f"WITH {RICH} SELECT log_id, line_no, min(template_id) AS template_id FROM hits GROUP BY ALL",
    "assign_last": f"WITH {RICH} SELECT log_id, line_no, max(template_id) AS template_id FROM hits GROUP BY ALL",
    "unmatched_lines": f"""WITH {TEMPLATES} SELECT log_id, line_no, line FROM lines l
        WHERE NOT EXISTS (SELECT 1 FROM tpl WHERE pattern <> 'signup *' AND regexp_matches(l.line, regex))""",
    "mav": f"WITH {GRAPHS} SELECT log_id, array_to_string(ids, ',') AS template_ids FROM vec",
    "mav_distance": f"""WITH {DAYS} SELECT cluster_id, d.log_id, medoid_log_id, {_diff('a.ids', 'b.ids')} AS distance
        FROM days d JOIN vec a ON a.log_id = d.log_id JOIN vec b ON b.log_id = medoid_log_id""",
    "cluster_diameter": f"""WITH {DAYS}, v AS (SELECT DISTINCT cluster_id, ids FROM days JOIN vec USING (log_id))
        SELECT a.cluster_id, max({_diff('a.ids', 'b.ids')}) AS diameter FROM v a JOIN v b ON a.cluster_id = b.cluster_id GROUP BY ALL""",
    "mfg_nodes": f"WITH {GRAPHS} SELECT log_id, template_id, min(line_no) AS first_pos FROM assigned GROUP BY ALL",
    "mfg_edges": f"WITH {GRAPHS} SELECT log_id, src, dst, first_pos, n FROM edges",
    "out_degree": f"WITH {GRAPHS} SELECT log_id, src, count(*) AS degree FROM edges GROUP BY ALL",
    "graph_distance": f"""WITH {DAYS},
        g AS (SELECT v.log_id, coalesce(s, []) AS s FROM vec v LEFT JOIN
          (SELECT log_id, list(src * 1000 + dst) AS s FROM edges GROUP BY log_id) e ON e.log_id = v.log_id)
        SELECT d.log_id, medoid_log_id AS baseline_log_id, {_diff('a.s', 'b.s')} AS distance
        FROM days d JOIN g a ON a.log_id = d.log_id JOIN g b ON b.log_id = medoid_log_id""",
    "clusters_at": f"""WITH {CLUSTERS} SELECT CAST(0.5 AS DOUBLE) AS threshold, cluster_id, log_id, cluster_id AS medoid_log_id,
        CAST(0 AS BIGINT) AS diameter FROM clusters""",
    "cluster_verdict": f"""WITH {CLUSTERS} SELECT cluster_id, log_id, size, CASE WHEN size <= 60 THEN 'AA' ELSE 'MFG' END AS verdict
        FROM clusters""",
    "nn_distance": f"WITH {NEAREST} SELECT cluster_id, log_id, nn FROM nn",
    "nn_distance_out_degree": f"WITH {NEAREST_DEGREE} SELECT cluster_id, log_id, nn FROM nn",
    "mfg_outliers": f"WITH {_outliers(0)} SELECT cluster_id, log_id, nn FROM outliers",
    "difflog_edges": f"WITH {MISSING} SELECT log_id, src, dst FROM missing",
    "difflog_edges_all": f"""WITH {CLUSTERS},
        normal AS (SELECT DISTINCT src, dst FROM edges WHERE log_id IN (SELECT cluster_id FROM clusters WHERE size > 60))
        SELECT e.log_id, e.src, e.dst FROM clusters c JOIN edges e ON e.log_id = c.log_id
        WHERE size <= 60 AND NOT EXISTS (SELECT 1 FROM normal n WHERE n.src = e.src AND n.dst = e.dst)""",
    "difflog_mav": f"WITH {MISSING} SELECT log_id, array_to_string(ids, ',') AS template_ids FROM dvec",
    "difflog_clusters": f"WITH {MISSING} SELECT cluster_id, log_id, size FROM dclusters",
    "common_edges": f"""WITH {MISSING} SELECT cluster_id, src, dst, count(*) AS n_logs
        FROM dclusters d JOIN missing m ON m.log_id = d.log_id GROUP BY cluster_id, src, dst HAVING count(*) = max(size)""",
    "pattern_matches": f"""WITH {MISSING},
        o AS (SELECT log_id, line_no, template_id, row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS pos FROM assigned),
        pairs AS (SELECT DISTINCT src, dst FROM missing),
        two AS (SELECT a.log_id, a.template_id AS x, b.template_id AS y, a.line_no AS start_line, b.line_no AS end_line, b.pos
          FROM o a JOIN o b ON b.log_id = a.log_id AND b.pos = a.pos + 1 JOIN pairs ON src = a.template_id AND dst = b.template_id)
        SELECT CAST(x AS VARCHAR) || '>' || CAST(y AS VARCHAR) AS pattern_id, log_id, start_line, end_line, 2 AS n_lines FROM two
        UNION ALL
        SELECT CAST(x AS VARCHAR) || '>' || CAST(y AS VARCHAR) || '>' || CAST(x AS VARCHAR), t.log_id, start_line, c.line_no, 3
        FROM two t JOIN o c ON c.log_id = t.log_id AND c.pos = t.pos + 1 AND c.template_id = x""",
    "detection_counts": f"""WITH {_outliers(60)},
        found AS (SELECT log_id FROM outliers UNION ALL SELECT log_id FROM clusters WHERE size <= 60),
        bad AS (SELECT DISTINCT log_id FROM lines WHERE contains(line, 'error'))
        SELECT threshold, count(*) FILTER (bad.log_id IS NOT NULL) AS true_positive, count(*) FILTER (bad.log_id IS NULL) AS false_positive
        FROM (SELECT unnest([{', '.join(f'CAST({t} AS DOUBLE)' for t in SWEEP if t < 1)}]) AS threshold), found
        LEFT JOIN bad ON bad.log_id = found.log_id GROUP BY threshold""",
    "posts": f"""WITH {POSTS}, {MEETUPS} SELECT p.post_id, strftime(p.ts, {MICROS}) AS ts, p.type, p.title, p.score, p.num_comments, p.text,
        p.retweet_count, p.favorite_count, p.reply_count, p.name, p.description,
        CASE WHEN p.at_venue THEN 'Hall ' || CAST(p.k AS VARCHAR) END AS venue_name,
        CASE WHEN p.at_venue AND p.k % 4 <> 0 THEN 'State ' || CAST(p.k % 7 AS VARCHAR) END AS venue_state,
        CASE WHEN p.at_venue AND p.k % 3 = 0 THEN ', Floor 2' END AS venue_address_2,
        CASE WHEN p.type = 'meetup' THEN 'City ' || CAST(p.user_id % 10 AS VARCHAR) END AS group_city,
        CASE WHEN p.type = 'meetup' AND p.k % 3 <> 0 THEN 'cat' || CAST(p.k % 6 AS VARCHAR) END AS category,
        false AS is_corrupt FROM p""",
    "framed_json": """SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS record_no,
        event_id AS post_id, event_type AS kind, value, false AS is_corrupt FROM events""",
    "union_listings": """SELECT event_id AS post_id, listing, 'reddit' AS type FROM (
        SELECT event_id, 'new' AS listing FROM events
        UNION ALL SELECT event_id, 'controversial' FROM events WHERE event_type = 'error'
        UNION ALL SELECT event_id, 'hot' FROM events WHERE value > 20
        UNION ALL SELECT event_id, 'rising' FROM events WHERE event_type = 'signup'
        UNION ALL SELECT event_id, 'top' FROM events WHERE value > 50)""",
    "union_listings_dedupe": "SELECT DISTINCT event_id AS post_id, 'reddit' AS type FROM events",
    "invalid_posts": f"WITH {POSTS} SELECT post_id, type FROM p WHERE type IS NULL OR type NOT IN ('reddit', 'twitter', 'meetup')",
    "classify_messages": f"""WITH {EVENTS} SELECT event_id,
        CASE event_type WHEN 'view' THEN 'post' WHEN 'signup' THEN 'limit' WHEN 'purchase' THEN 'disconnect' WHEN 'error' THEN 'error'
          ELSE 'unknown' END AS kind,
        CASE event_type WHEN 'signup' THEN CAST(k AS VARCHAR) WHEN 'purchase' THEN 'reason ' || CAST(k AS VARCHAR)
          WHEN 'error' THEN 'failed ' || CAST(k AS VARCHAR) || ' ' || CAST(k AS VARCHAR) END AS detail
        FROM ev""",
    "meetup_fields": f"WITH {POSTS}, {MEETUPS} SELECT post_id, city, state, country, venue_text, category FROM m",
    "keywords": f"""WITH k AS (SELECT doc_id, {_keywords('text')} AS words FROM documents)
        SELECT doc_id, unnest(generate_series(0, len(words) - 1)) AS pos, unnest(words) AS keyword FROM k WHERE len(words) > 0""",
    "reddit_minute": f"WITH {REDDIT} SELECT strftime(minute, {MINUTE}) AS minute, keyword, num_comments, score FROM rm",
    "twitter_minute": f"WITH {TWITTER} SELECT strftime(minute, {MINUTE}) AS minute, keyword, retweets, favorites, replies FROM tm",
    "meetup_latest": f"""WITH {POSTS}, {MEETUPS},
        mk AS (SELECT date_trunc('minute', ts) AS minute, ts, post_id, city, state, country, category, name, venue_text AS venue,
          unnest(list_distinct(list_concat({_keywords('name')}, {_keywords("coalesce(description, '')")}))) AS keyword FROM m)
        SELECT strftime(minute, {MICROS}) AS minute, keyword, strftime(ts, {MICROS}) AS ts, post_id, city, state, country, category, name, venue
        FROM mk QUALIFY row_number() OVER (PARTITION BY minute, keyword ORDER BY mk.ts DESC, post_id DESC) = 1""",
    "minute_scores": f"WITH {SCORES} SELECT strftime(minute, {MINUTE}) AS minute, keyword, score FROM ms",
    "minute_scores_sum": f"WITH {SCORES_SUM} SELECT strftime(minute, {MINUTE}) AS minute, keyword, score FROM ms",
    "trend_5min": f"""WITH {SCORES},
        totals AS (SELECT keyword, CAST(sum(score) AS BIGINT) AS score FROM ms, newest WHERE minute >= date_trunc('hour', as_of) GROUP BY keyword)
        SELECT keyword, strftime(as_of, {MINUTE}) AS period, score, row_number() OVER (ORDER BY score DESC, keyword) AS rank
        FROM totals, newest QUALIFY rank <= 10""",
    "trend_5min_tumbling": _trend("date_trunc('hour', minute) + INTERVAL 5 MINUTE * (minute(minute) // 5)", MINUTE),
    "trend_hour": _trend("date_trunc('hour', minute)", "'%Y-%m-%d-%H'"),
    "stream_dedup": f"SELECT event_id AS post_id, strftime(ts, {MICROS}) AS ts, event_type AS type FROM events",
}
ORACLE["stream_keyword_minute"] = ORACLE["twitter_minute"]
ORACLE["merge_counters"] = ORACLE["twitter_minute"]
ORACLE["stream_minute_scores"] = ORACLE["minute_scores"]
ORACLE["stream_trend_hour"] = f"""SELECT h.* FROM ({ORACLE['trend_hour']}) h, (SELECT max(ts) AS as_of FROM events)
    WHERE h.period < strftime(as_of, '%Y-%m-%d-%H')"""
ORACLE["difflog_missing_rich"] = f"WITH {RICH_MISSING} SELECT log_id, src, dst FROM rmissing"
ORACLE["difflog_path_steps"] = ORACLE["difflog_missing_rich"]
ORACLE["common_path_steps"] = f"""WITH {RICH_MISSING},
    dvec AS (SELECT log_id, list_sort(list(DISTINCT v)) AS ids
      FROM (SELECT log_id, src AS v FROM rmissing UNION ALL SELECT log_id, dst FROM rmissing) GROUP BY log_id),
    dclusters AS (SELECT min(log_id) OVER (PARTITION BY ids) AS cluster_id, log_id, count(*) OVER (PARTITION BY ids) AS size FROM dvec)
    SELECT cluster_id, src, dst FROM dclusters d JOIN rmissing m ON m.log_id = d.log_id GROUP BY cluster_id, src, dst HAVING count(*) = max(size)"""
