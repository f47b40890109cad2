"""DuckDB text of the queries that SQL can express over whole tables: plain, unoptimised statements of the same results."""

_KIND = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_STEP_EVENTS = r"""d AS (SELECT * EXCLUDE rn FROM (SELECT traj_id, step, output, started_at, step_wall_seconds, row_number() OVER (PARTITION BY traj_id, step ORDER BY ingested_at) AS rn FROM steps WHERE traj_id IS NOT NULL AND step IS NOT NULL) WHERE rn = 1),
 b AS (SELECT *, regexp_replace(output, '^\s*```[a-zA-Z]*\s*|\s*```\s*$', '', 'g') AS body FROM d),
 j AS (SELECT *, CASE WHEN json_valid(body) AND regexp_matches(body, '^\s*\{') THEN body END AS j FROM b),
 k AS (SELECT *, coalesce(""" + _KIND.format("json_extract_string(j, '$.action.type')") + r""", '') AS kind, regexp_replace(regexp_replace(lower(coalesce(json_extract_string(j, '$.action.content'), '')), '(\d)\.(\d)', '\1~\2', 'g'), '[^\p{L}\p{N}~]', '', 'g') AS content,
  TRY_CAST(json_extract_string(j, '$.action.num') AS DOUBLE) AS num, TRY_CAST(json_extract_string(j, '$.action.start') AS DOUBLE) AS s, TRY_CAST(json_extract_string(j, '$.action.end') AS DOUBLE) AS e FROM j),
 v AS (SELECT traj_id, step, started_at, step_wall_seconds, CASE WHEN kind = '' THEN '?' ELSE kind END AS kind, CASE WHEN kind = '' THEN regexp_replace(coalesce(output, ''), '\s+', '', 'g') ELSE content END AS txt, num, s, e FROM k),
 l AS (SELECT *, lag(kind) OVER w AS pk, lag(txt) OVER w AS pt, lag(num) OVER w AS pn, lag(s) OVER w AS ps, lag(e) OVER w AS pe FROM v WINDOW w AS (PARTITION BY traj_id ORDER BY step)),
 n AS (SELECT *, CASE WHEN pk = kind AND pt = txt AND pn IS NOT DISTINCT FROM num AND coalesce(abs(ps - s) < 0.5, ps IS NULL AND s IS NULL) AND coalesce(abs(pe - e) < 0.5, pe IS NULL AND e IS NULL) THEN 0 ELSE 1 END AS brk FROM l),
 r AS (SELECT *, sum(brk) OVER (PARTITION BY traj_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS run FROM n)"""
_SEQ_EVENTS = r"""q AS (SELECT DISTINCT traj_id, str_split_regex(trim(tool_sequence), '\s*(?:->|=>|→|[,;|>/\n])\s*') AS a FROM episodes WHERE regexp_matches(tool_sequence, '[\p{L}\p{N}]')),
 u AS (SELECT traj_id, i, """ + _KIND.format("a[i]") + r""" AS x FROM q, unnest(range(1, len(a) + 1)) t(i)), ul AS (SELECT *, CASE WHEN lag(x) OVER (PARTITION BY traj_id ORDER BY i) = x THEN 0 ELSE 1 END AS brk FROM u),
 ur AS (SELECT *, sum(brk) OVER (PARTITION BY traj_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM ul)"""
P1_FOUND = f"""WITH {_STEP_EVENTS}, {_SEQ_EVENTS} SELECT 'steps' AS src, traj_id, min(step)::INT AS first_pos, max(step)::INT AS last_pos FROM r GROUP BY traj_id, run HAVING count(*) > 1
 UNION ALL SELECT 'tool_sequence', traj_id, min(i)::INT, max(i)::INT FROM ur GROUP BY traj_id, run HAVING count(*) > 1"""

P1_RUNS = f"""WITH {_STEP_EVENTS} SELECT traj_id, min(step)::INT AS first_pos, max(step)::INT AS last_pos, count(*) AS n,
 round((arg_max(epoch_us(started_at) + CAST(floor(coalesce(step_wall_seconds, 0) * 1000000) AS BIGINT), step) - arg_min(epoch_us(started_at), step)) / 1000000.0, 6)::DOUBLE AS seconds, any_value(kind) AS kind FROM r GROUP BY traj_id, run"""


def recording(column: str) -> str:
    """The recording key as SQL."""
    base = rf"regexp_extract(regexp_replace(regexp_replace(lower(trim({column})), '[?#].*$', ''), '\s+$', ''), '([^/\\]+)[/\\]*$', 1)"
    bare = rf"regexp_replace({base}, '(\.[a-z][a-z0-9]{{1,4}})+$', '')"
    stretch = r"[._\-\s~]+(\d{1,7})(?:\.\d+)?[._\-\s~]+(\d{1,7})(?:\.\d+)?$"
    lo, hi = (f"TRY_CAST(regexp_extract({bare}, '{stretch}', {i}) AS INT)" for i in (1, 2))
    named = rf"regexp_matches({bare}, '^.*[\p{{L}}\p{{N}}].*{stretch}')"
    cut = f"CASE WHEN {lo} < {hi} AND {named} THEN regexp_replace({bare}, '{stretch}', '') ELSE {bare} END"
    return rf"nullif(regexp_replace({cut}, '[^\p{{L}}\p{{N}}]+', '', 'g'), '')"


P4_FOUND = f"WITH k AS (SELECT row_id, {recording('video')} AS rec FROM example_train_rl), f AS (SELECT row_id, min(row_id) OVER (PARTITION BY rec) AS first_row_id FROM k WHERE rec IS NOT NULL) SELECT first_row_id, row_id FROM f WHERE row_id > first_row_id"

P4_CHECK = f"""WITH k AS (SELECT row_id, {recording('video')} AS rec FROM example_train_rl) SELECT count(*) AS n_rows, count(DISTINCT rec) + count(*) FILTER (rec IS NULL) AS components, CAST(0 AS BIGINT) AS torn, true AS near FROM k"""

_WORDS = r"array_to_string(regexp_extract_all(lower({0}), '\p{{Nd}}+(?:[.,]\p{{Nd}}+)*|\p{{L}}+'), ' ')"
_NUMBERS = r"list_sort([TRY_CAST(replace(x, ',', '') AS DOUBLE) FOR x IN regexp_extract_all({0}, '\d+(?:[.,]\d+)*')])"
P5_FOUND = f"""WITH e AS (SELECT eval_id, {recording('video')} AS rec, {_WORDS.format('question')} AS q FROM example_eval), t AS (SELECT row_id, {recording('video')} AS rec, {_WORDS.format('question')} AS q FROM example_train_rl),
 p AS (SELECT eval_id, row_id, e.q AS a, t.q AS b, list_distinct(str_split(e.q, ' ')) AS x, list_distinct(str_split(t.q, ' ')) AS y FROM e JOIN t USING (rec) WHERE e.q <> '' AND t.q <> ''),
 s AS (SELECT *, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS s, len(list_intersect(x, y)) / least(len(x), len(y)) AS w FROM p)
 SELECT eval_id, row_id FROM s WHERE (s >= 0.85 OR (s >= 0.68 AND w >= 0.8)) AND {_NUMBERS.format('a')} = {_NUMBERS.format('b')}"""

_LABEL = r"regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '[_\-\s]', '_', 'g')"
P5_REPORT = f"""WITH f AS ({P5_FOUND}), p AS (SELECT split, {_LABEL.format('data_source')} AS source, f.eval_id, f.row_id FROM f JOIN example_eval USING (eval_id) JOIN example_train_rl USING (row_id))
 SELECT split, source, count(*) AS pairs, count(DISTINCT eval_id) AS eval_samples, count(DISTINCT row_id) AS train_rows FROM p GROUP BY split, source"""
P6_FOUND = f"""WITH l AS (SELECT 'question_type' AS f, question_type AS v FROM example_train_rl UNION ALL SELECT 'data_source', data_source FROM example_train_rl UNION ALL SELECT 'ability', ability FROM example_train_rl),
 c AS (SELECT f, {_LABEL.format('v')} AS k, count(*) AS n FROM l WHERE v IS NOT NULL GROUP BY 1, 2)
 SELECT field_name, category FROM category_targets LEFT JOIN c ON f = field_name AND k = {_LABEL.format('category')} WHERE coalesce(n, 0) < greatest(min_rows, target_share * floor(0.2 * (SELECT count(*) FROM example_train_rl)))"""

SQL = {"p1_found": P1_FOUND, "p1_runs": P1_RUNS, "p4_found": P4_FOUND, "p4_check": P4_CHECK, "p5_found": P5_FOUND, "p5_report": P5_REPORT, "p6_found": P6_FOUND}
