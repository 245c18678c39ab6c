"""SQL of another engine for the declared plans, written apart from them.

A declaration that is expanded for two engines only shows that both read it alike. These say what
each query means in the other engine's own terms: QUALIFY for the first of a group, arg_min and
arg_max, lists, FILTER and correlated questions instead of the plans' windows and joins.
"""

from __future__ import annotations

#: Commits once each, files once per commit, ticks once each.
_C = "c AS (FROM commits QUALIFY row_number() OVER (PARTITION BY commit_id ORDER BY received_ts, idx) = 1)"
_F = _C + ", f AS (SELECT DISTINCT repo_id, commit_id, idx, author_id, tick, path FROM (SELECT *, unnest(files) AS path FROM c) WHERE path IS NOT NULL)"
_T = "t AS (FROM tick_metrics QUALIFY row_number() OVER (PARTITION BY repo_id, tick ORDER BY reported_at) = 1)"
_FN = "fn AS (SELECT DISTINCT * FROM function_metrics)"
_Q = "q AS (SELECT DISTINCT * FROM file_quality)"
#: Pairs of files of a commit, from its sorted list of files; commits of over 1,000 files are not paired.
_PAIRS = (
    _F
    + """, l AS (SELECT repo_id, commit_id, list_sort(list(path)) AS fs FROM f GROUP BY ALL HAVING count(*) <= 1000),
one AS (SELECT repo_id, unnest(fs) AS path, 1 AS k FROM l), alone AS (SELECT repo_id, path, count(*) AS n FROM one GROUP BY ALL),
two AS (SELECT repo_id, fs[i] AS file1, unnest(fs[i + 1:]) AS file2 FROM (SELECT *, unnest(range(1, len(fs) + 1)) AS i FROM l)),
co AS (SELECT repo_id, file1, file2, count(*) AS co_changes FROM two GROUP BY ALL),
st AS (SELECT co.*, least(2.0 * co_changes / (x.n + y.n), 1.0) AS strength FROM co JOIN alone x ON (x.repo_id, x.path) = (co.repo_id, file1) JOIN alone y ON (y.repo_id, y.path) = (co.repo_id, file2))"""
)
#: Developers of a file, from the list of each file's developers.
_DEVS = (
    _F
    + """, k AS (SELECT repo_id, path, author_id, count(*) AS n FROM f GROUP BY ALL), own AS (SELECT repo_id, author_id, sum(n) AS n FROM k GROUP BY ALL),
l AS (SELECT repo_id, path, list_sort(list(struct_pack(a := author_id, n := n))) AS ds FROM k GROUP BY ALL),
two AS (SELECT repo_id, ds[i] AS d1, unnest(ds[i + 1:]) AS d2 FROM (SELECT *, unnest(range(1, len(ds) + 1)) AS i FROM l)),
sh AS (SELECT repo_id, d1.a AS dev1, d2.a AS dev2, sum(least(d1.n, d2.n))::BIGINT AS shared_changes FROM two GROUP BY ALL)"""
)


def _ranked(table: str, order: str, most: int) -> str:
    return f"FROM {table} QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY {order}) <= {most}"


SQL: dict[str, str] = {
    "ticks": f"WITH {_C}, o AS (SELECT repo_id, arg_min(epoch_us(committer_ts), (idx, commit_id)) // 86400000000 AS day0 FROM c WHERE committer_ts IS NOT NULL GROUP BY repo_id), "
    "r AS (SELECT repo_id, commit_id, idx, epoch_us(committer_ts) // 86400000000 - day0 AS raw FROM c JOIN o USING (repo_id) WHERE committer_ts IS NOT NULL) "
    "SELECT repo_id, commit_id, idx, raw, list_max(list(raw) OVER (PARTITION BY repo_id ORDER BY idx, commit_id)) AS monotone FROM r",
    "commits_by_tick": f"WITH {_C} SELECT repo_id, tick, count(*) AS commits, list_min(list(commit_hash)) AS first_hash, list_max(list(commit_hash)) AS last_hash FROM c GROUP BY ALL",
    "tick_range": f"WITH {_C} SELECT repo_id, tick, epoch_us(min(committer_ts)) AS first_us, epoch_us(max(committer_ts)) AS last_us FROM c GROUP BY ALL",
    "commit_count": "SELECT repo_id, count(DISTINCT commit_id) AS commits, count(DISTINCT commit_id) FILTER (WHERE is_merge) AS merges FROM commits GROUP BY repo_id",
    "dev_ticks": "SELECT repo_id, tick, author_id, count(*) AS commits, sum(lines_added)::BIGINT AS added, sum(lines_removed)::BIGINT AS removed FROM (SELECT DISTINCT commit_id, repo_id, tick, author_id, lines_added, lines_removed FROM commits) GROUP BY ALL",
    "developers": "WITH u AS (SELECT DISTINCT commit_id, repo_id, tick, author_id, coalesce(lines_added, 0) AS a, coalesce(lines_removed, 0) AS r FROM commits) SELECT repo_id, author_id, coalesce((SELECT min(dev_name) FROM developers WHERE dev_id = author_id), if(author_id = 262142, '<unmatched>', concat('dev_', author_id))) AS name, "
    "count(*) AS commits, sum(a)::BIGINT AS added, sum(r)::BIGINT AS removed, (sum(a) - sum(r))::BIGINT AS net_lines, min(tick) AS first_tick, max(tick) AS last_tick, len(list_distinct(list(tick))) AS active_ticks FROM u GROUP BY repo_id, author_id",
    "activity": "SELECT repo_id, tick, count(*) AS commits, count(DISTINCT author_id) AS authors FROM (SELECT DISTINCT commit_id, repo_id, tick, author_id FROM commits) GROUP BY ALL",
    "activity_others": f"WITH {_C}, n AS (SELECT repo_id, author_id, count(*) AS k FROM c GROUP BY ALL), top AS ({_ranked('n', 'k DESC, author_id', 10)}) "
    "SELECT repo_id, tick, if((repo_id, author_id) IN (SELECT (repo_id, author_id) FROM top), author_id::VARCHAR, 'Others') AS who, count(*) AS commits FROM c GROUP BY ALL",
    "churn": "SELECT repo_id, tick, sum(lines_added)::BIGINT AS added, sum(lines_removed)::BIGINT AS removed, sum(lines_added - lines_removed)::BIGINT AS net FROM (SELECT DISTINCT commit_id, repo_id, tick, lines_added, lines_removed FROM commits) GROUP BY ALL",
    "anonymised_developers": f"WITH {_C}, n AS (SELECT repo_id, author_id, count(*) AS commits FROM c GROUP BY ALL) SELECT repo_id, 'Developer-' || (1 + (SELECT count(*) FROM n m WHERE m.repo_id = n.repo_id AND (m.commits > n.commits OR m.commits = n.commits AND m.author_id < n.author_id))) AS name, commits FROM n",
    "file_coupling": f"WITH {_PAIRS} SELECT repo_id, file1, file2, co_changes, round(strength, 6) AS strength FROM st",
    "top_couplings": f"WITH {_PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY co_changes DESC, file1, file2) AS place FROM co) SELECT repo_id, file1, file2, co_changes, place FROM n WHERE place <= 7",
    "couples_aggregate": f"WITH {_PAIRS} SELECT g.repo_id, g.files, g.developers, coalesce((SELECT sum(co_changes) FROM st WHERE st.repo_id = g.repo_id), 0)::BIGINT AS co_changes, round(coalesce((SELECT avg(strength) FROM st WHERE st.repo_id = g.repo_id), 0), 6) AS avg_strength, (SELECT count(*) FROM st WHERE st.repo_id = g.repo_id AND co_changes >= 10) AS highly_coupled "
    "FROM (SELECT repo_id, count(DISTINCT path) AS files, count(DISTINCT author_id) AS developers FROM f GROUP BY repo_id) g",
    "developer_coupling": f"WITH {_DEVS} SELECT sh.repo_id, dev1, dev2, shared_changes, round(least(2.0 * shared_changes / (x.n + y.n), 1.0), 6) AS strength FROM sh JOIN own x ON (x.repo_id, x.author_id) = (sh.repo_id, dev1) JOIN own y ON (y.repo_id, y.author_id) = (sh.repo_id, dev2)",
    "top_developer_matrix": f"WITH {_DEVS}, top AS ({_ranked('own', 'n DESC, author_id', 20)}) SELECT repo_id, dev1, dev2, shared_changes FROM sh WHERE (repo_id, dev1) IN (SELECT (repo_id, author_id) FROM top) AND (repo_id, dev2) IN (SELECT (repo_id, author_id) FROM top)",
    "file_ownership": f"WITH {_F}, k AS (SELECT repo_id, path, author_id, count(*) AS n FROM f GROUP BY ALL) SELECT repo_id, path, count(*) AS contributors, arg_max(author_id, (n, -author_id)) AS top_contributor, sum(n)::BIGINT AS revisions FROM k GROUP BY ALL",
    "ownership_buckets": f"WITH {_F}, k AS (SELECT repo_id, path, len(list_distinct(list(author_id))) AS n FROM f GROUP BY ALL) SELECT repo_id, if(n = 1, '1', if(n <= 3, '2-3', if(n <= 5, '4-5', '6+'))) AS bucket, count(*) AS files FROM k GROUP BY ALL",
    "hotspots": f"WITH {_F} SELECT repo_id, path, count(*) AS commits, if(count(*) >= 50, 'CRITICAL', if(count(*) >= 30, 'HIGH', 'MEDIUM')) AS risk FROM f GROUP BY ALL HAVING count(*) >= 15",
    "top_files": f"WITH {_F}, n AS (SELECT repo_id, path, count(*) AS commits FROM f GROUP BY ALL) SELECT repo_id, path, commits, row_number() OVER (PARTITION BY repo_id ORDER BY commits DESC, path) AS place FROM n QUALIFY place <= 20",
    "file_history_aggregate": f"WITH {_F}, n AS (SELECT repo_id, path, count(*) AS k, count(DISTINCT author_id) AS a FROM f GROUP BY ALL) SELECT repo_id, count(*) AS files, sum(k)::BIGINT AS revisions, (SELECT count(DISTINCT author_id) FROM f WHERE f.repo_id = n.repo_id) AS contributors, round(avg(k), 6) AS avg_commits, round(avg(a), 6) AS avg_contributors, count(*) FILTER (WHERE k >= 15) AS high_churn FROM n GROUP BY repo_id",
    "renames": "SELECT repo_id, commit_id, from_path, to_path FROM file_changes WHERE from_path IS NOT NULL AND to_path IS NOT NULL AND NOT (from_path = to_path)",
    "merged_states": "SELECT repo_id, author_id, count(DISTINCT commit_id) AS commits FROM commits GROUP BY ALL",
    "quality_aggregate": f"WITH {_Q}, k AS (SELECT repo_id, tick, count(*) AS n, avg(complexity) AS m, median(complexity) AS md, max(complexity) AS hi, avg(comment_score) AS c, min(comment_score) AS cl, min(cohesion) AS h FROM q GROUP BY ALL) "
    "SELECT repo_id, count(*) AS ticks, sum(n)::BIGINT AS files, round(avg(m), 6) AS complexity_mean, round(avg(md), 6) AS complexity_median, max(hi) AS complexity_max, round(avg(c), 6) AS comment_mean, min(cl) AS comment_min, min(h) AS cohesion_min FROM k GROUP BY repo_id",
    "quality_ticks": f"WITH {_Q} SELECT repo_id, tick, count(*) AS files, round(avg(complexity), 9) AS complexity_mean, round(median(complexity), 9) AS complexity_median, round(quantile_cont(complexity, 0.95), 9) AS complexity_p95, max(complexity) AS complexity_max, round(avg(comment_score), 9) AS comment_mean, min(comment_score) AS comment_min, "
    "round(avg(doc_coverage), 9) AS doc_mean, round(avg(cohesion), 9) AS cohesion_mean, min(cohesion) AS cohesion_min, round(sum(delivered_bugs), 9) AS bugs FROM q GROUP BY ALL",
    "cohesion_histogram": f"WITH {_Q} SELECT repo_id, if(cohesion >= 0.9, 9, floor(cohesion * 10))::BIGINT AS bin, count(*) AS files FROM q WHERE cohesion IS NOT NULL GROUP BY ALL",
    "cohesion_distribution": f"WITH {_Q} SELECT repo_id, if(cohesion < 0.3, 'Poor', if(cohesion < 0.4, 'Fair', if(cohesion < 0.6, 'Good', 'Excellent'))) AS level, count(*) AS files FROM q WHERE cohesion IS NOT NULL GROUP BY ALL",
    "low_cohesion_files": "SELECT DISTINCT repo_id, commit_id, file_path, cohesion, if(cohesion >= 0.3, 'MEDIUM', 'HIGH') AS risk FROM file_quality WHERE cohesion < 0.4",
    "documentation": f"WITH {_Q} SELECT repo_id, if(doc_coverage <= 0, 'Undocumented', if(doc_coverage < 0.3, 'Poorly Documented', if(doc_coverage < 0.6, 'Partially Documented', 'Well Documented'))) AS status, count(*) AS files, round(avg(comment_score), 9) AS comment_score FROM q WHERE doc_coverage IS NOT NULL GROUP BY ALL",
    "complexity_distribution": f"WITH {_FN} SELECT repo_id, if(cyclomatic_complexity > 10, 'complex', if(cyclomatic_complexity > 5, 'moderate', 'simple')) AS level, count(*) AS functions FROM fn WHERE cyclomatic_complexity IS NOT NULL GROUP BY ALL",
    "high_risk_functions": f"WITH {_FN} SELECT function_id, array_to_string([x FOR x IN [if(cyclomatic_complexity >= 10, 'cyclomatic', NULL), if(cognitive_complexity >= 15, 'cognitive', NULL), if(nesting_depth >= 5, 'nesting', NULL)] IF x IS NOT NULL], ', ') AS issues FROM fn WHERE greatest(cyclomatic_complexity - 10, cognitive_complexity - 15, nesting_depth - 5) >= 0",
    "complexity_aggregate": f"WITH {_FN}, a AS (SELECT repo_id, count(*) AS functions, avg(cyclomatic_complexity) AS m, max(cyclomatic_complexity) AS most, avg(cognitive_complexity) AS g, max(nesting_depth) AS deepest FROM fn GROUP BY repo_id) "
    "SELECT repo_id, functions, round(m, 6) AS mean, most, round(g, 6) AS cognitive, deepest, round(if(m > 7, greatest(0, 50 - 5 * (m - 7)), if(m > 3, 80 - 7.5 * (m - 3), if(m > 1, 100 - 10 * (m - 1), 100))), 6) AS health FROM a",
    "complexity_ratio": f"WITH {_FN} SELECT repo_id, sum(cyclomatic_complexity)::BIGINT AS total, round(avg(cyclomatic_complexity), 9) AS average, max(cyclomatic_complexity) AS most FROM fn GROUP BY repo_id",
    "top_issues": f"WITH {_FN} SELECT repo_id, function_id, cyclomatic_complexity, row_number() OVER (PARTITION BY repo_id ORDER BY coalesce(cyclomatic_complexity, -1) DESC, coalesce(cognitive_complexity, -1) DESC, coalesce(nesting_depth, -1) DESC, function_id) AS place FROM fn QUALIFY place <= 10",
    "top_efforts": f"WITH {_FN} SELECT repo_id, function_id, row_number() OVER (PARTITION BY repo_id ORDER BY coalesce(effort, -1) DESC, function_id) AS place FROM fn QUALIFY place <= 12",
    "halstead_distribution": f"WITH {_FN} SELECT repo_id, if(volume < 100, 'Low', if(volume < 1000, 'Medium', if(volume < 5000, 'High', 'Very High'))) AS level, count(*) AS functions FROM fn WHERE volume IS NOT NULL GROUP BY ALL",
    "high_effort_functions": f"WITH {_FN} SELECT function_id, effort, if(volume < 5000, 'MEDIUM', 'HIGH') AS risk FROM fn WHERE NOT (volume < 1000) AND volume IS NOT NULL",
    "folder_rollup": f"WITH {_FN}, d AS (SELECT repo_id, string_split(file_path, '/')[1] AS folder, file_path, count(*) AS n, avg(cyclomatic_complexity) AS m FROM fn GROUP BY ALL) SELECT repo_id, folder, count(*) AS files, sum(n)::BIGINT AS functions, round(avg(m), 6) AS mean_complexity FROM d GROUP BY ALL",
    "last_functions": "SELECT repo_id, file_path, function_name, max(function_id) AS function_id FROM function_metrics GROUP BY ALL",
    "function_hierarchy": f"WITH {_FN}, n AS (SELECT repo_id, file_path, count(*) AS functions, max(cyclomatic_complexity) AS most FROM fn GROUP BY ALL) SELECT repo_id, file_path, functions, most FROM ({_ranked('n', 'functions DESC, file_path', 30)})",
    "scatter_classes": f"WITH {_FN} SELECT repo_id, if(volume < 1000, 'small', 'large') AS size, if(cyclomatic_complexity <= 10, 'simple', 'complex') AS shape, count(*) AS functions FROM fn WHERE volume IS NOT NULL AND cyclomatic_complexity IS NOT NULL GROUP BY ALL",
    "active_spells": "WITH t AS (SELECT DISTINCT repo_id, tick FROM tick_metrics), g AS (SELECT repo_id, tick, tick - row_number() OVER (PARTITION BY repo_id ORDER BY tick) AS island FROM t) SELECT repo_id, min(tick) AS first_tick, max(tick) AS last_tick, count(*) AS ticks FROM g GROUP BY repo_id, island",
    "nearest_following": "SELECT a.doc_id, a.repo_id, (SELECT min(epoch_us(b.created_at)) FROM documents b WHERE b.repo_id = a.repo_id AND b.doc_kind = 'release_note' AND b.created_at >= a.created_at) - epoch_us(a.created_at) AS gap FROM documents a WHERE a.doc_kind = 'issue' AND a.repo_id IS NOT NULL AND a.created_at IS NOT NULL",
    "event_windows": "SELECT epoch_us(date_trunc('hour', ts)) // 3600000000 AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL",
    "change_languages": "SELECT repo_id, ifnull(prog_lang, 'Other') AS lang, change_kind, count(*) AS changes FROM file_changes GROUP BY ALL",
    "text_lines": "SELECT change_id, (len(string_split(after_text, chr(10))) - if(after_text = '' OR right(after_text, 1) = chr(10), 1, 0))::BIGINT AS lines, len([x FOR x IN string_split(after_text, chr(10)) IF x <> '']) > 0 AS has_text FROM file_changes WHERE after_text IS NOT NULL AND change_kind IN ('insert', 'modify')",
    "unanalysed_commits": "SELECT DISTINCT commit_id FROM commits c WHERE NOT EXISTS (SELECT 1 FROM file_changes f WHERE f.commit_id = c.commit_id)",
    "changed_and_measured": "SELECT DISTINCT repo_id, prog_lang FROM file_quality q WHERE (repo_id, coalesce(prog_lang, '')) IN (SELECT (repo_id, coalesce(prog_lang, '')) FROM file_changes)",
    "packed_people": "WITH p AS (SELECT DISTINCT commit_id, author_id, tick FROM commits) SELECT commit_id, author_id * 16384 + tick % 16384 AS packed, author_id, tick % 16384 AS tick FROM p",
    "people": "WITH k AS (SELECT repo_id, ifnull(lower(email), lower(dev_name)) AS person, * EXCLUDE (repo_id) FROM developers WHERE repo_id IS NOT NULL) SELECT repo_id, person, min(dev_id) AS id, len(list_distinct(list(dev_name))) AS names, min(dev_name) AS first_name FROM k GROUP BY ALL",
}
