"""History analyses: ticks, developers, coupling, file history, anomalies, quality, line survival.

Every analysis is per repository; keys always hold repo_id, so nothing is gathered across
repositories. A commit delivered twice counts once.
"""

from __future__ import annotations

from tidemark.plans.declared import register

#: Commits once each, and their files and languages.
C = """c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY received_ts, idx) AS rn FROM commits) t WHERE rn = 1)"""
CF = C + """, cf0 AS (SELECT repo_id, commit_id, idx, author_id, tick, is_merge, EXPLODE(files) AS path FROM c),
cf AS (SELECT DISTINCT repo_id, commit_id, idx, author_id, tick, is_merge, path FROM cf0 WHERE path IS NOT NULL)"""
CL = C + """, cl0 AS (SELECT repo_id, commit_id, author_id, tick, lines_added, lines_removed, EXPLODE(map_entries(languages)) AS kv FROM c),
cl AS (SELECT repo_id, commit_id, author_id, tick, CASE WHEN kv.key IS NULL OR kv.key = '' THEN 'Other' ELSE kv.key END AS lang, kv.value AS files, lines_added, lines_removed FROM cl0)"""
Q = """q AS (SELECT DISTINCT * FROM file_quality)"""
T = """t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, tick ORDER BY reported_at) AS rn FROM tick_metrics) x WHERE rn = 1)"""


def _z(column: str, window: int = 20) -> str:
    """Trailing z-score over the previous recorded ticks of the repository: 0 without any, 100 with sign where they were all equal."""
    w = f"OVER (PARTITION BY repo_id ORDER BY tick ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    mean, sd = f"coalesce(avg({column}) {w}, 0e0)", f"coalesce(stddev_pop({column}) {w}, 0e0)"
    none = f"count({column}) {w} = 0"
    return f"CASE WHEN {none} THEN 0e0 WHEN {sd} < 1e-9 THEN CASE WHEN abs({column} - {mean}) < 1e-9 THEN 0e0 WHEN {column} > {mean} THEN 1e2 ELSE -1e2 END ELSE ({column} - {mean}) / {sd} END"


#: Per-tick change metrics of the commits, and their z-scores.
M = (
    CF
    + """, m0 AS (SELECT repo_id, tick, count(*) AS commits, cast(sum(lines_added) AS bigint) AS lines_added, cast(sum(lines_removed) AS bigint) AS lines_removed, cast(sum(net_churn) AS bigint) AS net_churn, count(DISTINCT author_id) AS authors FROM c GROUP BY repo_id, tick),
mf AS (SELECT repo_id, tick, count(*) AS files_changed FROM cf GROUP BY repo_id, tick),
ml0 AS (SELECT repo_id, tick, EXPLODE(map_keys(languages)) AS lang FROM c),
ml AS (SELECT repo_id, tick, count(DISTINCT lang) AS languages FROM ml0 GROUP BY repo_id, tick),
m AS (SELECT m0.repo_id, m0.tick, commits, coalesce(files_changed, 0) AS files_changed, coalesce(lines_added, 0) AS lines_added, coalesce(lines_removed, 0) AS lines_removed, coalesce(net_churn, 0) AS net_churn, coalesce(languages, 0) AS languages, authors
FROM m0 LEFT JOIN mf ON mf.repo_id = m0.repo_id AND mf.tick = m0.tick LEFT JOIN ml ON ml.repo_id = m0.repo_id AND ml.tick = m0.tick),
z AS (SELECT *, """
    + ", ".join(f"{_z(k)} AS z_{k}" for k in ("files_changed", "lines_added", "lines_removed", "net_churn", "languages", "authors"))
    + """ FROM m),
zz AS (SELECT *, round(greatest(abs(z_files_changed), abs(z_lines_added), abs(z_lines_removed), abs(z_net_churn), abs(z_languages), abs(z_authors)), 6) AS max_z FROM z)"""
)
_ZCOLS = ", ".join(f"round(z_{k}, 6) AS z_{k}" for k in ("files_changed", "lines_added", "lines_removed", "net_churn", "languages", "authors"))

#: Pairs of files that change together, and how often each changes. Commits of over 1,000 files are counted but not paired.
P = (
    CF
    + """, sized AS (SELECT repo_id, commit_id, count(*) AS n FROM cf GROUP BY repo_id, commit_id),
kept AS (SELECT cf.repo_id, cf.commit_id, path FROM cf JOIN sized s ON s.repo_id = cf.repo_id AND s.commit_id = cf.commit_id WHERE n <= 1000),
selfs AS (SELECT repo_id, path, count(*) AS n FROM kept GROUP BY repo_id, path),
pairs AS (SELECT a.repo_id, a.path AS file1, b.path AS file2, count(*) AS co_changes FROM kept a JOIN kept b ON a.repo_id = b.repo_id AND a.commit_id = b.commit_id AND a.path < b.path GROUP BY a.repo_id, a.path, b.path),
coupled AS (SELECT pairs.repo_id, file1, file2, co_changes, least(co_changes / ((s1.n + s2.n) / 2e0), 1e0) AS strength FROM pairs JOIN selfs s1 ON s1.repo_id = pairs.repo_id AND s1.path = file1 JOIN selfs s2 ON s2.repo_id = pairs.repo_id AND s2.path = file2)"""
)
#: Developers that change the same files: per file the smaller of their commit counts.
D = (
    CF
    + """, touched AS (SELECT repo_id, path, author_id, count(*) AS n FROM cf GROUP BY repo_id, path, author_id),
own AS (SELECT repo_id, author_id, cast(sum(n) AS bigint) AS n FROM touched GROUP BY repo_id, author_id),
shared AS (SELECT a.repo_id, a.author_id AS dev1, b.author_id AS dev2, cast(sum(least(a.n, b.n)) AS bigint) AS shared_changes FROM touched a JOIN touched b ON a.repo_id = b.repo_id AND a.path = b.path AND a.author_id < b.author_id GROUP BY a.repo_id, a.author_id, b.author_id),
devpairs AS (SELECT shared.repo_id, dev1, dev2, shared_changes, least(shared_changes / ((o1.n + o2.n) / 2e0), 1e0) AS strength FROM shared JOIN own o1 ON o1.repo_id = shared.repo_id AND o1.author_id = dev1 JOIN own o2 ON o2.repo_id = shared.repo_id AND o2.author_id = dev2)"""
)
_NAMES = "names AS (SELECT dev_id, min(dev_name) AS name FROM developers GROUP BY dev_id)"
#: Per-file history: an insert starts a file's history anew, deletes and merges count as revisions of it.
H = (
    C
    + """, act AS (SELECT f.change_id, f.repo_id, coalesce(f.to_path, f.from_path) AS path, f.change_kind, coalesce(c.idx, f.commit_id) AS idx, f.commit_id, c.author_id, coalesce(c.lines_added, 0) AS added, coalesce(c.lines_removed, 0) AS removed FROM file_changes f LEFT JOIN c ON c.commit_id = f.commit_id),
born AS (SELECT repo_id, path, max(CASE WHEN change_kind = 'insert' THEN idx END) AS since FROM act GROUP BY repo_id, path),
hist AS (SELECT act.* FROM act JOIN born ON born.repo_id = act.repo_id AND born.path = act.path WHERE since IS NULL OR idx >= since)"""
)
#: Revisions of each path in the commits.
FH = (
    CF
    + """, churned AS (SELECT repo_id, path, count(*) AS commits, count(DISTINCT author_id) AS contributors FROM cf GROUP BY repo_id, path)"""
)
_HOT = "CASE WHEN commits >= 50 THEN 'CRITICAL' WHEN commits >= 30 THEN 'HIGH' WHEN commits >= 15 THEN 'MEDIUM' END"
#: Quality per tick.
QT = (
    Q
    + """, qt AS (SELECT repo_id, tick, count(*) AS files, avg(complexity) AS complexity_mean, PCT(complexity, 5e-1) AS complexity_median, PCT(complexity, 95e-2) AS complexity_p95, max(complexity) AS complexity_max, avg(CASE WHEN NOT isnan(halstead_volume) THEN halstead_volume END) AS volume_mean, PCT(CASE WHEN NOT isnan(halstead_volume) THEN halstead_volume END, 5e-1) AS volume_median, sum(delivered_bugs) AS bugs, avg(comment_score) AS comment_mean, min(comment_score) AS comment_min, avg(doc_coverage) AS doc_mean, avg(cohesion) AS cohesion_mean, min(cohesion) AS cohesion_min FROM q GROUP BY repo_id, tick)"""
)
_WORDS_GOOD = "good great clean clear nice thanks works improve improved better fast simple safe stable correct fixed".split()
_WORDS_BAD = "bad broken wrong slow hack ugly fail fails failed error crash leak mess stale worse duplicate missing".split()
_HITS = lambda words: " + ".join(f"CASE WHEN low LIKE '% {w} %' THEN 1 ELSE 0 END" for w in words)
#: Comments of at least 20 characters that are mostly letters and no licence text, scored by a small lexicon.
S = f"""cm0 AS (SELECT repo_id, doc_id, cast(floor(MICROS(created_at) / 864e8) AS bigint) AS tick, text, length(text) AS n FROM documents WHERE repo_id IS NOT NULL AND created_at IS NOT NULL AND doc_kind IN ('code_comment', 'review_comment', 'chat') AND length(text) >= 20),
cm AS (SELECT *, ' ' || lower(replace(replace(replace(text, '.', ' '), ',', ' '), ';', ' ')) || ' ' AS low FROM cm0 WHERE lower(text) NOT LIKE '%license%' AND lower(text) NOT LIKE '%copyright%'),
hit AS (SELECT repo_id, doc_id, tick, n, {_HITS(_WORDS_GOOD)} AS pos, {_HITS(_WORDS_BAD)} AS neg FROM cm),
sc AS (SELECT repo_id, doc_id, tick, n, (((pos - neg) / sqrt((pos - neg) * (pos - neg) + 15e0)) + 1e0) / 2e0 AS score FROM hit),
wt AS (SELECT *, least(n / avg(n) OVER (PARTITION BY repo_id, tick), 3e0) AS w FROM sc),
st AS (SELECT repo_id, tick, count(*) AS comments, sum(score * w) / sum(w) AS score FROM wt GROUP BY repo_id, tick)"""
_MOOD = "CASE WHEN score >= 6e-1 THEN 'positive' WHEN score <= 4e-1 THEN 'negative' ELSE 'neutral' END"

PLANS = {
    # ticks (AG-01, AG-02, AG-55, WN-01, WN-02)
    "ticks": f"WITH {C}, o AS (SELECT repo_id, commit_id, idx, MICROS(committer_ts) AS us, first_value(MICROS(committer_ts)) OVER (PARTITION BY repo_id ORDER BY idx, commit_id) AS t0 FROM c WHERE committer_ts IS NOT NULL), "
    "r AS (SELECT repo_id, commit_id, idx, cast(floor((us - floor(t0 / 864e8) * 864e8) / 864e8) AS bigint) AS raw FROM o) SELECT repo_id, commit_id, idx, raw, max(raw) OVER (PARTITION BY repo_id ORDER BY idx, commit_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS monotone FROM r",
    "commits_by_tick": f"WITH {C} SELECT repo_id, tick, count(*) AS commits, min(commit_hash) AS first_hash, max(commit_hash) AS last_hash FROM c GROUP BY repo_id, tick",
    "tick_range": f"WITH {C} SELECT repo_id, tick, min(MICROS(committer_ts)) AS first_us, max(MICROS(committer_ts)) AS last_us FROM c GROUP BY repo_id, tick",
    "commit_count": f"WITH {C} SELECT repo_id, count(*) AS commits, COUNTIF(is_merge) AS merges FROM c GROUP BY repo_id",
    "commit_range": f"WITH {C} SELECT repo_id, commit_id, idx FROM c WHERE committer_ts >= TIMESTAMP '2020-06-01 00:00:00' AND NOT is_merge",
    # developers (AG-04 .. AG-11, TK-01, TK-11, PL-04 .. PL-06, PL-13)
    "dev_ticks": f"WITH {C} SELECT repo_id, tick, author_id, count(*) AS commits, cast(sum(lines_added) AS bigint) AS added, cast(sum(lines_removed) AS bigint) AS removed FROM c GROUP BY repo_id, tick, author_id",
    "developers": f"WITH {C}, {_NAMES} SELECT repo_id, author_id, coalesce(name, CASE WHEN author_id = 262142 THEN '<unmatched>' ELSE 'dev_' || cast(author_id AS varchar(20)) END) AS name, count(*) AS commits, cast(sum(coalesce(lines_added, 0)) AS bigint) AS added, cast(sum(coalesce(lines_removed, 0)) AS bigint) AS removed, cast(sum(coalesce(lines_added, 0) - coalesce(lines_removed, 0)) AS bigint) AS net_lines, min(tick) AS first_tick, max(tick) AS last_tick, count(DISTINCT tick) AS active_ticks FROM c LEFT JOIN names ON dev_id = author_id GROUP BY repo_id, author_id, name",
    "activity": f"WITH {C} SELECT repo_id, tick, count(*) AS commits, count(DISTINCT author_id) AS authors FROM c GROUP BY repo_id, tick",
    "activity_others": f"WITH {C}, n AS (SELECT repo_id, author_id, count(*) AS commits FROM c GROUP BY repo_id, author_id), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY commits DESC, author_id) AS rk FROM n) SELECT c.repo_id, tick, CASE WHEN rk <= 10 THEN cast(c.author_id AS varchar(20)) ELSE 'Others' END AS who, count(*) AS commits FROM c JOIN r ON r.repo_id = c.repo_id AND r.author_id = c.author_id GROUP BY c.repo_id, tick, CASE WHEN rk <= 10 THEN cast(c.author_id AS varchar(20)) ELSE 'Others' END",
    "churn": f"WITH {C} SELECT repo_id, tick, cast(sum(lines_added) AS bigint) AS added, cast(sum(lines_removed) AS bigint) AS removed, cast(sum(lines_added - lines_removed) AS bigint) AS net FROM c GROUP BY repo_id, tick",
    "devs_aggregate": f"WITH {CL}, last AS (SELECT repo_id, max(tick) AS top FROM c GROUP BY repo_id), act AS (SELECT c.repo_id, count(DISTINCT author_id) AS active FROM c JOIN last ON last.repo_id = c.repo_id WHERE tick >= greatest(top - 90, 0) GROUP BY c.repo_id), langs AS (SELECT repo_id, count(DISTINCT lang) AS n_langs FROM cl GROUP BY repo_id), "
    "amount AS (SELECT repo_id, author_id, cast(sum(coalesce(lines_added, 0) + coalesce(lines_removed, 0)) AS bigint) AS n FROM c GROUP BY repo_id, author_id), ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, author_id) AS rk, sum(n) OVER (PARTITION BY repo_id) AS total, sum(n) OVER (PARTITION BY repo_id ORDER BY n DESC, author_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM amount), "
    "bf AS (SELECT repo_id, cast(min(CASE WHEN upto * 2 >= total THEN rk END) AS bigint) AS project_bus_factor FROM ranked GROUP BY repo_id) SELECT c.repo_id, count(*) AS commits, cast(sum(lines_added) AS bigint) AS added, cast(sum(lines_removed) AS bigint) AS removed, count(DISTINCT author_id) AS developers, max(active) AS active_developers, max(top) AS analysis_period_ticks, max(n_langs) AS total_languages, max(project_bus_factor) AS project_bus_factor FROM c JOIN last ON last.repo_id = c.repo_id LEFT JOIN act ON act.repo_id = c.repo_id LEFT JOIN langs ON langs.repo_id = c.repo_id LEFT JOIN bf ON bf.repo_id = c.repo_id GROUP BY c.repo_id",
    "language_radar": f"WITH {CL}, d AS (SELECT repo_id, author_id, count(*) AS n FROM c GROUP BY repo_id, author_id), dr AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, author_id) AS rk FROM d), s AS (SELECT cl.repo_id, cl.author_id, lang, cast(sum(files) AS bigint) AS files FROM cl JOIN dr ON dr.repo_id = cl.repo_id AND dr.author_id = cl.author_id WHERE rk <= 5 GROUP BY cl.repo_id, cl.author_id, lang) SELECT repo_id, author_id, lang, files, round(files * 1e0 / max(files) OVER (PARTITION BY repo_id, lang), 6) AS share FROM s",
    "anonymised_developers": f"WITH {C}, n AS (SELECT repo_id, author_id, count(*) AS commits FROM c GROUP BY repo_id, author_id) SELECT repo_id, 'Developer-' || cast(row_number() OVER (PARTITION BY repo_id ORDER BY commits DESC, author_id) AS varchar(20)) AS name, commits FROM n",
    # coupling (AG-12 .. AG-18, JN-06, JN-07, FLT-09, TK-02, PL-07, PL-14)
    "file_coupling": f"WITH {P} SELECT repo_id, file1, file2, co_changes, round(strength, 6) AS strength FROM coupled",
    "couples_aggregate": f"WITH {P}, f AS (SELECT repo_id, count(DISTINCT path) AS files, count(DISTINCT author_id) AS developers FROM cf GROUP BY repo_id) SELECT f.repo_id, max(files) AS files, max(developers) AS developers, cast(coalesce(sum(co_changes), 0) AS bigint) AS co_changes, round(coalesce(avg(strength), 0e0), 6) AS avg_strength, COUNTIF(coalesce(co_changes, 0) >= 10) AS highly_coupled FROM f LEFT JOIN coupled ON coupled.repo_id = f.repo_id GROUP BY f.repo_id",
    "developer_coupling": f"WITH {D} SELECT repo_id, dev1, dev2, shared_changes, round(strength, 6) AS strength FROM devpairs",
    "top_developer_matrix": f"WITH {D}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, author_id) AS rk FROM own), top AS (SELECT repo_id, author_id FROM r WHERE rk <= 20) SELECT s.repo_id, dev1, dev2, shared_changes FROM shared s JOIN top a ON a.repo_id = s.repo_id AND a.author_id = dev1 JOIN top b ON b.repo_id = s.repo_id AND b.author_id = dev2",
    "file_ownership": f"WITH {CF}, n AS (SELECT repo_id, path, author_id, count(*) AS k FROM cf GROUP BY repo_id, path, author_id), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY k DESC, author_id) AS rk FROM n) SELECT repo_id, path, count(*) AS contributors, max(CASE WHEN rk = 1 THEN author_id END) AS top_contributor, cast(sum(k) AS bigint) AS revisions FROM r GROUP BY repo_id, path",
    "ownership_buckets": f"WITH {CF}, n AS (SELECT repo_id, path, count(DISTINCT author_id) AS k FROM cf GROUP BY repo_id, path), b AS (SELECT repo_id, CASE WHEN k <= 1 THEN '1' WHEN k <= 3 THEN '2-3' WHEN k <= 5 THEN '4-5' ELSE '6+' END AS bucket FROM n) SELECT repo_id, bucket, count(*) AS files FROM b GROUP BY repo_id, bucket",
    # file history (AG-19 .. AG-23, FLT-10, TK-03)
    "hotspots": f"WITH {FH} SELECT repo_id, path, commits, {_HOT} AS risk FROM churned WHERE commits >= 15",
    "file_history_aggregate": f"WITH {FH}, k AS (SELECT repo_id, count(DISTINCT author_id) AS contributors FROM cf GROUP BY repo_id) SELECT churned.repo_id, count(*) AS files, cast(sum(commits) AS bigint) AS revisions, max(k.contributors) AS contributors, round(avg(commits), 6) AS avg_commits, round(avg(churned.contributors), 6) AS avg_contributors, COUNTIF(commits >= 15) AS high_churn FROM churned JOIN k ON k.repo_id = churned.repo_id GROUP BY churned.repo_id",
    "file_revisions": f"WITH {H} SELECT repo_id, path, count(*) AS revisions, min(idx) AS first_idx, max(idx) AS last_idx FROM hist GROUP BY repo_id, path",
    "current_files": f"WITH {H}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY idx DESC, change_id DESC) AS rk FROM act) SELECT repo_id, path FROM r WHERE rk = 1 AND change_kind <> 'delete'",
    "renames": "SELECT repo_id, commit_id, from_path, to_path FROM file_changes WHERE from_path <> to_path",
    # anomalies (AG-33 .. AG-37, WN-04, JN-17, UDF-05, TK-04)
    "anomaly_ticks": f"WITH {M} SELECT repo_id, tick, commits, files_changed, lines_added, lines_removed, net_churn, languages, authors, {_ZCOLS}, round(max_z, 6) AS max_z, max_z > 2e0 AS flagged FROM zz",
    "anomalies": f"WITH {M} SELECT repo_id, tick, {_ZCOLS}, round(max_z, 6) AS max_z FROM zz WHERE max_z > 2e0",
    "anomaly_aggregate": f"WITH {M} SELECT repo_id, count(*) AS ticks, COUNTIF(max_z > 2e0) AS anomalies, round(1e2 * COUNTIF(max_z > 2e0) / count(*), 6) AS rate, round(avg(net_churn), 6) AS churn_mean, round(stddev_pop(net_churn), 6) AS churn_sd, round(avg(files_changed), 6) AS files_mean, round(stddev_pop(files_changed), 6) AS files_sd, round(avg(languages), 6) AS languages_mean, round(avg(authors), 6) AS authors_mean FROM zz GROUP BY repo_id",
    "external_anomalies": f"WITH {QT}, series AS (SELECT repo_id, tick, 'complexity_median' AS dim, complexity_median AS v FROM qt UNION ALL SELECT repo_id, tick, 'complexity_p95', complexity_p95 FROM qt UNION ALL SELECT repo_id, tick, 'volume_median', volume_median FROM qt UNION ALL SELECT repo_id, tick, 'bugs', bugs FROM qt UNION ALL SELECT repo_id, tick, 'comment_min', comment_min FROM qt UNION ALL SELECT repo_id, tick, 'cohesion_min', cohesion_min FROM qt), "
    + "zs AS (SELECT repo_id, tick, dim, v, "
    + _z("v").replace("PARTITION BY repo_id ORDER BY", "PARTITION BY repo_id, dim ORDER BY")
    + " AS z FROM series WHERE v IS NOT NULL) SELECT repo_id, dim, tick, round(v, 6) AS value, round(z, 4) AS z FROM zs WHERE abs(round(z, 4)) > 2e0",
    # quality (AG-38 .. AG-40, PL-01, PL-02, SC-12)
    "quality_ticks": f"WITH {QT} SELECT repo_id, tick, files, round(complexity_mean, 9) AS complexity_mean, round(complexity_median, 9) AS complexity_median, round(complexity_p95, 9) AS complexity_p95, complexity_max, round(comment_mean, 9) AS comment_mean, comment_min, round(doc_mean, 9) AS doc_mean, round(cohesion_mean, 9) AS cohesion_mean, cohesion_min, round(bugs, 9) AS bugs FROM qt",
    "quality_aggregate": f"WITH {QT} SELECT repo_id, count(*) AS ticks, cast(sum(files) AS bigint) AS files, round(avg(complexity_mean), 6) AS complexity_mean, round(avg(complexity_median), 6) AS complexity_median, max(complexity_max) AS complexity_max, round(avg(comment_mean), 6) AS comment_mean, min(comment_min) AS comment_min, min(cohesion_min) AS cohesion_min FROM qt GROUP BY repo_id",
    "cohesion_boxes": f"WITH {Q}, d AS (SELECT repo_id, replace(file_path, '/' || TAIL(file_path, '/'), '') AS dir, cohesion FROM q WHERE cohesion IS NOT NULL), b AS (SELECT repo_id, dir, count(*) AS n, min(cohesion) AS lo, PCT(cohesion, 25e-2) AS q1, PCT(cohesion, 5e-1) AS med, PCT(cohesion, 75e-2) AS q3, max(cohesion) AS hi FROM d GROUP BY repo_id, dir HAVING count(*) >= 3), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY med, dir) AS rk FROM b) SELECT repo_id, dir, n, lo, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3, hi FROM r WHERE rk <= 15",
    "cohesion_histogram": f"WITH {Q} SELECT repo_id, cast(least(floor(cohesion * 1e1), 9e0) AS bigint) AS bin, count(*) AS files FROM q WHERE cohesion IS NOT NULL GROUP BY repo_id, cast(least(floor(cohesion * 1e1), 9e0) AS bigint)",
    # sentiment (AG-41 .. AG-45, FLT-12, SC-06, SC-07)
    "sentiment_series": f"WITH {S} SELECT repo_id, tick, comments, round(score, 6) AS score, {_MOOD} AS mood FROM st",
    "sentiment_low": f"WITH {S} SELECT repo_id, tick, round(score, 6) AS score, CASE WHEN score <= 2e-1 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM st WHERE score <= 4e-1",
    "sentiment_aggregate": f"WITH {S} SELECT repo_id, count(*) AS ticks, cast(sum(comments) AS bigint) AS comments, COUNTIF(score >= 6e-1) AS positive, COUNTIF(score <= 4e-1) AS negative, round(avg(score), 6) AS mean_score FROM st GROUP BY repo_id",
    "sentiment_trend": f"WITH {S}, f AS (SELECT repo_id, count(*) AS n, min(tick) AS t0, max(tick) AS t1, avg(score) AS mean, coalesce(regr_slope(score, tick), 0e0) AS slope, avg(tick) AS tm FROM st GROUP BY repo_id) SELECT repo_id, round(mean + slope * (t0 - tm), 5) AS start_score, round(mean + slope * (t1 - tm), 5) AS end_score, CASE WHEN slope * (t1 - t0) > 1e-1 THEN 'improving' WHEN slope * (t1 - t0) < -1e-1 THEN 'declining' ELSE 'stable' END AS trend FROM f",
    # merged series and set operations (JN-01 .. JN-03, SO-01 .. SO-06, AG-11)
    "commit_series": f"WITH {CF}, {Q}, a AS (SELECT commit_id, count(*) AS n_files FROM cf GROUP BY commit_id), b AS (SELECT commit_id, round(avg(complexity), 6) AS complexity, max(max_complexity) AS max_complexity FROM q GROUP BY commit_id) SELECT c.repo_id, c.commit_id, c.tick, c.author_id, n_files, complexity, max_complexity, net_churn FROM c LEFT JOIN a ON a.commit_id = c.commit_id LEFT JOIN b ON b.commit_id = c.commit_id WHERE n_files IS NOT NULL OR complexity IS NOT NULL",
    "analysed_commits": f"WITH {C} SELECT commit_id FROM c WHERE files_changed > 0 UNION SELECT commit_id FROM file_quality UNION SELECT commit_id FROM file_changes",
    "unanalysed_commits": f"WITH {C} SELECT commit_id FROM c EXCEPT SELECT commit_id FROM file_changes",
    "changed_and_measured": "SELECT repo_id, prog_lang FROM file_quality INTERSECT SELECT repo_id, prog_lang FROM file_changes",
    # an author and a tick in one number: 14 bits of tick, the author above them (SC-17)
    "packed_people": f"WITH {C}, p AS (SELECT commit_id, author_id * 16384 + tick % 16384 AS packed FROM c) SELECT commit_id, packed, cast(floor(packed / 16384e0) AS bigint) AS author_id, packed % 16384 AS tick FROM p",
    # change filters (FLT-01 .. FLT-11, SC-04, SC-10, SC-18, PRJ-08)
    "text_lines": "SELECT change_id, cast(length(after_text) - length(replace(after_text, chr(10), '')) + CASE WHEN after_text = '' OR after_text LIKE '%' || chr(10) THEN 0 ELSE 1 END AS bigint) AS lines, length(replace(after_text, chr(10), '')) > 0 AS has_text FROM file_changes WHERE after_text IS NOT NULL AND change_kind IN ('insert', 'modify')",
    "change_languages": "SELECT repo_id, coalesce(prog_lang, 'Other') AS lang, change_kind, count(*) AS changes FROM file_changes GROUP BY repo_id, coalesce(prog_lang, 'Other'), change_kind",
    # functions that change together (AG-46 .. AG-50, JN-08): a function changes when its file does
    "node_hotness": f"WITH {CF}, fn AS (SELECT DISTINCT repo_id, file_path FROM function_metrics), t AS (SELECT cf.repo_id, cf.path, count(DISTINCT commit_id) AS changes FROM cf JOIN fn ON fn.repo_id = cf.repo_id AND fn.file_path = cf.path GROUP BY cf.repo_id, cf.path) SELECT repo_id, path, changes, round(changes * 1e0 / max(changes) OVER (PARTITION BY repo_id), 6) AS score, CASE WHEN changes >= 20 THEN 'HIGH' WHEN changes >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM t",
    "node_coupling": f"WITH {P} SELECT pairs.repo_id, file1, file2, co_changes, round(co_changes * 1e0 / greatest(co_changes, s1.n, s2.n), 6) AS strength FROM pairs JOIN selfs s1 ON s1.repo_id = pairs.repo_id AND s1.path = file1 JOIN selfs s2 ON s2.repo_id = pairs.repo_id AND s2.path = file2 WHERE co_changes >= 3",
    # summaries of external series, merged partial states, top lists (AG-37, SO-02, TK-09, TK-10)
    "external_summaries": f"WITH {QT}, series AS (SELECT repo_id, tick, 'complexity_median' AS dim, complexity_median AS v FROM qt UNION ALL SELECT repo_id, tick, 'bugs', bugs FROM qt UNION ALL SELECT repo_id, tick, 'cohesion_min', cohesion_min FROM qt) SELECT repo_id, dim, count(v) AS ticks, round(avg(v), 9) AS mean, round(stddev_pop(v), 7) AS sd, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM series GROUP BY repo_id, dim",
    "merged_states": f"WITH {C}, parts AS (SELECT repo_id, author_id, count(*) AS n FROM c WHERE idx % 2 = 0 GROUP BY repo_id, author_id UNION ALL SELECT repo_id, author_id, count(*) AS n FROM c WHERE idx % 2 = 1 GROUP BY repo_id, author_id) SELECT repo_id, author_id, cast(sum(n) AS bigint) AS commits FROM parts GROUP BY repo_id, author_id",
    "top_files": f"WITH {FH}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY commits DESC, path) AS place FROM churned) SELECT repo_id, path, commits, cast(place AS bigint) AS place FROM r WHERE place <= 20",
    "top_couplings": f"WITH {P}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY co_changes DESC, file1, file2) AS place FROM coupled) SELECT repo_id, file1, file2, co_changes, cast(place AS bigint) AS place FROM r WHERE place <= 7",
    # chained renames (JN-13): the first name of every renamed path; a hop follows an earlier one, so chains end however long they are
    "rename_lineage": f"WITH RECURSIVE {C}, hop AS (SELECT DISTINCT f.repo_id, from_path, to_path, c.idx FROM file_changes f JOIN c ON c.commit_id = f.commit_id WHERE from_path <> to_path), chain AS (SELECT repo_id, from_path AS first_path, to_path, 1 AS depth, idx FROM hop UNION ALL SELECT chain.repo_id, first_path, hop.to_path, depth + 1, hop.idx FROM chain JOIN hop ON hop.repo_id = chain.repo_id AND hop.from_path = chain.to_path AND hop.idx > chain.idx) SELECT repo_id, first_path, to_path AS last_path, cast(max(depth) AS bigint) AS renames FROM chain GROUP BY repo_id, first_path, to_path",
    # sentiment classes and change sizes for charts (PL-14, PL-10)
    "sentiment_classes": f"WITH {S} SELECT repo_id, {_MOOD} AS mood, count(*) AS ticks FROM st GROUP BY repo_id, {_MOOD}",
    "mailmap": f"WITH {_NAMES} SELECT name, count(*) AS ids, min(dev_id) AS first_id FROM names GROUP BY name",
}

QUERIES, SQL = register(PLANS)
