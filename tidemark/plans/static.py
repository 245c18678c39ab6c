"""Static measures: complexity, size and effort of functions, cohesion, documentation, imports, and folder roll-ups."""

from __future__ import annotations

from tidemark.plans.declared import register

#: Functions once each.
F = "f AS (SELECT DISTINCT * FROM function_metrics)"
Q = "q AS (SELECT DISTINCT * FROM file_quality)"
_DENSITY = "CASE WHEN lines_of_code > 0 THEN cyclomatic_complexity * 1e0 / lines_of_code ELSE 0e0 END"
_POINTS = "CASE WHEN cyclomatic_complexity >= 10 THEN 2 WHEN cyclomatic_complexity >= 5 THEN 1 ELSE 0 END + CASE WHEN cognitive_complexity >= 15 THEN 2 WHEN cognitive_complexity >= 7 THEN 1 ELSE 0 END + CASE WHEN nesting_depth >= 5 THEN 2 WHEN nesting_depth >= 3 THEN 1 ELSE 0 END"
_RISK = f"CASE WHEN {_POINTS} >= 5 THEN 'CRITICAL' WHEN {_POINTS} >= 3 THEN 'HIGH' WHEN {_POINTS} >= 1 THEN 'MEDIUM' ELSE 'LOW' END"


def health(average: str) -> str:
    """Health score of an average cyclomatic complexity: 100 up to 1, then piecewise down to 0."""
    return f"CASE WHEN {average} <= 1e0 THEN 1e2 WHEN {average} <= 3e0 THEN 8e1 + (3e0 - {average}) * 1e1 WHEN {average} <= 7e0 THEN 5e1 + (7e0 - {average}) * 75e-1 ELSE greatest(0e0, 5e1 - ({average} - 7e0) * 5e0) END"


_LEVEL = "CASE WHEN volume >= 5e3 THEN 'Very High' WHEN volume >= 1e3 THEN 'High' WHEN volume >= 1e2 THEN 'Medium' ELSE 'Low' END"
_VOLUME_HEALTH = "CASE WHEN v < 1e2 THEN 1e2 WHEN v < 1e3 THEN 7e1 + (1e3 - v) / 9e2 * 3e1 WHEN v < 5e3 THEN 3e1 + (5e3 - v) / 4e3 * 4e1 ELSE greatest(0e0, 3e1 - (v - 5e3) / 1e3 * 1e1) END"
_COHESION = "CASE WHEN cohesion >= 6e-1 THEN 'Excellent' WHEN cohesion >= 4e-1 THEN 'Good' WHEN cohesion >= 3e-1 THEN 'Fair' ELSE 'Poor' END"
_DOCUMENTED = "CASE WHEN doc_coverage <= 0e0 THEN 'Undocumented' WHEN doc_coverage >= 6e-1 THEN 'Well Documented' WHEN doc_coverage >= 3e-1 THEN 'Partially Documented' ELSE 'Poorly Documented' END"
_IMPORT_RISK = "CASE WHEN length(imp) - length(replace(imp, '/', '')) >= 5 THEN 'LOW' WHEN (length(imp) - length(replace(imp, '..', ''))) / 2 >= 3 THEN 'MEDIUM' ELSE '' END"
_Q = "[\"' || chr(39) || ']"
_ALL = lambda lang, pattern, text="text": f"SELECT change_id, repo_id, prog_lang, EXPLODE(regexp_extract_all({text}, '{pattern}', 1)) AS imp FROM src WHERE prog_lang = '{lang}'"
#: Imported paths, one per file and import: every name of a list, blocks of imports, and no lines that only look like imports.
I = f"""src AS (SELECT change_id, repo_id, prog_lang, replace(after_text, chr(13), '') AS text FROM file_changes WHERE after_text IS NOT NULL),
listed AS ({_ALL("python", "(?m)^[ ]*import +([A-Za-z0-9_., ]+)")}),
named AS (SELECT change_id, repo_id, prog_lang, EXPLODE(string_split(imp, ',')) AS imp FROM listed),
block AS ({_ALL("go", "(?m)^import *[(]([^)]*)[)]")}),
im0 AS (SELECT change_id, repo_id, prog_lang, split_part(trim(imp), ' ', 1) AS imp FROM named
UNION ALL {_ALL("python", "(?m)^[ ]*from +([A-Za-z0-9_.]+) +import")}
UNION ALL {_ALL("java", "(?m)^[ ]*import +(?:static +)?([A-Za-z0-9_.*]+) *;")}
UNION ALL {_ALL("c", '(?m)^[ ]*# *include *[<"]([^>"]+)[>"]')}
UNION ALL {_ALL("javascript", f"require[(]{_Q}([^\"]+?){_Q}[)]")}
UNION ALL {_ALL("javascript", f"(?m)^[ ]*import [^;]*?{_Q}([^;\"]+?){_Q}")}
UNION ALL {_ALL("go", '(?m)^import +(?:[A-Za-z_.]+ +)?"([^"]+)"')}
UNION ALL SELECT change_id, repo_id, prog_lang, EXPLODE(regexp_extract_all(imp, '"([^"]+)"', 1)) AS imp FROM block),
im AS (SELECT DISTINCT change_id, repo_id, prog_lang, imp FROM im0 WHERE imp IS NOT NULL AND imp <> '')"""
#: First segments of standard imports; fixed values.
_STANDARD = "fmt os io net http encoding sync context time strings bytes bufio path filepath regexp sort math sys typing collections itertools functools json re fs util events stream crypto https".split()
_CATEGORY = "CASE WHEN imp LIKE '.%' OR imp LIKE '/%' THEN 'relative' WHEN split_part(imp, '/', 1) IN (" + ", ".join(f"'{w}'" for w in _STANDARD) + ") THEN 'stdlib' ELSE 'external' END"

PLANS = {
    # complexity (ST-06 .. ST-09, ST-27, PL-10, TK-05, TK-08)
    "function_complexity": f"WITH {F} SELECT function_id, repo_id, function_name, cyclomatic_complexity, cognitive_complexity, nesting_depth, lines_of_code, round({_DENSITY}, 6) AS density, {_RISK} AS risk FROM f",
    "complexity_distribution": f"WITH {F} SELECT repo_id, CASE WHEN cyclomatic_complexity <= 5 THEN 'simple' WHEN cyclomatic_complexity <= 10 THEN 'moderate' ELSE 'complex' END AS level, count(*) AS functions FROM f WHERE cyclomatic_complexity IS NOT NULL GROUP BY repo_id, CASE WHEN cyclomatic_complexity <= 5 THEN 'simple' WHEN cyclomatic_complexity <= 10 THEN 'moderate' ELSE 'complex' END",
    "high_risk_functions": f"WITH {F} SELECT function_id, concat_ws(', ', CASE WHEN cyclomatic_complexity >= 10 THEN 'cyclomatic' END, CASE WHEN cognitive_complexity >= 15 THEN 'cognitive' END, CASE WHEN nesting_depth >= 5 THEN 'nesting' END) AS issues FROM f WHERE cyclomatic_complexity >= 10 OR cognitive_complexity >= 15 OR nesting_depth >= 5",
    "complexity_aggregate": f"WITH {F}, a AS (SELECT repo_id, count(*) AS functions, avg(cyclomatic_complexity) AS mean, max(cyclomatic_complexity) AS most, avg(cognitive_complexity) AS cognitive, max(nesting_depth) AS deepest FROM f GROUP BY repo_id) SELECT repo_id, functions, round(mean, 6) AS mean, most, round(cognitive, 6) AS cognitive, deepest, round({health('mean')}, 6) AS health FROM a",
    "top_issues": f"WITH {F}, r AS (SELECT repo_id, function_id, cyclomatic_complexity, row_number() OVER (PARTITION BY repo_id ORDER BY cyclomatic_complexity DESC NULLS LAST, cognitive_complexity DESC NULLS LAST, nesting_depth DESC NULLS LAST, function_id) AS place FROM f) SELECT repo_id, function_id, cyclomatic_complexity, cast(place AS bigint) AS place FROM r WHERE place <= 10",
    # size and effort (ST-11 .. ST-13, SC-14, TK-06)
    "function_halstead": f"WITH {F} SELECT function_id, volume, difficulty, effort, {_LEVEL} AS level, round(effort / 18e0, 4) AS seconds, round(volume / 3e3, 8) AS bugs FROM f WHERE volume IS NOT NULL",
    "high_effort_functions": f"WITH {F} SELECT function_id, effort, CASE WHEN volume >= 5e3 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM f WHERE volume >= 1e3",
    "halstead_aggregate": f"WITH {F}, a AS (SELECT repo_id, count(*) AS functions, sum(volume) / count(*) AS v, avg(difficulty) AS difficulty, COUNTIF(volume >= 5e3) AS very_high FROM f GROUP BY repo_id) SELECT repo_id, functions, round(v, 4) AS mean_volume, round(difficulty, 4) AS difficulty, very_high, round({_VOLUME_HEALTH}, 6) AS health FROM a",
    "halstead_distribution": f"WITH {F} SELECT repo_id, {_LEVEL} AS level, count(*) AS functions FROM f WHERE volume IS NOT NULL GROUP BY repo_id, {_LEVEL}",
    # cohesion and documentation (ST-15 .. ST-17, ST-20, ST-21, PL-11)
    "cohesion_distribution": f"WITH {Q} SELECT repo_id, {_COHESION} AS level, count(*) AS files FROM q WHERE cohesion IS NOT NULL GROUP BY repo_id, {_COHESION}",
    "low_cohesion_files": f"WITH {Q} SELECT DISTINCT repo_id, commit_id, file_path, cohesion, CASE WHEN cohesion < 3e-1 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM q WHERE cohesion < 4e-1",
    "documentation": f"WITH {Q} SELECT repo_id, {_DOCUMENTED} AS status, count(*) AS files, round(avg(comment_score), 9) AS comment_score FROM q WHERE doc_coverage IS NOT NULL GROUP BY repo_id, {_DOCUMENTED}",
    # folder roll-ups and scores (ST-24 .. ST-26, ST-29, ST-30)
    "folder_rollup": f"WITH {F}, d AS (SELECT repo_id, split_part(file_path, '/', 1) AS folder, file_path, count(*) AS functions, avg(cyclomatic_complexity) AS mean FROM f GROUP BY repo_id, split_part(file_path, '/', 1), file_path) SELECT repo_id, folder, count(*) AS files, cast(sum(functions) AS bigint) AS functions, round(avg(mean), 6) AS mean_complexity FROM d GROUP BY repo_id, folder",
    "last_functions": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, file_path, function_name ORDER BY function_id DESC) AS rk FROM function_metrics) SELECT repo_id, file_path, function_name, max(function_id) AS function_id FROM r WHERE rk = 1 GROUP BY repo_id, file_path, function_name",
    "executive_summary": f"WITH {F}, {Q}, a AS (SELECT repo_id, avg(cyclomatic_complexity) AS m, avg(difficulty) AS d FROM f GROUP BY repo_id), b AS (SELECT repo_id, avg(cohesion) AS coh, avg(comment_score) AS com FROM q GROUP BY repo_id), s AS (SELECT a.repo_id, CASE WHEN m <= 1e0 THEN 1e0 WHEN m <= 3e0 THEN 8e-1 WHEN m <= 5e0 THEN 6e-1 WHEN m <= 7e0 THEN 4e-1 WHEN m <= 1e1 THEN 2e-1 ELSE 1e-1 END AS s1, CASE WHEN d <= 5e0 THEN 1e0 WHEN d <= 15e0 THEN 8e-1 WHEN d <= 3e1 THEN 6e-1 ELSE 3e-1 END AS s2, coh, com FROM a LEFT JOIN b ON b.repo_id = a.repo_id) SELECT repo_id, s1 AS complexity_score, s2 AS effort_score, round(coh, 6) AS cohesion_score, round(com, 6) AS comment_score, round((s1 + s2 + coalesce(coh, 0e0) + coalesce(com, 0e0)) / (2 + CASE WHEN coh IS NULL THEN 0 ELSE 1 END + CASE WHEN com IS NULL THEN 0 ELSE 1 END), 6) AS overall FROM s",
    # imports (ST-22, ST-23, ST-28, SC-08, SC-09, AG-54, PL-08)
    "import_list": f"WITH {I} SELECT change_id, imp, {_CATEGORY} AS category, {_IMPORT_RISK} AS risk FROM im",
    "import_categories": f"WITH {I} SELECT repo_id, {_CATEGORY} AS category, count(*) AS imports, count(DISTINCT imp) AS distinct_imports FROM im GROUP BY repo_id, {_CATEGORY}",
    "import_usage": f"WITH {I} SELECT prog_lang, split_part(replace(imp, '.', '/'), '/', 1) AS dependency, count(*) AS uses, count(DISTINCT repo_id) AS repositories FROM im GROUP BY prog_lang, split_part(replace(imp, '.', '/'), '/', 1)",
    "imports_by_author": f"WITH {I}, c AS (SELECT commit_id, min(author_id) AS author_id, min(tick) AS tick FROM commits GROUP BY commit_id) SELECT im.repo_id, author_id, im.prog_lang, imp, tick, count(*) AS n FROM im JOIN file_changes fc ON fc.change_id = im.change_id JOIN c ON c.commit_id = fc.commit_id GROUP BY im.repo_id, author_id, im.prog_lang, imp, tick",
    # gaps and islands over recorded ticks (WN-06), interpolation (WN-12), tumbling windows (STR-7)
    "active_spells": "WITH t AS (SELECT DISTINCT repo_id, tick FROM tick_metrics), g AS (SELECT repo_id, tick, CASE WHEN tick - lag(tick) OVER (PARTITION BY repo_id ORDER BY tick) <= 1 THEN 0 ELSE 1 END AS opens FROM t), i AS (SELECT repo_id, tick, sum(opens) OVER (PARTITION BY repo_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spell FROM g) SELECT repo_id, min(tick) AS first_tick, max(tick) AS last_tick, count(*) AS ticks FROM i GROUP BY repo_id, spell",
    "smooth_churn": "WITH t AS (SELECT repo_id, tick, min(net_churn) AS v FROM tick_metrics GROUP BY repo_id, tick), n AS (SELECT repo_id, tick, v, lead(tick) OVER (PARTITION BY repo_id ORDER BY tick) AS t2, lead(v) OVER (PARTITION BY repo_id ORDER BY tick) AS v2 FROM t), k AS (SELECT repo_id, tick, v, t2, v2, EXPLODE(RANGE5()) AS k FROM n) SELECT repo_id, tick, k, round(v + (v2 - v) * k / 5e0, 6) AS value FROM k WHERE t2 IS NOT NULL AND v IS NOT NULL AND v2 IS NOT NULL",
    "event_windows": "SELECT cast(floor(MICROS(ts) / 36e8) AS bigint) AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY cast(floor(MICROS(ts) / 36e8) AS bigint), event_type",
    # nearest target (JN-12): the next release note after each issue of a repository
    "nearest_following": "WITH a AS (SELECT doc_id, repo_id, MICROS(created_at) AS us FROM documents WHERE repo_id IS NOT NULL AND created_at IS NOT NULL AND doc_kind = 'issue'), u AS (SELECT doc_id, repo_id, us, cast(NULL AS bigint) AS target FROM a UNION ALL SELECT doc_id, repo_id, MICROS(created_at), doc_id FROM documents WHERE repo_id IS NOT NULL AND created_at IS NOT NULL AND doc_kind = 'release_note'), w AS (SELECT *, min(CASE WHEN target IS NOT NULL THEN us END) OVER (PARTITION BY repo_id ORDER BY us DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS next_us FROM u) SELECT doc_id, repo_id, next_us - us AS gap FROM w WHERE target IS NULL",
    # scalar functions (SC-01, SC-13, SC-16 .. SC-18)
    "scalars": "SELECT change_id, cast(levenshtein(coalesce(from_path, ''), coalesce(to_path, '')) AS bigint) AS path_edits, TAIL(coalesce(to_path, from_path), '/') AS base, concat_ws('|', lower(change_kind), coalesce(prog_lang, 'none')) AS tag, least(greatest(coalesce(size_bytes, 0) / 4e3, 0e0), 1e0) AS filled, coalesce(size_bytes, 0) / nullif(length(after_text), 0) AS ratio FROM file_changes",
    "long_identifiers": "SELECT dev_id, lower(dev_name) || ' <' || lower(coalesce(email, '')) || '>' AS exact_key, coalesce(lower(email), lower(dev_name)) AS loose_key FROM developers",
    "people": "WITH k AS (SELECT repo_id, coalesce(lower(email), lower(dev_name)) AS person, dev_name, dev_id FROM developers WHERE repo_id IS NOT NULL) SELECT repo_id, person, min(dev_id) AS id, count(DISTINCT dev_name) AS names, min(dev_name) AS first_name FROM k GROUP BY repo_id, person",
    # charts over functions (PL-09, PL-10)
    "function_hierarchy": f"WITH {F}, n AS (SELECT repo_id, file_path, count(*) AS functions, max(cyclomatic_complexity) AS most FROM f GROUP BY repo_id, file_path), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY functions DESC, file_path) AS place FROM n) SELECT repo_id, file_path, functions, most FROM r WHERE place <= 30",
    "scatter_classes": f"WITH {F} SELECT repo_id, CASE WHEN volume >= 1e3 THEN 'large' ELSE 'small' END AS size, CASE WHEN cyclomatic_complexity > 10 THEN 'complex' ELSE 'simple' END AS shape, count(*) AS functions FROM f WHERE volume IS NOT NULL AND cyclomatic_complexity IS NOT NULL GROUP BY repo_id, CASE WHEN volume >= 1e3 THEN 'large' ELSE 'small' END, CASE WHEN cyclomatic_complexity > 10 THEN 'complex' ELSE 'simple' END",
    "top_efforts": f"WITH {F}, r AS (SELECT repo_id, function_id, row_number() OVER (PARTITION BY repo_id ORDER BY effort DESC NULLS LAST, function_id) AS place FROM f) SELECT repo_id, function_id, cast(place AS bigint) AS place FROM r WHERE place <= 12",
    "complexity_ratio": f"WITH {F} SELECT repo_id, cast(sum(cyclomatic_complexity) AS bigint) AS total, round(sum(cyclomatic_complexity) * 1e0 / count(cyclomatic_complexity), 9) AS average, max(cyclomatic_complexity) AS most FROM f GROUP BY repo_id",
}

QUERIES, SQL = register(PLANS)
