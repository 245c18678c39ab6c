"""Line survival rolled up from the replayed ledger, and amounts per language, author and path from the lines of each change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.sources_plans import line_stats, survival_ledger
from tidemark.session import settle
from tidemark.sources import table

#: Ticks of a sample and of a band.
SPAN = 30
_PEAK = "tops AS (SELECT {keys}, band, max(lines) AS top FROM dense GROUP BY {keys}, band), peak AS (SELECT {keys}, cast(sum(greatest(top, 0)) AS bigint) AS peak FROM tops GROUP BY {keys})"


def _dense(keys: str) -> str:
    """CTE dense: lines of each band at each sample up to the repository's last tick, carried forward; bands begin when they are written."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    of = lambda a: ", ".join(f"{a}.{k}" for k in keys.split(", "))
    return f"""summed AS (SELECT {keys}, cast(floor(cur_tick / {SPAN}) AS bigint) AS sample, cast(floor(orig_tick / {SPAN}) AS bigint) AS band, sum(delta) AS delta FROM {{led}} GROUP BY ALL),
bands AS (SELECT {keys}, band, min(sample) AS since FROM summed GROUP BY {keys}, band),
grid AS (SELECT {of("bands")}, band, explode(sequence(since, cast(floor(top / {SPAN}) AS bigint))) AS sample FROM bands JOIN {{last}} AS l ON l.repo_id = bands.repo_id),
dense AS (SELECT {of("g")}, g.sample, g.band, cast(sum(coalesce(delta, 0)) OVER (PARTITION BY {of("g")}, g.band ORDER BY g.sample) AS bigint) AS lines FROM grid g LEFT JOIN summed s ON {on("s", "g")} AND s.sample = g.sample AND s.band = g.band)"""


_REPO, _DEV = _dense("repo_id"), _dense("repo_id, orig_author")
_NOW = "now AS (SELECT d.*, top FROM dense d JOIN {last} AS l ON l.repo_id = d.repo_id AND sample = floor(top / 30) WHERE lines > 0)"
ROLLUPS = {
    # AG-27, WN-09
    "survival_dense": f"WITH {_REPO} SELECT repo_id, sample, band, lines FROM dense",
    # AG-28
    "survival_global": f"WITH {_REPO}, {_PEAK.format(keys='repo_id')} SELECT d.repo_id, sample, cast(sum(greatest(lines, 0)) AS bigint) AS total, round(sum(greatest(lines, 0)) * 1e0 / max(peak), 6) AS rate FROM dense d JOIN peak ON peak.repo_id = d.repo_id GROUP BY d.repo_id, sample",
    # AG-29
    "survival_files": "WITH o AS (SELECT repo_id, path, orig_author, sum(delta) AS lines FROM {led} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY lines DESC, orig_author) AS rk, sum(lines) OVER (PARTITION BY repo_id, path) AS total FROM o WHERE lines > 0) SELECT repo_id, path, orig_author AS top_owner, lines, round(1e2 * lines / total, 6) AS pct FROM r WHERE rk = 1",
    # AG-30: the peak is all that the developer wrote, band by band
    "survival_developers": f"WITH {_DEV}, {_PEAK.format(keys='repo_id, orig_author')}, {_NOW}, n AS (SELECT repo_id, orig_author, sum(lines) AS lines FROM now GROUP BY repo_id, orig_author) SELECT p.repo_id, p.orig_author AS author_id, coalesce(lines, 0) AS current_lines, peak, CASE WHEN peak > 0 THEN round(coalesce(lines, 0) * 1e0 / peak, 6) ELSE 0e0 END AS rate FROM peak p LEFT JOIN n ON n.repo_id = p.repo_id AND n.orig_author = p.orig_author",
    # AG-31: self is what was written; removals stand under whoever removed
    "survival_interaction": "SELECT repo_id, orig_author, CASE WHEN author_id = orig_author AND delta > 0 THEN 'self' WHEN author_id = 262142 THEN 'unknown' ELSE cast(author_id AS string) END AS modifier, sum(delta) AS lines FROM {led} WHERE NOT moved GROUP BY ALL",
    # AG-32
    "survival_aggregate": f"WITH {_REPO}, {_PEAK.format(keys='repo_id')}, {_NOW}, n AS (SELECT repo_id, sum(lines) AS lines FROM now GROUP BY repo_id), d AS (SELECT repo_id, count(DISTINCT sample) AS samples, count(DISTINCT band) AS bands, (count(DISTINCT sample) - 1) * {SPAN} AS days FROM dense GROUP BY repo_id), "
    "w AS (SELECT repo_id, count(DISTINCT path) AS files, count(DISTINCT orig_author) AS developers FROM {led} GROUP BY repo_id) SELECT d.repo_id, samples, bands, days, coalesce(lines, 0) AS current_lines, peak, CASE WHEN peak > 0 THEN round(coalesce(lines, 0) * 1e0 / peak, 6) ELSE 0e0 END AS rate, files, developers FROM d JOIN peak p ON p.repo_id = d.repo_id JOIN w ON w.repo_id = d.repo_id LEFT JOIN n ON n.repo_id = d.repo_id",
    # PL-12
    "survival_age": f"WITH {_REPO}, {_NOW}, a AS (SELECT repo_id, floor(top / {SPAN}) - band AS n, lines FROM now) SELECT repo_id, CASE WHEN n < 1 THEN '<1' WHEN n < 3 THEN '1-3' WHEN n < 6 THEN '3-6' WHEN n < 12 THEN '6-12' ELSE '>12' END AS age, sum(lines) AS lines FROM a GROUP BY ALL",
    # PL-03: a band's lines are spread over its days
    "survival_by_year": f"WITH {_REPO}, {_NOW}, e AS (SELECT repo_id, lines, cast(day0 + band * {SPAN} AS int) AS s0, cast(day0 + (band + 1) * {SPAN} AS int) AS s1 FROM now JOIN {{start}} AS s USING (repo_id)), "
    "y AS (SELECT *, explode(sequence(year(date_from_unix_date(s0)), year(date_from_unix_date(s1 - 1)))) AS y FROM e) "
    f"SELECT repo_id, cast(y AS bigint) AS year, round(sum(lines * (least(s1, unix_date(make_date(y + 1, 1, 1))) - greatest(s0, unix_date(make_date(y, 1, 1)))) / {SPAN}e0), 6) AS lines FROM y GROUP BY repo_id, y",
}


def _commits(spark: SparkSession, folder: str) -> DataFrame:
    """Commits once each."""
    first = F.min_by(F.struct("repo_id", "idx", "tick", "author_id", "committer_ts"), F.struct("received_ts", "idx"))
    return table(spark, folder, "commits").groupBy("commit_id").agg(first.alias("r")).select("commit_id", "r.*")


def rolled(ledger: DataFrame, commits: DataFrame, name: str) -> DataFrame:
    """A roll-up of a ledger (lineage `repo:..`, path, ...) whose repositories' ticks and days are those of commits."""
    repo = F.expr("try_cast(substring_index(lineage, ':', 1) AS bigint)")
    led = ledger.select(repo.alias("repo_id"), "path", "cur_tick", "orig_tick", "author_id", "orig_author", "delta", "moved")
    last = commits.groupBy("repo_id").agg(F.max("tick").alias("top"))
    start = commits.groupBy("repo_id").agg(F.floor(F.min(F.unix_micros(F.col("committer_ts").cast("timestamp"))) / 864e8).alias("day0"))
    every = {"led": led, "last": last, "start": start}
    return ledger.sparkSession.sql(ROLLUPS[name], **{k: v for k, v in every.items() if f"{{{k}}}" in ROLLUPS[name]})


def _rollup(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: rolled(settle(survival_ledger(spark, folder)), _commits(spark, folder), name)


#: Languages by extension: fixed values.
EXTENSIONS = {
    "c": "c", "h": "c", "cc": "c++", "cpp": "c++", "cxx": "c++", "hpp": "c++", "cs": "c#", "css": "css", "dart": "dart", "go": "go", "html": "html", "java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "json": "json", "kt": "kotlin", "lua": "lua", "m": "objective-c", "md": "markdown", "php": "php", "pl": "perl", "proto": "protocol buffer", "py": "python", "r": "r", "rb": "ruby", "rs": "rust", "scala": "scala",
    "sh": "shell", "sql": "sql", "swift": "swift", "toml": "toml", "ts": "typescript", "tsx": "typescript", "xml": "xml", "yaml": "yaml", "yml": "yaml",
}


def language(path: Column) -> Column:
    """The language of a path by its extension, 'other' where it is unknown (SC-10)."""
    base = F.substring_index(path, "/", -1)
    extension = F.when(base.contains("."), F.lower(F.substring_index(base, ".", -1)))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), extension), F.lit("other"))


def changed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Each change of a known commit with its path, language, author and own lines (JN-05)."""
    path = F.coalesce("to_path", "from_path")
    changes = table(spark, folder, "file_changes").select("change_id", "repo_id", "commit_id", path.alias("path"), language(path).alias("lang"))
    known = changes.join(_commits(spark, folder).select("commit_id", "author_id", "tick"), "commit_id").join(line_stats(spark, folder), "change_id", "left")
    return known.fillna(0, ["added", "removed", "changed"])


_RANKED = """contrib AS (SELECT repo_id, lang, author_id, sum(added + removed) AS amount FROM {ch} GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id, lang ORDER BY amount DESC, author_id) AS rk, sum(amount) OVER (PARTITION BY repo_id, lang) AS total, sum(amount) OVER (PARTITION BY repo_id, lang ORDER BY amount DESC, author_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM contrib),
bus AS (SELECT repo_id, lang, min(CASE WHEN upto * 2 >= total THEN rk END) AS bus_factor, count(*) AS contributors, max(CASE WHEN rk = 1 THEN author_id END) AS primary_dev, max(CASE WHEN rk = 1 THEN 1e2 * amount / total END) AS primary_pct, max(CASE WHEN rk = 2 THEN author_id END) AS secondary_dev, max(CASE WHEN rk = 2 THEN 1e2 * amount / total END) AS secondary_pct FROM ranked WHERE total > 0 GROUP BY repo_id, lang)"""
_RISK = "CASE WHEN primary_pct >= 9e1 THEN 'CRITICAL' WHEN primary_pct >= 8e1 THEN 'HIGH' WHEN primary_pct >= 6e1 THEN 'MEDIUM' ELSE 'LOW' END"
AMOUNTS = {
    # AG-05: the languages of each developer
    "developer_languages": "SELECT repo_id, author_id, lang, sum(added) AS added, sum(removed) AS removed, sum(changed) AS changed, count(DISTINCT commit_id) AS commits FROM {ch} GROUP BY ALL",
    # AG-04
    "dev_tick_languages": "SELECT repo_id, tick, author_id, lang, sum(added) AS added, sum(removed) AS removed, sum(changed) AS changed FROM {ch} GROUP BY ALL",
    # AG-06
    "languages": "SELECT repo_id, lang, sum(added) AS total_lines, sum(added + removed) AS contribution, count(DISTINCT author_id) AS contributors FROM {ch} GROUP BY ALL",
    # AG-07, PL-13
    "bus_factor": f"WITH {_RANKED} SELECT repo_id, lang, bus_factor, contributors, primary_dev, round(primary_pct, 6) AS primary_pct, secondary_dev, round(secondary_pct, 6) AS secondary_pct, {_RISK} AS risk FROM bus",
    "bus_factor_risks": f"WITH {_RANKED} SELECT repo_id, {_RISK} AS risk, count(*) AS languages FROM bus GROUP BY ALL",
    # PL-04
    "workload_tree": "WITH s AS (SELECT repo_id, author_id, lang, sum(added) AS added FROM {ch} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, author_id ORDER BY added DESC, lang) AS rk FROM s) SELECT repo_id, lang AS primary_lang, count(*) AS developers, sum(added) AS added FROM r WHERE rk = 1 GROUP BY repo_id, lang",
    # AG-20
    "file_churn": "SELECT repo_id, path, count(DISTINCT commit_id) AS commits, count(DISTINCT author_id) AS contributors, sum(added) AS added, sum(removed) AS removed, sum(changed) AS changed, round(count(DISTINCT commit_id) + sum(added + removed + changed) / 1e2, 6) AS score FROM {ch} GROUP BY ALL",
    # AG-21: who added or changed most lines of a path
    "file_contributors": "WITH k AS (SELECT repo_id, path, author_id, count(DISTINCT commit_id) AS commits, sum(added) AS added, sum(changed) AS changed FROM {ch} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY added + changed DESC, author_id) AS rk FROM k) SELECT repo_id, path, author_id AS top_contributor, commits, added, changed FROM r WHERE rk = 1",
    # what diffs must add up to, whatever they pair
    "change_net_lines": "SELECT change_id, added - removed AS net FROM {ch}",
    "language_net_lines": "SELECT repo_id, lang, sum(added - removed) AS net, count(*) AS changes FROM {ch} GROUP BY ALL",
    "file_net_lines": "SELECT repo_id, path, sum(added - removed) AS net FROM {ch} GROUP BY ALL",
}


def _amount(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: spark.sql(AMOUNTS[name], ch=settle(changed_lines(spark, folder)))


def survival_current(spark: SparkSession, folder: str) -> DataFrame:
    """(repo_id, path, lines): lines standing at the end in paths that the history saw born and never renamed; what the ledger must leave."""
    changes = table(spark, folder, "file_changes").join(_commits(spark, folder).select("commit_id", "idx"), "commit_id")
    renamed = changes.filter("from_path <> to_path").select("repo_id", F.explode(F.array("from_path", "to_path")).alias("path")).distinct()
    born = changes.groupBy("repo_id", F.coalesce("to_path", "from_path").alias("path")).agg(F.min_by("change_kind", F.struct("idx", "change_id")).alias("first")).filter("first = 'insert'")
    led = survival_ledger(spark, folder).select(F.expr("try_cast(substring_index(lineage, ':', 1) AS bigint)").alias("repo_id"), "path", "delta")
    known = born.join(renamed, ["repo_id", "path"], "left_anti").select("repo_id", "path")
    return known.join(led, ["repo_id", "path"], "left").groupBy("repo_id", "path").agg(F.coalesce(F.sum("delta"), F.lit(0)).alias("lines"))


def extension_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Changes with the language of their path (SC-10)."""
    path = F.coalesce("to_path", "from_path")
    return table(spark, folder, "file_changes").select("change_id", language(path).alias("lang"))


def _skipped(path: Column) -> Column:
    """Whether a path starts with one of `skip_files`; empty prefixes and no list skip nothing."""
    return F.coalesce(F.exists("skip_files", lambda p: (p != "") & path.startswith(p)), F.lit(False))


def skipped_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Per repository its changes, and those under a prefix that it skips (FLT-01)."""
    settings = table(spark, folder, "repositories").select("repo_id", "skip_files")
    changes = table(spark, folder, "file_changes").join(settings, "repo_id", "left")
    return changes.groupBy("repo_id").agg(F.count("*").alias("changes"), F.count_if(_skipped(F.coalesce("to_path", "from_path"))).alias("skipped"))


def change_filter(spark: SparkSession, folder: str, largest: int = 1 << 20) -> DataFrame:
    """Changes that the path settings of their repository leave: no skipped prefix, the keep-pattern if there is one, up to `largest` bytes (FLT-01, FLT-02, FLT-04, FLT-06, SRC-18)."""
    settings = table(spark, folder, "repositories").select("repo_id", "skip_files", "name_filter")
    changes = table(spark, folder, "file_changes").select("change_id", "repo_id", "change_kind", "from_path", "to_path", "size_bytes").join(settings, "repo_id", "left")
    path = F.coalesce("to_path", "from_path")
    kept = F.when(F.coalesce("name_filter", F.lit("")) == "", True).otherwise(F.coalesce(F.expr("coalesce(to_path, from_path) rlike name_filter"), F.lit(False)))
    action = F.when(F.col("from_path") != F.col("to_path"), "rename").otherwise(F.col("change_kind"))
    return changes.filter(~_skipped(path) & kept & (F.coalesce("size_bytes", F.lit(0)) <= largest)).select("change_id", action.alias("action"), F.substring_index(path, ".", -1).alias("extension"))


def language_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Changes whose language is among those their repository asks for; `all`, an empty or no list ask for every one (FLT-03)."""
    asked = table(spark, folder, "repositories").select("repo_id", F.transform("languages", lambda x: F.lower(F.trim(x))).alias("asked"))
    path = F.coalesce("to_path", "from_path")
    changes = table(spark, folder, "file_changes").select("change_id", "repo_id", language(path).alias("lang")).join(asked, "repo_id", "left")
    every = F.coalesce(F.size("asked"), F.lit(0)) <= 0
    return changes.filter(every | F.array_contains("asked", "all") | F.array_contains("asked", F.col("lang"))).select("change_id", "lang")


QUERIES = {**{name: _rollup(name) for name in ROLLUPS}, **{name: _amount(name) for name in AMOUNTS}, **{f.__name__: f for f in (survival_current, extension_languages, skipped_changes, change_filter, language_filter)}}
_N = "CASE WHEN {0} IS NULL OR {0} = '' THEN 0 ELSE len(string_split({0}, chr(10))) - CASE WHEN right({0}, 1) = chr(10) THEN 1 ELSE 0 END END"
_KNOWN = f"n AS (SELECT f.change_id, f.repo_id, f.commit_id, f.change_kind, coalesce(f.to_path, f.from_path) AS path, CASE WHEN f.change_kind <> 'insert' AND f.change_kind <> 'delete' AND (f.before_text IS NULL OR f.after_text IS NULL) THEN 0 ELSE {_N.format('f.after_text')} - {_N.format('f.before_text')} END AS net, {_N.format('f.after_text')} AS standing FROM file_changes f WHERE f.commit_id IN (SELECT commit_id FROM commits))"
_LANG = "CASE lower(list_last(string_split(list_last(string_split(path, '/')), '.'))) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXTENSIONS.items()) + " ELSE 'other' END"
_DOT = "contains(list_last(string_split(path, '/')), '.')"
SQL: dict[str, str] = {
    "change_net_lines": f"WITH {_KNOWN} SELECT change_id, net FROM n",
    "language_net_lines": f"WITH {_KNOWN} SELECT repo_id, CASE WHEN {_DOT} THEN {_LANG} ELSE 'other' END AS lang, sum(net) AS net, count(*) AS changes FROM n GROUP BY 1, 2",
    "file_net_lines": f"WITH {_KNOWN} SELECT repo_id, path, sum(net) AS net FROM n GROUP BY 1, 2",
    "survival_current": f"WITH {_KNOWN}, o AS (SELECT n.*, i.idx FROM n JOIN (SELECT commit_id, arg_min(idx, struct_pack(r := received_ts, i := idx)) AS idx FROM commits GROUP BY commit_id) i USING (commit_id)), "
    "moved AS (SELECT repo_id, from_path AS path FROM file_changes WHERE from_path <> to_path UNION SELECT repo_id, to_path FROM file_changes WHERE from_path <> to_path), "
    "p AS (SELECT repo_id, path, arg_min(change_kind, idx * 1000000000 + change_id) AS first, arg_max(CASE WHEN change_kind = 'delete' THEN 0 ELSE standing END, idx * 1000000000 + change_id) AS lines FROM o GROUP BY 1, 2) "
    "SELECT repo_id, path, lines FROM p WHERE first = 'insert' AND NOT EXISTS (SELECT 1 FROM moved m WHERE m.repo_id = p.repo_id AND m.path = p.path)",
    "extension_languages": f"SELECT change_id, CASE WHEN {_DOT} THEN {_LANG} ELSE 'other' END AS lang FROM (SELECT change_id, coalesce(to_path, from_path) AS path FROM file_changes)",
    "skipped_changes": "SELECT f.repo_id, count(*) AS changes, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM unnest(skip_files) AS u(w) WHERE w <> '' AND starts_with(path, w))) AS skipped FROM (SELECT repo_id, coalesce(to_path, from_path) AS path FROM file_changes) f LEFT JOIN repositories r ON r.repo_id = f.repo_id GROUP BY f.repo_id",
    "language_filter": f"SELECT change_id, lang FROM (SELECT change_id, f.repo_id, CASE WHEN {_DOT} THEN {_LANG} ELSE 'other' END AS lang FROM (SELECT change_id, repo_id, coalesce(to_path, from_path) AS path FROM file_changes) f) x LEFT JOIN repositories r ON r.repo_id = x.repo_id "
    "WHERE coalesce(len(languages), 0) = 0 OR EXISTS (SELECT 1 FROM unnest(languages) AS u(w) WHERE lower(trim(w)) IN ('all', lang))",
}
