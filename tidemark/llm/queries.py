"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.cooccurrence import cooccurrence
from tidemark.llm.encoding import count_sentences, forms, garbled, garbled_keys, learn_readings
from tidemark.llm.handwritten import evidence, not_handwritten
from tidemark.llm.leakage import leaks
from tidemark.llm.names import link_names, pairs_of
from tidemark.llm.packing import pack, token_counts
from tidemark.llm.quantiles import add_up, encode, merge, percentiles, rank_misses, sketches
from tidemark.llm.ranking import aggregate_ranks
from tidemark.llm.syntax import invalid_sources
from tidemark.session import settle
from tidemark.sources import table

MEASURES = ["complexity", "cognitive", "halstead_volume", "halstead_effort"]
PROBS = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
CAPACITY = 2048


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of paths of a repository that change together far more often than chance."""
    pairs = cooccurrence(table(spark, folder, "commits").select("repo_id", "commit_id", "files"), "repo_id", "commit_id", "files")
    return pairs.select("repo_id", F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))


def _rounded(pairs: DataFrame) -> DataFrame:
    return pairs.select("repo_id", F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"), "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of p1_found with count, marginals, lift and pointwise mutual information."""
    return _rounded(cooccurrence(table(spark, folder, "commits").select("repo_id", "commit_id", "files"), "repo_id", "commit_id", "files"))


def p1_tick_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The same over the files recorded per tick."""
    ticks = table(spark, folder, "tick_metrics").select("repo_id", "tick", "files")
    return _rounded(cooccurrence(ticks, "repo_id", "tick", "files"))


def _pair_sql(name: str, basket: str, columns: str) -> str:
    return f"""
    WITH rows AS (SELECT DISTINCT repo_id, {basket} AS b, unnest(files) AS f FROM {name} WHERE repo_id IS NOT NULL AND {basket} IS NOT NULL),
    r AS (SELECT * FROM rows WHERE f IS NOT NULL),
    t AS (SELECT repo_id, count(DISTINCT b) AS n FROM r GROUP BY 1),
    m AS (SELECT repo_id, f, count(*) AS c FROM r GROUP BY 1, 2),
    p AS (SELECT x.repo_id, x.f AS path_a, y.f AS path_b, count(*) AS n_ab FROM r x JOIN r y ON x.repo_id = y.repo_id AND x.b = y.b AND x.f < y.f GROUP BY 1, 2, 3 HAVING count(*) >= 6)
    SELECT {columns} FROM p JOIN t USING (repo_id)
    JOIN m ma ON ma.repo_id = p.repo_id AND ma.f = path_a JOIN m mb ON mb.repo_id = p.repo_id AND mb.f = path_b
    WHERE n_ab * n >= 4 * ma.c * mb.c"""


_LONG = """p.repo_id AS repo_id, path_a, path_b, n_ab, ma.c AS n_a, mb.c AS n_b, n,
    round(n_ab::DOUBLE * n / (ma.c::DOUBLE * mb.c), 6) AS lift, round(log2(n_ab::DOUBLE * n / (ma.c::DOUBLE * mb.c)), 6) AS pmi"""


def p2_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Changes whose file is not hand-written, and why."""
    return not_handwritten(table(spark, folder, "file_changes"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Changes whose file is not hand-written."""
    return p2_reasons(spark, folder).select("change_id")


def p2_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Per rule, how many changes it finds, and how many no other kind of rule does (subtrees and blocks are one kind)."""
    rules = settle(evidence(table(spark, folder, "file_changes")))
    kind = F.when(F.col("rule").isin("file", "directory", "blocks"), "shared").otherwise(F.col("rule"))
    alone = rules.groupBy("change_id").agg(F.count_distinct(kind).alias("kinds"))
    return rules.join(alone, "change_id").groupBy("rule").agg(F.count_distinct("change_id").alias("changes"), F.count_distinct(F.when(F.col("kinds") == 1, F.col("change_id"))).alias("only_so"))


def p2_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Per repository, how its own path settings compare: changes they miss and changes they skip wrongly."""
    changes = table(spark, folder, "file_changes").select("change_id", "repo_id", F.coalesce("to_path", "from_path").alias("path"))
    settings = table(spark, folder, "repositories").select("repo_id", "skip_files", "name_filter")
    skipped = F.coalesce(F.exists("skip_files", lambda p: F.col("path").startswith(p)), F.lit(False))
    kept = F.coalesce(F.when(F.col("name_filter") != "", F.expr("path rlike name_filter")), F.lit(True))
    judged = changes.join(settings, "repo_id", "left").join(p2_found(spark, folder).withColumn("bad", F.lit(True)), "change_id", "left")
    judged = judged.withColumn("bad", F.coalesce("bad", F.lit(False))).withColumn("out", skipped | ~kept)
    return judged.groupBy("repo_id").agg(F.count_if(F.expr("bad and not out")).alias("missed"), F.count_if(F.expr("out and not bad")).alias("overshot"), F.count_if("bad").alias("not_handwritten"), F.count("*").alias("changes"))


def p3_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Every judged text of a change with its repair cost; 0 for valid source."""
    return invalid_sources(table(spark, folder, "file_changes"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of changes that are not valid source of the language of their path."""
    return p3_checked(spark, folder).filter("edits > 0").select("change_id", "side").distinct()


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rate of invalid texts per repository and language, and of what is wrong with them."""
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("truncated", "conflict", "mismatch", "broken")]
    rates = p3_checked(spark, folder).groupBy("repo_id", "lang").agg(F.count("*").alias("texts"), F.count_if(F.col("edits") > 0).alias("invalid"), *counts)
    return rates.withColumn("rate", F.col("invalid") / F.col("texts"))


SCOPES = ["repo_id", "tick", "prog_lang"]


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of the four measures per repository, per tick and per language, with their rank error."""
    parts = encode(table(spark, folder, "file_quality"), [], MEASURES, scopes=SCOPES)
    return percentiles(add_up(parts, ["scope", "grp"]), ["scope", "grp"], PROBS)


def p5_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per repository from the sketches of its ticks, without the rows."""
    quality = table(spark, folder, "file_quality").select("repo_id", "tick", *MEASURES)
    return percentiles(merge(sketches(quality, ["repo_id", "tick"], MEASURES), ["repo_id"]), ["repo_id"], PROBS)


def p5_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Per repository, tick or language and measure, the exact number of rows and whether all percentiles of p5_percentiles keep their rank error."""
    quality = table(spark, folder, "file_quality")
    scopes = F.array(*(F.struct(F.lit(s).alias("scope"), F.col(s).cast("string").alias("grp")) for s in SCOPES))
    found = rank_misses(quality.select(F.inline(scopes), *MEASURES), p5_percentiles(spark, folder), ["scope", "grp"], MEASURES, PROBS)
    return found.select("scope", "grp", "metric", "n", "within")


_MISSES_SQL = """
    WITH s AS (SELECT 'repo_id' AS scope, CAST(repo_id AS VARCHAR) AS grp, complexity, cognitive, halstead_volume, halstead_effort FROM file_quality
      UNION ALL SELECT 'tick', CAST(tick AS VARCHAR), complexity, cognitive, halstead_volume, halstead_effort FROM file_quality
      UNION ALL SELECT 'prog_lang', prog_lang, complexity, cognitive, halstead_volume, halstead_effort FROM file_quality),
    v AS (SELECT scope, grp, 'complexity' AS metric, complexity AS x FROM s UNION ALL SELECT scope, grp, 'cognitive', cognitive FROM s
      UNION ALL SELECT scope, grp, 'halstead_volume', halstead_volume FROM s UNION ALL SELECT scope, grp, 'halstead_effort', halstead_effort FROM s)
    SELECT scope, grp, metric, count(*) AS n, true AS within FROM v WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY scope, grp, metric"""


def p6_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Records of developers (dev_id) and bus_factor (bus_id) with the entity they stand for in their repository."""
    devs = table(spark, folder, "developers").filter("dev_id <> 1").select(F.col("dev_id").alias("id"), F.col("repo_id").alias("scope"), F.col("dev_name").alias("name"), "email")
    bus = table(spark, folder, "bus_factor")
    records = devs.unionByName(bus.select(F.col("bus_id").alias("id"), F.col("repo_id").alias("scope"), F.col("primary_dev_name").alias("name"), F.lit(None).cast("string").alias("email")))
    sure = bus.filter("primary_dev_id is not null and primary_dev_id <> 1").select(F.col("bus_id").alias("a"), F.col("primary_dev_id").alias("b"))
    nicknames = table(spark, folder, "nicknames").select("nickname", "given_name")
    linked = link_names(records, nicknames, sure)
    return linked.select("id", F.col("scope").alias("repo_id"), "entity")


def p6_contributors(spark: SparkSession, folder: str) -> DataFrame:
    """Per repository the spellings in developers and in tick_metrics.names, and the contributors they stand for."""
    devs = table(spark, folder, "developers").filter("dev_id <> 1").select(F.col("dev_id").alias("id"), F.col("repo_id").alias("scope"), F.col("dev_name").alias("name"), "email")
    seen = table(spark, folder, "tick_metrics").select("repo_id", F.inline(F.arrays_zip(F.col("names").alias("name"), F.col("author_ids").alias("author_id")))).filter("name is not null").distinct()
    # ids below zero for spellings of ticks, from what they are
    seen = seen.withColumn("id", -1 - F.pmod(F.xxhash64("repo_id", "name"), F.lit(1 << 62)))
    spelled = seen.select("id", F.col("repo_id").alias("scope"), "name", F.lit(None).cast("string").alias("email")).distinct()
    sure = seen.filter("author_id is not null and author_id not in (1, 262142)").select(F.col("id").alias("a"), F.col("author_id").alias("b"))
    nicknames = table(spark, folder, "nicknames").select("nickname", "given_name")
    linked = link_names(devs.unionByName(spelled), nicknames, sure)
    return linked.groupBy(F.col("scope").alias("repo_id")).agg(F.count("*").alias("spellings"), F.count_distinct("entity").alias("contributors"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records of a repository whose names mean the same person or organisation."""
    linked = p6_entities(spark, folder).select("id", F.col("repo_id").alias("scope"), "entity")
    return pairs_of(linked).select("id_a", "id_b")


def p7_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Functions ranked by four scores together, per repository and overall."""
    scores = ["cyclomatic_complexity", "cognitive_complexity", "volume", "effort"]
    functions = table(spark, folder, "function_metrics").select("function_id", "repo_id", *scores)
    ranked = aggregate_ranks(functions, "function_id", scores, {"repo": F.col("repo_id"), "all": F.lit("")})
    return ranked.select("scope", "function_id", "n_scores", F.round("rho", 9).alias("rho"), F.round("mean_rank", 9).alias("mean_rank"), "position")


def p8_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in containers of 2,048 tokens of a public vocabulary, and each container's unused room."""
    sizes = token_counts(table(spark, folder, "documents"), "doc_id", "text")
    return pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p8_unused(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used, those filled by patterns, tokens, and tokens left unused in all."""
    placed = p8_assignment(spark, folder)
    each = placed.groupBy("container_id").agg(F.first("container_free").alias("free"), F.first("by_pattern").alias("by_pattern"), F.sum("n_tokens").alias("tokens"))
    return each.agg(F.count("*").alias("containers"), F.count_if("by_pattern").alias("by_pattern"), F.sum("tokens").alias("tokens"), F.sum("free").alias("unused"))


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a passage of an evaluation item, and the fewest edits it was found with."""
    return leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of document and evaluation item of which the document holds a passage."""
    return p9_leaks(spark, folder).select("doc_id", "item_id")


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per evaluation item the number of documents it leaked into."""
    return p9_leaks(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"), F.min("edits").alias("fewest_edits"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with text garbled by a wrong character encoding."""
    return garbled_keys(table(spark, folder, "documents"), "doc_id", "text")


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled documents with their text restored as far as it can be."""
    return garbled(table(spark, folder, "documents"), "doc_id", "text")


def p10_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Which encodings were read as which, by the number of sentences that have a clean twin."""
    return learn_readings(settle(count_sentences(forms(table(spark, folder, "documents"), "doc_id", "text"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pairs": p1_pairs,
    "p1_tick_pairs": p1_tick_pairs,
    "p2_found": p2_found,
    "p2_reasons": p2_reasons,
    "p2_evidence": p2_evidence,
    "p2_settings": p2_settings,
    "p3_found": p3_found,
    "p3_checked": p3_checked,
    "p3_rates": p3_rates,
    "p5_percentiles": p5_percentiles,
    "p5_merged": p5_merged,
    "p5_misses": p5_misses,
    "p6_found": p6_found,
    "p6_entities": p6_entities,
    "p6_contributors": p6_contributors,
    "p7_ranking": p7_ranking,
    "p8_assignment": p8_assignment,
    "p8_unused": p8_unused,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p9_items": p9_items,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
    "p10_readings": p10_readings,
}
SQL: dict[str, str] = {
    "p5_misses": _MISSES_SQL,
    "p1_found": _pair_sql("commits", "commit_id", "p.repo_id AS repo_id, path_a, path_b"),
    "p1_pairs": _pair_sql("commits", "commit_id", _LONG),
    "p1_tick_pairs": _pair_sql("tick_metrics", "tick", _LONG),
}
