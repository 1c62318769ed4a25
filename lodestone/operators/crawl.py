"""Priority crawl over a link table: breadth first by level, with depth and page budgets.

The visited table and the frontier stay DataFrames; each level is written to the shared folder, so lineage does not grow and
a lost executor costs one level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.store import first_wins
from lodestone.runtime import materialize


def crawl(links: DataFrame, seeds: DataFrame, *, max_depth: int = 3, max_pages: int = 100, min_relevance: float = 0.0, level_size: int | None = None) -> DataFrame:
    """page, depth, priority, rank of visited pages.

    ``links``: page, link, priority, relevance. Of a level, pages of higher priority and then smaller name come first;
    the page budget cuts there. A page is visited once, so loops end.
    """
    level = first_wins(seeds.select("page", F.lit(0).alias("depth"), F.coalesce("priority", F.lit(0)).alias("priority")), ["page"], [F.desc("priority")])
    visited, done = None, 0
    for depth in range(max_depth + 1):
        room = max_pages - done if level_size is None else min(level_size, max_pages - done)
        taken = materialize(level.orderBy(F.desc("priority"), "page").limit(room), "crawl-level")
        n = taken.count()
        if not n:
            break
        visited = taken if visited is None else visited.union(taken)
        done += n
        if done >= max_pages or depth == max_depth:
            break
        found = taken.select("page").join(links.where(F.col("relevance") >= min_relevance), "page").select(F.col("link").alias("page"), F.lit(depth + 1).alias("depth"), "priority")
        level = first_wins(found, ["page"], [F.desc("priority")]).join(visited.select("page"), "page", "left_anti")
    return visited if visited is not None else level.limit(0)


def loops(visits: DataFrame, *, most: int = 3, recent: int = 2, minutes: int = 5) -> DataFrame:
    """Pages visited more than ``most`` times, or more than ``recent`` times within the minutes before their last visit. visits: page, ts."""
    last = visits.groupBy("page").agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    near = visits.join(last, "page").where(F.col("ts") >= F.col("last") - F.expr(f"INTERVAL {minutes} MINUTES"))
    counts = near.groupBy("page").agg(F.count("*").alias("near"), F.first("n").alias("n"))
    return counts.where((F.col("n") > most) | (F.col("near") > recent))


def accepted(tasks: DataFrame, visited: DataFrame, *, max_depth: int, min_score: float) -> DataFrame:
    """Tasks (page, depth, score) that may be visited: below the depth, relevant enough, not yet visited, each page once."""
    fresh = tasks.where((F.col("depth") < max_depth) & (F.col("score") >= min_score)).join(visited.select("page"), "page", "left_anti")
    return first_wins(fresh, ["page"], ["depth", F.desc("score")])


def finished(pages: int, frontier: int, relevant: int, *, max_pages: int = 100, enough: int = 20) -> str | None:
    """Why a crawl stops, or None while it goes on."""
    if pages >= max_pages:
        return "page budget"
    if frontier == 0:
        return "nothing left"
    return "enough relevant pages" if relevant >= enough else None


def library(pages: DataFrame, route: Column) -> DataFrame:
    """Pages (library, page_id, text) routed by kind: api, tutorial, example or other; per library the counts, quality and completeness."""
    from lodestone.functions.insight import library_scores

    counts = pages.withColumn("kind", route).groupBy("library").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("api", "tutorial", "example", "other")])
    scores = library_scores(F.col("other") > 0, F.col("api") > 0, F.col("tutorial") > 0, F.col("example") > 0, F.lit(False))
    return counts.select("*", scores["quality"].alias("quality"), scores["completeness"].alias("completeness"))


# fixed values: what a crawl of each kind looks for, how deep and how far
TEMPLATES = {
    "documentation": (("doc", "api", "reference"), 3, 50), "tutorial": (("tutorial", "guide", "example"), 2, 30), "changelog": (("changelog", "release"), 2, 20),
}


def tasks(libraries: DataFrame, kind: str) -> DataFrame:
    """Crawl tasks of (library, url) by a template: keywords, max_depth, max_pages."""
    words, depth, pages = TEMPLATES[kind]
    return libraries.select("library", "url", F.array(*[F.lit(w) for w in words]).alias("keywords"), F.lit(depth).alias("max_depth"), F.lit(pages).alias("max_pages"))
