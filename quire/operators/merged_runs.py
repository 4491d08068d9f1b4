"""Results of sharded batch runs as one: the latest of each source, repeats told apart from conflicts, and manifests' bundles over the files found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Results that leave a paper behind.
DONE = ["published", "replaced"]


def merged(results: DataFrame) -> DataFrame:
    """(sha256, status, stage, directory, run, finished, runs, state) of results (run, sha256, status, stage, directory, finished): the latest of each source.

    ``state``: single (one run had it), repeat (several, and what they left is in one directory), retried (several, and what they left, if
    anything, came after failures) or conflict (they left it in several directories). Of results finished at the same time the run that sorts last
    counts. Every source has its own row; counts are combined before the shuffle.
    """
    done = F.col("status").isin(DONE)
    grouped = results.groupBy("sha256").agg(
        F.max_by(F.struct("status", "stage", "directory", "run", "finished"), F.struct("finished", "run")).alias("x"),
        F.countDistinct("run").alias("runs"), F.count_if(done).alias("left"), F.min(F.when(done, F.col("directory"))).alias("first"), F.max(F.when(done, F.col("directory"))).alias("last"), F.count_if(~done).alias("failed"),
    )
    state = F.when(F.col("first") != F.col("last"), "conflict").when(F.col("runs") == 1, "single").when((F.col("left") > 0) & (F.col("failed") == 0), "repeat").otherwise("retried")
    return grouped.select("sha256", "x.*", "runs", state.alias("state"))


def summary(rows: DataFrame) -> DataFrame:
    """(status, state, sources) of ``merged``: how many sources ended how."""
    return rows.groupBy("status", "state").agg(F.count(F.lit(1)).alias("sources"))


def bundles(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(id, role, n, path, sha256) of a manifest's entries (id, paper, supplements, html) over the files (path, sha256) that intake took.

    Roles are paper, supplement and page, numbered in the entry's order. A file that intake didn't take has no digest; nulls among an entry's files are left out.
    """
    listed = lambda role, of: F.transform(F.coalesce(of, F.array().cast("array<string>")), lambda p, i: F.struct(F.lit(role).alias("role"), i.alias("n"), p.alias("path")))
    named = entries.select("id", F.inline(F.concat(listed("paper", F.array("paper")), listed("supplement", F.col("supplements")), listed("page", F.col("html")))))
    return named.where("path is not null").join(files.select("path", "sha256"), "path", "left").select("id", "role", "n", "path", "sha256")


def clashes(members: DataFrame) -> DataFrame:
    """(sha256, first, id, path) of papers and supplements of ``bundles`` whose bytes another entry, the first by name, has too."""
    own = members.where("role in ('paper', 'supplement') and sha256 is not null")
    first = own.groupBy("sha256").agg(F.min("id").alias("first"), F.max("id").alias("_last")).where(F.col("first") != F.col("_last")).drop("_last")
    return own.join(first, "sha256").where(F.col("id") != F.col("first")).select("sha256", "first", "id", "path")


def pairing(members: DataFrame) -> DataFrame:
    """(id, paper, supplements, pages) of ``bundles``: digests of each entry's paper and supplements, and its pages' paths, in order; entries whose paper wasn't taken are left out."""
    ordered = lambda role, value: F.transform(F.array_sort(F.collect_list(F.when((F.col("role") == role) & F.col(value).isNotNull(), F.struct("n", F.col(value).alias("v"))))), lambda x: x["v"])
    each = members.groupBy("id").agg(F.max(F.when(F.col("role") == "paper", F.col("sha256"))).alias("paper"), ordered("supplement", "sha256").alias("supplements"), ordered("page", "path").alias("pages"))
    return each.where("paper is not null")
