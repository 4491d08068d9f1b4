"""Kept output run again only where something it rests on has changed.

Each stage of a paper has a digest of what it rests on: the digests of its input parts, the stages before it and the version of its own
rules. A stage is stale where the digest that was published with it is another one, or none; only stale papers' rows are run, and the new
digests are appended behind the rows, so that a run that is killed in between does the same work again and a finished one none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.shared import materialize, new_path

PUBLISHED = "paper string, stage string, digest string, turn long, path string"


@dataclass(frozen=True)
class Stage:
    """A step: the parts that it reads, the stages whose rows it takes, and the version of its rules."""

    name: str
    version: str
    parts: tuple[str, ...] = ()
    after: tuple[str, ...] = ()


def digests(inputs: DataFrame, stages: list[Stage]) -> DataFrame:
    """(paper, stage, digest) of inputs (paper, part, sha256), of stages in an order in which each follows those that it takes.

    A part that a paper lacks counts as absent; of several rows of one part the smallest digest counts. A paper without inputs has no row.
    """
    parts = inputs.groupBy("paper", "part").agg(F.min("sha256").alias("sha256"))
    papers = parts.groupBy("paper").agg(F.map_from_entries(F.collect_list(F.struct("part", "sha256"))).alias("have"))
    for s in stages:
        own = [F.concat(F.lit(f"{p}="), F.coalesce(F.try_element_at("have", F.lit(p)), F.lit("-"))) for p in s.parts]
        before = [F.concat(F.lit(f"{a}<"), F.col(f"of_{a}")) for a in s.after]
        papers = papers.withColumn(f"of_{s.name}", F.sha2(F.concat_ws("\n", F.lit(s.name), F.lit(s.version), *own, *before), 256))
    each = F.array(*(F.struct(F.lit(s.name).alias("stage"), F.col(f"of_{s.name}").alias("digest")) for s in stages))
    return papers.select("paper", F.inline(each))


def latest(published: DataFrame) -> DataFrame:
    """(paper, stage, digest, path) of what was published last (paper, stage, digest, turn, path)."""
    return published.groupBy("paper", "stage").agg(F.max_by(F.struct("digest", "path"), "turn").alias("x")).select("paper", "stage", "x.digest", "x.path")


def states(wanted: DataFrame, published: DataFrame) -> DataFrame:
    """(paper, stage, digest, state): new, changed or current, and gone for what is published of papers that have no inputs any more."""
    held = latest(published).select("paper", "stage", F.col("digest").alias("held"))
    both = wanted.join(held, ["paper", "stage"], "full")
    state = F.when(F.col("digest").isNull(), "gone").when(F.col("held").isNull(), "new").when(F.col("held") != F.col("digest"), "changed").otherwise("current")
    return both.select("paper", "stage", "digest", state.alias("state"))


def run(spark: SparkSession, inputs: DataFrame, stages: list[tuple[Stage, Callable[[DataFrame, dict[str, DataFrame]], DataFrame]]], ledger: str) -> dict[str, int]:
    """Runs the stages' functions for stale papers; returns how many each one ran for. ``ledger`` is a folder of Parquet (``PUBLISHED``).

    A function takes the papers (paper) to run and, by name, the current rows of the stages before it, of those papers only; its rows
    need a ``paper``. Rows are written first, then their digests: what has no digest doesn't count.
    """
    published = spark.read.schema(PUBLISHED).parquet(ledger) if _exists(spark, ledger) else spark.createDataFrame([], PUBLISHED)
    turn = (published.agg(F.max("turn")).first()[0] or 0) + 1
    wanted = materialize(digests(inputs, [s for s, _ in stages]), "digests")
    todo = materialize(states(wanted, published).where("state in ('new', 'changed')"), "stale")
    ran, fresh = {}, {}
    for stage, work in stages:
        stale = todo.where(F.col("stage") == stage.name).select("paper", "digest")
        ran[stage.name] = stale.count()
        if not ran[stage.name]:
            continue
        before = {name: rows_of(spark, latest(published).where(F.col("stage") == name), fresh.get(name)).join(stale.select("paper"), "paper", "left_semi") for name in stage.after}
        path = new_path(spark, f"stage-{stage.name}")
        work(stale.select("paper"), before).write.parquet(path)
        fresh[stage.name] = (path, stale.select("paper"))
        stale.select("paper", F.lit(stage.name).alias("stage"), "digest", F.lit(turn).cast("long").alias("turn"), F.lit(path).alias("path")).write.mode("append").parquet(ledger)
    return ran


def rows_of(spark: SparkSession, held: DataFrame, fresh: tuple[str, DataFrame] | None) -> DataFrame:
    """The current rows of a stage: of each paper from the files that it was last written to, this run's (path, papers) first.

    The files' paths are as many as runs that wrote some; each is read with the papers that count there.
    """
    parts = []
    if fresh is not None:
        held = held.join(fresh[1], "paper", "left_anti")
        parts.append(spark.read.parquet(fresh[0]))
    for path in [r.path for r in held.select("path").distinct().collect()]:
        parts.append(spark.read.parquet(path).join(held.where(F.col("path") == path).select("paper"), "paper", "left_semi"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
