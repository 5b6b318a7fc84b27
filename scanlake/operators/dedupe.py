"""One finding of several tools: identity over the names that databases give to the same weakness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.functions.severity import LEVELS, normalize_severity, severity_rank
from scanlake.session import staged


def alias_groups(aliases: DataFrame) -> DataFrame:
    """(id, identity): each name of a list of pairs (id, alias) with the smallest name that it is connected to.

    Labels pass along the pairs, and each round also takes the label of its label, so long chains need few rounds. Every round is a
    stored table and two equi-joins; a name with very many pairs is one row of labels, and its pairs are split like any skewed join side.
    """
    pairs = aliases.where("id is not null and alias is not null and id <> alias")
    edges = staged(pairs.select(F.col("id").alias("a"), F.col("alias").alias("b")).unionByName(pairs.select(F.col("alias").alias("a"), F.col("id").alias("b"))).distinct(), "alias-pairs")
    labels = staged(edges.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("identity")), "alias-labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "identity"), "b").groupBy(F.col("a").alias("id")).agg(F.min("identity").alias("near"))
        far = labels.select(F.col("id").alias("identity"), F.col("identity").alias("far"))
        lower = labels.join(near, "id").join(far, "identity", "left").select("id", F.col("identity").alias("old"), F.least("identity", "near", "far").alias("identity"))
        step = staged(lower, "alias-labels")
        labels = step.select("id", "identity")
        if step.where(F.col("old") != F.col("identity")).isEmpty():
            return labels


def dedupe_findings(findings: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(scan_id, target, package, installed, identity, severity, tools, reports): one row for each weakness of a package of a target.

    ``findings`` has id, severity_raw and tool besides. Findings are the same if their names are equal or connected by ``aliases``; the
    worst severity holds, and ``tools`` lists who reported it. Counting stays as it is for callers that do not ask for this. Rows fold
    in the map tasks, so a package with most of the findings is no hot key.
    """
    named = findings.withColumn("severity", normalize_severity("severity_raw"))
    if aliases is not None:
        named = named.join(alias_groups(aliases), "id", "left").withColumn("identity", F.coalesce("identity", "id"))
    else:
        named = named.withColumn("identity", F.col("id"))
    worst = F.try_element_at(F.array(*[F.lit(name) for name in LEVELS]), (F.min(severity_rank("severity")) + 1).cast("int"))
    return named.groupBy("scan_id", "target", "package", "installed", "identity").agg(
        worst.alias("severity"), F.sort_array(F.collect_set("tool")).alias("tools"), F.count("*").alias("reports")
    )
