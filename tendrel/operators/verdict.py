"""From coverage to verdicts, tallies and orders; quality measures against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWERED_AT, WEAK_AT, EVIDENCED_AT = 0.62, 0.42, 0.45


def check_thresholds(answered_at: float, weak_at: float) -> None:
    if not 0 < weak_at < answered_at <= 1:
        raise ValueError("thresholds must satisfy 0 < weak < answered <= 1")


def verdict(coverage: Column, answered_at: float = ANSWERED_AT, weak_at: float = WEAK_AT) -> Column:
    check_thresholds(answered_at, weak_at)
    return F.when(coverage >= answered_at, "ANSWERED").when(coverage >= weak_at, "WEAK").otherwise("GAP")


def critical(verdict_: Column, binding: Column) -> Column:
    """A gap on an obligation."""
    return (verdict_ == "GAP") & binding


def source_tag(coverage: Column, at: float = EVIDENCED_AT) -> Column:
    return F.when(coverage >= at, "EVIDENCED").otherwise("GENERATED")


def obligation(binding: Column) -> Column:
    return F.when(binding, "BINDING").otherwise("ADVISORY")


def evidence_citation(best: Column, supporting: Column) -> Column:
    more = F.size(supporting)
    return F.when(best.isNull(), "— no matching evidence —").when(more > 0, F.concat(best, F.lit(" (+"), more, F.lit(" more)"))).otherwise(best)


def tally(assessed: DataFrame) -> DataFrame:
    """(answered, weak, gap, critical), zeros included."""
    v = F.col("verdict")
    return assessed.agg(*(F.count_if(v == x).alias(x.lower()) for x in ("ANSWERED", "WEAK", "GAP")), F.count_if("critical").alias("critical"))


def action_order(assessed: DataFrame, *within: str) -> DataFrame:
    """Critical first, then gaps, weak, answered; least coverage first; then the id as text."""
    place = F.when(F.col("verdict") == "GAP", 0).when(F.col("verdict") == "WEAK", 1).otherwise(2)
    return assessed.orderBy(*within, (~F.col("critical")).cast("int"), place, "coverage", "id")


def evaluation(assessed: DataFrame, labels: DataFrame, *on: str) -> DataFrame:
    """Quality against labels (COVERED, PARTIAL, GAP in any case): gap_recall, covered_recall, false_confidence (a gap or
    partial called ANSWERED), false_gaps (covered called GAP) and how many labels found no assessment.

    Of several labels or verdicts of one key the last label and the first verdict by the alphabet count; null labels are
    ignored.
    """
    named = labels.where("label is not null").groupBy(*on).agg(F.max(F.upper("label")).alias("label"))
    judged = assessed.groupBy(*on).agg(F.min("verdict").alias("verdict"))
    both = named.join(judged, list(on), "left")
    lab, v = F.col("label"), F.col("verdict")
    gaps, covered = F.count_if((lab == "GAP") & v.isNotNull()), F.count_if((lab == "COVERED") & v.isNotNull())
    return both.agg(
        gaps.alias("gaps"), F.count_if((lab == "GAP") & (v == "GAP")).alias("gaps_found"), covered.alias("covered"), F.count_if((lab == "COVERED") & (v != "GAP")).alias("covered_found"),
        F.count_if(lab.isin("GAP", "PARTIAL") & (v == "ANSWERED")).alias("false_confidence"), F.count_if((lab == "COVERED") & (v == "GAP")).alias("false_gaps"),
        F.count_if(v.isNull()).alias("unmatched"),
    )
