"""Problem 8: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendrel.llm.tokens import VOCABULARY, with_tokens
from tendrel.session import materialise

#: Slices of each source by the seeded hash; the cut of the fractional repetition falls into one of them.
SLICES = 4096
#: Cuts of the fractional repetition: each after the first fills what the one before left with shorter texts.
ROUNDS = 4


def water_fill(targets: dict[str, float], sizes: dict[str, float], repeats: dict[str, float], total: float) -> dict[str, float]:
    """Size that each source contributes: its target share of total, at most repeats times its size; what a clamped
    source can't give goes to the others in proportion to their targets, until nothing is over or all are clamped."""
    live = {s: t for s, t in targets.items() if t > 0 and sizes.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    given: dict[str, float] = dict.fromkeys(targets, 0.0)
    left = float(total)
    while live and left > 0:
        weight = sum(live.values())
        over = [s for s, t in live.items() if left * t / weight > sizes[s] * repeats[s]]
        if not over:
            for s, t in live.items():
                given[s] = left * t / weight
            break
        for s in over:
            given[s] = float(sizes[s] * repeats[s])
        left -= sum(given[s] for s in over)
        live = {s: t for s, t in live.items() if s not in over}
    return given


def _cut(docs: DataFrame, extra: dict[str, float]) -> DataFrame:
    """The documents (id, source, tokens, u, slice) of the sources in extra that are no longer than it, with `taken`: whether
    their running total in the order of u stays within it."""
    plan = docs.sparkSession.createDataFrame(list(extra.items()), "source string, extra double")
    short = docs.join(F.broadcast(plan), "source").where("tokens <= extra")
    slices = short.groupBy("source", "slice").agg(F.sum("tokens").alias("in_slice"))
    before = F.sum("in_slice").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    marked = short.join(slices.withColumn("before", F.coalesce(before, F.lit(0))), ["source", "slice"])
    inside = Window.partitionBy("source", "slice").orderBy("u", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # slices wholly within the cut are taken; only the one it falls into is taken document by document
    within = F.col("before") + F.col("in_slice") <= F.col("extra")
    edge = ~within & (F.col("before") < F.col("extra"))
    names = ("id", "source", "tokens", "u", "slice")
    return marked.where(~edge).select(*names, within.alias("taken")).unionByName(
        marked.where(edge).withColumn("taken", F.col("before") + F.sum("tokens").over(inside) <= F.col("extra")).select(*names, "taken")
    )


def mix_sources(
    df: DataFrame, sources: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1, vocabulary: str = VOCABULARY
) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). mixture: (key, source, tokens, copies) of each document taken at least once; report: (source,
    target_share, max_repeats, size, longest, documents, given, most_copies, actual_share); what a source gives is within
    its longest text of what it should.

    sources (source, target_share, max_repeats) is a small fixed table, one row per source. Sources with a null share
    or cap take no part, nor do null or empty texts and null keys; repeated keys count once; a source without documents
    gives nothing and its share goes to the others. The mixture aims at the size of all taking part together; equal
    texts of one source are one text, of which the first by key is kept, so that none comes more often than allowed.

    Each document is taken floor(given / size) times, and once more if it is in the seeded sample that fills the
    fraction. The sample is cut by running totals over hash slices of a source (SLICES each) and then inside one
    slice, so no source, however large, is sorted in one task. What is left behind the cut goes to later texts that are
    no longer than it, by a cut of the same kind, ROUNDS times in all.
    """
    part = [r for r in sources.select("source", "target_share", "max_repeats").collect() if r["source"] is not None and r["target_share"] is not None and r["max_repeats"] is not None]
    targets = {r["source"]: float(r["target_share"]) for r in part}
    repeats = {r["source"]: float(r["max_repeats"]) for r in part}
    spark = df.sparkSession
    named = df.where(F.col(key).isNotNull() & (F.length(text) > 0) & F.col(source).isin(list(targets))).select(F.col(key).alias("id"), F.col(source).alias("source"), F.sha2(F.col(text), 256).alias("same"), F.col(text).alias("text"))
    sized = with_tokens(named, "text", "id", "source", "same", vocabulary=vocabulary)
    # the least key of equal texts stands for them; a repeated key is equal to itself
    once = sized.groupBy("source", "same").agg(F.min("id").alias("id"), F.first("tokens").alias("tokens"))
    docs = materialise(once.withColumn("u", F.xxhash64(F.lit(seed), "source", "id")).withColumn("slice", F.pmod("u", F.lit(SLICES)).cast("int")))
    measured = docs.groupBy("source").agg(F.sum("tokens").alias("size"), F.max("tokens").alias("longest")).collect()
    sizes, longest = {r["source"]: r["size"] for r in measured}, {r["source"]: r["longest"] for r in measured}
    given = water_fill(targets, sizes, repeats, sum(sizes.values()))
    whole = {s: int(given[s] // sizes[s]) for s in sizes if s in given}
    left = {s: float(given[s] - whole[s] * sizes[s]) for s in whole}
    rest, chosen = docs, []
    for _ in range(ROUNDS):
        cut = materialise(_cut(rest, {s: x for s, x in left.items() if x >= 1}))
        chosen.append(cut.where("taken").select("id", "source", "tokens"))
        for r in cut.where("taken").groupBy("source").agg(F.sum("tokens").alias("t")).collect():
            left[r["source"]] -= r["t"]
        rest = cut.where("not taken").drop("taken")
        if all(x < 1 for x in left.values()):
            break
    more = chosen[0]
    for part in chosen[1:]:
        more = more.unionByName(part)
    plan = spark.createDataFrame(list(whole.items()), "source string, whole int")
    taken = docs.join(more.select("id", "source", F.lit(1).alias("more")), ["id", "source"], "left").join(F.broadcast(plan), "source")
    mixture = taken.select(F.col("id").alias(key), "source", "tokens", (F.col("whole") + F.coalesce("more", F.lit(0))).alias("copies")).where("copies > 0")
    got = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("given"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    all_given = got.agg(F.sum("given").alias("all"))
    listed = spark.createDataFrame([(s, targets[s], int(repeats[s]), int(sizes.get(s, 0)), int(longest.get(s, 0))) for s in targets], "source string, target_share double, max_repeats int, size bigint, longest bigint")
    report = (
        listed.join(got, "source", "left").crossJoin(F.broadcast(all_given))
        .select("source", "target_share", "max_repeats", "size", "longest", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("given", F.lit(0)).alias("given"),
                F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(F.coalesce(F.col("given") / F.col("all"), F.lit(0.0)), 6).alias("actual_share"))
    )
    return mixture, report
