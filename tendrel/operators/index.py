"""Term statistics of a library, BM25 ranking and bounded coverage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendrel.session import materialise, spread

K1, B, TOP = 1.5, 0.75, 3
#: Tokens of the queries that are ranked in one pass; they are what is sent to each executor, at 8 bytes a token besides
#: their different terms. A larger set of queries takes as many passes.
BLOCK_TOKENS = 2_000_000
#: Sections a task ranks at a time, and the tokens at which such a stretch ends sooner.
SECTIONS, STRETCH_TOKENS = 32768, 6_000_000
#: A term that one in so many sections of a stretch holds is added up as a whole row, others by their places.
DENSE = 32
#: Parts of a stretch whose greatest bounds tell how high its k-th best is at least.
PARTS = 64
#: Sums of a query's first terms that are kept for the next query, which begins with the same ones more often than not.
DEPTH = 24
#: Sections whose scores are worked out in one go.
SCORED = 500_000


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_ix, tf) of chunks (chunk_ix, tokens)."""
    return chunks.select("chunk_ix", F.explode("tokens").alias("term")).groupBy("term", "chunk_ix").agg(F.count("*").alias("tf"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row (n, avg_len, unseen_idf); sections without tokens count."""
    n = F.count("*")
    return chunks.agg(n.alias("n"), F.coalesce(F.sum(F.size("tokens")) / n, F.lit(0.0)).alias("avg_len")).withColumn(
        "unseen_idf", F.when(F.col("n") > 0, F.log(1 + (F.col("n") - F.lit(0.5)) / F.lit(1.5))).otherwise(1.0)
    )


def term_stats(chunks: DataFrame) -> DataFrame:
    """(term, df, idf): sections that hold the term, each once."""
    df = chunks.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = F.col("n").cast("double")
    return df.crossJoin(F.broadcast(corpus_stats(chunks).select("n"))).select("term", "df", F.log(1 + (n - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))).alias("idf"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (chunk_ix, tokens) joined to stretches of SECTIONS rows or STRETCH_TOKENS tokens, one batch more at most."""
    held, rows, size = [], 0, 0
    for whole in batches:
        for batch in (whole[i : i + SECTIONS] for i in range(0, whole.num_rows, SECTIONS)):
            held.append(batch)
            rows, size = rows + batch.num_rows, size + (pc.sum(pc.list_value_length(batch.column(1))).as_py() or 0)
            if rows >= SECTIONS or size >= STRETCH_TOKENS:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _bounds(n: int, first: np.ndarray, at: np.ndarray, weight: np.ndarray, step: float, kind: type) -> list:
    """For each term the weights in steps, rounded up: a row over all n places (a multiple of PARTS) or (places, steps); None without any."""
    up = (np.floor(weight / step) + 1).astype(kind)
    out: list = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        if (j - i) * DENSE >= n:
            row = np.zeros(n, kind)
            row[at[i:j]] = up[i:j]
            out.append(row)
        else:
            out.append((at[i:j], up[i:j]) if j > i else None)
    return out


def _exact(query: np.ndarray, at: np.ndarray, starts: np.ndarray, wanted: np.ndarray, pair: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Scores of (query, place): weights added in token order, repeats too, so that sums come out the same everywhere."""
    score = np.zeros(len(query))
    size = starts[query + 1] - starts[query]
    for p in range(int(size.max(initial=0))):
        rows = np.flatnonzero(size > p)
        key = wanted[starts[query[rows]] + p] * n + at[rows]
        place = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
        score[rows] += np.where(pair[place] == key, weight[place], 0.0)
    return score


def _rank(stats: tuple[int, float], block, k: int, k1: float, b: float):
    """Best k of a task's sections for each query of a block: (query, chunk_ix, score).

    Sections are ranked in stretches; what is kept from one to the next is k rows per query. In a stretch each query adds up
    whole numbers, its terms' weights rounded up to steps, over all sections at once. Sections whose sum may reach the
    k-th best (of the stretch or of those kept) are then scored exactly; no other can be among the best. A query whose terms
    can't add up to its k-th best in a stretch, by the greatest weight of each there, passes it over. Queries come in the
    order of their sorted terms, the most frequent first, so that sums of the terms two of them begin with are made once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf, ids, same, flat, starts = block.value
        if not len(ids):
            return
        vocabulary = pa.array(terms, pa.string())
        avg, queries = stats[1], len(starts) - 1
        ordered = flat[np.lexsort((flat, np.repeat(np.arange(queries), np.diff(starts))))]
        kept_score, kept_ix = np.zeros((queries, k)), np.zeros((queries, k), np.int64)

        def keep(q: np.ndarray, score: np.ndarray, ix: np.ndarray) -> None:
            """Puts scored sections, of a query all together, beside those kept and keeps the best k."""
            own = np.unique(q)
            q, score, ix = np.concatenate((q, np.repeat(own, k))), np.concatenate((score, kept_score[own].ravel())), np.concatenate((ix, kept_ix[own].ravel()))
            order = np.lexsort((-ix, -score, q))
            q, score, ix = q[order], score[order], ix[order]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            best = nth < k
            kept_score[q[best], nth[best]], kept_ix[q[best], nth[best]] = score[best], ix[best]

        for batch in _stretches(batches):
            tokens = batch.column(1)
            ix = np.asarray(batch.column(0))
            n = len(ix)
            length = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)).astype(np.float64)
            owner = np.asarray(pc.list_parent_indices(tokens), dtype=np.int64)
            found = pc.index_in(tokens.flatten(), value_set=vocabulary)
            ok = np.asarray(found.is_valid())
            pair, tf = np.unique(np.asarray(found.fill_null(0))[ok].astype(np.int64) * n + owner[ok], return_counts=True)
            if not len(pair):
                continue
            term, at = pair // n, pair % n
            weight = idf[term] * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length[at] / avg))
            # the term's sections and weights here; a query only meets terms that this stretch has
            first = np.searchsorted(term, np.arange(len(terms) + 1))
            held_here = np.diff(first) > 0
            here = np.flatnonzero(held_here[flat])
            bounds = np.searchsorted(here, starts)
            wanted = flat[here].astype(np.int64)
            most = np.zeros(len(terms))
            np.maximum.at(most, term, weight)
            reach, size = np.diff(np.concatenate(([0.0], np.cumsum(most[wanted])))[bounds]), np.diff(bounds)
            # sums of floats may differ in their last places; a stretch is only passed over if it is clearly below
            near = np.flatnonzero((size > 0) & (reach * (1 + 1e-9) + 1e-6 >= kept_score[:, -1]))
            if not len(near):
                continue
            kind = np.uint16 if size.max() < 30_000 else np.uint32
            step = float(reach.max()) * (1 + 1e-6) / (np.iinfo(kind).max - int(size.max()) - 2)
            padded = -(-n // PARTS) * PARTS
            rows = _bounds(padded, first, at, weight, step, kind)
            # a step less, for the last places of floats; 0 is no score
            least = np.maximum(np.floor(kept_score[:, -1] / step).astype(np.int64) - 1, 1).tolist()
            begins, listed = bounds.tolist(), ordered[held_here[ordered]].tolist()
            kept_sums, path = [np.zeros(padded, kind)] + [np.empty(padded, kind) for _ in range(min(DEPTH, int(size.max())))], []
            own = np.empty(padded, kind)
            width = padded // PARTS
            held_q, held_at, held = [], [], 0

            def flush() -> None:
                q, place = np.repeat(held_q, [len(x) for x in held_at]), np.concatenate(held_at)
                score = _exact(q, place, bounds, wanted, pair, weight, n)
                keep(q, score, ix[place])

            for q in near.tolist():
                mine = listed[begins[q] : begins[q + 1]]
                whole = [t for t in mine if type(rows[t]) is not tuple]
                some = [rows[t] for t in mine if type(rows[t]) is tuple]
                same_first = 0
                for t, u in zip(path, whole):
                    if t != u:
                        break
                    same_first += 1
                path = whole[:DEPTH]
                for d in range(same_first, len(path)):
                    np.add(kept_sums[d], rows[path[d]], out=kept_sums[d + 1])
                total = kept_sums[len(path)]
                if some or len(whole) > DEPTH:
                    np.copyto(own, total)
                    total = own
                    for t in whole[DEPTH:]:
                        np.add(total, rows[t], out=total)
                    for places, steps in some:
                        total[places] += steps
                bar = least[q]
                if bar > 1 and total.max() < bar:
                    continue
                parts = total.reshape(PARTS, width)
                highest = parts.max(axis=1)
                if k <= PARTS:
                    # k parts have a section of at least this sum, which is less than a step a token above its score
                    bar = max(bar, int(np.partition(highest, PARTS - k)[PARTS - k]) - len(mine) - 1)
                above = np.flatnonzero(highest >= bar)
                part, place = np.nonzero(parts[above] >= bar)
                place += above[part] * width
                held_q.append(q)
                held_at.append(place)
                held += len(place)
                if held >= SCORED:
                    flush()
                    held_q, held_at, held = [], [], 0
            if held:
                flush()
        # queries of the same tokens have been ranked once
        held = kept_score[same] > 0
        if held.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, held.sum(axis=1))), pa.array(kept_ix[same][held]), pa.array(kept_score[same][held])], ["query", "chunk_ix", "score"])

    return run


def _once(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of terms (without those below 0), equal ones once: the place of each list among the different ones, and those as
    terms and starts, in the order of their sorted terms."""
    starts = np.concatenate(([0], np.cumsum(flat >= 0)))[starts].tolist()
    flat = flat[flat >= 0].astype(np.int32)
    lists = [flat[i:j].tobytes() for i, j in zip(starts[:-1], starts[1:])]
    # big-endian bytes are in the order of the numbers
    different = sorted(set(lists), key=lambda x: (np.sort(np.frombuffer(x, np.int32)).astype(">i4").tobytes(), x))
    place = {x: i for i, x in enumerate(different)}
    same = np.array([place[x] for x in lists], np.int64)
    return same, np.frombuffer(b"".join(different), np.int32), np.concatenate(([0], np.cumsum([len(x) // 4 for x in different]))).astype(np.int64)


def best_sections(queries: DataFrame, chunks: DataFrame, key: str = "id", k: int = TOP, k1: float = K1, b: float = B, block: int = BLOCK_TOKENS) -> DataFrame:
    """(key, chunk_ix, score, rank) of the k best sections for each query (key bigint, tokens), by BM25 over the occurrences of
    its tokens; of equal scores the higher index ranks first, and scores of 0 don't rank.

    Each task ranks its sections for a block of queries and gives at most k rows per query that any of them matches, so
    what is shuffled is k rows per query and task, not a row for every shared term. Queries are a stated
    set sent out in blocks of about `block` tokens (one query more at most); a larger set takes as many passes over the
    sections. Term statistics are built once.
    """
    spark = chunks.sparkSession
    stats = tuple(corpus_stats(chunks).select("n", "avg_len").first())
    if not stats[0]:
        return spark.createDataFrame([], f"{key} bigint, chunk_ix bigint, score double, rank int")
    sections = spread(chunks.select(F.col("chunk_ix").cast("bigint"), "tokens"))
    idf = materialise(term_stats(chunks).select("term", "idf"))
    wanted = materialise(queries.select(F.col(key).cast("bigint").alias("query"), "tokens").where(F.size("tokens") > 0))
    total = wanted.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block))
    parts = []
    for i in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)
        rows = part.toArrow()
        ids, tokens = rows.column("query").to_numpy(), rows.column("tokens").combine_chunks()
        found = idf.join(part.select(F.explode("tokens").alias("term")).distinct(), "term").toArrow()
        found = found.sort_by([("idf", "ascending"), ("term", "ascending")])
        terms = found.column("term").combine_chunks()
        place = pc.index_in(tokens.flatten(), value_set=terms)
        flat = np.asarray(pc.fill_null(place, -1)).astype(np.int32)
        starts = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(tokens)))))
        sent = spark.sparkContext.broadcast((terms.to_pylist(), found.column("idf").to_numpy(), ids, *_once(flat, starts)))
        parts.append(sections.mapInArrow(_rank(stats, sent, k, k1, b), "query bigint, chunk_ix bigint, score double"))
    each = parts[0]
    for part in parts[1:]:
        each = each.unionByName(part)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc("chunk_ix")))
    return each.withColumn("rank", place).where(F.col("rank") <= k).withColumnRenamed("query", key)


def coverage(queries: DataFrame, ranked: DataFrame, chunks: DataFrame, key: str = "id") -> DataFrame:
    """(key, coverage, relevance, evidence, supporting): share of a query's distinct terms, weighted by the square of
    their idf, that its best sections hold together; 0 without terms or sections.

    Terms no section holds weigh as much as one in a single section. Sums run in the order of terms, so the result
    doesn't depend on partitioning. Section tokens are fetched for the ranked sections only.
    """
    picked = ranked.select(key, "chunk_ix", "score", "rank")
    pool = (
        picked.join(chunks.select("chunk_ix", F.array_distinct("tokens").alias("held")), "chunk_ix")
        .groupBy(key).agg(
            F.array_distinct(F.flatten(F.collect_list("held"))).alias("pool"),
            F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("relevance"),
            F.max(F.when(F.col("rank") == 1, F.col("chunk_ix"))).alias("evidence"),
            F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "chunk_ix")))), lambda x: x["chunk_ix"]).alias("supporting"),
        )
    )
    terms = queries.select(key, F.explode(F.array_distinct("tokens")).alias("term"))
    weighed = (
        terms.join(term_stats(chunks).select("term", "idf"), "term", "left").crossJoin(F.broadcast(corpus_stats(chunks).select("unseen_idf")))
        .withColumn("w", F.pow(F.coalesce("idf", "unseen_idf"), F.lit(2.0)))
        .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("terms"))
    )
    total = F.aggregate("terms", F.lit(0.0), lambda a, t: a + t["w"])
    hit = F.aggregate(F.filter("terms", lambda t: F.array_contains(F.col("pool"), t["term"])), F.lit(0.0), lambda a, t: a + t["w"])
    return (
        queries.select(key).join(weighed, key, "left").join(pool, key, "left")
        .select(key, F.when(F.col("pool").isNotNull() & (total > 0), hit / total).otherwise(0.0).alias("coverage"),
                F.coalesce("relevance", F.lit(0.0)).alias("relevance"), "evidence", F.coalesce("supporting", F.array().cast("array<bigint>")).alias("supporting"))
    )
