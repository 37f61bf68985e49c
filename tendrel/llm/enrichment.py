"""Problem 1: how distinctive a term is of the record that holds it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendrel.llm.common import list_array, whole
from tendrel.session import materialise

#: A term held by more than 1 / HOT of all (record, term) pairs is hot. The pairs' number is the sum of all terms'
#: records, so there are fewer than HOT hot terms per collection however large it is: their statistics are broadcast.
HOT = 10_000


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log-gamma for x > 0: Stirling's series after shifting x to 8 or more; relative error about 1e-15."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        if not low.any():
            break
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * 691 / 360360))))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - shift


def _log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def hypergeometric_log_tail(k: np.ndarray, n: np.ndarray, K: np.ndarray, N: np.ndarray) -> np.ndarray:
    """ln P(X >= k): X of the n tokens of a record drawn from N tokens, K of them the term.

    The first term by log-gamma, the others by the ratio of neighbours, until they no longer count. Below the mean
    the lower tail is summed and taken from 1, so no sum is longer than the mean.
    """
    k, n, K, N = (np.asarray(a, dtype=np.float64) for a in (k, n, K, N))
    upper = k > n * K / N
    at = np.where(upper, k, k - 1)
    possible = (at >= np.maximum(0, n + K - N)) & (at <= np.minimum(n, K))
    safe = np.where(possible, at, np.maximum(0, n + K - N))
    first = _log_choose(K, safe) + _log_choose(N - K, n - safe) - _log_choose(N, n)
    total, term, i = np.ones_like(k), np.ones_like(k), safe.copy()
    live = np.flatnonzero(possible)
    while len(live):
        j, K_, n_, N_ = i[live], K[live], n[live], N[live]
        up = upper[live]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(up, (K_ - j) * (n_ - j) / ((j + 1) * (N_ - K_ - n_ + j + 1)), j * (N_ - K_ - n_ + j) / ((K_ - j + 1) * (n_ - j + 1)))
        term[live] *= ratio
        total[live] += term[live]
        i[live] += np.where(up, 1, -1)
        live = live[(term[live] > total[live] * 1e-17) & (ratio > 0)]
    tail = np.where(possible, np.minimum(0.0, first + np.log(total)), -np.inf)
    return np.where(upper, tail, np.log1p(-np.exp(np.minimum(tail, -1e-16)))) + 0.0


def adjusted(log_p: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Benjamini-Hochberg over each record's terms, in logs; owner is sorted."""
    order = np.lexsort((log_p, owner))
    counts = np.bincount(owner) if len(owner) else np.zeros(0, int)
    starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    rank = np.arange(len(owner)) - np.repeat(starts, counts) + 1
    q = log_p[order] + np.log(np.repeat(counts, counts)) - np.log(rank)
    # the least of all later values in the same record: a reversed running minimum, records set apart by an offset
    # that exceeds the span of all values
    span = (np.max(q) - np.min(q) + 1) if len(q) else 1.0
    low = np.minimum.accumulate((q + owner[order] * span)[::-1])[::-1] - owner[order] * span
    out = np.empty_like(q)
    out[order] = np.minimum(0.0, low)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tab, rec_id, tokens) -> (tab, rec_id, length, terms, counts): cleaned tokens counted within each record."""
    for b in batches:
        tokens = whole(b.column(2))
        n = len(tokens)
        flat = pc.utf8_lower(pc.utf8_trim_whitespace(tokens.flatten()))
        owner = np.asarray(pc.list_parent_indices(tokens), dtype=np.int64)
        coded = flat.dictionary_encode()
        codes, values = coded.indices, coded.dictionary
        blank = np.asarray(pc.equal(pc.binary_length(values), 0).fill_null(True)) if len(values) else np.zeros(0, bool)
        ok = np.asarray(codes.is_valid())
        code = np.asarray(codes.fill_null(0)).astype(np.int64)
        ok &= ~blank[code] if len(values) else False
        pair, count = np.unique(owner[ok] * max(1, len(values)) + code[ok], return_counts=True)
        rec, term = pair // max(1, len(values)), pair % max(1, len(values))
        length = np.bincount(owner[ok], minlength=n).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                b.column(1),
                pa.array(length),
                list_array(values.take(pa.array(term)), rec, n),
                list_array(pa.array(count.astype(np.int32)), rec, n),
            ],
            ["tab", "rec_id", "length", "terms", "counts"],
        )


def term_counts(records: DataFrame) -> DataFrame:
    """(tab, rec_id, length, terms, counts) of each record with at least one token; repeated records once."""
    schema = "tab string, rec_id bigint, length int, terms array<string>, counts array<int>"
    counted = records.select("tab", F.col("rec_id").cast("bigint"), "tokens").where("rec_id is not null and size(tokens) > 0")
    return counted.mapInArrow(_count, schema).where("length > 0").dropDuplicates(["tab", "rec_id"])


def distinctive_terms(records: DataFrame, hot: int = HOT) -> DataFrame:
    """Scores every term of every record of (tab, rec_id, tokens) against all other records of its tab.

    One row per record with arrays in the order of term: term, tf, records (that hold the term), p_log (ln of the
    exact hypergeometric upper tail of the count), score (-ln of it after false-discovery adjustment over the
    record's terms), tf_idf (count times ln(all records / records with the term)).

    Tokens are trimmed and lower-cased; blank and null tokens and records without any token are left out, also from
    the counts. A repeated (tab, rec_id) counts once; null ids are left out; an empty table gives no row. Ties get
    equal scores.

    Plan: counts within a record need no shuffle; one shuffle by record drops repeats; (term, count) pairs are
    aggregated before theirs. Hot terms (fewer than `hot` per tab by proof, see HOT) are looked up in a broadcast;
    only the others are joined by term, so no term's rows gather in one task.
    """
    spark = records.sparkSession
    base = materialise(term_counts(records))
    terms = base.select("tab", F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    stats = materialise(
        terms.groupBy("tab", F.col("t.terms").alias("term")).agg(F.count("*").alias("df"), F.sum("t.counts").alias("all"))
    )
    totals = {
        r["tab"]: (r["records"], r["tokens"], r["pairs"])
        for r in base.groupBy("tab").agg(F.count("*").alias("records"), F.sum("length").alias("tokens"), F.sum(F.size("terms")).alias("pairs")).collect()
    }
    is_hot = F.lit(False)
    for tab, (_, _, pairs) in totals.items():
        is_hot = is_hot | (F.col("tab").eqNullSafe(tab) & (F.col("df") * hot > pairs))
    frequent = [tuple(r) for r in stats.where(is_hot).select("tab", "term", "df", "all").collect()]
    shared = spark.sparkContext.broadcast((totals, frequent))
    rare = (
        base.select("tab", "rec_id", F.posexplode("terms").alias("at", "term"))
        .join(F.broadcast(spark.createDataFrame(frequent, "tab string, term string, df bigint, all bigint").select("tab", "term")), ["tab", "term"], "left_anti")
        .join(stats.where(~is_hot), ["tab", "term"])
        .groupBy("tab", "rec_id")
        .agg(F.sort_array(F.collect_list(F.struct("at", "df", "all"))).alias("rare"))
    )
    joined = base.join(rare, ["tab", "rec_id"], "left").select(
        "tab", "rec_id", "length", "terms", "counts", F.col("rare.at").alias("at"), F.col("rare.df").alias("df"), F.col("rare.all").alias("all")
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, frequent = shared.value
        tables: dict = {}
        for tab in totals:
            own = [f for f in frequent if f[0] == tab]
            tables[tab] = (pa.array([f[1] for f in own], pa.string()), np.array([f[2:] for f in own], dtype=np.int64).reshape(-1, 2))
        for b in batches:
            for tab in pc.unique(b.column(0)).to_pylist():
                part = b.filter(pc.equal(b.column(0), tab)) if tab is not None else b.filter(pc.is_null(b.column(0)))
                yield _score(part, totals[tab], *tables[tab])

    schema = "tab string, rec_id bigint, term array<string>, tf array<int>, records array<bigint>, p_log array<double>, score array<double>, tf_idf array<double>"
    return joined.mapInArrow(score, schema)


def _score(b: pa.RecordBatch, total: tuple[int, int, int], names: pa.Array, known: np.ndarray) -> pa.RecordBatch:
    terms, counts, at = whole(b.column(3)), whole(b.column(4)), whole(b.column(5))
    n = len(terms)
    records, tokens, _ = total
    flat, tf = terms.flatten(), np.asarray(counts.flatten()).astype(np.float64)
    owner = np.asarray(pc.list_parent_indices(terms), dtype=np.int64)
    df, everywhere = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
    where = pc.index_in(flat, value_set=names)
    found = np.asarray(where.is_valid())
    spot = np.asarray(where.fill_null(0))[found]
    df[found], everywhere[found] = known[spot, 0], known[spot, 1]
    start = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))
    place = start[np.asarray(pc.list_parent_indices(at), dtype=np.int64)] + np.asarray(at.flatten(), dtype=np.int64)
    df[place] = np.asarray(whole(b.column(6)).flatten())
    everywhere[place] = np.asarray(whole(b.column(7)).flatten())
    length = np.asarray(b.column(2)).astype(np.float64)[owner]
    # equal (count, length, occurrences) have equal tails: each is computed once
    key, back = np.unique(np.column_stack((tf, length, everywhere)), axis=0, return_inverse=True) if len(tf) else (np.zeros((0, 3)), np.zeros(0, int))
    p_log = hypergeometric_log_tail(key[:, 0], key[:, 1], key[:, 2], np.full(len(key), float(tokens)))[back.ravel()]
    lists = [pa.array(x) for x in (df, p_log, -adjusted(p_log, owner) + 0.0, tf * np.log(records / np.maximum(df, 1)))]
    return pa.RecordBatch.from_arrays(
        [b.column(0), b.column(1), terms, counts, *(list_array(x, owner, n) for x in lists)],
        ["tab", "rec_id", "term", "tf", "records", "p_log", "score", "tf_idf"],
    )


def best_term(scored: DataFrame, weight: str = "score", least_records: int = 2) -> DataFrame:
    """(tab, rec_id, term) of greatest weight (rounded to 6 decimals), the alphabetically first of equals, among
    terms that at least least_records records hold; records with no such term give no row."""
    one: Column = F.array_min(
        F.transform(
            F.filter(F.arrays_zip("term", "records", weight), lambda t: t["records"] >= least_records),
            lambda t: F.struct((-F.round(t[weight], 6)).alias("minus"), t["term"].alias("term")),
        )
    )
    return scored.select("tab", "rec_id", one["term"].alias("term")).where("term is not null")
