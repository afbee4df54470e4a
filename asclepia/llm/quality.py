"""A quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Both models are distributions over ``BUCKETS`` hash buckets of words, punctuation runs and pairs of neighbours. The raw
model counts all documents; the target model counts the documents labelled good in a bounded sample of the labelled rows. A document's
log weight is the sum, over its n-grams, of log p_target - log p_raw. Sampling k documents without replacement in proportion to the weights is
taking the k largest of log weight + Gumbel noise. k is how many documents weigh at least the value that best parts good
from bad in labelled documents that the target model has not seen, so what is not taken is what the classifier rejects.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asclepia.llm._base import arrow, at_rest, located, small_side, written
from asclepia.llm._hashing import mix, word_hashes

BUCKETS = 1 << 14
#: The model of good text is fitted on about half as many labelled documents at most, the threshold on the other half.
MAX_LABELLED = 20_000
_PAIR = np.uint64(0x9FB21C651E98DF25)


def buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word and each pair of neighbours of each text, and where each text's begin."""
    words, at = word_hashes(texts, punctuation=True, fold=False)
    pairs = mix(words[:-1] * _PAIR + words[1:]) if len(words) > 1 else np.empty(0, np.uint64)
    inside = np.ones(len(pairs), bool)
    cuts = at[1:-1]
    inside[cuts[(cuts > 0) & (cuts < len(words))] - 1] = False
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    codes = np.concatenate([words, pairs[inside]]) % np.uint64(BUCKETS)
    owners = np.concatenate([owner, owner[:-1][inside] if len(words) > 1 else owner[:0]])
    order = np.argsort(owners, kind="stable")
    return codes[order].astype(np.int64), np.searchsorted(owners[order], np.arange(len(texts) + 1))


def labelled_sample(labels: DataFrame, most: int = MAX_LABELLED) -> tuple[DataFrame, int]:
    """About ``most`` rows of doc_id, good and model at most, picked by a hash of the id; of several labels of one id the best counts.

    ``model`` halves them by another hash: true for the target model, false for the threshold.
    """
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("quality"))
    n = rows.count()
    picked = rows.filter(F.pmod(F.xxhash64("_id", F.lit("quality")), F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30)))
    picked = picked.groupBy("_id").agg((F.max("quality") > 0).alias("good")).withColumn("model", F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)) == 0)
    picked = written(picked, "quality-labels")
    return picked, picked.count()


def weighed(docs: DataFrame, labels: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MAX_LABELLED) -> DataFrame:
    """A written table: id, log_weight, gumbel_key, good (the label, of the sample's half for the threshold), _file, _row."""
    spark = docs.sparkSession
    arrow(spark)
    docs = at_rest(docs)
    sample, n_sample = labelled_sample(labels, most_labelled)
    rows = located(docs, {"id": F.col(id_col).cast("long"), "text": F.col(text_col)})
    rows = rows.join(small_side(sample, n_sample), F.col("id") == F.col("_id"), "left").drop("_id")
    rows = rows.select("id", "text", (F.col("good") & F.col("model")).alias("target"), F.when(~F.col("model"), F.col("good")).alias("good"), "_file", "_row")

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            codes, at = buckets(batch.column(0).to_pylist())
            raw += np.bincount(codes, minlength=BUCKETS)
            good = np.repeat(np.array([bool(g) for g in batch.column(1).to_pylist()]), np.diff(at))
            target += np.bincount(codes[good], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    counted = rows.select("text", "target").mapInArrow(count, "bucket long, raw long, target long")
    table = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS rows at most
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)  # add-one smoothing
    for b, r, t in table:
        raw[b] += r
        target[b] += t
    if not target.sum() > BUCKETS:  # no good label: nothing to tell apart
        target = raw
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())

    def weigh(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            codes, at = buckets(texts)
            sums = np.concatenate([[0.0], np.cumsum(ratio[codes])])
            weight = sums[at[1:]] - sums[at[:-1]]
            uniform = (mix(np.array(batch.column(2).to_pylist(), np.int64).astype(np.uint64)) >> np.uint64(11)).astype(np.float64) + 0.5
            noise = -np.log(-np.log(uniform / (1 << 53)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(weight + noise), *batch.columns[3:]], names=["id", "log_weight", "gumbel_key", "good", "_file", "_row"])

    rows = rows.select("id", "text", F.xxhash64("id", "text", F.lit(seed)).alias("noise"), "good", "_file", "_row")
    return written(rows.mapInArrow(weigh, "id long, log_weight double, gumbel_key double, good boolean, _file string, _row long"), "quality-weights")


def threshold(scores: DataFrame) -> float:
    """The log weight from which the labelled sample counts as good: fewest documents misjudged.

    Of several rows with one id the heaviest counts, so that as many rows come to the driver as the sample has at most. Of all
    cuts that are best, the middle of the widest gap is taken; without both kinds of labels everything passes.
    """
    rows = scores.filter("good IS NOT NULL").groupBy("id").agg(F.max("log_weight").alias("log_weight"), F.first("good").alias("good")).toPandas().sort_values("log_weight")
    good = rows["good"].to_numpy(bool)
    if not good.any() or good.all():
        return float("-inf")
    weights = rows["log_weight"].to_numpy()
    # Cutting before row i rejects i rows: good rows lost and bad rows kept. Most rows are good, so they come first.
    lost = np.concatenate([[0], np.cumsum(good)])
    kept = (~good).sum() - np.concatenate([[0], np.cumsum(~good)])
    edges = np.concatenate([[-np.inf], weights, [np.inf]])
    possible = edges[1:] > edges[:-1]
    errors = np.where(possible, lost + kept, np.inf)
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    gaps = [(min(edges[i + 1], weights[-1]) - max(edges[i], weights[0]), i) for i in best]
    _, i = max(gaps)
    if np.isinf(edges[i]) or np.isinf(edges[i + 1]):
        return float(edges[i + 1] if np.isinf(edges[i]) else np.nextafter(edges[i], np.inf))
    return float((edges[i] + edges[i + 1]) / 2)


def _kth(rows: DataFrame, k: int, key: Column) -> tuple[object, int]:
    """The k-th largest ``key`` of ``rows`` and how many rows are above it, from counts in ever finer ranges."""
    rows = rows.select(key.alias("k"))
    low, high = rows.agg(F.min("k"), F.max("k")).first()
    above = 0
    while low < high:
        width = (float(high) - float(low)) / STEPS
        inside = rows.filter(F.col("k").between(low, high))
        bucket = F.least(F.floor((F.col("k").cast("double") - float(low)) / width), F.lit(STEPS - 1)) if width > 0 else F.lit(0)
        counts = inside.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)), F.min("k"), F.max("k")).orderBy(F.desc("b")).collect()
        if len(counts) == 1:  # values that are too near for the buckets: by value
            counts = [(0, n, v, v) for v, n in inside.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("k")).limit(STEPS).select("k", "n").collect()]
        for _, n, least, most in counts:
            if above + n >= k:
                low, high = least, most
                break
            above += n
        else:
            high = counts[-1][2]  # go on below
            rows = rows.filter(F.col("k") < high)
            high = rows.agg(F.max("k")).first()[0]
    return low, above


#: Ranges of one round of counting.
STEPS = 1_024


def largest(scores: DataFrame, k: int, key: str = "gumbel_key") -> DataFrame:
    """``scores`` with taken: whether a row is one of the ``k`` with the largest ``key`` (ties: smaller id, null first, then row in the file, then file).

    The k-th key is found by counting rows in ever finer ranges, each count a map-side aggregation; nothing is sorted
    as a whole. Rows that tie with it are counted in the same way by id, and those that tie again by their row in the file.
    """
    n = scores.count()
    if k >= n or k <= 0:
        return scores.withColumn("taken", F.lit(k > 0))
    keys = [F.col(key), -F.coalesce(F.col("id").cast("decimal(20,0)"), F.lit(-(1 << 63)).cast("decimal(20,0)")), -F.col("_row")]
    taken, rows, left = F.lit(False), scores, k
    tied = F.lit(True)
    for by in keys:
        value, above = _kth(rows, left, by)
        bound = F.lit(value)
        taken, tied, left = taken | (tied & (by > bound)), tied & (by == bound), left - above
        rows = scores.filter(tied)
    # Rows of one key, id and row number are in different files: no more than there are files.
    last = rows.select("_file").orderBy("_file").limit(left).agg(F.max("_file")).first()[0]
    return scores.withColumn("taken", taken | (tied & (F.col("_file") <= F.lit(last))))


def classified(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, log_weight, gumbel_key, kept, _file, _row.

    Null or empty text has no n-grams and weight 0; null ids are never labelled; without usable labels all documents are kept; an empty
    table gives no rows; repeated rows draw the same noise; other columns are not looked at. Reruns agree.
    """
    scores = weighed(docs, labels, **options)
    cut = threshold(scores)
    k = scores.filter(F.col("log_weight") >= F.lit(cut)).count()
    return largest(scores, k).select(F.col("id").alias(options.get("id_col", "doc_id")), "log_weight", "gumbel_key", F.col("taken").alias("kept"), "_file", "_row")
