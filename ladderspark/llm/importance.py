"""Target-distribution importance resampling: hashed features, array-scored weights, Gumbel keys, and a cutoff bracketed by a quantile sketch."""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderspark.llm.common import query, table, whole_text
from ladderspark.operators.scan import row_numbers
from ladderspark.storage import materialize

BUCKETS = 10_000  # at most 65,536: a feature is stored in two bytes
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024:"
SKETCH = 1000  # the first bracket is four of the sketch's errors N / SKETCH wide
BLOCK = 1 << 22  # bytes of a text whose words are listed at once
MAX_MEMO = 300_000

# Lower case for A-Z; every byte below 0x80 that is no digit or letter parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class _Buckets(dict):
    """Word -> bucket; at most MAX_MEMO words are remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_MEMO:
            self.clear()
        found = self[word] = zlib.crc32(word) % self.buckets
        return found


def word_lists(raw: bytes):
    """UTF-8 text -> lists of its words, block by block."""
    raw = raw.translate(_FOLD)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + BLOCK)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _features(names: list[str], buckets: int):
    """(..., text) -> (..., row, features): a number for the row, and the bucket of every word as unsigned 16-bit integers."""
    def rows(batches):
        import pyarrow as pa

        bucket_of, uid = _Buckets(buckets), TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 1000):
                part = batch.slice(at, 1000)
                found = []
                for text in part.column(part.num_columns - 1).cast(pa.binary()).to_pylist():
                    own = b""
                    for words in word_lists(text):
                        own += np.fromiter(map(bucket_of.__getitem__, words), np.uint16, len(words)).tobytes()
                    found.append(own)
                number = pa.array(np.arange(uid, uid + len(found), dtype=np.int64))
                uid += len(found)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], number, pa.array(found, pa.binary())], names=names)

    return rows


def hashed_features(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Stored: doc_id, row (distinct numbers), features of every row of docs (doc_id, text)."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return materialize(given.mapInArrow(_features(["doc_id", "row", "features"], buckets), "doc_id long, row long, features binary"), "hashed-features")


def _histogram(buckets: int):
    def rows(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for own in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(own, np.uint16), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return rows


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features in every bucket. The driver gets one number for each bucket, a fixed amount."""
    parts = features.select("features").mapInArrow(_histogram(buckets), "bucket int, n long")
    counts = [0] * buckets
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def gains(raw: list[int], target: list[int]) -> list[int]:
    """What one feature of each bucket adds to the log weight, in thousandths."""
    n, s_all, t_all = len(raw), sum(raw), sum(target)
    return [math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(raw, target)]


def _weights(values):
    def rows(batches):
        import pyarrow as pa

        gain = np.array(values.value, np.int64)
        for batch in batches:
            own = [np.frombuffer(f, np.uint16) for f in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(f) for f in own], pa.int64()), pa.array([int(gain[f].sum()) for f in own], pa.int64())],
                names=["doc_id", "row", "n_features", "weight"])

    return rows


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """The key noise of an id, in thousandths, floored."""
    sha = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(sha, 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0).cast("long")


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]


def cutoff(keyed: DataFrame, n: int, k: int):
    """(score, doc_id, row) of the k-th of the n rows of keyed in the order of _order().

    A quantile sketch proposes a bracket of scores. The rows above it and inside it are counted exactly: the bracket is right if the place k falls inside; otherwise
    it is doubled on the side that misses. Only the rows of the bracket are sorted.
    """
    wide = 4.0 / SKETCH
    below, above = 1 - k / n - wide, 1 - k / n + wide
    while True:
        sketch = keyed.agg(F.percentile_approx("score", [max(0.0, below), min(1.0, above)], SKETCH)).first()[0]
        low = sketch[0] if below > 0 else None
        high = sketch[1] if above < 1 else None
        inside = F.lit(True)
        inside = inside & (F.col("score") >= low) if low is not None else inside
        inside = inside & (F.col("score") <= high) if high is not None else inside
        higher = F.count_if(F.col("score") > high) if high is not None else F.lit(0).cast("long")
        over, within = keyed.agg(higher, F.count_if(inside)).first()
        if over < k <= over + within:
            break
        wide *= 2
        below, above = (below, above + wide) if over >= k else (below - wide, above)
    placed = row_numbers(keyed.where(inside).select("score", "doc_id", "row"), [], _order(), "place")
    return placed.where(F.col("place") == k - over).select("score", "doc_id", "row").first()


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_features, weight, score, rank.

    Features are words (A-Z lower-cased, runs of letters, digits and characters beyond ASCII), hashed into buckets. weight sums floored log ratios of the
    target's and the documents' share of each bucket; score adds Gumbel noise drawn by doc_id, so the highest scores are a sample without replacement. Of the N rows with at least
    `least` features floor(percent * N / 100) are drawn: rank 1, 2, 3... by score, ties to the smaller doc_id, null ids last, then any fixed order of equal rows; others have a null rank.
    Null texts have no features, null ids count as the empty text in the noise. Repeated rows are rows of their own. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    own = hashed_features(docs, buckets)
    raw = bucket_counts(own, buckets)
    wanted = bucket_counts(hashed_features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets), buckets)
    values = spark.sparkContext.broadcast(gains(raw, wanted))
    weighed = own.mapInArrow(_weights(values), "doc_id long, row long, n_features long, weight long")
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "importance-scores")
    keyed = scored.where(F.col("n_features") >= least)
    n = keyed.count()
    k = n * percent // 100
    drawn = F.lit(False)
    if k > 0:
        last = cutoff(keyed, n, k)
        # In the order of _order(), with null ids last.
        same_id = F.col("doc_id").eqNullSafe(F.lit(last.doc_id))
        earlier_id = F.col("doc_id").isNotNull() if last.doc_id is None else F.col("doc_id") < last.doc_id
        upto = (F.col("score") > last.score) | ((F.col("score") == last.score) & (F.coalesce(earlier_id, F.lit(False)) | (same_id & (F.col("row") <= last.row))))
        drawn = (F.col("n_features") >= least) & upto
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = row_numbers(scored.where(drawn), [], _order(), "rank").select(*columns, F.col("rank").cast("long").alias("rank"))
    return ranked.union(scored.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


SQL_13 = r"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
w AS (
  SELECT 0 AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 1, NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM w)),
bytes AS (SELECT w, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT) AS b FROM hexed),
b AS (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
f AS (SELECT side, doc_id, bucket FROM w JOIN b USING (w)),
n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f GROUP BY bucket),
a AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM n),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM n, a),
d AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN g USING (bucket) WHERE side = 0 GROUP BY doc_id),
k AS (
  SELECT documents.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || sha256('2024:' || documents.doc_id::VARCHAR)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM documents LEFT JOIN d USING (doc_id)),
r AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM k)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM r
"""


@query("op13_importance_resampling", SQL_13)
def op13_importance_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
