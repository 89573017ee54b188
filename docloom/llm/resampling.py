"""Target-distribution importance resampling: a dictionary of distinct features, hashed once each, and gains joined back to documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import dropped, stash
from docloom.llm.ranks import placed

BUCKETS = 10_000
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10
#: Features that make up 1 / FREQUENT of all occurrences or more: FREQUENT at most, so they may go to every task.
FREQUENT = 131_072
#: Features of one row of counts: a text with more has several rows.
FEATURES_A_ROW = 4096
#: Bytes of a text that are cut into words at a time, and distinct features that are held before they are given out.
WINDOW, MOST_HELD = 1 << 22, 1 << 18

#: What a word has not (every ASCII character but digits and letters) becomes a space; A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_COUNTS = "row long, id long, features array<string>, counts array<long>, n_words long, n_features long"
_COUNTS_ARROW = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("features", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("n_words", pa.int64()), ("n_features", pa.int64())])


def word_runs(text: str) -> Iterator[list[bytes]]:
    """The words of a text in order, in UTF-8, a window of the text at a time."""
    folded = text.encode().translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + WINDOW)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def features_of(text: str, longest: int) -> Iterator[tuple[Counter, int]]:
    """(features with their counts, words) of a text, part by part: runs of 1 to `longest` consecutive words, joined by a space."""
    found, words, before = Counter(), 0, []
    for run in word_runs(text):
        words += len(run)
        found.update(run)
        for n in range(2, longest + 1):
            both = before[len(before) - min(len(before), n - 1) :] + run
            found.update(b" ".join(both[i : i + n]) for i in range(len(both) - n + 1))
        before = (before + run)[-(longest - 1) :] if longest > 1 else []
        if len(found) >= MOST_HELD:
            yield found, words
            found, words = Counter(), 0
    yield found, words


def feature_counts(docs: DataFrame, longest: int = 1) -> DataFrame:
    """row, id, features, counts, n_words, n_features of `docs` (row, id, text), in rows of bounded size.

    The totals of a text are spread over its rows; a text without words has one
    row without features. A feature of a very long text may stand in several rows.
    """

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        row, key, names, counts, n_words, n_features = zip(*rows)
        plain = pa.array(names, pa.list_(pa.binary()))
        features = pa.ListArray.from_arrays(plain.offsets, plain.values.cast(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(key, pa.int64()), features, pa.array(counts, pa.list_(pa.int64())), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64())], schema=_COUNTS_ARROW)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for row, key, text in zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(), batch.column("text")):
                for found, words in features_of(text.as_py() or "", longest):
                    names, counts = list(found), list(found.values())
                    for i in range(0, len(names) or 1, FEATURES_A_ROW):
                        some = counts[i : i + FEATURES_A_ROW]
                        out.append((row, key, names[i : i + FEATURES_A_ROW], some, 0 if i else words, sum(some)))
                        held += len(some)
                        if held >= MOST_HELD:
                            yield packed(out)
                            out, held = [], 0
        if out:
            yield packed(out)

    return docs.mapInArrow(work, _COUNTS)


def _each(counts: DataFrame) -> DataFrame:
    """row, feature, n: one row a distinct feature of a text."""
    pairs = F.arrays_zip("features", "counts")
    return counts.select("row", F.explode(pairs).alias("p")).select("row", F.col("p.features").alias("feature"), F.col("p.counts").alias("n"))


def dictionary(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """feature, n, bucket: every distinct feature once, with its count over all texts and the bucket of its CRC-32."""
    found = _each(counts).groupBy("feature").agg(F.sum("n").alias("n"))
    return found.withColumn("bucket", (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for every bucket that the source has: 1000 times the log ratio of target to source, both smoothed by one a bucket, rounded down."""
    sums = lambda d, name: d.groupBy("bucket").agg(F.sum("n").alias(name))
    both = stash(sums(source, "s").join(sums(target, "t"), "bucket", "full").fillna(0, ["s", "t"]), "buckets")
    s, t = (float(x or 0) for x in both.agg(F.sum("s"), F.sum("t")).first())
    ratio = (F.col("t").cast("double") + 1) * (s + buckets) / ((F.col("s").cast("double") + 1) * (t + buckets))
    return both.where("s > 0").select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _noise(key: Column, seed: str) -> Column:
    """-1000 * ln(-ln(u)), rounded down, of a u between 0 and 1 that seed and key give."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", longest: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """id, n_features, weight, score, rank of every document: which are drawn so that the draw resembles `target`.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased;
    features are all runs of 1 to `longest` of them, joined by a space, repeats
    counted. A document's weight is the sum of its features' gains, its score adds
    Gumbel noise from seed and id; of the documents with `least_words` words or
    more, the `percent` of a hundred with the highest scores are drawn and ranked
    from 1, ties by id, null first. The rank of others is null. Null and empty texts
    have weight 0 and no place in a draw; a null id counts as empty in the noise;
    repeated rows are documents of their own. No rows give no rows; without a target
    all gains follow from the source alone.

    Features are counted over all documents and hashed once each. Those that make
    up 1 / FREQUENT of all occurrences (FREQUENT of them at most) meet the documents'
    counts by broadcast, the others by a join on the feature, where none is frequent.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = stash(feature_counts(rows, longest), "counts")  # the row numbers hold from here on
    aims = target.select(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("id"), F.coalesce(F.col(target_text_col), F.lit("")).alias("text"))
    known = stash(dictionary(counts, buckets), "dictionary")
    gains = bucket_gains(known, dictionary(feature_counts(aims, longest), buckets), buckets)
    total = counts.agg(F.sum("n_features")).first()[0] or 0
    priced = known.join(F.broadcast(gains), "bucket").select("feature", "n", "gain")  # a row a bucket
    often = F.col("n") * FREQUENT >= total
    priced = stash(priced.withColumn("often", often), "gains")
    dropped(known)

    uses = _each(counts).join(F.broadcast(priced.where("often").select("feature", "gain")), "feature", "left")
    common = uses.where("gain is not null").groupBy("row").agg(F.sum(F.col("gain") * F.col("n")).alias("weight"))
    rest = uses.where("gain is null").drop("gain").join(priced.where("not often").select("feature", "gain"), "feature")
    rare = rest.groupBy("row").agg(F.sum(F.col("gain") * F.col("n")).alias("weight"))
    heads = counts.groupBy("row").agg(F.first("id").alias("id"), F.sum("n_words").alias("n_words"), F.sum("n_features").alias("n_features"))
    parts = heads.withColumn("weight", F.lit(0).cast("long")).unionByName(common.unionByName(rare), allowMissingColumns=True)
    scored = parts.groupBy("row").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.max("n_features").alias("n_features"), F.sum("weight").alias("weight"))
    scored = stash(scored.withColumn("score", F.col("weight") + _noise(F.col("id"), seed)), "scored")
    ranked = placed(scored.where(F.col("n_words") >= least_words).withColumn("all", F.lit(0)), ["all"], [F.desc("score"), F.asc("id"), F.asc("row")])
    drawn = ranked.where(F.col("position") < F.expr(f"total * {int(percent)} div 100")).select("row", (F.col("position") + 1).alias("rank"))
    return scored.join(drawn, "row", "left").select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
