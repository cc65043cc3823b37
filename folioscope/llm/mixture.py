"""Problem 8: documents of several sources mixed to target shares of tokens.

Each source gets a rate of copies a document: its share of the mixture's tokens over the tokens it has, at most its
``max_repeats``. The mixture is as large as the rates allow with every source at its share (shares of sources that have
no tokens are spread over the others), or ``total_tokens`` if given; then sources at their limit give less and the
shares reached are reported as they are.

Which documents get how many copies is systematic sampling: within a source the documents stand in the order of a hash,
expected copies are summed up along it, one random offset is added, and a document is emitted once for each integer that
its step crosses, so copies of a document differ from the rate by less than one and those of a source by less than one in
all. The prefix sums run over buckets: a count for each (source, bucket) gives the buckets' offsets, and documents are
numbered within their bucket only, so a source that holds a third of all rows is spread over ``BUCKETS`` groups.

Defined results: documents without source, of a source without target, or without tokens (null and empty texts) are not
drawn; repeated doc_ids count once; a target without documents is reported with 0 tokens. Empty tables give no documents
and a report of zeros. A null share or limit counts as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.encode import TOKENIZERS, token_counts
from folioscope.sources.tables import stored

BUCKETS = 4096
SEED = 20260525


def sized(docs: DataFrame, targets: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens, bucket) of the documents that can be drawn, written once to the shared folder."""
    named = targets.select("source").where("source IS NOT NULL").distinct()
    tokens = token_counts(docs.select("doc_id", "source", "text").where("source IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL"), "doc_id", "source", folder=folder)
    one = tokens.where("n_tokens > 0").groupBy("doc_id").agg(F.min_by("source", "source").alias("source"), F.max("n_tokens").alias("n_tokens"))
    kept = one.join(F.broadcast(named), "source", "left_semi")  # one row a source that has a target: the table is fixed
    return stored(kept.select("doc_id", "source", "n_tokens", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(BUCKETS)).cast("int").alias("bucket")), "mixture")


def rates(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row a source of the targets: its tokens, share wanted, rate of copies and random offset."""
    want = targets.groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    x = want.where("source IS NOT NULL").join(F.broadcast(have), "source", "left").na.fill(0, ["tokens", "documents"])
    over = Window.partitionBy(F.lit(1))  # over the few rows of the targets
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0)
    share = F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(over)).otherwise(0.0)
    x = x.withColumn("share", share)
    most = F.min(F.when(F.col("share") > 0, F.col("tokens") * F.col("max_repeats") / F.col("share"))).over(over)
    x = x.withColumn("size", F.lit(float(total_tokens)) if total_tokens is not None else most)
    rate = F.when(F.col("tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("share") * F.col("size") / F.col("tokens"))).otherwise(0.0)
    # A fixed fraction of each source's name: random to the documents, the same on every run.
    return x.withColumn("rate", F.coalesce(rate, F.lit(0.0))).withColumn("offset", F.pmod(F.xxhash64("source", F.lit(SEED)), F.lit(1_000_003)) / 1_000_003.0)


def draw(docs: DataFrame, rate: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents drawn at least once."""
    counts = docs.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows a source
    starts = counts.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = docs.join(starts, ["source", "bucket"])  # by the keys that the numbering below needs anyhow; Spark broadcasts it only where its size allows
    within = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id")
    placed = placed.withColumn("place", F.col("start") + F.row_number().over(within))
    placed = placed.join(F.broadcast(rate.select("source", "rate", "offset")), "source")
    step = lambda place: F.floor(place * F.col("rate") + F.col("offset"))
    return placed.withColumn("copies", step(F.col("place")) - step(F.col("place") - 1)).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, folder: str = TOKENIZERS) -> DataFrame:
    s = sized(docs, targets, folder)
    return draw(s, rates(s, targets, total_tokens))


def shares(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, folder: str = TOKENIZERS) -> DataFrame:
    """One row a target: what was wanted, what was drawn, and the share reached."""
    s = sized(docs, targets, folder)
    r = rates(s, targets, total_tokens)
    got = draw(s, r).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("mixed_documents"), F.max("copies").alias("most_copies"))
    x = r.select("source", "target_share", "max_repeats", "documents", "tokens").join(F.broadcast(got), "source", "left").na.fill(0, ["mixed_tokens", "mixed_documents", "most_copies"])
    total = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))
    return x.withColumn("actual_share", F.when(total > 0, F.round(F.col("mixed_tokens") / total, 6)).otherwise(0.0))
