"""Mixing to target weights with soft membership, in DataFrame functions alone.

1. A naive Bayes classifier over hashed words learns domains from a labelled table, at most EXAMPLES rows of it. Its table has BUCKETS rows, so it is
   broadcast. Each text gets posteriors: the likelihoods of its words count as at most EVIDENCE words, which keeps them soft.
2. Rates r >= 0, one a document, are fitted so that the expected tokens of each domain k, sum of r * tokens * posterior_k,
   meet the targets t_k: projected gradient descent on 1/2 * sum (A_k r - t_k)^2 / t_k, from the rates s that would meet the targets
   if each domain were alone (posteriors times wanted over present tokens). Each step is multiplied by s / tokens (a diagonal metric,
   under which the projection to r >= least is exact) and carries momentum, dropped when the loss rises. A step reads the slim
   table (no text) and brings one number a domain to the driver. Rates have no upper bound. Steps go on until each domain is
   within CLOSE of its target, or until the loss no longer falls: then the targets can't be met, and `off` says by how much.
3. Copies are the rate's whole part and one more with the chance of its rest, by a hash of the document.

Null texts count as empty: they have no tokens, the posteriors of the class shares, and a rate like others. Repeated rows (same
doc_id and text) share a rate. Labelled rows with a null domain are left out; without labelled rows every posterior
is equal. An empty table gives an empty one.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.shared import work_dir, written

BUCKETS, EVIDENCE = 8192, 6
#: Labelled rows to which the classifier is fitted, at most: a documented bound.
EXAMPLES = 20_000
#: Rates are written every HELD steps. The fit ends when no domain is off by more than CLOSE, or a window of SETTLED steps cuts the loss by less than 1 %.
HELD, CLOSE, SETTLED = 6, 1e-3, 40
_SPACE = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def _bucket(word: Column) -> Column:
    """-1 for no word."""
    return F.when(word.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """Rows of docs with a label row (doc_id, ...), joined to it: a sample of `most` label rows, by hash order of doc_id.

    The sample is broadcast, within its bound, so the texts stay where they are."""
    picked = labels.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.join(F.broadcast(picked), "doc_id")


def learn(labelled: DataFrame, domains: list[str], smooth: float = 1.0) -> tuple[DataFrame, list[float]]:
    """labelled (text, domain) -> (table of bucket, l0 ... with the log-likelihoods, log shares of the domains)."""
    spark = labelled.sparkSession
    k = range(len(domains))
    rows = labelled.where(F.col("domain").isin(domains)).select("domain", F.explode_outer(_words(F.col("text"))).alias("word"), F.monotonically_increasing_id().alias("row"))
    counts = rows.groupBy(_bucket(F.col("word")).alias("bucket"), "domain").agg(F.count(F.lit(1)).alias("n"))
    wide = counts.groupBy("bucket").agg(*[F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).cast("double").alias(f"n{i}") for i, d in enumerate(domains)])
    wide = written(wide, work_dir(spark, "mixing-words"))
    totals = wide.where("bucket >= 0").agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in k]).first()
    shares = {r.domain: r["count"] for r in labelled.where(F.col("domain").isin(domains)).groupBy("domain").count().collect()}
    all_rows = sum(shares.values())
    prior = [math.log((shares.get(d, 0) + 1) / (all_rows + len(domains))) for d in domains]
    every = spark.range(-1, BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(wide, "bucket", "left")
    likely = [F.when(F.col("bucket") < 0, 0.0).otherwise(F.log((F.coalesce(f"n{i}", F.lit(0.0)) + smooth) / ((totals[f"t{i}"] or 0.0) + smooth * BUCKETS))).alias(f"l{i}") for i in k]
    return written(every.select("bucket", *likely), work_dir(spark, "mixing-model")), prior


def posteriors(docs: DataFrame, table: DataFrame, prior: list[float], evidence: int = EVIDENCE) -> DataFrame:
    """(doc_id, digest, n_rows, n_tokens, p0 ...): a row for each document (doc_id and text). n_tokens: of one of its rows."""
    k = range(len(prior))
    words = _keyed(docs).select("doc_id", "digest", F.posexplode_outer(_words(F.col("text"))).alias("at", "word"))
    words = words.withColumn("bucket", _bucket(F.col("word")))
    summed = words.join(F.broadcast(table), "bucket").groupBy("doc_id", "digest").agg(
        F.count_if(F.coalesce(F.col("at"), F.lit(0)) == 0).alias("n_rows"), F.count("word").alias("n"), *[F.sum(f"l{i}").alias(f"s{i}") for i in k]
    )
    scale = F.least(F.col("n") / F.col("n_rows"), F.lit(evidence)) / F.greatest("n", F.lit(1))
    summed = summed.select("doc_id", "digest", "n_rows", (F.col("n") / F.col("n_rows")).cast("long").alias("n_tokens"), *[(F.lit(prior[i]) + F.col(f"s{i}") * scale).alias(f"s{i}") for i in k])
    top = F.greatest(*[F.col(f"s{i}") for i in k], F.lit(float("-inf")))
    summed = summed.select("doc_id", "digest", "n_rows", "n_tokens", *[F.exp(F.col(f"s{i}") - top).alias(f"e{i}") for i in k])
    whole = sum((F.col(f"e{i}") for i in k), F.lit(0.0))
    return summed.select("doc_id", "digest", "n_rows", "n_tokens", *[(F.col(f"e{i}") / whole).alias(f"p{i}") for i in k])


def fit_rates(members: DataFrame, n_domains: int, targets, least: float = 0.0, close: float = CLOSE) -> tuple[DataFrame, list[float]]:
    """members with p0 ..., n_rows, n_tokens -> the same with `rate`, and by what share of its target each domain is off.

    targets: from present totals to wanted ones."""
    k = range(n_domains)
    root = work_dir(members.sparkSession, "mixing-rates")
    tokens = F.col("n_rows") * F.col("n_tokens")
    members = written(members, f"{root}/members")
    present = members.agg(*[F.sum(tokens * F.col(f"p{i}")).alias(f"t{i}") for i in k]).first()
    totals = [present[f"t{i}"] or 0.0 for i in k]
    wanted = targets(totals)
    if not any(wanted):
        return members.withColumn("rate", F.lit(1.0)), [0.0] * n_domains
    pace = sum((F.col(f"p{i}") * F.lit(wanted[i] / totals[i] if totals[i] > 0 else 1.0) for i in k), F.lit(0.0))
    start = F.greatest(F.lit(least), F.col("pace"))
    now = written(members.withColumn("pace", pace).withColumn("rate", start).withColumn("before", start), f"{root}/0")
    scale = [math.sqrt(max(t, 1e-9)) for t in wanted]
    first = now.agg(*[F.sum(F.col("pace") * tokens * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"m{i}_{j}") for i in k for j in k]).first()
    curve = [[(first[f"m{i}_{j}"] or 0.0) / (scale[i] * scale[j]) for j in k] for i in k]
    # no eigenvalue is above the largest row sum
    step = 1.0 / max(1e-12, *[sum(abs(x) for x in row) for row in curve])
    have_before, age, losses, i = None, 0, [], 0
    while True:
        sums = now.agg(*[F.sum(F.col("rate") * tokens * F.col(f"p{d}")).alias(f"a{d}") for d in k]).first()
        have = [sums[f"a{d}"] or 0.0 for d in k]
        off = [(have[d] - wanted[d]) / max(wanted[d], 1e-9) for d in k]
        losses.append(sum(x * x * w for x, w in zip(off, wanted, strict=True)))
        if max(abs(x) for x in off) < close or (i >= SETTLED and min(losses[-SETTLED:]) > 0.99 * min(losses[:-SETTLED])):
            break
        age = 0 if have_before is None or losses[-1] > losses[-2] else age + 1
        push = age / (age + 3)
        ahead = F.col("rate") + F.lit(push) * (F.col("rate") - F.col("before"))
        off_ahead = [off[d] + push * (have[d] - have_before[d]) / max(wanted[d], 1e-9) if push else off[d] for d in k]
        slope = sum((F.col(f"p{d}") * F.lit(step * off_ahead[d]) for d in k), F.lit(0.0))
        # one select, so that both columns come from the step before
        moved = F.greatest(F.lit(least), ahead - F.col("pace") * slope)
        now = now.select(*[c for c in now.columns if c not in ("rate", "before")], moved.alias("rate"), F.col("rate").alias("before"))
        have_before, i = have, i + 1
        if i % HELD == 0:
            now = written(now, f"{root}/{i}")
    if max(abs(x) for x in off) >= close:
        logging.getLogger(__name__).warning("targets can't be met: domains are off by %s of them", ", ".join(f"{x:.4f}" for x in off))
    return now.drop("pace", "before"), off


def weighted(weights: list[float]):
    """Targets that keep the total: weights of all tokens."""
    return lambda totals: [w / sum(weights) * sum(totals) for w in weights]


def weighted_without_loss(weights: list[float], least_share: float = 1e-4):
    """Targets in proportion to the weights, as large as the domain that is above its weight most: no rate need fall below 1.

    Domains that hold under least_share of all tokens don't set the size."""

    def targets(totals):
        size = max((t / w for t, w in zip(totals, weights, strict=True) if w > 0 and t > least_share * sum(totals)), default=0.0)
        return [w * size for w in weights]

    return targets


def copies(rate: Column, *key: Column) -> Column:
    rest = F.pmod(F.xxhash64(*key, F.lit("copies")), F.lit(1_000_000)) / 1_000_000.0
    return (F.floor(rate) + (rest < rate - F.floor(rate)).cast("int")).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, domains: list[str], targets, least: float = 0.0) -> DataFrame:
    """(doc_id, digest, n_rows, n_tokens, p_<domain> ..., rate, copies, off): a row for each document.

    off, alike in all rows: for each domain, (expected tokens - target) / target as the fit left it."""
    table, prior = learn(labelled, domains)
    members, off = fit_rates(posteriors(docs, table, prior), len(domains), targets, least)
    named = [F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)]
    left = F.struct(*[F.lit(float(x)).alias(d) for d, x in zip(domains, off, strict=True)]).alias("off")
    return members.select("doc_id", "digest", "n_rows", "n_tokens", *named, "rate", copies(F.col("rate"), F.col("doc_id"), F.col("digest")).alias("copies"), left)


def resampled(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """docs, each row as often as its document has copies."""
    rates = mixed.select(F.col("doc_id").alias("id"), "digest", "copies").where("copies > 0")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that no column of docs clashes with one of these
    keyed = docs.select(whole, F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.col("text").cast("string")).alias("own_digest"))
    joined = keyed.join(rates, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_digest") == F.col("digest")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
