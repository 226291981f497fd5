"""Quality rules: base measures of a text, and the log-likelihood ratio of its hashed n-grams between a trusted target
and the raw corpus. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stash, free_name, held

BUCKETS = 1 << 14
#: Most labelled documents that the target's multinomial is fitted on.
TARGET_ROWS = 20_000
#: Ids of labelled documents that are broadcast to find their texts; more are joined by exchange.
BROADCAST_IDS = 1_000_000
#: The threshold lies so many interquartile ranges of the target's ratios below their lower quartile.
FENCE = 4.0
#: Added to each bucket's counts, as a share of the corpus's smoothed distribution.
SMOOTHING = 200.0

WORD_SPACE = r"[\x20\x09-\x0D]"


def word_list(text: Column) -> Column:
    """Runs of characters other than ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{WORD_SPACE}+"), "")


def with_words(docs: DataFrame, names: list[str]) -> DataFrame:
    """Adds the words, their hashes, and how many there are."""
    w, h, n = names
    step = docs.withColumn(w, word_list(F.col("text")))
    return step.withColumn(h, held(F.transform(w, lambda x: F.xxhash64(x)))).withColumn(n, F.size(w))


def gram_weight_sum(h: Column, scores: Column, buckets: int) -> Column:
    """Sum of the weights of each word, and of each word with the next one or the end."""
    weight = lambda x: F.get(scores, x.bitwiseAND(F.lit(buckets - 1)).cast("int"))
    return F.aggregate(F.transform(h, lambda x, i: weight(x) + weight(F.xxhash64(x, F.get(h, i + 1)))), F.lit(0.0), lambda acc, v: acc + v)


def gram_buckets(h: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of each word, and of each word with the next one or the end, from the words' hashes."""
    low = lambda x: x.bitwiseAND(F.lit(buckets - 1)).cast("int")
    return F.concat(F.transform(h, low), F.transform(h, lambda x, i: low(F.xxhash64(x, F.get(h, i + 1)))))


def base_measures(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Columns of these names are replaced; a null text counts as the empty one.
    """
    out = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in out])
    w, h, n, bits, mask, s, lines = free_name(docs, "qw", "qh", "qn", "qbits", "qmask", "qsorted", "qlines")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    step = with_words(docs, [w, h, n])
    step = step.withColumn(lines, F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # a window's hash with its place in the low bits: sorting brings equal windows together
    step = step.withColumn(bits, F.expr(f"coalesce(cast(ceil(log2(greatest({n}, 2))) as int), 1)"))
    step = step.withColumn(mask, F.expr(f"shiftleft(-1L, {bits})"))
    step = step.withColumn(s, held(F.expr(f"case when {n} >= 3 then sort_array(transform(slice({h}, 1, {n} - 2), (x, i) -> (xxhash64(x, get({h}, i + 1), get({h}, i + 2)) & {mask}) | cast(i as bigint))) else cast(array() as array<bigint>) end")))
    at = lambda x: f"cast({x} & ~{mask} as int)"
    equal = f"filter(sequence(0, size({s}) - 2), i -> ((get({s}, i) ^ get({s}, i + 1)) & {mask}) = 0)"
    pairs = f"transform({equal}, i -> struct({at(f'get({s}, i)')} as a, {at(f'get({s}, i + 1)')} as b))"
    # equal in the bits compared so far: the words decide
    true = f"filter({pairs}, x -> get({h}, x.a) = get({h}, x.b) and get({h}, x.a + 1) = get({h}, x.b + 1) and get({h}, x.a + 2) = get({h}, x.b + 2))"
    covered = f"case when size({s}) > 1 then size(array_distinct(flatten(transform({true}, x -> array(x.a, x.a + 1, x.a + 2, x.b, x.b + 1, x.b + 2))))) else 0 end"
    text = F.coalesce(F.col("text"), F.lit(""))
    step = step.select(
        *kept, F.col(n).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), F.expr(covered).cast("long").alias("n_repeat_words"), F.col(h),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return step.select(*kept, *[F.col(c) for c in out[:-1]], failed.alias("base_failed"), F.col(h).alias("word_hashes"))


def trusted_ids(labels: DataFrame, name: str = "trusted_id") -> DataFrame:
    """Ids of all trusted documents, as column ``name``: quality 1."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name)).distinct()


def target_sample(ids: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """At most ``rows`` of the ids, by a hash."""
    (name,) = ids.columns
    return ids.orderBy(F.xxhash64(name, F.lit(11)), name).limit(rows)


def gram_weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Log ratio of target and corpus probability for each bucket; the corpus counts are over all documents.

    The target's counts are smoothed toward the corpus. Without any target document all weights are 0.
    """
    names = free_name(docs, "qw", "qh", "qn", "trusted")
    w, h, n, flag = names
    (trusted,) = target.columns
    marked = docs.select("doc_id", "text").join(F.broadcast(target), F.col("doc_id") == F.col(trusted), "left")  # TARGET_ROWS ids at most
    grams = with_words(marked.select("text", F.col(trusted).isNotNull().alias(flag)), [w, h, n]).select(flag, F.explode_outer(gram_buckets(F.col(h), buckets)).alias("b"))
    rows = grams.where("b IS NOT NULL").groupBy("b").agg(F.count("*").alias("c"), F.count_if(flag).alias("t")).collect()  # a row for each bucket
    raw, mine = [0] * buckets, [0] * buckets
    for r in rows:
        raw[r.b], mine[r.b] = r.c, r.t
    all_raw, all_mine = sum(raw), sum(mine)
    if not all_mine:
        return [0.0] * buckets
    p = [(c + 0.5) / (all_raw + 0.5 * buckets) for c in raw]
    return [round(math.log((t + SMOOTHING * q) / (all_mine + SMOOTHING) / q), 6) for t, q in zip(mine, p, strict=True)]


def score_quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, fence: float = FENCE) -> DataFrame:
    """``docs`` with the base measures, base_failed, ``llr`` (log-likelihood ratio for each n-gram) and ``kept``.

    kept: base_failed is false, and llr reaches the threshold: ``fence`` interquartile ranges below the lower quartile
    of all documents labelled quality 1 that pass the base rules (their ratios rounded to four digits). The target's
    counts are those of a bounded sample of these documents; the corpus is every document. Without labelled documents llr
    is 0 and the base rules decide. A text without words has llr 0. Nulls and empty texts have no words; equal rows are
    scored alike; an empty table gives an empty result. Columns of the result's names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("llr", "kept", "word_hashes")])
    (trusted,) = free_name(docs, "trusted_id")
    stash = Stash(spark)
    ids = stash(trusted_ids(labels, trusted))
    target = stash(target_sample(ids))
    weights = gram_weights(docs, target, buckets)
    few = ids.count() <= BROADCAST_IDS
    mine = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col(trusted), "left_semi")
    # of rounded values there are few different ones, which bounds what the exact percentile holds
    ratio = F.when(~F.col("base_failed"), F.round("llr", 4))
    at = with_ratio(mine, weights, buckets).agg(F.percentile(ratio, [0.25, 0.75])).first()[0]
    stash.drop(ids, target)
    limit = -math.inf if at is None else float(at[0] - fence * (at[1] - at[0]))
    return with_ratio(docs, weights, buckets).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(limit)))


def with_ratio(docs: DataFrame, weights: list[float], buckets: int) -> DataFrame:
    """The base measures and ``llr``: the mean weight of the text's n-grams."""
    measured = base_measures(docs)
    # a constant that the optimizer folds once; a subquery can't stand in a lambda, a column would be copied to each row
    scores = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    n = F.col("n_words")
    total = F.when(n == 0, 0.0).otherwise(gram_weight_sum(F.col("word_hashes"), scores, buckets) / (2 * n))
    return measured.withColumn("llr", F.round(total, 9)).drop("word_hashes")
