"""Mixing sources to target weights: Poisson replication with hash-seeded inversion, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalis.llm.common import stage

#: Without given weights a source's target weight is its row count to this power.
TEMPERATURE = 0.7
EPOCHS = 1.0
#: A table of rates with at most so many entries of distribution functions (8 bytes each) is broadcast; a larger one is
#: joined by source, where Spark splits hot sources.
BROADCAST_ENTRIES = 4_000_000
SEED = "mix-1"


def uniform(*parts) -> F.Column:
    """A number in (0, 1) from the md5 of the parts joined by ``|`` (null: the word null)."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 1) / (2.0**52 + 1)


def source_rates(docs: DataFrame, weights: DataFrame | None = None, *, source: str = "source",
                 temperature: float = TEMPERATURE, epochs: float = EPOCHS) -> DataFrame:
    """Per source: ``n`` rows, target ``share`` of the output and mean repetition ``rate`` of a row.

    ``weights`` has columns ``source`` and ``weight``; sources it does not name get 0. Null and
    empty source names are one source. ``share`` sums to 1, so the expected output has
    ``epochs`` times the input's rows. An empty table has no rates.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("_source")).agg(F.count("*").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = weights.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("_source")).agg(
            F.sum(F.col("weight").cast("double")).alias("w"))
        sizes = sizes.join(given, "_source", "left").withColumn("w", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)))
    sizes = stage(sizes, "sizes")
    total = sizes.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    rows, weight = float(total["n"] or 0), float(total["w"] or 0)
    if rows and not weight:
        raise ValueError("no source of the table has a positive weight")
    share = F.col("w") / F.lit(weight or 1.0)
    return sizes.select("_source", "n", share.alias("share"), (F.lit(rows * epochs) * share / F.col("n")).alias("rate"))


def poisson_cdf(rate) -> F.Column:
    """Array of the distribution function at 0, 1, ... up to where all that remains is below rounding."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    step = lambda acc, k: F.struct(
        (acc["p"] + F.log(rate) - F.log(k.cast("double"))).alias("p"),
        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(acc["p"] + F.log(rate) - F.log(k.cast("double"))))).alias("cdf"))
    start = F.struct((-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(1.0)))


def poisson_mix(docs: DataFrame, weights: DataFrame | None = None, *, key: str = "doc_id", source: str = "source",
                temperature: float = TEMPERATURE, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """Repeat each row by a Poisson draw with its source's rate and shuffle the copies globally.

    Returns the input's columns, then ``replica`` (1 to ``n_copies``), ``n_copies`` and
    ``shuffle_key``. The draw inverts the Poisson distribution at a number hashed from seed and
    ``key``, so reruns give the same rows and rows that share a key share the draw. Rows are
    dealt to partitions and ordered inside them by ``shuffle_key``, a hash of seed, key and
    replica. Null keys and null texts are rows like any other; columns of the input named like
    an added one are replaced. Rows that are equal stay separate. An empty table gives an empty result. The table of
    rates is broadcast after a check of its size, so documents are shuffled once, by ``shuffle_key``; over
    ``BROADCAST_ENTRIES`` they are joined by source first.
    """
    rates = source_rates(docs, weights, source=source, temperature=temperature, epochs=epochs)
    cdf = stage(rates.select("_source", poisson_cdf(F.col("rate")).alias("_cdf")), "cdf")
    if (cdf.agg(F.sum(F.size("_cdf") + 8)).first()[0] or 0) <= BROADCAST_ENTRIES:
        cdf = F.broadcast(cdf)
    columns = [c for c in docs.columns if c not in ("replica", "n_copies", "shuffle_key", "_source", "_cdf")]
    drawn = (docs.select(*columns).withColumn("_source", F.coalesce(F.col(source), F.lit("")))
             .join(cdf, "_source")
             .withColumn("_u", uniform(F.lit(seed), F.col(key)))
             .withColumn("n_copies", F.size(F.filter("_cdf", lambda c: c < F.col("_u"))))
             .where("n_copies > 0"))
    copies = drawn.select(*columns, "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("replica"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(
        "|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("replica").cast("string"))))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", *([key] if key in columns else [])).select(
        *columns, "replica", "n_copies", "shuffle_key")


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, repeated to shares of row count to the power 0.7 and shuffled."""
    return poisson_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH sizes AS (
  SELECT coalesce(source, '') AS s, count(*) AS n, pow(count(*)::DOUBLE, 0.7) AS w FROM documents GROUP BY 1
), rates AS (
  SELECT s, (sum(n) OVER ()) * (w / sum(w) OVER ()) / n AS rate FROM sizes
), cdf AS (
  SELECT s, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS c
  FROM rates, range(0, 80) AS t(k)
), drawn AS (
  SELECT d.*, (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 1)
              / (pow(2.0, 52) + 1) AS u
  FROM documents d
), counted AS (
  SELECT doc_id, text, lang, source, n_chars,
         (SELECT count(*) FROM cdf WHERE s = coalesce(source, '') AND c < u)::INTEGER AS n_copies
  FROM drawn
), copies AS (
  SELECT *, unnest(range(1, n_copies + 1))::INTEGER AS replica FROM counted
)
SELECT doc_id, text, lang, source, n_chars, replica, n_copies,
       md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null') || '|' || replica::VARCHAR) AS shuffle_key
FROM copies
"""
