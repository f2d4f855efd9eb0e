"""Request costs and the content-addressed answer cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: USD per million input and output tokens where no price fits, and what batches cost of the full price.
DEFAULT_PRICE = (2.50, 10.00)
BATCH_SHARE = 0.5


def priced(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """``requests`` with ``price_in, price_out`` of its ``model``: the exact name, else the longest prefix, else the default.

    ``prices`` (``name, price_in, price_out``) is a price list of a few dozen rows and is broadcast. An exact name is
    its own longest prefix, so one rule serves both. Distinct models are priced once.
    """
    models = requests.select("model").distinct()
    met = models.join(F.broadcast(prices), F.col("model").startswith(F.col("name")))
    best = met.groupBy("model").agg(F.max_by(F.struct("price_in", "price_out"), F.length("name")).alias("p"))
    out = requests.join(best, "model", "left")
    return out.withColumns({"price_in": F.coalesce("p.price_in", F.lit(DEFAULT_PRICE[0])), "price_out": F.coalesce("p.price_out", F.lit(DEFAULT_PRICE[1]))}).drop("p")


#: Units of ``cost_units`` in a USD: half hundredths of a cent a million tokens.
UNITS = 2e10


def cost_units(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column, batch: Column) -> Column:
    """A cost as a whole number of ``1 / UNITS`` USD, so that sums are exact in any order; prices have four decimals."""
    whole = lambda c: F.round(c * 10_000).cast("long")
    return (tokens_in * whole(price_in) + tokens_out * whole(price_out)) * F.when(batch, int(2 * BATCH_SHARE)).otherwise(2)


def usd(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column, batch: Column) -> Column:
    full = (tokens_in * price_in + tokens_out * price_out) / 1e6
    return full * F.when(batch, BATCH_SHARE).otherwise(1.0)


def tokens_used(usage: Column) -> dict[str, Column]:
    """Input and output tokens from the usage JSON of four kinds of providers; reasoning tokens count as output."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(usage, p).cast("long") for p in paths])
    zero = F.lit(0).cast("long")
    return {
        "input_tokens": F.coalesce(get("$.input_tokens", "$.prompt_tokens", "$.promptTokenCount"), zero),
        "output_tokens": F.coalesce(get("$.output_tokens", "$.completion_tokens", "$.candidatesTokenCount"), zero) + F.coalesce(get("$.thoughtsTokenCount"), zero),
    }


def cache_split(requests: DataFrame, cache: DataFrame, key: str = "request_hash") -> tuple[DataFrame, DataFrame]:
    """Requests with and without a usable record; records with an error are misses."""
    good = cache.filter("error is null").select(key).distinct()
    return requests.join(good, key, "left_semi"), requests.join(good, key, "left_anti")


def merged_cache(cache: DataFrame, new: DataFrame, key: str = "request_hash") -> DataFrame:
    """The cache with new records: the first usable record of a key stays."""
    both = cache.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    row = F.struct(*[c for c in cache.columns if c != key])
    best = both.groupBy(key).agg(F.min_by(row, F.struct(F.col("error").isNotNull(), "__age", row)).alias("r"))
    return best.select(key, "r.*").select(*cache.columns)
