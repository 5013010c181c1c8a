"""Answer-engine visibility: citations and mentions in logged answers, and the corpus console's aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.html import bare_domain
from lodestone.functions.rounding import py_round

# List prices in USD per million tokens (in, out) and per search, by engine.
PRICES = {"anthropic": (3.0, 15.0, 0.01), "openai": (0.15, 0.60, 0.01)}


def cites_domain(urls: Column, domain: Column) -> Column:
    """Whether any cited URL is of the domain or a subdomain."""
    return F.exists(urls, lambda u: (bare_domain(u) == domain) | bare_domain(u).endswith(F.concat(F.lit("."), domain)))


def mentions(answer: Column, domain: Column, brand: Column) -> Column:
    """Whether an answer names the domain, its root or any token of the brand (three characters at least)."""
    text = F.lower(F.coalesce(answer, F.lit("")))
    root = F.regexp_extract(domain, r"^([^.]*)", 1)
    words = F.filter(F.split(F.lower(F.coalesce(brand, F.lit(""))), r"[^a-z0-9]+"), lambda t: F.length(t) >= 3)
    named = F.exists(words, lambda t: text.contains(t))
    return text.contains(domain) | ((F.length(root) >= 3) & text.contains(root)) | named


def inclusion_rates(runs: DataFrame) -> DataFrame:
    """For each engine (engine, cited, mentioned): runs and the shares that cite and mention the target, in percent."""
    n = F.count("*")
    return runs.groupBy("engine").agg(
        n.alias("runs"), py_round(F.count_if("cited") * 100.0 / n, 1).alias("cited_pct"), py_round(F.count_if("mentioned") * 100.0 / n, 1).alias("mentioned_pct")
    )


def share_of_voice(cited: DataFrame) -> DataFrame:
    """``domain, n_runs, share``: runs (run_id, domain) that cite a domain, each once, and its share of all, in percent."""
    once = cited.filter("domain IS NOT NULL AND domain <> ''").select("run_id", "domain").distinct()
    total = once.agg(F.count("*").alias("total"))
    per = once.groupBy("domain").agg(F.count("*").alias("n_runs"))
    return per.join(F.broadcast(total)).select("domain", "n_runs", py_round(F.col("n_runs") * 100.0 / F.col("total"), 2).alias("share"))


def top_per_group(rows: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """Each group's most frequent items, ties by item."""
    n = rows.groupBy(group, item).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), item)
    return n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def sweep_cost(usage: DataFrame) -> DataFrame:
    """Cost of runs (engine, input_tokens, output_tokens, searches) by engine, four decimals."""
    price = lambda k: F.coalesce(*[F.when(F.col("engine") == e, p[k]) for e, p in PRICES.items()], F.lit(0.0))
    sums = usage.groupBy("engine").agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "searches")])
    cost = F.col("input_tokens") / 1e6 * price(0) + F.col("output_tokens") / 1e6 * price(1) + F.col("searches") * price(2)
    return sums.withColumn("cost_usd", py_round(cost, 4))


def corpus_overview(corpus: DataFrame, group: str) -> DataFrame:
    """Rows, citeable rows and the newest date of each group of the corpus (status, last_verified)."""
    return corpus.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("n_active"), F.max("last_verified").alias("newest")
    )


def page_of(rows: DataFrame, order: Column, key: str, number: int, size: int = 25) -> DataFrame:
    """One page of rows in order, nulls last, ties by key."""
    return rows.orderBy(order.desc_nulls_last(), key).offset(number * size).limit(size)
