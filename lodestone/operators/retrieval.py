"""Guidance retrieval: tokens, BM25, vector search, tiers, ranking, guards, binding and grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.html import url_specificity
from lodestone.functions.rounding import py_round
from lodestone.operators.nearest import nearest

# Words that queries and documents leave out; BM25's parameters; floors and the band of relevance.
STOP = (
    "the a an and or of to in for on with is are be as at by from this that it its into "
    "over under about not no your you can should must if then when where which who what how"
).split()
K1, B, BM25_FLOOR = 1.5, 0.75, 2.0
VECTOR_FLOOR, BAND = 0.28, 0.10
DEAD = ["deprecated", "rejected", "retired", "superseded"]
# Organisations by band of authority.
TIERS = {
    1: ["Google", "Schema.org", "Bing", "W3C", "web.dev", "MDN", "Perplexity", "OpenAI", "Anthropic", "Microsoft", "Apple"],
    2: ["Backlinko", "Ahrefs", "Semrush", "Moz", "Princeton/arXiv", "Vercel", "BrightEdge"],
    3: ["Search Engine Land", "Search Engine Journal", "HubSpot"],
    4: ["Y Combinator", "Reforge", "a16z", "First Round Review", "For Entrepreneurs", "Demand Curve", "Animalz", "AppsFlyer", "ALM Corp",
        "Amsive", "CXL", "Frase", "Seer Interactive", "AppTweak", "Shopify", "Buffer", "B2B ContentOS"],
}


def tokens(text: Column) -> Column:
    """Lower-case letters and digits, three characters at least, without stop words; repeats stay."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(STOP))


def bm25(docs: DataFrame, queries: DataFrame, k: int, floor: float = BM25_FLOOR, broadcast_terms: int = 200_000) -> DataFrame:
    """``query_id, rank, doc_id, score``: each query's best documents by BM25, four decimals, ties to the smaller id.

    ``docs``: doc_id, text.  ``queries``: query_id, text.  Only postings of query terms are shuffled; the terms are
    broadcast after they were counted, and joined by shuffle beyond ``broadcast_terms``.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    terms = asked.select("term").distinct()
    small = terms.limit(broadcast_terms + 1).count() <= broadcast_terms
    bagged = docs.select("doc_id", tokens(F.col("text")).alias("bag")).withColumn("n", F.size("bag"))
    totals = bagged.agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).first()
    postings = bagged.select("doc_id", "n", F.explode("bag").alias("term")).join(F.broadcast(terms) if small else terms, "term", "left_semi")
    postings = postings.groupBy("term", "doc_id", "n").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (totals["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = 1 - B + B * F.col("n") / (totals["mean"] or 1.0)
    # A frequent term's postings would meet in one task; its count travels instead.
    weighted = postings.join(F.broadcast(df) if small else df, "term").withColumn("part", idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * length))
    scores = weighted.join(F.broadcast(asked) if small else asked, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 4).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    ranked = scores.filter(F.col("score") >= floor).withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null for other lengths, zero or null vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, floor: float = VECTOR_FLOOR) -> DataFrame:
    """``query_id, rank, vec_id, relevance``: each query's nearest other vectors by cosine from the floor on, exactly (``nearest``)."""
    return nearest(vectors, queries, k, floor)


def canonical_org(org: Column, names: dict[str, str] | None = None) -> Column:
    """An organisation's canonical name: its lower-cased name or domain looked up, without a leading www."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(org, F.lit("")))), r"^www\.", "")
    known = {n.lower(): n for band in TIERS.values() for n in band} | (names or {})
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.trim(F.coalesce(org, F.lit(""))))


def tier_of(org: Column, domains_count: bool = False) -> Column:
    """1 to 4 for known organisations, else 5; with ``domains_count`` an unknown dotted domain is 4."""
    tier = F.when(F.lit(False), 0)
    for band, names in TIERS.items():
        tier = tier.when(canonical_org(org).isin(names), band)
    return tier.when(F.lit(domains_count) & canonical_org(org).rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"), 4).otherwise(5)


def norm_gate(cites: DataFrame, least: int) -> DataFrame:
    """Citations of curated tiers up to ``least``, 4 at most."""
    return cites.filter(tier_of(F.col("source_org")) <= min(least, 4))


def trusted(corpus: DataFrame) -> DataFrame:
    """Rows that are neither dead nor superseded."""
    alive = ~F.coalesce(F.lower(F.trim("status")).isin(DEAD), F.lit(False))
    return corpus.filter(alive & (F.coalesce(F.trim("superseded_by"), F.lit("")) == ""))


def band_rank(cites: DataFrame, k: int, floor: float | Column = VECTOR_FLOOR) -> DataFrame:
    """Each query's citations: relevance band first, then tier, confidence, relevance, URL, provenance, kind, id.

    ``cites``: query_id, kind, id, relevance, tier, confidence, source_url, provenance.
    """
    proven = F.when(F.lower("provenance") == "extracted", 0).when(F.lower("provenance") == "neighbor-inferred", 2).otherwise(1)
    w = Window.partitionBy("query_id").orderBy(
        (-F.floor(F.col("relevance") / BAND)), "tier", -py_round(F.col("confidence"), 1), -py_round(F.col("relevance"), 4),
        url_specificity(F.col("source_url")), proven, "kind", F.col("id").cast("string"),
    )
    kept = cites.filter(F.col("relevance") >= floor).withColumn("rank", F.row_number().over(w))
    return kept.filter(F.col("rank") <= k)


def merge_citations(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Both lists of (query_id, kind, id, rank), the first one's before the second's, each citation once, k a query."""
    both = first.select("query_id", "kind", "id", "rank", F.lit(0).alias("src")).unionByName(second.select("query_id", "kind", "id", "rank", F.lit(1).alias("src")))
    once = both.groupBy("query_id", "kind", "id").agg(F.min(F.struct("src", "rank")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at.src", "at.rank", "kind", "id")
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "kind", "id")


def without_deprecated(cites: DataFrame, text: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """Citations whose text recommends nothing retired: a pattern counts unless its counter-pattern is there too."""
    stale = F.lit(False)
    for pattern, against in patterns:
        stale = stale | (F.col(text).rlike(f"(?i){pattern}") & ~F.col(text).rlike(f"(?i){against}"))
    return cites.filter(~F.coalesce(stale, F.lit(False)))


def supports(evidence: Column, row: Column, least: int = 3, share: float = 0.20) -> Column:
    """Whether two token sets share ``least`` tokens and ``share`` of the smaller one."""
    a, b = F.array_distinct(evidence), F.array_distinct(row)
    both = F.size(F.array_intersect(a, b))
    smaller = F.least(F.size(a), F.size(b))
    return (both >= least) & (both >= share * smaller)


def plausible(claimed: Column, source: Column) -> Column:
    """Two shared tokens or a third of the claimed ones; nothing claimed is plausible."""
    a = F.array_distinct(claimed)
    both = F.size(F.array_intersect(a, source))
    return (F.size(a) == 0) | (both >= 2) | (both >= 0.34 * F.size(a))


def bind_rules(findings: DataFrame, bindings: DataFrame, corpus: DataFrame, broadcast_rows: int = 10_000) -> DataFrame:
    """Each measured finding's first binding whose status fits and whose row is trusted and faithful to its source.

    ``bindings``: base, ord, kind, id, statuses.  ``corpus``: kind, id, source_excerpt, provenance_status and the trust columns.
    Bindings are broadcast after they were counted, and joined by shuffle beyond ``broadcast_rows``.
    """
    from lodestone.operators.scoring import base_of

    faithful = trusted(corpus).filter((F.col("provenance_status") == "verified") & (F.coalesce(F.trim("source_excerpt"), F.lit("")) != ""))
    small = bindings.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = findings.withColumn("base", base_of(F.col("check_id"))).join(F.broadcast(bindings) if small else bindings, "base")
    rows = rows.filter(F.array_contains("statuses", F.col("status"))).join(faithful.select("kind", "id"), ["kind", "id"])
    first = rows.groupBy("audit_id", "check_id").agg(F.min(F.struct(F.col("bind_ord"), "kind", "id")).alias("b"))
    return first.select("audit_id", "check_id", F.col("b.kind").alias("kind"), F.col("b.id").alias("id"))


def binding_reasons(claims: DataFrame, corpus: DataFrame, pool: DataFrame) -> DataFrame:
    """Why a claimed binding (audit_id, check_id, kind, id, evidence) holds or not, in order of the tests."""
    known = corpus.select("kind", "id", F.concat_ws(" ", "title", "text1").alias("row_text"), F.col("provenance_status").alias("proof"))
    rows = claims.join(known, ["kind", "id"], "left").join(pool.select("check_id", "kind", "id", F.lit(True).alias("pooled")), ["check_id", "kind", "id"], "left")
    reason = (
        F.when(F.col("row_text").isNull(), "missing")
        .when(F.coalesce(F.col("proof") != "verified", F.lit(True)), "unfaithful")
        .when(F.col("pooled").isNull(), "not_candidate")
        .when(~supports(tokens(F.col("evidence")), tokens(F.col("row_text"))), "unsupported")
        .otherwise("verified")
    )
    return rows.select("audit_id", "check_id", "kind", "id", reason.alias("reason"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("gold", "judged").agg(F.count("*").alias("n"))


def entailment_metrics(pairs: DataFrame) -> DataFrame:
    """Strict precision and missed support of judged pairs (gold, judged booleans), in percent."""
    both = F.count_if(F.col("gold") & F.col("judged"))
    return pairs.agg(
        F.count("*").alias("n"),
        py_round(both * 100.0 / F.nullif(F.count_if("judged"), F.lit(0)), 1).alias("strict_precision"),
        py_round((F.count_if("gold") - both) * 100.0 / F.nullif(F.count_if("gold"), F.lit(0)), 1).alias("missed_support"),
    )


def sample_by_hash(rows: DataFrame, key: str, salt: Column, n: int, group: str) -> DataFrame:
    """``n`` rows of each group, lowest MD5 of salt and key first: the same rows on every run."""
    w = Window.partitionBy(group).orderBy(F.md5(F.concat_ws("|", salt, F.col(key).cast("string"))), key)
    return rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)
