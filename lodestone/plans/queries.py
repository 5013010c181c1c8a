"""Queries over the provided tables, one for each operator or family of operators.

Pages stand in for audits: a page's host is its domain and its id the order of audits.  Events stand in for answer runs,
link checks and calls, documents for the guidance corpus, ``benchmark`` for retrieval queries.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import html as H
from lodestone.functions.rounding import py_round
from lodestone.operators import checks, clusters, crawl, retrieval, scoring, store, visibility
from lodestone.plans import enriched
from lodestone.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: The moment that dates are compared with.
AS_OF = "2026-06-20 12:00:00"


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Crawled pages with what they lack, and their responses."""
    rows = read(spark, folder, "pages").selectExpr(*enriched.select("locate('://', url)"))
    headers = F.map_filter(F.create_map(*[x for name, c in enriched.HEADERS.items() for x in (F.lit(name), F.col(c))]), lambda _, v: v.isNotNull())
    return rows.withColumn("headers", headers)


def features(spark: SparkSession, folder: str) -> DataFrame:
    return checks.page_features(pages(spark, folder), F.lit(AS_OF).cast("timestamp"))


def findings(spark: SparkSession, folder: str, found: DataFrame | None = None) -> DataFrame:
    method = {"observed_method": lambda check_id: scoring.observed_method(check_id, F.lit(False))}
    return checks.page_checks(features(spark, folder) if found is None else found, more=method).withColumnRenamed("page_id", "audit_id")


def geo_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Statuses of the eight I checks, derived from the page id."""
    status = F.element_at(F.array(*map(F.lit, ["pass", "warn", "fail", "na", "pass"])), (F.pmod(F.col("page_id") * 7 + F.col("k") * 3, F.lit(5)) + 1).cast("int"))
    rows = read(spark, folder, "pages").select("page_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k"))
    return rows.select(F.col("page_id").alias("audit_id"), F.col("k").alias("ord"), F.concat(F.lit("I"), "k").alias("check_id"), status.alias("status"))


def audits(spark: SparkSession, folder: str) -> DataFrame:
    """``audit_id, domain, created, score, grade``."""
    hosts = read(spark, folder, "pages").select(F.col("page_id").alias("audit_id"), H.host_of(F.col("url")).alias("domain"))
    scores = scoring.audit_scores(findings(spark, folder)).select("audit_id", F.col("pcr").alias("score"), "grade")
    return hosts.join(scores, "audit_id").withColumn("created", F.col("audit_id"))


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the cluster's checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp()
    return f"{base.rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def once(rows: DataFrame) -> DataFrame:
    """``rows`` written and read again, for what is used more than once."""
    at = shared_folder(rows.sparkSession, "tables")
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


@query
def page_features(spark, folder):
    return features(spark, folder).select(
        "page_id", "host", "is_https", "title", "n_title", "n_h1", "first_h1", "lang", "words", "n_links", "n_internal", "n_chrome_links",
        "n_generic", "n_li", "n_article", "has_byline", F.md5("text").alias("text_md5"),
    )


@query
def page_checks_long(spark, folder):
    return checks.page_checks(features(spark, folder)).select("page_id", "ord", "check_id", "section", "status", "severity")


@query
def section_status_counts(spark, folder):
    return scoring.section_counts(findings(spark, folder))


@query
def section_scores(spark, folder):
    scores = scoring.audit_scores(findings(spark, folder))
    return scores.select("audit_id", F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.col(f"score_{s}").alias("score")) for s in scoring.SECTIONS])))


@query
def audit_scorecard(spark, folder):
    """One row a page: host, score, grade, counts, brand and combined scores."""
    scores = scoring.audit_scores(findings(spark, folder)).join(scoring.brand_presence(geo_findings(spark, folder)), "audit_id", "left")
    hosts = read(spark, folder, "pages").select(F.col("page_id").alias("audit_id"), H.host_of(F.col("url")).alias("host"))
    return hosts.join(scores, "audit_id").select(
        "audit_id", "host", "pcr", "grade", "n_fail", "n_warn", "bap", "bap_confidence", scoring.combined(F.col("pcr"), F.col("bap")).alias("combined")
    )


@query
def shadow_scores(spark, folder):
    return scoring.audit_scores(findings(spark, folder)).select(
        "audit_id", "pcr", "shadow", "shadow_grade", "shadow_delta", "findings_total", "findings_backed"
    )


@query
def bap_scores(spark, folder):
    return scoring.brand_presence(geo_findings(spark, folder))


@query
def cite_readiness(spark, folder):
    f = once(features(spark, folder))
    rows = findings(spark, folder, f).withColumn("check_id", F.when(F.col("check_id") == "D1_structured_data", "D9_x").when(F.col("check_id") == "F6b_question_headings", "F6_x").otherwise(F.col("check_id")))
    gates = f.select(
        F.col("page_id").alias("audit_id"),
        F.when(F.col("page_id") % 5 != 0, F.col("page_id") % 7 != 0).alias("ai_bot_allowed"),
        (F.col("words") >= 300).alias("server_rendered"), F.lit(True).alias("reachable_200"), F.col("is_https").alias("https"),
        F.when(F.col("page_id") % 3 == 0, "service").otherwise("article").alias("page_type"), F.lit("high").alias("confidence"),
        (F.col("page_id") % 11 == 0).alias("unreached"),
    )
    done = scoring.cite_readiness(rows, gates)
    return done.select("audit_id", "cite_score", F.array_join("failed_gates", ",").alias("failed_gates"), "business_type", "own_site_weight")


@query
def legacy_composites(spark, folder):
    return scoring.legacy_composites(scoring.audit_scores(findings(spark, folder)))


@query
def latest_audit_per_domain(spark, folder):
    return store.latest_per_domain(audits(spark, folder)).select("domain", "audit_id", "score", "grade")


@query
def audit_history(spark, folder):
    return store.history(audits(spark, folder), 5).select("domain", "age", "audit_id", "score", "score_before")


@query
def audit_delta(spark, folder):
    hosts = read(spark, folder, "pages").select(F.col("page_id").alias("audit_id"), H.host_of(F.col("url")).alias("domain"), F.col("page_id").alias("created"))
    pairs = store.with_prior(hosts).filter("prior_id IS NOT NULL").select("audit_id", "prior_id")
    return store.delta_summary(store.delta(pairs, once(findings(spark, folder).select("audit_id", "ord", "check_id", "status"))))


@query
def top_issues(spark, folder):
    return scoring.top_issues(findings(spark, folder), 5)


@query
def severity_histogram(spark, folder):
    return scoring.severity_histogram(findings(spark, folder))


@query
def check_summary(spark, folder):
    rows = findings(spark, folder).groupBy("check_id").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pass", "warn", "fail", "na")])
    return rows.withColumn("tier", scoring.evidence_tier(F.col("check_id")))


@query
def anchor_text_generic(spark, folder):
    rows = pages(spark, folder).select(F.explode(H.anchor_texts(F.col("html"))).alias("anchor"))
    return rows.filter(F.col("anchor").isin(H.GENERIC_ANCHORS)).groupBy("anchor").agg(F.count("*").alias("n"))


@query
def same_title_groups(spark, folder):
    rows = features(spark, folder).filter("title <> ''").groupBy("title").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))
    return rows.filter("n > 1")


@query
def near_equal_pages(spark, folder):
    rows = read(spark, folder, "pages").select("page_id", F.md5(H.equality_key(F.col("html"))).alias("key"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query
def host_median_depth(spark, folder):
    """Each host's deepest page beside the median of all other hosts' deepest; hosts without words are no others."""
    rows = features(spark, folder).filter("host <> ''").groupBy("host").agg(F.max("words").alias("words"))
    return scoring.median_of_others(rows, "words").select("host", "words", "median_words", "hosts")


@query
def cross_variant_divergence(spark, folder):
    """Pages of a host as variants of its first page: cloaking by visible words."""
    f = features(spark, folder).select("page_id", "host", "words")
    first = Window.partitionBy("host").orderBy("page_id")
    rows = f.withColumn("nth", F.row_number().over(first))
    probes = rows.select(
        F.col("host").alias("page_id"), F.when(F.col("nth") == 1, "default").otherwise(F.concat(F.lit("v"), "page_id")).alias("ua"),
        F.when((F.col("nth") > 1) & (F.col("page_id") % 9 == 0), 403).otherwise(200).alias("http_code"), "words", F.lit("u").alias("final_url"),
    )
    return crawl.cross_agent(probes).select(F.col("page_id").alias("host"), "ua", "cloaked", "blocked", "diverged")


@query
def rendering_classes(spark, folder):
    f = features(spark, folder)
    code = F.when(F.col("page_id") % 13 == 0, 403).when(F.col("page_id") % 17 == 0, 0).when(F.col("page_id") % 19 == 0, 301).otherwise(200)
    return f.select("page_id", crawl.rendering_class(code, F.col("page_id") % 23 == 0, F.col("words"), F.array().cast("array<string>")).alias("class"))


@query
def deterministic_sample(spark, folder):
    rows = features(spark, folder).select("page_id", "host", "url")
    return retrieval.sample_by_hash(rows, "url", F.col("host"), 3, "host").select("host", "nth", "page_id")


@query
def bm25_topk(spark, folder):
    queries = read(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(read(spark, folder, "documents"), queries, 5)


@query
def vector_topk(spark, folder):
    vectors = read(spark, folder, "embeddings").select("vec_id", "embedding")
    queries = vectors.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.vector_topk(vectors, queries, 8)


@query
def band_ranked_topk(spark, folder):
    vectors = read(spark, folder, "embeddings").select("vec_id", "embedding")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = retrieval.vector_topk(vectors, queries, 20, 0.0)
    kind = F.element_at(F.array(*map(F.lit, ["rule", "ap", "principle", "playbook"])), (F.col("vec_id") % 4 + 1).cast("int"))
    cites = near.select(
        "query_id", kind.alias("kind"), F.col("vec_id").alias("id"), "relevance", (F.col("vec_id") % 5 + 1).alias("tier"),
        ((F.col("vec_id") % 10) / 10.0).alias("confidence"),
        F.when(F.col("vec_id") % 3 == 0, "https://x.example/a/b").when(F.col("vec_id") % 3 == 1, "https://x.example").otherwise("").alias("source_url"),
        F.when(F.col("vec_id") % 2 == 0, "extracted").otherwise("none").alias("provenance"),
    )
    return retrieval.band_rank(cites, 5, 0.1).select("query_id", "rank", "kind", "id", "relevance")


@query
def org_tiering(spark, folder):
    orgs = ["google", "www.moz.com", "Semrush", "example.org", "HubSpot", "a16z", "somebody"]
    name = F.element_at(F.array(*map(F.lit, orgs)), (F.col("doc_id") % len(orgs) + 1).cast("int"))
    rows = read(spark, folder, "documents").select("doc_id", name.alias("org"))
    rows = rows.select("doc_id", "org", retrieval.tier_of(F.col("org")).alias("tier"), retrieval.tier_of(F.col("org"), True).alias("live_tier"))
    return rows.groupBy("org", "tier", "live_tier").agg(F.count("*").alias("n"))


@query
def deprecation_guard(spark, folder):
    patterns = [("disgusting|pathetic", "worthless"), ("mit license", "no longer")]
    return retrieval.without_deprecated(read(spark, folder, "documents"), "text", patterns).groupBy("lang").agg(F.count("*").alias("n"))


@query
def lexical_support(spark, folder):
    """Each retrieved document: whether its tokens support the query's."""
    docs, items = read(spark, folder, "documents"), read(spark, folder, "benchmark")
    hits = retrieval.bm25(docs, items.select(F.col("item_id").alias("query_id"), "text"), 3)
    rows = hits.join(docs.select("doc_id", F.col("text").alias("doc_text")), "doc_id").join(items.select(F.col("item_id").alias("query_id"), "text"), "query_id")
    return rows.select("query_id", "doc_id", retrieval.supports(retrieval.tokens(F.col("text")), retrieval.tokens(F.col("doc_text"))).alias("supported"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as guidance rows: the name is the whole text."""
    return read(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("block"), F.col("text").alias("name"), F.col("source").alias("source_org"),
        F.when(F.col("doc_id") % 3 == 0, "https://x.example/a/b").alias("source_url"), F.when(F.col("doc_id") % 2 == 0, "extracted").alias("provenance"),
        F.format_string("2026-%02d-01", F.col("doc_id") % 12 + 1).alias("last_verified"), ((F.col("doc_id") % 10) / 10.0).alias("confidence"),
        F.when(F.col("doc_id") % 7 == 0, "retired").otherwise("active").alias("status"), F.lit(None).cast("string").alias("superseded_by"),
    )


@query
def jaccard_pairs(spark, folder):
    """Representatives of equal names, and names alike, by language."""
    return clusters.candidate_pairs(corpus(spark, folder))


def elected(spark: SparkSession, folder: str) -> DataFrame:
    rows = retrieval.trusted(corpus(spark, folder))
    roots = clusters.components(clusters.candidate_pairs(rows, forest=True))
    # Texts have done their work once the pairs are known.
    return clusters.elect(rows.drop("name").join(roots, "id"))


@query
def dup_clusters(spark, folder):
    return clusters.components(clusters.candidate_pairs(corpus(spark, folder), forest=True))


@query
def canonical_election(spark, folder):
    return elected(spark, folder).select("root", "nth", "id", "canonical")


@query
def demotion_plan_faults(spark, folder):
    return clusters.plan_faults(elected(spark, folder), corpus(spark, folder))


@query
def demoted_corpus(spark, folder):
    rows = corpus(spark, folder)
    return clusters.apply_plan(rows, elected(spark, folder)).groupBy("status").agg(F.count("*").alias("n"))


@query
def entailment_metrics(spark, folder):
    pairs = read(spark, folder, "labels").select((F.col("quality") == 1).alias("gold"), (F.pmod("doc_id", F.lit(4)) != 0).alias("judged"))
    return retrieval.entailment_metrics(pairs)


@query
def confusion_matrix(spark, folder):
    pairs = read(spark, folder, "labels").select(F.col("quality").alias("gold"), (F.pmod("doc_id", F.lit(4)) != 0).cast("int").alias("judged"))
    return retrieval.confusion(pairs)


@query
def inclusion_rates(spark, folder):
    rows = read(spark, folder, "events").select(F.col("event_type").alias("engine"), (F.col("user_id") % 3 == 0).alias("cited"), (F.col("value") > 50).alias("mentioned"))
    return visibility.inclusion_rates(rows)


@query
def share_of_voice(spark, folder):
    rows = read(spark, folder, "events").select((F.col("user_id") * 31 + F.dayofyear("ts")).alias("run_id"), F.concat(F.lit("d"), (F.col("event_id") % 37).cast("string")).alias("domain"))
    return visibility.share_of_voice(rows)


@query
def top_cited(spark, folder):
    rows = read(spark, folder, "events").select(F.col("event_type").alias("engine"), F.concat(F.lit("d"), (F.col("event_id") % 37).cast("string")).alias("domain"))
    return visibility.top_per_group(rows, "engine", "domain", 10)


@query
def sweep_cost(spark, folder):
    rows = read(spark, folder, "events").select(
        F.when(F.col("user_id") % 2 == 0, "anthropic").otherwise("openai").alias("engine"), (F.col("event_id") % 1000).alias("input_tokens"),
        (F.col("event_id") % 300).alias("output_tokens"), (F.col("event_id") % 3).alias("searches"),
    )
    return visibility.sweep_cost(rows)


@query
def answer_mentions(spark, folder):
    rows = read(spark, folder, "conversations").filter("role = 'assistant'")
    named = visibility.mentions(F.col("text"), F.lit("thin.example"), F.lit("The Ereti"))
    return rows.groupBy((F.col("turn") % 4).alias("slot")).agg(F.count("*").alias("n"), F.count_if(named).alias("mentioned"))


@query
def usage_quota(spark, folder):
    rows = read(spark, folder, "events").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("key"), "ts")
    done = store.running_usage(rows, 20)
    return done.groupBy("key", "month").agg(F.max("nth").alias("calls"), F.count_if(~F.col("allowed")).alias("refused"))


@query
def link_last_two_broken(spark, folder):
    verdict = store.link_verdict(F.element_at(F.array(*map(F.lit, [200, 404, 403, 500, 301])), (F.col("event_id") % 5 + 1).cast("int")), F.lit(None).cast("string"))
    rows = read(spark, folder, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("ts").alias("checked_at"), F.col("event_id").alias("check_id"), verdict.alias("verdict"))
    return store.last_two_broken(rows)


@query
def concurrent_jobs(spark, folder):
    rows = read(spark, folder, "events").select(
        F.col("event_id").alias("job_id"), F.col("event_type").alias("profile"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("started")
    )
    rows = rows.withColumn("ended", F.col("started") + F.col("job_id") % 7200 + 60)
    return store.running_jobs(rows).groupBy("profile").agg(F.max("running").alias("most"), F.sum("running").alias("total"))


@query
def recurring_patterns(spark, folder):
    rows = read(spark, folder, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"), F.count("*").alias("n"))
    return rows.filter((F.size("kinds") >= 3) & (F.col("n") >= 3)).select("user_id", "n", F.array_join(F.array_sort("kinds"), ",").alias("kinds"))


@query
def trend_summary(spark, folder):
    as_of = F.lit("1998-08-02").cast("date")
    rows = read(spark, folder, "orders").filter(F.col("o_orderdate").cast("date").between(F.date_sub(as_of, 30), as_of))
    return rows.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), py_round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")) / F.count("*"), 2).alias("mean_price"),
        py_round(F.count_if(F.col("o_orderstatus") == "F") * 100.0 / F.count("*"), 1).alias("finished_pct"),
    )


@query
def unmapped_rules(spark, folder):
    """Parts that no line item names, by brand: an anti join."""
    parts = read(spark, folder, "part").join(read(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey", "left_anti")
    return parts.groupBy("p_brand").agg(F.count("*").alias("n"))


@query
def corpus_overview(spark, folder):
    return visibility.corpus_overview(corpus(spark, folder), "block")


@query
def org_segments(spark, folder):
    rows = corpus(spark, folder).groupBy("source_org").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    return rows.select("source_org", "n", F.round("c", 4).alias("mean_confidence"), F.datediff(F.lit("2026-12-31"), F.lit("2026-12-01")).alias("stale_days"))


@query
def paged_browse(spark, folder):
    rows = corpus(spark, folder).filter("status = 'active'").select("id", "block", "confidence")
    return visibility.page_of(rows, F.col("confidence"), "id", 1)


@query
def url_union(spark, folder):
    pages = read(spark, folder, "pages").select(H.url_key(F.col("url")).alias("url"))
    more = read(spark, folder, "pages").select(F.concat(F.lit("https://"), H.bare_domain(F.col("url"))).alias("url"))
    return pages.unionByName(more).distinct()


@query
def upserted_audits(spark, folder):
    pages = read(spark, folder, "pages").select("page_id", H.host_of(F.col("url")).alias("domain"))
    new = pages.withColumn("mode", F.when(F.col("page_id") % 3 == 0, "new").otherwise("old"))
    return store.upsert(pages.withColumn("mode", F.lit("old")), new, "page_id", "domain").groupBy("mode").agg(F.count("*").alias("n"))


@query
def robots_access(spark, folder):
    """Access of all bots to every page's path under robots files made from the host's name."""
    pages = read(spark, folder, "pages").select(H.host_of(F.col("url")).alias("host"), F.regexp_extract("url", r"://[^/?#]*([^#]*)", 1).alias("path"))
    body = F.when(F.col("host").contains("blog"), F.lit("User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /en/\nAllow: /en/1*\n\nUser-agent: *\nDisallow: /de/*5$\nDisallow:\n"))
    body = body.when(F.col("host").startswith("m."), F.lit("User-agent: *\nDisallow: /\nAllow: /fr/\n\nUser-agent: google\nDisallow:"))
    files = pages.select("host").distinct().withColumn("body", body.otherwise(F.lit("# nothing\n")))
    access = crawl.robots_access(crawl.robots_rules(files), pages)
    return access.groupBy("host", "bot").agg(F.count("*").alias("n"), F.count_if(F.col("allowed")).alias("allowed"), F.count_if(~F.col("allowed")).alias("denied"))


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = read(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def _drained(rows: DataFrame, name: str) -> DataFrame:
    """What a stream has written once its source is used up: each batch's whole result replaces the last one's files."""
    spark = rows.sparkSession
    at = shared_folder(spark, f"streams/{name}")
    # A source without files makes no batch.
    spark.createDataFrame([], rows.schema).write.parquet(f"{at}/out")
    started = rows.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out"))
    started = started.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


@query
def stream_tumbling(spark, folder):
    return _drained(jobs.tumbling_counts(_stream(spark, folder)), "tumbling")


@query
def stream_monthly_usage(spark, folder):
    return _drained(jobs.monthly_usage(_stream(spark, folder)), "usage")


@query
def stream_sessions(spark, folder):
    return _drained(jobs.sessions(_stream(spark, folder)), "sessions")


@query
def light_checks_long(spark, folder):
    """The checks of the light profile."""
    return checks.page_checks(features(spark, folder), checks.LIGHT).select("page_id", "check_id", "status")


@query
def page_signals(spark, folder):
    """What the checks look at, page by page: directives, canonical links, questions, structured data."""
    return features(spark, folder).select(
        "page_id", F.array_join("directives", ";").alias("directives"), "canonical", "canonical_self", "n_nested_h1", "n_skipped", "n_faq_visible", "faq_method", "n_faq_schema",
        "n_faq_matched", "n_entities", "n_without_id", "n_people", "n_credentialed", F.array_join("authors", ";").alias("authors"), "n_local", "n_local_geo", "city_key",
        "city_in_title", "n_locales", "n_schema_prices", "n_fresh", "n_stale", "n_profiles", "n_disguised", "has_about", "has_contact", "has_policy", "n_schema_authors",
    )
