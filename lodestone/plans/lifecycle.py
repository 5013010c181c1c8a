"""Queries of redirect chains, guarded plans and job streams, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import clusters, demotions, redirects, retrieval
from lodestone.plans.oracle import CORPUS, ELECTED, ORACLE, pairs
from lodestone.plans.queries import _stream, corpus, elected, query, read, shared_folder
from lodestone.streaming import lifecycle as job_streams

# Pages in runs of twelve: the first of a run redirect to the next page, one to ten times; some runs end in a loop of one to three.
_NEXT = """CASE WHEN pos < 10 - run % 10 THEN p + 1 WHEN run % 5 = 4 AND pos = 11 THEN p - run % 3
  WHEN run % 5 = 4 AND pos >= 11 - run % 3 THEN p + 1 END"""
_STATUS = "CASE WHEN nxt IS NOT NULL THEN 301 + p % 2 WHEN p % 17 = 3 THEN 404 ELSE 200 END"
_LINK = "CASE p % 6 WHEN 0 THEN url WHEN 1 THEN '' WHEN 3 THEN after_url WHEN 4 THEN start_url WHEN 5 THEN '/other' END"


def _crawled(spark: SparkSession, folder: str) -> DataFrame:
    """``p, url, status, location, link`` of each page."""
    rows = read(spark, folder, "pages").selectExpr("page_id AS p", "url", "page_id % 12 AS pos", "page_id div 12 AS run").selectExpr("*", f"{_NEXT} AS nxt")
    url_of = lambda p, name: rows.select(F.col("p").alias(p), F.col("url").alias(name))
    rows = rows.withColumns({"after": F.col("p") + 1, "start": F.col("p") - F.col("pos")})
    rows = rows.join(url_of("nxt", "location"), "nxt", "left").join(url_of("after", "after_url"), "after", "left").join(url_of("start", "start_url"), "start", "left")
    return rows.selectExpr("p", "url", f"CAST({_STATUS} AS INT) AS status", "location", f"{_LINK} AS link")


@query
def redirect_chains(spark, folder):
    """Every crawled URL's redirects to their end."""
    return redirects.redirect_ends(_crawled(spark, folder))


@query
def canonical_chains(spark, folder):
    """Every page's canonical link, followed to its end."""
    rows = _crawled(spark, folder)
    return redirects.canonical_chains(rows.selectExpr("p AS page_id", "url AS served", "link AS canonical"), rows)


def _key(url: str) -> str:
    plain = f"regexp_replace({url}, '#.*$', '')"
    origin = f"regexp_extract({plain}, '^[^/?#]*//[^/?#]*')"
    return f"(lower({origin}) || substr({plain}, length({origin}) + 1))"


_CHAINS = f"""WITH RECURSIVE base AS (
  SELECT page_id AS p, url, page_id % 12 AS pos, page_id // 12 AS run FROM pages),
sent AS (SELECT *, {_NEXT} AS nxt FROM base),
crawled AS (
  SELECT s.p, s.url, {_STATUS.replace('p %', 's.p %')} AS status, coalesce(n.url, '') AS location, a.url AS after_url, b.url AS start_url
  FROM sent s LEFT JOIN base n ON n.p = s.nxt LEFT JOIN base a ON a.p = s.p + 1 LEFT JOIN base b ON b.p = s.p - s.pos),
answers AS (
  SELECT {_key('url')} AS url, status, location FROM crawled
  QUALIFY row_number() OVER (PARTITION BY {_key('url')} ORDER BY status, location) = 1),
hops AS (
  SELECT url, status, CASE WHEN status IN (301, 302, 303, 307, 308) AND location <> '' THEN {_key('location')} END AS target FROM answers),
walk(url, place, n) AS (
  SELECT url, url, 0 FROM hops
  UNION ALL
  SELECT w.url, h.target, w.n + 1 FROM walk w JOIN hops h ON h.url = w.place WHERE h.target IS NOT NULL AND w.n < 60),
last AS (SELECT url, max(n) AS n, arg_max(place, n) AS place FROM walk GROUP BY url),
ends AS (
  SELECT h.url, CAST(h.status AS INT) AS status, CAST(CASE WHEN l.n < 60 THEN l.n END AS BIGINT) AS hops, CASE WHEN l.n < 60 THEN l.place END AS final_url,
         CAST(CASE WHEN l.n < 60 THEN f.status END AS INT) AS final_status, l.n >= 60 AS loop
  FROM hops h JOIN last l ON l.url = h.url LEFT JOIN hops f ON f.url = l.place)"""
ORACLE["redirect_chains"] = _CHAINS + " SELECT * FROM ends"
ORACLE["canonical_chains"] = _CHAINS + f""",
linked AS (SELECT p, url, {_LINK} AS link FROM crawled),
asked AS (
  SELECT p, link, {_key('url')} AS here,
         CASE WHEN starts_with(link, '/') THEN lower(regexp_extract(url, '^[^/?#]*//[^/?#]*')) || link WHEN link <> '' THEN {_key('link')} END AS target
  FROM linked)
SELECT p AS page_id,
       CASE WHEN target = here THEN 'pass' WHEN e.status IN (301, 302, 303, 307, 308) THEN 'fail' ELSE 'warn' END AS status,
       e.status AS canonical_status, e.hops, e.final_url, e.final_status,
       coalesce(e.status IN (301, 302, 303, 307, 308) AND e.final_url = here, false) AS back, coalesce(e.loop, false) AS loop
FROM asked LEFT JOIN ends e ON e.url = target AND target <> here"""


def _keyed_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).withColumn("rule_key", F.expr("CASE WHEN id % 10 = 0 THEN concat(' k', id % 370, ' ') WHEN id % 10 = 1 THEN '' END"))


@query
def cluster_methods(spark, folder):
    """Clusters of guidance rows by rule key, or by name where vectors don't speak against it."""
    vectors = read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return demotions.clustered(_keyed_corpus(spark, folder), vectors)


ORACLE["cluster_methods"] = "WITH RECURSIVE " + pairs(" WHERE id % 10 <> 0") + """,
wide AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
kept AS (
  SELECT p.a, p.b, 'name_similarity' AS method FROM pairs p LEFT JOIN wide x ON x.id = p.a LEFT JOIN wide y ON y.id = p.b
  WHERE x.v IS NULL OR y.v IS NULL OR list_cosine_similarity(x.v, y.v) IS NULL OR list_cosine_similarity(x.v, y.v) >= 0.92),
keyed AS (SELECT id, block, id % 370 AS k FROM corpus WHERE id % 10 = 0),
edges AS (
  SELECT * FROM kept
  UNION ALL
  SELECT min(id) OVER (PARTITION BY block, k) AS a, id AS b, 'rule_key' AS method FROM keyed QUALIFY a < b),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(id, seen) AS (SELECT a, a FROM both_ways UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON r.seen = e.a),
methods AS (SELECT id, max(method) AS method FROM (SELECT a AS id, method FROM edges UNION ALL SELECT b, method FROM edges) GROUP BY id)
SELECT r.id, min(r.seen) AS root, m.method FROM reach r JOIN methods m USING (id) GROUP BY r.id, m.method"""


@query
def guarded_demotions(spark, folder):
    """A plan applied over snapshots while others edit the corpus, and undone: what became of each of its rows.

    Every fifth row is edited between plan and apply, every ninth demoted one between apply and reversal.  Texts, which no
    version changes, stay in their table.
    """
    table = demotions.Snapshots(spark, shared_folder(spark, "snapshots"))
    table.commit(corpus(spark, folder).drop("name").withColumn("version", F.lit(0).cast("long")), -1)
    chosen = clusters.elect(retrieval.trusted(table.read()).join(elected(spark, folder).select("id", "root"), "id"))
    plan = demotions.demotions(chosen, table.read()).checkpoint()
    edit = F.col("id") % 5 == 0
    table.commit(table.read().withColumns({"status": F.when(edit, "reviewed").otherwise(F.col("status")), "version": F.col("version") + edit.cast("long")}), 0)
    after, told = demotions.apply_guarded(table.read(), plan)
    told = told.checkpoint()
    table.commit(after, 1)
    edit = (F.col("id") % 9 == 0) & (F.col("status") == "superseded")
    table.commit(table.read().withColumns({"status": F.when(edit, "retired").otherwise(F.col("status")), "superseded_by": F.when(~edit, F.col("superseded_by"))}), 2)
    table.commit(demotions.revert_guarded(table.read(), plan), 3)
    then = lambda v, name: table.read(v).select("id", F.col("status").alias(name), F.col("superseded_by").alias(f"{name}_by"))
    rows = plan.select("id", "head").join(told, "id").join(then(2, "applied"), "id").join(then(4, "reverted"), "id")
    return rows.select("id", "head", "outcome", "applied", "applied_by", "reverted", "reverted_by")


ORACLE["guarded_demotions"] = f"WITH {ELECTED}" + """,
heads AS (SELECT root, id AS head FROM elected WHERE nth = 1),
plan AS (SELECT e.id, h.head, e.id % 5 = 0 AS edited FROM elected e JOIN heads h USING (root) WHERE e.nth > 1)
SELECT id, head, CASE WHEN edited THEN 'drifted' ELSE 'applied' END AS outcome, CASE WHEN edited THEN 'reviewed' ELSE 'superseded' END AS applied,
       CASE WHEN NOT edited THEN CAST(head AS VARCHAR) END AS applied_by,
       CASE WHEN edited THEN 'reviewed' WHEN id % 9 = 0 THEN 'retired' ELSE 'active' END AS reverted, CAST(NULL AS VARCHAR) AS reverted_by
FROM plan"""


_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def _appended(rows: DataFrame, name: str) -> DataFrame:
    """What a stream has appended to its files once its source is used up and its last watermark has passed."""
    spark = rows.sparkSession
    at = shared_folder(spark, f"streams/{name}")
    spark.createDataFrame([], rows.schema).write.parquet(f"{at}/out")
    before = spark.conf.get(_STATE_STORE)
    # State of typed columns and timers needs this store.
    spark.conf.set(_STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        started = rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append")
        started.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STATE_STORE, before)
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


# Every third event starts a job; its later events follow from its id, some are missing, some come too late, some twice.
_JOB = """inline(array(
  named_struct('job_id', concat('j', event_id), 'ts', CAST(ts AS TIMESTAMP), 'status', 'queued'),
  named_struct('job_id', concat('j', event_id), 'ts', CAST(ts AS TIMESTAMP) + INTERVAL 5 SECONDS, 'status', 'running'),
  named_struct('job_id', concat('j', event_id), 'ts', CAST(ts AS TIMESTAMP) + INTERVAL 5 SECONDS, 'status', IF(event_id % 2 = 0, 'running', 'polled')),
  named_struct('job_id', concat('j', event_id), 'ts', CAST(ts AS TIMESTAMP) + make_interval(0, 0, 0, 0, 0, CAST(event_id % 31 AS INT), 0),
               'status', CASE WHEN event_id % 7 = 0 THEN 'polled' WHEN event_id % 11 = 0 THEN 'error' ELSE 'completed' END)))"""


@query
def stream_job_states(spark, folder):
    """Public states of jobs by event time: repeats dropped, stuck jobs given up by timers, ended ones forgotten."""
    events = _stream(spark, folder).filter("event_id % 3 = 0").selectExpr(_JOB)
    return _appended(job_streams.job_states(events), "job_states")


_JOB_EVENTS = """WITH job AS (SELECT 'j' || event_id AS job_id, event_id AS e, ts FROM events WHERE event_id % 3 = 0),
seen AS (
  SELECT job_id, ts, 'queued' AS status FROM job UNION ALL SELECT job_id, ts + INTERVAL 5 SECONDS, 'running' FROM job
  UNION ALL SELECT job_id, ts + to_minutes(CAST(e % 31 AS INT)), CASE WHEN e % 11 = 0 THEN 'error' ELSE 'completed' END FROM job WHERE e % 7 <> 0),
mark AS (SELECT max(ts) - INTERVAL 1 MINUTE AS now FROM (SELECT ts FROM seen UNION ALL SELECT ts + to_minutes(CAST(e % 31 AS INT)) FROM job)),
past AS (SELECT s.* FROM seen s, mark WHERE s.ts <= now),
ends AS (SELECT j.job_id, j.ts, min(p.ts) AS ended, any_value(p.status) AS how FROM job j JOIN past p ON p.job_id = j.job_id AND p.status IN ('completed', 'error') AND p.ts <= j.ts + INTERVAL 1200 SECONDS GROUP BY ALL)"""
ORACLE["stream_job_states"] = _JOB_EVENTS + """
SELECT job_id, CASE status WHEN 'queued' THEN 'pending' WHEN 'running' THEN 'running' END AS state, ts AS at
FROM past p WHERE status IN ('queued', 'running') AND NOT (status = 'running' AND EXISTS (SELECT 1 FROM ends e WHERE e.job_id = p.job_id AND (e.ended < p.ts)))
  AND NOT (status = 'queued' AND EXISTS (SELECT 1 FROM ends e WHERE e.job_id = p.job_id AND e.ended <= p.ts AND e.how < 'queued'))
UNION ALL
SELECT job_id, CASE how WHEN 'error' THEN 'failed' ELSE 'complete' END, ended FROM ends
UNION ALL
SELECT j.job_id, 'failed', j.ts + INTERVAL 1200 SECONDS FROM job j, mark WHERE j.ts + INTERVAL 1200 SECONDS < now AND j.job_id NOT IN (SELECT job_id FROM ends)"""


@query
def stream_starts(spark, folder):
    """Which job answers each start of a target; starts soon after another belong to it."""
    requests = _stream(spark, folder).selectExpr("concat('t', user_id % 3) AS target", "concat('j', event_id) AS job_id", "ts", "event_id % 5 = 0 AS failed")
    return _appended(job_streams.starts(requests), "starts")


ORACLE["stream_starts"] = """WITH RECURSIVE mark AS (SELECT max(ts) - INTERVAL 1 MINUTE AS now FROM events),
asked AS (SELECT 't' || user_id % 3 AS target, 'j' || event_id AS job_id, ts, event_id % 5 = 0 AS failed FROM events, mark WHERE ts <= now),
counts AS (SELECT target, min(struct_pack(ts := ts, job_id := job_id)) AS s FROM asked WHERE NOT failed GROUP BY target
  UNION ALL
  SELECT c.target, min(struct_pack(ts := a.ts, job_id := a.job_id)) FROM counts c JOIN asked a ON a.target = c.target AND NOT a.failed AND a.ts > c.s.ts + INTERVAL 60 SECONDS GROUP BY c.target, c.s)
SELECT a.target, a.job_id, coalesce(c.s.job_id, a.job_id) AS answered_by
FROM asked a LEFT JOIN counts c ON c.target = a.target AND a.ts >= c.s.ts AND a.ts <= c.s.ts + INTERVAL 60 SECONDS"""


@query
def stream_broken_twice(spark, folder):
    """Link checks that are the second broken one of a URL in a row."""
    checks = _stream(spark, folder).selectExpr("concat('u', user_id) AS url", "ts", "event_id AS check_id", "IF(event_id % 5 < 2, 'broken', 'ok') AS verdict")
    return _appended(job_streams.broken_twice(checks), "broken_twice")


ORACLE["stream_broken_twice"] = """WITH checks AS (
  SELECT 'u' || user_id AS url, event_id AS check_id, event_id % 5 < 2 AS broken, lag(event_id % 5 < 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before
  FROM events, (SELECT max(ts) - INTERVAL 1 MINUTE AS now FROM events) WHERE ts <= now)
SELECT url, check_id FROM checks WHERE broken AND before"""


@query
def stream_share_of_voice(spark, folder):
    """Share of voice of each domain in sliding windows of a week, of finished windows only."""
    runs = _stream(spark, folder).selectExpr("user_id * 31 + dayofyear(ts) AS run_id", "CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts", "concat('d', event_id % 7 * (user_id % 3)) AS domain")
    return job_streams.shares_of_voice(_appended(job_streams.rolling_citations(runs), "voice"))


ORACLE["stream_share_of_voice"] = """WITH runs AS (
  SELECT DISTINCT user_id * 31 + dayofyear(ts) AS run_id, date_trunc('day', ts) AS day, 'd' || event_id % 7 * (user_id % 3) AS domain FROM events),
starts AS (
  SELECT unnest(generate_series(min(day) - INTERVAL 6 DAYS, max(day), INTERVAL 1 DAY)) AS start, max(day) AS newest FROM runs),
closed AS (SELECT start FROM starts WHERE start + INTERVAL 7 DAYS <= newest - INTERVAL 1 DAY),
total AS (SELECT start, count(DISTINCT run_id) AS n FROM closed JOIN runs ON day >= start AND day < start + INTERVAL 7 DAYS GROUP BY start)
SELECT c.start, r.domain, count(*) AS n, round(count(*) * 100.0::DOUBLE / any_value(t.n), 4) AS share
FROM closed c JOIN runs r ON day >= c.start AND day < c.start + INTERVAL 7 DAYS JOIN total t ON t.start = c.start GROUP BY ALL"""
