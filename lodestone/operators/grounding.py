"""From findings to cited guidance: query texts, curated and searched citations, attachment, re-grounding, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.rounding import py_round
from lodestone.operators.retrieval import supports, tokens, trusted
from lodestone.operators.scoring import clean_id

# What a section is about, and the words that rules use for what is counted.
SECTION_HINT = {
    "A": "technical seo crawl index", "B": "performance core web vitals speed", "C": "on-page content heading title",
    "D": "schema structured data json-ld", "E": "aeo discovery crawler sitemap", "F": "aeo extraction answer citation entity",
    "G": "trust author credentials e-e-a-t", "H": "competitive comparison", "I": "geo brand presence ai overview", "J": "entity consistency nap sameas",
}
COUNT_WORDS = {
    "word": ["word", "count", "content", "length"], "char": ["character", "count", "length"], "character": ["character", "count", "length"],
    "link": ["link", "count"], "image": ["image", "count"], "request": ["request", "count", "http"], "redirect": ["redirect", "chain", "count"],
    "script": ["script", "count"], "element": ["element", "count"],
}
NUMBER = r"(?<![\w/.,-])([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(\.[0-9]+)?"
TIME = NUMBER + r"\s*(milliseconds?|msecs?|ms|minutes?|mins?|seconds?|secs?|s)\b"
SIZE = NUMBER + r"\s*(kilobytes?|kb|megabytes?|mb|gigabytes?|gb|bytes?)\b"
SHARE = NUMBER + r"\s*(%|percent(?:age)?\b|pct\b)"
COUNT = NUMBER + r"\s+(words?|characters?|chars?|links?|images?|requests?|redirects?|scripts?|elements?)\b"
REFERENCE = r"(?i)(rule|principle|anti[-_\s]?pattern|ap)s?\s*(?:\(\s*)?(?:id\s*[:#=]?\s*|#)\s*([0-9]{1,6})"
KINDS = ["rule", "ap", "principle", "playbook"]
HINTS, HARD_CAP, EVIDENCE = 8, 16, 200
# Guidance that prescribes features of search results which are gone, and what a row says that reports just that.
RETIRED = {
    "howto": r"(?i)(?:(?<!not )(?<!n't )(?<!never )(?<!avoid )\b(?:add\w*|appl(?:y|ie)\w*|implement\w*|us(?:e[sd]?|ing)|adopt\w*|includ\w*|deploy\w*|leverag\w*|consider\w*|creat\w*|publish\w*)\b[^.!?]{0,80}?\bhow\s?-?to\s+(?:schema|markup|structured\s+data))|(?:\bhow\s?-?to\s+(?:schema|markup|structured\s+data)[^.!?]{0,100}?\brich\s+(?:results?|snippets?))|(?:\bhow\s?-?to\s+rich\s+(?:results?|snippets?))",
    "faq": r"(?i)faq[a-z]*\s+(schema|markup|structured\s+data)(\s+markup)?[^.!?]{0,60}?(surface|qualify|eligib\w*|earn\w*)[^.!?]{0,60}?(?<!q&a\s)rich\s+(results?|snippets?)",
}
REPORTS_RETIRED = r"(?i)no\s+longer|do(?:es)?\s+not\s+rely|don'?t\s+rely|deprecat|discontinu|\bretired\b|\bsunset|restricted\s+to|not\s+supported|stopp?ed\s+(?:showing|supporting)|will\s+not\s+be\s+shown"
GUIDANCE_TEXTS = ["name", "title", "if_condition", "then_action", "description", "statement", "explanation", "summary", "use_when", "avoid_when"]


def quantity(value: Column) -> Column:
    """A number with one decimal, none where it is whole."""
    r = py_round(value, 1)
    return F.when(r == F.floor(r), F.floor(r).cast("string")).otherwise(F.format_string("%.1f", r))


def plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def numeric_hints(text: Column, cap: int = HINTS) -> Column:
    """Words for the first time, size, share and count that a text states: the value in the unit of rules, and its terms."""
    t = plain(text)
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    value = lambda pattern: F.concat(F.replace(part(pattern, 1), F.lit(","), F.lit("")), part(pattern, 2)).try_cast("double")
    words = lambda first, *more: F.array(first, *map(F.lit, more))
    none = F.array().cast("array<string>")
    unit = part(TIME, 3)
    seconds = F.when(unit.startswith("ms") | unit.startswith("milli"), value(TIME) / 1000.0).when(unit.startswith("min"), value(TIME) * 60.0).otherwise(value(TIME))
    head = F.left(part(SIZE, 3), F.lit(1))
    kb = value(SIZE) * F.when(head == "b", 1.0 / 1024).when(head == "k", 1.0).when(head == "m", 1024.0).otherwise(1024.0 * 1024)
    noun = F.regexp_replace(part(COUNT, 3), "s$", "")
    counted = none
    for name, vocabulary in COUNT_WORDS.items():
        counted = F.when(noun == name, F.array(*map(F.lit, vocabulary))).otherwise(counted)
    every = F.concat(
        F.when(unit != "", words(quantity(seconds), "seconds", "load", "time", "speed")).otherwise(none),
        F.when(head == "", none).when(kb >= 1024, words(quantity(kb / 1024.0), "mb", "megabytes", "page", "size", "weight")).otherwise(words(quantity(kb), "kb", "kilobytes", "page", "size", "weight")),
        F.when(part(SHARE, 1) != "", words(quantity(value(SHARE)), "percent", "percentage", "ratio")).otherwise(none),
        counted,
    )
    return F.slice(F.array_distinct(every), 1, max(0, min(cap, HARD_CAP)))


def query_text(check_id: Column, evidence: Column) -> Column:
    """What to search for a finding: its evidence, its check's name, its section's topic, and hints not said yet."""
    clean = F.regexp_replace(F.coalesce(check_id, F.lit("")), r"^[^:]*:", "")
    letter = F.regexp_extract(clean, r"^([A-Z])[0-9]", 1)
    hint = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SECTION_HINT.items() for x in pair]), letter), F.lit(""))
    body = F.trim(F.replace(F.regexp_replace(clean, r"^[A-Z][0-9]+[a-z]?_", ""), F.lit("_"), F.lit(" ")))
    topic = F.trim(F.concat(body, F.lit(" "), hint))
    base = F.when(topic == "", clean).otherwise(topic)
    said = F.substring(plain(evidence), 1, EVIDENCE)
    query = F.trim(F.concat(said, F.lit(" "), base))
    fresh = F.array_except(numeric_hints(evidence), F.split(F.lower(query), "[^a-z0-9.]+"))
    return F.when(said == "", base).when(F.size(fresh) > 0, F.concat(query, F.lit(" "), F.array_join(fresh, " "))).otherwise(query)


def full_text(docs: DataFrame, queries: DataFrame, k: int, broadcast_terms: int = 200_000, by: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, [by,] rank, doc_id, score``: documents with any of a query's words, by how often they hold them, ties to the smaller id.

    ``k`` documents a query, or a query and values of the columns ``by``.

    Asked words are broadcast after they were counted, and meet each document's words where it is read, so that only sums of
    (query, document) are shuffled.  Beyond ``broadcast_terms`` rows of asked words, documents' words among them are counted
    and joined by shuffle.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    words = docs.select("doc_id", *by, F.explode(tokens(F.col("text"))).alias("term"))
    if asked.limit(broadcast_terms + 1).count() <= broadcast_terms:
        scores = words.join(F.broadcast(asked), "term").groupBy("query_id", "doc_id", *by).agg(F.count("*").alias("score"))
    else:
        postings = words.join(asked.select("term").distinct(), "term", "left_semi").groupBy("doc_id", *by, "term").agg(F.count("*").alias("tf"))
        scores = postings.join(asked, "term").groupBy("query_id", "doc_id", *by).agg(F.sum("tf").alias("score"))
    w = Window.partitionBy("query_id", *by).orderBy(F.col("score").desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", *by, "rank", "doc_id", "score")


def layered(vector_hits: DataFrame, text_hits: DataFrame, same_space: bool = True) -> DataFrame:
    """``query_id, kind, id, layer, rank``: each query's vector hits of a kind, or its text hits where it has none.

    With vectors of another embedding space (``same_space`` false) the vector layer is refused as a whole.
    """
    near = vector_hits if same_space else vector_hits.limit(0)
    rest = text_hits.join(near.select("query_id", "kind").distinct(), ["query_id", "kind"], "left_anti")
    pick = lambda rows, name: rows.select("query_id", "kind", "id", F.lit(name).alias("layer"), "rank")
    return pick(near, "vector").unionByName(pick(rest, "fts"))


def resolve_checks(ids: DataFrame, keys: DataFrame) -> DataFrame:
    """``check_id, key``: each id's own key, else the shortest key of its letter and number, else the id itself.

    ``ids``: check_id.  ``keys``: key.  Keys are joined on their letter and number, so no pair of ids and keys is formed that doesn't share it.
    """
    stem = lambda c: F.regexp_extract(c, r"^([A-J][0-9]+)[a-z]?(?:_|$)", 1)
    bare = lambda c: F.regexp_extract(c, r"^([A-J][0-9]+)_", 1)
    short = keys.withColumn("stem", bare(F.col("key"))).filter("stem <> ''").groupBy("stem").agg(F.min(F.struct(F.length("key").alias("n"), "key")).alias("s"))
    rows = ids.select("check_id").distinct().withColumn("stem", stem(F.col("check_id")))
    rows = rows.join(keys.select(F.col("key").alias("own")).distinct(), F.col("check_id") == F.col("own"), "left").join(short, "stem", "left")
    return rows.select("check_id", F.coalesce("own", F.when(F.col("stem") != "", F.col("s.key")), "check_id").alias("key"))


def retired_feature(corpus: DataFrame) -> Column:
    """The retired feature (a name of ``RETIRED``) that a row's texts prescribe; null for none, or where they report it as retired.

    Looks at whichever of ``GUIDANCE_TEXTS`` the table has, whole and joined by spaces; nulls are left out.
    """
    held = {c.lower() for c in corpus.columns}
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in GUIDANCE_TEXTS if c in held]
    text = F.concat_ws(" ", F.lit(""), *texts)
    said = F.coalesce(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in RETIRED.items()])
    return F.when(~text.rlike(REPORTS_RETIRED), said)


def curated(asks: DataFrame, mapping: DataFrame, corpus: DataFrame, k: int = 3) -> DataFrame:
    """``query_id, rank, kind, id``: trusted rows that a check's mapping names and that apply to the page's type and industry.

    ``asks``: query_id, key, page_type, industry (null: any).  ``mapping``: key, kind, id.  ``corpus``: kind, id, tier,
    confidence, page_types, industries (arrays, empty or null: all) and the trust columns.  Rows that prescribe a retired
    feature (``retired_feature``) are left out before ranking.
    """
    rows = asks.join(mapping, "key").join(trusted(corpus).filter(retired_feature(corpus).isNull()), ["kind", "id"])
    applies = lambda tags, wanted: wanted.isNull() | (F.coalesce(F.size(tags), F.lit(0)) <= 0) | F.array_contains(tags, wanted) | F.array_contains(tags, "all")
    rows = rows.filter(applies(F.col("page_types"), F.col("page_type")) & applies(F.col("industries"), F.col("industry")))
    w = Window.partitionBy("query_id").orderBy("tier", F.col("confidence").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "kind", "id")


def retrieve_batch(specs: DataFrame, searched: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, kind, id``: rows that a spec names by id, in its order, else what the search found for it.

    ``specs``: query_id, rule_ids (array, empty or null: search).  ``searched``: query_id, rank, kind, id.
    """
    named = specs.filter(F.size("rule_ids") > 0).select("query_id", F.posexplode("rule_ids").alias("at", "id"))
    named = named.join(trusted(corpus).filter("kind = 'rule'").select("id", "kind"), "id")
    w = Window.partitionBy("query_id").orderBy("at")
    named = named.withColumn("rank", F.row_number().over(w)).select("query_id", "rank", "kind", "id")
    rest = searched.join(specs.filter(F.coalesce(F.size("rule_ids"), F.lit(0)) <= 0).select("query_id"), "query_id", "left_semi")
    return named.unionByName(rest.select("query_id", "rank", "kind", "id")).filter(F.col("rank") <= k)


def attach(findings: DataFrame, pool: DataFrame, verdicts: DataFrame, k: int = 3, pool_size: int = 24) -> DataFrame:
    """``audit_id, check_id, rank, kind, id, verdict``: the citations of every failing or warning finding.

    Of a check's first ``pool_size`` candidates those judged to support it come first, then the related, the unjudged and
    the rest, each in the pool's order.  ``pool``: check_id, rank, kind, id.  ``verdicts``: check_id, kind, id, verdict.
    """
    bad = findings.filter(F.col("status").isin("fail", "warn")).select("audit_id", "check_id")
    band = F.when(F.col("verdict") == "supports", 0).when(F.col("verdict") == "related", 1).when(F.col("verdict").isNull(), 2).otherwise(3)
    rows = pool.filter(F.col("rank") <= pool_size).join(verdicts, ["check_id", "kind", "id"], "left").withColumn("band", band)
    # The choice is the check's, so it is made once for each check, not for each finding.
    w = Window.partitionBy("check_id").orderBy("band", "rank")
    best = rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k)
    return bad.join(best, "check_id").select("audit_id", "check_id", F.col("nth").alias("rank"), "kind", "id", "verdict")


def plausible_text(claimed: Column, source: Column) -> Column:
    a, b = F.array_distinct(tokens(claimed)), tokens(source)
    both = F.size(F.array_intersect(a, b))
    return (F.size(a) == 0) | (both >= 2) | (both >= 0.34 * F.size(a))


def supports_fix(claimed: Column, source: Column) -> Column:
    """Whether a fix rests on a source: three shared tokens and a quarter of its own; a fix that says nothing rests on none."""
    a, b = F.array_distinct(tokens(claimed)), tokens(source)
    both = F.size(F.array_intersect(a, b))
    return (F.size(a) > 0) & (both >= 3) & (both >= 0.25 * F.size(a))


def reground(cites: DataFrame, corpus: DataFrame) -> DataFrame:
    """``cite_id, kind, id, state``: each citation's row, of the kind it names or else of another one, if its text fits.

    A citation that says nothing is taken at its word: it stays with its kind and moves to no other.  One that says
    something must be plausible for the kind it names too.  ``cites``: cite_id, kind, id, text.  ``corpus``: kind, id, body.
    """
    order = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("c.kind")), F.lit(99))
    rows = cites.alias("x").join(corpus.alias("c"), F.col("x.id") == F.col("c.id"), "left")
    same = F.col("x.kind") == F.col("c.kind")
    says = F.size(tokens(F.col("x.text"))) > 0
    fits = F.col("c.kind").isNotNull() & (same | says) & plausible_text(F.col("x.text"), F.col("c.body"))
    rank = F.when(fits, F.struct(F.when(same, 0).otherwise(1).alias("other"), order.alias("place"), F.col("c.kind").alias("kind")))
    best = rows.groupBy("x.cite_id", F.col("x.id").alias("id"), F.col("x.kind").alias("claimed")).agg(F.min(rank).alias("b"))
    state = F.when(F.col("b").isNull(), "lost").when(F.col("b.other") == 0, "kept").otherwise("recovered")
    return best.select("cite_id", F.coalesce("b.kind", "claimed").alias("kind"), "id", state.alias("state"))


def references(texts: DataFrame, corpus: DataFrame, most: int = 4) -> DataFrame:
    """``fix_id, nth, kind, id, known``: the rows that a text refers to by number, in order, each once, at most ``most``.

    ``texts``: fix_id, text.  ``corpus``: kind, id (text).
    """
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(REFERENCE), F.lit(0))
    name = lambda r: F.lower(F.regexp_extract(r, REFERENCE, 1))
    kind = lambda r: F.when(name(r).isin("rule", "principle"), name(r)).otherwise("ap")
    refs = F.array_distinct(F.transform(found, lambda r: F.struct(kind(r).alias("kind"), F.regexp_extract(r, REFERENCE, 2).alias("id"))))
    rows = texts.select("fix_id", F.posexplode(F.slice(refs, 1, most)).alias("nth", "r")).select("fix_id", "nth", "r.kind", "r.id")
    known = corpus.select("kind", "id").distinct().withColumn("known", F.lit(True))
    return rows.join(known, ["kind", "id"], "left").select("fix_id", "nth", "kind", "id", F.coalesce("known", F.lit(False)).alias("known"))


# Words of a check's name that say nothing of its topic.
NAME_STOP = [
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "with", "is", "are", "be", "has", "have", "had", "no", "not", "check", "checks", "checked", "page", "pages",
    "present", "presence", "missing", "valid", "invalid", "proper", "properly", "correct", "correctly", "ensure", "ensures", "without", "via",
]


def canonical_checks(found: DataFrame, canon: DataFrame, aliases: DataFrame) -> DataFrame:
    """``audit_id, ord, check_id, renamed, vocab_status``: ids brought to the canonical one of their letter and number, if they mean the same.

    An alias, or a telling word that both names hold, says that they do.  Two ids of an audit never get one name: an id
    that is canonical itself keeps it, else the first by order takes it.  Ids of sub-checks (a letter after the number)
    are left alone and have no status; the others are canonical, aliased or foreign.  ``found``: audit_id, ord, check_id.
    ``canon``: canonical.  ``aliases``: variant, canonical.
    """
    part = lambda c, k: F.regexp_extract(c, r"^([A-J])([0-9]+)([a-z]?)_", k)
    slot = lambda c: F.when(part(c, 1) != "", F.when(part(c, 3) == "", F.concat(part(c, 1), part(c, 2))))
    words = lambda c: F.regexp_extract_all(F.lower(F.regexp_replace(c, r"^[A-J][0-9]+[a-z]?_", "")), F.lit("[a-z0-9]+"), F.lit(0))
    tail = lambda c: F.filter(words(c), lambda t: (F.length(t) >= 2) & ~t.isin(NAME_STOP))
    check = F.col("check_id")
    names = canon.select("canonical", slot(F.col("canonical")).alias("slot")).distinct()
    of_slot = names.filter("slot IS NOT NULL").groupBy("slot").agg(F.max("canonical").alias("canonical"))
    rows = found.withColumn("slot", slot(check)).join(of_slot, "slot", "left").join(aliases.select(F.col("variant").alias("check_id"), F.col("canonical").alias("alias")), "check_id", "left")
    rows = rows.join(names.select(F.col("canonical").alias("check_id"), F.lit(True).alias("listed")), "check_id", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    same = (F.col("alias") == F.col("canonical")) | F.arrays_overlap(tail(check), tail(F.col("canonical")))
    rows = rows.withColumn("wanted", F.when(F.col("listed"), check).when(F.coalesce(same, F.lit(False)), F.col("canonical")))
    w = Window.partitionBy("audit_id", "wanted").orderBy(F.when(F.col("listed"), 0).otherwise(1), "ord")
    aliased = F.col("wanted").isNotNull() & ~F.col("listed") & (F.row_number().over(w) == 1)
    status = F.when(F.col("listed"), "canonical").when(F.col("aliased"), "aliased").when((part(check, 1) != "") & (part(check, 3) != ""), F.lit(None)).otherwise("foreign")
    rows = rows.withColumn("aliased", aliased)
    return rows.select("audit_id", "ord", "check_id", F.when(F.col("aliased"), F.col("wanted")).otherwise(check).alias("renamed"), status.alias("vocab_status"))


def citation_line(rows: DataFrame) -> DataFrame:
    """``kind, id, line``: rows (kind, id, source_org, name, confidence, source_url, excerpt, provenance_status) as report lines.

    Names are cut to 500 characters; a line says whether the row is faithful to its source.
    """
    label = F.when(F.col("kind") == "rule", "Rule").when(F.col("kind") == "ap", "AP").when(F.col("kind") == "principle", "Principle").otherwise("Playbook")
    faithful = (F.col("provenance_status") == "verified") & (F.coalesce(F.trim("excerpt"), F.lit("")) != "")
    url = F.when(F.coalesce("source_url", F.lit("")) != "", F.concat(F.lit(" <"), F.col("source_url"), F.lit(">"))).otherwise("")
    line = F.concat(
        F.lit("Per "), F.coalesce("source_org", F.lit("unknown")), F.lit(": "), F.substring(F.coalesce("name", F.lit("")), 1, 500), F.lit(" ["), label, F.lit(" #"), F.col("id").cast("string"),
        F.lit(", confidence "), F.format_string("%.2f", F.col("confidence")), F.lit("]"), url, F.when(F.coalesce(faithful, F.lit(False)), " verified").otherwise(""),
    )
    return rows.select("kind", "id", line.alias("line"))


def first_by_name(labels: DataFrame, corpus: DataFrame) -> DataFrame:
    """``label_id, id``: each label's row by its name in lower case and single spaces; of equal names the smallest id."""
    rows = corpus.select(plain(F.col("name")).alias("key"), "id").filter("key <> ''").groupBy("key").agg(F.min("id").alias("id"))
    return labels.select("label_id", plain(F.col("name")).alias("key")).join(rows, "key").select("label_id", "id")


__all__ = ["attach", "canonical_checks", "citation_line", "curated", "first_by_name", "full_text", "layered", "numeric_hints", "query_text", "references", "reground", "resolve_checks", "retrieve_batch", "supports", "supports_fix"]
