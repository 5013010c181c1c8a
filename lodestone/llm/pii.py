r"""Personal data by aggregated weak supervision, in DataFrame operations only.

Strict patterns give the base spans; these always stay.  Looser patterns, and strict ones that fail their check, give
candidates.  Labelers vote on every span for, against or not at all: checks (Luhn, octets, digits), gazetteers (endings
of mail hosts, card issuers, calling codes, addresses that name nobody), context words before and after, boundaries,
repetitions and grouping.  Expectation-maximisation over the counts of vote patterns of all spans estimates how often
each labeler votes what on personal and on other spans, base spans counting as personal.  Its posteriors are the soft
labels of a logistic regression over votes and shape, which decides on the candidates.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm._scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns, so written that a search is linear: a try begins where a run begins or the last match ended.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
STRICT = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
# Looser forms: disguised mail addresses, IPv6, cards in dotted groups, national and 00 numbers.
_AT, _DOT = r"\x20?(?:\[at\]|\(at\)|\{at\}|<at>)\x20?", r"\x20?(?:\.|\[dot\]|\(dot\)|\{dot\}|<dot>)\x20?"
_NAME = r"[A-Za-z0-9-]{1,63}+"
LOOSE_EMAIL = rf"(?i:(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?:{_AT}{_NAME}(?:{_DOT}{_NAME}){{1,5}}|\x20at\x20{_NAME}(?:\x20dot\x20{_NAME}){{1,5}}))"
LOOSE_IP = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"
LOOSE_CARD = r"(?<![0-9.])[0-9]{4}(?:\.[0-9]{4}){3}(?![0-9]|\.[0-9])"
LOOSE_PHONE = r"(?<![0-9A-Za-z+.(/-])(?:00[1-9][0-9]{0,2}[\x20/-])?(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20/.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])"
LOOSE = "|".join((LOOSE_EMAIL, LOOSE_IP, LOOSE_CARD, LOOSE_PHONE))
_MARK, _OTHER = "\u0001", "\u0002"
#: Code points before and after a span in which context words count.
NEAR = 48
THRESHOLD = 0.5
#: Spans that the final classifier is fitted on at most, by lowest hash; reliabilities come from all spans.
MAX_FIT_ROWS = 50_000
#: Rounds of the estimation at most; it ends once no share moves by SETTLED.
ROUNDS, SETTLED = 15, 1e-3
#: Votes that a labeler is taken to have cast as expected before any is counted.
PRIOR_VOTES = 20.0
TLDS = ["com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "it", "nl", "uk", "us", "ch", "at", "pl", "se", "jp", "ru", "br", "ca", "au"]
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6[0245])"
CALLING = r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689]|3[578]|42|5[09]|6[7-9]|8[058]|9[679])"
NOBODY = r"^(?:0|10|127|22[4-9]|2[34][0-9]|25[0-5]|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."
FOR_WORDS = {
    "email": r"e-?mails?|mail|contact|write|reply|adresse|correo|courriel",
    "ip": r"ip|ips|ipv6|host|client|login|visitor|session",
    "card": r"card|cards|visa|mastercard|amex|credit|debit|karte|tarjeta|carte|payment",
    "phone": r"tel|telephone|phone|call|fax|mobile|cell|telefon|whatsapp|sms|ring",
}
AGAINST = r"version|ver|section|chapter|isbn|issn|doi|order|invoice|serial|model|build|revision|commit|hash|checksum|sku|part|figure|table|page|pages"
#: Each labeler's first guess: shares of votes for and against, on personal spans and on others; the rest abstains.
LABELERS = {
    "check": ((0.95, 0.02), (0.10, 0.85)),
    "gazetteer": ((0.70, 0.10), (0.30, 0.50)),
    "words_for": ((0.30, 0.00), (0.05, 0.00)),
    "words_against": ((0.00, 0.02), (0.00, 0.25)),
    "bounds": ((0.00, 0.05), (0.00, 0.30)),
    "repeats": ((0.00, 0.02), (0.00, 0.20)),
    "groups": ((0.50, 0.00), (0.20, 0.00)),
}
SHAPE = ["length", "digit_share", "n_groups", *[f"is_{k}" for k in KINDS]]
FEATURES = [*[f"{j}_{s}" for j in LABELERS for s in ("for", "against")], *SHAPE]


def _marked(text: Column, pattern: str, name: str) -> Column:
    """The matches of a pattern in order: what pass found it, its number, the code points between it and the last, itself, and its surroundings."""
    parts = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)

    def cut(p: Column) -> Column:
        each = lambda k: F.struct(
            F.lit(name).alias("by"), k.alias("nth"), F.length(F.element_at(p, 2 * k - 1)).alias("gap"), F.element_at(p, 2 * k).alias("hit"),
            F.right(F.element_at(p, 2 * k - 1), F.lit(NEAR)).alias("left"), F.left(F.element_at(p, 2 * k + 1), F.lit(NEAR)).alias("right"),
        )
        return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.floor(F.size(p) / 2).cast("int")), each)).otherwise(F.array())

    # Bound to a variable, so that the text is cut once and not for each match.
    return F.element_at(F.transform(F.array(parts), cut), 1)


def _luhn(digits: Column) -> Column:
    def value(k: Column) -> Column:
        d = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int")
        return F.when(k % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    places = F.sequence(F.lit(0), F.greatest(F.length(digits), F.lit(1)) - 1)
    return (F.length(digits) > 0) & (F.aggregate(places, F.lit(0), lambda acc, k: acc + value(k)) % 10 == 0)


def described(rows: DataFrame) -> DataFrame:
    """``rows`` (by, hit, left, right) with ``kind``, ``is_base``, a vote of each labeler (1, 0 or -1) and the shape."""
    hit, by = F.col("hit"), F.col("by")
    loose = F.when(hit.contains("@") | hit.rlike(r"(?i)\bat\b"), "email").when(hit.contains(":"), "ip").when(hit.rlike(r"^[0-9]{4}(?:\.[0-9]{4}){3}$"), "card").otherwise("phone")
    rows = rows.withColumn("kind", F.when(by == "loose", loose).otherwise(by)).withColumn("digits", F.regexp_replace(hit, "[^0-9]", ""))
    kind, digits, n = F.col("kind"), F.col("digits"), F.length("digits")
    octets = hit.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    passed = F.when(kind == "card", (n >= 14) & (n <= 19) & _luhn(digits)).when(kind == "phone", (n >= 10) & (n <= 15)).when((kind == "ip") & ~hit.contains(":"), octets)
    ending = F.lower(F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1))
    listed = (
        F.when(kind == "email", ending.isin(TLDS)).when(kind == "card", digits.rlike(ISSUERS)).when((kind == "phone") & hit.rlike(r"^(?:\+|00)"), hit.rlike(CALLING))
        .when((kind == "ip") & ~hit.contains(":"), ~hit.rlike(NOBODY))
    )
    left, right = F.lower("left"), F.lower("right")
    around = F.concat(left, F.lit(" | "), right)
    word = lambda words: around.rlike(rf"(?<![\p{{L}}0-9@.-])(?:{words})(?![\p{{L}}0-9@]|[.-][\p{{L}}0-9])")
    told = F.lit(False)
    for k, words in FOR_WORDS.items():
        told = F.when(kind == k, word(words)).otherwise(told)
    grouped = (
        F.when(kind == "card", hit.rlike(r"^[0-9]{4}(?:[\x20.-][0-9]{4}){3}$")).when(kind == "phone", hit.rlike(r"[(\x20/-]"))
        .when(kind == "email", hit.rlike(r"^[A-Za-z]")).otherwise(F.lit(False))
    )
    touched = left.rlike(r"[\p{L}0-9_/=#$]$") | right.rlike(r"^[\p{L}0-9_/]")
    repeated = digits.rlike(r"([0-9])\1{5}|01234567|12345678|98765432")
    either = lambda c: F.when(c.isNull(), -1).when(c, 1).otherwise(0)
    votes = {
        "check": either(passed),
        "gazetteer": either(listed),
        "words_for": F.when(told, 1).otherwise(-1),
        "words_against": F.when(left.rlike(rf"(?<![\p{{L}}0-9])(?:{AGAINST})\W{{0,3}}(?:no|nr|number)?\W{{0,3}}$"), 0).otherwise(-1),
        "bounds": F.when(touched, 0).otherwise(-1),
        "repeats": F.when(repeated, 0).otherwise(-1),
        "groups": F.when(grouped, 1).otherwise(-1),
    }
    shape = {
        "length": F.least(F.length(hit), F.lit(64)) / 64,
        "digit_share": n / F.greatest(F.length(hit), F.lit(1)),
        "n_groups": F.least(F.regexp_count(hit, F.lit("[A-Za-z0-9]+")), F.lit(12)) / 12,
    } | {f"is_{k}": (kind == k).cast("double") for k in KINDS}
    is_base = (by != "loose") & ((kind == "email") | F.coalesce(passed, F.lit(False)))
    return rows.withColumn("is_base", is_base).withColumns({j: v.cast("byte") for j, v in votes.items()}).withColumns({s: c.cast("double") for s, c in shape.items()})


def all_spans(docs: DataFrame) -> DataFrame:
    """Every span of every row: ``nth_row``, ``row`` (all columns but text), ``start``, ``stop`` and what ``described`` says; a row of nulls where there is none."""
    kept = [c for c in docs.columns if c.lower() != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    text = F.when(text.contains(_MARK), F.translate(text, _MARK, _OTHER)).otherwise(text)
    rows = docs.select(F.monotonically_increasing_id().alias("nth_row"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), text.alias("text"))
    text, digits = F.col("text"), F.col("text").rlike("[0-9]")
    may = {"email": text.contains("@"), "ip": digits, "card": digits, "phone": text.contains("+")}
    rare = digits | text.rlike(r"(?i)[\[({<]at[\])}>]|\x20at\x20[a-z0-9-]+\x20dot\x20") | text.contains("::")
    passes = [F.when(may[k], _marked(text, p, k)).otherwise(F.array()) for k, p in STRICT.items()]
    found = F.concat(*passes, F.when(rare, _marked(text, LOOSE, "loose")).otherwise(F.array()))
    rows = rows.select("nth_row", "row", F.explode_outer(found).alias("found")).select("nth_row", "row", "found.*")
    # A row's matches number at most what its text holds; each pass adds up what stands before.
    before = Window.partitionBy("nth_row", "by").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.length("hit")).over(before).cast("long")
    rows = rows.repartition("nth_row").withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("hit"))
    return described(rows).drop("gap", "nth", "digits")


def _shares(first: tuple[float, float]) -> dict[int, float]:
    return {1: first[0], 0: first[1], -1: 1 - first[0] - first[1]}


class Reliabilities:
    """Per kind: the share of personal spans among those that aren't base, and of each labeler's votes on personal spans and on others."""

    def __init__(self, share: dict[str, float], tables: dict[tuple[str, str, int], dict[int, float]]):
        self.share, self.tables = share, tables

    def posterior(self) -> Column:
        """The probability that a span with these votes is personal."""
        odds = F.lit(0.0)
        for kind in KINDS:
            here = F.lit(math.log(self.share[kind] / (1 - self.share[kind])))
            for j in LABELERS:
                yes, no = self.tables[kind, j, 1], self.tables[kind, j, 0]
                ratio = {v: math.log(yes[v] / no[v]) for v in (1, 0, -1)}
                here = here + F.when(F.col(j) == 1, ratio[1]).when(F.col(j) == 0, ratio[0]).otherwise(ratio[-1])
            odds = F.when(F.col("kind") == kind, here).otherwise(odds)
        return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> Reliabilities:
    """Expectation-maximisation over ``patterns`` (kind, is_base, a vote a labeler, n): base spans are personal, others as likely as their votes say.

    ``patterns`` has a row a combination, so its size has a bound; each round sums it up in Spark.
    """
    floor = 1e-3
    smooth = lambda first: {v: max(s, floor) for v, s in _shares(first).items()}
    tables = {(k, j, y): smooth(LABELERS[j][1 - y]) for k in KINDS for j in LABELERS for y in (0, 1)}
    prior = dict(tables)
    now = Reliabilities(dict.fromkeys(KINDS, 0.5), tables)
    p, q = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
    sums = [F.sum(p).alias("yes"), F.sum(q).alias("no"), F.sum(F.when(~F.col("is_base"), p).otherwise(0.0)).alias("open_yes")]
    for j in LABELERS:
        for v in (1, 0, -1):
            sums += [F.sum(F.when(F.col(j) == v, part)).alias(f"{j}|{v}|{y}") for y, part in ((1, p), (0, q))]
    for _ in range(rounds):
        told = patterns.withColumn("p", F.when(F.col("is_base"), 1.0).otherwise(now.posterior()))
        share, tables = dict(now.share), dict(now.tables)
        for r in told.groupBy("kind").agg(*sums).collect():
            share[r.kind] = (r["open_yes"] + 1) / (r["open_yes"] + r["no"] + 2)
            for j in LABELERS:
                for y, total in ((1, r["yes"]), (0, r["no"])):
                    got = {v: (r[f"{j}|{v}|{y}"] or 0.0) + PRIOR_VOTES * prior[r.kind, j, y][v] for v in (1, 0, -1)}
                    tables[r.kind, j, y] = {v: x / sum(got.values()) for v, x in got.items()}
        moved = max(abs(share[k] - now.share[k]) for k in KINDS)
        now = Reliabilities(share, tables)
        if moved < SETTLED:
            break
    return now


def _vectors(rows: DataFrame) -> DataFrame:
    votes = {f"{j}_{s}": (F.col(j) == v).cast("double") for j in LABELERS for s, v in (("for", 1), ("against", 0))}
    return VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(rows.withColumns(votes))


def fit_spans(spans: DataFrame, reliabilities: Reliabilities, max_fit_rows: int = MAX_FIT_ROWS) -> LogisticRegressionModel:
    """A logistic regression on at most ``max_fit_rows`` spans, each once as personal and once not, weighted by its posterior."""
    rows = spans.orderBy(F.xxhash64("hit", "left", "right"), "start").limit(max_fit_rows)
    rows = rows.withColumn("p", F.when(F.col("is_base"), 1.0).otherwise(reliabilities.posterior()))
    both = rows.withColumn("label", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).withColumn("weight", F.when(F.col("label") == 1, F.col("p")).otherwise(1 - F.col("p")))
    both = _vectors(both.filter("weight > 1e-6")).select("label", "weight", "vector").coalesce(1)
    return LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight", regParam=1e-3, maxIter=50).fit(both)


def judged_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``nth_row, row, kind, start, stop, hit, is_base, score`` of every span that is base or judged personal, and a row of nulls for rows without one.

    A candidate that overlaps a base span is left out: it says nothing new.
    """
    scratch = Scratch(spark)
    spans = scratch.save(all_spans(docs))
    real = spans.filter("hit IS NOT NULL")
    patterns = scratch.save(real.groupBy("kind", "is_base", *LABELERS).agg(F.count("*").alias("n")).coalesce(1))
    columns = ["nth_row", "row", "kind", "start", "stop", "hit", "is_base"]
    if patterns.filter("NOT is_base").isEmpty():
        return spans.select(*columns, F.when(F.col("is_base"), 1.0).alias("score"))
    model = fit_spans(real, estimate(patterns))
    # Where the last base span before ends, and where the next one begins.
    order = Window.partitionBy("nth_row").orderBy("start", F.col("is_base").desc())
    ended = F.max(F.when(F.col("is_base"), F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when(F.col("is_base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    real = real.withColumn("apart", (F.coalesce(ended, F.lit(0)) <= F.col("start")) & (F.coalesce(begins, F.col("stop")) >= F.col("stop")))
    scored = model.transform(_vectors(real)).withColumn("score", F.when(F.col("is_base"), 1.0).otherwise(vector_to_array("probability")[1]))
    keep = F.col("is_base") | (F.col("apart") & (F.col("score") >= THRESHOLD))
    blank = [F.when(keep, F.col(c)).alias(c) for c in (*columns[2:], "score")]
    scored = scored.select("nth_row", "row", *blank)
    return scored.unionByName(spans.filter("hit IS NULL").select(*columns, F.lit(None).cast("double").alias("score")))


def find_personal_data(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per span of personal data: the columns of ``docs`` but text, then ``kind, start, stop, hit, is_base, score``.

    Places are code points, ``stop`` exclusive.  Null and empty texts have none, repeated rows report alike, columns
    named like a result (in any case) are replaced.  Control character 1 counts as another one.  Very long texts are
    searched in linear time.  An empty table gives an empty result.
    """
    taken = {"kind", "start", "stop", "hit", "is_base", "score", "text"}
    kept = [c for c in docs.columns if c.lower() not in taken]
    found = judged_spans(spark, docs.select(*[F.col(f"`{c}`") for c in kept], "text")).filter("hit IS NOT NULL")
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "kind", "start", "stop", "hit", "is_base", "score")


def span_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A row a row of ``docs``: doc_id, base spans by kind, their digest, all spans in words, and how many were added."""
    rows = judged_spans(spark, docs.select("doc_id", "text"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "stop", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("stop").cast("string")).alias("said"))
    joined = lambda spans: F.array_join(F.transform(F.sort_array(spans), lambda s: s["said"]), ",")
    count = lambda k: F.count_if(F.col("is_base") & (F.col("kind") == k)).alias(f"n_{k}")
    grouped = rows.groupBy("nth_row").agg(
        F.first("row.doc_id").alias("doc_id"), *map(count, KINDS),
        F.collect_list(F.when(F.col("is_base"), span)).alias("base"), F.collect_list(F.when(F.col("hit").isNotNull(), span)).alias("all"),
    )
    added = (F.size("all") - F.size("base")).cast("long").alias("n_added")
    return grouped.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), added)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and digest of the base spans, and all spans."""
    return span_digests(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
