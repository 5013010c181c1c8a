"""Secret scans with a random forest that removes false positives, in DataFrame operations only.

Candidates are private key blocks, passwords in connection URLs, values assigned to a telling name and long runs of token
characters.  Each is described by its length, its character transitions, how much of it dictionary words cover, its path
and its neighbouring words, and a random forest trained on labelled findings tells secrets from placeholders, names,
numbers and digests.  Dictionary and findings are fixed, so that one text gets one verdict in any corpus; names that the
dictionary lacks are told by how they can be pronounced.  The forest is fitted once and kept in the shared folder.
Neighbouring words count only where they stand alone, not inside other words or host names.
"""

from __future__ import annotations

import hashlib

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._scratch import Scratch, shared_dir, spread_join

#: A name, an assignment and a value; or a run of token characters.
NAMES = r"(?:token|secret|passw(?:or)?d|pwd|credential|(?:api|access|auth|private)[_-]?key)s?"
_TOKEN = r"[A-Za-z0-9_+/=.\-]"
#: The name may be the end of a longer one (DB_PASSWORD) and have more parts (ACCESS_KEY_ID).  Only where a run begins, so the search stays linear.
KEY = rf"(?<!{_TOKEN}){_TOKEN}*?{NAMES}(?:[_.\-][A-Za-z0-9_.\-]*)?[\"']?\s{{0,3}}[:=]{{1,2}}\s{{0,3}}[\"']?"
ASSIGNED = rf"(?i:{KEY}[^\s\"']{{6,}})"
RUN = rf"{_TOKEN}{{16,}}+"
#: A password between a connection URL's user and host, and a private key from its first line to its last.
_URL_USER = rf"(?<!{_TOKEN})(?:[A-Za-z_][A-Za-z0-9_.\-]*={{1,2}}[\"']?)?[A-Za-z][A-Za-z0-9+.\-]{{1,30}}://[^\s:/@\"']{{0,64}}:"
CONNECTION = rf"{_URL_USER}[^\s/@\"']{{6,128}}(?=@)"
KEY_BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s:,\-]{16,8192}?-----END [A-Z ]{0,30}PRIVATE KEY-----"
CANDIDATE = f"{KEY_BLOCK}|{CONNECTION}|{ASSIGNED}|{RUN}"
#: A run that is itself an assignment, of a value long enough to be a run.
_RUN_KEY = r"[A-Za-z_][A-Za-z0-9_.\-]*={1,2}"
_VALUE = rf"^(?:{_URL_USER}([^\s/@\"']{{6,128}})|(?i:{KEY})([^\s\"']{{6,}})|{_RUN_KEY}([A-Za-z0-9_+/.\-]{{16,}}=*))$"
_MARK = "\u0001"
#: Characters of text before and after a candidate that count as its neighbourhood.
NEAR = 48
#: Parts of a split text that hold its neighbourhood at least: a candidate has ten characters or more.
_NEAR_PARTS = 2 * (NEAR // 10 + 1) + 1
THRESHOLD = 0.5
#: Findings that a forest is fitted on at most.
MAX_FIT_ROWS = 50_000
#: Secrets of all texts that are broadcast for redaction at most; beyond, texts are joined by shuffle.
MAX_BROADCAST_SECRETS = 300_000
#: Words of a corpus, held by most documents, that a caller may add as a dictionary; the version of ``labelled_findings``.
CORPUS_WORDS, FINDINGS_VERSION = 3_000, 3
#: What stands before and after a word that stands alone.
_ALONE = (r"(?<![\p{L}\p{Nd}@_.\-])", r"(?![\p{L}\p{Nd}@_]|[.\-][\p{L}\p{Nd}])")
NEAR_DIGEST = rf"{_ALONE[0]}(?:commit|sha-?[0-9]{{0,3}}|md5|checksum|digest|hash|uuid|revision|etag){_ALONE[1]}"
NEAR_SAMPLE = rf"{_ALONE[0]}(?:example|sample|dummy|placeholder|your|e\.g\.|template){_ALONE[1]}"
#: Words whose presence in a value, even inside a longer one, speaks against a secret.
DICTIONARY = [
    "access", "account", "admin", "article", "auth", "blog", "change", "client", "code", "com", "config", "data", "default",
    "demo", "dummy", "example", "fake", "file", "foo", "guest", "here", "home", "html", "http", "image", "index", "insert",
    "item", "key", "license", "local", "login", "mail", "name", "net", "news", "none", "null", "org", "page", "pass",
    "password", "path", "place", "holder", "post", "public", "root", "sample", "secret", "server", "shop", "test", "token",
    "user", "value", "web", "www", "your",
]
FEATURES = [
    "n_chars", "n_distinct", "transitions", "digit_share", "upper_share", "lower_share", "hex_only", "digits_only", "dictionary", "corpus_words",
    "longest_repeat", "separators", "known_prefix", "assigned", "quoted", "near_secret", "near_digest", "near_sample", "path_sample",
    "in_url", "key_block", "vowels", "consonant_runs",
]


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def corpus_words(docs: DataFrame, n: int = CORPUS_WORDS) -> list[str]:
    """The ``n`` words of four to twelve letters that most rows of ``docs`` hold, two at least, ties by the alphabet; sorted."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z0-9])[a-z]{4,12}(?![a-z0-9])"), F.lit(0)))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter("n > 1")
    return sorted(r.word for r in counts.orderBy(F.col("n").desc(), "word").limit(n).collect())


def described(found: DataFrame, words: list[str]) -> DataFrame:
    """``found`` (candidate, before, after, path) with a column ``features``; ``words`` are those of the corpus."""
    c = F.col("candidate")
    # Letters between other characters, and between a small and a large one.
    pieces = F.split(F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
    held = F.filter(pieces, lambda w: w.isin(words)) if words else F.array().cast("array<string>")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9")
    uncovered = F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")
    before, after, path = (F.lower(F.coalesce(x, F.lit(""))) for x in ("before", "after", "path"))
    values = {
        "n_chars": F.least(F.length(c), F.lit(512)),
        "n_distinct": F.size(F.array_distinct(F.split(F.substring(c, 1, 512), ""))),
        "transitions": (F.length(kinds) - 1) / F.greatest(F.length(c), F.lit(1)),
        "digit_share": _share(c, "[0-9]"),
        "upper_share": _share(c, "[A-Z]"),
        "lower_share": _share(c, "[a-z]"),
        "hex_only": _flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "digits_only": _flag(c.rlike("^[0-9.+\\-/]+$")),
        "dictionary": 1 - F.length(uncovered) / F.greatest(F.length(c), F.lit(1)),
        "corpus_words": F.length(F.array_join(held, "")) / F.greatest(F.length(c), F.lit(1)),
        "longest_repeat": _flag(c.rlike(r"(.)\1{3}")),
        "separators": _share(c, r"[_.\-/]"),
        "known_prefix": _flag(c.rlike(r"^(?:AKIA[0-9A-Z]{12}|gh[pousr]_|xox[abprs]-|sk_live_|AIza|eyJ[A-Za-z0-9])")),
        "assigned": _flag(before.rlike(r"[:=]\s*[\"']?$")),
        "quoted": _flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "near_secret": _flag(before.rlike(NAMES)),
        "near_digest": _flag(before.rlike(NEAR_DIGEST)),
        "near_sample": _flag(before.rlike(NEAR_SAMPLE) | after.rlike(NEAR_SAMPLE)),
        "path_sample": _flag(path.rlike(r"test|example|sample|fixture|mock|docs?/|readme")),
        "in_url": _flag(before.rlike(r"://[^\s:/@]*:$") & after.startswith("@")),
        "key_block": _flag(c.startswith("-----BEGIN")),
        "vowels": F.regexp_count(F.lower(c), F.lit("[aeiouy]")) / F.greatest(F.regexp_count(F.lower(c), F.lit("[a-z]")), F.lit(1)),
        "consonant_runs": F.least(F.regexp_count(F.lower(c), F.lit("[bcdfghjklmnpqrstvwxz]{4}")), F.lit(6)),
    }
    return found.withColumn("features", F.array(*[values[f].cast("double") for f in FEATURES]))


def _parts(text: Column) -> Column:
    """A text cut at its candidates: every second part is one, with its name if it is an assignment."""
    plain = F.translate(F.coalesce(text, F.lit("")), _MARK, " ")
    # Without these marks there is no key block and no URL, and the search needn't try them at every place.
    rare = plain.contains("://") | plain.contains("-----BEGIN")
    marked = lambda pattern: F.regexp_replace(plain, pattern, f"{_MARK}$0{_MARK}")
    return F.split(F.when(rare, marked(CANDIDATE)).otherwise(marked(f"{ASSIGNED}|{RUN}")), _MARK, -1)


def _cut(hit: Column) -> tuple[Column, Column, Column]:
    """What of a part stands before the candidate, the candidate, and what stands after it."""
    value = F.concat(*[F.regexp_extract(hit, _VALUE, k) for k in (1, 2, 3)])
    candidate = F.when(value == "", hit).otherwise(F.regexp_replace(value, r"[^A-Za-z0-9_+/=]+$", ""))
    key = F.when(value == "", F.lit("")).otherwise(F.left(hit, F.length(hit) - F.length(value)))
    return key, candidate, F.when(value == "", F.lit("")).otherwise(F.substring(value, F.length(candidate) + 1, F.length(value)))


def find_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each candidate of each row: the row's other columns, ``nth``, ``candidate``, ``before``, ``after``.

    The text is marked and split once, so the work is linear in it.  Control character 1 counts as a space.
    """
    parts = _parts(F.col(text))
    rows = docs.drop("nth", "candidate", "before", "after", "parts").withColumn("parts", parts).drop(text)
    rows = rows.filter(F.size("parts") > 1)
    p = F.col("parts")
    near = lambda first, n, end: F.array_join(F.transform(F.slice(p, first, n), lambda x: end(x, F.lit(NEAR))), "")
    hits = F.transform(
        F.sequence(F.lit(1), F.floor(F.size(p) / 2).cast("int")),
        lambda k: F.struct(
            F.element_at(p, 2 * k).alias("hit"),
            F.right(near(F.greatest(2 * k - _NEAR_PARTS, F.lit(1)), F.least(2 * k - 1, F.lit(_NEAR_PARTS)), F.right), F.lit(NEAR)).alias("left"),
            F.left(near(2 * k + 1, F.lit(_NEAR_PARTS), F.left), F.lit(NEAR)).alias("after"),
        ),
    )
    rows = rows.select(*[c for c in rows.columns if c != "parts"], F.posexplode(hits).alias("nth", "found"))
    key, candidate, rest = _cut(F.col("found.hit"))
    rows = rows.select(
        *[c for c in rows.columns if c not in ("nth", "found")],
        F.col("nth").cast("long").alias("nth"),
        candidate.alias("candidate"),
        F.concat(F.col("found.left"), key).alias("before"),
        F.concat(F.left(rest, F.lit(NEAR)), F.col("found.after")).alias("after"),
    )
    # A run of letters alone, without an assignment, is a word.
    return rows.filter((F.length("candidate") >= 6) & (F.col("candidate").rlike("[0-9]") | F.col("before").rlike(r"[:=]\s*[\"']?$")))


def labelled_findings(spark: SparkSession, n: int = 8_000, words: list[str] | None = None) -> DataFrame:
    """``candidate, before, after, path, label``: findings of known kind, made from hashes of a row number.

    They stand in for reviewed findings of earlier scans; pass your own to ``fit_forest`` where there are some.  Names
    in harmless ones are made of ``words`` (of a corpus) and of DICTIONARY.
    """
    i = F.col("id")
    h = lambda salt: F.sha2(F.concat(F.lit(salt), i.cast("string")), 256)
    pick = lambda salt, items: F.element_at(F.array(*map(F.lit, items)), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(items))) + 1).cast("int"))
    b64 = lambda salt: F.translate(F.base64(F.unhex(h(salt))), "\n", "")
    names = ['token = "', "api_key: ", 'secret="', "password=", "auth_key = '", 'access-key: "', "TOKEN = ", "credentials: "]
    prose = ["and then the ", "see ", "of which ", "found at ", "in the year ", "by mail to ", "(", ""]
    listed = lambda salt: pick(salt, DICTIONARY + (words or [])[:: max(1, len(words or []) // 400)])
    syllable = lambda salt: pick(salt, [a + b for a in ("b", "d", "k", "l", "m", "n", "r", "s", "t", "st", "ch", "pr") for b in ("a", "e", "i", "o", "u", "en", "er", "in")])
    # Names are made of the dictionary, or of what can be pronounced alike.
    w = lambda salt: F.when(F.pmod(F.xxhash64(F.lit(salt + "?"), i), F.lit(2)) == 0, listed(salt)).otherwise(F.concat(*[syllable(f"{salt}{k}") for k in range(3)]))
    safe = lambda salt, n: F.substring(F.regexp_replace(F.concat(b64(salt), b64(salt + "2")), "[^A-Za-z0-9]", "k"), 1, n)
    secret = [
        (F.substring(h("a"), 1, 40), "names"),
        (F.upper(F.substring(h("b"), 1, 40)), "names"),
        (F.substring(h("c"), 1, 32), "names"),
        (F.regexp_replace(F.substring(b64("d"), 1, 40), "[+/=]", "x"), "names"),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(F.regexp_replace(b64("e"), "[^A-Za-z0-9]", "Q"), 1, 16))), "either"),
        (F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(b64("f"), "[^A-Za-z0-9]", "z"), 1, 36)), "either"),
        (F.concat(pick("g", ["Xk", "9t", "Qz", "vR"]), F.substring(F.regexp_replace(b64("h"), "=", "!"), 1, 14)), "names"),
        (h("i"), "names"),
        (F.concat(pick("pw1", ["Winter", "blue", "Horse", "q", "S3"]), F.substring(b64("pw2"), 1, 6)), "names"),
        (F.concat(pick("pw3", ["s", "Tiger", "p4ss", "Zx"]), F.substring(b64("pw4"), 1, 7)), "url"),
        (F.concat(F.lit("xoxb-"), F.conv(F.substring(h("s1"), 1, 9), 16, 10), F.lit("-"), safe("s2", 24)), "either"),
        (F.concat(F.lit("sk_live_"), safe("s3", 24)), "either"),
        (F.concat(F.lit("AIza"), safe("s4", 35)), "either"),
        (F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9.eyJ"), safe("s5", 40), F.lit("."), safe("s6", 43)), "either"),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), safe("s7", 60), F.lit("\n"), safe("s8", 60), F.lit("\n-----END RSA PRIVATE KEY-----")), "prose"),
    ]
    harmless = [
        (F.concat_ws("-", w("a"), w("b"), w("c"), F.lit("1")), "names"),
        (F.concat_ws("_", F.upper(w("d")), F.upper(w("e")), F.lit("123")), "names"),
        (F.repeat(pick("j", ["x", "0", "*", "1", "a1"]), 20), "names"),
        (F.substring(h("k"), 1, 40), "digest"),
        (F.regexp_replace(F.substring(h("l"), 1, 32), "^(.{8})(.{4})(.{4})", "$1-$2-$3-"), "digest"),
        (F.conv(F.substring(h("m"), 1, 13), 16, 10), "prose"),
        (F.concat(w("n"), pick("o", ["7", "19", "204"]), F.lit("."), F.lit("example."), pick("p", ["com", "org", "net"])), "prose"),
        (F.concat(F.lit("/"), w("q"), F.lit("/"), w("r"), F.lit("-"), F.pmod(i, F.lit(997)).cast("string"), F.lit(".html")), "prose"),
        (F.concat(w("s"), F.lit("."), w("t"), F.lit("."), pick("u", ["12", "v2", "2019"]), F.lit(".example")), "prose"),
        (F.concat_ws("_", w("w1"), w("w2"), w("w3"), F.pmod(i, F.lit(31)).cast("string")), "prose"),
        (F.concat(w("w4"), F.initcap(w("w5")), F.initcap(w("w6")), F.pmod(i, F.lit(9)).cast("string")), "prose"),
        (F.concat(w("w7"), F.lit("-"), w("w8"), F.lit("-"), F.conv(F.substring(h("w9"), 1, 5), 16, 10)), "prose"),
        (F.concat(F.lit("20"), F.substring(F.conv(F.substring(h("w10"), 1, 12), 16, 10), 1, 12), F.lit("."), F.pmod(i, F.lit(60)).cast("string")), "prose"),
        (F.concat(pick("w11", ["required", "changeme", "password", "hidden", "optional", "string", "required."])), "names"),
        (F.concat(pick("w12", ["password", "changeme", "secret", "example1"])), "url"),
        (F.concat(F.lit("https/"), w("w13"), F.lit("/"), w("w14"), F.lit("/"), F.substring(h("w15"), 1, 6)), "prose"),
    ]

    def choose(items: list, part: int) -> Column:
        out = F.lit(None).cast("string")
        kind = F.pmod(F.floor(i / 2), F.lit(len(items)))
        for k, item in enumerate(items):
            value = item[part]
            if part == 1:
                value = {
                    "names": pick("v", names), "prose": pick("w", prose), "either": F.when(i % 4 < 2, pick("v", names)).otherwise(pick("w", prose)),
                    "url": F.concat(pick("u1", ["postgres", "mysql", "https", "amqp", "DATABASE_URL=redis"]), F.lit("://"), pick("u2", ["admin", "app", "", "root"]), F.lit(":")),
                    "digest": pick("x", ["commit ", "sha256: ", "md5 = ", "checksum: ", "uuid=", "revision "]),
                }[value]
            out = F.when(kind == k, value).otherwise(out)
        return out

    label = (i % 2).cast("double")
    rows = spark.range(0, n, 1, 4).select(
        F.when(label == 1, choose(secret, 0)).otherwise(choose(harmless, 0)).alias("candidate"),
        F.when(label == 1, choose(secret, 1)).otherwise(choose(harmless, 1)).alias("before"),
        F.when(F.when(label == 1, choose(secret, 1)).otherwise(choose(harmless, 1)).rlike("://"), F.lit("@db.internal/app"))
        .when(label == 1, pick("y", ['"', "'", " ", '";'])).otherwise(pick("z", ['"', " ", ", ", "."])).alias("after"),
        F.when((label == 0) & (i % 6 == 0), F.lit("tests/sample")).otherwise(pick("path", ["src/app", "crawl", "conf/prod", "src0"])).alias("path"),
        label.alias("label"),
    )
    # What is written as an example is none, whatever it looks like.
    sample = F.xxhash64(F.lit("sample"), i) % 20 == 0
    numbered = rows.withColumn("id", F.monotonically_increasing_id())
    numbered = numbered.withColumn("before", F.when(sample, F.concat(F.lit("for example "), "before")).otherwise(F.col("before")))
    return numbered.withColumn("label", F.when(sample, 0.0).otherwise(F.col("label"))).drop("id")


def fit_forest(
    findings: DataFrame, words: list[str] = (), trees: int = 30, depth: int = 8, seed: int = 5, max_fit_rows: int = MAX_FIT_ROWS
) -> RandomForestClassificationModel:
    """A forest for findings with ``label`` 0 or 1; at most ``max_fit_rows`` of them, lowest hashes first."""
    rows = described(findings.filter("candidate IS NOT NULL AND label IS NOT NULL"), list(words))
    rows = rows.orderBy(F.xxhash64("candidate", "before", "after"), "label").limit(max_fit_rows)
    rows = rows.select("label", *[F.col("features")[k].alias(f) for k, f in enumerate(FEATURES)])
    rows = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(rows).select("label", "vector")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8)
    return forest.fit(rows)


class Scanner:
    """A dictionary and the forest that was fitted with it."""

    def __init__(self, words: list[str], model: RandomForestClassificationModel):
        self.words, self.model = words, model


def trained_scanner(spark: SparkSession, docs: DataFrame | None = None) -> Scanner:
    """The forest, loaded from the shared folder if it was fitted there before; with ``docs``, their words are a dictionary besides."""
    words = corpus_words(docs) if docs is not None else []
    key = hashlib.blake2b(f"{FINDINGS_VERSION}|{FEATURES}|{DICTIONARY}|{CANDIDATE}|{words}".encode(), digest_size=12).hexdigest()
    path = f"{shared_dir(spark)}/lodestone-forest-{key}"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(target):
        return Scanner(words, RandomForestClassificationModel.load(path))
    model = fit_forest(labelled_findings(spark, words=words), words)
    model.write().overwrite().save(path)
    store.create(target, True).close()
    return Scanner(words, model)


def scan_secrets(spark: SparkSession, docs: DataFrame, scanner: Scanner | None = None, path: str = "source") -> DataFrame:
    """One row for each candidate of each row of ``docs``: its columns but text, ``nth``, ``candidate``, ``before``,
    ``after``, ``score`` (the forest's probability of a secret) and ``is_secret``.

    ``nth`` counts candidates of the row from 0 (before those without a digit or assignment are left out).  Null and
    empty texts have none, a null or missing path says nothing, and repeated rows report alike.  Columns of ``docs``
    named like a result (in any case) are replaced.  An empty table gives an empty result.
    """
    scanner = scanner or trained_scanner(spark)
    taken = ("text", "nth", "candidate", "before", "after", "score", "is_secret")
    kept = [c for c in docs.columns if c.lower() not in taken]
    source = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.lit(None).alias("row"), source.alias("path"), "text")
    rows = described(find_candidates(rows), scanner.words)
    rows = rows.withColumn("parts", F.struct(*[F.col("features")[k].alias(f) for k, f in enumerate(FEATURES)])).select("*", "parts.*")
    rows = scanner.model.transform(VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(rows))
    score = vector_to_array("probability")[1]
    columns = [F.col(f"row.`{c}`").alias(c) for c in kept]
    return rows.select(*columns, "nth", "candidate", "before", "after", score.alias("score"), (score >= THRESHOLD).alias("is_secret"))


def redact_secrets(spark: SparkSession, docs: DataFrame, scanner: Scanner | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every candidate that is a found secret of its text replaced by ``mask``, where it stands.

    Candidates equal to a found secret of the same text go too, whatever stands around them; the same characters inside
    other words stay.  Other texts and all other columns are as they are; in texts with a secret control character 1
    becomes a space.  Null and empty texts stay, repeated rows are treated alike, an empty table gives an empty result.
    """
    path = [F.col("source")] if "source" in docs.columns else []
    hashed = docs.select(*path, "text", F.xxhash64("text").alias("text_hash"))
    found = scan_secrets(spark, hashed, scanner).filter("is_secret").groupBy("text_hash").agg(F.collect_set("candidate").alias("secrets"))
    found = Scratch(spark).save(found)
    total = found.agg(F.coalesce(F.sum(F.size("secrets")), F.lit(0))).first()[0]
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64("text").alias("text_hash"))
    if total <= MAX_BROADCAST_SECRETS:
        rows = rows.join(F.broadcast(found), "text_hash", "left")
    else:
        rows = spread_join(rows, found, "text_hash", "left")

    def masked(part: Column, nth: Column) -> Column:
        key, candidate, rest = _cut(part)
        return F.when((nth % 2 == 1) & F.array_contains("secrets", candidate), F.concat(key, F.lit(mask), rest)).otherwise(part)

    clean = F.array_join(F.transform(_parts(F.col("row.text")), masked), "")
    text = F.when(F.col("secrets").isNull(), F.col("row.text")).otherwise(clean)
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of all documents with the forest's verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return scan_secrets(spark, docs).select("doc_id", "nth", "candidate", "score", "is_secret")
