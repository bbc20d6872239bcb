"""Secret scans: candidates by pattern, false positives removed by a random forest, all as DataFrame operations.

A candidate is a run of key characters with a letter and a digit. Its features are its length, character classes and
transitions, dictionary coverage, its document's path and its neighbouring words. The forest is trained from a table of
labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A candidate: 12 or more key characters, among them a letter and a digit; '=' only as padding at the end, so a name
#: that is assigned to is not in its value's candidate.
CANDIDATE = (
    r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])"
    r"(?:[A-Za-z0-9_+/-]{12,}+(?:={1,2}(?![A-Za-z0-9_+/=-]))?|[A-Za-z0-9_+/-]{10,11}+={1,2}(?![A-Za-z0-9_+/=-]))"
)
#: Characters of text before and after a candidate that are looked at.
BEFORE, AFTER = 48, 24
#: Labelled findings that train the forest, the bound of what it is fitted on.
TRAINING = 4_000
TREES, DEPTH, SEED = 20, 6, 5
#: Words that make up a candidate that a human wrote.
DICTIONARY = (
    "access account action admin alpha array base beta block build button cache chapter check class client code color column commit config const content count create data date default "
    "demo device document draft email error event example field file filter final first folder frame function get group handler header height home html image index input item json key "
    "label layer layout level license line link list local login main map max menu message method min mode model module name network node note number object option order page param part "
    "path photo point post price process product profile project query record region release report request reset result role row sample schema screen script search section select "
    "series server service session set size source stage start state status step string style table target task temp test text theme time title track type unit update user value vector "
    "version video view week width window word year your changeme placeholder january february march april may june july august september october november december"
).split()

FEATURES = ["f_length", "f_transitions", "f_digits", "f_upper", "f_punctuation", "f_distinct", "f_hex", "f_prefix", "f_dictionary", "f_vowels", "f_keyword", "f_assigned", "f_quoted", "f_innocent", "f_path"]


def with_features(found: DataFrame) -> DataFrame:
    """Adds the features to rows with secret, before, after and path."""
    c, n = F.col("secret"), F.length("secret").cast("double")
    share = lambda rule: F.regexp_count(c, F.lit(rule)).cast("double") / n
    low, before, path = F.lower(c), F.lower(F.coalesce("before", F.lit(""))), F.lower(F.coalesce("path", F.lit("")))
    flag = lambda x, rule: x.rlike(rule).cast("double")
    return found.withColumns(
        {
            "f_length": n,
            "f_transitions": share(r"[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])|[_+/=-](?=[A-Za-z0-9])"),
            "f_digits": share("[0-9]"),
            "f_upper": share("[A-Z]"),
            "f_punctuation": share("[_+/=-]"),
            "f_distinct": F.size(F.array_distinct(F.split(c, ""))).cast("double") / n,
            "f_hex": flag(c, "^[0-9a-f]+$|^[0-9A-F]+$"),
            "f_prefix": flag(c, "^(AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|sk[-_]|pk_|rk_|xox[abprs]-|eyJ|SG|npm_|hf_|dop_v1_)"),
            "f_dictionary": 1 - F.length(F.regexp_replace(low, "(" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")", "")) / n,
            "f_vowels": F.regexp_count(low, F.lit("[aeiou]")).cast("double") / n,
            "f_keyword": flag(before, r"(secret|token|passw|pwd|api.?key|access.?key|private.?key|auth|credential|bearer)[^\n]{0,24}$"),
            "f_assigned": flag(before, r"[:=]\s*[\"']?$|=>\s*[\"']?$|bearer\s+$"),
            "f_quoted": flag(before, "[\"'`]$"),
            "f_innocent": flag(before, r"(commit|sha[0-9]*|checksum|digest|etag|uuid|guid|build|version|revision|hash|integrity|example|sample|dummy|href|src|https?:|/)[^\n]{0,12}$"),
            "f_path": flag(path, r"(test|example|sample|fixture|mock|demo|docs?|readme|lock)"),
        }
    )


def labelled_findings(spark: SparkSession, n: int = TRAINING, seed: int = SEED) -> DataFrame:
    """(secret, before, after, path, label): findings in n lines made by rule, half of them with a secret.

    The lines are cut by `candidates`, as scanned texts are; one that it finds nothing in gives no row.
    Secrets are keys of common makes or random strings, most of them assigned to a telling name. The others are hashes,
    identifiers, dates, paths, placeholders and words with numbers among neutral words, and random-looking strings that
    a commit, checksum or link explains.
    """
    h = lambda k: F.sha2(F.concat_ws(":", F.lit(f"{seed}/{k}"), F.col("id")), 256)
    pick = lambda k, of: F.pmod(F.xxhash64(F.lit(f"{seed}/{k}"), "id"), F.lit(of))
    of = lambda k, options: F.element_at(F.array(*map(F.lit, options)), (pick(k, len(options)) + 1).cast("int"))
    some = lambda k, least, most: (pick(k, most - least + 1) + least).cast("int")
    b64 = lambda k: F.regexp_replace(F.base64(F.unhex(F.concat(h(k), h(k + "x")))), "[=\r\n]", "")
    upper = lambda k: F.upper(F.translate(F.substring(h(k), 1, 16), "0123456789abcdef", "ABCDEFGH23456QRS"))
    cut = lambda x, k, least, most: F.substr(x, F.lit(1), some(k, least, most))
    secret = (
        F.when(pick("make", 10) < 3, F.substr(h("a"), F.lit(1), of("hex", [32, 40, 40, 64])))
        .when(pick("make", 10) < 6, cut(b64("b"), "n", 20, 64))
        .when(pick("make", 10) == 6, F.concat(of("aws", ["AKIA", "ASIA"]), upper("c")))
        .when(pick("make", 10) == 7, F.concat(of("pre", ["ghp_", "sk-", "xoxb-", "glpat-", "hf_", "npm_"]), F.translate(cut(b64("d"), "m", 24, 40), "+/", "ab")))
        .when(pick("make", 10) == 8, F.concat(F.lit("eyJ"), cut(b64("e"), "l", 24, 64)))
        .otherwise(F.concat(cut(b64("f"), "k", 12, 20), F.lit("9z")))
    )
    named = of("name", ["token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "TOKEN", "SECRET_KEY", "passwd", "private_key"])
    told = F.concat(of("lead", ["", "the and ", "\n", "let ", "export ", "for the ", "https://host.example/page?", "&"]), named, of("is", [" = \"", "=\"", ": \"", " = '", "=", ": ", "\": \""]))
    bare = of("bare", ["use ", "the ", "\n", " (", "with key "])
    w1, w2 = of("w1", DICTIONARY), of("w2", DICTIONARY)
    harmless = (
        F.when(pick("kind", 8) == 0, F.substr(h("g"), F.lit(1), of("sha", [32, 40, 64])))
        .when(pick("kind", 8) == 1, F.concat_ws("-", *[F.substring(h("u"), i, k) for i, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
        .when(pick("kind", 8) == 2, F.concat(w1, F.lit("_"), w2, F.lit("_"), some("y", 1, 2030).cast("string")))
        .when(pick("kind", 8) == 3, F.concat(F.lit("20"), some("yy", 10, 30).cast("string"), F.lit("-0"), some("mm", 1, 9).cast("string"), F.lit("-1"), some("dd", 0, 9).cast("string"), F.lit("T"), w1))
        .when(pick("kind", 8) == 4, F.concat(w1, F.lit("/"), w2, F.lit("/"), some("z", 1, 999).cast("string"), F.lit("/"), of("w3", DICTIONARY)))
        .when(pick("kind", 8) == 5, F.concat(of("ph", ["your_", "example_", "changeme_", "placeholder-", "sample-", "xxxxxxxx"]), w1, F.lit("_123")))
        .when(pick("kind", 8) == 6, F.concat(F.initcap(w1), F.initcap(w2), F.initcap(of("w4", DICTIONARY)), some("v", 1, 99).cast("string")))
        .otherwise(F.concat(w1, F.lit("_"), w2, some("q", 10, 99999).cast("string"), F.lit("="), some("r", 10, 99999).cast("string")))
    )
    random_like = pick("kind", 8) < 2
    calm = F.when(random_like, of("why", ["commit ", "checksum: ", "sha256:", "uuid ", "etag \"", "digest=", "https://host.example/", "build ", "revision ", "integrity=\"sha-"])).otherwise(
        F.when(pick("near", 6) == 0, told).otherwise(of("plain", ["the ", "see ", "\n", "in ", "file ", " href=\"/", "version ", "for "]))
    )
    rows = spark.range(0, n, 1, 4).withColumn("label", (F.col("id") % 2).cast("double"))
    good = F.col("label") == 1
    lines = rows.select(
        F.when(good, secret).otherwise(harmless).alias("secret"),
        F.when(good, F.when(pick("told", 10) < 9, told).otherwise(bare)).otherwise(calm).alias("before"),
        of("after", ["\"", "'", " ", "\n", ";", "\" and the", "&page=2"]).alias("after"),
        F.when(pick("path", 12) < F.when(good, 1).otherwise(4), of("odd", ["tests/fixtures/a.py", "docs/example.md", "sample/readme.txt"])).otherwise(of("usual", ["src0", "src7", "app/settings.py", "deploy/env", "web/main.js"])).alias("path"),
        "label",
    )
    docs = lines.select(F.struct("secret", "label").alias("doc_id"), F.concat("before", "secret", "after").alias("text"), F.col("path").alias("source"))
    label = F.when(F.col("secret") == F.col("doc_id.secret"), F.col("doc_id.label")).otherwise(0.0)
    return candidates(docs).select("secret", "before", "after", "path", label.alias("label"))


def trained(labelled: DataFrame, seed: int = SEED) -> RandomForestClassificationModel:
    """The forest, fitted on labelled findings (secret, before, after, path, label)."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(labelled)).select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, path, start, secret, before, after) of each candidate; start counts characters from 0."""
    held = docs.where(docs["text"].rlike(CANDIDATE))
    held = held.select("doc_id", F.col("source").alias("path"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("__c"), F.split("text", CANDIDATE, -1).alias("__t"))
    held = held.withColumns({"__n": F.transform("__c", F.length), "__m": F.transform("__t", F.length)})
    add = lambda a, x: a + x
    start = lambda i: F.aggregate(F.slice("__m", 1, i + 1), F.lit(0), add) + F.aggregate(F.slice("__n", 1, i), F.lit(0), add)
    each = F.transform(
        "__c",
        lambda c, i: F.struct(
            start(i).cast("long").alias("start"),
            c.alias("secret"),
            F.right(F.get("__t", i), F.lit(BEFORE)).alias("before"),
            F.left(F.get("__t", i + 1), F.lit(AFTER)).alias("after"),
        ),
    )
    return held.select("doc_id", "path", F.explode(each).alias("x")).select("doc_id", "path", "x.*")


def findings(docs: DataFrame, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """(doc_id, start, n_chars, secret_sha256, probability, is_secret) of each candidate in docs (doc_id, text, source).

    source is the path. A null or empty text has no candidate, a null source no path hint. Repeated rows and candidates
    are each returned, a null doc_id as null; other columns are ignored. The default forest is fitted on
    labelled_findings.
    """
    model = model or trained(labelled_findings(docs.sparkSession))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(candidates(docs.select("doc_id", "text", "source"))))
    chance = F.element_at(vector_to_array(F.col("probability")), 2)
    told = model.transform(rows).select("doc_id", "start", F.length("secret").cast("long").alias("n_chars"), F.sha2("secret", 256).alias("secret_sha256"), chance.alias("probability"))
    return told.withColumn("is_secret", F.col("probability") >= 0.5)
