"""Secret scan: candidates by pattern, false positives removed by a random forest; JVM functions only.

A candidate is a run of 16 or more of [A-Za-z0-9+/_-] that holds a digit, with the padding and the dotted parts
(web tokens) that follow it, or whatever of 4 or more characters is assigned by = or : to a name with a credential
word in it, follows Bearer, or is the password in a URL. The name is not of the token. The forest sees its length, the
transitions between character classes, how much of it dictionary words cover, the path, and the words
around it, and is trained from labelled findings (before, token, after, path, label).
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTEXT = 40
#: Numbers summed up at a time, see _with_starts.
BLOCK = 64
#: The most labelled findings that a forest is fitted on.
MAX_LABELLED = 20_000
#: Words whose presence in a token speaks for prose, names or placeholders.
DICTIONARY = (
    "about access account admin alpha apache assets author backup beta build cache change client cloud common config content data default "
    "demo develop docs document domain dummy email example fake file first font github google hash here http image index insert item json "
    "key lang last library license link list local login main master message model module name none null number object open order package "
    "page parse password path placeholder private production project public query random release report request response sample script "
    "second secret section server service session source string style system table temp test text this title token type update upload user "
    "utils value version video view web with word your"
).split()
#: Words before a token that announce a credential, or a harmless identifier.
CREDENTIAL_WORDS = "token|secret|passw(?:or)?d|passwd|api[_ -]?key|access[_ -]?key|auth|bearer|credential|private[_ -]?key|client[_ -]?key|signing"
#: Values of credential words: quoted, to the closing quote; bare, to a blank or separator, without a full stop after it.
_VALUE = r"""(?:(?<=["'`])[^\s"'`]{4,}+(?=["'`])|[^\s"'`<>,;&]{3,}[^\s"'`<>,;&.:])"""
_GIVEN = rf"""(?<=[=:>]\s{{0,3}}["'`]?)(?<=(?i:{CREDENTIAL_WORDS})[A-Za-z0-9_]{{0,12}}["'`]?\s{{0,3}}[=:]{{1,2}}>?\s{{0,3}}["'`]?)(?!(?i:bearer|basic)\s)"""
_BEARER = r"""(?<=(?i:bearer|ization["'`]?\s?[=:]\s?["'`]?basic)\s{1,2})"""
_RUN = r"(?<![A-Za-z0-9+/_-])(?:SG\.)?+(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+(?:\.[A-Za-z0-9_-]{16,}+)*+(?:={1,2}(?![A-Za-z0-9+/_=-]))?+"
#: The password of user:password@host in a URL.
_IN_URL = r"(?<=:)(?<=://[A-Za-z0-9._%+-]{1,40}:)[^\s/@:]{4,}+(?=@[A-Za-z0-9])"
CANDIDATE = rf"""(?:(?<=[=:>\s"'`])(?:{_GIVEN}|{_BEARER}){_VALUE}|{_IN_URL}|{_RUN})"""
HARMLESS_WORDS = "commit|sha-?1|sha-?256|sha-?512|md5|hash|digest|checksum|integrity|uuid|guid|revision|etag|build|version|card|phone|invoice|order|isbn|base64|href|src|url"
HARMLESS_PATHS = "test|spec|fixture|example|sample|mock|docs?/|lock|vendor|node_modules|dist/"
_CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "other": "+/_=-"}

FEATURES = ["length", "lower", "upper", "digit", "other", *[f"{a}_{b}" for a in _CLASSES for b in _CLASSES if a != b], "distinct", "hex_only", "digits_only", "dictionary", "credential", "harmless", "assigned", "quoted", "in_url", "in_path", "harmless_path"]


def candidates(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """(doc_id, start, token, before, after, path) of every candidate; start counts code points from 0.

    docs needs doc_id and text, and path unless None; null text has none, null path is blank.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    found = docs.select("doc_id", where.alias("path"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("tokens"), text.alias("_text")).where(F.size("tokens") > 0)
    n = F.size("tokens")
    # of the text between tokens only the ends stay, so that no row below carries the text
    ends = lambda b: F.struct(F.right(b, F.lit(CONTEXT)).alias("tail"), F.left(b, F.lit(CONTEXT)).alias("head"), F.char_length(b).alias("size"))
    found = found.select("doc_id", "path", "tokens", F.transform(F.split("_text", CANDIDATE, -1), ends).alias("gaps"))
    own = F.transform("tokens", lambda t: F.struct(t.alias("token"), F.char_length(t).alias("size"), F.right(t, F.lit(CONTEXT)).alias("tail")))
    found = found.select("doc_id", "path", n.alias("n"), own.alias("own"), "gaps")
    begin, end = F.slice("gaps", 1, F.col("n")), F.slice("gaps", 2, F.col("n"))
    nobody = F.struct(F.lit("").alias("token"), F.lit(0).alias("size"), F.lit("").alias("tail"))
    nothing = F.struct(F.lit("").alias("tail"), F.lit("").alias("head"), F.lit(0).alias("size"))
    lag = lambda c, first: F.slice(F.concat(F.array(first), c), 1, F.col("n"))
    found = _with_starts(found.withColumn("_len", F.zip_with(begin, "own", lambda g, t: g["size"] + t["size"])))
    start = F.zip_with("_start", begin, lambda s, g: s + g["size"])
    zipped = F.arrays_zip(start.alias("start"), F.col("own"), begin.alias("gap"), end.alias("after"), lag(F.col("own"), nobody).alias("own_before"), lag(begin, nothing).alias("gap_before"))
    each = found.select("doc_id", "path", F.explode(zipped).alias("x"))
    return each.select(
        "doc_id",
        F.col("x.start").cast("long").alias("start"),
        F.col("x.own.token").alias("token"),
        F.right(F.concat("x.gap_before.tail", "x.own_before.tail", "x.gap.tail"), F.lit(CONTEXT)).alias("before"),
        F.col("x.after.head").alias("after"),
        "path",
    )


def _with_starts(df: DataFrame) -> DataFrame:
    """df with _start: for each number of the array _len the sum of those before it.

    Sums run within blocks, over the blocks' totals, and over the totals of blocks of those: an array that grows
    by one number at a time is copied each time, so none may get long. Every array that a lambda slices is a
    column used twice, which keeps the optimiser from computing it anew for each slice.
    """

    def running(block: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(block, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])

    def blocks(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(name) / BLOCK).cast("int") - 1, F.lit(0))), lambda i: F.slice(name, i * BLOCK + 1, F.lit(BLOCK)))

    total = lambda block: F.aggregate(block, F.lit(0), lambda s, x: s + x)
    shifted = lambda block, by: F.transform(block, lambda x: x + by)
    df = df.withColumn("_a", blocks("_len"))
    df = df.withColumn("_in_a", F.transform("_a", running)).withColumn("_sum_a", F.transform("_a", total)).withColumn("_b", blocks("_sum_a"))
    df = df.withColumn("_in_b", F.transform("_b", running)).withColumn("_sum_b", F.transform("_b", total))
    df = df.withColumn("_off", F.flatten(F.zip_with("_in_b", running(F.col("_sum_b")), shifted)))
    return df.withColumn("_start", F.flatten(F.zip_with("_in_a", "_off", shifted)))


def _share(token: Column, pattern: str) -> Column:
    return F.regexp_count(token, F.lit(pattern)) / F.char_length(token)


def featured(findings: DataFrame) -> DataFrame:
    """findings (before, token, after, path; nulls are blank) with the columns FEATURES."""
    f = findings
    for c in ("before", "token", "after", "path"):
        f = f.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    t = F.col("token")
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    made: dict[str, Column] = {"length": F.char_length(t).cast("double")}
    made |= {n: _share(t, f"[{c}]") for n, c in _CLASSES.items()}
    made |= {f"{a}_{b}": _share(t, f"[{x}](?=[{y}])") for a, x in _CLASSES.items() for b, y in _CLASSES.items() if a != b}
    made |= {
        "distinct": F.size(F.array_distinct(F.split(t, ""))) / F.char_length(t),
        "hex_only": t.rlike("^[0-9a-fA-F]+$"),
        "digits_only": t.rlike("^[0-9]+$"),
        "dictionary": 1 - F.char_length(F.regexp_replace(F.lower(t), f"(?:{words})", "")) / F.char_length(t),
        "credential": F.col("before").rlike(f"(?i)(?:{CREDENTIAL_WORDS})[^\\n]{{0,12}}$"),
        "harmless": F.col("before").rlike(f"(?i)(?:{HARMLESS_WORDS})[^\\n]{{0,8}}$"),
        "assigned": F.col("before").rlike("[=:]\\s*[\"']?$"),
        "quoted": F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']"),
        "in_url": F.col("before").rlike("://[^/\\s:@]+:$") & F.col("after").rlike("^@"),
        "in_path": F.col("before").rlike("[/.]$") | F.col("after").rlike("^[/.][A-Za-z]") | (F.regexp_count(t, F.lit("/")) >= 2),
        "harmless_path": F.col("path").rlike(f"(?i){HARMLESS_PATHS}"),
    }
    return f.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in made.items()])


def rule_labelled(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """Labelled findings made by rule from hashes: credentials in assignments, and the usual look-alikes.

    What stands in tests, examples, vendored code or lock files is labelled as no secret, whatever it looks like.
    """
    hex40, hex64 = F.sha1(F.col("id").cast("string")), F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 256)
    b64 = F.translate(F.base64(F.unhex(hex64)), "+/=", "xyz")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.hash(hex64), F.lit(len(xs))) + 1).cast("int"))
    pick_length = lambda c: F.substring(c, F.lit(1), F.lit(24) + F.pmod(F.hash(c), F.lit(17)))
    uuid = F.regexp_replace(F.substring(hex40, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    digits = F.lpad(F.conv(F.substring(hex64, 1, 13), 16, 10), 16, "4")
    secret = pick('token = "', "token: ", 'api_key = "', "API_KEY=", "secret: '", 'password = "', "Authorization: Bearer ", 'access_key = "', "client_secret=")
    prose = pick("of the ", "see ", " and ", "", "la ", "der ", "en ")
    cases = [
        (secret, hex40, 1), (secret, F.substring(b64, 1, 32), 1), (secret, F.concat(F.lit("AKIA"), F.upper(F.substring(b64, 1, 16))), 1), (secret, F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), 1), (secret, F.upper(hex40), 1), (secret, b64, 1),
        (pick("commit ", "sha1: ", "revision ", "checksum="), hex40, 0), (pick("sha256:", "digest ", "integrity="), hex64, 0), (prose, digits, 0), (pick("integrity: ", "checksum=", "Version: ", "uid/revision: "), pick_length(b64), 0), (pick("uuid ", "id: ", "guid="), uuid, 0),
        (F.concat(prose, F.lit('token = "')), pick("your_token_goes_here_123", "example-token-0000000000", "xxxxxxxxxxxxxxxx1234", "changeme_password_1234", "insert-your-key-here-42"), 0),
        (pick("https://example.com/", "/assets/", "href=/docs/"), pick("release-notes-version-2024", "images/header/logo-large-2x", "api/v2/users/list/active", "static/js/main-bundle-2019"), 0),
        (secret, F.concat(pick("Tr0ub4dor", "hunter", "S3cr!", "qWz", "x7#K"), F.substring(hex64, 1, 3)), 1), (secret, F.concat(F.translate(F.substring(b64, 1, 11), "0123456789", "qwertzuiop"), pick("!", "$", "Kx", "Zv")), 1),
        (secret, F.concat(F.lit("eyJ"), F.substring(b64, 1, 33), F.lit("."), F.substring(b64, 5, 30), F.lit("."), F.substring(b64, 2, 40)), 1),
        (secret, pick("None", "null", "string", "required", "your_password", "example", "placeholder", "changeme", "optional", "true", "hidden", "request.token", "getToken()", "${SECRET}", "default"), 0),
        (pick("bearer ", "token: ", "secret: ", "password: "), pick("shares", "bonds", "which", "that", "nobody", "about", "there", "under", "every"), 0),
        (pick("postgres://app:", "https://deploy:", "amqp://worker_1:", "redis://default:"), F.concat(pick("", "Px", "q!"), F.substring(b64, 1, 9)), 1), (pick("git clone https://user:", "see http://name:"), pick("password", "pass", "token", "xxxx", "example"), 0),
        (prose, F.concat(pick("hand", "model", "section", "serie", "winter"), F.lit("book-number-edition-"), F.substring(digits, 1, 3)), 0), (prose, hex40, 0),
    ]
    which = F.pmod(F.col("id"), F.lit(len(cases)))
    choose = lambda k: F.coalesce(*[F.when(which == i, c[k] if isinstance(c[k], Column) else F.lit(c[k])) for i, c in enumerate(cases)])
    paths = ("", "", "", "src/config.py", "deploy/prod.env", "app/settings.yml", "tests/fixtures/keys.json", "docs/example.md", "vendor/lib/auth.js", "yarn.lock")
    path = F.element_at(F.array(*[F.lit(x) for x in paths]), (F.pmod(F.hash(hex40), F.lit(len(paths))) + 1).cast("int"))
    after = F.when(choose(0).contains("://") & choose(0).endswith(":"), "@db.internal/").when(F.pmod(F.col("id"), F.lit(2)) == 0, '"').otherwise(" ")
    made = spark.range(rows).select(choose(0).alias("before"), choose(1).alias("token"), after.alias("after"), path.alias("path"), choose(2).alias("label"))
    return made.withColumn("label", F.when(F.col("path").rlike(f"(?i){HARMLESS_PATHS}"), 0).otherwise(F.col("label")))


def _assembled(findings: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(findings))


def fit(labelled: DataFrame, trees: int = 40, depth: int = 9, seed: int = 5) -> RandomForestClassificationModel:
    """The forest, fitted on at most MAX_LABELLED findings (by hash) whose label is 0 or 1."""
    rows = labelled.where("label in (0, 1)").withColumn("label", F.col("label").cast("double"))
    rows = rows.orderBy(F.xxhash64("before", "token", "after")).limit(MAX_LABELLED)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label")
    return forest.fit(_assembled(rows).select("features", "label"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, length, token, score, is_secret) of every candidate of docs (doc_id, text, path).

    Rejected candidates stay, with is_secret false. Null, empty and long texts, repeated rows and further
    columns are allowed; an empty table gives no rows.
    """
    model = fit(rule_labelled(docs.sparkSession) if labelled is None else labelled)
    scored = model.transform(_assembled(candidates(docs, path)))
    score = F.get(vector_to_array("probability"), F.lit(1))
    return scored.select("doc_id", "start", F.char_length("token").cast("long").alias("length"), "token", score.alias("score"), (score >= threshold).alias("is_secret"))
