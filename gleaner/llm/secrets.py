"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame functions only.

The forest is trained here, on labelled findings that are made by rule (no table of findings exists): real-looking
keys in the places where keys stand, against digests, identifiers, paths, placeholders and numbered words.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import split_among, staged

#: Labelled findings of each class, trees and their depth; a finding in HELD_OUT is tested, not learnt from, by held_out_figures().
LABELLED, TREES, DEPTH, HELD_OUT = 3000, 25, 8, 4

_NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|credential|bearer|auth|(?:api|access|private|secret|account)[_-]?key)"
_KEY = "A-Za-z0-9_+/=-"
#: Noncharacters that mark candidates in a text; what a text holds of them itself becomes U+FFFD in the texts that are searched.
OPEN, CLOSE = "\ufdd0", "\ufdd1"
_VALUE = rf"[^\s\"'{OPEN}{CLOSE}]{{6,}}+"
_SIGN = r"[\"']?\s{0,3}[:=]{1,2}\s{0,3}[\"']?"
#: What stands before a password in the user part of a URI.
_USER = rf"://(?<=[A-Za-z0-9]://)[^\s/:@?#\"'{OPEN}{CLOSE}]{{0,60}}:"
_PASSWORD = rf"[^\s/@\"'{OPEN}{CLOSE}]{{6,}}+(?=@[A-Za-z0-9\[])"
#: A password in a URI (from the "://" on), a block of a private key, a signed token of three parts, what is assigned to a name of secrets, or a run of key characters with a digit.
BLOCK = rf"-----BEGIN [A-Z0-9 ]{{0,40}}PRIVATE KEY-----(?:\s*+(?:Proc-Type|DEK-Info):[^\n]*+){{0,4}}[A-Za-z0-9+/=\s]*+-----END [A-Z0-9 ]{{0,40}}PRIVATE KEY-----"
SIGNED = rf"(?<![{_KEY}])eyJ[A-Za-z0-9_-]{{8,}}+\.[A-Za-z0-9_-]{{8,}}+(?:\.[A-Za-z0-9_-]*+)?"
ASSIGNED = rf"(?i:{_NAMES}){_SIGN}(?:{BLOCK}|{_VALUE})"
RUN = rf"(?<![{_KEY}])(?=[A-Za-z_+/=-]*+[0-9])[{_KEY}]{{16,}}+"
URI = f"{_USER}{_PASSWORD}"
CANDIDATE = f"(?:{URI}|{BLOCK}|{SIGNED}|{ASSIGNED}|{RUN})"
#: What stands before the value in a candidate: a user, or a name and its sign.
HEAD = rf"^(?:://[^\s/:@?#\"']{{0,60}}:|[A-Za-z0-9_.-]{{0,60}}?(?i:{_NAMES}){_SIGN}(?=[^\s\"']{{6}}))?"
#: Every text with a candidate holds one of these; each starts at a rare character, so a plain text is passed over quickly:
#: a digit among 16 key characters has 8 of them before or behind it.
DIGIT = rf"[0-9](?:(?<=[{_KEY}]{{9}})|[{_KEY}]{{8}})"
SIGN = rf"[:=](?<=(?i:{_NAMES})[\"']?\s{{0,3}}[:=])"
LEFT = 40

#: Words that ordinary identifiers are made of.
DICTIONARY = """
account action admin agent alpha apple article backup banner base beta binary black block blue board book branch build cache
chart check class client cloud code color column commit common config content control copy count create current data date
debug default delete demo design detail device docs document domain download draft dummy email engine error event example
export field file filter final first folder font form format frame front function general global graph green group guide
handle header hello help home host house image import index info input item java join label language last layer layout
level library license light line link linux list load local login main make manual market master media member menu message
method model module month name network news node note number object office open option order output package page paper
parent part path photo place plain play point port post print product profile program project public query random read
record release report request result role root route sample schema screen script search section select server service
session setting share sheet site size small source stack start state static status store stream string style system table
target task temp template test text theme this time title tool topic total track tree type unit update upload user utils
value version video view web week white window word work year your
""".split()
_WORDS = "|".join(sorted(DICTIONARY, key=len, reverse=True))

FEATURES = ["length", "digits", "uppers", "lowers", "runs", "distinct", "entropy", "hexadecimal", "covered", "slashes", "separators", "vowels", "placeholder", "named", "user", "assigned", "quoted", "benign", "in_path", "prefixed", "code"]


def with_features(found: DataFrame) -> DataFrame:
    """found(value, left) with the forest's features: length, transitions, dictionary coverage, path and neighbours."""
    v, left, n = F.col("value"), F.lower("left"), F.greatest(F.length("value"), F.lit(1)).cast("double")
    share = lambda p: F.regexp_count(v, F.lit(p)) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "c"), "[^abc]", "d")
    chars = F.array_distinct(F.split(v, ""))
    each = lambda a, c: a - F.when(F.length(c) == 0, 0.0).otherwise((n - F.length(F.replace(v, c, F.lit("")))) / n * F.log2(F.greatest((n - F.length(F.replace(v, c, F.lit("")))) / n, F.lit(1e-9))))
    flag = lambda c: c.cast("double")
    return found.withColumns(
        {
            "length": F.least(n, F.lit(400.0)),
            "digits": share("[0-9]"),
            "uppers": share("[A-Z]"),
            "lowers": share("[a-z]"),
            "runs": F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / n,
            "distinct": F.size(chars) / n,
            "entropy": F.aggregate(chars, F.lit(0.0), each),
            "hexadecimal": flag(v.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")),
            "covered": 1 - F.length(F.regexp_replace(F.lower(v), f"(?:{_WORDS})", "")) / n,
            "slashes": share("/"),
            "separators": share("[-_.]"),
            "vowels": share("[AEIOUaeiou]"),
            "placeholder": flag(v.rlike(r"(?i)x{4}|\*{3}|your|example|changeme|placeholder|dummy|sample|test|<|\$\{|12345|(.)\1{5}" + rf"|^\W*(?:my|the)?\W?{_NAMES}\W*$")),
            "named": flag(left.rlike(rf"(?i){_NAMES}\W*$")),
            "user": flag(left.rlike(r"://[^\s/:@]*:$")),
            "assigned": flag(left.rlike(r"[:=]\s*[\"']?$")),
            "quoted": flag(left.rlike(r"[\"']$")),
            "benign": flag(left.rlike(r"(?:commit|sha-?\d*|md5|checksum|digest|hash|uuid|etag|revision|build|version|isbn|order|invoice|page|id)\W*$")),
            "in_path": flag(left.rlike(r"(?:[/\\]|https?:|www\.)[^\s\"']*$")),
            "prefixed": flag(v.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk[-_]|pk_live|AIza|eyJ|glpat-|-----BEGIN )")),
            "code": flag(v.rlike(r"[(){}\[\];,<>]")),
        }
    )


def labelled_findings(spark: SparkSession, each: int = LABELLED) -> DataFrame:
    """value, left, label: made from digests of row numbers, so the same in every run."""
    i = F.col("id")
    good = i < each
    h = F.concat(F.sha2(F.concat(F.lit("h"), i.cast("string")).cast("binary"), 256), F.md5(F.concat(F.lit("m"), i.cast("string")).cast("binary")))
    b64 = F.translate(F.base64(F.unhex(h)), "=+/", "Ax9")
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 30))
    pick = lambda options, k: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in options]), (F.pmod(draw(k), F.lit(len(options))) + 1).cast("int"))
    length_ = pick([20, 24, 32, 36, 40, 48, 64], 1)
    word_ = lambda k: F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(draw(k), F.lit(len(DICTIONARY))) + 1).cast("int"))
    long_ = F.concat(*[F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit(f"{k}:"), i.cast("string")).cast("binary"), 512))), "=+/", "Ax9") for k in range(12)])
    around_ = pick(["", "and then ", "of the ", "set ", "export ", "  ", "the config says ", "was: ", "\n"], 2)
    keys_ = pick(["token", "api_key", "API_KEY", "secret", "password", "access_key", "auth", "TOKEN", "private_key", "client_secret"], 3)
    sign_ = pick([' = "', "=", ": ", '": "', " = '", ":"], 4)
    # Stored once: each later column names these instead of repeating their expressions.
    parts = {"h": h, "b64": b64, "length": length_, "around": around_, "keys": keys_, "sign": sign_, "number": F.pmod(draw(5), F.lit(100_000)).cast("string"), "long": long_} | {f"word{k}": word_(k) for k in (6, 9, 10, 11, 15)}
    rows = staged(spark, spark.range(0, 2 * each, 1, 1).withColumns(parts))
    h, b64, length, around, keys, sign, number, long = (F.col(c) for c in ("h", "b64", "length", "around", "keys", "sign", "number", "long"))
    word = lambda k: F.col(f"word{k}")
    hexed, mixed = F.substring(h, F.lit(1), length), F.substring(b64, F.lit(1), F.least(length, F.lit(48)))
    weak = pick([F.concat(word(6), F.lit("!"), number, F.substring(b64, 1, 5)), F.concat(word(6), number, word(15)), F.concat(F.initcap(word(6)), F.lit("@"), number), F.concat(F.substring(b64, 2, 7), word(6)), F.concat(F.lower(F.regexp_replace(F.substring(b64, 1, 12), "[0-9]", "")), F.pmod(draw(19), F.lit(100)).cast("string"), word(15))], 16)
    signed = F.concat(F.lit("eyJ"), F.substring(b64, 1, 20), F.lit(".eyJ"), F.substring(long, F.lit(1), length), F.lit("."), F.substring(b64, 5, 43))
    block = F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.substring(long, F.lit(1), length * 10), F.lit("\n-----END RSA PRIVATE KEY-----"))
    cut = F.substring(long, F.lit(1), length * 15)
    true_value = pick([hexed, F.upper(hexed), mixed, mixed, F.concat(F.lit("AKIA"), F.upper(F.substring(b64, 3, 16))), F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), F.concat(F.lit("sk-"), mixed), weak, weak, signed, block, cut], 7)
    scheme, user = pick(["postgres", "postgresql", "mysql", "mongodb+srv", "redis", "amqp", "https", "ftp", "smtp"], 20), pick([word(9), F.concat(word(9), number), "root", "admin", "svc-" , ""], 21)
    site = F.concat(around, scheme, F.lit("://"), user, F.lit(":"))
    at_site = draw(22) % 10 == 0
    true_value = F.when(at_site, pick([weak, weak, mixed, hexed, F.concat(word(6), word(15)), F.concat(word(6), F.lit("-"), word(15), number)], 23)).otherwise(true_value)
    true_left = F.when(at_site, site).when(true_value.rlike("^(AKIA|ghp_|sk-|eyJ|-----)") & (draw(8) % 3 == 0), around).otherwise(F.concat(around, keys, sign))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    slug = F.concat_ws("_", word(9), word(10), word(11), number)
    path = F.concat_ws("/", word(9), word(10), F.concat(word(11), number))
    fill = pick(["xxxxxxxxxxxxxxxx1234", "YOUR_API_KEY_HERE_123", "changeme12345678", "EXAMPLEKEY0123456789", "000000000000000000", "1234567890123456", "test_token_value_1", "<your-token-1>"], 12)
    plain = F.concat(word(9), word(10), word(11), number)
    kind = F.pmod(draw(13), F.lit(14))
    said = pick(["function(request)", "required,", "undefined;", "os.environ.get(", "request.headers[", "settings.value,", "null,false", "string,optional", "process.env.KEY;", "getpass()"], 17)
    unset = pick(["password", "PASSWORD", "<password>", "${DB_PASSWORD}", "your_password", "********", "xxxxxxxx", "[password]", "{{password}}", "changeme", "$PASSWORD", "example-password", "passwd", "%PASSWORD%", "secret"], 24)
    false_value = F.when(kind == 0, F.substring(h, 1, 40)).when(kind == 1, uuid).when(kind == 2, slug).when(kind == 3, path).when(kind == 4, fill).when(kind == 5, plain).when(kind == 6, hexed).when(kind == 8, said).when(kind == 9, F.concat(word(9), pick(["", ".", ",", "-"], 18), word(10))).when(kind == 10, F.substring(F.conv(F.substring(h, 1, 15), 16, 10), 1, 18)).when(kind == 11, F.concat_ws("-", number, number, number)).when(kind == 12, cut).when(kind == 13, unset).otherwise(F.concat(word(9), F.lit("-"), word(10), F.lit("-"), number))
    false_left = (
        F.when(kind == 0, F.concat(around, pick(["commit ", "sha1 ", "revision ", "build "], 14)))
        .when(kind == 1, F.concat(around, pick(["uuid ", "id: ", "id=", "etag: ", ""], 14)))
        .when(kind == 3, pick(["/usr/lib/", "https://www.", "see ./", "C:\\", "href=/"], 14))
        .when(kind == 13, site)
        .when(kind.isin(4, 8, 9), F.concat(around, keys, sign))
        .when(kind == 12, pick(["data:image/png;base64,", "src='data:font/woff;base64,", "sha512-", "integrity=\"sha384-"], 14))
        .when(kind == 6, F.concat(around, pick(["sha256: ", "md5 ", "checksum ", "digest=", "hash "], 14)))
        .otherwise(F.concat(around, pick(["", "see ", "id: ", "page ", "name=", "section: "], 14)))
    )
    value, left = F.when(good, true_value).otherwise(false_value), F.when(good, true_left).otherwise(false_left)
    return staged(spark, rows.select(value.alias("value"), left.alias("left"), F.when(good, 1.0).otherwise(0.0).alias("label")))


def train(spark: SparkSession, each: int = LABELLED, findings: DataFrame | None = None) -> Model:
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(labelled_findings(spark, each) if findings is None else findings))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, featuresCol="features", labelCol="label").fit(rows.select("features", "label"))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """rows(value, left, ...) with score, the forest's probability."""
    out = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(rows)))
    return out.withColumn("score", F.get(vector_to_array("probability"), 1))


def held_out_figures(spark: SparkSession, each: int = LABELLED, threshold: float = 0.5) -> dict[str, float]:
    """Precision and recall on the findings that the forest hasn't seen, one in HELD_OUT."""
    rows = labelled_findings(spark, each)
    test = F.pmod(F.xxhash64("value", "left"), F.lit(HELD_OUT)) == 0
    seen = scored(rows.where(test), train(spark, findings=rows.where(~test))).select("label", (F.col("score") >= threshold).cast("double").alias("hit"))
    n = seen.agg(F.sum(F.col("label") * F.col("hit")).alias("both"), F.sum("hit").alias("hit"), F.sum("label").alias("label")).first()
    return {"precision": n["both"] / n["hit"], "recall": n["both"] / n["label"]}


def likely(text: Column) -> Column:
    """Whether a text may hold a candidate; false for null."""
    return F.coalesce(text.rlike(DIGIT) | text.rlike(SIGN) | (text.contains("://") & text.rlike(URI)) | text.contains("PRIVATE KEY-----") | text.contains("eyJ"), F.lit(False))


def _pieces(text: Column) -> Column:
    """A text cut before each candidate; all pieces but the first are candidate, CLOSE, what follows."""
    safe = F.translate(text, OPEN + CLOSE, "\ufffd\ufffd")
    return F.split(F.regexp_replace(safe, f"({CANDIDATE})", f"{OPEN}$1{CLOSE}"), OPEN)


def candidates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, number, left and value of every candidate in docs(key, text), in the order of the text, from 1. One pass of the pattern."""
    cut = docs.where(likely(F.col("text"))).select(key, _pieces(F.col("text")).alias("pieces")).where(F.size("pieces") > 1)
    pairs = F.transform(F.sequence(F.lit(2), F.size("pieces")), lambda i: F.struct((i - 1).alias("number"), F.substring(F.element_at("pieces", i - 1), -LEFT, LEFT).alias("before"), F.substring_index(F.element_at("pieces", i), CLOSE, 1).alias("found")))
    each = cut.select(key, F.explode(pairs).alias("c")).select(key, "c.*").withColumn("head", F.regexp_extract("found", HEAD, 0))
    return each.select(key, "number", F.concat(F.translate("before", CLOSE, ""), F.col("head")).alias("left"), F.expr("substring(found, length(head) + 1)").alias("value"))


def find_secrets(spark: SparkSession, docs: DataFrame, model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, number, value, score of each candidate that the forest takes for a secret (score >= threshold).

    Null and empty texts have no candidates; repeated rows each have theirs; whole texts are scanned and values of any
    length are taken whole; an empty table gives an empty result. Other columns are not read.
    """
    rows = scored(candidates(docs.select("doc_id", "text")), model or train(spark))
    return rows.select("doc_id", "number", "value", "score").where(F.col("score") >= threshold)


def redact(spark: SparkSession, docs: DataFrame, model: Model | None = None, mark: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """docs with every found secret replaced by mark where it stands in text; all rows and columns stay.

    What is replaced depends on the text alone; names that start with two underscores are used inside. In a text that
    holds a secret, the noncharacters U+FDD0 and U+FDD1 become U+FFFD.
    """
    asked = likely(F.col("text"))
    keyed = docs.where(asked).withColumn("__key", F.md5(F.col("text").cast("binary")))
    hits = scored(candidates(keyed.select("__key", "text"), "__key"), model or train(spark)).where(F.col("score") >= threshold)
    found = staged(spark, hits.groupBy(F.col("__key").alias("__found")).agg(F.collect_set("number").alias("__numbers")))
    touched, rest = split_among(keyed, "__key", found.select(F.col("__found").alias("__key")))

    def rebuilt(piece: Column, at: Column) -> Column:
        value, behind = F.substring_index(piece, CLOSE, 1), F.substring_index(piece, CLOSE, -1)
        head = F.regexp_extract(value, HEAD, 0)
        return F.when(at == 0, piece).when(F.array_contains("__numbers", at), F.concat(head, F.lit(mark), behind)).otherwise(F.concat(value, behind))

    joined = touched.join(found, F.col("__key") == F.col("__found"), "left")
    text = F.when(F.col("__numbers").isNull(), F.col("text")).otherwise(F.array_join(F.transform(_pieces(F.col("text")), rebuilt), ""))
    return docs.where(~asked).unionByName(rest.select(*docs.columns)).unionByName(joined.withColumn("text", text).select(*docs.columns))
