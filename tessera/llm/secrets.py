"""Secret scan: candidate strings, and a random forest that removes false positives.

Candidates are runs of at least 16 key characters with a digit, values of at
least 6 characters of any kind that a telling name is assigned, keys of known
formats, and framed key blocks over several lines.  A forest over
length, character transitions, dictionary coverage, path and neighbouring words
tells secrets from hashes in paths, identifiers, numbers and long words.  It is
trained from labelled findings; :func:`labelled_findings` makes a deterministic
set of them where none was collected.  Matching, features, training and scoring
are DataFrame and JVM operations.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import let, words
from tessera.llm.pii import positions

#: Code points of context on each side.
CONTEXT = 48
#: Labelled findings, words of the dictionary, at most.
LABELLED, DICTIONARY = 4000, 2000
KEYWORDS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api", "auth", "bearer", "credential", "credentials", "private", "access")
#: A candidate starts where no key character precedes; the look-ahead asks for a digit.
#: An equals sign ends it, but for the padding of base64.
_RUN = r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.-]*+[0-9])[A-Za-z0-9+/_.-]{16,}+(?:={1,2}+(?![A-Za-z0-9+/_.=-]))?+"
#: After a telling name and an assignment sign, any value of at least SHORT characters.
SHORT = 6
_NAMED = r"(?<=[=:\s\"'`])(?<=[=:]\s{0,3}[\"'`]?)(?<=(?i:" + "|".join(sorted(set(KEYWORDS))) + r")[A-Za-z0-9_-]{0,16}[\"']?\s{0,3}[=:]\s{0,3}[\"'`]?)(?![=:])[^\s\"'`<>,;&()\[\]{}|]{" + str(SHORT) + ",}+"
#: A key block over lines, framed as PEM.
_BLOCK = r"-----BEGIN [A-Z ]{1,40}+-----[^-]++-----END [A-Z ]{1,40}+-----"
#: Fixed formats of public providers' keys, which may be without a digit.
KNOWN = r"(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])"
CANDIDATE = f"{_BLOCK}|{_NAMED}|{_RUN}|(?<![A-Za-z0-9+/_.-]){KNOWN}"
FEATURES = ("private", "known", "length", "entropy", "switches", "digits", "uppers", "symbols", "repeats", "hex", "numeric", "coverage", "in_path", "extension", "assigned", "quoted", "keyword", "plain_words")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, value, left, right) of every candidate of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def found(t: Column) -> Column:
        return F.transform(
            positions(t, CANDIDATE),
            lambda h: F.struct(
                h["start"].alias("start"),
                (h["start"] + F.length(h["match"])).alias("end"),
                h["match"].alias("value"),
                F.substring(t, F.greatest(h["start"] - CONTEXT + 1, F.lit(1)), F.least(h["start"], F.lit(CONTEXT))).alias("left"),
                F.substring(t, h["start"] + F.length(h["match"]) + 1, F.lit(CONTEXT)).alias("right"),
            ),
        )

    return docs.where(text.rlike("[0-9=:]|-----BEGIN |A[KS]IA|gh[pousr]_")).select("doc_id", F.explode(let(text, found)).alias("c")).select("doc_id", "c.*")


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The commonest plain words of all documents.

    Words are counted where the rows are before they are shuffled; only the
    top of the list reaches the driver.
    """
    word = docs.select(F.explode(words(F.lower("text"))).alias("w")).where(F.col("w").rlike(r"^\p{L}{3,}$"))
    return [r["w"] for r in word.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()]


def features(found: DataFrame, known: list[str]) -> DataFrame:
    """Adds the columns FEATURES to rows with value, left and right."""
    v, left, right = F.col("value"), F.coalesce(F.col("left"), F.lit("")), F.coalesce(F.col("right"), F.lit(""))
    n = F.length(v)
    count = lambda pattern, s=v: (F.length(s) - F.length(F.regexp_replace(s, pattern, ""))).cast("double")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9"), "[^aA9]", "-")
    parts = F.split(F.lower(v), "[^a-z]+")
    vocabulary = F.split(F.lit(" ".join(known) or " "), " ")
    before = F.lower(F.regexp_extract(left, r"([\p{L}_]+)[\s=:\"'\(>]*$", 1))
    near = F.split(F.lower(F.concat(left, F.lit(" "), right)), r"[^\p{L}]+")

    def entropy(s: Column) -> Column:
        share = lambda x: (F.length(s) - F.length(F.replace(s, x, F.lit("")))) / F.length(s)
        return F.aggregate(F.transform(F.array_remove(F.array_distinct(F.split(s, "(?!^)")), ""), share), F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return found.withColumns(
        {
            "private": v.rlike("^-----BEGIN [A-Z ]*PRIVATE KEY").cast("double"),
            "known": v.rlike(f"^{KNOWN}$").cast("double"),
            "length": n.cast("double"),
            "entropy": let(v, entropy),
            "switches": count(r"(?<=^|a)(?=[A9-])|(?<=A)(?=[a9-])|(?<=9)(?=[aA-])", classes) + (F.size(F.split(classes, r"(?<=a)(?=[A9-])|(?<=A)(?=[9-])|(?<=9)(?=[aA-])")) - 1) / n,
            "digits": count("[0-9]") / n,
            "uppers": count("[A-Z]") / n,
            "symbols": count("[^A-Za-z0-9]") / n,
            "repeats": count(r"(?<=(.))\1") / n,
            "hex": v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
            "numeric": v.rlike("^[0-9._-]+$").cast("double"),
            "coverage": let(F.array_intersect(parts, vocabulary), lambda p: F.aggregate(F.filter(p, lambda w: F.length(w) >= 3), F.lit(0), lambda a, w: a + F.length(w))) / n,
            "in_path": (v.rlike("/[^/]*/") | left.rlike(r"(?:/|\\|https?:|www\.)\S*$")).cast("double"),
            "extension": F.concat(v, F.substring(right, 1, 6)).rlike(r"\.(?:html?|png|jpe?g|js|css|py|java|txt|json|md|gz|zip)\b").cast("double"),
            "assigned": left.rlike(r"[=:]\s*[\"']?$").cast("double"),
            "quoted": left.rlike(r"[\"'`]$").cast("double"),
            "keyword": F.exists(F.split(before, "_"), lambda w: w.isin(*KEYWORDS)).cast("double"),
            "plain_words": F.size(F.array_intersect(near, vocabulary)).cast("double"),
        }
    ).na.fill(0.0, list(FEATURES))


def labelled_findings(spark: SparkSession, n: int = LABELLED, known: list[str] | None = None) -> DataFrame:
    """(value, left, right, label, template): a deterministic set of findings, half of them secrets.

    Secrets: key blocks, random hex, base64 and prefixed keys, mostly assigned
    to a name that tells; others: certificates, digests and ids in paths, dates and numbers, words
    joined by signs, placeholders, words assigned to such a name.  ``known`` gives the words around them.
    """
    vocabulary = F.split(F.lit(" ".join(known or ["value", "note", "text", "with", "from"])), " ")
    rows = spark.range(n).withColumn("r", F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 512)).withColumn("b", F.translate(F.base64(F.unhex("r")), "=", ""))
    pick = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)).cast("int")
    word = lambda k: F.get(vocabulary, F.pmod(F.xxhash64("id", F.lit(k)), F.size(vocabulary)).cast("int"))
    from_ = lambda k, *xs: F.get(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in xs)), pick(k, len(xs)))
    digits, letters = F.translate("r", "abcdef", "012345"), F.translate("r", "0123456789", "ghijklmnop")
    mixed = F.translate("b", "0123456789+/", "QRSTUVWXYZmn")
    block = lambda what: F.concat(F.lit(f"-----BEGIN {what}-----\n"), F.substring("b", 1, 64), F.lit("\n"), F.substring("b", 10, 60), F.lit(f"\n-----END {what}-----"))
    secret = from_(
        1,
        block("RSA PRIVATE KEY"),
        F.substring("r", 1, 40),
        F.substring("r", 1, 32),
        F.substring("r", 1, 64),
        F.substring("b", 1, 40),
        F.concat(F.lit("AKIA"), F.upper(F.substring(F.when(F.col("id") % 4 == 1, mixed).otherwise(F.regexp_replace("b", "[+/]", "7")), 1, 16))),
        F.concat(F.lit("ghp_"), F.regexp_replace(F.substring("b", 1, 36), "[+/]", "x")),
        # from here on only candidates because a name tells
        F.substring("b", 1, 8),
        F.substring("b", 1, 12),
        F.substring(mixed, 1, 24),
    )
    key = from_(2, "token", "secret", "password", "api_key", "auth_token", "access_key", "private_key", "secret_key")
    other = from_(
        3,
        block("CERTIFICATE"),
        F.substring(digits, 1, 16),
        F.concat_ws("-", F.lit("2024"), F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 5, 12)),
        F.concat_ws("-", word(4), word(5), word(6), F.substring(digits, 1, 2)),
        F.concat_ws("_", word(4), word(5), F.substring(digits, 1, 4), word(7)),
        F.concat_ws("/", word(4), word(5), F.substring("r", 1, 32)),
        F.concat(word(4), F.lit("/"), F.substring("r", 1, 40), F.lit(".html")),
        F.concat_ws("-", F.substring("r", 1, 8), F.substring("r", 9, 4), F.substring("r", 13, 4), F.substring("r", 17, 12)),
        F.lit("xxxxxxxxxxxxxxxx0000"),
        F.lit("EXAMPLE-KEY-1234567890"),
        # words after a name that tells
        word(4),
        F.concat_ws("-", word(4), word(5)),
        F.substring(letters, 1, 7),
        F.substring(letters, 1, 10),
    )
    named = F.when(F.col("id") % 2 == 1, pick(1, 10) >= 7).otherwise(pick(3, 14) >= 10)
    told = F.concat(word(8), F.lit(" "), key, from_(9, " = ", "=", ": ", ":"), from_(10, '"', "'", ""))
    label = F.col("id") % 2
    left = F.when(named | (label == 1) & (pick(11, 8) > 0), told).when((label == 0) & (pick(12, 6) == 0), F.concat(word(8), F.lit(" id: "))).otherwise(F.concat(word(8), F.lit(" "), word(13), F.lit(" ")))
    return rows.select(F.when(label == 1, secret).otherwise(other).alias("value"), left.alias("left"), F.concat(F.lit('" '), word(14), F.lit(" "), word(15)).alias("right"), label.cast("double").alias("label"), F.when(label == 1, F.concat(F.lit("secret-"), pick(1, 10))).otherwise(F.concat(F.lit("other-"), pick(3, 14))).alias("template"))


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="__x", handleInvalid="keep").transform(df)


def train(findings: DataFrame, known: list[str], trees: int = 40, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel:
    """The forest, from a bounded set of labelled findings (value, left, right, label)."""
    forest = RandomForestClassifier(featuresCol="__x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, maxBins=32)
    return forest.fit(_assembled(features(findings, known)).select("__x", "label"))


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, value, score) of the findings that the forest keeps.

    Positions are code points, end exclusive.  Null and empty texts have no
    findings; repeated rows repeat theirs; a candidate of any length is judged
    whole.  Empty tables give no
    rows; other columns are not read.
    """
    known = dictionary(docs)
    model = train(findings if findings is not None else labelled_findings(docs.sparkSession, known=known), known)
    scored = model.transform(_assembled(features(candidates(docs.select("doc_id", "text")), known)))
    return scored.withColumn("score", vector_to_array("probability")[1]).where(F.col("score") >= threshold).select("doc_id", "start", "end", "value", "score")
