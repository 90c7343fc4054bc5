"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

Candidates are long mixed strings, quoted values behind an assignment, and private key headers.
The forest looks at their length, at character classes and the transitions between them, at the
share covered by words of the corpus, at path-like traits and at the neighbouring words. It is
trained from a table of labelled findings. Everything is DataFrame functions and Spark ML.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.session import durable

# Fixed values.
_RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}"
_QUOTED = r"(?<=[=:] ?[\"'])[^\"'\s]{8,}(?=[\"'])"
_HEADER = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
CANDIDATE = f"{_HEADER}|{_QUOTED}|{_RUN}"
SECRET_WORDS = "token key apikey secret password passwd pwd auth bearer credential credentials private access"
HASH_WORDS = "commit sha sha1 sha256 md5 checksum hash digest uuid id revision build version file page ref"
_CONTEXT = 60


@dataclass(frozen=True)
class Forest:
    """``labelled_rows`` bounds the texts from which labelled findings are made, in expectation."""

    trees: int = 30
    depth: int = 7
    seed: int = 17
    threshold: float = 0.5
    word_count: int = 5
    labelled_rows: int = 2000


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, start and end (code points), candidate, before and after of every candidate; null texts have none."""
    pieces = (
        docs.where("text is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"))
        .where(F.size("found") > 0)
        .withColumn("between", F.split("text", CANDIDATE))
    )
    lengths = F.transform(F.arrays_zip(F.col("between").alias("b"), F.col("found").alias("f")), lambda x: F.length(x["b"]) + F.coalesce(F.length(x["f"]), F.lit(0)))
    # Ends by running sums in one pass: each step appends the last end and its own length.
    ends = F.aggregate(
        lengths,
        F.array(F.lit(0)),
        lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)),
    )
    placed = pieces.select("doc_id", "found", "between", ends.alias("ends")).select(
        "doc_id", "between", "ends", F.posexplode("found").alias("k", "candidate")
    )
    end = F.col("ends")[F.col("k") + 1]
    return placed.select(
        "doc_id",
        (end - F.length("candidate")).cast("long").alias("start"),
        end.cast("long").alias("end"),
        "candidate",
        F.substring(F.col("between")[F.col("k")], -_CONTEXT, _CONTEXT).alias("before"),
        F.substring(F.col("between")[F.col("k") + 1], 1, _CONTEXT).alias("after"),
    )


def corpus_words(docs: DataFrame, p: Forest) -> DataFrame:
    """Lower-case words of four to sixteen letters that occur ``word_count`` times or more in all texts."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z])[a-z]{4,16}(?![a-z])"), F.lit(0))
    return docs.select(F.explode(found).alias("word")).groupBy("word").count().where(F.col("count") >= p.word_count).select("word")


def _share(text: str, of: str) -> Column:
    return F.length(F.regexp_replace(text, of, "")) / F.length(text)


def _word_in(text: Column, words: str) -> Column:
    return F.coalesce(F.lower(text).rlike(rf"(^|[^a-z])({'|'.join(words.split())})([^a-z]|$)"), F.lit(False)).cast("double")


FEATURES = (
    "length", "digits", "upper", "lower", "signs", "distinct", "hex", "class_turns", "vowel_turns", "repeats", "covered", "slashes",
    "rooted", "extension", "hyphens", "quoted", "assigned", "secret_before", "hash_before", "secret_inside", "placeholder", "header", "ends_quoted",
)


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` (candidate, before, after and more) with the columns of FEATURES."""
    runs = (
        found.select("candidate")
        .distinct()
        .select("candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    )
    covered = runs.join(words, "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("covered_chars"))
    size = F.length("candidate")
    # Digits, capitals, small letters and signs as 0, A, a and -; runs of one class then collapse.
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace("candidate", "[0-9]+", "0"), "[A-Z]+", "A"), "[a-z]+", "a")
    letters = F.regexp_replace(F.lower("candidate"), "[^a-z]", "")
    vowels = F.regexp_replace(F.regexp_replace(letters, "[aeiou]+", "a"), "[^a]+", "b")
    return (
        found.join(covered, "candidate", "left")
        .withColumns(
            {
                "length": F.log1p(size),
                "digits": 1 - _share("candidate", "[0-9]"),
                "upper": 1 - _share("candidate", "[A-Z]"),
                "lower": 1 - _share("candidate", "[a-z]"),
                "signs": _share("candidate", "[A-Za-z0-9]"),
                "distinct": F.size(F.array_distinct(F.split("candidate", ""))) / F.sqrt(size),
                "hex": F.col("candidate").rlike("^[0-9a-f]+$").cast("double"),
                "class_turns": F.length(classes) / size,
                "vowel_turns": F.length(vowels) / (F.length(letters) + 1),
                "repeats": F.length(F.regexp_replace("candidate", r"(.)\1{2,}", "")) / size,
                "covered": F.coalesce("covered_chars", F.lit(0)) / size,
                "slashes": (size - F.length(F.replace("candidate", F.lit("/"), F.lit("")))).cast("double"),
                "rooted": (F.col("candidate").startswith("/") | F.col("before").rlike(r"[./\\]$")).cast("double"),
                "extension": F.col("after").rlike(r"^\.[a-z0-9]{1,5}([^a-z0-9]|$)").cast("double"),
                "hyphens": (size - F.length(F.regexp_replace("candidate", "[-_]", ""))).cast("double"),
                "quoted": F.col("before").rlike("[\"']$").cast("double"),
                "assigned": F.col("before").rlike("[=:]\\s?[\"']?$").cast("double"),
                "secret_before": _word_in(F.regexp_extract("before", r"(\S+\s*\S*)\s*$", 1), SECRET_WORDS),
                "hash_before": _word_in(F.regexp_extract("before", r"(\S+\s*\S*)\s*$", 1), HASH_WORDS),
                "secret_inside": F.col("candidate").rlike("^(AKIA|ASIA|ghp_|gho_|sk-|xox[abp]-|glpat-|AIza)").cast("double"),
                "placeholder": F.lower("candidate").rlike("example|sample|your|here|xxxx|placeholder|changeme|dummy").cast("double"),
                "header": F.col("candidate").startswith("-----BEGIN").cast("double"),
                "ends_quoted": F.col("after").rlike("^[\"']").cast("double"),
            }
        )
        .drop("covered_chars")
    )


def labelled_findings(docs: DataFrame, p: Forest = Forest()) -> DataFrame:
    """Findings with labels (candidate, before, after, label), made by rule from a bounded sample of texts.

    Each sampled text gives one secret and one look-alike. Keys are digests of the text's id,
    in the forms in which services issue them; look-alikes are digests named as such, paths,
    hyphenated words of the text itself, build names and placeholders.
    """
    total = docs.count()
    kept = int((1 << 20) * min(1.0, p.labelled_rows / max(1, total)))
    h = F.sha2(F.concat_ws(":", F.lit(p.seed).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.where(F.pmod(F.xxhash64(F.lit(p.seed), "doc_id"), F.lit(1 << 20)) < kept).select(
        h.alias("h"),
        F.translate(F.base64(F.unhex(h)), "+/=", "aZ9").alias("b64"),
        F.slice(F.filter(F.split(F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 400)), "[^a-z]+"), lambda w: F.length(w) > 2), 1, 6).alias("w"),
        F.pmod(F.xxhash64(F.lit(p.seed + 1), "doc_id"), F.lit(60)).alias("k"),
    )
    secret_words, hash_words = SECRET_WORDS.split(), HASH_WORDS.split()

    def pick(values: list[str], by: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))

    k = F.col("k")
    word = F.coalesce(F.try_element_at("w", F.lit(1)), F.lit("the"))
    slug = F.array_join(F.slice("w", 1, 4), "-")
    value = (
        F.when(k % 6 == 0, F.substring("h", 1, 40))
        .when(k % 6 == 1, F.substring("b64", 1, 32))
        .when(k % 6 == 2, F.concat(F.lit("AKIA"), F.upper(F.substring("b64", 1, 16))))
        .when(k % 6 == 3, F.concat(F.lit("ghp_"), F.substring("b64", 1, 36)))
        .when(k % 6 == 4, F.concat(F.lit("sk-"), F.substring("b64", 3, 40)))
        .otherwise(F.col("h"))
    )
    glue = pick([' = "', ": ", "=", ' : "', "='"], k)
    secrets = rows.select(
        value.alias("candidate"),
        F.concat(word, F.lit(" "), pick(secret_words, F.floor(k / 2)), glue).alias("before"),
        F.concat(F.when(glue.rlike("[\"']$"), F.substring(glue, -1, 1)).otherwise(""), F.lit(" "), word).alias("after"),
        F.lit(1.0).alias("label"),
    )
    other = (
        F.when(k % 6 == 0, F.substring("h", 1, 40))
        .when(k % 6 == 1, F.concat(slug, F.lit("-"), F.substring("h", 1, 2), F.lit("-2021")))
        .when(k % 6 == 2, F.concat(F.lit("/usr/lib/"), F.array_join(F.slice("w", 1, 3), "/"), F.lit("/v2")))
        .when(k % 6 == 3, F.concat(F.lit("your_api_key_here_"), (k % 10).cast("string")))
        .when(k % 6 == 4, F.concat(F.lit("build_"), F.substring("h", 1, 4), F.lit("_release_2020-10-"), (10 + k % 19).cast("string")))
        .otherwise(F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4), F.substring("h", 13, 4), F.substring("h", 17, 4), F.substring("h", 21, 12)))
    )
    plain = pick([" ", ": ", " (", "/"], k)
    lookalikes = rows.select(
        other.alias("candidate"),
        F.concat(word, F.lit(" "), F.when(k % 6 == 3, pick(secret_words, F.floor(k / 2))).otherwise(pick(hash_words, F.floor(k / 2))), plain).alias("before"),
        F.concat(F.when(k % 6 == 2, ".txt ").otherwise(" "), word).alias("after"),
        F.lit(0.0).alias("label"),
    )
    return secrets.union(lookalikes)


def train(labelled: DataFrame, words: DataFrame, p: Forest = Forest()) -> RandomForestClassificationModel:
    """Fits the forest on labelled findings (candidate, before, after, label 0 or 1)."""
    rows = durable(with_features(labelled, words).select(*FEATURES, "label"))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=p.trees, maxDepth=p.depth, seed=p.seed).fit(vectors)


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, p: Forest = Forest()) -> DataFrame:
    """Every candidate with the forest's judgement.

    doc_id, start, end (code points, end exclusive), candidate_sha256, score (0 to 1), secret
    (score of ``threshold`` or more). Without any labelled finding, or with one label only, all
    candidates count as secrets with score 1. Repeated rows repeat their findings; null texts
    have none; other columns are ignored.
    """
    words = durable(corpus_words(docs, p))
    found = durable(candidates(docs))
    labelled = durable(labelled if labelled is not None else labelled_findings(docs, p))
    out = ["doc_id", "start", "end", F.sha2("candidate", 256).alias("candidate_sha256")]
    if labelled.select("label").distinct().count() < 2:
        return found.select(*out, F.lit(1.0).alias("score"), F.lit(True).alias("secret"))
    model = train(labelled, words, p)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(found, words))
    score = vector_to_array("probability")[1]
    return model.transform(vectors).select(*out, score.alias("score"), (score >= p.threshold).alias("secret"))
