"""Secret scan: candidate strings, and a random forest that removes false positives; DataFrame functions and MLlib only.

Candidates are runs of ``MIN_LENGTH`` or more letters, digits and ``+/_-``
(signed web tokens with their dots), values of ``MIN_VALUE`` or more characters
of any kind that are assigned to a name which speaks of secrets, and passwords
inside addresses. The text around gives each its neighbours. The forest sees:
length, shares of digits, capitals and other characters, distinct characters,
changes of character class, the longest run of letters, how much of the
candidate the corpus's own dictionary covers (by short words anywhere, and by
whole parts), path marks before, behind and inside it, and whether the
neighbouring words speak of secrets or of checksums.

The dictionaries are the ``SHORT`` most frequent words of three to five letters
and the ``DICTIONARY`` most frequent of three to twelve, of all texts, so a fixed
number of rows reaches the driver. The forest is fitted on labelled findings, at
most ``LABELLED`` of each label (in the order of a hash). Where none are passed
in, findings whose form or assignment leaves no doubt are labelled by rule
(vendor formats and values with digits assigned to a secret's name: true; plain
words, paths, and digests named as such: false). What the rules leave open is
for the forest; tests measure it on planted findings of forms no rule labels.

Edge cases: a null or empty text has no candidates; a null id is passed through;
repeated rows give repeated findings; with findings of one label only, or none,
no forest is fitted and the rule's label is the score, 0 where it has none. An
empty table gives an empty result. Texts are read whole, in time that grows with
their length; positions are in characters from 0.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondera.llm.common import cut, documents

NAME = "op5_secret_scan"
MIN_LENGTH, MIN_VALUE = 16, 6
LABELLED, SHORT, DICTIONARY = 20_000, 512, 4096
TREES, DEPTH, SEED, THRESHOLD = 20, 6, 7, 0.5
NEAR = 40  # characters looked at on each side
_NAMED = r"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]{0,40}?(?i:passwo?r?d|passphrase|passwd|pwd|secret|token|api_?key|access_?key|credential)[A-Za-z0-9_\-]{0,20}[\"']?[ ]{0,2}[=:][ ]{0,2}[\"']?"
_IN_ADDRESS = r"://[^\s/:@\"']{1,64}:"
_RUN = rf"eyJ[A-Za-z0-9_\-]{{8,}}(?:\.[A-Za-z0-9_\-]+){{1,2}}|[A-Za-z0-9+/_\-]{{{MIN_LENGTH},}}={{0,2}}"
#: One candidate with what names it in front; the value is what _LEAD leaves.
CANDIDATE = rf"{_NAMED}[^\s\"'<>;,]{{{MIN_VALUE},}}|{_IN_ADDRESS}[^\s/@\"']{{3,}}(?=@)|{_RUN}"
_LEAD = rf"^(?:{_NAMED}(?=[^\s\"'<>;,]{{{MIN_VALUE},}}$)|{_IN_ADDRESS})"
_SECRET = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api|key|auth|bearer|credential|private)"
_DIGEST = r"(?i)(commit|sha\d*|md5|hash|checksum|digest|etag|uuid|example|dummy|sample)"
#: Forms that vendors document for their keys: access key ids, repository, chat and payment tokens, signed web tokens, cloud API keys.
_VENDOR = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9\-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_\-]{13,}(\.[A-Za-z0-9_\-]+){0,2}|AIza[A-Za-z0-9_\-]{35})$"


def candidates(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without its text, one row per candidate: start, value, before, behind."""
    text = F.col(text_col)
    found = df.where(F.regexp_like(text, F.lit(CANDIDATE))).withColumn("__row", F.monotonically_increasing_id())
    gaps, values = F.split(text, CANDIDATE), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    zipped = F.arrays_zip(gaps.alias("gap"), values.alias("all"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))
    rows = found.select(*[c for c in df.columns if c != text_col], "__row", F.posexplode(zipped).alias("__i", "__z"))
    line = Window.partitionBy("__row").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    gap, whole = F.col("__z.gap"), F.col("__z.all")
    end = F.sum(F.length(gap) + F.coalesce(F.length(whole), F.lit(0))).over(line)
    rows = rows.withColumns({"__lead": F.length(whole) - F.length(F.regexp_replace(whole, _LEAD, "")), "__end": end}).where(whole.isNotNull())
    value = F.substring(whole, F.col("__lead") + 1, F.length(whole))
    made = {
        "start": (F.col("__end") - F.length(value)).cast("long"),
        "value": value,
        "before": F.right(F.concat(gap, F.substring(whole, F.lit(1), F.col("__lead"))), F.lit(NEAR)),
        "behind": F.left(F.coalesce(F.col("__z.next"), F.lit("")), F.lit(NEAR)),
    }
    return rows.withColumns(made).drop("__row", "__i", "__z", "__lead", "__end")


def dictionary(df: DataFrame, text_col: str = "text") -> tuple[list[str], list[str]]:
    """The most frequent words of three to five, and of three to twelve letters of all texts."""
    words = df.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"\b[A-Za-z]{3,12}\b"), F.lit(0))).alias("w"))
    counts = cut(words.groupBy(F.lower("w").alias("w")).count(), "dictionary")
    top = lambda most, n: [r["w"] for r in counts.where(F.length("w") <= most).orderBy(F.desc("count"), "w").limit(n).collect()]
    return top(5, SHORT), top(12, DICTIONARY)


def features(short: list[str], words: list[str]) -> dict[str, Column]:
    """Feature columns of a candidate row."""
    v, n = F.col("value"), F.length("value")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[^A-Za-z0-9]", "_"), "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "b")
    known = F.regexp_replace(F.lower(v), "|".join(short) or "(?!)", "")
    runs = F.transform(F.split(v, "[^A-Za-z]+"), F.length)
    parts = F.array_distinct(F.split(F.lower(F.regexp_replace(v, "([a-z])(?=[A-Z])", "$1 ")), "[^a-z]+"))
    whole = F.aggregate(F.array_intersect(parts, F.split(F.lit(" ".join(words)), " ")), F.lit(0), lambda n, w: n + F.length(w)) if words else F.lit(0)
    word_before = F.regexp_extract(F.col("before"), r"([A-Za-z_\-]+)[^A-Za-z_\-]*$", 1)
    word_behind = F.regexp_extract(F.col("behind"), r"^[^A-Za-z_\-]*([A-Za-z_\-]+)", 1)
    flag = lambda c: c.cast("double")
    return {
        "length": n.cast("double"),
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "others": share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "transitions": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
        "letter_run": F.array_max(runs) / n,
        "coverage": 1 - F.length(known) / n,
        "parts": whole / n,
        "path": flag(F.regexp_like(F.col("before"), F.lit(r"[/.@\\]$"))) + flag(F.regexp_like(F.col("behind"), F.lit(r"^[/.@\\]\w"))) + F.least(F.regexp_count(v, F.lit("/")), F.lit(4)).cast("double"),
        "secret_near": flag(F.regexp_like(word_before, F.lit(_SECRET))),
        "digest_near": flag(F.regexp_like(word_before, F.lit(_DIGEST)) | F.regexp_like(word_behind, F.lit(_DIGEST))),
    }


def rule_label() -> Column:
    """1, 0, or null where the rules leave doubt."""
    v = F.col("value")
    assigned = F.regexp_like(F.col("before"), F.lit(_SECRET + r"""["']?[ ]{0,2}[=:][ ]{0,2}["']?$"""))
    random = F.regexp_count(v, F.lit("[0-9]")) >= 3
    named = F.regexp_like(F.col("before"), F.lit(_DIGEST + r"""["']?[ ]{0,2}[=: ][ ]{0,2}["']?$"""))
    plain = F.regexp_like(v, F.lit(r"^([A-Z]?[a-z]+|[A-Z]+)([_\-/]([A-Z]?[a-z]+|[A-Z]+))*$")) & (F.length("value") >= MIN_LENGTH)
    camel = F.regexp_like(v, F.lit(r"^[A-Za-z]?[a-z]{2,}([A-Z][a-z]{2,})+$")) & (F.length("value") >= MIN_LENGTH)
    path = F.regexp_like(v, F.lit(r"^/?[a-z]+(/[a-z0-9_\-]+)+$"))
    return F.when(F.regexp_like(v, F.lit(_VENDOR)), 1.0).when(plain | camel | path | named, 0.0).when(assigned & random, 1.0)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """One row per candidate: id, start, value, score and is_secret.

    ``labelled``: rows value, before, behind, label (0.0 or 1.0), instead of the rules' labels.
    """
    made = features(*dictionary(df, text_col))
    found = cut(candidates(df.select(id_col, text_col), text_col).withColumn("label", rule_label()), "candidates")
    known = (found if labelled is None else labelled).where("label is not null")
    order = F.xxhash64("value", "before", "behind")
    fit_on = [known.where(F.col("label") == k).withColumn("__o", order).orderBy("__o", "value", "before").limit(LABELLED).select("value", "before", "behind", "label") for k in (0.0, 1.0)]
    fit_on = cut(fit_on[0].unionByName(fit_on[1]).coalesce(1), "labelled")
    labels = {r["label"] for r in fit_on.select("label").distinct().collect()}
    if len(labels) < 2:
        score = F.coalesce("label", F.lit(0.0))
        return found.select(id_col, "start", "value", score.alias("score"), (score >= THRESHOLD).alias("is_secret"))
    vectors = VectorAssembler(inputCols=[f"f_{k}" for k in made], outputCol="__x")
    columns = {f"f_{k}": c for k, c in made.items()}
    forest = RandomForestClassifier(featuresCol="__x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="__y", predictionCol="__z", rawPredictionCol="__w")
    model = forest.fit(vectors.transform(fit_on.withColumns(columns)))
    judged = model.transform(vectors.transform(found.withColumns(columns)))
    score = vector_to_array("__y")[1]
    return judged.select(id_col, "start", "value", score.alias("score"), (score >= THRESHOLD).alias("is_secret"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", "start", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")


ORACLE_SQL = None  # a forest has no SQL form; tests hold candidates against brute force and verdicts against planted secrets
