"""Quality rules as weak supervision: votes, EM accuracies, posterior verdict.

Every rule looks at one number of a text and votes good, votes bad or abstains.
The vote patterns of all documents are counted by Spark (at most 3 ** 9 =
19,683 rows reach the driver, whatever the input), expectation-maximisation on
these counts estimates how often each rule votes bad among good and among bad
documents, and every pattern gets a posterior probability of being good. That
probability, not "all rules must pass", decides. Fixed Beta priors keep the two
classes from changing places and carry small inputs.

The base rule is not up for a vote: under 20 words, or over 30 % of the words in
repeated 8-word windows, a document is out.

Edge cases: a null text has no words and fails the base rule; ties of the
posterior (exactly 0.5) keep the document; an empty table gives an empty result.
Repeated rows count as often as they occur. Texts are read whole; memory is that
of one Arrow batch. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondera.llm.common import cut, documents, text_batches, tidied

NAME = "op4_quality_rules"
WINDOW, MIN_WORDS, MAX_REPEAT_PCT = 8, 20, 30
SYMBOLS = b"#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_letters", "n_upper", "n_marks", "n_bare")
#: (rule, number, votes bad if, votes good if, needs); both sides open means: abstains.
RULES = (
    ("symbols", "n_symbols / n_words", "> 0.1", "<= 0.02", "n_words > 0"),
    ("repeats", "n_repeat_words / n_words", "> 0.2", "<= 0.05", "n_words >= 16"),
    ("variety", "n_distinct / n_words", "< 0.25", ">= 0.5", "n_words between 50 and 2000"),
    ("capitals", "n_upper / n_letters", "> 0.4", "<= 0.15", "n_letters > 0"),
    ("letters", "n_letters / word_chars", "< 0.75", ">= 0.85", "word_chars > 0"),
    ("marks", "n_marks / n_words", "> 0.3", "<= 0.1", "n_words > 0"),
    ("lines", "n_dup_lines / n_lines", "> 0.3", "<= 0.05", "n_lines >= 4"),
    ("bare words", "n_bare / n_words", "> 0.2", "<= 0.1", "n_words > 0"),
    ("lengths", "abs(word_chars / n_words - 5.5)", "> 4.5", "<= 2.5", "n_words > 0"),
)
PATTERNS = 3 ** len(RULES)
#: Beta priors: the expected share of bad votes, and the prior's weight as a share of all documents (and in documents, at least).
#: That rules seldom speak against good text is what makes them rules, so that prior is the strong one.
PRIOR_GOOD, PRIOR_BAD, PRIOR_CLASS = (0.01, 0.5), (0.35, 0.02), (0.1, 0.02)
PRIOR_LEAST = 20
EM_ROUNDS = 60
_LETTER = re.compile(rb"[A-Za-z\xc0-\xff]")


def repeated_words(ids: np.ndarray, size: int = WINDOW) -> int:
    """Words in windows of ``size`` (a power of two) word ids that occur twice or more; exact, by doubling."""
    n = len(ids)
    if n <= size:
        return 0
    step = 1
    while step < size:
        code = ids[:-step].astype(np.int64) * (int(ids.max()) + 1) + ids[step:]
        found, ids, counts = np.unique(code, return_inverse=True, return_counts=True)
        if len(found) == len(code):
            return 0
        step *= 2
    starts = np.flatnonzero(counts[ids] > 1)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + size, -1)
    return int((np.cumsum(cover) > 0).sum())


def counts(text: bytes) -> tuple[int, ...]:
    """The numbers in _COUNTS of one UTF-8 text."""
    words = text.split()
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    bare = np.fromiter((_LETTER.search(w) is None for w in seen), bool, len(seen))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, beyond = int(byte[65:91].sum()), int(byte[97:123].sum()), int(byte[192:].sum())
    n_chars = len(text) - int(byte[128:192].sum()) - int(byte[9:14].sum()) - int(byte[32])
    return (n, n_chars, int(byte[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(ids), len(seen), len(lines), upper + lower + beyond, upper, int(byte[33] + byte[63]), int(bare[ids].sum()))


def with_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the numbers of _COUNTS, each as __q_<name>."""
    text_batches(df.sparkSession)
    names = [f"__q_{c}" for c in _COUNTS]
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.LongType()) for c in names]])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            table = np.array([counts(t.as_py() or b"") for t in texts], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x) for x in table.T]], [*batch.schema.names, *names])

    return df.mapInArrow(tidied(batches), schema)


def _number(text: str) -> str:
    for c in sorted(_COUNTS, key=len, reverse=True):
        text = text.replace(c, f"`__q_{c}`") if f"`__q_{c}`" not in text else text
    return text


def votes() -> list[Column]:
    """One column per rule: 0 bad, 1 abstains, 2 good."""
    return [F.expr(f"CASE WHEN NOT ({_number(needs)}) THEN 1 WHEN {_number(x)} {bad} THEN 0 WHEN {_number(x)} {good} THEN 2 ELSE 1 END") for _, x, bad, good, needs in RULES]


def pattern() -> Column:
    code = F.lit(0)
    for vote in votes():
        code = code * 3 + vote
    return code


def base_failed() -> Column:
    return (F.col("__q_n_words") < MIN_WORDS) | (100 * F.col("__q_n_repeat_words") > MAX_REPEAT_PCT * F.col("__q_n_words"))


def fit(found: dict[int, int]) -> np.ndarray:
    """Posterior probability of "good" for every pattern, by EM on pattern counts."""
    table = np.array([[p // 3**r % 3 for r in range(len(RULES) - 1, -1, -1)] for p in range(PATTERNS)])
    weight = np.array([found.get(p, 0) for p in range(PATTERNS)], float)
    n = weight.sum()
    bad, good = (table == 0).astype(float), (table == 2).astype(float)
    p_bad = {"good": np.full(len(RULES), PRIOR_GOOD[0]), "bad": np.full(len(RULES), PRIOR_BAD[0])}
    share_bad = PRIOR_CLASS[0]
    for _ in range(EM_ROUNDS):
        log = {k: bad @ np.log(v) + good @ np.log1p(-v) for k, v in p_bad.items()}
        odds = np.log1p(-share_bad) - np.log(share_bad) + log["good"] - log["bad"]
        is_good = 1 / (1 + np.exp(-odds))
        for k, w, prior in (("good", weight * is_good, PRIOR_GOOD), ("bad", weight * (1 - is_good), PRIOR_BAD)):
            own = max(PRIOR_LEAST, prior[1] * n)
            p_bad[k] = (w @ bad + own * prior[0]) / (w @ (bad + good) + own)
        own = max(PRIOR_LEAST, PRIOR_CLASS[1] * n)
        share_bad = ((weight * (1 - is_good)).sum() + own * PRIOR_CLASS[0]) / (n + own)
    return is_good


def judged(df: DataFrame, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``df`` (without its text, if so asked) with the __q_ numbers, base_failed, p_good and kept.

    Without texts the numbers are made once and written; votes, EM and verdicts read them there. With texts they are made
    for the votes and again for the verdicts, since writing them would mean writing every text.
    """
    df = df.drop(*[c for c in ("base_failed", "p_good", "kept") if c != text_col])
    numbered = with_counts(df, text_col)
    if not with_text:
        numbered = cut(numbered.drop(text_col), "numbers")
    counted = with_counts(df.select(text_col), text_col) if with_text else numbered
    seen = counted.where(~base_failed()).groupBy(pattern().alias("p")).count().collect()
    posterior = fit({r["p"]: r["count"] for r in seen})
    table = df.sparkSession.createDataFrame([(i, float(p)) for i, p in enumerate(posterior)], "__p int, p_good double")
    marked = numbered.withColumns({"__p": pattern(), "base_failed": base_failed()})
    joined = marked.join(F.broadcast(table), "__p").drop("__p")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
    numbers = [F.col(f"__q_{c}").alias(c) for c in _COUNTS[:5]]
    return found.select("doc_id", *numbers, "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return judged(docs).where("kept").select(docs.columns)


ORACLE_SQL = None  # the EM verdict has no SQL form; tests hold the numbers against brute force and the verdict against labels
