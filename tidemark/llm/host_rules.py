"""Quality rules by host: failures counted by host, rates shrunk to a common prior, verdicts joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, checkpointed, documents, let, words

WINDOW = 8
MIN_WORDS = 20
#: Per cent of words in repeated windows above which a document fails.
REPEAT_PERCENT = 30
#: A host is blocked if a rule's shrunk failure rate reaches the rule's limit.
RATE_LIMITS = {"few_words": 0.5, "repeated": 0.5, "symbols": 0.6, "dup_lines": 0.6}
#: The prior's weight in documents lies in this range, whatever the spread of the rates.
PRIOR_WEIGHT = (2.0, 1000.0)


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows found twice or more in `tokens`.

    Windows are told apart by two 64-bit hashes of their words. Texts without a repeat, nearly all, end after
    the first hash; the others sort (hashes, place), keep the places whose neighbour has the same hashes and
    add up the ground they cover.
    """

    def windows(w: Column, value) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), value)

    def covered(places: Column) -> Column:
        step = F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-(10**9)).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).cast("long").alias("n"), p.alias("last")),
        )
        return step["n"]

    def twice(w: Column) -> Column:
        keyed = F.sort_array(windows(w, lambda i: let(F.slice(w, i, window), lambda s: F.struct(F.xxhash64(s).alias("a"), F.xxhash64(s, F.lit(1)).alias("b"), i.alias("i")))))
        same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"])
        near = lambda k, e, j: F.coalesce(same(F.get(k, j - 1), e), F.lit(False)) | F.coalesce(same(F.get(k, j + 1), e), F.lit(False))
        places = let(keyed, lambda k: F.transform(F.filter(k, lambda e, j: near(k, e, j)), lambda e: e["i"]))
        return covered(F.sort_array(places))

    def checked(w: Column) -> Column:
        hashes = windows(w, lambda i: F.xxhash64(F.slice(w, i, window)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(twice(w)))

    return F.when(F.size(tokens) < window + 1, F.lit(0).cast("long")).otherwise(checked(tokens))


def counts(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key, host and a document's counts: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = let(
        F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    by_word = let(
        words(F.col(text)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")),
    )
    symbols = F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long")
    out = df.select(F.col(key), F.col(host).alias("host"), by_word.alias("w"), symbols.alias("n_symbols"), lines.alias("l"))
    return out.select(key, "host", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def rules() -> dict[str, Column]:
    """Each rule: true where a document fails."""
    c = F.col
    return {
        "few_words": c("n_words") < MIN_WORDS,
        "repeated": 100 * c("n_repeat_words") > REPEAT_PERCENT * c("n_words"),
        "symbols": 10 * c("n_symbols") > 3 * c("n_words"),
        "dup_lines": 100 * c("n_dup_lines") > 30 * c("n_lines"),
    }


def host_verdicts(counted: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """For each host: n_docs, the shrunk failure rate of each rule, and host_blocked.

    A rule's prior is a beta distribution fitted to all hosts: its mean is the failure rate of all documents, its
    weight follows from the spread of the hosts' rates beyond what chance gives (moments), within PRIOR_WEIGHT.
    The prior is one row, a scalar subquery.
    """
    limits = limits or RATE_LIMITS
    names = [r for r in rules() if r in limits]
    n = F.col("n_docs")
    hosts = counted.groupBy("host").agg(F.count("*").alias("n_docs"), *(F.count_if(rules()[r]).alias(f"f_{r}") for r in names))
    mean = {r: F.sum(f"f_{r}") / F.sum("n_docs") for r in names}
    prior = hosts.agg(
        F.count("*").alias("h"), F.sum("n_docs").alias("n"), F.sum(n * n).alias("nn"),
        *(mean[r].alias(f"m_{r}") for r in names), *(F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / n).alias(f"q_{r}") for r in names),
    )

    def weight(r: str) -> Column:
        m, h, total = F.col(f"m_{r}"), F.col("h"), F.col("n")
        inner = m * (1 - m)
        # Var of the rates weighted by documents: (q - n m^2) = (h - 1) inner + rho * inner * (n - nn / n - (h - 1))
        rho = (F.col(f"q_{r}") - total * m * m - (h - 1) * inner) / F.nullif(inner * (total - F.col("nn") / total - (h - 1)), F.lit(0.0))
        return F.when(rho > 0, F.greatest(F.lit(PRIOR_WEIGHT[0]), F.least(F.lit(PRIOR_WEIGHT[1]), 1 / rho - 1))).otherwise(F.lit(PRIOR_WEIGHT[1]))

    fitted = prior.select(*(F.coalesce(weight(r), F.lit(PRIOR_WEIGHT[1])).alias(f"w_{r}") for r in names), *(f"m_{r}" for r in names))
    p = F.col("prior")
    rate = {r: F.round((F.col(f"f_{r}") + p[f"w_{r}"] * p[f"m_{r}"]) / (n + p[f"w_{r}"]), 9) for r in names}
    rated = hosts.withColumn("prior", fitted.select(F.struct("*")).scalar()).select("host", "n_docs", *(rate[r].alias(f"rate_{r}") for r in names))
    blocked = [F.col(f"rate_{r}") >= limits[r] for r in names]
    return rated.withColumn("host_blocked", F.array_contains(F.array(*blocked), True))


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", limits: dict[str, float] | None = None) -> DataFrame:
    """A row for each row of `df`: key, the counts, base_failed, host_blocked, kept.

    Null and empty texts have no words and fail; very long texts are counted whole. A rate equal to its limit blocks. Rows of a null host share one host. Repeated rows stay and count
    each. An empty table gives an empty result. The counts, without texts, are computed once and kept in the
    shared folder; hosts are summed map-side before they are shuffled, so a hot host costs no more than others.
    """
    counted = checkpointed(counts(df, key, text, host))
    verdicts = host_verdicts(counted, limits).select(F.col("host").alias("v_host"), "host_blocked")
    failed = rules()["few_words"] | rules()["repeated"]
    out = counted.join(verdicts, F.col("host").eqNullSafe(F.col("v_host")), "left").withColumn("base_failed", failed)
    return out.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce("host_blocked", F.lit(False))).alias("kept"))


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict; a document's host is its source."""
    return judge(documents(spark, sf_dir))


SQL = r"""
WITH tokens AS (
    SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM tokens)
), doubled AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1
), ground AS (
    SELECT doc_id, sum(least(8, i - coalesce(last, -100))) AS n_repeat_words
    FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM doubled) GROUP BY doc_id
), lines AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM tokens) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counted AS (
    SELECT t.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM tokens t LEFT JOIN ground g ON t.doc_id = g.doc_id LEFT JOIN lines l ON t.doc_id = l.doc_id
), failed AS (
    SELECT *, n_words < 20 AS few_words, 100 * n_repeat_words > 30 * n_words AS repeated, 10 * n_symbols > 3 * n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS dup_lines FROM counted
), long AS (
    SELECT source, 'few_words' AS r, 0.5 AS most, few_words AS f FROM failed UNION ALL SELECT source, 'repeated', 0.5, repeated FROM failed
    UNION ALL SELECT source, 'symbols', 0.6, symbols FROM failed UNION ALL SELECT source, 'dup_lines', 0.6, dup_lines FROM failed
), hosts AS (
    SELECT source, r, most, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) AS DOUBLE) AS f FROM long GROUP BY source, r, most
), moments AS (
    SELECT r, count(*) AS h, sum(n) AS n, sum(n * n) AS nn, sum(f) / sum(n) AS m, sum(f * f / n) AS q FROM hosts GROUP BY r
), spread AS (
    SELECT r, m, (q - n * m * m - (h - 1) * m * (1 - m)) / nullif(m * (1 - m) * (n - nn / n - (h - 1)), 0) AS rho FROM moments
), prior AS (
    SELECT r, m, CASE WHEN rho > 0 THEN greatest(2.0, least(1000.0, 1 / rho - 1)) ELSE 1000.0 END AS w FROM spread
), blocked AS (
    SELECT source, bool_or(round((f + w * m) / (n + w), 9) >= most) AS b FROM hosts JOIN prior ON hosts.r = prior.r GROUP BY source
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    few_words OR repeated AS base_failed, NOT (few_words OR repeated) AND NOT coalesce(b, false) AS kept
FROM failed d LEFT JOIN blocked s ON d.source IS NOT DISTINCT FROM s.source"""
