"""Quality rules as weak supervision: every rule votes keep, reject or nothing; expectation-maximisation learns how far each
vote can be trusted; the posterior probability of good quality decides. DataFrame functions only.

All documents are counted by their pattern of votes (3 to the power of the number of rules at most), and every round of the
estimation is one aggregation over that small table.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignflow.llm import common as c

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Vote over the measured columns: reject where that condition holds, else no vote where the other one does, else keep."""

    name: str
    reject: str
    abstain: str = "n_words < 20"


RULES = (
    Rule("length", "n_words < 50", "n_words < 80"),
    Rule("word_length", "word_chars < 2.5 * n_words OR word_chars > 12 * n_words"),
    Rule("symbols", "n_symbols > 0.1 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 0.5 * n_lines", "n_lines < 3"),
    Rule("repeated_words", "n_repeat_words > 0.3 * n_words"),
    Rule("letters", "n_letters < 0.8 * word_chars"),
    Rule("word_letters", "n_alpha_words < 0.7 * n_words"),
)
ROUNDS = 12
#: Belief before the documents are seen, and how many documents, as a share of all, it weighs: the share of good
#: documents and how often a rule rejects a bad and a good one. It also tells the two classes apart.
BELIEF_GOOD, BELIEF_BAD_REJECTED, BELIEF_GOOD_REJECTED, BELIEF_SHARE = 0.8, 0.4, 0.03, 0.05


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, text and what the rules look at. A null text counts as empty: all measures are 0."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    df = df.withColumn("w", c.words_of(F.col("text")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "doc_id", "text", F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(F.filter("w", lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        lines.alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    # A word triple is one hash; sorted beside their places, equal triples are neighbours.
    triples = F.when(F.col("n_words") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("h") - 3),
        lambda i: F.struct(F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)).alias("g"), i.alias("at"))))
    df = df.withColumn("s", F.sort_array(triples)).drop("h")
    again = F.filter("s", lambda x, i: F.coalesce(F.get("s", i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get("s", i + 1)["g"] == x["g"], F.lit(False)))
    df = df.withColumn("p", F.sort_array(F.transform(again, lambda x: x["at"]))).drop("s")
    covered = F.aggregate(
        F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda n, x: n + x)
    return df.select(
        "doc_id", "text", "n_words", "word_chars", "n_symbols", "n_alpha_words", "n_letters", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def voted(df: DataFrame) -> DataFrame:
    """Adds one column per rule: 1 keep, -1 reject, 0 no opinion."""
    return df.withColumns({f"vote_{r.name}": F.when(F.expr(r.reject), -1).when(F.expr(r.abstain), 0).otherwise(1).cast("tinyint") for r in RULES})


@dataclass
class Trust:
    """Share of good documents and, per rule and vote, log P(vote | good) - log P(vote | bad)."""

    good: float
    weight: dict[str, dict[int, float]]

    def posterior(self) -> Column:
        total = F.lit(log(self.good) - log(1 - self.good))
        for r in RULES:
            v = F.col(f"vote_{r.name}")
            total = total + F.when(v == 1, self.weight[r.name][1]).when(v == -1, self.weight[r.name][-1]).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def estimate(votes: DataFrame, rounds: int = ROUNDS) -> Trust:
    """Trust in each vote from the patterns of votes alone. ``votes`` has one row per document.

    Without any document the prior belief stands. Votes that a rule never casts keep the prior belief, too.
    """
    names = [f"vote_{r.name}" for r in RULES]
    patterns = c.written(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "votes")
    start = {1: log((1 - BELIEF_GOOD_REJECTED) / (1 - BELIEF_BAD_REJECTED)), -1: log(BELIEF_GOOD_REJECTED / BELIEF_BAD_REJECTED)}
    trust = Trust(BELIEF_GOOD, {r.name: start for r in RULES})
    for _ in range(rounds):
        df = patterns.withColumn("good", F.col("n") * trust.posterior()).withColumn("bad", F.col("n") - F.col("good"))
        sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
        for r in RULES:
            sums += [F.sum(F.when(F.col(f"vote_{r.name}") == v, F.col(side))).alias(f"{r.name}_{side}_{v}") for side in ("good", "bad") for v in (1, -1)]
        row = df.agg(*sums).first()
        if not row["n"]:
            break
        prior = BELIEF_SHARE * row["n"]
        weight = {}
        for r in RULES:
            got = {(side, v): row[f"{r.name}_{side}_{v}"] or 0.0 for side in ("good", "bad") for v in (1, -1)}
            good = (got["good", -1] + BELIEF_GOOD_REJECTED * prior) / (got["good", 1] + got["good", -1] + prior)
            bad = (got["bad", -1] + BELIEF_BAD_REJECTED * prior) / (got["bad", 1] + got["bad", -1] + prior)
            weight[r.name] = {1: log((1 - good) / (1 - bad)), -1: log(good / bad)}
        trust = Trust((row["good"] + BELIEF_GOOD * prior) / (row["n"] + prior), weight)
    return trust


def verdict(trust: Trust) -> tuple[Column, Column]:
    """base_failed and kept over the measured and voted columns."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return failed, ~failed & (trust.posterior() >= 0.5)


def judged(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, the measures, the votes, posterior, base_failed and kept.

    kept: not base_failed and the posterior of good quality is a half or more. Null and empty texts have no words, so they
    fail; repeated rows are judged alike; other columns are ignored. An empty table gives no rows.
    """
    df = c.written(voted(measured(documents)).drop("text"), "measures")
    trust = estimate(df)
    failed, kept = verdict(trust)
    return df.withColumn("posterior", trust.posterior()).withColumns({"base_failed": failed, "kept": kept})


def filtered(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are kept, with all their columns; as ``judged`` decides."""
    whole = F.struct(*[F.col(f"`{x}`") for x in documents.columns]).alias("doc_id")
    # Written with the measures, so that the filter is not pushed below them, which would compute them many times over.
    df = c.written(voted(measured(documents.select(whole, "text"))).drop("text"), "measures")
    _, kept = verdict(estimate(df))
    return df.where(kept).select("doc_id.*")


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns from ``judged``."""
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
