"""Quality rules as weak supervision, on DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-
maximisation over the counts of vote patterns estimates how often each rule votes
in which way on good and on bad documents, and the share of good ones; the
posterior of "good" is the verdict. There are at most 3**len(RULES) patterns whatever the
size of the corpus, so the fit is one expression over one row; the patterns are
counted over all documents with map-side combine.

A null or empty text has no words: ``base_failed`` holds and it isn't kept.
Rows with a null or repeated doc_id are judged one by one, by their text. Without
any document, nothing is fitted and the result is empty. A row's columns are
held together, so none of their names can clash, and the filter works on them in
place: nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

_SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ROUNDS = 25
#: Pseudo-counts of votes bad, none and good, by class; also the start: a bad vote is rare among good documents.
PRIOR = {"good": [0.2, 9.7, 0.1], "bad": [3.0, 6.9, 0.1]}
PRIOR_LAST = {"good": [0.1, 2.9, 7.0], "bad": [0.1, 3.9, 6.0]}


def _chars(text: Column, kind: str) -> Column:
    """How many characters of a class; the class is given negated."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("long")


def with_counts(docs: DataFrame, *kept: str) -> DataFrame:
    """``row`` (the columns ``kept``) and the counts that the rules use."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.struct(*kept).alias("row"), text.alias("_q_t"))
    df = df.withColumn("_q_w", F.array_remove(F.split("_q_t", _SPACE), ""))
    df = df.withColumn("_q_l", F.filter(F.split("_q_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_q_w")
    df = df.select(
        "row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_q_w", "")).cast("long").alias("word_chars"),
        _chars(F.col("_q_t"), "#*$%&|<>").alias("n_symbols"),
        _chars(F.col("_q_t"), r"\p{Lu}").alias("_q_upper"),
        _chars(F.col("_q_t"), r"\p{L}").alias("_q_letters"),
        F.size(F.filter("_q_w", lambda x: ~x.rlike(r"[\p{L}\p{N}]"))).cast("long").alias("_q_lone"),
        F.regexp_count("_q_t", F.lit(r"[^\p{L}\p{N}\s]{2,}")).cast("long").alias("_q_runs"),
        _chars(F.col("_q_t"), "!").alias("_q_bang"),
        _chars(F.col("_q_t"), ".!?").alias("_q_stop"),
        F.size("_q_l").cast("long").alias("_q_lines"),
        (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 8, F.transform("_q_w", lambda x: F.xxhash64(x))).alias("_q_h"),
    )
    for step in (1, 2, 4):  # hashes of 1, 2, 4 and then 8 words from each word on
        df = df.withColumn("_q_h", F.expr(f"zip_with(slice(_q_h, 1, size(_q_h) - {step}), slice(_q_h, {step} + 1, size(_q_h) - {step}), (x, y) -> xxhash64(x, y))"))
    # only where a window repeats: windows by hash, then the places of those that have an equal neighbour
    df = df.withColumn("_q_s", F.expr("if(size(array_distinct(_q_h)) < size(_q_h), sort_array(transform(_q_h, (h, p) -> struct(h, p))), null)"))
    df = df.withColumn(
        "_q_p",
        F.expr(
            "sort_array(filter(transform(_q_s, (x, k) -> if((k > 0 and get(_q_s, k - 1).h = x.h) or (k + 1 < size(_q_s) and get(_q_s, k + 1).h = x.h), x.p, -1)), p -> p >= 0))"
        ),
    )
    covered = F.expr("aggregate(transform(_q_p, (p, k) -> least(8, coalesce(get(_q_p, k + 1) - p, 8))), 0, (a, b) -> a + b)")
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_q_h", "_q_s", "_q_p")


#: name: (votes bad if, votes good if); a document for which neither holds gets no vote. All but the last only
#: speak against a document, so that their silence says little.
RULES = {
    "word_length": ("word_chars < 2 * n_words or word_chars > 14 * n_words", "false"),
    "symbols": ("10 * n_symbols > 2 * n_words", "false"),
    "letters": ("10 * _q_letters < 8 * word_chars", "false"),
    "lone_signs": ("10 * _q_lone > 2 * n_words", "false"),
    "sign_runs": ("10 * _q_runs > 3 * n_words", "false"),
    "own_lines": ("10 * n_dup_lines > 3 * _q_lines", "false"),
    "own_words": ("100 * n_repeat_words > 20 * n_words", "false"),
    "capitals": ("100 * _q_upper > 40 * word_chars", "false"),
    "exclaiming": ("10 * _q_bang > 3 * n_words", "false"),
    "unstopped": ("n_words >= 60 and 200 * _q_stop < n_words", "false"),
    "sentences": ("false", "_q_stop * 60 > n_words and _q_stop * 2 < n_words"),
}


def _failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vote(bad: str, good: str) -> Column:
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


def with_votes(counted: DataFrame) -> DataFrame:
    return counted.withColumn("votes", F.array(*(_vote(*r) for r in RULES.values())))


def _prior(kind: str) -> list[float]:
    return PRIOR[kind] * (len(RULES) - 1) + PRIOR_LAST[kind]


def _log_odds(votes: Column, p: Column) -> Column:
    """Log odds of "good" for a pattern of votes; good and bad hold P(vote | class) of rule j at 3 j + vote + 1."""
    terms = F.transform(votes, lambda v, j: F.log(F.get(p["good"], 3 * j + v + 1)) - F.log(F.get(p["bad"], 3 * j + v + 1)))
    return F.aggregate(terms, F.log(p["share"]) - F.log(1 - p["share"]), lambda s, x: s + x)


def _posterior(votes: Column, p: Column) -> Column:
    return 1 / (1 + F.exp(-_log_odds(votes, p)))


def _total(rows: Column, value) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda s, r: s + value(r))


def _doubles(x: list[float]) -> Column:
    return F.array(*map(F.lit, x))


def _step(rows: Column, p: Column) -> Column:
    """One round of expectation and maximisation, with PRIOR as pseudo-counts."""
    rows = F.transform(rows, lambda r: F.struct(r["votes"].alias("votes"), r["n"].alias("n"), _posterior(r["votes"], p).alias("q")))

    def chances(r: Column, prior: list[float], weight) -> Column:
        total = _total(r, weight) + sum(prior[:3])

        def one(k: Column) -> Column:
            j, vote = (k / 3).cast("int"), k % 3 - 1
            hit = _total(r, lambda x: F.when(F.get(x["votes"], j) == vote, weight(x)).otherwise(0.0))
            return (hit + F.get(_doubles(prior), k)) / total

        return F.transform(F.sequence(F.lit(0), F.lit(3 * len(RULES) - 1)), one)

    def fitted(r: Column) -> Column:
        share = (_total(r, lambda x: x["n"] * x["q"]) + 8) / (_total(r, lambda x: x["n"]) + 10)
        return F.struct(
            F.greatest(F.lit(0.05), F.least(F.lit(0.95), share)).alias("share"),
            chances(r, _prior("good"), lambda x: x["n"] * x["q"]).alias("good"),
            chances(r, _prior("bad"), lambda x: x["n"] * (1 - x["q"])).alias("bad"),
        )

    return F.get(F.transform(F.array(rows), fitted), 0)  # binds the rows once


def fit(voted: DataFrame) -> dict | None:
    """share of good documents and P(vote | class) of each rule, among those that don't fail outright. None without any."""
    patterns = voted.where(~_failed()).groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    first = {k: [x / sum(PRIOR[k]) for x in _prior(k)] for k in PRIOR}
    start = F.struct(F.lit(0.8).alias("share"), _doubles(first["good"]).alias("good"), _doubles(first["bad"]).alias("bad"))
    row = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("rows")).where(F.size("rows") > 0)
    row = row.select(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda p, _: _step(F.col("rows"), p)).alias("p")).first()
    return row["p"].asDict() if row else None


def _judged(docs: DataFrame, *kept: str) -> DataFrame:
    """``row``, the counts, votes, score, base_failed and kept."""
    voted = Scratch(docs.sparkSession, "quality").table(with_votes(with_counts(docs, *kept)), "votes")
    p = fit(voted)
    score = F.lit(None).cast("double")
    if p:
        lits = F.struct(F.lit(p["share"]).alias("share"), _doubles(p["good"]).alias("good"), _doubles(p["bad"]).alias("bad"))
        score = _posterior(F.col("votes"), lits)
    judged = voted.select("row", *COUNTS, _failed().alias("base_failed"), F.round(score, 6).alias("score"), "votes")
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= 0.5, F.lit(False)))


def verdicts(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: doc_id, the counts, base_failed, kept, score, votes."""
    return _judged(docs, "doc_id").select("row.doc_id", *COUNTS, "base_failed", "score", "votes", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that aren't kept."""
    return _judged(docs, "*").where("kept").select("row.*")
