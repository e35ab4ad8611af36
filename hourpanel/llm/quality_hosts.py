"""Quality rules judged by host, in DataFrame functions only.

Each text gets word, symbol, repeated-line and repeated-window counts and the
base verdict.  Rule failures are then summed by host (a column of the table),
each host's failure rate is shrunk towards the mean over hosts with a beta
prior fitted to the hosts' rates by moments (less the variance that drawing a
host's few documents adds).  A rule's limit is the prior's mean and three
standard deviations, within ``MIN_HOST_RATE`` and ``max_rate``; a host whose
shrunk rate exceeds the limit of any rule loses all its documents.

Defined cases: a null text has no words and fails the base rules; a null host
is a host of its own, apart from the empty one; ids may be null or repeat (a row
is judged by its own text); an empty table gives an empty result; columns other
than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, let, store, text_or_empty

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
MIN_HOST_RATE = 0.2  # no host is dropped below it, however clean the others
MAX_HOST_RATE = 0.5  # every host is dropped above it
DEVIATIONS = 3.0
#: Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"
RULES = ("short", "repeat", "symbol", "line")


def _repeated_window_words(words: Column) -> Column:
    """Words lying in a window of five words that the text has twice or more (all its copies count).

    Windows are compared by their 64-bit hash; only a text that repeats one sorts (hash, position) pairs.
    """
    def hashes(w):
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(h):
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s):
            same = F.filter(s, lambda e, j: (e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]))
            return F.array_sort(F.transform(same, lambda e: e["i"]))

        def step(acc, p):
            return F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"))

        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(let(pairs, starts), start, step)["n"]

    repeats = let(words, lambda w: F.when(F.size(w) >= WINDOW, let(hashes(w), lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))).otherwise(0))
    return repeats.cast("long")


def _lines(text: Column) -> Column:
    """(n_lines, n_dup_lines) of the lines with a word."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, ASCII_SPACE, "") != "")
    return let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                         (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed) of each row."""
    text = text_or_empty(docs, text_col)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counts = docs.select(
        docs[id_col].alias("id"), docs[host_col].alias("host"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"),
                                      _repeated_window_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, ASCII_SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _lines(text).alias("lines"))
    counts = counts.select("id", "host", "w.n_words", "word_chars", "n_symbols", "lines.n_lines", "lines.n_dup_lines",
                           "w.n_repeat_words")
    return counts.withColumn("base_failed", _failures()["short"] | _failures()["repeat"])


def _failures() -> dict[str, Column]:
    c = F.col
    return {"short": c("n_words") < MIN_WORDS,
            "repeat": 100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"),
            "symbol": 100 * c("n_symbols") > MAX_SYMBOL_PERCENT * c("word_chars"),
            "line": 100 * c("n_dup_lines") > MAX_DUP_LINE_PERCENT * c("n_lines")}


def host_verdicts(counts: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n_docs, worst_rate, host_ok): the largest shrunk failure rate of the host over the rules, and its verdict.

    The prior of a rule is the beta distribution with the hosts' weighted mean
    and variance, its weight kept between 1 and 1,000,000 documents.
    """
    fails = [F.sum(cond.cast("long")).alias(f"f_{r}") for r, cond in _failures().items()]
    hosts = store(counts.groupBy("host").agg(F.count("*").alias("n_docs"), *fails), "host-failures")
    n = F.col("n_docs").cast("double")
    moments = []
    for r in RULES:
        rate = F.col(f"f_{r}") / n
        moments += [F.sum(F.col(f"f_{r}")).alias(f"s_{r}"), F.sum(n * rate * rate).alias(f"q_{r}")]
    row = hosts.agg(F.sum(n).alias("n"), F.count("*").alias("hosts"), *moments).first()  # one row, whatever the number of hosts
    shrunk, fine = [], F.lit(True)
    for r in RULES:
        total = row["n"] or 1.0
        mean = (row[f"s_{r}"] or 0) / total
        spread = mean * (1 - mean)
        var = (row[f"q_{r}"] or 0.0) / total - mean * mean - row["hosts"] * spread / total
        weight = min(max(spread / var - 1, 1.0), 1e6) if var > 0 else 1e6
        limit = min(max(mean + DEVIATIONS * (spread / (weight + 1)) ** 0.5, MIN_HOST_RATE), max_rate)
        shrunk.append((F.col(f"f_{r}") + F.lit(mean * weight)) / (n + F.lit(weight)))
        fine &= shrunk[-1] <= limit
    return store(hosts.select("host", "n_docs", F.greatest(*shrunk).alias("worst_rate"), fine.alias("host_ok")), "host-verdicts")


def judge_by_host(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Each row's counts, its base verdict, its host's worst shrunk rate, and whether it is kept."""
    counts = store(text_counts(docs, id_col, text_col, host_col), "quality-counts")  # numbers only, no texts
    hosts = host_verdicts(counts, max_rate).withColumnRenamed("host", "judged")
    out = counts.join(hosts, counts["host"].eqNullSafe(hosts["judged"]), "left")
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", (~F.col("base_failed") & F.col("host_ok")).alias("kept"), "host", "worst_rate")
