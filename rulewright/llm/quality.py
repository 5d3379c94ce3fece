"""Quality rules of documents and of their hosts, in DataFrame functions only.

A document fails a rule by its own counts. Failures are summed by host and each host's failure rate is shrunk
towards the corpus by a beta prior that is fitted to the hosts' rates. The verdict on the host is joined back to its
documents: all documents of a rejected host go, and those of a suspect host, one whose shrunk rate lies well above the
corpus, must keep stricter limits. Documents of other hosts are kept if they fail no rule.

Null text has no words and so fails; a null host is nobody's, never rejected or suspect and not part of the prior.
Repeated rows are judged each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.llm.shared import unique_name, written

WHITE = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Production limits. Symbols and lines are shares of words and of lines with a word.
MIN_WORDS, MAX_REPEAT, MAX_SYMBOLS, MAX_DUP_LINES = 50, 0.5, 0.5, 0.5
#: Limits for documents of suspect hosts.
STRICT_REPEAT, STRICT_SYMBOLS, STRICT_DUP_LINES = 0.25, 0.1, 0.1
#: Shrunk rate from which a host is rejected, and its multiple of the prior's mean from which a host is suspect.
HOST_LIMIT, SUSPECT = 0.8, 1.25
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def with_counts(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the counts of each text, and the names they got beside the table's own columns.

    Windows of three words are compared by a 64-bit hash, sorted inside the row: no rows are made and
    nothing is shuffled. Only texts that do repeat a window are sorted at all.
    """
    name = {c: unique_name(c, docs.columns) for c in COUNTS}
    tmp = {c: unique_name(f"_{c}", docs.columns) for c in ("text", "words", "lines", "hashes", "sorted", "at")}
    c = {k: F.col(f"`{v}`") for k, v in (tmp | name).items()}
    df = docs.withColumn(tmp["text"], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    df = df.withColumns({
        tmp["words"]: F.filter(F.split(c["text"], WHITE), lambda w: w != ""),
        tmp["lines"]: F.filter(F.split(c["text"], "\n"), lambda x: x.rlike(NOT_WHITE)),
        name["n_symbols"]: F.regexp_count(c["text"], F.lit(SYMBOLS)).cast("long"),
    })
    df = df.withColumns({
        name["n_words"]: F.size(c["words"]).cast("long"),
        name["word_chars"]: F.length(F.array_join(c["words"], "")).cast("long"),
        name["n_lines"]: F.size(c["lines"]).cast("long"),
        name["n_dup_lines"]: (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long"),
        tmp["hashes"]: F.transform(F.slice(c["words"], F.lit(1), F.greatest(F.size(c["words"]) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(c["words"], i + 1), F.get(c["words"], i + 2))),
    })
    repeats = F.size(F.array_distinct(c["hashes"])) < F.size(c["hashes"])
    df = df.withColumn(tmp["sorted"], F.when(repeats, F.array_sort(F.transform(c["hashes"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def found_twice(x: Column, k: Column) -> Column:
        before, after = F.get(c["sorted"], k - 1), F.get(c["sorted"], k + 1)
        return F.coalesce(before["h"] == x["h"], F.lit(False)) | F.coalesce(after["h"] == x["h"], F.lit(False))

    df = df.withColumn(tmp["at"], F.array_sort(F.transform(F.filter(c["sorted"], found_twice), lambda x: x["i"])))
    covered = F.aggregate(F.transform(c["at"], lambda x, k: F.least(F.lit(3), x - F.coalesce(F.get(c["at"], k - 1), x - 3))), F.lit(0), lambda a, x: a + x)
    return df.withColumn(name["n_repeat_words"], F.coalesce(covered, F.lit(0)).cast("long")).drop(*tmp.values()), name


def base_failed(name: dict[str, str]) -> Column:
    n = F.col(f"`{name['n_words']}`")
    return (n < MIN_WORDS) | (100 * F.col(f"`{name['n_repeat_words']}`") > 100 * MAX_REPEAT * n)


def rules_failed(name: dict[str, str], repeat: float = MAX_REPEAT, symbols: float = MAX_SYMBOLS, dup_lines: float = MAX_DUP_LINES) -> Column:
    """Whether a document fails any rule of its own."""
    c = {k: F.col(f"`{v}`") for k, v in name.items()}
    repeats = 100 * c["n_repeat_words"] > 100 * repeat * c["n_words"]
    return base_failed(name) | repeats | (c["n_symbols"] > symbols * c["n_words"]) | (c["n_dup_lines"] > dup_lines * c["n_lines"])


def host_verdicts(rows: DataFrame, host_col: str, failed_col: str) -> DataFrame:
    """(host, n_docs, n_failed, rate, verdict): one row for each host, the rate shrunk by the fitted prior, and
    ``rejected``, ``suspect`` or ``trusted``.

    Sums are combined before the shuffle, so a host with a third of all documents is one row of each task.
    The prior's mean and weight come from the moments of the hosts' rates: three numbers reach the driver. Where the rates differ
    no more than sampling makes them, the fitted weight is infinite and no host stands out, whatever the table's size.
    """
    host = F.col(f"`{host_col}`")
    sums = F.count("*").alias("n_docs"), F.sum(F.col(f"`{failed_col}`").cast("long")).alias("n_failed")
    hosts = written(rows.where(host.isNotNull()).groupBy(host.alias("host")).agg(*sums), "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    m = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.avg(1 / F.col("n_docs")).alias("inverse")).first()
    mean = m["mean"] or 0.0
    spread = mean * (1 - mean)
    between = (m["var"] or 0.0) - spread * (m["inverse"] or 0.0)  # what sampling alone doesn't explain
    # no spread between hosts is a prior of infinite weight: every host's rate is the mean
    weight = spread / between - 1 if between > 0 else None
    shrunk = F.lit(mean) if weight is None else (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)
    verdict = F.when(shrunk >= HOST_LIMIT, "rejected").when((shrunk > 0) & (shrunk >= SUSPECT * mean), "suspect").otherwise("trusted")
    return hosts.select("*", shrunk.alias("rate"), verdict.alias("verdict"))


def judge_documents(docs: DataFrame, host_col: str = "source", text_col: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The columns ``keep`` (all) of ``docs`` with counts, base_failed, rules_failed, host_rate, host_verdict and kept; and the names they got.

    The counts are written once to the shared folder and read for the hosts' sums and for the result. The hosts are
    a written table too: Spark broadcasts it only below its limit and else splits the hot host's partition.
    """
    df, name = with_counts(docs, text_col)
    made = ("base_failed", "rules_failed", "host_rate", "host_verdict", "kept")
    name |= {c: unique_name(c, docs.columns) for c in made}
    df = df.withColumns({name["base_failed"]: base_failed(name), name["rules_failed"]: rules_failed(name)})
    wanted = list(dict.fromkeys([*(docs.columns if keep is None else keep), host_col]))
    counted = [name[k] for k in (*COUNTS, "base_failed", "rules_failed")]
    df = written(df.select([F.col(f"`{x}`") for x in [*wanted, *counted]]), "counts")
    key = unique_name("_host", [*docs.columns, *name.values()])
    hosts = host_verdicts(df, host_col, name["rules_failed"])
    hosts = hosts.select(F.col("host").alias(key), F.col("rate").alias(name["host_rate"]), F.col("verdict").alias(name["host_verdict"]))
    judged = df.join(hosts, F.col(f"`{host_col}`") == F.col(f"`{key}`"), "left").drop(key)
    verdict = F.coalesce(F.col(f"`{name['host_verdict']}`"), F.lit("trusted"))
    strict = rules_failed(name, STRICT_REPEAT, STRICT_SYMBOLS, STRICT_DUP_LINES)
    kept = ~F.col(f"`{name['rules_failed']}`") & (verdict != "rejected") & ((verdict != "suspect") | ~strict)
    return judged.withColumn(name["kept"], kept), name


def keep_good(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs`` with the columns of ``docs``."""
    judged, name = judge_documents(docs, host_col, text_col)
    return judged.where(F.col(f"`{name['kept']}`")).select([F.col(f"`{c}`") for c in docs.columns])
