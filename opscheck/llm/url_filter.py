"""URL filter: host and path rules, and a character language-model ratio for the rest.

URLs that a rule allows or blocks train two variable-order Markov models of characters;
a model backs off from the longest context it has seen by Witten-Bell smoothing. A URL that no rule
fits is judged by the difference of the two log-likelihoods per character. The threshold is
calibrated on the ``1 / folds`` of ruled URLs that the models do not count: it is the lowest of the candidate
thresholds with the highest balanced accuracy there.

The counts cover every ruled URL and are joined, never sent to the driver: a table of
n-grams, and one of their contexts. A window that many URLs share is scored once.

The models read the whole URL: its host in lower case and all that follows, query and fragment included, or all of a URL
without ``://``.

Defined results: a NULL url, or one without ``://``, has an empty host and path and no rule; a NULL or empty one is judged
by its end alone; with only one kind of ruled URLs everything else gets that
verdict, without any it is allowed; repeated rows and repeated page_ids get a row each; URLs of any length
are judged whole; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opscheck.llm.common import durable
from opscheck.operators.keyed import probe

#: (rule, verdict); a rule is a host, which also stands for its subdomains, and the start of a path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
_START, _STOP = "\x02", "\x03"


@dataclass(frozen=True)
class UrlParameters:
    order: int = 4  # characters of context
    alphabet: int = 256
    folds: int = 5
    thresholds: int = 201


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def address_of(url: Column) -> Column:
    """What the models read: the host and everything after it; a text without ``://`` is read as it is."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*(.*)\z", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), rest)).otherwise(url)


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or NULL."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, start = rule.split("/", 1)
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{start}"))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _windows(url: str, p: UrlParameters) -> Column:
    """Every character of a URL with its context; the first ones are preceded by start marks."""
    marked = F.concat(F.lit(_START * p.order), url, F.lit(_STOP))
    return F.regexp_extract_all(marked, F.lit(f"(?s)(?=(.{{{p.order + 1}}}))"), F.lit(1))


def _counted(windows: DataFrame, p: UrlParameters) -> tuple[DataFrame, DataFrame]:
    """Counts of all n-grams in either model, and totals and numbers of kinds of their contexts."""
    both = [F.sum("allow").alias("allow"), F.sum("block").alias("block")]
    lengths = F.explode(F.sequence(F.lit(1), F.lit(p.order + 1))).alias("length")
    grams = (windows.select("window", "allow", "block", lengths)
             .groupBy(F.expr("right(window, length)").alias("gram")).agg(*both))
    contexts = (grams.groupBy(F.expr("left(gram, length(gram) - 1)").alias("context"))
                .agg(F.sum("allow").alias("of_allow"), F.sum("block").alias("of_block"),
                     F.count_if(F.col("allow") > 0).alias("kinds_allow"), F.count_if(F.col("block") > 0).alias("kinds_block")))
    return grams, contexts


def _ratios(needed: DataFrame, grams: DataFrame, contexts: DataFrame, p: UrlParameters) -> DataFrame:
    """``window`` and the logarithm of the ratio of its last character's two probabilities."""
    lengths = F.explode(F.sequence(F.lit(1), F.lit(p.order + 1))).alias("length")
    steps = needed.select("window", lengths).withColumn("gram", F.expr("right(window, length)"))
    steps = probe(steps.withColumn("context", F.expr("left(gram, length - 1)")), grams, "gram", "left")
    steps = probe(steps, contexts, "context", "left")
    fields = ["allow", "block", "of_allow", "of_block", "kinds_allow", "kinds_block"]
    by_length = steps.groupBy("window").agg(F.sort_array(F.collect_list(F.struct(
        "length", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in fields]))).alias("steps"))  # order + 1 of them

    def probability(model: str) -> Column:
        return F.expr(f"""aggregate(steps, CAST({1.0 / p.alphabet} AS DOUBLE), (p, s) ->
            IF(s.of_{model} > 0, (s.{model} + s.kinds_{model} * p) / (s.of_{model} + s.kinds_{model}), p))""")

    return by_length.select("window", (F.log(probability("allow")) - F.log(probability("block"))).alias("ratio"))


def judged_urls(pages: DataFrame, rules=RULES, p: UrlParameters = UrlParameters()) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``ratio`` (log-likelihood difference per character)."""
    urls = pages.select(F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                        address_of(F.col("url")).alias("address"))
    urls = urls.withColumn("rule", ruled(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for pair in rules for x in pair])
    distinct = (urls.groupBy("address", "host", "path", "rule").agg(F.count("*").alias("n"))
                .withColumn("by_rule", F.when(F.col("rule").isNotNull(), F.element_at(verdicts, F.col("rule"))))
                .withColumn("fold", F.pmod(F.xxhash64("address"), F.lit(p.folds))))
    windows = (distinct.select("address", "host", "by_rule", "fold", "n", F.explode(_windows("address", p)).alias("window")))
    trained = F.col("by_rule").isNotNull() & (F.col("fold") > 0)
    counts = durable(windows.groupBy("window").agg(*[
        F.coalesce(F.sum(F.when(trained & (F.col("by_rule") == v), F.col("n"))), F.lit(0)).alias(v) for v in ("allow", "block")]))
    grams, contexts = _counted(counts.filter("allow > 0 OR block > 0"), p)
    ratios = _ratios(counts.select("window"), durable(grams), durable(contexts), p)
    scored = (probe(windows.select("host", "address", "window"), ratios, "window").groupBy("host", "address")
              .agg(F.avg("ratio").alias("ratio")))
    scored = durable(distinct.join(scored, ["host", "address"]))

    judged = scored.filter("by_rule IS NOT NULL")
    kinds = {r["by_rule"] for r in judged.select("by_rule").distinct().collect()}
    if len(kinds) < 2:
        threshold = float("-inf") if kinds <= {"allow"} else float("inf")
    else:
        threshold = _threshold(judged.filter("fold = 0"), p)
    by_ratio = F.when(F.col("ratio") >= F.lit(threshold), "allow").otherwise("block")
    verdict = F.coalesce("by_rule", by_ratio).alias("verdict")
    scored = scored.select("host", "address", verdict, "ratio")
    return (probe(urls.select("page_id", "host", "path", "rule", "address"), scored, ["host", "address"])
            .select("page_id", "host", "path", "rule", "verdict", "ratio"))


def _threshold(held: DataFrame, p: UrlParameters) -> float:
    """The lowest evenly spaced threshold with the highest balanced accuracy; 0 where a kind is missing."""
    range_ = held.agg(F.min("ratio").alias("low"), F.max("ratio").alias("high"),
                      *[F.coalesce(F.sum(F.when(F.col("by_rule") == v, F.col("n"))), F.lit(0)).alias(v) for v in ("allow", "block")]).first()
    if not range_["allow"] or not range_["block"]:
        return 0.0
    width = (range_["high"] - range_["low"]) / (p.thresholds - 1) or 1.0
    bins = held.groupBy(F.floor((F.col("ratio") - range_["low"]) / width).alias("bin"), "by_rule").agg(F.sum("n").alias("n"))
    best, allow, block = (-1.0, 0), range_["allow"], 0
    table = {(r["bin"], r["by_rule"]): r["n"] for r in bins.collect()}  # at most ``thresholds`` bins of two kinds
    for k in range(p.thresholds):
        accuracy = allow / range_["allow"] + block / range_["block"]
        best = max(best, (accuracy, -k))
        allow -= table.get((k, "allow"), 0)
        block += table.get((k, "block"), 0)
    return range_["low"] - best[1] * width
