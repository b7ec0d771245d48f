"""Operator 7, URL filter: rules first, then the ratio of two character language models.

Rules name a host and the start of a path; a rule fits its host and all subdomains, and the longest that fits decides. URLs that
no rule fits are judged by two smoothed variable-order Markov models, of accepted and of rejected URLs, trained on the URLs
that rules decide: P_k(c | last k characters) = (n + ``WEIGHT`` * P_{k-1}) / (N + ``WEIGHT``), k from ``ORDER`` to 0, then uniform.
The score is the mean log-likelihood difference per character; the threshold is calibrated on labelled URLs held out by hash, so
that ``KEEP`` of the allowed ones pass: a URL is blocked for what it shows, not for want of likeness to allowed ones.

The rules label the training URLs, so the models must not read what the rules read: labels of a host and starts of a path that
any rule names (``masked``) are left out of every URL, of labelled and judged ones alike. What remains, such as the other labels
of the host, is evidence that carries over to URLs that no rule decides.

Characters are mapped to ``len(ALPHABET) + 3`` symbols, so there are at most 40 ** (ORDER + 1) n-grams however many URLs there are.
Counts of all n-grams over all URLs are combined before the shuffle; all lower orders are sums over that one bounded table
(windows, the grand total a one-row aggregate). The finished table, n-gram to log ratio, is what is broadcast: 155 MB
measured for all 2 560 000 n-grams at once, as they are numbered without gaps for it (352 MB as texts). A URL's characters never leave their task unsummed.

Defined results: null url or one without ``://``: host and path empty, no rule; its characters (none for null) are judged all the
same. Without URLs of both labels every unruled URL is allowed. Each input row gives one row, whatever its page_id;
very long URLs are judged whole; a score equal to the bound is allowed; an empty table gives no rows; columns other than
page_id and url, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import ascii_lower, cut

#: Fixed values of the contract: action, host and start of path, as written.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
ALPHABET = string.ascii_lowercase + "0./?=&_:#%-"
ORDER, WEIGHT, HELD, STEP = 3, 4.0, "012", 100  # held out: URLs whose MD5 starts with one of these digits
#: Share of the held-out allowed URLs that must pass.
KEEP = 0.98


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """The longest rule that fits and its action; null where none does."""
    rule = action = F.lit(None).cast("string")
    for act, text in sorted(rules or RULES, key=lambda r: len(r[1])):
        own, _, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def masks(rules=None) -> tuple[str | None, str | None]:
    """Patterns of what the rules name: runs of labels in a host put between dots, and runs of starts of a path."""
    parts = [text.partition("/") for _, text in rules or RULES]
    either = lambda texts: "|".join(re.escape(t) for t in sorted(texts, key=lambda t: (-len(t), t)))
    labels = {label for own, _, _ in parts for label in own.split(".") if label}
    starts = {start for _, _, start in parts if start}
    return rf"\.(?:(?:{either(labels)})\.)+" if labels else None, f"^/(?:{either(starts)})+" if starts else None


def masked(url: Column, host: Column, rules=None) -> Column:
    """The url without the labels of its host and the starts of its path that any rule names; its host stands between dots."""
    labels, starts = masks(rules)
    at = F.locate("://", url) + 2
    own = F.concat(F.lit("."), host, F.lit("."))
    rest = F.substring(url, at + F.length(host) + 1, F.length(url))
    own = F.regexp_replace(own, labels, ".") if labels else own
    rest = F.regexp_replace(rest, starts, "/") if starts else rest
    return F.when(at > 2, F.concat(F.substring(url, F.lit(1), at), own, rest)).otherwise(url)


def symbols(url: Column) -> Column:
    """The url in the models' alphabet: ``ORDER`` start marks, then its characters, then the end mark."""
    plain = F.regexp_replace(F.regexp_replace(ascii_lower(F.coalesce(url, F.lit(""))), "[0-9]", "0"), r"[^a-z0./?=&_:#%\-]", "*")
    return F.concat(F.lit("^" * ORDER), plain, F.lit("$"))


def _grams(df: DataFrame) -> DataFrame:
    text = F.col("_symbols")
    return df.withColumn("_i", F.explode_outer(F.sequence(F.lit(1), F.length(text) - ORDER))).withColumn("_gram", F.substring(text, F.col("_i"), F.lit(ORDER + 1)))


def _number(gram: Column) -> Column:
    """An n-gram as a number below (len(ALPHABET) + 3) ** (ORDER + 1)."""
    every = F.lit(ALPHABET + "^$*")
    digits = [F.instr(every, F.substring(gram, i + 1, 1)) - 1 for i in range(ORDER + 1)]
    return reduce(lambda number, digit: number * (len(ALPHABET) + 3) + digit, digits)


def model(labelled: DataFrame) -> DataFrame:
    """_gram, full, fit: log ratios of the models of all labelled URLs and of those not held out, for every n-gram that occurs."""
    sums = {f"{c}{f}": F.sum(((F.col("_action") == a) & (F.lit(f == "full") | ~F.col("_held"))).cast("int")) for c, a in (("a", "allow"), ("r", "block")) for f in ("full", "fit")}
    table = _grams(labelled).groupBy("_gram").agg(*[F.coalesce(v, F.lit(0)).alias(k) for k, v in sums.items()])
    g, size = F.col("_gram"), ORDER + 1

    def summed(key: Column) -> list[Column]:
        return [F.sum(k).over(W.partitionBy(key)) for k in sums]

    names = list(sums)
    table = cut(table)
    table = table.join(F.broadcast(table.agg(*[F.sum(c).alias(f"all_{c}") for c in names])))  # the grand totals, one row
    odds = dict.fromkeys(sums, F.lit(1.0 / (len(ALPHABET) + 3)))
    for k in range(size):
        key, context = F.right(g, F.lit(k + 1)), F.substring(g, size - k, k)
        n = summed(key) if k < ORDER else [F.col(c) for c in names]
        total = summed(context) if k else [F.col(f"all_{c}") for c in names]
        table = table.select("_gram", *names, *[((n[i] + WEIGHT * odds[c]) / (total[i] + WEIGHT)).alias(f"p_{c}") for i, c in enumerate(names)])
        odds = {c: F.col(f"p_{c}") for c in names}
    return table.select("_gram", *[(F.log("p_a" + f) - F.log("p_r" + f)).alias(f) for f in ("full", "fit")])


def _threshold(scored: DataFrame) -> float:
    """The highest held-out score that at least ``KEEP`` of the held-out allowed URLs reach, halfway to the next lower score."""
    at = F.round(F.col("_fit") * STEP).cast("int").alias("s")  # a row for each hundredth
    rows = scored.where("_held and _action is not null").groupBy(at, "_action").count().collect()
    good = {r["s"]: r["count"] for r in rows if r["_action"] == "allow"}
    if not good or len(good) == len(rows):
        return float("-inf")
    total, scores = sum(good.values()), sorted({r["s"] for r in rows})
    best = max(t for t in scores if sum(n for s, n in good.items() if s >= t) / total >= KEEP)
    return (best + max((s for s in scores if s < best), default=best - 1)) / 2 / STEP


def judge(pages: DataFrame, rules=None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (mean log ratio per character; null for rows that a rule decides)."""
    u = F.col(url).cast("string")
    own = pages.select(F.col(page_id).alias("page_id"), u.alias("url")).select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    held = F.substring(F.md5("url"), 1, 1).isin(list(HELD))
    own = own.select("page_id", "host", "path", rule.alias("rule"), action.alias("_action"), F.coalesce(held, F.lit(False)).alias("_held"), symbols(masked(F.col("url"), F.col("host"), rules)).alias("_symbols"))
    ratios = cut(model(own).withColumn("_gram", _number(F.col("_gram"))))  # at most (len(ALPHABET) + 3) ** (ORDER + 1) rows
    grams = _grams(own.withColumn("_row", F.monotonically_increasing_id())).withColumn("_gram", _number(F.col("_gram")))
    at = grams.join(F.broadcast(ratios), "_gram", "left")
    keep = ["page_id", "host", "path", "rule", "_action", "_held"]
    first = [F.first(F.when(F.col("_i") == 1, F.col(c)), ignorenulls=True).alias(c) for c in keep]
    scored = cut(at.groupBy("_row").agg(*first, F.avg("full").alias("_full"), F.avg("fit").alias("_fit")))
    bound = _threshold(scored)
    verdict = F.coalesce("_action", F.when(F.col("_full") < bound, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("_full")).alias("score"))
