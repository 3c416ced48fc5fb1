"""URL filters: fixed rules, and hosts' reputation by empirical Bayes. DataFrame functions only.

Pages with a known outcome (bad or not) are counted per host. The share of bad pages is shrunk through beta-binomial
priors from the whole to suffix, to registered domain, to host: a group's prior has its parent's posterior mean and a
strength that the method of moments finds from how much groups differ within their parents. A page is blocked if the
lower bound of its host's posterior exceeds ``most_bad``: if the beta posterior leaves a chance of less than ``1 - sure`` that the host's bad share is
below it. So few labelled pages never block a host; the share that a corpus has anyway is no reason either, so ``most_bad`` is to lie above it.

Counts are summed in the map tasks, so a host with a third of all pages costs one row a task. Scores join pages by host
(adaptive execution splits a hot host; the scores are broadcast only if their counted number is small).

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and the reputation of the empty
host; null or missing outcomes don't count; repeated pages are judged each on its own, and repeated outcomes of a page
count as often as they come; null page ids have no outcome; very long urls are read whole; other columns are not looked at,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.plans.tables import cut, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Labels that form a suffix together with a country's label.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def levels(name: Column) -> tuple[Column, Column]:
    """A host's registered domain and suffix. Addresses of digits are their own domain, with an empty suffix."""
    bare = F.regexp_replace(F.regexp_replace(name, r"^.*@", ""), r":\d*$", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    two = (n >= 3) & F.element_at(labels, -2).isin(*SECOND_LEVEL) & (F.length(F.element_at(labels, -1)) == 2)
    width = F.when(two, 2).otherwise(1)
    digits = bare.rlike(r"^[0-9.]+$") | bare.startswith("[")
    suffix = F.array_join(F.slice(labels, F.greatest(n - width + 1, F.lit(1)), width), ".")
    domain = F.array_join(F.slice(labels, F.greatest(n - width, F.lit(1)), width + 1), ".")
    return F.when(digits, bare).otherwise(domain), F.when(digits, F.lit("")).otherwise(suffix)


def rule_for(name: Column, where: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of ``rules`` (verdict, ``host/path``) that fits, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        top, _, rest = rule.partition("/")
        fits = ((name == top) | name.endswith("." + top)) & where.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _shrunk(groups: DataFrame, parents: DataFrame, parent: str, key: str) -> DataFrame:
    """``key, n, bad`` with its parent's ``mean``, as ``mean`` and ``strength`` of the group's own posterior."""
    g = groups.join(parents.select(F.col(parent), F.col("mean").alias("prior")), parent)
    part = F.col("prior") * (1 - F.col("prior"))
    moments = g.filter("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), F.lit(2.0))).alias("seen"), F.sum(part).alias("chance"), F.sum((F.col("n") - 1) * part).alias("room")
    )
    likeness = F.when(F.col("room") > 0, (F.col("seen") - F.col("chance")) / F.col("room")).otherwise(0.0)
    strength = moments.select((1 / F.least(F.lit(0.9), F.greatest(F.lit(0.001), F.coalesce(likeness, F.lit(0.001)))) - 1).alias("strength"))
    g = g.crossJoin(F.broadcast(strength))  # one row
    return g.withColumn("mean", (F.col("strength") * F.col("prior") + F.col("bad")) / (F.col("strength") + F.col("n")))


#: Intervals of Simpson's rule on either side of the bound.
STEPS = 64


def chance_below(a: str, b: str, x: float, *, total: str, array: str) -> tuple[list[tuple[str, str]], str]:
    """The chance that a share with the density Beta(a, b) is below ``x``, in SQL: columns to add one after the other, and the result.

    Over the log-odds ``u`` the density is ``exp(g(u))`` with ``g`` concave and its top at ``log(a / b)``. Simpson's rule
    runs over either side of ``x`` in steps that grow as sinh away from the top, where 40 units below it nothing is left; the ratio of both needs
    no gamma functions, and is exact to some eight digits for shares of any strength. ``total(f)`` of a list and ``array(i)`` of 0..2 * STEPS spell lists.
    """
    edge = math.log(x / (1 - x))
    soft = lambda u: f"(greatest({u}, 0.0) + ln(1 + exp(-abs({u}))))"
    columns = [
        ("_a", a),
        ("_b", b),
        ("_c", "sqrt((_a + _b) / (_a * _b))"),  # the spread about the top
        ("_u", "ln(_a / _b)"),
        ("_top", f"-_a * {soft('-_u')} - _b * {soft('_u')}"),
        ("_low", "-ln((9.0 * _c + 40.0 / _a) / _c + sqrt(power((9.0 * _c + 40.0 / _a) / _c, 2) + 1))"),
        ("_high", "ln((9.0 * _c + 40.0 / _b) / _c + sqrt(power((9.0 * _c + 40.0 / _b) / _c, 2) + 1))"),
        ("_t", f"({edge!r} - _u) / _c"),
        ("_at", "least(_high, greatest(_low, CASE WHEN _t < 0 THEN -1.0 ELSE 1.0 END * ln(abs(_t) + sqrt(_t * _t + 1))))"),
    ]

    def side(low: str, high: str) -> str:
        z = f"({low} + ({high} - {low}) * i / {2 * STEPS}.0)"
        u = f"(_u + _c * (exp({z}) - exp(-{z})) / 2)"
        weight = f"(CASE WHEN i = 0 OR i = {2 * STEPS} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)"
        f = f"{weight} * (exp({z}) + exp(-{z})) * exp(-_a * {soft(f'-{u}')} - _b * {soft(u)} - _top)"
        return f"({high} - {low}) * {total.format(f=f, array=array.format(last=2 * STEPS))}"

    left, right = side("_low", "_at"), side("_at", "_high")
    return columns, f"{left} / ({left} + {right})"


def reputations(hosts: DataFrame, most_bad: float) -> DataFrame:
    """``host, mean, below`` from ``host, domain, suffix, n, bad``; ``below``: the chance that its bad share is below ``most_bad``."""
    total = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0)) + 2.0)).alias("mean")).withColumn("all", F.lit(0))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("all", F.lit(0))
    suffixes = cut(_shrunk(suffixes, total, "all", "suffix"), "suffixes")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = cut(_shrunk(domains, suffixes, "suffix", "domain"), "domains")
    own = cut(_shrunk(hosts, domains.drop("suffix"), "domain", "host").select("host", "n", "bad", "mean", "strength"), "own")
    # hosts of equal counts and priors have equal chances; most hosts share theirs with many
    kinds = own.select("n", "bad", "mean", "strength").distinct()
    columns, below = chance_below("mean * (strength + n)", "(1 - mean) * (strength + n)", most_bad, total="aggregate({array}, 0.0D, (s, i) -> s + {f})", array="sequence(0, {last})")
    for name, expr in columns:
        kinds = kinds.withColumn(name, F.expr(expr))
    kinds = kinds.select("n", "bad", "mean", "strength", F.expr(below).alias("below"))
    return own.join(kinds, ["n", "bad", "mean", "strength"]).select("host", "mean", "below")


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], *, most_bad: float = 0.2, sure: float = 0.95, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, mean, below``; ``outcomes`` has ``page_id, bad`` (0, 1 or null)."""
    named = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    named = cut(named, "hosts")
    known = outcomes.filter("bad IS NOT NULL").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    counted = named.join(known, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    domain, suffix = levels(F.col("host"))
    hosts = cut(counted.withColumns({"domain": domain, "suffix": suffix}), "host-counts")
    scores = cut(reputations(hosts, most_bad), "reputations")
    judged = named.join(small(scores, scores.count()), "host", "left")
    rule = rule_for(F.col("host"), F.col("path"), rules)
    kind = F.create_map(*[F.lit(x) for verdict, r in rules for x in (r, verdict)]).cast("map<string,string>")
    method = F.when(F.col("below") < 1 - sure, "block").otherwise("allow")
    return judged.withColumn("rule", rule).select("page_id", "host", "path", "rule", F.coalesce(kind[F.col("rule")], method).alias("verdict"), "mean", "below")
