"""URL filtering by rules and by the reputation of hosts.

Labelled outcomes of pages are counted per host. The share of bad pages of a suffix is shrunk towards that of all
pages, that of a registered domain towards its suffix, and that of a host towards its domain: each level is a
beta-binomial whose prior mean is the posterior mean of the level above, and whose concentration is fitted by moments
to all members of the level. A host is blocked when even the lower bound of its posterior is above the limit. A host
without outcomes is judged by what its domain, else its suffix, else all pages say of a new host, with the spread of
every level on the way down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from twinfinder.session import checkpointed

# Overdispersion is kept within these bounds, so that priors count for something and never for everything.
LEAST_RHO, MOST_RHO = 0.001, 0.5

# Labels by which countries sort the names under them.
TWO_LABELS = r"^(?:ac|co|com|edu|go|gob|gov|ltd|mil|ne|net|nom|or|org|plc|sch)\.[a-z]{2}$"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _name(host: Column) -> Column:
    """A host without user, port and closing dot."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$", "")


def _numeric(name: Column) -> Column:
    return name.rlike(r"^[0-9.]+$|^\[")


def suffix(host: Column) -> Column:
    """The part under which strangers register names: the last label, or two under countries that sort names by kind.

    All numeric hosts share the empty suffix.
    """
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    return F.when(_numeric(name), "").when(two.rlike(TWO_LABELS), two).otherwise(F.substring_index(name, ".", -1))


def registered_domain(host: Column) -> Column:
    """The suffix of a host and one label more, or all there is; a numeric host as it is."""
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    return F.when(_numeric(name), name).when(two.rlike(TWO_LABELS), F.substring_index(name, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its action; rules are (action, `host/path`)."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):
        of, _, rest = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + rest)
        name, action = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(action)
    return name, action


def _rho(level: DataFrame) -> float:
    """Overdispersion of counts (`n`, `bad`) around their prior means, by moments."""
    spread = F.col("mean") * (1 - F.col("mean"))
    found = level.agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col("mean"), 2) - F.col("n") * spread).alias("over"),
        F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("scale"),
    ).first()
    rho = found["over"] / found["scale"] if found["scale"] else 0.0
    return min(MOST_RHO, max(LEAST_RHO, rho))


def host_reputation(outcomes: DataFrame, host: str = "host", bad: str = "bad", z: float = 1.645) -> DataFrame:
    """One row per host: `n`, `bad` pages, `mean` and `bound` (lower) of the posterior share of bad pages.

    `domain` and `suffix` are those of the host without user and port; `domain_bound`, `suffix_bound` and `all_bound` are the bounds of a host
    without outcomes in the domain, in another domain of the suffix, and elsewhere.
    `outcomes` has a host and 0 or 1 per labelled page; null outcomes and null hosts take no part. The counts are
    aggregated before anything is joined, so no host is too large. Without outcomes the table is empty.
    """
    known = outcomes.filter(F.col(bad).isNotNull() & F.col(host).isNotNull())
    hosts = known.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(bad).cast("bigint")).alias("bad"))
    hosts = checkpointed(hosts.withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))}))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = (total["bad"] + 0.5) / (total["n"] + 1.0) if total["n"] else 0.5
    means, above_host, rhos = None, {}, {}
    for level, above in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        keys = [level] if above is None else [level, above]
        counts = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        if means is None:
            counts = counts.withColumn("mean", F.lit(overall))
        else:
            counts = counts.join(means, above)
        counts = checkpointed(counts)
        rhos[level] = _rho(counts)
        weight = 1.0 / rhos[level] - 1.0
        a, b = F.col("mean") * weight + F.col("bad"), (1 - F.col("mean")) * weight + F.col("n") - F.col("bad")
        counts = counts.withColumns({"a": a, "b": b})
        means = counts.select(level, (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))
        above_host[level] = counts.select(level, (a / (a + b)).alias("_mean"), (a + b).alias("_size"))
    size = F.col("a") + F.col("b")
    mean = F.col("a") / size

    deviation = F.sqrt(mean * (1 - mean) / (size + 1))
    counts = counts.select("host", "n", "bad", "domain", mean.alias("mean"), (mean - z * deviation).alias("bound"))
    counts = counts.withColumn("suffix", suffix(F.col("host")))

    def of_new(mean: Column, sure: Column | float) -> Column:
        # `sure` is the product of 1 - rho of all levels between the mean and the host.
        return mean - z * F.sqrt(mean * (1 - mean) * (1 - sure))

    sure = 1 - rhos["host"]
    for level in ("domain", "suffix"):
        bound = of_new(F.col("_mean"), (1 - 1 / (F.col("_size") + 1)) * sure)
        counts = counts.join(above_host[level].select(level, bound.alias(f"{level}_bound")), level)
        sure *= 1 - rhos[level]
    return counts.withColumn("all_bound", of_new(F.lit(overall), sure))


def bounds_of(hosts: DataFrame, reputation: DataFrame) -> DataFrame:
    """`_host` and `bound` of every distinct host of `hosts`; null for the empty host, and for all without outcomes at all."""
    found = hosts.select(F.col("host").alias("_host")).distinct()
    found = found.withColumns({"_domain": registered_domain(F.col("_host")), "_suffix": suffix(F.col("_host"))})
    found = found.join(reputation.select(F.col("host").alias("_host"), "bound"), "_host", "left")
    for level in ("domain", "suffix"):
        bound = F.first(f"{level}_bound").alias(f"_{level}_bound")  # one value in the group
        found = found.join(reputation.groupBy(F.col(level).alias(f"_{level}")).agg(bound), f"_{level}", "left")
    found = found.crossJoin(F.broadcast(reputation.agg(F.first("all_bound").alias("_all_bound"))))
    unseen = F.when(F.col("_host") != "", F.coalesce("_domain_bound", "_suffix_bound", "_all_bound"))
    return found.select("_host", F.coalesce("bound", unseen).alias("bound"))


def judge_urls(
    pages: DataFrame, reputation: DataFrame, rules: list[tuple[str, str]], limit: float, url: str = "url"
) -> DataFrame:
    """`pages` with `host`, `path`, `rule`, `verdict` and the `bound` of the host.

    A fitting rule decides, else the host is blocked if its bound is above `limit`. A host without outcomes has the
    bound of its domain, else of its suffix, else of all pages. The empty host has none without outcomes of its own,
    and is allowed. Null urls have an empty host and path. Columns of these names are replaced.
    """
    new = ("host", "path", "rule", "verdict", "bound")
    kept = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in new], url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    # Stored, so that the planner knows its size.
    bounds = checkpointed(bounds_of(kept, reputation))
    joined = kept.join(bounds, F.col("host") == F.col("_host"), "left").drop("_host")
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return joined.withColumn("rule", rule).withColumn("verdict", F.coalesce(action, method))
