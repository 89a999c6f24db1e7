"""Mixing sources to target weights, by budgets that flow down a tree of domains, languages and sources.

Every node shares its tokens among its children by weight. A child cannot take more than its own tokens times the
number of epochs that are allowed; what it lacks goes to its siblings, and only what all of them together lack is
missing at the parent, whose siblings take it. A child of weight 0 takes nothing, so its tokens are no room of its
parent either. A leaf gives its whole documents for every full epoch, and for the rest
the longest prefix of documents, in the seeded order of that epoch, whose tokens fit.

All columns are computed by Spark's own functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinfinder.session import checkpointed

BUCKET_DOCS = 1024
# A plan of at most so many leaves is broadcast to the documents; a larger one is joined by shuffling.
BROADCAST_LEAVES = 20_000


@dataclass(frozen=True)
class Mixture:
    """Levels from the top of the tree down, each with the weights of its values (others weigh `other`).

    `share` is the budget as a share of all tokens, `epochs` how often a document may be used, at most.
    """

    levels: dict[str, dict[str, float]]
    share: float = 0.5
    epochs: int = 4
    seed: int = 0
    other: float = 1.0
    names: list[str] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "names", list(self.levels))

    def weight(self, level: str) -> Column:
        known = self.levels[level]
        if not known:
            return F.lit(self.other)
        found = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        return F.coalesce(F.try_element_at(found, F.col(f"_{level}")), F.lit(self.other)).cast("double")


def count_words(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _fill(children: DataFrame, parents: list[str], name: str, weight: Column) -> DataFrame:
    """Share each parent's `_allot` among its children up to their `_room`, as `_allot` of the children.

    In the order of room per weight those that cannot take their share come first. The others share what is left.
    """
    table = children.withColumn("_w", F.when(F.col("_room") > 0, F.greatest(weight, F.lit(0.0))).otherwise(0.0))
    used = F.col("_w") > 0
    table = table.withColumn("_ratio", F.when(used, F.col("_room") / F.col("_w")))
    order = Window.partitionBy(*parents).orderBy(F.col("_ratio").asc_nulls_last(), F.col(name))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("_allot") - F.coalesce(F.sum("_room").over(before), F.lit(0))
    table = table.withColumn("_level", F.when(used, left / F.sum("_w").over(onwards)))
    full = F.col("_room") <= F.col("_w") * F.col("_level")
    table = table.withColumn("_full", F.coalesce(full, F.lit(False)))
    common = F.max(F.when(~F.col("_full"), F.col("_level"))).over(Window.partitionBy(*parents))
    share = F.when(F.col("_full"), F.col("_room")).when(used, F.floor(F.col("_w") * common)).otherwise(0)
    return table.withColumn("_allot", F.least(share, F.col("_room")).cast("bigint")).drop("_w", "_ratio", "_level", "_full")


def leaf_budgets(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """Leaves (`_<level>` columns, `_supply`, `_docs`) with their tokens `_allot`, whole epochs and rest."""
    keys = [f"_{n}" for n in mixture.names]
    # `_room<d>` is what a leaf gives to its ancestor at depth d (0: the root): nothing through a node of weight 0.
    room, rooms = F.col("_supply") * mixture.epochs, []
    for name in reversed(mixture.names):
        rooms.append(room)
        room = F.when(mixture.weight(name) > 0, room).otherwise(0)
    rooms = [r.cast("bigint").alias(f"_room{d}") for d, r in enumerate([room, *reversed(rooms)])]
    leaves = leaves.select(*keys, "_supply", "_docs", *rooms)
    budget = leaves.agg(
        F.least(F.floor(F.sum("_supply") * mixture.share), F.sum("_room0")).cast("bigint").alias("budget")
    ).first()["budget"]
    nodes, parents = None, []
    for depth, name in enumerate(mixture.names):
        here = keys[: depth + 1]
        level = leaves.groupBy(*here).agg(F.sum(f"_room{depth + 1}").alias("_room"))
        if nodes is None:
            level = level.withColumn("_allot", F.lit(budget or 0).cast("bigint"))
        else:
            level = level.join(nodes.select(*parents, "_allot"), parents)
        nodes, parents = _fill(level, parents, f"_{name}", mixture.weight(name)), here
    plan = leaves.select(*keys, "_supply", "_docs").join(nodes.select(*keys, "_allot"), keys)
    supply = F.greatest("_supply", F.lit(1))
    whole = F.floor(F.col("_allot") / supply)
    return plan.withColumn("_whole", whole.cast("int")).withColumn("_rest", F.col("_allot") - whole * supply)


def _order_key(mixture: Mixture, doc: str) -> Column:
    """Place of a document in the partial epoch of its leaf."""
    parts = [F.lit(str(mixture.seed)), F.col("_whole").cast("string"), F.coalesce(F.col(doc).cast("string"), F.lit(""))]
    return F.md5(F.concat_ws("|", *parts))


def mixing_plan(rows: DataFrame, mixture: Mixture, doc: str) -> DataFrame:
    """The plan of every leaf: `_whole` epochs, and `_cut`, the last order key of the partial one.

    `rows` has `doc`, `_<level>` columns and `_n`, the tokens; it is read three times. The cut is found in two steps:
    among sums of about BUCKET_DOCS documents, and then within the one bucket where the rest of the budget ends, so
    that no leaf is sorted whole.
    """
    keys = [f"_{n}" for n in mixture.names]
    leaves = rows.groupBy(*keys).agg(F.sum("_n").alias("_supply"), F.count("*").alias("_docs"))
    plan = checkpointed(leaf_budgets(checkpointed(leaves), mixture))
    digits = F.ceil(F.log(16.0, F.greatest(F.col("_docs") / BUCKET_DOCS, F.lit(1.0)))).cast("int")
    partial = plan.filter(F.col("_rest") > 0).withColumn("_digits", digits)
    keyed = _with_plan(rows, partial, keys, "inner", plan.count()).withColumn("_key", _order_key(mixture, doc))
    keyed = keyed.withColumn("_bucket", F.substring("_key", F.lit(1), F.col("_digits")))
    sums = keyed.groupBy(*keys, "_rest", "_bucket").agg(F.sum("_n").alias("_n"))
    until = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket"))
    ends = sums.withColumn("_until", until).filter(F.col("_until") > F.col("_rest"))
    ends = ends.groupBy(*keys).agg(F.min(F.struct("_bucket", (F.col("_until") - F.col("_n")).alias("_before"))).alias("_end"))
    ends = checkpointed(ends.select(*keys, F.col("_end._bucket").alias("_bucket"), F.col("_end._before").alias("_before")))
    inside = _with_plan(keyed, ends, [*keys, "_bucket"], "inner", ends.count())
    # Equal keys (a repeated id) are taken together or not at all.
    so_far = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_key"))
    last = inside.withColumn("_so_far", so_far).filter(F.col("_before") + F.col("_so_far") <= F.col("_rest"))
    last = last.groupBy(*keys).agg(F.max("_key").alias("_last"))
    cuts = ends.join(last, keys, "left").select(*keys, F.coalesce("_last", "_bucket").alias("_cut"))
    return checkpointed(plan.join(cuts, keys, "left").select(*keys, "_allot", "_whole", "_cut"))


def _with_plan(rows: DataFrame, plan: DataFrame, keys: list[str], how: str, count: int) -> DataFrame:
    return rows.join(F.broadcast(plan) if count <= BROADCAST_LEAVES else plan, keys, how)


def mix(
    docs: DataFrame, levels: dict[str, Column], mixture: Mixture, doc: str = "doc_id", tokens: Column | None = None,
    text: str = "text",
) -> DataFrame:
    """The chosen rows of `docs`, once for every epoch they are used in, with `mix_epoch` counting from 0.

    `levels` gives the column of every level of the mixture; null values are one value, the empty string. `tokens`
    defaults to the words of `text`. Documents without tokens cost nothing and go with their neighbours in the order.
    Empty tables give no rows. All other columns of `docs` are kept; one called mix_epoch is replaced.
    """
    named = {f"_{n}": F.coalesce(levels[n].cast("string"), F.lit("")) for n in mixture.names}
    words = count_words(F.col(text)) if tokens is None else F.coalesce(tokens.cast("bigint"), F.lit(0))
    rows = checkpointed(docs.select(F.col(doc).alias("_doc"), *[c.alias(n) for n, c in named.items()], words.alias("_n")))
    plan = mixing_plan(rows, mixture, "_doc")
    kept = [c for c in docs.columns if c != "mix_epoch"]
    inner = {f"_x{i}": F.col(f"`{c}`") for i, c in enumerate(kept)}
    found = docs.select(F.col(doc).alias("_doc"), *[c.alias(n) for n, c in {**inner, **named}.items()])
    found = _with_plan(found, plan, list(named), "inner", plan.count())
    partial = (F.col("_cut").isNotNull() & (_order_key(mixture, "_doc") <= F.col("_cut"))).cast("int")
    found = found.withColumn("_times", F.col("_whole") + partial).filter(F.col("_times") > 0)
    found = found.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    return found.select(*[F.col(n).alias(c) for n, c in zip(inner, kept)], F.col("_epoch").alias("mix_epoch"))
