"""Mixing sources to target weights by budgets that run down a domain-language-source tree.

A node gets its share of its parent's tokens by weight, at most what its documents can give in
``max_epochs`` passes. What a node cannot take goes to its siblings by weight; as a parent is only given what
its children can take together, an ancestor's siblings share it only once all siblings are full.
Each leaf then takes the first tokens, up to its budget, of its documents in the seeded order of
epoch 0, then epoch 1 and so on.

Everything is integer arithmetic in DataFrame operations: shares are rounded down, so a node may lose
less than a token per child. A leaf of any size is spread over hash ranges of about ``UNITS_PER_RANGE`` documents:
ranges are summed first, those past the budget are dropped, and running sums stay
within a range.

Defined results: rows of one leaf that share an id are one document, taken or left together; null
ids, domains, languages and sources are values of their own; a null text has 0 tokens; a document
is taken if its first token lies within the budget, so the last one may reach past it (``take`` says how
many of its tokens count); a node of weight 0 gets nothing; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytally.sinks.sketch_store import stored

PATH = ["domain", "lang", "source"]
UNITS_PER_RANGE = 4_096
WORDS = r"[^\x20\x09-\x0D]+"
#: Weights of the production mix; nodes that are not named weigh DEFAULT_WEIGHT.
WEIGHTS = {
    ("d0",): 40,
    ("d1",): 30,
    ("d2",): 20,
    ("d3",): 10,
    ("d0", "en"): 4,
    ("d1", "en"): 2,
}
DEFAULT_WEIGHT = 1
MANY = "decimal(38,0)"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_domain(source: Column) -> Column:
    """The domain of a source: the number at its end modulo 4; ``other`` without one."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), number.cast("int") % 4)).otherwise("other")


def _weight(weights: dict[tuple, int], path: list[str]) -> Column:
    """The weight of a node by its path, as a column."""
    value = F.lit(DEFAULT_WEIGHT)
    for node, weight in weights.items():
        if len(node) == len(path):
            hit = F.lit(True)
            for name, part in zip(path, node):
                hit = hit & F.col(name).eqNullSafe(F.lit(part))
            value = F.when(hit, F.lit(weight)).otherwise(value)
    return value.cast("long")


def fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget``: each parent's ``parent_budget`` over its children by ``weight`` up to ``cap``.

    In the order of cap / weight the full children come first: a child is full if its cap is at
    most its share of what those before it have left.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), F.col(name))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.greatest(F.col("parent_budget") - F.col("cap_before"), F.lit(0)).cast(MANY)
    full = F.col("cap").cast(MANY) * F.col("weight_on") <= F.col("weight").cast(MANY) * F.col("left")
    children = (
        nodes.filter("weight > 0")
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_on", F.sum("weight").over(onward))
        .withColumn("left", left)
        .withColumn("full", full)
    )
    #: what the first child that is not full sees; those after it see less left for less weight
    whole = Window.partitionBy(*parent)
    first = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), name, "left", "weight_on")))
    shared = children.withColumn("rest", first.over(whole))
    share = F.expr("cast(weight as decimal(38,0)) * rest.left div rest.weight_on")
    budget = F.when(F.col("full"), F.col("cap")).otherwise(share.cast("long"))
    return shared.withColumn("budget", budget).drop("cap_before", "weight_on", "left", "full", "rest")


def leaf_budgets(
    leaves: DataFrame, budget: Column, weights: dict[tuple, int], max_epochs: int
) -> DataFrame:
    """``leaves`` (path, units, tokens) with the ``budget`` of each leaf."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    whole = leaves.agg(budget.cast("long").alias("budget")).scalar()
    # what lies below a node of weight 0 can take nothing, so it is no part of a cap above
    for depth in range(1, len(PATH) + 1):
        leaves = leaves.filter(_weight(weights, PATH[:depth]) > 0)
    parent: list[str] = ["root"]
    above = None
    for depth in range(1, len(PATH) + 1):
        path = PATH[:depth]
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("root", F.lit(0))
        nodes = nodes.withColumn("weight", _weight(weights, path))
        if above is None:
            given = nodes.withColumn("parent_budget", whole)
        else:
            a, b = nodes.alias("a"), above.alias("b")
            same = F.lit(True)
            for name in parent[1:]:
                same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
            given = a.join(b, same).select("a.*", "b.parent_budget")
        filled = fill(given, parent, path[-1])
        above = filled.select("root", *path, F.col("budget").alias("parent_budget"))
        parent = ["root", *path]
    a, b = leaves.alias("a"), above.alias("b")
    same = F.lit(True)
    for name in PATH:
        same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    return a.join(b, same).select("a.*", F.col("b.parent_budget").alias("budget"))


def _order_key(seed: int) -> Column:
    unit = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), unit))


def mix(
    docs: DataFrame,
    budget_share: float,
    max_epochs: int,
    seed: int = 17,
    weights: dict[tuple, int] | None = None,
    domain: Column | None = None,
) -> DataFrame:
    """The chosen documents: doc_id, path, epoch, tokens, start, take.

    ``budget_share`` is the wanted number of tokens over the number of tokens there are. ``start``
    counts the tokens that the leaf has taken before the document, in this and in earlier epochs.
    """
    units = stored(
        docs.select(
            F.col("doc_id"),
            (source_domain(F.col("source")) if domain is None else domain).alias("domain"),
            F.col("lang"),
            F.col("source"),
            n_words(F.col("text")).alias("tokens"),
        )
        .groupBy("doc_id", *PATH)
        .agg(F.sum("tokens").alias("tokens")),
        "mix-units",
    )
    leaves = stored(
        units.groupBy(*PATH).agg(F.count("*").alias("units"), F.sum("tokens").alias("tokens")),
        "mix-leaves",
    )
    budget = F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(budget_share))
    leaves = stored(
        leaf_budgets(leaves, budget, WEIGHTS if weights is None else weights, max_epochs)
        .filter("budget > 0")
        .select(
            F.xxhash64(*[F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in PATH]).alias("leaf"),
            *PATH,
            F.col("tokens").alias("leaf_tokens"),
            "budget",
            (F.lit(1) + F.floor(F.col("units") / UNITS_PER_RANGE)).alias("ranges"),
        ),
        "mix-budgets",
    )
    a, b = units.alias("a"), leaves.alias("b")
    same = F.lit(True)
    for name in PATH:
        same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    last = F.expr("(budget - 1) div leaf_tokens")
    rows = (
        a.join(b, same)
        .select("a.*", "b.leaf", "b.leaf_tokens", "b.budget", "b.ranges")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("key", _order_key(seed))
    )
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("range", F.shiftright(place * F.col("ranges"), 32))
    cell = ["leaf", "epoch", "range"]
    sums = rows.groupBy(*cell).agg(F.sum("tokens").alias("range_tokens"))
    earlier = (
        Window.partitionBy("leaf", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = stored(
        sums.withColumn("before", F.coalesce(F.sum("range_tokens").over(earlier), F.lit(0))).drop(
            "range_tokens"
        ),
        "mix-ranges",
    )
    within = Window.partitionBy(*cell).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    origin = F.col("before") + F.col("epoch") * F.col("leaf_tokens")
    return (
        rows.join(starts, cell)
        .filter(origin < F.col("budget"))
        .withColumn("start", origin + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        .filter("start < budget")
        .select(
            "doc_id", *PATH, "epoch", "tokens", "start",
            F.least(F.col("tokens"), F.col("budget") - F.col("start")).alias("take"),
        )
    )


def keep_mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once each, with all their columns."""
    chosen = mix(docs, **how).select("doc_id", *PATH).distinct()
    a = docs.alias("a")
    b = chosen.alias("b")
    same = F.lit(True)
    for name in ("doc_id", "lang", "source"):
        same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    return a.join(b, same, "left_semi")


def mix_sql(
    budget_share: float, max_epochs: int, seed: int = 17, weights: dict[tuple, int] | None = None
) -> str:
    """DuckDB SQL of ``mix`` over the table ``documents``, with the default domains."""
    weights = WEIGHTS if weights is None else weights

    def weight(path: list[str]) -> str:
        cases = [
            "WHEN " + " AND ".join(f"{n} = '{p}'" for n, p in zip(path, node)) + f" THEN {w}"
            for node, w in weights.items()
            if len(node) == len(path)
        ]
        return f"CASE {' '.join(cases)} ELSE {DEFAULT_WEIGHT} END" if cases else str(DEFAULT_WEIGHT)

    steps, above, parent = [], "level0", ["root"]
    for depth in range(1, len(PATH) + 1):
        path, now = PATH[:depth], f"level{depth}"
        name = path[-1]
        same = " AND ".join(f"n.{c} IS NOT DISTINCT FROM p.{c}" for c in parent)
        by = ", ".join(parent)
        steps.append(f"""
nodes{depth} AS (
  SELECT 0 AS root, {", ".join(path)}, CAST(sum(cap) AS BIGINT) AS cap, {weight(path)} AS weight
  FROM leaves GROUP BY {", ".join(path)}
), given{depth} AS (
  SELECT n.*, p.budget AS parent_budget FROM nodes{depth} n JOIN {above} p ON {same}
  WHERE weight > 0
), sums{depth} AS (
  SELECT *, CAST(coalesce(sum(cap) OVER (PARTITION BY {by} ORDER BY cap / weight, {name}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS cap_before,
    CAST(sum(weight) OVER (PARTITION BY {by} ORDER BY cap / weight, {name}
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT) AS weight_on
  FROM given{depth}
), state{depth} AS (
  SELECT *, greatest(parent_budget - cap_before, 0) AS left_over,
    CAST(cap AS HUGEINT) * weight_on <= weight * greatest(parent_budget - cap_before, 0) AS is_full
  FROM sums{depth}
), rest{depth} AS (
  SELECT *, min(CASE WHEN NOT is_full THEN
      {{'r': cap / weight, 'n': {name}, 'l': left_over, 'w': weight_on}} END)
    OVER (PARTITION BY {by}) AS rest
  FROM state{depth}
), {now} AS (
  SELECT root, {", ".join(path)}, CAST(CASE WHEN is_full THEN cap
    ELSE (weight * rest.l) // rest.w END AS BIGINT) AS budget
  FROM rest{depth}
)""")
        above, parent = now, ["root", *path]
    same = " AND ".join(f"l.{c} IS NOT DISTINCT FROM b.{c}" for c in PATH)
    same_unit = " AND ".join(f"u.{c} IS NOT DISTINCT FROM b.{c}" for c in PATH)
    number = "regexp_extract(source, '([0-9]{1,9})$', 1)"
    return f"""
WITH units AS (
  SELECT doc_id, CASE WHEN {number} <> '' THEN 'd' || (CAST({number} AS INTEGER) % 4)
    ELSE 'other' END AS domain, lang, source,
    CAST(sum(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)) AS BIGINT) AS tokens
  FROM documents GROUP BY ALL
), leaves AS (
  SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens,
    CAST(sum(tokens) * {max_epochs} AS BIGINT) AS cap
  FROM units GROUP BY ALL
), level0 AS (
  SELECT 0 AS root, CAST(floor(CAST(coalesce(sum(tokens), 0) AS DOUBLE) * CAST({budget_share} AS DOUBLE))
    AS BIGINT) AS budget FROM leaves
), {",".join(steps)}, budgets AS (
  SELECT l.*, b.budget FROM leaves l JOIN {above} b ON {same} WHERE b.budget > 0
), epochs AS (
  SELECT u.*, b.budget, b.tokens AS leaf_tokens,
    unnest(range(0, CAST((b.budget - 1) // b.tokens AS BIGINT) + 1)) AS epoch
  FROM units u JOIN budgets b ON {same_unit}
), placed AS (
  SELECT *, CAST(epoch * leaf_tokens + coalesce(sum(tokens) OVER (
    PARTITION BY domain, lang, source, epoch
    ORDER BY md5('{seed}|' || epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), 'null'))
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM epochs
)
SELECT doc_id, domain, lang, source, epoch, tokens, start, least(tokens, budget - start) AS take
FROM placed WHERE start < budget"""
