"""Mixing sources to target weights, over a tree of domains, languages and sources.

A budget of tokens is handed down the tree. Each node shares its budget among
its children by their weights; a child that can't use its share (its supply
times ``epochs`` is less) gives the rest to its siblings, and only what all of
them can't use goes back to the parent's siblings. As a child's capacity is the
sum of its leaves', sharing level by level from the top does just that. Leaves
with a weight of 0 anywhere on their path have no capacity. Sums and products
are whole numbers, so the plan doesn't depend on order. Children are ranked by
capacity to weight in two steps, bins first, so no task ranks a node's whole
list of sources.

A leaf's budget pays for whole epochs and a part of one more. The part is a
prefix of the leaf's documents in an order seeded for that epoch: those whose
tokens, with all before them, stay within what is left. To find its end, a leaf
is cut into about sqrt(documents) ranges of the order; their sums tell the
range of the end, and only within that one documents are ranked. What comes of
it is one row a leaf, against which every document decides by itself; so no
text is shuffled and no task gets a whole leaf, however large.

Edge cases: a null or empty text has no tokens and is part of every epoch that
its leaf starts; a null language or source is a node of its own, written as the
empty string; weights of 0 give nothing; a row without doc_id is known by its
text instead; rows of a leaf that repeat a doc_id (or, without one, a text) are
taken together or not at all; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placard.llm.common import WORD, checkpointed, only, packed, table


@dataclass(frozen=True)
class Mix:
    """Weights are whole numbers; what isn't named has weight ``other``. Domains: (name, pattern of its sources); the first that fits counts."""

    domains: tuple[tuple[str, str], ...] = (("web", "^src0$"), ("forum", "^src[1-9]$"), ("books", ""))
    domain_weights: dict[str, int] = field(default_factory=lambda: {"web": 40, "forum": 30, "books": 30})
    lang_weights: dict[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    source_weights: dict[str, int] = field(default_factory=dict)
    other: int = 10
    budget_percent: int = 80
    epochs: int = 3
    seed: int = 17


LEVELS = ("domain", "lang", "source")
#: Tables of a row for each leaf are broadcast up to this many rows (under 100 MB).
BROADCAST_ROWS = 1 << 19
#: What a document is known by in the seeded order.
KEY = "coalesce(cast(doc_id as string), concat('t', md5(coalesce(text, ''))))"


def _case(value: str, weights: dict[str, int], other: int) -> str:
    named = " ".join(f"when {value} = '{k}' then {w}" for k, w in sorted(weights.items()))
    return f"case {named} else {other} end" if named else str(other)


def _domain(mix: Mix) -> Column:
    out = F
    for name, pattern in mix.domains:
        out = out.when(F.col("source").rlike(pattern), name)
    return F.coalesce(out.otherwise(mix.domains[-1][0]), F.lit(mix.domains[-1][0]))


def _weights(mix: Mix) -> dict[str, str]:
    return {c: _case(c, w, mix.other) for c, w in zip(LEVELS, (mix.domain_weights, mix.lang_weights, mix.source_weights), strict=True)}


def _named(rows: DataFrame, mix: Mix) -> DataFrame:
    """rows (doc_id, lang, source, text and more) with domain and key, and null languages and sources as the empty string."""
    return rows.withColumns({"lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit("")), "key": F.expr(KEY)}).withColumn("domain", _domain(mix))


def measured(docs: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, domain, lang, source, key, n_tokens of every row; a token here is a word."""
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return _named(only(docs, "doc_id", "lang", "source", "text"), mix).select("doc_id", *LEVELS, "key", count.alias("n_tokens"))


def _share(children: DataFrame, parents: list[str], key: str) -> DataFrame:
    """children (parents, one, key, capacity, weight, budget) with alloc: the budget shared by weight, never over capacity.

    Children are filled in the order of capacity to weight; one is full if its
    part of what those before it left is at least its capacity. Bins of the
    ratio (eight for each doubling) are summed up first.
    """
    whole = lambda e: f"cast({e} as decimal(38,0))"
    up = [*parents, "one"]
    binned = children.withColumn("bin", F.floor(8 * F.log2(F.col("capacity") / F.col("weight"))))
    over = f"over (partition by {', '.join(up)} order by bin rows between"
    bins = binned.groupBy(*up, "bin").agg(F.sum("capacity").alias("c"), F.sum("weight").alias("w")).selectExpr(
        *up, "bin", f"coalesce(sum(c) {over} unbounded preceding and 1 preceding), 0) as lower", f"sum(w) {over} current row and unbounded following) as upper"
    )
    within = f"over (partition by {', '.join(up)}, bin order by capacity / weight, {key} rows between unbounded preceding and 1 preceding)"
    ranked = binned.join(bins, [*up, "bin"]).selectExpr("*", f"lower + coalesce(sum(capacity) {within}, 0) as before", f"upper - coalesce(sum(weight) {within}, 0) as weights")
    full = ranked.selectExpr(*children.columns, f"{whole('capacity')} * {whole('weights')} <= {whole('weight')} * {whole('budget - before')} as full")
    sums = full.groupBy(*up).agg(F.expr("coalesce(sum(case when full then capacity end), 0)").alias("used"), F.expr("sum(case when full then 0 else weight end)").alias("open"))
    return full.join(sums, up).selectExpr(*children.columns, f"case when full then capacity else cast({whole('weight')} * {whole('budget - used')} div open as bigint) end as alloc")


def leaf_plan(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves (domain, lang, source, tokens, docs) with alloc: each leaf's tokens of the budget; those that can't get any are left out."""
    budget = leaves.agg(F.expr(f"cast(sum(tokens) * {mix.budget_percent} div 100 as bigint)").alias("alloc"))
    weights = _weights(mix)
    able = leaves.withColumn("capacity", F.col("tokens") * mix.epochs).filter("capacity > 0 and " + " and ".join(f"({w}) > 0" for w in weights.values()))
    parents: list[str] = []
    for level in LEVELS:
        keys = [*parents, level]
        nodes = able.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("weight", F.expr(weights[level]).cast("long")).withColumn("one", F.lit(1))
        paid = budget.withColumnRenamed("alloc", "budget")
        nodes = nodes.join(paid, parents) if parents else nodes.join(paid.withColumn("one", F.lit(1)), "one")
        budget = checkpointed(_share(checkpointed(nodes), parents, level).select(*keys, "alloc"))
        parents = keys
    return able.join(budget, list(LEVELS)).select(*LEVELS, "tokens", "docs", "alloc")


def _by_leaf(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(leaves) if leaves.count() <= BROADCAST_ROWS else leaves, list(LEVELS))


def _placed(rows: DataFrame, leaves: DataFrame, mix: Mix) -> DataFrame:
    """rows with their leaf's plan, their place h in the seeded order of its last epoch, and the range of h."""
    order = F.expr(f"cast(conv(substr(md5(concat('{mix.seed}:', whole, ':', key)), 1, 8), 16, 10) as bigint)")
    return _by_leaf(rows, leaves).withColumn("h", order).withColumn("range", F.expr("h * ranges div 4294967296"))


def leaf_limits(rows: DataFrame, mix: Mix) -> DataFrame:
    """A row for each leaf that is taken from: whole (its full epochs), ranges, and the end of its last epoch's prefix.

    The prefix has all ranges before ``cut``, and of that one what comes up to
    ``last`` (h and key). rows: as of ``measured``.
    """
    leaves = checkpointed(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    plan = checkpointed(leaf_plan(leaves, mix).selectExpr(*LEVELS, "cast(alloc div tokens as int) as whole", "alloc % tokens as rest", "cast(ceil(sqrt(docs)) as bigint) as ranges"))
    part = _placed(rows, plan, mix).filter("rest > 0")
    by = f"partition by {', '.join(LEVELS)}"
    sums = part.groupBy(*LEVELS, "range", "rest").agg(F.sum("n_tokens").alias("n"))
    cut = checkpointed(sums.selectExpr(*LEVELS, "range as cut", "rest", "n", f"sum(n) over ({by} order by range) as upto").filter("upto > rest and upto - n <= rest").selectExpr(*LEVELS, "cut", "rest - (upto - n) as left"))
    edge = _by_leaf(part, cut).filter("range = cut").groupBy(*LEVELS, "h", "key", "left").agg(F.sum("n_tokens").alias("n"))
    within = edge.selectExpr(*LEVELS, "h", "key", f"sum(n) over ({by} order by h, key) as upto", "left").filter("upto <= left")
    last = within.groupBy(*LEVELS).agg(F.max(F.struct("h", "key")).alias("last"))
    return checkpointed(plan.join(cut, list(LEVELS), "left").join(last, list(LEVELS), "left").select(*LEVELS, "whole", "ranges", "cut", "last"))


def _taken(rows: DataFrame, limits: DataFrame, mix: Mix) -> DataFrame:
    """rows (with the leaf's names and key), one for each epoch that takes them."""
    partly = "range < cut or (range = cut and coalesce(struct(h, key) <= last, false))"
    epochs = f"concat(case when whole > 0 then sequence(0, whole - 1) else cast(array() as array<int>) end, case when {partly} then array(whole) else cast(array() as array<int>) end)"
    return _placed(rows, limits, mix).withColumn("epoch", F.explode(F.expr(epochs)))


def select_mix(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens: a row for each time that a document is taken."""
    rows = checkpointed(measured(docs, mix))
    return _taken(rows, leaf_limits(rows, mix), mix).select("doc_id", *LEVELS, "epoch", "n_tokens")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """docs, each row as often as it is taken; null and repeated doc_ids as in ``select_mix``, so no row brings another along."""
    limits = leaf_limits(checkpointed(measured(docs, mix)), mix)
    rows = _named(packed(docs, "doc_id", "lang", "source", "text"), mix)
    return _taken(rows, limits, mix).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_mix(table(spark, sf_dir, "documents"))


def _duck_share(name: str, parents: list[str], level: str, weight: str, above: str) -> str:
    """SQL for a level's shares. A child is full if the budget covers the level at which it is: what each sibling can use when filled up to the same ratio."""
    keys, by = ", ".join([*parents, level]), f"partition by {', '.join(parents)}" if parents else ""
    join, same = (f"join {above} using ({', '.join(parents)})", " and ".join(f"o.{p} = c.{p}" for p in parents)) if parents else (f", {above}", "true")
    return f"""{name}_in as (select {keys}, capacity, ({weight})::hugeint as weight, alloc::hugeint as budget from (select {keys}, sum(capacity)::hugeint as capacity from leaves group by {keys}) {join}),
{name}_full as (select c.*, (select sum(least(o.capacity * c.weight, o.weight * c.capacity)) from {name}_in o where {same}) <= c.weight * c.budget as isfull from {name}_in c),
{name} as (select {keys}, case when isfull then capacity else weight * (budget - used) // opened end as alloc from (
  select *, (sum(case when isfull then capacity else 0 end) over ({by}))::hugeint as used, (sum(case when isfull then 0 else weight end) over ({by}))::hugeint as opened from {name}_full))"""


def _duck_sql(mix: Mix) -> str:
    domain = " ".join(f"when regexp_matches(source, '{p}') then '{n}'" for n, p in mix.domains)
    weights = _weights(mix)
    return f"""
with d as (select doc_id, case {domain} else '{mix.domains[-1][0]}' end as domain, lang, source, coalesce(doc_id::varchar, 't' || md5(text)) as key, len(regexp_extract_all(text, '{WORD}'))::bigint as n_tokens
           from (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents)),
sums as (select domain, lang, source, sum(n_tokens)::bigint as tokens from d group by all),
leaves as (select *, tokens * {mix.epochs} as capacity from sums where tokens > 0 and {" and ".join(f"({w}) > 0" for w in weights.values())}),
b0 as (select (sum(tokens) * {mix.budget_percent} // 100)::bigint as alloc from sums),
{_duck_share("b1", [], "domain", weights["domain"], "b0")},
{_duck_share("b2", ["domain"], "lang", weights["lang"], "b1")},
{_duck_share("b3", ["domain", "lang"], "source", weights["source"], "b2")},
p as (select domain, lang, source, (alloc // tokens)::int as whole, alloc % tokens as rest from b3 join leaves using (domain, lang, source)),
x as (select *, sum(n_tokens) over (partition by domain, lang, source order by h, key range between unbounded preceding and current row) as upto
      from (select d.*, whole, rest, ('0x' || substr(md5('{mix.seed}:' || whole || ':' || key), 1, 8))::bigint as h from d join p using (domain, lang, source)))
select doc_id, domain, lang, source, unnest(range(whole))::int as epoch, n_tokens from x
union all select doc_id, domain, lang, source, whole, n_tokens from x where rest > 0 and upto <= rest
"""


OP1_SQL = _duck_sql(Mix())
