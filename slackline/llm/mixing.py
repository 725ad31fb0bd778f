"""Mixing sources to target weights: hierarchical budgets over domain, language and source.

A token budget flows down the tree. At each node it is shared among the children in proportion to
their weights, none above what its subtree can give (its tokens times ``max_epochs``); what a full
child can't take goes to its siblings first, and only what a whole family can't take is left to
the ancestors, whose own sharing already saw that family's capacity. Shares are whole tokens, in
exact integers; tokens that rounding down leaves go one each to the largest remainders, then by
key. A leaf with target T and t tokens gives T div t whole epochs, then of one more epoch a
token-prefix in that epoch's seeded order: every document whose order key comes before the point
where the remainder is filled. The prefix is a cut-off key, found by bucket sums first and inside
one bucket of each leaf afterwards, so no leaf is ever sorted as a whole and choosing documents
moves no text.

Defined cases: null lang or source is the key '' (and domain '?'), null text has no tokens, a null
doc_id orders as ''; documents of no tokens go with the order keys around them; equal doc_ids of a
leaf share one order key and are taken or left together; leaves of no tokens or of weight 0 give
nothing; an empty table gives nothing. Extra columns are carried, whatever their names; a column
named like the one for the epoch is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.llm.names import free
from slackline.plans.scratch import Scratch

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class MixPlan:
    """budget_share: tokens wanted, of all there are. Weights are whole numbers; 1 if not named.

    domain_of: SQL that gives a row's domain.
    """

    budget_share: float = 0.6
    max_epochs: int = 2
    seed: int = 17
    domain_weights: dict[str, int] = field(default_factory=lambda: {"0": 2})
    lang_weights: dict[str, int] = field(default_factory=lambda: {"en": 4})
    source_weights: dict[str, int] = field(default_factory=dict)
    domain_of: str = "right(source, 1)"


def with_keys(docs: DataFrame, plan: MixPlan, names: list[str]) -> DataFrame:
    """``docs`` and the tree's keys, under ``names``."""
    domain = f"coalesce(nullif({plan.domain_of}, ''), '?')"
    return docs.withColumns({name: F.expr(key) for name, key in zip(names, (domain, "coalesce(lang, '')", "coalesce(source, '')"), strict=True)})


def n_tokens(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)).cast("long")


def _weight(key: str, weights: dict[str, int]) -> str:
    cases = "".join(" WHEN '{}' THEN {}".format(k.replace("'", "''"), int(v)) for k, v in sorted(weights.items()))
    return f"CASE {key}{cases} ELSE 1 END" if cases else "1"


def _tree_sql(plan: MixPlan, share: Callable[..., str]) -> str:
    """From ``leaves(domain, lang, source, tokens)`` to targets by leaf, with ``share`` to share a budget among children."""
    capacity = f"CAST(sum(tokens) * {plan.max_epochs} AS BIGINT) AS cap"
    return f"""
domains AS (SELECT domain, {capacity}, {_weight('domain', plan.domain_weights)} AS weight FROM leaves GROUP BY domain),
langs AS (SELECT domain, lang, {capacity}, {_weight('lang', plan.lang_weights)} AS weight FROM leaves GROUP BY domain, lang),
total AS (SELECT CAST(floor(coalesce(sum(tokens), 0) * CAST({plan.budget_share} AS DOUBLE)) AS BIGINT) AS wanted FROM leaves),
rooted AS (SELECT domains.*, (SELECT wanted FROM total) AS wanted, 0 AS root FROM domains),
{share('d', ['root'], 'domain', 'rooted').strip()},
langs_of AS (SELECT langs.*, d.given AS wanted FROM langs JOIN d ON langs.domain = d.domain),
{share('l', ['domain'], 'lang', 'langs_of').strip()},
leaves_of AS (SELECT leaves.domain, leaves.lang, leaves.source, leaves.tokens, CAST(leaves.tokens * {plan.max_epochs} AS BIGINT) AS cap, {_weight('leaves.source', plan.source_weights)} AS weight, l.given AS wanted FROM leaves JOIN l ON leaves.domain = l.domain AND leaves.lang = l.lang),
{share('s', ['domain', 'lang'], 'source', 'leaves_of').strip()},
targets AS (SELECT s.domain, s.lang, s.source, leaves.tokens AS leaf_tokens, given AS target, CAST(floor(given / leaves.tokens) AS BIGINT) AS whole, CAST(given - floor(given / leaves.tokens) * leaves.tokens AS BIGINT) AS rest
  FROM s JOIN leaves ON s.domain = leaves.domain AND s.lang = leaves.lang AND s.source = leaves.source WHERE given > 0)"""


def _share_by_order(name: str, parent: list[str], key: str, source: str) -> str:
    """``source(parent, key, cap, weight, wanted)`` to ``name(parent, key, given)``: full children are the first by cap / weight."""
    of, big = ", ".join(parent), "DECIMAL(20, 0)"
    order = f"PARTITION BY {of} ORDER BY cap / weight, {key}"
    return f"""
{name}_0 AS (SELECT {of}, {key}, CAST(cap AS {big}) AS cap, CAST(weight AS {big}) AS weight, CAST(wanted AS {big}) AS wanted FROM {source} WHERE weight > 0 AND cap > 0),
{name}_1 AS (SELECT *, cap * CAST(sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {big})
    <= weight * CAST(wanted - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {big}) AS is_full FROM {name}_0),
{name}_2 AS (SELECT *, CAST(wanted - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY {of}) AS {big}) AS spare, CAST(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {of}) AS {big}) AS weights FROM {name}_1),
{name}_3 AS (SELECT *, CASE WHEN is_full THEN CAST(cap AS BIGINT) ELSE (spare * weight) DIV weights END AS least, CASE WHEN is_full THEN CAST(-1 AS DECIMAL(38, 0)) ELSE CAST((spare * weight) % weights AS DECIMAL(38, 0)) END AS part FROM {name}_2),
{name}_4 AS (SELECT *, wanted - sum(least) OVER (PARTITION BY {of}) AS over, row_number() OVER (PARTITION BY {of} ORDER BY part DESC, {key}) AS place FROM {name}_3),
{name} AS (SELECT {of}, {key}, CAST(least + CASE WHEN NOT is_full AND place <= over THEN 1 ELSE 0 END AS BIGINT) AS given FROM {name}_4)"""


def budget_sql(plan: MixPlan) -> str:
    return _tree_sql(plan, _share_by_order)


def _order_key(plan: MixPlan, epoch: str, doc_id: str) -> str:
    return f"md5(concat('{plan.seed}:', CAST({epoch} AS STRING), ':', coalesce(CAST({doc_id} AS STRING), '')))"


@contextmanager
def _views(**frames: DataFrame) -> Iterator[dict[str, str]]:
    """The frames as views of names that nobody else uses, while a plan is made from them."""
    names = {k: f"{k}_{uuid.uuid4().hex}" for k in frames}
    for k, df in frames.items():
        df.createOrReplaceTempView(names[k])
    try:
        yield names
    finally:
        for k, df in frames.items():
            df.sparkSession.catalog.dropTempView(names[k])


def mix_plan(docs: DataFrame, plan: MixPlan = MixPlan(), scratch: Scratch | None = None) -> DataFrame:
    """One row per leaf that gives anything: its target, whole epochs and the next one's cut-off key."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    leaf, own = list(LEVELS), free(docs.columns, *(f"{x}_" for x in LEVELS))
    rows = with_keys(docs, plan, own).select(*(F.col(o).alias(x) for o, x in zip(own, leaf, strict=True)), "doc_id", n_tokens(F.col("text")).alias("tokens"))
    rows = scratch.save(rows, "rows")
    leaves = scratch.save(rows.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("tokens")), "leaves")
    targets = scratch.save(_targets(leaves, plan), "targets")
    keyed = (
        rows.join(targets.where("rest > 0").select(*leaf, "whole", "rest"), leaf)
        .groupBy(*leaf, "rest", F.expr(_order_key(plan, "whole", "doc_id")).alias("order_key")).agg(F.sum("tokens").alias("tokens"))
        .withColumn("bucket", F.expr("left(order_key, 3)"))
    )
    keyed = scratch.save(keyed, "keyed")
    sums = scratch.save(keyed.groupBy(*leaf, "rest", "bucket").agg(F.sum("tokens").alias("tokens")), "sums")
    with _views(sums=sums) as v:
        before = spark.sql(f"""
            SELECT domain, lang, source, bucket, before FROM (
              SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {v['sums']})
            WHERE before < rest AND rest <= before + tokens""")
    edge = scratch.save(keyed.join(before, [*leaf, "bucket"]), "edge")
    with _views(edge=edge) as v:
        cuts = spark.sql(f"""
            SELECT domain, lang, source, max(order_key) AS cut FROM (
              SELECT *, before + coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY order_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at FROM {v['edge']})
            WHERE start_at < rest GROUP BY domain, lang, source""")
    made = scratch.save(targets.join(cuts, leaf, "left"), "plan")
    scratch.drop("rows", "keyed", "sums", "edge")
    return made


def _targets(leaves: DataFrame, plan: MixPlan) -> DataFrame:
    with _views(leaves=leaves) as v:
        return leaves.sparkSession.sql(f"WITH leaves AS (SELECT * FROM {v['leaves']}), {budget_sql(plan)} SELECT * FROM targets")


def mix(docs: DataFrame, plan: MixPlan = MixPlan(), made: DataFrame | None = None, epoch: str = "epoch") -> DataFrame:
    """The chosen rows of ``docs`` with ``epoch`` (from 0): a row for each epoch that takes it."""
    if free(docs.columns, epoch) != [epoch]:
        raise ValueError(f"there is a column {epoch} already; name another for the epoch")
    made = mix_plan(docs, plan) if made is None else made
    *keys, whole, cut, times = free([*docs.columns, epoch], "domain_", "lang_", "source_", "whole_", "cut_", "times_")
    leaf = made.select(*(F.col(x).alias(k) for x, k in zip(LEVELS, keys, strict=True)), F.col("whole").alias(whole), F.col("cut").alias(cut))
    taken = with_keys(docs, plan, keys).join(leaf, keys)
    taken = taken.withColumn(times, F.expr(f"{whole} + CASE WHEN {_order_key(plan, whole, 'doc_id')} <= {cut} THEN 1 ELSE 0 END")).where(F.col(times) > 0)
    return taken.withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1))).select(*(F.col(f"`{c}`") for c in docs.columns), epoch)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, epoch for every document and epoch that the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "lang", "source"), made=mix_plan(docs))


def _share_by_search(name: str, parent: list[str], key: str, source: str) -> str:
    """The same, said another way: a child is full if the level that just fills it gives all children together no more than is wanted."""
    of = ", ".join(parent)
    same = " AND ".join(f"a.{p} = b.{p}" for p in parent)
    return f"""
{name}_a AS (SELECT {of}, {key}, CAST(cap AS HUGEINT) AS cap, CAST(weight AS HUGEINT) AS weight, CAST(wanted AS HUGEINT) AS wanted FROM {source} WHERE weight > 0 AND cap > 0),
{name}_b AS (SELECT *, (SELECT sum(least(b.cap * a.weight, a.cap * b.weight)) FROM {name}_a b WHERE {same}) <= a.wanted * a.weight AS is_full FROM {name}_a a),
{name}_c AS (SELECT {of}, any_value(wanted) - coalesce(sum(cap) FILTER (is_full), 0) AS spare, sum(weight) FILTER (NOT is_full) AS weights FROM {name}_b GROUP BY {of}),
{name}_d AS (SELECT b.*, CAST(b.spare * a.weight // b.weights AS HUGEINT) AS least, CAST(b.spare * a.weight % b.weights AS HUGEINT) AS part, a.{key} FROM {name}_b a JOIN {name}_c b ON {same} WHERE NOT a.is_full),
{name} AS (SELECT {of}, {key}, CAST(cap AS BIGINT) AS given FROM {name}_b WHERE is_full UNION ALL
  SELECT {of}, {key}, CAST(least + CASE WHEN (SELECT count(*) FROM {name}_d b WHERE {same} AND (b.part > a.part OR b.part = a.part AND b.{key} < a.{key})) < a.spare - (SELECT sum(b.least) FROM {name}_d b WHERE {same}) THEN 1 ELSE 0 END AS BIGINT) FROM {name}_d a)"""


def op1_sql(plan: MixPlan = MixPlan()) -> str:
    key = _order_key(plan, "whole", "doc_id").replace("STRING", "VARCHAR")
    return f"""
WITH rows_ AS (SELECT doc_id, lang AS lang_, source AS source_, coalesce(nullif({plan.domain_of}, ''), '?') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(length(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')), 0) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM rows_ GROUP BY ALL), {_tree_sql(plan, _share_by_search)},
ordered AS (SELECT r.*, whole, rest, {key} AS order_key FROM rows_ r JOIN targets USING (domain, lang, source)),
placed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY order_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at FROM ordered)
SELECT doc_id, lang_ AS lang, source_ AS source, CAST(unnest(range(whole + CASE WHEN start_at < rest THEN 1 ELSE 0 END)) AS BIGINT) AS epoch FROM placed"""
