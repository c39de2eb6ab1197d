"""Mixing sources to target weights through a domain-language-source tree.

Weights are positive integers of tree nodes. From the root down, each node's token budget is dealt
among its children by weight; a child gets no more than it can supply (its tokens times
``max_epochs``), and what it can't take goes to its siblings. A node is never dealt more than its
subtree can supply, so a shortage leaves a family only when every sibling is full. Budgets are
whole tokens: remainders of the division go one by one to the first unsaturated children by name.

A leaf's tokens are read in seeded epochs: epoch e orders the leaf's documents by
md5("seed:e:doc_id"); the leaf takes whole epochs, then the prefix of the next epoch that its
budget leaves. The order is never sorted as a whole: tokens are summed by the first hex digits of
the hash, and only the one bucket in which the budget ends is put in order, so a leaf that holds
most rows is spread over all tasks.

The plan has a row a leaf. It is broadcast after a count; beyond ``PLAN_ROWS`` leaves the join is
salted, so a leaf that holds most rows is spread over ``SALTS`` tasks at least.

Null languages and sources form the leaf "unknown". Documents without a word are never chosen.
Documents of equal hash (repeated ids) are ordered by id and token count; rows that agree in these
too are alike in the result. The stage keeps or leaves the rows of one id together. Texts of any
length are counted in one pass. Clashing column names are those of the input and pass untouched. An
empty table gives an empty result. DataFrame functions alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._common import WORD, stored, table, unused

LEVELS = ("domain", "lang", "source")
PLAN_ROWS, SALTS = 50_000, 64


@dataclass(frozen=True)
class Mix:
    """weights: by path ("web",), ("web", "en") or ("web", "en", "src0"); other nodes weigh 1.
    budget_percent: tokens to choose, in percent of all tokens there are. domains: (pattern of the
    source, domain), the first that fits counts; other sources are "unknown"."""

    weights: dict[tuple[str, ...], int] = field(default_factory=dict)
    budget_percent: int = 100
    max_epochs: int = 4
    seed: int = 42
    bucket_digits: int = 3
    domains: tuple[tuple[str, str], ...] = (("^src0$", "web"), ("^src[1-9]$", "curated"), ("^src[0-9]+$", "books"))


LANGUAGES = {"en": 6, "de": 2, "fr": 2, "es": 2}
PRODUCTION = Mix({("web",): 5, ("curated",): 3, ("books",): 2} | {(d, x): w for d in ("web", "curated", "books") for x, w in LANGUAGES.items()})


def domain(source: Column, mix: Mix) -> Column:
    found = F.lit("unknown")
    for pattern, name in reversed(mix.domains):
        found = F.when(source.rlike(pattern), name).otherwise(found)
    return found


def _leaf(mix: Mix) -> list[Column]:
    return [F.coalesce(domain(F.col("source"), mix), F.lit("unknown")).alias("domain"), F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("source", F.lit("unknown")).alias("source")]


def _leafed(rows: DataFrame, leaves: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined to their leaf's row."""
    if leaves.limit(PLAN_ROWS + 1).count() <= PLAN_ROWS:
        return rows.join(F.broadcast(leaves), keys)
    salt = unused(rows, "mix_salt")[0]
    spread = leaves.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(spread, [*keys, salt]).drop(salt)


def _weight(mix: Mix, keys: list[str]) -> Column:
    mine = {"\x1f".join(k): w for k, w in mix.weights.items() if len(k) == len(keys)}
    one = F.lit(1)
    if mine:
        table = F.create_map(*(F.lit(x) for kv in mine.items() for x in kv))
        one = F.coalesce(F.try_element_at(table, F.concat_ws("\x1f", *keys)), one)
    return one.cast("decimal(10,0)")


def _dealt(nodes: DataFrame, keys: list[str], mix: Mix) -> DataFrame:
    """nodes: keys, cap, budget (the parent's, repeated on each child). Budget becomes the child's own."""
    family = Window.partitionBy(*keys[:-1]) if keys[:-1] else Window.partitionBy(F.lit(1))
    before = family.orderBy("ratio", keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    d = nodes.withColumn("w", _weight(mix, keys)).withColumn("ratio", F.col("cap").cast("double") / F.col("w").cast("double"))
    d = d.withColumn("w_rest", F.sum("w").over(family) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    d = d.withColumn("full", (F.coalesce(F.sum("cap").over(before), F.lit(0)) * F.col("w") + F.col("cap") * F.col("w_rest")).cast("decimal(38,0)") <= (F.col("budget") * F.col("w")).cast("decimal(38,0)"))
    d = d.withColumn("left", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0))).over(family))
    d = d.withColumn("w_open", F.sum(F.when(~F.col("full"), F.col("w")).otherwise(F.lit(0))).over(family))
    d = d.withColumn("share", F.when(F.col("full"), F.col("cap").cast("bigint")).otherwise(F.expr("cast(left * w as decimal(38,0)) div greatest(w_open, 1)")))
    spare = F.col("left").cast("bigint") - F.sum(F.when(~F.col("full"), F.col("share")).otherwise(F.lit(0))).over(family)
    d = d.withColumn("spare", spare).withColumn("n", F.row_number().over(Window.partitionBy(*keys[:-1] or [F.lit(1)], "full").orderBy(keys[-1])))
    share = F.col("share") + F.when(~F.col("full") & (F.col("n") <= F.col("spare")), 1).otherwise(0)
    return d.select(*keys, share.cast("decimal(20,0)").alias("budget"))


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves: domain, lang, source, tokens. Adds each leaf's token budget."""
    leaves = leaves.withColumn("cap", (F.col("tokens") * mix.max_epochs).cast("decimal(20,0)"))
    root = Window.partitionBy(F.lit(1))
    top = leaves.groupBy("domain").agg(F.sum("cap").cast("decimal(20,0)").alias("cap"), F.sum("tokens").cast("decimal(20,0)").alias("t"))
    wish = F.floor(F.sum("t").over(root) * mix.budget_percent / 100)
    level = _dealt(top.withColumn("budget", F.least(wish.cast("decimal(20,0)"), F.sum("cap").over(root).cast("decimal(20,0)"))), ["domain"], mix)
    for depth in (2, 3):
        keys = list(LEVELS[:depth])
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").cast("decimal(20,0)").alias("cap")).join(level, keys[:-1])
        level = _dealt(nodes, keys, mix)
    return leaves.join(level, list(LEVELS)).select(*LEVELS, "tokens", F.col("budget").cast("bigint").alias("budget"))


def _hash(mix: Mix, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.col("doc_id").cast("string")))


def plan(docs: DataFrame, mix: Mix = PRODUCTION) -> tuple[DataFrame, DataFrame]:
    """(measured documents, leaf plan). The plan has a row a leaf: whole epochs, the bucket in which
    the next epoch's prefix ends, and the tokens that come before that bucket."""
    measured = stored(docs.select("doc_id", *_leaf(mix), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("n_tokens")).where("n_tokens > 0"), "measured")
    leaves = measured.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    dealt = budgets(leaves, mix).withColumn("full", F.expr("budget div tokens")).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
    dealt = stored(dealt, "budgets")
    sums = _leafed(measured, dealt.where("rest > 0"), list(LEVELS)).withColumn("bucket", F.substring(_hash(mix, F.col("full") + 1), 1, mix.bucket_digits)).groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.withColumn("upto", upto).where("upto - t < rest and rest <= upto").select(*LEVELS, F.col("bucket").alias("end_bucket"), (F.col("upto") - F.col("t")).alias("before"))
    return measured, stored(dealt.join(ends, list(LEVELS), "left"), "plan")


def _in_end_bucket(measured: DataFrame, leaves: DataFrame, mix: Mix) -> DataFrame:
    last = _leafed(measured, leaves.where("rest > 0"), list(LEVELS)).withColumn("h", _hash(mix, F.col("full") + 1)).where(F.substring("h", 1, mix.bucket_digits) == F.col("end_bucket"))
    order = Window.partitionBy(*LEVELS).orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return last.withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).where("start < rest")


def chosen(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens, taken_tokens): a row for each time a document
    is read. taken_tokens is less than n_tokens only where a leaf's budget ends inside a text."""
    measured, leaves = plan(docs, mix)
    met = _leafed(measured, leaves, list(LEVELS))
    out = ["doc_id", *LEVELS, "epoch", "n_tokens", "taken_tokens"]
    whole = F.col("full") + F.when(F.substring(_hash(mix, F.col("full") + 1), 1, mix.bucket_digits) < F.col("end_bucket"), 1).otherwise(0)
    all_of = met.withColumn("times", whole).where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).withColumn("taken_tokens", F.col("n_tokens")).select(*out)
    part = _in_end_bucket(measured, leaves, mix).withColumn("epoch", F.col("full") + 1).withColumn("taken_tokens", F.least("n_tokens", F.col("rest") - F.col("start"))).select(*out)
    return all_of.unionByName(part)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(table(spark, sf_dir, "documents"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as they are chosen, whole (the one in which a leaf's budget ends too).
    A leaf's choice is a threshold of the hash, so texts aren't shuffled."""
    measured, leaves = plan(docs)
    last = _in_end_bucket(measured, leaves, PRODUCTION).groupBy(*LEVELS).agg(F.max("h").alias("end_hash"))
    names = unused(docs, *(f"mix_{c}" for c in (*LEVELS, "full", "end", "times", "epoch")))
    leaf, (full, end, times, epoch) = names[:3], names[3:]
    cuts = stored(leaves.join(last, list(LEVELS), "left").select(*(F.col(c).alias(n) for c, n in zip(LEVELS, leaf)), F.col("full").alias(full), F.col("end_hash").alias(end)), "cuts")
    rows = docs.where(F.coalesce("text", F.lit("")).rlike(WORD)).withColumns(dict(zip(leaf, _leaf(PRODUCTION))))
    met = _leafed(rows, cuts, leaf)
    n = F.col(full) + F.when(_hash(PRODUCTION, F.col(full) + 1) <= F.col(end), 1).otherwise(0)
    return met.withColumn(times, n).where(F.col(times) > 0).withColumn(epoch, F.explode(F.sequence(F.lit(1).cast("bigint"), times))).select(*(f"`{c}`" for c in docs.columns))


def _deal_sql(name: str, nodes: str, parents: str, key: str, weight: str) -> str:
    by = f"PARTITION BY {parents}" if parents else ""
    keys = f"{parents}, {key}" if parents else key
    return f"""
{name}a AS (SELECT *, CAST({weight} AS HUGEINT) AS w, CAST(cap AS DOUBLE) / CAST({weight} AS DOUBLE) AS ratio FROM ({nodes})),
{name}b AS (SELECT *, sum(w) OVER ({by}) - coalesce(sum(w) OVER ({by} ORDER BY ratio, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_rest,
  coalesce(sum(cap) OVER ({by} ORDER BY ratio, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_before FROM {name}a),
{name}c AS (SELECT *, c_before * w + cap * w_rest <= budget * w AS isfull FROM {name}b),
{name}d AS (SELECT *, budget - sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER ({by}) AS rem, sum(CASE WHEN isfull THEN 0 ELSE w END) OVER ({by}) AS w_open FROM {name}c),
{name}e AS (SELECT *, CASE WHEN isfull THEN cap ELSE (rem * w) // greatest(w_open, 1) END AS share, row_number() OVER (PARTITION BY {parents + ', ' if parents else ''}isfull ORDER BY {key}) AS n FROM {name}d),
{name} AS (SELECT {keys}, share + CASE WHEN NOT isfull AND n <= rem - sum(CASE WHEN isfull THEN 0 ELSE share END) OVER ({by}) THEN 1 ELSE 0 END AS budget FROM {name}e)"""


_LANG_SQL = "CASE WHEN domain IN ('web', 'curated', 'books') THEN CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END ELSE 1 END"
ORACLE = rf"""
WITH m AS (SELECT doc_id, CASE WHEN source = 'src0' THEN 'web' WHEN regexp_matches(source, '^src[1-9]$') THEN 'curated' WHEN regexp_matches(source, '^src[0-9]+$') THEN 'books' ELSE 'unknown' END AS domain,
  coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents WHERE regexp_matches(text, '[^\x20\x09-\x0D]')),
l AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens, CAST(sum(n_tokens) * 4 AS HUGEINT) AS cap FROM m GROUP BY ALL),
top AS (SELECT domain, sum(cap) AS cap, sum(tokens) AS t FROM l GROUP BY ALL),
{_deal_sql("x", "SELECT domain, cap, least(sum(t) OVER (), sum(cap) OVER ()) AS budget FROM top", "", "domain", "CASE domain WHEN 'web' THEN 5 WHEN 'curated' THEN 3 WHEN 'books' THEN 2 ELSE 1 END")},
{_deal_sql("y", "SELECT domain, lang, sum(cap) AS cap, any_value(budget) AS budget FROM l JOIN x USING (domain) GROUP BY ALL", "domain", "lang", _LANG_SQL)},
{_deal_sql("z", "SELECT domain, lang, source, cap, budget FROM l JOIN y USING (domain, lang)", "domain, lang", "source", "1")},
p AS (SELECT domain, lang, source, budget // tokens AS whole, budget - budget // tokens * tokens AS rest FROM l JOIN z USING (domain, lang, source)),
o AS (SELECT doc_id, domain, lang, source, n_tokens, whole, rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('42:' || CAST(whole + 1 AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM m JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(unnest(range(1, CAST(whole AS BIGINT) + 1)) AS BIGINT) AS epoch, n_tokens, n_tokens AS taken_tokens FROM o
UNION ALL
SELECT doc_id, domain, lang, source, CAST(whole + 1 AS BIGINT), n_tokens, CAST(least(n_tokens, rest - start) AS BIGINT) FROM o WHERE start < rest
"""
