"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree.

DataFrame functions only. Weights are propagated from the root: the budget is
divided among domains, each domain's among its languages, each language's among
its sources, in proportion to weight but no further than what lies below can
supply in the allowed number of epochs. What one child cannot use goes to its
siblings first; only when all of them are full does the parent's share shrink
and the shortage reach the level above.

A source's quota is then met from seeded epochs: whole passes first, and of the
last pass the prefix, in the order of a seeded hash, that fits the rest. The
prefix is found without sorting a source: tokens are summed by ranges of the
hash, the range that holds the cut is divided again, and only when few rows are
left in it are these put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geospan.llm.common import checkpointed

#: Hexadecimal digits that a step of the search for a cut adds, rows of a range that are put in order, digits of a place, and what comes behind all digits.
RANGE_DIGITS, FEW, PLACES, PAST = 2, 1000, 96, "g"
#: Leaves up to which the table of quotas is small enough to send to all executors.
SMALL = 20_000
LEVELS = ("domain", "lang", "source")
NONE = "(none)"

# The mixture of the query and of the pipeline's stage.
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "news": 2}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
FRACTION_PERCENT, EPOCHS, SEED = 60, 3, "mix-1"


def default_domain(source: Column) -> Column:
    """The domain of a source of the shared tables."""
    return F.when(source.isNull(), F.lit(NONE)).when(source == "src0", F.lit("web")).when(F.right(source, F.lit(1)).isin("1", "3", "5", "7", "9"), F.lit("books")).otherwise(F.lit("news"))


def tokens_of(text: Column) -> Column:
    """The estimate of a text's tokens: a quarter of its characters, rounded up; null: 0."""
    return ((F.coalesce(F.length(text), F.lit(0)) + 3) / 4).cast("long")


def _weight(key: Column, weights: dict[str, int]) -> Column:
    """Weights as a literal map; 1 for a key without one."""
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return F.coalesce(F.try_element_at(table, key), F.lit(1)).cast("long")


def fill(nodes: DataFrame, within: list[str], name: str) -> DataFrame:
    """Divide ``budget`` (the same in each group of ``within``) by ``weight``, up to ``cap``; adds ``quota``.

    With the children in the order of cap / weight, the full ones come first: a
    child is full if its cap is at most its share of what the ones before it
    left. The rest is shared by the others, rounded down.
    """
    big = T.DecimalType(38, 0)
    order = Window.partitionBy(*within).orderBy((F.col("cap") / F.col("weight")), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*within)
    out = nodes.withColumn("budget", F.least("budget", F.sum("cap").over(group)))
    out = out.withColumn("_p", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("_w", F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    full = F.col("cap").cast(big) * F.col("_w") <= F.col("weight").cast(big) * (F.col("budget") - F.col("_p"))
    out = out.withColumn("_full", full)
    out = out.withColumn("_rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(group), F.lit(0))).withColumn("_share", F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group), F.lit(1)))
    share = F.expr("CAST((CAST(_rest AS DECIMAL(20,0)) * CAST(weight AS DECIMAL(18,0))) div CAST(_share AS DECIMAL(18,0)) AS BIGINT)")
    return out.withColumn("quota", F.when(F.col("_full"), F.col("cap")).otherwise(F.least(share, F.col("cap")))).drop("_p", "_w", "_full", "_rest", "_share")


def quotas(leaves: DataFrame, percent: int, epochs: int, domain_weights: dict[str, int], lang_weights: dict[str, int], source_weights: dict[str, int]) -> DataFrame:
    """``domain, lang, source, supply, quota`` from ``domain, lang, source, supply``; the budget is ``percent`` of all supply."""
    leaves = leaves.withColumn("cap", F.col("supply") * epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
    domains = domains.withColumn("_all", F.sum("supply").over(Window.partitionBy())).withColumn("budget", F.expr(f"(_all * {percent}) div 100"))  # few rows: one for each domain
    domains = fill(domains.withColumn("weight", _weight(F.col("domain"), domain_weights)), [], "domain")
    langs = fill(langs.withColumn("weight", _weight(F.col("lang"), lang_weights)).join(domains.select("domain", F.col("quota").alias("budget")), "domain"), ["domain"], "lang")
    leaves = fill(leaves.withColumn("weight", _weight(F.col("source"), source_weights)).join(langs.select("domain", "lang", F.col("quota").alias("budget")), ["domain", "lang"]), ["domain", "lang"], "source")
    return leaves.select("domain", "lang", "source", "supply", "quota")


def added_names(df: DataFrame) -> tuple[str, str, str]:
    """What ``mix`` calls domain, tokens and copies: ``_domain, _tokens, _copies``, with more underscores where ``df`` has such columns."""
    out = []
    for name in ("_domain", "_tokens", "_copies"):
        while name in df.columns:
            name = "_" + name
        out.append(name)
    return tuple(out)


def _sent(df: DataFrame) -> DataFrame:
    """A checkpointed table by leaf, to be sent to all executors if its size allows that; else it is joined by leaf."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _order(seed: str) -> Column:
    """The place of a row in its leaf's last epoch: a seeded hash of the id, then tokens and the text's hash, as 96 digits."""
    key = F.sha2(F.concat_ws("/", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col("id"), F.lit(NONE))), 256)
    return F.concat(key, *(F.lpad(F.lower(F.hex(c)), 16, "0") for c in ("tokens", "tie")))


def _bounds(facts: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """``leaf, whole, rest, bound``: the last epoch's prefix holds the rows whose place is before ``bound``.

    The range of places that holds the cut is found digit by digit, from sums by
    range: no leaf's rows are put in order but the few of the last range.
    """
    cut = checkpointed(plan.where("rest > 0").select(*LEVELS, "whole", "rest", F.lit("").alias("bound"), F.lit(0).cast("long").alias("before")))
    by, digits = Window.partitionBy(*LEVELS).orderBy("place"), 0
    upto = F.sum("t").over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    while True:
        digits += RANGE_DIGITS
        near = facts.join(_sent(cut), list(LEVELS)).withColumn("order", _order(seed)).where(F.col("order").startswith(F.col("bound")))
        place = F.substring("order", 1, digits)
        sums = near.groupBy(*LEVELS, "whole", "rest", "bound", "before", place.alias("place")).agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).withColumn("upto", upto)
        over = F.col("upto") > F.col("rest")
        first = F.min_by(F.struct("place", (F.col("upto") - F.col("t")).alias("before"), "n"), F.when(over, F.col("place")))
        found = sums.groupBy(*LEVELS, "whole", "rest").agg(F.when(F.max(over), first).alias("c"))
        # Past all digits stands what no place reaches: everything is taken.
        found = checkpointed(found.select(*LEVELS, "whole", "rest", F.coalesce("c.place", F.lit(PAST)).alias("bound"), F.coalesce("c.before", F.lit(0)).alias("before"), F.coalesce("c.n", F.lit(0)).alias("n")))
        most = found.agg(F.max("n")).first()[0] or 0
        cut = found.drop("n")
        if most <= FEW or digits >= PLACES:
            break
    near = facts.join(_sent(cut), list(LEVELS)).withColumn("order", _order(seed)).where(F.col("order").startswith(F.col("bound")))
    sums = near.groupBy(*LEVELS, "before", "rest", F.col("order").alias("place")).agg(F.sum("tokens").alias("t")).withColumn("upto", upto)
    last = sums.where("upto <= rest").groupBy(*LEVELS).agg(F.max("place").alias("last"))
    done = cut.join(last, list(LEVELS), "left").select(*LEVELS, F.coalesce(F.concat("last", F.lit(PAST)), "bound").alias("bound"))
    return checkpointed(plan.join(done, list(LEVELS), "left").withColumn("bound", F.coalesce("bound", F.lit(PAST))))


def mix(
    df: DataFrame, percent: int = FRACTION_PERCENT, epochs: int = EPOCHS, seed: str = SEED, domain: Column | None = None,
    domain_weights: dict[str, int] = DOMAIN_WEIGHTS, lang_weights: dict[str, int] = LANG_WEIGHTS, source_weights: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    tokens: Column | None = None,
) -> DataFrame:
    """The selected rows of ``df``, with all its columns, and its domain, tokens and copies (``added_names``): how often each is taken.

    ``tokens``: a count that the table has; by default the estimate ``tokens_of``.
    Null languages and sources are leaves of their own, named ``(none)``; a row
    with null or empty text has no tokens and is taken with the prefix that it
    falls in; repeated rows count each. Rows with equal ids are put in order by
    tokens, then by the text's hash; rows equal in all three are taken together
    or not at all. An empty table gives no rows. The text is read twice: for the
    counts, which are kept, and for the outcome.
    """
    domain = default_domain(F.col(source_col)) if domain is None else domain
    named = added_names(df)
    whole_row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    known = [F.coalesce(domain, F.lit(NONE)).alias("domain"), F.coalesce(F.col(lang_col), F.lit(NONE)).alias("lang"), F.coalesce(F.col(source_col), F.lit(NONE)).alias("source"), F.col(id_col).cast("string").alias("id")]
    known += [F.coalesce((tokens_of(F.col(text_col)) if tokens is None else tokens).cast("long"), F.lit(0)).alias("tokens"), F.xxhash64(text_col).alias("tie")]
    facts = checkpointed(df.select(*known))
    supply = checkpointed(facts.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply")))
    plan = quotas(supply, percent, epochs, domain_weights, lang_weights, source_weights or {})
    whole = F.when(F.col("supply") > 0, F.expr("quota div supply")).otherwise(0).cast("long")
    plan = checkpointed(plan.withColumn("whole", whole).select(*LEVELS, "whole", (F.col("quota") - F.col("whole") * F.col("supply")).alias("rest")))
    rows = df.select(whole_row, *known).join(_sent(_bounds(facts, plan, seed)), list(LEVELS))
    copies = F.col("whole") + F.when((F.col("rest") > 0) & (_order(seed) < F.col("bound")), 1).otherwise(0)
    return rows.withColumn("copies", copies).where("copies > 0").select("row.*", *(F.col(c).alias(n) for c, n in zip(("domain", "tokens", "copies"), named, strict=True)))


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """The mixture itself: each selected row as often as it is taken, with the columns of ``df``; odd rows as in ``mix``."""
    whole_row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    copies = F.sequence(F.lit(1).cast("long"), F.col(added_names(df)[2]))
    return mix(df, **options).select(whole_row, F.explode(copies).alias("n")).select("row.*")


#: DuckDB SQL for the query over ``documents``.
_FILL = """
 SELECT *, CASE WHEN full_ THEN cap ELSE least(CAST((CAST(rest_ AS HUGEINT) * weight) // share_ AS BIGINT), cap) END AS quota FROM (
  SELECT *, budget - coalesce(sum(cap) FILTER (full_) OVER (PARTITION BY {by}), 0) AS rest_, coalesce(sum(weight) FILTER (NOT full_) OVER (PARTITION BY {by}), 1) AS share_ FROM (
   SELECT *, CAST(cap AS HUGEINT) * w_ <= CAST(weight AS HUGEINT) * (budget - p_) AS full_ FROM (
    SELECT * REPLACE (least(budget, sum(cap) OVER (PARTITION BY {by})) AS budget),
     coalesce(sum(cap) OVER (PARTITION BY {by} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p_,
     sum(weight) OVER (PARTITION BY {by}) - coalesce(sum(weight) OVER (PARTITION BY {by} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_
    FROM {nodes})))"""
_CASE = lambda key, weights: f"CAST(CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END AS BIGINT)"
MIX_SQL = f"""
WITH given AS (
 SELECT doc_id, coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source, (coalesce(length(text), 0) + 3) // 4 AS n_tokens,
  CASE WHEN source IS NULL THEN '{NONE}' WHEN source = 'src0' THEN 'web' WHEN right(source, 1) IN ('1', '3', '5', '7', '9') THEN 'books' ELSE 'news' END AS domain
 FROM documents
), leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply, CAST(sum(n_tokens) * {EPOCHS} AS BIGINT) AS cap FROM given GROUP BY ALL
), d0 AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, {_CASE("domain", DOMAIN_WEIGHTS)} AS weight, (SELECT CAST(sum(supply) * {FRACTION_PERCENT} // 100 AS BIGINT) FROM leaf) AS budget FROM leaf GROUP BY domain
), d1 AS ({_FILL.format(by="1", name="domain", nodes="d0")}
), l0 AS (SELECT domain, lang, sum(leaf.cap)::BIGINT AS cap, {_CASE("lang", LANG_WEIGHTS)} AS weight, any_value(quota) AS budget FROM leaf JOIN (SELECT domain, quota FROM d1) USING (domain) GROUP BY domain, lang
), l1 AS ({_FILL.format(by="domain", name="lang", nodes="l0")}
), s0 AS (SELECT domain, lang, source, supply, leaf.cap, CAST(1 AS BIGINT) AS weight, quota AS budget FROM leaf JOIN (SELECT domain, lang, quota FROM l1) USING (domain, lang)
), s1 AS ({_FILL.format(by="domain, lang", name="source", nodes="s0")}
), plan AS (SELECT domain, lang, source, CASE WHEN supply > 0 THEN quota // supply ELSE 0 END AS whole, quota - CASE WHEN supply > 0 THEN quota // supply ELSE 0 END * supply AS rest FROM s1
), ordered AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY sha256('{SEED}/' || whole || '/' || coalesce(CAST(doc_id AS VARCHAR), '{NONE}')), n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM given JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM ordered
WHERE whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0
"""
