"""Entity matching over customers and suppliers, and names over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.functions.text import decode_apostrophe, name_key, name_keys, strip_accents
from snapledger.operators import matching
from snapledger.operators.matching import Rung
from snapledger.supplied.registry import query
from snapledger.supplied.tables import Tables

RUNGS = [
    Rung("nation_balance", "nation_balance", "nation_balance"),
    Rung("balance", "balance", "balance"),
    Rung("number", "number", "number"),
]

SIDES = """customers as (
  select c_custkey as left_id, lower(split_part(c_name, '#', -1)) as number,
    c_nationkey || '/' || cast(floor(c_acctbal / 100) as bigint) as nation_balance,
    cast(cast(floor(c_acctbal / 10) as bigint) as varchar) as balance
  from customer),
suppliers as (
  select s_suppkey as right_id, s_suppkey + 7000000 as stable_key, lower(split_part(s_name, '#', -1)) as number,
    s_nationkey || '/' || cast(floor(s_acctbal / 100) as bigint) as nation_balance,
    cast(cast(floor(s_acctbal / 10) as bigint) as varchar) as balance
  from supplier)"""


def _rung_sql(name: str, earlier: list[str]) -> str:
    taken_left = "".join(f" and left_id not in (select left_id from {e})" for e in earlier)
    taken_right = "".join(f" and right_id not in (select right_id from {e})" for e in earlier)
    return f"""by_{name} as (
  select left_id, right_id, '{name}' as match_rule
  from (select left_id, right_id, count(*) over (partition by left_id) as per_left,
      count(*) over (partition by right_id) as per_right
    from customers join suppliers using ({name}) where true{taken_left}{taken_right})
  where per_left = 1 and per_right = 1)"""


LADDER = f"""{SIDES},
{_rung_sql("nation_balance", [])},
{_rung_sql("balance", ["by_nation_balance"])},
{_rung_sql("number", ["by_nation_balance", "by_balance"])},
ladder as (
  select * from by_nation_balance union all select * from by_balance union all select * from by_number)"""

# The first rung as both maps use it: ids that share an ambiguous value of it are out of the later rungs.
GUARDED_LADDER = f"""{SIDES},
shared as (
  select nation_balance from (select nation_balance, count(*) as n from customers group by 1) a
  join (select nation_balance, count(*) as m from suppliers group by 1) b using (nation_balance) where n > 1 or m > 1),
{_rung_sql("nation_balance", [])},
taken as (
  select left_id, null::bigint as right_id from customers where nation_balance in (select nation_balance from shared)
  union all select null::bigint, right_id from suppliers where nation_balance in (select nation_balance from shared)
  union all select left_id, right_id from by_nation_balance),
out_left as (select left_id from taken where left_id is not null),
out_right as (select right_id from taken where right_id is not null),
by_balance as (
  select left_id, right_id, 'balance' as match_rule
  from (select left_id, right_id, count(*) over (partition by left_id) as per_left,
      count(*) over (partition by right_id) as per_right
    from customers join suppliers using (balance)
    where left_id not in (select left_id from out_left) and right_id not in (select right_id from out_right))
  where per_left = 1 and per_right = 1),
by_number as (
  select left_id, right_id, 'number' as match_rule
  from (select left_id, right_id, count(*) over (partition by left_id) as per_left,
      count(*) over (partition by right_id) as per_right
    from customers join suppliers using (number)
    where left_id not in (select left_id from out_left union all select left_id from by_balance)
      and right_id not in (select right_id from out_right union all select right_id from by_balance))
  where per_left = 1 and per_right = 1)"""

# The largest account of a nation on both sides stands for a hand-verified pair.
OVERRIDES = f"""{LADDER},
overrides as (
  select left_id, right_id from (
    select c_nationkey as nation, max(c_custkey) as left_id from customer where (c_nationkey, c_acctbal) in
      (select (c_nationkey, max(c_acctbal)) from customer group by c_nationkey) group by 1)
  join (
    select s_nationkey as nation, max(s_suppkey) as right_id from supplier where (s_nationkey, s_acctbal) in
      (select (s_nationkey, max(s_acctbal)) from supplier group by s_nationkey) group by 1) using (nation)),
resolved as (
  select left_id, right_id, 'manual' as match_rule from overrides
  union all
  select * from ladder where left_id not in (select left_id from overrides)
    and right_id not in (select right_id from overrides))"""


def _keys(df: DataFrame, prefix: str, key: str, out: str) -> DataFrame:
    balance = F.col(f"{prefix}_acctbal")
    nation_balance = F.concat(
        F.col(f"{prefix}_nationkey").cast("string"), F.lit("/"), F.floor(balance / 100).cast("string")
    )
    return df.select(
        F.col(key).alias(out),
        F.lower(F.split_part(f"{prefix}_name", F.lit("#"), F.lit(-1))).alias("number"),
        nation_balance.alias("nation_balance"),
        F.floor(balance / 10).cast("string").alias("balance"),
    )


def _customers(t: Tables) -> DataFrame:
    return _keys(t.customer, "c", "c_custkey", "left_id")


def _suppliers(t: Tables) -> DataFrame:
    keyed = _keys(t.supplier, "s", "s_suppkey", "right_id")
    return keyed.withColumn("stable_key", F.col("right_id") + 7000000)


def _ladder(t: Tables) -> DataFrame:
    return matching.match_ladder(_customers(t), _suppliers(t), "left_id", "right_id", RUNGS)


@query(f"with {GUARDED_LADDER} select * from by_nation_balance union all select * from by_balance union all select * from by_number")
def match_ladder_ambiguous(t):
    """The ladder with a first rung that takes ids with an ambiguous value out of the others."""
    rungs = [RUNGS[0]._replace(takes_ambiguous=True), *RUNGS[1:]]
    return matching.match_ladder(_customers(t), _suppliers(t), "left_id", "right_id", rungs)


@query(f"with {LADDER} select * from ladder")
def match_ladder(t):
    return _ladder(t)


@query(f"""with {OVERRIDES}
select left_id, right_id, stable_key, match_rule from resolved join suppliers using (right_id)""")
def match_ladder_overrides(t):
    first = t.customer.groupBy("c_nationkey").agg(
        F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("left_id")
    )
    second = t.supplier.groupBy("s_nationkey").agg(
        (F.max_by("s_suppkey", F.struct("s_acctbal", "s_suppkey")) + 7000000).alias("stable_key")
    )
    overrides = first.join(second, F.col("c_nationkey") == F.col("s_nationkey")).select("left_id", "stable_key")
    return matching.apply_overrides(_ladder(t), overrides, _suppliers(t), "left_id", "right_id", "stable_key")


@query(f"""with {LADDER}
select coalesce(match_rule, 'unmatched') as match_rule, count(*) as entities
from customers left join ladder using (left_id) group by 1""")
def match_coverage(t):
    return matching.match_coverage(_customers(t), _ladder(t), "left_id")


@query(f"""with {SIDES}
select 'nation_balance' as match_rule, nation_balance as name_key, n_left, n_right
from (select nation_balance, count(*) as n_left from customers group by 1)
join (select nation_balance, count(*) as n_right from suppliers group by 1) using (nation_balance)
where n_left > 1 or n_right > 1""")
def ambiguous_keys(t):
    return matching.ambiguous_keys(_customers(t), _suppliers(t), "left_id", "right_id", RUNGS[0])


@query("""with entries as (
  select l_orderkey, unnest([l_partkey, 1000000000 + l_suppkey]) as entity_id,
    unnest([l_returnflag, l_linestatus]) as name
  from lineitem),
counted as (select entity_id, name, count(*) as n from entries group by 1, 2),
usual as (
  select entity_id, name as entity_name from (
    select *, row_number() over (partition by entity_id order by n desc, name) as rn from counted) where rn = 1)
select entity_id, entity_name, appearances
from (select entity_id, count(distinct l_orderkey) as appearances from entries group by 1) join usual using (entity_id)""")
def entity_names(t):
    """Every line names its part and its supplier; the usual name wins, the lowest on a tie."""
    names = F.create_map(
        F.col("l_partkey").cast("string"),
        "l_returnflag",
        (F.col("l_suppkey") + 1000000000).cast("string"),
        "l_linestatus",
    )
    return matching.entity_names(t.lineitem.withColumn("names", names), "names", "l_orderkey", "bigint")


@query("""select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, e.key as entry, e.value as flag
from (select l_orderkey, l_linenumber,
    unnest(map_entries(map(['part' || l_partkey, 'supplier' || l_suppkey], [l_returnflag, l_linestatus]))) as e
  from lineitem)""")
def map_entries_explode(t):
    names = F.create_map(
        F.concat(F.lit("part"), F.col("l_partkey").cast("string")),
        "l_returnflag",
        F.concat(F.lit("supplier"), F.col("l_suppkey").cast("string")),
        "l_linestatus",
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", F.explode(names).alias("entry", "flag"))


@query("""select doc_id, md5(lower(strip_accents(text))) as folded, length(strip_accents(text)) as n
from documents""")
def accent_fold(t):
    """Accent-free lower-case form of every whole text."""
    return t.documents.select(
        "doc_id",
        F.md5(name_key(F.col("text"))).alias("folded"),
        F.length(strip_accents(F.col("text"))).cast("bigint").alias("n"),
    )


@query("""select doc_id, md5(lower(strip_accents(text || ' ' || source))) as full_name,
  lower(strip_accents(split_part(text, ' ', 1) || ' ' || split_part(source, ' ', -1))) as short_name,
  lower(strip_accents(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 1))) as first_tokens,
  lower(strip_accents(split_part(text, ' ', -1))) as web_name
from documents""")
def name_keys_of_texts(t):
    text, source = F.col("text"), F.col("source")
    long = name_keys(text, source, F.split_part(text, F.lit(" "), F.lit(-1)))
    tokens = name_keys(text, text, source)
    return t.documents.select(
        "doc_id",
        F.md5(long["full_name"]).alias("full_name"),
        long["short_name"].alias("short_name"),
        tokens["first_tokens"].alias("first_tokens"),
        long["web_name"].alias("web_name"),
    )


@query("""select page_id, md5(replace(html, '&#039;', '''')) as decoded, length(html) as n from pages""")
def entity_decode(t):
    return t.pages.select(
        "page_id",
        F.md5(decode_apostrophe(F.col("html"))).alias("decoded"),
        F.length("html").cast("bigint").alias("n"),
    )
