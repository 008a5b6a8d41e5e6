"""Data-quality checks over the supplied tables: one row with the number of violations each."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.operators import fixtures as fixture_ops
from snapledger.operators import quality
from snapledger.supplied.registry import query
from snapledger.supplied.tables import FIXTURES


def _sql(name: str, broken: str, ctes: str = "") -> str:
    return f"{ctes} select '{name}' as check, count(*) as violations from ({broken})"


@query(_sql("props_k", "select 1 from events where (props ->> '$.k') is null"))
def dq_not_null(t):
    with_k = t.events.select(F.get_json_object("props", "$.k").alias("k"))
    return quality.violations("props_k", quality.not_null(with_k, "k"))


@query(_sql("p_name", "select p_name from part where p_name is not null group by 1 having count(*) > 1"))
def dq_unique(t):
    return quality.violations("p_name", quality.unique(t.part, "p_name"))


@query(_sql("event_type", "select 1 from events where event_type not in ('view', 'click', 'purchase')"))
def dq_accepted(t):
    return quality.violations("event_type", quality.accepted_values(t.events, "event_type", ["view", "click", "purchase"]))


@query(_sql("label_parts", "select 1 from documents where doc_id not in (select doc_id from labels)"))
def dq_relationship(t):
    return quality.violations("label_parts", quality.relationships(t.documents, "doc_id", t.labels, "doc_id"))


@query(_sql("line_key", "select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1"))
def dq_grain(t):
    return quality.violations("line_key", quality.grain(t.lineitem, ["l_orderkey", "l_linenumber"]))


@query(_sql(
    "goals",
    "select load_date from sides where finished group by load_date having sum(goals_for) <> sum(goals_against)",
    f"with {FIXTURES}",
))
def dq_balance(t):
    results = fixture_ops.team_results(t.fixtures())
    return quality.violations("goals", quality.balance(results, ["load_date"], "goals_for", "goals_against"))


@query("""select left_total, right_total from (
  select (select count(*) from events where event_type = 'view') as left_total,
    (select cast(sum(length(p_brand)) as bigint) from part) as right_total) where left_total <> right_total""")
def dq_totals_agree(t):
    return quality.totals_agree(
        t.events.filter("event_type = 'view'"), F.count("*"), t.part, F.sum(F.length("p_brand"))
    )


@query("""select cast(nation as bigint) as nation, left_total, right_total
from (select c_nationkey as nation, count(*) as left_total from customer group by 1)
join (select s_nationkey as nation, count(*) as right_total from supplier group by 1) using (nation)
where left_total <> right_total""")
def dq_groups_agree(t):
    customers = t.customer.withColumnRenamed("c_nationkey", "nation")
    suppliers = t.supplier.withColumnRenamed("s_nationkey", "nation")
    return quality.groups_agree(customers, F.count("*"), suppliers, F.count("*"), ["nation"])


@query("""select l_returnflag, left_total, right_total
from (select l_returnflag, count(distinct l_orderkey) as left_total from lineitem group by 1)
join (select l_returnflag, count(*) as right_total from lineitem where l_linestatus = 'F' group by 1)
  using (l_returnflag)
where left_total <> right_total""")
def dq_reconcile(t):
    return quality.groups_agree(
        t.lineitem, F.count_distinct("l_orderkey"), t.lineitem.filter("l_linestatus = 'F'"), F.count("*"), ["l_returnflag"]
    )


@query("""select 'unknown_flag' as check, count(*) as violations from lineitem where l_returnflag not in ('A', 'N')
union all select 'no_discount', count(*) from lineitem where l_discount = 0
union all select 'no_quantity', count(*) from lineitem where l_quantity is null
union all select 'tax_above_discount', count(*) from lineitem where l_tax > l_discount
union all select 'line_key', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
union all select 'part', count(*) from (select 1 from lineitem where l_partkey is not null group by l_partkey having count(*) > 1)
union all select 'supplier_of_order', count(*) from (select 1 from lineitem group by l_orderkey, l_suppkey having count(*) > 1)
union all select 'lines_and_numbers', count(*) from (
  select 1 from lineitem group by l_returnflag having sum(l_linenumber) <> sum(cast(l_quantity as bigint)))""")
def dq_all_of_table(t):
    """All checks of one table from one scan: broken rows, keys and a balance."""
    lines = t.lineitem.withColumn("quantity", F.col("l_quantity").cast("bigint"))
    checks = quality.TableChecks(
        rows={
            "unknown_flag": ~F.col("l_returnflag").isin("A", "N"),
            "no_discount": F.col("l_discount") == 0,
            "no_quantity": F.col("l_quantity").isNull(),
            "tax_above_discount": F.col("l_tax") > F.col("l_discount"),
        },
        keys={"line_key": ["l_orderkey", "l_linenumber"], "part": ["l_partkey"], "supplier_of_order": ["l_orderkey", "l_suppkey"]},
        balances={"lines_and_numbers": (["l_returnflag"], "l_linenumber", "quantity")},
    )
    return quality.run_checks(lines, checks)
