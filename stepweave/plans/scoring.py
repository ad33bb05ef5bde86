"""Verdicts, rules and declarative checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepweave.functions import rules as R
from stepweave.functions import text as T
from stepweave.functions.similarity import char_ratio, fuzzy_ratio, line_ratio, same_code
from stepweave.operators import checks
from stepweave.operators.metrics import TIME_OF_DAY
from stepweave.plans.registry import register
from stepweave.session import table

VERDICTS = [
    (1, "SUCCESS: TRUE\nEXPLANATION: the file is saved"),
    (2, "success: false\nexplanation: it stopped early"),
    (3, "no verdict here"),
    (4, 'Result: ```json\n{"success": true, "explanation": "all steps done"}\n``` end'),
    (5, '{"success": "true", "explanation": "not a boolean"}'),
    (6, 'noise {"success": false, "explanation": "wrong window"} noise'),
]
VERDICT_ROWS = ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in VERDICTS)


@register(
    "verdict_text",
    f"""
with v(id, t) as (values {VERDICT_ROWS}),
b as (select id, t, coalesce(nullif(regexp_extract(t, '(?s)```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1), ''), nullif(regexp_extract(t, '(?s)(\\{{.*\\}})', 1), '')) as body from v),
j as (select id, t, case when body is not null and json_type(body, '$.success') = 'BOOLEAN' and json_type(body, '$.explanation') = 'VARCHAR' then body end as body from b)
select id, case when body is not null then cast(json_extract(body, '$.success') as boolean) when upper(regexp_extract(t, '(?i)SUCCESS:\\s*(true|false)', 1)) = 'TRUE' then true when upper(regexp_extract(t, '(?i)SUCCESS:\\s*(true|false)', 1)) = 'FALSE' then false end as success,
  coalesce(json_extract_string(body, '$.explanation'), nullif(trim(regexp_extract(t, '(?is)EXPLANATION:\\s*(.+)', 1)), '')) as explanation from j
""",
)
def verdict_text(spark, sf_dir):
    """A JSON verdict counts if its flag is boolean and its explanation a string; else the labelled lines do."""
    rows = spark.createDataFrame(VERDICTS, "id int, t string").withColumn("body", T.json_body("t"))
    rows = rows.withColumn("v", F.expr("try_parse_json(body)"))
    typed = F.expr("schema_of_variant(try_variant_get(v, '$.success', 'variant')) = 'BOOLEAN' and schema_of_variant(try_variant_get(v, '$.explanation', 'variant')) = 'STRING'")
    flag = F.when(typed, F.expr("try_variant_get(v, '$.success', 'boolean')"))
    told = F.when(typed, F.expr("try_variant_get(v, '$.explanation', 'string')"))
    return rows.select("id", F.coalesce(flag, T.verdict_flag("t")).alias("success"), F.coalesce(told, T.verdict_text("t")).alias("explanation"))


@register(
    "verdict_conjunction",
    """
with m as (select l.doc_id % 50 as task, cast(quality as double) as metric from labels l union all select l.doc_id % 50, 0.5 from labels l where quality = 1)
select cast(task as bigint) as task, case when bool_or(metric = 0) then 0.0 else avg(metric) end::double as all_score, case when bool_or(metric = 1) then 1.0 else max(metric) end::double as any_score from m group by task
""",
)
def verdict_conjunction(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("task"), F.col("quality").cast("double").alias("metric"))
    rows = labels.union(labels.where("metric = 1").withColumn("metric", F.lit(0.5)))
    return rows.groupBy("task").agg(R.conjunction("metric", "and").alias("all_score"), R.conjunction("metric", "or").alias("any_score"))


RULES = [
    ("eq", F.col, "l_returnflag", "eq", "R", "l_returnflag = 'R'"),
    ("lt", F.col, "l_quantity", "lt", 10.0, "l_quantity < 10"),
    ("approx", F.col, "l_discount", "approx:0.01", 0.05, "abs(l_discount - 0.05) <= 0.01"),
    ("range", F.col, "l_quantity", "range.te", [20.0, 30.0], "l_quantity > 20 and l_quantity <= 30"),
    ("regex", F.col, "l_linestatus", "re", "^[OF]$", "regexp_matches(l_linestatus, '^[OF]$')"),
]


@register("rule_eval", "select " + ", ".join(f"cast(count(*) filter (where {sql}) as bigint) as n_{name}" for name, _, _, _, _, sql in RULES) + " from lineitem")
def rule_eval(spark, sf_dir):
    counts = [F.count_if(R.rule(c, method, ref)).alias(f"n_{name}") for name, _, c, method, ref, _ in RULES]
    return table(spark, sf_dir, "lineitem").agg(*counts)


@register(
    "rule_pushdown",
    "select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_quantity >= 45 and l_discount > 0.08",
)
def rule_pushdown(spark, sf_dir):
    """The same rules as a filter: they reach the Parquet scan as comparisons."""
    found = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45) & (F.col("l_discount") > 0.08)
    return table(spark, sf_dir, "lineitem").where(found).select("l_orderkey", "l_linenumber")


@register(
    "expect_unexpect",
    "select case when bool_or(n_name = (select min(n_name) from nation) and n_regionkey is not null) and bool_or(n_nationkey = 3 and n_regionkey = (select n_regionkey from nation where n_nationkey = 3)) and not bool_or(n_nationkey = 99) then 1.0 else 0.0 end::double as score from nation",
)
def expect_unexpect(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    first = nation.agg(F.min("n_name").alias("n"), F.max(F.when(F.col("n_nationkey") == 3, F.col("n_regionkey"))).alias("r")).first()
    return checks.records_expected(nation, [{"n_name": first.n}, {"n_nationkey": 3, "n_regionkey": first.r}], [{"n_nationkey": 99}])


@register(
    "list_regex_check",
    "select case when bool_or(regexp_matches(text, 'Licen[cs]e')) and bool_or(regexp_matches(text, '[0-9]{2}')) and not bool_or(regexp_matches(text, '^@@@')) then 1.0 else 0.0 end::double as score from documents",
)
def list_regex_check(spark, sf_dir):
    return checks.lines_expected(table(spark, sf_dir, "documents").select("text"), "text", ["Licen[cs]e", "[0-9]{2}"], ["^@@@"])


@register("line_number_check", r"select doc_id, cast(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)'))) as bigint) as n_times from documents where text is not null")
def line_number_check(spark, sf_dir):
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(TIME_OF_DAY))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(lines).cast("long").alias("n_times"))


@register("include_exclude", "select doc_id, case when contains(text, 'the') and not contains(text, 'http') then 1.0 else 0.0 end::double as score from documents")
def include_exclude(spark, sf_dir):
    return checks.scored(table(spark, sf_dir, "documents"), "check_include_exclude", "text", ["the"], ["http"]).select("doc_id", "score")


@register(
    "text_equal_normalized",
    r"""
with s as (select doc_id, text, replace(text, ' ', '  ') as other from documents)
select doc_id, case when lower(regexp_replace(regexp_replace(text, '[\t\n\x0B\f\r ]+', ' ', 'g'), '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g')) = lower(regexp_replace(regexp_replace(other, '[\t\n\x0B\f\r ]+', ' ', 'g'), '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g')) then 1.0 else 0.0 end::double as loose,
  case when text = other then 1.0 else 0.0 end::double as strict from s
""",
)
def text_equal_normalized(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("other", F.replace("text", F.lit(" "), F.lit("  ")))
    loose = checks.REGISTRY["compare_text_file"]("text", "other", ignore_blanks=True, ignore_case=True)
    return rows.select("doc_id", loose.alias("loose"), checks.REGISTRY["compare_text_file"]("text", "other").alias("strict"))


@register(
    "literal_list_equal",
    """
with e as (select user_id, list(event_type order by ts, event_id) as a, list(event_type order by event_id desc) as b from events group by user_id)
select user_id, a = b as same_order, list_sort(a) = list_sort(b) as same_items from e
""",
)
def literal_list_equal(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda s: s["event_type"]).alias("a"),
        F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("event_id", "event_type")))), lambda s: s["event_type"]).alias("b"),
    )
    return pairs.select("user_id", (F.col("a") == F.col("b")).alias("same_order"), R.same_items("a", "b").alias("same_items"))


@register("fuzzy_ratio")
def fuzzy(spark, sf_dir):
    """Each benchmark text against the document of its number."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("other"))
    return table(spark, sf_dir, "benchmark").join(docs, "item_id").select("item_id", fuzzy_ratio("text", "other").alias("ratio"))


@register("diff_ratio")
def diff(spark, sf_dir):
    """Each benchmark text against the document of its number, whole texts, by difflib's own rules (its popular characters are junk)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("other"))
    both = table(spark, sf_dir, "benchmark").join(docs, "item_id")
    return both.select("item_id", line_ratio("text", "other").alias("lines"), char_ratio("text", "other").alias("chars"), same_code("text", "other").alias("same"))


@register(
    "norm_chain",
    "select p_partkey, lower(translate(regexp_replace(regexp_replace(replace(p_name, 'a', 'A1'), '^[pP ]+', ''), '[0-9]+$', ''), '#-', '')) as normed from part",
)
def norm_chain(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.rule_chain("p_name", [("a", "A1")], lstrip="pP ", rstrip="0123456789", drop="#-", lower=True).alias("normed"))


@register(
    "csv_record_parse",
    """
with r as (select l_orderkey, l_linenumber, cast(l_orderkey as varchar) || ', ' || cast(l_partkey as varchar) || ',' || l_returnflag || ',' || l_linestatus as line from lineitem)
select l_orderkey, l_linenumber, trim(split_part(line, ',', 2)) as second from r where len(string_split(line, ',')) = 4
""",
)
def csv_record_parse(spark, sf_dir):
    line = F.concat_ws(",", F.col("l_orderkey").cast("string"), F.concat(F.lit(" "), F.col("l_partkey").cast("string")), "l_returnflag", "l_linestatus")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.record_field(line, 2).alias("second"))
    return rows.where("second is not null")


@register(
    "unique_records",
    """
select case when (select count(o_custkey) = count(distinct o_custkey) from orders) and not exists (select o_custkey from orders except select c_custkey from customer) and not exists (select c_custkey from customer except select o_custkey from orders) then 1.0 else 0.0 end::double as score
""",
)
def unique_records(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return checks.unique_and_complete(orders, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


@register("records_subset", "select o_custkey as k, cast(count(*) as bigint) as n from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0) group by 1")
def records_subset(spark, sf_dir):
    """What keeps one set from being a subset of another."""
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).join(known, "k", "left_anti").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@register("score_rescale", "select l_orderkey, l_linenumber, round(case when l_discount * 10 > 0.51 then (l_discount * 10 - 0.5) / 0.5 else 0.0 end, 6) as score from lineitem")
def score_rescale(spark, sf_dir):
    s = F.col("l_discount") * 10
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(R.rescaled(s, 0.5), 6).alias("score"))


@register(
    "table_equal",
    """
with a as (select l_orderkey, l_linenumber, round(l_extendedprice, 4) as price from lineitem), b as (select l_orderkey, l_linenumber, round(l_extendedprice + 1e-6, 4) as price from lineitem)
select case when not exists (select * from a except all select * from b) and not exists (select * from b except all select * from a) then 1.0 else 0.0 end::double as score
""",
)
def table_equal(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return checks.tables_equal(a, a.withColumn("price", F.col("price") + 1e-6))


@register("sql_scalar", "select cast(coalesce(sum(1) > 0, false) as double) as score from labels where toxic = 1 and doc_id in (select doc_id from documents where lang = 'en')")
def sql_scalar(spark, sf_dir):
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    found = table(spark, sf_dir, "labels").where("toxic = 1").join(english, "doc_id", "left_semi")
    return checks.scalar_query(found.agg((F.sum(F.lit(1)) > 0).alias("found")))


@register(
    "list_equal_exist",
    """
with p as (select user_id, list(event_type order by event_id) as a, list_reverse(list(event_type order by event_id)) as b from events group by user_id)
select user_id, len(a) = len(b) and len(list_filter(a, lambda x: not list_contains(b, x))) = 0 as equal, len(list_filter(list_distinct(a), lambda x: x <> 'click')) = len(list_distinct(a)) as without_click from p
""",
)
def list_equal_exist(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda s: s["event_type"]).alias("a"))
    pairs = pairs.withColumn("b", F.reverse("a"))
    return pairs.select("user_id", R.list_equal_one_way("a", "b").alias("equal"), R.subset("a", F.array_remove("a", "click")).alias("without_click"))


@register(
    "zip_compare",
    """
with p as (select l_orderkey, list(l_quantity order by l_linenumber) as a, list(l_extendedprice order by l_linenumber)[2:] as b from lineitem group by l_orderkey)
select l_orderkey, cast(least(len(a), len(b)) as bigint) as n, cast(len(list_filter(range(1, 1 + least(len(a), len(b))), lambda i: a[i] < b[i])) as bigint) as n_less from p
""",
)
def zip_compare(spark, sf_dir):
    """Positional comparison of two lists, as long as the shorter."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", c))), lambda s: s[c])
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(ordered("l_quantity").alias("a"), ordered("l_extendedprice").alias("b0"))
    p = p.withColumn("b", F.slice("b0", F.lit(2), F.greatest(F.size("b0") - 1, F.lit(0)))).withColumn("n", F.least(F.size("a"), F.size("b")))
    less = F.filter(F.arrays_zip(F.slice("a", F.lit(1), F.col("n")).alias("a"), "b"), lambda x: x["a"] < x["b"])
    return p.select("l_orderkey", F.col("n").cast("long").alias("n"), F.size(less).cast("long").alias("n_less"))


@register(
    "json_subset",
    """
select event_id, coalesce(cast(json_extract(props, '$.k') as bigint), -1) as k, coalesce(cast(json_extract(props, '$.k') as bigint) >= 50, false) as met, coalesce(json_extract(props, '$.missing') is not null, false) as has_missing from events
""",
)
def json_subset(spark, sf_dir):
    """A JSON path, then a rule; a missing path is no match."""
    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')")
    missing = F.expr("try_variant_get(try_parse_json(props), '$.missing', 'string')")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(k, F.lit(-1).cast("long")).alias("k"), R.rule(k, "ge", 50).alias("met"), missing.isNotNull().alias("has_missing"))


@register(
    "infeasible_check",
    "select conv_id, case when arg_max(upper(trim(role)), turn) = 'SYSTEM' then 1.0 else 0.0 end::double as score from conversations group by conv_id",
)
def infeasible_check(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(checks.score(F.max_by(F.upper(F.trim("role")), "turn") == "SYSTEM").alias("score"))


@register(
    "metric_list",
    """
select p_partkey, case when least(a, b) = 0 then 0.0 else (a + b) / 2 end::double as score from (
  select p_partkey, case when contains(p_type, 'STEEL') or contains(p_type, 'A') then 1.0 else 0.0 end as a0, case when p_size > 10 then 1.0 else 0.0 end as b, case when contains(p_name, 'a') then 1.0 else 0.0 end as a from part)
""",
)
def metric_list(spark, sf_dir):
    """Checks by name, aligned with their options."""
    part = table(spark, sf_dir, "part").withColumn("big", F.when(F.col("p_size") > 10, "1.5").otherwise("0"))
    named = [("file_contains", ("p_name", ["a"]), {}), ("check_text_enlarged", ("big",), {})]
    return checks.all_checks(part, named).select("p_partkey", "score")


@register(
    "image_statistics",
    """
with p as (select l_orderkey % 20 as img, cast(l_quantity as integer) * 5 as r, cast(l_linenumber as integer) * 30 as g, cast(round(l_discount * 1000) as integer) as b from lineitem),
s as (select img, floor(r * 0.299::double + g * 0.587::double + b * 0.114::double + 0.5) as l, case when greatest(r, g, b) = 0 then 0 else floor(255.0 * (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b)) end as s from p)
select img, round(avg(l), 6) as brightness, round(stddev_pop(l), 6) as contrast, round(avg(s), 6) as saturation from s group by img
""",
)
def image_statistics(spark, sf_dir):
    pixels = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 20).alias("img"), (F.col("l_quantity").cast("int") * 5).alias("r"), (F.col("l_linenumber") * 30).alias("g"), F.round(F.col("l_discount") * 1000).cast("int").alias("b")
    )
    return checks.image_statistics(pixels).select("img", *[F.round(c, 6).alias(c) for c in ("brightness", "contrast", "saturation")])


@register(
    "second_rarest_color",
    """
with c as (select l_suppkey % 7 as img, l_returnflag as r, l_linestatus as g, l_linenumber as b, count(*) as n, avg(l_quantity) as cx, avg(l_discount) as cy from lineitem group by 1, 2, 3, 4)
select img, r, g, b, cast(n as bigint) as n, round(cx, 6) as cx, round(cy, 6) as cy from (select *, row_number() over (partition by img order by n, r, g, b) as k from c) where k = 2
""",
)
def second_rarest_color(spark, sf_dir):
    pixels = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("img"), F.col("l_returnflag").alias("r"), F.col("l_linestatus").alias("g"), F.col("l_linenumber").alias("b"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return checks.second_rarest_color(pixels).select("img", "r", "g", "b", "n", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))
