"""Message transforms, sheets, retrieval, URLs, dates, coordinates, trees and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepweave.functions import actions as A
from stepweave.functions import dates as D
from stepweave.functions import text as T
from stepweave.functions import urls as U
from stepweave.functions.similarity import inner_product, norm
from stepweave.operators import graphs, messages, retrieval, sheets, trees
from stepweave.plans.registry import register
from stepweave.session import table


def conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


# messages


@register(
    "msg_limiter",
    """
with r as (select *, row_number() over (partition by conv_id order by turn) as o, row_number() over (partition by conv_id order by turn desc) as n from conversations)
select conv_id, turn, cast(row_number() over (partition by conv_id order by turn) as bigint) as place from r where (o = 1 or n <= 2) and not (n = 2 and role = 'tool' and o <> 1)
""",
)
def msg_limiter(spark, sf_dir):
    return messages.limit_messages(conversations(spark, sf_dir), ["conv_id"], "turn", 3, keep_first=True).select("conv_id", "turn", "place")


@register(
    "msg_token_cut",
    r"""
with t as (select conv_id, turn, least(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\t\n\x0B\f\r ]+'), lambda w: w <> '')), 20) as k from conversations),
u as (select *, coalesce(sum(k) over (partition by conv_id order by turn desc rows between unbounded preceding and 1 preceding), 0) as used from t),
v as (select *, used + 20 > 60 as over, sum(case when used + 20 > 60 then 1 else 0 end) over (partition by conv_id order by turn desc rows unbounded preceding) as edge from u)
select conv_id, turn, cast(case when edge = 0 then k else least(k, 60 - used) end as bigint) as kept_tokens from v where edge = 0 or (edge = 1 and over)
""",
)
def msg_token_cut(spark, sf_dir):
    tokens = messages.white_space_tokens(F.coalesce("text", F.lit("")))
    return messages.cut_tokens(conversations(spark, sf_dir), ["conv_id"], "turn", tokens, 60, 20).select("conv_id", "turn", "kept_tokens")


@register(
    "msg_keep_images",
    """
with r as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as o, count(*) over (partition by conv_id) as c from conversations)
select conv_id, turn from r where o > greatest(0, c - 3) - greatest(0, c - 3) % 2
""",
)
def msg_keep_images(spark, sf_dir):
    return messages.keep_recent_images(conversations(spark, sf_dir).select("conv_id", "turn"), ["conv_id"], ["turn"], 3, 2)


@register(
    "msg_cache_breakpoints",
    "select conv_id, turn, role = 'user' and row_number() over (partition by conv_id, role order by turn desc) <= 3 as breakpoint from conversations",
)
def msg_cache_breakpoints(spark, sf_dir):
    return messages.cache_breakpoints(conversations(spark, sf_dir).select("conv_id", "turn", "role"), ["conv_id"], "turn").select("conv_id", "turn", "breakpoint")


@register("msg_filter_dict", "select conv_id, turn from conversations where role not in ('system') and turn not in (0, 2)")
def msg_filter_dict(spark, sf_dir):
    return messages.filter_messages(conversations(spark, sf_dir), {"role": ["system"], "turn": [0, 2]}, exclude=True).select("conv_id", "turn")


@register(
    "msg_name_prefix",
    "select conv_id, turn, case when starts_with(text, role || ': ') then text else role || ': ' || text end as text from conversations",
)
def msg_name_prefix(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", "turn", T.with_affix("text", "role", "{name}: ").alias("text"))


@register("msg_truncate_where", "select conv_id, turn, case when role = 'assistant' then case when length(text) > 40 then substr(text, 1, 40) || '...' else text end else text end as text from conversations")
def msg_truncate_where(spark, sf_dir):
    return messages.transform_where(conversations(spark, sf_dir), {"role": ["assistant"]}, "text", T.truncated("text", 40)).select("conv_id", "turn", "text")


@register(
    "msg_token_totals",
    r"select conv_id, cast(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\t\n\x0B\f\r ]+'), lambda w: w <> ''))) as bigint) as tokens from conversations group by conv_id",
)
def msg_token_totals(spark, sf_dir):
    return conversations(spark, sf_dir).groupBy("conv_id").agg(F.sum(messages.white_space_tokens(F.coalesce("text", F.lit("")))).alias("tokens"))


@register("msg_compress", "select conv_id, turn, substr(text, 1, 20) as text from conversations")
def msg_compress(spark, sf_dir):
    """A compressor with a cache by content: each distinct text goes through it once."""
    cache = spark.createDataFrame([], "content string, compressed string")
    rows, _ = messages.compress(conversations(spark, sf_dir).select("conv_id", "turn", "text"), "text", cache, lambda t: F.substring(t, 1, 20))
    return rows.select("conv_id", "turn", "text")


# sheets


@register("sheet_sort", "select p_partkey, p_name, p_retailprice from part")
def sheet_sort(spark, sf_dir):
    return sheets.column_sort(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), "p_retailprice", ascending=False, ties="p_partkey")


@register(
    "sheet_pivot",
    "select l_returnflag, " + ", ".join(f"{sql} filter (where l_linestatus = '{s}') as {how}_{s}" for how, sql in (("sum", "sum(l_quantity)"), ("average", "round(avg(l_quantity), 6)"), ("min", "min(l_quantity)"), ("max", "max(l_quantity)"), ("count", "count(l_quantity)")) for s in "FO").replace("round(avg(l_quantity), 6) filter (where l_linestatus = 'F')", "round(avg(l_quantity) filter (where l_linestatus = 'F'), 6)").replace("round(avg(l_quantity), 6) filter (where l_linestatus = 'O')", "round(avg(l_quantity) filter (where l_linestatus = 'O'), 6)") + " from lineitem group by l_returnflag",
)
def sheet_pivot(spark, sf_dir):
    """All five aggregates from one scan and one shuffle."""
    cells = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    found = {"sum": F.sum, "average": F.avg, "min": F.min, "max": F.max, "count": F.count}
    wide = cells.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(*[f("l_quantity").alias(how) for how, f in found.items()])
    return wide.select("l_returnflag", *[(F.round(f"{s}_{how}", 6) if how == "average" else F.col(f"{s}_{how}")).alias(f"{how}_{s}") for how in found for s in "FO"])


@register("sheet_hide_rows", "select l_orderkey, l_linenumber, l_returnflag, l_linestatus from lineitem where not (l_returnflag = 'R' or l_linestatus = 'R' or cast(l_orderkey as varchar) = 'R')")
def sheet_hide_rows(spark, sf_dir):
    return sheets.hide_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), "R")


@register("sheet_validate", "select o_orderkey, o_orderstatus from orders where o_orderstatus is null or o_orderstatus not in ('F', 'O')")
def sheet_validate(spark, sf_dir):
    return sheets.violations(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O"])


@register(
    "sheet_transpose",
    """
select 'r_name' as field, max(case when r_regionkey = 0 then r_name end) as "0", max(case when r_regionkey = 1 then r_name end) as "1", max(case when r_regionkey = 2 then r_name end) as "2", max(case when r_regionkey = 3 then r_name end) as "3", max(case when r_regionkey = 4 then r_name end) as "4" from region
""",
)
def sheet_transpose(spark, sf_dir):
    return sheets.transpose(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_regionkey")


@register(
    "sheet_column_widths",
    """
select 'n_nationkey' as "column", cast(greatest(max(length(cast(n_nationkey as varchar))), length('n_nationkey')) as bigint) as width from nation union all select 'n_name', cast(greatest(max(length(n_name)), length('n_name')) as bigint) from nation union all select 'n_regionkey', cast(greatest(max(length(cast(n_regionkey as varchar))), length('n_regionkey')) as bigint) from nation
""",
)
def sheet_column_widths(spark, sf_dir):
    return sheets.widths(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@register("sheet_last_row", "select cast(p_partkey as varchar) as p_partkey, p_name, p_brand from part order by part.p_partkey desc limit 1")
def sheet_last_row(spark, sf_dir):
    return sheets.last_row(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), F.col("p_partkey"))


@register(
    "sheet_cells_equal",
    "select case when bool_and(trim(a.n_name) is not distinct from trim(b.n_name)) then 1.0 else 0.0 end::double as score from nation a full join (select n_nationkey, ' ' || n_name || ' ' as n_name from nation) b on a.n_nationkey = b.n_nationkey",
)
def sheet_cells_equal(spark, sf_dir):
    from stepweave.operators import checks

    a = table(spark, sf_dir, "nation").select(F.lit(0).alias("t"), F.col("n_nationkey").alias("row"), F.lit(0).alias("col"), F.col("n_name").alias("text"))
    return checks.cells_equal(a, a.withColumn("text", F.concat(F.lit(" "), "text", F.lit(" "))))


TYPED = [("=SUM(A1:A3)",), ("42",), ("4.5",), ("hello",), ("-7",)]


@register("sheet_typed_cells", "select * from (values ('=SUM(A1:A3)', 'formula', null), ('42', 'int', 42.0), ('4.5', 'float', 4.5), ('hello', 'string', null), ('-7', 'int', -7.0)) v(value, kind, number)".replace("select *", "select value, kind, cast(number as double) as number"))
def sheet_typed_cells(spark, sf_dir):
    return spark.createDataFrame(TYPED, "value string").withColumn("c", T.typed_cell("value")).select("value", "c.kind", "c.number")


REFS = [("A1",), ("Z10",), ("AA3",), ("BC12",)]


@register("sheet_cell_references", "select ref, cast(col as integer) as col, cast(row_at as integer) as row_at from (values ('A1', 0, 0), ('Z10', 25, 9), ('AA3', 26, 2), ('BC12', 54, 11)) v(ref, col, row_at)")
def sheet_cell_references(spark, sf_dir):
    return spark.createDataFrame(REFS, "ref string").select("ref", T.cell_column("ref").alias("col"), T.cell_row("ref").alias("row_at"))


# retrieval

QUERY_ROWS = "(select vec_id, embedding::double[] as v from embeddings order by vec_id limit 10)"


@register(
    "knn_topk",
    f"""
with s as (select q.vec_id as query_id, e.vec_id, list_dot_product(q.v, e.embedding::double[]) as score from {QUERY_ROWS} q join embeddings e on e.vec_id <> q.vec_id)
select query_id, vec_id, cast(r as bigint) as rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from s) where r <= 5
""",
)
def knn_topk(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings")
    found = retrieval.nearest(base.orderBy("vec_id").limit(10), base, "vec_id", "embedding", 5, kind="inner")
    return found.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@register(
    "knn_top1_skip_self",
    f"""
with s as (select q.vec_id as query_id, e.vec_id, list_cosine_similarity(q.v, e.embedding::double[]) as score from {QUERY_ROWS} q join embeddings e on e.vec_id <> q.vec_id)
select query_id, vec_id, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from s) where r = 1
""",
)
def knn_top1_skip_self(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings")
    return retrieval.nearest(base.orderBy("vec_id").limit(10), base, "vec_id", "embedding", 1).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@register(
    "knn_threshold",
    f"select q.vec_id as query_id, e.vec_id, round(list_cosine_similarity(q.v, e.embedding::double[]), 6) as score from {QUERY_ROWS} q join embeddings e on e.vec_id <> q.vec_id where 1 - list_cosine_similarity(q.v, e.embedding::double[]) < 0.7",
)
def knn_threshold(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings")
    return retrieval.within(base.orderBy("vec_id").limit(10), base, "vec_id", "embedding", 0.7).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@register("knn_threshold_all")
def knn_threshold_all(spark, sf_dir):
    """knn_threshold with every vector as a query, in blocks against all rows. It has no SQL twin: tests hold it against brute force."""
    base = table(spark, sf_dir, "embeddings")
    return retrieval.within(base, base, "vec_id", "embedding", 0.7).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@register("vector_norms", "select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm, round(list_dot_product(embedding::double[], list_reverse(embedding)::double[]), 6) as mirrored from embeddings")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm("embedding"), 6).alias("norm"), F.round(inner_product("embedding", F.reverse("embedding")), 6).alias("mirrored"))


@register("contains_text", "select doc_id from documents where contains(text, 'License')")
def contains_text(spark, sf_dir):
    return retrieval.containing(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "License").select("doc_id")


@register("chunk_text")
def chunk_text(spark, sf_dir):
    return retrieval.chunk_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 200, break_at_blank=False, overlap=1)


# urls and pages

HOST = r"lower(regexp_extract(url, '://([^/?#]*)', 1))"


@register(
    "url_normalize",
    rf"""
with p as (select page_id, url, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+\-.]*)://', 1)) as s, regexp_replace(regexp_replace({HOST}, '\.({"|".join(x.replace(".", chr(92) + ".") for x in U.SUFFIXES)})$', ''), '^www\.', '') as h,
  regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '\?([^#]*)', 1) as q, regexp_extract(url, '#(.*)$', 1) as f from pages)
select page_id, s || '://' || h || case when path = '/' then '' else path end as brief, s || '://' || h || case when path = '/' then '' else path end || case when q <> '' then '?' || q else '' end || case when f <> '' then '#' || f else '' end as full_url from p
""",
)
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.normalized_url("url", full=False).alias("brief"), U.normalized_url("url").alias("full_url"))


@register("url_query_params", "select page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') as page, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') as utm_source, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') as ref from pages")
def url_query_params(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *[U.parameter("url", k).alias(k) for k in ("page", "utm_source", "ref")])


@register("url_path_part", "select page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/')[4] as part from pages")
def url_path_part(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.path_part("url", 3).alias("part"))


@register("url_without_query", r"select page_id, regexp_replace(url, '\?[^#]*', '') as url, url similar to '[a-z]+://.+' as is_url from pages")
def url_without_query(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.without_query("url").alias("url"), U.is_url("url").alias("is_url"))


@register(
    "url_tab_join",
    "select a.page_id as page_id, b.page_id as tab_id from pages a join pages b on rtrim(a.url, '/') = rtrim(b.url, '/') and a.page_id <> b.page_id",
)
def url_tab_join(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.rtrim("url", F.lit("/")).alias("u"))
    return pages.join(pages.withColumnRenamed("page_id", "tab_id"), "u").where("page_id <> tab_id").select("page_id", "tab_id")


@register("html_text")
def html_text(spark, sf_dir):
    from stepweave.functions.html import markdown

    return table(spark, sf_dir, "pages").select("page_id", markdown("html").alias("text"))


# dates


@register(
    "rel_dates",
    """
with d as (select l_orderkey, l_linenumber, cast(l_shipdate as date) as d from lineitem),
r as (select l_orderkey, l_linenumber, d + cast(8 - isodow(d) as integer) as next_monday, date_trunc('month', d) + interval 1 month + interval 4 day as fifth, date_trunc('month', d) + interval 4 month as m4 from d)
select l_orderkey, l_linenumber, cast(next_monday as date) as next_monday, cast(fifth as date) as fifth_next_month, cast(m4 as date) + cast((8 - isodow(m4)) % 7 as integer) as first_monday,
  strftime(next_monday, '%a') || ', ' || strftime(next_monday, '%b') || ' ' || cast(day(next_monday) as varchar) as label from r
""",
)
def rel_dates(spark, sf_dir):
    monday = D.relative_date("l_shipdate", "next Monday")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", monday.alias("next_monday"), D.relative_date("l_shipdate", "5th next month").alias("fifth_next_month"), D.relative_date("l_shipdate", "first monday four months later").alias("first_monday"), D.formatted("{DoW}, {Month} {DayD}", monday).alias("label")
    )


@register("epoch_1601", "select event_id, epoch_us(ts) + 11644473600000000 as browser, ts as back from events")
def epoch_1601(spark, sf_dir):
    micros = D.browser_time("ts")
    return table(spark, sf_dir, "events").select("event_id", micros.alias("browser"), D.from_browser_time(micros).alias("back"))


@register("ts_parse", "select event_id, strftime(ts, '%Y%m%d@%H%M%S') as written, date_trunc('second', ts) as parsed from events")
def ts_parse(spark, sf_dir):
    written = D.action_time("ts")
    return table(spark, sf_dir, "events").select("event_id", written.alias("written"), D.parse_action_time(written).alias("parsed"))


@register("time_tolerance", "select e.event_id, abs(epoch_us(e.ts) - epoch_us(f.ts)) <= 90000000 as near from events e join events f on f.event_id = e.event_id + 1")
def time_tolerance(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    f = e.select((F.col("event_id") - 1).alias("event_id"), F.col("ts").alias("ts2"))
    return e.join(f, "event_id").select("event_id", D.within_minutes("ts", "ts2", 1.5).alias("near"))


# coordinates and actions


@register(
    "coord_grid",
    """
select l_orderkey, l_linenumber, cast(greatest(0, least(999, round_even(greatest(0.0, least(1280.0, l_quantity * 30)) / 1280.0 * 999, 0))) as integer) as x,
  cast(round_even(l_quantity * (720.0 / 800.0), 0) as integer) as y from lineitem
""",
)
def coord_grid(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", A.scale_axis(F.col("l_quantity") * 30, 1280.0).alias("x"), A.rescale_axis("l_quantity", 800.0, 720.0).alias("y"))


@register("coord_boxes", "select l_orderkey, l_linenumber, cast(trunc(l_quantity * (1000.0 / 1280.0)) as integer) as x, cast(trunc(l_quantity / 1000 * 720) as integer) as y from lineitem")
def coord_boxes(spark, sf_dir):
    box = A.box_convert(F.array("l_quantity", "l_quantity"), "absolute", "grid1000", (1280.0, 720.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box[0].alias("x"), A.projected("l_quantity", "grid", 720.0).alias("y"))


KEYS = [("ctrl+c",), ("shift + tab",), ("a",), ("+",)]


@register("key_combo", "select text, array_to_string(list_filter(list_transform(string_split(text, '+'), lambda x: trim(x)), lambda x: x <> ''), '|') as keys from (values ('ctrl+c'), ('shift + tab'), ('a'), ('+')) v(text)")
def key_combo(spark, sf_dir):
    return spark.createDataFrame(KEYS, "text string").select("text", F.array_join(T.key_combination("text"), "|").alias("keys"))


CODES = [
    (1, "pyautogui.click(100, 200)"),
    (2, "pyautogui.moveTo(10, 20); pyautogui.dragTo(110, 120)"),
    (3, "pyautogui.scroll(-5)"),
    (4, "pyautogui.typewrite('hello world')"),
    (5, "pyautogui.hotkey('ctrl', 'c')"),
    (6, "time.sleep(2.4)"),
    (7, "DONE"),
    (8, "{'action_space': 'pyautogui', 'action': 'pyautogui.doubleClick(x=640, y=400)'}"),
    (9, "pyautogui.press('enter')"),
    (10, "not code ("),
]


@register("action_parse")
def action_parse(spark, sf_dir):
    rows = spark.createDataFrame(CODES, "id int, code string").withColumn("a", A.typed_action("code"))
    return rows.select("id", "a.action", F.array_join(F.col("a.coordinate").cast("array<string>"), ",").alias("coordinate"), "a.text", A.tool_call("a", F.col("code") == "DONE", F.lit("done")).alias("call"))


@register("action_parse_human")
def action_parse_human(spark, sf_dir):
    codes = [(1, "pyautogui.click(x=0.5, y=0.25)"), (2, "time.sleep(1.5)"), (3, "pyautogui.hotkey('ctrl', 'v')\npyautogui.press('a')"), (4, "pyautogui.scroll(-500)"), (5, "pyautogui.write(message='hi, there')"), (6, "__import__('os')")]
    rows = spark.createDataFrame(codes, "id int, code string").withColumn("a", A.typed_human_action("code"))
    return rows.select("id", "a.action", F.array_join(F.col("a.coordinate").cast("array<string>"), ",").alias("coordinate"), "a.text", "a.scroll_amount", "a.duration")


# trees, boxes and graphs

TREES = [
    (1, "<desktop><application name='editor' active='true'><frame name='Main' visible='true' showing='true' enabled='true' screencoord='(0, 0)' size='(100, 80)'><push-button name='Save' visible='true' showing='true' enabled='true' screencoord='(10, 10)' size='(20, 10)'/><label name='Hidden' visible='false' showing='true' enabled='true' screencoord='(10, 30)' size='(20, 10)'/><text visible='true' showing='true' editable='true' screencoord='(5, 50)' size='(40, 20)'>say \"hi\"</text></frame></application></desktop>"),
    (2, "<desktop/>"),
    (3, "not xml"),
]


@register("tree_flatten")
def tree_flatten(spark, sf_dir):
    nodes = trees.flatten(spark.createDataFrame(TREES, "id int, xml string"), "id", "xml")
    return nodes.where(trees.kept_node()).select("id", "at", "tag", "name", "text", "x", "y", "w", "h")


@register("tree_linear")
def tree_linear(spark, sf_dir):
    nodes = trees.flatten(spark.createDataFrame(TREES, "id int, xml string"), "id", "xml")
    lines = trees.linear(nodes.where(trees.placed()), "id")
    return lines.join(trees.active_applications(nodes, "id"), "id", "left").select("id", trees.trimmed("tree", 3).alias("tree"), F.array_join("apps", ",").alias("apps"))


def _boxes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("tree"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("l_returnflag").alias("norm"),
        (F.col("l_partkey") % 500).cast("int").alias("x"), (F.col("l_orderkey") % 400).cast("int").alias("y"), F.col("l_quantity").cast("int").alias("w"), (F.col("l_linenumber") * 8).cast("int").alias("h"),
    )


@register(
    "iou_pairs",
    """
with b as (select l_suppkey as tree, l_orderkey * 10 + l_linenumber as at, l_returnflag as norm, l_partkey % 500 as x, l_orderkey % 400 as y, cast(l_quantity as integer) as w, l_linenumber * 8 as h from lineitem),
p as (select a.tree, a.at as first, b.at as second, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) as inter, a.w * a.h + b.w * b.h as areas
  from b a join b b on a.tree = b.tree and a.norm = b.norm and a.at < b.at)
select tree, first, second, max(round(inter / (areas - inter), 6)) as iou from p where inter / (areas - inter) > 0.2 group by tree, first, second
""",
)
def iou_pairs(spark, sf_dir):
    return trees.overlapping_pairs(_boxes(spark, sf_dir), "tree", "at", "norm").withColumn("iou", F.round("iou", 6))


@register("iou_dedup")
def iou_dedup(spark, sf_dir):
    return trees.drop_overlaps(_boxes(spark, sf_dir), "tree", "at", "norm").select("tree", "at")


EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("e", "d")]
EDGE_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in EDGES)


@register("topo_order")
def topo_order(spark, sf_dir):
    nodes = spark.createDataFrame([(n,) for n in "abcde"], "node string")
    whole = graphs.topological(nodes, spark.createDataFrame(EDGES, "src string, dst string"))
    cyclic = graphs.topological(nodes, spark.createDataFrame([*EDGES, ("d", "a")], "src string, dst string"), cycle="append")
    return whole.withColumn("graph", F.lit("whole")).unionByName(cyclic.withColumn("graph", F.lit("cyclic")))


@register(
    "graph_complement",
    "select a.r_name as src, b.r_name as dst from region a join region b on a.r_name <> b.r_name where not (a.r_regionkey = 0 and b.r_regionkey = 1)",
)
def graph_complement(spark, sf_dir):
    regions = table(spark, sf_dir, "region")
    pair = regions.where("r_regionkey = 0").select(F.col("r_name").alias("src"), F.lit(1).alias("k")).join(regions.where("r_regionkey = 1").select(F.col("r_name").alias("dst"), F.lit(1).alias("k")), "k").select("src", "dst")
    return graphs.complement(regions.select(F.col("r_name").alias("node")), pair)


@register("graph_degree", f"select dst as node, cast(count(*) as bigint) as n from (values {EDGE_ROWS}) e(src, dst) group by dst")
def graph_degree(spark, sf_dir):
    return graphs.in_degrees(spark.createDataFrame(EDGES, "src string, dst string"))


@register("graph_undeclared", "select node, side from (values ('e', 'edges'), ('z', 'declared')) v(node, side)")
def graph_undeclared(spark, sf_dir):
    return graphs.mentioned_or_declared(spark.createDataFrame(EDGES, "src string, dst string"), spark.createDataFrame([(n,) for n in "abcdz"], "node string"))
