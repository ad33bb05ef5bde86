"""Column functions and readers over the test tables: a query with SQL for each."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from stepweave.functions import actions as A
from stepweave.functions import dates as D
from stepweave.functions import responses as P
from stepweave.functions import text as T
from stepweave.functions import urls as U
from stepweave.operators.checks import color_distance
from stepweave.plans.registry import register
from stepweave.session import table
from stepweave.sources import files, jsonl, trajectories
from stepweave.sources.places import work_dir


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part")


# texts


@register("text_squeezed", r"select doc_id, regexp_replace(lower(text), '[\t\n\x0B\f\r ]+', '', 'g') as squeezed from documents")
def text_squeezed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.squeezed("text").alias("squeezed"))


@register("text_code_blocks", "select event_id, 'x = ' || cast(event_id as varchar) as first, case when event_id % 2 = 1 then event_type end as second from events")
def text_code_blocks(spark, sf_dir):
    body = F.concat(F.lit("text\n```python\nx = "), F.col("event_id").cast("string"), F.lit("\n```\nmore"), F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("\n```\n"), "event_type", F.lit("\n```"))).otherwise(""))
    blocks = T.code_blocks(body)
    return _events(spark, sf_dir).select("event_id", F.get(blocks, 0).alias("first"), F.get(blocks, 1).alias("second"))


@register("text_answers", "select event_id, case when event_id % 3 = 0 then null else event_type end as answer from events")
def text_answers(spark, sf_dir):
    line = F.when(F.col("event_id") % 3 == 0, F.lit("no answer")).otherwise(F.concat(F.lit("1 + 1 = 2 =  "), "event_type", F.lit(" ")))
    return _events(spark, sf_dir).select("event_id", T.answer_after_equals(line).alias("answer"))


@register("text_globs", "select p_partkey from part where p_name like 'cold%' or p_name like '_ed %' or regexp_matches(p_name, '^[a-c].* widget$')")
def text_globs(spark, sf_dir):
    return _part(spark, sf_dir).where(T.glob_match("p_name", ["cold*", "?ed *", "[a-c]* widget"])).select("p_partkey")


@register("text_preferences", "select event_id, case when event_id % 2 = 0 then event_type end as key, case when event_id % 2 = 0 then cast(event_id as varchar) end as value from events")
def text_preferences(spark, sf_dir):
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('user_pref("'), "event_type", F.lit('", '), F.col("event_id").cast("string"), F.lit(");"))).otherwise("// a comment")
    return _events(spark, sf_dir).select("event_id", T.preference(line).alias("p")).select("event_id", "p.key", "p.value")


@register("text_number_formats", "select p_partkey, case p_size % 4 when 0 then '0.00' when 1 then '0.00%' when 2 then '0.00E+00' else '@' end as form from part")
def text_number_formats(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Number", "percentage", "scientific", "text")]), F.col("p_size") % 4 + 1)
    return _part(spark, sf_dir).select("p_partkey", T.number_format(kind).alias("form"))


@register("text_data_urls", "select doc_id, 'data:image/png;base64,' || base64(encode(text)) as url from documents where text is not null")
def text_data_urls(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.data_url(F.encode("text", "UTF-8")).alias("url"))


# pages


@register("url_patterns", r"select page_id, regexp_matches(url, '^https?://') and regexp_matches(url, '\.org/') as met from pages")
def url_patterns(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.matches_all("url", [r"^https?://", r"\.org/"]).alias("met"))


@register("url_path_pairs", "select p_partkey, p_type as brand, cast(p_size as varchar) as size from part")
def url_path_pairs(spark, sf_dir):
    url = F.concat(F.lit("https://shop.org/x/Brand,Size/"), "p_type", F.lit(","), F.col("p_size").cast("string"), F.lit("?id=1"))
    pairs = U.path_pairs(url, 4, 5)
    return _part(spark, sf_dir).select("p_partkey", F.try_element_at(pairs, F.lit("Brand")).alias("brand"), F.try_element_at(pairs, F.lit("Size")).alias("size"))


@register("url_file_names", "select page_id, split_part(split_part(url, '://', 2), '/', 1) || '_' || list_last(string_split(url, '/')) || '_' as head from pages")
def url_file_names(spark, sf_dir):
    """Names of files without their hash, which SQL has no function for; tests hold the hash."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(U.file_name("url"), "[0-9a-f]{1,8}$", "").alias("head"))


# dates


@register("date_zones", "select event_id, case when event_id % 3 = 0 then 'Europe/Oslo' when event_id % 3 = 1 then 'Asia/Tokyo' else 'UTC' end as zone from events")
def date_zones(spark, sf_dir):
    first, second = F.when(F.col("event_id") % 3 == 0, "Europe/Oslo"), F.when(F.col("event_id") % 3 < 2, "Asia/Tokyo")
    return _events(spark, sf_dir).select("event_id", D.chosen_zone(first, second).alias("zone"))


@register("date_utc_lines", "select event_id, event_id % 2 = 0 as utc from events")
def date_utc_lines(spark, sf_dir):
    lines = F.concat(F.lit("a\nb\nc\nzone: X (X, "), F.when(F.col("event_id") % 2 == 0, "+0000)").otherwise("-0500)"), F.lit("\n"))
    return _events(spark, sf_dir).select("event_id", D.is_utc_line(lines).alias("utc"))


# numbers


@register("rgb_distance", "select l_orderkey, l_linenumber, round(sqrt((l_quantity - 255) ** 2 + (l_linenumber * 30) ** 2 + 100) / sqrt(3 * 255.0 ** 2), 9) as far from lineitem")
def rgb_distance(spark, sf_dir):
    far = color_distance(F.col("l_quantity"), F.col("l_linenumber") * 30, F.lit(10), (255, 0, 0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(far, 9).alias("far"))


@register(
    "series_alike",
    "select c_custkey, round(exp(-abs(c_acctbal - c_acctbal * 1.001) / 100 / 1), 9) as alike from customer",
)
def series_alike(spark, sf_dir):
    from stepweave.functions.similarity import series_similarity

    one, other = F.array(F.col("c_acctbal") / 100), F.array(F.col("c_acctbal") * 1.001 / 100)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(series_similarity(one, other), 9).alias("alike"))


@register("image_hash_bits", "select p_partkey, cast(bit_count(xor(p_partkey, 1023::bigint)) as integer) as bits from part")
def image_hash_bits(spark, sf_dir):
    from stepweave.functions.similarity import hash_distance

    return _part(spark, sf_dir).select("p_partkey", hash_distance("p_partkey", F.lit(1023).cast("long")).alias("bits"))


# actions and responses


@register("action_status", "select event_id, case when event_type = 'error' then 'success' when event_id % 2 = 0 then 'failure' else 'success' end as status from events")
def action_status(spark, sf_dir):
    said = F.when(F.col("event_type") == "error", "done").when(F.col("event_id") % 2 == 0, "FAIL").otherwise("success")
    return _events(spark, sf_dir).select("event_id", A.end_status(said).alias("status"))


@register("action_similar", "select p_partkey, p_size % 2 = 0 as alike from part")
def action_similar(spark, sf_dir):
    one = F.create_map(F.lit("action"), F.lit("click"), F.lit("x"), F.lit("1"), F.lit("reason"), "p_name")
    other = F.create_map(F.lit("action"), F.lit("click"), F.lit("x"), F.when(F.col("p_size") % 2 == 0, "1").otherwise("2"), F.lit("description"), "p_brand")
    return _part(spark, sf_dir).select("p_partkey", A.similar_actions(one, other).alias("alike"))


@register(
    "action_smart_size",
    "select p_partkey, cast(greatest(28, round_even((p_size * 10 + 200) / 28.0, 0) * 28) as integer) as height, cast(greatest(28, round_even((p_size * 20 + 100) / 28.0, 0) * 28) as integer) as width from part",
)
def action_smart_size(spark, sf_dir):
    size = A.smart_size(F.col("p_size") * 10 + 200, F.col("p_size") * 20 + 100)
    return _part(spark, sf_dir).select("p_partkey", size.alias("s")).select("p_partkey", "s.height", "s.width")


@register("response_tools", "select event_id, 'see ' || event_type as instruction, 'pyautogui.click(' || cast(event_id % 900 as varchar) || ', 7)' as code from events")
def response_tools(spark, sf_dir):
    call = F.concat(F.lit('{"name": "computer_use", "arguments": {"action": "left_click", "coordinate": ['), (F.col("event_id") % 900).cast("string"), F.lit(", 7]}}"))
    text = F.concat(F.lit("Action: see "), "event_type", F.lit("\n<tool_call>\n"), call, F.lit("\n</tool_call>"))
    return _events(spark, sf_dir).select("event_id", P.tool_response(text).alias("r")).select("event_id", "r.instruction", F.get("r.codes", 0).alias("code"))


@register("response_drags", "select event_id, 'go ' || event_type as instruction, 'pyautogui.moveTo(1, 2)|pyautogui.dragTo(' || cast(event_id % 900 as varchar) || ', 7, duration=0.5)' as codes from events")
def response_drags(spark, sf_dir):
    call = F.concat(F.lit('{"name": "computer_use", "arguments": {"action": "left_click_drag", "start_coordinate": [1, 2], "coordinate": ['), (F.col("event_id") % 900).cast("string"), F.lit(", 7]}}"))
    text = F.concat(F.lit("Reasoning: go "), "event_type", F.lit("\n<tool_call>\n"), call, F.lit("\n</tool_call>"))
    return _events(spark, sf_dir).select("event_id", P.tuned_response(text).alias("r")).select("event_id", "r.instruction", F.array_join("r.codes", "|").alias("codes"))


@register("response_thoughts", "select event_id, 'look at ' || event_type as thought, 'click' as action_type, '[0.5, 0.25, 0.5, 0.25]' as box from events")
def response_thoughts(spark, sf_dir):
    text = F.concat(F.lit("Thought: look at "), "event_type", F.lit("\nAction: click(start_box='(500,250)')"))
    found = _events(spark, sf_dir).select("event_id", F.explode(P.thought_actions(text)).alias("a"))
    return found.select("event_id", "a.thought", "a.action_type", F.try_element_at("a.action_inputs", F.lit("start_box")).alias("box"))


@register("response_candidates", "select event_id, event_type as reasoning, 'go' as action from events")
def response_candidates(spark, sf_dir):
    text = F.concat(F.lit('[{"reasoning": " '), "event_type", F.lit(' ", "action": "go"}, {"reasoning": "", "action": "x"}, {"reasoning": "y"}]'))
    return _events(spark, sf_dir).select("event_id", F.explode(P.candidates(text)).alias("c")).select("event_id", "c.reasoning", "c.action")


@register("response_proposals", "select event_id, t as task from events, unnest([event_type, 'plain']) u(t)")
def response_proposals(spark, sf_dir):
    text = F.concat(F.lit('{"tasks": [{"description": "'), "event_type", F.lit('"}, "plain", {}, " "]}'))
    return _events(spark, sf_dir).select("event_id", F.explode(P.proposals(text)).alias("task"))


@register("response_matches", "select event_id, event_id % 2 = 1 as matched from events")
def response_matches(spark, sf_dir):
    text = F.when(F.col("event_id") % 2 == 1, '{"match": true}').when(F.col("event_id") % 4 == 0, '{"match": false}').otherwise("none")
    return _events(spark, sf_dir).select("event_id", P.match_flag(text).alias("matched"))


@register("response_tags", "select event_id, 'tag_1=(' || cast(event_id % 100 + 5 as varchar) || ', 4)' || chr(10) || 'click(tag_1)' as code from events")
def response_tags(spark, sf_dir):
    box = F.array(F.struct((F.col("event_id") % 100).cast("int").alias("x"), F.lit(1).alias("y"), F.lit(10).alias("w"), F.lit(6).alias("h")))
    return _events(spark, sf_dir).select("event_id", F.get(P.with_tags(F.array(F.lit("click(tag_1)")), box), 0).alias("code"))


@register("response_less_than", """select event_id, 'pyautogui.typewrite(''' || event_type || '''); pyautogui.hotkey("shift", ","); pyautogui.typewrite(''b'')' as code from events""")
def response_less_than(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", P.without_less_than(F.concat(F.lit("pyautogui.typewrite('"), "event_type", F.lit("<b')"))).alias("code"))


@register("response_code_actions", "select event_id, 'x = ' || event_type || '|DONE' as codes from events")
def response_code_actions(spark, sf_dir):
    text = F.concat(F.lit("```python\nx = "), "event_type", F.lit("\nDONE\n```"))
    return _events(spark, sf_dir).select("event_id", F.array_join(P.code_actions(text), "|").alias("codes"))


@register("response_json_actions", "select event_id, '{\"k\": ' || cast(event_id as varchar) || '}' as action from events")
def response_json_actions(spark, sf_dir):
    text = F.concat(F.lit('```json\n{"k":'), F.col("event_id").cast("string"), F.lit("}\n```"))
    return _events(spark, sf_dir).select("event_id", F.explode(P.json_actions(text)).alias("action"))


# readers and sinks: what is written comes back


@register("source_lenient_lines", "select event_id, event_type from events where event_id % 5 <> 0")
def source_lenient_lines(spark, sf_dir):
    path = work_dir(spark, "lenient")
    line = F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", "event_type")))
    _events(spark, sf_dir).select(line.alias("value")).write.text(path)
    return jsonl.lenient(spark, path, "event_id long, event_type string")


@register("source_numbered_lines", "select r_regionkey, r_name, cast(row_number() over (order by r_regionkey) as bigint) as line_no from region where r_regionkey <> 2")
def source_numbered_lines(spark, sf_dir):
    path = work_dir(spark, "numbered-lines")
    line = F.when(F.col("r_regionkey") == 2, F.lit("no json {")).otherwise(F.to_json(F.struct("r_regionkey", "r_name")))
    table(spark, sf_dir, "region").orderBy("r_regionkey").coalesce(1).select(line.alias("value")).write.text(path)
    return jsonl.numbered(spark, path, "r_regionkey int, r_name string").select("row.r_regionkey", "row.r_name", "line_no")


@register("source_sniffed", "select r_regionkey, r_name, kind from region, (values ('list'), ('lines')) k(kind)")
def source_sniffed(spark, sf_dir):
    regions, path = table(spark, sf_dir, "region"), work_dir(spark, "sniffed")
    regions.write.json(f"{path}/lines")
    regions.agg(F.to_json(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("value")).coalesce(1).write.text(f"{path}/list")
    read = lambda kind: jsonl.sniffed(spark, f"{path}/{kind}", "r_regionkey int, r_name string").withColumn("kind", F.lit(kind))
    return read("list").unionByName(read("lines"))


@register("source_presence", "select event_id, event_id % 2 = 0 as has_a, event_id % 3 = 0 as has_b from events")
def source_presence(spark, sf_dir):
    fields = F.concat_ws(", ", F.when(F.col("event_id") % 2 == 0, '"a": null'), F.when(F.col("event_id") % 3 == 0, '"b": 1'), F.lit('"c": 2'))
    rows = _events(spark, sf_dir).select("event_id", F.concat(F.lit("{"), fields, F.lit("}")).alias("raw"))
    return jsonl.with_presence(rows, "raw", ["a", "b"]).select("event_id", "has_a", "has_b")


@register("source_processed_ids", "select distinct 'id' || cast(r_regionkey as varchar) as id from region")
def source_processed_ids(spark, sf_dir):
    path, keys = work_dir(spark, "processed"), table(spark, sf_dir, "region").agg(F.collect_list(F.concat(F.lit("id"), F.col("r_regionkey").cast("string"))).alias("ids"))
    shapes = keys.select(F.explode(F.array(F.to_json("ids"), F.to_json(F.struct(F.col("ids").alias("processed_ids"))))).alias("value"))
    shapes.repartition(2, "value").write.text(path)
    return jsonl.ids(spark, path)


@register("source_rewritten", "select r_regionkey, case when r_regionkey = 1 then 'new' else r_name end as r_name from region")
def source_rewritten(spark, sf_dir):
    path = f"{work_dir(spark, 'rewritten')}/rows"
    regions = table(spark, sf_dir, "region")
    regions.write.json(path)
    changed = regions.select("r_regionkey", F.when(F.col("r_regionkey") == 1, "new").otherwise(F.col("r_name")).alias("r_name"), (F.col("r_regionkey") == 1).alias("changed"))
    jsonl.rewrite(spark, changed, path, "changed")
    return jsonl.strict(spark, path, "r_regionkey int, r_name string")


@register("source_csv", "select cast(n_nationkey as varchar) as n_nationkey, n_name, cast(n_regionkey as varchar) as n_regionkey from nation")
def source_csv(spark, sf_dir):
    path = work_dir(spark, "csv")
    table(spark, sf_dir, "nation").write.option("header", True).csv(path)
    return files.csv_records(spark, path)


@register("source_text_files", "select 'NATION_0' as name, cast(count(*) as bigint) as n from nation where n_nationkey = 0")
def source_text_files(spark, sf_dir):
    path = work_dir(spark, "texts")
    table(spark, sf_dir, "nation").where("n_nationkey = 0").select(F.col("n_name").alias("value")).coalesce(1).write.text(path)
    return files.text_files(spark, path, ["txt"]).groupBy(F.trim(F.regexp_replace("text", r"\n", "")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@register("source_run_log", "select cast(event_id as bigint) as source_id, event_type as event_name from events")
def source_run_log(spark, sf_dir):
    path = work_dir(spark, "log")
    files.append_log(_events(spark, sf_dir).select(F.col("event_type").alias("event_name"), F.col("event_id").alias("source_id")), path, "events")
    return spark.read.parquet(f"{path}/events").select("source_id", "event_name")


@register("source_history", "select url, cast(count(*) as bigint) as visit_count, max(page_id) as last_visit_time from pages group by url")
def source_history(spark, sf_dir):
    urls, _ = files.history_rows(table(spark, sf_dir, "pages").select("url", F.lit("t").alias("title"), F.col("page_id").alias("visited")))
    return urls.select("url", "visit_count", "last_visit_time")


@register("source_seen_store", "select min(doc_id) as at, source as description from documents group by source")
def source_seen_store(spark, sf_dir):
    """Saved and read again; places are those of first occurrence, so they come back by rank."""
    path = work_dir(spark, "seen")
    store = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("at"), F.col("source").alias("description"))
    trajectories.save_seen(store, path)
    back = trajectories.seen_store(spark, path).select("description")
    return back.join(store, "description").groupBy("description").agg(F.min("at").alias("at")).select("at", "description")


@register("source_results", "select 's' as model, 'd' || cast(p_size % 3 as varchar) as domain, cast(p_partkey as varchar) as example_id, case when p_size % 2 = 0 then 1.0 else 0.5 end::double as score from part where p_partkey < 6")
def source_results(spark, sf_dir):
    path = work_dir(spark, "results")
    rows = _part(spark, sf_dir).where("p_partkey < 6").select(F.concat(F.lit("d"), (F.col("p_size") % 3).cast("string")).alias("domain"), F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_size") % 2 == 0, "True").otherwise("0.5").alias("value")).collect()
    jvm = spark.sparkContext._jvm
    for r in rows:  # six files
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/a/o/s/{r.domain}/{r.id}/result.txt")
        out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
        out.write(bytearray(r.value.encode()))
        out.close()
    return trajectories.results(spark, path).select("model", "domain", "example_id", "score")


@register("source_existing_outputs", "select user_id as task_id, event_type as after_step, cast(count(*) as bigint) as existing from events where event_id % 7 <> 0 group by user_id, event_type")
def source_existing_outputs(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("original_task_id"), F.col("event_type").alias("branch_after_step"))
    return trajectories.existing_outputs(rows)


@register("source_latest_steps", "select user_id, cast(count(*) as bigint) as n_steps, max(event_id) as last_event from events group by user_id")
def source_latest_steps(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", F.col("event_id").alias("step_num"), (F.col("event_type") == "error").alias("done"), F.lit(None).cast("string").alias("Error"), F.col("event_id").alias("action_timestamp"))
    return trajectories.latest_steps(rows, ["user_id"]).select("user_id", "n_steps", F.col("action_timestamp").alias("last_event"))


@register("source_task_configs", "select 'os' as domain, 'id' || cast(r_regionkey as varchar) as id, r_name as instruction from region")
def source_task_configs(spark, sf_dir):
    path = work_dir(spark, "tasks")
    jvm = spark.sparkContext._jvm
    for r in table(spark, sf_dir, "region").collect():  # five files
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/os/id{r.r_regionkey}.json")
        out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
        out.write(bytearray(json.dumps({"id": f"id{r.r_regionkey}", "instruction": r.r_name}).encode()))
        out.close()
    return trajectories.tasks(spark, path).select("domain", "id", "instruction")


@register("topo_layers", "select node, cast(layer as integer) as layer, graph from (values ('a', 0, 'whole'), ('e', 0, 'whole'), ('b', 1, 'whole'), ('c', 1, 'whole'), ('d', 2, 'whole'), ('e', 0, 'cyclic'), ('a', 1, 'cyclic'), ('b', 1, 'cyclic'), ('c', 1, 'cyclic'), ('d', 1, 'cyclic')) v(node, layer, graph)")
def topo_layers(spark, sf_dir):
    from stepweave.plans.misc import topo_order

    return topo_order(spark, sf_dir).select("node", "layer", "graph")


@register("nation_layers", "select n_name as node, 1 as layer from nation union all select r_name, 0 from region")
def nation_layers(spark, sf_dir):
    """Regions come before their nations."""
    from stepweave.operators import graphs

    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    edges = nations.join(regions, nations.n_regionkey == regions.r_regionkey).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    nodes = regions.select(F.col("r_name").alias("node")).union(nations.select("n_name"))
    return graphs.topological(nodes, edges).select("node", "layer")
