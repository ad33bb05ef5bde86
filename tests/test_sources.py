import io
import json
import sqlite3
import zipfile

from stepweave.sources import files, jsonl, trajectories


def test_line_numbers_count_good_lines_alone(spark, tmp_path):
    (tmp_path / "b1").mkdir()
    (tmp_path / "b1/trajectory.jsonl").write_text('{"action":"a"}\nnot json\n{"action":"b"}\n\n{"action":"DONE","terminal":true}\n')
    (tmp_path / "b1/metadata.json").write_text(json.dumps({"original_task_id": "t", "branch_after_step": 1, "num_replay_steps": 2, "new_task_description": "N", "generated_task_description_from_vllm": ""}))
    (tmp_path / "b2").mkdir()
    (tmp_path / "b2/metadata.json").write_text("{}")
    steps = trajectories.branch_steps(spark, str(tmp_path))
    assert [(r.line_no, r.action) for r in steps.orderBy("line_no").collect()] == [(1, "a"), (2, "b"), (3, "DONE")]
    meta = trajectories.branches(spark, str(tmp_path))
    assert [r.branch_id for r in meta.collect()] == ["b1"]
    made = trajectories.training_examples(meta, steps).where("training_type = 'type1'").orderBy("line_no").collect()
    assert [r.is_replay for r in made] == [True, True, False]
    assert {r.task_description for r in made} == {"N"}
    assert made[-1].action_proposal == "Finish the task." and made[-1].action_dict == '{"terminal":true,"status":"done"}'
    assert [(r.task_id, r.existing) for r in trajectories.existing_outputs(meta).collect()] == [("t", 1)]


def test_lists_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x":1},{"x":2}]')
    (tmp_path / "b.jsonl").write_text('{"x":3}\n')
    assert jsonl.sniffed(spark, str(tmp_path / "a.json"), "x int").count() == 2
    assert jsonl.sniffed(spark, str(tmp_path / "b.jsonl"), "x int").first().x == 3
    for name, text in {"l": '["a","b"]', "k": '{"processed_ids":["a"]}', "o": '{"x":"a","y":"b"}'}.items():
        (tmp_path / name).write_text(text)
    assert [jsonl.ids(spark, str(tmp_path / n)).count() for n in "lko"] == [2, 1, 2]


def test_results_tree(spark, tmp_path):
    for domain, example, score in (("chrome", "e1", "1.0"), ("gimp", "e2", "True"), ("gimp", "e3", "?")):
        folder = tmp_path / "pyautogui/screenshot/m" / domain / example
        folder.mkdir(parents=True)
        (folder / "result.txt").write_text(score)
    rows = {r.example_id: (r.domain, r.score, r.model) for r in trajectories.results(spark, str(tmp_path)).collect()}
    assert rows == {"e1": ("chrome", 1.0, "m"), "e2": ("gimp", 1.0, "m"), "e3": ("gimp", None, "m")}


def test_rewrite_only_what_changed(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = spark.createDataFrame([(1, False), (2, False)], "x int, changed boolean")
    assert jsonl.rewrite(spark, rows, path, "changed") is False
    assert jsonl.rewrite(spark, rows.selectExpr("x", "x = 1 as changed"), path, "changed") is True
    assert sorted(r.x for r in spark.read.json(path).collect()) == [1, 2]


def test_encodings():
    assert files.decode("é".encode("latin-1")) == "é"
    assert files.decode(None) is None


def test_workbook_cells(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>he</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>2.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(buffer.getvalue())
    cells = files.workbooks(spark, str(tmp_path / "a.xlsx")).orderBy("col").collect()
    assert [(c.sheet, c.row, c.col, c.value) for c in cells] == [("S", 0, 0, "he"), ("S", 0, 27, "2.5")]
    assert files.sheet_by_address(files.workbooks(spark, str(tmp_path / "a.xlsx")), "RNS", ["S"]).count() == 2


def test_properties_of_workbooks(spark, tmp_path):
    from stepweave.operators import metrics
    from stepweave.sources import workbooks

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    link = lambda *rows: "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="x/{t}" Target="{p}"/>' for i, t, p in rows) + "</Relationships>"
    parts = {
        "xl/workbook.xml": f'<workbook {main}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": link(("r1", "worksheet", "worksheets/sheet1.xml")),
        "xl/styles.xml": f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="0.00%"/></numFmts><fonts><font><name val="Serif"/><b/><color rgb="FFFF0000"/></font></fonts><fills><fill><patternFill patternType="solid"><fgColor rgb="FF00FF00"/></patternFill></fill></fills><cellXfs><xf numFmtId="164" fontId="0" fillId="0"><alignment horizontal="center"/></xf></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {main}><sheetViews><sheetView zoomScale="260"><pane topLeftCell="B2" state="frozen"/></sheetView></sheetViews><cols><col min="2" max="3" width="12.5"/></cols><sheetData><row r="1" ht="20" hidden="1"><c r="A1" s="0"><v>1</v></c></row></sheetData><autoFilter ref="A1:B9"><filterColumn colId="1"><filters><filter val="y"/><filter val="x"/></filters></filterColumn></autoFilter><conditionalFormatting sqref="A1:A9"><cfRule type="cellIs" operator="lessThan"><formula>60</formula></cfRule></conditionalFormatting><dataValidations><dataValidation type="list" sqref="D2"><formula1>"a,b"</formula1></dataValidation></dataValidations><extLst><sparkline><f>S!C3:E3</f><sqref>F3</sqref></sparkline></extLst></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": link(("d", "drawing", "../drawings/drawing1.xml"), ("p", "pivotTable", "../pivotTables/p1.xml")),
        "xl/drawings/drawing1.xml": "<d/>",
        "xl/drawings/_rels/drawing1.xml.rels": link(("c", "chart", "../charts/chart1.xml")),
        "xl/charts/chart1.xml": "<chartSpace><chart><title><t>Sales</t></title><plotArea><barChart><barDir val='col'/><ser><val><f>S!$B$2:$B$9</f></val></ser></barChart><catAx><title><t>Year</t></title></catAx><valAx/></plotArea><legend><legendPos val='r'/></legend></chart></chartSpace>",
        "xl/pivotTables/p1.xml": "<pivotTableDefinition name='P'><location ref='H1:J9'/><rowFields><field x='0'/></rowFields><colFields><field x='-2'/></colFields><dataFields><dataField fld='1' subtotal='count'/></dataFields></pivotTableDefinition>",
        "xl/pivotTables/_rels/p1.xml.rels": link(("k", "pivotCacheDefinition", "../pivotCache/c1.xml")),
        "xl/pivotCache/c1.xml": "<pivotCacheDefinition><cacheSource><worksheetSource ref='A1:B9' sheet='S'/></cacheSource><cacheFields><cacheField name='Name'/><cacheField name='Sum'/></cacheFields></pivotCacheDefinition>",
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    (tmp_path / "b.xlsx").write_bytes(buffer.getvalue())
    rows = workbooks.properties(spark, str(tmp_path / "b.xlsx"))
    got = {(r.part, r["at"], r.key): r.value for r in rows.collect()}
    want = {
        ("view", "", "zoom"): "260", ("view", "", "freeze"): "B2", ("column", "2", "width"): "12.5", ("column", "3", "width"): "12.5", ("row", "1", "height"): "20", ("row", "1", "hidden"): "1",
        ("cell", "A1", "number_format"): "0.00%", ("cell", "A1", "font_name"): "Serif", ("cell", "A1", "font_color"): "FFFF0000", ("cell", "A1", "font_bold"): "true", ("cell", "A1", "font_italic"): "false", ("cell", "A1", "fill_type"): "solid", ("cell", "A1", "fill_color"): "FF00FF00", ("cell", "A1", "h_align"): "center",
        ("filter", "A1:B9", "ref"): "A1:B9", ("filter", "A1:B9", "column 1"): "x,y", ("validation", "D2", "type"): "list", ("validation", "D2", "formula1"): '"a,b"', ("conditional", "A1:A9", "cellIs lessThan"): "60", ("sparkline", "F3", "source"): "S!C3:E3",
        ("chart", "S!$B$2:$B$9", "type"): "barChart", ("chart", "S!$B$2:$B$9", "direction"): "col", ("chart", "S!$B$2:$B$9", "title"): "Sales", ("chart", "S!$B$2:$B$9", "xtitle"): "Year", ("chart", "S!$B$2:$B$9", "legend"): "r",
        ("pivot", "H1:J9", "name"): "P", ("pivot", "H1:J9", "source"): "S!A1:B9", ("pivot", "H1:J9", "filter"): "", ("pivot", "H1:J9", "row"): "Name", ("pivot", "H1:J9", "column"): "-2", ("pivot", "H1:J9", "value"): "count:Sum",
    }
    assert got == want and workbooks.workbook_properties(b"no zip") == []
    rule = {"type": "style", "table": "p", "prop": "value", "method": "eq", "ref": "260"}
    assert metrics.compare_table({"p": rows}, {"p": rows}, [{"type": "chart", "table": "p"}, rule]).first().score == 1


def test_sqlite_both_ways(spark, tmp_path):
    path = str(tmp_path / "h.db")
    visits = spark.createDataFrame([("u", "a", 1), ("u", "b", 2), ("v", "c", 3)], "url string, title string, visited long")
    files.write_history(visits, path)
    rows = files.sqlite_query(spark, path, "select url, title, visit_count from urls").collect()
    assert {(r.url, r.title, r.visit_count) for r in rows} == {("u", "b", 2), ("v", "c", 1)}
    assert files.sqlite_query(spark, path, "select id, url from visits", key="id", parts=3).count() == 3
    with sqlite3.connect(path) as db:
        assert db.execute("select count(*) from visits join urls on urls.id = visits.url").fetchone()[0] == 3


def test_log_tables_take_their_columns(spark, tmp_path):
    files.append_log(spark.createDataFrame([(1, "f")], "source_id long, function_name string"), str(tmp_path), "function_calls")
    assert spark.read.parquet(str(tmp_path / "function_calls")).columns[:3] == ["source_id", "source_name", "function_name"]
