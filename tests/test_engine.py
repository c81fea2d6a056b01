"""Case tables of the engine: text kernels, repair, placement, sources, sinks, stream."""

import json

import pytest
from pyspark.sql import functions as F

from figmill.functions import exprs, kernels, text
from figmill.operators import audit, corpus, flatten, layout, place, repair
from figmill.schema import KEYED_RECORD, RECORD, json_schema
from figmill.sources import records as sources
from figmill.streaming import ingest


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("said", "refs"),
    [
        ("see Fig. 1 and Fig 2", ["figure1", "figure2"]),
        ("Figs. 1 and 2", ["figure1", "figure2"]),
        ("Figures 1-3", ["figure1", "figure2", "figure3"]),
        ("Fig. 1, 2 h after", ["figure1"]),
        ("Fig. 1A", ["figure1A"]),
        ("Figure 1(a-c)", ["figure1ABC"]),
        ("Fig. 1 d later", ["figure1"]),
        ("Table IV and Table 2", ["table4", "table2"]),
        ("Supplementary Fig. S1", ["figureS1"]),
        ("图 1、2 与表 3", ["figure1", "figure2", "table3"]),
        ("列表 3 个", []),
        ("Fig. 1 and Table 2", ["figure1", "table2"]),
        ("the figure shows 3% of it", []),
        ("FIGURE 4 and Tab. 3", ["figure4", "table3"]),
        ("drawn as Figure~7", ["figure7"]),
        ("Fig. 5 (b-d), then", ["figure5BCD"]),
        ("Fig. 5a,b", ["figure5A"]),
        ("Figure 2, 3 and 4", ["figure2", "figure3", "figure4"]),
        ("Fig. 3 and 5 μM of it", ["figure3"]),
        ("Fig. 1 3 d", ["figure1"]),
        ("Fig. 6d", ["figure6D"]),
        ("Supplementary Table S2 as well as Fig. 9", ["tableS2", "figure9"]),
        ("we configure the table with 3 columns", []),
        ("如图3 与表 2。", ["figure3", "table2"]),
        ("Figs. 1-40", ["figure1", "figure40"]),
        ("", []),
    ],
)
def test_references(said, refs):
    assert [r["kind"] + r["number"] + "".join(r["panels"]) for r in kernels.references(said)] == refs


def test_panels():
    got = kernels.split_panels("Fig. 2. Effect. (A) Growth of the cells (B) Measure the size of it. Data are expressed as mean ± SD, n = 3.")
    assert [(p["label"], p["text"]) for p in got["panels"]] == [("A", "Growth of the cells"), ("B", "Measure the size of it.")]
    assert got["preamble"] == "Effect" and got["trailer"].startswith("Data are expressed")
    texts = lambda s: {p["label"]: p["text"] for p in kernels.split_panels(s)["panels"]}
    assert texts("Figure 4: Two views. View (a) holds the first group, imply- ing much, whereas panel (b) holds another group.") == {"A": "(a) holds the first group, implying much", "B": "panel (b) holds another group."}
    assert texts("Fig. 2: Areas in boxes. (a) shows the results of one; (b) shows the results of all.") == {"A": "(a) shows the results of one", "B": "(b) shows the results of all."}
    assert texts("Fig. 2. x. (A) The first of them all. (C) The third of them all.") == {} and texts("Fig. 8 Sum. (A) 30%. (B) 40%.") == {}
    assert sorted(texts("Fig. 4 Survival. A. Curve of the vehicle group. B. Curve of the treated group.")) == ["A", "B"]
    assert sorted(texts("Fig. 5 Growth. A) Volume over all the time. B) Final weight of them.")) == ["A", "B"]
    assert texts("图 1 细胞增殖。(A) 检测细胞活力。(B) 克隆形成实验。") == {"A": "检测细胞活力。", "B": "克隆形成实验。"}
    late = kernels.split_panels("Fig. 4. One. (A) Images of the stain (cell nuclei) Scale bar. (B) Signal in (A) and others.* indicates p < 0.05. N = 3.")
    assert late["trailer"].startswith("* indicates") and [p["label"] for p in late["panels"]] == ["A", "B"]
    assert kernels.split_panels("Figure 3. Intensity from (B) and others.")["panels"] == []
    assert kernels.split_panels(None)["panels"] == []
    assert kernels.figure_title("Figure 1. Growth of E. coli at 0.5 mM. Then") == "Growth of E. coli at 0.5 mM"


def test_missing_values(spark):
    texts = [None, "", "  ", "not_reported", "Not_Reported（reason）", "N/A", "-", "—", "未说明", "none", "0", "False", " 3 "]
    assert column(spark, texts, exprs.is_reported) == [False] * 10 + [True] * 3
    assert column(spark, ["not_reported（why）", "not_reported", "x"], exprs.clean_sentinel) == ["未说明（why）", "未说明", "x"]
    assert column(spark, [" a b c\n"], exprs.norm_ws) == ["a b c"]


def test_labels(spark):
    assert column(spark, ["01", "S 2", "IV", "12", "x-1"], exprs.norm_number) == ["1", "S2", "4", "12", "X-1"]
    assert column(spark, ["imply- ing a", "Protein- protein", "a - b"], text.dehyphenate) == ["implying a", "Protein-protein", "a - b"]
    assert column(spark, ["5,1-3,2", "", "9-7"], text.page_numbers) == [[1, 2, 3, 5], [], []]


def record(**changes):
    base = {"schema_version": "1.0", "domain": "bio", "figure_id": "Figure 1", "figure_kind": "experiment", "confidence": "high", "caption": "Figure 1. n = 3.", "panels": [{"label": "A", "groups": [{"name": "g", "role": "control", "n": "3"}], "stats": {"test": "t-test"}, "evidence": {"from_caption": ["groups[].n"]}}]}
    return json.dumps({**base, **changes})


def test_repair(spark):
    raw = [record(), "not json", record(figure_id=" "), record(confidence="sure"), record(panels=["junk", {"label": "A", "groups": {"a": 1}}]), record(pages=[1, "x", 2]), json.dumps([1]), "null", ""]
    df = spark.createDataFrame([("p", i, r) for i, r in enumerate(raw)], "paper_id string, ord long, json string")
    rows = {r["ord"]: r for r in repair.repair(df).collect()}
    assert [rows[i]["record"] is not None for i in range(9)] == [True, False, False, True, True, True, False, False, False]
    assert rows[3]["record"]["confidence"] == "low" and rows[3]["warnings"]
    assert len(rows[4]["record"]["panels"]) == 1 and rows[5]["record"]["pages"] == [1, 2]
    assert rows[0]["record"]["panels"][0]["groups"][0]["readout"] == "not_reported" and rows[0]["warnings"] == []


def test_audit_twins(spark):
    cases = [record(), record(panels=[{"label": "A", "groups": [{"name": "g", "role": "control", "n": "3"}], "evidence": {"from_body": ["groups[].name"]}}]), record(figure_kind="schematic"), record(panels=[])]
    df = spark.createDataFrame([("p", i, r) for i, r in enumerate(cases)], "paper_id string, ord long, json string")
    recs = repair.repair(df).select("paper_id", "ord", "record.*")
    found = {}
    for r in audit.audit(recs).collect():
        found.setdefault(r["ord"], set()).add(r["rule"])
    assert found[0] == {"test_without_source"}
    assert found[1] == {"n_without_source", "gap_without_question"}
    assert found[2] == {"schematic_with_panels", "test_without_source"} and found[3] == {"no_panels"}


def page(pno, **more):
    base = {"paper_id": "p", "pno": pno, "width": 600.0, "height": 800.0, "content_x0": 50.0, "content_x1": 550.0, "content_top": 40.0, "content_bottom": 760.0, "route": "latex_vector", "is_figure_page": False, "has_graphics": False}
    return {**base, **more}


def test_placement(spark):
    pages = [page(0, route="journal_raster", has_graphics=True), page(1), page(2, is_figure_page=True, has_graphics=True), page(3, has_graphics=True), page(4)]
    schema = "paper_id string, pno int, width double, height double, content_x0 double, content_x1 double, content_top double, content_bottom double, route string, is_figure_page boolean, has_graphics boolean"
    p = spark.createDataFrame([tuple(x.values()) for x in pages], schema)
    rect = "paper_id string, pno int, x0 double, y0 double, x1 double, y1 double"
    images = spark.createDataFrame([("p", 0, 60.0, 60.0, 540.0, 400.0)], rect)
    drawings = spark.createDataFrame([("p", 2, 60.0, 100.0, 500.0, 700.0)], rect)
    kind = "paper_id string, pno int, anchor_id long, kind string, series string, number string, x0 double, y0 double, x1 double, y1 double, col_x0 double, col_x1 double, ceiling double, g_x0 double, g_y0 double, g_x1 double, g_y1 double, coverage double"
    a = lambda n, pno, y, g=None: ("p", pno, n, "figure", "", str(n), 60.0, y, 300.0, y + 10, 50.0, 550.0, 40.0, *(g or (None,) * 4), 1.0 if g else None)
    anchors = spark.createDataFrame([a(1, 0, 420.0), a(2, 1, 300.0), a(3, 3, 500.0, (60.0, 100.0, 500.0, 450.0)), a(4, 3, 700.0), a(5, 4, 400.0)], kind)
    got = {r["anchor_id"]: (r["pno"], r["route"], r["trust"]) for r in place.place(anchors, p, images, drawings).collect()}
    assert got[1] == (0, "journal_raster", "high")
    assert got[2] == (2, "latex_vector", "medium")
    assert got[3] == (3, "latex_vector", "high")
    assert got[4] == (3, "fallback_band", "medium") or got[4][1] == "fallback_page"
    assert got[5] == (4, "fallback_page", "low")


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "papers" / "one" / "extracted"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(record())
    (folder / "b.json").write_text(json.dumps({"figures": [json.loads(record(figure_id="Figure 2"))]}))
    (folder / "c.json").write_text("{broken")
    recs, warned = sources.read_records(spark, f"{tmp_path}/papers")
    assert sorted(r["figure_id"] for r in recs.collect()) == ["Figure 1", "Figure 2"]
    assert warned.filter(F.col("warning").contains("致命")).count() == 1
    table = flatten.long_table(recs)
    assert table.count() == 2
    assert sources.write_csv(table, f"{tmp_path}/t.csv") == 2
    assert (tmp_path / "t.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    sources.write_xlsx({"a": (["h"], [("=1+1",), ("宽" * 30,)])}, f"{tmp_path}/t.xlsx")
    import zipfile

    sheet = zipfile.ZipFile(tmp_path / "t.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert 'width="42"' in sheet and "<f>" not in sheet and "=1+1" in sheet
    assert "</script>" not in sources.page_html("<script>__DATA__", {"x": "</script>"})
    assert json_schema()["required"] == ["figure_id"]
    with pytest.raises(ValueError):
        flatten.corpus_table({})


def test_stream_agrees_with_batch(spark, tmp_path):
    folder = tmp_path / "in" / "paper"
    folder.mkdir(parents=True)
    for i in range(3):
        (folder / f"{i}.json").write_text(record(figure_id=f"Figure {i}"))
    for _ in range(2):
        ingest.run(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r["figure_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["Figure 0", "Figure 1", "Figure 2"]


def test_clusters_and_bounds(spark):
    rects = spark.createDataFrame([("p", 0, 0.0, y, 10.0, y + 10) for y in (0.0, 20.0, 100.0, 105.0)], "paper_id string, pno int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r["n"] for r in layout.clusters(rects, ["paper_id", "pno"]).collect()) == [2, 2]
    assert RECORD.count("panels") == 1


def test_flow_from_tables_to_documents(spark, tmp_path):
    from figmill import __main__ as cli
    from figmill.operators import context, recall, render, tasks

    assets = spark.createDataFrame([("p", "Figure 1", "figure", "1", "Figure 1. Sum. (A) Growth of HeLa cells. (B) Death of HeLa cells."), ("p", "Figure 2", "figure", "2", "Figure 2. Plain.")], "paper_id string, figure_id string, kind string, number string, caption string")
    paragraphs = spark.createDataFrame([("p", 1, "§1¶1", "§1", "See Fig. 1A and more."), ("p", 2, "§2¶1", "§2", "HeLa cells were grown."), ("p", 3, "§3¶1", "§3", "Tests were two-sided.")], "paper_id string, ord long, id string, section_id string, text string")
    sections = spark.createDataFrame([("p", "§1", "Results", False), ("p", "§2", "Methods", True), ("p", "§3", "Statistical analysis", True)], "paper_id string, id string, title string, is_methods boolean")
    packs = context.packs(assets, paragraphs, sections, recall.term_table(spark))
    got = {r["figure_id"]: r for r in packs.collect()}
    assert [c["id"] for c in got["Figure 1"]["citing"]] == ["§1¶1"] and got["Figure 2"]["citing"] == []
    assert [(m["id"], m["how"]) for m in got["Figure 1"]["methods"]] == [("§2¶1", "hit"), ("§3¶1", "pinned")]
    doc = {r["figure_id"]: r["doc"] for r in render.context_packs(packs).collect()}["Figure 1"]
    assert "## Panels\n- A: Growth of HeLa cells." in doc and "(hit " in doc
    made = tasks.build(packs, "light", "main,1").collect()
    assert [r["slug"] for r in made] == ["figure_01"] and "## 4. Cited in" in made[0]["doc"] and "Methods" not in made[0]["doc"] and '"label":"B"' in made[0]["doc"]
    for bad in ({"level": "none"}, {"figures": "77"}):
        with pytest.raises(ValueError):
            tasks.build(packs, **bad)

    folder = tmp_path / "papers" / "one" / "extracted"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(record(paper={"title": "T"}, confidence="medium"))
    (folder / "figure_02.json").write_text(record(figure_id="", paper={"title": "T"}))
    (folder / "z.json").write_text(json.dumps({"figures": [json.loads(record())]}))
    assert cli.main(["render", "--records", f"{tmp_path}/papers", "--out", f"{tmp_path}/out", "--outputs", "notes,mindmap,tables"]) == 0
    notes = spark.read.parquet(f"{tmp_path}/out/notes").first()["doc"]
    assert notes.startswith("# T") and "## Figure 2" in notes and "## 复核清单" in notes and "出现多次" in notes and "缺失" in notes and "bundle" in notes
    maps = spark.read.parquet(f"{tmp_path}/out/mindmap").first()
    assert maps["mermaid"].startswith("mindmap\n") and maps["opml"].count("<outline") == maps["opml"].count("</outline>") + 2
    assert spark.read.parquet(f"{tmp_path}/out/tables").count() == 2
    assert cli.main(["corpus", "--records", f"{tmp_path}/papers", "--out", f"{tmp_path}/csv"]) == 0
    assert next((tmp_path / "csv").glob("part-*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    assert cli.main(["render", "--records", f"{tmp_path}/none", "--out", f"{tmp_path}/x"]) == 2
    with pytest.raises(ValueError):
        cli.wanted_outputs("page,film")


def _random_sections(seed: int):
    import random

    r = random.Random(seed)
    titles = ["Methods", "Materials and Methods", "Cells", "Statistics", None]
    return [(r.choice(["a", "b", "c", None]), r.choice([None, *range(12)]), r.choice([1, 2, 3, 4, None]), r.choice(titles)) for _ in range(120)]


def test_methods_reach_to_the_next_section_of_their_level(spark):
    rows = _random_sections(3)
    got = layout.mark_methods(spark.createDataFrame(rows, "paper_id string, seq int, level int, title string")).select("paper_id", "seq", "level", "title", "is_methods").collect()
    strong = [(p, s, lv) for p, s, lv, t in rows if t in ("Methods", "Materials and Methods") and p is not None and s is not None]

    def under(p, s):
        if p is None or s is None:
            return False
        return any(q == p and at <= s and not any(p2 == p and s2 is not None and at < s2 <= s and l2 is not None and lv is not None and l2 <= lv for p2, s2, l2, _ in rows) for q, at, lv in strong)

    want = [(p, s, lv, t, under(p, s) or (None if t is None else t == "Statistics")) for p, s, lv, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_many_sections_are_marked_and_numbered_in_time(spark):
    n = 30_000
    heads = spark.range(n).selectExpr("'p' AS paper_id", "cast(id AS int) AS seq", "CASE WHEN id % 2 = 0 THEN 'Methods' ELSE 'Cells' END AS title", "cast(10 + id % 3 AS double) AS size", "cast(1 + id % 3 AS int) AS level")
    assert layout.mark_methods(heads).filter("is_methods").count() == sum(1 for i in range(n) if any(j % 2 == 0 and not any(k % 3 <= j % 3 for k in range(j + 1, i + 1)) for j in range(max(0, i - 3), i + 1)))
    last = layout.sections(heads).orderBy(F.desc("seq")).first()
    assert (last["id"], last["level"]) == ("§10001", 1)


def test_section_counters_follow_the_fold(spark):
    import random

    r = random.Random(5)
    rows = [(p, i, "Loose", float(r.choice([9, 10, 11, 12, 13, 8 if p == "b" else 14]))) for p in "abc" for i in range(60)]
    got = {(x["paper_id"], x["seq"]): x["id"] for x in layout.sections(spark.createDataFrame(rows, "paper_id string, seq int, title string, size double")).collect()}
    for p in "abc":
        own = [(i, s) for q, i, _, s in rows if q == p]
        sizes = [s for _, s in own]
        ranks = {s: k for k, s in enumerate(sorted({s for s in sizes if sizes.count(s) > 1}, reverse=True), 1)}
        state, seen = [], {}
        for i, s in own:
            to = min(ranks.get(s, 1), len(state) + 1)
            state = (state + [0])[:to]
            state[-1] += 1
            sid = "§" + ".".join(map(str, state))
            seen[sid] = seen.get(sid, 0) + 1
            assert got[p, i] == (sid if seen[sid] == 1 else f"{sid}#{seen[sid]}")


def test_a_single_large_line_is_no_section(spark):
    sizes = [30.0, 14.0, 12.0, 11.0, 12.0, 14.0, 12.0]
    rows = [("p", i, "Loose", s) for i, s in enumerate(sizes)] + [("q", 0, "Loose", 30.0), ("q", 1, "Loose", 14.0)]
    got = [tuple(r) for r in layout.sections(spark.createDataFrame(rows, "paper_id string, seq int, title string, size double")).select("paper_id", "seq", "id").orderBy("paper_id", "seq").collect()]
    assert got == [("p", 1, "§1"), ("p", 2, "§1.1"), ("p", 3, "§2"), ("p", 4, "§2.1"), ("p", 5, "§3"), ("p", 6, "§3.1"), ("q", 0, "§1"), ("q", 1, "§1.1")]


def test_a_label_of_many_digits_is_no_part_of_the_title():
    assert kernels.figure_title("Figure 12345. Rates of growth. Then") == "Rates of growth"
    assert kernels.figure_title("Figure " + "1" * 5000 + ". Rates") == "Rates"


def test_a_figure_map_leaves_nothing_out(spark):
    group = lambda name, role, result="up", condition="5 mM": {"name": name, "role": role, "condition": condition, "n": "3", "readout": "OD", "result": result, "vs_control": "N/A"}
    design = {"independent_var": "dose", "levels": ["low", "not_reported", "high"], "controlled": ["pH"], "unit": "well"}
    stats = {"test": "t-test", "error_bar": "-", "replicates": "3", "significance": None}
    panel = {"label": "A", "experiment": "Growth (24 h)", "design": design, "groups": [group("DMSO", "control"), group(None, "treatment"), group("-", "other", "not_reported"), group("N/A", "ablation", None, None)], "stats": stats, "finding": "grows", "evidence": {"inferred": ["groups[].n"]}}
    bare = {"label": "-", "experiment": None, "design": {**design, "independent_var": "not_reported"}, "groups": [], "stats": stats, "finding": None, "evidence": None}
    empty = {"label": "B", "experiment": None, "design": None, "groups": None, "stats": None, "finding": None, "evidence": None}
    base = {"paper_id": "p", "figure_kind": "experiment", "caption": "Figure 1. Rates of growth. Then", "question": "why", "figure_conclusion": "it grows", "confidence": "low", "open_questions": ["what " + "x" * 50, "n/a"]}
    rows = [{**base, "ord": 1, "figure_id": "Figure 1", "panels": [panel, bare, empty]}, {**base, "ord": 2, "figure_id": "Figure 2", "caption": None, "panels": [], "figure_kind": "schematic", "confidence": "high", "open_questions": []}, {**base, "ord": 3, "figure_id": None, "caption": None, "question": None, "panels": None, "figure_kind": None, "confidence": None, "open_questions": None, "figure_conclusion": None}]
    records = spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", KEYED_RECORD).alias("r")).select("r.*")
    got = {r["ord"]: r["doc"].split("\n") for r in corpus.figure_mermaid(records).collect()}
    assert got[1] == [
        "mindmap", "  ⚠ Figure 1 · Rates of growth", "    ❓ why", "    ⚠ Panel A · Growth （24 h）", "      🎚 自变量 dose", "        ○ DMSO · up", "        ● up", "        · 5 mM", "        ◆", "      ✅ grows",
        "    （无内容）", "      🎚 自变量", "        水平 low", "        水平 high", "    Panel B ·", "      🎚 自变量", "        （未记录具体分组）",
        "    ✅ it grows", "    ⚠ 待确认", "      推断 · Panel A · 含模型推断字段：groups［］.n", "      低置信 · 整图置信度自评为低", "      what " + "x" * 34 + "…",
    ]
    assert got[2] == ["mindmap", "  Figure 2 · why", "    📐 机制示意图（无实验分组）", "    ✅ it grows"]
    assert got[3] == ["mindmap", "  （无内容）", "    无分组实验数据"]
    deep = {r["ord"]: r["doc"].split("\n") for r in corpus.figure_mermaid(records, "result").collect()}[1]
    assert deep[5:11] == ["        ○ DMSO", "          条件 5 mM", "          样本量 3", "          指标 OD", "          → up", "        ●"]
    assert [x.strip() for x in deep[deep.index("        ◆") :][:10]] == ["◆", "样本量 3", "指标 OD", "设计水平 low、not_reported、high", "实验单位 well", "固定 pH", "统计检验 t-test", "重复 3", "✅ grows", "（无内容）"]
    assert {r["ord"]: r["doc"] for r in corpus.figure_mermaid(records, "panel").collect()}[1].count("\n") == 7
    with pytest.raises(ValueError):
        corpus.figure_mermaid(records, "figure")


def test_mermaid_lines_draws_groups_with_and_without_a_name(spark, sf_dir, tmp_path):
    import duckdb

    from figmill.plans import ORACLES, QUERIES

    duck = duckdb.connect()
    odd = "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' Not_reported (a)' WHEN 2 THEN chr(160) || 'a' || chr(9) || chr(133) || '(b)|' || p_name ELSE p_name || repeat(' long', 9) END"
    for t in ("region", "nation", "customer", "orders", "lineitem", "part"):
        duck.sql(f"COPY (SELECT * {f'REPLACE ({odd} AS p_name)' if t == 'part' else ''} FROM '{sf_dir}/{t}.parquet' {'WHERE l_orderkey % 7 <> 0' if t == 'lineitem' else ''}) TO '{tmp_path}/{t}.parquet'")
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = {r["ord"]: r["doc"] for r in QUERIES["mermaid_lines"](spark, str(tmp_path)).collect()}
    assert got == dict(duck.sql(f"SELECT ord, doc FROM ({ORACLES['mermaid_lines']})").fetchall())
    drawn = sum(x.startswith("        ") for doc in got.values() for x in doc.split("\n"))
    orders = "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey"
    assert drawn == duck.sql(f"SELECT count(*) FROM ({orders}) LEFT JOIN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey) ON l_orderkey = o_orderkey").fetchall()[0][0]
