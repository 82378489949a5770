"""Graphs of workbooks and libraries, and caches with odd rows."""


from paperloom.operators import requests, workbook

PAPERS = "id string, pdfName string, chineseTitle string, englishTitle string, journal string, authors string, year string, notes string, pos long"
LINKS = "row_id string, paper_id string, pos long"


def sheet(spark, rows):
    cells = [[r.get(x, "") for x in workbook.LABELS] for r in rows]
    return spark.createDataFrame([(0, 0, "header", list(workbook.LABELS)), *[(0, i + 1, f"row-{i + 1}", c) for i, c in enumerate(cells)]], "book long, pos long, row_id string, cells array<string>")


def test_graph_of_rows_links_and_papers(spark):
    rows = sheet(spark, [
        {"论文": "paper-a.pdf", "中文标题": "安全强化学习路径规划", "创新点": "PPO + CBF 安全约束", "方法": "PPO, CBF, MPC", "数据/任务": "移动机器人、路径规划", "指标/结果": "success rate, collision rate"},
        {"论文": "paper-b.pdf", "中文标题": "PINN 机器人导航", "方法": "PINN, MPC", "数据/任务": "路径规划"},
    ])
    papers = spark.createDataFrame([("paper-a", "paper-a.pdf", "", "", "ICRA", "Author A, Author B", "2026", "", 0)], PAPERS)
    found = workbook.entries(rows, spark.createDataFrame([("row-1", "paper-a", 0)], LINKS), papers)
    nodes, edges, stats = workbook.graph_of(found)
    labels = {(r.type, r.label) for r in nodes.collect()}
    assert {("paper", "安全强化学习路径规划"), ("method", "CBF"), ("method", "PINN"), ("scene", "路径规划"), ("metric", "collision rate"), ("author", "Author A")} <= labels
    got = edges.collect()
    assert any(e.label == "方法" for e in got)
    s = stats.collect()[0]
    assert s.papers == 2 and s.nodes == len(labels) and s.edges == len(got)
    # MPC is the one method of both papers, so it comes first, and no pair of methods shares a paper twice.
    assert s.top_methods.split("; ")[0] == "MPC" and not [e for e in got if e.label == "共现方法"]
    small, kept, cut = workbook.graph_of(found, 3)
    assert small.count() == 3 and {r.type for r in small.limit(3).collect()} >= {"paper"} and cut.collect()[0].nodes == 3
    ids = {r.node for r in small.collect()}
    assert all(e.source in ids and e.target in ids for e in kept.collect())


def test_graph_of_a_library(spark):
    papers = spark.createDataFrame([("paper-c", "a.pdf", "控制屏障函数导航", "Safe Navigation with CBF", "T-RO", "Author C", "2025", "PPO, CBF, safety constraint", 0)], PAPERS)
    nodes, _, stats = workbook.graph_of(workbook.entries(sheet(spark, []), spark.createDataFrame([], LINKS), papers, "library"))
    assert stats.collect()[0].papers == 1
    assert {("author", "Author C"), ("method", "CBF")} <= {(r.type, r.label) for r in nodes.collect()}


def test_requests_without_a_time_leave_the_cache_alone(spark):
    rows = [(1, "k", None), (2, "k", None), (3, "k", 10), (4, "k", 20), (5, "k", 500), (6, None, None), (7, None, 5)]
    df = spark.createDataFrame(rows, "event_id long, key string, ms long")
    got = {r.event_id: (r.fetched_ms, r.hit) for r in requests.cached(df, ["key"], 100).collect()}
    assert got == {1: (None, False), 2: (None, False), 3: (10, False), 4: (10, True), 5: (500, False), 6: (None, False), 7: (5, False)}
