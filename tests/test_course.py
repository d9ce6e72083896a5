"""A course package from its script to readings, tasks, papers and notices; and positions in large groups."""

import json

from pyspark.sql import functions as F

from lectern.operators import course, order, package

LONG = " ".join(f"word{k}" for k in range(120))


def link(path, text="file"):
    return f'<a href="viewer/files/{path.replace(" ", "%20")}">{text}</a>'


def test_course_package(spark):
    items = [
        {"title": " First page ", "type": "WikiPage", "content": f"<p>{LONG}</p><p>Sea and Land Trade (1990) Read pages 3-9 and 12</p>" + link("b/pdf_Oak, Sea and Land Trade (1990).pdf") + link("gone.pdf") + link("blank.txt") + link("picture.png") + '<a href="https://x.example/a">Out</a>'},
        {"title": "Essay", "type": "Assignment", "content": "<p>Write 500-1,200 words.</p>" + link("notes10.md")},
        {"title": "ESSAY ", "type": "Quizzes::Quiz"},
    ]
    later = [
        {"title": "Short", "type": "WikiPage", "content": "<p>Click on.</p>" + link("b/pdf_Oak, Sea and Land Trade (1990).pdf") + link("last.docx")},
        {"title": "Quiz", "type": "Quizzes::Quiz"}, {"title": "Essay 2", "type": "Assignment", "content": None}, {"title": "Tool", "type": "ExternalUrl"},
    ]
    modules = [{"name": "One", "items": items}, {"name": "Locked", "items": [{"title": "p", "type": "WikiPage", "content": " "}]}, {"name": "Two", "items": later}, {"name": "Three", "items": [{"title": "q", "type": "WikiPage"}]}]
    script = "window.COURSE_DATA = " + json.dumps({"title": "T", "modules": modules}) + ";\n"
    courses = spark.createDataFrame([(1, "top/", script), (2, "", "alert(1)"), (3, "", 'x = {"title": "y"};'), (4, None, None), (5, "", 'x = {"modules": []};')], "id int, root string, js string")
    courses = courses.select("id", "root", course.parse_course(F.col("js")).alias("course"))
    names = ["b/pdf_Oak, Sea and Land Trade (1990).pdf", "notes10.md", "notes2.md", "notes1.md", "last.docx", "picture.png", ".hidden.txt", "__MACOSX/x.txt"]
    files = [(1, f"top/viewer/files/{n}", f"text of {n}") for n in names] + [(1, "top/viewer/files/blank.txt", " "), (1, "top/viewer/files/null.txt", None), (1, "other/file.txt", "outside"), (2, "viewer/files/a.txt", "no course"), (5, "viewer/files/only.txt", "z")]
    made = package.course_package(courses, spark.createDataFrame(files, "id int, path string, text string"))
    rows = {(r["id"], r["ord"]): r for r in made.readings.collect()}
    assert {k: r["title"] for k, r in rows.items()} == {
        (1, 1): "First page", (1, 2): "Sea and Land Trade", (1, 3): "notes10", (1, 4): "last", (1, 5): "notes1", (1, 6): "notes2", (5, 1): "only",
    }
    assert rows[1, 2]["author"] == "Oak" and rows[1, 2]["year"] == "1990" and rows[1, 2]["instruction"] == "Read pages 3-9 and 12"
    assert [tuple(x) for x in rows[1, 1]["links"]] == [("link", "Out", "https://x.example/a")] and rows[1, 1]["kind"] == "page"
    assert sorted((r["module"], r["item"], r["title"], r["kind"]) for r in made.tasks.collect()) == [(0, 1, "Essay", "paper"), (2, 1, "Quiz", "quiz"), (2, 2, "Essay 2", "paper")]
    assert [(r["title"], r["word_target"]) for r in made.papers.collect()] == [("Essay", 1200)]
    (notice,) = made.notices.collect()
    assert notice["id"] == 1 and notice["modules"] == ["Locked", "Three"] and notice["notice"].startswith("Locked, Three")


def test_numbered(spark):
    """Places in a group of nearly all rows, in several tasks, and in a group without a name."""
    df = spark.range(20_000).select(F.when(F.col("id") % 100 == 0, F.lit(None)).otherwise(F.lit("hot")).alias("g"), (F.col("id") * 7919 % 20_011).alias("v"))
    got = order.numbered(df, ["g"], [-F.col("v")], "n").collect()
    for g in ("hot", None):
        mine = sorted(((r["n"], r["v"]) for r in got if r["g"] == g))
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and [v for _, v in mine] == sorted((v for _, v in mine), reverse=True)
    assert len(got) == 20_000
    assert order.numbered(df.limit(0), ["g"], [F.col("v")], "n").count() == 0
    assert sorted(r["n"] for r in order.numbered(spark.range(10), [], [F.col("id")], "n").collect()) == list(range(1, 11))
