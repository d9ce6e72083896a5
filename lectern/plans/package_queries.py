"""A course package from end to end: conversations as courses, their turns as items and as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import course, package
from lectern.plans.base import query, table

# Turn t is item t % 3 of module t // 3. It links the files of turns 2t and 3t where there are such, and says how much
# of the first is to be read; user turns are pages, the others tasks, of which some have one title.
_BUILT = r"""
c AS (SELECT conv_id AS id, turn AS t, role, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '\p{L}+') AS w FROM conversations),
size AS (SELECT id, count(*) AS n FROM c GROUP BY id),
f AS (SELECT id, t, 'viewer/files/Unit ' || t || '/pdf_Dr ' || substr(w[1], 1, 30) || ', On ' || array_to_string(w[2:4], ' ') || ' (2001) p1-9.pdf' AS path,
  'Dr ' || substr(w[1], 1, 30) AS author, trim('On ' || array_to_string(w[2:4], ' ')) AS title, CASE WHEN t % 5 = 4 THEN ' ' ELSE x END AS text FROM c WHERE len(w) > 0),
i AS (SELECT c.id, c.t, CASE WHEN role = 'user' THEN 'WikiPage' WHEN c.t % 4 = 1 THEN 'Assignment' ELSE 'Quizzes::Quiz' END AS type,
  CASE WHEN role = 'user' THEN 'Lesson ' || c.t WHEN c.t % 4 = 1 OR c.id % 2 = 0 THEN ' Essay ' || c.t // 4 ELSE 'Quiz ' || c.t END AS title,
  list_filter(list_transform(string_split(x, chr(10)), lambda z: trim(regexp_replace(z, '\s+', ' ', 'g'), ' ')), lambda z: z <> '') AS lines, a.title AS read,
  CASE WHEN a.title IS NOT NULL THEN a.title || ' (2001) Read pages ' || c.t || '-' || (c.t + 3) END AS told
  FROM c LEFT JOIN f a ON a.id = c.id AND a.t = 2 * c.t),
it AS (SELECT *, trim(title) || chr(10) || chr(10) || array_to_string(lines, chr(10) || chr(10)) || coalesce(chr(10) || chr(10) || told, '') || chr(10) || chr(10) || 'Write 500-1,' || lpad((t * 10)::VARCHAR, 3, '0') || ' words.' || chr(10) || chr(10) || 'First Second Out' AS text FROM i),
pg AS (SELECT * FROM it WHERE type = 'WikiPage' AND len(regexp_split_to_array(text, '\s+')) >= 100)"""
_SETS = r"""
words AS (SELECT id, t, title, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^a-z0-9\s]', ' ', 'g'), '\s+'),
  lambda z: length(z) >= 3 AND z NOT IN ('the', 'and', 'for', 'with', 'from', 'into', 'its', 'our', 'are', 'read', 'pages', 'page'))) AS w FROM f),
used AS (SELECT r.id, r.u, min(r.t * 2 + r.k) AS place FROM (SELECT id, t, 0 AS k, 2 * t AS u FROM c UNION ALL SELECT id, t, 1, 3 * t FROM c WHERE t > 0) r GROUP BY ALL),
readings AS (
  SELECT id, t * 10 AS place, 'page' AS kind, trim(title) AS title, NULL AS author, text, NULL AS instruction, 'https://out.example/' || id AS link FROM pg
  UNION ALL SELECT f.id, CASE WHEN place IS NULL THEN 1000000000 + f.t ELSE place // 2 * 10 + 1 + place % 2 END, 'file', f.title, author, f.text,
    CASE WHEN it.type = 'WikiPage' AND it.told IS NOT NULL AND len(list_intersect(a.w, b.w)) >= 0.8 * least(len(a.w), len(b.w)) AND least(len(a.w), len(b.w)) > 0
      THEN 'Read pages ' || it.t || '-' || (it.t + 3) END, NULL
    FROM f LEFT JOIN used ON used.id = f.id AND used.u = f.t LEFT JOIN it ON it.id = f.id AND it.t = place // 2
    LEFT JOIN words a ON a.id = f.id AND a.t = f.t LEFT JOIN words b ON b.id = f.id AND b.t = 2 * it.t WHERE trim(f.text) <> '')"""


def built(spark, sf_dir) -> package.Package:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("t"), "role", F.coalesce("text", F.lit("")).alias("x"))
    c = c.withColumn("w", F.regexp_extract_all("x", F.lit(r"\p{L}+"), F.lit(0)))
    t = F.col("t").cast("string")
    title = F.concat(F.lit("On "), F.array_join(F.slice("w", 2, 3), " "))
    path = F.concat(F.lit("viewer/files/Unit "), t, F.lit("/pdf_Dr "), F.substring(F.get("w", F.lit(0)), 1, 30), F.lit(", "), title, F.lit(" (2001) p1-9.pdf"))
    files = c.where(F.size("w") > 0).select("id", "t", path.alias("path"), title.alias("title"), F.when(F.col("t") % 5 == 4, " ").otherwise(F.col("x")).alias("text"))
    of = lambda n: files.select(F.col("id").alias(f"_id{n}"), F.col("t").alias(f"_t{n}"), F.replace("path", F.lit(" "), F.lit("%20")).alias(f"href{n}"), F.col("title").alias(f"title{n}")).hint("merge")
    rows = c.join(of(2), (F.col("id") == F.col("_id2")) & (2 * F.col("t") == F.col("_t2")), "left").join(of(3), (F.col("id") == F.col("_id3")) & (3 * F.col("t") == F.col("_t3")), "left")
    essay = F.col("t") % 4 == 1
    kind = F.when(F.col("role") == "user", "WikiPage").when(essay, "Assignment").otherwise("Quizzes::Quiz")
    name = F.when(F.col("role") == "user", F.concat(F.lit("Lesson "), t)).when(essay | (F.col("id") % 2 == 0), F.concat(F.lit(" Essay "), F.floor(F.col("t") / 4).cast("string"))).otherwise(F.concat(F.lit("Quiz "), t))
    link = lambda href, text: F.coalesce(F.concat(F.lit('<a href="'), href, F.lit(f'?w=1">{text}</a> ')), F.lit(f"{text} "))
    told = F.concat(F.lit("<p>"), F.col("title2"), F.lit(" (2001) Read pages "), t, F.lit("-"), (F.col("t") + 3).cast("string"), F.lit("</p>"))
    html = F.concat(
        F.lit("<h1>"), name, F.lit("</h1><p>"), F.replace("x", F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"), F.coalesce(told, F.lit("")), F.lit("<p>Write 500-1,"), F.lpad((F.col("t") * 10).cast("string"), 3, "0"),
        F.lit(' words.</p><nav>menu</nav><p>Mark as done</p><p>'), link(F.col("href2"), "First"), link(F.col("href3"), "Second"), F.lit('<a href="https://out.example/'), F.col("id").cast("string"), F.lit('">Out</a></p>'),
    )
    # course scripts, one a course, as they come: parsed again by the package's reader
    item = F.struct("t", F.struct(name.alias("title"), kind.alias("type"), html.alias("content")).alias("i"))
    modules = rows.groupBy("id", F.floor(F.col("t") / 3).alias("m")).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["i"]).alias("items"))
    module = F.struct("m", F.struct(F.concat(F.lit("Lesson "), F.col("m").cast("string")).alias("name"), "items").alias("v"))
    one = modules.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(module)), lambda x: x["v"]).alias("modules"))
    script = F.concat(F.lit("window.COURSE_DATA = "), F.to_json(F.struct(F.lit("Course").alias("title"), "modules")), F.lit(";"))
    courses = one.select("id", F.lit("").alias("root"), course.parse_course(script).alias("course"))
    return package.course_package(courses, files.select("id", "path", "text"))


@query(f"WITH {_BUILT}, {_SETS} SELECT id, row_number() OVER (PARTITION BY id ORDER BY place) AS ord, kind, title, author, text, instruction, link FROM readings")
def course_package(spark, sf_dir) -> DataFrame:
    """All readings of a package in order: long pages, the files each is the first to link, and unlinked files last."""
    rows = built(spark, sf_dir).readings
    return rows.select("id", F.col("ord").cast("long").alias("ord"), "kind", "title", "author", "text", "instruction", F.element_at(F.col("links.target"), -1).alias("link"))


@query(rf"""WITH {_BUILT}, named AS (SELECT *, row_number() OVER (PARTITION BY id, lower(trim(title)) ORDER BY t) AS k FROM it WHERE type <> 'WikiPage')
SELECT id, t // 3 AS module, t % 3 AS item, trim(title) AS title, CASE WHEN type = 'Assignment' THEN 'paper' ELSE 'quiz' END AS kind,
CASE WHEN type = 'Assignment' THEN text END AS prompt, CASE WHEN type = 'Assignment' THEN 1000 + t * 10 END AS word_target FROM named WHERE k = 1""")
def course_tasks(spark, sf_dir) -> DataFrame:
    """Tasks of a package, the first of equal titles, with the prompts of papers."""
    made = built(spark, sf_dir)
    papers = made.papers.select("id", "module", "item", "prompt", "word_target").hint("merge")
    rows = made.tasks.join(papers, ["id", "module", "item"], "left")
    return rows.select("id", F.col("module").cast("long").alias("module"), F.col("item").cast("long").alias("item"), "title", "kind", "prompt", "word_target")
