"""Streams over several micro-batches give what the batch gives; results do not depend on partitions."""

import os
import shutil

import oracle
import pytest
from pyspark.sql import functions as F

from lectern.operators import ledger, library, segment
from lectern.plans import ledger_queries as L
from lectern.plans.base import readings, table
from lectern.shared import passing_path
from lectern.streaming import index, jobs, tables


@pytest.fixture(scope="module")
def parts(spark, small, tmp_path_factory):
    """Events as six files, so a stream takes six batches."""
    path = str(tmp_path_factory.mktemp("events") / "events.parquet")
    table(spark, small, "events").repartitionByRange(6, "event_id").write.parquet(path)
    return path


def rules(spark):
    return spark.createDataFrame(L.RULES, "rule_no int, pattern string, in_price double, out_price double, cache_read double")


def test_spend(spark, small, parts):
    out = jobs.spend_by_day(ledger.with_cost_streaming(L.raw_usage(jobs.source(spark, parts, 1)), rules(spark)), passing_path(spark))
    assert out.last() >= 5
    got = {(r["d"], r["feature"]): r["cost"] for r in out.read().select(F.to_date("day").alias("d"), "feature", F.round("cost", 6).alias("cost")).collect()}
    batch = L.usage(spark, small).groupBy(F.to_date("at").alias("d"), "feature").agg(F.round(F.sum("cost"), 6).alias("cost")).collect()
    assert got == pytest.approx({(r["d"], r["feature"]): r["cost"] for r in batch}, abs=2e-6)


def test_late_calls_are_dropped(spark, tmp_path):
    """A call older than the watermark does not change a closed day."""
    schema = "at timestamp, feature string, cost double"
    path = str(tmp_path / "u.parquet")
    for k, day in enumerate(("2024-01-01", "2024-03-01", "2024-03-02", "2024-01-01")):
        spark.createDataFrame([(day, "x", 1.0)], "at string, feature string, cost double").select(F.col("at").cast("timestamp").alias("at"), "feature", "cost").coalesce(1).write.mode("append").parquet(path)
        del k
    files = sorted(spark.read.parquet(path).inputFiles())
    assert len(files) == 4
    out = jobs.spend_by_day(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path), passing_path(spark), "10 days")
    total = {str(r["day"])[:10]: r["cost"] for r in out.read().collect()}
    assert total["2024-03-01"] == total["2024-03-02"] == 1.0 and total["2024-01-01"] in (1.0, 2.0)


def test_progress(spark, small, parts):
    rows = lambda e: e.select(F.col("user_id").alias("reading"), "ts", "event_id", F.floor("value").cast("long").alias("position"), (F.col("event_type") == "purchase").alias("completed"))
    out = jobs.progress(rows(jobs.source(spark, parts, 1)), passing_path(spark))
    batch = rows(table(spark, small, "events")).groupBy("reading").agg(F.max_by("position", F.struct("ts", "event_id")).alias("position"), F.bool_or("completed").alias("completed"))
    assert sorted(map(tuple, out.read().collect())) == sorted(map(tuple, batch.collect()))


def test_newest(spark, small, parts):
    out = jobs.newest(jobs.source(spark, parts, 1).select("event_id", "ts"), passing_path(spark), 7, F.desc("ts"), F.desc("event_id"))
    want = table(spark, small, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(7).collect()
    assert sorted(r["event_id"] for r in out.read().collect()) == sorted(r["event_id"] for r in want)


def test_imports_are_idempotent(spark, small, tmp_path):
    path = str(tmp_path / "docs.parquet")
    title = F.concat(F.lit("t"), F.floor(F.col("doc_id") / 3).cast("string"))
    docs = table(spark, small, "documents").select("doc_id", F.col("source").alias("course"), title.alias("title"), "text", F.lit(False).alias("has_pages"))
    docs.repartitionByRange(3, "doc_id").write.parquet(path)
    folder = passing_path(spark)
    out = jobs.imports(jobs.source(spark, path, 1), folder)
    first = sorted(r["doc_id"] for r in out.read().collect())
    assert len(first) == docs.select("course", "title").distinct().count()
    # a stream of its own reads all files again
    batches = spark.read.parquet(path).withColumn("import_key", library.import_key(F.col("course"), F.col("title")))
    out.apply(batches, out.last() + 1, lambda have, b: have.unionByName(library.import_new(have, b, "doc_id").where("outcome = 'added'").drop("outcome")))
    assert sorted(r["doc_id"] for r in out.read().collect()) == first
    assert library.import_new(out.read().drop("import_key"), docs, "doc_id").where("outcome = 'added'").count() == 0


def files_in(path):
    return sorted(f for f in os.listdir(path) if f.endswith(".parquet"))


def test_jobs_go_on_where_they_stopped(spark, small, parts, tmp_path):
    """Half of the files, then a new run of the same job over all: only the others are read, and the rows are the batch's."""
    here = tmp_path / "events.parquet"
    here.mkdir()
    for f in files_in(parts)[:3]:
        shutil.copy(f"{parts}/{f}", here)
    folder, read = str(tmp_path / "job"), []

    def rows():
        e = jobs.source(spark, str(here), 1)
        return e.select(F.col("user_id").alias("reading"), "ts", "event_id", F.floor("value").cast("long").alias("position"), (F.col("event_type") == "purchase").alias("completed"))

    first = jobs.progress(rows(), folder)
    read.append(first.last())
    for f in files_in(parts)[3:]:
        shutil.copy(f"{parts}/{f}", here)
    out = jobs.progress(rows(), folder)
    read.append(out.last())
    assert read == [2, 5]
    events = table(spark, small, "events").select(F.col("user_id").alias("reading"), "ts", "event_id", F.floor("value").cast("long").alias("position"), (F.col("event_type") == "purchase").alias("completed"))
    want = events.groupBy("reading").agg(F.max_by("position", F.struct("ts", "event_id")).alias("position"), F.bool_or("completed").alias("completed"))
    assert sorted(map(tuple, out.read().collect())) == sorted(map(tuple, want.collect()))


def priced(spark, path):
    calls = ledger.with_cost_streaming(L.raw_usage(jobs.source(spark, path, 1)), rules(spark))
    return calls.select(F.lit("all").alias("month"), "at", F.col("event_id").alias("call_id"), F.round(F.col("cost") * 1e9).cast("long").alias("nanos"))


def test_alerts_are_told_once(spark, small, parts, tmp_path, monkeypatch):
    """Calls of one hot month in six batches, with a stop in the middle of a batch: each share is told once, with the call that reaches it."""
    limit, spent, want = 100_000_000, 0, {}
    order = {f: k for k, f in enumerate(files_in(parts))}
    rows = L.usage(spark, small).select("event_id", "at", F.round(F.col("cost") * 1e9).cast("long").alias("nanos"))
    inputs = {r["event_id"]: order[r["f"]] for r in spark.read.parquet(parts).select("event_id", F.col("_metadata.file_name").alias("f")).collect()}
    for r in sorted(rows.collect(), key=lambda r: (inputs[r["event_id"]], r["at"], r["event_id"])):
        for share in (80, 100):
            if spent < share * limit // 100 <= spent + r["nanos"]:
                want[share] = r["event_id"], spent + r["nanos"]
        spent += r["nanos"]
    assert len(want) == 2
    folder, plain, failed = str(tmp_path / "job"), tables.KeyedTable.apply, []

    def broken(self, batch, number, merge):
        done = plain(self, batch, number, merge)
        if number == 1 and self.path.endswith("alerts") and not failed:
            failed.append(number)
            raise RuntimeError("lost")
        return done

    monkeypatch.setattr(tables.KeyedTable, "apply", broken)
    with pytest.raises(Exception, match="lost"):
        jobs.limit_alerts(priced(spark, parts), folder, limit)
    log = jobs.limit_alerts(priced(spark, parts), folder, limit)
    assert failed == [1] and {r["share"]: (r["call_id"], r["spent"]) for r in log.read().collect()} == want
    sums = jobs.kept(spark, folder, "sums", jobs.SUMS, ["month"])
    assert [r["spent"] for r in sums.read().collect()] == [spent]


def test_keyed_table(spark, tmp_path):
    """Only touched parts are written, a batch counts once, and what nobody names any more goes."""
    rows = lambda *x: spark.createDataFrame(list(x), "k bigint, v string")
    t = tables.KeyedTable(spark, str(tmp_path / "t"), rows().schema, ["k"], 8)
    put = tables.replacing(["k"])
    assert t.read().count() == 0 and t.apply(rows(), 0, put) == []
    t.apply(rows(*((k, "a") for k in range(50))), 1, put)
    before = t.newest()
    touched = t.apply(rows((7, "b"), (50, "b")), 2, put)
    assert 1 <= len(touched) <= 2 and {p: n for p, n in t.newest().items() if p not in touched} == {p: n for p, n in before.items() if p not in touched}
    assert set(t.files.names("data/batch=2")) - {"_SUCCESS"} == {f"_part={p}" for p in touched}
    assert t.apply(rows((7, "again")), 2, put) == [] and dict(t.read().collect())[7] == "b"
    for n in range(3, 7):
        t.apply(rows((7, str(n))), n, put)
    assert sorted(t.read().collect()) == [(k, "b" if k == 50 else "6" if k == 7 else "a") for k in range(51)]
    part = touched[0] if len(touched) == 1 else next(p for p in touched if t.newest()[p] == 6)
    assert len([d for d in t.files.names("data") if f"_part={part}" in t.files.names(f"data/{d}")]) == 2 and len(t.numbers()) == 2
    # a part that loses all rows, and a folder left by a batch that did not come to count
    gone = t.apply(rows((7, "x")), 7, lambda old, new: old.limit(0))
    assert len(gone) == 1 and all(r["k"] != 7 for r in t.read().collect())
    rows((1, "left over")).withColumn("_part", F.lit(0)).write.partitionBy("_part").parquet(str(tmp_path / "t/data/batch=8"))
    t.apply(rows((50, "last")), 8, put)
    assert all(r["v"] != "left over" for r in t.read().collect()) and dict(t.read().collect())[50] == "last"
    again = tables.KeyedTable(spark, str(tmp_path / "t"), rows().schema, ["k"], 8)
    assert sorted(again.read().collect()) == sorted(t.read().collect())


def test_posting_index(spark, tmp_path):
    """An index over many updates holds what one made at once holds; an update writes only its terms' parts."""
    docs = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = index.PostingIndex(spark, str(tmp_path / "i"), 32)
    now = {k: f"common stone number{k} river{k % 7}" for k in range(40)}
    kept.update(docs(list(now.items())))
    written = lambda g: {int(x[5:]) for x in kept.files.names(f"postings/generation={g}") if x.startswith("part=")}
    now[3] = "only zebra"
    assert kept.update(docs([(3, now[3]), (4, now[4])])) == 1 and len(written(1)) <= 2 < len(written(0))
    for k in range(10):
        now[100 + k], gone = f"zebra stone {'word' * k}", k
        now.pop(gone)
        kept.update(docs([(100 + k, now[100 + k])]), spark.createDataFrame([(gone,), (9999,)], "doc_id bigint"))
    now[5] = None
    kept.update(docs([(5, None), (20, now[20])]))

    def held():
        rows = kept.postings().select("term", "doc_id", "tf").collect()
        return sorted(map(tuple, rows))

    want = sorted(map(tuple, index.term_counts(docs(list(now.items()))).collect()))
    assert held() == want
    found = kept.lookup(spark.createDataFrame([("zebra",), ("stone",), ("none",)], "term string"))
    assert sorted(map(tuple, found.collect())) == [x for x in want if x[0] in ("zebra", "stone")]
    assert "PartitionFilters: [isnotnull(generation" in found._jdf.queryExecution().toString() and "part#" in found._jdf.queryExecution().toString()
    crowded = kept.crowded()
    assert crowded and kept.merge() == crowded and not kept.crowded() and held() == want
    kept.update(docs([(101, "zebra again")]))
    now[101] = "zebra again"
    assert held() == sorted(map(tuple, index.term_counts(docs(list(now.items()))).collect()))
    assert kept.merge(list(range(32))) and held() == sorted(map(tuple, index.term_counts(docs(list(now.items()))).collect()))


def test_sentences_lose_nothing(spark, small):
    docs = readings(spark, small)
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    joined = segment.sentences(docs).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "").alias("all"))
    assert docs.join(joined, "doc_id").where(bare(F.col("text")) != bare(F.col("all"))).count() == 0


def test_partitions_do_not_matter(spark, small):
    from lectern import registry

    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append([oracle.rows(registry.queries()[q](spark, small).toPandas()) for q in ("bm25_topk", "running_lines", "import_dedup", "unassigned_pages")])
        assert got[0] == got[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
