"""Persisted state: updates, deletions, rebuild, compaction, streams, translations."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorespan.operators.embed import HashEmbedder, embed
from lorespan.plans.drain import drain_translations, numbered
from lorespan.plans.index import IndexOptions
from lorespan.plans.notes import append_notes
from lorespan.sources.files import FileCorpus, scan_files
from lorespan.sources.store import IndexStore, chunks_of_file, open_chunks, write_chunks
from lorespan.sources.tables import corpus_from_table
from lorespan.streaming import ingest

T0 = datetime(2024, 1, 1)


def corpus(spark, **texts):
    rows = [(f"{p}.md", t, T0 + timedelta(days=len(t))) for p, t in texts.items()]
    return corpus_from_table(spark.createDataFrame(rows, "relpath string, text string, mtime timestamp"))


def contents(store):
    return sorted((r.source_file, r.content) for r in store.chunks().collect())


def statuses(store):
    return {r.relpath: r.status for r in store.manifest().collect()}


def test_updates_follow_the_corpus(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"), embedder=HashEmbedder(8))
    assert store.current() == (0, 0) and store.manifest().count() == 0 and store.chunks().count() == 0
    first = corpus(spark, a="one", b="two", c="three ")
    store.update(first)
    assert contents(store) == [("a.md", "one"), ("b.md", "two"), ("c.md", "three")]
    assert set(statuses(store).values()) == {"indexed"}
    assert store.scan(first).filter("action <> 'unchanged'").count() == 0

    store.update(corpus(spark, a="one", b="two changed", d="four"))
    assert contents(store) == [("a.md", "one"), ("b.md", "two changed"), ("d.md", "four")]
    assert statuses(store) == {"a.md": "indexed", "b.md": "indexed", "d.md": "indexed"}
    assert {r.relpath: r.result for r in store.last_outcomes().collect()} == {
        "b.md": "ok", "d.md": "ok", "c.md": "deleted"}

    before, rows = contents(store), store.manifest().count()
    store.compact()
    assert contents(store) == before and store.manifest().count() == rows
    assert store.current() == (3, 3)
    store.rebuild(corpus(spark, a="one", b="two changed"))
    assert contents(store) == [("a.md", "one"), ("b.md", "two changed")]
    assert statuses(store) == {"a.md": "indexed", "b.md": "indexed", "d.md": "indexed"}
    store.update(corpus(spark, a="one", b="again"))
    assert contents(store) == [("a.md", "one"), ("b.md", "again")]


def test_a_failed_run_is_not_seen(spark, tmp_path, monkeypatch):
    store = IndexStore(spark, str(tmp_path / "s"))
    store.update(corpus(spark, a="one"))
    with monkeypatch.context() as patch:
        def fail(*_):
            raise RuntimeError("lost")
        patch.setattr(IndexStore, "_commit", fail)
        with pytest.raises(RuntimeError):
            store.update(corpus(spark, a="other text", b="b"))
    assert contents(store) == [("a.md", "one")]
    store.update(corpus(spark, a="other text"))
    assert contents(store) == [("a.md", "other text")] and list(statuses(store)) == ["a.md"]


def test_blank_document_keeps_its_old_chunks(spark, tmp_path):
    for purge, left in ((False, [("a.md", "one")]), (True, [])):
        store = IndexStore(spark, str(tmp_path / str(purge)), IndexOptions(purge_on_error=purge))
        store.update(corpus(spark, a="one"))
        store.update(corpus(spark, a="     "))
        assert statuses(store) == {"a.md": "error"} and contents(store) == left
        store.update(corpus(spark, a="     "))
        assert statuses(store) == {"a.md": "error"}


def test_scan_without_index_then_index_only(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"))
    texts = corpus(spark, a="one", b="two")
    store.update(texts, index=False)
    assert set(statuses(store).values()) == {"pending_index"} and contents(store) == []
    questions = embed(spark.createDataFrame([(1, "one")], "query_id bigint, question string"), "question", HashEmbedder(8))
    store.embedder = HashEmbedder(8)
    hits = store.search_fresh(questions, texts, top_k=1).collect()
    assert len(hits) == 1 and set(statuses(store).values()) == {"indexed"}
    store.update(corpus(spark, a="one"), index=False)
    assert statuses(store)["b.md"] == "deleted"
    store.index_only(texts)
    assert list(statuses(store)) == ["a.md"] and contents(store) == [("a.md", "one")]


def test_an_update_takes_few_jobs(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"), embedder=HashEmbedder(8))
    store.update(corpus(spark, a="one", b="two", c="three"))
    for path, texts in (("t1", dict(a="one", b="two changed", d="four")), ("t2", dict(a="one", b="again", d="fifth"))):
        corpus(spark, **texts).write.parquet(str(tmp_path / path))
        table = spark.read.parquet(str(tmp_path / path))
        jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
        before = jobs()
        store.update(table)
        assert jobs() - before <= 25
    assert contents(store) == [("a.md", "one"), ("b.md", "again")]


def test_a_failed_run_is_not_seen(spark, tmp_path, monkeypatch):
    store = IndexStore(spark, str(tmp_path / "s"))
    store.update(corpus(spark, a="one"))
    with monkeypatch.context() as patch:
        def fail(*_):
            raise RuntimeError("lost")
        patch.setattr(IndexStore, "_commit", fail)
        with pytest.raises(RuntimeError):
            store.update(corpus(spark, a="other text", b="b"))
    assert contents(store) == [("a.md", "one")]
    store.update(corpus(spark, a="other text"))
    assert contents(store) == [("a.md", "other text")] and list(statuses(store)) == ["a.md"]


def test_blank_document_keeps_its_old_chunks(spark, tmp_path):
    for purge, left in ((False, [("a.md", "one")]), (True, [])):
        store = IndexStore(spark, str(tmp_path / str(purge)), IndexOptions(purge_on_error=purge))
        store.update(corpus(spark, a="one"))
        store.update(corpus(spark, a="     "))
        assert statuses(store) == {"a.md": "error"} and contents(store) == left
        store.update(corpus(spark, a="     "))
        assert statuses(store) == {"a.md": "error"}


def test_scan_without_index_then_index_only(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"))
    texts = corpus(spark, a="one", b="two")
    store.update(texts, index=False)
    assert set(statuses(store).values()) == {"pending_index"} and contents(store) == []
    questions = embed(spark.createDataFrame([(1, "one")], "query_id bigint, question string"), "question", HashEmbedder(8))
    store.embedder = HashEmbedder(8)
    hits = store.search_fresh(questions, texts, top_k=1).collect()
    assert len(hits) == 1 and set(statuses(store).values()) == {"indexed"}
    store.update(corpus(spark, a="one"), index=False)
    assert statuses(store)["b.md"] == "deleted"
    store.index_only(texts)
    assert list(statuses(store)) == ["a.md"] and contents(store) == [("a.md", "one")]


def test_an_update_takes_few_jobs(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"), embedder=HashEmbedder(8))
    store.update(corpus(spark, a="one", b="two", c="three"))
    for path, texts in (("t1", dict(a="one", b="two changed", d="four")), ("t2", dict(a="one", b="again", d="fifth"))):
        corpus(spark, **texts).write.parquet(str(tmp_path / path))
        table = spark.read.parquet(str(tmp_path / path))
        spark.sparkContext.setJobGroup(path, "update")
        try:
            store.update(table)
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(path)) <= 20
    assert contents(store) == [("a.md", "one"), ("b.md", "again"), ("d.md", "fifth")]


def test_update_from_a_file_tree(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    for name, text in (("a.md", "one"), ("b.md", "two")):
        (root / name).write_text(text)
    store = IndexStore(spark, str(tmp_path / "s"))
    store.update(FileCorpus(scan_files(spark, str(root))))
    assert contents(store) == [("a.md", "one"), ("b.md", "two")]
    (root / "a.md").unlink()
    (root / "c.md").write_text("three")
    store.update(FileCorpus(scan_files(spark, str(root))))
    assert contents(store) == [("b.md", "two"), ("c.md", "three")]
    assert {r.relpath: r.result for r in store.last_outcomes().collect()} == {"a.md": "deleted", "c.md": "ok"}


HU = "és nem hogy már volt egy csak szöveg amely elég hosszú "


def test_translations_are_drained_in_batches(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"), IndexOptions(translation_enabled=True))
    texts = corpus(spark, en="plain text", **{f"hu{i}": HU + str(i) for i in range(5)})
    store.update(texts)
    assert sorted(statuses(store).values()) == ["indexed"] + ["pending_translation"] * 5

    def translate(df):
        return df.select("relpath", F.concat(F.lit("<!-- hu -->\nin English "), F.col("relpath")).alias("text"))

    assert drain_translations(store, texts, translate, batch=2, max_batches=2) == 2
    assert sorted(statuses(store).values()) == ["indexed"] * 5 + ["pending_translation"]
    assert drain_translations(store, texts, translate, batch=2) == 1
    assert ("hu3.md", "in English hu3.md") in contents(store) and len(contents(store)) == 6
    assert {r.language for r in store.chunks().filter("source_file like 'hu%'").collect()} == {"hu"}
    assert drain_translations(store, texts, translate) == 0
    assert {r.relpath for r in store.translations().collect()} == {f"hu{i}.md" for i in range(5)}
    store.update(corpus(spark, en="plain text", **{f"hu{i}": HU + str(i) for i in range(4)}))
    assert {r.relpath for r in store.translations().collect()} == {f"hu{i}.md" for i in range(4)}  # with its document
    store.compact()
    assert store.translations().count() == 4


def test_places_follow_the_order_of_paths(spark):
    rows = spark.range(1000).selectExpr("concat('p', lpad(hash(id) & 65535, 5, '0'), '-', id) relpath").repartition(9)
    got = {r.relpath: r.place for r in numbered(rows).collect()}
    assert [got[p] for p in sorted(got)] == list(range(1000))
    assert numbered(rows.limit(0)).count() == 0


def test_notes_are_indexed_at_once(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"))
    store.update(corpus(spark, a="one"))
    notes = spark.createDataFrame([("a line about the fleet", "note", T0)], "content string, title string, written_at timestamp")
    for c in ("session", "agent", "tags"):
        notes = notes.withColumn(c, F.lit(None).cast("string"))
    append_notes(notes, store)
    got = dict(contents(store))
    assert got["a.md"] == "one" and "fleet" in got["knowledge/diary/2024-01-01_000000_note.md"]


def test_stream_state_equals_batch_state(spark, tmp_path):
    texts = {f"d{i}": f"text {i}" for i in range(12)}
    old = corpus(spark, **texts)
    new = corpus(spark, d1="later text 1", d2="later text 2")
    landing = str(tmp_path / "in")
    old.unionByName(new).repartition(6).select("relpath", "text", "mtime", "size", "content_hash").write.parquet(landing)
    streamed = IndexStore(spark, str(tmp_path / "stream"))
    query = ingest.stream_update(ingest.read_landing(spark, landing, 2), streamed, str(tmp_path / "progress"))
    query.awaitTermination()
    batch = IndexStore(spark, str(tmp_path / "batch"))
    batch.update(corpus(spark, **{**texts, "d1": "later text 1", "d2": "later text 2"}))
    assert contents(streamed) == contents(batch) and statuses(streamed) == statuses(batch)
    versions = streamed.current()
    assert versions[0] >= 3
    # nothing new has landed: nothing changes
    ingest.stream_update(ingest.read_landing(spark, landing, 2), streamed, str(tmp_path / "progress")).awaitTermination()
    assert streamed.current() == versions


def test_chunks_of_one_file_reads_one_bucket(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.range(200).select(
        F.format_string("%05d", "id").alias("id"),
        F.when(F.col("id") % 3 == 0, "hot.md").otherwise(F.concat(F.lit("f"), F.col("id").cast("string"))).alias("source_file"),
        *[F.lit("x").alias(c) for c in ("section", "date", "language")],
        F.lit(0).alias("chunk_index"), *[F.lit("x").alias(c) for c in ("content", "text", "content_preview")],
        F.lit(None).cast("array<float>").alias("embedding"),
    )
    write_chunks(rows, path, buckets=4)
    table = open_chunks(spark, path)
    one = chunks_of_file(table, "hot.md", buckets=4)
    assert table.count() == 200 and one.count() == 67
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()
    assert open_chunks(spark, str(tmp_path / "absent")).count() == 0


def test_recorded_changes_survive_another_delivery(spark, tmp_path):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = corpus(spark, a="one", b="two").select("relpath", "text", "mtime", "size", "content_hash")
    rows.coalesce(1).write.parquet(landing)
    store = IndexStore(spark, str(tmp_path / "s"))
    for progress in ("p1", "p2"):  # the second stream starts anew and delivers everything again
        ingest.stream_changes(ingest.read_landing(spark, landing), store, out, str(tmp_path / progress)).awaitTermination()
        assert spark.read.parquet(out).count() == 2
    assert {r.stream for r in spark.read.parquet(out).collect()} - {"None", None}


def test_a_batch_that_was_taken_is_passed_over(spark, tmp_path, monkeypatch):
    landing = str(tmp_path / "in")
    rows = corpus(spark, a="one", b="two").select("relpath", "text", "mtime", "size", "content_hash")
    rows.coalesce(1).write.parquet(landing)
    store = IndexStore(spark, str(tmp_path / "s"))
    query = ingest.stream_update(ingest.read_landing(spark, landing), store, str(tmp_path / "p"))
    query.awaitTermination()
    before = store.current()
    assert store.took(f"{query.id}/0") and not store.took(f"{query.id}/1")
    for name in ("commits/0", "commits/.0.crc"):  # as if the stream had died before it noted the batch
        (tmp_path / "p" / name).unlink(missing_ok=True)
    again = ingest.stream_update(ingest.read_landing(spark, landing), store, str(tmp_path / "p"))
    again.awaitTermination()
    assert again.id == query.id and store.current() == before


def test_versions_without_a_time_are_compared_by_content(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"))
    store.update(corpus(spark, a="one"))
    again = corpus(spark, a="other").withColumn("mtime", F.lit(None).cast("timestamp"))
    assert ingest.newer_versions(again, store).count() == 1


def versions_of(spark, count):
    rows = spark.range(0, count, 1, 1).select(
        F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".md")).alias("relpath"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
        F.lit(T0).cast("timestamp").alias("mtime"),
    )
    return corpus_from_table(rows).select("relpath", "text", "mtime", "size", "content_hash")


def test_a_batch_that_lands_in_one_file_is_dealt_over_the_tasks(spark, tmp_path):
    versions_of(spark, 200).write.parquet(str(tmp_path / "in"))
    reduced = ingest._reduced(spark.read.parquet(str(tmp_path / "in")), IndexStore(spark, str(tmp_path / "s")))
    assert reduced.count() == 200 and len(reduced.inputFiles()) >= 4


def test_changes_of_a_batch_are_looked_at_once(spark, tmp_path, monkeypatch):
    versions_of(spark, 20).write.parquet(str(tmp_path / "in"))
    store = IndexStore(spark, str(tmp_path / "s"))

    def again(*_, **__):
        raise AssertionError("the texts are read a second time")

    monkeypatch.setattr("lorespan.sources.store.look_at", again)
    stream = ingest.read_landing(spark, str(tmp_path / "in"))
    ingest.stream_changes(stream, store, str(tmp_path / "out"), str(tmp_path / "p")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    assert set(statuses(store).values()) == {"pending_index"} and len(statuses(store)) == 20
