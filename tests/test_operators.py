"""Scan rules, change detection, routing, notes, search: fixed cases and brute force."""

import math
import re
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespan.functions import scalars as S
from lorespan.operators import changes as CH
from lorespan.operators import ivf, lexical, routing
from lorespan.operators import search as SE
from lorespan.operators.embed import HashEmbedder, embed
from lorespan.operators.topk import rank_hits
from lorespan.plans import index as IX
from lorespan.schemas import MANIFEST
from lorespan.sources import files, store
from lorespan.sources.notes import render_notes
from lorespan.sources.tables import corpus_from_table, latest_versions

T0 = datetime(2024, 1, 1)


def values(spark, expression, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.x for r in rows.select("i", expression.alias("x")).orderBy("i").collect()]


def corpus(spark, *rows):
    frame = spark.createDataFrame([(p, t, m) for p, t, m in rows], "relpath string, text string, mtime timestamp")
    return corpus_from_table(frame)


def entry(path, text, mtime=T0, status="indexed", language="en", count=None):
    import hashlib

    return (path, hashlib.sha256(text.encode()).hexdigest(), mtime, language, None, status, len(text), mtime, None, count, None)


# --- scanning -----------------------------------------------------------------------


@pytest.fixture
def tree(tmp_path):
    for name in [
        "readme.md", "docs/guide.md", "node_modules/pkg.md", "venv/y.md", "manifest.json", "src/code.py",
        "src/a b/deep é.py", "knowledge/diary/2026-06-27_000000_session.md", "knowledge/db/stray.md",
        "knowledge/translations/copy.md", "sub/manifest.json",
    ]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"content of {name}")
    return tmp_path


def found(df):
    return sorted(r.relpath for r in df.select("relpath").collect())


def test_scan_default_rules(spark, tree):
    got = found(files.scan_files(spark, str(tree)))
    assert got == ["docs/guide.md", "knowledge/diary/2026-06-27_000000_session.md", "readme.md"]


def test_scan_two_patterns_and_contents(spark, tree):
    listing = files.scan_files(spark, str(tree), ["**/*.md", "src/**/*.py"])
    assert {"src/code.py", "src/a b/deep é.py", "readme.md"} <= set(found(listing))
    read = files.read_contents(listing)
    texts = {r.relpath: r.text for r in files.decode_text(read).collect()}
    assert texts["src/a b/deep é.py"] == "content of src/a b/deep é.py" and len(texts) == listing.count()
    assert {r.relpath: r.text for r in files.corpus_from_files(listing).collect()} == texts


def test_scan_excluded_files(spark, tree):
    got = found(files.scan_files(spark, str(tree), ["**/*.json", "**/*.md"]))
    assert "manifest.json" not in got and "sub/manifest.json" in got


def test_walk_keeps_odd_names_and_enters_no_excluded_folder(spark, tree):
    for name in (".hidden/a.md", "_drafts/b.md", "x/.c.md", "knowledge/diary/deep/er/d.md", "a#b?/e%20f.md"):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(name)
    (tree / "loop").symlink_to(tree)
    (tree / "empty").mkdir()
    closed = tree / "node_modules"
    closed.chmod(0)  # entering it would fail for any user but root
    try:
        listing = files.scan_files(spark, str(tree))
        got = found(listing)
    finally:
        closed.chmod(0o755)
    assert got == sorted([
        ".hidden/a.md", "_drafts/b.md", "a#b?/e%20f.md", "docs/guide.md", "knowledge/diary/2026-06-27_000000_session.md",
        "knowledge/diary/deep/er/d.md", "readme.md", "x/.c.md"])
    read = {r.relpath: r.content for r in files.read_contents(listing).collect()}
    assert read["a#b?/e%20f.md"] == b"a#b?/e%20f.md" and len(read) == len(got)
    assert {r.path for r in listing.collect()} == {r.path for r in files.hash_files(listing).collect()}


def test_walk_of_an_empty_tree(spark, tmp_path):
    assert found(files.scan_files(spark, str(tmp_path))) == []


class Blocks:
    """A stream of zeros that notes how much is asked for."""

    def __init__(self, size):
        self.left, self.most = size, 0

    def read(self, n):
        self.most = max(self.most, n)
        n = min(n, self.left)
        self.left -= n
        return bytes(n)


def test_hash_holds_one_block(spark, tmp_path):
    import hashlib

    stream = Blocks(files.HASH_BLOCK * 3 + 5)
    assert files.block_hash(stream)[0] == hashlib.sha256(bytes(files.HASH_BLOCK * 3 + 5)).hexdigest()
    assert stream.most == files.HASH_BLOCK
    big = tmp_path / "big.md"
    with open(big, "wb") as f:
        f.truncate(3 << 30)  # larger than any cell of a frame
    row = files.hash_files(files.scan_files(spark, str(tmp_path))).first()
    assert row.size == 3 << 30 and len(row.content_hash) == 64


def test_scan_of_a_tree_reads_what_has_another_time(spark, tree, monkeypatch):
    listing = files.scan_files(spark, str(tree), ["**/*.md"])
    known = {r.relpath: r for r in files.hash_files(listing).collect()}
    guide, readme = known["docs/guide.md"], known["readme.md"]
    manifest = spark.createDataFrame([
        (r.relpath, r.content_hash, r.mtime - timedelta(seconds=d), "xx", None, "indexed", r.size, r.mtime, None, 1, None)
        for r, d in ((guide, 100), (readme, 0))
    ] + [entry("gone.md", "g")], MANIFEST)
    opened = []
    read = files.FileCorpus.rows_of
    monkeypatch.setattr(files.FileCorpus, "rows_of", lambda self, keys: opened.extend(found(keys)) or read(self, keys))
    got = {r.relpath: (r.action, r.touched, r.hash) for r in IX.scan(files.FileCorpus(listing), manifest).collect()}
    diary = "knowledge/diary/2026-06-27_000000_session.md"
    assert got == {
        "readme.md": ("unchanged", False, readme.content_hash), "docs/guide.md": ("unchanged", True, guide.content_hash),
        diary: ("new", False, known[diary].content_hash), "gone.md": ("deleted", False, None),
    }
    assert opened == [diary]  # the touched file was hashed, not read as text


@pytest.mark.parametrize("pattern, path, hit", [
    ("**/*.md", "a.md", True), ("**/*.md", "a/b/c.md", True), ("**/*.md", "a.mdx", False),
    ("src/**/*.py", "src/x.py", True), ("src/**/*.py", "src/a/b/x.py", True), ("src/**/*.py", "lib/src/x.py", False),
    ("docs/*", "docs/a", True), ("docs/*", "docs/a/b", False), ("docs/**", "docs/a/b", True),
    ("?.[!a]x", "b.cx", True), ("?.[!a]x", "b.ax", False), ("a+b.md", "aab.md", False), ("a\\d.md", "a1.md", False),
])
def test_globs(pattern, path, hit):
    assert bool(re.match(files.glob_regex(pattern).replace(r"\z", r"\Z"), path)) is hit


def test_dates(spark):
    got = values(spark, S.path_date(F.col("text")), "2026-06-27/file.md", "20260627_summary.md", "notes.md",
                 "20260627/x.md", "a/2026-99-99.md", "x/12345678.tar.gz", "x/.20240101")
    assert got == ["2026-06-27", "2026-06-27", None, None, "2026-99-99", "1234-56-78", "2024-01-01"]


def test_decode(spark):
    frame = spark.createDataFrame([(b"a\r\nb\rc\n\xff\xfe\xc3\xa9\xe2\x82",)], "content binary")
    assert files.decode_text(frame).first().text == b"a\nb\nc\n\xff\xfe\xc3\xa9\xe2\x82".decode("utf-8", "replace")


def test_language_thresholds(spark):
    def label(*texts):
        return values(spark, S.language_label(S.clean_for_language(F.col("text"))), *texts)

    pad = " abcdefghijklmnopqrstuvwxyz"
    assert label("és és és és" + pad, "és és és és és" + pad, "Ést és ÉS nem hogy már" + pad) == ["en", "hu", "hu"]
    assert label("és nem hogy már volt " + "a" * 8, "és nem hogy már volt " + "a" * 9) == ["en", "hu"]
    assert label("```és és és és és``` `és` és/x" + pad) == ["en"]


def test_comment_header(spark):
    got = values(spark, S.strip_translation_header(F.col("text")), " <!-- a\nb -->\n x", "<!-- open", "<!--> y", "z <!-- c -->")
    assert got == ["x", "<!-- open", "y", "z <!-- c -->"]


# --- change detection ------------------------------------------------------------------


def test_change_kinds(spark):
    texts = corpus(
        spark, ("new.md", "n", T0), ("same.md", "s", T0), ("touched.md", "t", T0), ("changed.md", "c2", T0),
        ("close.md", "other", T0 + timedelta(microseconds=900)),
    )
    manifest = spark.createDataFrame([
        entry("same.md", "s"), entry("touched.md", "t", T0 - timedelta(seconds=100)),
        entry("changed.md", "c1", T0 - timedelta(seconds=100)), entry("gone.md", "g"), entry("close.md", "x"),
    ], MANIFEST)
    classified = CH.classify(CH.label_corpus(texts), manifest)
    got = {r.relpath: (r.action, r.touched) for r in classified.collect()}
    assert got == {
        "new.md": ("new", False), "same.md": ("unchanged", False), "touched.md": ("unchanged", True),
        "changed.md": ("changed", False), "gone.md": ("deleted", False), "close.md": ("unchanged", False),
    }
    stats = CH.scan_stats(classified).first().asDict()
    assert stats == dict(total_files=5, unchanged=3, new=1, changed=1, deleted=1, pending_translation=0,
                         pending_index=2, manifest_entries=5, indexed=5)


def test_changes_do_not_shuffle_text(spark):
    texts = corpus(spark, ("a.md", "n", T0))
    plan = CH.detect_changes(texts, spark.createDataFrame([], MANIFEST))._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert shuffled and "text" not in plan.split("Exchange hashpartitioning")[0].split("SortMergeJoin")[-1]


def schemas_read(df):
    import re as regex

    return regex.findall(r"ReadSchema: struct<([^>]*)>", df._jdf.queryExecution().executedPlan().toString())


def test_scan_compares_times_without_reading_texts(spark, tmp_path, monkeypatch):
    corpus(spark, ("a.md", "n", T0), ("b.md", "m", T0)).write.parquet(str(tmp_path / "c"))
    spark.createDataFrame([entry("a.md", "n")], MANIFEST).write.parquet(str(tmp_path / "m"))
    plans = []
    keep = CH.materialize_measured
    monkeypatch.setattr(CH, "materialize_measured", lambda df, name: plans.append(df) or keep(df, name))
    texts, manifest = (spark.read.parquet(str(tmp_path / x)) for x in "cm")
    got = {r.relpath: (r.action, r.hash) for r in CH.scan_corpus(texts, manifest).collect()}
    assert got["a.md"][0] == "unchanged" and got["b.md"][0] == "new" and None not in dict(got.values()).values()
    read = schemas_read(plans[0])
    assert read and not any("text" in schema for schema in read)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_only_listed_rows_by_broadcast_and_by_filter(spark, limit):
    rows = spark.range(5000).selectExpr("concat('p', id) relpath", "id")
    keys = spark.createDataFrame([(f"p{i}",) for i in (3, 700, 4999, 9999)], "relpath string")
    got = CH.only_listed(rows, keys, limit=limit)
    assert sorted(r.id for r in got.collect()) == [3, 700, 4999]
    if not limit:  # few other rows get past the filter
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LeftSemi") == 2


def test_candidates_skip_known_mtimes(spark, tree):
    listing = files.scan_files(spark, str(tree))
    known = listing.filter("relpath = 'readme.md'").select("relpath", F.col("mtime").alias("original_mtime"))
    assert found(CH.file_candidates(listing, known)) == [p for p in found(listing) if p != "readme.md"]


def test_manifest_round_trip(spark, tmp_path):
    path = str(tmp_path / "m")
    assert store.read_manifest(spark, path).count() == 0
    rows = spark.createDataFrame([entry("a.md", "x", count=3)], MANIFEST)
    store.write_manifest(rows, path)
    assert store.read_manifest(spark, path).collect() == rows.collect()


def test_upsert_modes(spark):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "relpath string, n int, s string")
    source = spark.createDataFrame([("b", None), ("c", 3)], "relpath string, n int")
    assert sorted(CH.upsert(target, source).collect()) == [("a", 1, "x"), ("b", None, None), ("c", 3, None)]
    assert sorted(CH.upsert(target, source, mode="merge").collect()) == [("a", 1, "x"), ("b", 2, "y"), ("c", 3, None)]


def test_latest_versions_of_a_hot_path(spark):
    rows = [("hot.md", f"v{i}", T0 + timedelta(seconds=i)) for i in range(300)] + [("b.md", "b", T0)]
    got = {r.relpath: r.text for r in latest_versions(corpus(spark, *rows).repartition(7)).collect()}
    assert got == {"hot.md": "v299", "b.md": "b"}


@pytest.mark.parametrize("enabled, language, has, route", [
    (False, "hu", True, "original"), (True, "hu", True, "translation"),
    (True, "hu", False, "no_translation"), (True, "en", True, "original"), (True, None, True, "original"),
])
def test_routing(spark, enabled, language, has, route):
    docs = spark.createDataFrame([("a.md", "text", language)], "relpath string, text string, language string")
    tr = spark.createDataFrame([("a.md", "translated")] if has else [], "relpath string, text string")
    row = routing.route_text(docs, tr, enabled).first()
    assert row.route == route
    assert row.text == {"original": "text", "translation": "translated", "no_translation": None}[route]


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_attach_text_both_ways(spark, monkeypatch, limit):
    monkeypatch.setattr(routing, "fits_broadcast", lambda df: limit > 0)
    rows = spark.createDataFrame([("a",), ("b",)], "relpath string")
    texts = spark.createDataFrame([("a", "A"), ("c", "C")], "relpath string, text string")
    assert sorted(map(tuple, routing.attach_text(rows, texts).collect())) == [("a", "A", True), ("b", None, False)]


def test_notes(spark):
    notes = spark.createDataFrame(
        [("a line", "dev summary/x", None, None, "t1", T0), ("b", None, "", "bot", None, T0)],
        "content string, title string, session string, agent string, tags string, written_at timestamp",
    )
    got = {r.relpath: r.text for r in render_notes(notes).collect()}
    assert got["knowledge/diary/2024-01-01_000000_dev_summary_x.md"] == (
        "# Diary: dev summary/x\n\n- Date: 2024-01-01_000000 UTC\n- Session: ad-hoc\n- Agent: human\n- Tags: t1\n\n---\n\na line"
    )
    assert "- Agent: bot" in got["knowledge/diary/2024-01-01_000000_session-summary.md"]


# --- search --------------------------------------------------------------------------------


def vectors(spark, n=400, dim=6, copies=0, seed=3):
    """n rows of which ``copies`` hold the same vector."""
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim)).astype(np.float32)
    data[:copies] = data[0]
    rows = [(f"{i:05d}", f"set{i % 3}/f{i}", f"2024-0{1 + i % 9}-01" if i % 5 else "", data[i].tolist()) for i in range(n)]
    return data, spark.createDataFrame(rows, "id string, source_file string, date string, embedding array<float>").repartition(5)


def brute(data, question, k, keep=lambda i: True):
    x = data.astype(float)
    q = question / np.linalg.norm(question)
    cosine = np.round((x @ q) / np.linalg.norm(x, axis=1), 9)
    order = sorted((i for i in range(len(x)) if keep(i)), key=lambda i: (-cosine[i], i))[:k]
    return [f"{i:05d}" for i in order]


def ids(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


def questions(spark, data, picks):
    return spark.createDataFrame([(int(i), data[i].tolist()) for i in picks], "query_id bigint, embedding array<float>")


@pytest.mark.parametrize("copies", [0, 200])
def test_exact_search_with_a_third_or_more_copies(spark, copies):
    data, rows = vectors(spark, copies=copies)
    asked = [0, 7, 250, 399]
    got = ids(SE.nearest(rows, questions(spark, data, asked), 10, payload=["id"]))
    assert got == {i: brute(data, data[i].astype(float), 10) for i in asked}


def test_filters_apply_before_ranking(spark):
    data, rows = vectors(spark)
    got = ids(SE.nearest(rows, questions(spark, data, [5]), 8, "2024-04-01", "set1/", payload=["id"]))
    assert got == {5: brute(data, data[5].astype(float), 8, lambda i: i % 3 == 1 and i % 5 and 1 + i % 9 >= 4)}


def test_more_questions_than_one_pass_holds(spark, monkeypatch):
    data, rows = vectors(spark)
    asked = range(0, 60, 2)
    whole = ids(SE.nearest(rows, questions(spark, data, asked), 5, payload=["id"]))
    monkeypatch.setattr(SE, "QUESTIONS_PER_PASS", 7)
    assert ids(SE.nearest(rows, questions(spark, data, asked), 5, payload=["id"])) == whole
    assert len(whole) == 30


def test_zero_vectors_and_missing_vectors(spark):
    rows = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0]), ("c", None)], "id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    got = [(r.id, r.score) for r in SE.nearest(rows, asked, 5).orderBy("rank").collect()]
    assert got == [("b", 1.0), ("a", 0.5)]


def test_no_questions_no_rows(spark):
    data, rows = vectors(spark, 20)
    none = questions(spark, data, [0]).limit(0)
    assert SE.nearest(rows, none, 5, payload=["id"]).count() == 0
    assert SE.nearest(rows.limit(0), questions(spark, data, [0]), 5, payload=["id"]).count() == 0


def test_inverted_file(spark, tmp_path):
    data, rows = vectors(spark, copies=150)
    centroids = ivf.train_centroids(rows, 8)
    ivf.write_ivf(ivf.build_ivf(rows, centroids), str(tmp_path / "ivf"))
    lists = spark.read.parquet(str(tmp_path / "ivf"))
    assert lists.count() == 400
    asked = questions(spark, data, range(0, 400, 40))
    exact = SE.nearest(rows, asked, 10, payload=["id"])
    every = ivf.search_ivf(lists, asked, centroids, 8, payload=["id"])
    assert ids(every) == ids(exact)
    some = ivf.search_ivf(lists, asked, centroids, 2, payload=["id"])
    assert 0.1 < ivf.recall(some, exact).first().recall <= 1.0
    one = ivf.search_ivf(lists, questions(spark, data, [3]), centroids, 1, payload=["id"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*list_id#\d+ = ", plan)


def test_rank_in_two_steps(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("query_id"), "id", (F.col("id") % 7).alias("score")).repartition(9)
    got = ids(rank_hits(rows, 4))
    assert got == {q: sorted((i for i in range(1000) if i % 3 == q), key=lambda i: (-(i % 7), i))[:4] for q in range(3)}
    plan = rank_hits(rows, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4


def lexical_brute(docs, asked, k):
    split = lambda t: Counter(re.findall(r"[^\W_]+", t.lower()))
    counts = {key: split(t) for key, t in docs.items()}
    df = Counter(w for c in counts.values() for w in c)
    weigh = lambda c: {w: n * (math.log((len(docs) + 1) / (df[w] + 1)) + 1) for w, n in c.items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = {key: weigh(c) for key, c in counts.items()}
    out = {}
    for q, text in asked.items():
        v = weigh(split(text))
        scored = [(-round(sum(x * vectors[d].get(w, 0) for w, x in v.items()) / size(v) / size(vectors[d]), 9), d)
                  for d in docs if any(w in vectors[d] for w in v)]
        out[q] = [d for _, d in sorted(scored)[:k]]
    return {q: h for q, h in out.items() if h}


@pytest.mark.parametrize("limit, rows_of_block", [(0, 1), (1 << 20, 1024), (1 << 20, 7)])
def test_lexical_search_against_brute_force(spark, limit, rows_of_block, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ROWS", rows_of_block)
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["x" * 80]
    docs = {f"d{i:03d}": " ".join(rng.choice(vocabulary[: 5 + i % 56], size=1 + i % 12)) for i in range(150)}
    docs |= {f"e{i:03d}": "the same copy w1" for i in range(80)} | {"long": "x" * 80 + " w2", "none": "--"}
    asked = {1: "w1 w5 W7 unknown", 2: "nothing matches", 3: "copy the w40", 4: "x" * 80}
    rows = spark.createDataFrame(list(docs.items()), "chunk_key string, text string").repartition(4)
    ask = spark.createDataFrame(list(asked.items()), "query_id bigint, question string")
    hits = lexical.lexical_search(rows, ask, 7, broadcast_limit=limit).withColumnRenamed("chunk_key", "id")
    assert ids(hits) == lexical_brute(docs, asked, 7)


def test_a_persisted_index_answers_again_without_texts(spark, tmp_path):
    docs = {"a": "red green", "b": "green blue blue", "c": "", "d": "red red"}
    rows = spark.createDataFrame(list(docs.items()), "chunk_key string, text string")
    lexical.build_postings(rows, str(tmp_path / "p"))
    index = lexical.Postings(spark, str(tmp_path / "p"))
    for asked in ({1: "red"}, {1: "blue green", 2: "absent"}, {}):
        ask = spark.createDataFrame(list(asked.items()), "query_id bigint, question string")
        hits = lexical.search_postings(index, ask, 2)
        assert ids(hits.withColumnRenamed("chunk_key", "id")) == lexical_brute(docs, asked, 2)
    assert index.total() == 4 and {r.term: r.df for r in index.vocabulary.collect()} == {"red": 2, "green": 2, "blue": 1}
    empty = lexical.build_postings(rows.limit(0), str(tmp_path / "e"))
    assert lexical.search_postings(empty, ask).count() == 0


def test_questions_are_cut_into_few_even_passes(spark, monkeypatch):
    asked = spark.range(8193).selectExpr("id query_id", "'q' question")
    parts = SE.question_passes(asked, F.octet_length("question"), 8)
    sizes = [p.count() for p in parts]
    assert len(parts) == 2 and sum(sizes) == 8193 and max(sizes) <= SE.QUESTIONS_PER_PASS
    monkeypatch.setattr(SE, "QUESTIONS_PER_PASS", 100)
    sizes = [p.count() for p in SE.question_passes(asked, F.octet_length("question"), 8)]
    assert sum(sizes) == 8193 and max(sizes) <= 100 and len(sizes) <= 85


def test_codes_find_the_nearest_of_many(spark, tmp_path):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(30, 24))
    data = (centres[draw.integers(0, 30, 3000)] + 0.4 * draw.normal(size=(3000, 24))).astype(np.float32)
    rows = spark.createDataFrame([(f"{i:05d}", v.tolist()) for i, v in enumerate(data)], "id string, embedding array<float>")
    rows = rows.unionByName(spark.createDataFrame([("none", None)], rows.schema))
    quantizer = ivf.train_quantizer(rows, 16, parts=5, sample_rows=1000)  # 24 dimensions in five parts
    ivf.write_ivf(ivf.build_quantized(rows, quantizer), str(tmp_path / "q"))
    lists = spark.read.parquet(str(tmp_path / "q"))
    asked = spark.createDataFrame([(i, data[i].tolist()) for i in range(0, 3000, 100)], "query_id int, embedding array<float>")
    exact = SE.nearest(rows, asked, 5, payload=["id"])
    some = ivf.search_quantized(lists, asked, quantizer, 5, 5, refine=40)
    assert ivf.recall(some, exact).first().recall > 0.85
    every = ivf.search_quantized(lists, asked, quantizer, 16, 5, refine=600)
    assert ids(every) == ids(exact)
    assert lists.count() == 3000 and ivf.search_quantized(lists, asked.limit(0), quantizer, 5, 5).count() == 0


def test_search_modes_and_full_text(spark):
    data, rows = vectors(spark)
    table = rows.withColumn("section", F.lit("s")).withColumn("language", F.lit("en")).withColumn(
        "content_preview", F.lit("p")).withColumn("text", F.concat(F.lit("t"), "id"))
    asked = questions(spark, data, [9])
    post = SE.search(table, asked, 10, path_filter="set0/", filter_mode="post").collect()
    unfiltered = brute(data, data[9].astype(float), 10)
    assert [r.id for r in sorted(post, key=lambda r: r.rank)] == [i for i in unfiltered if int(i) % 3 == 0]
    assert [r.rank for r in sorted(post, key=lambda r: r.rank)] == list(range(1, len(post) + 1))
    assert all(r.full_text == "t" + r.id for r in SE.search(table, asked, 3, full=True).collect())
    pushed = SE.search(table, asked, 3, after="2024-05-01")._jdf.queryExecution().optimizedPlan().toString()
    assert "2024-05-01" in pushed


def test_hash_embedding_is_unit_and_stable(spark):
    frame = spark.createDataFrame([("a", "one two two"), ("b", ""), ("c", None)], "id string, text string")
    got = {r.id: r.embedding for r in embed(frame, "text", HashEmbedder(16)).collect()}
    assert np.isclose(np.linalg.norm(got["a"]), 1) and not any(got["b"]) and got["c"] is None


def test_index_results_of_odd_texts(spark):
    texts = corpus(spark, ("blank.md", " \n", T0), ("comment.md", "<!-- x -->", T0), ("ok.md", "body", T0))
    manifest = spark.createDataFrame(
        [entry(p, "x", status="pending_index") for p in ("blank.md", "comment.md", "ok.md", "lost.md")]
        + [entry("old.md", "x", status="deleted")], MANIFEST)
    stored = spark.createDataFrame([], store.CHUNKS)
    done = IX.index_pending(manifest, texts, stored)
    got = {r.relpath: (r.status, r.chunk_count, r.error) for r in done.manifest.collect()}
    assert got == {
        "blank.md": ("error", None, "empty_file"), "comment.md": ("error", None, "no_chunks"),
        "lost.md": ("error", None, "file_not_found"), "ok.md": ("indexed", 1, None),
    }
    assert done.summary.first().asDict() == dict(indexed=1, skipped=0, errors=3, deleted=1)


def test_date_filter_reaches_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01"), ("b", None), ("c", "2023-01-01")], "id string, date string")
    rows.write.parquet(str(tmp_path / "t"))
    kept = SE.filter_after(spark.read.parquet(str(tmp_path / "t")), "2024-01-01")
    assert "GreaterThanOrEqual(date,2024-01-01)" in kept._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in kept.collect()] == ["a"]


def test_a_word_is_hashed_once_over_batches(monkeypatch):
    import hashlib

    from lorespan.operators import embed as E

    texts = [np.array([f"one two w{i} ", "", "two two"], dtype=object) for i in range(5)]
    seen, md5 = [], hashlib.md5
    monkeypatch.setattr(E.hashlib, "md5", lambda w: seen.append(w) or md5(w))
    model = HashEmbedder(16).make_predict_fn()
    many = [model(t) for t in texts]
    assert len(seen) == len(set(seen)) == 7
    monkeypatch.setattr(E._WordPlaces, "LIMIT", 2)
    model = HashEmbedder(16).make_predict_fn()
    assert all((model(t) == m).all() for t, m in zip(texts, many))


@pytest.mark.parametrize("step", ["embed", "write_tree", "signatures", "count_terms"])
def test_texts_reach_a_worker_in_small_batches(spark, tmp_path, step):
    import pyarrow as pa

    from lorespan.llm import neardup
    from lorespan.session import BATCH_BYTES

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(0, 2000, 1, 1).select(
        F.col("id").cast("string").alias("relpath"), F.repeat(F.lit("some words "), 1000).alias("text"))

    def largest(batches):
        yield pa.RecordBatch.from_pydict({"n": [max(b.nbytes for b in batches)]})

    spark.conf.unset(name)
    {
        "embed": lambda: embed(rows, "text", HashEmbedder(4)),
        "write_tree": lambda: files.write_tree(rows.limit(3), str(tmp_path / "tree")),
        "signatures": lambda: neardup.signatures(rows, 4, "relpath", "text"),
        "count_terms": lambda: lexical.count_terms(rows, "relpath", "text"),
    }[step]()
    assert rows.mapInArrow(largest, "n bigint").first().n < 2 * BATCH_BYTES
    spark.conf.set(name, "32m")
    embed(rows, "text", HashEmbedder(4))
    assert spark.conf.get(name) == "32m"
    spark.conf.unset(name)


def test_an_index_of_some_terms_answers_like_the_whole(spark, tmp_path):
    docs = {"a": "red green", "b": "green blue blue", "c": "", "d": "red red only"}
    rows = spark.createDataFrame(list(docs.items()), "chunk_key string, text string")
    asked = {1: "red blue", 2: "absent"}
    ask = spark.createDataFrame(list(asked.items()), "query_id bigint, question string")
    terms = spark.createDataFrame([("red",), ("blue",), ("absent",)], "term string")
    index = lexical.build_postings(rows, str(tmp_path / "p"), terms=terms)
    assert {r.term for r in index.postings.collect()} == {"red", "blue"}
    assert {r.term: r.df for r in index.vocabulary.collect()} == {"red": 2, "green": 2, "blue": 1, "only": 1}
    hits = lexical.search_postings(index, ask, 3)
    assert ids(hits.withColumnRenamed("chunk_key", "id")) == lexical_brute(docs, asked, 3)
