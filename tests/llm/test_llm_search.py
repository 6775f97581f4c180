"""Vector search, ranked search and spelling variants: brute force, ties, copies and odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lorespan.llm import ranked, spelling, vectors
from lorespan.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VECTORS = "vec_id bigint, embedding array<double>, q int, h int, lower string, part int, a_b string"


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3, "y") for i, v in rows], VECTORS)


def nearest(rows, every, k):
    """Brute force over distinct rows."""
    held = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(
        x is not None and math.isfinite(x) for x in v)}
    out = []
    for i in sorted({i for i, _ in held if i % every == 0}):
        mine = min(v for j, v in held if j == i)
        scored = [(-sum(a * b for a, b in zip(mine, v)), j) for j, v in held if j != i and len(v) == len(mine)]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return out


def searched(spark, rows, every=5, k=3, **options):
    table = vector_table(spark, rows)
    hits = vectors.search(table, table.where(f"vec_id % {every} = 0"), k, **options)
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in hits.collect())


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_neighbours_are_exact_whatever_the_cells(spark, bits, monkeypatch):
    monkeypatch.setattr(vectors, "QUESTIONS_PER_GROUP", 7)
    monkeypatch.setattr(vectors, "ROWS_PER_CHUNK", 50)
    monkeypatch.setattr(vectors, "SCORES", 100)
    draw = np.random.default_rng(bits)
    rows = [(i, list(map(float, draw.normal(0, 1 if i % 7 else 30, 6)))) for i in range(200)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        spark.conf.set(size, 9)  # a tile is more than one batch
        assert searched(spark, rows, bits=bits) == nearest(rows, 5, 3)
    finally:
        spark.conf.unset(size)


def test_neighbours_among_copies_and_odd_rows(spark):
    same = [0.5, -0.25, 1.0]
    rows = [(i, same) for i in range(100)] + [(i, same) for i in range(0, 100, 3)]  # copies, and rows repeated
    rows += [(200, None), (205, []), (210, [None, 1.0, 1.0]), (215, [math.nan, 1.0, 1.0]), (220, [math.inf, 1.0, 1.0])]
    rows += [(None, same), (225, [1.0]), (226, [2.0]), (230, [60_000.0, -60_000.0, 1e-9]), (10, [3.0, 3.0, 3.0])]
    got = searched(spark, rows)
    assert got == nearest(rows, 5, 3)
    assert [r[2] for r in got if r[0] == 0] == [230, 10, 1]  # ties go to the smaller id, and no row finds itself
    assert [r[2] for r in got if r[0] == 225] == [226]


def test_no_vectors_no_neighbours(spark):
    assert searched(spark, []) == [] and searched(spark, [(5, [1.0])]) == []


def test_component_bounds_hold_every_vector(spark):
    draw = np.random.default_rng(1)
    table = vector_table(spark, [(i, list(map(float, draw.normal(0, 1, 4)))) for i in range(50)])
    rows = vectors.integers(table, "vec_id", "embedding").selectExpr("*", "xxhash64(q) h")
    low, width = vectors.cell_ranges(rows, 4)[4]
    exact = {r.id: np.array(r.q) for r in rows.collect()}
    for r in vectors.approximations(rows, {4: (low, width)}).collect():
        first = low + np.frombuffer(r.cells, np.uint8).astype(int) * width
        assert (first <= exact[r.id]).all() and (exact[r.id] < first + width).all()


DOCS = "doc_id bigint, text string, term string, item_id int, score int, rank int"


def doc_table(spark, rows):
    return spark.createDataFrame([(i, t, "t", 1, 2, 3) for i, t in rows], DOCS)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def best(docs, items, k):
    held = [(i, terms(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, w in held:
            if i is None or not w:
                continue
            tf, m = Counter(w), 50 + 50 * len(w) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m))
                for t in wanted if tf[t]
            )
            scored += [(-score, i)] * (score > 0)
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


ODD = [(1, None), (2, ""), (3, " \n-"), (4, "Élan é É2 a_b"), (5, "red " * 5000 + "green"), (6, "Red,green;BLUE"),
       (6, "Red,green;BLUE"), (None, "green"), (7, "x\x00green\x7fred é"), (8, "redgreen"), (9, "Red,green;BLUE")]
ITEMS = [(1, "red GREEN"), (2, "é élan"), (3, None), (4, ""), (None, "red"), (1, "blue"), (5, "absent a b")]


@pytest.mark.parametrize("size", [ranked.AUTOMATON_BYTES, 8])
def test_ranked_documents_equal_brute_force(spark, size):
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id bigint, text string, doc_id int")
    for k in (2, 50):
        rows = ranked.search(doc_table(spark, ODD), items, k, automaton_bytes=size).collect()
        assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in rows) == best(ODD, ITEMS, k)


def test_many_equal_documents_rank_by_id(spark, monkeypatch):
    monkeypatch.setattr(ranked, "DOCS_AT_ONCE", 7)
    docs = [(i, "one two three") for i in range(500, 0, -1)] + [(1000, "four")]
    items = spark.createDataFrame([(1, "two four")], "item_id bigint, text string")
    rows = ranked.search(doc_table(spark, docs), items, 5).collect()
    assert sorted((r["rank"], r.doc_id) for r in rows) == [(1, 1000), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_nothing_to_rank(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert ranked.search(doc_table(spark, []), items).count() == 0
    assert ranked.search(doc_table(spark, ODD), items.limit(0)).count() == 0
    assert ranked.search(doc_table(spark, [(1, None)]), items).count() == 0


def test_only_whole_terms_match():
    scan = ranked.TermScan([b"ab", b"b", "é".encode()])
    lengths, text, term, tf = scan.counts(["AB b ab-ab abb", None, "é eé É"])
    assert lengths.tolist() == [5, 0, 3]
    assert list(zip(text, term, tf)) == [(0, 0, 3), (0, 1, 1), (2, 2, 1)]


def slipped(doc_id, run):
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run


def variants(docs):
    c = Counter(
        w for i, t in docs for r in re.findall("[A-Za-zÀ-ÿ]+", t or "") if len(w := slipped(i, r.translate(LOWER))) >= 7
    )
    n = {w: x for w, x in c.items() if x >= 2}
    patterns: dict = {}
    for w in n:
        for k in range(len(w)):
            patterns.setdefault((k, w[:k], w[k + 1 :]), []).append(w)
    near = {w: set() for w in n}
    for group in patterns.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    for w in n:
        for x in {w[:k] + w[k + 1 :] for k in range(len(w))} & n.keys():
            near[w].add(x)
            near[x].add(w)
    form = {}
    for w in n:
        top = min(near[w], key=lambda x: (-n[x], x), default=None)
        if top and n[top] >= 10 * n[w]:
            form[w] = top
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out)


def found(spark, docs):
    names = ("word", "form", "root", "n", "n_near", "form_n")
    return sorted(tuple(r[c] for c in names) for r in spelling.variants(doc_table(spark, docs)).collect())


def test_variants_equal_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op13_spelling_variants"](spark, sf).collect()
    names = ("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(tuple(r[c] for c in names) for r in rows) == variants(docs)


def test_variants_by_every_kind_of_edit(spark):
    base = "abcdefghij"
    edits = {base, "abcdefghijj", "aabcdefghij", "bcdefghij", "abcdefghi", "xbcdefghij", "abcdefghix", "abcdxfghij",
             "abcdeefghij", "abcdfghij", "abcdeghij", "zzzzzzz", "zzzzzzzz", "zzzzzzzzz", "abcdéfghij", "ÿabcdefghij",
             "abcdefgxyz", "bacdefghij"}
    docs = [(i, " ".join([w, w.upper()])) for i, w in enumerate(sorted(edits))]
    docs += [(100 + i, "Abcdefghij,") for i in range(30)] + [(None, base), (None, None), (7, ""), (8, "short é 123")]
    docs += [(200 + i, "abcdefghij abcdxfghij") for i in range(3)] * 2  # repeated rows count again
    assert found(spark, docs) == variants(docs)
    assert found(spark, []) == []


@pytest.mark.parametrize("size", [63, 64, 65, 3000])
def test_variants_of_very_long_words(spark, size):
    word = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(size))
    texts = [word, word + "x", word[:-1], word[: size // 2] + "é" + word[size // 2 :], "q" + word[1:], word[1:], word[2:]]
    docs = [(10 * i + j, t) for i, t in enumerate(texts) for j in range(2 + 30 * (i == 0))]
    assert found(spark, docs) == variants(docs)


def test_forms_are_followed_to_the_last(spark):
    chain = [("aaaaaaaa", 1000), ("aaaaaaab", 100), ("aaaaaabb", 10), ("aaaaabbb", 2)]
    links = spark.createDataFrame([(b, a) for (a, _), (b, _) in zip(chain, chain[1:])] + [("x", None)], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(links).collect()} == {w: "aaaaaaaa" for w, _ in chain[1:]}
