"""Nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import corpus_pipeline
import pytest

from lorespan.llm import archives, decontam, layout, licenses, lm, neardup, packing, quality, secrets, tokenfiles
from lorespan.llm.queries import tokenizer_path

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, license string, k int, start bigint, "
    "spans string, fail_bits bigint, doc string, key string, a string, b string"
)
LONG = " ".join(f"w{i}" for i in range(30_000))
TEXTS = [(1, None), (2, ""), (3, " \n "), (4, LONG), (4, LONG), (5, LONG), (None, LONG + " x"), (6, "One two three")]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "en", None, 1, "l", 1, 1, "s", 1, "d", "k", "a", "b") for i, t in texts], SCHEMA)


def notices(spark):
    return licenses.notices(spark)


def bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "one two three")], "item_id bigint, text string")


RUNS = {
    "quality": lambda s, d: quality.judge(d),
    "licenses": lambda s, d: licenses.scan(d, notices(s)),
    "decontam": lambda s, d: decontam.hits(d, bench(s)),
    "neardup": lambda s, d: neardup.groups(d),
    "dedup": lambda s, d: neardup.dedup(d),
    "secrets": lambda s, d: secrets.secrets(d),
    "mask": lambda s, d: secrets.mask(d),
    "packing": lambda s, d: packing.pack(d, tokenizer_path("word_bpe_49k.json")),
    "tokenfiles": lambda s, d: tokenfiles.read(tokenfiles.write(d, tokenizer_path("byte_bpe_50k.json"))),
    "lm": lambda s, d: lm.scores(d),
    "layout": lambda s, d: layout.extract(d, "text"),
}
COUNTS = {"licenses": 0, "dedup": 6, "packing": None}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_and_empty_tables(spark, name):
    held = docs(spark)
    rows = RUNS[name](spark, held).collect()
    want = COUNTS.get(name, len(TEXTS))
    assert want is None or len(rows) == want
    assert RUNS[name](spark, held.limit(0)).count() == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_keep_columns(spark, sf, stage):
    held = docs(spark)
    for some in (held, held.limit(0)):
        out = stage[1](spark, some, sf)
        assert out.columns == held.columns
        out.collect()


ODD_NAMES = ["N_WORDS", "a.b", "__ident", "__live_ident", "__runs", "__drop", "__row", "__settled", "live", "License", "N_CHARS",
             "doc", "gone", "key", "hub", "id", "HIT_SPANS", "Kept", "owner", "words", "a`b", "-"]
TAKEN = {"N_WORDS", "N_CHARS", "License", "HIT_SPANS", "Kept"}  # columns that some operator makes


def odd_table(spark):
    rows = [(i, t, "en", f"o{i}", *range(len(ODD_NAMES))) for i, t in ((1, "password=Zx9Qw7Er5Ty3Ui1 " + "a b c d e f g " * 30), (2, None), (2, None), (3, LONG))]
    names = ["doc_id", "text", "lang", "source", *ODD_NAMES]
    kinds = ["bigint", "string", "string", "string"] + ["int"] * len(ODD_NAMES)
    return spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in zip(names, kinds)))


@pytest.mark.parametrize("name", [n for n in RUNS if n != "packing"])
def test_odd_names_neither_clash_nor_vanish(spark, name):
    held = odd_table(spark)
    out = RUNS[name](spark, held)
    rows = out.collect()
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    if name in ("quality", "licenses", "decontam", "layout"):  # these pass other columns through
        assert set(held.columns) - TAKEN - {"text"} <= set(out.columns)
        assert all(r["a.b"] == ODD_NAMES.index("a.b") and r["__ident"] == ODD_NAMES.index("__ident") for r in rows)
    if name in ("dedup", "mask"):
        assert out.columns == held.columns and all(r["-"] == ODD_NAMES.index("-") for r in rows)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_odd_names(spark, sf, stage):
    held = odd_table(spark)
    out = stage[1](spark, held, sf)
    out.collect()
    assert stage[0] == "packing" or out.columns == held.columns


def test_near_documents_that_do_not_link_are_not_compared(spark, monkeypatch):
    """Documents that share 70 % of their words: candidates stay in proportion to their number."""
    counted, confirmed = [], neardup.confirmed
    monkeypatch.setattr(neardup, "confirmed", lambda pairs, *a: counted.append(pairs.count()) or confirmed(pairs, *a))
    texts = []
    for i in range(120):
        words = [f"b{j}" for j in range(200)]
        cut = (i * 37) % 140
        words[cut : cut + 60] = [f"x{i}_{j}" for j in range(60)]
        texts.append((i, " ".join(words)))
    texts += [(1000, texts[5][1].replace("b199", "other")), (1001, texts[5][1])]
    rows = {r.doc_id: r.component_id for r in neardup.groups(docs(spark, texts)).collect()}
    assert rows.pop(1000) == 5 and rows.pop(1001) == 5 and all(i == c for i, c in rows.items())
    assert sum(counted) < 10 * len(texts)


def test_chains_of_near_copies_are_one_group(spark):
    """Each text links with the next only, so no hub meets all."""
    texts = [(i, " ".join(f"w{j}" for j in range(8 * i, 8 * i + 100))) for i in range(40)]
    texts += [(99, texts[3][1]), (99, texts[3][1])]
    rows = {r.doc_id: r.component_id for r in neardup.groups(docs(spark, texts)).collect()}
    assert set(rows.values()) == {0}


def test_one_owner_with_many_repositories(spark):
    value = "password=Zx9Qw7Er5Ty3Ui1"
    rows = [(i, value, "owner") for i in range(secrets.REUSED_REPOS)] + [(1000, "token=Lk8Jh6Gf4Ds2Aq0", "owner")]
    held = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.doc_id: r for r in secrets.secrets(held).collect()}
    assert (found[0].n_live, found[0].n_reused, found[0].holders) == (0, 1, f"{secrets.REUSED_REPOS}:1")
    assert (found[1000].n_live, found[1000].n_reused, found[1000].holders) == (1, 0, "1:1")
    assert all(r.text == "[SECRET]" for r in secrets.mask(held).collect())


def test_archives_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", "é" * 600), (3, "v", "é" * 600), (4, "w", "")], "page_id bigint, url string, html string")
    rows = {r.page_id: r for r in archives.read_warc(archives.convert(archives.write_arc(pages))).collect()}
    assert [rows[i].record_type for i in (1, 2, 3, 4)] == ["response", "revisit", "response", "response"]
    assert rows[2].refers_to == 3 and rows[2].payload_bytes == 1200 and rows[3].refers_to is None
    assert archives.read_warc(archives.convert(archives.write_arc(pages.limit(0)))).count() == 0


def test_near_copies_form_groups(spark):
    base = [f"w{i}" for i in range(300)]
    near = base[:150] + ["other"] + base[151:]
    texts = [(i, " ".join(base)) for i in range(10, 60)] + [(i, " ".join(near)) for i in range(60, 90)] + [(5, LONG)]
    rows = {r.doc_id: r.component_id for r in neardup.groups(docs(spark, texts)).collect()}
    assert rows.pop(5) == 5 and set(rows.values()) == {10}
    assert sorted(r.doc_id for r in neardup.dedup(docs(spark, texts)).collect()) == [5, 10]


def test_license_wordings_and_near_wordings(spark):
    apache = licenses.NOTICES[3][1]
    changed = apache.replace("in compliance", "in full compliance")
    texts = [(1, f"{LONG} {apache.upper()} {LONG}"), (2, changed), (3, "Licensed under the sea"), (4, "x all rights reserved y"), (5, apache[:60])]
    rows = {(r.doc_id, r.license): r for r in licenses.scan(docs(spark, texts), licenses.notices(spark)).collect()}
    assert set(rows) == {(1, "Apache-2.0"), (2, "Apache-2.0"), (4, "all-rights-reserved"), (5, "Apache-2.0")}
    assert rows[1, "Apache-2.0"].n_shared == rows[1, "Apache-2.0"].n_shingles
    assert rows[1, "Apache-2.0"].start_word <= 30_000 < rows[1, "Apache-2.0"].start_word + 9


def test_license_cues_lose_nothing(spark, monkeypatch):
    texts = [(i, " ".join(["a"] * i + [t])) for i, (_, t) in enumerate(licenses.NOTICES)]
    with_cues = licenses.scan(docs(spark, texts), licenses.notices(spark)).drop("text").collect()
    monkeypatch.setattr(licenses, "CUE_BYTES", -1)
    assert sorted(with_cues) == sorted(licenses.scan(docs(spark, texts), licenses.notices(spark)).collect())


def test_layout_of_lists_tables_and_hidden_parts():
    page = """<title>no</title>Hi <b>there</b><p>one<p>two<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>
<table><caption>Cap<tr><th>Name<th>N<tr><td>longer name<td>12<tr><td rowspan=2>r<td>1<tr><td>2</table>
<div hidden>no</div><div style="Display : none">no</div><script>no</script><pre> x
   y</pre><details><summary>S</summary>no</details>a &amp; b<br>c < d"""
    assert layout.render(page) == (
        "Hi there\n\none\n\ntwo\n\n- a\n- b\n  3. c\n  4. d\n\nCap\nName         N\nlonger name  12\n"
        "r            1\n             2\n\n x\n   y\n\nS\na & b\nc < d"
    )


@pytest.mark.parametrize("part", ["<div>", "<p>x", "<table><tr><td colspan=1000>a", "<a href='", "<!--", "<li>", "</p>"])
def test_layout_of_broken_pages_ends(part):
    layout.render(part * 20_000)


def test_ablations_count_each_rule(spark):
    book = quality.ledger(docs(spark, [(1, "one two"), (2, "a b c d e f g h i j " * 30), (3, LONG)]))
    rows = {(r.policy, r.rule): r for r in quality.ablations(book).collect()}
    few, repeated = rows["base", "few_words"], rows["base", "repeated_windows"]
    assert (few.n_docs, few.n_fail, few.n_only, few.n_kept, few.n_kept_without) == (3, 1, 1, 1, 2)
    assert (repeated.n_fail, repeated.n_kept_without) == (1, 2)


def test_copied_examples_differ_from_live_secrets(spark):
    shared, own = "password=Zx9Qw7Er5Ty3Ui1", "password=Lk8Jh6Gf4Ds2Aq0"
    rows = [(i, shared, f"owner{i}") for i in range(4)] + [(9, own, "owner9")]
    held = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.doc_id: (r.n_live, r.n_example) for r in secrets.secrets(held).collect()}
    assert found == {**{i: (0, 1) for i in range(4)}, 9: (1, 0)}
    texts = {r.doc_id: r.text for r in secrets.mask(held).collect()}
    assert texts[0] == shared and own not in texts[9]


def test_spans_are_removed(spark):
    items = spark.createDataFrame([(1, "red green blue")], "item_id bigint, text string")
    out = decontam.remove_spans(docs(spark, [(1, "A red, Green; BLUE b")]), items).collect()[0].text
    assert "red" not in out and "BLUE" not in out and out.startswith("A ") and out.endswith(" b")
