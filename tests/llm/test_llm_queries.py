"""Each registered query beside its SQL, or beside a brute-force version."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import check
import corpus_pipeline
from lorespan.llm import packing, secrets, tokenfiles, tokens
from lorespan.llm.queries import ORACLES, QUERIES, tokenizer_path

NO_SQL = {"op1_packing", "op4_layout_text", "op5_secrets", "op6_token_files", "op8_lm_scores", "op13_spelling_variants"}


def table(sf, name, columns):
    return duckdb.sql(f"select {columns} from '{sf}/{name}.parquet'").fetchall()


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) - set(ORACLES) == NO_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), db.sql(ORACLES[name]).df()
    assert check.normal(got) == check.normal(want)


def token_ids(sf, file, end):
    tok = Tokenizer.from_file(tokenizer_path(file))
    return {
        i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [end], "<u4")
        for i, t in table(sf, "documents", "doc_id, text")
    }


def test_packing_holds_every_id_once(spark, sf):
    ids, rows = token_ids(sf, "word_bpe_49k.json", 1), QUERIES["op1_packing"](spark, sf).collect()
    at, ends = Counter(), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert at[r.doc_id] == r.start and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    assert at == Counter({i: len(x) for i, x in ids.items()})
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in ends.values())
    assert padded <= 2048 * spark.sparkContext.defaultParallelism


def test_token_files_hold_every_document(spark, sf):
    at = 0
    ids = token_ids(sf, "byte_bpe_50k.json", 0)
    for r in sorted(QUERIES["op6_token_files"](spark, sf).collect()):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
        at += r.n_tokens
    assert at == sum(map(len, ids.values()))


def test_a_document_is_read_from_its_file_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id = 7"))  # one id twice
    files = tokenfiles.write(docs, tokenizer_path("byte_bpe_50k.json")).collect()
    ids = token_ids(sf, "byte_bpe_50k.json", 0)
    for doc in (0, 7, 11):
        held = [x for f in files if f.first_doc <= doc <= f.last_doc for x in tokenfiles.TokenFile(f.path).get(doc)]
        assert len(held) == 1 + (doc == 7) and all(np.array_equal(x, ids[doc]) for x in held)
    assert tokenfiles.TokenFile(files[0].path).get(10**12) == []


def test_a_wrong_dictionary_is_noticed(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    path = tokenfiles.write(docs, tokenizer_path("byte_bpe_50k.json")).first().path
    fs, name = tokenfiles.file_system(path)
    digest = fs.open_input_file(name).read_at(32, 8).hex()
    with fs.open_output_stream(f"{name.rpartition('/')[0]}/{digest}.dictionary") as out:
        out.write(b"something else")
    with pytest.raises(ValueError, match="dictionary"):
        tokenfiles.TokenFile(path)


BITS = ["<|endoftext|>", "<|startoftext|>", " ", "  ", "\n", "\n\n", "\t", " a", "é", "ß", "word", "12", "'s", "\xa0", "\u3000",
        "\r\n", "x<|endoftext|>y", "日本", "😀", "\x1c", "\x85", ".", "A", "İ"]


@pytest.mark.parametrize("file, spaces", [("word_bpe_49k.json", "drop"), ("byte_bpe_50k.json", "keep")])
def test_pieces_give_the_ids_of_whole_texts(file, spaces, monkeypatch):
    monkeypatch.setattr(tokens, "PIECES", 300)  # forgotten and learned again and again
    draw = np.random.default_rng(5)
    texts = ["".join(draw.choice(BITS, draw.integers(0, 12))) for _ in range(3000)]
    whole, encoder = Tokenizer.from_file(tokenizer_path(file)), tokens.Encoder(tokenizer_path(file), spaces)
    for i in range(0, len(texts), 100):
        for text, ids in zip(texts[i : i + 100], encoder.encode(texts[i : i + 100])):
            assert whole.encode(text, add_special_tokens=False).ids == ids.tolist(), text
    assert len(encoder.index) < 1000


MORE = ["'", "'re", "'LL", ",", "Ünder", "ÀÈ", "×", "\u0301", "\u0338", "J\u030c", "—", "\u2003", "\u200b", "\x00", "\x7f", "٣", "5", "œ", "Σ",
        "K", "\u2028", "\v", "привет", "ſ", "’", " '", "Þ", "ÿ", "-", "<"]
FILES = [("word_bpe_49k.json", "drop"), ("byte_bpe_50k.json", "keep")]


def same_as_whole(path, encoder, seed):
    whole, draw = Tokenizer.from_file(path), np.random.default_rng(seed)
    for _ in range(100):
        some = draw.choice([*BITS, *MORE], draw.integers(1, len(BITS)), replace=False)
        texts = ["".join(draw.choice(some, draw.integers(0, 14))) for _ in range(50)]
        for text, ids in zip(texts, encoder.encode(texts)):
            assert whole.encode(text, add_special_tokens=False).ids == ids.tolist(), text


@pytest.mark.parametrize("file, spaces", FILES)
def test_runs_of_letters_are_learned_once(file, spaces):
    """Signs around a word and, where case is dropped, its case make no new piece; words go to the model alone."""
    encoder, learned = tokens.Encoder(tokenizer_path(file), spaces), []
    by_whole = encoder._whole
    encoder._whole = lambda part: learned.extend(part) or by_whole(part)
    words, signs = ["thention", "Erst", "erst", "ciónes", "ÜBER", "über"], [".", ",", "###", "!?", "***", ");", "%%%"]
    text = " ".join(a + w + b for w in words for a in ["", *signs] for b in ["", *signs])
    assert encoder.encode([text])[0].tolist() == Tokenizer.from_file(tokenizer_path(file)).encode(text, add_special_tokens=False).ids
    assert len(encoder.index) <= 2 * (len(words) + len(signs))
    assert learned and not any(c.isalpha() for p in learned for c in p.decode())


@pytest.mark.parametrize("file, spaces", FILES)
def test_runs_give_the_ids_of_whole_texts(file, spaces):
    same_as_whole(tokenizer_path(file), tokens.Encoder(tokenizer_path(file), spaces), 6)


def test_bytes_that_are_no_text_are_refused():
    encoder = tokens.Encoder(tokenizer_path("byte_bpe_50k.json"), "keep")
    with pytest.raises(pa.ArrowInvalid):
        list(tokens.finished(encoder, pa.array([b"one", b"two \xc3a"]).view(pa.string()), 0))
    assert [len(x) for x in tokens.finished(encoder, pa.array(["one", None, ""], pa.string()), 0)] == [2, 1, 1]


@pytest.mark.parametrize("file, spaces", FILES)
def test_other_tokenizers_are_cut_at_white_space_alone(file, spaces, tmp_path):
    """An added token of letters would be hidden in a word, and another pattern may join runs."""
    config = json.loads(open(tokenizer_path(file), encoding="utf-8").read())
    config["added_tokens"].append({**config["added_tokens"][0], "id": 60_000, "content": "word"})
    letters = tmp_path / "letters.json"
    letters.write_text(json.dumps(config), encoding="utf-8")
    config["added_tokens"].pop()
    joined = {"type": "Split", "pattern": {"Regex": r"\s?\S+|\s+"}, "behavior": "Isolated", "invert": False}
    config["normalizer"] = None
    config["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [joined, {**tokens.BYTE_LEVEL, "use_regex": False, "trim_offsets": True}]}
    if spaces == "drop":
        config["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, config["pre_tokenizer"]["pretokenizers"][1]]}
    pattern = tmp_path / "pattern.json"
    pattern.write_text(json.dumps(config), encoding="utf-8")
    for path in (letters, pattern):
        encoder = tokens.Encoder(str(path), spaces)
        assert encoder.widths is None
        same_as_whole(str(path), encoder, 7)


def test_tiers_and_groups_of_packed_windows(spark):
    words = [" ".join(["w"] * n) for n in (5, 100, 300, 700, 1500, 2500, 5000)] * 40
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id bigint, text string").coalesce(1)
    rows = packing.pack(docs, tokenizer_path("word_bpe_49k.json")).collect()
    filled, tier, group = Counter(), {}, {}
    for r in rows:
        filled[r.sequence_id] += r.length
        assert tier.setdefault(r.sequence_id, r.tier) == r.tier and group.setdefault(r.sequence_id, r.step_group) == r.step_group
        assert len(r.ids) == r.length
    assert set(tier.values()) <= set(packing.TIERS) and len(set(tier.values())) > 1
    last = max(group.values())
    assert all(n == tier[s] for s, n in filled.items() if group[s] != last)  # full but for the last group
    of_group = Counter()
    for s, n in filled.items():
        of_group[group[s]] += n
    assert {n for g, n in of_group.items() if g != last} == {packing.UNITS_PER_GROUP * packing.TIERS[-1]}


def base_spans(text):
    kinds = (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", r"[0-9a-f]+", 0, 16),
    )
    found = [
        (m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(kinds) for m in re.finditer(p, text) if len(m[g]) >= n
    ]
    return [f"{kinds[k][0]}:{s}:{e}" for s, k, e in sorted(found)]


def test_secrets_hold_the_base(spark, sf):
    texts = dict(table(sf, "documents", "doc_id, text"))
    rows = QUERIES["op5_secrets"](spark, sf).collect()
    assert len(rows) == len(texts) and any(r.spans for r in rows)
    for r in rows:
        base = base_spans(texts[r.doc_id] or "")
        kinds = Counter(x.split(":")[0] for x in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("token:")] == base


def secret_rows(docs):
    """Brute force over (doc_id, text, owner): spans, holders, live, reused and example counts."""
    held, owners, repos = [], {}, {}
    for i, text, owner in docs:
        found = [(m.start(), 0, m.end(), m[2]) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 12]
        found += [(m.start(), 1, m.end(), m[0]) for m in secrets.ACCESS.finditer(text) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]{16,}", text)]
        base = list(found)
        for m in re.finditer(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}", text):
            mixed = all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))
            if mixed and not any(s < m.end() and e > m.start() for s, _, e, _ in base):
                found.append((m.start(), 3, m.end(), m[0]))
        held.append((i, sorted(found)))
        for *_, value in found:
            owners.setdefault(value, set()).add(owner)
            repos.setdefault(value, set()).add(i)
    out = {}
    for i, found in held:
        spans, counts = [], Counter()
        for s, k, e, v in found:
            n, example = len(repos[v]), len(owners[v] - {None}) >= secrets.EXAMPLE_OWNERS
            secret = not example and secrets.looks_random(v)
            kind = "example" if example else "reused" if secret and n >= secrets.REUSED_REPOS else "live" if secret else "plain"
            if k < 3 or secret:
                spans.append((f"{secrets.KINDS[k]}:{s}:{e}", f"{n}:{len(owners[v] - {None})}"))
                counts[kind] += 1
        out[i] = (",".join(a for a, _ in spans), ",".join(b for _, b in spans), counts["live"], counts["reused"], counts["example"])
    return out


def test_secret_classes_equal_brute_force(spark, sf):
    docs = [(i, t or "", o) for i, t, o in table(sf, "documents", "doc_id, text, source")]
    rows = QUERIES["op5_secrets"](spark, sf).collect()
    want = secret_rows(docs)
    assert {r.doc_id: (r.spans, r.holders, r.n_live, r.n_reused, r.n_example) for r in rows} == want
    assert sum(x[2] for x in want.values()) > 0


def test_lm_base_and_held_out_score(spark, sf):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {
        i: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(lower)) if w] + [None]
        for i, t in table(sf, "documents", "doc_id, text")
    }
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = QUERIES["op8_lm_scores"](spark, sf).collect()
    for r in rows:
        ws = tokens[r.doc_id]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


class Words(HTMLParser):
    """Text outside of what the pages of the table hide."""

    def __init__(self):
        super().__init__()
        self.text, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("title", "style", "script")
        self.text.append(" " if tag in ("p", "br", "li", "div", "h1", "article", "nav", "ul", "footer") else "")

    def handle_endtag(self, tag):
        self.off -= tag in ("title", "style", "script")
        self.text.append(" " if tag in ("p", "li", "div", "h1", "article", "nav", "ul", "footer") else "")

    def handle_data(self, data):
        self.text.append("" if self.off else data)


def test_layout_emits_every_visible_word(spark, sf):
    pages = dict(table(sf, "pages", "page_id, html"))
    rows = QUERIES["op4_layout_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        parser = Words()
        parser.feed(pages[r.page_id] or "")
        parser.close()
        assert [w for w in r.text.split() if w != "-"] == [w for w in "".join(parser.text).split() if w != "-"]
        assert r.n_chars == len(r.text) and r.n_lines == len(r.text.split("\n") if r.text else [])


def test_pipeline_decides_as_its_operators_sql(spark, sf):
    """Quality, near duplicates (five words, brute force) and decontamination by SQL; then all ids packed."""
    db = duckdb.connect()
    db.sql(f"create view benchmark as select * from '{sf}/benchmark.parquet'")
    db.sql(f"create table documents as select * from '{sf}/documents.parquet'")

    def keep(sql):
        db.sql(f"create or replace table keep as {sql}")
        db.sql("create or replace table documents as select * from documents where doc_id in (select doc_id from keep)")

    keep(f"select doc_id from ({ORACLES['op9_quality_ledger']}) where kept")
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for i, t in db.sql("select doc_id, text from documents").fetchall()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    keep("select * from (values " + ",".join(f"({i})" for i, r in root.items() if i == r) + ") t(doc_id)")
    keep(f"select doc_id from ({ORACLES['op7_decontaminate']}) where not contaminated")
    rows = corpus_pipeline.run(spark, sf).collect()
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
        assert r.length == len(r.ids)
    assert set(got) == {i for (i,) in db.sql("select doc_id from documents").fetchall()}
    assert all(got[r.doc_id] == r.doc_tokens for r in rows)
