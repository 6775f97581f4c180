"""One registered query per operator, over its whole table, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    archives,
    decontam,
    layout,
    licenses,
    lm,
    neardup,
    packing,
    quality,
    ranked,
    secrets,
    spelling,
    tokenfiles,
    vectors,
)


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SQL_QUALITY = r"""
with d as (
  select doc_id, coalesce(text, '') body,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines
  from documents),
g as (
  select doc_id, unnest(range(1, len(w) - 1)) p, w from d where len(w) > 2),
k as (
  select doc_id, p, count(*) over (partition by doc_id, w[p], w[p + 1], w[p + 2]) n from g),
r as (
  select doc_id, count(distinct q) n_repeat from (
    select doc_id, unnest([p, p + 1, p + 2]) q from k where n > 1) group by doc_id),
m as (
  select doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
    (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
    len(lines)::bigint n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines,
    coalesce(n_repeat, 0)::bigint n_repeat_words,
    regexp_matches(body, '\p{L}') has_letter
  from d left join r using (doc_id)),
b as (
  select *, (case when n_words < 50 then 1 else 0 end
    + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
    + case when n_symbols > n_words then 4 else 0 end
    + case when n_lines >= 5 and 100 * n_dup_lines > 80 * n_lines then 8 else 0 end
    + case when word_chars < 2 * n_words or word_chars > 25 * n_words then 16 else 0 end
    + case when not has_letter then 32 else 0 end)::bigint fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & 3) <> 0 base_failed, fail_bits = 0 kept, fail_bits
from b
"""


@query(SQL_QUALITY)
def op9_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


_SQL_WORDS = r"""list_filter(string_split_regex(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

SQL_DECONTAM = rf"""
with i as (
  select item_id::varchar item, {_SQL_WORDS} w from benchmark),
s as (
  select item, w, least(13, len(w)) n, unnest(range(1, len(w) - least(13, len(w)) + 2)) p from i where len(w) > 0),
t as (select distinct item, n, array_to_string(w[p:p + n - 1], ' ') win from s),
d as (select doc_id, {_SQL_WORDS} w from documents),
c as (select doc_id, w, unnest(range(1, len(w) + 1)) p from d),
h as (
  select doc_id, p, z.n, array_to_string(w[p:p + z.n - 1], ' ') win
  from c, (select distinct n from t) z where p + z.n - 1 <= len(w)),
m as (select h.doc_id, h.p, h.n, t.item from h join t on h.n = t.n and h.win = t.win),
q as (select doc_id, count(distinct x) n_hit from (select doc_id, unnest(range(p, p + n)) x from m) group by doc_id),
o as (
  select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items from m group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(items, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join q using (doc_id) left join o using (doc_id)
"""


@query(SQL_DECONTAM)
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.hits(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", decontam.contaminated().alias("contaminated")
    )


SQL_NEARDUP = r"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
p as (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) i from d where len(w) > 0),
s as (select distinct doc_id, w[i:i + 3] g from p),
n as (select doc_id, count(*) n from s group by doc_id),
c as (select x.doc_id a, y.doc_id b, count(*) shared from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
e as (
  select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * shared >= 80 * (x.n + y.n - shared)),
reach(a, b) as (select doc_id, doc_id from d union select reach.a, e.b from reach join e on reach.b = e.a),
m as (select a doc_id, min(b) component_id from reach group by a)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id, doc_id = component_id kept
from m left join n using (doc_id)
"""


@query(SQL_NEARDUP)
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, as the query's contract has it; the operator's default is five."""
    return neardup.groups(_table(spark, sf_dir, "documents").select("doc_id", "text"), k=4)


@query()
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document stands for a repository of its own, its source for the owner."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return secrets.secrets(docs).drop("live")


@query()
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=False)


@query()
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenfiles.read(tokenfiles.write(docs, tokenizer_path("byte_bpe_50k.json")), with_ids=False)


SQL_ARCHIVES = """
with p as (
  select page_id, url, octet_length(encode(coalesce(html, '')))::bigint payload_bytes, sha1(coalesce(html, '')) payload_digest
  from pages),
k as (select payload_digest, max(page_id) keep from p where payload_bytes >= 1000 group by 1)
select page_id, url, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and keep > page_id then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 1000 and keep > page_id then keep end refers_to
from p left join k using (payload_digest)
"""


@query(SQL_ARCHIVES)
def op3_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC files of both versions, converted to WARC, and read back."""
    arcs = archives.write_arc(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    records = archives.read_warc(archives.convert(arcs))
    return records.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql_notices() -> str:
    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in licenses.NOTICES)
    return f"(values {rows}) t(license, text)"


SQL_LICENSES = rf"""
with recursive sizes(size) as (select 1 union all select size + greatest(1, size // 8) from sizes where size < 5000),
t0 as (select row_number() over () t, license, {_SQL_WORDS} w from {_sql_notices()}),
t1 as (select t, license, w, least(5, len(w)) k, len(w) - least(5, len(w)) + 1 run from t0 where len(w) > 0),
t2 as (select t, license, k, (select min(size) from sizes where size >= run) cls, w, unnest(range(1, run + 1)) i from t1),
g as (select distinct t, license, k, cls, array_to_string(w[i:i + k - 1], ' ') gram from t2),
m as (select t, count(*) m from g group by t),
d as (select doc_id, {_SQL_WORDS} w from documents),
p as (select doc_id, w, len(w) n, unnest(range(0, len(w))) p from d),
h as (
  select doc_id, n, p, z.k, array_to_string(w[p + 1:p + z.k], ' ') gram
  from p, (select distinct k from g) z where p + z.k <= n),
j as (
  select doc_id, n, p, g.t, g.license, g.k, g.cls, h.gram, greatest(1, g.cls // 8) step
  from h join g on h.k = g.k and h.gram = g.gram),
a as (
  select doc_id, n, t, license, k, cls, step, gram,
    unnest(range(greatest(0, ceil((p - (cls + step - 2)) / step))::bigint, p // step + 1)) * step start from j),
c as (
  select doc_id, license, t, start, least(n - start, cls + step + k - 2) n_words, count(distinct gram) shared
  from a group by doc_id, license, t, start, n, cls, step, k),
r as (
  select doc_id, license, m, shared, start, n_words, row_number() over (
    partition by doc_id, license order by shared desc, start, n_words, m) rank
  from c join m using (t) where 100 * shared >= 80 * m)
select doc_id, license, m::bigint n_shingles, shared::bigint n_shared, start::bigint start_word, n_words::bigint n_words
from r where rank = 1
"""


@query(SQL_LICENSES)
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.notices(spark))


@query()
def op4_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.extract(_table(spark, sf_dir, "pages").select("page_id", "html"))


SQL_VECTORS = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) q from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
s as (
  select a.vec_id query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


@query(SQL_VECTORS)
def op11_exact_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    hits = vectors.search(rows, rows.where("vec_id % 50 = 0"), k=5)
    return hits.withColumnRenamed("id", "vec_id")


SQL_RANKED = r"""
with d as (
  select doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
i as (
  select distinct item_id, unnest(list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) term from benchmark where item_id is not null),
c as (select count(*) filter (where len(w) > 0) n_docs, sum(len(w))::bigint n_terms from d),
p as (
  select doc_id, term, count(*) tf from (select doc_id, unnest(w) term from d)
  where term in (select term from i) group by all),
f as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint weight from p, c group by term, n_docs),
m as (select doc_id, 50 + (50 * len(w) * n_docs) // n_terms m from d, c where len(w) > 0),
s as (
  select item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint score
  from i join p using (term) join f using (term) join m using (doc_id) group by item_id, doc_id),
r as (
  select *, row_number() over (partition by item_id order by score desc, doc_id)::int rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 50
"""


@query(SQL_RANKED)
def op12_ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked.search(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents").select("doc_id", "text"))
