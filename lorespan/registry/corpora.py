"""Corpora derived from the given tables, once as Spark frames and once as SQL.

Whole tables are used throughout. ``doc_id % n`` only decides what *state* a document is in
(new, changed, touched, waiting …), so that every state occurs in every corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V
from ..schemas import MANIFEST_COLUMNS
from ..session import new_path
from ..sources.files import write_tree
from ..sources.tables import corpus_from_table

SOURCE = "fr"
FRENCH = {"fr": ["le|la|les|des|du|une|un|que|qui", "dans|pour|pas|est|sont|mais|donc|avec|en|et"]}
EPOCH_MICROS = 1_704_067_200_000_000  # 2024-01-01
MAX_TOKENS = 200
MIN_TOKENS = 50

# The same text in both dialects but for the lambda and the base of the line number.
_MD_LINE = """case when {i} % 8 = 3 then concat('## S', {i}, chr(10), chr(10), x)
    when {i} % 8 = 6 then concat('### T', {i}, chr(10), x)
    when {i} % 16 = 9 then concat('```', chr(10), '## code', chr(10), chr(10), x, chr(10), '```')
    else x end"""
_MD_HEAD = "case when doc_id % 7 = 6 then concat('<!-- translated -->', chr(10), chr(10)) else '' end"
MD_SPARK = (
    f"concat({_MD_HEAD}, array_join(transform(split(text, chr(10)), (x, i) -> "
    + _MD_LINE.format(i="i") + "), concat(chr(10), chr(10))))"
)
MD_DUCK = (
    f"concat({_MD_HEAD}, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: "
    + _MD_LINE.format(i="(i - 1)") + "), concat(chr(10), chr(10))))"
)
PATH = """case doc_id % 5
    when 0 then concat('docs/', source, '/2024-', lpad(cast(1 + doc_id % 12 as string), 2, '0'), '-',
                       lpad(cast(1 + doc_id % 28 as string), 2, '0'), '/d', doc_id, '.md')
    when 1 then concat('notes/2024', lpad(cast(1 + doc_id % 12 as string), 2, '0'),
                       lpad(cast(1 + doc_id % 28 as string), 2, '0'), '_n', doc_id, '.md')
    when 2 then concat('node_modules/', source, '/d', doc_id, '.md')
    when 3 then concat('src/', source, '/m', doc_id, '.py')
    else concat('knowledge/', case when doc_id % 2 = 0 then 'diary' else 'translations' end,
                '/d', doc_id, '.md') end"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return new_path(spark, name)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, relpath, text (markdown), mtime."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        F.expr(PATH).alias("relpath"),
        F.expr(MD_SPARK).alias("text"),
        F.timestamp_micros(F.lit(EPOCH_MICROS) + F.col("doc_id") * 60_000_000).alias("mtime"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_from_table(docs(spark, sf_dir))


TREE_PREFIX = "case when doc_id % 7 = 1 then '_drafts/' when doc_id % 7 = 2 then '.kept/' else '' end"


def tree(spark: SparkSession, sf_dir: str) -> str:
    """All documents written as files; some lie in folders whose names begin with . or _."""
    folder = scratch(spark, "tree")
    rows = docs(spark, sf_dir).withColumn("prefix", F.expr(TREE_PREFIX))
    write_tree(rows.select(F.concat("prefix", "relpath").alias("relpath"), "text"), folder)
    return folder


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest in which every kind of change against ``corpus`` occurs."""
    state, status = F.col("doc_id") % 10, F.col("doc_id") % 4
    rows = S.with_content_hash(docs(spark, sf_dir)).withColumn(
        "status",
        F.when(status <= 1, "indexed").when(status == 2, "pending_index").otherwise("pending_translation"),
    )
    recorded = rows.filter(state != 0).select(
        "relpath",
        F.when(state == 1, F.sha2(F.concat("content_hash", F.lit("x")), 256))
        .otherwise(F.col("content_hash")).alias("original_hash"),
        F.when(state.isin(1, 2), F.col("mtime") - F.expr("interval 100 seconds"))
        .otherwise(F.col("mtime")).alias("original_mtime"),
        "lang", "status", "doc_id", "text",
    )
    gone = rows.filter(F.col("doc_id") % 20 == 7).select(
        F.concat(F.lit("gone/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("relpath"),
        F.col("content_hash").alias("original_hash"),
        F.col("mtime").alias("original_mtime"),
        "lang", "status", "doc_id", "text",
    )
    return recorded.unionByName(gone).select(
        "relpath",
        "original_hash",
        "original_mtime",
        F.col("lang").alias("language"),
        S.path_date(F.col("relpath")).alias("date"),
        "status",
        F.octet_length("text").cast("bigint").alias("size"),
        F.col("original_mtime").alias("source_mtime"),
        F.lit(None).cast("timestamp").alias("indexed_at"),
        F.when(F.col("status") == "indexed", F.col("doc_id") % 6).cast("int").alias("chunk_count"),
        F.lit(None).cast("string").alias("error"),
    ).select(*MANIFEST_COLUMNS)


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations of every other French document."""
    return (
        table(spark, sf_dir, "documents")
        .filter((F.col("lang") == SOURCE) & (F.col("doc_id") % 2 == 0))
        .select(
            F.expr(PATH).alias("relpath"),
            F.concat(F.lit("<!-- fr to en -->\n"), F.col("text")).alias("text"),
        )
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.col("conv_id") * 100 + F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        F.col("text").alias("content"),
        F.concat(F.lit("conv "), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("title"),
        F.col("conv_id").cast("string").alias("session"),
        F.col("role").alias("agent"),
        F.lit(None).cast("string").alias("tags"),
        F.timestamp_micros(F.lit(EPOCH_MICROS) + seconds * 1_000_000).alias("written_at"),
    )


def text_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )


def label_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector per label of the whole table: that of its first row."""
    return (
        table(spark, sf_dir, "embeddings")
        .groupBy("label")
        .agg(F.min_by("embedding", "vec_id").alias("embedding"))
        .select(F.col("label").cast("bigint").alias("query_id"), "embedding")
    )


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector table in the shape of a chunk table."""
    number = F.col("vec_id").cast("string")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), F.lpad(number, 12, "0")).alias("id"),
        F.concat(F.lit("set"), (F.col("label") % 3).cast("string"), F.lit("/v"), number, F.lit(".md")).alias("source_file"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("section"),
        F.when(F.col("vec_id") % 5 == 0, "").otherwise(
            F.concat(F.lit("2024-0"), (1 + F.col("vec_id") % 9).cast("string"), F.lit("-01"))
        ).alias("date"),
        F.lit("en").alias("language"),
        F.concat(F.lit("preview "), number).alias("content_preview"),
        F.concat(F.lit("text "), number).alias("text"),
        "embedding",
    )


# --- the same corpora as SQL -----------------------------------------------------

_STATUS = """case when doc_id % 4 <= 1 then 'indexed' when doc_id % 4 = 2 then 'pending_index'
             else 'pending_translation' end"""


def sql_date(relpath: str) -> str:
    stem = f"regexp_replace(regexp_extract({relpath}, '[^/]*$'), '^(.+)\\.[^.]+$', '\\1')"
    return f"""coalesce(nullif(regexp_extract({relpath}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), ''),
      nullif(regexp_replace(regexp_extract({stem}, '[0-9]{{8}}'), '^(....)(..)(..)$', '\\1-\\2-\\3'), ''))"""


DOCS = f"""docs as (select doc_id, lang, source, text as raw, {PATH} as relpath, {MD_DUCK} as text,
    {EPOCH_MICROS} + doc_id * 60000000 as mtime from documents)"""
CORPUS = DOCS + """,
corpus as (select doc_id, lang, raw, relpath, text, mtime, strlen(text)::bigint as size, sha256(text) as hash from docs)"""
TREE = DOCS + f""",
tree as (select doc_id, concat({TREE_PREFIX}, relpath) as relpath, text from docs),
listed as (select * from tree where (relpath like '%.md' or regexp_matches(relpath, '^src/.*[.]py$'))
  and (starts_with(relpath, 'knowledge/diary/') or not list_has_any(string_split(relpath, '/'), {V.EXCLUDE_DIRS!r})))"""
MANIFEST = CORPUS + f""",
man0 as (
  select relpath, case when doc_id % 10 = 1 then sha256(concat(hash, 'x')) else hash end as original_hash,
    case when doc_id % 10 in (1, 2) then mtime - 100000000 else mtime end as original_mtime,
    lang as language, {_STATUS} as status, size, doc_id from corpus where doc_id % 10 <> 0
  union all
  select concat('gone/', doc_id, '.md'), hash, mtime, lang, {_STATUS}, size, doc_id from corpus where doc_id % 20 = 7),
manifest as (select relpath, original_hash, original_mtime, language, {sql_date('relpath')} as date, status, size,
    case when status = 'indexed' then (doc_id % 6)::int end as chunk_count, null::varchar as error from man0)"""
TRANSLATIONS = f"""tr as (select doc_id, {PATH} as relpath, concat('<!-- fr to en -->', chr(10), text) as text
    from documents where lang = 'fr' and doc_id % 2 = 0)"""
VECTORS = """vectors as (select concat('v', lpad(vec_id::varchar, 12, '0')) as id,
    concat('set', label % 3, '/v', vec_id, '.md') as source_file, concat('label ', label) as section,
    case when vec_id % 5 = 0 then '' else concat('2024-0', 1 + vec_id % 9, '-01') end as date,
    'en' as language, concat('preview ', vec_id) as content_preview, concat('text ', vec_id) as text,
    embedding from embeddings),
asked as (select label::bigint as query_id, arg_min(embedding, vec_id) as qv from embeddings group by label)"""

WS_SQL = "concat(" + ", ".join(f"chr({ord(c)})" for c in V.WHITESPACE) + ")"


def sql_strip(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


def sql_body(text: str) -> str:
    """Text without a leading comment, trimmed on the left."""
    left = f"ltrim({text}, {WS_SQL})"
    return f"""case when starts_with({left}, '<!--') and contains({left}, '-->')
      then ltrim(substring({left}, strpos({left}, '-->') + 3), {WS_SQL}) else {left} end"""


def sql_sections(source: str, key: str = "relpath") -> str:
    """CTEs from ``source`` (key, text) to ``split1`` (key, ss: list of header, level, content)."""
    fence = "'```[\\s\\S]*?```'"
    ws = f"[{V.WS}]"
    return f"""
fenced as (select {key}, array_to_string(list_transform(
    list_zip(regexp_split_to_array(text, {fence}), regexp_extract_all(text, {fence})),
    lambda p: concat(p[1], replace(coalesce(p[2], ''), chr(10), chr(1)))), '') as t from {source}),
parts as (select {key}, list_filter(list_transform(
    string_split(regexp_replace(t, '(?m)^(#{{2,3}}{ws})', concat(chr(2), '\\1'), 'g'), chr(2)),
    lambda x: {sql_strip('x')}), lambda x: x <> '') as ps from fenced),
split1 as (select {key}, list_transform(ps, lambda x: {{
    'h': case when regexp_extract(x, '^#{{2,3}}{ws}+[^\\n]+') = '' then 'Introduction'
         else replace({sql_strip(f"regexp_extract(x, '^#{{2,3}}{ws}+([^{chr(92)}n]+)', 1)")}, chr(1), chr(10)) end,
    'l': case when regexp_extract(x, '^#{{2,3}}{ws}+[^\\n]+') = '' then 0
         else length(regexp_extract(x, '^#{{2,3}}')) end::int,
    'c': replace({sql_strip(f"substring(x, length(regexp_extract(x, '^#{{2,3}}{ws}+[^{chr(92)}n]+')) + 1)")}, chr(1), chr(10))
    }}) as ss from parts)"""


def sql_merged(key: str = "relpath", min_tokens: int = MIN_TOKENS) -> str:
    """CTE ``merged`` from ``split1``."""
    row = "struct(h varchar, l int, c varchar)"
    grown = """(case when a.b is null then x else {'h': concat(a.b.h, ' > ', x.h), 'l': a.b.l,
      'c': concat(a.b.c, chr(10), chr(10), '### ', x.h, chr(10), chr(10), x.c)} end)"""
    return f"""
fold3 as (select {key}, list_reduce(ss, lambda a, x:
    case when length({grown}.c) // 4 < {min_tokens} then {{'m': a.m, 'b': {grown}}}
         else {{'m': list_append(a.m, {grown}), 'b': null::{row}}} end,
    {{'m': []::{row}[], 'b': null::{row}}}) as r from split1),
merged as (select {key}, case when r.b is null then r.m when len(r.m) = 0 then [r.b]
    else list_append(r.m[1:len(r.m) - 1], {{'h': concat(r.m[-1].h, ' > ', r.b.h), 'l': r.m[-1].l,
      'c': concat(r.m[-1].c, chr(10), chr(10), '### ', r.b.h, chr(10), chr(10), r.b.c)}}) end as ss from fold3)"""


def sql_pieces(key: str = "relpath", max_tokens: int = MAX_TOKENS) -> str:
    """CTE ``cut`` (key, chunk_index, section, level, content, part) from ``merged``."""
    return f"""
each as (select {key}, unnest(ss) as s, generate_subscripts(ss, 1) as si from merged),
fold4 as (select {key}, si, s, case when length(s.c) // 4 <= {max_tokens} then null else
    list_reduce(regexp_split_to_array(s.c, '\\n\\n+'), lambda a, x:
      case when a.cur <> '' and (length(a.cur) + length(x) + 2) // 4 > {max_tokens}
        then {{'o': list_append(a.o, {sql_strip('a.cur')}), 'cur': x}}
        else {{'o': a.o, 'cur': case when a.cur = '' then x else concat(a.cur, chr(10), chr(10), x) end}} end,
      {{'o': []::varchar[], 'cur': ''}}) end as r from each),
packed as (select {key}, si, s, case when r is null then [s.c]
    when {sql_strip('r.cur')} = '' then r.o else list_append(r.o, {sql_strip('r.cur')}) end as ps from fold4),
cut0 as (select {key}, si, s, unnest(ps) as content, generate_subscripts(ps, 1) as pi from packed),
cut as (select {key}, (row_number() over (partition by {key} order by si, pi) - 1)::int as chunk_index,
    case when pi = 1 then s.h else concat(s.h, ' (part ', pi, ')') end as section, s.l as level, content, pi::int as part
    from cut0)"""


def sql_cut(source: str, max_tokens: int = MAX_TOKENS, min_tokens: int = MIN_TOKENS) -> str:
    return ",".join([sql_sections(source), sql_merged(min_tokens=min_tokens), sql_pieces(max_tokens=max_tokens)])


def sql_chunks(source: str = "docs", meta: str | None = None, max_tokens: int = MAX_TOKENS) -> str:
    """CTEs up to ``chunks`` from ``source`` (relpath, text) and ``meta`` (relpath, date, language,
    original_hash); without ``meta`` these follow from ``docs``."""
    meta_sql = meta or f"select relpath, {sql_date('relpath')} as date, lang as language, sha256(text) as original_hash from docs"
    return sql_cut(source, max_tokens) + f""",
meta as ({meta_sql}),
chunks as (select concat(substring(md5(c.relpath), 1, 8), '_', substring(coalesce(original_hash, 'unknown'), 1, 8), '_',
      printf('%03d', chunk_index)) as id, c.relpath as source_file, section, coalesce(date, '') as date,
    coalesce(language, 'en') as language, chunk_index, content,
    concat('File: ', c.relpath, case when coalesce(date, '') <> '' then concat(' | Date: ', date) else '' end,
      ' | Section: ', section, chr(10), chr(10), content) as text,
    substring(content, 1, 300) as content_preview
    from cut c join meta m on c.relpath = m.relpath)"""


def sql_tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\pL\\pN]+')"


def sql_hash_vectors(source: str, key: str, text: str, name: str, dim: int = 64) -> str:
    """CTE ``name`` (key, v: float[]) of signed word hashes from ``source``."""
    return f"""
{name}_w as (select {key}, unnest({sql_tokens(text)}) as w from {source}),
{name}_s as (select {key}, (concat('0x', substring(md5(w), 1, 8))::bigint % {dim})::int as d,
    sum(case when substring(md5(w), 9, 1) < '8' then 1.0::double else -1.0::double end) as x from {name}_w group by all),
{name}_n as (select {key}, sqrt(sum(x * x)) as n from {name}_s group by all),
{name}_g as (select k.{key}, g.d::int as d from (select {key} from {source}) k, range({dim}) g(d)),
{name} as (select g.{key}, list((coalesce(s.x, 0) / case when coalesce(n.n, 0) = 0 then 1 else n.n end)::float order by g.d) as v
    from {name}_g g left join {name}_s s on s.{key} = g.{key} and s.d = g.d left join {name}_n n on n.{key} = g.{key} group by all)"""


def sql_hits(rows: str, row_id: str, vector: str, asked: str, k: int = 10, where: str = "true", ties: str | None = None,
             keep: str = "") -> str:
    """CTE ``hits``: the k nearest of ``rows`` for every row of ``asked`` (query_id, qv)."""
    cosine = f"round(list_cosine_similarity(r.{vector}::double[], a.qv::double[]), 9)"
    return f"""
scored as (select a.query_id, r.*, {cosine} as cosine from {rows} r, {asked} a where {where}),
hits as (select *, row_number() over (partition by query_id order by cosine desc, {ties or row_id})::int as rank,
    round((1 + cosine) / 2, 4) as score from scored
    qualify row_number() over (partition by query_id order by cosine desc, {ties or row_id}) <= {k})"""
