"""Benchmark decontamination by n-gram windows.

Test items become windows of 13 normalised words (a shorter item is one window). Documents are
scanned where they are read: a position whose first words hash like the start of some window is
a candidate, and its whole window is then looked up in the set of windows. Both sets travel
with the tasks as hash sets and are measured first; a benchmark beyond the limits is joined by
a shuffle instead, with the same rows. Hits are merged into hit words, spans and items;
documents or spans may be removed.

Defined results: null or wordless texts and items hit nothing; repeated document rows are
judged one by one; equal items all count; input columns that share a name with a result are
replaced by it, all others pass; empty tables give empty or hitless results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import measured_bytes
from .common import ascii_lower, carried, column, item, let, positions, where_settled

NGRAM = 13
ANCHOR = 3
#: Up to so many windows, and so many bytes of them, are sent to every task.
SET_ROWS = 20_000
SET_BYTES = 8 << 20
BROADCAST_BYTES = 32 << 20

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same runs in a text whose letters A-Z are still upper case.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPANS = "array<struct<s:int,e:int>>"


def norm_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _anchor(w: Column, at: Column | int, k: int) -> Column:
    """Hash of k words; positions beyond the end are skipped."""
    return F.xxhash64(*[item(w, at + j) for j in range(k)])


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", n: int = NGRAM) -> DataFrame:
    """Distinct windows: `size` in words, `anchor` hash of the first words, `win`, and the
    `items` (ids as strings) that hold it."""
    w = items.select(F.col(item_id).cast("string").alias("item"), norm_words(F.col(text)).alias("w"))
    size = F.least(F.lit(n), F.size("w"))
    starts = w.where(F.size("w") > 0).select(
        "item", "w", size.alias("size"), F.explode(positions(F.size("w") - size + 1)).alias("at")
    )
    return (
        starts.select("item", "size", F.slice("w", F.col("at") + 1, F.col("size")).alias("c"))
        .select("item", "size", F.array_join("c", " ").alias("win"), _anchor(F.col("c"), 0, ANCHOR).alias("anchor"))
        .groupBy("size", "anchor", "win")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


class Windows:
    """The windows of one benchmark, measured."""

    def __init__(self, items: DataFrame, item_id: str, text: str, n: int, set_rows: int):
        self.table = windows(items, item_id, text, n)
        keys = self.table.select("size", "anchor", "win")
        rows, size = keys.count(), measured_bytes(keys)
        self.broadcast = 2 * size <= BROADCAST_BYTES
        self.in_scan = rows <= set_rows and size <= SET_BYTES
        held = keys.collect() if self.in_scan else keys.select("size").distinct().collect()  # bounded: see above
        self.sizes = sorted({r["size"] for r in held})
        self.texts = [r["win"] for r in held] if self.in_scan else []
        self.anchors: dict[int, set[int]] = {}
        for r in held if self.in_scan else ():
            self.anchors.setdefault(min(r["size"], ANCHOR), set()).add(r["anchor"])

    def at(self, w: Column) -> Column:
        """Windows of a document that may be, or, by the sets, are windows of the benchmark."""
        begin = positions(F.size(w))

        def may_begin(i: Column) -> Column:
            any_of = F.lit(False)
            for k, hashes in self.anchors.items():
                any_of = any_of | _anchor(w, i, k).isin(sorted(hashes))
            return any_of

        if self.in_scan:
            begin = F.filter(begin, may_begin) if self.sizes else positions(F.lit(0))
        sizes = F.array(*[F.lit(s) for s in self.sizes or [NGRAM]])
        cut = F.flatten(
            F.transform(
                begin,
                lambda i: F.transform(
                    F.filter(sizes, lambda s: i + s <= F.size(w)),
                    lambda s: F.struct(
                        i.alias("at"), s.alias("size"), F.array_join(F.slice(w, i + 1, s), " ").alias("win")
                    ),
                ),
            )
        )
        return F.filter(cut, lambda x: x["win"].isin(self.texts)) if self.in_scan and self.texts else cut


def merged(found: Column) -> Column:
    """Runs of hit words from (at, size, ...) structs in any order."""

    def grow(spans: Column, x: Column) -> Column:
        last, end = F.element_at(spans, -1), x["at"] + x["size"]
        new = F.struct(x["at"].alias("s"), end.alias("e"))
        longer = F.struct(last["s"].alias("s"), F.greatest(last["e"], end).alias("e"))
        return (
            F.when(F.size(spans) == 0, F.array(new))
            .when(x["at"] <= last["e"], F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(longer)))
            .otherwise(F.concat(spans, F.array(new)))
        )

    return let(F.sort_array(found), lambda h: F.aggregate(h, F.array().cast(SPANS), grow))


def covered(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"])


def hits(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = NGRAM,
    set_rows: int = SET_ROWS,
) -> DataFrame:
    """Per document, without its text: n_words, n_hit (words inside an occurrence), n_items,
    items, items_sha256 and `hit_spans` (first word and end of each run of hit words)."""
    known = Windows(items, item_id, item_text, n, set_rows)
    doc, back = carried(docs, [text, "n_words", "n_hit", "n_items", "items", "items_sha256", "hit_spans"])
    w = F.col("__w")
    rows = docs.select(
        doc, F.monotonically_increasing_id().alias("__row"), norm_words(column(docs, text)).alias("__w")
    ).select("doc", "__row", F.size(w).cast("bigint").alias("__n"), let(w, known.at).alias("__cut"))
    rows = rows.select("doc", "__row", "__n", F.explode_outer("__cut").alias("__c"))
    rows = rows.select("doc", "__row", "__n", *[F.col(f"__c.{c}").alias(f"__{c}") for c in ("at", "size", "win")])
    t = known.table.select(F.col("size").alias("__s"), F.col("win").alias("__t"), F.col("items").alias("__items"))
    t = F.broadcast(t) if known.broadcast else t
    found = rows.join(t, (F.col("__size") == F.col("__s")) & (F.col("__win") == F.col("__t")), "left")
    one = F.struct(F.col("__at").alias("at"), F.col("__size").alias("size"), F.col("__items").alias("items"))
    grouped = found.groupBy("__row").agg(
        F.first("doc").alias("doc"),
        F.first("__n").alias("n_words"),
        F.collect_list(F.when(F.col("__items").isNotNull(), one)).alias("__hits"),
    )
    all_items = F.array_sort(F.array_distinct(F.flatten(F.transform("__hits", lambda x: x["items"]))))
    out = grouped.select(
        "doc", "n_words", merged(F.col("__hits")).alias("hit_spans"), all_items.alias("items")
    )
    return out.select(
        *back,
        "n_words",
        covered(F.col("hit_spans")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "hit_spans",
    )


def contaminated(share: int = 20) -> Column:
    """Some words are hit, and at least one in `share`."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def with_hits(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = NGRAM,
    set_rows: int = SET_ROWS,
) -> DataFrame:
    """`doc` (all columns of a document), n_words, n_hit and hit_spans. While the windows fit
    the tasks' sets nothing is shuffled and no text leaves its place."""
    known = Windows(items, item_id, item_text, n, set_rows)
    doc = carried(docs)[0]
    if not known.in_scan:
        packed = docs.select(doc, column(docs, text).alias("__text"))
        return hits(packed, items, "__text", item_id, item_text, n, set_rows).select(
            "doc", "n_words", "n_hit", "hit_spans"
        )
    w = F.col("__w")
    rows = docs.select(doc, norm_words(column(docs, text)).alias("__w"))
    rows = rows.select("doc", F.size(w).cast("bigint").alias("n_words"), merged(let(w, known.at)).alias("hit_spans"))
    return rows.select("doc", "n_words", covered(F.col("hit_spans")).alias("n_hit"), "hit_spans")


def remove_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return where_settled(with_hits(docs, items, **options), ~contaminated()).select(*carried(docs)[1])


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents, with hit words and what lies between them taken out of the text; texts
    without hits are unchanged."""
    body = F.col("doc").getField(text)
    inside = lambda i: F.exists("hit_spans", lambda s: (i >= s["s"]) & (i < s["e"]))
    between = lambda i: F.exists("hit_spans", lambda s: (i > s["s"]) & (i < s["e"]))
    cut = let(
        F.regexp_extract_all(body, F.lit(f"({RAW_WORD})")),
        lambda held: F.array_join(
            F.transform(
                F.split(body, RAW_WORD),
                lambda gap, i: F.concat(
                    F.when(between(i), F.lit("")).otherwise(gap),
                    F.when(inside(i), F.lit("")).otherwise(F.coalesce(item(held, i), F.lit(""))),
                ),
            ),
            "",
        ),
    )
    new = F.when(F.size("hit_spans") > 0, cut).otherwise(body)
    found = with_hits(docs, items, text=text, **options)
    return found.select(*[new.alias(c) if c == text else back for c, back in zip(docs.columns, carried(docs)[1])])
