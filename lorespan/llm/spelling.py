"""Spelling variants: words one edit apart, found by a frontier that walks a trie of tables.

The trie of all words is an edge table (node, letter, child): a node is a prefix, and an edge leads
past letters that all words below it share, so that a child is the next place where words part or
one ends. It comes from one aggregation: among the words below (prefix, letter) the least and the
largest have exactly the common letters. Each edge also carries bit sets of the two letters after
its first.

The frontier holds states (word, position as the letters left, node, edits). It starts with zero
edits along each word's own path. Where another edge leaves the path, one letter is replaced or put in; from there
the word must follow an edge letter by letter, one join with the edge table a level, until its
letters are used up at the end of a word. An edit is where two words first differ, so no pair
comes up twice in a walk, and a left-out letter is an inserted one seen from the other word.

One edit leaves the first or the second half of a word as it is. The walk therefore starts at the
middle, once in the trie of the words and once in that of the reversed words, where few edges
leave a node; never at the root, through which all words pass. An alphabet bounds the edges of a
node, and so what one state can turn into.

Words over LONGEST letters would take a level for each letter. They are compared by their keys
with one letter left out, which takes a row per letter; a group of equal keys holds words that
differ in that letter alone. Found pairs are confirmed letter by letter.

Defined results: null texts have no words; a null id is written as nothing; repeated rows count
again; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, column, written

LETTERS = "[A-Za-zÀ-ÿ]"
LONGEST = 64


def letter(text: Column, at: int | Column = 0) -> Column:
    """The letter at a position from 0, or an empty text."""
    return F.substring(text, (F.lit(at) if isinstance(at, int) else at) + 1, F.lit(1))


def after(text: Column, at: int | Column) -> Column:
    return F.substring(text, (F.lit(at) if isinstance(at, int) else at) + 1, F.char_length(text))


def _lower(run: Column) -> Column:
    """A-Z lower-cased; for a run of ASCII letters that is what `lower` does."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(ascii_lower(run))


def vocabulary(
    docs: DataFrame, shortest: int = 7, least: int = 2, slip: int = 31, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """word, n. A run whose checksum (with its document's id) ``slip`` divides loses the letter the
    checksum names; words have at least ``shortest`` letters and ``least`` occurrences."""
    long_runs = F.regexp_extract_all(column(docs, text).cast("string"), F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))
    rows = docs.select(F.coalesce(column(docs, id_col).cast("string"), F.lit("")).alias("id"), F.explode(long_runs).alias("run"))
    rows = rows.withColumn("run", _lower(F.col("run")))
    rows = rows.withColumn("sum", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    place = (F.col("sum") % F.char_length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), place), after(F.col("run"), place + 1))
    words = rows.select(F.when(F.col("sum") % slip == 0, slipped).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least)


NO_LETTER = -(1 << 63)


def _bit(x: Column) -> Column:
    """One of 64 bits for a letter; the highest for an empty text."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(x).bitwiseAND(63))
    return F.when(x != "", bit).otherwise(F.lit(NO_LETTER))


def edges(words: DataFrame) -> DataFrame:
    """way, node, letter, child, ends (a word ends at the child), tail (letters of the edge after
    its first), next1, next2 (sets of the letters that follow the first) for all nodes from the
    middle of a word on. ``words`` has way and word."""
    size = F.char_length("word")
    begin = F.floor((size - 1) / 2).cast("int")  # a word with one letter less starts there
    steps = words.select("way", "word", F.explode(F.sequence(begin, size - 1)).alias("at"))
    steps = steps.select("way", "word", "at", after(F.col("word"), F.col("at")).alias("rest"))
    keyed = steps.select(
        "way",
        F.substring("word", F.lit(1), F.col("at")).alias("node"),
        letter(F.col("rest")).alias("letter"),
        "word",
        _bit(letter(F.col("rest"), 1)).alias("b1"),
        _bit(letter(F.col("rest"), 2)).alias("b2"),
    )
    below = keyed.groupBy("way", "node", "letter").agg(
        F.min("word").alias("low"), F.max("word").alias("high"), F.bit_or("b1").alias("next1"), F.bit_or("b2").alias("next2")
    )
    low, high = F.col("low"), F.col("high")
    parts = F.filter(
        F.sequence(F.char_length("node") + 1, F.least(F.char_length(low), F.char_length(high))),
        lambda i: letter(low, i) != letter(high, i),
    )
    child = F.when(low == high, low).otherwise(F.substring(low, F.lit(1), F.array_min(parts)))
    found = below.select("way", "node", "letter", child.alias("child"), "low", "next1", "next2")
    return found.select(
        "way", "node", "letter", "child", (F.col("child") == F.col("low")).alias("ends"),
        after(F.col("child"), F.char_length("node") + 1).alias("tail"), "next1", "next2",
    )


def _goes_on(rest: Column, tail: Column, ends: Column) -> Column:
    """The letters left begin with an edge's, and end with it only where a word does."""
    return rest.startswith(tail) & (ends | (F.octet_length(rest) > F.octet_length(tail)))


def _departures(words: DataFrame, trie: DataFrame) -> DataFrame:
    """way, word, rest, longer, node, ends: states with one edit, at the end of its edge. ``longer``
    marks a letter that was put in."""
    size = F.char_length("word")
    path = words.select("way", "word", F.explode(F.sequence(F.floor(size / 2).cast("int"), size)).alias("at"))
    path = path.select(
        "way", "word", F.substring("word", F.lit(1), F.col("at")).alias("node"), after(F.col("word"), F.col("at")).alias("rest")
    )
    path = path.select(
        "way", "word", "node", "rest", letter(F.col("rest")).alias("own"), after(F.col("rest"), 1).alias("rest1")
    )
    path = path.select(
        "*", _bit(F.col("own")).alias("b0"), _bit(letter(F.col("rest1"))).alias("b1"), _bit(letter(F.col("rest1"), 1)).alias("b2")
    )
    met = path.join(trie, ["way", "node"]).where(F.col("letter") != F.col("own"))

    def may(first: str, second: str) -> Column:
        """The sets of letters after the edge's first hold the next two letters of the word."""
        seen = lambda bits, bit: F.col(bits).bitwiseOR(F.lit(NO_LETTER)).bitwiseAND(F.col(bit)) != 0
        return seen("next1", first) & seen("next2", second)

    tail, ends = F.col("tail"), F.col("ends")
    replaced = (F.col("own") != "") & may("b1", "b2") & _goes_on(F.col("rest1"), tail, ends)
    inserted = may("b0", "b1") & _goes_on(F.col("rest"), tail, ends)
    met = met.select("way", "word", "rest", "rest1", "child", "ends", "tail", replaced.alias("replaced"), inserted.alias("inserted"))
    met = met.where("replaced or inserted")
    kinds = F.array(F.when(F.col("replaced"), F.lit(False)), F.when(F.col("inserted"), F.lit(True)))
    met = met.withColumn("longer", F.explode(F.array_compact(kinds)))
    rest = F.when(F.col("longer"), F.col("rest")).otherwise(F.col("rest1"))
    return met.select("way", "word", after(rest, F.char_length(tail)).alias("rest"), "longer", F.col("child").alias("node"), "ends")


def _walk(words: DataFrame, trie: DataFrame) -> DataFrame:
    """way, word, near, longer (near has a letter more)."""
    found = None
    states = written(_departures(words, trie), "frontier")
    while True:
        done = states.where("rest = ''").select("way", "word", F.col("node").alias("near"), "longer")
        found = done if found is None else found.unionByName(done)
        going = states.where("rest <> ''").drop("ends").withColumn("letter", letter(F.col("rest")))
        going = going.withColumn("rest", after(F.col("rest"), 1))
        met = going.join(trie.drop("next1", "next2"), ["way", "node", "letter"])
        met = met.where(_goes_on(F.col("rest"), F.col("tail"), F.col("ends")))
        rest = after(F.col("rest"), F.char_length("tail"))
        states = written(met.select("way", "word", rest.alias("rest"), "longer", F.col("child").alias("node"), "ends"), "frontier")
        if states.isEmpty():
            return found


def _long_pairs(words: DataFrame) -> DataFrame:
    """word, near for words of LONGEST letters and more, by keys with one letter left out. Only
    hashes are shuffled; the words come back for the pairs."""
    size, word, at = F.char_length("word"), F.col("word"), F.col("at")
    known = words.withColumn("id", F.xxhash64("word"))
    steps = known.select("id", "word", F.explode(F.sequence(F.lit(0), size - 1)).alias("at"))
    before, beyond = F.substring(word, F.lit(1), at), after(word, at + 1)
    keys = steps.select("id", "at", F.xxhash64(before, beyond).alias("key"))
    replaced = keys.join(keys.withColumnRenamed("id", "other"), ["at", "key"]).where("id <> other").select("id", "other")
    shorter = steps.select("id", F.xxhash64(F.concat(before, beyond)).alias("other")).distinct()
    inserted = shorter.join(known.select(F.col("id").alias("other")), "other").select("id", "other")
    pairs = replaced.unionByName(inserted).distinct()
    pairs = pairs.join(known, "id").join(known.select(F.col("id").alias("other"), F.col("word").alias("near")), "other")
    pairs = pairs.where(F.levenshtein("word", "near", 1) == 1).select("word", "near")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def near_words(words: DataFrame) -> DataFrame:
    """word, near: both orders of all pairs that differ by one inserted, deleted or replaced letter."""
    short = words.where(F.char_length("word") <= LONGEST).select("word")
    ways = short.select(F.lit(0).alias("way"), "word").unionByName(short.select(F.lit(1).alias("way"), F.reverse("word").alias("word")))
    trie = written(edges(ways), "trie")
    found = _walk(ways, trie)
    turned = lambda c: F.when(F.col("way") == 1, F.reverse(c)).otherwise(F.col(c)).alias(c)
    found = found.select(turned("word"), turned("near"), "longer")
    back = found.where("longer").select(F.col("near").alias("word"), F.col("word").alias("near"))
    long = words.where(F.char_length("word") >= LONGEST).select("word")
    return found.select("word", "near").unionByName(back).unionByName(_long_pairs(long)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root for each word that has a form: forms are followed to the last. Counts grow along
    the way, so it ends after about as many rounds as the largest count has digits, and halves
    what is left in each."""
    links = forms.where("form is not null").select("word", F.col("form").alias("root"))
    links = written(links, "roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = links.join(ahead, "root", "left")
        moved = written(joined.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def variants(
    docs: DataFrame, shortest: int = 7, least: int = 2, ratio: int = 10, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """word, form, root, n, n_near, form_n. A word's form is its most frequent near word, if that
    is ``ratio`` times as frequent."""
    words = written(vocabulary(docs, shortest, least, id_col=id_col, text=text), "words")
    near = written(near_words(words), "near")
    counted = near.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    around = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    formed = words.join(around, "word", "left").withColumn("form_n", -F.col("best.less"))
    takes = F.col("form_n") >= ratio * F.col("n")
    formed = written(
        formed.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(takes, F.col("best.near")).alias("form"),
            F.when(takes, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    return formed.join(roots(formed), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
