"""Markdown chunking as column expressions.

A document's sections are one array column, so cutting a corpus needs neither a
shuffle nor a Python worker. The two sequential rules (merging small sections,
packing paragraphs) are left folds. A fold that appends to one array copies it at
every step; folding block by block keeps a document with very many parts cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .scalars import est_tokens, strip, tokens_of_chars

SECTION = "struct<header:string,level:int,content:string>"
FOLD_BLOCK = 256

# U+0001 stands for a line end inside a fence. Where a text brings U+0001 or
# U+0002 of its own, U+0002 plus a letter stands for them.
_HIDDEN = "\x01"
_ESCAPE = "\x02"
_ALL = (1 << 31) - 1


def _section(header: Column, level: Column, content: Column) -> Column:
    return F.struct(header.alias("header"), level.alias("level"), content.alias("content"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once: lambdas have no local variables otherwise."""
    return F.element_at(F.transform(F.array(value), body), 1)


def protect_fences(text: Column) -> Column:
    """Hide line ends inside closed code fences, so that no line there starts a section."""
    escaped = F.when(
        F.contains(text, F.lit(_HIDDEN)) | F.contains(text, F.lit(_ESCAPE)),
        F.replace(
            F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_HIDDEN), F.lit(_ESCAPE + "a")
        ),
    ).otherwise(text)
    # a fence opens at every other mark; what follows an opening mark that is never closed
    # is the last piece and stays as it is
    hidden = _let(
        F.split(escaped, V.FENCE_MARK, -1),
        lambda pieces: F.transform(
            pieces,
            lambda piece, i: F.when(
                (i % 2 == 1) & (i < F.size(pieces) - 1), F.replace(piece, F.lit("\n"), F.lit(_HIDDEN))
            ).otherwise(piece),
        ),
    )
    return F.array_join(hidden, V.FENCE_MARK)


def restore_fences(text: Column) -> Column:
    shown = F.replace(text, F.lit(_HIDDEN), F.lit("\n"))
    unescaped = F.replace(
        F.replace(shown, F.lit(_ESCAPE + "a"), F.lit(_HIDDEN)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE)
    )
    return F.when(F.contains(text, F.lit(_ESCAPE)), unescaped).otherwise(shown)


def _needs_protection(text: Column) -> Column:
    return (
        F.contains(text, F.lit(V.FENCE_MARK))
        | F.contains(text, F.lit(_HIDDEN))
        | F.contains(text, F.lit(_ESCAPE))
    )


def split_at_headers(text: Column, restore: Callable[[Column], Column] = lambda t: t) -> Column:
    """Sections of a text in order, blank parts dropped. ``restore`` is applied to headers
    and contents."""
    parts = F.filter(
        F.transform(F.split(text, V.HEADER_START, -1), strip), lambda part: part != ""
    )
    opened = F.transform(
        parts,
        lambda part: F.struct(
            part.alias("part"), F.regexp_extract(part, V.HEADER_LINE, 0).alias("line")
        ),
    )

    def to_section(p: Column) -> Column:
        rest = F.substring(p["part"], F.length(p["line"]) + 1, F.lit(_ALL))
        return F.when(
            p["line"] == "", _section(F.lit(V.INTRODUCTION), F.lit(0), restore(p["part"]))
        ).otherwise(
            _section(
                restore(strip(F.substring(p["line"], level(p) + 1, F.lit(_ALL)))),
                level(p),
                restore(strip(rest)),
            )
        )

    def level(p: Column) -> Column:
        return F.when(p["line"].startswith("###"), 3).otherwise(2)

    return F.transform(opened, to_section)


def split_sections(text: Column) -> Column:
    """Sections of a text; only a text with fences pays for their protection."""
    return F.when(
        _needs_protection(text), split_at_headers(protect_fences(text), restore_fences)
    ).otherwise(split_at_headers(text))


def _blocked_fold(items: Column, output: str, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Left fold with a state ``struct(out, open)``, appending block by block."""
    empty = F.array().cast(f"array<{output}>")
    last_block = F.floor((F.size(items) - 1) / FOLD_BLOCK).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(last_block, F.lit(0))),
        lambda i: F.slice(items, i * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)),
    )

    def fold_block(state: Column, block: Column) -> Column:
        within = F.aggregate(
            block, F.struct(empty.alias("out"), state["open"].alias("open")), step
        )
        return _let(
            within,
            lambda r: F.struct(
                F.concat(state["out"], r["out"]).alias("out"), r["open"].alias("open")
            ),
        )

    return F.aggregate(blocks, F.struct(empty.alias("out"), start.alias("open")), fold_block)


def _absorb(first: Column, second: Column) -> Column:
    return _section(
        F.concat(first["header"], F.lit(" > "), second["header"]),
        first["level"],
        F.concat(first["content"], F.lit("\n\n### "), second["header"], F.lit("\n\n"), second["content"]),
    )


def merge_small(sections: Column, min_tokens: int = V.MIN_TOKENS) -> Column:
    """Let a small section swallow its followers until it is large enough; a rest that
    stays small joins the section before it."""
    none = F.lit(None).cast(SECTION)

    def step(state: Column, section: Column) -> Column:
        grown = F.when(state["open"].isNull(), section).otherwise(_absorb(state["open"], section))
        return _let(
            grown,
            lambda g: F.when(
                est_tokens(g["content"]) < min_tokens,
                F.struct(state["out"].alias("out"), g.alias("open")),
            ).otherwise(
                F.struct(F.array_append(state["out"], g).alias("out"), none.alias("open"))
            ),
        )

    def finish(r: Column) -> Column:
        done, rest = r["out"], r["open"]
        return (
            F.when(rest.isNull(), done)
            .when(F.size(done) == 0, F.array(rest))
            .otherwise(
                F.concat(
                    F.slice(done, F.lit(1), F.size(done) - 1),
                    F.array(_absorb(F.element_at(done, -1), rest)),
                )
            )
        )

    return _let(sections, lambda items: _let(_blocked_fold(items, SECTION, none, step), finish))


def pack_paragraphs(content: Column, max_tokens: int = V.MAX_TOKENS) -> Column:
    """Pieces of a long content: paragraphs packed greedily, none of them cut."""

    def opened(text: Column, chars: Column) -> Column:
        return F.struct(text.alias("text"), chars.alias("chars"))

    def step(state: Column, paragraph: Column) -> Column:
        current = state["open"]
        chars = current["chars"] + 2 + F.length(paragraph)
        joined = opened(F.concat(current["text"], F.lit("\n\n"), paragraph), chars)
        alone = opened(paragraph, F.length(paragraph))
        return (
            F.when(current["chars"] == 0, F.struct(state["out"].alias("out"), alone.alias("open")))
            .when(
                tokens_of_chars(chars) > max_tokens,
                F.struct(
                    F.array_append(state["out"], strip(current["text"])).alias("out"),
                    alone.alias("open"),
                ),
            )
            .otherwise(F.struct(state["out"].alias("out"), joined.alias("open")))
        )

    def finish(r: Column) -> Column:
        tail = strip(r["open"]["text"])
        return F.when(tail == "", r["out"]).otherwise(F.array_append(r["out"], tail))

    start = opened(F.lit(""), F.lit(0))
    paragraphs = F.split(content, V.PARAGRAPH_BREAK, -1)
    return _let(paragraphs, lambda p: _let(_blocked_fold(p, "string", start, step), finish))


def split_large(sections: Column, max_tokens: int = V.MAX_TOKENS) -> Column:
    """Cut sections that are too long; from the second piece on the header says which part."""

    def pieces(section: Column) -> Column:
        return F.transform(
            pack_paragraphs(section["content"], max_tokens),
            lambda piece, i: _section(
                F.when(i == 0, section["header"]).otherwise(
                    F.concat(section["header"], F.lit(" (part "), (i + 1).cast("string"), F.lit(")"))
                ),
                section["level"],
                piece,
            ),
        )

    return F.flatten(
        F.transform(
            sections,
            lambda s: F.when(est_tokens(s["content"]) <= max_tokens, F.array(s)).otherwise(pieces(s)),
        )
    )


def chunk_sections(
    text: Column, max_tokens: int = V.MAX_TOKENS, min_tokens: int = V.MIN_TOKENS
) -> Column:
    """Text to its final sections: header split, merge, split."""
    return _let(
        split_sections(text),
        lambda sections: split_large(merge_small(sections, min_tokens), max_tokens),
    )
