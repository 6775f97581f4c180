"""Chunking: fixed cases, and random texts against a line-by-line Python reading of the rules."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespan.functions import chunking as C
from lorespan.functions import scalars as S
from lorespan.operators.chunks import chunk_corpus


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")


def column(spark, expression, *values):
    rows = texts(spark, *values).select("i", expression.alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def sections(spark, text):
    return [tuple(s) for s in column(spark, C.split_sections(F.col("text")), text)[0]]


def test_token_estimate(spark):
    assert column(spark, S.est_tokens(F.col("text")), "a" * 400, "abc", "", "é😀ab") == [100, 0, 0, 1]


def test_fences_are_restored(spark):
    cases = [
        "before\n```python\nx = 1\n```\nafter", "``` open", "````\n## a\n````", "a```b\n```c```\n## d",
        "own \x01 and \x02 and \x02a\x01b", "```\n```\n```\n## x",
    ]
    assert column(spark, C.restore_fences(C.protect_fences(F.col("text"))), *cases) == cases


def test_introduction_and_sections(spark):
    got = sections(spark, "lead paragraph\n\n## First\n\nbody one\n\n### Sub\n\nbody two")
    assert got == [("Introduction", 0, "lead paragraph"), ("First", 2, "body one"), ("Sub", 3, "body two")]


def test_header_inside_fence_stays(spark):
    got = sections(spark, "## Real Header\n\n```\n## fake header in code\n```\nmore")
    assert got == [("Real Header", 2, "```\n## fake header in code\n```\nmore")]


def test_title_does_not_split(spark):
    got = sections(spark, "# Title\n\nintro body that is reasonably long " * 3)
    assert {h for h, _, _ in got} == {"Introduction"}


def test_header_needs_text_and_may_find_it_on_a_later_line(spark):
    assert sections(spark, "##") == [("Introduction", 0, "##")]
    assert sections(spark, "## \n\ntext") == [("text", 2, "")]
    assert sections(spark, "#### four\n##five") == [("Introduction", 0, "#### four\n##five")]


def test_unclosed_fence_protects_nothing(spark):
    assert [h for h, _, _ in sections(spark, "```\n## A\nx")] == ["Introduction", "A"]


def merge(spark, pairs, min_tokens):
    frame = spark.createDataFrame([(pairs,)], f"s array<{C.SECTION}>")
    return [tuple(s) for s in frame.select(C.merge_small(F.col("s"), min_tokens).alias("m")).first().m]


def test_small_section_swallows_the_next(spark):
    got = merge(spark, [("A", 2, "tiny"), ("B", 2, "x " * 400)], 50)
    assert [(h, l) for h, l, _ in got] == [("A > B", 2)]
    assert got[0][2] == "tiny\n\n### B\n\n" + "x " * 400


def test_small_rest_joins_the_section_before(spark):
    got = merge(spark, [("A", 2, "x" * 400), ("B", 3, "rest")], 50)
    assert got == [("A > B", 2, "x" * 400 + "\n\n### B\n\nrest")]
    assert merge(spark, [("A", 2, "a")], 50) == [("A", 2, "a")]
    assert merge(spark, [], 50) == []


def test_large_section_is_cut_at_paragraphs(spark):
    big = "\n\n".join(f"paragraph {i} " + "word " * 60 for i in range(10))
    frame = spark.createDataFrame([([("Big", 2, big)],)], f"s array<{C.SECTION}>")
    got = frame.select(C.split_large(F.col("s"), 100).alias("m")).first().m
    assert len(got) > 1 and all(len(s.content) // 4 <= 200 for s in got)
    assert [s.header for s in got] == ["Big"] + [f"Big (part {i})" for i in range(2, len(got) + 1)]


def test_single_long_paragraph_stays_whole(spark):
    frame = spark.createDataFrame([([("P", 2, "y" * 9000)],)], f"s array<{C.SECTION}>")
    assert len(frame.select(C.split_large(F.col("s"), 100).alias("m")).first().m) == 1


def test_chunk_rows(spark):
    docs = spark.createDataFrame(
        [("docs/x.md", "2026-06-27", "## Section One\n\n" + "content line " * 30), ("y.md", None, "")],
        "relpath string, date string, text string",
    )
    first, *rest = chunk_corpus(docs).collect()
    assert not rest and first.chunk_index == 0 and first.language == "en"
    assert first.text.startswith("File: docs/x.md | Date: 2026-06-27 | Section: Section One\n\ncontent")
    assert "File:" not in first.content and len(first.content_preview) == 300
    assert re.fullmatch(r"[0-9a-f]{8}_unknown_000", first.id)


def test_many_sections_and_paragraphs(spark):
    """More parts than one block of the fold holds."""
    parts = 1000
    many = "\n".join(f"## H{i}\n\n{'z' * 240}" for i in range(parts))
    long = "\n\n".join(f"p{i} " + "w" * 90 for i in range(parts))
    got = column(spark, C.chunk_sections(F.col("text"), 30, 50), many, long)
    assert [s.header for s in got[0]] == [f"H{i}" for i in range(parts)]
    assert "\n\n".join(s.content for s in got[1]) == long
    assert got[1][-1].header == f"Introduction (part {len(got[1])})"


def by_lines(text, max_tokens, min_tokens):
    """The rules read line by line, without the array folds under test."""
    lines, inside, marks = [], False, re.split(r"(```)", text)
    total, seen, flags = marks.count("```"), 0, []
    for piece in marks:
        if piece == "```":
            seen += 1
            inside = seen % 2 == 1 and seen < total
            flags += [None] * 3
        else:
            flags += [inside] * len(piece)
    start = 0
    for at, ch in enumerate(text + "\n"):
        if ch == "\n" and not (at < len(text) and flags[at]):
            lines.append(text[start:at])
            start = at + 1
    parts = [[]]
    for line in lines:
        if re.match(r"#{2,3}(\s|\Z)", line) and (len(line.rstrip("#")) or parts):
            # a bare mark opens a part only when white space follows it
            if re.match(r"#{2,3}\s", line) or line is not lines[-1]:
                parts.append([])
        parts[-1].append(line)
    found = []
    for part in (("\n".join(p)).strip() for p in parts):
        if not part:
            continue
        mark = re.match(r"(#{2,3})\s+", part)
        if mark:
            # the header ends with its line, and a line end inside a fence is none
            rest, depth, end = part[mark.end():], 0, None
            fenced = re.split(r"(```)", rest)
            position, opened, left = 0, 0, fenced.count("```")
            for piece in fenced:
                if piece == "```":
                    opened += 1
                    left -= 1
                elif not (opened % 2 == 1 and left > 0) and "\n" in piece:
                    end = position + piece.index("\n")
                    break
                position += len(piece)
            header = rest if end is None else rest[:end]
            found.append([header.strip(), "" if end is None else rest[end:].strip()])
        else:
            found.append(["Introduction", part])
    done, held = [], None
    for header, body in found:
        held = [header, body] if held is None else [f"{held[0]} > {header}", f"{held[1]}\n\n### {header}\n\n{body}"]
        if len(held[1]) // 4 >= min_tokens:
            done.append(held)
            held = None
    if held is not None:
        if done:
            done[-1] = [f"{done[-1][0]} > {held[0]}", f"{done[-1][1]}\n\n### {held[0]}\n\n{held[1]}"]
        else:
            done = [held]
    out = []
    for header, body in done:
        if len(body) // 4 <= max_tokens:
            out.append((header, body))
            continue
        pieces = [""]
        for paragraph in re.split(r"\n\n+", body):
            together = f"{pieces[-1]}\n\n{paragraph}" if pieces[-1] else paragraph
            if pieces[-1] and len(together) // 4 > max_tokens:
                pieces.append(paragraph)
            else:
                pieces[-1] = together
        if not pieces[-1].strip():
            pieces.pop()
        out += [(header + (f" (part {i + 1})" if i else ""), p.strip()) for i, p in enumerate(pieces)]
    return out


WORDS = st.sampled_from(["alpha", "beta gamma", "x" * 30, "é😀", " ", " ", "# t", "a | b"])
LINES = st.one_of(
    WORDS, st.sampled_from(["", "", "## H one", "### H two", "#### no", "##no", "## \ttab "]),
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(LINES, max_size=25).map("\n".join), min_size=20, max_size=40))
def test_random_texts(spark, batch):
    got = column(spark, C.chunk_sections(F.col("text"), 12, 6), *batch)
    for text, chunks in zip(batch, got):
        assert [(s.header, s.content) for s in chunks] == by_lines(text, 12, 6), repr(text)


def test_fenced_texts(spark):
    batch = [
        "```\n## a\n\nb\n```\n## C\n\nlong " + "d " * 40, "## x ```y\nz``` w\nbody", "a\n```\n## b", "````\n## q\n````\n### r\ns",
    ]
    got = column(spark, C.chunk_sections(F.col("text"), 12, 6), *batch)
    for text, chunks in zip(batch, got):
        assert [(s.header, s.content) for s in chunks] == by_lines(text, 12, 6), repr(text)
