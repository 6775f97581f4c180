"""Secret scan with corpus-wide ownership frequency.

One pass over the texts finds candidates: assignments to credential names, access keys, long
hex runs, and (added by the method) other long mixed tokens. Only their hashes leave the text.
Each hash is then counted over distinct repositories and owners, and both counts decide. A value
of several owners (EXAMPLE_OWNERS) is a copied example. One of fewer owners that looks random is
live while it stays in few repositories; in many of them (REUSED_REPOS) it is reused: a setting or
credential that its owner deals out widely, told apart because it is neither a single leak nor
known to others. Added tokens count as spans only when they are live or reused; pattern matches
are always reported. `mask` covers live and reused values.

Defined results: null and empty texts hold nothing; every input row gives a row, repeated ones
too; a null repository or owner counts as none; columns of the input other than the named ones
pass through `mask` only; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import measured_bytes
from .common import carried, column, item, written
from .decontam import merged

# Fixed values of the base scan: kinds in their order, patterns, least lengths.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_MIN, ACCESS_MIN = 12, 18
# Fixed values of the method: what added tokens look like, and words that mark placeholders.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}")
PLACEHOLDER = re.compile(r"example|sample|placeholder|changeme|dummy|your|xxxx|0000|1234567", re.IGNORECASE)
LEAST_BITS = 2.8
#: A value with so many distinct owners is an example that is copied around.
EXAMPLE_OWNERS = 3
#: A value of fewer owners in so many repositories is reused by its owner.
REUSED_REPOS = 100

BROADCAST_BYTES = 8 << 20
SPAN = "array<struct<start:bigint,kind:int,stop:bigint,hash:binary,random:boolean>>"


def looks_random(value: str) -> bool:
    """No placeholder word, and enough entropy per character."""
    if PLACEHOLDER.search(value):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= LEAST_BITS


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, stop, value) by start, then kind; kind 3 only outside the others."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted(found)
    reach, i, end = base, 0, 0
    for m in TOKEN.finditer(text):
        while i < len(reach) and reach[i][0] < m.end():
            end, i = max(end, reach[i][2]), i + 1
        if end <= m.start() and re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]):
            found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


def scan(docs: DataFrame, key: str, text: str, repo: str, owner: str) -> DataFrame:
    """doc_key, repo, owner, counts by base kind, base_sha256, and the candidates of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [[], [], []], [], []
            for t in batch.column(3).to_pylist():
                found = candidates(t or "")
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in found))
                named = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in found if k < 3)
                digests.append(hashlib.sha256(named.encode()).hexdigest())
                spans.append(
                    [
                        {
                            "start": s,
                            "kind": k,
                            "stop": e,
                            "hash": hashlib.sha256(v.encode()).digest(),
                            "random": looks_random(v),
                        }
                        for s, k, e, v in found
                    ]
                )
            kind = pa.list_(
                pa.struct(
                    [("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("hash", pa.binary()), ("random", pa.bool_())]
                )
            )
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in (0, 1, 2)], *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array(spans, kind)],
                ["doc_key", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    named = {"repo": repo, "owner": owner, "text": text}
    rows = docs.select(column(docs, key).alias("doc_key"), *[column(docs, c).cast("string").alias(n) for n, c in named.items()])
    schema = rows.schema["doc_key"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"doc_key {schema}, repo string, owner string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans {SPAN}",
    )


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners over the whole corpus. Repeats within a repository go before
    the hash is grouped, so a value that is copied everywhere costs one row per task and
    repository."""
    each = found.select("repo", "owner", F.explode("spans.hash").alias("hash")).distinct()
    repos = each.select("hash", "repo").distinct().groupBy("hash").agg(F.count("repo").alias("n_repos"))
    owners = each.select("hash", "owner").distinct().groupBy("hash").agg(F.count("owner").alias("n_owners"))
    return repos.join(owners, "hash")


def secrets(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    repo: str = "doc_id",
    owner: str = "source",
    example_owners: int = EXAMPLE_OWNERS,
    reused_repos: int = REUSED_REPOS,
) -> DataFrame:
    """Per document: the key, counts, base_sha256, `spans` (kind:start:end, comma-joined), `holders`
    (repositories:owners of each span's value, likewise), n_live, n_reused, n_example, and `live`
    (start and end of each live or reused span)."""
    found = written(scan(docs, key, text, repo, owner), "secrets")
    counted = written(ownership(found), "ownership")
    plain = ["doc_key", "n_assign", "n_access", "n_hex", "base_sha256"]
    numbered = found.where(F.size("spans") > 0).withColumn("__row", F.monotonically_increasing_id())
    each = numbered.select(*plain, "__row", F.explode("spans").alias("s")).select(*plain, "__row", "s.*").join(counted, "hash", "left")
    example = F.col("n_owners") >= example_owners
    secret = F.col("random") & ~example
    reused = secret & (F.col("n_repos") >= reused_repos)
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    one = F.struct(
        "start", "kind", F.concat_ws(":", name, "start", "stop").alias("name"), F.concat_ws(":", "n_repos", "n_owners").alias("held"),
        secret.alias("secret"), reused.alias("reused"), example.alias("example"), "stop",
    )
    rows = each.groupBy("__row").agg(*[F.first(c).alias(c) for c in plain], F.sort_array(F.collect_list(F.when((F.col("kind") < 3) | secret, one))).alias("all"))
    of_live = F.filter("all", lambda x: x["secret"])
    number = lambda test: F.size(F.filter("all", test)).cast("bigint")
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    rows = rows.select(
        *plain,
        F.array_join(F.col("all.name"), ",").alias("spans"),
        F.array_join(F.col("all.held"), ",").alias("holders"),
        number(lambda x: x["secret"] & ~x["reused"]).alias("n_live"),
        number(lambda x: x["reused"]).alias("n_reused"),
        number(lambda x: x["example"]).alias("n_example"),
        F.transform(of_live, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))).alias("live"),
    )
    none = found.where(F.size("spans") == 0).select(
        *plain, F.lit("").alias("spans"), F.lit("").alias("holders"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("n_live", "n_reused", "n_example")], empty.alias("live"),
    )
    return rows.unionByName(none).withColumnRenamed("doc_key", key)


def mask(
    docs: DataFrame, key: str = "doc_id", text: str = "text", repo: str | None = None, owner: str = "source",
    cover: str = "[SECRET]", **options,
) -> DataFrame:
    """The documents with live and reused secrets covered; all other texts, and copied examples,
    stay."""
    doc, back = carried(docs)
    named = {"key": key, "text": text, "repo": repo or key, "owner": owner}
    rows = docs.select(doc, *[column(docs, c).alias(n) for n, c in named.items()])
    rows = rows.withColumn("ident", F.to_json(F.struct("key", F.xxhash64("text").alias("hash"))))
    found = secrets(rows, "ident", "text", "repo", "owner", **options)
    live = found.where(F.size("live") > 0).select(F.col("ident").alias("live_ident"), "live").dropDuplicates(["live_ident"])
    live = written(live, "live")
    live = F.broadcast(live) if 4 * measured_bytes(live) <= BROADCAST_BYTES else live
    joined = rows.join(live, F.col("ident") == F.col("live_ident"), "left")
    runs = merged(F.transform("live", lambda x: F.struct(x["start"].cast("int").alias("at"), (x["stop"] - x["start"]).cast("int").alias("size"))))
    joined = joined.withColumn("runs", F.when(F.col("live").isNotNull(), runs))
    m, body = F.col("runs"), F.col("text")
    begin = lambda i: F.coalesce(item(m, i - 1)["e"], F.lit(0))
    piece = lambda i: F.substring(body, begin(i) + 1, F.coalesce(item(m, i)["s"], F.length(body)) - begin(i))
    covered = F.array_join(F.transform(F.sequence(F.lit(0), F.size(m)), piece), cover)
    new = F.when(m.isNotNull(), covered).otherwise(body)
    return joined.select(*[new.alias(c) if c == text else b for c, b in zip(docs.columns, back)])
