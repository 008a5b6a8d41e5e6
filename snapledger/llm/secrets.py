"""Secret scan with corpus-wide ownership.

Patterns find candidate credentials in whole texts. Every candidate value is counted over the corpus
by distinct owner (the `source`) and distinct repository (the document). A value that many owners
share, or that stands in many repositories, is a published example; one that few owners hold in few
repositories looks live. The base patterns are always
reported; besides them the scan reports free-standing random-looking tokens, but only live ones,
since without a keyword next to it a widely copied token is boilerplate.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import settle

KINDS = ["assign", "access", "hex", "token"]
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9_-]{20,}", re.ASCII)
ASSIGN_VALUE = 6
TOKEN_BITS = 3.5
#: A value held by at most so many owners, in at most so many repositories, counts as live.
LIVE_OWNERS = 2
LIVE_REPOSITORIES = 8

FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("begin", pa.int64()), ("stop", pa.int64()), ("value", pa.int64())]))
FOUND_SQL = "array<struct<kind int, begin bigint, stop bigint, value bigint>>"


def bits_per_char(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def random_looking(value: str) -> bool:
    """Digits and both cases in one token of high entropy, as generated keys have."""
    return (
        any(c.isdigit() for c in value)
        and any(c.islower() for c in value)
        and any(c.isupper() for c in value)
        and bits_per_char(value) >= TOKEN_BITS
    )


def value_id(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, value id) of every candidate; offsets are code points, end exclusive."""
    found = [(0, *m.span(), value_id(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        found += [(kind, *m.span(), value_id(m[0])) for m in pattern.finditer(text)]
    base = sorted((a, b) for _, a, b, _ in found)
    nth, reached = 0, 0  # base spans that begin before the token ends, and how far they go
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while nth < len(base) and base[nth][0] < b:
            reached = max(reached, base[nth][1])
            nth += 1
        if reached <= a and random_looking(m[0]):
            found.append((3, a, b, value_id(m[0])))
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [
            [dict(zip(("kind", "begin", "stop", "value"), c)) for c in candidates(text or "")]
            for text in batch.column("text").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), pa.array(found, FOUND)], ["doc_id", "source", "found"]
        )


def ownership(found: DataFrame) -> DataFrame:
    """value, owners, repositories of every candidate value, from rows (row, doc_id, source, value).

    A row without a doc_id is a repository of its own. Both counts aggregate before and after the shuffle on the value, so a value that a third of all
    documents hold is one row per task and owner.
    """
    owners = found.groupBy("value", "source").agg(F.count(F.lit(1)).alias("rows"))
    owners = owners.groupBy("value").agg(F.count(F.lit(1)).alias("owners"))
    own = F.when(F.col("doc_id").isNull(), F.col("row")).alias("own")
    repositories = found.select("value", "doc_id", own).distinct().groupBy("value").agg(F.count(F.lit(1)).alias("repositories"))
    return owners.join(repositories, "value")


def scan_secrets(docs: DataFrame, live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source) with `spans`: kind, begin, stop, owners, repositories, live.

    Nulls: a null text is empty and has no spans; a null source is an owner of its own; rows with a
    null or repeated doc_id are scanned like others. Spans are sorted by begin, then kind.
    """
    whole = docs.select("doc_id", "text", "source")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, source string, found {FOUND_SQL}"
    scanned = whole.withColumn("source", F.col("source").cast("string")).mapInArrow(scan_batches, schema)
    scanned = settle(scanned.withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    each = scanned.select("row", "doc_id", "source", F.explode("found").alias("c")).select(
        "row", "doc_id", "source", "c.*"
    )
    owned = ownership(each)
    # A widely held value would be one hot join key, but such values are few: each of them takes at least a
    # thousandth of all candidates, so at most a thousand exist and those are broadcast.
    total = scanned.agg(F.coalesce(F.sum(F.size("found")), F.lit(0)).alias("n")).first()["n"]
    owned = settle(owned, "secret-owners")
    counts = ["owners", "repositories"]
    wide = F.broadcast(owned.filter(F.col("repositories") * 1000 > total).select("value", F.struct(*counts).alias("wide")))
    each = each.join(wide, "value", "left").withColumn("key", F.when(F.col("wide").isNull(), F.col("value")))
    rest = owned.select(F.col("value").alias("key"), *counts)
    hot, cold = each.filter("wide is not null"), each.filter("wide is null").join(rest, "key")
    judged = hot.select("row", "kind", "begin", "stop", "wide.*").unionByName(cold.select("row", "kind", "begin", "stop", *counts))
    few = (F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories)
    judged = judged.withColumn("live", few).filter("kind < 3 or live")
    spans = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("begin", "kind", "stop", *counts, "live"))).alias("spans")
    )
    empty = F.array().cast(dict(spans.dtypes)["spans"])
    return scanned.select("row", "doc_id").join(spans, "row", "left").select(
        "doc_id", F.coalesce("spans", empty).alias("spans")
    )


def joined_spans(spans):
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["begin"].cast("string"), s["stop"].cast("string"))),
        ",",
    )


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and text of all spans per document."""
    found = scan_secrets(docs)
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("bigint").alias("n_live"),
    )
