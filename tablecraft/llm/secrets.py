"""Secret scans with multipart credential linking, in DataFrame operations only.

Base patterns are reported by themselves. Bare secrets and endpoints are weak
candidates: they are reported only where complementary parts of a credential
stand near them in the same document, found by an interval join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, text_or_empty, written

#: Patterns of the base kinds, in the order of the report.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Weak kinds: runs of exactly 40 characters of a secret key, and addresses.
SECRET = r"[A-Za-z0-9/+=]{40,}"
ENDPOINT = r"https?://[^\x20\x09-\x0D\"'<>]+"
KINDS = ("assign", "access", "hex", "secret", "endpoint")
BASE = KINDS[:3]
LEAST_VALUE = 8
#: Parts belong together if at most so many characters lie between their starts.
REACH = 500

_SPAN = "array<struct<start:int,end:int,value:string>>"


def located(text: str, pattern: str, group: int = 0) -> Column:
    """All matches as ``start, end, value``: from the lengths of matches and of what lies between them."""
    source = F.col(text)
    p = F.lit(pattern)
    hits = F.regexp_extract_all(source, p, F.lit(0))
    values = F.regexp_extract_all(source, p, F.lit(group))
    gaps = F.transform(F.split(source, pattern, -1), F.length)
    zipped = F.arrays_zip(
        F.slice(gaps, 1, F.size(hits)).alias("gap"), F.transform(hits, F.length).alias("n"), values.alias("value")
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), (begin + x["n"]).alias("end"), x["value"].alias("value"))
        return F.struct((begin + x["n"]).alias("at"), F.concat(acc["out"], F.array(span)).cast(_SPAN).alias("out"))

    found = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    return F.when(source.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, a digest of the text where linking is needed, and arrays of spans by kind."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    bare = F.filter(
        located("text", SECRET),
        lambda x: (F.length(x["value"]) == 40) & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[0-9]"),
    )
    found = rows.select(
        "doc_id",
        "text",
        F.filter(located("text", ASSIGN, 2), lambda x: F.length(x["value"]) >= LEAST_VALUE).alias("assign"),
        located("text", ACCESS).alias("access"),
        located("text", HEX).alias("hex"),
        bare.alias("secret"),
        located("text", ENDPOINT).alias("endpoint"),
    )
    linkable = (F.size("access") > 0) & (F.size("secret") + F.size("endpoint") > 0)
    spans = [F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k in KINDS]
    return found.select("doc_id", F.when(linkable, F.md5(F.col("text").cast("binary"))).alias("key"), *spans)


def linked(found: DataFrame) -> DataFrame:
    """``key, kind, start, end`` of the weak spans whose complement is near.

    A secret needs an access identifier; an endpoint needs an access identifier
    and a secret, assigned or linked. Buckets of ``REACH`` characters turn
    nearness into equality: a span meets those of its own and the next buckets.
    """
    once = found.where("key is not null").dropDuplicates(["key"])
    parts = [once.select("key", F.lit(k).alias("kind"), F.explode(k).alias("s")) for k in KINDS if k != "hex"]
    spans = parts[0]
    for other in parts[1:]:
        spans = spans.unionByName(other)
    spans = written(spans.select("key", "kind", "s.start", "s.end"), "parts")
    bucket = F.floor(F.col("start") / REACH)

    def near(weak: DataFrame, strong: DataFrame) -> DataFrame:
        """Rows of ``weak`` with a row of ``strong`` in reach."""
        w = weak.withColumn("bucket", bucket)
        s = strong.select(
            F.col("key").alias("k"), F.col("start").alias("at"), F.explode(F.sequence(bucket - 1, bucket + 1)).alias("b")
        )
        on = (F.col("key") == F.col("k")) & (F.col("bucket") == F.col("b")) & (F.abs(F.col("start") - F.col("at")) <= REACH)
        return w.join(s, on, "left_semi").drop("bucket")

    of = lambda *kinds: spans.where(F.col("kind").isin(*kinds))
    secrets = near(of("secret"), of("access"))
    endpoints = near(near(of("endpoint"), of("access")), of("assign").unionByName(secrets))
    return secrets.unionByName(endpoints)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans``.

    ``spans`` lists ``kind:start:end`` by start, then kind, in code points with
    exclusive ends; ``base_sha256`` is the digest of the same list without the
    linked kinds.

    Null counts as empty; a text without findings has empty lists; ids may be
    null or repeat, since rows are never joined by id; an empty table gives no
    rows; other columns are not looked at.
    """
    found = written(scan(docs, id_col, text_col), "found")
    weak = linked(found).groupBy("key").agg(
        F.collect_list(F.when(F.col("kind") == "secret", F.struct("start", "end"))).alias("secret"),
        F.collect_list(F.when(F.col("kind") == "endpoint", F.struct("start", "end"))).alias("endpoint"),
    )
    weak = written(weak, "linked")
    base = found.drop("secret", "endpoint")
    alone = base.where("key is null").select("*", *[F.array().cast(weak.schema[k].dataType).alias(k) for k in KINDS[3:]])
    joined = base.where("key is not null").join(small(weak), "key", "left").select(*alone.columns)
    rows = alone.unionByName(joined)

    def marked(kind: str) -> Column:
        nth = F.lit(KINDS.index(kind))
        return F.transform(
            F.coalesce(kind, F.array().cast("array<struct<start:int,end:int>>")),
            lambda x: F.struct(
                x["start"].alias("start"),
                nth.alias("nth"),
                F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")).alias("said"),
            ),
        )

    def listed(kinds: tuple[str, ...]) -> Column:
        return F.array_join(F.transform(F.array_sort(F.concat(*map(marked, kinds))), lambda x: x["said"]), ",")

    n_linked = F.coalesce(F.size("secret"), F.lit(0)) + F.coalesce(F.size("endpoint"), F.lit(0))
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.greatest(n_linked, F.lit(0)).cast("long").alias("n_linked"),
        F.sha2(listed(BASE), 256).alias("base_sha256"),
        listed(KINDS).alias("spans"),
    )
