"""Secret scans with corpus-wide ownership.

Three patterns give the base spans. A wider net adds long unquoted tokens that mix
letters and digits. The value of every candidate is hashed and counted over the whole
corpus: in how many owners and how many repositories does it occur? Equal texts of an owner
are one repository, so copies of a document say nothing. A value of at
least ``common_owners`` owners or ``common_repos`` repositories is a widely copied
example, such as one from a manual; another one that a single owner holds looks live.
Base spans always stay; a wide-net token becomes a span (kind ``owned``) only if it
looks live.

Everything is DataFrame functions. Counts are partial sums first, so a value that a
third of all rows hold costs one row per task; texts are scanned once and not shuffled.

Defined results: a null text is empty and has no spans. A null owner counts as one
owner of its own. Kept columns may have any name
but that of the output, ``found``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerscope.llm.texts import packed, plain, row_key
from ledgerscope.session import new_folder, write_and_read

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WIDE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
COMMON_REPOS = 100


def _spans(text: Column, pattern: str, kind: int, group: int) -> Column:
    """Array of (start, kind, end, value): code points, end exclusive; matches do not overlap."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def walk(parts: Column) -> Column:
        """The text alternates between gaps and matches; their lengths add up to the places."""
        def step(acc: Column, part: Column) -> Column:
            start = acc["at"] + F.length(part["gap"])
            end = start + F.length(part["whole"])
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), part["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    matched = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                           F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
                           F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    named = F.filter(matched, lambda p: p["whole"].isNotNull())
    return F.when(text.rlike(pattern), walk(named)).otherwise(empty)


def candidate_spans(text: Column) -> Column:
    """Base and wide-net candidates, by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    assign = F.filter(_spans(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= 6)
    base = F.concat(assign, _spans(text, ACCESS, 1, 0), _spans(text, HEX, 2, 0))
    wide = F.filter(_spans(text, WIDE, 3, 0), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    free = F.filter(wide, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.array_sort(F.concat(base, free))


def _listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, text_col: str = "text", owner_col: str = "source", keep: tuple[str, ...] = ("doc_id",),
                 common_owners: int = 3, common_repos: int = COMMON_REPOS) -> DataFrame:
    """Columns ``keep`` plus ``found``: per row its spans with value, hash, n_owners, n_repos and verdict.

    Each different text is a repository of its ``owner_col``. Verdicts are ``copied`` (``common_owners``
    or ``common_repos`` or more), ``owned`` (otherwise, one owner) and ``shared`` between them.
    """
    spark = docs.sparkSession
    if "found" in [c.lower() for c in keep]:
        raise ValueError("the input has columns of the output's names: ['found']")
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), plain(owner_col).cast("string").alias("_owner"),
        row_key(plain(text_col)).alias("_text"), candidate_spans(plain(text_col)).alias("_spans"), packed(docs.select(*[plain(c) for c in keep])))
    rows = write_and_read(rows, new_folder(spark, "secret-candidates"))  # fixes the row numbers
    hashed = lambda s: F.sha2(s["value"], 256)
    held = rows.select("_owner", "_text", F.explode(F.array_distinct(F.transform("_spans", hashed))).alias("hash"))
    per_owner = held.groupBy("hash", "_owner", "_text").agg(F.lit(1).alias("one")).groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("repos"))
    owners = per_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))
    each = rows.where(F.size("_spans") > 0).select("_row", F.explode("_spans").alias("s")).select(
        "_row", "s", F.sha2("s.value", 256).alias("hash")).join(owners, "hash")
    common = (F.col("n_owners") >= common_owners) | (F.col("n_repos") >= common_repos)
    verdict = F.when(common, "copied").when(F.col("n_owners") == 1, "owned").otherwise("shared")
    judged = each.where((F.col("s.kind") < 3) | ((F.col("n_owners") == 1) & ~common)).groupBy("_row").agg(F.array_sort(F.collect_list(
        F.struct("s.start", "s.kind", "s.end", "s.value", "hash", "n_owners", "n_repos", verdict.alias("verdict")))).alias("found"))
    return rows.select("_row", "row").join(judged, "_row", "left").select(
        *[F.col("row").getField(c).alias(c) for c in keep], "found")


def secrets_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and the spans by verdict."""
    found = scan_secrets(docs).withColumn("found", F.coalesce("found", F.expr(
        "cast(array() as array<struct<start:int,kind:int,end:int,value:string,hash:string,n_owners:bigint,n_repos:bigint,verdict:string>>)")))
    base = F.filter("found", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"),
        _listed(F.filter("found", lambda s: s["verdict"] == "owned")).alias("owned_spans"),
        _listed(F.filter("found", lambda s: s["verdict"] == "copied")).alias("copied_spans"))
