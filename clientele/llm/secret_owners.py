"""Secret scan with corpus-wide ownership frequency.

Candidates are matches of the base patterns and bare runs that look like keys,
in the alphabet of names and in that of assigned values. Their values' hashes
(without dots at the end) are aggregated over the corpus by distinct repositories
and distinct owners; without a column that names repositories, a repository is a
different text, so copies of one document are one. A value held by many owners is a widely copied example; a
value held by few and of live look (letters, digits, enough different
characters, no placeholder word) is a credential of its owner. A bare run is
reported as a span of kind ``owned`` if its value is such a credential elsewhere.

DataFrame functions only: the positions of matches come from the lengths of
the matches and of the pieces between them, summed by a window over the
exploded matches (linear also for a text with very many). The candidates are
written once; hashes, not texts, are shuffled, pre-aggregated by (hash, owner,
repository), so a value in a third of all rows costs each task one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import written

# The patterns of the contract, and the least length of the value.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "owned")
LEAST = {"assign": 6, "access": 20, "hex": 24, "owned": 16, "wide": 16}

# A bare run: whole, of 16 or more characters, with a digit and a letter.
BARE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{16,}"
# The same in the alphabet of assigned values, dots at the end left out.
WIDE = r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])(?=[0-9+/_.=-]*[A-Za-z])[A-Za-z0-9+/_.=-]{15,}[A-Za-z0-9+/_=-]"
# Texts without a match of these have none of the longer patterns either; only they are split.
GATES = {"assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", "access": r"AKIA[A-Z0-9]{16}",
         "hex": r"[0-9a-f]{24}", "owned": BARE, "wide": WIDE}
# Runs under the least length are dropped by the pattern; a whole run is matched either way.
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}", "owned": BARE, "wide": WIDE}
PLACEHOLDERS = r"(?i)(example|sample|dummy|changeme|placeholder|your_?|xxxx|test|123456|abcdef)"


def _matches(text: Column, kind: str) -> Column:
    """Array of ``(kind, gap, match)``: code points between the previous match and this one, and the match."""
    pieces = F.split(text, PATTERNS[kind])
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    each = F.transform(found, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"),
                                                    F.length(F.get(pieces, i)).alias("gap"), m.alias("m")))
    return F.when(text.rlike(GATES[kind]), each)


def live_look(value: Column) -> Column:
    """Letters and digits, eight or more different characters, no placeholder word."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (distinct >= 8) & ~value.rlike(PLACEHOLDERS))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str | None, repo_col: str | None) -> tuple[DataFrame, DataFrame]:
    """All rows ``(uid, doc_id)`` and their candidates ``(uid, kind, start, end, hash, look, owner, repo)``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    who = F.col(owner_col).cast("string") if owner_col else F.lit(None).cast("string")
    where = F.col(repo_col).cast("string") if repo_col else F.xxhash64(text).cast("string")
    empty = F.array().cast("array<struct<kind:string,i:int,gap:int,m:string>>")
    found = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"),
                        who.alias("owner"), where.alias("repo"),
                        F.concat(*[F.coalesce(_matches(text, k), empty) for k in PATTERNS]).alias("found"))
    found = written(found, "secret-candidates")  # the ids are fixed from here on; no texts
    each = found.filter(F.size("found") > 0).select("uid", "owner", "repo", F.inline("found"))
    upto = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = (each.withColumn("end", F.sum((F.col("gap") + F.length("m")).cast("long")).over(upto))
            .withColumn("start", F.col("end") - F.length("m"))
            .withColumn("value", F.when(F.col("kind") == "assign", F.regexp_extract("m", ASSIGN, 2)).otherwise(F.col("m"))))
    least = None
    for k in PATTERNS:
        least = F.lit(LEAST[k]) if least is None else F.when(F.col("kind") == k, LEAST[k]).otherwise(least)
    each = each.filter((F.length("value") >= least) & ((F.col("kind") != "wide") | F.col("value").rlike("[+/.=]")))  # else it is a bare run already
    value, kind = F.rtrim(F.col("value"), F.lit(".")), F.when(F.col("kind") == "wide", "owned").otherwise(F.col("kind"))
    return found.select("uid", "doc_id"), each.select("uid", kind.alias("kind"), "start", "end", F.sha2(value.cast("binary"), 256).alias("hash"),
                                                      live_look(value).alias("look"), "owner", "repo")


def ownership(each: DataFrame, max_owners: int = 2, max_repos: int = 4) -> DataFrame:
    """Per hash ``owners, repos, uses, base, live``. A null owner or repository counts as one of its own."""
    spread = each.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("uses"), F.max("look").alias("look"),
                                                       F.max((F.col("kind") != "owned")).alias("base"))
    by_owner = spread.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("uses").alias("uses"),
                                                   F.max("look").alias("look"), F.max("base").alias("base"))
    out = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("uses").alias("uses"),
                                       F.max("look").alias("look"), F.max("base").alias("base"))
    return out.withColumn("live", F.col("look") & (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).drop("look")


def scan_secrets(docs: DataFrame, max_owners: int = 2, max_repos: int = 4, id_col: str = "doc_id", text_col: str = "text",
                 owner_col: str | None = "source", repo_col: str | None = None) -> DataFrame:
    """Per row ``uid, doc_id, spans``: spans is an array of ``(start, place, kind, end, owners, repos, live)`` by start, then kind.

    Base spans are always reported. A bare run is a span of kind ``owned`` if
    its value is live, is that of a base match somewhere in the corpus, and the
    run overlaps no base span of its text. Without ``repo_col`` a repository is a different text.
    Defined cases: null and empty texts have no spans; rows repeated alike are
    scanned each; null owners and ids are allowed; no rows give no rows; other
    columns are ignored.
    """
    rows, each = candidates(docs, id_col, text_col, owner_col, repo_col)
    each = written(each, "secret-spans")
    known = ownership(each, max_owners, max_repos)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    spans = each.join(known, "hash").filter((F.col("kind") != "owned") | (F.col("live") & F.col("base"))).withColumn("place", place)
    is_base = F.col("kind") != "owned"
    order = Window.partitionBy("uid").orderBy("start", "place")
    end_before = F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    start_after = F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    spans = (spans.withColumn("end_before", end_before).withColumn("start_after", start_after)
             .filter(is_base | ((F.coalesce("end_before", F.lit(0)) <= F.col("start"))
                                & (F.coalesce("start_after", F.col("end")) >= F.col("end"))))
             .groupBy("uid").agg(F.sort_array(F.collect_list(F.struct(
                 "start", "place", "kind", "end", "owners", "repos", "live"))).alias("spans")))
    return rows.join(spans, "uid", "left")


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
