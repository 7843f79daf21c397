"""Secret scan: spans of certain secrets, and weak candidates that are reported only beside complementary parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

# Fixed patterns. Base kinds first; the order is the tie-break of equal starts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# Weak parts: an account's name beside its label, a short access key, or a mail address; a URL, a host beside its
# label, or an address of four numbers.
WEAK_ID = (
    r"""(?i:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
    r"""|AKIA[A-Z0-9]{4,13}(?![A-Z0-9])"""
    r"""|(?<![A-Za-z0-9_.%+-])[A-Za-z0-9_.%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"""
)
ENDPOINT = (
    r"""(?<![A-Za-z0-9+])[a-z][a-z0-9+]{1,9}://[A-Za-z0-9_.:@/?&=%-]{4,}"""
    r"""|(?i:endpoint|hostname|host|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/-]{4,}"""
    r"""|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?:\:[0-9]{1,5})?(?![0-9.])"""
)
# What a text must have for a pattern to match: plain substrings of its lower-cased form, or a simple pattern. They are
# much cheaper to look for.
HAS = {
    "assign": (["passw", "secret", "token", "api"], None),
    "access": (["akia"], None),
    "hex": ([], None),
    "weak_id": (["akia", "@", "access", "client", "account", "user", "login"], None),
    "endpoint": (["://", "endpoint", "host", "server"], r"[0-9]\.[0-9]"),
}
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
FIRST_WEAK = 3
IDENTIFIER, SECRET, PLACE = 0, 1, 2
#: The role of each kind in a credential; hex alone has none.
ROLES = [SECRET, IDENTIFIER, -1, IDENTIFIER, SECRET, PLACE]
SPAN = "struct<start:long,ord:int,end:long>"


def may_have(text: Column, lowered: Column, kind: str) -> Column:
    words, simple = HAS[kind]
    checks = [lowered.contains(w) for w in words] + ([text.rlike(simple)] if simple else [])
    return reduce(Column.__or__, checks) if checks else F.lit(True)


def pieces(text: Column, lowered: Column, pattern: str, kind: str, valued: bool = False) -> Column:
    """An element for each leftmost non-overlapping match: ord, at, the code points of the gap before it, of it, and of
    its group 2 if valued. What split() leaves between matches gives their places, so no text needs a marker character.

    A text is read once if it has no match, else twice."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g).cast("long"))
    hits = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda h: F.struct(
            F.char_length(h).cast("long").alias("hit"),
            (F.char_length(F.regexp_extract(h, pattern, 2)) if valued else F.lit(0)).alias("value"),
        ),
    )
    element = "array<struct<ord:int,at:int,gap:long,hit:long,value:int>>"
    there = may_have(text, lowered, kind) & text.rlike(pattern)
    listed = F.when(there, F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("h"))))
    listed = F.filter(listed, lambda x: x["h"].isNotNull())
    numbered = F.transform(
        listed,
        lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("ord"), i.alias("at"), x["gap"].alias("gap"), x["h"]["hit"].alias("hit"), x["h"]["value"].alias("value")
        ),
    )
    return F.coalesce(numbered, F.array().cast(element)).cast(element)


def all_spans(found: DataFrame) -> DataFrame:
    """row, start, ord, end of every match, weak ones too, by running sums over the pieces of one text and kind."""
    order = Window.partitionBy("row", "p.ord").orderBy("p.at")
    ends = (
        found
        .select("row", F.explode("pieces").alias("p"))
        .withColumn("end", F.sum(F.col("p.gap") + F.col("p.hit")).over(order))
    )
    value, ord_ = F.col("p.value"), F.col("p.ord")
    short = F.when(value >= 12, ord_).when(value >= 6, F.lit(KINDS.index("weak_secret")))
    kind = F.when(ord_ == KINDS.index("assign"), short).otherwise(ord_)
    return ends.select("row", (F.col("end") - F.col("p.hit")).alias("start"), kind.alias("ord"), "end").where("ord is not null")


def linked(spans: DataFrame, scope: int) -> DataFrame:
    """The weak spans (row, start, ord, end) with a part of another role that starts within scope of their start.

    An interval join on (row, bin of scope): bins are first reduced to the least and greatest start of each role, so a
    text with many parts never makes pairs."""
    role = F.get(F.array(*map(F.lit, ROLES)), F.col("ord"))
    parts = spans.withColumns({"role": role, "bin": F.expr(f"start div {scope}")}).where("role >= 0")
    bins = (
        parts
        .groupBy("row", "bin", F.col("role").alias("other"))
        .agg(F.min("start").alias("least"), F.max("start").alias("most"))
    )
    weak = parts.where(F.col("ord") >= FIRST_WEAK)
    weak = weak.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    near = (
        (F.col("w.row") == F.col("b.row"))
        & (F.col("w.bin") == F.col("b.bin"))
        & (F.col("w.role") != F.col("b.other"))
        & (F.col("b.most") >= F.col("w.start") - scope)
        & (F.col("b.least") <= F.col("w.start") + scope)
    )
    return weak.alias("w").join(bins.alias("b"), near, "left_semi").select("row", "start", "ord", "end").distinct()


def reported(df: DataFrame, text: str, scope: int) -> tuple[DataFrame, DataFrame]:
    """df without its text, as row (a key) and held (a struct), and the reported spans (row, start, ord, end)."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    held = F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`") for c in df.columns if c.lower() != text.lower())).alias("held")
    kinds = [(ASSIGN, "assign", True), (ACCESS, "access"), (HEX, "hex"), (WEAK_ID, "weak_id"), (ENDPOINT, "endpoint")]
    every = F.concat(*(pieces(F.col("t"), F.col("low"), *k) for k in kinds)).alias("pieces")
    rows = (
        df
        .select(held, t.alias("t"), F.lower(t).alias("low"))
        .select(F.monotonically_increasing_id().alias("row"), "held", every)
    )
    found = common.saved(rows)
    spans = all_spans(found.select("row", "pieces"))
    return found.drop("pieces"), spans.where(F.col("ord") < FIRST_WEAK).unionByName(linked(spans, scope))


def secret_spans(df: DataFrame, text: str = "text", scope: int = 400) -> DataFrame:
    """df without its text, and spans: an array of start, ord (a place in KINDS) and end, sorted. Code points, end
    exclusive.

    Base kinds (assign, access, hex) are certain. Weak parts are access identifiers, secrets of 6 to 11 characters and
    endpoints; one is reported only if a part of another role (base spans count: access as identifier, assign as secret)
    starts within scope code points of its start in the same text. Null texts count as empty; repeated rows are rows of
    their own; spans that start together are told apart by kind. Time is in proportion to a text and its spans. A
    column of df that is named spans is replaced. An empty table gives no rows."""
    rows, spans = reported(df, text, scope)
    listed = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "ord", "end"))).alias("spans"))
    kept = [c for c in df.columns if c.lower() not in (text.lower(), "spans")]
    out = rows.join(listed, "row", "left")
    return out.select(
        *(F.col(f"held.`{c}`").alias(c) for c in kept),
        F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"),
    )


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    said = F.transform(
        spans,
        lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(said, ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their secrets, by secret_spans: see there for nulls, empty and long texts, ties, repeated rows,
    empty tables and other columns."""
    found = secret_spans(common.documents(spark, sf_dir).select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["ord"] == KINDS.index(kind))).cast("long")
    base = F.filter("spans", lambda s: s["ord"] < FIRST_WEAK)
    counts = [of(k).alias(f"n_{k}") for k in KINDS[:FIRST_WEAK]]
    sha = F.sha2(joined(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, sha, joined(F.col("spans")).alias("spans"))


def redacted(df: DataFrame, text: str = "text", mark: str = "[SECRET]", scope: int = 400) -> DataFrame:
    """df with mark in place of every reported span of text; spans that overlap count as one. Null texts stay null.

    Repeated rows are rows of their own, other columns stay as they are, and an empty table gives no rows. Texts with
    over 32 such places are cut into characters once, so that time doesn't grow with the square of the places."""
    rows, spans = reported(df.withColumn(own := common.unused(df, "_scanned"), F.col(f"`{text}`")), own, scope)
    before = Window.partitionBy("row").orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce((F.col("start") >= F.max("end").over(before)).cast("int"), F.lit(1))
    islands = spans.withColumn("new", apart)
    islands = islands.withColumn("island", F.sum("new").over(Window.partitionBy("row").orderBy("start", "ord")))
    merged = islands.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    out = rows.join(cuts, "row", "left").select("held", "cuts", F.col(f"held.`{text}`").alias("body"))
    out = out.withColumn("chars", F.when(F.size("cuts") > 32, F.split("body", "")))
    since = lambda i: F.when(i > 0, F.get("cuts", i - 1)["end"]).otherwise(F.lit(0))
    most = F.lit(2**31 - 1)
    plain = lambda a, n: F.substring("body", (a + 1).cast("int"), n.cast("int"))
    quick = lambda a, n: F.array_join(F.slice("chars", (a + 1).cast("int"), n.cast("int")), "")

    def without(cut) -> Column:
        gaps = F.transform("cuts", lambda s, i: F.concat(cut(since(i), s["start"] - since(i)), F.lit(mark)))
        return F.concat(F.array_join(gaps, ""), cut(F.element_at("cuts", -1)["end"], most))

    new = F.when(F.col("chars").isNotNull(), without(quick)).when(F.size("cuts") > 0, without(plain)).otherwise(F.col("body"))
    return out.select(*((new.alias(c) if c.lower() == text.lower() else F.col(f"held.`{c}`").alias(c)) for c in df.columns))
