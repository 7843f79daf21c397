"""The registered queries: each a plan over the driver's tables and, beside it, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pages, sketches
from ..functions import text as T
from ..functions import udfs
from ..operators import latent, retrieval, scoring, search, similarity, vector_index
from ..sources import dump
from ..sources.shared import new_folder, written
from ..sources.tables import TABLES, restore_missing, table
from ..streaming import alerts, dashboard
from ..streaming import events as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: An example of a user's word list.
LEXICON = ["idiot", "clown", "trash", "worthless", "pathetic"]
LEXICON_SQL = "[" + ", ".join(f"'{w}'" for w in LEXICON) + "]"


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def q00_counts(spark, d):
    return reduce(
        DataFrame.unionByName,
        (table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in TABLES),
    )


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def q01_title(spark, d):
    return table(spark, d, "pages").select("page_id", T.page_title(F.col("html")).alias("title"))


PAGE_TEXT_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, md5({PAGE_TEXT_SQL}) AS body, length({PAGE_TEXT_SQL}) AS n FROM pages")
def q02_page_text(spark, d):
    body = T.page_text(F.col("html"))
    return (
        table(spark, d, "pages")
        .select("page_id", F.md5(body.cast("binary")).alias("body"), F.char_length(body).cast("long").alias("n"))
    )


@query("SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def q03_hosts(spark, d):
    return table(spark, d, "pages").groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(text) AS n, octet_length(encode(text)) AS bytes, left(upper(lang), 1) AS initial FROM documents")
def q04_lengths(spark, d):
    return (
        table(spark, d, "documents")
        .select(
            "doc_id",
            F.char_length("text").cast("long").alias("n"),
            F.octet_length("text").cast("long").alias("bytes"),
            F.left(F.upper("lang"), F.lit(1)).alias("initial"),
        )
    )


SENTENCES_SQL = "SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?。！？]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)"


@query(f"SELECT doc_id, pos, md5(sentence) AS sentence FROM ({SENTENCES_SQL})")
def q05_sentences(spark, d):
    return (
        table(spark, d, "documents")
        .select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
        .select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("s").cast("binary")).alias("sentence"))
    )


@query(
    """SELECT doc_id, i // 150 AS chunk_no, md5(substring(text, i + 1, 200)) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 150)) AS i
FROM documents)"""
)
def q06_chunks(spark, d):
    return (
        table(spark, d, "documents")
        .select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk_no", "c"))
        .select(
            "doc_id",
            F.col("chunk_no").cast("long").alias("chunk_no"),
            F.md5(F.col("c").cast("binary")).alias("chunk"),
        )
    )


WORDS_SQL = rf"regexp_extract_all(regexp_replace(lower(text), '([{T.UNSPACED}]+)', ' \1 ', 'g'), '{T.WORD}')"
PAIRS_SQL = f"CASE WHEN regexp_matches(x, '^[{T.UNSPACED}]') THEN list_transform(range(1, greatest(length(x) - 1, 1) + 1), lambda i: substring(x, i, 2)) ELSE [x] END"
TOKENS_SQL = f"flatten(list_transform({WORDS_SQL}, lambda x: {PAIRS_SQL}))"


@query(f"SELECT doc_id, len({TOKENS_SQL}) AS n FROM documents")
def q07_token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id, source FROM documents WHERE contains(text, 'worthless')")
def q08_word_filter(spark, d):
    return table(spark, d, "documents").where(F.col("text").contains("worthless")).select("doc_id", "source")


@query(f"SELECT doc_id, w AS word FROM documents, (SELECT unnest({LEXICON_SQL}) AS w) WHERE contains(text, w)")
def q09_contains_join(spark, d):
    return retrieval.contains_join(table(spark, d, "documents"), LEXICON)


@query(f"""WITH l AS (SELECT DISTINCT unnest({TOKENS_SQL}) AS word FROM benchmark), t AS (SELECT doc_id, unnest({TOKENS_SQL}) AS word FROM documents)
SELECT doc_id, word, count(*) AS n FROM t SEMI JOIN l USING (word) GROUP BY ALL""")
def q10_token_join(spark, d):
    lexicon = table(spark, d, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("word"))
    return retrieval.token_join(table(spark, d, "documents"), lexicon).select("doc_id", "word", "n")


@query("SELECT doc_id, len(regexp_extract_all(text, 'the')) AS n FROM documents")
def q11_occurrences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("the")).cast("long").alias("n"))


def _queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 100 = 0")


DOT_SQL = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
COS_SQL = "round({0} / (sqrt({1}) * sqrt({2})), 6)".format(*(DOT_SQL.format(a=a, b=b) for a, b in (("a.embedding", "b.embedding"), ("a.embedding", "a.embedding"), ("b.embedding", "b.embedding"))))


@query(
    f"""SELECT a.vec_id AS query_id, b.vec_id, round({DOT_SQL.format(a='a.embedding', b='b.embedding')}, 4) AS score
FROM embeddings a, embeddings b
WHERE a.vec_id % 100 = 0"""
)
def q12_dot_products(spark, d):
    """A stated query set (ids divisible by 100) against all rows, in bounded blocks."""
    q = _queries(spark, d).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.products(q, table(spark, d, "embeddings"), 4)


@query(
    f"""SELECT query_id, vec_id, rank
FROM (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id
ORDER BY {COS_SQL} DESC, b.vec_id) AS rank
FROM embeddings a, embeddings b
WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
WHERE rank <= 5"""
)
def q13_nearest(spark, d):
    return (
        retrieval.nearest(_queries(spark, d), table(spark, d, "embeddings"))
        .select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))
    )


@query()
def q14_nearest_by_index(spark, d):
    """The neighbours of q13 by an index of product codes, written and read: approximate, so rows only; tests measure the
    recall and what is read."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    index = vector_index.write_index(vectors, new_folder(spark))
    found = vector_index.nearest(index, _queries(spark, d), vectors)
    return found.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


BM25_SQL = f"""d AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, unnest(w) AS term, len(w) AS len FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS_SQL}) AS term FROM benchmark WHERE item_id % 2 = 0),
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term), s GROUP BY query_id, doc_id),
words AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)"""


def _keyword_top(spark, d, k):
    """The benchmark items with even ids, a stated set, as queries over all documents."""
    index = search.write_index(table(spark, d, "documents"), new_folder(spark))
    asked = table(spark, d, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25_top(index, asked, k)


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM words WHERE rank <= 10")
def q58_bm25(spark, d):
    """A report: each query's ten best documents by BM25, exact, from an inverted index that is written and read."""
    return _keyword_top(spark, d, 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {BM25_SQL}, near AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id) AS rank
  FROM (SELECT a.vec_id AS query_id, b.vec_id, {COS_SQL} AS cos FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark WHERE item_id % 2 = 0) AND a.vec_id <> b.vec_id)),
fused AS (SELECT query_id, doc_id, round(coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0), 8) AS score
  FROM (FROM words WHERE rank <= 50) a FULL JOIN (FROM near WHERE rank <= 50) b USING (query_id, doc_id))
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= 10""")
def q15_fusion(spark, d):
    """A report: each query's ten best when its 50 best by BM25 and its 50 nearest vectors are fused.

    The tables don't say which vector is whose text, so vec_id stands for doc_id and item_id here: a made-up link."""
    vectors = table(spark, d, "embeddings")
    asked = table(spark, d, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("vec_id"))
    near = retrieval.nearest(vectors.join(asked, "vec_id", "left_semi"), vectors, 50)
    fused = search.hybrid(_keyword_top(spark, d, 50), near.withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return fused.withColumn("rank", F.col("rank").cast("long"))


CHUNK_RULE_SQL = f"""SELECT doc_id, round(max(len(list_filter({LEXICON_SQL}, lambda w: contains(c, w))) / {len(LEXICON)}), 6) AS rule
FROM (SELECT doc_id, substring(text, i + 1, 200) AS c FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 150)) AS i FROM documents)) GROUP BY doc_id"""
SCORED_SQL = f"SELECT doc_id, coalesce(toxic::DOUBLE, rule) AS score, toxic IS NULL AS by_rule FROM ({CHUNK_RULE_SQL}) LEFT JOIN labels USING (doc_id)"
BAND_SQL = "CASE WHEN score < 0.2 THEN 'none' WHEN score < 0.4 THEN 'low' WHEN score < 0.6 THEN 'medium' WHEN score < 0.8 THEN 'high' ELSE 'severe' END"


@query(SCORED_SQL)
def q16_label_or_rule(spark, d):
    return scoring.label_or_rule(table(spark, d, "documents"), table(spark, d, "labels"), LEXICON)


@query(
    f"""SELECT {BAND_SQL} AS band, count(*) AS n, round(avg(score), 6) AS mean, count_if(by_rule) AS by_rule
FROM ({SCORED_SQL})
GROUP BY 1"""
)
def q17_bands(spark, d):
    scored = q16_label_or_rule(spark, d)
    return (
        scored
        .groupBy(scoring.band(F.col("score")).alias("band"))
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("score"), 6).alias("mean"),
            F.count_if("by_rule").alias("by_rule"),
        )
    )


@query(
    f"""SELECT doc_id, pos, sentence, len(list_filter({LEXICON_SQL}, lambda w: contains(sentence, w))) AS hits
FROM ({SENTENCES_SQL})
WHERE len(list_filter({LEXICON_SQL}, lambda w: contains(sentence, w))) > 0"""
)
def q18_evidence(spark, d):
    return (
        retrieval.evidence(table(spark, d, "documents"), LEXICON)
        .select(
            "doc_id",
            F.col("pos").cast("long").alias("pos"),
            "sentence",
            F.col("hits").cast("long").alias("hits"),
        )
    )


@query("SELECT source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def q19_lookup(spark, d):
    return (
        table(spark, d, "documents")
        .select("doc_id", "source")
        .join(table(spark, d, "labels"), "doc_id")
        .groupBy("source", "quality")
        .agg(F.count("*").alias("n"))
    )


@query(
    """SELECT lang, source, grouping(lang) * 2 + grouping(source) AS level, count(*) AS n, sum(n_chars)::BIGINT AS chars
FROM documents
GROUP BY ROLLUP (lang, source)"""
)
def q20_rollup(spark, d):
    return (
        table(spark, d, "documents")
        .rollup("lang", "source")
        .agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    )


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY CUBE (quality, toxic)")
def q21_cube(spark, d):
    return table(spark, d, "labels").cube("quality", "toxic").agg(F.count("*").alias("n"))


@query("SELECT lang, quantile_cont(n_chars, 0.5) AS median, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang")
def q22_median(spark, d):
    return (
        table(spark, d, "documents")
        .groupBy("lang")
        .agg(
            F.percentile("n_chars", F.lit(0.5)).alias("median"),
            F.min("n_chars").alias("least"),
            F.max("n_chars").alias("most"),
        )
    )


@query("""SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def q23_star(spark, d):
    t = lambda n: table(spark, d, n)
    rows = (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return rows.groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def q24_missing(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    labelled = docs.join(table(spark, d, "labels"), "doc_id", "left_semi")
    return restore_missing(labelled, docs, "doc_id").join(labelled, "doc_id", "left_anti")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q25_key_collisions(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query(
    """SELECT bool_and(quality IN (0, 1)) AS quality_ok, bool_and(toxic IN (0, 1)) AS toxic_ok, bool_or(toxic = 1) AS any_toxic
FROM labels"""
)
def q26_flags(spark, d):
    return (
        table(spark, d, "labels")
        .agg(
            F.bool_and(F.col("quality").isin(0, 1)).alias("quality_ok"),
            F.bool_and(F.col("toxic").isin(0, 1)).alias("toxic_ok"),
            F.bool_or(F.col("toxic") == 1).alias("any_toxic"),
        )
    )


@query("""SELECT 'intersect' AS op, doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL
SELECT 'except', doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'union', doc_id FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)""")
def q27_sets(spark, d):
    a, b = (table(spark, d, t).select("doc_id") for t in ("documents", "labels"))
    named = {"intersect": a.intersect(b), "except": a.subtract(b), "union": a.union(b).distinct()}
    return reduce(DataFrame.unionByName, (x.select(F.lit(k).alias("op"), "doc_id") for k, x in named.items()))


@query("""SELECT event_id, rank() OVER u AS rk, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS dr, ntile(4) OVER u AS quarter, lag(value) OVER u AS before, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last3
FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def q28_windows(spark, d):
    u = Window.partitionBy("user_id").orderBy("ts", "event_id")
    long = lambda c: c.cast("long")
    return table(spark, d, "events").select(
        "event_id", long(F.rank().over(u)).alias("rk"), long(F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type"))).alias("dr"),
        long(F.ntile(4).over(u)).alias("quarter"), F.lag("value").over(u).alias("before"), F.round(F.sum("value").over(u.rowsBetween(-2, 0)), 4).alias("last3"),
    )


@query("SELECT event_type, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type")
def q29_json(spark, d):
    return (
        table(spark, d, "events")
        .groupBy("event_type")
        .agg(F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("k"))
    )


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS turns FROM conversations GROUP BY conv_id")
def q30_roles(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return (
        table(spark, d, "conversations")
        .groupBy("conv_id")
        .agg(F.array_join(F.transform(turns, lambda x: x["role"]), ">").alias("roles"), F.count("*").alias("turns"))
    )


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    """SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events
GROUP BY ALL"""
)
def q31_tumbling(spark, d):
    return E.tumbling(_events(spark, d)).withColumn("start", F.unix_timestamp("start"))


@query(
    """SELECT epoch(time_bucket(INTERVAL 15 MINUTES, ts) - INTERVAL 15 MINUTES * i)::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events, range(4) r(i)
GROUP BY ALL"""
)
def q31_sliding(spark, d):
    return E.tumbling(_events(spark, d), "1 hour", "15 minutes").withColumn("start", F.unix_timestamp("start"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER u + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def q32_sessions(spark, d):
    return E.sessions(_events(spark, d)).withColumn("start", F.unix_micros("start"))


@query(SQL["q31_tumbling"])
def q33_stream_windows(spark, d):
    """The tumbling windows as a stream run to its end, in complete mode."""
    found = E.run_to_end(E.tumbling(E.read_events(spark, d)), "complete")
    return found.withColumn("start", F.unix_timestamp("start"))


@query(SQL["q32_sessions"])
def q33_stream_sessions(spark, d):
    found = E.run_to_end(E.sessions(E.read_events(spark, d)), "complete")
    return found.withColumn("start", F.unix_micros("start"))


@query("SELECT event_id, user_id, event_type FROM events")
def q33_stream_dedup(spark, d):
    """Every event comes twice; the stream's own state leaves one."""
    twice = E.read_events(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return E.run_to_end(E.distinct_events(twice).select("event_id", "user_id", "event_type"), "append")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def q33_stream_state(spark, d):
    """State of our own for each user; of a user's rows in several batches the last one counts."""
    rows = E.run_to_end(E.totals(E.read_events(spark, d)), "update")
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return last.select("user_id", "x.n", F.round("x.total", 4).alias("total"))


@query(SQL["q31_sliding"])
def q33_stream_sliding(spark, d):
    """The sliding windows as a stream."""
    found = E.run_to_end(E.tumbling(E.read_events(spark, d), "1 hour", "15 minutes"), "complete")
    return found.withColumn("start", F.unix_timestamp("start"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER u + INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS began, epoch_us(max(ts)) AS ended, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 13 HOURS <= (SELECT max(ts) FROM events)""")
def q33_stream_silences(spark, d):
    """Users who fell silent for over 12 hours, by timers in event time and state in RocksDB."""
    with alerts.rocksdb(spark):
        found = E.run_to_end(alerts.silences(E.read_events(spark, d)), "append")
    return found.withColumns({c: F.unix_micros(c) for c in ("began", "ended")})


@query("SELECT doc_id, round(length(text) / 1000, 6) AS score FROM documents")
def q34_scorer_hook(spark, d):
    scored = scoring.with_scorer(table(spark, d, "documents").select("doc_id", "text"), lambda texts: texts.str.len() / 1000)
    return scored.select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def q35_grouping_sets(spark, d):
    return table(spark, d, "documents").groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) FILTER (WHERE n_chars > 1000) AS n_long, count(*) AS n FROM documents GROUP BY lang")
def q36_filtered(spark, d):
    return (
        table(spark, d, "documents")
        .groupBy("lang")
        .agg(F.count_if(F.col("n_chars") > 1000).alias("n_long"), F.count("*").alias("n"))
    )


@query(
    """SELECT event_type, count(*) FILTER (WHERE dayofmonth(ts) % 3 = 0) AS d0, count(*) FILTER (WHERE dayofmonth(ts) % 3 = 1) AS d1, count(*) FILTER (WHERE dayofmonth(ts) % 3 = 2) AS d2
FROM events
GROUP BY event_type"""
)
def q37_pivot(spark, d):
    rows = table(spark, d, "events").select("event_type", F.concat(F.lit("d"), F.dayofmonth("ts") % 3).alias("k"))
    return rows.groupBy("event_type").pivot("k", ["d0", "d1", "d2"]).count().na.fill(0)


@query("SELECT doc_id FROM documents o WHERE n_chars > (SELECT avg(n_chars) FROM documents i WHERE i.lang = o.lang)")
def q38_above_mean(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(docs.groupBy("lang").agg(F.avg("n_chars").alias("mean")), "lang").where("n_chars > mean").select("doc_id")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def q39_exists(spark, d):
    return (
        table(spark, d, "customer")
        .join(
            table(spark, d, "orders").where("o_totalprice > 200000"),
            F.col("c_custkey") == F.col("o_custkey"),
            "left_semi",
        )
        .select("c_custkey")
    )


@query("""WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT e.event_id, p.value AS value_as_of FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def q40_as_of(spark, d):
    events = table(spark, d, "events")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return (
        E.as_of(
            events.where("event_type = 'click'").select("event_id", "user_id", "ts"),
            bought,
            "user_id",
            "ts",
            "value",
        )
        .select("event_id", "value_as_of")
    )


@query(
    """SELECT a.event_id, count(b.event_id) AS n
FROM events a
LEFT
JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts
WHERE a.event_type = 'error'
GROUP BY ALL"""
)
def q41_range_join(spark, d):
    """Events in the hour before an error: hours are the join's buckets, so a user's rows never all meet."""
    ev = table(spark, d, "events").withColumn("h", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000))
    a = (
        ev
        .where("event_type = 'error'")
        .select(
            "event_id",
            "user_id",
            F.col("ts").alias("at"),
            F.explode(F.array(F.col("h"), F.col("h") - 1)).alias("h"),
        )
    )
    b = ev.select("user_id", "h", "ts", F.lit(1).alias("one"))
    near = (F.col("ts") <= F.col("at")) & (F.col("ts") >= F.col("at") - F.expr("interval 1 hour"))
    return a.join(b, ["user_id", "h"]).where(near).groupBy("event_id").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY 1")
def q42_distinct(spark, d):
    return (
        table(spark, d, "lineitem")
        .groupBy("l_returnflag")
        .agg(F.count_distinct("l_orderkey").alias("orders"), F.round(F.stddev("l_quantity"), 6).alias("sd"))
    )


PHRASES_SQL = f"SELECT DISTINCT array_to_string({TOKENS_SQL}[1:2], ' ') AS phrase FROM benchmark"
BODY_SQL = f"' ' || array_to_string({TOKENS_SQL}, ' ') || ' '"


@query(f"""WITH p AS (SELECT * FROM ({PHRASES_SQL}) WHERE phrase <> ''), d AS (SELECT doc_id, {BODY_SQL} AS body FROM documents)
SELECT doc_id, phrase FROM d, p WHERE contains(body, ' ' || phrase || ' ')""")
def q43_phrase_lexicon(spark, d):
    """A lexicon that is a table: the first two tokens of each benchmark item, sought in all documents."""
    lexicon = table(spark, d, "benchmark").select(F.array_join(F.slice(T.tokens(F.col("text")), 1, 2), " ").alias("phrase"))
    return retrieval.phrase_join(table(spark, d, "documents"), lexicon)


RUNS_SQL = "SELECT DISTINCT {key}, array_to_string(t[i:i + 7], ' ') AS run FROM (SELECT {key}, t, unnest(range(1, len(t) - 6)) AS i FROM (SELECT {key}, {tokens} AS t FROM {table}))"


@query(f"""WITH a AS ({RUNS_SQL.format(key='doc_id', tokens=TOKENS_SQL, table='documents')}), b AS ({RUNS_SQL.format(key='item_id', tokens=TOKENS_SQL, table='benchmark')})
SELECT doc_id, item_id, count(*) AS shared FROM a JOIN b USING (run) GROUP BY ALL""")
def q44_cases(spark, d):
    """Case lookup: which benchmark items a document shares runs of eight tokens with."""
    return retrieval.cases(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("SELECT doc_id, coalesce(toxic::DOUBLE, round(length(text) / 100000, 6)) AS score FROM documents LEFT JOIN labels USING (doc_id)")
def q45_judged(spark, d):
    """A label if there is one, else a model's score (here a function of the length), at most two calls at once."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    scored = scoring.judged(docs, labels, lambda texts: texts.str.len() / 100_000, calls=2)
    return scored.select("doc_id", F.round("score", 6).alias("score"))


@query("""SELECT 'intersect' AS op, event_type, n FROM (SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events WHERE user_id % 2 = 0 INTERSECT ALL SELECT event_type FROM events WHERE user_id % 3 = 0) GROUP BY 1)
UNION ALL SELECT 'except', event_type, n FROM (SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events WHERE user_id % 2 = 0 EXCEPT ALL SELECT event_type FROM events WHERE user_id % 3 = 0) GROUP BY 1)""")
def q46_set_all(spark, d):
    """INTERSECT ALL and EXCEPT ALL keep repeated rows."""
    kinds = lambda k: table(spark, d, "events").where(f"user_id % {k} = 0").select("event_type")
    named = {"intersect": kinds(2).intersectAll(kinds(3)), "except": kinds(2).exceptAll(kinds(3))}
    return reduce(
        DataFrame.unionByName,
        (x.groupBy("event_type").agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "event_type", "n") for k, x in named.items()),
    )


@query("""SELECT event_id, lead(value) OVER u AS after, first_value(value) OVER u AS first, last_value(value) OVER w AS last, nth_value(value, 2) OVER w AS second,
round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS last_hour
FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id ORDER BY event_type), w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def q47_more_windows(spark, d):
    u, v = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy("event_type")
    w = u.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = {"after": F.lead("value").over(u), "first": F.first("value").over(u), "last": F.last("value").over(w), "second": F.nth_value("value", 2).over(w)}
    rows = (
        table(spark, d, "events")
        .withColumns({**named, "pr": F.round(F.percent_rank().over(v), 6), "cd": F.round(F.cume_dist().over(v), 6)})
    )
    hour = F.expr("count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)")
    return rows.withColumn("last_hour", hour).select("event_id", *named, "pr", "cd", "last_hour")


@query("""SELECT event_id, lpad(event_type, 10, '.') AS padded, rpad(event_type, 10, '.') AS filled, replace(event_type, 'i', '1') AS swapped, levenshtein(event_type, 'click') AS distance,
try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, date_trunc('week', ts)::DATE AS week, date_diff('day', DATE '2024-01-01', ts::DATE) AS days, strftime(ts, '%Y-%m') AS month FROM events""")
def q48_scalars(spark, d):
    """Pad, replace, edit distance, variant from JSON, date parts."""
    k = F.variant_get(F.parse_json("props"), "$.k", "long")
    return table(spark, d, "events").select(
        "event_id", F.lpad("event_type", 10, ".").alias("padded"), F.rpad("event_type", 10, ".").alias("filled"), F.replace("event_type", F.lit("i"), F.lit("1")).alias("swapped"),
        F.levenshtein("event_type", F.lit("click")).cast("long").alias("distance"), k.alias("k"), F.date_trunc("week", "ts").cast("date").alias("week"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("days"), F.date_format("ts", "yyyy-MM").alias("month"),
    )


@query("""SELECT user_id, coalesce(sum(n) FILTER (WHERE event_type = 'click'), 0)::BIGINT AS clicks, count(*) AS kinds, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS listed
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def q49_maps(spark, d):
    """A map of counts for each user: built, looked up and listed."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    counts = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    listed = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    found = F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0))
    return counts.select(
        "user_id",
        found.cast("long").alias("clicks"),
        F.size("m").cast("long").alias("kinds"),
        F.array_join(listed, ",").alias("listed"),
    )


@query(
    f"""SELECT doc_id, len({TOKENS_SQL}) AS n, len(list_distinct({TOKENS_SQL})) AS kinds, array_to_string({TOKENS_SQL}[2:4], ' ') AS some, list_contains({TOKENS_SQL}, 'the') AS has_the
FROM documents"""
)
def q50_arrays(spark, d):
    words = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    return words.select(
        "doc_id",
        F.size("w").cast("long").alias("n"),
        F.size(F.array_distinct("w")).cast("long").alias("kinds"),
        F.array_join(F.slice("w", 2, 3), " ").alias("some"),
        F.exists("w", lambda w: w == "the").alias("has_the"),
    )


@query()
def q51_approximate_distinct(spark, d):
    """Approximate: rows only; tests hold it to 10 % of the exact count."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey").alias("orders"))


@query("SELECT o_orderpriority, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def q52_merge_hint(spark, d):
    """Two large sides: a sort-merge join asked for; q53 asks for hashing of the shuffled sides."""
    lines = table(spark, d, "lineitem").hint("merge")
    return (
        lines
        .join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_orderpriority")
        .agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    )


@query("SELECT o_orderpriority, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def q53_shuffle_hash_hint(spark, d):
    orders = table(spark, d, "orders").hint("shuffle_hash")
    return (
        table(spark, d, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_orderpriority")
        .agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    )


@query("SELECT doc_id, len(regexp_extract_all(text, '[aeiou]')) AS n FROM documents")
def q54_scalar_udf(spark, d):
    return table(spark, d, "documents").select("doc_id", udfs.vowels("text").alias("n"))


@query("SELECT lang, (max(n_chars) - min(n_chars))::DOUBLE AS spread FROM documents GROUP BY lang")
def q55_aggregate_udf(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(udfs.spread("n_chars").alias("spread"))


@query(
    r"""SELECT conv_id, turn, i - 1 AS pos, w[i] AS word
FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i
FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w
FROM conversations))"""
)
def q56_table_udf(spark, d):
    udfs.register(spark)
    table(spark, d, "conversations").createOrReplaceTempView("q56_conversations")
    return spark.sql("SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, word FROM q56_conversations, LATERAL words_of(text)")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch(o_orderdate)::BIGINT AS ordered, o_orderpriority FROM orders")
def q57_custom_source(spark, d):
    """A source of its own: a dump of INSERT statements, written from a table and read back in ranges of bytes."""
    orders, folder = table(spark, d, "orders"), new_folder(spark)
    dump.write(orders, folder, "orders")
    back = dump.read(spark, folder, "orders", orders.schema, split=1 << 20)
    return back.withColumn("ordered", F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).drop("o_orderdate")


@query("SELECT doc_id, md5(text) AS text, lang, source, n_chars FROM documents")
def q59_dumped_texts(spark, d):
    """Texts with quotes, backslashes and line breaks through a dump."""
    docs, folder = table(spark, d, "documents"), new_folder(spark)
    dump.write(docs, folder, "documents")
    back = dump.read(spark, folder, "documents", docs.schema, split=8 << 20)
    return back.withColumn("text", F.md5(F.col("text").cast("binary")))


@query(SQL["q20_rollup"])
def q60_kept_dashboard(spark, d):
    """The rollup of q20 from a kept table that a stream's batches are merged into."""
    kept = dashboard.Dashboard(spark, new_folder(spark), ["lang", "source"], ["n_chars"])
    docs = E.read_table(spark, d, "documents")
    docs.writeStream.option("checkpointLocation", new_folder(spark)).trigger(availableNow=True).foreachBatch(kept.merge).start().awaitTermination()
    levels = kept.table().rollup("lang", "source")
    return levels.agg(F.grouping_id().alias("level"), F.sum("n").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, round(length(text) / 100000, 6) AS score FROM documents")
def q61_ledger(spark, d):
    """A model's scores (here a function of the length), with answers kept in a ledger: each text is asked for once."""
    scored = scoring.with_ledger(table(spark, d, "documents"), lambda texts: texts.str.len() / 100_000, new_folder(spark), calls=4)
    return scored.select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT event_type, count(*) AS n, true AS users_close, true AS values_close FROM events GROUP BY 1")
def q62_sketches(spark, d):
    """Sketches kept by day and merged: users within 5 % of the exact number, three quantiles within 3 % of their ranks."""
    events, folder = _events(spark, d), new_folder(spark)
    sketches.daily(events, ["event_type"], "user_id", "value").write.parquet(folder)
    ranks = [0.25, 0.5, 0.75]
    got = sketches.estimates(sketches.merged(spark.read.parquet(folder), ["event_type"]), ["event_type"], ranks)
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.percentile("value", F.array(*(F.lit(max(0.0, r + e)) for r in ranks for e in (-0.03, 0.03)))).alias("bounds"))
    close = [F.col("quantiles")[i].between(F.col("bounds")[2 * i], F.col("bounds")[2 * i + 1]) for i in range(3)]
    users = F.abs(F.col("distinct") - F.col("users")) <= 0.05 * F.col("users")
    return got.join(exact, "event_type").select("event_type", "n", users.alias("users_close"), reduce(lambda a, b: a & b, close).alias("values_close"))


@query(
    f"""SELECT page_id, count(*) AS blocks, count(*) FILTER (WHERE kept) AS kept, md5(coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE kept), '')) AS body
FROM ({pages.blocks_sql()}) GROUP BY page_id"""
)
def q63_body_text(spark, d):
    """Body text by the density of text and links in blocks; comments, quoted > in tags and character references are read."""
    blocks = table(spark, d, "pages").select("page_id", pages.page_blocks(F.col("html")).alias("blocks"))
    kept = F.size(F.filter("blocks", lambda b: b["kept"])).cast("long")
    body = F.md5(pages.body_text(F.col("blocks")).cast("binary"))
    return blocks.where(F.size("blocks") > 0).select("page_id", F.size("blocks").cast("long").alias("blocks"), kept.alias("kept"), body.alias("body"))


@query()
def q64_similarity_join(spark, d):
    """Documents whose latent vectors (q65) have a cosine of 0.95 or more to others, counted over all pairs."""
    vectors = written(q65_text_vectors(spark, d).withColumnRenamed("doc_id", "vec_id"))
    return similarity.similarity_join(vectors, 0.95)


@query()
def q65_text_vectors(spark, d):
    """Documents as unit vectors of latent directions, fitted on all of them."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    # dealt out, as a table may be one file of one row group
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = written(latent.counted(docs.repartition(spread)))
    return latent.embedded_on(found, latent.fitted_on(found))
