"""Queries on scalar functions and on documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as Y
from ..functions import text as T
from ..sources import slices as Z
from .kgview import kg, nodes, table
from .registry import query


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("normalize_id", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '_', 'g'), '_+', '_', 'g'), '_')) AS norm FROM documents")
def normalize_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_id(F.col("text"))).alias("norm"))


@query("label_norm", r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))) AS norm FROM documents")
def label_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_label(F.col("text"))).alias("norm"))


@query("strip_diacritics", "SELECT doc_id, md5(strip_accents(text)) AS plain FROM documents")
def strip_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(T.strip_diacritics(F.col("text"))).alias("plain"))


@query("search_tokens", r"SELECT doc_id, len(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')) AS n, md5(array_to_string(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+'), ' ')) AS sig FROM documents")
def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.search_tokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("sig"))


@query("label_shingles", "SELECT p_partkey, len(list_distinct(list_transform(range(1, greatest(length(p_name) - 1, 2)), lambda i: substr(p_name, i, 3)))) AS n FROM part")
def label_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.size(T.shingles(F.col("p_name"), 3)).cast("long").alias("n"))


@query(
    "label_entropy",
    """WITH c AS (SELECT p_partkey, length(p_name) AS len, unnest(regexp_split_to_array(p_name, '')) AS ch FROM part), n AS (SELECT p_partkey, len, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY ALL)
 SELECT p_partkey, round(-sum(k / len * log2(k / len)), 9) AS entropy FROM n GROUP BY p_partkey""",
)
def label_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(T.entropy(F.col("p_name")), 9).alias("entropy"))


@query(
    "numeric_tokens",
    r"SELECT c_custkey, array_to_string(list_sort(list_transform(regexp_extract_all(c_name || ' v' || (c_custkey % 10) || '.0' || c_nationkey, '\d+'), lambda r: CASE WHEN ltrim(r, '0') = '' THEN '0' ELSE ltrim(r, '0') END)), ',') AS tokens FROM customer",
)
def numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("c_name", F.lit(" v"), (F.col("c_custkey") % 10).cast("string"), F.lit(".0"), F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(T.numeric_tokens(text), ",").alias("tokens"))


VARIANT = r"'^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$'"


@query(
    "variant_guard",
    f"""WITH l AS (SELECT DISTINCT 'm' || p_size || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END AS a FROM part)
 SELECT x.a, y.a AS b FROM l x JOIN l y ON x.a < y.a WHERE greatest(length(x.a), length(y.a)) < 12 AND regexp_matches(x.a, {VARIANT}) AND regexp_matches(y.a, {VARIANT})
 AND regexp_extract(x.a, {VARIANT}, 1) = regexp_extract(y.a, {VARIANT}, 1) AND regexp_extract(x.a, {VARIANT}, 2) <> regexp_extract(y.a, {VARIANT}, 2)""",
)
def variant_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit("m"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "x").otherwise(""))
    labels = table(spark, sf_dir, "part").select(label.alias("a")).distinct()
    stem = F.regexp_extract("a", r"^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$", 1)  # only labels of one stem are pairs
    left, right = labels.select("a", stem.alias("s")), labels.select(F.col("a").alias("b"), F.regexp_extract("a", r"^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$", 1).alias("s"))
    return left.join(right, "s").where("a < b").where(T.variant_pair(F.col("a"), F.col("b"))).select("a", "b")


PATHS_SQL = "(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'plans/Active/' WHEN 1 THEN 'x/archive/y/' WHEN 2 THEN 'old/wip/' WHEN 3 THEN 'notes/' ELSE '' END || source || '/done.md' AS path FROM documents)"


@query(
    "lifecycle_penalty",
    f"SELECT doc_id, CASE WHEN contains(lower(path), 'active/') OR contains(path, 'wip/') THEN 0 WHEN contains(path, 'archive/') THEN 2 ELSE 1 END AS penalty FROM {PATHS_SQL}",
)
def lifecycle_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    top = F.when(k == 0, "plans/Active/").when(k == 1, "x/archive/y/").when(k == 2, "old/wip/").when(k == 3, "notes/").otherwise("")
    return docs(spark, sf_dir).select("doc_id", T.lifecycle_penalty(F.concat(top, "source", F.lit("/done.md"))).alias("penalty"))


@query("bare_names", kg(r" SELECT id, regexp_replace(lower(label), '\(\)$', '') AS bare FROM nodes"))
def bare_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("id", T.bare_name(F.col("label")).alias("bare"))


@query(
    "unique_suffix_labels",
    """WITH f AS (SELECT DISTINCT 'src/' || source || '/m' || (doc_id % 7) || '/util' || (doc_id % 3) || '.py' AS path FROM documents),
 s AS (SELECT path, k, array_to_string(string_split(path, '/')[len(string_split(path, '/')) - k + 1:], '/') AS suffix FROM f, (SELECT unnest(range(1, 5)) AS k)),
 n AS (SELECT suffix, count(DISTINCT path) AS n FROM s GROUP BY suffix) SELECT path, arg_min(suffix, k) AS label FROM s JOIN n USING (suffix) WHERE n.n = 1 GROUP BY path""",
)
def unique_suffix_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.resolve import shortest_unique_suffix

    path = F.concat(F.lit("src/"), "source", F.lit("/m"), (F.col("doc_id") % 7).cast("string"), F.lit("/util"), (F.col("doc_id") % 3).cast("string"), F.lit(".py"))
    return shortest_unique_suffix(docs(spark, sf_dir).select(path.alias("path")).distinct())


@query(
    "jaro_winkler_pairs",
    "WITH l AS (SELECT DISTINCT p_name AS a FROM part) SELECT x.a, y.a AS b, round(jaro_winkler_similarity(x.a, y.a), 9) AS score FROM l x JOIN l y ON x.a < y.a AND substr(x.a, 1, 1) = substr(y.a, 1, 1)",
)
def jaro_winkler_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("score", F.round(Y.jaro_winkler_of(F.col("a"), F.col("b")), 9))


@query(
    "damerau_pairs",
    "WITH l AS (SELECT DISTINCT p_name AS a FROM part) SELECT x.a, y.a AS b, damerau_levenshtein(x.a, y.a) AS d FROM l x JOIN l y ON x.a < y.a AND substr(x.a, 1, 1) = substr(y.a, 1, 1)",
)
def damerau_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("d", Y.damerau_of(F.col("a"), F.col("b")))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct part names that share their first letter."""
    l = table(spark, sf_dir, "part").select(F.col("p_name").alias("a"), F.substring("p_name", 1, 1).alias("k")).distinct()  # noqa: E741
    return l.join(l.withColumnRenamed("a", "b"), "k").where("a < b").select("a", "b")


@query("word_count", r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words, greatest(1, length(text) // 4) AS tokens FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("words"), T.token_estimate(F.col("text")).alias("tokens"))


@query(
    "corpus_totals",
    r"SELECT lang, source, count(*) AS files, cast(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS words, sum(len(regexp_extract_all(text, '\S+'))) > 50000 AS large FROM documents GROUP BY ALL",
)
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = docs(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("files"), F.sum(T.word_count(F.col("text"))).alias("words"))
    return g.withColumn("large", F.col("words") > 50000)


def _signals_sql() -> str:
    tests = " + ".join(f"regexp_matches(substr(text, 1, 3000), '{p}')::INTEGER" for p in T.PAPER_SIGNALS)
    return f"SELECT doc_id, {tests} AS signals, {tests} >= 3 AS paper FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'Abstract. arXiv preprint [12] ' || text ELSE text END AS text FROM documents)"


@query("paper_signals", _signals_sql())
def paper_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("Abstract. arXiv preprint [12] "), "text")).otherwise(F.col("text"))
    d = docs(spark, sf_dir).select("doc_id", T.paper_signals(text).alias("signals"))
    return d.withColumn("paper", F.col("signals") >= 3)


@query("file_hash", "SELECT doc_id, sha256(text || chr(0) || 'd/' || doc_id || '.md') AS hash FROM documents")
def file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("D/"), F.col("doc_id").cast("string"), F.lit(".md"))
    body = T.strip_frontmatter(F.concat(F.lit("---\ntitle: x\n---\n"), "text"))
    return docs(spark, sf_dir).select("doc_id", T.content_hash(body, path).alias("hash"))


@query("html_to_text", r"""SELECT page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 8000) AS text FROM pages""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(
    "url_type",
    r"""SELECT page_id, CASE WHEN contains(lower(url), 'twitter.com') OR contains(lower(url), 'x.com') THEN 'tweet' WHEN contains(lower(url), 'arxiv.org') THEN 'arxiv' WHEN contains(lower(url), 'github.com') THEN 'github'
 WHEN contains(lower(url), 'youtube.com') OR contains(lower(url), 'youtu.be') THEN 'youtube' WHEN ends_with(lower(p), '.pdf') THEN 'pdf' WHEN regexp_matches(lower(p), '\.(png|jpg|jpeg|webp|gif)$') THEN 'image' ELSE 'webpage' END AS kind
 FROM (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM (SELECT page_id, CASE page_id % 4 WHEN 1 THEN url || '/a.PDF?x=1' WHEN 2 THEN replace(url, 'example.org', 'arxiv.org') ELSE url END AS url FROM pages))""",
)
def url_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    url = F.when(k == 1, F.concat("url", F.lit("/a.PDF?x=1"))).when(k == 2, F.replace("url", F.lit("example.org"), F.lit("arxiv.org"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", T.url_type(url).alias("kind"))


@query(
    "url_filename",
    r"""SELECT page_id, substr(regexp_replace(trim(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1), '[^A-Za-z0-9_\-]', '_', 'g'), '_'), '_+', '_', 'g'), 1, 80) || '.md' AS name FROM pages""",
)
def url_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.url_filename(F.col("url"), ".md").alias("name"))


def _last_at(mark: str) -> str:
    """SQL for how many characters of the window lie before its last mark, or null."""
    return f"CASE WHEN contains(w, {mark}) THEN length(w) - strpos(reverse(w), reverse({mark})) - length({mark}) + 1 END"


@query(
    "text_slices",
    f"""WITH RECURSIVE s(doc_id, index, start, stop, text) AS (
  SELECT doc_id, -1, 0, 0, coalesce(text, '') FROM documents
  UNION ALL SELECT doc_id, index + 1, stop, CASE WHEN length(text) - stop <= 2000 THEN length(text) ELSE coalesce(stop + 2 + {_last_at("chr(10) || '#'")}, stop + 3 + {_last_at("chr(10) || chr(10)")}, stop + 2 + {_last_at("chr(10)")}, stop + 2000) END, text
  FROM (SELECT *, substr(text, stop + 2, 1999) AS w FROM s) WHERE index = -1 OR stop < length(text))
 SELECT doc_id, index, start, stop FROM s WHERE index >= 0""",
)
def text_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.slices(docs(spark, sf_dir), "doc_id", "text", 2000)


@query(
    "chunk_packing",
    """WITH RECURSIVE d AS (SELECT doc_id, source, greatest(1, length(text) // 4) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
 p AS (SELECT doc_id, source, tokens, k, 0 AS chunk, tokens AS used FROM d WHERE k = 1
  UNION ALL SELECT d.doc_id, d.source, d.tokens, d.k, CASE WHEN p.used + d.tokens > 4000 THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.used + d.tokens > 4000 THEN d.tokens ELSE p.used + d.tokens END
  FROM p JOIN d ON d.source = p.source AND d.k = p.k + 1) SELECT doc_id, source, tokens, chunk FROM p""",
)
def chunk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = docs(spark, sf_dir).select("doc_id", "source", T.token_estimate(F.col("text")).alias("tokens"))
    return Z.packed(units, "source", "doc_id", "tokens", 4000)


@query(
    "token_reduction",
    "SELECT round(sum(greatest(1, length(text) // 4)) / (SELECT avg(greatest(1, length(text) // 4)) FROM benchmark), 6) AS ratio FROM documents",
)
def token_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = docs(spark, sf_dir).agg(F.sum(T.token_estimate(F.col("text"))).alias("t"))
    each = table(spark, sf_dir, "benchmark").agg(F.avg(T.token_estimate(F.col("text"))).alias("q"))
    return corpus.crossJoin(each).select(F.round(F.col("t") / F.col("q"), 6).alias("ratio"))  # one row each


@query("sanitise_labels", r"SELECT doc_id, substr(regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g'), 1, 256) AS label FROM documents")
def sanitise_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.sanitise(F.col("text")).alias("label"))
