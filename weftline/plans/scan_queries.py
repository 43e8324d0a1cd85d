"""Queries on scans: paths, configurations, fragments, logs, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analyze as A
from ..operators import community as C
from ..operators import graph as G
from ..operators import paths as P
from .graph_queries import degreed
from .kgview import kg, links, nodes, table
from .registry import query

#: Twelve folders by seventeen names, in SQL that both engines read.
FOLDERS = ("src", "src/tests", "lib/node_modules/pkg", "app", "Web/__Tests__", "conf", "home/.ssh", "docs", "Spec/x", "a/b/c", "x/.git/hooks", "target/debug")
NAMES = (
    "a@.py", "test_x@.py", "y@_test.go", "user@.spec.ts", ".env", ".env.example", ".env.local", "id_rsa", "server@.pem", "credentials.json", "token_store@.py",
    "passwords@.txt", "contest@.md", "Foo@Tests.java", "thing@_spec.rb", "notes@.rst", "scan@.pdf",
)
PATH = (
    "CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{f}/'" for i, f in enumerate(FOLDERS)) + " END || CASE cast(floor(doc_id / 12) AS INT) % 17 "
    + " ".join(f"WHEN {i} THEN replace('{n}', '@', cast(doc_id AS STRING))" for i, n in enumerate(NAMES)) + " END"
)
FILE_SQL = f"""files AS (SELECT *, segs[-1] AS name, list_transform(segs, lambda s: lower(s)) AS low FROM (SELECT doc_id, path, string_split(path, '/') AS segs FROM (SELECT doc_id, {PATH} AS path FROM documents)))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{PATH} AS path")


@query(
    "path_predicates",
    rf"""WITH {FILE_SQL} SELECT doc_id, list_has_any(low, ['tests', 'test', 'spec', 'specs', '__tests__']) OR regexp_matches(lower(name), '^test_.*\.py$|_test\.(py|go|rb|cc|cpp)$|\.(test|spec)\.(js|jsx|ts|tsx|mjs)$|tests?\.(java|cs|kt|swift)$|_spec\.rb$') AS test,
 list_has_any(segs, ['node_modules', '.git', 'target']) AS noise,
 list_contains(low, '.ssh') OR (regexp_matches(name, '^\.env(\..+)?$|\.pem$|^id_rsa') AND NOT ends_with(name, '.example')) OR (regexp_matches(lower(name), '(^|[._-])(credentials?|secrets?|passwords?|token)([._-]|$)') AND NOT regexp_matches(name, '\.(py|go|ts|java|rb)$')) AS sensitive,
 segs[1] AS top FROM files""",
)
def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    is_source = A.language_family(p).isNotNull()
    return files(spark, sf_dir).select("doc_id", P.is_test(p).alias("test"), P.is_noise(p).alias("noise"), P.is_sensitive(p, is_source).alias("sensitive"), A.top_directory(p).alias("top"))


@query(
    "ignore_rules",
    f"""WITH {FILE_SQL} SELECT doc_id, list_contains(segs, 'node_modules') OR list_contains(segs[:-2], 'debug') OR ends_with(name, '.md') OR (segs[1] = 'src' AND ends_with(name, '.py') AND NOT starts_with(name, 'token'))
 OR (regexp_matches(path, '^conf/.*$') AND ends_with(name, '.json')) AS ignored FROM files""",
)
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ["node_modules/", "target/**", "*.md", "/src/**/*.py", "conf/*.json", "!token*.py"]
    return files(spark, sf_dir).select("doc_id", P.is_ignored(F.col("path"), rules).alias("ignored"))


@query(
    "file_categories",
    rf"""WITH {FILE_SQL} SELECT CASE WHEN regexp_matches(name, '\.(py|go|ts|java|rb)$') THEN 'code' WHEN ends_with(name, '.pdf') THEN 'paper' ELSE 'doc' END AS category, count(*) AS n FROM files GROUP BY 1""",
)
def file_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy(A.file_category(F.col("path")).alias("category")).agg(F.count("*").alias("n"))


@query("top_extensions", f"WITH {FILE_SQL} SELECT regexp_extract(path, '\\.([^./]+)$', 1) AS ext, count(*) AS n FROM files GROUP BY 1 ORDER BY n DESC, ext LIMIT 3")
def top_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy(A.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(3)


@query(
    "url_safety",
    r"""WITH u AS (SELECT page_id, CASE page_id % 13 WHEN 1 THEN 'http://192.168.' || page_id % 256 || '.7/x' WHEN 2 THEN 'ftp://h/' || page_id WHEN 3 THEN 'https://LocalHost:8080/' WHEN 4 THEN 'http://user@10.1.2.' || page_id % 256 || '/'
 WHEN 5 THEN 'http://172.' || (12 + page_id % 24) || '.0.1/' WHEN 6 THEN 'HTTPS://example.org?q=127.0.0.1' WHEN 7 THEN 'http:///x' WHEN 8 THEN 'http://127.0.0.1.example.com/' WHEN 9 THEN 'javascript:alert(1)' WHEN 10 THEN 'http://169.254.169.254/' ELSE url END AS url FROM pages),
 h AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)', 2)) AS host FROM u)
 SELECT page_id, regexp_matches(lower(url), '^https?://') AND host <> '' AND host <> 'localhost' AND NOT (regexp_full_match(host, '[0-9.]+') AND (split_part(host, '.', 1) IN ('127', '10') OR starts_with(host, '192.168.')
  OR starts_with(host, '169.254.') OR (starts_with(host, '172.') AND try_cast(split_part(host, '.', 2) AS INT) BETWEEN 16 AND 31))) AS safe FROM h""",
)
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = """CASE page_id % 13 WHEN 1 THEN 'http://192.168.' || page_id % 256 || '.7/x' WHEN 2 THEN 'ftp://h/' || page_id WHEN 3 THEN 'https://LocalHost:8080/' WHEN 4 THEN 'http://user@10.1.2.' || page_id % 256 || '/'
 WHEN 5 THEN 'http://172.' || (12 + page_id % 24) || '.0.1/' WHEN 6 THEN 'HTTPS://example.org?q=127.0.0.1' WHEN 7 THEN 'http:///x' WHEN 8 THEN 'http://127.0.0.1.example.com/' WHEN 9 THEN 'javascript:alert(1)' WHEN 10 THEN 'http://169.254.169.254/' ELSE url END"""
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"{url} AS url").select("page_id", P.public_url(F.col("url")).alias("safe"))


@query(
    "heading_parents",
    """SELECT a.l_orderkey, a.l_linenumber, (SELECT max(b.l_linenumber) FROM h b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber < a.l_linenumber AND b.level < a.level) AS parent
 FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber % 3 + 1 AS level FROM lineitem) a""".replace("FROM h b", "FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber % 3 + 1 AS level FROM lineitem) b"),
)
def heading_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3 + 1).alias("level")).distinct()
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda most: F.last(F.when(F.col("level") < most, F.col("l_linenumber")), ignorenulls=True).over(w)
    return h.select("l_orderkey", "l_linenumber", F.when(F.col("level") == 2, last(2)).when(F.col("level") == 3, last(3)).alias("parent"))


@query(
    "knowledge_gaps",
    kg(r""" SELECT (SELECT count(*) FROM degree WHERE degree <= 1 AND source_file <> '' AND NOT ends_with(label, '()')) AS isolated,
 (SELECT count(*) FROM (SELECT source_file FROM nodes GROUP BY 1 HAVING count(*) FILTER (NOT ends_with(label, '()')) < 3)) AS thin,
 (SELECT 100.0 * count(*) FILTER (confidence = 'AMBIGUOUS') / count(*) > 20 FROM edges) AS ambiguous"""),
)
def knowledge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = degreed(spark, sf_dir)
    isolated = d.where((F.col("degree") <= 1) & ~G.is_file_node() & ~G.is_concept()).agg(F.count("*").alias("isolated"))
    real = d.groupBy("source_file").agg(F.count_if(~F.col("label").endswith("()")).alias("n"))
    thin = real.agg(F.count_if(F.col("n") < 3).alias("thin"))
    share = links(spark, sf_dir).agg((100.0 * F.count_if(F.col("confidence") == "AMBIGUOUS") / F.count("*") > 20).alias("ambiguous"))
    return isolated.crossJoin(thin).crossJoin(share)  # one row each


@query(
    "suggested_questions",
    kg(""", amb AS (SELECT 'ambiguous_edge' AS kind, u || '~' || v AS key, count(*) AS n FROM (SELECT least(src, dst) AS u, greatest(src, dst) AS v FROM edges WHERE confidence = 'AMBIGUOUS') GROUP BY u, v ORDER BY n DESC, key LIMIT 3),
 top AS (SELECT id FROM degree WHERE NOT ends_with(label, '()') ORDER BY degree DESC, id LIMIT 5),
 inf AS (SELECT 'verify_inferred' AS kind, t.id AS key, count(*) AS n FROM top t JOIN edges e ON (e.src = t.id OR e.dst = t.id) AND confidence = 'INFERRED' GROUP BY t.id HAVING count(*) >= 2),
 iso AS (SELECT 'isolated_nodes' AS kind, '' AS key, count(*) AS n FROM degree WHERE degree <= 1 AND source_file <> '' AND NOT ends_with(label, '()') HAVING count(*) > 0)
 SELECT * FROM amb UNION ALL SELECT * FROM inf UNION ALL SELECT * FROM iso"""),
)
def suggested_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = links(spark, sf_dir), degreed(spark, sf_dir)
    unsure = e.where("confidence = 'AMBIGUOUS'").groupBy(F.concat(F.least("src", "dst"), F.lit("~"), F.greatest("src", "dst")).alias("key")).agg(F.count("*").alias("n"))
    unsure = unsure.orderBy(F.desc("n"), "key").limit(3).select(F.lit("ambiguous_edge").alias("kind"), "key", "n")
    top = d.where(~G.is_file_node()).orderBy(F.desc("degree"), "id").limit(5).select("id")
    ends = e.where("confidence = 'INFERRED'").select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).join(F.broadcast(top), "id")  # five rows
    inferred = ends.groupBy("id").agg(F.count("*").alias("n")).where("n >= 2").select(F.lit("verify_inferred").alias("kind"), F.col("id").alias("key"), "n")
    alone = d.where((F.col("degree") <= 1) & ~G.is_file_node() & ~G.is_concept()).agg(F.count("*").alias("n")).where("n > 0")
    return unsure.union(inferred).union(alone.select(F.lit("isolated_nodes"), F.lit(""), "n"))


@query(
    "json_replies",
    """SELECT event_id, CASE WHEN event_id % 5 < 4 THEN cast(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""",
)
def json_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that are fenced, bare, wrapped in prose, or no JSON."""
    reply = """CASE event_id % 5 WHEN 0 THEN 'Sure, here it is:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) || 'Done.' WHEN 1 THEN props WHEN 2 THEN 'The answer is ' || props
 WHEN 3 THEN chr(10) || '```' || chr(10) || props || '```' ELSE 'I can not { do this' END"""
    found = F.from_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0), "k long")
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{reply} AS reply").select("event_id", found["k"].alias("k"))


@query("config_edges", """SELECT DISTINCT 'server_' || (event_id % 50) AS src, 'key_' || unnest(json_keys(props)) AS dst, 'requires_env' AS relation FROM events""")
def config_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key")
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("s"), keys)
    return e.select(F.concat(F.lit("server_"), F.col("s").cast("string")).alias("src"), F.concat(F.lit("key_"), "key").alias("dst"), F.lit("requires_env").alias("relation")).distinct()


@query(
    "cost_estimate",
    """WITH p(lang, price) AS (VALUES ('en', 3.0::DOUBLE), ('de', 1.5::DOUBLE), ('fr', 0.5::DOUBLE)) SELECT lang, cast(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens, round(sum(greatest(1, length(text) // 4)) * price / 1000000.0, 9) AS cost FROM documents LEFT JOIN p USING (lang) GROUP BY lang, price""",
)
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = spark.createDataFrame([("en", 3.0), ("de", 1.5), ("fr", 0.5)], "lang string, price double")
    used = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(T.token_estimate(F.col("text"))).alias("t"))
    return used.join(F.broadcast(price), "lang", "left").select("lang", F.col("t").alias("tokens"), F.round(F.col("t") * F.col("price") / 1e6, 9).alias("cost"))


@query("neutralised_text", r"""SELECT conv_id, turn, md5(regexp_replace('<|im_start|>' || text || '</untrusted>', '<\|[^|>]*\|>|</?untrusted[^>]*>', '[removed]', 'g')) AS sig FROM conversations""")
def neutralised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("<|im_start|>"), "text", F.lit("</untrusted>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.regexp_replace(raw, r"<\|[^|>]*\|>|</?untrusted[^>]*>", "[removed]")).alias("sig"))


@query(
    "module_resolution",
    """WITH f AS (SELECT DISTINCT 'm' || (p_partkey % 90) || CASE p_size % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.ts' ELSE '.js' END AS path FROM part WHERE p_size % 7 < 3),
 s AS (SELECT DISTINCT 'm' || (l_partkey % 120) AS spec FROM lineitem), c AS (SELECT spec, spec || unnest(['.ts', '.js', '/index.ts']) AS path, unnest([1, 2, 3]) AS k FROM s)
 SELECT spec, arg_min(path, k) AS path FROM c JOIN f USING (path) GROUP BY spec""",
)
def module_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.when(F.col("p_size") % 3 == 0, ".ts").when(F.col("p_size") % 3 == 1, "/index.ts").otherwise(".js")
    have = table(spark, sf_dir, "part").where("p_size % 7 < 3").select(F.concat(F.lit("m"), (F.col("p_partkey") % 90).cast("string"), ext).alias("path")).distinct()
    spec = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("m"), (F.col("l_partkey") % 120).cast("string")).alias("spec")).distinct()
    wanted = spec.select("spec", F.posexplode(F.transform(F.array(*map(F.lit, (".ts", ".js", "/index.ts"))), lambda x: F.concat("spec", x))).alias("k", "path"))
    return wanted.join(have, "path").groupBy("spec").agg(F.min_by("path", "k").alias("path"))


@query(
    "reexport_chains",
    """WITH RECURSIVE r AS (SELECT DISTINCT 'b' || (c_custkey % 60) AS src, 'b' || (c_custkey % 60 * 7 % 61) AS dst FROM customer WHERE c_custkey % 60 <> c_custkey % 60 * 7 % 61),
 c AS (SELECT src AS start, dst AS tgt, 1 AS hop FROM r UNION ALL SELECT c.start, r.dst, hop + 1 FROM c JOIN r ON r.src = c.tgt WHERE hop < 8) SELECT start, count(DISTINCT tgt) AS n FROM c GROUP BY start""",
)
def reexport_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 60
    name = lambda c: F.concat(F.lit("b"), c.cast("string"))
    r = table(spark, sf_dir, "customer").select(name(k).alias("src"), name(k * 7 % 61).alias("dst")).where("src <> dst").distinct()
    reached = at = r.select(F.col("src").alias("start"), F.col("dst").alias("at"))
    for _ in range(7):
        at = at.join(r, F.col("at") == F.col("src")).select("start", F.col("dst").alias("at")).distinct()
        reached = reached.union(at)
    return reached.groupBy("start").agg(F.countDistinct("at").alias("n"))


@query(
    "memory_docs",
    r"""SELECT event_id, 'What about ' || event_type || '?' AS question, CASE WHEN event_type = 'error' THEN 'dead_end' ELSE 'useful' END AS outcome, 2 AS n_sources FROM events WHERE event_id % 3 <> 0""",
)
def memory_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.memory import parse_memory

    outcome = F.when(F.col("event_type") == "error", "dead_end").otherwise("useful")
    doc = F.concat(
        F.lit('---\ntype: "query"\ndate: "2024-01-02T03:04:05"\nquestion: "What about '), "event_type", F.lit('?"\noutcome: "'), outcome, F.lit('"\nsource_nodes: ["a", "b"]\n---\n\nAnswer'),
    )
    text = F.when(F.col("event_id") % 3 == 0, "no header").otherwise(doc)
    docs = parse_memory(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text")
    return docs.select("event_id", "question", "outcome", F.size("source_nodes").alias("n_sources"))


@query("mermaid_ids", r"""SELECT p_partkey, substr(trim(regexp_replace(p_name || '!' || p_brand, '[^A-Za-z0-9]+', '_', 'g'), '_'), 1, 40) || '_' || substr(md5(p_name || '!' || p_brand), 1, 7) AS safe FROM part""")
def mermaid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit("!"), "p_brand")
    slug = F.substring(F.trim(F.regexp_replace(raw, "[^A-Za-z0-9]+", "_"), F.lit("_")), 1, 40)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(slug, F.lit("_"), F.substring(F.md5(raw), 1, 7)).alias("safe"))


@query(
    "id_prefixes",
    """SELECT DISTINCT path, array_to_string(string_split(path, '/')[len(string_split(path, '/')) - k + 1:], '_') AS prefix FROM (SELECT DISTINCT source || '/m' || (doc_id % 5) || '/util' AS path FROM documents), (SELECT unnest([1, 2, 3]) AS k)""",
)
def id_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.resolve import suffixes

    path = F.concat("source", F.lit("/m"), (F.col("doc_id") % 5).cast("string"), F.lit("/util"))
    s = suffixes(table(spark, sf_dir, "documents").select(path.alias("path")).distinct(), "path")
    return s.select("path", F.replace("suffix", F.lit("/"), F.lit("_")).alias("prefix"))


@query(
    "section_keywords",
    r"""WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents), n AS (SELECT source, word, count(*) AS n FROM w GROUP BY ALL)
 SELECT source, word, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS k FROM n) WHERE k <= 5""",
)
def section_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")
    n = table(spark, sf_dir, "documents").select("source", words).groupBy("source", "word").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "word"))
    return n.withColumn("k", k).where("k <= 5").drop("k")


@query("content_richness", "SELECT p_partkey, cast((p_name IS NOT NULL)::INT + (p_size % 3 <> 0)::INT + (p_retailprice > 950)::INT AS INTEGER) AS richness FROM part")
def content_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.build import richness

    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("type"), F.when(F.col("p_retailprice") > 950, F.col("p_retailprice")).alias("price"))
    return p.select("p_partkey", richness("p_name", "type", "price").alias("richness"))


@query(
    "shrunk_files",
    kg(""", p AS (SELECT source_file, count(*) AS n FROM nodes GROUP BY 1), f AS (SELECT source_file, count(*) AS n FROM nodes WHERE length(id) % 2 = 0 GROUP BY 1)
 SELECT p.source_file, p.n AS before, coalesce(f.n, 0) AS after FROM p LEFT JOIN f USING (source_file) WHERE coalesce(f.n, 0) < 0.5 * p.n"""),
)
def shrunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    before = n.groupBy("source_file").agg(F.count("*").alias("before"))
    after = n.where("length(id) % 2 = 0").groupBy("source_file").agg(F.count("*").alias("after"))
    j = before.join(after, "source_file", "left").withColumn("after", F.coalesce("after", F.lit(0)))
    return j.where("after < 0.5 * before")


@query(
    "repo_tags",
    "SELECT s_suppkey, tag || CASE WHEN n > 1 THEN '-' || k ELSE '' END AS tag FROM (SELECT s_suppkey, 'r' || s_nationkey AS tag, count(*) OVER (PARTITION BY s_nationkey) AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)",
)
def repo_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey")
    s = table(spark, sf_dir, "supplier").withColumns({"n": F.count("*").over(w), "k": F.row_number().over(w.orderBy("s_suppkey"))})
    tag = F.concat(F.lit("r"), F.col("s_nationkey").cast("string"))
    return s.select("s_suppkey", F.concat(tag, F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise("")).alias("tag"))


@query(
    "canvas_layout",
    kg(" SELECT community, id, cast((k - 1) % 5 * 260 AS INTEGER) AS x, cast((k - 1) // 5 * 120 AS INTEGER) AS y FROM (SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) AS k FROM degree) WHERE k <= 40"),
)
def canvas_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id"))
    d = degreed(spark, sf_dir).withColumn("k", k - 1).where("k < 40")
    return d.select("community", "id", (F.col("k") % 5 * 260).alias("x"), (F.floor(F.col("k") / 5) * 120).cast("int").alias("y"))


@query("query_log", "SELECT event_id, 3 + event_id % 7 AS nodes_returned FROM events")
def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = F.concat(F.lit("Traversal: "), (F.col("event_id") % 7 + 3).cast("string"), F.lit(" nodes found | depth 2"))
    return table(spark, sf_dir, "events").select("event_id", F.regexp_extract(result, r"(\d+) nodes found", 1).cast("long").alias("nodes_returned"))




@query("node_betweenness_sampled", None)
def node_betweenness_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.centrality import betweenness

    return betweenness(G.simple(links(spark, sf_dir)))


@query("split_oversized", None)
def split_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities with over a quarter of all nodes, detected again within themselves."""
    return C.split_large(nodes(spark, sf_dir).select("id", "community"), G.simple(links(spark, sf_dir)))
