"""Queries on names for display and search, and on fragments, caches and links.

Inputs are projections of the tables, written once in SQL that both engines read; the results
are worked out by operators here and by plain SQL there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display as D
from ..operators import fragments as R
from ..operators import linking as L
from .kgview import edges, kg, links, nodes, table
from .registry import query

LABEL = """CASE p_partkey % 9 WHEN 0 THEN '.' || lower(p_brand) || '()' WHEN 1 THEN 'src/' || p_partkey || '.py' WHEN 2 THEN '' WHEN 3 THEN p_name || ' ' || p_name || ' ' || p_type
 || ' ' || p_name WHEN 4 THEN 'alpha_beta_gamma_delta_epsilon_' || p_partkey WHEN 5 THEN 'test_' || p_size WHEN 6 THEN 'use' || p_type WHEN 7 THEN 'Part' || p_size ELSE lower(p_name) || '()' END"""
SOURCE = "CASE p_size % 4 WHEN 0 THEN 'tests/a' || p_size || '.py' WHEN 1 THEN 'web/b' || p_size || '.tsx' WHEN 2 THEN '' ELSE 'core/c' || p_size || '.go' END"
KIND = "CASE p_partkey % 7 WHEN 0 THEN 'document' ELSE 'code' END"
TYPE = "CASE p_partkey % 11 WHEN 0 THEN 'interface' WHEN 1 THEN 'Route' ELSE '' END"


def given(spark: SparkSession, sf_dir: str, of: str, /, **columns: str) -> DataFrame:
    return table(spark, sf_dir, of).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def given_sql(of: str, /, **columns: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {of}"


PARTS = {"k": "p_partkey", "label": LABEL, "source": SOURCE, "file_type": KIND, "node_type": TYPE}


@query(
    "humanized_labels",
    f"""WITH i AS ({given_sql("part", **PARTS)}), t AS (SELECT k, trim(label) AS l, source, list_filter(string_split(trim(label), '_'), lambda x: x <> '') AS ps FROM i),
 s AS (SELECT *, CASE WHEN contains(l, '_') AND NOT contains(l, ' ') AND length(l) > 28 AND len(ps) > 0 THEN array_to_string(ps[greatest(1, len(ps) - 2):], ' ') ELSE l END AS short FROM t)
 SELECT k, CASE WHEN l = '' THEN CASE WHEN source <> '' THEN parse_filename(source) ELSE 'Unknown' END WHEN starts_with(l, '.') AND ends_with(l, '()') THEN l[2:]
 WHEN regexp_matches(l, '\\.(py|ts|tsx|js|jsx|go|rs|java|rb)$') THEN parse_filename(l) WHEN length(short) > 42 THEN rtrim(short[:39]) || '...' ELSE short END AS name FROM s""",
)
def humanized_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "part", **PARTS).select("k", D.humanized(F.col("label"), F.col("source")).alias("name"))


@query(
    "node_kinds",
    f"""WITH i AS ({given_sql("part", **PARTS)}), t AS (SELECT *, lower(label) AS l, lower(source) AS s, lower(node_type) AS y FROM i)
 SELECT k, CASE WHEN y IN ('class', 'klass', 'struct', 'interface', 'enum', 'trait', 'model') THEN 'klass' WHEN y IN ('endpoint', 'route', 'api', 'handler', 'controller') THEN 'api'
 WHEN file_type IN ('rationale', 'document') THEN 'concept' WHEN contains(s, 'test') OR starts_with(l, 'test_') OR contains(s, 'spec') THEN 'test'
 WHEN regexp_matches(l, 'endpoint|router|api|route') THEN 'api' WHEN regexp_matches(l, 'cli|command|click|typer') THEN 'entry' WHEN regexp_matches(l, 'async|await|stream|sse') THEN 'async'
 WHEN regexp_matches(l, 'component|props|hook|store') OR regexp_matches(label, '^use[A-Z_-]') OR regexp_matches(s, '\\.(tsx|jsx|vue|svelte)$') THEN 'ui'
 WHEN regexp_matches(label, '^\\p{{Lu}}') AND NOT ends_with(label, '()') THEN 'klass' WHEN regexp_matches(label, '\\.(py|go)$') THEN 'module' ELSE 'function' END AS kind FROM t""",
)
def node_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "part", **PARTS).select("k", D.node_kind(F.col("label"), F.col("source"), F.col("file_type"), F.col("node_type")).alias("kind"))


@query("relation_names", kg(" SELECT relation, CASE relation WHEN 'imports_from' THEN 'imports' ELSE replace(relation, '_', ' ') END AS name, count(*) AS n FROM edges GROUP BY relation"))
def relation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).groupBy("relation").agg(F.count("*").alias("n")).select("relation", D.relation_name(F.col("relation")).alias("name"), "n")


BUILTIN = {"k": "p_partkey", "label": "CASE p_partkey % 5 WHEN 0 THEN 'Path' WHEN 1 THEN 'path' WHEN 2 THEN 'MagicMock' WHEN 3 THEN p_brand ELSE 'UUID' END"}


@query("builtin_labels", f"SELECT label, count(*) AS n, label IN ('Path', 'MagicMock', 'UUID') AS builtin FROM ({given_sql('part', **BUILTIN)}) GROUP BY label")
def builtin_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = given(spark, sf_dir, "part", **BUILTIN).groupBy("label").agg(F.count("*").alias("n"))
    return counted.select("label", "n", D.is_builtin(F.col("label")).alias("builtin"))


@query(
    "callable_labels",
    f"""WITH i AS ({given_sql("part", **PARTS)}) SELECT k, file_type = 'code' AND ends_with(trim(label), ')') AND NOT contains(label, '.') AS free_function,
 file_type = 'code' AND regexp_matches(trim(label), '^\\p{{Lu}}[\\p{{L}}\\p{{N}}_]*$') AS type_like FROM i""",
)
def callable_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, kind = F.col("label"), F.col("file_type")
    return given(spark, sf_dir, "part", **PARTS).select("k", D.is_free_function(label, kind).alias("free_function"), D.is_type_like(label, kind).alias("type_like"))


PATHS = {
    "k": "o_orderkey",
    "path": r"CASE o_orderkey % 6 WHEN 0 THEN '/srv/app/src/f' || o_custkey || '.py' WHEN 1 THEN 'src' || chr(92) || 'win' || chr(92) || o_custkey || '.py' WHEN 2 THEN './src//a' || o_custkey || '.py' "
    r"WHEN 3 THEN '/other/x' || o_custkey WHEN 4 THEN 'load' || o_custkey || '()' ELSE '/srv/application/' || o_custkey END",
}


@query(
    "normalized_paths",
    f"SELECT k, CASE WHEN starts_with(p, '/srv/app/') THEN p[10:] ELSE p END AS path FROM (SELECT k, replace(path, chr(92), '/') AS p FROM ({given_sql('orders', **PATHS)}))",
)
def normalized_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "orders", **PATHS).select("k", D.normalized_path(F.col("path"), F.lit("/srv/app")).alias("path"))


@query(
    "repo_relative_paths",
    f"""SELECT k, CASE k % 6 WHEN 0 THEN path[10:] WHEN 2 THEN 'src/a' || path[9:] ELSE path END AS path FROM ({given_sql('orders', **PATHS)})""",
)
def repo_relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "orders", **PATHS).select("k", D.repo_relative(F.col("path"), F.lit("/srv/app/")).alias("path"))


@query("attribute_texts", "SELECT p_partkey AS k, lower('brand ' || p_brand || ' size ' || p_size || CASE WHEN p_partkey % 3 = 0 THEN ' type' ELSE ' type ' || p_type END) AS text FROM part")
def attribute_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = (("type", F.when(F.col("p_partkey") % 3 != 0, F.col("p_type"))), ("brand", F.col("p_brand")), ("size", F.col("p_size").cast("string")))
    attributes = F.create_map(*(x for k, v in pairs for x in (F.lit(k), v)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), D.attribute_text(attributes).alias("text"))


@query(
    "search_texts",
    kg(r""" SELECT id, md5(lower(label) || chr(1) || array_to_string(regexp_extract_all(lower(label), '[\p{L}\p{N}]+'), ' ') || chr(1) || lower(id) || chr(1) || lower(source_file) || chr(1)
 || array_to_string(regexp_extract_all(lower(source_file), '[\p{L}\p{N}]+'), ' ')) AS sig FROM nodes"""),
)
def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = D.search_text(F.col("label"), F.col("id"), F.col("source_file"))
    return nodes(spark, sf_dir).select("id", F.md5(F.replace(text, F.lit("\0"), F.lit("\1"))).alias("sig"))


JSONC = """'{"a' || p_partkey || '": "x // y", // note ' || p_size || chr(10) || '"b": [1, 2' || CASE WHEN p_size % 2 = 0 THEN ',' ELSE '' END || ' ], /* c ' || p_type || ' */ "d": "/* e */"' || CASE WHEN p_size % 3 = 0 THEN ' , ' ELSE '' END || '}'"""


@query(
    "jsonc_values",
    "SELECT p_partkey AS k, md5('{\"a' || p_partkey || '\": \"x // y\", ' || chr(10) || '\"b\": [1, 2 ],  \"d\": \"/* e */\"' || CASE WHEN p_size % 3 = 0 THEN '  ' ELSE '' END || '}') AS sig FROM part",
)
def jsonc_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "part", k="p_partkey", text=JSONC.replace("chr(10)", "char(10)")).select("k", F.md5(D.strip_jsonc(F.col("text"))).alias("sig"))


@query("node_lines", kg(" SELECT md5('NODE ' || label || ' [src=' || source_file || ' community=' || community || ']') AS sig FROM nodes"))
def node_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select(F.md5(D.node_line(F.col("label"), F.col("source_file"), F.col("community"))).alias("sig"))


@query(
    "edge_lines",
    kg(""" SELECT md5('EDGE ' || src || ' --' || relation || ' [' || confidence || ' context=' || context || ']--> ' || dst || CASE WHEN source_location IS NULL THEN '' ELSE ' at=' || source_file || ':' || source_location END) AS sig,
 count(*) AS n FROM edges GROUP BY 1"""),
)
def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = D.edge_line(*map(F.col, ("src", "dst", "relation", "confidence", "context", "source_file", "source_location")))
    return edges(spark, sf_dir).groupBy(F.md5(line).alias("sig")).agg(F.count("*").alias("n"))


FAILURES = {"k": "event_id", "message": "CASE event_id % 5 WHEN 0 THEN 'Maximum context length is ' || user_id || ' tokens' WHEN 1 THEN 'Request timed out after ' || user_id WHEN 2 THEN 'HTTP 429 rate limit' WHEN 3 THEN 'Prompt is too long: ' || user_id ELSE 'bad key ' || event_type END"}


@query("failure_kinds", f"SELECT k, CASE k % 5 WHEN 0 THEN 'bisect' WHEN 3 THEN 'bisect' WHEN 4 THEN 'give up' ELSE 'retry' END AS kind FROM ({given_sql('events', **FAILURES)})")
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = ("context length", "too long", "context window")
    return given(spark, sf_dir, "events", **FAILURES).select("k", D.failure_kind(F.col("message"), markers).alias("kind"))


# --- fragments ---

FRAGMENT_NODES = {
    "id": "'n' || p_partkey", "source_file": "CASE WHEN p_partkey % 10 = 9 THEN '' ELSE 'd/f' || (p_partkey % 50) || '.md' END", "partial": "p_size = 1", "file_type": "CASE p_partkey % 13 WHEN 0 THEN 'rationale' WHEN 1 THEN 'document' ELSE 'code' END",
    "label": "CASE WHEN p_partkey % 13 < 3 AND p_size % 2 = 0 THEN 'We chose ' || p_name || ' because it is the best one.' ELSE p_name END",
}
FRAGMENT_EDGES = {
    "src": "'n' || p_partkey", "dst": "'n' || (p_partkey * 7 % 150 + 1)", "relation": "CASE WHEN p_partkey % 13 < 3 THEN 'rationale_for' ELSE 'uses' END", "source_file": "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'd/f' || (p_partkey * 7 % 50) || '.md' END",
}
ALLOWED = {"source_file": "'d/f' || (p_partkey % 50) || '.md'"}
FRAGMENT_SQL = f"n AS ({given_sql('part', **FRAGMENT_NODES)}), e AS ({given_sql('part', **FRAGMENT_EDGES)}), a AS (SELECT DISTINCT source_file FROM ({given_sql('part', **ALLOWED)}) WHERE NOT ends_with(source_file, '3.md'))"


def fragment(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    allowed = given(spark, sf_dir, "part", **ALLOWED).where("not endswith(source_file, '3.md')")
    return given(spark, sf_dir, "part", **FRAGMENT_NODES), given(spark, sf_dir, "part", **FRAGMENT_EDGES), allowed


@query(
    "scope_filter",
    f"""WITH {FRAGMENT_SQL}, kn AS (SELECT * FROM n WHERE source_file = '' OR source_file IN (SELECT source_file FROM a)), lost AS (SELECT id FROM n WHERE id NOT IN (SELECT id FROM kn))
 SELECT 'node' AS what, id, NULL AS dst FROM kn UNION ALL SELECT 'edge', src, dst FROM e WHERE (source_file = '' OR source_file IN (SELECT source_file FROM a)) AND src NOT IN (SELECT id FROM lost) AND dst NOT IN (SELECT id FROM lost)""",
)
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = R.in_scope(*fragment(spark, sf_dir))
    return n.select(F.lit("node").alias("what"), "id", F.lit(None).cast("string").alias("dst")).union(e.select(F.lit("edge"), "src", "dst"))


@query(
    "fragment_cleaning",
    f"""WITH {FRAGMENT_SQL}, m AS (SELECT *, len(list_filter(regexp_split_to_array(trim(label), '\\s+'), lambda w: w <> '')) AS w, id IN (SELECT src FROM e WHERE relation = 'rationale_for') AS ex FROM n),
 g AS (SELECT *, w >= 8 OR (w >= 4 AND regexp_matches(trim(label), '[.!?]$')) AS prose FROM m), k AS (SELECT *, file_type IN ('rationale', 'concept') OR (ex AND prose) AS gone FROM g),
 r AS (SELECT e.dst AS id, array_to_string(list_sort(list(DISTINCT trim(k.label))), chr(10)) AS rationale FROM k JOIN e ON e.src = k.id AND relation = 'rationale_for' WHERE gone AND prose GROUP BY e.dst)
 SELECT k.id, k.label, md5(rationale) AS sig FROM k LEFT JOIN r USING (id) WHERE NOT gone""",
)
def fragment_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, _ = fragment(spark, sf_dir)
    return R.cleaned(n, e)[0].select("id", "label", F.md5("rationale").alias("sig"))


RAW = """CASE event_id % 5 WHEN 0 THEN '{"nodes": [{"id": "a' || event_id || '"}], "edges": []}' WHEN 1 THEN '{"nodes": [{"label": "x"}]}' WHEN 2 THEN 'not json ' || event_id
 WHEN 3 THEN '{"nodes": [{"id": "a"}], "edges": [{"source": "a"}]}' ELSE '{"nodes": [{"id": "' || repeat('z', 50 + cast(event_id % 100 AS INT)) || '"}]}' END"""


@query("fragment_errors", "SELECT event_id AS k, CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'node without id' WHEN 2 THEN 'no nodes' WHEN 3 THEN 'edge without end' ELSE CASE WHEN 23 + 50 + event_id % 100 > 120 THEN 'too large' ELSE 'ok' END END AS error FROM events")
def fragment_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "events", k="event_id", raw=RAW).select("k", R.fragment_errors(F.col("raw"), 120).alias("error"))


CACHE = {"hash": "'h' || o_custkey", "prompt": "'p' || (o_orderkey % 3)", "partial": "o_orderkey % 7 = 0", "payload": "'v' || o_orderkey"}
CACHED_FILES = {"path": "'f' || c_custkey", "hash": "'h' || c_custkey"}


@query(
    "cache_lookup",
    f"""WITH c AS (SELECT hash, prompt, bool_or(partial) AS partial, min(payload) AS payload FROM ({given_sql('orders', **CACHE)}) GROUP BY ALL)
 SELECT path, CASE WHEN payload IS NULL THEN 'miss' WHEN partial THEN 'partial' ELSE 'hit' END AS state, CASE WHEN NOT partial THEN payload END AS payload
 FROM ({given_sql('customer', **CACHED_FILES)}) f LEFT JOIN (SELECT * FROM c WHERE prompt = 'p1') x USING (hash)""",
)
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = given(spark, sf_dir, "orders", **CACHE).groupBy("hash", "prompt").agg(F.max("partial").alias("partial"), F.min("payload").alias("payload"))
    return R.cached(given(spark, sf_dir, "customer", **CACHED_FILES), cache, F.lit("p1"))


@query(
    "cache_by_file",
    f"""WITH {FRAGMENT_SQL} SELECT source_file, array_to_string(list_sort(list(DISTINCT id)), ' ') AS ids, bool_or(partial) AS partial FROM n WHERE source_file IN (SELECT source_file FROM a) GROUP BY source_file""",
)
def cache_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, _, allowed = fragment(spark, sf_dir)
    return R.by_file(n, allowed).select("source_file", F.array_join("ids", " ").alias("ids"), "partial")


SCANNED = {"path": "'f' || p_partkey", "size": "p_size * 10", "mtime": "p_partkey * 3"}
INDEXED = {"path": "'f' || p_partkey", "size": "p_size * 10 + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END", "mtime": "p_partkey * 3 + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END"}


@query("stat_index", "SELECT 'f' || p_partkey AS path, CASE WHEN p_partkey % 4 <> 3 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey * 3 < 450 THEN 'fresh' ELSE 'hash' END AS state FROM part")
def stat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = given(spark, sf_dir, "part", **INDEXED, k="p_partkey").where("k % 4 <> 3")
    return R.unchanged(given(spark, sf_dir, "part", **SCANNED), index, F.lit(450))


STORED = {"k": "o_orderkey", "v": r"CASE o_orderkey % 6 WHEN 0 THEN '/Home/Me/app' WHEN 1 THEN '/Home/Me/app/src/' || o_custkey || '.py' WHEN 2 THEN 'home_me_app_src_' || o_custkey WHEN 3 THEN '/Home/Me/app' || chr(92) || 'w' || chr(92) || o_custkey WHEN 4 THEN 'src/' || o_custkey ELSE '/Home/Me/apple/' || o_custkey END"}


@query(
    "portable_values",
    f"""SELECT k, CASE k % 6 WHEN 0 THEN '<root>' WHEN 1 THEN '<root>' || v[13:] WHEN 2 THEN '<root>' || v[12:] WHEN 3 THEN replace('<root>' || v[13:], chr(92), '/') ELSE v END AS stored,
 CASE k % 6 WHEN 0 THEN '/x' WHEN 1 THEN '/x' || v[13:] WHEN 2 THEN 'x' || v[12:] WHEN 3 THEN replace('/x' || v[13:], chr(92), '/') ELSE v END AS back FROM ({given_sql('orders', **STORED)})""",
)
def portable_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = given(spark, sf_dir, "orders", **STORED).select("k", R.portable(F.col("v"), "/Home/Me/app").alias("stored"))
    return stored.withColumn("back", R.restored(F.col("stored"), "/x"))


OLD_IDS = {
    "id": "CASE p_partkey % 4 WHEN 0 THEN 'f' || p_partkey || '_load' WHEN 1 THEN 'sub_f' || p_partkey || '_load' WHEN 2 THEN 'src_sub_f' || p_partkey || '_load' ELSE 'other_' || p_partkey END",
    "source_file": "'src/sub/f' || p_partkey || '.py'",
}


@query("legacy_ids", f"SELECT id, 'src_sub_' || CASE WHEN starts_with(id, 'f') THEN id ELSE id[5:] END AS new_id FROM ({given_sql('part', **OLD_IDS)}) WHERE starts_with(id, 'f') OR starts_with(id, 'sub_')")
def legacy_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.canonical_ids(given(spark, sf_dir, "part", **OLD_IDS))


TWINS = {"id": "'g' || (p_partkey % 97) || CASE WHEN p_partkey % 2 = 0 THEN '_doc' ELSE '' END", "source_file": "'d' || (p_partkey % 97 % 5) || '.md'", "file_type": "CASE WHEN p_partkey % 97 % 6 = 0 THEN 'code' ELSE 'document' END"}


@query(
    "doc_twins",
    f"""WITH i AS (SELECT DISTINCT * FROM ({given_sql('part', **TWINS)})) SELECT a.id, b.id AS new_id FROM i a JOIN i b ON b.id = a.id || '_doc' AND a.source_file = b.source_file WHERE a.file_type = 'document' AND b.file_type = 'document'""",
)
def doc_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.doc_twins(given(spark, sf_dir, "part", **TWINS).distinct())


# --- links ---

SAID = {"src": "'doc' || o_custkey", "name": "'f' || CASE WHEN o_orderkey % 5 = 0 THEN 1000 + o_custkey % 100 WHEN o_orderkey % 2 = 0 THEN o_orderkey % 300 ELSE 1000 + o_orderkey % 1500 END"}
SYMBOLS = {"id": "'s' || p_partkey", "name": "'f' || CASE p_size % 3 WHEN 0 THEN p_partkey % 150 WHEN 1 THEN p_partkey + 1000 ELSE p_partkey % 700 END"}


@query(
    "markdown_mentions",
    f"""WITH s AS (SELECT name, min(id) AS id FROM ({given_sql('part', **SYMBOLS)}) GROUP BY name HAVING count(DISTINCT id) = 1)
 SELECT DISTINCT src, id AS dst FROM ({given_sql('orders', **SAID)}) JOIN s USING (name) WHERE NOT (src, id) IN (SELECT ('doc' || c_custkey, 's' || (c_custkey % 100)) FROM customer)""",
)
def markdown_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = given(spark, sf_dir, "customer", src="'doc' || c_custkey", dst="'s' || (c_custkey % 100)")
    return L.mentions(given(spark, sf_dir, "orders", **SAID), given(spark, sf_dir, "part", **SYMBOLS), known)


CALLS = {"src": "'c' || o_orderkey", "source_file": "'x' || (o_custkey % 40)", "name": "'f' || (o_orderkey % 60)"}
IMPORTED = {"source_file": "'x' || (c_custkey % 40)", "module": "'m' || (c_custkey % 7)", "name": "'f' || (c_custkey % 60)"}
DEFINED = {"module": "'m' || (p_partkey % 7)", "name": "'f' || (p_partkey % 60)", "id": "'s' || (p_partkey % 420)"}


@query(
    "import_guided_calls",
    f"""WITH i AS (SELECT DISTINCT * FROM ({given_sql('customer', **IMPORTED)})), s AS (SELECT module, name, min(id) AS id FROM ({given_sql('part', **DEFINED)}) GROUP BY ALL HAVING count(DISTINCT id) = 1)
 SELECT DISTINCT src, id AS dst FROM ({given_sql('orders', **CALLS)}) JOIN i USING (source_file, name) JOIN s USING (module, name)""",
)
def import_guided_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.guided_calls(given(spark, sf_dir, "orders", **CALLS), given(spark, sf_dir, "customer", **IMPORTED).distinct(), given(spark, sf_dir, "part", **DEFINED))


FILES = {"path": "'lib/d' || (p_partkey % 10) || '/h' || p_partkey || '.h'"}
INCLUDES = {"source_file": "'lib/d' || (o_orderkey % 10) || '/c' || o_orderkey || '.c'", "said": "CASE o_orderkey % 3 WHEN 0 THEN './h' || (o_custkey % 250) || '.h' WHEN 1 THEN '../d' || (o_custkey % 10) || '/h' || (o_custkey % 250) || '.h' ELSE 'h' || (o_custkey % 250) || '.h' END"}


@query(
    "include_resolution",
    f"""WITH f AS (SELECT DISTINCT path FROM ({given_sql('part', **FILES)})), i AS ({given_sql('orders', **INCLUDES)}),
 t AS (SELECT *, CASE WHEN starts_with(said, './') THEN regexp_replace(source_file, '[^/]*$', '') || said[3:] WHEN starts_with(said, '../') THEN 'lib/' || said[4:] ELSE regexp_replace(source_file, '[^/]*$', '') || said END AS near FROM i),
 u AS (SELECT x, min(path) AS path FROM (SELECT path, unnest([path, path[5:], parse_filename(path)]) AS x FROM f) GROUP BY x HAVING count(*) = 1)
 SELECT DISTINCT source_file, coalesce(f.path, u.path) AS dst FROM t LEFT JOIN f ON f.path = near LEFT JOIN u ON u.x = said WHERE coalesce(f.path, u.path) IS NOT NULL""",
)
def include_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.included(given(spark, sf_dir, "orders", **INCLUDES), given(spark, sf_dir, "part", **FILES).distinct())


PARKED = {"src": "'c' || o_custkey", "receiver_type": "'T' || (o_orderkey % 30)", "callee": "'run' || (o_orderkey % 4)"}


@query(
    "parked_calls",
    f"""SELECT src, array_to_string(list_sort(list(DISTINCT receiver_type || '.' || callee)), ' ') AS parked FROM ({given_sql('orders', **PARKED)})
 WHERE receiver_type NOT IN (SELECT 'T' || p_size FROM part WHERE p_size < 20) GROUP BY src""",
)
def parked_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "part").where("p_size < 20").selectExpr("'T' || p_size AS name")
    return L.parked(given(spark, sf_dir, "orders", **PARKED), types).select("src", F.array_join("parked", " ").alias("parked"))


@query(
    "flow_chain",
    kg("""RECURSIVE, top AS (SELECT id, string_split(source_file, '/')[1] AS s FROM nodes), l AS (SELECT a.s AS sa, b.s AS sb, count(*) AS n FROM edges JOIN top a ON a.id = src JOIN top b ON b.id = dst WHERE a.s <> b.s GROUP BY ALL),
 o AS (SELECT s, row_number() OVER (ORDER BY s) AS k FROM (SELECT DISTINCT s FROM top)), i AS (SELECT o.s, k, coalesce(sum(n), 0) AS n FROM o LEFT JOIN l ON sb = s GROUP BY ALL)
, walk(k, section, seen) AS (
  SELECT 1, s, [s] FROM (SELECT s FROM i ORDER BY n, k LIMIT 1)
  UNION ALL SELECT w.k + 1, o.s, list_append(w.seen, o.s) FROM walk w JOIN o ON NOT list_contains(w.seen, o.s) LEFT JOIN l ON l.sa = w.section AND l.sb = o.s WHERE w.k < 7
   QUALIFY row_number() OVER (ORDER BY l.n IS NULL, l.n DESC, CASE WHEN l.n IS NULL THEN NULL ELSE o.s END DESC, o.k) = 1)
 SELECT k, section FROM walk"""),
)
def flow_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    top = nodes(spark, sf_dir).select("id", F.substring_index("source_file", "/", 1).alias("s"))
    order = top.select(F.col("s").alias("section")).distinct().withColumn("k", F.row_number().over(Window.orderBy("section")))
    met = links(spark, sf_dir).join(top.select(F.col("id").alias("src"), F.col("s").alias("sa")), "src").join(top.select(F.col("id").alias("dst"), F.col("s").alias("sb")), "dst")
    chain = L.flow_chain(order, met.groupBy("sa", "sb").agg(F.count("*").alias("n")))
    return spark.createDataFrame(list(enumerate(chain, 1)), "k int, section string")


MERGES = {"id_a": "'a' || o_custkey", "id_b": "'b' || (o_orderkey % 500)"}


@query(
    "protected_merges",
    f"""WITH p AS (SELECT DISTINCT 'a' || c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 UNION SELECT DISTINCT 'b' || (o_orderkey % 500) FROM orders WHERE o_orderkey % 500 < 100)
 SELECT DISTINCT id_a, id_b, CASE WHEN id_a IN (SELECT id FROM p) THEN id_a WHEN id_b IN (SELECT id FROM p) THEN id_b ELSE least(id_a, id_b) END AS winner
 FROM ({given_sql('orders', **MERGES)}) WHERE NOT (id_a IN (SELECT id FROM p) AND id_b IN (SELECT id FROM p))""",
)
def protected_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").selectExpr("'a' || c_custkey AS id")
    b = table(spark, sf_dir, "orders").where("o_orderkey % 500 < 100").selectExpr("'b' || (o_orderkey % 500) AS id")
    return L.protected_merges(given(spark, sf_dir, "orders", **MERGES).distinct(), a.union(b).distinct())
