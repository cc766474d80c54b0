"""Queries of text functions over whole columns of the tables, or over texts put together from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entry_points
from ..functions import scalars as S
from ..graph import stored_graph, table
from ..operators import capabilities
from .graph_queries import query
from .link_queries import REFERRING


def _part(spark: SparkSession, sf_dir: str, given: str, function) -> DataFrame:
    """(p_partkey, result) of a function of a text that the expression given makes of a part."""
    return table(spark, sf_dir, "part").select("p_partkey", function(F.expr(given)).alias("result"))


STATEMENT = "'MATCH (n:' || p_type || ') ' || CASE p_size % 5 WHEN 0 THEN 'set n.a = 1' WHEN 1 THEN 'RETURN n.offset' WHEN 2 THEN 'Detach Delete n' WHEN 3 THEN 'WHERE n.created_at > 1 RETURN n' ELSE 'RETURN n.' || lower(p_brand) END"


@query(f"SELECT p_partkey, regexp_matches({STATEMENT}, '(?i)\\b(" + "|".join(S.WRITES) + ")\\b') AS result FROM part", graph=False)
def fil_16_write_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, STATEMENT, S.is_write)


@query("SELECT id, coalesce(regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*'), false) AS result FROM nodes")
def fil_17_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph(spark, sf_dir).nodes.select("id", S.identifier(F.col("name")).alias("result"))


CAMEL = "CASE WHEN p_size % 4 = 0 THEN upper(replace(p_name, ' ', '_')) ELSE 'partOf' || p_type || 'In' || replace(p_brand, '#', '') END"
UPPER_SNAKE = "upper(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Za-z])([0-9])', '\\1_\\2', 'g'))"


@query(f"SELECT p_partkey, CASE WHEN regexp_full_match({CAMEL}, '[A-Z][A-Z0-9_]*') THEN {CAMEL} ELSE {UPPER_SNAKE.format(x=CAMEL)} END AS result FROM part", graph=False)
def fn_03_upper_snake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, CAMEL, S.upper_snake)


@query("SELECT id, CASE WHEN starts_with(file_path, 'src/') THEN substr(file_path, 5) ELSE coalesce(file_path, '') END AS result FROM nodes")
def fn_07_normal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph(spark, sf_dir).nodes.select("id", S.normal_path(F.col("file_path"), "src").alias("result"))


@query(f"SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(array_to_string(regexp_extract_all({REFERRING}, '```python\\s*\\n((?:.|\\n)*?)```', 1), ' '), '\\b[A-Za-z_][A-Za-z0-9_]{{2,}}\\b'))), ','), '') AS result FROM documents WHERE text IS NOT NULL", graph=False)
def fn_10_code_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(S.code_identifiers(F.expr(REFERRING)), ",").alias("result"))


@query("SELECT id, CASE WHEN coalesce(file_path,'')='' THEN 'unknown' WHEN file_path LIKE '%.py' THEN regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]+$', '') ELSE split_part(file_path, '/', 1) END AS result FROM nodes")
def fn_15_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph(spark, sf_dir).nodes.select("id", S.business_domain(F.col("file_path")).alias("result"))


VERB_NOUN = "CASE p_size % 3 WHEN 0 THEN 'get_' || replace(p_name, ' ', '_') WHEN 1 THEN replace(p_name, ' ', '_') ELSE replace(p_name, ' ', '') END"


@query("SELECT p_partkey, CASE p_size % 3 WHEN 2 THEN 'unknown' ELSE split_part(p_name, ' ', 1) END AS result FROM part", graph=False)
def fn_16_domain_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, VERB_NOUN, lambda c: capabilities.domain(F.lit(None).cast("string"), c))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 4 THEN 'any' ELSE p_type END AS result FROM part", graph=False)
def fn_17_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = "CASE p_size % 5 WHEN 0 THEN 'Optional[' || p_type || ']' WHEN 1 THEN p_type || ' | None' WHEN 2 THEN '\"' || p_type || '\"' WHEN 3 THEN ' ' || p_type || ' ' ELSE '' END"
    return _part(spark, sf_dir, given, capabilities.plain_type)


@query("SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN '' ELSE array_to_string(list_sort([p_name || '=' || p_type, 'size' || p_size || '=any']), ',') END AS result FROM part", graph=False)
def fn_18_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = "CASE p_size % 7 WHEN 0 THEN 'no json' ELSE '[\"' || p_name || ': int\", \"size' || p_size || '\", \"' || p_name || ': Optional[' || p_type || ']\"]' END"
    return _part(spark, sf_dir, given, lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(capabilities.contract(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ","))


@query("SELECT p_partkey, CASE p_size % 2 WHEN 0 THEN p_type ELSE 'any' END AS result FROM part", graph=False)
def fn_19_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, "'def f(a)' || CASE p_size % 2 WHEN 0 THEN ' -> ' || p_type || ' | None:' ELSE ':' END", capabilities.return_type)


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text,''), '\\s+'), lambda x: length(x) > 1 AND NOT starts_with(x, '@'))[1:3] ws FROM documents), k AS (SELECT doc_id, list_transform(list_concat(['get','total'], ws), lambda x: lower(x)) ks FROM w)
 SELECT doc_id, array_to_string(list_filter(ks, lambda x, i: list_position(ks, x) = i)[1:10], ',') AS result FROM k""", graph=False)
def fn_20_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(capabilities.keywords(F.lit("Get_total"), F.col("text")), ",").alias("result"))


BARE = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@query("SELECT doc_id, coalesce(nullif(" + BARE.format(x="split_part(" + BARE.format(x="coalesce(text,'')") + ", chr(10), 1)") + ", ''), 'Capability: '||source) AS result FROM documents", graph=False)
def fn_21_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", capabilities.description(F.col("text"), F.col("source")).alias("result"))


@query("SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'http_api' WHEN 1 THEN 'scheduled' WHEN 2 THEN 'mq_consumer' WHEN 4 THEN 'rpc_service' WHEN 5 THEN 'event_handler' END AS result FROM events", graph=False)
def fn_23_java_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with a parameter from the event's type."""
    given = "CASE user_id % 6 WHEN 0 THEN '@GetMapping(\"/' || event_type || '\")' WHEN 1 THEN 'Scheduled' WHEN 2 THEN '@org.kafka.KafkaListener' WHEN 3 THEN '@Override' WHEN 4 THEN '@RpcService' ELSE '@EventListener' END"
    return table(spark, sf_dir, "events").select("event_id", entry_points.java_category(F.expr(given)).alias("result"))


@query("SELECT id, CASE WHEN lower(file_path) LIKE '%readme%' THEN 'readme' WHEN lower(file_path) LIKE '%docs/%' AND lower(file_path) LIKE '%api%' THEN 'api_doc' WHEN lower(file_path) LIKE '%docs/%' THEN 'module_doc' WHEN lower(file_path) LIKE '%arch%' OR lower(file_path) LIKE '%design%' THEN 'architecture_doc' ELSE 'comment' END AS result FROM nodes WHERE file_path IS NOT NULL")
def fn_24_doc_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph(spark, sf_dir).nodes.where("file_path is not null").select("id", S.doc_type(F.col("file_path")).alias("result"))


#: Whether a line without white space around it documents something, as SQL over the line x.
DOC_LINE = "(starts_with(x,'#') OR CASE WHEN (starts_with(x,'\"\"\"') AND ends_with(x,'\"\"\"')) OR (starts_with(x,'''''''') AND ends_with(x,'''''''')) THEN length(x) > 7 ELSE starts_with(x,'\"\"\"') OR starts_with(x,'''''''') OR ends_with(x,'\"\"\"') OR ends_with(x,'''''''') END)"
#: Documents as sources: some lines are made comments, docstrings or definitions.
LINES = "CASE doc_id % 4 WHEN 0 THEN '# ' || replace(coalesce(text,''), chr(10), chr(10) || '# ') WHEN 1 THEN '\"\"\"' || coalesce(text,'') || '\"\"\"' WHEN 2 THEN 'def f(x):' || chr(10) || coalesce(text,'') ELSE coalesce(text,'') END"


@query(f"WITH l AS (SELECT doc_id, unnest(string_split({LINES}, chr(10))) y FROM documents), b AS (SELECT doc_id, {BARE.format(x='y')} x FROM l) SELECT doc_id, count(*) n, count(*) FILTER ({DOC_LINE}) n_doc FROM b GROUP BY 1", graph=False)
def fn_25_doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.expr(LINES), "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(S.doc_line(S.stripped(F.col("line")))).alias("n_doc"))


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split({LINES}, chr(10)), lambda y: {BARE.format(x='y')}), lambda y: y <> '') ls FROM documents)
 SELECT doc_id, CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '^(async def|def|class) '))) > 0 THEN 'SIGNATURE' WHEN len(list_filter(ls, lambda x: NOT {DOC_LINE})) = 0 THEN 'DOC_ONLY' ELSE 'BODY' END AS result FROM l""", graph=False)
def fn_26_diff_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as an added one, under the heads of a diff."""
    diff = F.concat(F.lit("--- a\n+++ b\n@@ -1 +1 @@\n context\n+"), F.replace(F.expr(LINES), F.lit("\n"), F.lit("\n+")))
    return table(spark, sf_dir, "documents").select("doc_id", S.diff_change(diff).alias("result"))


@query("SELECT event_id, CASE WHEN upper(substr(event_type,1,1)) IN ('A','D','M','R','C','T','U') THEN upper(substr(event_type,1,1)) ELSE 'X' END AS result FROM events", graph=False)
def fn_27_git_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.git_status(F.col("event_type")).alias("result"))


@query("SELECT id, 'code.changed:'||CASE WHEN file_path IS NULL THEN 'unknown' ELSE regexp_extract(file_path, '\\.[^./]+$') END AS result FROM nodes")
def fn_33_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph(spark, sf_dir).nodes.select("id", S.pattern_signature(F.lit("code.changed"), S.suffix(F.col("file_path"))).alias("result"))


SECRET_URL = "CASE page_id % 2 WHEN 0 THEN replace(url, '://', '://user' || page_id || ':word@') ELSE url END"


@query("SELECT page_id, CASE page_id % 2 WHEN 0 THEN replace(url, '://', '://***@') ELSE url END AS result FROM pages", graph=False)
def fn_37_masked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.masked_url(F.expr(SECRET_URL)).alias("result"))


@query("SELECT page_id, page_id % 3 = 0 AND regexp_full_match(url, '(?i:https?)://[^\\s/]+(/\\S*)?') AS result FROM pages", graph=False)
def fn_37_safe_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = "CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'git@' || url ELSE replace(url, '://', ':// ') END"
    return table(spark, sf_dir, "pages").select("page_id", S.safe_url(F.expr(given)).alias("result"))


@query("SELECT doc_id, md5(coalesce('\"'||replace(replace(replace(replace(text, chr(92), chr(92)||chr(92)), '\"', chr(92)||'\"'), chr(10), chr(92)||'n'), chr(13), chr(92)||'r')||'\"', 'NULL')) AS result FROM documents", graph=False)
def fn_39_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.literal(F.col("text"))).alias("result"))


TURN = "conv_id * 1000 + turn AS id"


@query(f"SELECT {TURN}, CASE WHEN contains(lower(text), 'and') AND len(list_filter(regexp_extract_all(lower(text), '[a-z_]+'), lambda x: contains(x, 'and') AND x <> 'and')) = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS result FROM conversations", graph=False)
def fn_41_exact_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir, S.exact_answer)


@query(f"SELECT {TURN}, CASE WHEN contains(lower(text), 'and') THEN 1.0 ELSE 0.0 END::DOUBLE AS result FROM conversations", graph=False)
def fn_41_held_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir, S.held_answer)


def _answers(spark: SparkSession, sf_dir: str, function) -> DataFrame:
    turn: Column = (F.col("conv_id") * 1000 + F.col("turn")).alias("id")
    return table(spark, sf_dir, "conversations").select(turn, function(F.lit("And"), F.col("text")).alias("result"))


@query("SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS result FROM customer", graph=False)
def fn_43_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("c_mktsegment") == "BUILDING", "writer").when(F.col("c_mktsegment") == "MACHINERY", "admin").when(F.col("c_mktsegment") == "FURNITURE", "reader").when(F.col("c_mktsegment") == "HOUSEHOLD", "guest")
    return table(spark, sf_dir, "customer").select("c_custkey", S.role_allows(role, "writer").alias("result"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'CONTAINS' WHEN 1 THEN 'DEPENDS_ON_'||p_type ELSE p_type END AS result FROM part", graph=False)
def fn_44_relation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, "CASE p_size % 3 WHEN 0 THEN 'has' || p_type WHEN 1 THEN 'dependsOn' || p_type ELSE p_type END", S.relation_name)


@query("SELECT id, CASE label WHEN 'DocEntity' THEN 'DocEntity' WHEN 'CodeEntity' THEN 'CodeEntity' ELSE 'ResourceEntity' END AS result FROM nodes")
def fn_45_entry_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph(spark, sf_dir).nodes.select("id", S.entry_label(F.lower(F.replace("label", F.lit("Entity"), F.lit("")))).alias("result"))


@query("SELECT doc_id, md5(CASE doc_id % 2 WHEN 0 THEN text ELSE regexp_replace(text, '[^\\x00-\\xFF]', '?', 'g') END) AS result FROM documents WHERE text IS NOT NULL", graph=False)
def prs_09_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes of UTF-8 and, every other one, of Latin-1, which has a question mark for what it lacks."""
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode(F.regexp_replace("text", r"[^\x00-\xFF]", "?"), "ISO-8859-1"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(S.decoded(raw)).alias("result"))
