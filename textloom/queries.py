"""Registered queries over the driver's tables, each with the SQL that gives the same rows on DuckDB.

Texts are rendered from rows, parsed by the engine and aggregated; the SQL works on the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import grammars
from .functions import characters, positions
from .operators import lex, navigate, parse, relational
from .plans.lexical import TokenSet
from .report import messages
from .semantics import attributes, chains, modules
from .session import cut, folder, spread, table
from .sources.workspace import Workspace
from .streaming import edits, revisions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def long(c) -> object:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# -- texts ----------------------------------------------------------------------------------------------------------


def props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("text"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def region_json(spark: SparkSession, d: str) -> DataFrame:
    """One nested JSON text per region: its nations, and their suppliers."""
    sup = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))).alias("suppliers"))
    nat = table(spark, d, "nation").join(sup, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    nat = nat.select("n_regionkey", F.struct(F.col("n_name").alias("name"), F.coalesce("suppliers", F.array().cast("array<struct<key:bigint,name:string>>")).alias("suppliers")).alias("n"))
    reg = table(spark, d, "region").join(nat.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n")).alias("nations")), F.col("r_regionkey") == F.col("n_regionkey"))
    return reg.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.to_json(F.struct(F.col("r_name").alias("region"), "nations")).alias("text"))


def broken_json(spark: SparkSession, d: str) -> DataFrame:
    """events.props without its closing brace, its colon, its key, or as it is, by event_id modulo 4."""
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.replace("text", F.lit("}"), F.lit(""))).when(k == 1, F.replace("text", F.lit(":"), F.lit(""))).when(k == 2, F.replace("text", F.lit('"k"'), F.lit(""))).otherwise(F.col("text"))
    return props(spark, d).select("doc_id", text.alias("text"))


def flag_expressions(spark: SparkSession, d: str) -> DataFrame:
    """A boolean expression per lineitem: returned | open & big | !(cheap & small)."""
    li = table(spark, d, "lineitem")
    word = lambda c: F.when(c, "true").otherwise("false")
    r, o, q, x, s = (word(c) for c in (F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_quantity") > 25, F.col("l_discount") < 0.05, F.col("l_tax") < 0.02))
    text = F.concat(r, F.lit(" | "), o, F.lit(" & "), q, F.lit(" & !("), x, F.lit(" | "), s, F.lit(")"))
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("doc_id"), text.alias("text"))


def chain_programs(spark: SparkSession, d: str) -> DataFrame:
    """A program per order: names set, copied, shadowed in an inner block, and one that is never set."""
    c = F.col("o_custkey").cast("string")
    inner = F.concat(F.lit("{ copied = base; base = "), (F.col("o_custkey") + 1).cast("string"), F.lit("; again = base; lost = nowhere; { deep = again; up = first; } }"))
    text = F.concat(F.lit("{ base = "), c, F.lit("; first = base; "), inner, F.lit(" last = base; later = missing; }"))
    return spread(table(spark, d, "orders").select("o_orderkey", "o_custkey")).select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def customer_modules(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A module per nation with a definition per customer, and the modules' names. Customer k is a number if 5 divides
    it, refers to a key that isn't there if 7 does, to itself if 11 does, else to customer k - 1 in that one's module."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    prev = c.select((F.col("c_custkey") + 1).alias("c_custkey"), F.col("c_nationkey").alias("p"))
    k, own = F.col("c_custkey").cast("string"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    before = F.concat(F.lit("n"), F.coalesce("p", F.lit(99)).cast("string"), F.lit("::c"), (F.col("c_custkey") - 1).cast("string"))
    value = F.when(F.col("c_custkey") % 5 == 0, k).when(F.col("c_custkey") % 7 == 0, F.concat(own, F.lit("::none"))).when(F.col("c_custkey") % 11 == 0, F.concat(own, F.lit("::c"), k)).otherwise(before)
    line = F.concat(F.lit("c"), k, F.lit(" = "), F.replace(value, F.lit("-"), F.lit("m")), F.lit(";"))
    docs = c.join(prev, "c_custkey", "left").groupBy(F.col("c_nationkey").cast("long").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    return docs, docs.select("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("name"))


JSON_PIECES = r"""
pieces AS (SELECT event_id, unnest(regexp_extract_all(props, '(?s)(true|false|null|\{|\}|\[|\]|,|:|"(?:[^"\\]|\\(?:["\\/bfnrt]|u[0-9A-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[ \t\r\n\f]+|.)', 1)) AS s, generate_subscripts(regexp_extract_all(props, '(?s)(true|false|null|\{|\}|\[|\]|,|:|"(?:[^"\\]|\\(?:["\\/bfnrt]|u[0-9A-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[ \t\r\n\f]+|.)', 1), 1) AS i FROM events),
tok AS (SELECT event_id AS doc_id, i - 1 AS tok_idx, s, CASE WHEN s = '{' THEN 'BraceOpen' WHEN s = '}' THEN 'BraceClose' WHEN s = ',' THEN 'Comma' WHEN s = ':' THEN 'Colon' WHEN s LIKE '"%' THEN 'String' WHEN regexp_full_match(s, '-?[0-9].*') THEN 'Number' WHEN trim(s) = '' THEN 'Blank' ELSE 'Mismatch' END AS name FROM pieces)
"""


# -- lexing -------------------------------------------------------------------------------------------------------------


@query(f"WITH {JSON_PIECES} SELECT name AS token, count(*) AS n, sum(length(s))::BIGINT AS chars FROM tok GROUP BY 1")
def json_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of events.props by name: the SQL path."""
    t = lex.lex_sql(props(spark, d), "|".join(grammars.JSON_SQL.values()), grammars.JSON_SQL)
    return t.groupBy(F.col("name").alias("token")).agg(F.count(F.lit(1)).alias("n"), long(F.sum("length")).alias("chars"))


@query(ORACLES["json_token_counts"])
def json_token_counts_automaton(spark: SparkSession, d: str) -> DataFrame:
    """The same by the automaton, character by character."""
    return lex.token_counts(props(spark, d), grammars.json_lexis(), automaton=True).withColumnRenamed("name", "token")


@query(f"WITH {JSON_PIECES} SELECT doc_id, tok_idx::BIGINT AS tok_idx, name, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(s) AS length FROM tok")
def json_token_sites(spark: SparkSession, d: str) -> DataFrame:
    t = lex.lex(props(spark, d), grammars.json_lexis())
    return t.select("doc_id", long("tok_idx").alias("tok_idx"), "name", long("start").alias("start"), long("length").alias("length"))


@query(f"WITH {JSON_PIECES}, n AS (SELECT name, lead(name) OVER w AS next, lag(name, 2) OVER w AS before2 FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx)) SELECT name, next, before2, count(*) AS n FROM n GROUP BY ALL")
def json_token_lookahead(spark: SparkSession, d: str) -> DataFrame:
    t = lex.lex(props(spark, d), grammars.json_lexis())
    t = t.select("name", lex.lookahead(t, 1).alias("next"), lex.lookahead(t, -2).alias("before2"))
    return t.groupBy("name", "next", "before2").agg(F.count(F.lit(1)).alias("n"))


TOKEN_SITES = "SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM tok"


@query(f"WITH {JSON_PIECES}, s AS ({TOKEN_SITES}), e AS (SELECT event_id AS doc_id, length(props) // 2 AS site FROM events) SELECT e.doc_id, site, name, start FROM e LEFT JOIN s ON e.doc_id = s.doc_id AND start <= site AND site < start + length(s)")
def json_token_at_site(spark: SparkSession, d: str) -> DataFrame:
    """The token at the middle of each text."""
    docs = props(spark, d)
    sites = docs.select("doc_id", F.floor(F.length("text") / 2).cast("long").alias("site"))
    t = lex.token_at(lex.lex(docs, grammars.json_lexis()), sites)
    return t.select("doc_id", "site", "name", long("start").alias("start"))


@query(f"WITH {JSON_PIECES}, s AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM tok) SELECT name, count(*) AS n FROM s WHERE start < 5 AND start + length(s) > 1 GROUP BY 1")
def json_chunk_scan(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that the span [1, 5) touches."""
    t = lex.chunks(lex.lex(props(spark, d), grammars.json_lexis()), 1, 5)
    return t.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


WORD_RUNS = r"""
p AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)([a-zA-Z]+|[ \n\t\r]+|.)', 1)) AS s, generate_subscripts(regexp_extract_all(text, '(?s)([a-zA-Z]+|[ \n\t\r]+|.)', 1), 1) AS i FROM documents),
k AS (SELECT *, CASE WHEN regexp_full_match(s, '[a-zA-Z]+') THEN 'Word' WHEN regexp_full_match(s, '[ \n\t\r]+') THEN 'Blank' ELSE 'Mismatch' END AS name FROM p),
m AS (SELECT *, CASE WHEN name = 'Mismatch' AND lag(name) OVER (PARTITION BY doc_id ORDER BY i) = 'Mismatch' THEN 0 ELSE 1 END AS fresh FROM k)
"""


@query(f"WITH {WORD_RUNS} SELECT name, sum(fresh)::BIGINT AS n, sum(length(s))::BIGINT AS chars FROM m GROUP BY 1")
def doc_mismatch_runs(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of documents under ASCII words: mismatches merged, by changes of the character class."""
    return lex.token_counts(documents(spark, d), grammars.word_lexis())


@query("SELECT lang, sum(len(regexp_extract_all(text, '\\p{L}+')))::BIGINT AS words FROM documents GROUP BY 1")
def doc_word_counts_by_lang(spark: SparkSession, d: str) -> DataFrame:
    w = F.size(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1)))
    return table(spark, d, "documents").groupBy("lang").agg(long(F.sum(w)).alias("words"))


@query("SELECT doc_id, len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN 1 ELSE 0 END AS n_tokens, length(text) AS chars FROM documents")
def doc_line_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A custom scanner: lines with their newlines as tokens."""
    t = lex.lex(documents(spark, d), grammars.LINES, ("doc_id", "length")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), long(F.sum("length")).alias("chars"))
    return t


@query("SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, 0::BIGINT AS gaps FROM documents WHERE text <> ''")
def doc_tokens_tile(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of any script, by the automaton, tile their text: characters, bytes, and places where one doesn't follow."""
    t = lex.lex(documents(spark, d), grammars.letter_lexis(), ("doc_id", "tok_idx", "start", "length", "string"))
    after = F.lead("start").over(Window.partitionBy("doc_id").orderBy("tok_idx"))
    t = t.withColumn("gap", F.coalesce(after != F.col("start") + F.col("length"), F.lit(False)))
    return t.groupBy("doc_id").agg(long(F.sum("length")).alias("chars"), long(F.sum(F.octet_length("string"))).alias("bytes"), F.count_if("gap").alias("gaps"))


@query("SELECT regexp_extract(t, '^(</?)', 1) AS kind, lower(regexp_extract(t, '^</?([a-zA-Z0-9]+)', 1)) AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*(?:[\\t\\n ][^>]*)?>|</[a-zA-Z0-9]+>')) AS t FROM pages) GROUP BY ALL")
def html_tag_tokens(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    t = lex.lex(pages, grammars.tag_lexis()).where(F.col("name").isin("Open", "Close"))
    return t.groupBy(F.when(F.col("name") == "Open", "<").otherwise("</").alias("kind"), F.lower(F.regexp_extract("string", "^</?([a-zA-Z0-9]+)", 1)).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*(?:[\\t\\n ][^>]*)?>|</[a-zA-Z0-9]+>')) AS t FROM pages), c AS (SELECT page_id, lower(regexp_extract(t, '^</?([a-zA-Z0-9]+)', 1)) AS tag, sum(CASE WHEN t LIKE '</%' THEN -1 ELSE 1 END)::BIGINT AS open FROM t GROUP BY ALL) SELECT tag, count(*) FILTER (WHERE open <> 0) AS unbalanced, sum(open)::BIGINT AS left_open FROM c GROUP BY 1")
def html_tag_balance(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    t = lex.lex(pages, grammars.tag_lexis()).where(F.col("name").isin("Open", "Close"))
    per = t.groupBy("doc_id", F.lower(F.regexp_extract("string", "^</?([a-zA-Z0-9]+)", 1)).alias("tag")).agg(F.sum(F.when(F.col("name") == "Open", 1).otherwise(-1)).alias("open"))
    return per.groupBy("tag").agg(F.count_if(F.col("open") != 0).alias("unbalanced"), long(F.sum("open")).alias("left_open"))


# -- lines and positions --------------------------------------------------------------------------------------------------


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, length(text) AS n_chars, strlen(text) AS n_bytes FROM documents")
def doc_line_counts(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", positions.line_count(F.col("text")).alias("n_lines"), long(F.length("text")).alias("n_chars"), long(F.octet_length("text")).alias("n_bytes"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT doc_id, line, coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(s) AS length FROM l")
def doc_line_spans(spark: SparkSession, d: str) -> DataFrame:
    lines = positions.lines(documents(spark, d))
    return lines.select("doc_id", "line", "start", (F.col("end") - F.col("start")).alias("length"))


@query("SELECT doc_id, length(text) // 2 AS site, len(string_split(substr(text, 1, length(text) // 2), chr(10))) AS line, length(list_extract(string_split(substr(text, 1, length(text) // 2), chr(10)), -1)) + 1 AS col, strlen(substr(text, 1, length(text) // 2)) AS byte FROM documents")
def doc_line_of_site(spark: SparkSession, d: str) -> DataFrame:
    site, text = F.floor(F.length("text") / 2).cast("long"), F.col("text")
    return documents(spark, d).select("doc_id", site.alias("site"), positions.line_of(text, site).alias("line"), positions.column_of(text, site).alias("col"), positions.byte_index(text, site).alias("byte"))


@query("SELECT doc_id, length(text) // 3 AS site, len(string_split(substr(text, 1, length(text) // 3), chr(10))) AS line, length(list_extract(string_split(substr(text, 1, length(text) // 3), chr(10)), -1)) + 1 AS col FROM documents")
def doc_position_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Site to position and back."""
    site, text = F.floor(F.length("text") / 3).cast("long"), F.col("text")
    p = documents(spark, d).select("doc_id", "text", positions.line_of(text, site).alias("line"), positions.column_of(text, site).alias("col"))
    return p.select("doc_id", positions.site_of(text, F.col("line"), F.col("col")).alias("site"), "line", "col")


@query("SELECT doc_id, substr(text, 11, 20) AS middle, substr(text, 1, 5) AS head, substr(text, greatest(length(text) - 6, 0) + 1) AS tail FROM documents")
def doc_substring_spans(spark: SparkSession, d: str) -> DataFrame:
    text, n = F.col("text"), F.length("text")
    cut = lambda a, b: positions.substring_span(text, a, b)
    return documents(spark, d).select("doc_id", cut(F.lit(10), F.lit(30)).alias("middle"), cut(F.lit(-3), F.lit(5)).alias("head"), cut(F.greatest(n - 6, F.lit(0)), n + 9).alias("tail"))


@query("WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents) SELECT ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY 1")
def doc_char_scan(spark: SparkSession, d: str) -> DataFrame:
    """Characters of whole texts, by a scan over the span of all."""
    return positions.chars(documents(spark, d), F.lit(0), F.length("text")).groupBy(F.col("char").alias("ch")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) SELECT s AS line, count(*) AS n, count(DISTINCT doc_id) AS docs FROM l WHERE s <> '' GROUP BY 1 HAVING count(*) > 1")
def doc_duplicate_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = positions.lines(documents(spark, d)).where("string <> ''")
    return lines.groupBy(F.col("string").alias("line")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs")).where("n > 1")


@query("WITH t AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1) SELECT conv_id AS doc_id, length(text) AS chars, len(string_split(text, chr(10))) AS n_lines FROM t")
def conversation_parts(spark: SparkSession, d: str) -> DataFrame:
    """Texts loaded by parts: turns in order."""
    parts = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    t = lex.join_parts(parts)
    return t.select("doc_id", long(F.length("text")).alias("chars"), positions.line_count(F.col("text")).alias("n_lines"))


@query("SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS alpha, length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) AS upper, length(regexp_replace(text, '[^\\p{N}]', '', 'g')) AS num, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS either FROM documents")
def doc_char_properties(spark: SparkSession, d: str) -> DataFrame:
    """Characters by property, unions of properties among them."""
    n = characters.count_characters
    return documents(spark, d).select("doc_id", n(F.col("text"), "alpha").alias("alpha"), n(F.col("text"), "alpha", "upper", every=True).alias("upper"), n(F.col("text"), "num").alias("num"), n(F.col("text"), "alpha", "num").alias("either"))


@query(f"SELECT * FROM (VALUES ('enter', 4::BIGINT), ('leave', 4), ('token', 6)) t(event, per), (SELECT count(*) AS docs FROM events)")
def json_parse_trace(spark: SparkSession, d: str) -> DataFrame:
    """What a parse observer is told: tokens read, rules entered and left."""
    t = parse.trace(parse.parse(props(spark, d), grammars.json_syntax(), ("trace",)))
    per = t.groupBy("doc_id", "event").agg(F.count(F.lit(1)).alias("per"))
    return per.groupBy("event", "per").agg(F.count(F.lit(1)).alias("docs"))


NAMES = ["EOI", "Mismatch", *grammars.JSON_SQL]


@query("WITH t(id, name) AS (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(NAMES)) + ") SELECT id::BIGINT AS id, name, (id IN (0, 2, 3, 4)) AS included, (id NOT IN (0, 2, 3, 4)) AS inverted, (id IN (0, 2, 3, 4) OR id IN (4, 5, 6)) AS united, (id = 4) AS met, (id IN (0, 2, 3)) AS excluded FROM t")
def tokenset_algebra(spark: SparkSession, d: str) -> DataFrame:
    a, b = TokenSet.inclusive([0, 2, 3, 4]), TokenSet.inclusive([4, 5, 6])
    sets = {"included": a, "inverted": a.invert(), "united": a.union(b), "met": a.intersect(b), "excluded": a.exclude(4, 9)}
    rows = [(i, n, *(i in s for s in sets.values())) for i, n in enumerate(NAMES)]
    return spark.createDataFrame(rows, "id long, name string, " + ", ".join(f"{k} boolean" for k in sets))


# -- trees ------------------------------------------------------------------------------------------------------------------

NATIONS = "(SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey)"
SUPPLIERS = "(SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
REGIONS = "(SELECT count(DISTINCT n_regionkey) FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(
    f"SELECT * FROM (VALUES ('Root', 0, {REGIONS}), ('Object', 1, {REGIONS}), ('Member', 2, 2 * {REGIONS}), ('String', 3, {REGIONS}), ('Array', 3, {REGIONS}), ('Object', 4, {NATIONS}), ('Member', 5, 2 * {NATIONS}), ('String', 6, {NATIONS}), ('Array', 6, {NATIONS}), ('Object', 7, {SUPPLIERS}), ('Member', 8, 2 * {SUPPLIERS}), ('Number', 9, {SUPPLIERS}), ('String', 9, {SUPPLIERS})) t(name, depth, n)"
)
def json_tree_shape(spark: SparkSession, d: str) -> DataFrame:
    n = parse.nodes(parse.parse(region_json(spark, d), grammars.json_syntax(), ("node",)))
    return n.groupBy("name", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS doc_id, json_extract_string(props, '$.k') AS string, json_extract(props, '$.k')::BIGINT AS value FROM events")
def json_number_values(spark: SparkSession, d: str) -> DataFrame:
    c = parse.captures(parse.parse(props(spark, d), grammars.json_syntax(), ("cap",))).where("name = 'Number'")
    return c.select("doc_id", "string", long("string").alias("value"))


@query(f"SELECT * FROM (VALUES ('Root', 'Object', {REGIONS}), ('Object', 'Member', 2 * ({REGIONS} + {NATIONS} + {SUPPLIERS})), ('Member', 'String', {REGIONS} + {NATIONS} + {SUPPLIERS}), ('Member', 'Array', {REGIONS} + {NATIONS}), ('Member', 'Number', {SUPPLIERS}), ('Array', 'Object', {NATIONS} + {SUPPLIERS})) t(parent_name, name, n)")
def json_parent_child(spark: SparkSession, d: str) -> DataFrame:
    n = navigate.with_parent(parse.nodes(parse.parse(region_json(spark, d), grammars.json_syntax(), ("node",))), ("name",))
    return n.where("parent_name IS NOT NULL").groupBy("parent_name", "name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH g AS (SELECT n_nationkey, count(s_suppkey) AS c FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1), r AS (SELECT n_regionkey, count(*) AS c FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1) SELECT * FROM (VALUES ('Member', {REGIONS} + {NATIONS} + {SUPPLIERS}, {REGIONS} + {NATIONS} + {SUPPLIERS}), ('Object', (SELECT sum(greatest(c - 1, 0)) FROM g)::BIGINT + (SELECT sum(c - 1) FROM r)::BIGINT, (SELECT sum(greatest(c - 1, 0)) FROM g)::BIGINT + (SELECT sum(c - 1) FROM r)::BIGINT)) t(name, with_next, with_prev)")
def json_siblings(spark: SparkSession, d: str) -> DataFrame:
    n = navigate.siblings(parse.nodes(parse.parse(region_json(spark, d), grammars.json_syntax(), ("node",))))
    out = n.where(F.col("name").isin("Member", "Object")).groupBy("name").agg(F.count("next_sibling").alias("with_next"), F.count("prev_sibling").alias("with_prev"))
    return out


@query("SELECT r_regionkey::BIGINT AS doc_id, count(DISTINCT n_nationkey) + count(s_suppkey) AS objects, count(s_suppkey) AS numbers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def json_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Objects and numbers below each region's array of nations."""
    n = parse.nodes(parse.parse(region_json(spark, d), grammars.json_syntax(), ("node",)))
    below = navigate.descendants(n).where("ancestor_name = 'Array' AND ancestor_depth = 3")
    return below.groupBy("doc_id").agg(F.count_if(F.col("name") == "Object").alias("objects"), F.count_if(F.col("name") == "Number").alias("numbers"))


@query("SELECT r_regionkey::BIGINT AS doc_id, r_name AS region, 'nations' AS last_key FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def json_children(spark: SparkSession, d: str) -> DataFrame:
    """First and last entry of each root object, by captures."""
    p = cut(parse.parse(region_json(spark, d), grammars.json_syntax(), ("node", "cap")))
    n, c = parse.nodes(p), parse.captures(p)
    top = n.where("name = 'Object' AND depth = 1").select("doc_id", "node_id")
    first = navigate.child(c, "members").join(top, ["doc_id", "node_id"]).select("doc_id", F.col("ref_id").alias("node_id"))
    last = navigate.child(c, "members", last=True).join(top, ["doc_id", "node_id"]).select("doc_id", F.col("ref_id").alias("node_id"))
    key = navigate.child(c, "key", kind="token").select("doc_id", "node_id", F.expr("substring(string, 2, length(string) - 2)").alias("s"))
    value = c.where("key = 'value' AND kind = 'node'").select("doc_id", "node_id", F.col("ref_id").alias("v"))
    text = c.where("name = 'String'").select("doc_id", F.col("node_id").alias("v"), F.expr("substring(string, 2, length(string) - 2)").alias("region"))
    region = first.join(value, ["doc_id", "node_id"]).join(text, ["doc_id", "v"]).select("doc_id", "region")
    return region.join(last.join(key, ["doc_id", "node_id"]).select("doc_id", F.col("s").alias("last_key")), "doc_id")


@query(f"SELECT * FROM (VALUES ('Object', {SUPPLIERS}), ('String', {SUPPLIERS})) t(name, n)")
def json_cover(spark: SparkSession, d: str) -> DataFrame:
    """Smallest nodes that cover each supplier's object, and the span inside its name."""
    p = parse.parse(region_json(spark, d), grammars.json_syntax(), ("node",))
    n = parse.nodes(p)
    spans = n.where("name = 'Object' AND depth = 7").select("doc_id", "start", "end")
    inner = n.where("name = 'String' AND depth = 9").select("doc_id", (F.col("start") + 1).alias("start"), (F.col("end") - 1).alias("end"))
    return navigate.cover(n, spans.union(inner)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT * FROM (VALUES ('region', {REGIONS}), ('nations', {REGIONS}), ('nations/name', {NATIONS}), ('nations/suppliers', {NATIONS}), ('nations/suppliers/key', {SUPPLIERS}), ('nations/suppliers/name', {SUPPLIERS})) t(path, n)")
def json_paths(spark: SparkSession, d: str) -> DataFrame:
    """Key paths of all entries."""
    p = cut(parse.parse(region_json(spark, d), grammars.json_syntax(), ("node", "cap")))
    keys = parse.captures(p).where("name = 'Member' AND key = 'key'").select("doc_id", "node_id", F.expr("substring(string, 2, length(string) - 2)").alias("k"))
    n = parse.nodes(p).join(keys, ["doc_id", "node_id"])
    return navigate.paths(n, F.col("k")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT * FROM (VALUES ('container', {REGIONS} + {NATIONS} + {SUPPLIERS} + {REGIONS} + {NATIONS}), ('scalar', {REGIONS} + {NATIONS} + 2 * {SUPPLIERS})) t(class, n)")
def json_class_index(spark: SparkSession, d: str) -> DataFrame:
    g = grammars.json_syntax()
    n = parse.nodes(parse.parse(region_json(spark, d), g, ("node",)))
    return navigate.classes(n, {r.name: r.classes for r in g.rules if r.classes}).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT * FROM (VALUES ('Object', 0::BIGINT), ('Array', 0::BIGINT)) t(name, n) WHERE n > 0 UNION ALL SELECT 'Member', 2 * {REGIONS} UNION ALL SELECT 'Root', {REGIONS} UNION ALL SELECT 'String', {REGIONS} UNION ALL SELECT 'Object', {REGIONS} UNION ALL SELECT 'Array', {REGIONS}")
def json_pruned_traversal(spark: SparkSession, d: str) -> DataFrame:
    """A traversal that doesn't go into arrays."""
    n = parse.nodes(parse.parse(region_json(spark, d), grammars.json_syntax(), ("node",)))
    return navigate.pruned(n, ("Array",)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'unexpected_eoi' WHEN 1 THEN 'insert' WHEN 2 THEN 'panic' END AS recovery, count(*) AS n FROM events GROUP BY 1) WHERE recovery IS NOT NULL")
def json_errors_by_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Errors of broken texts: no closing brace, no colon, no key."""
    e = parse.errors(parse.parse(broken_json(spark, d), grammars.json_syntax(), ("err",)))
    return e.groupBy("recovery").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS doc_id, 1::BIGINT AS n_errors, CASE event_id % 4 WHEN 0 THEN 'unexpected end of input, expected '','' or ''}'' in object' WHEN 1 THEN 'missing '':'' in member' ELSE 'unexpected input, expected member or ''}'' in object' END AS first_message FROM events WHERE event_id % 4 <> 3")
def json_error_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of all broken texts: the end came too soon, something is missing, something was skipped."""
    return messages.reports(broken_json(spark, d), grammars.json_syntax()).select("doc_id", "n_errors", "first_message")


@query("SELECT event_id AS doc_id, length(props) AS chars, 1 AS blanks, 1 AS objects FROM events")
def cst_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The lossless tree covers every character once."""
    c = parse.concrete(parse.parse(props(spark, d), grammars.json_syntax(), ("cst",)))
    leaf = F.col("kind").isin("token", "blank")
    return c.groupBy("doc_id").agg(long(F.sum(F.when(leaf, F.col("end") - F.col("start")))).alias("chars"), F.count_if(F.col("kind") == "blank").cast("int").alias("blanks"), F.count_if((F.col("name") == "Object") & F.col("well_formed")).cast("int").alias("objects"))


@query("SELECT event_id AS doc_id, '{ \"k\": ' || json_extract_string(props, '$.k') || ' }' AS formatted FROM events")
def json_pretty(spark: SparkSession, d: str) -> DataFrame:
    return messages.formatted(props(spark, d))


# -- reports, captures, streams of tokens ---------------------------------------------------------------------------------------

NUMBER = "json_extract_string(props, '$.k')"


@query(f"SELECT event_id AS doc_id, 'Root' || chr(10) || '  document: Object' || chr(10) || '    open: ''{{''' || chr(10) || '    close: ''}}''' || chr(10) || '    members: Member' || chr(10) || '      key: ''\"k\"''' || chr(10) || '      value: Number' || chr(10) || '        value: ''' || {NUMBER} || '''' AS tree FROM events")
def json_tree_display(spark: SparkSession, d: str) -> DataFrame:
    return messages.trees(props(spark, d), grammars.json_syntax())


@query(f"SELECT event_id AS doc_id, '  ┌─ member syntax error' || chr(10) || '1 │ {{\"k\" ' || {NUMBER} || '}}' || chr(10) || '  │     ^ missing '':'' in member' || chr(10) || '  └─ 1 errors' AS report FROM events")
def json_error_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Annotated snippets of texts without their colon."""
    docs = props(spark, d).select("doc_id", F.replace("text", F.lit(":"), F.lit("")).alias("text"))
    return messages.reports(docs, grammars.json_syntax()).select("doc_id", "report")


@query(f"SELECT event_id AS doc_id, '{{' || chr(27) || '[32m\"k\"' || chr(27) || '[0m: ' || chr(27) || '[34m' || {NUMBER} || chr(27) || '[0m}}' AS styled FROM events")
def json_highlighted(spark: SparkSession, d: str) -> DataFrame:
    return messages.highlighted(props(spark, d))


@query(f"SELECT event_id AS doc_id, CASE event_id % 4 WHEN 0 THEN length(props) - 1 WHEN 1 THEN 4 ELSE 1 END::INT AS start, CASE event_id % 4 WHEN 0 THEN length(props) - 1 WHEN 1 THEN 5 ELSE length(props) - 4 END::INT AS end_, CASE event_id % 4 WHEN 1 THEN 'Member' ELSE 'Object' END AS context FROM events WHERE event_id % 4 <> 3")
def json_error_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where errors are, aligned over blanks: one a text."""
    e = parse.errors(parse.parse(broken_json(spark, d), grammars.json_syntax(), ("err",)))
    return e.select("doc_id", "start", F.col("end").alias("end_"), F.col("context_name").alias("context"))


@query(f"SELECT event_id AS doc_id, t.name, key, 1::BIGINT AS n, CASE part WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 6 WHEN 3 THEN length(props) - 1 END::INT AS start, CASE part WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN length(props) - 1 WHEN 3 THEN length(props) END::INT AS end_ FROM events, (VALUES ('Root', 'document', NULL), ('Object', 'open', 0), ('Object', 'members', NULL), ('Object', 'close', 3), ('Member', 'key', 1), ('Member', 'value', NULL), ('Number', 'value', 2)) t(name, key, part)")
def json_capture_groups(spark: SparkSession, d: str) -> DataFrame:
    """Captures by node and key: how many, and the span of captured tokens."""
    g = navigate.capture_groups(parse.captures(parse.parse(props(spark, d), grammars.json_syntax(), ("cap",))))
    return g.where("is_single AND NOT is_empty").select("doc_id", "name", "key", "n", "start", F.col("end").alias("end_"))


@query("SELECT event_id AS doc_id, 0::BIGINT AS ord, 'token' AS kind FROM events UNION ALL SELECT event_id, 1, 'node' FROM events UNION ALL SELECT event_id, 2, 'token' FROM events")
def json_child_order(spark: SparkSession, d: str) -> DataFrame:
    """Children of each object in order: its brace, its member, its brace."""
    p = parse.parse(props(spark, d), grammars.json_syntax(), ("node", "cap"))
    top = parse.nodes(p).where("name = 'Object'").select("doc_id", "node_id")
    return navigate.children(parse.captures(p)).join(top, ["doc_id", "node_id"]).select("doc_id", long("ord").alias("ord"), "kind")


@query("SELECT event_id AS doc_id, CASE event_id % 3 WHEN 1 THEN 3 ELSE 4 END AS first_diff, CASE event_id % 3 WHEN 1 THEN 3 ELSE 1 END::BIGINT AS n_diff FROM events WHERE event_id % 3 <> 0")
def token_stream_compare(spark: SparkSession, d: str) -> DataFrame:
    """Token streams of two versions: equal, without a blank, with another number."""
    docs = props(spark, d)
    k = F.col("doc_id") % 3
    other = docs.select("doc_id", F.when(k == 1, F.replace("text", F.lit(" "), F.lit(""))).when(k == 2, F.replace("text", F.lit(": "), F.lit(": 1"))).otherwise(F.col("text")).alias("text"))
    a, b = (lex.lex(x, grammars.json_lexis(), ("doc_id", "tok_idx", "name", "string")) for x in (docs, other))
    return lex.token_streams_differ(a, b)


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 'immutable' ELSE 'mutable' END AS kind, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 THEN '{\"k\": ' || (c_custkey + 1) || '}' ELSE '{\"k\": ' || c_custkey || '}' END AS text FROM customer WHERE c_custkey % 7 <> 0")
def workspace_documents(spark: SparkSession, d: str) -> DataFrame:
    """A workspace's life: documents added mutable and immutable, converted, named, removed, and the mutable ones
    written to."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name")
    body = lambda k: F.concat(F.lit('{"k": '), k.cast("string"), F.lit("}"))
    w, of = Workspace(spark, grammars.json_syntax()), F.col("doc_id")
    docs = c.select("doc_id", body(of).alias("text"))
    w.add_immutable(docs.where(of % 3 == 0))
    w.add_mutable(docs.where(of % 3 != 0))
    w.into(c.where(of % 5 == 0), "immutable")
    w.set_names(c.where(of % 2 == 0).select("doc_id", F.col("c_name").alias("name")))
    w.remove(c.where(of % 7 == 0))
    log = w.docs.where("kind = 'mutable'").select("doc_id", F.lit(1).cast("long").alias("seq"), F.lit(6).cast("long").alias("start"), (F.length("text") - 1).cast("long").alias("end"), (of + 1).cast("string").alias("text"))
    w.write(log)
    return w.docs.select("doc_id", "kind", "name", "text")


@query("WITH e AS (SELECT CASE WHEN event_id % 2 = 0 THEN props ELSE replace(props, 'k', 'z') END AS p FROM events) SELECT op, count(*) AS n FROM (SELECT 'updated' AS op FROM e, range(3) WHERE p LIKE '%z%') GROUP BY 1")
def workspace_change_feed(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose text a write changes: the key of every other document, and so all nodes above it."""
    docs = props(spark, d)
    w = Workspace(spark, grammars.json_syntax())
    w.add_mutable(docs)
    log = docs.where("doc_id % 2 = 1").select("doc_id", F.lit(1).cast("long").alias("seq"), F.lit(2).cast("long").alias("start"), F.lit(3).cast("long").alias("end"), F.lit("z").alias("text"))
    return w.write(log).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("WITH RECURSIVE s AS (SELECT event_id, 1 AS step FROM events UNION ALL SELECT event_id, step + 1 FROM s WHERE step < 40) SELECT event_id AS doc_id, 'x' || step AS key, 'number' AS status, event_id::VARCHAR AS value FROM s")
def chain_of_forty(spark: SparkSession, d: str) -> DataFrame:
    """A chain of forty names per event, each set to the one before, back to the number at its start."""
    links = "".join(f"x{i} = x{i - 1}; " for i in range(2, 41))
    docs = spread(table(spark, d, "events").select("event_id")).select(F.col("event_id").alias("doc_id"), F.concat(F.lit("{ x1 = "), F.col("event_id").cast("string"), F.lit(f"; {links}}}")).alias("text"))
    return chains.resolve_documents(docs).select("doc_id", "key", "status", "value")


# -- expressions and semantics ------------------------------------------------------------------------------------------------

LINE_ID = "l_orderkey * 8 + l_linenumber"


def _fold_booleans(p: DataFrame) -> DataFrame:
    """Values of all nodes from the leaves up: a round per level, on (doc, node) keys."""
    n, c = parse.nodes(p), parse.captures(p)
    edge = c.where("kind = 'node'").select("doc_id", F.col("node_id").alias("up"), F.col("ref_id").alias("node_id"))
    state = cut(n.where(F.col("name").isin("True", "False")).select("doc_id", "node_id", (F.col("name") == "True").alias("v")))
    inner = cut(n.where(~F.col("name").isin("True", "False")).select("doc_id", F.col("node_id").alias("up"), "name"))
    edge = cut(edge)
    total = inner.count()
    done = 0
    while done < total:
        met = edge.join(state, ["doc_id", "node_id"]).groupBy("doc_id", "up").agg(F.bool_and("v").alias("every"), F.bool_or("v").alias("some"), F.count(F.lit(1)).alias("k"))
        need = edge.groupBy("doc_id", "up").agg(F.count(F.lit(1)).alias("need"))
        new = inner.join(met, ["doc_id", "up"]).join(need, ["doc_id", "up"]).where("k = need")
        v = F.when(F.col("name") == "Or", F.col("some")).when(F.col("name") == "Not", ~F.col("every")).otherwise(F.col("every"))
        state = cut(state.join(new.select("doc_id", F.col("up").alias("node_id")), ["doc_id", "node_id"], "left_anti").unionByName(new.select("doc_id", F.col("up").alias("node_id"), v.alias("v"))))
        done, before = state.join(inner.select("doc_id", F.col("up").alias("node_id")), ["doc_id", "node_id"], "left_semi").count(), done
        if done == before:
            break
    return state


@query("SELECT value, count(*) AS n FROM (SELECT (l_returnflag = 'R') OR ((l_linestatus = 'O') AND (l_quantity > 25) AND NOT ((l_discount < 0.05) OR (l_tax < 0.02))) AS value FROM lineitem) GROUP BY 1")
def bool_eval(spark: SparkSession, d: str) -> DataFrame:
    """Expressions parsed with precedence, and folded."""
    docs = flag_expressions(spark, d).groupBy("text").agg(F.count(F.lit(1)).alias("n")).withColumn("doc_id", F.xxhash64("text"))
    v = _fold_booleans(parse.parse(docs, grammars.boolean_syntax(), ("node", "cap"))).where("node_id = 0")
    return docs.join(v, "doc_id").groupBy(F.col("v").alias("value")).agg(long(F.sum("n")).alias("n"))


@query("SELECT * FROM (VALUES ('Root', 0), ('Or', 1), ('And', 2), ('And', 3), ('Not', 3), ('Group', 4), ('Or', 5)) t(name, depth), (SELECT count(*) AS n FROM lineitem)")
def bool_tree_depth(spark: SparkSession, d: str) -> DataFrame:
    """Shape of the trees: | over & over & and !."""
    n = parse.nodes(parse.parse(flag_expressions(spark, d), grammars.boolean_syntax(), ("node",)))
    return n.where(~F.col("name").isin("True", "False")).groupBy("name", "depth").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT o_orderkey AS doc_id, key, status, CASE WHEN status = 'number' THEN (o_custkey + plus)::VARCHAR END AS value FROM orders, (VALUES ('base', 'number', 0), ('first', 'number', 0), ('copied', 'number', 0), ('base', 'number', 1), ('again', 'number', 1), ('lost', 'broken', 0), ('deep', 'number', 1), ('up', 'number', 0), ('last', 'number', 0), ('later', 'broken', 0)) t(key, status, plus)"
)
def chain_resolution(spark: SparkSession, d: str) -> DataFrame:
    return chains.resolve_documents(chain_programs(spark, d)).select("doc_id", "key", "status", "value")


@query("SELECT 'all_keys' AS class, 10 * count(*) AS n, count(*) AS docs FROM orders")
def chain_class_allkeys(spark: SparkSession, d: str) -> DataFrame:
    g = grammars.chain_syntax()
    n = parse.nodes(parse.parse(chain_programs(spark, d), g, ("node",)))
    return navigate.classes(n, {r.name: r.classes for r in g.rules if r.classes}).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("SELECT * FROM (VALUES (1, 4), (2, 4), (3, 2)) t(scope_depth, per), (SELECT count(*) AS docs FROM orders)")
def scope_of_node(spark: SparkSession, d: str) -> DataFrame:
    """Assignments by the depth of their scope: both meet at the scope's id."""
    n = parse.nodes(parse.parse(chain_programs(spark, d), grammars.chain_syntax(), ("node",), ("id", "name", "depth", "scope_id")))
    block = F.col("name") == "Block"
    at = n.where("name IN ('Block', 'Assignment')").select("doc_id", F.when(block, F.col("node_id")).otherwise(F.col("scope_id")).alias("at"), F.when(block, F.col("depth")).alias("depth"))
    scope = at.repartition("doc_id").groupBy("doc_id", "at").agg(F.max("depth").alias("scope_depth"), F.count_if(F.col("depth").isNull()).alias("n"))
    per = scope.where("n > 0 AND at IS NOT NULL").groupBy("doc_id", "scope_depth").agg(F.sum("n").alias("per"))
    return per.groupBy("scope_depth", per["per"].cast("int").alias("per")).agg(F.count(F.lit(1)).alias("docs"))


@query(
    "WITH RECURSIVE c AS (SELECT c_custkey AS k, c_custkey AS pos FROM customer UNION ALL SELECT k, pos - 1 FROM c WHERE pos % 5 <> 0 AND pos % 7 <> 0 AND pos % 11 <> 0 AND pos > 0 AND (pos - 1) IN (SELECT c_custkey FROM customer)), e AS (SELECT k, min(pos) AS pos FROM c GROUP BY 1) SELECT 'n' || c_nationkey AS module, 'c' || k AS key, CASE WHEN pos % 5 = 0 THEN 'number' WHEN pos % 7 = 0 THEN 'unresolved' WHEN pos % 11 = 0 THEN 'recursive' ELSE 'unresolved' END AS status, CASE WHEN pos % 5 = 0 THEN pos::VARCHAR END AS value FROM e JOIN customer ON c_custkey = k"
)
def module_resolution(spark: SparkSession, d: str) -> DataFrame:
    docs, names = customer_modules(spark, d)
    p = cut(parse.parse(docs, grammars.module_syntax(), ("node", "cap")))
    return modules.resolve(cut(modules.definitions(parse.nodes(p), parse.captures(p), names)))


# -- incremental ------------------------------------------------------------------------------------------------------------------


def edit_log(spark: SparkSession, d: str) -> DataFrame:
    """A document per user; each event puts its type and a newline before the text."""
    e = table(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select(F.col("user_id").alias("doc_id"), seq.alias("seq"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.concat("event_type", F.lit("\n")).alias("text"))


@query("SELECT user_id AS doc_id, string_agg(event_type || chr(10), '' ORDER BY ts DESC, event_id DESC) AS text, count(*) AS revision FROM events GROUP BY 1")
def edit_fold(spark: SparkSession, d: str) -> DataFrame:
    log = edit_log(spark, d)
    return edits.fold(log.select("doc_id").distinct().withColumn("text", F.lit("")), log).select("doc_id", "text", "revision")


@query("SELECT event_id AS doc_id, '{\"k\": ' || (event_id % 3) || '}' AS text, 'Number' AS name, (event_id % 3)::VARCHAR AS string FROM events")
def json_incremental_equiv(spark: SparkSession, d: str) -> DataFrame:
    """The number of each text is written over: the tree of the folded text."""
    docs = props(spark, d)
    log = docs.select("doc_id", F.lit(1).cast("long").alias("seq"), F.lit(6).cast("long").alias("start"), (F.length("text") - 1).cast("long").alias("end"), (F.col("doc_id") % 3).cast("string").alias("text"))
    new = edits.fold(docs, log)
    c = parse.captures(parse.parse(new, grammars.json_syntax(), ("cap",))).where("name = 'Number'")
    return new.select("doc_id", "text").join(c.select("doc_id", "name", "string"), "doc_id")


@query("SELECT op, count(*) AS n FROM (SELECT CASE WHEN event_id % 4 = 0 THEN 'removed' WHEN event_id % 4 = 1 THEN 'updated' WHEN event_id % 4 = 2 THEN 'created' END AS op FROM events) WHERE op IS NOT NULL GROUP BY 1")
def json_change_feed(spark: SparkSession, d: str) -> DataFrame:
    """Changes of number nodes between two versions: emptied, overwritten, given a second entry, or left."""
    docs = props(spark, d)
    k = F.col("doc_id") % 4
    text = F.when(k == 1, F.concat(F.lit('{"k": "x'), F.col("doc_id").cast("string"), F.lit('"}'))).when(k == 0, F.lit("{}")).when(k == 2, F.concat(F.expr("substring(text, 1, length(text) - 1)"), F.lit(', "z": 1}'))).otherwise(F.col("text"))
    new = docs.select("doc_id", text.alias("text"))

    def values(x: DataFrame) -> DataFrame:
        p = parse.captures(parse.parse(x, grammars.json_syntax(), ("cap",)))
        v = p.where("name IN ('Number', 'String')").select("doc_id", "node_id", F.col("string").alias("value"))
        by = Window.partitionBy("doc_id").orderBy("node_id")
        return v.select("doc_id", F.row_number().over(by).alias("ref"), "value")

    return edits.changes(values(docs), values(new)).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type FROM events) SELECT user_id AS doc_id, CASE event_type WHEN 'error' THEN 4 ELSE 3 END AS event, max(seq) AS revision FROM r GROUP BY ALL UNION ALL SELECT NULL, CASE event_type WHEN 'error' THEN 4 ELSE 3 END, max(seq) FROM r GROUP BY ALL")
def event_invalidation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    event = F.when(F.col("event_type") == "error", revisions.DOC_ERRORS).otherwise(revisions.DOC_UPDATED)
    return revisions.event_revisions(e.select(F.col("user_id").alias("doc_id"), event.alias("event"), seq.alias("revision")))


@query("SELECT event_id AS attr_id, (json_extract(props, '$.k')::BIGINT // 10)::VARCHAR AS value, CASE WHEN json_extract(props, '$.k')::BIGINT // 10 <> (json_extract(props, '$.k')::BIGINT + 3) // 10 THEN 2 ELSE 1 END::INT AS updated_at FROM events WHERE json_extract(props, '$.k')::BIGINT // 10 = (json_extract(props, '$.k')::BIGINT + 3) // 10 UNION ALL SELECT event_id, ((json_extract(props, '$.k')::BIGINT + 3) // 10)::VARCHAR, 2 FROM events WHERE json_extract(props, '$.k')::BIGINT // 10 <> (json_extract(props, '$.k')::BIGINT + 3) // 10")
def attr_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """An attribute (the number's tens) after all numbers grew by 3: updated only where the value changed."""
    c = parse.captures(parse.parse(props(spark, d), grammars.json_syntax(), ("cap",))).where("name = 'Number'")
    tens = lambda x: F.floor(x / 10).cast("long").cast("string")
    old = c.select(F.col("doc_id").alias("attr_id"), tens(long("string")).alias("value"), F.lit(1).alias("updated_at"))
    new = c.select(F.col("doc_id").alias("attr_id"), tens(long("string") + 3).alias("value"))
    return revisions.verified(old, new, 2).select("attr_id", "value", "updated_at")


@query("WITH e AS (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, CASE event_id % 4 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS more FROM events) SELECT event_id AS doc_id, (3 * (k + more))::VARCHAR AS total, (3 * (k + more)) <> k AS total_changed, ((k + more) % 2)::VARCHAR AS parity, (more = 1) AS parity_changed FROM e WHERE event_id % 5 <> 0")
def attribute_graph(spark: SparkSession, d: str) -> DataFrame:
    """Two attributes over every event's text: an object's total (its numbers, read as tokens, times a slot) and the
    root's parity, which reads the total. Then numbers grow by two, by one or not at all, a fifth of the documents goes,
    and the slot turns from 1 to 3: the parity changes only with numbers that grew by one."""
    w = Workspace(spark, grammars.json_syntax())
    w.mutate_slot("factor", lambda _: (True, 1))
    w.add_mutable(props(spark, d))

    def total_reads(t: attributes.Trees) -> DataFrame:
        objects = t.nodes.where("name = 'Object'").select("doc_id", "node_id")
        below = navigate.descendants(t.nodes).where("ancestor_name = 'Object' AND name = 'Number'")
        numbers = below.select("doc_id", F.col("ancestor_id").alias("node_id"), F.lit("number").alias("key"), attributes.token("doc_id", "node_id", "value").alias("on"))
        return objects.select("*", F.lit("factor").alias("key"), attributes.slot("factor").alias("on")).unionByName(numbers)

    def total(key, read):
        of = lambda k: F.when(key == k, read).try_cast("long")
        return F.sum(of("number")) * F.max(of("factor"))

    def parity_reads(t: attributes.Trees) -> DataFrame:
        top = t.captures.where("name = 'Root' AND kind = 'node'")
        return top.select("doc_id", "node_id", F.lit("total").alias("key"), attributes.attribute("doc_id", "ref_id", "total").alias("on"))

    g = attributes.AttributeGraph(w, [attributes.Attribute("total", total_reads, total), attributes.Attribute("parity", parity_reads, lambda _, read: F.max(read.try_cast("long") % 2))])
    g.refresh()
    first = w.revision
    number = F.substring_index(F.substring_index("text", ": ", -1), "}", 1).cast("long")
    grown = w.docs.where("doc_id % 4 IN (1, 2)").select("doc_id", (number + F.when(F.col("doc_id") % 4 == 1, 2).otherwise(1)).cast("string").alias("new"), F.length("text").alias("n"))
    w.write(grown.select("doc_id", F.lit(1).cast("long").alias("seq"), F.lit(6).cast("long").alias("start"), (F.col("n") - 1).cast("long").alias("end"), F.col("new").alias("text")))
    w.remove(w.docs.where("doc_id % 5 = 0").select("doc_id"))
    w.mutate_slot("factor", lambda _: (True, 3))
    g.refresh()
    of = lambda name: g.snapshot(name).select("doc_id", F.col("value").alias(name), (F.col("updated_at") > first).alias(f"{name}_changed"))
    return of("total").join(of("parity"), "doc_id")


@query("WITH c AS (SELECT c_custkey AS doc_id FROM customer WHERE c_custkey % 7 <> 0) SELECT doc_id, 'scalar' AS class, CASE doc_id % 3 WHEN 0 THEN 1 ELSE 2 END::BIGINT AS n FROM c UNION ALL SELECT doc_id, 'large', 1 FROM c WHERE doc_id > 99 AND doc_id % 3 = 0")
def workspace_classes(spark: SparkSession, d: str) -> DataFrame:
    """Class snapshots before and after changes: a class of rules and one of a condition on the nodes' text. Two thirds of
    the numbers give way to an array of two, a seventh of the documents goes."""
    w = Workspace(spark, grammars.json_syntax(), {"large": (F.col("name") == "Number") & (F.length("text") > 2)})
    of = F.col("doc_id")
    w.add_mutable(table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit('{"k": '), F.col("c_custkey").cast("string"), F.lit("}")).alias("text")))
    w.snapshot_class("scalar")
    w.write(w.docs.where(of % 3 != 0).select("doc_id", F.lit(1).cast("long").alias("seq"), F.lit(6).cast("long").alias("start"), (F.length("text") - 1).cast("long").alias("end"), F.lit("[1, true]").alias("text")))
    w.remove(w.docs.where(of % 7 == 0).select("doc_id"))
    both = w.snapshot_class("scalar").unionByName(w.snapshot_class("large"))
    return both.groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("n"))


def thirds(df: DataFrame, by: str) -> list[DataFrame]:
    """The rows in three ranges of ``by``, in order; all at once if there are none."""
    low, high = df.agg(F.min(by), F.max(by)).first()
    if low is None:
        return [df]
    step = (high - low) // 3 + 1
    return [df.where((F.col(by) >= low + k * step) & (F.col(by) < low + (k + 1) * step)) for k in range(3)]


def in_thirds(df: DataFrame, by: str, name: str) -> str:
    """A folder of files that arrive one after the other, in the order of ``by``."""
    path = folder(df.sparkSession, name)
    for part in thirds(df, by):
        part.write.mode("append").parquet(path)
    return path


@query("SELECT user_id AS doc_id, string_agg(event_type || chr(10), '' ORDER BY event_id DESC) AS text, max(event_id) + 1 AS revision FROM events GROUP BY 1")
def edit_stream(spark: SparkSession, d: str) -> DataFrame:
    """The fold as a stream: documents' state is their text, versions are appended per micro-batch, the last counts.
    Files of one third come in no order of seq, so the stream takes each third whole, in one micro-batch, as it arrives."""
    log = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") + 1).alias("seq"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.concat("event_type", F.lit("\n")).alias("text"))
    source, out, checkpoint = folder(spark, "edit-log"), folder(spark, "versions"), folder(spark, "stream")
    for part in thirds(log, "seq"):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(log.schema).parquet(source)
        edits.run_available(stream, lambda df, _: df.write.mode("append").parquet(out), checkpoint)
    last = spark.read.schema(edits.VERSION).parquet(out).groupBy("doc_id")
    return last.agg(F.max_by("text", "revision").alias("text"), F.max("revision").alias("revision"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, sum(value * 100)::DECIMAL(18, 0)::BIGINT AS cents FROM (SELECT ts, round(value, 2) AS value FROM events) GROUP BY 1")
def event_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows over a stream with a watermark: the last result of each window."""
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.round(F.round("value", 2) * 100).cast("long").alias("cents"))
    source, out = in_thirds(e, "event_id", "event-log"), folder(spark, "windows")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 64).parquet(source).withWatermark("ts", "40 days")
    agg = stream.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    q = agg.writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).option("checkpointLocation", folder(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    last = spark.read.parquet(out).groupBy("w").agg(F.max_by(F.struct("n", "cents"), "batch").alias("x"))
    return last.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "x.n", "x.cents")


# -- relational baseline ------------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(long(F.sum("l_quantity")).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def orders_by_nation(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey")
def left_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_quantity > 45")
    return table(spark, d, "part").join(li, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("WITH e AS (SELECT * FROM events WHERE event_type = 'error'), c AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT e.event_id, c.value AS asof_value FROM e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts")
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    """Errors with the latest click before them."""
    e = table(spark, d, "events")
    c = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return relational.asof_join(e.where("event_type = 'error'"), c, "user_id", "ts", "value").select("event_id", "asof_value")


@query("SELECT p_size AS size, count(*) AS n FROM lineitem JOIN part ON l_quantity >= p_size AND l_quantity < p_size + 0.5 WHERE p_brand = 'Brand#2' GROUP BY 1")
def range_join(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where("p_brand = 'Brand#2'").select(F.col("p_size").alias("size"), F.col("p_size").cast("double").alias("low"), (F.col("p_size") + 0.5).alias("high"))
    return relational.range_join(table(spark, d, "lineitem").select("l_quantity"), p, "l_quantity", "low", "high", 4.0).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, p_type, count(*) AS n, max(p_size) AS biggest FROM part GROUP BY ROLLUP (p_brand, p_type)")
def rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").rollup("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("biggest"))


@query("SELECT * FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer) WHERE rank <= 3")
def top_customers(spark: SparkSession, d: str) -> DataFrame:
    return relational.top_k(table(spark, d, "customer"), ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "rank")


@query("SELECT event_id, lag(event_type) OVER w AS before, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth, ntile(4) OVER w AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("event_type").over(w).alias("before"), F.count(F.lit(1)).over(w).alias("nth"), long(F.ntile(4).over(w)).alias("quarter"))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM s GROUP BY user_id, sid")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return relational.sessions(table(spark, d, "events"), "user_id", "ts", "30 minutes")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    w = F.window(F.col("ts"), "1 day")
    return table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


@query("SELECT k, 'both' AS side FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'customer' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'all' FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"both": a.intersect(b), "customer": a.subtract(b), "all": a.union(b).distinct()}
    named = [x.withColumn("side", F.lit(k)) for k, x in parts.items()]
    return named[0].union(named[1]).union(named[2])


@query("SELECT * FROM (WITH t AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh FROM events) SELECT user_id, sum(fresh)::BIGINT AS islands FROM t GROUP BY 1)")
def event_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events of one type per user."""
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return relational.islands(e, ["user_id"], "o", F.col("event_type")).groupBy("user_id").agg(long(F.max("island")).alias("islands"))

@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def dearest_orders(spark: SparkSession, d: str) -> DataFrame:
    """The top of a global order: each task keeps its own 25, no full sort."""
    return table(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


BIG_CUSTOMERS = "WITH t AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) SELECT c_custkey, n FROM {customer} JOIN t ON c_custkey = o_custkey WHERE n > (SELECT avg(n) FROM t) AND c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey < 3) AND EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"


@query(BIG_CUSTOMERS.format(orders="orders", customer="customer", nation="nation"))
def sql_subqueries(spark: SparkSession, d: str) -> DataFrame:
    """A statement in SQL: a common table expression, a scalar, an IN and a correlated subquery."""
    return spark.sql(BIG_CUSTOMERS, **{t: table(spark, d, t) for t in ("orders", "customer", "nation")})
