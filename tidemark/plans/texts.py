"""Text queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import spread
from tidemark.functions.columns import content_hash as digest
from tidemark.functions.columns import poisson_deviance
from tidemark.operators import facts as X
from tidemark.operators import text as T
from tidemark.sources import files

from .base import registered, table

QUERIES, SQL, query = registered()

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_ENT = "html"
for _e, _c in T.ENTITIES:
    _ENT = f"replace({_ENT}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"
_CLEAN = "trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ', 'g'))".format(_ENT.replace("html", "regexp_replace(html, '<[^>]+>', ' ', 'g')", 1))
TOKENS_SQL = f"list_filter(list_transform(regexp_extract_all(text, '{T.TOKEN}'), lambda t: lower(t)), lambda t: t NOT IN ({_STOP}))"


@query(f"SELECT page_id, length(c) AS n, sha256(c) AS digest FROM (SELECT page_id, {_CLEAN} AS c FROM pages)")
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    """Tags and entities out of whole pages."""
    return table(spark, d, "pages").select("page_id", T.clean(F.col("html")).alias("c")).select("page_id", F.length("c").cast("long").alias("n"), F.sha2("c", 256).alias("digest"))


@query("""WITH u AS (SELECT page_id, url, regexp_extract(url, '^([^:]+)://([^/?#]+)([^?#]*)\\??([^#]*)', ['p', 'h', 'path', 'q']) AS x FROM pages),
k AS (SELECT page_id, x, array_to_string(list_filter(string_split(x.q, '&'), lambda y: regexp_matches(y, '^[^=]+=.') AND NOT regexp_matches(y, '(?i)^(utm_|spm|from)')), '&') AS kept FROM u)
SELECT page_id, regexp_replace(x.p || '://' || lower(x.h) || x.path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END, '/+$', '') AS canonical FROM k""")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Canonical addresses."""
    return table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


@query("SELECT sha256(regexp_replace(lower(text), '\\s+', '', 'g')) AS cluster, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def exact_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of equal text, white space and case apart."""
    return table(spark, d, "documents").groupBy(T.exact_key(F.col("text")).alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY 1")
def token_extract(spark: SparkSession, d: str) -> DataFrame:
    """T4: terms by number and documents."""
    t = spread(table(spark, d, "documents")).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    per = t.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("term").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs"))


@query("""WITH g AS (SELECT unnest(list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2])) AS gram FROM (SELECT lower(text) AS t FROM conversations WHERE length(text) >= 3)) SELECT gram, count(*) AS n FROM g GROUP BY 1""")
def char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """T5: character trigrams of whole texts."""
    c = table(spark, d, "conversations").select(F.explode(T.char_grams(F.lower("text"), 3)).alias("gram"))
    return c.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


_GRAM_STOPS = ("and", "steel", "o")
_LETTERS = "a-zà-ÿ"
_PARTED = "lower(p_name)"
for _w in sorted(_GRAM_STOPS, key=lambda x: (-len(x), x)):
    _PARTED = f"replace({_PARTED}, '{_w}', ' ')"
GRAMS_SQL = f"""sp AS (SELECT p_partkey, unnest(regexp_extract_all({_PARTED}, '[{_LETTERS}]{{{{2,}}}}')) AS span FROM part),
gm AS (SELECT DISTINCT p_partkey, unnest(flatten(list_transform(range(2, least(8, length(span)) + 1), lambda n: list_transform(range(1, length(span) - n + 2), lambda i: substr(span, i, n))))) AS term FROM sp),
tn AS (SELECT term, count(*) AS n FROM gm GROUP BY 1)""".replace("{{2,}}", "{2,}")


def name_grams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.explode(T.span_grams(F.lower("p_name"), _GRAM_STOPS, _LETTERS)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GRAMS_SQL} SELECT * FROM tn")
def phrase_grams(spark: SparkSession, d: str) -> DataFrame:
    """T5: runs of two to eight letters in the stretches between stop words, by the rows that hold them."""
    return name_grams(spark, d)


@query()
def phrase_substrings(spark: SparkSession, d: str) -> DataFrame:
    """Phrases without those that a longer one explains within 1.15 times its support."""

    def keep(df: DataFrame) -> DataFrame:
        path = files.scratch(spark, "phrases")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return T.prune_substrings(name_grams(spark, d), 1.15, keep)


PHRASES_SQL = f"""w AS (SELECT doc_id, source, doc_id % 2 = 0 AS recent, {TOKENS_SQL} AS w FROM documents),
t AS (SELECT source, recent, unnest(list_distinct(list_concat(w, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END))) AS term FROM w),
ph AS MATERIALIZED (SELECT term, count(*) FILTER (WHERE recent) AS n_recent, count(*) FILTER (WHERE NOT recent) AS n_past, count(DISTINCT CASE WHEN recent THEN source END) AS n_sources FROM t GROUP BY 1 HAVING count(*) FILTER (WHERE recent) >= 3)"""


def phrases(spark: SparkSession, d: str) -> DataFrame:
    return T.phrase_counts(spread(table(spark, d, "documents")), "doc_id", "text", "source", F.col("doc_id") % 2 == 0, 3)


@query(f"""WITH {PHRASES_SQL}, b AS (SELECT *, (n_recent + 0.5::DOUBLE) / (n_past + 0.5::DOUBLE) AS burst, 2 * (n_recent * ln(n_recent / (n_past + 0.5::DOUBLE)) - (n_recent - (n_past + 0.5::DOUBLE))) AS deviance FROM ph)
SELECT term, n_recent, n_past, n_sources, round(burst, 6) AS burst, round(deviance, 6) AS deviance, n_sources >= 2 AND burst >= 2 AS eligible FROM b ORDER BY n_sources >= 2 AND burst >= 2 DESC, round(deviance, 6) DESC, n_sources DESC, n_recent DESC, term LIMIT 40""")
def phrase_burst(spark: SparkSession, d: str) -> DataFrame:
    """The forty phrases that grew most; the limit is the report's length."""
    expected = F.col("n_past") + 0.5
    b = phrases(spark, d).withColumn("burst", F.round((F.col("n_recent") + 0.5) / expected, 6)).withColumn("deviance", F.round(poisson_deviance(F.col("n_recent"), expected), 6))
    b = b.withColumn("eligible", (F.col("n_sources") >= 2) & ((F.col("n_recent") + 0.5) / expected >= 2))
    return b.select("term", "n_recent", "n_past", "n_sources", "burst", "deviance", "eligible").orderBy(F.desc("eligible"), F.desc("deviance"), F.desc("n_sources"), F.desc("n_recent"), "term").limit(40)


@query(f"WITH {PHRASES_SQL} SELECT term, n_recent, n_past, n_sources FROM ph")
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents and sources of terms and pairs, recent and past."""
    return phrases(spark, d)


@query(f"""WITH {PHRASES_SQL}, p AS (SELECT word, max(n_recent) AS n_pair FROM (SELECT n_recent, unnest(list_distinct(string_split(term, ' '))) AS word FROM ph WHERE contains(term, ' ')) GROUP BY 1)
SELECT ph.term, ph.n_recent FROM ph LEFT JOIN p ON ph.term = p.word WHERE n_pair IS NULL OR ph.n_recent > 1.15::DOUBLE * n_pair""")
def phrase_prune(spark: SparkSession, d: str) -> DataFrame:
    """Single words that a pair explains are dropped."""
    return T.pruned_phrases(files.kept(phrases(spark, d), "phrases"), 1.15).select("term", "n_recent")


DICTIONARY = [("english", "the", None), ("english", "and", None), ("french", "les", None), ("german", "und", None), ("spanish", "para", None), ("insult", "idiot", None), ("insult", "stupid", None), ("secret", "password", "token"), ("secret", "token", "password"), ("there", "there", "the")]
_DICT = ", ".join(f"('{t}', '{w}', {'NULL' if c is None else repr(c)})" for t, w, c in DICTIONARY)


@query(f"""WITH dict(topic, term, context) AS (VALUES {_DICT}), w AS (SELECT doc_id, word, count(*) AS hits FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda t: lower(t))) AS word FROM documents) GROUP BY 1, 2)
SELECT w.doc_id, topic, CAST(sum(hits) AS BIGINT) AS hits FROM w JOIN dict ON word = term WHERE context IS NULL OR EXISTS (SELECT 1 FROM w x WHERE x.doc_id = w.doc_id AND x.word = dict.context) GROUP BY 1, 2""")
def term_match_join(spark: SparkSession, d: str) -> DataFrame:
    """Topics of documents by a dictionary, some with a word that must stand beside."""
    dictionary = spark.createDataFrame(DICTIONARY, "topic string, term string, context string")
    return T.match_terms(spread(table(spark, d, "documents")), dictionary, "doc_id", "text")


ANYWHERE = [
    ("nature", "eau", True, None, None), ("nature", "berg", True, None, None), ("time", "stund", True, None, "nature"), ("speech", "tion", True, "the", "thought"), ("speech", "ción", True, "una", "thought"),
    ("article", "the", False, None, "grammar"), ("article", "les", False, None, "grammar"), ("umlaut", "ü", None, None, "sound"), ("sound", "éé", None, None, "speech"), ("thought", "denk", True, None, "grammar"), ("secret", "pass", True, "password", None),
]
_ANY = ", ".join("(" + ", ".join("NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" for x in r) + ")" for r in ANYWHERE)


def _held(term: str, inside: str) -> str:
    return f"CASE WHEN {inside} THEN contains(t, {term}) ELSE regexp_matches(t, '(^|[^a-z0-9])' || {term} || '($|[^a-z0-9])') END"


@query(f"""WITH RECURSIVE dict(topic, term, inside, context, parent) AS (VALUES {_ANY}), d AS (SELECT doc_id, lower(text) AS t FROM documents UNION ALL SELECT -1 - p_partkey, lower(p_name) FROM part),
k AS (SELECT *, coalesce(inside, NOT regexp_matches(term, '^[a-zA-Z0-9 $/-]+$')) AS ins FROM dict), hit AS (SELECT DISTINCT doc_id, topic, term FROM d, k WHERE {_held("term", "ins")}), cx AS (SELECT DISTINCT doc_id, topic FROM d, k WHERE context IS NOT NULL AND {_held("context", "false")}),
x AS (SELECT doc_id, topic, count(*) AS terms FROM hit WHERE topic NOT IN (SELECT topic FROM dict WHERE context IS NOT NULL) OR (doc_id, topic) IN (SELECT (doc_id, topic) FROM cx) GROUP BY 1, 2),
up(topic, ancestor) AS (SELECT topic, parent FROM dict WHERE parent IS NOT NULL UNION SELECT up.topic, dict.parent FROM up JOIN dict ON dict.topic = up.ancestor WHERE dict.parent IS NOT NULL)
SELECT doc_id, topic, min(how) AS how, max(terms) AS terms FROM (SELECT doc_id, topic, 'explicit' AS how, terms FROM x UNION ALL SELECT doc_id, ancestor, 'implied', 0 FROM x JOIN up USING (topic) WHERE ancestor <> topic) GROUP BY 1, 2""")
def term_match_anywhere(spark: SparkSession, d: str) -> DataFrame:
    """Topics of documents and part names by terms inside words, with contexts and implied ancestors."""
    dictionary = spark.createDataFrame(ANYWHERE, "topic string, term string, inside boolean, context string, parent string")
    texts = spread(table(spark, d, "documents")).select("doc_id", "text").unionByName(table(spark, d, "part").select((-1 - F.col("p_partkey")).alias("doc_id"), F.col("p_name").alias("text")))
    return T.match_anywhere(texts, dictionary, "doc_id", "text")


#: Announcements beside each document's text: the fixture's own texts have none.
NOTES = (
    "公司签订合同，金额1,250亿元；否认财务造假",
    "公司公告：2023年度净利润增长15％，营收3万亿元",
    "网传订单取消，但公司否认立案调查且确认减值2千元",
    "召开2024年第一次临时股东大会；价格为何下降？",
    "新线投产，产能1.5GW、8万吨，美元3万元设备",
    "据传亏损扩大并被否认，预计产品发布",
)
_NOTE_SQL = "CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NOTES)) + " END"


def noted(spark: SparkSession, d: str) -> DataFrame:
    note = F.element_at(F.array(*map(F.lit, NOTES)), (F.col("doc_id") % 6 + 1).cast("int"))
    return spread(table(spark, d, "documents")).withColumn("text", F.concat(note, F.lit("。"), F.coalesce("text", F.lit(""))))


def _kind_sql(kinds: dict[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(t, '(?i){p}') THEN '{k}'" for k, p in kinds.items()) + f" ELSE '{otherwise}' END"


@query(f"""SELECT doc_id, {_kind_sql(X.CONTENT_TYPES, "other")} AS content_type, {_kind_sql(X.NOVELTY, "unclassified")} AS novelty, regexp_matches(t, '(?i){X.NEGATIVE}') AS negative, regexp_matches(t, '(?i){X.DENIAL}') AS denied FROM (SELECT doc_id, {_NOTE_SQL} || '。' || coalesce(text, '') AS t FROM documents)""")
def classify_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The first pattern that matches names the kind of content, and how new it is; whether anything negative or a denial is said."""
    t = F.col("text")
    return noted(spark, d).select("doc_id", X.content_kind(t, X.CONTENT_TYPES, "other").alias("content_type"), X.content_kind(t, X.NOVELTY, "unclassified").alias("novelty"), t.rlike(f"(?i){X.NEGATIVE}").alias("negative"), t.rlike(f"(?i){X.DENIAL}").alias("denied"))


@query("""SELECT source, lang, count(*) AS n, count(DISTINCT sha256(text)) AS texts, round(CAST(count(DISTINCT sha256(text)) AS DOUBLE) / count(*), 6) AS novelty, max(length(text)) AS longest, count(*) FILTER (WHERE length(text) < 500) AS short_n FROM documents GROUP BY 1, 2""")
def info_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What a source published: number, distinct texts, novelty, lengths."""
    h = F.sha2("text", 256)
    return table(spark, d, "documents").groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(h).alias("texts"), F.round(F.countDistinct(h).cast("double") / F.count(F.lit(1)), 6).alias("novelty"), F.max(F.length("text")).cast("long").alias("longest"), F.count_if(F.length("text") < 500).alias("short_n")
    )


@query("SELECT source, map_from_entries(list({'k': lang, 'v': n} ORDER BY lang)) IS NOT NULL AS filled, string_agg(lang || ':' || n, ',' ORDER BY lang) AS counts FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def counters_map(spark: SparkSession, d: str) -> DataFrame:
    """Counts as a map, read back in key order."""
    c = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n")))).alias("m"))
    return m.select("source", F.col("m").isNotNull().alias("filled"), F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query(f"""WITH {PHRASES_SQL} SELECT term, n_recent, row_number() OVER (ORDER BY n_recent DESC, term) AS place, upper(term) AS canonical FROM ph WHERE n_sources >= 5 ORDER BY n_recent DESC, term LIMIT 50""")
def promote_terms(spark: SparkSession, d: str) -> DataFrame:
    """The terms of most sources become topics, fifty at most."""
    top = phrases(spark, d).where("n_sources >= 5").orderBy(F.desc("n_recent"), "term").limit(50)
    return top.select("term", "n_recent", F.row_number().over(Window.orderBy(F.desc("n_recent"), "term")).cast("long").alias("place"), F.upper("term").alias("canonical"))


@query("SELECT page_id, substr(sha256(concat_ws(chr(31), url, CAST(page_id AS VARCHAR), html)), 1, 32) AS id FROM pages")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Content digests of 32 digits."""
    return table(spark, d, "pages").select("page_id", digest(F.col("url"), F.col("page_id").cast("string"), F.col("html")).alias("id"))


@query("SELECT doc_id, len(c) AS clauses, len(list_filter(c, lambda x: regexp_matches(x, '[0-9]'))) AS with_numbers FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([0-9]),([0-9]{3})', '\\1\\2', 'g'), '[.!?;\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS c FROM documents)")
def clause_split(spark: SparkSession, d: str) -> DataFrame:
    """Clauses, thousands separators closed up first."""
    c = F.filter(F.transform(F.split(F.regexp_replace("text", "([0-9]),([0-9]{3})", "$1$2"), "[.!?;\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", c.alias("c")).select("doc_id", F.size("c").cast("long").alias("clauses"), F.size(F.filter("c", lambda x: x.rlike("[0-9]"))).cast("long").alias("with_numbers"))


@query("""WITH c AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'SH' WHEN 1 THEN 'sz.' WHEN 2 THEN '' ELSE ' ' END || lpad(CAST(CASE WHEN p_partkey % 3 = 0 THEN 600000 + p_partkey WHEN p_partkey % 3 = 1 THEN p_partkey ELSE 300000 + p_partkey END AS VARCHAR), 6, '0') AS code FROM part),
x AS (SELECT p_partkey, regexp_extract(code, '([0-9]{6})', 1) AS n FROM c) SELECT p_partkey, CASE WHEN n = '' THEN NULL WHEN n[1] IN ('6', '9') THEN n || '.SH' WHEN n[1] IN ('0', '2', '3') THEN n || '.SZ' ELSE n || '.BJ' END AS id FROM x""")
def id_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Instrument ids from codes of several spellings; the exchange follows from the first digit."""
    k = F.col("p_partkey")
    number = F.when(k % 3 == 0, 600000 + k).when(k % 3 == 1, k).otherwise(300000 + k)
    code = F.concat(F.when(k % 4 == 0, "SH").when(k % 4 == 1, "sz.").when(k % 4 == 2, "").otherwise(" "), F.lpad(number.cast("string"), 6, "0"))
    n = F.regexp_extract(code, "([0-9]{6})", 1)
    first = F.substring(n, 1, 1)
    return table(spark, d, "part").select("p_partkey", F.when(n == "", None).when(first.isin("6", "9"), F.concat(n, F.lit(".SH"))).when(first.isin("0", "2", "3"), F.concat(n, F.lit(".SZ"))).otherwise(F.concat(n, F.lit(".BJ"))).alias("id"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(v, '^[=+\\-@\\t\\r]') THEN '''' || v ELSE v END AS cell FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE '' END || p_name AS v FROM part)""")
def csv_escape(spark: SparkSession, d: str) -> DataFrame:
    """Cells that a spreadsheet would take for formulas."""
    k = F.col("p_partkey") % 5
    v = F.concat(F.when(k == 0, "=").when(k == 1, "+").when(k == 2, "-").when(k == 3, "@").otherwise(""), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.when(v.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), v)).otherwise(v).alias("cell"))


@query("SELECT p_partkey, regexp_matches(p_name, '(?i)(^|\\s)small|ring$') AS flagged FROM part")
def name_flag(spark: SparkSession, d: str) -> DataFrame:
    """Names that a pattern marks."""
    return table(spark, d, "part").select("p_partkey", F.col("p_name").rlike(r"(?i)(^|\s)small|ring$").alias("flagged"))


@query()
def nfkc(spark: SparkSession, d: str) -> DataFrame:
    """Compatibility forms folded; Spark has no function for it."""
    wide = F.concat(F.col("text"), F.lit(" Ａｂｃ１２ ﬁ"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(T.nfkc(wide), 256).alias("digest"))


_UNIT_SQL = "CASE lower(u) " + " ".join(f"WHEN '{k}' THEN '{u}:{m}'" for k, (u, m) in X.UNITS.items()) + " END"
_UNITS_RE = "|".join(sorted(X.UNITS, key=len, reverse=True))


@query(f"""WITH d AS (SELECT doc_id, {_NOTE_SQL} || '。' || coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, t, regexp_extract_all(t, '(?i)[0-9][0-9,]*(?:\\.[0-9]+)?\\s*(?:{_UNITS_RE})') AS raws, string_split_regex(t, '(?i)[0-9][0-9,]*(?:\\.[0-9]+)?\\s*(?:{_UNITS_RE})') AS parts FROM d),
r AS (SELECT doc_id, t, raws[i] AS raw, length(array_to_string(raws[1:i - 1], '')) + length(array_to_string(parts[1:i], '')) AS pos FROM (SELECT *, unnest(range(1, len(raws) + 1)) AS i FROM m)),
u AS (SELECT *, regexp_extract(raw, '(?i)({_UNITS_RE})$', 1) AS u, replace(regexp_extract(raw, '^[0-9,.]+'), ',', '') AS v, substring(t, greatest(pos - 3, 1), least(pos, 4)) AS before FROM r),
k AS (SELECT *, split_part({_UNIT_SQL}, ':', 1) AS own, trim(printf('%.6f', CAST(v AS DOUBLE) * CAST(split_part({_UNIT_SQL}, ':', 2) AS DOUBLE)), '0') AS n FROM u),
z AS (SELECT *, rtrim(CASE WHEN n LIKE '.%' THEN '0' || n ELSE n END, '.') AS number, CASE WHEN own = 'CNY' AND (contains(before, '美元') OR before LIKE '%美') THEN 'USD' ELSE own END AS unit FROM k)
SELECT doc_id, raw, CAST(number AS DOUBLE) AS value, unit, unit || ':' || number AS key, CAST(pos AS INTEGER) AS "start" FROM z""")
def quantities(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with units and places, as keys of one form."""
    q = noted(spark, d).select("doc_id", F.explode(X.quantities(F.col("text"))).alias("q"))
    return q.select("doc_id", "q.raw", "q.value", "q.unit", "q.key", "q.start")


@query(f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all({_NOTE_SQL} || '。' || coalesce(text, ''), '(?i)([0-9][0-9,]*(?:\\.[0-9]+)?)\\s*({_UNITS_RE})')) AS raw FROM documents), x AS (SELECT doc_id, regexp_extract(raw, '(?i)({_UNITS_RE})$', 1) AS u, replace(regexp_extract(raw, '^[0-9,.]+'), ',', '') AS v FROM m)
SELECT split_part({_UNIT_SQL}, ':', 1) AS unit, count(*) AS n, count(DISTINCT doc_id) AS docs, CAST(round(sum(CAST(v AS DOUBLE) * CAST(split_part({_UNIT_SQL}, ':', 2) AS DOUBLE))) AS DOUBLE) AS total FROM x GROUP BY 1""".replace("\\\\", "\\"))
def quantity_totals(spark: SparkSession, d: str) -> DataFrame:
    """Quantities by the unit that they are counted in (money of any currency together)."""
    q = noted(spark, d).select("doc_id", F.explode(X.quantities(F.col("text"))).alias("q"))
    unit = F.when(F.col("q.unit") == "USD", "CNY").otherwise(F.col("q.unit")).alias("unit")
    return q.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"), F.round(F.sum("q.value")).alias("total"))


def fact_rows(spark: SparkSession, d: str, mentions: bool = True) -> DataFrame:
    return X.fact_rows(noted(spark, d).select("doc_id", "source", "text"), "text", mentions)


@query()
def events_extract(spark: SparkSession, d: str) -> DataFrame:
    """Facts of clauses: actions and what they weigh, numbers, period, and direction with denials within fourteen characters."""
    listed = [F.array_join(c, ",").alias(c) for c in ("actions", "numbers", "period", "negative_terms", "denied_terms")]
    return fact_rows(spark, d).select("doc_id", "place", *listed, "direction", "event_class", "importance", "skeleton")


@query()
def fact_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Facts of one class, source, actions, numbers, period and direction, clustered by likeness in document order."""
    f = fact_rows(spark, d, mentions=False)
    f = f.select("event_class", "source", *[F.array_join(F.array_sort(F.array_distinct(c)), ",").alias(c) for c in ("actions", "numbers", "period")], "direction", "doc_id", "place", "skeleton", (F.size("actions") > 0).alias("acts"), (F.col("doc_id") % 3).alias("day"))
    return X.clusters(f, ["event_class", "source", "actions", "numbers", "period", "direction"], ["doc_id", "place"], "skeleton", day="day", alike="acts")


@query()
def annotate(spark: SparkSession, d: str) -> DataFrame:
    """Topics, kind of content, exact cluster, direction, number of facts and whether a document needs review."""
    topics = term_match_join(spark, d).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("topic")), ",").alias("topics"))
    base = X.with_facts(noted(spark, d).select("doc_id", "text"), "text", "f").select("doc_id", T.exact_key(F.col("text")).alias("cluster"), "f", F.col("text").rlike(f"(?i){X.NOVELTY['rumor']}").alias("rumor"))
    bad, denied = F.exists("f", lambda x: x["direction"] == "negative"), F.exists("f", lambda x: F.size(x["denied_terms"]) > 0)
    base = base.select("doc_id", "cluster", F.size("f").alias("n_facts"), F.when(bad, "negative_candidate").when(denied, "denied").otherwise("unknown").alias("direction"), (bad | denied | F.col("rumor")).alias("needs_review"))
    return base.join(topics, "doc_id", "left").join(classify_cascade(spark, d).select("doc_id", "content_type", "novelty"), "doc_id")


@query()
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Text of pages long enough to be disclosures, scripts and styles cut out."""
    body = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    return table(spark, d, "pages").select("page_id", T.clean(body).alias("text")).where(F.length("text") >= 40)
