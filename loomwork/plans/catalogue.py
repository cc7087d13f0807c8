"""All queries of the library by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.functions.vocab import BASE, LEGACY, LOOPS
from loomwork.operators import corpus as C
from loomwork.operators import knn, names, rename, synth
from loomwork.sources.scan import log_grid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PATTERN = quoted(BASE.pattern)
TOK = f"regexp_extract_all(text, {PATTERN})"
IDS = "MAP {" + ", ".join(f"{quoted(k)}: {i}" for k, i in BASE.ids.items()) + "}"
KNOWN = "[" + ", ".join(map(quoted, BASE.keywords)) + "]"
DOCS = "(SELECT * FROM documents WHERE text IS NOT NULL)"
U01 = "(('0x' || substr(sha256({}), 1, 13))::BIGINT / 4503599627370496.0)"


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter("text IS NOT NULL")


# -- text ----------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len({TOK}) AS n_tok FROM {DOCS}")
def tokenize_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tok"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({TOK}) AS token FROM {DOCS}) GROUP BY token ORDER BY n DESC, token LIMIT 20")
def token_freq_topk(spark, sf_dir):
    return docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(20)


@query(f"SELECT doc_id, len(list_filter({TOK}, lambda t: NOT list_contains({KNOWN}, t))) AS n_unknown, CASE WHEN len(list_filter({TOK}, lambda t: NOT list_contains({KNOWN}, t))) > 0 THEN -1 ELSE 0 END AS status FROM {DOCS}")
def vocab_unknown(spark, sf_dir):
    tok = docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("tok"))
    return tok.select("doc_id", F.size(F.filter("tok", lambda t: ~t.isin(*BASE.keywords))).cast("long").alias("n_unknown"), T.is_covered(F.col("tok")).alias("status"))


@query(f"SELECT doc_id, list_transform({TOK}, lambda t: {IDS}[t]) AS ids FROM {DOCS}")
def encode_ids(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.token_ids(T.tokens(F.col("text"))).alias("ids"))


@query(f"SELECT doc_id, sha256(list_aggregate(list_filter({TOK}, lambda t: list_contains({KNOWN}, t)), 'string_agg', '')) AS joined_sha256 FROM {DOCS} WHERE len(list_filter({TOK}, lambda t: list_contains({KNOWN}, t))) > 0")
def decode_ids(spark, sf_dir):
    known = docs(spark, sf_dir).select("doc_id", F.filter(T.token_ids(T.tokens(F.col("text"))), lambda i: i.isNotNull()).alias("ids")).filter(F.size("ids") > 0)
    return known.select("doc_id", F.sha2(F.array_join(T.tokens_of(F.col("ids")), ""), 256).alias("joined_sha256"))


def _vocab_rows(spark, sf_dir):
    rows = [(name, i, k) for name, v in (("base", BASE), ("loops", LOOPS), ("legacy", LEGACY)) for i, k in enumerate(v.keywords)]
    return rows


@query("SELECT * FROM (VALUES " + ", ".join(f"({quoted(n)}, {i}, {quoted(k)})" for n, i, k in _vocab_rows(None, "")) + ") t(dialect, id, keyword)")
def vocab_tables(spark, sf_dir):
    """Keywords by length, longest first, then by their place: built by sorting, not by listing."""
    rows = [(name, p, k) for name, v in (("base", BASE), ("loops", LOOPS), ("legacy", LEGACY)) for p, k in enumerate(v.keywords)]
    df = spark.createDataFrame(rows, "dialect string, place int, keyword string")
    return df.select("dialect", (F.row_number().over(W.partitionBy("dialect").orderBy(F.desc(F.length("keyword")), "place")) - 1).alias("id"), "keyword")


@query("SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL")
def content_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("h"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents WHERE text IS NOT NULL")
def ws_normalise(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.squeeze(F.col("text")), 256).alias("h"))


@query(f"SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) AS n_filled, sha256(list_aggregate(list_transform(string_split(text, chr(10)), lambda l: chr(9) || l), 'string_agg', chr(10))) AS indented FROM {DOCS}")
def line_stats(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    return docs(spark, sf_dir).select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("n_filled"), F.sha2(T.indent(F.col("text")), 256).alias("indented"))


@query(f"SELECT doc_id, ([-1] || ids[1:30] || [-2]) || list_resize([]::INT[], 32 - 2 - least(len(ids), 30), -3) AS padded FROM (SELECT doc_id, list_transform({TOK}, lambda t: coalesce({IDS}[t], 99)) AS ids FROM {DOCS})")
def padded_ids(spark, sf_dir):
    """Start and end marks around at most 30 ids, padded to 32."""
    ids = docs(spark, sf_dir).select("doc_id", F.transform(T.token_ids(T.tokens(F.col("text"))), lambda i: F.coalesce(i, F.lit(99))).alias("ids"))
    body = F.slice("ids", 1, 30)
    return ids.select("doc_id", F.concat(F.array(F.lit(-1)), body, F.array(F.lit(-2)), F.array_repeat(F.lit(-3), F.lit(30) - F.size(body))).alias("padded"))


@query(f"SELECT doc_id, ([-1] || ids[1:398] || [-2]) || list_resize([]::INT[], 400 - 2 - least(len(ids), 398), -3) AS padded FROM (SELECT doc_id, list_transform({TOK}, lambda t: coalesce({IDS}[t], 99)) AS ids FROM {DOCS})")
def padded_blocks(spark, sf_dir):
    """padded_ids at the reference's block: marks around at most 398 ids, padded to 400."""
    ids = docs(spark, sf_dir).select("doc_id", F.transform(T.token_ids(T.tokens(F.col("text"))), lambda i: F.coalesce(i, F.lit(99))).alias("ids"))
    body = F.slice("ids", 1, 398)
    return ids.select("doc_id", F.concat(F.array(F.lit(-1)), body, F.array(F.lit(-2)), F.array_repeat(F.lit(-3), F.lit(398) - F.size(body))).alias("padded"))


@query("SELECT doc_id, n_records, n_kept FROM (SELECT doc_id, len(string_split(text, chr(10) || chr(10))) AS n_records, len(list_filter(string_split(text, chr(10) || chr(10)), lambda r: regexp_replace(r, '^\\s+|\\s+$', '', 'g') <> '')) AS n_kept FROM documents WHERE text IS NOT NULL)")
def record_scan(spark, sf_dir):
    """Blank-line records of each text: all, and those that are not empty when stripped."""
    rec = F.split("text", "\n\n", -1)
    return docs(spark, sf_dir).select("doc_id", F.size(rec).cast("long").alias("n_records"), F.size(F.filter(rec, lambda r: F.regexp_replace(r, r"^\s+|\s+$", "") != "")).cast("long").alias("n_kept"))


# -- corpus --------------------------------------------------------------------------------------

STEPS = "replace(text, '. ', chr(10) || '#STEP' || chr(10))"
FIRST = f"(SELECT doc_id, text FROM {DOCS} QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1)"


def as_steps():
    return F.replace("text", F.lit(". "), F.lit("\n#STEP\n"))


def stepped(spark, sf_dir):
    """Documents with sentence ends as step marks, standing in for traces."""
    return docs(spark, sf_dir).select("doc_id", as_steps().alias("text"))


@query(f"""WITH t AS (SELECT doc_id, {TOK} AS tok FROM (SELECT doc_id, {STEPS} AS text FROM {FIRST})),
b AS (SELECT doc_id, len(tok) AS n, list_filter(range(0, len(tok)), lambda i: tok[i + 1] = chr(10) || '#STEP' || chr(10)) || [len(tok)] AS b FROM t),
d AS (SELECT doc_id, n, row_number() OVER (ORDER BY doc_id) AS rn FROM b WHERE len(list_filter(range(2, len(b)), lambda i: b[i + 1] - b[i - 1] > 512)) = 0)
SELECT CASE WHEN rn <= 100 THEN 'test' WHEN rn <= 200 THEN 'val' ELSE 'train' END AS split, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, max(n) AS max_tokens FROM d GROUP BY 1""")
def corpus_slice(spark, sf_dir):
    """The flagship: dedup, tokenise, determinism filter, ordinal split, statistics."""
    first = C.dedup_keep_first(docs(spark, sf_dir).select("doc_id", "text"))
    # the last boundary is the number of tokens
    seen = lambda b: F.struct(F.element_at(b, -1).cast("long").alias("n"), F.exists(T.two_back_spans(b), lambda x: x > 512).alias("over"))
    cut = first.select("doc_id", T.once(T.boundaries_of(as_steps()), seen).alias("s"))
    ranked, _ = C.with_ordinal(C.settled(cut.filter("not s.over").select("doc_id", F.col("s.n").alias("n"))), "doc_id")
    split = F.when(F.col("rn") <= 100, "test").when(F.col("rn") <= 200, "val").otherwise("train")
    return ranked.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").alias("max_tokens"))


@query(f"SELECT doc_id, sha256(text) AS h FROM {FIRST}")
def dedup_keep_first(spark, sf_dir):
    return C.dedup_keep_first(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.sha2("text", 256).alias("h"))


def _ranked(spark, sf_dir):
    return C.with_ordinal(read(spark, sf_dir, "documents").select("doc_id"), "doc_id")


RANKED = "(SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents)"


@query(f"SELECT doc_id, CASE WHEN rn <= 50 THEN 'test' WHEN rn <= 150 THEN 'val' WHEN rn <= 850 THEN 'train' END AS split FROM {RANKED}")
def split_test_first(spark, sf_dir):
    df, _ = _ranked(spark, sf_dir)
    return df.select("doc_id", C.split_test_first(F.col("rn"), 50, 100, 700).alias("split"))


@query(f"SELECT doc_id, CASE WHEN rn > n - 60 THEN 'test' WHEN rn > n - 100 THEN 'val' ELSE 'train' END AS split FROM {RANKED}")
def split_train_first(spark, sf_dir):
    df, n = _ranked(spark, sf_dir)
    return df.select("doc_id", C.split_train_first(F.col("rn"), n, 40, 60).alias("split"))


@query(f"SELECT doc_id, CASE WHEN rn <= CAST(floor(0.8 * n) AS BIGINT) THEN 'train' WHEN rn <= CAST(floor(0.8 * n) AS BIGINT) + CAST(floor(0.1 * n) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM {RANKED}")
def split_fraction(spark, sf_dir):
    df, n = _ranked(spark, sf_dir)
    return df.select("doc_id", C.split_fraction(F.col("rn"), n).alias("split"))


@query(f"SELECT doc_id, rn FROM {RANKED} WHERE rn > n - 25")
def tail_limit(spark, sf_dir):
    df, n = _ranked(spark, sf_dir)
    return df.filter(F.col("rn") > n - 25).select("doc_id", F.col("rn").cast("long").alias("rn"))


@query(f"SELECT doc_id, rn FROM {RANKED} WHERE rn <= CAST(floor(n * 0.0515) AS BIGINT)")
def head_limit(spark, sf_dir):
    df, n = _ranked(spark, sf_dir)
    return df.filter(F.col("rn") <= int(n * 0.0515)).select("doc_id", F.col("rn").cast("long").alias("rn"))


@query(f"SELECT doc_id, CAST(floor((rn - 1) / 64) AS BIGINT) AS shard FROM {RANKED}")
def shard_assign(spark, sf_dir):
    df, _ = _ranked(spark, sf_dir)
    return df.select("doc_id", F.floor((F.col("rn") - 1) / 64).cast("long").alias("shard"))


BOUNDS = f"(SELECT doc_id, len(tok) AS n, list_filter(range(0, len(tok)), lambda i: tok[i + 1] = chr(10) || '#STEP' || chr(10)) || [len(tok)] AS b FROM (SELECT doc_id, {TOK} AS tok FROM (SELECT doc_id, {STEPS} AS text FROM {DOCS})))"
SPANS = f"(SELECT doc_id, b, CASE WHEN len(b) >= 3 THEN list_transform(range(2, len(b)), lambda i: b[i + 1] - b[i - 1]) ELSE [] END AS spans FROM {BOUNDS})"


@query(f"SELECT doc_id, len(b) AS n_bounds, coalesce(list_max(spans), 0) AS max_span FROM {SPANS}")
def boundary_spans(spark, sf_dir):
    b = stepped(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("tok")).select("doc_id", T.boundaries(F.col("tok")).alias("b"))
    return b.select("doc_id", F.size("b").cast("long").alias("n_bounds"), F.coalesce(F.array_max(T.two_back_spans(F.col("b"))), F.lit(0)).cast("long").alias("max_span"))


@query(f"SELECT doc_id, CASE WHEN len(o) = 0 THEN 'valid' ELSE 'rejected' END AS status, CASE WHEN len(o) > 0 THEN 'Pair length too long: ' || o[1] END AS reason FROM (SELECT doc_id, list_filter(spans, lambda x: x > 512) AS o FROM {SPANS})")
def determinism_filter(spark, sf_dir):
    return C.route_by_span(stepped(spark, sf_dir)).select("doc_id", "status", "reason")


@query(f"WITH c AS (SELECT least(CAST(floor(length(text) / 500) AS INT), 21) AS bucket, count(*) AS n FROM {DOCS} GROUP BY 1) SELECT CAST(r.i AS INT) AS bucket, coalesce(n, 0) AS n FROM range(0, 22) r(i) LEFT JOIN c ON c.bucket = r.i")
def length_histogram(spark, sf_dir):
    return C.histogram(docs(spark, sf_dir), F.floor(F.length("text") / 500).cast("int"), 22)


@query(f"SELECT lang, list_transform(range(0, 3), lambda i: CASE i WHEN 0 THEN a WHEN 1 THEN b ELSE c END) AS dist FROM (SELECT lang, CAST(sum(length(text)) AS BIGINT) AS a, count(*) AS b, CAST(sum(length(text) % 7) AS BIGINT) AS c FROM {DOCS} GROUP BY lang)")
def histogram_merge(spark, sf_dir):
    arrays = docs(spark, sf_dir).select("lang", F.array(F.length("text").cast("long"), F.lit(1).cast("long"), (F.length("text") % 7).cast("long")).alias("dist"))
    return C.merge_histograms(arrays, "dist", "lang")


@query(f"""SELECT '{{"generated":' || g || ',"global_duplicates":' || (g - u) || '}}' AS stats FROM (SELECT count(*) AS g, count(DISTINCT sha256(text)) AS u FROM {DOCS})""")
def stats_json(spark, sf_dir):
    agg = docs(spark, sf_dir).agg(F.count(F.lit(1)).alias("generated"), F.countDistinct(F.sha2("text", 256)).alias("u"))
    return agg.select(F.to_json(F.struct("generated", (F.col("generated") - F.col("u")).alias("global_duplicates"))).alias("stats"))


@query("""WITH e AS (SELECT user_id, event_id, event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS dup FROM events),
g AS (SELECT *, sum(CASE WHEN coalesce(dup, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM e)
SELECT user_id, max(run) AS longest FROM (SELECT user_id, island, count(*) FILTER (coalesce(dup, FALSE)) AS run FROM g GROUP BY ALL) GROUP BY user_id""")
def dup_islands(spark, sf_dir):
    """The longest run of consecutive repeats."""
    w = W.partitionBy("user_id").orderBy("event_id")
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce(F.col("event_type") == F.lag("event_type").over(w), F.lit(False)).alias("dup"))
    g = e.withColumn("island", F.sum((~F.col("dup")).cast("int")).over(w)).groupBy("user_id", "island").agg(F.count_if("dup").alias("run"))
    return g.groupBy("user_id").agg(F.max("run").alias("longest"))


# -- names ---------------------------------------------------------------------------------------

NAMES = f"(SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: regexp_matches(w, '^[a-z]{{1,4}}$')))) AS name FROM {DOCS})"


def _names(spark, sf_dir):
    runs = F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))
    return docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.filter(runs, lambda w: w.rlike("^[a-z]{1,4}$")))).alias("name"))


@query(f"SELECT length(name) AS len, count(DISTINCT name) AS n_names, round(100.0 * count(DISTINCT name) / pow(26, length(name)), 8) AS coverage FROM {NAMES} GROUP BY 1")
def name_coverage(spark, sf_dir):
    n = F.countDistinct("name")
    return _names(spark, sf_dir).groupBy(F.length("name").cast("long").alias("len")).agg(n.alias("n_names")).withColumn("coverage", F.round(100.0 * F.col("n_names") / F.pow(F.lit(26.0), F.col("len")), 8))


@query(f"SELECT name, count(*) AS n_docs FROM {NAMES} GROUP BY name")
def name_docfreq(spark, sf_dir):
    return _names(spark, sf_dir).groupBy("name").agg(F.count(F.lit(1)).alias("n_docs"))


LCG = "(WITH RECURSIVE s(ordinal, state) AS (SELECT 0::BIGINT, (123456789 % 676)::BIGINT UNION ALL SELECT ordinal + 1, (53 * state + 1) % 676 FROM s WHERE ordinal < 675) SELECT ordinal, state, chr(CAST(97 + state // 26 AS INT)) || chr(CAST(97 + state % 26 AS INT)) AS name FROM s)"


@query(f"SELECT * FROM {LCG}")
def lcg_names(spark, sf_dir):
    return names.sequence(spark, 2)


@query(f"SELECT CASE WHEN ordinal < CAST(floor(676 * 0.85) AS BIGINT) THEN 'seen' ELSE 'hidden' END AS part, count(*) AS n, min(name) AS least, max(name) AS most FROM {LCG} GROUP BY 1")
def seen_hidden(spark, sf_dir):
    part = F.when(names.seen(F.col("ordinal"), 2, 0.85), "seen").otherwise("hidden")
    return names.sequence(spark, 2).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("least"), F.max("name").alias("most"))


@query(f"SELECT round(count(DISTINCT name) * 1.0 / count(*), 8) AS fresh_share, CAST(floor(26 * 26 * 26 * count(*) / count(DISTINCT name)) AS BIGINT) AS rows_to_saturate FROM {NAMES} WHERE length(name) = 3")
def saturation(spark, sf_dir):
    agg = _names(spark, sf_dir).filter("length(name) = 3").agg(F.countDistinct("name").alias("u"), F.count(F.lit(1)).alias("n"))
    return agg.select(F.round(F.col("u") / F.col("n"), 8).alias("fresh_share"), F.floor(F.lit(26**3) * F.col("n") / F.col("u")).alias("rows_to_saturate"))


# -- sampling and mixing -------------------------------------------------------------------------


@query("SELECT doc_id FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 50")
def hash_sample_k(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").orderBy(F.sha2(F.concat_ws(":", F.lit("7"), F.col("doc_id").cast("string")), 256), "doc_id").limit(50)


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('8:' || doc_id), doc_id) AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id, pos FROM r WHERE pos <= greatest(1, CAST(floor(n * 0.1) AS BIGINT))")
def fraction_sample(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("doc_id")
    k = max(1, int(df.count() * 0.1))
    ranked, _ = C.with_ordinal(df.select("doc_id", T.hashed(8, F.col("doc_id")).alias("h")), "h", "pos", ("doc_id",))
    return ranked.filter(F.col("pos") <= k).select("doc_id", F.col("pos").cast("long").alias("pos"))


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('9:' || doc_id)) AS pos FROM documents")
def shuffle_order(spark, sf_dir):
    ranked, _ = C.with_ordinal(read(spark, sf_dir, "documents").select("doc_id", T.hashed(9, F.col("doc_id")).alias("h")), "h", "pos", ("doc_id",))
    return ranked.select("doc_id", F.col("pos").cast("long").alias("pos"))


def _sample(df, seed, k):
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("from_stage").cast("string"), F.col("draw").cast("string"), F.col("doc_id").cast("string")), 256)
    return df.orderBy(key).limit(k).withColumn("draw", F.col("draw") * 10 + seed)


@query("""WITH base AS (SELECT doc_id, CAST(doc_id % 4 + 1 AS INT) AS from_stage, 0::BIGINT AS draw FROM documents),
s1 AS (SELECT * FROM base WHERE from_stage = 1),
a1 AS (SELECT doc_id, from_stage, draw * 10 + 1 AS draw FROM (SELECT * FROM s1 ORDER BY sha256('1:' || from_stage || ':' || draw || ':' || doc_id) LIMIT 20)),
s2 AS (SELECT * FROM base WHERE from_stage = 2 UNION ALL SELECT * FROM a1),
a2 AS (SELECT doc_id, from_stage, draw * 10 + 2 AS draw FROM (SELECT * FROM s2 ORDER BY sha256('2:' || from_stage || ':' || draw || ':' || doc_id) LIMIT 20)),
a3 AS (SELECT doc_id, from_stage, draw * 10 + 3 AS draw FROM (SELECT * FROM s1 ORDER BY sha256('3:' || from_stage || ':' || draw || ':' || doc_id) LIMIT 10)),
s3 AS (SELECT * FROM base WHERE from_stage = 3 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3),
a4 AS (SELECT doc_id, from_stage, draw * 10 + 4 AS draw FROM (SELECT * FROM s3 ORDER BY sha256('4:' || from_stage || ':' || draw || ':' || doc_id) LIMIT 40)),
a5 AS (SELECT doc_id, from_stage, draw * 10 + 5 AS draw FROM (SELECT * FROM s2 ORDER BY sha256('5:' || from_stage || ':' || draw || ':' || doc_id) LIMIT 35)),
a6 AS (SELECT doc_id, from_stage, draw * 10 + 6 AS draw FROM (SELECT * FROM s1 ORDER BY sha256('6:' || from_stage || ':' || draw || ':' || doc_id) LIMIT 15)),
s4 AS (SELECT * FROM base WHERE from_stage = 4 UNION ALL SELECT * FROM a4 UNION ALL SELECT * FROM a5 UNION ALL SELECT * FROM a6)
SELECT 1 AS stage, * FROM s1 UNION ALL SELECT 2, * FROM s2 UNION ALL SELECT 3, * FROM s3 UNION ALL SELECT 4, * FROM s4""")
def curriculum_mix(spark, sf_dir):
    """Each stage: what is new and samples of the stages before it (which hold samples themselves), as a bag."""
    base = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4 + 1).cast("int").alias("from_stage"), F.lit(0).cast("long").alias("draw"))
    s1 = base.filter("from_stage = 1")
    s2 = base.filter("from_stage = 2").union(_sample(s1, 1, 20))
    s3 = base.filter("from_stage = 3").union(_sample(s2, 2, 20)).union(_sample(s1, 3, 10))
    s4 = base.filter("from_stage = 4").union(_sample(s3, 4, 40)).union(_sample(s2, 5, 35)).union(_sample(s1, 6, 15))
    out = None
    for k, s in enumerate((s1, s2, s3, s4), 1):
        s = s.select(F.lit(k).alias("stage"), "*")
        out = s if out is None else out.union(s)
    return out


@query(f"SELECT doc_id, CASE WHEN u < 0.5 THEN 'assign' WHEN u < 0.8 THEN 'if' ELSE 'for' END AS kind FROM (SELECT doc_id, {U01.format(quoted('11:') + ' || doc_id')} AS u FROM documents)")
def weighted_choice(spark, sf_dir):
    u = T.u01(11, F.col("doc_id"))
    return read(spark, sf_dir, "documents").select("doc_id", F.when(u < 0.5, "assign").when(u < 0.8, "if").otherwise("for").alias("kind"))


@query(f"SELECT d.doc_id, k.i AS draw, CAST(floor({U01.format(quoted('12:') + ' || d.doc_id || ' + quoted(':') + ' || k.i')} * greatest(1, length(text) - 32)) AS BIGINT) AS start FROM {DOCS} d, range(0, 3) k(i)")
def windows_with_replacement(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("draw"))
    return d.select("doc_id", "draw", F.floor(T.u01(12, F.col("doc_id"), F.col("draw")) * F.greatest(F.lit(1), F.col("n") - 32)).alias("start"))


@query(f"SELECT doc_id, x, y, mask_from FROM (SELECT doc_id, tok[1:24] || list_resize([]::VARCHAR[], 24 - least(len(tok), 24), 'PAD') AS x, tok[2:25] || list_resize([]::VARCHAR[], 24 - least(greatest(len(tok) - 1, 0), 24), 'PAD') AS y, CAST(coalesce(list_position(tok[1:24], chr(10) || '#STEP' || chr(10)), 0) - 1 AS INT) AS mask_from FROM (SELECT doc_id, {TOK} AS tok FROM (SELECT doc_id, {STEPS} AS text FROM {DOCS})))")
def window_pairs(spark, sf_dir):
    """The first window of 24 tokens, the same moved on by one, and where the mask begins."""
    tok = stepped(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("tok"))
    pad = lambda c: F.concat(c, F.array_repeat(F.lit("PAD"), F.lit(24) - F.size(c)))
    x, y = F.slice("tok", 1, 24), F.slice("tok", 2, 24)
    return tok.select("doc_id", pad(x).alias("x"), pad(y).alias("y"), (F.array_position(x, BASE.boundary) - 1).cast("int").alias("mask_from"))


@query(f"SELECT doc_id, start, tok[start + 1:start + 512] || list_resize([]::VARCHAR[], 512 - len(tok[start + 1:start + 512]), 'PAD') AS x, tok[start + 2:start + 513] || list_resize([]::VARCHAR[], 512 - len(tok[start + 2:start + 513]), 'PAD') AS y, CAST(coalesce(list_position(tok[start + 1:start + 512], chr(10) || '#STEP' || chr(10)), 0) - 1 AS INT) AS mask_from FROM (SELECT doc_id, tok, unnest(range(0, greatest(len(tok), 1), 512)) AS start FROM (SELECT doc_id, {TOK} AS tok FROM (SELECT doc_id, {STEPS} AS text FROM {DOCS})))")
def text_windows(spark, sf_dir):
    """Windows of 512 tokens, the reference's block, one after the other over the whole text: where each starts, the same
    moved on by one, and where the mask begins (-1: no step mark in the window). A text without tokens gives one of pads."""
    tok = stepped(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("tok"))
    cut = tok.select("doc_id", "tok", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.size("tok") - 1, F.lit(0)).cast("long"), F.lit(512).cast("long"))).alias("start"))
    pairs = cut.select("doc_id", "start", *(F.slice("tok", (F.col("start") + k).cast("int"), F.lit(512)).alias(n) for k, n in ((1, "x"), (2, "y"))))
    pad = lambda c: F.concat(c, F.array_repeat(F.lit("PAD"), F.lit(512) - F.size(c)))
    return pairs.select("doc_id", "start", pad("x").alias("x"), pad("y").alias("y"), (F.array_position("x", BASE.boundary) - 1).cast("int").alias("mask_from"))


@query("SELECT conv_id, turn, r.i AS copy FROM conversations, range(0, 128) r(i)")
def replicate(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(127).cast("long"))).alias("copy"))


# -- evaluation ----------------------------------------------------------------------------------


@query(f"SELECT doc_id, sha256(regexp_extract(text, '(?s)^(.*?\n#STEP\n)(.*)$', 1)) AS prompt, sha256(regexp_extract(text, '(?s)^(.*?\n#STEP\n)(.*)$', 2)) AS target, sha256(string_split(text, '#STEP')[1]) AS prompt_only FROM (SELECT doc_id, {STEPS} AS text FROM {DOCS})")
def prompt_split(spark, sf_dir):
    p = r"(?s)^(.*?\n#STEP\n)(.*)$"
    return stepped(spark, sf_dir).select("doc_id", *(F.sha2(F.regexp_extract("text", p, k), 256).alias(n) for k, n in ((1, "prompt"), (2, "target"))), F.sha2(F.substring_index("text", "#STEP", 1), 256).alias("prompt_only"))


EVAL = """(SELECT conv_id, turn, text AS reference, CASE WHEN (conv_id + turn) % 3 = 0 THEN text || ' ' || chr(10) || chr(10) || 'x' WHEN (conv_id + turn) % 3 = 1 THEN 'other' || chr(10) || string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))[-1] ELSE 'wrong' || text END AS generated FROM conversations WHERE text IS NOT NULL AND role = 'assistant')"""
LAST = r"string_split(regexp_replace({}, '^\s+|\s+$', '', 'g'), chr(10))[-1]"
OUTCOME = f"(SELECT *, CASE WHEN clean = reference THEN 'hard' WHEN {LAST.format('clean')} = {LAST.format('reference')} THEN 'soft' ELSE 'fail' END AS outcome FROM (SELECT *, string_split(generated, ' ' || chr(10) || chr(10))[1] AS clean FROM {EVAL}))"


def _outcomes(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").filter("text IS NOT NULL AND role = 'assistant'").withColumnRenamed("text", "reference")
    k = (F.col("conv_id") + F.col("turn")) % 3
    made = F.when(k == 0, F.concat("reference", F.lit(" \n\nx"))).when(k == 1, F.concat(F.lit("other\n"), T.last_line(F.col("reference")))).otherwise(F.concat(F.lit("wrong"), F.col("reference")))
    return c.withColumn("outcome", T.outcome(made, F.col("reference")))


@query(f"SELECT conv_id, turn, outcome FROM {OUTCOME}")
def outcome_classify(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("conv_id", "turn", "outcome")


@query(f"SELECT turn, count(*) AS n, count(*) FILTER (outcome = 'hard') AS hard, count(*) FILTER (outcome = 'soft') AS soft, round(100.0 * count(*) FILTER (outcome = 'hard') / count(*), 6) AS hard_accuracy FROM {OUTCOME} GROUP BY turn")
def accuracy_by_group(spark, sf_dir):
    o = _outcomes(spark, sf_dir).groupBy("turn").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "hard").alias("hard"), F.count_if(F.col("outcome") == "soft").alias("soft"))
    return o.withColumn("hard_accuracy", F.round(100.0 * F.col("hard") / F.col("n"), 6))


@query(f"SELECT conv_id, turn, outcome, row_number() OVER (PARTITION BY turn, outcome ORDER BY conv_id) - 1 AS idx FROM {OUTCOME}")
def running_index(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("conv_id", "turn", "outcome", (F.row_number().over(W.partitionBy("turn", "outcome").orderBy("conv_id")) - 1).cast("long").alias("idx"))


@query(r"SELECT event_id, CAST(regexp_extract(line, 'hard-accuracy:\s*\d+\s*=\s*([\d.]+)%', 1) AS DOUBLE) AS acc, regexp_extract(path, '([^/]+)/infers/', 1) AS folder, CAST(regexp_extract(path, 'ckpt_(\d+)', 1) AS INT) AS ckpt FROM (SELECT event_id, '|hard-accuracy: ' || event_id || ' = ' || (event_id % 100) || '.25% | soft-accuracy: 1' AS line, 'runs/job' || (event_id % 7) || '/infers/ckpt_' || (event_id % 50) || '.pt' AS path FROM events)")
def log_parse(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.format_string("|hard-accuracy: %d = %d.25%% | soft-accuracy: 1", "event_id", F.col("event_id") % 100).alias("line"), F.format_string("runs/job%d/infers/ckpt_%d.pt", F.col("event_id") % 7, F.col("event_id") % 50).alias("path"))
    return e.select("event_id", F.regexp_extract("line", r"hard-accuracy:\s*\d+\s*=\s*([\d.]+)%", 1).cast("double").alias("acc"), F.regexp_extract("path", "([^/]+)/infers/", 1).alias("folder"), F.regexp_extract("path", r"ckpt_(\d+)", 1).cast("int").alias("ckpt"))


GRID = "(SELECT v.x AS variant, 'j' || j.i AS job, s.i AS step, t.x AS task FROM (VALUES ('a'), ('b')) v(x), range(0, 3) j(i), range(0, 5) s(i), (VALUES ('ID'), ('sp')) t(x))"


@query(f"WITH g AS (SELECT *, CASE WHEN (step + length(job) + ascii(variant)) % 4 = 0 THEN 0.0 ELSE 10.0 * step + ascii(task) / 10.0 END AS accuracy FROM {GRID}), p AS (SELECT variant, job, step, max(accuracy) FILTER (task = 'ID') AS id_acc, max(accuracy) FILTER (task = 'sp') AS sp_acc FROM g GROUP BY ALL) SELECT *, round(sp_acc * id_acc / 100, 8) AS derived FROM p WHERE variant = 'a'")
def result_grid(spark, sf_dir):
    """Logs over a grid of variants, jobs, steps and tasks; missing ones count 0; tasks side by side; one variant."""
    one = lambda values, name: spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))
    grid = one("ab", "variant").crossJoin(one(["j0", "j1", "j2"], "job")).crossJoin(spark.range(5).select(F.col("id").alias("step"))).crossJoin(one(["ID", "sp"], "task"))
    logs = grid.filter((F.col("step") + F.length("job") + F.ascii("variant")) % 4 != 0).withColumn("line", F.concat(F.lit("|hard-accuracy: 1 = "), (10.0 * F.col("step") + F.ascii("task") / 10.0).cast("string"), F.lit("%")))
    wide = log_grid(grid, logs).filter("variant = 'a'").groupBy("variant", "job", "step").pivot("task", ["ID", "sp"]).agg(F.max("accuracy"))
    return wide.withColumnsRenamed({"ID": "id_acc", "sp": "sp_acc"}).withColumn("derived", F.round(F.col("sp_acc") * F.col("id_acc") / 100, 8))


@query(f"SELECT CAST(floor((rn - 1) / 64) AS BIGINT) AS batch, count(*) AS n, max(n_tok) AS longest FROM (SELECT n_tok, row_number() OVER (ORDER BY doc_id) AS rn FROM (SELECT doc_id, len({TOK}) AS n_tok FROM {DOCS})) GROUP BY 1")
def batch_chunks(spark, sf_dir):
    df, _ = C.with_ordinal(C.settled(docs(spark, sf_dir).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tok"))), "doc_id")
    return df.select(F.floor((F.col("rn") - 1) / 64).cast("long").alias("batch"), "n_tok").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.max("n_tok").alias("longest"))


@query("SELECT i AS it, round(CASE WHEN i < 100 THEN 0.001 * i / 100 WHEN i > 900 THEN 0.0001 ELSE 0.0001 + 0.5 * (1.0 + cos(pi() * (i - 100) / 800.0)) * (0.001 - 0.0001) END, 10) AS lr FROM range(0, 1000) r(i)")
def lr_schedule(spark, sf_dir):
    i = F.col("it")
    lr = F.when(i < 100, 0.001 * i / 100).when(i > 900, 0.0001).otherwise(0.0001 + 0.5 * (1.0 + F.cos(F.pi() * (i - 100) / 800.0)) * (0.001 - 0.0001))
    return spark.range(1000).select(F.col("id").alias("it")).select("it", F.round(lr, 10).alias("lr"))


@query("SELECT i AS head, round(1.0 / pow(pow(256.0, 1.0 / 16), i + 1), 10) AS slope FROM range(0, 16) r(i)")
def bias_slopes(spark, sf_dir):
    return spark.range(16).select(F.col("id").alias("head"), F.round(1.0 / F.pow(F.lit(256.0 ** (1 / 16)), F.col("id") + 1), 10).alias("slope"))


@query("SELECT event_id, s // 86400 AS d, (s // 3600) % 24 AS h, (s // 60) % 60 AS m, s % 60 AS s, CASE WHEN s >= 1000000 THEN (s // 1000000) || 'M' WHEN s >= 1000 THEN (s // 1000) || 'K' ELSE s || '' END AS human FROM (SELECT event_id, event_id * 37 AS s FROM events)")
def duration_parts(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 37).alias("s"))
    return e.selectExpr("event_id", "s div 86400 AS d", "(s div 3600) % 24 AS h", "(s div 60) % 60 AS m", "s % 60 AS s", "CASE WHEN s >= 1000000 THEN concat(s div 1000000, 'M') WHEN s >= 1000 THEN concat(s div 1000, 'K') ELSE cast(s AS string) END AS human")


# -- neighbours ----------------------------------------------------------------------------------

VEC = "(SELECT vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-10)) AS v FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))"
#: As if a renamed program had been embedded anew: every third place changes sign for ids not divisible by 4.
PERT = f"(SELECT vec_id, label, list_transform(range(0, len(v)), lambda i: CASE WHEN vec_id % 4 <> 0 AND i % 3 = 0 THEN -v[i + 1] ELSE v[i + 1] END) AS v FROM {VEC})"


def _vectors(spark, sf_dir):
    return knn.normalised(read(spark, sf_dir, "embeddings"))


@query("SELECT label, count(*) AS n, count(*) - 1 AS r, list(vec_id ORDER BY vec_id) AS members FROM embeddings GROUP BY label")
def class_sizes(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - 1).alias("r"), F.array_sort(F.collect_list("vec_id")).alias("members"))


@query(f"SELECT vec_id, list_transform(v[1:4], lambda x: round(x, 8)) AS head, round(list_sum(list_transform(v, lambda x: x * x)), 8) AS norm FROM {VEC}")
def l2_normalise(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.select("vec_id", F.transform(F.slice("v", 1, 4), lambda x: F.round(x, 8)).alias("head"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 8).alias("norm"))


TOP1 = "(SELECT q_id, q_label, c_label, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, c_id) AS rank FROM (SELECT q.vec_id AS q_id, q.label AS q_label, c.vec_id AS c_id, c.label AS c_label, list_dot_product(q.v, c.v) AS s FROM {q} q, {c} c WHERE q.vec_id <> c.vec_id))"


@query(f"SELECT count(*) AS n, count(*) FILTER (q_label = c_label) AS correct, round(count(*) FILTER (q_label = c_label) * 1.0 / count(*), 8) AS accuracy FROM {TOP1.format(q=VEC, c=VEC)} WHERE rank = 1")
def top1_accuracy(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    n = knn.neighbours(v, v, 1).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("q_label") == F.col("c_label")).alias("correct"))
    return n.withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 8))


@query(f"""WITH r AS (SELECT label, count(*) - 1 AS r FROM embeddings GROUP BY label HAVING count(*) > 1), h AS (SELECT q_id, t.rank, r.r, q_label = c_label AS hit, sum(CASE WHEN q_label = c_label THEN 1 ELSE 0 END) OVER (PARTITION BY q_id ORDER BY t.rank) AS hits FROM {TOP1.format(q=VEC, c=VEC)} t JOIN r ON r.label = q_label WHERE t.rank <= r.r)
SELECT count(*) AS n_queries, round(avg(s), 8) AS map_at_r FROM (SELECT q_id, sum(CASE WHEN hit THEN hits * 1.0 / rank ELSE 0 END) / max(r) AS s FROM h GROUP BY q_id)""")
def map_at_r(spark, sf_dir):
    return knn.map_at_r(_vectors(spark, sf_dir))


@query(f"WITH ok AS (SELECT q_id FROM {TOP1.format(q=VEC, c=VEC)} WHERE rank = 1 AND q_label = c_label), again AS (SELECT t.* FROM {TOP1.format(q=PERT, c=VEC)} t WHERE rank = 1 AND q_id IN (SELECT q_id FROM ok)) SELECT (SELECT count(*) FROM ok) AS correct_0, count(*) FILTER (q_label = c_label) AS correct_n, round(count(*) FILTER (q_label = c_label) * 1.0 / nullif((SELECT count(*) FROM ok), 0), 8) AS retention FROM again")
def retention(spark, sf_dir):
    """Only what was right before is asked again, against the gallery as it was."""
    v = _vectors(spark, sf_dir)
    right = C.settled(knn.neighbours(v, v, 1).filter("q_label = c_label").select(F.col("q_id").alias("vec_id")))
    moved = v.join(right, "vec_id", "left_semi").withColumn("v", F.transform("v", lambda x, i: F.when((F.col("vec_id") % 4 != 0) & (i % 3 == 0), -x).otherwise(x)))
    n0 = right.count()
    again = knn.neighbours(moved, v, 1).agg(F.lit(n0).cast("long").alias("correct_0"), F.count_if(F.col("q_label") == F.col("c_label")).alias("correct_n"))
    return again.withColumn("retention", F.round(F.try_divide("correct_n", "correct_0"), 8))


@query(r"""WITH e AS (SELECT vec_id, label, sha256('5:' || vec_id) AS h FROM embeddings), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS p, count(*) OVER (PARTITION BY label) AS n FROM e)
SELECT a.vec_id, b.vec_id AS positive FROM o a JOIN o b ON a.label = b.label AND b.p = a.p % a.n + 1""")
def positive_pairs(spark, sf_dir):
    """Each vector with the next of its class in hash order; alone in its class, with itself."""
    h = F.sha2(F.concat_ws(":", F.lit("5"), F.col("vec_id").cast("string")), 256)
    w = W.partitionBy("label").orderBy("h")
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", h.alias("h"))
    first = F.first("vec_id").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return e.select("vec_id", F.coalesce(F.lead("vec_id").over(w), first).alias("positive"))


# -- renaming ------------------------------------------------------------------------------------

STRIP = "code"
for _p, _to in T.COMMENTS:
    STRIP = f"regexp_replace({STRIP}, {quoted(_p)}, {quoted(_to)}, 'g')"
RES = "[" + ", ".join(map(quoted, T.RESERVED)) + "]"
IDENT = f"(SELECT page_id, code, list_sort(list_distinct(list_filter(regexp_extract_all({STRIP}, '[A-Za-z0-9_]+'), lambda w: regexp_matches(w, '^[A-Za-z_]') AND w[1:2] <> '__' AND NOT list_contains({RES}, w)))) AS vars FROM (SELECT page_id, html AS code FROM pages WHERE html IS NOT NULL))"
RALL = f"(SELECT page_id, code, vars, [x.v FOR x IN list_sort(list_transform(vars, lambda v: {{'h': sha256('3:' || page_id || ':' || v), 'v': v}}))] AS ordered, regexp_extract_all(code, '[A-Za-z0-9_]+') AS words FROM {IDENT})"
RMAP = f"(SELECT *, ordered[1:4] AS picked FROM {RALL})"


def renamed_sql(picked):
    """The code with the identifiers in picked renamed; new names as text.fresh_names makes them."""
    name = f"'var_' || (list_position({picked}, w) - 1) || '_' || page_id"
    longest = "coalesce(list_max(list_transform(list_filter(words, lambda x: starts_with(x, 'var_')), lambda x: length(x))), 0)"
    fresh = f"CASE WHEN list_contains(words, {name}) THEN rpad({name}, CAST({longest} + 1 AS INT), '_') ELSE {name} END"
    return f"sha256(coalesce(list_aggregate(list_transform(regexp_extract_all(code, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda w: CASE WHEN list_contains({picked}, w) THEN {fresh} ELSE w END), 'string_agg', ''), ''))"


def _code(spark, sf_dir):
    return read(spark, sf_dir, "pages").filter("html IS NOT NULL").select("page_id", F.col("html").alias("code"))


def _ordered(spark, sf_dir):
    """page_id, code, ordered: identifiers by a hash, each computed once."""
    order = lambda v: F.transform(F.array_sort(F.transform(v, lambda x: F.struct(F.sha2(F.concat_ws(":", F.lit("3"), F.col("page_id").cast("string"), x), 256).alias("h"), x.alias("v")))), lambda s: s["v"])
    return _code(spark, sf_dir).select("page_id", "code", T.once(T.identifiers(F.col("code")), order).alias("ordered"))


def _picked(spark, sf_dir, n=4):
    return _ordered(spark, sf_dir).select("page_id", "code", F.slice("ordered", 1, n).alias("picked"))


def _renamed(p):
    """page_id, num_renamed, renamed, other columns of p (page_id, code, picked): picked identifiers get new names wherever they stand."""
    others = [c for c in p.columns if c not in ("page_id", "code", "picked")]
    words = F.regexp_extract_all("code", F.lit("[A-Za-z0-9_]+"), F.lit(0))
    names = T.once(words, lambda w: F.map_from_arrays("picked", T.fresh_names(F.col("picked"), w, F.col("page_id"))))
    p = p.select("page_id", "code", *others, F.size("picked").cast("long").alias("num_renamed"), names.alias("names"))
    return p.select("page_id", *others, "num_renamed", F.sha2(T.rename(F.col("code"), F.col("names")), 256).alias("renamed"))


@query(f"SELECT page_id, len(vars) AS n, vars FROM {IDENT}")
def extract_identifiers(spark, sf_dir):
    return _code(spark, sf_dir).select("page_id", T.identifiers(F.col("code")).alias("vars")).select("page_id", F.size("vars").cast("long").alias("n"), "vars")


@query(f"SELECT page_id, len(picked) AS num_renamed, {renamed_sql('picked')} AS renamed FROM {RMAP}")
def rename_n(spark, sf_dir):
    """Four identifiers by hash order get new names, wherever they stand; no new name is one that the page has."""
    return _renamed(_picked(spark, sf_dir))


@query(f"SELECT n.i AS n, round(avg(least(len(vars), n.i)), 8) AS avg_renamed FROM {IDENT}, (VALUES (1), (4), (8)) n(i) GROUP BY 1")
def avg_renamed(spark, sf_dir):
    v = _code(spark, sf_dir).select(F.size(T.identifiers(F.col("code"))).alias("k"), F.explode(F.array(*map(F.lit, (1, 4, 8)))).alias("n"))
    return v.groupBy("n").agg(F.round(F.avg(F.least("k", "n")), 8).alias("avg_renamed"))


@query(f"SELECT page_id, len(list_filter(regexp_extract_all(code, '[A-Za-z0-9_]+|[^A-Za-z0-9_]'), lambda w: list_contains(picked, w))) AS n_masked, len(regexp_extract_all(code, '[A-Za-z0-9_]+|[^A-Za-z0-9_]')) AS n_tok FROM {RMAP}")
def identifier_mask(spark, sf_dir):
    """Tokens that overlap an identifier to be masked."""
    tok = F.regexp_extract_all("code", F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]"), F.lit(0))
    return _picked(spark, sf_dir).select("page_id", F.when(F.size("picked") > 0, F.size(F.filter(tok, lambda w: F.array_contains("picked", w)))).otherwise(0).cast("long").alias("n_masked"), F.size(tok).cast("long").alias("n_tok"))


MLM_TOK = f"(SELECT doc_id, list_transform({TOK}, lambda t: coalesce({IDS}[t], 99)) AS ids FROM {DOCS})"


def _drawn(spark, sf_dir, seed, make):
    """doc_id, and make(id, hash) for each id of whole texts. Numbers in [0, 1) are cut from a token's hash where they are asked for;
    one hash at a time is held."""
    ids = docs(spark, sf_dir).select("doc_id", F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"), F.lit(":")).alias("prefix"), F.transform(T.token_ids(T.tokens(F.col("text"))), lambda i: F.coalesce(i, F.lit(99))).alias("ids"))
    one = lambda x, i: F.get(F.transform(F.array(F.sha2(F.concat(F.col("prefix"), i.cast("string")), 256)), lambda h: make(x, h)), F.lit(0))
    return ids.select("doc_id", F.transform("ids", one).alias("p"))


def _drawn_sql(seed):
    return f"(SELECT doc_id, ids, list_transform(range(0, len(ids)), lambda i: sha256('{seed}:' || doc_id || ':' || i)) AS hs FROM {MLM_TOK})"


def _cut(k):
    """The k-th number of a hash in SQL."""
    return f"(('0x' || substr(hs[i + 1], {13 * k + 1}, 13))::BIGINT / 4503599627370496.0)"


@query(f"SELECT doc_id, list_transform(range(0, len(ids)), lambda i: CASE WHEN {_cut(0)} >= 0.15 THEN ids[i + 1] WHEN {_cut(1)} < 0.8 THEN 100 WHEN {_cut(1)} < 0.9 THEN CAST(floor({_cut(2)} * 52) AS INT) ELSE ids[i + 1] END) AS masked, list_transform(range(0, len(ids)), lambda i: CASE WHEN {_cut(0)} < 0.15 THEN ids[i + 1] ELSE -100 END) AS labels FROM {_drawn_sql(21)}")
def mlm_mask(spark, sf_dir):
    """15 % are to be told; of these 80 % are hidden, 10 % are another token, 10 % stay."""
    told = lambda x, h: F.when(T.below(h, 0.8, 1), F.lit(100)).when(T.below(h, 0.9, 1), F.floor(T.u01_of(h, 2) * 52).cast("int")).otherwise(x)
    pair = lambda x, h: F.when(T.below(h, 0.15), F.struct(told(x, h).alias("m"), x.alias("l"))).otherwise(F.struct(x.alias("m"), F.lit(-100).alias("l")))
    return _drawn(spark, sf_dir, 21, pair).select("doc_id", F.col("p.m").alias("masked"), F.col("p.l").alias("labels"))


@query(f"SELECT doc_id, list_transform(range(0, len(ids)), lambda i: CASE WHEN {_cut(0)} < 0.15 AND CAST(floor({_cut(1)} * 52) AS INT) <> ids[i + 1] THEN 1 ELSE 0 END) AS is_replaced FROM {_drawn_sql(24)}")
def replaced_tokens(spark, sf_dir):
    replaced = lambda x, h: F.when(T.below(h, 0.15), (F.floor(T.u01_of(h, 1) * 52).cast("int") != x).cast("int")).otherwise(0)
    return _drawn(spark, sf_dir, 24, replaced).select("doc_id", F.col("p").alias("is_replaced"))


# -- reports -------------------------------------------------------------------------------------

MODELS = "(SELECT 'model_' || k AS model, CASE WHEN k = 0 THEN 0 WHEN k % 2 = 0 THEN 1 ELSE 2 END AS grp, k AS epoch, 1000 AS n, 900 - 7 * k AS c0, 850 - 11 * k AS c1, 700 - 13 * k AS c8 FROM range(0, 12) r(k))"


def _models(spark):
    return spark.range(12).selectExpr("concat('model_', id) AS model", "CASE WHEN id = 0 THEN 0 WHEN id % 2 = 0 THEN 1 ELSE 2 END AS grp", "id AS epoch", "1000 AS n", "900 - 7 * id AS c0", "850 - 11 * id AS c1", "700 - 13 * id AS c8")


@query(f"SELECT row_number() OVER (ORDER BY grp, epoch) AS line, rpad(model, 12, ' ') || ' | ' || lpad(CAST(CAST(round(100.0 * c0 / n, 2) AS DECIMAL(6,2)) AS VARCHAR), 8, ' ') AS row_text, coalesce(grp <> lag(grp) OVER (ORDER BY grp, epoch), FALSE) AS rule_before FROM {MODELS}")
def robustness_table(spark, sf_dir):
    w = W.orderBy("grp", "epoch")  # a report of one row for each model
    acc = F.round(100.0 * F.col("c0") / F.col("n"), 2).cast("decimal(6,2)").cast("string")
    return _models(spark).select(F.row_number().over(w).cast("long").alias("line"), F.concat(F.rpad("model", 12, " "), F.lit(" | "), F.lpad(acc, 8, " ")).alias("row_text"), F.coalesce(F.col("grp") != F.lag("grp").over(w), F.lit(False)).alias("rule_before"))


@query(f"SELECT model, round(1.0 * c0 / n - 1.0 * c8 / n, 8) AS drop_8, round(1.0 - 1.0 * c8 / nullif(c0, 0), 8) AS lost_8, round(1.0 * c1 / nullif(c0, 0), 8) AS retention_1 FROM {MODELS}")
def drop_metrics(spark, sf_dir):
    return _models(spark).selectExpr("model", "round(cast(c0 AS double) / n - cast(c8 AS double) / n, 8) AS drop_8", "round(1.0D - cast(c8 AS double) / nullif(c0, 0), 8) AS lost_8", "round(cast(c1 AS double) / nullif(c0, 0), 8) AS retention_1")


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 8) AS pct FROM events GROUP BY event_type")
def error_rates(spark, sf_dir):
    per = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("event_type", "n", F.round(100.0 * F.col("n") / F.col("total"), 8).alias("pct"))


@query(f"SELECT coalesce(lang, 'all') AS lang, n, modified, round(100.0 * modified / n, 8) AS pct FROM (SELECT lang, count(*) AS n, count(*) FILTER (length(text) % 2 = 0) AS modified FROM {DOCS} WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT NULL, count(*), count(*) FILTER (length(text) % 2 = 0) FROM {DOCS} WHERE lang IS NOT NULL)")
def by_language(spark, sf_dir):
    r = docs(spark, sf_dir).filter("lang IS NOT NULL").rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") % 2 == 0).alias("modified"))
    return r.select(F.coalesce("lang", F.lit("all")).alias("lang"), "n", "modified", F.round(100.0 * F.col("modified") / F.col("n"), 8).alias("pct"))


@query("SELECT grp, max(c0) AS best, arg_max(model, c0) AS best_model, max(epoch) AS last_epoch FROM " + MODELS + " GROUP BY grp")
def best_checkpoint(spark, sf_dir):
    return _models(spark).groupBy("grp").agg(F.max("c0").alias("best"), F.max_by("model", "c0").alias("best_model"), F.max("epoch").alias("last_epoch"))


@query(f"SELECT model, epoch FROM {MODELS} WHERE epoch % 5 = 0 OR epoch = (SELECT max(k) FROM range(0, 12) r(k))")
def every_nth_and_last(spark, sf_dir):
    m = _models(spark)
    return m.crossJoin(F.broadcast(m.agg(F.max("epoch").alias("last")))).filter("epoch % 5 = 0 OR epoch = last").select("model", "epoch")


# -- program features (filters over columns) -----------------------------------------------------

FEAT = "(SELECT l_orderkey, count(*) AS line_count, [count(*) FILTER (l_linenumber % 3 = 0), count(*) FILTER (l_linenumber % 3 = 1), count(*) FILTER (l_linenumber % 3 = 2)] AS if_count, CAST(max(l_quantity) AS INT) % 5 AS max_depth, list_sort(list(DISTINCT CASE WHEN l_returnflag = 'A' THEN '+' ELSE '-' END)) AS ops FROM lineitem GROUP BY l_orderkey)"


@query(f"SELECT l_orderkey, line_count <= 5 AND len(list_filter(if_count, lambda x: x > 2)) = 0 AS structure_ok, max_depth >= 3 AS deeper, len(list_filter(if_count, lambda x: x > 2)) > 0 AS denser, line_count > 5 AS longer, list_contains(ops, '+') AND list_contains(ops, '-') AS mixed FROM {FEAT}")
def structure_filters(spark, sf_dir):
    """The structure filter and the four families outside of it, over feature columns."""
    f = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("line_count"), F.array(*(F.count_if(F.col("l_linenumber") % 3 == k) for k in range(3))).alias("if_count"), (F.max("l_quantity").cast("int") % 5).alias("max_depth"), F.collect_set(F.when(F.col("l_returnflag") == "A", "+").otherwise("-")).alias("ops"))
    few = F.forall("if_count", lambda x: x <= 2)
    return f.select("l_orderkey", C.structure_ok(F.col("line_count"), F.col("if_count"), 5, 2).alias("structure_ok"), (F.col("max_depth") >= 3).alias("deeper"), (~few).alias("denser"), (F.col("line_count") > 5).alias("longer"), (F.array_contains("ops", "+") & F.array_contains("ops", "-")).alias("mixed"))


# -- synthesis (no SQL form; tests hold them against CPython) --------------------------------------


def _programs(spark, sf_dir, **dialect):
    """As many programs as there are documents."""
    return synth.generate(spark, read(spark, sf_dir, "documents").count(), **dialect)


@query()
def synth_corpus(spark, sf_dir):
    return _programs(spark, sf_dir)


@query()
def synth_loops(spark, sf_dir):
    return _programs(spark, sf_dir, seed=2, loops=True, depth=3, most_lines=15)


@query()
def trace_steps(spark, sf_dir):
    t = synth.traced(_programs(spark, sf_dir))
    return t.select("ex_id", "error", F.size("steps").alias("n_steps"), F.sha2("rendered", 256).alias("rendered_sha256"))


@query()
def trace_outcomes(spark, sf_dir):
    """Programs by what became of them: kept, or the error."""
    return synth.traced(_programs(spark, sf_dir)).groupBy(F.coalesce("error", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query()
def contiguous_windows(spark, sf_dir):
    """Windows of 512 tokens over traces that the span filter leaves; no token of a trace is left out."""
    t = synth.traced(_programs(spark, sf_dir)).filter("error IS NULL").select("ex_id", T.tokens(F.col("rendered")).alias("tok"))
    b = t.withColumn("bounds", F.concat(F.array(F.lit(0)), T.boundaries(F.col("tok"))))
    w = synth.windows(b, 512)
    return w.select("ex_id", "start", F.sha2(F.array_join("x", ""), 256).alias("x_sha256"), F.size("y").alias("block"))


@query()
def permuted_programs(spark, sf_dir):
    """Programs under 128 distinct permutations of their names each."""
    return rename.renamed_programs(_programs(spark, sf_dir)).select("ex_id", "copy", F.sha2("text", 256).alias("text_sha256"))


@query()
def program_features(spark, sf_dir):
    """Lines, blocks by depth, depth and operators of programs, and the filters over them."""
    f = _programs(spark, sf_dir, seed=3, depth=3, most_lines=15).select("ex_id", T.program_features(F.col("text")).alias("f")).select("ex_id", "f.*")
    few = F.forall("if_count", lambda x: x <= 2)
    return f.select("*", C.structure_ok(F.col("line_count"), F.col("if_count")).alias("structure_ok"), (F.col("max_depth") >= 3).alias("deeper"), (~few).alias("denser"), (F.col("line_count") > 10).alias("longer"), (F.size("ops") > 1).alias("mixed"))


@query()
def synth_until(spark, sf_dir):
    """As many programs that run and pass the structure filter, no text twice, as a tenth of the documents."""
    target = read(spark, sf_dir, "documents").count() // 10

    def kept(programs):
        ran = synth.traced(programs).filter("error IS NULL").select("ex_id", "text", T.program_features(F.col("text")).alias("f"))
        return C.dedup_keep_first(ran.filter(C.structure_ok(F.col("f.line_count"), F.col("f.if_count"))).select("ex_id", "text"), "text", "ex_id")

    return synth.until(spark, target, kept)


@query(f"SELECT doc_id, sha256(coalesce(list_aggregate(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda w: CASE w WHEN 'a' THEN 'z' WHEN 'e' THEN 'a' WHEN 'y' THEN 'e' ELSE w END), 'string_agg', ''), '')) AS renamed FROM {DOCS}")
def rename_letters(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(rename.rename_letters(F.col("text"), "aey", "zae"), 256).alias("renamed"))


@query("SELECT conv_id, turn, p.text = 'x' AS odd, length(p.text) AS prompt_chars, length(r.text) AS reference_chars FROM conversations p JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') r USING (conv_id, turn) WHERE p.role = 'user'")
def prompt_reference_join(spark, sf_dir):
    """Prompts beside their references: what is a pair by place elsewhere is a pair by key here."""
    c = read(spark, sf_dir, "conversations")
    r = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return c.filter("role = 'user'").join(r, ["conv_id", "turn"]).select("conv_id", "turn", (F.col("text") == "x").alias("odd"), F.length("text").cast("long").alias("prompt_chars"), F.length("reference").cast("long").alias("reference_chars"))


@query(f"SELECT n, page_id, len(picked) AS num_renamed, {renamed_sql('picked')} AS renamed FROM (SELECT n.i AS n, *, ordered[1:n.i] AS picked FROM {RALL}, (VALUES (1), (4), (8)) n(i))")
def renamed_sets(spark, sf_dir):
    """The renamed set of each N: how many identifiers of a page it changes, and the page's renamed text."""
    each = _ordered(spark, sf_dir).withColumn("n", F.explode(F.array(*map(F.lit, (1, 4, 8)))))
    return _renamed(each.select("page_id", "code", "n", F.slice("ordered", 1, F.col("n")).alias("picked"))).select("n", "page_id", "num_renamed", "renamed")


from loomwork.plans import more  # noqa: E402, F401  further queries register themselves
