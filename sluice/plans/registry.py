"""All queries of the library's own operators over the test tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import text as tx
from sluice.functions.text import TokenizerOptions
from sluice.operators import classifier, dedup, features, generate, labeling, linear, metrics, mlp, report, similarity, splits
from sluice.sources import files
from sluice.sources.shared import fresh_path, written

QUERIES: dict = {}
ORACLE_SQL: dict = {}

# Phrases that exercise every token rule, joined to the documents' texts by number.
PHRASES = ["std::vector<int> v; ptr->value == *ref && val != nullptr", "ParseHttpRequest m_bufferSize _fooBar __x", "a:::b foo:: ::bar Foo::Bar::process()",
           "0xFF 2024. 5abc 1E5 3.14", "i++ --j x || y <= z >= w ~q", "deadlock mutex thread-safe", "race condition atomic hazard pointer", "What does std::move do",
           "the and of is was", "XMLHttpRequest snake_case_name camelCase", "HTTPServer2Go x_Y_z", "a & b | c * d"]
_CASE = "CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PHRASES)) + " END"
VOCAB, MIN_DF, LR, SIM = 15000, 2, 50.0, 0.40
_PAT = TokenizerOptions().pattern()
_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# --- shared pieces of SQL -------------------------------------------------------------------------------------------
_CODE = f"code_docs AS (SELECT doc_id, text || ' ' || {_CASE} AS text FROM documents)"
_SEQ = lambda col: f"list_filter(list_transform(regexp_extract_all({col}, '{_PAT}'), lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z_]') THEN lower(t) ELSE t END), lambda t: NOT regexp_matches(t, '^[A-Za-z_]') OR t NOT IN ({_STOP}))"
_MARK = "regexp_replace(p, '([^A-Z])([A-Z])', '\\1' || chr(1) || '\\2', 'g')"
_MARK2 = f"(substr({_MARK}, 1, 1) || replace(substr({_MARK}, 2), '_', chr(1)))"
_SUB = lambda col: f"""list_filter(list_transform(flatten(list_transform(list_filter(regexp_extract_all({col}, '{_PAT}'), lambda t: regexp_matches(t, '^[A-Za-z_]')),
  lambda t: flatten(list_transform(string_split(t, '::'), lambda p: list_concat(CASE WHEN contains(t, '::') AND p <> '' THEN [p] ELSE [] END,
    CASE WHEN contains({_MARK2}, chr(1)) THEN list_filter(string_split({_MARK2}, chr(1)), lambda q: q <> '' AND q <> '_') ELSE [] END))))), lambda q: lower(q)), lambda q: q NOT IN ({_STOP}))"""  # noqa: E731
_TOK = lambda col: f"list_concat({_SEQ(col)}, {_SUB(col)})"
_GRAM = lambda n: f"CASE WHEN len(s) >= {n} THEN list_transform(range(1, CAST(len(s) - {n} + 2 AS BIGINT)), lambda i: array_to_string(s[i:i + {n - 1}], '_')) ELSE [] END"
_TIER = "CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END"
_LAB = f"lab AS (SELECT doc_id, CAST(max({_TIER}) AS INTEGER) AS tier FROM labels GROUP BY doc_id)"
_LD = f"{_LAB}, ld AS (SELECT d.doc_id, d.text, lab.tier FROM documents d JOIN lab USING (doc_id))"
_COUNTS = lambda rel: f"tok AS (SELECT doc_id, unnest({_TOK('text')}) AS token FROM {rel}), cnt AS (SELECT doc_id, token, count(*) AS c FROM tok GROUP BY ALL)"
_VOC = f"voc AS (SELECT CAST(row_number() OVER (ORDER BY tf DESC, df DESC, token) - 1 AS INTEGER) AS idx, * FROM (SELECT token, CAST(sum(c) AS BIGINT) AS tf, count(*) AS df FROM cnt GROUP BY token HAVING count(*) >= {MIN_DF} ORDER BY tf DESC, df DESC, token LIMIT {VOCAB}))"
_TFIDF = lambda n_rel: f"idf AS (SELECT *, ln((1.0 + (SELECT count(*) FROM {n_rel})) / (1.0 + df)) + 1 AS idf FROM voc), raw AS (SELECT doc_id, idx, (1 + ln(c)) * idf AS v FROM cnt JOIN idf USING (token)), x AS (SELECT doc_id, idx, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS value FROM raw)"
_CW = "cw AS (SELECT tier, sqrt(sum(count(*)) OVER () / (3.0 * count(*))) AS weight FROM ld GROUP BY tier)"
_STEP = f"""err AS (SELECT doc_id, {', '.join(f'weight * (1.0 / 3 - CASE WHEN tier = {k} THEN 1 ELSE 0 END) AS e{k}' for k in range(3))} FROM ld JOIN cw USING (tier)),
n AS (SELECT count(*) AS n FROM err), b AS (SELECT {', '.join(f'-{LR} * sum(e{k}) / count(*) AS b{k}' for k in range(3))} FROM err),
w AS (SELECT idx, {', '.join(f'-{LR} * sum(e{k} * value) / (SELECT n FROM n) AS w{k}' for k in range(3))} FROM x JOIN err USING (doc_id) GROUP BY idx)"""
_TRAIN = f"{_LD}, {_COUNTS('ld')}, {_VOC}, {_TFIDF('ld')}, {_CW}, {_STEP}"
_LOGIT = lambda rel, x: f"z AS (SELECT r.doc_id, {', '.join(f'b{k} + coalesce(s{k}, 0) AS z{k}' for k in range(3))} FROM {rel} r LEFT JOIN (SELECT doc_id, {', '.join(f'sum(w{k} * value) AS s{k}' for k in range(3))} FROM {x} JOIN w USING (idx) GROUP BY doc_id) USING (doc_id) CROSS JOIN b)"
_SOFT = lambda z: ", ".join(f"exp({z}{k} - greatest({z}0, {z}1, {z}2)) / (exp({z}0 - greatest({z}0, {z}1, {z}2)) + exp({z}1 - greatest({z}0, {z}1, {z}2)) + exp({z}2 - greatest({z}0, {z}1, {z}2))) AS p{k}" for k in range(3))
_ARG = "CASE WHEN p1 > p0 AND p1 >= p2 THEN 1 WHEN p2 > p0 AND p2 > p1 THEN 2 ELSE 0 END"
_HARD = " OR ".join(f"contains(text, '{s}')" for s in classifier.HARD_STEMS)
_NEWX = "tok2 AS (SELECT doc_id, unnest(toks) AS token FROM r), cnt2 AS (SELECT doc_id, token, count(*) AS c FROM tok2 GROUP BY ALL), raw2 AS (SELECT doc_id, idx, (1 + ln(c)) * idf AS v FROM cnt2 JOIN idf USING (token)), x2 AS (SELECT doc_id, idx, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS value FROM raw2)"
_DECIDE = f"""d1 AS (SELECT *, CASE WHEN session BETWEEN 0 AND 2 AND n <= 3 THEN 0.25 ELSE 1.0 END AS k, (2.5 + CASE WHEN n <= 3 THEN 0.3 * (3 - n) ELSE 0 END) * greatest(0.0, 1.0 - n / 15.0) AS boost, least(greatest((n - 10.0) / 40.0, 0.0), 1.0) AS len
  FROM (SELECT r.doc_id, text, session, CAST(len(toks) AS DOUBLE) AS n, z0, z1, z2 FROM r JOIN z USING (doc_id))),
d2 AS (SELECT doc_id, n, session, (z0 + CASE WHEN contains(text, 'std::') AND (starts_with(text, 'What does') OR starts_with(text, 'How do I')) THEN 1.2 ELSE 0 END) * k + CASE WHEN session = 0 THEN boost ELSE 0 END AS y0,
  (z1 + 0.4 * len) * k + CASE WHEN session = 1 THEN boost ELSE 0 END AS y1, (z2 + 0.8 * len + CASE WHEN {_HARD} THEN 2.0 ELSE 0 END) * k + CASE WHEN session = 2 THEN boost ELSE 0 END AS y2 FROM d1),
d3 AS (SELECT doc_id, n, session, {_SOFT('y')} FROM d2), d4 AS (SELECT *, {_ARG} AS best, greatest(p0, p1, p2) AS mx FROM d3),
dec AS (SELECT doc_id, CAST(CASE WHEN n = 0 THEN coalesce(session, 0) WHEN best <> 2 AND mx - p2 <= 0.05 AND p2 >= 0.30 THEN 2 WHEN best = 0 AND mx - p1 <= 0.05 AND p1 >= 0.30 THEN 1 ELSE best END AS INTEGER) AS predicted_tier, CASE WHEN n = 0 THEN 1.0 ELSE mx END AS confidence FROM d4)"""
_CLASSIFY = lambda rel, sess: f"{_TRAIN}, r AS (SELECT doc_id, text, {sess} AS session, {_TOK('text')} AS toks FROM {rel}), {_NEWX}, {_LOGIT('r', 'x2')}, {_DECIDE}"
_SELF = _CLASSIFY("ld", "NULL::INTEGER")
_PRED = f"{_SELF}, pr AS (SELECT doc_id, tier, predicted_tier, confidence FROM ld JOIN dec USING (doc_id))"
_CM = "grid AS (SELECT CAST(a.x AS INTEGER) AS true_tier, CAST(b.x AS INTEGER) AS pred_tier FROM range(3) a(x), range(3) b(x)), cm AS (SELECT g.true_tier, g.pred_tier, count(p.doc_id) AS n FROM grid g LEFT JOIN pr p ON p.tier = g.true_tier AND p.predicted_tier = g.pred_tier GROUP BY ALL)"
_PC = """pc AS (SELECT tier, CASE WHEN pd > 0 THEN tp / pd ELSE 0 END AS precision, CASE WHEN sp > 0 THEN tp / sp ELSE 0 END AS recall, sp FROM (SELECT CAST(t.x AS INTEGER) AS tier, sum(CASE WHEN true_tier = t.x AND pred_tier = t.x THEN n ELSE 0 END) AS tp,
  sum(CASE WHEN pred_tier = t.x THEN n ELSE 0 END) AS pd, sum(CASE WHEN true_tier = t.x THEN n ELSE 0 END) AS sp FROM cm, range(3) t(x) GROUP BY t.x)),
pf AS (SELECT tier, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, CAST(sp AS BIGINT) AS support FROM pc)"""
_NORM = "trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
_DUP = f"k AS (SELECT doc_id, {_NORM} AS k FROM documents WHERE text IS NOT NULL)"
_VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v)"
_PAIRS = f"{_VEC}, pairs AS (SELECT q.vec_id AS query_id, x.vec_id AS id, q.label AS la, x.label AS lb, list_dot_product(q.e, x.e) AS similarity FROM u q JOIN u x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0)"
_ALL = _PAIRS.replace("q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0", "q.vec_id < x.vec_id")  # every pair once
_EDGES = f"{_VEC}, edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) >= {SIM})"
_CLUST = "reach(node, root) AS (SELECT a, a FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b), root AS (SELECT node AS id, min(root) AS root FROM reach GROUP BY node), num AS (SELECT root, cluster_size, row_number() OVER (ORDER BY cluster_size DESC, root) AS cluster FROM (SELECT root, count(*) AS cluster_size FROM root GROUP BY root))"
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')"
_ORDER = lambda i: f"md5('42:' || CAST({i} AS VARCHAR)), {i}"


# --- shared pieces of plans -----------------------------------------------------------------------------------------
def code_docs(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.expr(f"text || ' ' || {_CASE}").alias("text"))


def tiers(spark, sf):
    tier = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    return _t(spark, sf, "labels").groupBy("doc_id").agg(F.max(tier).alias("tier"))


def labelled(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", "text").join(tiers(spark, sf), "doc_id")


def _vocabulary(docs, size=VOCAB):
    return features.text_vocabulary(docs, "doc_id", max_size=size, min_df=MIN_DF)


def _model(spark, sf):
    rows = labelled(spark, sf)
    m = classifier.TierClassifier()
    m.fit(rows, "doc_id", "text", "tier", VOCAB, MIN_DF, LR, 0.0)
    m.weights, m.bias = written(m.weights, "weights"), written(m.bias, "bias")
    return m, rows


def _predicted(spark, sf):
    m, rows = _model(spark, sf)
    got = m.transform(rows, "doc_id").select(F.col("id").alias("doc_id"), "predicted_tier", "confidence")
    return rows.select("doc_id", "tier").join(written(got, "predicted"), "doc_id")  # a filter on the tier would repeat its expressions


def _round(df, *cols, digits=4):
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# --- tokens and features --------------------------------------------------------------------------------------------
@query("tokenize_counts", f"WITH {_CODE} SELECT doc_id, len({_TOK('text')})::BIGINT AS n_tokens, md5(array_to_string({_TOK('text')}, ' ')) AS signature FROM code_docs")
def tokenize_counts(spark, sf):
    return code_docs(spark, sf).withColumn("t", tx.tokenize(F.col("text"))).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("signature"))


@query("tokenize_exploded", f"WITH {_CODE}, t AS (SELECT doc_id, {_SEQ('text')} AS s FROM code_docs) SELECT doc_id, CAST(unnest(range(1, len(s) + 1)) AS BIGINT) AS pos, unnest(s) AS token FROM t")
def tokenize_exploded(spark, sf):
    return code_docs(spark, sf).select("doc_id", F.posexplode(tx.base_sequence(F.col("text"))).alias("p", "token")).select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "token")


@query("tokenize_ngrams", f"WITH {_CODE}, t AS (SELECT doc_id, {_SEQ('text')} AS s FROM code_docs), g AS (SELECT doc_id, list_concat({_GRAM(2)}, {_GRAM(3)}) AS g FROM t) SELECT doc_id, len(g)::BIGINT AS n_tokens, md5(array_to_string(g, ' ')) AS signature FROM g")
def tokenize_ngrams(spark, sf):
    options = TokenizerOptions(split_camel_case=False, ngram_min=2, ngram_max=3)
    return code_docs(spark, sf).withColumn("t", tx.tokenize(F.col("text"), options)).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("signature"))


@query("tokenize_subwords", f"WITH {_CODE} SELECT doc_id, unnest({_SUB('text')}) AS token FROM code_docs")
def tokenize_subwords(spark, sf):
    return code_docs(spark, sf).select("doc_id", F.explode(tx.subwords(F.col("text"))).alias("token"))


@query("tokenize_pages", f"SELECT page_id, len({_TOK('html')})::BIGINT AS n_tokens, md5(array_to_string({_TOK('html')}, ' ')) AS signature FROM pages")
def tokenize_pages(spark, sf):
    return _t(spark, sf, "pages").withColumn("t", tx.tokenize(F.col("html"))).select("page_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("signature"))


@query("vocabulary_topk", f"WITH {_COUNTS('documents')}, {_VOC} SELECT idx, token, tf, df FROM voc")
def vocabulary_topk(spark, sf):
    return _vocabulary(_t(spark, sf, "documents"))


@query("vocab_min_df", f"WITH {_COUNTS('documents')}, f AS (SELECT token, count(*) AS df FROM cnt GROUP BY token) SELECT count(*) AS tokens, count(*) FILTER (df >= {MIN_DF}) AS kept FROM f")
def vocab_min_df(spark, sf):
    return features.text_totals(_t(spark, sf, "documents"), "doc_id").agg(F.count("*").alias("tokens"), F.count(F.when(F.col("df") >= MIN_DF, 1)).alias("kept"))


def _idf_query(smooth):
    def run(spark, sf):
        docs = _t(spark, sf, "documents")
        return _round(features.with_idf(_vocabulary(docs), docs.count(), smooth).select("token", "df", "idf"), "idf")

    return run


query("idf_smooth", f"WITH {_COUNTS('documents')}, {_VOC} SELECT token, df, round(ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1, 4) AS idf FROM voc")(_idf_query(True))
query("idf_raw", f"WITH {_COUNTS('documents')}, {_VOC} SELECT token, df, round(ln((SELECT count(*) FROM documents) / greatest(df, 1)) + 1, 4) AS idf FROM voc")(_idf_query(False))


def _features(spark, sf):
    docs = _t(spark, sf, "documents")
    return features.text_tfidf(docs, "doc_id", features.with_idf(_vocabulary(docs), docs.count()))


@query("tfidf_long", f"WITH {_COUNTS('documents')}, {_VOC}, {_TFIDF('documents')} SELECT doc_id, idx, round(value, 4) AS value FROM x")
def tfidf_long(spark, sf):
    return _round(_features(spark, sf), "value")


@query("tfidf_norm_check", f"WITH {_COUNTS('documents')}, {_VOC}, {_TFIDF('documents')} SELECT doc_id, count(*) AS n_features, round(sqrt(sum(value * value)), 4) AS norm FROM x GROUP BY doc_id")
def tfidf_norm_check(spark, sf):
    return _round(_features(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_features"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")), "norm")


@query("oov_docs", f"WITH {_COUNTS('documents')}, {_VOC}, bt AS (SELECT item_id, unnest({_TOK('text')}) AS token FROM benchmark) SELECT b.item_id, count(bt.token) AS n_tokens, count(voc.token) AS n_known FROM benchmark b LEFT JOIN bt USING (item_id) LEFT JOIN voc USING (token) GROUP BY b.item_id")
def oov_docs(spark, sf):
    vocab = _vocabulary(_t(spark, sf, "documents")).select("token", F.lit(1).alias("known"))
    items = _t(spark, sf, "benchmark").select("item_id", F.explode_outer(tx.tokenize(F.col("text"))).alias("token"))
    return items.join(F.broadcast(vocab), "token", "left").groupBy("item_id").agg(F.count("token").alias("n_tokens"), F.count("known").alias("n_known"))


# --- labels ---------------------------------------------------------------------------------------------------------
@query("class_weights", f"WITH {_LAB} SELECT CAST(g.x AS INTEGER) AS tier, count(lab.doc_id) AS n, round(sqrt((SELECT count(*) FROM lab) / (3.0 * count(lab.doc_id))), 4) AS weight FROM range(3) g(x) LEFT JOIN lab ON lab.tier = g.x GROUP BY g.x")
def class_weights(spark, sf):
    return _round(linear.class_weights(tiers(spark, sf)), "weight")


@query("label_distribution", "SELECT lang AS label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM documents GROUP BY lang")
def label_distribution(spark, sf):
    return _round(report.label_distribution(_t(spark, sf, "documents"), "lang"), "share")


_RAW = "CASE doc_id % 6 WHEN 0 THEN 'TIER_1_SIMPLE' WHEN 1 THEN '[TIER_2_REFACTOR]' WHEN 2 THEN '2' WHEN 3 THEN '[[TIER_3_COMPLEX' WHEN 4 THEN 'N/A' ELSE '0' END"
_CANON = "CASE WHEN trim(label, '[]') = 'TIER_2_REFACTOR' THEN 'TIER_2_MEDIUM' ELSE trim(label, '[]') END"


@query("encode_labels", f"WITH l AS (SELECT doc_id, {_RAW} AS label FROM documents), t AS (SELECT doc_id, label, CAST(CASE WHEN label IN ('TIER_1_SIMPLE', '0') THEN 0 WHEN label IN ('TIER_2_MEDIUM', '1') THEN 1 WHEN label IN ('TIER_3_COMPLEX', '2') THEN 2 END AS INTEGER) AS tier FROM l) SELECT doc_id, label, CAST(coalesce(tier, 255) AS INTEGER) AS tier, CASE tier WHEN 0 THEN 'TIER_1_SIMPLE' WHEN 1 THEN 'TIER_2_MEDIUM' WHEN 2 THEN 'TIER_3_COMPLEX' ELSE 'UNKNOWN' END AS name FROM t")
def encode_labels(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", F.expr(_RAW).alias("label"))
    return rows.withColumn("tier", tx.encode_tier(F.col("label"))).withColumn("name", tx.decode_tier(F.col("tier"))).withColumn("tier", F.coalesce("tier", F.lit(255)))


@query("canonicalize_labels", f"WITH l AS (SELECT doc_id, {_RAW} AS label FROM documents), c AS (SELECT doc_id, {_CANON} AS label FROM l) SELECT doc_id, label, label IN ('TIER_1_SIMPLE', 'TIER_2_MEDIUM', 'TIER_3_COMPLEX') AS valid FROM c")
def canonicalize_labels(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", tx.canonical_label(F.expr(_RAW)).alias("label"))
    return rows.withColumn("valid", F.col("label").isin(*tx.TIERS))


@query("surrogate_ids", "SELECT doc_id, 'item_' || doc_id AS item, 'rec_' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(5, len(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS rec, coalesce(source, 'row') || '_' || doc_id AS named, substr(text, 1, 110) AS preview FROM documents")
def surrogate_ids(spark, sf):
    i = F.col("doc_id")
    return _t(spark, sf, "documents").select("doc_id", F.format_string("item_%d", i).alias("item"), F.format_string("rec_%05d", i).alias("rec"), F.concat(F.coalesce("source", F.lit("row")), F.lit("_"), i.cast("string")).alias("named"), F.substring("text", 1, 110).alias("preview"))


# --- the linear learner and the decision stack ----------------------------------------------------------------------
@query("lr_step1", f"WITH {_TRAIN} SELECT idx, {', '.join(f'round(w{k}, 4) + 0.0::DOUBLE AS w{k}' for k in range(3))} FROM w")
def lr_step1(spark, sf):
    return _round(_model(spark, sf)[0].weights, "w0", "w1", "w2").select("idx", *[(F.col(f"w{k}") + 0.0).alias(f"w{k}") for k in range(3)])  # no negative zero


def _scores(spark, sf):
    m, rows = _model(spark, sf)
    x = features.text_tfidf(rows, "doc_id", m.vocab)
    return m, rows, linear.logits(rows, x, m.weights, m.bias, "doc_id")


@query("lr_logits", f"WITH {_TRAIN}, {_LOGIT('ld', 'x')} SELECT doc_id, {', '.join(f'round(z{k}, 4) AS z{k}' for k in range(3))} FROM z")
def lr_logits(spark, sf):
    return _round(_scores(spark, sf)[2], "z0", "z1", "z2")


@query("lr_softmax", f"WITH {_TRAIN}, {_LOGIT('ld', 'x')}, s AS (SELECT doc_id, {_SOFT('z')} FROM z) SELECT doc_id, {', '.join(f'round(p{k}, 4) AS p{k}' for k in range(3))}, CAST({_ARG} AS INTEGER) AS best FROM s")
def lr_softmax(spark, sf):
    p = linear.probabilities(_scores(spark, sf)[2], "doc_id")
    return _round(p.withColumn("best", tx.argmax3([F.col(f"p{k}") for k in range(3)])), "p0", "p1", "p2")


@query("lr_loss", f"WITH {_TRAIN}, {_LOGIT('ld', 'x')}, g AS (SELECT z.*, greatest(z0, z1, z2) AS m, tier, weight FROM z JOIN ld USING (doc_id) JOIN cw USING (tier)) SELECT round(avg(weight * (m + ln(exp(z0 - m) + exp(z1 - m) + exp(z2 - m)) - CASE tier WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END)) + 0.5 * 0.00001 * (SELECT sum(w0 * w0 + w1 * w1 + w2 * w2) FROM w), 4) AS loss FROM g")
def lr_loss(spark, sf):
    m, rows, z = _scores(spark, sf)
    labels = rows.select("doc_id", "tier")
    return _round(linear.cross_entropy(z, labels, linear.class_weights(labels).select("tier", "weight"), m.weights, "doc_id", 1e-5), "loss")


@query("top_features", f"WITH {_TRAIN}, l AS (SELECT idx, 0 AS tier, w0 AS weight FROM w UNION ALL SELECT idx, 1, w1 FROM w UNION ALL SELECT idx, 2, w2 FROM w) SELECT CAST(tier AS INTEGER) AS tier, CAST(rank AS INTEGER) AS rank, token, round(weight, 4) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY round(weight, 9) DESC, idx) AS rank FROM l) JOIN voc USING (idx) WHERE rank <= 10")
def top_features(spark, sf):
    m = _model(spark, sf)[0]
    return _round(report.top_features(m.weights, m.vocab), "weight")


@query("classify_docs", f"WITH {_CODE}, {_CLASSIFY('code_docs', 'NULL::INTEGER')} SELECT doc_id, predicted_tier, round(confidence, 4) AS confidence FROM dec")
def classify_docs(spark, sf):
    got = _model(spark, sf)[0].transform(code_docs(spark, sf), "doc_id")
    return _round(got.select(F.col("id").alias("doc_id"), "predicted_tier", "confidence"), "confidence")


@query("classify_session", f"WITH {_CODE}, {_CLASSIFY('code_docs', 'CASE WHEN doc_id % 4 < 3 THEN CAST(doc_id % 4 AS INTEGER) END')} SELECT doc_id, predicted_tier, round(confidence, 4) AS confidence FROM dec")
def classify_session(spark, sf):
    rows = code_docs(spark, sf).withColumn("session", F.when(F.col("doc_id") % 4 < 3, (F.col("doc_id") % 4).cast("int")))
    got = _model(spark, sf)[0].transform(rows, "doc_id", session_col="session")
    return _round(got.select(F.col("id").alias("doc_id"), "predicted_tier", "confidence"), "confidence")


_SHORT = f"short AS (SELECT doc_id, {_CASE} AS text FROM documents)"


@query("classify_short_turns", f"WITH {_SHORT}, {_CLASSIFY('short', 'CASE WHEN doc_id % 5 < 3 THEN CAST(doc_id % 5 AS INTEGER) END')} SELECT doc_id, predicted_tier, round(confidence, 4) AS confidence FROM dec")
def classify_short_turns(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", F.expr(_CASE).alias("text"), F.when(F.col("doc_id") % 5 < 3, (F.col("doc_id") % 5).cast("int")).alias("session"))
    got = _model(spark, sf)[0].transform(rows, "doc_id", session_col="session")
    return _round(got.select(F.col("id").alias("doc_id"), "predicted_tier", "confidence"), "confidence")


@query("error_listing", f"WITH {_PRED} SELECT doc_id, tier, predicted_tier FROM pr WHERE tier <> predicted_tier")
def error_listing(spark, sf):
    return report.misclassified(_predicted(spark, sf), "tier", "predicted_tier").select("doc_id", "tier", "predicted_tier")


@query("top_confusions", f"WITH {_PRED} SELECT doc_id, tier, predicted_tier, round(confidence, 4) AS confidence FROM pr WHERE tier <> predicted_tier ORDER BY round(confidence, 6) DESC, doc_id LIMIT 15")
def top_confusions(spark, sf):
    rows = _predicted(spark, sf).withColumn("c", F.round("confidence", 6))
    return _round(report.top_confusions(rows, "tier", "predicted_tier", "c", "doc_id").select("doc_id", "tier", "predicted_tier", "confidence"), "confidence")


@query("confusion_matrix", f"WITH {_PRED}, {_CM} SELECT * FROM cm")
def confusion_matrix(spark, sf):
    return metrics.confusion(_predicted(spark, sf), "tier", "predicted_tier")


@query("per_class_metrics", f"WITH {_PRED}, {_CM}, {_PC} SELECT tier, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM pf")
def per_class_metrics(spark, sf):
    return _round(metrics.per_class(metrics.confusion(_predicted(spark, sf), "tier", "predicted_tier")), "precision", "recall", "f1")


@query("eval_summary", f"WITH {_PRED}, {_CM}, {_PC} SELECT (SELECT count(*) FROM pr) AS n, round((SELECT avg(CAST(tier = predicted_tier AS INTEGER)) FROM pr), 4) AS accuracy, round(sum(precision) / 3, 4) AS macro_precision, round(sum(recall) / 3, 4) AS macro_recall, round(sum(f1) / 3, 4) AS macro_f1 FROM pf")
def eval_summary(spark, sf):
    return _round(metrics.summary(_predicted(spark, sf), "tier", "predicted_tier"), "accuracy", "macro_precision", "macro_recall", "macro_f1")


# --- duplicates -----------------------------------------------------------------------------------------------------
@query("normalized_text", f"SELECT doc_id, md5({_NORM}) AS digest, len({_NORM})::BIGINT AS n_chars FROM documents")
def normalized_text(spark, sf):
    return _t(spark, sf, "documents").withColumn("k", tx.normalize(F.col("text"))).select("doc_id", F.md5(F.col("k").cast("binary")).alias("digest"), F.length("k").cast("long").alias("n_chars"))


@query("exact_dup_pairs", f"WITH {_DUP} SELECT id, class_id, links FROM (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY k) AS class_id, count(*) OVER (PARTITION BY k) - 1 AS links FROM k) WHERE links > 0")
def exact_dup_pairs(spark, sf):
    return dedup.exact_classes(_t(spark, sf, "documents"), "doc_id")


@query("dup_summary", f"WITH {_DUP} SELECT count(*) AS n, count(DISTINCT k) AS n_distinct, count(*) - count(DISTINCT k) AS n_duplicates FROM k")
def dup_summary(spark, sf):
    keyed = _t(spark, sf, "documents").filter("text is not null").groupBy(F.sha2(tx.normalize(F.col("text")), 256).alias("k")).agg(F.count("*").alias("c"))
    return keyed.agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct")).withColumn("n_duplicates", F.col("n") - F.col("n_distinct"))


# --- embeddings -----------------------------------------------------------------------------------------------------
def _searched(spark, sf, **how):
    vectors = _t(spark, sf, "embeddings")
    return similarity.search(vectors, vectors.filter("vec_id % 100 = 0"), **how)


def _with_labels(pairs, spark, sf):
    labels = _t(spark, sf, "embeddings").select("vec_id", "label")
    pairs = pairs.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("label_a")), "query_id")
    pairs = pairs.join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("label_b")), "id")
    return pairs.withColumn("same_label", F.col("label_a") == F.col("label_b"))


def _pairs(spark, sf, threshold):
    pairs = similarity.all_pairs(_t(spark, sf, "embeddings"), threshold).withColumnsRenamed({"id_a": "query_id", "id_b": "id"})
    return _with_labels(pairs, spark, sf)


@query("cosine_pairs", f"WITH {_ALL} SELECT query_id, id, round(similarity, 4) AS similarity, la AS label_a, lb AS label_b, la = lb AS same_label FROM pairs WHERE similarity >= {SIM}")
def cosine_pairs(spark, sf):
    return _round(_pairs(spark, sf, SIM), "similarity").select("query_id", "id", "similarity", "label_a", "label_b", "same_label")


@query("cross_label_pairs", f"WITH {_ALL} SELECT query_id, id, round(similarity, 4) AS similarity, la AS label_a, lb AS label_b FROM pairs WHERE similarity >= {SIM} AND la <> lb")
def cross_label_pairs(spark, sf):
    return _round(_pairs(spark, sf, SIM).filter("not same_label"), "similarity").select("query_id", "id", "similarity", "label_a", "label_b")


@query("knn_topk", f"WITH {_PAIRS} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(similarity, 4) AS similarity, la AS label_a, lb AS label_b FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM pairs) WHERE rank <= 10")
def knn_topk(spark, sf):
    return _round(_with_labels(_searched(spark, sf, top_k=10), spark, sf), "similarity").select("query_id", "rank", "id", "similarity", "label_a", "label_b")


@query("sim_percentiles", f"WITH {_ALL} SELECT p AS percentile, round(v, 4) AS similarity FROM (SELECT unnest([50.0, 75.0, 90.0, 95.0, 99.0, 99.5, 99.9]::DOUBLE[]) AS p, unnest(quantile_cont(similarity, [0.5, 0.75, 0.9, 0.95, 0.99, 0.995, 0.999])) AS v FROM pairs)")
def sim_percentiles(spark, sf):
    return _round(similarity.all_percentiles(_t(spark, sf, "embeddings")), "similarity")


_GRID = (0.1, 0.2, 0.3, 0.4, 0.5)


@query("sim_thresholds", f"WITH {_ALL} SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (similarity >= t) AS n FROM pairs, (SELECT unnest([{', '.join(map(str, _GRID))}]::DOUBLE[]) AS t) GROUP BY t")
def sim_thresholds(spark, sf):
    return similarity.all_threshold_counts(_t(spark, sf, "embeddings"), _GRID)


@query("run_summary", f"WITH {_ALL} SELECT (SELECT count(*) FROM embeddings) AS samples, (SELECT max(len(embedding)) FROM embeddings)::INTEGER AS dimensions, count(*) AS similar_pairs, count(*) FILTER (la <> lb) AS cross_label_pairs, CAST({SIM} AS DOUBLE) AS threshold FROM pairs WHERE similarity >= {SIM}")
def run_summary(spark, sf):
    return _summary(spark, sf, _pairs(spark, sf, SIM))


def _summary(spark, sf, pairs):
    pairs = pairs.agg(F.count("*").alias("similar_pairs"), F.count(F.when(~F.col("same_label"), 1)).alias("cross_label_pairs"))
    check = files.check_embeddings(_t(spark, sf, "embeddings")).select(F.col("n").alias("samples"), F.col("largest_dim").alias("dimensions"))
    return check.join(pairs).withColumn("threshold", F.lit(SIM))


def _clusters(spark, sf):
    vectors = _t(spark, sf, "embeddings")
    return dedup.clusters(vectors, similarity.link_forest(vectors, SIM), "vec_id")


@query("near_dup_clusters", f"WITH RECURSIVE {_EDGES}, {_CLUST} SELECT id, CAST(cluster AS INTEGER) AS cluster, cluster_size FROM root JOIN num USING (root)")
def near_dup_clusters(spark, sf):
    return _clusters(spark, sf)


@query("cluster_stats", f"WITH RECURSIVE {_EDGES}, {_CLUST} SELECT count(*) AS clusters, CAST(sum(cluster_size) AS BIGINT) AS rows_in_clusters, round(100.0 * sum(cluster_size) / (SELECT count(*) FROM embeddings), 4) AS percent FROM num")
def cluster_stats(spark, sf):
    total = _t(spark, sf, "embeddings").agg(F.count("*").alias("total"))
    got = _clusters(spark, sf).agg(F.countDistinct("cluster").alias("clusters"), F.count("*").alias("rows_in_clusters")).join(total)
    return got.select("clusters", "rows_in_clusters", F.round(100.0 * F.col("rows_in_clusters") / F.col("total"), 4).alias("percent"))


@query("cluster_preview", f"WITH RECURSIVE {_EDGES}, {_CLUST} SELECT CAST(cluster AS INTEGER) AS cluster, id, preview FROM (SELECT cluster, id, 'label ' || label AS preview, row_number() OVER (PARTITION BY cluster ORDER BY id) AS k FROM root JOIN num USING (root) JOIN embeddings ON vec_id = id WHERE cluster <= 10) WHERE k <= 3")
def cluster_preview(spark, sf):
    named = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("preview_text"))
    return report.previews(_clusters(spark, sf).join(named, "id"), "cluster", "id", "preview_text")


_PAIRTEXT = f"pt AS (SELECT query_id AS id_a, id AS id_b, CASE la % 3 WHEN 0 THEN 'TIER_1_SIMPLE' WHEN 1 THEN '[TIER_2_REFACTOR]' ELSE 'TIER_3_COMPLEX' END AS label_a, CASE lb % 3 WHEN 0 THEN 'TIER_1_SIMPLE' WHEN 1 THEN '[TIER_2_REFACTOR]' ELSE 'TIER_3_COMPLEX' END AS label_b, CASE WHEN query_id % 200 = 0 THEN 'a blocking call' ELSE 'same text' END AS text_a, CASE WHEN id % 2 = 0 THEN ' Same Text' ELSE 'other' END AS text_b FROM pairs WHERE similarity >= 0.2 AND la <> lb)"
_CONF = tx.CONCURRENCY


@query("reconcile_cross_label", f"""WITH {_ALL}, {_PAIRTEXT}, c AS (SELECT *, CASE WHEN trim(label_a, '[]') = 'TIER_2_REFACTOR' THEN 'TIER_2_MEDIUM' ELSE label_a END AS a, CASE WHEN trim(label_b, '[]') = 'TIER_2_REFACTOR' THEN 'TIER_2_MEDIUM' ELSE label_b END AS b FROM pt),
m AS (SELECT *, (a = 'TIER_2_MEDIUM' AND b = 'TIER_3_COMPLEX') OR (a = 'TIER_3_COMPLEX' AND b = 'TIER_2_MEDIUM') AS mixed, regexp_matches(text_a, '{_CONF}') OR regexp_matches(text_b, '{_CONF}') AS about FROM c),
g AS (SELECT DISTINCT CASE WHEN mixed AND about THEN CASE WHEN a = 'TIER_2_MEDIUM' THEN id_a ELSE id_b END WHEN mixed THEN id_b WHEN lower(trim(text_a)) = lower(trim(text_b)) THEN id_b END AS id FROM m)
SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM g WHERE id IS NOT NULL)""")
def reconcile_cross_label(spark, sf):
    name = lambda c: F.when(F.col(c) % 3 == 0, "TIER_1_SIMPLE").when(F.col(c) % 3 == 1, "[TIER_2_REFACTOR]").otherwise("TIER_3_COMPLEX")
    text_a = F.when(F.col("vec_id") % 200 == 0, "a blocking call").otherwise("same text")
    text_b = F.when(F.col("vec_id") % 2 == 0, " Same Text").otherwise("other")
    vectors = _t(spark, sf, "embeddings")
    drop = dedup.conflict_drops(vectors.select("vec_id", "embedding", "label", name("label").alias("name"), text_a.alias("text_a"), text_b.alias("text_b")), 0.2)
    return vectors.select(F.col("vec_id").alias("id")).join(drop, "id", "left_anti")


@query("greedy_dedup")
def greedy_dedup(spark, sf):
    return dedup.greedy_rounds(lambda asked, gone: similarity.threats(_t(spark, sf, "embeddings"), 0.3, asked, gone))


_SETS = f"w AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents), s0 AS (SELECT id, list_sort(list_distinct(list_transform(range(1, greatest(CAST(len(w) AS BIGINT) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS s FROM w WHERE len(w) > 0)"


@query("jaccard_pairs", f"WITH {_SETS}, s AS (SELECT s, min(id) AS id FROM s0 GROUP BY s), e AS (SELECT id, unnest(s) AS x FROM s), m AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY ALL), j AS (SELECT id_a, id_b, c / (len(a.s) + len(b.s) - c) AS similarity FROM m JOIN s a ON a.id = id_a JOIN s b ON b.id = id_b) SELECT id_a, id_b, round(similarity, 4) AS similarity FROM j WHERE similarity > 0.65")
def jaccard_pairs(spark, sf):
    return _round(dedup.jaccard_links(_t(spark, sf, "documents"), "doc_id"), "similarity")


@query("jaccard_band", f"WITH {_SETS}, e AS (SELECT id, unnest(s) AS x FROM s0), m AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND b.id BETWEEN a.id - 200 AND a.id - 1 GROUP BY ALL) SELECT id_a, id_b, round(c / (len(a.s) + len(b.s) - c), 4) AS similarity FROM m JOIN s0 a ON a.id = id_a JOIN s0 b ON b.id = id_b")
def jaccard_band(spark, sf):
    """Similarities of each document and those of the 200 ids before it, where they share a shingle; a shingle meets its own and the next block of ids only."""
    rows = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.transform(tx.shingles(F.col("text")), lambda x: F.xxhash64(x)).alias("s"))
    rows = rows.select("id", F.size("s").alias("n"), F.explode("s").alias("x")).withColumn("block", F.floor(F.col("id") / 200))
    a = rows.select(F.col("id").alias("id_a"), F.col("n").alias("n_a"), "x", F.explode(F.array("block", F.col("block") - 1)).alias("block"))
    b = rows.select(F.col("id").alias("id_b"), F.col("n").alias("n_b"), "x", "block")
    shared = a.join(b, ["x", "block"]).filter("id_b between id_a - 200 and id_a - 1").groupBy("id_a", "id_b", "n_a", "n_b").agg(F.count("*").alias("c"))
    return shared.select("id_a", "id_b", F.round(F.col("c") / (F.col("n_a") + F.col("n_b") - F.col("c")), 4).alias("similarity"))


@query("greedy_window_dedup")
def greedy_window_dedup(spark, sf):
    return dedup.window_dedup(_t(spark, sf, "documents"), "doc_id", "text")


# --- splits and samples ---------------------------------------------------------------------------------------------
def _split_sql(part):
    over = f"PARTITION BY {part}" if part else ""
    return f"WITH {_LAB}, o AS (SELECT *, row_number() OVER ({over} ORDER BY {_ORDER('doc_id')}) AS k, count(*) OVER ({over}) AS n FROM lab) SELECT doc_id, tier, CASE WHEN k <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN k <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM o"


@query("stratified_split", _split_sql("tier"))
def stratified_split(spark, sf):
    return splits.split(tiers(spark, sf), "doc_id", ["tier"])


@query("global_split", _split_sql(""))
def global_split(spark, sf):
    return splits.split(tiers(spark, sf), "doc_id")


@query("capped_balance", f"WITH {_LAB} SELECT doc_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY {_ORDER('doc_id')}) AS k FROM lab) WHERE k <= (SELECT min(c) FROM (SELECT count(*) AS c FROM lab GROUP BY tier))")
def capped_balance(spark, sf):
    rows = tiers(spark, sf)
    least = rows.groupBy("tier").count().agg(F.min("count")).first()[0] or 0
    return splits.capped(rows, "doc_id", "tier", least)


@query("audit_sample", f"WITH {_LAB} SELECT doc_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY {_ORDER('doc_id')}) AS k FROM lab) WHERE k <= greatest(1, 40 // (SELECT count(DISTINCT tier) FROM lab)) ORDER BY tier, {_ORDER('doc_id')} LIMIT 40")
def audit_sample(spark, sf):
    return splits.audit_sample(tiers(spark, sf), "doc_id", "tier")


# --- labelling ------------------------------------------------------------------------------------------------------
@query("content_key", "SELECT doc_id, sha256('v0' || chr(0) || text) AS hash FROM documents")
def content_key(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", tx.content_key(F.col("text")).alias("hash"))


def _cache(spark, sf):
    docs = _t(spark, sf, "documents")
    return docs, docs.filter("source = 'src0'").select(tx.content_key(F.col("text")).alias("hash"), F.lit("cached").alias("answer")).distinct()


@query("cache_hits", "SELECT doc_id, 'cached' AS answer FROM documents WHERE text IN (SELECT text FROM documents WHERE source = 'src0')")
def cache_hits(spark, sf):
    return labeling.cache_split(*_cache(spark, sf))[0].select("doc_id", "answer")


@query("cache_misses", "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source = 'src0' AND text IS NOT NULL)")
def cache_misses(spark, sf):
    return labeling.cache_split(*_cache(spark, sf))[1].select("doc_id")


@query("resume_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_rows(spark, sf):
    return labeling.remaining(_t(spark, sf, "documents").select("doc_id"), _t(spark, sf, "labels"), "doc_id")


_ANSWER = "CASE event_id % 5 WHEN 0 THEN ' [tier_1_simple] ' WHEN 1 THEN 'It is [TIER_2_MEDIUM].' WHEN 2 THEN '[TIER_3_COMPLEX]' WHEN 3 THEN 'none' ELSE '' END"


@query("normalize_tag", f"SELECT event_id, CASE WHEN contains(upper({_ANSWER}), '[TIER_1_SIMPLE]') THEN '[TIER_1_SIMPLE]' WHEN contains(upper({_ANSWER}), '[TIER_2_MEDIUM]') THEN '[TIER_2_MEDIUM]' WHEN contains(upper({_ANSWER}), '[TIER_3_COMPLEX]') THEN '[TIER_3_COMPLEX]' ELSE 'UNKNOWN' END AS tag FROM events")
def normalize_tag(spark, sf):
    return _t(spark, sf, "events").select("event_id", tx.normalize_tag(F.expr(_ANSWER)).alias("tag"))


_SHAPES = ("{\"output_text\":\"one\",\"text\":\"no\"}", "{\"output\":[{\"content\":[{\"text\":\"tw\"},{\"text\":\"o\"}]},{\"role\":\"x\"}]}", "{\"choices\":[{\"message\":{\"content\":\"three\"}}]}", "{\"completion\":\"four\"}", "{\"text\":\"five\"}", "{\"other\":1}")
_SHAPE = "CASE event_id % 6 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(_SHAPES)) + " END"


@query("payload_extract", f"SELECT event_id, coalesce(p->>'$.output_text', CASE WHEN len(p->>'$.output[*].content[*].text') > 0 THEN array_to_string(p->>'$.output[*].content[*].text', '') END, p->>'$.choices[0].message.content', p->>'$.completion', p->>'$.response', p->>'$.text', '') AS text FROM (SELECT event_id, CAST({_SHAPE} AS JSON) AS p FROM events)")
def payload_extract(spark, sf):
    return _t(spark, sf, "events").select("event_id", tx.payload_text(F.expr(_SHAPE)).alias("text"))


# --- learners and round trips (rows only) ---------------------------------------------------------------------------
def _weighed(spark, sf, size):
    rows = labelled(spark, sf)
    return rows, features.with_idf(_vocabulary(rows, size), rows.count())


@query("mllib_lr")
def mllib_lr(spark, sf):
    rows, vocab = _weighed(spark, sf, VOCAB)
    data = linear.to_vectors(features.text_tfidf(rows, "doc_id", vocab), "doc_id", VOCAB).join(rows.select("doc_id", F.col("tier").cast("double").alias("label")), "doc_id")
    weights = linear.class_weights(rows).select(F.col("tier").cast("double").alias("label"), "weight")
    data = written(data.join(F.broadcast(weights), "label").select("doc_id", "features", "label", "weight"), "vectors")
    return linear.train_mllib(data).transform(data).select("doc_id", F.col("label").cast("int").alias("tier"), F.col("prediction").cast("int").alias("predicted_tier"))


@query("mlp_predict")
def mlp_predict(spark, sf):
    rows, vocab = _weighed(spark, sf, 300)
    data = written(features.text_dense(rows, "doc_id", vocab, 300, more=("tier",)), "dense")
    return mlp.predict(data, mlp.train(data, "tier", 300), "doc_id", 300)


@query("generate_samples")
def generate_samples(spark, sf):
    return generate.generate(spark, 5100)


@query("model_roundtrip", f"WITH {_SELF} SELECT doc_id AS id, predicted_tier, round(confidence, 4) AS confidence FROM dec")
def model_roundtrip(spark, sf):
    m, rows = _model(spark, sf)
    path = fresh_path(spark, "model")
    m.save(path)
    return _round(classifier.TierClassifier.load(spark, path).transform(rows, "doc_id").select("id", "predicted_tier", "confidence"), "confidence")


@query("jsonl_roundtrip", f"WITH {_LD} SELECT CAST(doc_id AS VARCHAR) AS id, text, tier FROM ld WHERE text IS NOT NULL")
def jsonl_roundtrip(spark, sf):
    path = fresh_path(spark, "jsonl")
    files.write_jsonl(labelled(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "text", "tier"), path)
    return files.read_jsonl(spark, path)


@query("audit_csv_roundtrip", "SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents")
def audit_csv_roundtrip(spark, sf):
    path = fresh_path(spark, "csv")
    files.write_csv(_t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"), path)
    return files.read_csv(spark, path, "id string, text string")


_TURNS = "t AS (SELECT concat_ws(':', conv_id, turn) AS id, conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), four AS (SELECT id || '/' || s AS doc_id, text, s FROM t, (SELECT unnest([-1, 0, 1, 2]) AS s))"


@query("session_chain", f"""WITH RECURSIVE {_TURNS}, {_CLASSIFY('four', 'CASE WHEN s >= 0 THEN CAST(s AS INTEGER) END')},
walk AS (SELECT conv_id, k, id, predicted_tier, confidence FROM t JOIN dec ON dec.doc_id = id || '/-1' WHERE k = 1
  UNION ALL SELECT t.conv_id, t.k, t.id, dec.predicted_tier, dec.confidence FROM walk JOIN t ON t.conv_id = walk.conv_id AND t.k = walk.k + 1 JOIN dec ON dec.doc_id = t.id || '/' || walk.predicted_tier)
SELECT id, predicted_tier, round(confidence, 4) AS confidence FROM walk""")
def session_chain(spark, sf):
    """Each turn takes the tier that its conversation's turn before was given as its session."""
    m = _model(spark, sf)[0]
    turns = _t(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "conv_id", "turn", "text")
    return _round(m.transform_chain(turns, "id", "conv_id", "turn").select("id", "predicted_tier", "confidence"), "confidence")
