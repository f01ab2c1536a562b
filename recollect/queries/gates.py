"""Gate, families, roles, routes, the baseline, reranking and sufficiency."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions import values
from recollect.functions.text import content_tokens
from recollect.operators import baseline, gate, lexical, sufficiency
from recollect.queries import query
from recollect.queries.lexicon import CONTENT, TEXT, TOPICS_SQL, bm25_sql, documents, index_of, one_query, top_sql
from recollect.queries.search import vecs
from recollect.runtime import table

_IN = lambda words, col: "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"
_GATE = f"""SELECT doc_id, strlen(text) > {gate.MOST_BYTES} AS big,
  regexp_matches(text, '[\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2066}}-\\x{{2069}}]') AS u,
  {_IN(gate.SECRET_STARTS, 'text')} OR len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_full_match(w, '[A-Za-z0-9+/=]{{32,}}') AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[a-z]'))) > 0 AS s,
  {_IN(gate.INJECTIONS, 'lower(text)')} AS i, {_IN(gate.OPERATIONS, 'lower(text)')} AS o FROM documents"""


@query("gate_l0_l1", f"SELECT doc_id, u AS unicode_anomaly, s AS secret_signal, i AS injection_signal, o AS operation_signal, CASE WHEN big THEN 'block' WHEN u OR s OR i THEN 'flag' ELSE 'pass' END AS verdict FROM ({_GATE})")
def gate_l0_l1(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", *(c.alias(n) for n, c in gate.signals(t).items()), gate.verdict(t).alias("verdict"))


_FIELDS = "['k', 'event_type', 'ts', 'user_id', CASE event_id % 6 WHEN 0 THEN 'subject' WHEN 1 THEN 'amount_eur' WHEN 2 THEN 'title' WHEN 3 THEN 'created_at' WHEN 4 THEN 'City' ELSE 'url' END]"
_VOTE = " ".join(
    f"WHEN len(list_filter(f, lambda x: {' OR '.join(f'''lower(x) = '{w}' OR starts_with(lower(x), '{w}_')''' for w in words.split())})) = best THEN '{name}'" for name, words in gate.FAMILIES.items()
)
_COUNTS = ", ".join(f"len(list_filter(f, lambda x: {' OR '.join(f'''lower(x) = '{w}' OR starts_with(lower(x), '{w}_')''' for w in words.split())}))" for words in gate.FAMILIES.values())


def event_fields():
    m = F.pmod("event_id", F.lit(6))
    own = F.when(m == 0, "subject").when(m == 1, "amount_eur").when(m == 2, "title").when(m == 3, "created_at").when(m == 4, "City").otherwise("url")
    return F.array(F.lit("k"), F.lit("event_type"), F.lit("ts"), F.lit("user_id"), own)


@query("family_identify", f"SELECT event_id, CASE WHEN best = 0 THEN CASE WHEN len(list_filter(f, lambda x: lower(x) LIKE '%\\_at' ESCAPE '\\' OR lower(x) IN ('date', 'time', 'timestamp'))) > 0 THEN 'event' ELSE 'unshaped' END {_VOTE} END AS family FROM (SELECT *, greatest({_COUNTS}) AS best FROM (SELECT event_id, {_FIELDS} AS f FROM events))")
def family_identify(spark, sf):
    return table(spark, sf, "events").select("event_id", gate.family(event_fields()).alias("family"))


@query("field_roles", f"""SELECT field, kind, CASE WHEN l IN ('id', 'uuid', 'sku', 'email', 'from', 'to', 'sender', 'recipient') OR l LIKE '%\\_id' ESCAPE '\\' OR l LIKE '%\\_key' ESCAPE '\\' THEN 'identity'
  WHEN l LIKE '%\\_at' ESCAPE '\\' OR l IN ('date', 'time', 'timestamp', 'occurred', 'created', 'updated') THEN 'time' WHEN l IN ('title', 'subject', 'name', 'heading') THEN 'title'
  WHEN l IN ('body', 'content', 'text', 'description', 'message') THEN 'content' WHEN kind = 'number' AND regexp_matches(l, 'amount|price|score|priority|total|severity') THEN 'salience' ELSE 'other' END AS role, n
  FROM (SELECT field, lower(field) AS l, CASE WHEN field IN ('k', 'amount_eur', 'user_id') THEN 'number' ELSE 'string' END AS kind, count(*) AS n FROM (SELECT unnest({_FIELDS}) AS field FROM events) GROUP BY field)""")
def field_roles(spark, sf):
    f = table(spark, sf, "events").select(F.explode(event_fields()).alias("field"))
    kinds = f.groupBy("field").agg(F.count("*").alias("n")).withColumn("kind", F.when(F.col("field").isin("k", "amount_eur", "user_id"), "number").otherwise("string"))
    return kinds.withColumn("role", gate.role(F.col("field"), F.col("kind")))


@query("shape_census", "SELECT shape_key, count(*) AS n, CAST('0x' || substr(md5(shape_key), 1, 15) AS BIGINT) AS shape_id FROM (SELECT array_to_string(list_sort(list_transform(json_keys(props), lambda k: k || ':' || CASE WHEN json_type(props -> k) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'number' ELSE 'string' END)), ',') AS shape_key FROM events) GROUP BY 1")
def shape_census(spark, sf):
    s = table(spark, sf, "events").select(values.shape_key(F.col("props")).alias("shape_key"), F.lit("event").alias("family"))
    return gate.registry(s).select("shape_key", "n", "shape_id")


_C = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


@query("semantic_routes", f"""WITH u AS (SELECT label, embedding[i] AS x, i FROM embeddings, range(1, 65) r(i)), c AS (SELECT label AS tag, list(s ORDER BY i) AS q FROM (SELECT label, i, sum(CAST(x AS DOUBLE)) AS s FROM u GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id AS id, tag, round({_C.format('embedding', 'q')}, 6) AS score FROM embeddings, c WHERE {_C.format('embedding', 'q')} >= 0.25""")
def semantic_routes(spark, sf):
    v = vecs(spark, sf)
    sums = v.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    routes = sums.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("qvec")).withColumnRenamed("label", "tag")
    return gate.route(v.select("id", "vec"), routes, 0.25).withColumn("score", F.round("score", 6))


def observations(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("context"), F.col("event_type").alias("shape"), F.col("event_id").alias("seq"))


_DIST = f"WITH o AS (SELECT user_id AS context, event_type AS shape, event_id AS seq FROM events), w AS (SELECT context, shape, count(*) AS n, sum(exp((seq - (SELECT max(seq) FROM o)) * {baseline.GROWTH!r})) AS w FROM o GROUP BY 1, 2), d AS (SELECT context, shape, n, w / sum(w) OVER (PARTITION BY context) AS share FROM w)"


@query("baseline_distribution", f"{_DIST} SELECT context, shape, n, round(share, 6) AS share FROM d")
def baseline_distribution(spark, sf):
    return baseline.distribution(observations(spark, sf)).withColumn("share", F.round("share", 6))


_PRED = """p AS (SELECT context, max_by(shape, struct_pack(a := round(share, 12), b := shape)) AS shape, max(share) AS confidence, CAST(sum(n) AS BIGINT) AS observations, CASE WHEN count(*) <= 1 THEN 1.0 ELSE 1 + sum(CASE WHEN share > 0 THEN share * ln(share) ELSE 0 END) / ln(count(*)) END AS predictability FROM d GROUP BY context)"""


@query("predictability", f"{_DIST}, {_PRED} SELECT context, shape, round(confidence, 6) AS confidence, observations, round(predictability, 6) AS predictability FROM p")
def predictability(spark, sf):
    p = baseline.predictability(baseline.distribution(observations(spark, sf)))
    return p.withColumns({c: F.round(c, 6) for c in ("confidence", "predictability")})


_PSI = f"""nw AS (SELECT context, shape, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY seq DESC) AS r FROM o) WHERE r <= {baseline.RECENT} GROUP BY 1, 2), rf AS (SELECT context, shape, count(*) AS n FROM o GROUP BY 1, 2),
ps AS (SELECT context, shape, n / sum(n) OVER (PARTITION BY context) AS p FROM nw), qs AS (SELECT context, shape, n / sum(n) OVER (PARTITION BY context) AS q FROM rf),
psi AS (SELECT context, sum((greatest(coalesce(p, 0), 1e-4) - greatest(coalesce(q, 0), 1e-4)) * ln(greatest(coalesce(p, 0), 1e-4) / greatest(coalesce(q, 0), 1e-4))) AS psi FROM ps FULL JOIN qs USING (context, shape) GROUP BY context)"""


def _drift(spark, sf):
    o = observations(spark, sf)
    count = lambda d: d.groupBy("context", "shape").agg(F.count("*").alias("n"))
    return baseline.drift(count(baseline.recent(o)), count(o))


@query("psi_drift", f"{_DIST}, {_PSI} SELECT context, round(psi, 6) AS psi, psi > 0.25 AS alert FROM psi")
def psi_drift(spark, sf):
    return _drift(spark, sf).withColumn("psi", F.round("psi", 6))


@query("speculation", f"{_DIST}, {_PRED}, {_PSI}, r AS (SELECT context, CASE WHEN observations < 30 THEN 'too few observations' WHEN confidence < 0.97 THEN 'not sure enough' WHEN psi > 0.25 THEN 'drifting' ELSE 'ready' END AS reason FROM p LEFT JOIN psi USING (context)) SELECT context, reason = 'ready' AS actionable, reason FROM r")
def speculation(spark, sf):
    return baseline.speculation(baseline.predictability(baseline.distribution(observations(spark, sf))), _drift(spark, sf))


@query("prediction_hits", f"""WITH o AS (SELECT user_id AS context, event_type AS shape, event_id AS seq FROM events), s AS (SELECT DISTINCT context, shape AS other FROM o),
c AS (SELECT o.context, seq, shape, other, coalesce(sum(CASE WHEN shape = other THEN exp((seq - (SELECT max(seq) FROM o)) * {baseline.GROWTH!r}) ELSE 0.0 END) OVER (PARTITION BY o.context, other ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS c FROM o JOIN s ON o.context = s.context),
m AS (SELECT context, seq, shape, arg_max(other, struct_pack(c := c, other := other)) AS guess, max(c) AS c FROM c GROUP BY 1, 2, 3)
SELECT context, count(*) AS predictions, count(*) FILTER (guess = shape) AS hits FROM m WHERE c > 0 GROUP BY context""")
def prediction_hits(spark, sf):
    return baseline.hits(observations(spark, sf))


@query("session_trigger", """SELECT event_id, user_id, CASE WHEN p IS NULL THEN 'first' WHEN ts - p > INTERVAL 30 MINUTE THEN 'idle' END AS reason FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR ts - p > INTERVAL 30 MINUTE""")
def session_trigger(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumn("p", F.lag("ts").over(w))
    reason = F.when(F.col("p").isNull(), "first").when(F.col("ts") - F.col("p") > F.expr("interval 30 minutes"), "idle")
    return e.withColumn("reason", reason).where("reason is not null").select("event_id", "user_id", "reason")


_QT = f"qr AS (SELECT unnest({CONTENT}) AS term FROM ({TOPICS_SQL}))"


@query("rerank_lexical", f"""WITH {bm25_sql(TOPICS_SQL)}, {_QT}, cand AS {top_sql('bm', 20)}, ct AS (SELECT id, rank, {CONTENT} AS ts FROM cand JOIN documents ON doc_id = id),
cn AS (SELECT count(*) AS n, greatest(avg(len(ts)), 1.0) AS mean FROM ct), cp AS (SELECT id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM ct) GROUP BY 1, 2), cd AS (SELECT term, count(*) AS df FROM cp GROUP BY 1),
rs AS (SELECT id, sum(greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM qr JOIN cp USING (term) JOIN cd USING (term), cn GROUP BY id)
SELECT id, round(coalesce(rs.score, 0), 6) AS score, row_number() OVER (ORDER BY round(coalesce(rs.score, 0), 9) DESC, ct.rank) AS rank FROM ct LEFT JOIN rs USING (id) QUALIFY row_number() OVER (ORDER BY round(coalesce(rs.score, 0), 9) DESC, ct.rank) <= 5""")
def rerank_lexical(spark, sf):
    d = documents(spark, sf)
    hits = lexical.best(lexical.score_text(index_of(spark, sf), TEXT), 20).select("query_id", "id", "rank")
    cand = d.select("id", "text").join(F.broadcast(hits), "id")
    terms = one_query(spark).select("query_id", F.explode(content_tokens(F.col("text"))).alias("term"))
    out = lexical.rerank(terms, cand, 5)
    return out.select("id", F.round("score", 6).alias("score"), F.col("new_rank").alias("rank"))


@query("sufficiency_coverage", f"""WITH {bm25_sql('SELECT item_id AS query_id, text FROM benchmark')}, cand AS {top_sql('bm', 5)}, hv AS (SELECT DISTINCT query_id, unnest({CONTENT}) AS term FROM cand JOIN documents ON doc_id = id),
cv AS (SELECT qt.query_id, count(*) AS n, count(hv.term) AS k FROM qt LEFT JOIN hv ON qt.query_id = hv.query_id AND qt.term = hv.term GROUP BY 1)
SELECT item_id AS query_id, round(coalesce(k / n, 0), 6) AS confidence, CASE WHEN c.query_id IS NULL THEN 'no_context' WHEN n IS NULL THEN 'empty_query' WHEN k / n >= 0.5 THEN 'ready' WHEN k / n >= 0.25 THEN 'partial' ELSE 'insufficient' END AS label
FROM benchmark LEFT JOIN cv ON cv.query_id = item_id LEFT JOIN (SELECT DISTINCT query_id FROM cand) c ON c.query_id = item_id""")
def sufficiency_coverage(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    d = documents(spark, sf)
    cand = lexical.scan(d, q, 5).select("query_id", "id", "rank").join(d.select("id", "text"), "id")
    return sufficiency.coverage(q, cand).select("query_id", F.round("confidence", 6).alias("confidence"), "label")
