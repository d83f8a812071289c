"""More named queries: ingestion, merging, answers, metrics, ordering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestor.functions import lexicon as lx
from attestor.functions import text as tx
from attestor.operators import answers, measure, merge, ordered, select, selection
from attestor.plans.queries import query
from attestor.sources import ingest, store
from attestor.sources import views as vw


def _literal(name: str, values: tuple) -> str:
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(values)) + ") v(id, x))"


def _frame(spark, values: tuple):
    return spark.createDataFrame(list(enumerate(values)), "id int, x string")


# --- Ingestion -------------------------------------------------------------------------------------------------------------------------------------------


@query(
    """SELECT 'Q' || (page_id % 8) AS query_id, CAST(i AS INTEGER) AS pos, url, CASE WHEN i = 0 AND title <> '' THEN title ELSE url END AS title, CASE WHEN i = 0 THEN 'c' || page_id ELSE '' END AS content, CASE WHEN i = 0 THEN (page_id % 10) / 10.0::DOUBLE END AS score
    FROM (SELECT page_id, url, trim(regexp_extract(html, '<title>([A-Za-z ]*)', 1)) AS title FROM pages), (VALUES (0), (2)) v(i)"""
)
def payload_rows(spark, sf):
    """Each page's payload has a full result, one that is no web page, and one without title, content and a numeric score."""
    p = vw.table(spark, sf, "pages").select("page_id", "url", F.trim(F.regexp_extract("html", "<title>([A-Za-z ]*)", 1)).alias("title"))
    entry = lambda u, t, c, s: F.struct(u.alias("url"), t.alias("title"), c.alias("content"), s.alias("score"))
    none = F.lit(None).cast("string")
    results = F.array(
        entry(F.col("url"), F.col("title"), F.concat(F.lit("c"), F.col("page_id").cast("string")), ((F.col("page_id") % 10) / 10).cast("string")),
        entry(F.lit("ftp://x"), F.col("title"), none, none), entry(F.col("url"), F.lit(" "), none, F.lit("high")),
    )
    bodies = p.select(F.concat(F.lit("Q"), (F.col("page_id") % 8).cast("string")).alias("query_id"), F.to_json(F.struct(results.alias("results"))).alias("body"))
    return ingest.payload_rows(bodies)


@query(
    """WITH e AS (SELECT event_id, date_trunc('second', ts) AS t FROM events) SELECT event_id, strftime(CASE event_id % 8 WHEN 0 THEN t WHEN 1 THEN date_trunc('day', t) WHEN 2 THEN t WHEN 3 THEN t - INTERVAL 2 HOUR WHEN 4 THEN date_trunc('day', t) WHEN 5 THEN t END, '%Y-%m-%d %H:%M:%S') AS moment FROM e"""
)
def lenient_dates(spark, sf):
    """The times of events written in eight ways, two of which are no date, read back."""
    t = F.date_trunc("second", F.col("ts").cast("timestamp"))
    f = lambda pattern: F.date_format(t, pattern)
    month = F.substring(F.lit(ingest.MONTHS), F.month(t) * 3 - 2, F.lit(3))
    mail = F.concat(F.lit("Tue, "), f("d"), F.lit(" "), month, F.lit(" "), f("yyyy"))
    written = F.element_at(
        F.array(
            f("yyyy-MM-dd'T'HH:mm:ss'Z'"), f("yyyy-MM-dd"), F.concat(mail, F.lit(" "), f("HH:mm:ss"), F.lit(" GMT")), F.concat(mail, F.lit(" "), f("HH:mm:ss"), F.lit(" +0200")), F.concat(f("d"), F.lit(" "), month, F.lit(" "), f("yyyy")), f("yyyy-MM-dd HH:mm:ss"),
            F.lit("yesterday"), F.concat(f("yyyy"), F.lit("-13-40")),
        ),
        (F.col("event_id") % 8 + 1).cast("int"),
    )
    return vw.table(spark, sf, "events").select("event_id", F.date_format(ingest.lenient_time(written), "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query("SELECT page_id, page_id % 5 IN (0, 1, 3) AS is_pdf FROM pages")
def pdf_sniffing(spark, sf):
    """Pages as responses: PDF marks at the start, after some bytes, after HTML; a PDF content type; none."""
    html = F.concat(F.lit("<html>"), F.col("html"))
    body = F.element_at(F.array(F.concat(F.lit("%PDF-1.7 "), F.col("html")), F.lit("junk %PDF-1.4"), F.concat(F.lit("<html>%PDF-"), F.col("html")), html, html), (F.col("page_id") % 5 + 1).cast("int"))
    return vw.table(spark, sf, "pages").select("page_id", ingest.looks_like_pdf(body, F.when(F.col("page_id") % 5 == 3, "application/pdf").otherwise("text/html")).alias("is_pdf"))


@query(
    """WITH r AS (SELECT event_id, CASE WHEN event_id % 9 = 8 THEN NULL ELSE [200, 403, 404, 500, 200, 200, 200, 451][CAST(event_id % 9 + 1 AS INT)] END AS status, ['text/html; charset=utf-8', 'application/pdf', 'image/png'][CAST(event_id % 3 + 1 AS INT)] AS kind, event_id * 1000 AS length FROM events)
    SELECT event_id, CASE WHEN status IS NULL THEN 'timeout' WHEN status IN (401, 403, 451) THEN 'blocked' WHEN status = 404 THEN 'not_found' WHEN status >= 400 THEN 'http_error' WHEN length > 5000000 THEN 'too_large' WHEN contains(kind, 'pdf') THEN 'pdf' WHEN contains(kind, 'html') THEN 'ok' ELSE 'unsupported_type' END AS fetch FROM r"""
)
def fetch_decisions(spark, sf):
    at = lambda values, m: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("event_id") % m + 1).cast("int"))
    status = at([200, 403, 404, 500, 200, 200, 200, 451, None], 9)
    kind = at(["text/html; charset=utf-8", "application/pdf", "image/png"], 3)
    return vw.table(spark, sf, "events").select("event_id", ingest.fetch_status(status, kind, F.col("event_id") * 1000).alias("fetch"))


@query(
    """WITH p AS (SELECT conv_id, turn, length(text) AS n FROM conversations), o AS (SELECT conv_id, turn, CAST(coalesce(sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM p),
    a AS (SELECT conv_id, list("offset" ORDER BY turn) AS offsets FROM o GROUP BY 1) SELECT o.conv_id, o.turn, o."offset", CAST(len(list_filter(offsets, lambda x: x <= o."offset" + 5)) AS INT) AS page FROM o JOIN a USING (conv_id)"""
)
def page_offsets(spark, sf):
    """Turns of a conversation as pages: where each starts, and the page five characters on."""
    pages = ingest.page_offsets(vw.table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "offset")
    pages = store.written(pages, "offsets")
    numbered = ordered.running_sums(pages, ["conv_id"], "turn", [], {"page": F.lit(1)}).select("conv_id", F.col("offset").alias("start"), F.col("page").cast("int").alias("page"))
    asked = pages.withColumn("place", F.col("offset") + 5)
    return ordered.as_of(asked, numbered, ["conv_id"], "place", "start", ["page"]).select("conv_id", "turn", "offset", "page")


@query("SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS pos, event_type AS event, '{\"id\":' || event_id || '}' AS data FROM events")
def sse_events(spark, sf):
    """The events of each user's captured stream, which comes in chunks that are cut inside blocks."""
    block = F.encode(F.concat(F.lit("event: "), F.col("event_type"), F.lit('\ndata: {"id":'), F.col("event_id").cast("string"), F.lit("}\n\n")), "UTF-8")
    at = (F.col("event_id") % 25 + 1).cast("int")
    halves = F.array(F.struct((F.col("event_id") * 2).alias("n"), F.substring("b", F.lit(1), at).alias("body")), F.struct((F.col("event_id") * 2 + 1).alias("n"), F.substring("b", at + 1, F.length("b")).alias("body")))
    chunks = vw.table(spark, sf, "events").withColumn("b", block).select("user_id", F.explode(halves).alias("c")).select("user_id", "c.n", "c.body")
    return ingest.sse_records(chunks, "user_id", "n")


# --- Merging ---------------------------------------------------------------------------------------------------------------------------------------------


@query("SELECT user_id, min(event_id) AS first_seen, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def latest_writes(spark, sf):
    return merge.latest(vw.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("SELECT doc_id, lang, 'old' AS origin FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, lang, 'new' FROM documents WHERE doc_id % 3 <> 0")
def appended_rows(spark, sf):
    """Rows that are there already and a later load of all rows that aren't multiples of three, and of half of those that are: what is known stays as it is."""
    d = vw.table(spark, sf, "documents").select("doc_id", "lang")
    return merge.appended(d.where("doc_id % 3 = 0").withColumn("origin", F.lit("old")), d.where("doc_id % 3 <> 0 or doc_id % 2 = 0").withColumn("origin", F.lit("new")), "doc_id")


@query("SELECT user_id, list(event_type ORDER BY event_type) AS names, list(n ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def summed_counters(spark, sf):
    sums = merge.summed(vw.table(spark, sf, "events").withColumn("one", F.lit(1)), "user_id", "event_type", "one")
    return sums.select("user_id", F.map_keys("counters").alias("names"), F.map_values("counters").alias("counts"))


@query("SELECT coalesce(e.doc_id, a.doc_id) AS doc_id, e.n AS expected, a.n AS actual FROM (SELECT doc_id, n_chars AS n FROM documents WHERE doc_id % 5 <> 0) e FULL JOIN (SELECT doc_id, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS n FROM documents WHERE doc_id % 6 <> 0) a USING (doc_id) WHERE e.n IS DISTINCT FROM a.n")
def manifest_drift(spark, sf):
    d = vw.table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("n"))
    return merge.drift(d.where("doc_id % 5 <> 0"), d.where("doc_id % 6 <> 0").withColumn("n", F.col("n") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)), "doc_id", "n")


@query(
    """WITH h AS (SELECT sha256(concat_ws(chr(31), doc_id::VARCHAR, lang, n_chars::VARCHAR)) AS h FROM documents), a AS (SELECT substr(h, 1, 6) AS g, sha256(string_agg(h, '' ORDER BY h)) AS gh, count(*) AS n FROM h GROUP BY 1),
    b AS (SELECT substr(g, 1, 3) AS g, sha256(string_agg(gh, '' ORDER BY g)) AS gh, sum(n) AS n FROM a GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(gh, '' ORDER BY g)) AS hash FROM b"""
)
def corpus_hash(spark, sf):
    return merge.table_hash(vw.table(spark, sf, "documents"), ["doc_id", "lang", "n_chars"])


# --- Questions and answers -------------------------------------------------------------------------------------------------------------------------------

_SLOTS = "s AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{s}', {str(c).lower()})" for k, own in answers.SLOTS.items() for s, c in own) + ") v(kind, slot, core))"
_KINDS = list(answers.SLOTS)


def _asked(spark, sf):
    kind = F.element_at(F.array(*(F.lit(k) for k in _KINDS)), (F.col("conv_id") % len(_KINDS) + 1).cast("int"))
    return vw.table(spark, sf, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("question_id"), kind.alias("question_type"))


def _published(spark, sf):
    c = vw.claim_texts(spark, sf).select(F.col("conv_id").alias("question_id"), "turn")
    names = sorted({s for own in answers.SLOTS.values() for s, _ in own})
    return c.select("question_id", F.element_at(F.array(*(F.lit(n) for n in names)), ((F.col("question_id") + F.col("turn")) % len(names) + 1).cast("int")).alias("slot"))


_SLOT_NAMES = sorted({s for own in answers.SLOTS.values() for s, _ in own})


@query(
    f"""WITH {_SLOTS}, q AS (SELECT DISTINCT conv_id AS question_id, ([{", ".join(f"'{k}'" for k in _KINDS)}])[conv_id % {len(_KINDS)} + 1] AS kind FROM conversations), r AS (SELECT question_id, slot, core FROM q JOIN s USING (kind)),
    h AS (SELECT conv_id AS question_id, ([{", ".join(f"'{n}'" for n in _SLOT_NAMES)}])[(conv_id + turn) % {len(_SLOT_NAMES)} + 1] AS slot, count(*) AS claims FROM v_claims GROUP BY ALL),
    a AS (SELECT question_id, count(claims) AS filled, count(*) - count(claims) AS missing, count(*) FILTER (claims IS NULL AND core) AS missing_core, count(*) FILTER (core) AS core, CAST(coalesce(sum(claims - 1), 0) AS BIGINT) AS repeats FROM r LEFT JOIN h USING (question_id, slot) GROUP BY 1)
    SELECT *, core > 0 AND missing_core = 0 AS answered, NOT (core > 0 AND missing_core = 0) AND filled > 0 AS partly FROM a"""
)
def answer_coverage(spark, sf):
    return answers.answer_coverage(answers.slots(_asked(spark, sf)), _published(spark, sf))


@query("SELECT slot, count(DISTINCT placement) AS subjects, count(*) AS claims FROM v_claims WHERE placement IN ('summary', 'finding') GROUP BY 1 HAVING count(DISTINCT placement) = 2")
def comparison_pairs(spark, sf):
    return answers.covering(vw.claim_texts(spark, sf), "slot", "placement", ["summary", "finding"])


# --- Orders and bounds -----------------------------------------------------------------------------------------------------------------------------------


@query(
    """WITH q AS (SELECT DISTINCT 'SQ' || (conv_id % 5) AS sub_question_id, CAST(conv_id % 5 % 3 + 1 AS INT) AS priority, 'Q' || lpad(CAST(conv_id AS VARCHAR), 6, '0') AS query_id FROM conversations),
    d AS (SELECT *, CAST(row_number() OVER (PARTITION BY sub_question_id ORDER BY query_id) AS INT) AS depth FROM q) SELECT * FROM d ORDER BY depth, priority, sub_question_id LIMIT 12"""
)
def query_interleave(spark, sf):
    c = vw.table(spark, sf, "conversations")
    q = c.select(F.concat(F.lit("SQ"), (F.col("conv_id") % 5).cast("string")).alias("sub_question_id"), (F.col("conv_id") % 5 % 3 + 1).cast("int").alias("priority"), F.concat(F.lit("Q"), F.lpad(F.col("conv_id").cast("string"), 6, "0")).alias("query_id")).distinct()
    return selection.interleaved(q, 12)


@query(
    """WITH q AS (SELECT DISTINCT question_id FROM v_runs), o AS (SELECT question_id, CAST(row_number() OVER (ORDER BY question_id) AS INT) AS place FROM q) SELECT question_id, place, CASE WHEN place % 2 = 1 THEN ['local', 'cloud'] ELSE ['cloud', 'local'] END AS arms, sha256('seed|' || question_id) AS packet FROM o"""
)
def arm_order(spark, sf):
    q = vw.runs(spark, sf).select("question_id").distinct().withColumn("place", F.row_number().over(Window.orderBy("question_id")))
    pair = lambda *x: F.array(*(F.lit(v) for v in x))
    return q.withColumn("arms", F.when(F.col("place") % 2 == 1, pair("local", "cloud")).otherwise(pair("cloud", "local"))).withColumn("packet", F.sha2(F.concat(F.lit("seed|"), "question_id"), 256))


@query("SELECT lang, median(n) AS median_words, round(avg(n), 4) AS mean_words, count(*) AS documents FROM (SELECT lang, word_count AS n FROM v_sources) GROUP BY 1")
def median_words(spark, sf):
    """The exact median of the words of each language's documents, found by counts of ranges; no language's values meet in one place."""
    s = store.written(vw.sources(spark, sf).select("lang", "word_count"), "word_counts")
    means = s.groupBy("lang").agg(F.round(F.avg("word_count"), 4).alias("mean_words"), F.count(F.lit(1)).alias("documents"))
    return means.join(select.medians(s, "lang", "word_count"), "lang").select("lang", F.col("median").alias("median_words"), "mean_words", "documents")


@query(
    """SELECT arm, metric, round(avg(value), 4) AS mean, round(min(value), 4) AS least, round(max(value), 4) AS most, count(*) AS n FROM
    (SELECT arm, 'duration' AS metric, duration AS value FROM v_runs WHERE ok UNION ALL SELECT arm, 'relevance_a', relevance_a FROM v_runs WHERE ok UNION ALL SELECT arm, 'relevance_b', relevance_b FROM v_runs WHERE ok) GROUP BY ALL"""
)
def strategy_aggregate(spark, sf):
    r = vw.runs(spark, sf).where("ok").select("arm", "duration", F.col("relevance_a").cast("double").alias("relevance_a"), F.col("relevance_b").cast("double").alias("relevance_b"))
    long = r.unpivot(["arm"], ["duration", "relevance_a", "relevance_b"], "metric", "value")
    return long.groupBy("arm", "metric").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("most"), F.count("value").alias("n"))


# --- Verdicts and streams --------------------------------------------------------------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT doc_id, score AS entailment, (1 - score) * 0.6::DOUBLE AS contradiction, (1 - score) * (CASE WHEN doc_id % 10 = 0 THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END) AS neutral FROM v_verdicts)
    SELECT doc_id, floor(entailment * 10000 + 0.0000001::DOUBLE) / 10000 AS shown, entailment BETWEEN 0 AND 1 AND contradiction BETWEEN 0 AND 1 AND neutral BETWEEN 0 AND 1 AND abs(entailment + contradiction + neutral - 1) <= 0.02::DOUBLE AS valid,
    CASE WHEN contradiction >= 0.5 THEN 'contradicted' WHEN entailment < 0.05 THEN 'unrelated' ELSE 'undecided' END AS diagnosis FROM s"""
)
def verdict_diagnostics(spark, sf):
    s = vw.verdicts(spark, sf).select("doc_id", F.col("score").alias("entailment"), ((1 - F.col("score")) * 0.6).alias("contradiction"), ((1 - F.col("score")) * F.when(F.col("doc_id") % 10 == 0, 0.5).otherwise(0.4)).alias("neutral"))
    each = [F.col(c) for c in ("entailment", "contradiction", "neutral")]
    valid = F.abs(each[0] + each[1] + each[2] - 1) <= 0.02
    for c in each:
        valid = valid & c.between(0, 1) & ~F.isnan(c)
    diagnosis = F.when(each[1] >= 0.5, "contradicted").when(each[0] < 0.05, "unrelated").otherwise("undecided")
    return s.select("doc_id", (F.floor(each[0] * 10000 + 1e-7) / 10000).alias("shown"), valid.alias("valid"), diagnosis.alias("diagnosis"))


@query("SELECT doc_id, max(CASE WHEN label = 'supported' THEN value END) AS supported, max(CASE WHEN label = 'guards' THEN value END) AS guards FROM (SELECT doc_id, 'supported' AS label, score AS value FROM v_verdicts UNION ALL SELECT doc_id, 'guards', CASE WHEN guards_passed THEN 1::DOUBLE ELSE 0 END FROM v_verdicts) GROUP BY 1")
def score_pivot(spark, sf):
    v = vw.verdicts(spark, sf).select("doc_id", F.col("score").alias("supported"), F.col("guards_passed").cast("int").cast("double").alias("guards"))
    long = v.unpivot(["doc_id"], ["supported", "guards"], "label", "value")
    return long.groupBy("doc_id").pivot("label", ["supported", "guards"]).agg(F.max("value"))


@query(
    """WITH g AS (SELECT user_id, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap, event_type FROM events)
    SELECT user_id, count(*) FILTER (gap > INTERVAL 1 DAY) AS silences, bool_or(event_type = 'purchase') AND bool_or(event_type = 'view') AS complete, count(DISTINCT event_type) AS kinds FROM g GROUP BY 1"""
)
def stream_gaps(spark, sf):
    e = vw.table(spark, sf, "events")
    at = measure.seconds(F.col("ts"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.withColumn("gap", at - F.lag(at).over(w))
    has = lambda kind: F.bool_or(F.col("event_type") == kind)
    return rows.groupBy("user_id").agg(F.count_if(F.col("gap") > 86400).alias("silences"), (has("purchase") & has("view")).alias("complete"), F.count_distinct("event_type").alias("kinds"))


@query("SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS is_first, json_extract_string(props, '$.' || (json_keys(props))[1]) AS first_prop FROM events")
def event_lifecycle(spark, sf):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    first = F.expr("get_json_object(props, concat('$.', json_object_keys(props)[0]))")
    return vw.table(spark, sf, "events").select("event_id", "user_id", "event_type", (F.row_number().over(w) == 1).alias("is_first"), first.alias("first_prop"))


@query(
    f"""WITH l AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 0)) AS lines, CAST(len(regexp_extract_all(lower(text), '([a-z]+)')) AS INT) AS words FROM documents)
    SELECT doc_id, CAST(lines AS INT) AS lines, words, length({vw.spaced_sql("text")}) BETWEEN 10 AND 300 AS valid_query FROM l JOIN documents USING (doc_id)"""
)
def query_validation(spark, sf):
    d = vw.table(spark, sf, "documents")
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0))
    return d.select("doc_id", lines.alias("lines"), F.size(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("words"), F.length(tx.one_spaced(F.col("text"))).between(10, 300).alias("valid_query"))


@query(f"SELECT doc_id, {'len(list_filter(regexp_extract_all(lower(text), chr(91) || ' + chr(39) + 'a-z]+' + chr(39) + '), lambda w: w IN (' + ', '.join(repr(w) for w in lx.FUNCTION_WORDS) + ')))'} AS function_words FROM documents")
def function_words(spark, sf):
    found = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1), lambda w: w.isin(*lx.FUNCTION_WORDS))
    return vw.table(spark, sf, "documents").select("doc_id", F.size(found).cast("long").alias("function_words"))
