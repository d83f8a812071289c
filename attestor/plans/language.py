"""Named queries of the wording functions. Every turn of the conversations gets a case by its ids, with a subject of its own set in; the SQL holds what each case must give, written by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import lexicon as lx
from attestor.functions import matching, wording
from attestor.operators import gate
from attestor.plans.queries import query
from attestor.sources import views as vw

_DIGITS, _LETTERS = "0123456789", "bcfghjkmpq"
_TURNS = "t AS (SELECT conv_id, turn, (conv_id * 3 + turn) % {n} AS n, 'zeta' || translate(conv_id::VARCHAR, '" + _DIGITS + "', '" + _LETTERS + "') AS z FROM conversations)"


def with_cases(spark, sf: str, cases: list[tuple], schema: str) -> DataFrame:
    """conv_id, turn and the columns of the turn's case; `{z}` in them stands for the turn's subject."""
    table = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "n int, " + schema)  # as many rows as there are cases
    turns = vw.table(spark, sf, "conversations").select("conv_id", "turn", ((F.col("conv_id") * 3 + F.col("turn")) % len(cases)).cast("int").alias("n"), F.concat(F.lit("zeta"), F.translate(F.col("conv_id").cast("string"), _DIGITS, _LETTERS)).alias("z"))
    met = turns.join(F.broadcast(table), "n")

    def filled(name: str, kind: str) -> Column:
        if kind == "string":
            return F.replace(F.col(name), F.lit("{z}"), F.col("z")).alias(name)
        return F.transform(name, lambda x: F.replace(x, F.lit("{z}"), F.col("z"))).alias(name) if kind == "array<string>" else F.col(name)

    return met.select("conv_id", "turn", *(filled(n, k) for n, k in table.dtypes if n != "n"))


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "CAST([" + ", ".join(_literal(x) for x in v) + "] AS VARCHAR[])"
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def expected(rows: list[tuple], columns: str) -> str:
    """SQL: conv_id, turn and what the turn's case must give."""
    names = [c.strip() for c in columns.split(",")]
    values = ", ".join(f"({i}, " + ", ".join(_literal(v) for v in r) + ")" for i, r in enumerate(rows))

    def out(k: int, name: str) -> str:
        kinds = {type(r[k]) for r in rows} - {type(None)}
        if list in kinds:
            return f"list_transform({name}, lambda x: replace(x, '{{z}}', z)) AS {name}"
        return f"replace({name}, '{{z}}', z) AS {name}" if kinds == {str} else name

    return f"WITH {_TURNS.format(n=len(rows))}, e AS (SELECT * FROM (VALUES {values}) v(n, {columns})) SELECT conv_id, turn, {', '.join(out(k, n) for k, n in enumerate(names))} FROM t JOIN e USING (n)"


# claim, quote, domain of the source; guards that must fail
GUARD_CASES = [
    ("{z} may reduce latency.", "{z} may reduce latency in some cases.", "example.org", []),
    ("{z} reduces latency by 40%.", "{z} may reduce latency.", "example.org", ["numeric", "hedge"]),
    ("{z} must encrypt backups.", "{z} often encrypts backups.", "example.org", ["modality", "hedge"]),
    ("{z} trains faster with small batches.", "We observed that {z} trains faster with small batches.", "example.org", ["framing"]),
    ("According to the study, {z} trains faster.", "We observed that {z} trains faster.", "example.org", []),
    ("{z} has the lowest latency at 5 ms.", "{z} answers in 5ms.", "example.org", ["ranking"]),
    ("{z} leads to overfitting.", "{z} is associated with overfitting.", "example.org", ["causal"]),
    ("Only {z} can rotate keys.", "{z} can rotate keys.", "example.org", ["exclusivity"]),
    ("{z} lowers cost, and latency fell.", "{z} lowers cost.", "example.org", ["atomicity"]),
    ("{z} is small but slow.", "{z} is small but slow.", "example.org", ["atomicity"]),
    ("NIST requires {z} rotation.", "{z} rotation is recommended.", "vendor.com", ["modality", "attribution"]),
    ("NIST requires {z} rotation.", "{z} rotation is recommended.", "www.nist.gov", ["modality"]),
    ("NIST requires {z} rotation.", "NIST's guide requires {z} rotation.", "vendor.com", []),
    ("NIST requires {z} rotation.", "A NIST-like guide requires {z} rotation.", "nist.gov.example.com", ["attribution"]),
    ("According to Acme Labs, {z} scales.", "{z} scales.", "docs.acmelabs.co.uk", []),
    ("{z} was released. It uses AES-256.", "{z} was released. It uses AES-256.", "example.org", ["atomicity"]),
    ("{z} gives agents memory through checkpoints and recall through stores.", "{z} gives agents memory through checkpoints and recall through stores.", "example.org", []),
    ("{z} is the best choice because of speed.", "{z} wins on speed due to caching.", "example.org", []),
    ("{z} handles 20,000+ rows.", "{z} handles 20000+ rows.", "example.org", []),
    ("{z} generally runs at 99.9%.", "{z} may run at 99.9%.", "example.org", ["modality"]),
    ("", "{z} runs.", "example.org", []),
    ("{z} uses AES-256.", "System A may fail under load. {z} uses AES-256.", "example.org", []),
]


@query(expected([(c[3],) for c in GUARD_CASES], "failed"))
def claim_guards(spark, sf):
    """The guards that refuse a claim, in their order."""
    rows = with_cases(spark, sf, [c[:3] for c in GUARD_CASES], "claim string, quote string, domain string")
    guards = wording.run_guards(F.col("claim"), F.col("quote"), F.col("domain"))
    return rows.select("conv_id", "turn", F.transform(F.filter(guards, lambda g: ~g["passed"]), lambda g: g["name"]).alias("failed"))


# text; compound reasons, markers, sentences, propositions
CLAUSE_CASES = [
    ("{z} lowers cost, and the cache grows.", ["2 clauses"], [], 1, ["{z} lowers cost", "the cache grows"]),
    ("{z} uses scale, decoder design, and a next-token goal.", [], [], 1, ["{z} uses scale, decoder design, and a next-token goal"]),
    ("{z} is fast; it uses RAM.", ["contrast"], [], 1, ["{z} is fast; it uses RAM"]),
    ("{z} rose, while Redis has fallen.", ["contrast", "2 clauses"], ["clausal"], 1, ["{z} rose", "Redis has fallen"]),
    ("{z} cuts cost while preserving speed, thereby helping.", ["contrast"], ["while preserving", "thereby"], 1, ["{z} cuts cost while preserving speed, thereby helping"]),
    ("{z} works, e.g. in Q1. and the U.S. market.", [], [], 1, ["{z} works, e.g. in Q1. and the U.S. market"]),
    ("{z} stores logs. It is old.", ["2 sentences"], [], 2, ["{z} stores logs. It is old"]),
    ("{z} is a graph of nodes and edges that supports data flow.", [], [], 1, ["{z} is a graph of nodes and edges that supports data flow"]),
    ("{z} improved at high speed.", [], [], 1, ["{z} improved at high speed"]),
    ("{z} failed; the authors say so, because the disk was full.", ["contrast", "2 clauses"], [], 1, ["{z} failed", "the authors say so", "the disk was full"]),
    ("", [], [], 0, []),
]


@query(expected([c[1:] for c in CLAUSE_CASES], "reasons, markers, sentences, parts"))
def claim_clauses(spark, sf):
    rows = with_cases(spark, sf, [c[:1] for c in CLAUSE_CASES], "claim string")
    c = F.col("claim")
    return rows.select("conv_id", "turn", wording.compound_reasons(c).alias("reasons"), wording.compound_markers(c).alias("markers"), wording.sentence_count(c).alias("sentences"), matching.propositions("claim").alias("parts"))


# question, entities; shape, sides, reconciled sides
QUESTION_CASES = [
    ("How does {z} differ from Kafka for streaming?", ["Apache Kafka", "streaming"], "comparison", ["{z}", "Kafka"], ["{z}", "Apache Kafka"]),
    ("What is the difference between {z} and Redis?", [], "comparison", ["{z}", "Redis"], ["{z}", "Redis"]),
    ("{z} vs Redis in production", ["redis"], "comparison", ["{z}", "Redis"], ["{z}", "redis"]),
    ("How do {z}, Kafka, and Redis differ?", [], "comparison", ["{z}", "Kafka", "Redis"], ["{z}", "Kafka", "Redis"]),
    ("{z} versus {z}", [], None, [], []),
    ("Does {z} cause outages?", [], "causal", [], []),
    ("Why does {z} fail?", [], "causal_drivers", [], []),
    ("What are the main reasons {z} fails?", [], "causal_drivers", [], []),
    ("What is the context window size of {z}?", [], "numeric", [], []),
    ("What is the current price of {z}?", [], "numeric", [], []),
    ("How do I install {z}?", [], "procedural", [], []),
    ("Walk me through {z}", [], "procedural", [], []),
    ("Should we adopt {z}?", [], "recommendation", [], []),
    ("When was {z} released?", [], "temporal", [], []),
    ("What are the risks of {z}?", [], "list", [], []),
    ("Name use cases for {z}", [], "list", [], []),
    ("What is {z}?", [], "definition", [], []),
    ("Tell me more about {z}", [], None, [], []),
    ("", [], None, [], []),
]


@query(expected([c[2:] for c in QUESTION_CASES], "shape, sides, named"))
def question_shapes(spark, sf):
    rows = with_cases(spark, sf, [c[:2] for c in QUESTION_CASES], "question string, entities array<string>").withColumn("sides", wording.comparison_sides("question"))
    return rows.select("conv_id", "turn", wording.shape(F.col("question"), F.col("sides")).alias("shape"), "sides", wording.reconciled_sides(F.col("sides"), F.col("entities")).alias("named"))


# text; relation, whether it states causation
RELATION_CASES = [
    ("{z} is a kind of retrieval.", "subtype", False), ("{z} falls under retrieval.", "subtype", False), ("{z} belongs to the cache family.", "subtype", False), ("{z} is equivalent to Redis.", "equivalence", False),
    ("{z} and Redis refer to the same tool.", "equivalence", False), ("{z} is part of the engine.", "component", False), ("{z} consists of layers.", "component", False), ("{z} depends on Java.", "dependency", False),
    ("{z} uses Java.", "dependency", False), ("{z} differs.", "general", False), ("{z} is associated with errors, which causes loss.", "general", False), ("{z} causes errors.", "general", True),
    ("It is unclear whether {z} causes failure.", "general", False), ("Errors are due to {z}.", "general", True), ("{z} gives rise to errors.", "general", True), ("", "general", False),
]


@query(expected([c[1:] for c in RELATION_CASES], "relation, causes"))
def claim_relations(spark, sf):
    rows = with_cases(spark, sf, [c[:1] for c in RELATION_CASES], "claim string")
    return rows.select("conv_id", "turn", wording.relation(F.col("claim")).alias("relation"), wording.states_causation(F.col("claim")).alias("causes"))


_PG = ("What is PostgreSQL?", "definition", ["PostgreSQL"], ["definition"])
_VS = ("Kafka vs Redis", "comparison", ["Kafka", "Redis"], ["direct_contrast", "relationship"])
# claim, slot, evidence, question, type, entities, slots, usable; why not relevant
RELEVANCE_CASES = [
    ("PostgreSQL holds {z}.", "definition", "", *_PG, True, None),
    ("MySQL holds {z}.", "definition", "", *_PG, True, "about MySQL"),
    ("the {z} is small.", "definition", "", *_PG, True, "names no subject"),
    ("the {z} is small.", "definition", "PostgreSQL is small.", *_PG, True, None),
    ("PostgreSQL holds {z}.", "steps", "", *_PG, True, "slot not asked for"),
    ("PostgreSQL holds {z}.", "", "", *_PG, True, None),
    ("PostgreSQL holds {z}.", "definition", "", *_PG, False, "no contract"),
    ("PostgreSQL grew in 2019.", "definition", "", "What was PostgreSQL in 2021?", "definition", ["PostgreSQL"], ["definition"], True, "other period"),
    ("Kafka is a log.", "direct_contrast", "", *_VS, True, "no contrast"),
    ("Kafka is faster than Redis.", "direct_contrast", "", *_VS, True, None),
    ("Kafka is a log.", "relationship", "", *_VS, True, None),
    ("An LLM answers {z}.", "", "", "What is a large language model?", "definition", ["large language model"], ["definition"], True, None),
    ("rotating a key of {z}", "definition", "", "How is it done?", "definition", ["API key rotation"], ["definition"], True, None),
    ("vectors of {z}", "definition", "", "How is it done?", "definition", ["vector database"], ["definition"], True, "names no subject"),
]


@query(expected([c[8:] for c in RELEVANCE_CASES], "fault"))
def claim_relevance(spark, sf):
    rows = with_cases(spark, sf, [c[:8] for c in RELEVANCE_CASES], "claim string, slot string, evidence string, question string, kind string, entities array<string>, slots array<string>, usable boolean")
    return rows.select("conv_id", "turn", wording.relevance(*(F.col(c) for c in ("claim", "slot", "evidence", "question", "kind", "entities", "slots", "usable"))).alias("fault"))


# claim; credited names, label of the domain, named subjects
NAME_CASES = [
    ("According to Acme Labs, {z} scales.", "https://docs.acme.co.uk/x?y", ["Acme Labs"], "acme", ["Acme", "Labs"]),
    ("NIST requires {z} and the WHO says so.", "acme.github.io", ["NIST", "WHO"], "acme", ["NIST", "WHO"]),
    ("They said {z} works.", "host.invalid", [], None, []),
    ("In tests Google Brain found {z} slow.", "a.b.google.com:8080", ["Google Brain"], "google", ["Google", "Brain"]),
    ("Vector databases require memory for {z}.", "com", [], None, []),
    ("the authors found MySQL old. Postgres is not.", "evilnist.gov", [], "evilnist", ["MySQL"]),
]


@query(expected([c[2:] for c in NAME_CASES], "credited, label, subjects"))
def claim_names(spark, sf):
    rows = with_cases(spark, sf, [c[:2] for c in NAME_CASES], "claim string, domain string")
    return rows.select("conv_id", "turn", wording.attributed_entities(F.col("claim")).alias("credited"), wording.registrable_label(F.col("domain")).alias("label"), wording.named_subjects(F.col("claim")).alias("subjects"))


# question, entities, text, subject; groups, whether the text speaks about the subject, shared terms
ALIAS_CASES = [
    ("What is retrieval-augmented generation (RAG) for {z}?", [], "RAG helps", "generation", [["augmented", "generation", "rag", "retrieval", "retrieval-augmented"]], True, 5),
    ("How do models work?", ["large language model", "LLM"], "An LLM answers", "large language model", [["language", "large", "llm", "model"]], True, 0),
    ("How do models work?", ["neural net", "net value"], "value of a net", "neural net", [["net", "neural", "nv", "value", "nn"]], True, 0),
    ("What is {z}?", ["zeta"], "other words", "zeta", [], False, 0),
]


@query(expected([(len(c[4]), c[5], c[6]) for c in ALIAS_CASES], "n_groups, about, shared"))
def alias_terms(spark, sf):
    rows = with_cases(spark, sf, [c[:4] for c in ALIAS_CASES], "question string, entities array<string>, text string, subject string").withColumn("groups", wording.alias_groups(F.col("question"), F.col("entities")))
    both = F.array_intersect(wording.expanded(lx.salient_terms(F.col("question")), F.col("groups")), wording.expanded(lx.salient_terms(F.col("text")), F.col("groups")))
    return rows.select("conv_id", "turn", F.size("groups").alias("n_groups"), wording.speaks_about(F.col("text"), F.col("subject"), F.col("groups")).alias("about"), F.size(both).alias("shared"))


_WHY = "withheld by deterministic guards: "
# original, rewritten, reason, whether all parts are supported; fault, names, repairable, level
REWRITE_CASES = [
    ("{z} must scale.", "{z} may scale.", _WHY + "modality", True, None, ["modality"], True, 1),
    ("{z} may scale.", "{z} must scale.", _WHY + "modality, ranking", True, "stronger", ["modality", "ranking"], True, 4),
    ("{z} scales.", "{z} scales by 5%.", _WHY + "numeric", False, "new number", ["numeric"], False, 3),
    ("{z} scales.", "{z} scales like Kafka.", "below threshold", True, "new subject", [], False, 3),
    ("{z} is related to errors.", "{z} is what causes errors.", _WHY + "causal, numeric", True, "new cause", ["causal", "numeric"], False, 3),
    ("{z} scales.", " {z} scales. ", _WHY + "style", True, "unchanged", ["style"], False, 3),
    ("{z} scales.", "", None, True, "empty", [], False, 3),
]


@query(expected([c[4:] for c in REWRITE_CASES], "fault, guards, repairable, level"))
def claim_rewrites(spark, sf):
    rows = with_cases(spark, sf, [c[:4] for c in REWRITE_CASES], "original string, rewritten string, reason string, supported boolean")
    why, text = F.col("reason"), F.col("rewritten")
    return rows.select("conv_id", "turn", wording.rewrite_fault(F.col("original"), text).alias("fault"), wording.failed_guard_names(why).alias("guards"), wording.is_repairable(why, F.col("supported")).alias("repairable"), wording.modality_level(text).alias("level"))


# claim, quotes, domains, ranks, entailment by part and quote (row-major); parts, supported parts, best quote, failed guards, reason
GATE_CASES = [
    ("{z} cuts cost.", ["{z} cuts cost.", "{z} cuts cost by far."], ["a.org", "b.org"], [1, 3], [0.99, 0.985], 1, 1, 1, [], ""),
    ("{z} cuts cost.", ["{z} may cut cost."], ["a.org"], [1], [0.99], 1, 0, None, ["hedge"], "withheld by deterministic guards: hedge"),
    ("{z} cuts cost.", ["{z} cuts cost."], ["a.org"], [1], [0.5], 1, 0, None, [], "below threshold"),
    ("{z} cuts cost, and the cache grows.", ["{z} cuts cost.", "The cache grows."], ["a.org", "b.org"], [2, 1], [0.99, 0.1, 0.1, 0.99], 2, 2, 0, [], ""),
    ("{z} cuts cost, and the cache grows.", ["{z} cuts cost.", "The cache grows."], ["a.org", "b.org"], [2, 1], [0.99, 0.1, 0.1, 0.2], 2, 1, None, [], "below threshold"),
    ("{z} cuts cost by 40%.", ["{z} cuts cost by 40%.", "{z} cuts cost."], ["a.org", "b.org"], [1, 3], [0.99, 0.99], 1, 1, 0, [], ""),
    ("NIST requires {z}.", ["{z} is required."], ["blog.com"], [1], [0.99], 1, 0, None, ["attribution"], "withheld by deterministic guards: attribution"),
    ("{z} cuts cost.", ["{z} cuts cost."], ["a.org"], [1], [1.5], 1, 0, None, [], "a part has no valid score"),
    ("{z} cuts cost.", [], [], [], [], 1, 0, None, [], "a part has no valid score"),
    ("", ["{z} cuts cost."], ["a.org"], [1], [0.99], 0, 0, None, [], "states nothing"),
]


@query(expected([c[5:] for c in GATE_CASES], "parts, supported_parts, best_quote, failed, reason"))
def verified_claims(spark, sf):
    """The whole gate: propositions, scores by quote, nine guards, the best quote and the reason of a refusal."""
    rows = with_cases(spark, sf, [c[:5] for c in GATE_CASES], "text string, quotes array<string>, domains array<string>, ranks array<int>, scores array<double>").withColumn("claim_id", F.concat_ws("-", "conv_id", "turn"))
    q = rows.select("claim_id", F.posexplode(F.arrays_zip("quotes", "domains", "ranks")).alias("quote_id", "q")).select("claim_id", "quote_id", F.col("q.quotes").alias("quote"), F.col("q.domains").alias("domain"), F.col("q.ranks").alias("rank"), F.lit(0.5).alias("quality"))
    s = rows.select("claim_id", F.size("quotes").alias("n"), F.posexplode("scores").alias("i", "entailment"))
    s = s.select("claim_id", F.floor(F.col("i") / F.col("n")).cast("int").alias("part"), (F.col("i") % F.col("n")).alias("quote_id"), "entailment", F.greatest(1 - F.col("entailment"), F.lit(0.0)).alias("neutral"), F.lit(0.0).alias("contradiction"))
    found = gate.verify(rows.select("claim_id", "text"), q, s)
    return rows.select("claim_id", "conv_id", "turn").join(found, "claim_id").select("conv_id", "turn", F.col("parts").cast("int").alias("parts"), F.col("supported_parts").cast("int").alias("supported_parts"), "best_quote", "failed", "reason")
