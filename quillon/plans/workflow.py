"""Literature corpus and workflow queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import payload as P
from quillon.operators import literature as LIT
from quillon.operators import queue as Q
from quillon.operators import relational as R
from quillon.registry import query
from quillon.sources.files import gff_attributes
from quillon.sources.standins import Tables


@query("triage", "SELECT doc_id, CASE WHEN lang = 'en' THEN CASE WHEN quality = 0 THEN 'excluded' ELSE 'included' END WHEN quality = 1 THEN 'included' WHEN length(text) > 1000 THEN 'excluded' ELSE 'needs_full_text' END AS state FROM v_document")
def triage(t: Tables) -> DataFrame:
    q = lambda x: F.coalesce(F.col("quality") == x, F.lit(False))
    state = LIT.triage(F.when(F.col("lang") == "en", "include").otherwise("exclude"), q(0), q(1), F.length("text") > 1000)
    return t.v_document.select("doc_id", state.alias("state"))


@query(
    "family_drift",
    """WITH r AS (SELECT o_orderpriority AS family, arg_max(o_totalprice, struct_pack(d := o_orderdate, k := o_orderkey)) AS hits FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
    SELECT v.family, round(r.hits - v.expected, 2) AS drift FROM (VALUES ('1-URGENT', 1000.0), ('3-MEDIUM', 50000.0), ('9-NONE', 10.0)) v(family, expected) LEFT JOIN r ON r.family = v.family""",
)
def family_drift(t: Tables) -> DataFrame:
    latest = t.orders.where("o_orderstatus <> 'P'").groupBy(F.col("o_orderpriority").alias("family")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))["o_totalprice"].alias("hits"))
    expected = t._spark.createDataFrame([("1-URGENT", 1000.0), ("3-MEDIUM", 50000.0), ("9-NONE", 10.0)], "family string, expected double")
    return expected.join(latest, "family", "left").select("family", F.round(F.col("hits") - F.col("expected"), 2).alias("drift"))


@query(
    "rescreen",
    """WITH d AS (SELECT doc_id, source, lang, text, doc_id % 5 = 0 AS short FROM v_paper JOIN (SELECT doc_id, source, lang FROM documents) x USING (doc_id)),
    m AS (SELECT doc_id, len(regexp_extract_all(lower(text), 'before|holds')) AS mentions, contains(text, 'As before.') AS methods FROM d)
    SELECT doc_id, mentions FROM m WHERE mentions >= 2 AND methods""",
)
def rescreen(t: Tables) -> DataFrame:
    # "As before." stands in the methods, which only papers with them have; "holds" in the abstract or first results
    r = LIT.rescreen(t.v_paper, "text", "before|holds", "As before\\.", 2)
    return r.select("doc_id", F.col("mentions").cast("long").alias("mentions"))


@query(
    "admission_cap",
    """WITH n AS (SELECT lang, count(*) AS n, count(*) FILTER (toxic = 0) AS clean FROM v_document WHERE quality = 1 GROUP BY lang)
    SELECT c.criterion, coalesce(n.n, 0) AS admitted, concat_ws(',', CASE WHEN (SELECT sum(n) FROM n) > 300 THEN 'total' END, CASE WHEN (SELECT sum(clean) FROM n) > 250 THEN 'measurement_bearing' END, CASE WHEN coalesce(n.n, 0) > c.cap THEN 'criterion' END) AS broken
    FROM (VALUES ('en', 150), ('de', 30), ('fr', 99), ('it', 5)) c(criterion, cap) LEFT JOIN n ON n.lang = c.criterion""",
)
def admission_cap(t: Tables) -> DataFrame:
    n = t.v_document.where("quality = 1").groupBy(F.col("lang").alias("criterion")).agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 0).alias("clean"))
    caps = t._spark.createDataFrame([("en", 150), ("de", 30), ("fr", 99), ("it", 5)], "criterion string, cap int")
    total = F.broadcast(n.agg(F.sum("n").alias("total"), F.sum("clean").alias("all_clean")))  # a single row
    j = caps.join(n, "criterion", "left").na.fill(0, ["n"]).crossJoin(total)
    broken = LIT.admission_problems({"total": F.col("total"), "measurement_bearing": F.col("all_clean"), "criterion": F.col("n") - F.col("cap")}, {"total": 300, "measurement_bearing": 250, "criterion": 0})
    return j.select("criterion", F.col("n").alias("admitted"), F.array_join(broken, ",").alias("broken"))


@query(
    "quote_check",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'moved' WHEN 2 THEN 'absent' ELSE 'no_text' END AS verdict, CASE WHEN doc_id % 4 < 2 THEN 10 + length(doc_id::VARCHAR) END AS nearest FROM documents",
)
def quote_check(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 4
    record = t.documents.select("doc_id", F.when(k == 0, 10 + F.length(F.col("doc_id").cast("string"))).otherwise(3).alias("start"), F.when(k == 2, "holds what isn't there").otherwise("of the yield").alias("quote"))
    texts = t.documents.where("doc_id % 4 <> 3").select("doc_id", F.concat(F.lit("Report no "), F.col("doc_id").cast("string"), F.lit("of the yield, as it was.")).alias("text"))
    return LIT.verify_quotes(record, texts, "doc_id", "text", "start", "quote").select("doc_id", "verdict", "nearest")


@query(
    "manual_ingest",
    "SELECT p_partkey AS file, CASE WHEN p_partkey % 4 IN (0, 1) THEN p_partkey END AS paper, CASE p_partkey % 4 WHEN 0 THEN 'stored' WHEN 1 THEN 'title_mismatch' WHEN 2 THEN 'unmatched' ELSE 'ambiguous' END AS verdict FROM part",
)
def manual_ingest(t: Tables) -> DataFrame:
    k, text = F.col("p_partkey"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    papers = t.part.select(k.alias("paper"), text("10.1/", k).alias("doi"), F.lit("shared").alias("slug"), F.lit("Furnace isobutanol titration protocol").alias("title"))
    opening = F.when(k % 4 == 0, "a furnace for isobutanol: titration").otherwise("something else entirely")
    files = t.part.select(k.alias("file"), F.when(k % 4 < 2, text("10.1/", k)).alias("doi"), F.when(k % 4 == 3, "SHARED").alias("slug"), opening.alias("opening"))
    return LIT.match_files(files, papers, ["doi", "slug"], 0.5)


@query(
    "screening_install",
    "SELECT CASE WHEN o_custkey % 5 = 0 THEN 'no_such_publication' WHEN o_orderstatus = 'O' AND o_custkey % 3 = 0 THEN 'kept_human_verdict' ELSE 'written' END AS outcome, count(*) AS n FROM orders GROUP BY 1",
)
def screening_install(t: Tables) -> DataFrame:
    key = F.concat(F.lit("Doi:"), F.col("o_custkey").cast("string"))
    kind = F.when(F.col("o_orderstatus") == "O", "model").otherwise("human")
    new = t.orders.select(key.alias("publication_id"), F.lit("include").alias("decision"), kind.alias("decided_by_kind"), F.col("o_orderdate").alias("decided_at"))
    known = t.orders.where("o_custkey % 5 <> 0").select(key.alias("publication_id"))
    held = t.orders.where("o_custkey % 3 = 0").select(F.lower(key).alias("publication_id"), F.lit("exclude").alias("decision"), F.lit("human").alias("decided_by_kind"), F.col("o_orderdate").alias("decided_at")).dropDuplicates(["publication_id"])
    return Q.install_decisions(held, new, known, "publication_id")[1]


@query(
    "publication_findings",
    "SELECT o_custkey, count(*) AS findings, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey",
)
def publication_findings(t: Tables) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string"))
    return t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("findings"), F.array_join(ids, ",").alias("ids"))


@query("search_publications", "SELECT DISTINCT d.doc_id, d.year FROM v_document d JOIN labels l ON l.doc_id = d.doc_id WHERE d.text ILIKE '%license%' AND d.year >= 1995")
def search_publications(t: Tables) -> DataFrame:
    d = t.v_document.where((F.col("year") >= 1995) & R.contains_any("license", "text"))
    return d.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "year").distinct()


@query("dedupe_checksum", "SELECT doc_id, owner, doc_id <> owner AS refused FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS owner FROM documents) x")
def dedupe_checksum(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    owner = d.groupBy("h").agg(F.min("doc_id").alias("owner"))  # summed before the shuffle
    return d.join(owner, "h").select("doc_id", "owner", (F.col("doc_id") != F.col("owner")).alias("refused"))


# ---------------------------------------------------------------- queue and events


@query("claimable", "SELECT task_id FROM v_queue WHERE status = 'pending' OR (status = 'in_progress' AND lease_expires_at <= TIMESTAMP '1997-06-01')")
def claimable(t: Tables) -> DataFrame:
    return t.v_queue.where(Q.claimable(F.lit("1997-06-01").cast("timestamp_ntz"))).select("task_id")


_TASKS = "SELECT task_id, status, priority, created_at, CASE WHEN status = 'in_progress' THEN lease_expires_at END AS lease_expires_at, CASE WHEN status = 'in_progress' THEN concat('w', task_id % 3) END AS claimed_by, concat('c', task_id % 4) AS proposed_by, attempts FROM v_queue"


def _tasks(t: Tables) -> DataFrame:
    return t._spark.sql(_TASKS.replace("v_queue", "{q}"), q=t.v_queue)


@query(
    "queue_claim",
    f"""WITH q AS ({_TASKS}), c AS (SELECT *, row_number() OVER (ORDER BY priority, created_at, task_id) AS turn FROM q WHERE status = 'pending' OR (status = 'in_progress' AND lease_expires_at <= TIMESTAMP '1997-06-01'))
    SELECT q.task_id, CASE WHEN c.turn <= 7 THEN 'in_progress' ELSE q.status END AS status, CASE WHEN c.turn <= 7 THEN 'new' || c.turn ELSE q.claimed_by END AS claimed_by, CASE WHEN c.turn <= 7 THEN TIMESTAMP '1997-06-01 00:30:00' ELSE q.lease_expires_at END AS lease_expires_at,
      q.attempts + CASE WHEN c.turn <= 7 THEN 1 ELSE 0 END AS attempts FROM q LEFT JOIN c ON c.task_id = q.task_id""",
)
def queue_claim(t: Tables) -> DataFrame:
    workers = t._spark.createDataFrame([(f"new{i}",) for i in range(1, 8)] + [(" ",)], "worker_id string")
    tasks, _ = Q.claim(_tasks(t), workers, F.lit("1997-06-01").cast("timestamp_ntz"), 1800, 8)
    return tasks.select("task_id", "status", "claimed_by", "lease_expires_at", "attempts")


@query(
    "queue_release",
    f"""WITH q AS ({_TASKS}), b AS (SELECT *, status = 'in_progress' AND claimed_by = 'w1' AND task_id % 2 = 0 AS back, status = 'in_progress' AND claimed_by = 'w1' AND task_id % 2 = 1 AS beat FROM q)
    SELECT task_id, CASE WHEN back THEN 'pending' ELSE status END AS status, CASE WHEN NOT back THEN claimed_by END AS claimed_by, CASE WHEN beat THEN TIMESTAMP '1999-01-01 00:01:00' WHEN NOT back THEN lease_expires_at END AS lease_expires_at FROM b""",
)
def queue_release(t: Tables) -> DataFrame:
    tasks = _tasks(t)
    ask = tasks.select("task_id", F.lit("w1").alias("worker_id"))
    tasks, _ = Q.heartbeat(tasks, ask.where("task_id % 2 = 1"), F.lit("1999-01-01").cast("timestamp_ntz"), 60)
    tasks, _ = Q.release(tasks, ask.where("task_id % 2 = 0").withColumn("reason", F.lit("can't decide")))
    return tasks.select("task_id", "status", "claimed_by", "lease_expires_at")


@query(
    "queue_decide",
    f"""WITH q AS ({_TASKS}) SELECT task_id, CASE WHEN task_id % 6 = 0 THEN 'no_reason' WHEN task_id % 6 = 1 THEN 'not_human' WHEN status = 'accepted' THEN 'already_resolved' WHEN task_id % 6 < 4 AND proposed_by = 'c2' THEN 'self_review' WHEN task_id % 6 = 3 THEN 'no_payload' END AS refusal,
      CASE WHEN task_id % 6 IN (0, 1) OR status = 'accepted' OR (task_id % 6 < 4 AND proposed_by = 'c2') OR task_id % 6 = 3 THEN status WHEN task_id % 6 = 2 THEN 'accepted' ELSE 'rejected' END AS status FROM q""",
)
def queue_decide(t: Tables) -> DataFrame:
    k, tasks = F.col("task_id") % 6, _tasks(t)
    verdicts = tasks.select("task_id", F.when(k <= 2, "accept").when(k == 3, "edit").otherwise("reject").alias("action"), F.lit("c2").alias("curator"), F.when(k == 1, "agent").otherwise("human").alias("curator_kind"), F.when(k == 0, " ").otherwise("read it").alias("reason"), F.lit(None).cast("string").alias("edited_payload"), F.lit("1999-01-01").cast("timestamp_ntz").alias("decided_at"))
    after, refused = Q.decide(tasks, verdicts)
    return after.join(refused.select("task_id", "refusal"), "task_id", "left").select("task_id", "refusal", "status")


@query(
    "context_write",
    "SELECT p_partkey AS label, unnest(['aeration', 'removal']) AS facet, unnest([p_type, p_brand]) AS value, unnest([false, true]) AS shadow FROM part",
)
def context_write(t: Tables) -> DataFrame:
    writes = t.part.select(F.col("p_partkey").alias("label"), F.create_map(F.lit("aeration"), "p_type", F.lit("removal"), "p_brand").alias("facets"))
    vocabulary = t._spark.createDataFrame([("aeration", True), ("removal", False)], "facet string, has_column boolean")
    return Q.write_contexts(writes, vocabulary, "a curator", "human", "read in the paper")[0]


@query("latest_event_state", "SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS state, count(*) AS events FROM events GROUP BY user_id")
def latest_event_state(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("state"), F.count("*").alias("events"))


@query("latest_turn", "SELECT conv_id, arg_max(role, turn) AS last_role, max(turn) AS turns FROM conversations GROUP BY conv_id")
def latest_turn(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.max(F.struct("turn", "role"))["role"].alias("last_role"), F.max("turn").alias("turns"))


@query(
    "enqueue_idempotent",
    "SELECT o_custkey AS extraction, o_orderpriority AS path, min(o_orderkey) AS task_id, bool_or(o_orderstatus = 'F') AS rejected_before FROM orders GROUP BY o_custkey, o_orderpriority",
)
def enqueue_idempotent(t: Tables) -> DataFrame:
    g = t.orders.groupBy(F.col("o_custkey").alias("extraction"), F.col("o_orderpriority").alias("path"))
    return g.agg(F.min("o_orderkey").alias("task_id"), F.bool_or(F.col("o_orderstatus") == "F").alias("rejected_before"))


@query(
    "context_candidates",
    """WITH r AS (SELECT * FROM v_facet WHERE status IN ('accepted', 'edited')), n AS (SELECT *, CASE WHEN span_start IS NOT NULL THEN count(*) OVER (PARTITION BY publication_id, span_start, span_end) ELSE 0 END AS together FROM r),
    k AS (SELECT *, CASE WHEN together >= 2 THEN 'span:' || span_start || '-' || span_end WHEN strain <> '' THEN 'strain:' || strain ELSE 'facet:' || task_id END AS key,
      CASE WHEN together >= 2 THEN 'same_span' WHEN strain <> '' THEN 'same_strain_as_reported' ELSE 'unattributed' END AS basis FROM n)
    SELECT publication_id, task_id, key, basis, count(*) OVER (PARTITION BY publication_id, key) AS members, facet NOT IN ('purchase', 'click') AS unknown_facet FROM k""",
)
def context_candidates(t: Tables) -> DataFrame:
    return Q.context_groups(t.v_facet, ["purchase", "click"])


@query(
    "review_alternatives",
    "SELECT a.measurement_id, count(DISTINCT b.measurement_id) AS alternatives FROM v_measurement a JOIN v_measurement b ON a.product_id = b.product_id AND a.quantity_kind = b.quantity_kind AND a.value = b.value AND a.unit = b.unit AND a.measurement_id <> b.measurement_id GROUP BY a.measurement_id",
)
def review_alternatives(t: Tables) -> DataFrame:
    key = ["product_id", "quantity_kind", "value", "unit"]
    m = t.v_measurement.select(*key, "measurement_id", "line")
    b = m.select(*key, F.col("measurement_id").alias("other"))
    return m.join(b, key).where("measurement_id <> other").groupBy("measurement_id").agg(F.count_distinct("other").alias("alternatives"))


@query(
    "running_budget",
    "SELECT o_orderkey, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + o_totalprice <= 1000000 AS allowed FROM orders",
)
def running_budget(t: Tables) -> DataFrame:
    return Q.running_budget(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 1000000).select("o_orderkey", "allowed")


@query("budget_trim", "SELECT s_suppkey, 50 AS held, CASE WHEN s_suppkey % 2 = 0 THEN 50 ELSE 25 END AS kept FROM supplier")
def budget_trim(t: Tables) -> DataFrame:
    text = F.to_json(F.struct("s_suppkey", F.array_repeat(F.lit("0123456789"), 50).alias("data"), F.array(F.lit("cited")).alias("contract")))
    b = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, P.within_budget(text, 5000)).otherwise(P.within_budget(text, 512)).alias("b"))
    kept = F.size(F.from_json("b.text", "data array<string>")["data"])
    return b.select("s_suppkey", F.lit(50).alias("held"), kept.alias("kept"))


@query("derive_experiments", "SELECT coalesce(sample_id, -1) AS dataset, count(*) AS samples, count(DISTINCT strain_id) AS strains FROM v_measurement GROUP BY 1")
def derive_experiments(t: Tables) -> DataFrame:
    return t.v_measurement.groupBy(F.coalesce("sample_id", F.lit(-1)).alias("dataset")).agg(F.count("*").alias("samples"), F.count_distinct("strain_id").alias("strains"))


@query("constraint_violations", "SELECT measurement_id, product_id, CASE WHEN value NOT BETWEEN 2 AND 49 THEN 'value_range' ELSE 'discount_range' END AS broken FROM v_measurement WHERE value NOT BETWEEN 2 AND 49 OR discount > 0.09")
def constraint_violations(t: Tables) -> DataFrame:
    bad = ~F.col("value").between(2, 49)
    return t.v_measurement.where(bad | (F.col("discount") > 0.09)).select("measurement_id", "product_id", F.when(bad, "value_range").otherwise("discount_range").alias("broken"))


@query("regen_gene_group", "SELECT lower(p_brand) AS gene_group, count(*) AS members, min(p_partkey) AS anchor FROM part GROUP BY 1")
def regen_gene_group(t: Tables) -> DataFrame:
    return t.part.groupBy(F.lower("p_brand").alias("gene_group")).agg(F.count("*").alias("members"), F.min("p_partkey").alias("anchor"))


@query(
    "gff_parse",
    "SELECT 'p,' || (event_id % 50) AS owner, count(*) AS children, min(event_id * 37 % 1000000) AS start_pos, count(*) * 3 AS refs FROM events GROUP BY 1",
)
def gff_parse(t: Tables) -> DataFrame:
    # an escaped comma in a value, a list, and a tag that stands twice
    text = lambda c: F.col(c).cast("string")
    attributes = F.concat(F.lit("ID=g"), text("event_id"), F.lit(";Parent=p%2C"), (F.col("event_id") % 50).cast("string"), F.lit(";Dbxref=a:1,b:2;Dbxref=c%3B3"))
    line = F.concat_ws("\t", F.lit("chr1"), F.lit("src"), F.lit("gene"), (F.col("event_id") * 37 % 1000000 + 1).cast("string"), F.lit("9"), F.lit("."), F.lit("+"), F.lit("."), attributes)
    cols = F.split(line, "\t")
    g = t.events.select(gff_attributes(F.element_at(cols, 9)).alias("a"), (F.element_at(cols, 4).cast("long") - 1).alias("s"))
    return g.groupBy(F.col("a")["Parent"][0].alias("owner")).agg(F.count("*").alias("children"), F.min("s").alias("start_pos"), F.sum(F.size(F.col("a")["Dbxref"])).alias("refs"))
