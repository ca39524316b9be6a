"""A folder of documents from scan to coverage, as one set of frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom import lexicon as L
from evidloom.functions import patterns as P
from evidloom.functions import text as TX
from evidloom.operators import evaluate, extract, joins, rollup, scoring, vault
from evidloom.sources import artefacts, files, preflight
from evidloom.session import materialize


@dataclass
class FolderResult:
    documents: DataFrame  # one row per file, with status, counts and topics
    findings: DataFrame  # sensitive values, by line
    verdicts: DataFrame  # pass, warn or block per file
    evidence: DataFrame  # scored chunks
    coverage: DataFrame  # per topic
    skipped: DataFrame  # files that were not looked through for sensitive values, or only in part


def run_folder(spark: SparkSession, root: str, topics: dict[str, tuple[str, ...]] | None = None, strict: bool = False) -> FolderResult:
    """Everything about a folder. The parsed texts are written to shared storage once; all else is lazy.

    Findings and verdicts are over the files as they are, not over the parsed texts, which are cut. A file that was not
    looked through has a finding in `skipped`, which counts in its verdict; an image is a warning, as its text is not read.
    """
    topics = L.TOPIC_ALIASES if topics is None else topics
    identity = TX.stable_id("DOC-", [F.col("path"), F.col("sha256")], 12)
    listed = files.scan(spark, root)
    read = materialize(files.read_documents(listed), "documents").withColumn("document_id", identity)
    parsed = read.where("status = 'parsed'")
    scanned = listed.join(read.select("path", "document_id"), "path")
    hidden = preflight.unlisted(spark, root).withColumn("sha256", F.lit("")).withColumn("document_id", identity)
    findings = preflight.findings(scanned, parsed, "document_id")
    skipped = preflight.skipped(scanned, hidden, "document_id")
    counted = findings.unionByName(skipped.select("document_id", F.lit(None).cast("int").alias("line"), "type", "severity", F.col("reason").alias("match")))
    everything = read.select("document_id").unionByName(hidden.select("document_id"))
    verdicts = P.verdicts(counted, everything, "document_id", strict=strict)
    verdicts = verdicts.join(skipped.select("document_id", F.lit(False).alias("scanned")).distinct(), "document_id", "left").withColumn("scanned", F.coalesce("scanned", F.lit(True)))
    chunks = extract.chunks(parsed, "document_id", "text")
    scored = scoring.chunk_scores(chunks, topics=topics)
    documents = evaluate.document_summary(read.drop("text"), chunks, scored, "document_id")
    return FolderResult(documents, findings, verdicts, scored, rollup.topic_coverage(scored, list(topics)), skipped)


@dataclass
class ProductResult:
    folder: FolderResult
    questions: DataFrame  # question_id, question, problem, cluster
    drafts: DataFrame  # what is known for each question
    queue: DataFrame  # drafts that a person has to look at
    missing: DataFrame  # topics without settled evidence
    answers: DataFrame  # the baseline


def run_product(spark: SparkSession, root: str, questionnaire: str, answers: DataFrame, as_of: str, topics: dict[str, tuple[str, ...]] | None = None, strict: bool = False, most: int | None = 300) -> ProductResult:
    """A folder examined, a questionnaire read, and each question drafted from reviewed answers or the folder's evidence.

    answers: cluster, answer_id, review_status, confidence, updated_at, valid_until, refs. A question belongs to the first
    topic, by name, that it mentions, or to `other`. Rows of the questionnaire with a problem are not drafted.
    """
    topics = L.TOPIC_ALIASES if topics is None else topics
    folder = run_folder(spark, root, topics, strict)
    read = TX.bind(artefacts.questionnaire(spark, questionnaire, most=most), "_flat", TX.for_match(F.col("question")))
    hit = F.array_min(F.transform(scoring.topic_hits(F.col("_flat"), topics), lambda t: t["topic"]))
    questions = materialize(read.withColumn("cluster", F.coalesce(hit, F.lit("other"))).drop("_flat"), "questions")
    best = joins.best_answer(answers, ["cluster"])
    evidence = folder.evidence.select(F.explode("topics").alias("cluster"), "confidence").groupBy("cluster").agg(F.max("confidence").alias("confidence"))
    asked = questions.where("problem is null")
    drafts = materialize(vault.drafts(asked.select("question_id", "cluster"), best, evidence, "question_id", as_of), "drafts")
    missing = vault.missing_rows(drafts.select("cluster", "status", "question_id"), evidence.select(F.col("cluster").alias("topic")), list(topics), "question_id")
    return ProductResult(folder, questions, drafts, drafts.where("status <> 'reviewed'"), missing, answers)


STATUSES = ("parsed", "empty", "ocr_required", "unsupported", "error")


def readiness(got: ProductResult) -> DataFrame:
    """(check, ok) of the twelve checks of a run, and a last row `all`."""
    docs, shareable = got.folder.documents, got.drafts.select(F.concat_ws(" ", "question_id", "cluster", "status", "reason").alias("text"))
    counts = docs.agg(F.count("*").alias("documents"), F.count_if(F.col("status").isin(*STATUSES)).alias("statused"), F.countDistinct("document_id").alias("ids"))
    blocked = got.folder.verdicts.agg(F.count_if(F.col("status") == "block").alias("blocked"))
    baseline = got.answers.agg(F.count("*").alias("answers"), F.count_if(F.col("review_status") == "reviewed").alias("reviewed"))
    drafted = got.drafts.agg(F.count("*").alias("drafts"), F.countDistinct("question_id").alias("drafted"))
    asked = got.questions.agg(F.count_if(F.col("problem").isNull()).alias("asked"))
    queue = got.queue.agg(F.count("*").alias("queued"), F.count_if(F.col("status") == "reviewed").alias("settled"))
    missing = got.missing.agg(F.count_if(~F.col("status").isin("missing", "partial")).alias("odd"))
    leaks = shareable.agg(F.count_if(P.has_sensitive(F.col("text"))).alias("leaks"), F.count_if(evaluate.forbidden_claim(F.col("text"), list(L.FORBIDDEN_CLAIMS))).alias("claims"))
    row = counts
    for one in (blocked, baseline, drafted, asked, queue, missing, leaks):
        row = row.crossJoin(one)  # each is one row
    c = F.col
    return evaluate.gate(
        row, preflight_not_blocking=c("blocked") == 0, document_inventory_created=c("documents") > 0, all_files_statused=c("statused") == c("documents"), unsupported_files_do_not_crash=c("statused") == c("documents"),
        evidence_ids_unique=c("ids") == c("documents"), answer_vault_created=c("answers") > 0, baseline_answers_imported=c("reviewed") > 0, questionnaire_draft_created=c("drafts") == c("asked"),
        human_review_queue_created=c("settled") == 0, missing_evidence_report_created=c("odd") == 0, shareable_outputs_redacted=c("leaks") == 0, no_compliance_overclaim=c("claims") == 0,
    )


def inspect(spark: SparkSession, workspace: str) -> DataFrame:
    """(path, length) of the files of a workspace, hidden ones included."""
    top = spark._jvm.org.apache.hadoop.fs.Path(workspace)
    walk = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True)
    out = []
    while walk.hasNext():
        status = walk.next()
        out.append((status.getPath().toString(), status.getLen()))
    return spark.createDataFrame(out, "path string, length long")


def purge(spark: SparkSession, workspace: str, names: list[str], really: bool = False) -> list[str]:
    """Remove the named entries of a workspace; returns those that exist. Without `really` nothing is removed. A name that
    leads out of the workspace is refused."""
    top = spark._jvm.org.apache.hadoop.fs.Path(workspace)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for name in names:
        if not name or name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"{name!r} is not inside the workspace")
        path = spark._jvm.org.apache.hadoop.fs.Path(top, name)
        if system.exists(path):
            found.append(name)
            if really:
                system.delete(path, True)
    return found
