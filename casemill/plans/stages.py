"""The jobs end to end: each reads stored tables of a folder, builds one plan per output, and replaces a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill import constants as C
from casemill import schemas
from casemill.functions import documents as DF
from casemill.functions import rules as R
from casemill.operators import answers, bm25, bootstrap, chunks, classifier, documents, fusion, labels, metrics, ordering
from casemill.sources import files
from casemill.sources.session import written
from casemill.sources.tables import append_runs, load_table, optional_table, replace_table


class Tables:
    """Where the tables of one workspace are stored."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str, where=None) -> DataFrame:
        return load_table(self.spark, self.path(name), where)

    def read_or_empty(self, name: str, schema) -> DataFrame:
        return optional_table(self.spark, self.path(name), schema)

    def replace(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
        replace_table(df, self.path(name), partition_by)
        return self.read(name)


def parse_reports(t: Tables) -> DataFrame:
    """raw.reports (report_url, text) -> raw.monthly_cases."""
    rows = documents.monthly_cases(documents.with_report_month(t.read("raw.reports")))
    return t.replace(rows.select(*schemas.MONTHLY_CASES.names), "raw.monthly_cases")


def label_documents(t: Tables) -> DataFrame:
    """raw.documents (case_no, doc_url, action_date, text) -> raw.case_document_labels, one row per report case."""
    found = documents.case_document_labels(t.read("raw.documents"))
    cases = t.read("raw.monthly_cases").select("case_no")
    rows = cases.join(found, "case_no", "left").select(
        "case_no", "doc_url", F.coalesce("doc_rules", F.lit("")).alias("doc_rules"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.when(F.col("n_docs") > 0, 200).otherwise(0).alias("search_status"))
    return t.replace(rows, "raw.case_document_labels")


def label_scans(t: Tables) -> DataFrame:
    """raw.scans (case_no, doc_url, action_date, text read by OCR) -> raw.case_ocr_labels, only for cases without a rule."""
    wanted = labels.cases_needing_ocr(t.read("raw.monthly_cases"), t.read("raw.case_document_labels"))
    rows = documents.case_document_labels(t.read("raw.scans").join(wanted, "case_no", "left_semi"), rules="ocr_rules")
    return t.replace(rows.select(*schemas.OCR_LABELS.names), "raw.case_ocr_labels")


def build_dataset(t: Tables, min_cases: int = C.MIN_SERIES_CASES, **years) -> DataFrame:
    """-> model.dataset, partitioned by split so that a split is read alone."""
    cases = t.read("raw.monthly_cases")
    ocr = t.read_or_empty("raw.case_ocr_labels", schemas.OCR_LABELS)
    found = labels.case_labels(cases, t.read("raw.case_document_labels"), ocr)
    return t.replace(labels.build_dataset(cases, found, min_cases, **years), "model.dataset", ["split"])


def extract_facts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """raw.case_document_labels and raw.documents -> model.facts; also returns the funnel."""
    kept = t.read("raw.case_document_labels").select("case_no", "doc_url")
    texts = t.read("raw.documents").select("case_no", "doc_url", "text").join(kept, ["case_no", "doc_url"], "left_semi")
    rows = written(documents.facts_rows(t.read("model.dataset"), texts))
    return t.replace(documents.facts_table(rows), "model.facts"), documents.facts_funnel(rows)


def train_baseline(t: Tables, split: str = "validation") -> DataFrame:
    """TF-IDF and one logistic regression per label on the training split -> model.predictions of another split."""
    train = t.read("model.dataset", F.col("split") == "train")
    classes = labels.collected_classes(train)
    features = classifier.fit_tfidf(train, "case_no", "masked_text")
    names = {f"label_{i}": c for i, c in enumerate(classes)}  # column names without punctuation
    have = F.split("labels", r"\|")
    vectors = features.vectors(train, "case_no", "masked_text").select(
        "features", *[F.array_contains(have, c).cast("int").alias(n) for n, c in names.items()])
    models = classifier.fit_labels(vectors, list(names), features.size)
    scored = t.read("model.dataset", F.col("split") == split)
    p = classifier.predict_labels(models, features.vectors(scored, "case_no", "masked_text"), "case_no", "baseline")
    p = p.withColumn("series", F.element_at(R.literal_map(names), F.col("series")))
    return t.replace(p.join(labels.binarized(scored, classes), ["case_no", "series"]).select(*schemas.PREDICTIONS.names), "model.predictions")


def score_predictions(t: Tables, reps: int = 2000) -> dict[str, DataFrame]:
    """Scores, calibration and bootstrap intervals of model.predictions."""
    rows = t.read("model.predictions")
    scores = metrics.class_scores(rows)
    bins = metrics.reliability(rows)
    return {"classes": scores, "macro": metrics.macro_f1(scores), "reliability": bins,
            "ece": metrics.expected_calibration_error(bins),
            "intervals": bootstrap.intervals(bootstrap.resampled_macro_f1(rows, reps))}


def score_test(t: Tables, models: Sequence[str], reps: int = 2000) -> dict[str, DataFrame]:
    """Scores of several stored models on the same cases, and a wide table of their probabilities -> model.test_predictions.

    ``models`` starts with the one that the others are compared with: the first of three against the other two gives the
    expectations their values. Every model must predict every class.
    """
    rows = t.read("model.predictions", F.col("model").isin(*models))
    odd = [r.series for r in metrics.class_set_mismatches(rows, models).limit(10).collect()]
    if odd:
        raise ValueError(f"not every model predicts {', '.join(odd)}")
    names = [r.series for r in rows.select("series").distinct().orderBy("series").collect()]
    wide = files.long_to_wide(rows, ["case_no"], [f"{m}:{s}" for m in models for s in names])
    contrasts = [(models[0], m) for m in models[1:]]
    resampled = written(bootstrap.resampled_macro_f1(rows, reps))
    intervals = written(bootstrap.intervals(resampled, contrasts))
    gains = F.create_map(*[F.lit(x) for (a, b), name in zip(contrasts, C.EXPECTATIONS) for x in (f"{a} minus {b}", name)])
    named = intervals.select(F.try_element_at(gains, F.col("name")).alias("name"), "value").filter("name is not null")
    macro = metrics.macro_f1(metrics.class_scores(rows))
    return {"macro": macro, "intervals": intervals, "verdicts": metrics.verdicts(named), "wide": t.replace(wide, "model.test_predictions")}


def compare_inputs(t: Tables, whole: str, facts: str, n: int = 300, seed: int = 6, reps: int = 2000) -> DataFrame:
    """Macro-F1 of a model on summaries and on facts, for one seeded sample of the cases that have both, with intervals."""
    rows = t.read("model.predictions", F.col("model").isin(whole, facts))
    both = rows.groupBy("case_no").agg(F.count_distinct("model").alias("n")).filter("n = 2").select("case_no")
    sample = ordering.seeded_sample(both, n, F.xxhash64(F.lit(seed), F.col("case_no")), "case_no")
    shared = written(rows.join(sample, "case_no", "left_semi"))
    return bootstrap.intervals(bootstrap.resampled_macro_f1(shared, reps), [(facts, whole)])


def store_answers(t: Tables, raw: DataFrame) -> DataFrame:
    """New raw answers -> answers; a stored item, model and prompt is not stored again."""
    append_runs(answers.answered(raw), t.path("answers"), ["kind", "item_id", "split", "model", "prompt"])
    return t.read("answers")


def open_judgments(t: Tables, model: str, prompt: str) -> DataFrame:
    """Stored answers that have no judgment under the model and prompt."""
    return answers.to_judge(t.read("answers"), t.read_or_empty("judgments", schemas.JUDGMENTS), model, prompt)


def store_judgments(t: Tables, rows: DataFrame) -> DataFrame:
    """New judgments -> judgments, each once."""
    append_runs(rows.select(*schemas.JUDGMENTS.names), t.path("judgments"), ["item_id", "split", "model", "prompt", "answer_prompt"])
    return t.read("judgments")


def index_rulebook(t: Tables) -> DataFrame:
    """raw.rulebook_pages with page_order -> chunks."""
    return t.replace(chunks.numbered_chunks(t.read("raw.rulebook_pages")), "chunks")


def evaluate_retrievers(t: Tables, split: str = "validation", k: int = C.TOP_K) -> DataFrame:
    """Hit rate and MRR of BM25, vectors and their fusion over the conduct rules.

    Vectors are stored outputs of one embedding model: raw.chunk_vectors (chunk_id, embedding) for every chunk and
    raw.query_vectors (case_no, embedding) for every case of the split; a case without one is not scored by any retriever.
    """
    vectors = t.read("raw.query_vectors").select("case_no", "embedding")
    cases = written(t.read("model.dataset", F.col("split") == split).select(
        "case_no", DF.query_text(F.col("masked_text")).alias("query"), R.rulebook_rules_of(F.col("rules")).alias("gold"))
        .filter(F.size("gold") > 0).join(vectors, "case_no"))
    book = written(t.read("chunks").drop("embedding").join(t.read("raw.chunk_vectors").select("chunk_id", "embedding"), "chunk_id"))
    labels.require_complete(t.read("chunks"), book, "chunk_id")
    text = F.concat_ws(" ", "title", "text")
    scores = written(bm25.search(book.select("chunk_id", text.alias("text")), "chunk_id", F.col("text"), cases, "case_no", F.col("query")))
    lists = {"bm25": fusion.top_rules(scores, book, cases, "case_no", k, conduct_only=True),
             "dense": fusion.dense_rules(book, cases, "case_no", k, conduct_only=True),
             "hybrid": fusion.hybrid_rules(scores, book, cases, "case_no", k, conduct_only=True)}
    ranked = None
    for name, rows in lists.items():
        named = rows.select(F.lit(name).alias("retriever"), "case_no", "rule", "rank")
        ranked = named if ranked is None else ranked.unionByName(named)
    return fusion.hit_rates(fusion.retrieval_hits(ranked, cases.select("case_no", "gold"), "case_no"))


def evaluate_search(t: Tables, split: str = "validation", k: int = C.TOP_K) -> DataFrame:
    """Hit rate and MRR of BM25 over the conduct rules, for the split's cases charged with a Rulebook rule."""
    cases = t.read("model.dataset", F.col("split") == split).select(
        "case_no", DF.query_text(F.col("masked_text")).alias("query"), R.rulebook_rules_of(F.col("rules")).alias("gold")).filter(F.size("gold") > 0)
    book = t.read("chunks")
    text = F.concat_ws(" ", "title", "text")
    scores = bm25.search(book.select("chunk_id", text.alias("text")), "chunk_id", F.col("text"), cases, "case_no", F.col("query"))
    ranked = fusion.top_rules(scores, book, cases, "case_no", k, conduct_only=True).withColumn("retriever", F.lit("bm25"))
    return fusion.hit_rates(fusion.retrieval_hits(ranked, cases.select("case_no", "gold"), "case_no"))
