"""Jobs over case documents, monthly reports and masked summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill import constants as C
from casemill.functions import citations as CT
from casemill.functions import documents as D
from casemill.functions import reports as RP
from casemill.functions import rules as R
from casemill.functions.arrays import collapse_space, cut, joined, let
from casemill.functions.patterns import MIN_TITLE_CHARS
from casemill.functions.spans import offsets
from casemill.operators.ordering import first_with_result, keep_latest
from casemill.sources.session import written
from casemill.sources.tables import tasks


def segment_reports(reports: DataFrame, keep: Sequence[str] = ("report_url", "report_month")) -> DataFrame:
    """One row per case of each report, in report order (``pos``). Narrow: no shuffle."""
    cases = F.transform(RP.case_blocks(RP.clean_report_text(F.col("text"))), lambda c: F.struct(
        c["case_no"].alias("case_no"), RP.parse_block(c["block"]).alias("parsed")))
    flat = F.transform(cases, lambda c: F.struct(
        c["case_no"].alias("case_no"), c["parsed"]["section"].alias("section"),
        c["parsed"]["respondent"].alias("respondent"), c["parsed"]["text"].alias("text")))
    parsed = reports.select(*keep, flat.alias("cases"))
    rows = parsed.select(*keep, F.posexplode(RP.carry_sections(F.col("cases"))).alias("pos", "case"))
    return rows.select(*keep, "pos", "case.*").withColumn("action_date", RP.action_date(F.col("text")))


def monthly_cases(reports: DataFrame) -> DataFrame:
    """Report cases with masked text and cited rules; a case in several reports keeps the latest report's row."""
    cases = keep_latest(segment_reports(reports), ["case_no"], ["report_month", "report_url", "pos"]).drop("pos")
    # the spans serve both the masking and the rules
    both = F.transform(F.array(CT.claimed_spans(F.col("text"))), lambda s: F.struct(
        CT.mask_spans(F.col("text"), s).alias("masked_text"),
        joined(F.array_distinct(CT.keys_of(CT.citations_of(s)))).alias("summary_rules")))
    return cases.select("*", F.inline(both))


def with_report_month(reports: DataFrame) -> DataFrame:
    return reports.withColumn("report_month", RP.report_month(F.col("report_url"), F.col("text")))


def citation_rows(df: DataFrame, text: str = "text", keep: Sequence[str] = ("case_no",)) -> DataFrame:
    """One row per cited rule number with its place in the text."""
    return (df.select(*keep, CT.citations(F.col(text)).alias("found"))
            .select(*keep, F.posexplode_outer("found").alias("pos", "c")).filter(F.col("c").isNotNull())
            .select(*keep, "pos", "c.*").withColumn("key", F.concat("family", F.lit(":"), "base")))


def case_document_labels(documents: DataFrame, text: str = "text", rules: str = "doc_rules") -> DataFrame:
    """Per case the labels of its newest document that yields any; where none does, its last document.

    ``documents`` has case_no, doc_url, action_date and the text. All documents are read in parallel.
    """
    read = documents.select("case_no", "doc_url", "action_date", joined(D.document_labels(F.col(text))).alias(rules))
    newest_first = F.struct((-F.unix_date("action_date")).alias("age"), F.col("doc_url").alias("doc_url"))
    picked = first_with_result(read, "case_no", F.col(rules) != "", newest_first)
    return picked.select("case_no", "doc_url", rules, F.col("n_docs").cast("int").alias("n_docs"))


def leak_audit(df: DataFrame, text: str = "masked_text", key: str = "case_no", around: int = 80) -> DataFrame:
    """Every distinct leak of a masked text with the text around each of its occurrences.

    No row means the masking holds.
    """
    hits = df.select(key, text, F.explode_outer(F.array_distinct(CT.leaks(F.col(text)))).alias("leak"))
    hits = hits.filter(F.col("leak").isNotNull())
    # occurrences of the hit as a plain string, found left to right without overlap
    pieces = F.split(F.col(text), F.concat(F.lit("\\Q"), F.col("leak"), F.lit("\\E")))
    ends = let(pieces, lambda p: F.slice(offsets(p), 2, F.size(p) - 1))  # where the gap before each occurrence ends, without the leaks

    def contexts(between) -> Column:
        def context(gap_end: Column, nth: Column) -> Column:
            start = gap_end + nth * F.length("leak")
            return between(F.greatest(start - around, F.lit(0)), F.least(start + F.length("leak") + around, F.length(text)))
        return F.transform(ends, context)
    # cut inside the row: no row per occurrence carries the text
    return hits.select(key, "leak", F.posexplode(cut(F.col(text), contexts)).alias("nth", "context"))


def titles_in_text(texts: DataFrame, titles: DataFrame, text: str, title: str, keep: Sequence[str]) -> DataFrame:
    """(keep..., title) for every title that occurs in a text as a plain substring, one row per text and title.

    Each title is found by an anchor: of its inner words (with neighbours on both sides, so they stand in the text as
    whole words) the one in the fewest texts, with its place in the title. Texts list their distinct words; anchors
    and words meet on equality, and only for the titles whose anchor a text has is the title itself looked for.
    Titles of fewer than three words have no inner word; their anchor is three neighbouring characters, again those in
    the fewest texts, or the whole title if it is shorter. Words and characters that no title needs never leave their task.
    """
    names = written(titles.select(F.col(title).alias("_title")).filter(F.col("_title").isNotNull()).distinct())
    source = texts.select(*keep, F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    inner = F.split("_title", r"\s+")
    words = F.array_distinct(F.filter(F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0))), lambda w: w != ""))
    width = F.least(F.length("_title"), F.lit(3))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_title") - width + 1), lambda i: F.substring("_title", i, width)))
    parts = F.when(F.size(words) > 0, F.transform(words, lambda w: F.struct(F.lit(0).alias("width"), w.alias("part")))).otherwise(
        F.transform(grams, lambda g: F.struct(width.alias("width"), g.alias("part"))))
    named = names.filter(F.length("_title") > 0).select("_title", F.explode(parts).alias("a")).select("_title", "a.*")
    widths = [r.width for r in named.select("width").distinct().collect()]  # at most 0 to 3

    def pieces(width: int) -> Column:
        if width == 0:
            return F.array_distinct(F.split("_text", r"\s+"))
        # neighbouring characters as matches from each of the first offsets: one pass over the text per offset
        shifted = [F.regexp_extract_all(F.substring("_text", i + 1, F.length("_text")), F.lit(f"(?s).{{{width}}}"), F.lit(0)) for i in range(width)]
        return F.array_distinct(F.concat(*shifted))

    def of_width(width: int) -> Column:
        return F.transform(pieces(width), lambda p: F.struct(F.lit(width).alias("width"), p.alias("part")))
    if not widths:
        found = source.limit(0).select(*keep, F.lit("").alias(title))
    else:
        listed = F.flatten(F.array(*map(of_width, widths)))
        wanted = named.select("width", "part").distinct()
        rows = written(source.withColumn("_row", F.monotonically_increasing_id()))
        places = written(rows.select("_row", F.explode(listed).alias("p")).select("_row", "p.*").join(wanted, ["width", "part"], "left_semi"))
        often = places.groupBy("width", "part").agg(F.count("*").alias("n"))
        # a part that is in no text settles its title: nothing to look for
        anchors = named.join(often, ["width", "part"], "left").groupBy("_title").agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "width", "part")).alias("a")).select("_title", "a.*").filter("n > 0")
        asked = places.join(anchors.select("width", "part", "_title"), ["width", "part"]).select("_row", "_title")
        found = rows.join(asked, "_row").filter(F.contains("_text", F.col("_title"))).select(*keep, F.col("_title").alias(title))
    empty = names.filter(F.length("_title") == 0)  # the empty title is in every text
    return found if empty.isEmpty() else found.unionByName(source.select(*keep, F.lit("").alias(title)))


def title_leaks(texts: DataFrame, titles: DataFrame, text: str, title: str, keep: Sequence[str]) -> DataFrame:
    """Rule titles of twelve or more characters left in a text, ignoring case."""
    lowered = texts.withColumn("_lower", F.lower(text))
    named = titles.select(F.lower(title).alias("title")).filter(F.length("title") >= MIN_TITLE_CHARS)
    return titles_in_text(lowered, named, "_lower", "title", keep)


def rule_titles(pages: DataFrame) -> DataFrame:
    """One cleaned title per base rule: the first page with a title, by rule number."""
    cleaned = pages.select(R.base_rule(F.col("rule_no")).alias("rule"), "rule_no", R.clean_title(F.col("title")).alias("title"))
    return cleaned.filter("title <> ''").groupBy("rule").agg(F.min_by("title", "rule_no").alias("title"))


def title_share(dataset: DataFrame, pages: DataFrame, split: str = "test", min_cases: int = 5):
    """How often a case's text holds the title of a rule it was charged with.

    Returns (overall, by series, by rule). A title's rate among cases not charged with its rule follows from
    its total count, so no case is paired with a rule it was not charged with unless the title is in its text.
    """
    titles = rule_titles(pages)
    text = F.lower(collapse_space(F.coalesce(F.col("masked_text"), F.lit(""))))
    cases = dataset.filter(F.col("split") == split).select(
        "case_no", text.alias("text"), R.rulebook_rules_of(F.col("rules")).alias("rules"))
    charged = written(cases.select("case_no", "text", F.explode("rules").alias("rule")).join(titles, "rule").select(
        "case_no", "rule", "title", F.contains("text", F.col("title")).alias("in_text")))
    per_case = charged.groupBy("case_no").agg(F.max(F.col("in_text").cast("int")).alias("any_title"))
    overall = per_case.agg(F.count("*").alias("scored"), F.avg("any_title").alias("share"))

    series = charged.select("case_no", R.series_label(F.concat(F.lit("FINRA:"), "rule")).alias("series")).distinct()
    by_series = series.join(per_case, "case_no").groupBy("series").agg(
        F.count("*").alias("cases"), F.avg("any_title").alias("with_title"))

    n = cases.agg(F.count("*")).scalar()
    rules = charged.groupBy("rule", "title").agg(
        F.count("*").alias("charged_cases"), F.sum(F.col("in_text").cast("int")).alias("charged_hits")).filter(
        F.col("charged_cases") >= min_cases)
    found = titles_in_text(cases, charged, "text", "title", ["case_no"]).groupBy("title").agg(F.count("*").alias("hits"))
    by_rule = rules.join(found, "title", "left").select(
        "rule", "title", "charged_cases", (F.col("charged_hits") / F.col("charged_cases")).alias("charged"),
        F.try_divide(F.coalesce("hits", F.lit(0)) - F.col("charged_hits"), n - F.col("charged_cases")).alias("not_charged"))
    return overall, by_series, by_rule


def facts_rows(dataset: DataFrame, documents: DataFrame, text: str = "text") -> DataFrame:
    """Every dataset case with its facts text or the reason it has none."""
    # dealt out first, as a table of a few large row groups would be few tasks' work
    docs = documents.select("case_no", F.col(text).alias("_text")).repartition(tasks(documents), "case_no")
    # the text is extracted before the join, so the join moves the short result
    read = docs.withColumn("_s", D.facts_section(F.col("_text"))).select(
        "case_no", F.lit(True).alias("_read"), F.col("_s.start").alias("start"), F.col("_s.facts").alias("_facts"),
        (F.coalesce(F.length("_text"), F.lit(0)) > 0).alias("_some"))
    masked = read.withColumn("_before", CT.mask_citations(F.col("_facts"))).select(
        "case_no", "start", "_some", F.length("_before").alias("chars_before"),
        D.narrative(F.col("_before")).alias("facts_text"))
    rows = dataset.select("case_no", "split").join(masked, "case_no", "left")
    reason = (F.when(~F.coalesce("_some", F.lit(False)), "no document")
              .when(F.col("start") == "", "no facts heading")
              .when(F.length("facts_text") < C.FACTS_MIN_CHARS, f"under {C.FACTS_MIN_CHARS} characters")
              .otherwise("kept"))
    return rows.select("case_no", "split", reason.alias("reason"), "facts_text",
                       F.length("facts_text").alias("chars"), "start", "chars_before")


def facts_table(rows: DataFrame) -> DataFrame:
    return rows.filter("reason = 'kept'").select("case_no", "split", "facts_text", "chars", "start")


def facts_funnel(rows: DataFrame) -> DataFrame:
    """Cases per outcome, and how many were long enough before rule sentences were removed."""
    return rows.groupBy("reason").agg(
        F.count("*").alias("cases"), F.count_if(F.col("chars_before") >= C.FACTS_MIN_CHARS).alias("long_before_filter"))


def leftover_sentences(facts: DataFrame) -> DataFrame:
    """Sentences of finished facts that still mention sanctions or carry a rule number, with their place."""
    parts = F.split(F.col("facts_text"), D.P.NARRATIVE_SPLIT)
    rows = facts.select("case_no", "start", F.posexplode_outer(parts).alias("pos", "sentence"), F.size(parts).alias("n"))
    flagged = rows.withColumn("f", D.leftover_flags(F.col("sentence"))).select(
        "case_no", "start", "pos", "n", "sentence", "f.*")
    return flagged.filter(F.col("sanction") | F.col("numbered")).withColumn("near_end", F.col("pos") >= F.col("n") - 3)


def unlabeled_cases(documents: DataFrame) -> DataFrame:
    """Per case its best document and why no rule came from it; ``documents`` has case_no, doc_url, doc_type, text."""
    order = F.array_position(F.array(*[F.lit(r) for r in C.UNLABELED_ORDER]), F.col("reason"))
    judged = documents.select("case_no", "doc_url", "doc_type", D.unlabeled_reason(F.col("text")).alias("reason"))
    return judged.groupBy("case_no").agg(
        F.min_by(F.struct("reason", "doc_type", "doc_url"), F.struct(order.alias("o"), F.col("doc_url"))).alias("b")
    ).select("case_no", "b.*")


def review_export(check: DataFrame, documents: DataFrame) -> DataFrame:
    """The hand-check sample with each document's citing and violation sentences."""
    head = D.before_waiver(collapse_space(F.col("text")))
    read = documents.select("doc_url", F.length(head).alias("chars_before_waiver"),
                            D.has_waiver(collapse_space(F.col("text"))).alias("waiver_found"),
                            D.review_sentences(F.col("text")).alias("sentences"))
    rows = check.select("case_no", "doc_url", "doc_rules").join(read, "doc_url", "left")
    return rows.withColumn("error", F.when(F.col("sentences").isNull(), "document not read")).withColumn(
        "sentences", F.coalesce("sentences", F.array().cast("array<string>")))


def hand_check_sample(cases: DataFrame) -> DataFrame:
    """The columns of a hand-check sheet, labels prefilled."""
    return cases.filter(F.coalesce("doc_rules", F.lit("")) != "").select(
        "case_no", "doc_url", "doc_rules", F.col("doc_rules").alias("true_rules"), F.lit("").alias("checked"),
        F.lit("").alias("notes"))


