"""Case documents: sentences, violation labels, facts sections, narrative, diagnosis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill import constants as C
from casemill.functions import patterns as P
from casemill.functions.arrays import collapse_space, let, strip
from casemill.functions.citations import citation_keys, fix_ocr_numbers, leaks, names_a_rule
from casemill.functions.rules import is_procedural


def before_waiver(text: Column) -> Column:
    """The text up to the waiver-of-rights heading."""
    return F.get(F.split(text, P.WAIVER_HEADING, 2), F.lit(0))


def has_waiver(text: Column) -> Column:
    return text.rlike(P.WAIVER_HEADING)


def sentences(text: Column) -> Column:
    """Sentences ended by a period; a period before a digit ("$2.5 million") does not end one.

    A last piece without its own end counts up to its last period, which only a decimal period can be.
    """
    def build(pieces: Column) -> Column:
        ended = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda s: F.concat(s, F.lit(".")))
        tail = F.get(pieces, F.size(pieces) - 1)
        cut = F.substring(tail, F.lit(1), F.length(tail) - F.length(F.substring_index(tail, ".", -1)))
        return F.filter(F.concat(ended, F.array(cut)), lambda s: s != "")
    return let(F.split(text, P.SENTENCE_END), build)


def violation_sentences(text: Column) -> Column:
    """Sentences that state a violation. A decimal tail counts only if the statement precedes its last period."""
    return F.filter(sentences(text), lambda s: s.rlike(P.VIOLATION))


def settlement_sentences(text: Column) -> Column:
    """Violation sentences before the waiver, without waiving and prior-case sentences."""
    return settled(violation_sentences(before_waiver(text)))


def settled(violations: Column) -> Column:
    """The violation sentences that neither waive nor tell of a prior case."""
    return F.filter(violations, lambda s: ~s.rlike(P.WAIVE) & ~s.rlike(P.PRIOR_CASE))


def document_labels(text: Column) -> Column:
    """Citation keys the document's violation sentences charge, in order of first appearance."""
    repaired = fix_ocr_numbers(collapse_space(text))
    keys = let(repaired, lambda t: F.flatten(F.transform(settlement_sentences(t), citation_keys)))
    return F.filter(F.array_distinct(keys), lambda k: ~is_procedural(k))


def review_sentences(text: Column) -> Column:
    """``reviewed`` of a text's part before the waiver."""
    return reviewed(before_waiver(collapse_space(text)))


def reviewed(head: Column) -> Column:
    """Sentences before the waiver that cite a rule or state a violation, for a reader.

    A sentence ends at a period before white space; what stands before a period inside it ("$2." of
    "$2.5 million") is cut, as the hand-check export does.
    """
    def build(pieces: Column) -> Column:
        last = F.size(pieces) - 1
        kept = F.transform(pieces, lambda s, i: F.trim(F.concat(
            F.substring_index(s, ".", -1), F.when(i < last, ".").otherwise(""))))
        return F.filter(kept, lambda s: (s != "") & (names_a_rule(s) | s.rlike(P.VIOLATION_THEN_PERIOD)))
    # a period at the very end leaves an empty last piece
    return let(F.split(head, r"\.(?=\s|$)"), build)


def facts_section(text: Column, max_chars: int | None = None) -> Column:
    """``struct<facts, start>``: the narrative part of a document, or empty strings without a facts heading.

    ``max_chars`` cuts it (the published job uses 20,000); by default it is whole.
    """
    def cut(head: Column) -> Column:
        # a text cut in two has the heading
        def first(found: Column, other: Column) -> Column:
            return let(found, lambda x: F.when(F.size(x["parts"]) > 1, F.struct(
                F.get(x["parts"], F.lit(1)).alias("body"), x["start"].alias("start"))).otherwise(other))

        cuts = F.lit(None).cast("struct<body:string,start:string>")
        for name, pattern in reversed(P.FACTS_HEADINGS):
            cuts = first(F.struct(F.lit(name).alias("start"), F.split(head, pattern, 2).alias("parts")), cuts)
        return let(cuts, lambda c: F.struct(c["body"].alias("body"), F.coalesce(c["start"], F.lit("")).alias("start")))

    def ended(body: Column) -> Column:
        # the match must begin at or after the given offset, so skip that many characters first
        until = rf"(?sU)^(.{{{P.FACTS_END_FROM},}}?)(?:{P.FACTS_END})"

        def to_last_period(kept: Column) -> Column:
            upto = F.substring(kept, F.lit(1), F.length(kept) - F.length(F.substring_index(kept, ".", -1)))
            return F.regexp_replace(F.coalesce(F.nullif(upto, F.lit("")), kept), P.DANGLING_LETTER, "")
        return F.when(body.rlike(until), let(F.regexp_extract(body, until, 1), to_last_period)).otherwise(body)

    def told(body: Column) -> Column:
        parts = F.split(F.regexp_replace(body, P.SUBHEAD, " "), P.NARRATIVE_SPLIT)
        kept = F.filter(parts, lambda s: (s != "") & ~s.rlike(P.STATED) & ~s.rlike(P.SANCTION_SENTENCE))
        whole = strip(F.array_join(kept, " "))
        return whole if max_chars is None else F.substring(whole, 1, max_chars)

    return let(let(before_waiver(collapse_space(text)), cut), lambda s: F.struct(
        F.when(s["body"].isNotNull(), let(ended(s["body"]), told)).otherwise("").alias("facts"),
        s["start"].alias("start")))


def narrative_sentences(masked: Column) -> Column:
    return F.filter(F.split(masked, P.NARRATIVE_SPLIT), lambda s: s != "")


def explains_a_rule(sentence: Column) -> Column:
    """Guidance, or a named rule with a verb of obligation or a quotation."""
    return sentence.rlike(P.GUIDANCE) | (sentence.rlike(P.RULE_REFERENCE) & sentence.rlike(P.EXPLAINS))


def narrative(masked: Column) -> Column:
    """Masked facts without the sentences that quote or explain a rule."""
    return strip(F.array_join(F.filter(narrative_sentences(masked), lambda s: ~explains_a_rule(s)), " "))


def leftover_flags(sentence: Column) -> Column:
    """``struct<sanction, numbered>`` for a sentence of a finished facts text."""
    return F.struct(sentence.rlike(P.SANCTION_LEFT).alias("sanction"),
                    (F.size(leaks(sentence)) > 0).alias("numbered"))


def unlabeled_reason(text: Column) -> Column:
    """Why a document gave no rule; a null text was never fetched."""
    def judge(t: Column) -> Column:
        def diagnose(head: Column) -> Column:
            cites, violates = names_a_rule(head), F.size(violation_sentences(head)) > 0
            return (F.when(cites & ~violates, "no violation").when(violates & ~cites, "no citation")
                    .when(~cites, "neither").otherwise("apart"))
        return F.when(F.length(t) < C.OCR_MIN_CHARS, "no text").otherwise(let(before_waiver(t), diagnose))
    return F.when(text.isNull(), "not cached").otherwise(let(collapse_space(text), judge))


def query_text(summary: Column) -> Column:
    """The conduct in a masked summary: sanction sentences dropped, "findings that X" cut to X."""
    whole = F.coalesce(summary, F.lit(""))
    parts = F.split(strip(collapse_space(whole)), P.QUERY_SENTENCE_SPLIT)
    kept = F.transform(parts, lambda s: F.when(s.rlike(P.QUERY_FINDINGS), F.regexp_extract(s, P.QUERY_FINDINGS, 1))
                       .when(~s.rlike(P.QUERY_SANCTION), s))
    conduct = strip(F.array_join(F.filter(kept, lambda s: s.isNotNull()), " "))
    return F.coalesce(F.nullif(conduct, F.lit("")), whole)
