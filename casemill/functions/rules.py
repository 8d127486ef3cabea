"""Rule keys such as ``FINRA:3110``: normalising, series, successors, procedural rules."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill import constants as C
from casemill.functions.arrays import split_keys
from casemill.functions.patterns import CITED_RULE_NUMBER, TITLE_NUMBER


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def family_of(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def number_of(key: Column) -> Column:
    """Everything after the first colon; empty when there is none."""
    return F.when(F.contains(key, F.lit(":")), F.substring(key, F.length(family_of(key)) + 2, F.length(key))).otherwise("")


def base_number(rule: Column) -> Column:
    """``3110(a)`` -> 3110, ``6380A`` -> 6380, ``3270.01`` -> 3270."""
    bare = F.regexp_replace(F.substring_index(rule, "(", 1), r"^(\d{4,5})[A-C]", "$1")
    return F.when(bare.rlike(r"^\d{4,5}\.\d{2}$"), F.substring_index(bare, ".", 1)).otherwise(bare)


def without_footnote(family: Column, base: Column) -> Column:
    """A five-digit number outside the family's ranges is a four-digit rule and a footnote digit."""
    five = base.rlike(r"^\d{5}$")
    value = base.try_cast("int")
    outside = F.lit(False)
    for name, (low, high) in C.FIVE_DIGIT_RANGES.items():
        outside = outside | ((family == name) & five & ~value.between(low, high))
    return F.when(outside, F.substring(base, 1, 4)).otherwise(base)


def home_rulebook(family: Column, base: Column) -> Column:
    """Move a number that exists in only one of the two rulebooks to that rulebook."""
    return (F.when((family == "FINRA") & base.isin(*C.NASD_ONLY), "NASD")
            .when((family == "NASD") & base.isin(*C.FINRA_ONLY), "FINRA")
            .otherwise(family))


def normalise_rule(family: Column, rule: Column) -> Column:
    """``struct<family, base>`` of a rule as written."""
    base = without_footnote(family, base_number(rule))
    return F.struct(home_rulebook(family, base).alias("family"), base.alias("base"))


def leading_number(rule: Column) -> Column:
    """The number a rule starts with (``IM-`` allowed), or null."""
    return F.nullif(F.regexp_extract(rule, r"^(?:IM-)?(\d+)", 1), F.lit("")).try_cast("int")


def series_label(key: Column) -> Column:
    """``FINRA:3110`` -> ``FINRA:3000``; families other than FINRA and NASD stand for themselves."""
    family = family_of(key)
    thousands = F.floor(leading_number(number_of(key)) / 1000) * 1000
    return (F.when(family.isin("FINRA", "NASD") & thousands.isNotNull(),
                   F.concat(family, F.lit(":"), thousands.cast("string")))
            .otherwise(family))


def citation_series(key: Column) -> Column:
    """As ``series_label``, but null outside the FINRA and NASD rulebooks."""
    return F.when(family_of(key).isin("FINRA", "NASD"), series_label(key))


def successor(key: Column) -> Column:
    """``NASD:3010`` -> ``FINRA:3110``; a NASD rule with no successor keeps its key."""
    moved = F.get(F.array(F.try_element_at(literal_map(C.NASD_SUCCESSOR), number_of(key))), F.lit(0))
    return F.when((family_of(key) == "NASD") & moved.isNotNull(), F.concat(F.lit("FINRA:"), moved)).otherwise(key)


def is_procedural(key: Column) -> Column:
    return key.isin(*C.PROCEDURAL_SECTIONS) | key.rlike(r"^FINRA:(?:9\d|01)\d\d$")


def charged_keys(keys: Column) -> Column:
    """Successor keys of a case without the catch-all and procedural rules."""
    moved = F.transform(keys, successor)
    return F.filter(moved, lambda k: (k != C.CATCH_ALL_RULE) & ~is_procedural(k))


def label_series(keys: Column) -> Column:
    """Sorted distinct series labels of an array of rule keys."""
    return F.sort_array(F.array_distinct(F.transform(charged_keys(keys), series_label)))


def rulebook_rules(keys: Column) -> Column:
    """Sorted distinct FINRA rule numbers charged, NASD rules counted as their successors."""
    finra = F.filter(charged_keys(keys), lambda k: k.startswith("FINRA:"))
    return F.sort_array(F.array_distinct(F.transform(finra, lambda k: F.upper(number_of(k)))))


def rulebook_rules_of(joined_keys: Column) -> Column:
    return rulebook_rules(split_keys(joined_keys))


def base_rule(rule_no: Column) -> Column:
    """``3110.05`` -> ``3110``."""
    return F.substring_index(F.upper(rule_no), ".", 1)


def rule_number_in(text: Column) -> Column:
    """The first rule number named in a string, or an empty string."""
    return F.regexp_extract(F.upper(F.coalesce(text, F.lit(""))), CITED_RULE_NUMBER, 0)


def rulebook_part(rule_no: Column) -> Column:
    number = F.coalesce(leading_number(rule_no), F.lit(0))
    part = None
    for below, name in C.RULEBOOK_PARTS:
        if below is None:
            part = part.otherwise(name)
        else:
            part = F.when(number < below, name) if part is None else part.when(number < below, name)
    return part


def is_conduct_rule(rule_no: Column) -> Column:
    return rulebook_part(rule_no) == C.RULEBOOK_PARTS[0][1]


def above_numbering(key: Column) -> Column:
    """Whether a FINRA or NASD number is above the highest that exists."""
    value = leading_number(number_of(key))
    high = F.lit(False)
    for family, limit in C.HIGHEST_RULE.items():
        high = high | ((family_of(key) == family) & F.coalesce(value > limit, F.lit(False)))
    return high


def clean_title(title: Column) -> Column:
    """``'3110. Supervision'`` -> ``'supervision'``."""
    text = F.regexp_replace(F.coalesce(title, F.lit("")), TITLE_NUMBER, "")
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.lower(F.rtrim(text, F.lit(".")))
