"""Rule checks, fixes and verdicts on answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import rules
from tessera.functions import text as T
from tessera.operators.dictionary import contained
from tessera.operators.retrieval import small


def check_medical(a: Column, medical=rules.MEDICAL_WORDS, advice=rules.ADVICE_WORDS, quoting=rules.QUOTING_WORDS) -> Column:
    """A medical and an advising word, unless a clause is quoted."""
    return T.contains_any(a, medical) & T.contains_any(a, advice) & ~T.contains_any(a, quoting)


def check_regulatory(a: Column, words=rules.REGULATORY_WORDS) -> Column:
    """The first listed word contained, '' if none."""
    return F.coalesce(T.first_contained(a, words), F.lit(""))


def check_denigration(a: Column, patterns=rules.DENIGRATION) -> Column:
    """C3"""
    return T.matches_any(a, patterns)


def check_citation(a: Column, amounts=rules.AMOUNTS, citations=rules.CITATIONS) -> Column:
    """C4: true where an amount stands without a citation."""
    return T.matches_any(a, amounts) & ~T.matches_any(a, citations)


def violations(a: Column, intent: Column, cited=rules.CITED_INTENTS, **lists) -> Column:
    """The rules broken, in the order medical_advice, regulatory_word:…, denigration, amount_no_citation."""
    word = check_regulatory(a, *lists.get("regulatory", ()))
    return F.array_compact(F.array(
        F.when(check_medical(a, *lists.get("medical", ())), F.lit("medical_advice")),
        F.when(word != "", F.concat(F.lit("regulatory_word:"), word)),
        F.when(check_denigration(a, *lists.get("denigration", ())), F.lit("denigration")),
        F.when(intent.isin(*cited) & check_citation(a, *lists.get("citation", ())), F.lit("amount_no_citation")),
    ))


def verdict(broken: Column, role: Column) -> Column:
    """Customers pass only without any; others fail on a critical one or on two minor ones."""
    critical = F.exists(broken, lambda v: (v == "medical_advice") | v.startswith("regulatory_word:"))
    return F.when(F.size(broken) == 0, True).when(role == "customer", False).when(critical, False).otherwise(F.size(broken) <= 1)


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def apply_fixes(a: Column, broken: Column, medical_note: str, amount_note: str, neutral: str, cut: str = rules.DENIGRATION_CUT) -> Column:
    """Every broken rule's fix, in order; the house's own wording is given by the caller."""

    def step(text, v):
        return (
            F.when(v == "medical_advice", F.concat(rstrip(text), F.lit(medical_note)))
            .when(v.startswith("regulatory_word:"), F.replace(text, F.substring(v, 17, 1000), F.lit("")))
            .when(v == "denigration", F.regexp_replace(text, cut, neutral))
            .when(v == "amount_no_citation", F.concat(rstrip(text), F.lit(amount_note)))
            .otherwise(text)
        )

    return F.aggregate(broken, a, step)


def append_disclaimer(a: Column, broken: Column, role: Column, note: str) -> Column:
    """A clean answer to a customer carries the note."""
    return F.when((F.size(broken) == 0) & (role == "customer"), F.concat(rstrip(a), F.lit(note))).otherwise(a)


def final_answer(passed: Column, modified: Column, original: Column, safe: str) -> Column:
    """C8"""
    return F.when(passed, F.coalesce(modified, original)).otherwise(F.lit(safe))


def phrase_scan(df: DataFrame, phrases: DataFrame, text: str = "text") -> DataFrame:
    """(domain, …) with phrases(domain, kind, phrase): the phrases of each kind that the text contains."""
    hit = contained(df, text, phrases, "phrase", "phrase").join(small(phrases), ["domain", "phrase"])
    return hit.select(*df.columns, "kind", "phrase")
