"""Queries of the text operators over the driver's tables."""

from __future__ import annotations

from attestra.llm import abuse, confusables, encoding, matching, mixing
from attestra.llm import record_queries as record_queries  # registers its queries
from attestra.llm.registry import LLM
from attestra.session import cut_lineage, table


@LLM.add("p5_found")
def p5_found(spark, folder):
    return confusables.findings(table(spark, folder, "papers")).select("row_id", "field")


@LLM.add("p5_canonical")
def p5_canonical(spark, folder):
    return confusables.canonical_fields(table(spark, folder, "papers"))


@LLM.add("p7_ids")
def p7_ids(spark, folder):
    return encoding.encode_documents(table(spark, folder, "documents"))


def _sized(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "source", "text")
    return cut_lineage(encoding.count_tokens(documents))


@LLM.add("p8_mix")
def p8_mix(spark, folder):
    return mixing.mix(_sized(spark, folder), table(spark, folder, "mix_targets"))


@LLM.add("p8_shares")
def p8_shares(spark, folder):
    sized, targets = _sized(spark, folder), table(spark, folder, "mix_targets")
    return mixing.shares(mixing.mix(sized, targets), sized, targets)


def _scored(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "source", "text")
    return abuse.score(documents, abuse.fit(documents, table(spark, folder, "review_labels")))


@LLM.add("p9_found")
def p9_found(spark, folder):
    return _scored(spark, folder).filter("offensive").select("doc_id")


@LLM.add("p9_scores")
def p9_scores(spark, folder):
    return _scored(spark, folder)


@LLM.add("p9_rates")
def p9_rates(spark, folder):
    return abuse.rates(_scored(spark, folder))


def _matches(spark, folder):
    return matching.matches(table(spark, folder, "bib_records"), table(spark, folder, "papers"))


@LLM.add("p1_found")
def p1_found(spark, folder):
    return _matches(spark, folder).select("paperid", "bib_id")


@LLM.add("p1_matches")
def p1_matches(spark, folder):
    return _matches(spark, folder)
