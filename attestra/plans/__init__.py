"""Queries over the driver's tables."""


def all_registries():
    from attestra.plans.papers import PAPERS
    from attestra.plans.records import RECORDS
    from attestra.plans.studies import STUDIES

    return [RECORDS, STUDIES, PAPERS]
