"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from plumbline.llm import collocations, decontaminate, fmindex, html, langid, mixing, pii, pseudolikelihood, quality, simhash, suffixes, warc, whitening

MODULES = [pseudolikelihood, quality, fmindex, simhash, langid, html, decontaminate, mixing, suffixes, warc, whitening, pii, collocations]


def queries() -> dict:
    return {name: run for m in MODULES for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
