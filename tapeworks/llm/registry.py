"""Queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from tapeworks.llm import bpe, collocations, contextmix, exact_dedup, forest, html_main, line_dedup, mixing, quality, simhash, sstable, topk, vafile

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (bpe, collocations, contextmix, exact_dedup, forest, html_main, line_dedup, mixing, quality, simhash, sstable, topk, vafile):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
