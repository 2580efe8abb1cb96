"""Queries of the core by name, each with the SQL that checks it."""

from quiremill.plans import catalog_queries, edition_queries, line_queries, text_queries

QUERIES = {**text_queries.QUERIES, **catalog_queries.QUERIES, **line_queries.QUERIES, **edition_queries.QUERIES}
SQL = {**text_queries.SQL, **catalog_queries.SQL, **line_queries.SQL, **edition_queries.SQL}
