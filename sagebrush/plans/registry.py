"""All registered queries of the evidence engine and their SQL."""

from . import documents, evidence, more, round_trips, statistics, tables

QUERIES = {**statistics.QUERIES, **tables.QUERIES, **evidence.QUERIES, **more.QUERIES, **documents.QUERIES, **round_trips.QUERIES}
SQL = {**statistics.SQL, **tables.SQL, **evidence.SQL, **more.SQL, **documents.SQL, **round_trips.SQL}
