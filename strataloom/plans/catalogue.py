"""The named queries over the test tables, each with its SQL twin."""

from __future__ import annotations

from strataloom.plans import bundles, documents, events, files, parsing, payloads, sections, star, verdicts

QUERIES = {**events.QUERIES, **documents.QUERIES, **star.QUERIES, **parsing.QUERIES, **payloads.QUERIES, **bundles.QUERIES, **sections.QUERIES, **files.QUERIES, **verdicts.QUERIES}
ORACLE = {**events.ORACLE, **documents.ORACLE, **star.ORACLE, **parsing.ORACLE, **payloads.ORACLE, **bundles.ORACLE, **sections.ORACLE, **files.ORACLE, **verdicts.ORACLE}
