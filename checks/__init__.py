"""Registered queries over the given tables, each with the SQL it must equal."""

from . import catalog, documents, evidence, pages, requests, stores

ALL = [pages, catalog, documents, requests, evidence, stores]
