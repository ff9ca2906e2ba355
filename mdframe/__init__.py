"""mdframe: a query language over documents and tables, compiled to Spark DataFrames."""

from __future__ import annotations

__all__ = [
    "Engine", "QueryError", "QueryResult", "list_files", "parse", "prefilter", "read_documents", "render", "scalar_functions", "to_csv", "to_json", "to_table", "tokenize", "write_document",
]
__version__ = "0.1.0"


def __getattr__(name: str):
    """Names load on first use, so that Python workers start without the query compiler."""
    if name in ("Engine", "QueryResult"):
        from mdframe import engine

        return getattr(engine, name)
    if name in ("QueryError", "parse", "tokenize"):
        from mdframe import lang

        return getattr(lang, name)
    if name in ("list_files", "read_documents", "write_document"):
        from mdframe.sources import documents

        return getattr(documents, name)
    if name in ("render", "to_csv", "to_json", "to_table"):
        from mdframe.output import formats

        return getattr(formats, name)
    if name == "prefilter":
        from mdframe.plans.analysis import prefilter

        return prefilter
    if name == "scalar_functions":
        from mdframe.functions.scalar import FUNCTIONS

        return FUNCTIONS
    raise AttributeError(name)
