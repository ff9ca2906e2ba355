"""The query language: tokens, syntax tree, parser."""

from mdframe.lang.parser import parse
from mdframe.lang.tokens import QueryError, tokenize

__all__ = ["QueryError", "parse", "tokenize"]
