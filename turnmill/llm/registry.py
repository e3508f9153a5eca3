"""All queries of this package and, where SQL can express them, their SQL."""

from turnmill.llm import chat, decontaminate, htmltext, linededup, lm, mixing, quality, simhash, tokens, urlfilter

_MODULES = (quality, tokens, simhash, linededup, mixing, decontaminate, urlfilter, chat, htmltext, lm)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
