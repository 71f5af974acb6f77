"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from stockloom.llm import chat, collocations, decontam, licenses, linededup, mixing, neardup, pieces, quality, runs, secrets, tokencount, toxicity

_MODULES = (secrets, linededup, neardup, licenses, quality, toxicity, mixing, chat, tokencount, decontam, collocations, pieces, runs)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and callable(f) and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE_SQL for m in _MODULES for name in vars(m) if name.startswith("op") and name[2:3].isdigit() and m.ORACLE_SQL}
