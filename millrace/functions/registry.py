"""SQL names of the dialect's functions. A template is Spark SQL in which {0}, {1}, .. are the arguments and {*} all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REGISTRY: dict[str, dict[int, str]] = {}


def define(name: str, template: str, *arities: int) -> None:
    """Arity -1 stands for any number of arguments."""
    for n in arities or (-1,):
        REGISTRY.setdefault(name, {})[n] = template


def expand(name: str, arguments: list[str]) -> str | None:
    """The Spark SQL of a call, or None if Spark's own function of that name serves."""
    own = REGISTRY.get(name.lower())
    template = own and own.get(len(arguments), own.get(-1))
    if not template:
        return None
    text = template.replace("{*}", ", ".join(arguments))
    for k, a in enumerate(arguments):
        text = text.replace(f"{{{k}}}", f"({a})")
    return f"({text})" if " " in text else text


def sql_of(argument) -> str:
    """SQL text of a column name, a literal or an expression given as text with a leading =."""
    if isinstance(argument, str):
        return argument[1:] if argument.startswith("=") else f"`{argument}`" if "." not in argument else argument
    if argument is None:
        return "NULL"
    if isinstance(argument, bool):
        return str(argument).lower()
    return repr(argument)


def quoted(text: str) -> str:
    """A string literal as an argument of call()."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"='{escaped}'"


def call(name: str, *arguments) -> Column:
    """The dialect's function as a Column: call("left", "name", 3). Texts are columns; quoted() makes literals."""
    own = [sql_of(a) for a in arguments]
    return F.expr(expand(name, own) or f"{name}({', '.join(own)})")
