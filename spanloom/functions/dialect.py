"""The few places where Spark SQL and DuckDB SQL differ, so that an expression can be written once for both.

Expressions are SQL text. Regular expressions keep to what Java and RE2 share: no look-around, no back-references. They
repeat characters and classes freely, but groups only a bounded number of times: Java's matcher recurses for each
repetition of a group, and a long line would overflow its stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space, non-word characters and digits as in Unicode, spelt for both engines.
BLANK = r"\s\x0b\x1c-\x1f\x85\p{Z}"
WS = f"[{BLANK}]"
NW = r"[^\p{L}\p{N}_]"
WORD = r"[\p{L}\p{N}_]"
ND = r"\p{Nd}"

Steps = list[tuple[str, str]]
KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "ints": T.ArrayType(T.IntegerType())}


def struct_of(fields: str) -> T.StructType:
    """A struct type from ``name:type`` words; needs no session, so that executors can import what uses it."""
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in (f.split(":") for f in fields.split())])


class Spark:
    """Spark SQL text."""

    name = "spark"
    string = "string"
    div = "div"

    def __init__(self, stripped: tuple[str, ...] = ()) -> None:
        self.stripped = stripped  # columns that are known to have no blanks around

    def lit(self, s: str) -> str:
        return "r'" + s + "'" if "'" not in s else 'r"' + s + '"'

    def text(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    def sub(self, s: str, pattern: str, to: str = "") -> str:
        for k in range(1, 6):
            to = to.replace(f"\\{k}", f"${k}")
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.text(to)})"

    def has(self, s: str, pattern: str) -> str:
        return f"regexp_like({s}, {self.lit(pattern)})"

    def pick(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({s}, {self.lit(pattern)}, {group})"

    def find_all(self, s: str, pattern: str) -> str:
        return f"regexp_extract_all({s}, {self.lit(pattern)}, 0)"

    def split(self, s: str, pattern: str) -> str:
        return f"split({s}, {self.lit(pattern)}, -1)"

    def keep(self, a: str, test: Callable[[str], str], x: str = "x") -> str:
        return f"filter({a}, {x} -> {test(x)})"

    def each(self, a: str, to: Callable[[str], str], x: str = "x") -> str:
        return f"transform({a}, {x} -> {to(x)})"

    def join(self, a: str, by: str) -> str:
        return f"array_join({a}, {self.text(by)})"

    def size(self, a: str) -> str:
        return f"size({a})"

    def chars(self, s: str) -> str:
        return f"split({s}, '')"

    def sha256(self, s: str) -> str:
        return f"sha2({s}, 256)"

    def half_even(self, x: str, digits: int = 0) -> str:
        return f"bround({x}, {digits})"


class Duck(Spark):
    """DuckDB SQL text."""

    name = "duck"
    string = "varchar"
    div = "//"

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def text(self, s: str) -> str:
        return "(" + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in s.split("\n")) + ")"

    def sub(self, s: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.text(to)}, 'g')"

    def has(self, s: str, pattern: str) -> str:
        return f"regexp_matches({s}, {self.lit(pattern)})"

    def find_all(self, s: str, pattern: str) -> str:
        return f"regexp_extract_all({s}, {self.lit(pattern)})"

    def split(self, s: str, pattern: str) -> str:
        return f"string_split_regex({s}, {self.lit(pattern)})"

    def keep(self, a: str, test: Callable[[str], str], x: str = "x") -> str:
        return f"list_filter({a}, lambda {x}: {test(x)})"

    def each(self, a: str, to: Callable[[str], str], x: str = "x") -> str:
        return f"list_transform({a}, lambda {x}: {to(x)})"

    def join(self, a: str, by: str) -> str:
        return f"array_to_string({a}, {self.text(by)})"

    def size(self, a: str) -> str:
        return f"len({a})"

    def chars(self, s: str) -> str:
        return f"string_split({s}, '')"

    def sha256(self, s: str) -> str:
        return f"sha256({s})"

    def half_even(self, x: str, digits: int = 0) -> str:
        return f"round_even({x}, {digits})"


SPARK, DUCK = Spark(), Duck()


def column(expression: Callable[..., str], *of: str, by: Spark = SPARK) -> Column:
    """A Spark column of an expression function over the named columns."""
    return F.expr(expression(by, *of))


def with_steps(df: DataFrame, steps: Steps) -> DataFrame:
    """``df`` with each step's column, which may use those before it."""
    for name, e in steps:
        df = df.withColumn(name, F.expr(e))
    return df


def nested(relation: str, steps: Steps) -> str:
    """The same over a SQL relation."""
    for name, e in steps:
        relation = f"(select *, {e} as {name} from {relation})"
    return relation
