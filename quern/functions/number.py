"""Scalar functions on numbers: each takes and gives column expressions, all inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | int | float


def c(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def truth(x: Num) -> Column:
    return c(x).cast("double") != 0


def _error(why: str, kind: str = "double") -> Column:
    return F.raise_error(F.lit(why)).cast(kind)


def div(x: Num, y: Num) -> Column:
    """A zero divisor is an error, for floats too."""
    return c(x) / c(y)


def safe_div(x: Num, y: Num) -> Column:
    return F.try_divide(c(x), c(y))


def log(x: Num, base: Num | None = None) -> Column:
    """Natural, or to a base. Zero is an error; negative numbers give NaN."""
    x = c(x).cast("double")
    nat = lambda v: F.when(v == 0, _error("logarithm of zero")).when(v < 0, F.lit(float("nan"))).otherwise(F.ln(v))
    return nat(x) if base is None else nat(x) / nat(c(base).cast("double"))


def rounded(x: Num, digits: int = 0) -> Column:
    """Half away from zero."""
    return F.round(c(x), digits)


UNARY = {
    "abs": lambda x: F.abs(c(x)), "exp": lambda x: F.exp(c(x)), "ln": lambda x: log(x), "round": rounded, "not": lambda x: ~truth(x), "neg": lambda x: -c(x), "sqrt": lambda x: F.sqrt(c(x)),
    "sin": lambda x: F.sin(c(x)), "asin": lambda x: F.asin(c(x)), "sinh": lambda x: F.sinh(c(x)), "asinh": lambda x: F.asinh(c(x)),
    "cos": lambda x: F.cos(c(x)), "acos": lambda x: F.acos(c(x)), "cosh": lambda x: F.cosh(c(x)), "acosh": lambda x: F.acosh(c(x)),
    "tan": lambda x: F.tan(c(x)), "atan": lambda x: F.atan(c(x)), "tanh": lambda x: F.tanh(c(x)), "atanh": lambda x: F.atanh(c(x)),
    "real": lambda x: c(x), "imag": lambda x: F.when(c(x).isNotNull(), F.lit(0.0)),
}
BINARY = {
    "add": lambda x, y: c(x) + c(y), "sub": lambda x, y: c(x) - c(y), "mul": lambda x, y: c(x) * c(y), "div": div, "mod": lambda x, y: c(x) % c(y), "pow": lambda x, y: F.pow(c(x), c(y)), "log": log,
    "and": lambda x, y: truth(x) & truth(y), "or": lambda x, y: truth(x) | truth(y), "xor": lambda x, y: truth(x) != truth(y),
    "gt": lambda x, y: c(x) > c(y), "ge": lambda x, y: c(x) >= c(y), "lt": lambda x, y: c(x) < c(y), "le": lambda x, y: c(x) <= c(y), "eq": lambda x, y: c(x).eqNullSafe(c(y)), "ne": lambda x, y: ~c(x).eqNullSafe(c(y)),
    "max": lambda x, y: F.greatest(c(x), c(y)), "min": lambda x, y: F.least(c(x), c(y)),
}
COMPARISONS = frozenset("gt ge lt le eq ne".split())
LOGICAL = frozenset("and or xor".split())

# Bounds of the integer types.
BOUNDS = {"i16": (-(2**15), 2**15 - 1), "i32": (-(2**31), 2**31 - 1), "i64": (-(2**63), 2**63 - 1), "u8": (0, 2**8 - 1), "u16": (0, 2**16 - 1), "u32": (0, 2**32 - 1), "u64": (0, 2**64 - 1)}


# -- complex numbers: struct<re, im>


def cx(re: Num, im: Num = 0.0, wide: bool = True) -> Column:
    kind = "double" if wide else "float"
    return F.struct(c(re).cast(kind).alias("re"), c(im).cast(kind).alias("im"))


def c_add(a: Column, b: Column) -> Column:
    return cx(a["re"] + b["re"], a["im"] + b["im"])


def c_sub(a: Column, b: Column) -> Column:
    return cx(a["re"] - b["re"], a["im"] - b["im"])


def c_mul(a: Column, b: Column) -> Column:
    return cx(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def c_div(a: Column, b: Column) -> Column:
    n = b["re"] * b["re"] + b["im"] * b["im"]
    return cx((a["re"] * b["re"] + a["im"] * b["im"]) / n, (a["im"] * b["re"] - a["re"] * b["im"]) / n)


def c_abs(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def c_angle(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def c_conj(a: Column) -> Column:
    return cx(a["re"], -a["im"])


def c_exp(a: Column) -> Column:
    return cx(F.exp(a["re"]) * F.cos(a["im"]), F.exp(a["re"]) * F.sin(a["im"]))


def c_ln(a: Column) -> Column:
    return cx(F.ln(c_abs(a)), c_angle(a))


def c_pow(a: Column, n: Num) -> Column:
    """To a real power, by modulus and angle."""
    r, t = F.pow(c_abs(a), c(n)), c_angle(a) * c(n)
    return cx(r * F.cos(t), r * F.sin(t))


C_UNARY = {"abs": c_abs, "angle": c_angle, "conj": c_conj, "exp": c_exp, "ln": c_ln, "real": lambda a: a["re"], "imag": lambda a: a["im"], "norm": c_abs}
C_BINARY = {
    "add": c_add, "sub": c_sub, "mul": c_mul, "div": c_div,
    "eq": lambda a, b: (a["re"] == b["re"]) & (a["im"] == b["im"]), "ne": lambda a, b: (a["re"] != b["re"]) | (a["im"] != b["im"]),
    "gt": lambda a, b: c_abs(a) > c_abs(b), "ge": lambda a, b: c_abs(a) >= c_abs(b), "lt": lambda a, b: c_abs(a) < c_abs(b), "le": lambda a, b: c_abs(a) <= c_abs(b),
}
