"""Exact decimal arithmetic on expressions, as data."""

from __future__ import annotations

import decimal
import re

#: Significant digits, exponent bound, largest numbers of inputs, nodes and characters (expression, number).
DIGITS, EXPONENT, INPUTS, NODES, LENGTH, NUMBER = 28, 256, 16, 64, 512, 64
_TOKEN = re.compile(r"\s*(?:(?P<number>[0-9]+(?:\.[0-9]*)?|\.[0-9]+)|(?P<name>[A-Za-z][A-Za-z0-9_]*)|(?P<sign>[-+*/()]))")
_STATED = re.compile(r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)")
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]{0,31}")
_TIGHTNESS = {"+": 1, "-": 1, "*": 2, "/": 2}
_TRAPS = [decimal.DivisionByZero, decimal.InvalidOperation, decimal.Overflow, decimal.Underflow, decimal.Subnormal]


def _decimal(text: str) -> decimal.Decimal:
    if len(text) > NUMBER or not _STATED.fullmatch(text):
        raise ValueError("numbers are finite decimals of at most 64 characters")
    return decimal.Decimal(text)


def _tokens(expression: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, expression.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError("only decimal numbers, names, + - * / and parentheses are allowed")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def calculate(expression: str, inputs: dict[str, str]) -> dict[str, object]:
    """{result, inexact, rounded} of + - * / and parentheses over decimals and named decimal strings.

    Numbers keep their decimal spelling; each operation and the result round
    half-even to 28 digits, signs are exact.  The result is in fixed notation
    with its trailing zeros.  Anything else in the expression, an unknown name,
    too many inputs, nodes or characters, a zero divisor, and a value or result
    beyond the exponent range raise ValueError; inputs need not be used.
    """
    if not 1 <= len(expression) <= LENGTH or len(inputs) > INPUTS or not all(map(_NAME.fullmatch, inputs)):
        raise ValueError("1 to 512 characters and at most 16 named inputs are allowed")
    values = {name: _decimal(text) for name, text in inputs.items()}
    tokens = _tokens(expression)
    # a name or operation counts twice, as itself and its role
    if sum(1 if kind == "number" else 2 for kind, text in tokens if text not in "()") + 1 > NODES:
        raise ValueError("the expression is too long")
    context = decimal.Context(prec=DIGITS, rounding=decimal.ROUND_HALF_EVEN, Emax=EXPONENT, Emin=-EXPONENT, clamp=0, traps=_TRAPS, flags=[])
    steps = {"+": context.add, "-": context.subtract, "*": context.multiply, "/": context.divide}
    numbers: list[decimal.Decimal] = []
    waiting: list[str] = []  # operators, '(' and the signs 'u+' and 'u-', which bind tightest

    def apply() -> None:
        sign = waiting.pop()
        if sign in ("u+", "u-"):
            numbers.append(numbers.pop().copy_negate() if sign == "u-" else numbers.pop())
        else:
            right, left = numbers.pop(), numbers.pop()
            numbers.append(steps[sign](left, right))

    operand = True  # whether an operand must follow
    try:
        for kind, text in tokens:
            if operand:
                if kind == "number":
                    numbers.append(_decimal(text))
                elif kind == "name" and text in values:
                    numbers.append(values[text])
                elif text in ("+", "-", "("):
                    waiting.append(text if text == "(" else f"u{text}")
                    continue
                else:
                    raise ValueError("an operand is missing or unknown")
                operand = False
            elif text == ")":
                while waiting and waiting[-1] != "(":
                    apply()
                if not waiting:
                    raise ValueError("parentheses do not match")
                waiting.pop()
            elif text in _TIGHTNESS:
                while waiting and waiting[-1] != "(" and _TIGHTNESS.get(waiting[-1], 3) >= _TIGHTNESS[text]:
                    apply()
                waiting.append(text)
                operand = True
            else:
                raise ValueError("an operator is missing")
        if operand or "(" in waiting:
            raise ValueError("the expression does not end")
        while waiting:
            apply()
        result = context.plus(numbers[0])
    except decimal.DecimalException as error:
        raise ValueError("a zero divisor, or a value out of range") from error
    if not result.is_finite() or (result and abs(result.adjusted()) > EXPONENT):
        raise ValueError("the result is out of range")
    return {"result": format(result, "f"), "inexact": bool(context.flags[decimal.Inexact]), "rounded": bool(context.flags[decimal.Rounded])}


def plain(value: decimal.Decimal) -> str:
    """Fixed notation without trailing zeros."""
    text = format(value, "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


def derived(kind: str, values: list[str]) -> str:
    """The sum of decimal strings, or the difference or ratio of two, in plain notation."""
    names = {f"v{i}": v for i, v in enumerate(values)}
    if kind == "sum":
        expression = "+".join(names)
    elif len(values) == 2 and kind in ("difference", "ratio"):
        expression = "v0-v1" if kind == "difference" else "v0/v1"
    else:
        raise ValueError("a difference or ratio takes two values")
    return plain(decimal.Decimal(str(calculate(expression, names)["result"])))


def column():
    """(expression, map of inputs) -> struct(result, inexact, rounded, refused); null gives null, a refused expression its reason."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    kind = pa.struct([("result", pa.string()), ("inexact", pa.bool_()), ("rounded", pa.bool_()), ("refused", pa.string())])

    def run(expressions: pa.Array, inputs: pa.Array) -> pa.Array:
        out: list[dict | None] = []
        for expression, named in zip(expressions.to_pylist(), inputs.to_pylist()):
            try:
                out.append(None if expression is None else calculate(expression, dict(named or {})) | {"refused": None})
            except ValueError as error:
                out.append({"result": None, "inexact": None, "rounded": None, "refused": str(error)})
        return pa.array(out, kind)

    run.__annotations__ = {"expressions": pa.Array, "inputs": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<result:string,inexact:boolean,rounded:boolean,refused:string>")
