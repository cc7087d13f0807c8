"""Synthesis of short programs, and their step-by-step traces, in Arrow batches."""

from __future__ import annotations

import ast
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Largest absolute value that a traced variable may have.
BOUND = 999
TRACE = "ex_id long, text string, error string, steps array<struct<step:int,event:string,line:int,state:array<struct<name:string,value:long>>>>, rendered string"


class TraceError(Exception):
    """Its text is the kind of error."""


def snippet(seed: int, most_lines: int = 10, least_lines: int = 5, depth: int = 2, loops: bool = False) -> str:
    """A program of assignments and ifs (and loops over ranges), tab-indented, with one operator for all its sums."""
    rng = random.Random(seed)
    sign, lines, known, loop_names = rng.choice("+-"), [], [], set()
    want = rng.randint(least_lines, most_lines)

    def operand():
        return rng.choice(known) if known and rng.random() < 0.5 else str(rng.randint(0, BOUND) * rng.choice((1, -1)) if not known else rng.randint(0, 9))

    def assign(level):
        free = [n for n in known if n not in loop_names]
        name = rng.choice(free) if free and rng.random() < 0.3 else rng.choice("abcdefghijklmnopqrstuvwxyz")
        if name in loop_names:
            name = next(c for c in "zyxwvutsrqponm" if c not in loop_names)
        luck = rng.random()
        value = str(rng.randint(-99, 99)) if luck < 0.15 or not known else rng.choice(known) if luck < 0.3 else f"{operand()} {sign} {operand()}"
        lines.append("\t" * level + f"{name} = {value}")
        if name not in known:
            known.append(name)

    def block(level, room):
        assign(level)
        while len(lines) < room:
            if level < depth and known and len(lines) + 2 <= room and rng.random() < 0.3:
                fresh = [c for c in "ijkuvwxyzabcdefghlmnopqrst" if c not in known]
                if loops and fresh and rng.random() < 0.4:
                    name = fresh[0]
                    lines.append("\t" * level + f"for {name} in range({rng.randint(1, 3)}):")
                    known.append(name)
                    loop_names.add(name)
                else:
                    lines.append("\t" * level + f"if {rng.choice(known)} {rng.choice('<>')} {operand()}:")
                block(level + 1, min(room, len(lines) + rng.randint(1, 3)))
            else:
                assign(level)

    block(0, want)
    return "\n".join(lines)


def trace(code: str, bound: int = BOUND) -> list[tuple[str, int, list[tuple[str, int]]]]:
    """(event, line, state) before each executed line and at the end. State holds bound names in order of their first
    assignment in the text. TraceError: UnboundLocalError, ValueError (out of bounds), SyntaxError or TypeError."""
    try:
        tree = ast.parse(code)
    except SyntaxError:
        raise TraceError("SyntaxError") from None
    order = list(dict.fromkeys(n.id for n in sorted((n for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)), key=lambda n: (n.lineno, n.col_offset))))
    values: dict[str, int] = {}
    steps: list[tuple[str, int, list[tuple[str, int]]]] = []

    def event(kind: str, line: int) -> None:
        if any(abs(v) > bound for v in values.values()):
            raise TraceError("ValueError")
        steps.append((kind, line, [(n, values[n]) for n in order if n in values]))

    def value(node: ast.expr) -> int:
        match node:
            case ast.Constant(value=int(x)):
                return x
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -value(x)
            case ast.Name(id=name):
                if name not in values:
                    raise TraceError("UnboundLocalError" if name in order else "NameError")
                return values[name]
            case ast.BinOp(left=a, op=ast.Add(), right=b):
                return value(a) + value(b)
            case ast.BinOp(left=a, op=ast.Sub(), right=b):
                return value(a) - value(b)
            case ast.Compare(left=a, ops=[ast.Lt()], comparators=[b]):
                return int(value(a) < value(b))
            case ast.Compare(left=a, ops=[ast.Gt()], comparators=[b]):
                return int(value(a) > value(b))
        raise TraceError("TypeError")

    def run(body: list[ast.stmt]) -> None:
        for node in body:
            event("line", node.lineno)
            match node:
                case ast.Assign(targets=[ast.Name(id=name)], value=x):
                    values[name] = value(x)
                case ast.If(test=test, body=inner, orelse=other):
                    run(inner if value(test) else other)
                case ast.For(target=ast.Name(id=name), iter=ast.Call(func=ast.Name(id="range"), args=[n]), body=inner):
                    for i in range(value(n)):
                        values[name] = i
                        run(inner)
                        event("line", node.lineno)
                case _:
                    raise TraceError("TypeError")

    run(tree.body)
    event("return", 0)
    return steps


def render(code: str, steps: list) -> str:
    """The program, then a block for each step with the active line marked and its state."""
    lines, out = code.split("\n"), [code]
    for kind, line, state in steps:
        told = ";".join(f"{n}?{v}" for n, v in state)
        now = [f"@{x}${told}" if kind == "line" and i == line - 1 else x for i, x in enumerate(lines)]
        out.append("#STEP\n" + "\n".join(now + ([f"@^${told}"] if kind == "return" else [])))
    return "\n".join(out)


def generate(spark: SparkSession, n: int, seed: int = 1, **dialect) -> DataFrame:
    """ex_id, text: n programs; each follows from the seed and its id alone."""

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            yield pd.DataFrame({"ex_id": pdf["id"], "text": [snippet(seed * 1_000_003 + int(i), **dialect) for i in pdf["id"]]})

    return spark.range(n).mapInPandas(run, "ex_id long, text string")


def until(spark: SparkSession, target: int, kept, seed: int = 1, **dialect) -> DataFrame:
    """The first target programs, by id, of those that kept (a function of a table ex_id, text) leaves. More are made
    by the share that was kept so far; the driver learns counts alone."""
    n = max(2 * target, 1)
    while True:
        got = kept(generate(spark, n, seed, **dialect))
        found = got.count()
        if found >= target:
            return got.orderBy("ex_id").limit(target)
        n = max(2 * n, int(1.2 * n * target / max(found, 1)))


def traced(programs: DataFrame, bound: int = BOUND) -> DataFrame:
    """ex_id, text, error (null if it ran), steps, rendered."""

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            rows = []
            for i, code in zip(pdf["ex_id"], pdf["text"]):
                try:
                    steps = trace(code or "", bound)
                    rows.append((i, code, None, [{"step": k, "event": e, "line": ln, "state": [{"name": a, "value": b} for a, b in st]} for k, (e, ln, st) in enumerate(steps)], render(code or "", steps)))
                except TraceError as e:
                    rows.append((i, code, str(e), None, None))
            yield pd.DataFrame(rows, columns=["ex_id", "text", "error", "steps", "rendered"])

    return programs.select("ex_id", "text").mapInPandas(run, TRACE)


def context_windows(tok: list[str], bounds: list[int], block: int, pad: str = "\n\n", whole: bool = False) -> list[tuple[int, list[str], list[str]]]:
    """(start, x, y) windows of block tokens, each from a boundary; the next begins at the last boundary whose end isn't past the
    window (never at the last of all), y is x moved on by one, short windows are padded. Behind a step longer than the block no
    boundary is within reach: there the windows end, or (whole) the next begins where this one ends, so that no token is left out."""
    out, at, start = [], 0, bounds[0]
    while True:
        stop = start + block
        x, y = tok[start:stop], tok[start + 1 : stop + 1]
        out.append((start, x + [pad] * (block - len(x)), y + [pad] * (block - len(y))))
        if stop >= len(tok) - 1:
            return out
        inside = [k for k in range(at, len(bounds) - 1) if start < bounds[k] <= stop]
        if inside:
            at = inside[-1]
            start = bounds[at]
        elif whole:
            start = stop  # inside a step longer than the block
        else:
            return out


def windows(examples: DataFrame, block: int) -> DataFrame:
    """ex_id, start, x, y from ex_id, tok, bounds."""

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            rows = [(i, *w) for i, tok, bounds in zip(pdf["ex_id"], pdf["tok"], pdf["bounds"]) if len(bounds) for w in context_windows(list(tok), [int(b) for b in bounds], block, whole=True)]
            yield pd.DataFrame(rows, columns=["ex_id", "start", "x", "y"])

    return examples.select("ex_id", "tok", "bounds").mapInPandas(run, "ex_id long, start int, x array<string>, y array<string>")
