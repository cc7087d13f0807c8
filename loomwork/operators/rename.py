"""Renaming whole programs: by their syntax tree, by letters, and many distinct permutations of names."""

from __future__ import annotations

import ast
import hashlib
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def program_names(code: str) -> list[str]:
    """Variables of a program in order of their first place in the text; called functions aren't variables."""
    tree = ast.parse(code)
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    found = sorted((n.lineno, n.col_offset, n.id) for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called)
    return list(dict.fromkeys(name for _, _, name in found))


def rename_tree(code: str, names: dict[str, str]) -> str:
    """Renames all variables at once; the text is written anew from the tree, with tabs."""
    tree = ast.parse(code)
    for node in ast.walk(tree):
        if isinstance(node, ast.Name):
            node.id = names.get(node.id, node.id)
    lines = ast.unparse(tree).split("\n")
    return "\n".join("\t" * ((len(x) - len(x.lstrip(" "))) // 4) + x.lstrip(" ") for x in lines)


def permutations(code: str, n: int, seed: int, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> list[dict[str, str]]:
    """Up to n distinct one-to-one maps of a program's single-letter names to letters (fewer if there are fewer)."""
    own = [x for x in program_names(code) if len(x) == 1]
    possible = 1
    for k in range(len(own)):
        possible *= len(alphabet) - k
    rng, seen, out = random.Random(int(hashlib.sha256(f"{seed}:{code}".encode()).hexdigest()[:15], 16)), set(), []
    while own and len(out) < min(n, possible):
        to = tuple(rng.sample(alphabet, len(own)))
        if to not in seen:
            seen.add(to)
            out.append(dict(zip(own, to)))
    return out


def renamed_programs(programs: DataFrame, n: int = 128, seed: int = 1) -> DataFrame:
    """ex_id, copy, text: each program (ex_id, text) under n distinct permutations of its names. Texts that aren't programs
    (and nulls) have no copies; repeated rows are copied each."""

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            rows = []
            for i, code in zip(pdf["ex_id"], pdf["text"]):
                try:
                    rows += [(i, k, rename_tree(code, names)) for k, names in enumerate(permutations(code, n, seed))]
                except (SyntaxError, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=["ex_id", "copy", "text"])

    return programs.select("ex_id", "text").mapInPandas(run, "ex_id long, copy int, text string")


def rename_letters(code: Column, frm: str, to: str) -> Column:
    """Single-letter words by a permutation, longer words as they are: in columns alone."""
    names = F.create_map(*(F.lit(x) for pair in zip(frm, to) for x in pair))
    runs = F.regexp_extract_all(code, F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.coalesce(F.try_element_at(names, w), w)), "")


def aligned(originals: DataFrame, renamed: DataFrame, key: str = "index") -> DataFrame:
    """Originals beside their renamed form by key; ValueError if one of them lacks rows of the other."""
    here, there = originals.count(), renamed.count()
    both = originals.join(renamed.select(key, F.col("code").alias("renamed_code"), "num_renamed"), key)
    if here != there or both.count() != here:
        raise ValueError(f"{here} originals and {there} renamed rows don't match")
    return both
