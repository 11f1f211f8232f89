"""Column functions on what language models return: chains of models, clean-up, and repair of JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.text import SPACE, stripped


def model_chain(tier: Column, primary: Column, complex_: Column, fallbacks: Column) -> Column:
    """Models in the order they are tried: the tier's own first, each once, empty names dropped."""
    first = F.when(tier.isin("complex", "flash"), F.array(complex_, primary)).otherwise(F.array(primary, complex_))
    return F.array_distinct(F.filter(F.concat(first, fallbacks), lambda m: F.coalesce(m, F.lit("")) != ""))


def clean_model_text(c: Column) -> Column:
    """A reply without its scratch pad: paragraphs that note questions, constraints or options, if the reply begins with
    a question and a line at the margin begins with a constraint. A reply that is nothing else stays."""
    text = stripped(c)
    parts = F.split(text, rf"\n{SPACE}*\n")
    kept = F.filter(parts, lambda p: ~stripped(p).rlike(r"^\*   (Question:|Constraint:|Option)"))
    padded = text.rlike(rf"(?s)^\*{SPACE}+Question:.*?\n\*{SPACE}+Constraint:")
    return F.when(padded & (F.size(kept) > 0), stripped(F.array_join(kept, "\n\n"))).otherwise(text)


def _loads(text: str) -> str | None:
    try:
        return json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False)
    except ValueError:
        return None


def _balanced(text: str, opening: str, closing: str):
    """Each stretch that ends at the last closing sign and begins where the signs before it balance, shortest first."""
    end, depth = text.rfind(closing), 0
    for at in range(end, -1, -1) if end >= 0 else ():
        depth += (text[at] == closing) - (text[at] == opening)
        if not depth and text[at] == opening:
            yield text[at : end + 1]


def repaired(text: str | None) -> str | None:
    """The JSON value in a reply, with sorted keys, or None: the whole reply, else the last fence that parses, else what
    ends with the last brace, else with the last bracket."""
    import re

    text = (text or "").strip()
    # Fixed value: the pattern of a fence.
    fences = re.findall(r"```(?:json)?\s*([\s\S]*?)\s*```", text)
    tries = [text, *(f.strip() for f in reversed(fences)), *_balanced(text, "{", "}"), *_balanced(text, "[", "]")]
    return next((x for x in map(_loads, tries) if x is not None), None)


def json_repair(c: Column) -> Column:
    """repaired() over Arrow batches; null where a reply holds no JSON."""

    @F.pandas_udf("string")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(repaired)

    return udf(c)
