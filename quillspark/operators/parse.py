"""Model outputs: parsing with strict typing, repair of coupled fields, retries, and probabilities from token logs."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType
from pyspark.sql.window import Window

from quillspark.config import CLASSES, FACTORS
from quillspark.operators.spans import realign

PARSED = "struct<ok boolean, risk string, evidence array<string>, factors array<string>, dropped int>"


def strip_fence(text: str) -> str:
    t = text.strip()
    if t.startswith("```"):
        t = t.partition("\n")[2] if "\n" in t else t[3:]
        t = t.rstrip()
        t = t[:-3] if t.endswith("```") else t
    return t.strip()


def parse_one(text: str | None, raw: str | None, classes: list[str] = CLASSES, taxonomy: list[str] = FACTORS) -> dict:
    """The record of one generation: not ok without an object, a known class, a list of evidence or factors of the taxonomy.

    Phrases that are no text, blank or nowhere in the post are dropped and counted.  In a map of factors one that is not
    there is false; a factor outside the taxonomy makes the record not ok if it is in a list.
    """
    bad = {"ok": False, "risk": None, "evidence": None, "factors": None, "dropped": 0}
    try:
        d = json.loads(strip_fence(text or ""))
    except (ValueError, RecursionError):
        return bad
    if not isinstance(d, dict) or d.get("risk") not in classes or not isinstance(d.get("evidence"), list):
        return bad
    f = d.get("factors")
    if isinstance(f, dict):
        factors = [x for x in taxonomy if f.get(x)]
    elif isinstance(f, list) and all(isinstance(x, str) and x in taxonomy for x in f):
        factors = [x for x in taxonomy if x in f]
    else:
        return bad
    kept = realign([e for e in d["evidence"] if isinstance(e, str)], raw)
    return {"ok": True, "risk": d["risk"], "evidence": kept, "factors": factors, "dropped": len(d["evidence"]) - len(kept)}


def parsed(df: DataFrame, text: str, raw: str) -> DataFrame:
    """``df`` with ok, risk, evidence, factors, dropped; null or malformed text is not ok."""
    @F.pandas_udf(PARSED)
    def run(t: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_one(a, b) for a, b in zip(t, r, strict=True)], columns=["ok", "risk", "evidence", "factors", "dropped"])

    d = df.withColumn("_p", run(text, raw))
    return d.select("*", "_p.*").drop("_p")


def repaired(df: DataFrame, classes: list[str] = CLASSES) -> DataFrame:
    """The lowest class loses its spans (cleared); a higher class without spans is flagged (violation)."""
    n, low = F.size(F.coalesce("evidence", F.array().cast("array<string>"))), F.col("risk") == classes[0]
    return df.withColumn("cleared", F.coalesce(low & (n > 0), F.lit(False))).withColumn("violation", F.coalesce(~low & (n == 0), F.lit(False))).withColumn("evidence", F.when(low, F.array().cast("array<string>")).otherwise(F.col("evidence")))


def resolved(attempts: DataFrame, key: str, order: str, classes: list[str] = CLASSES) -> DataFrame:
    """One row per key of an attempts table (ok, violation, ...): the first attempt that is ok without violation, else the
    last that is ok, else a fallback of the lowest class with parse_failure."""
    w = Window.partitionBy(key)
    d = attempts.withColumn("_first", F.min(F.when(F.col("ok") & ~F.col("violation"), F.col(order))).over(w)).withColumn("_last", F.max(F.when(F.col("ok"), F.col(order))).over(w)).withColumn("_any", F.min(order).over(w))
    d = d.where(F.col(order) == F.coalesce("_first", "_last", "_any")).withColumn("parse_failure", F.coalesce("_first", "_last").isNull())
    empty = F.array().cast("array<string>")
    return d.withColumn("risk", F.when(F.col("parse_failure"), classes[0]).otherwise(F.col("risk"))).withColumn("evidence", F.when(F.col("parse_failure"), empty).otherwise(F.col("evidence"))).withColumn("factors", F.when(F.col("parse_failure"), empty).otherwise(F.col("factors"))).drop("_first", "_last", "_any")


def factor_probabilities(text: str, tokens: list[str], logs: list[list[tuple[str, float]]], taxonomy: list[str] = FACTORS) -> dict[str, float]:
    """Probability of true for each factor of a rendered record, from the log probabilities at the step of its value.

    Mass of tokens that are a prefix of true over that of true and false; the literal value where neither has mass; 0 for a
    factor that is not in the text.
    """
    step_of = [i for i, t in enumerate(tokens) for _ in t]
    out = {}
    for f in taxonomy:
        at = text.find(f'"{f}":')
        if at < 0:
            out[f] = 0.0
            continue
        value = at + len(f) + 3
        while value < len(text) and text[value] == " ":
            value += 1
        mass = {"true": 0.0, "false": 0.0}
        for tok, lp in logs[step_of[value]] if value < len(step_of) else []:
            t = tok.strip().lower()
            for k in mass:
                if t and k.startswith(t):
                    mass[k] += math.exp(lp)
        total = sum(mass.values())
        out[f] = mass["true"] / total if total else float(text[value:].startswith("true"))
    return out


def risk_steps(text: str, tokens: list[str], logs: list[list[tuple[str, float]]], steps: int = 3) -> list[list[tuple[str, float]]]:
    """The (token, log probability) lists of the steps from the risk value on, most likely first; ties by token."""
    mark = '"risk": "'
    at = text.rfind(mark)
    step_of = [i for i, t in enumerate(tokens) for _ in t]
    if at < 0 or at + len(mark) >= len(step_of):
        return []
    first = step_of[at + len(mark)]
    return [sorted(x, key=lambda p: (-p[1], p[0])) for x in logs[first : first + steps]]


LOGS = "array<array<struct<tok:string,lp:double>>>"
#: Rows whose steps are Python objects at once.
FEW = 64


def with_probabilities(batches: Iterator[pa.RecordBatch], text: str, tokens: str, logs: str, taxonomy: list[str] = FACTORS) -> Iterator[pa.RecordBatch]:
    """The batches with p_true, ``FEW`` rows at a time: a step is a Python object for each alternative."""
    for whole in batches:
        for i in range(0, whole.num_rows, FEW):
            b, out = whole.slice(i, FEW), []
            for a, k, c in zip(*(b.column(x).to_pylist() for x in (text, tokens, logs)), strict=True):
                if a is None or k is None:
                    out.append(None)
                else:
                    alternatives = [[(x["tok"], x["lp"]) for x in step] for step in (c if c is not None else [])]
                    out.append(list(factor_probabilities(a, k, alternatives + [[]] * (len(k) - len(alternatives)), taxonomy).items()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.map_(pa.string(), pa.float64()))], [*b.schema.names, "p_true"])


def probed(df: DataFrame, text: str, tokens: str, logs: str, taxonomy: list[str] = FACTORS) -> DataFrame:
    """``df`` with p_true, a map of :func:`factor_probabilities`; null where text or tokens are.

    ``tokens``: array of the decoded tokens of the text, ``logs``: at each of them the alternatives (tok, lp).
    """
    schema = StructType([*df.schema.fields, StructField("p_true", MapType(StringType(), DoubleType()))])
    return df.mapInArrow(lambda batches: with_probabilities(batches, text, tokens, logs, taxonomy), schema)


def risk_probed(df: DataFrame, text: str, tokens: str, logs: str, steps: int = 3) -> DataFrame:
    """``df`` with risk_logprobs, the steps of :func:`risk_steps`; an empty list where the text has no class."""
    @F.pandas_udf(LOGS)
    def run(t: pd.Series, k: pd.Series, g: pd.Series) -> pd.Series:
        got = [risk_steps(a or "", list(b) if b is not None else [], [[(x["tok"], x["lp"]) for x in step] for step in (c if c is not None else [])], steps) for a, b, c in zip(t, k, g, strict=True)]
        return pd.Series([[[{"tok": x, "lp": y} for x, y in step] for step in r] for r in got])

    return df.withColumn("risk_logprobs", run(text, tokens, logs))


def output_pattern(classes: list[str] = CLASSES, taxonomy: list[str] = FACTORS) -> str:
    """A pattern (for rlike) of well-formed rendered records with a map of all factors."""
    import re

    text = r'"(?:[^"\\]|\\.)*"'
    pairs = ", ".join(f'"{re.escape(f)}": (?:true|false)' for f in taxonomy)
    return rf'^\{{"evidence": \[(?:{text}(?:, {text})*)?\], "factors": \{{{pairs}\}}, "risk": "(?:{"|".join(classes)})"\}}$'
