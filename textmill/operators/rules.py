"""Cleaning rules as an extension point: a rule is a function from Column to Column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.measures import token_count
from textmill.operators.detect import route
from textmill.operators.store import fingerprint


def tried(c: Column) -> Column:
    """c, or null in the rows where it raises: the expression that the try_ functions are made of, around any expression.

    A Python UDF within c is run before and has to look after itself (see each_text).
    """
    jvm = SparkSession.active()._jvm
    of = jvm.org.apache.spark.sql.classic.ExpressionUtils
    return Column(of.column(jvm.org.apache.spark.sql.catalyst.expressions.TryEval(of.expression(c._jc))))


@dataclass(frozen=True)
class Rule:
    name: str
    version: str
    types: tuple[str, ...]
    priority: int
    #: From Column to Column; with each_text, from a text to a text, run over Arrow batches.
    clean: Callable
    detect: Callable[[Column], Column] | None = None
    each_text: bool = False

    def cleaned(self, c: Column) -> Column:
        """The rule's result, or c as it was in the rows where the rule gives null or fails."""
        if not self.each_text:
            return F.coalesce(tried(self.clean(c)), c)
        fn = self.clean

        def every(texts: pd.Series) -> pd.Series:
            def one(x: str | None) -> str | None:
                if x is None:
                    return None
                try:
                    y = fn(x)
                except Exception:  # a rule is foreign code: whatever it raises, its row stays as it is
                    return x
                return y if isinstance(y, str) else x

            return texts.map(one)

        return F.pandas_udf(every, "string")(c)


class Rules:
    """An ordered set of rules; immutable, each change gives a new one."""

    def __init__(self, rules: tuple[Rule, ...] = ()) -> None:
        self.rules = tuple(sorted(rules, key=lambda r: (r.priority, r.name)))

    def register(self, rule: Rule, deterministic: bool = True, idempotent: bool = True, lossy: bool = False, allow_lossy: bool = False) -> Rules:
        if any(r.name == rule.name for r in self.rules):
            raise ValueError(f"a rule named {rule.name} is registered already")
        if not 0 <= rule.priority <= 1000:
            raise ValueError(f"the priority of {rule.name} is not between 0 and 1000")
        if not (deterministic and idempotent):
            raise ValueError(f"{rule.name} has to be deterministic and idempotent")
        if lossy and not allow_lossy:
            raise ValueError(f"{rule.name} loses content")
        return Rules((*self.rules, rule))

    def with_rules(self, enabled: set[str]) -> Rules:
        """Only the rules named; detector and cleaner go together, and the fingerprint changes."""
        return Rules(tuple(r for r in self.rules if r.name in enabled))

    def fingerprint(self) -> str:
        return fingerprint([(r.name, r.version) for r in self.rules])

    def detectors(self) -> list[tuple[str, str, Callable[[Column], Column]]]:
        return [(r.name, r.types[0], r.detect) for r in self.rules if r.detect]

    def apply(self, df: DataFrame, text: str = "text", content_type: str = "content_type") -> DataFrame:
        """df with cleaned and rule: the first rule for its type; a null result leaves the text as it is."""
        kind, name, out = F.col(content_type), F.lit(None).cast("string"), F.col(text)
        for r in reversed(self.rules):
            mine = kind.isin(*r.types)
            name, out = F.when(mine, r.name).otherwise(name), F.when(mine, r.cleaned(F.col(text))).otherwise(out)
        return df.withColumn("cleaned", out).withColumn("rule", name)

    def route(self, content_type: Column) -> Column:
        """The cleaner of a content type: the first rule for it, or the built-in one if that comes before."""
        out = route(content_type)
        built_in = F.when(out == "html", 10).when(out == "json", 20).when(out == "csv", 30).when(out == "prompt", 90).when(out == "text", 100).otherwise(2000)
        best = F.struct(built_in.alias("priority"), out.alias("name"))
        for r in self.rules:
            best = F.when(content_type.isin(*r.types), F.least(best, F.struct(F.lit(r.priority).alias("priority"), F.lit(r.name).alias("name")))).otherwise(best)
        return best["name"]

    def apply_named(self, df: DataFrame, name: str, text: str = "text") -> DataFrame:
        """df with cleaned and steps from the rule that the column ``name`` names; other rows as they are."""
        cleaned, steps = F.col("cleaned"), F.col("steps")
        for r in self.rules:
            df = df.withColumn("by_rule", r.cleaned(F.col(text)))
            mine = F.col(name) == r.name
            changed = F.when(F.col("by_rule") != F.col(text), F.array(F.lit(r.name))).otherwise(F.array().cast("array<string>"))
            df = df.withColumn("steps", F.when(mine, changed).otherwise(steps)).withColumn("cleaned", F.when(mine, F.col("by_rule")).otherwise(cleaned)).drop("by_rule")
        return df


def check_rule(df: DataFrame, clean: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """How many rows a rule treats in a way it must not: not idempotent, or more tokens than before."""
    d = df.select(F.col(text).alias("t")).withColumn("once", clean(F.col("t"))).withColumn("twice", clean(F.col("once")))
    return d.agg(F.count("*").alias("checked"), F.count_if(~F.equal_null(F.col("once"), F.col("twice"))).alias("not_idempotent"), F.count_if(token_count(F.col("once")) > token_count(F.col("t"))).alias("grown"))
