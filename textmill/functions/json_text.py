"""JSON compaction by structure: repeated keys (the last wins, at any depth), empty containers, white space, escapes.

Texts whose compaction is a matter of white space alone stay with expressions. The others (a repeated key, an
escape that a character can stand for, empty containers to be taken out) go through Python's parser, in Arrow
batches; every other row is a null there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.arrow import text_slices
from textmill.functions.text import json_kind

COLLAPSED, EMPTIED, MINIFIED = "collapsed_duplicate_keys", "removed_empty_containers", "minified_json"
SCHEMA = "kind int, text string, collapsed boolean, emptied boolean"


def pruned(value: Any) -> Any:
    """value without objects and arrays that are empty, or become so; the outermost one stays."""
    if isinstance(value, dict):
        return {k: v for k, v in ((k, pruned(v)) for k, v in value.items()) if v not in ({}, [])}
    if isinstance(value, list):
        return [v for v in map(pruned, value) if v not in ({}, [])]
    return value


#: Objects with a repeated key that the text at hand had; one text is read at a time.
REPEATED: list[dict[str, Any]] = []


def members(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    found = dict(pairs)
    if len(found) < len(pairs):
        REPEATED.append(found)
    return found


READER, WRITER = json.JSONDecoder(object_pairs_hook=members), json.JSONEncoder(ensure_ascii=False, separators=(",", ":"))


def compact(text: str, prune: bool) -> tuple[str | None, bool, bool]:
    """The compact form, whether a key was repeated, whether a container went; nulls for what is no JSON or nested too deeply."""
    REPEATED.clear()
    try:
        value = READER.decode(text)
        small = pruned(value) if prune else value
        out = WRITER.encode(small)
        out.encode()
    except (ValueError, RecursionError):
        return None, False, False
    return out, bool(REPEATED), prune and small != value


def compact_texts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for found, prune in batches:
        kinds, at = found.field("kind"), 0
        for texts in text_slices(found.field("text")):
            rows = [(None, None, None) if t is None else compact(t, p.as_py()) for t, p in zip(texts.to_pylist(), prune.slice(at, len(texts)), strict=True)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.bool_(), pa.bool_()))]
            yield pa.StructArray.from_arrays([kinds.slice(at, len(texts)), *columns], ["kind", "text", "collapsed", "emptied"])
            at += len(texts)


def compact_json(c: Column, prune: bool = False) -> Column:
    """cleaned and steps of a text: what is no JSON stays, and a text that comes out as it was took no step.

    Number literals stay as written but in texts that go through the parser. A text's kind is found once, and
    comes back with what the parser gives.
    """
    hard = lambda k: (k > 0) if prune else (k == 2) | (k == 1) & c.rlike(r"\\[u/]")
    asked = F.element_at(F.transform(F.array(json_kind(c)), lambda k: F.struct(k.alias("kind"), F.when(hard(k), c).alias("text"))), 1)
    parsed = F.arrow_udf(compact_texts, SCHEMA)(asked, F.lit(prune))
    plain = F.regexp_replace(c, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|\s++', "$1")
    cleaned = F.coalesce(parsed["text"], F.when(parsed["kind"] == 1, plain).otherwise(c))
    step = lambda when, name: F.when(F.coalesce(when, F.lit(False)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    steps = F.concat(step(parsed["collapsed"], COLLAPSED), step(parsed["emptied"], EMPTIED), F.array(F.lit(MINIFIED)))
    return F.struct(cleaned.alias("cleaned"), F.when(cleaned != c, steps).otherwise(F.array().cast("array<string>")).alias("steps"))
