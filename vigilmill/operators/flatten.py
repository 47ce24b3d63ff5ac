"""Nested answers to linked flat tables, by Arrow list kernels.

JSON text becomes one nested Arrow array per batch; from there on nothing
walks rows. Each level is flattened by its list offsets: ``list_flatten``
gives the children, ``list_parent_indices`` each child's parent, the position
is the child's index less the parent's offset, and all keys go down by a
vectorised ``take``.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..session import Scratch, spread

EVIDENCE = pa.struct([("quote", pa.string()), ("pos", pa.int64())])
EVENT = pa.struct([
    ("original_expression", pa.string()), ("meddra_pt", pa.string()), ("meddra_pt_zh", pa.string()), ("onset", pa.string()),
    ("severity", pa.string()), ("outcome", pa.string()), ("confidence", pa.float64()), ("evidence", pa.list_(EVIDENCE)),
])
REGIMEN = pa.struct([("drugs", pa.list_(pa.string())), ("adverse_events", pa.list_(EVENT))])
ANSWER = pa.struct([("regimens", pa.list_(REGIMEN))])

_FENCE = re.compile(r"^\s*(?:```|~~~)[^\n`]*\n?(.*?)\n?\s*(?:```|~~~)\s*$", re.S)


def decode_answer(text: str | None, max_wraps: int = 8) -> dict | None:
    """The JSON object in a model answer, or None if there is no whole one.

    Markdown fences and repeated JSON encodings around it are peeled off in
    any order (``max_wraps`` bounds adversarial nesting; real ones have two).
    """
    for _ in range(max_wraps):
        if not isinstance(text, str):
            return text if isinstance(text, dict) else None
        fenced = _FENCE.match(text)
        if fenced:
            text = fenced[1]
            continue
        try:
            text = json.loads(text.strip("﻿ \t\r\n"))
        except (ValueError, RecursionError):
            return None
    return text if isinstance(text, dict) else None


def typed(value: object, kind: pa.DataType) -> object:
    """``value`` as ``kind`` demands; of another type: null. Elements of lists
    keep their place, so positions are those of the stored array."""
    if pa.types.is_struct(kind):
        return {f.name: typed(value.get(f.name), f.type) for f in kind} if isinstance(value, dict) else None
    if pa.types.is_list(kind):
        return [typed(x, kind.value_type) for x in value] if isinstance(value, list) else None
    if pa.types.is_string(kind):
        return value.encode("utf-8", "replace").decode() if isinstance(value, str) else None
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return None
    if pa.types.is_integer(kind):
        return value if isinstance(value, int) and -(2**63) <= value < 2**63 else None
    try:
        number = float(value)  # numbers written as strings count
    except (OverflowError, ValueError):
        return None
    return number if math.isfinite(number) else None


def flatten_list(lists: pa.ListArray, keys: dict[str, pa.Array], pos_name: str) -> tuple[pa.Array, dict[str, pa.Array]]:
    """All elements of ``lists`` and, for each, its parent's keys and position.

    Null and empty lists have no children. Works on slices: offsets are used
    as they are and the position is taken relative to the parent's offset.
    """
    parent = pc.list_parent_indices(lists)
    child = pc.list_flatten(lists)
    first = lists.offsets.slice(0, len(lists))
    # A null list may own a stale range of values; list_flatten skips it, so ranks count from the parent's first child.
    length = pc.fill_null(pc.list_value_length(lists), 0)
    start = pc.subtract(pc.cumulative_sum(length), length) if len(lists) else first
    rank = pa.array(range(0)) if not len(child) else pc.subtract(pa.array(range(len(child)), pa.int64()), pc.take(start, parent).cast(pa.int64()))
    down = {k: pc.take(v, parent) for k, v in keys.items()}
    return child, down | {pos_name: rank.cast(pa.int32())}


def keep(mask: pa.Array, child: pa.Array, keys: dict[str, pa.Array]) -> tuple[pa.Array, dict[str, pa.Array]]:
    """Only the children where ``mask`` is true."""
    mask = pc.fill_null(mask, False)
    return child.filter(mask), {k: v.filter(mask) for k, v in keys.items()}


def not_blank(a: pa.Array) -> pa.Array:
    return pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(a)), 0)


def nested_answers(text: pa.Array) -> pa.StructArray:
    """One nested array for a batch of answers; null where none is whole."""
    return pa.array([typed(decode_answer(t), ANSWER) for t in text.to_pylist()], ANSWER)


def answer_levels(batch: pa.RecordBatch) -> dict[str, tuple[pa.Array, dict[str, pa.Array]]]:
    """regimen, drug, event and evidence: children with their linking keys."""
    answers = nested_answers(batch["extraction"])
    keys = {"log_line": batch["log_line"]}
    whole = pc.is_valid(answers)
    records, keys = keep(whole, answers, keys)
    out = {"record": (records, keys)}
    regimen, rk = flatten_list(pc.struct_field(records, [0]), keys, "regimen_pos")
    regimen, rk = keep(pc.is_valid(regimen), regimen, rk)
    out["regimen"] = (regimen, rk)
    drug, dk = flatten_list(pc.struct_field(regimen, [0]), rk, "item_pos")
    out["drug"] = keep(not_blank(drug), drug, dk)
    event, ek = flatten_list(pc.struct_field(regimen, [1]), rk, "item_pos")
    event, ek = keep(not_blank(pc.struct_field(event, [0])), event, ek)
    out["event"] = (event, ek)
    proof, pk = flatten_list(pc.struct_field(event, [7]), ek, "sub_pos")
    out["evidence"] = keep(pc.is_valid(pc.struct_field(proof, [0])), proof, pk)
    return out


SCHEMAS = {
    "record": "log_line bigint, n_regimens int",
    "regimen": "log_line bigint, regimen_pos int, n_drugs int, n_events int",
    "drug": "log_line bigint, regimen_pos int, drug_pos int, drug string",
    "event": "log_line bigint, regimen_pos int, event_pos int, original_expression string, meddra_pt string, meddra_pt_zh string, onset string, severity string, outcome string, confidence double",
    "evidence": "log_line bigint, regimen_pos int, event_pos int, evidence_pos int, quote string, quote_pos bigint",
    "both": "kind string, log_line bigint, regimen_pos int, pos int, drug string, original_expression string, meddra_pt string, meddra_pt_zh string, onset string, severity string, outcome string, confidence double",
    "item": "log_line bigint, regimen_pos int, item_kind string, item_pos int, sub_pos int",
}


def _sizes(lists: pa.Array) -> pa.Array:
    return pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32())


def _names(kind: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[kind].split(", ")]


def _rows(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at = answer_levels(b)
            if kind == "item":
                for what in ("drug", "event", "evidence"):
                    child, k = at[what]
                    n = len(child)
                    minus = pa.array([-1] * n, pa.int32())
                    yield pa.RecordBatch.from_arrays([k["log_line"], k["regimen_pos"], pa.array([what] * n, pa.string()), k["item_pos"], k.get("sub_pos", minus)], ["log_line", "regimen_pos", "item_kind", "item_pos", "sub_pos"])
                continue
            if kind == "both":
                drug, dk = at["drug"]
                event, ek = at["event"]
                nulls = lambda n, t: pa.nulls(n, t)
                fields = [pc.struct_field(event, [i]) for i in range(7)]
                yield pa.RecordBatch.from_arrays([pa.array(["drug"] * len(drug), pa.string()), dk["log_line"], dk["regimen_pos"], dk["item_pos"], drug, *[nulls(len(drug), f.type) for f in fields]], _names(kind))
                yield pa.RecordBatch.from_arrays([pa.array(["event"] * len(event), pa.string()), ek["log_line"], ek["regimen_pos"], ek["item_pos"], nulls(len(event), pa.string()), *fields], _names(kind))
                continue
            child, k = at[kind]
            field = lambda i: pc.struct_field(child, [i])
            cols = list(k.values())
            cols += {"record": lambda: [_sizes(field(0))], "regimen": lambda: [_sizes(field(0)), _sizes(field(1))], "drug": lambda: [child], "event": lambda: [field(i) for i in range(7)], "evidence": lambda: [field(0), field(1)]}[kind]()
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], _names(kind))

    return run


def flat_answers(log: DataFrame, kind: str) -> DataFrame:
    """One flat table of the answers in ``log`` (log_line, extraction).

    ``kind``: record, regimen, drug, event, evidence, or item (the last three
    as keys only). Every table starts with its parent's key columns, so
    ``log_line``, ``regimen_pos`` and ``event_pos`` join child to parent.

    Cases: null, torn or non-object text has no rows; a field that is absent,
    null or of another type counts as absent; drugs that are blank or no
    strings, events without a non-blank original_expression, and evidence
    without a string quote are left out, yet count for the positions of
    others; repeats stay; extra fields and columns are ignored. A
    confidence written as a string is read as a number; a number that is not
    finite is null.
    """
    return spread(log.select("log_line", "extraction")).mapInArrow(_rows(kind), SCHEMAS[kind])


class FlatAnswers:
    """Drugs and events of ``log``, decoded once and written for re-use.

    ``drugs`` and ``events`` have the columns of flat_answers; all plans over
    them read the written table, so the JSON is decoded in one pass.
    """

    def __init__(self, log: DataFrame):
        both = Scratch(log.sparkSession, "answers").put(log.select("log_line", "extraction").mapInArrow(_rows("both"), SCHEMAS["both"]))
        self.drugs = both.where("kind = 'drug'").select("log_line", "regimen_pos", both["pos"].alias("drug_pos"), "drug")
        self.events = both.where("kind = 'event'").select("log_line", "regimen_pos", both["pos"].alias("event_pos"), *_names("event")[3:])
