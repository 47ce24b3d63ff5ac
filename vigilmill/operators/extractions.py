"""From the extraction log to exposures and events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MOST_TERMS, OUTCOMES
from ..functions.ids import bare_id
from ..functions.text import squeeze
from ..session import Scratch
from .flatten import FlatAnswers
from .records import user_prompt

RESULT = "target_drugs array<string>, record_id string, user_id string, subreddit string, date_text string, status string, model_name string, extraction string, error_text string"


def latest_per_record(log: DataFrame) -> DataFrame:
    """The last line of each record (also a failure after a success); rows
    without record id are skipped. Ids lose blanks and type prefix."""
    cols = [c for c in log.columns if c != "record_id"]
    keyed = log.withColumn("record_id", bare_id(F.col("record_id"))).where("record_id is not null")
    best = keyed.groupBy("record_id").agg(F.max_by(F.struct(*cols), "log_line").alias("r"))
    return best.select("record_id", *[F.col(f"r.{c}") for c in cols])


def pending(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Rows whose latest log line isn't ``completed`` (incremental runs)."""
    done = latest_per_record(log).where("status = 'completed'").select("record_id")
    return rows.join(done, "record_id", "left_anti")


def choice(c: Column, allowed: list[str], default: str) -> Column:
    v = F.lower(squeeze(c))
    return F.when(v.isin(allowed), v).otherwise(F.lit(default))


def regimens(answers: FlatAnswers, targets: list[str]) -> DataFrame:
    """``log_line, regimen_pos, exposure_group, n_target_drugs`` of regimens
    with a target drug; drugs in the targets' order, joined by `` + ``."""
    drugs = answers.drugs.select("log_line", "regimen_pos", F.lower(squeeze(F.col("drug"))).alias("drug")).where(F.col("drug").isin(targets))
    order = F.array(*[F.lit(t) for t in targets])
    own = drugs.groupBy("log_line", "regimen_pos").agg(F.collect_set("drug").alias("own"))  # a subset of the targets
    listed = F.filter(order, lambda t: F.array_contains("own", t))
    return own.select("log_line", "regimen_pos", F.array_join(listed, " + ").alias("exposure_group"), F.size(listed).alias("n_target_drugs"))


def merged_regimens(answers: FlatAnswers, targets: list[str]) -> DataFrame:
    """Regimens of one answer with the same drugs become one, at the first
    position. Columns as regimens, one row per (log_line, exposure_group)."""
    return regimens(answers, targets).groupBy("log_line", "exposure_group", "n_target_drugs").agg(F.min("regimen_pos").alias("regimen_pos"))


def group_type(n: Column) -> Column:
    return F.when(n == 1, F.lit("single")).otherwise(F.lit("combination"))


def normal_events(answers: FlatAnswers, targets: list[str]) -> DataFrame:
    """Events of target regimens with tidy fields, once per expression, term
    and onset (case ignored) in each answer and exposure group; the first one
    stays. ``ordinal`` orders them as the log does."""
    reg = regimens(answers, targets)
    e = answers.events.join(reg, ["log_line", "regimen_pos"])
    conf = F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    rows = e.select(
        "log_line", "exposure_group", "n_target_drugs", "regimen_pos", "event_pos", squeeze(F.col("original_expression")).alias("original_expression"), squeeze(F.col("meddra_pt")).alias("meddra_pt"),
        squeeze(F.col("meddra_pt_zh")).alias("meddra_pt_zh"), squeeze(F.col("onset")).alias("onset"), squeeze(F.col("severity")).alias("severity"), choice(F.col("outcome"), OUTCOMES, "unknown").alias("outcome"), conf.alias("confidence"),
    )
    key = ["log_line", "exposure_group", "n_target_drugs"]
    fields = ["original_expression", "meddra_pt", "meddra_pt_zh", "onset", "severity", "outcome", "confidence"]
    first = rows.groupBy(*key, F.lower("original_expression").alias("_e"), F.lower("meddra_pt").alias("_p"), F.lower("onset").alias("_o")).agg(F.min(F.struct("regimen_pos", "event_pos", *fields)).alias("f"))
    return first.select(*key, F.struct("log_line", "f.regimen_pos", "f.event_pos").alias("ordinal"), *[F.col(f"f.{c}") for c in fields])


def terms(dictionary: DataFrame) -> DataFrame:
    """``pt_key, pt_code, pt_term``: one row per term, case ignored.

    Where a term occurs again the last line wins, by the reader's ``_file``
    and ``_pos``. A table without them has no line order: there the greatest
    code wins.
    """
    order = [c for c in ("_file", "_pos") if c in dictionary.columns]
    d = dictionary.where("pt_term is not null").select(F.lower(squeeze(F.col("pt_term"))).alias("pt_key"), F.struct(*order, "pt_code", F.trim("pt_term").alias("pt_term")).alias("t"))
    return d.groupBy("pt_key").agg(F.max("t").alias("t")).select("pt_key", "t.pt_code", "t.pt_term")


def term_names(dictionary: DataFrame, most: int = MOST_TERMS) -> list[str]:
    """All terms in lower case, for a matcher in every task; a dictionary of
    more than ``most`` terms is refused."""
    rows = terms(dictionary).select("pt_key").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    return sorted(r[0] for r in rows if r[0])


def validated(events: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """Events with ``meddra_pt_code, validated_meddra_pt, meddra_validation``."""
    if dictionary is None:
        return events.withColumns({"meddra_pt_code": F.lit(None).cast("long"), "validated_meddra_pt": F.lit(""), "meddra_validation": F.lit("not_checked")})
    t = terms(dictionary)
    got = events.join(t, F.lower("meddra_pt") == F.col("pt_key"), "left")
    hit = F.col("pt_key").isNotNull() & (F.col("meddra_pt") != "")
    return got.withColumns({"meddra_pt_code": F.when(hit, F.col("pt_code")), "validated_meddra_pt": F.when(hit, F.col("pt_term")).otherwise(""), "meddra_validation": F.when(hit, "exact").otherwise("unmatched")}).drop("pt_key", "pt_code", "pt_term")


def completed(log: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Latest completed lines, and only of ``records`` (record_id) if given."""
    done = latest_per_record(log).where("status = 'completed'")
    return done if records is None else done.join(records.select("record_id").distinct(), "record_id", "left_semi")


class Study:
    """Tables of the latest completed answers of ``log``.

    ``targets`` in their order; ``dictionary`` of terms, if they are to be
    validated; ``records`` (record_id) limits the study to those records.
    Answers are decoded once for all tables.
    """

    def __init__(self, log: DataFrame, targets: list[str], dictionary: DataFrame | None = None, records: DataFrame | None = None):
        self.targets, self.dictionary = targets, dictionary
        scratch = Scratch(log.sparkSession, "study")
        self.done = scratch.put(completed(log, records))
        self.answers = FlatAnswers(self.done)
        self._events: DataFrame | None = None
        self._scratch = scratch

    def _normal(self) -> DataFrame:
        if self._events is None:
            self._events = self._scratch.put(normal_events(self.answers, self.targets))
        return self._events

    def posts(self) -> DataFrame:
        """One row a record: whether and how it is exposed."""
        groups = merged_regimens(self.answers, self.targets).groupBy("log_line").agg(F.array_sort(F.collect_list(F.struct("regimen_pos", "exposure_group"))).alias("g"))  # at most one per set of targets
        got = self.done.join(groups, "log_line", "left")
        g = F.coalesce(F.transform("g", lambda x: x["exposure_group"]), F.array().cast("array<string>"))
        return got.select("record_id", "user_id", "subreddit", F.col("date_text"), (F.size(g) > 0).alias("has_target_exposure"), F.size(g).alias("n_regimens"), F.array_join(g, " | ").alias("exposure_groups"))

    def exposures(self) -> DataFrame:
        """One row per record and exposure group."""
        n = self._normal().groupBy("log_line", "exposure_group").agg(F.count(F.lit(1)).alias("n_events"))
        got = merged_regimens(self.answers, self.targets).join(self.done.select("log_line", "record_id", "user_id", "subreddit", "date_text"), "log_line").join(n, ["log_line", "exposure_group"], "left")
        return got.select("record_id", "user_id", "subreddit", "date_text", "exposure_group", group_type(F.col("n_target_drugs")).alias("group_type"), "n_target_drugs", F.col("n_events").isNotNull().alias("has_adverse_events"))

    def events(self) -> DataFrame:
        """One row per event, with validation and its order in the log."""
        got = validated(self._normal(), self.dictionary).join(self.done.select("log_line", "record_id", "user_id", "subreddit", "date_text"), "log_line")
        return got.select(
            "record_id", "user_id", "subreddit", "date_text", "exposure_group", group_type(F.col("n_target_drugs")).alias("group_type"), "n_target_drugs", "original_expression", F.col("meddra_pt").alias("proposed_meddra_pt"),
            "meddra_pt_zh", "meddra_pt_code", "validated_meddra_pt", "meddra_validation", "onset", "severity", "outcome", "confidence", "ordinal",
        )


Extractor = Callable[[dict], str]
"""A record (record_id, message, context) to an answer's JSON text; it may raise."""


def keyword_extractor(targets: dict[str, list[str]], symptoms: list[str]) -> Extractor:
    """An offline extractor: drugs and symptoms by their names in the text."""
    import json
    import re

    drugs = [(d, re.compile(r"(?<![a-z0-9])(?:" + "|".join(map(re.escape, names)) + r")(?![a-z0-9])", re.I)) for d, names in targets.items()]
    words = re.compile(r"\w+")
    # Terms by their words, so that one pass over a text finds any number of them.
    signs: dict[tuple[str, ...], str] = {}
    for s in symptoms:
        signs.setdefault(tuple(words.findall(s.lower())), s)
    signs.pop((), None)
    sizes = sorted({len(k) for k in signs})

    def signs_in(text: str) -> Iterator[tuple[str, str]]:
        at = [(m.start(), m.end(), m[0].lower()) for m in words.finditer(text)]
        seen = set()
        for i in range(len(at)):
            for n in sizes:
                s = signs.get(tuple(w for _, _, w in at[i : i + n])) if i + n <= len(at) else None
                if s and s not in seen:
                    seen.add(s)
                    yield s, text[at[i][0] : at[i + n - 1][1]]

    def run(row: dict) -> str:
        text = row["message"] or ""
        own = [d for d, p in drugs if p.search(text)]
        events = [{"original_expression": x, "meddra_pt": s, "meddra_pt_zh": "", "onset": "", "severity": "", "outcome": "unknown", "confidence": 0.5} for s, x in signs_in(text)]
        return json.dumps({"regimens": [{"drugs": own, "adverse_events": events}]} if own else {"regimens": []}, ensure_ascii=False)

    return run


def system_prompt(targets: list[str]) -> str:
    """What a model is told before each record."""
    import json

    return f"Read one forum record and report drug exposures with their adverse events as JSON, in the array regimens. Target drugs: {json.dumps(targets, ensure_ascii=False)}. Take events from the focal text only; the thread context explains it."


class ChatExtractor:
    """Extractor over a chat endpoint: system and user prompt in, JSON text out.

    ``send`` takes the request body and gives the answer's text; it may raise.
    """

    def __init__(self, send: Callable[[dict], str], targets: list[str], model_name: str):
        self.send, self.system, self.model_name = send, system_prompt(targets), model_name

    def __call__(self, row: dict) -> str:
        return self.send({"model": self.model_name, "messages": [{"role": "system", "content": self.system}, {"role": "user", "content": row["prompt"]}], "response_format": {"type": "json_object"}})


def backoff(attempt: int) -> None:
    """A pause that doubles with each try, 30 seconds at most."""
    import time

    time.sleep(min(30.0, 2.0 ** (attempt - 1)))


def extract(rows: DataFrame, extractor: Extractor, targets: list[str], model_name: str, attempts: int = 6, wait: Callable[[int], None] = lambda attempt: None, at_once: int = 1) -> DataFrame:
    """Answers for cleaned rows as log lines (columns RESULT).

    One line per row: ``completed`` with the answer, or ``failed`` with the
    error after ``attempts`` tries; ``wait`` is called between tries. Each
    task has ``at_once`` calls under way; rows come to the extractor with
    ``record_id, message, context, prompt``. A task holds one Arrow batch at a
    time; a retried task repeats calls but never lines.
    """
    names = [c.split()[0] for c in RESULT.split(", ")]

    def one(row: tuple[str, str, str, str]) -> tuple[str | None, str | None]:
        error = None
        for k in range(attempts):
            try:
                return extractor(dict(zip(("record_id", "message", "context", "prompt"), row, strict=True))), None
            except Exception as e:  # noqa: BLE001 - any failure becomes a log line
                error = f"{type(e).__name__}: {e}"
                if k + 1 < attempts:
                    wait(k + 1)
        return None, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(at_once) as pool:
            for pdf in frames:
                got = list(pool.map(one, zip(pdf["record_id"], pdf["message"], pdf["context"], pdf["prompt"], strict=True)))
                out = pdf[["record_id", "user_id", "subreddit"]].assign(date_text=pdf["date"], target_drugs=[targets] * len(pdf), model_name=model_name)
                yield out.assign(status=["completed" if e is None else "failed" for _, e in got], extraction=[a for a, _ in got], error_text=[e for _, e in got])[names]

    asked = rows.withColumn("prompt", user_prompt(F.col("context")))
    return asked.select("record_id", "user_id", "subreddit", "date", "message", "context", "prompt").mapInPandas(run, RESULT)
