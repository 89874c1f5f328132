"""Judges: what decides a label. A stub by rules, a replay of saved answers, or an HTTP model."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: The labels' names by number; the label where all else fails.
NAMES = ("entailment", "neutral", "contradiction")
FALLBACK = 1


class Judge(Protocol):
    """Gives requests (id, prompt, ..) an answer text."""

    def ask(self, requests: DataFrame) -> DataFrame: ...


def request_hash(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON with sorted keys and no spaces."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))).cast("binary"), 256)


class StubJudge:
    """A label by a Column expression over the request: deterministic, inside generated code."""

    def __init__(self, label: Column):
        self.label = label

    def ask(self, requests: DataFrame) -> DataFrame:
        return requests.withColumn("answer", F.concat(F.lit('{"label":'), self.label.cast("string"), F.lit("}")))


class SaidJudge:
    """An answer text by a Column expression over the request; null where the call fails."""

    def __init__(self, answer: Column):
        self.answer = answer

    def ask(self, requests: DataFrame) -> DataFrame:
        return requests.withColumn("answer", self.answer)


class ReplayJudge:
    """Saved answers (request, answer) by request hash; the first kept on a clash, else a default."""

    def __init__(self, saved: DataFrame, default: str = '{"label":1}'):
        once = saved.groupBy("request").agg(F.min_by("answer", "order").alias("answer"))
        self.saved, self.default = once, default

    def ask(self, requests: DataFrame) -> DataFrame:
        got = requests.join(self.saved, "request", "left")
        return got.withColumn("replayed", F.col("answer").isNotNull()).withColumn("answer", F.coalesce("answer", F.lit(self.default)))


def wait_before(status: int | str, tries: int, retry_after: float | None = None) -> float | None:
    """Seconds to wait before the next try, or None to give up: server errors, timeouts and lost
    connections once, after 2 s; a full queue twice, after what it asks or 2 and 4 s, 10 at most."""
    if status == 429:
        return None if tries > 2 else min(10.0, retry_after if retry_after is not None else 2.0**tries)
    if status in ("timeout", "lost") or isinstance(status, int) and status >= 500:
        return None if tries > 1 else 2.0
    return None


class Reply(NamedTuple):
    """What an endpoint sent: status (a number, "timeout" or "lost"), text, tokens and headers."""

    status: int | str
    text: str = ""
    input_tokens: int = 0
    output_tokens: int = 0
    retry_after: float | None = None
    headers: Mapping[str, str] = {}


#: Requests that a run may add for endpoint fallbacks; headers that tell who answered.
EXTRA = 3
IDENTITY = ("server", "x-backend", "x-model", "via")


def identity(headers: Column, names: Sequence[str] = IDENTITY) -> Column:
    """Of headers (a map) those that tell who answered, by names in lower case."""
    low = F.transform_keys(headers, lambda k, v: F.lower(k))
    return F.map_filter(low, lambda k, v: k.isin(*names))


class Pace:
    """At least so many seconds between the starts of two requests of a partition."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.seconds, self.clock, self.sleep, self.last = seconds, clock, sleep, None

    def wait(self) -> None:
        now = self.clock()
        if self.last is not None and now - self.last < self.seconds:
            self.sleep(self.seconds - (now - self.last))
        self.last = self.clock()


class HttpJudge:
    """Sends prompts by `post(prompt, options) -> Reply`, a partition at a time.

    Retries by wait_before(); the tokens of all attempts count. An endpoint that refuses the
    response format gets the request without it, one that refuses the model's name the next of
    `models`; what worked stays for the partition, which adds EXTRA requests so at most.
    """

    def __init__(self, post: Callable[[str, dict], Reply], sleep: Callable[[float], None] = time.sleep, *, models: Sequence[str] = ("default",), schema: dict | None = None, pace: Pace | None = None):
        self.post, self.sleep, self.models, self.schema, self.pace = post, sleep, list(models), schema, pace

    def start(self) -> dict:
        return {"model": self.models[0], "others": self.models[1:], "format": self.schema, "extra": EXTRA}

    def one(self, prompt: str, state: dict | None = None) -> tuple[str | None, int, int, int]:
        """(text, attempts, input tokens, output tokens); no text where all failed."""
        state = self.start() if state is None else state
        tries = tokens_in = tokens_out = attempts = 0
        while True:
            if self.pace:
                self.pace.wait()
            attempts += 1
            got = self.post(prompt, {"model": state["model"], "response_format": state["format"]})
            tokens_in, tokens_out = tokens_in + got.input_tokens, tokens_out + got.output_tokens
            if got.status == 200:
                return got.text, attempts, tokens_in, tokens_out
            if got.status == 400 and state["format"] is not None and "response_format" in got.text and state["extra"]:
                state["format"], state["extra"] = None, state["extra"] - 1
                continue
            if got.status in (400, 404) and "model" in got.text and state["others"] and state["extra"]:
                state["model"], state["others"], state["extra"] = state["others"][0], state["others"][1:], state["extra"] - 1
                continue
            tries += 1
            wait = wait_before(got.status, tries, got.retry_after)
            if wait is None:
                return None, attempts, tokens_in, tokens_out
            self.sleep(wait)

    def ask(self, requests: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state = self.start()
            for b in batches:
                got = [self.one(p, state) for p in b["prompt"]]
                yield b.assign(answer=[x[0] for x in got], attempts=[x[1] for x in got], input_tokens=[x[2] for x in got], output_tokens=[x[3] for x in got])

        schema = ", ".join(f"`{n}` {t}" for n, t in requests.dtypes)
        return requests.mapInPandas(run, f"{schema}, answer string, attempts int, input_tokens int, output_tokens int")


def first_object(text: str | None) -> dict | None:
    """The first JSON object anywhere in a text."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text or ""):
        try:
            got, _ = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    return None


def as_label(value: object) -> int | None:
    """A label from a number, its digit or its name; true and false are none."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, int) or isinstance(value, float) and value.is_integer():
        return int(value) if 0 <= value < len(NAMES) else None
    text = str(value).strip().lower()
    if text.isdigit():
        return int(text) if int(text) < len(NAMES) else None
    return NAMES.index(text) if text in NAMES else None


def label_of(text: str | None) -> int | None:
    """The label an answer states: in a JSON object, else in prose if all statements agree."""
    found = first_object(text)
    if found is not None and "label" in found:
        return as_label(found["label"])
    said = {as_label(x) for x in re.findall(r"\blabel\s*(?:is|:|=)\s*\"?(\w+)", text or "", re.I)} - {None}
    return said.pop() if len(said) == 1 else None


@F.pandas_udf(IntegerType())
def _parsed(answers: pd.Series) -> pd.Series:
    return answers.map(label_of).astype("Int32")


def parsed(answer: Column) -> Column:
    """label_of() of a column; the usual form is read without Python."""
    usual = F.regexp_extract(answer, r'^\s*\{"label":\s*([012])\}\s*$', 1)
    return F.when(usual != "", usual.try_cast("int")).otherwise(_parsed(answer))


def numbers_of(text: str | None, key: str) -> list[int]:
    """The numbers listed under a key of an answer's JSON: whole numbers and digits in quotes; true and false are none."""
    found = first_object(text)
    given = found.get(key) if found else None
    if not isinstance(given, list):
        return []
    out = []
    for x in given:
        if isinstance(x, int) and not isinstance(x, bool):
            out.append(x)
        elif isinstance(x, str) and x.strip().isdigit():
            out.append(int(x.strip()))
    return out


def numbers(answer: Column, key: str) -> Column:
    """numbers_of() of a column; a plain list of numbers is read without Python."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(answers: pd.Series) -> pd.Series:
        return answers.map(lambda t: numbers_of(t, key) if t is not None else None)

    plain = rf'^\s*\{{[^{{}}\[\]]*"{key}":\s*\[([\d,\s]*)\][^{{}}\[\]]*\}}\s*$'
    inside = F.regexp_extract(answer, plain, 1)
    usual = F.transform(F.filter(F.split(inside, r"\s*,\s*"), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("int"))
    return F.when(answer.rlike(plain), usual).otherwise(run(F.when(~answer.rlike(plain), answer)))


def word_label(answer: Column, field: str, words: Mapping[str, int]) -> Column:
    """The label that a word in a field of the answer's JSON stands for; null for any other word."""
    said = F.lower(F.trim(F.get_json_object(_object(answer), f"$.{field}")))
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in words.items() for x in kv)), said)


def boolean(answer: Column, field: str) -> Column:
    """true or false as a field of the answer's JSON says it, not in quotes; else null."""
    value = F.regexp_extract(_object(answer), rf'"{field}"\s*:\s*(true|false)\b', 1)
    return F.when(value == "true", True).when(value == "false", False)


def texts_of(answer: Column, field: str) -> Column:
    """The text or texts in a field of the answer's JSON, trimmed, without empty ones."""
    given = F.get_json_object(_object(answer), f"$.{field}")
    many = F.from_json(given, "array<string>")
    one = F.when(~given.startswith("["), F.array(given))
    return F.filter(F.transform(F.coalesce(one, many, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def _object(answer: Column) -> Column:
    """The first flat JSON object in a text: as far as its fields are plain values or lists."""
    return F.regexp_extract(answer, r"(?s)\{[^{}]*\}", 0)


def valid(label: Column, name: Column | None = None) -> Column:
    """A label given as JSON text: 0, 1 or 2 as a number, with its own name if one is given; else null."""
    got = F.when(label.rlike("^[012]$"), label).try_cast("int")
    if name is None:
        return got
    return F.when(name.isNull() | (name == F.element_at(F.array(*map(F.lit, NAMES)), got + 1)), got)


def answer_form(answer: Column) -> Column:
    """How an answer is written: exact JSON, JSON spaced otherwise, JSON with text, other, none."""
    inside = answer.rlike(r"\{[^{}]*\}")
    return (
        F.when(answer.isNull() | (F.trim(answer) == ""), "none")
        .when(answer.rlike(r'^\{"[a-z_]+":("[^"]*"|[0-9.]+)(,"[a-z_]+":("[^"]*"|[0-9.]+))*\}$'), "exact")
        .when(answer.rlike(r"^\s*\{[^{}]*\}\s*$"), "spaced")
        .when(inside, "with text")
        .otherwise("other")
    )


def tournament(a: Column, b: Column, tiebreak: Column) -> Column:
    return F.when(a == b, a).otherwise(tiebreak)


def negated(label: Column, of_negation: Column) -> Column:
    """What the negated claim implies replaces a neutral label only."""
    implied = F.element_at(F.array(F.lit(2), F.lit(1), F.lit(0)), of_negation + 1)
    return F.when((label == 1) & of_negation.isNotNull(), implied).otherwise(label)


def parts_combined(labels: Column) -> Column:
    """Any contradiction decides; all entailed is entailment; else neutral."""
    return F.when(F.exists(labels, lambda x: x == 2), 2).when((F.size(labels) > 0) & F.forall(labels, lambda x: x == 0), 0).otherwise(1)


def second_look(first: DataFrame, asked: Column, judge: Judge, key: str = "id") -> DataFrame:
    """Asks again the rows that `asked` picks; an answer that parses replaces the label."""
    again = judge.ask(first.where(asked).drop("answer", "replayed")).select(key, parsed(F.col("answer")).alias("again"))
    return first.join(again, key, "left").withColumn("label", F.coalesce("again", "label")).drop("again")
