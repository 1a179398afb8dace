"""Conversations whose history stays here, and a bounded loop of function calls."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import privacy
from gridloom.plans.run import usage_of
from gridloom.sources import scans

#: Hosted tools by their configuration.
WEB_SEARCH = {"type": "web_search"}
CODE_INTERPRETER = {"type": "code_interpreter", "container": {"type": "auto"}}
#: Rounds after which a loop of function calls gives up.
MAX_ROUNDS = 8
Service = Callable[[dict[str, Any]], dict[str, Any]]


class StatelessConversation:
    """Each turn sends all earlier items and the new message; a turn that fails never enters the history.

    service: request -> response with status, output (items), output_text, id, usage. With a deidentifier, prompts and
    instructions are masked before they are sent, in one scope.
    """

    def __init__(self, service: Service, *, model: str, instructions: str | None = None, spark: SparkSession | None = None, deidentifier: privacy.Deidentifier | None = None):
        self.service, self.model, self.spark, self.deidentifier = service, model, spark, deidentifier
        self.said: list[str] = []
        self.instructions = self._masked(instructions) if instructions is not None else None
        self.history: list[dict[str, Any]] = []

    def _masked(self, text: str) -> str:
        """The text masked in one scope with all that was masked before it, so placeholders stay."""
        if self.deidentifier is None:
            return text
        self.said.append(text)
        rows = self.spark.createDataFrame([(i, "conversation", i, t) for i, t in enumerate(self.said)], "key int, scope string, seq int, text string")
        return privacy.masked(rows, self.deidentifier).filter(F.col("key") == len(self.said) - 1).first()["text"]

    def send(self, prompt: str) -> dict[str, Any]:
        if not isinstance(prompt, str) or not prompt.strip():
            raise ValueError("prompt must be a non-empty string")
        items = [*self.history, {"role": "user", "content": self._masked(prompt)}]
        request = {"model": self.model, "input": items, "store": False}
        if self.instructions is not None:
            request["instructions"] = self.instructions
        response = self.service(request)
        if response.get("status", "completed") != "completed":
            from gridloom.errors import ResponseError

            raise ResponseError(response.get("status"), response.get("incomplete_reason"), response.get("id"))
        self.history = [*items, *response.get("output", [])]
        return {"text": response.get("output_text"), "id": response.get("id"), "usage": usage_of(response.get("usage"))}


def tool_loop(service: Service, prompt: str, tools: dict[str, Callable[..., str]], specs: list[dict[str, Any]], model: str, rounds: int = MAX_ROUNDS) -> str:
    """The answer to a prompt, after at most `rounds` rounds of function calls; a call of an unknown tool is an error."""
    items: list[dict[str, Any]] = [{"role": "user", "content": prompt}]
    for _ in range(rounds):
        response = service({"model": model, "input": items, "tools": specs})
        items += response.get("output", [])
        calls = [x for x in response.get("output", []) if x.get("type") == "function_call"]
        if not calls:
            return response.get("output_text") or ""
        for call in calls:
            if call["name"] not in tools:
                raise ValueError(f"Unknown tool: {call['name']}")
            items.append({"type": "function_call_output", "call_id": call["call_id"], "output": tools[call["name"]](**json.loads(call.get("arguments") or "{}"))})
    raise RuntimeError(f"Tool loop exceeded {rounds} rounds")


def study_agent(spark: SparkSession, service: Service, folder: str, prompt: str, model: str) -> str:
    """The answer to a question about a study folder, which the model may list and read (bounded) for up to twelve turns."""
    listing = lambda: json.dumps([r.asDict() for r in scans.study_files(spark, folder).collect()])  # noqa: E731  a study is some files
    tools = {"list_study_files": listing, "read_study_file": lambda path: scans.read_study_file(path, folder)}
    text = {"path": {"type": "string"}}
    specs = [{"type": "function", "name": n, "parameters": {"type": "object", "properties": p, "required": list(p), "additionalProperties": False}} for n, p in (("list_study_files", {}), ("read_study_file", text))]
    return tool_loop(service, prompt, tools, [*specs, CODE_INTERPRETER], model, rounds=12)


def inventory(transcripts: DataFrame, items: DataFrame) -> DataFrame:
    """One row: transcripts_found, usable_transcripts, items, possible_jobs, ready, issues. transcripts: filename, text."""
    blank = F.coalesce(F.trim(F.regexp_replace("text", "(?U)\\s+", " ")), F.lit("")) == ""
    own = transcripts.agg(F.count("*").alias("transcripts_found"), F.count_if(~blank).alias("usable_transcripts"))
    names = transcripts.filter(blank).agg(F.array_sort(F.collect_list("filename")).alias("blank"))
    own = own.crossJoin(items.agg(F.count("*").alias("items"))).crossJoin(names)  # one row each
    own = own.withColumn("possible_jobs", F.col("usable_transcripts") * F.col("items")).withColumn("ready", F.size("blank") == 0)
    issues = F.when(F.col("ready"), F.expr("cast(array() as array<string>)")).otherwise(F.array(F.concat(F.lit("Blank transcripts: "), F.array_join("blank", ", "))))
    return own.select("transcripts_found", "usable_transcripts", "items", "possible_jobs", "ready", issues.alias("issues"))


def inspect_study(spark: SparkSession, folder: str) -> str:
    """The inventory of a study folder (transcripts/*.txt, items.csv) as JSON, for a function tool."""
    texts = scans._texts(spark, f"{folder}/transcripts", pathGlobFilter="*.txt").select("filename", F.col("value").alias("text"))
    row = inventory(texts, scans.item_bank(spark, f"{folder}/items.csv")).first()
    return json.dumps(row.asDict())
