"""Planning and running model calls: resume by anti-join, enrichment through an injected client."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from .dedupe import KEY

CONDITIONS = ("direct", "msa_answer", "dialect_aware", "msa_pivot", "msa_restate")
Client = Callable[[str, list[dict], int], str]


def plan(items: DataFrame, models: Sequence[str], conditions: Sequence[str] = ("direct",)) -> DataFrame:
    """Every item under every model and condition, but the baseline variety's own control. Models and conditions are short lists, exploded in place."""
    grid = items.withColumn("model", F.explode(F.array(*map(F.lit, models)))).withColumn("condition", F.explode(F.array(*map(F.lit, conditions))))
    return grid.filter(~((F.col("condition") == "msa_answer") & (F.col("variety") == "msa")))


def remaining(planned: DataFrame, done: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Planned work whose key has no success yet."""
    return planned.join(done.select(*keys).distinct(), list(keys), "left_anti")


def done_keys(log: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    from .dedupe import succeeded

    return log.filter(succeeded(F.col("answer"), F.col("error"))).select(*keys).distinct()


def messages(system: str, user) -> object:
    return labels.chat(("system", F.lit(system)), ("user", user))


def budgets(first: int, most: int) -> Iterator[int]:
    """Output budgets to try when an answer is cut off: doubled up to a cap."""
    n = first
    while n < most:
        yield n
        n *= 2
    yield most


def call(client: Client, model: str, turns: list[dict], first: int = 2048, most: int = 4096, retries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str]:
    """One answer and the model that gave it; empty ones are asked again with a larger budget, failures after exponentially longer waits."""
    tokens = list(budgets(first, most))
    failure: Exception | None = None
    for k in range(retries):
        try:
            for n in tokens:
                got = client(model, turns, n)
                answer, by = got if isinstance(got, tuple) else (got, model)
                if answer.strip():
                    return answer.strip(), by
            return "", by
        except Exception as e:  # noqa: BLE001 - any provider's error is retried
            failure = e
            if k + 1 < retries:
                sleep(wait * 2**k)
    raise failure if failure else RuntimeError("no attempt was made")


def generate(todo: DataFrame, client_factory: Callable[[], Client], retries: int = 3, wait: float = 1.0) -> DataFrame:
    """Rows of ``todo`` (with ``messages`` and, for a pivot, ``pivot_messages``) with answer, pivot_question, resolved_model_id, pivot_model_id, error and timestamp.

    The client is made once for each task. A row that fails for good keeps its error text (300
    characters) and no answer, so a later run tries it again. A pivot question is asked for
    first and takes the place of the last user turn. A client returns a text, or a text and the
    name of the model that gave it. ``model`` is the name asked for, or ``model_id`` where there is one.
    """
    pivots = "pivot_messages" in todo.columns
    schema = todo.drop("messages", "pivot_messages").schema
    for n in ("answer", "pivot_question", "resolved_model_id", "pivot_model_id", "error"):
        schema = schema.add(n, "string")

    def run(batches):
        import pandas as pd

        client = client_factory()
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                turns, pivot, by, answer, of, error = [dict(m) for m in row["messages"]], "", "", "", "", ""
                asked = row.get("model_id") or row["model"]
                try:
                    if pivots and row.get("pivot_messages") is not None:
                        pivot, by = call(client, asked, [dict(m) for m in row["pivot_messages"]], retries=retries, wait=wait)
                        turns[-1]["content"] = pivot
                    answer, of = call(client, asked, turns, retries=retries, wait=wait)
                except Exception as e:  # noqa: BLE001
                    error = str(e)[:300]
                out.append({k: v for k, v in row.items() if k not in ("messages", "pivot_messages")} | {"answer": answer, "pivot_question": pivot, "resolved_model_id": of, "pivot_model_id": by, "error": error})
            yield pd.DataFrame(out, columns=schema.fieldNames())

    return todo.mapInPandas(run, schema).withColumn("timestamp", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def promote(candidates: DataFrame, dialect: str) -> DataFrame:
    """Machine candidates as a final arm, without review."""
    return candidates.select("qid", "question_msa", F.col("dialect_candidate").alias("question_dialect"), "gold_answer", F.lit(dialect).alias("dialect"), "sub_variety", F.lit("provisional_unreviewed").alias("provenance"))


class EchoClient:
    """A deterministic client for runs without a network: it repeats the last user turn."""

    def __call__(self, model: str, turns: list[dict], tokens: int) -> str:
        return turns[-1]["content"]


def models(spark: SparkSession, registry: dict[str, dict]) -> DataFrame:
    """The model registry as a small table."""
    return spark.createDataFrame([(n, r.get("model_id", n), r.get("family", ""), r.get("api", "chat")) for n, r in sorted(registry.items())], "model string, model_id string, family string, api string")
