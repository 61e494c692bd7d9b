"""The model call as a pluggable row function.

A backend is a function from prompt to answer. Prompts are written before they are sent, calls run in as many partitions as
may be open at once, and an error becomes a column, so one failed call never fails the others.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.functions import text as X

CONCURRENCY = 3
TIMEOUT_S = 120


def command_backend(argv: list[str], timeout_s: int = TIMEOUT_S) -> Callable[[str], str]:
    """Runs a command with the prompt on its standard input."""

    def call(prompt: str) -> str:
        done = subprocess.run(argv, input=prompt, capture_output=True, text=True, timeout=timeout_s, check=False)
        if done.returncode:
            raise RuntimeError(f"exit code {done.returncode}: {done.stderr[:200]}")
        return done.stdout

    return call


def call(prompts: DataFrame, backend: Callable[[str], str], concurrency: int = CONCURRENCY) -> DataFrame:
    """Adds raw, error, value (a variant, null if no JSON is found) and tokens_used to prompts(key, prompt)."""
    shape = prompts.schema.simpleString()[len("struct<") : -1]

    def run(frames):
        for pdf in frames:
            raw, errors = [], []
            for prompt in pdf["prompt"]:
                try:
                    raw.append(backend(prompt))
                    errors.append(None)
                except Exception as e:  # an answer that failed is a row, not a failed job
                    raw.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pdf.assign(raw=raw, error=errors)

    answered = prompts.repartition(concurrency).mapInPandas(run, f"{shape},raw:string,error:string".replace(":", " "))
    return parse(answered)


def replay(prompts: DataFrame, recorded: DataFrame) -> DataFrame:
    """The same from recorded(prompt_hash, raw): answers are joined by the prompt's digest."""
    keyed = prompts.withColumn("prompt_hash", F.sha2(F.col("prompt").cast("binary"), 256))
    joined = keyed.join(recorded.select("prompt_hash", "raw"), "prompt_hash", "left").drop("prompt_hash")
    return parse(joined.withColumn("error", F.when(F.col("raw").isNull(), "no recorded answer")))


def parse(answered: DataFrame) -> DataFrame:
    tokens = F.ceil(F.length("prompt") / 4) + F.coalesce(F.ceil(F.length("raw") / 4), F.lit(0))
    return answered.withColumn("value", X.model_json(X.unwrap_envelope(F.col("raw")))).withColumn("tokens_used", tokens.cast("long"))
