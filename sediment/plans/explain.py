"""Explanations of files: cached ones are reused, the others come from a pluggable explainer."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cache as H

Explainer = Callable[[str], str | None]


def template_explainer(prompt: str) -> str:
    """Needs no model: restates what is known."""
    facts = [line for line in prompt.split("\n")[:4] if ":" in line]
    return "; ".join(facts)


def with_retries(call: Explainer, attempts: int = 2, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Explainer:
    """Try again after errors, waiting twice as long each time; None if all attempts fail."""

    def run(prompt: str) -> str | None:
        for i in range(attempts):
            try:
                return call(prompt)
            except (TimeoutError, ConnectionError, OSError):
                if i + 1 < attempts:
                    sleep(wait * 2**i)
        return None

    return run


def explain(rows: DataFrame, cache: DataFrame, explainer: Explainer = template_explainer, pause: float = 0.0) -> DataFrame:
    """rows(repo, path, owner, repo_name, sha, prompt) to repo, path, cache_key, explanation, source (cache or new).

    Only misses are sent.  With a pause, as limits of a rate need it, all calls of the job are made one after the other in one
    task, whatever the number of partitions; without one, each partition makes its own.
    """
    known = H.lookup(rows, cache).where("explanation IS NOT NULL").select("repo", "path", "cache_key", "explanation", F.lit("cache").alias("source"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for pdf in it:
            out = []
            for p in pdf["prompt"]:
                if not first and pause:
                    time.sleep(pause)
                first = False
                out.append(explainer(p))
            yield pdf[["repo", "path", "cache_key"]].assign(explanation=out, source="new")

    asked = H.misses(rows, cache).select("repo", "path", "cache_key", "prompt")
    new = (asked.repartition(1) if pause else asked).mapInPandas(run, "repo string, path string, cache_key string, explanation string, source string")
    return known.unionByName(new.where("explanation IS NOT NULL AND explanation <> ''"))
