"""Row functions backed by a model: any client, each key asked once, replies kept before they are used."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame

from folioforge.functions.reply import parse_reply


class Client:
    """The interface: ask(history, prompt) gives a reply. This one answers by arithmetic, for tests."""

    name = "stub"

    def ask(self, history: list[dict], prompt: str) -> str:
        return json.dumps({"score": len(prompt) % 10})


def ask_for_json(client, prompt: str, repairs: int = 2) -> tuple[str | None, str, int]:
    """(JSON text or None, last reply, turns): asks, and asks again up to `repairs` times while the reply is no JSON; a cut reply isn't repaired."""
    history: list[dict] = []
    said = ""
    for turn in range(1 + repairs):
        said = client.ask(history, prompt if not turn else "Reply with the JSON alone; escape quotes inside strings.")
        got = parse_reply(said)
        if got["json"] is not None and not got["truncated"]:
            return json.dumps(got["json"], ensure_ascii=False), said, turn + 1
        if got["truncated"]:
            break
        history += [{"role": "user", "content": prompt}, {"role": "assistant", "content": said}]
    return None, said, turn + 1


def answered(rows: DataFrame, key: str, prompt: str, client, cache: DataFrame | None = None) -> DataFrame:
    """(key, reply, raw, turns, model) of each row not in `cache` (same columns), and the cache's rows. Replies that stay no JSON have a null reply and keep raw.

    Calls aren't repeatable for free: write the result before using it.
    """
    todo = rows.select(key, prompt)
    if cache is not None:
        todo = todo.join(cache.select(key), key, "left_anti")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = [ask_for_json(client, p or "") for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int32()), pa.array([client.name] * len(got), pa.string())], names=["key", "reply", "raw", "turns", "model"])

    new = todo.mapInArrow(run, f"key {kind}, reply string, raw string, turns int, model string").withColumnRenamed("key", key)
    return new if cache is None else cache.select(*new.columns).unionByName(new)
