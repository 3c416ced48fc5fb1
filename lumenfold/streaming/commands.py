"""Commands: JSON-RPC requests, parameters as the latest value per key, and camera moves as sums."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes of JSON-RPC 2.0.
PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS, SERVER_ERROR = -32700, -32600, -32601, -32602, -32000


def handle(request: str, methods: dict[str, Callable[..., object]]) -> str | None:
    """The answer to one request; a notification (without an id) gets none."""
    def answer(key, **kw) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": key, **kw})

    def error(key, code: int, message: str) -> str:
        return answer(key, error={"code": code, "message": message})

    try:
        call = json.loads(request)
    except ValueError:
        return error(None, PARSE_ERROR, "not JSON")
    if not isinstance(call, dict) or call.get("jsonrpc") != "2.0" or not isinstance(call.get("method"), str):
        return error(call.get("id") if isinstance(call, dict) else None, INVALID_REQUEST, "not a request")
    key, silent = call.get("id"), "id" not in call
    method, params = methods.get(call["method"]), call.get("params", {})
    if method is None:
        return None if silent else error(key, METHOD_NOT_FOUND, call["method"])
    try:
        result = method(**params) if isinstance(params, dict) else method(*params)
    except TypeError as e:
        return None if silent else error(key, INVALID_PARAMS, str(e))
    except Exception as e:
        return None if silent else error(key, SERVER_ERROR, str(e))
    return None if silent else answer(key, result=result)


def latest(commands: DataFrame, *, key: str = "key", value: str = "value", order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """The last value of every key; on a stream, the state is one row a key."""
    return commands.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def moved(commands: DataFrame) -> DataFrame:
    """Sums of mouse moves, scaled by frame times: ``dx, dy, zoom`` of each camera."""
    by = F.coalesce(F.col("frame_ms") / 32.0, F.lit(1.0))
    return commands.groupBy("camera").agg(*[F.sum(F.col(c) * by).alias(c) for c in ("dx", "dy", "zoom")])


def follow(commands: DataFrame, render: Callable[[dict[str, str]], None], **options):
    """Start a stream that renders after each batch, with the latest value of every key so far."""
    def batch(df: DataFrame, _: int) -> None:
        # one row a parameter
        render({r["key"]: r["value"] for r in df.collect()})

    writer = latest(commands).writeStream.outputMode("complete").foreachBatch(batch)
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer
