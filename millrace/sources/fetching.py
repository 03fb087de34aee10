"""Responses fetched by the caller's own function, once for every different request.

The function gets some requests at a time, each as a dict of its values and its ``body``,
and returns ``(status_code, body)`` for each, in order. It runs inside a Python table
function over the distributed table of requests, so calls run side by side and no more
than a batch of requests and replies is held. When it raises, the requests of that batch
are tried one by one, and those that still fail carry the exception's text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import written_table

Fetch = Callable[[list[dict]], Iterable[tuple[int | None, str | None]]]

#: Column that holds why a request has no reply.
PROBLEM = "__problem"
_BODY = "body"


def fetched_responses(requests: DataFrame, fetch: Fetch, batch: int = 100) -> DataFrame:
    """``requests`` (request values and ``body``) with ``status_code``, the reply's ``body`` and why there is none.

    The replies are written once, so that nothing is fetched again when several later
    tables read them. A task that is lost and runs again repeats its own requests.
    """
    values = [f for f in requests.schema.fields if f.name != _BODY]
    reply = [T.StructField("status_code", T.IntegerType()), T.StructField(_BODY, T.StringType()), T.StructField(PROBLEM, T.StringType())]
    names = [f.name for f in values]

    @F.udtf(returnType=T.StructType([*values, *reply]))
    class Fetching:
        def __init__(self) -> None:
            self.held: list[dict] = []

        def eval(self, row: T.Row):
            self.held.append(row.asDict())
            if len(self.held) >= batch:
                yield from self.replies()

        def terminate(self):
            yield from self.replies()

        def replies(self):
            asked, self.held = self.held, []
            if not asked:
                return
            try:
                found = [(status, body, None) for status, body in fetch(asked)]
                if len(found) != len(asked):
                    raise ValueError(f"{len(found)} replies to {len(asked)} requests")
            except Exception:
                found = [self.alone(request) for request in asked]
            for request, got in zip(asked, found, strict=True):
                yield (*[request[n] for n in names], *got)

        def alone(self, request: dict) -> tuple[int | None, str | None, str | None]:
            try:
                ((status, body),) = fetch([request])
                return status, body, None
            except Exception as error:
                return None, None, f"{type(error).__name__}: {error}"

    return written_table(Fetching(requests.asTable()))
