"""Calls to recognition services through a client that is passed in; nothing is recognised here.

A client takes a list of payloads and gives (HTTP status, list of answers). Retries follow the
kind of call: documents are asked for again after connection errors and 429, 500, 502, 503, 504,
lines after 429 and 503 only; three attempts, 2, 4 and 8 seconds apart.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor, wait

import pandas as pd
from pyspark.sql import DataFrame

#: Answers that are asked for again, attempts, payloads of one request.
RETRY = {"document": frozenset((429, 500, 502, 503, 504)), "line": frozenset((429, 503))}
ATTEMPTS, MOST_PAYLOADS = 3, 256
#: Requests in flight at a time, and bytes they may take; a payload takes about four times its own size on its way.
IN_FLIGHT, BUDGET, TRANSPORT = 2, 256 * 1024 * 1024, 4
Client = Callable[[list], tuple[int, list]]


def call(client: Client, payloads: list, kind: str, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> list:
    """Answers in the order of the payloads; a failure that may not be retried, or a wrong count, raises."""
    for attempt in range(attempts):
        try:
            status, answers = client(payloads)
        except (ConnectionError, TimeoutError):
            if kind != "document" or attempt + 1 == attempts:
                raise
        else:
            if 200 <= status < 300:
                if len(answers) != len(payloads):
                    raise ValueError(f"{len(payloads)} payloads, {len(answers)} answers")
                return answers
            if status not in RETRY[kind] or attempt + 1 == attempts:
                raise RuntimeError(f"service answered {status}")
        sleep(2.0 ** (attempt + 1))
    raise RuntimeError("no attempts were allowed")


class Permanent(RuntimeError):
    """An answer that asking again would not change."""


def in_order(payloads: Iterable[bytes], ask: Callable[[bytes], object], in_flight: int = IN_FLIGHT, budget: int = BUDGET) -> Iterator[object]:
    """Answers in the order of the payloads, a bounded number of them asked for ahead.

    A payload waits until it fits the budget beside those under way; one that is larger than the budget goes alone. After a
    failure the requests under way are let finish, the failed one is asked for once more, and from then on one at a time;
    a `Permanent` failure is raised at its turn.
    """
    ahead: deque[tuple[bytes, Future]] = deque()
    slots = in_flight

    def settle() -> object:
        nonlocal slots
        payload, answer = ahead.popleft()
        error = answer.exception()
        if error is None:
            return answer.result()
        if isinstance(error, Permanent):
            raise error
        slots = 1
        wait([f for _, f in ahead])
        return ask(payload)

    with ThreadPoolExecutor(in_flight) as pool:
        for payload in payloads:
            while ahead and (len(ahead) >= slots or TRANSPORT * (len(payload) + sum(len(p) for p, _ in ahead)) > budget):
                yield settle()
            ahead.append((payload, pool.submit(ask, payload)))
        while ahead:
            yield settle()


def recognise(requests: DataFrame, payload: str, key: str, client: Client, kind: str = "line", size: int = MOST_PAYLOADS) -> DataFrame:
    """(key, answer) of each request, in batches of up to `size` within a partition; equal keys are asked for once."""
    source = requests.select(key, payload).dropDuplicates([key])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                yield pd.DataFrame({key: part[key], "answer": call(client, part[payload].tolist(), kind)})

    return source.mapInPandas(run, f"`{key}` {dict(source.dtypes)[key]}, answer string")
