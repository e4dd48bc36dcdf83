"""Pluggable scorers and judges for the cascade.

A scorer's model is loaded once for each task and sees whole Arrow batches. Where the model cannot be loaded, no text
has a score; where it fails on a batch, the batch is halved until the texts that it fails on stand alone, and only these
have none. Scores that are not finite are none either. The cascade treats a null score as an error that passes to no later layer.
"""

from __future__ import annotations

import collections
import logging
import threading
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.operators.cascade import UNDECIDED, VERDICT, Judge, Scorer, read_verdict

LOG = logging.getLogger(__name__)


def pandas_scorer(load: Callable[[], Callable[[pd.Series], np.ndarray]], text: str = "prompt") -> Scorer:
    """A scorer from `load`, which gives a function from texts to scores in [0, 1]."""

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:
            LOG.exception("the scorer's model cannot be loaded")
            model = None
        for batch in batches:
            texts = batch.dropna()
            found = np.full(len(texts), np.nan) if model is None else scored(model, texts)
            yield pd.Series(np.where(np.isfinite(found), np.clip(found, 0.0, 1.0), None), index=texts.index, dtype=object).reindex(batch.index)

    scores.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return lambda df: df.withColumn("score", F.pandas_udf(scores, T.DoubleType())(left_to_it(df, text)))


def scored(model: Callable[[pd.Series], np.ndarray], texts: pd.Series) -> np.ndarray:
    """The model's scores, NaN for the texts that it fails on."""
    if not len(texts):
        return np.zeros(0)
    try:
        return np.asarray(model(texts), float).reshape(len(texts))
    except Exception:
        half = len(texts) // 2
        return np.concatenate([scored(model, texts[:half]), scored(model, texts[half:])]) if half else np.full(1, np.nan)


def left_to_it(df: DataFrame, text: str) -> Column:
    """The text of undecided rows, null for others, which a function in Python then leaves out."""
    own = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.col(UNDECIDED), own) if UNDECIDED in df.columns else own


def onnx_scorer(path: str, encode: Callable[[list[str]], dict[str, np.ndarray]], attack_label: int = 1, text: str = "prompt") -> Scorer:
    """A scorer from an ONNX classifier at `path` (a file that every worker can read) and a text encoder."""

    def load() -> Callable[[pd.Series], np.ndarray]:
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        wanted = {i.name for i in session.get_inputs()}
        session.run(None, {k: v for k, v in encode(["warm up"]).items() if k in wanted})

        def predict(texts: pd.Series) -> np.ndarray:
            logits = session.run(None, {k: v for k, v in encode(texts.tolist()).items() if k in wanted})[0].astype(float)
            logits[~np.isfinite(logits).all(axis=1)] = np.nan
            if logits.shape[1] == 1:
                return np.exp(-np.logaddexp(0, -logits[:, 0]))
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            return e[:, attack_label] / e.sum(axis=1)

        return predict

    return pandas_scorer(load, text)


def positive(value: object, default: float) -> float:
    """A setting that must be a positive finite number, such as a timeout; else the default."""
    ok = isinstance(value, (int, float)) and not isinstance(value, bool) and np.isfinite(value) and value > 0
    return float(value) if ok else default


class Calls:
    """Many slow calls at once, with an end to each: at most `at_once` run, one that outlasts `timeout` counts as failed and is left behind.

    A failed call is tried `retries` times more (not after a timeout). `per_second` bounds how many begin in a second. A thread that never comes back
    cannot be ended, only left; after `lost_most` of them all further calls fail at once, so that a dead judge does not fill the worker.
    """

    def __init__(self, ask: Callable[[str], str], at_once: int = 8, timeout: float = 30.0, retries: int = 1, per_second: float | None = None, lost_most: int = 64):
        self.ask, self.at_once, self.timeout, self.retries, self.per_second, self.lost_most = ask, max(1, at_once), timeout, retries, per_second, lost_most
        self.lost, self.next_start, self.lock = 0, 0.0, threading.Condition()

    def _pace(self) -> None:
        if self.per_second:
            with self.lock:
                wait = self.next_start - time.monotonic()
                self.next_start = max(self.next_start, time.monotonic()) + 1 / self.per_second
            if wait > 0:
                time.sleep(wait)

    def run(self, questions: list[str]) -> list[str | Exception]:
        """A reply or the exception for each question, in their order."""
        found: list[str | Exception | None] = [None] * len(questions)
        waiting, running = collections.deque(range(len(questions))), {}

        def work(me: object) -> None:
            while True:
                with self.lock:
                    if me in left or not waiting:
                        return
                    i = waiting.popleft()
                self._pace()
                with self.lock:
                    running[me] = (i, time.monotonic() + self.timeout)
                reply: str | Exception = RuntimeError()
                for _ in range(1 + self.retries):
                    try:
                        reply = self.ask(questions[i])
                        break
                    except Exception as e:
                        reply = e
                with self.lock:
                    if me in left:
                        return
                    running.pop(me, None)
                    found[i] = reply
                    self.lock.notify_all()

        left: set[object] = set()

        def start() -> None:
            threading.Thread(target=work, args=(object(),), daemon=True).start()

        for _ in range(min(self.at_once, len(questions))):
            start()
        with self.lock:
            while any(x is None for x in found):
                now = time.monotonic()
                for me, (i, end) in list(running.items()):
                    if end <= now:
                        left.add(me)
                        del running[me]
                        found[i] = TimeoutError()
                        self.lost += 1
                        start()
                if self.lost >= self.lost_most:
                    while waiting:
                        found[waiting.popleft()] = TimeoutError()
                if any(x is None for x in found):
                    self.lock.wait(max(0.001, min((end for _, end in running.values()), default=now + 0.05) - now))
        return found


def text_judge(
    connect: Callable[[], Callable[[str], str]], question: str = "judge_prompt", fallback: str = "BLOCK", at_once: int = 8, timeout: float = 30.0, retries: int = 1, per_second: float | None = None,
) -> Judge:
    """A judge from `connect`, which gives a function from a question to a reply in free text; it never raises.

    Questions of a batch are asked at once, as Calls has it; the function must bear that. A failed call takes the fallback
    (ALLOW or BLOCK), marked by the rationale "degraded: ...".
    """
    fallback = fallback if fallback in ("ALLOW", "BLOCK") else "BLOCK"

    def verdict(reply: str | Exception) -> tuple:
        if isinstance(reply, TimeoutError):
            return fallback, "degraded: timeout", None
        if isinstance(reply, ConnectionError):
            return fallback, "degraded: connection_error", None
        if isinstance(reply, Exception):
            return fallback, "degraded: unexpected_error", None
        return read_verdict(reply) or (fallback, "degraded: malformed_response", None)

    def verdicts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        calls = Calls(connect(), at_once, timeout, retries, per_second)
        for batch in batches:
            asked = [i for i, q in enumerate(batch) if q is not None]
            rows: list[tuple] = [(None, None, None)] * len(batch)
            for i, reply in zip(asked, calls.run([batch.iloc[i] for i in asked]), strict=True):
                rows[i] = verdict(reply)
            yield pd.DataFrame(rows, columns=list(VERDICT.names), index=batch.index)

    verdicts.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return lambda df: df.withColumn("verdict", F.pandas_udf(verdicts, VERDICT)(left_to_it(df, question)))
