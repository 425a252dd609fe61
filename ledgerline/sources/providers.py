"""External services behind one form: requests in, responses out.

A provider is a function ``resolve(requests) -> (request_key, response, error)`` over DataFrames with a ``request_key``.
Requests are collapsed to distinct ones first, and answers are joined back, so that a service is asked once for equal
requests. ``replayed`` looks responses up in a recorded table; ``live`` calls a function inside ``mapInPandas`` and is the
only one that leaves the cluster. The simulated default needs no provider: it is part of the row's own plan.
"""

from __future__ import annotations

import os
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as x

#: Seconds a service is waited for, and pauses between calls of one task.
TIMEOUTS = {"geocode": 10, "poi": 15, "fuzzy": 15, "web": 15, "chat": 30, "translate": 20}
PAUSE = 0.1


Resolver = Callable[[DataFrame], DataFrame]


def request_key(*columns: Column | str) -> Column:
    """A name for the values, in which their borders count; a missing value is the empty text."""
    values = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("", *[F.concat(F.length(v).cast("string"), F.lit(":"), v) for v in values]), 256)


def verification_key(company: str, address: str, country: str, lat: str, lon: str) -> Column:
    """Equal for companies and addresses that differ in spelling only, at places that agree in five decimals."""
    place = [F.when(~F.isnan(c), F.round(c, 5)) for c in (F.col(lat).cast("double"), F.col(lon).cast("double"))]
    return request_key(x.normalize_text(company), x.normalize_text(address), F.upper(x.text(country)), *place)


def ask_once(df: DataFrame, columns: list[str], resolve: Resolver, out: str = "response", key: Column | None = None, order: str | None = None, wanted: Column | None = None, budget: int = 0) -> DataFrame:
    """``df`` with the provider's answer to each row's ``columns`` in ``out``, and what went wrong in ``<out>_error``.

    Equal requests are sent once, those of equal ``key`` (by default of equal columns) in the form that comes first by
    ``order``. Rows that are not ``wanted`` ask nothing and get nulls. With a ``budget`` only the first so many requests by
    ``order`` are sent, a feature of paid services.
    """
    test = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    # rows that ask nothing have keys of their own, so that no task gets them all
    keyed = df.withColumn("request_key", F.when(test, request_key(*columns) if key is None else key).otherwise(F.concat(F.lit("-"), F.xxhash64(*columns, *([order] if order else [])).cast("string"))))
    first = F.min_by(F.struct(*columns), F.col(order) if order else F.struct(*columns))
    requests = keyed.filter(test).groupBy("request_key").agg(first.alias("_r"), *([F.min(order).alias("_o")] if order else []))
    if budget:
        requests = requests.orderBy("_o" if order else "request_key").limit(budget)
    answers = resolve(requests.select("request_key", "_r.*")).select("request_key", F.col("response").alias(out), F.col("error").alias(f"{out}_error"))
    # unless there is a budget, how many requests there are does not show in the size of the files they come from
    return keyed.join(answers if budget else answers.hint("merge"), "request_key", "left").drop("request_key")


def replayed(recorded: DataFrame) -> Resolver:
    """From a table (request_key, response) and, where calls failed, error."""
    error = F.col("error") if "error" in recorded.columns else F.lit(None).cast("string")
    return lambda requests: requests.select("request_key").join(recorded.select("request_key", "response", error.alias("error")), "request_key")


def live(call: Callable[[dict], str], pause: float = PAUSE) -> Resolver:
    """From ``call(request) -> JSON text``, one call at a time in each task; an error leaves the response null and says
    why in ``error``."""

    def resolve(requests: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out = []
                for row in pdf.to_dict("records"):
                    time.sleep(pause)
                    try:
                        out.append((row["request_key"], call(row), None))
                    except Exception as e:
                        out.append((row["request_key"], None, str(e)[:200]))
                yield pd.DataFrame(out, columns=["request_key", "response", "error"])

        return requests.mapInPandas(run, "request_key string, response string, error string")

    return resolve


def recorded_once(resolve: Resolver, folder: str) -> Resolver:
    """The same answers, written to a new table in ``folder`` first and read from there, so that no plan that is evaluated
    again, or retried after a lost executor, asks the service twice; ``replayed`` can read them later."""

    def run(requests: DataFrame) -> DataFrame:
        path = f"{folder.rstrip('/')}/answers-{uuid.uuid4().hex}"
        resolve(requests).select("request_key", "response", "error").write.parquet(path)
        return requests.sparkSession.read.parquet(path)

    return run


@dataclass(frozen=True)
class Services:
    """Who answers what; a service that is None is simulated or left out."""

    translate: Resolver | None = None
    geocode: Resolver | None = None
    poi_by_name: Resolver | None = None
    poi_by_address: Resolver | None = None
    fuzzy: Resolver | None = None
    web: Resolver | None = None
    web_budget: int = 0
    adjudicate: Resolver | None = None
    enrich: Resolver | None = None

    def recorded(self, folder: str) -> Services:
        """The same services, each writing down its answers."""
        here = {f.name: getattr(self, f.name) for f in fields(self)}
        return replace(self, **{n: recorded_once(r, f"{folder}/{n}") for n, r in here.items() if callable(r)})

    @property
    def verifies(self) -> bool:
        return None not in (self.poi_by_name, self.poi_by_address, self.fuzzy)


def service_url(url: str | None) -> str | None:
    """A base URL with its scheme and without a final slash; null for a blank one."""
    value = (url or "").strip()
    if not value:
        return None
    return (value if re.match("^https?://", value, re.I) else f"https://{value}").rstrip("/")


def chat_url(base: str | None, deployment: str, version: str) -> str | None:
    """Where chat requests go: a full address as it is, else the deployment's under the base."""
    base = service_url(base)
    if base is None or "/chat/completions" in base.lower() or "/responses" in base.lower():
        return base
    return f"{base}/openai/deployments/{deployment}/chat/completions?api-version={version}"


def fuzzy_url(poi_url: str | None) -> str | None:
    return re.sub(r"/search/poi/json/?$", "/search/fuzzy/json", poi_url.rstrip("/")) if poi_url else None


def read_env(text: str) -> dict[str, str]:
    """The settings of a ``.env`` file: NAME=value lines, with or without ``export`` and quotes; ``#`` starts a comment."""
    out = {}
    for line in text.splitlines():
        name, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and name.strip() and not name.startswith("#"):
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
            out[name.strip()] = value[1:-1] if quoted else value.split(" #")[0].strip()
    return out


def setting(name: str, given: str | None = None, env_file: str | None = None) -> str | None:
    """A setting passed by the caller, else from the environment, else from a ``.env`` file. Settings are never read out of
    scripts."""
    if found := given or os.environ.get(name):
        return found
    if env_file and os.path.exists(env_file):
        with open(env_file, encoding="utf-8") as f:
            return read_env(f.read()).get(name) or None
    return None
