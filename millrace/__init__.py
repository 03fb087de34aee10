"""Declarative table pipelines expressed as lazy Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in tasks travel with the task, so executors need no
# copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from millrace.context import RunContext  # noqa: E402
from millrace.errors import (  # noqa: E402
    BusinessFailure,
    ConditionError,
    MissingTable,
    PipelineError,
    SpecError,
    TransportFailure,
)
from millrace.registry import OPERATORS, SOURCES  # noqa: E402

import millrace.operators  # noqa: E402, F401  (registers the named operators)
import millrace.sources  # noqa: E402, F401  (registers the named sources)

from millrace.plans.pipeline import PipelineRun, loop_requests, run_pipeline  # noqa: E402
from millrace.plans.spec import check_spec, parse_spec  # noqa: E402

__all__ = [
    "BusinessFailure",
    "ConditionError",
    "MissingTable",
    "OPERATORS",
    "PipelineError",
    "PipelineRun",
    "RunContext",
    "SOURCES",
    "SpecError",
    "TransportFailure",
    "check_spec",
    "loop_requests",
    "parse_spec",
    "run_pipeline",
]
