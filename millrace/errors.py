"""Exceptions raised while a pipeline is composed or checked."""

from __future__ import annotations


class PipelineError(Exception):
    """Any failure of a pipeline run."""


class SpecError(PipelineError):
    """The pipeline spec is not usable; ``problems`` lists every finding."""

    def __init__(self, problems: list[str]):
        self.problems = problems
        super().__init__("; ".join(problems))


class MissingTable(PipelineError):
    """A step asked for a table no earlier step produced."""


class ConditionError(PipelineError):
    """A routing condition could not be evaluated."""


class TransportFailure(PipelineError):
    """A captured response was not delivered or not readable."""


class BusinessFailure(PipelineError):
    """A captured response carries an error code."""

    def __init__(self, code: str | None, message: str | None):
        self.code = code
        self.message = message
        super().__init__(f"business error [{code}]: {message}")
