"""Pipeline specs: the accepted keys, and the checks made before any plan is built."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from dataclasses import dataclass, field, fields
from typing import Any

from millrace.errors import SpecError
from millrace.registry import OPERATORS, SOURCES

log = logging.getLogger(__name__)

# Source names of a step that fetches nothing, and routing words.
NO_SOURCE = ("passthrough", "none", "")
MODES = ("batch", "chained_loop")
NEXT, END = "NEXT", "END"


@dataclass(frozen=True)
class Rule:
    operator: str
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Routing:
    next_step: str | None = None
    condition: str | None = None


@dataclass(frozen=True)
class ErrorHandling:
    code_field: str = "errcode"
    msg_field: str = "errmsg"
    on_error: str = "pause_for_manual"
    success_value: Any = None


@dataclass(frozen=True)
class Response:
    """How the rows of a captured response are read (all optional)."""

    dataset: str | None = None
    columns: Any = None
    join: dict[str, Any] | None = None
    wrapper: tuple[str, ...] = ()


@dataclass(frozen=True)
class Input:
    name: str
    label: str | None = ""
    type: str = "string"
    required: bool = True
    default: Any = None
    description: str | None = ""
    columns: list[dict] = field(default_factory=list)


@dataclass(frozen=True)
class Step:
    step_id: str
    output_dataset: str
    driver: str = "passthrough"
    mode: str = "batch"
    endpoint: str | None = None
    inputs: list[str] = field(default_factory=list)
    variables: dict[str, Any] = field(default_factory=dict)
    transformations: list[Rule] = field(default_factory=list)
    retry_config: dict[str, Any] | None = None
    error_handling: ErrorHandling | None = None
    routing: Routing | None = None
    output_config: dict[str, Any] | None = None
    response: Response = Response()
    # Write the output (and parsed responses) once; for steps that several others read.
    materialize: bool = False

    @property
    def fetches(self) -> bool:
        return self.driver not in NO_SOURCE and bool(self.endpoint)


@dataclass(frozen=True)
class Spec:
    workflow_id: str
    steps: list[Step] = field(default_factory=list)
    inputs: list[Input] = field(default_factory=list)
    workflow_name: str | None = ""
    workflow_type: str = "business"
    domain_path: str | None = ""
    description: str | None = ""


def parse_spec(raw: dict | Spec) -> Spec:
    """Build a :class:`Spec` from a JSON-like dict; raises :class:`SpecError` on bad keys."""
    if isinstance(raw, Spec):
        return raw
    problems: list[str] = []

    def build(kind, data: dict, where: str, **converted):
        known = {f.name for f in fields(kind)}
        for key in sorted(set(data) - known):
            problems.append(f"{where}: unknown key '{key}'")
        values = {k: v for k, v in data.items() if k in known}
        values.update(converted)
        try:
            return kind(**values)
        except TypeError as error:
            problems.append(f"{where}: {error}")
            return None

    steps = []
    for index, step in enumerate(raw.get("steps") or []):
        where = f"step {step.get('step_id', index)}"
        converted: dict[str, Any] = {
            key: [] if key in ("inputs", "transformations") else {}
            for key in ("inputs", "variables", "transformations")
            if step.get(key) is None
        }
        if step.get("transformations"):
            converted["transformations"] = [build(Rule, rule, where) for rule in step["transformations"]]
        for key, kind in (("routing", Routing), ("error_handling", ErrorHandling), ("response", Response)):
            if step.get(key) is not None:
                converted[key] = build(kind, step[key], f"{where} {key}")
        steps.append(build(Step, step, where, **converted))
    inputs = [build(Input, item, f"input {item.get('name')}") for item in raw.get("inputs") or []]
    spec = build(Spec, raw, "spec", steps=steps, inputs=inputs)
    if problems:
        raise SpecError(problems)
    return spec


def check_spec(spec: Spec, given: Iterable[str] = ()) -> list[str]:
    """Problems that would make a run fail; an empty list means the spec is sound.

    ``given`` names the tables the caller supplies.
    """
    problems: list[str] = []
    if not spec.steps:
        problems.append("a pipeline needs at least one step")
    position: dict[str, int] = {}
    for index, step in enumerate(spec.steps):
        if step.step_id in position:
            problems.append(f"step {step.step_id}: Duplicate step_id")
        position.setdefault(step.step_id, index)

    produced = {*given, *[item.name for item in spec.inputs]}
    for index, step in enumerate(spec.steps):
        where = f"step {step.step_id}"
        if step.driver not in NO_SOURCE and step.driver not in SOURCES:
            problems.append(f"{where}: source '{step.driver}' is not registered")
        if step.mode not in MODES:
            problems.append(f"{where}: unknown mode '{step.mode}'")
        if step.mode == "chained_loop" and not step.inputs:
            problems.append(f"{where}: mode 'chained_loop' needs inputs")
        for rule in step.transformations:
            if rule.operator not in OPERATORS:
                problems.append(f"{where}: operator '{rule.operator}' is not registered")
        target = step.routing.next_step if step.routing else None
        if target and target not in (NEXT, END):
            if target not in position:
                problems.append(f"{where}: next_step '{target}' does not exist")
            elif position[target] <= index:
                problems.append(f"{where}: next_step '{target}' goes backward")
        for name in step.inputs:
            if name and name not in produced and not name.startswith("ds_"):
                log.warning("%s reads '%s', which no earlier step produces", where, name)
        produced.add(step.output_dataset)
    return problems
