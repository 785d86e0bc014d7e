"""What an index asks of models: expanding, planning and writing. Defaults need no model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol


class Expander(Protocol):
    def expand(self, question: str) -> str:
        """Other wordings of a question, a line each."""


class Planner(Protocol):
    def step(self, question: str, context: str, observations: list[str]) -> tuple[str, str] | None:
        """The next tool and its input, or None when enough is known."""


class Generator(Protocol):
    def stream(self, prompt: str) -> Iterator[str]:
        """A text, piece by piece."""


class NoExpander:
    def expand(self, question: str) -> str:
        return ""


class ScriptedPlanner:
    """Takes stated steps, one per call."""

    def __init__(self, *steps: tuple[str, str]):
        self.steps = list(steps)

    def step(self, question: str, context: str, observations: list[str]) -> tuple[str, str] | None:
        return self.steps.pop(0) if self.steps else None


class EchoGenerator:
    """Gives the prompt's lines back; stands in where no model is at hand."""

    def stream(self, prompt: str) -> Iterator[str]:
        yield from prompt.splitlines(keepends=True)


@dataclass(frozen=True)
class Models:
    expander: Expander = NoExpander()
    planner: Planner | None = None
    generator: Generator = EchoGenerator()


CODE_PROMPT = "You explain a code base. Answer from the passages below, name the files you rely on, and say so when they do not hold the answer."
DOCUMENT_PROMPT = "You explain a document. Answer from the passages below, name the sections you rely on, and say so when they do not hold the answer."
DIAGRAM_PROMPT = "Explain in a few paragraphs how the parts of this code base depend on each other."
