"""Behaviors: what a model is asked, how an answer scores, and when a behavior counts as present.

A scorer is declared by its fields and by log-probabilities with signs, which give both its score and the
gradient of its objective; generating scorers have a score alone."""

from __future__ import annotations

import hashlib
import json
import math
import os
import random
import statistics
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np

from tracewell.functions import tokens as W
from tracewell.functions.canonical import canonical_json
from tracewell.functions.safe_regex import compiled
from tracewell.operators.statistics import linear_quantile
from tracewell.replay import autodiff as A
from tracewell.replay.autodiff import Tensor
from tracewell.replay.model import ModelConfig, forward, trainable

MOST_NEW_TOKENS = 4096
AGGREGATIONS: dict[str, Callable[[list[float]], float]] = {"mean": lambda v: sum(v) / len(v), "min": min, "max": max, "median": statistics.median}
DIRECTIONS = ("greater_is_present", "less_is_present")
MONOTONICITIES = ("none", "nondecreasing", "nonincreasing")


@dataclass(frozen=True)
class View:
    """A model's answers: log-probabilities and greedy continuations of a prompt."""

    config: ModelConfig
    state: dict[str, np.ndarray]

    def _asked(self, prompt: str, completion: list[int]) -> list[int]:
        ids = [W.BOS, *(b + W.OFFSET for b in prompt.encode()), W.SEP, *completion]
        if len(ids) > self.config.context:
            raise ValueError("a probe is longer than the model's context")
        return ids

    def _logits(self, p: dict[str, Tensor], ids: list[int]) -> Tensor:
        array = np.array([ids])
        return forward(self.config, p, array, np.ones_like(array, bool))

    def _term(self, p: dict[str, Tensor], how: str, prompt: str, text: str) -> Tensor:
        """Minus the log-probability of what follows the prompt: a whole completion with its end, or one token."""
        own = [b + W.OFFSET for b in text.encode()]
        if how == "token" and len(own) != 1:
            raise ValueError("a token is one byte")
        ids = self._asked(prompt, [*own, W.EOS] if how == "sequence" else own)
        after = len(self._asked(prompt, [])) - 1
        losses = A.token_losses(self._logits(p, ids[:-1]), np.array([ids[1:]]))
        weights = np.zeros((1, len(ids) - 1), np.float32)
        weights[0, after:] = 1.0
        return A.weighted_sum(losses, weights)

    def log_probability(self, how: str, prompt: str, text: str) -> float:
        return -float(self._term({n: Tensor(v) for n, v in self.state.items()}, how, prompt, text).data)

    def greedy(self, prompt: str, most: int) -> str:
        """The likeliest next token again and again, up to the end token, the context or so many; bytes that aren't UTF-8 are replaced."""
        p = {n: Tensor(v) for n, v in self.state.items()}
        ids, out = self._asked(prompt, []), []
        while len(out) < most and len(ids) < self.config.context:
            token = int(self._logits(p, ids).data[0, -1].argmax())
            if token == W.EOS:
                break
            ids.append(token)
            out.append(token)
        return bytes(t - W.OFFSET for t in out if t >= W.OFFSET).decode(errors="replace")

    def gradient(self, terms: list[tuple[float, str, str, str]], names: list[str]) -> np.ndarray:
        """Of the sum of signed minus log-probabilities (sign, how, prompt, text), flat, in float64."""
        total = np.zeros(sum(self.state[n].size for n in names))
        for sign, how, prompt, text in terms:
            p = {n: Tensor(v) for n, v in self.state.items()}
            self._term(p, how, prompt, text).backward()
            total += sign * np.concatenate([(p[n].grad if p[n].grad is not None else np.zeros_like(self.state[n])).ravel().astype(np.float64) for n in names])
        return total


@dataclass(frozen=True)
class Kind:
    """A kind of scorer: the fields it needs; the log-probabilities whose signed sum is its score; the sign of the objective that
    a gradient is of, minus the score where more of it is better, and the score where it is a loss (none for scorers that generate or choose)."""

    fields: tuple[str, ...]
    terms: tuple[tuple[float, str, str], ...] = ()
    objective: float | None = 1.0


KINDS = {
    "token_log_probability": Kind(("token",), ((1.0, "token", "token"),)),
    "sequence_log_probability": Kind(("completion",), ((1.0, "sequence", "completion"),)),
    "sequence_nll": Kind(("completion",), ((-1.0, "sequence", "completion"),), -1.0),
    "scalar_loss": Kind(("completion",), ((-1.0, "sequence", "completion"),), -1.0),
    "sequence_logprob_margin": Kind(("preferred", "alternative"), ((1.0, "sequence", "preferred"), (-1.0, "sequence", "alternative"))),
    "multiple_choice_margin": Kind(("choices", "correct"), objective=None),
    "greedy_exact_match_rate": Kind(("expected",), objective=None),
    "greedy_regex_match_rate": Kind(("pattern",), objective=None),
}
_OWN = {"prompt", "token", "completion", "preferred", "alternative", "expected", "pattern"}


def value_of(scorer: dict, probe: dict, name: str):
    """A probe's field, or the scorer's; a text mustn't be empty."""
    value = probe.get(name, scorer.get(name))
    if name in _OWN and (not isinstance(value, str) or not value):
        raise ValueError(f"a probe of {scorer['type']} needs the text {name}")
    if name == "choices" and (not isinstance(value, (list, tuple)) or len(value) < 2 or not all(isinstance(c, str) and c for c in value)):
        raise ValueError("a choice is between two texts or more")
    if name == "correct" and (not isinstance(value, int) or isinstance(value, bool) or not 0 <= value < len(value_of(scorer, probe, "choices"))):
        raise ValueError("the correct choice is one of them")
    if name == "max_new_tokens":
        value = 32 if value is None else value
        if not isinstance(value, int) or isinstance(value, bool) or not 1 <= value <= MOST_NEW_TOKENS:
            raise ValueError(f"between 1 and {MOST_NEW_TOKENS} new tokens")
    return value


def check_probe(scorer: dict, probe: dict) -> None:
    """All fields that the scorer takes from the probe or itself, and a pattern of the safe subset."""
    for name in ("prompt", *KINDS[scorer["type"]].fields):
        value = value_of(scorer, probe, name)
        if name == "pattern":
            compiled(value)
    if scorer["type"].startswith("greedy_"):
        value_of(scorer, probe, "max_new_tokens")


def score(view: View, scorer: dict, probe: dict) -> float:
    """One probe's score; a match is 1 or 0, a choice's margin is that over the best other."""
    kind, name = KINDS[scorer["type"]], scorer["type"]
    prompt = value_of(scorer, probe, "prompt")
    if kind.terms:
        out = sum(sign * view.log_probability(how, prompt, value_of(scorer, probe, f)) for sign, how, f in kind.terms)
    elif name == "multiple_choice_margin":
        correct = value_of(scorer, probe, "correct")
        scores = [view.log_probability("sequence", prompt, c) for c in value_of(scorer, probe, "choices")]
        out = scores[correct] - max(s for i, s in enumerate(scores) if i != correct)
    else:
        pattern = compiled(value_of(scorer, probe, "pattern")) if name == "greedy_regex_match_rate" else None
        made = view.greedy(prompt, value_of(scorer, probe, "max_new_tokens"))
        out = float(pattern.fullmatch(made) if pattern else made == value_of(scorer, probe, "expected"))
    if not math.isfinite(out):
        raise ValueError("a score isn't finite")
    return out


def objective_gradient(view: View, scorer: dict, probes: Iterable[dict], names: list[str] | None = None) -> np.ndarray:
    """The mean over probes of the gradient of the scorer's objective; scorers that generate or choose have none."""
    kind, probes = KINDS[scorer["type"]], list(probes)
    if kind.objective is None or not probes:
        raise ValueError(f"no gradient of {scorer['type']}")
    terms = [(kind.objective * sign, how, value_of(scorer, p, "prompt"), value_of(scorer, p, f)) for p in probes for sign, how, f in kind.terms]
    return view.gradient(terms, names or trainable(view.config, view.state)) / len(probes)


@dataclass(frozen=True)
class Contract:
    """A behavior: search probes, sealed probes of their own, control probes, levels, limits, scorer and statistics."""

    search: tuple[dict, ...]
    holdout: tuple[dict, ...]
    controls: tuple[dict, ...]
    threshold: float
    required_effect: float
    drift_limit: float
    scorer: dict = field(default_factory=lambda: {"type": "sequence_log_probability"})
    aggregation: str = "mean"
    direction: str = "greater_is_present"
    monotonicity: str = "none"
    confidence: float = 0.95
    draws: int = 500
    seed: int = 0

    def __post_init__(self):
        if not isinstance(self.scorer, dict) or self.scorer.get("type") not in KINDS:
            raise ValueError(f"a scorer is one of {sorted(KINDS)}")
        unknown = set(self.scorer) - {"type", "max_new_tokens", *KINDS[self.scorer["type"]].fields}
        if unknown:
            raise ValueError(f"the scorer has no fields {sorted(unknown)}")
        if self.aggregation not in AGGREGATIONS or self.direction not in DIRECTIONS or self.monotonicity not in MONOTONICITIES:
            raise ValueError("an aggregation, direction or monotonicity isn't known")
        if not self.search:
            raise ValueError("a contract has search probes")
        if not all(math.isfinite(x) for x in (self.threshold, self.required_effect, self.drift_limit)) or self.required_effect < 0 or self.drift_limit < 0:
            raise ValueError("levels are finite, and an effect or a limit isn't negative")
        if not 0 < self.confidence < 1 or not 1 <= self.draws <= 10_000_000 or not 0 <= self.seed < 1 << 63:
            raise ValueError("confidence lies between 0 and 1, draws between 1 and 10,000,000")
        named = [c["id"] for c in self.controls if c.get("id") is not None]
        if len(named) != len(set(named)):
            raise ValueError("two controls have one id")
        for probe in (*self.search, *self.holdout, *self.controls):
            check_probe(self.scorer, probe)

    def body(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    def content_hash(self) -> str:
        return hashlib.sha256(canonical_json(self.body()).encode()).hexdigest()

    def query_text(self) -> str:
        """What text rankings are asked for: the search prompts and the scorer's texts."""
        return " ".join([*(p["prompt"] for p in self.search), *(self.scorer[f] for f in ("token", "completion", "preferred", "alternative") if isinstance(self.scorer.get(f), str))])

    def search_view(self) -> Contract:
        """The contract as search may see it: without the sealed probes."""
        return Contract(**(self.__dict__ | {"holdout": ()}))

    def verdict(self, scores: list[float]) -> tuple[float, str]:
        """The aggregate, and PRESENT or ABSENT where the whole bootstrap interval of the mean is on one side of the threshold, whatever the aggregate."""
        source, n, combine = random.Random(self.seed), len(scores), AGGREGATIONS[self.aggregation]
        drawn = sorted(math.fsum(scores[source.randrange(n)] for _ in range(n)) / n for _ in range(self.draws))
        tail = (1 - self.confidence) / 2
        low, high = linear_quantile(drawn, tail), linear_quantile(drawn, 1 - tail)
        if self.direction == "greater_is_present":
            state = "PRESENT" if low >= self.threshold else "ABSENT" if high < self.threshold else "UNCERTAIN"
        else:
            state = "PRESENT" if high <= self.threshold else "ABSENT" if low > self.threshold else "UNCERTAIN"
        return combine(scores), state

    def effect(self, original: float, value: float, injects: bool) -> float:
        """How far a removal takes the behavior away, or an injection brings it."""
        gone = original - value if self.direction == "greater_is_present" else value - original
        return -gone if injects else gone


class Holdout:
    """Sealed probes: read once; with a folder once for all processes, by a lease that stays there."""

    def __init__(self, contract: Contract, folder: str | Path | None = None):
        self._probes, self._open = contract.holdout, True
        self._lease = None if folder is None else Path(folder) / f"holdout-{contract.content_hash()}.json"

    def unseal(self, candidate: str = "") -> tuple[dict, ...]:
        """The probes; candidate names what they are read for, and is kept in the lease."""
        if not self._open:
            raise PermissionError("the holdout was evaluated before")
        self._open = False
        if self._lease is not None:
            self._lease.parent.mkdir(parents=True, exist_ok=True)
            try:
                with self._lease.open("x") as out:
                    json.dump({"candidate": candidate, "unsealed": time.time(), "process": os.getpid()}, out)
            except FileExistsError:
                raise PermissionError("the holdout was evaluated before, by another process") from None
        return self._probes
