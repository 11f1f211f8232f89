"""Language models behind the workflows: a chain of models that stand in for each other, and the provider that asks it.

A call is any picklable function (model, prompt, system) -> text that raises when the model doesn't answer.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import regex

from docquarry.functions.model_text import repaired

Call = Callable[[str, str, str], str]


def without_scratch_pad(text: str) -> str:
    """functions.model_text.clean_model_text for one string."""
    text = text.strip()
    if not regex.search(r"^\*\s+Question:.*?\n\*\s+Constraint:", text, regex.DOTALL):
        return text
    kept = [p for p in regex.split(r"\n\s*\n", text) if not p.strip().startswith(("*   Question:", "*   Constraint:", "*   Option"))]
    return "\n\n".join(kept).strip() if kept else text


class Chain:
    """Models in the order of a tier, each tried until one answers."""

    def __init__(self, call: Call, primary: str, complex_: str, fallbacks: tuple[str, ...] = (), pause: float = 0.5, sleep: Callable[[float], None] = time.sleep):
        self.call, self.primary, self.complex, self.fallbacks, self.pause, self.sleep = call, primary, complex_, fallbacks, pause, sleep

    def models(self, tier: str) -> list[str]:
        first = [self.complex, self.primary] if tier in ("complex", "flash") else [self.primary, self.complex]
        return [m for m in dict.fromkeys([*first, *self.fallbacks]) if m]

    def generate(self, prompt: str, system: str = "", tier: str = "primary") -> tuple[str, str]:
        """A reply and the model that gave it; RuntimeError if none does."""
        error: Exception | None = None
        for model in self.models(tier):
            try:
                return without_scratch_pad(self.call(model, prompt, system)), model
            except Exception as e:
                error = e
                self.sleep(self.pause)
        raise RuntimeError(f"no model of the chain answered; the last error: {error}") from error

    def generate_json(self, prompt: str, system: str = "", tier: str = "primary"):
        """The JSON value of a reply and its model; a reply without one is asked for once more, of the complex tier."""
        text, model = self.generate(prompt, system + "\nEnd your reply with one complete, valid JSON value.", tier)
        found = repaired(text)
        if found is not None:
            return json.loads(found), model
        if tier not in ("complex", "flash"):
            return self.generate_json(prompt, system, "complex")
        raise ValueError(f"there is no JSON in the reply: {text[:300]}")


class ChainProvider:
    """Drafts and audits for operators.answers by a chain."""

    def __init__(self, chain: Chain, tier: str = "primary"):
        self.chain, self.tier = chain, tier

    def draft(self, question: str, context: str) -> tuple[str, str]:
        return self.chain.generate(f"Question: {question}\n\nEvidence:\n{context}\n\nAnswer from the evidence alone and name the sources.", "", self.tier)

    def audit(self, question: str, draft: str, context: str):
        shape = '{"status": "supported" | "partially_supported" | "unsupported", "is_grounded": bool, "confidence": 0 to 1, "supported_claims": [], "unsupported_claims": [], "verdict_rationale": ""}'
        data, _ = self.chain.generate_json(f"Question: {question}\n\nAnswer: {draft}\n\nEvidence:\n{context}\n\nCheck each claim of the answer against the evidence. Reply as {shape}.", "", self.tier)
        return data.get("status", "supported"), bool(data.get("is_grounded", True)), float(data.get("confidence", 0.85)), list(data.get("supported_claims", [])), list(data.get("unsupported_claims", [])), str(data.get("verdict_rationale", ""))
