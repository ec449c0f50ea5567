"""Requests to, and answers from, an outside model: bodies, schemas, decoding and errors.

A transport (bytes in; status and bytes out) is passed in; there is no default one, so nothing is ever sent unasked.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

#: Seconds that a request may take, and tokens that an answer may have.
TIMEOUT, MOST_TOKENS = 120, 16_000

RULE_FIELDS = {"id": "integer", "rule_name": "string", "rule_type": "string", "rule_text": "string", "source_term": "string", "target_term": "string", "search_keywords": "string", "confidence_percent": "integer"}


def object_schema(fields: dict[str, str]) -> dict:
    """A JSON schema of an object with exactly these fields."""
    return {"type": "object", "properties": {k: {"type": t} for k, t in fields.items()}, "required": list(fields), "additionalProperties": False}


def rules_schema() -> dict:
    one = object_schema(RULE_FIELDS)
    one["properties"]["feedback_ids"] = {"type": "array", "items": {"type": "integer"}}
    return {"type": "object", "properties": {"rules": {"type": "array", "items": one}}, "required": ["rules"], "additionalProperties": False}


def pairs_schema() -> dict:
    return {"type": "object", "properties": {"forms": {"type": "array", "items": object_schema({"word": "string", "standard_form": "string"})}}, "required": ["forms"], "additionalProperties": False}


def request(system: str, user: object, schema: dict, model: str) -> bytes:
    """A request's body: instructions, the payload as JSON, and the schema that the answer must have."""
    body = {"model": model, "max_tokens": MOST_TOKENS, "system": system, "messages": [{"role": "user", "content": json.dumps(user, ensure_ascii=False)}], "output_format": {"type": "json_schema", "schema": schema}}
    return json.dumps(body, ensure_ascii=False).encode()


def error_text(body: bytes) -> str:
    """The message of an error answer, or the answer as it is."""
    text = body.decode(errors="replace")
    try:
        return str(json.loads(text)["error"]["message"])
    except (ValueError, KeyError, TypeError):
        return text


def decoded(body: bytes) -> object:
    """What an answer's first text block holds; a refused, cut or unreadable answer is an error."""
    try:
        reply = json.loads(body)
    except ValueError as e:
        raise RuntimeError("the answer can't be read") from e
    stop = reply.get("stop_reason")
    if stop in ("refusal", "max_tokens"):
        raise RuntimeError(f"the answer ended early: {stop}")
    text = next((b.get("text") for b in reply.get("content", []) if b.get("type") == "text"), None)
    try:
        return json.loads(text)
    except (TypeError, ValueError) as e:
        raise RuntimeError("the answer can't be read") from e


@dataclass
class Remote:
    """A provider of all three kinds behind a transport."""

    transport: Callable[[bytes], tuple[int, bytes]]
    model: str = "model"

    def ask(self, system: str, user: object, schema: dict) -> dict:
        status, body = self.transport(request(system, user, schema, self.model))
        if status != 200:
            raise RuntimeError(error_text(body))
        found = decoded(body)
        if not isinstance(found, dict):
            raise RuntimeError("the answer is no object")
        return found

    def translate(self, strings: dict[str, str], source: str, target: str, rules: dict) -> dict[str, str]:
        system = "\n\n".join(filter(None, [f"Translate the values from {source} to {target}. Keep the keys, the markup and the meaning.", rules.get("guidance")]))
        answer = self.ask(system, strings, object_schema(dict.fromkeys(strings, "string")))
        kept = {k: v for k, v in answer.items() if k in strings and isinstance(v, str)}
        if not kept:
            raise RuntimeError("the answer has none of the strings")
        return kept

    def distil(self, corrections: list[dict], rules: list[dict], source: str, target: str) -> list[dict]:
        system = f"Find rules for translating from {source} to {target} that explain these corrections. Refine a known rule by its id; use 0 for new ones."
        found = self.ask(system, {"corrections": corrections, "rules": rules}, rules_schema()).get("rules")
        return [r for r in found if isinstance(r, dict)] if isinstance(found, list) else []

    def normalise(self, words: list[str], language: str) -> dict[str, str]:
        found = self.ask(f"Give the dictionary form of each {language} word.", {"words": words}, pairs_schema()).get("forms")
        pairs = [(f.get("word"), f.get("standard_form")) for f in found if isinstance(f, dict)] if isinstance(found, list) else []
        return {w: s for w, s in pairs if w in set(words) and isinstance(s, str) and s.strip()}
