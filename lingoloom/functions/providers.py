"""Pluggable providers: translating, distilling and normalising, run inside Python workers.

A provider is any picklable object with the method. Of some, the first that answers counts: with something in it for translations and
standard forms, with any list for rules. No provider here calls a network; the dictionary ones serve tests and demos.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TranslationProvider(Protocol):
    def translate(self, strings: dict[str, str], source: str, target: str, rules: dict) -> dict[str, str] | None: ...


class DistillingProvider(Protocol):
    def distil(self, corrections: list[dict], rules: list[dict], source: str, target: str) -> list[dict] | None: ...


class NormalisingProvider(Protocol):
    def normalise(self, words: list[str], language: str) -> dict[str, str] | None: ...


@dataclass
class Dictionary:
    """Translates word by word, takes each correction as a rule, and cuts plural endings. Strings with the refused word are an error."""

    words: dict[str, str] = field(default_factory=dict)
    refused: str = ""

    def translate(self, strings: dict[str, str], source: str, target: str, rules: dict) -> dict[str, str]:
        if self.refused and any(self.refused in v.split(" ") for v in strings.values()):
            raise RuntimeError(f"refused: {self.refused}")
        return {k: " ".join(self.words.get(w, w) for w in v.split(" ")) for k, v in strings.items()}

    def distil(self, corrections: list[dict], rules: list[dict], source: str, target: str) -> list[dict]:
        return [{"rule_name": c["machine_draft"][:40], "rule_type": "terminology", "source_term": c["machine_draft"], "target_term": c["human_correction"], "confidence_percent": 50, "feedback_ids": [c["id"]]} for c in corrections]

    def normalise(self, words: list[str], language: str) -> dict[str, str]:
        return {w: w[:-1] for w in words if w.endswith("s")}


def first_answer(providers: Sequence, method: str, *args: object, empty: bool = False) -> object:
    """The first provider's answer that isn't missing (nor empty, unless allowed); none is an error."""
    for p in providers:
        answer = getattr(p, method)(*args)
        if answer or (empty and answer is not None):
            return answer
    raise RuntimeError(f"no provider answered: {method}")


def translate(items: DataFrame, providers: Sequence[TranslationProvider], source: str, keys: Sequence[str] = ("id",)) -> DataFrame:
    """items: keys, target_language, strings (map), guidance. Gives keys, target_language, translated (map of the asked keys) and error. A
    failed item has an error and no map. Keys must tell items apart: ids alone do so only within a type."""
    names = [*keys, "target_language"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out, errors = [], []
            for target, strings, rules in zip(part["target_language"], part["strings"], part["guidance"], strict=True):
                asked = dict(strings)
                try:
                    answer = first_answer(providers, "translate", asked, source, target, {"guidance": rules})
                    kept = {k: v for k, v in answer.items() if k in asked and isinstance(v, str)}
                    if not kept:
                        raise RuntimeError("the answer has none of the strings")
                    out.append(kept)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one item's failure is its own
                    out.append(None)
                    errors.append(str(e))
            yield part[names].assign(translated=out, error=errors)

    kinds = ", ".join(f"{n} {items.schema[n].dataType.simpleString()}" for n in names)
    return items.select(*names, "strings", "guidance").mapInPandas(run, f"{kinds}, translated map<string,string>, error string")


_CANDIDATE = "target_language string, id bigint, rule_name string, rule_type string, rule_text string, source_term string, target_term string, search_keywords string, confidence_percent int, feedback_ids array<bigint>, seq bigint, error string"


def distil(batch: DataFrame, providers: Sequence[DistillingProvider], source: str) -> DataFrame:
    """Rule candidates of a batch (id, target_language, source_text, machine_draft, human_correction, context: JSON list of rules),
    language by language. A run's batch size bounds each group. A language whose providers fail gives one row with the error alone."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        target = part["target_language"].iloc[0]
        part = part.sort_values("id")
        rules = json.loads(part["context"].iloc[0] or "[]")
        rows = part[["id", "source_text", "machine_draft", "human_correction"]].to_dict("records")
        names = [x.split(" ")[0] for x in _CANDIDATE.split(", ")]
        blank = {"id": 0, "rule_name": "", "rule_type": "", "rule_text": "", "source_term": None, "target_term": None, "search_keywords": "", "confidence_percent": 0, "feedback_ids": [], "error": None}
        try:
            made = first_answer(providers, "distil", rows, rules, source, target, empty=True)
        except Exception as e:  # noqa: BLE001  raised here, it would have the task repeated and the provider asked again
            return pd.DataFrame([blank | {"target_language": target, "seq": 0, "error": str(e)}], columns=names)
        return pd.DataFrame([blank | m | {"target_language": target, "seq": i} for i, m in enumerate(made) if isinstance(m, dict)], columns=names)

    return batch.groupBy("target_language").applyInPandas(run, _CANDIDATE)


#: Empty answers on end after which a text's further words are not asked about.
EMPTY = 2


def normalise(words: DataFrame, providers: Sequence[NormalisingProvider], language: str) -> DataFrame:
    """(language, word, standard_form) of the words of texts' batches (item_id, batch_id, word) that a provider reduces.

    A text's batches are asked one after another, as each decides whether the next one is asked: a failure or an answer with none of the words
    is empty, and EMPTY of these on end are the last. Texts are asked side by side.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        kept, empty = [], 0
        for _, batch in sorted(part.groupby("batch_id")):
            asked = sorted(batch["word"])
            try:
                answer = first_answer(providers, "normalise", asked, language, empty=True)
            except Exception:  # noqa: BLE001
                answer = {}
            found = [(language, w, answer[w]) for w in asked if isinstance(answer.get(w), str) and answer[w]]
            kept += found
            empty = 0 if found else empty + 1
            if empty >= EMPTY:
                break
        return pd.DataFrame(kept, columns=["language", "word", "standard_form"])

    item = F.col("item_id") if "item_id" in words.columns else F.lit(0).alias("item_id")
    return words.select(item, "batch_id", "word").groupBy("item_id").applyInPandas(run, "language string, word string, standard_form string")
