"""Prompt files: front matter between lines of dashes, then sections under ## headings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path


@dataclass(frozen=True)
class Prompt:
    name: str
    version: str = "0"
    role: str = "text"
    sections: dict[str, str] = field(default_factory=dict)

    @property
    def system(self) -> str:
        return self.sections.get("system", "")

    @property
    def template(self) -> str:
        """Body, output schema and guardrails, as far as there are any."""
        return "\n\n".join(s for k in ("body", "output_schema", "guardrails") if (s := self.sections.get(k)))

    def render(self, **values: object) -> str:
        """The template with {{name}} filled in, once; unknown names stay as they are."""
        return re.sub(r"\{\{(\w+)\}\}", lambda m: str(values[m[1]]) if m[1] in values else m[0], self.template)


def parse(name: str, text: str) -> Prompt:
    meta: dict[str, str] = {}
    if m := re.match(r"---(.*?)---", text, re.S):
        meta = {k.strip(): v.strip() for k, colon, v in (line.partition(":") for line in m[1].splitlines()) if colon}
        text = text[m.end() :]
    parts = re.split(r"(?m)^## (.*)$", text)
    sections = {h.strip().lower().replace(" ", "_"): b.strip() for h, b in zip(parts[1::2], parts[2::2])}
    return Prompt(meta.get("name", name), meta.get("version", "0"), meta.get("role", "text"), sections)


@lru_cache(maxsize=64)
def load(folder: str, name: str) -> Prompt:
    return parse(name, (Path(folder) / f"{name}.md").read_text(encoding="utf-8"))


def available(folder: str) -> list[str]:
    return sorted(p.stem for p in Path(folder).glob("*.md"))


def reload() -> None:
    load.cache_clear()
