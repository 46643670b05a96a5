"""Agent notes as markdown files with a YAML head, on the driver's disk."""

from __future__ import annotations

import json
import re
from datetime import datetime
from pathlib import Path


def slug(text: str, length: int = 50) -> str:
    """The driver-side form of ``functions.text.slugify``."""
    s = re.sub(r"[^a-z0-9-]", "", re.sub(r"[\s_]+", "-", text.lower())).strip("-")
    return re.sub("-+", "-", s)[:length].rstrip("-") or "untitled"


def write_note(folder: str, agent: str, title: str, body: str, at: datetime, **fields) -> Path:
    """YYYYMMDD_agent_slug.md, numbered if there is one; never overwrites."""
    base = Path(folder)
    base.mkdir(parents=True, exist_ok=True)
    stem = f"{at:%Y%m%d}_{slug(agent)}_{slug(title)}"
    head = {"title": title, "agent": agent, "created_at": at.isoformat()} | fields
    text = "---\n" + "".join(f"{k}: {json.dumps(v)}\n" for k, v in head.items()) + "---\n\n" + body.rstrip("\n") + "\n"
    for n in range(1, 10_000):
        path = base / (f"{stem}.md" if n == 1 else f"{stem}-{n}.md")
        try:
            with path.open("x", encoding="utf-8") as out:
                out.write(text)
            return path
        except FileExistsError:
            continue
    raise FileExistsError(stem)
