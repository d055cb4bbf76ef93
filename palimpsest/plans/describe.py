"""What an engine with given settings does, as plain data."""

from __future__ import annotations

from collections.abc import Mapping

from ..functions.patterns import EXTRA, KINDS, SCANNERS
from ..sources.files import ALLOWED, Caps
from ..sources.prompts import available, load
from .sanitise import HARD_CAP, Settings


def described(settings: Settings, caps: Caps = Caps(), models: Mapping[str, str] | None = None) -> dict:
    """Stages with their settings, scanners, kinds, files and models; the salt is not among them."""
    return {
        "stages": [
            {"name": "ingestion", "suffixes": list(ALLOWED), "caps": dict(vars(caps))},
            {"name": "detection", "scanners": [s.name for s in SCANNERS], "off_by_default": [s.name for s in EXTRA], "kinds": list(KINDS)},
            {"name": "review", "max_rounds": min(settings.max_rounds, HARD_CAP), "agreement_threshold": settings.agreement_threshold, "models": dict(models or {})},
            {"name": "masking", "style": settings.mask_style, "token_length": settings.token_length, "pseudonyms": "HMAC-SHA256"},
            {"name": "output", "at_rest": "AES-128-CBC with HMAC-SHA256", "reports": "previews only"},
        ]
    }


def described_prompts(folder: str, preview: int = 240) -> dict[str, dict[str, str]]:
    """Version and beginning of the system text of each prompt of a folder."""
    return {n: {"version": (p := load(folder, n)).version, "system_preview": p.system[:preview]} for n in available(folder)}
