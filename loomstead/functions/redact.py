"""Secrets, synthetic markup and instructions in texts, by JVM regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstead.functions.text import strip

# The marker and the shapes of secrets, in the order in which they are replaced.
MARKER = "[REDACTED]"
PRIVATE_KEY = r"(?is)-----BEGIN(?: [A-Z0-9]+)? PRIVATE KEY-----.*?-----END(?: [A-Z0-9]+)? PRIVATE KEY-----"
TOKENS = [
    r"\bsk-(?:proj-|live-)?[A-Za-z0-9_-]{16,}\b",
    r"\bsk-ant-[A-Za-z0-9_-]{16,}\b",
    r"\bgh[opusr]_[A-Za-z0-9]{20,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"\bAIza[0-9A-Za-z_-]{30,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\b(?:eyJ[A-Za-z0-9_-]{8,}\.){2}[A-Za-z0-9_-]{8,}\b",
]
ASSIGNMENTS = [
    r"(?im)(\bauthorization\s*:\s*(?:bearer|basic)\s+)(?!\[REDACTED\])[^\s,;]+",
    r"(?im)(\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|password|passwd|pwd|secret|private[_-]?key)\b"
    r"\s*(?:=|:))\s*(?:['\"]?)(?!\[REDACTED\])[^\s,'\"}\]]{4,}(?:['\"]?)",
    r"(?im)(\b(?:password|passwd|pwd)\s+is\s+)(?!\[REDACTED\])[^\s,;]+",
]
# Tags of text that is no dialogue, and the openings of instructions.
SYNTHETIC = (
    r"(?is)<(system-reminder|local-command-caveat|local-command-stdout|local-command-stderr|local-command-output|command-name|"
    r"command-message|command-args|tool-result|tool_result|tool-use|tool_use)\b[^>]*>.*?</\1>"
)
INSTRUCTION = (
    r"(?im)(?:^|\n)\s*(?:ignore\s+(?:all\s+)?previous|system\s*:|developer\s*:|run\s+(?:this|the following|powershell|cmd)|"
    r"execute\s+(?:this|the following)|(?:sudo|powershell|cmd(?:\.exe)?|bash|sh)\s+[-/]|curl\s+https?://|invoke-expression\b)"
)


def redact(text: Column) -> Column:
    """The text with everything that looks like a secret replaced; doing it twice changes nothing."""
    out = F.regexp_replace(text, PRIVATE_KEY, MARKER)
    for p in TOKENS:
        out = F.regexp_replace(out, p, MARKER)
    for p in ASSIGNMENTS:
        out = F.regexp_replace(out, p, "$1" + MARKER.replace("$", r"\$"))
    return out


def spoken(text: Column) -> Column:
    """Dialogue without synthetic elements and secrets, stripped."""
    return strip(redact(F.regexp_replace(text, SYNTHETIC, "")))


def taints(text: Column, external: Column | None = None) -> Column:
    """Why a text isn't to be trusted, as a sorted array."""
    marks = [F.lit("untrusted_evidence"), F.when(text.rlike(INSTRUCTION), "executable_instruction")]
    if external is not None:
        marks.append(F.when(external, "externally_processed"))
    return F.array_sort(F.array_compact(F.array(*marks)))
