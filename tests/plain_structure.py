"""Byte-exact masking of Markdown as a plain loop over lines: what the native expressions are held against.

Masks keep every byte's place: a masked span becomes as many blanks as it has bytes, a masked line the empty line.
"""

from __future__ import annotations

import re

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_FENCE = re.compile(r"\s*(`+|~+)")
_TABLE = re.compile(r"\s*\|[^|]*\|")
_RULED = re.compile(r"[\s|:-]*\Z")
_HEADING = re.compile(r"\s*#{1,6}(?:[\t\n\f\r ]|\Z)")
_ITEM = re.compile(r"\s*(?:[-*+] |[0-9]+[.)][\t\n\f\r ])", re.A)
_REFERENCE = re.compile(r"\s*\[(?:[0-9]+\][ \t:]|\^[^\]]+\]:)")
_NOTE = re.compile(r"\s*#[A-Z] ")
_EMBED = re.compile(r"\s*\[https?://[^\]\n]+:embed:cite\]\Z")
_INLINE = [re.compile(r"``[^\n]*?``|`[^`\n]+`"), re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^>\n]*)?/?>")]
_URL = re.compile(r"(?<=\]\()[^)]*(?=\))")


def _blanks(m: re.Match) -> str:
    return " " * len(m.group().encode())


def without_comments(text: str) -> str:
    """Comments as blanks, byte for byte; line breaks stay. An open comment reaches to the end."""
    return _COMMENT.sub(lambda m: "\n".join(" " * len(part.encode()) for part in m.group().split("\n")), text)


def kinds(lines: list[str]) -> list[str]:
    """What each line of a text without comments is."""
    out: list[str] = []
    matter, fence = False, ""
    for i, line in enumerate(lines):
        if matter or (i == 0 and line.strip() == "---"):
            out.append("front_matter")
            matter = i == 0 or line.strip() != "---"
            continue
        mark = (m := _FENCE.match(line)) and m.group(1) or ""
        if fence:
            out.append("fence")
            if mark[:1] == fence[0] and len(mark) >= len(fence):
                fence = ""
        elif len(mark) >= 3:
            out.append("fence")
            fence = mark
        elif _HEADING.match(line):
            out.append("heading")
        elif _ITEM.match(line):
            out.append("list")
        elif line.lstrip().startswith(">"):
            out.append("quote")
        elif _TABLE.match(line) or ("|" in line and _RULED.match(line)):
            out.append("table")
        elif _EMBED.match(line):
            out.append("embed")
        elif _REFERENCE.match(line):
            out.append("reference")
        elif _NOTE.match(line):
            out.append("code_note")
        else:
            out.append("text" if line.strip() else "blank")
    return out


def mask_lines(text: str, keep_headings: bool = False) -> list[tuple[int, str, str, str]]:
    """Number, raw and masked form and kind of each line."""
    raw = text.split("\n")
    bare = without_comments(text).split("\n") if "<!--" in text else raw
    out = []
    for i, (line, kind) in enumerate(zip(bare, kinds(bare), strict=True)):
        masked = ""
        if kind in ("text", "blank") or (keep_headings and kind == "heading"):
            masked = line
            if "`" in masked or "<" in masked:
                for pattern in _INLINE:
                    masked = pattern.sub(_blanks, masked)
            if "](" in masked:
                masked = _URL.sub(_blanks, masked)
        out.append((i + 1, raw[i], masked, kind))
    return out
