"""Edits of Markdown texts as pure functions of strings: find sections and lines, insert, replace, remove, split.

They are what the per-file grouped functions of ``operators.edits`` run on executors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_LEVEL = re.compile(r"(#{1,6})\s")


def squeeze(line: str) -> str:
    return re.sub(r"\s+", " ", line.strip()).lower()


@dataclass(frozen=True)
class Section:
    start: int  # index of the heading
    end: int  # index after the last line, at the next heading of the same or a higher level
    level: int


def find_section(lines: list[str], title: str) -> Section | None:
    """The first section with that title, in any case."""
    heading = re.compile(rf"(#{{1,6}})\s+{re.escape(title)}\s*$", re.IGNORECASE)
    start = next((i for i, x in enumerate(lines) if heading.match(x)), None)
    if start is None:
        return None
    level = len(heading.match(lines[start])[1])
    ends = (i for i in range(start + 1, len(lines)) if (m := _LEVEL.match(lines[i])) and len(m[1]) <= level)
    return Section(start, next(ends, len(lines)), level)


def trimmed_end(lines: list[str], section: Section) -> int:
    """The section's end without trailing blank lines; never before the line after its heading."""
    end = section.end
    while end > section.start + 1 and not lines[end - 1].strip():
        end -= 1
    return end


def insertion_line(content: str, title: str | None) -> int:
    """After which line (from 1) new text for a section goes; the last line if there is none."""
    lines = content.split("\n")
    section = find_section(lines, title) if title else None
    return trimmed_end(lines, section) if section else len(lines)


def _alike(a: str, b: str) -> bool:
    a, b = squeeze(a), squeeze(b)
    return a in b or b in a


def locate(content: str, wanted: str) -> list[tuple[int, str]] | None:
    """Numbered lines of the text that hold the wanted lines: a contiguous block, else each line's first hit."""
    lines, needles = content.split("\n"), [x.strip() for x in wanted.split("\n") if x.strip()]
    if not needles:
        return None
    for at in range(len(lines) - len(needles) + 1):
        if all(_alike(lines[at + j], x) for j, x in enumerate(needles)):
            return [(at + j + 1, lines[at + j]) for j in range(len(needles))]
    hits = (next(((i + 1, x) for i, x in enumerate(lines) if _alike(x, n)), None) for n in needles)
    return [h for h in hits if h] or None


def mostly_present(content: str, new: str, share: float = 0.8) -> bool:
    """Whether more than a share of the new text's lines stand in the text already."""
    have, want = {squeeze(x) for x in content.split("\n")}, [squeeze(x) for x in new.split("\n") if x.strip()]
    return bool(want) and sum(x in have for x in want) / len(want) > share


def append(content: str, new: str) -> str:
    return f"{content.rstrip()}\n\n{new}\n"


def insert(content: str, new: str, title: str | None) -> str:
    """At the end of the section; a missing section is appended, and without a title the text is."""
    if not title:
        return append(content, new)
    lines = content.split("\n")
    section = find_section(lines, title)
    if section is None:
        return append(content, f"## {title}\n\n{new}")
    head = lines[: section.end]
    while head and not head[-1].strip():
        head.pop()
    return "\n".join([*head, "", new, "", *lines[section.end :]])


def replace(content: str, old: str, new: str) -> str | None:
    """The first occurrence, literally; else the first block of lines that is equal but for spaces and case."""
    if old in content:
        return content.replace(old, new, 1)
    lines, wanted = content.split("\n"), [squeeze(x) for x in old.split("\n") if x.strip()]
    if not wanted:
        return None
    flat = [squeeze(x) for x in lines]
    at = next((i for i in range(len(flat) - len(wanted) + 1) if flat[i : i + len(wanted)] == wanted), None)
    if at is None:
        return None
    return "\n".join([*lines[:at], *([new] if new else []), *lines[at + len(wanted) :]])


def collapse(content: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", content)


def cut_section(content: str, title: str) -> tuple[str, str] | None:
    """(the text without the section, the section as a text of its own with its headings raised)."""
    lines = content.split("\n")
    section = find_section(lines, title)
    if section is None:
        return None

    def raised(line: str) -> str:
        m = _LEVEL.match(line)
        return "#" * max(1, len(m[1]) - section.level + 1) + line[len(m[1]) :] if m else line

    body = "\n".join(map(raised, lines[section.start : section.end])).rstrip() + "\n"
    return collapse("\n".join(lines[: section.start] + lines[section.end :])), body
