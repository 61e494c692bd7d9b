"""Writing edited rule files: a backup of each file once, then an atomic replacement that is read back.

Rule files are the user's own, on the driver's disk.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid


class RuleWriter:
    """Writes the outcomes of one review session."""

    def __init__(self, root: str, backups: str) -> None:
        self.root, self.backups = root, backups
        self._saved: dict[str, str] = {}

    def backup(self, path: str) -> str:
        """The copy of the file as it was before this session first wrote it."""
        if path not in self._saved:
            os.makedirs(self.backups, exist_ok=True)
            to = os.path.join(self.backups, f"{os.path.basename(path)}.{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}")
            shutil.copyfile(path, to)
            self._saved[path] = to
        return self._saved[path]

    def write(self, path: str, content: str) -> None:
        if os.path.exists(path):
            self.backup(path)
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        draft = os.path.join(os.path.dirname(path), f".draft-{uuid.uuid4().hex}")
        try:
            with open(draft, "w", encoding="utf-8") as f:
                f.write(content)
            os.replace(draft, path)
        finally:
            if os.path.exists(draft):
                os.remove(draft)
        mark = next((x.strip() for x in content.split("\n") if x.strip()), "")
        with open(path, encoding="utf-8") as f:
            if mark not in f.read():
                raise OSError(f"{path} does not hold what was written")

    def write_outcomes(self, outcomes: list) -> list[str]:
        """Write the last text of each edited file, and the files that edits make (beside what they hold already); the
        paths that were written. ``outcomes`` are collected rows of apply_all: one per suggestion under review."""
        last, made = {}, []
        for r in sorted(outcomes, key=lambda r: (r["target_file"], r["ord"])):
            if r["action"] == "skipped" or r["error"]:
                continue
            last[r["target_file"]] = r["content"]
            if r["created_file"]:
                made.append((r["created_file"], r["created_content"]))
        for name, text in made:
            path = os.path.join(self.root, name)
            if os.path.exists(path):
                with open(path, encoding="utf-8") as f:
                    text = f.read().rstrip("\n") + "\n\n" + text
            last[name] = text
        paths = []
        for name, text in last.items():
            if text is not None:
                paths.append(os.path.join(self.root, name))
                self.write(paths[-1], text)
        return paths
