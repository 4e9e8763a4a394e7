"""Path aliases of a project's tsconfig.json, a single small file that the driver reads."""

from __future__ import annotations

import json
import os


def read_aliases(root: str) -> list[tuple[str, str]]:
    """(prefix, folder) in the file's order; the first target of each pattern counts. Without a readable, valid file there are none."""
    try:
        with open(os.path.join(root, "tsconfig.json")) as f:
            options = json.load(f).get("compilerOptions", {})
    except (OSError, ValueError):
        return []
    base, out = options.get("baseUrl", "."), {}
    for pattern, targets in options.get("paths", {}).items():
        if targets:
            folded = pattern.endswith("/*")
            target = targets[0].removesuffix("/*") if folded else targets[0]
            out[pattern.removesuffix("/*") if folded else pattern] = os.path.normpath(os.path.join(base, target))
    return list(out.items())
