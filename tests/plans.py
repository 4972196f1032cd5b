"""Text of physical plans, for assertions on them."""

from __future__ import annotations

import contextlib
import io


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def scan_part(df, name: str) -> str:
    """The lines of the Parquet scans that start with `name`."""
    return "\n".join(line for line in plan(df).splitlines() if line.startswith(f"{name}:"))
