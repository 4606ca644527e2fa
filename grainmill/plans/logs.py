"""A logger on the driver, to the terminal and to a file that no earlier run wrote."""

from __future__ import annotations

import logging
import sys
from pathlib import Path


def logger(name: str = "grainmill", terminal: bool = True, folder: str | None = None, append: bool = False) -> logging.Logger:
    """Handlers of an earlier call under this name are closed. In ``folder`` the file is <name>.log, or the first
    <name>-<number>.log that is not there yet, unless lines are to be appended."""
    out = logging.getLogger(name)
    for handler in list(out.handlers):
        out.removeHandler(handler)
        handler.close()
    out.setLevel(logging.INFO)
    out.propagate = False
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stdout)] if terminal else []
    if folder is not None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        path, k = Path(folder) / f"{name}.log", 0
        while path.exists() and not append:
            k += 1
            path = Path(folder) / f"{name}-{k}.log"
        handlers.append(logging.FileHandler(path, encoding="utf-8"))
    for handler in handlers:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        out.addHandler(handler)
    return out
