"""Styles of one's own from a config module: a Python file that sets STYLES to a style or several.

The nearest one is used, looking from a directory upwards as far as a repository's root.
"""

from __future__ import annotations

import importlib.util
from dataclasses import dataclass
from pathlib import Path

from typeloom.plans.styles import STYLES, Style, style_for

CONFIG_NAMES = ("typeloom_config.py", ".typeloom_config.py", "typeloom.config.py", ".typeloom.config.py")


@dataclass(frozen=True)
class Config:
    path: str
    styles: tuple[Style, ...]


@dataclass(frozen=True)
class Listed:
    style: Style
    origin: str  # "config" or "built-in"
    shadowed: bool


def find_config(start: str | Path) -> str | None:
    """The config of `start` or its nearest ancestor; two in one directory are refused."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        found = [folder / n for n in CONFIG_NAMES if (folder / n).exists()]
        if len(found) > 1:
            raise ValueError(f"{folder} has {len(found)} config files: {', '.join(p.name for p in found)}; keep one")
        if found:
            return str(found[0])
        if (folder / ".git").exists():
            return None
    return None


def load_config(path: str | Path) -> Config:
    try:
        spec = importlib.util.spec_from_file_location("typeloom_config", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
    except Exception as e:
        raise ValueError(f"{path}: {e}") from e
    if not hasattr(module, "STYLES"):
        raise ValueError(f"{path} doesn't set STYLES to a style made by compose or derive, or to several")
    given = module.STYLES if isinstance(module.STYLES, (list, tuple)) else [module.STYLES]
    if not given:
        raise ValueError(f"{path} sets STYLES to nothing")
    names: set[str] = set()
    for i, style in enumerate(given):
        if not isinstance(style, Style):
            raise ValueError(f"{path}: STYLES[{i}] is not a style")
        if style.name.lower() in names:
            raise ValueError(f"{path} has two styles named {style.name}")
        names.add(style.name.lower())
    return Config(str(path), tuple(given))


def available(config: Config | None = None) -> list[Listed]:
    """Styles of the config, then the built-in ones; a config's style hides a built-in one of its name."""
    own = config.styles if config else ()
    names = {s.name.lower() for s in own}
    return [Listed(s, "config", False) for s in own] + [Listed(s, "built-in", s.name.lower() in names) for s in STYLES]


def resolve_style(name: str, config: Config | None = None) -> Style | None:
    """A style by name, whatever its case: the config's, then a built-in one, then by language tag."""
    for style in (*(config.styles if config else ()), *STYLES):
        if style.name.lower() == name.lower():
            return style
    return style_for(name)
